"""Answer and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalised_answer


def answer_scores(rows: DataFrame, prediction: str, answer: str) -> DataFrame:
    """rows with exact_match and f1 of two text columns, after normalisation; f1 of the bags of words, 1 if both are
    empty and 0 if one is. The texts are normalised in a step of their own, or each word would normalise them again."""
    words = lambda c: F.array_sort(F.filter(F.split(c, " "), lambda w: w != ""))
    rows = rows.withColumn("_p", normalised_answer(F.col(prediction))).withColumn("_a", normalised_answer(F.col(answer)))
    rows = rows.withColumn("exact_match", (F.col("_p") == F.col("_a")).cast("double")).withColumn("_p", words("_p")).withColumn("_a", words("_a"))
    rows = rows.withColumn("_p", _bag(F.col("_p"))).withColumn("_a", _bag(F.col("_a")))
    common, total = F.size(F.array_intersect("_p", "_a")), F.size("_p") + F.size("_a")
    f1 = F.when(total == 0, F.lit(1.0)).when(common == 0, F.lit(0.0)).otherwise(2.0 * common / total)
    return rows.withColumn("f1", f1).drop("_p", "_a")


def _bag(words: Column) -> Column:
    """Sorted words, each numbered among its equals, so that sets of them meet as bags do."""
    return F.transform(words, lambda w, i: F.concat(w, F.lit("#"), (i + 1 - F.array_position(words, w)).cast("string")))


def hits(results: DataFrame, evidence: DataFrame, k: int) -> DataFrame:
    """question_id, n_evidence, hit, coverage, all_hit of evidence files among the first k result paths (by suffix).

    results: question_id, position (0 first), path. evidence: question_id, file. A question without evidence scores 1.
    """
    top = results.where(F.col("position") < k).select("question_id", "path")
    files = evidence.distinct()
    found = files.join(top, "question_id").where(F.endswith("path", F.col("file"))).select("question_id", "file").distinct()
    n = files.groupBy("question_id").agg(F.count("*").alias("n_evidence"))
    got = found.groupBy("question_id").agg(F.count("*").alias("n_found"))
    rows = results.select("question_id").distinct().join(n, "question_id", "left").join(got, "question_id", "left")
    rows = rows.select("question_id", F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), F.coalesce("n_found", F.lit(0)).alias("_found"))
    share = F.when(F.col("n_evidence") == 0, F.lit(1.0)).otherwise(F.col("_found") / F.col("n_evidence"))
    return rows.select("question_id", "n_evidence", ((F.col("_found") > 0) | (F.col("n_evidence") == 0)).cast("double").alias("hit"), share.alias("coverage"), (share == 1).cast("double").alias("all_hit"))


def ranking_metrics(results: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """query_id, reciprocal_rank, recall, ndcg at k. results: query_id, position (0 first), id. relevant: query_id, id."""
    hit = results.join(relevant.withColumn("rel", F.lit(1)), ["query_id", "id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    gain = F.when(F.col("position") < k, F.col("rel") / F.log2(F.col("position") + 2)).otherwise(0.0)
    own = hit.groupBy("query_id").agg(F.max(F.when(F.col("rel") == 1, 1.0 / (F.col("position") + 1))).alias("rr"), F.sum(F.when(F.col("position") < k, F.col("rel")).otherwise(0)).alias("found"), F.sum(gain).alias("dcg"))
    n = relevant.groupBy("query_id").agg(F.count("*").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n").cast("int"), F.lit(k))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1))
    return own.join(n, "query_id").select("query_id", F.coalesce("rr", F.lit(0.0)).alias("reciprocal_rank"), (F.col("found") / F.col("n")).alias("recall"), (F.col("dcg") / ideal).alias("ndcg"))


def by_type(scores: DataFrame, metrics: list[str], retrieval: list[str]) -> DataFrame:
    """question_type (null: all), n and the mean of each metric; questions whose id ends in _abs count in no retrieval metric."""
    mean = lambda m: F.avg(F.when(~F.col("question_id").endswith("_abs"), F.col(m)) if m in retrieval else F.col(m)).alias(m)
    return scores.rollup("question_type").agg(F.count("*").alias("n"), *[mean(m) for m in metrics])


def evidence_support(hit: Column, prediction: Column) -> Column:
    return ((hit > 0) & (F.trim(F.coalesce(prediction, F.lit(""))) != "")).cast("double")


def best_run(runs: DataFrame, group: str, metric: str, fallback: str) -> DataFrame:
    """The run of each group with the best metric, the fallback where it is missing."""
    value = F.coalesce(F.col(metric), F.col(fallback), F.lit(0.0))
    return runs.groupBy(group).agg(F.max_by("run", F.struct(value, "run")).alias("run"), F.max(value).alias("best"))
