"""Documents to a training corpus, a stage after another. Part of the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.decontaminate import decontaminate
from palimpsest.llm.frames import delete, ensure_checkpoint_dir, table
from palimpsest.llm.mixing import TARGETS, fit_domains, mix
from palimpsest.llm.near_dup import without_near_duplicates
from palimpsest.llm.pii import pseudonymise
from palimpsest.llm.quality_rules import fit_rules, keep_good
from palimpsest.llm.queries import PII_KEY

#: A mix is to be worth this share of the tokens at least, as far as no few documents repeated hundreds of times are to stand for all.
LEAST_EFFECTIVE = 0.1


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the rules are fitted on the labelled documents of the table.

    A row is judged by its text alone, whatever its id; a null text fails the base rules.
    """
    return keep_good(docs, fit_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8): the one with the smallest id.

    Rows that share an id but aren't alike all stay, as do rows without an id or without words.
    """
    return without_near_duplicates(docs, shingle=5, percent=80)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate; each row by its own text, a null text has no words and stays."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")).select(docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with pseudonyms for personal data, row by row; n_chars follows the text; a null text stays null."""
    out = pseudonymise(docs, PII_KEY, count_col=None)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns) if "n_chars" in docs.columns else out.select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the copies that bring the domains' tokens to their target weights; none without a copy.

    A scarce domain's target that would leave a corpus worth less than LEAST_EFFECTIVE of its tokens is given up, with a warning.
    Rows that share an id are drawn alike; columns of documents with the names of results are replaced.
    """
    model = fit_domains(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return mix(docs, model, TARGETS, least_effective=LEAST_EFFECTIVE).where("n_copies > 0")


STAGES = [("quality rules", quality), ("near-duplicates", near_dup), ("contamination", contamination), ("pii", pii), ("mixing", mixing)]

#: Trained stages can't be written as SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES on documents, each written to the shared checkpoint folder and read again; what the next has read goes."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        delete(spark, f"{folder}/{k - 1}")
    return docs
