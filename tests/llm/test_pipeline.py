"""The pipeline's stages against brute force, and its run."""

import hashlib
import re

import corpus_pipeline as pipe
from palimpsest.llm import queries

from .test_operators import SF, contamination, groups


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = []
    for k, (name, stage) in enumerate(pipe.STAGES):
        before = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        if k + 1 < len(pipe.STAGES):
            assert docs.columns == columns, name
        if name == "quality rules":
            want = {r["doc_id"] for r in queries.op3_gbt_rules(spark, SF).where("kept").collect()}
            assert set(after) == want
        if name == "near-duplicates":
            assert set(after) == {i for (i, _), (_, c) in zip(before, groups(before, 5, 80)) if i == c}
        if name == "contamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert set(after) == {i for (i, _), x in zip(before, contamination(before, items)) if not x[-1]}
        if name == "pii":
            assert set(after) == {i for i, _ in before}
            for i, text in before:
                for mail in re.findall(r"[\w.]+@[\w.]+\.com", text):
                    assert mail not in after[i]
        kept.append(len(after))
    assert kept == sorted(kept, reverse=True) and docs.where("n_copies < 1").count() == 0


def test_run_is_repeatable(spark):
    digest = lambda df: hashlib.sha256(str(sorted((r["doc_id"], r["text"]) for r in df.collect())).encode()).hexdigest()
    assert digest(pipe.run(spark, SF)) == digest(queries.pipeline(spark, SF))


def test_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(pipe.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert docs.count() == 0


def test_shared_ids_lose_no_text(spark):
    words = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    rows = [(1, words(1, 40)), (1, words(2, 40)), (2, words(2, 40) + " more"), (3, words(3, 40)), (3, words(3, 40)), (4, words(1, 40)), (5, ""), (5, None), (None, words(1, 40)), (None, words(9, 40)), (6, words(6, 40)), (6, words(6, 40) + " end"), (7, words(7, 40))]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, component_id int")
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in pipe.near_dup(spark, docs, SF).collect())
    want = [(-1, rows[8][1]), (-1, rows[9][1]), (1, rows[0][1]), (1, rows[1][1]), (3, rows[3][1]), (5, ""), (5, ""), (7, rows[12][1])]
    assert [x for x in got if x[0] != 6] == sorted(want) and len([x for x in got if x[0] == 6]) == 1
    assert pipe.near_dup(spark, docs, SF).columns == docs.columns
    unique = docs.where("component_id in (0, 2, 3, 5, 6, 8, 9)")
    assert sorted(r["component_id"] for r in pipe.near_dup(spark, unique, SF).collect()) == [0, 2, 3, 6, 8, 9]
