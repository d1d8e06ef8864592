from pyspark.sql import functions as F

from palimpsest import schemas
from palimpsest.operators import retrieval, state, windows
from palimpsest.sources import tables


def test_tables_and_snapshots(spark, tmp_path):
    schemas.create_all(spark, str(tmp_path / "store"))
    schemas.create_all(spark, str(tmp_path / "store"))  # again: what exists stays
    path = f"{tmp_path}/store/episodic_memories"
    rows = spark.createDataFrame([("1", "u", "text", "event"), ("2", "v", "text", "fact")], "id string, user_id string, content string, memory_type string")
    tables.append(schemas.empty(spark, "episodic_memories").unionByName(rows, allowMissingColumns=True), path)
    assert [r["id"] for r in tables.scan(spark, path, "u").collect()] == ["1"]
    episodic, semantic = tables.routed(rows)
    assert episodic.count() == semantic.count() == 1
    assert tables.without_user(rows, "u").count() == 1
    assert spark.read.parquet(tables.snapshot(rows, str(tmp_path / "snap"), "1")).count() == 2
    assert tables.alive(spark)


def test_questions(spark, tmp_path):
    (tmp_path / "q.json").write_text('[{"question_id": "q1", "question": "x", "haystack_sessions": [[{"role": "user", "content": "hi"}]], "haystack_session_ids": ["s1"], "haystack_dates": ["2024-01-01"]}]')
    texts = tables.session_texts(tables.questions(spark, str(tmp_path / "q.json")))
    assert texts.first()["text"] == "Session: s1\nDate: 2024-01-01\nuser: hi"
    tables.write_markdown(texts, str(tmp_path / "md"))
    assert spark.read.text(str(tmp_path / "md")).count() > 0
    tables.write_report(texts, str(tmp_path / "report"))
    assert "| q1 | s1 |" in tables.markdown_table(texts)


def test_episodes_and_vectors(spark):
    s = spark.createDataFrame([("u", "s", "x" * 3000)], "user_id string, session_id string, summary string")
    row = tables.session_episodes(s, "2024-01-01").first()
    assert row["memory_type"] == "session" and len(row["embed_text"]) == 2000
    v = spark.createDataFrame([(1, [1.0, 0.5])], "id long, embedding array<float>")
    assert tables.exported_vectors(v).first()["embedding"] == "[1.0,0.5]"


def test_keys(spark):
    keys = spark.createDataFrame([("a", "u", None), ("b", "v", "2024-01-01")], "api_key string, user_id string, revoked string").select(state.key_hash(F.col("api_key")).alias("key_hash"), "user_id", F.col("revoked").cast("timestamp").alias("revoked_at"))
    got = state.verified_keys(spark.createDataFrame([("a",), ("b",), ("c",)], "api_key string"), keys).collect()
    assert {r["api_key"]: r["user_id"] for r in got} == {"a": "u", "b": None, "c": None}


def test_timeline_and_detail(spark):
    rows = spark.createDataFrame([(str(i), "u", f"t{i}", "fact", i, "{}", "episodic") for i in range(6)], "id string, user_id string, text string, memory_type string, at long, metadata string, layer string").withColumn("created_at", F.timestamp_seconds("at"))
    got = retrieval.timeline(rows, rows.where("id = '3'"), 2, 1).collect()
    assert sorted((r["id"], r["side"], r["step"]) for r in got) == [("1", -1, 2), ("2", -1, 1), ("4", 1, 1)]
    assert retrieval.detail(rows, rows.where("id = '3'"), "other").count() == 0


def test_with_working(spark):
    results = spark.createDataFrame([("q", "m", "text", 0.5, "fact")], "query_id string, id string, text string, score double, source string")
    work = windows.recency_scores(spark.createDataFrame([("q", "w1", "old", 1), ("q", "w2", "new", 2)], "query_id string, id string, content string, turn long"), ["query_id"], "turn")
    assert [r["id"] for r in retrieval.with_working(results, work).orderBy("position").collect()] == ["w2", "m", "w1"]
