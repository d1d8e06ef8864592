"""Streams give what the batch forms give."""

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import windows
from palimpsest.streaming import messages as stream

SF = "/root/testdata/sf0.001"


def collect(spark, df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name)


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    calls = spark.read.parquet(f"{SF}/events.parquet").select(F.col("user_id").cast("string").alias("client"), F.col("event_id").alias("call_id"), F.col("ts").cast("timestamp").alias("at"))
    calls.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(calls.schema).parquet(str(tmp_path / "in"))
    got = {(r["call_id"], r["allowed"]) for r in collect(spark, stream.rate_limited(source, 1, 3600.0), "limited", tmp_path).collect()}
    assert got == {(r["call_id"], r["allowed"]) for r in windows.rate_limited(calls, "client", "at", "call_id", 1, 3600.0).collect()}


def test_drain_stream_equals_batch(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select(F.col("conv_id").cast("string").alias("session_id"), "turn", "role", F.col("text").alias("content"))
    rows.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream.ROCKSDB)
    try:
        got = {(r["session_id"], r["turn"], r["drain"]) for r in collect(spark, stream.drains(source, 3), "drained", tmp_path).collect()}
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    batch = windows.drains(rows, ["session_id"], "turn", 3)
    full = batch.groupBy("session_id", "drain").count().where("count = 3").drop("count")
    assert got == {(r["session_id"], r["turn"], r["drain"]) for r in batch.join(full, ["session_id", "drain"]).collect()}


@pytest.mark.parametrize("make, name", [(lambda s: stream.sessions(s, "user_id", "at"), "sessions_out"), (lambda s: stream.daily_usage(s), "daily_out")])
def test_windows_run(spark, tmp_path, make, name):
    rows = spark.read.parquet(f"{SF}/events.parquet").select(F.col("user_id").cast("string").alias("user_id"), F.col("ts").cast("timestamp").alias("at"), F.lit(1).alias("tokens"))
    rows.write.parquet(str(tmp_path / "in"))
    out = collect(spark, make(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))), name, tmp_path)
    assert out.count() > 0
