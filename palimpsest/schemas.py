"""The tables of the memory store, and the uniform view over its layers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = {
    "episodic_memories": "id string, user_id string, session_id string, content string, embedding array<float>, memory_type string, created_at timestamp, metadata string",
    "semantic_memories": "id string, user_id string, content string, embedding array<float>, memory_type string, created_at timestamp, metadata string",
    "canonical_memories": "id string, user_id string, memory_key string, value string, memory_type string, confidence double, event_time timestamp, status string, supersedes_memory_id string, embedding array<float>, created_at timestamp, updated_at timestamp, metadata string, consolidated_from array<string>, consolidation_round int, last_consolidated_at timestamp",
    "working_messages": "id string, user_id string, session_id string, role string, content string, created_at timestamp, turn bigint",
    "user_profiles": "user_id string, profile string, updated_at timestamp, token_budget_daily int, tokens_used_today int, budget_reset_at timestamp",
    "consolidation_log": "id bigint, user_id string, started_at timestamp, finished_at timestamp, memories_scanned int, memories_merged int, memories_deleted int, memories_abstracted int, status string, error string, metadata string",
    "memory_update_queue": "id bigint, user_id string, payload string, status string, attempts int, last_error string, available_at timestamp, created_at timestamp, updated_at timestamp",
    "short_term_buffer": "id string, user_id string, session_id string, messages array<struct<role:string,content:string>>, topic_summary string, token_count int, created_at timestamp, updated_at timestamp",
    "api_keys": "key_hash string, user_id string, label string, created_at timestamp, revoked_at timestamp",
}
LAYERS = ("episodic", "semantic", "canonical")


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])


def create_all(spark: SparkSession, folder: str) -> None:
    """Writes each missing table as an empty Parquet folder; what exists stays as it is."""
    for name in TABLES:
        empty(spark, name).write.mode("ignore").parquet(f"{folder}/{name}")


def memory_view(df: DataFrame, layer: str) -> DataFrame:
    """id, user_id, text, memory_type, created_at, metadata, embedding, layer; of canonical memories the active ones."""
    if layer not in LAYERS:
        raise ValueError(f"unknown layer: {layer}")
    if layer == "canonical":
        df = df.where(F.col("status") == "active")
    text = F.col("value" if layer == "canonical" else "content")
    return df.select("id", "user_id", text.alias("text"), "memory_type", "created_at", "metadata", "embedding", F.lit(layer).alias("layer"))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def source_label() -> Column:
    """The memory type, or the layer where it is null or empty."""
    return F.coalesce(F.nullif(F.col("memory_type"), F.lit("")), F.col("layer"))
