"""Readers and writers: Parquet tables of tenants, JSON question sets, Markdown sessions, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vector import literal

QUESTIONS = "question_id string, question_type string, question string, answer string, haystack_sessions array<array<struct<role:string,content:string>>>, haystack_session_ids array<string>, haystack_dates array<string>, answer_session_ids array<string>"


def scan(spark: SparkSession, path: str, user_id=None) -> DataFrame:
    """A Parquet table, one tenant's rows where one is given; the filter reaches the scan."""
    rows = spark.read.parquet(path)
    return rows.where(F.col("user_id") == user_id) if user_id is not None else rows


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def snapshot(rows: DataFrame, folder: str, version: str) -> str:
    """Writes the next snapshot of a table beside the others and returns its path; readers change over by name."""
    path = f"{folder}/version={version}"
    rows.write.mode("errorifexists").parquet(path)
    return path


def routed(memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(episodic, semantic): events to the first, all else to the second."""
    event = F.coalesce(F.col("memory_type") == "event", F.lit(False))
    return memories.where(event), memories.where(~event)


def session_episodes(summaries: DataFrame, now: str) -> DataFrame:
    """Episodic rows (type session) of summaries (user_id, session_id, summary); embed_text is what is to be embedded."""
    return summaries.select(
        F.sha2(F.concat_ws("|", "user_id", "session_id", "summary"), 256).alias("id"), "user_id", "session_id", F.col("summary").alias("content"), F.lit(None).cast("array<float>").alias("embedding"),
        F.lit("session").alias("memory_type"), F.lit(now).cast("timestamp").alias("created_at"), F.lit("{}").alias("metadata"), F.left("summary", F.lit(2000)).alias("embed_text"),
    )


def without_user(rows: DataFrame, user_id) -> DataFrame:
    return rows.where(~F.col("user_id").eqNullSafe(F.lit(user_id)))


def questions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of question instances."""
    return spark.read.schema(QUESTIONS).option("multiLine", True).json(path)


def session_texts(instances: DataFrame) -> DataFrame:
    """question_id, session_id, text of each session of the instances."""
    zipped = F.arrays_zip(F.col("haystack_session_ids").alias("id"), F.col("haystack_dates").alias("date"), F.col("haystack_sessions").alias("turns"))
    rows = instances.select("question_id", F.explode(zipped).alias("s"))
    turns = F.transform("s.turns", lambda t: F.concat(t["role"], F.lit(": "), t["content"]))
    text = F.concat_ws("\n", F.concat(F.lit("Session: "), F.col("s.id")), F.concat(F.lit("Date: "), F.col("s.date")), F.array_join(turns, "\n"))
    return rows.select("question_id", F.col("s.id").alias("session_id"), text.alias("text"))


def write_markdown(texts: DataFrame, path: str) -> None:
    """One Markdown block a session, in files of text."""
    texts.select(F.concat(F.lit("# "), "session_id", F.lit("\n\n"), "text", F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def markdown_table(rows: DataFrame, most: int = 100) -> str:
    """A report of at most `most` rows as a Markdown table."""
    head = "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns) + "\n"
    return head + "".join("| " + " | ".join(str(v) for v in r) + " |\n" for r in rows.limit(most).collect())


def exported_vectors(rows: DataFrame, column: str = "embedding") -> DataFrame:
    return rows.withColumn(column, literal(F.col(column)))


def alive(spark: SparkSession) -> bool:
    return spark.sql("select 1").first()[0] == 1
