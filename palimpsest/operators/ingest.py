"""Conversation pre-processing: selection, sentence compression, topic segments, budget, summaries.

Conversations are rows of a session key, an order, role and content. Compression and segmentation are folds over one
message or one session; they run as Arrow batches of these.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as txt
from ..params import SensoryParams
from .windows import trimmed

_WORD = re.compile(r"[a-z0-9_]+")
_SENTENCE_END = re.compile(r"(?<=[.!?。！？])\s+")
_NAMES = re.compile(r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*|\"[^\"]+\"|'[^']+'")


def select_messages(messages: DataFrame, params: SensoryParams = SensoryParams()) -> DataFrame:
    """Messages with a normalised role and content, without empty and low-information ones."""
    role = F.lower(txt.strip(F.coalesce("role", F.lit("unknown"))))
    rows = messages.withColumn("role", F.when(role == "", "unknown").otherwise(role)).withColumn("content", txt.normalise(F.col("content")))
    rows = rows.where((F.col("content") != "") & ~txt.is_low_information(F.col("content")))
    return rows.where(F.col("role").isin("user", "system")) if params.messages_use == "user_only" else rows


def _kahan(values: Iterator[float]) -> float:
    """The sum by Kahan's steps, as SQL's fsum takes them; sum() corrects otherwise and may differ in the last bit."""
    total = error = 0.0
    for x in values:
        new = total + (x - error)
        error = (new - total) - (x - error)
        total = new
    return total


def sentence_weights(sentences: list[str]) -> list[float]:
    """Kahan sum over a sentence's terms of their share of it, times ln((n + 1) / (df + 1)) + 1; 0 without terms.

    Weights may be equal but for the last bit, so what is summed first, and how, decides which sentence stays.
    """
    counts = [Counter(_WORD.findall(s.lower())) for s in sentences]
    df = Counter(t for c in counts for t in c)
    n = len(sentences)
    return [_kahan(k / c.total() * (math.log((n + 1) / (df[t] + 1)) + 1) for t, k in c.items()) for c in counts]


def compress(text: str | None, limit: int) -> str:
    """At most about `limit` characters of a text: its first and last sentence and, of those between, the weightiest that
    fit; where that can't be, its head and tail around an ellipsis."""
    if limit <= 0:
        return ""
    text = " ".join((text or "").split())
    if len(text) <= limit:
        return text
    parts = [p for p in map(str.strip, _SENTENCE_END.split(text)) if p]
    room = limit - len(parts[0]) - len(parts[-1]) - 1
    if len(parts) <= 2 or room < 0:
        head = max(1, int(limit * 0.65))
        return f"{text[:head].rstrip()} ... {text[-max(1, limit - head - 5):].lstrip()}"
    weights, kept = sentence_weights(parts), {0, len(parts) - 1}
    for i in sorted(range(1, len(parts) - 1), key=lambda i: -weights[i]):
        if len(parts[i]) < room:
            kept.add(i)
            room -= len(parts[i]) + 1
    return " ".join(parts[i] for i in sorted(kept))


def compressed(text: Column, limit: int) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: compress(t, limit))

    return run(text)


def _size(text: str) -> int:
    return max(1, len(text) // 4) if text else 0


def _names(text: str) -> frozenset[str]:
    found = (x.strip("\"'").strip().lower() for x in _NAMES.findall(text))
    return frozenset(x for x in found if len(x) > 1)


def _alike(a: frozenset, b: frozenset) -> float:
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def topic_numbers(contents: list[str], params: SensoryParams = SensoryParams()) -> list[int]:
    """The topic of each message in turn: a new one where a long topic meets an unlike message, or grows too long."""
    full = max(64, params.topic_token_threshold)
    out, topic, size, words, names = [], 1, 0, frozenset(), frozenset()
    for content in contents:
        own, called, cost = frozenset(_WORD.findall(content.lower())), _names(content), _size(content)
        if out and ((size >= full and 0.6 * _alike(words, own) + 0.4 * _alike(names, called) < params.topic_similarity) or size + cost > 2 * full) and size:
            topic, size, words, names = topic + 1, 0, frozenset(), frozenset()
        out.append(topic)
        size, words, names = size + cost, words | own, names | called
    return out


def segmented(messages: DataFrame, keys: list[str], order: str, params: SensoryParams = SensoryParams()) -> DataFrame:
    """keys, order, role, content: a session of several topics as one system message a topic, others as they are."""
    rows = messages.select(*keys, order, "role", "content")
    if not params.topic_segment:
        return rows

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        topics = topic_numbers(pdf["content"].tolist(), params)
        if topics[-1] <= 1:
            return pdf
        pdf = pdf.assign(_topic=topics, _line=pdf["role"] + ": " + pdf["content"])
        out = pdf.groupby("_topic", sort=True).agg({**{k: "first" for k in keys}, order: "first", "_line": " ".join}).reset_index()
        out["role"] = "system"
        out["content"] = [f"[topic_{t}] {compress(x, max(80, params.segment_chars))}" for t, x in zip(out["_topic"], out["_line"])]
        return out[[*keys, order, "role", "content"]]

    return rows.groupBy(*keys).applyInPandas(run, rows.schema)


def prepared(messages: DataFrame, keys: list[str], order: str, params: SensoryParams = SensoryParams()) -> DataFrame:
    """Messages ready for extraction: selected, compressed, segmented, cut to the budget."""
    rows = select_messages(messages, params)
    if params.pre_compress:
        rows = rows.withColumn("content", compressed(F.col("content"), max(40, params.message_chars)))
    rows = segmented(rows, keys, order, params)
    budget = max(64, params.max_input_tokens)
    rows = trimmed(rows, keys, order, budget)
    over = F.col("tokens") > budget  # only a last message can be
    return rows.withColumn("content", F.when(over, compressed(F.col("content"), max(32, budget * 4))).otherwise(F.col("content"))).drop("tokens")


def session_summaries(messages: DataFrame, keys: list[str], order: str, params: SensoryParams = SensoryParams(), limit: int = 1800) -> DataFrame:
    """keys, summary: the prepared conversation in one text of at most about `limit` characters."""
    rows = prepared(messages, keys, order, params)
    turns = F.array_sort(F.collect_list(F.struct(order, "role", "content")))
    return rows.groupBy(*keys).agg(turns.alias("turns")).select(*keys, compressed(txt.conversation_lines(F.col("turns")), limit).alias("summary"))


def batched_sessions(sessions: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """Sessions merged by `size` in order: key, batch, turns."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    rows = sessions.withColumn("batch", F.floor(n / size).cast("long"))
    merged = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col("turns"))))
    return rows.groupBy(key, "batch").agg(F.flatten(F.transform(merged, lambda s: s["turns"])).alias("turns"))


def user_chunks(messages: DataFrame, keys: list[str], order: str, size: int = 1600, overlap: int = 120) -> DataFrame:
    """keys, chunk_no, chunk: overlapping pieces of a session's user turns, or of all turns where it has none."""
    turns = F.array_sort(F.collect_list(F.struct(order, "role", "content")))
    rows = messages.groupBy(*keys).agg(turns.alias("turns"))
    own = F.filter("turns", lambda t: t["role"] == "user")
    text = F.when(F.size(own) > 0, txt.conversation_lines(own)).otherwise(txt.conversation_lines(F.col("turns")))
    return rows.select(*keys, F.posexplode(txt.chunks(text, size, overlap)).alias("chunk_no", "chunk"))


def extracted(prepared_rows: DataFrame, keys: list[str], order: str, llm) -> DataFrame:
    """keys and the memories that llm (text -> reply) finds in each session; the callable is made in each worker."""
    from ..functions.json import memories

    fields = "content string, memory_type string, confidence double, metadata string, memory_key string, value string, event_time string, source_refs array<string>"
    turns = F.array_sort(F.collect_list(F.struct(order, "role", "content")))
    sessions = prepared_rows.groupBy(*keys).agg(txt.conversation_lines(turns).alias("conversation"))
    schema = T.StructType([f for f in sessions.schema.fields if f.name in keys] + T._parse_datatype_string(fields).fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{k: r[k] for k in keys} | m for r in pdf.to_dict("records") for m in memories(llm(r["conversation"]))]
            yield pd.DataFrame(rows, columns=schema.names)

    return sessions.mapInPandas(run, schema)
