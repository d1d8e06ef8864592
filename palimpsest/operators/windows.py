"""Working-memory windows: recent messages, recency scores, drains, trimming, sampling, limits."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
import pyspark.sql.types as T
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import estimated_tokens


def recent(messages: DataFrame, keys: list[str], order: str, n: int = 20) -> DataFrame:
    """The last n messages of each session."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return messages.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def recency_scores(messages: DataFrame, keys: list[str], order: str) -> DataFrame:
    """score from 0.3 for the oldest to 0.6 for the newest; empty messages count in the scale and are left out."""
    i = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    n = F.count("*").over(Window.partitionBy(*keys))
    rows = messages.withColumn("score", 0.3 + 0.3 * i / F.greatest(n - 1, F.lit(1)))
    return rows.where(F.coalesce(F.col("content"), F.lit("")) != "")


def drains(messages: DataFrame, keys: list[str], order: str, every: int = 8) -> DataFrame:
    """message number, and the drain it goes with: message 1 to `every` with drain 1, and so on; is_drain at its last."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    rows = messages.withColumn("number", n.cast("long"))
    return rows.withColumn("drain", F.ceil(F.col("number") / every).cast("long")).withColumn("is_drain", F.col("number") % every == 0)


def trimmed(messages: DataFrame, keys: list[str], order: str, budget: int) -> DataFrame:
    """Messages that stay when a session is cut to `budget` estimated tokens.

    Messages go one by one: those before the first system message, then those after it; the first system message
    goes last, as does a last message. So a message stays once what goes before it brings the sum down far enough.
    """
    if budget <= 0:
        return messages.limit(0)
    rows = messages.withColumn("tokens", estimated_tokens(F.col("content")).cast("long"))
    all_rows = Window.partitionBy(*keys)
    first_system = F.min(F.when(F.col("role") == "system", F.col(order))).over(all_rows)
    rows = rows.withColumn("_place", F.when(F.col(order) == first_system, 1).otherwise(0))
    by = all_rows.orderBy("_place", order)
    gone = F.coalesce(F.sum("tokens").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("tokens").over(all_rows) - gone
    last = F.row_number().over(all_rows.orderBy(F.desc("_place"), F.desc(order))) == 1
    return rows.withColumn("_left", left).withColumn("_last", last).where((F.col("_left") <= budget) | F.col("_last")).drop("_place", "_left", "_last")


def first_of(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def spread(rows: DataFrame, keys: list[str], path: str, order: str) -> DataFrame:
    """Rows of each key with the first of each path ahead of the rest; position tells the order."""
    rows = rows.withColumn("_again", F.row_number().over(Window.partitionBy(*keys, path).orderBy(order)) > 1)
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy("_again", order)) - 1).drop("_again")


def balanced_sample(rows: DataFrame, kind: str, order: str, limit: int) -> DataFrame:
    """`limit` rows, as evenly over kinds as they allow; all rows for limit <= 0."""
    if limit <= 0:
        return rows
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(kind).orderBy(order)))
    return rows.orderBy("_n", kind).limit(limit).drop("_n")


#: Calls of a client that stay in one piece at least.
SPAN = 5000


def folded(rows: DataFrame, keys: list[str], order: list[str], field: T.StructField, step: Callable[[object, dict], tuple[object, object]]) -> DataFrame:
    """rows with `field`: step(state, row) -> (state, value) over each key's rows in order, beginning with None.

    Partitions are read through in order of key, so a key's rows are never gathered; only its state is held.
    """
    schema = T.StructType([*rows.schema.fields, field])
    # By a hash of the keys: for the keys themselves the planner may take a partitioning that it gives up later.
    dealt = rows.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for pdf in batches:
            own, out = list(zip(*[pdf[k] for k in keys])), []
            columns = {c: pdf[c].astype(object).where(pdf[c].notna(), None).tolist() for c in pdf.columns}
            for i, key in enumerate(own):
                if key != last:
                    last, state = key, None
                state, value = step(state, {c: v[i] for c, v in columns.items()})
                out.append(value)
            yield pdf.assign(**{field.name: out})

    return dealt.mapInPandas(run, schema)


def accepted(times: list[float], most: int, seconds: float = 60.0) -> list[bool]:
    """Which of a client's calls a sliding limit lets through; calls that it turns away don't count."""
    out, kept, start = [], [], 0
    for t in times:
        while start < len(kept) and kept[start] <= t - seconds:
            start += 1
        ok = len(kept) - start < most
        out.append(ok)
        if ok:
            kept.append(t)
    return out


def rate_limited(calls: DataFrame, client: str, at: str, order: str, most: int = 60, seconds: float = 60.0) -> DataFrame:
    """calls with allowed: whether a client's accepted calls of the last `seconds` leave room; refused ones leave no trace.

    After a pause of `seconds` nothing is left of a client's past, so its calls are dealt out between pauses, SPAN or more in
    a piece, and each piece runs through in order: what is held is the accepted calls of one window, never a client.
    """
    w = Window.partitionBy(client).orderBy(at, order)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    pause = F.coalesce(micros - F.lag(micros).over(w) >= int(seconds * 1e6), F.lit(True))
    n = F.row_number().over(w)
    rows = calls.withColumn("_micros", micros).withColumn("_span", F.floor(F.max(F.when(pause, n)).over(w.rowsBetween(Window.unboundedPreceding, 0)) / SPAN))

    def step(kept: deque | None, row: dict) -> tuple[deque, bool]:
        kept = deque() if kept is None else kept
        while kept and kept[0] <= row["_micros"] - seconds * 1e6:
            kept.popleft()
        ok = len(kept) < most
        if ok:
            kept.append(row["_micros"])
        return kept, ok

    return folded(rows, [client, "_span"], ["_micros", order], T.StructField("allowed", T.BooleanType()), step).drop("_micros", "_span")


def sessions(events: DataFrame, key: str, at: str, order: str, hours: float = 2.0) -> DataFrame:
    """events with session: a new one after a gap longer than `hours`."""
    w = Window.partitionBy(key).orderBy(at, order)
    gap = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp"))
    return events.withColumn("_new", (gap > int(hours * 3.6e9)).cast("int")).withColumn("session", F.coalesce(F.sum("_new").over(w), F.lit(0)).cast("long") + 1).drop("_new")
