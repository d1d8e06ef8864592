"""Streaming forms of the stateful rules; each gives what its batch form in operators.windows gives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.windows import accepted

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Drain(StatefulProcessor):
    """Numbers the messages of a session and emits them in drains of `every`."""

    def __init__(self, every: int):
        self.every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", "turn bigint, role string, content string")
        self.count = handle.getValueState("count", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.waiting.get()]
        n = self.count.get()[0] if self.count.exists() else 0
        new = pd.concat(list(rows)).sort_values("turn", kind="stable")
        held += list(new[["turn", "role", "content"]].itertuples(index=False, name=None))
        out = []
        while len(held) >= self.every:
            n += 1
            out += [(key[0], n, *m) for m in held[: self.every]]
            held = held[self.every :]
        self.count.update((n,))
        self.waiting.put([(int(t), r, c) for t, r, c in held]) if held else self.waiting.clear()
        yield pd.DataFrame(out, columns=["session_id", "drain", "turn", "role", "content"])

    def close(self) -> None:
        pass


def drains(messages: DataFrame, every: int = 8) -> DataFrame:
    """session_id, drain, turn, role, content of a stream of messages, each drain once it is full. Needs RocksDB state."""
    return messages.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=_Drain(every), outputStructType="session_id string, drain bigint, turn bigint, role string, content string", outputMode="append", timeMode="none"
    )


def _limit(most: int, seconds: float):
    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        calls = pd.concat(list(batches)).sort_values(["at", "call_id"], kind="stable")
        times = (calls["at"].astype("int64") / (1e9 if "ns" in str(calls["at"].dtype) else 1e6)).tolist()
        allowed = accepted(kept + times, most, seconds)[len(kept) :]
        now = max(times) if times else 0
        state.update(([t for t in kept + [t for t, ok in zip(times, allowed) if ok] if t > now - seconds],))
        yield pd.DataFrame({"client": key[0], "call_id": calls["call_id"], "allowed": allowed})

    return run


def rate_limited(calls: DataFrame, most: int = 60, seconds: float = 60.0) -> DataFrame:
    """client, call_id, allowed of a stream of calls (client, call_id, at)."""
    return calls.groupBy("client").applyInPandasWithState(_limit(most, seconds), "client string, call_id long, allowed boolean", "kept array<double>", "append", "NoTimeout")


def sessions(events: DataFrame, key: str, at: str, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """key, start, end, n of sessions that end with a gap; emitted once the watermark has passed them."""
    rows = events.withWatermark(at, late)
    out = rows.groupBy(F.col(key), F.session_window(F.col(at), gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def daily_usage(usage: DataFrame, at: str = "at", late: str = "1 hour") -> DataFrame:
    """user_id, day, tokens."""
    rows = usage.withWatermark(at, late)
    return rows.groupBy("user_id", F.window(at, "1 day").alias("w")).agg(F.sum("tokens").alias("tokens")).select("user_id", F.to_date("w.start").alias("day"), "tokens")
