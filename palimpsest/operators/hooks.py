"""Injected models: embedders, language models, usage tracking, and deterministic stand-ins that work offline."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class Embedder(Protocol):
    id: str
    model: str

    def embed_query(self, text: str) -> list[float]: ...

    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


@dataclass
class HashEmbedder:
    """Words fall into slots by the sum of their code points, with half their weight in the next; unit length. A text
    without words is the first unit vector."""

    size: int = 16
    id: str = "hash"
    model: str = "hash-16"

    def embed_query(self, text: str) -> list[float]:
        v = np.zeros(self.size)
        for w in re.findall(r"\w+", text.lower()):
            slot = sum(map(ord, w)) % self.size
            v[slot] += 1.0
            v[(slot + 1) % self.size] += 0.5
        if not v.any():
            v[0] = 1.0
        return (v / np.sqrt(v @ v)).tolist()

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return [self.embed_query(t) for t in texts]


@dataclass
class Resized:
    """An embedder's vectors brought to one size, as functions.vector.resized does."""

    inner: Embedder
    size: int

    @property
    def id(self) -> str:
        return self.inner.id

    @property
    def model(self) -> str:
        return self.inner.model

    def _fit(self, v: list[float]) -> list[float]:
        x = np.asarray(v[: self.size], float)
        n = np.sqrt(x @ x)
        x = x / n if len(v) > self.size and n >= 1e-10 else x
        return np.pad(x, (0, self.size - len(x))).tolist()

    def embed_query(self, text: str) -> list[float]:
        return self._fit(self.inner.embed_query(text))

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return [self._fit(v) for v in self.inner.embed_batch(texts)]


#: Factories by name, asked in this order where no name is given; register what a deployment has.
PROVIDERS: dict[str, Callable[[str | None], Embedder | None]] = {}


def create_embedder(provider: str | None = None, model: str | None = None) -> Embedder:
    for name, make in PROVIDERS.items():
        if provider in (None, "auto", name) and (made := make(model)) is not None:
            return made
    raise ValueError(f"no embedding provider is available: {provider or 'auto'}")


def embedded(rows: DataFrame, text: str, make: Callable[[], Embedder], batch: int = 64, column: str = "embedding") -> DataFrame:
    """rows with an embedding of each text. make() runs in each worker; equal texts of a batch are embedded once; where
    a batch fails its texts are tried one by one, and those that fail are null."""
    from pyspark.sql import types as T

    schema = T.StructType([f for f in rows.schema.fields if f.name != column] + [T.StructField(column, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for pdf in batches:
            texts = list(dict.fromkeys(pdf[text].fillna("")))
            known: dict[str, list[float] | None] = {}
            for i in range(0, len(texts), batch):
                part = texts[i : i + batch]
                try:
                    known.update(zip(part, client.embed_batch(part)))
                except Exception:  # a provider may raise anything
                    for t in part:
                        try:
                            known[t] = client.embed_query(t)
                        except Exception:
                            known[t] = None
            yield pdf.drop(columns=[column], errors="ignore").assign(**{column: pdf[text].fillna("").map(known)})[schema.names]

    return rows.mapInPandas(run, schema)


@dataclass
class Call:
    input_tokens: int
    output_tokens: int
    operation: str
    duration_ms: float


@dataclass
class UsageTracker:
    """Wraps a language model, text -> text, and logs each call; a failed one with no output."""

    llm: Callable[[str], str]
    operation: str = ""
    calls: list[Call] = field(default_factory=list)

    def __call__(self, prompt: str) -> str:
        size = lambda t: max(1, len(t) // 4) if t else 0
        start, reply = time.perf_counter(), ""
        try:
            reply = self.llm(prompt)
            return reply
        finally:
            self.calls.append(Call(size(prompt), size(reply), self.operation, (time.perf_counter() - start) * 1000))

    def with_operation(self, operation: str) -> UsageTracker:
        return UsageTracker(self.llm, operation, self.calls)

    @property
    def total_tokens(self) -> int:
        return sum(c.input_tokens + c.output_tokens for c in self.calls)


#: The operations that may have a model of their own.
OPERATIONS = ("extraction", "conflict", "rerank", "answer", "consolidation", "promotion")


def models(default: Callable[[str], str] | None, **own: Callable[[str], str]) -> dict[str, Callable[[str], str] | None]:
    """A model for each operation, the default where it has none of its own."""
    unknown = set(own) - set(OPERATIONS)
    if unknown:
        raise ValueError(f"unknown operations: {sorted(unknown)}")
    return {op: own.get(op, default) for op in OPERATIONS}
