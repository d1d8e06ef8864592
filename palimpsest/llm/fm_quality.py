"""Quality classifier: a factorisation machine (Rendle, "Factorization Machines", 2010).

A document is a sparse vector of hashed words (log counts at unit length), structure statistics and metadata (n_chars,
where the table has it). Score = w0 + <w, x> + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2], that is all
pairwise interactions in time linear in the words of a text.

It is fitted on a bounded sample of labelled documents that are not held out; labels, lang, source and doc_id are
never inputs.

Edge cases: null and empty texts have statistics of zero and a score like any other; null n_chars counts as zero;
repeated rows score alike; without labels the score is 0.5; columns of docs with the names of results are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .doc_stats import RATIOS, ratios
from .frames import map_text
from .labelled import SAMPLE_ROWS, crc_mod, sample
from .tokens import SPACED_LOWER, U, mix, words

HASH_BITS, RANK = 14, 6
STATS = [*RATIOS, "log_n_chars"]
N_INPUTS = (1 << HASH_BITS) + len(STATS)
PREDICT_FROM = 0.3


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def standard(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -4, 4)

    def margin(self, docs: np.ndarray, at: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        """Scores of n documents from entries (document, input, value), by the sum-of-squares identity."""
        out = self.bias + np.bincount(docs, self.weights[at] * x, minlength=n)[:n]
        vx = self.factors[at] * x[:, None]
        for f in range(vx.shape[1]):
            out += 0.5 * (np.bincount(docs, vx[:, f], minlength=n)[:n] ** 2 - np.bincount(docs, vx[:, f] ** 2, minlength=n)[:n])
        return out


def word_entries(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hashed word, value) of each distinct hashed word: log counts, at unit length a document."""
    w = words(offsets, data, SPACED_LOWER)
    n = len(offsets) - 1
    key, count = np.unique((w.docs.astype(U) << U(HASH_BITS)) | (mix(w.hashes) >> U(64 - HASH_BITS)), return_counts=True)
    docs, at, x = (key >> U(HASH_BITS)).astype(np.int64), (key & U((1 << HASH_BITS) - 1)).astype(np.int64), 1 + np.log(count)
    return docs, at, x / np.sqrt(np.maximum(np.bincount(docs, x * x, minlength=n), 1e-12))[docs]


def statistics(offsets: np.ndarray, data: np.ndarray, n_chars: np.ndarray) -> np.ndarray:
    return np.column_stack([ratios(offsets, data), np.log1p(np.maximum(n_chars, 0))])


def with_stats(docs: np.ndarray, at: np.ndarray, x: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, k = stats.shape
    return np.concatenate([docs, np.repeat(np.arange(n), k)]), np.concatenate([at, np.tile((1 << HASH_BITS) + np.arange(k), n)]), np.concatenate([x, stats.ravel()])


def train(docs: np.ndarray, at: np.ndarray, x: np.ndarray, stats: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 256, rate: float = 0.02, ridge: float = 1e-4, seed: int = 9) -> Machine:
    """Adam on the log loss. docs must be in ascending order."""
    rng = np.random.default_rng(seed)
    n = len(y)
    mean = stats.mean(axis=0) if n else np.zeros(len(STATS))
    m = Machine(float(np.log((y.sum() + 1) / (n - y.sum() + 1))) if n else 0.0, np.zeros(N_INPUTS), rng.normal(0, 0.02, (N_INPUTS, RANK)), mean, (stats.std(axis=0) if n else np.ones(len(STATS))) + 1e-6)
    if not 0 < y.sum() < n:
        return m
    first = np.searchsorted(docs, np.arange(n + 1))
    z = m.standard(stats)
    table = np.column_stack([m.weights, m.factors])
    moment, square, step, bias_moment = np.zeros_like(table), np.zeros_like(table), 0, 0.0
    for _ in range(epochs):
        order = rng.permutation(n)
        for k in range(0, n, batch):
            rows = order[k : k + batch]
            size = first[rows + 1] - first[rows]
            take = np.repeat(first[rows] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            d, i, v = with_stats(np.repeat(np.arange(len(rows)), size), at[take], x[take], z[rows])
            used, inverse = np.unique(i, return_inverse=True)
            m.weights, m.factors = table[:, 0], table[:, 1:]
            p = 1 / (1 + np.exp(-np.clip(m.margin(d, i, v, len(rows)), -30, 30)))
            g = (p - y[rows])[d] / len(rows)
            vx = m.factors[i] * v[:, None]
            total = np.column_stack([np.bincount(d, vx[:, f], minlength=len(rows)) for f in range(RANK)])
            grad = np.column_stack([np.bincount(inverse, g * v, minlength=len(used)), *[np.bincount(inverse, g * v * (total[d, f] - vx[:, f]), minlength=len(used)) for f in range(RANK)]])
            grad += ridge * table[used]
            step += 1
            moment[used] = 0.9 * moment[used] + 0.1 * grad
            square[used] = 0.999 * square[used] + 0.001 * grad * grad
            table[used] -= rate * (moment[used] / (1 - 0.9**step)) / (np.sqrt(square[used] / (1 - 0.999**step)) + 1e-8)
            bias_moment = 0.9 * bias_moment + 0.1 * float(np.mean(p - y[rows]))
            m.bias -= rate * bias_moment
    m.weights, m.factors = table[:, 0].copy(), table[:, 1:].copy()
    return m


def fit_machine(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS // 2) -> Machine:
    docs = docs if "n_chars" in docs.columns else docs.withColumn("n_chars", F.length("text"))
    own = sample(docs, labels, "quality", where=crc_mod("doc_id", 5) != 0, rows=rows, columns=("text", "n_chars"))

    def make():
        def work(offsets, data, n_chars):
            d, at, x = word_entries(offsets, data)
            ends = np.searchsorted(d, np.arange(len(offsets)))
            split = lambda v, t: [v[a:b].astype(t).tobytes() for a, b in zip(ends[:-1], ends[1:])]
            return {"at": split(at, np.int16), "x": split(x, np.float32), "stats": list(statistics(offsets, data, n_chars.fill_null(0).to_numpy(zero_copy_only=False)))}

        return work

    fields = [T.StructField("at", T.BinaryType()), T.StructField("x", T.BinaryType()), T.StructField("stats", T.ArrayType(T.DoubleType()))]
    got = map_text(own.withColumn("n_chars", F.col("n_chars").cast("long")), "text", fields, make, keep=["doc_id", "label"], also=("n_chars",)).toPandas().sort_values("doc_id", kind="stable")
    at = [np.frombuffer(b, np.int16) for b in got["at"]]
    x = [np.frombuffer(b, np.float32) for b in got["x"]]
    docs_at = np.repeat(np.arange(len(at)), [len(a) for a in at])
    none = [np.zeros(0, np.int64)]
    return train(docs_at, np.concatenate(at or none).astype(np.int64), np.concatenate(x or none).astype(float), np.array(got["stats"].tolist()).reshape(-1, len(STATS)), got["label"].to_numpy(float))


def quality_scores(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (default: all), held_out, score (0 to 1, higher: better), predicted."""
    keep = docs.columns if keep is None else keep
    chars = docs["n_chars"].cast("long") if "n_chars" in docs.columns else F.length(F.col(f"`{text_col}`")).cast("long")
    docs = docs.withColumn("metadata of the machine", chars)

    def make():
        def work(offsets, data, n_chars):
            stats = machine.standard(statistics(offsets, data, n_chars.fill_null(0).to_numpy(zero_copy_only=False)))
            margin = machine.margin(*with_stats(*word_entries(offsets, data), stats), len(stats))
            score = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            return {"score": score, "predicted": (score >= PREDICT_FROM).astype(np.int32)}

        return work

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    out = map_text(docs, text_col, fields, make, keep=keep, also=("metadata of the machine",))
    return out.withColumn("held_out", F.coalesce(crc_mod(id_col, 5) == 0, F.lit(False)))
