"""Toxicity by a string-kernel support vector machine with Nystrom landmarks.

The kernel is the gap-weighted subsequence kernel of Lodhi et al. ("Text Classification using String Kernels", 2002)
on the words of a text, with subsequences of three characters spanning at most SPAN: each counts DECAY**span, so
skipped and inserted characters weaken a match and don't end it. Word edges are characters of their own; characters
that are neither letters nor digits match nothing and only widen a gap. The kernel is divided by lengths' norms.

Landmarks are words of the fitting sample (Williams & Seeger, "Using the Nystrom Method", 2001). As a subsequence
kernel has an explicit feature map, the landmark expansion of the machine folds into one weight per triple of
characters: a word is scored by table lookups, exactly as by the sum over landmarks.

A sentence is as toxic as its most toxic word (or run of single letters), a text as its most toxic sentence. Only
texts are labelled, so fitting is multi-instance: the words that explain the toxic sentences are found by greedy
cover, the machine is fitted on them against words of clean sentences, and instances are chosen anew a few times.
Labels are those of a bounded sample of documents that are not held out; lang, source and doc_id are never inputs.

Edge cases: null and empty texts, and texts without a letter, get the lowest score; repeated rows score alike;
without labels of both kinds every score is 0.5; columns of docs with the names of results are replaced.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import map_text, pieces, utf8
from .labelled import crc_mod, sample
from .tokens import SPACED_LOWER, Words, prefix_hashes, spans, words

SPAN, DECAY = 7, 0.7
PREDICT_FROM = 0.7
#: Most labelled documents fitted on, a quarter of them toxic, and most landmarks.
SAMPLE_DOCS, LANDMARKS = 5_000, 192
#: Words that explain a toxic text before it counts as explained.
COVER = 4
#: Words longer than this are not divided by more than its norm, or insults glued into long words would vanish.
NORM_LENGTH = 14

_START, _END, _OTHER, _DROP = 62, 63, 0, 255
#: Class of each byte: letters 1-26, digits 27-36, bytes that continue a code point 37-61; lead bytes go.
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[48:58] = np.arange(27, 37)
_CLASS[0x80:0xC0] = 37 + np.arange(64) % 25
_CLASS[0xC0:] = _DROP
_OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


@dataclass
class Units:
    """Character classes of strings, one after another with their edges, and the string of each."""

    codes: np.ndarray
    owner: np.ndarray
    n: int

    def take(self, rows: np.ndarray) -> Units:
        first = np.searchsorted(self.owner, np.arange(self.n + 1))
        size = first[rows + 1] - first[rows]
        at = np.repeat(first[rows] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        return Units(self.codes[at], np.repeat(np.arange(len(rows)), size), len(rows))


def units(w: Words, rows: np.ndarray) -> Units:
    """The words w[rows] without the other characters around them, as Units."""
    cls = _CLASS[w.data]
    kept = np.concatenate(([0], np.cumsum(cls != _DROP)))
    cls = cls[cls != _DROP]
    starts, ends = kept[w.starts[rows]], kept[w.ends[rows]]
    at = np.flatnonzero(cls > 0)
    first, last = np.searchsorted(at, starts), np.searchsorted(at, ends) - 1
    some = last >= first
    starts, ends = np.where(some, at[np.minimum(first, len(at) - 1)] if len(at) else 0, 0), np.where(some, (at[np.maximum(last, 0)] if len(at) else 0) + 1, 0)
    size = np.where(some, ends - starts, 0) + 2
    total = np.concatenate(([0], np.cumsum(size)))
    owner = np.repeat(np.arange(len(rows)), size)
    pos = np.arange(total[-1]) - total[owner]
    codes = cls[np.clip(starts[owner] + pos - 1, 0, max(len(cls) - 1, 0))] if len(cls) else np.zeros(total[-1], np.uint8)
    codes = codes.astype(np.uint8)
    codes[total[:-1]], codes[total[1:] - 1] = _START, _END
    return Units(codes, owner, len(rows))


def from_strings(strings: list[str]) -> Units:
    w = words(*utf8(pa.array([s.replace(" ", "") or "." for s in strings], pa.string())), SPACED_LOWER)
    return units(w, np.arange(len(w.starts)))


def triples(u: Units):
    """(owner, triple, weight) of all subsequences of three, offset by offset."""
    codes, n = u.codes.astype(np.int32), len(u.codes)
    for a, b in _OFFSETS:
        if n <= b:
            continue
        x, y, z = codes[: n - b], codes[a : n - b + a], codes[b:]
        at = np.flatnonzero((u.owner[: n - b] == u.owner[b:]) & (x > 0) & (y > 0) & (z > 0))
        yield u.owner[at], (x[at] << 12) | (y[at] << 6) | z[at], DECAY ** (b + 1)


def norms(u: Units) -> np.ndarray:
    total = np.full(u.n, 1e-9)
    for owner, _, weight in triples(u):
        total += weight**2 * np.bincount(owner, minlength=u.n)
    most = sum(DECAY ** (2 * (b + 1)) * max(0, NORM_LENGTH - b) for _, b in _OFFSETS)
    return np.sqrt(np.minimum(total, most))


def features(u: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Explicit feature map: (string, triple, value), summed over equal triples and divided by the norm."""
    owner, triple, value = (np.concatenate(x) if x else np.zeros(0) for x in zip(*[(o, t, np.full(len(o), v)) for o, t, v in triples(u)])) if len(u.codes) > 2 else (np.zeros(0, int),) * 3
    key, inverse = np.unique(owner.astype(np.int64) << 18 | triple.astype(np.int64), return_inverse=True)
    total = np.bincount(inverse, value, minlength=len(key))
    owner = key >> 18
    return owner, key & 0x3FFFF, total / norms(u)[owner]


def kernel(u: Units, landmarks: Units) -> np.ndarray:
    """Kernel of each string with each landmark."""
    lo, lt, lv = features(landmarks)
    used, column = np.unique(lt, return_inverse=True)
    dense = np.zeros((len(used) + 1, landmarks.n))
    np.add.at(dense, (column, lo), lv)
    out = np.zeros((u.n, landmarks.n))
    o, t, v = features(u)
    at = np.searchsorted(used, t)
    at[(at >= len(used)) | (used[np.minimum(at, len(used) - 1)] != t)] = len(used)
    ok = at < len(used)
    o, at, v = o[ok], at[ok], v[ok]
    for k in range(0, len(o), 20_000):
        part = slice(k, k + 20_000)  # owners ascend
        rows, first = np.unique(o[part], return_index=True)
        out[rows] += np.add.reduceat(dense[at[part]] * v[part, None], first)
    return out


@dataclass
class Machine:
    table: np.ndarray  # weight of each triple
    bias: float
    slope: float
    shift: float

    def decide(self, u: Units) -> np.ndarray:
        total = np.zeros(u.n)
        for owner, triple, weight in triples(u):
            total += weight * np.bincount(owner, self.table[triple], minlength=u.n)
        return total / norms(u) + self.bias

    def probability(self, decision: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.clip(decision, *SCALED) + self.shift, -30, 30)))


#: The machine without labels of both kinds.
CONSTANT = Machine(np.zeros(1 << 18), 0.0, 0.0, 0.0)
#: What a text without words decides.
LOWEST = -3.0
#: Decisions beyond these count as these in the scaling to probabilities: toxic texts without a toxic word tell it nothing.
SCALED = (-1.5, 1.5)


def spelled_out(w: Words) -> list[tuple[int, str]]:
    """(document, joined run) of four or more words of one letter in a row."""
    cls = _CLASS[w.data]
    letters = np.concatenate(([0], np.cumsum((cls > 0) & (cls != _DROP))))
    one = np.concatenate(([False], (letters[w.ends] - letters[w.starts]) == 1, [False]))
    edge = np.flatnonzero(one[1:] != one[:-1])
    out = []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        for d in range(int(w.docs[a]), int(w.docs[b - 1]) + 1):
            i, j = max(a, int(w.first[d])), min(b, int(w.first[d + 1]))
            if j - i >= 4:
                out.append((d, b"".join(w.data[w.starts[k] : w.ends[k]].tobytes() for k in range(i, j)).decode("utf-8", "ignore")))
    return out


def _inserted(codes: np.ndarray) -> np.ndarray:
    return (codes == _OTHER) | ((codes >= 27) & (codes <= 36))


def decisions(machine: Machine, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The largest decision among each document's words; each distinct word of the block is scored once."""
    n = len(offsets) - 1
    out = np.full(n, LOWEST)
    w = words(offsets, data, SPACED_LOWER)
    if not len(w.hashes):
        return out
    _, rows, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
    u = units(w, rows)
    got = machine.decide(u)
    inner = np.unique(u.owner[_inserted(u.codes)])  # with signs or digits inside: also without them
    if len(inner):
        part = u.take(inner)
        keep = ~_inserted(part.codes)
        got[inner] = np.maximum(got[inner], machine.decide(Units(part.codes[keep], part.owner[keep], part.n)))
    np.maximum.at(out, w.docs, np.maximum(got[inverse], LOWEST))
    if spelled := spelled_out(w):
        for (d, _), x in zip(spelled, machine.decide(from_strings([s for _, s in spelled]))):
            out[d] = max(out[d], x)
    return out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Squared-hinge machine in the primal by Newton steps (Chapelle, 2007)."""
    x = np.column_stack([x, np.ones(len(x))])
    beta, last = np.zeros(x.shape[1]), None
    reg = ridge * np.eye(x.shape[1])
    reg[-1, -1] = 1e-6
    for _ in range(30):
        active = y * (x @ beta) < 1
        if last is not None and (active == last).all():
            break
        last = active
        xa = x[active] * weight[active, None]
        beta = np.linalg.solve(xa.T @ x[active] + reg, xa.T @ y[active])
    return beta


def _vocabulary(texts: list[str]) -> tuple[Units, np.ndarray, np.ndarray]:
    """The distinct words of texts as Units, in order of their hashes, and the pairs (text, word), each once.

    Words that differ in the signs around them alone are one.
    """
    offsets, data = utf8(pa.array(texts, pa.string()))
    hashes, parts, pairs = [], [], []
    for i, j in pieces(offsets, 1_000_000):
        at = offsets[i : j + 1]
        w = words(at - at[0], data[at[0] : at[-1]], SPACED_LOWER)
        _, first, of = np.unique(w.hashes, return_index=True, return_inverse=True)
        u = units(w, first)
        edge = np.searchsorted(u.owner, np.arange(u.n + 1))
        own = spans(prefix_hashes(u.codes), edge[:-1], edge[1:])
        hashes.append(own)
        parts.append(u)
        pairs.append((w.docs + i, own[of]))
    every, rows = np.unique(np.concatenate(hashes), return_index=True)
    shift = np.concatenate(([0], np.cumsum([u.n for u in parts])))
    joined = Units(np.concatenate([u.codes for u in parts]), np.concatenate([u.owner + k for u, k in zip(parts, shift)]), int(shift[-1]))
    pair = np.unique(np.concatenate([np.unique(d.astype(np.int64) << 32 | np.searchsorted(every, h)) for d, h in pairs]))
    return joined.take(rows), pair >> 32, pair & 0xFFFFFFFF


FOLDS = 3


def train(labels: np.ndarray, texts: list[str], seed: int = 8) -> Machine:
    """labels and texts of labelled documents.

    The scaling to probabilities, and the decision that has PREDICT_FROM, come from decisions on texts that the machine
    was not fitted on: the rows given are dealt into FOLDS parts, and each is decided by a machine of the others.
    """
    first_of = {t: k for k, t in reversed(list(enumerate(texts)))}  # copies add nothing
    rows = np.array(sorted(first_of.values()), int)
    labels, texts = np.asarray(labels)[rows], [texts[k] for k in rows]
    toxic = labels == 1
    if not toxic.any() or toxic.all():
        return CONSTANT
    fold = np.array([zlib.crc32(t[:200].encode()) % FOLDS for t in texts])  # near copies, mostly, together
    top = np.full(len(texts), LOWEST)
    for k in range(FOLDS):
        inner, outer = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(outer) and toxic[inner].any() and not toxic[inner].all():
            top[outer] = decisions(_machine(toxic[inner], [texts[i] for i in inner], seed, turns=2), *utf8(pa.array([texts[i] for i in outer], pa.string())))
    return _scaled(_machine(toxic, texts, seed), top, toxic)


def _scaled(machine: Machine, top: np.ndarray, toxic: np.ndarray) -> Machine:
    """The machine with Platt's slope, and the shift that gives PREDICT_FROM to the decision `top` with the best F1."""
    if machine is CONSTANT:
        return machine
    x, t = np.column_stack([np.clip(top, *SCALED), np.ones(len(top))]), np.where(toxic, (toxic.sum() + 1) / (toxic.sum() + 2), 1 / ((~toxic).sum() + 2))
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-4)[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - t) + 1e-3 * beta)
        beta = beta - np.clip(step, -2, 2)
    cuts = np.arange(-1.0, SCALED[1], 0.05)
    found, flagged = np.array([(toxic & (top >= c)).sum() for c in cuts]), np.array([(top >= c).sum() for c in cuts])
    f1 = 2 * found / (flagged + toxic.sum())
    best = np.median(cuts[f1 >= f1.max() - 0.002])  # the middle, where several do
    machine.slope = float(max(beta[0], 2.0))
    machine.shift = float(np.log(PREDICT_FROM / (1 - PREDICT_FROM)) - machine.slope * best)
    return machine


def _machine(toxic: np.ndarray, texts: list[str], seed: int, turns: int = 4) -> Machine:
    vocabulary, doc, word = _vocabulary(texts)
    in_toxic = np.bincount(word[toxic[doc]], minlength=vocabulary.n)
    in_clean = np.bincount(word[~toxic[doc]], minlength=vocabulary.n)
    odds = ((in_toxic + 0.1) / (toxic.sum() + 1)) / ((in_clean + 0.1) / ((~toxic).sum() + 1))
    rng = np.random.default_rng(seed)

    # Near copies count together: a text weighs 1 over the texts with its two smallest word hashes.
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    smallest = [tuple(word[i : min(i + 2, j)].tolist()) for i, j in zip(first[:-1], first[1:])]  # word numbers follow hashes
    copies = Counter(smallest)
    share = np.array([1 / copies[k] for k in smallest])

    # Greedy cover: the words that tell toxic texts from clean ones, the most telling first, until COVER of them
    # explain each toxic text.
    order = np.argsort(word, kind="stable")
    has = np.searchsorted(word[order], np.arange(vocabulary.n + 1))
    left = np.bincount(word, np.where(toxic, share, 0)[doc], minlength=vocabulary.n)
    left[(odds <= 8) | (in_toxic < 3)] = 0
    telling, unexplained, picked = left > 0, np.where(toxic, COVER, 0), []
    while len(picked) < LANDMARKS // 2:
        best = int(np.argmax(left))
        if left[best] < 2:
            break
        picked.append(best)
        left[best], telling[best] = 0, False
        for d in doc[order[has[best] : has[best + 1]]]:
            unexplained[d] -= 1
            if unexplained[d] == 0:
                own = word[first[d] : first[d + 1]]
                left[own[telling[own]]] -= share[d]
    if not picked:
        return CONSTANT

    by_count = np.argsort(-in_clean, kind="stable")
    clean = by_count[: min(3000, int((in_clean > 0).sum()))]
    rest = np.flatnonzero(in_clean > 0)
    clean = np.union1d(clean, rng.choice(rest, min(3000, len(rest)), replace=False))
    positive = np.array(picked)
    machine, hard = CONSTANT, np.zeros(0, int)  # hard: the worst mistakes among the words of clean texts
    for _ in range(turns):
        marks = np.concatenate([positive[np.argsort(-in_toxic[positive], kind="stable")][: LANDMARKS // 2], hard[: LANDMARKS // 4]])
        marks = np.unique(np.concatenate([marks, rng.choice(clean, min(LANDMARKS // 2 - min(len(hard), LANDMARKS // 4), len(clean)), replace=False)]))
        landmarks = vocabulary.take(marks)
        values, vectors = np.linalg.eigh(kernel(landmarks, landmarks))
        keep = values > 1e-6 * values.max()
        whiten = vectors[:, keep] / np.sqrt(values[keep])
        y = np.repeat([1.0, -1.0], [len(positive), len(clean)])
        weight = np.repeat([len(clean) / (4 * len(positive)), 1.0], [len(positive), len(clean)])
        beta = _svm(kernel(vocabulary.take(np.concatenate([positive, clean])), landmarks) @ whiten, y, weight)
        alpha, (lo, lt, lv) = whiten @ beta[:-1], features(landmarks)
        machine = Machine(np.bincount(lt, alpha[lo] * lv, minlength=1 << 18), float(beta[-1]), 1.0, 0.0)
        got = machine.decide(vocabulary)
        # Of each toxic text, the words that clean ones don't have and that look most toxic; the worst mistakes of clean ones.
        chosen = {int(p) for p in picked}
        for d in np.flatnonzero(toxic):
            own = word[first[d] : first[d + 1]]
            own = own[(odds[own] > 4) & (got[own] > 0)]
            chosen.update(own[np.argsort(-got[own], kind="stable")][:5].tolist())
        positive = np.array(sorted(chosen))
        hard = np.setdiff1d(rest, positive)
        hard = hard[np.argsort(-got[hard], kind="stable")][:1500]
        clean = np.setdiff1d(np.union1d(clean, hard), positive)

    return machine


def fit_machine(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_DOCS) -> Machine:
    """A machine from at most `rows` labelled documents that are not held out; a quarter of the room is for toxic ones."""
    own = labels.select(F.col("doc_id"), F.when(F.col("toxic").isin(0, 1), F.col("toxic")).alias("toxic"))
    open_rows = crc_mod("doc_id", 3) != 1
    got = [sample(docs, own.where(F.col("toxic") == k), "toxic", where=open_rows, rows=rows * (3, 1)[k] // 4).toPandas() for k in (0, 1)]
    import pandas as pd

    got = pd.concat(got).drop_duplicates("doc_id", keep="last").sort_values("doc_id", kind="stable")
    return train(got["label"].to_numpy(), got["text"].fillna("").tolist())


def toxicity_scores(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (default: all), score (0 to 1, higher: more toxic), predicted, held_out."""

    def make():
        def work(offsets, data):
            score = machine.probability(decisions(machine, offsets, data))
            return {"score": score, "predicted": (score >= PREDICT_FROM).astype(np.int32)}

        return work

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    out = map_text(docs, text_col, fields, make, keep=keep)
    return out.withColumn("held_out", F.coalesce(crc_mod(id_col, 3) == 1, F.lit(False)))
