"""Mixing sources to target weights with soft membership.

A softmax classifier, fitted on a bounded sample of the labelled table, gives each document a posterior over the
domains. Of the nonnegative rates r, one a document, that bring the domains' tokens

    S_k = sum over documents d of n_d r_d p_dk

to their targets T, with n the tokens, the ones nearest to 1 in the metric that weighs documents by their tokens are
r_d = max(0, 1 + sum_k p_dk u_k), the same function of p for all documents. The few numbers u are those of the dual,

    sum over d of n_d r_d^2 / 2 - sum over k of T_k u_k + RIDGE sum over k of S0_k u_k^2 / 2,   S0 the totals at rate 1,

which Newton steps with a line search bring to its minimum. Each step is one aggregate of some dozen numbers, rates are
never stored, and a lost executor costs a reread.

Where no rates meet the targets, as when no document's posterior of a domain is as high as its share asked, the least
squares of the totals would give all weight to the few documents nearest to it and none to the rest. So the domain
asked for most beyond what the documents hold is released: its number of the dual stays 0, it keeps the tokens that
come with the others, and these are fitted to their targets' proportions, and so on until the held ones are met.
Released domains, and totals that stay off their targets by more than TOLERANCE, are warned of.

A target that is only just in reach has the same outcome by other means: the few documents at the edge get rates of
hundreds, all others none. Where that is no mix of use, least_effective tells which share of the tokens a fit must be worth
(Kish's effective size, (sum n r)^2 / sum n r^2); below it, a domain asked for over MOST_REPEATS times is released, too.

Targets are met as asked, however often a scarce domain's documents are repeated for it; most_repeats is an opt-in
limit, which hands what a scarce domain lacks to the others. The fit holds asked, reachable and achieved tokens.

Edge cases: null and empty texts have no tokens and change no total; a domain that no document can belong to is left
out of the objective; repeated rows have equal rates; without labels the posteriors are even; an empty table
gives an empty result; columns of docs with the names of results are replaced.
"""

from __future__ import annotations

import logging
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fm_quality import HASH_BITS, word_entries
from .doc_stats import RATIOS, ratios
from .frames import cut, map_text
from .labelled import SAMPLE_ROWS, sample
from .tokens import SPACED, words

log = logging.getLogger(__name__)

#: Domains of the labelled table, and the weights asked for by default.
DOMAINS = ("clean", "low_quality", "toxic")
TARGETS = {"clean": 0.95, "low_quality": 0.02, "toxic": 0.03}
#: Passes over the rows at most for a set of targets, how far a domain's total may be from its target (as a share of it), weight of the ridge.
MOST_PASSES, TOLERANCE, RIDGE = 300, 1e-4, 1e-10
#: A usual limit for a domain's target, in times of what the documents hold of it; only where it is asked for.
MOST_REPEATS = 4.0
N_INPUTS = (1 << HASH_BITS) + len(RATIOS)


@dataclass
class Softmax:
    weights: np.ndarray  # inputs x domains
    bias: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def posteriors(self, docs: np.ndarray, at: np.ndarray, x: np.ndarray, stats: np.ndarray) -> np.ndarray:
        z = self.bias + np.clip((stats - self.mean) / self.scale, -4, 4) @ self.weights[1 << HASH_BITS :]
        for k in range(z.shape[1]):
            z[:, k] += np.bincount(docs, self.weights[at, k] * x, minlength=len(z))[: len(z)]
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def train(docs: np.ndarray, at: np.ndarray, x: np.ndarray, stats: np.ndarray, y: np.ndarray, k: int, epochs: int = 60, rate: float = 0.05, ridge: float = 1e-5) -> Softmax:
    """Full-batch Adam on the log loss."""
    n = len(y)
    m = Softmax(np.zeros((N_INPUTS, k)), np.zeros(k), stats.mean(axis=0) if n else np.zeros(len(RATIOS)), (stats.std(axis=0) if n else np.ones(len(RATIOS))) + 1e-6)
    if not n:
        return m
    target, z = np.eye(k)[y], np.clip((stats - m.mean) / m.scale, -4, 4)
    m.bias = np.log((target.sum(axis=0) + 1) / (n + k))
    moment, square = np.zeros_like(m.weights), np.zeros_like(m.weights)
    for step in range(1, epochs + 1):
        g = (m.posteriors(docs, at, x, stats) - target) / n
        grad = np.concatenate([np.column_stack([np.bincount(at, g[docs, c] * x, minlength=1 << HASH_BITS) for c in range(k)]), z.T @ g]) + ridge * m.weights
        moment, square = 0.9 * moment + 0.1 * grad, 0.999 * square + 0.001 * grad * grad
        m.weights -= rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
        m.bias -= rate * g.sum(axis=0)
    return m


def fit_domains(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS // 2) -> Softmax:
    """Domains of the labelled table: toxic where labelled so, else by quality."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)
    own = sample(docs, labels.select("doc_id", domain.alias("domain")), "domain", rows=rows, classes=(0, 1, 2))

    def make():
        def work(offsets, data):
            d, at, x = word_entries(offsets, data)
            ends = np.searchsorted(d, np.arange(len(offsets)))
            split = lambda v, t: [v[a:b].astype(t).tobytes() for a, b in zip(ends[:-1], ends[1:])]
            return {"at": split(at, np.int16), "x": split(x, np.float32), "stats": list(ratios(offsets, data))}

        return work

    fields = [T.StructField("at", T.BinaryType()), T.StructField("x", T.BinaryType()), T.StructField("stats", T.ArrayType(T.DoubleType()))]
    got = map_text(own, "text", fields, make, keep=["doc_id", "label"]).toPandas().sort_values("doc_id", kind="stable")
    at, x = [np.frombuffer(b, np.int16) for b in got["at"]], [np.frombuffer(b, np.float32) for b in got["x"]]
    none = [np.zeros(0, np.int64)]
    of = np.repeat(np.arange(len(at)), [len(a) for a in at])
    return train(of, np.concatenate(at or none).astype(np.int64), np.concatenate(x or none).astype(float), np.array(got["stats"].tolist()).reshape(-1, len(RATIOS)), got["label"].to_numpy(int), len(DOMAINS))


def with_posteriors(docs: DataFrame, model: Softmax, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (default: all), n_tokens and p_<domain>."""

    def make():
        def work(offsets, data):
            w = words(offsets, data, SPACED)
            p = model.posteriors(*word_entries(offsets, data), ratios(offsets, data, w))
            return {"n_tokens": np.diff(w.first)} | {f"p_{d}": p[:, k] for k, d in enumerate(DOMAINS)}

        return work

    fields = [T.StructField("n_tokens", T.LongType())] + [T.StructField(f"p_{d}", T.DoubleType()) for d in DOMAINS]
    return map_text(docs, text_col, fields, make, keep=keep)


def rate(duals: np.ndarray | list[float], domains: tuple[str, ...] = DOMAINS) -> Column:
    """The rate of a row at the given numbers of the dual."""
    return F.greatest(F.lit(0.0), sum((F.col(f"p_{d}") * float(u) for d, u in zip(domains, duals)), F.lit(1.0)))


@dataclass
class Rates:
    duals: np.ndarray
    asked: np.ndarray  # tokens by domain
    targets: np.ndarray  # those of them that documents and most_repeats let reach
    achieved: np.ndarray
    released: tuple[str, ...] = ()  # domains whose targets no rates meet together with the others'

    effective: float = 1.0  # Kish's effective size, as a share of the tokens

    def gaps(self) -> np.ndarray:
        """How far each domain's total is from its target, as a share of it (of all targets where its own is 0)."""
        return np.abs(self.achieved - self.targets) / np.where(self.targets > 0, self.targets, max(self.targets.sum(), 1.0))

    def __str__(self) -> str:
        gone = f"; out of reach and released: {', '.join(self.released)}" if self.released else ""
        return "; ".join(f"{d}: asked {w:.6g}, reachable {'-' if d in self.released else f'{t:.6g}'}, achieved {a:.6g} tokens" for d, w, t, a in zip(DOMAINS, self.asked, self.targets, self.achieved)) + gone


def attainable(share: np.ndarray, base: np.ndarray, most: float = MOST_REPEATS) -> np.ndarray:
    """Token targets of all tokens by share, none above `most` times the domain's own."""
    want, free = np.zeros(len(base)), np.ones(len(base), bool)
    for _ in base:
        left = base.sum() - want[~free].sum()
        want[free] = left * share[free] / max(share[free].sum(), 1e-300)
        over = free & (want > most * base)
        if not over.any():
            break
        want[over] = most * base[over]
        free &= ~over
    return np.minimum(want, most * base)


def fit_rates(rows: DataFrame, targets: dict[str, float] = TARGETS, most: int = MOST_PASSES, tolerance: float = TOLERANCE, most_repeats: float | None = None, least_effective: float = 0.0) -> Rates:
    """The rates' dual numbers over rows with n_tokens and p_<domain>, fitted until each domain's total is within
    tolerance of its target, in `most` passes at most; domains out of reach are released, and a warning tells of them.
    So are scarce domains as long as the rates are worth less than the share least_effective of the tokens."""
    share = np.array([targets[d] for d in DOMAINS], float)
    share = share / share.sum()
    p, pairs = [F.col(f"p_{d}") for d in DOMAINS], [(i, j) for i in range(len(DOMAINS)) for j in range(i, len(DOMAINS))]

    def at(u):
        """The dual without T and ridge, its gradient (the totals) and its second derivatives."""
        r, n = rate(u), F.col("n_tokens")
        parts = [n * r * r / 2, *[n * r * c for c in p], *[F.when(r > 0, n * p[i] * p[j]) for i, j in pairs]]
        got = np.array(rows.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(str(k)) for k, c in enumerate(parts)]).first(), float)
        second = np.zeros((len(p), len(p)))
        for (i, j), x in zip(pairs, got[1 + len(p) :]):
            second[i, j] = second[j, i] = x
        return got[0], got[1 : 1 + len(p)], second

    start = at(np.zeros(len(p)))
    base = start[1]
    asked = share * base.sum()
    open_domains = base > 1e-9 * max(base.sum(), 1.0)
    if most_repeats is not None:
        want = attainable(share, base, most_repeats)
    elif open_domains.all() or not share[open_domains].any():
        want = asked
    else:  # what no document holds nothing repeats
        want = np.where(open_domains, share, 0.0) * base.sum() / share[open_domains].sum()
    passes = 1

    def descended(held, wanted):
        """The dual numbers, 0 where not held, the totals, whether the held ones meet what is wanted, and the effective size."""
        nonlocal passes
        ridge, last = np.where(held, RIDGE * base, 1.0), passes + most
        u, (value, total, second) = np.zeros(len(p)), start
        met = lambda: not (Rates(u, asked, wanted, total).gaps()[held] > tolerance).any()
        while passes < last and not met():
            slope = np.where(held, total - wanted + ridge * u, 0.0)
            if (np.abs(slope) <= 0.1 * tolerance * np.minimum(wanted, base)).all():
                break  # the minimum: what is left of the gaps no rates close
            curve = np.where(np.outer(held, held), second, 0.0) + np.diag(ridge)
            scale = 1 / np.sqrt(np.diag(curve))
            step = np.where(held, -scale * np.linalg.lstsq(curve * np.outer(scale, scale), scale * slope, rcond=None)[0], 0.0)
            now, length = value - wanted @ u + ridge @ (u * u) / 2, 1.0
            while passes < last:
                new, passes = u + length * step, passes + 1
                value, total, second = at(new)
                if value - wanted @ new + ridge @ (new * new) / 2 <= now + 1e-4 * length * (slope @ step) + 1e-12 * abs(now):
                    break
                length /= 2
            u = new
        return u, total, met(), total.sum() ** 2 / max(2 * value * base.sum(), 1e-300)

    held, wanted = open_domains.copy(), want
    u, total, met, effective = descended(held, wanted)
    while (not met or effective < least_effective and (held & (wanted > MOST_REPEATS * base)).any()) and held.any():
        held[np.argmax(np.where(held, wanted / np.where(held, base, 1.0), -1.0))] = False
        left = want[held].sum()
        if not left:
            held[:] = False
        wanted = np.where(held, want * base[held].sum() / (left or 1.0), base)
        u, total, met, effective = descended(held, wanted)
    fit = Rates(u, asked, want, total, tuple(d for d, k, o in zip(DOMAINS, held, open_domains) if o and not k), float(effective))
    if (fit.gaps()[open_domains] > tolerance).any() or (np.abs(want - asked) > tolerance * asked).any():
        warnings.warn(f"mixing: targets not met after {passes} passes. {fit}", stacklevel=2)
    return fit


def mix(docs: DataFrame, model: Softmax, targets: dict[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, most_repeats: float | None = None, least_effective: float = 0.0) -> DataFrame:
    """The columns `keep` of docs (default: all), n_tokens, p_<domain>, rate, and n_copies, whose expectation is the rate.

    n_copies is the rate's whole part, and one more where a hash of the id falls below the rest.
    """
    keep = docs.columns if keep is None else keep
    rows = cut(with_posteriors(docs, model, text_col, keep=[] if text_col in keep else keep))
    fit = fit_rates(rows, targets, most_repeats=most_repeats, least_effective=least_effective)
    log.info("mixing: %s", fit)
    out = rows if text_col not in keep else with_posteriors(docs, model, text_col, keep=keep)
    chance = F.pmod(F.xxhash64(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.lit("mixing")), F.lit(1 << 32)) / float(1 << 32)
    out = out.withColumn("rate", rate(fit.duals))
    return out.withColumn("n_copies", (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("int")).cast("long"))
