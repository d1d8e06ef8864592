"""Benchmark decontamination by winnowing (Schleimer, Wilkerson & Aiken, "Winnowing").

Fingerprints of a text are the smallest hash of GRAM words in each run of WINDOW - GRAM + 1 of them, so that any
shared run of WINDOW words shares a fingerprint. A document's fingerprints are looked up among the benchmark's; each
hit is extended to the windows of WINDOW words around it, and the words of those that an item has are hit.

An item shorter than WINDOW words is one window of its own length; the winnowing guarantee doesn't hold below WINDOW
words, so these are looked up by the hash of the whole item.

The benchmark goes to the workers in blocks of at most BLOCK_BYTES of text. One block is one pass over the documents;
of several, each reads the documents once and stores the hits alone, which are united and joined to the documents.

Edge cases: a null text has no words and is not contaminated; an item without words has no window; an item whose id is
null makes hits but is not listed; repeated items count once; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import cut, map_text, utf8
from .tokens import ALNUM_LOWER, U, Words, grams, words

WINDOW, GRAM = 13, 8
#: Most benchmark text sent to the workers at once.
BLOCK_BYTES = 16_000_000
#: Columns of docs by these names are replaced.
RESULTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def winnow(hashes: np.ndarray, span: int) -> np.ndarray:
    """Positions of the smallest of each `span` consecutive hashes, the last of equals."""
    n = len(hashes) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = hashes[:n].copy(), np.arange(n)
    for k in range(1, span):
        less = hashes[k : k + n] <= best
        best[less], at[less] = hashes[k : k + n][less], (np.arange(n) + k)[less]
    return np.unique(at)


def isin_sorted(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


class Index:
    """A block of items: sorted fingerprints, and for each window length the sorted window hashes and their items."""

    def __init__(self, items: list[tuple[str | None, str]]):
        import pyarrow as pa

        offsets, data = utf8(pa.array([t for _, t in items], pa.string()))
        w = words(offsets, data, ALNUM_LOWER)
        prints, by_length = [np.zeros(0, U)], defaultdict(lambda: defaultdict(set))
        for d, (item, _) in enumerate(items):
            own = w.hashes[w.first[d] : w.first[d + 1]]
            if not len(own):
                continue
            length = min(WINDOW, len(own))
            for h in grams(own, length).tolist():
                by_length[length][h].add(item)
            if length == WINDOW:
                g = grams(own, GRAM)
                prints.append(g[winnow(g, WINDOW - GRAM + 1)])
        self.prints = np.unique(np.concatenate(prints))
        self.windows = {}
        for length, table in by_length.items():
            keys = np.array(sorted(table), U)
            self.windows[length] = keys, [sorted(i for i in table[k] if i is not None) for k in keys.tolist()]

    def starts(self, w: Words) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(length, first words, rows of self.windows[length]) of the windows that occur in the documents of w.

        Hashes run across the ends of documents; what crosses one is dropped last, as each window inside a document is
        among all windows.
        """
        out = []
        for length, (keys, _) in self.windows.items():
            if length == WINDOW:
                g = grams(w.hashes, GRAM)
                marks = winnow(g, WINDOW - GRAM + 1)
                marks = marks[isin_sorted(g[marks], self.prints)]
                at = np.unique((marks[:, None] - np.arange(WINDOW - GRAM + 1)).ravel())
                at = at[(at >= 0) & (at <= len(w.hashes) - WINDOW)]
                h = grams(w.hashes, WINDOW)[at] if len(at) else np.zeros(0, U)
            else:
                h = grams(w.hashes, length)
                at = np.arange(len(h))
            ok = isin_sorted(h, keys)
            ok[ok] = w.docs[at[ok]] == w.docs[at[ok] + length - 1]
            out.append((length, at[ok], np.searchsorted(keys, h[ok])))
        return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> list[DataFrame]:
    items = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(size // BLOCK_BYTES) + 1
    return [items] if n == 1 else [items.where(F.pmod(F.xxhash64("text"), F.lit(2 * n)) == k) for k in range(2 * n)]


#: What a map over texts finds, by names that no table has.
HIT_WORDS, HIT_ITEMS, TEXT_KEY = "positions of hit words", "items that hit", "key of the text"
#: Most texts with hits that are sent to all executors, as digests of some 200 bytes each.
BROADCAST_TEXTS = 50_000


def _hits(docs: DataFrame, text_col: str, index: Index | None, keep: list[str]) -> DataFrame:
    """keep, n_words, HIT_WORDS and HIT_ITEMS of each row against a block of items; with no block, keep and n_words."""

    def make():
        def work(offsets, data):
            w = words(offsets, data, ALNUM_LOWER)
            n = len(offsets) - 1
            if index is None:
                return {"n_words": np.diff(w.first)}
            cover, items = np.zeros(len(w.hashes) + 1, np.int64), defaultdict(set)
            for length, at, rows in index.starts(w):
                np.add.at(cover, at, 1)
                np.add.at(cover, at + length, -1)
                for d, r in set(zip(w.docs[at].tolist(), rows.tolist())):
                    items[d].update(index.windows[length][1][r])
            hit = np.flatnonzero(np.cumsum(cover)[:-1] > 0)
            ends = np.searchsorted(w.docs[hit], np.arange(n + 1))
            hit_words = [(hit[a:b] - first).astype(np.int64) for a, b, first in zip(ends[:-1], ends[1:], w.first)]
            return {"n_words": np.diff(w.first), HIT_WORDS: hit_words, HIT_ITEMS: [sorted(items.get(d, ())) for d in range(n)]}

        return work

    found = [T.StructField(HIT_WORDS, T.ArrayType(T.LongType())), T.StructField(HIT_ITEMS, T.ArrayType(T.StringType()))]
    return map_text(docs, text_col, [T.StructField("n_words", T.LongType()), *(found if index else ())], make, keep=keep)


def _digests(hits: DataFrame) -> DataFrame:
    """hits with n_hit, n_items and items_sha256 in place of what they are made from."""
    out = hits.withColumn("n_hit", F.size(HIT_WORDS).cast("long")).withColumn("n_items", F.size(HIT_ITEMS).cast("long"))
    return out.withColumn("items_sha256", F.sha2(F.array_join(HIT_ITEMS, ","), 256)).drop(HIT_WORDS, HIT_ITEMS)


def _hits_by_blocks(docs: DataFrame, text_col: str, blocks: list[DataFrame]) -> DataFrame:
    """TEXT_KEY, n_hit, n_items, items_sha256 of the texts that are hit by any block.

    A result is a matter of the text alone, so rows are told by its digest: of each block's pass only the texts that it
    hits are stored, each once and without the text.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    texts, found = docs.select(F.sha2(text, 256).alias(TEXT_KEY), text.alias("text")), []
    for block in blocks:
        hits = _hits(texts, "text", Index([tuple(r) for r in block.collect()]), [TEXT_KEY]).where(F.size(HIT_WORDS) > 0)
        found.append(cut(hits.drop("n_words").dropDuplicates([TEXT_KEY])))
    every = reduce(DataFrame.unionByName, found)
    united = lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return _digests(every.groupBy(TEXT_KEY).agg(united(HIT_WORDS), united(HIT_ITEMS)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (default: all), n_words, n_hit, n_items, items_sha256, contaminated."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in RESULTS]
    blocks = _blocks(benchmark, item_id_col, item_text_col)
    if len(blocks) == 1:
        # At most BLOCK_BYTES, give or take an item.
        out = _digests(_hits(docs, text_col, Index([tuple(r) for r in blocks[0].collect()]), keep))
    else:
        found = cut(_hits_by_blocks(docs, text_col, blocks))
        found = F.broadcast(found) if found.count() <= BROADCAST_TEXTS else found
        key = F.sha2(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), 256)
        out = _hits(docs.withColumn(TEXT_KEY, key), text_col, None, [*keep, TEXT_KEY]).join(found, TEXT_KEY, "left").drop(TEXT_KEY)
        out = out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_hit", "n_items")})
        out = out.withColumn("items_sha256", F.coalesce("items_sha256", F.sha2(F.lit(""), 256)))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
