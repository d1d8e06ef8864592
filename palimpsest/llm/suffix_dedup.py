"""Removal of repeated passages of LENGTH bytes by suffix arrays.

A byte goes when a LENGTH-byte string over it starts anywhere else, too. To sort all suffixes of a corpus in one place
is out of the question, so strings that can be equal are brought together first:

1. Anchors. Among any REACH consecutive 16-byte grams the one with the smallest hash (the last of equals) is an anchor.
   A string starting at p is ruled by the anchor chosen from the REACH grams from p on. Equal strings have their anchor
   at the same offset, and the core, the LENGTH - REACH + 1 bytes from the anchor, in common. An anchor's region is all
   strings that it rules, as one run of bytes.
2. Groups. Cores are counted; only what has a core that occurs twice goes on. Equal regions need no sorting: all their
   strings are repeated, and one of them stands for all. Regions count as equal if two 64-bit hashes agree, that of the
   core and that of the whole; they have under 600 bytes.
3. Suffix arrays. The different regions of a core are read as strings of BLOCK-byte symbols, lined up at the anchor,
   and their suffixes are sorted by linear grouping (grouping.py). A string that starts t bytes before a block is in
   order by those t bytes and the rank of the suffix there; equal strings are neighbours, and a comparison of their bytes
   settles it.
4. A core with more than GROUP different regions is never gathered: its strings are dealt by ranges of their offset from
   the anchor, which all strings of a range share more bytes, and again by shorter ranges, down to one offset, where
   regions are equal or have nothing in common.

Edge cases: a null text is empty; texts shorter than LENGTH lose nothing but may be any; repeated rows are documents of
their own, so all of a repeated text of LENGTH bytes goes; rows of null ids are kept apart by their texts; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .frames import counted, cut, dealt, map_text, utf8
from .grouping import suffix_array
from .tokens import U, mix, prefix_hashes, spans

LENGTH, REACH, GRAM, BLOCK = 400, 200, 16, 16
CORE = LENGTH - REACH + 1
#: Most different regions of a core that one task gathers, and regions sorted in one array.
GROUP, ARRAY = 1000, 1500
#: Widths of the ranges of offsets that larger groups are dealt by, one after another.
RANGES = (25, 5, 1)


def _ruling_anchors(prefix: np.ndarray, n: int) -> np.ndarray:
    """For each p, the anchor that rules the string at p (if it is long enough)."""
    m = n - GRAM + 1
    if m < REACH:
        return np.zeros(0, np.int64)
    at = np.arange(m)
    key = (spans(prefix, at, at + GRAM) & U(0xFFFFFFFF00000000)) | (U(0xFFFFFFFF) - at.astype(U))  # the last of equals
    width = 1
    while 2 * width <= REACH:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < REACH:
        key = np.minimum(key[: len(key) - (REACH - width)], key[REACH - width :])
    return (U(0xFFFFFFFF) - (key & U(0xFFFFFFFF))).astype(np.int64)


def regions(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, anchor, first and last string, core hash, region hash) of each anchor that rules a string."""
    starts, ends = offsets[:-1], offsets[1:] - LENGTH  # last string of each document
    long = ends >= starts
    count = np.where(long, ends - starts + 1, 0)
    if not count.sum():
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, U),) * 2
    prefix = prefix_hashes(data)
    docs = np.repeat(np.arange(len(count)), count)
    p = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + starts[docs]
    s = _ruling_anchors(prefix, len(data))[p]
    first = np.flatnonzero(np.concatenate(([True], (s[1:] != s[:-1]) | (docs[1:] != docs[:-1]))))
    last = np.append(first[1:], len(p)) - 1
    s, docs, p0, p1 = s[first], docs[first], p[first], p[last]
    core = spans(prefix, s, s + CORE)
    whole = mix(spans(prefix, p0, p1 + LENGTH) + ((s - p0) * 65536 + (s - p1)).astype(U) * U(0x9E3779B97F4A7C15))
    return docs, s, p0, p1, core, whole


def _lists(values: np.ndarray, docs: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(docs, np.arange(n + 1)), pa.int32()), pa.array(values, kind))


def _first_pass(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, id_key and text_key (which name a text), n_bytes, kept_sha256 of the whole text, and anchors."""

    def make():
        def work(offsets, data):
            n = len(offsets) - 1
            d, s, p0, p1, core, whole = regions(offsets, data)
            base = offsets[d]
            raw = data.tobytes()
            return {
                "n_bytes": np.diff(offsets),
                "sha256": [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())],
                "at": _lists(s - base, d, n, pa.int32()),
                "far": _lists(s - p0, d, n, pa.int32()),
                "near": _lists(s - p1, d, n, pa.int32()),
                "core": _lists(core.view(np.int64), d, n, pa.int64()),
                "whole": _lists(whole.view(np.int64), d, n, pa.int64()),
            }

        return work

    ints, longs = T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType())
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("sha256", T.StringType())]
    fields += [T.StructField(k, ints) for k in ("at", "far", "near")] + [T.StructField(k, longs) for k in ("core", "whole")]
    return map_text(_keyed(docs, id_col, text_col), "text", fields, make, keep=["doc_id", "id_key", "text_key"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text, own = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), F.col(f"`{id_col}`").cast("long")
    return docs.select(own.alias("doc_id"), F.coalesce(own, F.lit(-(1 << 63))).alias("id_key"), F.xxhash64(text).alias("text_key"), text.alias("text"))


class Parts:
    """Regions of some groups, lined up at their anchors: bytes start `far` before the anchor, whose strings are those
    from far to near before it."""

    def __init__(self, group: np.ndarray, far: np.ndarray, near: np.ndarray, offsets: np.ndarray, data: np.ndarray):
        self.group, self.far, self.near, self.offsets, self.data = group, far, near, offsets, data

    def repeated(self) -> tuple[np.ndarray, np.ndarray]:
        """(region, offset before the anchor) of each string that another region of its group has at that offset."""
        n = len(self.group)
        anchor = self.offsets[:-1] + self.far
        # Symbols: blocks from the last multiple of BLOCK before the first string on; a region's end comes first in order.
        lead = self.far // BLOCK  # full blocks before the anchor
        begin = anchor - lead * BLOCK
        blocks = -(-(self.offsets[1:] - begin) // BLOCK)
        of = np.repeat(np.arange(n), blocks)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        at = (begin[of] + nth * BLOCK)[:, None] + np.arange(BLOCK)
        cells = np.where(at < self.offsets[1:][of][:, None], np.append(self.data, np.zeros(BLOCK, np.uint8))[np.minimum(at, len(self.data))], 0).astype(np.uint8)
        _, rank = np.unique(np.ascontiguousarray(cells).view(">u8").astype(U), axis=0, return_inverse=True)
        text = np.zeros(len(of) + n, np.int64)  # 0 ends a region
        place = np.arange(len(of)) + of
        text[place] = rank.ravel() + 1
        order = np.empty(len(text), np.int64)
        order[np.array(suffix_array(text.tolist()), np.int64)] = np.arange(len(text))
        # Strings, by group, offset, the bytes before their first block, and the rank of the suffix there.
        count = self.far - self.near + 1
        who = np.repeat(np.arange(n), count)
        offset = np.repeat(self.far, count) - (np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count))
        block, before = offset // BLOCK, offset % BLOCK
        start, edge = anchor[who] - offset, anchor[who] - block * BLOCK
        first_symbol = np.concatenate(([0], np.cumsum(blocks + 1)[:-1]))
        suffix = order[first_symbol[who] + lead[who] - block]
        prefix = prefix_hashes(self.data)
        key = mix(spans(prefix, start, edge) ^ (self.group[who].astype(np.int64).view(U) * U(3) + offset.astype(U) * U(0xD6E8FEB86659FD93)))
        by = np.lexsort((suffix, key))
        rest = spans(prefix, edge, start + LENGTH)
        same = (key[by][1:] == key[by][:-1]) & (rest[by][1:] == rest[by][:-1]) & (who[by][1:] != who[by][:-1])
        a, b = start[by[:-1][same]], start[by[1:][same]]
        strings = np.ndarray(max(0, len(self.data) - LENGTH + 1), f"V{LENGTH}", np.ascontiguousarray(self.data), strides=(1,))
        bytes_of = lambda at: strings[at].view(np.uint8).reshape(len(at), LENGTH)
        same[same] = np.concatenate([np.zeros(0, bool), *((bytes_of(a[k : k + 8192]) == bytes_of(b[k : k + 8192])).all(axis=1) for k in range(0, len(a), 8192))])
        hit = np.zeros(len(who), bool)
        hit[by[1:][same]] = hit[by[:-1][same]] = True
        return who[hit], offset[hit]


_PART = "id_key long, text_key long, at int, far int, near int, gid long, whole long, bytes binary, alone boolean, size long"


def _bytes_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """_PART rows for the wanted anchors (_PART without bytes), with the bytes of their regions."""
    marks = F.sort_array(F.collect_list(F.struct("at", "far", "near", "gid", "whole", "alone", "size"))).alias("marks")
    rows = texts.join(wanted.groupBy("id_key", "text_key").agg(marks), ["id_key", "text_key"]).select("id_key", "text_key", "text", "marks")
    start = F.col("m.at") - F.col("m.far")
    size = F.col("m.far") - F.col("m.near") + LENGTH
    out = rows.select("id_key", "text_key", F.col("text").cast("binary").alias("raw"), F.explode("marks").alias("m"))
    return out.select("id_key", "text_key", "m.at", "m.far", "m.near", "m.gid", "m.whole", F.substring("raw", start + 1, size).alias("bytes"), "m.alone", "m.size")


def _sorted_groups(parts: DataFrame) -> DataFrame:
    """id_key, text_key, start, end of the repeated runs of the regions that are alone, by suffix arrays."""
    schema = T.StructType([T.StructField(k, T.LongType()) for k in ("id_key", "text_key", "start", "end")])
    groups = dealt(parts, "gid").sortWithinPartitions("gid", "whole")

    def solve(rows: pa.Table) -> list[np.ndarray]:
        offsets, data = utf8(rows.column("bytes"))
        far, near, at = (rows.column(k).to_numpy().astype(np.int64) for k in ("far", "near", "at"))
        who, offset = Parts(rows.column("gid").to_numpy(), far, near, offsets, data).repeated()
        alone = rows.column("alone").to_numpy()
        who, offset = who[alone[who]], offset[alone[who]]
        p = at[who] - offset
        new = np.concatenate(([True], (who[1:] != who[:-1]) | (p[1:] != p[:-1] + 1))) if len(who) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(who))[: len(first)] - 1
        return [rows.column("id_key").to_numpy()[who[first]], rows.column("text_key").to_numpy()[who[first]], p[first], p[last] + LENGTH]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in _with_end(batches):
            if batch is not None:
                held.append(batch)
                if sum(b.num_rows for b in held) < ARRAY:
                    continue
            if not held:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            gid = rows.column("gid").to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(gid[1:] != gid[:-1]) + 1, [len(gid)]))
            if batch is not None:
                cuts = cuts[:-1]  # the last group may go on
            i = 0
            while i + 1 < len(cuts):
                j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + ARRAY, "right")) - 1)
                got = solve(rows.slice(int(cuts[i]), int(cuts[j] - cuts[i])).combine_chunks())
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()) for g in got], schema=to_arrow_schema(schema))
                i = j
            held = rows.slice(int(cuts[-1])).to_batches() if batch is not None else []

    return groups.mapInArrow(run, schema)


def _with_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _dealt_out(parts: DataFrame, width: int) -> DataFrame:
    """_PART rows of the strings of each region, by ranges of `width` offsets, under hashes of what a range's strings share."""
    fields = to_arrow_schema(T._parse_datatype_string(_PART))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for k in range(0, whole_batch.num_rows, 500):
                batch = whole_batch.slice(k, 500)
                offsets, data = utf8(batch.column(7))
                at, far, near = (batch.column(c).to_numpy().astype(np.int64) for c in (2, 3, 4))
                cells = far // width - near // width + 1
                who = np.repeat(np.arange(len(far)), cells)
                cell = near[who] // width + np.arange(len(who)) - np.repeat(np.cumsum(cells) - cells, cells)
                low, high = cell * width, cell * width + width - 1  # offsets of the range
                new_far, new_near = np.minimum(far[who], high), np.maximum(near[who], low)
                anchor, prefix = (offsets[:-1] + far)[who], prefix_hashes(data)
                start, end = anchor - new_far, anchor - new_near + LENGTH
                gid = mix(spans(prefix, anchor - low, anchor - high + LENGTH) ^ (batch.column(5).to_numpy()[who].view(U) + cell.astype(U) * U(0xA0761D6478BD642F)))
                whole = mix(spans(prefix, start, end) + (new_far * 65536 + new_near).astype(U) * U(0x9E3779B97F4A7C15))
                raw = data.tobytes()
                take = pa.array(who)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take), pa.array(new_far, pa.int32()), pa.array(new_near, pa.int32()), pa.array(gid.view(np.int64)), pa.array(whole.view(np.int64)), pa.array([raw[a:b] for a, b in zip(start.tolist(), end.tolist())], pa.binary()), batch.column(8).take(take), batch.column(9).take(take)],
                    schema=fields,
                )

    return parts.select([f.name for f in fields]).mapInArrow(run, T._parse_datatype_string(_PART))


def _runs(rows: DataFrame) -> DataFrame:
    """Runs of the whole regions in rows."""
    return rows.select("id_key", "text_key", (F.col("at") - F.col("far")).cast("long").alias("start"), (F.col("at") - F.col("near") + LENGTH).cast("long").alias("end"))


def _open_groups(copies: DataFrame) -> DataFrame:
    """gid and size of the groups of several regions, one of which has no copy yet."""
    single = F.max((F.col("copies") == 1) & F.col("some_alone")).alias("open")
    return cut(copies.groupBy("gid").agg(F.count("*").alias("size"), single).where("size > 1 and open").select("gid", "size"))


def repeated_runs(anchors: DataFrame, texts_of) -> tuple[DataFrame | None, DataFrame]:
    """Texts with repeated cores, and the runs (id_key, text_key, start, end) that go."""
    # Stored first: a join of two shuffles, neither of which is the aggregate's own, can split a core that all texts have.
    cores = cut(anchors.groupBy("core").agg(F.count("*").alias("times"), (F.min("whole") != F.max("whole")).alias("mixed")).where("times > 1").select("core", "mixed"))
    rows = cut(anchors.join(cores, "core"))
    texts = texts_of(rows.select("id_key", "text_key").distinct())

    counts = rows.where("mixed").groupBy("core", "whole").agg(F.count("*").alias("copies"), F.min(F.struct("id_key", "text_key", "at", "far", "near")).alias("one"))
    runs = [_runs(rows.where("not mixed"))]
    counts = cut(counts)
    runs.append(_runs(rows.where("mixed").join(counts.where("copies > 1").select("core", "whole"), ["core", "whole"], "left_semi")))
    # Sizes come before bytes: what has no partner to be sorted with is never gathered.
    sizes = _open_groups(counts.select(F.col("core").alias("gid"), F.lit(True).alias("some_alone"), "copies"))
    wanted = counts.withColumnRenamed("core", "gid").join(sizes, "gid").select("one.*", "gid", "whole", (F.col("copies") == 1).alias("alone"), "size")
    parts = cut(_bytes_of(texts, wanted))
    for width in (*RANGES, None):
        runs.append(_sorted_groups(parts.where(F.col("size") <= GROUP)))
        large = parts.where(F.col("size") > GROUP)
        if width is None or not large.take(1):
            break
        ranges = cut(_dealt_out(large, width).drop("size"))
        copies = cut(ranges.groupBy("gid", "whole").agg(F.count("*").alias("copies"), F.max("alone").alias("some_alone"), F.min(F.struct("id_key", "text_key", "at", "far", "near")).alias("one")))
        runs.append(_runs(ranges.where("alone").join(copies.where("copies > 1").select("gid", "whole"), ["gid", "whole"], "left_semi")))
        ones = copies.join(_open_groups(copies), "gid").select("gid", "whole", F.col("one.id_key"), F.col("one.text_key"), F.col("one.at"), (F.col("copies") == 1).alias("single"), "size")
        parts = cut(ranges.join(ones, ["gid", "whole", "id_key", "text_key", "at"]).select("id_key", "text_key", "at", "far", "near", "gid", "whole", "bytes", (F.col("alone") & F.col("single")).alias("alone"), "size"))
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return texts, out


_CUT = [T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept_text", T.BinaryType())]


def _without(texts: DataFrame, runs: DataFrame, with_text: bool) -> DataFrame:
    """id_key, text_key and what is left of each text."""
    merged = runs.groupBy("id_key", "text_key").agg(F.collect_set(F.struct("start", "end")).alias("runs"))  # at most as many as a text has anchors

    def make():
        def work(offsets, data, of):
            raw, out = data.tobytes(), {f.name: [] for f in _CUT}
            for d, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                cover = np.zeros(b - a + 1, np.int64)
                for r in of[d].as_py() or ():
                    cover[r["start"]] += 1
                    cover[r["end"]] -= 1
                gone = np.concatenate(([False], np.cumsum(cover)[:-1] > 0, [False]))
                edge = np.flatnonzero(gone[1:] != gone[:-1])
                left, at = [], 0
                for i, j in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    left.append(raw[a + at : a + i])
                    at = j
                left = b"".join([*left, raw[a + at : b]])
                for k, v in zip(out, ((b - a) - len(left), len(edge) // 2, hashlib.sha256(left).hexdigest(), left if with_text else None)):
                    out[k].append(v)
            return out

        return work

    rows = texts.join(merged, ["id_key", "text_key"])
    return map_text(rows, "text", _CUT, make, keep=["id_key", "text_key"], also=("runs",))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row, and with_text what is left of its bytes (null where
    nothing went; the bytes on both sides of a removed run may be part of one character)."""
    keyed = _keyed(docs, id_col, text_col)
    rows = cut(_first_pass(docs, id_col, text_col))
    lists = rows.select("id_key", "text_key", F.inline(F.arrays_zip("at", "far", "near", "core", "whole")))

    def texts_of(keys: DataFrame) -> DataFrame:
        return cut(keyed.select("id_key", "text_key", "text").join(counted(cut(keys)), ["id_key", "text_key"], "left_semi").dropDuplicates(["id_key", "text_key"]))

    texts, runs = repeated_runs(lists, texts_of)
    left = _without(texts, runs, with_text)
    out = rows.select("doc_id", "id_key", "text_key", "n_bytes", "sha256").join(left, ["id_key", "text_key"], "left")
    out = out.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"), "kept_text")
    return out if with_text else out.drop("kept_text")
