"""Near-duplicate groups by HyperMinHash.

Each document's distinct word shingles are hashed to 64 bits. The top bits choose a bucket; of the rest a register
keeps the number of leading zeros of the smallest value and the next MANTISSA bits after its leading one (Yu & Weber,
"HyperMinHash: MinHash in LogLog space"). Bands of registers give candidate pairs, an estimate of the Jaccard index
corrected for chance collisions of registers discards the hopeless, and the rest are verified on the full sets.

How groups are kept from going quadratic: equal sets become one node first. Then links are verified and joined into
components in two turns:
1. each member of a band is paired with one hub of it, so a band costs as many rows as it has members;
2. of bands whose members are in several components yet, all members outside the largest component are held against all
   members, by registers and then by the FINE smallest shingles, in blocks of at most BLOCK rows a side. A block keeps
   its own components as it goes and proposes a pair only where it joins two of them. Sets of at most FINE shingles are
   compared in full there; of larger ones all pairs within reach are proposed, unless joined already.
So no pair of a band that could join two components is left out, and a block proposes about as many pairs as it has rows.

Edge cases: a text that is null or without words is linked with nothing; a row whose id is null takes no part and has
a null component; rows that share an id are compared each by its own text; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected
from .frames import counted, cut, dealt, map_text
from .tokens import SPACED_LOWER, U, mix, shingle_sets, words

BUCKET_BITS = 8
BUCKETS = 1 << BUCKET_BITS
MANTISSA = 10
BANDS, ROWS = 36, 5
#: Standard errors under the threshold at which an estimate still goes to verification.
MARGIN = 4.0
BLOCK = 1024
#: Smallest shingles of a set that blocks compare.
FINE = 1024

_EDGES = (np.arange(BUCKETS + 1, dtype=object) << (64 - BUCKET_BITS))[:BUCKETS].astype(np.uint64)
_RNG = np.random.default_rng(5)
#: Registers of each band, and the order in which an empty register looks for one to borrow from.
BAND_REGISTERS = np.stack([np.roll(_RNG.permutation(BUCKETS), i)[:ROWS] for i in range(BANDS)])
PROBES = np.stack([_RNG.permutation(BUCKETS) for _ in range(BUCKETS)])


def registers(shingles: np.ndarray) -> np.ndarray:
    """uint16 registers of a sorted set of hashes: leading zeros + 1 above MANTISSA bits; 0 is an empty bucket."""
    out = np.zeros(BUCKETS, np.uint16)
    at = np.searchsorted(shingles, _EDGES)
    full = np.flatnonzero(np.diff(np.append(at, len(shingles))))
    rest = (shingles[at[full]] << U(BUCKET_BITS)) >> U(11)  # the smallest of each bucket: 53 bits, exact in a double
    _, bits = np.frexp(rest.astype(np.float64))
    zeros = 53 - bits  # of 53
    body = np.where(rest > 0, rest ^ (U(1) << np.maximum(bits - 1, 0).astype(U)), U(0))
    up = (bits - 1 - MANTISSA).astype(np.int64)
    mantissa = np.where(up >= 0, body >> np.maximum(up, 0).astype(U), body << np.maximum(-up, 0).astype(U)) & U((1 << MANTISSA) - 1)
    out[full] = ((np.minimum(zeros, 62) + 1).astype(np.uint16) << MANTISSA) | mantissa.astype(np.uint16)
    return out


def densified(regs: np.ndarray) -> np.ndarray:
    """regs with each empty register borrowing from the first full one of its own probe order, so that bands of short
    texts don't agree by being empty."""
    full = regs > 0
    empty = np.flatnonzero(~full)
    if not len(empty) or len(empty) == BUCKETS:
        return regs
    order = PROBES[empty]
    out = regs.copy()
    out[empty] = regs[order[np.arange(len(empty)), full[order].argmax(axis=1)]]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key a band."""
    key = mix(np.arange(1, BANDS + 1, dtype=U) * U(0x9E3779B97F4A7C15))
    for column in densified(regs)[BAND_REGISTERS].T:
        key = mix(key ^ column.astype(U) * U(0xBF58476D1CE4E5B9))
    return key.view(np.int64)


def expected_collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Registers expected to be equal by chance for sets of n and m independent shingles.

    With e = shingles of a bucket, the smallest of e uniform values falls in the cell (zeros z, mantissa v) with
    chance (1 - low)**e - (1 - high)**e; a collision has both sets' in one cell. Summed over z with the cells of one z
    taken as equal in width, which is close for MANTISSA = 10.
    """
    out = np.zeros(np.broadcast(n, m).shape)
    a, b = np.asarray(n, float) / BUCKETS, np.asarray(m, float) / BUCKETS
    cells = 1 << MANTISSA
    for z in range(40):
        width = 2.0 ** -(z + 1) / cells
        middle = 1.5 * 2.0 ** -(z + 1)
        out += cells * (a * np.exp(-a * middle) * width) * (b * np.exp(-b * middle) * width)
    return out * BUCKETS


def estimate(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard index of register rows x and y of sets of n and m shingles."""
    either = (x > 0) | (y > 0)
    used = np.maximum(either.sum(axis=1), 1)
    equal = ((x == y) & either).sum(axis=1)
    return np.clip((equal - expected_collisions(n, m)) / used, 0, 1), used


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """doc_id, n_shingles, set_key (digest of the full set), registers and band keys of each row."""

    def make():
        def work(offsets, data):
            sets = shingle_sets(words(offsets, data, SPACED_LOWER), shingle)
            regs = [registers(s) if len(s) else None for s in sets]
            return {
                "n_shingles": np.array([len(s) for s in sets], np.int64),
                "set_key": [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets],
                "registers": [r.tobytes() if r is not None else None for r in regs],
                "bands": [band_keys(r) if r is not None else None for r in regs],
            }

        return work

    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("registers", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return map_text(docs, "text", fields, make, keep=["doc_id"])


def _reach(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    """The estimate of each pair, or -1 where it or the sizes leave the threshold out of reach."""
    got, used = estimate(x, y, n, m)
    ok = (got >= threshold - MARGIN * np.sqrt(threshold * (1 - threshold) / used) - 1 / used) & (np.minimum(n, m) >= threshold * np.maximum(n, m) - 1)
    return np.where(ok, got, -1.0)


def _registers_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BUCKETS)


def _estimated(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs a < b whose sizes and estimated index leave the threshold within reach."""
    sig = nodes.select("id", "n", "registers")
    both = pairs.join(sig.toDF("a", "na", "ra"), "a").join(sig.toDF("b", "nb", "rb"), "b").select("a", "b", "na", "nb", "ra", "rb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, m = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
                ok = pa.array(_reach(_registers_of(batch.column(4)), _registers_of(batch.column(5)), n, m, threshold) >= 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def fine_estimate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(Jaccard index, margin) of two sorted sets from their FINE smallest members; without margin if those are all."""
    both = np.sort(np.concatenate((x, y)))
    twice = both[1:] == both[:-1]
    if len(x) < FINE and len(y) < FINE:
        common = int(twice.sum())
        return common / max(1, len(both) - common), 0.0
    first = np.concatenate(([True], ~twice))
    union = np.flatnonzero(first)[:FINE]  # the smallest of the union
    common = int(twice[union[union < len(twice)]].sum())
    return common / max(1, len(union)), MARGIN * 0.5 / np.sqrt(max(1, len(union)))


def _joining_pairs(ids: np.ndarray, comp: np.ndarray, n: np.ndarray, regs: np.ndarray, fine: list[np.ndarray], asks: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Pairs of a block that may join two of its components."""
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while (up := root.setdefault(c, c)) != c:
            root[c] = root[up] if up in root else up
            c = up
        return c

    of, out = np.flatnonzero(~asks), []
    for k in np.flatnonzero(asks):
        near = of[comp[of] != comp[k]]
        got = _reach(regs[near], regs[k][None, :], n[near], n[k], threshold)
        near = near[np.argsort(-got, kind="stable")][: int((got >= 0).sum())]
        for j in near.tolist():
            a, b = find(int(comp[k])), find(int(comp[j]))
            if a == b:
                continue
            index, margin = fine_estimate(fine[k], fine[j])
            if index >= threshold - margin - 1e-9:
                out.append((min(ids[k], ids[j]), max(ids[k], ids[j])))
                if not margin:
                    root[max(a, b)] = min(a, b)
    return out


def _across(members: DataFrame, sig: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs a < b of members of a band in different components that may be links, enough to join all that are linked.

    members: band, id, component. A band's members outside its largest component are held against all its members.
    """
    sizes = members.groupBy("band", "component").agg(F.count("*").alias("size"))
    bands = sizes.groupBy("band").agg(F.count("*").alias("components"), F.sum("size").alias("members"), F.max(F.struct("size", "component")).alias("largest")).where("components > 1")
    needed = lambda rows: F.ceil(rows / F.lit(BLOCK)).cast("int")
    bands = bands.select("band", F.col("largest.component").alias("main"), needed(F.col("members")).alias("nd"), needed(F.col("members") - F.col("largest.size")).alias("nq"))
    rows = members.join(bands, "band").join(sig, "id").join(sets.select("id", "fine"), "id")
    salt = lambda of, k: F.pmod(F.xxhash64("id", F.lit(k)), of).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), of - 1))
    data = rows.withColumn("d", salt(F.col("nd"), 1)).withColumn("q", each(F.col("nq"))).withColumn("asks", F.lit(False))
    asks = rows.where("component <> main").withColumn("q", salt(F.col("nq"), 2)).withColumn("d", each(F.col("nd"))).withColumn("asks", F.lit(True))
    columns = ["band", "q", "d", "asks", "id", "component", "n", "registers", "fine"]
    blocks = dealt(data.select(columns).unionByName(asks.select(columns)), "band", "q", "d").sortWithinPartitions("band", "q", "d", "asks", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the block that may go on in the next batch
        for batch in _with_end(batches):
            whole = held if batch is None else pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if whole is None or not whole.num_rows:
                continue
            key = np.column_stack([whole.column(k).to_numpy() for k in ("band", "q", "d")])
            ends = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            cuts = np.concatenate(([0], ends, [len(key)]))
            last = len(cuts) - 1 if batch is None else len(cuts) - 2
            pairs = []
            for i, j in zip(cuts[:last].tolist(), cuts[1 : last + 1].tolist()):
                part = whole.slice(i, j - i)
                ids, comp, n, asking = (part.column(k).to_numpy() for k in ("id", "component", "n", "asks"))
                pairs += _joining_pairs(ids, comp, n, _registers_of(part.column("registers")), [np.frombuffer(x, np.uint32) for x in part.column("fine").to_pylist()], asking, threshold)
            held = None if batch is None else whole.slice(int(cuts[last]))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return blocks.mapInArrow(run, "a long, b long").distinct()


def _with_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _shingles(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """id, full shingle set, and the upper halves of its FINE smallest shingles, of the documents in ids."""

    def make():
        def work(offsets, data):
            sets = shingle_sets(words(offsets, data, SPACED_LOWER), shingle)
            return {"shingles": [s.tobytes() for s in sets], "fine": [(s[:FINE] >> U(32)).astype(np.uint32).tobytes() for s in sets]}

        return work

    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).join(ids, "id", "left_semi")
    return map_text(texts, "text", [T.StructField("shingles", T.BinaryType()), T.StructField("fine", T.BinaryType())], make, keep=["id"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = np.sort(np.concatenate((x, y)))
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= percent * (len(x) + len(y) - common) and common > 0)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(ok, pa.bool_())) for k in (0, 1)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links), kept (doc_id = component_id), a row a row.

    Two documents are linked when 100 * shared shingles >= percent * shingles of either, on the whole sets.
    """
    threshold = percent / 100
    least = -(-percent // (100 - percent)) if percent < 100 else 1 << 62
    rows = cut(signatures(docs, id_col, text_col, shingle))
    nodes = cut(rows.where(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull()).groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers"), F.first("bands").alias("bands")))

    # A set of fewer than `least` shingles can only be linked with its equals.
    bands = nodes.where(F.col("n") >= least).select(F.explode("bands").alias("band"), "id")
    # Stored first: a join of two shuffles, neither of which is the aggregate's own, can split a large band.
    company = cut(bands.groupBy("band").agg(F.count("*").alias("members")).where("members > 1").select("band"))
    shared = cut(bands.join(company, "band"))
    ids = cut(shared.select("id").distinct())
    sig = cut(nodes.join(ids, "id", "left_semi").select("id", "n", "registers"))
    sets = cut(_shingles(docs, counted(ids), id_col, text_col, shingle))

    hubs = cut(shared.groupBy("band").agg(F.min(F.struct(F.xxhash64("id"), "id"))["id"].alias("hub")))
    pairs = shared.join(hubs, "band").where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    links = cut(_verified(_estimated(pairs, sig, threshold), sets, percent))
    label = connected(links)
    members = shared.join(label, "id", "left").select("band", "id", F.coalesce("component", "id").alias("component"))
    found = cut(_verified(_across(members, sig, sets, threshold), sets, percent))
    if found.take(1):
        # Links between components: few, and the labels of all others stay.
        joined = found.join(label.toDF("a", "ca"), "a", "left").join(label.toDF("b", "cb"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        label = connected(label.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(joined))

    component = nodes.select("set_key", "id").join(label, "id", "left").select("set_key", F.coalesce("component", "id").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "set_key").join(component, "set_key", "left")
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        (F.col("doc_id").isNull() | (F.col("doc_id") == F.coalesce("component_id", "doc_id"))).alias("kept"),
    )


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs, all columns, with one row of each near-duplicate group: the one with the smallest id.

    Rows that share an id are held apart by their texts: unlike ones all stay, each with a group of its own, and of
    rows equal in id and text one stays (the one with the smallest hash of all its columns). Rows without an id or
    without words are linked with nothing and all stay. Columns may have any names, as keys are joined by names of their own.
    """
    key, text = "key of the row", F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    own = F.col(f"`{id_col}`").cast("long")
    many = cut(docs.where(own.isNotNull()).groupBy(own.alias(key)).agg(F.count("*").alias("times")).where("times > 1").select(key))
    rows = docs.withColumn(key, own)
    if not many.take(1):
        groups = near_duplicates(docs, id_col, text_col, shingle, percent)
        return rows.join(counted(cut(groups.where("not kept").select(F.col("doc_id").alias(key)))), key, "left_anti").drop(key)

    shared = "whether the id is shared"
    rows = rows.join(counted(many).withColumn(shared, F.lit(True)), key, "left")
    rows = rows.withColumn(key, F.when(F.col(shared), F.xxhash64(own, text)).otherwise(own)).drop(shared)
    groups = near_duplicates(rows.select(F.col(f"`{key}`").alias("doc_id"), text.alias("text")), "doc_id", "text", shingle, percent)
    groups = cut(groups.where("doc_id is not null and n_shingles > 0").groupBy("doc_id", "component_id").agg(F.count("*").alias("times")))
    large = groups.groupBy("component_id").agg(F.sum("times").alias("members")).where("members > 1").select("component_id")
    members = groups.join(large, "component_id", "left_semi")
    ids = rows.select(F.col(f"`{key}`").alias("doc_id"), own.alias("id")).distinct()
    members = cut(members.join(ids, "doc_id"))
    first = members.groupBy("component_id").agg(F.min(F.struct("id", "doc_id"))["doc_id"].alias("leader"))
    members = cut(members.join(first, "component_id"))
    rows = rows.join(counted(cut(members.where("doc_id <> leader").select(F.col("doc_id").alias(key)).distinct())), key, "left_anti")
    copied = counted(cut(members.where("doc_id = leader and times > 1").select(F.col("doc_id").alias(key)).distinct()))
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])))
    one = rows.join(copied, key, "left_semi").withColumn(shared, nth).where(F.col(shared) == 1).drop(shared)
    return rows.join(copied, key, "left_anti").unionByName(one).select(*[F.col(f"`{c}`") for c in docs.columns])
