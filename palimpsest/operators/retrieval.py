"""Candidates, hybrid merge, ranking, tiers and layered search over memory views.

A memory view has id, user_id, text, memory_type, created_at, metadata, embedding and layer (schemas.memory_view). All
take many queries at once where a query frame is given: the queries are the small side, and each joins its own tenant
only, on user_id. Greedy selections work on the candidates of one query, which the quotas bound.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as txt
from ..functions.time import decay
from ..functions.vector import cosine
from ..params import SearchParams
from ..schemas import source_label, union
from .state import like_earlier


def _top(df: DataFrame, keys: list[str], k: int | Column, *order: Column) -> DataFrame:
    """The first k rows of each key; Spark plans a group limit before the shuffle."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")


def vector_search(memories: DataFrame, query: list[float], k: int, user_id=None, least: float | None = None) -> DataFrame:
    """The k memories most similar to one vector, as a TakeOrderedAndProject."""
    rows = memories.where(F.col("embedding").isNotNull())
    rows = rows.where(F.col("user_id") == user_id) if user_id is not None else rows
    rows = rows.withColumn("score", cosine(F.col("embedding"), F.lit(query).cast("array<double>")))
    rows = rows.where(F.col("score") >= least) if least is not None else rows
    return rows.orderBy(F.desc("score"), "id").limit(k)


def vector_candidates(memories: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id and the columns of memories with vector_score: the k nearest memories of each query's user.

    queries: query_id, user_id, query_embedding.
    """
    rows = memories.where(F.col("embedding").isNotNull()).join(queries, "user_id")
    rows = rows.withColumn("vector_score", cosine(F.col("embedding"), F.col("query_embedding"))).drop("query_embedding")
    return _top(rows, ["query_id"], k, F.desc("vector_score"), F.col("id"))


def vector_search_all(memories: DataFrame, queries: DataFrame, k: int, least: float | None = None, block: int = 2048) -> DataFrame:
    """query_id, id, score: the k memories most similar to each query, of all memories.

    queries: query_id, query_embedding. A block of memories and one of queries are a task, which gives k rows a query.
    """
    import numpy as np

    own = memories.where(F.col("embedding").isNotNull()).select("id", F.col("embedding").cast("array<double>"))
    asked = queries.where(F.col("query_embedding").isNotNull()).select("query_id", F.col("query_embedding").cast("array<double>"))
    n_own, n_asked = (max(1, -(-df.count() // block)) for df in (own, asked))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = own.withColumn("mb", deal("id", n_own)).withColumn("qb", every(n_asked))
    asked = asked.withColumn("qb", deal("query_id", n_asked)).withColumn("mb", every(n_own))

    def run(m: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(m):
            ids, e = m["id"].to_numpy(), np.stack(m["embedding"].to_list())
            norms = np.sqrt((e * e).sum(axis=1))
            for i, v in zip(q["query_id"], q["query_embedding"]):
                size = norms * np.sqrt((v * v).sum())
                score = np.divide((e * v).sum(axis=1), size, out=np.zeros(len(e)), where=size > 0)
                at = np.lexsort((ids, -score))[:k]
                out.append(pd.DataFrame({"query_id": i, "id": ids[at], "score": score[at]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "score": []})

    types = {c: df.schema[c].dataType.simpleString() for c, df in (("query_id", asked), ("id", own))}
    rows = own.groupBy("mb", "qb").cogroup(asked.groupBy("mb", "qb")).applyInPandas(run, f"query_id {types['query_id']}, id {types['id']}, score double")
    rows = rows.where(F.col("score") >= least) if least is not None else rows
    return _top(rows, ["query_id"], k, F.desc("score"), F.col("id"))


def keyword_search_all(memories: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, text_score: the k best of all memories that have all terms of each query (query_id, terms)."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0)))
    asked = queries.select("query_id", F.size("terms").alias("n"), F.explode("terms").alias("word"))
    wanted = asked.select("word").distinct()
    counts = memories.select("id", words.alias("word")).join(wanted, "word", "left_semi").groupBy("id", "word").agg(F.count("*").alias("f"))
    rows = counts.join(asked, "word").groupBy("query_id", "id", "n").agg(F.count("*").alias("found"), F.sum(F.col("f") / (F.col("f") + 1)).alias("s"))
    rows = rows.where("found = n").select("query_id", "id", (F.col("s") / F.col("n")).alias("text_score"))
    return _top(rows, ["query_id"], k, F.desc(F.round("text_score", 9)), F.col("id"))  # rounded: sums come in any order


def keyword_candidates(memories: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id and the columns of memories with text_score. queries: query_id, user_id, terms (array).

    A memory matches if it has all terms; no term matches nothing. The score is how densely they occur, below 1:
    f / (f + 1) summed over terms, in their order, and divided by their number; ranks go by these very numbers, so scores
    that differ in the last bit are no tie. It stands for the store's full-text rank, whose numbers depend on its own
    stemmer and weights. Each text is split once, and only wanted words become rows.
    """
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0)))
    asked = queries.select("query_id", "user_id", F.size("terms").alias("n"), F.posexplode("terms").alias("at", "word"))
    wanted = asked.select("user_id", "word").distinct()
    counts = memories.select("user_id", "id", words.alias("word")).join(wanted, ["user_id", "word"], "left_semi").groupBy("user_id", "id", "word").agg(F.count("*").alias("f"))
    part = F.struct("at", (F.col("f") / (F.col("f") + 1)).alias("s"))
    rows = counts.join(asked, ["user_id", "word"]).groupBy("query_id", "user_id", "id", "n").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    total = F.aggregate("parts", F.lit(0.0), lambda sum_, x: sum_ + x["s"])
    rows = rows.where("size(parts) = n").select("query_id", "user_id", "id", (total / F.col("n")).alias("text_score"))
    best = _top(rows, ["query_id"], k, F.desc("text_score"), F.col("id"))
    return memories.join(best, ["user_id", "id"])


def hybrid_merge(vector: DataFrame, keyword: DataFrame, params: SearchParams = SearchParams(), keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Full outer join of hits: score = weighted sum, a missing score is 0, other columns from the vector side first."""
    v, k = vector.alias("v"), keyword.alias("k")
    on = [F.col(f"v.{c}") == F.col(f"k.{c}") for c in keys]
    rows = v.join(k, on, "full_outer")
    names = [c for c in vector.columns if c != "vector_score"] + [c for c in keyword.columns if c != "text_score" and c not in vector.columns]
    pick = [F.coalesce(*[F.col(f"{side}.{c}") for side, df in (("v", vector), ("k", keyword)) if c in df.columns]).alias(c) for c in names]
    vs, ts = F.coalesce("v.vector_score", F.lit(0.0)), F.coalesce("k.text_score", F.lit(0.0))
    return rows.select(*pick, vs.alias("vector_score"), ts.alias("text_score"), (params.vector_weight * vs + params.text_weight * ts).alias("score"))


def temporal_decay(rows: DataFrame, now: str, params: SearchParams = SearchParams(), exempt: tuple[str, ...] = ()) -> DataFrame:
    """score times its decay by age; rows without created_at and of exempt layers pass unchanged."""
    if not params.decay:
        return rows
    new = F.col("score") * decay(F.col("created_at"), now, params.half_life_days)
    return rows.withColumn("score", F.when(F.col("layer").isin(*exempt), F.col("score")).otherwise(new) if exempt else new)


def _tokens(text: str | None) -> frozenset[str]:
    import re

    return frozenset(re.findall(r"[a-z0-9_]+", (text or "").lower()))


def _similar(a: frozenset, b: frozenset) -> float:
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def diverse_order(scores: list[float], texts: list[str | None], weight: float) -> list[int]:
    """Maximal marginal relevance: each next item has the largest weight * relevance - (1 - weight) * likeness to
    what is chosen; of equals the one with the higher score, then the earlier."""
    n = len(scores)
    weight = max(0.0, min(1.0, weight))
    if weight == 1.0 or n <= 1:
        return sorted(range(n), key=lambda i: -scores[i])
    low, high = min(scores), max(scores)
    gain = [weight * ((s - low) / (high - low) if high > low else 1.0) for s in scores]
    sets, likeness, left, out = [_tokens(t) for t in texts], [0.0] * n, list(range(n)), []
    while left:
        best = max(left, key=lambda i: (gain[i] - (1 - weight) * likeness[i], scores[i], -i))
        out.append(best)
        left.remove(best)
        for i in left:
            likeness[i] = max(likeness[i], _similar(sets[i], sets[best]))
    return out


def distinct_order(texts: list[str | None], threshold: float) -> list[int]:
    """Positions kept when each text is held against those kept before it."""
    kept: list[tuple[int, frozenset]] = []
    for i, t in enumerate(texts):
        own = _tokens(t)
        if all(_similar(own, k) < threshold for _, k in kept):
            kept.append((i, own))
    return [i for i, _ in kept]


def _per_query(rows: DataFrame, keys: list[str], order: list[str], pick) -> DataFrame:
    """rows of each key in the order that pick chooses, with position."""
    import pyspark.sql.types as T

    schema = T.StructType([*rows.schema.fields, T.StructField("position", T.LongType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ascending=[not c == "score" for c in order], kind="stable").reset_index(drop=True)
        out = pdf.iloc[pick(pdf)].copy()
        out["position"] = range(len(out))
        return out

    return rows.groupBy(*keys).applyInPandas(run, schema)


def diversify(rows: DataFrame, keys: list[str], params: SearchParams = SearchParams(), text: str = "text") -> DataFrame:
    """Candidates of each query reordered by maximal marginal relevance; position tells the order."""
    weight = params.diversity_lambda if params.diversity else 1.0
    return _per_query(rows, keys, ["score", "id"], lambda p: diverse_order(p["score"].tolist(), p[text].tolist(), weight))


def dedup_content(rows: DataFrame, keys: list[str], order: list[str], params: SearchParams = SearchParams(), text: str = "text") -> DataFrame:
    """Results of each query without those like an earlier one."""
    return _per_query(rows, keys, order, lambda p: distinct_order(p[text].tolist(), params.content_similarity))


def _token_sets(rows: DataFrame, group: str, text: str, *also: str) -> DataFrame:
    """id, grp, `also`, h (hashes of the distinct tokens, in order) and k, a hash of both grp and h: rows of one k have equal sets."""
    own = rows.select(F.col("id"), F.col(group).alias("grp"), *also, F.array_sort(F.transform(txt.tokens(F.col(text)), lambda t: F.xxhash64(t))).alias("h"))
    return own.withColumn("k", F.xxhash64("grp", "h"))


def distinct_contents(rows: DataFrame, group: str, cut: Callable[[DataFrame], DataFrame], params: SearchParams = SearchParams(), text: str = "text") -> DataFrame:
    """grp and id of the rows (id, group, text) of whole groups that are like no earlier one kept, in order of id.

    dedup_content without gathering a group: equal token sets are one, _near_sets finds the rest, and like_earlier what goes. `cut` ends the lineage of each round.
    """
    own = cut(_sketched(rows, group, text))
    first = own.groupBy("grp", "k").agg(F.min("id").alias("id"))
    a, b = first.select(F.col("k").alias("ka"), F.col("id").alias("a")), first.select(F.col("k").alias("kb"), F.col("id").alias("b"))
    near = _near_sets(rows, own, params.content_similarity, group, text, cut).join(a, "ka").join(b, "kb")
    gone = like_earlier(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), cut)
    return first.select("grp", "id").join(gone, "id", "left_anti").select("grp", "id")


def similar_pairs(rows: DataFrame, threshold: float, group: str, text: str = "text", cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Pairs a < b of a group whose token sets have a Jaccard index of threshold or more.

    Equal sets are one until the end; _near_sets finds the pairs of unlike ones. `cut` stores what is read again, as keys and sketches of the rows, no texts.
    """
    rows = rows.where(F.col(group).isNotNull())
    own = cut(_sketched(rows, group, text))
    full = own.where("n > 0")
    a, b = full.select(F.col("k").alias("ka"), "grp", F.col("id").alias("a")), full.select(F.col("k").alias("kb"), F.col("id").alias("b"))
    near = _near_sets(rows, own, threshold, group, text, cut).join(a, "ka").join(b, "kb")
    near = near.select("grp", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")
    equal = a.join(b, F.col("ka") == F.col("kb")).where("a < b").select("grp", "a", "b", F.lit(1.0).alias("similarity"))
    empty = own.where("n = 0").select("id", "grp")  # empty sets are alike: linked in order of id, not all with all
    chain = empty.withColumn("b", F.lead("id").over(Window.partitionBy("grp").orderBy("id"))).where("b is not null").select("grp", F.col("id").alias("a"), "b", F.lit(1.0).alias("similarity"))
    return near.unionByName(equal).unionByName(chain)


#: Tokens are counted in so many buckets; keys that are sent to all executors at most; sets compared in a task, roughly; bits of a set's sketch.
TOKEN_BUCKETS, MOST_SENT, SETS_A_TASK, SKETCH_BITS = 1 << 20, 500_000, 500, 1024


def _flat(h):
    """(number of values of each row, all values) of an Arrow list column."""
    import numpy as np

    ends = h.offsets.to_numpy().astype(np.int64)
    return np.diff(ends), h.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]


def _sketched(rows: DataFrame, group: str, text: str) -> DataFrame:
    """id, grp, k (_token_sets), n (size of the set) and its sketch s: the parity of its tokens in each of SKETCH_BITS places."""
    import numpy as np
    import pyarrow as pa

    own = _token_sets(rows, group, text)

    def run(batches):
        for batch in batches:
            n, flat = _flat(batch.column(3))
            ends = np.concatenate(([0], np.cumsum(n)))
            for i in range(0, len(n), 1000):
                m = n[i : i + 1000]
                place = np.repeat(np.arange(len(m)), m) * SKETCH_BITS + ((flat[ends[i] : ends[i] + m.sum()] >> 24) & (SKETCH_BITS - 1))
                odd = np.bincount(place, minlength=len(m) * SKETCH_BITS).reshape(-1, SKETCH_BITS).astype(np.uint8) & 1
                s = pa.array([bits.tobytes() for bits in np.packbits(odd, axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(i, 1000) for c in range(3)], pa.array(m), s], names=["id", "grp", "k", "n", "s"])

    types = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    return own.select("id", "grp", "k", "h").mapInArrow(run, f"id {types['id']}, grp {types['grp']}, k long, n long, s binary")


def _near_sets(rows: DataFrame, own: DataFrame, threshold: float, group: str, text: str, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """ka, kb, similarity: the pairs of unlike nonempty sets of rows (own: _sketched) of a group with a Jaccard index of threshold or more.

    A prefix filter finds candidates: of sets this alike, in any one order of all tokens, the first few of each share one,
    and the first that they share leaves room for the rest. The order is by how often tokens occur, counted in buckets,
    rarest first, so tokens that all texts have bring no pairs together. Each text makes its own prefix; only that is
    shuffled, as numbers. Two sets have at least as many tokens apart as their sketches have bits apart, which ends most
    candidates before any set is moved.
    """
    import numpy as np
    import pyarrow as pa

    bucket = F.col("t").bitwiseAND(F.lit(TOKEN_BUCKETS - 1))
    sets = _token_sets(rows, group, text)
    often = sets.select(F.explode_outer("h").alias("t")).groupBy(bucket.alias("at")).agg(F.count("*").alias("f")).where("f > 1 and at is not null")  # outer: no filter that splits the text again
    often = often.select(F.col("at").cast("int"), F.least(F.lit(127), (4 * F.log2("f"))).cast("byte").alias("rank")).toArrow()  # a million buckets: no rows in the driver
    rank = np.zeros(TOKEN_BUCKETS, np.uint8)
    rank[often["at"].to_numpy()] = often["rank"].to_numpy()
    names = ["t", "k", "n", "pos"]

    def prefixes(batches):
        for batch in batches:
            k, g = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            n, flat = _flat(batch.column(2))
            doc = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((flat, rank[flat & (TOKEN_BUCKETS - 1)], doc))
            pos = np.arange(len(flat)) - (np.cumsum(n) - n)[doc]
            at = np.flatnonzero(pos <= (n - np.ceil(threshold * n - 1e-9))[doc])
            d = doc[at]
            t = flat[order[at]] ^ (g[d] * 0x2545F4914F6CDD1D)  # of its group
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (t, k[d], n[d], pos[at])], names=names)

    few = sets.select("k", F.xxhash64("grp").alias("g"), "h").mapInArrow(prefixes, "t long, k long, n long, pos long")
    few = few.repartition("t").distinct()
    a, b = few.toDF("t", "ka", "na", "pa"), few.toDF("t", "kb", "nb", "pb")
    room = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= threshold / (1 + threshold) * (F.col("na") + F.col("nb")) - 1e-9
    pairs = cut(a.join(b, "t").where((F.col("ka") < F.col("kb")) & room).select("ka", "kb").distinct())

    def possible(s: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        s = s.drop_duplicates("k").set_index("k")
        a, b = s.index.get_indexer(p["ka"]), s.index.get_indexer(p["kb"])
        bits, n = np.frombuffer(b"".join(s["s"]), np.uint64).reshape(len(s), -1), s["n"].to_numpy()
        ok = np.zeros(len(p), bool)
        for i in range(0, len(p), 10_000):
            x, y = a[i : i + 10_000], b[i : i + 10_000]
            ok[i : i + 10_000] = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64) <= (1 - threshold) / (1 + threshold) * (n[x] + n[y]) + 1e-9
        return p.loc[ok, ["ka", "kb"]]

    def compare(s: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        of = dict(zip(s["k"], s["h"]))
        both = np.array([len(np.intersect1d(of[x], of[y], assume_unique=True)) for x, y in zip(p["ka"], p["kb"])], np.int64)
        every = np.array([len(of[x]) + len(of[y]) for x, y in zip(p["ka"], p["kb"])], np.int64) - both
        near = p[["ka", "kb"]].assign(similarity=both / every)
        return near[near["similarity"] >= threshold]

    pairs = cut(_held(pairs, own, lambda wanted: own.join(wanted, "id").select("hub", "k", "n", "s"), cut).applyInPandas(possible, "ka long, kb long"))
    whole = lambda wanted: _token_sets(rows.join(wanted, "id"), group, text, "hub").select("hub", "k", "h")
    return cut(_held(pairs, own, whole, cut).applyInPandas(compare, "ka long, kb long, similarity double"))


def _held(pairs: DataFrame, own: DataFrame, sets: Callable[[DataFrame], DataFrame], cut: Callable[[DataFrame], DataFrame]):
    """What sets gives (hub, k, ...) of the rows of the ends of pairs (ka, kb), and the pairs, brought together.

    A set goes once to each hub that it has pairs with, not to each pair: a pair's hub is the least first end of the
    pairs in which its own first end is the second, so sets that are all alike share one.
    """
    least = pairs.groupBy(F.col("kb").alias("ka")).agg(F.min("ka").alias("hub"))
    pairs = cut(pairs.join(least, "ka", "left").select(F.coalesce("hub", "ka").alias("hub"), "ka", "kb"))
    wanted = pairs.select("hub", F.col("ka").alias("k")).unionByName(pairs.select("hub", F.col("kb").alias("k"))).distinct()
    wanted = cut(wanted.join(own.groupBy("k").agg(F.min("id").alias("id")), "k").select("id", "hub"))
    count = wanted.count()
    task = F.pmod(F.xxhash64("hub"), F.lit(count // SETS_A_TASK + 1)).alias("task")
    held = sets(F.broadcast(wanted) if count <= MOST_SENT else wanted)
    return held.select(task, *held.columns[1:]).groupBy("task").cogroup(pairs.select(task, "ka", "kb").groupBy("task"))


def compact(memories: list[DataFrame], query: list[float], k: int, user_id=None) -> DataFrame:
    """Tier 1: id, title, memory_type, score, created_at, source of the k best of all layers; each layer is cut to k first."""
    best = [vector_search(m, query, k, user_id) for m in memories]
    rows = union(best).orderBy(F.desc("score"), "id").limit(k)
    return rows.select("id", F.left(F.coalesce("text", F.lit("")), F.lit(80)).alias("title"), F.coalesce("memory_type", F.lit("")).alias("memory_type"), F.coalesce("score", F.lit(0.0)).alias("score"), "created_at", F.col("layer").alias("source"))


def timeline(memories: DataFrame, anchors: DataFrame, earlier: int, later: int) -> DataFrame:
    """Tier 2: for each anchor (id), the rows of its user strictly before and after it, so many of each layer.

    anchor_id, id, title, created_at, layer, side (-1, 1), step (1: next to the anchor).
    """
    order = F.when(F.col("layer") == "canonical", 1).otherwise(0)
    found = memories.join(anchors.select("id"), "id", "left_semi")
    found = found.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(order, "layer"))).where("_n = 1")
    found = found.select(F.col("id").alias("anchor_id"), "user_id", F.col("created_at").alias("anchor_at"))
    rows = memories.join(found, "user_id").where("created_at <> anchor_at")
    rows = rows.withColumn("side", F.when(F.col("created_at") < F.col("anchor_at"), -1).otherwise(1))
    gap = F.abs(F.unix_micros("created_at") - F.unix_micros("anchor_at"))
    rows = rows.withColumn("step", F.row_number().over(Window.partitionBy("anchor_id", "layer", "side").orderBy(gap, "id")))
    rows = rows.where(F.col("step") <= F.when(F.col("side") < 0, earlier).otherwise(later))
    return rows.select("anchor_id", "id", F.left("text", F.lit(80)).alias("title"), "created_at", "layer", "side", "step")


def detail(memories: DataFrame, ids: DataFrame, user_id=None) -> DataFrame:
    """Tier 3: full rows by id, in the order of layers; of one user where one is given."""
    rows = memories.where(F.col("user_id") == user_id) if user_id is not None else memories
    rows = rows.join(ids.select("id").distinct(), "id", "left_semi")
    return rows.select("id", F.coalesce("text", F.lit("")).alias("content"), F.coalesce("memory_type", F.lit("")).alias("memory_type"), F.lit(1.0).alias("score"), "created_at", source_label().alias("source"), F.coalesce("metadata", F.lit("{}")).alias("metadata"))


def page(memories: DataFrame, offset: int, limit: int, user_id=None) -> DataFrame:
    """Newest memories first, a slice of them."""
    rows = memories.where(F.col("user_id") == user_id) if user_id is not None else memories
    return rows.orderBy(F.desc_nulls_last("created_at"), "layer", "id").offset(offset).limit(limit)


def search(layers: dict[str, DataFrame], queries: DataFrame, now: str, params: SearchParams = SearchParams()) -> DataFrame:
    """Layered hybrid search of many queries: candidates threefold a layer's quota, merge, decay, diversity, cut to the
    quota, layers one after another (canonical first), likes of earlier results dropped, cut to max_results.

    queries: query_id, user_id, query_embedding, terms. Result: query_id, position, id, text, score, layer, ...
    """
    quotas = params.quotas(list(layers))
    ranked = []
    for n, name in enumerate(sorted(layers, key=lambda x: x != "canonical")):
        k = 3 * quotas[name]
        view = layers[name]
        v = vector_candidates(view, queries.select("query_id", "user_id", "query_embedding"), k)
        t = keyword_candidates(view, queries.select("query_id", "user_id", "terms"), k)
        rows = temporal_decay(hybrid_merge(v, t, params, ("query_id", "id")), now, params)
        rows = diversify(rows, ["query_id"], params).where(F.col("position") < quotas[name])
        ranked.append(rows.withColumn("layer_no", F.lit(n)))
    rows = union(ranked).withColumnRenamed("position", "layer_position")
    if len(layers) > 1:
        rows = dedup_content(rows, ["query_id"], ["layer_no", "layer_position"], params)
    else:
        rows = rows.withColumn("position", F.col("layer_position"))
    return rows.where(F.col("position") < params.max_results).withColumn("source", source_label()).drop("layer_no", "layer_position", "embedding")


def with_working(results: DataFrame, working: DataFrame) -> DataFrame:
    """Search results and scored working messages (windows.recency_scores) in one order by score."""
    own = working.select("query_id", "id", F.col("content").alias("text"), "score", F.lit("working").alias("source"))
    return results.select("query_id", "id", "text", "score", "source").unionByName(own).withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")) - 1)
