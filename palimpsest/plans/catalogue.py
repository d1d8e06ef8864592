"""The queries over the driver's tables, and their SQL.

The tables stand for the memory store: embeddings (label) and documents (source) and events (user_id) for tenants'
memories, conversations for working messages, benchmark for questions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as txt
from ..functions.sets import jaccard
from ..functions.time import decay
from ..functions.vector import clamped, cosine, normalised, resized
from ..operators import evaluate, ingest, retrieval, state, windows
from ..params import SearchParams

NOW = "2024-02-01 00:00:00"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as a memory view; the three layers by vec_id modulo 3."""
    layer = F.element_at(F.array(*map(F.lit, ("canonical", "episodic", "semantic"))), F.pmod("vec_id", F.lit(3)).cast("int") + 1)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("user_id"), F.concat(F.lit("memory "), F.col("vec_id")).alias("text"), F.lit("fact").alias("memory_type"), F.lit(NOW).cast("timestamp").alias("created_at"), F.lit("{}").alias("metadata"), "embedding", layer.alias("layer"))


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"])


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").withColumnRenamed("text", "content")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


_COSINE = "list_sum([x[1]::DOUBLE * x[2]::DOUBLE FOR x IN list_zip(e.embedding, q.embedding)]) / (sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN e.embedding])) * sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN q.embedding])))"
_WORDS = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9_]+'))"


@query(f"""SELECT e.vec_id AS id, round({_COSINE}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
ORDER BY {_COSINE} DESC, e.vec_id LIMIT 20""")
def vector_topk(spark, sf_dir):
    return retrieval.vector_search(vectors(spark, sf_dir), query_vector(spark, sf_dir), 20).select("id", F.round("score", 6).alias("score"))


@query(f"""SELECT e.vec_id AS id, round({_COSINE}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
WHERE {_COSINE} >= 0.3 ORDER BY {_COSINE} DESC, e.vec_id LIMIT 5""")
def similar_threshold_topk(spark, sf_dir):
    return retrieval.vector_search(vectors(spark, sf_dir), query_vector(spark, sf_dir), 5, least=0.3).select("id", F.round("score", 6).alias("score"))


@query(f"""WITH s AS (SELECT e.vec_id AS id, {_COSINE} AS score, e.vec_id % 3 AS l FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)
SELECT id, 'memory ' || id AS title, 'fact' AS memory_type, round(score, 6) AS score, ['canonical', 'episodic', 'semantic'][(l + 1)::INT] AS source FROM s ORDER BY score DESC, id LIMIT 15""")
def compact_union(spark, sf_dir):
    views = vectors(spark, sf_dir)
    layers = [views.where(F.col("layer") == name) for name in ("canonical", "episodic", "semantic")]
    return retrieval.compact(layers, query_vector(spark, sf_dir), 15).select("id", "title", "memory_type", F.round("score", 6).alias("score"), "source")


@query(f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {_COSINE} AS score FROM embeddings e JOIN embeddings q ON e.label = q.label WHERE q.vec_id % 100 = 0)
SELECT query_id, id, round(score, 6) AS vector_score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5""")
def vector_candidates(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    queries = rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), "user_id", F.col("embedding").alias("query_embedding"))
    return retrieval.vector_candidates(rows, queries, 5).select("query_id", "id", F.round("vector_score", 6).alias("vector_score"))


# The searches above and keyword_topk with every hundredth row as a query, against all rows.

_ALL = f"s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {_COSINE} AS score, e.vec_id % 3 AS l FROM embeddings e CROSS JOIN embeddings q WHERE q.vec_id % 100 = 0)"
_BEST = "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= {0}"


def _vector_queries(spark, sf_dir) -> DataFrame:
    return vectors(spark, sf_dir).where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))


@query(f"WITH {_ALL} SELECT query_id, id, round(score, 6) AS score FROM s {_BEST.format(20)}")
def vector_topk_all(spark, sf_dir):
    return retrieval.vector_search_all(vectors(spark, sf_dir), _vector_queries(spark, sf_dir), 20).select("query_id", "id", F.round("score", 6).alias("score"))


@query(f"WITH {_ALL} SELECT query_id, id, round(score, 6) AS score FROM s WHERE score >= 0.3 {_BEST.format(5)}")
def similar_threshold_topk_all(spark, sf_dir):
    return retrieval.vector_search_all(vectors(spark, sf_dir), _vector_queries(spark, sf_dir), 5, least=0.3).select("query_id", "id", F.round("score", 6).alias("score"))


@query(f"""WITH {_ALL} SELECT query_id, id, 'memory ' || id AS title, 'fact' AS memory_type, round(score, 6) AS score, ['canonical', 'episodic', 'semantic'][(l + 1)::INT] AS source FROM s {_BEST.format(15)}""")
def compact_union_all(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    best = retrieval.vector_search_all(rows, _vector_queries(spark, sf_dir), 15).join(rows.select("id", "text", "memory_type", "layer"), "id")
    return best.select("query_id", "id", F.left("text", F.lit(80)).alias("title"), "memory_type", F.round("score", 6).alias("score"), F.col("layer").alias("source"))


@query(f"""WITH {_ALL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, l ORDER BY score DESC, id) AS n FROM s WHERE l < 2)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY l, n) - 1)::BIGINT AS position, id, round(score, 6) AS score FROM r WHERE n <= CASE l WHEN 0 THEN 6 ELSE 4 END""")
def quota_search_all(spark, sf_dir):
    from pyspark.sql import Window

    queries, quotas = _vector_queries(spark, sf_dir), SearchParams().quotas(["canonical", "episodic"])
    parts = [retrieval.vector_search_all(vectors(spark, sf_dir).where(F.col("layer") == name), queries, k).withColumn("layer_no", F.lit(n)) for n, (name, k) in enumerate(quotas.items())]
    position = F.row_number().over(Window.partitionBy("query_id").orderBy("layer_no", F.desc("score"), "id")) - 1
    return parts[0].unionByName(parts[1]).select("query_id", position.cast("long").alias("position"), "id", F.round("score", 6).alias("score"))


@query("""WITH q AS (SELECT item_id AS query_id, list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')), lambda w: len(w) >= 2) AS terms FROM benchmark),
d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS ws FROM documents),
m AS (SELECT query_id, id, terms, ws FROM d CROSS JOIN q WHERE len(terms) > 0 AND list_has_all(ws, terms)),
s AS (SELECT query_id, id, list_sum([len(list_filter(ws, lambda w: w = t)) / (len(list_filter(ws, lambda w: w = t)) + 1) FOR t IN terms]) / len(terms) AS text_score FROM m)
SELECT query_id, id, round(text_score, 6) AS text_score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(text_score, 9) DESC, id) <= 5""")
def keyword_topk_all(spark, sf_dir):
    terms = F.filter(txt.tokens(F.col("text")), lambda w: F.length(w) >= 2)
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), terms.alias("terms"))
    return retrieval.keyword_search_all(_texts(spark, sf_dir), queries, 5).select("query_id", "id", F.round("text_score", 6).alias("text_score"))


def _texts(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("source").alias("user_id"), "text", F.col("lang").alias("memory_type"), F.lit(NOW).cast("timestamp").alias("created_at"), F.lit("{}").alias("metadata"), F.lit(None).cast("array<float>").alias("embedding"), F.lit("semantic").alias("layer"))


def _keyword_queries(spark, sf_dir) -> DataFrame:
    """The first two distinct words of each benchmark item, asked of the one tenant of the item's remainder."""
    terms = F.slice(F.filter(txt.tokens(F.col("text")), lambda w: F.length(w) >= 2), 1, 2)
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("src"), F.pmod("item_id", F.lit(20))).alias("user_id"), terms.alias("terms"))


@query("""WITH q AS (SELECT item_id AS query_id, 'src' || (item_id % 20) AS user_id, list_filter(list_distinct_first, lambda w: len(w) >= 2)[1:2] AS terms FROM
(SELECT item_id, list_transform(list_sort([{'i': list_position(ws, w), 'w': w} FOR w IN list_distinct(ws)]), lambda s: s.w) AS list_distinct_first FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS ws FROM benchmark))),
d AS (SELECT doc_id AS id, source AS user_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS ws FROM documents),
m AS (SELECT query_id, id, terms, ws FROM d JOIN q USING (user_id) WHERE len(terms) > 0 AND list_has_all(ws, terms)),
s AS (SELECT query_id, id, list_sum([len(list_filter(ws, lambda w: w = t)) / (len(list_filter(ws, lambda w: w = t)) + 1) FOR t IN terms]) / len(terms) AS text_score FROM m)
SELECT query_id, id, round(text_score, 6) AS text_score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY text_score DESC, id) <= 5""")
def keyword_topk(spark, sf_dir):
    return retrieval.keyword_candidates(_texts(spark, sf_dir), _keyword_queries(spark, sf_dir), 5).select("query_id", "id", F.round("text_score", 6).alias("text_score"))


@query("""SELECT coalesce(v.id, k.id) AS id, round(coalesce(vs, 0), 6) AS vector_score, round(coalesce(ts, 0), 6) AS text_score, round(0.7 * coalesce(vs, 0) + 0.3 * coalesce(ts, 0), 6) AS score
FROM (SELECT event_id AS id, value / 1000 AS vs FROM events WHERE value >= 10) v FULL JOIN (SELECT event_id AS id, value / 500 AS ts FROM events WHERE value < 50) k ON v.id = k.id""")
def hybrid_merge(spark, sf_dir):
    e = events(spark, sf_dir)
    v = e.where("value >= 10").select(F.col("event_id").alias("id"), (F.col("value") / 1000).alias("vector_score"))
    k = e.where("value < 50").select(F.col("event_id").alias("id"), (F.col("value") / 500).alias("text_score"))
    return retrieval.hybrid_merge(v, k).select("id", *[F.round(c, 6).alias(c) for c in ("vector_score", "text_score", "score")])


@query(f"""SELECT event_id, round(value * exp(-ln(2) / 30 * greatest(0, epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 86400000000.0), 6) AS score FROM events""")
def temporal_decay(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", F.col("value").alias("score"), F.col("ts").alias("created_at"))
    return retrieval.temporal_decay(rows, NOW).select("event_id", F.round("score", 6).alias("score"))


@query(f"""WITH s AS (SELECT e.vec_id AS id, {_COSINE} AS score, e.vec_id % 3 AS l FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
r AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY score DESC, id) AS n FROM s WHERE l < 2)
SELECT (row_number() OVER (ORDER BY l, n) - 1)::BIGINT AS position, id, round(score, 6) AS score FROM r WHERE n <= CASE l WHEN 0 THEN 6 ELSE 4 END""")
def quota_search(spark, sf_dir):
    from pyspark.sql import Window

    q, params = query_vector(spark, sf_dir), SearchParams()
    quotas = params.quotas(["canonical", "episodic"])
    parts = []
    for n, (name, k) in enumerate(quotas.items()):
        best = retrieval.vector_search(vectors(spark, sf_dir).where(F.col("layer") == name), q, k)
        parts.append(best.select(F.lit(n).alias("layer_no"), "id", "score"))
    rows = parts[0].unionByName(parts[1])  # ten rows at most
    position = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("layer_no", F.desc("score"), "id")) - 1
    return rows.select(position.cast("long").alias("position"), "id", F.round("score", 6).alias("score"))


@query()
def layered_search(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    queries = rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), "user_id", F.col("embedding").alias("query_embedding"), F.array(F.lit("memory")).alias("terms"))
    layers = {name: rows.where(F.col("layer") == name) for name in ("canonical", "episodic")}
    return retrieval.search(layers, queries, NOW).select("query_id", "position", "id", F.round("score", 6).alias("score"), "source")


@query()
def mmr(spark, sf_dir):
    """Every hundredth memory asked of its user's, three times the results fetched; texts are the documents of the same number."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("own"))
    rows = vectors(spark, sf_dir)
    queries = rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), "user_id", F.col("embedding").alias("query_embedding"))
    found = retrieval.vector_candidates(rows, queries, 3 * SearchParams().max_results).select("query_id", "id", "text", F.col("vector_score").alias("score"))
    found = found.join(docs, "id", "left").select("query_id", "id", F.coalesce("own", "text").alias("text"), "score")
    return retrieval.diversify(found, ["query_id"]).select("query_id", "position", "id")


#: Of rows in order of id, those kept that are like none kept before; p has the likes (grp, a, b).
_KEPT = """o AS (SELECT grp, id, row_number() OVER (PARTITION BY grp ORDER BY id) AS n FROM {rows}),
near AS (SELECT grp, b AS id, list(a) AS earlier FROM p GROUP BY 1, 2),
r(grp, n, kept) AS (SELECT DISTINCT grp, 0::BIGINT, []::BIGINT[] FROM o UNION ALL SELECT r.grp, o.n, CASE WHEN list_has_any(r.kept, coalesce(near.earlier, []::BIGINT[])) THEN r.kept ELSE list_append(r.kept, o.id) END FROM r JOIN o ON o.grp = r.grp AND o.n = r.n + 1 LEFT JOIN near ON near.grp = o.grp AND near.id = o.id),
kept AS (SELECT grp, unnest(kept) AS id FROM (SELECT grp, arg_max(kept, n) AS kept FROM r GROUP BY 1))"""


@query(f"""WITH RECURSIVE t AS (SELECT doc_id, source, {_WORDS.format('text')} AS ws FROM documents),
p AS (SELECT a.source AS grp, a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.source = b.source AND a.doc_id < b.doc_id AND least(len(a.ws), len(b.ws)) >= 0.85 * greatest(len(a.ws), len(b.ws))
WHERE len(a.ws) + len(b.ws) = 0 OR len(list_intersect(a.ws, b.ws)) / (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws))) >= 0.85),
{_KEPT.format(rows="(SELECT source AS grp, doc_id AS id FROM documents)")}
SELECT grp AS query_id, row_number() OVER (PARTITION BY grp ORDER BY id) - 1 AS position, id FROM kept""")
def content_dedup(spark, sf_dir):
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("id"), "text")
    kept = retrieval.distinct_contents(rows, "query_id", _cut(spark)).withColumnRenamed("grp", "query_id")
    position = F.row_number().over(Window.partitionBy("query_id").orderBy("id")) - 1
    return kept.select("query_id", position.cast("long").alias("position"), "id")


@query(f"""WITH t AS (SELECT doc_id, source, {_WORDS.format('text')} AS ws FROM documents),
p AS (SELECT a.source AS grp, a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.ws, b.ws)) AS c, len(a.ws) + len(b.ws) AS n FROM t a JOIN t b ON a.source = b.source AND a.doc_id < b.doc_id AND least(len(a.ws), len(b.ws)) >= 0.85 * greatest(len(a.ws), len(b.ws)))
SELECT grp, a, b, round(c / (n - c), 6) AS similarity FROM p WHERE c / (n - c) >= 0.85""")
def jaccard_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    return retrieval.similar_pairs(rows, 0.85, "source", cut=_cut(spark)).select("grp", "a", "b", F.round("similarity", 6).alias("similarity"))


_PAIRS = f"""p AS (SELECT e.label AS grp, e.vec_id AS a, q.vec_id AS b, {_COSINE} AS similarity FROM embeddings e JOIN embeddings q ON e.label = q.label AND e.vec_id < q.vec_id WHERE {_COSINE} >= 0.3)"""


@query(f"WITH {_PAIRS} SELECT grp, a, b, round(similarity, 6) AS similarity FROM p")
def cosine_pairs(spark, sf_dir):
    return state.similar_pairs(vectors(spark, sf_dir), "user_id", 0.3).select("grp", "a", "b", F.round("similarity", 6).alias("similarity"))


def _cut(spark: SparkSession):
    """Checkpoints in the folder of spark.checkpoint.dir, or in one of our own where none is set."""
    import tempfile

    sc = spark.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir", None) and sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="palimpsest-checkpoint-"))
    return lambda df: df.checkpoint()


@query(f"""WITH RECURSIVE {_PAIRS}, e2 AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach(a, b) AS (SELECT DISTINCT a, a FROM e2 UNION SELECT r.a, e2.b FROM reach r JOIN e2 ON e2.a = r.b)
SELECT a AS id, min(b) AS component FROM reach GROUP BY 1""")
def vector_clusters(spark, sf_dir):
    return state.components(state.similar_pairs(vectors(spark, sf_dir), "user_id", 0.3), _cut(spark))


@query(f"""WITH RECURSIVE {_PAIRS}, e2 AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach(a, b) AS (SELECT DISTINCT a, a FROM e2 UNION SELECT r.a, e2.b FROM reach r JOIN e2 ON e2.a = r.b),
c AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY 1),
m AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY component ORDER BY id) <= 10)
SELECT component, string_agg(id::VARCHAR, ',' ORDER BY id) AS members FROM m GROUP BY 1 HAVING count(*) >= 2""")
def cluster_members(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    labels = state.components(state.similar_pairs(rows, "user_id", 0.3), _cut(spark))
    return state.clusters(labels, rows, ["id"]).select("component", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"))


@query(f"""WITH RECURSIVE {_PAIRS}, {_KEPT.format(rows="(SELECT label AS grp, vec_id AS id FROM embeddings)")} SELECT vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT id FROM kept)""")
def vector_dedup(spark, sf_dir):
    return state.like_earlier(state.similar_pairs(vectors(spark, sf_dir), "user_id", 0.3), _cut(spark))


@query(f"""SELECT conv_id, turn, len({_WORDS.format('text')})::INT AS n_tokens, (CASE WHEN len(text) = 0 THEN 0 ELSE greatest(1, len(text) // 4) END)::INT AS estimated,
len(list_filter(string_split_regex(regexp_replace(text, '([.!?。！？])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> ''))::INT AS n_sentences,
trim(regexp_replace(text, '\\s+', ' ', 'g')) AS normalised FROM conversations""")
def text_functions(spark, sf_dir):
    t = F.col("content")
    return messages(spark, sf_dir).select("conv_id", "turn", F.size(txt.tokens(t)).alias("n_tokens"), txt.estimated_tokens(t).alias("estimated"), F.size(txt.sentences(t)).alias("n_sentences"), txt.normalise(t).alias("normalised"))


@query("SELECT doc_id, left(text, 80) AS title, coalesce(nullif(lang, ''), 'semantic') AS source FROM documents")
def titles(spark, sf_dir):
    from ..schemas import source_label

    return _texts(spark, sf_dir).select(F.col("id").alias("doc_id"), F.left("text", F.lit(80)).alias("title"), source_label().alias("source"))


@query("""SELECT conv_id, turn, string_agg(k, '|' ORDER BY k) AS keywords FROM (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(text, '[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*')) AS raw, lower(raw) AS k FROM conversations) WHERE len(k) > 1 AND NOT contains(k, '"')
GROUP BY 1, 2""".replace("string_agg(k,", "string_agg(DISTINCT k,"))
def capital_words(spark, sf_dir):
    found = F.transform(F.regexp_extract_all(F.col("content"), F.lit(r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*"), F.lit(0)), lambda x: F.lower(x))
    rows = messages(spark, sf_dir).select("conv_id", "turn", F.array_sort(F.array_distinct(F.filter(found, lambda x: F.length(x) > 1))).alias("k"))
    return rows.where(F.size("k") > 0).select("conv_id", "turn", F.array_join("k", "|").alias("keywords"))


_STOP = ", ".join(f"'{w}'" for w in txt.QUERY_STOP_WORDS)


@query(f"""SELECT item_id, list_aggregate(list_filter(list_filter(string_split_regex(trim(lower(text)), '[\\s.,!?;:"''()\\[\\]{{}}<>/\\\\|@#$%^&*=+~`]+'), lambda w: w <> '' AND w NOT IN ({_STOP}) AND NOT (regexp_full_match(w, '[\\x00-\\x7F]*') AND len(w) < 3) AND NOT regexp_full_match(w, '\\d+')), lambda w, i: list_position(list_filter(string_split_regex(trim(lower(text)), '[\\s.,!?;:"''()\\[\\]{{}}<>/\\\\|@#$%^&*=+~`]+'), lambda w: w <> '' AND w NOT IN ({_STOP}) AND NOT (regexp_full_match(w, '[\\x00-\\x7F]*') AND len(w) < 3) AND NOT regexp_full_match(w, '\\d+')), w) = i), 'string_agg', ' ') AS keywords,
array_to_string(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}\\p{{M}}_]+'), ' & ') AS match FROM benchmark""")
def query_keywords(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(txt.query_keywords(F.col("text")), " ").alias("keywords"), txt.match_query(F.col("text")).alias("match"))


@query("""SELECT doc_id, regexp_replace(replace(regexp_replace(regexp_replace(lower(trim(text)), '[ \\t-]+', '_', 'g'), '\\.{2,}', '.', 'g'), chr(10), ''), '[^a-z0-9_.À-ÿ]', '', 'g') AS memory_key,
CASE WHEN lang IN ('preference', 'fact', 'decision', 'event') THEN lang ELSE 'fact' END AS memory_type FROM documents""")
def memory_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", txt.memory_key(F.col("text")).alias("memory_key"), txt.memory_type(F.col("lang")).alias("memory_type"))


@query("""WITH t AS (SELECT conv_id, turn, text, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations)
SELECT conv_id, turn FROM t QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3""")
def working_recent(spark, sf_dir):
    return windows.recent(messages(spark, sf_dir), ["conv_id"], "turn", 3).select("conv_id", "turn")


@query("""SELECT conv_id, turn, round(0.3 + 0.3 * (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / greatest(count(*) OVER (PARTITION BY conv_id) - 1, 1), 6) AS score FROM conversations""")
def working_scores(spark, sf_dir):
    return windows.recency_scores(messages(spark, sf_dir), ["conv_id"], "turn").select("conv_id", "turn", F.round("score", 6).alias("score"))


@query("""SELECT conv_id, turn, row_number() OVER w AS number, ceil(row_number() OVER w / 3)::BIGINT AS drain, row_number() OVER w % 3 = 0 AS is_drain FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def drain_slices(spark, sf_dir):
    return windows.drains(messages(spark, sf_dir), ["conv_id"], "turn", 3).select("conv_id", "turn", "number", "drain", "is_drain")


@query("""WITH t AS (SELECT conv_id, turn, role, CASE WHEN len(text) = 0 THEN 0 ELSE greatest(1, len(text) // 4) END AS tokens FROM conversations),
s AS (SELECT *, CASE WHEN turn = min(CASE WHEN role = 'system' THEN turn END) OVER (PARTITION BY conv_id) THEN 1 ELSE 0 END AS place FROM t),
r AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id) - coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY place, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, row_number() OVER (PARTITION BY conv_id ORDER BY place DESC, turn DESC) AS back FROM s)
SELECT conv_id, turn, tokens::BIGINT AS tokens FROM r WHERE rest <= 300 OR back = 1""")
def trim_budget(spark, sf_dir):
    return windows.trimmed(messages(spark, sf_dir), ["conv_id"], "turn", 300).select("conv_id", "turn", "tokens")


@query("SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1")
def session_counts(spark, sf_dir):
    return messages(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("n"))


_NEAR = """SELECT a.event_id AS anchor_id, e.event_id AS id, e.ts AS created_at, CASE WHEN e.ts < a.ts THEN -1 ELSE 1 END AS side, abs(epoch_us(e.ts) - epoch_us(a.ts)) AS gap
FROM events e JOIN events a ON e.user_id = a.user_id AND e.ts <> a.ts WHERE a.event_id % 100 = 0"""


@query(f"""SELECT anchor_id, id, side, row_number() OVER (PARTITION BY anchor_id, side ORDER BY gap, id)::INT AS step FROM ({_NEAR}) QUALIFY step <= CASE WHEN side < 0 THEN 3 ELSE 2 END""")
def timeline(spark, sf_dir):
    e = events(spark, sf_dir).select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("text"), F.col("ts").alias("created_at"), F.lit("episodic").alias("layer"))
    return retrieval.timeline(e, e.where("id % 100 = 0"), 3, 2).select("anchor_id", "id", "side", "step")


@query("SELECT doc_id AS id, text AS content, lang AS memory_type, 1.0::DOUBLE AS score, lang AS source FROM documents WHERE doc_id IN (SELECT item_id * 7 FROM benchmark)")
def detail_by_ids(spark, sf_dir):
    ids = table(spark, sf_dir, "benchmark").select((F.col("item_id") * 7).alias("id"))
    return retrieval.detail(_texts(spark, sf_dir), ids).select("id", "content", "memory_type", "score", "source")


@query("SELECT event_id AS id FROM events ORDER BY ts DESC, event_id LIMIT 25 OFFSET 50")
def list_paginated(spark, sf_dir):
    e = events(spark, sf_dir).select(F.col("event_id").alias("id"), F.lit("episodic").alias("layer"), F.col("ts").alias("created_at"))
    return retrieval.page(e, 50, 25).select("id")


@query("""WITH w AS (SELECT conv_id, turn, unnest(list_filter(string_split_regex(regexp_replace(text, '([.!?。！？])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')) AS s, generate_subscripts(list_filter(string_split_regex(regexp_replace(text, '([.!?。！？])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> ''), 1) AS i FROM conversations),
n AS (SELECT conv_id, turn, count(*) AS n FROM w GROUP BY 1, 2),
k AS (SELECT conv_id, turn, i, t, count(*) AS tf FROM (SELECT conv_id, turn, i, unnest(regexp_extract_all(lower(s), '[a-z0-9_]+')) AS t FROM w) GROUP BY 1, 2, 3, 4),
d AS (SELECT conv_id, turn, t, count(*) AS df FROM k GROUP BY 1, 2, 3)
SELECT conv_id, turn, i::INT AS sentence, round(sum(tf / m * (ln((n + 1) / (df + 1)) + 1)), 6) AS weight FROM k JOIN d USING (conv_id, turn, t) JOIN n USING (conv_id, turn)
JOIN (SELECT conv_id, turn, i, sum(tf) AS m FROM k GROUP BY 1, 2, 3) USING (conv_id, turn, i) GROUP BY 1, 2, 3""")
def tfidf_sentences(spark, sf_dir):
    rows = messages(spark, sf_dir).select("conv_id", "turn", txt.sentences(F.col("content")).alias("sentences"))
    words = rows.select("conv_id", "turn", F.size("sentences").alias("n"), F.posexplode("sentences").alias("i", "s"))
    words = words.withColumn("own", F.regexp_extract_all(F.lower("s"), F.lit("[a-z0-9_]+"), F.lit(0)))
    words = words.select("conv_id", "turn", "n", (F.col("i") + 1).alias("sentence"), F.size("own").alias("m"), F.explode("own").alias("t"))
    tf = words.groupBy("conv_id", "turn", "n", "sentence", "m", "t").agg((F.count("*") / F.col("m")).alias("tf"))
    df = tf.groupBy("conv_id", "turn", "t").agg(F.count("*").alias("df"))
    weight = F.col("tf") * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1)
    return tf.join(df, ["conv_id", "turn", "t"]).groupBy("conv_id", "turn", "sentence").agg(F.round(F.sum(weight), 6).alias("weight"))


@query("""WITH RECURSIVE m AS (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations),
l AS (SELECT conv_id, turn, t, list_filter([trim(x) FOR x IN string_split_regex(regexp_replace(t, '([.!?。！？])\\s+', '\\1' || chr(1), 'g'), chr(1))], lambda s: s <> '') AS parts FROM m WHERE len(t) > 320),
s AS (SELECT conv_id, turn, unnest(parts) AS s, generate_subscripts(parts, 1) AS i, len(parts) AS n FROM l WHERE len(parts) > 2 AND len(parts[1]) + len(parts[-1]) + 1 <= 320),
k AS (SELECT conv_id, turn, i, n, t, count(*) AS tf, min(pos) AS pos, any_value(m) AS m FROM (SELECT conv_id, turn, i, n, len(ts) AS m, unnest(ts) AS t, generate_subscripts(ts, 1) AS pos FROM (SELECT *, regexp_extract_all(lower(s), '[a-z0-9_]+') AS ts FROM s)) GROUP BY 1, 2, 3, 4, 5),
d AS (SELECT conv_id, turn, t, count(*) AS df FROM k GROUP BY 1, 2, 3),
w AS (SELECT conv_id, turn, i, list_aggregate(list((tf / m) * (ln((n + 1) / (df + 1)) + 1) ORDER BY pos), 'fsum') AS weight FROM k JOIN d USING (conv_id, turn, t) GROUP BY 1, 2, 3),
o AS (SELECT conv_id, turn, i, len(s) AS size, row_number() OVER (PARTITION BY conv_id, turn ORDER BY coalesce(weight, 0) DESC, i) AS pos FROM s LEFT JOIN w USING (conv_id, turn, i) WHERE i > 1 AND i < n),
g(conv_id, turn, pos, room, kept) AS (SELECT conv_id, turn, 0::BIGINT, 320 - len(parts[1]) - len(parts[-1]) - 1, [1, len(parts)] FROM l WHERE len(parts) > 2 AND len(parts[1]) + len(parts[-1]) + 1 <= 320
UNION ALL SELECT g.conv_id, g.turn, o.pos, CASE WHEN size + 1 <= room THEN room - size - 1 ELSE room END, CASE WHEN size + 1 <= room THEN list_append(kept, i) ELSE kept END FROM g JOIN o ON o.conv_id = g.conv_id AND o.turn = g.turn AND o.pos = g.pos + 1),
b AS (SELECT conv_id, turn, arg_max(kept, pos) AS kept FROM g GROUP BY 1, 2)
SELECT m.conv_id, m.turn, CASE WHEN len(m.t) <= 320 THEN m.t WHEN b.kept IS NULL THEN rtrim(m.t[:208]) || ' ... ' || ltrim(m.t[-107:]) ELSE array_to_string([parts[x] FOR x IN list_sort(b.kept)], ' ') END AS content
FROM m LEFT JOIN l USING (conv_id, turn) LEFT JOIN b USING (conv_id, turn)""")
def compress_messages(spark, sf_dir):
    return messages(spark, sf_dir).select("conv_id", "turn", ingest.compressed(F.col("content"), 320).alias("content"))


@query()
def topic_segments(spark, sf_dir):
    from ..params import SensoryParams

    rows = ingest.select_messages(messages(spark, sf_dir))
    return ingest.segmented(rows, ["conv_id"], "turn", SensoryParams(topic_token_threshold=100))


@query()
def session_summaries(spark, sf_dir):
    return ingest.session_summaries(messages(spark, sf_dir), ["conv_id"], "turn")


@query("""WITH s AS (SELECT doc_id, trim(text, ' ' || chr(10) || chr(9) || chr(13)) AS t FROM documents)
SELECT doc_id, i::INT AS chunk_no, trim(substring(t, i * 1480 + 1, 1600), ' ' || chr(10) || chr(9) || chr(13)) AS chunk FROM (SELECT doc_id, t, unnest(range(0, (greatest(0, ceil((len(t) - 1600) / 1480)) + 1)::BIGINT)) AS i FROM s)""")
def chunk_overlap(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", F.posexplode(txt.chunks(F.col("text"))).alias("chunk_no", "chunk"))


@query("SELECT event_id, (props->>'k')::INT AS k, (props->>'missing') IS NULL AS missing FROM events")
def json_props(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.get_json_object("props", "$.missing").isNull().alias("missing"))


@query("""SELECT event_type AS operation, count(*) AS calls, sum(event_id % 100)::BIGINT AS input_tokens, sum(event_id % 10)::BIGINT AS output_tokens, round(sum(value), 4) AS duration_ms FROM events GROUP BY 1""")
def usage_by_operation(spark, sf_dir):
    calls = events(spark, sf_dir).select(F.col("event_type").alias("operation"), (F.col("event_id") % 100).alias("input_tokens"), (F.col("event_id") % 10).alias("output_tokens"), F.col("value").alias("duration_ms"))
    return state.usage_summary(calls).withColumn("duration_ms", F.round("duration_ms", 4))


@query("""SELECT user_id::VARCHAR AS user_id, sum(event_id % 100)::BIGINT AS used, greatest(0, 1000 - sum(event_id % 100))::BIGINT AS remaining, 1000::BIGINT AS daily_limit FROM events WHERE ts::DATE = DATE '2024-01-05' AND event_id % 100 > 0 GROUP BY 1""")
def daily_budget(spark, sf_dir):
    e = events(spark, sf_dir).where(F.to_date("ts") == F.lit("2024-01-05").cast("date"))
    usage = e.select(F.col("user_id").cast("string").alias("user_id"), (F.col("event_id") % 100).alias("tokens"))
    profiles = spark.createDataFrame([], "user_id string, tokens_used_today int, token_budget_daily int, budget_reset_at timestamp")
    return state.budget_left(profiles, usage, "2024-01-05 12:00:00", 1000)


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r(user_id, event_id, n, last, allowed) AS (SELECT user_id, event_id, n, t, true FROM o WHERE n = 1 UNION ALL
SELECT o.user_id, o.event_id, o.n, CASE WHEN o.t - r.last >= 3600000000 THEN o.t ELSE r.last END, o.t - r.last >= 3600000000 FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
SELECT event_id, allowed FROM r""")
def rate_limit(spark, sf_dir):
    calls = events(spark, sf_dir).select("event_id", "user_id", "ts")
    return windows.rate_limited(calls, "user_id", "ts", "event_id", 1, 3600.0).select("event_id", "allowed")


@query("""SELECT event_id, (1 + coalesce(sum(CASE WHEN gap > 7200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0))::BIGINT AS session FROM
(SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)""")
def session_gaps(spark, sf_dir):
    return windows.sessions(events(spark, sf_dir), "user_id", "ts", "event_id").select("event_id", "session")


def _canonical(spark, sf_dir) -> DataFrame:
    """Each user's last event of each type as an active canonical memory, the others as superseded."""
    from pyspark.sql import Window

    last = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id"))) == 1
    return events(spark, sf_dir).select(
        F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("memory_key"), F.round("value", 2).cast("string").alias("value"),
        F.when(F.col("event_type") == "click", "event").otherwise("fact").alias("memory_type"), (F.col("event_id") % 100 / 100).alias("confidence"), F.col("ts").alias("event_time"),
        F.when(last, "active").otherwise("superseded").alias("status"), F.lit(None).cast("string").alias("supersedes_memory_id"), F.lit(None).cast("array<float>").alias("embedding"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"),
    )


_CANON = """c AS (SELECT event_id AS id, user_id, event_type AS memory_key, event_id % 100 / 100.0 AS confidence, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1 AS active FROM events)"""


@query(f"""WITH {_CANON}, cand AS (SELECT event_id AS cid, user_id, CASE WHEN value < 20 THEN 'new ' ELSE '' END || event_type AS memory_key, ((event_id * 7) % 100) / 100.0 AS confidence, CASE WHEN value > 60 THEN ts END AS event_time, value < 10 AS alike FROM events)
SELECT cid, CASE WHEN c.id IS NULL THEN CASE WHEN alike THEN 'NOOP' ELSE 'ADD' END WHEN event_time > c.ts THEN 'SUPERSEDE' WHEN event_time < c.ts THEN 'NOOP'
WHEN cand.confidence > c.confidence THEN 'SUPERSEDE' WHEN cand.confidence < c.confidence THEN 'NOOP' ELSE 'UPDATE' END AS action, c.id::VARCHAR AS existing_id
FROM cand LEFT JOIN c ON c.active AND c.user_id = cand.user_id AND c.memory_key = cand.memory_key""")
def conflict_rules(spark, sf_dir):
    key = F.concat(F.when(F.col("value") < 20, "new ").otherwise(""), F.col("event_type"))
    candidates = events(spark, sf_dir).select(
        F.col("event_id").alias("cid"), F.col("user_id").cast("string").alias("user_id"), key.alias("memory_key"), F.lit("other").alias("value"), ((F.col("event_id") * 7) % 100 / 100).alias("confidence"),
        F.when(F.col("value") > 60, F.col("ts")).alias("event_time"), (F.col("value") < 10).alias("similar"),
    )
    return state.resolved(candidates, _canonical(spark, sf_dir)).select("cid", "action", "existing_id")


@query("""SELECT event_id AS ord, CASE WHEN n = 1 THEN 'ADD' WHEN ts > prev THEN 'SUPERSEDE' ELSE 'other' END AS action FROM
(SELECT event_id, ts, row_number() OVER w AS n, lag(ts) OVER w AS prev FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))""")
def folded_candidates(spark, sf_dir):
    from pyspark.sql import Window

    c = _canonical(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("user_id", "memory_key").orderBy("event_time", F.col("id").cast("long"))).cast("long"))
    out = state.fold_candidates(c, "n").select("user_id", "memory_key", "n", "action")
    return out.join(c.select("user_id", "memory_key", "n", F.col("id").cast("long").alias("ord")), ["user_id", "memory_key", "n"]).select("ord", "action")


@query(f"""WITH {_CANON} SELECT id::VARCHAR AS id, CASE WHEN confidence < 0.5 AND active THEN 'superseded' WHEN active THEN 'active' ELSE 'superseded' END AS status FROM c
UNION ALL SELECT 'new ' || id, 'active' FROM c WHERE confidence < 0.5 AND active""")
def apply_actions(spark, sf_dir):
    c = _canonical(spark, sf_dir)
    hit = c.where("status = 'active' and confidence < 0.5")
    actions = hit.select("user_id", "memory_key", F.lit("v").alias("value"), "memory_type", "confidence", "event_time", "embedding", F.lit("SUPERSEDE").alias("action"), F.col("id").alias("existing_id"), F.concat(F.lit("new "), F.col("id")).alias("new_id"))
    return state.applied(c, actions, NOW).select("id", "status")


@query(f"""WITH {_CANON} SELECT id::VARCHAR AS id, CASE WHEN confidence < 0.2 THEN 'deleted' WHEN active THEN 'active' ELSE 'superseded' END AS status FROM c""")
def soft_delete(spark, sf_dir):
    c = _canonical(spark, sf_dir)
    return state.soft_deleted(c, c.where("confidence < 0.2"), NOW).select("id", "status")


@query(f"""WITH {_CANON} SELECT id::VARCHAR AS id FROM c WHERE active OR ts >= TIMESTAMP '2024-01-17'""")
def cleanup(spark, sf_dir):
    return state.cleaned(_canonical(spark, sf_dir), "2024-02-16 00:00:00").select("id")


@query(f"""WITH {_CANON} SELECT id::VARCHAR AS id, 'stale' AS why FROM c WHERE active AND confidence < 0.7 AND ts < TIMESTAMP '2024-01-27'
UNION ALL SELECT id::VARCHAR, 'promotable' FROM c WHERE active AND memory_key = 'click' AND ts < TIMESTAMP '2024-01-27' + INTERVAL 90 DAY""")
def stale_and_promotable(spark, sf_dir):
    c, now = _canonical(spark, sf_dir), "2024-07-25 00:00:00"
    return state.stale(c, now).select("id", F.lit("stale").alias("why")).unionByName(state.promotable(c, now).select("id", F.lit("promotable").alias("why")))


@query(f"""WITH {_CANON} SELECT user_id::VARCHAR AS user_id, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-20') AS new_memories FROM c WHERE active GROUP BY 1 HAVING count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-20') >= 3""")
def consolidation_trigger(spark, sf_dir):
    from ..params import StateParams

    c = _canonical(spark, sf_dir)
    log = c.select("user_id").distinct().select("user_id", F.lit("completed").alias("status"), F.lit("2024-01-20").cast("timestamp").alias("finished_at"))
    return state.consolidation_due(c, log, StateParams(consolidation_threshold=3))


@query("""WITH a AS (SELECT conv_id, turn, list_filter(string_split_regex(regexp_replace(lower(text), '[^\\p{L}\\p{M}\\p{N}_\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '' AND x NOT IN ('a', 'an', 'the')) AS ws FROM conversations),
w AS (SELECT x.conv_id, x.turn, x.ws AS p, y.ws AS q FROM a x JOIN a y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1),
c AS (SELECT *, coalesce(list_sum([least(len(list_filter(p, lambda x: x = w)), len(list_filter(q, lambda x: x = w))) FOR w IN list_distinct(p)]), 0) AS common FROM w)
SELECT conv_id, turn, (array_to_string(p, ' ') = array_to_string(q, ' '))::INT::DOUBLE AS exact_match, round(CASE WHEN len(p) + len(q) = 0 THEN 1 WHEN common = 0 THEN 0 ELSE 2 * common / (len(p) + len(q)) END, 6) AS f1 FROM c""")
def em_f1(spark, sf_dir):
    m = messages(spark, sf_dir).select("conv_id", "turn", F.col("content").alias("prediction"))
    rows = m.join(m.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("prediction").alias("answer")), ["conv_id", "turn"])
    return evaluate.answer_scores(rows, "prediction", "answer").select("conv_id", "turn", "exact_match", F.round("f1", 6).alias("f1"))


def _ranked(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "labels")
    return e.select((F.col("doc_id") % 40).alias("question_id"), F.floor(F.col("doc_id") / 40).alias("position"), F.concat(F.lit("corpus/doc"), F.col("doc_id"), F.lit(".md")).alias("path"), F.col("doc_id").alias("id"), "quality", "toxic")


@query("""WITH r AS (SELECT doc_id % 40 AS question_id, doc_id // 40 AS position, doc_id, toxic FROM labels),
g AS (SELECT question_id, count(*) FILTER (WHERE toxic = 1) AS n, count(*) FILTER (WHERE toxic = 1 AND position < 10) AS got FROM r GROUP BY 1)
SELECT question_id, n AS n_evidence, (got > 0 OR n = 0)::INT::DOUBLE AS hit, round(CASE WHEN n = 0 THEN 1 ELSE got / n END, 6) AS coverage, (n = 0 OR got = n)::INT::DOUBLE AS all_hit FROM g""")
def hit_at_k(spark, sf_dir):
    r = _ranked(spark, sf_dir)
    evidence = r.where("toxic = 1").select("question_id", F.concat(F.lit("doc"), F.col("id"), F.lit(".md")).alias("file"))
    evidence = evidence.withColumn("file", F.concat(F.lit("/"), F.col("file")))
    return evaluate.hits(r, evidence, 10).withColumn("coverage", F.round("coverage", 6))


@query("""WITH r AS (SELECT doc_id % 40 AS query_id, doc_id // 40 AS position, toxic AS rel FROM labels),
g AS (SELECT query_id, max(CASE WHEN rel = 1 THEN 1.0 / (position + 1) END) AS rr, sum(CASE WHEN position < 5 THEN rel ELSE 0 END) AS found, sum(CASE WHEN position < 5 THEN rel / log2(position + 2) ELSE 0 END) AS dcg, sum(rel) AS n FROM r GROUP BY 1)
SELECT query_id, round(rr::DOUBLE, 6) AS reciprocal_rank, round(found / n, 6) AS recall, round(dcg / list_sum([1 / log2(i + 1) FOR i IN range(1, least(n, 5)::BIGINT + 1)]), 6) AS ndcg FROM g WHERE n > 0""")
def ranking_metrics(spark, sf_dir):
    r = _ranked(spark, sf_dir).withColumnRenamed("question_id", "query_id")
    out = evaluate.ranking_metrics(r.select("query_id", "position", "id"), r.where("toxic = 1").select("query_id", "id"))
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in ("reciprocal_rank", "recall", "ndcg")])


@query("""SELECT lang AS question_type, count(*) AS n, round(avg(n_chars), 6) AS f1, round(avg(CASE WHEN doc_id % 10 > 0 THEN n_chars END), 6) AS hit FROM documents GROUP BY ROLLUP (lang)""")
def metrics_by_type(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    q = F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 10 == 0, "_abs").otherwise(""))
    scores = d.select(q.alias("question_id"), F.col("lang").alias("question_type"), F.col("n_chars").alias("f1"), F.col("n_chars").alias("hit"))
    return evaluate.by_type(scores, ["f1", "hit"], ["hit"]).select("question_type", "n", F.round("f1", 6).alias("f1"), F.round("hit", 6).alias("hit"))


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents) ORDER BY n, lang LIMIT 50")
def balanced_sample(spark, sf_dir):
    return windows.balanced_sample(table(spark, sf_dir, "documents"), "lang", "doc_id", 50).select("doc_id", "lang")


@query("""SELECT vec_id, round(sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding[1:16]])), 6) AS head_norm, 16::INT AS short_size, 80::INT AS long_size, 1.0::DOUBLE AS unit FROM embeddings""")
def vector_shapes(spark, sf_dir):
    from ..functions.vector import norm

    e = table(spark, sf_dir, "embeddings")
    v = F.col("embedding")
    return e.select("vec_id", F.round(norm(F.slice(v, 1, 16)), 6).alias("head_norm"), F.size(resized(v, 16)).alias("short_size"), F.size(resized(v, 80)).alias("long_size"), F.round(norm(normalised(v)), 6).alias("unit"))


@query("""SELECT event_id, round(greatest(0, least(1, value / 100)), 6) AS clamped, round(exp(-ln(2) / 7 * greatest(0, epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 86400000000.0), 6) AS weight FROM events""")
def scalar_functions(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.round(clamped(F.col("value") / 100), 6).alias("clamped"), F.round(decay(F.col("ts"), NOW, 7), 6).alias("weight"))


@query(f"""WITH t AS (SELECT conv_id, turn, {_WORDS.format('text')} AS ws FROM conversations)
SELECT a.conv_id, a.turn, round(len(list_intersect(a.ws, b.ws)) / (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws))), 6) AS similarity FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def turn_similarity(spark, sf_dir):
    m = messages(spark, sf_dir).select("conv_id", "turn", txt.tokens(F.col("content")).alias("w"))
    n = m.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return m.join(n, ["conv_id", "turn"]).select("conv_id", "turn", F.round(jaccard(F.col("w"), F.col("v")), 6).alias("similarity"))
