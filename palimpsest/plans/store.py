"""Queries over the state of the store, its sessions and its texts, and their SQL; registered with those of the catalogue."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as txt
from ..functions.time import event_time, iso_text, iso_time
from ..functions.vector import cosine
from ..operators import evaluate, ingest, retrieval, state, windows
from ..operators.hooks import HashEmbedder, embedded
from .catalogue import _CANON, NOW, _canonical, _cut, events, messages, query, table

_USER = "user_id::VARCHAR"


def _profiles(spark, sf_dir):
    """A profile of each second user, with a counter of today or of yesterday."""
    rows = events(spark, sf_dir).where("user_id % 2 = 0").groupBy("user_id").agg(F.max("event_id").alias("m"))
    return rows.select(F.col("user_id").cast("string").alias("user_id"), (F.col("m") % 500).cast("int").alias("tokens_used_today"), F.when(F.col("user_id") % 3 == 0, 2000).cast("int").alias("token_budget_daily"), F.when(F.col("user_id") % 4 == 0, F.lit("2024-01-05 01:00:00")).otherwise(F.lit("2024-01-04 23:00:00")).cast("timestamp").alias("budget_reset_at"))


_PROFILES = f"""p AS (SELECT {_USER} AS user_id, max(event_id) % 500 AS used, CASE WHEN user_id % 3 = 0 THEN 2000 END AS budget, CASE WHEN user_id % 4 = 0 THEN TIMESTAMP '2024-01-05 01:00:00' ELSE TIMESTAMP '2024-01-04 23:00:00' END AS reset_at FROM events WHERE user_id % 2 = 0 GROUP BY user_id),
u AS (SELECT {_USER} AS user_id, sum(event_id % 100) AS spent FROM events WHERE ts::DATE = DATE '2024-01-05' AND event_id % 100 > 0 GROUP BY 1)"""


def _usage(spark, sf_dir):
    e = events(spark, sf_dir).where(F.to_date("ts") == F.lit("2024-01-05").cast("date"))
    return e.select(F.col("user_id").cast("string").alias("user_id"), (F.col("event_id") % 100).alias("tokens"))


@query(f"""WITH {_PROFILES}, b AS (SELECT coalesce(p.user_id, u.user_id) AS user_id, CASE WHEN p.user_id IS NULL OR reset_at::DATE < DATE '2024-01-05' THEN 0 ELSE used END + coalesce(spent, 0) AS used, coalesce(budget, 1000) AS daily_limit FROM p FULL JOIN u ON p.user_id = u.user_id)
SELECT user_id, used::BIGINT AS used, greatest(0, daily_limit - used)::BIGINT AS remaining, daily_limit::BIGINT AS daily_limit FROM b""")
def budget_after_reset(spark, sf_dir):
    return state.budget_left(_profiles(spark, sf_dir), _usage(spark, sf_dir), "2024-01-05 12:00:00", 1000)


@query(f"""WITH {_PROFILES} SELECT coalesce(p.user_id, u.user_id) AS user_id, (CASE WHEN spent IS NULL THEN used ELSE CASE WHEN reset_at::DATE >= DATE '2024-01-05' THEN used ELSE 0 END + spent END)::BIGINT AS tokens_used_today,
coalesce(budget, 1000)::BIGINT AS token_budget_daily, strftime(CASE WHEN spent IS NOT NULL AND (reset_at IS NULL OR reset_at::DATE < DATE '2024-01-05') THEN TIMESTAMP '2024-01-05 12:00:00' ELSE reset_at END, '%Y-%m-%d %H:%M:%S') AS budget_reset_at FROM p FULL JOIN u ON p.user_id = u.user_id""")
def usage_recorded(spark, sf_dir):
    out = state.recorded_usage(_profiles(spark, sf_dir), _usage(spark, sf_dir), "2024-01-05 12:00:00", 1000)
    return out.withColumn("budget_reset_at", F.date_format("budget_reset_at", "yyyy-MM-dd HH:mm:ss"))


@query(f"""WITH {_PROFILES}, b AS (SELECT coalesce(p.user_id, u.user_id) AS user_id, greatest(0, coalesce(budget, 1000) - CASE WHEN p.user_id IS NULL OR reset_at::DATE < DATE '2024-01-05' THEN 0 ELSE used END - coalesce(spent, 0)) AS remaining FROM p FULL JOIN u ON p.user_id = u.user_id)
SELECT event_id, CASE WHEN remaining <= 0 THEN 'over_budget' WHEN event_id % 100 / 100.0 < 0.5 THEN 'unsure' ELSE 'store' END AS outcome FROM events LEFT JOIN b ON b.user_id = events.{_USER}""")
def storable_memories(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", F.col("user_id").cast("string").alias("user_id"), (F.col("event_id") % 100 / 100).alias("confidence"))
    return state.storable(rows, budget_after_reset(spark, sf_dir)).select("event_id", "outcome")


@query(f"""WITH {_CANON}, a AS (SELECT c.*, CASE id % 5 WHEN 0 THEN 'ADD' WHEN 1 THEN 'UPDATE' WHEN 2 THEN 'SUPERSEDE' WHEN 3 THEN 'DELETE' ELSE 'NOOP' END AS action FROM c WHERE active)
SELECT c.id::VARCHAR AS id, CASE WHEN a.action IN ('SUPERSEDE', 'DELETE') OR NOT c.active THEN 'superseded' ELSE 'active' END AS status, a.action = 'UPDATE' AS rewritten, NULL::VARCHAR AS supersedes_memory_id, coalesce(a.action IN ('UPDATE', 'SUPERSEDE', 'DELETE'), false) AS touched FROM c LEFT JOIN a USING (id) WHERE a.action IS NOT NULL
UNION ALL SELECT id::VARCHAR, 'superseded', NULL, NULL, false FROM c WHERE NOT active
UNION ALL SELECT 'new ' || id, 'active', true, CASE WHEN action = 'SUPERSEDE' THEN id::VARCHAR END, true FROM a WHERE action IN ('ADD', 'SUPERSEDE')""")
def apply_all_actions(spark, sf_dir):
    c = _canonical(spark, sf_dir)
    action = F.element_at(F.array(*map(F.lit, ("ADD", "UPDATE", "SUPERSEDE", "DELETE", "NOOP"))), (F.col("id").cast("long") % 5 + 1).cast("int"))
    actions = c.where("status = 'active'").select("user_id", "memory_key", F.lit("rewritten").alias("value"), "memory_type", "confidence", "event_time", "embedding", action.alias("action"), F.col("id").alias("existing_id"), F.concat(F.lit("new "), F.col("id")).alias("new_id"))
    out = state.applied(c, actions, NOW)
    was_active = c.where("status = 'active'").select("id", F.lit(True).alias("was_active"))
    rewritten = F.when(F.coalesce("was_active", F.col("id").startswith("new ")), F.col("value") == "rewritten")
    return out.join(was_active, "id", "left").select("id", "status", rewritten.alias("rewritten"), "supersedes_memory_id", (F.col("updated_at") == F.lit(NOW).cast("timestamp")).alias("touched"))


@query("""SELECT user_id::VARCHAR AS user_id, sha256('key ' || user_id) AS key_hash, CASE WHEN user_id % 5 <> 0 THEN user_id::VARCHAR END AS owner FROM (SELECT DISTINCT user_id FROM events)""")
def verified_keys(spark, sf_dir):
    users = events(spark, sf_dir).select(F.col("user_id").cast("string").alias("user_id")).distinct()
    secret = F.concat(F.lit("key "), F.col("user_id"))
    keys = users.select(state.key_hash(secret).alias("key_hash"), "user_id", F.when(F.col("user_id").cast("long") % 5 == 0, F.lit(NOW)).cast("timestamp").alias("revoked_at"))
    asked = users.select(F.col("user_id").alias("asking"), secret.alias("api_key"))
    return state.verified_keys(asked, keys).select(F.col("asking").alias("user_id"), state.key_hash(F.col("api_key")).alias("key_hash"), F.col("user_id").alias("owner"))


@query("""SELECT event_id::VARCHAR AS id, (n - 1)::BIGINT AS ancestors, (n - 1)::INT AS depth FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n > 1""")
def supersede_chains(spark, sf_dir):
    """How many memories each one replaced, one after another."""
    w = Window.partitionBy("user_id", "memory_key").orderBy("event_time", F.col("id").cast("long"))
    c = _canonical(spark, sf_dir).withColumn("supersedes_memory_id", F.lag("id").over(w)).withColumn("consolidated_from", F.lit(None).cast("array<string>"))
    return state.lineage(c, _cut(spark)).groupBy("id").agg(F.count("*").alias("ancestors"), F.max("depth").alias("depth"))


@query(f"""WITH {_CANON}, m AS (SELECT user_id, list(id::VARCHAR ORDER BY id) AS ids FROM c WHERE active AND confidence >= 0.5 GROUP BY 1 HAVING count(*) > 1)
SELECT c.id::VARCHAR AS id, CASE WHEN active AND confidence < 0.5 OR active AND c.user_id NOT IN (SELECT user_id FROM m) THEN 'active' ELSE 'superseded' END AS status, 0::BIGINT AS merged_from FROM c
UNION ALL SELECT 'merged ' || user_id, 'active', len(ids) FROM m""")
def merged_clusters(spark, sf_dir):
    c = _canonical(spark, sf_dir)
    merges = c.where("status = 'active' and confidence >= 0.5").groupBy("user_id").agg(F.collect_list("id").alias("members")).where(F.size("members") > 1)
    merges = merges.select("user_id", "members", F.concat(F.lit("merged "), F.col("user_id")).alias("new_id"), F.lit("all").alias("content"), F.lit("fact").alias("memory_type"), F.lit("").alias("memory_key"), F.lit(None).cast("double").alias("confidence"))
    out = state.merged(c.withColumn("consolidated_from", F.lit(None).cast("array<string>")), merges, NOW)
    return out.select("id", "status", F.coalesce(F.size("consolidated_from").cast("long"), F.lit(0)).alias("merged_from")).withColumn("merged_from", F.greatest(F.col("merged_from"), F.lit(0)))


def _sessions(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("session_id"), F.col("ts").alias("created_at"))


@query(f"""SELECT event_id AS id FROM events WHERE NOT (user_id % 2 = 0 AND (event_type = 'click' OR ts < TIMESTAMP '2024-01-20 10:00:00'))""")
def started_sessions(spark, sf_dir):
    rows = _sessions(spark, sf_dir)
    starts = rows.where(F.col("user_id").cast("long") % 2 == 0).select("user_id", F.lit("click").alias("session_id")).distinct()
    return state.started_session(rows, starts, "2024-01-20 12:00:00").select("id")


@query("""SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS size FROM conversations) WHERE n > size - size % 3""")
def session_rest(spark, sf_dir):
    return state.session_rest(messages(spark, sf_dir), ["conv_id"], "turn", 3).select("conv_id", "turn")


@query("""SELECT user_id FROM (SELECT user_id::VARCHAR AS user_id FROM events UNION SELECT source FROM documents UNION SELECT label::VARCHAR FROM embeddings)""")
def all_users(spark, sf_dir):
    own = {"events": events(spark, sf_dir).select(F.col("user_id").cast("string").alias("user_id")), "documents": table(spark, sf_dir, "documents").select(F.col("source").alias("user_id")), "embeddings": table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("user_id"))}
    return state.all_users(own)


@query("""SELECT user_id, sum(a)::BIGINT AS memories, sum(b)::BIGINT AS vectors FROM (SELECT user_id::VARCHAR AS user_id, 1 AS a, 0 AS b FROM events UNION ALL SELECT label::VARCHAR, 0, 1 FROM embeddings) GROUP BY 1""")
def counts_by_user(spark, sf_dir):
    return state.counts_by_user({"memories": events(spark, sf_dir).select(F.col("user_id").cast("string").alias("user_id")), "vectors": table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("user_id"))})


@query("SELECT doc_id FROM documents WHERE source LIKE 'src1_'")
def users_like(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("user_id", F.col("source"))
    return state.users_like(rows, "src1_").select("doc_id")


@query("""SELECT name, count(*) FILTER (user_id <> 3)::BIGINT AS rows_left FROM (SELECT 'events' AS name, user_id FROM events UNION ALL SELECT 'embeddings', label FROM embeddings) GROUP BY 1 UNION ALL SELECT 'used', sum(CASE WHEN user_id = 4 THEN 0 ELSE m % 500 END)::BIGINT FROM (SELECT user_id, max(event_id) AS m FROM events WHERE user_id % 2 = 0 GROUP BY 1)""")
def tenant_reset(spark, sf_dir):
    tables = {"events": events(spark, sf_dir).select(F.col("user_id").cast("string").alias("user_id")), "embeddings": table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("user_id"))}
    kept, _ = state.reset_user(tables, _profiles(spark, sf_dir), "3")
    _, profiles = state.reset_user({}, _profiles(spark, sf_dir), "4")
    out = [t.agg(F.count("*").alias("rows_left")).select(F.lit(name).alias("name"), "rows_left") for name, t in kept.items()]
    return out[0].union(out[1]).union(profiles.select(F.lit("used").alias("name"), F.sum("tokens_used_today").cast("long").alias("rows_left")))


@query("""SELECT event_id, (props->>'k')::INT AS k, event_type AS kind, user_id AS owner FROM events""")
def metadata_merge(spark, sf_dir):
    old = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit('{"kind":"old","k":'), F.get_json_object("props", "$.k"), F.lit("}"))).otherwise(F.col("props"))
    merged = state.metadata_merged(old, F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("owner"))))
    rows = events(spark, sf_dir).select("event_id", merged.alias("m"))
    return rows.select("event_id", F.get_json_object("m", "$.k").cast("int").alias("k"), F.get_json_object("m", "$.kind").alias("kind"), F.get_json_object("m", "$.owner").cast("long").alias("owner"))


@query("""SELECT event_id, CASE WHEN ts >= TIMESTAMP '2024-01-20 11:30:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00' THEN 's1' END AS source_session_id, (props->>'k')::INT AS k FROM events""")
def provenance(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", F.col("ts").alias("created_at"), F.col("props").alias("metadata"))
    out = state.with_provenance(rows, "2024-01-20 12:00:00", 30, "s1")
    return out.select("event_id", F.get_json_object("metadata", "$.source_session_id").alias("source_session_id"), F.get_json_object("metadata", "$.k").cast("int").alias("k"))


_REPLY = "CASE turn % 5 WHEN 0 THEN 'ok.' WHEN 1 THEN 'Thank you!!' WHEN 2 THEN 'yes?' ELSE text END"


@query(f"""SELECT conv_id, turn, len(c) < 20 AND NOT contains(c, '?') AND lower(rtrim(c, '.!,')) IN ('ok', 'okay', 'sure', 'thanks', 'thank you', 'yes', 'no', 'yep', 'nope', 'got it', 'k', 'yea', 'yeah', 'alright') AS low_information FROM (SELECT conv_id, turn, {_REPLY} AS c FROM conversations)""")
def low_information(spark, sf_dir):
    return messages(spark, sf_dir).select("conv_id", "turn", F.expr(_REPLY.replace("text", "content")).alias("c")).select("conv_id", "turn", txt.is_low_information(F.col("c")).alias("low_information"))


@query(f"""SELECT conv_id, turn, lower(role) AS role FROM (SELECT conv_id, turn, role, {_REPLY} AS c FROM conversations) WHERE NOT (len(c) < 20 AND NOT contains(c, '?') AND lower(rtrim(c, '.!,')) IN ('ok', 'okay', 'sure', 'thanks', 'thank you', 'yes', 'no', 'yep', 'nope', 'got it', 'k', 'yea', 'yeah', 'alright')) AND trim(c) <> ''""")
def selected_messages(spark, sf_dir):
    rows = messages(spark, sf_dir).withColumn("content", F.expr(_REPLY.replace("text", "content")))
    return ingest.select_messages(rows).select("conv_id", "turn", "role")


@query("""SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS conversation FROM conversations GROUP BY 1""")
def conversation_text(spark, sf_dir):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "content")))
    return messages(spark, sf_dir).groupBy("conv_id").agg(txt.conversation_lines(turns).alias("conversation"))


@query("""SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9$]+'), lambda t: len(t) >= 3 AND t NOT IN ('what', 'when', 'where', 'which', 'who', 'whom', 'whose', 'how', 'why', 'did', 'does', 'do', 'is', 'are', 'was', 'were', 'the', 'a', 'an', 'to', 'of', 'in', 'on', 'for', 'with', 'and', 'or', 'my', 'your', 'our', 'i', 'me', 'you', 'it', 'that', 'this', 'there'))).list_sort() AS terms FROM benchmark""")
def evidence_terms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_sort(txt.evidence_terms(F.col("text"))).alias("terms"))


@query("""SELECT doc_id, CASE WHEN len(text) <= 300 THEN text ELSE text[1:100] || chr(10) || '...' || chr(10) || substring(text, (floor((len(text) - 100) / 2) + 1)::BIGINT, 100) || chr(10) || '...' || chr(10) || text[-100:] END AS sampled, left(text, 50) AS truncated FROM documents""")
def head_middle_tail(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", txt.head_middle_tail(F.col("text"), 300).alias("sampled"), txt.truncated(F.col("text"), 50).alias("truncated"))


@query("""SELECT doc_id, rtrim(ltrim(text, ' ' || chr(9) || chr(10) || chr(13)), ' ' || chr(9) || chr(10) || chr(13)) AS stripped FROM documents""")
def fences_stripped(spark, sf_dir):
    fenced = F.concat(F.lit("```json\n"), F.col("text"), F.lit("\n```"))
    return table(spark, sf_dir, "documents").select("doc_id", txt.strip_fences(fenced).alias("stripped"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || '+00:00' AS written,
CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS valid, epoch_us(CASE event_id % 4 WHEN 0 THEN date_trunc('day', ts) WHEN 3 THEN NULL ELSE date_trunc('second', ts) END) AS micros FROM events""")
def iso_times(spark, sf_dir):
    at = F.col("ts")
    given = F.element_at(F.array(F.date_format(at, " yyyy-MM-dd "), F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format(at, "dd.MM.yyyy")), (F.col("event_id") % 4 + 1).cast("int"))
    written = F.regexp_replace(iso_text(at), "Z$", "+00:00")
    return events(spark, sf_dir).select("event_id", written.alias("written"), iso_time(given).alias("valid"), F.unix_micros(event_time(given)).alias("micros"))


@query("""SELECT conv_id, turn, round(list_sum([x[1] * x[2] FOR x IN list_zip(a, b)]) / sqrt(list_sum([x * x FOR x IN a]) * list_sum([x * x FOR x IN b])), 5) AS similarity FROM (
SELECT conv_id, turn, [v0::DOUBLE, v1, v2, v3] AS a, lag([v0::DOUBLE, v1, v2, v3]) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM (
SELECT conv_id, turn, CASE WHEN sum(n) IS NULL THEN 1 ELSE sum(CASE slot WHEN 0 THEN n WHEN 3 THEN n / 2 ELSE 0 END) END AS v0, coalesce(sum(CASE slot WHEN 1 THEN n WHEN 0 THEN n / 2 ELSE 0 END), 0) AS v1, coalesce(sum(CASE slot WHEN 2 THEN n WHEN 1 THEN n / 2 ELSE 0 END), 0) AS v2, coalesce(sum(CASE slot WHEN 3 THEN n WHEN 2 THEN n / 2 ELSE 0 END), 0) AS v3 FROM (
SELECT c.conv_id, c.turn, w.slot, w.n FROM conversations c LEFT JOIN (SELECT conv_id, turn, list_sum([unicode(x) FOR x IN string_split(t, '')]) % 4 AS slot, count(*)::DOUBLE AS n FROM (
SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}_]+')) AS t FROM conversations) GROUP BY 1, 2, 3) w ON w.conv_id = c.conv_id AND w.turn = c.turn) GROUP BY 1, 2)) WHERE b IS NOT NULL""")
def embedded_turns(spark, sf_dir):
    """Likeness of each turn to the one before, by the offline embedder of four slots."""
    rows = embedded(messages(spark, sf_dir).select("conv_id", "turn", "content"), "content", lambda: HashEmbedder(4))
    before = F.lag("embedding").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = rows.withColumn("before", before).where("before is not null")
    return rows.select("conv_id", "turn", F.round(cosine(F.col("embedding").cast("array<double>"), F.col("before").cast("array<double>")), 5).alias("similarity"))


@query("""SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY again, turn) - 1)::INT AS position FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) > 1 AS again FROM conversations)""")
def spread_by_role(spark, sf_dir):
    return windows.spread(messages(spark, sf_dir), ["conv_id"], "role", "turn").select("conv_id", "turn", F.col("position").cast("int").alias("position"))


@query("""SELECT conv_id, min(turn) AS turn, role FROM conversations GROUP BY 1, 3""")
def first_by_role(spark, sf_dir):
    return windows.first_of(messages(spark, sf_dir), ["conv_id", "role"], "turn").select("conv_id", "turn", "role")


@query("""WITH m AS (SELECT user_id AS query_id, event_id AS id, (event_id * 7 % 1000) / 1000::DOUBLE AS score FROM events WHERE event_id % 2 = 0), w AS (SELECT user_id AS query_id, event_id AS id, event_id % 10 / 10::DOUBLE AS score FROM events WHERE event_id % 2 = 1)
SELECT query_id, id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1)::INT AS position FROM (SELECT * FROM m UNION ALL SELECT * FROM w)""")
def results_with_working(spark, sf_dir):
    e = events(spark, sf_dir).select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), F.lit("t").alias("text"))
    found = e.where("id % 2 = 0").withColumn("score", F.col("id") * 7 % 1000 / 1000).withColumn("source", F.lit("fact"))
    working = e.where("id % 2 = 1").select("query_id", "id", F.col("text").alias("content"), (F.col("id") % 10 / 10).alias("score"))
    return retrieval.with_working(found, working).select("query_id", "id", F.col("position").cast("int").alias("position"))


@query("""SELECT kind, run, v AS best FROM (SELECT event_type AS kind, user_id AS run, v, row_number() OVER (PARTITION BY event_type ORDER BY v DESC, user_id DESC) AS n FROM
(SELECT event_type, user_id, CASE WHEN user_id % 3 = 0 THEN round(avg(value), 6) ELSE count(*) END AS v FROM events GROUP BY 1, 2)) WHERE n = 1""")
def best_runs(spark, sf_dir):
    runs = events(spark, sf_dir).groupBy(F.col("event_type").alias("kind"), F.col("user_id").alias("run")).agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").cast("double").alias("n"))
    return evaluate.best_run(runs.withColumn("mean", F.when(F.col("run") % 3 == 0, F.col("mean"))), "kind", "mean", "n")


@query("""SELECT user_id, coalesce(sum(event_id) FILTER (event_type = 'view'), 0)::INT AS memories_scanned, coalesce(sum(event_id) FILTER (event_type = 'click'), 0)::INT AS memories_merged, count(*) FILTER (event_type = 'purchase')::INT AS memories_deleted, count(*) FILTER (event_type = 'signup')::INT AS memories_abstracted, count(*) FILTER (event_id % 50 = 0)::INT AS n_errors FROM events GROUP BY 1""")
def consolidation_reports(spark, sf_dir):
    kind = F.create_map(*[F.lit(x) for x in ("view", "scan", "click", "merge", "purchase", "delete", "signup", "abstract")])[F.col("event_type")]
    rows = events(spark, sf_dir).select("user_id", kind.alias("kind"), F.col("event_id").alias("size"), F.lit(0.0).alias("seconds"), F.when(F.col("event_id") % 50 == 0, F.lit("failed")).alias("error"))
    out = state.report(rows)
    return out.select("user_id", "memories_scanned", "memories_merged", "memories_deleted", "memories_abstracted", F.size("errors").alias("n_errors"))


@query("""SELECT conv_id, floor((n - 1) / 3)::BIGINT AS batch, count(*) AS turns FROM (SELECT conv_id % 10 AS conv_id, dense_rank() OVER (PARTITION BY conv_id % 10 ORDER BY conv_id) AS n FROM conversations) GROUP BY 1, 2""")
def session_batches(spark, sf_dir):
    sessions = messages(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("turns"))
    out = ingest.batched_sessions(sessions.withColumn("user_id", F.col("conv_id") % 10), "user_id", "conv_id", 3)
    return out.select(F.col("user_id").alias("conv_id"), "batch", F.size("turns").cast("long").alias("turns"))
