"""State of the memory store: conflict resolution, deletes, clusters, staleness, retention, budgets.

Tables are immutable; every operator returns the next snapshot or the actions that lead to it. One writer a tenant.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.time import before
from ..functions.vector import cosine
from ..params import StateParams
from .windows import folded

_P = StateParams()


def rule_action(candidate: dict, existing: dict | None, similar: bool) -> tuple[str, str]:
    """(action, reason) for a candidate against the active memory with its key, by time, confidence, value in turn."""
    if existing is None:
        return ("NOOP", "like a stored memory") if similar else ("ADD", "new")
    ours, theirs = candidate.get("event_time"), existing.get("event_time")
    if ours is not None and theirs is not None and ours != theirs:
        return ("SUPERSEDE", "newer") if ours > theirs else ("NOOP", "older")
    a, b = candidate.get("confidence"), existing.get("confidence")
    a, b = 0.8 if a is None else a, 0.8 if b is None else b
    if a != b:
        return ("SUPERSEDE", "surer") if a > b else ("NOOP", "less sure")
    return ("NOOP", "same value") if candidate.get("value") == existing.get("value") else ("UPDATE", "new value")


def resolved(candidates: DataFrame, canonical: DataFrame) -> DataFrame:
    """candidates with action, reason and existing_id against the stored canonical memories of the same user and key.

    candidates: user_id, memory_key, value, confidence, event_time, and similar (whether a stored memory is alike);
    each is held against the store as it is. fold_candidates applies many of one key in order.
    """
    own = canonical.where(F.col("status") == "active").select("user_id", "memory_key", F.col("id").alias("existing_id"), F.col("value").alias("_value"), F.coalesce("confidence", F.lit(0.8)).alias("_confidence"), F.col("event_time").alias("_time"))
    rows = candidates.join(own, ["user_id", "memory_key"], "left").withColumn("_own", F.coalesce("confidence", F.lit(0.8)))
    both, newer = F.col("event_time").isNotNull() & F.col("_time").isNotNull(), F.col("event_time") > F.col("_time")
    branch = lambda no_key, like, new, old, sure, unsure, same, other: (
        F.when(F.col("existing_id").isNull(), F.when(F.coalesce("similar", F.lit(False)), like).otherwise(no_key))
        .when(both & newer, new).when(both & (F.col("event_time") < F.col("_time")), old)
        .when(F.col("_own") > F.col("_confidence"), sure).when(F.col("_own") < F.col("_confidence"), unsure)
        .when(F.col("value").eqNullSafe(F.col("_value")), same).otherwise(other)
    )
    rows = rows.withColumn("action", branch("ADD", "NOOP", "SUPERSEDE", "NOOP", "SUPERSEDE", "NOOP", "NOOP", "UPDATE"))
    rows = rows.withColumn("reason", branch("new", "like a stored memory", "newer", "older", "surer", "less sure", "same value", "new value"))
    return rows.drop("_value", "_confidence", "_time", "_own")


def fold_candidates(candidates: DataFrame, order: str) -> DataFrame:
    """user_id, memory_key, order, action, reason, value of candidates applied one after another to an empty key."""
    rows = candidates.select("user_id", "memory_key", F.col(order), "value", "confidence", F.unix_micros("event_time").alias("event_time"))
    made = T.StructField("made", T._parse_datatype_string("action string, reason string, value string"))

    def step(current: dict | None, c: dict) -> tuple[dict | None, dict]:
        action, reason = rule_action(c, current, False)
        current = c if action != "NOOP" else current
        return current, {"action": action, "reason": reason, "value": current["value"]}

    out = folded(rows, ["user_id", "memory_key"], [order], made, step)
    return out.select("user_id", "memory_key", order, "made.action", "made.reason", "made.value")


def applied(canonical: DataFrame, actions: DataFrame, now: str) -> DataFrame:
    """The next snapshot of canonical memories.

    actions: user_id, memory_key, value, memory_type, confidence, event_time, embedding, action, existing_id, new_id.
    SUPERSEDE and DELETE end the existing row, UPDATE rewrites it (its embedding too), ADD and SUPERSEDE insert.
    """
    at = F.lit(now).cast("timestamp")
    change = actions.where(F.col("action").isin("UPDATE", "SUPERSEDE", "DELETE")).select(F.col("existing_id").alias("id"), "action", *[F.col(c).alias(f"_{c}") for c in ("value", "confidence", "event_time", "embedding")])
    rows = canonical.join(change, "id", "left")
    update = F.col("action") == "UPDATE"
    for c in ("value", "confidence", "event_time", "embedding"):
        rows = rows.withColumn(c, F.when(update, F.col(f"_{c}")).otherwise(F.col(c)))
    rows = rows.withColumn("status", F.when(F.col("action").isin("SUPERSEDE", "DELETE"), "superseded").otherwise(F.col("status")))
    rows = rows.withColumn("updated_at", F.when(F.col("action").isNotNull(), at).otherwise(F.col("updated_at")))
    key = F.when(F.coalesce("memory_key", F.lit("")) == "", F.concat(F.lit("memory_"), F.sha2("new_id", 256))).otherwise(F.col("memory_key"))
    new = actions.where(F.col("action").isin("ADD", "SUPERSEDE")).select(
        F.col("new_id").alias("id"), "user_id", key.alias("memory_key"), "value", "memory_type", F.coalesce("confidence", F.lit(0.8)).alias("confidence"), "event_time",
        F.lit("active").alias("status"), F.when(F.col("action") == "SUPERSEDE", F.col("existing_id")).alias("supersedes_memory_id"), "embedding", at.alias("created_at"), at.alias("updated_at"),
    )
    return rows.select(canonical.columns).unionByName(new, allowMissingColumns=True)


def duplicate_keys(canonical: DataFrame) -> DataFrame:
    """user_id, memory_key with more than one active row: none in a sound snapshot."""
    return canonical.where("status = 'active'").groupBy("user_id", "memory_key").count().where("count > 1")


def similar_to_stored(candidates: DataFrame, stored: DataFrame, threshold: float = _P.conflict_similarity) -> DataFrame:
    """candidates with similar: whether a stored vector of the user reaches the threshold."""
    c = candidates.select("id", "user_id", F.col("embedding").alias("_e"))
    hits = c.join(stored.where("embedding is not null").select("user_id", F.col("embedding").alias("_s")), "user_id").where(cosine(F.col("_e"), F.col("_s")) >= threshold).select("id").distinct()
    return candidates.join(hits.withColumn("similar", F.lit(True)), "id", "left").withColumn("similar", F.coalesce("similar", F.lit(False)))


def similar_pairs(rows: DataFrame, group: str, threshold: float, block: int = 512) -> DataFrame:
    """group, a, b, similarity of pairs a < b of a group with a cosine of threshold or more.

    Vectors are dealt in blocks; a task holds two blocks of a group and multiplies them as matrices, so a group that
    holds a third of all rows is many tasks, and only pairs that pass become rows.
    """
    own = rows.where(F.col("embedding").isNotNull()).select(F.col(group).alias("grp"), F.col("id"), "embedding")
    sizes = own.groupBy("grp").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    own = own.join(sizes, "grp").withColumn("block", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    dealt = own.withColumn("other", other).select("grp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "embedding")
    schema = f"grp {rows.schema[group].dataType.simpleString()}, a {rows.schema['id'].dataType.simpleString()}, b {rows.schema['id'].dataType.simpleString()}, similarity double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        parts = []
        for k in (i, j):
            p = pdf[pdf["block"] == k].drop_duplicates("id")
            x = np.array(p["embedding"].tolist(), float).reshape(len(p), -1)
            length = np.sqrt((x * x).sum(axis=1))
            parts.append((p["id"].to_numpy(), np.divide(x, length[:, None], out=np.zeros_like(x), where=length[:, None] >= 1e-10)))
        (a, x), (b, y) = parts
        s = x @ y.T if len(a) and len(b) else np.zeros((len(a), len(b)))
        at = np.argwhere(s >= threshold)
        at = at[a[at[:, 0]] < b[at[:, 1]]] if i == j else at
        first, second = a[at[:, 0]], b[at[:, 1]]
        return pd.DataFrame({"grp": [pdf["grp"].iloc[0]] * len(at), "a": np.minimum(first, second), "b": np.maximum(first, second), "similarity": s[at[:, 0], at[:, 1]]})

    return dealt.groupBy("grp", "i", "j").applyInPandas(run, schema)


def like_earlier(edges: DataFrame, cut) -> DataFrame:
    """id of the rows that go when, in order of id, each row like one kept before it goes. edges: a < b, the likes.

    In each round rows without an open earlier neighbour are kept and their neighbours go. `cut` ends a round's lineage.
    """
    edges = cut(edges.select("a", "b"))
    out = edges.select(F.col("b").alias("id")).limit(0)
    while edges.take(1):
        keep = edges.select("a").distinct().join(edges.select(F.col("b").alias("a")), "a", "left_anti")
        gone = cut(edges.join(keep, "a", "left_semi").select(F.col("b").alias("id")).distinct())
        edges = cut(edges.join(gone.toDF("b"), "b", "left_anti").join(gone.toDF("a"), "a", "left_anti").select("a", "b"))
        out = out.unionByName(gone)
    return out


def components(edges: DataFrame, checkpoint) -> DataFrame:
    """id, component of the ends of edges (a, b): least ids spread along edges and then jump to their own label.

    checkpoint(df) cuts the lineage of each round (DataFrame.checkpoint, or a written table).
    """
    both = checkpoint(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = checkpoint(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")))
    while True:
        near = both.join(label.toDF("b", "other"), "b").groupBy("a").agg(F.min("other").alias("other"))
        step = label.join(near, "a").select("a", F.least("label", "other").alias("label"), F.col("label").alias("was"))
        jump = step.join(step.select(F.col("a").alias("label"), F.col("label").alias("further")), "label", "left")
        new = checkpoint(jump.select("a", F.least("label", F.coalesce("further", F.col("label"))).alias("label"), "was"))
        if not new.where("label <> was").take(1):
            return new.select(F.col("a").alias("id"), F.col("label").alias("component"))
        label = new.select("a", "label")


def clusters(labels: DataFrame, rows: DataFrame, order: list[str], most: int = _P.max_cluster) -> DataFrame:
    """component, member ids of clusters of two or more, the first `most` by order; the others stay as they are."""
    w = Window.partitionBy("component").orderBy(*order)
    own = labels.join(rows, "id").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    members = F.transform(F.array_sort(F.collect_list(F.struct("_n", "id"))), lambda s: s["id"])
    return own.groupBy("component").agg(members.alias("members")).where(F.size("members") >= 2)


def merged(canonical: DataFrame, merges: DataFrame, now: str) -> DataFrame:
    """Next snapshot after merges (user_id, members, new_id, content, memory_type, memory_key, confidence)."""
    at = F.lit(now).cast("timestamp")
    gone = merges.select(F.explode("members").alias("id")).distinct().withColumn("_gone", F.lit(True))
    rows = canonical.join(gone, "id", "left").withColumn("status", F.when(F.col("_gone"), "superseded").otherwise(F.col("status"))).withColumn("updated_at", F.when(F.col("_gone"), at).otherwise(F.col("updated_at")))
    key = F.when(F.coalesce("memory_key", F.lit("")) == "", F.concat(F.lit("memory_"), F.sha2("new_id", 256))).otherwise(F.col("memory_key"))
    new = merges.select(F.col("new_id").alias("id"), "user_id", key.alias("memory_key"), F.col("content").alias("value"), "memory_type", F.coalesce("confidence", F.lit(0.9)).alias("confidence"), F.lit("active").alias("status"), F.col("members").alias("consolidated_from"), at.alias("created_at"), at.alias("updated_at"))
    return rows.select(canonical.columns).unionByName(new, allowMissingColumns=True)


def soft_deleted(canonical: DataFrame, ids: DataFrame, now: str) -> DataFrame:
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    rows = canonical.join(hit, "id", "left")
    return rows.withColumn("status", F.when(F.col("_hit"), "deleted").otherwise(F.col("status"))).withColumn("updated_at", F.when(F.col("_hit"), F.lit(now).cast("timestamp")).otherwise(F.col("updated_at"))).drop("_hit")


def without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select("id").distinct(), "id", "left_anti")


def stale(canonical: DataFrame, now: str, params: StateParams = _P) -> DataFrame:
    """Active memories of low confidence that are old."""
    return canonical.where((F.col("status") == "active") & (F.col("confidence") < params.stale_confidence) & before(F.col("created_at"), now, days=params.stale_days))


def promotable(canonical: DataFrame, now: str, params: StateParams = _P) -> DataFrame:
    """Active events old enough to become facts."""
    return canonical.where((F.col("status") == "active") & (F.col("memory_type") == "event") & before(F.col("created_at"), now, days=params.promotion_days))


def cleaned(canonical: DataFrame, now: str, params: StateParams = _P) -> DataFrame:
    """Without rows ended longer than the retention."""
    old = F.col("status").isin("superseded", "deleted") & before(F.col("updated_at"), now, days=params.cleanup_days)
    return canonical.where(~F.coalesce(old, F.lit(False)))


def fresh_messages(messages: DataFrame, now: str, params: StateParams = _P) -> DataFrame:
    return messages.where(~before(F.col("created_at"), now, hours=params.session_timeout_hours))


def consolidation_due(canonical: DataFrame, log: DataFrame, params: StateParams = _P) -> DataFrame:
    """user_id, new_memories of users with enough active memories since their last completed run."""
    last = log.where("status = 'completed'").groupBy("user_id").agg(F.max("finished_at").alias("last_run"))
    rows = canonical.where("status = 'active'").join(last, "user_id", "left")
    fresh = F.count_if(F.col("last_run").isNull() | (F.col("created_at") > F.col("last_run")))
    return rows.groupBy("user_id").agg(fresh.alias("new_memories")).where(F.col("new_memories") >= params.consolidation_threshold)


def lineage(canonical: DataFrame, checkpoint) -> DataFrame:
    """id, ancestor, depth: what each memory supersedes or was consolidated from, all the way back."""
    step = canonical.select("id", F.explode(F.array_compact(F.concat(F.array("supersedes_memory_id"), F.coalesce("consolidated_from", F.array().cast("array<string>"))))).alias("ancestor")).distinct()
    out = checkpoint(step.withColumn("depth", F.lit(1)))
    size = out.count()
    while True:  # each round joins the paths found so far with each other: as many rounds as the longest has binary digits
        far = out.toDF("id", "via", "near").join(out.toDF("via", "ancestor", "further"), "via").select("id", "ancestor", (F.col("near") + F.col("further")).alias("depth"))
        out = checkpoint(out.unionByName(far).groupBy("id", "ancestor").agg(F.min("depth").alias("depth")))
        size, before = out.count(), size
        if size == before:
            return out


def budget_left(profiles: DataFrame, usage: DataFrame, now: str, default: int = _P.daily_budget) -> DataFrame:
    """user_id, used, remaining, daily_limit: today's use after the daily reset and the usage given, of known and new users."""
    today = F.to_date(F.lit(now).cast("timestamp"))
    used = F.when(F.to_date("budget_reset_at") < today, F.lit(0)).otherwise(F.coalesce("tokens_used_today", F.lit(0)))
    own = profiles.select("user_id", used.alias("_used"), F.coalesce("token_budget_daily", F.lit(default)).alias("_limit"))
    spent = usage.where("tokens > 0").groupBy("user_id").agg(F.sum("tokens").alias("_spent"))
    rows = own.join(spent, "user_id", "full_outer")
    total = F.coalesce("_used", F.lit(0)) + F.coalesce("_spent", F.lit(0))
    limit = F.coalesce("_limit", F.lit(default))
    return rows.select("user_id", total.cast("long").alias("used"), F.greatest(F.lit(0), limit - total).cast("long").alias("remaining"), limit.cast("long").alias("daily_limit"))


def usage_summary(calls: DataFrame) -> DataFrame:
    """operation, calls, input_tokens, output_tokens, duration_ms; an empty operation as unknown."""
    op = F.coalesce(F.nullif(F.col("operation"), F.lit("")), F.lit("unknown")).alias("operation")
    return calls.groupBy(op).agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("duration_ms").alias("duration_ms"))


def report(actions: DataFrame) -> DataFrame:
    """Counters of a consolidation run by user from its actions (user_id, kind, size, seconds, error)."""
    of = lambda kind, value: F.coalesce(F.sum(F.when(F.col("kind") == kind, value)), F.lit(0)).cast("int")
    return actions.groupBy("user_id").agg(
        of("scan", F.col("size")).alias("memories_scanned"), of("merge", F.col("size")).alias("memories_merged"), of("delete", F.lit(1)).alias("memories_deleted"),
        of("abstract", F.lit(1)).alias("memories_abstracted"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("duration_seconds"), F.array_compact(F.collect_list("error")).alias("errors"),
    )


def key_hash(api_key):
    return F.sha2(api_key, 256)


def verified_keys(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """requests (api_key) with the user of each key that is not revoked."""
    return requests.withColumn("key_hash", key_hash(F.col("api_key"))).join(keys.where("revoked_at is null").select("key_hash", "user_id"), "key_hash", "left").drop("key_hash")


def users_like(rows: DataFrame, pattern: str) -> DataFrame:
    """rows of the users whose id is LIKE pattern."""
    return rows.where(F.col("user_id").like(pattern))


def all_users(tables: dict[str, DataFrame]) -> DataFrame:
    """The distinct user_id of all tables; each table gives its own distinct ones first."""
    return reduce(DataFrame.union, [t.select("user_id").where("user_id is not null").distinct() for t in tables.values()]).distinct()


def counts_by_user(tables: dict[str, DataFrame]) -> DataFrame:
    """user_id and the number of its rows in each table, as column; one shuffle of partial counts."""
    parts = [t.groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", F.lit(name).alias("name"), "n") for name, t in tables.items()]
    total = [F.coalesce(F.sum(F.when(F.col("name") == name, F.col("n"))), F.lit(0)).cast("long").alias(name) for name in tables]
    return reduce(DataFrame.union, parts).groupBy("user_id").agg(*total)


def reset_user(tables: dict[str, DataFrame], profiles: DataFrame, user_id: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """All tables without a user's rows, and the profiles with its use at zero."""
    kept = {name: t.where(F.coalesce(F.col("user_id") != user_id, F.lit(True))) for name, t in tables.items()}
    return kept, profiles.withColumn("tokens_used_today", F.when(F.col("user_id") == user_id, F.lit(0)).otherwise(F.col("tokens_used_today")))


def recorded_usage(profiles: DataFrame, usage: DataFrame, now: str, default: int = _P.daily_budget) -> DataFrame:
    """The next profiles (user_id, tokens_used_today, token_budget_daily, budget_reset_at) after usage (user_id, tokens).

    A counter of another day starts anew; users without a profile get one; use of zero or less leaves no trace.
    """
    at = F.lit(now).cast("timestamp")
    spent = usage.where("tokens > 0").groupBy("user_id").agg(F.sum("tokens").alias("_spent"))
    own = profiles.select("user_id", F.col("tokens_used_today").alias("_used"), F.col("token_budget_daily").alias("_budget"), F.col("budget_reset_at").alias("_reset"))
    rows = own.join(spent, "user_id", "full_outer")
    fresh = F.coalesce(F.to_date("_reset") >= F.to_date(at), F.lit(False))
    touched = F.col("_spent").isNotNull()
    used = F.when(touched, F.when(fresh, F.coalesce("_used", F.lit(0))).otherwise(F.lit(0)) + F.col("_spent")).otherwise(F.col("_used"))
    return rows.select("user_id", used.cast("long").alias("tokens_used_today"), F.coalesce("_budget", F.lit(default)).cast("long").alias("token_budget_daily"), F.when(touched & ~fresh, at).otherwise(F.col("_reset")).alias("budget_reset_at"))


def storable(memories: DataFrame, budgets: DataFrame, params: StateParams = _P) -> DataFrame:
    """memories (user_id, confidence) with outcome: over_budget, unsure or store. budgets: user_id, remaining (budget_left);
    a user without one has its whole budget."""
    rows = memories.join(budgets.select("user_id", "remaining"), "user_id", "left")
    return rows.withColumn("outcome", F.when(F.col("remaining") <= 0, "over_budget").when(F.coalesce("confidence", F.lit(0.8)) < params.min_confidence, "unsure").otherwise("store")).drop("remaining")


def started_session(messages: DataFrame, starts: DataFrame, now: str, params: StateParams = _P) -> DataFrame:
    """messages after the sessions `starts` (user_id, session_id) begin: their own old messages go, and those of the
    users' other sessions that are older than the timeout."""
    begun = starts.select("user_id", F.col("session_id").alias("_session")).distinct()
    rows = messages.join(begun, "user_id", "left")
    gone = F.col("_session").isNotNull() & ((F.col("session_id") == F.col("_session")) | before(F.col("created_at"), now, hours=params.session_timeout_hours))
    return rows.where(~F.coalesce(gone, F.lit(False))).drop("_session")


def session_rest(messages: DataFrame, keys: list[str], order: str, every: int = _P.drain_every) -> DataFrame:
    """The messages of each session that no drain has taken when it ends: those after its last full `every`."""
    w = Window.partitionBy(*keys)
    n, size = F.row_number().over(w.orderBy(order)), F.count("*").over(w)
    return messages.withColumn("_n", n).withColumn("_size", size).where(F.col("_n") > F.col("_size") - F.col("_size") % every).drop("_n", "_size")


def metadata_merged(old, new):
    """A JSON object with the members of another; of both the new one. Null and what is no object count as empty."""
    members = lambda c: F.coalesce(F.map_entries(F.try_parse_json(F.when(F.trim(c).startswith("{"), c)).cast("map<string,variant>")), F.expr("cast(array() as array<struct<key:string,value:variant>>)"))
    a, b = members(old), members(new)
    mine = F.filter(a, lambda x: ~F.array_contains(F.transform(b, lambda y: y["key"]), x["key"]))
    return F.to_json(F.map_from_entries(F.concat(mine, b)))


def with_provenance(rows: DataFrame, now: str, minutes: int, session_id: str) -> DataFrame:
    """rows whose metadata names their session, where they were created in the last `minutes`."""
    fresh = ~before(F.col("created_at"), now, hours=minutes / 60) & (F.col("created_at") <= F.lit(now).cast("timestamp"))
    stamp = F.to_json(F.struct(F.lit(session_id).alias("source_session_id")))
    return rows.withColumn("metadata", F.when(fresh, metadata_merged(F.col("metadata"), stamp)).otherwise(F.col("metadata")))
