import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from palimpsest import schemas
from palimpsest.operators import answer, evaluate, hooks, ingest, retrieval, state, windows
from palimpsest.params import SearchParams, SensoryParams, StateParams
from palimpsest.plans import catalogue

NOW = "2024-02-01 00:00:00"
SF = "/root/testdata/sf0.01"


def test_quotas():
    assert SearchParams(max_results=10).quotas(["canonical", "episodic"]) == {"canonical": 6, "episodic": 4}
    assert SearchParams(max_results=1).quotas(["canonical", "episodic"]) == {"canonical": 1, "episodic": 1}
    assert SearchParams(max_results=7).quotas(["episodic"]) == {"episodic": 7}
    with pytest.raises(ValueError):
        SearchParams(max_results=0)


def test_hybrid_merge(spark):
    v = spark.createDataFrame([("a", "va", 0.9), ("b", "vb", 0.9)], "id string, text string, vector_score double")
    k = spark.createDataFrame([("b", "kb", 0.8), ("c", "kc", 0.8)], "id string, text string, text_score double")
    got = {r["id"]: (r["text"], round(r["score"], 4)) for r in retrieval.hybrid_merge(v, k).collect()}
    assert got == {"a": ("va", 0.63), "b": ("vb", 0.87), "c": ("kc", 0.24)}


def test_diverse_order_prefers_unlike_texts():
    assert retrieval.diverse_order([0.5, 0.9], ["a", "b"], 1.0) == [1, 0]
    assert retrieval.diverse_order([1.0, 0.95, 0.5], ["cat sat", "cat sat", "dog ran"], 0.5) == [0, 2, 1]
    assert retrieval.distinct_order(["a b", "b a", "c", "", ""], 0.85) == [0, 2, 3]


def test_keyword_topk_ranks_by_whole_scores_as_its_sql(spark, tmp_path):
    texts = {i: "red red tea tea" for i in range(1, 6)} | {9: "red" + 5 * " tea", 12: "red"}  # (1/2 + 5/6) / 2 is above (2/3 + 2/3) / 2 by the last bit
    spark.createDataFrame([(i, "src1", t, "en") for i, t in texts.items()], "doc_id long, source string, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "Red tea!")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = sorted(tuple(r) for r in catalogue.keyword_topk(spark, str(tmp_path)).select("query_id", "id", "text_score").collect())
    assert [i for _, i, _ in got] == [1, 2, 3, 4, 9]
    assert got == sorted(c.execute(catalogue.ORACLE_SQL["keyword_topk"]).fetchall())


def test_similar_pairs_equal_brute_force(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 9))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("g", F.lit(1))
    got = {(r["a"], r["b"]) for r in retrieval.similar_pairs(rows, 0.8, "g").collect()}
    sets = [frozenset(t.split()) for t in texts]
    want = {(i, j) for i, j in itertools.combinations(range(60), 2) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    empty = [i for i in range(60) if not sets[i]]
    assert got == want | set(zip(empty, empty[1:]))


def test_similar_pairs_shuffle_less_than_the_texts(spark):
    rng = random.Random(6)
    texts = [" ".join(f"{w:030x}" for w in rng.sample(range(20000), 300)) for _ in range(300)]
    texts += [t + " more" for t in texts[:9]]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("g", F.lit("g"))
    written = lambda: sum(e.totalShuffleWrite() for e in [spark._jsc.sc().statusStore().executorList(False).apply(0)])
    before = written()
    got = {(r["a"], r["b"]) for r in retrieval.similar_pairs(rows, 0.85, "g", cut=lambda df: df.checkpoint()).collect()}
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    assert got == {(i, 300 + i) for i in range(9)} and 0 < written() - before < sum(map(len, texts)) / 2


def test_token_counts_reach_the_driver_as_no_rows(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g h"), (3, "x y z"), (4, "")], "id long, text string").withColumn("g", F.lit("g"))
    frame = type(rows)
    plain = frame.toPandas
    monkeypatch.setattr(frame, "toPandas", lambda df: pytest.fail("a row for each bucket of tokens") if "f" in df.columns else plain(df))
    kept = retrieval.distinct_contents(rows, "g", lambda df: df.checkpoint())
    assert {r["id"] for r in kept.collect()} == {1, 3, 4}


def test_distinct_contents_shuffle_less_than_the_texts(spark):
    rng = random.Random(7)
    texts = [" ".join(f"{w:030x}" for w in rng.sample(range(20000), 300)) for _ in range(300)]
    texts += [t + " more" for t in texts[:9]]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("g", F.lit("g"))
    written = lambda: spark._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    got = {r["id"] for r in retrieval.distinct_contents(rows, "g", lambda df: df.checkpoint()).collect()}
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    assert got == set(range(300)) and 0 < written() - before < sum(map(len, texts)) / 2


def test_trim_equals_removal_one_by_one(spark):
    rng = random.Random(1)
    rows = [(s, t, rng.choice(["user", "system", "assistant"]), "x" * rng.randint(1, 60)) for s in range(60) for t in range(rng.randint(1, 7))]
    got = windows.trimmed(spark.createDataFrame(rows, "s long, turn long, role string, content string"), ["s"], "turn", 20)
    got = {(r["s"], r["turn"]) for r in got.collect()}
    want = set()
    for s, own in itertools.groupby(rows, key=lambda r: r[0]):
        own = list(own)
        while sum(max(1, len(r[3]) // 4) for r in own) > 20 and len(own) > 1:
            own.pop(1 if own[0][2] == "system" else 0)
        want |= {(s, r[1]) for r in own}
    assert got == want


def test_working_windows(spark):
    rows = spark.createDataFrame([("s", i, "user", "" if i == 1 else f"m{i}") for i in range(4)], "s string, turn long, role string, content string")
    assert [r["turn"] for r in windows.recent(rows, ["s"], "turn", 2).orderBy("turn").collect()] == [2, 3]
    assert [round(r["score"], 2) for r in windows.recency_scores(rows, ["s"], "turn").orderBy("turn").collect()] == [0.3, 0.5, 0.6]
    assert [(r["drain"], r["is_drain"]) for r in windows.drains(rows, ["s"], "turn", 3).orderBy("turn").collect()] == [(1, False), (1, False), (1, True), (2, False)]


def test_rate_limit():
    assert windows.accepted([0, 1, 2, 3, 61.5], 3) == [True, True, True, False, True]
    assert windows.accepted([0, 60], 1) == [True, True]


def test_balanced_sample(spark):
    rows = spark.createDataFrame([("a", i) for i in range(10)] + [("b", i) for i in range(2)], "kind string, n long")
    got = windows.balanced_sample(rows, "kind", "n", 6).groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in got} == {"a": 4, "b": 2}


def test_compress():
    assert ingest.compress("short", 100) == "short"
    assert ingest.compress("anything", 0) == ""
    text = "First one here. " + "Filler words again and again. " * 6 + "Rare zebra quartz. Last one."
    got = ingest.compress(text, 80)
    assert got.startswith("First one here.") and got.endswith("Last one.") and len(got) <= 80
    assert " ... " in ingest.compress("x" * 300, 100)


def test_compress_messages_breaks_ties_as_its_sql(spark, tmp_path):
    text = (
        "Erhe tith thlyhe aneare ntonnt en aningre ththshnt heth atorst ndtier. Erthin andountin it annd nderwh ernt attionst reshwhnd thstea eroren"
        " bleenor thha nd of oner oringin ndsh by reanwh of reth. To and of heorea and on ertier, anshenou ster ly thoren as, onnt, the ingou thatinat"
        " esha as to the inantiesnt. Thre the anat thin nd th the atesble."
    )  # the weights of the sentences between differ by how the sum is corrected
    spark.createDataFrame([(1, 0, text)], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    c = duckdb.connect()
    c.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    got = [tuple(r) for r in catalogue.compress_messages(spark, str(tmp_path)).select("conv_id", "turn", "content").collect()]
    assert got == c.execute(catalogue.ORACLE_SQL["compress_messages"]).fetchall()


def test_topics():
    words = lambda w: " ".join([w] * 60)
    p = SensoryParams(topic_token_threshold=64)
    assert ingest.topic_numbers([words("Alpha one"), words("Beta two")], p) == [1, 2]
    assert ingest.topic_numbers(["a", "b"], p) == [1, 1]


def test_prepared(spark):
    rows = spark.createDataFrame([("s", 0, "User", " I live in  Rome. "), ("s", 1, "assistant", "ok"), ("s", 2, None, "")], "s string, turn long, role string, content string")
    assert [(r["role"], r["content"]) for r in ingest.prepared(rows, ["s"], "turn").collect()] == [("user", "I live in Rome.")]


@pytest.mark.parametrize(
    "candidate, existing, similar, want",
    [
        ({}, None, False, "ADD"),
        ({}, None, True, "NOOP"),
        ({"event_time": 2}, {"event_time": 1}, False, "SUPERSEDE"),
        ({"event_time": 1}, {"event_time": 2}, False, "NOOP"),
        ({"confidence": 0.9, "event_time": 1}, {"confidence": None, "event_time": 1}, False, "SUPERSEDE"),
        ({"confidence": 0.5}, {"confidence": 0.8}, False, "NOOP"),
        ({"value": "a"}, {"value": "a"}, False, "NOOP"),
        ({"value": "a"}, {"value": "b"}, False, "UPDATE"),
    ],
)
def test_rules_by_row_and_by_join(spark, candidate, existing, similar, want):
    assert state.rule_action(candidate, existing, similar)[0] == want
    row = lambda d: ("u", "k", d.get("value"), d.get("confidence"), d.get("event_time"))
    schema = "user_id string, memory_key string, value string, confidence double, event_time long"
    c = spark.createDataFrame([(*row(candidate), similar)], schema + ", similar boolean").withColumn("event_time", F.timestamp_seconds("event_time"))
    e = spark.createDataFrame([(*row(existing), "active", "1")] if existing is not None else [], schema + ", status string, id string").withColumn("event_time", F.timestamp_seconds("event_time"))
    assert state.resolved(c, e).first()["action"] == want


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40)], "a long, b long")
    got = {r["id"]: r["component"] for r in state.components(edges, lambda df: df.checkpoint()).collect()}
    assert got == {i: 0 for i in range(21)} | {40: 40, 50: 40}


def test_similar_vectors_in_blocks(spark):
    rng = random.Random(2)
    rows = [(i, 1, [rng.gauss(0, 1) for _ in range(3)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, g long, embedding array<float>")
    got = {(r["a"], r["b"]) for r in state.similar_pairs(df, "g", 0.9, block=7).collect()}
    cos = lambda x, y: sum(a * b for a, b in zip(x, y)) / (sum(a * a for a in x) * sum(b * b for b in y)) ** 0.5
    assert got == {(i, j) for i, j in itertools.combinations(range(40), 2) if cos(rows[i][2], rows[j][2]) >= 0.9}


def test_snapshots(spark):
    rows = [(str(i), "u", f"k{i}", "v", "fact", 0.5, "active") for i in range(3)]
    c = spark.createDataFrame(rows, "id string, user_id string, memory_key string, value string, memory_type string, confidence double, status string")
    c = schemas.empty(spark, "canonical_memories").unionByName(c.withColumn("created_at", F.lit("2023-01-01").cast("timestamp")), allowMissingColumns=True)
    actions = spark.createDataFrame([("u", "k0", "new", "fact", 0.9, "SUPERSEDE", "0", "n0"), ("u", "k1", "upd", "fact", 0.7, "UPDATE", "1", "n1"), ("u", "", "add", "fact", None, "ADD", None, "n2")], "user_id string, memory_key string, value string, memory_type string, confidence double, action string, existing_id string, new_id string")
    actions = actions.withColumn("event_time", F.lit(None).cast("timestamp")).withColumn("embedding", F.lit(None).cast("array<float>"))
    new = state.applied(c, actions, NOW)
    got = {r["id"]: (r["value"], r["status"], r["supersedes_memory_id"], r["confidence"]) for r in new.collect()}
    assert got == {"0": ("v", "superseded", None, 0.5), "1": ("upd", "active", None, 0.7), "2": ("v", "active", None, 0.5), "n0": ("new", "active", "0", 0.9), "n2": ("add", "active", None, 0.8)}
    assert state.duplicate_keys(new).count() == 0
    assert {r["id"] for r in state.stale(c, NOW).collect()} == {"0", "1", "2"}
    assert state.lineage(new, lambda df: df.checkpoint()).count() == 1
    assert state.consolidation_due(c, schemas.empty(spark, "consolidation_log"), StateParams(consolidation_threshold=3)).first()["new_memories"] == 3


def test_budget(spark):
    profiles = spark.createDataFrame([("a", 50, 100, "2024-01-31"), ("b", 50, 100, "2024-02-01")], "user_id string, tokens_used_today int, token_budget_daily int, reset string").withColumn("budget_reset_at", F.col("reset").cast("timestamp"))
    usage = spark.createDataFrame([("a", 30), ("b", 80), ("c", 5), ("c", -1)], "user_id string, tokens int")
    got = {r["user_id"]: (r["used"], r["remaining"]) for r in state.budget_left(profiles, usage, NOW, 10).collect()}
    assert got == {"a": (30, 70), "b": (130, 0), "c": (5, 5)}


def test_memory_view(spark):
    assert schemas.memory_view(schemas.empty(spark, "canonical_memories"), "canonical").columns[2] == "text"
    with pytest.raises(ValueError):
        schemas.memory_view(schemas.empty(spark, "canonical_memories"), "other")


def test_metrics(spark):
    df = spark.createDataFrame([("The cat, sat!", "cat sat"), ("a b b", "b c"), ("", "")], "p string, a string")
    got = evaluate.answer_scores(df, "p", "a").collect()
    assert [r["exact_match"] for r in got] == [1.0, 0.0, 1.0]
    assert [r["f1"] for r in got] == pytest.approx([1.0, 0.5, 1.0])


def test_answers():
    items = [{"id": "m1", "text": "user: I moved to Rome in May.\nassistant: Nice.", "score": 0.9}, {"id": "m2", "text": "Cats.", "score": 0.8}]
    good = '{"answer": "Rome", "evidence": [{"memory_id": "m1", "quote": "q", "reason": "r"}], "confidence": 0.9, "abstain": false}'
    abstain = '{"answer": "", "evidence": [], "confidence": 0, "abstain": true}'
    replies = iter([abstain, good])
    assert answer.generate("where did I move", items, lambda p: next(replies))["answer"] == "Rome"
    assert answer.generate("where did I move to Rome", items, lambda p: "bad")["answer"] == "I moved to Rome in May."
    assert answer.generate("q", [], lambda p: good)["abstain"] and answer.generate("q", items, None)["abstain"]
    assert answer.generate("q", items, lambda p: 1 / 0)["abstain"]
    assert [x["id"] for x in answer.rerank("q", items, lambda p: '[{"index": 0, "score": 0.1}, {"index": 1, "score": 0.9}]')] == ["m2", "m1"]
    assert answer.rerank("q", items, lambda p: "bad") == items
    assert answer.conflict_actions({"content": "x"}, [{"id": "1", "text": "y"}], lambda p: '[{"action": "UPDATE", "memory_id": "9"}]')[0]["action"] == "ADD"
    assert answer.merge_reply(["a"], lambda p: '{"action": "keep"}') is None


def test_hooks(spark):
    e = hooks.HashEmbedder()
    assert e.embed_query("")[0] == 1.0 and sum(x * x for x in e.embed_query("some words")) == pytest.approx(1)
    assert len(hooks.Resized(e, 20).embed_query("a")) == 20
    rows = hooks.embedded(spark.createDataFrame([(1, "a"), (2, None)], "id long, text string"), "text", hooks.HashEmbedder)
    assert all(len(r["embedding"]) == 16 for r in rows.collect())
    tracker = hooks.UsageTracker(lambda p: "12345678")
    tracker.with_operation("answer")("1234")
    assert tracker.calls[0].operation == "answer" and tracker.total_tokens == 3
    with pytest.raises(ValueError):
        hooks.create_embedder("none")
    with pytest.raises(ValueError):
        hooks.models(None, odd=len)


def test_extracted(spark):
    rows = spark.createDataFrame([("s", 0, "user", "I like tea")], "s string, turn long, role string, content string")
    got = ingest.extracted(rows, ["s"], "turn", lambda c: '[{"content": "' + c + '", "memory_type": "preference"}]').collect()
    assert [(r["s"], r["content"], r["memory_type"]) for r in got] == [("s", "user: I like tea", "preference")]


def test_content_dedup_of_whole_sources_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("source", "doc_id", "text").collect()
    got = sorted((r["query_id"], r["position"], r["id"]) for r in catalogue.content_dedup(spark, SF).collect())
    want = []
    for source in {r["source"] for r in docs}:
        own = sorted((r["doc_id"], r["text"]) for r in docs if r["source"] == source)
        want += [(source, n, own[i][0]) for n, i in enumerate(retrieval.distinct_order([t for _, t in own], 0.85))]
    assert got == sorted(want)


def test_distinct_contents_of_large_groups_and_chains(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[i : i + 20]) for i in range(40)]  # each like its neighbour (19 of 21 words), not like the third
    texts += [None, "", "...", *[f"copy of {i} words" for i in range(3)], *["copy of 0 words"] * 40, " ".join(words[:20]) + " w5"]
    rows = [(g, 100 * g + i, t) for g in range(2) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "g long, id long, text string")
    got = {(r["grp"], r["id"]) for r in retrieval.distinct_contents(df, "g", lambda x: x.checkpoint()).collect()}
    assert got == {(g, 100 * g + i) for g in range(2) for i in retrieval.distinct_order(texts, 0.85)} and len(got) < 2 * 40


def test_mmr_takes_the_overfetched_candidates(spark):
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    cos = lambda x, y: sum(a * b for a, b in zip(x, y)) / (sum(a * a for a in x) ** 0.5 * sum(b * b for b in y) ** 0.5)
    want = []
    for q, label, v in rows:
        if q % 100 == 0:
            best = sorted((-cos(v, e), i) for i, other, e in rows if other == label)[:30]
            order = retrieval.diverse_order([-s for s, _ in best], [docs.get(i) or f"memory {i}" for _, i in best], 0.7)
            want += [(q, n, best[k][1]) for n, k in enumerate(order)]
    assert sorted((r["query_id"], r["position"], r["id"]) for r in catalogue.mmr(spark, SF).collect()) == sorted(want)


def test_searches_of_all_queries_in_blocks(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(3)]) for i in range(90)] + [(90, None)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    asked = df.where("id % 10 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    got = {(r["query_id"], r["id"]) for r in retrieval.vector_search_all(df, asked, 7, block=4).collect()}
    norm = lambda x: sum(a * a for a in x) ** 0.5
    cos = lambda x, y: round(sum(a * b for a, b in zip(x, y)) / (norm(x) * norm(y)), 12) if norm(x) * norm(y) else 0.0
    assert {q for q, _ in got} == set(range(0, 90, 10))
    for q in range(0, 90, 10):
        best = sorted((-cos(rows[q][1], v), i) for i, v in rows[:90])
        own = [next(s for s, j in best if j == i) for a, i in got if a == q]
        assert sorted(own) == [s for s, _ in best[:7]]
