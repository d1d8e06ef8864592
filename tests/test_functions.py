import math

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import json as js
from palimpsest.functions import sets, text, time, vector


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("given, want", [("Hello World 123", ["hello", "world", "123"]), ("hello-world_test!", ["hello", "world_test"]), ("", []), (None, [])])
def test_tokens(spark, given, want):
    assert one(spark, text.tokens(F.lit(given).cast("string"))) == want


@pytest.mark.parametrize("given, want", [("", 0), ("hi", 1), ("hello world, this is a test", 6), (None, 0)])
def test_estimated_tokens(spark, given, want):
    assert one(spark, text.estimated_tokens(F.lit(given).cast("string"))) == want


def test_normalise_any_white_space(spark):
    assert one(spark, text.normalise(F.lit("  a   b　c \n"))) == "a b c"


@pytest.mark.parametrize("given, want", [("Profile Favorite-Food", "profile_favorite_food"), ("a..b...c", "a.b.c"), ("café!", "café"), (" a \t- b ", "a_b")])
def test_memory_key(spark, given, want):
    assert one(spark, text.memory_key(F.lit(given))) == want
    assert js.key_of(given) == want


@pytest.mark.parametrize("given, want", [("ok", True), ("Thank you!", True), ("ok?", False), ("I like okra", False), ("got it.", True)])
def test_low_information(spark, given, want):
    assert one(spark, text.is_low_information(F.lit(given))) is want


def test_query_keywords(spark):
    words = one(spark, text.query_keywords(F.lit("what is my favorite sushi restaurant in Tokyo, room 42?")))
    assert words == ["favorite", "sushi", "restaurant", "tokyo", "room"]
    assert one(spark, text.query_keywords(F.lit("东京寿司"))) == ["东", "京", "寿", "司", "东京", "京寿", "寿司"]


def test_match_query(spark):
    assert one(spark, text.match_query(F.lit("hello world"))) == "hello & world"
    assert one(spark, text.match_query(F.lit(""))) is None


def test_names_and_quotes(spark):
    assert one(spark, text.names_and_quotes(F.lit("met Ada Lovelace and 'the cat' at \"Bar 9\""))) == ["ada lovelace", "the cat", "bar 9"]


def test_chunks(spark):
    got = one(spark, text.chunks(F.lit("x" * 4000), 1600, 120))
    assert [len(c) for c in got] == [1600, 1600, 1040]
    assert one(spark, text.chunks(F.lit("abc"), 1600, 120)) == ["abc"]
    assert one(spark, text.chunks(F.lit(""), 1600, 120)) == []


def test_line_scores(spark):
    got = one(spark, text.line_scores(F.lit("Where is the cat"), F.lit("Session: 1\nuser: A cat sat. Nothing.\n\nThe cat.")))
    assert [(r["score"], r["line"]) for r in got] == [(1, "A cat sat."), (0, "Nothing."), (2, "The cat.")]


@pytest.mark.parametrize("a, b, want", [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0], [-1.0], -1.0), ([0.0, 0.0], [1.0, 1.0], 0.0), ([3.0, 4.0, 0.0], [3.0, 4.0], 1.0)])
def test_cosine(spark, a, b, want):
    assert one(spark, vector.cosine(F.lit(a), F.lit(b))) == pytest.approx(want)


def test_vector_shapes(spark):
    assert one(spark, vector.normalised(F.lit([3.0, float("nan"), 4.0]))) == pytest.approx([0.6, 0, 0.8])
    assert one(spark, vector.resized(F.lit([3.0, 4.0, 5.0]), 2)) == pytest.approx([0.6, 0.8])
    assert one(spark, vector.resized(F.lit([1.0]), 3)) == [1.0, 0.0, 0.0]
    assert one(spark, vector.clamped(F.lit(float("nan")))) == 0
    with pytest.raises(Exception, match="dimensions"):
        one(spark, vector.strict_cosine(F.lit([1.0]), F.lit([1.0, 2.0])))


@pytest.mark.parametrize("a, b, want", [(["a", "b", "c"], ["b", "c", "d"], 0.5), ([], [], 1.0), (["a"], [], 0.0)])
def test_jaccard(spark, a, b, want):
    cast = lambda x: F.lit(x).cast("array<string>") if x else F.array().cast("array<string>")
    assert spark.range(1).select(sets.jaccard(cast(a), cast(b)).alias("x")).first()["x"] == want


def test_decay(spark):
    at = lambda d: one(spark, time.decay(F.lit(d).cast("timestamp"), "2024-01-31 00:00:00", 30))
    assert at("2024-01-31 00:00:00") == 1.0
    assert at("2024-01-01 00:00:00") == pytest.approx(0.5)
    assert at(None) == 1.0
    assert at("2025-01-01 00:00:00") == 1.0
    assert one(spark, time.decay(F.lit("2020-01-01").cast("timestamp"), "2024-01-01", math.inf)) == 1.0


@pytest.mark.parametrize("given, want", [("2026-01-15", True), ("2026-01-15T10:30:00Z", True), ("not a date", False), ("", False)])
def test_iso_time(spark, given, want):
    assert (one(spark, time.iso_time(F.lit(given))) is not None) is want


def test_json_replies():
    assert js.parse_object('```json\n{"a": 1}\n```') == {"a": 1}
    assert js.parse_object("[1]") is None
    assert js.first_object('noise {bad} {"a": "}"} more') == {"a": "}"}
    assert js.as_text([" a ", None, ["b"]]) == "a b"
    assert js.as_text({"b": 1, "a": 2}) == '{"a": 2, "b": 1}'
    got = js.memories('[{"content": "x", "confidence": 5, "memory_type": "odd", "memory_key": "My Key"}, 3, {"content": " "}]')
    assert [(m["content"], m["confidence"], m["memory_type"], m["memory_key"], m["value"]) for m in got] == [("x", 1.0, "fact", "my_key", "x")]
    assert js.memories("no json") == []


def test_answer_replies():
    assert js.answer("nothing")["abstain"] is True
    got = js.answer('so: {"answer": "a", "evidence": [], "confidence": "2", "abstain": false}')
    assert got["valid"] and got["abstain"] and got["confidence"] == 1.0 and got["abstain_reason"]
