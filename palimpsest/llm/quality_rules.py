"""Quality rules: base counts of a text and a verdict of boosted trees over its statistics.

The forest is fitted on a bounded sample of labelled documents and may only reject more, never less, as symbols,
repeated lines, repeated words, capitals or exclamation marks grow (monotonic constraints).

Edge cases: a null or empty text has no words and fails the base rule; repeated rows are judged alike, each for
itself; without labels of both kinds the forest is a constant that accepts; columns of docs with the names of results are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .boosting import Forest, fit
from .doc_stats import RATIOS, base_counts, ratios
from .frames import map_text
from .labelled import SAMPLE_ROWS, sample
from .tokens import SPACED, words

#: The quality may only fall as these grow.
FALLING = ["symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "mark_ratio", "symbol_words"]
#: A text is rejected when good quality is less likely than this.
KEEP_FROM = 0.5
LEAST_WORDS = 50

FIELDS = [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
FIELDS += [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("quality", T.DoubleType())]


def fit_rules(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Forest:
    def make():
        return lambda offsets, data: {"ratios": list(ratios(offsets, data))}

    field = [T.StructField("ratios", T.ArrayType(T.DoubleType()))]
    got = map_text(sample(docs, labels, "quality", rows=rows), "text", field, make, keep=["doc_id", "label"]).toPandas()
    got = got.sort_values("doc_id", kind="stable")
    x = np.array(got["ratios"].tolist()).reshape(-1, len(RATIOS))
    return fit(x, got["label"].to_numpy(float), {RATIOS.index(f): -1 for f in FALLING})


def quality_rules(docs: DataFrame, forest: Forest, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (default: all), the base counts, base_failed, kept and the forest's quality."""

    def make():
        def work(offsets, data):
            w = words(offsets, data, SPACED)
            base = base_counts(offsets, data, w)
            quality = forest.predict(ratios(offsets, data, w, base))
            failed = (base["n_words"] < LEAST_WORDS) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
            return {k: v for k, v in base.items() if k[0] != "_"} | {"base_failed": failed, "kept": ~failed & (quality >= KEEP_FROM), "quality": quality}

        return work

    return map_text(docs, text_col, FIELDS, make, keep=keep)


def keep_good(docs: DataFrame, forest: Forest, text_col: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs."""
    judged = map_text(docs, text_col, [T.StructField("verdict of the rules", T.BooleanType())], _verdict(forest))
    return judged.where(F.col("`verdict of the rules`")).select(*[F.col(f"`{c}`") for c in docs.columns])


def _verdict(forest: Forest):
    def make():
        def work(offsets, data):
            w = words(offsets, data, SPACED)
            base = base_counts(offsets, data, w)
            failed = (base["n_words"] < LEAST_WORDS) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
            return {"verdict of the rules": ~failed & (forest.predict(ratios(offsets, data, w, base)) >= KEEP_FROM)}

        return work

    return make
