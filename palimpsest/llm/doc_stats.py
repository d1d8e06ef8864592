"""Counts and ratios of a block of documents, by numpy over its bytes."""

from __future__ import annotations

import numpy as np

from .tokens import SPACED, U, Words, grams, mix, words

_LINES = np.ones(256, bool), np.arange(256, dtype=np.uint8)
_LINES[0][10] = False


def _table(*chars: int) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_SYMBOLS = _table(*b"#*$%&|<>")
_UPPER = _table(*range(65, 91))
_DIGITS = _table(*range(48, 58))
_ENDS = _table(*b".!?")
_MARKS = _table(*b"!?")
_TAIL = _table(*range(0x80, 0xC0))  # bytes that continue a code point


def _per_doc(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.searchsorted(positions, offsets)).astype(np.int64)


def _distinct(docs: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of each document."""
    key = np.unique(mix(docs.astype(U) * U(0x9E3779B97F4A7C15)) ^ hashes, return_index=True)[1]
    return np.bincount(docs[key], minlength=n)[:n]


def base_counts(offsets: np.ndarray, data: np.ndarray, w: Words) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    n = len(offsets) - 1
    spans = w.ends - w.starts
    tails = np.concatenate(([0], np.cumsum(_TAIL[data])))
    chars = np.concatenate(([0], np.cumsum(spans - (tails[w.ends] - tails[w.starts]))))
    lines = words(offsets, data, _LINES)
    first_word = np.searchsorted(w.starts, lines.starts)
    worded = first_word < len(w.starts)
    worded[worded] = w.starts[first_word[worded]] < lines.ends[worded]
    line_docs = lines.docs[worded]
    repeat = np.zeros(n, np.int64)
    if len(w.hashes) >= 3:
        inside = w.docs[:-2] == w.docs[2:]
        at = np.flatnonzero(inside)
        key = mix(w.docs[at].astype(U) * U(0x9E3779B97F4A7C15)) ^ grams(w.hashes, 3)[at]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(at), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        cover = np.zeros(len(w.hashes), bool)
        for k in range(3):
            cover[at[again] + k] = True
        repeat = np.bincount(w.docs[cover], minlength=n)[:n]
    return {
        "n_words": np.diff(w.first),
        "word_chars": np.diff(chars[w.first]),
        "n_symbols": _per_doc(np.flatnonzero(_SYMBOLS[data]), offsets),
        "n_dup_lines": np.bincount(line_docs, minlength=n)[:n] - _distinct(line_docs, lines.hashes[worded], n),
        "n_repeat_words": repeat.astype(np.int64),
        "_n_lines": np.bincount(line_docs, minlength=n)[:n],
    }


#: Ratios that a quality model reads.
RATIOS = ["log_words", "word_length", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "digit_ratio", "mark_ratio", "distinct_ratio", "words_a_sentence", "words_a_line", "symbol_words"]


def ratios(offsets: np.ndarray, data: np.ndarray, w: Words | None = None, base: dict[str, np.ndarray] | None = None) -> np.ndarray:
    """A row of RATIOS a document; a text without words gives zeros."""
    w = w or words(offsets, data, SPACED)
    base = base or base_counts(offsets, data, w)
    n = len(offsets) - 1
    count = lambda t: _per_doc(np.flatnonzero(t[data]), offsets)
    n_words, n_chars = np.maximum(base["n_words"], 1), np.maximum(base["word_chars"], 1)
    marked = np.zeros(n, np.int64)
    if len(w.starts):
        cum = np.concatenate(([0], np.cumsum(_SYMBOLS[data])))
        has = (cum[w.ends] - cum[w.starts]) > 0
        marked = np.bincount(w.docs[has], minlength=n)[:n]
    return np.column_stack([
        np.log1p(base["n_words"]),
        base["word_chars"] / n_words,
        base["n_symbols"] / n_chars,
        base["n_dup_lines"] / np.maximum(base["_n_lines"], 1),
        base["n_repeat_words"] / n_words,
        count(_UPPER) / n_chars,
        count(_DIGITS) / n_chars,
        count(_MARKS) / n_words,
        _distinct(w.docs, w.hashes, n) / n_words,
        n_words / (count(_ENDS) + 1),
        n_words / np.maximum(base["_n_lines"], 1),
        marked / n_words,
    ]) * (base["n_words"] > 0)[:, None]
