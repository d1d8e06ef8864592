"""Words, shingles and their 64-bit hashes over whole blocks of UTF-8 text with numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _word_table(separators: list[int], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    is_word = np.ones(256, bool)
    is_word[separators] = False
    as_read = np.arange(256, dtype=np.uint8)
    if lower:
        as_read[65:91] += 32
    return is_word, as_read


#: Words [^\x20\x09-\x0D]+ as written, and the same with A-Z lower-cased.
SPACED = _word_table([0x20, *range(0x09, 0x0E)], False)
SPACED_LOWER = _word_table([0x20, *range(0x09, 0x0E)], True)
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lower-cased.
ALNUM_LOWER = _word_table([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)], True)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = np.asarray(x, U)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverse modulo 2**64 for i < n."""
    if len(_POWERS[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, b, U)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """h with h[j] - h[i] = sum of (data[x] + 1) * _BASE**x for i <= x < j."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=out[1:])
    return out


def spans(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each data[start:end], the same wherever the bytes stand."""
    _, down = powers(len(prefix) + 1)
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U))


@dataclass
class Words:
    """The words of some documents, in order: byte spans, document numbers, hashes and each document's range."""

    starts: np.ndarray
    ends: np.ndarray
    docs: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # words of document d are first[d]:first[d + 1]
    data: np.ndarray  # the bytes as read (lower-cased if so asked)


def words(offsets: np.ndarray, data: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> Words:
    is_word, as_read = table
    n = len(offsets) - 1
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(0, U), np.zeros(n + 1, np.int64), data)
    data = as_read[data]
    inside = is_word[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(starts, offsets).astype(np.int64)
    docs = np.repeat(np.arange(n), np.diff(first))
    return Words(starts, ends, docs, spans(prefix_hashes(data), starts, ends), first, data)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; len(hashes) - k + 1 of them (those that cross documents are the caller's to drop)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for i in range(k):
        out = out * U(0xD6E8FEB86659FD93) + hashes[i : i + n]
    return mix(out)


def shingle_sets(w: Words, k: int) -> list[np.ndarray]:
    """Each document's sorted distinct k-word shingles; a text of fewer words is one shingle, one without words none."""
    every, out = grams(w.hashes, k), []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= k:
            s = np.sort(every[a : b - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            whole = U(b - a)
            for h in w.hashes[a:b]:
                whole = U((int(whole) * 0xA0761D6478BD642F + int(h)) & 0xFFFFFFFFFFFFFFFF)
            out.append(mix(np.array([whole], U)))
        else:
            out.append(np.zeros(0, U))
    return out
