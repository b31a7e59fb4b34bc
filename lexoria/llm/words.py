"""Vectorised word and shingle hashing over Arrow string columns.

Words are the maximal runs outside space and U+0009..U+000D, with A-Z lower-cased. A word's hash
is a multilinear form of its bytes over 64-bit random odd multipliers, finished by a 64-bit mixer:
two different words collide with a chance of about 2**-57.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes between alphanumeric words: ASCII outside 0-9, A-Z and a-z. Other letters are words' bytes.
PUNCTUATION = np.ones(256, dtype=bool)
PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text whose words are hashed at once, about; the arrays in between take some 50 times that.
_AT_ONCE = 500_000


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def stream(n: int, seed: int = 0) -> np.ndarray:
    """n pseudo-random 64-bit words."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * _GOLD)


_POWERS = stream(1 << 10) | np.uint64(1)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = stream(1 << int(n - 1).bit_length()) | np.uint64(1)
    return _POWERS


def chunks(column: pa.Array, most_bytes: int = 4_000_000) -> Iterator[slice]:
    """Slices of a string column of about ``most_bytes`` each; a longer text stands alone."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    start = 0
    while start < len(column):
        end = int(np.searchsorted(off, off[start] + most_bytes, side="right")) - 1
        end = min(max(end, start + 1), len(column))
        yield slice(start, end)
        start = end


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    text = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return text, off - off[0]


def word_spans(text: np.ndarray, off: np.ndarray, separator: np.ndarray = _SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and how many each text has."""
    inside = ~separator[text]
    before = np.empty_like(inside)
    if len(inside):
        before[0] = False
        before[1:] = inside[:-1]
        before[off[:-1][off[:-1] < len(text)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    if len(inside):
        after[-1] = False
        after[:-1] = inside[1:]
        last = off[1:] - 1
        after[last[last >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    per = np.diff(np.searchsorted(starts, off))
    return starts, ends, per


def word_hashes(column: pa.Array, separator: np.ndarray = _SEPARATOR, beginning: int | None = None, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, words per text). beginning: only so many characters of each
    count; lower: whether A-Z count as a-z."""
    parts = [_word_hashes(column[part], separator, beginning, lower) for part in chunks(column, _AT_ONCE)]
    if len(parts) == 1:
        return parts[0]
    return np.concatenate([np.zeros(0, np.uint64), *(h for h, _ in parts)]), np.concatenate([np.zeros(0, np.int64), *(per for _, per in parts)])


def _word_hashes(column: pa.Array, separator: np.ndarray, beginning: int | None, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    text, off = raw(column)
    starts, ends, per = word_spans(text, off, separator)
    if beginning is not None:
        at = np.append(np.flatnonzero((text & 0xC0) != 0x80), len(text))  # where characters begin
        ends = np.minimum(ends, at[np.minimum(np.searchsorted(at, starts) + beginning, len(at) - 1)])
    if not len(starts):
        return np.zeros(0, np.uint64), per
    length = ends - starts
    total = int(length.sum())
    first = np.cumsum(length) - length
    at = np.arange(total, dtype=np.int64)
    place = at - np.repeat(first, length)
    low = text[place + np.repeat(starts, length)]
    low = (_LOWER[low] if lower else low).astype(np.uint64)
    with np.errstate(over="ignore"):
        low += np.uint64(1)
        low *= _powers(int(length.max()))[place]
        h = np.add.reduceat(low, first)
        h += length.astype(np.uint64) * _GOLD
    return mix(h), per


def hash_word(word: str) -> int:
    """The hash of one word, as word_hashes gives it."""
    return int(word_hashes(pa.array([word]))[0][0])


_ROLL = stream(64, seed=77) | np.uint64(1)


def shingle_hashes(h: np.ndarray, per: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every k-word shingle in order, shingles per text); a text of 1..k-1 words has its
    whole sequence as its only shingle."""
    ends = np.cumsum(per)
    starts = ends - per
    n = np.where(per >= k, per - k + 1, (per > 0).astype(per.dtype))
    out = np.empty(int(n.sum()), np.uint64)
    first = np.cumsum(n) - n
    full = per >= k
    with np.errstate(over="ignore"):
        if len(h) >= k:
            rolled = np.zeros(len(h) - k + 1, np.uint64)
            for i in range(k):
                rolled += h[i : i + len(rolled)] * _ROLL[i]
            rolled = mix(rolled)
            m = n[full]
            place = np.arange(int(m.sum()), dtype=np.int64)
            inner = place - np.repeat(np.cumsum(m) - m, m)
            out[np.repeat(first[full], m) + inner] = rolled[np.repeat(starts[full], m) + inner]
        for i in np.flatnonzero(~full & (per > 0)):
            w = h[starts[i] : ends[i]]
            out[first[i]] = mix(np.array([np.sum(w * _ROLL[: len(w)]) + np.uint64(len(w)) * _M1], np.uint64))[0]
    return out, n
