"""Words and word shingles as 64-bit hashes, vectorised over the bytes of many texts at once.

A word is a maximal run of bytes other than space and \\t-\\r; A-Z are lower-cased. The set of a text holds its
distinct runs of `size` words; a shorter text has its whole word sequence as one shingle; a text without words,
or null, has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from tideglass.llm.worker import kept

SIZE = 5
#: Bytes of text that are hashed at once.
CHUNK = 1 << 20
#: Longer words are hashed one by one.
LONGEST = 256
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_END = np.uint64(0x94D049BB133111EB)
_FOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_R29, _R32 = np.uint64(29), np.uint64(32)
_SPACES = np.isin(np.arange(256), [0x20, *range(9, 14)])


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit number for each byte (a letter's for its capital), and powers of the base."""
    points = np.array([xxhash.xxh3_64_intdigest(bytes([b]).lower()) for b in range(256)], np.uint64)
    powers = np.full(LONGEST, _BASE, np.uint64)
    powers[0] = 1
    with np.errstate(over="ignore"):
        return points, np.multiply.accumulate(powers)


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie end to end in data (bytes), text i from bounds[i] to bounds[i + 1]; then
    where each text's words begin, and their number at the end."""
    points, powers = kept("word-tables", _tables)
    letter = ~_SPACES[data]
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    edges = bounds[:-1][np.diff(bounds) > 0]
    first[edges] = letter[edges]
    at = np.flatnonzero(first)
    cuts = np.searchsorted(at, bounds)
    if not len(at):
        return np.zeros(0, np.uint64), cuts
    starts = np.flatnonzero(first[letter])
    own = data[letter]
    lengths = np.diff(starts, append=len(own))
    place = np.arange(len(own)) - np.repeat(starts, lengths)
    with np.errstate(over="ignore"):
        out = np.add.reduceat(points[own] * powers[np.minimum(place, LONGEST - 1)], starts)
        out = (out ^ (out >> _R32)) * _MIX
    for i in np.flatnonzero(lengths > LONGEST):
        out[i] = xxhash.xxh64_intdigest(own[starts[i] : starts[i] + lengths[i]].tobytes().lower())
    return out, cuts


def combine(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` words, in order; the whole sequence if there are fewer words."""
    if not len(words):
        return words
    run = min(size, len(words))
    n = len(words) - run + 1
    with np.errstate(over="ignore"):
        out = (words[:n] ^ np.uint64(run)) * _FOLD
        for i in range(1, run):
            out ^= out >> _R29
            out = (out ^ words[i : i + n]) * _MIX
        out ^= out >> _R32
        out *= _END
        out ^= out >> _R29
    return out


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    if len(values) < 2:
        return values
    fresh = np.empty(len(values), bool)
    fresh[0] = True
    np.not_equal(values[1:], values[:-1], out=fresh[1:])
    return values[fresh]


def _runs(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK bytes."""
    a = 0
    while a < len(bounds) - 1:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + CHUNK, "right")) - 1)
        yield a, b
        a = b


def shingle_sets(texts: pa.Array, size: int = SIZE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; an empty array for null."""
    if not len(texts):
        return []
    wide = texts.cast(pa.large_string())
    bounds = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    raw = wide.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    out: list[np.ndarray] = []
    for a, b in _runs(bounds):
        words, cuts = word_hashes(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
        runs = combine(words, size) if len(words) >= size else words
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            out.append(distinct(runs[low : high - size + 1]) if high - low >= size else combine(words[low:high], size))
    if wide.null_count:
        for i in np.flatnonzero(wide.is_null().to_numpy(zero_copy_only=False)):
            out[i] = np.zeros(0, np.uint64)
    return out


def shingle_set(text: str | None, size: int = SIZE) -> np.ndarray:
    """Sorted distinct shingle hashes of one text."""
    return shingle_sets(pa.array([text], pa.large_string()), size)[0]
