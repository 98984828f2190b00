"""Words, shingles and spans as the operators here share them.

A word is a maximal run of code points other than space and U+0009 to U+000D.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separators of words, for Java's regular expressions.
SPACE = r"[\x20\x09-\x0D]+"

#: Odd multipliers of the five words of a shingle.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
#: Bytes of text that are hashed at once, about; a longer text is hashed alone.
STEP = 1 << 19

#: Random 64-bit values of a byte at each of the first 64 places of a word (tabulation hashing), as it is and with A-Z as a-z.
PLACES = 64
_EXACT = np.random.default_rng(0x5EED).integers(0, 1 << 64, (PLACES, 256), dtype=np.uint64)
_FOLDED = _EXACT.copy()
_FOLDED[:, 65:91] = _EXACT[:, 97:123]
_INK = np.ones(256, dtype=bool)
_INK[[9, 10, 11, 12, 13, 32]] = False


def words(text: Column) -> Column:
    """Array of words; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, whatever the optimizer inlines."""
    return F.transform(F.array(value), body)[0]


def finish(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes, one after another, and where each begins; a null text has none."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = np.int64 if texts.type == pa.large_string() else np.int32
    _, bounds, data = texts.buffers()
    offsets = np.frombuffer(bounds, dtype=wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, dtype=np.int64)
    body = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, dtype=np.uint8)
    return body, offsets - offsets[0]


def hashed_words(texts: pa.Array, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a string array, and where each text's words begin (with the total at the end).

    ``fold``: A-Z count as a-z. All texts are hashed together, without a Python object a word.
    """
    body, offsets = _bytes(texts)
    ink = _INK[body]
    begin = ink.copy()
    begin[1:] &= ~ink[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(body)]
    begin[firsts] |= ink[firsts]  # a word ends with its text
    starts = np.flatnonzero(begin)
    if not len(starts):
        return np.empty(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    letters = body[ink].astype(np.int32)
    at = (np.cumsum(ink, dtype=np.int32)[starts] - 1).astype(np.int32)
    sizes = np.diff(at, append=np.int32(len(letters)))
    place = np.arange(len(letters), dtype=np.int32) - np.repeat(at, sizes)
    values = (_FOLDED if fold else _EXACT).ravel()[(place & (PLACES - 1)) << 8 | letters]
    if sizes.max() > PLACES:
        values *= (2 * (place // PLACES) + 1).astype(np.uint64)
    return finish(np.add.reduceat(values, at) + sizes.astype(np.uint64)), np.searchsorted(starts, offsets)


def _short(h: np.ndarray) -> int:
    """One shingle of a whole sequence of fewer words than a shingle has."""
    mixed = np.bitwise_xor.reduce(finish(h * MIX[: len(h)] + np.arange(1, len(h) + 1, dtype=np.uint64)))
    return int(mixed ^ np.uint64(0xD1B54A32D192ED03 + len(h)))


def shingle_sets(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit hashes of each text's ``width``-word shingles, ascending within a text, and where each begins.

    A-Z count as a-z. Fewer words make one shingle of the whole sequence; no words make none.
    """
    h, at = hashed_words(texts, True)
    n = np.diff(at)
    windows = np.maximum(n - width + 1, 0)
    short = np.flatnonzero((n > 0) & (n < width))
    sizes = windows + ((n > 0) & (n < width))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(int(ends[-1]), dtype=np.uint64)
    if windows.any():
        m = len(h) - width + 1
        mixed = np.zeros(m, dtype=np.uint64)
        for k in range(width):
            mixed += h[k : k + m] * MIX[k % len(MIX)] ^ np.uint64(k)
        whole = np.ones(m, dtype=bool)  # windows that lie in one text
        for j in range(1, width):
            last = at[1:] - j
            last = last[(last >= at[:-1]) & (last < m)]
            whole[last] = False
        own = np.ones(len(out), dtype=bool)
        own[ends[short]] = False
        out[own] = finish(mixed[whole])
    for d in short.tolist():
        out[ends[d]] = _short(h[at[d] : at[d + 1]])
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        out[a:b].sort()
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = out[1:] != out[:-1]
    keep[ends[:-1][sizes > 0]] = True
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[ends]


def pieces(texts: pa.Array, step: int = STEP) -> Iterator[tuple[int, pa.Array]]:
    """Slices of a string array of about ``step`` bytes, each with its first row."""
    sizes = np.diff(_bytes(texts)[1])
    at = 0
    while at < len(texts):
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), step, side="right")))
        yield at, texts.slice(at, n)
        at += n


def each_set(texts: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """The shingle set of each text of a string array, in turn."""
    for _, part in pieces(texts):
        h, at = shingle_sets(part, width)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            yield h[a:b]


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """``shingle_sets`` of one text."""
    return shingle_sets(pa.array([(text or "").encode("utf-8", "surrogatepass")], pa.binary()).view(pa.string()), width)[0]


def set_key(hashes: np.ndarray) -> int:
    """Signed 64-bit key of a sorted set of hashes."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).astype(np.int64)) if len(hashes) else 0


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    """Hashes of words as they are."""
    return hashed_words(pa.array([b" ".join(tokens)], pa.binary()).view(pa.string()), False)[0]
