"""Bottom-k sketches of shingle hashes as document fingerprints.

A sketch is the k smallest of the distinct hashes of a text's five-word shingles, cut to 48 bits. Sketches of parts
merge into the sketch of the whole (keep the k smallest of the union); that is how an edited text's sketch is made of
those of what was kept and of what was put in its place. From sketches alone come the number of distinct
shingles, the resemblance (Jaccard likeness) and the containment of two texts; with fewer than k shingles all three
are exact up to hash collisions.

A fingerprint is a sketch in base64, smallest hash first, 6 big-endian bytes each; a text without words has the empty
fingerprint. Two empty fingerprints have likeness 1, an empty and another one 0.

Nulls, ties, repeats: a null text counts as the empty one. Documents are in descending order of doc_id, nulls last, then
of the 64-bit hash of the text, then of the text; "next" follows that order and the last document's next
is the first, so a single document is its own next; rows that are equal stay separate. An empty table gives an empty
result. Only doc_id and text are read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Workspace
from .text import each_set, sha256, shingles

K, WIDTH = 128, 5
BITS = np.uint64(16)
#: Documents that one range of doc_id holds, about, and ranges at most.
RANGE_DOCS, MOST_RANGES = 4_000, 1 << 16


def _least(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k smallest distinct 48-bit hashes of a sorted set of 64-bit ones: twins are neighbours."""
    h = hashes[: 2 * k] >> BITS
    h = h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h
    return h[:k] if len(h) >= k or len(hashes) <= 2 * k else np.unique(hashes >> BITS)[:k]


def sketch(text: str | None, k: int = K) -> np.ndarray:
    """The k smallest distinct 48-bit shingle hashes, ascending."""
    return _least(shingles(text), k)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of both texts' shingles together."""
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**48 / (float(a[k - 1]) + 1)


def _shared(a: np.ndarray, b: np.ndarray, k: int) -> tuple[int, int]:
    union = np.union1d(a, b)
    if len(a) == k or len(b) == k:
        union = union[:k]
    both = np.intersect1d(a, b, assume_unique=True)
    return int(np.searchsorted(both, union[-1], side="right")) if len(union) else 0, len(union)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness of the shingle sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    same, of = _shared(a, b, k)
    return same / of


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too."""
    if not len(a):
        return 1.0
    same, of = _shared(a, b, k)
    return min(1.0, same / of * distinct(merge(a, b, k), k) / distinct(a, k)) if of else 0.0


def pack(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def unpack(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), dtype=np.uint8).reshape(-1, 6)
    return np.hstack([np.zeros((len(raw), 2), dtype=np.uint8), raw]).copy().view(">u8").ravel().astype(np.uint64)


def fingerprints(documents: DataFrame, k: int = K) -> DataFrame:
    """doc_id, fingerprint and n_shingles (estimated) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_least(h, k) for h in each_set(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(pack, found), pa.string(), size=len(found)), pa.array([distinct(s, k) for s in found], pa.float64())],
                names=["doc_id", "fingerprint", "n_shingles"],
            )

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint string, n_shingles double")


def seam(kept: str, new: str) -> str | None:
    """What to sketch besides ``kept``'s whole words for the text ``kept + new``: the last words of ``kept`` from which a
    shingle can reach on, and ``new``; None where ``kept`` has too few words for parts."""
    end = len(kept)
    while end and kept[end - 1] not in " \t\n\x0b\x0c\r":
        end -= 1  # a word may go on in what follows
    words = kept[max(0, end - 4096) : end].encode("utf-8", "surrogatepass").split()
    if len(words) < WIDTH + (end > 4096):
        words = kept[:end].encode("utf-8", "surrogatepass").split()
    if len(words) < WIDTH:
        return None
    return b" ".join(words[1 - WIDTH :]).decode("utf-8", "surrogatepass") + " " + kept[end:] + new


def edited_sketches(texts: list[str], following: list[str], k: int = K) -> tuple[list[str], list[np.ndarray]]:
    """The edited texts and their sketches, merged from those of their parts: the last floor(n / 3) code points of each
    text give way to the first as many (or all) of the one that follows."""
    cuts = [len(t) - len(t) // 3 for t in texts]
    edited = [t[:c] + f[: len(t) - c] for t, c, f in zip(texts, cuts, following)]
    seams = [seam(t[:c], f[: len(t) - c]) for t, c, f in zip(texts, cuts, following)]
    whole = lambda t, c: t[:c] if not c or t[c - 1] in " \t\n\x0b\x0c\r" else t[: max(t.rfind(x, 0, c) for x in " \t\n\x0b\x0c\r") + 1]
    first = each_set(pa.array([e if s is None else whole(t, c) for t, c, e, s in zip(texts, cuts, edited, seams)], pa.string()), WIDTH)
    second = each_set(pa.array([None if s is None or len(s.encode("utf-8", "surrogatepass").split()) < WIDTH else s for s in seams], pa.string()), WIDTH)
    return edited, [merge(_least(a, k), _least(b, k), k) if len(b) else _least(a, k) for a, b in zip(first, second)]


#: What is told of a document.
ROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
ROW_SQL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class Cuts:
    """Ranges of keys (doc_id, h) by their greatest keys, the greatest range first; a null doc_id is below all others."""

    def __init__(self, tops: list[tuple[int | None, int]]) -> None:
        known = sorted(t for t in tops if t[0] is not None)
        self.ids, self.hs = (np.array([t[k] for t in known], dtype=np.int64) for k in (0, 1))
        self.null = np.sort(np.array([h for i, h in tops if i is None], dtype=np.int64))

    def find(self, ids: np.ndarray, null: np.ndarray, hs: np.ndarray) -> np.ndarray:
        """The range of each key: how many tops are not below it, less one."""
        low, high = np.searchsorted(self.ids, ids, side="left"), np.searchsorted(self.ids, ids, side="right")
        for k in np.flatnonzero((low < high) & ~null).tolist():  # a doc_id in which ranges meet
            low[k] += np.searchsorted(self.hs[low[k] : high[k]], hs[k], side="left")
        at = len(self.ids) - low
        at[null] = len(self.ids) + len(self.null) - np.searchsorted(self.null, hs[null], side="left")
        return at - 1


def with_next(documents: DataFrame, ws: Workspace, range_docs: int = RANGE_DOCS) -> DataFrame:
    """Partitions of rows (doc_id, text, guest) in descending order, so that each row is followed by its next document; the
    row after a partition's last own document is a guest, the first of the partition below (of the top one, for the
    lowest).

    Keys are range-sorted and written first, without texts; from them come the ranges' greatest keys, ``MOST_RANGES`` at
    most, which are broadcast. Texts are shuffled once. Only rows equal in doc_id and text are always in one range.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("h", F.xxhash64("text"))
    n_ranges = min(MOST_RANGES, max(1, -(-docs.count() // range_docs)))
    keys = docs.select("doc_id", "h").repartitionByRange(n_ranges, F.col("doc_id").desc_nulls_last(), F.col("h").desc())
    keys = ws.table("keys", keys.withColumn("range", F.spark_partition_id()).groupBy("range").agg(F.max(F.struct("doc_id", "h")).alias("top")))
    found = [(r["top"]["doc_id"], r["top"]["h"]) for r in keys.collect()]
    ws.drop("keys")
    tops = sorted(found, key=lambda t: (t[0] is not None, t[0] or 0, t[1]), reverse=True)
    sent = ws.spark.sparkContext.broadcast(Cuts(tops))

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            at = sent.value.find(batch.column(0).fill_null(0).to_numpy(), null, batch.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], names=["doc_id", "text", "h", "range"])

    own = docs.mapInArrow(ranged, "doc_id long, text string, h long, range int").withColumn("guest", F.lit(False))
    of = ws.spark.createDataFrame([(i, h, (k - 1) % len(tops)) for k, (i, h) in enumerate(tops)], "i long, g long, range int")
    first = docs.join(F.broadcast(of), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g"))).groupBy("doc_id", "h", "range").agg(F.max("text").alias("text"))
    guests = ws.table("guests", first.select("doc_id", "text", "h", "range", F.lit(True).alias("guest")))  # a text a range
    order = ["guest", F.col("doc_id").desc_nulls_last(), F.col("h").desc(), F.col("text").desc()]
    return own.unionByName(guests).repartitionById(max(1, len(tops)), F.col("range")).sortWithinPartitions(*order).select("doc_id", "text", "guest")


def compare_edited(documents: DataFrame, ws: Workspace, k: int = K, range_docs: int = RANGE_DOCS) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    Edited: the last floor(n / 3) code points give way to the first as many (or all) of the next document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            marks = [_least(h, k) for h in each_set(batch.column(1))]
            if held is not None:
                ids, texts, marks = [held[0], *ids], [held[1], *texts], [held[2], *marks]
            held = ids[-1], texts[-1], marks[-1]
            if len(ids) > 1:
                edited, others = edited_sketches(texts[:-1], texts[1:], k)
                cols = [ids[:-1], [len(t) for t in texts[:-1]], [sha256(e) for e in edited], [pack(m) for m in marks[:-1]], [pack(o) for o in others]]
                cols += [[resemblance(m, o, k) for m, o in zip(marks, others)], [resemblance(m, o, k) for m, o in zip(marks, marks[1:])]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, ROW)], schema=ROW)

    return with_next(documents, ws, range_docs).mapInArrow(run, ROW_SQL)
