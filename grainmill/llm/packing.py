"""Packing by power-of-two decomposition.

The ids of a document, with an end id, are cut into pieces whose lengths are powers of two: full sequences first, then
the binary digits of what is left, longest first. A piece is a sequence of its own, so no sequence crosses documents
and none is padded; equal lengths form a bucket, and sequences are numbered bucket by bucket, longest first.

Nulls, ties, repeats: a null or empty text has only the end id; equal rows stay separate documents, whose pieces are
numbered in any order; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Workspace
from .tokenizing import default_path, encoder

#: Texts handed to one Arrow batch of output at most.
ROWS = 512
#: Pieces that one numbering window holds, about.
PIECES_PER_BUCKET = 100_000


def lengths(n: int, longest: int) -> Iterator[int]:
    """Powers of two, the longest first, that add up to ``n``."""
    for _ in range(n // longest):
        yield longest
    n %= longest
    while n:
        top = 1 << (n.bit_length() - 1)
        yield top
        n -= top


def in_files(documents: DataFrame) -> DataFrame:
    """doc_id and text with the place of each row: the number of its file by name (slot) and its row there (at).

    Both are null where ``documents`` are not read from files.
    """
    try:
        meta = documents.metadataColumn("_metadata")
        part = lambda k: F.coalesce(F.regexp_extract(meta["file_name"], r"^part-(\d+)-.*-c(\d+)\.", k).try_cast("long"), F.lit(0))
        return documents.select("doc_id", "text", (part(1) * 100_000 + part(2)).alias("slot"), meta["row_index"].alias("at"))
    except AnalysisException:
        return documents.select("doc_id", "text", F.lit(None).cast("long").alias("slot"), F.lit(None).cast("long").alias("at"))


def pieces(documents: DataFrame, path: str, end_id: int = 1, longest: int = 2048, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, slot, at, start, length, ids_crc32, doc_tokens; the ids themselves where asked for.

    ``documents``: doc_id, text, and the place (slot, at) of a row, which goes with its pieces.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    schema = "doc_id long, slot long, at long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                cols: list[list] = [[] for _ in range(7 + with_ids)]
                for doc_id, text, *place in zip(*(part.column(k).to_pylist() for k in range(4))):
                    ids = memoryview(encode(text) + end)
                    total = len(ids) // 4
                    start = 0
                    for n in lengths(total, longest):
                        own = ids[4 * start : 4 * (start + n)]
                        row = (doc_id, *place, start, n, zlib.crc32(own), total) + ((bytes(own),) if with_ids else ())
                        for c, v in zip(cols, row):
                            c.append(v)
                        start += n
                kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids
                names = ["doc_id", "slot", "at", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("slot").cast("long"), F.col("at").cast("long"))
    return docs.mapInArrow(run, schema)


def pack(documents: DataFrame, ws: Workspace, path: str | None = None, end_id: int = 1, longest: int = 2048, with_ids: bool = False, per_bucket: int = PIECES_PER_BUCKET, in_order: bool = False) -> DataFrame:
    """Adds sequence_id (dense from 0, longest bucket first) and offset, which is always 0. Within a bucket, numbers follow
    a hash of the piece or, with ``in_order``, the order of the files' names and of the rows in them.

    Numbering: pieces are dealt to (length, slot) cells by that hash or by file, cells are counted, and a running
    sum over the cells gives each its first number; only cells are sorted together, and slots grow with the input.
    """
    nowhere = F.lit(None).cast("long")
    docs = in_files(documents) if in_order else documents.select("doc_id", "text", nowhere.alias("slot"), nowhere.alias("at"))
    made = ws.table("pieces", pieces(docs, path or default_path(), end_id, longest, with_ids))
    slots = max(1, -(-made.count() // per_bucket))
    slotted = made.withColumn("slot", F.coalesce("slot", F.pmod(F.xxhash64("doc_id", "start", "doc_tokens", "ids_crc32"), F.lit(slots))))
    cells = slotted.groupBy("length", "slot").agg(F.count("*").alias("n"))
    running = Window.partitionBy("length").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    per_length = cells.groupBy("length").agg(F.sum("n").alias("m"))
    longer = Window.orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    firsts = per_length.select("length", F.coalesce(F.sum("m").over(longer), F.lit(0)).alias("first"))
    ahead = cells.select("length", "slot", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("ahead"))
    starts = ahead.join(firsts, "length").select("length", "slot", (F.col("first") + F.col("ahead")).alias("base"))
    order = Window.partitionBy("length", "slot").orderBy("at", "doc_id", "start", "ids_crc32", "doc_tokens")
    numbered = slotted.withColumn("nth", F.row_number().over(order)).join(starts, ["length", "slot"])
    ids = ["ids"] if with_ids else []
    place = ["slot", "at"] if in_order else []
    return numbered.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("nth") - 1).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *place, *ids
    )
