"""Token ids in files with Elias-Fano encoded document boundaries.

A shard file holds documents in ascending doc_id order:

    8 bytes   magic "GMEFTOK1"
    6 x u64   documents, ids, bytes per id (2 or 4), low bits per boundary, bytes of upper bits, null doc_ids
    doc_ids   first value as i64, then gaps as unsigned LEB128 (nulls come first and are only counted)
    lower     the low bits of each boundary, packed
    upper     per boundary a one after as many zeros as its upper part has grown, packed
    select    u32 position in ``upper`` of every 256th one
    ids       the ids of all documents, one after another

Boundary i is the number of ids before document i; boundaries with the total at the end are a growing sequence, which
takes about 2 + log2(ids / documents) bits each. ``Shard.offset`` finds one boundary from the samples without decoding
the rest. Integers are little-endian.

Shards are ranges of doc_id. A task writes a shard under a temporary name of its own attempt and then renames it to its
final one, so attempts that run again, or side by side, leave one whole file. Files go to the shared folder by pyarrow's
file systems (local, hdfs, viewfs, s3 and s3a, gs, abfs and abfss, dbfs by its mount); they are read back by Spark's
binaryFile source, each document by the select structure.

Nulls, ties, repeats: a null or empty text has only the end id; null doc_ids come first; rows with one doc_id follow
one another in the order of the 64-bit hashes of their texts, then of the texts, and stay separate; an empty table gives no files and no rows.
Only doc_id and text are read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import Workspace
from .tokenizing import default_path, encoder

MAGIC = b"GMEFTOK1"
SAMPLE = 256
#: Ids and documents of one file at most: what a task holds in memory. A single longer document gets a file alone.
SHARD_IDS, SHARD_DOCS = 8_000_000, 200_000
#: Bytes of text that one shard range holds, about (a range may fill several files).
RANGE_BYTES = 48 << 20


def _pack_low(values: np.ndarray, bits: int) -> bytes:
    if not bits:
        return b""
    shifts = np.arange(bits, dtype=np.uint64)
    return np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes()


def _varints(gaps: list[int]) -> bytes:
    out = bytearray()
    for g in gaps:
        while g > 127:
            out.append(g & 127 | 128)
            g >>= 7
        out.append(g)
    return bytes(out)


def encode_shard(doc_ids: list[int | None], counts: list[int], ids: bytes) -> bytes:
    """The file of documents with these id counts; ``ids`` are little-endian unsigned 32-bit integers."""
    bounds = np.concatenate([[0], np.cumsum(np.asarray(counts, dtype=np.uint64))]).astype(np.uint64)
    n, total = len(doc_ids), int(bounds[-1])
    bits = max(0, (total // (n + 1)).bit_length() - 1) if n else 0
    ones = (bounds >> np.uint64(bits)).astype(np.int64) + np.arange(n + 1)
    upper = np.zeros(int(ones[-1]) + 1, dtype=np.uint8)
    upper[ones] = 1
    packed = np.packbits(upper, bitorder="little").tobytes()
    values = np.frombuffer(ids, dtype="<u4")
    width = 2 if not len(values) or int(values.max()) < 1 << 16 else 4
    known = [d for d in doc_ids if d is not None]
    keys = struct.pack("<q", known[0]) + _varints([b - a for a, b in zip(known, known[1:])]) if known else b""
    head = MAGIC + struct.pack("<6Q", n, total, width, bits, len(packed), n - len(known))
    return b"".join([head, keys, _pack_low(bounds, bits), packed, ones[::SAMPLE].astype("<u4").tobytes(), values.astype(f"<u{width}").tobytes()])


class Shard:
    """A shard file's content; ``offset(i)`` and ``ids(i)`` answer for one document."""

    def __init__(self, content: bytes) -> None:
        if content[:8] != MAGIC:
            raise ValueError("not a token file")
        self.n, self.total, self.width, self.bits, size, nulls = struct.unpack_from("<6Q", content, 8)
        at, known = 56, self.n - nulls
        self.doc_ids: list[int | None] = [None] * nulls
        if known:
            (d,) = struct.unpack_from("<q", content, at)
            at += 8
            self.doc_ids.append(d)
            for _ in range(known - 1):
                gap = shift = 0
                while content[at] & 128:
                    gap |= (content[at] & 127) << shift
                    shift, at = shift + 7, at + 1
                d += gap | content[at] << shift
                at += 1
                self.doc_ids.append(d)
        view = memoryview(content)
        low = -(-(self.n + 1) * self.bits // 8)
        self.low, at = np.frombuffer(view[at : at + low], dtype=np.uint8), at + low
        self.upper, at = np.frombuffer(view[at : at + size], dtype=np.uint8), at + size
        samples = -(-(self.n + 1) // SAMPLE)
        self.select, at = np.frombuffer(view[at : at + 4 * samples], dtype="<u4"), at + 4 * samples
        self.data = np.frombuffer(view[at : at + self.width * self.total], dtype=f"<u{self.width}")

    def _low(self, i: int) -> int:
        a, b = i * self.bits, (i + 1) * self.bits
        part = int.from_bytes(self.low[a // 8 : -(-b // 8)].tobytes(), "little")
        return part >> (a % 8) & ((1 << self.bits) - 1)

    def offset(self, i: int) -> int:
        """Ids before document ``i`` (of ``n`` itself: all). Reads a few bytes from the nearest sample on."""
        one, left = int(self.select[i // SAMPLE]), i % SAMPLE
        at = one // 8
        left += int(np.unpackbits(self.upper[at : at + 1], bitorder="little")[: one % 8].sum())  # ones before the sample
        while True:
            bits = np.unpackbits(self.upper[at : at + 64], bitorder="little")
            found = np.flatnonzero(bits)
            if left < len(found):
                return (at * 8 + int(found[left]) - i << self.bits) | self._low(i)
            left -= len(found)
            at += 64

    def offsets(self) -> np.ndarray:
        """All boundaries at once, the total last."""
        ones = np.flatnonzero(np.unpackbits(self.upper, bitorder="little"))[: self.n + 1].astype(np.uint64)
        high = (ones - np.arange(self.n + 1, dtype=np.uint64)) << np.uint64(self.bits)
        if not self.bits:
            return high.astype(np.int64)
        bits = np.unpackbits(self.low, bitorder="little")[: (self.n + 1) * self.bits].reshape(-1, self.bits).astype(np.uint64)
        return (high | (bits << np.arange(self.bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)).astype(np.int64)

    def ids(self, i: int) -> np.ndarray:
        return self.data[self.offset(i) : self.offset(i + 1)].astype("<u4")


def _open(uri: str):
    """The pyarrow file system of a folder's or file's address, and the path there."""
    from pyarrow import fs

    for given, known in (("s3a://", "s3://"), ("s3n://", "s3://"), ("dbfs:/", "/dbfs/")):
        if uri.startswith(given):
            uri = known + uri[len(given) :]
    if "://" not in uri:
        uri = uri.removeprefix("file:")
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def _put(uri: str, content: bytes, attempt: int = 0) -> None:
    """Writes a file as a whole: attempts have names of their own, and the one that is last to rename stays."""
    from pyarrow import fs

    where, path = _open(uri)
    tried = f"{path}.{attempt}.tmp"
    with where.open_output_stream(tried) as out:
        out.write(content)
    try:
        where.move(tried, path)
    except OSError:  # some file systems do not rename onto a file that another attempt has put there
        if where.get_file_info(path).type != fs.FileType.File:
            raise
        where.delete_file(tried)


def write(documents: DataFrame, folder: str, path: str | None = None, end_id: int = 0, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Writes the shard files under ``folder``; returns a lazy manifest, which writes them when it is evaluated.

    Manifest: range, part, file, n_docs, n_ids. Texts are shuffled once, by ranges of doc_id; ids never are.
    """
    path = path or default_path()
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size, = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n_ranges = max(1, -(-size // range_bytes), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "1")))
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(path).encode, TaskContext.get()
        now, attempt = task.partitionId(), task.taskAttemptId()
        part, doc_ids, counts, ids, held = 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            file = f"{folder}/range-{now:06d}-{part:05d}.eftok"
            _put(file, encode_shard(doc_ids, counts, b"".join(ids)), attempt)
            row = {"range": now, "part": part, "file": file, "n_docs": len(doc_ids), "n_ids": held}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("range", pa.int32()), ("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held >= SHARD_IDS or len(doc_ids) >= SHARD_DOCS:
                    yield flush()
                    part, doc_ids, counts, ids, held = part + 1, [], [], [], 0
                got = encode(text) + end
                doc_ids.append(doc_id)
                counts.append(len(got) // 4)
                ids.append(got)
                held += len(got) // 4
        if doc_ids:
            yield flush()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = docs.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(n_ranges, *order, "row").sortWithinPartitions(*order, F.col("text").asc_nulls_first())
    return dealt.select("doc_id", "text").mapInArrow(run, "range int, part int, file string, n_docs long, n_ids long")


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Per document from the files, by the select structure: doc_id, start (over all files), n_tokens, ids_crc32."""
    per_range = manifest.groupBy("range").agg(F.sum("n_ids").alias("m"))
    first = per_range.select("range", F.coalesce(F.sum("m").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    within = Window.partitionBy("range").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = manifest.select("range", F.regexp_extract("file", r"[^/]+$", 0).alias("name"), F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("ahead"))
    bases = bases.join(first, "range").select("name", (F.col("first") + F.col("ahead")).cast("long").alias("base"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.eftok").load(folder)
    named = files.select(F.regexp_extract("path", r"[^/]+$", 0).alias("name"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shard = Shard(batch.column(1)[k].as_py())
                name = batch.column(0)[k].as_py()
                for a in range(0, shard.n, 4096):
                    b = min(shard.n, a + 4096)
                    bounds = [shard.offset(i) for i in range(a, b + 1)]
                    own = [zlib.crc32(shard.data[x:y].astype("<u4").tobytes()) for x, y in zip(bounds, bounds[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * (b - a)), pa.array(shard.doc_ids[a:b], pa.int64()), pa.array(bounds[:-1], pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(own, pa.int64())],
                        names=["name", "doc_id", "at", "n_tokens", "ids_crc32"],
                    )

    rows = named.mapInArrow(run, "name string, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(bases, "name").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(documents: DataFrame, ws: Workspace, **options) -> DataFrame:
    """Writes the files and reads them back."""
    folder = ws.path("files")
    jvm, spark = ws.spark.sparkContext._jvm, ws.spark
    hadoop = jvm.org.apache.hadoop.fs.Path(folder)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop)
    manifest = ws.table("manifest", write(documents, folder, **options))
    return read(spark, folder, manifest)
