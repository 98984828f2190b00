"""Fill-in-the-middle documents, cut at lines, over an index of distinct texts.

A text is told by its SHA-256. Documents meet the index of distinct texts in one shuffle by that key: of equal texts in one
task the first only travels, once its content has been compared with the others', and the rest travel as keys. Behind the
shuffle the texts of a key are compared again and become one entry: the text and the Elias-Fano list of its boundaries
(code points after each line), computed once. The documents of the key follow it in the sort order, and each selects its
two seeded cuts from the list.

A text that more than a part in ``parts`` of all documents share is hot; there are fewer than ``parts`` of these, so they
are broadcast, and the documents of each are dealt to as many tasks as they fill parts, each with an entry of its own.

Nulls, ties, repeats: a null text is the empty one, which stays as it is (plain); a null doc_id is hashed as no digits;
rows with one doc_id get the same cuts; repeated rows stay; an empty table gives an empty result. Two texts with one
SHA-256 would raise an error. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Workspace
from .elias_fano import EliasFano

MARKS = ("<P>", "<S>", "<M>")
#: Bytes of texts that a task remembers while it looks for equal ones, and bytes of output that it holds.
REMEMBERED, HELD = 32 << 20, 8 << 20
_KEYED = "doc_id long, key binary, piece int, text string"
_CUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class Entry:
    """A distinct text and its line boundaries; entry ``i`` of the list is the number of code points of ``i`` lines."""

    __slots__ = ("bounds", "marked", "text")

    def __init__(self, text: str) -> None:
        self.text = text
        self.marked = not text or any(m in text for m in MARKS)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        ends = np.flatnonzero(points == 10) + 1
        if len(points) and (not len(ends) or ends[-1] != len(points)):
            ends = np.append(ends, len(points))
        self.bounds = EliasFano(np.concatenate([[0], ends]))

    @property
    def lines(self) -> int:
        return len(self.bounds) - 1


def seeded(doc_id: int | None, seed: int) -> list[int]:
    """The first four unsigned 32-bit integers of a document's hash."""
    told = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(told[k : k + 8], 16) for k in (0, 8, 16, 24)]


def cut(entry: Entry, doc_id: int | None, seed: int, rate: int, spm: int) -> tuple[str, int | None, int | None, str]:
    """form, code points of prefix and middle, and the document's output."""
    h1, h2, h3, h4 = seeded(doc_id, seed)
    if entry.marked or h3 % 100 >= rate:
        return "plain", None, None, entry.text
    first, second = sorted((h1 % (entry.lines + 1), h2 % (entry.lines + 1)))
    a, b = entry.bounds.select(first), entry.bounds.select(second)
    prefix, middle, suffix = entry.text[:a], entry.text[a:b], entry.text[b:]
    if h4 % 100 < spm:
        return "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def _first_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Takes the text off every row whose key and piece have sent an equal one from this task."""
    sent: dict[tuple, str] = {}
    size = 0
    for batch in batches:
        texts = batch.column(3).to_pylist()
        for i, at in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            text = texts[i]
            if at in sent:
                if sent[at] != text:
                    raise ValueError("two texts share a SHA-256")
                texts[i] = None
                continue
            size += len(text)
            if size > REMEMBERED:
                sent, size = {}, len(text)
            sent[at] = text
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string())], names=["doc_id", "key", "piece", "text"])


def _cuts(seed: int, rate: int, spm: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        rows: list[tuple] = []
        held, key, entry = 0, None, None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            for doc_id, now, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                if now != key:
                    key, entry = now, Entry(text)
                elif text is not None and text != entry.text:
                    raise ValueError("two texts share a SHA-256")
                rows.append((doc_id, entry.lines, *cut(entry, doc_id, seed, rate, spm)))
                held += len(entry.text) + 64
                if held >= HELD:
                    yield told()
                    rows, held = [], 0
        if rows:
            yield told()

    return run


def fill_in_middle(documents: DataFrame, ws: Workspace, seed: int = 7, rate: int = 100, spm: int = 50, parts: int | None = None) -> DataFrame:
    """doc_id, n (lines), form, prefix_chars, middle_chars, output.

    ``rate`` of 100 documents are cut, ``spm`` of 100 of these have the suffix first. ``parts`` (by default the session's
    shuffle partitions) tells hot texts and does not change the result.
    """
    parts = parts or int(ws.spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    keyed = docs.withColumn("key", F.unhex(F.sha2("text", 256)))
    total = documents.count()
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") * parts > total)
    hot = ws.table("hot", counts.select("key", F.ceil(F.col("n") * parts / F.lit(max(1, total))).cast("int").alias("pieces")))
    piece = F.coalesce(F.pmod(F.xxhash64(F.monotonically_increasing_id()), "pieces").cast("int"), F.lit(0))
    dealt = keyed.join(F.broadcast(hot), "key", "left").select("doc_id", "key", piece.alias("piece"), "text")
    sent = dealt.mapInArrow(_first_texts, _KEYED).repartition("key", "piece")
    return sent.sortWithinPartitions("key", "piece", F.col("text").isNull()).mapInArrow(_cuts(seed, rate, spm), _CUT)


def restore(output: Column, form: Column) -> Column:
    """The text again, from output and form alone."""
    part = F.split(output, "<[PSM]>", -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def digest(made: DataFrame) -> DataFrame:
    """The report of the query: hashes of outputs and of the texts rebuilt from them."""
    output = F.col("output")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(output, 256).alias("output_sha256"), F.sha2(restore(output, F.col("form")), 256).alias("restored_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
l AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS ls, [('0x' || substr(h, 8 * k + 1, 8))::BIGINT FOR k IN range(4)] AS r FROM d),
c AS (SELECT *, len(ls) AS n, least(r[1] % (len(ls) + 1), r[2] % (len(ls) + 1)) AS a, greatest(r[1] % (len(ls) + 1), r[2] % (len(ls) + 1)) AS b,
  t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS plain FROM l),
p AS (SELECT *, coalesce(array_to_string(ls[1:a], ''), '') AS prefix, coalesce(array_to_string(ls[a + 1:b], ''), '') AS middle, coalesce(array_to_string(ls[b + 1:n], ''), '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, CASE WHEN plain THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
  CASE WHEN NOT plain THEN length(prefix) END AS prefix_chars, CASE WHEN NOT plain THEN length(middle) END AS middle_chars,
  sha256(CASE WHEN plain THEN t WHEN r[4] % 100 < 50 THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""
