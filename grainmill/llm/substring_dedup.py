"""Repeated substrings: suffix automata of reference shards, matching statistics, spans above a length removed.

The general operator, ``remove_known``, broadcasts automata of a bounded reference and streams documents through them.

For a corpus against itself a broadcast of everything has no bound, so ``remove_repeats`` deals the reference into
shards of which only the matching ones can hold a window's other occurrence. Every window of ``width`` words has an
anchor: the least hash of its 8-word parts, leftmost at ties. Equal windows have equal anchors, at the same place. The
windows of a document that share one anchor make a run. Runs are dealt by anchor:

* an anchor with one run proves its windows unique, and nothing more is done about them;
* runs with equal words repeat as a whole;
* other runs with one anchor are a reference shard: their words are fetched, those that are equal word for word are one,
  a suffix automaton is built of what is left, and each is streamed through it; where the longest suffix that occurs
  twice or more has ``width`` words or more, the span is removed;
* a shard of too many different words for one task's memory is dealt anew, by the hashes of its windows: a window whose
  hash is alone is unique, and the others' words are fetched and go through shards of their own, so no anchor, however
  frequent, is gathered in one place and no window is removed on the word of its hash.

Nulls, ties, repeats: a null or empty text has no words, and the hash of the empty string; equal rows repeat each
other; rows with one doc_id but different texts are different documents; an empty table gives an empty result. Only
doc_id and text are read. Runs that are equal as a whole are told by the 64-bit hashes of their anchor and of all their
words together; everything else is compared by words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Workspace
from .text import finish, word_hashes

WIDTH, ANCHOR = 35, 8
#: Words of one shard's automaton at most; a state takes some 400 bytes.
SHARD_WORDS = 150_000
#: Texts whose runs a task holds at once.
ROWS = 2_048
#: Words of a broadcast reference at most.
REFERENCE_WORDS = 500_000
#: Removed windows, asked ones, and removed ones that others are compared with.
FULL, ASK, PROBE = 1, 2, 3


class SuffixAutomaton:
    """Suffix automaton of word sequences; ``None`` may separate them. ``finish`` counts occurrences."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.len, self.count = [-1], [0], [0]
        self.last = 0
        self.parts = 0

    def add(self, words: Iterable) -> None:
        for w in words:
            self._extend(w)
        self.parts += 1
        self._extend((self.parts,))  # a separator that occurs once

    def _extend(self, w) -> None:
        nxt, link, length = self.next, self.link, self.len
        cur, p = len(nxt), self.last
        nxt.append({})
        link.append(0)
        length.append(length[p] + 1)
        self.count.append(1)
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                self.count.append(0)
                while p >= 0 and nxt[p].get(w) == q:
                    nxt[p][w] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        self.last = cur

    def finish(self) -> SuffixAutomaton:
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            self.count[self.link[s]] += self.count[s]
        return self

    def matching(self, words: Iterable, least: int = 1) -> Iterator[int]:
        """After each word, the length of the longest suffix so far that occurs ``least`` times or more."""
        s = n = 0
        nxt, link, length, count = self.next, self.link, self.len, self.count
        for w in words:
            while s and w not in nxt[s]:
                s = link[s]
                n = length[s]
            if w in nxt[s]:
                s, n = nxt[s][w], n + 1
            t, m = s, n
            while t and count[t] < least:
                t = link[t]
                m = length[t]
            yield m if t else 0


def spans(lengths: Iterable[int], width: int) -> list[tuple[int, int]]:
    """Maximal word ranges [a, b) covered by matches of ``width`` or more."""
    out: list[tuple[int, int]] = []
    for end, n in enumerate(lengths, 1):
        if n >= width:
            if out and end - n <= out[-1][1]:
                out[-1] = (min(out[-1][0], end - n), end)
            else:
                out.append((end - n, end))
    return out


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def runs(words: Sequence[bytes], width: int = WIDTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows by anchor: key, segment hash, first and last window (all 64-bit)."""
    n = len(words) - width + 1
    if n < 1:
        return (np.empty(0, dtype=np.int64),) * 4
    h = word_hashes(words)
    grams = len(h) - anchor + 1
    g = np.zeros(grams, dtype=np.uint64)
    for k in range(anchor):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[k : k + grams]
    g = finish(g)
    span = width - anchor + 1
    at = np.lib.stride_tricks.sliding_window_view(g, span).argmin(axis=1) + np.arange(n)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:] - 1, [n - 1]])
    view = memoryview(h.tobytes())
    seg = np.fromiter((xxhash.xxh3_64_intdigest(view[8 * a : 8 * (b + width)]) for a, b in zip(first.tolist(), last.tolist())), dtype=np.uint64, count=len(first))
    return g[at[first]].view(np.int64), seg.view(np.int64), first.astype(np.int64), last.astype(np.int64)


def _blobs(order: np.ndarray, starts: np.ndarray, data: np.ndarray) -> pa.Array:
    """Rows of ``data`` (n x 3 int64) in ``order`` as binary values, a value a group."""
    offsets = np.concatenate([starts, [len(order)]]).astype(np.int32) * 24
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(data[order]).tobytes())])


def _anchors(docs: DataFrame, width: int) -> DataFrame:
    """(key, seg, where): equal runs of some texts in one row; where: doc_id, text key and both windows of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            keys, segs, data = [], [], []
            for row, tkey, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                key, seg, a, b = runs(tokens(text), width)
                if len(key):
                    keys.append(key)
                    segs.append(seg)
                    data.append(np.column_stack([np.full(len(key), row), np.full(len(key), tkey), a << 32 | b]))
            if not keys:
                continue
            key, seg, data = np.concatenate(keys), np.concatenate(segs), np.concatenate(data).astype(np.int64)
            order = np.lexsort((seg, key))
            k, s = key[order], seg[order]
            starts = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])]))
            yield pa.RecordBatch.from_arrays([pa.array(k[starts]), pa.array(s[starts]), _blobs(order, starts, data)], names=["key", "seg", "where"])

    return docs.select("id", "tkey", "text").mapInArrow(run, "key long, seg long, where binary")


def _settle(anchors: DataFrame) -> DataFrame:
    """Runs whose anchor repeats: (id, tkey, key, a, b, kind). Needs a row's neighbours in the sorted order only."""
    kinds = [("id", pa.int64()), ("tkey", pa.int64()), ("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("kind", pa.int8())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row of the batch before: its next one was not known
        before: tuple | None = None  # key and seg of the row before that one

        def judge(key, seg, blobs, before, after):
            """All rows given; ``before`` and ``after``: key and seg of their neighbours, or None."""
            n = len(key)
            pk, ps = np.empty(n, np.int64), np.empty(n, np.int64)
            nk, ns = np.empty(n, np.int64), np.empty(n, np.int64)
            pk[1:], ps[1:], nk[:-1], ns[:-1] = key[:-1], seg[:-1], key[1:], seg[1:]
            pk[0], ps[0] = before or (~key[0], 0)
            nk[-1], ns[-1] = after or (~key[-1], 0)
            same_p, same_n = (pk == key) & (ps == seg), (nk == key) & (ns == seg)
            other_p, other_n = (pk == key) & (ps != seg), (nk == key) & (ns != seg)
            size = np.fromiter((len(x) // 24 for x in blobs), dtype=np.int64, count=n)
            full = same_p | same_n | (size > 1)
            alone = ~full & (other_p | other_n)
            probe = full & ((~same_p & other_p) | (~same_n & other_n))
            keep = np.flatnonzero(full | alone)
            if not len(keep):
                return None
            data = np.frombuffer(b"".join([blobs[i] for i in keep.tolist()]), dtype=np.int64).reshape(-1, 3)
            times = size[keep]
            kind = np.repeat(np.where(alone[keep], ASK, FULL), times).astype(np.int8)
            heads = np.concatenate([[0], np.cumsum(times)[:-1]])
            kind[heads[probe[keep]]] = PROBE
            cols = [data[:, 0], data[:, 1], np.repeat(key[keep], times), data[:, 2] >> 32, data[:, 2] & 0xFFFFFFFF, kind]
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), t) for c, (_, t) in zip(cols, kinds)], names=[k for k, _ in kinds])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, seg = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            blobs = batch.column(2).to_pylist()
            if held:
                key, seg, blobs = np.concatenate([[held[0]], key]), np.concatenate([[held[1]], seg]), [held[2], *blobs]
            if len(key) > 1:
                out = judge(key[:-1], seg[:-1], blobs[:-1], before, (key[-1], seg[-1]))
                before = (key[-2], seg[-2])
                if out:
                    yield out
            held = (key[-1], seg[-1], blobs[-1])
        if held and (out := judge(np.array([held[0]]), np.array([held[1]]), [held[2]], before, None)):
            yield out

    sorted_ = anchors.repartition("key").sortWithinPartitions("key", "seg")
    return sorted_.mapInArrow(run, "id long, tkey long, key long, a long, b long, kind byte")


def _fetch(docs: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """The words of asked runs: (key, id, tkey, a, ask, words)."""
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("tkey", pa.int64()), ("a", pa.int64()), ("ask", pa.bool_()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row, tkey, text, want in zip(*(batch.column(i).to_pylist() for i in range(4))):
                words = tokens(text)
                out += [(w["key"], row, tkey, w["a"], w["kind"] == ASK, b" ".join(words[w["a"] : w["b"] + width])) for w in want]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    wants = asked.groupBy("id", "tkey").agg(F.collect_list(F.struct("key", "a", "b", "kind")).alias("want"))
    return docs.join(wants, ["id", "tkey"]).select("id", "tkey", "text", "want").mapInArrow(run, "key long, id long, tkey long, a long, ask boolean, words binary")


def repeated_in(shard: Sequence[Sequence[bytes]], width: int) -> list[list[int]]:
    """For each sequence of a shard, the starts of its windows that the shard holds twice or more."""
    automaton = SuffixAutomaton()
    for words in shard:
        automaton.add(words)
    automaton.finish()
    return [[end - width for end, n in enumerate(automaton.matching(words, 2), 1) if n >= width] for words in shard]


def _match(fetched: DataFrame, width: int, shard_words: int | None) -> DataFrame:
    """(id, tkey, a, b, hash, ask): windows found repeated (hash is null), or the hash of a window of a shard of more than
    ``shard_words`` different words (None: of any size), and whether it is asked about.

    A task holds the different sequences of one shard; a sequence that comes again is settled as it comes.
    """
    schema = pa.schema([("id", pa.int64()), ("tkey", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("hash", pa.int64()), ("ask", pa.bool_())])

    def windows(row) -> Iterator[tuple]:
        words = row[5].split()
        for i in range(len(words) - width + 1):
            h = xxhash.xxh3_64_intdigest(b" ".join(words[i : i + width]))
            yield row[1], row[2], row[3] + i, row[3] + i, h - (h >> 63 << 64), row[4]

    def whole(row) -> tuple:
        return row[1], row[2], row[3], row[3] + row[5].count(b" ") + 1 - width, None, True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: dict[bytes, list] = {}  # the first row of each sequence, and whether it came again
        key, held, large = None, 0, False
        out: list[tuple] = []

        def close() -> None:
            firsts = [row for row, _ in shard.values()]
            if any(row[4] and not again for row, again in shard.values()):
                for (row, again), starts in zip(shard.values(), repeated_in([r[5].split() for r in firsts], width)):
                    if row[4] and not again:
                        out.extend((row[1], row[2], row[3] + i, row[3] + i, None, True) for i in starts)

        def batch_out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out.clear()
            return made

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if row[0] != key:
                    close()
                    shard, key, held, large = {}, row[0], 0, False
                first = None if large else shard.get(row[5])
                if large:
                    out.extend(windows(row))
                elif first:
                    if first[0][4] and not first[1]:
                        out.append(whole(first[0]))
                    first[1] = True
                    if row[4]:
                        out.append(whole(row))
                else:
                    shard[row[5]] = [row, False]
                    held += row[5].count(b" ") + 1
                    if shard_words is not None and held > shard_words:
                        large = True
                        for r, again in shard.values():
                            out.extend(windows((*r[:4], r[4] and not again, r[5])))
                        shard = {}
                if len(out) >= 20_000:
                    yield batch_out()
        close()
        if out:
            yield batch_out()

    return fetched.repartition("key").sortWithinPartitions("key").mapInArrow(run, "id long, tkey long, a long, b long, hash long, ask boolean")


def repeated_windows(docs: DataFrame, ws: Workspace, width: int = WIDTH, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(id, tkey, a, b): all windows from the a-th to the b-th of a document occur elsewhere, too."""
    settled = ws.table("settled", _settle(_anchors(docs, width)))
    asked = settled.where(F.col("kind") != FULL).select("id", "tkey", "key", "a", "b", "kind")
    found = ws.table("found", _match(_fetch(docs, asked, width), width, shard_words))
    rest = found.where("hash is not null")
    out = settled.where(F.col("kind") != ASK).select("id", "tkey", "a", "b").unionByName(found.where("hash is null").select("id", "tkey", "a", "b"))
    if not rest.limit(1).count():
        return out
    often = rest.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    kind = F.when(F.col("ask"), ASK).otherwise(PROBE).cast("byte")
    again = ws.table("again", rest.join(often, "hash").select("id", "tkey", F.col("hash").alias("key"), "a", "b", kind.alias("kind")))
    return out.unionByName(_match(_fetch(docs, again, width), width, None).select("id", "tkey", "a", "b"))


def _keyed(documents: DataFrame) -> DataFrame:
    """A null doc_id is 0 with another text key, so joins need no null-safe comparison."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"),
        F.xxhash64(text, F.col("doc_id").isNull()).alias("tkey"),
        text.alias("text"),
    )


def remove_repeats(documents: DataFrame, ws: Workspace, width: int = WIDTH, shard_words: int = SHARD_WORDS, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every whole text (and kept_text where asked for): words covered by a
    window that occurs elsewhere go; windows are judged on the input.

    Shuffles: runs once, the words of undecided runs once, texts twice (to fetch those words, and to cut).
    """
    if width < ANCHOR:
        raise ValueError(f"a window needs {ANCHOR} words or more")
    docs = _keyed(documents)
    found = repeated_windows(docs.select("id", "tkey", "text"), ws, width, shard_words)
    cover = found.distinct().groupBy("id", "tkey").agg(F.collect_list(F.struct("a", "b")).alias("cover"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("kept_text", pa.string())] * with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            ids, texts, covers = (batch.column(i) for i in range(3))
            for doc_id, text, cover in zip(ids.to_pylist(), texts.to_pylist(), covers.to_pylist()):
                words = tokens(text)
                n = len(words)
                if cover:
                    edge = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(edge, [c["a"] for c in cover], 1)
                    np.add.at(edge, [c["b"] + width for c in cover], -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:n]) == 0).tolist()]
                kept = b" ".join(words)
                out.append((doc_id, n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass"))[: len(schema)])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    joined = docs.join(cover, ["id", "tkey"], "left").select("doc_id", "text", "cover")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)


def remove_known(documents: DataFrame, reference: DataFrame, ws: Workspace, width: int = WIDTH, shard_words: int = SHARD_WORDS, most_words: int = REFERENCE_WORDS) -> DataFrame:
    """doc_id and text without the maximal spans of ``width`` words or more that a bounded reference has, too.

    ``reference``: a text column; it is collected and broadcast as automata of shards, and refused where it holds more
    than ``most_words`` words (give it as documents to ``remove_repeats`` then).
    """
    n, = reference.select(F.coalesce(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"))), F.lit(0))).first()
    if n > most_words:
        raise ValueError(f"the reference has {n} words; at most {most_words} are broadcast")
    shards, held = [[]], 0
    for (text,) in reference.select("text").distinct().collect():
        words = tokens(text)
        if held and held + len(words) > shard_words:
            shards.append([])
            held = 0
        shards[-1].append(words)
        held += len(words)
    sent = ws.spark.sparkContext.broadcast(shards)
    built: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not built:
            for shard in sent.value:
                built.append(SuffixAutomaton())
                for words in shard:
                    built[-1].add(words)
        for batch in batches:
            texts = []
            for text in batch.column(1).to_pylist():
                words = tokens(text)
                gone = [s for automaton in built for s in spans(automaton.matching(words), width)]
                cut = {i for a, b in gone for i in range(a, b)}
                texts.append(text if not cut else b" ".join([w for i, w in enumerate(words) if i not in cut]).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, text string")


#: The whole report of ``remove_repeats`` in SQL.
SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT rid, i, array_to_string(w[i:i + 34], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM docs WHERE len(w) >= 35)),
twice AS (SELECT rid, i FROM windows SEMI JOIN (SELECT g FROM windows GROUP BY g HAVING count(*) > 1) t USING (g)),
gone AS (SELECT DISTINCT rid, i + j AS pos FROM twice, (SELECT unnest(range(35)) AS j)),
kept AS (SELECT rid, string_agg(x, ' ' ORDER BY pos) AS text, count(*) AS n FROM (SELECT rid, unnest(w) AS x, generate_subscripts(w, 1) AS pos FROM docs) e ANTI JOIN gone g USING (rid, pos) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (rid)
"""
