"""Exact Jaccard self-join of shingle sets by index lists, with skipping over related sets.

Sets are the distinct five-word shingles of texts (64-bit hashes, A-Z in lower case). All sets are put in one order of
shingles: those frequent in many places last, the rest by hash. Two sets that are similar enough share a shingle within
each one's prefix, so only prefixes are indexed: a list per shingle, sorted by set size. Equal sets are one class.

What is skipped, and why nothing is lost:

* lists of one class hold no pair;
* within a list, blocks whose sizes or positions cannot reach the needed overlap are skipped as a whole;
* a set has a signature: for each of some bits the parity of its shingles that fall there. Two sets differ in at least as
  many shingles as their signatures differ in bits, which bounds the overlap, so pairs that share a passage only are
  never proposed;
* first, each list links its sets to one pivot only, the set that holds the list's shingle at the earliest position: as
  rare shingles come first, that is the least edited of a group of copies. These links are computed exactly and grouped
  into components. A set in a pivot's component takes its answer from the pivot, so lists are then only searched for
  pairs across components;
* sets compared with one pivot are settled among themselves by their differences from it (what each lacks and has
  besides): the overlap of two follows from these, so neither text is read again, and only links come out;
* a pair (x, y) that is left, of sets with pivots r, s, takes its answer from (r, s) where that decides: Jaccard distance is a
  metric, so d(r, s) - d(r, x) - d(s, y) above the bound proves that x and y are not linked, and a link of r and s
  makes the pair's components one. Only the remaining pairs are computed.

What counts as frequent only changes the order of shingles and so the work, never the result.

Hot groups: a list that is expected to be long is dealt to several tasks by class, and the pivots of its parts are linked
with one another; a list is searched, and a pivot's sets are settled, in parts of a bounded number of comparisons, each
of which holds its own sets and streams the others.

Nulls, ties, repeats: null and empty texts have no set, are linked with nothing and are their own component; equal rows
are linked; a component's id is its smallest doc_id that is not null, null where it has none; rows without a doc_id
and rows that share one are linked by their texts as all others are; an empty table gives an empty result. Only doc_id
and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Workspace, unused
from .text import each_set, pieces, set_key, shingle_sets

#: Similarity as a fraction: linked when DEN * intersection >= NUM * union.
NUM, DEN = 3, 4
#: Shingles that one local count holds, copies in it from which a shingle is reported, and how many of the most
#: frequent ones are broadcast at most (8 bytes and a class each).
CHUNK, LOCAL, FREQUENT = 1 << 21, 4, 200_000
#: Members that one task compares with a pivot, about; entries of a block; of a part of a list; held of a list at once.
PER_PIVOT, BLOCK, LIST_PART, HOLD = 256, 128, 1 << 17, 1 << 18
#: Lists up to this length are searched side by side.
SHORT_LIST = 24
#: Comparisons that one task makes, about.
COMPARISONS = 50_000_000
#: Largest set whose signature goes with its entries in lists (larger ones are looked up a pair), and its 64-bit words.
BRIEF, BRIEF_WORDS = 1024, 16
#: Keys of texts that are broadcast at most; beyond it texts are shuffled to them.
BROADCAST = 100_000


def needed(a, b):
    """The least overlap of linked sets with ``a`` and ``b`` elements: NUM (a + b) / (NUM + DEN), rounded up."""
    return -((-NUM * (a + b)) // (NUM + DEN))


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def signature(h: np.ndarray) -> bytes:
    """For each of as many bits as the set has elements, or up to twice that, the parity of the elements that fall there."""
    bits = max(64, 1 << (len(h) - 1).bit_length())
    return np.packbits((np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Bits in which two signatures differ, the longer one folded to the shorter one's length."""
    x, y = np.frombuffer(a, dtype="<u8"), np.frombuffer(b, dtype="<u8")
    n = min(len(x), len(y))
    fold = lambda v: np.bitwise_xor.reduce(v.reshape(-1, n), axis=0)
    return int(np.bitwise_count(fold(x) ^ fold(y)).sum())


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(kind, x, n, f, h, sig): kind 0 is a document's id, set size, class and key; kind 1 a shingle and its local count;
    kind 2 a class, its size and signature."""
    schema = pa.schema([("kind", pa.int8()), ("x", pa.int64()), ("n", pa.int64()), ("f", pa.int64()), ("h", pa.int64()), ("sig", pa.binary())])

    def rows(kind: int, x, n, f=None, h=None, sig=None) -> pa.RecordBatch:
        none = lambda v, t: pa.nulls(len(x), t) if v is None else pa.array(v, t)
        x = pa.array(x, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int8)), x, pa.array(n, pa.int64()), none(f, pa.int64()), none(h, pa.int64()), none(sig, pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, seen, held = [], set(), 0

        def frequent() -> Iterator[pa.RecordBatch]:
            h = np.sort(np.concatenate(chunk))
            heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            times = np.diff(np.concatenate([heads, [len(h)]]))
            many = times >= LOCAL
            if many.any():
                yield rows(1, h[heads[many]].view(np.int64), times[many])

        for batch in batches:
            for first, texts in pieces(batch.column(2)):
                sizes, classes, signed = [], [], []
                for h in each_set(texts, width):
                    f = set_key(h)
                    sizes.append(len(h))
                    classes.append(f)
                    if len(h) and f not in seen:
                        seen.add(f)
                        signed.append((f, len(h), signature(h)))
                        chunk.append(h.copy())
                        held += len(h)
                yield rows(0, batch.column(0).slice(first, len(texts)), sizes, classes, batch.column(1).slice(first, len(texts)))
                if signed:
                    f, n, sig = zip(*signed)
                    yield rows(2, f, n, sig=sig)
                if held >= CHUNK:
                    yield from frequent()
                    chunk, seen, held = [], set(), 0
        if chunk:
            yield from frequent()

    return docs.select("doc_id", "h", "text").mapInArrow(run, "kind byte, x long, n long, f long, h long, sig binary")


def _postings(docs: DataFrame, frequent: list[tuple[int, int]], ws: Workspace, width: int) -> DataFrame:
    """(s, q, n, f, p): the prefix shingles of each class that a batch holds. p is the position; q the part of a list
    that is expected to be long, -1 for others."""
    frequent = sorted(frequent, key=lambda x: x[0] % (1 << 64))
    keys = np.array([h for h, _ in frequent], dtype=np.int64).view(np.uint64)
    ranks = np.array([min(15, c.bit_length() - 1) for _, c in frequent], dtype=np.int8)
    parts = np.array([-(-c // LIST_PART) for _, c in frequent], dtype=np.int64)
    sent = ws.spark.sparkContext.broadcast((keys, ranks, parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank, split = sent.value
        common = np.zeros(1 << 20, dtype=bool)  # by the upper bits, what may be known
        common[known >> np.uint64(44)] = True
        for batch in batches:
            seen: set[int] = set()
            for _, texts in pieces(batch.column(0)):
                h, at = shingle_sets(texts, width)
                found = np.flatnonzero(common[h >> np.uint64(44)]) if len(known) else np.empty(0, dtype=np.int64)
                order, part = np.zeros(len(h), dtype=np.int8), np.ones(len(h), dtype=np.int64)
                if len(found):
                    i = np.minimum(np.searchsorted(known, h[found]), len(known) - 1)
                    hit = known[i] == h[found]
                    order[found[hit]], part[found[hit]] = rank[i[hit]], split[i[hit]]
                own, sizes, classes = [], [], []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                    f = set_key(h[a:b])
                    if a == b or f in seen:
                        continue
                    seen.add(f)
                    m, r = prefix_length(b - a), order[a:b]
                    rare = np.flatnonzero(r == 0)[:m]
                    if len(rare) < m:  # the rest by rank, then hash
                        rest = np.flatnonzero(r)
                        rare = np.concatenate([rare, rest[np.argsort(r[rest], kind="stable")]])[:m]
                    own.append(rare + a)
                    sizes.append(b - a)
                    classes.append(f)
                if own:
                    counts = np.array([len(x) for x in own])
                    took, f = np.concatenate(own), np.repeat(np.array(classes, dtype=np.int64), counts)
                    p = np.arange(len(took)) - np.repeat(np.cumsum(counts) - counts, counts)
                    q = np.where(part[took] > 1, f % part[took], -1)
                    cols = [h[took].view(np.int64), q.astype(np.int32), np.repeat(np.array(sizes, dtype=np.int32), counts), f, p.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["s", "q", "n", "f", "p"])

    return docs.select("text").mapInArrow(run, "s long, q int, n int, f long, p int")


#: Columns of a shared posting: list, class, size, position, and whether the list's first and previous classes exist.
SHARED = [("s", pa.int64()), ("q", pa.int32()), ("n", pa.int32()), ("f", pa.int64()), ("p", pa.int32()), ("f1", pa.int64()), ("n1", pa.int32()), ("p1", pa.int32()), ("f2", pa.int64()), ("n2", pa.int32()), ("p2", pa.int32())]


def _shared(postings: DataFrame) -> DataFrame:
    """Postings of lists with two classes or more, each with the list's first class (f1, ..) and the one before (f2, ..).

    A list's first row has itself as both. Streams the sorted lists with one row of memory, however long they are. Each
    part of a list that is dealt to several tasks is a list here, and none of them is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {k: batch.column(i).to_numpy() for i, k in enumerate(("s", "q", "n", "f", "p"))}
            if held:
                cols = {k: np.concatenate([held[k], v]) for k, v in cols.items()}
            s, q, f = cols["s"], cols["q"], cols["f"]
            keep = np.concatenate([[True], (s[1:] != s[:-1]) | (f[1:] != f[:-1])])
            cols = {k: v[keep] for k, v in cols.items()}
            s, q = cols["s"], cols["q"]
            other = (s[1:] != s[:-1]) | (q[1:] != q[:-1])
            new = np.concatenate([[True], other])
            i = np.arange(len(s))
            first = np.maximum.accumulate(np.where(new, i, 0))
            before = np.where(new, i, i - 1)
            for k in ("f", "n", "p"):
                cols[k + "1"], cols[k + "2"] = cols[k][first], cols[k][before]
            alone = new.copy()
            if held:  # the first row's list may have begun earlier
                same = first == 0
                for k in ("f", "n", "p"):
                    cols[k + "1"][same] = held[k + "1"][0]
                    cols[k + "2"][0] = held[k + "2"][0]
                alone[0] = bool(held["alone"][0])
            ends = np.concatenate([other, [True]])
            out = ~(alone & ends) | (q >= 0)
            held = {k: v[-1:] for k, v in cols.items()} | {"alone": alone[-1:]}
            out[-1] = False  # not known yet
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(cols[k][out], t) for k, t in SHARED], names=[k for k, _ in SHARED])
        if held and (not held["alone"][0] or held["q"][0] >= 0):
            yield pa.RecordBatch.from_arrays([pa.array(held[k], t) for k, t in SHARED], names=[k for k, _ in SHARED])

    dealt = postings.repartition("s", "q").sortWithinPartitions("s", "q", "p", "n", "f")
    return dealt.select("s", "q", "n", "f", "p").mapInArrow(run, "s long, q int, n int, f long, p int, f1 long, n1 int, p1 int, f2 long, n2 int, p2 int")


def possible(na: Column, pa_: Column, nb: Column, pb: Column) -> Column:
    """Whether sets that share a first shingle at these positions can be linked at all."""
    need = F.ceil(F.lit(NUM) * (na + nb) / F.lit(NUM + DEN))
    return (na * DEN >= nb * NUM) & (nb * DEN >= na * NUM) & (F.least(na - pa_, nb - pb) >= need)


def _pivots(shared: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a the pivot: each list's first class with the others, or, where sizes forbid that, each
    class with the one before it. The pivots of a long list's parts get the first of them as theirs."""
    able = lambda k: (F.col(f"f{k}") != F.col("f")) & possible(F.col(f"n{k}"), F.col(f"p{k}"), F.col("n"), F.col("p"))
    pivot = F.when(able(1), F.col("f1")).when(able(2), F.col("f2"))
    pairs = shared.select(pivot.alias("a"), F.col("f").alias("b")).where("a is not null")
    heads = shared.where("q >= 0 and f = f1").select("s", "n", "f", "p")
    first = heads.groupBy("s").agg(F.min(F.struct("p", "n", "f")).alias("k")).select("s", F.col("k.f").alias("f1"), F.col("k.n").alias("n1"), F.col("k.p").alias("p1"))
    return pairs.unionByName(heads.join(first, "s").where(able(1)).select(F.col("f1").alias("a"), F.col("f").alias("b"))).distinct()


def _linkable(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """Those pairs (a, b) of classes whose signatures do not rule a link out. ``signed``: f, n, sig."""
    side = lambda k: signed.select(F.col("f").alias(k), F.col("n").alias(f"n{k}"), F.col("sig").alias(f"sig{k}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb, sa, sb = (batch.column(k).to_pylist() for k in range(2, 6))
            keep = [differing(x, y) <= n + m - 2 * needed(n, m) for n, m, x, y in zip(na, nb, sa, sb)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", "na", "nb", "siga", "sigb").mapInArrow(run, "a long, b long")


def _matrix(column: pa.Array) -> np.ndarray:
    """Signatures as rows of ``BRIEF_WORDS`` words, padded with zeros; a signature that is left out is all zeros."""
    out = np.zeros((len(column), BRIEF_WORDS), dtype=np.uint64)
    for k, sig in enumerate(column.to_pylist()):
        if sig:
            out[k, : len(sig) // 8] = np.frombuffer(sig, dtype="<u8")
    return out


def _words(n: np.ndarray) -> np.ndarray:
    """64-bit words of the signatures of sets of these sizes; 0 for those that are left out."""
    return np.where(n > BRIEF, 0, np.maximum(1, 1 << np.maximum(0, np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64) - 6)))


def unruled(n: np.ndarray, sig: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs (i, j), of sizes that allow a link, the signatures do not rule out."""
    words = np.minimum(_words(n[i]), _words(n[j]))
    keep = words == 0
    for w in np.unique(words[~keep]).tolist():
        k = np.flatnonzero(words == w)
        fold = (lambda r: sig[r, :w] ^ sig[r, w : 2 * w]) if w < BRIEF_WORDS else (lambda r: sig[r])  # noqa: B023, E731
        apart = np.bitwise_count(fold(i[k]) ^ fold(j[k])).sum(axis=1).astype(np.int64)
        keep[k] = apart <= n[i[k]] + n[j[k]] - 2 * needed(n[i[k]], n[j[k]])
    return keep


def list_pairs(n: np.ndarray, p: np.ndarray, group: np.ndarray, block: int = BLOCK, home: np.ndarray | None = None, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of one list (sorted by size) across groups (and homes, if given) that sizes and positions allow.

    Only entries that are ``own`` are compared with the others: all but those of the largest group, if not given. Blocks
    are skipped by their largest remainder (size less position) and size range.
    """
    home = np.arange(len(n)) if home is None else home
    if own is None:
        _, inverse, counts = np.unique(group, return_inverse=True, return_counts=True)
        own = inverse != counts.argmax()
    starts = np.arange(0, len(n), block)
    left = n - p
    most = np.maximum.reduceat(left, starts)
    low, high = n[starts], n[np.minimum(starts + block, len(n)) - 1]
    out_a, out_b = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    for x in np.flatnonzero(own).tolist():
        nx, rx = int(n[x]), int(left[x])
        able = (high * DEN >= nx * NUM) & (low * NUM <= nx * DEN) & (np.minimum(most, rx) >= needed(nx, low))
        for b in starts[able].tolist():
            y = np.arange(b, min(b + block, len(n)))
            ok = (group[y] != group[x]) & (home[y] != home[x]) & (n[y] * DEN >= nx * NUM) & (n[y] * NUM <= nx * DEN) & (np.minimum(left[y], rx) >= needed(nx, n[y]))
            ok &= ~own[y] | (y > x)  # a pair of two own entries once
            y = y[ok]
            out_a.append(np.minimum(x, y))
            out_b.append(np.maximum(x, y))
    return np.concatenate(out_a), np.concatenate(out_b)


def _short_pairs(lists: np.ndarray, n: np.ndarray, p: np.ndarray, group: np.ndarray, home: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of many short lists at once: rows that are 1, 2, .. places apart in one list."""
    out_a, out_b = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    left = n - p
    for apart in range(1, len(n)):
        i = np.flatnonzero(lists[apart:] == lists[:-apart])
        if not len(i):
            break
        j = i + apart
        ok = (group[i] != group[j]) & (home[i] != home[j]) & (own[i] | own[j]) & (n[i] * DEN >= n[j] * NUM) & (n[j] * DEN >= n[i] * NUM)
        ok &= np.minimum(left[i], left[j]) >= needed(n[i], n[j])
        out_a.append(i[ok])
        out_b.append(j[ok])
    return np.concatenate(out_a), np.concatenate(out_b)


def _across(entries: DataFrame, signed: DataFrame, ws: Workspace) -> DataFrame:
    """Distinct pairs (a, b) of classes in different components (column c) and with different pivots (r) that some list
    and the signatures allow. ``entries``: s, n, f, p, c, r.

    A list's entries outside its largest component are its own ones. They are split into parts of about ``COMPARISONS``
    comparisons; a part gets the whole list, its own entries first, and holds ``HOLD`` others at once.
    """
    per = entries.groupBy("s", "c").agg(F.count("*").alias("k"), F.min("r").alias("r0"), F.max("r").alias("r1"))
    per = per.groupBy("s").agg(F.sum("k").alias("m"), F.max("k").alias("k"), F.max_by("c", "k").alias("top"), F.min("r0").alias("r0"), F.max("r1").alias("r1"))
    per = ws.table("lists", per.where("m > k and r0 < r1").select("s", "top", F.ceil((F.col("m") - F.col("k")) * F.col("m") / COMPARISONS).cast("int").alias("parts")))
    brief = signed.select("f", F.when(F.col("n") <= BRIEF, F.col("sig")).alias("sig"))
    part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = entries.join(per, "s").join(brief, "f").withColumn("part", part)
    dealt = dealt.withColumn("own", (F.col("c") != F.col("top")) & (F.pmod(F.xxhash64("f"), F.col("parts")) == F.col("part")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            s, part, own, n, f, p, c, r, sig = cols
            if not len(s):
                return
            lists = np.cumsum(np.concatenate([[True], (s[1:] != s[:-1]) | (part[1:] != part[:-1])]))
            starts = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1]]))
            sizes = np.diff(np.append(starts, len(s)))
            short = np.flatnonzero(np.repeat(sizes <= SHORT_LIST, sizes))
            i, j = _short_pairs(lists[short], n[short], p[short], c[short], r[short], own[short])
            all_i, all_j = [short[i]], [short[j]]
            for a, m in zip(starts[sizes > SHORT_LIST].tolist(), sizes[sizes > SHORT_LIST].tolist()):
                k = a + np.argsort(n[a : a + m], kind="stable")
                i, j = list_pairs(n[k], p[k], c[k], BLOCK, r[k], own[k])
                all_i.append(k[i])
                all_j.append(k[j])
            i, j = np.concatenate(all_i), np.concatenate(all_j)
            for a in range(0, len(i), 1 << 16):
                x, y = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
                keep = unruled(n, sig, x, y)
                x, y = f[x[keep]], f[y[keep]]
                if len(x):
                    both = np.unique(np.column_stack([np.minimum(x, y), np.maximum(x, y)]), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))], names=["a", "b"])

        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(8)] + [_matrix(batch.column(8))]
            cols[3], cols[5] = cols[3].astype(np.int64), cols[5].astype(np.int64)
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            s, part = cols[0], cols[1]
            cut = len(s) - int(((s == s[-1]) & (part == part[-1])).sum())  # where the last list begins
            yield from found([x[:cut] for x in cols])
            held = [x[cut:] for x in cols]
            if len(held[0]) > HOLD:  # compare now, keep the own entries for what follows
                yield from found(held)
                held = [x[held[2]] for x in held]
        if held is not None:
            yield from found(held)

    ordered = dealt.repartition("s", "part").sortWithinPartitions("s", "part", F.col("own").desc(), "n", "f")
    return ordered.select("s", "part", "own", "n", "f", "p", "c", "r", "sig").mapInArrow(run, "a long, b long").distinct()


def near(small: DataFrame) -> DataFrame:
    """``small`` (a written table) to be broadcast where it has ``BROADCAST`` rows at most, else as it is."""
    return F.broadcast(small) if small.count() <= BROADCAST else small


def verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, ws: Workspace, name: str, differences: bool = False) -> DataFrame:
    """(a, b, same, na, nb) of each pair of classes: the exact overlap and sizes. With ``differences`` also what b lacks
    of a (a bit for each of a's sorted hashes) and what it has besides (hashes), where the two share half or more.

    ``classes``: f and the key h of a document of it. One text of each key wanted is dealt to its pivots a; a pivot of
    many pairs is dealt to several tasks.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / PER_PIVOT).cast("int").alias("k"))
    dealt = pairs.join(sizes, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("k")).cast("int"))
    members = dealt.select(F.col("b").alias("f"), "a", "salt", F.lit(1).alias("role"))
    hubs = dealt.select(F.col("a").alias("f"), "a", "salt", F.lit(0).alias("role")).distinct()
    wanted = ws.table(f"{name}-wanted", members.unionByName(hubs).join(classes.select("f", "h"), "f"))
    keys = near(ws.table(f"{name}-keys", wanted.select("h").distinct()))
    # copies of one text under one key are one row before they meet
    own = docs.join(keys, "h", "left_semi").groupBy("h").agg(F.min("text").alias("text"))
    texts = own.join(wanted, "h").select("a", "salt", "role", "f", "text")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("same", pa.int64()), ("na", pa.int64()), ("nb", pa.int64())] + [("minus", pa.binary()), ("plus", pa.binary())] * differences)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hashes = None, None
        for batch in batches:
            out = []
            rows = zip(*(batch.column(k).to_pylist() for k in range(4)), each_set(batch.column(4), width))
            for a, salt, role, f, h in rows:
                if set_key(h) != f:  # another text of that key
                    continue
                if role == 0:
                    hub, hashes = (a, salt), h.copy()
                elif hub == (a, salt):
                    i = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                    hit = hashes[i] == h
                    same = int(hit.sum())
                    told = (a, f, same, len(hashes), len(h))
                    if differences:
                        lacks = np.ones(len(hashes), dtype=bool)
                        lacks[i[hit]] = False
                        half = 2 * same >= len(hashes) + len(h) - same
                        told += (np.packbits(lacks).tobytes(), h[~hit].tobytes()) if half else (None, None)
                    out.append(told)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    ordered = texts.repartition("a", "salt").sortWithinPartitions("a", "salt", "role", "f")
    found = ws.table(name, ordered.mapInArrow(run, "a long, b long, same long, na long, nb long" + ", minus binary, plus binary" * differences))
    ws.drop(f"{name}-wanted", f"{name}-keys")
    return found


def related(na: int, n: np.ndarray, minus: np.ndarray, plus: list[np.ndarray], own: np.ndarray, joined: np.ndarray) -> list[tuple[int, int]]:
    """Linked pairs (x, y), x in ``own``, of sets told by their differences from one set of ``na`` elements.

    ``minus``: rows of bits of what each lacks of it; ``plus``: sorted hashes of what each has besides. The overlap of
    x and y is na - |minus x or minus y| + |plus x and plus y|, so neither set is needed again. Of x's links to sets
    that are ``joined`` with the one set the first is enough; of two others the later one is y.
    """
    where: dict[int, list[int]] = {}
    for k, h in enumerate(plus):
        for v in h.tolist():
            where.setdefault(v, []).append(k)
    out = []
    for x in own.tolist():
        able = np.flatnonzero((n * DEN >= n[x] * NUM) & (n * NUM <= n[x] * DEN))
        able = able[able != x]
        same = na - np.bitwise_count(minus[able] | minus[x]).sum(axis=1).astype(np.int64)
        shared: dict[int, int] = {}
        for v in plus[x].tolist():
            if len(where[v]) > 1:
                for k in where[v]:
                    shared[k] = shared.get(k, 0) + 1
        if shared:
            more = np.zeros(len(n), dtype=np.int64)
            more[list(shared)] = list(shared.values())
            same += more[able]
        found = able[same >= needed(n[x], n[able])]
        out += [(x, int(y)) for y in (*found[joined[found]][:1], *found[~joined[found] & (found > x)])]
    return out


def _derived(members: DataFrame, ws: Workspace) -> DataFrame:
    """Links (a, b) among the sets tried with one pivot, from their differences alone. ``members``: r, f, na, n, minus,
    plus, linked. Sets linked with the pivot are one component already, so only the others are compared with all.

    A pivot's work is split into parts of about ``COMPARISONS`` comparisons; a part gets all of the pivot's members, its
    own first, and holds these and ``HOLD`` others at once.
    """
    sizes = members.groupBy("r").agg(F.count("*").alias("m"), F.count_if(~F.col("linked")).alias("u")).where("u > 0")
    parts = near(ws.table("parts", sizes.select("r", F.least(F.col("u"), F.ceil(F.col("u") * F.col("m") / COMPARISONS)).cast("int").alias("k"))))
    dealt = members.join(parts, "r").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.withColumn("own", ~F.col("linked") & (F.pmod(F.xxhash64("f"), F.col("k")) == F.col("part")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def settle() -> Iterator[pa.RecordBatch]:
            own = np.array([k for k, r in enumerate(held) if r[4]], dtype=np.int64)
            if len(own):
                minus = np.vstack([np.frombuffer(r[2], dtype=np.uint8) for r in held])
                pairs = related(now[2], np.array([r[1] for r in held], dtype=np.int64), minus, [np.frombuffer(r[3], dtype=np.uint64) for r in held], own, np.array([r[5] for r in held]))
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array([held[x][0] for x, _ in pairs], pa.int64()), pa.array([held[y][0] for _, y in pairs], pa.int64())], names=["a", "b"])

        for batch in batches:
            for r, part, na, f, n, minus, plus, own, joined in zip(*(c.to_pylist() for c in batch.columns)):
                if (r, part, na) != now:
                    yield from settle()
                    now, held = (r, part, na), []
                held.append((f, n, minus, plus, own, joined))
                if len(held) > HOLD:
                    yield from settle()
                    held = [x for x in held if x[4]]
        yield from settle()

    ordered = dealt.repartition("r", "part").sortWithinPartitions("r", "part", F.col("own").desc(), "f")
    return ordered.select("r", "part", "na", "f", "n", "minus", "plus", "own", "linked").mapInArrow(run, "a long, b long")


def linked() -> Column:
    return F.col("same") * DEN >= (F.col("na") + F.col("nb") - F.col("same")) * NUM


def components(edges: DataFrame, ws: Workspace, name: str, rounds: int = 200) -> DataFrame:
    """(f, c): every node of the edges (a, b) and the least node of its component.

    Large-star and small-star steps alternate until nothing changes; a node with many edges is met with partial
    aggregates, and with joins of two written tables, whose hot keys Spark splits. The steps grow with the logarithm of
    the number of nodes; more than ``rounds`` are an error.
    """
    now = ws.table(f"{name}-0", edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    for step in range(1, rounds + 1):
        told = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if told == before:
            break
        before = told
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ws.table(f"{name}-least-{step}", both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        large = ws.table(f"{name}-large-{step}", both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = ws.table(f"{name}-{step}", small.select("e.u", "e.v").where("u <> v").distinct())
        ws.drop(f"{name}-{step - 1}", f"{name}-least-{step}", f"{name}-large-{step}")
    else:
        raise RuntimeError(f"components of {name} are not settled after {rounds} rounds")
    leaves = now.groupBy("u").agg(F.min("v").alias("c")).select(F.col("u").alias("f"), "c")
    return leaves.unionByName(now.select(F.col("v").alias("f"), F.col("v").alias("c")).distinct())


def row_key() -> Column:
    """Key of a row's doc_id and text, the same for rows equal in both; rows without a doc_id have one, too."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.col("text").cast("string"))


def join(documents: DataFrame, ws: Workspace, width: int = 5) -> DataFrame:
    """doc_id, n_shingles and component_id of every text."""
    return _linked(documents, ws, width).select("doc_id", "n_shingles", "component_id")


def _linked(documents: DataFrame, ws: Workspace, width: int) -> DataFrame:
    """The same with the key h and the component c of every text, which is null where it has no set.

    Texts are read whole twice (sizes, signatures and frequent shingles; prefixes); those of classes that are compared
    are dealt to their pivots.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_key().alias("h"))
    sets = ws.table("sets", _sets(docs, width))
    own = sets.where("kind = 0").select(F.col("x").alias("doc_id"), "n", "f", "h")
    signed = sets.where("kind = 2").select(F.col("x").alias("f"), "n", "sig").dropDuplicates(["f"])
    frequent = sets.where("kind = 1").groupBy(F.col("x").alias("h")).agg(F.sum("n").alias("c")).orderBy(F.col("c").desc(), "h").limit(FREQUENT)
    classes = ws.table("classes", own.where("n > 0").groupBy("f").agg(F.min("doc_id").alias("doc_id"), F.min("h").alias("h")))

    postings = _postings(docs, [(r["h"], r["c"]) for r in frequent.collect()], ws, width)
    shared = ws.table("shared", _shared(postings))
    signed = ws.table("signed", signed.join(shared.select("f").distinct(), "f", "left_semi"))
    tried = verify(ws.table("asked", _linkable(_pivots(shared), signed)), classes, docs, width, ws, "pivots", differences=True)
    stars = tried.where(linked()).select("a", "b")
    far = 1 - F.col("same") / (F.col("na") + F.col("nb") - F.col("same"))
    # a set's home is the nearest pivot that it was compared with; all that share one are settled by their differences
    homes = tried.where("minus is not null").groupBy(F.col("b").alias("f")).agg(F.min(F.struct(far.alias("d"), F.col("a").alias("r"))).alias("h")).select("f", "h.r", "h.d")
    homes = ws.table("homes", homes)
    members = tried.join(homes.select(F.col("f").alias("b"), F.col("r").alias("a")), ["a", "b"])
    members = members.select(F.col("a").alias("r"), F.col("b").alias("f"), "na", F.col("nb").alias("n"), "minus", "plus", linked().alias("linked"))
    settled = ws.table("derived-links", _derived(ws.table("members", members), ws))
    labels = ws.table("labels", components(stars.unionByName(settled), ws, "stars"))

    # a pivot is its own home unless it has a nearer one; a set without a home is one for itself
    known = labels.join(homes.select("f", "r"), "f", "full")
    entries = shared.select("s", "n", "f", "p").join(known, "f", "left").withColumn("c", F.coalesce("c", "f")).withColumn("r", F.coalesce("r", "f"))
    entries = ws.table("entries", entries)
    ws.drop("shared", "asked", "members", "parts")
    found = _across(entries, signed, ws).join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    open_pairs = ws.table("across", _linkable(found, signed))
    ws.drop("entries", "lists", "signed")
    # each side's answer comes from its home, if it is linked with it, where that decides
    pivot = homes.where(F.col("d") <= 1 - NUM / DEN + 1e-12)
    side = lambda k: pivot.select(F.col("f").alias(k), F.col("r").alias(f"r{k}"), F.col("d").alias(f"d{k}"))
    derived = open_pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    derived = derived.select("a", "b", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb"), F.coalesce("da", F.lit(0.0)).alias("da"), F.coalesce("db", F.lit(0.0)).alias("db"))
    derived = ws.table("derived", derived.select("a", "b", F.least("ra", "rb").alias("r"), F.greatest("ra", "rb").alias("q"), (F.col("da") + F.col("db")).alias("slack")))
    roots = verify(derived.select(F.col("r").alias("a"), F.col("q").alias("b")).distinct(), classes, docs, width, ws, "roots")
    apart = derived.join(roots.select(F.col("a").alias("r"), F.col("b").alias("q"), far.alias("d"), linked().alias("one")), ["r", "q"], "left")
    undecided = apart.where(~F.coalesce("one", F.lit(False)) & (F.coalesce("d", F.lit(0.0)) - F.col("slack") <= 1 - NUM / DEN + 1e-9))
    undecided = undecided.where(~((F.col("a") == F.col("r")) & (F.col("b") == F.col("q"))) & ~((F.col("a") == F.col("q")) & (F.col("b") == F.col("r"))))
    rest = verify(undecided.select("a", "b"), classes, docs, width, ws, "rest")

    edges = stars.unionByName(settled).unionByName(roots.where(linked()).select("a", "b")).unionByName(rest.where(linked()).select("a", "b"))
    final = ws.table("components", components(edges, ws, "all"))
    named = ws.table("named", classes.join(final, "f", "left").withColumn("c", F.coalesce("c", "f")).select("f", "c", "doc_id"))
    ids = ws.table("ids", named.groupBy("c").agg(F.min("doc_id").alias("component_id")))
    by_class = ws.table("by-class", named.select("f", "c").join(ids, "c"))
    ws.drop("classes", "pivots", "homes", "derived-links", "labels", "across", "derived", "roots", "rest", "components", "named", "ids")
    out = own.join(by_class, "f", "left")
    alone = F.col("n") == 0
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "h", "c")


def keep_first(documents: DataFrame, ws: Workspace, width: int = 5) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with its columns; all documents without a set.

    Of a component's rows with that doc_id the first by text stays (of equal texts the first by the other columns'
    hash), as where no row of a component has a doc_id. Only keys are grouped; texts meet the keys of survivors once.
    """
    columns = documents.columns
    key, own, rows, put = unused(columns, "h", "own", "rows", "put")
    found = ws.table("joined", _linked(documents, ws, width))
    ws.drop("sets", "by-class")
    first = found.where("c is not null and doc_id <=> component_id").groupBy("c").agg(F.count("*").alias(rows), F.min("h").alias("h0"), F.max("h").alias("h1"))
    first = ws.table("first", first)
    single = first.where(F.col(rows) == 1).select(F.col("h0").alias(key))
    single = near(ws.table("single", single))
    inked = F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    docs = documents.withColumn(key, row_key())
    kept = docs.where(inked).join(single, key, "left_semi").select(*columns)
    # several rows that could stay: the smallest is found by partial aggregates, however many there are
    many = found.where("c is not null and doc_id <=> component_id").join(first.where(F.col(rows) > 1), "c").select(F.col("h").alias(key), F.col("c").alias(own)).distinct()
    plain = [f.name for f in documents.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    order = F.struct(F.col("text").cast("string"), F.xxhash64(*plain))
    several = docs.where(inked).join(many, key).groupBy(own).agg(F.min_by(F.struct(*columns), order).alias(put)).select(f"{put}.*")
    return kept.unionByName(several).unionByName(documents.where(~inked))


#: The whole report in SQL: all pairs that share a shingle, and everything reachable by links.
SQL = r"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT DISTINCT rid, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT rid, count(*) AS n FROM grams GROUP BY rid),
pairs AS (SELECT a.rid AS a, b.rid AS b, count(*) AS same FROM grams a JOIN grams b ON a.g = b.g AND a.rid <> b.rid GROUP BY a.rid, b.rid),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.rid = a JOIN sizes y ON y.rid = b WHERE 100 * same >= 75 * (x.n + y.n - same)),
reach AS (SELECT rid, rid AS r FROM docs UNION SELECT reach.rid, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, c.component_id FROM docs d LEFT JOIN sizes s USING (rid) JOIN (SELECT reach.rid, min(doc_id) AS component_id FROM reach JOIN docs ON docs.rid = reach.r GROUP BY reach.rid) c USING (rid)
"""
