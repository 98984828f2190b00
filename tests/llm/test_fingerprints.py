import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from grainmill.llm import fingerprints as fp
from grainmill.llm.text import sha256, shingles
from tests.llm.conftest import MESSY


def shingle_set(text):
    """Written out without the operator's code."""
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def exact(a, b):
    x, y = shingle_set(a), shingle_set(b)
    return float(x == y) if not x or not y else len(x & y) / len(x | y)


def in_order(items):
    h = lambda t: ((xxhash.xxh64_intdigest(t.encode(), seed=42) + (1 << 63)) % (1 << 64)) - (1 << 63)
    return sorted(items, key=lambda r: (r[0] is not None, r[0] or 0, h(r[1] or "")), reverse=True)


def check(items, rows):
    order = in_order(items)
    want = []
    for k, (i, t, *_) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        want.append((i, len(t), sha256(edited), fp.pack(fp.sketch(t)), fp.pack(fp.sketch(edited)), exact(t, edited), exact(t, nxt)))
    got = [tuple(r) for r in rows]
    key = lambda r: (str(r[0]), r[1], r[2])
    want.sort(key=key)
    got.sort(key=key)
    assert [w[:5] for w in want] == [g[:5] for g in got]
    gaps = [(abs(g[k] - w[k]), w[k]) for w, g in zip(want, got) for k in (5, 6)]
    assert all(gap <= 5 * (w * (1 - w) / fp.K) ** 0.5 + 1e-9 for gap, w in gaps) and sum(gap for gap, _ in gaps) / len(gaps) < 0.02
    marks = {}
    for _, t, *_ in items:  # equal sets have equal fingerprints; other sets of up to k shingles have others
        marks.setdefault(frozenset(shingle_set(t)), set()).add(fp.pack(fp.sketch(t)))
    assert all(len(x) == 1 for x in marks.values())
    small = [mark for x, (mark,) in marks.items() if len(x) <= fp.K]
    assert len(small) == len(set(small))


def test_messy(messy, ws):
    check(MESSY, fp.compare_edited(messy, ws).collect())


def test_documents_over_many_ranges(documents, ws):
    items = [(r["doc_id"], r["text"]) for r in documents.collect()]
    check(items, fp.compare_edited(documents, ws).collect())
    check(items, fp.compare_edited(documents, ws, range_docs=7).collect())


def test_rows_of_one_doc_id_over_many_ranges(frame, ws):
    items = [(1, f"w{k} of a text with some words of its own {k % 7} more", "en", "s") for k in range(60)] + [(1, "all the very same words here", "en", "s")] * 40 + [(2, "", "en", "s")]
    check(items, fp.compare_edited(frame(items), ws, range_docs=5).collect())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb", " ", "\n", "É", "😀", "cc dd", "e f g h ", "ij"]), max_size=40).map("".join), st.lists(st.sampled_from(["x", "yy ", " ", "é", "zz z"]), max_size=30).map("".join))
def test_sketches_of_parts_make_the_whole(text, following):
    (edited,), (mark,) = fp.edited_sketches([text], [following], 8)
    assert edited == text[: len(text) - len(text) // 3] + following[: len(text) // 3]
    assert (mark == fp.sketch(edited, 8)).all() and len(mark) == len(fp.sketch(edited, 8))


def test_one_document_is_its_own_next(frame, ws):
    r, = fp.compare_edited(frame([(1, "a b c d e f g h i", "en", "s")]), ws).collect()
    assert r["near_next"] == 1.0


def test_empty(empty, ws):
    assert fp.compare_edited(empty, ws).count() == 0


def test_merge_distinct_and_containment():
    a, b = " ".join(f"a{i}" for i in range(3000)), " ".join(f"b{i}" for i in range(3000))
    both = np.union1d(shingles(a), shingles(b))
    merged = fp.merge(fp.sketch(a), fp.sketch(b))
    assert (merged == np.unique(both >> fp.BITS)[: fp.K]).all()
    assert fp.distinct(merged) == pytest.approx(len(both), rel=0.35)
    assert fp.containment(fp.sketch(a), fp.merge(fp.sketch(a), fp.sketch(b))) > 0.7
    assert (fp.unpack(fp.pack(merged)) == merged).all() and len(fp.unpack("")) == 0


def test_general_operator(documents):
    got = fp.fingerprints(documents).collect()
    assert len(got) == documents.count() and all(r["n_shingles"] >= 0 for r in got)


def test_ranges_of_keys():
    import random

    rng = random.Random(3)
    keys = [(None if rng.random() < 0.2 else rng.randrange(-3, 5), rng.randrange(-(1 << 63), 1 << 63)) for _ in range(400)]
    order = sorted(set(keys), key=lambda t: (t[0] is not None, t[0] or 0, t[1]), reverse=True)
    tops = sorted({order[0], *rng.sample(order, 30)}, key=lambda t: (t[0] is not None, t[0] or 0, t[1]), reverse=True)
    want = [max(k for k, t in enumerate(tops) if order.index(t) <= order.index(key)) for key in keys]
    ids, null = np.array([i or 0 for i, _ in keys]), np.array([i is None for i, _ in keys])
    assert fp.Cuts(tops).find(ids, null, np.array([h for _, h in keys])).tolist() == want
