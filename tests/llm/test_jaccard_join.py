import random

import numpy as np
import pyarrow as pa
import pytest

from grainmill.llm import jaccard_join as jj
from tests.llm.conftest import MESSY


def brute(items):
    sets = []
    for i, t, *_ in items:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a], sets[b]
            same = x[1] and y[1] and 100 * len(x[1] & y[1]) >= 75 * len(x[1] | y[1])
            if same and ((x[0] is not None and y[0] is not None) or x[1] == y[1]):
                parent[find(a)] = find(b)
    out = []
    for a, (i, s) in enumerate(sets):
        ids = [sets[b][0] for b in range(len(sets)) if find(b) == find(a) and sets[b][0] is not None]
        out.append((i, len(s), (min(ids) if ids else None) if s else i))
    return sorted(out, key=str)


def told(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def test_messy(messy, ws):
    assert told(jj.join(messy, ws)) == brute(MESSY)


def test_documents(documents, ws):
    assert told(jj.join(documents, ws)) == brute([(r["doc_id"], r["text"]) for r in documents.collect()])


def test_chains_passages_and_borders(frame, ws):
    """Chains of edits whose ends are not similar, a passage that all share, and pairs at the border of 3/4."""
    rng = random.Random(3)
    word = lambda: "w" + str(rng.randrange(4000))
    passage = [word() for _ in range(30)]
    items, n = [], 0
    for _ in range(12):
        own = [word() for _ in range(rng.randrange(8, 120))]
        for _ in range(rng.randrange(1, 12)):
            items.append((n, " ".join(own + (passage if rng.random() < 0.5 else [])), "en", "s"))
            n += 1
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(len(own))] = word()
    base = [f"b{k}" for k in range(11)]  # 7 shingles
    items += [(n, " ".join(base), "en", "s"), (n + 1, " ".join(base[:-1]), "en", "s"), (n + 2, " ".join(base[:-2]), "en", "s"), (n + 3, " ".join(base[:-1] + ["z"]), "en", "s")]
    rng.shuffle(items)
    assert told(jj.join(frame(items), ws)) == brute(items)


def test_large_group(frame, ws, monkeypatch):
    monkeypatch.setattr(jj, "PER_PIVOT", 20)
    rng = random.Random(5)
    base = [f"v{k}" for k in range(80)]
    items = []
    for i in range(150):
        own = list(base)
        for _ in range(rng.randrange(0, 5)):
            own[rng.randrange(80)] = f"e{rng.randrange(9999)}"
        items.append((i, " ".join(own), "en", "s"))
    assert told(jj.join(frame(items), ws)) == brute(items)


@pytest.mark.parametrize("seed", [1, 2])
def test_group_at_the_border(frame, ws, monkeypatch, seed):
    """Copies of which many are just not similar to the least edited one, in several parts."""
    monkeypatch.setattr(jj, "COMPARISONS", 500)
    rng = random.Random(seed)
    base = [f"v{k}" for k in range(100)]
    items = []
    for i in range(120):
        own = list(base)
        for _ in range(rng.randrange(1, 7)):
            own[rng.randrange(100)] = f"e{rng.randrange(40)}"
        items.append((i, " ".join(own), "en", "s"))
    assert told(jj.join(frame(items), ws)) == brute(items)


def test_overlaps_from_differences():
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 1 << 60, 60).astype(np.uint64))
    extra = rng.integers(0, 1 << 60, 30).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(40, 60)], rng.permutation(extra)[: rng.integers(0, 9)]])) for _ in range(40)]
    minus = np.vstack([np.packbits(~np.isin(base, s)) for s in sets])
    plus = [np.setdiff1d(s, base) for s in sets]
    near = lambda x, y: 4 * len(np.intersect1d(x, y)) >= 3 * len(np.union1d(x, y))
    joined = np.array([near(s, base) for s in sets])
    own = np.flatnonzero(~joined)
    got = set(jj.related(len(base), np.array([len(s) for s in sets]), minus, plus, own, joined))
    linked = {(x, y) for x in own.tolist() for y in range(40) if x != y and near(sets[x], sets[y])}
    assert got <= linked and len(own) > 5
    for x in own.tolist():
        assert any(joined[y] for z, y in got if z == x) == any(joined[y] for z, y in linked if z == x)
        assert {y for z, y in got if z == x and not joined[y]} == {y for z, y in linked if z == x and not joined[y] and y > x}


@pytest.mark.parametrize("block", [1, 3, 128])
def test_block_skipping_loses_no_pair(block):
    rng = np.random.default_rng(1)
    n = np.sort(rng.integers(4, 60, 200))
    p = (rng.random(200) * n / 4).astype(int)
    group = rng.integers(0, 5, 200)
    a, b = jj.list_pairs(n, p, group, block)
    want = {
        (i, j)
        for i in range(200)
        for j in range(i + 1, 200)
        if group[i] != group[j] and 4 * n[i] >= 3 * n[j] and min(n[i] - p[i], n[j] - p[j]) >= jj.needed(int(n[i]), int(n[j]))
    }
    got = list(zip(a.tolist(), b.tolist()))
    assert set(got) == want and len(got) == len(want)


def test_empty(empty, ws):
    assert jj.join(empty, ws).count() == 0


def test_keep_first(messy, ws):
    kept = jj.keep_first(messy, ws)
    assert kept.columns == messy.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert ids == sorted([3, 4, 6, 7, 8, 9, 11, 13, None, None], key=str)


def test_signatures_never_rule_out_a_link():
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 1 << 63, rng.integers(1, 90)).astype(np.uint64)) for _ in range(20)]
    for k in range(160):  # copies that lose and gain some, and large sets whose signatures are left out
        base = sets[k % 20] if k < 140 else np.unique(rng.integers(0, 1 << 63, 1500).astype(np.uint64))
        more = rng.integers(0, 1 << 63, rng.integers(0, 1 + len(base) // 3)).astype(np.uint64)
        sets += [base, np.unique(np.concatenate([rng.permutation(base)[rng.integers(0, 1 + len(base) // 4) :], more]))]
    n = np.array([len(s) for s in sets])
    sigs = [jj.signature(s) if len(s) else b"\0" * 8 for s in sets]
    matrix = jj._matrix(pa.array([g if len(s) <= jj.BRIEF else None for g, s in zip(sigs, sets)], pa.binary()))
    i, j = np.triu_indices(len(sets), 1)
    fit = (n[i] > 0) & (n[j] > 0) & (4 * n[i] >= 3 * n[j]) & (4 * n[j] >= 3 * n[i])
    i, j = i[fit], j[fit]
    kept = jj.unruled(n, matrix, i, j)
    same = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)])
    by_pair = np.array([jj.differing(sigs[a], sigs[b]) for a, b in zip(i, j)])
    assert (by_pair <= n[i] + n[j] - 2 * same).all()
    linked = same >= jj.needed(n[i], n[j])
    assert kept[linked].all() and linked.sum() > 50 and (~kept).sum() > 100


@pytest.mark.parametrize("seed", [3])
def test_long_lists_in_parts(frame, ws, monkeypatch, seed):
    """Lists dealt to several tasks, searched in parts and streamed, with short lists searched one by one."""
    for name, value in (("LIST_PART", 16), ("COMPARISONS", 300), ("HOLD", 8), ("SHORT_LIST", 3), ("BROADCAST", 5), ("LOCAL", 2), ("BLOCK", 4)):
        monkeypatch.setattr(jj, name, value)
    rng = random.Random(seed)
    items = []
    for g in range(4):
        base = [f"g{g % 2}v{k}" for k in range(90)]
        for _ in range(g * 45):
            own = base[: 90 - 12 * (g // 2)]
            for _ in range(rng.randrange(0, 7)):
                own[rng.randrange(len(own))] = f"e{rng.randrange(60)}"
            items.append((len(items), " ".join(own), "en", "s"))
    rng.shuffle(items)
    assert told(jj.join(frame(items), ws)) == brute(items)
