"""Rows without a doc_id and rows that share one, against a brute-force version that goes by texts alone."""

import random

import pytest

from grainmill.llm import jaccard_join as jj


def brute(items):
    """(components of rows, survivors): lists of row numbers."""
    sets = []
    for _, t, *_ in items:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    groups = {}
    for a in range(len(sets)):
        groups.setdefault(find(a) if sets[a] else ("alone", a), []).append(a)
    first = [min(g, key=lambda a: (items[a][0] is None, items[a][0] or 0, items[a][1] or "")) for g in groups.values()]
    return list(groups.values()), first


def items():
    rng = random.Random(9)
    out = []
    for g in range(12):
        own = [f"g{g}w{k}" for k in range(40)]
        for _ in range(rng.randrange(1, 7)):
            out.append((None if g % 3 == 0 or rng.random() < 0.5 else rng.randrange(9), " ".join(own), "en", "s"))
            own[rng.randrange(40)] = f"e{rng.randrange(9999)}"
    # a chain whose middle has no doc_id, copies and blanks without one, two unlike texts of one doc_id
    base = [f"c{k}" for k in range(30)]
    steps = [base, base[:2] + ["x"] + base[3:], ["y"] + base[1:2] + ["x"] + base[3:28] + ["z"] + base[29:]]
    out += [(50, " ".join(steps[0]), "en", "s"), (None, " ".join(steps[1]), "en", "s"), (51, " ".join(steps[2]), "en", "s")]
    copy = "the very same words in every copy of this text here"
    out += [(None, copy, "en", "s")] * 3 + [(None, "", "en", "s"), (None, None, "en", "s"), (60, copy, "en", "s")]
    out += [(None, "only rows without a key hold these words of a text", "en", "s")] * 2
    return out + [(70, "one text of a shared key that is like no other", "en", "s"), (70, "and quite another one that is like nothing before", "en", "s")]


def test_components(frame, ws):
    rows = items()
    want = []
    for g in brute(rows)[0]:
        ids = [rows[a][0] for a in g if rows[a][0] is not None]
        want += [(rows[a][0], min(ids) if ids else None) for a in g]
    got = [(r["doc_id"], r["component_id"]) for r in jj.join(frame(rows), ws).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("parts", [1, 7])
def test_survivors(frame, ws, parts):
    rows = items()
    want = [(rows[a][0], rows[a][1]) for a in brute(rows)[1]]
    got = [(r["doc_id"], r["text"]) for r in jj.keep_first(frame(rows).repartition(parts), ws).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
