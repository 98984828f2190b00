import hashlib
import random
from collections import Counter

import pytest

from grainmill.llm import substring_dedup as sd
from tests.llm.conftest import MESSY


def brute(items, width):
    rows = [(i, (t or "").encode().split()) for i, t, *_ in items]
    seen = Counter(tuple(w[k : k + width]) for _, w in rows for k in range(len(w) - width + 1))
    out = []
    for i, w in rows:
        gone = {j for k in range(len(w) - width + 1) if seen[tuple(w[k : k + width])] > 1 for j in range(k, k + width)}
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return sorted(out, key=str)


def told(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()), key=str)


def planted(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(200)}"
    passages = [[word() for _ in range(rng.randrange(8, 40))] for _ in range(6)]
    items = []
    for i in range(60):
        w = []
        for _ in range(rng.randrange(0, 4)):
            w += [word() for _ in range(rng.randrange(0, 25))]
            w += rng.choice(passages)[: rng.randrange(5, 40)]
        if rng.random() < 0.2:
            w += ["again"] * rng.randrange(0, 30)
        items.append((i, " ".join(w), "en", "s"))
    return items + [(100, items[3][1], "en", "s"), (101, items[3][1] + " x", "en", "s")]


@pytest.mark.parametrize("width,shard", [(12, 10_000), (12, 30), (9, 200), (9, 1)])
def test_planted(frame, ws, width, shard):
    items = planted(width + shard)
    assert told(sd.remove_repeats(frame(items), ws, width, shard)) == brute(items, width)


def test_messy(messy, ws):
    assert told(sd.remove_repeats(messy, ws)) == brute(MESSY, 35)


def test_documents(documents, ws):
    assert told(sd.remove_repeats(documents, ws)) == brute([(r["doc_id"], r["text"]) for r in documents.collect()], 35)


def test_empty(empty, ws):
    assert sd.remove_repeats(empty, ws).count() == 0


def test_automaton_matching_statistics():
    rng = random.Random(2)
    texts = [[rng.choice("abc") for _ in range(30)] for _ in range(4)]
    a = sd.SuffixAutomaton()
    for t in texts:
        a.add(t)
    a.finish()
    grams = lambda n: Counter(tuple(t[i : i + n]) for t in texts for i in range(len(t) - n + 1))
    counts = {n: grams(n) for n in range(1, 31)}
    own = [rng.choice("abcd") for _ in range(50)]
    for least in (1, 2, 3):
        for end, got in enumerate(a.matching(own, least), 1):
            want = max((n for n in range(1, min(end, 30) + 1) if counts[n][tuple(own[end - n : end])] >= least), default=0)
            assert got == want


def test_known_passages_go(frame, spark, ws):
    passage = " ".join(f"p{i}" for i in range(50))
    ref = spark.createDataFrame([(passage,), (None,), ("",)], "text string")
    got = {r["doc_id"]: r["text"] for r in sd.remove_known(frame([(1, f"a b {passage} c", "en", "s"), (2, "clean", "en", "s"), (3, None, "en", "s")]), ref, ws).collect()}
    assert got == {1: "a b c", 2: "clean", 3: None}
    with pytest.raises(ValueError):
        sd.remove_known(frame([]), ref, ws, most_words=10)


def test_a_frequent_passage_in_small_shards(frame, ws):
    """A passage in many different surroundings, whose edges make large shards of different sequences."""
    rng = random.Random(8)
    passage = [f"p{k}" for k in range(14)]
    items = []
    for i in range(90):
        before, after = ([f"u{rng.randrange(40)}" for _ in range(rng.randrange(0, 12))] for _ in range(2))
        items.append((i, " ".join(before + passage + after), "en", "s"))
    for shard in (10_000, 60):
        assert told(sd.remove_repeats(frame(items), ws, 12, shard)) == brute(items, 12)
