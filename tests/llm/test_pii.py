import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from grainmill.llm import pii
from grainmill.llm.text import joined, sha256
from tests.llm.conftest import MESSY


def brute(text):
    text = text or ""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda s: [c for c in s if c in "0123456789"]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and pii.luhn("".join(digits(m[0])))]
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return out


TEXTS = ["a@b.c@d.ef x@y", "1.2.3.4.5.6.7.8 256.1.1.1 1.1.1.256 01.002.0003.4", "4111 1111 1111 1111-", "4111-1111-1111-1111 4111111111111112", "+1 (555) 010-9999. +49 30 1234567", "++1+1 555 555 5555", "é a.b@ü.de ä@x.de 😀 a@x.de", "@@a@a.a."]


@pytest.mark.parametrize("text", [t for _, t, *_ in MESSY] + TEXTS)
def test_base_equals_brute_force(text):
    assert pii.base_spans(text or "") == brute(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.c", "@", ".", "-", " ", "1", "25", "255", "4111", "1111", "+", "(", ")", "é", "😀", "\n", "_%"]), max_size=40).map("".join))
def test_base_on_fuzzed_texts(text):
    assert pii.base_spans(text) == brute(text)


def test_documents(documents, ws):
    got = {r["doc_id"]: r for r in pii.digest(pii.find_pii(documents, ws)).collect()}
    for r in documents.collect():
        spans = brute(r["text"])
        g = got[r["doc_id"]]
        assert [g[f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in spans) for k in pii.BASE]
        assert g["base_sha256"] == sha256(joined(spans))


FILL = "weather river stone garden music window paper bridge market train summer winter light water table forest north".split()
GIVEN = ["Anna", "Peter", "Laura", "Thomas", "Marie", "Daniel", "Ulrik", "Tamsin", "Oisin", "Yara"]  # the last four are not listed
FAMILY = ["Schmidt", "Jones", "Keller", "Moreau", "Larsen", "Pereira", "Novak", "Okafor"]
PLACES = ["Blue River", "Stone Bridge", "Green Forest", "Old Market", "Grand Canal", "Long Valley"]


def planted(n, seed):
    """(doc_id, text, spans that are personal data, spans that only look so)."""
    import random

    rng = random.Random(seed)
    fill = lambda: " ".join(rng.choice(FILL) for _ in range(rng.randrange(3, 9)))
    digits = lambda k: "".join(rng.choice("123456789") for _ in range(k))
    out = []
    for i in range(n):
        text, true, false = fill() + " ", [], []
        for _ in range(3):
            person = f"{rng.choice(GIVEN)} {rng.choice(FAMILY)}"
            number = f"{rng.randrange(100, 600)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}"
            kind, before, span, after, good = rng.choice([
                ("name", rng.choice(["signed by Mr ", "written by Dr ", "best regards "]), person, " of the office ", True),
                ("name", rng.choice(["we walked to ", "a view of ", "the old "]), rng.choice(PLACES), " in the evening ", False),
                ("ssn", rng.choice(["his ssn ", "social security number "]), number, " on the form ", True),
                ("ssn", rng.choice(["see part ", "item ", "order "]), number, " in the catalogue ", False),
                ("account", rng.choice(["paid into account ", "from konto "]), digits(10), " on monday ", True),
                ("account", rng.choice(["invoice ", "ticket ", "serial "]), digits(10), " of the batch ", False),
            ])
            (true if good else false).append((kind, len(text) + len(before), len(text) + len(before) + len(span)))
            text += before + span + after + fill() + ". "
        out.append((i, text, true, false))
    return out


def test_planted_truth(frame, ws):
    """Spans that no labeler knows are found by the words around them, and decoys are left alone."""
    docs = planted(600, 1)
    got = {r["doc_id"]: {(s["kind"], s["start"], s["end"]) for s in r["spans"]} for r in pii.find_pii(frame([(i, t, "en", "s") for i, t, *_ in docs]), ws).collect()}
    for kind in ("name", "ssn", "account"):
        true = [(i, s) for i, _, spans, _ in docs for s in spans if s[0] == kind]
        found = [(i, s) for i in got for s in got[i] if s[0] == kind]
        hits = sum(s in got[i] for i, s in true)
        assert hits / len(true) > 0.95 and hits / len(found) > 0.95, (kind, hits, len(true), len(found))
    unlisted = [(i, s) for i, t, spans, _ in docs for s in spans if t[s[1] : s[2]].split()[0] in GIVEN[6:]]
    assert sum(s in got[i] for i, s in unlisted) / len(unlisted) > 0.9 and len(unlisted) > 50


def test_labelers_that_lie_are_found_out():
    """Votes drawn with known reliabilities: EM gets these back, and the truth better than a majority does."""
    import numpy as np

    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.3
    right, speaks = np.array([0.95, 0.8, 0.7, 0.4]), np.array([0.7, 0.8, 0.6, 0.9])
    votes = np.where(rng.random((20_000, 4)) < speaks, np.where((rng.random((20_000, 4)) < right) == truth[:, None], 1, -1), 0)
    patterns, where, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    prior, table, p = pii.reliabilities(patterns, counts.astype(float))
    assert abs(prior - 0.3) < 0.05
    assert all(abs(table[j, 1, 2] - right[j]) < 0.06 and abs(table[j, 0, 0] - right[j]) < 0.06 for j in range(4))
    told = p[where.ravel()] > 0.5
    assert (told == truth).mean() > (((votes.sum(axis=1) > 0) == truth).mean()) + 0.03


def test_sample_does_not_depend_on_the_dealing(frame, ws, spark):
    import numpy as np

    from grainmill.storage import Workspace

    docs = frame([(i, t, "en", "s") for i, t, *_ in planted(120, 4)] * 2)
    one, other = (pii.learn(d, Workspace(spark, "t"), sample=40) for d in (docs.repartition(1), docs.repartition(7)))
    assert np.allclose(one, other)


def test_messy_and_empty(messy, empty, ws):
    assert pii.digest(pii.find_pii(messy, ws)).count() == len(MESSY)
    assert pii.digest(pii.find_pii(empty, ws)).count() == 0
    out = pii.redact(messy, ws)
    assert out.columns == messy.columns and out.count() == len(MESSY)


def test_redact(frame, ws):
    out = pii.redact(frame([(1, "mail a@b.co or 4111 1111 1111 1111 now", "en", "s"), (2, "clean text", "en", "s")]), ws).orderBy("doc_id").collect()
    assert [r["text"] for r in out] == ["mail <EMAIL> or <CARD> now", "clean text"]
    assert out[0]["n_chars"] == len("mail <EMAIL> or <CARD> now")
