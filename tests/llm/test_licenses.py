import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from grainmill.llm import licenses
from tests.llm.conftest import MESSY

COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base(text):
    w = words(text)
    found = [(i, label) for phrase, label in PHRASES.items() for i in range(len(w)) if w[i : i + phrase.count(" ") + 1] == phrase.split()]
    starts = [i for i, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def fuzzy(text):
    """label -> fewest errors, and the best likeness, over all stretches of whole words of about the notice's length."""
    w, labels, best = words(text), set(), 0.0
    for n in licenses.NOTICES:
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                part = " ".join(w[i:j])
                if len(part) > n.size + n.edits:
                    break
                if len(part) >= n.size - n.edits and part.endswith(n.tail):
                    d = distance(part[: len(part) - len(n.tail)], n.head)
                    if d <= n.edits:
                        labels.add(n.label)
                        best = max(best, 1 - d / n.size)
    return labels, best


def told(text):
    n, spans = licenses.finder().spans(text)
    own, other = [s for s in spans if s[0]], [s for s in spans if not s[0]]
    starts = [s[2] for s in own]
    return (n, len(own), min(starts, default=None), max(starts, default=None), ",".join(sorted({s[1] for s in own}))), ({s[1] for s in other}, max((s[5] for s in other), default=0.0))


ODD = ["Under the MIT-License!", "under the mit licenses", "xunder the mit license", "under  the\nmit\x00license under the mit license", "cc by nc cc by nc", "CC BY-NC", "cc by ncé", "apache license version 2.0", "Apache License, Version 20", "ÀPACHE license version 2", "cc", "😀 cc by nc 😀"]


@pytest.mark.parametrize("text", [t for _, t, *_ in MESSY] + ODD)
def test_base(text):
    assert told(text)[0] == base(text)


def edited(rng, text, n):
    letters = list(text)
    for _ in range(n):
        at, kind = rng.randrange(len(letters)), rng.randrange(3)
        if kind == 0:
            letters[at] = rng.choice("abcxyz ")
        elif kind == 1:
            del letters[at]
        else:
            letters.insert(at, rng.choice("abcxyz "))
    return "".join(letters)


def test_edited_notices_equal_brute_force():
    """Notices with up to one error too many, among other words: the same labels and likeness as all stretches give."""
    rng = random.Random(5)
    for k in range(400):
        n = licenses.NOTICES[k % len(licenses.NOTICES)]
        body = edited(rng, n.head, rng.randrange(n.edits + 2)) + n.tail
        text = " ".join(["the project is", body, rng.choice(["of course", "0", "", "license", "the mit license"])])
        if rng.random() < 0.3:
            text += " and " + edited(rng, n.head + n.tail, 1)
        got, want = told(text), fuzzy(text)
        assert got[1][0] == want[0], text
        assert got[1][1] == pytest.approx(want[1]), text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("under the mit license apache version 2 3 cc by nc gnu general public licence lesser all rights reserved é".split()), max_size=14))
def test_fuzzed_words(parts):
    text = " ".join(parts)
    got, want = told(text), fuzzy(text)
    assert got[0] == base(text) and got[1][0] == want[0] and got[1][1] == pytest.approx(want[1])


def test_no_notice_passes_for_another_label():
    for n in licenses.NOTICES:
        assert fuzzy(n.head + n.tail)[0] == {n.label}
    for text in ("under the bsd license", "apache license version 1", "gnu general public license version 1", "cc by sa", "creative commons attribution", "all rights reversed and served"):
        assert not fuzzy(text)[0], text


def test_every_piece_is_a_seed():
    for n in licenses.NOTICES:
        assert "".join(p for _, p in n.pieces) == n.head and len(n.pieces) == n.edits + 1


def test_documents(documents):
    got = licenses.digest(licenses.find_licenses(documents))
    assert got.columns == COLUMNS
    rows = {r["doc_id"]: r for r in got.collect()}
    for r in documents.collect():
        g, want = rows[r["doc_id"]], base(r["text"])
        assert (g["n_words"], g["n_base"], g["first_word"], g["last_word"], g["base_labels"]) == want
        assert set(filter(None, want[4].split(","))) <= set(filter(None, g["labels"].split(","))) and 0 <= g["score"] <= 1
        assert (g["score"] == 1) >= (want[1] > 0)


def test_messy_and_empty(messy, empty):
    assert licenses.digest(licenses.find_licenses(messy)).count() == len(MESSY)
    assert licenses.digest(licenses.find_licenses(empty)).collect() == []
