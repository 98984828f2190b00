import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from grainmill.llm import packing
from grainmill.llm.tokenizing import default_path, encoder
from tests.llm.conftest import MESSY

LIBRARY = Tokenizer.from_file(default_path())


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def check(items, rows):
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    for i in {i for i, *_ in items}:
        wants = sorted((library(t) + [1] for j, t, *_ in items if j == i), key=len)
        got = sorted(by[i], key=lambda r: (r["doc_tokens"], r["start"]))
        assert sum(r["length"] for r in got) == sum(map(len, wants))
        for ids in wants:
            data = np.array(ids, dtype="<u4")
            assert {(r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_tokens"] == len(ids)} >= {
                (s, n, zlib.crc32(data[s : s + n].tobytes())) for s, n in pieces(len(ids))
            }
    seq = [r["sequence_id"] for r in rows]
    assert sorted(seq) == list(range(len(rows)))
    assert all(r["offset"] == 0 and r["length"] & (r["length"] - 1) == 0 and r["length"] <= 2048 for r in rows)


def pieces(n):
    at = 0
    for x in packing.lengths(n, 2048):
        yield at, x
        at += x


def test_messy(messy, ws):
    check(MESSY, packing.pack(messy, ws, per_bucket=3).collect())


def test_documents(documents, ws):
    check([(r["doc_id"], r["text"]) for r in documents.collect()], packing.pack(documents, ws).collect())


def test_ids_on_request(frame, ws):
    r, = packing.pack(frame([(1, "hello", "en", "s")]), ws, with_ids=True).orderBy("start").limit(1).collect()
    assert zlib.crc32(r["ids"]) == r["ids_crc32"]


def test_empty(empty, ws):
    assert packing.pack(empty, ws).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from([" ", "  ", "\n", "\t", "\xa0", " ", "it's", "don't", "'ll", "word", "Été", "ß", "½", "42", "...", "<|endoftext|>", "日本", "😀", "\x1c", "_"]), max_size=20).map("".join)))
def test_encoder_equals_the_library(text):
    got = np.frombuffer(encoder(default_path()).encode(text), dtype="<u4").tolist()
    assert got == library(text.encode("utf-8", "replace").decode())


def test_long_texts_are_cut_at_boundaries(monkeypatch):
    from grainmill.llm import tokenizing

    monkeypatch.setattr(tokenizing, "STEP", 50)
    text = "some words  and, 'quoted' ones\n\n with blanks " * 40
    assert np.frombuffer(encoder(default_path()).encode(text), dtype="<u4").tolist() == library(text)


@pytest.mark.parametrize("n", [0, 1, 2047, 2048, 2049, 5000])
def test_lengths(n):
    got = list(packing.lengths(n, 2048))
    assert sum(got) == n and got == sorted(got, reverse=True) and len([x for x in got if x < 2048]) == len({x for x in got if x < 2048})
