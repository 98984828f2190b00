import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from grainmill.llm import fill_middle
from grainmill.llm.elias_fano import EliasFano
from tests.llm.conftest import MESSY

COLUMNS = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, told = len(lines), sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h = [int(told[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    form = "spm" if h[3] % 100 < spm else "psm"
    output = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, n, form, len(prefix), len(middle), sha(output), sha(text)


def check(df, ws, **options):
    got = fill_middle.digest(fill_middle.fill_in_middle(df, ws, **options))
    options.pop("parts", None)
    assert got.columns == COLUMNS
    want = [brute(r["doc_id"], r["text"], **options) for r in df.select("doc_id", "text").collect()]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


ODD = ["\n", "\n\n\n", "a\n", "a\nb", "a\r\nb\x0bc d\x00\n", "<P>", "a<S>\n", "<", "<P\n>", "<\nS>", "S>\n<", "ü\n😀\n" * 50, "x" * 70_000 + "\n" + "y\n" * 3000]


def test_messy_and_empty(messy, empty, frame, ws):
    check(messy, ws)
    check(frame([(i, t, "en", "a") for i, t in enumerate(ODD)]), ws)
    assert fill_middle.digest(fill_middle.fill_in_middle(empty, ws)).collect() == []


def test_documents(documents, ws):
    check(documents, ws)
    check(documents, ws, seed=11, rate=60, spm=20)


@pytest.mark.parametrize("parts", [1, 5, 64])
def test_hot_texts(frame, ws, parts):
    """A third of the rows has one text, null or not, and a tenth another; rows without a doc_id are dealt, too."""
    items = [(i if i % 4 else None, "one\ntwo\nthree\n" if i % 3 == 0 else "x\ny" if i % 10 == 1 else None if i % 10 == 2 else f"{i % 50}\n" * (i % 7), "en", "a") for i in range(900)]
    check(frame(items).repartition(7), ws, parts=parts)


def test_equal_texts_travel_once(spark, ws):
    import pyarrow as pa

    names = ["doc_id", "key", "piece", "text"]
    batch = lambda texts: pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([t[:1].encode() for t in texts]), pa.array([0] * len(texts), pa.int32()), pa.array(texts)], names=names)
    sent = [b.column(3).to_pylist() for b in fill_middle._first_texts(iter([batch(["aa", "bb", "aa"]), batch(["bb", "cc", "aa"])]))]
    assert sent == [["aa", "bb", None], [None, "cc", None]]
    with pytest.raises(ValueError):
        list(fill_middle._first_texts(iter([batch(["aa", "ab"])])))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 10**6)), max_size=400))
def test_elias_fano(gaps):
    values = np.cumsum(np.array([0, *gaps], dtype=np.int64))
    packed = EliasFano(values)
    assert [packed.select(i) for i in range(len(values))] == values.tolist()
    for i in (-1, len(values)):
        with pytest.raises(IndexError):
            packed.select(i)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="a<>PSM\né", max_size=30), st.integers(0, 50))
def test_fuzzed_cuts(text, doc_id):
    form, prefix, middle, output = fill_middle.cut(fill_middle.Entry(text), doc_id, 7, 100, 50)
    want = brute(doc_id, text)
    assert (form, prefix, middle, sha(output)) == (want[2], want[3], want[4], want[5])
