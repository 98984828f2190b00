import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from grainmill.llm import token_file
from grainmill.llm.tokenizing import default_path
from tests.llm.conftest import MESSY


def brute(items):
    e = Tokenizer.from_file(default_path())
    h = lambda t: 42 if t is None else ((xxhash.xxh64_intdigest(t.encode(), seed=42) + (1 << 63)) % (1 << 64)) - (1 << 63)
    order = sorted(items, key=lambda r: (r[0] is not None, r[0] or 0, h(r[1])))
    out, at = [], 0
    for i, t, *_ in order:
        ids = np.array([*e.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def told(df):
    return sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in df.collect()), key=lambda r: r[1])


def test_messy(messy, ws):
    assert told(token_file.round_trip(messy, ws)) == brute(MESSY)


def test_documents_in_many_files(documents, ws, monkeypatch):
    monkeypatch.setattr(token_file, "SHARD_DOCS", 5)
    got = told(token_file.round_trip(documents, ws, range_bytes=30_000))
    assert got == brute([(r["doc_id"], r["text"]) for r in documents.collect()])


def test_empty(empty, ws):
    assert token_file.round_trip(empty, ws).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 900), st.integers(0, 3000)), max_size=700), st.integers(0, 2), st.sampled_from([200, 70_000]))
def test_shards(parts, nulls, top):
    ids, d = [None] * min(nulls, len(parts)), -5
    for gap, _ in parts[len(ids) :]:
        d += gap
        ids.append(d)
    counts = [1 + n % 50 for _, n in parts]
    data = np.arange(sum(counts), dtype="<u4") % top
    shard = token_file.Shard(token_file.encode_shard(ids, counts, data.tobytes()))
    bounds = np.concatenate([[0], np.cumsum(counts)]).astype(int) if counts else np.zeros(1, int)
    assert shard.doc_ids == ids and shard.offsets().tolist() == bounds.tolist()
    assert [shard.offset(i) for i in range(0, len(ids) + 1)] == bounds.tolist()
    if ids:
        assert shard.ids(len(ids) - 1).tolist() == data[bounds[-2] : bounds[-1]].tolist()


def test_boundaries_take_few_bits():
    counts = [700] * 20_000
    content = token_file.encode_shard(list(range(20_000)), counts, np.zeros(sum(counts), dtype="<u4").tobytes())
    shard = token_file.Shard(content)
    assert 8 * (len(shard.low) + len(shard.upper) + 4 * len(shard.select)) / 20_000 < 2 + np.log2(700) + 0.5
    assert shard.width == 2


def test_not_a_file():
    with pytest.raises(ValueError):
        token_file.Shard(b"x" * 100)


def test_attempts_side_by_side_leave_one_file(tmp_path):
    for attempt in (3, 4, 3):
        token_file._put(f"file://{tmp_path}/x.eftok", b"content", attempt)
    assert [p.name for p in tmp_path.iterdir()] == ["x.eftok"] and (tmp_path / "x.eftok").read_bytes() == b"content"
