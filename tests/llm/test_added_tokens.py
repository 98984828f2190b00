"""Ids of texts that hold the file's added tokens, against the library as it comes."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from grainmill.llm import packing, token_file
from grainmill.llm.tokenizing import default_path, encoder

TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y  z", "<|endoftext| >", "plain text, no token", "日本 <|endoftext|>\n\n it's"]


def fresh(text):
    return Tokenizer.from_file(default_path()).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", TEXTS)
def test_encoder(text):
    assert np.frombuffer(encoder(default_path()).encode(text), dtype="<u4").tolist() == fresh(text)


def test_token_file_and_packing(frame, ws):
    docs = frame([(i, t, "en", "s") for i, t in enumerate(TEXTS)])
    at = 0
    for r in sorted(token_file.round_trip(docs, ws).collect(), key=lambda r: r["doc_id"]):
        ids = np.array([*fresh(TEXTS[r["doc_id"]]), 0], dtype="<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert {r["doc_id"]: r["doc_tokens"] for r in packing.pack(docs, ws).collect()} == {i: len(fresh(t)) + 1 for i, t in enumerate(TEXTS)}
