"""Token ids of whole texts by the tokenizers library, fast enough for a corpus.

A byte-level BPE splits a text by a fixed pattern and merges each piece on its own, so the ids of a text are the ids of
its pieces one after another. Pieces repeat; the library's model is asked once for each piece that is not remembered.
The memory of pieces is bounded: when it is full it starts anew.

The library finds the file's added tokens in a text before it splits it; texts that hold one are left to the library.

The file's normalizer must be absent and its pre-tokenizer byte-level with the pattern and no prefix space; another
file is encoded by the library as a whole, text by text.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np

#: The letters and numbers below U+0250, white space below U+0250, and the pattern's contractions.
LETTERS, NUMBERS, BLANK = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
LATIN = re.compile(f" ?[{LETTERS}]+| ?[{NUMBERS}]+|{CONTRACTIONS}| ?[^{BLANK}{LETTERS}{NUMBERS}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")
NOT_LATIN = re.compile("[^\x00-ɏ]")
ANY = CONTRACTIONS + r"| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECE_CACHE = 400_000
#: Texts longer than this many characters are cut at pattern boundaries, so the list of pieces stays small.
STEP = 1 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _printable() -> dict[int, int]:
    """Byte to the character that stands for it in a byte-level vocabulary."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in kept)
    return {b: b for b in kept} | {b: 256 + n for n, b in enumerate(others)}


class Encoder(dict):
    """Piece to the little-endian unsigned 32-bit bytes of its ids."""

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        pre = told.get("pre_tokenizer") or {}
        self.by_piece = (
            told["model"].get("type", "BPE") == "BPE"
            and not told.get("normalizer")
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and not told["model"].get("continuing_subword_prefix")
            and not told["model"].get("end_of_word_suffix")
        )
        self.added = [t["content"] for t in told.get("added_tokens") or () if t["content"]]
        self.model, self.any, self.table = self.tokenizer.model, regex.compile(ANY), _printable()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= PIECE_CACHE:
            self.clear()
        spelled = piece.encode("utf-8").decode("latin-1").translate(self.table)
        ids = self[piece] = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
        return ids

    def _pieces(self, text: str) -> list[str]:
        return (self.any if NOT_LATIN.search(text) else LATIN).findall(text)

    def _cut(self, text: str) -> Iterator[str]:
        """Parts of ``text`` of about STEP characters, ending before the space of "x y" with x, y ASCII letters."""
        at = 0
        while len(text) - at > STEP:
            m = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])").search(text, at + STEP)
            if not m:
                break
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text without special tokens, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        text = text.encode("utf-8", "replace").decode("utf-8")  # lone surrogates, which no valid text has
        if not self.by_piece or any(t in text for t in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        get = self.__getitem__
        return b"".join(b"".join(map(get, self._pieces(part))) for part in self._cut(text))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_all(texts: Iterable[str | None], path: str) -> Iterator[bytes]:
    encode = encoder(path).encode
    return map(encode, texts)
