"""Licence notices in texts, with errors: exact seeds, then bounded-error matching.

A text counts as its words (runs of ASCII letters, digits and all other code points above U+007F, A-Z as a-z) joined by one
space. A notice is a short sequence of words of which a head may have up to ``edits`` errors (letters put in, left out or
changed) and a tail none. A head with that many errors still holds one of its ``edits + 1`` pieces unchanged (pigeonhole),
so an automaton of all pieces gives every place worth looking at. There the regex library's bounded-error matching looks for
the best match that begins and ends with whole words, inside the stretch that the piece's place allows.

Base phrases are found where their words stand consecutively, without errors. A document's score is the likeness of its best
match: 1 less the errors' share of the notice's length, 0 without a match.

Nulls, ties, repeats: a null text is the empty one, which has no words and no labels; matches may overlap and all count;
repeated rows stay; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Notice:
    label: str
    head: str
    edits: int
    tail: str = ""

    @property
    def size(self) -> int:
        return len(self.head) + len(self.tail)

    @cached_property
    def pieces(self) -> list[tuple[int, str]]:
        """(place in the head, piece): the head in ``edits + 1`` parts of nearly equal length."""
        n, parts = len(self.head), self.edits + 1
        cuts = [n * k // parts for k in range(parts + 1)]
        return [(a, self.head[a:b]) for a, b in zip(cuts, cuts[1:])]


#: Base phrases and their labels.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

#: Notices that are found with errors. What tells two of them apart (a version, a name of three letters) has none: it is in
#: the tail, or the errors are too few to change it.
NOTICES = (
    Notice("mit", "under the mit license", 1),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    Notice("apache-2", "apache license version", 2, " 2"),
    Notice("gpl-2", "gnu general public license version", 3, " 2"),
    Notice("gpl-3", "gnu general public license version", 3, " 3"),
    Notice("lgpl", "gnu lesser general public license", 3),
    Notice("agpl", "gnu affero general public license", 3),
    Notice("mpl", "mozilla public license", 2),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification", 6),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose", 6),
    Notice("cc-by-nc", "creative commons attribution noncommercial", 3),
    Notice("cc-by-sa", "creative commons attribution sharealike", 3),
    Notice("cc-by-nd", "creative commons attribution noderivatives", 3),
    Notice("public-domain", "dedicated to the public domain", 2),
    Notice("proprietary", "all rights reserved", 1),
)

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def spaced(text: str | None) -> str:
    """The words with a space before, between and after them; one space if there are none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()
    return (b" " + b" ".join(words) + b" ").decode("utf-8", "surrogatepass") if words else " "


class Finder:
    def __init__(self, notices: tuple[Notice, ...] = NOTICES, base: tuple[tuple[str, str], ...] = BASE) -> None:
        import ahocorasick
        import regex

        self.notices, self.base = notices, base
        self.match = [regex.compile(rf"(?b)(?<= )(?:{regex.escape(n.head, literal_spaces=True)}){{e<={n.edits}}}{regex.escape(n.tail, literal_spaces=True)}(?= )") for n in notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, notice in enumerate(notices):
            for at, piece in notice.pieces:
                seeds.setdefault(piece, []).append((i, at))
        self.seeds = ahocorasick.Automaton()
        for piece, owners in seeds.items():
            self.seeds.add_word(piece, (len(piece), owners))
        if seeds:
            self.seeds.make_automaton()
        self.any = bool(seeds)

    def spans(self, text: str | None) -> tuple[int, list[tuple[bool, str, int, int, int, float]]]:
        """Number of words, and (base, label, first word, words, errors, likeness) of each match, base ones first."""
        line = spaced(text)
        found: list[tuple[bool, str, int, int, int, float]] = []
        for label, phrase in self.base:
            asked, at = f" {phrase} ", line.find(f" {phrase} ")
            while at >= 0:
                found.append((True, label, line.count(" ", 0, at), phrase.count(" ") + 1, 0, 1.0))
                at = line.find(asked, at + 1)
        if self.any:
            places: set[tuple[int, int]] = set()
            for end, (n, owners) in self.seeds.iter(line):
                places.update((i, end - n + 1 - at) for i, at in owners)
            matches = set()
            for i, at in places:
                notice = self.notices[i]
                m = self.match[i].search(line, max(0, at - notice.edits - 1), at + notice.size + notice.edits + 1)
                if m:
                    matches.add((m.start(), m.end(), i, sum(m.fuzzy_counts)))
            for a, b, i, errors in sorted(matches):
                found.append((False, self.notices[i].label, line.count(" ", 0, a) - 1, line.count(" ", a, b) + 1, errors, 1 - errors / self.notices[i].size))
        return line.count(" ") - 1, found


_FINDER: list[Finder] = []


def finder() -> Finder:
    if not _FINDER:
        _FINDER.append(Finder())
    return _FINDER[0]


def find_licenses(documents: DataFrame) -> DataFrame:
    """doc_id, n_words and spans: array of (base, label, first_word, words, errors, likeness) of every whole text."""
    kind = pa.struct([("base", pa.bool_()), ("label", pa.string()), ("first_word", pa.int64()), ("words", pa.int64()), ("errors", pa.int64()), ("likeness", pa.float64())])
    schema = "doc_id long, n_words long, spans array<struct<base:boolean,label:string,first_word:long,words:long,errors:long,likeness:double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = finder().spans
        for batch in batches:
            told = [spans(t) for t in batch.column(1).to_pylist()]
            flat = [s for _, row in told for s in row]
            offsets = [0]
            for _, row in told:
                offsets.append(offsets[-1] + len(row))
            parts = pa.StructArray.from_arrays([pa.array([s[k] for s in flat], kind[k].type) for k in range(len(kind))], fields=list(kind))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in told], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), parts)],
                names=["doc_id", "n_words", "spans"],
            )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """The report of the query: counts and places of the base phrases, labels, score, and the spans found with errors."""
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["first_word"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    told = lambda s: F.concat_ws(":", s["label"], s["first_word"].cast("string"), s["words"].cast("string"), s["errors"].cast("string"))
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["likeness"])), F.lit(0.0)).alias("score"),
        F.array_join(F.transform(F.filter("spans", lambda s: ~s["base"]), told), ",").alias("spans"),
    )
