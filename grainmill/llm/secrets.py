"""Secrets in texts: a keyword automaton first, regular expressions only at its hits, then embedded checksums.

One Aho-Corasick pass over the UTF-8 bytes of a text, A-Z in lower case, finds the keywords. At a hit the kind's
expression is tried anchored, never elsewhere. Kinds with an embedded checksum must pass it.

Base kinds (no checksum): assign, access, hex. ``hex`` has no word to go by; its keywords are all groups of four
hexadecimal digits, the first of which begins where a run does.
Added kinds: github and npm, tokens of 36 base-62 characters after their prefix whose last 6 are the CRC-32 of the
first 30, and jwt, three base64url parts of which the first two must decode to JSON objects.

Nulls, ties, repeats: a null text counts as the empty one, which has no spans; spans of different kinds may overlap and
all stay; equal rows give equal rows; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import joined, sha256

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Kind:
    """``pattern`` is over bytes and anchored at a keyword's start; ``valid`` sees the match and decides."""

    name: str
    keywords: tuple[bytes, ...]
    pattern: re.Pattern
    valid: Callable[[re.Match], bool]


def base62_crc(body: bytes) -> bytes:
    n, out = zlib.crc32(body), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out.encode()


def _json_object(part: bytes) -> bool:
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(part + b"=" * (-len(part) % 4))), dict)
    except (ValueError, RecursionError):
        return False


KINDS = (
    Kind(
        "assign",
        (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"),
        re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I),
        lambda m: len(m[2]) >= 6,
    ),
    Kind("access", (b"akia",), re.compile(rb"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    Kind("hex", tuple(bytes(x) for x in product(b"0123456789abcdef", repeat=4)), re.compile(rb"[0-9a-f]{24,}"), lambda m: True),
    Kind("github", (b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_"), re.compile(rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"), lambda m: base62_crc(m[1]) == m[2]),
    Kind("npm", (b"npm_",), re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"), lambda m: base62_crc(m[1]) == m[2]),
    Kind("jwt", (b"eyj",), re.compile(rb"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+"), lambda m: _json_object(m[1]) and _json_object(m[2])),
)
BASE = ("assign", "access", "hex")


class Scanner:
    def __init__(self, kinds: tuple[Kind, ...] = KINDS) -> None:
        import ahocorasick

        self.kinds = kinds
        self.keys = ahocorasick.Automaton()
        by_key: dict[str, list[int]] = {}
        for i, kind in enumerate(kinds):
            for k in kind.keywords:
                by_key.setdefault(k.decode("latin-1"), []).append(i)
        for k, owners in by_key.items():
            self.keys.add_word(k, (len(k), owners))
        if by_key:
            self.keys.make_automaton()
        self.any = bool(by_key)

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, by start, then in the order of the kinds.

        Per kind the matches are the leftmost, non-overlapping ones of its expression; failing ones are dropped
        afterwards and still use up their characters.
        """
        if not text:
            return []
        data = text.encode("utf-8", "surrogatepass")
        found: list[tuple[int, int, int]] = []
        if self.any:
            hits = sorted((end - n + 1, owner) for end, (n, owners) in self.keys.iter(data.lower().decode("latin-1")) for owner in owners)
            free_from = [0] * len(self.kinds)
            for at, i in hits:
                if at >= free_from[i] and (m := self.kinds[i].pattern.match(data, at)):
                    free_from[i] = m.end()
                    if self.kinds[i].valid(m):
                        found.append((at, i, m.end()))
        found.sort()
        if len(data) == len(text):
            return [(self.kinds[i].name, a, b) for a, i, b in found]
        points, at, n = {}, 0, 0
        for p in sorted({x for a, _, b in found for x in (a, b)}):
            n += len(data[at:p].decode("utf-8", "surrogatepass"))
            at, points[p] = p, n
        return [(self.kinds[i].name, points[a], points[b]) for a, i, b in found]


_SCANNER: list[Scanner] = []


def scanner() -> Scanner:
    if not _SCANNER:
        _SCANNER.append(Scanner())
    return _SCANNER[0]


def find_secrets(documents: DataFrame) -> DataFrame:
    """doc_id and spans: array of (kind, start, end) of every whole text."""
    schema = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner().spans
        for batch in batches:
            found = [scan(t) for t in batch.column(1).to_pylist()]
            flat = [s for row in found for s in row]
            parts = pa.StructArray.from_arrays([pa.array([s[k] for s in flat], spans.value_type[k].type) for k in range(3)], fields=list(spans.value_type))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(row) for row in found])]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, parts)], names=["doc_id", "spans"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """The report of the query: counts of the base kinds, the hash of the base spans, all spans."""
    one = F.concat_ws
    told = lambda spans: F.array_join(F.transform(spans, lambda s: one(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def redact(text: str | None, mark: str = "<SECRET>") -> str | None:
    """The text with every span replaced by ``mark``; overlapping spans count as one."""
    if not text:
        return text
    out, at = [], 0
    for _, a, b in scanner().spans(text):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def report(text: str | None) -> tuple[str, str]:
    """Brute-force form of ``digest`` for one text: (base_sha256, spans)."""
    spans = scanner().spans(text)
    return sha256(joined([s for s in spans if s[0] in BASE])), joined(spans)


def _sql() -> str:
    """The whole report in SQL. Places of matches follow from the lengths of what lies between them; CRC-32 is computed bit
    by bit; a token's end is that of its run of characters."""
    found = {
        "assign": (r"""(?i:password|passwd|secret|token|api_?key)["\']?\x20*[:=]\x20*["\']?[A-Za-z0-9+/_.=-]+""", r"""length(regexp_extract(m, '(?i:password|passwd|secret|token|api_?key)["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)', 1)) >= 6"""),
        "access": ("AKIA[A-Z0-9]+", "length(m) >= 20"),
        "hex": ("[0-9a-f]+", "length(m) >= 24"),
        "github": ("gh[pousr]_[A-Za-z0-9]+", None),
        "npm": ("npm_[A-Za-z0-9]+", None),
        "jwt": (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "len(list_filter(string_split(m, '.')[1:2], lambda x: coalesce(json_type(try_cast(decode(try(from_base64(replace(replace(x, '-', '+'), '_', '/') || repeat('=', (4 - length(x) % 4) % 4)))) AS JSON)) = 'OBJECT', false))) = 2"),
    }
    crc = "xor(list_reduce(list_transform(range(30), lambda k: ord(substring(b, k + 1, 1))::BIGINT), lambda c, x: list_reduce(range(8), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)), xor(c, x)), 4294967295), 4294967295)"
    token = f"length(m) = length(m[1:4]) + 36 AND (SELECT string_agg(substring('{BASE62}', 1 + CAST(v // p % 62 AS INTEGER), 1), '' ORDER BY p DESC) FROM (SELECT {crc} AS v FROM (SELECT substring(m, 5, 30) AS b)), (SELECT unnest([1, 62, 3844, 238328, 14776336, 916132832]) AS p)) = substring(m, 35, 6)"
    parts = []
    for rank, (kind, (pattern, test)) in enumerate(found.items()):
        q = pattern.replace("\\'", "''")
        each = f"SELECT rid, regexp_extract_all(text, '{q}') AS ms, string_split_regex(text, '{q}') AS gaps FROM docs"
        placed = f"SELECT rid, m, list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0) AS a FROM (SELECT *, unnest(ms) AS m, generate_subscripts(ms, 1) AS k FROM ({each}))"
        test = (test or token).replace("\\'", "''")
        parts.append(f"SELECT rid, {rank} AS rank, '{kind}' AS kind, CAST(a AS BIGINT) AS a, CAST(a + length(m) AS BIGINT) AS b FROM ({placed}) WHERE {test}")
    spans = " UNION ALL ".join(parts)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents), sp AS ({spans}),
ag AS (SELECT rid, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) FILTER (WHERE rank < 3) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) AS spans FROM sp GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN ag USING (rid)
"""


SQL = _sql()
