"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs the labelers, a classifier decides.

Candidates are wide: every span that a base kind's expression accepts, every chain of 7 to 20 digits, every run of the
form of an IBAN, every pair of capitalised words. Four labelers look at each and vote for it, against it, or abstain:
the form of the span (regex, with embedded checksums), lists of names, providers and known invented numbers (gazetteer),
cue and counter-cue words around it (context), and what it is glued to (boundary). Votes are counted by kind and pattern
over all documents; from these few counts, expectation-maximisation estimates each kind's prior and each labeler's
reliability, and so the probability of every pattern of votes.

The span classifier never sees votes. Its features are the words around a span and the span's shape, hashed; it is
trained by logistic regression against EM's probabilities, on a bounded sample of the candidates that some labeler voted
on and as many of those on which all abstained, whose probability is the prior (the ``SAMPLE`` least hashes a kind, the
same however the documents are dealt), and decides on every candidate of an added kind, so it finds spans that no labeler
knows from the company they keep.

Base kinds (email, ip, card, phone) always stay, as their expressions define them. Added kinds (ssn, iban, account,
name) stay where the classifier accepts them and no base span overlaps.

Nulls, ties, repeats: a null text counts as the empty one, which has no spans; of overlapping added spans the leftmost,
then longest, then first listed kind stays; equal rows give equal rows; an empty table gives an empty result. Only doc_id
and text are read (``redact`` keeps all columns).
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from heapq import heappush, heappushpop

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Workspace

BASE = ("email", "ip", "card", "phone")
ADDED = ("ssn", "iban", "account", "name")
KINDS = BASE + ADDED
LABELERS = ("regex", "gazetteer", "context", "boundary")
#: Candidates of a kind, with votes and without, that the classifier is trained on at most; hashed features; and the probability from which an
#: added span stays.
SAMPLE, WIDTH, THRESHOLD = 2_000, 1 << 12, 0.5
#: Groups of candidates by hash that are cut to their share and some spare ones before they meet.
GROUPS, SPARE = 32, 64

#: Given names the gazetteer knows, in lower case; a parameter's default, not a complete list.
GIVEN = (
    "alexander alice amelia andrea andreas angela anna antonio barbara beatriz benjamin carlos carmen caroline catherine charlotte christian christine claudia daniel david diana "
    "dominique eduardo elena elizabeth emily emma eric eva felix fernando francisco franz gabriel george gerard hannah hans heinrich helen henry isabel jacques james javier jean "
    "jennifer jessica joan john jorge joseph juan julia karl katharina klaus laura linda lucas luis manuel marie martin mary matthew michael miguel monika nicole nina oliver olivia "
    "pablo patricia patrick paul pedro peter philippe pierre rachel robert rosa samuel sandra sarah sofia sophie stefan stephanie susan susanne sylvie teresa thomas ursula victor wolfgang"
).split()
#: Capitalised words that begin no name: sentences' first words and forms of address.
NO_NAME = frozenset(
    "the of and for with from this that there here when where what who why how not but or if in on at by to as is are was were be it its he she they we you i his her my our your an "
    "der die das und ein eine ist im am von zu mit auf für le la les un une et est dans de du des el los las una y en con por para que del "
    "mr mrs ms miss dr prof sir herr frau mme monsieur señor señora dear hello hi name contact street road avenue new north south east west january february march april may june july august september october november december "
    "monday tuesday wednesday thursday friday saturday sunday".split()
)
PROVIDERS = re.compile(r"@(?:[^@]*\.)?(?:gmail|googlemail|yahoo|hotmail|outlook|gmx|web|icloud|aol|proton|protonmail|orange|free|mail)\.", re.I)
ROLES = re.compile(r"^(?:info|no-?reply|support|admin|sales|office|webmaster|postmaster|contact|hello)@", re.I)
#: Numbers that cards, accounts and the like are shown with in manuals.
INVENTED = frozenset("4111111111111111 4242424242424242 5555555555554444 378282246310005 6011111111111117 123456789 12345678 1234567890 987654321 078051120 219099999".split())
#: Lengths of IBANs by country.
IBAN_LENGTHS = dict(zip("AT BE CH CZ DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split(), (20, 16, 21, 24, 22, 18, 24, 18, 27, 22, 22, 27, 20, 18, 15, 28, 25, 24)))
#: Words that make a span of the kind likelier, and words that make any number less likely, when they stand near it.
CUES = {
    "email": ("mail", "e-mail", "email", "contact", "reach", "write"),
    "ip": ("ip", "host", "address", "server"),
    "card": ("card", "visa", "mastercard", "payment", "credit", "carte", "karte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon"),
    "ssn": ("ssn", "social security"),
    "iban": ("iban", "konto", "cuenta", "compte", "account", "transfer"),
    "account": ("account", "passport", "acct", "iban", "konto", "cuenta", "kontonummer"),
    "name": ("mr", "mrs", "ms", "dr", "prof", "herr", "frau", "mme", "señor", "señora", "name", "named", "dear", "contact", "signed", "sincerely", "regards"),
}
COUNTER = ("page", "chapter", "version", "section", "figure", "table", "year", "order", "item", "part", "isbn", "issn", "serial", "invoice", "ticket", "seite", "kapitel", "número", "about", "total")
CUE_REACH = 32

EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
DIGIT_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
UPPER, LOWER = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"
PAIR = re.compile(rf"(?<!\w)(?=([{UPPER}][{LOWER}]+(?: (?:van|von|der|de|del|di|da|la|le)){{0,2}} [{UPPER}][{LOWER}]+(?:-[{UPPER}][{LOWER}]+)?)(?!\w))")
WORD = re.compile(r"[^\W_]+")
NOT_DIGIT = re.compile(r"[^0-9]+")
LETTER = re.compile(r"[A-Za-z]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_sum(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, from each "@" outwards, so long runs of letters cost nothing."""
    free, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > free and text[a - 1] in LOCAL:
            a -= 1
        m = EMAIL_DOMAIN.match(text, at + 1) if a < at else None
        if m:
            yield a, m.end()
        free = m.end() if m else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base kinds' spans by kind as listed, then start; failing matches are dropped without a second try."""
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in DIGIT_CHAIN.finditer(text):
        if m.end() - m.start() >= 13:
            d = NOT_DIGIT.sub("", m[0])
            if 13 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return out


class Finder:
    """Candidates, votes and features of one text. ``names``: the gazetteer of given names, in lower case."""

    def __init__(self, names=GIVEN) -> None:
        self.names = frozenset(names)
        listed = lambda words: re.compile(r"(?<![^\W\d_])(?:" + "|".join(map(re.escape, words)) + r")(?![^\W\d_])", re.I)
        self.cues = {k: listed(v) for k, v in CUES.items()}
        self.counter = listed(COUNTER)

    def candidates(self, text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """(kind, start, end): the base spans by kind, then start; wide candidates of the added kinds that no base span
        overlaps, by start, the longest first."""
        if not text:
            return [], []
        base = base_spans(text)
        wide = [("ssn", m.start(), m.end()) for m in SSN.finditer(text)]
        wide += [("iban", m.start(), m.end()) for m in IBAN.finditer(text)]
        for m in DIGIT_CHAIN.finditer(text):
            if 7 <= m.end() - m.start() <= 40 and 7 <= len(NOT_DIGIT.sub("", m[0])) <= 20:
                wide.append(("account", m.start(), m.end()))
        wide += [("name", m.start(1), m.end(1)) for m in PAIR.finditer(text)]
        if base:
            merged: list[list[int]] = []
            for a, b in sorted((a, b) for _, a, b in base):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            starts = [a for a, _ in merged]

            def free(a: int, b: int) -> bool:
                k = bisect_right(starts, a) - 1
                return not (k >= 0 and merged[k][1] > a) and not (k + 1 < len(starts) and starts[k + 1] < b)

            wide = [c for c in wide if free(c[1], c[2])]
        return base, sorted(wide, key=lambda c: (c[1], -c[2], KINDS.index(c[0])))

    def form(self, kind: str, span: str, digits: str) -> int:
        if kind == "email":
            last = span.rpartition(".")[2]
            return 1 if last.isalpha() and len(last) > 1 and ".." not in span else -1
        if kind == "ip":
            parts = span.split(".")
            return -1 if any(len(x) > 1 and x[0] == "0" for x in parts) or all(len(x) == 1 for x in parts) else 1
        if kind == "card":
            issued = (digits[0] == "4" and len(digits) in (13, 16, 19)) or (digits[:2] in ("34", "37") and len(digits) == 15)
            return 1 if issued or (len(digits) == 16 and ("51" <= digits[:2] <= "55" or "2221" <= digits[:4] <= "2720" or digits[:2] in ("60", "62", "64", "65"))) else -1
        if kind == "phone":
            return 1 if 10 <= len(digits) <= 13 else 0
        if kind == "ssn":
            return 1 if digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000" else -1
        if kind == "iban":
            return 1 if iban_sum(span) else -1
        if kind == "account":
            if len(set(digits)) < 3 or digits[:2] in ("19", "20") and len(digits) in (8, 12, 14):
                return -1  # filled up, or a date
            return -1 if len(digits) >= 13 and not luhn(digits) else 0
        words = span.split(" ")
        return -1 if words[0] == words[-1] or min(len(words[0]), len(words[-1])) < 3 else 0

    def listed(self, kind: str, span: str, digits: str) -> int:
        if kind == "email":
            return -1 if ROLES.search(span) else 1 if PROVIDERS.search(span) else 0
        if kind == "ip":
            a, b = (int(x) for x in span.split(".")[:2])
            return -1 if a in (0, 10, 127) or a >= 224 or (a, b) in ((192, 168), (169, 254), (192, 0), (198, 51), (203, 0)) else 0
        if kind == "iban":
            n = IBAN_LENGTHS.get(span[:2])
            return 0 if n is None else 1 if n == len(span.replace(" ", "")) else -1
        if kind == "name":
            words = span.lower().split(" ")
            return -1 if words[0] in NO_NAME or words[-1] in NO_NAME else 1 if words[0] in self.names else 0
        return -1 if digits in INVENTED else 0

    def votes(self, text: str, kind: str, a: int, b: int) -> list[int]:
        """A vote of each labeler: 1 for, -1 against, 0 abstains."""
        span = text[a:b]
        digits = NOT_DIGIT.sub("", span)
        before, after = text[max(0, a - CUE_REACH) : a], text[b : b + CUE_REACH // 2]
        near = 1 if self.cues[kind].search(before) or kind != "name" and self.cues[kind].search(after) else 0
        if not near and kind != "name" and (self.counter.search(before) or before.strip()[-1:] in ("$", "€", "£", "#") or after.strip()[:1] in ("%", "€", "$", "£")):
            near = -1
        left, right = text[a - 1 : a] if a else "", text[b : b + 1]
        glued = left.isalnum() or left in ("_", "/", "-", "=") and left != "" or right.isalnum() or right in ("_", "/", "=") and right != ""
        return [self.form(kind, span, digits), self.listed(kind, span, digits), near, -1 if glued else 0]

    def features(self, text: str, kind: str, a: int, b: int) -> list[int]:
        """Hashed features of a span: its shape and the words around it, each with the kind."""
        span = text[a:b]
        shape = re.sub(rf"[{LOWER}]+", "a", re.sub(rf"[{UPPER}]", "A", re.sub(r"[0-9]+", lambda m: f"9{min(len(m[0]), 20)}", span)))
        before = WORD.findall(text[max(0, a - CUE_REACH) : a].lower())[-3:]
        after = WORD.findall(text[b : b + CUE_REACH].lower())[:2]
        told = [kind, f"{kind} shape {shape}", f"{kind} left {text[a - 1 : a] if a else '^'}", f"{kind} right {text[b : b + 1] or '$'}"]
        told += [f"{kind} near {w}" for w in dict.fromkeys(before)] + [f"{kind} before {w}" for w in before[-1:]] + [f"{kind} after {w}" for w in after]
        return sorted({xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) % WIDTH for x in told})

    def sample(self, text: str | None) -> Iterator[tuple[str, int, int, list[int]]]:
        """(kind, pattern, hash, features) of every candidate: pattern is the votes in base 3, hash that of its place."""
        base, wide = self.candidates(text)
        for kind, a, b in (*base, *wide):
            code = 0
            for v in self.votes(text, kind, a, b):
                code = code * 3 + v + 1
            around = text[max(0, a - CUE_REACH) : b + CUE_REACH].encode("utf-8", "surrogatepass")
            yield kind, code, xxhash.xxh3_64_intdigest(around, seed=KINDS.index(kind)) >> 1, (a, b)

    def find(self, text: str | None, weights: np.ndarray | None, threshold: float = THRESHOLD) -> list[tuple[str, int, int]]:
        """All spans: the base kinds', and the added ones that the classifier's ``weights`` accept."""
        base, wide = self.candidates(text)
        kept, last = [], -1
        if weights is not None:
            least = np.log(threshold / (1 - threshold))
            for kind, a, b in wide:
                if a >= last and weights[self.features(text, kind, a, b)].sum() >= least:
                    kept.append((kind, a, b))
                    last = b
        return base + sorted(kept, key=lambda s: (KINDS.index(s[0]), s[1]))


_FINDER: list[Finder] = []


def finder() -> Finder:
    if not _FINDER:
        _FINDER.append(Finder())
    return _FINDER[0]


def observed(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(kind, pattern, n, hash, features) from one pass over the texts: how often each pattern of votes occurs (n), and
    the candidates with the least hashes of each kind (n is null), ``sample`` with votes and without a task at most."""
    schema = pa.schema([("kind", pa.string()), ("pattern", pa.int32()), ("n", pa.int64()), ("hash", pa.int64()), ("features", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = finder()
        counts: Counter = Counter()
        least: dict[tuple[str, bool], list] = {(k, v): [] for k in KINDS for v in (False, True)}
        held: dict[tuple[str, bool], set[int]] = {k: set() for k in least}  # copies of a place are one
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for kind, code, h, (a, b) in own.sample(text):
                    counts[kind, code] += 1
                    heap, seen = least[kind, code == SILENT], held[kind, code == SILENT]
                    if h not in seen and (len(heap) < sample or -heap[0][0] > h):
                        seen.add(h)
                        row = (-h, code, own.features(text, kind, a, b))
                        if len(heap) < sample:
                            heappush(heap, row)
                        else:
                            seen.discard(-heappushpop(heap, row)[0])
        rows = [(k, c, n, None, None) for (k, c), n in counts.items()]
        rows += [(k, c, None, -h, f) for (k, _), heap in least.items() for h, c, f in heap]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(zip(*rows), schema)], schema=schema)

    return documents.select(F.col("text").cast("string")).mapInArrow(run, "kind string, pattern int, n long, hash long, features array<int>")


#: The pattern on which all labelers abstain.
SILENT = sum(3**k for k in range(len(LABELERS)))


def unvote(pattern: int) -> list[int]:
    votes = []
    for _ in LABELERS:
        pattern, v = divmod(pattern, 3)
        votes.append(v - 1)
    return votes[::-1]


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """EM for one kind, after Dawid and Skene: prior, P(vote | class) as (labeler, class, vote + 1), P(true) of each row.

    Abstaining says nothing, so only votes for and against count, and a row on which everyone abstains has the prior.
    Starts from the majority of votes; pseudo-counts hold labelers to be right three times of four, and the prior to be
    one in four, until there is evidence.
    """
    p = np.where(votes.any(axis=1), 1 / (1 + np.exp(-2.0 * votes.sum(axis=1))), 0.25)
    table = np.zeros((votes.shape[1], 2, 3))
    prior, voted = 0.25, votes.any(axis=1)
    for _ in range(rounds):
        prior = float(((counts * voted) @ p + 1) / ((counts * voted).sum() + 4))
        for j in range(votes.shape[1]):
            for y, w, lean in ((0, counts * (1 - p), (3.0, 1.0)), (1, counts * p, (1.0, 3.0))):
                against, given = w[votes[:, j] < 0].sum() + lean[0], w[votes[:, j] > 0].sum() + lean[1]
                table[j, y] = [against / (against + given), 1.0, given / (against + given)]
        log = np.log([1 - prior, prior])[None, :] + sum(np.log(table[j][:, votes[:, j] + 1]).T for j in range(votes.shape[1]))
        log -= log.max(axis=1, keepdims=True)
        new = np.exp(log[:, 1]) / np.exp(log).sum(axis=1)
        if np.abs(new - p).max(initial=0) < 1e-9:
            break
        p = new
    return prior, table, p


def fit(features: list[list[int]], soft: np.ndarray, weight: np.ndarray, width: int = WIDTH, ridge: float = 2.0, rounds: int = 300) -> np.ndarray:
    """Weights of a logistic regression on sets of hashed features against probabilities, by accelerated gradients."""
    rows = np.repeat(np.arange(len(features)), [len(f) for f in features])
    cols = np.concatenate([np.asarray(f, dtype=np.int64) for f in features])
    most = np.bincount(cols, weights=weight[rows], minlength=width) * max(len(f) for f in features) / 4 + ridge
    w, v, momentum = np.zeros(width), np.zeros(width), 1.0
    for _ in range(rounds):
        z = np.bincount(rows, weights=v[cols], minlength=len(features))
        gap = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - soft)
        new = v - (np.bincount(cols, weights=gap[rows], minlength=width) + ridge * v) / most
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        v, w, momentum = new + (momentum - 1) / following * (new - w), new, following
    return w


def train(seen: DataFrame, sample: int = SAMPLE) -> np.ndarray | None:
    """The classifier's weights from ``observed`` candidates. The driver gets a count a kind and pattern of votes (at most
    kinds x 3^labelers of them, however large the corpus) and ``sample`` candidates a kind at most."""
    told = seen.where("n is not null").groupBy("kind", "pattern").agg(F.sum("n").alias("n")).collect()
    counts = sorted((r["kind"], r["pattern"], r["n"]) for r in told)
    if not counts:
        return None
    truth: dict[tuple[str, int], float] = {}
    for kind in KINDS:
        own = [c for c in counts if c[0] == kind]
        if own:
            votes = np.array([unvote(c[1]) for c in own])
            truth |= {(kind, c[1]): x for c, x in zip(own, reliabilities(votes, np.array([c[2] for c in own], dtype=float))[2].tolist())}
    group = ["kind", F.col("pattern") == SILENT]
    first = F.row_number().over(Window.partitionBy(*group, F.pmod("hash", F.lit(GROUPS))).orderBy("hash", "pattern"))
    few = seen.where("n is null").dropDuplicates(["kind", "hash"]).withColumn("nth", first).where(F.col("nth") <= sample // GROUPS + SPARE)
    few = few.withColumn("nth", F.row_number().over(Window.partitionBy(*group).orderBy("hash", "pattern")))
    rows = few.where(F.col("nth") <= sample).select("kind", "pattern", "features", "nth").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["kind"], r["pattern"] == SILENT, r["nth"]))
    return fit([r["features"] for r in rows], np.array([truth[r["kind"], r["pattern"]] for r in rows]), np.ones(len(rows)))


def learn(documents: DataFrame, ws: Workspace, sample: int = SAMPLE) -> np.ndarray | None:
    weights = train(ws.table("observed", observed(documents, sample)), sample)
    ws.drop("observed")
    return weights


def find_pii(documents: DataFrame, ws: Workspace, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and spans (kind, start, end) of every whole text, by kind as listed, then start. Texts are read twice, to
    learn and to find, and never shuffled."""
    weights = ws.spark.sparkContext.broadcast(learn(documents, ws))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = finder()
        for batch in batches:
            found = [own.find(t, weights.value, threshold) for t in batch.column(1).to_pylist()]
            flat = [s for spans in found for s in spans]
            parts = [pa.array([s[k] for s in flat], span[k].type) for k in range(3)]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(parts, fields=list(span)))], names=["doc_id", "spans"])

    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def digest(found: DataFrame) -> DataFrame:
    """The report of the query: counts of the base kinds, the hash of the base spans, all spans by kind, then start."""
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def redact(documents: DataFrame, ws: Workspace, threshold: float = THRESHOLD) -> DataFrame:
    """``documents`` with each span replaced by its kind in angle brackets (``<EMAIL>``); overlapping spans become one
    mark, the first one's. n_chars, where there is such a column, follows. Rows without spans are unchanged, nulls too.
    Texts are never shuffled or joined.
    """
    weights = ws.spark.sparkContext.broadcast(learn(documents, ws))
    names = documents.columns
    at, counted = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def clean(text: str | None) -> str | None:
        out, here = [], 0
        for kind, a, b in sorted(finder().find(text, weights.value, threshold), key=lambda s: (s[1], -s[2])):
            if a >= here:
                out += [text[here:a], f"<{kind.upper()}>"]
            here = max(here, b)
        return "".join(out) + text[here:] if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, old = list(batch.columns), batch.column(at).to_pylist()
            new = [clean(t) for t in old]
            columns[at] = pa.array(new, batch.column(at).type)
            if counted is not None:
                was = batch.column(counted)
                columns[counted] = pa.array([n if x == y else len(y) for n, x, y in zip(was.to_pylist(), old, new)], was.type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return documents.mapInArrow(run, documents.schema)
