"""Weak labels: issue, object, requested action and attributes of a complaint, and the repair of predicted topics."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import patterns as p
from ..functions.text import collapse, lower_first, sentences, strip
from .scoring import TOPIC

MARKS = " .,;:«»-"


def _trim(x: Column, chars: str = MARKS) -> Column:
    inside = "".join("\\" + c if c in "-\\]^" else c for c in chars)
    return F.regexp_replace(x, f"^[{inside}]+|[{inside}]+$", "")


def _cyrillic(x: Column, of, otherwise=None) -> Column:
    """``of`` a text with a Cyrillic letter (or the sign №), else ``otherwise`` of it (the text itself): patterns that need one
    are not tried in other texts."""
    rest = (lambda v: v) if otherwise is None else otherwise
    return F.transform(F.array(x), lambda v: F.when(v.rlike(p.CYRILLIC), of(v)).otherwise(rest(v)))[0]


def domain(kind: Column, mapping=p.KIND_TO_DOMAIN, default: str = "other") -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[kind], F.lit(default))


_STREET = re.compile(p.STREET.removeprefix(p.I).replace(p.W, r"\w").replace("(?<!\\w)", r"\b", 1), re.IGNORECASE)
_PERSON, _PHONE = re.compile(p.PERSON), re.compile(p.PHONE)
_CYRILLIC, _DIGITS = re.compile(p.CYRILLIC), re.compile(r"0\d{2}[-\s)]?\d{3}")  # what names and streets, and what telephones have


def redact_text(text: str | None) -> str | None:
    """Without capitalised words of three letters or more that no street phrase overlaps, and without phone numbers.

    Over-matches on purpose: sentence beginnings go, too.
    """
    if not text:
        return text
    cuts = []
    if not text.isascii() and _CYRILLIC.search(text):
        safe = bytearray(len(text))
        for m in _STREET.finditer(text):
            end = min(len(text), m.start(1) + len(m[1]) + len(m[2].rstrip("., ")))
            safe[m.start(1) : end] = b"\1" * (end - m.start(1))
        cuts = [m.span() for m in _PERSON.finditer(text) if not any(safe[m.start() : m.end()])]
    if _DIGITS.search(text):
        cuts += [m.span() for m in _PHONE.finditer(text)]
    if not cuts:
        return text
    out, at = [], 0
    for a, b in sorted(cuts):
        out.append(text[at:a])
        at = b
    return "".join(out) + text[at:]


@F.pandas_udf(StringType())
def _redact(texts: pd.Series) -> pd.Series:
    return texts.map(redact_text)


def redact(x: Column) -> Column:
    """``redact_text`` over Arrow batches: spans that protect others are beyond a single expression."""
    return _redact(x)


def street(text: Column) -> Column:
    """The first street phrase, stem and name; empty without one."""

    def found(own: Column) -> Column:
        stem, name = F.regexp_extract(own, p.STREET, 1), F.regexp_extract(own, p.STREET, 2)
        return F.trim(F.concat(stem, F.when(stem != "", F.lit(" ")).otherwise(F.lit("")), name))

    # a match holds blanks, which are collapsed only in texts that may have one
    return _cyrillic(F.coalesce(text, F.lit("")), lambda v: F.transform(F.array(collapse(v)), found)[0], lambda v: F.lit(""))


def streets(text: Column) -> Column:
    """Distinct lower-case street names, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p.STREET), F.lit(2)), lambda s: F.lower(F.trim(s)))))


def issue(text: Column) -> Column:
    def bare(v: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(F.regexp_replace(v, p.ADMIN_CLAUSE, ""), r"^Щодо\s+", ""), r"^[Сс]карга\s+на\s+", "")

    return F.left(collapse(redact(_cyrillic(collapse(text), bare))), F.lit(400))


def requested_action(text: Column) -> Column:
    """The first sentence with a request verb, redacted; empty without one."""

    def asked(v: Column) -> Column:
        found = F.get(F.filter(sentences(v), lambda s: s.rlike(p.REQUEST)), F.lit(0))
        return collapse(F.regexp_replace(found, p.ADMIN_CLAUSE, ""))

    return F.left(redact(_cyrillic(F.coalesce(text, F.lit("")), asked, lambda v: F.lit(""))), F.lit(200))


def attributes(text: Column, organization: Column | None = None) -> Column:
    """street, building and organization (if the text names it), those that are there."""
    own = collapse(text)
    pairs = [F.lit("street"), F.nullif(street(text), F.lit("")), F.lit("building"), F.nullif(_cyrillic(own, lambda v: F.regexp_extract(v, p.BUILDING, 1), lambda v: F.lit("")), F.lit(""))]
    if organization is not None:
        named = ~organization.isin("null", "None", "") & F.contains(F.lower(own), F.lower(organization))
        pairs += [F.lit("organization"), F.when(named, organization)]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def label(text: Column, kind: Column, organization: Column | None = None) -> Column:
    """The weak label as a topic."""
    return F.struct(
        domain(kind).alias("domain"), issue(text).alias("issue"), street(text).alias("object"), requested_action(text).alias("requested_action"), attributes(text, organization).alias("attributes")
    ).cast(TOPIC)


def strip_boilerplate(text: Column) -> Column:
    """Without the sentences that are boilerplate."""
    without = lambda v: collapse(F.array_join(F.filter(sentences(v), lambda s: ~s.rlike(p.BOILERPLATE_ANY)), " "))
    return _trim(_cyrillic(collapse(text), without))


def clean_clause(text: Column) -> Column:
    """``strip_boilerplate``, wrappers and names off, then all dangling identity words off the end."""
    bare = lambda v: collapse(F.regexp_replace(F.regexp_replace(v, r"^[Сс]карга\s+на\s+", ""), r"^Щодо\s+", ""))
    own = _trim(redact(_cyrillic(strip_boilerplate(text), bare)))
    return _trim(_cyrillic(own, lambda v: F.regexp_replace(v, p.DANGLING_IDENTITY, "")))


def reference_topic(text: Column, kind: Column, organization: Column | None = None) -> Column:
    return F.struct(
        domain(kind).alias("domain"),
        F.left(clean_clause(text), F.lit(400)).alias("issue"),
        street(text).alias("object"),
        F.left(_trim(redact(collapse(strip_boilerplate(requested_action(text))))), F.lit(200)).alias("requested_action"),
        attributes(text, organization).alias("attributes"),
    ).cast(TOPIC)


def condense(text: Column, most: int = 170) -> Column:
    """A clause cut to ``most`` characters at the last of the preferred cuts beyond a third of it, else at a space."""
    own = collapse(_cyrillic(clean_clause(text), lambda v: F.regexp_replace(v, p.ACTION_HEAD, "")))

    def cut(x: Column) -> Column:
        head = F.left(x, F.lit(most))
        out = F.regexp_extract(head, r"(?s)^(.*) [^ ]*$", 1)
        out = F.when(F.contains(head, F.lit(" ")), out).otherwise(head)
        for sep in reversed(p.CONDENSE_CUTS):
            at = F.length(head) - F.instr(F.reverse(head), sep[::-1]) - len(sep) + 1  # 0-based start of the last one
            there = F.contains(head, F.lit(sep)) & (at > most // 3)
            out = F.when(there, F.substring(x, F.lit(1), at)).otherwise(out)
        return F.when(F.length(x) <= most, x).otherwise(out)

    return _trim(F.transform(F.array(own), cut)[0])


def drop_tail(text: Column) -> Column:
    """Without the boilerplate sentences at the end."""

    def tail(s: Column) -> Column:
        low = F.lower(s)
        hit = F.lit(False)
        for x in p.TAIL_HAS:
            hit = hit | F.contains(low, F.lit(x))
        for x in p.TAIL_BEGINS:
            hit = hit | low.startswith(x)
        return hit

    def kept(s: Column) -> Column:
        last = F.aggregate(F.transform(s, lambda x, i: F.when(~tail(x), i + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
        return F.array_join(F.slice(s, F.lit(1), last), " ")

    return F.transform(F.array(sentences(text)), kept)[0]


#: Repairs of punctuation, in the order in which they are made.
MENDS = (
    (r"\s+([.,;:!?])", "$1"),
    (r"([.!?])\s*([.!?])", "$1"),
    (r"[.,;:]{2,}", "."),
    (r"^\s*[.,;:!\-–—]+\s*", ""),
    (r"\s*[.,;:!\-–—]+$", ""),
)


def clean_issue(text: Column) -> Column:
    """Boilerplate sentences out, then clauses (three passes), then punctuation mended (three passes), 400 characters.

    A pass that changes nothing leaves the next ones nothing to do, so a fixed number of passes stops as early.
    """
    drop = p.I + "|".join(f"(?:{x})" for x in p.DROP_SENTENCES)
    clauses = p.I + "|".join([p.ADMIN, *p.DROP_CLAUSES])

    def without(x: Column) -> Column:
        cut = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, clauses, ""), p.ANSWER_STUB, ""), p.TRAILING_VERB, "")
        return F.when(x.rlike(p.CLAUSE_STEMS), cut).otherwise(x)

    def bare(v: Column) -> Column:
        out = F.array_join(F.filter(sentences(v), lambda s: ~s.rlike(drop)), " ")
        for _ in range(3):
            out = F.transform(F.array(out), without)[0]
        return out

    def mended(v: Column) -> Column:
        for pattern, to in MENDS:
            v = F.regexp_replace(v, pattern, to)
        return strip(_cyrillic(v, lambda x: F.regexp_replace(x, p.DANGLING_HEAD, "")))

    def passes(v: Column, left: int) -> Column:
        return F.transform(F.array(mended(v)), lambda w: w if left == 1 else F.when(w == v, w).otherwise(passes(w, left - 1)))[0]

    out = F.transform(F.array(_cyrillic(collapse(text), bare)), lambda v: passes(v, 3))[0]
    return F.left(collapse(out), F.lit(400))


def action_clause(text: Column, most: int = 200) -> Column:
    """The clause of the first sentence that opens with a request verb, marker off; "take measures" needs a purpose.

    Only that first sentence counts: a generic or tiny clause ends the search with nothing.
    """
    clauses = p.I + "|".join([p.ADMIN, *p.DROP_CLAUSES])

    def body(v: Column) -> Column:
        likely = F.filter(sentences(v), lambda s: s.rlike(p.ANY_ACTION_VERB))
        bodies = F.transform(likely, lambda s: F.regexp_replace(strip(F.regexp_replace(s, clauses, "")), p.ACTION_MARKER, ""))
        return F.get(F.filter(bodies, lambda b: b.rlike(p.ACTION_VERB)), F.lit(0))

    def clause(b: Column) -> Column:
        purpose = F.trim(F.regexp_extract(b, p.PURPOSE, 0))
        generic = b.rlike(p.GENERIC_ACTION)
        own = _trim(F.regexp_replace(b, r"\s+", " "), " ,;:.!?")
        return F.when(generic & (purpose == ""), "").when(F.length(own) < 4, "").otherwise(own)

    verb = lambda c: F.trim(F.regexp_extract(c, p.ACTION_VERB, 0))
    first = _cyrillic(F.coalesce(text, F.lit("")), body, lambda v: F.lit(None).cast("string"))
    own = F.transform(F.array(first), clause)[0]  # bound, so that a body's patterns are not run again for each mention of it
    rest = F.transform(F.array(own), lambda c: F.substr(c, F.length(verb(c)) + 1))[0]
    return F.left(F.trim(F.concat_ws(" ", verb(own), strip(redact(rest)))), F.lit(most))


def note_kernel(text: Column, boilerplate=p.TAIL_HAS, leads: tuple[str, ...] = ()) -> Column:
    """What is left without request and boilerplate sentences and a leading word, redacted."""
    kept = lambda v: F.array_join(F.filter(sentences(v), lambda s: ~s.rlike(p.REQUEST) & ~_any(F.lower(s), boilerplate)), " ")
    own = _trim(_cyrillic(collapse(text), kept) if all(map(_CYRILLIC.search, boilerplate)) else kept(text))
    for lead in leads:
        own = F.when(F.lower(own).startswith(lead), strip(F.substr(own, F.lit(len(lead) + 1)))).otherwise(own)
    return _trim(redact(collapse(own)))


def _any(x: Column, parts) -> Column:
    hit = F.lit(False)
    for part in parts:
        hit = hit | F.contains(x, F.lit(part))
    return hit


def action_phrase(action: Column, leads: tuple[str, ...] = ()) -> Column:
    """A lead word off, no marks at the ends, the first letter lower."""
    own = _trim(redact(collapse(action)), " „”“’'\"")
    for lead in leads:
        own = F.when(F.lower(own).startswith(lead), strip(F.substr(own, F.lit(len(lead) + 1)))).otherwise(own)
    return lower_first(_trim(own, " .,"))


def has_request(text: Column) -> Column:
    """Whether a word begins like a request."""
    return F.coalesce(text, F.lit("")).rlike(p.REQUEST_MARKER)


def clean_topic(topic: Column) -> Column:
    """Narrator off the ends; request sentences leave the issue and become the action if there is none."""
    off = lambda x: strip(F.regexp_replace(F.coalesce(x, F.lit("")), p.NARRATION, ""))

    def of(t: Column) -> Column:
        parts = F.filter(F.split(t["issue"], r"(?<=[.!?])\s+"), lambda s: s != "")
        asks = F.filter(parts, lambda s: s.rlike(p.REQUEST_SENTENCE))
        rest = F.filter(parts, lambda s: ~s.rlike(p.REQUEST_SENTENCE))
        moved = F.array_join(F.transform(asks, lambda s: strip(F.regexp_replace(s, p.REQUEST_LEAD, ""))), " ")
        some = F.size(asks) > 0
        return F.struct(
            t["domain"].alias("domain"),
            F.when(some, strip(F.array_join(rest, " "))).otherwise(t["issue"]).alias("issue"),
            t["object"].alias("object"),
            F.when(some & (strip(t["requested_action"]) == ""), strip(moved)).otherwise(t["requested_action"]).alias("requested_action"),
            t["attributes"].alias("attributes"),
        )

    cleaned = F.struct(topic["domain"].alias("domain"), off(topic["issue"]).alias("issue"), topic["object"].alias("object"), off(topic["requested_action"]).alias("requested_action"), topic["attributes"].alias("attributes"))
    return F.transform(F.array(cleaned), of)[0]


_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_ASKS, _LEAD = re.compile(p.REQUEST_SENTENCE), re.compile(p.REQUEST_LEAD)


def _bodies(text: str) -> list[str]:
    """The request sentences of a text without their lead and end marks."""
    asked = (_LEAD.sub("", s) for s in _SENTENCE.split(text) if _ASKS.match(s))
    return [b for b in (re.sub(r"[.!?]+$", "", s).strip() for s in asked) if b]


def fill_actions(topics: list[dict], text: str) -> list[dict]:
    """Topics without an action get the text's unused requests in order; one request is split at its conjunctions where
    the pieces fit the topics."""
    empty = [t for t in topics if not (t["requested_action"] or "").strip()]
    parts: list[str] = []
    for body in _bodies(text) if empty else ():
        pieces = [x.strip() for x in re.split(r"\s+та\s+", body) if x.strip()]
        parts += pieces if 2 <= len(pieces) <= len(topics) - len(parts) else [body]
    claimed = [t["requested_action"] for t in topics if (t["requested_action"] or "").strip()]
    unused = iter([x for x in parts if not any(x in c for c in claimed)])
    return [t if (t["requested_action"] or "").strip() else t | {"requested_action": next(unused, t["requested_action"])} for t in topics]


def repair_actions(topics: list[dict], text: str, shared: int = 10, lost: int = 3) -> list[dict]:
    """Actions cut short are completed from the text's requests; an issue loses the sentence that is its own action."""
    bodies, out = _bodies(text), []
    for t in topics:
        action = (t["requested_action"] or "").strip()
        if action:
            for b in bodies:
                n = next((i for i, (x, y) in enumerate(zip(action, b)) if x != y), min(len(action), len(b)))
                if b != action and n >= shared and len(action) - n <= lost:
                    t, action = t | {"requested_action": b}, b
                    break
            said = [s for s in _SENTENCE.split(t["issue"] or "") if s]
            kept = [s for s in said if s.strip() != action]
            if 0 < len(kept) < len(said):
                t = t | {"issue": " ".join(kept).strip()}
        out.append(t)
    return out


@F.pandas_udf(ArrayType(TOPIC))
def mend(topics: pd.Series, text: pd.Series) -> pd.Series:
    """``fill_actions``, then ``repair_actions``, over array columns of topics."""
    rows = []
    for ts, x in zip(topics, text):
        own = None if ts is None else [dict(t) for t in ts]
        rows.append(own if own is None else repair_actions(fill_actions(own, x or ""), x or ""))
    return pd.Series(rows)


def render(topics: Column, location: Column | None = None, contact: Column | None = None, channel: Column | None = None) -> Column:
    """The appeal as text. Empty fields have no line. The headings."""
    line = lambda head, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(head), x))

    def one(t: Column, i: Column) -> Column:
        extra = F.transform(F.filter(F.map_entries(F.coalesce(t["attributes"], F.create_map().cast("map<string,string>"))), lambda e: F.coalesce(e["value"], F.lit("")) != ""), lambda e: F.concat(F.lit("     - "), e["key"], F.lit(": "), e["value"]))
        named = F.when(F.coalesce(F.size(t["attributes"]), F.lit(0)) > 0, F.lit("   Додаткові відомості:"))
        head = F.concat((i + 1).cast("string"), F.lit(". Проблема: "), F.coalesce(F.nullif(t["issue"], F.lit("")), F.lit("—")))
        fields = F.array_compact(F.array(head, line("   Об'єкт: ", t["object"]), line("   Сфера: ", t["domain"]), line("   Прошу: ", t["requested_action"]), named))
        return F.concat(fields, extra, F.array(F.lit("")))

    def block(head: str, x: Column | None) -> Column:
        return F.array().cast("array<string>") if x is None else F.when(F.coalesce(x, F.lit("")) != "", F.array(F.concat(F.lit(head), x), F.lit(""))).otherwise(F.array().cast("array<string>"))

    body = F.when(F.size(topics) == 0, F.array(F.lit("Проблема не визначена."), F.lit(""))).otherwise(F.flatten(F.transform(topics, one)))
    top = F.array(F.lit("Звернення громадянина до органу місцевого самоврядування"), F.lit(""))
    end = F.array(F.lit("Звернення підготовлене за допомогою асистента. Кожне твердження перевірено користувачем перед надсиланням."))
    return F.array_join(F.concat(top, block("Канал надсилання (офіційний): ", channel), body, block("Місце порушення: ", location), block("Контактні дані для відповіді: ", contact), end), "\n")


def balanced_json(text: str, start: int = 0) -> tuple[str, int] | None:
    """The bracketed value that begins at or after ``start`` and the index behind it; strings and escapes are honoured."""
    m = re.compile(r"[{\[]").search(text, start)
    if not m:
        return None
    stack, quoted, i = [], False, m.start()
    while i < len(text):
        c = text[i]
        if quoted:
            i += c == "\\"
            quoted = c != '"'
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]":
            if stack.pop() != c:
                return None
            if not stack:
                return text[m.start() : i + 1], i + 1
        i += 1
    return None


def bracket_ends(text: str) -> dict[int, int]:
    """Start and end (exclusive) of every bracketed value: what ``balanced_json`` gives at each opening bracket, for all of
    them in one pass from the right.

    A scan that starts at a bracket is outside of strings there, and from any place the rest of a scan depends on nothing
    but whether it is in a string. So for each quote, backslash and bracket two numbers are kept: the next bracket that
    counts if a scan comes by outside of a string, and if it comes by inside of one; and for each bracket the first closing
    one behind it, or itself, that nothing between has opened.
    """
    marks = [(m.start(), m.group()) for m in re.finditer(r'["\\\\{}\[\]]', text)]
    n, ends = len(marks), {}
    none = n  # no further bracket
    outside, inside, free = [none] * (n + 2), [none] * (n + 2), [none] * (n + 2)
    for j in range(n - 1, -1, -1):
        place, c = marks[j]
        if c == "\\":
            inside[j] = inside[j + 2] if j + 1 < n and marks[j + 1][0] == place + 1 else inside[j + 1]
            outside[j] = outside[j + 1]
        elif c == '"':
            outside[j], inside[j] = inside[j + 1], outside[j + 1]
        else:
            outside[j], inside[j] = j, inside[j + 1]
            if c in "}]":
                free[j] = j
            else:
                close = free[outside[j + 1]]
                if close != none and marks[close][1] == ("}" if c == "{" else "]"):
                    ends[place] = marks[close][0] + 1
                    free[j] = free[outside[close + 1]]
    return ends


def find_topics(text: str | None) -> list[dict] | None:
    """Topics from the first place of a generation that holds a valid value: an object with topics, a list of topics,
    a topic, or several topics with commas between. Every topic needs all five fields with their types. A value is read
    once, however many places lead to it."""
    import json

    from .scoring import DOMAINS

    def valid(t) -> bool:
        return (
            isinstance(t, dict)
            and t.get("domain") in DOMAINS
            and all(isinstance(t.get(k), str) for k in ("issue", "object", "requested_action"))
            and isinstance(t.get("attributes"), dict)
            and all(isinstance(v, str) for v in t["attributes"].values())
        )

    text = text or ""
    ends = bracket_ends(text)
    opening, comma, first = re.compile(r"[{\[]"), re.compile(r"\s*,"), re.compile(r'\[[ \t\n\r]*[{\]]|\{[ \t\n\r]*"')
    values: dict[int, object] = {}

    def value(at: int):
        if at not in values:
            try:
                values[at] = json.loads(text[at : ends[at]]) if first.match(text, at) else None  # nothing else holds topics
            except (ValueError, RecursionError):
                values[at] = None
        return values[at]

    def following(at: int) -> int | None:
        tail = comma.match(text, ends[at])
        m = opening.search(text, tail.end()) if tail else None
        return m.start() if m and m.start() in ends else None

    failed: set[int] = set()  # places from which a row of topics ends in something else
    for m in opening.finditer(text):
        at = m.start()
        if at not in ends:
            continue
        if following(at) is None:
            got = value(at)
            if got is None:
                continue
            topics = got if isinstance(got, list) else got.get("topics") if isinstance(got.get("topics"), list) else [got]
        else:
            row, now = [], at
            while now is not None and now not in failed and valid(value(now)):
                row.append(now)
                now = following(now)
            if now is not None:
                failed.update(row, (now,))
                continue
            topics = [values[x] for x in row]
        if all(map(valid, topics)):
            return [{k: t[k] for k in ("domain", "issue", "object", "requested_action", "attributes")} for t in topics]
    return None


@F.pandas_udf(ArrayType(TOPIC))
def parsed_topics(raw: pd.Series) -> pd.Series:
    out = pd.Series([None] * len(raw), index=raw.index, dtype=object)
    held = raw.str.contains(r"[{\[]", na=False)
    out[held] = raw[held].map(find_topics)
    return out


