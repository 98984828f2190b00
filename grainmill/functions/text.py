"""Scalar text functions: Column to Column, all inside code generation.

Null in, null out, unless a function says otherwise.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 29 white-space code points of Unicode as a character class's content.
WS = r"\t-\r\x1c-\x20\x85\xa0  -     　"
BLANKS = f"[{WS}]+"
#: The same runs. Most characters are printable ASCII and end at the first test, not after all ranges of the class.
RUNS = "(?![!-~])" + BLANKS
#: The same code points one by one.
BLANK_CHARS = "".join(c for c in map(chr, range(0x3001)) if re.match(BLANKS, c))
#: A word character; the same set in every engine, unlike ``\w``.
WORD = r"[\p{L}\p{N}_]"
#: Ends of sentences: the character before stays, the blanks go.
SENTENCE_END = r"(?<=[.!?])" + BLANKS

#: Apostrophes and quotation marks.
APOSTROPHE, OPEN_QUOTE, CLOSE_QUOTE = "’", "“", "”"
TOKEN = "[a-zа-яіїєґ']+"


def strip(x: Column, extra: str = "") -> Column:
    """Without leading and trailing Unicode blanks and ``extra`` characters (of a character class)."""
    if not extra:
        return F.btrim(x, F.lit(BLANK_CHARS))  # looks at the ends only
    return F.regexp_replace(x, f"^[{WS}{extra}]+|[{WS}{extra}]+$", "")


def collapse(x: Column) -> Column:
    """Runs of blanks become one space; none at the ends. Case stays. Null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), RUNS, " "))


def normalize(x: Column) -> Column:
    """Lower case and collapsed blanks; null becomes empty. The identity of a text."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), RUNS, " "))


def sentences(x: Column) -> Column:
    """Non-empty sentences of a collapsed text."""
    return F.filter(F.split(collapse(x), SENTENCE_END), lambda s: s != "")


def tokens(x: Column) -> Column:
    """Runs of lower-case Latin or Ukrainian letters and apostrophes; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))


def word_tokens(x: Column) -> Column:
    """Lower-cased runs of word characters, repeats kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(f"({WORD}+)"), F.lit(1))


def word_set(x: Column) -> Column:
    return F.array_distinct(word_tokens(x))


def plain_words(x: Column) -> Column:
    """Lower-case words with curly apostrophes straightened and punctuation as spaces."""
    straight = F.translate(F.lower(F.coalesce(x, F.lit(""))), "’‘", "''")
    return F.filter(F.split(F.regexp_replace(straight, f"[^\\p{{L}}\\p{{N}}_{WS}]", " "), BLANKS), lambda w: w != "")


def squash(x: Column) -> Column:
    """Lower case, runs of anything but word characters as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^\\p{L}\\p{N}_]+", " "))


def one_line(x: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(x, F.lit("")), "\n", " "))


def lower_first(x: Column) -> Column:
    return F.concat(F.lower(F.left(x, F.lit(1))), F.substr(x, F.lit(2)))


def pair_quotes(x: Column) -> Column:
    """ASCII quotes to typographic ones: between two letters an apostrophe, then pairs with something between them.

    Empty pairs and single quotes stay; blanks at the ends go.
    """
    mid = F.regexp_replace(x, r'(\p{L})"(\p{L})', f"$1{APOSTROPHE}$2")
    return strip(_pairs(mid))


def _pairs(x: Column) -> Column:
    """Quotes taken two by two from the left: every second part of the split lies inside a pair."""
    parts = F.split(x, '"')

    def rebuilt(p: Column) -> Column:
        n = F.size(p)
        whole = F.transform(
            p,
            lambda s, i: F.when(i % 2 == 0, s).when(i == n - 1, F.concat(F.lit('"'), s)).when(s == "", F.lit('""')).otherwise(F.concat(F.lit(OPEN_QUOTE), s, F.lit(CLOSE_QUOTE))),
        )
        return F.array_join(whole, "")

    return F.when(~F.contains(x, F.lit('"')), x).otherwise(F.transform(F.array(parts), rebuilt)[0])


def alternate_quotes(x: Column) -> Column:
    """ASCII quotes to typographic ones of the same length, by a scan from the left.

    Between two letters or digits a quote is an apostrophe and the next one opens; any other quote opens or closes in
    turn. Idempotent.
    """
    inner = "[0-9A-Za-zА-яІіЇїЄєҐґ]"
    parts = F.split(x, '"', -1)

    def folded(p: Column) -> Column:
        start = F.struct(F.element_at(p, 1).alias("text"), F.lit(True).alias("opens"), F.element_at(p, 1).alias("before"))

        def step(a: Column, s: Column) -> Column:
            between = a["before"].rlike(inner + r"\z") & s.rlike(r"\A" + inner)
            mark = F.when(between, F.lit(APOSTROPHE)).when(a["opens"], F.lit(OPEN_QUOTE)).otherwise(F.lit(CLOSE_QUOTE))
            return F.struct(F.concat(a["text"], mark, s).alias("text"), F.when(between, True).otherwise(~a["opens"]).alias("opens"), s.alias("before"))

        return F.aggregate(F.slice(p, F.lit(2), F.size(p)), start, step)["text"]

    return F.when(~F.contains(x, F.lit('"')), x).otherwise(F.transform(F.array(parts), folded)[0])


def empty_to_null(x: Column) -> Column:
    """Stripped; null where nothing is left."""
    return F.nullif(strip(x), F.lit(""))


def contains_copy(action: Column, text: Column, least: int = 8) -> Column:
    """Whether the squashed action, of ``least`` characters or more, is part of the squashed text."""
    a = squash(action)
    return (F.length(a) >= least) & F.contains(squash(text), a)


def repeats_itself(x: Column, least_tokens: int = 60, width: int = 6, times: int = 4) -> Column:
    """Whether a text of ``least_tokens`` tokens or more has a ``width``-gram ``times`` times or more.

    Within the row: the grams are sorted, so equal ones are neighbours; no explosion, no shuffle.
    """
    own = F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(f"({WORD}+)"), F.lit(1))

    def looped(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.array_join(F.slice(w, i + 1, width), " "))
        often = F.transform(F.array(F.sort_array(grams)), lambda g: F.exists(F.transform(g, lambda v, i: v == F.get(g, i + (times - 1))), lambda b: F.coalesce(b, F.lit(False))))[0]
        return F.when(F.size(w) < F.lit(max(least_tokens, width)), F.lit(False)).otherwise(often)

    return F.transform(F.array(own), looped)[0]


#: Phrases of administrative text and their weights, and lengths with theirs.
BOILERPLATE_WEIGHTS = (
    ("відповідь заявнику", 3.0),
    ("надає згоду на обробку персональних даних", 3.0),
    ("персональних даних", 1.0),
)
PHONE_PHRASES = ("надано номер телефону", "надано номер контакт")
LENGTH_WEIGHTS = ((40, 3.0), (80, 1.5), (160, 0.5))


def boilerplate_score(x: Column, phrases=BOILERPLATE_WEIGHTS, either=PHONE_PHRASES, either_weight: float = 2.0, lengths=LENGTH_WEIGHTS) -> Column:
    """Sum of the weights of the phrases found, plus that of the first length bound the text stays below."""
    low = F.lower(F.coalesce(x, F.lit("")))
    score = F.lit(0.0)
    for phrase, weight in phrases:
        score = score + F.when(F.contains(low, F.lit(phrase)), weight).otherwise(0.0)
    any_of = F.lit(False)
    for phrase in either:
        any_of = any_of | F.contains(low, F.lit(phrase))
    size, short = F.length(F.coalesce(x, F.lit(""))), None
    for bound, weight in lengths:
        short = F.when(size < bound, weight) if short is None else short.when(size < bound, weight)
    return score + F.when(any_of, either_weight).otherwise(0.0) + (short.otherwise(0.0) if short is not None else F.lit(0.0))


#: Topic marker, connectors and request verbs.
TOPIC_MARKER, CONNECTORS, REQUESTS = "щодо", ("а також", "крім того"), ("прошу", "вимагаю")


def topic_score(x: Column, marker: str = TOPIC_MARKER, connectors=CONNECTORS, requests=REQUESTS) -> Column:
    """How much a text looks like several requests in one: markers counted, and a point for each of: each connector,
    each request verb found twice, two clauses that begin with a marker or request, two connectors found as words."""
    low = F.lower(F.coalesce(x, F.lit("")))
    count = lambda s: F.regexp_count(low, F.lit(_quoted(s)))
    one = lambda c: F.when(c, 1).otherwise(0)
    starts = "|".join(_quoted(s) for s in (marker, *requests))
    heads = F.size(F.filter(F.split(low, "[.;\n]"), lambda c: c.rlike(f"\\A[{WS}]*(?:{starts})")))
    edge = "[^\\p{L}\\p{N}_]"
    joined = F.regexp_count(low, F.lit(f"(?<![\\p{{L}}\\p{{N}}_])(?:{'|'.join(map(_quoted, connectors))})(?=\\z|{edge})"))
    score = count(marker)
    for c in connectors:
        score = score + one(F.contains(low, F.lit(c)))
    for r in requests:
        score = score + one(count(r) >= 2)
    return score + one(heads >= 2) + one(joined >= 2)


def _quoted(s: str) -> str:
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}" else c for c in s)
