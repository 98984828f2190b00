"""Quality rules by distribution divergence, in DataFrame functions alone.

A document's histogram of character classes and its histogram of common words are compared with its language's
references by Jensen-Shannon distance (base 2, so 0 to 1). The references come from the corpus itself: the common
words are a language's most frequent words of letters, counted exactly, and a reference histogram is the mean of the
histograms of documents, so long documents weigh no more than others. It is taken of the documents that pass the base
rules and are near their medians, bin by bin, so that junk does not shape what it is judged by as long as it is the
smaller part of a language.

Guards: a histogram of few characters or words is noise, so a document shorter than ``MIN_CHARS`` code points is not
judged by its characters and one of fewer than ``MIN_WORDS`` words not by its words; from there on the bounds narrow with
the square root of the number of words.

Base rules: fewer than 50 words, or more than half of the words in 3-word windows that occur twice or more.

Nulls, ties, repeats: a null text has no words and fails the base; a null lang is a language of its own; a language
without a document that passes the base has no reference, and its distances are 0; of words as frequent the first by
code point is commoner; equal rows give equal rows; an empty table gives an empty result. Only doc_id, text and lang are
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Workspace
from .text import SPACE, let

#: Common words of a language, and the groups that its words are dealt to before the most frequent are chosen.
COMMON, GROUPS = 24, 64
#: Parts of 1 that shares are counted in for their medians.
STEPS = 1000
#: Code points from which on a histogram of characters is judged, words from which on one of words is.
MIN_CHARS, MIN_WORDS = 300, 60
#: Distances above these are too far from the language: a bound for long texts, and how much it widens for short ones,
#: whose histograms are noisy, over the square root of the number of words.
CHAR_BOUND, WORD_BOUND = (0.12, 1.1), (0.12, 1.7)

SYMBOLS = "[#*$%&|<>]"
CLASSES = (r"\p{Lu}", r"\p{Nd}", r"[.,;:!?'\"()-]", r"[^\p{L}\p{M}\p{Nd}\x20\x09-\x0D.,;:!?'\"()-]")


def repeated(words: Column) -> Column:
    """How many words lie in 3-word windows whose words occur twice or more as a window.

    Windows are told apart by 64-bit hashes. Where all are distinct, as in most short texts, nothing repeats. Else they
    are sorted with their positions, so equal ones are neighbours; then the positions of repeated ones are sorted, and
    each covers up to three words beyond the one before.
    """
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def positions(s: Column) -> Column:
        same = lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])
        return F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["p"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def counted(h: Column) -> Column:
        windows = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(let(F.sort_array(windows), positions), covered))

    found = let(hashes, counted)
    return F.when(F.size(words) >= 4, found).otherwise(0).cast("long")


def base_stats(text: Column, extra=lambda words: []) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and ``extra`` columns of the words."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = F.array_remove(F.split(text, SPACE), "")
    dup = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            dup.cast("long").alias("n_dup_lines"),
            repeated(w).alias("n_repeat_words"),
            *extra(w),
        ),
    )


def runs(words: Column, common: Column) -> Column:
    """Array of (k, c): the k-th common word occurs c times; k from 1."""

    def counted(s: Column) -> Column:
        ends = F.filter(F.transform(s, lambda x, i: F.struct(x.alias("k"), (i + 1).alias("e"))), lambda x, i: F.coalesce(x["k"] != F.get(s, i + 1), F.lit(True)))
        return let(ends, lambda e: F.transform(e, lambda x, i: F.struct(x["k"].alias("k"), (x["e"] - F.coalesce(F.get(e, i - 1)["e"], F.lit(0))).cast("long").alias("c"))))

    longest = F.array_max(F.transform(common, lambda x: F.octet_length(x)))  # most words are longer and need no look
    short = let(longest, lambda most: F.filter(words, lambda x: F.octet_length(x) <= most))
    found = F.filter(F.transform(short, lambda x: F.array_position(common, x)), lambda k: k > 0)
    return F.when(common.isNull(), F.array().cast("array<struct<k:bigint,c:bigint>>")).otherwise(let(F.sort_array(found), counted))


def class_counts(text: Column) -> Column:
    """Counts of upper-case letters, digits, punctuation, other signs; letters and spaces follow from the lengths.

    Runs of a-z and blanks, which no class has, are taken out first: what is left is a small part of a text.
    """
    rest = F.regexp_replace(F.coalesce(text, F.lit("")), r"[a-z\x20\x09-\x0D]++", "")
    return let(rest, lambda x: F.array(*[F.regexp_count(x, F.lit(c)).cast("long") for c in CLASSES]))


def divergence(p: Column, q: Column) -> Column:
    """One bin's part of the Jensen-Shannon divergence in bits."""
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return (part(p) + part(q)) / 2


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def common_words(documents: DataFrame, common: int = COMMON, groups: int = GROUPS) -> DataFrame:
    """lang and its most frequent words of letters, most frequent first. A row a language.

    Words are counted with partial sums; the best of each of some hashed groups meet, so no task ranks a whole vocabulary.
    """
    each = documents.select("lang", F.explode(F.split(F.coalesce("text", F.lit("")), SPACE)).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n"))
    each = each.where(F.col("w").rlike(r"^\p{L}+$"))
    order = [F.col("n").desc(), F.col("w")]
    part = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("w"), F.lit(groups))).orderBy(*order))
    best = each.withColumn("nth", part).where(F.col("nth") <= common)
    best = best.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("nth") <= common)
    return best.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "w"))), lambda x: x["w"]).alias("common"))


def references(rows: DataFrame) -> DataFrame:
    """of (the language), char_ref and word_ref (common word to share): the means of the rows' histograms. ``rows``: lang,
    shares, runs, n_words. A row a language."""
    per_class = rows.select("lang", F.posexplode("shares").alias("i", "x")).groupBy("lang", "i").agg(F.avg("x").alias("x"))
    chars = per_class.groupBy(F.col("lang").alias("of")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("char_ref"))
    n = rows.groupBy(F.col("lang").alias("l1")).agg(F.count("*").alias("n"))
    per_word = rows.select("lang", F.explode("runs").alias("r"), "n_words").groupBy("lang", F.col("r.k").alias("k")).agg(F.sum(F.col("r.c") / F.col("n_words")).alias("x"))
    sums = per_word.groupBy(F.col("lang").alias("l2")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "x")))).alias("sums"))
    both = chars.join(n, F.col("of").eqNullSafe(F.col("l1"))).join(sums, F.col("of").eqNullSafe(F.col("l2")), "left")
    return both.select("of", "char_ref", F.transform_values("sums", lambda k, x: x / F.col("n")).alias("word_ref"))


def medians(rows: DataFrame) -> DataFrame:
    """The same of the bins' medians, to a part in ``STEPS``; those of the characters' bins scaled to make 1.

    Shares are counted by language, bin and step, so no language is sorted as a whole.
    """
    step = lambda x: F.round(x * STEPS).cast("int")
    n = rows.groupBy(F.col("lang").alias("of")).agg(F.count("*").alias("n"))
    chars = rows.select("lang", F.lit(0).alias("kind"), F.posexplode("shares").alias("i", "x")).select("lang", "kind", F.col("i").cast("long").alias("i"), step(F.col("x")).alias("b"))
    words = rows.select("lang", F.lit(1).alias("kind"), F.explode("runs").alias("r"), "n_words").select("lang", "kind", F.col("r.k").alias("i"), step(F.col("r.c") / F.col("n_words")).alias("b"))
    seen = chars.unionByName(words).groupBy("lang", "kind", "i", "b").agg(F.count("*").alias("c")).join(n, F.col("lang").eqNullSafe(F.col("of"))).drop("of")
    # documents without the bin have a share of 0
    absent = seen.groupBy("lang", "kind", "i", "n").agg((F.col("n") - F.sum("c")).alias("c")).withColumn("b", F.lit(0))
    steps = seen.unionByName(absent.select(*seen.columns)).groupBy("lang", "kind", "i", "n", "b").agg(F.sum("c").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("lang", "kind", "i").orderBy("b"))
    middle = steps.withColumn("upto", upto).where(2 * F.col("upto") >= F.col("n")).groupBy("lang", "kind", "i").agg((F.min("b") / STEPS).alias("x"))
    of = lambda kind: F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("i", "x"))))
    told = middle.groupBy(F.col("lang").alias("of")).agg(of(0).alias("c"), of(1).alias("w"))
    total = F.greatest(_sum(F.transform("c", lambda s: s["x"])), F.lit(1 / STEPS))
    return told.select("of", F.transform("c", lambda s: s["x"] / total).alias("char_ref"), F.when(F.size("w") > 0, F.map_from_entries("w")).alias("word_ref"))


def distances(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """Adds char_distance and word_distance to ``rows``; 0 without a reference."""
    char_distance = F.sqrt(F.greatest(_sum(F.zip_with("shares", "char_ref", divergence)), F.lit(0.0)))
    q = lambda k: F.coalesce(F.element_at("word_ref", k), F.lit(0.0))
    n = F.greatest(F.col("n_words"), F.lit(1))
    bins = F.transform("runs", lambda r: F.struct((r["c"] / n).alias("p"), q(r["k"]).alias("q")))

    def of_words(b: Column) -> Column:
        p_in, q_in = _sum(F.transform(b, lambda x: x["p"])), _sum(F.transform(b, lambda x: x["q"]))
        q_all = _sum(F.map_values("word_ref"))
        return _sum(F.transform(b, lambda x: divergence(x["p"], x["q"]))) + F.greatest(q_all - q_in, F.lit(0.0)) / 2 + divergence(F.greatest(1 - p_in, F.lit(0.0)), F.greatest(1 - q_all, F.lit(0.0)))

    word_distance = F.when(F.col("word_ref").isNull(), F.lit(0.0)).otherwise(F.sqrt(F.greatest(let(bins, of_words), F.lit(0.0))))
    joined = rows.join(refs, F.col("lang").eqNullSafe(F.col("of")), "left")
    return joined.withColumns({"char_distance": F.round(F.coalesce(char_distance, F.lit(0.0)), 6), "word_distance": F.round(F.coalesce(word_distance, F.lit(0.0)), 6)}).drop("of", "char_ref", "word_ref")


def near(char_bound=CHAR_BOUND, word_bound=WORD_BOUND, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS) -> Column:
    """Whether the distances are within the bounds, where the text is long enough for them."""
    noise = 1 / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    by_chars = (F.col("chars") < min_chars) | (F.col("char_distance") <= char_bound[0] + char_bound[1] * noise)
    return by_chars & ((F.col("n_words") < min_words) | (F.col("word_distance") <= word_bound[0] + word_bound[1] * noise))


def judge(documents: DataFrame, ws: Workspace, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS, char_bound=CHAR_BOUND, word_bound=WORD_BOUND) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, char_distance and word_distance of every whole text.

    Texts are read twice (common words, counts) and never shuffled; what is joined by language is a row a language,
    which Spark broadcasts as long as its size allows and joins by shuffle beyond.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    listed = ws.table("common", common_words(docs)).select(F.col("lang").alias("of"), "common")
    stats = docs.join(listed, F.col("lang").eqNullSafe(F.col("of")), "left").select(
        "doc_id",
        "lang",
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"),
        class_counts(F.col("text")).alias("classes"),
        base_stats(F.col("text"), lambda w: [runs(w, F.col("common")).alias("runs")]).alias("s"),
    )
    stats = ws.table("stats", stats.select("doc_id", "lang", "chars", "classes", "s.*"))
    ws.drop("common")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))

    spaces = F.col("chars") - F.col("word_chars")
    rest = F.col("chars") - spaces - F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x)
    shares = F.transform(F.concat("classes", F.array(spaces, rest)), lambda x: x / F.greatest(F.col("chars"), F.lit(1)))
    seen = stats.withColumn("base_failed", failed).withColumn("shares", shares)
    within = near(char_bound, word_bound, min_chars, min_words)

    passed = seen.where(~F.col("base_failed"))
    first = ws.table("medians", medians(passed))
    again = references(distances(passed, first).where(within)).withColumnsRenamed({"of": "of2", "char_ref": "char2", "word_ref": "word2"})
    refs = first.join(again, F.col("of").eqNullSafe(F.col("of2")), "left")
    refs = ws.table("references", refs.select("of", F.coalesce("char2", "char_ref").alias("char_ref"), F.when(F.col("char2").isNull(), F.col("word_ref")).otherwise(F.col("word2")).alias("word_ref")))
    ws.drop("medians")
    judged = distances(seen, refs)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & within).alias("kept"), "char_distance", "word_distance")


def _sql() -> str:
    """The whole report in SQL."""
    d = lambda p, q: f"((CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0 END) + (CASE WHEN {q} > 0 THEN {q} * log2({q} / (({p} + {q}) / 2)) ELSE 0 END)) / 2"
    bound = lambda b: f"{b[0]} + {b[1]} / sqrt(greatest(n_words, 1))"
    within = f"(chars < {MIN_CHARS} OR char_distance <= {bound(CHAR_BOUND)}) AND (n_words < {MIN_WORDS} OR word_distance <= {bound(WORD_BOUND)})"
    same = "IS NOT DISTINCT FROM"
    medians = ", ".join(f"max(CASE WHEN i = {i} THEN x END) / any_value(z.z) AS r{i}" for i in range(1, 7))

    def refs(k: int, rows: str) -> str:
        means = ", ".join(f"avg(s[{i}]) AS r{i}" for i in range(1, 7))
        return f"""
cref{k} AS (SELECT lang, count(*) AS n, {means} FROM {rows} GROUP BY lang),
wref{k} AS (SELECT r.lang, c.nth, sum(c.c / r.n_words) / any_value(f.n) AS q FROM {rows} r JOIN cnt c USING (rid) JOIN cref{k} f ON r.lang {same} f.lang GROUP BY r.lang, c.nth),
wall{k} AS (SELECT lang, sum(q) AS q_all FROM wref{k} GROUP BY lang)"""

    def told(k: int, refs: int, rows: str) -> str:
        chars = " + ".join(d(f"r.s[{i}]", f"f.r{i}") for i in range(1, 7))
        return f"""
wpart{k} AS (SELECT r.rid, sum({d('(c.c / r.n_words)', 'coalesce(w.q, 0)')}) AS part, sum(c.c / r.n_words) AS p_in, sum(coalesce(w.q, 0)) AS q_in
  FROM {rows} r JOIN cnt c USING (rid) LEFT JOIN wref{refs} w ON w.lang {same} r.lang AND w.nth = c.nth GROUP BY r.rid),
dist{k} AS (SELECT r.*, round(coalesce(sqrt(greatest({chars}, 0)), 0), 6) AS char_distance,
    round(coalesce(CASE WHEN a.q_all IS NULL THEN 0 ELSE sqrt(greatest(coalesce(p.part, 0) + greatest(a.q_all - coalesce(p.q_in, 0), 0) / 2
      + {d('greatest(1 - coalesce(p.p_in, 0), 0)', 'greatest(1 - a.q_all, 0)')}, 0)) END, 0), 6) AS word_distance
  FROM {rows} r LEFT JOIN cref{refs} f ON r.lang {same} f.lang LEFT JOIN wall{refs} a ON a.lang {same} r.lang LEFT JOIN wpart{k} p USING (rid))"""

    return rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, lang FROM documents),
words AS (SELECT *, regexp_extract_all(text, '[^ 	-
]+') AS w, length(text) AS chars, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS lines FROM docs),
each AS (SELECT rid, lang, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words),
grams AS (SELECT rid, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS g FROM each WINDOW o AS (PARTITION BY rid ORDER BY i)),
twice AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS k FROM grams WHERE g IS NOT NULL) WHERE k > 1),
cover AS (SELECT rid, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS j) GROUP BY rid),
counted AS (SELECT lang, word, count(*) AS n FROM each WHERE regexp_full_match(word, '\p{{L}}+') GROUP BY lang, word),
common AS (SELECT lang, word, nth FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, encode(word)) AS nth FROM counted) WHERE nth <= {COMMON}),
cnt AS (SELECT e.rid, c.nth, count(*)::DOUBLE AS c FROM each e JOIN common c ON e.lang {same} c.lang AND e.word = c.word GROUP BY e.rid, c.nth),
base AS (SELECT rid, doc_id, lang, chars, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '{SYMBOLS}')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    len(regexp_extract_all(text, '\p{{Lu}}')) AS c1, len(regexp_extract_all(text, '\p{{Nd}}')) AS c2, len(regexp_extract_all(text, '[.,;:!?''"()-]')) AS c3,
    len(regexp_extract_all(text, '[^\p{{L}}\p{{M}}\p{{Nd}} 	-
.,;:!?''"()-]')) AS c4
  FROM words LEFT JOIN cover USING (rid)),
seen AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    list_transform([c1, c2, c3, c4, chars - word_chars, word_chars - c1 - c2 - c3 - c4], lambda x: x / greatest(chars, 1)::DOUBLE) AS s FROM base),
passed AS (SELECT * FROM seen WHERE NOT base_failed),
total AS (SELECT lang, count(*) AS n FROM passed GROUP BY lang),
steps AS (SELECT lang, 0 AS kind, i, round(x * {STEPS})::INT AS b FROM (SELECT lang, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM passed)
  UNION ALL SELECT r.lang, 1, c.nth, round(c.c / r.n_words * {STEPS})::INT FROM passed r JOIN cnt c USING (rid)),
counts AS (SELECT lang, kind, i, b, count(*) AS c FROM steps GROUP BY ALL),
filled AS (SELECT lang, kind, i, b, sum(c) AS c FROM (SELECT * FROM counts UNION ALL
  SELECT c.lang, kind, i, 0, any_value(t.n) - sum(c.c) FROM counts c JOIN total t ON c.lang {same} t.lang GROUP BY c.lang, kind, i) GROUP BY ALL),
upto AS (SELECT *, sum(c) OVER (PARTITION BY lang, kind, i ORDER BY b) AS up FROM filled),
mid AS (SELECT u.lang, kind, i, min(b) / {STEPS}::DOUBLE AS x FROM upto u JOIN total t ON u.lang {same} t.lang WHERE 2 * up >= t.n GROUP BY u.lang, kind, i),
cref1 AS (SELECT m.lang, any_value(t.n) AS n, {medians} FROM mid m JOIN total t ON m.lang {same} t.lang
  JOIN (SELECT lang, greatest(sum(x), 1 / {STEPS}::DOUBLE) AS z FROM mid WHERE kind = 0 GROUP BY lang) z ON m.lang {same} z.lang WHERE kind = 0 GROUP BY m.lang),
wref1 AS (SELECT lang, i AS nth, x AS q FROM mid WHERE kind = 1),
wall1 AS (SELECT lang, sum(q) AS q_all FROM wref1 GROUP BY lang),{told(1, 1, 'passed')},
good AS (SELECT * FROM dist1 WHERE {within}),{refs(2, 'good')},
cref3 AS (SELECT * FROM cref2 UNION ALL SELECT f.* FROM cref1 f WHERE NOT EXISTS (SELECT 1 FROM cref2 g WHERE g.lang {same} f.lang)),
wref3 AS (SELECT * FROM wref2 UNION ALL SELECT w.* FROM wref1 w WHERE NOT EXISTS (SELECT 1 FROM cref2 g WHERE g.lang {same} w.lang)),
wall3 AS (SELECT lang, sum(q) AS q_all FROM wref3 GROUP BY lang),{told(2, 3, 'seen')}
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  base_failed, NOT base_failed AND {within} AS kept, char_distance, word_distance FROM dist2
"""


SQL = _sql()
