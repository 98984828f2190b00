"""Queries of text functions, weak labels and TF-IDF."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as p
from ..functions import text as t
from ..operators import audit, labels, scoring, vectors
from .tables import WS, appeals, table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source")


def collapsed_text(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(t.collapse(F.col("text"))).alias("md5"))


def letter_tokens(spark: SparkSession, d: str) -> DataFrame:
    x = t.tokens(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(x).cast("long").alias("n_tokens"), F.size(F.array_distinct(x)).cast("long").alias("n_distinct"))


def squashed_text(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(t.squash(F.col("text"))).alias("md5"))


def word_sets(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.size(t.word_set(F.col("text"))).cast("long").alias("n_words"))


def plain_words(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.size(t.plain_words(F.col("text"))).cast("long").alias("n_words"))


def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.size(t.sentences(F.col("text"))).cast("long").alias("n_sentences"))


def paired_quotes(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where(F.contains("text", F.lit('"'))).select("doc_id", t.pair_quotes(F.col("text")).alias("text"))


def alternate_quotes(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where(F.contains("text", F.lit('"'))).select("doc_id", t.alternate_quotes(F.col("text")).alias("text"))


def lower_first(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(t.lower_first(F.col("text"))).alias("md5"))


def boilerplate_scores(spark: SparkSession, d: str) -> DataFrame:
    phrases = (("licensed under", 3.0), ("public license", 1.0))
    return _docs(spark, d).select("doc_id", t.boilerplate_score(F.col("text"), phrases, ("version 2", "version 3"), 2.0).alias("score"))


def topic_scores(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", t.topic_score(F.col("text"), " edth ", ("of the", "and the"), ("the", "der")).cast("long").alias("score"))


def repeated_grams(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", t.repeats_itself(F.col("text")).alias("loops"))


def benchmark_copies(spark: SparkSession, d: str) -> DataFrame:
    """How many documents hold each benchmark passage as a whole, as words; passages that none holds have no row."""
    return audit.contained(table(spark, d, "benchmark"), "item_id", _docs(spark, d), "doc_id").groupBy("item_id").agg(F.count("*").alias("n_docs"))


def private_like(spark: SparkSession, d: str) -> DataFrame:
    c = audit.private_counts(F.col("text"))
    return _docs(spark, d).select("doc_id", c["phones"].alias("phones"), c["emails"].alias("emails"))


def private_totals(spark: SparkSession, d: str) -> DataFrame:
    c = _docs(spark, d).select("lang", audit.private_counts(F.col("text")).alias("c"))
    return c.groupBy("lang").agg(F.count_if(F.col("c.phones") > 0).alias("phone_rows"), F.sum("c.phones").alias("phone_hits"), F.count_if(F.col("c.emails") > 0).alias("email_rows"), F.sum("c.emails").alias("email_hits"))


def weak_labels(spark: SparkSession, d: str) -> DataFrame:
    a = appeals(spark, d)
    return a.select("row_id", labels.label(F.col("content"), F.col("kind")).alias("t")).select("row_id", "t.domain", F.length("t.issue").alias("issue_chars"), "t.requested_action", "t.object")


def reference_topics(spark: SparkSession, d: str) -> DataFrame:
    """All five fields of each record's reference topic, the issue by its length."""
    a = appeals(spark, d)
    told = a.select("row_id", labels.reference_topic(F.col("content"), F.col("kind")).alias("t"))
    return told.select("row_id", "t.domain", F.length("t.issue").alias("issue_chars"), "t.object", "t.requested_action", F.to_json("t.attributes").alias("attributes"))


def clean_issues(spark: SparkSession, d: str) -> DataFrame:
    return appeals(spark, d).select("row_id", F.length(labels.clean_issue(F.col("content"))).alias("chars"), labels.action_clause(F.col("content")).alias("action"), F.length(labels.condense(F.col("content"))).alias("terse_chars"))


def conversation_topics(spark: SparkSession, d: str) -> DataFrame:
    """Topics read from each turn's text, cleaned and mended; turns without any have null."""
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.size(labels.mend(labels.parsed_topics(F.col("text")), F.col("text"))).alias("n_topics"))


def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return vectors.vocabulary(_docs(spark, d)).select("token", "df", F.round("idf", 6).alias("idf"))


def tfidf_weights(spark: SparkSession, d: str) -> DataFrame:
    """Each document's number of weighted tokens and its largest weight."""
    docs = _docs(spark, d)
    w = vectors.tfidf(docs, vectors.vocabulary(docs))
    return w.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.round(F.max("weight"), 6).alias("top_weight"))


def benchmark_rouge(spark: SparkSession, d: str) -> DataFrame:
    """Likeness of each whole passage to the next one's, by item_id; the last has none."""
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("a"))
    both = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("a").alias("b")), "item_id")
    return both.select("item_id", F.round(scoring.rouge_l(F.col("a"), F.col("b")), 6).alias("rouge"), F.round(scoring.token_overlap(F.col("a"), F.col("b")), 6).alias("overlap"))


def benchmark_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Matching-blocks ratio of each whole passage to the next one's words."""
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("a"))
    both = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("a").alias("b")), "item_id")
    return both.select("item_id", F.round(scoring.word_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


QUERIES = {
    f.__name__: f
    for f in (
        collapsed_text, letter_tokens, squashed_text, word_sets, plain_words, sentence_counts, paired_quotes, alternate_quotes, lower_first, boilerplate_scores, topic_scores, repeated_grams,
        benchmark_copies, private_like, private_totals, weak_labels, reference_topics, clean_issues, conversation_topics, vocabulary, tfidf_weights, benchmark_rouge, benchmark_ratio,
    )
}

_W = r"[\p{L}\p{N}_]"
_TOKENS = f"regexp_extract_all(lower(coalesce(text, '')), '{t.TOKEN.replace(chr(39), chr(39) * 2)}')"
_WORDS = rf"regexp_extract_all(lower(coalesce(text, '')), '{_W}+')"
_EMAILS = f"len(regexp_extract_all(coalesce(text, ''), '{p.LIKE_EMAIL}'))"
_PHONES = f"len(regexp_extract_all(coalesce(text, ''), '{p.LIKE_PHONE}'))"
_COLLAPSED = f"trim(regexp_replace(coalesce(text, ''), '{WS}+', ' ', 'g'))"
_VOCAB = f"""each AS (SELECT doc_id, unnest(list_distinct({_TOKENS})) AS token FROM documents),
  voc AS (SELECT token, count(*) AS df, ln((SELECT count(*) FROM documents) / (1 + count(*))) AS idf FROM each WHERE length(token) > 2 GROUP BY token HAVING count(*) >= 2)"""

ORACLE_SQL = {
    "collapsed_text": f"SELECT doc_id, md5({_COLLAPSED}) AS md5 FROM documents",
    "letter_tokens": f"SELECT doc_id, CAST(len({_TOKENS}) AS BIGINT) AS n_tokens, CAST(len(list_distinct({_TOKENS})) AS BIGINT) AS n_distinct FROM documents",
    "squashed_text": f"SELECT doc_id, md5(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))) AS md5 FROM documents",
    "word_sets": f"SELECT doc_id, CAST(len(list_distinct({_WORDS})) AS BIGINT) AS n_words FROM documents",
    "plain_words": f"""SELECT doc_id, CAST(len(list_filter(string_split_regex(regexp_replace(translate(lower(coalesce(text, '')), '’‘', ''''''),
      '[^\\p{{L}}\\p{{N}}_{WS[1:-1]}]', ' ', 'g'), '{WS}+'), lambda x: x <> '')) AS BIGINT) AS n_words FROM documents""",
    "sentence_counts": f"SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace({_COLLAPSED}, '([.!?]) +', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')) AS BIGINT) AS n_sentences FROM documents",
    "paired_quotes": f"""WITH x AS (SELECT doc_id, string_split(regexp_replace(text, '(\\p{{L}})"(\\p{{L}})', '\\1’\\2', 'g'), '"') AS p FROM documents WHERE contains(text, '"'))
      SELECT doc_id, regexp_replace(array_to_string(list_transform(p, lambda s, i: CASE WHEN i % 2 = 1 THEN s WHEN i = len(p) THEN '"' || s WHEN s = '' THEN '""' ELSE '“' || s || '”' END), ''), '^{WS}+|{WS}+$', '', 'g') AS text FROM x""",
    "alternate_quotes": """WITH RECURSIVE x AS (SELECT doc_id, string_split(text, '"') AS p FROM documents WHERE contains(text, '"')),
      r AS (SELECT doc_id, p, 1 AS i, p[1] AS text, true AS opens FROM x
        UNION ALL SELECT doc_id, p, i + 1, text || CASE WHEN regexp_matches(p[i], '[0-9A-Za-zА-яІіЇїЄєҐґ]$') AND regexp_matches(p[i + 1], '^[0-9A-Za-zА-яІіЇїЄєҐґ]') THEN '’' WHEN opens THEN '“' ELSE '”' END || p[i + 1],
          CASE WHEN regexp_matches(p[i], '[0-9A-Za-zА-яІіЇїЄєҐґ]$') AND regexp_matches(p[i + 1], '^[0-9A-Za-zА-яІіЇїЄєҐґ]') THEN true ELSE NOT opens END FROM r WHERE i < len(p))
      SELECT doc_id, text FROM r WHERE i = len(p)""",
    "lower_first": "SELECT doc_id, md5(lower(text[1:1]) || text[2:]) AS md5 FROM documents",
    "boilerplate_scores": """SELECT doc_id, CASE WHEN contains(lower(text), 'licensed under') THEN 3.0::DOUBLE ELSE 0 END + CASE WHEN contains(lower(text), 'public license') THEN 1.0::DOUBLE ELSE 0 END
      + CASE WHEN contains(lower(text), 'version 2') OR contains(lower(text), 'version 3') THEN 2.0::DOUBLE ELSE 0 END
      + CASE WHEN length(text) < 40 THEN 3.0::DOUBLE WHEN length(text) < 80 THEN 1.5 WHEN length(text) < 160 THEN 0.5 ELSE 0 END AS score FROM documents""",
    "topic_scores": """WITH l AS (SELECT doc_id, lower(text) AS x FROM documents),
      c AS (SELECT doc_id, x, len(regexp_extract_all(x, ' edth ')) AS m, len(regexp_extract_all(x, 'the')) AS r1, len(regexp_extract_all(x, 'der')) AS r2,
        len(list_filter(string_split_regex(x, '[.;\n]'), lambda s: regexp_matches(s, '^[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}]*(?: edth |the|der)'))) AS heads,
        len(list_filter(regexp_extract_all(regexp_replace(x, '([^\\p{L}\\p{N}_])', '\\1\\1', 'g') , '(?:^|[^\\p{L}\\p{N}_])(?:of  the|and  the)(?:$|[^\\p{L}\\p{N}_])'), lambda s: true)) AS j FROM l)
      SELECT doc_id, CAST(m + CAST(contains(x, 'of the') AS INTEGER) + CAST(contains(x, 'and the') AS INTEGER) + CAST(r1 >= 2 AS INTEGER) + CAST(r2 >= 2 AS INTEGER)
        + CAST(heads >= 2 AS INTEGER) + CAST(j >= 2 AS INTEGER) AS BIGINT) AS score FROM c""",
    "repeated_grams": f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_W}+') AS w FROM documents),
      g AS (SELECT doc_id, array_to_string(w[i:i + 5], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 4)) AS i FROM w WHERE len(w) >= 60)),
      m AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, g, count(*) AS n FROM g GROUP BY doc_id, g) GROUP BY doc_id)
      SELECT w.doc_id, coalesce(m.n >= 4, false) AS loops FROM w LEFT JOIN m USING (doc_id)""",
    "benchmark_copies": f"""WITH b AS (SELECT item_id, ' ' || array_to_string({_WORDS}, ' ') || ' ' AS p FROM benchmark), w AS (SELECT doc_id, ' ' || array_to_string({_WORDS}, ' ') || ' ' AS x FROM documents)
      SELECT item_id, count(*) AS n_docs FROM w JOIN b ON contains(x, p) AND length(p) > 2 GROUP BY item_id""",
    "private_like": f"SELECT doc_id, CAST({_PHONES} AS BIGINT) AS phones, CAST({_EMAILS} AS BIGINT) AS emails FROM documents",
    "private_totals": f"""SELECT lang, count(*) FILTER (WHERE {_PHONES} > 0) AS phone_rows, CAST(sum({_PHONES}) AS BIGINT) AS phone_hits, count(*) FILTER (WHERE {_EMAILS} > 0) AS email_rows,
      CAST(sum({_EMAILS}) AS BIGINT) AS email_hits FROM documents GROUP BY lang""",
    "benchmark_rouge": f"""WITH RECURSIVE w AS (SELECT item_id, list_filter(string_split_regex(text, '{WS}+'), lambda x: x <> '') AS w, list_distinct(list_filter(string_split_regex(lower(text), '{WS}+'), lambda x: x <> '')) AS s FROM benchmark),
      prs AS (SELECT x.item_id, x.w AS a, y.w AS b, len(list_intersect(x.s, y.s)) / greatest(len(x.s), 1)::DOUBLE AS overlap FROM w x JOIN w y ON y.item_id = x.item_id + 1),
      lcs AS (SELECT item_id, a, b, overlap, 0 AS i, list_transform(range(len(b) + 1), lambda z: 0::BIGINT) AS r FROM prs
        UNION ALL SELECT item_id, a, b, overlap, i + 1, list_transform(range(len(b) + 1), lambda j: list_max(list_transform(range(j + 1), lambda k: greatest(r[k + 1], CASE WHEN k >= 1 AND b[k] = a[i + 1] THEN r[k] + 1 ELSE 0 END)))) FROM lcs WHERE i < len(a))
      SELECT item_id, round(2.0 * r[len(b) + 1] / (len(a) + len(b)), 6) AS rouge, round(overlap, 6) AS overlap FROM lcs WHERE i = len(a)""",
    "vocabulary": f"WITH {_VOCAB} SELECT token, df, round(idf, 6) AS idf FROM voc",
    "tfidf_weights": f"""WITH {_VOCAB}, tok AS (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents),
      raw AS (SELECT doc_id, token, (1 + ln(count(*))) * any_value(idf) AS w FROM tok JOIN voc USING (token) GROUP BY doc_id, token),
      len AS (SELECT doc_id, sqrt(sum(w * w)) AS l FROM raw GROUP BY doc_id)
      SELECT doc_id, count(*) AS n_tokens, round(max(CASE WHEN l = 0 THEN w ELSE w / l END), 6) AS top_weight FROM raw JOIN len USING (doc_id) GROUP BY doc_id""",
}
