"""Augmentation: pairs of records, replication, streams, corpus profiles.

Pairs are found by equality joins on a key of the first few rows of each domain, or among neighbours (``pairing``), so a
hot key never makes the square of its rows. Orders are hashes of a seed and the ids: the same rows for a seed, and not
those of another engine's random numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize, strip


def seeded(seed: int, *keys: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def single_kind(df: DataFrame, text: str = "content", kind: str = "kind") -> DataFrame:
    """Rows whose normalised text has one kind only, in all rows."""
    own = df.withColumn("__gm_t", F.md5(normalize(F.col(text))))
    several = own.groupBy("__gm_t").agg(F.min(kind).alias("lo"), F.max(kind).alias("hi")).where("lo <> hi").select("__gm_t")
    return own.join(several, "__gm_t", "left_anti").drop("__gm_t")


def without_texts(df: DataFrame, frozen: DataFrame, text: str = "content") -> DataFrame:
    """Rows whose normalised text is not in ``frozen``."""
    known = frozen.select(F.md5(normalize(F.col(text))).alias("__gm_t")).distinct()
    return df.withColumn("__gm_t", F.md5(normalize(F.col(text)))).join(known, "__gm_t", "left_anti").drop("__gm_t")


def pairs_by_key(df: DataFrame, key: str, uid: str, domain: str, per_key: int = 3, seed: int = 42) -> DataFrame:
    """(key, a_*, b_*, nth): pairs of different domains with one key, ``per_key`` a key or as many as there are, in a seeded
    order among those of the rows that take part: the first ``per_key`` rows of each domain, in a seeded order, which hold
    ``per_key`` pairs of a key if there are so many. ``pairing.pairs`` is for pairs that must meet further conditions."""
    w = Window.partitionBy(key, domain).orderBy(seeded(seed, uid), uid)
    few = df.withColumn("__gm_nth", F.row_number().over(w)).where(F.col("__gm_nth") <= per_key).drop("__gm_nth")
    a = few.select(F.col(key), *[F.col(c).alias(f"a_{c}") for c in few.columns if c != key])
    b = few.select(F.col(key), *[F.col(c).alias(f"b_{c}") for c in few.columns if c != key])
    both = a.join(b, key).where((F.col(f"a_{uid}") < F.col(f"b_{uid}")) & (F.col(f"a_{domain}") != F.col(f"b_{domain}")))
    order = Window.partitionBy(key).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(f"a_{uid}").cast("string"), F.col(f"b_{uid}").cast("string"))), f"a_{uid}", f"b_{uid}")
    return both.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_key)


def random_pairs(df: DataFrame, uid: str, domain: str, n: int, rows: int = 64, seed: int = 42, extra: Column | None = None, turns: int = 4) -> DataFrame:
    """``n`` pairs of different domains at most, for which ``extra`` holds (over a_* and b_* columns). Rows are dealt to hashed
    buckets of about ``rows`` and paired with their neighbours there, in ``turns`` seeded orders; no pair comes twice."""
    from . import pairing

    buckets, out = max(1, df.count() // rows), None
    for turn in range(turns):
        own = df.withColumn("__gm_key", F.pmod(F.xxhash64(seeded(seed + turn, uid)), F.lit(buckets)))
        side = lambda x: [F.col(f"{x}.{c}").alias(f"{x}_{c}") for c in df.columns]
        lower = F.col(f"a.{uid}") < F.col(f"b.{uid}")
        beside = pairing.neighbours(own, "__gm_key", uid, domain, seed=seed + turn).where("b is not null")
        beside = beside.select(F.when(lower, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(lower, F.col("b")).otherwise(F.col("a")).alias("b"))
        found = beside.select(F.lit(turn).alias("__gm_turn"), *side("a"), *side("b"))
        found = found.where(F.col(f"a_{domain}") != F.col(f"b_{domain}"))
        found = found if extra is None else found.where(extra)
        out = found if out is None else out.unionByName(found)
    two = [F.least(f"a_{uid}", f"b_{uid}"), F.greatest(f"a_{uid}", f"b_{uid}")]
    once = out.withColumn("__gm_nth", F.row_number().over(Window.partitionBy(*two).orderBy("__gm_turn"))).where("__gm_nth = 1")
    return once.orderBy("__gm_turn", seeded(seed, f"a_{uid}", f"b_{uid}"), f"a_{uid}").limit(n).drop("__gm_turn", "__gm_nth")


def independent(a: Column, b: Column, least: int = 30) -> Column:
    """Whether two topics' clauses can stand side by side: different, long enough, different issues and actions."""
    norm = lambda x: normalize(x)
    ia, ib, ra, rb = norm(a["issue"]), norm(b["issue"]), norm(a["requested_action"]), norm(b["requested_action"])
    return (ia != ib) & (F.length(strip(a["issue"])) >= least) & (F.length(strip(b["issue"])) >= least) & ~((ra != "") & (ra == rb))


def clash(a: Column, b: Column, rules) -> Column:
    """Whether both kinds are in one of the rule sets."""
    hit = F.lit(False)
    for rule in rules:
        hit = hit | (a.isin(*rule) & b.isin(*rule))
    return hit


def counted_rejects(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """(reason, n): rows by the first test they fail; reason kept for those that fail none. One pass."""
    reason = None
    for name, ok in tests.items():
        reason = F.when(~ok, name) if reason is None else reason.when(~ok, name)
    return df.groupBy((reason.otherwise("kept") if reason is not None else F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def stream_of(uid: Column, prefixes: tuple[tuple[str, str], ...], default: str = "single") -> Column:
    """The stream of a uid's first matching prefix; longer prefixes must come first."""
    out = None
    for prefix, name in prefixes:
        out = F.when(uid.startswith(prefix), name) if out is None else out.when(uid.startswith(prefix), name)
    return F.lit(default) if out is None else out.otherwise(default)


def replicate(df: DataFrame, times: Column, uid: str = "uid") -> DataFrame:
    """Each row ``times`` times; copies after the first get ``#n`` behind their uid."""
    many = df.withColumn("__gm_n", F.explode(F.sequence(F.lit(0), times - 1)))
    return many.where(times > 0).withColumn(uid, F.when(F.col("__gm_n") == 0, F.col(uid)).otherwise(F.concat(F.col(uid), F.lit("#"), F.col("__gm_n").cast("string")))).drop("__gm_n")


def keep_streams(df: DataFrame, all_needed: Column) -> DataFrame:
    """Rows with an issue: in every topic where ``all_needed``, else in any."""
    has = lambda t: strip(F.coalesce(t["issue"], F.lit(""))) != ""
    return df.where(F.when(all_needed, F.forall("topics", has) & (F.size("topics") > 0)).otherwise(F.exists("topics", has)))


def chat(uid: Column, system: str, user: Column, topics: Column) -> Column:
    """A three-message example with the topics as JSON text."""
    message = lambda role, x: F.struct(F.lit(role).alias("role"), x.alias("content"))
    payload = F.to_json(F.struct(topics.alias("topics")))
    return F.struct(F.array(message("system", F.lit(system)), message("user", strip(F.coalesce(user, F.lit("")))), message("assistant", payload)).alias("messages"), uid.alias("uid"))


def annotated_streams(content: DataFrame, annotations: DataFrame) -> DataFrame:
    """Real decompositions checked against their records: an annotation with fewer than two kinds or domains, or with an
    issue that the text does not hold, fails the run. ``content``: uid, content; ``annotations``: uid, kind_issues."""
    both = annotations.join(content, "uid", "left")
    kinds = F.array_distinct(F.transform("kind_issues", lambda k: k["kind"]))
    held = F.forall("kind_issues", lambda k: F.contains(normalize(F.col("content")), normalize(k["issue"])))
    why = F.when(F.col("content").isNull(), "no record").when(F.size(kinds) < 2, "one kind").when(~held, "issue not in text")
    checked = F.when(why.isNotNull(), F.raise_error(F.concat_ws(" ", F.lit("annotation of"), F.col("uid"), why))).otherwise(F.lit(True))
    return both.withColumn("__gm_ok", checked.cast("boolean")).where("__gm_ok").drop("__gm_ok")


def profile(topics: DataFrame, uid: str = "uid") -> DataFrame:
    """(n_topics, same_domain, n): how many examples have how many topics."""
    told = topics.select(F.size("topics").alias("n_topics"), (F.size(F.array_distinct(F.transform("topics", lambda t: t["domain"]))) < F.size("topics")).alias("same_domain"))
    return told.groupBy("n_topics", "same_domain").agg(F.count("*").alias("n"))


def verbatim_rate(df: DataFrame) -> DataFrame:
    """Share of single-topic issues that the text holds as they are; null without any."""
    one = df.where(F.size("topics") == 1).select(F.contains(F.col("text"), F.get("topics", F.lit(0))["issue"]).alias("held"))
    return one.agg(F.count("*").alias("n"), F.avg(F.col("held").cast("int")).alias("rate"))


def review(df: DataFrame, many: int = 6, private: str = r"(?:\+?38)?0\d{9}|\S+@\S+\.\S+") -> DataFrame:
    """One row over proposals (id, topics): counts of records by number of topics, of topics, of empty fields, of large
    attribute sets and of topics that look like holding personal data."""
    empty = lambda k: F.sum(F.size(F.filter("topics", lambda t: strip(F.coalesce(t[k], F.lit(""))) == ""))).alias(f"empty_{k}")
    joined = lambda t: F.concat_ws(" ", t["issue"], t["object"], t["requested_action"], F.map_values(F.coalesce(t["attributes"], F.create_map().cast("map<string,string>"))))
    n = F.coalesce(F.size("topics"), F.lit(0))
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(n > 0).alias("with_topics"),
        F.count_if(n == 0).alias("zero_topics"),
        F.count_if(n > 1).alias("multi_topic"),
        F.sum(n).alias("topics_total"),
        empty("issue"),
        empty("object"),
        empty("requested_action"),
        F.sum(F.size(F.filter("topics", lambda t: F.coalesce(F.size(t["attributes"]), F.lit(0)) > many))).alias("large_attributes"),
        F.sum(F.size(F.filter("topics", lambda t: joined(t).rlike(private)))).alias("private_like"),
    )


def domain_crosstab(df: DataFrame, kind: str, domains: list[str]) -> DataFrame:
    """Topics by kind and domain, a column a domain; kinds without topics are listed with zeros."""
    each = df.select(kind, F.explode_outer("topics").alias("t")).select(kind, F.col("t.domain").alias("domain"))
    return each.groupBy(kind).pivot("domain", domains).agg(F.count(F.lit(1))).na.fill(0)
