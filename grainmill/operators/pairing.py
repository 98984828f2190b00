"""Pairs of records that share a key (a street, an object), found among neighbours and never by joining a key with itself.

The records of a key are put in an order in which those of different domains alternate: the first of each domain in a
seeded order, then the second of each, and so on. The first meets the second, the third the fourth: every record is looked
at once, a key of any size takes one sort, and a key without a match ends as soon as its rows have gone by. Each pair gets
the first reason that speaks against it, or ``kept``; reasons are counted in the same pass.

A hot key, of more than ``LEAST`` records and more than a part in ``PARTS`` of all, is dealt by hash into pieces of about
that size, and pairs are found within pieces. There are fewer than ``PARTS`` such keys, so their list is broadcast. Both
numbers belong to the result and not to the cluster.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lower_first, normalize, strip
from . import augment, labels, streams

Test = Callable[[Column, Column], Column]

#: What makes a key hot.
PARTS, LEAST = 256, 4096


def _order(seed: int, *keys: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def dealt(df: DataFrame, key: str, uid: str, parts: int = PARTS, least: int = LEAST) -> DataFrame:
    """Adds ``piece``: 0, or for a hot key one of its pieces by a hash of the uid."""
    counts = df.groupBy(F.col(key).alias("__gm_k")).agg(F.count("*").alias("__gm_n"))
    total = counts.agg(F.sum("__gm_n").alias("__gm_m"))
    size = F.greatest(F.col("__gm_m") / parts, F.lit(float(least)))
    hot = counts.crossJoin(F.broadcast(total)).where(F.col("__gm_n") > size)  # the total is one row
    hot = hot.select("__gm_k", F.ceil(F.col("__gm_n") / size).cast("long").alias("__gm_p"))
    spread = F.conv(F.left(F.md5(F.col(uid).cast("string")), F.lit(8)), 16, 10).cast("long")
    both = df.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("__gm_k")), "left")
    return both.withColumn("piece", F.coalesce(spread % F.col("__gm_p"), F.lit(0)).cast("long")).drop("__gm_k", "__gm_p")


def neighbours(df: DataFrame, key: str, uid: str, domain: str, within: tuple[str, ...] = (), seed: int = 42, least: int = LEAST) -> DataFrame:
    """(key, piece, a, b): records side by side, as structs; b is null for the last of an odd number.

    ``within``: columns that both must share besides the key. Rows with a null key or a null in ``within`` take no part.
    """
    rows = dealt(df.dropna(subset=[key, *within]), key, uid, least=least)
    group = [key, "piece", *within]
    rows = rows.select(*group, F.col(domain).alias("__gm_d"), F.col(uid).cast("string").alias("__gm_u"), _order(seed, F.col(uid)).alias("__gm_o"), F.struct(*df.columns).alias("a"))
    rows = rows.repartition(*group)
    nth = F.row_number().over(Window.partitionBy(*group, "__gm_d").orderBy("__gm_o", "__gm_u"))
    line = Window.partitionBy(*group).orderBy("__gm_nth", "__gm_d", "__gm_o", "__gm_u")
    rows = rows.withColumn("__gm_nth", nth).withColumn("b", F.lead("a").over(line)).withColumn("__gm_at", F.row_number().over(line))
    return rows.where(F.col("__gm_at") % 2 == 1).select(*dict.fromkeys([key, "piece"]), "a", "b")


def pairs(
    df: DataFrame, key: str, uid: str, domain: str, tests: dict[str, Test] | None = None, within: tuple[str, ...] = (), per_key: int = 3, seed: int = 42, least: int = LEAST
) -> DataFrame:
    """(key, a, b, reason): all pairs of neighbours with the reason against them.

    Reasons, the first that applies: no_partner, same_domain, those of ``tests`` (each gives what must hold of a and b; a
    null counts as false), duplicate_pair (the same two records under a smaller key), over_cap (more than ``per_key`` of
    the key, in a seeded order), kept.
    """
    a, b = F.col("a"), F.col("b")
    reason = F.when(b.isNull(), "no_partner").when(a[domain].eqNullSafe(b[domain]), "same_domain")
    for name, holds in (tests or {}).items():
        reason = reason.when(~F.coalesce(holds(a, b), F.lit(False)), name)
    told = neighbours(df, key, uid, domain, within, seed, least).withColumn("reason", reason)
    free = F.col("reason").isNull()
    first, second = F.least(a[uid], b[uid]), F.greatest(a[uid], b[uid])
    # rows that are out already stay in parts of their own, so no window gathers them
    aside = F.when(~free, F.struct(F.col(key).cast("string"), F.col("piece"), _order(seed, a[uid])))
    again = F.row_number().over(Window.partitionBy(F.when(free, first), F.when(free, second), aside).orderBy(key))
    told = told.withColumn("reason", F.when(free & (again > 1), "duplicate_pair").otherwise(F.col("reason")))
    order = [_order(seed, a[uid], b[uid]), a[uid]]
    near = F.row_number().over(Window.partitionBy(key, "piece", free).orderBy(*order))
    told = told.withColumn("reason", F.when(free & (near > per_key), "over_cap").otherwise(F.col("reason")))
    # at most per_key of each piece are left
    far = F.row_number().over(Window.partitionBy(key, F.when(~free, F.col("piece")), free).orderBy(*order))
    return told.select(key, "a", "b", F.when(free, F.when(far > per_key, "over_cap").otherwise("kept")).otherwise(F.col("reason")).alias("reason"))


def independent_clauses(least: int = 30) -> Test:
    """Clauses that are not empty, not equal and ``least`` characters long; issues that differ; actions, where both have
    one, that differ. Records have clause_chars and the hashes that ``_thin`` gives of clause, issue and action."""

    def holds(a: Column, b: Column) -> Column:
        differ = lambda c: a[c] != b[c]
        long = F.least(a["clause_chars"], b["clause_chars"]) >= least
        return long & (a["clause_hash"] != F.md5(F.lit(""))) & differ("clause_hash") & differ("issue_hash") & (differ("action_hash") | (a["action_hash"] == F.md5(F.lit(""))))

    return holds


def _thin(rows: DataFrame, texts: tuple[str, ...], ws, hashed: tuple[str, ...] = ()) -> DataFrame:
    """Rows with lengths (and hashes of those in ``hashed``) in place of their texts, so that pairs are found without moving a
    text, and ``row``, by which the texts of those that are kept are fetched. Written: texts are dear to make, and rows are
    counted before they are dealt. What is asked of a text is asked of its length then, since a condition on the text itself
    would be pushed below and make it anew."""
    shape = [F.length(t).alias(f"{t}_chars") for t in texts] + [F.md5(normalize(F.col(t))).alias(f"{t}_hash") for t in hashed]
    return ws.table("thin", rows.select(*[c for c in rows.columns if c not in texts], *shape, _row(texts).alias("row")))


def _row(texts: tuple[str, ...]) -> Column:
    return F.md5(F.concat_ws(":", F.col("uid").cast("string"), *[F.md5(F.coalesce(F.col(t), F.lit(""))) for t in texts]))


def _told(found: DataFrame, rows: DataFrame, texts: tuple[str, ...], frozen: DataFrame, make: Callable[[Column, Column], Column], ws) -> DataFrame:
    """(street, a, b, reason, text, a_issue, b_issue): pairs with the texts of those that are kept; one whose text is frozen
    (content) gets the reason ``leakage``. Pairs are written thin; kept ones are few, are written apart so that their size
    is known, and fetch their records' texts from all ``rows``, of which no text is made for the others."""
    found = ws.table("pairs", found)
    kept = ws.table("kept", found.where("reason = 'kept'"))
    asked = ws.table("asked", kept.select(F.explode(F.array("a.uid", "b.uid")).alias("uid")).distinct())
    whole = rows.join(asked, "uid", "left_semi").select(_row(texts).alias("__gm_row"), F.struct(*texts).alias("__gm_t"))
    whole = ws.table("texts", whole.dropDuplicates(["__gm_row"]))
    for side in ("a", "b"):
        own = whole.withColumnsRenamed({"__gm_row": f"__gm_r{side}", "__gm_t": f"__gm_{side}"})
        kept = kept.join(own, F.col(f"{side}.row") == F.col(f"__gm_r{side}"))
    merged = lambda side: F.struct(F.col(f"{side}.*"), F.col(f"__gm_{side}.*"))
    kept = kept.select("street", "a", "b", "reason", merged("a").alias("__gm_x"), merged("b").alias("__gm_y"))
    kept = kept.withColumn("text", make(F.col("__gm_x"), F.col("__gm_y")))
    known = frozen.select(F.md5(normalize(F.col("content"))).alias("__gm_f")).distinct().withColumn("__gm_leaks", F.lit(True))
    kept = kept.withColumn("__gm_f", F.md5(normalize(F.col("text")))).join(known, "__gm_f", "left")
    free = F.col("__gm_leaks").isNull()
    kept = kept.select("street", "a", "b", F.when(free, "kept").otherwise("leakage").alias("reason"), *[F.when(free, c).alias(n) for c, n in ((F.col("text"), "text"), (F.col("__gm_x.issue"), "a_issue"), (F.col("__gm_y.issue"), "b_issue"))])
    none = F.lit(None).cast("string")
    return kept.unionByName(found.where("reason <> 'kept'").select("street", "a", "b", "reason", none.alias("text"), none.alias("a_issue"), none.alias("b_issue")))


def same_object(rows: DataFrame, frozen: DataFrame, ws, per_key: int = 3, seed: int = 42) -> DataFrame:
    """(street, a, b, reason, text, a_issue, b_issue): two problems of one object at one street, as one sentence.

    ``rows``: uid, kind, street, object, domain, issue, action, clause.
    """
    texts = ("issue", "action", "clause")
    rows = rows.where("object <> ''").select("uid", "kind", "street", "object", "domain", *[F.coalesce(t, F.lit("")).alias(t) for t in texts])
    found = pairs(_thin(rows, texts, ws, texts), "street", "uid", "domain", {"not_independent": independent_clauses()}, ("object",), per_key, seed)
    text = lambda a, b: F.concat(F.lit("По "), a["street"], F.lit(": "), a["clause"], F.lit(", а також "), lower_first(b["clause"]), F.lit("."))
    return _told(found, rows, texts, frozen, text, ws)


def _by_street(rows: DataFrame) -> DataFrame:
    return rows.withColumn("street", F.explode(F.array_distinct("streets"))).drop("streets")


def compact(rows: DataFrame, frozen: DataFrame, ws, per_key: int = 1, seed: int = 42, longest: int = 3000) -> DataFrame:
    """(street, a, b, reason, text, a_issue, b_issue): two issues at one street in one short paragraph. ``rows``: uid, kind,
    streets (array), domain, issue; a record takes part at each of its streets, two records make one pair only."""
    rows = rows.select("uid", "kind", "domain", "streets", strip(F.coalesce("issue", F.lit(""))).alias("issue"))
    text = lambda a, b: F.concat(F.lit("По "), a["street"], F.lit(": "), a["issue"], F.lit(", а також "), b["issue"], F.lit("."))
    fixed = len("По : , а також .")
    short = {"too_long": lambda a, b: F.length(a["street"]) + a["issue_chars"] + b["issue_chars"] + fixed <= longest}
    found = pairs(_by_street(_thin(rows, ("issue",), ws).where("issue_chars > 0")), "street", "uid", "domain", short, (), per_key, seed)
    return _told(found, rows, ("issue",), frozen, text, ws)


def same_street(rows: DataFrame, frozen: DataFrame, ws, per_key: int = 1, seed: int = 42) -> DataFrame:
    """(street, a, b, reason, text, a_issue, b_issue): two whole complaints about one street. ``rows``: uid, kind, streets,
    domain, issue, body."""
    rows = rows.select("uid", "kind", "domain", "streets", "issue", "body")
    found = pairs(_by_street(_thin(rows, ("issue", "body"), ws).where("body_chars > 0 and issue_chars > 0")), "street", "uid", "domain", None, (), per_key, seed)
    return _told(found, rows, ("issue", "body"), frozen, lambda a, b: F.concat(a["body"], F.lit(" а також "), b["body"]), ws)


def rejects(told: DataFrame, *by: str) -> DataFrame:
    """(reason, n): every reason with its number of pairs, ``kept`` among them."""
    return told.groupBy(*by, "reason").agg(F.count("*").alias("n"))


def labelled(records: DataFrame, frozen: DataFrame, ws, mapping=None) -> DataFrame:
    """What pairs are made of, from raw records (uid, kind, content): those whose text has one kind, is not frozen and
    leaves an issue. uid, kind, domain, street, streets, object, issue, action, clause, body. Written, since labels are
    dear."""
    from ..functions import patterns as p

    own = augment.without_texts(augment.single_kind(records), frozen)
    topic = labels.reference_topic(F.col("content"), F.col("kind"))
    domain = labels.domain(F.col("kind"), p.KIND_TO_DOMAIN if mapping is None else mapping)
    told = own.select("uid", "kind", "content", domain.alias("domain"), topic.alias("t"))
    told = told.select(
        "uid", "kind", "domain", F.col("t.object").alias("street"), labels.streets(F.col("content")).alias("streets"), F.col("t.object").alias("object"),
        F.col("t.issue").alias("issue"), F.col("t.requested_action").alias("action"), labels.condense(F.col("content")).alias("clause"),
        labels.drop_tail(F.col("content")).alias("body"),
    )
    return ws.table("labelled", told.where("issue <> ''"))


def examples(told: DataFrame, prefix: str, own_issues: bool = True) -> DataFrame:
    """(uid, text, topics, sources): kept pairs as training examples, relabelled from each topic's own issue; one whose
    issue comes out empty is left out. ``told``: a, b (uid, kind, domain), text, a_issue, b_issue."""
    kept = told.where("reason = 'kept'").withColumn("uid", F.concat(F.lit(prefix), F.col("a.uid").cast("string"), F.lit("-"), F.col("b.uid").cast("string")))
    topic = lambda x, issue: streams.topic_of(issue, x["kind"]).withField("domain", x["domain"])
    made = kept.select("uid", "text", F.array(topic(F.col("a"), F.col("a_issue")), topic(F.col("b"), F.col("b_issue"))).alias("topics"), F.array(F.col("a.uid"), F.col("b.uid")).alias("sources"))
    told = streams.relabelled(made, F.lit(own_issues))
    return told.where(F.forall("topics", lambda t: strip(t["issue"]) != "")).select("uid", "text", "topics", "sources")
