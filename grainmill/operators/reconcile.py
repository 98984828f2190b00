"""Strict JSON, validation of annotations, reconciliation of expected and supplied records, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .scoring import DOMAINS

_END = "#end-of-json#"
#: A topic's fields. The error strings below are fixed, too: reports compare them.
FIELDS = ("domain", "issue", "object", "requested_action", "attributes")


def strict_json(raw: Column) -> Column:
    """The text as a variant where it is one JSON value and nothing else; else null.

    The parser accepts text behind a value, so the value is parsed as the first of two array elements, of which the
    second is known; anything left over would make more or other elements.
    """
    return F.try_variant_get(strict_array(raw), "$[0]", "variant")


def strict_array(raw: Column) -> Column:
    """The two elements of ``strict_json`` as one variant, parsed once; null where the text isn't one JSON value.

    Blank text leaves nothing before the comma, which is no JSON.
    """
    return F.transform(F.array(wrapped(raw)), unspoilt)[0]


def wrapped(raw: Column) -> Column:
    """An array of the text's value and a known end, as a variant; null where the text begins with no JSON value."""
    return F.try_parse_json(F.concat(F.lit("["), strip(F.coalesce(raw, F.lit(""))), F.lit(f',"{_END}"]')))


def unspoilt(w: Column) -> Column:
    """The array of ``wrapped`` where it has its two elements, else null."""
    return F.when((F.try_variant_get(w, "$[1]", "string") == _END) & F.try_variant_get(w, "$[2]", "variant").isNull(), w)


def parse_error(raw: Column) -> Column:
    """Why a prediction is not an object with a list of topics; empty where it is."""
    v = strict_json(raw)
    kind = F.schema_of_variant(v)
    topics = F.try_variant_get(v, "$.topics", "variant")
    return (
        F.when(strip(F.coalesce(raw, F.lit(""))) == "", "empty output")
        .when(v.isNull(), "not strict JSON")
        .when(~kind.startswith("OBJECT"), F.concat(F.lit("top level is "), F.lower(F.regexp_extract(kind, r"^\w+", 0))))
        .when(topics.isNull() | ~F.coalesce(F.schema_of_variant(topics).startswith("ARRAY"), F.lit(False)), "missing 'topics' array")
        .otherwise("")
    )


def braced(raw: Column) -> Column:
    """From the first opening to the last closing brace; the text itself where there is no such pair."""
    found = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    return F.when((raw.startswith("{") & raw.endswith("}")) | (found == ""), raw).otherwise(found)


def topics_of(raw: Column, permissive: bool = False) -> Column:
    """Array of topic variants, or null."""
    return F.try_variant_get(strict_json(braced(raw) if permissive else raw), "$.topics", "array<variant>")


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def topic_errors(topic: Column, domains=DOMAINS) -> Column:
    """Contract violations of a topic variant: keys missing or unexpected, types, domain, blank issue."""
    is_object = F.coalesce(F.schema_of_variant(topic).startswith("OBJECT"), F.lit(False))
    keys = F.map_keys(F.coalesce(topic.try_cast("map<string,variant>"), F.create_map().cast("map<string,variant>")))
    known = F.array(*map(F.lit, FIELDS))
    listed = lambda head, names: F.when(F.size(names) > 0, F.concat(F.lit(head), F.array_join(F.sort_array(names), ",")))
    text = lambda k: F.try_variant_get(topic, f"$.{k}", "string")
    wrong = [
        F.when(_kind(topic, f"$.{k}").isNotNull() & ~_kind(topic, f"$.{k}").isin("STRING", "VOID"), F.lit(f"{k} is not a string")) for k in ("issue", "object", "requested_action")
    ]
    attributes = _kind(topic, "$.attributes")
    checks = [
        listed("missing ", F.array_except(known, keys)),
        listed("unexpected ", F.array_except(keys, known)),
        F.when(~F.coalesce((_kind(topic, "$.domain") == "STRING") & text("domain").isin(*domains), F.lit(False)), "unknown domain"),
        *wrong,
        F.when(attributes.isNotNull() & ~attributes.startswith("OBJECT") & (attributes != "VOID"), "attributes is not an object"),
        F.when(strip(F.coalesce(text("issue"), F.lit(""))) == "", "blank issue"),
    ]
    return F.when(~is_object, F.array(F.lit("not an object"))).otherwise(F.array_compact(F.array(*checks)))


def annotation_schema() -> dict:
    """The contract as a JSON Schema (draft 7), for tools outside Spark; ``topic_errors`` is its check here."""
    text = {"type": "string"}
    topic = {"domain": {"type": "string", "enum": list(DOMAINS)}, "issue": text, "object": {"oneOf": [{"type": "object"}, text]}, "requested_action": text, "attributes": {"type": "object"}}
    return {
        "$schema": "http://json-schema.org/draft-07/schema#", "type": "object", "required": ["topics"], "additionalProperties": False,
        "properties": {"topics": {"type": "array", "items": {"$ref": "#/definitions/topic"}}},
        "definitions": {"topic": {"type": "object", "required": list(FIELDS), "additionalProperties": False, "properties": topic}},
    }


def contract_errors(df: DataFrame, raw: str = "raw", key: str = "id") -> DataFrame:
    """(key, topic, error): a row a violation; topic is null for those of the whole payload."""
    whole = df.select(key, F.lit(None).cast("int").alias("topic"), parse_error(F.col(raw)).alias("error")).where("error <> ''")
    each = df.select(key, F.posexplode(topics_of(F.col(raw))).alias("topic", "t")).select(key, "topic", F.explode(topic_errors(F.col("t"))).alias("error"))
    return whole.unionByName(each)


def wrapper_errors(raw: Column) -> Column:
    """What stands around or before the JSON of a generation."""
    head = F.ltrim(F.coalesce(raw, F.lit("")))
    tests = [
        (F.contains(raw, F.lit("<think>")) | F.contains(raw, F.lit("</think>")), "thinking text"),
        (head.startswith("```"), "markdown fence"),
        (head.startswith("!"), "wrapper before JSON"),
        (head.rlike(r"\A\p{L}"), "prose before JSON"),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in tests]))


def reconcile(expected: DataFrame, supplied: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(category, id, n): ids missing, unknown, supplied twice, or supplied with another text than expected.

    One full join on the id, after each side is counted by id; texts are compared as hashes, of which the least and the
    greatest of an id tell whether one differs.
    """
    want = expected.select(F.col(key).alias("id"), F.md5(text).alias("h"), F.lit(1).alias("w"))
    got = supplied.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n"), F.min(F.md5(text)).alias("lo"), F.max(F.md5(text)).alias("hi"))
    both = want.join(got, "id", "full_outer")
    tests = [
        ("missing_id", F.col("n").isNull()),
        ("unknown_id", F.col("w").isNull()),
        ("duplicate_id", F.col("n") > 1),
        ("changed_text", F.col("w").isNotNull() & F.coalesce((F.col("lo") != F.col("h")) | (F.col("hi") != F.col("h")), F.col("lo").isNotNull() & F.col("h").isNull(), F.lit(False))),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in tests]))
    return both.select(F.explode(found).alias("category"), "id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def merge_in_order(base: DataFrame, extra: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Base rows with their one extra row, in base order; a key missing on either side fails the run."""
    left = base.withColumn("__gm_l", F.lit(1))
    right = extra.withColumn("__gm_r", F.lit(1))
    both = left.join(right, key, "full_outer")
    bad = F.col("__gm_l").isNull() | F.col("__gm_r").isNull()
    checked = F.when(bad, F.raise_error(F.concat(F.lit("no partner for "), F.col(key).cast("string")))).otherwise(F.lit(True))
    return both.withColumn("__gm_ok", checked.cast("boolean")).where("__gm_ok").drop("__gm_l", "__gm_r", "__gm_ok").orderBy(ordinal)


def changes(recorded: DataFrame, current: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, state) of two manifests: removed, added, changed or unchanged."""
    a = recorded.select(*keys, F.col(value).alias("old"), F.lit(1).alias("in_old"))
    b = current.select(*keys, F.col(value).alias("new"), F.lit(1).alias("in_new"))
    both = a.join(b, keys, "full_outer")
    state = F.when(F.col("in_new").isNull(), "removed").when(F.col("in_old").isNull(), "added").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("changed")
    return both.select(*keys, state.alias("state"))


def latest(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The last row of each key: what a lookup built in input order ends up with."""
    names = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*names), ordinal).alias("r")).select(key, "r.*")


def lookup(df: DataFrame, table: DataFrame, key: str, ordinal: str, fallback_suffix: str = "-") -> DataFrame:
    """Each row with its key's last row of the table, or that of the key with a suffix; without either the run fails."""
    own = latest(table, key, ordinal)
    names = [c for c in own.columns if c != key]
    packed = own.select(F.col(key).alias("__gm_k"), F.struct(*names).alias("r"))
    exact = df.join(packed.withColumnRenamed("r", "r1"), F.col(key) == F.col("__gm_k"), "left").drop("__gm_k")
    either = exact.join(packed.withColumnRenamed("r", "r2"), F.concat(F.col(key).cast("string"), F.lit(fallback_suffix)) == F.col("__gm_k").cast("string"), "left").drop("__gm_k")
    found = F.coalesce("r1", "r2")
    checked = F.when(found.isNull(), F.raise_error(F.concat(F.lit("no record for "), F.col(key).cast("string"))).cast(packed.schema["r"].dataType)).otherwise(found)
    return either.withColumn("found", checked).drop("r1", "r2")


def resume(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is still to do."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def set_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): left, right or both."""
    both = a.select(key).distinct().withColumn("l", F.lit(1)).join(b.select(key).distinct().withColumn("r", F.lit(1)), key, "full_outer")
    return both.select(key, F.when(F.col("r").isNull(), "left").when(F.col("l").isNull(), "right").otherwise("both").alias("side"))


def prefix_reason(paths: DataFrame, reasons: DataFrame) -> DataFrame:
    """(path, reason): the reason of the path itself, else of its longest listed directory, else null.

    A path is joined by equality with each of its own directories, so no pairs are compared.
    """
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    each = paths.select("path", F.explode(ups).alias("prefix")).join(reasons.select(F.regexp_replace("prefix", "/$", "").alias("prefix"), "reason"), "prefix", "left")
    return each.groupBy("path").agg(F.max_by("reason", F.when(F.col("reason").isNotNull(), F.length("prefix"))).alias("reason"))
