"""Queries of sources and sinks, weak labels of the reference language, payloads, vectors and files.

Files are written to a workspace from the driver's tables and read back by the sources; texts of the reference language
are made of its fixed phrases and the tables' keys, so their labels are known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, augment, curate, labels, reconcile, scoring, suites, vectors
from ..sources import io
from ..storage import Workspace
from .suites import _lines, _sql, cases
from .tables import table


def csv_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells with quotes, line ends and nothing, written as CSV and read back as strings."""
    ws = Workspace(spark, "csv")
    c = table(spark, d, "customer")
    cell = F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit('a "'), "c_mktsegment", F.lit('",\nand '), "c_name"))
    c.select(F.col("c_custkey").cast("string").alias("uid"), cell.alias("content")).write.option("header", True).option("escape", '"').csv(ws.path("cells"))
    return io.read_csv(spark, ws.path("cells"), ["uid", "content"]).select("uid", "content")


def jsonl_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows in order of a key through JSON lines, nulls kept."""
    ws = Workspace(spark, "jsonl")
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("priority"))
    io.write_jsonl(rows, ws.path("rows"), ["o_orderkey"])
    back = io.read_jsonl(spark, ws.path("rows"), rows.schema)
    return back.select("o_orderkey", "priority")


def split_files(spark: SparkSession, d: str) -> DataFrame:
    ws = Workspace(spark, "splits")
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("uid"), F.col("c_name").alias("content"))
    for k, name in enumerate(("train", "validation", "test")):
        io.write_jsonl(rows.where(F.col("uid") % 3 == k), ws.path(f"{name}.jsonl"))
    return io.read_splits(spark, ws.path("").rstrip("/"), rows.schema).select("split", F.col("split_index").cast("long").alias("split_index"), "uid")


def tolerant_scan(spark: SparkSession, d: str) -> DataFrame:
    """Lines that are no JSON are dropped."""
    ws = Workspace(spark, "tolerant")
    line = F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.when(F.col("event_id") % 7 == 0, "").otherwise("}"))
    table(spark, d, "events").select(line.alias("value")).write.text(ws.path("lines"))
    return io.read_jsonl(spark, ws.path("lines"), "id long", "DROPMALFORMED").select("id")


def batch_manifest(spark: SparkSession, d: str) -> DataFrame:
    ws = Workspace(spark, "batches")
    rows = table(spark, d, "customer").select(F.concat(F.lit("b"), F.col("c_nationkey").cast("string")).alias("batch_id"), F.col("c_custkey").alias("id"))
    return io.write_batches(rows, ws.path("batches")).select("batch_id", "records", F.element_at("ids", 1).alias("first"))


def vector_cache(spark: SparkSession, d: str) -> DataFrame:
    """Vectors saved with their records' fingerprint, loaded for these and refused for others."""
    ws = Workspace(spark, "vectors")
    e = table(spark, d, "embeddings")
    own = e.select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"))
    records = e.select(F.col("vec_id").cast("string").alias("uid"), F.col("label").cast("string").alias("kind"), F.lit("x").alias("content"))
    io.save_vectors(own, records, ws.path("v"), "model", "train")
    if io.load_vectors(spark, records.limit(1), ws.path("v"), "model", "train") is not None:
        raise ValueError("vectors of other records")
    both = io.join_vectors(records.select(F.col("uid").alias("id"), "kind"), io.load_vectors(spark, records, ws.path("v"), "model", "train"))
    return both.select("id", "kind", F.size("vector").cast("long").alias("dim"))


def file_exposure(spark: SparkSession, d: str) -> DataFrame:
    """Keys, rows and personal-looking strings of a JSON-lines file."""
    ws = Workspace(spark, "exposure")
    o = table(spark, d, "customer")
    text = F.concat(F.lit("call 067-123-45-67 of "), "c_name", F.when(F.col("c_custkey") % 2 == 0, " or write to some.one@example.org").otherwise(""))
    rows = o.select(F.col("c_custkey").cast("string").alias("uid"), F.lit("t").alias("receivedDateTime"), F.lit("t").alias("type"), F.lit("k").alias("kind"), F.when(F.col("c_custkey") % 3 == 0, "short").otherwise(text).alias("content"))
    rows.coalesce(1).write.json(ws.path("files"))
    told = audit.scan_jsonl(spark, ws.path("files"), "*.json")
    return told.select("rows", F.array_join("verbatim_source_keys", ",").alias("keys"), "verbatim_source_schema", "carries_free_text", "phone_like_rows", "phone_like_hits", "email_like_rows", "email_like_hits")


def file_contents(spark: SparkSession, d: str) -> DataFrame:
    ws = Workspace(spark, "files")
    table(spark, d, "nation").select(F.col("n_regionkey"), F.col("n_name").alias("value")).repartition(1).sortWithinPartitions("n_regionkey", "value").write.partitionBy("n_regionkey").text(ws.path("texts"))
    told = audit.file_hashes(spark, ws.path("texts"), "part-*")
    return told.select(F.regexp_extract("path", r"n_regionkey=(\d+)", 1).cast("long").alias("region"), "bytes", "sha256")


def quoted_hashes(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", F.sha2("n_name", 256).alias("sha256"))
    docs = n.select(F.concat(F.lit("d"), F.col("n_nationkey").cast("string")).alias("doc"), F.concat(F.lit("file `"), "sha256", F.lit("` is there")).alias("text"))
    return audit.quoted_hashes(docs, n.where("n_nationkey % 2 = 0"))


def chat_round_trip(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d)
    chats = c.select(augment.chat(F.col("id").cast("string"), "system", F.concat(F.lit("  "), "text"), F.col("expected")).alias("c")).select("c.*")
    back = suites.targets_of_chats(chats)
    return back.select("uid", "text", F.size("expected").cast("long").alias("n"), F.array_join(F.transform("expected", lambda t: F.concat_ws("/", t["domain"], t["issue"], t["object"], t["requested_action"])), "|").alias("topics"))


def topic_review(spark: SparkSession, d: str) -> DataFrame:
    """Counts over proposals: empty fields, several topics, personal-looking ones."""
    c = cases(spark, d).select("id", F.when(F.col("id") % 10 == 0, F.slice("expected", 1, 0)).otherwise(F.col("expected")).alias("topics"))
    told = augment.review(c)
    return told.select(*[F.col(x).cast("long").alias(x) for x in told.columns])


def topic_profile(spark: SparkSession, d: str) -> DataFrame:
    told = augment.profile(cases(spark, d).select("id", F.col("expected").alias("topics")), "id")
    return told.select(F.col("n_topics").cast("long").alias("n_topics"), "same_domain", "n")


def verbatim_issues(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d).select("text", F.when(F.col("id") % 4 == 0, F.transform("expected", lambda t: t.withField("issue", F.lit("not there")))).otherwise(F.col("expected")).alias("topics"))
    return augment.verbatim_rate(c).select("n", F.round("rate", 6).alias("rate"))


def kind_domains(spark: SparkSession, d: str) -> DataFrame:
    """Topics by kind and domain, a column a domain."""
    c = cases(spark, d).select("category", F.col("expected").alias("topics"))
    return augment.domain_crosstab(c, "category", ["roads", "water"])


def independent_lines(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring lines of orders that can stand side by side, by whether their kinds clash."""
    lines = _lines(spark, d).select("id", "k", "issue", F.col("ask").alias("requested_action"), "pk")
    a, b = lines.select("id", "k", F.struct("issue", "requested_action").alias("a"), (F.col("pk") % 4).cast("string").alias("ka")), lines.select("id", (F.col("k") - 1).alias("k"), F.struct("issue", "requested_action").alias("b"), (F.col("pk") % 4).cast("string").alias("kb"))
    both = a.join(b, ["id", "k"])
    return both.groupBy(augment.independent(F.col("a"), F.col("b"), 20).alias("independent"), augment.clash(F.col("ka"), F.col("kb"), [("0", "1"), ("2", "3")]).alias("clash")).agg(F.count("*").alias("n"))


def grounded_names(spark: SparkSession, d: str) -> DataFrame:
    """Whether parts' names are grounded in their description, as they are or by their stems."""
    p = table(spark, d, "part")
    source = F.concat(F.lit("the "), F.regexp_replace("p_name", "et$", "eted"), F.lit(" of "), "p_brand")
    value = F.concat("p_name", F.when(F.col("p_size") % 2 == 0, " missing words here").otherwise(""))
    return p.select("p_partkey", scoring.grounded(source, value).alias("grounded"))


def wrapped_outputs(spark: SparkSession, d: str) -> DataFrame:
    """What stands around the JSON of an output, and whether the braces in it hold an object with topics."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey") % 6
    raw = F.concat(F.when(k == 0, "```json ").when(k == 1, "Here: ").when(k == 2, "<think>no</think>").when(k == 3, "!").otherwise(""), F.lit('{"topics":['), F.when(k == 5, '{"domain":"water"}').otherwise(""), F.lit("]}"), F.when(k == 0, "```").otherwise(""))
    return o.select("o_orderkey", F.array_join(reconcile.wrapper_errors(raw), ",").alias("around"), F.size(reconcile.topics_of(raw, permissive=True)).cast("long").alias("n_topics"))


def merged_records(spark: SparkSession, d: str) -> DataFrame:
    """Nations with their region's row, in order; and the record of a key or of its suffixed one."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("key"), "n_name")
    extra = n.select("key", F.concat(F.lit("x-"), "n_name").alias("note"))
    one = reconcile.merge_in_order(n, extra, "key", "n_name")
    known = n.select(F.when(F.length("key") == 1, F.col("key")).otherwise(F.concat("key", F.lit("-"))).alias("key"), F.upper("n_name").alias("u"), F.length("n_name").alias("at"))
    return reconcile.lookup(one, known, "key", "at").select("key", "note", F.col("found.u").alias("u"))


def softmax_shares(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.array(F.col("p_size") / 10.0, F.col("p_retailprice") / 1000.0, F.lit(0.5)).alias("s"))
    told = p.select("p_partkey", vectors.softmax(F.col("s")).alias("p"))
    return told.select("p_partkey", F.round(F.get("p", F.lit(0)), 9).alias("a"), F.round(F.get("p", F.lit(2)), 9).alias("c"))


def mean_log_loss(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select((F.col("p_size") % 2).cast("int").alias("label"), F.array(F.col("p_size") / 60.0, 1 - F.col("p_size") / 60.0).alias("probabilities"))
    return vectors.log_loss(p, "label").select(F.round("log_loss", 6).alias("log_loss"))


def class_weights(spark: SparkSession, d: str) -> DataFrame:
    told = vectors.balanced_weights(table(spark, d, "embeddings").select("vec_id", "label"), "label")
    return told.select("vec_id", F.round("weight", 9).alias("weight"))


#: A complaint of the reference language; {k} is a key.
COMPLAINT = "Скарга на те, що у будинку по вул. Садова, буд. 7 не працює ліфт номер {k}. Прошу відремонтувати ліфт номер {k}. Заявник надає згоду на обробку персональних даних. Відповідь надати телефоном 067-123-45-67."


def _complaints(spark: SparkSession, d: str) -> DataFrame:
    head, middle, tail = COMPLAINT.split("{k}")
    key = F.col("c_custkey").cast("string")
    return table(spark, d, "customer").select("c_custkey", F.concat(F.lit(head), key, F.lit(middle), key, F.lit(tail)).alias("content"))


def complaint_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of complaints about a lift: the street, the building, the request, and the domain of its kind."""
    kind = F.lit("Експлуатація та ремонт житла ( у т.ч. ліфтів, сантехнічного обладнання тощо)")
    t = labels.label(F.col("content"), kind)
    told = _complaints(spark, d).select("c_custkey", t.alias("t"), labels.domain(F.lit("інше")).alias("other"))
    return told.select("c_custkey", "t.domain", "other", F.col("t.object").alias("street"), F.col("t.attributes")["building"].alias("building"), F.col("t.requested_action").alias("action"))


def complaint_clauses(spark: SparkSession, d: str) -> DataFrame:
    """Boilerplate, wrappers and phone numbers off; the request as a clause; trailing boilerplate off."""
    c = F.col("content")
    told = _complaints(spark, d).select("c_custkey", labels.strip_boilerplate(c).alias("stripped"), labels.clean_clause(c).alias("clean"), labels.action_clause(c).alias("clause"), labels.drop_tail(c).alias("headed"), labels.has_request(c).alias("asks"))
    return told


def cleaned_topics(spark: SparkSession, d: str) -> DataFrame:
    """Topics whose issue ends in its narrator or holds its own request."""
    key = F.col("c_custkey").cast("string")
    issue = F.concat(F.lit("Стоїть ліфт "), key, F.when(F.col("c_custkey") % 2 == 0, " заявник.").otherwise(F.concat(F.lit(". Прошу полагодити ліфт "), key)))
    t = F.struct(F.lit("housing").alias("domain"), issue.alias("issue"), F.lit("").alias("object"), F.lit("").alias("requested_action"), F.create_map().cast("map<string,string>").alias("attributes"))
    told = table(spark, d, "customer").select("c_custkey", labels.clean_topic(t).alias("t"))
    return told.select("c_custkey", "t.issue", F.col("t.requested_action").alias("action"))


def rendered_appeals(spark: SparkSession, d: str) -> DataFrame:
    t = F.array(F.struct(F.lit("water").alias("domain"), F.col("n_name").alias("issue"), F.lit("").alias("object"), F.lit("").alias("requested_action"), F.create_map().cast("map<string,string>").alias("attributes")))
    return table(spark, d, "nation").select("n_nationkey", labels.render(t, F.concat(F.lit("місце "), "n_name")).alias("text"))


def leak_free_splits(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a split without leaks, after the check that would fail the run otherwise."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_name").alias("content"), F.when(F.col("c_custkey") % 4 == 0, "test").otherwise("train").alias("split"))
    curate.assert_no_leakage(c)
    return c.groupBy("split").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        csv_cells, jsonl_rows, split_files, tolerant_scan, batch_manifest, vector_cache, file_exposure, file_contents, quoted_hashes, chat_round_trip, topic_review, topic_profile, verbatim_issues,
        kind_domains, independent_lines, grounded_names, wrapped_outputs, merged_records, softmax_shares, mean_log_loss, class_weights, complaint_labels, complaint_clauses, cleaned_topics,
        rendered_appeals, leak_free_splits,
    )
}

_CASES = f"WITH {_sql('0')}"
_K = "CAST(c_custkey AS VARCHAR)"

ORACLE_SQL = {
    "csv_cells": f"""SELECT {_K} AS uid, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'a "' || c_mktsegment || '",' || chr(10) || 'and ' || c_name END AS content FROM customer""",
    "jsonl_rows": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS priority FROM orders",
    "split_files": "SELECT CASE c_custkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split, c_custkey % 3 AS split_index, c_custkey AS uid FROM customer",
    "tolerant_scan": "SELECT event_id AS id FROM events WHERE event_id % 7 <> 0",
    "batch_manifest": "SELECT 'b' || c_nationkey AS batch_id, count(*) AS records, min(c_custkey) AS first FROM customer GROUP BY c_nationkey",
    "vector_cache": "SELECT CAST(vec_id AS VARCHAR) AS id, CAST(label AS VARCHAR) AS kind, len(embedding)::BIGINT AS dim FROM embeddings",
    "file_exposure": """SELECT count(*) AS rows, 'content,kind,receivedDateTime,type,uid' AS keys, true AS verbatim_source_schema, true AS carries_free_text, count(*) FILTER (WHERE c_custkey % 3 <> 0) AS phone_like_rows,
      count(*) FILTER (WHERE c_custkey % 3 <> 0) AS phone_like_hits, count(*) FILTER (WHERE c_custkey % 3 <> 0 AND c_custkey % 2 = 0) AS email_like_rows, count(*) FILTER (WHERE c_custkey % 3 <> 0 AND c_custkey % 2 = 0) AS email_like_hits FROM customer""",
    "file_contents": "SELECT n_regionkey::BIGINT AS region, sum(strlen(n_name) + 1)::BIGINT AS bytes, sha256(string_agg(n_name || chr(10), '' ORDER BY encode(n_name))) AS sha256 FROM nation GROUP BY n_regionkey",
    "quoted_hashes": "SELECT 'd' || n_nationkey AS doc, sha256(n_name) AS sha256, n_nationkey % 2 = 0 AS known FROM nation",
    "chat_round_trip": f"{_CASES} SELECT CAST(id AS VARCHAR) AS uid, text, len(exp)::BIGINT AS n, array_to_string(list_transform(exp, lambda t: t.d || '/' || t.i || '/' || t.o || '/' || t.a), '|') AS topics FROM cs",
    "topic_review": f"""{_CASES}, x AS (SELECT CASE WHEN id % 10 = 0 THEN [] ELSE exp END AS t FROM cs) SELECT count(*) AS total, count(*) FILTER (WHERE len(t) > 0) AS with_topics, count(*) FILTER (WHERE len(t) = 0) AS zero_topics, count(*) FILTER (WHERE len(t) > 1) AS multi_topic,
      sum(len(t))::BIGINT AS topics_total, 0::BIGINT AS empty_issue, sum(len(list_filter(t, lambda x: x.o = '')))::BIGINT AS empty_object, sum(len(list_filter(t, lambda x: x.a = '')))::BIGINT AS empty_requested_action, 0::BIGINT AS large_attributes, 0::BIGINT AS private_like FROM x""",
    "topic_profile": f"{_CASES} SELECT len(exp)::BIGINT AS n_topics, len(list_distinct(list_transform(exp, lambda t: t.d))) < len(exp) AS same_domain, count(*) AS n FROM cs GROUP BY ALL",
    "verbatim_issues": f"{_CASES} SELECT count(*) AS n, round(avg((id % 4 <> 0)::INT), 6) AS rate FROM cs WHERE len(exp) = 1",
    "kind_domains": f"{_CASES}, x AS (SELECT category, unnest(exp).d AS d FROM cs) SELECT category, count(*) FILTER (WHERE d = 'roads') AS roads, count(*) FILTER (WHERE d = 'water') AS water FROM x GROUP BY category",
    "independent_lines": f"""{_CASES}, b AS (SELECT x.issue AS i, y.issue AS j, x.ask AS p, y.ask AS q, x.pk % 4 AS u, y.pk % 4 AS v FROM ln x JOIN ln y ON x.id = y.id AND y.k = x.k + 1)
      SELECT i <> j AND length(i) >= 20 AND length(j) >= 20 AND NOT (p <> '' AND p = q) AS independent, (u IN (0, 1) AND v IN (0, 1)) OR (u IN (2, 3) AND v IN (2, 3)) AS clash, count(*) AS n FROM b GROUP BY ALL""",
    "grounded_names": r"""WITH x AS (SELECT p_partkey, list_distinct(regexp_extract_all(lower('the ' || regexp_replace(p_name, 'et$', 'eted') || ' of ' || p_brand), '[\p{L}\p{N}_]+')) AS s,
        list_distinct(regexp_extract_all(lower(p_name || CASE WHEN p_size % 2 = 0 THEN ' missing words here' ELSE '' END), '[\p{L}\p{N}_]+')) AS v FROM part)
      SELECT p_partkey, len(list_filter(v, lambda t: list_contains(s, t) OR len(list_filter(s, lambda u: length(u) >= 5 AND length(t) >= 5 AND u[1:5] = t[1:5])) > 0)) / len(v)::DOUBLE >= 0.6 AS grounded FROM x""",
    "wrapped_outputs": """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'markdown fence' WHEN 1 THEN 'prose before JSON' WHEN 2 THEN 'thinking text' WHEN 3 THEN 'wrapper before JSON' ELSE '' END AS around, (o_orderkey % 6 = 5)::BIGINT AS n_topics FROM orders""",
    "merged_records": "SELECT CAST(n_nationkey AS VARCHAR) AS key, 'x-' || n_name AS note, upper(n_name) AS u FROM nation",
    "softmax_shares": "WITH x AS (SELECT p_partkey, exp(p_size / 10.0) AS a, exp(p_retailprice / 1000.0) AS b, exp(0.5) AS c FROM part) SELECT p_partkey, round(a / (a + b + c), 9) AS a, round(c / (a + b + c), 9) AS c FROM x",
    "mean_log_loss": "SELECT round(avg(-ln(greatest(CASE WHEN p_size % 2 = 0 THEN p_size / 60.0 ELSE 1 - p_size / 60.0 END, 1e-15))), 6) AS log_loss FROM part",
    "class_weights": "SELECT vec_id, round(count(*) OVER () / ((SELECT count(DISTINCT label) FROM embeddings) * count(*) OVER (PARTITION BY label))::DOUBLE, 9) AS weight FROM embeddings",
    "complaint_labels": f"SELECT c_custkey, 'housing' AS domain, 'other' AS other, 'вул. Садова' AS street, '7' AS building, ' відремонтувати ліфт номер ' || {_K} || '.' AS action FROM customer",
    "complaint_clauses": f"""SELECT c_custkey, 'Скарга на те, що у будинку по вул. Садова, буд. 7 не працює ліфт номер ' || {_K} || '. Прошу відремонтувати ліфт номер ' || {_K} AS stripped,
      'те, що у будинку по вул. Садова, буд. 7 не працює ліфт номер ' || {_K} || '.  відремонтувати ліфт номер ' || {_K} AS clean, 'відремонтувати ліфт номер ' || {_K} AS clause,
      'Скарга на те, що у будинку по вул. Садова, буд. 7 не працює ліфт номер ' || {_K} || '. Прошу відремонтувати ліфт номер ' || {_K} || '.' AS headed, true AS asks FROM customer""",
    "cleaned_topics": f"SELECT c_custkey, 'Стоїть ліфт ' || {_K} || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '.' END AS issue, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'полагодити ліфт ' || {_K} END AS action FROM customer",
    "rendered_appeals": """SELECT n_nationkey, 'Звернення громадянина до органу місцевого самоврядування' || chr(10) || chr(10) || '1. Проблема: ' || n_name || chr(10) || '   Сфера: water' || chr(10) || chr(10) || 'Місце порушення: місце ' || n_name || chr(10) || chr(10)
      || 'Звернення підготовлене за допомогою асистента. Кожне твердження перевірено користувачем перед надсиланням.' AS text FROM nation""",
    "leak_free_splits": "SELECT CASE WHEN c_custkey % 4 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM customer GROUP BY 1",
}
