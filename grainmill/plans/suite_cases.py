"""The evaluation suite over the driver's documents, with its SQL: all 22 categories, every record of the table in the pool."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collapse
from ..operators import builder, pairing
from ..storage import Workspace
from .tables import WS, norm, table

DOMAINS = ("roads", "sanitation", "water", "housing", "electricity", "payments", "heating", "construction", "transport")
LETTERS = tuple(builder.AREAS)


def _pool(spark: SparkSession, d: str) -> DataFrame:
    """Documents as a prepared pool: labels are plain functions of text and number, so that SQL can tell them, too."""
    n, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    of = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (n % k).cast("int") + 1)
    issue, action = collapse(text), F.when(n % 3 == 0, F.concat(F.lit("mend number "), n.cast("string"))).otherwise("")
    street = F.when(n % 4 == 0, F.concat(F.lit("вул. "), (n % 23).cast("string"))).otherwise("")
    ref = F.struct(of(DOMAINS, 9).alias("domain"), issue.alias("issue"), street.alias("object"), action.alias("requested_action"), F.create_map().cast("map<string,string>").alias("attributes"))
    return table(spark, d, "documents").select(
        n.cast("string").alias("uid"), F.when(n % 2 == 0, "validation").otherwise("test").alias("split"), F.col("source").alias("kind"), text.alias("content"), ref.alias("ref"),
        F.substring_index(issue, ". ", 1).alias("terse"), F.array_join(F.slice(F.split(issue, " "), 1, 8), " ").alias("minimal"), action.alias("action"), street.alias("street"),
        of(DOMAINS, 9).alias("mapped"), F.array_distinct(F.array(of(LETTERS, 11), of(LETTERS, 7))).alias("areas"), (n % 6 == 1).alias("boiler"), (issue != "").alias("usable"),
    )


def evaluation_suite(spark: SparkSession, d: str) -> DataFrame:
    """Finished cases: (id, category, kind, sources, splits, domains, topics, text_md5)."""
    made = builder.finish(builder.assemble(_pool(spark, d), Workspace(spark, "suite")))
    told = lambda c: F.array_join(c, ",").alias(c)
    return made.select("id", "category", "kind", told("sources"), told("splits"), F.array_join("expected_domains", ",").alias("domains"), F.col("expected_topic_count").cast("long").alias("topics"), F.md5("text").alias("text_md5"))


QUERIES = {"evaluation_suite": evaluation_suite}

#: More rounds than a table has ever needed; further ones take nothing.
ROUNDS = 8


def _beside(rows: str, key: str, name: str) -> str:
    size = f"greatest(m / {pairing.PARTS}.0, {float(pairing.LEAST)})"
    return f"""{name}c AS (SELECT {key} AS k, count(*) AS n FROM {rows} GROUP BY 1), {name}z AS (SELECT k, CAST(ceil(n / {size}) AS BIGINT) AS p FROM {name}c, (SELECT sum(n) AS m FROM {name}c) WHERE n > {size}),
{name}q AS (SELECT r.*, coalesce(('0x' || left(md5(uid), 8))::BIGINT % p, 0) AS piece FROM {rows} r LEFT JOIN {name}z ON {key} = k),
{name}l AS (SELECT *, row_number() OVER (PARTITION BY {key}, piece, domain ORDER BY o, uid) AS nth FROM {name}q),
{name}w AS (SELECT *, row_number() OVER v AS place, lead({name}l) OVER v AS b FROM {name}l WINDOW v AS (PARTITION BY {key}, piece ORDER BY nth, domain, o, uid)),
{name} AS (SELECT *, md5('42:' || uid || ':' || b.uid) AS po FROM {name}w WHERE place % 2 = 1 AND b IS NOT NULL AND domain <> b.domain)"""


def _sql() -> str:
    quotas = {letter: n for letter, _, _, n, _ in builder.CATEGORIES}
    lower = lambda x: f"lower(left({x}, 1)) || substr({x}, 2)"
    upper = "upper(left(b.terse, 1)) || substr(b.terse, 2)"
    two = "uid || ',' || b.uid AS sources, split AS splits, least(domain, b.domain) || ',' || greatest(domain, b.domain) AS domains, 2 AS topics"
    forms = {"B": f"terse || ', і ' || {lower('b.terse')} || '.'", "C": f"terse || ', а також ' || {lower('b.terse')} || '.'", "D": f"issue || ' ' || {lower('b.issue')} || '.'", "F": f"terse || '. ' || {upper} || '.'"}
    cases = [f"(SELECT '{c}' AS category, CAST(rank AS VARCHAR) AS o0, po AS o1, 'composed' AS kind, {two}, {text} AS text FROM (SELECT * FROM ne ORDER BY rank, po LIMIT {quotas[c]}))" for c, text in forms.items()]
    act = f"terse || '. Прошу ' || {lower('b.action')} || '.'"
    cases.append(f"(SELECT 'G', CAST(rank AS VARCHAR), po, 'composed', {two}, {act} FROM (SELECT * FROM ne WHERE length(b.action) >= 8 ORDER BY rank, po LIMIT {quotas['G']}))")
    near = f"SELECT * FROM (SELECT * FROM es QUALIFY row_number() OVER (PARTITION BY spot ORDER BY po, uid) = 1) ORDER BY rank, spot LIMIT {quotas['E']}"
    cases.append(f"(SELECT 'E', CAST(rank AS VARCHAR), spot, 'composed', {two}, 'По ' || street || ': ' || {forms['C']} FROM ({near}))")
    seen: dict[str, int] = {}
    slots = []
    for j, (da, db) in enumerate(builder.AMBIGUOUS):
        na, nb = seen.get(da, 0) + 1, seen.get(db, 0) + 1
        seen |= {da: na, db: nb}
        slots.append(f"({j}, '{da}', {na}, '{db}', {nb})")
    confused = f"""SELECT j, a.*, b FROM (VALUES {", ".join(slots)}) s(j, da, na, db, nb) JOIN rk a ON a.domain = da AND a.nr = na JOIN rk b ON b.domain = db AND b.nr = nb AND a.split = b.split
      QUALIFY row_number() OVER (PARTITION BY j ORDER BY a.rank) = 1 ORDER BY j LIMIT {quotas['K']}"""
    cases.append(f"(SELECT 'K', lpad(CAST(j AS VARCHAR), 4, '0'), '', 'composed', {two}, {forms['C']} FROM ({confused}))")
    rounds, taken = [], "SELECT uid, c FROM t0"
    rounds.append("t0 AS (SELECT uid, c, 0 AS nth FROM ft WHERE false)")
    for k in range(1, ROUNDS + 1):
        rounds.append(f"""u{k} AS (SELECT q.c, quota - coalesce(n, 0) AS room FROM qt q LEFT JOIN (SELECT c, count(*) AS n FROM ({taken}) GROUP BY c) USING (c) WHERE quota > coalesce(n, 0)),
x{k} AS (SELECT uid, c, o, room FROM ft JOIN u{k} USING (c) WHERE uid NOT IN (SELECT uid FROM ({taken}))), s{k} AS (SELECT c, count(*) AS n FROM x{k} GROUP BY c),
t{k} AS (SELECT uid, c, row_number() OVER (PARTITION BY c ORDER BY o, uid) AS nth FROM (SELECT uid, c, o, room FROM x{k} JOIN s{k} USING (c) QUALIFY row_number() OVER (PARTITION BY uid ORDER BY n, c) = 1) QUALIFY nth <= any_value(room) OVER (PARTITION BY c))""")
        taken += f" UNION ALL SELECT uid, c FROM t{k}"
    rows = f"SELECT p.*, c, row_number() OVER (PARTITION BY c ORDER BY o, uid) AS nr FROM own p JOIN ({taken}) USING (uid)"
    single = f"CASE WHEN c <> 'A' THEN trim(regexp_replace(body, '^{WS}+|{WS}+$', '', 'g')) WHEN nr <= {builder.TERSE} THEN terse ELSE minimal END"
    cases.append(f"(SELECT c, lpad(CAST(nr AS VARCHAR), 6, '0'), '', CASE WHEN c = 'A' THEN 'condensed' ELSE 'real' END, uid, split, domain, 1, {single} FROM ({rows}))")
    values = ", ".join(f"('{c}', {quotas[c]})" for c in builder.SINGLE)
    stripped = f"length(regexp_replace(body, '^{WS}+|{WS}+$', '', 'g'))"
    return f"""WITH base AS (SELECT CAST(doc_id AS VARCHAR) AS uid, doc_id AS n, coalesce(text, '') AS body, trim(regexp_replace(coalesce(text, ''), '{WS}+', ' ', 'g')) AS issue FROM documents),
own AS (SELECT uid, n, body, issue, CASE WHEN n % 2 = 0 THEN 'validation' ELSE 'test' END AS split, CASE WHEN n % 2 = 0 THEN 1 ELSE 2 END AS rank, {list(DOMAINS)}[n % 9 + 1] AS domain, string_split(issue, '. ')[1] AS terse,
  array_to_string(string_split(issue, ' ')[1:8], ' ') AS minimal, CASE WHEN n % 3 = 0 THEN 'mend number ' || n ELSE '' END AS action, CASE WHEN n % 4 = 0 THEN 'вул. ' || n % 23 ELSE '' END AS street, md5('42:' || uid) AS o FROM base WHERE issue <> ''),
st AS (SELECT *, split || '|' || street AS spot FROM own WHERE street <> ''),
{_beside("own", "split", "ne")},
{_beside("st", "spot", "es")},
rk AS (SELECT *, row_number() OVER (PARTITION BY split, domain ORDER BY o, uid) AS nr FROM own),
ft AS (SELECT uid, o, unnest(list_distinct(list_filter([CASE WHEN length(terse) < 150 THEN 'A' END, CASE WHEN action = '' THEN 'H' END, CASE WHEN {stripped} > 600 THEN 'I' END, CASE WHEN n % 6 = 1 THEN 'J' END, {list(LETTERS)}[n % 11 + 1], {list(LETTERS)}[n % 7 + 1]], lambda x: x IS NOT NULL))) AS c FROM own),
qt AS (SELECT * FROM (VALUES {values}) v(c, quota)),
{", ".join(rounds)},
al AS ({" UNION ALL ".join(cases)}), nu AS (SELECT *, 'ev3-' || lpad(CAST(row_number() OVER (ORDER BY category, o0, o1) AS VARCHAR), 3, '0') AS id FROM al)
SELECT id, category, kind, sources, splits, domains, CAST(topics AS BIGINT) AS topics, md5(text) AS text_md5 FROM nu WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY {norm("text")} ORDER BY id) = 1"""


ORACLE_SQL = {"evaluation_suite": _sql()}
