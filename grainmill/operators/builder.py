"""The adversarial evaluation suite: cases of 22 categories made of held-out records, and what is done with lists of cases.

Records are a table (uid, kind, content, split), one a normalised text. Labels, condensed notes and flags are computed once
for all of them. Everything is then chosen by relations over the whole pool: pairs are neighbours of one split in a seeded
order (``pairing``), confusable domains meet by rank, and real records are dealt to categories by rounds, each record to the
scarcest category that still has room for it. The choice is defined by hashes of the uids, so it does not depend on
partitions; it keeps the suite's quotas and conditions and is not another engine's choice of records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as p
from ..functions.text import collapse, lower_first, normalize, strip
from . import labels, pairing

#: The categories' letter, name, topics, cases, and the area that a category stands for.
CATEGORIES = (
    ("A", "terse_single", 1, 10, None),
    ("B", "terse_two_topic_i", 2, 8, None),
    ("C", "terse_two_topic_also", 2, 8, None),
    ("D", "two_sentences", 2, 8, None),
    ("E", "same_object_two_problems", 2, 6, None),
    ("F", "different_objects_two_problems", 2, 8, None),
    ("G", "explicit_and_implicit_action", 2, 6, None),
    ("H", "no_explicit_action", 1, 12, None),
    ("I", "long_rambling", 1, 8, None),
    ("J", "irrelevant_prose", 1, 6, None),
    ("K", "ontology_ambiguity", 2, 8, None),
    ("L", "lighting", 1, 6, r"освітлен|ліхтар"),
    ("M", "traffic_lights", 1, 4, r"світлофор"),
    ("N", "playgrounds", 1, 5, r"майданчик|дитяч\w* майдан|качелі|горка|песочниц"),
    ("O", "trees", 1, 6, r"дерев|кущ|гілк|амброз|бур.?ян|покос"),
    ("P", "stray_animals", 1, 3, r"безпритульн|тварин"),
    ("Q", "waste", 1, 6, r"смітт|сміття|відход|контейнер"),
    ("R", "water_sewerage", 1, 6, r"водопостач|каналізац|порив|протік"),
    ("S", "roads_sidewalks", 1, 7, r"дорог|асфальт|ямк|тротуар|пішохід|люк"),
    ("T", "public_transport", 1, 5, r"маршрутк|автобус|тролейбус|трамва|зупинк"),
    ("U", "housing_heating", 1, 6, r"тепл|опален|дах|стел|стіна|будинок|квартир"),
    ("V", "elevators", 1, 4, r"ліфт"),
)
#: Domains that are easily confused.
AMBIGUOUS = (("roads", "sanitation"), ("water", "housing"), ("electricity", "sanitation"), ("water", "sanitation"), ("housing", "payments"), ("heating", "payments"), ("roads", "construction"), ("transport", "roads"))
TOPIC_COUNT = {letter: topics for letter, _, topics, _, _ in CATEGORIES}
NAMES = {letter: name for letter, name, *_ in CATEGORIES}
AREAS = {letter: area for letter, *_, area in CATEGORIES if area}
#: Cases of A that are terse notes (the others are minimal), and of the categories that one real record fills.
TERSE = 6
SINGLE = ("A", "H", "I", "J", *AREAS)
SPLITS = ("validation", "test")
CASE = (
    "id string, category string, category_name string, kind string, sources array<string>, splits array<string>, note string, text string, "
    "expected_topics array<struct<domain:string,issue:string,object:string,requested_action:string,attributes:map<string,string>>>, expected_topic_count int, expected_domains array<string>"
)


def area_hits(text: Column, pattern: str) -> Column:
    return F.coalesce(text, F.lit("")).rlike(p.I + pattern.replace(r"\w", p.W))


def prepare(records: DataFrame, ws, mapping=None, areas=None, boilerplate: str | None = None) -> DataFrame:
    """The pool: uid, split, kind, content, ref (the reference topic), terse and minimal notes, action, street, mapped (the
    kind's domain, if it has one), and flags (usable, areas, boiler). Written, since labels are dear."""
    mapping, areas = p.KIND_TO_DOMAIN if mapping is None else mapping, AREAS if areas is None else areas
    content = F.coalesce("content", F.lit(""))
    own = records.select(F.col("uid").cast("string").alias("uid"), "split", "kind", content.alias("content")).where(strip(content) != "")
    ref = labels.reference_topic(F.col("content"), F.col("kind")).withField("domain", labels.domain(F.col("kind"), mapping))
    told = own.select(
        "*", ref.alias("ref"), labels.condense(F.col("content")).alias("terse"), labels.condense(F.col("content"), 110).alias("minimal"), labels.street(F.col("content")).alias("street"),
        F.coalesce(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[F.col("kind")], F.lit(None).cast("string")).alias("mapped"),
        F.array_compact(F.array(*[F.when(area_hits(F.col("content"), v), F.lit(k)) for k, v in areas.items()])).alias("areas"),
        F.exists(labels.sentences(F.col("content")), lambda s: s.rlike(p.BOILERPLATE_ANY if boilerplate is None else boilerplate)).alias("boiler"),
    )
    told = told.withColumn("usable", strip(F.col("ref.issue")) != "").withColumn("action", F.col("ref.requested_action"))
    return ws.table("suite-pool", told)


def _hash(seed: int, *keys: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *keys))


def _case(category, text: Column, rows: list[Column], kind: str, note: Column, order: list[Column], topics: list[Column] | None = None) -> Column:
    """A case as a struct, but for its id; ``order`` is its place among those of its category."""
    category = F.lit(category) if isinstance(category, str) else category
    topics = [r["ref"] for r in rows] if topics is None else topics
    names = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    return F.struct(
        category.alias("category"), names[category].alias("category_name"), F.lit(kind).alias("kind"), F.array(*[r["uid"] for r in rows]).alias("sources"),
        F.array_sort(F.array_distinct(F.array(*[r["split"] for r in rows]))).alias("splits"), note.alias("note"), text.alias("text"), F.array(*topics).alias("expected_topics"),
        F.lit(len(rows)).alias("expected_topic_count"), F.array_sort(F.array_distinct(F.array(*[t["domain"] for t in topics]))).alias("expected_domains"), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("place"),
    )


def _top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def dealt_singles(rows: DataFrame, quotas: dict[str, int], ws, seed: int = 42) -> DataFrame:
    """(uid, category): real records for categories up to their quotas, no record twice. ``rows``: uid, eligible (letters).

    By rounds: every free record asks the scarcest category that it fits and that has room (fewest free records that fit, then
    the letter); a category takes those that ask, in a seeded order, until it is full. What the driver gets is a number a
    category; rounds end when none is taken, after as many as there are categories at most."""
    out, room, step = None, dict(quotas), 0
    while room:
        letters = F.array(*map(F.lit, sorted(room)))
        free = rows if out is None else rows.join(out, "uid", "left_anti")
        free = free.select("uid", F.array_intersect("eligible", letters).alias("fits")).where(F.size("fits") > 0)
        support = {r["c"]: r["n"] for r in free.select(F.explode("fits").alias("c")).groupBy("c").agg(F.count("*").alias("n")).collect()}
        if not support:
            break
        scarce = sorted(support, key=lambda c: (support[c], c))
        asks = free.select("uid", F.filter(F.array(*map(F.lit, scarce)), lambda c: F.array_contains("fits", c))[0].alias("category"))
        nth = F.row_number().over(Window.partitionBy("category").orderBy(_hash(seed, F.col("uid")), "uid"))
        most = F.create_map(*[x for c in scarce for x in (F.lit(c), F.lit(room[c]))])
        taken = asks.withColumn("nth", nth).where(F.col("nth") <= max(room.values())).where(F.col("nth") <= most[F.col("category")])
        told = ws.table(f"singles-{step}", taken.select("uid", "category"))
        out, step = told if out is None else out.unionByName(told), step + 1
        got = {r["category"]: r["n"] for r in told.groupBy("category").agg(F.count("*").alias("n")).collect()}
        room = {c: n - got.get(c, 0) for c, n in room.items() if n > got.get(c, 0)}
    return rows.sparkSession.createDataFrame([], "uid string, category string") if out is None else out


def _thin(pool: DataFrame, ws) -> DataFrame:
    """What cases are chosen by, without a text: one row a uid that is usable, of several the one with the least content.
    ``row`` tells it from others of its uid. Written before it is filtered, so that a text is looked at once."""
    fits = {"A": F.length("terse") < 150, "H": strip(F.col("action")) == "", "I": F.length(strip(F.col("content"))) > 600, "J": F.col("boiler")}
    eligible = F.concat(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in fits.items()])), F.array_intersect("areas", F.array(*map(F.lit, AREAS))))
    shape = ["uid", "split", "mapped", "street", F.col("ref.domain").alias("domain"), (F.length(collapse(F.col("action"))) >= 8).alias("asks"), eligible.alias("eligible"), "usable"]
    own = ws.table("thin", pool.select(*shape, _row().alias("row"))).where("usable")
    again = ws.table("again", own.groupBy(F.col("uid").alias("__gm_u")).agg(F.count("*").alias("__gm_n")).where("__gm_n > 1").select("__gm_u"))
    same = F.col("uid").eqNullSafe(F.col("__gm_u"))
    least = F.min(F.struct("content", "split", "kind", _row().alias("row"))).alias("__gm_l")
    least = ws.table("least", pool.where("usable").join(again, same, "left_semi").groupBy("uid").agg(least).select(F.col("uid").alias("__gm_u"), F.col("__gm_l.row").alias("__gm_r")))
    several = own.join(least, same & (F.col("row") == F.col("__gm_r")), "left_semi").dropDuplicates(["uid"])
    return ws.table("own", own.join(again, same, "left_anti").unionByName(several))


def _row() -> Column:
    return F.md5(F.concat_ws(":", *[F.coalesce(F.md5(c), F.lit("")) for c in ("content", "split", "kind")]))


def _whole(pool: DataFrame, ws, *chosen: DataFrame):
    """Gives a function that puts the whole records of ``pool`` in place of the thin ones of named columns. ``chosen``: frames
    of the thin ones (uid, row), twice the quotas' sum at most. The driver lists their uids, so that the condition reaches the
    scan and no text is made of other records."""
    asked = None
    for c in chosen:
        one = c.select("uid", "row")
        asked = one if asked is None else asked.unionByName(one)
    uids = [r["uid"] for r in asked.select("uid").distinct().collect()]
    rec = F.struct("uid", "split", "content", "ref", "terse", "minimal", "action", "street").alias("__gm_rec")
    texts = pool.where(F.col("uid").isin(uids)).select("uid", _row().alias("row"), rec)
    texts = ws.table("texts", texts.dropDuplicates(["uid", "row"]))

    def put(df: DataFrame, *sides: str) -> DataFrame:
        for x in sides:
            own = texts.select(F.col("uid").alias("__gm_u"), F.col("row").alias("__gm_r"), "__gm_rec")
            df = df.join(own, (F.col(f"{x}.uid") == F.col("__gm_u")) & (F.col(f"{x}.row") == F.col("__gm_r"))).withColumn(x, F.col("__gm_rec")).drop("__gm_u", "__gm_r", "__gm_rec")
        return df

    return put


def assemble(pool: DataFrame, ws, quotas: dict[str, int] | None = None, ambiguous=AMBIGUOUS, seed: int = 42) -> DataFrame:
    """The cases (``CASE``) before ``finish``, of a pool as ``prepare`` gives it: terse notes, two problems joined in several
    ways, one street with two problems, explicit and implicit requests, none at all, long and irrelevant prose, domains that
    are easily confused, and an area each. Pairs are of one split and two domains; validation comes first. Records are chosen
    by their thin rows; as many as the quotas ask for then get their texts."""
    quotas = {letter: n for letter, _, _, n, _ in CATEGORIES} | (quotas or {})
    own = _thin(pool, ws)
    lean = ["uid", "split", "mapped", "street", "asks", "row"]
    rank = F.array_position(F.array(*map(F.lit, SPLITS)), F.col("split"))
    a, b = F.col("a"), F.col("b")
    clause = lambda x: F.concat(x["terse"], F.lit(", а також "), lower_first(b["terse"]), F.lit("."))

    # two problems: neighbours of one split; the same pairs in each form
    mapped = own.where("mapped is not null").select(*lean)
    beside = pairing.neighbours(mapped, "split", "uid", "mapped", seed=seed).where("b is not null and a.mapped <> b.mapped")
    beside = ws.table("beside", beside.select("split", "a", "b", _hash(seed, a["uid"], b["uid"]).alias("o")))
    first = ws.table("first", _top(beside, max(quotas[c] for c in "BCDF"), rank, F.col("o")))
    asked = ws.table("with-request", _top(beside.where("b.asks"), quotas["G"], rank, F.col("o")))

    # one street, two problems
    near = mapped.where("street <> ''").withColumn("spot", F.concat_ws("|", "split", "street"))
    near = pairing.pairs(near, "spot", "uid", "mapped", per_key=1, seed=seed).where("reason = 'kept'")
    near = ws.table("near", _top(near.withColumn("split", a["split"]), quotas["E"], rank, F.col("spot")))

    # domains that are easily confused: the n-th mention of a domain takes its n-th record
    seen: dict[str, int] = {}
    slots = []
    for j, (da, db) in enumerate(ambiguous):
        na, nb = seen.get(da, 0) + 1, seen.get(db, 0) + 1
        seen |= {da: na, db: nb}
        slots += [(j, split, da, na, db, nb) for split in SPLITS]
    confused = None
    if slots:
        w = Window.partitionBy("split", "domain").orderBy(_hash(seed, F.col("uid")), "uid")
        ranked = own.where(F.col("domain").isin(*seen)).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= max(seen.values()))
        ranked = ws.table("ranked", ranked.select("split", "domain", "nth", F.struct("uid", "row").alias("r")))
        named = pool.sparkSession.createDataFrame(slots, "j int, split string, da string, na int, db string, nb int")
        both = named.join(ranked.toDF("split", "da", "na", "a"), ["split", "da", "na"]).join(ranked.toDF("split", "db", "nb", "b"), ["split", "db", "nb"])
        both = both.withColumn("nth", F.row_number().over(Window.partitionBy("j").orderBy(rank))).where("nth = 1")
        confused = ws.table("confused", both.orderBy("j").limit(quotas["K"]))

    # one real record each
    taken = dealt_singles(own.select("uid", "eligible").where(F.size("eligible") > 0), {c: quotas[c] for c in SINGLE if quotas[c]}, ws, seed)
    rows = own.join(F.broadcast(taken), "uid").withColumn("o", _hash(seed, F.col("uid")))  # as many as the quotas
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("category").orderBy("o", "uid")))
    rows = ws.table("singles", rows.select("category", "nth", F.struct("uid", "row").alias("a")))

    pairs = [df for df in (first, asked, near, confused) if df is not None]
    put = _whole(pool, ws, *[df.select(f"{x}.*") for df in pairs for x in ("a", "b")], rows.select("a.*"))
    first = put(first, "a", "b")
    upper = F.concat(F.upper(F.left(b["terse"], F.lit(1))), F.substr(b["terse"], F.lit(2)))
    forms = {
        "B": (F.concat(a["terse"], F.lit(", і "), lower_first(b["terse"]), F.lit(".")), "two condensed records joined"),
        "C": (clause(a), "two condensed records joined"),
        "D": (F.concat(a["ref"]["issue"], F.lit(" "), lower_first(b["ref"]["issue"]), F.lit(".")), "two records as two sentences"),
        "F": (F.concat(a["terse"], F.lit(". "), upper, F.lit(".")), "two records in sequence"),
    }
    place = [rank.cast("string"), F.col("o")]
    told = [_top(first, quotas[c], rank, F.col("o")).select(_case(c, text, [a, b], "composed", F.lit(note), place).alias("c")) for c, (text, note) in forms.items()]
    act = collapse(b["action"])
    topics = [a["ref"], b["ref"].withField("requested_action", act).withField("issue", F.left(b["terse"], F.lit(400)))]
    told.append(put(asked, "a", "b").select(_case("G", F.concat(a["terse"], F.lit(". Прошу "), lower_first(act), F.lit(".")), [a, b], "composed", F.lit("a problem without a request, and one with it"), place, topics).alias("c")))

    text = F.concat(F.lit("По "), a["street"], F.lit(": "), clause(a))
    told.append(put(near, "a", "b").select(_case("E", text, [a, b], "composed", F.concat(F.lit("two records about one street ("), a["street"], F.lit(")")), [rank.cast("string"), F.col("spot")]).alias("c")))
    if confused is not None:
        note = F.concat(F.lit("domains that are easily confused ("), F.col("da"), F.lit(", "), F.col("db"), F.lit(")"))
        told.append(put(confused, "a", "b").select(_case("K", clause(a), [a, b], "composed", note, [F.lpad(F.col("j").cast("string"), 4, "0"), F.lit("")]).alias("c")))
    rows = put(rows, "a")
    notes = {"A": "reduced to a note by deletions", "H": "no request", "I": "long, with back-story and repetition", "J": "consent and delivery of the answer around the problem"}
    notes |= {c: f"about {NAMES[c]}" for c in AREAS}
    note = F.create_map(*[F.lit(x) for kv in notes.items() for x in kv])[F.col("category")]
    text = F.when(F.col("category") != "A", strip(a["content"])).when(F.col("nth") <= TERSE, a["terse"]).otherwise(a["minimal"])
    order = [F.lpad(F.col("nth").cast("string"), 6, "0"), F.lit("")]
    for where, kind in (("category = 'A'", "condensed"), ("category <> 'A'", "real")):
        told.append(rows.where(where).select(_case(F.col("category"), text, [a], kind, note, order).alias("c")))

    out = told[0]
    for more in told[1:]:
        out = out.unionByName(more)
    number = F.row_number().over(Window.orderBy("c.category", "c.place"))  # as many rows as the quotas
    numbered = out.withColumn("id", F.concat(F.lit("ev3-"), F.lpad(number.cast("string"), 3, "0")))
    return ws.table("cases", numbered.select("id", *[F.col(f"c.{name.split()[0]}") for name in CASE.split(", ")[1:] if not name.startswith(("issue", "object"))]))


def suite(records: DataFrame, ws, mapping=None, areas=None, quotas=None, ambiguous=AMBIGUOUS, boilerplate: str | None = None, seed: int = 42) -> DataFrame:
    """``assemble`` over ``prepare``: the suite of raw held-out records."""
    return assemble(prepare(records, ws, mapping, areas, boilerplate), ws, quotas, ambiguous, seed)


def distinct_cases(cases: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """``finish`` in no order, for what counts cases. Issues are looked at before cases are joined with the first ids of their
    texts, so that topics travel only where they are asked for."""
    from .curate import first_of

    blank = F.exists("expected_topics", lambda t: strip(F.coalesce(t["issue"], F.lit(""))) == "")
    own = cases.where((strip(F.col("text")) != "") & (F.col("expected_topic_count") >= 1)).withColumn("__gm_blank", blank)
    own = first_of(own, [normalize(F.col("text"))], "id").dropDuplicates(["id"])
    checked = F.when(F.col("__gm_blank"), F.raise_error(F.concat(F.col("id"), F.lit(": empty expected issue"))).cast("boolean")).otherwise(F.lit(True))
    if training is not None:
        known = training.select(F.md5(normalize(F.col("text"))).alias("__gm_t")).distinct().withColumn("__gm_in", F.lit(True))
        own = own.withColumn("__gm_t", F.md5(normalize(F.col("text")))).join(known, "__gm_t", "left")
        checked = F.when(F.col("__gm_in"), F.raise_error(F.concat(F.col("id"), F.lit(": a training text"))).cast("boolean")).otherwise(checked)
    return own.where(checked).select(*cases.columns)


def finish(cases: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """Cases with a text and a topic, one a normalised text and one an id (the first by id), in order of id. An expected
    topic without an issue fails the run, as does a text that ``training`` (column text) holds."""
    return distinct_cases(cases, training).orderBy("id")


def statistics(cases: DataFrame) -> DataFrame:
    """(statistic, value, n): cases by category, provenance, split (the first), number of topics and expected domain, the
    cases that span splits, and the text lengths at the least, the quarters and the most."""
    fact = lambda name, value: F.struct(F.lit(name).alias("s"), value.cast("string").alias("v"))
    facts = F.array(
        fact("cases", F.lit("all")), fact("category", F.col("category")), fact("provenance", F.col("kind")), fact("split", F.get("splits", F.lit(0))), fact("topics", F.col("expected_topic_count")),
        fact("spanning", F.when(F.size("splits") != 1, F.col("id"))), fact("length", F.length("text")),
    )
    domains = F.transform("expected_domains", lambda d: F.struct(F.lit("domain").alias("s"), d.alias("v")))
    long = F.col("s") == "length"
    told = cases.select(F.explode(F.concat(facts, domains)).alias("f")).select("f.*").where(F.col("v").isNotNull() | long).groupBy("s", "v").agg(F.count("*").alias("n"))
    # cases are read once and counted by length, too; a length's places follow from the counts of the lengths below it
    length = F.when(long, F.col("v").cast("long"))
    alone = Window.partitionBy("s", F.when(~long, F.col("v")))  # lengths are few
    told = told.withColumn("m", F.sum("n").over(alone)).withColumn("end", F.sum("n").over(alone.orderBy(length).rowsBetween(Window.unboundedPreceding, 0)))
    holds = lambda at: (F.col("end") - F.col("n") <= at) & (at < F.col("end"))
    least, most = holds(F.lit(0)), holds(F.col("m") - 1) & (F.col("m") > 1)
    quarters = [F.when(holds(F.floor(F.col("m") * k / 4)), F.lit(name)) for k, name in ((1, "p25"), (2, "median"), (3, "p75"))]
    marks = F.array_compact(F.array(F.when(least, F.lit("min")), F.when(most, F.lit("max")), *quarters))
    return told.select(F.col("s").alias("statistic"), F.explode(F.when(long, marks).otherwise(F.array("v"))).alias("value"), F.when(long, length).otherwise(F.col("n")).alias("n"))


def write(cases: DataFrame, folder: str) -> None:
    """Cases and statistics as JSON lines, in order of id and of name."""
    from ..sources.io import write_jsonl

    write_jsonl(cases, f"{folder}/cases", ["id"])
    write_jsonl(statistics(cases), f"{folder}/stats", ["statistic", "value"])


def tagged(*lists: tuple[str, DataFrame]) -> DataFrame:
    """(id, tags) of several lists of ids together, each with its tag, tags sorted."""
    out = None
    for tag, ids in lists:
        one = ids.select("id", F.lit(tag).alias("tag"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("id").agg(F.sort_array(F.collect_set("tag")).alias("tags"))


def control_sample(members: DataFrame, categories: list[str]) -> DataFrame:
    """(slot, category, id): for each slot the next member by id of its category, the first one again after the last; a
    category without members, or one used up, fails the run. ``members``: category, id."""
    spark = members.sparkSession
    offsets = [(k, c, categories[:k].count(c)) for k, c in enumerate(categories)]
    slots = spark.createDataFrame(offsets, "slot int, category string, nth int")
    most = max((n for *_, n in offsets), default=0)
    ranked = members.withColumn("nth", F.row_number().over(Window.partitionBy("category").orderBy("id")) - 1).where(F.col("nth") <= most)
    told = slots.join(ranked, ["category", "nth"], "left")
    checked = F.when(F.col("id").isNull(), F.raise_error(F.concat(F.lit("no control case left in category "), F.col("category")))).otherwise(F.lit(True))
    return told.withColumn("__gm_ok", checked.cast("boolean")).where("__gm_ok").select("slot", "category", "id")
