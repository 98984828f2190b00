"""Training streams: relabelled examples, terse ones, pairs of complaints as one text, and the corpora made of them.

Draws are seeded hashes of the ids: the same rows for a seed, and not those of another engine's random numbers.
An example is a row (uid, text, topics); ``chat`` in ``augment`` turns it into messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, lower_first, normalize, strip
from . import augment, labels
from .scoring import TOPIC

#: How two requests are put into one text, and whether both get a lead.
REGISTRY = (
    ("Заявник звернувся з двох питань, а саме: {a} та {b}.", False),
    ("Заявник звернувся з двох питань: {a} та {b}.", False),
    ("Заявник звертається з двох питань, а саме: {a} та {b}.", True),
    ("Заявниця звернулася з двох питань, а саме: {a} та {b}.", True),
    ("Прохання {a}. Прохання {b}.", False),
    ("Щодо {a}, а також {b}.", False),
    ("Необхідно {a}, а також {b}.", False),
    ("Треба {a}. Крім того, {b}.", False),
    ("Прошу {a}, а також {b}.", False),
)
LEAD = "стосовно "
#: How a second clause is joined to the first.
JOINERS = ("а також {b}", ", крім того, {b}", "а {b}", "через що також {b}")
#: Two requests in one sentence, leads of notes, and what a note's boilerplate sentences hold.
NOTE_REQUESTS = ("Прошу {a} та {b}.", "Необхідно {a} та {b}.")
NOTE_LEADS = ("щодо ", "прохання ", "звертається з ")
NOTE_BOILERPLATE = (
    "відповідь надат", "надати телефоном", "надати поштою", "надати письмово", "згоду на обробку", "згоду на оброблення", "бажає отримати", "просить надати", "відповідь заявник",
    "заявник надає", "надає згоду", "заявниця надає", "повідомити засобами", "персональних даних", "надати відповідь", "відповідь надається", "просимо надати",
)


def topic_of(issue: Column, kind: Column, mapping=None) -> Column:
    """The weak label of one (issue, kind), without an organization."""
    label = labels.label(issue, kind)
    return label if mapping is None else label.withField("domain", labels.domain(kind, mapping))


def relabelled(df: DataFrame, per_topic: Column, clean=labels.clean_issue, act=labels.action_clause) -> DataFrame:
    """Topics with cleaned issues and re-derived actions, from the whole text or, where ``per_topic``, each from its own
    issue; objects and attributes stay. Adds changed_issues, actions and empty_actions of a row. ``uid`` is unique; a row
    without topics keeps none."""
    names = [c for c in df.columns if c not in ("uid", "topics")]
    each = df.select("*", per_topic.alias("__gm_own"), F.posexplode_outer("topics").alias("__gm_at", "__gm_t"))
    issue = F.coalesce(F.col("__gm_t.issue"), F.lit(""))
    each = each.withColumn("__gm_i", clean(F.when(F.col("__gm_own"), issue).otherwise(F.col("text"))))
    found = act(F.when(F.col("__gm_own"), F.col("__gm_i")).otherwise(F.col("text")))
    each = each.withColumn("__gm_a", F.when(F.col("__gm_own") & (F.col("__gm_i") == ""), "").otherwise(found))
    topic = F.col("__gm_t").withField("issue", F.col("__gm_i")).withField("requested_action", F.col("__gm_a"))
    one = F.when(F.col("__gm_at").isNotNull(), F.struct(F.col("__gm_at").alias("at"), topic.alias("t"), (F.col("__gm_i") != issue).cast("int").alias("c"), (F.col("__gm_a") != "").cast("int").alias("a")))
    told = each.groupBy("uid").agg(F.first(F.struct(*names)).alias("__gm_r"), F.array_sort(F.collect_list(one), lambda x, y: x["at"] - y["at"]).alias("__gm_x"))  # a row's topics
    total = lambda k: F.aggregate("__gm_x", F.lit(0), lambda n, x: n + x[k])
    told = told.select("uid", "__gm_r.*", F.transform("__gm_x", lambda x: x["t"]).alias("topics"), total("c").alias("changed_issues"), total("a").alias("actions"), F.size("__gm_x").alias("__gm_n"))
    return told.withColumn("empty_actions", F.col("__gm_n") - F.col("actions")).select(*df.columns, "changed_issues", "actions", "empty_actions")


def relabel_counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("changed_issues", "actions", "empty_actions")])


def terse_pool(df: DataFrame, kernel: Column, longest: int = 150, least: int = 25, text: str = "content") -> DataFrame:
    """Short records that leave a kernel; adds ``kernel``."""
    return df.where(F.length(collapse(F.col(text))) < longest).withColumn("kernel", collapse(kernel)).where(F.length("kernel") >= least)


def terse_examples(pool: DataFrame, ordinal: str, prefix: str = "V3-TERSE-", clean=labels.clean_issue, act=labels.action_clause, mapping=None) -> DataFrame:
    """Examples with the kernel as the visible text, whose issue is not empty. ``ordinal``: a record's place in the pool,
    dense from 0, which is its number."""
    from ..functions import patterns as p

    told = pool.withColumn("issue", clean(F.col("kernel"))).where("issue <> ''")
    domain = labels.domain(F.col("kind"), p.KIND_TO_DOMAIN if mapping is None else mapping)
    topic = F.struct(domain.alias("domain"), F.col("issue"), labels.street(F.col("kernel")).alias("object"), act(F.col("kernel")).alias("requested_action"), labels.attributes(F.col("kernel")).alias("attributes")).cast(TOPIC)
    return told.select(F.concat(F.lit(prefix), F.lpad(F.col(ordinal).cast("string"), 5, "0")).alias("uid"), F.col("kernel").alias("text"), F.array(topic).alias("topics"))


def _pick(options: list[Column], seed: int, salt: str) -> Column:
    h = F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col("a_uid"), F.col("b_uid")), F.lit(len(options))).cast("int")
    return F.get(F.array(*options), h)


def _filled(template: str, a: Column, b: Column) -> Column:
    """A template with both texts; texts may hold anything."""
    parts, rest = [], template
    for name, x in (("{a}", a), ("{b}", b)):
        if name in rest:
            head, rest = rest.split(name, 1)
            parts += [F.lit(head), x]
    return F.concat(*parts, F.lit(rest))


def registry_texts(pairs: DataFrame, seed: int = 42, templates=REGISTRY, lead: str = LEAD) -> DataFrame:
    """Adds text: two issues (a_issue, b_issue) in one of the registry's phrasings."""
    led = lambda x: F.when(F.lower(x).startswith(lead), x).otherwise(F.concat(F.lit(lead), x))
    options = [_filled(t, led(F.col("a_issue")) if both else F.col("a_issue"), led(F.col("b_issue")) if both else F.col("b_issue")) for t, both in templates]
    return pairs.withColumn("text", _pick(options, seed, "registry"))


def joined_texts(pairs: DataFrame, seed: int = 42, joiners=JOINERS) -> DataFrame:
    """Adds text: the second issue joined to the first as a clause."""
    second = lower_first(strip(F.col("b_issue")))
    options = [F.concat(strip(F.col("a_issue")), F.lit(", "), _filled(j, F.lit(""), second), F.lit(".")) for j in joiners]
    return pairs.withColumn("text", _pick(options, seed, "joiner"))


def note_texts(pairs: DataFrame, seed: int = 42, requests=NOTE_REQUESTS) -> DataFrame:
    """Adds text: two kernels (a_kernel, b_kernel) in one sentence and their actions (a_action, b_action) in another."""
    upper = F.concat(F.upper(F.left(F.col("a_kernel"), F.lit(1))), F.substr(F.col("a_kernel"), F.lit(2)))
    asks = _pick([_filled(r, F.col("a_action"), F.col("b_action")) for r in requests], seed, "note")
    return pairs.withColumn("text", F.concat(upper, F.lit(", а також "), lower_first(F.col("b_kernel")), F.lit(". "), asks))


def pooled(df: DataFrame, frozen: DataFrame, ws, mapping=None, text: str = "content", kind: str = "kind", uid: str = "uid") -> DataFrame:
    """(uid, kind, content, domain, issue, action, kernel, phrase): records whose text has one kind and is not frozen, with
    what pairs are made of; written, since labels are dear."""
    from ..functions import patterns as p

    own = augment.without_texts(augment.single_kind(df, text, kind), frozen, text)
    content = F.col(text)
    mapped = labels.domain(F.col(kind), p.KIND_TO_DOMAIN if mapping is None else mapping)
    told = own.select(F.col(uid).alias("uid"), F.col(kind).alias("kind"), content.alias("content"), mapped.alias("domain"), labels.issue(content).alias("issue"), labels.requested_action(content).alias("action"), labels.note_kernel(content, NOTE_BOILERPLATE, NOTE_LEADS).alias("kernel"))
    return ws.table("pool", told.withColumn("phrase", labels.action_phrase(F.col("action"), NOTE_LEADS)))


def paired(pool: DataFrame, frozen: DataFrame, n: int, style: str, ws, seed: int = 42, clash_rules=()) -> DataFrame:
    """(uid, text, topics, a_uid, b_uid, domains): ``n`` examples at most of pairs of different domains, in one of the styles
    registry, joined or note. Texts that are too long (2,500 or 2,000 characters) or frozen are left out, as are pairs
    with an empty issue; notes need short records with an action each, kernels, and different actions."""
    rows = pool.where("issue <> ''")
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    if style == "note":
        short = F.length(strip(F.col("content"))).between(60, 260) & F.length("action").between(20, 220) & (F.length("kernel") >= 25) & (F.length("phrase") >= 8)
        rows = rows.where(short)
        extra = (strip(F.left(a("action"), F.lit(25))) != strip(F.left(b("action"), F.lit(25)))) & ~augment.clash(a("kind"), b("kind"), clash_rules)
        make, most, tag = note_texts, None, "NT"
        found = augment.random_pairs(rows, "uid", "domain", 2 * n, seed=seed, extra=extra)
        found = found.withColumnsRenamed({"a_phrase": "a_act", "b_phrase": "b_act"}).drop("a_action", "b_action").withColumnsRenamed({"a_act": "a_action", "b_act": "b_action"})
    else:
        make, most, tag = (registry_texts, 2500, "RS") if style == "registry" else (joined_texts, 2000, "SC")
        found = augment.random_pairs(rows, "uid", "domain", 2 * n, seed=seed)
    told = make(found, seed)
    told = told if most is None else told.where(F.length("text") <= most)
    told = augment.without_texts(told, frozen.select(F.col("content").alias("text")), "text")
    topics = F.array(topic_of(a("issue"), a("kind")).withField("domain", a("domain")), topic_of(b("issue"), b("kind")).withField("domain", b("domain")))
    told = told.withColumn("topics", topics).where(F.forall("topics", lambda t: strip(t["issue"]) != ""))
    uid = F.concat(F.lit(f"MT-SYN-{tag}-"), a("uid").cast("string"), F.lit("-"), b("uid").cast("string"))
    order = augment.seeded(seed, "a_uid", "b_uid")
    return told.orderBy(order).limit(n).select(uid.alias("uid"), "text", "topics", "a_uid", "b_uid", F.array(a("domain"), b("domain")).alias("domains"))


def corpus(single: DataFrame, terse: DataFrame, several: DataFrame, times_terse: int = 8, times_real: int = 12, times_made: int = 3, real: str = "MT-REAL") -> DataFrame:
    """(stream, uid, text, topics): the streams together, replicated by their weights. A single or terse example needs an
    issue in any topic, one of several topics needs one in all. ``dropped`` counts what this leaves out."""
    tagged = lambda df, name: df.select(F.lit(name).alias("stream"), "uid", "text", "topics")
    rows = tagged(single, "single").unionByName(tagged(terse, "terse")).unionByName(tagged(several, "multitopic"))
    kept = augment.keep_streams(rows, F.col("stream") == "multitopic")
    times = F.when(F.col("stream") == "terse", times_terse).when(F.col("stream") == "single", 1).when(F.col("uid").startswith(real), times_real).otherwise(times_made)
    return augment.replicate(kept, times)


def dropped(single: DataFrame, several: DataFrame) -> DataFrame:
    """(stream, dropped): examples without an issue to learn from."""
    count = lambda df, name, all_needed: df.agg(F.lit(name).alias("stream"), (F.count("*")).alias("n")).crossJoin(augment.keep_streams(df, F.lit(all_needed)).agg(F.count("*").alias("kept")))  # noqa: E731  # one row each
    both = count(single, "single", False).unionByName(count(several, "multitopic", True))
    return both.select("stream", (F.col("n") - F.col("kept")).alias("dropped"))


def with_same_object(corpus_rows: DataFrame, same_object: DataFrame) -> DataFrame:
    """A corpus with the same-object stream; a uid in both, or a same-object example without exactly two topics, fails the
    run."""
    extra = same_object.select(F.lit("same_object").alias("stream"), "uid", "text", "topics")
    two = F.when(F.size("topics") != 2, F.raise_error(F.concat(F.lit("not two topics: "), F.col("uid")))).otherwise(F.lit(True))
    extra = extra.withColumn("__gm_ok", two.cast("boolean")).where("__gm_ok").drop("__gm_ok")
    known = corpus_rows.select("uid").distinct().withColumn("__gm_in", F.lit(True))
    both = extra.join(known, "uid", "left")
    new = F.when(F.col("__gm_in"), F.raise_error(F.concat(F.lit("in both: "), F.col("uid")))).otherwise(F.lit(True))
    extra = both.withColumn("__gm_ok", new.cast("boolean")).where("__gm_ok").select("stream", "uid", "text", "topics")
    return corpus_rows.unionByName(extra)


def of_uids(df: DataFrame, provenance: DataFrame, uid: str = "uid") -> DataFrame:
    """Provenance rows of the examples that are there; copies (``#n``) count as their example."""
    own = df.select(F.split(uid, "#")[0].alias(uid)).distinct()
    return provenance.join(own, uid, "left_semi")


def held_out_examples(examples: DataFrame, fraction: float = 0.08, least: int = 8, seed: int = 42) -> DataFrame:
    """Adds ``held``: of real and of synthetic examples (column synthetic) the first by a seeded hash. All in all a fraction
    is held, ``least`` at least; of real ones the fraction, one at least; synthetic ones fill up the rest."""
    n, real = examples.count(), examples.where(~F.col("synthetic")).count()
    n_hold = max(least, round(fraction * n))
    n_real = max(1, min(real, round(fraction * real))) if real else 0
    order = [augment.seeded(seed, "uid"), F.col("uid")]
    picked = examples.where(~F.col("synthetic")).orderBy(*order).limit(n_real).unionByName(examples.where("synthetic").orderBy(*order).limit(max(0, n_hold - n_real)))
    held = picked.select("uid").withColumn("held", F.lit(True))  # a fraction of a bounded set of examples
    return examples.join(held, "uid", "left").withColumn("held", F.coalesce("held", F.lit(False)))


def multitopic_set(records: DataFrame, frozen: DataFrame, real: DataFrame, targets: dict[str, int], ws, mapping=None, seed: int = 42, fraction: float = 0.08) -> DataFrame:
    """(uid, text, topics, synthetic, held, leaks): real decompositions and synthetic pairs of each style up to its target,
    with the held-out part and whether a text is frozen. ``real``: uid, text, topics."""
    pool = pooled(records, frozen, ws, mapping)
    out = real.select("uid", "text", "topics", F.lit(False).alias("synthetic"))
    for style, n in targets.items():
        if n:
            out = out.unionByName(ws.table(f"style-{style}", paired(pool, frozen, n, style, ws, seed)).select("uid", "text", "topics", F.lit(True).alias("synthetic")))
    told = held_out_examples(ws.table("examples", out), fraction, seed=seed)
    known = frozen.select(F.md5(normalize(F.col("content"))).alias("__gm_t")).distinct().withColumn("leaks", F.lit(True))
    both = told.withColumn("__gm_t", F.md5(normalize(F.col("text")))).join(known, "__gm_t", "left").drop("__gm_t")
    return both.withColumn("leaks", F.coalesce("leaks", F.lit(False)))


def same_corpus(rebuilt: DataFrame, recorded_fingerprint: str, columns=("uid", "text")) -> DataFrame:
    """The rebuilt corpus; another fingerprint than the recorded one fails the run."""
    from .audit import records_fingerprint

    got = records_fingerprint(rebuilt, columns).first()["fingerprint"]
    if got != recorded_fingerprint:
        raise ValueError(f"the corpus has fingerprint {got}, not {recorded_fingerprint}")
    return rebuilt
