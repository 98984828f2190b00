"""Exposure audits of file sets, hashes of files, trees and records, claim checks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns as p

#: Keys of the raw source's schema, and how many of them make a file a verbatim copy of it.
SOURCE_KEYS, VERBATIM = ("uid", "receivedDateTime", "type", "kind", "content", "accrualMethod"), 5
TEXT_KEYS = ("messages", "text", "raw", "content")


def private_counts(text: Column) -> Column:
    """Struct of phone-like and email-like hits."""
    x = F.coalesce(text, F.lit(""))
    return F.struct(F.regexp_count(x, F.lit(p.LIKE_PHONE)).cast("long").alias("phones"), F.regexp_count(x, F.lit(p.LIKE_EMAIL)).cast("long").alias("emails"))


def file_hashes(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, bytes, sha256) of files, read by Spark from any of its file systems."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def _folded(df: DataFrame, by: str | None, name: str) -> DataFrame:
    """(by, name, n): SHA-256 over the values (column ``value``) of each group in their order.

    Rows are streamed through the hash in sorted order, so nothing is gathered; a hash of a whole is sequential by nature,
    so each group, or everything without ``by``, passes through one task.
    """
    key = F.col(by).cast("string") if by else F.lit("")
    rows = df.select(key.alias("by"), "value")
    rows = rows.repartition("by").sortWithinPartitions("by", "value") if by else rows.repartitionByRange("value").sortWithinPartitions("value").coalesce(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest, n, seen = None, hashlib.sha256(), 0, False
        done = []
        for batch in batches:
            for group, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if seen and group != at:
                    done.append((at, digest.hexdigest(), n))
                    digest, n = hashlib.sha256(), 0
                at, seen, n = group, True, n + 1
                digest.update(value.encode("utf-8", "surrogatepass"))
        if seen:
            done.append((at, digest.hexdigest(), n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.string()), pa.array([d[2] for d in done], pa.int64())], names=["by", name, "n"])

    told = rows.mapInArrow(run, f"by string, {name} string, n long")
    if by:
        return told.select(F.col("by").cast(df.schema[by].dataType).alias(by), name, "n")
    nothing = df.sparkSession.range(1).select(F.lit(hashlib.sha256().hexdigest()).alias("none"))
    return nothing.join(told, F.lit(True), "left").select(F.coalesce(name, "none").alias(name), F.coalesce("n", F.lit(0)).cast("long").alias("n"))  # one row each


def tree_hash(hashes: DataFrame, path: str = "path", by: str | None = None) -> DataFrame:
    """SHA-256 of the sorted ``path:sha256`` entries, one after another, of all files or of each group."""
    entry = F.concat_ws(":", F.col(path), F.col("sha256")).alias("value")
    return _folded(hashes.select(*([by] if by else []), entry), by, "tree_sha256").drop("n")


def scan_jsonl(spark: SparkSession, folder: str, glob: str = "*.jsonl") -> DataFrame:
    """Per file: rows, the source keys it has, whether it copies the source's schema or carries free text, and phone- and
    email-like rows and hits. Blank lines do not count; lines that are not JSON count as rows only.

    Strings shorter than 13 characters cannot hold a hit and are skipped, as are keys; values are found at any depth.
    """
    lines = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(folder).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("line")).where("line <> ''")
    v = F.try_parse_json("line")
    keys = F.coalesce(F.map_keys(v.try_cast("map<string,variant>")), F.array().cast("array<string>"))
    values = F.regexp_extract_all("line", F.lit(r'"((?:[^"\\]|\\.){13,})"(?!\s*:)'), F.lit(1))
    private = private_counts(F.array_join(values, "\n"))
    rows = lines.select("path", v.isNotNull().alias("ok"), keys.alias("keys"), F.when(v.isNotNull(), private).alias("c"))
    told = rows.groupBy("path").agg(
        F.count("*").alias("rows"),
        F.array_distinct(F.flatten(F.collect_set("keys"))).alias("keys"),
        F.count_if(F.col("c.phones") > 0).alias("phone_like_rows"),
        F.coalesce(F.sum("c.phones"), F.lit(0)).alias("phone_like_hits"),
        F.count_if(F.col("c.emails") > 0).alias("email_like_rows"),
        F.coalesce(F.sum("c.emails"), F.lit(0)).alias("email_like_hits"),
    )
    own = F.array_intersect("keys", F.array(*map(F.lit, SOURCE_KEYS)))
    return told.withColumn("verbatim_source_keys", F.sort_array(own)).withColumn("verbatim_source_schema", F.size(own) >= VERBATIM).withColumn("carries_free_text", F.arrays_overlap("keys", F.array(*map(F.lit, TEXT_KEYS)))).drop("keys")


def path_class(path: Column, rules: tuple[tuple[str, str, str], ...], default: str) -> Column:
    """The class of the first rule (prefix or suffix, value, class) that the path meets."""
    out = None
    for how, value, name in rules:
        met = path.startswith(value) if how == "prefix" else path.endswith(value)
        out = F.when(met, name) if out is None else out.when(met, name)
    return F.lit(default) if out is None else out.otherwise(default)


def records_fingerprint(df: DataFrame, columns: tuple[str, ...] = ("uid", "kind", "content")) -> DataFrame:
    """SHA-256 over the sorted records, each value and a NUL; null prints as None. The same for rows in any order."""
    told = F.concat(*[x for c in columns for x in (F.coalesce(F.col(c).cast("string"), F.lit("None")), F.char(F.lit(0)))])
    return _folded(df.select(told.alias("value")), None, "fingerprint")


def grid_complete(df: DataFrame, keys: list[str], output: str) -> DataFrame:
    """One row: rows, distinct keys, blank outputs, the cells of the full grid that are missing, and whether all is there."""
    sizes = [F.countDistinct(k) for k in keys]
    full = sizes[0]
    for s in sizes[1:]:
        full = full * s
    told = df.agg(F.count("*").alias("rows"), F.countDistinct(*keys).alias("cells"), F.count_if(F.coalesce(F.trim(output), F.lit("")) == "").alias("blank"), full.alias("full"))
    ok = (F.col("rows") == F.col("cells")) & (F.col("cells") == F.col("full")) & (F.col("blank") == 0)
    return told.select("rows", "cells", "blank", (F.col("full") - F.col("cells")).alias("missing"), ok.alias("complete"))


def check_claims(claims: DataFrame, measured: DataFrame, keys: list[str], digits: int = 4) -> DataFrame:
    """(keys, claimed, measured, state): agrees at that rounding, differs or unmeasured."""
    both = claims.select(*keys, F.col("value").alias("claimed")).join(measured.select(*keys, F.col("value").alias("measured")), keys, "left")
    state = F.when(F.col("measured").isNull(), "unmeasured").when(F.round("claimed", digits) == F.round("measured", digits), "agrees").otherwise("differs")
    return both.withColumn("state", state)


def contained(passages: DataFrame, passage_id: str, docs: DataFrame, doc_id: str, text: str = "text", width: int = 8) -> DataFrame:
    """(passage_id, doc_id): documents that hold a whole passage as a run of words (lower case, any separators).

    Candidates share the hash of the passage's first ``width`` words, or of all where it has fewer, and are then compared
    word by word; windows are joined by equality, with one row a distinct window of a document. Passages without words are
    nowhere.
    """
    from ..functions.text import word_tokens

    def windows(w: Column, n: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(w, i, n), " ")))
        return F.when(F.size(w) >= n, F.array_distinct(hashes)).otherwise(F.array().cast("array<bigint>"))

    own = passages.select(passage_id, word_tokens(F.col(text)).alias("__gm_p")).where(F.size("__gm_p") > 0).withColumn("__gm_n", F.least(F.size("__gm_p"), F.lit(width)))
    own = own.withColumn("__gm_h", F.xxhash64(F.array_join(F.slice("__gm_p", F.lit(1), F.col("__gm_n")), " ")))
    words = docs.select(doc_id, word_tokens(F.col(text)).alias("__gm_w"))
    sizes = sorted(r[0] for r in own.select("__gm_n").distinct().collect())  # at most ``width`` numbers
    if not sizes:
        return words.join(own, F.lit(False)).select(passage_id, doc_id)
    of = lambda n: F.transform(windows(F.col("__gm_w"), F.lit(n)), lambda h: F.struct(F.lit(n).alias("n"), h.alias("h")))
    each = F.flatten(F.array(*map(of, sizes)))
    keys = words.select(doc_id, "__gm_w", F.explode(each).alias("__gm_k"))
    both = keys.join(own, (F.col("__gm_k.n") == F.col("__gm_n")) & (F.col("__gm_k.h") == F.col("__gm_h")))
    spaced = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    return both.where(F.contains(spaced("__gm_w"), spaced("__gm_p"))).select(passage_id, doc_id).distinct()


def markdown_tables(text: DataFrame, body: str = "text") -> DataFrame:
    """(table, row, cells) of the pipe tables in documents (doc, text); rows of dashes are left out."""
    lines = text.select("doc", F.posexplode(F.split(body, "\n")).alias("pos", "line")).withColumn("pipe", F.trim("line").startswith("|"))
    w = Window.partitionBy("doc").orderBy("pos")
    new = (F.col("pipe") & ~F.coalesce(F.lag("pipe").over(w), F.lit(False))).cast("int")
    numbered = lines.withColumn("table", F.sum(new).over(w)).where("pipe")
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    body_rows = numbered.withColumn("cells", cells).where(~F.forall("cells", lambda c: c.rlike("^:?-+:?$")))
    return body_rows.select("doc", "table", (F.row_number().over(Window.partitionBy("doc", "table").orderBy("pos")) - 1).alias("row"), "cells")


def quoted_hashes(text: DataFrame, known: DataFrame, body: str = "text") -> DataFrame:
    """(doc, sha256, known): every 64-digit hash that a document quotes, and whether a file has it."""
    each = text.select("doc", F.explode(F.regexp_extract_all(body, F.lit(r"\b([0-9a-f]{64})\b"), F.lit(1))).alias("sha256")).distinct()
    return each.join(known.select("sha256").distinct().withColumn("known", F.lit(True)), "sha256", "left").select("doc", "sha256", F.coalesce("known", F.lit(False)).alias("known"))


def exposure(files: DataFrame) -> DataFrame:
    """Totals over files (path, sha256, bytes, rows, alias): files, those that aren't aliases, distinct contents, bytes, rows,
    rows of distinct contents (each counted at its first path), the rows that copies repeat, and groups of copies."""
    groups = files.where("not alias").groupBy("sha256").agg(F.min_by("rows", "path").alias("rows"), F.count("*").alias("n"))
    all_files = files.agg(F.count("*").alias("files"), F.count_if(~F.col("alias")).alias("distinct_files"), F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    distinct = groups.agg(F.count("*").alias("distinct_contents"), F.sum("rows").alias("distinct_rows"), F.count_if(F.col("n") > 1).alias("duplicate_groups"))
    both = all_files.crossJoin(distinct)  # one row each
    return both.select("files", "distinct_files", "distinct_contents", "bytes", "rows", "distinct_rows", (F.col("rows") - F.col("distinct_rows")).alias("duplicate_rows"), "duplicate_groups")


def exposure_by(files: DataFrame, *by: str) -> DataFrame:
    return files.groupBy(*by).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))


#: Characters of a gram by which tokens are looked up in the list of all tokens.
GRAM = 3


def _tokens(x: Column) -> Column:
    """Distinct runs of non-blank characters."""
    return F.array_distinct(F.regexp_extract_all(x, F.lit(r"(\S+)"), F.lit(1)))


def _grams(x: Column, k) -> Column:
    """Distinct parts of ``k`` characters of a token; none of a shorter one."""
    k = F.lit(k) if isinstance(k, int) else k
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - k + 1, F.lit(1))), lambda i: F.substr(x, i, k))
    return F.when(F.length(x) >= k, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def mentions(needles: DataFrame, bodies: DataFrame, ws, body_id: str = "reader", body: str = "body") -> DataFrame:
    """(needle, body_id): every body that contains all strings of a needle, by joins on equality only. ``needles``: needle,
    an array of strings.

    A run of non-blank characters of such a string lies inside one such run of the body. Bodies are therefore tokenised once
    into postings (token, body). A needle is looked up by one of its runs only, the one that fewest of all different tokens
    may contain, in the list of these tokens, which grows far slower than the bodies. That look-up is a join on grams of
    three characters: the rarest gram of the run. What is found is verified in the list, then in the bodies. Postings,
    tokens and grams are written, since bodies are dear to tokenise.

    A needle without a non-blank character, or with a null string, fails the run; null needles and bodies take no part.
    """
    own = needles.select("needle").dropna().distinct()
    runs = F.array_distinct(F.flatten(F.transform("needle", _tokens)))
    blank = F.raise_error(F.lit("a needle without a character that is not blank")).cast("array<string>")
    own = own.withColumn("runs", F.when(F.size(runs) > 0, runs).otherwise(blank))
    postings = ws.table("postings", bodies.dropna(subset=[body]).select(F.col(body_id).alias("id"), F.explode(_tokens(F.col(body))).alias("token")))
    known = ws.table("tokens", postings.select("token").distinct())
    # the grams of every token, and its shorter parts, by which runs that are shorter than a gram are found
    parts = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda k: _grams(F.col("token"), k)))
    grams = ws.table("grams", known.select("token", F.explode(F.array_distinct(parts)).alias("gram")))
    weights = grams.groupBy("gram").agg(F.count("*").alias("n"))
    asked = own.select("needle", F.explode("runs").alias("run"))
    asked = asked.select("needle", "run", F.explode(_grams(F.col("run"), F.least(F.length("run"), F.lit(GRAM)))).alias("gram"))
    rated = asked.join(weights, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    best = rated.groupBy("needle").agg(F.min_by(F.struct("run", "gram"), F.struct("n", "run", "gram")).alias("c"))
    held = best.select("needle", "c.run", "c.gram").join(grams, "gram").where(F.contains("token", F.col("run")))
    found = held.select("needle", "token").join(postings, "token").select("needle", "id").distinct()
    texts = bodies.select(F.col(body_id).alias("id"), F.col(body).alias("body"))
    holds = F.forall("needle", lambda x: F.contains(F.col("body"), x))
    return found.join(texts, "id").where(holds).select("needle", F.col("id").alias(body_id)).distinct()


def read_by(files: DataFrame, readers: DataFrame, ws, common: tuple[str, ...] = ("data",)) -> DataFrame:
    """(path, reader): files that a reader's body (reader, body) mentions, by the last folder and the name, or by the name
    together with any folder above it but the first and the common ones."""
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    tail = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), "/")
    folders = F.array_except(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), F.array(*map(F.lit, common)))
    either = F.array_union(F.array(F.array(tail)), F.transform(F.filter(folders, lambda d: F.trim(d) != ""), lambda d: F.array(name, d)))
    asked = ws.table("asked", files.where(F.trim(name) != "").select("path", F.explode(either).alias("needle")))
    return asked.join(mentions(asked, readers, ws), "needle").select("path", "reader").distinct()


def distribution_checks(paths: DataFrame, docs: DataFrame, forbidden: list[tuple[str, str]], required: list[tuple[str, str, str]], claims: list[tuple[str, str]]) -> DataFrame:
    """(check, ok, found) of a distribution: path patterns that no file may have (check, pattern), texts or patterns that a
    document must hold (check, doc, pattern), and claims that no document may make (check, pattern). ``docs``: doc, text."""
    count = lambda df, checks, value, of: df.agg(*[F.count_if(F.col(value).rlike(c[-1]) & of(c)).alias(str(i)) for i, c in enumerate(checks)]).select(F.explode(F.create_map(*[x for i, c in enumerate(checks) for x in (F.lit(c[0]), F.col(f"`{i}`"))])).alias("check", "found"))
    everywhere = lambda c: F.lit(True)
    told = []
    if forbidden:
        told.append(count(paths, forbidden, "path", everywhere).withColumn("ok", F.col("found") == 0))
    if required:
        told.append(count(docs, required, "text", lambda c: F.col("doc") == c[1]).withColumn("ok", F.col("found") > 0))
    if claims:
        told.append(count(docs, claims, "text", everywhere).withColumn("ok", F.col("found") == 0))
    out = told[0]
    for t in told[1:]:
        out = out.unionByName(t)
    return out.select("check", "ok", "found")


def split_fingerprints(files: DataFrame) -> DataFrame:
    """(split, n, tree_sha256) of files (split, path, sha256)."""
    entry = F.concat_ws(":", "path", "sha256").alias("value")
    return _folded(files.select("split", entry), "split", "tree_sha256").select("split", "n", "tree_sha256")
