import zlib

from pyspark.sql import functions as F

import corpus_pipeline
from grainmill.llm import jaccard_join, mixing, pii, rule_ensemble
from grainmill.storage import Workspace

D = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "jaccard_join", "pii", "mixing", "packing"]


def test_each_stage_works_on_what_is_kept(spark):
    ws = Workspace(spark, "test-pipeline")
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, ws.table(str(k), stage(spark, docs, D))
        if name != "packing":
            assert docs.columns == columns
        if name == "jaccard_join":
            assert jaccard_join.join(docs, Workspace(spark, "t")).where("doc_id <> component_id").count() == 0
            assert docs.join(before, "doc_id", "left_anti").count() == 0
        if name == "pii":
            assert docs.count() == before.count()
            assert pii.find_pii(docs, Workspace(spark, "t")).where("size(spans) > 0").count() == 0
        if name == "mixing":
            taken = {(r["doc_id"]): r["taken"] for r in mixing.mix(before, Workspace(spark, "t")).taken.collect()}
            due = mixing.mix(before, Workspace(spark, "t"), h=F.xxhash64(*before.columns)).curriculum.select("doc_id", "take", "position").collect()
            words = {}
            for r in docs.collect():
                words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].encode().split())
            assert words == {i: n for i, n in taken.items() if n}
        if name == "packing":
            meta = F.col("_metadata.file_name"), F.col("_metadata.row_index")
            before_rows = before.select("*", meta[0].alias("f"), meta[1].alias("k")).orderBy("f", "k").collect()
            rows = docs.orderBy("slot", "at", "start").collect()
            assert all(len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)
            # documents in the order of the curriculum, whatever their pieces; each bucket numbered in that order
            seen = [r["doc_id"] for r in rows if r["start"] == 0]
            assert seen == [r["doc_id"] for r in before_rows]
            numbers = {}
            for r in rows:
                numbers.setdefault(r["length"], []).append(r["sequence_id"])
            assert all(n == sorted(n) for n in numbers.values())
            places = {}
            for r in due:
                places.setdefault((r["doc_id"], r["take"]), []).append(r["position"])
            at = [places[r["doc_id"], len(r["text"].encode().split())].pop(0) for r in before_rows]
            assert at == sorted(at)
            assert docs.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()


def test_quality_stage_is_the_classifier(spark):
    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    kept = corpus_pipeline.keep_good_quality(spark, docs, D)
    want = rule_ensemble.score(docs, labels, Workspace(spark, "t")).where("predicted = 1")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in want.collect())


def test_empty_and_extra_columns(spark, messy, empty):
    for docs in (messy, empty.withColumn("doc_id", F.col("doc_id"))):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, D)
            assert name == "packing" or out.columns == docs.columns, name
            out.count()


def test_run_end_to_end(spark, tmp_path):
    """From documents to packed ids, against what the stages owe: copies gone, personal data marked, the mix in order."""
    import random

    import numpy as np
    from tokenizers import Tokenizer

    from grainmill.llm.tokenizing import default_path

    rng = random.Random(12)
    word = lambda: "w" + str(rng.randrange(500))
    base = [[word() for _ in range(rng.randrange(60, 90))] for _ in range(24)]
    rows = [(i, " ".join(w), "en", "ab"[i % 2]) for i, w in enumerate(base)]
    rows += [(100 + i, " ".join(base[i]), "en", "b") for i in range(4)]  # copies
    rows += [(200 + i, " ".join(base[i][:-1] + ["edited"]), "en", "a") for i in range(4, 8)]  # near copies
    rows += [(300, " ".join([word() for _ in range(60)]) + " write to me@example.org now", "en", "a"), (301, "", "en", "b"), (302, None, "en", None)]
    docs = spark.createDataFrame([(i, t, la, s, len(t) if t is not None else None) for i, t, la, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    got = corpus_pipeline.run(spark, str(tmp_path)).orderBy("slot", "at", "start").collect()
    # two labels train no rules, so nothing is rejected; of copies the first stays; blank texts stay and are never taken
    kept = [(i, t.replace("me@example.org", "<EMAIL>") if t else t, la, s) for i, t, la, s in rows if i < 100 or i >= 300]
    frame = spark.createDataFrame([(i, t, la, s, len(t) if t is not None else None) for i, t, la, s in kept], docs.schema)
    want = mixing.mix(frame, Workspace(spark, "t"), h=F.xxhash64(*frame.columns)).curriculum.select("doc_id", "take", "position").collect()
    text = {i: t for i, t, *_ in kept}
    library = Tokenizer.from_file(default_path())
    ids = lambda i, n: [*library.encode(text[i] if n == len(text[i].split()) else " ".join(text[i].split()[:n]), add_special_tokens=False).ids, 1]
    found, places = [], {}
    for r in got:
        if r["start"] == 0:
            found.append((r["doc_id"], []))
        assert r["start"] == len(found[-1][1]) and found[-1][0] == r["doc_id"]
        found[-1][1].extend(np.frombuffer(r["ids"], dtype="<u4").tolist())
    due = [(r["doc_id"], ids(r["doc_id"], r["take"]), r["position"]) for r in want]
    assert sorted(found) == sorted((i, x) for i, x, _ in due)
    for i, x, position in due:
        places.setdefault((i, tuple(x)), []).append(position)
    at = [places[i, tuple(x)].pop(0) for i, x in found]
    assert at == sorted(at)
    assert sorted(r["sequence_id"] for r in got) == list(range(len(got)))
