import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from grainmill.operators import curate


@pytest.fixture(scope="module")
def appeals(spark):
    rows = [(0, "u1", "Вода", "Надано номер 5", "2025-01-01T00:00"), (1, "u1", "Вода", "Немає води", "2025-12-31T23:59"), (2, "u2", "Вода", "Немає  ВОДИ", "2026-01-01T00:00:30")]
    rows += [(3, "u3", "Інше", "Щось", "2026-02-01T00:00"), (4, "u4", "", "Порожній вид", "2026-02-01T00:00"), (5, "u5", None, "Без виду", "2026-02-01T00:00")]
    rows += [(6, "u6", "Вода", "Немає води", "2026-07-01T00:00"), (7, "u7", "Дороги", "Яма", "2026-13-01T00:00"), (8, "u8", "Вода", "мені надано номер", "2025-02-01T10:10")]
    return spark.createDataFrame(rows, "row_id long, uid string, kind string, content string, received string")


def ids(df):
    return sorted(r["row_id"] for r in df.collect())


def test_noise_and_broad(appeals):
    got = appeals.select("row_id", curate.is_noise(F.col("content")).alias("n"), curate.is_broad(F.col("kind")).alias("b"))
    assert ids(got.where("n")) == [0] and ids(got.where("b")) == [3, 5]


def test_dedup(appeals):
    assert 6 not in ids(curate.dedup_pairs(appeals)) and 1 in ids(curate.dedup_pairs(appeals))
    assert set(ids(curate.dedup_normalized(appeals))).isdisjoint({2, 6})


def test_support_is_inclusive(appeals):
    assert ids(curate.min_support(appeals, 5)) == [0, 1, 2, 6, 8]
    assert ids(curate.min_support(appeals, 6)) == []


def test_split_bounds(appeals):
    got = {r["row_id"]: r["split"] for r in curate.chronological_split(appeals, "2026-01-01T00:00", "2026-07-01T00:00").collect()}
    assert (got[1], got[2], got[6], got[7]) == ("train", "validation", "test", "test")


def test_bad_date_fails_or_is_null(spark):
    bad = spark.createDataFrame([(1, "soon"), (2, None)], "row_id long, received string")
    with pytest.raises(PySparkException):
        curate.chronological_split(bad, "2026-01-01T00:00", "2026-07-01T00:00").collect()
    assert curate.chronological_split(bad, "2026-01-01T00:00", "2026-07-01T00:00", strict=False).where("split is null").count() == 2


def test_leakage(appeals):
    s = curate.chronological_split(appeals, "2026-01-01T00:00", "2026-07-01T00:00")
    r, = curate.leakage(s).collect()
    assert (r["text"], r["splits"], r["rows"]) == ("немає води", ["test", "train", "validation"], 3)
    with pytest.raises(ValueError):
        curate.assert_no_leakage(s)
    curate.assert_no_leakage(s.where("split = 'train'"))


def test_unknown_label_fails(appeals, spark):
    labels = spark.createDataFrame([("Вода", 0)], "kind string, idx int")
    with pytest.raises(PySparkException):
        curate.to_index(appeals, labels).collect()


def test_ids_get_ordinals_only_where_repeated(spark):
    df = spark.createDataFrame([(1, "a", "train"), (2, "a", "train"), (3, "a", "test")], "row_id long, uid string, split string")
    assert [r["id"] for r in curate.id_table(df).orderBy("row_id").collect()] == ["train:a#0", "train:a#1", "test:a"]


def test_funnel(appeals):
    got = [r["rows"] for r in curate.funnel(appeals, "2026-01-01T00:00", "2026-07-01T00:00", 2).orderBy("ordinal").collect()]
    assert got == [9, 8, 6, 5, 3, 2, 1, 0]


def test_strided_wraps(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "ordinal long, v string")
    assert [r["v"] for r in curate.strided(df, 4, 2).orderBy("pick").collect()] == ["a", "c", "b", "a"]
    assert curate.strided(df.limit(0), 4, 2).count() == 0


def test_empty(appeals):
    none = appeals.limit(0)
    assert [r["rows"] for r in curate.funnel(none, "2026-01-01T00:00", "2026-07-01T00:00").collect()] == [0] * 8
