"""Stamps of many layouts as instants: a dictionary of all dates, a time suffix, votes of each source.

The dictionary lists every date from 2000-01-01 to 2099-12-31 as each layout writes it (y-m-d, ymd, d.m.y, d b y, and with
slashes), with both readings: the date if the day comes first and the date if the month does. Only slashed tokens can
differ in them, or have one only. It has some 205,000 rows whatever the input, so it is broadcast and a date token is read
by one hash join; a token that is not in it is no date. The rest of a stamp, its time, is judged by one expression.

A source's slashed stamps that are possible in one order only vote for that order. Votes are summed before they are
shuffled. A source that holds more than a part in ``parts`` of all slashed stamps is hot; there are fewer than ``parts``
of these, so their votes are broadcast and their rows stay where they are. Slashed stamps of all other sources meet their
votes in a shuffled join, and the rest of the table is not shuffled at all.

Wall times without an offset are in ``zone``. One that the zone skips or repeats takes the offset before the change and
counts as ambiguous.

Nulls, ties, repeats: a null, empty or unfit stamp is bad (utc_us null) and does not vote, and so is one that needs a zone
which is null or unknown; null sources are one source; equal votes, or none, give the month first; rows that share a
stamp_id stay separate; an empty table gives an empty result. Only stamp_id, source, zone and raw are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Workspace

#: White space that is stripped at both ends.
BLANK = " \t\n\x0b\x0c\r"
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
#: Days of the dictionary, from 2000-01-01 to 2099-12-31.
DAYS = 36_525
_MINUTE = "[0-5][0-9]"
#: What may follow a date: nothing, or a time of 24 or of 12 hours with an offset or without.
TIME = rf"([T\x20]((([01][0-9]|2[0-3]):{_MINUTE}(:{_MINUTE})?)|((0[1-9]|1[0-2]):{_MINUTE}(:{_MINUTE})?\x20?[AP]M))(\x20?(Z|[+-](0[0-9]|1[0-4]):?{_MINUTE}))?)?"
#: No zone has two changes within these hours, and none repeats more than these hours, in the years of the dictionary.
HOURS = 6
_US = 1_000_000


def dictionary(spark: SparkSession) -> DataFrame:
    """token, day_first, month_first (days since 1970; null: impossible): every date in every layout."""
    day = F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int"))
    days = spark.range(0, DAYS, 1, 4).select(day.alias("date"))
    y, m, d = (F.date_format("date", p) for p in ("yyyy", "MM", "dd"))
    name = F.element_at(F.array(*map(F.lit, MONTHS)), F.month("date"))
    number = F.unix_date("date")
    swapped = F.when(F.dayofmonth("date") <= 12, F.unix_date(F.make_date(F.year("date"), F.dayofmonth("date"), F.least(F.month("date"), F.lit(12)))))
    entry = lambda token, day_first, month_first: F.struct(token.alias("token"), day_first.alias("day_first"), month_first.alias("month_first"))
    plain = [F.concat_ws("-", y, m, d), F.concat(y, m, d), F.concat_ws(".", d, m, y), F.concat_ws(" ", d, name, y)]
    slashed = [entry(F.concat_ws("/", d, m, y), number, swapped)]
    month_only = F.when(F.dayofmonth("date") > 12, entry(F.concat_ws("/", m, d, y), F.lit(None).cast("int"), number))
    entries = F.array_compact(F.array(*[entry(t, number, number) for t in plain], *slashed, month_only))
    return days.select(F.explode(entries).alias("e")).select("e.*")


def _slashed(text: Column) -> Column:
    return (F.substring(text, 3, 1) == "/") & (F.substring(text, 6, 1) == "/")


def _token(text: Column) -> Column:
    """The date token if there is one: its layout tells its length."""
    third = F.substring(text, 3, 1)
    size = F.when(third == " ", 11).when(third.isin("/", ".") | (F.substring(text, 5, 1) == "-"), 10).otherwise(8)
    return F.substr(text, F.lit(1), size)


def _offset_at(instant: Column, zone: Column) -> Column:
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(instant), zone)) - instant


def _read(stamps: DataFrame) -> DataFrame:
    """Adds epoch, both readings, and what the time suffix says: fits, clock_us (since midnight), offset_us, own_zone."""
    text = F.col("text")
    known = stamps.withColumn("token", _token(text)).join(F.broadcast(dictionary(stamps.sparkSession)), "token", "left")
    rest = F.substr(text, F.length("token") + 1)
    known = known.withColumn("rest", rest).withColumn("fits", F.col("rest").rlike(rf"^{TIME}\z"))
    rest, two = F.col("rest"), lambda at: F.substr(F.col("rest"), at, F.lit(2)).try_cast("long")
    hour = F.when(rest.contains("AM"), two(F.lit(2)) % 12).when(rest.contains("PM"), two(F.lit(2)) % 12 + 12).otherwise(two(F.lit(2)))
    second = F.when(F.substring(rest, 7, 1) == ":", two(F.lit(8))).otherwise(0)
    clock = F.when(rest == "", F.lit(0)).otherwise(hour * 3600 + two(F.lit(5)) * 60 + second) * _US
    sign = F.greatest(F.locate("+", rest), F.locate("-", rest))
    away = (two(sign + 1) * 3600 + F.right(rest, F.lit(2)).try_cast("long") * 60) * _US
    offset = F.when(sign > 0, F.when(F.substr(rest, sign, F.lit(1)) == "-", -away).otherwise(away)).when(F.endswith(rest, F.lit("Z")), F.lit(0))
    zone = F.when(F.try_make_timestamp(F.lit(2000), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0), F.col("zone")).isNotNull(), F.col("zone"))
    epoch = F.when(text.rlike(r"^[0-9]{10}\z"), text.try_cast("long") * _US).when(text.rlike(r"^[0-9]{13}\z"), text.try_cast("long") * 1000)
    return known.select(
        *stamps.columns,
        epoch.alias("epoch"),
        "day_first",
        "month_first",
        F.when(F.col("fits"), clock.cast("long")).alias("clock_us"),
        F.when(F.col("fits"), offset.cast("long")).alias("offset_us"),
        zone.alias("own_zone"),
    ).withColumn("fits", F.col("clock_us").isNotNull() & (F.col("offset_us").isNotNull() | F.col("own_zone").isNotNull()))


def _cleaned(stamps: DataFrame) -> DataFrame:
    return stamps.select(F.col("stamp_id").cast("long").alias("stamp_id"), F.col("source").cast("string").alias("source"), F.col("zone").cast("string").alias("zone"), F.coalesce(F.btrim(F.col("raw").cast("string"), F.lit(BLANK)), F.lit("")).alias("text"))


def votes(stamps: DataFrame) -> DataFrame:
    """source, day_votes, month_votes, n (its slashed stamps) of every source that has slashed stamps."""
    read = _read(_cleaned(stamps).where(_slashed(F.col("text"))))
    one = lambda a, b: F.count_if(F.col("fits") & F.col(a).isNotNull() & F.col(b).isNull())
    return read.groupBy("source").agg(one("day_first", "month_first").alias("day_votes"), one("month_first", "day_first").alias("month_votes"), F.count("*").alias("n"))


def normalise(stamps: DataFrame, ws: Workspace, margin: int = 1, parts: int | None = None) -> DataFrame:
    """stamp_id, utc_us, rule, ambiguous. An order wins with more than ``margin`` times the other's votes.

    ``parts`` tells hot sources (by default the session's shuffle partitions) and does not change the result.
    """
    spark = ws.spark
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cast = ws.table("votes", votes(stamps))
    total = cast.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = cast.where(F.col("n") * parts > total).select(F.col("source").alias("voter"), "day_votes", "month_votes")
    cold = cast.where(F.col("n") * parts <= total).select(F.col("source").alias("voter"), "day_votes", "month_votes")
    rows = _cleaned(stamps)
    slashed, own = rows.where(_slashed(F.col("text"))), F.expr("source <=> voter")
    none = F.lit(None).cast("long")
    plain = rows.where(~_slashed(F.col("text"))).withColumn("day_votes", none).withColumn("month_votes", none)
    by_hot = slashed.join(F.broadcast(hot), own)
    by_cold = slashed.join(F.broadcast(hot), own, "left_anti").join(cold.hint("shuffle_hash"), own)
    read = _read(plain.unionByName(by_hot.drop("voter")).unionByName(by_cold.drop("voter")))
    return _settled(read, margin)


def _settled(read: DataFrame, margin: int) -> DataFrame:
    first, second = F.col("day_first"), F.col("month_first")
    fits = F.col("fits") & F.coalesce(first, second).isNotNull()
    contested = fits & (first != second)
    by_day = F.col("day_votes") > margin * F.col("month_votes")
    by_month = F.col("month_votes") > margin * F.col("day_votes")
    rule = F.when(F.col("epoch").isNotNull(), "epoch").when(~F.coalesce(fits, F.lit(False)), "bad").when(contested & (by_day | by_month), "votes").when(contested, "default").otherwise("plain")
    date = F.when(by_day, F.coalesce(first, second)).otherwise(F.coalesce(second, first)).cast("long")
    wall = F.when(fits & F.col("epoch").isNull(), date * 86_400 * _US + F.col("clock_us"))
    told = read.select("stamp_id", "epoch", rule.alias("rule"), wall.alias("wall"), "offset_us", "own_zone")
    zone, wall = F.col("own_zone"), F.col("wall")
    utc = F.when(F.col("offset_us").isNull(), F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall), zone)))
    told = told.withColumn("local", utc)
    local = F.col("local")
    later = wall - _offset_at(local + HOURS * 3600 * _US, zone)
    skipped = _offset_at(local, zone) != wall - local
    repeated = (later > local) & (_offset_at(later, zone) == wall - later)
    return told.select(
        "stamp_id",
        F.coalesce("epoch", wall - F.col("offset_us"), local).alias("utc_us"),
        "rule",
        (F.col("rule").isin("votes", "default") | F.coalesce(skipped | repeated, F.lit(False))).alias("ambiguous"),
    )


def _sql() -> str:
    two = "[0-9]{2}"
    layouts = {  # pattern, length, and the parts of the date if the day, and if the month, comes first
        "iso": (rf"20{two}-{two}-{two}", 10, "left(t, 10)", "left(t, 10)"),
        "digits": (rf"20{two}{two}{two}", 8, "left(t, 4) || '-' || substr(t, 5, 2) || '-' || substr(t, 7, 2)", None),
        "dots": (rf"{two}[.]{two}[.]20{two}", 10, "substr(t, 7, 4) || '-' || substr(t, 4, 2) || '-' || left(t, 2)", None),
        "names": (rf"{two} ({'|'.join(MONTHS)}) 20{two}", 11, f"substr(t, 8, 4) || '-' || lpad(CAST(list_position({list(MONTHS)}, substr(t, 4, 3)) AS VARCHAR), 2, '0') || '-' || left(t, 2)", None),
        "slashes": (rf"{two}/{two}/20{two}", 10, "substr(t, 7, 4) || '-' || substr(t, 4, 2) || '-' || left(t, 2)", "substr(t, 7, 4) || '-' || left(t, 2) || '-' || substr(t, 4, 2)"),
    }
    case = lambda k: "CASE " + " ".join(f"WHEN regexp_matches(t, '^{v[0]}') THEN {v[k] or v[2]}" for v in layouts.values()) + " END"
    at = lambda us: f"to_timestamp(({us}) / 1000000)"
    away = lambda us: f"epoch_us(timezone(zone, {at(us)})) - ({us})"
    return rf"""
WITH s AS (SELECT row_number() OVER () AS rid, stamp_id, source, zone, trim(coalesce(raw, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM stamps),
d AS (SELECT *, CASE WHEN regexp_full_match(t, '[0-9]{{10}}') THEN t::BIGINT * 1000000 WHEN regexp_full_match(t, '[0-9]{{13}}') THEN t::BIGINT * 1000 END AS epoch,
  try_cast({case(2)} AS DATE) AS dayfirst, try_cast({case(3)} AS DATE) AS monthfirst, substr(t, 1 + {case(1)}) AS rest FROM s),
f AS (SELECT *, coalesce(regexp_full_match(rest, '{TIME}'), false) AND coalesce(dayfirst, monthfirst) IS NOT NULL AND zone IS NOT NULL AS fits FROM d),
v AS (SELECT source, count(*) FILTER (WHERE dayfirst IS NOT NULL AND monthfirst IS NULL) AS dv, count(*) FILTER (WHERE monthfirst IS NOT NULL AND dayfirst IS NULL) AS mv FROM f WHERE fits GROUP BY source),
r AS (SELECT f.*, CASE WHEN epoch IS NOT NULL THEN 'epoch' WHEN NOT fits THEN 'bad' WHEN dayfirst <> monthfirst THEN CASE WHEN coalesce(dv, 0) <> coalesce(mv, 0) THEN 'votes' ELSE 'default' END ELSE 'plain' END AS rule,
  CASE WHEN coalesce(dv, 0) > coalesce(mv, 0) THEN coalesce(dayfirst, monthfirst) ELSE coalesce(monthfirst, dayfirst) END AS day,
  CASE WHEN rest = '' THEN 0 ELSE 3600 * CASE WHEN contains(rest, 'M') THEN substr(rest, 2, 2)::INT % 12 + CASE WHEN contains(rest, 'PM') THEN 12 ELSE 0 END ELSE substr(rest, 2, 2)::INT END
    + 60 * substr(rest, 5, 2)::INT + CASE WHEN substr(rest, 7, 1) = ':' THEN substr(rest, 8, 2)::INT ELSE 0 END END AS clock,
  regexp_extract(rest, '([+-])[0-9]', 1) AS sign FROM f LEFT JOIN v ON f.source IS NOT DISTINCT FROM v.source),
w AS (SELECT *, CASE WHEN fits AND epoch IS NULL THEN epoch_us(day::TIMESTAMP) + clock * 1000000::BIGINT END AS wall,
  CASE WHEN sign <> '' THEN (CASE WHEN sign = '-' THEN -1 ELSE 1 END) * (3600 * substr(rest, instr(rest, sign) + 1, 2)::BIGINT + 60 * right(rest, 2)::BIGINT) * 1000000 WHEN rest LIKE '%Z' THEN 0 END AS off FROM r),
z AS (SELECT *, {away("wall - 14 * 3600000000")} AS o1, {away("wall + 14 * 3600000000")} AS o2 FROM w WHERE wall IS NOT NULL AND off IS NULL),
c AS (SELECT *, wall - o1 AS u1, wall - o2 AS u2 FROM z),
l AS (SELECT rid, CASE WHEN {away("u1")} = o1 OR {away("u2")} <> o2 THEN u1 ELSE u2 END AS utc, o1 <> o2 AND ({away("u1")} = o1) = ({away("u2")} = o2) AS amb FROM c)
SELECT stamp_id, coalesce(epoch, wall - off, utc) AS utc_us, rule, rule IN ('votes', 'default') OR coalesce(amb, false) AS ambiguous FROM w LEFT JOIN l USING (rid)
"""


SQL = _sql()
