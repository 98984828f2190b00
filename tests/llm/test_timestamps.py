import random
import re
import zoneinfo
from datetime import date, datetime, timedelta, timezone

import pytest

from grainmill.llm import timestamps

SCHEMA = "stamp_id long, source string, zone string, raw string, token string, text string, voter string, epoch long, n long, fits int"
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
PATTERNS = [
    (r"(?P<y>20[0-9]{2})-(?P<m>[0-9]{2})-(?P<d>[0-9]{2})", False),
    (r"(?P<y>20[0-9]{2})(?P<m>[0-9]{2})(?P<d>[0-9]{2})", False),
    (r"(?P<d>[0-9]{2})[.](?P<m>[0-9]{2})[.](?P<y>20[0-9]{2})", False),
    (rf"(?P<d>[0-9]{{2}}) (?P<b>{'|'.join(MONTHS)}) (?P<y>20[0-9]{{2}})", False),
    (r"(?P<d>[0-9]{2})/(?P<m>[0-9]{2})/(?P<y>20[0-9]{2})", True),
]
ZONES = zoneinfo.available_timezones()
SUFFIX = r"(?:[T ](?P<h>[0-9]{2}):(?P<mi>[0-9]{2})(?::(?P<s>[0-9]{2}))?(?: ?(?P<half>[AP]M))?(?: ?(?P<off>Z|[+-][0-9]{2}:?[0-9]{2}))?)?"


def _date(y, m, d):
    try:
        return date(int(y), int(m), int(d))
    except ValueError:
        return None


def read(row):
    """(readings, seconds of the day, offset in minutes or None) of a stamp that is neither an epoch nor bad."""
    text = (row[3] or "").strip(" \t\n\x0b\x0c\r")
    for pattern, slashed in PATTERNS:
        m = re.fullmatch(pattern + SUFFIX, text, re.ASCII)
        if not m:
            continue
        g = m.groupdict()
        month = MONTHS.index(g["b"]) + 1 if g.get("b") else g["m"]
        readings = [_date(g["y"], month, g["d"]), _date(g["y"], g["d"], month) if slashed else None]
        if not slashed:
            readings[1] = readings[0]
        hour, minute, second = int(g["h"] or 0), int(g["mi"] or 0), int(g["s"] or 0)
        if minute > 59 or second > 59 or not any(readings):
            return None
        if g["half"]:
            if not 1 <= hour <= 12:
                return None
            hour = hour % 12 + 12 * (g["half"] == "PM")
        if hour > 23:
            return None
        offset = None
        if g["off"] == "Z":
            offset = 0
        elif g["off"]:
            away = g["off"].replace(":", "")
            if int(away[1:3]) > 14 or int(away[3:]) > 59:
                return None
            offset = (1 if away[0] == "+" else -1) * (int(away[1:3]) * 60 + int(away[3:]))
        elif row[2] is None or row[2] not in ZONES:
            return None
        return readings, hour * 3600 + minute * 60 + second, offset
    return None


def brute(rows):
    votes = {}
    for row in rows:
        got = read(row)
        if got and (got[0][0] is None) != (got[0][1] is None):
            votes.setdefault(row[1], [0, 0])[got[0][0] is None] += 1
    out = []
    for row in rows:
        text = (row[3] or "").strip(" \t\n\x0b\x0c\r")
        if re.fullmatch("[0-9]{10}|[0-9]{13}", text, re.ASCII):
            out.append((row[0], int(text) * (10**6 if len(text) == 10 else 1000), "epoch", False))
            continue
        got = read(row)
        if not got:
            out.append((row[0], None, "bad", False))
            continue
        (first, second), seconds, offset = got
        rule, day = "plain", first or second
        if first and second and first != second:
            a, b = votes.get(row[1], (0, 0))
            rule, day = ("votes", first if a > b else second) if a != b else ("default", second)
        wall, shaky = datetime(day.year, day.month, day.day) + timedelta(seconds=seconds), False
        if offset is None:
            zone = zoneinfo.ZoneInfo(row[2])
            own = wall.replace(tzinfo=zone).utcoffset()
            shaky = own != wall.replace(tzinfo=zone, fold=1).utcoffset()
            utc = wall - own
        else:
            utc = wall - timedelta(minutes=offset)
        us = (utc - datetime(1970, 1, 1)) // timedelta(microseconds=1)
        out.append((row[0], us, rule, shaky or rule in ("votes", "default")))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t", "x", "v", 1, 2, 3) for r in rows], SCHEMA)


def check(spark, ws, rows, **options):
    got = timestamps.normalise(frame(spark, rows), ws, **options)
    assert got.columns == ["stamp_id", "utc_us", "rule", "ambiguous"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_messy(spark, ws):
    texts = [
        None, "", " ", "n/a", "2024-02-30", "2024-02-29", "2023-02-29", "20240131", "20240131T10:20", "2024013110", "1999-01-01", "2100-01-01",
        "2024-01-01T24:00", "2024-01-01 10:60", "2024-01-01 10:10:60", "2024-01-01 00:10 AM", "2024-01-01 12:10 AM", "2024-01-01 12:10PM", "2024-01-01 13:10 PM",
        "2024-01-01 10:10 +15:00", "2024-01-01 10:10+14:59", "2024-01-01 10:10-0060", "2024-01-01T10:10:11Z", "2024-01-01T10:10:11 PM -0330", "2024-01-01  10:10",
        "31.12.2024", "31.13.2024", "01 jan 2024", "01 Jan 2024 05:06", "01 Foo 2024", "1 Jan 2024", "\t2024-01-01 05:06:07\r\n", "2024-01-01 ", "2024-01-01\n05:06", "2024-01-01Z",
        "13/01/2024", "01/13/2024", "05/05/2024", "03/04/2024", "13/13/2024", "03/04/2024 24:00", "01/14/2024 25:00", "١٢٣٤٥٦٧٨٩٠", "1700000000", "1700000000123", "170000000012", "2024-1-01", "x" * 100_000,
    ]
    rows = [(i, s, z, t) for i, (t, s, z) in enumerate((t, s, z) for t in texts for s, z in (("a", "UTC"), (None, "Europe/Berlin"), ("b", None), ("c", "No/Where"), ("d", "")))]
    rows += [(7, "a", "UTC", "03/04/2024"), (7, "a", "UTC", "03/04/2024"), (None, "a", "UTC", "13/04/2024"), (None, None, None, None)]
    check(spark, ws, rows)
    check(spark, ws, rows, parts=1)


@pytest.mark.parametrize("parts", [1, 4, 1000])
def test_votes(spark, ws, parts):
    """Orders of a hot source, of a source without votes, of ties and of a null source, whatever counts as hot."""
    rng, rows = random.Random(3), []
    for i in range(4000):
        source = rng.choice(["hot"] * 6 + ["s%d" % rng.randrange(40), None])
        a, b = rng.randrange(1, 29 if source == "hot" or rng.random() < 0.3 else 13), rng.randrange(1, 13)
        if source and source[-1] in "13579":
            a, b = b, a
        rows.append((i, source, rng.choice(["UTC", "America/New_York", "Asia/Kolkata"]), f"{a:02}/{b:02}/20{rng.randrange(100):02} {rng.randrange(26):02}:{rng.randrange(61):02}"))
    check(spark, ws, rows, parts=parts)


def test_changes_of_all_zones(spark, ws):
    """Wall times around every change of every zone that both zone tables know alike."""
    known = set(spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds())
    rows, utc = [], timezone.utc
    for zone in sorted(ZONES & known):
        info, at = zoneinfo.ZoneInfo(zone), datetime(2004, 1, 1, tzinfo=utc)
        if zone.startswith(("posix", "right", "System")):
            continue
        while at.year < 2023:
            after = at + timedelta(days=7)
            if at.astimezone(info).utcoffset() != after.astimezone(info).utcoffset():
                lo, hi = at, after
                while hi - lo > timedelta(minutes=1):
                    mid = lo + (hi - lo) // 2
                    lo, hi = (mid, hi) if mid.astimezone(info).utcoffset() == at.astimezone(info).utcoffset() else (lo, mid)
                for minutes in (-190, -61, -60, -31, -1, 0, 1, 29, 59, 60, 61, 190):
                    wall = hi.replace(second=0, tzinfo=None) + at.astimezone(info).utcoffset() + timedelta(minutes=minutes)
                    rows.append((len(rows), "s", zone, wall.strftime("%Y-%m-%d %H:%M:%S")))
            at = after
    assert len(rows) > 10_000
    got = {tuple(r) for r in timestamps.normalise(frame(spark, rows), ws).collect()}
    missed = {rows[r[0]][2] for r in got ^ set(brute(rows))}
    assert len(missed) <= 12, sorted(missed)  # zones whose changes the two tables date differently
    assert not missed & {"America/New_York", "Europe/Berlin", "Asia/Kolkata", "Australia/Lord_Howe", "America/Sao_Paulo", "Asia/Tehran"}


def test_empty(spark, ws):
    got = timestamps.normalise(spark.createDataFrame([], SCHEMA), ws)
    assert got.collect() == [] and got.columns == ["stamp_id", "utc_us", "rule", "ambiguous"]


def test_dictionary(spark):
    told = {r["token"]: (r["day_first"], r["month_first"]) for r in timestamps.dictionary(spark).collect()}
    days = lambda *x: (date(*x) - date(1970, 1, 1)).days
    assert len(told) == timestamps.dictionary(spark).count() == 4 * timestamps.DAYS + sum(1 + (d.day > 12) for d in (date(2000, 1, 1) + timedelta(k) for k in range(timestamps.DAYS)))
    assert told["31/01/2000"] == (days(2000, 1, 31), None) and told["01/31/2000"] == (None, days(2000, 1, 31))
    assert told["02/01/2000"] == (days(2000, 1, 2), days(2000, 2, 1)) and told["29 Feb 2096"] == (days(2096, 2, 29),) * 2
    assert "30/02/2000" not in told and "20990931" not in told and told["31.12.2099"][0] == days(2099, 12, 31)
