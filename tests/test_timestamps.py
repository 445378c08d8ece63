"""p5: hand-worked values, and a plain Python reading of the smallest tables."""

import re
from datetime import UTC, datetime, timedelta
from pathlib import Path
from zoneinfo import ZoneInfo

import pytest

from factgate.operators.timestamps import fit_formats, normalise_times, parse_values

SITES = [(1, "America/New_York", "mdy"), (5, "Europe/London", "dmy"), (8, "Australia/Sydney", "dmy")]
LOADED = datetime(2022, 12, 1, tzinfo=UTC)
CASES = [
    (1, "2019-03-10 02:30:00", "2019-03-10T07:30:00.000000Z"),  # skipped hour moves forward
    (1, "2019-11-03 01:30:00", "2019-11-03T05:30:00.000000Z"),  # occurs twice: the first
    (1, "2019-11-03 01:30:00 EST", "2019-11-03T06:30:00.000000Z"),
    (5, "05/06/2022", "2022-06-05"),
    (1, "05/06/2022", "2022-05-06"),
    (1, "25/12/2020", None),
    (5, "5/6/22 14:29", "2022-06-05T13:29:00.000000Z"),
    (8, "20200123195937", "2020-01-23T08:59:37.000000Z"),
    (8, "20150925T193447Z", "2015-09-25T19:34:47.000000Z"),
    (1, "1578169627", "2020-01-04T20:27:07.000000Z"),
    (1, "1406328035295", "2014-07-25T22:40:35.295000Z"),
    (1, "\t2020-03-10T06:50:52+05:45  ", "2020-03-10T01:05:52.000000Z"),
    (1, "2018-01-14 22:23:44 -0500", "2018-01-15T03:23:44.000000Z"),
    (1, "January 5, 2014 12:48 AM", "2014-01-05T05:48:00.000000Z"),
    (1, "03/21/2015 12:41pm", "2015-03-21T16:41:00.000000Z"),
    (5, "02.02.2014 13:59", "2014-02-02T13:59:00.000000Z"),
    (5, "01-DEC-2013 21:32:29", "2013-12-01T21:32:29.000000Z"),
    (5, "2019-01-08T20:28:42.1234567Z", "2019-01-08T20:28:42.123456Z"),
    (1, "Sep 2022", "2022-09"), (1, "2022-09", "2022-09"), (1, "2016 ", "2016"), (1, "20140914", "2014-09-14"),
    (1, "31 June 2020", None), (1, "2018-13-04 10:00:00", None), (1, "0000-00-00", None), (1, "Sep 1", None),
    (1, "3 weeks ago", None), (1, "", None), (1, None, None), (1, "2019-02-30 08:15", None), (1, "2019-02-03 25:15", None),
    (99, "2019-02-03 10:15", None), (99, "2019-02-03 10:15:00Z", "2019-02-03T10:15:00.000000Z"),
]


def frames(spark, cases):
    v = spark.createDataFrame([("t", i, s, site, LOADED, "x") for i, (site, s, _) in enumerate(cases)], "item_table string, row_id bigint, raw string, site_id int, loaded_at timestamp, tz_extra string")
    return v.drop("tz_extra"), spark.createDataFrame(SITES, "site_id int, tz string, date_order string")


def test_cases(spark):
    v, s = frames(spark, CASES)
    got = {r.row_id: r for r in normalise_times(v, s).collect()}
    assert len(got) == len(CASES)
    for i, (site, raw, want) in enumerate(CASES):
        assert got[i].norm == want, (site, raw, got[i])


def test_session_zone_is_irrelevant(spark):
    v, s = frames(spark, CASES)
    before = {r.row_id: r.norm for r in normalise_times(v, s).collect()}
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert before == {r.row_id: r.norm for r in normalise_times(v, s).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_em_finds_an_undeclared_order_and_marks_what_stays_open(spark):
    s = spark.createDataFrame([(1, "UTC", None), (2, "UTC", None)], "site_id int, tz string, date_order string")
    days = [datetime(2020, 1, 1, tzinfo=UTC) + timedelta(days=i) for i in range(200)]
    rows = [("t", i, d.strftime("%d/%m/%Y"), 1, d + timedelta(days=1)) for i, d in enumerate(days)]
    rows += [("t", 1000, "05/06/2020", 2, None)]
    v = spark.createDataFrame(rows, "item_table string, row_id bigint, raw string, site_id int, loaded_at timestamp")
    got = {r.row_id: r for r in normalise_times(v, s).collect()}
    right = sum(got[i].norm == d.strftime("%Y-%m-%d") for i, d in enumerate(days))
    assert right == len(days)
    assert got[1000].status == "ambiguous"
    assert fit_formats(parse_values(v, s)).count() > 0


def test_a_wrong_declaration_yields_to_the_data(spark):
    days = [f"{d}/{m}/2021" for d in range(13, 29) for m in range(1, 13)] + ["05/06/2021"]
    values, sites = frames(spark, [(1, d, None) for d in days] + [(5, "05/06/2021", None)])
    got = {(r.site, r.raw): r for r in normalise_times(values, sites).join(values.select("row_id", values.site_id.alias("site")), "row_id").collect()}
    assert got[1, "25/12/2021"].norm == "2021-12-25" and got[1, "05/06/2021"].norm == "2021-06-05"
    assert got[5, "05/06/2021"].norm == "2021-06-05"


def test_empty(spark):
    v, s = frames(spark, CASES)
    assert normalise_times(v.limit(0), s).count() == 0
    assert normalise_times(v, s.limit(0)).filter("norm is not null").count() > 0


MON = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}


def plain(raw, tz, order):
    """A second reading of the rules, value by value."""
    s = raw.strip()
    try:
        if re.fullmatch(r"\d{10}|\d{13}", s):
            us = int(s) * (1_000_000 if len(s) == 10 else 1000)
            return (datetime(1970, 1, 1) + timedelta(microseconds=us)).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
        if m := re.fullmatch(r"(\d{4})(\d\d)(\d\d)T?(\d\d)(\d\d)(\d\d)(Z?)", s):
            s = "{}-{}-{} {}:{}:{}{}".format(*m.groups())
        m = re.search(r"[T\s](\d+):(\d\d)(?::(\d\d)(?:\.(\d+))?)?\s*([ap]m)?\s*([+-]\d\d:?\d\d|Z|[A-Z]{3,4})?$", s, re.I)
        day, time = (s[: m.start()], m) if m else (s, None)
        if x := re.fullmatch(r"(\d{4})[-/](\d+)[-/](\d+)|(\d{4})(\d\d)(\d\d)", day):
            y, mo, d = (int(v) for v in x.groups() if v)
        elif x := re.fullmatch(r"(\d+)[-/.](\d+)[-/.](\d{4}|\d\d)", day):
            a, b, y = (int(v) for v in x.groups())
            y, (mo, d) = y + (2000 if y < 100 else 0), (a, b) if order == "mdy" else (b, a)
        elif x := re.fullmatch(r"(\d+)[ -]([A-Za-z]{3})[a-z]*[ -](\d{4})", day, re.I):
            d, mo, y = int(x[1]), MON[x[2].lower()], int(x[3])
        elif x := re.fullmatch(r"([A-Za-z]{3})[a-z]* (\d+), (\d{4})", day):
            d, mo, y = int(x[2]), MON[x[1].lower()], int(x[3])
        elif x := re.fullmatch(r"(\d{4})-(\d\d)", day):
            return datetime(int(x[1]), int(x[2]), 1).strftime("%Y-%m")
        elif x := re.fullmatch(r"([A-Za-z]{3})[a-z]* (\d{4})", day):
            return datetime(int(x[2]), MON[x[1].lower()], 1).strftime("%Y-%m")
        elif re.fullmatch(r"\d{4}", day):
            return datetime(int(day), 1, 1).strftime("%Y")
        else:
            return None
        if not time:
            return datetime(y, mo, d).strftime("%Y-%m-%d")
        h, mi, sec = int(time[1]), int(time[2]), int(time[3] or 0)
        if time[5]:
            h = h % 12 + (12 if time[5].lower() == "pm" else 0)
        t = datetime(y, mo, d, h, mi, sec, int((time[4] or "0")[:6].ljust(6, "0")))
        z = time[6]
        if z is None:
            t = t.replace(tzinfo=ZoneInfo(tz), fold=0).astimezone(UTC)
        else:
            known = {"Z": 0, "UTC": 0, "GMT": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "PDT": -7, "PST": -8, "CET": 1, "CEST": 2}
            off = timedelta(hours=known[z]) if z in known else timedelta(minutes=int(z[0] + "1") * (int(z[1:3]) * 60 + int(z[-2:])))
            t = (t - off).replace(tzinfo=UTC)
        return t.strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    except (ValueError, KeyError):
        return None


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_tables_against_plain_reading(spark, sf):
    from factgate.plans.prep import p5_found

    d = f"/root/testdata/{sf}"
    if not Path(d).exists():
        pytest.skip("no test data")
    got = {(r.item_table, r.row_id): r.norm for r in p5_found(spark, d).collect()}
    sites = {r.site_id: r for r in spark.read.parquet(f"{d}/sites.parquet").collect()}
    want = {}
    for t, k, c in (("admissions", "row_id", "admittime"), ("triples", "triple_id", "temporal_start")):
        for r in spark.read.parquet(f"{d}/{t}.parquet").select(k, c, "site_id").filter(f"{c} is not null").collect():
            if n := plain(r[1], sites[r.site_id].tz, sites[r.site_id].date_order):
                want[t, r[0]] = n
    assert got == want
