"""Mixed timestamp formats and time zones, brought to one unambiguous form.

Every valid parse of a value is a candidate. Expectation-maximisation per source fits a mixture over formats and over
the lag between the parsed day and the row's arrival; a value's posterior picks its interpretation and values that stay
undecided are marked. A source's declared day/month order is a prior worth PRIOR values: it decides where the data say little and
yields where they say otherwise. Only counts per (source, candidate formats, lag bins) enter the fit, so its input is bounded however
many rows there are. Each value is parsed once and written down; fit and choice read what was written.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgate.functions.dates import DAY_US, MONTH_RE, existing_date, micros_text, month_number
from factgate.functions.text import trim_blanks
from factgate.session import cut_lineage
from factgate.tables import broadcast_if_small, small_rows

#: The site table must fit the driver; it bounds the mixture table too (sites x formats x lag bins squared).
MAX_SITES = 100_000
EM_ROUNDS = 30
#: A fit of at most so many rows is broadcast to the values.
MAX_FIT = 200_000
#: A posterior below this leaves the value marked as ambiguous.
DECIDED = 0.95
#: What a declared day/month order weighs against the data, in values.
PRIOR = 20.0
#: Share of a source's numeric dates that may be slips: an order it writes less often is none of its orders.
ERROR = 0.05
LAG_EDGES = (-2, 3, 15, 61, 401)  # days from the parsed day to arrival; six bins

# Usual offsets of zone abbreviations in minutes; by region of the site where they differ.
ZONES = {
    "Z": 0, "UTC": 0, "UT": 0, "GMT": 0, "WET": 0, "WEST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120,
    "EEST": 180, "MSK": 180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480,
    "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "AST": -240, "ADT": -180, "NST": -210, "NDT": -150, "BST": 60,
    "IST": 330, "JST": 540, "KST": 540, "SGT": 480, "HKT": 480, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600,
    "AEDT": 660, "NZST": 720, "NZDT": 780,
}
REGION_ZONES = {
    "Australia/": {"EST": 600, "EDT": 660, "CST": 570, "CDT": 630, "WST": 480},
    "Asia/Shanghai": {"CST": 480}, "Asia/Taipei": {"CST": 480}, "Europe/Dublin": {"IST": 60}, "Asia/Jerusalem": {"IST": 120, "IDT": 180},
    "Asia/Dhaka": {"BST": 360},
}

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?\s*([AaPp]\.?[Mm]\.?)?\s*([+-]\d{2}:?\d{2}|[+-]\d{2}|[A-Za-z]{1,5})?$"
_JOIN = r"(?:[Tt]|\s*,\s*|\s+)"
# Rewrites of a date part into kind|year|month|day, by what it begins with; a part no rule fits keeps no bar.
_YEAR_FIRST = (
    (r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})$", "ymd|$1|$3|$4"),
    (r"^(\d{4})(\d{2})(\d{2})$", "packed|$1|$2|$3"),
    (r"^(\d{4})[-/.](\d{1,2})$", "month|$1|$2|1"),
    (r"^(\d{4})$", "year|$1|1|1"),
)
_DAY_OR_MONTH_FIRST = (
    (r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4})$", "numeric|$4|$1|$3"),
    (r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{2})$", "numeric|20$4|$1|$3"),
    (r"^(\d{1,2})[-/.](\d{4})$", "month|$2|$1|1"),
)
_NAMED = (
    (rf"(?i)^(\d{{1,2}})(?:st|nd|rd|th)?[\s,.-]*({MONTH_RE})[\s,.-]*(\d{{4}})$", "named|$3|$2|$1"),
    (rf"(?i)^(\d{{1,2}})(?:st|nd|rd|th)?[\s,.-]*({MONTH_RE})[\s,.-]*(\d{{2}})$", "named|20$3|$2|$1"),
    (rf"(?i)^({MONTH_RE})[\s.-]*(\d{{1,2}})(?:st|nd|rd|th)?[\s,-]+(\d{{4}})$", "named|$3|$1|$2"),
    (rf"(?i)^({MONTH_RE})[\s,.-]*(\d{{4}})$", "month|$2|$1|1"),
)


def zone_table(tz: str | None) -> dict[str, int]:
    """What zone abbreviations mean at a site."""
    out = dict(ZONES)
    for region, names in REGION_ZONES.items():
        if (tz or "").startswith(region):
            out |= names
    return out


def _zone_minutes(zone: Column, zones: Column) -> Column:
    """Offset of a written zone in minutes, null if unknown or none."""
    digits = F.rpad(F.regexp_replace(zone, "[^0-9]", ""), 4, "0").try_cast("int")
    numeric = F.when((digits <= 1800) & (digits % 100 < 60), F.floor(digits / 100) * 60 + digits % 100) * F.when(zone.startswith("-"), -1).otherwise(1)
    return F.when(zone.rlike("^[+-]"), numeric.cast("int")).otherwise(F.try_element_at(zones, F.upper(zone)))


def _rewritten(c: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    for pattern, into in rules:
        c = F.regexp_replace(c, pattern, into)
    return c


def parse_candidates(values: DataFrame) -> DataFrame:
    """Adds fmt_a, day_a, fmt_b, day_b (the valid readings of the date part), precision, and the parts of the time.

    values: raw, tz and anything else. All in the JVM; a value meets only the patterns its first characters allow.
    """
    trimmed = trim_blanks(F.col("raw"))
    # digits run together are written out first: 20200123T195937Z, 20200123195937
    packed = F.regexp_replace(trimmed, r"^(\d{4})(\d{2})(\d{2})[Tt ]?(\d{2})(\d{2})(\d{2})((?:[.,]\d+)?\s*(?:[Zz]|[+-]\d{2}:?\d{2})?)$", "$1-$2-$3T$4:$5:$6$7")
    packed = F.regexp_replace(packed, r"^(\d{4})(\d{2})(\d{2})[Tt](\d{2})(\d{2})([Zz]?)$", "$1-$2-$3T$4:$5$6")
    s = F.when((F.length(trimmed) > 8) & F.substring(trimmed, 5, 1).between("0", "9"), packed).otherwise(trimmed)
    df = values.withColumn("__s", s).withColumn("parts", F.split(F.regexp_replace("__s", _JOIN + _TIME, "|$1|$2|$3|$4|$5|$6"), r"\|", -1))
    s, parts = F.col("__s"), F.col("parts")
    df = df.withColumn("timed", F.size("parts") == 7).withColumn("__d", trim_blanks(parts[0]))
    d = F.col("__d")
    date_s = F.when(d.rlike("[A-Za-z]"), _rewritten(d, _NAMED)).when(d.rlike(r"^\d{4}"), _rewritten(d, _YEAR_FIRST)).otherwise(_rewritten(d, _DAY_OR_MONTH_FIRST))
    df = df.withColumn("ymd", F.split(date_s, r"\|", -1))
    y, m, d = (F.get("ymd", i) for i in (1, 2, 3))
    kind = F.when(F.size("ymd") == 4, F.col("ymd")[0])
    month = F.when(m.rlike("^[0-9]"), m.try_cast("int")).otherwise(month_number(m))

    def t(i: int) -> Column:
        return F.when(F.col("timed"), F.get(parts, F.lit(i)))

    hour, minute, second = t(1).try_cast("int"), t(2).try_cast("int"), F.coalesce(t(3).try_cast("int"), F.lit(0))
    half = F.lower(F.substring(t(5), 1, 1))
    hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    frac = F.rpad(F.substring(t(4), 1, 6), 6, "0").try_cast("bigint")
    clock = F.when((hour < 24) & (minute < 60) & (second < 60), (hour * 3600 + minute * 60 + second).cast("bigint") * 1_000_000 + F.coalesce(frac, F.lit(0)))
    epoch = F.when(s.rlike(r"^\d{10}$"), s.try_cast("bigint") * 1_000_000).when(s.rlike(r"^\d{13}$"), s.try_cast("bigint") * 1000)
    df = df.select(
        *values.columns, "timed", kind.alias("kind"), epoch.alias("epoch_us"), clock.alias("clock_us"), t(6).alias("zone"),
        existing_date(y, month, d).alias("day_first"), F.when(kind == "numeric", existing_date(y, d, month)).alias("day_second"),
    )
    df = df.withColumn("zone_min", _zone_minutes(F.col("zone"), F.col("zones")))
    partial = F.when(F.col("kind").isin("month", "year"), F.col("kind")).otherwise("date")
    bad = F.col("timed") & (F.col("clock_us").isNull() | (partial != "date") | ((F.col("zone") != "") & F.col("zone_min").isNull()))
    kind, is_epoch = F.col("kind"), F.col("epoch_us").isNotNull()
    fmt = F.when(kind == "numeric", "mdy").otherwise(kind)
    return df.select(
        *values.columns, "epoch_us", "clock_us", "zone_min",
        F.when(is_epoch | F.col("timed"), "instant").otherwise(partial).alias("precision"),
        F.when(is_epoch, "epoch").when(~bad & F.col("day_first").isNotNull(), fmt).alias("fmt_a"),
        F.when(is_epoch, F.date_from_unix_date((F.col("epoch_us") / DAY_US).cast("int"))).when(~bad, F.col("day_first")).alias("day_a"),
        F.when(~bad & F.col("day_second").isNotNull(), "dmy").alias("fmt_b"),
        F.when(~bad, F.col("day_second")).alias("day_b"),
    )


def _lag(day: Column, loaded_at: Column) -> Column:
    days = F.unix_date(F.date_from_unix_date(F.floor(F.unix_micros(loaded_at) / DAY_US).cast("int"))) - F.unix_date(day)
    out = F.lit(len(LAG_EDGES))
    for i in reversed(range(len(LAG_EDGES))):
        out = F.when(days < LAG_EDGES[i], i).otherwise(out)
    return F.when(day.isNotNull(), F.when(loaded_at.isNull(), len(LAG_EDGES) + 1).otherwise(out))


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    """EM over one source's counted signatures. The signatures number at most formats x bins squared."""
    pdf = pdf[pdf["fmt_a"].notna() | pdf["fmt_b"].notna()]
    if pdf.empty:
        return pd.DataFrame(columns=["source_key", "fmt_a", "bin_a", "fmt_b", "bin_b", "n", "post_a", "post_b", "both", "weight_a", "weight_b"])
    names = sorted({f for c in ("fmt_a", "fmt_b") for f in pdf[c].dropna()})
    index = {f: i for i, f in enumerate(names)}
    declared = pdf["date_order"].iloc[0]
    n = pdf["n"].to_numpy(float)
    nb = len(LAG_EDGES) + 2
    f = np.stack([pdf[c].map(index).fillna(-1).to_numpy(int) for c in ("fmt_a", "fmt_b")])
    b = np.stack([pdf[c].fillna(-1).to_numpy(int) for c in ("bin_a", "bin_b")])
    may = f >= 0
    orders = np.array([x in ("mdy", "dmy") for x in names])
    pseudo = np.array([PRIOR if x == declared else 1e-9 for x in names])
    weight, lag = 1 + pseudo, np.full(nb, 1 / nb)
    post, wrong = np.zeros(f.shape), np.zeros(f.shape[1])
    for _ in range(EM_ROUNDS):
        # the two orders share out the numeric dates; every other format is the only reading of its values
        share = np.where(orders, weight / max(weight[orders].sum(), 1e-300), 1.0)
        like = np.where(may, share[f] * lag[b], 0.0)
        likelier = np.where(share[f[0]] >= share[f[1]], 0, 1) * (f[1] >= 0) * (f[0] >= 0) + (f[0] < 0)
        at = np.arange(f.shape[1])
        wrong = np.where(orders[f[likelier, at]], ERROR * lag[b[likelier, at]], 0.0)
        total = like.sum(0) + wrong
        post, wrong = np.divide(like, total, out=np.zeros_like(like), where=total > 0), wrong / np.maximum(total, 1e-300)
        soft = post * n
        weight = np.bincount(f[may], soft[may], minlength=len(names)) + pseudo
        lag = np.bincount(b[may], soft[may], minlength=nb) + 0.5
        lag = lag / lag.sum()
    post[:, wrong > post.max(0)] = 0.0  # more likely a slip of the pen than any order the source writes
    post = np.divide(post, post.sum(0), out=np.zeros_like(post), where=post.sum(0) > 0)
    weight = weight / weight.sum()
    both = (pdf["fmt_a"].notna() & pdf["fmt_b"].notna()).to_numpy()
    out = pdf[["source_key", "fmt_a", "bin_a", "fmt_b", "bin_b", "n"]].copy()
    out["post_a"] = post[0]
    out["post_b"] = post[1]
    out["both"] = both
    out["weight_a"] = [weight[i] if i >= 0 else None for i in f[0]]
    out["weight_b"] = [weight[i] if i >= 0 else None for i in f[1]]
    return out


_FIT_SCHEMA = "source_key string, fmt_a string, bin_a int, fmt_b string, bin_b int, n bigint, post_a double, post_b double, both boolean, weight_a double, weight_b double"


def with_sites(values: DataFrame, sites: DataFrame) -> DataFrame:
    """Adds tz, date_order and source_key of the row's site; unknown sites share one key."""
    rows = small_rows(sites.select("site_id", "tz", F.lower("date_order").alias("date_order")).filter("site_id is not null").dropDuplicates(["site_id"]), MAX_SITES, "sites")
    known = values.sparkSession.createDataFrame([(*r, zone_table(r.tz)) for r in rows] or [(None, None, None, {})], "site_id int, tz string, date_order string, zones map<string,int>")
    usual = F.create_map(*[x for k, v in ZONES.items() for x in (F.lit(k), F.lit(v))])
    out = values.join(F.broadcast(known.withColumnRenamed("site_id", "known_site")), F.col("site_id") == F.col("known_site"), "left")
    return out.withColumn("source_key", F.coalesce(F.col("known_site").cast("string"), F.lit("?"))).withColumn("zones", F.coalesce("zones", usual)).drop("known_site")


def fit_formats(parsed: DataFrame) -> DataFrame:
    """The mixture of each source: one row per (source, candidate formats, lag bins) with posteriors."""
    order = F.coalesce("date_order", F.lit("?")).alias("date_order")
    counted = parsed.groupBy("source_key", order, "fmt_a", "bin_a", "fmt_b", "bin_b").agg(F.count("*").alias("n"))
    return counted.groupBy("source_key").applyInPandas(_fit, _FIT_SCHEMA)


def parse_values(values: DataFrame, sites: DataFrame) -> DataFrame:
    """Every value with its candidate readings, written to the checkpoint folder."""
    parsed = parse_candidates(with_sites(values, sites))
    parsed = parsed.drop("zones").withColumn("bin_a", F.when(F.col("fmt_a").isNotNull(), _lag(F.col("day_a"), F.col("loaded_at")))).withColumn("bin_b", F.when(F.col("fmt_b").isNotNull(), _lag(F.col("day_b"), F.col("loaded_at"))))
    return cut_lineage(parsed.drop("site_id", "loaded_at"))


def normalise_times(values: DataFrame, sites: DataFrame) -> DataFrame:
    """One unambiguous form per value.

    values: item_table, row_id, raw, site_id, loaded_at. Result, one row per input row: item_table, row_id, raw, norm, precision
    (instant, date, month, year), fmt, posterior, status. norm of an instant is UTC with microseconds; seconds not given
    are 0, further fraction digits are cut. Without a zone the site's zone holds: a local time that occurs twice is the
    first, one skipped moves forward by the gap. status: 'ok'; 'ambiguous' (the posterior stays below DECIDED; the likelier
    reading is still given, equal ones as month first). Where more than ERROR of a source's rows contradict its declared order, they win over it; 'unreadable' (null, no year, no such day or time, unknown zone, a
    time without any zone; norm is null).
    """
    parsed = parse_values(values, sites)
    fit = fit_formats(parsed).select(*(F.col(c).alias(f"m_{c}") for c in ("source_key", "fmt_a", "bin_a", "fmt_b", "bin_b")), "post_a", "post_b")
    on = F.col("source_key") == F.col("m_source_key")
    for c in ("fmt_a", "bin_a", "fmt_b", "bin_b"):
        on = on & F.col(c).eqNullSafe(F.col(f"m_{c}"))
    got = parsed.join(broadcast_if_small(fit, MAX_FIT), on, "left")
    use_a = F.coalesce(F.col("post_a"), F.lit(0.0)) >= F.coalesce(F.col("post_b"), F.lit(0.0))
    post = F.greatest(F.coalesce("post_a", F.lit(0.0)), F.coalesce("post_b", F.lit(0.0)))
    day = F.when(post > 0, F.when(use_a, F.col("day_a")).otherwise(F.col("day_b")))
    wall = F.unix_date(day).cast("bigint") * DAY_US + F.col("clock_us")
    utc = F.when(F.col("zone_min").isNotNull(), wall - F.col("zone_min").cast("bigint") * 60_000_000).otherwise(F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall), F.col("tz"))))
    us = F.coalesce(F.when(post > 0, F.col("epoch_us")), utc)
    text = day.cast("string")
    norm = F.when(F.col("precision") == "instant", micros_text(us)).when(F.col("precision") == "month", F.substring(text, 1, 7)).when(F.col("precision") == "year", F.substring(text, 1, 4)).otherwise(text)
    out = got.select("item_table", "row_id", "raw", norm.alias("norm"), "precision", F.when(post > 0, F.when(use_a, F.col("fmt_a")).otherwise(F.col("fmt_b"))).alias("fmt"), post.alias("posterior"))
    status = F.when(F.col("norm").isNull(), "unreadable").when(F.col("posterior") < DECIDED, "ambiguous").otherwise("ok")
    return out.withColumn("status", status)
