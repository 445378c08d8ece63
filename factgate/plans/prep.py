"""Data-preparation queries of the core: wide tables (p1), timestamps (p5), orphan references (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgate.operators.orphans import code_key, orphan_references, orphan_report
from factgate.operators.timestamps import REGION_ZONES, ZONES, fit_formats, normalise_times, parse_values
from factgate.operators.wide import to_wide, wide_issues
from factgate.tables import table


def p1_wide(spark: SparkSession, sf: str) -> DataFrame:
    ehr = table(spark, sf, "triples").filter("source = 'ehr'").select("entity", "attribute", "value")
    return to_wide(ehr, table(spark, sf, "attribute_catalog")).drop("issues", "others")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    ehr = table(spark, sf, "triples").filter("source = 'ehr'").select("entity", "attribute", "value")
    return wide_issues(to_wide(ehr, table(spark, sf, "attribute_catalog")))


def _times(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "admissions").select(F.lit("admissions").alias("item_table"), "row_id", F.col("admittime").alias("raw"), "site_id", "loaded_at")
    t = table(spark, sf, "triples").select(F.lit("triples").alias("item_table"), F.col("triple_id").alias("row_id"), F.col("temporal_start").alias("raw"), "site_id", "loaded_at")
    return a.unionByName(t).filter("raw is not null")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return normalise_times(_times(spark, sf), table(spark, sf, "sites")).filter("norm is not null").select("item_table", "row_id", "norm")


def p5_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """What EM makes of each site's day/month order when no order is declared: rows that either order could read."""
    undeclared = table(spark, sf, "sites").withColumn("date_order", F.lit(None).cast("string"))
    fit = fit_formats(parse_values(_times(spark, sf), undeclared)).filter("both")
    w = F.sum(F.col("n"))
    return fit.groupBy("source_key").agg(w.alias("n_both"), F.round(F.sum(F.col("n") * F.col("post_a")) / w, 4).alias("mdy_share"), F.round(F.max("weight_a"), 4).alias("mdy_weight"), F.round(F.max("weight_b"), 4).alias("dmy_weight"))


def _p6_parts(spark: SparkSession, sf: str) -> list[tuple[str, str, DataFrame]]:
    diag, labs, adm = (table(spark, sf, n) for n in ("diagnoses_icd", "labevents", "admissions"))
    icd, items = table(spark, sf, "d_icd_diagnoses"), table(spark, sf, "d_labitems")

    def child(df: DataFrame, key) -> DataFrame:
        return df.select("row_id", key.alias("key"), "loaded_at")

    def parent(df: DataFrame, key) -> DataFrame:
        return df.select(key.alias("key"), "loaded_at", "deleted_at")

    return [
        ("diagnoses_icd", "icd9_code", orphan_references(child(diag, code_key(F.col("icd9_code"))), parent(icd, code_key(F.col("icd9_code"))))),
        ("diagnoses_icd", "hadm_id", orphan_references(child(diag, F.col("hadm_id")), parent(adm, F.col("hadm_id")))),
        ("labevents", "itemid", orphan_references(child(labs, F.col("itemid")), parent(items, F.col("itemid")))),
    ]


def _p6_all(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for t, f, df in _p6_parts(spark, sf):
        df = df.select(F.lit(t).alias("child_table"), F.lit(f).alias("ref_field"), "row_id", "status", "loaded_at")
        out = df if out is None else out.unionByName(df)
    return out


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _p6_all(spark, sf).drop("loaded_at")


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_report(_p6_all(spark, sf))


QUERIES = {"p1_found": p1_found, "p1_wide": p1_wide, "p5_found": p5_found, "p5_mixture": p5_mixture, "p6_found": p6_found, "p6_report": p6_report}

_TRIM = r"regexp_replace({0}, '^[\s\x0B\x1C-\x1F\x{{85}}\pZ]+|[\s\x0B\x1C-\x1F\x{{85}}\pZ]+$', '', 'g')"


def _trim(c: str) -> str:
    return _TRIM.format(c)


_NAME = r"lower(regexp_replace({0}, '[-\s\x0B\x1C-\x1F\x{{85}}\pZ]', '_', 'g'))"
_NUM = r"^[+-]?(\d{1,3}(,\d{3})+|\d+)(\.\d+)?([eE][+-]?\d+)?"
_MON = "january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec"

_P1_CELLS = rf"""
WITH cat AS (
  SELECT {_NAME.format(_trim('attribute'))} AS attribute, value_type AS kind, lower(coalesce(unit_name, '')) AS unit FROM attribute_catalog),
rows_ AS (
  SELECT {_NAME.format(_trim('entity'))} AS entity, {_NAME.format(_trim('attribute'))} AS attribute, {_trim('value')} AS v
  FROM triples WHERE source = 'ehr'),
typed AS (
  SELECT entity, attribute, kind, v, lower(v) AS low, (v IS NOT NULL AND lower(v) NOT IN ('', 'null', 'none', 'n/a')) AS has,
         regexp_extract(v, '{_NUM}', 0) AS head, unit
  FROM rows_ JOIN cat USING (attribute) WHERE entity <> ''),
nums AS (
  SELECT *, CASE WHEN head <> '' AND lower({_trim('substr(v, length(head) + 1)')}) IN ('', unit) THEN replace(head, ',', '') END AS plain FROM typed),
parsed AS (
  SELECT entity, attribute, kind, v, has,
    CASE WHEN has AND kind = 'int' AND TRY_CAST(plain AS DOUBLE) = floor(TRY_CAST(plain AS DOUBLE)) THEN CAST(TRY_CAST(plain AS DOUBLE) AS BIGINT)
         WHEN has AND kind = 'boolean' AND low IN ('true', 't', 'yes', 'y', '1') THEN 1
         WHEN has AND kind = 'boolean' AND low IN ('false', 'f', 'no', 'n', '0') THEN 0 END AS l,
    CASE WHEN has AND kind = 'float' THEN TRY_CAST(plain AS DOUBLE) END AS d,
    CASE WHEN has AND kind = 'string' THEN lower(regexp_replace(v, '[\s\x0B\x1C-\x1F\x{{85}}\pZ]+', ' ', 'g')) END AS s,
    CASE WHEN has AND kind = 'date' THEN CASE
      WHEN regexp_matches(v, '^(\d{{4}}-\d{{1,2}}-\d{{1,2}}|\d{{4}}/\d{{1,2}}/\d{{1,2}})$') THEN TRY_CAST(replace(v, '/', '-') AS DATE)
      WHEN regexp_matches(v, '^\d{{1,2}}/\d{{1,2}}/\d{{4}}$') THEN TRY_CAST(regexp_replace(v, '^(\d+)/(\d+)/(\d+)$', '\3-\1-\2') AS DATE)
      WHEN regexp_matches(low, '^\d{{1,2}}[\s\pZ,.-]+({_MON})[\s\pZ,.-]+\d{{4}}$')
        THEN TRY_CAST(regexp_replace(low, '^(\d+)[\s\pZ,.-]+([a-z]{{3}})[a-z]*[\s\pZ,.-]+(\d+)$', '\3-') || CAST((instr('janfebmaraprmayjunjulaugsepoctnovdec', regexp_extract(low, '[a-z]{{3}}', 0)) + 2) // 3 AS VARCHAR) || '-' || regexp_extract(low, '^\d+', 0) AS DATE)
      WHEN regexp_matches(low, '^({_MON})[\s\pZ,.-]+\d{{1,2}}[\s\pZ,.-]+\d{{4}}$')
        THEN TRY_CAST(regexp_extract(low, '\d{{4}}$', 0) || '-' || CAST((instr('janfebmaraprmayjunjulaugsepoctnovdec', substr(low, 1, 3)) + 2) // 3 AS VARCHAR) || '-' || regexp_extract(low, '\d+', 0) AS DATE)
    END END AS dt
  FROM nums),
cells AS (
  SELECT entity, attribute, any_value(kind) AS kind, count(*) FILTER (WHERE has) AS n,
    count(*) FILTER (WHERE l IS NOT NULL OR d IS NOT NULL OR s IS NOT NULL OR dt IS NOT NULL) AS readable,
    min(l) AS l_lo, max(l) AS l_hi, min(d) AS d_lo, max(d) AS d_hi, min(s) AS s_lo, max(s) AS s_hi, min(dt) AS t_lo, max(dt) AS t_hi,
    min(v) FILTER (WHERE s IS NOT NULL) AS s_raw
  FROM parsed GROUP BY ALL),
judged AS (
  SELECT *, CASE WHEN n > 0 AND readable = 0 THEN 'unreadable'
    WHEN coalesce(l_lo < l_hi, false) OR coalesce(d_lo < d_hi, false) OR coalesce(s_lo < s_hi, false) OR coalesce(t_lo < t_hi, false) THEN 'conflict' END AS issue
  FROM cells)
"""

# The attributes of the test catalogue by type, for the wide oracle.
_WIDE = {
    "string": "admission_type insurance specimen_site lesion_site regimen_name",
    "int": "length_of_stay prior_admissions cell_count node_count cycles_given toxicity_grade",
    "float": "weight height tumour_fraction fixation_hours diameter suv_max dose_intensity",
    "boolean": "icu_stay dnr_order margin_clear biopsied dose_reduced",
    "date": "discharge_date collected_on first_seen started_on",
}
_PICK = {"string": "s_raw", "int": "l_lo", "float": "d_lo", "boolean": "CAST(l_lo AS BOOLEAN)", "date": "t_lo"}
_P1_WIDE = (
    _P1_CELLS
    + "SELECT entity, "
    + ", ".join(f"max({_PICK[k]}) FILTER (WHERE attribute = '{a}' AND issue IS NULL) AS {a}" for k, names in _WIDE.items() for a in names.split())
    + " FROM judged GROUP BY entity"
)


def _p6_sql(child: str, field: str, parent: str, key: str) -> str:
    return f"""
  SELECT '{child}' AS child_table, '{field}' AS ref_field, c.row_id, c.loaded_at,
    CASE WHEN p.n IS NULL THEN 'missing' WHEN p.first_ <= c.loaded_at THEN 'deleted' ELSE 'late' END AS status
  FROM (SELECT row_id, {key.format(field)} AS k, loaded_at FROM {child} WHERE {field} IS NOT NULL) c
  LEFT JOIN (SELECT {key.format(field)} AS k, count(*) AS n, min(loaded_at) AS first_ FROM {parent} WHERE {field} IS NOT NULL GROUP BY 1) p ON p.k = c.k
  WHERE NOT EXISTS (SELECT 1 FROM {parent} q WHERE {key.format('q.' + field)} = c.k AND q.loaded_at <= c.loaded_at AND (q.deleted_at IS NULL OR q.deleted_at > c.loaded_at))"""


_CODE = r"upper(regexp_replace({0}, '[.\s\x0B\x1C-\x1F\x{{85}}\pZ]', '', 'g'))"
_P6 = " UNION ALL ".join(
    [_p6_sql("diagnoses_icd", "icd9_code", "d_icd_diagnoses", _CODE), _p6_sql("diagnoses_icd", "hadm_id", "admissions", "{0}"), _p6_sql("labevents", "itemid", "d_labitems", "{0}")]
)

_ZONES = ", ".join(f"('{z}', {m})" for z, m in ZONES.items())
_REGIONS = ", ".join(f"('{r}', '{z}', {m})" for r, zs in REGION_ZONES.items() for z, m in zs.items())
_TIME = r"^(.*?)(?:[Tt]|\s*,\s*|\s+)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?\s*([AaPp]\.?[Mm]\.?)?\s*([+-]\d{2}:?\d{2}|[+-]\d{2}|[A-Za-z]{1,5})?$"
_DATE_SHAPES = (
    # pattern, kind, and where year, month (or day) and day (or month) stand
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})$", "ymd", "123"), (r"^(\d{4})/(\d{1,2})/(\d{1,2})$", "ymd", "123"), (r"^(\d{4})\.(\d{1,2})\.(\d{1,2})$", "ymd", "123"),
    (r"^(\d{4})(\d{2})(\d{2})$", "ymd", "123"), (r"^(\d{4})[-/.](\d{1,2})$", "month", "12"), (r"^(\d{4})$", "year", "1"),
    (r"^(\d{1,2})-(\d{1,2})-(\d{4}|\d{2})$", "numeric", "312"), (r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})$", "numeric", "312"), (r"^(\d{1,2})\.(\d{1,2})\.(\d{4}|\d{2})$", "numeric", "312"),
    (r"^(\d{1,2})[-/.](\d{4})$", "month", "21"),
    (rf"(?i)^(\d{{1,2}})(?:st|nd|rd|th)?[\s,.-]*({_MON})[\s,.-]*(\d{{4}}|\d{{2}})$", "named", "321"),
    (rf"(?i)^({_MON})[\s.-]*(\d{{1,2}})(?:st|nd|rd|th)?[\s,-]+(\d{{4}})$", "named", "312"), (rf"(?i)^({_MON})[\s,.-]*(\d{{4}})$", "month", "21"),
)


def _part(i: int) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(ds, '{p}') THEN regexp_extract(ds, '{p}', {at[i]})" for p, _, at in _DATE_SHAPES if len(at) > i) + " END"


#: norm of every admittime and temporal_start by the plain rules: the declared order, the site's zone.
TIMES_SQL = rf"""
raw_ AS (
  SELECT 'admissions' AS item_table, row_id, admittime AS raw, site_id FROM admissions UNION ALL SELECT 'triples', triple_id, temporal_start, site_id FROM triples),
t0 AS (SELECT item_table, row_id, tz, coalesce(date_order, 'mdy') AS date_order, {_trim('raw')} AS s FROM raw_ LEFT JOIN sites USING (site_id) WHERE raw IS NOT NULL),
t1 AS (SELECT * REPLACE (regexp_replace(regexp_replace(s, '^(\d{{4}})(\d{{2}})(\d{{2}})[Tt ]?(\d{{2}})(\d{{2}})(\d{{2}})((?:[.,]\d+)?\s*(?:[Zz]|[+-]\d{{2}}:?\d{{2}})?)$', '\1-\2-\3T\4:\5:\6\7'),
  '^(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})([Zz]?)$', '\1-\2-\3T\4:\5\6') AS s) FROM t0),
t2 AS (SELECT *, regexp_matches(s, '{_TIME}') AS timed, regexp_extract(s, '{_TIME}', ['d', 'h', 'mi', 'se', 'fr', 'half', 'zone']) AS x FROM t1),
t3 AS (SELECT *, {_trim("CASE WHEN timed THEN x.d ELSE s END")} AS ds FROM t2),
t4 AS (SELECT *, CASE {" ".join(f"WHEN regexp_matches(ds, '{p}') THEN '{k}'" for p, k, _ in _DATE_SHAPES)} END AS kind, {_part(0)} AS y0, {_part(1)} AS m0, {_part(2)} AS d0 FROM t3),
t5 AS (SELECT *, CASE WHEN length(y0) = 2 THEN '20' || y0 ELSE y0 END AS y, CASE WHEN regexp_matches(m0, '^[A-Za-z]') THEN try_cast((instr('janfebmaraprmayjunjulaugsepoctnovdec', lower(substr(m0, 1, 3))) + 2) // 3 AS VARCHAR) ELSE m0 END AS a FROM t4),
t6 AS (SELECT *, CASE WHEN try_cast(y AS INT) > 0 THEN try_cast(y || '-' || CASE WHEN kind = 'year' THEN '1-1' WHEN kind = 'month' THEN a || '-1' WHEN kind = 'numeric' AND date_order = 'dmy' THEN d0 || '-' || a ELSE a || '-' || d0 END AS DATE) END AS day,
  CASE WHEN x.half = '' THEN try_cast(x.h AS INT) WHEN try_cast(x.h AS INT) BETWEEN 1 AND 12 THEN try_cast(x.h AS INT) % 12 + CASE WHEN lower(x.half[1]) = 'p' THEN 12 ELSE 0 END END AS hh FROM t5),
zs(zone, mins) AS (VALUES {_ZONES}), zr(region, zone, mins) AS (VALUES {_REGIONS}),
t7 AS (SELECT t6.*, CASE WHEN x.zone = '' OR NOT timed THEN NULL WHEN regexp_matches(x.zone, '^[+-]') THEN
    (CASE WHEN x.zone[1] = '-' THEN -1 ELSE 1 END) * (try_cast(regexp_replace(x.zone, '[^0-9]', '', 'g')[1:2] AS INT) * 60 + try_cast('0' || regexp_replace(x.zone, '[^0-9]', '', 'g')[3:4] AS INT))
    ELSE coalesce(zr.mins, zs.mins) END AS mins,
  CASE WHEN hh < 24 AND try_cast(x.mi AS INT) < 60 AND coalesce(try_cast(x.se AS INT), 0) < 60 THEN day + to_hours(hh) + to_minutes(try_cast(x.mi AS INT)) + to_seconds(coalesce(try_cast(x.se AS INT), 0)) + to_microseconds(try_cast(rpad(substr(x.fr, 1, 6), 6, '0') AS INT)) END AS wall
  FROM t6 LEFT JOIN zs ON zs.zone = upper(x.zone) LEFT JOIN zr ON zr.zone = upper(x.zone) AND starts_with(tz, region)),
t8 AS (SELECT *, CASE WHEN x.zone <> '' THEN wall - to_minutes(mins) WHEN timezone(tz, timezone(tz, wall) - INTERVAL 1 HOUR) = wall THEN timezone('UTC', timezone(tz, wall) - INTERVAL 1 HOUR) ELSE timezone('UTC', timezone(tz, wall)) END AS utc FROM t7),
times AS (SELECT item_table, row_id, CASE
  WHEN regexp_matches(s, '^\d{{10}}$') THEN strftime(make_timestamp(try_cast(s AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%S.%fZ') WHEN regexp_matches(s, '^\d{{13}}$') THEN strftime(make_timestamp(try_cast(s AS BIGINT) * 1000), '%Y-%m-%dT%H:%M:%S.%fZ')
  WHEN timed AND kind IN ('ymd', 'numeric', 'named') THEN strftime(utc, '%Y-%m-%dT%H:%M:%S.%fZ') WHEN timed THEN NULL
  WHEN kind = 'year' THEN strftime(day, '%Y') WHEN kind = 'month' THEN strftime(day, '%Y-%m') ELSE strftime(day, '%Y-%m-%d') END AS norm FROM t8)"""

ORACLE = {
    "p5_found": f"WITH {TIMES_SQL} SELECT * FROM times WHERE norm IS NOT NULL",
    "p1_found": _P1_CELLS + "SELECT entity, attribute, issue FROM judged WHERE issue IS NOT NULL",
    "p1_wide": _P1_WIDE,
    "p6_found": f"SELECT child_table, ref_field, row_id, status FROM ({_P6})",
    "p6_report": f"SELECT child_table, ref_field, strftime(loaded_at, '%Y-%m') AS month, status, count(*) AS n_rows FROM ({_P6}) GROUP BY ALL",
}
