"""Queries over the structured tables (S, P, J, A, W, O, U, G families)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgate.operators import ehr
from factgate.plans.prep import TIMES_SQL
from factgate.tables import broadcast_if_small
from factgate.tables import table as t

LOW, HIGH = 140, 239
_TRAIN = "pmod(subject_id, 10) < 7"


def sel02_range_cohort(s: SparkSession, d: str) -> DataFrame:
    return ehr.cohort_by_range(t(s, d, "diagnoses_icd"), LOW, HIGH)


def sel03_pattern_cohort(s: SparkSession, d: str) -> DataFrame:
    return ehr.cohort_by_pattern(t(s, d, "diagnoses_icd"), r"^\s*(1[4-9]\d|2[0-3]\d)")


def j01_cohort_notes(s: SparkSession, d: str) -> DataFrame:
    c = sel02_range_cohort(s, d)
    return t(s, d, "notes_all").select("row_id", "note_id", "subject_id", "category").join(c, "subject_id")


def j02_cohort_labs(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "labevents").select("row_id", "subject_id", "itemid").join(sel02_range_cohort(s, d), "subject_id", "left_semi")


def j03_unprocessed_notes(s: SparkSession, d: str) -> DataFrame:
    """Notes of which no model proposed a claim yet (resume by anti-join; also S-15)."""
    done = t(s, d, "triples").filter("source <> 'ehr' and note_id is not null").select("note_id")
    return t(s, d, "notes_all").select("note_id").filter("note_id is not null").distinct().join(done, "note_id", "left_anti")


def j04_titles_default(s: SparkSession, d: str) -> DataFrame:
    names = ehr.titles(t(s, d, "d_icd_diagnoses"))
    return t(s, d, "diagnoses_icd").select("row_id", "icd9_code").join(broadcast_if_small(names, ehr.MAX_TITLES), "icd9_code", "left").select("row_id", F.coalesce("long_title", "icd9_code").alias("title"))


def j05_titles_only(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "diagnoses_icd").select("row_id", "hadm_id", "icd9_code").join(broadcast_if_small(ehr.titles(t(s, d, "d_icd_diagnoses")), ehr.MAX_TITLES), "icd9_code")


def g11_chart_facts(s: SparkSession, d: str) -> DataFrame:
    return ehr.chart_facts(t(s, d, "diagnoses_icd"), t(s, d, "prescriptions"), t(s, d, "admissions"), t(s, d, "d_icd_diagnoses"))


def g12_cohort_graph(s: SparkSession, d: str) -> DataFrame:
    """Facts of the cohort's charts by kind (A-20)."""
    return g11_chart_facts(s, d).join(sel02_range_cohort(s, d), "subject_id", "left_semi").groupBy("kind").agg(F.count("*").alias("n_facts"), F.countDistinct("subject_id").alias("n_subjects"), F.countDistinct("entity").alias("n_entities"))


def _admissions(s: SparkSession, d: str) -> DataFrame:
    return ehr.admissions_once(t(s, d, "admissions"), t(s, d, "sites"))


def w01_code_growth(s: SparkSession, d: str) -> DataFrame:
    return ehr.code_growth(t(s, d, "diagnoses_icd"), _admissions(s, d))


def w02_growth(s: SparkSession, d: str) -> DataFrame:
    return ehr.growth(w01_code_growth(s, d), 2).select("subject_id", "n_admissions", "first_codes", "last_codes", F.round("growth", 6).alias("growth"))


def w03_row_growth(s: SparkSession, d: str) -> DataFrame:
    return ehr.row_growth(t(s, d, "diagnoses_icd"), _admissions(s, d)).select("subject_id", "n_admissions", "n_rows", "n_first", F.round("growth", 6).alias("growth"))


def g13_longitudinal(s: SparkSession, d: str) -> DataFrame:
    """Statistics over subjects with three admissions or more (A-14)."""
    return ehr.growth(w01_code_growth(s, d), 3).agg(F.count("*").alias("n_subjects"), F.round(F.avg("last_codes"), 4).alias("mean_codes"), F.round(F.median("last_codes"), 4).alias("median_codes"), F.round(F.avg("growth"), 4).alias("mean_growth"), F.round(F.stddev_pop("growth"), 4).alias("sd_growth"))


def g14_split_coverage(s: SparkSession, d: str) -> DataFrame:
    """Codes of training and test subjects and their overlap, subjects of several admissions and how their rows grow (A-15, W-03, U-06, J-17, P-10)."""
    c = ehr.code_coverage(t(s, d, "diagnoses_icd"), F.expr(_TRAIN)).withColumn("coverage", F.round("coverage", 6))
    g = ehr.row_growth(t(s, d, "diagnoses_icd"), _admissions(s, d)).agg(F.count("*").alias("n_multi"), F.round(F.avg("growth"), 4).alias("mean_growth"), F.round(F.stddev_pop("growth"), 4).alias("sd_growth"))
    return c.select("*", *(g.select(x).scalar().alias(x) for x in g.columns))


def sel02_neoplasms(s: SparkSession, d: str) -> DataFrame:
    """The cohort of neoplasm codes of both revisions; codes that begin with a letter are read as revision 10 (P-02, S-08)."""
    code = F.col("icd9_code")
    version = F.when(F.trim(code).rlike("^[A-Za-z]"), 10).otherwise(9)
    return t(s, d, "diagnoses_icd").filter(ehr.neoplasm_codes(code, version)).select("subject_id").filter("subject_id is not null").distinct()


def u06_shared_codes(s: SparkSession, d: str) -> DataFrame:
    x = t(s, d, "diagnoses_icd").filter("icd9_code is not null and subject_id is not null")
    return x.filter(_TRAIN).select("icd9_code").intersect(x.filter(f"not ({_TRAIN})").select("icd9_code"))


def a13_table_stats(s: SparkSession, d: str) -> DataFrame:
    x = t(s, d, "diagnoses_icd")
    return x.agg(F.count("*").alias("n_rows"), F.countDistinct("icd9_code").alias("n_codes"), F.countDistinct("subject_id").alias("n_subjects"), F.countDistinct("hadm_id").alias("n_admissions"))


def a13_admission_types(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "admissions").groupBy(F.coalesce("admission_type", F.lit("")).alias("admission_type")).agg(F.count("*").alias("n"))


def w10_heads(s: SparkSession, d: str) -> DataFrame:
    """The first twenty lab rows of each admission, the feature of a bounded preview."""
    x = t(s, d, "labevents").filter("hadm_id is not null").select("row_id", "hadm_id", "itemid", "charttime")
    return ehr.head_of_each(x, "hadm_id", ["charttime", "row_id"], 20).select("hadm_id", "row_id", "nth")


def w11_admission_order(s: SparkSession, d: str) -> DataFrame:
    return w01_code_growth(s, d).select("subject_id", "hadm_id", "nth")


def o07_first_subjects(s: SparkSession, d: str) -> DataFrame:
    """The hundred smallest subject numbers: a top-k, sorted before it is cut."""
    return t(s, d, "admissions").select("subject_id").filter("subject_id is not null").distinct().orderBy("subject_id").limit(100)


def o08_systematic(s: SparkSession, d: str) -> DataFrame:
    """Every tenth note by id, by global rank. Ranks come from per-range counts, not from one sorted task."""
    from factgate.operators.calibrate import global_rank

    ids = t(s, d, "notes_all").select("note_id").filter("note_id is not null").distinct()
    return global_rank(ids, ["note_id"]).filter("(rank - 1) % 10 = 0").select("note_id")


QUERIES = {f.__name__: f for f in (sel02_range_cohort, sel02_neoplasms, sel03_pattern_cohort, j01_cohort_notes, j02_cohort_labs, j03_unprocessed_notes, j04_titles_default, j05_titles_only, g11_chart_facts, g12_cohort_graph, w01_code_growth, w02_growth, w03_row_growth, g13_longitudinal, g14_split_coverage, u06_shared_codes, a13_table_stats, a13_admission_types, w10_heads, w11_admission_order, o07_first_subjects, o08_systematic)}

_COHORT = f"SELECT DISTINCT subject_id FROM diagnoses_icd WHERE subject_id IS NOT NULL AND try_cast(substr(trim(icd9_code), 1, 3) AS INT) BETWEEN {LOW} AND {HIGH} AND regexp_matches(substr(trim(icd9_code), 1, 3), '^[0-9]+$')"
_TITLES = "SELECT icd9_code, arg_min(long_title, (loaded_at, long_title)) AS long_title FROM d_icd_diagnoses WHERE icd9_code IS NOT NULL GROUP BY 1"
_FACTS = f"""
SELECT subject_id, entity, attribute, value, kind, min(hadm_id) AS hadm_id FROM (
  SELECT subject_id, coalesce(long_title, d.icd9_code) AS entity, 'has_diagnosis' AS attribute, d.icd9_code AS value, 'Condition' AS kind, hadm_id FROM diagnoses_icd d LEFT JOIN ({_TITLES}) c ON c.icd9_code = d.icd9_code
  UNION ALL SELECT subject_id, trim(drug), 'has_medication', coalesce(route, ''), 'MedicationStatement', hadm_id FROM prescriptions
  UNION ALL SELECT subject_id, 'Admission_' || hadm_id, 'admission_type', coalesce(admission_type, ''), 'Encounter', hadm_id FROM admissions)
WHERE subject_id IS NOT NULL AND coalesce(entity, '') <> '' GROUP BY ALL"""
_ADM = f"""one AS (SELECT hadm_id, arg_min(coalesce(subject_id, -1), row_id) AS sid, min(row_id) AS row_id FROM admissions WHERE hadm_id IS NOT NULL GROUP BY 1), {TIMES_SQL},
adm AS (SELECT hadm_id, nullif(sid, -1) AS subject_id, coalesce(norm, '9999') AS at_ FROM one LEFT JOIN (SELECT row_id, norm FROM times WHERE item_table = 'admissions') USING (row_id))"""
_GROWTH = f"""
{_ADM},
first_ AS (SELECT a.subject_id, icd9_code, min((at_, a.hadm_id)) AS f FROM diagnoses_icd d JOIN adm a ON a.hadm_id = d.hadm_id WHERE icd9_code IS NOT NULL GROUP BY ALL),
new_ AS (SELECT f[2] AS hadm_id, count(*) AS n FROM first_ GROUP BY 1),
g AS (SELECT subject_id, adm.hadm_id, coalesce(n, 0) AS n_new, sum(coalesce(n, 0)) OVER w AS n_codes, row_number() OVER w AS nth
  FROM adm LEFT JOIN new_ ON new_.hadm_id = adm.hadm_id WHERE subject_id IS NOT NULL WINDOW w AS (PARTITION BY subject_id ORDER BY at_, adm.hadm_id)),
h AS (SELECT subject_id, count(*) AS n_admissions, arg_min(n_codes, nth) AS first_codes, arg_max(n_codes, nth) AS last_codes FROM g GROUP BY 1)"""
_TR = "(subject_id % 10) < 7"
ORACLE = {
    "sel02_range_cohort": _COHORT,
    "sel02_neoplasms": "SELECT DISTINCT subject_id FROM diagnoses_icd WHERE subject_id IS NOT NULL AND CASE WHEN regexp_matches(trim(icd9_code), '^[A-Za-z]') THEN starts_with(upper(trim(icd9_code)), 'C') ELSE try_cast(substr(trim(icd9_code), 1, 3) AS INT) BETWEEN 140 AND 208 AND regexp_matches(substr(trim(icd9_code), 1, 3), '^[0-9]+$') END",
    "sel03_pattern_cohort": r"SELECT DISTINCT subject_id FROM diagnoses_icd WHERE subject_id IS NOT NULL AND regexp_matches(icd9_code, '^\s*(1[4-9]\d|2[0-3]\d)')",
    "j01_cohort_notes": f"SELECT row_id, note_id, subject_id, category FROM notes_all WHERE subject_id IN ({_COHORT})",
    "j02_cohort_labs": f"SELECT row_id, subject_id, itemid FROM labevents WHERE subject_id IN ({_COHORT})",
    "j03_unprocessed_notes": "SELECT DISTINCT note_id FROM notes_all WHERE note_id IS NOT NULL AND note_id NOT IN (SELECT note_id FROM triples WHERE source <> 'ehr' AND note_id IS NOT NULL)",
    "j04_titles_default": f"SELECT row_id, coalesce(long_title, d.icd9_code) AS title FROM diagnoses_icd d LEFT JOIN ({_TITLES}) c ON c.icd9_code = d.icd9_code",
    "j05_titles_only": f"SELECT row_id, hadm_id, d.icd9_code, long_title FROM diagnoses_icd d JOIN ({_TITLES}) c ON c.icd9_code = d.icd9_code",
    "g11_chart_facts": _FACTS,
    "g12_cohort_graph": f"SELECT kind, count(*) AS n_facts, count(DISTINCT subject_id) AS n_subjects, count(DISTINCT entity) AS n_entities FROM ({_FACTS}) WHERE subject_id IN ({_COHORT}) GROUP BY 1",
    "w01_code_growth": f"WITH {_GROWTH} SELECT * FROM g",
    "w02_growth": f"WITH {_GROWTH} SELECT *, round((last_codes - first_codes) / greatest(first_codes, 1), 6) AS growth FROM h WHERE n_admissions >= 2",
    "w03_row_growth": f"""WITH {_ADM}, f AS (SELECT subject_id, count(*) AS n_admissions, arg_min(hadm_id, (at_, hadm_id)) AS fh FROM adm WHERE subject_id IS NOT NULL GROUP BY 1)
SELECT subject_id, n_admissions, count(*) AS n_rows, count(*) FILTER (WHERE d.hadm_id = fh) AS n_first, round(count(*) / greatest(count(*) FILTER (WHERE d.hadm_id = fh), 1), 6) AS growth
FROM diagnoses_icd d JOIN adm USING (hadm_id) JOIN f ON f.subject_id = adm.subject_id WHERE n_admissions >= 2 GROUP BY ALL""".replace("SELECT subject_id, n_admissions, count(*) AS n_rows", "SELECT f.subject_id, n_admissions, count(*) AS n_rows"),
    "g13_longitudinal": f"WITH {_GROWTH} SELECT count(*) AS n_subjects, round(avg(last_codes), 4) AS mean_codes, round(median(last_codes), 4) AS median_codes, round(avg((last_codes - first_codes) / greatest(first_codes, 1)), 4) AS mean_growth, round(stddev_pop((last_codes - first_codes) / greatest(first_codes, 1)), 4) AS sd_growth FROM h WHERE n_admissions >= 3",
    "g14_split_coverage": f"WITH {_ADM}, fa AS (SELECT subject_id, count(*) AS k, arg_min(hadm_id, (at_, hadm_id)) AS fh FROM adm WHERE subject_id IS NOT NULL GROUP BY 1), rg AS (SELECT fa.subject_id, count(*) / greatest(count(*) FILTER (WHERE d.hadm_id = fh), 1) AS g FROM diagnoses_icd d JOIN adm USING (hadm_id) JOIN fa ON fa.subject_id = adm.subject_id WHERE k >= 2 GROUP BY 1), s AS (SELECT icd9_code, bool_or({_TR}) AS a, bool_or(NOT {_TR}) AS b FROM diagnoses_icd WHERE icd9_code IS NOT NULL AND subject_id IS NOT NULL GROUP BY 1) SELECT count(*) FILTER (WHERE a) AS n_train, count(*) FILTER (WHERE b) AS n_test, count(*) FILTER (WHERE a AND b) AS n_shared, round(count(*) FILTER (WHERE a AND b) / greatest(count(*) FILTER (WHERE b), 1), 6) AS coverage, (SELECT count(*) FROM rg) AS n_multi, (SELECT round(avg(g), 4) FROM rg) AS mean_growth, (SELECT round(stddev_pop(g), 4) FROM rg) AS sd_growth FROM s",
    "u06_shared_codes": f"SELECT icd9_code FROM diagnoses_icd WHERE icd9_code IS NOT NULL AND subject_id IS NOT NULL AND {_TR} INTERSECT SELECT icd9_code FROM diagnoses_icd WHERE icd9_code IS NOT NULL AND subject_id IS NOT NULL AND NOT {_TR}",
    "a13_table_stats": "SELECT count(*) AS n_rows, count(DISTINCT icd9_code) AS n_codes, count(DISTINCT subject_id) AS n_subjects, count(DISTINCT hadm_id) AS n_admissions FROM diagnoses_icd",
    "a13_admission_types": "SELECT coalesce(admission_type, '') AS admission_type, count(*) AS n FROM admissions GROUP BY 1",
    "w10_heads": "SELECT hadm_id, row_id, nth FROM (SELECT hadm_id, row_id, row_number() OVER (PARTITION BY hadm_id ORDER BY charttime NULLS FIRST, row_id) AS nth FROM labevents WHERE hadm_id IS NOT NULL) WHERE nth <= 20",
    "w11_admission_order": f"WITH {_GROWTH} SELECT subject_id, hadm_id, nth FROM g",
    "o07_first_subjects": "SELECT DISTINCT subject_id FROM admissions WHERE subject_id IS NOT NULL ORDER BY 1 LIMIT 100",
    "o08_systematic": "SELECT note_id FROM (SELECT note_id, row_number() OVER (ORDER BY note_id) AS r FROM (SELECT DISTINCT note_id FROM notes_all WHERE note_id IS NOT NULL)) WHERE (r - 1) % 10 = 0",
}
