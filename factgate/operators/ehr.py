"""Structured records: cohorts, facts from charts, growth of knowledge by admission, train/test coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgate.operators.claims import first_of
from factgate.operators.timestamps import normalise_times
from factgate.session import cut_lineage
from factgate.tables import broadcast_if_small

#: Code titles of at most so many rows are broadcast.
MAX_TITLES = 1_000_000


def icd_group(code: Column) -> Column:
    """The three-digit ICD-9 group as a number, null for V, E and unreadable codes."""
    return F.substring(F.trim(code), 1, 3).try_cast("int")


def cohort_by_range(diagnoses: DataFrame, low: int, high: int) -> DataFrame:
    """Subjects with a code whose group lies in [low, high]."""
    return diagnoses.filter(icd_group(F.col("icd9_code")).between(low, high)).select("subject_id").filter("subject_id is not null").distinct()


def neoplasm_codes(code: Column, version: Column | None = None, groups: tuple[int, ...] = (), prefixes: tuple[str, ...] = ()) -> Column:
    """Whether a code means a chosen illness: revision 9 by its three-digit group (140 to 208 where none is named), revision 10 by
    its beginning ('C' where none is named). Without a version column all codes are of revision 9."""
    group = icd_group(code)
    nine = group.isin(*groups) if groups else group.between(140, 208)
    if version is None:
        return F.coalesce(nine, F.lit(False))
    ten = F.lit(False)
    for p in prefixes or ("C",):
        ten = ten | F.startswith(F.upper(F.trim(code)), F.lit(p))
    return F.coalesce(((version == 9) & nine) | ((version == 10) & ten), F.lit(False))


def cohort_by_pattern(diagnoses: DataFrame, pattern: str) -> DataFrame:
    return diagnoses.filter(F.col("icd9_code").rlike(pattern)).select("subject_id").filter("subject_id is not null").distinct()


def titles(codes: DataFrame) -> DataFrame:
    """One title per code: that of its first loaded row."""
    return codes.filter("icd9_code is not null").groupBy("icd9_code").agg(F.min_by("long_title", F.struct("loaded_at", "long_title")).alias("long_title"))


def chart_facts(diagnoses: DataFrame, prescriptions: DataFrame, admissions: DataFrame, codes: DataFrame) -> DataFrame:
    """Facts of the chart: subject_id, entity, attribute, value, kind, hadm_id; each once a subject.

    A diagnosis is named by its code's title, or the code itself if it has none; prescriptions and admissions follow. The smallest
    hadm_id survives among equal facts. Rows without a subject or a name make no fact.
    """
    named = diagnoses.join(broadcast_if_small(titles(codes), MAX_TITLES), "icd9_code", "left")
    d = named.select("subject_id", F.coalesce("long_title", "icd9_code").alias("entity"), F.lit("has_diagnosis").alias("attribute"), F.col("icd9_code").alias("value"), F.lit("Condition").alias("kind"), "hadm_id")
    p = prescriptions.select("subject_id", F.trim("drug").alias("entity"), F.lit("has_medication").alias("attribute"), F.coalesce("route", F.lit("")).alias("value"), F.lit("MedicationStatement").alias("kind"), "hadm_id")
    a = admissions.select("subject_id", F.concat(F.lit("Admission_"), F.col("hadm_id").cast("string")).alias("entity"), F.lit("admission_type").alias("attribute"), F.coalesce("admission_type", F.lit("")).alias("value"), F.lit("Encounter").alias("kind"), "hadm_id")
    facts = d.unionByName(p).unionByName(a).filter("subject_id is not null and coalesce(entity, '') <> ''")
    return facts.groupBy("subject_id", "entity", "attribute", "value", "kind").agg(F.min("hadm_id").alias("hadm_id"))


def admissions_once(admissions: DataFrame, sites: DataFrame) -> DataFrame:
    """One row per hadm_id, that of the smallest row_id: subject_id, hadm_id, at. `at` is its admission time in the one form of
    `normalise_times`, so text orders as time does; unreadable ones come last."""
    one = first_of(admissions.filter("hadm_id is not null").select("row_id", "subject_id", "hadm_id", "admittime", "site_id", "loaded_at"), [F.col("hadm_id")], [F.col("row_id")])
    raw = one.select(F.lit("admissions").alias("item_table"), F.col("hadm_id").alias("row_id"), F.col("admittime").alias("raw"), "site_id", "loaded_at")
    at = normalise_times(raw, sites).select(F.col("row_id").alias("hadm_id"), F.coalesce("norm", F.lit("9999")).alias("at"))
    return cut_lineage(one.select("hadm_id", "subject_id").join(at, "hadm_id"))


def code_growth(diagnoses: DataFrame, adm: DataFrame) -> DataFrame:
    """New and cumulative distinct codes of a subject by admission, in order of (at, hadm_id). adm: admissions_once.

    A code counts at the admission where it first appears: a partial aggregation finds it, so the window sees one row per admission.
    """
    seen = diagnoses.select("hadm_id", "icd9_code").filter("icd9_code is not null").join(adm, "hadm_id")
    first = seen.groupBy("subject_id", "icd9_code").agg(F.min(F.struct("at", "hadm_id")).alias("f"))
    new = first.groupBy(F.col("f.hadm_id").alias("hadm_id")).agg(F.count("*").alias("n_new"))
    w = Window.partitionBy("subject_id").orderBy("at", "hadm_id")
    df = adm.filter("subject_id is not null").join(new, "hadm_id", "left").withColumn("n_new", F.coalesce("n_new", F.lit(0)))
    return df.select("subject_id", "hadm_id", "n_new", F.sum("n_new").over(w).alias("n_codes"), F.row_number().over(w).alias("nth"))


def growth(by_admission: DataFrame, least: int) -> DataFrame:
    """Subjects with at least `least` admissions: (last - first) / max(first, 1) of the cumulative codes."""
    g = by_admission.groupBy("subject_id").agg(F.count("*").alias("n_admissions"), F.min_by("n_codes", "nth").alias("first_codes"), F.max_by("n_codes", "nth").alias("last_codes"))
    return g.filter(F.col("n_admissions") >= least).withColumn("growth", (F.col("last_codes") - F.col("first_codes")) / F.greatest("first_codes", F.lit(1)))


def row_growth(diagnoses: DataFrame, adm: DataFrame) -> DataFrame:
    """All diagnosis rows over those of the first admission, for subjects with two admissions or more. adm: admissions_once."""
    adm = adm.filter("subject_id is not null")
    firsts = adm.groupBy("subject_id").agg(F.count("*").alias("n_admissions"), F.min_by("hadm_id", F.struct("at", "hadm_id")).alias("first_hadm"))
    rows = diagnoses.select("hadm_id").join(adm.select("hadm_id", "subject_id"), "hadm_id").join(firsts, "subject_id")
    g = rows.groupBy("subject_id", "n_admissions").agg(F.count("*").alias("n_rows"), F.count_if(F.col("hadm_id") == F.col("first_hadm")).alias("n_first"))
    return g.filter("n_admissions >= 2").withColumn("growth", F.col("n_rows") / F.greatest("n_first", F.lit(1)))


def code_coverage(diagnoses: DataFrame, is_train: Column) -> DataFrame:
    """Distinct codes of the training and the test side, and those they share."""
    sides = diagnoses.filter("icd9_code is not null and subject_id is not null").groupBy("icd9_code").agg(F.bool_or(is_train).alias("train"), F.bool_or(~is_train).alias("test"))
    c = sides.agg(F.count_if("train").alias("n_train"), F.count_if("test").alias("n_test"), F.count_if(F.col("train") & F.col("test")).alias("n_shared"))
    return c.withColumn("coverage", F.col("n_shared") / F.greatest("n_test", F.lit(1)))


def head_of_each(df: DataFrame, group: str, order: list[str], k: int) -> DataFrame:
    """At most k rows of each group in the stated order. The row-number filter becomes a map-side top-k a group."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= k)
