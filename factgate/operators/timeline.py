"""Temporal facts: anchoring, timelines, snapshots, changes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgate.functions import mentions as kernels
from factgate.functions.clinical import tidy
from factgate.tables import broadcast_if_small

NEAR = 500
#: Keys looked up at a time by broadcast.
MAX_KEYS = 500_000


def date_form(c: Column) -> Column:
    """Normal form of an explicit anchor, null if it has no absolute date; Arrow-batched."""
    @F.pandas_udf("string")
    def form(s: pd.Series) -> pd.Series:
        return s.map(kernels.date_form, na_action="ignore")

    return form(c)


def near_window(evidence: Column, low: Column) -> Column:
    """Offset of the first window of the text that holds most words of the evidence, -1 for none or a null text; Arrow-batched."""
    @F.pandas_udf("int")
    def at(e: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([-1 if y is None else kernels.near_window(x, y) for x, y in zip(e, t, strict=True)], dtype="int32")

    return at(evidence, low)


def nearest_dates(points: DataFrame, dates: DataFrame, reach: int = NEAR) -> DataFrame:
    """claim_id, form of the absolute date nearest to each point of its note within `reach` characters; ties to the earlier one.

    points: claim_id, note_id, at. Both neighbours of a point come from one sorted pass over the union of points and dates, so a
    note with many dates and claims costs its sort, not their product.
    """
    d = dates.filter("kind = 'absolute'").select("note_id", F.col("start").alias("at"), F.struct("start", "form").alias("d"), F.lit(None).cast("bigint").alias("claim_id"))
    p = points.select("note_id", "at", F.lit(None).cast(d.schema["d"].dataType).alias("d"), "claim_id")
    both = d.unionByName(p)
    base = Window.partitionBy("note_id").orderBy("at", F.asc_nulls_first("claim_id"), "d.form")
    back, ahead = base.rowsBetween(Window.unboundedPreceding, 0), base.rowsBetween(0, Window.unboundedFollowing)
    near = both.withColumns({"b": F.last("d", ignorenulls=True).over(back), "a": F.first("d", ignorenulls=True).over(ahead)}).filter("claim_id is not null")
    gap_b, gap_a = F.col("at") - F.col("b.start"), F.col("a.start") - F.col("at")
    take_b = F.col("b").isNotNull() & (F.col("a").isNull() | (gap_b <= gap_a))
    return near.withColumn("form", F.when(take_b & (gap_b <= reach), F.col("b.form")).when(~take_b & (gap_a <= reach), F.col("a.form"))).filter("form is not null").select("claim_id", "form")


def anchored(claims: DataFrame, notes: DataFrame, dates: DataFrame) -> DataFrame:
    """Adds date_form and date_kind (explicit, inferred_proximity, none).

    A claim's own anchor counts first; else the date nearest to where the first 50 characters of its evidence lie in the note,
    or else (reworded, spaced otherwise) to the first window of 50 characters with 60 % of the words of its first 30.
    Claims of notes without any date keep nulls in both columns.
    """
    dated = dates.select(F.col("note_id").alias("d_note")).distinct()
    explicit = F.when(~F.lower(F.coalesce("anchor", F.lit(""))).isin("", "null", "none"), F.coalesce(date_form(F.col("anchor")), F.col("anchor")))
    df = claims.withColumn("explicit", explicit).join(dated, F.col("note_id") == F.col("d_note"), "left")
    text = notes.select(F.col("note_id").alias("t_note"), F.lower("text").alias("low"))
    look = df.filter("explicit is null and d_note is not null and coalesce(evidence, '') <> ''").join(text, F.col("note_id") == F.col("t_note"))
    points = look.select("claim_id", "note_id", "evidence", "low", (F.position(F.lower(F.left("evidence", F.lit(50))), F.col("low")) - 1).alias("exact"))
    missed = F.when(F.col("exact") < 0, F.col("low"))  # only texts in which the evidence was not found go to Python
    points = points.withColumn("window", near_window(F.col("evidence"), missed)).select("claim_id", "note_id", F.greatest("exact", "window").alias("at")).filter("at >= 0")
    near = nearest_dates(points, dates).select(F.col("claim_id").alias("n_claim"), F.col("form").alias("near"))
    out = df.join(near, F.col("claim_id") == F.col("n_claim"), "left")
    known = F.col("d_note").isNotNull()
    return out.withColumns({
        "date_form": F.when(known, F.coalesce("explicit", "near")),
        "date_kind": F.when(known, F.when(F.col("explicit").isNotNull(), "explicit").when(F.col("near").isNotNull(), "inferred_proximity").otherwise("none")),
    }).drop("explicit", "d_note", "n_claim", "near")


def timeline(claims: DataFrame) -> DataFrame:
    """Facts and entities per patient and date, the undated together."""
    return claims.groupBy("patient_id", F.coalesce("date_form", F.lit("undated")).alias("day")).agg(F.count("*").alias("n_facts"), F.countDistinct(tidy(F.col("entity"))).alias("n_entities"))


def time_metrics(claims: DataFrame) -> DataFrame:
    """Coverage by kind of date, first and last date, facts per date."""
    d = F.col("date_form")
    full = F.when(d.rlike(r"^\d{4}-\d\d"), d)
    return claims.agg(
        F.count("*").alias("n"), F.count_if(F.col("date_kind") == "explicit").alias("n_explicit"), F.count_if(F.col("date_kind") == "inferred_proximity").alias("n_inferred"),
        F.round(F.count(d) / F.greatest(F.count("*"), F.lit(1)), 4).alias("coverage"), F.countDistinct(d).alias("n_dates"), F.min(full).alias("first_day"), F.max(full).alias("last_day"),
        F.round(F.count(d) / F.greatest(F.countDistinct(d), F.lit(1)), 4).alias("per_date"),
    )


def snapshot(relations: DataFrame, at: str) -> DataFrame:
    """Relations valid at a moment: begun (or without beginning) and not ended; strings compare as strings, [start, end)."""
    start, stop = (F.when(~F.lower(F.coalesce(c, F.lit(""))).isin("", "null", "none"), F.col(c)) for c in ("temporal_start", "temporal_end"))
    return relations.filter((start.isNull() | (start <= at)) & (stop.isNull() | (stop > at)))


def about(relations: DataFrame, keys: DataFrame) -> DataFrame:
    """Relations whose subject or object is a key, up to case, in time order: key, nth and the relation. keys: key.

    Strings order as strings, a relation without a start comes last, ties by relation_id; one that has the key on both sides counts once.
    """
    k = keys.select(F.lower("key").alias("key")).distinct()
    ends = relations.withColumn("key", F.explode(F.array_distinct(F.array(F.lower("subject"), F.lower("object")))))
    w = Window.partitionBy("key").orderBy(F.coalesce("temporal_start", F.lit("9999")), "relation_id")
    return ends.join(broadcast_if_small(k, MAX_KEYS), "key", "left_semi").withColumn("nth", F.row_number().over(w))


def changes(relations: DataFrame) -> DataFrame:
    """(subject, predicate) with more than one distinct object: counts, first and last object in time order.

    Relations without a start come last. Only extremes are kept, so a hot subject is combined map-side.
    """
    t = F.struct(F.coalesce("temporal_start", F.lit("9999")).alias("t"), F.col("relation_id"))
    g = relations.groupBy("subject", "predicate").agg(F.count("*").alias("n"), F.countDistinct("object").alias("n_objects"), F.min_by("object", t).alias("first_object"), F.max_by("object", t).alias("last_object"))
    return g.filter("n_objects > 1")


def change_timeline(relations: DataFrame) -> DataFrame:
    """The relations of every (subject, predicate) that changes, in time order: subject, predicate, nth, temporal_start, object.

    Rows instead of a list a group, so a hot subject is sorted with spill and never held whole; missing starts are empty and come first.
    """
    hot = changes(relations).select("subject", "predicate")
    at = F.coalesce("temporal_start", F.lit(""))
    w = Window.partitionBy("subject", "predicate").orderBy(at, "object", "relation_id")
    return relations.join(hot, ["subject", "predicate"], "left_semi").select("subject", "predicate", F.row_number().over(w).alias("nth"), at.alias("temporal_start"), "object")


def relations_of(triples: DataFrame) -> DataFrame:
    """Flat triples as relations between names."""
    return triples.select(F.col("triple_id").alias("relation_id"), F.lower(F.trim("entity")).alias("subject"), F.lower(F.trim("attribute")).alias("predicate"), F.lower(F.trim("value")).alias("object"), F.col("fhir_type").alias("subject_type"), F.lit("Value").alias("object_type"), "temporal_start", "temporal_end", "evidence_span", "note_id").filter("coalesce(subject, '') <> '' and coalesce(object, '') <> ''")
