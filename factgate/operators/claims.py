"""Claims: union of extractors, first-wins deduplication, cleaning with reasons, consensus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgate import vocab
from factgate.functions.clinical import is_phi, is_vacuous, scrub_phi, status_of, tidy, type_a


def first_of(df: DataFrame, key: list[Column], order: list[Column], **of_key: Column) -> DataFrame:
    """The first row of each key, with the aggregates of the key that of_key names. The order must end in a unique column; the
    hash aggregate combines map-side, so a key with a third of all rows sends one row a task."""
    named = [k.alias(f"__k{i}") for i, k in enumerate(key)]
    picked = df.groupBy(*named).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("__row"), *(x.alias(n) for n, x in of_key.items()))
    return picked.select("__row.*", *of_key)


def claims_of(triples: DataFrame) -> DataFrame:
    """Model-proposed triples as claims: claim_id, note_id, model, entity, attribute, value, kind, anchor, evidence."""
    return triples.filter("source <> 'ehr'").select(
        F.col("triple_id").alias("claim_id"), "note_id", F.col("source").alias("model"), "entity", "attribute", "value",
        F.col("fhir_type").alias("kind"), F.col("temporal_start").alias("anchor"), F.col("evidence_span").alias("evidence"),
    )


def claim_key() -> list[Column]:
    return [F.col("note_id"), *(F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in ("entity", "attribute", "value"))]


def union_dedup(claims: DataFrame, **of_key: Column) -> DataFrame:
    """One claim per (note, entity, attribute, value) up to case and outer blanks: the first by model and id survives."""
    return first_of(claims, claim_key(), [F.col("model"), F.col("claim_id")], **of_key)


def consensus(claims: DataFrame) -> DataFrame:
    """How many models propose each canonical claim."""
    keys = [k.alias(n) for k, n in zip(claim_key(), ("note_id", "entity", "attribute", "value"), strict=True)]
    return claims.groupBy(*keys).agg(F.countDistinct("model").alias("n_models"), F.count("*").alias("n_claims"), F.min("claim_id").alias("first_claim"))


def clean(claims: DataFrame) -> DataFrame:
    """Adds drop_reason (null: kept before deduplication) and rewrites entity, value, kind, evidence and anchor.

    In order: a personal identifier in entity or value drops the claim; marks of de-identification are scrubbed; an entity
    that says nothing is recast to Patient for a demographic attribute with a value, else dropped; administrative types are
    dropped unless demographic; a value equal to its entity becomes a status; the type becomes canonical. Nulls are empty.
    """
    e, v, a, k = (F.coalesce(F.col(c), F.lit("")) for c in ("entity", "value", "attribute", "kind"))
    df = claims.withColumns({"phi": is_phi(e) | is_phi(v), "e": scrub_phi(e), "v": scrub_phi(v), "demographic": tidy(a).isin(*vocab.DEMOGRAPHIC)})
    df = df.withColumn("vacuous", is_vacuous(F.col("e"))).withColumn("recast", F.col("vacuous") & F.col("demographic") & (F.col("v") != ""))
    df = df.withColumns({"e": F.when(F.col("recast"), "Patient").otherwise(F.col("e")), "k0": F.when(F.col("recast"), "Patient").otherwise(k)})
    # the administrative test reads the type as it came
    reason = F.when(F.col("phi"), "phi").when(F.col("vacuous") & ~F.col("recast"), "vacuous").when(tidy(k).isin(*vocab.ADMIN_TYPES) & ~F.col("demographic"), "admin")
    df = df.withColumn("drop_reason", reason).withColumn("collapsed", (tidy(F.col("e")) == tidy(F.col("v"))) & (F.col("e") != ""))
    df = df.withColumn("v", F.when(F.col("collapsed"), status_of(a)).otherwise(F.col("v"))).withColumn("canonical", type_a(k, a))
    keep = [c for c in claims.columns if c not in ("entity", "value", "kind", "evidence", "anchor")]
    return df.select(
        *keep, F.col("e").alias("entity"), F.col("v").alias("value"), F.when(F.col("recast"), "Patient").otherwise(F.col("canonical")).alias("kind"),
        F.when(F.col("evidence") != "", scrub_phi(F.col("evidence"))).alias("evidence"), F.when(F.col("anchor") != "", scrub_phi(F.col("anchor"))).alias("anchor"),
        "drop_reason", "recast", "collapsed", (F.col("canonical") != k).alias("retyped"),
    )


def canonical_dedup(cleaned: DataFrame, **of_key: Column) -> DataFrame:
    """Kept claims, one per note and canonical (entity, attribute, value, kind); the first id survives. of_key: aggregates of the key."""
    kept = cleaned.filter("drop_reason is null")
    return first_of(kept, [F.col("note_id"), *(tidy(F.col(c)) for c in ("entity", "attribute", "value")), F.col("kind")], [F.col("claim_id")], **of_key)


def cleaning_report(cleaned: DataFrame) -> DataFrame:
    """One row of counters of what cleaning did."""
    kept = F.col("drop_reason").isNull()
    key = F.struct(F.col("note_id"), *(tidy(F.col(c)).alias(c) for c in ("entity", "attribute", "value")), F.col("kind"))
    one = cleaned.agg(
        F.count("*").alias("n_input"), *(F.count_if(F.col("drop_reason") == r).alias(f"n_{r}") for r in ("phi", "vacuous", "admin")),
        F.count_if(kept & F.col("recast")).alias("n_recast"), F.count_if(kept & F.col("collapsed")).alias("n_collapsed"),
        F.count_if(kept & F.col("retyped")).alias("n_retyped"), F.count_if(kept).alias("n_before_dedup"), F.countDistinct(F.when(kept, key)).alias("n_kept"),
    )
    return one.withColumn("n_deduped", F.col("n_before_dedup") - F.col("n_kept")).drop("n_before_dedup")
