"""Queries over claims: union, cleaning, validation, gate, calibration, evaluation and corpus reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgate.functions import clinical, match
from factgate.functions.text import normalize
from factgate.operators import calibrate, claims, ehr, evaluate, notes, validate
from factgate.session import cut_lineage
from factgate.tables import broadcast_if_small, small_rows, spread
from factgate.tables import table as t

AS_OF = "2021-06-01"
MODELS = ["model_a", "model_b", "model_c"]


def _claims(s: SparkSession, d: str) -> DataFrame:
    return claims.claims_of(spread(t(s, d, "triples")))


def _validated(s: SparkSession, d: str) -> DataFrame:
    return validate.validate(claims.union_dedup(_claims(s, d)), spread(t(s, d, "notes_all")), AS_OF)


def f01_normalize(s: SparkSession, d: str) -> DataFrame:
    return _claims(s, d).select("claim_id", normalize(F.coalesce("entity", F.lit(""))).alias("entity"), clinical.tidy(F.col("attribute")).alias("attribute"))


def f06_identifiers(s: SparkSession, d: str) -> DataFrame:
    """Identifier parts of names (F-06), scrubbed texts and flags (F-08, F-09), statuses (V-12), codes (J-12, G-02)."""
    e = F.coalesce("entity", F.lit(""))
    return _claims(s, d).select(
        "claim_id", clinical.safe_uri(e).alias("uri"), clinical.scrub_phi(F.col("value")).alias("scrubbed"), clinical.is_phi(F.col("entity")).alias("phi"),
        clinical.is_vacuous(F.col("entity")).alias("vacuous"), clinical.status_of(F.col("attribute")).alias("status"), clinical.code_of(F.col("entity")).alias("code"), clinical.miss_bucket(e).alias("bucket"),
    )


def f10_types(s: SparkSession, d: str) -> DataFrame:
    """The three readings of a type word (F-10, F-11, F-12, V-15) over the types and attributes that occur."""
    x = t(s, d, "triples").select(F.coalesce("fhir_type", F.lit("")).alias("raw"), F.coalesce("attribute", F.lit("")).alias("attribute")).distinct()
    x = x.unionByName(x.select(F.col("attribute").alias("raw"), "attribute").distinct()).distinct()
    return x.select("raw", "attribute", clinical.type_a(F.col("raw"), F.col("attribute")).alias("a"), clinical.type_b(F.col("raw")).alias("b"), clinical.type_c(F.col("raw")).alias("c"))


def w13_union(s: SparkSession, d: str) -> DataFrame:
    """Ensemble union with first-wins deduplication (U-01, U-02, W-13)."""
    return claims.union_dedup(_claims(s, d)).select("claim_id", "note_id", "model", "entity", "attribute", "value")


def e06_consensus(s: SparkSession, d: str) -> DataFrame:
    return claims.consensus(_claims(s, d))


def v11_cleaning(s: SparkSession, d: str) -> DataFrame:
    return claims.cleaning_report(claims.clean(_claims(s, d)))


def sel08_drops(s: SparkSession, d: str) -> DataFrame:
    """What becomes of each claim (P-08, P-09, V-12, V-13)."""
    return claims.clean(_claims(s, d)).select("claim_id", "entity", "value", "kind", "drop_reason", "recast", "collapsed")


def v14_kept(s: SparkSession, d: str) -> DataFrame:
    return claims.canonical_dedup(claims.clean(_claims(s, d))).select("claim_id", "note_id", "entity", "attribute", "value", "kind")


def v02_grounding(s: SparkSession, d: str) -> DataFrame:
    return validate.grounding(_claims(s, d), spread(t(s, d, "notes_all"))).select("claim_id", F.round("grounding", 6).alias("grounding"))


def v03_ontology(s: SparkSession, d: str) -> DataFrame:
    return _claims(s, d).select("claim_id", clinical.known_concept(F.col("entity"), F.col("kind")).alias("ontology"))


def v04_schema(s: SparkSession, d: str) -> DataFrame:
    return validate.schema_scores(_claims(s, d)).select(F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("attribute", F.lit("")).alias("attribute"), "schema")


def v05_temporal(s: SparkSession, d: str) -> DataFrame:
    return _claims(s, d).select("claim_id", validate.temporal_score(F.col("anchor"), AS_OF).alias("temporal"))


def v06_contradiction(s: SparkSession, d: str) -> DataFrame:
    return validate.contradiction(_claims(s, d)).select("claim_id", "contradiction")


def v07_trust(s: SparkSession, d: str) -> DataFrame:
    """Trust of every claim of the union (V-01 to V-08)."""
    return _validated(s, d).select("claim_id", "note_id", "kind", *(F.round(c, 3).alias(c) for c in validate.LAYERS), "trust")


def sel05_gate(s: SparkSession, d: str) -> DataFrame:
    """Admission by type: the flagship (P-05, P-06, P-07, A-02)."""
    g = validate.gate(_validated(s, d), 0.7)
    ok = F.col("accepted") & (F.col("grounding") > 0)
    return g.groupBy(F.coalesce("kind", F.lit("")).alias("kind")).agg(F.count("*").alias("n"), F.count_if(ok).alias("n_admitted"), F.count_if(F.col("grounding") >= 0.5).alias("n_grounded"), F.round(F.avg("trust"), 4).alias("mean_trust"))


def a03_layers(s: SparkSession, d: str) -> DataFrame:
    """Layer report by model and overall (A-01, A-03, E-11)."""
    return validate.layer_report(_validated(s, d), F.col("model"))


def v10_fused(s: SparkSession, d: str) -> DataFrame:
    """Fused trust with a reviewer's judgements derived from the claim itself (V-09, V-10, O-03)."""
    j = F.pmod(F.col("claim_id"), F.lit(10)) / 10.0
    x = _validated(s, d).withColumns({"r": j, "c": 1 - j, "j": F.col("grounding"), "xi": j / 2})
    return validate.fused_trust(x).select("claim_id", "agent", "place", "fused")


def f27_perturbed(s: SparkSession, d: str) -> DataFrame:
    """The first three perturbations of each claim (F-27)."""
    return evaluate.perturbed(_claims(s, d)).select("claim_id", "nth", "how", "value", "kind")


def f37_fallback(s: SparkSession, d: str) -> DataFrame:
    """Heads and tails by alternate fields (F-37): the entity, else the attribute; the value, else the evidence."""
    return _claims(s, d).select("claim_id", clinical.first_given("entity", "attribute").alias("head"), clinical.first_given("value", "evidence").alias("tail"))


def _notes(s: SparkSession, d: str) -> DataFrame:
    return validate.first_notes(spread(t(s, d, "notes_all")))


def _gold(s: SparkSession, d: str) -> DataFrame:
    """Stand-in for annotations: the canonical names that stand in a note, with their kind and number of mentions: note_id, gold, label, n."""
    names = t(s, d, "canon_items").filter("canon_name is not null").select("canon_name", "item_kind")
    terms = [r.canon_name for r in small_rows(names.select("canon_name"), 1_000_000, "canon_items")]
    found = notes.find_terms(_notes(s, d), terms).groupBy("note_id", F.lower("text").alias("gold")).agg(F.count("*").alias("n"))
    kinds = names.groupBy(F.lower("canon_name").alias("gold")).agg(F.min("item_kind").alias("label"))
    return cut_lineage(found.join(broadcast_if_small(kinds, 500_000), "gold").select("note_id", "gold", "label", "n"))


def _of_notes(s: SparkSession, d: str) -> DataFrame:
    return _claims(s, d).filter("note_id is not null")


def _hits(s: SparkSession, d: str, gold: DataFrame | None = None) -> DataFrame:
    return evaluate.match_pairs(evaluate.claim_texts(_of_notes(s, d)), _gold(s, d) if gold is None else gold, ["model"])


def f03_match(s: SparkSession, d: str) -> DataFrame:
    """match_score of all canonical names against all type attributes and of each model's entities with the note's gold (F-02, F-03, F-33)."""
    a = t(s, d, "canon_items").select(F.col("canon_name").alias("a"))
    b = t(s, d, "attribute_catalog").select(F.replace("attribute", F.lit("_"), F.lit(" ")).alias("b"))
    extra = s.createDataFrame([("HTN", "hypertension"), ("chest pain", "pain"), ("red big house", "big red house"), ("a1 b2 c3 d4 e5 f6", "b2 a1 zz"), ("x", "")], "a string, b string")
    pairs = t(s, d, "triples").select(F.col("entity").alias("a"), F.col("value").alias("b")).distinct().unionByName(extra)
    return pairs.select("a", "b", F.round(match.match_score(F.col("a"), F.col("b")), 6).alias("score"), match.concept_match(F.col("a"), F.col("b")).alias("concept"))


def j06_pairs(s: SparkSession, d: str) -> DataFrame:
    return _hits(s, d).select("note_id", "model", "text", "gold", "score")


def j07_blocked(s: SparkSession, d: str) -> DataFrame:
    return evaluate.blocked_pairs(evaluate.claim_texts(_of_notes(s, d)), _gold(s, d))


def e01_scores(s: SparkSession, d: str) -> DataFrame:
    """Macro scores per model over distinct texts (E-02, A-05)."""
    g = _gold(s, d)
    return evaluate.macro(evaluate.prf(_hits(s, d, g), evaluate.claim_texts(_of_notes(s, d)), g), "model")


def _note_scores(s: SparkSession, d: str) -> DataFrame:
    c, g = _of_notes(s, d), _gold(s, d)
    texts = evaluate.texts_of_claims(c)
    return evaluate.note_scores(c, texts, _hits(s, d, g), g, evaluate.claims_in_note(texts, c, _notes(s, d)))


def e01_notes(s: SparkSession, d: str) -> DataFrame:
    """Entity and mention scores and hallucination by note and model (E-01, A-04)."""
    x = _note_scores(s, d)
    return x.select("note_id", "model", "n_claims", "n_gold", "n_mentions", "n_right", "n_covered", "n_covered_mentions", *(F.round(c, 4).alias(c) for c in ("p", "r", "f1", "mention_r", "mention_f1", "hallucination")))


def e01_models(s: SparkSession, d: str) -> DataFrame:
    """Means and sums by model (A-06)."""
    return evaluate.model_totals(_note_scores(s, d))


def u05_subsets(s: SparkSession, d: str) -> DataFrame:
    """Every subset of models, ranked by mean F1 and recall (U-05, E-03, O-04)."""
    c, g = _of_notes(s, d), _gold(s, d)
    keyed = c.withColumn("key", F.struct(*(F.lower(F.trim(F.coalesce(F.col(x), F.lit("")))).alias(x) for x in ("entity", "attribute", "value"))))
    return evaluate.subset_scores(keyed, evaluate.texts_of_claims(c), _hits(s, d, g), g, MODELS)


def e04_misses(s: SparkSession, d: str) -> DataFrame:
    """Gold texts the models miss, by bucket (E-04, F-25)."""
    g = _gold(s, d)
    return evaluate.misses(_hits(s, d, g), g).groupBy("bucket").agg(F.count("*").alias("n"))


def a18_labels(s: SparkSession, d: str) -> DataFrame:
    """Recall by gold label (A-18, E-04)."""
    g = _gold(s, d)
    return evaluate.by_label(_hits(s, d, g), g)


def a18_recurring(s: SparkSession, d: str) -> DataFrame:
    g = _gold(s, d)
    return evaluate.recurring(evaluate.misses(_hits(s, d, g), g))


def e12_samples(s: SparkSession, d: str) -> DataFrame:
    """The first matched, missed and ungrounded texts by note and model (E-12), a bounded inspection table."""
    c, g = _of_notes(s, d), _gold(s, d)
    texts = evaluate.texts_of_claims(c)
    bare = evaluate.claims_in_note(texts, c, _notes(s, d)).filter("not grounded").join(c, "claim_id").select("note_id", "model", F.trim(F.coalesce("entity", F.lit(""))).alias("text"))
    return evaluate.samples(_hits(s, d, g), g, bare)


def _chart(s: SparkSession, d: str) -> DataFrame:
    items = t(s, d, "d_labitems").filter("itemid is not null").groupBy("itemid").agg(F.min_by("label", F.struct("loaded_at", "label")).alias("label"))
    return evaluate.chart_concepts(t(s, d, "diagnoses_icd"), t(s, d, "prescriptions"), t(s, d, "labevents"), ehr.titles(t(s, d, "d_icd_diagnoses")), items)


def e05_concepts(s: SparkSession, d: str) -> DataFrame:
    """What the charts say, by category (E-05, W-10)."""
    return _chart(s, d)


def e05_chart_scores(s: SparkSession, d: str) -> DataFrame:
    """Claims against the charts of their admissions (E-05, F-04)."""
    n = claims.first_of(t(s, d, "notes_all").filter("note_id is not null").select("row_id", "note_id", "hadm_id", "text"), [F.col("note_id")], [F.col("row_id")])
    return evaluate.chart_scores(evaluate.said_in_notes(_of_notes(s, d), n), _chart(s, d))


def e08_quality(s: SparkSession, d: str) -> DataFrame:
    """Per-model quality (E-08, A-16, F-26)."""
    n = _notes(s, d)
    return evaluate.model_quality(evaluate.in_note(_claims(s, d), n, 4), n)


def e07_failures(s: SparkSession, d: str) -> DataFrame:
    return evaluate.failures(evaluate.in_note(_claims(s, d), validate.first_notes(spread(t(s, d, "notes_all"))), 5))


def e10_curve(s: SparkSession, d: str) -> DataFrame:
    """Claims of the first 25, 50, 75 and 100 % of notes by id (E-10, W-04)."""
    per = _claims(s, d).filter("note_id is not null").groupBy("note_id").agg(F.count("*").alias("n"))
    run = calibrate.running(per, ["note_id"], {"claims": F.col("n")})
    total = run.agg(F.count("*")).scalar()
    steps = F.array(*[F.struct(F.lit(p).alias("percent"), F.ceil(total * p / 100).alias("k")) for p in (25, 50, 75, 100)])
    return run.withColumn("x", F.explode(steps)).filter("rank = x.k").select("x.percent", F.col("rank").alias("n_notes"), F.col("claims").alias("n_claims"))


def _scored(s: SparkSession, d: str) -> DataFrame:
    """Validated claims with a verdict: right if another model agrees on the claim."""
    agreed = (F.min("model") != F.max("model")).cast("int")  # counted where the union groups by the canonical key: no claim is lost to a join by id
    v = validate.validate(claims.union_dedup(_claims(s, d), y=agreed), spread(t(s, d, "notes_all")), AS_OF)
    return cut_lineage(v.select("claim_id", F.least(F.greatest(F.col("trust"), F.lit(0.0)), F.lit(1.0)).alias("score"), "y", "kind", "entity", "value", "evidence", "anchor", "model", *validate.LAYERS, "trust"))


def c04_ece(s: SparkSession, d: str) -> DataFrame:
    return calibrate.ece(_scored(s, d)).select(F.round("ece", 6).alias("ece"))


def c04_bins(s: SparkSession, d: str) -> DataFrame:
    return calibrate.reliability(_scored(s, d)).select("bin", "n", F.round("mean_score", 6).alias("mean_score"), F.round("share", 6).alias("share"))


def c05_scores(s: SparkSession, d: str) -> DataFrame:
    return calibrate.proper_scores(_scored(s, d)).select(F.round("brier", 6).alias("brier"), F.round("nll", 6).alias("nll"))


def w05_curve(s: SparkSession, d: str) -> DataFrame:
    return calibrate.risk_coverage(_scored(s, d).select("claim_id", "score", "y"), "claim_id").select("claim_id", "rank", "errors", F.round("risk", 6).alias("risk"))


def c06_aurc(s: SparkSession, d: str) -> DataFrame:
    return calibrate.aurc(calibrate.risk_coverage(_scored(s, d).select("claim_id", "score", "y"), "claim_id")).select(F.round("aurc", 6).alias("aurc"))


def w07_coverage(s: SparkSession, d: str) -> DataFrame:
    return calibrate.coverage_at(calibrate.risk_coverage(_scored(s, d).select("claim_id", "score", "y"), "claim_id"), [0.2, 0.3, 0.5]).select("target", F.round("coverage", 6).alias("coverage"))


def c07_bands(s: SparkSession, d: str) -> DataFrame:
    """Bands at three operating points (C-07, C-08, C-09, W-08)."""
    x = _scored(s, d).select("claim_id", "score", "y")
    b = calibrate.bands(x.filter("claim_id % 2 = 0"), x.filter("claim_id % 2 = 1"), "claim_id", [0.2, 0.3, 0.5], 0.15)
    return b.withColumn("insert_precision", F.round("insert_precision", 6))


def o05_held(s: SparkSession, d: str) -> DataFrame:
    """The fourteen lowest-scored wrong claims: a top-k report."""
    return _scored(s, d).filter("y = 0").select("claim_id", "score").orderBy("score", "claim_id").limit(14)


def c02_boosted(s: SparkSession, d: str) -> DataFrame:
    """Held-out calibration of boosted trees and their Platt scaling against the rule's trust (C-01, C-02, C-03)."""
    x = calibrate.features(_scored(s, d)).select("claim_id", "y", "f", "score")
    side = F.pmod("claim_id", F.lit(5))
    model = calibrate.fit_booster(x.filter(side < 3))
    scored = calibrate.boosted_scores(model, x.drop("score"))
    a, b = calibrate.platt(scored.filter(side == 3))
    test = scored.filter(side == 4)
    lines = [("rule", x.filter(side == 4)), ("boosted", test), ("platt", test.withColumn("score", 1 / (1 + F.exp(-(F.col("score") * a + b)))))]
    out = None
    for name, df in lines:
        one = calibrate.proper_scores(df).select(F.lit(name).alias("scorer"), F.round("brier", 6).alias("brier"), F.round("nll", 6).alias("nll"), calibrate.ece(df).scalar().alias("ece"))
        out = one if out is None else out.unionByName(one)
    return out


def e13_pivot(s: SparkSession, d: str) -> DataFrame:
    """Claims per note and model as a table (E-13)."""
    return _claims(s, d).filter("note_id is not null").groupBy("note_id").pivot("model", MODELS).count().fillna(0)


QUERIES = {f.__name__: f for f in (f01_normalize, f06_identifiers, f10_types, w13_union, e06_consensus, v11_cleaning, sel08_drops, v14_kept, v02_grounding, v03_ontology, v04_schema, v05_temporal, v06_contradiction, v07_trust, sel05_gate, a03_layers, v10_fused, f27_perturbed, f37_fallback, f03_match, j06_pairs, j07_blocked, e01_scores, e01_notes, e01_models, u05_subsets, e04_misses, a18_labels, a18_recurring, e12_samples, e05_concepts, e05_chart_scores, e08_quality, e07_failures, e10_curve, c04_ece, c04_bins, c05_scores, w05_curve, c06_aurc, w07_coverage, c07_bands, o05_held, c02_boosted, e13_pivot)}

from factgate.plans.oracles import CLAIMS as ORACLE  # noqa: E402
