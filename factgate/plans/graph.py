"""Queries over the statement graph and over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgate import vocab
from factgate.operators import claims, notes, rdf, timeline, validate
from factgate.session import cut_lineage
from factgate.tables import spread
from factgate.tables import table as t

AS_OF = "2021-06-01"


def _claims(s: SparkSession, d: str) -> DataFrame:
    """Cleaned claims of notes with their patient and the number of models that agree on them."""
    cleaned = claims.canonical_dedup(claims.clean(claims.claims_of(spread(t(s, d, "triples"))).filter("note_id is not null")), consensus=F.countDistinct("model"))
    owner = claims.first_of(t(s, d, "notes_all").select("row_id", "note_id", "subject_id").filter("note_id is not null"), [F.col("note_id")], [F.col("row_id")])
    owner = owner.select(F.col("note_id").alias("n"), "subject_id")
    df = cleaned.join(owner, F.col("note_id") == F.col("n"), "left")
    return df.withColumn("patient_id", F.coalesce(F.concat(F.lit("s"), F.col("subject_id").cast("string")), F.concat(F.lit("n"), F.col("note_id").cast("string")))).drop("n")


def _trusted(s: SparkSession, d: str) -> DataFrame:
    """The same with the five layers and the trust of the validator, validated once."""
    return cut_lineage(validate.validate(_claims(s, d), spread(t(s, d, "notes_all")), AS_OF))


def _graph(s: SparkSession, d: str) -> DataFrame:
    """Statements without trust and consensus, for queries that ask for neither."""
    return rdf.statements(_claims(s, d).drop("consensus"))


def _full_graph(s: SparkSession, d: str) -> DataFrame:
    return rdf.statements(_trusted(s, d))


def _treatments(s: SparkSession, d: str) -> DataFrame:
    """Names of the canonical list that are drugs."""
    c = t(s, d, "canon_items").filter("item_kind = 'drug'")
    return c.select(F.col("canon_name").alias("name")).unionAll(c.select("alt_name")).filter("name is not null")


def g01_statements(s: SparkSession, d: str) -> DataFrame:
    return _full_graph(s, d)


def s13_ntriples(s: SparkSession, d: str) -> DataFrame:
    return rdf.ntriples(_full_graph(s, d))


def g03_merged(s: SparkSession, d: str) -> DataFrame:
    """Cohort graph and schema as one set of statements, counted by predicate (G-03, G-04, U-03)."""
    return _full_graph(s, d).unionByName(rdf.schema_statements(s)).distinct().groupBy("p").agg(F.count("*").alias("n"))


def g06_depths(s: SparkSession, d: str) -> DataFrame:
    return rdf.class_depths(s)


def _of_kind(s: SparkSession, d: str, kind: str) -> DataFrame:
    return rdf.patient_entities(_graph(s, d), kind)


def g07_conditions(s: SparkSession, d: str) -> DataFrame:
    return _of_kind(s, d, "Condition")


def g07_medications(s: SparkSession, d: str) -> DataFrame:
    return _of_kind(s, d, "MedicationStatement")


def g07_procedures(s: SparkSession, d: str) -> DataFrame:
    return _of_kind(s, d, "Procedure")


def g07_linked(s: SparkSession, d: str) -> DataFrame:
    return rdf.valued(_graph(s, d), "kg:ontologyCode", "code")


def g07_high_trust(s: SparkSession, d: str) -> DataFrame:
    return rdf.valued(_full_graph(s, d), "kg:trustScore", "trust").withColumn("trust", F.col("trust").cast("double")).filter("trust >= 0.8")


def g07_temporal(s: SparkSession, d: str) -> DataFrame:
    return rdf.valued(_graph(s, d), "kg:temporalAnchor", "time").drop("label").distinct()


def g07_entity_count(s: SparkSession, d: str) -> DataFrame:
    return rdf.entities(_graph(s, d)).agg(F.countDistinct("entity").alias("n_entities"))


def g08_cohorts(s: SparkSession, d: str) -> DataFrame:
    """Patients with a neoplasm, with a treatment, and with any dated entity (A-10)."""
    st = _graph(s, d)
    links = rdf.named_or_like(rdf.patient_entities(st), _treatments(s, d), vocab.CHEMO)
    dated = st.filter("p = 'kg:temporalAnchor'").select(F.col("s").alias("entity")).distinct().withColumn("dated", F.lit(True))
    flags = (("n_neoplasm", F.col("label").rlike(f"(?i){vocab.CANCER}")), ("n_treated", F.col("meant")), ("n_dated", F.col("dated")))
    return links.join(dated, "entity", "left").agg(*(F.countDistinct(F.when(c, F.col("patient"))).alias(n) for n, c in flags))


def g09_summary(s: SparkSession, d: str) -> DataFrame:
    """Q1: a diagnosis and all treatments of each patient who has both (J-14, A-12)."""
    st = _graph(s, d)
    a = rdf.with_patterns(rdf.patient_entities(st, "Condition"), vocab.CANCER).groupBy("patient").agg(F.min("label").alias("diagnosis"))
    b = rdf.named_or_like(rdf.patient_entities(st, "MedicationStatement"), _treatments(s, d), vocab.CHEMO).filter("meant")
    return a.join(b.groupBy("patient").agg(F.array_join(F.array_sort(F.collect_set("label")), ", ").alias("treatments")), "patient")


def g09_treated(s: SparkSession, d: str) -> DataFrame:
    """Q2."""
    return g09_summary(s, d).agg(F.count("*").alias("n_treated"))


def g09_most_used(s: SparkSession, d: str) -> DataFrame:
    """Q3: the ten medications of most patients, a top-k (A-11)."""
    return _of_kind(s, d, "MedicationStatement").groupBy("label").agg(F.countDistinct("patient").alias("n_patients")).orderBy(F.desc("n_patients"), "label").limit(10)


def g09_comorbid(s: SparkSession, d: str) -> DataFrame:
    """Q4: other conditions of patients with a neoplasm (P-11)."""
    c = _of_kind(s, d, "Condition")
    return rdf.co_occurring(rdf.with_patterns(c, vocab.CANCER), c.filter(~F.col("label").rlike(f"(?i){vocab.CANCER}")))


def g09_dated(s: SparkSession, d: str) -> DataFrame:
    """Q6: dated events of patients."""
    return rdf.dated(_graph(s, d))


def g10_report(s: SparkSession, d: str) -> DataFrame:
    return _full_graph(s, d).agg(F.count("*").alias("n_statements"), F.countDistinct("s").alias("n_subjects"), F.countDistinct("p").alias("n_predicates"), F.countDistinct(F.when(F.col("s").like("patient:%"), F.col("s"))).alias("n_patients"))


def g05_usage(s: SparkSession, d: str) -> DataFrame:
    """Property usage with its commonest domain and range over inferred classes (G-05, A-19)."""
    r = timeline.relations_of(t(s, d, "triples"))
    return rdf.property_usage(r.withColumn("subject_type", rdf.inferred_class(F.col("subject"), F.col("subject_type"))))


def o06_top_properties(s: SparkSession, d: str) -> DataFrame:
    """The fifteen most used properties, a top-k report (O-06, A-07)."""
    return g05_usage(s, d).orderBy(F.desc("n"), "predicate").limit(15)


def j13_two_hops(s: SparkSession, d: str) -> DataFrame:
    """Edges within two hops of the canonical conditions (J-13, R-04)."""
    e = timeline.relations_of(t(s, d, "triples").filter("note_id is not null")).select(F.col("subject").alias("src"), F.col("object").alias("dst"))
    start = t(s, d, "canon_items").filter("item_kind = 'condition' and ref_id % 100 = 0").select(F.col("canon_name").alias("key"))
    return rdf.neighbourhood(e, start, 2)


def g15_nodes(s: SparkSession, d: str) -> DataFrame:
    return rdf.trust_graph(_trusted(s, d))[0].select("node_id", "node", "kind", F.round("trust", 4).alias("trust"), "first_claim")


def g15_edges(s: SparkSession, d: str) -> DataFrame:
    """Edges both ways with dense ids and seven features (G-15)."""
    return rdf.trust_graph(_trusted(s, d))[1].select("claim_id", "src_id", "dst_id", *(F.round(c, 4).alias(c) for c in rdf.EDGE_FEATURES))


def g16_propagated(s: SparkSession, d: str) -> DataFrame:
    n, e = rdf.trust_graph(_trusted(s, d))
    return rdf.propagate(n, e).select("node", F.round("trust", 6).alias("trust"))


def g17_labels(s: SparkSession, d: str) -> DataFrame:
    """Label of each entity by its last claim: trust from 0.6 (G-17)."""
    return _trusted(s, d).groupBy(F.lower(F.trim("entity")).alias("node")).agg(F.max_by((F.col("trust") >= 0.6).cast("int"), "claim_id").alias("label"))


def g18_mapped(s: SparkSession, d: str) -> DataFrame:
    """Propagated trust brought back to the claims (G-18, without the trained network)."""
    c = _trusted(s, d)
    return rdf.mapped_back(c, rdf.propagate(*rdf.trust_graph(c))).select("claim_id", "trust", F.round("graph_trust", 6).alias("graph_trust"))


def g05_schema(s: SparkSession, d: str) -> DataFrame:
    """The schema that grew with the relations as OWL statements (G-05): the fixed classes, types that occur, and properties by use."""
    r = timeline.relations_of(t(s, d, "triples"))
    r = r.withColumn("subject_type", rdf.inferred_class(F.col("subject"), F.col("subject_type")))
    known = s.createDataFrame([(c, p) for c, p in vocab.CLASSES], "class string, parent string")
    new = r.select(F.col("subject_type").alias("class")).unionAll(r.select("object_type")).filter("coalesce(class, '') <> ''").distinct().join(known.select("class"), "class", "left_anti")
    return rdf.schema_export(known.unionByName(new.withColumn("parent", F.lit("Resource"))), rdf.property_usage(r))


def f28_short(s: SparkSession, d: str) -> DataFrame:
    """Short names of the identifiers of entities, written out (F-28)."""
    return rdf.entities(_graph(s, d)).select("entity", rdf.short_name(F.concat(F.lit("http://kg/x#"), F.substring("entity", 4, 10_000))).alias("short")).distinct()


def f20_recency(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "triples").select("triple_id", F.round(rdf.recency(F.col("temporal_start")), 4).alias("recency"))


def f18_forms(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "triples").filter("temporal_start is not null").select("triple_id", timeline.date_form(F.col("temporal_start")).alias("form"))


def _anchored(s: SparkSession, d: str) -> DataFrame:
    first = validate.first_notes(spread(t(s, d, "notes_all")))
    return timeline.anchored(_claims(s, d), first, notes.dates(first))


def t01_anchored(s: SparkSession, d: str) -> DataFrame:
    """Dates of claims, own or near their evidence (T-01, T-02, J-09)."""
    return _anchored(s, d).select("claim_id", "date_form", "date_kind")


def t03_timeline(s: SparkSession, d: str) -> DataFrame:
    return timeline.timeline(_anchored(s, d))


def t04_metrics(s: SparkSession, d: str) -> DataFrame:
    return timeline.time_metrics(_anchored(s, d))


def t05_snapshot(s: SparkSession, d: str) -> DataFrame:
    return timeline.snapshot(timeline.relations_of(t(s, d, "triples")), "2018").select("relation_id", "subject", "predicate", "object")


def t06_about(s: SparkSession, d: str) -> DataFrame:
    """Relations of the canonical names with a number divisible by 10, in time order (T-06, W-12)."""
    keys = t(s, d, "canon_items").filter("ref_id % 10 = 0").select(F.col("canon_name").alias("key"))
    return timeline.about(timeline.relations_of(t(s, d, "triples")), keys).select("key", "nth", "relation_id", "subject", "predicate", "object")


def t07_timeline(s: SparkSession, d: str) -> DataFrame:
    return timeline.change_timeline(timeline.relations_of(t(s, d, "triples")))


def t07_changes(s: SparkSession, d: str) -> DataFrame:
    return timeline.changes(timeline.relations_of(t(s, d, "triples")))


def t08_relations(s: SparkSession, d: str) -> DataFrame:
    return timeline.relations_of(t(s, d, "triples")).select("relation_id", "subject", "predicate", "object", "subject_type")


def t09_stats(s: SparkSession, d: str) -> DataFrame:
    return timeline.relations_of(t(s, d, "triples")).agg(F.count("*").alias("n"), F.countDistinct("subject").alias("n_subjects"), F.countDistinct("predicate").alias("n_predicates"), F.count("temporal_start").alias("n_dated"))


def t10_reified(s: SparkSession, d: str) -> DataFrame:
    """Relations as reified statements."""
    r = timeline.relations_of(t(s, d, "triples"))
    node = F.concat(F.lit("kg:r"), F.col("relation_id").cast("string"))
    parts = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(node.alias("s"), F.lit(p).alias("p"), F.col(c).alias("o"))) for p, c in (("rdf:subject", "subject"), ("rdf:predicate", "predicate"), ("rdf:object", "object"), ("kg:validFrom", "temporal_start"), ("kg:validUntil", "temporal_end"))]))
    return r.select(F.explode(parts).alias("x")).select("x.*")


QUERIES = {f.__name__: f for f in (g01_statements, s13_ntriples, g03_merged, g06_depths, g07_conditions, g07_medications, g07_procedures, g07_linked, g07_high_trust, g07_temporal, g07_entity_count, g08_cohorts, g09_summary, g09_treated, g09_most_used, g09_comorbid, g09_dated, g10_report, g05_usage, o06_top_properties, j13_two_hops, g15_nodes, g15_edges, g16_propagated, g17_labels, g18_mapped, g05_schema, f28_short, f20_recency, f18_forms, t01_anchored, t03_timeline, t04_metrics, t05_snapshot, t06_about, t07_changes, t07_timeline, t08_relations, t09_stats, t10_reified)}

from factgate.plans.oracles import GRAPH as ORACLE  # noqa: E402
