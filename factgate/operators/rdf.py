"""Statements of the fact graph, their schema, and the cohort queries over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgate import vocab
from factgate.functions.clinical import code_of, lookup, safe_uri, type_c
from factgate.operators.calibrate import global_rank
from factgate.session import cut_lineage
from factgate.tables import broadcast_if_small

#: Names of at most so many rows are broadcast to the labels.
MAX_NAMES = 500_000
#: Lists of an entity that are longer are cut into blocks of about so many (more where a product has over 3.6 billion rows, so that
#: the blocks' copies grow as the statements, not as the product); at most MAX_HOT entities with such lists are broadcast.
BLOCK, MAX_HOT = 300, 200_000
#: Rows that a task of a product writes: at least SMALL_TASK, and while there are fewer tasks than MAX_TASKS, at most about LARGE_TASK.
SMALL_TASK, LARGE_TASK, MAX_TASKS = 250_000, 5_000_000, 10_000

NUMBER = r"^[+-]?[0-9]+(\.[0-9]+)?$"


def _s(s: Column, p: Column | str, o: Column, kind: str | Column, when: Column | None = None) -> Column:
    one = F.struct(s.alias("s"), (F.lit(p) if isinstance(p, str) else p).alias("p"), o.alias("o"), (F.lit(kind) if isinstance(kind, str) else kind).alias("o_kind"))
    return one if when is None else F.when(when, one)


def statements(claims: DataFrame) -> DataFrame:
    """Distinct statements (s, p, o, o_kind: uri, string or float) of claims.

    claims: patient_id, entity, attribute, value, kind, evidence, anchor, and trust and consensus where those are to be stated. Entities
    are shared between patients, as their identifier is their name. Claims without entity or value state nothing but their patient. One
    pass, one distinct.
    """
    e, v = F.trim(F.coalesce("entity", F.lit(""))), F.trim(F.coalesce("value", F.lit("")))
    df = claims.withColumns({"e": e, "v": v, "has": (e != "") & (v != "")})
    ent, pat = F.concat(F.lit("kg:"), safe_uri(F.col("e"))), F.concat(F.lit("patient:"), safe_uri(F.col("patient_id")))
    a = F.trim(F.coalesce("attribute", F.lit("")))
    code, kind, has = code_of(F.col("e")), type_c(F.col("kind")), F.col("has")
    is_num = F.col("v").rlike(NUMBER)
    rows = F.array_compact(F.array(
        _s(pat, "rdf:type", F.lit("fhir:Patient"), "uri"), _s(pat, "rdfs:label", F.col("patient_id"), "string"),
        _s(ent, "rdf:type", F.concat(F.lit("fhir:"), kind), "uri", has & kind.isin(*vocab.CORE_TYPES)), _s(ent, "rdfs:label", F.col("e"), "string", has),
        _s(ent, "owl:sameAs", code, "uri", has & code.isNotNull()), _s(ent, "kg:ontologyCode", code, "string", has & code.isNotNull()),
        _s(ent, F.when(a == "", "kg:hasValue").otherwise(F.concat(F.lit("kg:"), safe_uri(a))), F.col("v"), F.when(is_num, "float").otherwise("string"), has),
        _s(pat, "kg:hasEntity", ent, "uri", has), _s(ent, "kg:evidenceSpan", F.left("evidence", F.lit(200)), "string", has & (F.coalesce("evidence", F.lit("")) != "")),
        *([_s(ent, "kg:trustScore", F.format_string("%.4f", F.coalesce("trust", F.lit(0.5))), "float", has)] if "trust" in claims.columns else []),
        *([_s(ent, "kg:consensusLevel", F.col("consensus").cast("string"), "string", has & F.col("consensus").isNotNull())] if "consensus" in claims.columns else []),
        _s(ent, "kg:temporalAnchor", F.col("anchor"), "string", has & ~F.lower(F.coalesce("anchor", F.lit(""))).isin("", "null", "none")),
    ))
    return df.select(F.explode(rows).alias("t")).select("t.*").distinct()


#: What the prefixes of statements stand for in exported files; kg and patient may be set to a site's own.
PREFIXES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "owl": "http://www.w3.org/2002/07/owl#",
    "xsd": "http://www.w3.org/2001/XMLSchema#", "fhir": "http://hl7.org/fhir/", "kg": "urn:kg:", "patient": "urn:patient:",
    "SNOMED": "http://snomed.info/id/", "RxNorm": "urn:rxnorm:", "LOINC": "http://loinc.org/rdf/",
}


def iri(name: Column, prefixes: dict[str, str] = PREFIXES) -> Column:
    """<IRI> of a prefixed name; characters an IRI may not hold are percent-encoded."""
    head = F.substring_index(name, ":", 1)
    full = F.concat(F.coalesce(lookup(prefixes, head), F.concat(F.lit("urn:"), head, F.lit(":"))), F.substring(name, F.length(head) + 2, F.length(name)))
    for raw, code in ((" ", "%20"), ("<", "%3C"), (">", "%3E"), ('"', "%22"), ("{", "%7B"), ("}", "%7D"), ("|", "%7C"), ("^", "%5E"), ("`", "%60"), ("\\", "%5C")):
        full = F.replace(full, F.lit(raw), F.lit(code))
    return F.concat(F.lit("<"), full, F.lit(">"))


def ntriples(st: DataFrame, prefixes: dict[str, str] = PREFIXES) -> DataFrame:
    """One N-Triples line per statement in column `value`: absolute IRIs, escaped literals, typed numbers."""
    text = F.col("o")
    for raw, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(code))
    quoted = F.concat(F.lit('"'), text, F.lit('"'))
    o = F.when(F.col("o_kind") == "uri", iri(F.col("o"), prefixes)).when(F.col("o_kind") == "float", F.concat(quoted, F.lit(f"^^<{PREFIXES['xsd']}float>"))).otherwise(quoted)
    return st.select(F.concat_ws(" ", iri(F.col("s"), prefixes), iri(F.col("p"), prefixes), o, F.lit(".")).alias("value"))


def short_name(name: Column) -> Column:
    """The last part of an identifier, after its last slash and hash, at most 40 characters."""
    return F.left(F.substring_index(F.substring_index(name, "/", -1), "#", -1), F.lit(40))


def entities(st: DataFrame) -> DataFrame:
    """entity, label pairs."""
    return st.filter("p = 'rdfs:label' and s like 'kg:%'").select(F.col("s").alias("entity"), F.col("o").alias("label"))


def patient_entities(st: DataFrame, kind: str | None = None) -> DataFrame:
    """patient, entity, label of linked entities, of one class where given."""
    out = st.filter("p = 'kg:hasEntity'").select(F.col("s").alias("patient"), F.col("o").alias("entity"))
    if kind:
        out = out.join(st.filter((F.col("p") == "rdf:type") & (F.col("o") == f"fhir:{kind}")).select(F.col("s").alias("entity")), "entity", "left_semi")
    return out.join(entities(st), "entity").select("patient", "entity", "label")


def valued(st: DataFrame, predicate: str, name: str) -> DataFrame:
    """entity, label and the objects of one predicate; each distinct object is a row."""
    return st.filter(F.col("p") == predicate).select(F.col("s").alias("entity"), F.col("o").alias(name)).join(entities(st), "entity")


def dated(st: DataFrame) -> DataFrame:
    """patient, label, time: every patient of an entity with every label and every plausible date of it, each once.

    This is a product of three lists an entity, far larger than the statements it is made of. So nothing of its size is moved or
    sorted: the lists are gathered in blocks, combinations of blocks are spread over the tasks, and the rows are written out of
    them last. A row needs no distinct, as a label belongs to one entity and a block holds its members once.
    """
    is_link, is_label = F.col("p") == "kg:hasEntity", (F.col("p") == "rdfs:label") & F.col("s").like("kg:%")
    is_date = (F.col("p") == "kg:temporalAnchor") & (F.length("o") > 3) & ~F.contains(F.col("o"), F.lit("REDACTED"))
    side = F.when(is_link, "patient").when(is_label, "label").when(is_date, "time")
    parts = st.select(F.when(is_link, F.col("o")).otherwise(F.col("s")).alias("entity"), side.alias("side"), F.when(is_link, F.col("s")).otherwise(F.col("o")).alias("x"))
    parts, sides = cut_lineage(parts.filter("side is not null")), ("patient", "label", "time")
    n = parts.groupBy("entity").agg(*(F.count_if(F.col("side") == k).cast("double").alias(k) for k in sides))
    total = n.agg(F.coalesce(F.sum(F.col("patient") * F.col("label") * F.col("time")), F.lit(0.0))).first()[0]
    block = max(BLOCK, int(total**0.5) // 200)
    hot = n.filter(F.greatest(*sides) > block)
    cut = parts.join(broadcast_if_small(hot, MAX_HOT), "entity", "left")
    pieces = F.coalesce(F.ceil(F.coalesce(*(F.when(F.col("side") == k, F.col(k)) for k in sides)) / block), F.lit(1))
    blocks = cut.groupBy("entity", "side", F.pmod(F.xxhash64("x"), pieces).alias("block")).agg(F.collect_set("x").alias("xs"))
    a, b, c = (blocks.filter(F.col("side") == k).select("entity", F.col("block").alias(f"{k}_block"), F.col("xs").alias(f"{k}s")) for k in sides)
    tasks = int(max(min(4 * st.sparkSession.sparkContext.defaultParallelism, total // SMALL_TASK + 1), min(MAX_TASKS, total // LARGE_TASK)))
    tiles = a.join(b, "entity").join(c, "entity").repartition(tasks, "entity", *(f"{k}_block" for k in sides))
    rows = tiles.select(F.explode("patients").alias("patient"), "labels", "times").select("patient", F.explode("labels").alias("label"), "times")
    return rows.select("patient", "label", F.explode("times").alias("time"))


def co_occurring(a: DataFrame, b: DataFrame) -> DataFrame:
    """label of b and the patients who have something of a. The side of a is one row per patient before the join."""
    return b.join(a.select("patient").distinct(), "patient", "left_semi").groupBy("label").agg(F.countDistinct("patient").alias("n_patients"))


def with_patterns(df: DataFrame, pattern: str) -> DataFrame:
    return df.filter(F.col("label").rlike(f"(?i){pattern}"))


def named_or_like(df: DataFrame, names: DataFrame, pattern: str) -> DataFrame:
    """Adds `meant`: whether the label is one of the names, up to case, or holds the pattern. names: name."""
    listed = names.select(F.lower(F.trim("name")).alias("__name")).filter("__name <> ''").distinct().withColumn("__listed", F.lit(True))
    out = df.join(broadcast_if_small(listed, MAX_NAMES), F.lower(F.trim("label")) == F.col("__name"), "left")
    return out.withColumn("meant", F.coalesce("__listed", F.lit(False)) | F.col("label").rlike(f"(?i){pattern}")).drop("__name", "__listed")


def schema_statements(spark) -> DataFrame:
    """Classes and their parents as statements."""
    rows = [(f"fhir:{c}", "rdf:type", "owl:Class") for c, _ in vocab.CLASSES] + [(f"fhir:{c}", "rdfs:subClassOf", f"fhir:{p}") for c, p in vocab.CLASSES if p]
    return spark.createDataFrame(rows, "s string, p string, o string").withColumn("o_kind", F.lit("uri"))


def class_depths(spark) -> DataFrame:
    """Depth of every class in the hierarchy, by a recursive query (at most 20 levels)."""
    values = ", ".join(f"('{c}', {'NULL' if p is None else repr(p)})" for c, p in vocab.CLASSES)
    return spark.sql(f"""
      WITH RECURSIVE h(c, p) AS (SELECT * FROM VALUES {values} AS t(c, p)),
      d(c, depth) AS (SELECT c, 0 FROM h WHERE p IS NULL UNION ALL SELECT h.c, depth + 1 FROM d JOIN h ON h.p = d.c WHERE depth < 20)
      SELECT c AS class, depth FROM d""")


def inferred_class(entity: Column, kind: Column) -> Column:
    """The class an entity's name implies, else its type."""
    e = F.lower(entity)
    cases = [F.when(F.contains(e, F.lit(w)), c) for w, c in vocab.CLASS_WORDS]
    return F.coalesce(*cases, kind, F.lit("Resource"))


def property_usage(relations: DataFrame) -> DataFrame:
    """predicate, n, and its most common domain and range (ties by name). relations: predicate, subject_type, object_type."""
    r = relations.select("predicate", F.explode(F.array(F.struct(F.lit("domain").alias("side"), F.coalesce("subject_type", F.lit("")).alias("t")), F.struct(F.lit("range").alias("side"), F.coalesce("object_type", F.lit("")).alias("t")))).alias("x")).select("predicate", "x.*")
    c = r.groupBy("predicate", "side", "t").agg(F.count("*").alias("n"))
    best = c.groupBy("predicate").agg(F.sum(F.when(F.col("side") == "domain", F.col("n"))).alias("n"), *(F.min_by("t", F.when(F.col("side") == side, F.struct((-F.col("n")).alias("m"), "t"))).alias(side) for side in ("domain", "range")))
    return best


def schema_export(classes: DataFrame, usage: DataFrame) -> DataFrame:
    """The schema as OWL statements (s, p, o, o_kind): classes with label and parent, properties with label, commonest domain and range.

    classes: class, parent. usage: property_usage. Names become identifier parts; empty names state nothing.
    """
    def of(*triples: Column) -> Column:
        return F.array_compact(F.array(*triples))

    def name(c: str) -> Column:
        return F.concat(F.lit("kg:"), safe_uri(F.col(c)))

    c = classes.filter("coalesce(class, '') <> ''").select(F.explode(of(
        _s(name("class"), "rdf:type", F.lit("owl:Class"), "uri"), _s(name("class"), "rdfs:label", F.col("class"), "string"),
        _s(name("class"), "rdfs:subClassOf", name("parent"), "uri", F.coalesce("parent", F.lit("")) != ""),
    )).alias("t"))
    p = usage.filter("coalesce(predicate, '') <> ''").select(F.explode(of(
        _s(name("predicate"), "rdf:type", F.lit("owl:ObjectProperty"), "uri"), _s(name("predicate"), "rdfs:label", F.col("predicate"), "string"),
        _s(name("predicate"), "rdfs:domain", name("domain"), "uri", F.coalesce("domain", F.lit("")) != ""),
        _s(name("predicate"), "rdfs:range", name("range"), "uri", F.coalesce("range", F.lit("")) != ""),
    )).alias("t"))
    return c.unionByName(p).select("t.*").distinct()


def neighbourhood(edges: DataFrame, start: DataFrame, hops: int, least: int = 3) -> DataFrame:
    """Edges within `hops` of the start keys: src, dst, hop. Keys shorter than `least` are not expanded; an edge is reported at
    each hop that reaches it. The frontier is checkpointed each hop and holds every key once, however many edges a hub has."""
    both = edges.select(F.lower("src").alias("k"), "src", "dst", F.lower("dst").alias("next")).unionAll(edges.select(F.lower("dst").alias("k"), "src", "dst", F.lower("src").alias("next")))
    front = start.select(F.lower("key").alias("k")).distinct()
    seen, out = front, None
    for hop in range(1, hops + 1):
        hit = both.join(front, "k", "left_semi")
        found = hit.select("src", "dst").distinct().withColumn("hop", F.lit(hop))
        out = found if out is None else out.unionAll(found)
        if hop < hops:
            front = cut_lineage(hit.select(F.col("next").alias("k")).filter(F.length("k") >= least).distinct().join(seen, "k", "left_anti"))
            seen = seen.unionAll(front)
    return out


#: Features of an edge: the five layers, the trust they give, and how recent the fact is.
EDGE_FEATURES = ("grounding", "ontology", "schema", "temporal", "contradiction", "trust", "recency")


def trust_graph(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of claims: claim_id, entity, value, kind, anchor, trust and the five layers.

    nodes: node_id (dense, from 0, in the order nodes first appear: by claim, its entity before its value), node, trust (the
    highest of its claims as their entity, at least 0.5), kind (most voted as an entity, ties to the first seen; Unknown for a node that
    is a value only), first_claim. A node is longer than one character. edges: both ways between the two nodes of a claim, no loops:
    claim_id, src, dst, src_id, dst_id and EDGE_FEATURES (0.5 where a layer is missing).
    """
    e, v = F.lower(F.trim(F.coalesce("entity", F.lit("")))), F.lower(F.trim(F.coalesce("value", F.lit(""))))
    half = F.lit(0.5)
    ends = claims.withColumn("recency", recency(F.col("anchor"))).select("claim_id", "kind", e.alias("e"), v.alias("v"), *(F.coalesce(F.col(c), half).alias(c) for c in EDGE_FEATURES))
    parts = F.array(F.struct(F.col("e").alias("node"), F.lit(0).alias("pos")), F.struct(F.col("v").alias("node"), F.lit(1).alias("pos")))
    long = ends.select("claim_id", "trust", "kind", F.explode(parts).alias("x")).select("claim_id", "trust", "x.*", F.when(F.col("x.pos") == 0, F.coalesce("kind", F.lit("Unknown"))).alias("kind")).filter("length(node) > 1")
    votes = long.groupBy("node", "kind").agg(F.count("*").alias("n"), F.min(F.struct("claim_id", "pos")).alias("seen"), F.max(F.when(F.col("pos") == 0, F.col("trust"))).alias("trust"))
    order = F.when(F.col("kind").isNotNull(), F.struct((-F.col("n")).alias("m"), "seen"))
    nodes = votes.groupBy("node").agg(F.greatest(half, F.max("trust")).alias("trust"), F.coalesce(F.min_by("kind", order), F.lit("Unknown")).alias("kind"), F.min("seen").alias("seen"))
    nodes = nodes.select("node", "trust", "kind", F.col("seen.claim_id").alias("first_claim"), F.col("seen.pos").alias("pos"))
    nodes = cut_lineage(global_rank(nodes, ["first_claim", "pos"]).select((F.col("rank") - 1).alias("node_id"), "node", "trust", "kind", "first_claim"))
    one = ends.filter("length(e) > 1 and length(v) > 1 and e <> v")
    both = one.select("claim_id", *EDGE_FEATURES, F.explode(F.array(F.struct(F.col("e").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("e").alias("dst")))).alias("x")).select("claim_id", "x.src", "x.dst", *EDGE_FEATURES)
    ids = nodes.select("node", "node_id")
    edges = both.join(ids.toDF("src", "src_id"), "src").join(ids.toDF("dst", "dst_id"), "dst")
    return nodes, edges.select("claim_id", "src", "dst", "src_id", "dst_id", *EDGE_FEATURES)


def mapped_back(claims: DataFrame, propagated: DataFrame) -> DataFrame:
    """claim_id, trust, graph_trust: the propagated trust of the claim's entity, the claim's own where the graph has no such node."""
    key = F.lower(F.trim(F.coalesce("entity", F.lit(""))))
    nodes = propagated.select(F.col("node").alias("__node"), F.col("trust").alias("__trust"))
    return claims.withColumn("__key", key).join(nodes, F.col("__key") == F.col("__node"), "left").select("claim_id", "trust", F.coalesce("__trust", "trust").alias("graph_trust"))


def propagate(nodes: DataFrame, edges: DataFrame, rounds: int = 2, keep: float = 0.5) -> DataFrame:
    """Rounds of residual mean aggregation of trust over neighbours, edge-weighted. Partial sums are combined map-side at hubs."""
    state = nodes.select("node", "trust")
    for _ in range(rounds):
        got = edges.join(state.withColumnRenamed("node", "src").withColumnRenamed("trust", "t"), "src").groupBy("dst").agg((F.sum(F.col("t") * F.col("trust")) / F.sum("trust")).alias("m"))
        state = state.join(got.withColumnRenamed("dst", "node"), "node", "left").select("node", (keep * F.col("trust") + (1 - keep) * F.coalesce("m", "trust")).alias("trust"))
        state = cut_lineage(state)
    return state


def recency(anchor: Column, base_year: int = 2026) -> Column:
    """1 less 0.05 a year before the base year, within [0, 1]; 0.5 without a year."""
    y = F.regexp_extract(anchor, r"(19|20)\d{2}", 0).try_cast("int")
    # least and greatest pass over nulls, so the missing year is asked for first
    return F.when(y.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - 0.05 * (F.lit(base_year) - y))))
