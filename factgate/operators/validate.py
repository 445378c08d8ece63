"""Five validation layers, trust, gate, and the fused trust of rule and reviewer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgate import vocab
from factgate.functions.clinical import known_concept
from factgate.functions.match import grounded, scored, shaped
from factgate.functions.text import normalize, tokens
from factgate.operators.claims import first_of
from factgate.tables import broadcast_if_small

#: Distinct (kind, attribute) pairs that are broadcast to the claims.
MAX_PAIRS = 200_000
WEIGHTS = (0.30, 0.20, 0.15, 0.15, 0.20)
LAYERS = ("grounding", "ontology", "schema", "temporal", "contradiction")


def first_notes(notes: DataFrame) -> DataFrame:
    """One text per note_id: that of its smallest row_id."""
    return first_of(notes.select("row_id", "note_id", "subject_id", "text").filter("note_id is not null"), [F.col("note_id")], [F.col("row_id")])


def grounding(claims: DataFrame, notes: DataFrame) -> DataFrame:
    """Adds `grounding`: mean over the fields long enough to check of whether they lie in the note; 0.5 if none is."""
    plain = first_notes(notes).select(F.col("note_id").alias("nid"), normalize(F.coalesce("text", F.lit(""))).alias("note")).withColumn("note_tokens", tokens(F.col("note")))
    fields = (("entity", 2), ("value", 2), ("evidence", 5))
    df = claims.withColumns({f"__n_{c}": F.when(F.length(F.coalesce(F.col(c), F.lit(""))) > n, normalize(F.col(c))) for c, n in fields})
    df = df.join(plain, F.col("note_id") == F.col("nid"), "left")
    df = df.withColumns({f"__g_{c}": F.when(F.col(f"__n_{c}").isNotNull(), grounded(F.col(f"__n_{c}"), F.col("note"), F.col("note_tokens")).cast("int")) for c, _ in fields})
    n = sum((F.col(f"__g_{c}").isNotNull().cast("int") for c, _ in fields), F.lit(0))
    hits = sum((F.coalesce(f"__g_{c}", F.lit(0)) for c, _ in fields), F.lit(0))
    df = df.withColumn("grounding", F.when(n == 0, 0.5).otherwise(hits / n))
    return df.drop("nid", "note", "note_tokens", *(f"__{k}_{c}" for k in "ng" for c, _ in fields))


def schema_scores(claims: DataFrame) -> DataFrame:
    """kind, attribute, schema of each distinct pair: 0.5 for a type without a list, 1.0 if a listed attribute lies in the
    attribute or the reverse, 0.8 from a match of 0.5, else 0.3. The best over all listed attributes counts; an empty
    attribute is contained in every one.

    Pairs are scored once, against the fixed list as rows, however many claims hold them.
    """
    spark = claims.sparkSession
    listed = spark.createDataFrame([(t, n) for t, names in vocab.VALID_ATTRIBUTES.items() for n in names], "listed_kind string, name string")
    pairs = claims.select("kind", "attribute").distinct().withColumn("a", normalize(F.coalesce("attribute", F.lit(""))))
    listed = shaped(listed.withColumn("b", normalize(F.col("name"))), "b")
    x = scored(shaped(pairs, "a").join(F.broadcast(listed), F.col("kind") == F.col("listed_kind"), "left"), "a", "b", "score")
    inside = F.contains(F.col("a"), F.col("name")) | F.contains(F.col("name"), F.col("a"))
    best = F.when(F.col("name").isNull(), 0.5).when(inside, 1.0).when(F.col("score") >= 0.5, 0.8).otherwise(0.3)
    return x.groupBy("kind", "attribute").agg(F.max(best).alias("schema"))


def with_schema(claims: DataFrame) -> DataFrame:
    """Adds `schema` by joining the scored pairs; they are broadcast while a count shows them few."""
    s = schema_scores(claims).select(F.col("kind").alias("s_kind"), F.col("attribute").alias("s_attribute"), "schema")
    on = F.col("kind").eqNullSafe(F.col("s_kind")) & F.col("attribute").eqNullSafe(F.col("s_attribute"))
    return claims.join(broadcast_if_small(s, MAX_PAIRS), on, "left").drop("s_kind", "s_attribute")


def anchor_date(c: Column) -> Column:
    """A date in one of the plain formats month/day/year, year-month-day, month day, year, month-day-year; two-digit years pivot at 69."""
    from factgate.functions.dates import MONTH_RE, existing_date, month_number

    t = F.trim(c)
    num = r"^(\d{1,2})([/-])(\d{1,2})\2(\d{4}|\d{2})$"
    y = F.regexp_extract(t, num, 4)
    year = F.when(F.length(y) == 2, F.when(y.try_cast("int") < 69, y.try_cast("int") + 2000).otherwise(y.try_cast("int") + 1900)).otherwise(y.try_cast("int"))
    iso, named = r"^(\d{4})-(\d{1,2})-(\d{1,2})$", rf"(?i)^({MONTH_RE}) (\d{{1,2}}), (\d{{4}})$"
    return (
        F.when(t.rlike(num), existing_date(year, F.regexp_extract(t, num, 1), F.regexp_extract(t, num, 3)))
        .when(t.rlike(iso), existing_date(F.regexp_extract(t, iso, 1), F.regexp_extract(t, iso, 2), F.regexp_extract(t, iso, 3)))
        .when(t.rlike(named), existing_date(F.regexp_extract(t, named, 3), month_number(F.regexp_extract(t, named, 1)), F.regexp_extract(t, named, 2)))
    )


def temporal_score(anchor: Column, as_of: str, day: Column | None = None) -> Column:
    """0.7 without an anchor, 0.6 for one that is no plain date, 0.1 before 1900 or after as_of, 0.3 before 1980, else 1.

    day: the anchor's date where it is a column already, so that it is parsed once.
    """
    d = anchor_date(anchor) if day is None else day
    none = F.coalesce(F.lower(anchor), F.lit("")).isin("", "null", "none", "n/a")
    return F.when(none, 0.7).when(d.isNull(), 0.6).when((F.year(d) < 1900) | (d > F.lit(as_of).cast("date")), 0.1).when(F.year(d) < 1980, 0.3).otherwise(1.0)


def contradiction(claims: DataFrame) -> DataFrame:
    """Adds `contradiction`: 0.1 for opposite values, 0.5 for other conflicting values, 1.0 for none.

    Two claims conflict if they share note and non-empty anchor, their entities and attributes match from 0.6 and their values
    differ. The first conflicting claim by id decides. Claims are compared only inside (note, anchor); their distinct
    (entity, attribute, value) forms are compared, so repeated claims of a hot group cost nothing.
    """
    n = {c: normalize(F.coalesce(F.col(c), F.lit(""))) for c in ("entity", "attribute", "value")}
    plain = claims.select("claim_id", "note_id", "anchor", *(x.alias(f"n_{c}") for c, x in n.items()))
    held = F.coalesce("anchor", F.lit("")) != ""
    group = ["note_id", "anchor", "n_entity", "n_attribute", "n_value"]
    faces = plain.filter(held).groupBy(*group).agg(F.min("claim_id").alias("first"))
    faces = shaped(shaped(faces, "n_entity"), "n_attribute")
    left = faces.select(*(F.col(c).alias(f"l_{c}") for c in faces.columns if c != "first"))
    pairs = left.join(faces, (F.col("l_note_id") == F.col("note_id")) & (F.col("l_anchor") == F.col("anchor")) & (F.col("l_n_value") != F.col("n_value")))
    pairs = scored(pairs, "l_n_entity", "n_entity", "s_entity").filter("s_entity >= 0.6")
    pairs = scored(pairs, "l_n_attribute", "n_attribute", "s_attribute").filter("s_attribute >= 0.6")
    a, b = F.col("l_n_value"), F.col("n_value")
    opposite = F.lit(False)
    for p, q in vocab.OPPOSITES:
        opposite = opposite | (F.contains(a, F.lit(p)) & F.contains(b, F.lit(q))) | (F.contains(a, F.lit(q)) & F.contains(b, F.lit(p)))
    hit = pairs.withColumn("s", F.when(opposite, 0.1).otherwise(0.5)).groupBy(*(f"l_{c}" for c in group)).agg(F.min_by("s", "first").alias("s"))
    on = F.lit(True)
    for c in group:
        on = on & (F.col(c) == F.col(f"l_{c}"))
    scores = plain.join(hit, on, "left").select(F.col("claim_id").alias("cid"), F.coalesce("s", F.lit(1.0)).alias("contradiction"))
    return claims.join(scores, F.col("claim_id") == F.col("cid")).drop("cid")


def validate(claims: DataFrame, notes: DataFrame, as_of: str = "2026-01-01", weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Adds the five layers and `trust`, their weighted sum (4 places)."""
    df = with_schema(contradiction(grounding(claims, notes))).withColumn("__day", anchor_date(F.col("anchor")))
    df = df.withColumns({"ontology": known_concept(F.col("entity"), F.col("kind")), "temporal": temporal_score(F.col("anchor"), as_of, F.col("__day"))}).drop("__day")
    trust = sum((F.col(c) * w for c, w in zip(LAYERS, weights, strict=True)), F.lit(0.0))
    return df.withColumn("trust", F.round(trust, 4))


def gate(validated: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Adds `accepted`: trust (0.5 when missing) from the threshold on."""
    return validated.withColumn("accepted", F.coalesce("trust", F.lit(0.5)) >= threshold)


def layer_report(validated: DataFrame, by: Column) -> DataFrame:
    """Mean, least, share from 0.5 and share from 0.999 of every layer, by group and overall (rollup)."""
    long = validated.select(by.alias("grp"), F.explode(F.array(*[F.struct(F.lit(c).alias("layer"), F.col(c).alias("s")) for c in (*LAYERS, "trust")])).alias("x")).select("grp", "x.*")
    out = long.rollup("layer", "grp").agg(F.count("*").alias("n"), F.round(F.avg("s"), 3).alias("mean_score"), F.round(F.min("s"), 3).alias("least"), F.count_if(F.col("s") < 0.5).alias("n_below"), F.round(F.avg((F.col("s") >= 0.5).cast("int")), 4).alias("pass_half"), F.round(F.avg((F.col("s") >= 0.999).cast("int")), 4).alias("pass_full"), F.grouping("grp").cast("int").alias("is_all"))
    return out.filter("layer is not null")


def fused_trust(reviewed: DataFrame, per_note: int = 50) -> DataFrame:
    """Rule trust fused with a reviewer's for the most uncertain claims of each note.

    reviewed: note_id, claim_id, trust, r, c, j, xi. agent = clamp(.25 r + .25 c + .30 j - .20 xi); the `per_note` claims nearest to
    0.5 (ties by id) get .4 trust + .6 agent, the others keep the rule's.
    """
    agent = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.25 * F.col("r") + 0.25 * F.col("c") + 0.30 * F.col("j") - 0.20 * F.col("xi")))
    w = Window.partitionBy("note_id").orderBy(F.abs(F.col("trust") - 0.5), "claim_id")
    df = reviewed.withColumn("agent", F.round(agent, 4)).withColumn("place", F.row_number().over(w))
    return df.withColumn("fused", F.round(F.when(F.col("place") <= per_note, 0.4 * F.col("trust") + 0.6 * F.col("agent")).otherwise(F.col("trust")), 4))
