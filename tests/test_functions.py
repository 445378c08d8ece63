"""Hand-worked cases of the column functions and operators."""

import math

import pytest

from factgate.functions import clinical, match
from factgate.functions.mentions import chunk_paragraphs, date_form, date_mentions, salvage
from factgate.functions.text import normalize
from factgate.operators import calibrate, claims, ehr, notes, rdf, retrieval, timeline, validate
from pyspark.sql import functions as F


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols))
    return df.select(expr.alias("x")).first().x


def test_texts(spark):
    assert one(spark, normalize(F.col("a")), a="  HER2-neu,  (+)  ") == "her2 neu"
    assert one(spark, clinical.safe_uri(F.col("a")), a="chest  pain (left)!") == "chest_pain_left"
    assert one(spark, clinical.scrub_phi(F.col("a")), a="seen by ___ today") == "seen by REDACTED today"
    assert one(spark, clinical.is_phi(F.col("a")), a="[Known lastname 12]") is True
    assert [one(spark, clinical.is_vacuous(F.col("a")), a=x) for x in ("Year", "ab", "123", "anemia")] == [True, True, True, False]
    assert one(spark, clinical.negated(F.col("a")), a="Positive nodes") == "negative nodes"
    assert one(spark, clinical.code_of(F.col("a")), a="Stage II Breast Cancer") == "SNOMED:254837009"
    assert [one(spark, clinical.miss_bucket(F.col("a")), a=x) for x in ("VITALS", "5 mg", "the mass", "IHC", "breast lump")] == ["section_header", "lab_fragment", "anaphora", "abbreviation", "substantive"]


@pytest.mark.parametrize(("a", "b", "want"), [("pain", "Pain!", 1.0), ("chest pain", "pain", 0.9), ("htn", "hypertension", 0.85), ("red big house", "big red house", 1.0), ("a1 b2 c3 d4 e5 f6", "b2 a1 zz", 2 / 3 * 0.8), ("x", "", 0.0)])
def test_match(spark, a, b, want):
    assert one(spark, match.match_score(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(want)


def test_types(spark):
    rows = [("Drug", ""), ("zzz", "dose"), ("zzz", "q"), ("", ""), ("Lab Result", ""), ("finding", "")]
    df = spark.createDataFrame(rows, "r string, a string")
    got = df.select(clinical.type_a(F.col("r"), F.col("a")), clinical.type_b(F.col("r")), clinical.type_c(F.col("r"))).collect()
    assert [g[0] for g in got[:3]] == ["MedicationStatement", "MedicationStatement", "Observation"]
    assert [g[1] for g in got[3:]] == ["Observation", "Observation", "Condition"]
    assert got[5][2] == "Observation" and got[0][2] == "MedicationStatement"


def test_dates_and_chunks():
    assert [date_form(x) for x in ("3/4/16", "3/4/51", "September 2016", "Oct 25")] == ["2016-03-04", "1951-03-04", "2016-09", "????-10-25"]
    found = date_mentions("seen September 17, 2016, 3 weeks ago")
    assert len([d for d in found if d[4] == "absolute" and d[2] == 5]) == 2 and found[-1][4] == "relative_past"
    assert [x[1] - x[0] for x in chunk_paragraphs("aaa\nbbb\n" + "c" * 20 + "\nd", 8)] == [7, 20, 1]


def test_salvage():
    assert len(salvage('```json\n[{"entity":"a"}]\n```')) == 1 and salvage('{"triples": [{"entity":"b"}]}')[0]["entity"] == "b"
    assert len(salvage('[{"entity":"a"},{"entity":')) == 1 and salvage('x {"entity":"a"} y') == [] and salvage(None) == []


def test_negation_window(spark):
    a, p = clinical.positive_mentions(F.col("a"), "edema")
    assert (one(spark, a, a="no evidence of edema. edema present"), one(spark, p, a="no evidence of edema. edema present")) == (2, 0)
    assert (one(spark, a, a=None), one(spark, p, a="edema present, far later edema")) == (0, 2)


def test_temporal_layer(spark):
    got = [one(spark, validate.temporal_score(F.col("a"), "2026-01-01"), a=x) for x in ("null", "after 3 cycles", "1975-05-01", "1850-01-01", "2016-09-17", "2027-01-01", None, "2016-02-30")]
    assert got == [0.7, 0.6, 0.3, 0.1, 1.0, 0.1, 0.7, 0.6]


CLAIM = "claim_id bigint, note_id bigint, model string, entity string, attribute string, value string, kind string, anchor string, evidence string"


def test_contradiction_and_grounding(spark):
    rows = [(1, 1, "a", "gout", "status", "positive", "Condition", "2020", ""), (2, 1, "a", "gout", "status", "negative", "Condition", "2020", ""), (3, 1, "a", "cyst", "size", "red", "Condition", "2020", None), (4, 1, "a", "cyst", "size", "blue", "Condition", "2020", None), (5, 1, "a", "gout", "status", "negative", "x", "", None), (6, None, None, None, None, None, None, "2020", None), (7, 1, "a", "rod blue green", "x", "", "x", "", "")]
    c = spark.createDataFrame(rows, CLAIM)
    assert {r.claim_id: r.contradiction for r in validate.contradiction(c).collect()} == {1: 0.1, 2: 0.1, 3: 0.5, 4: 0.5, 5: 1.0, 6: 1.0, 7: 1.0}
    n = spark.createDataFrame([(1, 1, None, "the blue rod was shipped")], "row_id bigint, note_id bigint, subject_id bigint, text string")
    g = {r.claim_id: r.grounding for r in validate.grounding(c, n).collect()}
    assert g[7] == 1.0 and g[6] == 0.5 and len(g) == 7
    assert validate.validate(c.limit(0), n).count() == 0


def test_cleaning(spark):
    rows = [(1, 1, "a", "year", "age", "84", "Age", None, None), (2, 1, "a", "gout", "has_history", "Gout", "Condition", None, "x ___ y"), (3, 1, "a", "gout", "x", "gout", "Problem", None, None), (4, 1, "a", "[name]", "x", "y", "", None, None), (5, 1, "a", "it", "x", "y", "", None, None), (6, 1, "a", "nurse call", "x", "y", "Provider", None, None), (7, 1, "b", "GOUT ", "x", " gout", "problem", None, None)]
    c = claims.clean(spark.createDataFrame(rows, CLAIM))
    got = {r.claim_id: r for r in c.collect()}
    assert (got[1].entity, got[1].kind, got[1].recast) == ("Patient", "Patient", True)
    assert (got[2].value, got[3].value, got[2].evidence) == ("history", "present", "x REDACTED y")
    assert [got[i].drop_reason for i in (4, 5, 6)] == ["phi", "vacuous", "admin"]
    assert {r.claim_id for r in claims.canonical_dedup(c).collect()} == {1, 2, 3}
    assert claims.cleaning_report(c).first().n_deduped == 1


def test_calibration(spark):
    s = spark.createDataFrame([(1, 0.9, 1), (2, 0.8, 1), (3, 0.7, 0), (4, 0.6, 1)], "id bigint, score double, y int")
    curve = calibrate.risk_coverage(s, "id")
    assert calibrate.coverage_at(curve, [0.95]).first().coverage == 0.5
    assert calibrate.aurc(curve).first().aurc == pytest.approx((0 + 1 / 6 + (1 / 3 + 1 / 4) / 2) / 4)
    b = calibrate.bands(s, s, "id", [0.95]).first()
    assert (b.tau_high, b.tau_low, b.n_insert, b.n_review, b.n_reject) == (0.8, 0.7, 2, 1, 1)
    e = spark.createDataFrame([(0.95, 1), (0.85, 1), (0.15, 0)], "score double, y int")
    assert calibrate.ece(e).first().ece == pytest.approx(0.35 / 3)


def test_global_rank_is_a_rank(spark):
    df = spark.range(1000).select(F.pmod(F.col("id") * 7919, F.lit(1000)).alias("id"))
    got = calibrate.running(df, ["id"], {"total": F.col("id")}).collect()
    assert all(r.rank == r.id + 1 and r.total == r.id * (r.id + 1) // 2 for r in got) and len(got) == 1000


def test_growth(spark):
    d = spark.createDataFrame([(1, 10, "a"), (1, 10, "b"), (1, 11, "b"), (1, 11, "c"), (1, 11, "d")], "subject_id bigint, hadm_id bigint, icd9_code string")
    a = spark.createDataFrame([(1, 1, 10, "01/02/2020 10:00"), (2, 1, 11, "2020-01-09 08:00"), (3, 1, 11, "2019-03-01 08:00")], "row_id bigint, subject_id bigint, hadm_id bigint, admittime string")
    a = a.withColumn("site_id", F.lit(1)).withColumn("loaded_at", F.lit("2020-02-01").cast("timestamp"))
    adm = ehr.admissions_once(a, spark.createDataFrame([(1, "UTC", "mdy")], "site_id int, tz string, date_order string"))
    assert sorted((r.hadm_id, r["at"]) for r in adm.collect()) == [(10, "2020-01-02T10:00:00.000000Z"), (11, "2020-01-09T08:00:00.000000Z")]
    g = ehr.code_growth(d, adm)
    assert sorted((r.nth, r.n_codes) for r in g.collect()) == [(1, 2), (2, 4)] and ehr.growth(g, 2).first().growth == 1.0


def test_neoplasm_codes(spark):
    rows = spark.createDataFrame([("C50.9", 10), ("c18", 10), ("1629", 9), ("V10", 9), ("2090", 9), ("174", 10), (None, 9)], "code string, version int")
    got = rows.select(ehr.neoplasm_codes(F.col("code"), F.col("version")).alias("all"), ehr.neoplasm_codes(F.col("code"), F.col("version"), (162,), ("C50",)).alias("some")).collect()
    assert [r.all for r in got] == [True, True, True, False, False, False, False] and [r.some for r in got] == [True, False, True, False, False, False, False]


def test_lines_of_statements_parse(spark):
    st = spark.createDataFrame([("kg:a b", "kg:said", 'x "y"\n\\z', "string"), ("kg:a", "rdf:type", "fhir:Condition", "uri"), ("kg:a", "kg:n", "1.5", "float")], "s string, p string, o string, o_kind string")
    got = sorted(r.value for r in rdf.ntriples(st).collect())
    assert got == sorted([
        '<urn:kg:a%20b> <urn:kg:said> "x \\"y\\"\\n\\\\z" .',
        "<urn:kg:a> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://hl7.org/fhir/Condition> .",
        '<urn:kg:a> <urn:kg:n> "1.5"^^<http://www.w3.org/2001/XMLSchema#float> .',
    ])


def test_graph(spark):
    e = spark.createDataFrame([("aaa", "bbb"), ("bbb", "ccc")], "src string, dst string")
    s = spark.createDataFrame([("AAA",)], "key string")
    assert rdf.neighbourhood(e, s, 1).count() == 1 and rdf.neighbourhood(e, s, 2).count() == 3
    assert {r["class"]: r.depth for r in rdf.class_depths(spark).collect()}["BreastCancer"] == 3
    assert [one(spark, rdf.recency(F.col("a")), a=x) for x in ("2026-01", "2016-01", "????-10-25")] == [1.0, 0.5, 0.5]


def test_snapshot(spark):
    r = spark.createDataFrame([(1, "2020", None), (2, "2022", None), (3, "2020", "2021"), (4, None, None), (5, "none", "null")], "id int, temporal_start string, temporal_end string")
    assert {x.id for x in timeline.snapshot(r, "2021").collect()} == {1, 4, 5}


def test_nearest_dates(spark):
    d = spark.createDataFrame([(1, "x", "2020-01-01", 100, 110, "absolute"), (1, "y", "2021-01-01", 300, 310, "absolute"), (1, "z", "now", 190, 193, "current")], "note_id bigint, raw string, form string, start int, stop int, kind string")
    p = spark.createDataFrame([(1, 1, 190), (2, 1, 210), (3, 1, 200), (4, 1, 900), (5, 2, 100)], "claim_id bigint, note_id bigint, at int")
    assert {r.claim_id: r.form for r in timeline.nearest_dates(p, d).collect()} == {1: "2020-01-01", 2: "2021-01-01", 3: "2020-01-01"}


def test_sections_as_of(spark):
    n = spark.createDataFrame([(1, "HPI: cough. Medications: aspirin. cough"), (2, None)], "note_id bigint, text string")
    m = notes.with_section(notes.find_terms(n, ["cough", "aspirin"]), notes.sections(n))
    assert sorted((r.start, r.section) for r in m.collect()) == [(5, "HPI"), (25, "MEDICATIONS"), (34, "MEDICATIONS")]


def test_dense_is_exact_in_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 4))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "vec_id bigint, v array<double>")
    q = df.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    monkeypatch.setattr(retrieval, "MAX_SMALL", 2)
    got = {(r.query_id, r.place): r.vec_id for r in retrieval.dense(q, df, 3).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for i in range(0, 60, 10):
        s = np.round(u @ u[i], 6)
        s[i] = -9
        assert [got[i, k + 1] for k in range(3)] == sorted(range(60), key=lambda j: (-s[j], j))[:3]


def test_fusion(spark):
    df = spark.createDataFrame([(0.0, None, 0), (3.0, 1.0, 5)], "s double, d double, n int")
    assert [r.f for r in df.select(retrieval.fuse(F.col("s"), F.col("d"), F.col("n")).alias("f")).collect()] == [0.0, pytest.approx(0.3 * 0.75 + 0.5 + 0.2)]


def test_proper_scores(spark):
    r = calibrate.proper_scores(spark.createDataFrame([(1.0, 0), (0.5, 1)], "score double, y int")).first()
    assert r.brier == pytest.approx(0.625) and r.nll == pytest.approx((-math.log(1e-6) - math.log(0.5)) / 2)
