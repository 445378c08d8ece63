"""Claims end to end on hand-worked tables: verdicts, fused trust, boosting, failures."""

import pytest

from factgate.operators import calibrate
from factgate.plans import claims as plans


@pytest.fixture
def tables(spark, tmp_path):
    """A folder with the claims given (triple_id, note_id, source, entity, attribute, value, evidence) and one note."""

    def write(rows):
        cols = "triple_id bigint, note_id bigint, source string, entity string, attribute string, value string, fhir_type string, temporal_start string, evidence_span string"
        spark.createDataFrame([(*r[:6], "Condition", None, r[6] if len(r) > 6 else None) for r in rows], cols).write.parquet(f"{tmp_path}/triples.parquet")
        spark.createDataFrame([(1, 1, 1, "anemia present")], "row_id bigint, note_id bigint, subject_id bigint, text string").write.parquet(f"{tmp_path}/notes_all.parquet")
        return str(tmp_path)

    return write


def test_every_claim_of_the_union_has_a_verdict(spark, tables):
    # another model's copy has the smaller id, with and without a note; one claim of one model alone
    d = tables([(1, 1, "model_b", "Anemia ", "status", "present"), (2, 1, "model_a", "anemia", "Status", "present"), (3, None, "model_c", "gout", None, None), (4, None, "model_a", "gout", None, ""), (5, 1, "model_a", "cough", "status", "present")])
    assert {r.claim_id: r.y for r in plans._scored(spark, d).collect()} == {2: 1, 4: 1, 5: 0}
    assert plans._scored(spark, d).count() == plans.w13_union(spark, d).count() == 3


def test_booster_has_all_its_trees(spark):
    df = spark.createDataFrame([([float(i % 7), float(i % 3)], i % 2) for i in range(60)], "f array<double>, y int")
    model = calibrate.fit_booster(df)
    assert model.getNumTrees == 200 and max(t.depth for t in model.trees) <= 3


def test_fifty_claims_of_a_note_are_fused(spark, tables):
    d = tables([(i, 1, "model_a", f"finding {i}", "status", "present") for i in range(60)])
    rows = plans.v10_fused(spark, d).collect()
    rule = {r.claim_id: r.trust for r in plans._validated(spark, d).collect()}
    want = {r.claim_id: round(0.4 * rule[r.claim_id] + 0.6 * r.agent, 4) if r.place <= 50 else rule[r.claim_id] for r in rows}
    assert len(rows) == 60 and {r.claim_id: r.fused for r in rows} == pytest.approx(want, abs=1e-4)
    assert sum(abs(r.fused - rule[r.claim_id]) > 1e-3 for r in rows) > 5


def test_failures_name_three_examples(spark, tables):
    d = tables([(i, 1, "model_a", "anemia", "status", "anemia") for i in (9, 4, 7, 5)] + [(1, 1, "model_a", "xy", "status", "none"), (2, 1, "model_a", "cough", "status", "anemia present")])
    got = {r.failure: (r.n, r.examples) for r in plans.e07_failures(spark, d).collect()}
    assert got["degenerate"] == (4, [4, 5, 7]) and got["vacuous"] == (1, [1])
