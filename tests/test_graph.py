"""The statement graph on hand-worked tables: dated events."""

import itertools

import pytest

from factgate.operators import rdf
from factgate.plans import graph


@pytest.fixture
def tables(spark, tmp_path):
    """A folder with the claims given (note_id, entity, attribute, value, anchor); note n is of subject n."""

    def write(rows):
        cols = "triple_id bigint, note_id bigint, source string, entity string, attribute string, value string, fhir_type string, temporal_start string, evidence_span string"
        spark.createDataFrame([(i, n, "model_a", e, a, v, "Condition", t, None) for i, (n, e, a, v, t) in enumerate(rows)], cols).write.parquet(f"{tmp_path}/triples.parquet")
        notes = [(n, n, n, "text") for n in sorted({r[0] for r in rows})]
        spark.createDataFrame(notes, "row_id bigint, note_id bigint, subject_id bigint, text string").write.parquet(f"{tmp_path}/notes_all.parquet")
        return str(tmp_path)

    return write


def found(df):
    return sorted(tuple(r) for r in df.select("patient", "label", "time").collect())


@pytest.mark.parametrize("block", [1, 3, 300])
def test_dated_events_of_a_shared_entity(spark, tables, monkeypatch, block):
    monkeypatch.setattr(rdf, "BLOCK", block)
    monkeypatch.setattr(rdf, "SMALL_TASK", 40)
    rows = [(n, "Gout" if n % 2 else "Gout.", "status", f"v{n}", f"2019-01-0{n}") for n in range(1, 9)]  # two labels of one entity
    # a date twice, as text and as a number; one too short, one redacted, none; an entity without any date
    rows += [(9, "Gout", "temporalAnchor", "2018", "2018"), (9, "Gout", "stage", "a", "9"), (9, "Gout", "stage", "b", "[**2019-7**]"), (9, "Gout", "stage", "c", None)]
    rows += [(1, "Cough", "status", "dry", None), (2, "Fever", "status", "high", "2020-02-02")]
    df = graph.g09_dated(spark, tables(rows))
    times = [*(f"2019-01-0{n}" for n in range(1, 9)), "2018"]
    want = [(f"patient:s{p}", e, t) for p, e, t in itertools.product(range(1, 10), ("Gout", "Gout."), times)]
    assert found(df) == sorted([*want, ("patient:s2", "Fever", "2020-02-02")])
    assert df.schema.simpleString() == "struct<patient:string,label:string,time:string>"


def test_dated_events_are_not_moved_once_they_are_written_out(spark, tables):
    plan = graph.g09_dated(spark, tables([(1, "Gout", "status", "x", "2019-01-01")]))._jdf.queryExecution().executedPlan().toString()
    last = plan[: plan.index("Generate explode")]
    assert "Exchange" not in last and "Aggregate" not in last and "Sort" not in last


def test_dated_events_of_one_entity_are_spread_over_tasks(spark, tables, monkeypatch):
    monkeypatch.setattr(rdf, "BLOCK", 5)
    monkeypatch.setattr(rdf, "SMALL_TASK", 100)
    rows = [(n, "Gout", "status", f"v{n}", f"2019-01-{n:02d}") for n in range(1, 31)]
    df = graph.g09_dated(spark, tables(rows))
    n = df.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()
    assert sum(n) == 900 and max(n) < 450


def test_spaces_of_any_kind_are_cut_off_names(spark, tables):
    rows = [(1, "Gout", "status", "mild", "2019-01-01"), (2, "Gout\u00a0\u2009", "status", "mild\u3000", "2019-01-02\u00a0"), (3, "\u2009No\u00a0grip ", "status", "x", "2019-01-03")]
    times = ("2019-01-01", "2019-01-02")
    assert found(graph.g09_dated(spark, tables(rows))) == sorted([*((f"patient:s{p}", "Gout", t) for p in (1, 2) for t in times), ("patient:s3", "No\u00a0grip", "2019-01-03")])
