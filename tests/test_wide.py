from datetime import date

from factgate.operators.wide import to_wide, wide_issues

CAT = [("weight", "X", "float", "kg"), ("stay", "X", "int", "days"), ("alive", "X", "boolean", None), ("seen", "X", "date", None), ("ward", "X", "string", None), ("entity", "X", "int", None), ("Big Name", "X", "int", None)]


def run(spark, rows):
    t = spark.createDataFrame(rows, "entity string, attribute string, value string, issues string") if rows else spark.createDataFrame([], "entity string, attribute string, value string, issues string")
    return to_wide(t, spark.createDataFrame(CAT, "attribute string, entity_kind string, value_type string, unit_name string"))


def test_types_names_and_issues(spark):
    rows = [
        (" A-1", "Weight ", "+1,234.50 KG"), ("a 1", "weight", "1.2345e3"), ("a_1", "stay", "1e1days"), ("a_1", "Alive", "Y"),
        ("a_1", "seen", "31-Jan-2020"), ("a_1", "seen", "January 31, 2020"), ("a_1", "seen", "2020/1/31"), ("a_1", "ward", "  East   Wing "),
        ("a_1", "ward", "east wing"), ("a_1", "entity", "7"), ("a_1", "big-name", "9007199254740993"), ("a_1", "unlisted", "u"),
        ("b", "weight", "3,5"), ("b", "stay", "1.5"), ("b", "alive", "maybe"), ("b", "seen", "30 February 2020"), ("b", "ward", None),
        ("c", "stay", "5"), ("c", "stay", "6"), ("c", "alive", "1"), ("c", "alive", "unk"), ("c", "weight", "N/A"), ("c", "weight", "1e999"),
        ("d", "weight", "none"), (None, "weight", "1"), ("", "weight", "1"), ("e", None, "1"),
    ]
    w = run(spark, [(*r, "clash") for r in rows])
    got = {r.entity: r for r in w.collect()}
    assert set(got) == {"a_1", "b", "c", "d"}
    a = got["a_1"]
    assert (a.weight, a.stay, a.alive, a.seen, a.entity_value, a.big_name) == (1234.5, 10, True, date(2020, 1, 31), 7, 9007199254740993)
    assert a.ward == "East   Wing" and a.others == {"unlisted": "u"} and a.issues == []
    assert {(r.entity, r.attribute, r.issue) for r in wide_issues(w).collect()} == {
        ("b", "weight", "unreadable"), ("b", "stay", "unreadable"), ("b", "alive", "unreadable"), ("b", "seen", "unreadable"),
        ("c", "stay", "conflict"), ("c", "weight", "unreadable"),
    }
    assert got["c"].stay is None and got["c"].alive is True and got["d"].weight is None


def test_empty_and_many_entities_across_batches(spark):
    assert run(spark, []).count() == 0
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(f"e{i:03d}", a, str(i), None) for i in range(150) for a in ("stay", "weight", "ward")]
        got = run(spark, rows).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 150 and all(r.stay == int(r.entity[1:]) == r.weight and r.ward == str(r.stay) for r in got)


def test_one_entity_with_a_third_of_all_rows(spark):
    rows = [("hot", "stay", "4", None)] * 3000 + [(f"e{i}", "stay", "1", None) for i in range(6000)]
    got = {r.entity: r.stay for r in run(spark, rows).collect()}
    assert len(got) == 6001 and got["hot"] == 4
