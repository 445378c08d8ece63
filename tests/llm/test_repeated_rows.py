"""Repeated rows, columns of any type and clashing names stay as they are."""

from factgate.llm import canonical


def test_repeated_rows_and_maps_survive(spark):
    canon = spark.createDataFrame([(1, "condition", "anemia", None), (2, "condition", "pneumonia", None)], "ref_id bigint, item_kind string, canon_name string, alt_name string")
    rows = spark.createDataFrame([("pneumonia", {"a": 1}, 7)] * 3 + [("anemia", None, 7), (None, None, 7)], "value string, tags map<string, int>, ref int")
    got = canonical.map_to_canonical(rows, canon).collect()
    assert sorted((r.value or "", r.ref_id, r.ref) for r in got) == [("", 0, 7), ("anemia", 1, 7)] + [("pneumonia", 2, 7)] * 3
