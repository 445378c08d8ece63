from datetime import datetime

from factgate.operators.orphans import bloom_words, maybe_in, orphan_references, orphan_report, validity
from pyspark.sql import functions as F


def d(day):
    return datetime(2020, 1, day) if day else None


def run(spark, child, parent):
    c = spark.createDataFrame([(i, k, d(t), "x") for i, k, t in child], "row_id bigint, key bigint, loaded_at timestamp, words string")
    p = spark.createDataFrame([(k, d(a), d(b), "x") for k, a, b in parent], "key bigint, loaded_at timestamp, deleted_at timestamp, first string")
    return orphan_references(c, p)


PARENT = [(1, 5, None), (2, 5, 10), (2, 8, 12), (2, 20, None), (3, 5, 9), (3, 5, 9), (4, None, None), (5, 7, 3), (None, 1, None)]


def test_statuses(spark):
    child = [(1, 1, 5), (2, 1, 4), (3, 2, 11), (4, 2, 12), (5, 2, 20), (6, 3, 9), (7, 9, 9), (8, None, 9), (9, 1, None), (10, 4, 9), (11, 5, 8), (12, 1, 4)]
    got = {r.row_id: r.status for r in run(spark, child, PARENT).collect()}
    assert got == {2: "late", 4: "deleted", 6: "deleted", 7: "missing", 9: "late", 10: "late", 11: "deleted", 12: "late"}
    assert orphan_report(run(spark, child, PARENT).withColumn("child_table", F.lit("c")).withColumn("ref_field", F.lit("key"))).agg(F.sum("n_rows")).first()[0] == 8


def test_shuffled_joins_say_the_same(spark, monkeypatch):
    from factgate.operators import orphans

    child = [(i, i % 11, 1 + i % 28) for i in range(200)]
    want = sorted((r.row_id, r.status) for r in run(spark, child, PARENT).collect())
    monkeypatch.setattr(orphans, "MAX_BROADCAST_ROWS", 0)
    assert sorted((r.row_id, r.status) for r in run(spark, child, PARENT).collect()) == want


def test_empty_sides(spark):
    assert run(spark, [], PARENT).count() == 0
    assert [(r.row_id, r.status) for r in run(spark, [(1, 1, 1)], []).collect()] == [(1, "missing")]


def test_filter_has_no_false_negative_and_few_false_positives(spark):
    keys = spark.range(0, 20000, 2).withColumnRenamed("id", "key")
    words, bits = bloom_words(keys, 10000)
    t = spark.range(20000).withColumn("m", maybe_in(words.scalar(), F.col("id"), bits))
    assert t.filter("id % 2 = 0 and not m").count() == 0
    assert t.filter("id % 2 = 1 and m").count() < 300


def test_overlapping_rows_become_one_interval(spark):
    p = spark.createDataFrame([(2, d(5), d(10)), (2, d(8), d(12)), (2, d(12), d(13)), (2, d(20), None)], "key bigint, loaded_at timestamp, deleted_at timestamp")
    assert sorted((r.start.day, r.stop.day) for r in validity(p).collect()) == [(5, 13), (20, 31)]
