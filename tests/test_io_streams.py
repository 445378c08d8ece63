import gzip
import io
import json
import zipfile

from factgate.sources import readers, writers
from factgate.streaming import ingest
from pyspark.sql import functions as F


def test_folders_annotations_results(spark, tmp_path):
    (tmp_path / "pdac_1.txt").write_text("  " + "note " * 40)
    (tmp_path / "pdac_2.txt").write_text("short")
    (tmp_path / "pdac_1.ann.txt").write_text("T1\tTEST 3 7\tscan\nT2\tOther 1 2\tx\nR1\tfoo\nT3\tProcedure 4 9;12 15\tleft arm\n")
    n = readers.note_folder(spark, str(tmp_path)).collect()
    assert [r.patient_id for r in n] == ["pdac_1"] and not n[0].text.startswith(" ")
    assert sorted((r.label, r.start, r.stop, r.text) for r in readers.annotations(spark, str(tmp_path)).collect()) == [("Procedure", 4, 9, "left arm"), ("TEST", 3, 7, "scan")]
    for m in ("m1", "m2"):
        (tmp_path / "by" / m).mkdir(parents=True)
        (tmp_path / "by" / m / "7.json").write_text(json.dumps({"triples": [{"entity": m, "value": "v"}] * (1 if m == "m1" else 0)}))
    got = sorted((r.model, r.note, r.entity) for r in readers.result_files(spark, str(tmp_path / "by")).collect())
    assert got == [("m1", "7", "m1"), ("m2", "7", None)]


def test_zip_csv_json_and_text_column(spark, tmp_path):
    b = io.BytesIO()
    with gzip.GzipFile(fileobj=b, mode="w") as g:
        g.write(b'ROW_ID,TEXT\n1,"a, long\nnote"\n2,b\n')
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("Data/NOTEEVENTS.csv.gz", b.getvalue())
    df = readers.csv_in_zip(spark, str(tmp_path / "x.zip"), "noteevents")
    assert [(r.row_id, r.text) for r in df.orderBy("row_id").collect()] == [("1", "a, long\nnote"), ("2", "b")]
    (tmp_path / "t.csv").write_text("A,B\n1,xx\n2,yyyyy\n")
    t = readers.csv_table(spark, str(tmp_path / "t.csv"))
    assert t.columns == ["a", "b"] and readers.text_column(t) == "b" and readers.text_column(df) == "text"
    (tmp_path / "n.jsonl").write_text('{"id": 1, "text": "x"}\nbroken\n')
    assert readers.json_notes(spark, str(tmp_path / "n.jsonl"), "id bigint, text string").filter("id = 1").count() == 1


def test_note_subsets(spark):
    n = spark.createDataFrame([(1, 1, 7, "c", "x" * 300), (2, 2, 7, "c", None), (3, 3, 7, "c", "s"), (4, 4, 8, "c", "x" * 201), (5, 5, None, "c", "x" * 250)], "row_id bigint, note_id bigint, subject_id bigint, category string, text string")
    d = spark.createDataFrame([(7, "174.1"), (7, "1749"), (8, "V10"), (None, "150")], "subject_id bigint, icd9_code string")
    assert {r.row_id for r in readers.frequent(n).collect()} == {1, 2, 3}
    assert {r.row_id for r in readers.long_texts(n).collect()} == {1, 4, 5}
    assert {r.row_id for r in readers.of_cohort(n, d).collect()} == {1, 2, 3, 4}
    n.createOrReplaceTempView("t_notes")
    d.createOrReplaceTempView("t_diag")
    assert [r.row_id for r in readers.warehouse_notes(spark, "t_diag", "t_notes", 140, 239).collect()] == [1]


def test_benchmark_and_questions(spark):
    b = spark.createDataFrame([(1, "Gout", "yes", "Yes", "no"), (1, "Flu", "yes", "yes", "yes"), (2, "x", "no", "yes", "no")], "row_id int, concept string, detection string, encounter string, negation string")
    assert [(r.row_id, r.concepts) for r in readers.benchmark_labels(b).collect()] == [(1, ["gout"])]
    assert readers.split_questions(spark.range(10), "id", 8).filter("part = 'test'").count() == 2


def test_sinks_and_resume(spark, tmp_path):
    f = spark.createDataFrame([(1, 0, "m", "a"), (2, 0, "m", "b")], "note_id bigint, pos int, model string, entity string")
    assert writers.unfinished(f, spark, str(tmp_path / "none"), "note_id").count() == 2
    writers.write_facts(f.filter("note_id = 1"), str(tmp_path / "f"), ["model"])
    assert [r.note_id for r in writers.unfinished(f, spark, str(tmp_path / "f"), "note_id").collect()] == [2]
    st = spark.createDataFrame([("kg:s", "kg:p", 'say "x"\nnow', "string"), ("kg:s", "kg:p", "kg:o", "uri"), ("kg:s", "kg:p", "1.5", "float")], "s string, p string, o string, o_kind string")
    writers.write_statements(st, str(tmp_path / "nt"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "nt")).collect()) == [
        '<urn:kg:s> <urn:kg:p> "1.5"^^<http://www.w3.org/2001/XMLSchema#float> .', '<urn:kg:s> <urn:kg:p> "say \\"x\\"\\nnow" .', "<urn:kg:s> <urn:kg:p> <urn:kg:o> .",
    ]
    writers.write_report(f.agg(F.count("*").alias("n")), str(tmp_path / "r"))
    writers.json_notes_out(f, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "r")).first().n == 2 and spark.read.json(str(tmp_path / "j")).count() == 2


def rows(df):
    return sorted(df.select(*sorted(df.columns)).collect(), key=str)


def test_streams_agree_with_batch(spark, tmp_path):
    t = spark.read.parquet("/root/testdata/sf0.001/triples.parquet")
    t.repartition(3).write.parquet(str(tmp_path / "t"))
    s = ingest.stream_table(spark, str(tmp_path / "t"))
    got = ingest.finish(ingest.ingest(s), "append")
    want = ingest.ingest(t)
    assert rows(got) == rows(want)  # collected: counting an exceptAll over dropDuplicates fails inside Spark 4.1.2
    rates = ingest.finish(ingest.admission_rates(ingest.ingest(ingest.stream_table(spark, str(tmp_path / "t")))), "complete")
    assert rows(rates) == rows(ingest.admission_rates(want)) and rates.agg(F.sum("n")).first()[0] == t.count()


def test_late_rows_are_dropped_and_open_windows_wait(spark, tmp_path):
    from datetime import datetime

    def part(rows):
        df = spark.createDataFrame([(i, 1, "model_a", "anemia", "x", "Condition", None, datetime(2020, 1, day)) for i, day in rows], "triple_id bigint, note_id bigint, source string, entity string, value string, fhir_type string, temporal_start string, loaded_at timestamp")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "late"))

    import time

    for rows_ in ([(1, 20), (2, 14)], [(6, 21)], [(3, 1), (1, 20), (4, 21), (5, 30)]):
        part(rows_)
        time.sleep(1.1)  # files are taken in the order they were written
    got = ingest.finish(ingest.ingest(ingest.stream_table(spark, str(tmp_path / "late"), 1)), "append")
    assert sorted(r.triple_id for r in got.collect()) == [1, 2, 4, 5, 6]  # 3 is late, 1 is known
    rates = ingest.finish(ingest.admission_rates(ingest.ingest(ingest.stream_table(spark, str(tmp_path / "late"), 1)), "5 days"), "append").collect()
    assert [(r.start.day, r.n) for r in rates] == [(14, 1)]  # later windows are still open


def test_registry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
