"""Context of prompts, retried generators, the table function, and lower case that keeps offsets."""

from pyspark.sql import functions as F

from factgate.operators import notes, timeline

NOTES = "note_id bigint, text string"


def test_offsets_survive_letters_that_grow(spark):
    n = spark.createDataFrame([(1, "\u0130 Chest pain seen, chest painful"), (2, ""), (3, None)], NOTES)
    got = notes.find_terms(n, ["chest pain"]).collect()
    assert [(r.text, r.start, r.stop) for r in got] == [("Chest pain", 2, 12)]


def test_a_failing_generator_is_asked_again():
    calls = []

    def shaky(prompts):
        calls.append(len(prompts))
        if len(prompts) > 1 or prompts == ["bad"]:
            raise RuntimeError
        return [p.upper() for p in prompts]

    assert notes.answers_of(shaky, ["a", "bad", "b"], 2) == ["A", "", "B"] and calls.count(3) == 2
    assert notes.answers_of(lambda p: p[:1], ["a"], 1) == ["a"] and notes.answers_of(lambda p: [], ["a"], 1) == [""]


def test_context_lists_good_hits_in_order(spark):
    m = spark.createDataFrame([(1, 0, "anemia", 2), (1, 0, "gout", 1), (1, 1, "rash", 1)], "note_id bigint, chunk_no int, term string, place int")
    h = spark.createDataFrame([("anemia", "Anemia NOS", "285.9", 2.0, 1), ("gout", "Gout", "274", 0.9, 1), ("gout", "Gouty", "274.1", 0.4, 2), ("gout", "x", "y", 3.0, 3)], "term string, title string, code string, score double, place int")
    got = notes.ontology_context(m, h).collect()
    assert [(r.note_id, r.chunk_no) for r in got] == [(1, 0)]
    assert got[0].context.split("\n")[1:] == ['  - "Gout" [274] (matched: "gout")', '  - "Anemia NOS" [285.9] (matched: "anemia")']


def test_the_table_function_agrees_with_the_operator(spark):
    n = spark.createDataFrame([(1, "a" * 30 + "\n" + "b" * 30 + "\n\nc"), (2, ""), (3, None)], NOTES)
    name = notes.register_chunk_note(spark)
    got = spark.sql(f"SELECT note_id, c.* FROM {{n}}, LATERAL {name}(text, 40) AS c", n=n)
    assert sorted(map(tuple, got.collect())) == sorted((r.note_id, r.chunk_no, r.start, r.stop) for r in notes.chunks(n, 40).collect())


def test_changes_in_time_order(spark):
    r = spark.createDataFrame([(1, "s", "p", "b", "2020"), (2, "s", "p", "a", None), (3, "s", "q", "a", "2019"), (4, "s", "p", "b", "2018")], "relation_id bigint, subject string, predicate string, object string, temporal_start string")
    assert [(x.nth, x.temporal_start, x.object) for x in timeline.change_timeline(r).orderBy("nth").collect()] == [(1, "", "a"), (2, "2018", "b"), (3, "2020", "b")]
    keys = spark.createDataFrame([("B",), ("zzz",)], "key string")
    assert [(x.key, x.nth, x.relation_id) for x in timeline.about(r, keys).orderBy("nth").collect()] == [("b", 1, 4), ("b", 2, 1)]
    assert timeline.about(r, keys.filter(F.col("key") == "zzz")).count() == 0
