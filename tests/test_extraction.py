"""Extraction chunk by chunk with the facts found before."""

import json

from factgate.operators import notes


def test_chunks_in_turn_see_earlier_facts_and_seeds(spark):
    rows = [(1, 1, "p1", ["gout", "flu"]), (1, 0, "p0", ["gout"]), (2, 0, "q0", ["Gout"]), (2, 1, "q1", None)]
    df = spark.createDataFrame(rows, "note_id bigint, chunk_no int, prompt string, mentions array<string>")

    def generate(prompts):
        return [json.dumps([{"entity": "gout", "attribute": "seen", "value": p.replace("\n", " ")}]) for p in prompts]

    got = {(r.note_id, r.chunk_no): r.value for r in notes.extract_in_turn(df, generate, ({"entity": "flu", "attribute": "a", "value": "b"},)).collect()}
    assert got == {(1, 0): "p0", (1, 1): "p1 Prior: (gout, seen, p0) Prior: (flu, a, b)", (2, 0): "q0", (2, 1): "q1"}
