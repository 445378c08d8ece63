"""Evidence that is reworded in the note."""

import pytest

from factgate.functions.mentions import near_window
from factgate.operators import timeline

NOTE = "Seen 3/4/2016. The patient  denies any severe\nchest pain at this time; follow up in two weeks."


def slow(evidence, text):
    """The rule as it is written: window by window."""
    words = evidence[:30].lower().split()
    return next((i for i in range(len(text) - 30) if words and sum(w in text[i : i + 50].lower() for w in words) >= len(words) * 0.6), -1)


@pytest.mark.parametrize("evidence", ["patient denies severe pain", "chest pain severe, denied", "no such words", "Seen 3/4/2016", "weeks two in up", "a a a zz", " ", "The The zebra"])
def test_first_window(evidence):
    assert near_window(evidence, NOTE.lower()) == slow(evidence, NOTE)
    assert near_window(evidence, "short") == -1


def test_reworded_evidence_is_dated(spark):
    claims = spark.createDataFrame([(1, 1, None, "patient denies severe chest pain"), (2, 1, None, "the patient  denies"), (3, 1, None, "zebra stripes only"), (4, 1, None, None)], "claim_id bigint, note_id bigint, anchor string, evidence string")
    notes = spark.createDataFrame([(1, NOTE)], "note_id bigint, text string")
    dates = spark.createDataFrame([(1, "3/4/2016", "2016-03-04", 5, 13, "absolute")], "note_id bigint, raw string, form string, start int, stop int, kind string")
    got = {r.claim_id: (r.date_form, r.date_kind) for r in timeline.anchored(claims, notes, dates).collect()}
    assert got == {1: ("2016-03-04", "inferred_proximity"), 2: ("2016-03-04", "inferred_proximity"), 3: (None, "none"), 4: (None, "none")}
