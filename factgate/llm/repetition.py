"""Repetition inside a single document: the share of its words that lie in five-word phrases seen earlier in the same text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

PHRASE = 5
LEAST_SHARE = 0.3
_WORD = re.compile(r"[^\W_]+")


def repeated_words(text: str, phrase: int = PHRASE) -> tuple[int, int]:
    """(repeated words, words). A word is repeated if it lies in `phrase` words that also begin at an earlier word."""
    ws = _WORD.findall(text.lower())
    n = len(ws)
    if n <= phrase:
        return 0, n
    seen: set[tuple[str, ...]] = set()
    marked, upto = 0, 0  # words before `upto` are counted
    for i, g in enumerate(zip(*(ws[k:] for k in range(phrase)), strict=False)):
        if g in seen:
            marked += i + phrase - max(i, upto)
            upto = i + phrase
        else:
            seen.add(g)
    return marked, n


def repetition_share(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_repeated, share of each document.

    docs: doc_id, text. Map-only: no text leaves its task and memory is one text's phrases. Null and empty texts have no
    words and share 0. Repeated rows are measured each for itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [repeated_words(t) if t else (0, 0) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([n for _, n in got], pa.int64()), pa.array([m for m, _ in got], pa.int64()), pa.array([m / n if n else 0.0 for m, n in got], pa.float64())],
                names=["doc_id", "n_words", "n_repeated", "share"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_repeated bigint, share double")
