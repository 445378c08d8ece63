"""Sinks: partitioned facts with resume, statement text, report rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgate.operators.rdf import ntriples


def write_facts(facts: DataFrame, path: str, by: list[str], mode: str = "append") -> None:
    """Facts as Parquet partitioned by run columns; rows of one partition value are written together."""
    facts.repartition(*by).write.mode(mode).partitionBy(*by).parquet(path)


def unfinished(todo: DataFrame, spark: SparkSession, path: str, key: str) -> DataFrame:
    """Rows of todo whose key the output folder does not hold yet; all of them if there is no output."""
    try:
        done = spark.read.parquet(path).select(key).distinct()
    except Exception as e:  # noqa: BLE001 - any other failure is raised again
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return todo
        raise
    return todo.join(done, key, "left_anti")


def write_statements(statements: DataFrame, path: str) -> None:
    """One line per statement, written by all tasks."""
    ntriples(statements).write.mode("overwrite").text(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report of few rows as one JSON file."""
    report.coalesce(1).write.mode("overwrite").json(path)


def json_notes_out(facts: DataFrame, path: str) -> None:
    """One JSON object a note with its facts in order; a note's facts are bounded by its text."""
    cols = [c for c in facts.columns if c not in ("note_id", "pos")]
    facts.groupBy("note_id").agg(F.array_sort(F.collect_list(F.struct("pos", *cols))).alias("triples")).write.mode("overwrite").json(path)
