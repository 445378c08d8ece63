"""Sources: note folders, annotation files, delimited and JSON tables, archives, text-column discovery."""

from __future__ import annotations

import csv
import gzip
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Labels an annotation may carry, and names a text column may have.
LABELS = ("PROBLEM", "TEST", "TREATMENT", "ClinicalCondition", "Observation", "Condition", "Medication", "Procedure")
TEXT_NAMES = ("text", "note_text", "notes", "note", "report", "content", "discharge_summary")


def note_folder(spark: SparkSession, path: str, least: int = 100) -> DataFrame:
    """patient_id, file, text of the .txt files of a folder, trimmed; annotation files and texts under `least` characters are skipped."""
    df = spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.trim("value").alias("text"))
    df = df.filter(~F.col("file").endswith(".ann.txt") & (F.length("text") >= least))
    return df.select(F.regexp_replace("file", r"\.txt$", "").alias("patient_id"), "file", "text")


def annotations(spark: SparkSession, path: str, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """file, label, start, stop, text of standoff annotation lines: T lines of three tab fields with a known label; the first two offsets count."""
    lines = spark.read.option("pathGlobFilter", "*.ann*").option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_name").alias("file"), F.split("value", "\t", 3).alias("f"))
    lines = lines.filter((F.size("f") == 3) & F.col("f")[0].startswith("T"))
    nums = F.regexp_extract_all(F.regexp_replace(F.col("f")[1], r"^\S+", ""), F.lit(r"(\d+)"), 1)
    df = lines.select("file", F.regexp_extract(F.col("f")[1], r"^(\S+)", 1).alias("label"), F.get(nums, F.lit(0)).cast("int").alias("start"), F.get(nums, F.lit(1)).cast("int").alias("stop"), F.col("f")[2].alias("text"))
    return df.filter(F.col("label").isin(*labels) & F.col("stop").isNotNull())


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    """A delimited table (also gzipped) with lower-case names; every column is text, for the caller to cast."""
    df = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    return df.toDF(*[c.lower() for c in df.columns])


def csv_in_zip(spark: SparkSession, path: str, part: str) -> DataFrame:
    """The first member whose name contains `part` (any case), plain or gzipped CSV, out of one or more zip files.

    Archives are read by the tasks, one a file; rows stream out in slices of 10,000. Columns are the header's, lower case.
    """
    import pyspark.sql.types as T

    files = spark.read.format("binaryFile").load(path)

    def opened(content: bytes) -> csv.reader | None:
        z = zipfile.ZipFile(io.BytesIO(content))
        name = next((n for n in sorted(z.namelist()) if part.lower() in n.lower()), None)
        if name is None:
            return None
        raw = z.open(name)
        return csv.reader(io.TextIOWrapper(gzip.open(raw) if name.endswith(".gz") else raw, "utf-8", newline=""))

    def head(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for c in p["content"]:
                if (r := opened(c)) is not None:
                    yield pd.DataFrame({"names": [[x.lower() for x in next(r)]]})

    found = files.select("content").mapInPandas(head, "names array<string>").first()
    if found is None:
        raise FileNotFoundError(f"no member like {part}")
    names = list(found["names"])

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for c in p["content"]:
                r = opened(c)
                if r is None:
                    continue
                next(r)
                block: list[list[str]] = []
                for line in r:
                    block.append(line)
                    if len(block) == 10_000:
                        yield pd.DataFrame(block, columns=names)
                        block = []
                if block:
                    yield pd.DataFrame(block, columns=names)

    return files.select("content").mapInPandas(rows, T.StructType([T.StructField(n, T.StringType()) for n in names]))


def text_column(df: DataFrame) -> str:
    """The column that holds the notes: a usual name, else the string column that is longest on average (one aggregation)."""
    strings = [f.name for f in df.schema if f.dataType.typeName() == "string"]
    for n in TEXT_NAMES:
        for c in strings:
            if c.lower() == n:
                return c
    if not strings:
        raise ValueError("no string column")
    means = df.agg(*(F.coalesce(F.avg(F.length(c)), F.lit(0.0)).alias(c) for c in strings)).first()
    return max(strings, key=lambda c: means[c])


def json_notes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON-lines notes by a declared schema, so no pass infers it; unreadable lines are nulls in every column."""
    return spark.read.schema(schema).json(path)


def result_files(spark: SparkSession, path: str) -> DataFrame:
    """model, note, and one row per fact of per-note result files <model>/<id>.json with a list `triples`."""
    fact = "struct<entity:string,attribute:string,value:string,fhir_type:string,temporal_anchor:string,evidence_span:string>"
    df = spark.read.schema(f"triples array<{fact}>").option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
    where = F.col("_metadata.file_path")
    df = df.select(F.regexp_extract(where, r"([^/]+)/[^/]+\.json$", 1).alias("model"), F.regexp_extract(where, r"([^/]+)\.json$", 1).alias("note"), F.posexplode_outer("triples").alias("pos", "t"))
    return df.select("model", "note", "pos", "t.*")


def benchmark_labels(labels: DataFrame) -> DataFrame:
    """Concepts present per row of a labelled benchmark: detected, of this encounter, not negated."""
    yes = (F.lower("detection") == "yes") & (F.lower("encounter") == "yes") & (F.lower("negation") == "no")
    return labels.filter(yes).groupBy("row_id").agg(F.array_sort(F.collect_set(F.lower("concept"))).alias("concepts"))


def split_questions(questions: DataFrame, key: str, head: int) -> DataFrame:
    """Adds part: 'train' for the first `head` questions by key, else 'test'; the cut key is found by a top-k, not a global sort."""
    cut = questions.select(key).orderBy(key).limit(head).agg(F.max(key)).scalar()
    return questions.withColumn("part", F.when(F.col(key) <= cut, "train").otherwise("test"))


def frequent(notes: DataFrame, least: int = 3) -> DataFrame:
    """Notes of subjects with at least `least` notes; notes without a subject belong to none."""
    many = notes.filter("subject_id is not null").groupBy("subject_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return notes.join(many.select("subject_id"), "subject_id", "left_semi")


def of_cohort(notes: DataFrame, cohort: DataFrame) -> DataFrame:
    """Notes of a cohort of subjects (repeated members count once)."""
    return notes.join(cohort.select("subject_id"), "subject_id", "left_semi")


def long_texts(notes: DataFrame, least: int = 200) -> DataFrame:
    """Notes whose text has at least `least` characters; null texts have none."""
    return notes.filter(F.length("text") >= least)


def warehouse_notes(spark: SparkSession, diagnoses: str, notes: str, low: int, high: int, least: int = 200) -> DataFrame:
    """The warehouse form of the cohort scan, in SQL over two registered tables: distinct cohort keys joined to longer notes."""
    return spark.sql(
        """
        WITH cohort AS (SELECT DISTINCT subject_id FROM identifier(:d) WHERE try_cast(substr(trim(icd9_code), 1, 3) AS INT) BETWEEN :low AND :high)
        SELECT n.row_id, n.note_id, subject_id, n.category FROM cohort JOIN identifier(:n) AS n USING (subject_id) WHERE length(n.text) > :least
        """,
        {"d": diagnoses, "n": notes, "low": low, "high": high, "least": least},
    )
