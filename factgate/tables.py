"""Table access by name under one directory, and size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_rows(df: DataFrame, limit: int, what: str) -> list:
    """Rows of a reference table on the driver; raises when it is larger than the stated bound."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows; it cannot be held on the driver")
    return rows


#: A side is broadcast only below this estimate of its bytes.
MAX_BYTES = 64 << 20


def _width(df: DataFrame) -> Column:
    """Estimated bytes of a row: the length of its texts, eight a number, eight an element."""
    out = F.lit(8)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            out = out + F.coalesce(F.octet_length(c), F.lit(0)) + 8
        elif kind in ("array", "map"):
            texts = "string" in f.dataType.simpleString()
            out = out + F.coalesce(F.octet_length(F.to_json(F.struct(c))) if texts else F.size(c) * 8, F.lit(0)) + 8
        else:
            out = out + 8
    return out.cast("bigint")


def is_small(df: DataFrame, max_rows: int) -> bool:
    """Whether a table has at most so many rows and MAX_BYTES of content; one distributed pass."""
    one = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(_width(df)), F.lit(0)).alias("b")).first()
    return one["n"] <= max_rows and one["b"] <= MAX_BYTES


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint only when rows and bytes are counted and small; otherwise a shuffled join (AQE splits skew)."""
    return F.broadcast(df) if is_small(df, max_rows) else df


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer splits than the cluster has cores, spread over them; larger tables stay as they are read.

    For operators that spend far more on a row than moving it costs. Columns not used are pruned before the move.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
