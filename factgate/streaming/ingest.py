"""Incremental claims and monitors on Structured Streaming; every transformation also takes a batch DataFrame."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgate.functions.clinical import known_concept
from factgate.operators.validate import temporal_score
from factgate.session import cut_lineage, ensure_checkpoint_dir


def stream_table(spark: SparkSession, path: str, files_a_batch: int = 64) -> DataFrame:
    """A folder or one file of Parquet as a stream with the schema it has now."""
    now = spark.read.parquet(path)
    reader = spark.readStream.schema(now.schema).option("maxFilesPerTrigger", files_a_batch)
    folder, _, name = path.rstrip("/").rpartition("/")
    if [f.rpartition("/")[2] for f in now.inputFiles()] == [name]:  # a stream reads folders, so the file is picked by its name
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def ingest(claims: DataFrame, delay: str = "7 days", threshold: float = 0.6) -> DataFrame:
    """Claims deduplicated by id inside the watermark and gated by what one claim alone shows.

    An id is remembered for `delay` after it arrived, so the state holds a week of ids, not all of them. A row that comes more than
    `delay` behind the newest one known a batch earlier is late and dropped; a batch DataFrame has no late rows.
    """
    once = claims.withWatermark("loaded_at", delay)
    once = once.dropDuplicatesWithinWatermark(["triple_id"]) if claims.isStreaming else once.dropDuplicates(["triple_id"])
    trust = F.round(0.5 * known_concept(F.col("entity"), F.col("fhir_type")) + 0.5 * temporal_score(F.col("temporal_start"), "2026-01-01"), 4)
    return once.select("triple_id", "note_id", "source", "loaded_at", trust.alias("trust")).withColumn("accepted", F.col("trust") >= threshold)


def admission_rates(gated: DataFrame, width: str = "30 days") -> DataFrame:
    """Share of accepted claims by tumbling window of arrival and source. In append mode a window comes out once the watermark passed its end."""
    w = gated.groupBy(F.window("loaded_at", width).alias("w"), "source").agg(F.count("*").alias("n"), F.count_if("accepted").alias("n_accepted"))
    return w.select(F.col("w.start").alias("start"), "source", "n", "n_accepted")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Sessions of each user: events no further apart than the gap. Times without a zone are read in the session's. In append mode a
    session comes out once the watermark, a day behind, passed its end."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day").groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select("user_id", F.col("w.start").alias("start"), "n", "total")


def finish(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all that is there now and gives its result as a table in the shared folder.

    mode 'append' keeps what every batch adds, 'complete' the last whole result. Offsets and results survive a lost driver; once the result
    is written down as a whole, the folder of the run is removed.
    """
    spark = stream.sparkSession
    at = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{at}/out" if mode == "complete" else f"{at}/out/batch={batch}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    out = cut_lineage(spark.read.schema(stream.schema).parquet(f"{at}/out"))
    folder = spark._jvm.org.apache.hadoop.fs.Path(at)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return out.drop("batch") if "batch" not in stream.columns else out
