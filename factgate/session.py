"""Session factory and the few runtime services operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def make_session(app: str = "factgate", master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with AQE, UTC time and Kryo; `conf` overrides or extends."""
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
    }
    base |= conf
    return SparkSession.builder.master(master).appName(app).config(map=base).getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints that spark.checkpoint.dir names; on a local master without one, a temporary folder."""
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known:
        return known
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="factgate-ckpt-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: written to the shared folder, so a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
