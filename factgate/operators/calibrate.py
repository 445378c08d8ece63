"""Calibration and selective admission, with global ranks and running sums that never sort all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgate.session import cut_lineage, ensure_checkpoint_dir


def _ranged(df: DataFrame, order: list[str], descending: bool) -> DataFrame:
    """Rows range-partitioned by the order, each with its partition's number. Checkpointed, as range bounds come from a sample
    and must be the same for every reader."""
    cols = [F.desc(c) if descending and i == 0 else F.asc(c) for i, c in enumerate(order)]
    return cut_lineage(df.repartitionByRange(*cols).withColumn("__part", F.spark_partition_id()))


def running(df: DataFrame, order: list[str], sums: dict[str, Column], descending: bool = False) -> DataFrame:
    """Adds `rank` (from 1) and running sums over the whole table in the order given; it must end in a unique column.

    Sums inside a range partition plus the totals of the partitions before it: two passes over small state instead of one
    window over all rows.
    """
    df = _ranged(df, order, descending)
    cols = [F.desc(c) if descending and i == 0 else F.asc(c) for i, c in enumerate(order)]
    all_ = {"rank": F.lit(1).cast("bigint"), **sums}
    parts = df.groupBy("__part").agg(*(F.sum(x).alias(f"__t_{n}") for n, x in all_.items()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    base = parts.select(F.col("__part").alias("__p"), *(F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in all_))
    own = Window.partitionBy("__part").orderBy(*cols).rowsBetween(Window.unboundedPreceding, 0)
    keep = [c for c in df.columns if c != "__part"]
    inner = df.select("*", *(F.sum(x).over(own).alias(f"__s_{n}") for n, x in all_.items()))
    return inner.join(F.broadcast(base), F.col("__part") == F.col("__p")).select(*keep, *((F.col(f"__s_{n}") + F.col(f"__b_{n}")).alias(n) for n in all_))


def global_rank(df: DataFrame, order: list[str], descending: bool = False) -> DataFrame:
    return running(df, order, {}, descending)


def reliability(scored: DataFrame, bins: int = 10) -> DataFrame:
    """One row per equal-width bin of score (last one closed): count, mean score, share right."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    return scored.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg(F.col("y").cast("double")).alias("share"))


def ece(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error: bin gaps weighted by bin size."""
    return reliability(scored, bins).agg((F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("share"))) / F.sum("n")).alias("ece"))


def proper_scores(scored: DataFrame) -> DataFrame:
    """Brier score and negative log likelihood (scores clipped to 1e-6)."""
    p, y = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("score"))), F.col("y")
    return scored.agg(F.avg((F.col("score") - y) * (F.col("score") - y)).alias("brier"), F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("nll"))


def risk_coverage(scored: DataFrame, key: str) -> DataFrame:
    """Rows by falling score (ties by key): rank k, running errors, risk = errors / k, precision."""
    df = running(scored, ["score", key], {"errors": F.lit(1) - F.col("y")}, descending=True)
    return df.withColumn("risk", F.col("errors") / F.col("rank")).withColumn("precision", 1 - F.col("errors") / F.col("rank"))


def aurc(curve: DataFrame) -> DataFrame:
    """Area under risk over coverage by trapezoids between consecutive ranks.

    Each inner risk counts once and both ends half, so no neighbour has to be looked up: n sums instead of a window.
    """
    n = F.count("*")
    ends = F.sum(F.when(F.col("rank") == 1, F.col("risk") / 2).otherwise(0.0)) + F.max_by("risk", "rank") / 2
    return curve.agg(F.when(n > 1, (F.sum("risk") - ends) / n).otherwise(0.0).alias("aurc"))


def coverage_at(curve: DataFrame, targets: list[float]) -> DataFrame:
    """For each target the largest share of rows with running precision at or above it."""
    one = curve.agg(F.count("*").alias("n"), *(F.coalesce(F.max(F.when(F.col("precision") >= p, F.col("rank"))), F.lit(0)).alias(f"k{i}") for i, p in enumerate(targets)))
    rows = F.array(*[F.struct(F.lit(p).alias("target"), (F.col(f"k{i}") / F.greatest("n", F.lit(1))).alias("coverage")) for i, p in enumerate(targets)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def bands(dev: DataFrame, test: DataFrame, key: str, highs: list[float], low: float = 0.5) -> DataFrame:
    """Insert, review and reject shares of `test` under thresholds found on `dev`.

    high: score at the last rank (falling) with running precision at or above the target, 1.01 if none; low: score at the
    last rank (rising) with running precision at or below it, -0.01 if none. Insert takes precedence over reject.
    """
    down = risk_coverage(dev, key)
    up = running(dev, ["score", key], {"right": F.col("y")}).withColumn("precision", F.col("right") / F.col("rank"))
    tl = up.agg(F.coalesce(F.max_by("score", F.when(F.col("precision") <= low, F.col("rank"))), F.lit(-0.01)).alias("tau_low"))
    th = down.agg(*(F.coalesce(F.max_by("score", F.when(F.col("precision") >= h, F.col("rank"))), F.lit(1.01)).alias(f"h{i}") for i, h in enumerate(highs)))
    h, lo = th.first(), tl.first()["tau_low"]
    lines = []
    for i, target in enumerate(highs):
        ins = F.col("score") >= h[f"h{i}"]
        lines.append(test.agg(
            F.lit(target).alias("target"), F.lit(h[f"h{i}"]).alias("tau_high"), F.lit(lo).alias("tau_low"), F.count("*").alias("n"), F.count_if(ins).alias("n_insert"),
            F.count_if(~ins & (F.col("score") < lo)).alias("n_reject"), F.count_if(~ins & (F.col("score") >= lo)).alias("n_review"),
            (F.sum(F.when(ins, F.col("y"))) / F.greatest(F.count_if(ins), F.lit(1))).alias("insert_precision"), F.count_if(~ins & (F.col("y") == 0)).alias("n_held_wrong"),
        ))
    out = lines[0]
    for x in lines[1:]:
        out = out.unionByName(x)
    return out


def features(claims: DataFrame) -> DataFrame:
    """Adds f: the layers, trust, word counts, presence flags, a number flag and one-hots of the first four types."""
    from factgate.functions.text import normalize
    from factgate.operators.validate import LAYERS

    def words(c: str) -> Column:
        n = normalize(F.coalesce(c, F.lit("")))
        return F.when(n == "", 0).otherwise(F.size(F.split(n, " ")))

    flags = [F.coalesce("evidence", F.lit("")) != "", ~F.lower(F.trim(F.coalesce("anchor", F.lit("")))).isin("", "null", "none"), F.replace("value", F.lit("."), F.lit("")).rlike("^[0-9]+$")]
    one_hot = [F.col("kind") == k for k in ("Condition", "Observation", "Procedure", "MedicationStatement")]
    cols = [*(F.col(c) for c in (*LAYERS, "trust")), words("entity"), words("value"), *(F.coalesce(x, F.lit(False)).cast("int") for x in (*flags, *one_hot))]
    return claims.withColumn("f", F.array(*(c.cast("double") for c in cols)))


def fit_booster(train: DataFrame, rounds: int = 200, depth: int = 3, seed: int = 0):
    """Gradient-boosted trees on f, y. Fitted by Spark ML, so distributed over the rows.

    With the checkpoint folder set the fit cuts the lineage of its errors every ten rounds, so it does not grow with the rounds.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    ensure_checkpoint_dir(train.sparkSession)
    return GBTClassifier(featuresCol="v", labelCol="y", maxIter=rounds, maxDepth=depth, seed=seed, checkpointInterval=10).fit(train.select("y", array_to_vector("f").alias("v")))


def boosted_scores(model, rows: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector, vector_to_array

    return model.transform(rows.withColumn("v", array_to_vector("f"))).withColumn("score", vector_to_array("probability")[1]).drop("v", "rawPrediction", "probability", "prediction")


def platt(scored: DataFrame):
    """One-feature logistic calibration of `score` against y; returns (slope, intercept)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    m = LogisticRegression(featuresCol="v", labelCol="y").fit(scored.select("y", array_to_vector(F.array("score")).alias("v")))
    return float(m.coefficients[0]), float(m.intercept)
