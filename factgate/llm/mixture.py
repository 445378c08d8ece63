"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factgate.session import cut_lineage
from factgate.tables import small_rows

MAX_SOURCES = 100_000
#: Hash bins by which a source's fractional pass finds its cut, and documents a bin; only the cut's bin is ordered row by row.
BINS = 4096
BIN_DOCS = 20_000


def water_fill(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total: float) -> dict[str, float]:
    """Tokens each source gives to a mixture of `total`. Sources at their cap are clamped, what they cannot give goes to the others in proportion."""
    caps = {s: r * sizes.get(s, 0) for s, (_, r) in targets.items()}
    give: dict[str, float] = {}
    open_ = {s for s, (w, _) in targets.items() if w > 0 and caps[s] > 0}
    left = total
    while open_:
        weight = sum(targets[s][0] for s in open_)
        over = {s for s in open_ if left * targets[s][0] / weight > caps[s]}
        if not over:
            give |= {s: left * targets[s][0] / weight for s in open_}
            break
        give |= {s: float(caps[s]) for s in over}
        left -= sum(caps[s] for s in over)
        open_ -= over
    return {s: give.get(s, 0.0) for s in targets}


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(mixture, report).

    docs: doc_id, source, n_tokens. targets: source, target_share, max_repeats (repeated sources add up, with their smallest
    cap). total_tokens: size of the mixture; default: all tokens of the sources named, once. Shares are normalised over the
    sources named. mixture: doc_id, source, epoch (from 0), n_tokens; a document appears once an epoch and at most
    max_repeats times. A fractional epoch takes documents in the order of a seeded hash up to the side nearer to its tokens, so a
    source misses its amount by half a document at most. Documents of unnamed or null sources and with no tokens are not in
    it. report, one row per source named: target_share (normalised), docs, size, tokens given, epochs, actual_share.
    """
    named = {}
    for r in small_rows(targets.filter("source is not null and target_share > 0").groupBy("source").agg(F.sum("target_share").alias("w"), F.min("max_repeats").alias("r")), MAX_SOURCES, "mix_targets"):
        named[r.source] = (float(r.w), max(0, int(r.r or 0)))
    spark = docs.sparkSession
    whole = sum(w for w, _ in named.values()) or 1.0
    want = spark.createDataFrame([(s, w / whole, r) for s, (w, r) in named.items()], "source string, target_share double, max_repeats int")
    rows = docs.select("doc_id", "source", F.col("n_tokens").cast("bigint").alias("n_tokens")).filter("n_tokens > 0").join(F.broadcast(want.select("source")), "source")
    rows = cut_lineage(rows.select("doc_id", "source", "n_tokens", F.xxhash64(F.lit(seed), "doc_id").alias("h")))
    stats = {r.source: r for r in rows.groupBy("source").agg(F.sum("n_tokens").alias("size"), F.count("*").alias("docs")).collect()}
    sizes = {s: int(r["size"]) for s, r in stats.items()}
    total = float(total_tokens if total_tokens is not None else sum(sizes.values()))
    give = water_fill(sizes, named, total)
    epochs = {s: give[s] / sizes[s] if sizes.get(s) else 0.0 for s in named}
    quota = spark.createDataFrame([(s, int(e + 1e-9), round((e - int(e + 1e-9)) * sizes.get(s, 0)) if e - int(e + 1e-9) > 1e-9 else 0) for s, e in epochs.items()], "source string, full int, part bigint")
    # the bin in which a source's fractional pass ends, from token sums by (source, bin)
    bins = max(BINS, max((r["docs"] for r in stats.values()), default=0) // BIN_DOCS)
    binned = rows.withColumn("bin", F.pmod("h", F.lit(bins)))
    sums = binned.groupBy("source", "bin").agg(F.sum("n_tokens").alias("t"))
    run = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("t").over(run), F.lit(0))).join(F.broadcast(quota), "source")
    cuts = sums.filter("before < part and before + t >= part").select("source", F.col("bin").alias("cut"), "before", "full", "part")
    plan = quota.join(cuts.select("source", "cut", "before"), "source", "left")  # one row per source
    placed = binned.join(F.broadcast(plan), "source")
    in_cut = placed.filter("bin = cut")
    # a seeded order within the cut's bin; a document is taken while that brings the source nearer to its amount
    order = Window.partitionBy("source").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("before") + F.coalesce(F.sum("n_tokens").over(order), F.lit(0))
    in_cut = in_cut.withColumn("extra", (2 * ahead + F.col("n_tokens") <= 2 * F.col("part")).cast("int"))
    outside = placed.filter("cut is null or bin <> cut").withColumn("extra", F.coalesce((F.col("bin") < F.col("cut")).cast("int"), F.lit(0)))
    every = outside.unionByName(in_cut).withColumn("copies", F.col("full") + F.col("extra")).filter("copies > 0")
    mixture = every.select("doc_id", "source", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("epoch"), "n_tokens")
    got = every.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most"))
    have = spark.createDataFrame([(s, int(r["docs"]), sizes[s]) for s, r in stats.items()], "source string, docs bigint, size bigint")
    report = want.join(have, "source", "left").join(got, "source", "left").select(
        "source", "target_share", "max_repeats", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("size", F.lit(0)).alias("size"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("most", F.lit(0)).alias("most_repeats"),
    )
    everything = got.agg(F.sum("tokens")).scalar()
    report = report.withColumn("actual_share", F.col("tokens") / F.coalesce(everything, F.lit(1)))
    return mixture, report
