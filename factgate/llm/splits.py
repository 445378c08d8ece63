"""Train, validation and test splits that keep related records together.

Related records are found as connected components over a contracted graph (alternating large-star and small-star steps
on edges that survive contraction). Whole components are then assigned: hashed start, moves and exchanges accepted by
annealing in parallel shards and chains, best state kept. Components so large that they alone shift a split's share are
annealed first, together, as there are at most 1 / BIG of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgate.functions.text import squeeze
from factgate.session import cut_lineage
from factgate.tables import broadcast_if_small, small_rows

#: A component with more than this share of all records is annealed globally.
BIG = 1 / 1000
#: Components annealed together in one task.
SHARD = 20_000
CHAINS = 8
STEPS = 40_000
#: The most frequent labels are balanced one by one, the rest as one.
MAX_LABELS = 32
MAX_SPLITS = 100
#: Weight of label deviation against size deviation.
LABEL_WEIGHT = 0.3
SMALL = 1_000_000


def _node(c: Column, kind: int) -> Column:
    """Notes and subjects share one id space. Ids must lie within 62 bits."""
    ok = F.abs(c) < F.lit(1 << 61)
    return F.when(c.isNotNull(), F.when(ok, F.shiftleft(c, 1) + kind).otherwise(F.raise_error(F.lit("ids beyond 61 bits")).cast("bigint")))


def connected(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of the undirected edges (a, b).

    Each round replaces edges by star edges and is written to the checkpoint folder; rounds are logarithmic in the
    component size. A hub's edges meet their minimum in a join that AQE splits where it is skewed.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    e = cut_lineage(e)
    last = None
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: neighbours above a node are tied to the least node around it
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        # small star: a node and its lower neighbours are tied to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("x"), "m").filter("x > m").select(F.col("x").alias("u"), F.col("m").alias("v"))
        e = cut_lineage(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())


def note_groups(notes: DataFrame, links: DataFrame) -> DataFrame:
    """note_id, group (its least note_id) for every note.

    notes: note_id, subject_id, parent_note_id. links: subject_id, linked_subject_id. Ties: rows with one note_id, one
    non-null subject, linked subjects (also through subjects without notes), a note and its parent (also one that is not
    there), and all chains. Rows without a note_id are left out. A note tied to nothing is its own group.

    Notes are contracted to their least subject first, so the stars of notes around a subject never enter the rounds.
    """
    notes = notes.select("note_id", "subject_id", "parent_note_id").filter("note_id is not null")
    note, subject, parent = _node(F.col("note_id"), 0), _node(F.col("subject_id"), 1), _node(F.col("parent_note_id"), 0)
    rows = notes.select(note.alias("n"), subject.alias("s"), parent.alias("p"))
    reps = rows.groupBy("n").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    reps = cut_lineage(reps.select("n", F.coalesce("lo", "n").alias("rep"), (F.col("hi") > F.col("lo")).alias("mixed")))
    mixed = reps.filter("mixed").select("n", "rep")
    edges = rows.select("n", "s").filter("s is not null").join(mixed, "n").select(F.col("rep").alias("a"), F.col("s").alias("b"))
    tied = rows.select("n", "p").filter("p is not null").distinct().join(reps.select("n", "rep"), "n").select("p", F.col("rep").alias("a"))
    tied = tied.join(reps.select(F.col("n").alias("p"), F.col("rep").alias("prep")), "p", "left").select("a", F.coalesce("prep", "p").alias("b"))
    known = links.select(_node(F.col("subject_id"), 1).alias("a"), _node(F.col("linked_subject_id"), 1).alias("b")).filter("a is not null and b is not null")
    roots = connected(edges.unionAll(tied).unionAll(known))
    by_rep = reps.groupBy("rep").agg(F.min("n").alias("least"))
    by_root = by_rep.join(roots, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("root", "rep").alias("root"), "least")
    least = by_root.groupBy("root").agg(F.min("least").alias("group"))
    of_rep = broadcast_if_small(by_root.select("rep", "root").join(least, "root").select("rep", "group"), SMALL)
    return reps.join(of_rep, "rep").select(F.shiftright("n", 1).alias("note_id"), F.shiftright("group", 1).alias("group"))


def _deviation(sums: np.ndarray, goal: np.ndarray, scale: np.ndarray) -> float:
    """Weighted sum of absolute differences. Columns: size, then labels."""
    return float((np.abs(sums - goal) * scale).sum())


def anneal(vec: np.ndarray, start: np.ndarray, goal: np.ndarray, scale: np.ndarray, seed: int, steps: int) -> tuple[float, np.ndarray]:
    """Moves and exchanges of whole components; the best state seen. vec: components x (size, labels); goal: splits x the same."""
    rng = np.random.default_rng(seed)
    n, k = len(vec), len(goal)
    at = start.copy()
    sums = np.zeros_like(goal)
    np.add.at(sums, at, vec)
    cost = _deviation(sums, goal, scale)
    best, kept = cost, at.copy()
    if n == 0 or k < 2:
        return best, kept
    heat = max(cost / 20, 1e-9)
    picks, others, to, luck, swap = rng.integers(0, n, steps), rng.integers(0, n, steps), rng.integers(0, k, steps), rng.random(steps), rng.random(steps) < 0.5
    for i in range(steps):
        a, b = picks[i], others[i]
        s, t = at[a], at[b] if swap[i] else to[i]
        if s == t:
            continue
        d = vec[a] - vec[b] if swap[i] else vec[a]
        old = (np.abs(sums[s] - goal[s]) + np.abs(sums[t] - goal[t])) @ scale
        new = (np.abs(sums[s] - d - goal[s]) + np.abs(sums[t] + d - goal[t])) @ scale
        if new <= old or luck[i] < math.exp((old - new) / heat):
            sums[s] -= d
            sums[t] += d
            at[a] = t
            if swap[i]:
                at[b] = s
            cost += new - old
            if cost < best - 1e-12:
                best, kept = cost, at.copy()
        heat *= 0.9997
    return best, kept


def _hashed(ids: np.ndarray, shares: np.ndarray, seed: int) -> np.ndarray:
    """Start: each component drawn by a hash of its id and the shares."""
    x = (ids.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    u = (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    return np.minimum(np.searchsorted(np.cumsum(shares), u, side="right"), len(shares) - 1)


def assign_splits(groups: DataFrame, records: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """note_id, group, split. groups: note_id, group. records: note_id, label. targets: split_name, target_share.

    Shares are normalised; records with several rows count once for size and by each row for labels. Every group lies in one split,
    however large; with no groups the result is empty.
    """
    goals = sorted(small_rows(targets.filter("split_name is not null and target_share > 0").groupBy("split_name").agg(F.sum("target_share").alias("s")), MAX_SPLITS, "split_targets"), key=lambda r: r.split_name)
    names = [r.split_name for r in goals]
    shares = np.array([r.s for r in goals], float)
    shares /= shares.sum()
    label = F.coalesce(F.lower(squeeze(F.col("label"))), F.lit(""))
    tagged = records.select("note_id", label.alias("label"))
    top = [r.label for r in tagged.groupBy("label").count().orderBy(F.desc("count"), "label").limit(MAX_LABELS).collect()]
    of = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in top] or [F.lit("")]), F.col("label")), F.lit(0)).cast("int")
    width = 2 + len(top)  # size, other labels, each top label
    marks = tagged.select("note_id", of.alias("l")).groupBy("note_id", "l").agg(F.count("*").alias("n"))
    sizes = groups.groupBy("group").agg(F.count("*").alias("size"))
    cells = groups.join(marks, "note_id").groupBy("group", "l").agg(F.sum("n").alias("n"))
    hist = cells.groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("l", "n"))).alias("h"))
    comps = sizes.join(hist, "group", "left")
    comps = comps.select("group", F.concat(F.array(F.col("size").cast("double")), F.transform(F.sequence(F.lit(0), F.lit(width - 2)), lambda i: F.coalesce(F.try_element_at("h", i), F.lit(0)).cast("double"))).alias("v"))
    comps = cut_lineage(comps)
    sums = comps.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(F.col("v")[i]), F.lit(0.0)).alias(f"s{i}") for i in range(width)]).first()
    n, total = sums["n"], np.array([sums[f"s{i}"] for i in range(width)])
    goal = shares[:, None] * total[None, :]
    scale = np.r_[1.0, np.full(width - 1, LABEL_WEIGHT)] / np.maximum(total[0], 1.0)
    is_big = F.col("v")[0] > total[0] * BIG
    big = sorted(comps.filter(is_big).collect(), key=lambda r: r.group)  # at most 1 / BIG rows
    ids, vec = np.array([r.group for r in big], np.int64), np.array([r.v for r in big], float).reshape(len(big), width)
    rest = np.clip(goal, 0, None)
    kept = np.zeros(0, int)
    if big:

        def chain(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                for c in p["id"]:
                    cost, at = anneal(vec, _hashed(ids, shares, seed + int(c)), goal * (vec.sum(0) / np.maximum(total, 1.0)), scale, seed + int(c), STEPS)
                    yield pd.DataFrame({"cost": [cost], "chain": [c], "at": [at.tolist()]})

        spark = groups.sparkSession
        runs = spark.range(0, CHAINS, 1, CHAINS).mapInPandas(chain, "cost double, chain bigint, at array<int>").collect()
        kept = np.array(min(runs, key=lambda r: (r["cost"], r.chain))["at"], int)
        used = np.zeros_like(goal)
        np.add.at(used, kept, vec)
        rest = np.clip(goal - used, 0, None)
    small_total = np.maximum(total - (vec.sum(0) if big else 0), 0)
    share_left = np.divide(rest, rest.sum(0), out=np.repeat(shares[:, None], width, 1), where=rest.sum(0) > 0)
    shards = max(1, math.ceil(n / SHARD))

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("group")
        v = np.stack(pdf["v"].to_numpy())
        want = share_left * v.sum(0)[None, :]
        key = pdf["group"].to_numpy(np.int64)
        start = _hashed(key, share_left[:, 0], seed)
        tries = [anneal(v, start if c == 0 else _hashed(key, share_left[:, 0], seed + c), want, scale, seed + c, min(STEPS, 20 * len(v) + 200)) for c in range(2)]
        at = min(tries, key=lambda t: t[0])[1]
        return pd.DataFrame({"group": key, "split": [names[i] for i in at]})

    little = comps.filter(~is_big).withColumn("shard", F.pmod(F.xxhash64("group"), F.lit(shards))).groupBy("shard").applyInPandas(shard, "group bigint, split string")
    large = groups.sparkSession.createDataFrame([(int(g), names[i]) for g, i in zip(ids, kept, strict=True)], "group bigint, split string")
    # one third of all records may lie in one group: large groups meet their split by broadcast, the rest by a shuffled join
    done = groups.join(F.broadcast(large), "group", "left")
    return done.filter("split is not null").unionByName(done.filter("split is null").drop("split").join(little, "group"))


def split_report(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """Records and share reached by split against its target."""
    got = assigned.groupBy("split").agg(F.count("*").alias("n_notes"), F.countDistinct("group").alias("n_groups"))
    whole = assigned.agg(F.count("*").alias("n")).first()["n"]
    return targets.join(got, F.col("split_name") == F.col("split"), "left").select("split_name", "target_share", F.coalesce("n_notes", F.lit(0)).alias("n_notes"), F.coalesce("n_groups", F.lit(0)).alias("n_groups"), (F.coalesce("n_notes", F.lit(0)) / F.lit(max(whole, 1))).alias("share"))
