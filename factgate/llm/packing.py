"""Filling fixed-capacity containers with items of varying length.

Only the histogram of lengths (at most `capacity` bins) reaches the driver. Shallow combinations of frequent lengths that
fill a window below the capacity are enumerated, their repeat counts solved by non-negative least squares against the
histogram and rounded down; what is left is packed greedily, largest first, again on the histogram. The plan is a list of
runs of ranks; every item finds its container from its length and its rank among items of that length.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factgate.session import cut_lineage
from factgate.tables import small_rows

MAX_CAPACITY = 1 << 20
MAX_LIMITS = 100
#: Lengths the combinations are built from, combinations kept, and the room a combination may leave.
FREQUENT = 96
COMBINATIONS = 1500
WINDOW = 0.004
#: Items of one length ranked in one task.
RANK_ROWS = 200_000


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares by active sets."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    ata, atb = a.T @ a, a.T @ b
    tol = 1e-8 * max(1.0, float(np.abs(atb).max(initial=0)))
    for _ in range(rounds):
        grad = np.where(free, -np.inf, atb - ata @ x)
        j = int(np.argmax(grad))
        if n == 0 or grad[j] <= tol:
            break
        free[j] = True
        while True:
            idx = np.flatnonzero(free)
            z = np.linalg.lstsq(ata[np.ix_(idx, idx)], atb[idx], rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[idx] = z
                break
            bad = z <= 0
            step = np.min(x[idx][bad] / np.maximum(x[idx][bad] - z[bad], 1e-300))
            x[idx] += step * (z - x[idx])
            drop = idx[(x[idx] <= 1e-12) & bad]
            if not len(drop):
                drop = idx[bad][:1]
            x[drop] = 0
            free[drop] = False
            if not free.any():
                break
    return x


def combinations(lengths: np.ndarray, capacity: int, seed: int = 0) -> list[dict[int, int]]:
    """Multisets of at most three distinct lengths whose sum lies within the window below the capacity."""
    least = capacity - max(1, int(capacity * WINDOW))
    rng = np.random.default_rng(seed)
    values = sorted({int(v) for v in lengths})
    found: dict[tuple, dict[int, int]] = {}
    for x in values:
        for y in rng.permutation(values):
            y = int(y)
            for a in {1, 2, max(1, capacity // (2 * x)), capacity // x}:
                room = capacity - a * x
                if room < 0:
                    continue
                b = room // y
                room -= b * y
                one: dict[int, int] = {x: a}
                if b:
                    one[y] = one.get(y, 0) + b
                if room:
                    k = bisect_right(values, room)
                    if k:
                        one[values[k - 1]] = one.get(values[k - 1], 0) + 1
                        room -= values[k - 1]
                if capacity - room >= least:
                    found.setdefault(tuple(sorted(one.items())), one)
    every = [found[k] for k in sorted(found)]
    return every if len(every) <= COMBINATIONS else [every[i] for i in rng.choice(len(every), COMBINATIONS, replace=False)]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(combination, repeats) that use up the histogram exactly; every combination fits the capacity."""
    left = {k: n for k, n in histogram.items() if n > 0}
    out: list[tuple[dict[int, int], int]] = []
    frequent = sorted(left, key=lambda k: (-left[k], k))[:FREQUENT]
    combos = combinations(np.array(frequent), capacity) if frequent else []
    if combos:
        row = {k: i for i, k in enumerate(sorted(frequent))}
        a = np.zeros((len(row), len(combos)))
        for j, c in enumerate(combos):
            for k, m in c.items():
                a[row[k], j] = m
        x = nnls(a, np.array([left[k] for k in row], float))
        for j in np.argsort(-x):
            times = min([int(x[j]), *(left[k] // m for k, m in combos[j].items())])
            if times > 0:
                out.append((combos[j], times))
                for k, m in combos[j].items():
                    left[k] -= m * times
    order = sorted(k for k, n in left.items() if n)
    while order:
        room, one = capacity, {}
        i = len(order) - 1
        while i >= 0 and room:
            k = order[i]
            m = min(left[k], room // k)
            if m:
                one[k] = m
                room -= m * k
            i = min(i, bisect_right(order, room)) - 1
        times = min(left[k] // m for k, m in one.items())
        out.append((one, times))
        for k, m in one.items():
            left[k] -= m * times
        order = [k for k in order if left[k]]
    return out


def runs(planned: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, first container, items of that length a container), sorted."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for one, times in planned:
        for k, m in one.items():
            rows.append((k, used.get(k, 0), base, m))
            used[k] = used.get(k, 0) + m * times
        base += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def _pack_one(items: DataFrame, n_items: int, name: str, capacity: int) -> DataFrame:
    rest = items.select("doc_id", F.col("n_tokens"), (F.col("n_tokens") % capacity).alias("len"))
    part = rest.filter("len > 0")
    salts = max(1, n_items // RANK_ROWS)
    part = part.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    counts = part.groupBy("len", "salt").agg(F.count("*").alias("n"))
    hist = {r.len: r.n for r in counts.groupBy("len").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` bins
    table = runs(plan(hist, capacity))
    spark = items.sparkSession
    shared = spark.sparkContext.broadcast(table)  # a few runs a length at most
    before = Window.partitionBy("len").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = F.row_number().over(Window.partitionBy("len", "salt").orderBy("doc_id")) - 1
    ranked = part.withColumn("own", own).join(offsets, ["len", "salt"]).select("doc_id", "n_tokens", "len", (F.col("own") + F.col("before")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        keys = (t[:, 0] << 40) + t[:, 1]
        for b in batches:
            size, rank = b.column("len").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(keys, (size << 40) + rank, side="right") - 1
            box = t[at, 2] + (rank - t[at, 1]) // t[at, 3]
            total = b.column("n_tokens").to_numpy()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([f"p{i}" for i in box]), pa.array(total // capacity), pa.array(total - size), pa.array(size)], names=["doc_id", "container_id", "piece_no", "start_token", "n_tokens"])

    packed = ranked.mapInArrow(place, f"doc_id {items.schema['doc_id'].dataType.simpleString()}, container_id string, piece_no bigint, start_token bigint, n_tokens bigint")
    full = items.filter(F.col("n_tokens") >= capacity).withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("n_tokens") / capacity) - 1)))
    full = full.select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit("-"), F.col("piece_no").cast("string")).alias("container_id"), "piece_no", (F.col("piece_no") * capacity).alias("start_token"), F.lit(capacity).cast("bigint").alias("n_tokens"))
    none = items.filter("n_tokens = 0").select("doc_id", F.lit(None).cast("string").alias("container_id"), F.lit(0).cast("bigint").alias("piece_no"), F.lit(0).cast("bigint").alias("start_token"), F.lit(0).cast("bigint").alias("n_tokens"))
    return packed.unionByName(full).unionByName(none).select(F.lit(name).alias("pack_name"), F.lit(capacity).alias("capacity"), "*")


def pack(items: DataFrame, limits: DataFrame) -> DataFrame:
    """Every item in a container of each capacity.

    items: doc_id, n_tokens (doc_id unique and not null). limits: pack_name, capacity_tokens. Result: pack_name, capacity,
    container_id, doc_id, piece_no, start_token, n_tokens. An item larger than the capacity fills whole containers of its own and only its
    rest is packed; no other item is split. Items of length 0 take no room and have a null container. Ties of length are ranked by doc_id.
    """
    items = cut_lineage(items.select("doc_id", F.col("n_tokens").cast("bigint").alias("n_tokens")))
    n = items.count()
    bounds = small_rows(limits.filter("capacity_tokens > 0").dropDuplicates(["pack_name", "capacity_tokens"]), MAX_LIMITS, "pack_limits")
    if any(r.capacity_tokens > MAX_CAPACITY for r in bounds):
        raise ValueError("capacity beyond the histogram bound")
    if not bounds:
        return _pack_one(items.limit(0), 0, "", 1).limit(0)
    return reduce(DataFrame.unionAll, [_pack_one(items, n, r.pack_name, r.capacity_tokens) for r in sorted(bounds, key=lambda r: (r.capacity_tokens, str(r.pack_name)))])


def pack_report(packed: DataFrame) -> DataFrame:
    """Containers, tokens, share of room used, and items cut, by pack."""
    boxes = packed.filter("container_id is not null").groupBy("pack_name", "capacity", "container_id").agg(F.sum("n_tokens").alias("used"), F.count_if(F.col("piece_no") > 0).alias("cut"))
    return boxes.groupBy("pack_name", "capacity").agg(
        F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"), F.sum("cut").alias("n_cut_pieces"),
        (F.sum("used") / (F.count("*") * F.col("capacity"))).alias("filled"),
    )
