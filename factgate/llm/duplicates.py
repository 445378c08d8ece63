"""Duplicates hidden by formatting: records equal but for blanks, case, punctuation or the order of their fields.

Records become canonical bytes. A recursive radix partitioning splits oversized buckets by further bytes until each fits a
task, then every bucket is counted in a burst trie with terminal counters. A key that alone is oversized cannot be split by
bytes; its counter and least id come from the histogram pass itself and its rows are labelled where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgate.session import cut_lineage
from factgate.tables import broadcast_if_small

#: Rows of one bucket; a bucket is one trie in one task's memory, whatever the size of the input.
BUCKET_ROWS = 200_000
#: A level's oversized prefixes are broadcast up to so many, beyond it rows meet them by a shuffle.
MAX_SMALL = 500_000
#: Prefix lengths in bytes by level; the last is the whole key.
DEPTHS = (2, 4, 8, 16, 32, 64, 1 << 30)
#: Keys of one trie container before it bursts into containers by the next byte.
BURST = 512


def bare(c: Column) -> Column:
    """Letters, digits and points between two digits, without case; null as empty."""
    return F.coalesce(F.lower(F.regexp_replace(c, r"(?!(?<=\p{Nd})\.(?=\p{Nd}))[^\p{L}\p{Nd}]", "")), F.lit(""))


def canonical_bytes(fields: list[str], scope: str) -> Column:
    """Field texts in sorted order, then the scope; U+001F and U+001E cannot occur in a bare text."""
    ordered = F.array_sort(F.array(*[bare(F.col(f)) for f in fields]))
    return F.encode(F.concat(F.array_join(ordered, "\u001f"), F.lit("\u001e"), F.coalesce(F.col(scope).cast("string"), F.lit(""))), "utf-8")


class BurstTrie:
    """Byte trie whose leaves are containers of key rests; each rest has a terminal counter [count, least id, ids]."""

    __slots__ = ("root",)

    def __init__(self):
        self.root: dict = {}

    def add(self, key: bytes, rid: int) -> None:
        node, depth = self.root, 0
        while None in node:  # an inner node: children by byte
            node = node.setdefault(key[depth : depth + 1], {})
            depth += 1
        rest = key[depth:]
        end = node.get(rest)
        if end is None:
            node[rest] = [1, rid, [rid]]
            if len(node) > BURST:
                self._burst(node)
        else:
            end[0] += 1
            end[1] = min(end[1], rid)
            end[2].append(rid)

    @staticmethod
    def _burst(node: dict) -> None:
        held = list(node.items())
        node.clear()
        node[None] = True
        for rest, end in held:
            node.setdefault(rest[:1], {})[rest[1:]] = end

    def terminals(self) -> Iterator[list]:
        stack = [self.root]
        while stack:
            node = stack.pop()
            if None in node:
                stack += [v for k, v in node.items() if k is not None]
            else:
                yield from node.values()


def place(rows: DataFrame) -> DataFrame:
    """rows (rid, key) with bucket, least, n: the shortest prefix of the key that is not oversized, or, where the whole key alone is
    oversized, no bucket but its count and least id.

    A level counts only rows under the oversized prefixes of the level before; these stay a table, so the driver holds none of them.
    """
    out = rows.withColumns({"bucket": F.lit(None).cast("binary"), "least": F.lit(None).cast("bigint"), "n": F.lit(None).cast("bigint"), "__open": F.lit(True)})
    for level, depth in enumerate(DEPTHS):
        head = F.substring("key", 1, depth) if depth < 1 << 30 else F.col("key")
        counts = out.filter("__open").groupBy(head.alias("__head")).agg(F.count("*").alias("__n"), F.min("rid").alias("__least"), (F.max(F.length("key")) <= depth).alias("__whole"))
        over = cut_lineage(counts.filter(F.col("__n") > BUCKET_ROWS))
        if over.isEmpty():
            return out.withColumn("bucket", F.when(F.col("__open"), head).otherwise(F.col("bucket"))).drop("__open")
        out = out.withColumn("__at", F.when(F.col("__open"), head)).join(broadcast_if_small(over, MAX_SMALL), F.col("__at") == F.col("__head"), "left")
        fits, whole = F.col("__open") & F.col("__head").isNull(), F.col("__open") & F.coalesce("__whole", F.lit(False))
        out = out.select(
            "rid", "key", F.when(fits, F.col("__at")).otherwise(F.col("bucket")).alias("bucket"), F.when(whole, F.col("__least")).otherwise(F.col("least")).alias("least"),
            F.when(whole, F.col("__n")).otherwise(F.col("n")).alias("n"), (F.col("__open") & F.col("__head").isNotNull() & ~F.coalesce("__whole", F.lit(False))).alias("__open"),
        )
    return out.drop("__open")  # the last level is the whole key: nothing is open below it


def _count_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: one trie a bucket, dropped when the next begins. Yields rid, least, n of every row."""
    trie, at, size = BurstTrie(), None, 0

    def flush() -> pa.RecordBatch:
        rid, least, n = [], [], []
        for count, first, ids in trie.terminals():
            rid += ids
            least += [first] * count
            n += [count] * count
        return pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(least, pa.int64()), pa.array(n, pa.int64())], names=["rid", "least", "n"])

    for b in batches:
        for bucket, key, rid in zip(b.column("bucket").to_pylist(), b.column("key").to_pylist(), b.column("rid").to_pylist(), strict=True):
            if bucket != at:
                if size:
                    yield flush()
                trie, at, size = BurstTrie(), bucket, 0
            trie.add(key, rid)
            size += 1
    if size:
        yield flush()


def label_copies(records: DataFrame, rid: str, fields: list[str], scope: str) -> DataFrame:
    """rid, least (the smallest id of the row's group of copies), n (its number of copies), one row per record.

    Two records of one scope are copies if their fields hold the same bare texts in whatever order; a null scope is one
    scope, a null field is empty. Records whose fields are all empty are copies of one another. Ids are unique bigints.
    """
    rows = cut_lineage(records.select(F.col(rid).cast("bigint").alias("rid"), canonical_bytes(fields, scope).alias("key")))
    placed = place(rows)
    hot = placed.filter("n is not null").select("rid", "least", "n")
    cold = placed.filter("n is null").select("rid", "key", "bucket").repartition("bucket").sortWithinPartitions("bucket")
    return cold.mapInArrow(_count_bucket, "rid bigint, least bigint, n bigint").unionAll(hot)
