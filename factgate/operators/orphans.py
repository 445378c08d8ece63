"""References to records that do not exist, judged at the time each referring row arrived.

A Bloom filter of all parent keys, built with JVM aggregates and carried as one array of words, proves most orphans in
the scan of the child; only filter-positive references go to the exact join with the parents' validity intervals.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgate.session import cut_lineage
from factgate.tables import is_small

#: The filter never exceeds 2^28 bits (32 MB): beyond 16 bits a key it grows less selective, never wrong.
MAX_BITS = 1 << 28
BITS_A_KEY = 16
#: Bits a key sets, all in one 64-bit word: a test reads the filter once, and the plan names it once.
HASHES = 5
#: Intervals of at most so many rows (three 8-byte columns and a key) are broadcast to the exact join.
MAX_BROADCAST_ROWS = 1_000_000


def _word_and_mask(key: Column, n_words: int) -> tuple[Column, Column]:
    h1, h2 = F.xxhash64(key, F.lit(17)), F.xxhash64(key, F.lit(29))
    mask = F.lit(0).cast("bigint")
    for i in range(HASHES):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h2, 6 * i).bitwiseAND(63).cast("int")))
    return F.pmod(h1, F.lit(n_words).cast("bigint")), mask


def bloom_words(keys: DataFrame, n_keys: int) -> tuple[DataFrame, int]:
    """One row holding the blocked filter of column `key` as an array of 64-bit words, and the number of words (a power of two)."""
    n_words = min(MAX_BITS, 1 << max(10, math.ceil(math.log2(max(1, n_keys) * BITS_A_KEY)))) // 64
    word, mask = _word_and_mask(F.col("key"), n_words)
    words = keys.select(word.alias("w"), mask.alias("m")).groupBy("w").agg(F.bit_or("m").alias("v"))
    # word blocks of 1,024 keep every aggregation buffer small; there are at most 4,096 of them
    blocks = words.groupBy(F.shiftright("w", 10).alias("b")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("w") % 1024).cast("int").alias("k"), "v"))).alias("m"))
    per = min(1024, n_words)
    full = F.transform(F.sequence(F.lit(0), F.lit(per - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("bigint")))
    packed = blocks.select(F.col("b").cast("int").alias("b"), full.alias("ws")).agg(F.map_from_entries(F.collect_list(F.struct("b", "ws"))).alias("all"))
    empty = F.array_repeat(F.lit(0).cast("bigint"), per)
    return packed.select(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n_words // per - 1)), lambda b: F.coalesce(F.try_element_at("all", b), empty))).alias("words")), n_words


def maybe_in(words: Column, key: Column, n_words: int) -> Column:
    """False proves that `key` was not among the filter's keys."""
    word, mask = _word_and_mask(key, n_words)
    return F.get(words, word.cast("int")).bitwiseAND(mask) == mask


def validity(parent: DataFrame) -> DataFrame:
    """Disjoint intervals [start, stop) in which a key is valid; stop null means for good.

    parent: key, loaded_at, deleted_at. Rows deleted no later than they were loaded never count. Repeated rows collapse
    in a partial aggregation, overlapping ones in a spilling window over the key.
    """
    far = F.lit("9999-12-31").cast("timestamp")
    spans = parent.select("key", F.col("loaded_at").alias("start"), F.coalesce("deleted_at", far).alias("stop")).filter("start < stop")
    spans = spans.groupBy("key", "start").agg(F.max("stop").alias("stop"))
    w = Window.partitionBy("key").orderBy("start")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", (reach.isNull() | (F.col("start") > reach)).cast("int"))
    spans = spans.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy("key", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def orphan_references(child: DataFrame, parent: DataFrame) -> DataFrame:
    """References of `child` to which no valid parent row existed when the child arrived.

    child: row_id, key, loaded_at. parent: key, loaded_at, deleted_at. Null keys refer to nothing and are no cases. A
    parent row holds at t if loaded_at <= t and deleted_at is null or > t; a null loaded_at never holds, and a child with
    a null loaded_at sees no parent. status: 'missing' (the key has no row at all), 'deleted' (some row was loaded by then),
    'late' (rows came only later). Result: row_id, status, loaded_at; each child row at most once.
    """
    child = child.filter("key is not null").select("row_id", "key", "loaded_at")
    parent = parent.filter("key is not null")
    keys = cut_lineage(parent.groupBy("key").agg(F.min("loaded_at").alias("first")))
    n = keys.count()
    words, n_words = bloom_words(keys.select("key"), n)
    # one row of at most 32 MB, written once: every mention of the filter reads that row
    child = child.withColumn("maybe", maybe_in(_scalar(cut_lineage(words)), F.col("key"), n_words))
    islands = validity(parent).withColumnRenamed("key", "k").withColumn("held", F.lit(True))
    small = n <= MAX_BROADCAST_ROWS and is_small(islands, MAX_BROADCAST_ROWS)
    held = (F.col("key") == F.col("k")) & (F.col("loaded_at") >= F.col("start")) & (F.col("loaded_at") < F.col("stop"))
    firsts = keys.select(F.col("key").alias("k"), "first", F.lit(True).alias("known"))
    firsts = F.broadcast(firsts) if small else firsts
    status = F.when(F.col("known").isNull(), "missing").when(F.col("first") <= F.col("loaded_at"), "deleted").otherwise("late")

    def judged(rows: DataFrame) -> DataFrame:
        return rows.join(firsts, F.col("key") == F.col("k"), "left").select("row_id", status.alias("status"), "loaded_at")

    if small:
        # one pass: a proven orphan never probes the intervals and has no first arrival
        return judged(child.join(F.broadcast(islands), F.col("maybe") & held, "left").filter("held is null").select("row_id", "key", "loaded_at"))
    proven = child.filter(~F.col("maybe")).select("row_id", F.lit("missing").alias("status"), "loaded_at")
    return proven.unionByName(judged(child.filter("maybe").drop("maybe").join(islands, held, "left_anti")))


def _scalar(one_row: DataFrame) -> Column:
    return one_row.scalar()


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans counted per child table, field, month of arrival and status. found: child_table, ref_field, status, loaded_at."""
    month = F.date_format(F.date_trunc("month", "loaded_at"), "yyyy-MM")
    return found.groupBy("child_table", "ref_field", month.alias("month"), "status").agg(F.count("*").alias("n_rows"))


def code_key(c: Column) -> Column:
    """Codes compare without dots, blanks and case."""
    from factgate.functions.text import BLANK

    return F.upper(F.regexp_replace(c, rf"[.]|{BLANK}", ""))
