"""Mapping free-entered values to a canonical list by a prefix-filter set-similarity join, in the JVM throughout.

Texts become their letters, compared as sets of letter pairs. Pairs are ordered by rarity over list and values together; only
the rare prefixes of two texts are joined, pairs of texts pass a length and a positional filter, their Jaccard similarity is
counted exactly and the best entry kept. Each distinct value is looked up once, however many rows hold it.
"""

from __future__ import annotations

import math
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgate.functions.text import trim_blanks
from factgate.operators.calibrate import global_rank
from factgate.session import cut_lineage
from factgate.tables import MAX_BYTES, is_small

#: Least Jaccard similarity joined; from SURE on it is enough, below it the edit distance must also be small.
LEAST = 0.4
SURE = 0.55
#: Most edits, as a share of the longer text's letters.
MOST_EDITS = 0.34
#: Entries whose Jaccard similarity is this close to the best are told apart by their edit distance.
TIE = 0.15
#: A side of at most so many rows (and of bounded bytes) is broadcast.
MAX_SMALL = 500_000
#: A value that holds more than this share of all rows is hot: at most 1 / HOT of them, which meet their rows by broadcast.
HOT = 1 / 1000


def _unaccented() -> tuple[str, str]:
    """Letters made of one plain letter and marks, and those plain letters."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        parts = unicodedata.normalize("NFKD", chr(code).lower())
        if len(parts) > 1 and chr(code).islower() and all(unicodedata.combining(c) for c in parts[1:]):
            pairs.append((chr(code), parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _PLAIN = _unaccented()


def plain(c: Column) -> Column:
    """Lower case without accents."""
    return F.regexp_replace(F.translate(F.lower(c), _ACCENTED, _PLAIN), r"\p{M}+", "")


def words(c: Column) -> Column:
    """Runs of letters of the plain form; a digit between letters belongs to its word."""
    return F.regexp_extract_all(plain(c), F.lit(r"\p{L}+(?:\p{Nd}\p{L}+)*"), 0)


def letters_only(c: Column) -> Column:
    return F.regexp_replace(plain(c), r"[^\p{L}]", "")


def pairs(text: Column) -> Column:
    """Distinct pairs of neighbouring letters; a single letter is its own."""
    return F.when(F.length(text) < 2, F.array(text)).otherwise(F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(..))"), 1)))


def _prefix(size: Column) -> Column:
    """Tokens of a set of `size` of which one must be shared by any set at least LEAST similar."""
    return (size - F.ceil(size * LEAST) + 1).cast("int")


def _ranked(items: DataFrame, ranks: DataFrame) -> DataFrame:
    """key, text, r (the ranks of its pairs, rarest first), n, bits (a 64-bit map of the ranks). Partitioned by key once; nothing after it moves."""
    spark = items.sparkSession
    # a stated number is kept by adaptive execution, which would read so few bytes in one task
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = items.repartition(parts, "key").select("key", "text", F.explode(pairs(F.col("text"))).alias("pair"))
    return rows.join(ranks, "pair").groupBy("key", "text").agg(F.array_sort(F.collect_list("rank")).alias("r"), F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("rank") % 64)).alias("bits")).withColumn("n", F.size("r"))


def _posted(entries: DataFrame, ranks: DataFrame) -> DataFrame:
    """The rare-prefix postings of the entries."""
    listed = _ranked(entries.withColumn("key", F.struct("ref", "text")), ranks)
    at = F.posexplode(F.slice("r", F.lit(1), _prefix(F.col("n"))))
    return listed.select(F.col("text").alias("e_text"), F.col("r").alias("e_r"), F.col("n").alias("m"), F.col("bits").alias("e_bits"), F.col("key.ref").alias("ref"), at.alias("e_at", "e_rank"))


def similar(items: DataFrame, posted: DataFrame, ranks: DataFrame) -> DataFrame:
    """key, text, ref, jaccard, edits of every item and entry at least LEAST similar.

    items: key, text. posted: postings. Every qualifying pair comes out once: at the rarest pair of letters both share.
    """
    left = _ranked(items, ranks)
    probe = left.select("key", "text", "r", "n", "bits", F.posexplode(F.slice("r", F.lit(1), _prefix(F.col("n")))).alias("at", "rank"))
    n, m = F.col("n"), F.col("m")
    need = F.ceil((n + m) * (LEAST / (1 + LEAST)) - 1e-9)
    on = (F.col("rank") == F.col("e_rank")) & (m >= n * LEAST) & (n >= m * LEAST) & (1 + F.least(n - F.col("at") - 1, m - F.col("e_at") - 1) >= need)
    # every bit of one map that the other lacks is a pair of letters not shared: a bound that costs no array
    on = on & (n - F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not("e_bits"))) >= need) & (m - F.bit_count(F.col("e_bits").bitwiseAND(F.bitwise_not("bits"))) >= need)
    met = probe.join(posted, on)
    # exploded, so that no later filter is pushed below the cheap conditions of the join and the sets are intersected once
    met = met.select("*", F.explode(F.array(F.array_intersect("r", "e_r"))).alias("shared"))
    both = F.size("shared")
    met = met.filter(F.get("shared", F.lit(0)) == F.col("rank")).withColumn("jaccard", both / (n + m - both)).filter(F.col("jaccard") >= LEAST)
    edits = F.levenshtein("text", "e_text") / F.greatest(F.length("text"), F.length("e_text"))
    return met.select("key", "text", "ref", "jaccard", edits.alias("edits"))


def _best(found: DataFrame, key: str, least: float) -> DataFrame:
    """key, ref, score: the most similar entry, where one is at least `least` similar; near ties go to fewer edits, then to the
    longer text and the smallest ref."""
    top = F.max("jaccard").over(Window.partitionBy(key))
    near = found.withColumn("top", top).filter((F.col("top") >= least) & (F.col("jaccard") >= F.col("top") - TIE))
    order = F.struct(F.col("edits"), -F.col("jaccard"), -F.length("text"), F.col("ref"))
    return near.groupBy(key).agg(F.min_by(F.struct("ref", "jaccard"), order).alias("b")).select(key, F.col("b.ref").alias("ref"), F.col("b.jaccard").alias("score"))


def _keys(names: DataFrame, entries: DataFrame, short: Column) -> DataFrame:
    """kind, k, ref: the least ref of each exact name, each abbreviation's letters and each name's letters."""
    exact = names.select(F.lit("name").alias("kind"), F.col("canon_name").alias("k"), "ref")
    initials = names.filter(short).select(F.lit("short"), letters_only(F.col("alt_name")), "ref")
    text = entries.select(F.lit("text"), "text", "ref")
    return exact.unionAll(initials).unionAll(text).filter("k <> ''").groupBy("kind", "k").agg(F.min("ref").alias("ref"))


def _stretches(values: DataFrame, longest: int) -> DataFrame:
    """key, start, text of every run of neighbouring words of at most `longest` letters."""
    most = F.least(F.size("ws"), F.lit(longest))  # a word has a letter at least
    runs = values.select("key", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("ws")), lambda a: F.slice("ws", a, most))).alias("start", "run"))
    upto = runs.select("key", "run", F.explode(F.sequence(F.lit(1), F.size("run"))).alias("k"))
    return upto.select("key", F.array_join(F.slice("run", F.lit(1), F.col("k")), "").alias("text")).filter(F.length("text") <= longest).distinct()


def _ranks(values: DataFrame, entries: DataFrame) -> DataFrame:
    """pair, rank: rarity over list and values together. As large as the alphabet squared at most."""
    seen = values.select(F.explode(pairs(F.col("text"))).alias("pair")).unionAll(entries.select(F.explode(pairs(F.col("text"))).alias("pair")))
    counts = cut_lineage(seen.groupBy("pair").agg(F.count("*").alias("n")))
    if is_small(counts, MAX_SMALL):
        return F.broadcast(counts.select("pair", F.row_number().over(Window.orderBy("n", "pair")).alias("rank")))
    return cut_lineage(global_rank(counts, ["n", "pair"]).select("pair", F.col("rank").cast("int").alias("rank")))


def canonical_values(values: DataFrame, canon: DataFrame) -> DataFrame:
    """value, ref, score of each distinct value that denotes an entry. values: value (distinct, not blank). See map_to_canonical."""
    names = canon.filter("ref_id is not null").select(F.col("ref_id").cast("bigint").alias("ref"), F.lower("item_kind").alias("kind"), "canon_name", "alt_name")
    short = F.coalesce(F.col("kind") == "condition", F.lit(False))
    full = names.select("ref", F.col("canon_name").alias("name")).unionAll(names.filter(~short).select("ref", "alt_name")).filter("name is not null")
    entries = cut_lineage(full.select("ref", F.array_join(words(F.col("name")), "").alias("text")).filter("text <> ''").distinct())
    sizes = entries.agg(F.max(F.length("text")).alias("longest"), F.count("*").alias("n")).first()
    longest = math.floor((sizes["longest"] or 0) / LEAST)
    # a name of the list has at most `longest` postings and two keys
    hint = F.broadcast if sizes["n"] * longest * max(longest, 8) * 8 <= MAX_BYTES else (lambda df: df)

    df = values.select("value", words(F.col("value")).alias("ws")).withColumn("text", F.array_join("ws", "")).withColumn("initials", letters_only(F.col("value")))
    keys = _keys(names, entries, short)
    for kind, column in (("name", "value"), ("short", "initials"), ("text", "text")):
        one = keys.filter(F.col("kind") == kind).select(F.col("k").alias(f"k_{kind}"), F.col("ref").alias(f"r_{kind}"))
        df = df.join(hint(one), F.col(column) == F.col(f"k_{kind}"), "left")
    df = df.select("value", "ws", "text", F.coalesce("r_name", "r_short", "r_text").alias("ref"))
    df = cut_lineage(df.withColumn("key", F.monotonically_increasing_id()))
    known = df.filter("ref is not null").select("value", "ref", F.lit(1.0).alias("score"))
    open_ = df.filter("ref is null and text <> ''")
    if not longest:
        return known

    ranks = _ranks(open_, entries)
    posted = hint(cut_lineage(_posted(entries, ranks)))
    whole = open_.filter(F.length("text") <= longest).select("key", "text")
    first = cut_lineage(_best(similar(whole, posted, ranks), "key", SURE))
    rest = open_.select("key", "ws").join(first.select("key"), "key", "left_anti")
    parts = _stretches(rest, longest).select(F.struct("key", "text").alias("key"), "text")
    found = similar(parts, posted, ranks).filter((F.col("jaccard") >= SURE) | (F.col("edits") <= MOST_EDITS)).select(F.col("key.key").alias("key"), "text", "ref", "jaccard", "edits")
    mapped = first.unionByName(_best(found, "key", LEAST)).join(df.select("key", "value"), "key").select("value", "ref", "score")
    return known.unionByName(mapped)


def map_to_canonical(rows: DataFrame, canon: DataFrame) -> DataFrame:
    """Adds ref_id (0: denotes no entry) and score (Jaccard similarity, 0.0 for none) to each row by its column `value`.

    canon: ref_id, item_kind, canon_name, alt_name. A condition's alt_name is an abbreviation: it denotes its entry only when all
    its letters and no others stand there in order. A value equal to a canon_name denotes it before anything else; then
    abbreviations, then names of the same letters, then the whole value from SURE on, at last its best run of neighbouring words
    (so doses and routes beside a name need no list of their own). Runs longer than the longest name / LEAST are not compared.
    Null, blank and letterless values denote nothing; an empty list maps everything to 0. Equal scores go to fewer edits, the
    longer text, the smallest ref_id. All other columns and repeated rows stay; columns already named ref_id or score are replaced.
    """
    rows = rows.drop("ref_id", "score")
    counted = rows.filter(F.coalesce(trim_blanks(F.col("value")), F.lit("")) != "").groupBy("value").agg(F.count("*").alias("n_rows"))
    counted = cut_lineage(counted)
    got = cut_lineage(canonical_values(counted, canon).join(counted, "value").select(F.col("value").alias("__v"), F.col("ref").alias("__ref"), F.col("score").alias("__score"), "n_rows"))
    found = got.drop("n_rows")
    on = F.col("value") == F.col("__v")
    if is_small(found, MAX_SMALL):
        out = rows.join(F.broadcast(found), on, "left")
    else:
        # at most 1 / HOT hot values meet their rows where they lie; all other rows meet by a shuffle
        total = counted.agg(F.sum("n_rows")).first()[0]
        hot = F.col("n_rows") > total * HOT
        near = rows.join(F.broadcast(got.filter(hot).drop("n_rows")), on, "left").drop("__v")
        far = near.filter("__ref is null").drop("__ref", "__score").join(got.filter(~hot).drop("n_rows"), on, "left")
        out = near.filter("__ref is not null").unionByName(far.drop("__v"))
    return out.select(*rows.columns, F.coalesce("__ref", F.lit(0).cast("bigint")).alias("ref_id"), F.coalesce("__score", F.lit(0.0)).alias("score"))
