"""Lexical, vector and graph retrieval, their fusion, and option scoring."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgate.functions.text import normalize
from factgate.session import cut_lineage
from factgate.tables import broadcast_if_small

K1, B = 1.5, 0.75
WEIGHTS = (0.3, 0.5, 0.2)
#: A scored side of at most so many rows is broadcast against the other.
MAX_SMALL = 200_000
#: Bytes of the query vectors that are on the driver and broadcast at one time.
BLOCK_BYTES = 32 << 20


def terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf."""
    n = normalize(F.coalesce(F.col(text), F.lit("")))
    return df.select(key, F.explode(F.split(n, " ")).alias("term")).filter("term <> ''").groupBy(key, "term").agg(F.count("*").alias("tf"))


def bm25(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best documents of each query with a positive score: query_id, doc_id, score, place (ties by doc_id).

    corpus: doc_id, text. queries: query_id, text. Distinct query terms; idf = ln(1 + (N - df + .5) / (df + .5)). Only terms of
    the queries are looked up, and the term statistics are computed by one aggregation of the corpus.
    """
    post = terms(corpus, "doc_id", "text")
    wanted = terms(queries, "query_id", "text").select("query_id", "term")
    post = post.join(broadcast_if_small(wanted.select("term").distinct(), MAX_SMALL), "term", "left_semi")
    sizes = corpus.select("doc_id", F.size(F.filter(F.split(normalize(F.coalesce("text", F.lit(""))), " "), lambda x: x != "")).alias("len"))
    stats = sizes.agg(F.count("*").alias("n"), F.avg("len").alias("mean")).first()
    n, mean = stats["n"], stats["mean"] or 1.0
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.select("term", F.ln(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    hits = post.join(wanted, "term").join(idf, "term").join(sizes, "doc_id")
    score = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(mean)))
    return best(hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(score), 6).alias("score")).filter("score > 0"), "query_id", "doc_id", k)


def best(scored: DataFrame, group: str, item: str, k: int) -> DataFrame:
    """Top k of each group by score, ties by item. A top-k, so the row-number limit is applied before the shuffle."""
    w = Window.partitionBy(group).orderBy(F.desc("score"), item)
    return scored.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a) * dot(b, b)), F.lit(1e-12))


def dense(queries: DataFrame, vectors: DataFrame, k: int, normalised: bool = True) -> DataFrame:
    """The k nearest other vectors of each query: query_id, vec_id, score, place (ties by vec_id). Exact.

    queries: query_id, q. vectors: vec_id, v. A stated query set against all rows, in blocks of BLOCK_BYTES: one block at a time
    is sent to every task, which multiplies it with its rows in small slices and keeps k rows a query; with several blocks each one's
    result is written down before the next begins. Null vectors are no rows. normalised: cosine, else the raw product.
    """
    spark = queries.sparkSession
    rows = queries.filter("q is not null").select("query_id", "q")
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("q")), F.lit(1)).alias("d")).first()
    blocks = max(1, -(-size["n"] * size["d"] * 8 // BLOCK_BYTES))
    out = None
    for i in range(blocks):
        pdf = rows.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).toPandas()
        q = np.stack(pdf["q"].to_numpy()).astype(np.float64) if len(pdf) else np.zeros((0, 1))
        if normalised and len(q):
            q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
        shared = spark.sparkContext.broadcast((pdf["query_id"].to_numpy(np.int64), q))

        def run(parts, shared=shared):
            ids, q = shared.value
            m = len(ids)
            best_s, best_v = np.full((m, k), -np.inf), np.full((m, k), np.iinfo(np.int64).max)
            for p in parts:
                step = max(1, 4_000_000 // max(1, m))
                for a in range(0, len(p), step):
                    part = p.iloc[a : a + step]
                    vid = part["vec_id"].to_numpy(np.int64)
                    v = np.stack(part["v"].to_numpy()).astype(np.float64)
                    if normalised:
                        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                    s = np.round(q @ v.T, 6)
                    s[ids[:, None] == vid[None, :]] = -np.inf
                    s, w = np.hstack([best_s, s]), np.hstack([best_v, np.broadcast_to(vid, s.shape)])
                    order = np.lexsort((w, -s))[:, :k]
                    best_s, best_v = np.take_along_axis(s, order, 1), np.take_along_axis(w, order, 1)
            ok = np.isfinite(best_s)
            yield pd.DataFrame({"query_id": np.repeat(ids, ok.sum(1)), "vec_id": best_v[ok], "score": best_s[ok]})

        got = vectors.filter("v is not null").select("vec_id", "v").mapInPandas(run, "query_id bigint, vec_id bigint, score double")
        if blocks > 1:
            got = cut_lineage(best(got, "query_id", "vec_id", k).drop("place"))
            shared.destroy()
        out = got if out is None else out.unionAll(got)
    return best(out, "query_id", "vec_id", k)


def fuse(bm25_score: Column, dense_score: Column, n_neighbours: Column) -> Column:
    """Weighted sum of s / max(s + 1, 1), (cosine + 1) / 2 and min(n / 5, 1); 4 places."""
    a, b, c = WEIGHTS
    s = F.coalesce(bm25_score, F.lit(0.0))
    d = F.when(dense_score.isNull(), 0.0).otherwise((dense_score + 1) / 2)
    return F.round(a * s / F.greatest(s + 1, F.lit(1.0)) + b * d + c * F.least(F.coalesce(n_neighbours, F.lit(0)) / 5, F.lit(1.0)), 4)


def pair_vector(text: Column, dims: int = 64) -> Column:
    """A stand-in encoder in Arrow batches: counts of hashed pairs of neighbouring characters of the normal form. A trained encoder
    would take its place."""

    @F.pandas_udf("array<double>")
    def encode(s: pd.Series) -> pd.Series:
        def one(t: str) -> np.ndarray:
            codes = np.append(np.frombuffer(t.encode("utf-32-le"), np.uint32), 0).astype(np.int64)
            pairs = codes[:-1] * 7 + codes[1:]
            return np.bincount((pairs[:-1] if len(pairs) > 1 else pairs) % dims, minlength=dims).astype(float)

        return s.map(one)

    return encode(normalize(F.coalesce(text, F.lit(""))))


def enriched(claims: DataFrame, corpus: DataFrame, edges: DataFrame) -> DataFrame:
    """claim_id, lexical, dense, neighbours, score of each claim against a corpus and a graph; an empty claim scores 0.

    claims: claim_id, entity, value. corpus: doc_id (bigint), text. edges: src, dst. The best lexical and the best vector score of the
    claim's entity and value, the edges that touch its entity. Each distinct text and entity is looked up once.
    """
    text = F.trim(F.concat_ws(" ", F.coalesce("entity", F.lit("")), F.coalesce("value", F.lit(""))))
    c = claims.select("claim_id", F.lower(F.trim(F.coalesce("entity", F.lit("")))).alias("key"), text.alias("text"))
    texts = cut_lineage(c.filter("text <> ''").select("text").distinct().withColumn("query_id", F.monotonically_increasing_id()))
    lex = bm25(corpus, texts, 1).select("query_id", F.col("score").alias("lexical"))
    vec = dense(texts.select((-F.col("query_id") - 1).alias("query_id"), pair_vector(F.col("text")).alias("q")), corpus.select(F.col("doc_id").alias("vec_id"), pair_vector(F.col("text")).alias("v")), 1)
    found = texts.join(lex, "query_id", "left").join(vec.select((-F.col("query_id") - 1).alias("query_id"), F.col("score").alias("dense")), "query_id", "left").drop("query_id")
    ends = edges.select(F.explode(F.array_distinct(F.array(F.lower("src"), F.lower("dst")))).alias("key")).filter("key <> ''").groupBy("key").agg(F.count("*").alias("neighbours"))
    x = c.join(found, "text", "left").join(ends, "key", "left").withColumn("neighbours", F.coalesce("neighbours", F.lit(0)))
    score = F.when(F.col("text") == "", 0.0).otherwise(fuse(F.col("lexical"), F.col("dense"), F.col("neighbours")))
    return x.select("claim_id", F.coalesce("lexical", F.lit(0.0)).alias("lexical"), "dense", "neighbours", score.alias("score"))


def fact_text(cut: int = 512) -> Column:
    """Text of a fact (entity, attribute, value) as it is indexed, cut to so many characters."""
    return F.left(F.trim(F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in ("entity", "attribute", "value")))), F.lit(cut))


def knowledge(top: DataFrame, facts: DataFrame) -> DataFrame:
    """query_id, lines, knowledge: the facts retrieved for each query in order, as lines with their polarity and as running text.

    top: query_id, doc_id, place (at most a few a query). facts: doc_id, entity, attribute, value, polarity ('+' where it is missing).
    """
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("entity", "attribute", "value")]
    line = F.concat(F.lit("["), F.coalesce("polarity", F.lit("+")), F.lit("] ("), F.concat_ws(", ", *parts), F.lit(")"))
    x = top.join(facts, "doc_id").select("query_id", F.struct("place", line.alias("line"), F.concat_ws(" ", *parts).alias("text")).alias("f"))
    g = x.groupBy("query_id").agg(F.array_sort(F.collect_list("f")).alias("f"))  # as many as were retrieved
    lines = F.concat_ws("\n", F.lit("Medical knowledge graph:"), F.array_join(F.transform("f", lambda y: y["line"]), "\n"))
    return g.select("query_id", lines.alias("lines"), F.array_join(F.transform("f", lambda y: y["text"]), " ").alias("knowledge"))


def augmented(questions: DataFrame, found: DataFrame) -> DataFrame:
    """query_id, prompt: context, what was found, and the question; without a finding only context and question. questions: query_id, context, question."""
    x = questions.join(found.select("query_id", "knowledge"), "query_id", "left")
    return x.select("query_id", F.concat(F.col("context"), F.coalesce(F.concat(F.lit(" Medical knowledge: "), "knowledge"), F.lit("")), F.lit(" Question: "), F.col("question")).alias("prompt"))


def option_scores(scored: DataFrame, k: int = 10) -> DataFrame:
    """query_id, pos, neg, margin: means of the k best scores of positive and of negative facts. scored: query_id, vec_id, polarity, score."""
    w = Window.partitionBy("query_id", "polarity").orderBy(F.desc("score"), "vec_id")
    top = scored.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
    means = top.groupBy("query_id").agg(*(F.coalesce(F.avg(F.when(F.col("polarity") == p, F.col("score"))), F.lit(0.0)).alias(n) for p, n in (("+", "pos"), ("-", "neg"))))
    return means.withColumn("margin", F.col("pos") - F.col("neg"))


def ternary(margin: Column, width: float = 0.02) -> Column:
    return F.when(margin > width, "yes").when(margin < -width, "no").otherwise("maybe")
