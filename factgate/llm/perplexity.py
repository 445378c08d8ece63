"""Perplexity of each document under a modified Kneser-Ney trigram model of its own language, and bands around it.

N-grams are 64-bit hashes counted by Spark over all documents; continuation counts, discounts and back-off weights are
aggregations of those counts. The model is a pair of arrays, hashes in order and log probabilities. While it is small enough
(a checked bound) it is sent to every task and searched there; beyond, the same arrays stay partitioned and are joined by hash.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgate.functions.text import trim_blanks
from factgate.session import cut_lineage
from factgate.tables import is_small

#: Entries (12 bytes each) of a model that is sent to the tasks.
MAX_LOCAL = 300_000
#: Bands: so many standard deviations of log perplexity around a language's mean.
WIDTH = 2.0
LEAST_WORDS = 5
#: Tables of one row a language are broadcast up to so many languages.
MAX_LANGUAGES = 100_000
_WORD = re.compile(r"[^\W_]+")


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(29))


def _grams(texts: list[str | None], langs: list[str], known: dict) -> tuple[np.ndarray, ...]:
    """(document, u, v, w) hashes of every word with the two before it; begins of texts are padded."""
    flat: list[int] = []
    owner: list[np.ndarray] = []
    for i, (text, lang) in enumerate(zip(texts, langs, strict=True)):
        ws = _WORD.findall(text.lower()) if text else []
        if len(known) > 500_000:
            known.clear()
        seed = zlib.crc32(lang.encode())
        out = [seed, seed]
        for w in ws:
            h = known.get((seed, w))
            if h is None:
                h = known[seed, w] = xxhash.xxh64_intdigest(w, seed)
            out.append(h)
        flat += out
        owner.append(np.full(len(out), i, np.int32))
    if not flat:
        z = np.zeros(0, np.uint64)
        return np.zeros(0, np.int32), z, z, z
    a, o = np.array(flat, np.uint64), np.concatenate(owner)
    at = np.flatnonzero(o[:-2] == o[2:])
    return o[at], a[at], a[at + 1], a[at + 2]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _lang() -> Column:
    low = F.lower(trim_blanks(F.col("lang")))
    return F.when(F.coalesce(low, F.lit("")) == "", "und").otherwise(low).alias("lang")


def count_trigrams(docs: DataFrame) -> DataFrame:
    """h3, n, and the hashes of its parts, each distinct trigram once; combined in every batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            langs = b.column("lang").to_pylist()
            doc, u, v, w = _grams(b.column("text").to_pylist(), langs, known)
            uv, vw = _mix(u, v), _mix(v, w)
            h, first, n = np.unique(_mix(uv, w), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [_signed(h), pa.array(n.astype(np.int64)), _signed(uv[first]), _signed(vw[first]), _signed(v[first]), _signed(w[first]), pa.array([langs[i] for i in doc[first]], pa.string())],
                names=["h3", "n", "uv", "vw", "v", "w", "lang"],
            )

    got = docs.select("text", _lang()).mapInArrow(run, "h3 bigint, n bigint, uv bigint, vw bigint, v bigint, w bigint, lang string")
    return got.groupBy("h3").agg(F.sum("n").alias("n"), *(F.min(c).alias(c) for c in ("uv", "vw", "v", "w", "lang")))


def _discounts(counts: DataFrame, n: str, hint=F.broadcast) -> DataFrame:
    """d1, d2, d3 of each language from its numbers of n-grams seen once to four times."""
    s = counts.groupBy("lang").agg(*(F.count_if(F.col(n) == i).alias(f"n{i}") for i in (1, 2, 3, 4)))
    y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1))

    def d(i: int) -> Column:
        raw = i - (i + 1) * y * F.col(f"n{i + 1}") / F.greatest(F.col(f"n{i}"), F.lit(1))
        return F.greatest(F.lit(0.05), F.least(F.lit(i - 0.05), raw)).alias(f"d{i}")

    return hint(s.select("lang", d(1), d(2), d(3)))  # one row a language


def _discount(n: Column) -> Column:
    return F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))


def _context(counts: DataFrame, key: str, n: str) -> DataFrame:
    """Mass of a context and what its discounts free."""
    return counts.groupBy(key).agg(F.sum(n).alias("mass"), *(F.count_if(F.col(n) == i).alias(f"k{i}") for i in (1, 2)), F.count_if(F.col(n) >= 3).alias("k3"))


def _interpolated(n: Column, lower: Column) -> Column:
    freed = (F.col("d1") * F.col("k1") + F.col("d2") * F.col("k2") + F.col("d3") * F.col("k3")) / F.col("mass")
    return (n - _discount(n)) / F.col("mass") + freed * lower


def train(tri: DataFrame, hint=F.broadcast) -> DataFrame:
    """h3, logp: interpolated modified Kneser-Ney probability of every trigram seen. tri: count_trigrams, best checkpointed. hint: how
    tables of one row a language are joined."""
    bi = tri.groupBy("vw").agg(F.count("*").alias("n"), F.min("v").alias("v"), F.min("w").alias("w"), F.min("lang").alias("lang"))
    uni = bi.groupBy("w").agg(F.count("*").alias("n"), F.min("lang").alias("lang"))
    whole = hint(_context(uni, "lang", "n").join(uni.groupBy("lang").agg(F.count("*").alias("words")), "lang"))
    p1 = uni.join(_discounts(uni, "n", hint), "lang").join(whole, "lang").select("w", _interpolated(F.col("n"), 1 / F.col("words")).alias("p1"))
    p2 = bi.join(_discounts(bi, "n", hint), "lang").join(_context(bi, "v", "n"), "v").join(p1, "w").select("vw", _interpolated(F.col("n"), F.col("p1")).alias("p2"))
    p3 = tri.join(_discounts(tri, "n", hint), "lang").join(_context(tri, "uv", "n"), "uv").join(p2, "vw")
    return p3.select("h3", F.ln(_interpolated(F.col("n"), F.col("p2"))).cast("float").alias("logp"))


def _scored_locally(docs: DataFrame, model: DataFrame) -> DataFrame:
    pdf = model.toPandas().sort_values("h3")
    shared = docs.sparkSession.sparkContext.broadcast((pdf["h3"].to_numpy(np.int64), pdf["logp"].to_numpy(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, logp = shared.value
        known: dict = {}
        for b in batches:
            doc, u, v, w = _grams(b.column("text").to_pylist(), b.column("lang").to_pylist(), known)
            p = logp[np.searchsorted(keys, _mix(_mix(u, v), w).view(np.int64))] if len(doc) else np.zeros(0)
            n = np.bincount(doc, minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), pa.array(n.astype(np.int64)), pa.array(np.bincount(doc, p, minlength=b.num_rows))], names=["doc_id", "lang", "n_words", "logp"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string, n_words bigint, logp double")


def _scored_joined(docs: DataFrame, model: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            doc, u, v, w = _grams(b.column("text").to_pylist(), b.column("lang").to_pylist(), known)
            h = _mix(_mix(u, v), w).view(np.int64)
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]) if len(doc) else np.zeros(0, int)
            n = np.diff(np.r_[new, len(doc)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(doc[new])), pa.array(h[new]), pa.array(n.astype(np.int64))], names=["doc_id", "h3", "n"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    sums = docs.mapInArrow(run, f"doc_id {kind}, h3 bigint, n bigint").join(model, "h3").groupBy("doc_id").agg(F.sum("n").alias("n_words"), F.sum(F.col("n") * F.col("logp").cast("double")).alias("logp"))
    return docs.select("doc_id", "lang").join(sums, "doc_id", "left").select("doc_id", "lang", F.coalesce("n_words", F.lit(0)).alias("n_words"), F.coalesce("logp", F.lit(0.0)).alias("logp"))


def perplexity_bands(docs: DataFrame, width: float = WIDTH, max_local: int = MAX_LOCAL) -> DataFrame:
    """doc_id, lang, n_words, perplexity, band of every document.

    docs: doc_id (unique), text, lang. band: 'low' (repeats what the corpus or it itself says), 'high' (unlike its language),
    'ok', or 'short' under LEAST_WORDS words, which have no perplexity. The bands of a language are its mean log perplexity
    plus and minus `width` deviations. Null and blank languages are one language, upper case counts as lower.
    """
    docs = docs.select("doc_id", "text", _lang())
    tri = cut_lineage(count_trigrams(docs.select("text", "lang")))
    # languages are free text: their tables are broadcast only if few are counted
    hint = F.broadcast if is_small(docs.select("lang").distinct(), MAX_LANGUAGES) else (lambda df: df)
    model = train(tri, hint)
    local = tri.limit(max_local + 1).count() <= max_local
    scored = cut_lineage(_scored_locally(docs, model) if local else _scored_joined(docs, model))
    loss = F.when(F.col("n_words") >= LEAST_WORDS, -F.col("logp") / F.col("n_words"))
    scored = scored.select("doc_id", "lang", "n_words", loss.alias("loss"))
    level = scored.groupBy("lang").agg(F.avg("loss").alias("mean"), F.coalesce(F.stddev_pop("loss"), F.lit(0.0)).alias("sd"))
    x = scored.join(hint(level), "lang")  # one row a language
    band = F.when(F.col("loss").isNull(), "short").when(F.col("loss") < F.col("mean") - width * F.col("sd"), "low").when(F.col("loss") > F.col("mean") + width * F.col("sd"), "high").otherwise("ok")
    return x.select("doc_id", "lang", "n_words", F.round(F.exp("loss"), 4).alias("perplexity"), band.alias("band"))
