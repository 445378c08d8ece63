"""Queries over note texts: sections, mentions, chunks, retrieval, answers, salvage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factgate.functions import clinical
from factgate.operators import notes, retrieval, validate
from factgate.operators.calibrate import global_rank
from factgate import vocab
from factgate.tables import small_rows
from factgate.tables import spread
from factgate.tables import table as t


def _notes(s: SparkSession, d: str) -> DataFrame:
    return validate.first_notes(spread(t(s, d, "notes_all")))


def _terms(s: SparkSession, d: str) -> list[str]:
    return [r.canon_name for r in small_rows(t(s, d, "canon_items").select("canon_name").filter("canon_name is not null"), 1_000_000, "canon_items")]


def w09_first_notes(s: SparkSession, d: str) -> DataFrame:
    """The first note of each subject by time and row (W-09)."""
    from factgate.operators.claims import first_of

    x = t(s, d, "notes_all").filter("subject_id is not null").select("subject_id", "note_id", "row_id", F.coalesce("note_time", F.lit("9999-12-31").cast("timestamp")).alias("at"))
    return first_of(x, [F.col("subject_id")], [F.col("at"), F.col("row_id")]).select("subject_id", "note_id", "row_id")


def f17_dates(s: SparkSession, d: str) -> DataFrame:
    return notes.dates(_notes(s, d))


def f14_sections(s: SparkSession, d: str) -> DataFrame:
    return notes.sections(_notes(s, d))


def m01_mentions(s: SparkSession, d: str) -> DataFrame:
    """Mentions with section and category (M-01, J-11, F-14, F-15, P-04)."""
    n = _notes(s, d)
    return notes.categorised(notes.with_section(notes.find_terms(n, _terms(s, d)), notes.sections(n)))


def f16_candidates(s: SparkSession, d: str) -> DataFrame:
    return notes.candidates(m01_mentions(s, d))


def m02_chunks(s: SparkSession, d: str) -> DataFrame:
    """Greedy paragraph chunks with their mentions (M-02, W-14, J-10)."""
    n = _notes(s, d)
    c = notes.chunks(n, 1500)
    inside = notes.in_chunks(notes.find_terms(n, _terms(s, d)), c).groupBy("note_id", "chunk_no").agg(F.count("*").alias("n_mentions"))
    return c.join(inside, ["note_id", "chunk_no"], "left").select("note_id", "chunk_no", "start", "stop", F.coalesce("n_mentions", F.lit(0)).alias("n_mentions"))


def _answers(prompts: list[str]) -> list[str]:
    """A stand-in generator: one fact per candidate; its value says whether the prompt holds a prior fact of it."""
    import json

    out = []
    for p in prompts:
        names, *prior = p.rsplit("Candidates: ", 1)[-1].split("\n")
        facts = [{"entity": x, "attribute": "mentioned", "value": "again" if any(f"Prior: ({x}," in y for y in prior) else "yes", "fhir_type": "Observation"} for x in names.split(", ") if x != "none"]
        out.append("```json\n" + json.dumps(facts) + "\n```")
    return out


def _prompts(s: SparkSession, d: str) -> DataFrame:
    n = _notes(s, d)
    return notes.prompts(notes.chunks(n, 1500), n, notes.find_terms(n, _terms(s, d)))


def m05_in_turn(s: SparkSession, d: str) -> DataFrame:
    """Facts of chunks in turn, each prompt with the prior facts of its note (M-05), from the stand-in generator."""
    return notes.extract_in_turn(_prompts(s, d), _answers).select("note_id", "chunk_no", "pos", "entity", "attribute", "value")


def m06_extracted(s: SparkSession, d: str) -> DataFrame:
    """Facts from a stand-in generator that answers each prompt, in independent batches, with one fact per candidate (M-04, M-06, M-07, F-21)."""
    return notes.extract(_prompts(s, d), _answers).select("note_id", "chunk_no", "pos", "entity", "attribute", "value")


def m03_context(s: SparkSession, d: str) -> DataFrame:
    """The context of each chunk's prompt: code titles and canonical names that the terms of the chunk find (M-03)."""
    n = _notes(s, d)
    mentioned = notes.context_mentions(notes.find_terms(n, _terms(s, d)), notes.chunks(n, 1500))
    terms = mentioned.select("term").distinct()
    titles = t(s, d, "d_icd_diagnoses").filter("icd9_code is not null").groupBy(F.concat(F.lit("ICD9:"), "icd9_code").alias("doc_id")).agg(F.min("long_title").alias("text"))
    corpus = titles.unionByName(t(s, d, "canon_items").filter("ref_id is not null").select(F.concat(F.lit("LIST:"), F.col("ref_id").cast("string")).alias("doc_id"), F.col("canon_name").alias("text")))
    hits = retrieval.bm25(corpus, terms.select(F.col("term").alias("query_id"), F.col("term").alias("text")), notes.CONTEXT_HITS)
    named = hits.join(corpus, "doc_id").select(F.col("query_id").alias("term"), F.col("text").alias("title"), F.col("doc_id").alias("code"), "score", "place")
    return notes.ontology_context(mentioned, named)


def m08_entropy(s: SparkSession, d: str) -> DataFrame:
    """Entropy of the softmax of each vector, the formula of a generator's token entropy (M-08, F-31)."""
    e = F.transform("embedding", lambda x: F.exp(x.cast("double")))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return t(s, d, "embeddings").select("vec_id", F.round(notes.entropy(F.array(F.transform(e, lambda x: x / total))), 5).alias("entropy"))


def h2_chunks(s: SparkSession, d: str) -> DataFrame:
    """Chunks by a table function called from SQL (H-2)."""
    name = notes.register_chunk_note(s)
    return s.sql(f"SELECT note_id, c.* FROM {{n}}, LATERAL {name}(text, 1500) AS c", n=_notes(s, d).select("note_id", "text"))


def f24_negation(s: SparkSession, d: str) -> DataFrame:
    """All and positive occurrences of the ten concepts by note (F-24)."""
    x = _notes(s, d).select("note_id", *(F.struct(*(c.alias(n) for c, n in zip(clinical.positive_mentions(F.col("text"), k), ("n_all", "n_positive"), strict=True))).alias(k) for k in vocab.CONCEPTS))
    return x.select("note_id", F.explode(F.array(*[F.struct(F.lit(k).alias("concept"), F.col(k)["n_all"].alias("n_all"), F.col(k)["n_positive"].alias("n_positive")) for k in vocab.CONCEPTS])).alias("r")).select("note_id", "r.*").filter("n_all > 0")


def e09_keyword(s: SparkSession, d: str) -> DataFrame:
    """Notes where a concept occurs only negated, and those of them that no claim names either (E-09, U-04)."""
    from factgate.operators.claims import claims_of

    found = f24_negation(s, d)
    said = claims_of(t(s, d, "triples")).filter("note_id is not null").select("note_id", F.lower(F.concat_ws(" ", "entity", "value")).alias("said"))
    named = said.select("note_id", F.explode(F.filter(F.array(*[F.lit(k) for k in vocab.CONCEPTS]), lambda k: F.contains(F.col("said"), k))).alias("concept")).distinct()
    false = found.filter("n_positive = 0").select("note_id", "concept")
    avoided = false.join(named, ["note_id", "concept"], "left_anti")
    by = found.groupBy("concept").agg(F.count("*").alias("n_keyword"))
    return by.join(false.groupBy("concept").agg(F.count("*").alias("n_false")), "concept", "left").join(avoided.groupBy("concept").agg(F.count("*").alias("n_avoided")), "concept", "left").fillna(0)


def r02_bm25(s: SparkSession, d: str) -> DataFrame:
    """Five best code titles for each canonical condition (R-01, R-02, O-01, F-13)."""
    corpus = t(s, d, "d_icd_diagnoses").select("icd9_code", "long_title").filter("icd9_code is not null").groupBy(F.col("icd9_code").alias("doc_id")).agg(F.min("long_title").alias("text"))
    q = t(s, d, "canon_items").filter("item_kind = 'condition'").select(F.col("ref_id").alias("query_id"), F.col("canon_name").alias("text"))
    return retrieval.bm25(corpus, q, 5)


def _query_vectors(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = t(s, d, "embeddings")
    return v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), v.select("vec_id", F.col("embedding").alias("v"))


def r03_dense(s: SparkSession, d: str) -> DataFrame:
    """Five nearest vectors of every hundredth vector (R-03, R-07, R-10, J-15, O-02)."""
    return retrieval.dense(*_query_vectors(s, d), 5)


def r08_options(s: SparkSession, d: str) -> DataFrame:
    """Option margins: nearest of even against nearest of odd labels, with the ternary decision (R-08, R-09)."""
    q, v = _query_vectors(s, d)
    labels = t(s, d, "embeddings").select("vec_id", F.when(F.col("label") % 2 == 0, "+").otherwise("-").alias("polarity"))
    sides = [retrieval.dense(q, v.join(labels.filter(F.col("polarity") == p).select("vec_id"), "vec_id", "left_semi"), 10).withColumn("polarity", F.lit(p)) for p in "+-"]
    m = retrieval.option_scores(sides[0].unionByName(sides[1]))
    return m.select("query_id", *(F.round(c, 5).alias(c) for c in ("pos", "neg", "margin")), retrieval.ternary(F.col("margin")).alias("decision"))


def _titles(s: SparkSession, d: str) -> DataFrame:
    """Code titles with a number of their own: doc_id, text."""
    codes = t(s, d, "d_icd_diagnoses").filter("icd9_code is not null and long_title is not null").groupBy("icd9_code").agg(F.min("long_title").alias("text"))
    return global_rank(codes.select("icd9_code", "text"), ["icd9_code"]).select(F.col("rank").alias("doc_id"), "text")


def _cut(c: str | Column) -> Column:
    """Cut to three places; ties of a rounded number would depend on its last bit."""
    return F.floor((F.col(c) if isinstance(c, str) else c) * 1000 + 1e-6) / 1000


def r06_enriched(s: SparkSession, d: str) -> DataFrame:
    """Lexical, vector and graph evidence of every claim, fused (R-05, R-06)."""
    tr = t(s, d, "triples").filter("source <> 'ehr'")
    c = tr.select(F.col("triple_id").alias("claim_id"), "entity", "value")
    edges = tr.select(F.trim(F.coalesce("entity", F.lit(""))).alias("src"), F.trim(F.coalesce("value", F.lit(""))).alias("dst"))
    x = retrieval.enriched(c, _titles(s, d), edges)
    return x.select("claim_id", "lexical", _cut("dense").alias("dense"), "neighbours", _cut("score").alias("score"))


def r05_fused(s: SparkSession, d: str) -> DataFrame:
    """Mean evidence by note (R-06): the fused scores of its claims."""
    of = t(s, d, "triples").filter("source <> 'ehr' and note_id is not null").select(F.col("triple_id").alias("claim_id"), "note_id")
    return r06_enriched(s, d).join(of, "claim_id").groupBy("note_id").agg(F.count("*").alias("n"), _cut(F.avg("score")).alias("mean_score"))


def _facts(s: SparkSession, d: str) -> DataFrame:
    """Distinct facts of the models with the id of their first claim; a fact that denies carries '-'."""
    f = t(s, d, "triples").filter("source <> 'ehr'").groupBy("entity", "attribute", "value").agg(F.min("triple_id").alias("doc_id"))
    denies = F.coalesce(F.lower("value").rlike(r"\b(absent|negative|denied|none|no)\b"), F.lit(False))
    return f.withColumn("polarity", F.when(denies, "-").otherwise("+"))


def _knowledge(s: SparkSession, d: str) -> DataFrame:
    f = _facts(s, d)
    q = t(s, d, "canon_items").filter("item_kind = 'condition'").select(F.col("ref_id").alias("query_id"), F.col("canon_name").alias("text"))
    return retrieval.knowledge(retrieval.bm25(f.select("doc_id", retrieval.fact_text().alias("text")), q, 5), f)


def r07_lines(s: SparkSession, d: str) -> DataFrame:
    """The five facts nearest to each canonical condition, as lines with polarity (R-07)."""
    return _knowledge(s, d).select("query_id", "lines")


def r10_augmented(s: SparkSession, d: str) -> DataFrame:
    """A question about each canonical condition with the facts found for it (R-10)."""
    q = t(s, d, "canon_items").filter("item_kind = 'condition'").select(F.col("ref_id").alias("query_id"), F.lit("A chart review.").alias("context"), F.concat(F.lit("Is there "), "canon_name", F.lit("?")).alias("question"))
    return retrieval.augmented(q, _knowledge(s, d))


def f22_answers(s: SparkSession, d: str) -> DataFrame:
    rows = ["Answer: b", "C", "(D)", "", "<think>A or B</think> The correct answer is (c)", "I would say B, but Answer: D", "answer: no", "Yes, because", "verdict is maybe", "Hardly; no", "**A**) first"]
    x = s.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, response string")
    return x.select("id", clinical.choice_answer(F.col("response")).alias("letter"), clinical.verdict_answer(F.col("response")).alias("verdict"))


def f21_salvage(s: SparkSession, d: str) -> DataFrame:
    """Facts read back from model output in several states of damage."""
    raw = ['```json\n[{"entity": "a", "value": 1}]\n```', '{"triples": [{"entity": "b"}]}', '[{"entity":"c"},{"entity":', 'x {"entity":"d"} y', '<think>[]</think>[{"entity":"e"}] done', ""]
    x = s.createDataFrame([(i, r) for i, r in enumerate(raw)], "note_id bigint, prompt string").withColumn("chunk_no", F.lit(0))
    return notes.extract(x, lambda p: p).select("note_id", "pos", "entity", "value")


def f35_props(s: SparkSession, d: str) -> DataFrame:
    """JSON decoded by a declared schema and encoded again (F-35)."""
    x = t(s, d, "events").select("event_id", F.from_json("props", "k int").alias("p"))
    return x.select("event_id", F.col("p.k").alias("k"), F.to_json(F.struct((F.col("p.k") * 2).alias("k"))).alias("doubled"))


QUERIES = {f.__name__: f for f in (w09_first_notes, f17_dates, f14_sections, m01_mentions, f16_candidates, m02_chunks, m03_context, m05_in_turn, m06_extracted, m08_entropy, h2_chunks, f24_negation, e09_keyword, r02_bm25, r03_dense, r08_options, r05_fused, r06_enriched, r07_lines, r10_augmented, f22_answers, f21_salvage, f35_props)}

from factgate.plans.oracles import TEXT as ORACLE  # noqa: E402
