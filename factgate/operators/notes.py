"""Notes to mentions, dates, sections, chunks and facts: the text side of extraction.

Regular expressions with offsets run in Arrow batches of Python, one pass a note; everything after is relational.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgate.functions import mentions as kernels
from factgate.functions.text import normalize
from factgate.functions.clinical import category

CHUNK = 6000
#: Times a generator is asked before its answer counts as empty.
ATTEMPTS = 4
#: Context of a prompt: mentions looked up, their least length, hits a mention and the least score of a hit.
CONTEXT_MENTIONS, CONTEXT_LENGTH, CONTEXT_HITS, CONTEXT_SCORE = 30, 3, 2, 0.5
#: Prior facts in a prompt: mentions looked up, facts a mention, lines in all.
PRIOR_MENTIONS, PRIOR_FACTS, PRIOR_LINES = 10, 2, 10
FIELDS = ("entity", "attribute", "value", "fhir_type", "temporal_anchor", "evidence_span")
FACTS = "note_id bigint, chunk_no int, pos int, " + ", ".join(f"{f} string" for f in FIELDS)


def _per_note(notes: DataFrame, kernel: Callable[[str], list[tuple]], columns: str) -> DataFrame:
    """One row per tuple the kernel gives for a note's text. notes: note_id, text. Null texts give none."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(k, *r) for k, t in zip(p["note_id"], p["text"], strict=True) if t for r in kernel(t)]
            yield pd.DataFrame(rows, columns=["note_id", *names])

    return notes.select("note_id", "text").filter("text is not null").mapInPandas(run, f"note_id bigint, {columns}")


def dates(notes: DataFrame) -> DataFrame:
    """note_id, raw, form, start, stop, kind of all absolute and relative dates."""
    return _per_note(notes, kernels.date_mentions, "raw string, form string, start int, stop int, kind string")


def sections(notes: DataFrame) -> DataFrame:
    """note_id, start, section of all header words."""
    return _per_note(notes, kernels.section_starts, "start int, section string")


def chunks(notes: DataFrame, limit: int = CHUNK) -> DataFrame:
    """note_id, chunk_no, start, stop of greedily filled paragraphs."""
    return _per_note(notes, lambda t: [(i, a, b) for i, (a, b) in enumerate(kernels.chunk_paragraphs(t, limit))], "chunk_no int, start int, stop int")


def find_terms(notes: DataFrame, terms: list[str]) -> DataFrame:
    """note_id, text, start, stop of every occurrence of the terms as whole words: the stand-in for a mention model.

    Spans of 2 to 200 characters; generic words are no mentions. Hits come from one automaton over all terms.
    """
    generic = {"the", "a", "an", "patient", "history", "none", "normal", "no", "yes", "he"}
    wanted = sorted({t.lower() for t in terms if 2 <= len(t) <= 200} - generic)

    def kernel(text: str, _cache: dict = {}) -> list[tuple]:  # noqa: B006 - one automaton a worker
        if "a" not in _cache:
            import ahocorasick

            a = ahocorasick.Automaton()
            for t in wanted:
                a.add_word(t, t)
            if wanted:
                a.make_automaton()
            _cache["a"] = a
        low = kernels.lower_in_place(text)
        out = []
        if not wanted:
            return out
        for end, t in _cache["a"].iter(low):
            s = end - len(t) + 1
            if (s == 0 or not low[s - 1].isalnum()) and (end + 1 == len(low) or not low[end + 1].isalnum()):
                out.append((text[s : end + 1], s, end + 1))
        return out

    return _per_note(notes, kernel, "text string, start int, stop int")


def with_section(found: DataFrame, heads: DataFrame) -> DataFrame:
    """Adds the last section that starts before each mention, UNKNOWN for none: an as-of join by a running window over the union."""
    a = found.withColumns({"at": F.col("start") * 2, "head": F.lit(None).cast("string")})
    b = heads.select("note_id", (F.col("start") * 2 + 1).alias("at"), F.col("section").alias("head"))
    both = a.unionByName(b, allowMissingColumns=True)
    # a header at the mention's own offset does not precede it; among headers at one offset the first named wins
    w = Window.partitionBy("note_id").orderBy("at", F.desc("head")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("section", F.coalesce(F.last("head", ignorenulls=True).over(w), F.lit("UNKNOWN"))).filter("head is null").drop("at", "head")


def categorised(found: DataFrame) -> DataFrame:
    return found.withColumn("category", category(F.col("text"), F.col("section")))


def candidates(found: DataFrame, limit: int = 200) -> DataFrame:
    """One line per note and category: distinct mentions by normal form in order of offset, at most `limit` of them."""
    n = normalize(F.col("text"))
    firsts = found.withColumn("n", n).groupBy("note_id", "category", "n").agg(F.min(F.struct("start", "text")).alias("m"))
    return firsts.groupBy("note_id", "category").agg(F.count("*").alias("n_mentions"), F.array_join(F.transform(F.slice(F.array_sort(F.collect_list("m")), 1, limit), lambda m: m["text"]), ", ").alias("line"))


def in_chunks(found: DataFrame, parts: DataFrame, slack: int = 50) -> DataFrame:
    """Mentions of each chunk: those that start in it and end at most `slack` characters after it."""
    c = parts.select(F.col("note_id").alias("c_note"), "chunk_no", F.col("start").alias("c_start"), F.col("stop").alias("c_stop"))
    return found.join(c, (F.col("note_id") == F.col("c_note")) & (F.col("start") >= F.col("c_start")) & (F.col("stop") <= F.col("c_stop") + slack)).select("note_id", "chunk_no", "text", "start", "stop")


def prompts(parts: DataFrame, notes: DataFrame, found: DataFrame) -> DataFrame:
    """The request text of each chunk: first chunks and continuations differ, candidates are listed. Adds the chunk's first mentions."""
    firsts = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("start", "stop", "text"))), 1, PRIOR_MENTIONS), lambda m: m["text"])
    listed = in_chunks(found, parts).groupBy("note_id", "chunk_no").agg(F.array_join(F.array_sort(F.collect_set("text")), ", ").alias("terms"), firsts.alias("mentions"))
    df = parts.join(notes.select("note_id", "text"), "note_id").join(listed, ["note_id", "chunk_no"], "left")
    body = F.substring(F.col("text"), F.col("start") + 1, F.col("stop") - F.col("start"))
    head = F.when(F.col("chunk_no") == 0, "Facts of this note:").otherwise("More facts of the same note:")
    return df.select("note_id", "chunk_no", F.concat_ws("\n", head, body, F.concat(F.lit("Candidates: "), F.coalesce("terms", F.lit("none")))).alias("prompt"), "mentions")


def answers_of(generate: Callable[[list[str]], list[str]], prompts: list[str], attempts: int = ATTEMPTS) -> list[str]:
    """As many answers as prompts. A batch that fails or comes back short is asked again; then its prompts one by one, and a prompt that
    keeps failing has the empty answer."""
    for _ in range(attempts):
        try:
            got = list(generate(prompts))
        except Exception:  # noqa: BLE001 - a generator may fail in any way
            continue
        if len(got) == len(prompts):
            return [a or "" for a in got]
    return [""] if len(prompts) == 1 else [answers_of(generate, [p], attempts)[0] for p in prompts]


def extract(prompted: DataFrame, generate: Callable[[list[str]], list[str]]) -> DataFrame:
    """Facts from a generator of answers, chunk by chunk, batched: note_id, chunk_no, pos and the fact's fields.

    generate takes a batch of prompts and gives as many answers; an answer without readable facts gives no rows. Failures are tried again.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(k, c, i, *(o[f] for f in FIELDS)) for k, c, answer in zip(p["note_id"], p["chunk_no"], answers_of(generate, p["prompt"].tolist()), strict=True) for i, o in enumerate(kernels.salvage(answer))]
            yield pd.DataFrame(rows, columns=["note_id", "chunk_no", "pos", *FIELDS])

    return prompted.select("note_id", "chunk_no", "prompt").mapInPandas(run, FACTS)


def prior_lines(mentions: list[str], facts: list[dict]) -> list[str]:
    """Lines of the facts known so far whose entity or value is one of the mentions."""
    out = []
    for m in mentions[:PRIOR_MENTIONS]:
        near = [f for f in facts if m.lower().strip() in ((f["entity"] or "").lower().strip(), (f["value"] or "").lower().strip())]
        out += [f"Prior: ({f['entity']}, {f['attribute'] or ''}, {f['value'][:40]})" for f in near[:PRIOR_FACTS] if f["entity"] and f["value"]]
    return out[:PRIOR_LINES]


def extract_in_turn(prompted: DataFrame, generate: Callable[[list[str]], list[str]], seeds: tuple[dict, ...] = ()) -> DataFrame:
    """As extract, but the chunks of a note come one after the other and each prompt ends in the prior facts about its mentions:
    those of the note's chunks before it and the seeds (entity, attribute, value), a fixed list that is not given out again.

    One group a note, so the notes run side by side and a group holds no more than a note's prompts.
    """
    def run(p: pd.DataFrame) -> pd.DataFrame:
        known, rows = list(seeds), []
        for k, c, prompt, mentions in p.sort_values("chunk_no")[["note_id", "chunk_no", "prompt", "mentions"]].itertuples(index=False):
            prior = prior_lines([] if mentions is None else list(mentions), known)
            facts = kernels.salvage(answers_of(generate, ["\n".join([prompt, *prior])])[0])
            known += facts
            rows += [(k, c, i, *(o[f] for f in FIELDS)) for i, o in enumerate(facts)]
        return pd.DataFrame(rows, columns=["note_id", "chunk_no", "pos", *FIELDS])

    return prompted.select("note_id", "chunk_no", "prompt", "mentions").groupBy("note_id").applyInPandas(run, FACTS)


def context_mentions(found: DataFrame, parts: DataFrame) -> DataFrame:
    """note_id, chunk_no, place, term: the distinct terms of the first CONTEXT_MENTIONS mentions of each chunk that are long enough."""
    w = Window.partitionBy("note_id", "chunk_no").orderBy("start", "stop", "text")
    firsts = in_chunks(found, parts).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= CONTEXT_MENTIONS)
    return firsts.withColumn("term", F.lower(F.trim("text"))).filter(F.length("term") >= CONTEXT_LENGTH).groupBy("note_id", "chunk_no", "term").agg(F.min("place").alias("place"))


def ontology_context(mentioned: DataFrame, hits: DataFrame) -> DataFrame:
    """note_id, chunk_no, context: a line for every good hit of every term of a chunk, in the order of the terms.

    mentioned: context_mentions. hits: term, title, code, score, place (the best CONTEXT_HITS of a term).
    """
    good = hits.filter((F.col("score") > CONTEXT_SCORE) & (F.col("place") <= CONTEXT_HITS))
    line = F.concat(F.lit('  - "'), "title", F.lit('" ['), "code", F.lit('] (matched: "'), "term", F.lit('")'))
    x = mentioned.join(good.withColumnRenamed("place", "hit"), "term").select("note_id", "chunk_no", F.struct("place", "hit", line.alias("line")).alias("l"))
    lines = F.transform(F.array_sort(F.collect_list("l")), lambda y: y["line"])  # at most CONTEXT_MENTIONS x CONTEXT_HITS
    return x.groupBy("note_id", "chunk_no").agg(F.concat_ws("\n", F.lit("## Concepts of the list:"), F.array_join(lines, "\n")).alias("context"))


class ChunkNote:
    """Table function chunk_note(text, max): the greedily filled paragraphs of one text as rows."""

    def eval(self, text: str, limit: int):
        for i, (a, b) in enumerate(kernels.chunk_paragraphs(text, limit) if text else []):
            yield i, a, b


def register_chunk_note(spark) -> str:
    """Makes chunk_note callable from SQL and gives its name."""
    spark.udtf.register("chunk_note", F.udtf(ChunkNote, returnType="chunk_no int, start int, stop int"))
    return "chunk_note"


def entropy(probabilities: Column) -> Column:
    """Mean of -sum p ln p over an array of arrays of token probabilities."""
    one = F.transform(probabilities, lambda ps: F.aggregate(ps, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.ln(p)).otherwise(0.0)))
    return F.aggregate(one, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(one), F.lit(1))
