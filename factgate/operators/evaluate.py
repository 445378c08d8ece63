"""Matching of extracted against expected facts, model subsets, misses, corpus reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgate import vocab
from factgate.functions.clinical import lookup, miss_bucket, negated, tidy
from factgate.functions.match import concept_form, form_tokens, grounded, same_concept, scored, shaped
from factgate.functions.text import normalize, tokens
from factgate.tables import broadcast_if_small

LEAST = 0.4
#: Code titles and item labels of at most so many rows are broadcast.
MAX_LISTED = 1_000_000


def claim_texts(claims: DataFrame) -> DataFrame:
    """Distinct note_id, model, text: entity, value, evidence of more than one character, and entity with value."""
    e, v, s = (F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("entity", "value", "evidence"))
    parts = F.filter(F.array(e, v, s, F.trim(F.concat(e, F.lit(" "), v))), lambda x: F.length(x) > 1)
    return claims.select("note_id", "model", F.explode(F.array_distinct(parts)).alias("text")).distinct()


def texts_of_claims(claims: DataFrame) -> DataFrame:
    """claim_id, text of each claim, by the same rule."""
    e, v, s = (F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("entity", "value", "evidence"))
    parts = F.filter(F.array(e, v, s, F.trim(F.concat(e, F.lit(" "), v))), lambda x: F.length(x) > 1)
    return claims.select("claim_id", F.explode(F.array_distinct(parts)).alias("text"))


def match_pairs(found: DataFrame, gold: DataFrame, extra: list[str]) -> DataFrame:
    """Pairs of one note with match_score from LEAST: note_id, *extra, text, gold, score. Exact: inside a note all distinct normal
    forms are compared, as containment also holds between texts without a common token.

    found: note_id, text, extra. gold: note_id, gold. Repeated texts are compared once.
    """
    a = found.select("note_id", *extra, "text", normalize(F.col("text")).alias("a")).filter("a <> ''")
    b = gold.select("note_id", "gold", normalize(F.col("gold")).alias("b")).filter("b <> ''").distinct()
    forms = shaped(a.select("note_id", "a").distinct(), "a").join(shaped(b.select("note_id", "b").distinct(), "b"), "note_id")
    hits = scored(forms, "a", "b", "score").filter(F.col("score") >= LEAST).select("note_id", "a", "b", "score")
    return a.join(hits, ["note_id", "a"]).join(b, ["note_id", "b"]).select("note_id", *extra, "text", "gold", F.round("score", 6).alias("score"))


def blocked_pairs(found: DataFrame, gold: DataFrame) -> DataFrame:
    """As match_pairs, for texts that share a token: the token is part of the join key, so no note is compared with itself whole.
    Loses matches without a common token (character containment, abbreviations)."""
    a = found.select("note_id", normalize(F.col("text")).alias("a")).distinct().withColumn("t", F.explode(tokens(F.col("a"))))
    b = gold.select("note_id", normalize(F.col("gold")).alias("b")).distinct().withColumn("t", F.explode(tokens(F.col("b"))))
    pairs = a.join(b, ["note_id", "t"]).select("note_id", "a", "b").distinct()
    pairs = scored(shaped(shaped(pairs, "a"), "b"), "a", "b", "score").filter(F.col("score") >= LEAST)
    return pairs.select("note_id", "a", "b", F.round("score", 6).alias("score"))


def prf(hits: DataFrame, found: DataFrame, gold: DataFrame) -> DataFrame:
    """Precision, recall and F1 per note and model over distinct texts and distinct gold texts."""
    nf = found.groupBy("note_id", "model").agg(F.countDistinct("text").alias("n_found"))
    ng = gold.groupBy("note_id").agg(F.countDistinct("gold").alias("n_gold"))
    got = hits.groupBy("note_id", "model").agg(F.countDistinct("text").alias("n_right"), F.countDistinct("gold").alias("n_covered"))
    x = nf.join(ng, "note_id").join(got, ["note_id", "model"], "left").fillna(0, ["n_right", "n_covered"])
    p, r = F.col("n_right") / F.greatest("n_found", F.lit(1)), F.col("n_covered") / F.greatest("n_gold", F.lit(1))
    return x.withColumns({"p": p, "r": r}).withColumn("f1", F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0))


def macro(scores: DataFrame, by: str) -> DataFrame:
    """Mean, population deviation and normal 95 % interval of F1, means of precision and recall, by group."""
    half = 1.96 * F.stddev_pop("f1") / F.sqrt(F.count("*"))
    return scores.groupBy(by).agg(F.count("*").alias("k"), F.round(F.avg("p"), 4).alias("mean_p"), F.round(F.avg("r"), 4).alias("mean_r"), F.round(F.avg("f1"), 4).alias("mean_f1"), F.round(F.stddev_pop("f1"), 4).alias("sd_f1"), F.round(F.avg("f1") - half, 4).alias("ci_low"), F.round(F.avg("f1") + half, 4).alias("ci_high"))


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def note_scores(claims: DataFrame, texts: DataFrame, hits: DataFrame, gold: DataFrame, checked: DataFrame) -> DataFrame:
    """One row per note and model, claims counted one by one and gold both by distinct text and by mention.

    claims: claim_id, note_id, model. texts: claim_id, text (of each claim). hits: note_id, text, gold. gold: note_id, gold, n (mentions).
    checked: claim_id, grounded. A claim is right if one of its texts matches a gold text; gold mentions are covered with their text.
    """
    n_gold = gold.groupBy("note_id").agg(F.count("*").alias("n_gold"), F.sum("n").alias("n_mentions"))
    of_claim = texts.join(claims.select("claim_id", "note_id", "model"), "claim_id")
    met = of_claim.join(hits.select("note_id", "text", "gold").distinct(), ["note_id", "text"]).select("note_id", "model", "claim_id", "gold").distinct()
    right = met.groupBy("note_id", "model").agg(F.countDistinct("claim_id").alias("n_right"))
    covered = met.select("note_id", "model", "gold").distinct().join(gold, ["note_id", "gold"]).groupBy("note_id", "model").agg(F.count("*").alias("n_covered"), F.sum("n").alias("n_covered_mentions"))
    base = claims.join(checked.select("claim_id", "grounded"), "claim_id").groupBy("note_id", "model").agg(F.count("*").alias("n_claims"), F.count_if(~F.col("grounded")).alias("n_ungrounded"))
    x = base.join(n_gold, "note_id").join(right, ["note_id", "model"], "left").join(covered, ["note_id", "model"], "left").fillna(0, ["n_right", "n_covered", "n_covered_mentions"])
    p, r, m = F.col("n_right") / F.col("n_claims"), F.col("n_covered") / F.col("n_gold"), F.col("n_covered_mentions") / F.col("n_mentions")
    return x.withColumns({"p": p, "r": r, "f1": _f1(p, r), "mention_r": m, "mention_f1": _f1(p, m), "hallucination": F.col("n_ungrounded") / F.col("n_claims")})


def model_totals(scores: DataFrame) -> DataFrame:
    """Means and sums of note_scores by model."""
    means = [F.round(F.avg(c), 4).alias(f"mean_{c}") for c in ("p", "r", "f1", "mention_r", "mention_f1", "hallucination")]
    return scores.groupBy("model").agg(F.count("*").alias("n_notes"), *means, *(F.sum(c).alias(c) for c in ("n_claims", "n_gold", "n_mentions", "n_right", "n_ungrounded")))


def claims_in_note(texts: DataFrame, claims: DataFrame, notes: DataFrame) -> DataFrame:
    """claim_id, grounded: whether one of a claim's texts lies in its note, or most of its words do. Distinct texts of a note are looked up once.

    texts: claim_id, text. notes: note_id, text.
    """
    plain = notes.select("note_id", normalize(F.coalesce("text", F.lit(""))).alias("note")).withColumn("words", tokens(F.col("note")))
    of_claim = texts.join(claims.select("claim_id", "note_id"), "claim_id").withColumn("n", normalize(F.col("text")))
    once = of_claim.select("note_id", "n").distinct().join(plain, "note_id").select("note_id", "n", grounded(F.col("n"), F.col("note"), F.col("words")).alias("g"))
    found = of_claim.join(once.filter("g"), ["note_id", "n"], "left_semi").select("claim_id").distinct().withColumn("grounded", F.lit(True))
    return claims.select("claim_id").join(found, "claim_id", "left").select("claim_id", F.coalesce("grounded", F.lit(False)).alias("grounded"))


def subset_scores(claims: DataFrame, texts: DataFrame, hits: DataFrame, gold: DataFrame, models: list[str]) -> DataFrame:
    """Every non-empty subset of models over all notes with gold: mask, n_models, mean p, r, f1 and claims a note, place (by f1, then r).

    claims: claim_id, note_id, model, key (the canonical claim; equal keys of a note are one claim). The models that hold a claim and
    those that cover a gold text become bit masks, counted before they meet the subsets.
    """
    bit = F.coalesce(*[F.when(F.col("model") == m, F.lit(1 << i)) for i, m in enumerate(models)], F.lit(0))
    held = claims.groupBy("note_id", "key").agg(F.bit_or(bit).alias("m"), F.min("claim_id").alias("claim_id"))
    met = texts.join(claims.select("claim_id", "note_id", "key"), "claim_id").join(hits.select("note_id", "text", "gold").distinct(), ["note_id", "text"]).select("note_id", "key", "gold").distinct()
    right = met.select("note_id", "key").distinct().withColumn("right", F.lit(True))
    all_masks = F.sequence(F.lit(1), F.lit((1 << len(models)) - 1))

    def spread(df: DataFrame) -> DataFrame:
        return df.withColumn("mask", F.explode(F.filter(all_masks, lambda s: s.bitwiseAND(F.col("m")) > 0)))

    n = held.join(right, ["note_id", "key"], "left").groupBy("note_id", "m").agg(F.count("*").alias("n"), F.count_if(F.col("right").isNotNull()).alias("tp"))
    n = spread(n).groupBy("note_id", "mask").agg(F.sum("n").alias("n"), F.sum("tp").alias("tp"))
    cover = met.join(held.select("note_id", "key", "m"), ["note_id", "key"]).groupBy("note_id", "gold").agg(F.bit_or("m").alias("m")).groupBy("note_id", "m").agg(F.count("*").alias("c"))
    cover = spread(cover).groupBy("note_id", "mask").agg(F.sum("c").alias("c"))
    base = gold.groupBy("note_id").agg(F.count("*").alias("g")).withColumn("mask", F.explode(all_masks))
    x = base.join(n, ["note_id", "mask"], "left").join(cover, ["note_id", "mask"], "left").fillna(0, ["n", "tp", "c"])
    p, r = F.col("tp") / F.greatest("n", F.lit(1)), F.col("c") / F.greatest("g", F.lit(1))
    out = x.withColumns({"p": p, "r": r}).withColumn("f1", _f1(F.col("p"), F.col("r"))).groupBy("mask").agg(*(F.round(F.avg(c), 4).alias(f"mean_{c}") for c in ("p", "r", "f1")), F.round(F.avg("n"), 1).alias("mean_claims"))
    out = out.withColumn("n_models", F.bit_count("mask").cast("int"))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean_f1"), F.desc("mean_r"), "mask")))  # 2^n - 1 rows


def misses(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """Gold texts of a note that no text matches, with their bucket."""
    return gold.select("note_id", "gold").distinct().join(hits.select("note_id", "gold").distinct(), ["note_id", "gold"], "left_anti").withColumn("bucket", miss_bucket(F.col("gold")))


def by_label(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """Gold texts, covered ones and recall by gold label. gold: note_id, gold, label."""
    got = hits.select("note_id", "gold").distinct().withColumn("hit", F.lit(True))
    g = gold.join(got, ["note_id", "gold"], "left").groupBy("label").agg(F.count("*").alias("n_gold"), F.count_if(F.col("hit").isNotNull()).alias("n_matched"))
    return g.withColumn("recall", F.round(F.col("n_matched") / F.greatest("n_gold", F.lit(1)), 3))


def recurring(missed: DataFrame, k: int = 50) -> DataFrame:
    """The k most frequent substantive misses (lower case, blanks squeezed) of two notes or more."""
    sub = missed.filter("bucket = 'substantive'")
    return sub.groupBy(tidy(F.col("gold")).alias("gold")).agg(F.countDistinct("note_id").alias("n_notes")).filter("n_notes >= 2").orderBy(F.desc("n_notes"), "gold").limit(k)


def samples(hits: DataFrame, gold: DataFrame, ungrounded: DataFrame, k: int = 6, k_ungrounded: int = 4) -> DataFrame:
    """Bounded samples per note and model: the first k matched and missed gold texts, the first texts of ungrounded claims.

    hits: note_id, model, gold. gold: note_id, gold. ungrounded: note_id, model, text. Only the k smallest texts of a group leave a task.
    """
    pairs = hits.select("note_id", "model").distinct().join(gold.select("note_id", "gold").distinct(), "note_id")
    matched = hits.select("note_id", "model", "gold").distinct()
    missed = pairs.join(matched, ["note_id", "model", "gold"], "left_anti")
    kinds = (("matched", matched.withColumnRenamed("gold", "text"), k), ("missed", missed.withColumnRenamed("gold", "text"), k), ("ungrounded", ungrounded.select("note_id", "model", F.left("text", F.lit(60)).alias("text")).distinct(), k_ungrounded))
    out = None
    for kind, df, most in kinds:
        w = Window.partitionBy("note_id", "model").orderBy("text")
        top = df.select("note_id", "model", "text").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).withColumn("kind", F.lit(kind))
        out = top if out is None else out.unionByName(top)
    return out.select("note_id", "model", "kind", "place", "text")


def chart_concepts(diagnoses: DataFrame, prescriptions: DataFrame, labs: DataFrame, codes: DataFrame, items: DataFrame, k_drugs: int = 20, k_labs: int = 20, head_labs: int = 50) -> DataFrame:
    """What a chart says of an admission: hadm_id, category, concept. The feature is bounded per admission, as stated by its parameters.

    Diagnoses by the title of their code; the first k_drugs prescriptions in order of row_id, of more than two characters; of the first
    head_labs lab rows in order of row_id the first k_labs distinct labels. Rows without an admission or a name say nothing.
    """
    dx = diagnoses.filter("hadm_id is not null").join(broadcast_if_small(codes.filter("coalesce(long_title, '') <> ''"), MAX_LISTED), "icd9_code").select("hadm_id", F.lit("diagnosis").alias("category"), F.lower("long_title").alias("concept"))
    w = Window.partitionBy("hadm_id").orderBy("row_id")
    rx = prescriptions.filter("hadm_id is not null").select("hadm_id", "row_id", F.lower(F.trim("drug")).alias("concept")).withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= k_drugs)
    rx = rx.filter("length(concept) > 2").select("hadm_id", F.lit("medication").alias("category"), "concept")
    head = labs.filter("hadm_id is not null").select("hadm_id", "row_id", "itemid").withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= head_labs)
    named = head.join(broadcast_if_small(items.filter("coalesce(label, '') <> ''"), MAX_LISTED), "itemid").groupBy("hadm_id", "label").agg(F.min("row_id").alias("row_id"))
    named = named.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= k_labs).select("hadm_id", F.lit("lab").alias("category"), F.lower("label").alias("concept"))
    return dx.unionByName(rx).unionByName(named).distinct()


def _matched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, x of the left side that match a text of the right side of the same key by same_concept. left: key, x. right: key, y.

    A shared token is needed unless one form lies in the other, so texts meet by token, and by containment only where no token met.
    """
    def shaped_(df: DataFrame, c: str) -> DataFrame:
        f = df.select(key, c, concept_form(F.col(c)).alias(f"f_{c}")).filter(F.col(f"f_{c}") != "")
        return f.withColumn(f"t_{c}", form_tokens(F.col(f"f_{c}")))

    a, b = shaped_(left.distinct(), "x"), shaped_(right.distinct(), "y")
    ok = same_concept(F.col("f_x"), F.col("f_y"), F.col("t_x"), F.col("t_y"))
    by_token = a.withColumn("tok", F.explode("t_x")).join(b.withColumn("tok", F.explode("t_y")), [key, "tok"]).filter(ok).select(key, "x").distinct()
    rest = a.join(by_token, [key, "x"], "left_anti")
    inside = rest.join(b.select(key, "f_y", "t_y"), key).filter(ok).select(key, "x").distinct()
    return by_token.unionByName(inside)


def chart_scores(found: DataFrame, facts: DataFrame) -> DataFrame:
    """Claims of an admission's notes against its chart: hadm_id, n_found, n_facts, n_matched, precision, recall, f1, hallucination.

    found: hadm_id, text (lower case, more than two characters), seen (whether a note of the admission says it). facts: hadm_id, category,
    concept. A text is right if it matches any fact, a fact is covered if any text matches it.
    """
    once = found.groupBy("hadm_id", "text").agg(F.bool_or("seen").alias("seen"))
    texts, gold = once.select("hadm_id", F.col("text").alias("x")), facts.select("hadm_id", F.col("concept").alias("y")).distinct()
    right = _matched(texts, gold, "hadm_id").groupBy("hadm_id").agg(F.count("*").alias("n_right"))
    covered = _matched(gold.withColumnRenamed("y", "x"), texts.withColumnRenamed("x", "y"), "hadm_id").withColumnRenamed("x", "concept")
    covered = facts.join(covered, ["hadm_id", "concept"], "left_semi").groupBy("hadm_id").agg(F.count("*").alias("n_matched"))
    said = once.groupBy("hadm_id").agg(F.count("*").alias("n_found"), F.count_if(~F.col("seen")).alias("n_hallucinated"))
    n = facts.groupBy("hadm_id").agg(F.count("*").alias("n_facts"))
    x = said.join(n, "hadm_id").join(right, "hadm_id", "left").join(covered, "hadm_id", "left").fillna(0, ["n_right", "n_matched"])
    p, r = F.col("n_right") / F.col("n_found"), F.col("n_matched") / F.col("n_facts")
    return x.select("hadm_id", "n_found", "n_facts", "n_matched", *(F.round(c, 3).alias(k) for k, c in (("precision", p), ("recall", r), ("f1", _f1(p, r)), ("hallucination", F.col("n_hallucinated") / F.col("n_found")))))


def said_in_notes(claims: DataFrame, notes: DataFrame) -> DataFrame:
    """hadm_id, text, seen of the entities and values (lower case, more than two characters) of claims. notes: note_id, hadm_id, text.

    seen: the text, or one of its first two words if longer than three characters, stands in the claim's note.
    """
    low = F.array(*[F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))) for c in ("entity", "value")])
    once = claims.select("note_id", F.explode(F.array_distinct(low)).alias("text")).filter("length(text) > 2").distinct()
    x = once.join(notes.filter("hadm_id is not null").select("note_id", "hadm_id", F.lower(F.coalesce("text", F.lit(""))).alias("note")), "note_id")
    words = F.filter(F.slice(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "), 1, 2), lambda w: F.length(w) > 3)
    return x.select("hadm_id", "text", (F.contains("note", "text") | F.exists(words, lambda w: F.contains(F.col("note"), w))).alias("seen"))


def perturbed(claims: DataFrame, n: int = 3) -> DataFrame:
    """Up to n false variants of each claim, numbered nth: its value negated, its first number scaled, its type swapped, in this order.

    The factor, 2 to 10, is derived from claim_id, so runs agree. Adds nth and how; value and kind are those of the variant.
    """
    v = F.coalesce("value", F.lit(""))
    num = F.regexp_extract(v, r"\d+\.?\d*", 0)
    scaled = F.round(F.regexp_replace(num, r"\.$", "").cast("double") * (2 + F.pmod(F.col("claim_id"), F.lit(9))), 1)
    at = F.position(num, v)
    rest = F.concat(F.substring(v, F.lit(1), at - 1), scaled.cast("string"), F.substring(v, at + F.length(num), F.length(v)))
    swap = lookup(vocab.TYPE_SWAPS, F.coalesce("kind", F.lit("")))

    def one(how: str, value: Column, kind: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(how).alias("how"), value.alias("value"), kind.alias("kind")))

    turned = negated(v)
    variants = F.array_compact(F.array(one("negated", turned, F.col("kind"), turned.isNotNull()), one("scaled", rest, F.col("kind"), num != ""), one("swapped", v, swap, swap.isNotNull())))
    keep = [c for c in claims.columns if c not in ("value", "kind")]
    return claims.select(*keep, F.posexplode(F.slice(variants, 1, n)).alias("nth", "x")).select(*keep, (F.col("nth") + 1).alias("nth"), "x.*")


def in_note(claims: DataFrame, notes: DataFrame, least: int) -> DataFrame:
    """Adds verbatim: whether evidence (else value), blanks squeezed and in lower case, of at least `least` characters lies in the note; null if shorter."""
    n = notes.select(F.col("note_id").alias("n_note"), tidy(F.col("text")).alias("note"))
    ev = tidy(F.when(F.coalesce("evidence", F.lit("")) != "", F.col("evidence")).otherwise(F.col("value")))
    df = claims.withColumn("ev", ev).join(n, F.col("note_id") == F.col("n_note"), "left")
    return df.withColumn("verbatim", F.when(F.length("ev") >= least, F.contains(F.coalesce("note", F.lit("")), F.col("ev")))).drop("ev", "n_note", "note")


def model_quality(checked: DataFrame, notes: DataFrame) -> DataFrame:
    """Per model: notes, notes without any of its claims, claims, claims a note, share of checkable claims verbatim in their note, distinct entity heads (30 characters)."""
    every = notes.filter("note_id is not null").agg(F.countDistinct("note_id")).scalar()
    return checked.groupBy("model").agg(F.countDistinct("note_id").alias("n_notes"), (every - F.countDistinct("note_id")).alias("n_empty"), F.count("*").alias("n_claims"), F.round(F.count("*") / F.greatest(F.countDistinct("note_id"), F.lit(1)), 4).alias("per_note"), F.round(F.avg(F.col("verbatim").cast("int")), 4).alias("grounded"), F.countDistinct(F.left(tidy(F.col("entity")), F.lit(30))).alias("n_heads"))


def failures(checked: DataFrame) -> DataFrame:
    """Overlapping kinds of failure: count, share and up to three examples (smallest ids)."""
    e, v = tidy(F.col("entity")), tidy(F.col("value"))
    kinds = (
        ("degenerate", (e == v) & (e != "")), ("phi", F.lower(F.concat(F.coalesce("entity", F.lit("")), F.coalesce("value", F.lit("")))).rlike(r"\[|\*\*\*\*\*|known (lastname|firstname)")),
        ("bad type", (tidy(F.col("kind")) != "") & ~tidy(F.col("kind")).isin(*[x.lower() for x in vocab.ALL_TYPES], "deviceusestatement")),
        ("vacuous", e.isin(*vocab.SURVEY_GENERIC) | (F.length(e) <= 3)), ("ungrounded", ~F.coalesce("verbatim", F.lit(True))),
    )
    tagged = checked.select("claim_id", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in kinds]))).alias("failure"))
    # three least ids a failure: a task keeps three of each before the shuffle, so no list grows with the data
    first = Window.partitionBy("failure").orderBy("claim_id")
    least = tagged.withColumn("place", F.row_number().over(first)).filter("place <= 3").groupBy("failure").agg(F.array_sort(F.collect_list("claim_id")).alias("examples"))
    total = checked.agg(F.count("*")).scalar()
    n = tagged.groupBy("failure").agg(F.count("*").alias("n"))
    return n.join(least, "failure").withColumn("share", F.round(F.col("n") / F.greatest(total, F.lit(1)), 4))
