"""Column builders over claim fields: personal identifiers, empty talk, types, identifiers, categories, answers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from factgate import vocab
from factgate.functions.text import normalize


def lookup(table: dict[str, object], key: Column) -> Column:
    """Value of a small fixed table, null for other keys."""
    return F.try_element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))]), key)


#: Every space of Unicode (category Zs), as notes hold no-break and thin ones too.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def squeezed(c: Column) -> Column:
    """Blanks squeezed, spaces of any kind cut off at both ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "), F.lit(SPACES))


def tidy(c: Column) -> Column:
    """Lower case, blanks squeezed, null as empty."""
    return squeezed(F.lower(F.coalesce(c, F.lit(""))))


def is_phi(c: Column) -> Column:
    return F.coalesce(c.rlike(vocab.PHI), F.lit(False))


def scrub_phi(c: Column) -> Column:
    return squeezed(F.regexp_replace(F.coalesce(c, F.lit("")), vocab.PHI_MARKS, " REDACTED "))


def is_vacuous(c: Column) -> Column:
    t = tidy(c)
    return t.isin(*vocab.VACUOUS) | (F.length(t) <= 2) | t.rlike("^[0-9]+$")


def type_a(raw: Column, attribute: Column) -> Column:
    """Resource type for cleaning: exact, by word, by a part of the attribute, else Observation."""
    a = tidy(attribute)
    out = F.when(raw.isin(*vocab.ALL_TYPES), raw).when(lookup(vocab.TYPE_WORDS_A, tidy(raw)).isNotNull(), lookup(vocab.TYPE_WORDS_A, tidy(raw)))
    for t, parts in vocab.TYPE_BY_ATTRIBUTE:
        out = out.when(a.rlike(parts), t)
    return out.otherwise("Observation")


def type_b(raw: Column) -> Column:
    """Resource type for extraction: exact, by word, then the first line of the table that contains the word or is contained in it."""
    lines = vocab.TYPE_LINES_B
    key = F.regexp_replace(F.lower(F.trim(raw)), r"[\s_-]", "")
    pairs = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(t).alias("t")) for w, t in lines])
    partial = F.try_element_at(F.filter(pairs, lambda p: F.contains(key, p["w"]) | F.contains(p["w"], key)), F.lit(1))["t"]
    first: dict[str, str] = {}
    for w, t in lines:
        first.setdefault(w, t)
    return F.when(F.coalesce(raw, F.lit("")) == "", "Observation").when(raw.isin(*vocab.CORE_TYPES), raw).otherwise(F.coalesce(lookup(first, key), partial, F.lit("Observation")))


def type_c(raw: Column) -> Column:
    """Resource type for materialisation: by word, a core type in any case, else as it stands."""
    key = F.lower(F.trim(raw))
    core = {t.lower(): t for t in vocab.CORE_TYPES}
    return F.coalesce(lookup(vocab.TYPE_WORDS_C, key), lookup(core, key), raw, F.lit(""))


def safe_uri(c: Column) -> Column:
    """Identifier part: other characters as one underscore, none outside, 100 characters, percent-encoded."""
    s = F.regexp_replace(F.regexp_replace(F.trim(c), r"[^\p{L}\p{N}_-]", "_"), "_+", "_")
    return F.url_encode(F.left(F.regexp_replace(s, "^_+|_+$", ""), F.lit(100)))


def status_of(attribute: Column) -> Column:
    return F.coalesce(lookup(vocab.STATUS_WORDS, tidy(attribute)), F.lit("present"))


def code_of(entity: Column) -> Column:
    """SYSTEM:code of the first known term contained in the entity, null for none."""
    e = F.lower(F.trim(entity))
    cases = [F.when(F.contains(e, F.lit(t)), f"{s}:{c}") for s, terms in vocab.CODES for t, c in terms.items()]
    return F.coalesce(*cases)


def miss_bucket(c: Column) -> Column:
    t = F.trim(c)
    upper = (t == F.upper(t)) & (t != F.lower(t))
    return (
        F.when(F.lower(t).isin(*vocab.MISS_HEADERS) | (upper & (F.length(t) > 5)), "section_header").when(t.rlike(vocab.MISS_UNITS), "lab_fragment")
        .when(t.rlike(vocab.MISS_GENERIC), "anaphora").when(upper & (F.length(t) <= 5), "abbreviation").otherwise("substantive")
    )


def category(text: Column, section: Column) -> Column:
    """TREATMENT, TEST, PROBLEM or OTHER by words, endings and section, in that order."""
    t = F.trim(F.lower(text))

    def any_of(words: tuple[str, ...]) -> Column:
        return t.rlike("|".join(re.escape(w) for w in words))

    return (
        F.when(any_of(vocab.TREATMENT_WORDS) | (section == "MEDICATIONS") | (t.rlike(f"(?:{'|'.join(vocab.DRUG_ENDINGS)})$") & (F.length(t) > 4)), "TREATMENT")
        .when(any_of(vocab.TEST_WORDS) | section.isin("LABS", "IMAGING", "PATHOLOGY"), "TEST")
        .when(any_of(vocab.PROBLEM_WORDS) | section.isin("HPI", "ASSESSMENT", "PMH"), "PROBLEM").otherwise("OTHER")
    )


def negated(value: Column) -> Column:
    """The value with its first polarity word turned round, null when it has none."""
    cases = [F.when(F.contains(F.lower(value), F.lit(a)), F.regexp_replace(value, f"(?i){a}", b)) for a, b in vocab.NEGATIONS]
    return F.coalesce(*cases)


def first_given(*columns: str) -> Column:
    """The first of several fields that is neither null nor blank, null if none is."""
    return F.coalesce(*[F.when(F.trim(F.col(c)) != "", F.col(c)) for c in columns])


def positive_mentions(text: Column, concept: str) -> tuple[Column, Column]:
    """(all, positive) occurrences of a concept: positive ones have no cue in the 55 characters before them."""
    low = F.lower(text)
    parts = F.split(low, re.escape(concept))
    n = F.size(parts) - 1
    # the text before occurrence i is parts 0..i joined by the concept again
    before = F.transform(F.sequence(F.lit(1), n), lambda i: F.right(F.array_join(F.slice(parts, F.lit(1), i), concept), F.lit(55)))
    ok = F.when(n > 0, F.size(F.filter(before, lambda b: ~b.rlike(vocab.NEGATION_CUES)))).otherwise(0)
    return F.when(text.isNull(), 0).otherwise(n), F.when(text.isNull(), 0).otherwise(ok)


def _answer_body(c: Column) -> Column:
    s = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)<think>.*?</think>", "")
    return F.trim(F.element_at(F.split(s, "</think>"), -1))


def choice_answer(c: Column) -> Column:
    """The letter A to D a response settles on; A when it names none."""
    u = F.trim(F.upper(F.regexp_replace(_answer_body(c), r"\*+", "")))

    def last(p: str) -> Column:
        return F.try_element_at(F.regexp_extract_all(u, F.lit(p), 1), F.lit(-1))

    def first(p: str) -> Column:
        return F.nullif(F.regexp_extract(u, p, 1), F.lit(""))

    return F.coalesce(
        last(r"ANSWER\s*:\s*([A-D])\b"), F.when(u.isin("A", "B", "C", "D"), u), first(r"^([A-D])\s*[.):,\s]"),
        first(r"(?:CORRECT|OPTION)\s*(?:IS|:)\s*[:\s]*\(?([A-D])\b"), first(r"\(([A-D])\)"), last(r"\b([A-D])\b"), F.lit("A"),
    )


def verdict_answer(c: Column) -> Column:
    """yes, no or maybe as a response settles on it; maybe when it says none."""
    low = F.lower(_answer_body(c))

    def first(p: str) -> Column:
        return F.nullif(F.regexp_extract(low, p, 1), F.lit(""))

    return F.coalesce(
        first(r"answer\s*:\s*(yes|no|maybe)"), first(r"^(yes|no|maybe)\b"), first(r"(?:decision|verdict|conclusion)\s*(?:is|:)\s*(yes|no|maybe)"),
        F.try_element_at(F.regexp_extract_all(low, F.lit(r"\b(yes|no|maybe)\b"), 1), F.lit(-1)), F.lit("maybe"),
    )


def known_concept(entity: Column, kind: Column) -> Column:
    """1.0 for a known term or token, 0.7 for a core type, else 0.3."""
    n = normalize(F.coalesce(entity, F.lit("")))
    known = F.array(*[F.lit(t) for t in vocab.KNOWN_TERMS])
    return F.when(n.isin(*vocab.KNOWN_TERMS) | F.arrays_overlap(F.split(n, " "), known), 1.0).when(kind.isin(*vocab.CORE_TYPES), 0.7).otherwise(0.3)
