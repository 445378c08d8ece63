"""Column builders that compare two short texts, without Python in the data path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgate.functions.clinical import lookup
from factgate.functions.text import normalize, tokens
from factgate.vocab import ABBREVIATIONS, CONCEPT_STOP_WORDS

_EXPANDED = {k: v for k, v in ABBREVIATIONS.items()}
_SHORT = {v: k for k, v in ABBREVIATIONS.items()}


def forms(n: Column) -> Column:
    """A normal form with its expansion and its abbreviation, where there is one."""
    return F.array_compact(F.array(n, lookup(_EXPANDED, n), lookup(_SHORT, n)))


def overlap(a: Column, b: Column) -> tuple[Column, Column]:
    """(Jaccard, share of b found in a) of two arrays of distinct tokens; 0 for empty ones."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1.0)), both / F.greatest(F.size(b), F.lit(1))


def _score(a: Column, b: Column, fa: Column, fb: Column, na: Column, nb: Column, both: Column) -> Column:
    jaccard, inside = both / F.greatest(na + nb - both, F.lit(1)), both / F.greatest(nb, F.lit(1))
    # texts without another form were compared by containment already
    short = ((F.size(fa) > 1) | (F.size(fb) > 1)) & F.exists(fa, lambda x: F.exists(fb, lambda y: F.contains(x, y) | F.contains(y, x)))
    return (
        F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(F.contains(a, b) | F.contains(b, a), 0.9).when(short, 0.85)
        .when(jaccard >= 0.5, jaccard).when(inside >= 0.6, inside * 0.8).otherwise(0.0)
    )


def match_score(a: Column, b: Column) -> Column:
    """1 equal; 0.9 one contains the other; 0.85 by abbreviation; Jaccard from 0.5; share of b's tokens from 0.6, times 0.8; else 0."""
    return score_normal(normalize(F.coalesce(a, F.lit(""))), normalize(F.coalesce(b, F.lit(""))))


def score_normal(a: Column, b: Column) -> Column:
    """match_score of texts already in normal form. For many pairs, shape each side once and use `scored`."""
    ta, tb = tokens(a), tokens(b)
    return _score(a, b, forms(a), forms(b), F.size(ta), F.size(tb), F.size(F.array_intersect(ta, tb)))


def shaped(df: DataFrame, column: str) -> DataFrame:
    """Adds what a comparison needs of a normal form: <column>_f (forms) and <column>_t (tokens), once per text, not per pair."""
    return df.withColumns({f"{column}_f": forms(F.col(column)), f"{column}_t": tokens(F.col(column))})


def scored(pairs: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Adds match_score of two shaped columns of a pair; their common tokens are counted once."""
    pairs = pairs.withColumn("__both", F.size(F.array_intersect(F.col(f"{a}_t"), F.col(f"{b}_t"))))
    score = _score(F.col(a), F.col(b), F.col(f"{a}_f"), F.col(f"{b}_f"), F.size(f"{a}_t"), F.size(f"{b}_t"), F.col("__both"))
    return pairs.withColumn(out, score).drop("__both")


def grounded(n: Column, note: Column, note_tokens: Column) -> Column:
    """Whether a normal form lies in the note's, or at least 60 % of its tokens do. Nothing is grounded in no note."""
    mine = tokens(n)
    share = F.size(F.array_intersect(mine, note_tokens)) / F.greatest(F.size(mine), F.lit(1))
    return F.coalesce((n != "") & (F.contains(note, n) | (share >= 0.6)), F.lit(False))


def concept_form(c: Column) -> Column:
    """The normal form without words that say nothing and without single characters."""
    kept = F.filter(F.split(normalize(F.coalesce(c, F.lit(""))), " "), lambda w: (F.length(w) > 1) & ~w.isin(*CONCEPT_STOP_WORDS))
    return F.array_join(kept, " ")


def same_concept(x: Column, y: Column, tx: Column, ty: Column) -> Column:
    """Whether two concept forms with their distinct tokens match: equal; one of at least four characters lies in the other; or more than
    30 % of all their tokens are shared. An empty form matches nothing."""
    shorter = F.least(F.length(x), F.length(y))
    inside = (shorter >= 4) & F.when(F.length(x) <= F.length(y), F.contains(y, x)).otherwise(F.contains(x, y))
    return (x != "") & (y != "") & ((x == y) | inside | (overlap(tx, ty)[0] > 0.3))


def concept_match(a: Column, b: Column) -> Column:
    """same_concept of two texts."""
    x, y = concept_form(a), concept_form(b)
    return same_concept(x, y, form_tokens(x), form_tokens(y))


def form_tokens(form: Column) -> Column:
    return F.when(form == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(form, " ")))
