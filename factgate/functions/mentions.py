"""Python kernels for what built-in functions cannot express: all matches with offsets, and salvage of broken JSON."""

from __future__ import annotations

import json
import re

import numpy as np

from factgate import vocab
from factgate.functions.dates import MONTHS

_FULL = "|".join(m.capitalize() for m in MONTHS)
_ABBR = "|".join(m[:3].capitalize() for m in MONTHS)
_NUMBER = {m[:3]: i + 1 for i, m in enumerate(MONTHS)}
#: Absolute dates: pattern and how its groups name year, month and day.
_ABSOLUTE = (
    (re.compile(r"\b(?P<m>\d{1,2})/(?P<d>\d{1,2})/(?P<y>\d{2,4})\b"), "ymd"),
    (re.compile(r"\b(?P<y>\d{4})-(?P<m>\d{1,2})-(?P<d>\d{1,2})\b"), "ymd"),
    (re.compile(rf"\b(?P<m>{_FULL})\s+(?P<d>\d{{1,2}}),?\s+(?P<y>\d{{4}})\b", re.I), "ymd"),
    (re.compile(rf"\b(?P<m>{_FULL})\s+(?P<y>\d{{4}})\b", re.I), "ym"),
    (re.compile(rf"\b(?P<m>{_ABBR})\w*\s+(?P<d>\d{{1,2}}),?\s*(?P<y>\d{{4}})?\b", re.I), "ymd"),
)
# Relative expressions and their names.
_RELATIVE = tuple(
    (re.compile(p, re.I), n)
    for p, n in (
        (r"\b(\d+)\s+(days?|weeks?|months?|years?)\s+(ago|prior|before|earlier)\b", "relative_past"),
        (r"\bafter\s+(\d+)\s+(cycles?|doses?|weeks?|months?)\b", "relative_post"),
        (r"\b(at diagnosis|at presentation|initially|on admission)\b", "event_anchor"),
        (r"\b(pre-?operative|pre-?treatment|pre-?chemo)\b", "pre_intervention"),
        (r"\b(post-?operative|post-?treatment|post-?chemo|post-?surgery)\b", "post_intervention"),
        (r"\b(currently|now|today|at this time|at present)\b", "current"),
        (r"\b(history of|prior|previous|formerly)\b", "historical"),
    )
)


def _form(m: re.Match, shape: str) -> str:
    """year-month[-day] without checking the calendar; two-digit years pivot at 50, a missing year is ????."""
    g = m.groupdict()
    month = int(g["m"]) if g["m"].isdigit() else _NUMBER[g["m"][:3].lower()]
    if g["y"] is None:
        year = "????"
    else:
        y = int(g["y"])
        year = f"{y + (2000 if y < 50 else 1900) if y < 100 else y:04d}"
    return f"{year}-{month:02d}" + (f"-{int(g['d']):02d}" if shape == "ymd" else "")


def date_mentions(text: str) -> list[tuple[str, str, int, int, str]]:
    """(raw, normalised, start, end, type) of every match of every pattern, by start; overlapping matches all stay."""
    out = [(m.group(), _form(m, shape), m.start(), m.end(), "absolute") for p, shape in _ABSOLUTE for m in p.finditer(text)]
    out += [(m.group(), m.group(), m.start(), m.end(), n) for p, n in _RELATIVE for m in p.finditer(text)]
    return sorted(out, key=lambda x: x[2])


def date_form(text: str | None) -> str | None:
    """Normal form of the first absolute pattern that matches anywhere in a date string."""
    for p, shape in _ABSOLUTE:
        if text and (m := p.search(text)):
            return _form(m, shape)
    return None


def lower_in_place(text: str) -> str:
    """Lower case in which every character keeps its offset: one whose lower case is longer stays as it is."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


_SECTION = tuple((n, re.compile(p, re.I)) for n, p in vocab.SECTIONS)


def section_starts(text: str) -> list[tuple[int, str]]:
    """(offset, section) of every header word, by offset; at one offset the earlier line of the table first."""
    return sorted(((m.start(), n) for n, p in _SECTION for m in p.finditer(text)), key=lambda x: x[0])


def chunk_paragraphs(text: str, limit: int) -> list[tuple[int, int]]:
    """Spans of whole lines filled up to `limit` characters; a longer line is a chunk of its own."""
    out, start, at = [], 0, 0
    for line in text.split("\n"):
        end = at + len(line) + 1
        if at > start and end - 1 - start > limit:
            out.append((start, at - 1))
            start = at
        at = end
    out.append((start, len(text)))
    return [(a, b) for a, b in out if text[a:b].strip()]


_FIELDS = ("entity", "attribute", "value", "fhir_type", "temporal_anchor", "evidence_span")


def salvage(raw: str | None) -> list[dict[str, str | None]]:
    """Fact objects in a model's output: fenced, wrapped, truncated or mixed with prose. Without any '[' or wrapper there are none."""
    if not raw:
        return []
    s = re.sub(r"(?s)<think>.*?</think>", "", raw)
    s = s.rsplit("</think>", 1)[-1]
    if m := re.search(r"(?s)```(?:json)?\s*(.*?)(?:```|$)", s):
        s = m[1]
    s = s.strip()
    got = _loads(s)
    if isinstance(got, dict):
        got = next((got[k] for k in ("triples", "data", "results") if isinstance(got.get(k), list)), None)
    a = s.find("[")
    if not isinstance(got, list):
        if a < 0:
            return []
        b = s.rfind("]")
        got = _loads(s[a : b + 1]) if b > a else None
    if not isinstance(got, list):
        cut = s.rfind("}")
        got = _loads(s[a : cut + 1] + "]") if cut > a else None
    if not isinstance(got, list):
        got = [o for m in re.finditer(r"\{[^{}]*\}", s[a:]) if isinstance(o := _loads(m[0]), dict)]
    return [{f: None if o.get(f) is None else str(o[f]) for f in _FIELDS} for o in got if isinstance(o, dict)]


def _loads(s: str):
    try:
        return json.loads(s)
    except ValueError:
        return None


def near_window(evidence: str, low: str, width: int = 50, share: float = 0.6) -> int:
    """Offset of the first window of `width` characters that holds the share of the words of the evidence's first 30 characters,
    -1 for none; windows begin before the last 30 characters. low: the text in lower case.

    Every word marks the starts of the windows it lies in, so a text costs a pass a word and not a comparison a window.
    """
    words, stop = evidence[:30].lower().split(), len(low) - 30
    need = len(words) * share
    if not words or stop <= 0 or sum(w in low for w in words) < need:
        return -1
    held = np.zeros(stop, dtype=np.int32)
    for w in words:
        own = np.zeros(stop, dtype=bool)
        at = low.find(w)
        while at >= 0:
            own[max(at + len(w) - width, 0) : at + 1] = True
            at = low.find(w, at + 1)
        held += own
    first = int(np.argmax(held >= need))
    return first if held[first] >= need else -1
