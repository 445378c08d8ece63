"""Hand-worked cases, brute force and round trips for the training-text operators."""

import random
from itertools import product

import numpy as np
import pytest

from factgate.llm import canonical, chunking, duplicates, mixture, packing, repetition, splits, tokens
from pyspark.sql import functions as F

# ---------------------------------------------------------------- chunking
LIMITS = [("t", 40, 8)]


def brute_boundary(text, limit):
    import re

    for name, parts in (
        ("blank_line", re.split(r"\n[^\S\n]*(?:\n[^\S\n]*)*\n", text)), ("line", text.split("\n")),
        ("sentence", re.split(r"\n|(?<=[.!?])\s+", text)), ("space", text.split()),
    ):
        if all(len(p.strip()) <= limit for p in parts):
            return name
    return "none"


def random_text(rng, n):
    return "".join(rng.choice(["word ", "a", ". ", "! ", "\n", "\n\n", "\n \n", "\r\n", " ", "HEAD:\n", "longerword"]) for _ in range(n))


def test_pieces_tile_share_overlap_and_respect_the_limit():
    rng = random.Random(1)
    for n in (5, 20, 60, 200):
        for _ in range(30):
            text = random_text(rng, n)
            got = chunking.pieces(text, 40, 8)
            if len(text) <= 40:
                assert got == [(0, len(text), "whole")]
                continue
            assert chunking.coarsest(text, 40) == brute_boundary(text, 40)
            assert all(b - a <= 40 for a, b, _ in got)
            assert got[0][0] == 0 and got[-1][1] == len(text)
            assert all(nxt[0] == max(0, cur[1] - 8) for cur, nxt in zip(got, got[1:]))
            rest = "".join(text[a + (8 if i else 0) if i and a > 0 else a : b] for i, (a, b, _) in enumerate(got) if True)
            ends = [0, *(b for _, b, _ in got)]
            assert "".join(text[x:y] for x, y in zip(ends, ends[1:])) == text and rest


def test_heading_stays_with_its_paragraph():
    text = "a" * 25 + "\n\nFINDINGS:\nshort text of it here\n\n" + "b" * 30
    got = chunking.pieces(text, 40, 0)
    assert any(text[a:b].lstrip().startswith("FINDINGS:\nshort") for a, b, _ in got)


def test_only_siblings_are_merged():
    text = "# A\n\n" + " ".join(f"Sentence {i} of the first part." for i in range(9)) + "\n\n# B\n\nShort end."
    got = [text[a:b] for a, b, _ in chunking.pieces(text, 200, 0)]
    assert got[-1].startswith("# B") and "".join(got) == text and len(got) == 3


def test_heading_depth_and_nested_lists_are_kept_together():
    text = "# One\n\nbody one\n\n## Sub\n\nbody two\n\n# Two\n\n" + "- item a\n  - a1\n  - a2\n- item b\n  - b1\n  - b2\n" * 2
    got = [text[a:b] for a, b, _ in chunking.pieces(text, 60, 0)]
    assert got[0].startswith("# One") and "## Sub" in got[0] and got[1].startswith("# Two")
    assert all(p.startswith(("# ", "- item")) for p in got) and "".join(got) == text
    assert [chunking.heading_depth(x) for x in ("## Plan", "1.2 Findings", "FINDINGS", "Plan:", "a sentence.", "")] == [2, 7, 30, 30, 0, 0]


def test_split_texts_edge_cases(spark):
    rows = [("t", "1", None), ("t", "2", ""), ("t", "3", "x" * 100), ("t", "4", "ok"), ("u", "5", "y" * 99), ("t", "3", "x" * 100)]
    items = spark.createDataFrame([(*r, 7) for r in rows], "item_table string, item_key string, text string, piece int")
    got = chunking.split_texts(items, spark.createDataFrame(LIMITS, "item_table string, max_chars int, overlap_chars int")).collect()
    assert {r.item_key for r in got} == {"3"} and {r.boundary for r in got} == {"none"}
    assert all(len(r.piece) <= 40 for r in got)
    assert chunking.split_texts(items.limit(0), spark.createDataFrame(LIMITS, "item_table string, max_chars int, overlap_chars int")).count() == 0
    with pytest.raises(ValueError):
        chunking.pieces("x" * 50, 8, 8)


# ---------------------------------------------------------------- canonical
CANON = [(1, "drug", "Suloraspramil", None), (2, "drug", "Sulomazolac", "Yarrurexrile"), (3, "condition", "recurrent biliary fistula", "REBF"), (4, "condition", "acute biliary fistula", None), (5, "condition", "drug-induced renal stricture", "DRIRS")]
VALUES = {
    "SULORASPRAMIL*NF*": 1, "Sulorasprmail 50 mg": 1, "inj suloraspramil 100 mg/ml": 1, "Su1oraspramyl": 1, "Suloraspra.": 1, "yarrurexryle (PO)": 2,
    "fistula, biliary, recurrent": 3, "hx of recurrent biliairy fistula": 3, "acute  biliary\tfistula - unspecified": 4, "R.E.B.F.": 3, "rebf?": 3,
    "REBFX": 0, "REB": 0, "D.R.I.R.S.": 5, "gummostehe wash": 0, "50 mg": 0, "???": 0, "": 0, " ": 0, "status": 0,
}


def test_values_map_to_their_entry(spark):
    canon = spark.createDataFrame(CANON, "ref_id bigint, item_kind string, canon_name string, alt_name string")
    rows = spark.createDataFrame([(i, v, "s") for i, v in enumerate([*VALUES, None])], "row_id bigint, value string, score_text string")
    got = {r.value: r.ref_id for r in canonical.map_to_canonical(rows, canon).collect()}
    assert got == VALUES | {None: 0}
    assert {r.ref_id for r in canonical.map_to_canonical(rows, canon.limit(0)).collect()} == {0}
    assert canonical.map_to_canonical(rows.limit(0), canon).count() == 0


def _canon(spark, rows):
    return spark.createDataFrame(rows, "ref_id bigint, item_kind string, canon_name string, alt_name string")


def test_prefix_filter_loses_no_pair(spark):
    rng = random.Random(3)
    names = [(i + 1, "".join(rng.choice("abcdef") for _ in range(rng.randint(4, 12)))) for i in range(60)]
    texts = set()
    for _ in range(200):
        v = list(rng.choice(names)[1])
        for _ in range(rng.randint(0, 3)):
            v[rng.randrange(len(v))] = rng.choice("abcdefg")
        texts.add("".join(v))
    entries = spark.createDataFrame(names, "ref bigint, text string")
    items = spark.createDataFrame(list(enumerate(sorted(texts))), "key bigint, text string")
    ranks = canonical._ranks(items, entries)
    got = {(r.text, r.ref): round(r.jaccard, 9) for r in canonical.similar(items, canonical._posted(entries, ranks), ranks).collect()}

    def cut(t):
        return {t[i : i + 2] for i in range(len(t) - 1)}

    want = {(t, i): round(len(cut(t) & cut(n)) / len(cut(t) | cut(n)), 9) for t in texts for i, n in names}
    assert got == {k: j for k, j in want.items() if j >= canonical.LEAST - 1e-9}


def test_an_exact_name_wins_and_no_word_is_dropped(spark):
    canon = _canon(spark, [(3, "drug", "sodium chloride", None), (4, "drug", "potassium chloride", None), (5, "drug", "chloride", None), (6, "condition", "left possible calcium", None)])
    rows = spark.createDataFrame([(v,) for v in ("sodium chloride", "potassium chloride", "chloride", "Potasium chloride 5 mg", "possible left calcium", None)], "value string")
    got = {r.value: r.ref_id for r in canonical.map_to_canonical(rows, canon).collect()}
    assert got == {"sodium chloride": 3, "potassium chloride": 4, "chloride": 5, "Potasium chloride 5 mg": 4, "possible left calcium": 6, None: 0}


def test_shuffled_paths_agree_with_broadcasts(spark, monkeypatch):
    canon = _canon(spark, CANON)
    values = [v for v in VALUES] + ["hot value"] * 30 + ["rebf?"] * 30
    rows = spark.createDataFrame([(v, "x", 1) for v in values], "value string, text string, score int")
    whole = sorted((r.value, r.text, r.ref_id, r.score) for r in canonical.map_to_canonical(rows, canon).collect())
    monkeypatch.setattr(canonical, "is_small", lambda df, n: False)
    monkeypatch.setattr(canonical, "MAX_BYTES", 0)
    monkeypatch.setattr(canonical, "HOT", 0.2)
    assert sorted((r.value, r.text, r.ref_id, r.score) for r in canonical.map_to_canonical(rows, canon).collect()) == whole
    assert len(whole) == len(values)


def test_long_values_are_read_whole(spark):
    canon = _canon(spark, CANON)
    rows = spark.createDataFrame([("word " * 3000 + "suloraspramil",), ("x" * 50_000,)], "value string")
    assert [r.ref_id for r in canonical.map_to_canonical(rows, canon).collect()] == [1, 0]


# ---------------------------------------------------------------- splits
def brute_groups(notes, links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for n, s, p in notes:
        if n is None:
            continue
        find(("n", n))
        for other in ([("s", s)] if s is not None else []) + ([("n", p)] if p is not None else []):
            parent[find(("n", n))] = find(other)
    for a, b in links:
        if a is not None and b is not None:
            parent[find(("s", a))] = find(("s", b))
    groups = {}
    for n in {n for n, _, _ in notes if n is not None}:
        groups.setdefault(find(("n", n)), []).append(n)
    return {n: min(g) for g in groups.values() for n in g}


@pytest.mark.parametrize("seed", [0, 1])
def test_groups_against_union_find(spark, seed):
    rng = random.Random(seed)
    notes = [(rng.randint(1, 120), rng.choice([None, 7, *range(40)]), rng.choice([None] * 8 + [rng.randint(1, 150)])) for _ in range(200)] + [(None, 1, 2)]
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(12)] + [(None, 3), (100, 101), (101, 5)]
    n = spark.createDataFrame([(*x, 0) for x in notes], "note_id bigint, subject_id bigint, parent_note_id bigint, n int")
    l = spark.createDataFrame(links, "subject_id bigint, linked_subject_id bigint")
    assert {r.note_id: r.group for r in splits.note_groups(n, l).collect()} == brute_groups(notes, links)
    assert splits.note_groups(n.limit(0), l.limit(0)).count() == 0


def test_long_chain_and_hub(spark):
    chain = [(i, i + 1) for i in range(1, 200)] + [(1000, 2000 + i) for i in range(300)]
    e = spark.createDataFrame(chain, "a bigint, b bigint")
    roots = {r.node: r.root for r in splits.connected(e).collect()}
    assert {roots[i] for i in range(1, 201)} == {1} and {roots[2000 + i] for i in range(300)} == {1000}


def test_assignment_keeps_groups_and_shares(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([1, *range(2, 300)]) if rng.random() > 0.33 else 1, rng.choice(["a", "b", "A ", None])) for i in range(3000)]
    g = spark.createDataFrame([(i, k) for i, k, _ in rows], "note_id bigint, group bigint")
    r = spark.createDataFrame([(i, lab) for i, _, lab in rows], "note_id bigint, label string")
    t = spark.createDataFrame([("train", 0.6), ("val", 0.2), ("test", 0.2)], "split_name string, target_share double")
    got = splits.assign_splits(g, r, t).collect()
    assert len(got) == 3000
    by = {}
    for x in got:
        by.setdefault(x.group, set()).add(x.split)
    assert all(len(s) == 1 for s in by.values())
    share = {s: sum(x.split == s for x in got) / 3000 for s in ("train", "val", "test")}
    assert abs(share["train"] - 0.6) < 0.02 and abs(share["val"] - 0.2) < 0.02
    assert splits.assign_splits(g.limit(0), r.limit(0), t).count() == 0


# ---------------------------------------------------------------- duplicates
RECORDS = [
    (1, 10, "Gout ", "status", "8.9 cm"), (2, 10, "status", "GOUT", "8.9-cm"), (3, 10, "gout", "status", "89 cm"), (4, 11, "gout", "status", "8.9cm"),
    (5, None, "a", None, "b"), (6, None, "b", "", "A"), (7, None, None, None, None), (8, None, "?", "", " "), (9, None, "1.5", "x", "y"), (10, None, "1. 5", "x", "y"), (11, None, "é", "É", "e"), (12, None, "e", "é", "é"),
]


def label(spark, rows):
    df = spark.createDataFrame([(*r, 0) for r in rows], "triple_id bigint, note_id bigint, entity string, attribute string, value string, n int")
    return {r.rid: (r.least, r.n) for r in duplicates.label_copies(df, "triple_id", ["entity", "attribute", "value"], "note_id").collect()}


def test_copies(spark):
    got = label(spark, RECORDS)
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 1), 4: (4, 1), 5: (5, 2), 6: (5, 2), 7: (7, 2), 8: (7, 2), 9: (9, 1), 10: (10, 1), 11: (11, 2), 12: (11, 2)}
    assert label(spark, RECORDS[:1]) == {1: (1, 1)}


def test_splitting_and_a_hot_key_change_nothing(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, None, "hot" if i % 3 == 0 else "h" + rng.choice("abc") * rng.randint(1, 30), "same", "same") for i in range(3000)]
    want = label(spark, rows)
    brute = {}
    for r in rows:
        brute.setdefault(r[2], []).append(r[0])
    assert want == {i: (min(g), len(g)) for g in brute.values() for i in g}
    monkeypatch.setattr(duplicates, "BUCKET_ROWS", 40)
    monkeypatch.setattr(duplicates, "MAX_SMALL", 3)
    monkeypatch.setattr(duplicates, "BURST", 4)
    assert label(spark, rows) == want


def test_trie_bursts():
    t = duplicates.BurstTrie()
    rng = random.Random(0)
    keys = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 14))) for _ in range(9000)]
    for i, k in enumerate(keys):
        t.add(k, i)
    assert sorted((e[0], e[1]) for e in t.terminals()) == sorted((keys.count(k), keys.index(k)) for k in set(keys))


# ---------------------------------------------------------------- packing
def test_nnls_against_enumeration():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = rng.random((5, 4)), rng.random(5)
        best = min(
            (float(((a[:, list(s)] @ z - b) ** 2).sum()) for s in product([0, 1], repeat=4) for s in [[i for i in range(4) if s[i]]] if s for z in [np.linalg.lstsq(a[:, s], b, rcond=None)[0]] if (z >= 0).all()),
            default=float((b**2).sum()),
        )
        x = packing.nnls(a, b)
        assert (x >= 0).all() and ((a @ x - b) ** 2).sum() <= best + 1e-9


@pytest.mark.parametrize("capacity", [16, 100, 512])
def test_plan_uses_every_item_once(capacity):
    rng = random.Random(capacity)
    hist = {}
    for _ in range(5000):
        k = min(capacity - 1, max(1, int(rng.expovariate(1 / (capacity / 4)))))
        hist[k] = hist.get(k, 0) + 1
    used, boxes = {}, 0
    for one, times in packing.plan(hist, capacity):
        assert sum(k * m for k, m in one.items()) <= capacity and times > 0
        boxes += times
        for k, m in one.items():
            used[k] = used.get(k, 0) + m * times
    assert used == hist
    assert boxes <= 1.03 * -(-sum(k * n for k, n in hist.items()) // capacity) + 2


def test_pack_places_every_token(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([0, 5, 5, 5, 17, 100, 64, 63, rng.randint(1, 300)]), "x") for i in range(2000)]
    items = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint, len string")
    limits = spark.createDataFrame([("a", 64), ("b", 100)], "pack_name string, capacity_tokens int")
    got = packing.pack(items, limits).collect()
    for name, cap in (("a", 64), ("b", 100)):
        per, boxes = {}, {}
        for r in got:
            if r.pack_name == name:
                per.setdefault(r.doc_id, []).append((r.start_token, r.n_tokens))
                if r.container_id:
                    boxes[r.container_id] = boxes.get(r.container_id, 0) + r.n_tokens
        assert max(boxes.values()) <= cap
        for i, n, _ in rows:
            p = sorted(per[i])
            assert sum(x for _, x in p) == n and len(p) == max(1, -(-n // cap))
            assert all(a + x == b for (a, x), (b, _) in zip(p, p[1:]))
    assert packing.pack(items.limit(0), limits).count() == 0


# ---------------------------------------------------------------- mixture
def test_water_fill():
    give = mixture.water_fill({"a": 100, "b": 10, "c": 50}, {"a": (0.4, 1), "b": (0.4, 2), "c": (0.2, 2), "d": (0.5, 3)}, 160)
    assert give["b"] == 20 and give["d"] == 0 and abs(give["a"] + give["c"] - 140) < 1e-9
    assert give["a"] <= 100 and give["c"] <= 100
    assert sum(mixture.water_fill({"a": 10}, {"a": (1.0, 2)}, 1000).values()) == 20


def test_mixture_shares_and_caps(spark):
    rng = random.Random(4)
    docs = [(i, rng.choice(["big"] * 6 + ["mid"] * 3 + ["tiny", None, "unnamed"]), rng.randint(0, 60), "e") for i in range(4000)]
    d = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint, epoch string")
    t = spark.createDataFrame([("big", 0.3, 1), ("mid", 0.3, 2), ("tiny", 0.2, 3), ("none", 0.2, 4)], "source string, target_share double, max_repeats int")
    mixed, report = mixture.mix(d, t)
    rows, rep = mixed.collect(), {r.source: r for r in report.collect()}
    size = {s: sum(n for _, x, n, _ in docs if x == s) for s in ("big", "mid", "tiny")}
    got = {s: sum(r.n_tokens for r in rows if r.source == s) for s in size}
    want = mixture.water_fill(size, {"big": (0.3, 1), "mid": (0.3, 2), "tiny": (0.2, 3), "none": (0.2, 4)}, sum(size.values()))
    for s in size:
        assert abs(got[s] - want[s]) <= 31 and rep[s].tokens == got[s]
    copies = {}
    for r in rows:
        copies.setdefault((r.doc_id, r.source), []).append(r.epoch)
    cap = {"big": 1, "mid": 2, "tiny": 3}
    assert all(sorted(e) == list(range(len(e))) and len(e) <= cap[s] for (_, s), e in copies.items())
    assert rep["none"].tokens == 0 and mixture.mix(d.limit(0), t)[0].count() == 0


# ---------------------------------------------------------------- tokens, repetition
def test_token_counts_round_trip(spark):
    enc = tokens.encoder(tokens.FOLDER, tokens.VOCABULARY)
    texts = ["Weight 74.9 kg,\r\n<|endoftext|> temp", "é" * 50, "", None, "x" * 3000]
    assert all(enc.decode(enc.encode_ordinary(t)) == t for t in texts if t)
    got = tokens.count_tokens(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}


def brute_repeated(text):
    import re

    ws = re.findall(r"[^\W_]+", text.lower())
    grams = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    marked = {i + k for i, g in enumerate(grams) if g in grams[:i] for k in range(5)}
    return len(marked), len(ws)


def test_repetition_against_brute_force(spark):
    rng = random.Random(8)
    texts = ["", None, "a b c d e", "a b c d e a b c d e", "A, b. c-d_e! a b c d e x", "la " * 40] + [" ".join(rng.choice("ab cd ef".split()) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    got = {r.doc_id: (r.n_repeated, r.n_words) for r in repetition.repetition_share(spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id bigint, text string, share int")).collect()}
    assert got == {i: brute_repeated(t) if t else (0, 0) for i, t in enumerate(texts)}


def test_splits_shares_on_the_small_tables(spark):
    from factgate.llm.queries import p4_report

    got = p4_report(spark, "/root/testdata/sf0.01").filter(F.col("n_notes") > 0).collect()
    assert sum(r.n_notes for r in got) > 0 and all(abs(r.share - r.target_share) < 0.05 for r in got)


# ---------------------------------------------------------------- perplexity
def test_trigram_model_is_a_distribution_and_both_ways_agree(spark):
    from factgate.llm import perplexity

    rng = random.Random(11)
    vocab = "ab cd ef gh ij kl".split()
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 40))), rng.choice(["en", "EN", None, "fr"]), 1) for i in range(200)] + [(999, "ab cd " * 60, "en", 1), (1000, None, "en", 1), (1001, " ".join(f"odd{i}" for i in range(40)), "en", 1)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, n bigint")
    local = {r.doc_id: (r.perplexity, r.band) for r in perplexity.perplexity_bands(d).collect()}
    joined = {r.doc_id: (r.perplexity, r.band) for r in perplexity.perplexity_bands(d, max_local=0).collect()}
    assert local == joined and len(local) == len(docs)
    assert local[1000] == (None, "short") and local[999][1] == "low"
    tri = perplexity.count_trigrams(d)
    p = tri.join(perplexity.train(tri), "h3").groupBy("uv").agg(F.sum(F.exp("logp")).alias("p"))
    assert p.filter("p > 1.0001 or p <= 0").count() == 0
    assert perplexity.perplexity_bands(d.limit(0)).count() == 0
