"""Queries of the training-text operators and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factgate.functions.text import trim_blanks
from factgate.llm.canonical import LEAST, MAX_SMALL, MOST_EDITS, SURE, TIE, map_to_canonical
from factgate.llm.chunking import split_texts
from factgate.llm.duplicates import label_copies
from factgate.llm.mixture import mix
from factgate.llm.packing import pack, pack_report
from factgate.llm.perplexity import perplexity_bands
from factgate.llm.repetition import LEAST_SHARE, repetition_share
from factgate.llm.splits import assign_splits, note_groups, split_report
from factgate.llm.tokens import count_tokens
from factgate.tables import broadcast_if_small, table


def _pieces(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "clinical_documents").select(F.lit("clinical_documents").alias("item_table"), F.col("patient_id").alias("item_key"), "text")
    n = table(spark, sf, "notes_all").select(F.lit("notes_all").alias("item_table"), F.col("row_id").cast("string").alias("item_key"), "text")
    return split_texts(c.unionByName(n), table(spark, sf, "chunk_limits"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _pieces(spark, sf).filter("piece_no = 0").select("item_table", "item_key", "boundary")


def p2_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return _pieces(spark, sf)


def p2_tiling(spark: SparkSession, sf: str) -> DataFrame:
    """What every set of pieces must show: the texts cut, their characters (overlaps counted once), and how many pieces break a rule."""
    limits = table(spark, sf, "chunk_limits")
    p = _pieces(spark, sf).select("item_table", "item_key", "piece_no", "start_char", "end_char", F.length("piece").alias("size"))
    before = Window.partitionBy("item_table", "item_key").orderBy("piece_no")  # one text's pieces
    p = p.withColumn("last", F.lag("end_char").over(before)).join(F.broadcast(limits), "item_table")  # a row a table
    first = F.col("last").isNull()
    gap = F.when(first, F.col("start_char") != 0).otherwise(F.col("last") - F.col("start_char") != F.least("overlap_chars", "last"))
    return p.groupBy("item_table").agg(
        F.countDistinct("item_key").alias("n_texts"), F.sum(F.col("end_char") - F.coalesce("last", F.lit(0))).alias("n_chars"), F.count_if(F.col("size") > F.col("max_chars")).alias("n_too_long"),
        F.count_if(F.col("size") != F.col("end_char") - F.col("start_char")).alias("n_altered"), F.count_if(gap).alias("n_bad_overlap"),
    )


def _mapped(spark: SparkSession, sf: str) -> DataFrame:
    canon = table(spark, sf, "canon_items")
    p = table(spark, sf, "prescriptions").select(F.lit("prescriptions").alias("item_table"), "row_id", F.col("drug").alias("value"))
    t = table(spark, sf, "triples").filter("source <> 'ehr'").select(F.lit("triples").alias("item_table"), F.col("triple_id").alias("row_id"), F.col("entity").alias("value"))
    return map_to_canonical(p.unionByName(t).filter(trim_blanks(F.col("value")) != ""), canon)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "canon_items").select(F.col("canon_name").alias("value")).filter("value is not null").distinct()
    return _mapped(spark, sf).join(broadcast_if_small(names, MAX_SMALL), "value", "left_anti").select("item_table", "row_id", "ref_id")


def p3_report(spark: SparkSession, sf: str) -> DataFrame:
    m = _mapped(spark, sf)
    return m.groupBy("item_table").agg(F.count("*").alias("n_rows"), F.count_if(F.col("ref_id") == 0).alias("n_unmatched"), F.countDistinct(F.when(F.col("ref_id") == 0, F.col("value"))).alias("n_unmatched_values"))


def p3_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """The values that denote no entry, with the rows that hold them."""
    return _mapped(spark, sf).filter("ref_id = 0").groupBy("item_table", "value").agg(F.count("*").alias("n_rows"))


def _groups(spark: SparkSession, sf: str) -> DataFrame:
    return note_groups(table(spark, sf, "notes_all"), table(spark, sf, "subject_links"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _groups(spark, sf).filter("group <> note_id").select(F.col("group").alias("note_id_a"), F.col("note_id").alias("note_id_b"))


def _assigned(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "notes_all").select("note_id", F.col("category").alias("label"))
    return assign_splits(_groups(spark, sf), labels, table(spark, sf, "split_targets"))


def p4_splits(spark: SparkSession, sf: str) -> DataFrame:
    return _assigned(spark, sf)


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    return split_report(_assigned(spark, sf), table(spark, sf, "split_targets"))


def p4_kept(spark: SparkSession, sf: str) -> DataFrame:
    """What every split must show: all notes once, no group in two splits, every share within a hundredth of its target or a note of it."""
    a = _assigned(spark, sf).select("note_id", "group", "split")
    torn = a.groupBy("group").agg(F.countDistinct("split").alias("k")).agg(F.count_if(F.col("k") > 1)).scalar()
    n = a.agg(F.count("*")).scalar()
    largest = a.groupBy("group").agg(F.count("*").alias("k")).agg(F.max("k")).scalar()
    t = table(spark, sf, "split_targets").select("split_name", "target_share")
    got = t.join(a.groupBy("split").agg(F.count("*").alias("k")), F.col("split_name") == F.col("split"), "left")
    off = F.abs(F.coalesce("k", F.lit(0)) / n - F.col("target_share"))
    return got.select("split_name", n.alias("n_notes"), torn.alias("n_torn_groups"), (off <= F.greatest(F.lit(0.01), largest / n)).alias("near_target"))


def _copies(spark: SparkSession, sf: str) -> DataFrame:
    return label_copies(table(spark, sf, "triples").select("triple_id", "note_id", "entity", "attribute", "value"), "triple_id", ["entity", "attribute", "value"], "note_id")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _copies(spark, sf).filter("rid <> least").select(F.col("least").alias("triple_id_a"), F.col("rid").alias("triple_id_b"))


def p7_records(spark: SparkSession, sf: str) -> DataFrame:
    return _copies(spark, sf).filter("rid = least").select(F.col("rid").alias("triple_id"), F.col("n").alias("n_copies"))


def p8_packed(spark: SparkSession, sf: str) -> DataFrame:
    return pack(count_tokens(table(spark, sf, "documents").select("doc_id", "text")), table(spark, sf, "pack_limits"))


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    return pack_report(p8_packed(spark, sf))


def p8_filled(spark: SparkSession, sf: str) -> DataFrame:
    """What every packing must show: all documents, none cut that fits, all tokens in order once, no container over its capacity."""
    sizes = count_tokens(table(spark, sf, "documents").select("doc_id", "text"))
    packed = pack(sizes, table(spark, sf, "pack_limits"))
    over = packed.filter("container_id is not null").groupBy("pack_name", "capacity", "container_id").agg(F.sum("n_tokens").alias("used")).groupBy("pack_name").agg(F.count_if(F.col("used") > F.col("capacity")).alias("n_over"))
    last = Window.partitionBy("pack_name", "doc_id").orderBy("piece_no")  # one document's pieces
    p = packed.withColumn("gap", F.col("start_token") != F.coalesce(F.lag(F.col("start_token") + F.col("n_tokens")).over(last), F.lit(0)))
    docs = p.groupBy("pack_name", "capacity", "doc_id").agg(F.sum("n_tokens").alias("got"), F.count("*").alias("k"), F.bool_or("gap").alias("gap")).join(sizes.select("doc_id", F.col("n_tokens").alias("want")), "doc_id")
    broken = (F.col("got") != F.col("want")) | F.col("gap") | ((F.col("want") <= F.col("capacity")) & (F.col("k") > 1))
    return docs.groupBy("pack_name", "capacity").agg(F.count("*").alias("n_docs"), F.count_if(broken).alias("n_broken")).join(over, "pack_name")


def _mix(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return mix(count_tokens(table(spark, sf, "documents").select("doc_id", "source", "text")), table(spark, sf, "mix_targets"))


def p9_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf)[0]


def p9_report(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf)[1]


def p9_capped(spark: SparkSession, sf: str) -> DataFrame:
    """What every mixture must show of each source named: its documents, no repetition beyond the cap, epochs without holes."""
    mixed, report = _mix(spark, sf)
    docs = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("k"), F.max("epoch").alias("last"), F.countDistinct("epoch").alias("epochs"))
    got = docs.groupBy("source").agg(F.max("k").alias("most"), F.count_if((F.col("last") + 1 != F.col("k")) | (F.col("epochs") != F.col("k"))).alias("holes"))
    return report.select("source", "docs", "max_repeats").join(got, "source", "left").select("source", F.col("docs").alias("n_docs"), (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within_cap"), F.coalesce("holes", F.lit(0)).alias("n_holes"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return repetition_share(table(spark, sf, "documents")).filter(F.col("share") >= LEAST_SHARE).select("doc_id")


def p10_shares(spark: SparkSession, sf: str) -> DataFrame:
    return repetition_share(table(spark, sf, "documents"))


def p10_perplexity(spark: SparkSession, sf: str) -> DataFrame:
    return perplexity_bands(table(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_pieces, p2_tiling, p3_found, p3_report, p3_unmatched, p4_found, p4_splits, p4_report, p4_kept, p7_found, p7_records, p8_packed, p8_report, p8_filled, p9_mixture, p9_report, p9_capped, p10_found, p10_shares, p10_perplexity)}

_BARE = r"coalesce(lower(regexp_replace(regexp_replace(regexp_replace({0}, '(\pN)\.(\pN)', '\1' || chr(1) || '\2', 'g'), '(\pN)\.(\pN)', '\1' || chr(1) || '\2', 'g'), '[^\pL\p{{Nd}}' || chr(1) || ']', '', 'g')), '')"
_P7 = f"""
WITH k AS (SELECT triple_id, coalesce(note_id, -1) AS s, list_sort([{_BARE.format('entity')}, {_BARE.format('attribute')}, {_BARE.format('value')}]) AS f FROM triples),
g AS (SELECT triple_id, min(triple_id) OVER (PARTITION BY s, f) AS least, count(*) OVER (PARTITION BY s, f) AS n FROM k)
"""
_P10 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\pL\pN]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) > 4)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(i) OVER (PARTITION BY doc_id, gram) AS first_ FROM g) WHERE first_ < i),
m AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeated FROM r, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY doc_id),
s AS (SELECT doc_id, coalesce(len(ws), 0) AS n_words, coalesce(n_repeated, 0) AS n_repeated FROM w LEFT JOIN m USING (doc_id))
"""
_STRETCH = """
WITH items AS (
  SELECT 'clinical_documents' AS item_table, patient_id AS item_key, text FROM clinical_documents
  UNION ALL SELECT 'notes_all', CAST(row_id AS VARCHAR), text FROM notes_all),
long_ AS (SELECT item_table, item_key, text, max_chars FROM items JOIN chunk_limits USING (item_table) WHERE length(text) > max_chars),
longest AS (SELECT item_table, item_key, max_chars,
"""


def _longest(pattern: str) -> str:
    blank = r"[\s\x0B\x1C-\x1F\x{85}\pZ]"
    return f"list_max(list_transform(string_split_regex(text, '{pattern}'), lambda x: length(regexp_replace(x, '^{blank}+|{blank}+$', '', 'g'))))"


def _pairs(t: str) -> str:
    return f"CASE WHEN length({t}) < 2 THEN [{t}] ELSE list_distinct(list_transform(range(1, length({t})), lambda i: substr({t}, i, 2))) END"


def _shared(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b})))"


_EDITS = "levenshtein(t, e) / greatest(length(t), length(e))"
_WS = r"regexp_extract_all(strip_accents(lower({0})), '\pL+(?:\p{{Nd}}\pL+)*')"
_BLANKS = r"[\s\x0B\x1C-\x1F\x{85}\pZ]"
_P3 = rf"""
WITH rows_ AS (
  SELECT 'prescriptions' AS item_table, row_id, drug AS v FROM prescriptions UNION ALL SELECT 'triples', triple_id, entity FROM triples WHERE source <> 'ehr'),
held AS (SELECT * FROM rows_ WHERE regexp_replace(v, '{_BLANKS}', '', 'g') <> ''),
ents AS (
  SELECT ref, e, {_pairs('e')} AS pe FROM (SELECT DISTINCT ref, array_to_string({_WS.format('n')}, '') AS e FROM (
    SELECT ref_id AS ref, canon_name AS n FROM canon_items UNION ALL SELECT ref_id, alt_name FROM canon_items WHERE item_kind <> 'condition') WHERE n IS NOT NULL) WHERE e <> ''),
vals AS (SELECT v, ws, array_to_string(ws, '') AS t, regexp_replace(strip_accents(lower(v)), '[^\pL]', '', 'g') AS i FROM (SELECT v, {_WS.format('v')} AS ws FROM (SELECT DISTINCT v FROM held))),
known AS (
  SELECT v, ws, t, coalesce((SELECT min(ref_id) FROM canon_items WHERE canon_name = v),
    (SELECT min(ref_id) FROM canon_items WHERE item_kind = 'condition' AND regexp_replace(strip_accents(lower(alt_name)), '[^\pL]', '', 'g') = i),
    (SELECT min(ref) FROM ents WHERE e = t)) AS ref FROM vals),
size_ AS (SELECT floor(max(length(e)) / {LEAST}) AS longest FROM ents),
whole AS (SELECT v, t, e, ents.ref, {_shared('pt', 'pe')} AS j FROM (SELECT v, t, {_pairs('t')} AS pt FROM known, size_ WHERE ref IS NULL AND t <> '' AND length(t) <= longest) JOIN ents ON len(pt) >= {LEAST} * len(pe) AND len(pe) >= {LEAST} * len(pt)),
w1 AS (SELECT *, {_EDITS} AS d, max(j) OVER (PARTITION BY v) AS top FROM whole WHERE j >= {LEAST}),
first_ AS (SELECT v, arg_min(ref, (d, -j, -length(t), ref)) AS ref FROM w1 WHERE top >= {SURE} AND j >= top - {TIE} GROUP BY 1),
runs AS (SELECT v, a, unnest(range(a, len(ws) + 1)) AS b, ws FROM (SELECT v, ws, unnest(range(1, len(ws) + 1)) AS a FROM known WHERE ref IS NULL AND v NOT IN (SELECT v FROM first_))),
parts AS (SELECT DISTINCT v, t FROM (SELECT v, array_to_string(ws[a:b], '') AS t FROM runs), size_ WHERE length(t) <= longest),
near AS (SELECT v, t, e, ents.ref, {_shared('pt', 'pe')} AS j FROM (SELECT v, t, {_pairs('t')} AS pt FROM parts) JOIN ents ON len(pt) >= {LEAST} * len(pe) AND len(pe) >= {LEAST} * len(pt)),
w2 AS (SELECT *, {_EDITS} AS d FROM near WHERE j >= {LEAST}),
w3 AS (SELECT *, max(j) OVER (PARTITION BY v) AS top FROM w2 WHERE j >= {SURE} OR d <= {MOST_EDITS}),
second AS (SELECT v, arg_min(ref, (d, -j, -length(t), ref)) AS ref FROM w3 WHERE j >= top - {TIE} GROUP BY 1),
mapped AS (SELECT item_table, row_id, held.v, CAST(coalesce(known.ref, first_.ref, second.ref, 0) AS BIGINT) AS ref_id FROM held JOIN known ON known.v = held.v LEFT JOIN first_ ON first_.v = held.v LEFT JOIN second ON second.v = held.v)
"""

_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\pZ]"
ORACLE = {
    "p2_found": _STRETCH
    + f"{_longest(r'\n' + r'[\t\r\f\x0B\x1C-\x1F\x{85}\pZ]*' + r'\n')} AS a, {_longest(r'\n')} AS b, "
    + f"list_max(list_transform(string_split_regex(regexp_replace(text, '([.!?]){_SPACE}+', '\\1' || chr(10), 'g'), '\\n'), lambda x: length(regexp_replace(x, '^{_SPACE}+|{_SPACE}+$', '', 'g')))) AS c, {_longest(_SPACE + '+')} AS d FROM long_) "
    + "SELECT item_table, item_key, CASE WHEN a <= max_chars THEN 'blank_line' WHEN b <= max_chars THEN 'line' WHEN c <= max_chars THEN 'sentence' WHEN d <= max_chars THEN 'space' ELSE 'none' END AS boundary FROM longest",
    "p2_tiling": _STRETCH.split("longest AS (")[0].rstrip().rstrip(",") + " SELECT item_table, count(DISTINCT item_key) AS n_texts, CAST(sum(length(text)) AS BIGINT) AS n_chars, 0 AS n_too_long, 0 AS n_altered, 0 AS n_bad_overlap FROM long_ GROUP BY 1",
    "p4_kept": "SELECT split_name, (SELECT count(DISTINCT note_id) FROM notes_all) AS n_notes, 0 AS n_torn_groups, true AS near_target FROM split_targets",
    "p8_filled": "SELECT pack_name, capacity_tokens AS capacity, (SELECT count(*) FROM documents) AS n_docs, 0 AS n_broken, 0 AS n_over FROM pack_limits",
    "p9_capped": "SELECT source, (SELECT count(*) FROM documents d WHERE d.source = t.source AND length(text) > 0) AS n_docs, true AS within_cap, 0 AS n_holes FROM mix_targets t",
    "p3_found": _P3 + "SELECT item_table, row_id, ref_id FROM mapped WHERE v NOT IN (SELECT canon_name FROM canon_items WHERE canon_name IS NOT NULL)",
    "p3_report": _P3 + "SELECT item_table, count(*) AS n_rows, count(*) FILTER (WHERE ref_id = 0) AS n_unmatched, count(DISTINCT v) FILTER (WHERE ref_id = 0) AS n_unmatched_values FROM mapped GROUP BY 1",
    "p3_unmatched": _P3 + "SELECT item_table, v AS value, count(*) AS n_rows FROM mapped WHERE ref_id = 0 GROUP BY ALL",
    "p4_found": """
WITH RECURSIVE ties AS (
  SELECT 'n' || note_id AS a, 's' || subject_id AS b FROM notes_all WHERE note_id IS NOT NULL AND subject_id IS NOT NULL
  UNION SELECT 'n' || note_id, 'n' || parent_note_id FROM notes_all WHERE note_id IS NOT NULL AND parent_note_id IS NOT NULL
  UNION SELECT 's' || subject_id, 's' || linked_subject_id FROM subject_links WHERE subject_id IS NOT NULL AND linked_subject_id IS NOT NULL),
edges AS (SELECT a, b FROM ties UNION SELECT b, a FROM ties),
reach AS (
  SELECT DISTINCT note_id AS origin, 'n' || note_id AS node FROM notes_all WHERE note_id IS NOT NULL
  UNION SELECT origin, b FROM reach JOIN edges ON node = a),
least AS (SELECT n.note_id, min(r.origin) AS group_ FROM (SELECT DISTINCT note_id FROM notes_all WHERE note_id IS NOT NULL) n JOIN reach r ON r.node = 'n' || n.note_id GROUP BY 1)
SELECT group_ AS note_id_a, note_id AS note_id_b FROM least WHERE group_ <> note_id""",
    "p7_found": _P7 + "SELECT least AS triple_id_a, triple_id AS triple_id_b FROM g WHERE triple_id <> least",
    "p7_records": _P7 + "SELECT triple_id, n AS n_copies FROM g WHERE triple_id = least",
    "p10_found": _P10 + "SELECT doc_id FROM s WHERE n_words > 0 AND n_repeated / n_words >= 0.3",
    "p10_shares": _P10 + "SELECT doc_id, n_words, n_repeated, CASE WHEN n_words > 0 THEN n_repeated / n_words ELSE 0 END AS share FROM s",
}
