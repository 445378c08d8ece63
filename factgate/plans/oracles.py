"""SQL that checks the claim, graph and text queries, built from the same fixed values but run by another engine."""

from __future__ import annotations

from factgate import vocab

AS_OF = "2021-06-01"
_C = """c AS (SELECT triple_id AS claim_id, note_id, source AS model, entity, attribute, value, fhir_type AS kind, temporal_start AS anchor, evidence_span AS evidence FROM triples WHERE source <> 'ehr')"""
_KEYS = "note_id, lower(trim(coalesce(entity, ''), ' ')), lower(trim(coalesce(attribute, ''), ' ')), lower(trim(coalesce(value, ''), ' '))"
_U = f"u AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY {_KEYS} ORDER BY model, claim_id) = 1)"
_NOTES = "notes AS (SELECT note_id, arg_min(coalesce(text, chr(0)), row_id) AS text, arg_min(coalesce(subject_id, -1), row_id) AS subject_id FROM notes_all WHERE note_id IS NOT NULL GROUP BY 1)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def items(values) -> str:
    return ", ".join(q(v) for v in values)


def norm(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '[^\pL\pN_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def toks(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN []::VARCHAR[] ELSE list_distinct(string_split({x}, ' ')) END"


def tidy(x: str) -> str:
    return rf"trim(regexp_replace(lower(coalesce({x}, '')), '\s+', ' ', 'g'))"


def case(key: str, table: dict[str, str]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + " END"


def phi(x: str) -> str:
    return f"regexp_matches(coalesce({x}, ''), {q(vocab.PHI)})"


def scrub(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(coalesce({x}, ''), {q(vocab.PHI_MARKS)}, ' REDACTED ', 'g'), '\s+', ' ', 'g'))"


def vacuous(x: str) -> str:
    return f"({tidy(x)} IN ({items(vocab.VACUOUS)}) OR length({tidy(x)}) <= 2 OR regexp_matches({tidy(x)}, '^[0-9]+$'))"


def type_a(raw: str, attribute: str) -> str:
    by_part = " ".join(f"WHEN regexp_matches({tidy(attribute)}, {q(p)}) THEN {q(t)}" for t, p in vocab.TYPE_BY_ATTRIBUTE)
    by_word = case(tidy(raw), vocab.TYPE_WORDS_A)
    return f"CASE WHEN {raw} IN ({items(vocab.ALL_TYPES)}) THEN {raw} WHEN {by_word} IS NOT NULL THEN {by_word} {by_part} ELSE 'Observation' END"


def type_c(raw: str) -> str:
    key = f"lower(trim({raw}))"
    return f"coalesce({case(key, vocab.TYPE_WORDS_C)}, {case(key, {t.lower(): t for t in vocab.CORE_TYPES})}, {raw}, '')"


def status(a: str) -> str:
    return f"coalesce({case(tidy(a), vocab.STATUS_WORDS)}, 'present')"


def code(x: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower(trim({x})), {q(t)}) THEN {q(s + ':' + c)}" for s, terms in vocab.CODES for t, c in terms.items()) + " END"


def bucket(x: str) -> str:
    up = f"(trim({x}) = upper(trim({x})) AND trim({x}) <> lower(trim({x})))"
    return (
        f"CASE WHEN lower(trim({x})) IN ({items(vocab.MISS_HEADERS)}) OR ({up} AND length(trim({x})) > 5) THEN 'section_header' WHEN regexp_matches(trim({x}), {q(vocab.MISS_UNITS)}) THEN 'lab_fragment'"
        f" WHEN regexp_matches(trim({x}), {q(vocab.MISS_GENERIC)}) THEN 'anaphora' WHEN {up} AND length(trim({x})) <= 5 THEN 'abbreviation' ELSE 'substantive' END"
    )


def _uri(x: str) -> str:
    return rf"left(regexp_replace(regexp_replace(regexp_replace(trim({x}), '[^\pL\pN_-]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g'), 100)"


def forms(x: str) -> str:
    short = {v: k for k, v in vocab.ABBREVIATIONS.items()}
    return f"list_filter([{x}, {case(x, vocab.ABBREVIATIONS)}, {case(x, short)}], lambda f: f IS NOT NULL)"


def score(a: str, b: str, fa: str, fb: str, ta: str, tb: str) -> str:
    """match_score of two normal forms with their forms and tokens."""
    both = f"len(list_intersect({ta}, {tb}))"
    jac, inside = f"({both} / greatest(len(list_distinct(list_concat({ta}, {tb}))), 1))", f"({both} / greatest(len({tb}), 1))"
    near = f"len(list_filter({fa}, lambda x: len(list_filter({fb}, lambda y: contains(x, y) OR contains(y, x))) > 0)) > 0"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0 WHEN {a} = {b} THEN 1 WHEN contains({a}, {b}) OR contains({b}, {a}) THEN 0.9 WHEN {near} THEN 0.85 WHEN {jac} >= 0.5 THEN {jac} WHEN {inside} >= 0.6 THEN {inside} * 0.8 ELSE 0 END"


_CLEAN = f"""
k0 AS (SELECT *, {phi('entity')} OR {phi('value')} AS phi_, {scrub('entity')} AS e0, {scrub('value')} AS v0, {tidy('attribute')} IN ({items(vocab.DEMOGRAPHIC)}) AS dem FROM c),
k1 AS (SELECT *, {vacuous('e0')} AS vac, {vacuous('e0')} AND dem AND v0 <> '' AS recast FROM k0),
k2 AS (SELECT *, CASE WHEN recast THEN 'Patient' ELSE e0 END AS e FROM k1),
k3 AS (SELECT *, {tidy('e')} = {tidy('v0')} AND e <> '' AS collapsed, {type_a("coalesce(kind, '')", 'attribute')} AS canonical,
  CASE WHEN phi_ THEN 'phi' WHEN vac AND NOT recast THEN 'vacuous' WHEN {tidy('kind')} IN ({items(vocab.ADMIN_TYPES)}) AND NOT dem THEN 'admin' END AS drop_reason FROM k2),
k AS (SELECT claim_id, note_id, model, e AS entity, attribute, CASE WHEN collapsed THEN {status('attribute')} ELSE v0 END AS value,
  CASE WHEN recast THEN 'Patient' ELSE canonical END AS kind, CASE WHEN evidence <> '' THEN {scrub('evidence')} END AS evidence, CASE WHEN anchor <> '' THEN {scrub('anchor')} END AS anchor,
  drop_reason, recast, collapsed, canonical <> coalesce(kind, '') AS retyped FROM k3),
kept AS (SELECT *, len(list_distinct(list(model) OVER (PARTITION BY note_id, {tidy('entity')}, {tidy('attribute')}, {tidy('value')}, kind))) AS consensus FROM k WHERE drop_reason IS NULL
  QUALIFY row_number() OVER (PARTITION BY note_id, {tidy('entity')}, {tidy('attribute')}, {tidy('value')}, kind ORDER BY claim_id) = 1)"""

_MON = "january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec"
_DAY = rf"""CASE
  WHEN regexp_matches(trim(anchor), '^\d{{1,2}}(/\d{{1,2}}/|-\d{{1,2}}-)(\d{{4}}|\d{{2}})$') THEN try_cast(
    CASE WHEN length(regexp_extract(trim(anchor), '(\d+)$', 1)) = 4 THEN regexp_extract(trim(anchor), '(\d+)$', 1) WHEN CAST(regexp_extract(trim(anchor), '(\d+)$', 1) AS INT) < 69 THEN '20' || regexp_extract(trim(anchor), '(\d+)$', 1) ELSE '19' || regexp_extract(trim(anchor), '(\d+)$', 1) END
    || '-' || regexp_extract(trim(anchor), '^(\d+)', 1) || '-' || regexp_extract(trim(anchor), '^\d+.(\d+)', 1) AS DATE)
  WHEN regexp_matches(trim(anchor), '^\d{{4}}-\d{{1,2}}-\d{{1,2}}$') THEN try_cast(trim(anchor) AS DATE)
  WHEN regexp_matches(trim(anchor), '(?i)^({_MON}) \d{{1,2}}, \d{{4}}$') THEN try_cast(regexp_extract(anchor, '(\d{{4}}) *$', 1) || '-' || CAST((instr('janfebmaraprmayjunjulaugsepoctnovdec', lower(substr(trim(anchor), 1, 3))) + 2) // 3 AS VARCHAR) || '-' || regexp_extract(anchor, '(\d+),', 1) AS DATE)
END"""
TEMPORAL = f"CASE WHEN lower(coalesce(anchor, '')) IN ('', 'null', 'none', 'n/a') THEN 0.7 WHEN {_DAY} IS NULL THEN 0.6 WHEN year({_DAY}) < 1900 OR {_DAY} > DATE '{AS_OF}' THEN 0.1 WHEN year({_DAY}) < 1980 THEN 0.3 ELSE 1.0 END"
ONTOLOGY = f"CASE WHEN {norm("coalesce(entity, '')")} IN ({items(vocab.KNOWN_TERMS)}) OR len(list_intersect(string_split({norm("coalesce(entity, '')")}, ' '), [{items(vocab.KNOWN_TERMS)}])) > 0 THEN 1.0 WHEN kind IN ({items(vocab.CORE_TYPES)}) THEN 0.7 ELSE 0.3 END"


def _ground(c: str) -> str:
    n = norm(f"coalesce({c}, '')")
    return f"(CASE WHEN {n} <> '' AND note IS NOT NULL AND (contains(note, {n}) OR len(list_intersect({toks(n)}, tk)) / greatest(len({toks(n)}), 1) >= 0.6) THEN 1.0 ELSE 0.0 END)"


_GROUND = f"""
{_NOTES},
nn AS (SELECT note_id AS nid, {norm('replace(text, chr(0), chr(32))')} AS note FROM notes),
nt AS (SELECT nid, note, {toks('note')} AS tk FROM nn),
gr AS (SELECT u.*, list_filter([{', '.join(f"CASE WHEN length(coalesce({c}, '')) > {n} THEN {_ground(c)} END" for c, n in (('entity', 2), ('value', 2), ('evidence', 5)))}], lambda x: x IS NOT NULL) AS g FROM SRC u LEFT JOIN nt ON nt.nid = u.note_id)"""
GROUNDING = "CASE WHEN len(g) = 0 THEN 0.5 ELSE list_sum(g) / len(g) END"

_SCHEMA_LISTS = "sl(kind, va) AS (VALUES " + ", ".join(f"({q(t)}, {q(a)})" for t, names in vocab.VALID_ATTRIBUTES.items() for a in names) + ")"
_SCHEMA = f"""
{_SCHEMA_LISTS},
sa AS (SELECT DISTINCT kind, attribute, {norm("coalesce(attribute, '')")} AS a FROM c),
sp AS (SELECT sa.kind, attribute, a, va, {norm('va')} AS b FROM sa LEFT JOIN sl ON sl.kind = sa.kind),
sf AS (SELECT *, {forms('a')} AS fa, {forms('b')} AS fb, {toks('a')} AS ta, {toks('b')} AS tb FROM sp),
ss AS (SELECT kind AS skind, attribute AS sattr, CASE WHEN max(va) IS NULL THEN 0.5 WHEN bool_or(contains(a, va) OR contains(va, a)) THEN 1.0 WHEN bool_or({score('a', 'b', 'fa', 'fb', 'ta', 'tb')} >= 0.5) THEN 0.8 ELSE 0.3 END AS schema_ FROM sf GROUP BY ALL)"""

_opp = " OR ".join(f"(contains(l.v, {q(p)}) AND contains(r.v, {q(n)})) OR (contains(l.v, {q(n)}) AND contains(r.v, {q(p)}))" for p, n in vocab.OPPOSITES)
_CONTRA = f"""
cf AS (SELECT claim_id, note_id, anchor, {norm("coalesce(entity, '')")} AS e, {norm("coalesce(attribute, '')")} AS a, {norm("coalesce(value, '')")} AS v FROM SRC WHERE coalesce(anchor, '') <> ''),
cg AS (SELECT *, {forms('e')} AS fe, {forms('a')} AS fa, {toks('e')} AS te, {toks('a')} AS ta FROM cf),
cp AS (SELECT l.claim_id, arg_min(CASE WHEN {_opp} THEN 0.1 ELSE 0.5 END, r.claim_id) AS s FROM cg l JOIN cg r ON l.note_id = r.note_id AND l.anchor = r.anchor AND l.v <> r.v
  WHERE {score('l.e', 'r.e', 'l.fe', 'r.fe', 'l.te', 'r.te')} >= 0.6 AND {score('l.a', 'r.a', 'l.fa', 'r.fa', 'l.ta', 'r.ta')} >= 0.6 GROUP BY 1)"""


def _src(sql: str, name: str) -> str:
    return sql.replace("SRC", name)


_VALID = f"""{_C}, {_U}, {_src(_GROUND, 'u')}, {_SCHEMA}, {_src(_CONTRA, 'u')},
v0 AS (SELECT gr.*, {GROUNDING} AS grounding, {ONTOLOGY} AS ontology, ss.schema_ AS schema_, {TEMPORAL} AS temporal, coalesce(cp.s, 1.0) AS contradiction
  FROM gr JOIN ss ON skind IS NOT DISTINCT FROM kind AND sattr IS NOT DISTINCT FROM attribute LEFT JOIN (SELECT claim_id AS cclaim, s FROM cp) cp ON cclaim = gr.claim_id),
v AS (SELECT *, round(CAST(0 AS DOUBLE) + grounding * 0.3::DOUBLE + ontology * 0.2::DOUBLE + schema_ * 0.15::DOUBLE + temporal * 0.15::DOUBLE + contradiction * 0.2::DOUBLE, 4) AS trust FROM v0)"""
# whole-word occurrences: the text is cut at the name, and the characters on both sides of each cut are looked at
_EDGE = "(CASE WHEN {0} = '' THEN {1} ELSE NOT regexp_matches({2}, '[\\pL\\pN]') END)"
_FOUND = f"""fo AS (SELECT note_id, text, name, label, ps, unnest(range(1, len(ps))) AS i FROM (SELECT note_id, text, lower(canon_name) AS name, min(item_kind) AS label, string_split(lower(text), lower(canon_name)) AS ps
  FROM notes JOIN canon_items ON contains(lower(text), lower(canon_name)) GROUP BY note_id, text, lower(canon_name))),
mt AS (SELECT note_id, name, label, CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + (i - 1) * length(name) AS INT) AS start, text FROM fo WHERE {_EDGE.format('ps[i]', 'i = 1', 'right(ps[i], 1)')} AND {_EDGE.format('ps[i + 1]', 'i + 1 = len(ps)', 'left(ps[i + 1], 1)')})"""
_GOLD = f"{_FOUND}, gold AS (SELECT note_id, name AS gold, min(label) AS label, count(*) AS n FROM mt GROUP BY 1, 2)"
_TEXTS = f"""{_NOTES}, tx AS (SELECT DISTINCT note_id, model, x.t AS text FROM (SELECT note_id, model, unnest(list_filter([trim(coalesce(entity, ''), ' '), trim(coalesce(value, ''), ' '), trim(coalesce(evidence, ''), ' '), trim(trim(coalesce(entity, ''), ' ') || ' ' || trim(coalesce(value, ''), ' '), ' ')], lambda z: length(z) > 1)) AS t FROM c WHERE note_id IS NOT NULL) x),
{_GOLD}"""
_HITS = f"""{_C}, {_TEXTS},
ta AS (SELECT note_id, model, text, {norm('text')} AS a FROM tx), tb AS (SELECT note_id, gold, {norm('gold')} AS b FROM gold),
fa AS (SELECT DISTINCT note_id, a, {forms('a')} AS f1, {toks('a')} AS t1 FROM ta WHERE a <> ''), fb AS (SELECT DISTINCT note_id, b, {forms('b')} AS f2, {toks('b')} AS t2 FROM tb WHERE b <> ''),
fp AS (SELECT fa.note_id, a, b, {score('a', 'b', 'f1', 'f2', 't1', 't2')} AS score FROM fa JOIN fb ON fa.note_id = fb.note_id),
hits AS (SELECT ta.note_id, model, text, gold, score FROM ta JOIN fp ON fp.note_id = ta.note_id AND fp.a = ta.a JOIN tb ON tb.note_id = fp.note_id AND tb.b = fp.b WHERE score >= 0.4)"""
_CTEXTS = "ct AS (SELECT claim_id, unnest(list_distinct(list_filter([trim(coalesce(entity, ''), ' '), trim(coalesce(value, ''), ' '), trim(coalesce(evidence, ''), ' '), trim(trim(coalesce(entity, ''), ' ') || ' ' || trim(coalesce(value, ''), ' '), ' ')], lambda z: length(z) > 1))) AS text FROM c WHERE note_id IS NOT NULL)"
_BARE = f"""gn AS (SELECT note_id AS nid, {norm('replace(text, chr(0), chr(32))')} AS note FROM notes), gt AS (SELECT nid, note, {toks('note')} AS tk FROM gn),
bg AS (SELECT claim_id, coalesce(bool_or(g), false) AS grounded FROM (SELECT c.claim_id, n <> '' AND note IS NOT NULL AND (contains(note, n) OR len(list_intersect({toks('n')}, tk)) / greatest(len({toks('n')}), 1) >= 0.6) AS g
  FROM c LEFT JOIN (SELECT claim_id, {norm('text')} AS n FROM ct) ct ON ct.claim_id = c.claim_id LEFT JOIN gt ON nid = c.note_id WHERE c.note_id IS NOT NULL) GROUP BY 1)"""
_BY_NOTE = f"""{_HITS}, {_CTEXTS}, {_BARE}, mc AS (SELECT DISTINCT c.note_id, c.model, c.claim_id, h.gold FROM ct JOIN c USING (claim_id) JOIN hits h ON h.note_id = c.note_id AND h.text = ct.text),
cg AS (SELECT DISTINCT note_id, model, gold FROM mc), ng AS (SELECT note_id, count(*) AS n_gold, CAST(sum(n) AS BIGINT) AS n_mentions FROM gold GROUP BY 1),
nb AS (SELECT note_id, model, count(*) AS n_claims, count(*) FILTER (WHERE NOT grounded) AS n_ungrounded FROM c JOIN bg USING (claim_id) GROUP BY 1, 2), nr AS (SELECT note_id, model, count(DISTINCT claim_id) AS n_right FROM mc GROUP BY 1, 2),
nc AS (SELECT cg.note_id, model, count(*) AS n_covered, CAST(sum(n) AS BIGINT) AS n_covered_mentions FROM cg JOIN gold ON gold.note_id = cg.note_id AND gold.gold = cg.gold GROUP BY 1, 2),
nx AS (SELECT nb.*, n_gold, n_mentions, coalesce(n_right, 0) AS n_right, coalesce(n_covered, 0) AS n_covered, coalesce(n_covered_mentions, 0) AS n_covered_mentions FROM nb JOIN ng ON ng.note_id = nb.note_id LEFT JOIN nr ON nr.note_id = nb.note_id AND nr.model = nb.model LEFT JOIN nc ON nc.note_id = nb.note_id AND nc.model = nb.model),
np AS (SELECT *, n_right / n_claims AS p, n_covered / n_gold AS r, n_covered_mentions / n_mentions AS mention_r, n_ungrounded / n_claims AS hallucination FROM nx),
ns AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1, CASE WHEN p + mention_r > 0 THEN 2 * p * mention_r / (p + mention_r) ELSE 0 END AS mention_f1 FROM np)"""
_CHART = """tl AS (SELECT icd9_code, arg_min(long_title, (loaded_at, long_title)) AS long_title FROM d_icd_diagnoses WHERE icd9_code IS NOT NULL GROUP BY 1), li AS (SELECT itemid, arg_min(label, (loaded_at, label)) AS label FROM d_labitems WHERE itemid IS NOT NULL GROUP BY 1),
cc AS (SELECT DISTINCT hadm_id, 'diagnosis' AS category, lower(long_title) AS concept FROM diagnoses_icd JOIN tl USING (icd9_code) WHERE hadm_id IS NOT NULL AND coalesce(long_title, '') <> ''
  UNION SELECT hadm_id, 'medication', lower(trim(drug, ' ')) FROM (SELECT *, row_number() OVER (PARTITION BY hadm_id ORDER BY row_id) AS nth FROM prescriptions WHERE hadm_id IS NOT NULL) WHERE nth <= 20 AND length(trim(drug, ' ')) > 2
  UNION SELECT hadm_id, 'lab', lower(label) FROM (SELECT *, row_number() OVER (PARTITION BY hadm_id ORDER BY row_id) AS nth FROM (SELECT hadm_id, label, min(row_id) AS row_id FROM (SELECT *, row_number() OVER (PARTITION BY hadm_id ORDER BY row_id) AS k FROM labevents WHERE hadm_id IS NOT NULL) JOIN li USING (itemid) WHERE k <= 50 AND coalesce(label, '') <> '' GROUP BY 1, 2)) WHERE nth <= 20)"""


def _form(x: str) -> str:
    return f"array_to_string(list_filter(string_split({norm(f"coalesce({x}, '')")}, ' '), lambda w: length(w) > 1 AND w NOT IN ({items(vocab.CONCEPT_STOP_WORDS)})), ' ')"


def same_concept(x: str, y: str) -> str:
    tx, ty = f"list_distinct(string_split({x}, ' '))", f"list_distinct(string_split({y}, ' '))"
    inside = f"(least(length({x}), length({y})) >= 4 AND CASE WHEN length({x}) <= length({y}) THEN contains({y}, {x}) ELSE contains({x}, {y}) END)"
    return f"({x} <> '' AND {y} <> '' AND ({x} = {y} OR {inside} OR len(list_intersect({tx}, {ty})) / greatest(len(list_distinct(list_concat({tx}, {ty}))), 1) > 0.3))"


_MISSED = "ms AS (SELECT * FROM gold ANTI JOIN hits h ON h.note_id = gold.note_id AND h.gold = gold.gold)"
_CHECK = f"""{_C}, {_NOTES}, ev AS (SELECT c.*, {tidy("CASE WHEN coalesce(evidence, '') <> '' THEN evidence ELSE value END")} AS ev FROM c),
ck AS (SELECT ev.*, CASE WHEN length(ev) >= LEAST_ THEN contains(coalesce({tidy('replace(text, chr(0), chr(32))')}, ''), ev) END AS verbatim FROM ev LEFT JOIN notes ON notes.note_id = ev.note_id)"""
_SCORED = f"""{_VALID},
ag AS (SELECT arg_min(claim_id, (model, claim_id)) AS cid, CAST(count(DISTINCT model) > 1 AS INT) AS y FROM c GROUP BY {_KEYS}),
sc AS (SELECT v.claim_id, least(greatest(trust, 0), 1) AS score, y FROM v JOIN ag ON cid = v.claim_id)"""
_CURVE = f"{_SCORED}, cv AS (SELECT *, row_number() OVER w AS rank, sum(1 - y) OVER w AS errors FROM sc WINDOW w AS (ORDER BY score DESC, claim_id))"

_FAIL = {
    "degenerate": f"{tidy('entity')} = {tidy('value')} AND {tidy('entity')} <> ''",
    "phi": r"regexp_matches(lower(coalesce(entity, '') || coalesce(value, '')), '\[|\*\*\*\*\*|known (lastname|firstname)')",
    "bad type": f"{tidy('kind')} <> '' AND {tidy('kind')} NOT IN ({items([*(x.lower() for x in vocab.ALL_TYPES), 'deviceusestatement'])})",
    "vacuous": f"{tidy('entity')} IN ({items(vocab.SURVEY_GENERIC)}) OR length({tidy('entity')}) <= 3",
    "ungrounded": "NOT coalesce(verbatim, true)",
}

CLAIMS = {
    "f01_normalize": f"WITH {_C} SELECT claim_id, {norm("coalesce(entity, '')")} AS entity, {tidy('attribute')} AS attribute FROM c",
    "f06_identifiers": f"WITH {_C} SELECT claim_id, url_encode({_uri("coalesce(entity, '')")}) AS uri, {scrub('value')} AS scrubbed, {phi('entity')} AS phi, {vacuous('entity')} AS vacuous, {status('attribute')} AS status, {code('entity')} AS code, {bucket("coalesce(entity, '')")} AS bucket FROM c",
    "f37_fallback": f"WITH {_C} SELECT claim_id, CASE WHEN trim(entity, ' ') <> '' THEN entity WHEN trim(attribute, ' ') <> '' THEN attribute END AS head, CASE WHEN trim(value, ' ') <> '' THEN value WHEN trim(evidence, ' ') <> '' THEN evidence END AS tail FROM c",
    "w13_union": f"WITH {_C}, {_U} SELECT claim_id, note_id, model, entity, attribute, value FROM u",
    "e06_consensus": f"WITH {_C} SELECT note_id, lower(trim(coalesce(entity, ''), ' ')) AS entity, lower(trim(coalesce(attribute, ''), ' ')) AS attribute, lower(trim(coalesce(value, ''), ' ')) AS value, count(DISTINCT model) AS n_models, count(*) AS n_claims, min(claim_id) AS first_claim FROM c GROUP BY {_KEYS}",
    "v11_cleaning": f"WITH {_C}, {_CLEAN} SELECT count(*) AS n_input, count(*) FILTER (WHERE drop_reason = 'phi') AS n_phi, count(*) FILTER (WHERE drop_reason = 'vacuous') AS n_vacuous, count(*) FILTER (WHERE drop_reason = 'admin') AS n_admin, count(*) FILTER (WHERE drop_reason IS NULL AND recast) AS n_recast, count(*) FILTER (WHERE drop_reason IS NULL AND collapsed) AS n_collapsed, count(*) FILTER (WHERE drop_reason IS NULL AND retyped) AS n_retyped, (SELECT count(*) FROM kept) AS n_kept, count(*) FILTER (WHERE drop_reason IS NULL) - (SELECT count(*) FROM kept) AS n_deduped FROM k",
    "sel08_drops": f"WITH {_C}, {_CLEAN} SELECT claim_id, entity, value, kind, drop_reason, recast, collapsed FROM k",
    "v14_kept": f"WITH {_C}, {_CLEAN} SELECT claim_id, note_id, entity, attribute, value, kind FROM kept",
    "v02_grounding": f"WITH {_C}, {_src(_GROUND, 'c')} SELECT claim_id, round({GROUNDING}, 6) AS grounding FROM gr",
    "v03_ontology": f"WITH {_C} SELECT claim_id, {ONTOLOGY} AS ontology FROM c",
    "v04_schema": f"WITH {_C}, {_SCHEMA} SELECT coalesce(skind, '') AS kind, coalesce(sattr, '') AS attribute, schema_ AS schema FROM ss",
    "v05_temporal": f"WITH {_C} SELECT claim_id, {TEMPORAL} AS temporal FROM c",
    "v06_contradiction": f"WITH {_C}, {_src(_CONTRA, 'c')} SELECT c.claim_id, coalesce(s, 1.0) AS contradiction FROM c LEFT JOIN cp ON cp.claim_id = c.claim_id",
    "v07_trust": f"WITH {_VALID} SELECT claim_id, note_id, kind, round(grounding, 3) AS grounding, round(ontology, 3) AS ontology, round(schema_, 3) AS schema, round(temporal, 3) AS temporal, round(contradiction, 3) AS contradiction, trust FROM v",
    "sel05_gate": f"WITH {_VALID} SELECT coalesce(kind, '') AS kind, count(*) AS n, count(*) FILTER (WHERE trust >= 0.7 AND grounding > 0) AS n_admitted, count(*) FILTER (WHERE grounding >= 0.5) AS n_grounded, round(avg(trust), 4) AS mean_trust FROM v GROUP BY 1",
    "a03_layers": f"WITH {_VALID}, lg AS (SELECT model AS grp, unnest(['grounding', 'ontology', 'schema', 'temporal', 'contradiction', 'trust']) AS layer, unnest([grounding, ontology, schema_, temporal, contradiction, trust]) AS s FROM v) SELECT layer, grp, count(*) AS n, round(avg(s), 3) AS mean_score, round(min(s), 3) AS least, count(*) FILTER (WHERE s < 0.5) AS n_below, round(avg(CAST(s >= 0.5 AS INT)), 4) AS pass_half, round(avg(CAST(s >= 0.999 AS INT)), 4) AS pass_full, CAST(grouping(grp) AS INT) AS is_all FROM lg GROUP BY ROLLUP (layer, grp) HAVING layer IS NOT NULL",
    "f03_match": f"WITH p AS (SELECT DISTINCT entity AS a, value AS b FROM triples UNION ALL VALUES ('HTN', 'hypertension'), ('chest pain', 'pain'), ('red big house', 'big red house'), ('a1 b2 c3 d4 e5 f6', 'b2 a1 zz'), ('x', '')), n AS (SELECT a, b, {norm("coalesce(a, '')")} AS x, {norm("coalesce(b, '')")} AS y FROM p), f AS (SELECT *, {forms('x')} AS fx, {forms('y')} AS fy, {toks('x')} AS tx, {toks('y')} AS ty, {_form('a')} AS cx, {_form('b')} AS cy FROM n) SELECT a, b, round({score('x', 'y', 'fx', 'fy', 'tx', 'ty')}, 6) AS score, {same_concept('cx', 'cy')} AS concept FROM f",
    "j06_pairs": f"WITH {_HITS} SELECT note_id, model, text, gold, round(score, 6) AS score FROM hits",
    "e04_misses": f"WITH {_HITS}, {_MISSED} SELECT {bucket('gold')} AS bucket, count(*) AS n FROM ms GROUP BY 1",
    "e08_quality": f"WITH {_CHECK.replace('LEAST_', '4')} SELECT model, count(DISTINCT note_id) AS n_notes, (SELECT count(*) FROM notes) - count(DISTINCT note_id) AS n_empty, count(*) AS n_claims, round(count(*) / greatest(count(DISTINCT note_id), 1), 4) AS per_note, round(avg(CAST(verbatim AS INT)), 4) AS grounded, count(DISTINCT left({tidy('entity')}, 30)) AS n_heads FROM ck GROUP BY 1",
    "e07_failures": f"WITH {_CHECK.replace('LEAST_', '5')} " + " UNION ALL ".join(f"SELECT {q(n)} AS failure, count(*) AS n, list_sort(list(claim_id))[1:3] AS examples, round(count(*) / greatest((SELECT count(*) FROM ck), 1), 4) AS share FROM ck WHERE {w} HAVING count(*) > 0" for n, w in _FAIL.items()),
    "e13_pivot": f"WITH {_C} SELECT note_id, count(*) FILTER (WHERE model = 'model_a') AS model_a, count(*) FILTER (WHERE model = 'model_b') AS model_b, count(*) FILTER (WHERE model = 'model_c') AS model_c FROM c WHERE note_id IS NOT NULL GROUP BY 1",
    "e10_curve": f"WITH {_C}, p AS (SELECT note_id, count(*) AS n FROM c WHERE note_id IS NOT NULL GROUP BY 1), r AS (SELECT row_number() OVER (ORDER BY note_id) AS k, sum(n) OVER (ORDER BY note_id) AS n_claims FROM p), s AS (SELECT unnest([25, 50, 75, 100]) AS percent) SELECT percent, k AS n_notes, n_claims FROM s JOIN r ON k = ceil((SELECT count(*) FROM p) * percent / 100)",
    "c04_ece": f"WITH {_SCORED}, b AS (SELECT least(floor(score * 10), 9) AS bin, count(*) AS n, avg(score) AS m, avg(y) AS s FROM sc GROUP BY 1) SELECT round(sum(n * abs(m - s)) / sum(n), 6) AS ece FROM b",
    "c04_bins": f"WITH {_SCORED} SELECT CAST(least(floor(score * 10), 9) AS INT) AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(y), 6) AS share FROM sc GROUP BY 1",
    "c05_scores": f"WITH {_SCORED} SELECT round(avg((score - y) * (score - y)), 6) AS brier, round(avg(-(y * ln(greatest(1e-6, least(1 - 1e-6, score))) + (1 - y) * ln(1 - greatest(1e-6, least(1 - 1e-6, score))))), 6) AS nll FROM sc",
    "w05_curve": f"WITH {_CURVE} SELECT claim_id, rank, errors, round(errors / rank, 6) AS risk FROM cv",
    "c06_aurc": f"WITH {_CURVE}, l AS (SELECT errors / rank AS r, lag(errors / rank) OVER (ORDER BY rank) AS p FROM cv) SELECT round(coalesce(sum((r + p) / 2), 0) / count(*), 6) AS aurc FROM l",
    "w07_coverage": f"WITH {_CURVE}, t AS (SELECT unnest([0.2, 0.3, 0.5]) AS target) SELECT target, round(coalesce(max(rank) FILTER (WHERE 1 - errors / rank >= target), 0) / (SELECT count(*) FROM cv), 6) AS coverage FROM t CROSS JOIN cv GROUP BY target",
    "o05_held": f"WITH {_SCORED} SELECT claim_id, score FROM sc WHERE y = 0 ORDER BY score, claim_id LIMIT 14",
}

_ONLY_NOTES = _C.replace("source <> 'ehr'", "source <> 'ehr' AND note_id IS NOT NULL")
_OWNED = "CASE WHEN subject_id >= 0 THEN 's' || subject_id ELSE 'n' || {0}.note_id END AS patient"
_OK = "ok AS (SELECT *, trim(coalesce(entity, ''), ' ') AS e, trim(coalesce(value, ''), ' ') AS v FROM cl WHERE trim(coalesce(entity, ''), ' ') <> '' AND trim(coalesce(value, ''), ' ') <> '')"
_G = f"""{_ONLY_NOTES}, {_CLEAN}, {_NOTES},
cl AS (SELECT kept.*, {_OWNED.format('kept')} FROM kept LEFT JOIN notes ON notes.note_id = kept.note_id), {_OK}"""
_GT = f"""{_ONLY_NOTES}, {_CLEAN}, {_src(_GROUND, 'kept')}, {_SCHEMA.replace('FROM c)', 'FROM kept)')}, {_src(_CONTRA, 'kept')},
v0 AS (SELECT gr.*, {GROUNDING} AS grounding, {ONTOLOGY} AS ontology, ss.schema_ AS schema_, {TEMPORAL} AS temporal, coalesce(cp.s, 1.0) AS contradiction
  FROM gr JOIN ss ON skind IS NOT DISTINCT FROM kind AND sattr IS NOT DISTINCT FROM attribute LEFT JOIN (SELECT claim_id AS cclaim, s FROM cp) cp ON cclaim = gr.claim_id),
cl AS (SELECT v0.*, {_OWNED.format('v0')}, round(CAST(0 AS DOUBLE) + grounding * 0.3::DOUBLE + ontology * 0.2::DOUBLE + schema_ * 0.15::DOUBLE + temporal * 0.15::DOUBLE + contradiction * 0.2::DOUBLE, 4) AS trust FROM v0 LEFT JOIN notes ON notes.note_id = v0.note_id), {_OK}"""
_RECENCY = "CASE WHEN {0} IS NULL THEN 0.5 ELSE greatest(0, least(1, 1 - CAST(0.05 AS DOUBLE) * (2026 - {0}))) END"


def _kind(k: str) -> str:
    return f"EXISTS (SELECT 1 FROM ok z WHERE {_uri('z.e')} = {_uri('ok.e')} AND {type_c('z.kind')} = '{k}')"


_R = "r AS (SELECT triple_id AS relation_id, lower(trim(entity, ' ')) AS subject, lower(trim(attribute, ' ')) AS predicate, lower(trim(value, ' ')) AS object, fhir_type AS subject_type, temporal_start, temporal_end, note_id FROM triples WHERE coalesce(trim(entity, ' '), '') <> '' AND coalesce(trim(value, ' '), '') <> '')"
_MISSING = "IN ('', 'null', 'none')"
GRAPH = {
    "g06_depths": "WITH RECURSIVE h(c, p) AS (VALUES " + ", ".join(f"({q(c)}, {'NULL' if p is None else q(p)})" for c, p in vocab.CLASSES) + "), d(class, depth) AS (SELECT c, 0 FROM h WHERE p IS NULL UNION ALL SELECT h.c, depth + 1 FROM d JOIN h ON h.p = d.class) SELECT class, depth FROM d",
    "g07_entity_count": f"WITH {_G} SELECT count(DISTINCT {_uri('e')}) AS n_entities FROM ok",
    "g17_labels": f"WITH {_GT} SELECT lower(trim(entity, ' ')) AS node, arg_max(CAST(trust >= 0.6 AS INT), claim_id) AS label FROM cl GROUP BY 1",
    "f20_recency": "SELECT triple_id, CASE WHEN y IS NULL THEN 0.5 ELSE round(greatest(0, least(1, 1 - CAST(0.05 AS DOUBLE) * (2026 - y))), 4) END AS recency FROM (SELECT triple_id, try_cast(regexp_extract(temporal_start, '(19|20)\\d{2}', 0) AS INT) AS y FROM triples)",
    "t05_snapshot": f"WITH {_R} SELECT relation_id, subject, predicate, object FROM r WHERE (lower(coalesce(temporal_start, '')) {_MISSING} OR temporal_start <= '2018') AND (lower(coalesce(temporal_end, '')) {_MISSING} OR temporal_end > '2018')",
    "t06_about": f"WITH {_R}, rk AS (SELECT *, unnest(list_distinct([subject, object])) AS key FROM r) SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY coalesce(temporal_start, '9999'), relation_id) AS INT) AS nth, relation_id, subject, predicate, object FROM rk WHERE key IN (SELECT lower(canon_name) FROM canon_items WHERE ref_id % 10 = 0)",
    "t07_timeline": f"WITH {_R}, ch AS (SELECT subject AS cs, predicate AS cp FROM r GROUP BY 1, 2 HAVING count(DISTINCT object) > 1) SELECT subject, predicate, CAST(row_number() OVER (PARTITION BY subject, predicate ORDER BY coalesce(temporal_start, ''), object, relation_id) AS INT) AS nth, coalesce(temporal_start, '') AS temporal_start, object FROM r JOIN ch ON cs = subject AND cp = predicate",
    "t07_changes": f"WITH {_R} SELECT subject, predicate, count(*) AS n, count(DISTINCT object) AS n_objects, arg_min(object, (coalesce(temporal_start, '9999'), relation_id)) AS first_object, arg_max(object, (coalesce(temporal_start, '9999'), relation_id)) AS last_object FROM r GROUP BY 1, 2 HAVING count(DISTINCT object) > 1",
    "t08_relations": f"WITH {_R} SELECT relation_id, subject, predicate, object, subject_type FROM r",
    "t09_stats": f"WITH {_R} SELECT count(*) AS n, count(DISTINCT subject) AS n_subjects, count(DISTINCT predicate) AS n_predicates, count(temporal_start) AS n_dated FROM r",
    "t10_reified": f"WITH {_R} SELECT 'kg:r' || relation_id AS s, p, o FROM (SELECT relation_id, unnest(['rdf:subject', 'rdf:predicate', 'rdf:object', 'kg:validFrom', 'kg:validUntil']) AS p, unnest([subject, predicate, object, temporal_start, temporal_end]) AS o FROM r) WHERE o IS NOT NULL",
}
_NODES = f"""{_GT}, en AS (SELECT *, lower(trim(coalesce(entity, ''), ' ')) AS e, lower(trim(coalesce(value, ''), ' ')) AS v, {_RECENCY.format("try_cast(regexp_extract(anchor, '(19|20)[0-9][0-9]', 0) AS INT)")} AS recency FROM (SELECT * EXCLUDE (g) FROM cl)),
lo AS (SELECT claim_id, trust, coalesce(kind, 'Unknown') AS kind, e AS node, 0 AS pos FROM en WHERE length(e) > 1 UNION ALL SELECT claim_id, NULL, NULL, v, 1 FROM en WHERE length(v) > 1),
vo AS (SELECT node, kind, count(*) AS n, min((claim_id, pos)) AS seen, max(trust) AS trust FROM lo GROUP BY 1, 2),
nd AS (SELECT node, coalesce(arg_min(kind, (-n, seen)) FILTER (WHERE kind IS NOT NULL), 'Unknown') AS kind, greatest(0.5, max(trust)) AS t, min(seen) AS seen FROM vo GROUP BY 1),
ni AS (SELECT row_number() OVER (ORDER BY seen) - 1 AS node_id, * FROM nd),
ee AS (SELECT claim_id, e AS src, v AS dst, trust AS w, grounding, ontology, schema_, temporal, contradiction, recency FROM en WHERE length(e) > 1 AND length(v) > 1 AND e <> v
  UNION ALL SELECT claim_id, v, e, trust, grounding, ontology, schema_, temporal, contradiction, recency FROM en WHERE length(e) > 1 AND length(v) > 1 AND e <> v)"""
_SPREAD = f"""{_NODES},
m1 AS (SELECT dst, sum(t * w) / sum(w) AS m FROM ee JOIN ni ON node = src GROUP BY 1), n1 AS (SELECT node, 0.5::DOUBLE * t + 0.5::DOUBLE * coalesce(m, t) AS t FROM ni LEFT JOIN m1 ON dst = node),
m2 AS (SELECT dst, sum(t * w) / sum(w) AS m FROM ee JOIN n1 ON node = src GROUP BY 1), n2 AS (SELECT node, 0.5::DOUBLE * t + 0.5::DOUBLE * coalesce(m, t) AS t FROM n1 LEFT JOIN m2 ON dst = node)"""
GRAPH |= {
    "g15_nodes": f"WITH {_NODES} SELECT node_id, node, kind, round(t, 4) AS trust, seen[1] AS first_claim FROM ni",
    "g15_edges": f"WITH {_NODES} SELECT claim_id, a.node_id AS src_id, b.node_id AS dst_id, round(grounding, 4) AS grounding, round(ontology, 4) AS ontology, round(schema_, 4) AS schema, round(temporal, 4) AS temporal, round(contradiction, 4) AS contradiction, round(w, 4) AS trust, round(recency, 4) AS recency FROM ee JOIN ni a ON a.node = src JOIN ni b ON b.node = dst",
    "g16_propagated": f"WITH {_SPREAD} SELECT node, round(t, 6) AS trust FROM n2",
    "g18_mapped": f"WITH {_SPREAD} SELECT claim_id, trust, round(coalesce(t, trust), 6) AS graph_trust FROM en LEFT JOIN n2 ON node = e",
}

_concepts = "[" + items(vocab.CONCEPTS) + "]"
TEXT = {
    "w09_first_notes": "SELECT subject_id, note_id, row_id FROM notes_all WHERE subject_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY coalesce(note_time, TIMESTAMPTZ '9999-12-31 00:00:00+00'), row_id) = 1",
    "f24_negation": f"""WITH {_NOTES}, k AS (SELECT unnest({_concepts}) AS concept), p AS (SELECT note_id, concept, string_split(lower(text), concept) AS ps FROM notes CROSS JOIN k WHERE contains(lower(text), concept)),
b AS (SELECT note_id, concept, i, right(list_reduce(ps[1:i], lambda x, y: x || concept || y), 55) AS before FROM (SELECT note_id, concept, ps, unnest(range(1, len(ps))) AS i FROM p))
SELECT note_id, concept, count(*) AS n_all, count(*) FILTER (WHERE NOT regexp_matches(before, {q(vocab.NEGATION_CUES)})) AS n_positive FROM b GROUP BY 1, 2""",
    "r03_dense": """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / greatest(sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])), 1e-12), 6) AS score
FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, vec_id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s) WHERE place <= 5""",
    "r02_bm25": f"""WITH cp AS (SELECT icd9_code AS doc_id, string_split({norm('min(long_title)')}, ' ') AS ts FROM d_icd_diagnoses WHERE icd9_code IS NOT NULL GROUP BY 1),
st AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM cp), po AS (SELECT doc_id, t, count(*) AS tf, any_value(l) AS l FROM (SELECT doc_id, len(ts) AS l, unnest(ts) AS t FROM cp) GROUP BY 1, 2),
qs AS (SELECT DISTINCT ref_id AS query_id, unnest(string_split({norm('canon_name')}, ' ')) AS t FROM canon_items WHERE item_kind = 'condition'), df AS (SELECT t, count(*) AS df FROM po GROUP BY 1),
s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / mean))), 6) AS score FROM qs JOIN po USING (t) JOIN df USING (t) CROSS JOIN st GROUP BY 1, 2)
SELECT query_id, doc_id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM s WHERE score > 0) WHERE place <= 5""",
    "f22_answers": "SELECT * FROM (VALUES (0, 'B', 'maybe'), (1, 'C', 'maybe'), (2, 'D', 'maybe'), (3, 'A', 'maybe'), (4, 'C', 'maybe'), (5, 'D', 'maybe'), (6, 'A', 'no'), (7, 'A', 'yes'), (8, 'A', 'maybe'), (9, 'A', 'no'), (10, 'A', 'maybe')) t(id, letter, verdict)",
    "f21_salvage": "SELECT CAST(a AS BIGINT) AS note_id, b AS pos, c AS entity, d AS value FROM (VALUES (0, 0, 'a', '1'), (1, 0, 'b', NULL), (2, 0, 'c', NULL), (4, 0, 'e', NULL)) t(a, b, c, d)",
    "f35_props": "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, '{\"k\":' || CAST(json_extract(props, '$.k') AS INT) * 2 || '}' AS doubled FROM events",
}


def type_b(raw: str) -> str:
    key = rf"regexp_replace(lower(trim({raw})), '[\s_-]', '', 'g')"
    lines = vocab.TYPE_LINES_B
    first: dict[str, str] = {}
    for w, ty in lines:
        first.setdefault(w, ty)
    partial = " ".join(f"WHEN contains({key}, {q(w)}) OR contains({q(w)}, {key}) THEN {q(ty)}" for w, ty in lines)
    return f"CASE WHEN coalesce({raw}, '') = '' THEN 'Observation' WHEN {raw} IN ({items(vocab.CORE_TYPES)}) THEN {raw} ELSE coalesce({case(key, first)}, CASE {partial} END, 'Observation') END"


_TYPED = "tt AS (SELECT DISTINCT coalesce(fhir_type, '') AS raw, coalesce(attribute, '') AS attribute FROM triples), ty AS (SELECT raw, attribute FROM tt UNION SELECT attribute, attribute FROM tt)"
_NEG = "CASE " + " ".join(f"WHEN contains(lower(coalesce(value, '')), {q(a)}) THEN regexp_replace(coalesce(value, ''), {q(a)}, {q(b)}, 'gi')" for a, b in vocab.NEGATIONS) + " END"
_NUM1 = r"regexp_extract(coalesce(value, ''), '\d+\.?\d*', 0)"
_BANDS = f"""{_SCORED}, dv AS (SELECT * FROM sc WHERE claim_id % 2 = 0), te AS (SELECT * FROM sc WHERE claim_id % 2 = 1),
dn AS (SELECT *, row_number() OVER w AS rank, 1 - sum(1 - y) OVER w / row_number() OVER w AS prec FROM dv WINDOW w AS (ORDER BY score DESC, claim_id)),
up AS (SELECT *, row_number() OVER w AS rank, sum(y) OVER w / row_number() OVER w AS prec FROM dv WINDOW w AS (ORDER BY score, claim_id)),
lo AS (SELECT coalesce(arg_max(score, rank) FILTER (WHERE prec <= 0.15), -0.01) AS tau_low FROM up),
th AS (SELECT target, coalesce(arg_max(score, rank) FILTER (WHERE prec >= target), 1.01) AS tau_high FROM dn CROSS JOIN (SELECT unnest([0.2, 0.3, 0.5]) AS target) GROUP BY target)"""
CLAIMS |= {
    "f10_types": f"WITH {_TYPED} SELECT raw, attribute, {type_a('raw', 'attribute')} AS a, {type_b('raw')} AS b, {type_c('raw')} AS c FROM ty",
    "f27_perturbed": f"""WITH {_C}, pb AS (SELECT claim_id, kind, coalesce(value, '') AS v, {_NEG} AS neg, {_NUM1} AS num, {case("coalesce(kind, '')", vocab.TYPE_SWAPS)} AS swap FROM c),
pv AS (SELECT claim_id, 1 AS o, 'negated' AS how, neg AS value, kind FROM pb WHERE neg IS NOT NULL
  UNION ALL SELECT claim_id, 2, 'scaled', v[1:strpos(v, num) - 1] || CAST(round(CAST(rtrim(num, '.') AS DOUBLE) * (2 + claim_id % 9), 1) AS VARCHAR) || v[strpos(v, num) + length(num):], kind FROM pb WHERE num <> '' UNION ALL SELECT claim_id, 3, 'swapped', v, swap FROM pb WHERE swap IS NOT NULL)
SELECT claim_id, CAST(row_number() OVER (PARTITION BY claim_id ORDER BY o) AS INT) AS nth, how, value, kind FROM pv""",
    "v10_fused": f"""WITH {_VALID}, j AS (SELECT claim_id, note_id, trust, grounding, (claim_id % 10) / 10.0::DOUBLE AS j FROM v),
g AS (SELECT claim_id, trust, round(greatest(0, least(1, 0.25::DOUBLE * j + 0.25::DOUBLE * (1 - j) + 0.30::DOUBLE * grounding - 0.20::DOUBLE * (j / 2))), 4) AS agent, row_number() OVER (PARTITION BY note_id ORDER BY abs(trust - 0.5::DOUBLE), claim_id) AS place FROM j)
SELECT claim_id, agent, place, round(CASE WHEN place <= 50 THEN 0.4::DOUBLE * trust + 0.6::DOUBLE * agent ELSE trust END, 4) AS fused FROM g""",
    "j07_blocked": f"WITH {_HITS}, ba AS (SELECT DISTINCT note_id, a, f1, t1, unnest(t1) AS t FROM fa), bb AS (SELECT DISTINCT note_id, b, f2, t2, unnest(t2) AS t FROM fb), bp AS (SELECT DISTINCT ba.note_id, a, b, f1, f2, t1, t2 FROM ba JOIN bb ON ba.note_id = bb.note_id AND ba.t = bb.t), bs AS (SELECT note_id, a, b, round({score('a', 'b', 'f1', 'f2', 't1', 't2')}, 6) AS score FROM bp) SELECT * FROM bs WHERE score >= 0.4",
    "e01_scores": f"""WITH {_HITS}, nf AS (SELECT note_id, model, count(DISTINCT text) AS n_found FROM tx GROUP BY 1, 2), ng AS (SELECT note_id, count(DISTINCT gold) AS n_gold FROM gold GROUP BY 1),
gt AS (SELECT note_id, model, count(DISTINCT text) AS r, count(DISTINCT gold) AS c FROM hits GROUP BY 1, 2),
s AS (SELECT nf.model, coalesce(r, 0) / n_found AS p, coalesce(c, 0) / n_gold AS r FROM nf JOIN ng ON ng.note_id = nf.note_id LEFT JOIN gt ON gt.note_id = nf.note_id AND gt.model = nf.model),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM s)
SELECT model, count(*) AS k, round(avg(p), 4) AS mean_p, round(avg(r), 4) AS mean_r, round(avg(f1), 4) AS mean_f1, round(stddev_pop(f1), 4) AS sd_f1, round(avg(f1) - 1.96 * stddev_pop(f1) / sqrt(count(*)), 4) AS ci_low, round(avg(f1) + 1.96 * stddev_pop(f1) / sqrt(count(*)), 4) AS ci_high FROM f GROUP BY 1""",
    "a18_recurring": f"WITH {_HITS}, {_MISSED} SELECT {tidy('gold')} AS gold, count(DISTINCT note_id) AS n_notes FROM ms WHERE {bucket('gold')} = 'substantive' GROUP BY 1 HAVING count(DISTINCT note_id) >= 2 ORDER BY n_notes DESC, 1 LIMIT 50",
    "a18_labels": f"WITH {_HITS}, hg AS (SELECT DISTINCT note_id, gold FROM hits) SELECT label, count(*) AS n_gold, count(hg.gold) AS n_matched, round(count(hg.gold) / greatest(count(*), 1), 3) AS recall FROM gold LEFT JOIN hg ON hg.note_id = gold.note_id AND hg.gold = gold.gold GROUP BY 1",
    "e01_notes": f"WITH {_BY_NOTE} SELECT note_id, model, n_claims, n_gold, n_mentions, n_right, n_covered, n_covered_mentions, round(p, 4) AS p, round(r, 4) AS r, round(f1, 4) AS f1, round(mention_r, 4) AS mention_r, round(mention_f1, 4) AS mention_f1, round(hallucination, 4) AS hallucination FROM ns",
    "e01_models": f"WITH {_BY_NOTE} SELECT model, count(*) AS n_notes, {', '.join(f'round(avg({c}), 4) AS mean_{c}' for c in ('p', 'r', 'f1', 'mention_r', 'mention_f1', 'hallucination'))}, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in ('n_claims', 'n_gold', 'n_mentions', 'n_right', 'n_ungrounded'))} FROM ns GROUP BY 1",
    "u05_subsets": f"""WITH {_HITS}, {_CTEXTS}, kc AS (SELECT claim_id, note_id, model, (lower(trim(coalesce(entity, ''), ' ')), lower(trim(coalesce(attribute, ''), ' ')), lower(trim(coalesce(value, ''), ' '))) AS key FROM c WHERE note_id IS NOT NULL),
mk AS (SELECT DISTINCT kc.note_id, key, h.gold FROM ct JOIN kc USING (claim_id) JOIN hits h ON h.note_id = kc.note_id AND h.text = ct.text), su AS (SELECT CAST(unnest(range(1, 8)) AS INT) AS mask),
mm AS (SELECT mask, unnest(list_filter([1, 2, 4], lambda b: b & mask > 0)) AS b FROM su), bm AS (SELECT note_id, key, CASE model WHEN 'model_a' THEN 1 WHEN 'model_b' THEN 2 ELSE 4 END AS b FROM kc),
hk AS (SELECT DISTINCT mask, note_id, key FROM mm JOIN bm USING (b)), na AS (SELECT mask, note_id, count(*) AS n, count(*) FILTER (WHERE (note_id, key) IN (SELECT (note_id, key) FROM mk)) AS tp FROM hk GROUP BY 1, 2),
cv AS (SELECT mask, hk.note_id, count(DISTINCT gold) AS c FROM hk JOIN mk ON mk.note_id = hk.note_id AND mk.key = hk.key GROUP BY 1, 2), gg AS (SELECT note_id, count(*) AS g FROM gold GROUP BY 1),
x AS (SELECT su.mask, coalesce(n, 0) AS n, coalesce(tp, 0) / greatest(coalesce(n, 0), 1) AS p, coalesce(c, 0) / greatest(g, 1) AS r FROM su CROSS JOIN gg LEFT JOIN na ON na.mask = su.mask AND na.note_id = gg.note_id LEFT JOIN cv ON cv.mask = su.mask AND cv.note_id = gg.note_id),
y AS (SELECT mask, round(avg(p), 4) AS mean_p, round(avg(r), 4) AS mean_r, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 4) AS mean_f1, round(avg(n), 1) AS mean_claims, CAST(bit_count(mask) AS INT) AS n_models FROM x GROUP BY mask)
SELECT *, row_number() OVER (ORDER BY mean_f1 DESC, mean_r DESC, mask) AS place FROM y""",
    "e12_samples": f"""WITH {_HITS}, {_CTEXTS}, {_BARE}, pr AS (SELECT DISTINCT note_id, model FROM hits), hm AS (SELECT DISTINCT note_id, model, gold FROM hits),
sm AS (SELECT note_id, model, 'matched' AS kind, gold AS text, 6 AS most FROM hm UNION ALL SELECT pr.note_id, model, 'missed', gold, 6 FROM pr JOIN gold ON gold.note_id = pr.note_id WHERE NOT EXISTS (SELECT 1 FROM hm WHERE hm.note_id = pr.note_id AND hm.model = pr.model AND hm.gold = gold.gold)
  UNION ALL (SELECT DISTINCT note_id, model, 'ungrounded', left(trim(coalesce(entity, ''), ' '), 60), 4 FROM c JOIN bg USING (claim_id) WHERE NOT grounded))
SELECT note_id, model, kind, text, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY note_id, model, kind ORDER BY text) AS INT) AS place FROM sm) WHERE place <= most""",
    "e05_concepts": f"WITH {_CHART} SELECT * FROM cc",
    "e05_chart_scores": rf"""WITH {_C}, {_CHART}, hn AS (SELECT note_id, arg_min(coalesce(hadm_id, -1), row_id) AS hadm_id, lower(arg_min(coalesce(text, ''), row_id)) AS note FROM notes_all WHERE note_id IS NOT NULL GROUP BY 1),
sx AS (SELECT DISTINCT note_id, unnest([lower(trim(coalesce(entity, ''), ' ')), lower(trim(coalesce(value, ''), ' '))]) AS text FROM c WHERE note_id IS NOT NULL),
sn AS (SELECT hadm_id, text, bool_or(contains(note, text) OR len(list_filter(list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '), ' ')[1:2], lambda w: length(w) > 3), lambda w: contains(note, w))) > 0) AS seen FROM sx JOIN hn USING (note_id) WHERE length(text) > 2 AND hadm_id >= 0 GROUP BY 1, 2),
fx AS (SELECT hadm_id, text, {_form('text')} AS x FROM sn), fy AS (SELECT DISTINCT hadm_id, concept, {_form('concept')} AS y FROM cc),
pm AS (SELECT fx.hadm_id, text, concept FROM fx JOIN fy ON fx.hadm_id = fy.hadm_id WHERE {same_concept('x', 'y')}),
rt AS (SELECT hadm_id, count(DISTINCT text) AS n_right FROM pm GROUP BY 1), cd AS (SELECT cc.hadm_id, count(*) AS n_matched FROM cc WHERE EXISTS (SELECT 1 FROM pm WHERE pm.hadm_id = cc.hadm_id AND pm.concept = cc.concept) GROUP BY 1),
sa AS (SELECT hadm_id, count(*) AS n_found, count(*) FILTER (WHERE NOT seen) AS bad FROM sn GROUP BY 1), fa AS (SELECT hadm_id, count(*) AS n_facts FROM cc GROUP BY 1),
z AS (SELECT sa.hadm_id, n_found, n_facts, coalesce(n_matched, 0) AS n_matched, coalesce(n_right, 0) / n_found AS p, coalesce(n_matched, 0) / n_facts AS r, bad / n_found AS h FROM sa JOIN fa ON fa.hadm_id = sa.hadm_id LEFT JOIN rt ON rt.hadm_id = sa.hadm_id LEFT JOIN cd ON cd.hadm_id = sa.hadm_id)
SELECT hadm_id, n_found, n_facts, n_matched, round(p, 3) AS precision, round(r, 3) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 3) AS f1, round(h, 3) AS hallucination FROM z""",
    "c07_bands": f"""WITH {_BANDS} SELECT target, tau_high, tau_low, count(*) AS n, count(*) FILTER (WHERE score >= tau_high) AS n_insert, count(*) FILTER (WHERE score < tau_high AND score < tau_low) AS n_reject, count(*) FILTER (WHERE score < tau_high AND score >= tau_low) AS n_review,
round(sum(y) FILTER (WHERE score >= tau_high) / greatest(count(*) FILTER (WHERE score >= tau_high), 1), 6) AS insert_precision, count(*) FILTER (WHERE score < tau_high AND y = 0) AS n_held_wrong FROM te CROSS JOIN th CROSS JOIN lo GROUP BY ALL""",
}

_PLAIN = f""",
ba AS (SELECT *, trim(coalesce(entity, ''), ' ') AS e, trim(coalesce(value, ''), ' ') AS v, 'patient:' || url_encode({_uri('patient')}) AS pat, 'kg:' || url_encode({_uri("coalesce(entity, '')")}) AS ent, {type_c('kind')} AS tc, {code("coalesce(entity, '')")} AS cd FROM cl),
bo AS (SELECT * FROM ba WHERE e <> '' AND v <> ''),
st AS (SELECT pat AS s, 'rdf:type' AS p, 'fhir:Patient' AS o, 'uri' AS o_kind FROM ba UNION SELECT pat, 'rdfs:label', patient, 'string' FROM ba
  UNION SELECT ent, 'rdf:type', 'fhir:' || tc, 'uri' FROM bo WHERE tc IN ({items(vocab.CORE_TYPES)}) UNION SELECT ent, 'rdfs:label', e, 'string' FROM bo
  UNION SELECT ent, 'owl:sameAs', cd, 'uri' FROM bo WHERE cd IS NOT NULL UNION SELECT ent, 'kg:ontologyCode', cd, 'string' FROM bo WHERE cd IS NOT NULL
  UNION SELECT ent, CASE WHEN trim(coalesce(attribute, ''), ' ') = '' THEN 'kg:hasValue' ELSE 'kg:' || url_encode({_uri("coalesce(attribute, '')")}) END, v, CASE WHEN regexp_matches(v, '^[+-]?[0-9]+(\\.[0-9]+)?$') THEN 'float' ELSE 'string' END FROM bo
  UNION SELECT pat, 'kg:hasEntity', ent, 'uri' FROM bo UNION SELECT ent, 'kg:evidenceSpan', left(evidence, 200), 'string' FROM bo WHERE coalesce(evidence, '') <> ''
  EXTRA UNION SELECT ent, 'kg:temporalAnchor', anchor, 'string' FROM bo WHERE lower(coalesce(anchor, '')) NOT IN ('', 'null', 'none')),
en AS (SELECT s AS entity, o AS label FROM st WHERE p = 'rdfs:label' AND starts_with(s, 'kg:')), pe AS (SELECT s AS patient, o AS entity FROM st WHERE p = 'kg:hasEntity'),
pl AS (SELECT patient, pe.entity, label FROM pe JOIN en ON en.entity = pe.entity)"""
_ST = _G + _PLAIN.replace("EXTRA", "")
_STT = _GT + _PLAIN.replace("EXTRA", "UNION SELECT ent, 'kg:trustScore', printf('%.4f', trust), 'float' FROM bo UNION SELECT ent, 'kg:consensusLevel', CAST(consensus AS VARCHAR), 'string' FROM bo")


def _iri(x: str) -> str:
    from factgate.operators.rdf import PREFIXES

    out = f"{case(f"split_part({x}, ':', 1)", PREFIXES)} || substr({x}, strpos({x}, ':') + 1)"
    for raw, code_ in ((" ", "%20"), ("<", "%3C"), (">", "%3E"), ('"', "%22"), ("{", "%7B"), ("}", "%7D"), ("|", "%7C"), ("^", "%5E"), ("`", "%60"), ("\\", "%5C")):
        out = f"replace({out}, {q(raw)}, {q(code_)})"
    return f"'<' || {out} || '>'"


_LITERAL = """'"' || replace(replace(replace(replace(replace(o, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't') || '"'"""


def _class(k: str) -> str:
    return f"SELECT patient, entity, label FROM pl WHERE entity IN (SELECT s FROM st WHERE p = 'rdf:type' AND o = 'fhir:{k}')"


_NEO = f"(?i)({vocab.CANCER})"
_DRUGS = "SELECT lower(trim(canon_name, ' ')) FROM canon_items WHERE item_kind = 'drug' AND canon_name IS NOT NULL UNION SELECT lower(trim(alt_name, ' ')) FROM canon_items WHERE item_kind = 'drug' AND alt_name IS NOT NULL"
_TREATED = f"(regexp_matches(label, {q(f'(?i)({vocab.CHEMO})')}) OR lower(trim(label, ' ')) IN ({_DRUGS}))"
_BOTH = f"""{_ST}, di AS (SELECT patient, min(label) AS diagnosis FROM ({_class('Condition')}) WHERE regexp_matches(label, {q(_NEO)}) GROUP BY 1),
tr AS (SELECT patient, array_to_string(list_sort(list(DISTINCT label)), ', ') AS treatments FROM ({_class('MedicationStatement')}) WHERE {_TREATED} GROUP BY 1)"""
_USE = """r2 AS (SELECT predicate, subject, CASE """ + " ".join(f"WHEN contains(subject, {q(w)}) THEN {q(c)}" for w, c in vocab.CLASS_WORDS) + """ ELSE coalesce(subject_type, 'Resource') END AS st FROM r),
uc AS (SELECT predicate, st, count(*) AS n FROM r2 GROUP BY 1, 2), us AS (SELECT predicate, CAST(sum(n) AS BIGINT) AS n, arg_min(st, (-n, st)) AS domain, 'Value' AS range FROM uc GROUP BY 1)"""
_HOPS = """ed AS (SELECT subject AS src, object AS dst FROM r WHERE note_id IS NOT NULL), bt AS (SELECT src AS k, src, dst, dst AS nx FROM ed UNION ALL SELECT dst, src, dst, src FROM ed),
s0 AS (SELECT DISTINCT lower(canon_name) AS k FROM canon_items WHERE item_kind = 'condition' AND ref_id % 100 = 0), h1 AS (SELECT * FROM bt WHERE k IN (SELECT k FROM s0)),
s1 AS (SELECT DISTINCT nx AS k FROM h1 WHERE length(nx) >= 3 AND nx NOT IN (SELECT k FROM s0))"""
GRAPH |= {
    "g01_statements": f"WITH {_STT} SELECT * FROM st",
    "g03_merged": f"WITH {_STT}, ms AS (SELECT * FROM st UNION (VALUES " + ", ".join([f"({q('fhir:' + c)}, 'rdf:type', 'owl:Class', 'uri')" for c, _ in vocab.CLASSES] + [f"({q('fhir:' + c)}, 'rdfs:subClassOf', {q('fhir:' + p)}, 'uri')" for c, p in vocab.CLASSES if p]) + ")) SELECT p, count(*) AS n FROM ms GROUP BY 1",
    "g07_conditions": f"WITH {_ST} {_class('Condition')}",
    "g07_medications": f"WITH {_ST} {_class('MedicationStatement')}",
    "g07_procedures": f"WITH {_ST} {_class('Procedure')}",
    "g07_linked": f"WITH {_ST} SELECT s AS entity, o AS code, label FROM st JOIN en ON en.entity = s WHERE p = 'kg:ontologyCode'",
    "g07_high_trust": f"WITH {_STT} SELECT s AS entity, CAST(o AS DOUBLE) AS trust, label FROM st JOIN en ON en.entity = s WHERE p = 'kg:trustScore' AND CAST(o AS DOUBLE) >= 0.8",
    "g07_temporal": f"WITH {_ST} SELECT DISTINCT s AS entity, o AS time FROM st WHERE p = 'kg:temporalAnchor'",
    "g08_cohorts": f"WITH {_ST} SELECT count(DISTINCT patient) FILTER (WHERE regexp_matches(label, {q(_NEO)})) AS n_neoplasm, count(DISTINCT patient) FILTER (WHERE {_TREATED}) AS n_treated, count(DISTINCT patient) FILTER (WHERE entity IN (SELECT s FROM st WHERE p = 'kg:temporalAnchor')) AS n_dated FROM pl",
    "g09_summary": f"WITH {_BOTH} SELECT di.patient, diagnosis, treatments FROM di JOIN tr ON tr.patient = di.patient",
    "g09_treated": f"WITH {_BOTH} SELECT count(*) AS n_treated FROM di JOIN tr ON tr.patient = di.patient",
    "g09_most_used": f"WITH {_ST} SELECT label, count(DISTINCT patient) AS n_patients FROM ({_class('MedicationStatement')}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "g09_comorbid": f"WITH {_ST}, co AS ({_class('Condition')}) SELECT label, count(DISTINCT patient) AS n_patients FROM co WHERE NOT regexp_matches(label, {q(_NEO)}) AND patient IN (SELECT patient FROM co WHERE regexp_matches(label, {q(_NEO)})) GROUP BY 1",
    "g09_dated": f"WITH {_ST} SELECT DISTINCT patient, label, o AS time FROM pl JOIN st ON s = entity WHERE p = 'kg:temporalAnchor' AND length(o) > 3 AND NOT contains(o, 'REDACTED')",
    "g10_report": f"WITH {_STT} SELECT count(*) AS n_statements, count(DISTINCT s) AS n_subjects, count(DISTINCT p) AS n_predicates, count(DISTINCT s) FILTER (WHERE starts_with(s, 'patient:')) AS n_patients FROM st",
    "g05_usage": f"WITH {_R}, {_USE} SELECT * FROM us",
    "g05_schema": f"""WITH {_R}, {_USE}, kc(c, p) AS (VALUES {", ".join(f"({q(c)}, {'NULL' if p is None else q(p)})" for c, p in vocab.CLASSES)}),
ac AS (SELECT c, p FROM kc UNION SELECT st, 'Resource' FROM r2 WHERE st <> '' AND st NOT IN (SELECT c FROM kc) UNION SELECT 'Value', 'Resource'),
cu AS (SELECT 'kg:' || url_encode({_uri('c')}) AS s, c, 'kg:' || url_encode({_uri('p')}) AS p FROM ac), pu AS (SELECT 'kg:' || url_encode({_uri('predicate')}) AS s, * FROM us WHERE predicate <> '')
SELECT s, 'rdf:type' AS p, 'owl:Class' AS o, 'uri' AS o_kind FROM cu UNION SELECT s, 'rdfs:label', c, 'string' FROM cu UNION SELECT s, 'rdfs:subClassOf', p, 'uri' FROM cu WHERE p IS NOT NULL
UNION SELECT s, 'rdf:type', 'owl:ObjectProperty', 'uri' FROM pu UNION SELECT s, 'rdfs:label', predicate, 'string' FROM pu UNION SELECT s, 'rdfs:domain', 'kg:' || url_encode({_uri('domain')}), 'uri' FROM pu WHERE domain <> '' UNION SELECT s, 'rdfs:range', 'kg:' || url_encode({_uri('range')}), 'uri' FROM pu""",
    "f28_short": f"WITH {_ST} SELECT DISTINCT entity, left(list_last(string_split(list_last(string_split('http://kg/x#' || substr(entity, 4), '/')), '#')), 40) AS short FROM en",
    "s13_ntriples": f"WITH {_STT} SELECT concat_ws(' ', {_iri('s')}, {_iri('p')}, CASE o_kind WHEN 'uri' THEN {_iri('o')} WHEN 'float' THEN {_LITERAL} || '^^<http://www.w3.org/2001/XMLSchema#float>' ELSE {_LITERAL} END, '.') AS value FROM st",
    "o06_top_properties": f"WITH {_R}, {_USE} SELECT * FROM us ORDER BY n DESC, predicate LIMIT 15",
    "j13_two_hops": f"WITH {_R}, {_HOPS} SELECT DISTINCT src, dst, 1 AS hop FROM h1 UNION ALL SELECT DISTINCT src, dst, 2 FROM bt WHERE k IN (SELECT k FROM s1)",
}
_COS = "SELECT q.vec_id AS query_id, v.vec_id, v.label, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / greatest(sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])), 1e-12), 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0"
TEXT |= {
    "r08_options": f"""WITH s AS ({_COS}), k AS (SELECT *, row_number() OVER (PARTITION BY query_id, label % 2 ORDER BY score DESC, vec_id) AS place FROM s),
m AS (SELECT query_id, coalesce(avg(score) FILTER (WHERE label % 2 = 0), 0) AS pos, coalesce(avg(score) FILTER (WHERE label % 2 <> 0), 0) AS neg FROM k WHERE place <= 10 GROUP BY 1)
SELECT query_id, round(pos, 5) AS pos, round(neg, 5) AS neg, round(pos - neg, 5) AS margin, CASE WHEN pos - neg > 0.02 THEN 'yes' WHEN pos - neg < -0.02 THEN 'no' ELSE 'maybe' END AS decision FROM m""",
    "e09_keyword": f"""WITH f AS ({TEXT['f24_negation']}), fa AS (SELECT note_id, concept FROM f WHERE n_positive = 0), sd AS (SELECT note_id, lower(concat_ws(' ', entity, value)) AS said FROM triples WHERE source <> 'ehr' AND note_id IS NOT NULL),
av AS (SELECT * FROM fa WHERE NOT EXISTS (SELECT 1 FROM sd WHERE sd.note_id = fa.note_id AND contains(said, concept)))
SELECT concept, count(*) AS n_keyword, (SELECT count(*) FROM fa WHERE fa.concept = f.concept) AS n_false, (SELECT count(*) FROM av WHERE av.concept = f.concept) AS n_avoided FROM f GROUP BY concept""",
}
def _found(pattern: str, columns: str, source: str = "notes") -> str:
    """Every match of a pattern: note_id, m (the match), start and further columns. Offsets are the lengths before it."""
    return f"""SELECT note_id, ms[i] AS m, CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS INT) AS start, {columns}
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT note_id, string_split_regex(text, {q(pattern)}) AS ps, regexp_extract_all(text, {q(pattern)}) AS ms FROM {source} WHERE text <> chr(0)))"""


_SECTIONS = " UNION ALL ".join(_found("(?i)" + p, f"{q(n)} AS section") for n, p in vocab.SECTIONS)
_FULL_MONTH = "January|February|March|April|May|June|July|August|September|October|November|December"
_ABBR_MONTH = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
_ABS = (
    (r"\b(\d{1,2})/(\d{1,2})/(\d{2,4})\b", (3, 1, 2)), (r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b", (1, 2, 3)), (rf"(?i)\b({_FULL_MONTH})\s+(\d{{1,2}}),?\s+(\d{{4}})\b", (3, 1, 2)),
    (rf"(?i)\b({_FULL_MONTH})\s+(\d{{4}})\b", (2, 1, 0)), (rf"(?i)\b({_ABBR_MONTH})\w*\s+(\d{{1,2}}),?\s*(\d{{4}})?\b", (3, 1, 2)),
)


def _dated(pattern: str, at: tuple[int, int, int], x: str) -> str:
    """The normal form of the first match of an absolute pattern in x."""
    y, m, d = (f"regexp_extract({x}, {q(pattern)}, {i})" for i in at)
    year = f"CASE WHEN {y} = '' THEN '????' WHEN CAST({y} AS INT) < 50 THEN CAST(CAST({y} AS INT) + 2000 AS VARCHAR) WHEN CAST({y} AS INT) < 100 THEN CAST(CAST({y} AS INT) + 1900 AS VARCHAR) ELSE lpad(CAST(CAST({y} AS INT) AS VARCHAR), 4, '0') END"
    month = f"lpad(CASE WHEN regexp_matches({m}, '^[0-9]') THEN CAST(try_cast({m} AS INT) AS VARCHAR) ELSE CAST((instr('janfebmaraprmayjunjulaugsepoctnovdec', lower(substr({m}, 1, 3))) + 2) // 3 AS VARCHAR) END, 2, '0')"
    return f"{year} || '-' || {month}" + (f" || '-' || lpad(CAST(CAST({d} AS INT) AS VARCHAR), 2, '0')" if at[2] else "")


def _date_rows() -> str:
    from factgate.functions.mentions import _RELATIVE

    rows = [_found(p, f"{_dated(p, at, 'ms[i]')} AS form, 'absolute' AS kind") for p, at in _ABS]
    rows += [_found("(?i)" + p.pattern, f"ms[i] AS form, {q(n)} AS kind") for p, n in _RELATIVE]
    return " UNION ALL ".join(f"SELECT note_id, m AS raw, form, start, CAST(start + length(m) AS INT) AS stop, kind FROM ({r})" for r in rows)


def _any(ws: tuple[str, ...]) -> str:
    import re

    return f"regexp_matches(tt, {q('|'.join(re.escape(w) for w in ws))})"


_CATEGORY = f"""CASE WHEN {_any(vocab.TREATMENT_WORDS)} OR section = 'MEDICATIONS' OR (regexp_matches(tt, {q('(?:' + '|'.join(vocab.DRUG_ENDINGS) + ')$')}) AND length(tt) > 4) THEN 'TREATMENT'
  WHEN {_any(vocab.TEST_WORDS)} OR section IN ('LABS', 'IMAGING', 'PATHOLOGY') THEN 'TEST' WHEN {_any(vocab.PROBLEM_WORDS)} OR section IN ('HPI', 'ASSESSMENT', 'PMH') THEN 'PROBLEM' ELSE 'OTHER' END"""
_MENTIONS = f"""{_NOTES}, {_FOUND}, hd AS ({_SECTIONS}), ms1 AS (SELECT mt.note_id, substr(text, start + 1, length(name)) AS text, start, CAST(start + length(name) AS INT) AS stop FROM mt),
sx1 AS (SELECT ms1.*, coalesce((SELECT arg_min(section, (-hd.start, section)) FROM hd WHERE hd.note_id = ms1.note_id AND hd.start < ms1.start), 'UNKNOWN') AS section FROM ms1),
mn AS (SELECT note_id, text, start, stop, section, {_CATEGORY} AS category FROM (SELECT *, trim(lower(text), ' ') AS tt FROM sx1))"""
TEXT |= {
    "f14_sections": f"WITH {_NOTES} SELECT note_id, start, section FROM ({_SECTIONS})",
    "f17_dates": f"WITH {_NOTES} {_date_rows()}",
    "m01_mentions": f"WITH {_MENTIONS} SELECT * FROM mn",
    "f16_candidates": f"WITH {_MENTIONS}, fm AS (SELECT note_id, category, {norm('text')} AS n, min((start, text)) AS m FROM mn GROUP BY 1, 2, 3) SELECT note_id, category, count(*) AS n_mentions, array_to_string(list_transform(list_sort(list(m))[1:200], lambda x: x[2]), ', ') AS line FROM fm GROUP BY 1, 2",
    "m08_entropy": "SELECT vec_id, round(-list_sum(list_transform(p, lambda x: x * ln(x))), 5) AS entropy FROM (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM (SELECT vec_id, list_transform(embedding, lambda x: exp(x::DOUBLE)) AS e FROM embeddings))",
}
GRAPH["f18_forms"] = "SELECT triple_id, CASE " + " ".join(f"WHEN regexp_matches(temporal_start, {q(p)}) THEN {_dated(p, at, 'temporal_start')}" for p, at in _ABS) + " END AS form FROM triples WHERE temporal_start IS NOT NULL"


def _bm25(corpus: str, queries: str, k: int) -> str:
    """CTEs ending in bm(query_id, doc_id, score, place). corpus(doc_id, text), queries(query_id, text) are CTEs."""
    return f"""bc AS (SELECT doc_id, list_filter(string_split({norm("coalesce(text, '')")}, ' '), lambda w: w <> '') AS ts FROM {corpus}), bs AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM bc),
bq AS (SELECT DISTINCT query_id, unnest(list_filter(string_split({norm("coalesce(text, '')")}, ' '), lambda w: w <> '')) AS w FROM {queries}), bp AS (SELECT doc_id, l, w, count(*) AS tf FROM (SELECT doc_id, len(ts) AS l, unnest(ts) AS w FROM bc) GROUP BY ALL),
bd AS (SELECT w, count(*) AS df FROM bp GROUP BY 1), br AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / mean))), 6) AS score FROM bq JOIN bp USING (w) JOIN bd USING (w) CROSS JOIN bs GROUP BY 1, 2),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM br WHERE score > 0) WHERE place <= {k})"""


_VECTOR = "list_transform(range(0, 64), lambda d: CAST(len(list_filter(hp, lambda z: z = d)) AS DOUBLE))"
_PAIRS = "list_transform(range(1, greatest(length(t) - 1, 1) + 1), lambda i: CASE WHEN t = '' THEN -1 ELSE (unicode(substr(t, i, 1)) * 7 + CASE WHEN i < length(t) THEN unicode(substr(t, i + 1, 1)) ELSE 0 END) % 64 END)"


_ENRICHED = f"""cm AS (SELECT triple_id AS claim_id, note_id, lower(trim(coalesce(entity, ''), ' ')) AS key, trim(coalesce(entity, '') || ' ' || coalesce(value, ''), ' ') AS text, trim(coalesce(entity, ''), ' ') AS src, trim(coalesce(value, ''), ' ') AS dst FROM triples WHERE source <> 'ehr'),
ti AS (SELECT row_number() OVER (ORDER BY icd9_code) AS doc_id, min(long_title) AS text FROM d_icd_diagnoses WHERE icd9_code IS NOT NULL AND long_title IS NOT NULL GROUP BY icd9_code),
qt AS (SELECT DISTINCT text AS query_id, text FROM cm WHERE text <> ''), {_bm25('ti', 'qt', 1)},
qp AS (SELECT query_id, {_PAIRS} AS hp FROM (SELECT query_id, {norm('text')} AS t FROM qt)), tp AS (SELECT doc_id, {_PAIRS} AS hp FROM (SELECT doc_id, {norm('text')} AS t FROM ti)),
qv AS MATERIALIZED (SELECT query_id, {_VECTOR} AS q FROM qp), tv AS MATERIALIZED (SELECT doc_id, {_VECTOR} AS v FROM tp),
dn AS (SELECT query_id, round(max(list_dot_product(q, v) / greatest(sqrt(list_dot_product(q, q) * list_dot_product(v, v)), 1e-12)), 6) AS c FROM qv CROSS JOIN tv GROUP BY 1),
en0 AS (SELECT key, count(*) AS k FROM (SELECT unnest(list_distinct([lower(src), lower(dst)])) AS key FROM cm) WHERE key <> '' GROUP BY 1),
er AS (SELECT claim_id, note_id, coalesce(bm.score, 0) AS lexical, floor(c * 1000 + 1e-6) / 1000 AS dense, coalesce(k, 0) AS neighbours,
  floor(round(CASE WHEN cm.text = '' THEN 0 ELSE 0.3::DOUBLE * coalesce(bm.score, 0) / greatest(coalesce(bm.score, 0) + 1, 1) + 0.5::DOUBLE * CASE WHEN c IS NULL THEN 0 ELSE (c + 1) / 2 END + 0.2::DOUBLE * least(coalesce(k, 0) / 5, 1) END, 4) * 1000 + 1e-6) / 1000 AS score
  FROM cm LEFT JOIN bm ON bm.query_id = cm.text LEFT JOIN dn ON dn.query_id = cm.text LEFT JOIN en0 ON en0.key = cm.key)"""
_KNOW = rf"""fc AS (SELECT entity, attribute, value, min(triple_id) AS doc_id, CASE WHEN coalesce(regexp_matches(lower(value), '\b(absent|negative|denied|none|no)\b'), false) THEN '-' ELSE '+' END AS polarity FROM triples WHERE source <> 'ehr' GROUP BY 1, 2, 3),
fd AS (SELECT doc_id, left(trim(coalesce(entity, '') || ' ' || coalesce(attribute, '') || ' ' || coalesce(value, ''), ' '), 512) AS text FROM fc), fq AS (SELECT ref_id AS query_id, canon_name AS text FROM canon_items WHERE item_kind = 'condition'), {_bm25('fd', 'fq', 5)},
kn AS (SELECT query_id, string_agg('[' || polarity || '] (' || coalesce(entity, '') || ', ' || coalesce(attribute, '') || ', ' || coalesce(value, '') || ')', chr(10) ORDER BY place) AS ls, string_agg(coalesce(entity, '') || ' ' || coalesce(attribute, '') || ' ' || coalesce(value, ''), ' ' ORDER BY place) AS tx FROM bm JOIN fc USING (doc_id) GROUP BY 1)"""
TEXT |= {
    "r06_enriched": f"WITH {_ENRICHED} SELECT claim_id, lexical, dense, neighbours, score FROM er",
    "r05_fused": f"WITH {_ENRICHED} SELECT note_id, count(*) AS n, floor(avg(score) * 1000 + 1e-6) / 1000 AS mean_score FROM er WHERE note_id IS NOT NULL GROUP BY 1",
    "r07_lines": f"WITH {_KNOW} SELECT query_id, 'Medical knowledge graph:' || chr(10) || ls AS lines FROM kn",
    "r10_augmented": f"WITH {_KNOW} SELECT fq.query_id, 'A chart review.' || coalesce(' Medical knowledge: ' || tx, '') || ' Question: Is there ' || text || '?' AS prompt FROM fq LEFT JOIN kn ON kn.query_id = fq.query_id",
}
_X = f"x AS (SELECT triple_id, source, loaded_at, round(0.5::DOUBLE * {ONTOLOGY} + 0.5::DOUBLE * {TEMPORAL.replace(AS_OF, '2026-01-01')}, 4) AS trust FROM (SELECT *, fhir_type AS kind, temporal_start AS anchor FROM triples))"
STREAMS = {
    "x1_ingest": f"WITH {_X} SELECT triple_id, trust, trust >= 0.6 AS accepted FROM x",
    "x2_rates": f"WITH {_X} SELECT to_timestamp(floor(epoch(loaded_at) / 2592000) * 2592000) AT TIME ZONE 'UTC' AS start, source, count(*) AS n, count(*) FILTER (WHERE trust >= 0.6) AS n_accepted FROM x GROUP BY 1, 2 HAVING floor(epoch(min(loaded_at)) / 2592000) * 2592000 + 2592000 <= (SELECT floor(epoch(max(loaded_at)) * 1000) / 1000 - 604800 FROM triples)",
}
