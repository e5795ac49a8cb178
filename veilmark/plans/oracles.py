"""DuckDB statements equivalent to the registered queries, written independently of the Spark expressions."""

from __future__ import annotations

from ..functions import patterns as P
from ..functions import values as G
from ..operators.mapping import FORMATTED, REDRAWS
from ..operators.service import ERRORS
from ..sources.paragraphs import TEMPLATES

PARAGRAPHS = f"""lines AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
own AS (SELECT doc_id, unnest(range(0, len(l)))::INT AS paragraph_index, unnest(l) AS text FROM lines),
paras AS (SELECT doc_id::BIGINT AS doc_id, paragraph_index, text FROM own UNION ALL {TEMPLATES})"""

PHONE_OK = """(length(d) BETWEEN 7 AND 15 AND CASE WHEN regexp_matches(t, '^[^0-9+]*[+]') THEN
  CASE WHEN d LIKE '91%' THEN regexp_full_match(d, '91[6-9][0-9]{9}') WHEN d LIKE '1%' THEN regexp_full_match(d, '1[2-9][0-9]{2}[2-9][0-9]{6}')
   WHEN d LIKE '44%' THEN regexp_full_match(d, '44[1-9][0-9]{8,9}') WHEN d LIKE '61%' THEN regexp_full_match(d, '61[2-478][0-9]{8}')
   WHEN d LIKE '65%' THEN regexp_full_match(d, '65[3689][0-9]{7}') WHEN d LIKE '971%' THEN regexp_full_match(d, '971[2-9][0-9]{7,8}') ELSE length(d) BETWEEN 8 AND 15 END
  ELSE regexp_full_match(d, '[6-9][0-9]{9}|[2-9][0-9]{2}[2-9][0-9]{6}|0[1-9][0-9]{8,9}') END)"""
LUHN_OK = """(length(d) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda j:
  CASE WHEN (length(d) - j) % 2 = 0 THEN substr(d, j, 1)::INT WHEN substr(d, j, 1)::INT >= 5 THEN 2 * substr(d, j, 1)::INT - 9 ELSE 2 * substr(d, j, 1)::INT END)) % 10 = 0)"""
SSN_OK = "(substr(t, 1, 3) NOT IN ('000', '666') AND (substr(t, 1, 3) < '900' OR substr(t, 1, 3) = '987') AND substr(t, 5, 2) <> '00' AND substr(t, 8, 4) <> '0000')"
NOT_VERSION = "NOT regexp_matches(lower(substr(p, greatest(s - 9, 1), least(10, s))), 'version|v\\.?$')"
# Look-around is not available here: a maximal run of hexadecimal digits and colons stands for the pattern's edges.
IPV6_RUN = "[0-9a-fA-F:]*:[0-9a-fA-F:]*"
IPV6_OK = """(NOT regexp_matches(t, '[0-9a-fA-F]{5}|:::|^:[^:]|:$|::.*::') AND
  CASE WHEN contains(t, '::') THEN len(list_filter(string_split(t, ':'), lambda g: g <> '')) <= 7 ELSE len(list_filter(string_split(t, ':'), lambda g: g <> '')) = 8 END)"""
IP_OK = "(len(list_filter(string_split(t, '.'), lambda o: o::INT > 255 OR (length(o) > 1 AND o LIKE '0%'))) = 0)"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spans(name: str, pattern: str, where: str = "true") -> str:
    rx = _q(pattern)
    return f"""{name}_m AS (SELECT doc_id, paragraph_index, text AS p, regexp_extract_all(text, {rx}) AS m, string_split_regex(text, {rx}) AS g FROM paras WHERE regexp_matches(text, {rx}) AND {where}),
{name} AS (SELECT doc_id, paragraph_index, p, i, m[i] AS t, regexp_replace(m[i], '[^0-9]', '', 'g') AS d,
  (list_sum(list_transform(g[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:i-1], lambda z: length(z))), 0))::INT AS s
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM {name}_m))"""


HEADING = f"regexp_matches(%s, {_q('(?i)^\\s*(?:' + P.HEADINGS + ')')})"
_NAME = f"regexp_extract(t, '{P.NAME}')"
_LAYERS = {
    "email": ("EMAIL_ADDRESS", "regex_email", 1.0, P.EMAIL, "rtrim(t, '.:,;')", "true", "true"),
    "phone": ("PHONE_NUMBER", "regex_phone", 0.95, P.PHONE, "t", PHONE_OK, "true"),
    "ip": ("IP_ADDRESS", "regex_ip", 1.0, P.IPV4, "t", f"{IP_OK} AND {NOT_VERSION}", "true"),
    "ip6": ("IP_ADDRESS", "regex_ip", 1.0, IPV6_RUN, "t", f"{IPV6_OK} AND {NOT_VERSION}", "true"),
    "card": ("CREDIT_CARD", "luhn_credit_card", 1.0, P.CARD, "t", LUHN_OK, "true"),
    "ssn": ("SSN", "regex_ssn", 1.0, P.SSN, "t", SSN_OK, "true"),
    "dob": ("DATE_OF_BIRTH", "context_dob", 0.9, P.DATE, "t", f"abs(s - length(string_split_regex(p, {_q(P.DOB_KEYWORD)})[1])) <= 60", f"regexp_matches(text, {_q(P.DOB_KEYWORD)})"),
    "address": ("ADDRESS", "context_address", 0.85, P.ADDRESS, "t", "len(list_filter(string_split_regex(t, '\\s+'), lambda w: w <> '')) >= 2", f"regexp_matches(text, {_q(P.ADDRESS_KEYWORD)})"),
    "organization": ("ORGANIZATION", "corp_suffix", 0.92, P.ORGANIZATION, "t", f"NOT {HEADING % 't'}", f"NOT {HEADING % 'text'}"),
    "person": ("PERSON", "cue_person", 0.7, P.CUE_PERSON, _NAME, f"NOT {HEADING % _NAME}", f"NOT {HEADING % 'text'}"),
}


def _layer(name: str) -> tuple[str, str]:
    entity, recognizer, confidence, pattern, text, keep, where = _LAYERS[name]
    start = f"(s + length(t) - length({text}))::INT" if name == "person" else "s"  # the name stands behind its cue
    select = f"SELECT doc_id, paragraph_index, '{entity}' AS entity_type, {start} AS \"start\", ({start} + length({text}))::INT AS \"end\", {text} AS text, '{recognizer}' AS recognizer, {confidence}::DOUBLE AS confidence FROM {name} WHERE {keep}"
    return _spans(name, pattern, where), select


_RANK = "CASE entity_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in P.PRIORITY.items()) + " END"
CANDIDATES = (
    "WITH " + PARAGRAPHS + ",\n" + ",\n".join(_layer(k)[0] for k in _LAYERS) + ",\nraw AS (" + " UNION ALL ".join(_layer(k)[1] for k in _LAYERS) + """),
cut AS (SELECT *, rtrim(text, ':,;."''()[]{}') AS r FROM raw),
cand AS (SELECT doc_id, paragraph_index, entity_type, ("start" + length(r) - length(ltrim(r, '"''()[]{} ')))::INT AS "start", ("start" + length(r))::INT AS "end",
  ltrim(r, '"''()[]{} ') AS text, recognizer, confidence FROM cut WHERE regexp_matches(ltrim(r, '"''()[]{} '), '\\S'))"""
)
DETECT = CANDIDATES + f""",
packed AS (SELECT doc_id, paragraph_index, list_sort(list({{'a': {_RANK}, 'b': -confidence, 'c': "start" - "end", 's': "start", 'e': "end", 't': text, 'y': entity_type, 'r': recognizer}})) AS c FROM cand GROUP BY doc_id, paragraph_index),
kept AS (SELECT doc_id, paragraph_index, unnest(list_reduce(list_transform(c, lambda z: [z]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: x[1].s < y.e AND y.s < x[1].e)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS k FROM packed),
det AS (SELECT doc_id, paragraph_index, k.y AS entity_type, k.s AS "start", k.e AS "end", k.t AS text, k.r AS recognizer, -k.b AS confidence FROM kept),
keyed AS (SELECT *, CASE entity_type WHEN 'PERSON' THEN lower(regexp_replace(trim(text), '\\s+', ' ', 'g'))
  WHEN 'PHONE_NUMBER' THEN CASE WHEN trim(text) LIKE '+%' THEN '+' ELSE '' END || regexp_replace(text, '[^0-9]', '', 'g') ELSE lower(trim(text)) END AS normalized FROM det),
keys AS (SELECT doc_id, entity_type, normalized, min(paragraph_index::BIGINT * 100000000 + "start") AS first_at, arg_min(text, paragraph_index::BIGINT * 100000000 + "start") AS original, count(*) AS occurrences, sha256(normalized || ':' || entity_type) AS h FROM keyed GROUP BY doc_id, entity_type, normalized),
mails AS (SELECT doc_id, normalized, first_at, list_filter(string_split_regex(split_part(normalized, '@', 1), '\\W+'), lambda z: length(z) > 2) AS mw FROM keys WHERE entity_type = 'EMAIL_ADDRESS' AND split_part(normalized, '@', 1) NOT IN ({", ".join(map(repr, P.GENERIC_LOCAL_PARTS))})),
people AS (SELECT doc_id, normalized AS person, first_at AS person_at, list_filter(string_split_regex(normalized, '\\W+'), lambda z: length(z) > 2) AS pw FROM keys WHERE entity_type = 'PERSON'),
pairs AS (SELECT doc_id, normalized, first_at, person, person_at, unnest(mw) AS a, pw FROM mails JOIN people USING (doc_id)),
links AS (SELECT doc_id, normalized, min(first_at) AS mail_at, arg_min(person, (person_at, person)) AS person FROM pairs WHERE len(list_filter(pw, lambda b: a = b OR (length(a) > 3 AND contains(b, a)))) > 0 GROUP BY doc_id, normalized),
named AS (SELECT doc_id, person AS normalized, 'PERSON' AS entity_type, min(mail_at) AS mail_at FROM links GROUP BY doc_id, person),
created AS (SELECT k.*, l.person, least(k.first_at, coalesce(n.mail_at, k.first_at)) AS created_at FROM keys k LEFT JOIN links l ON k.entity_type = 'EMAIL_ADDRESS' AND l.doc_id = k.doc_id AND l.normalized = k.normalized LEFT JOIN named n ON n.entity_type = k.entity_type AND n.doc_id = k.doc_id AND n.normalized = k.normalized),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY created_at, CASE WHEN entity_type = 'PERSON' THEN 0 ELSE 1 END, entity_type, normalized) - 1)::INT AS creation_index FROM created),
p0 AS (SELECT *, (doc_id * 1000000 + paragraph_index) * 10000 + "start" AS id, (doc_id * 31 + paragraph_index * 7 + "start") % 10 AS k FROM det),
gt AS (SELECT id AS gt_id, doc_id, paragraph_index, CASE WHEN k = 2 THEN 'PERSON' ELSE entity_type END AS entity_type, "start", ("end" + CASE WHEN k = 1 THEN 1 ELSE 0 END)::INT AS "end" FROM p0 WHERE k <> 0),
matched AS (SELECT gt.*, p0.id AS pred_id FROM gt JOIN p0 USING (doc_id, paragraph_index, entity_type, "start", "end")),
miss AS (SELECT * FROM gt WHERE gt_id NOT IN (SELECT gt_id FROM matched)),
spare AS (SELECT * FROM p0 WHERE id NOT IN (SELECT pred_id FROM matched)),
wrong AS (SELECT m.gt_id, m.doc_id, m.paragraph_index, m.entity_type, arg_min(s.entity_type, s.id) AS predicted_type FROM miss m JOIN spare s ON m.doc_id = s.doc_id AND m.paragraph_index = s.paragraph_index AND s."start" < m."end" AND m."start" < s."end" GROUP BY ALL),
cats(entity_type) AS (VALUES {", ".join(f"('{c}')" for c in P.CATEGORIES)}),
counted AS (SELECT entity_type, coalesce((SELECT count(*) FROM gt WHERE gt.entity_type = cats.entity_type), 0) AS gt, coalesce((SELECT count(*) FROM p0 WHERE p0.entity_type = cats.entity_type), 0) AS pred,
  coalesce((SELECT count(*) FROM matched WHERE matched.entity_type = cats.entity_type), 0) AS tp FROM cats),
metrics AS (SELECT entity_type, gt, pred, tp, pred - tp AS fp, gt - tp AS fn FROM counted)
"""
_HEX = "list_sum(list_transform(range(0, 8), lambda j: (strpos('0123456789abcdef', substr({h}, (1 + {o} + j)::INT, 1)) - 1)::BIGINT << (4 * (7 - j))::INT))::BIGINT"


def seed(h: str, part: int = 0) -> str:
    return _HEX.format(h=h, o=8 * part)


def _pick(pool: list, n: str) -> str:
    return f"([{', '.join(repr(x) for x in pool)}])[({n} % {len(pool)} + 1)::INT]"


def _pad(n: str, width: int) -> str:
    return f"lpad(({n} % {10**width})::VARCHAR, {width}, '0')"


def _span(n: str, low: int, high: int) -> str:
    return f"({n} % {high - low + 1} + {low})::VARCHAR"


def value(kind: str, h: str, key: str = "normalized") -> str:
    a, b, c = (seed(h, k) for k in range(3))
    body = f"'4' || {_pad(a, 7)} || {_pad(b, 7)}"
    check = f"((10 - list_sum(list_transform(range(1, 16), lambda z: CASE WHEN (15 - z) % 2 = 1 THEN substr({body}, z::INT, 1)::INT WHEN substr({body}, z::INT, 1)::INT >= 5 THEN 2 * substr({body}, z::INT, 1)::INT - 9 ELSE 2 * substr({body}, z::INT, 1)::INT END)) % 10) % 10)::INT::VARCHAR"
    whole = f"({body} || {check})"
    return {
        "person": f"{_pick(G.FIRST, a)} || ' ' || {_pick(G.LAST, b)}",
        "email": f"lower({_pick(G.FIRST, a)}) || '.' || lower({_pick(G.LAST, b)}) || '@' || {_pick(['example.com', 'example.org', 'example.test'], c)}",
        "address": f"'Plot ' || {_span(a, 10, 999)} || ', Synthetic Avenue, Test City, ' || {_span(b, 100000, 999999)}",
        "ssn": f"(CASE WHEN {a} % 800 + 100 = 666 THEN 665 ELSE {a} % 800 + 100 END)::VARCHAR || '-' || {_span(b, 10, 99)} || '-' || {_span(c, 1000, 9999)}",
        "card": "'-'".join(f"substr({whole}, {1 + 4 * k}, 4) || " for k in range(4)).replace("|| '-'", "|| '-' || ").rstrip("| "),
        "dob": f"lpad({_span(a, 1, 28)}, 2, '0') || '-' || {_pick(G.MONTHS, b)} || '-' || {_span(c, 1975, 2000)}",
        "ip": f"{_pick(P.TEST_NETS, a)} || '.' || {_span(b, 1, 254)}",
        "phone": f"CASE WHEN {key} LIKE '+91%' OR regexp_full_match({key}, '[6-9][0-9]{{9}}') THEN '+91 ' || {_span(a, 6, 9)} || {_pad(b, 4)} || ' ' || {_pad(c, 5)} ELSE '+1-' || {_pick(P.AREA_CODES, a)} || '-555-' || {_pad(b, 4)} END",
        "org": f"{_pick(G.STEMS, a)} || ' ' || {_span(b, 100, 9999)} || ' ' || CASE WHEN contains({key}, 'pvt') OR contains({key}, 'ltd') THEN 'Pvt Ltd' WHEN contains({key}, 'inc') THEN 'Inc.' WHEN contains({key}, 'llp') THEN 'LLP' ELSE 'Corp' END",
    }[kind]


KINDS = {"PERSON": "person", "EMAIL_ADDRESS": "email", "PHONE_NUMBER": "phone", "ORGANIZATION": "org", "ADDRESS": "address", "SSN": "ssn", "CREDIT_CARD": "card", "DATE_OF_BIRTH": "dob", "IP_ADDRESS": "ip"}


def _drawn(h: str) -> str:
    return "CASE entity_type " + " ".join(f"WHEN '{k}' THEN {value(v, h)}" for k, v in KINDS.items()) + " END"


_TOKENS = "list_filter(string_split_regex(lower(%s), '\\W+'), lambda z: length(z) > 2)"
_GENERIC = ", ".join(map(repr, [*P.GENERIC_WORDS, "enterprise"]))
# Formats need no check here: every drawn value has its category's.
_SAFE = f"""(length(trim(replacement)) > 0 AND lower(replacement) <> lower(original) AND (entity_type NOT IN ('PERSON', 'ORGANIZATION')
  OR NOT list_has_any(list_filter({_TOKENS % "original"}, lambda z: z NOT IN ({_GENERIC})), {_TOKENS % "replacement"})))"""
_FALLBACK = """CASE entity_type WHEN 'PERSON' THEN 'Synthetic Person ' || creation_index WHEN 'ORGANIZATION' THEN 'Nexgen Solutions ' || creation_index || ' Corp' WHEN 'ADDRESS' THEN 'Plot ' || creation_index || ', Synthetic Avenue, Test City'
  WHEN 'EMAIL_ADDRESS' THEN 'contact.' || creation_index || '@example.com' WHEN 'PHONE_NUMBER' THEN '+1-212-555-' || printf('%04d', creation_index) ELSE 'SYNTHETIC_' || entity_type || '_' || creation_index END"""
_AGAIN = f"row_number() OVER (PARTITION BY doc_id, entity_type, replacement ORDER BY draws, creation_index) > 1"
_LOCAL, _DOMAIN = (f"split_part(%s, '@', {k})" for k in (1, 2))
_CANDIDATES = DETECT + f"""
, linked AS (SELECT *, CASE WHEN person IS NOT NULL THEN sha256(person || ':PERSON') END AS ph FROM ranked),
drawn AS (SELECT *, CASE WHEN person IS NOT NULL THEN lower(replace({value("person", "ph")}, ' ', '.')) || '@example.com' ELSE {_drawn("h")} END AS candidate FROM linked),
collided AS (SELECT *, row_number() OVER (PARTITION BY doc_id, entity_type, candidate ORDER BY creation_index) AS collision_rank, sha256(h || '#' || row_number() OVER (PARTITION BY doc_id, entity_type, candidate ORDER BY creation_index)) AS h2 FROM drawn)"""
MAPPED = (
    _CANDIDATES
    + f""",
r0 AS (SELECT *, CASE WHEN collision_rank > 1 THEN 1 ELSE 0 END AS draws, CASE WHEN collision_rank = 1 THEN candidate WHEN entity_type = 'PERSON' THEN candidate || ' ' || collision_rank
  WHEN entity_type = 'EMAIL_ADDRESS' THEN {_LOCAL % "candidate"} || collision_rank || '@' || {_DOMAIN % "candidate"} WHEN entity_type = 'ORGANIZATION' THEN 'Unit ' || collision_rank || ' ' || candidate ELSE {_drawn("h2")} END AS replacement FROM collided)"""
    + "".join(
        f""",
q{k} AS (SELECT *, {_AGAIN} OR NOT {_SAFE} AS again, sha256(h || '_v{k}') AS hk FROM r{k - 1}),
r{k} AS (SELECT * EXCLUDE (again, hk) REPLACE (CASE WHEN again THEN {_drawn("hk")} ELSE replacement END AS replacement, CASE WHEN again THEN {k + 1} ELSE draws END AS draws) FROM q{k})"""
        for k in range(1, REDRAWS + 1)
    )
    + f""",
fallen AS (SELECT * REPLACE (CASE WHEN {_SAFE} THEN replacement ELSE {_FALLBACK} END AS replacement) FROM r{REDRAWS}),
last AS (SELECT *, {_AGAIN} AS again FROM fallen),
mapped AS (SELECT * REPLACE (CASE WHEN NOT again THEN replacement WHEN entity_type = 'EMAIL_ADDRESS' THEN {_LOCAL % "replacement"} || '.' || creation_index || '@' || {_DOMAIN % "replacement"}
  WHEN entity_type IN ({", ".join(map(repr, FORMATTED))}) THEN {_FALLBACK} ELSE replacement || ' ' || creation_index END AS replacement) FROM last),
edits AS (SELECT k.doc_id, k.paragraph_index, list({{'s': k."start", 'e': k."end", 'v': m.replacement}} ORDER BY k."start") AS c FROM keyed k JOIN mapped m USING (doc_id, entity_type, normalized) GROUP BY ALL),
redacted AS (SELECT paras.doc_id, paras.paragraph_index, CASE WHEN c IS NULL THEN text ELSE array_to_string(list_transform(range(1, len(c) + 1), lambda i: substr(text, (CASE WHEN i = 1 THEN 0 ELSE c[i-1].e END + 1)::INT, (c[i].s - CASE WHEN i = 1 THEN 0 ELSE c[i-1].e END)::INT) || c[i].v), '') || substr(text, c[-1].e + 1) END AS redacted_text,
  coalesce(len(c), 0)::INT AS applied FROM paras LEFT JOIN edits ON paras.doc_id = edits.doc_id AND paras.paragraph_index = edits.paragraph_index),
wanted AS (SELECT doc_id, entity_type, normalized, unnest(list_distinct([lower(original), normalized])) AS needle FROM keys
  WHERE length(original) >= CASE WHEN entity_type IN ('PERSON', 'ORGANIZATION', 'ADDRESS') THEN 8 ELSE 4 END AND lower(original) NOT IN ({", ".join(map(repr, P.GENERIC_WORDS))}))
"""
)
_WHOLE = "contains(%s, needle) AND regexp_matches(%s, '(?:^|[^\\p{L}\\p{M}\\p{N}_])' || regexp_escape(needle) || '(?:$|[^\\p{L}\\p{M}\\p{N}_])')"
#: Numbers with one decimal, halves up, from a double that a tenth of a unit divides exactly.
_TENTHS = "(floor({x} * 10 + 0.5)::BIGINT // 10)::VARCHAR || '.' || (floor({x} * 10 + 0.5)::BIGINT % 10)::VARCHAR"

_RATIOS = """round(p, 4) AS "precision", round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4)::DOUBLE AS f1,
  round(CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE 0 END, 4)::DOUBLE AS exact_match_ratio"""
_PR = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END::DOUBLE AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END::DOUBLE AS r"


def oracle_sql() -> dict[str, str]:
    out = {}
    span = 'doc_id, paragraph_index, entity_type, "start", "end", text'
    for query, name in {"ipv4_spans": "ip", "ipv6_spans": "ip6"}.items():
        cte, select = _layer(name)
        out[query] = f'WITH {PARAGRAPHS}, {cte} SELECT doc_id, paragraph_index, "start", "end", text FROM ({select})'
    for query, name in {"ner_spans": "person", "email_spans": "email", "phone_valid": "phone", "card_luhn": "card", "ssn_valid": "ssn", "dob_spans": "dob", "address_spans": "address", "org_suffix_spans": "organization"}.items():
        cte, select = _layer(name)
        out[query] = f"WITH {PARAGRAPHS}, {cte} SELECT {span} FROM ({select})"
    for kind in ("person", "email", "address", "ssn", "card", "dob", "ip", "phone", "org"):
        key = "CASE c_custkey % 3 WHEN 0 THEN '+91' || (9000000000 + c_custkey) WHEN 1 THEN (7000000000 + c_custkey)::VARCHAR ELSE '+1415' || (5550000 + c_custkey) END" if kind == "phone" else "'apex ' || (['technologies pvt ltd', 'goods inc.', 'partners llp', 'labs'])[c_custkey % 4 + 1]"
        out[f"gen_{kind}"] = f"WITH k AS (SELECT c_custkey, sha256(lower(c_name) || ':X') AS h, {key} AS normalized FROM customer) SELECT c_custkey, {value(kind, 'h')} AS value FROM k"
    out["para_split"] = f"WITH {PARAGRAPHS} SELECT * FROM own"
    out["blank_filter"] = f"WITH {PARAGRAPHS} SELECT doc_id, count(*) AS paragraphs, sum(length(text))::BIGINT AS chars FROM paras WHERE regexp_matches(text, '\\S') GROUP BY doc_id"
    out["para_numbering"] = "WITH t AS (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM conversations WHERE text IS NOT NULL), u AS (SELECT conv_id AS doc_id, turn, unnest(range(0, len(l))) AS line, unnest(l) AS text FROM t) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY turn, line, text) - 1)::INT AS paragraph_index, text FROM u"
    out["docx_scan"] = f"WITH {PARAGRAPHS} SELECT * FROM own"
    counts = ", ".join(f"sum((n + {k - 1}) // {k})::BIGINT AS {name}" for name, k in (("bold", 2), ("italic", 3), ("underline", 5), ("coloured", 7)))
    out["format_stats"] = f"WITH {PARAGRAPHS}, r AS (SELECT doc_id, (length(text) + 9) // 10 AS n FROM own) SELECT doc_id, count(*) AS paragraphs, sum(n)::BIGINT AS runs, {counts} FROM r GROUP BY doc_id"
    out["phone_candidates"] = f'WITH {PARAGRAPHS}, {_layer("phone")[0]} SELECT doc_id, paragraph_index, s AS "start", (s + length(t))::INT AS "end", t AS text FROM phone WHERE length(d) BETWEEN 7 AND 15'
    out["candidate_union"] = CANDIDATES + f" SELECT {span}, recognizer FROM raw"
    out["candidate_order"] = CANDIDATES + f' SELECT doc_id, paragraph_index, (row_number() OVER (PARTITION BY doc_id, paragraph_index ORDER BY {_RANK}, -confidence, "start" - "end", "start") - 1)::INT AS place, entity_type, "start", "end" FROM cand'
    out["detect_all"] = DETECT + f"SELECT {span}, recognizer FROM det"
    out["email_person_link"] = DETECT + "SELECT doc_id, normalized, person FROM links"
    out["entity_map"] = MAPPED + "SELECT doc_id, entity_type, normalized, original, h AS seed_hash, person, creation_index, replacement FROM mapped"
    out["map_unique"] = DETECT + "SELECT entity_type, count(*) AS entities, count(*) AS replacements, count(*) AS safe FROM keys GROUP BY entity_type"
    out["replacement_safety"] = "SELECT c_custkey, c_custkey % 6 IN (3, 5) AS safe FROM customer"
    out["detect_map_join"] = DETECT + 'SELECT doc_id, entity_type, count(*) AS tasks, count(DISTINCT normalized) AS "values" FROM keyed GROUP BY doc_id, entity_type'
    out["redact_text"] = MAPPED + "SELECT * FROM redacted"
    out["docx_roundtrip"] = MAPPED + "SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY paragraph_index) - 1)::INT AS paragraph_index, redacted_text FROM redacted WHERE doc_id >= 10000000"
    out["docx_checks"] = MAPPED + f""", whole AS (SELECT doc_id, sum(applied)::INT AS applied, lower(string_agg(redacted_text, chr(10))) AS low FROM redacted WHERE doc_id >= 10000000 GROUP BY doc_id),
left_over AS (SELECT doc_id, count(DISTINCT needle) AS n FROM wanted JOIN whole USING (doc_id) WHERE {_WHOLE % ("low", "low")} GROUP BY doc_id)
SELECT doc_id, applied, 0::INT AS links, 0::INT AS fields, true AS "valid", coalesce(n, 0)::INT AS residual FROM whole LEFT JOIN left_over USING (doc_id)"""
    out["residual_semi"] = MAPPED + f""", low AS (SELECT r.doc_id, lower(CASE WHEN r.doc_id % 3 = 0 THEN p.text ELSE '' END) AS low FROM redacted r JOIN paras p ON r.doc_id = p.doc_id AND r.paragraph_index = p.paragraph_index),
masked AS (SELECT doc_id, paragraph_index, list({{'s': "start", 'e': "end", 'y': entity_type}} ORDER BY "start") AS c FROM det GROUP BY ALL),
texts AS (SELECT doc_id, low FROM low WHERE doc_id % 3 = 0 UNION ALL SELECT p.doc_id, lower(CASE WHEN c IS NULL THEN text ELSE array_to_string(list_transform(range(1, len(c) + 1), lambda i: substr(text, (CASE WHEN i = 1 THEN 0 ELSE c[i-1].e END + 1)::INT, (c[i].s - CASE WHEN i = 1 THEN 0 ELSE c[i-1].e END)::INT) || '<' || c[i].y || '>'), '') || substr(text, c[-1].e + 1) END)
  FROM paras p LEFT JOIN masked m ON p.doc_id = m.doc_id AND p.paragraph_index = m.paragraph_index WHERE p.doc_id % 3 <> 0)
SELECT DISTINCT doc_id, entity_type, normalized FROM wanted JOIN texts USING (doc_id) WHERE {_WHOLE % ("low", "low")}"""
    out["rel_left_join"] = """WITH h AS (SELECT page_id AS doc_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages), u AS (SELECT doc_id, unnest(range(0, len(l))) AS n, unnest(l) AS href FROM h)
SELECT doc_id, 'rId' || n AS rel_id, CASE WHEN n % 3 = 2 THEN '' ELSE href END AS target, CASE WHEN n % 3 = 2 THEN 'External' ELSE 'Internal' END AS target_mode, CASE WHEN n % 3 = 2 THEN 'hyperlink' ELSE 'page' END AS type FROM u"""
    out["rel_rewrite"] = MAPPED + """, targets AS (SELECT DISTINCT doc_id, CASE entity_type WHEN 'PERSON' THEN 'https://people.example/' || upper(text) || '/cv' ELSE 'mailto:' || upper(text) || '?subject=x' END AS target FROM det WHERE entity_type IN ('EMAIL_ADDRESS', 'PERSON')),
hits AS (SELECT t.doc_id, target, arg_min({'n': original, 'v': replacement}, (CASE WHEN entity_type = 'EMAIL_ADDRESS' THEN 0 ELSE 1 END, creation_index)) AS m FROM targets t JOIN mapped USING (doc_id) WHERE entity_type IN ('EMAIL_ADDRESS', 'PERSON') AND contains(lower(target), lower(original)) GROUP BY ALL)
SELECT doc_id, target, CASE WHEN starts_with(lower(target), 'mailto:') THEN 'mailto:' || m.v ELSE substr(target, 1, strpos(lower(target), lower(m.n)) - 1) || m.v || substr(target, strpos(lower(target), lower(m.n)) + length(m.n)) END AS new_target FROM hits"""
    out["field_rewrite"] = MAPPED + """, fields AS (SELECT doc_id, paragraph_index, ' HYPERLINK ' || upper(string_agg(text, ' | ' ORDER BY "start")) AS instruction FROM det GROUP BY ALL),
swaps AS (SELECT doc_id, list({'n': trim(original), 'v': trim(replacement)} ORDER BY creation_index) AS m FROM mapped WHERE length(trim(original)) >= 3 GROUP BY doc_id)
SELECT doc_id, paragraph_index, list_reduce(list_prepend({'n': '', 'v': instruction}, m), lambda acc, x: {'n': '', 'v': CASE WHEN contains(lower(acc.v), lower(x.n)) THEN regexp_replace(acc.v, regexp_escape(x.n), x.v, 'gi') ELSE acc.v END}).v AS new_instruction FROM fields JOIN swaps USING (doc_id)"""
    model = {"PERSON": ("PERSON", "model_person", 0.88, ["Rohan Dey", "Omar Reyes"]), "ORG": ("ORGANIZATION", "model_org", 0.85, ["Apex1"]), "GPE": ("ADDRESS", "model_loc", 0.75, ["Mahatma Gandhi"])}
    parts = [(f"m{k}", entity, recognizer, confidence, r"\b(?:" + "|".join(words) + r")\b") for k, (entity, recognizer, confidence, words) in enumerate(model.values())]
    out["model_entities"] = f"WITH paras AS (SELECT doc_id::BIGINT AS doc_id, paragraph_index, text FROM ({TEMPLATES})), " + ", ".join(_spans(name, pattern, f"NOT {HEADING % 'text'}") for name, *_, pattern in parts) + " " + " UNION ALL ".join(f"""SELECT doc_id, paragraph_index, '{entity}' AS entity_type, s AS "start", (s + length(t))::INT AS "end", t AS text, '{recognizer}' AS recognizer, {confidence}::DOUBLE AS confidence FROM {name}""" for name, entity, recognizer, confidence, _ in parts)
    out["replaced_estimate"] = DETECT + "SELECT entity_type, count(*) AS n, floor(count(*)::DOUBLE / (SELECT count(*) FROM det) * 1000 + 0.5)::BIGINT AS estimated FROM det GROUP BY entity_type"
    out["fp_fn_maps"] = DETECT + "SELECT 'fp' AS side, entity_type, fp AS n FROM metrics WHERE fp > 0 UNION ALL SELECT 'fn', entity_type, fn FROM metrics WHERE fn > 0"
    out["gt_bounds"] = f"WITH {PARAGRAPHS} SELECT doc_id, count(*) FILTER (paragraph_index % 4 - 1 >= 0 AND paragraph_index % 4 - 1 < paragraph_index % 50 AND paragraph_index % 50 <= length(text)) AS inside, count(*) AS annotations FROM own GROUP BY doc_id"
    out["gt_lookup"] = "SELECT page_id, CASE WHEN page_id % 100 % 7 = 0 THEN 'truth/' || (page_id % 100) || '.json' END AS truth_path FROM pages"
    out["token_format"] = "SELECT c_custkey, c_custkey % 3 = 0 AS good FROM customer"
    scaled = "(o_orderkey * 977) / pow(1024.0, k)"
    out["display_forms"] = f"""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey * 977 >= 1073741824 THEN 3 WHEN o_orderkey * 977 >= 1048576 THEN 2 WHEN o_orderkey * 977 >= 1024 THEN 1 ELSE 0 END AS k FROM orders)
SELECT o_orderkey, regexp_replace({_TENTHS.format(x=scaled)}, '[.]0$', '') || ' ' || (['Bytes', 'KB', 'MB', 'GB'])[k + 1] AS size, CASE WHEN o_orderkey % 7 > 0 THEN {_TENTHS.format(x="(o_orderkey % 1000) / 1024.0::DOUBLE * 100")} || '%' ELSE 'N/A' END AS share FROM o"""
    out["error_map"] = "SELECT status::INT AS status, body FROM (VALUES (200, NULL), " + ", ".join(f"""({k}, '{{"error":"{e}","message":"{m}"}}')""" for k, (e, m) in ERRORS.items()) + ") t(status, body)"
    out["span_trim"] = CANDIDATES + f" SELECT {span} FROM cand"
    out["resolve_overlaps"] = DETECT + f"SELECT {span}, recognizer, confidence FROM det"
    out["counts_present"] = DETECT + "SELECT entity_type, count(*) AS n FROM det GROUP BY entity_type"
    out["counts_zero_filled"] = DETECT + "SELECT entity_type, count(det.doc_id) AS n FROM cats LEFT JOIN det USING (entity_type) GROUP BY entity_type"
    out["unique_entities"] = DETECT + "SELECT entity_type, count(DISTINCT normalized) AS entities FROM keyed GROUP BY entity_type"
    out["normalize_keys"] = DETECT + "SELECT DISTINCT entity_type, text, normalized FROM keyed"
    out["seed_hash"] = DETECT + f", u AS (SELECT DISTINCT entity_type, normalized, h FROM keys) SELECT entity_type, normalized, h AS seed_hash, {seed('h')} AS seed FROM u"
    out["creation_index"] = DETECT + "SELECT doc_id, entity_type, normalized, creation_index, occurrences FROM ranked"
    out["collision_rank"] = _CANDIDATES + " SELECT doc_id, entity_type, normalized, candidate, collision_rank FROM collided"
    out["mask_text"] = DETECT + """, cuts AS (SELECT doc_id, paragraph_index, list({'s': "start", 'e': "end", 'y': entity_type} ORDER BY "start") AS c, count(*)::INT AS applied FROM det GROUP BY ALL)
SELECT doc_id, paragraph_index, array_to_string(list_transform(range(1, len(c) + 1), lambda i: substr(text, (CASE WHEN i = 1 THEN 0 ELSE c[i-1].e END + 1)::INT, (c[i].s - CASE WHEN i = 1 THEN 0 ELSE c[i-1].e END)::INT) || '<' || c[i].y || '>'), '') || substr(text, c[-1].e + 1) AS redacted_text, applied
FROM cuts JOIN paras USING (doc_id, paragraph_index)"""
    out["applied_counts"] = DETECT + "SELECT count(*)::BIGINT AS applied, count(DISTINCT (doc_id, paragraph_index)) AS paragraphs, true AS consistent FROM det"
    out["gt_exact_match"] = DETECT + "SELECT entity_type, count(*) AS tp FROM matched GROUP BY entity_type"
    out["category_metrics"] = DETECT + f"SELECT entity_type, gt, pred, tp, fp, fn, {_RATIOS} FROM (SELECT *, {_PR} FROM metrics)"
    out["micro_macro"] = DETECT + f""", each AS (SELECT *, {_RATIOS} FROM (SELECT *, {_PR} FROM metrics) WHERE gt > 0 OR pred > 0),
macro AS (SELECT round(avg("precision"), 4) AS macro_precision, round(avg(recall), 4) AS macro_recall, round(avg(f1), 4) AS macro_f1 FROM each),
total AS (SELECT sum(gt)::BIGINT AS gt, sum(pred)::BIGINT AS pred, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM metrics)
SELECT gt, pred, tp, fp, fn, {_RATIOS}, macro.* FROM (SELECT *, {_PR} FROM total), macro"""
    out["error_mismatch"] = DETECT + "SELECT doc_id, paragraph_index, entity_type, predicted_type, CASE WHEN predicted_type <> entity_type THEN 'type' ELSE 'boundary' END AS kind FROM wrong"
    out["error_fp_anti"] = DETECT + 'SELECT doc_id, paragraph_index, entity_type, "start", "end" FROM spare s WHERE NOT EXISTS (SELECT 1 FROM wrong w WHERE w.doc_id = s.doc_id AND w.paragraph_index = s.paragraph_index)'
    out["audit_projection"] = DETECT + "SELECT entity_type AS category, paragraph_index, CASE WHEN doc_id >= 10000000 THEN 'table' ELSE 'body' END AS location_type, recognizer FROM det"
    out["span_to_runs"] = DETECT + 'SELECT doc_id, paragraph_index, "start", ("start" // 10)::INT AS first_run, (("end" - 1) // 10 - "start" // 10 + 1)::INT AS runs FROM det'
    out["run_offsets"] = f"""WITH {PARAGRAPHS}, r AS (SELECT doc_id, paragraph_index, regexp_extract_all(text, '[^ ]+|[ ]+') AS m FROM paras), u AS (SELECT doc_id, paragraph_index, unnest(range(0, len(m)))::INT AS run_index, unnest(m) AS t FROM r)
SELECT doc_id, paragraph_index, run_index, coalesce(sum(length(t)) OVER (PARTITION BY doc_id, paragraph_index ORDER BY run_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start_offset, sum(length(t)) OVER (PARTITION BY doc_id, paragraph_index ORDER BY run_index)::INT AS end_offset FROM u"""
    out["ip_version_filter"] = f"WITH {PARAGRAPHS}, {_layer('ip')[0]}, k AS ({_layer('ip')[1]}) SELECT doc_id, paragraph_index, (SELECT count(*) FROM k WHERE k.doc_id = ip_m.doc_id AND k.paragraph_index = ip_m.paragraph_index)::INT AS kept FROM ip_m"
    out["file_gate"] = "SELECT page_id, CASE WHEN k = 3 THEN 400 WHEN n > 3000 THEN 413 WHEN n = 0 THEN 400 WHEN k = 2 THEN 400 ELSE 200 END::INT AS status FROM (SELECT page_id, page_id % 5 AS k, CASE page_id % 5 WHEN 1 THEN 0 WHEN 2 THEN strlen(html) ELSE 4 + strlen(coalesce(html, '')) END AS n FROM pages)"
    out["content_sha"] = "SELECT doc_id, sha256(text) AS sha FROM documents"
    out["ttl_filter"] = "SELECT event_id FROM events WHERE floor(epoch(TIMESTAMP '2024-01-01 06:00:00')) - floor(epoch(ts)) <= 600"
    out["filename_sanitize"] = r"SELECT page_id, CASE WHEN contains(url, '..') OR contains(url, '/') OR contains(url, '\') THEN regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g') ELSE url END AS name, 'redacted_' || string_split(url, '/')[-1] AS safe_name FROM pages"
    out["service_info"] = "SELECT 'Veilmark' AS name, '1.0.0' AS version, '.docx' AS supported_file_type, place::INT AS place, category FROM (VALUES " + ", ".join(f"({k}, '{c}')" for k, c in enumerate(P.CATEGORIES)) + ") t(place, category)"
    return out
