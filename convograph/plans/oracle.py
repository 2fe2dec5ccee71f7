"""SQL (DuckDB) that the core's queries are checked against."""

from __future__ import annotations

from convograph import config
from convograph.operators.terms import PHRASE_STOPS

_WS = r"[\t\n\x0B\f\r \x{85}\p{Z}]"


def _sub(x: str, pattern: str, by: str = "''") -> str:
    return f"regexp_replace({x}, '{pattern}', {by}, 'g')"


def _strip(x: str) -> str:
    return _sub(x, f"^{_WS}+|{_WS}+$")


def _node(x: str) -> str:
    return f"lower({_sub(_sub(_strip(x), _WS + '+', chr(39) + '_' + chr(39)), '[^a-zA-Z0-9_]')})"


def _spaced(x: str) -> str:
    return _sub(_strip(x), _WS + "+", "' '")


def _not_blank(x: str) -> str:
    return f"regexp_matches({x}, '[^{_WS[1:-1]}]')"


def _list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_DOCS = "d AS (SELECT doc_id, path, text FROM documents WHERE text IS NOT NULL)"
_SENT = f"string_split(regexp_replace(text, '([.!?]){_WS}+', '\\1' || chr(1), 'g'), chr(1))"
_EDGE = f"list_distinct(list_transform(regexp_extract_all(text, '{config.EDGE_LINK}', 1), lambda x: lower({_strip('x')})))"
_REL = f"list_distinct(list_transform(regexp_extract_all(text, '{config.RELATION_LINK}', 1), lambda x: {_sub('lower(' + _strip('x') + ')', _WS + '+', chr(39) + '_' + chr(39))}))"
_CHUNK = f"list_distinct(regexp_extract_all(text, '{config.CHUNK_LINK}', 1))"



def _units(key: str) -> str:
    return f"""p AS (SELECT {key}, string_split(text, chr(10) || chr(10)) AS u FROM d),
s AS (SELECT {key}, {_SENT} AS u FROM d),
units AS (
  SELECT {key}, 'paragraph' AS context, CAST(i - 1 AS INTEGER) AS unit, u[i] AS text FROM (SELECT {key}, u, unnest(range(1, len(u) + 1)) AS i FROM p)
  UNION ALL
  SELECT {key}, 'sentence', CAST(i - 1 AS INTEGER), u[i] FROM (SELECT {key}, u, unnest(range(1, len(u) + 1)) AS i FROM s))"""


_UNITS = f"{_DOCS}, {_units('doc_id')}"
_CHUNK_TEXTS = "d AS (SELECT row_id, text FROM chunks WHERE text IS NOT NULL)"
_PAIRS = f"""{_CHUNK_TEXTS}, {_units('row_id')},
n AS (SELECT row_id, context, unit, unnest({_EDGE}) AS node FROM units WHERE text LIKE '%[[%'),
pairs AS (
  SELECT x.row_id, x.context, x.unit, x.node AS source, y.node AS target,
    CAST(CASE x.context WHEN 'sentence' THEN 5 WHEN 'paragraph' THEN 2 ELSE 1 END AS BIGINT) AS weight
  FROM n x JOIN n y ON x.row_id = y.row_id AND x.context = y.context AND x.unit = y.unit AND x.node < y.node)"""

_EDGES = f"""{_PAIRS},
e AS (SELECT source, target, CAST(sum(weight) AS BIGINT) AS weight, array_to_string(list_sort(list(DISTINCT context)), ',') AS contexts FROM pairs GROUP BY 1, 2)"""

_ADJ = f"""{_EDGES},
both_ways AS (SELECT source AS node, target AS neighbor, weight FROM e UNION ALL SELECT target, source, weight FROM e),
adj AS (SELECT node, neighbor, CAST(row_number() OVER (PARTITION BY node ORDER BY weight DESC, neighbor) AS INTEGER) AS ord, weight FROM both_ways)"""

_TOKENS = f"""{_DOCS},
t AS (SELECT DISTINCT token FROM (SELECT unnest(string_split({_sub('text', _WS + '+', 'chr(1)')}, chr(1))) AS token FROM d) WHERE token <> '')"""

_TRIGGERS = " UNION ALL ".join(f"SELECT '{r}' AS relation, '{t}' AS trig" for r, ts in config.RELATION_TRIGGERS.items() for t in ts)
_RELATIONS = f"""c AS (SELECT row_id, text FROM chunks WHERE text IS NOT NULL),
s0 AS (SELECT row_id, {_SENT} AS u FROM c),
s1 AS (SELECT row_id, CAST(i - 1 AS INTEGER) AS sentence, u[i] AS text FROM (SELECT row_id, u, unnest(range(1, len(u) + 1)) AS i FROM s0)),
m AS (SELECT row_id, sentence, text, list_transform(regexp_extract_all(text, '{config.RELATION_LINK}', 1), lambda x: {_sub('lower(' + _strip('x') + ')', _WS + '+', chr(39) + '_' + chr(39))}) AS ns FROM s1 WHERE text LIKE '%[[%'),
f AS (SELECT row_id, sentence, node, min(pos) AS pos FROM (SELECT row_id, sentence, unnest(ns) AS node, unnest(range(len(ns))) AS pos FROM m) GROUP BY 1, 2, 3),
trig AS ({_TRIGGERS}),
hit AS (SELECT DISTINCT row_id, sentence, relation FROM m JOIN trig ON contains(lower(text), trig)),
matches AS (
  SELECT x.row_id, x.sentence, x.node AS source, hit.relation, y.node AS target
  FROM f x JOIN f y ON x.row_id = y.row_id AND x.sentence = y.sentence AND x.pos < y.pos
  JOIN hit ON hit.row_id = x.row_id AND hit.sentence = x.sentence WHERE x.node <> '' AND y.node <> '')"""

_SECTIONS = f"""{_DOCS},
cut AS (SELECT doc_id, path, text, list_filter(string_split(regexp_replace(text, '(?m)^(##{_WS})', chr(1) || '\\1', 'g'), chr(1)), lambda p: regexp_matches(p, '^##{_WS}')) AS ps FROM d),
sec AS (SELECT doc_id, path, list_filter(list_transform(CASE WHEN len(ps) > 0 THEN ps ELSE [text] END, lambda p: {_strip('p')}), lambda p: p <> '') AS ss FROM cut),
sections AS (SELECT doc_id, path, i AS n, ss[i] AS s FROM (SELECT doc_id, path, ss, unnest(range(1, len(ss) + 1)) AS i FROM sec))"""


def _chunks(most: int) -> str:
    return f"""{_SECTIONS},
big AS (SELECT doc_id, n, string_split(s, chr(10) || chr(10)) AS ps FROM sections WHERE length(s) > {most}),
fold AS (
  SELECT doc_id, n, ps, 0 AS i, CAST([] AS VARCHAR[]) AS o, '' AS cur FROM big
  UNION ALL
  SELECT doc_id, n, ps, i + 1,
    CASE WHEN length(cur) + length(ps[i + 1]) + 2 <= {most} OR cur = '' THEN o ELSE list_append(o, cur) END,
    CASE WHEN length(cur) + length(ps[i + 1]) + 2 <= {most} THEN cur || CASE WHEN cur <> '' THEN chr(10) || chr(10) ELSE '' END || ps[i + 1] ELSE ps[i + 1] END
  FROM fold WHERE i < len(ps)),
packed AS (SELECT doc_id, n, CASE WHEN cur <> '' THEN list_append(o, cur) ELSE o END AS o FROM fold WHERE i = len(ps)),
parts AS (
  SELECT doc_id, path, n, 1 AS k, s AS text FROM sections WHERE length(s) <= {most}
  UNION ALL
  SELECT b.doc_id, b.path, b.n, u.k, u.text FROM sections b JOIN (SELECT doc_id, n, k, o[k] AS text FROM (SELECT doc_id, n, o, unnest(range(1, len(o) + 1)) AS k FROM packed)) u ON u.doc_id = b.doc_id AND u.n = b.n),
made AS (
  SELECT path || '#' || doc_id AS path, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n, k) - 1 AS INTEGER) AS ord, text FROM parts)"""


_LAST = "last AS (SELECT * FROM (SELECT id, batch_id, row_id, text, links, hash, row_number() OVER (PARTITION BY id ORDER BY batch_id DESC, row_id DESC) AS rn FROM chunks WHERE id IS NOT NULL) WHERE rn = 1)"
_POST = f"{_LAST}, post AS (SELECT DISTINCT entity, id FROM (SELECT id, unnest(links) AS entity FROM last) WHERE entity IS NOT NULL)"
_DOT = "round(list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda z: z[1] * z[2])), 6)"
_TOPK = f"""sc AS (SELECT a.vec_id AS query, b.vec_id AS id, {_DOT} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0),
tk AS (SELECT * FROM (SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS rank, id, score FROM sc) WHERE rank <= 10)"""
_HITS = f"{_TOPK}, hits AS (SELECT query, c.id, min(rank) AS rank FROM tk JOIN chunks c ON c.row_id = tk.id GROUP BY 1, 2)"

_CAND = f"{_DOCS}, cand AS (SELECT doc_id, unnest(range(len(m))) AS pos, unnest(m) AS surface FROM (SELECT doc_id, regexp_extract_all(text, '{config.EDGE_LINK}', 1) AS m FROM d))"


def _scored(name: str, points: int, least: int, most: int) -> str:
    return f"""{name} AS (SELECT * FROM (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, first, surface) AS INTEGER) AS ord, surface AS display, {_node('surface')} AS node, score
  FROM (SELECT doc_id, surface, CAST(sum({points}) AS BIGINT) AS score, min(pos) AS first FROM cand GROUP BY 1, 2) WHERE score >= {least}) WHERE ord <= {most})"""


_TERMS = f"""{_CAND}, {_scored('topics', 1, 2, 25)}, {_scored('ents', 2, 2, 50)},
terms AS (SELECT doc_id, kind, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k, ord) AS INTEGER) AS ord, display, node FROM (
  SELECT doc_id, 'topic' AS kind, 0 AS k, ord, display, node FROM topics UNION ALL SELECT doc_id, 'entity', 1, ord, display, node FROM ents))"""
_LINE = "'- [[conversations/' || string_split(path, '/')[-2] || '/' || regexp_replace(string_split(path, '/')[-1], '\\.md$', '') || ']]'"
_PAGES = f"""{_TERMS},
pages AS (SELECT kind, {_strip(_sub('node', '[<>:"/\\\\|?*]'))} AS node, arg_min(display, doc_id * 1000 + ord) AS display FROM terms GROUP BY 1, 2),
kinds AS (SELECT node, min(kind) AS page_kind FROM pages GROUP BY 1),
said AS (SELECT DISTINCT node, {_LINE} AS line, doc_id FROM terms JOIN d USING (doc_id)),
mentions AS (SELECT DISTINCT page_kind, node, line FROM said JOIN kinds USING (node))"""

_ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?(?:Z|[+-]\d{2}(?::?\d{2})?)?)?$"


def _iso(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '{_ISO}') AND try_cast(left({x}, 10) AS DATE) IS NOT NULL THEN left({x}, 10) ELSE 'unknown-date' END"


def _epoch(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL AND {x} <> 0 AND {x} > -62135596800 AND {x} < 253402300800 THEN strftime(make_timestamp(CAST(floor({x}) AS BIGINT) * 1000000), '%Y-%m-%d') ELSE 'unknown-date' END"


_GPT_NODES = "g AS (SELECT row_id, account_id, create_time, e.key AS rec_id, e.value.message AS m, i AS pos FROM (SELECT row_id, account_id, create_time, unnest(map_entries(mapping)) AS e, unnest(range(len(map_entries(mapping)))) AS i FROM chatgpt_export))"
_GPT_TEXT = f"coalesce({_strip('array_to_string(list_filter(m.content.parts, lambda p: p IS NOT NULL AND ' + _not_blank('p') + '), chr(10) || chr(10))')}, '')"
_CL = "cl AS (SELECT row_id, account_id, created_at, name, unnest(chat_messages) AS m, unnest(range(len(chat_messages))) AS pos FROM claude_export)"
_CL_TEXT = f"coalesce({_strip('array_to_string(list_transform(list_filter(m.content, lambda b: b.type = ' + chr(39) + 'text' + chr(39) + ' AND b.text IS NOT NULL AND ' + _not_blank('b.text') + '), lambda b: b.text), chr(10) || chr(10))')}, '')"
_CL_MD = (
    "coalesce("
    + _strip(
        "array_to_string(list_filter(list_transform(m.content, lambda b: CASE WHEN b.type = 'text' AND b.text IS NOT NULL AND " + _not_blank("b.text")
        + " THEN b.text WHEN b.type = 'thinking' AND b.thinking IS NOT NULL AND " + _not_blank("b.thinking")
        + " THEN chr(10) || '> Claude Thinking' || chr(10) || '>' || chr(10) || '> ' || b.thinking || chr(10) END), lambda t: t IS NOT NULL), chr(10) || chr(10))"
    )
    + ", '')"
)
_SES = f"""se AS (
  SELECT line_id, path, line_no, json_extract_string(line, '$.type') AS kind, json_extract_string(line, '$.timestamp') AS stamp,
    coalesce({_strip("CASE json_type(line, '$.message.content') WHEN 'VARCHAR' THEN json_extract_string(line, '$.message.content') ELSE array_to_string(list_transform(list_filter(CAST(json_extract(line, '$.message.content') AS JSON[]), lambda b: json_extract_string(b, '$.type') = 'text' AND " + _not_blank("json_extract_string(b, '$.text')") + "), lambda b: json_extract_string(b, '$.text')), chr(10) || chr(10)) END")}, '') AS text
  FROM session_lines WHERE json_valid(line)),
sm AS (SELECT DISTINCT path, line_no, kind AS role, text, coalesce(stamp, '') AS stamp FROM se WHERE kind IN ('user', 'assistant') AND text <> '' AND NOT list_contains(string_split(path, '/'), 'subagents'))"""
_NL = "chr(10)"
_BLOCK = f"CASE WHEN role = 'user' THEN {_NL} || '## Prompt' || {_NL} ELSE {_NL} || '## Response' || {_NL} END || {_NL} || text || {_NL} || {_NL} || '### Timestamp' || {_NL} || {_NL} || stamp"
_SBLOCK = _BLOCK.replace("|| stamp", "|| sm.stamp").replace("|| text ||", "|| sm.text ||")
_SDOC = f"""{_SES},
first AS (SELECT path, arg_min(stamp, line_no) AS stamp FROM sm GROUP BY 1),
sdoc AS (
  SELECT sm.path, {_iso('any_value(first.stamp)')} AS date, string_split(sm.path, '/')[-2] AS project, regexp_replace(string_split(sm.path, '/')[-1], '\\.[^.]*$', '') AS session,
    string_agg({_SBLOCK}, {_NL} ORDER BY line_no, {_SBLOCK}) AS body
  FROM sm JOIN first USING (path) GROUP BY sm.path)"""

_DAY = """SELECT account_id, date, hash, 'conversations/{p}/{p}_' || date || '_' || hash || '.md' AS path,
  '---' || chr(10) || 'platform: {p}' || chr(10) || 'date: ' || date || chr(10) || 'hash: ' || hash || chr(10) || '---' || chr(10) || chr(10) || '# {l} Export - ' || date || chr(10) || chr(10) || txt AS text
FROM (SELECT account_id, date, left(sha256(coalesce(string_agg(body, '' ORDER BY o1, o2, o3, o4, o5, o6), '')), 6) AS hash, string_agg(text, chr(10) ORDER BY o1, o2, o3, o4, o5, o6) AS txt FROM pieces GROUP BY 1, 2) q"""
_HEAD = "chr(10) || '---' || chr(10) || chr(10) || '# ' || {t} || chr(10)"
_EPOCH_ISO = "CASE WHEN m.create_time > -62135596800 AND m.create_time < 253402300800 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime(ts, '%f') = '000000' THEN '' ELSE '.' || strftime(ts, '%f') END ELSE '' END"
_TS = "make_timestamp(CASE WHEN m.create_time > -62135596800 AND m.create_time < 253402300800 THEN CAST(trunc(CAST(m.create_time AS DOUBLE) * 1000000) AS BIGINT) END)"
_GPT_DAYS = f"""{_GPT_NODES},
gm AS (SELECT account_id, {_epoch('create_time')} AS date, '' AS o1, coalesce(create_time, 0) AS o2, row_id AS o3, '1' AS o4, m.create_time AS o5, pos AS o6, m.author.role AS role, CASE WHEN m.content.content_type = 'text' THEN {_GPT_TEXT} END AS text, {_EPOCH_ISO} AS stamp
  FROM (SELECT *, {_TS} AS ts FROM g) g WHERE m IS NOT NULL AND m.create_time IS NOT NULL AND m.author.role IN ('user', 'assistant')),
pieces AS (
  SELECT account_id, {_epoch('create_time')} AS date, '' AS o1, coalesce(create_time, 0) AS o2, row_id AS o3, '0' AS o4, 0.0 AS o5, -1 AS o6, {_HEAD.format(t="coalesce(title, 'untitled')")} AS text, CAST(NULL AS VARCHAR) AS body FROM chatgpt_export
  UNION ALL SELECT account_id, date, o1, o2, o3, o4, o5, o6, {_BLOCK}, text FROM gm WHERE text <> '')"""
_CL_DAYS = f"""{_CL},
cm AS (SELECT account_id, {_iso("coalesce(created_at, '')")} AS date, coalesce(created_at, '') AS o1, 0.0 AS o2, row_id AS o3, coalesce(m.created_at, '') AS o4, 1.0 AS o5, pos AS o6, CASE WHEN m.sender = 'human' THEN 'user' ELSE 'assistant' END AS role, {_CL_MD} AS text, coalesce(m.created_at, '') AS stamp FROM cl WHERE m IS NOT NULL),
pieces AS (
  SELECT account_id, {_iso("coalesce(created_at, '')")} AS date, coalesce(created_at, '') AS o1, 0.0 AS o2, row_id AS o3, '' AS o4, 0.0 AS o5, -1 AS o6, {_HEAD.format(t="CASE WHEN name <> '' THEN name ELSE 'untitled' END")} AS text, CAST(NULL AS VARCHAR) AS body FROM claude_export
  UNION ALL SELECT account_id, date, o1, o2, o3, o4, o5, o6, {_BLOCK}, text FROM cm WHERE text <> '')"""

_CLEAN = _sub(_sub(_sub(_sub("text", r"\[\[.*?\]\]"), "(?s)```.*?```"), "`.*?`"), rf"https?://[^{_WS[1:-1]}]+")
_CLEAN_TOPIC = _sub(_sub(_sub(_sub(_sub(_sub("text", r"\[\[.*?\]\]"), "(?s)```.*?```"), "`.*?`"), "import .*"), "from .* import .*"), rf"https?://[^{_WS[1:-1]}]+")
_FILE = _sub("token", '[<>:"/\\\\|?*]')
_SPECIAL = "[" + "".join("\\" + c for c in config.TOPIC_FORBIDDEN) + "]"

_CLEAN_TOPIC_ALL = _spaced(_sub(_CLEAN_TOPIC, "[#>*_`-]", "' '"))
_WORDCHARS = r"\p{L}\p{M}\p{N}_"


def _title(x: str) -> str:
    """Python's title case; letters whose upper case is several are listed."""
    return (
        f"array_to_string(list_transform(regexp_extract_all({x}, '(\\p{{L}}+|[^\\p{{L}}]+)', 1), lambda r: CASE left(r, 1) WHEN 'ﬁ' THEN 'Fi' WHEN 'ﬂ' THEN 'Fl' "
        "WHEN 'ﬀ' THEN 'Ff' WHEN 'ﬃ' THEN 'Ffi' WHEN 'ß' THEN 'Ss' ELSE upper(left(r, 1)) END || lower(substr(r, 2))), '')"
    )


def _entity_ok(x: str) -> str:
    return f"length({x}) >= 3 AND len(string_split({x}, ' ')) <= 4 AND NOT list_contains([{_list((*config.STOP_TERMS, *config.VERBS))}], lower({x})) AND regexp_matches({x}, '\\p{{L}}')"


def _topic_ok(x: str) -> str:
    opening = " AND ".join(f"NOT starts_with({x}, '{o}')" for o in config.TOPIC_OPENINGS)
    return f"length({x}) >= 4 AND len(string_split({x}, ' ')) <= 3 AND NOT list_contains([{_list(config.STOP_TERMS)}], {x}) AND regexp_matches({x}, '\\p{{L}}') AND NOT regexp_matches({x}, '\\p{{Nd}}') AND NOT regexp_matches({x}, '{_SPECIAL}') AND {opening}"


_PHRASES = f"""{_DOCS},
spaced AS (SELECT doc_id, string_split(regexp_replace(lower({_CLEAN_TOPIC_ALL}), '[^{_WORDCHARS}'' -]+', ' ' || chr(1) || ' ', 'g'), ' ') AS ws FROM d),
marked AS (SELECT doc_id, array_to_string(list_transform(list_filter(ws, lambda w: w <> ''), lambda w: CASE WHEN list_contains([{_list(PHRASE_STOPS)}], w) THEN chr(1) ELSE w END), ' ') AS t FROM spaced),
runs AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(1)), lambda r: trim(r)), lambda r: r <> '' AND len(string_split(r, ' ')) <= 3) AS rs FROM marked),
ph AS (SELECT doc_id, i - 1 AS pos, rs[i] AS surface FROM (SELECT doc_id, rs, unnest(range(1, len(rs) + 1)) AS i FROM runs)),
pc AS (SELECT doc_id, surface, count(*) AS n, min(pos) AS pos FROM ph GROUP BY 1, 2),
pr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n * len(string_split(surface, ' ')) DESC, pos, surface) AS r FROM pc)"""


def _best(points: str, surface: str, rows: str, least: int, most: int) -> str:
    return f"""SELECT doc_id, ord, display, node, score FROM (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, first, display) AS INTEGER) AS ord, display, {_node('display')} AS node, score
  FROM (SELECT doc_id, {surface} AS display, CAST(sum({points}) AS BIGINT) AS score, min(pos) AS first FROM {rows} GROUP BY 1, 2) WHERE score >= {least}) WHERE ord <= {most}"""


def _windows(key: str) -> str:
    """Model windows (``win``: key, win from 0, w) of the cleaned texts of d, by a fold over sentences."""
    text = _SENT.replace("regexp_replace(text,", f"regexp_replace({_spaced(_CLEAN)},")
    return f"""ws AS (SELECT {key}, {text} AS ps FROM d),
wfold AS (
  SELECT {key}, ps, 0 AS i, CAST([] AS VARCHAR[]) AS o, '' AS cur FROM ws
  UNION ALL
  SELECT {key}, ps, i + 1, CASE WHEN length(cur) + length(ps[i + 1]) < {config.MAX_MODEL_CHARS} THEN o ELSE list_append(o, {_strip('cur')}) END,
    CASE WHEN length(cur) + length(ps[i + 1]) < {config.MAX_MODEL_CHARS} THEN cur || ' ' || ps[i + 1] ELSE ps[i + 1] END FROM wfold WHERE i < len(ps)),
wdone AS (SELECT {key}, CASE WHEN cur <> '' THEN list_append(o, {_strip('cur')}) ELSE o END AS o FROM wfold WHERE i = len(ps)),
win AS (SELECT {key}, CAST(i - 1 AS INTEGER) AS win, o[i] AS w FROM (SELECT {key}, o, unnest(range(1, len(o) + 1)) AS i FROM wdone)),
hits AS (SELECT {key}, win, list_concat(regexp_extract_all(w, '({config.MODEL_NAME})', 1), regexp_extract_all(w, '({config.DOTTED_NAME})', 1)) AS hs FROM win),
rx AS (SELECT {key}, CAST(win * 100000 + i - 1 AS BIGINT) AS pos, {_spaced('hs[i]')} AS surface FROM (SELECT {key}, win, hs, unnest(range(1, len(hs) + 1)) AS i FROM hits))"""


_CAPS = rf"[\p{{Ll}},;:] (\p{{Lu}}[{_WORDCHARS}-]+(?: \p{{Lu}}[{_WORDCHARS}-]+){{0,3}})"
_ENTITIES = f"""{_DOCS}, {_windows('doc_id')},
caps AS (SELECT doc_id, regexp_extract_all({_spaced(_CLEAN)}, '{_CAPS}', 1) AS cs FROM d),
cand AS (
  SELECT doc_id, i - 1 AS pos, {_spaced('cs[i]')} AS surface, 2 AS points FROM (SELECT doc_id, cs, unnest(range(1, len(cs) + 1)) AS i FROM caps)
  UNION ALL SELECT doc_id, pos, surface, 1 FROM rx),
good AS (SELECT * FROM cand WHERE {_entity_ok('surface')})"""
_PACKED = f"""{_SES},
o AS (SELECT path, line_no, length(text) AS n, row_number() OVER (PARTITION BY path ORDER BY line_no, length(text)) AS i FROM sm),
pfold AS (
  SELECT path, line_no, i, 1 AS part, n AS total FROM o WHERE i = 1
  UNION ALL
  SELECT o.path, o.line_no, o.i, CASE WHEN f.total + o.n > 2000 THEN f.part + 1 ELSE f.part END, CASE WHEN f.total + o.n > 2000 THEN o.n ELSE f.total + o.n END
  FROM pfold f JOIN o ON o.path = f.path AND o.i = f.i + 1)"""
_UNION = f"""{_SDOC},
u AS (
  SELECT DISTINCT 'chatgpt' AS platform, CAST(account_id AS VARCHAR) AS owner, {_epoch('create_time')} AS date FROM chatgpt_export
  UNION ALL SELECT DISTINCT 'claude', CAST(account_id AS VARCHAR), {_iso("coalesce(created_at, '')")} FROM claude_export
  UNION ALL SELECT DISTINCT 'gemini', CAST(account_id AS VARCHAR), {_iso("coalesce(time, '')")} FROM gemini_activity
  UNION ALL SELECT 'claude-code', path, date FROM sdoc)"""
_UNIX = " ".join(f"WHEN create_time >= {1640995200 * u} AND create_time < {1798761600 * u} THEN {x}" for u, x in (
    (1, "CAST(floor(create_time) AS BIGINT) * 1000000 + CAST(round_even((create_time - floor(create_time)) * 1000000, 0) AS BIGINT)"),
    (1000, "CAST(floor(create_time) AS BIGINT) * 1000 + CAST(round_even((create_time - floor(create_time)) * 1000, 0) AS BIGINT)"),
    (1000000, "CAST(round_even(create_time, 0) AS BIGINT)"), (1000000000, "CAST(round_even(create_time / 1000, 0) AS BIGINT)"),
))
_ISO_FULL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.]\d{1,6})?(Z|[+-]\d{2}:\d{2})$"

SQL = {
    "file_union": f"WITH {_UNION} SELECT platform, owner, date, count(*) AS n FROM u GROUP BY 1, 2, 3",
    "pack_messages": f"WITH RECURSIVE {_PACKED} SELECT path, line_no, part, CAST(max(part) OVER (PARTITION BY path) AS INTEGER) AS parts FROM pfold",
    "model_windows": f"WITH RECURSIVE {_DOCS}, {_windows('doc_id')} SELECT doc_id, win, w AS text FROM win",
    "regex_entities": f"WITH RECURSIVE {_CHUNK_TEXTS}, {_windows('row_id')} SELECT * FROM rx",
    "keyword_scores": f"WITH {_PHRASES} SELECT doc_id, pos, surface FROM pr WHERE r <= 5",
    "topic_scores": f"WITH {_PHRASES}, tp AS (SELECT doc_id, surface, pos, n + CASE WHEN r <= 5 THEN 2 ELSE 0 END AS points FROM pr WHERE {_topic_ok('surface')}) {_best('points', _title('surface'), 'tp', config.TOPIC_LEAST, config.TOPICS_PER_DOC)}",
    "entity_scores": f"WITH RECURSIVE {_ENTITIES} {_best('points', 'surface', 'good', config.ENTITY_LEAST, config.ENTITIES_PER_DOC)}",
    "rendered_pages": f"""WITH {_PAGES}, {_RELATIONS},
rl AS (SELECT DISTINCT page_kind, source AS node, '- ' || relation || ' → [[' || target || ']]' AS line FROM matches JOIN kinds ON kinds.node = source),
mt AS (SELECT page_kind AS kind, node, string_agg(line, chr(10) ORDER BY line) AS t FROM mentions GROUP BY 1, 2),
rt AS (SELECT page_kind AS kind, node, string_agg(line, chr(10) ORDER BY line) AS t FROM rl GROUP BY 1, 2)
SELECT kind, node, '# ' || display || chr(10) || coalesce(chr(10) || chr(10) || '## Mentioned In' || chr(10) || mt.t || chr(10), '') || coalesce(chr(10) || '## Relations' || chr(10) || chr(10) || rt.t, '') AS body
FROM pages LEFT JOIN mt USING (kind, node) LEFT JOIN rt USING (kind, node)""",
    "gemini_file": "SELECT time, title, CASE WHEN safe_html_item IS NOT NULL THEN coalesce(array_to_string(list_transform(safe_html_item, lambda x: x.html), ' ¦ '), '') END AS html FROM gemini_activity",
    "claude_file": f"WITH {_CL} SELECT created_at, name, m.sender AS sender, m.created_at AS at, {_CL_MD} AS text FROM cl",
    "chatgpt_file": f"WITH {_GPT_NODES.replace('row_id, account_id, create_time,', 'row_id, account_id, create_time, title,')} SELECT create_time, title, rec_id AS node, m.create_time AS at, m.author.role AS role, array_to_string(m.content.parts, ' ¦ ') AS parts FROM g",
    "markdown_files": f"WITH {_CL_DAYS}, days AS ({_DAY.format(p='claude', l='Claude')}) SELECT account_id || '/' || path AS path, CAST(length(text) AS BIGINT) AS n_chars, sha256(text) AS hash FROM days",
    "unix_instants": f"SELECT * FROM (SELECT row_id, CASE {_UNIX} END AS utc_us FROM chatgpt_export) WHERE utc_us IS NOT NULL",
    "iso_instants": f"WITH {_CL} SELECT * FROM (SELECT row_id, m.msg_id AS rec_id, epoch_us(try_cast(m.created_at AS TIMESTAMPTZ)) AS utc_us FROM cl WHERE regexp_matches(m.created_at, '{_ISO_FULL}')) WHERE utc_us IS NOT NULL",
    "entity_index": f"WITH {_POST} SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY id) AS ord, id FROM post",
    "adjacency_file": f"WITH {_ADJ} SELECT node, neighbor, ord FROM adj",
    "result_report": f"WITH {_HITS}, {_LAST} SELECT query, rank, id, rank || '. ' || id || ' ' || left(regexp_replace(coalesce(hash, ''), '\\s+', ' ', 'g'), 12) AS line FROM hits JOIN last USING (id)",
    "color_group_file": "SELECT * FROM (VALUES (true, 1, 'tag:#x', 255, 1), (true, 2, 'path:topics', 11893742, 1), (true, 3, 'path:entities', 5017087, 1), (true, 4, 'path:\"conversations/claude\"', 15237946, 1), (true, 5, 'path:\"conversations/chatgpt\"', 4177807, 1), (true, 6, 'path:\"conversations/gemini\"', 15228318, 1), (true, 7, 'path:\"conversations/claude-code\"', 33536, 1)) v(collapse, ord, query, rgb, a)",
    "index_build": f"""WITH RECURSIVE {_chunks(4000)}, ids AS (SELECT DISTINCT left(sha1(path), 12) || ':' || ord AS id, unnest({_CHUNK}) AS entity FROM made)
SELECT 'chunks' AS store, count(*) AS n FROM made UNION ALL SELECT 'vectors', count(*) FROM made UNION ALL SELECT 'postings', count(*) FROM ids""",
    "cooccurrence_edges": f"WITH {_EDGES} SELECT * FROM e",
    "edges_double_pass": f"WITH {_EDGES} SELECT source, target, weight * 2 AS weight, contexts FROM e",
    "context_weighted_pairs": f"WITH {_PAIRS} SELECT * FROM pairs",
    "adjacency": f"WITH {_ADJ} SELECT * FROM adj",
    "adjacency_capped": f"WITH {_ADJ} SELECT * FROM adj WHERE ord <= 5",
    "adjacency_from_edge_list": "SELECT source AS node, target AS neighbor FROM edges UNION SELECT target, source FROM edges",
    "graph_expand": f"WITH {_ADJ}, seeds AS (SELECT row_id, unnest({_EDGE}) AS node FROM d) SELECT row_id, node FROM seeds UNION SELECT row_id, neighbor FROM seeds JOIN adj USING (node) WHERE ord <= 5",
    "relation_matches": f"WITH {_RELATIONS} SELECT * FROM matches",
    "relation_graph": f"WITH {_RELATIONS} SELECT source, relation, target, count(*) AS weight, 'conversation' AS contexts FROM matches GROUP BY 1, 2, 3",
    "text_units": f"WITH {_UNITS} SELECT * FROM units",
    "extracted_links": f"WITH {_DOCS} SELECT doc_id, array_to_string(list_sort({_EDGE}), ' ¦ ') AS edge_links, array_to_string(list_sort({_REL}), ' ¦ ') AS relation_links, array_to_string(list_sort({_CHUNK}), ' ¦ ') AS chunk_links FROM d",
    "section_bounds": f"WITH {_SECTIONS} SELECT doc_id, CAST(n - 1 AS INTEGER) AS ord, CAST(length(s) AS INTEGER) AS n_chars, sha256(s) AS hash FROM sections",
    "document_chunks": f"WITH RECURSIVE {_chunks(4000)} SELECT path, ord, left(sha1(path), 12) || ':' || ord AS id, text, array_to_string(list_sort({_CHUNK}), ' ¦ ') AS links, sha256(text) AS hash FROM made",
    "paragraph_chunks": f"WITH RECURSIVE {_chunks(600)} SELECT path, ord, CAST(length(text) AS INTEGER) AS n_chars, sha256(text) AS hash FROM made",
    "dedup_last_wins": f"WITH {_LAST} SELECT id, batch_id, row_id, hash FROM last",
    "postings": f"WITH {_POST} SELECT * FROM post",
    "inverted_index": f"WITH {_POST} SELECT entity, count(*) AS n_chunks, min(id) AS first_id, max(id) AS last_id FROM post GROUP BY 1",
    "index_lookup": f"WITH {_POST} SELECT DISTINCT id FROM post WHERE entity IN (SELECT source FROM edges UNION SELECT target FROM edges)",
    "index_counts": f"WITH {_POST} SELECT 'chunks' AS what, count(*) AS n FROM last UNION ALL SELECT 'postings', count(*) FROM post UNION ALL SELECT 'entities', count(DISTINCT entity) FROM post",
    "chunk_point_lookup": f"WITH {_LAST} SELECT id, row_id, hash FROM last WHERE id = (SELECT min(id) FROM chunks)",
    "store_roundtrip": f"WITH {_LAST} SELECT id, text, array_to_string(links, ' ¦ ') AS links, hash FROM last",
    "vector_topk": f"SELECT b.vec_id AS id, {_DOT} AS score FROM embeddings a, embeddings b WHERE a.vec_id = (SELECT min(vec_id) FROM embeddings) ORDER BY score DESC, id LIMIT 10",
    "vector_topk_batch": f"WITH {_TOPK} SELECT * FROM tk",
    "hits_join_chunks": f"WITH {_HITS}, {_LAST} SELECT query, rank, id, hash FROM hits JOIN last USING (id)",
    "retrieve": f"""WITH {_HITS}, {_POST}, {_ADJ},
found AS (SELECT query, id, rank, links FROM hits JOIN last USING (id)),
seeds AS (SELECT DISTINCT query, unnest(links) AS node FROM found),
reached AS (SELECT query, node FROM seeds UNION SELECT query, neighbor FROM seeds JOIN adj USING (node) WHERE ord <= 5),
rel AS (SELECT DISTINCT query, id FROM reached JOIN post ON entity = node)
SELECT query, id, coalesce(min(rank), 0) AS rank FROM (SELECT query, id, rank FROM found UNION ALL SELECT query, id, NULL FROM rel) GROUP BY 1, 2""",
    "chatgpt_text": f"WITH {_GPT_NODES} SELECT row_id, rec_id, m.author.role AS speaker, coalesce(m.content.content_type, '') = 'text' AS is_text, {_GPT_TEXT} AS text FROM g WHERE m IS NOT NULL",
    "claude_text": f"WITH {_CL} SELECT row_id, m.msg_id AS rec_id, CASE WHEN m.sender = 'human' THEN 'user' ELSE 'assistant' END AS speaker, {_CL_TEXT} AS text FROM cl WHERE m IS NOT NULL",
    "claude_markdown_text": f"WITH {_CL} SELECT row_id, m.msg_id AS rec_id, {_CL_MD} AS text FROM cl",
    "session_text": f"WITH {_SES} SELECT DISTINCT line_id, path, line_no, kind, text FROM se",
    "session_files_pruned": "SELECT DISTINCT path FROM session_lines WHERE NOT list_contains(string_split(path, '/'), 'subagents')",
    "session_meta": f"WITH {_SDOC} SELECT path, date, project, session, 'claudecode_' || date || '_' || split_part(session, '-', 1) || '.md' AS name FROM sdoc",
    "iso_dates": f"SELECT 'claude_export' AS tab, row_id AS id, {_iso(chr(99) + 'oalesce(created_at, ' + chr(39) * 2 + ')')} AS day FROM claude_export UNION ALL SELECT 'gemini_activity', item_id, {_iso('coalesce(time, ' + chr(39) * 2 + ')')} FROM gemini_activity",
    "epoch_dates": f"SELECT row_id, {_epoch('create_time')} AS day FROM chatgpt_export",
    "sorted_raw": "SELECT account_id, item_id, CAST(row_number() OVER (PARTITION BY account_id ORDER BY coalesce(time, ''), item_id, coalesce(title, '')) AS INTEGER) AS ord FROM (SELECT DISTINCT account_id, item_id, time, title FROM gemini_activity)",
    "render_chatgpt_days": f"WITH {_GPT_DAYS} " + _DAY.format(p="chatgpt", l="ChatGPT"),
    "render_claude_days": f"WITH {_CL_DAYS} " + _DAY.format(p="claude", l="Claude"),
    "render_sessions": f"""WITH {_SDOC} SELECT path, 1 AS part, 1 AS parts, date, project, session, 'claudecode_' || date || '_' || split_part(session, '-', 1) || '.md' AS name,
'---' || {_NL} || 'platform: claude-code' || {_NL} || 'date: ' || date || {_NL} || 'project: ' || project || {_NL} || 'session: ' || session || {_NL} || '---' || {_NL} || {_NL} || '# ' || project || ' (' || session || ')' || {_NL} || {_NL} || body AS text FROM sdoc""",
    "node_names": f"SELECT name, {_node('name')} AS node FROM (SELECT DISTINCT unnest(links) AS name FROM chunks) WHERE name IS NOT NULL",
    "token_names": f"WITH {_TOKENS} SELECT token, {_FILE} AS file_name, {_spaced('token')} AS surface FROM t",
    "title_cased": f"WITH {_TOKENS} SELECT token, array_to_string(list_transform(regexp_extract_all(token, '(\\p{{L}}+|[^\\p{{L}}]+)', 1), lambda r: CASE left(r, 1) WHEN 'ﬁ' THEN 'Fi' WHEN 'ﬂ' THEN 'Fl' WHEN 'ﬀ' THEN 'Ff' WHEN 'ﬃ' THEN 'Ffi' WHEN 'ß' THEN 'Ss' ELSE upper(left(r, 1)) END || lower(substr(r, 2))), '') AS title FROM t",
    "valid_terms": f"""WITH {_TOKENS} SELECT token,
length({_strip('token')}) >= 3 AND NOT list_contains([{_list((*config.STOP_TERMS, *config.VERBS))}], lower({_strip('token')})) AND regexp_matches(token, '\\p{{L}}') AS entity_ok,
length({_strip('token')}) >= 4 AND NOT list_contains([{_list(config.STOP_TERMS)}], lower({_strip('token')})) AND regexp_matches(token, '\\p{{L}}') AND NOT regexp_matches(token, '\\p{{Nd}}') AND NOT regexp_matches(token, '{_SPECIAL}') AS topic_ok FROM t""",
    "clean_entity_text": f"WITH {_DOCS} SELECT doc_id, {_spaced(_CLEAN)} AS cleaned FROM d",
    "clean_topic_text": f"WITH {_DOCS} SELECT doc_id, {_spaced(_sub(_CLEAN_TOPIC, '[#>*_`-]', chr(39) + ' ' + chr(39)))} AS cleaned FROM d",
    "term_scores": f"WITH {_CAND}, {_scored('sc', 1, 1, 5)} SELECT * FROM sc",
    "term_union": f"WITH {_TERMS} SELECT * FROM terms",
    "node_pages": f"WITH {_PAGES} SELECT * FROM pages",
    "mentions": f"WITH {_PAGES} SELECT * FROM mentions",
    "append_if_missing": f"WITH {_PAGES} SELECT * FROM mentions EXCEPT SELECT page_kind, node, line FROM said JOIN kinds USING (node) WHERE doc_id % 2 = 0",
    "relation_lines": f"WITH {_PAGES}, {_RELATIONS} SELECT DISTINCT page_kind, source AS node, '- ' || relation || ' → [[' || target || ']]' AS line FROM matches JOIN kinds ON kinds.node = source",
    "color_group_upsert": "SELECT * FROM (VALUES (1, 'tag:#x', 255, 1), (2, 'path:topics', 11893742, 1), (3, 'path:entities', 5017087, 1), (4, 'path:\"conversations/claude\"', 15237946, 1), (5, 'path:\"conversations/chatgpt\"', 4177807, 1), (6, 'path:\"conversations/gemini\"', 15228318, 1), (7, 'path:\"conversations/claude-code\"', 33536, 1)) v(ord, query, rgb, a)",
}
