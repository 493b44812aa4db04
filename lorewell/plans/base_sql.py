"""The bound corpus as DuckDB SQL: common table expressions that the checks build on."""

from __future__ import annotations

from lorewell.functions.ids import TYPES
from lorewell.functions.text import STOPWORDS, SUFFIXES, fold_map
from lorewell.functions.scores import TYPE_WEIGHT
from lorewell.sources.bound import EDGE_RULES, NOW_MS

NOW = str(NOW_MS)


def note(i: str) -> str:
    return f"('n' || lpad(CAST({i} AS VARCHAR), 10, '0'))"


_types = ",".join(f"'{t}'" for t in TYPES)

NOTES = f"""notes AS (
  SELECT d.doc_id, {note('d.doc_id')} AS id,
    CASE WHEN doc_id % 10 <> 0 THEN list_extract([{_types}], doc_id % 10 + 1) END AS type,
    substring(string_split(coalesce(text, ''), chr(10))[1], 1, 120) AS statement, coalesce(text, '') AS body, [lang] AS tags,
    CASE WHEN doc_id % 16 = 5 THEN ['src/' || source || '/doc_' || (doc_id % 64) || '.rs', 'src/' || source || '/**'] ELSE ['src/' || source || '/doc_' || (doc_id % 64) || '.rs'] END AS anchors,
    list_extract(['foundational','tactical','observational'], doc_id % 3 + 1) AS classification,
    list_extract(['active','active','in_progress','closed','active','blocked','active','closed','superseded','forgotten','active'], doc_id % 11 + 1) AS status,
    CASE WHEN doc_id % 10 = 0 THEN 'epic' WHEN doc_id % 10 IN (1, 2, 5) THEN 'task' WHEN doc_id % 20 = 3 THEN 'issue' END AS scope,
    1700000000000 + doc_id * 3600000 AS created_ms,
    CASE WHEN quality = 1 THEN 1e0 ELSE 0e0 END AS successes, CASE WHEN toxic = 1 THEN 1e0 ELSE 0e0 END AS failures,
    CAST(CASE WHEN quality = 1 THEN 1 ELSE 0 END AS BIGINT) AS reviews,
    CASE WHEN quality = 1 OR toxic = 1 THEN 1700000000000 + doc_id * 3600000 + 86400000 END AS last_ms,
    CASE WHEN doc_id % 50 = 6 AND doc_id % 100 <> 6 THEN {note('doc_id + 1')} END AS superseded_by,
    's' || (doc_id % 40) AS subject, 'r' || (doc_id % 3) AS relation, 'o' || (doc_id % 7) AS object,
    'agent' || (doc_id % 7) AS agent_id, CASE WHEN doc_id % 4 = 3 THEN 'subagent' ELSE 'main' END AS agent_role
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) USING (doc_id)
)"""

_rules = " UNION ALL ".join(f"SELECT i, '{k}' AS kind, CAST({to.replace('DIV', '//')} AS BIGINT) AS j FROM ids WHERE {cond}" for k, cond, to in EDGE_RULES)
EDGES = f"""ids AS (SELECT doc_id AS i FROM documents), raw_edges AS ({_rules} UNION ALL SELECT (i - 1) // 8, 'results_in', i FROM ids WHERE i >= 1),
edges AS (SELECT {note('i')} AS src, kind, {note('j')} AS dst FROM raw_edges)"""

EVENTS = f"""log AS (
  SELECT event_id,
    CASE event_type WHEN 'signup' THEN 'write' WHEN 'purchase' THEN 'task' WHEN 'error' THEN 'forget' WHEN 'click' THEN 'link' ELSE CASE WHEN event_id % 2 = 0 THEN 'restore' ELSE 'update' END END AS op,
    {note('user_id')} AS note_id, epoch_us(ts) // 1000 AS at_ms,
    CASE WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'review' WHEN event_type = 'purchase' THEN 'submit' END AS action,
    CASE WHEN event_type = 'click' AND event_id % 4 = 0 THEN 'replaces' WHEN event_type = 'click' THEN 'references' END AS kind,
    CASE WHEN event_type = 'click' THEN {note('event_id % 500')} END AS dst
  FROM events)"""

PATHS = "paths AS (SELECT DISTINCT 'src/' || source || '/doc_' || (doc_id % 64) || '.rs' AS path FROM documents WHERE doc_id % 64 % 3 <> 0 AND source IS NOT NULL)"

VECTORS = f"vectors AS (SELECT {note('vec_id')} AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, label FROM embeddings)"

_source, _target = (x.replace("'", "''") for x in fold_map())


def tokens(text: str) -> str:
    return f"regexp_extract_all(lower(translate({text}, '{_source}', '{_target}')), '[a-z0-9_]+')"


_cut = lambda t: f"regexp_replace({t}, '^(.{{4,}}?)(?:{'|'.join(SUFFIXES)})$', '\\1')"


def stem(t: str) -> str:
    return f"CASE WHEN length({t}) < 4 THEN {t} WHEN ends_with({t}, 'oes') THEN {_cut(f'(left({t}, length({t}) - 3) || {chr(39)}ao{chr(39)})')} WHEN ends_with({t}, 's') AND length({t}) >= 5 THEN {_cut(f'left({t}, length({t}) - 1)')} ELSE {_cut(t)} END"


STOP = ", ".join(f"'{w}'" for w in STOPWORDS)

#: Terms of all fields, then their counts and lengths.
POSTINGS = f"""toks AS (
  SELECT id, 'statement' AS field, unnest({tokens('statement')}) AS tok FROM notes
  UNION ALL SELECT id, 'body', unnest({tokens('body')}) FROM notes
  UNION ALL SELECT id, 'tags', unnest({tokens("array_to_string(tags, ' ')")}) FROM notes),
postings AS (SELECT id, field, {stem('tok')} AS term, count(*) AS tf FROM toks GROUP BY ALL),
doc_len AS (SELECT n.id, f.field, coalesce(l.len, 0) AS len FROM notes n CROSS JOIN (VALUES ('statement'), ('body'), ('tags')) f(field)
  LEFT JOIN (SELECT id, field, sum(tf) AS len FROM postings GROUP BY ALL) l ON l.id = n.id AND l.field = f.field),
avg_len AS (SELECT field, avg(len) AS avg_len FROM doc_len GROUP BY field),
dfs AS (SELECT field, term, count(*) AS df FROM postings GROUP BY ALL)"""

WILSON = lambda s, f: f"(CASE WHEN {s} + {f} > 0 THEN greatest(({s} / ({s} + {f}) + 3.8416e0 / (({s} + {f}) * 2e0) - sqrt(({s} / ({s} + {f}) * (1e0 - {s} / ({s} + {f})) + 3.8416e0 / (({s} + {f}) * 4e0)) / ({s} + {f})) * 1.96e0) / (3.8416e0 / ({s} + {f}) + 1e0), 0e0) ELSE 0e0 END)"
AGE = f"(1e0 / (CAST(greatest(({NOW} - created_ms) // 86400000, 0) AS DOUBLE) / 90e0 + 1e0))"
WEIGHT = "CASE coalesce(type, 'epic') " + " ".join(f"WHEN '{k}' THEN {w}e0" for k, w in TYPE_WEIGHT.items()) + " ELSE 1e0 END"


def confidence(sim: str = "0e0", task: str = "0e0", drift: str = "0e0") -> str:
    w = WILSON("successes", "failures")
    return f"least(greatest(({sim} * {AGE} + {w} + greatest({task}, 0e0) + {AGE} * 0.05e0 * (1e0 - {sim})) * (1e0 - {drift} * 0.5e0), 0e0), 1e0)"


def sql(parts: list[str], body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {body}"
