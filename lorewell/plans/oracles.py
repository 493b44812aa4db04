"""DuckDB SQL for the catalogue's queries, over the same tables."""

from __future__ import annotations

from lorewell.functions.text import SLOTS, query_terms
from lorewell.operators.retrieval import HIGH_FREQUENCY_LEAST
from lorewell.plans.base_sql import AGE, EDGES, EVENTS, NOTES, NOW, PATHS, POSTINGS, STOP, VECTORS, WEIGHT, WILSON, confidence, sql, stem, tokens
from lorewell.plans.catalogue import AS_OF, LOG_AS_OF, PATHS as WORKING, QUERY

GLOB_RE = lambda p: f"('^' || replace(replace(replace(replace(regexp_replace({p}, '([.+()|{{}}^$\\[\\]\\\\])', '\\\\\\1', 'g'), '**', chr(1)), '*', '[^/]*'), '?', '[^/]'), chr(1), '.*') || '$')"
MATCH = lambda p, t: f"regexp_matches({t}, {GLOB_RE(p)}, 's')"
EITHER = lambda a, b: f"({a} = {b} OR {MATCH(a, b)} OR {MATCH(b, a)})"

_terms = query_terms(QUERY)
QTERMS = "qterms AS (SELECT term, count(*) AS mult FROM (VALUES " + ", ".join(f"('{t}')" for t in _terms) + ") t(term) GROUP BY 1)"
CORPUS_N = "corpus_n AS (SELECT count(*) AS n FROM notes)"
CUT = lambda r: f"q AS (SELECT * FROM qterms WHERE term NOT IN (SELECT term FROM dfs, corpus_n WHERE n >= {HIGH_FREQUENCY_LEAST} GROUP BY term, n HAVING max(df) / n >= {r}))"
BM25 = f"""parts AS (
  SELECT p.id, p.field, CASE p.field WHEN 'statement' THEN 3e0 WHEN 'tags' THEN 2e0 ELSE 1e0 END * ln(1e0 + (n - d.df + 0.5e0) / (d.df + 0.5e0)) * p.tf * 2.5e0
    / (p.tf + 1.5e0 * CASE WHEN avg_len > 0 THEN 0.25e0 + 0.75e0 * len / avg_len ELSE 1e0 END) * q.mult AS part
  FROM postings p JOIN q USING (term) JOIN dfs d ON d.field = p.field AND d.term = p.term JOIN doc_len l ON l.id = p.id AND l.field = p.field JOIN avg_len a ON a.field = p.field, corpus_n),
bm25 AS (SELECT id, raw, body_raw, raw * {WEIGHT} * (1e0 + 0.1e0 * successes) AS score
  FROM (SELECT id, sum(part) AS raw, sum(CASE WHEN field = 'body' THEN part ELSE 0e0 END) AS body_raw FROM parts GROUP BY id) JOIN notes USING (id))"""
LEX = [NOTES, POSTINGS, QTERMS, CORPUS_N, CUT(0.9), BM25]

WORK = "(type IN ('task', 'error', 'question', 'risk', 'decision') AND scope IS NOT NULL)"
TASKS = f"""anc AS (SELECT id, unnest(anchors) AS anchor FROM notes),
confirmers AS (SELECT id, unnest(anchors) AS anchor FROM notes WHERE scope IS NOT NULL AND successes > 0),
apairs AS (SELECT DISTINCT a.anchor AS a, b.anchor AS b FROM (SELECT DISTINCT anchor FROM anc) a, (SELECT DISTINCT anchor FROM confirmers) b WHERE {EITHER('a.anchor', 'b.anchor')}),
task AS (SELECT x.id, least(count(DISTINCT c.id) * 0.1e0, 1e0) AS task FROM anc x JOIN apairs p ON p.a = x.anchor JOIN confirmers c ON c.anchor = p.b GROUP BY x.id)"""
CONF = f"conf AS (SELECT id, {confidence('0e0', 'coalesce(task, 0e0)')} AS confidence FROM notes LEFT JOIN task USING (id))"
PLAIN_CONF = f"conf AS (SELECT id, {confidence()} AS confidence FROM notes)"
LOSERS = """losers AS (SELECT DISTINCT CASE WHEN round(a.confidence, 9) < round(b.confidence, 9) THEN src ELSE dst END AS id
  FROM edges JOIN conf a ON a.id = src JOIN conf b ON b.id = dst WHERE kind = 'contradicts' AND round(a.confidence, 9) <> round(b.confidence, 9))"""

_paths = "(VALUES " + ", ".join(f"('{p}')" for p in WORKING) + ") w(path)"
ANCHOR_HITS = f"""hits AS (SELECT id, count(*) AS hits FROM (SELECT id, unnest(anchors) AS anchor FROM notes), {_paths} WHERE {MATCH('anchor', 'path')} GROUP BY id)"""

DEPENDS = "depends AS (SELECT DISTINCT src, dst FROM edges WHERE kind = 'depends_on')"
CLOSURE = lambda name, rel: f"{name} AS (SELECT src, dst FROM {rel} UNION SELECT r.src, e.dst FROM {name} r JOIN {rel} e ON r.dst = e.src)"
TTL = f"""ttl AS (SELECT id, doc_id, greatest(created_ms, coalesce(last_ms, created_ms)) AS origin,
  CASE classification WHEN 'foundational' THEN NULL WHEN 'observational' THEN 30 + 30 * 50 * reviews // 100 ELSE 365 + 365 * 50 * reviews // 100 END AS days FROM notes)"""
VALID = f"""anc2 AS (SELECT id, unnest(anchors) AS anchor FROM notes),
okay AS (SELECT DISTINCT anchor FROM (SELECT DISTINCT anchor FROM anc2) a, paths WHERE {MATCH('anchor', 'path')}),
validity AS (SELECT id, count(*) AS total, count(o.anchor) AS valid FROM anc2 LEFT JOIN okay o USING (anchor) GROUP BY id)"""
CONTENT = lambda t: f"list_filter(list_distinct({tokens(t)}), lambda x: length(x) >= 2 AND x NOT IN ({STOP}))"
DRIFT = f"""tex AS (SELECT id, created_ms, unnest(anchors) AS anchor, statement || chr(10) || body AS t FROM notes),
tex2 AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY created_ms, id) AS k, count(*) OVER (PARTITION BY anchor) AS n_notes FROM tex),
terms AS (SELECT anchor, n_notes, k <= n_notes // 2 AS old, unnest({CONTENT('t')}) AS term FROM tex2 WHERE n_notes >= 4),
cnt AS (SELECT anchor, n_notes, term, count(*) FILTER (WHERE old) AS a, count(*) FILTER (WHERE NOT old) AS b FROM terms GROUP BY ALL),
prob AS (SELECT anchor, n_notes, a / sum(a) OVER (PARTITION BY anchor) AS p, b / sum(b) OVER (PARTITION BY anchor) AS q FROM cnt),
js AS (SELECT anchor, n_notes, sum((CASE WHEN p > 0 THEN p * log2(p / ((coalesce(p, 0) + coalesce(q, 0)) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((coalesce(p, 0) + coalesce(q, 0)) / 2)) ELSE 0 END) / 2) AS js FROM prob GROUP BY ALL)"""
DEFEATED = """gone AS (SELECT id FROM notes WHERE status IN ('superseded', 'forgotten')),
fallen AS (SELECT src AS id FROM depends WHERE dst IN (SELECT id FROM gone) UNION SELECT d.src FROM fallen f JOIN depends d ON d.dst = f.id),
defeated AS (SELECT id FROM fallen WHERE id NOT IN (SELECT id FROM gone) UNION SELECT dst FROM edges WHERE kind = 'replaces')"""
CYCLIC = lambda reach: f"SELECT a.src AS id, min(a.dst) AS component FROM {reach} a JOIN {reach} b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src"
VIEWS = f"""reach_open AS (SELECT src, dst FROM reach WHERE dst NOT IN (SELECT id FROM notes WHERE status IN ('closed', 'superseded'))),
ring AS ({CYCLIC('reach')}),
views AS (SELECT n.id, CASE WHEN r.id IS NOT NULL THEN 'cycle' ELSE (SELECT min(dst) FROM reach_open o WHERE o.src = n.id) END AS reason FROM notes n LEFT JOIN ring r ON r.id = n.id WHERE {WORK})"""
IMPACT = f"impact AS (SELECT dst AS id, count(DISTINCT src) AS impact FROM reach WHERE src <> dst AND src IN (SELECT id FROM notes WHERE {WORK} AND status IN ('active', 'in_progress', 'blocked')) GROUP BY 1)"
PARENT = "parent AS (SELECT dst AS id, min(src) AS parent FROM edges WHERE kind = 'results_in' GROUP BY 1)"


def _epics(hops: int) -> str:
    steps = [f"SELECT n.id, 0 AS h, n.id AS cur FROM notes n"]
    out = f"up AS ({steps[0]} UNION ALL SELECT u.id, u.h + 1, p.parent FROM up u JOIN parent p ON p.id = u.cur WHERE u.h < {hops})"
    return f"{out}, epic AS (SELECT id, cur AS epic FROM (SELECT u.id, u.cur, row_number() OVER (PARTITION BY u.id ORDER BY h) AS k FROM up u JOIN notes n ON n.id = u.cur WHERE n.scope = 'epic') WHERE k = 1)"


def _pagerank(steps: int = 32, seeds: str = "true", parts: list[str] = ()) -> list[str]:
    """CTEs up to r1, r2, ... of the power iteration; ``parts`` has notes and edges, and what ``seeds`` (a condition on notes) names. Those of ``parts`` that read a rank come last."""
    late = [p for p in parts if f"FROM r{steps}" in p]
    at = parts.index(late[0]) if late else len(parts)
    out = [
        *parts[:at],
        "lnk AS (SELECT DISTINCT src, dst FROM edges WHERE kind IN ('references', 'supports', 'extends', 'replaces') AND dst IN (SELECT id FROM notes))",
        "deg AS (SELECT src, count(*) AS d FROM lnk GROUP BY 1)", "nn AS (SELECT count(*) AS n FROM notes)",
        f"pers AS MATERIALIZED (SELECT id, CASE WHEN {seeds} THEN 1e0 / count(*) FILTER ({seeds}) OVER () ELSE 0e0 END AS p FROM notes)",
        "r0 AS MATERIALIZED (SELECT id, 1e0 / n AS r FROM notes, nn)",
    ]
    for k in range(1, steps + 1):
        out.append(f"c{k} AS MATERIALIZED (SELECT dst AS id, sum(r / d) AS c FROM lnk JOIN deg USING (src) JOIN r{k - 1} ON id = src GROUP BY 1)")
        out.append(f"r{k} AS MATERIALIZED (SELECT n.id, 0.15e0 * n.p + 0.85e0 * (coalesce(c, 0e0) + (1e0 - t.t) * n.p) AS r FROM pers n LEFT JOIN c{k} ON c{k}.id = n.id, (SELECT coalesce(sum(c), 0e0) AS t FROM c{k}) t)")
    return [*out, *parts[at:]]


def _dice(where: str, fields: str) -> str:
    sets = f"""live AS (SELECT id, created_ms FROM notes WHERE status NOT IN ('superseded', 'forgotten') AND {where}),
    sets AS (SELECT l.id, created_ms, list_sort(coalesce(list(DISTINCT term) FILTER (WHERE term IS NOT NULL), [])) AS s FROM live l LEFT JOIN (SELECT * FROM postings WHERE field IN ({fields})) p ON p.id = l.id GROUP BY ALL),
    cls AS (SELECT s, min(id) AS c FROM sets GROUP BY s),
    t AS (SELECT c, len(s) AS n, unnest(s) AS term FROM cls),
    ov AS (SELECT a.c AS a, b.c AS b, 2e0 * count(*) / (any_value(a.n) + any_value(b.n)) AS score FROM t a JOIN t b ON a.term = b.term AND a.c < b.c GROUP BY 1, 2),
    prs AS (SELECT a, b, score FROM ov WHERE round(score, 9) >= 0.92 UNION ALL SELECT c, id, 1e0 FROM sets JOIN cls USING (s) WHERE id <> c),
    props AS (SELECT CASE WHEN (x.created_ms, a) <= (y.created_ms, b) THEN a ELSE b END AS keep, CASE WHEN (x.created_ms, a) <= (y.created_ms, b) THEN b ELSE a END AS drop_, score FROM prs JOIN live x ON x.id = a JOIN live y ON y.id = b)"""
    return sets


def _slots() -> str:
    words = f"(' ' || array_to_string({tokens('body')}, ' ') || ' ')"
    cases = []
    for kind, slots in SLOTS.items():
        for name, phrases in slots:
            has = " OR ".join(f"contains({words}, ' {p} ')" for p in phrases)
            if kind == "snippet":
                has += " OR regexp_matches(body, '(?m)^\\s*```[A-Za-z0-9]')"
            cases.append(f"CASE WHEN type = '{kind}' AND NOT ({has}) THEN '{name}' END")
    cases.append("CASE WHEN type = 'snippet' AND len(anchors) = 0 THEN 'âncora' END")
    cases.append("CASE WHEN type = 'question' AND len(anchors) = 0 AND coalesce(e, 0) = 0 THEN 'o que falta (âncora ou depends_on)' END")
    return f"array_to_string(list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL), ',')"


DEGREE = "degree AS (SELECT src AS id, count(*) AS e FROM edges GROUP BY 1)"
INTEGRITY = """issues AS (
  SELECT 'self_edge' AS issue, src, dst, kind FROM (SELECT DISTINCT * FROM edges) WHERE src = dst
  UNION ALL SELECT 'dangling', src, dst, kind FROM (SELECT DISTINCT * FROM edges) WHERE src <> dst AND dst NOT IN (SELECT id FROM notes)
  UNION ALL SELECT 'dangling', id, superseded_by, 'replaces' FROM notes WHERE superseded_by IS NOT NULL AND superseded_by NOT IN (SELECT id FROM notes)
  UNION ALL SELECT 'missing_forward', id, superseded_by, 'replaces' FROM notes n WHERE superseded_by IN (SELECT id FROM notes) AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.kind = 'replaces' AND e.src = n.superseded_by AND e.dst = n.id)
  UNION ALL SELECT 'missing_backref', src, dst, 'replaces' FROM (SELECT DISTINCT src, dst FROM edges WHERE kind = 'replaces') e JOIN notes o ON o.id = e.dst WHERE o.superseded_by IS DISTINCT FROM e.src)"""
CLAIMS = "claims AS (SELECT subject, relation, count(DISTINCT object) AS n_objects, count(DISTINCT id) AS n_notes, min(object) AS first_object FROM notes GROUP BY 1, 2 HAVING count(DISTINCT object) > 1)"
FLOWS = "flows AS (SELECT note_id AS id, min(at_ms) AS created_ms, max(at_ms) FILTER (WHERE op = 'task' AND action = 'review') AS closed_ms FROM log WHERE note_id IS NOT NULL GROUP BY 1)"
COS = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"
NEXT_VIEWS = [NOTES, EDGES, DEPENDS, CLOSURE("reach", "depends"), VIEWS]

NORM = lambda t: f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"
ARRTAGS = "array_to_string(tags, ' ')"

ORACLES: dict[str, str] = {
    "token_df": sql([NOTES, POSTINGS], "SELECT field, term, df FROM dfs"),
    "bm25_topk": sql(LEX, "SELECT id, round(score, 6) AS score FROM bm25 ORDER BY score DESC, id LIMIT 20"),
    "bm25_highfreq_cut": sql([NOTES, POSTINGS, QTERMS, CORPUS_N, CUT(0.5)], "SELECT DISTINCT term FROM q JOIN dfs USING (term)"),
    "bm25_body_share": sql(LEX, "SELECT id, round(CASE WHEN raw > 0 THEN least(greatest(body_raw / raw, 0e0), 1e0) ELSE 0e0 END, 6) AS share FROM bm25"),
    "tag_counts": sql([NOTES], "SELECT tag, count(*) AS n_notes FROM (SELECT unnest(tags) AS tag FROM notes WHERE status NOT IN ('superseded', 'forgotten')) WHERE tag IS NOT NULL GROUP BY 1"),
    "structural_filter": sql([NOTES], f"SELECT id FROM notes WHERE type IN ('fact', 'decision', 'error') AND classification IN ('foundational', 'tactical') AND list_has_any(tags, ['en', 'fr']) AND agent_role = 'main' AND created_ms BETWEEN 1700000000000 AND 1735000000000 AND status IN ('active', 'in_progress', 'blocked', 'closed') AND EXISTS (SELECT 1 FROM (SELECT unnest(anchors) AS a) WHERE regexp_matches(a, '^src/src1[^/]*/.*$') OR {MATCH('a', chr(39) + 'src/src1*/**' + chr(39))})"),
    "anchor_channel": sql([NOTES], f"""SELECT id, CAST(sum(f) + sum(i) AS BIGINT) AS hits, sum(f) > 0 AS file FROM (SELECT id, (SELECT count(*) FROM {_paths} WHERE {MATCH('anchor', 'path')}) AS f,
      CASE WHEN id = 'n0000000003' OR {MATCH('anchor', "'n0000000003'")} THEN 1 ELSE 0 END AS i FROM (SELECT id, unnest(anchors) AS anchor FROM notes)) GROUP BY id HAVING sum(f) + sum(i) > 0"""),
    "semantic_topk": sql([VECTORS], f"SELECT b.id, round({COS}, 6) AS similarity FROM vectors a, vectors b WHERE a.id = 'n0000000000' AND round({COS}, 6) >= 0 ORDER BY 2 DESC, 1 LIMIT 50"),
    "rrf_fuse": sql([*LEX, ANCHOR_HITS, "ch AS (SELECT id, 1e0 / (60 + row_number() OVER (ORDER BY round(score, 6) DESC, id)) AS l, 0e0 AS a FROM bm25 QUALIFY row_number() OVER (ORDER BY round(score, 6) DESC, id) <= 50 UNION ALL SELECT id, 0e0, 2e0 / (60 + row_number() OVER (ORDER BY hits DESC, id)) FROM hits)"],
                    "SELECT id, round(sum(l) + sum(a), 9) AS score, round(sum(l), 9) AS lexical, round(sum(a), 9) AS anchor FROM ch GROUP BY id"),
    "recall_hybrid": sql([*LEX, EDGES, TASKS, CONF, LOSERS, ANCHOR_HITS, VECTORS, "allowed AS (SELECT id FROM notes WHERE scope IS NULL AND status IN ('active', 'in_progress', 'blocked', 'closed'))",
        "lex AS (SELECT id, round(score * (1e0 + coalesce(task, 0e0)), 6) AS s FROM bm25 LEFT JOIN task USING (id) WHERE score > 0 AND id IN (SELECT id FROM allowed))",
        f"sem0 AS (SELECT b.id, round({COS}, 6) AS s FROM vectors a, vectors b WHERE a.id = 'n0000000000' AND round({COS}, 6) >= 0 ORDER BY 2 DESC, 1 LIMIT 50)",
        """ch AS (SELECT id, 1e0 / (60 + row_number() OVER (ORDER BY s DESC, id)) AS l, 0e0 AS a, 0e0 AS v FROM lex
          UNION ALL SELECT id, 0e0, 2e0 / (60 + row_number() OVER (ORDER BY hits DESC, id)), 0e0 FROM hits WHERE id IN (SELECT id FROM allowed)
          UNION ALL SELECT id, 0e0, 0e0, 30e0 / (60 + row_number() OVER (ORDER BY s DESC, id)) FROM sem0 WHERE id IN (SELECT id FROM allowed))""",
        "fused AS (SELECT id, round(sum(l + a + v), 9) AS score, sum(l) AS l, sum(a) AS a, sum(v) AS v FROM ch GROUP BY id ORDER BY score DESC, id LIMIT 25)",
        f"""full_ AS (SELECT n.*, f.score, f.l, f.a, f.v, coalesce(t.task, 0e0) AS task_, score / (SELECT max(score) FROM fused) AS sim, lo.id IS NOT NULL AS lost, h.id IS NOT NULL AS file, {AGE} AS age
          FROM fused f JOIN notes n USING (id) LEFT JOIN task t USING (id) LEFT JOIN losers lo ON lo.id = f.id LEFT JOIN hits h ON h.id = f.id)"""],
        f"""SELECT id, statement, score, round(CASE WHEN lost THEN greatest({confidence('sim', 'task_')} - 0.1e0, 0e0) ELSE {confidence('sim', 'task_')} END, 6) AS confidence,
          CASE WHEN file THEN 'file_match' WHEN successes > 0 OR task_ > 0 THEN 'stars' WHEN v > 0 THEN 'semantic' WHEN {NOW} - created_ms <= 604800000 THEN 'recent' ELSE 'universal' END AS why,
          round(l, 9) AS lexical, round(a, 9) AS anchor, round(v, 9) AS semantic, round(age, 6) AS recent,
          round(least(CASE WHEN successes + failures > 0 THEN (1e0 + successes) / (2e0 + successes + failures) ELSE 0e0 END + task_, 1e0), 6) AS stars FROM full_"""),
    "rank_confidence": sql([NOTES, EDGES, TASKS, CONF, LOSERS], """SELECT n.id, statement, round(CASE WHEN l.id IS NOT NULL THEN greatest(confidence - 0.1e0, 0e0) ELSE confidence END, 6) AS confidence,
      CASE WHEN successes > 0 OR coalesce(task, 0) > 0 THEN 'stars' ELSE 'universal' END AS why, round(least(CASE WHEN successes + failures > 0 THEN (1e0 + successes) / (2e0 + successes + failures) ELSE 0e0 END + coalesce(task, 0e0), 1e0), 6) AS stars
      FROM notes n JOIN conf USING (id) LEFT JOIN losers l USING (id) LEFT JOIN task t USING (id) WHERE scope IS NULL AND status IN ('active', 'in_progress', 'blocked', 'closed') ORDER BY 3 DESC, 1 LIMIT 25"""),
    "wilson_confidence": sql([NOTES], f"SELECT id, round(CASE WHEN successes + failures > 0 THEN (1e0 + successes) / (2e0 + successes + failures) ELSE 0e0 END, 6) AS posterior, round({WILSON('successes', 'failures')}, 6) AS wilson FROM notes"),
    "task_confirmation": sql([NOTES, TASKS], "SELECT id, round(task, 6) AS task FROM task"),
    "contradiction_losers": sql([NOTES, EDGES, TASKS, CONF, LOSERS], "SELECT id FROM losers"),
    "freshness": sql([NOTES, TTL], f"SELECT count(*) FILTER (WHERE origin + days * 86400000 <= {NOW}) AS stale, count(*) FILTER (WHERE origin + days * 86400000 > {NOW} AND origin + days * 86400000 - {NOW} <= 604800000) AS expiring, count(*) AS notes FROM ttl"),
    "expired": sql([NOTES, TTL], f"SELECT id, origin + days * 86400000 AS expiry_ms FROM ttl WHERE origin + days * 86400000 <= {NOW}"),
    "retention": sql([NOTES, TTL], f"SELECT id, round(CASE WHEN days IS NULL THEN 1e0 ELSE pow(0.5e0, CAST(greatest(({NOW} - origin) // 86400000, 0) AS DOUBLE) / days) END, 6) AS retention FROM ttl"),
    "anchor_drift": sql([NOTES, PATHS, VALID], "SELECT id, total, valid, round(1e0 - valid / total, 6) AS drift FROM validity"),
    "topic_drift_js": sql([NOTES, DRIFT], "SELECT anchor, n_notes, round(js, 6) AS js FROM js"),
    "demotion_plan": sql([NOTES, EDGES, PATHS, DEPENDS, CLOSURE("reach", "depends"), "repl AS (SELECT DISTINCT src, dst FROM edges WHERE kind = 'replaces')", CLOSURE("reach2", "repl"), PLAIN_CONF, LOSERS, TTL, VALID, DRIFT, DEFEATED,
        f"""prot AS (SELECT id FROM ({CYCLIC('reach')}) UNION SELECT id FROM ({CYCLIC('reach2')})),
        drifted AS (SELECT DISTINCT id FROM tex WHERE anchor IN (SELECT anchor FROM js WHERE round(js, 9) >= 0.5)),
        plan AS (SELECT n.id, CASE WHEN t.origin + t.days * 86400000 <= {NOW} THEN 'expired'
          WHEN classification <> 'foundational' AND v.total > 0 AND v.valid / v.total < 0.5 AND ({NOW} - created_ms) // 86400000 >= 30 AND confidence < 0.5 THEN 'anchor_decay'
          WHEN n.id IN (SELECT id FROM losers) THEN 'contradicted' WHEN n.id IN (SELECT id FROM defeated) THEN 'defeated' WHEN n.id IN (SELECT id FROM drifted) THEN 'drifted' END AS reason
          FROM notes n JOIN ttl t USING (id) JOIN conf USING (id) LEFT JOIN validity v USING (id) WHERE n.id NOT IN (SELECT id FROM prot))"""],
        "SELECT id, reason, CASE WHEN reason IN ('expired', 'anchor_decay') THEN 'forget' ELSE 'review' END AS action FROM plan WHERE reason IS NOT NULL", recursive=True),
    "as_of_active": sql([NOTES, EVENTS], f"""SELECT id FROM notes n WHERE created_ms <= {LOG_AS_OF} AND NOT EXISTS (SELECT 1 FROM log WHERE op = 'link' AND kind = 'replaces' AND dst = n.id AND at_ms <= {LOG_AS_OF})
      AND coalesce((SELECT arg_max(op, event_id) FROM log WHERE op IN ('forget', 'restore') AND note_id = n.id AND at_ms <= {LOG_AS_OF}), 'restore') <> 'forget'"""),
    "retirements": sql([EVENTS], f"SELECT id, at_ms AS retired_at, op AS reason, at_ms + 30 * CAST(86400000 AS BIGINT) <= {NOW} AS due FROM (SELECT note_id AS id, at_ms, op, row_number() OVER (PARTITION BY note_id ORDER BY at_ms DESC, event_id DESC) AS k FROM log WHERE op IN ('forget', 'supersede')) WHERE k = 1"),
    "usage_merge": sql([EVENTS, "had AS (SELECT note_id AS id, count(*) AS hits, max(at_ms) AS seen FROM log WHERE event_id % 2 = 0 GROUP BY 1), cited AS (SELECT DISTINCT note_id AS id FROM log WHERE event_id % 5 = 0)"],
        f"SELECT id, CAST(coalesce(hits, 0) + CASE WHEN c.id IS NOT NULL AND coalesce(seen, -1) <> {NOW} THEN 1 ELSE 0 END AS BIGINT) AS hits, CASE WHEN c.id IS NOT NULL THEN greatest(coalesce(seen, 0), {NOW}) ELSE seen END AS last_seen_ms FROM had h FULL JOIN cited c USING (id)"),
    "event_diff": sql([EVENTS], f'SELECT DISTINCT at_ms AS "at", note_id, op FROM log WHERE at_ms >= {AS_OF}'),
    "dice_pairs": sql([NOTES, POSTINGS, _dice("scope IS NULL", "'statement', 'body', 'tags'")], 'SELECT keep, drop_ AS "drop", round(score, 6) AS score FROM props'),
    "statement_pairs": sql([NOTES, POSTINGS, _dice("scope IS NOT NULL", "'statement'")], 'SELECT keep, drop_ AS "drop", round(score, 6) AS score FROM props'),
    "compact_strategies": sql([NOTES, POSTINGS, _dice("scope IS NULL", "'statement', 'body', 'tags'")], """SELECT keep, drop_ AS "drop", CASE WHEN k.last_ms IS NOT NULL AND d.last_ms IS NOT NULL THEN 'merge_outcomes' WHEN k.last_ms IS NOT NULL OR d.last_ms IS NOT NULL THEN 'keep_latest' ELSE 'concat' END AS strategy
      FROM props JOIN notes k ON k.id = keep JOIN notes d ON d.id = drop_"""),
    "bfs_expand": sql([EDGES, "ord AS (SELECT * FROM (VALUES ('references', 0), ('depends_on', 1), ('contradicts', 2), ('supports', 3), ('extends', 4), ('replaces', 5), ('rejects', 6), ('results_in', 7), ('same_as', 8), ('broader', 9), ('narrower', 10), ('related', 11)) o(kind, o))",
        "l1 AS (SELECT dst AS id, 1 AS depth, kind AS via, src AS parent FROM edges JOIN ord USING (kind) WHERE src = 'n0000000040' AND dst <> 'n0000000040' QUALIFY row_number() OVER (PARTITION BY dst ORDER BY src, o) = 1)",
        "l2 AS (SELECT dst AS id, 2 AS depth, kind AS via, src AS parent FROM edges JOIN ord USING (kind) WHERE src IN (SELECT id FROM l1) AND dst <> 'n0000000040' AND dst NOT IN (SELECT id FROM l1) QUALIFY row_number() OVER (PARTITION BY dst ORDER BY src, o) = 1)"],
        "SELECT * FROM l1 UNION ALL SELECT * FROM l2"),
    "closure_depends": sql([EDGES, DEPENDS, CLOSURE("reach", "depends")], "SELECT src, dst FROM reach", recursive=True),
    "cycles": sql([EDGES, "dr AS (SELECT DISTINCT src, dst FROM edges WHERE kind IN ('depends_on', 'related'))", CLOSURE("reach", "dr")], CYCLIC("reach"), recursive=True),
    "ready_blocked": sql(NEXT_VIEWS, "SELECT id, CASE WHEN reason IS NULL THEN 'ready' ELSE 'blocked' END AS state, reason FROM views", recursive=True),
    "integrity": sql([NOTES, EDGES, INTEGRITY], "SELECT * FROM issues"),
    "pagerank": sql(_pagerank(parts=[NOTES, EDGES]), "SELECT id, round(r * 1000, 6) AS rank_per_mille FROM r32"),
    "same_as_classes": sql([EDGES, "sa AS (SELECT src, dst FROM edges WHERE kind = 'same_as' UNION SELECT dst, src FROM edges WHERE kind = 'same_as')", CLOSURE("reach", "sa")], "SELECT src AS id, min(dst) AS representative FROM reach GROUP BY 1", recursive=True),
    "broader_closure": sql([EDGES, "br AS (SELECT DISTINCT src, dst FROM edges WHERE kind = 'broader')", CLOSURE("reach", "br")], "SELECT src, dst FROM reach", recursive=True),
    "claim_conflicts": sql([NOTES, CLAIMS], "SELECT * FROM claims"),
    "tms_defeated": sql([NOTES, EDGES, DEPENDS, DEFEATED], "SELECT DISTINCT id FROM defeated", recursive=True),
    "impact": sql([NOTES, EDGES, DEPENDS, CLOSURE("reach", "depends"), IMPACT], "SELECT id, impact FROM impact", recursive=True),
    "progress": sql([NOTES, EDGES, f"items AS (SELECT id, status FROM notes WHERE {WORK}), tree AS (SELECT DISTINCT src, dst FROM edges WHERE kind = 'results_in'), leaves AS (SELECT * FROM items WHERE id NOT IN (SELECT src FROM tree WHERE dst IN (SELECT id FROM items)))",
        "down AS (SELECT n.id AS root, t.dst AS id FROM notes n JOIN tree t ON t.src = n.id WHERE n.scope = 'epic' AND t.dst <> n.id UNION ALL SELECT d.root, t.dst FROM down d JOIN tree t ON t.src = d.id WHERE t.dst <> d.root AND t.dst <> d.id)"],
        "SELECT root, count(*) AS total, count(*) FILTER (WHERE status = 'closed') AS done FROM down JOIN leaves USING (id) GROUP BY 1", recursive=True),
    "epics": sql([NOTES, EDGES, PARENT, _epics(3)], "SELECT id, epic FROM epic", recursive=True),
    "subtree": sql([EDGES, "tree AS (SELECT DISTINCT src, dst FROM edges WHERE kind = 'results_in'), down AS (SELECT dst AS id, 1 AS depth, src || '/' || dst AS way FROM tree WHERE src = 'n0000000001' UNION ALL SELECT t.dst, d.depth + 1, d.way || '/' || t.dst FROM down d JOIN tree t ON t.src = d.id)"],
        "SELECT id, depth, row_number() OVER (ORDER BY way) - 1 AS position FROM down", recursive=True),
    "history": sql([NOTES, EDGES, "rp AS (SELECT src, min(dst) AS dst FROM edges WHERE kind = 'replaces' GROUP BY 1), old AS (SELECT 'n0000000057' AS id, 0 AS k UNION ALL SELECT r.dst, k + 1 FROM old o JOIN rp r ON r.src = o.id WHERE k < 50), top AS (SELECT id FROM old ORDER BY k DESC LIMIT 1), nw AS (SELECT id, CAST(0 AS BIGINT) AS step FROM top UNION ALL SELECT n.superseded_by, step + 1 FROM nw JOIN notes n ON n.id = nw.id WHERE n.superseded_by IS NOT NULL AND step < 50)"],
        "SELECT id, step FROM nw", recursive=True),
    "scope_members": sql([EDGES, DEPENDS, "dn AS (SELECT 'n0000000010' AS id UNION SELECT e.dst FROM dn JOIN edges e ON e.src = dn.id AND e.kind = 'results_in'), ups AS (SELECT 'n0000000010' AS id UNION SELECT d.src FROM ups JOIN depends d ON d.dst = ups.id)"], "SELECT id FROM dn UNION SELECT id FROM ups", recursive=True),
    "structural_clusters": sql([NOTES, EDGES, PARENT, _epics(8), "ax AS (SELECT id, 'anchor' AS axis, unnest(anchors) AS key FROM notes UNION ALL SELECT id, 'type', coalesce(type, 'epic') FROM notes UNION ALL SELECT id, 'class', classification FROM notes UNION ALL SELECT id, 'scope', epic FROM epic)"],
        "SELECT axis, key, count(DISTINCT id) AS n_members, min(id) AS first_id FROM ax GROUP BY 1, 2", recursive=True),
    "global_terms": sql([NOTES], f"SELECT term, count(*) AS n_notes FROM (SELECT unnest({CONTENT('statement')}) AS term FROM notes) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8"),
    "knn_per_note": sql([VECTORS], f"SELECT a.id AS origin, b.id, round({COS}, 6) AS score FROM vectors a, vectors b WHERE a.id <> b.id AND substr(a.id, 10) IN ('00', '50') AND round({COS}, 6) >= 0 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round({COS}, 6) DESC, b.id) <= 5"),
    "similar_pairs": sql([VECTORS], f"SELECT a.id AS a, b.id AS b, round({COS}, 6) AS score FROM vectors a JOIN vectors b ON a.id < b.id WHERE round({COS}, 6) >= 0.45"),
    "semantic_suggestions": sql([NOTES, EDGES, VECTORS, f"nn AS (SELECT a.id AS o, b.id, round({COS}, 6) AS score FROM vectors a, vectors b WHERE a.id <> b.id AND substr(a.id, 10) IN ('00', '50') AND round({COS}, 6) >= 0.4 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round({COS}, 6) DESC, b.id) <= 10)",
        "pr AS (SELECT DISTINCT least(o, id) AS a, greatest(o, id) AS b, score FROM nn), lk AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges)"],
        "SELECT pr.a, pr.b, CASE WHEN score >= 0.92 THEN 'duplicate' WHEN score >= 0.75 THEN 'link' WHEN coalesce(list_has_any(x.anchors, y.anchors), false) THEN 'link' ELSE 'contradiction' END AS relation, score FROM pr LEFT JOIN notes x ON x.id = pr.a LEFT JOIN notes y ON y.id = pr.b WHERE NOT EXISTS (SELECT 1 FROM lk WHERE lk.a = pr.a AND lk.b = pr.b)"),
    "unlinked": sql([EDGES, VECTORS], "SELECT id FROM vectors WHERE id NOT IN (SELECT src FROM edges)"),
    "task_flow": sql([EVENTS, FLOWS], "SELECT id, created_ms, coalesce(closed_ms, -1) AS closed_ms FROM flows"),
    "flow_summary": sql([EVENTS, FLOWS], f"SELECT count(*) AS notes, count(closed_ms) AS closed, CAST(coalesce(sum(closed_ms - created_ms) // nullif(count(closed_ms), 0), 0) AS BIGINT) AS mean_cycle_ms, CAST(sum(coalesce(closed_ms, {NOW}) - created_ms) // count(*) AS BIGINT) AS mean_lead_ms FROM flows"),
    "throughput": sql([EVENTS], "SELECT at_ms // 86400000 * 86400000 AS start_ms, count(*) AS closed FROM log WHERE op = 'task' AND action = 'review' GROUP BY 1"),
    "manifest_rank": sql([NOTES, TASKS], """SELECT id, CASE WHEN coalesce(task, 0) > 0 OR successes > 0 THEN 'star' ELSE classification END AS tier,
      CASE WHEN successes > 0 THEN 100e0 ELSE 0e0 END + CASE classification WHEN 'foundational' THEN 50e0 WHEN 'tactical' THEN 20e0 ELSE 10e0 END + CASE WHEN coalesce(task, 0) > 0 THEN 100e0 ELSE 0e0 END AS score, created_ms FROM notes LEFT JOIN task USING (id) ORDER BY 3 DESC, 4 DESC, 1 LIMIT 50"""),
    "next_tasks": sql([*NEXT_VIEWS, IMPACT], "SELECT n.id, trim(regexp_replace(statement, '[|\\s]+', ' ', 'g')) AS statement, coalesce(impact, 0) AS impact, created_ms FROM notes n JOIN views v ON v.id = n.id AND v.reason IS NULL LEFT JOIN impact i ON i.id = n.id WHERE status NOT IN ('closed', 'superseded', 'forgotten') ORDER BY 3 DESC, 4, 1 LIMIT 20", recursive=True),
    "budget_cut": sql([NOTES, "ln AS (SELECT doc_id AS position, id || '|' || trim(regexp_replace(statement, '[|\\s]+', ' ', 'g')) AS line FROM notes ORDER BY id LIMIT 200), cs AS (SELECT *, CAST(ceil(length(line) / 4e0) AS BIGINT) AS cost, sum(ceil(length(line) / 4e0)) OVER (ORDER BY position) AS s FROM ln), ov AS (SELECT *, sum(CASE WHEN s > 1500 THEN 1 ELSE 0 END) OVER (ORDER BY position) AS o FROM cs)"],
        "SELECT position, CASE WHEN o = 0 THEN line ELSE left(line, CAST((1500 - (s - cost)) * 4 AS BIGINT)) || '…' END AS line FROM ov WHERE o = 0 OR (o = 1 AND s > 1500 AND 1500 - (s - cost) >= 100)"),
    "auto_scope": sql([NOTES, EDGES, DEPENDS, "ep AS (SELECT id FROM notes WHERE scope = 'epic'), tr AS (SELECT DISTINCT src, dst FROM edges WHERE kind = 'results_in'), dn AS (SELECT id AS epic, id FROM ep UNION SELECT dn.epic, t.dst FROM dn JOIN tr t ON t.src = dn.id), ups AS (SELECT id AS epic, id FROM ep UNION SELECT u.epic, d.src FROM ups u JOIN depends d ON d.dst = u.id), mem AS (SELECT * FROM dn UNION SELECT * FROM ups)",
        f"ah AS (SELECT id, anchor FROM (SELECT id, unnest(anchors) AS anchor FROM notes) WHERE EXISTS (SELECT 1 FROM {_paths} WHERE {MATCH('anchor', 'path')}))"], "SELECT epic, count(*) AS hits FROM mem JOIN ah USING (id) GROUP BY 1", recursive=True),
    "promotions": sql([NOTES, EDGES, f"pc AS (SELECT id, round(least(greatest(least(len(anchors) + len(tags), 5) / 5e0 * {AGE} + 0.05e0 * {AGE} * (1e0 - least(len(anchors) + len(tags), 5) / 5e0), 0e0), 1e0), 6) AS confidence FROM notes WHERE type IN ('meta', 'decision') AND classification = 'foundational' AND id NOT IN (SELECT src FROM edges WHERE kind = 'contradicts'))"], "SELECT * FROM pc WHERE confidence >= 0.05"),
    "doctor_checks": sql([NOTES, EDGES, PATHS, DEPENDS, CLOSURE("reach", "depends"), TASKS, CONF, LOSERS, TTL, VALID, INTEGRITY, CLAIMS, DEGREE], f"""SELECT 'integrity' AS "check", count(*) AS findings FROM issues UNION ALL SELECT 'dependency_cycles', count(*) FROM ({CYCLIC('reach')}) UNION ALL SELECT 'broken_anchors', count(*) FROM validity WHERE valid < total
      UNION ALL SELECT 'expired', count(*) FROM ttl WHERE origin + days * 86400000 <= {NOW} UNION ALL SELECT 'contradictions', count(*) FROM losers UNION ALL SELECT 'claim_conflicts', count(*) FROM claims
      UNION ALL SELECT 'missing_slots', count(*) FROM notes LEFT JOIN degree USING (id) WHERE {_slots()} <> '' UNION ALL SELECT 'empty_body', count(*) FROM notes WHERE trim(body) = '' UNION ALL SELECT 'long_statement', count(*) FROM notes WHERE length(statement) > 120""", recursive=True),
    "agent_recap": sql([NOTES, "rc AS (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY created_ms DESC, id DESC) AS k FROM notes)"],
        "SELECT agent_id, max(created_ms) AS newest_ms, count(*) AS n_notes, arg_max(id, created_ms) FILTER (WHERE type = 'decision') AS decision, arg_max(id, created_ms) FILTER (WHERE type = 'error') AS error FROM rc WHERE k <= 30 GROUP BY 1"),
    "missing_slots": sql([NOTES, EDGES, DEGREE], f"SELECT * FROM (SELECT id, {_slots()} AS slots FROM notes LEFT JOIN degree USING (id)) WHERE slots <> ''"),
    "note_ids": sql([NOTES], f"""SELECT id, type || '_' || lower(to_base(CAST('0x' || left(sha256(type || chr(31) || {NORM('statement')}), 8) AS BIGINT), 36, 8)) AS note_id,
      left(sha256({NORM('statement')} || chr(10) || {NORM('body')}), 8) AS body_hash, strftime(make_timestamp(created_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS created_at FROM notes WHERE type IS NOT NULL"""),
    "critical_path": sql([NOTES, EDGES, EVENTS, FLOWS, DEPENDS, CLOSURE("reach", "depends"), f"ring AS ({CYCLIC('reach')})",
        "ok_edges AS (SELECT d.* FROM depends d LEFT JOIN ring a ON a.id = d.src LEFT JOIN ring b ON b.id = d.dst WHERE a.component IS NULL OR b.component IS NULL OR a.component <> b.component)",
        f"dur AS (SELECT f.id, coalesce(closed_ms, {NOW}) - f.created_ms AS d FROM flows f JOIN notes n ON n.id = f.id)",
        "nodes AS (SELECT src AS id FROM ok_edges UNION SELECT dst FROM ok_edges UNION SELECT id FROM dur), nd AS (SELECT id, coalesce(d, 0) AS d FROM nodes LEFT JOIN dur USING (id))",
        "walk AS (SELECT id, id AS tip, d AS total, CAST(1 AS BIGINT) AS n_steps FROM nd UNION ALL SELECT w.id, e.dst, w.total + nd.d, n_steps + 1 FROM walk w JOIN ok_edges e ON e.src = w.tip JOIN nd ON nd.id = e.dst)"],
        "SELECT id, total, n_steps FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY total DESC, n_steps DESC) AS k FROM walk) WHERE k = 1", recursive=True),
    "write_decisions": sql([NOTES, POSTINGS, CORPUS_N, "drafts AS (SELECT 'd' || id AS draft_id, statement, CASE WHEN doc_id % 2 = 0 THEN left(body, 400) ELSE body END AS body, tags FROM notes WHERE doc_id % 41 = 3)",
        f"dt AS (SELECT draft_id, unnest({CONTENT("statement || chr(10) || body")}) AS tok FROM drafts), q AS (SELECT draft_id, {stem('tok')} AS term, count(*) AS mult FROM dt GROUP BY ALL)",
        f"""sc AS (SELECT draft_id, p.id, sum(CASE p.field WHEN 'statement' THEN 3e0 WHEN 'tags' THEN 2e0 ELSE 1e0 END * ln(1e0 + (n - d.df + 0.5e0) / (d.df + 0.5e0)) * p.tf * 2.5e0 / (p.tf + 1.5e0 * CASE WHEN avg_len > 0 THEN 0.25e0 + 0.75e0 * len / avg_len ELSE 1e0 END) * q.mult) AS raw
          FROM q JOIN postings p USING (term) JOIN dfs d ON d.field = p.field AND d.term = p.term JOIN doc_len l ON l.id = p.id AND l.field = p.field JOIN avg_len a ON a.field = p.field, corpus_n GROUP BY ALL)""",
        f"top AS (SELECT draft_id, id FROM (SELECT draft_id, id, row_number() OVER (PARTITION BY draft_id ORDER BY round(raw * {WEIGHT} * (1e0 + 0.1e0 * successes), 6) DESC, id) AS k FROM sc JOIN notes USING (id) WHERE status NOT IN ('superseded', 'forgotten')) WHERE k <= 10)",
        f"dtoks AS (SELECT draft_id, unnest({tokens('statement')} || {tokens('body')} || {tokens(ARRTAGS)}) AS tok FROM drafts), ds AS (SELECT DISTINCT draft_id, {stem('tok')} AS term FROM dtoks), ns AS (SELECT DISTINCT id, term FROM postings)",
        "na AS (SELECT draft_id, count(*) AS a FROM ds GROUP BY 1), nb AS (SELECT id, count(*) AS b FROM ns GROUP BY 1)",
        "ov AS (SELECT t.draft_id, t.id, round(2e0 * (SELECT count(*) FROM ds JOIN ns USING (term) WHERE ds.draft_id = t.draft_id AND ns.id = t.id) / (a + b), 6) AS score FROM top t JOIN na USING (draft_id) JOIN nb USING (id))",
        "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY draft_id ORDER BY score DESC, id) AS k FROM ov) WHERE k = 1)"],
        "SELECT d.draft_id, CASE WHEN score >= 0.92 THEN 'reject' WHEN score >= 0.75 THEN 'merge' ELSE 'create' END AS decision, b.id AS best_id, score FROM drafts d LEFT JOIN best b USING (draft_id)"),
    "ndcg_eval": """WITH rk AS (SELECT lang AS query, doc_id AS id, (doc_id * 7919) % 1000 AS rank FROM documents WHERE lang IS NOT NULL), rl AS (SELECT lang AS query, doc_id AS id FROM documents WHERE doc_id % 9 = 0 AND lang IS NOT NULL),
      g AS (SELECT query, count(*) AS h, min(rank) AS f, sum(1e0 / log2(rank + 2e0)) AS dcg FROM rk JOIN rl USING (query, id) WHERE rank < 50 GROUP BY 1), m AS (SELECT query, count(*) AS n FROM rl GROUP BY 1)
      SELECT query, round(coalesce(h / n, 0e0), 6) AS recall, round(coalesce(1e0 / (f + 1), 0e0), 6) AS mrr, round(coalesce(dcg / (SELECT sum(1e0 / log2(i + 2e0)) FROM range(0, least(n, 50)) r(i)), 0e0), 6) AS ndcg FROM m LEFT JOIN g USING (query)""",
    "shard_merge": "SELECT id, created_ms, agent_id FROM (SELECT 'c' || conv_id AS id, turn AS created_ms, role AS agent_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) AS k FROM conversations) WHERE k = 1",
    "event_log_dedup": "SELECT 'evt_' || user_id || event_type AS id, min(event_id) AS _line FROM events GROUP BY 1",
}
