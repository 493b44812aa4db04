"""DuckDB SQL for the queries on recall's options, task views, hand-off, health and writes."""

from __future__ import annotations

from lorewell.plans.base_sql import EDGES, EVENTS, NOTES, NOW, PATHS, POSTINGS, VECTORS, confidence, note, sql
from lorewell.plans.catalogue import AS_OF, PATHS as WORKING
from lorewell.plans.oracles import ANCHOR_HITS, CLOSURE, CONF, COS, CYCLIC, DEPENDS, EITHER, IMPACT, INTEGRITY, LEX, LOSERS, MATCH, NEXT_VIEWS, NORM, PARENT, TASKS, TTL, VALID, WORK, _dice, _epics, _pagerank

SHOWN = "status IN ('active', 'in_progress', 'blocked', 'closed')"
LINE = lambda t: f"trim(regexp_replace({t}, '[|\\s]+', ' ', 'g'))"
SCOPE = "n0000000010"
BELONGS = f"inside AS (SELECT 'n0000000002' AS id UNION SELECT d.src FROM inside i JOIN depends d ON d.dst = i.id)"
AS_OF_SET = f"""lasts AS (SELECT note_id AS id, arg_max(op, event_id) AS op FROM log WHERE at_ms <= {AS_OF} AND op IN ('forget', 'restore') GROUP BY 1),
then_ AS (SELECT id FROM notes WHERE created_ms <= {AS_OF} AND id NOT IN (SELECT id FROM lasts WHERE op = 'forget' AND id IS NOT NULL) AND id NOT IN (SELECT dst FROM log WHERE at_ms <= {AS_OF} AND op = 'link' AND kind = 'replaces' AND dst IS NOT NULL))"""


def _recall(allowed: str, more: list[str] = (), edges: str = EDGES, semantic: bool = False, ppr: str = "", limit: str = "", ids: str = "", inside: str = "") -> list[str]:
    """CTEs up to full_ (the hits with their parts and why) of a recall with the given candidates."""
    own = f"own AS (SELECT id, count(*) AS n FROM (SELECT id, unnest(anchors) AS anchor FROM notes), (VALUES {ids}) w(i) WHERE id = i OR {MATCH('anchor', 'i')} GROUP BY id)" if ids else "own AS (SELECT id, 0 AS n FROM notes WHERE false)"
    ch = [
        "SELECT id, 1e0 / (60 + row_number() OVER (ORDER BY s DESC, id)) AS l, 0e0 AS a, 0e0 AS v, 0e0 AS p FROM lex",
        "SELECT id, 0e0, 2e0 / (60 + row_number() OVER (ORDER BY h DESC, id)), 0e0, 0e0 FROM anchored",
    ]
    parts = [*LEX, edges, DEPENDS, TASKS, CONF, LOSERS, ANCHOR_HITS, *more, f"allowed AS (SELECT id FROM notes WHERE scope IS NULL AND {allowed})", own,
        "lex AS (SELECT id, round(score * (1e0 + coalesce(task, 0e0)), 6) AS s FROM bm25 LEFT JOIN task USING (id) WHERE score > 0 AND id IN (SELECT id FROM allowed))",
        "anchored AS (SELECT id, coalesce(h.hits, 0) + coalesce(o.n, 0) AS h, h.id IS NOT NULL AS file, o.id IS NOT NULL AS own FROM allowed LEFT JOIN hits h USING (id) LEFT JOIN own o USING (id) WHERE h.id IS NOT NULL OR o.id IS NOT NULL)"]
    if semantic:
        parts += [VECTORS, f"sem0 AS (SELECT b.id, round({COS}, 6) AS s FROM vectors a, vectors b WHERE a.id = 'n0000000000' AND round({COS}, 6) >= 0 ORDER BY 2 DESC, 1 LIMIT 50)"]
        ch.append("SELECT id, 0e0, 0e0, 30e0 / (60 + row_number() OVER (ORDER BY s DESC, id)), 0e0 FROM sem0 WHERE id IN (SELECT id FROM allowed)")
    if ppr:
        ch.append(f"SELECT id, 0e0, 0e0, 0e0, 1e0 / (60 + row_number() OVER (ORDER BY round(r * 1000, 6) DESC, id)) FROM {ppr} WHERE id IN (SELECT id FROM allowed)")
    tracked = f"WHEN n.id IN (SELECT id FROM {inside}) THEN 'tracker_match'" if inside else ""
    return [*parts, f"ch AS ({' UNION ALL '.join(ch)})", f"fused AS (SELECT id, round(sum(l + a + v + p), 9) AS score, sum(l) AS l, sum(a) AS a, sum(v) AS v FROM ch GROUP BY id ORDER BY score DESC, id {limit})",
        f"""hit AS (SELECT n.*, f.score, f.l, f.a, f.v, coalesce(t.task, 0e0) AS task_, f.score / (SELECT max(score) FROM fused) AS sim, lo.id IS NOT NULL AS lost,
          CASE WHEN h.file THEN 'file_match' WHEN h.own THEN 'anchor_match' {tracked} WHEN successes > 0 OR coalesce(t.task, 0) > 0 THEN 'stars' WHEN f.v > 0 THEN 'semantic' WHEN {NOW} - created_ms <= 604800000 THEN 'recent' ELSE 'universal' END AS why
          FROM fused f JOIN notes n USING (id) LEFT JOIN task t USING (id) LEFT JOIN losers lo ON lo.id = f.id LEFT JOIN anchored h ON h.id = f.id)""",
        f"full_ AS (SELECT *, round(CASE WHEN lost THEN greatest({confidence('sim', 'task_')} - 0.1e0, 0e0) ELSE {confidence('sim', 'task_')} END, 6) AS confidence_ FROM hit)"]


HASH = lambda t: f"left(md5({t}), 8)"
FILES = f"files AS (SELECT path, {HASH('path')} AS h FROM paths)"
NOW_FILES = f"now_files AS (SELECT path, CASE WHEN left(h, 1) IN ('2', '3') THEN 'changed' ELSE h END AS h FROM files WHERE left(h, 1) NOT IN ('0', '1'))"
LINES = f"""lines AS (SELECT doc_id AS position, id, {HASH('body')} AS bh, '|' || {LINE('statement')} || '|' || classification AS rest FROM notes WHERE doc_id % 25 = 0 OR status IN ('superseded', 'forgotten'))"""
ANCHOR_LINES = "alines AS (SELECT (SELECT max(position) FROM lines) + row_number() OVER (ORDER BY path) AS position, path, h FROM files WHERE path LIKE '%1.rs')"
MEMBERS = f"dn AS (SELECT '{{0}}' AS id UNION SELECT e.dst FROM dn JOIN edges e ON e.src = dn.id AND e.kind = 'results_in'), ups AS (SELECT '{{0}}' AS id UNION SELECT d.src FROM ups JOIN depends d ON d.dst = ups.id), members AS (SELECT id FROM dn UNION SELECT id FROM ups)"
MANIFEST = f"""man AS (SELECT n.id, CASE WHEN coalesce(task, 0) > 0 OR successes > 0 THEN 'star' ELSE classification END AS tier, statement, created_ms,
  CASE WHEN successes > 0 THEN 100 ELSE 0 END + CASE classification WHEN 'foundational' THEN 50 WHEN 'tactical' THEN 20 ELSE 10 END + CASE WHEN coalesce(task, 0) > 0 THEN 100 ELSE 0 END AS s FROM notes n LEFT JOIN task USING (id))"""


def _rewind(where: str, budget: int) -> list[str]:
    return [r"""ln AS (SELECT row_number() OVER (ORDER BY s DESC, m.created_ms DESC, m.id) - 1 AS position, concat_ws('|', m.id, """ + LINE("m.statement") + r""", tier) ||
          CASE WHEN (n.classification = 'foundational' OR n.type = 'decision') AND regexp_replace(n.body, '^\s+|\s+$', '', 'g') <> '' THEN chr(10) || regexp_replace(n.body, '^\s+|\s+$', '', 'g') ELSE '' END AS line
          FROM man m JOIN notes n ON n.id = m.id WHERE """ + where + ")",
        "cs AS (SELECT *, CAST(ceil(length(line) / 4e0) AS BIGINT) AS cost, sum(ceil(length(line) / 4e0)) OVER (ORDER BY position) AS s FROM ln)",
        f"fst AS (SELECT min(position) FILTER (WHERE s > {budget}) AS f, count(*) AS n FROM cs)", f"tail AS (SELECT count(*) > 0 AS cut_ FROM cs, fst WHERE position = f AND {budget} - (s - cost) >= 100)"]


def _cut(budget: int) -> str:
    return f"SELECT position, CASE WHEN position = f THEN left(line, CAST(({budget} - (s - cost)) * 4 AS BIGINT)) || '…' ELSE line END AS line, cut_ AS truncated, coalesce(n - f, 0) AS dropped FROM cs, fst, tail WHERE f IS NULL OR position < f OR (position = f AND cut_)"


_TYPES = ["fact", "decision", "question", "task", "def", "error", "snippet", "link", "meta", "risk"]
_NAMES = ["active", "in_progress", "blocked", "closed", "superseded", "forgotten"]
_names = "(VALUES " + ", ".join(f"('{n}')" for n in _NAMES) + ")"
_changed = " || ".join(["statement"])
_child = "kids AS (SELECT DISTINCT src AS id, dst AS child FROM edges WHERE kind = 'results_in')"
_cue = "list_extract(['Depende de', 'isto requer', 'que contradiz', 'veja [[', 'confirma', 'ver'], doc_id % 6 + 1)"
_ten = "lpad(CAST(doc_id - doc_id % 10 AS VARCHAR), 8, '0')"
_five = "lpad(CAST(doc_id - doc_id % 10 + 5 AS VARCHAR), 8, '0')"
_progress = f"""items AS (SELECT id, status FROM notes WHERE {WORK}), tree AS (SELECT DISTINCT src, dst FROM edges WHERE kind = 'results_in'), leaves AS (SELECT * FROM items WHERE id NOT IN (SELECT src FROM tree WHERE dst IN (SELECT id FROM items))),
down AS (SELECT n.id AS root, t.dst AS id FROM notes n JOIN tree t ON t.src = n.id WHERE n.scope = 'epic' AND t.dst <> n.id UNION ALL SELECT d.root, t.dst FROM down d JOIN tree t ON t.src = d.id WHERE t.dst <> d.root AND t.dst <> d.id),
prog AS (SELECT root, count(*) AS total, count(*) FILTER (WHERE status = 'closed') AS done FROM down JOIN leaves USING (id) GROUP BY 1)"""
_cutoff = lambda cond: EDGES.replace("\nedges AS (", "\nall_edges AS (") + f", edges AS (SELECT * FROM all_edges WHERE NOT ({cond}))"
#: References count as dependencies.
_REFERENCES = EDGES.replace("\nedges AS (", "\nplain_edges AS (") + ", edges AS (SELECT src, CASE WHEN kind = 'references' THEN 'depends_on' ELSE kind END AS kind, dst FROM plain_edges)"

ORACLES: dict[str, str] = {
    "recall_scoped": sql(_recall(f"{SHOWN} AND id IN (SELECT id FROM inside)", [BELONGS], _REFERENCES, inside="inside"), "SELECT id, score, confidence_ AS confidence, why, round(l, 9) AS lexical, round(a, 9) AS anchor FROM full_", recursive=True),
    "recall_as_of": sql(_recall("id IN (SELECT id FROM then_)", [EVENTS, AS_OF_SET], limit="LIMIT 25"), "SELECT id, score, confidence_ AS confidence, why FROM full_"),
    "why_labels": sql(_recall("status IN ('active', 'closed')", semantic=True, ids="('n0000000003'), ('n0000000064')"), "SELECT why, count(*) AS n FROM full_ GROUP BY 1"),
    "recall_authority": sql([*_pagerank(seeds=f"id IN (SELECT id FROM anchored)", parts=_recall(SHOWN, ppr="r32", limit="LIMIT 25", ids="('n0000000004'), ('n0000000016'), ('n0000000027')"))], "SELECT id, score, why FROM full_"),
    "ppr_ranks": sql(_pagerank(seeds="doc_id % 100 = 3", parts=[NOTES, EDGES]), "SELECT id, round(r * 1000, 6) AS rank_per_mille FROM r32"),
    "task_list": sql([*NEXT_VIEWS, IMPACT], f"SELECT n.id, scope, status, reason, coalesce(impact, 0) AS impact FROM notes n JOIN views v ON v.id = n.id AND v.reason IS NOT NULL LEFT JOIN impact i ON i.id = n.id WHERE {WORK} AND scope = 'task' AND list_has_any(tags, ['en', 'de'])", recursive=True),
    "task_list_in_container": sql([*NEXT_VIEWS, IMPACT, PARENT, MEMBERS.format("n0000000001")], f"SELECT n.id, scope, status, reason, coalesce(impact, 0) AS impact FROM notes n LEFT JOIN views v ON v.id = n.id LEFT JOIN impact i ON i.id = n.id WHERE {WORK} AND n.id IN (SELECT id FROM members) AND n.id IN (SELECT id FROM parent WHERE parent = 'n0000000001')", recursive=True),
    "notes_by_ids": sql([NOTES], "SELECT CAST(p AS BIGINT) AS position, w.id, statement, n.id IS NOT NULL AS found FROM (VALUES (0, 'n0000000005'), (1, 'n9999999999'), (2, 'n0000000001'), (3, 'n0000000005')) w(p, id) LEFT JOIN notes n ON n.id = w.id"),
    "program_roots": sql([NOTES, _cutoff("kind = 'results_in' AND ends_with(dst, '0')"), PARENT], f"SELECT id FROM notes WHERE scope = 'epic' AND id NOT IN (SELECT id FROM parent) AND EXISTS (SELECT 1 FROM (SELECT unnest(anchors) AS a) WHERE {EITHER('a', chr(39) + 'src/src10/**' + chr(39))})"),
    "task_roles": sql([NOTES, EDGES, PARENT, "lv AS (SELECT id, 0 AS depth FROM notes WHERE id NOT IN (SELECT id FROM parent) UNION ALL SELECT p.id, lv.depth + 1 FROM lv JOIN parent p ON p.parent = lv.id)", _child],
        """SELECT n.id, CAST(depth AS BIGINT) AS depth, CASE WHEN type = 'error' THEN 'Bug' WHEN type = 'question' THEN 'Spike' WHEN type = 'risk' THEN 'Risk' WHEN type = 'decision' THEN 'Decision' WHEN depth = 0 THEN 'Epic'
          WHEN depth = 1 AND n.id IN (SELECT id FROM kids) THEN 'Feature' WHEN depth = 1 THEN 'Story' ELSE 'Sub-task' END AS role FROM notes n JOIN lv USING (id)""", recursive=True),
    "task_modes": sql([NOTES, EDGES, DEPENDS, EVENTS, _child, "sub AS (SELECT note_id AS child, arg_max(at_ms, event_id) AS t FROM log WHERE event_id % 7 = 0 AND op = 'task' AND action = 'submit' GROUP BY 1)",
        "told AS (SELECT a.id, count(DISTINCT a.child) AS told FROM kids a JOIN depends d ON d.src = a.child JOIN kids b ON b.id = a.id AND b.child = d.dst WHERE b.child < a.child GROUP BY 1)"],
        "SELECT k.id, CASE WHEN count(DISTINCT t) >= 2 THEN 'magentic' WHEN count(*) < 2 OR coalesce(any_value(told), 0) = count(*) - 1 THEN 'sequential' ELSE 'concurrent' END AS mode FROM kids k LEFT JOIN sub USING (child) LEFT JOIN told ON told.id = k.id GROUP BY 1"),
    "task_contexts": sql([NOTES, EDGES, DEPENDS, PARENT, _epics(3), _progress, """rel AS (SELECT id, 'parent' AS relation, parent AS other FROM parent UNION ALL SELECT src, 'blocked_by', dst FROM depends UNION ALL SELECT dst, 'blocks', src FROM depends WHERE src <> dst
        UNION ALL SELECT DISTINCT src, 'child', dst FROM edges WHERE kind = 'results_in' UNION ALL SELECT id, 'epic', epic FROM epic)"""],
        f"SELECT r.id, r.relation, r.other, {LINE(chr(39) * 2 + ' || coalesce(n.statement, ' + chr(39) * 2 + ')')} AS statement, n.scope, coalesce(n.status, 'active') AS status, p.total, p.done FROM rel r JOIN notes w ON w.id = r.id AND w.doc_id % 50 = 1 LEFT JOIN notes n ON n.id = r.other LEFT JOIN prog p ON p.root = r.other AND r.relation = 'epic'", recursive=True),
    "agent_memory": sql([NOTES], "SELECT id, agent_id, created_ms FROM notes WHERE agent_id = 'agent3' ORDER BY created_ms DESC, id LIMIT 40"),
    "work_by_status": sql([NOTES], f"SELECT status, count(*) AS n FROM notes WHERE {WORK} AND status NOT IN ('closed', 'superseded', 'forgotten') GROUP BY 1"),
    "epics_around": sql([NOTES, _cutoff("kind = 'results_in' AND ends_with(dst, '1')"), DEPENDS, PARENT, _epics(8), "far AS (SELECT id, id AS epic, 0 AS h FROM notes WHERE scope = 'epic' UNION SELECT d.src, f.epic, f.h + 1 FROM far f JOIN depends d ON d.dst = f.id WHERE f.h < 60)"],
        "SELECT id, epic FROM epic UNION ALL SELECT id, arg_min(epic, (h, epic)) FROM far WHERE id IN (SELECT id FROM notes) AND id NOT IN (SELECT id FROM epic) GROUP BY 1", recursive=True),
    "manifest_counters": sql(NEXT_VIEWS, "SELECT count(*) AS notes, (SELECT count(*) FROM views WHERE reason IS NULL) AS ready, (SELECT count(*) FROM views WHERE reason IS NOT NULL) AS blocked, count(*) FILTER (WHERE scope = 'epic') AS containers, 'dirty' AS dirty, (SELECT string_agg(id, ' ' ORDER BY created_ms DESC, id) FROM (SELECT * FROM notes ORDER BY created_ms DESC, id LIMIT 3)) AS recent FROM notes", recursive=True),
    "rewind_scope": sql([NOTES, EDGES, DEPENDS, TASKS, MANIFEST, MEMBERS.format(SCOPE), *_rewind("m.id IN (SELECT id FROM members)", 400)], _cut(400), recursive=True),
    "rewind_resume": sql([NOTES, EDGES, DEPENDS, TASKS, MANIFEST, MEMBERS.format(SCOPE), *_rewind("m.id IN (SELECT id FROM members)", 400)], f"SELECT position, line FROM ({_cut(400)})", recursive=True),
    "rewind_files": sql([NOTES, EDGES, DEPENDS, PARENT, TASKS, MANIFEST, ANCHOR_HITS, f"wp(p) AS (VALUES {', '.join(f"('{p}')" for p in WORKING)})",
        f"rts AS (SELECT DISTINCT id FROM (SELECT id, unnest(anchors) AS a FROM notes WHERE scope = 'epic' AND id NOT IN (SELECT id FROM parent)), wp WHERE {EITHER('a', 'p')})",
        "rdn AS (SELECT id FROM rts UNION SELECT e.dst FROM rdn JOIN edges e ON e.src = rdn.id AND e.kind = 'results_in'), rup AS (SELECT id FROM rts UNION SELECT d.src FROM rup JOIN depends d ON d.dst = rup.id)",
        *_rewind("m.id IN (SELECT id FROM hits UNION SELECT id FROM rdn UNION SELECT id FROM rup)", 4000)], _cut(4000), recursive=True),
    "rewind_auto": sql([*NEXT_VIEWS, IMPACT, TTL, f"""fr AS (SELECT count(*) FILTER (WHERE origin + days * 86400000 <= {NOW}) AS stale, count(*) FILTER (WHERE origin + days * 86400000 > {NOW} AND origin + days * 86400000 - {NOW} <= 604800000) AS expiring FROM ttl)""",
        f"rd AS (SELECT n.id, {LINE('statement')} AS statement, coalesce(impact, 0) AS impact, created_ms FROM notes n JOIN views v ON v.id = n.id AND v.reason IS NULL LEFT JOIN impact i ON i.id = n.id WHERE status NOT IN ('closed', 'superseded', 'forgotten'))",
        "nx AS (SELECT * FROM rd ORDER BY impact DESC, created_ms, id LIMIT 4)",
        """ls AS (SELECT 0 AS position, 'notes=' || count(*) || ' ready=' || (SELECT count(*) FROM views WHERE reason IS NULL) || ' blocked=' || (SELECT count(*) FROM views WHERE reason IS NOT NULL) || ' containers=' || count(*) FILTER (WHERE scope = 'epic') || ' dirty' AS line FROM notes
          UNION ALL SELECT 1, 'recent: ' || string_agg(id, ' ' ORDER BY created_ms DESC, id) FROM (SELECT * FROM notes ORDER BY created_ms DESC, id LIMIT 3)
          UNION ALL SELECT 2, 'next: ' || string_agg(id || '|' || statement, ' ' ORDER BY impact DESC, created_ms, id) FROM nx UNION ALL SELECT 3, 'fresh: stale=' || stale || ' expiring=' || expiring || ' pending=0' FROM fr)"""],
        "SELECT CAST(position AS BIGINT) AS position, line, false AS truncated, (SELECT count(*) FROM rd) - (SELECT count(*) FROM nx) AS dropped FROM ls", recursive=True),
    "refs_annotated": sql([NOTES, PATHS, FILES, LINES, ANCHOR_LINES], "SELECT position, id || CASE WHEN position % 4 <> 0 THEN '@' || bh ELSE '' END || rest AS line FROM lines UNION ALL SELECT position, 'anchor|' || path || '@' || h FROM alines"),
    "refs_verified": sql([NOTES, PATHS, FILES, NOW_FILES, LINES, ANCHOR_LINES, f"cur AS (SELECT id, status, superseded_by, {HASH('CASE WHEN doc_id % 50 = 0 THEN body || chr(33) ELSE body END')} AS h FROM notes WHERE doc_id % 75 <> 0)",
        "v AS (SELECT position, 'note' AS kind, CASE WHEN c.id IS NULL THEN 'dangling' WHEN c.status = 'forgotten' THEN 'retired' WHEN c.status = 'superseded' THEN 'superseded' WHEN c.h <> bh THEN 'changed' END AS status, l.id AS name, bh AS hash, superseded_by, c.h AS h FROM lines l LEFT JOIN cur c USING (id))",
        "w AS (SELECT position, 'anchor' AS kind, CASE WHEN a.path LIKE '%21.rs' OR n.path IS NULL THEN 'dangling' WHEN n.h <> a.h THEN 'changed' END AS status, a.path AS name, a.h AS hash, n.h AS h FROM alines a LEFT JOIN now_files n USING (path))"],
        "SELECT position, kind, status, name, hash, CASE status WHEN 'superseded' THEN superseded_by WHEN 'changed' THEN h END AS detail FROM v WHERE status IS NOT NULL UNION ALL SELECT position, kind, status, name, hash, CASE WHEN status = 'changed' THEN h END FROM w WHERE status IS NOT NULL"),
    "stale_anchors": sql([NOTES, PATHS, FILES, NOW_FILES, "rec AS (SELECT DISTINCT id, path, h, CASE WHEN contains(b, path) OR contains(b, regexp_extract(path, '[^/]*$')) THEN 'cited' ELSE 'context' END AS role FROM (SELECT id, CASE WHEN doc_id % 3 = 0 THEN body || ' ' || array_to_string(anchors, ' ') ELSE body END AS b, unnest(anchors) AS path FROM notes) JOIN files USING (path))"],
        "SELECT id, r.path, role, CASE WHEN n.path IS NULL THEN 'missing' ELSE 'content_changed' END AS reason, role = 'cited' AS invalidates FROM rec r LEFT JOIN now_files n ON n.path = r.path WHERE n.path IS NULL OR n.h <> r.h"),
    "audit": sql([NOTES, POSTINGS, EDGES, PATHS, DEPENDS, CLOSURE("reach", "depends"), "repl AS (SELECT DISTINCT src, dst FROM edges WHERE kind = 'replaces')", CLOSURE("reach2", "repl"), INTEGRITY, _dice("scope IS NULL", "'statement', 'body', 'tags'")],
        f"""SELECT 'integrity' AS finding, count(*) AS n FROM issues UNION ALL SELECT 'supersession_cycles', count(DISTINCT component) FROM ({CYCLIC('reach2')}) UNION ALL SELECT 'dependency_cycles', count(DISTINCT component) FROM ({CYCLIC('reach')})
        UNION ALL SELECT 'broken_anchors', count(*) FROM (SELECT id, unnest(anchors) AS a FROM notes) WHERE a NOT LIKE '%*%' AND a NOT IN (SELECT path FROM paths) UNION ALL SELECT 'duplicates', count(*) FROM props
        UNION ALL SELECT 'missing_edges', count(*) FROM (SELECT id AS src, {note('doc_id * 3 + 1')} AS dst FROM notes WHERE doc_id % 20 = 0) s WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = s.src AND e.dst = s.dst) UNION ALL SELECT 'stale_locks', 1""", recursive=True),
    "edge_mentions": sql([NOTES, f"own AS (SELECT *, type || '_' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS own FROM notes WHERE type IS NOT NULL)",
        f"""m AS (SELECT id, own AS target, 'replaces' AS kind, 'verbo' AS reason FROM own
          UNION SELECT id, 'def_' || {_five}, 'extends', 'verbo' FROM own)"""],
        "SELECT id, target, kind, reason FROM m WHERE target IN (SELECT own FROM own)"),
    "closest_labels": sql([NOTES, "w AS (SELECT DISTINCT left(type, length(type) - doc_id % 3) || 's' AS raw FROM notes WHERE type IS NOT NULL)", "v AS (SELECT i, v FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(_TYPES)) + ") t(i, v))",
        "b AS (SELECT raw, arg_min(v, (levenshtein(raw, v), i)) AS v, min(levenshtein(raw, v)) AS d FROM w, v GROUP BY raw)"], "SELECT raw, CASE WHEN d <= greatest(2, length(raw) // 3) THEN v END AS hint FROM b"),
    "parent_markers": sql([NOTES], f"SELECT id, CASE WHEN doc_id % 3 = 0 THEN {note('doc_id // 3')} END AS parent, CAST(CASE WHEN doc_id % 6 = 0 THEN doc_id % 9 END AS BIGINT) AS blocks, md5(regexp_replace(body, '(\\n\\s*)+$', '')) AS rest FROM notes"),
    "outcomes_appended": sql([NOTES, EVENTS, "r AS (SELECT note_id AS id, count(*) AS n, string_agg('success:' || at_ms || ':' || event_id, ',' ORDER BY at_ms, CAST(event_id AS VARCHAR)) AS o FROM log WHERE op = 'task' AND action = 'review' GROUP BY 1)"],
        "SELECT n.id, 1 + coalesce(r.n, 0) AS revision, coalesce(o, '') AS outcomes FROM notes n LEFT JOIN r USING (id)"),
    "draft_problems": sql([NOTES], """SELECT id AS draft_id, CASE WHEN doc_id % 17 = 4 THEN 'not an object' WHEN doc_id % 7 = 1 THEN 'unknown key: titel' WHEN doc_id % 13 = 3 THEN 'no statement' WHEN doc_id % 11 = 2 THEN 'unknown type'
      WHEN doc_id % 19 = 5 THEN 'unknown status' END AS problem FROM notes"""),
    "checks_resolved": sql([NOTES, f"a AS (SELECT DISTINCT unnest(anchors) AS a FROM notes)"], f"""SELECT 'fmt' AS name, 'explicit' AS source UNION ALL SELECT 'lint', 'explicit' UNION ALL SELECT 'nowhere', 'missing' UNION ALL SELECT 'all', 'global'
      UNION ALL SELECT n, 'anchor' FROM (VALUES ('one', 'src/src1/doc_1.rs'), ('none', 'docs/*.md'), ('two', 'src/*/doc_2?.rs')) c(n, p) WHERE EXISTS (SELECT 1 FROM a WHERE {MATCH('p', 'a')})"""),
    "check_outcomes": sql([EVENTS, "r AS (SELECT note_id, CASE WHEN event_id % 10 > 0 THEN event_id % 5 > 0 END AS passed, event_id % 3 = 0 AS err FROM log)"],
        "SELECT note_id, CASE WHEN count(passed) = 0 THEN 'abandoned' WHEN bool_and(passed) THEN 'success' WHEN coalesce(bool_or(NOT passed AND err), false) THEN 'failure' ELSE 'partial' END AS outcome FROM r GROUP BY 1"),
    "gates_accepted": sql([NOTES], "SELECT id AS name, true AS passed, CAST(doc_id % 7 AS DOUBLE) AS before, CAST(doc_id % 9 AS DOUBLE) AS after FROM notes WHERE doc_id % 4 > 0 AND doc_id % 9 - doc_id % 7 >= 1"),
    "transitions": sql([NOTES], f"""SELECT s.status AS source, t.n AS target, count(*) AS n, count(*) FILTER (WHERE CASE WHEN t.n = 'superseded' THEN false WHEN s.status = 'superseded' THEN t.n = 'forgotten' WHEN s.status = 'forgotten' THEN t.n = 'active' ELSE true END) AS note,
      count(*) FILTER (WHERE (s.status, t.n) IN (('active', 'in_progress'), ('active', 'closed'), ('in_progress', 'in_progress'), ('in_progress', 'closed'), ('in_progress', 'active'), ('blocked', 'active'), ('blocked', 'in_progress'))) AS task FROM notes s, {_names} t(n) GROUP BY ALL"""),
    "hierarchy": sql([NOTES, EDGES, PARENT], "SELECT p.id, coalesce((a.scope, c.scope) IN (('epic', 'issue'), ('epic', 'task'), ('issue', 'task')), false) AS allowed FROM parent p JOIN notes c ON c.id = p.id JOIN notes a ON a.id = p.parent"),
    "demotions_covered": sql([NOTES, PATHS.replace("paths AS", "every_path AS") + ", paths AS (SELECT * FROM every_path WHERE left(md5(path), 1) < '8')", VALID, "sh AS (SELECT sum(valid) / sum(total) AS share FROM validity)"],
        "SELECT id, CASE WHEN doc_id % 2 = 0 THEN 'anchor_decay' ELSE 'expired' END AS reason FROM notes, sh WHERE doc_id % 2 = 1 OR coalesce(share, 0) >= 0.5"),
    "drift_index": sql([EVENTS], "SELECT note_id AS id, arg_max((at_ms % 1000) / 1000e0, event_id) AS drift FROM log GROUP BY 1"),
    "edges_missing": sql([NOTES, EDGES, f"s AS (SELECT id AS src, {note('(doc_id * 13 + 7) % (doc_id // 2 + 1)')} AS dst FROM notes WHERE doc_id % 8 = 0 UNION ALL SELECT id, {note('doc_id * 5')} FROM notes WHERE doc_id % 8 = 1)"], "SELECT src, dst FROM s WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = s.src AND e.dst = s.dst)"),
    "events_since": "SELECT 'e' || event_id AS id FROM events WHERE (event_id % 3, event_id) > (502 % 3, 502)",
    "status_changes": sql([NOTES, "t AS (SELECT id, list_extract(['closed', 'active', 'superseded', 'forgotten'], doc_id % 4 + 1) AS target FROM notes WHERE doc_id % 3 = 0)",
        "x AS (SELECT n.id, status, target, CASE WHEN target = 'superseded' THEN false WHEN status = 'superseded' THEN target = 'forgotten' WHEN status = 'forgotten' THEN target = 'active' ELSE true END AS ok FROM notes n LEFT JOIN t USING (id))"],
        "SELECT id, CASE WHEN target IS NOT NULL AND ok THEN target ELSE status END AS status, CASE WHEN target IS NOT NULL AND NOT ok THEN target END AS refused FROM x"),
    "notes_updated": sql([NOTES, "p AS (SELECT *, doc_id % 6 = 2 AS moved FROM notes WHERE type IS NOT NULL AND doc_id % 6 IN (2, 4))"], f"""SELECT id, CASE WHEN moved THEN type || '_' || lower(to_base(CAST('0x' || left(sha256(type || chr(31) || {NORM("'new ' || statement")}), 8) AS BIGINT), 36, 8)) ELSE id END AS new_id,
      CASE WHEN moved THEN 'supersede' ELSE 'update' END AS action, CASE WHEN moved THEN 'superseded' ELSE status END AS status, CAST(CASE WHEN moved THEN 3 ELSE 4 END AS BIGINT) AS revision FROM p"""),
    "notes_merged": sql([NOTES, f"m AS (SELECT {note('doc_id // 2')} AS id, anchors AS a, left(body, 40) AS b FROM notes WHERE doc_id % 30 = 0)"], """SELECT n.id, array_to_string(list_filter(tags, lambda x: x IS NOT NULL) || CASE WHEN m.id IS NULL THEN [] ELSE list_filter(['zz', 'en'], lambda x: NOT list_contains(list_filter(tags, lambda y: y IS NOT NULL), x)) END, ',') AS tags,
      array_to_string(list_filter(anchors, lambda x: x IS NOT NULL) || list_filter(coalesce(m.a, []), lambda x: NOT list_contains(anchors, x)), ',') AS anchors, md5(CASE WHEN m.id IS NULL OR contains(body, m.b) THEN body ELSE body || chr(10) || chr(10) || m.b END) AS body FROM notes n LEFT JOIN m ON m.id = n.id"""),
    "links_added": sql([NOTES, EDGES, f"l AS (SELECT id AS src, CASE WHEN doc_id % 24 = 0 THEN 'supports' ELSE 'likes' END AS kind, {note('doc_id * 2')} AS dst FROM notes WHERE doc_id % 12 = 0)"],
        "SELECT kind, count(*) AS n FROM (SELECT src, kind, dst FROM edges UNION SELECT src, kind, dst FROM l WHERE kind = 'supports' AND src <> dst) GROUP BY 1 UNION ALL SELECT 'refused ' || kind, count(*) FROM l WHERE kind = 'likes' OR src = dst GROUP BY 1"),
    "statement_pairs_mixed": sql([NOTES, POSTINGS, _dice("true", "'statement'")], "SELECT keep, drop_ AS drop, round(score, 6) AS score FROM props p JOIN notes k ON k.id = keep JOIN notes d ON d.id = drop_ WHERE k.scope IS NOT NULL OR d.scope IS NOT NULL"),
    "merge_strategy": sql([NOTES, POSTINGS, _dice("true", "'statement', 'body', 'tags'")], "SELECT keep, drop_ AS drop, round(score, 6) AS score FROM props"),
    "hints": sql([NOTES], "SELECT id, doc_id % 5 AS priority FROM notes WHERE doc_id % 10 = 1 AND doc_id % 30 <> 1 ORDER BY 2, 1 LIMIT 7"),
    "unlinked_by_reference": sql([EDGES, VECTORS], "SELECT id FROM vectors WHERE id NOT IN (SELECT src FROM edges WHERE kind IN ('extends', 'supports'))"),
}
ORACLES["dup_proposals_lsh"] = ORACLES["merge_strategy"]
