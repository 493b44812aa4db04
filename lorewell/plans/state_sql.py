"""DuckDB SQL for the queries on persisted state."""

from __future__ import annotations

from lorewell.plans.base_sql import EDGES, EVENTS, NOTES, NOW, PATHS, POSTINGS, VECTORS, note, sql
from lorewell.plans.oracles import CLOSURE, COS, CYCLIC, DEGREE, DEPENDS, EITHER, FLOWS, INTEGRITY, LEX, MATCH, NORM, PARENT, TASKS, _dice, _slots
from lorewell.plans.work_sql import FILES, NOW_FILES

_json = lambda c: f"""CASE WHEN {c} IS NOT NULL THEN '"{c}":"' || {c} || '"' END"""

ORACLES: dict[str, str] = {
    "bm25_index": sql(LEX, "SELECT id, round(score, 6) AS score FROM bm25 ORDER BY score DESC, id LIMIT 20"),
    "cache_kept": """
WITH old AS (
  SELECT vec_id, md5(CAST(vec_id AS VARCHAR)) AS body_hash, 'model' || vec_id % 3 AS model, embedding, vec_id % 10 AS created_ms, vec_id * 7919 % 1000 AS used_ms FROM embeddings
), rows_ AS (
  SELECT body_hash, model, created_ms, used_ms, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vector FROM old
  UNION ALL SELECT body_hash, model, CASE WHEN vec_id % 2 = 0 THEN created_ms ELSE 5 END, used_ms, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 2) FROM old
), best AS (
  SELECT *, max(used_ms) OVER (PARTITION BY body_hash, model) AS used FROM rows_ QUALIFY row_number() OVER (PARTITION BY body_hash, model ORDER BY created_ms DESC, vector DESC) = 1
), fit AS (
  SELECT *, sum(len(vector) * 4 + strlen(model)) OVER (ORDER BY used DESC, body_hash, model ROWS UNBOUNDED PRECEDING) AS upto FROM best WHERE 9 - created_ms <= 7
)
SELECT body_hash, model, created_ms, used AS used_ms, round(vector[1], 6) AS first_value FROM fit WHERE upto <= 100000
""",
    "event_segments": sql([EVENTS, f"""lines AS (SELECT 'ev-' || lpad(CAST(event_id AS VARCHAR), 10, '0') AS id, at_ms,
      strlen('{{"at":' || at_ms || ',"data":{{' || concat_ws(',', {_json('action')}, {_json('dst')}, {_json('kind')}) || '}},"id":"ev-' || lpad(CAST(event_id AS VARCHAR), 10, '0') || '",' || coalesce('"note_id":"' || note_id || '",', '') || '"op":"' || op || '"}}') + 1 AS bytes FROM log)""",
      "cut AS (SELECT *, CAST((sum(bytes) OVER (ORDER BY at_ms, id ROWS UNBOUNDED PRECEDING) - bytes) // 65536 AS INT) AS segment FROM lines)"],
      "SELECT segment, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, arg_min(id, (at_ms, id)) AS first_id, arg_max(id, (at_ms, id)) AS last_id FROM cut GROUP BY 1"),
    "histories": sql([NOTES, EDGES, "rp AS (SELECT src, min(dst) AS dst FROM edges WHERE kind = 'replaces' GROUP BY 1)", "st AS (SELECT src AS id FROM edges WHERE kind = 'replaces' UNION SELECT id FROM notes WHERE superseded_by IS NOT NULL)",
      "old AS (SELECT id AS start, id, [id] AS way FROM st UNION ALL SELECT o.start, r.dst, list_append(o.way, r.dst) FROM old o JOIN rp r ON r.src = o.id WHERE NOT list_contains(o.way, r.dst))",
      "top AS (SELECT start, arg_max(id, len(way)) AS root FROM old GROUP BY 1)",
      "nw AS (SELECT start, root AS id, [root] AS way FROM top UNION ALL SELECT nw.start, n.superseded_by, list_append(nw.way, n.superseded_by) FROM nw JOIN notes n ON n.id = nw.id WHERE n.superseded_by IS NOT NULL AND NOT list_contains(nw.way, n.superseded_by))"],
      "SELECT start, id, CAST(len(way) - 1 AS BIGINT) AS step FROM nw", recursive=True),
    "critical_chain": sql([NOTES, EDGES, EVENTS, FLOWS, DEPENDS, CLOSURE("reach", "depends"), f"ring AS ({CYCLIC('reach')})",
      "ok_edges AS (SELECT d.* FROM depends d LEFT JOIN ring a ON a.id = d.src LEFT JOIN ring b ON b.id = d.dst WHERE a.component IS NULL OR b.component IS NULL OR a.component <> b.component)",
      f"dur AS (SELECT f.id, coalesce(closed_ms, {NOW}) - f.created_ms AS d FROM flows f JOIN notes n ON n.id = f.id)",
      "nodes AS (SELECT src AS id FROM ok_edges UNION SELECT dst FROM ok_edges UNION SELECT id FROM dur), nd AS (SELECT id, coalesce(d, 0) AS d FROM nodes LEFT JOIN dur USING (id))",
      "walk AS (SELECT id, id AS tip, d AS total, [id] AS way FROM nd UNION ALL SELECT w.id, e.dst, w.total + nd.d, list_append(w.way, e.dst) FROM walk w JOIN ok_edges e ON e.src = w.tip JOIN nd ON nd.id = e.dst)",
      "best AS (SELECT id, way FROM walk QUALIFY row_number() OVER (PARTITION BY id ORDER BY total DESC, len(way) DESC, way) = 1)"],
      "SELECT id AS start, CAST(p - 1 AS BIGINT) AS position, way[p] AS id FROM (SELECT id, way, unnest(range(1, len(way) + 1)) AS p FROM best WHERE len(way) = (SELECT max(len(way)) FROM best))", recursive=True),
    "doctor_store": sql([NOTES, POSTINGS, EDGES, EVENTS, PATHS, FILES, NOW_FILES, DEPENDS, CLOSURE("reach", "depends"), INTEGRITY, PARENT, DEGREE, _dice("true", "'statement', 'body', 'tags'"),
      "roots AS (SELECT * FROM notes WHERE scope = 'epic' AND id NOT IN (SELECT id FROM parent))", "ra AS (SELECT id, unnest(anchors) AS a FROM roots)",
      f"orphans AS (SELECT path FROM now_files WHERE {MATCH("'src/*/doc_1.rs'", 'path')} AND NOT EXISTS (SELECT 1 FROM ra WHERE {EITHER('a', 'path')}))",
      f"bare AS (SELECT id, trim(body) = '' AS blank, {_slots()} AS slots FROM notes LEFT JOIN degree USING (id) WHERE coalesce(type, '') <> 'task' AND coalesce(scope, '') <> 'epic' AND status NOT IN ('superseded', 'forgotten'))",
      f"""cnt(k, "check", findings, fixable) AS (SELECT 1, 'schema', count(*), false FROM documents WHERE coalesce(text, '') = '' UNION ALL SELECT 2, 'integrity', count(*), false FROM issues UNION ALL SELECT 3, 'cycles', count(*), false FROM ({CYCLIC('reach')})
      UNION ALL SELECT 4, 'anchors', count(*), true FROM files f LEFT JOIN now_files n USING (path) WHERE n.h IS NULL OR n.h <> f.h
      UNION ALL SELECT 5, 'program_anchor', (SELECT count(*) FROM roots WHERE NOT EXISTS (SELECT 1 FROM ra WHERE ra.id = roots.id AND {EITHER('a', "'src/*/doc_1.rs'")})) + (SELECT count(*) FROM orphans), false
      UNION ALL SELECT 6, 'duplicates', count(*), false FROM props UNION ALL SELECT 7, 'locks', count(*), true FROM log WHERE op = 'write' AND {NOW} - at_ms >= 60000 UNION ALL SELECT 8, 'config', 1, false
      UNION ALL SELECT 9, 'body_hash', count(*), true FROM notes WHERE doc_id % 13 = 0 UNION ALL SELECT 10, 'events', count(*), false FROM log WHERE event_id % 10 = 3 AND op IN ('forget', 'write')
      UNION ALL SELECT 11, 'derived', count(*), true FROM notes WHERE doc_id % 17 = 0 OR doc_id % 19 = 0 UNION ALL SELECT 12, 'embeddings', 1, false UNION ALL SELECT 13, 'body', count(*), false FROM bare WHERE blank OR slots <> '')"""],
      'SELECT "check", findings, findings = 0 AS ok, fixable FROM cnt', recursive=True),
} | {
    name: sql([NOTES, EDGES, EVENTS, VECTORS, DEPENDS, CLOSURE("reach", "depends"),
      "lastr AS (SELECT note_id AS id, max((at_ms, event_id)) AS l, arg_max(op, (at_ms, event_id)) AS reason, max(at_ms) AS retired_at FROM log WHERE op IN ('forget', 'supersede') AND note_id IS NOT NULL GROUP BY 1)",
      "rest AS (SELECT note_id AS id, max((at_ms, event_id)) AS r FROM log WHERE op = 'restore' GROUP BY 1)",
      f"gone AS (SELECT l.id, retired_at, reason FROM lastr l LEFT JOIN rest USING (id) WHERE retired_at + 30 * CAST(86400000 AS BIGINT) <= {NOW} AND (r IS NULL OR r <= l.l) AND l.id IN (SELECT id FROM notes) AND l.id NOT IN (SELECT id FROM ({CYCLIC('reach')})))",
      "kept AS (SELECT * FROM edges WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone))", "live AS (SELECT * FROM notes WHERE id NOT IN (SELECT id FROM gone))"], select, recursive=True)
    for name, select in (
        ("purge_due", "SELECT g.id, retired_at, reason, (SELECT count(*) FROM edges e WHERE e.src = g.id OR e.dst = g.id) AS links, (SELECT count(*) FROM live n WHERE n.superseded_by = g.id) AS pointers FROM gone g"),
        ("purge_left", "SELECT 'notes' AS what, count(*) AS n FROM live UNION ALL SELECT 'links', count(*) FROM kept UNION ALL SELECT 'vectors', count(*) FROM vectors WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'pointers', count(*) FROM live WHERE superseded_by IS NOT NULL AND superseded_by NOT IN (SELECT id FROM gone) UNION ALL SELECT 'dangling', 0"),
    )
} | {
    "task_batch": sql([NOTES, EDGES, PARENT, f"""ops AS (SELECT doc_id AS line, CASE WHEN doc_id % 3 = 0 THEN id WHEN doc_id % 41 = 5 THEN 'n9999999999' END AS own, CASE WHEN doc_id % 37 = 4 THEN ' ' ELSE 'new item ' || doc_id END AS statement,
        CASE doc_id % 5 WHEN 1 THEN 'k' || (doc_id - 1) WHEN 2 THEN {note('(doc_id - 2)')} WHEN 3 THEN 'k' || (doc_id + 1) WHEN 4 THEN {note('(doc_id * 8 + 1)')} END AS parent, CASE WHEN doc_id % 5 = 1 THEN doc_id - 1 END AS by_,
        CASE doc_id % 7 WHEN 1 THEN 'issue' WHEN 2 THEN 'epic' WHEN 5 THEN 'odd' ELSE 'task' END AS made FROM notes)""",
      f"""tg AS (SELECT o.*, coalesce(own, 'task_' || lower(to_base(CAST('0x' || left(sha256('task' || chr(31) || {NORM('o.statement')}), 8) AS BIGINT), 36, 8))) AS target, n.id IS NOT NULL AS known, CASE WHEN own IS NULL THEN made ELSE coalesce(n.scope, 'task') END AS scope FROM ops o LEFT JOIN notes n ON n.id = o.own)""",
      """p1 AS (SELECT *, CASE WHEN own IS NOT NULL AND NOT known THEN 'unknown id' WHEN own IS NULL AND trim(statement) = '' THEN 'no statement' WHEN scope NOT IN ('epic', 'issue', 'task') THEN 'no scope of work' WHEN row_number() OVER (PARTITION BY target ORDER BY line) > 1 THEN 'changed twice' END AS problem FROM tg)""",
      """p2 AS (SELECT a.line, a.own, a.target, a.scope, a.by_, coalesce(b.target, a.parent) AS parent_id, coalesce(a.problem, CASE WHEN a.parent IS NOT NULL AND b.line IS NULL AND n.id IS NULL THEN 'unknown parent'
        WHEN a.parent IS NOT NULL AND NOT coalesce(list_position(['epic', 'issue', 'task'], CASE WHEN b.line IS NOT NULL THEN b.scope ELSE n.scope END) < list_position(['epic', 'issue', 'task'], a.scope), false) THEN 'parent of no higher rank' END) AS problem
        FROM p1 a LEFT JOIN p1 b ON b.line = a.by_ LEFT JOIN notes n ON n.id = coalesce(b.target, a.parent))""",
      "wants AS (SELECT line, parent_id AS src, target AS dst FROM p2 WHERE parent_id IS NOT NULL AND problem IS NULL)",
      "tree AS (SELECT parent AS src, id AS dst FROM parent WHERE id NOT IN (SELECT dst FROM wants) UNION SELECT src, dst FROM wants)", CLOSURE("reach", "tree"), f"ring AS ({CYCLIC('reach')})",
      "p3 AS (SELECT p.*, coalesce(problem, CASE WHEN line IN (SELECT line FROM wants w JOIN ring a ON a.id = w.src JOIN ring b ON b.id = w.dst AND b.component = a.component) THEN 'closes a cycle' END) AS problem_ FROM p2 p)",
      "lost AS (SELECT line FROM p3 WHERE problem_ IS NOT NULL UNION SELECT p.line FROM lost l JOIN p3 p ON p.by_ = l.line)"],
      "SELECT line, CASE WHEN own IS NULL THEN 'created' ELSE 'updated' END AS action, target, scope, parent_id, coalesce(problem_, CASE WHEN line IN (SELECT line FROM lost) THEN 'its parent is rejected' END) AS problem FROM p3", recursive=True),
} | {
    name: sql([NOTES, EDGES, f"""up AS (SELECT src, dst FROM edges WHERE kind = 'broader' UNION SELECT dst, src FROM edges WHERE kind = 'narrower' UNION SELECT {note('doc_id')}, {note('doc_id // 2')} FROM documents WHERE doc_id % 30 = 11 AND doc_id > 30
      UNION SELECT {note('doc_id // 3')}, {note('doc_id')} FROM documents WHERE doc_id % 90 = 9)""", CLOSURE("reach", "up")], select, recursive=True)
    for name, select in (("broader_narrower", "SELECT src, dst FROM reach"), ("hierarchy_cycles", CYCLIC("reach")))
} | {
    "link_suggestions": sql([VECTORS, EDGES, f"near AS (SELECT a.id AS src, b.id AS dst, round({COS}, 6) AS score FROM vectors a, vectors b WHERE a.id[-2:] IN ('00', '50') AND a.id <> b.id AND round({COS}, 6) >= 0.2e0 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round({COS}, 6) DESC, b.id) <= 8)"],
      "SELECT * FROM near n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE (e.src = n.src AND e.dst = n.dst) OR (e.src = n.dst AND e.dst = n.src))"),
    "confirmed_around": sql([NOTES, EDGES, TASKS, "near(id, h) AS (SELECT 'n0000000010', 0 UNION SELECT e.dst, h + 1 FROM near JOIN edges e ON e.src = near.id WHERE h < 3)"],
      "SELECT id, status, round(coalesce(task, 0e0), 6) AS task FROM notes LEFT JOIN task USING (id) WHERE id IN (SELECT id FROM near) AND list_has_any(tags, ['en', 'de']) AND status IN ('active', 'in_progress', 'blocked', 'closed')", recursive=True),
} | {
    name: sql([NOTES, EDGES, f"""pt AS (SELECT doc_id AS line, CASE WHEN doc_id % 29 = 7 THEN 'n9999999999' ELSE id END AS id, CASE WHEN doc_id % 12 = 2 THEN 'twin ' || doc_id // 24 WHEN doc_id % 4 = 1 THEN 'changed ' || doc_id END AS s,
        CASE WHEN doc_id % 5 = 0 THEN 'wrong' WHEN doc_id % 5 = 1 THEN left(sha256({NORM('statement')} || chr(10) || {NORM('body')}), 8) END AS expected FROM notes)""",
      f"rw AS (SELECT p.line, p.id, n.id IS NOT NULL AS known, n.type, n.doc_id % 4 AS revision, p.s IS NULL OR p.s = n.statement AS same, coalesce(p.s, n.statement) AS st, p.expected, left(sha256({NORM('n.statement')} || chr(10) || {NORM('n.body')}), 8) AS h FROM pt p LEFT JOIN notes n ON n.id = p.id)",
      f"nw AS (SELECT *, type || '_' || lower(to_base(CAST('0x' || left(sha256(type || chr(31) || {NORM('st')}), 8) AS BIGINT), 36, 8)) AS new_id_ FROM rw)",
      """pr AS (SELECT *, same OR new_id_ IS NULL AS stays, row_number() OVER (PARTITION BY id ORDER BY line) > 1 AS again, row_number() OVER (PARTITION BY new_id_ ORDER BY line) > 1 AS twin FROM nw)""",
      "oc AS (SELECT *, CASE WHEN NOT known THEN 'unknown id' WHEN expected IS NOT NULL AND expected <> h THEN 'another hash' WHEN again THEN 'patched twice' WHEN NOT stays AND twin THEN 'id is taken' END AS problem FROM pr)",
      "sup AS (SELECT id, new_id_ FROM oc WHERE problem IS NULL AND NOT stays)"], select)
    for name, select in (
        ("update_outcomes", "SELECT line, id, CASE WHEN problem IS NULL AND NOT stays THEN new_id_ END AS new_id, CASE WHEN problem IS NULL THEN CASE WHEN stays THEN 'revised' ELSE 'superseded' END END AS action, CAST(CASE WHEN problem IS NULL THEN revision + 1 END AS INT) AS revision, problem FROM oc"),
        ("update_effects", """SELECT 'status' AS what, key, count(*) AS n FROM (SELECT CASE WHEN id IN (SELECT id FROM sup) THEN 'superseded' ELSE status END AS key FROM notes UNION ALL SELECT 'active' FROM sup) GROUP BY ALL
          UNION ALL SELECT 'kind', kind, count(*) FROM (SELECT kind FROM edges UNION ALL SELECT kind FROM edges JOIN sup ON sup.id = src WHERE kind <> 'replaces' UNION ALL SELECT 'replaces' FROM sup) GROUP BY ALL
          UNION ALL SELECT 'op', CASE WHEN stays THEN 'update' ELSE 'supersede' END, count(*) FROM oc WHERE problem IS NULL GROUP BY ALL"""),
    )
}
