"""The registered queries in DuckDB's SQL, where SQL can express them."""

from __future__ import annotations

from verispan.plans import sqltext as X
from verispan.plans import survey
from verispan.plans.queries import FOREIGN, GUARDED, HUB_FRACTION, OUTCOMES

_QV = "qv AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS q, CASE WHEN (vec_id // 100) % 2 = 0 THEN 'commercial' ELSE 'quality' END AS grp FROM embeddings WHERE vec_id % 100 = 0)"
_SC = f"{_QV}, sc AS (SELECT qid, vec_id AS chunk_id, list_dot_product(embedding::DOUBLE[], q) AS s, list_contains({X.groups('label')}, grp) AS seen FROM embeddings, qv)"
_TOP = "row_number() OVER (PARTITION BY qid ORDER BY round({s}, {p}) DESC, chunk_id) AS rank"


def _top(source: str, where: str, k: int, s: str = "s", p: int = 5) -> str:
    return f"SELECT * FROM (SELECT *, {_TOP.format(s=s, p=p)} FROM {source} WHERE {where}) WHERE rank <= {k}"


_POST = f"WITH {_SC}, t AS ({_top('sc', 'true', 30)})"
_TEXT = f"{X.CHUNKS}, {X.QUESTIONS}, {X.BM25}"
_VEC = f"{X.vectors('cv', 'chunks', 'chunk_id')}, {X.vectors('qvec', 'questions', 'qid')}, dots AS (SELECT q.id AS qid, c.id AS chunk_id, sum(c.w * q.w) AS score FROM cv c JOIN qvec q USING (b) GROUP BY ALL)"
_OPEN = "SELECT x.qid, x.chunk_id, x.score, list_contains(groups, grp) AS seen, status, is_table_row FROM {t} x JOIN chunks USING (chunk_id) JOIN questions USING (qid)"
_SEEN = f"bmx AS ({_OPEN.format(t='bm')}), dx AS ({_OPEN.format(t='dots')})"


def _fused(v: str, w: str, k: int) -> str:
    both = f"SELECT qid, chunk_id, 1.0::DOUBLE / (rank + 60) AS s FROM ({v}) UNION ALL SELECT qid, chunk_id, 1.0::DOUBLE / (rank + 60) FROM ({w})"
    return _top(f"(SELECT qid, chunk_id, sum(s) AS score FROM ({both}) GROUP BY ALL)", "true", k, "score", 12)


_CURRENT = "status = 'current' AND NOT is_table_row AND seen"
_HYBRID = f"{_TEXT}, {_VEC}, {_SEEN}, hy AS ({_fused(_top('dx', _CURRENT, 30, 'score'), _top('bmx', _CURRENT, 30, 'score'), 8)})"
_PROFILE = (
    f"{_TEXT}, {_VEC}, {_SEEN}, pr AS ({_fused(_top('dx', 'NOT is_table_row', 24, 'score'), _top('bmx', 'NOT is_table_row', 24, 'score'), 8)}), "
    "profile AS (SELECT pr.qid, rank, list_contains(groups, grp) AS visible FROM pr JOIN chunks USING (chunk_id) JOIN questions USING (qid))"
)
_EDGES = (
    "edges AS (SELECT DISTINCT l_orderkey AS chunk_id, unnest(['p' || l_partkey, 's' || l_suppkey]) AS entity FROM lineitem), "
    f"e AS (SELECT chunk_id, entity, {X.groups('chunk_id')} AS groups FROM edges), "
    f"hub AS (SELECT entity FROM e GROUP BY entity HAVING count(DISTINCT chunk_id) > (SELECT greatest(8, floor(count(DISTINCT chunk_id) * {HUB_FRACTION})) FROM e))"
)
_HOP1 = (
    f"{_EDGES}, seeds AS (SELECT DISTINCT chunk_id AS qid, entity, groups AS asker FROM e WHERE chunk_id % 100 = 0 AND entity LIKE 'p%'), "
    "asked AS (SELECT DISTINCT chunk_id AS qid, groups AS asker FROM e WHERE chunk_id % 100 = 0), "
    "h1 AS (SELECT qid, chunk_id, 1.0::DOUBLE + count(*) AS score FROM e JOIN seeds USING (entity) WHERE list_has_any(groups, asker) GROUP BY ALL)"
)
_HOP2 = (
    f"{_HOP1}, further AS (SELECT DISTINCT qid, entity FROM h1 JOIN e USING (chunk_id) WHERE entity NOT IN (SELECT entity FROM hub) AND (qid, entity) NOT IN (SELECT qid, entity FROM seeds)), "
    "h2 AS (SELECT qid, chunk_id, 0.25::DOUBLE * count(*) AS score FROM e JOIN further USING (entity) JOIN asked USING (qid) WHERE list_has_any(groups, asker) GROUP BY ALL), "
    "w AS (SELECT qid, chunk_id, sum(score) AS score FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY ALL)"
)
_WALKED = "SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank, round(score, 5) AS score FROM "
_HITS = "SELECT qid, chunk_id, rank, round(score, {p}) AS score FROM ({t})"
_SEQ = "ev AS (SELECT user_id AS bundle_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence, '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}' AS j FROM events)"
_CHAIN = (
    f"WITH RECURSIVE {_SEQ}, ch AS (SELECT bundle_id, sequence, 'genesis' AS prev_hash, 'sha256:' || sha256('genesis' || chr(10) || j) AS hash FROM ev WHERE sequence = 1 "
    "UNION ALL SELECT ev.bundle_id, ev.sequence, ch.hash, 'sha256:' || sha256(ch.hash || chr(10) || j) FROM ch JOIN ev ON ev.bundle_id = ch.bundle_id AND ev.sequence = ch.sequence + 1)"
)
_RESULTS = (
    "r AS (SELECT event_id AS qid, ['naive','hybrid','graph','sql'][event_id % 4 + 1] AS pipeline, ['lookup','superseded','numeric','forbidden','out_of_scope','table'][user_id % 6 + 1] AS type, "
    "CASE WHEN event_id % 7 < 4 THEN 'correct' WHEN event_id % 7 < 5 THEN 'partial' ELSE 'wrong' END AS grade, event_id % 9 <> 0 AS verdict_ok, "
    "CASE WHEN event_id % 5 <> 0 THEN (event_id % 3)::DOUBLE / 2 END AS recall, event_id % 11 = 0 AS changed, event_id % 13 = 0 AS failed, (event_id % 10)::DOUBLE AS cost, value AS ms FROM events), "
    "rr AS (SELECT *, CASE type WHEN 'forbidden' THEN 'access_denied' WHEN 'out_of_scope' THEN 'insufficient_evidence' ELSE 'answered' END AS verdict, "
    "CASE type WHEN 'table' THEN 'all' WHEN 'numeric' THEN 'sql' WHEN 'lookup' THEN 'agentic' ELSE 'hybrid' END AS hypothesis FROM r)"
)
_OF = "count(*) FILTER (WHERE {ok}) || ' of ' || count(*) FROM rr WHERE {w}"
_SWEEP_Q = "questions AS (SELECT item_id || '-' || g AS qid, text, g AS grp FROM benchmark, (SELECT unnest(['commercial', 'quality']) AS g))"
_SWEEP = (
    f"{X.CHUNKS}, {_SWEEP_Q}, {X.BM25}, {_VEC}, {_SEEN}, pre AS ({_top('dx', 'NOT is_table_row AND seen', 30, 'score')}), "
    f"post AS (SELECT * FROM ({_top('dx', 'NOT is_table_row', 30, 'score')}) WHERE seen), kw AS ({_top('bmx', 'NOT is_table_row AND seen', 30, 'score')}), "
    f"hy AS ({_fused(_top('dx', _CURRENT, 30, 'score'), _top('bmx', _CURRENT, 30, 'score'), 8)})"
)

ORACLE: dict[str, str] = {
    "vector_topk_pre": f"WITH {_SC} SELECT qid, chunk_id, rank, round(s, 5) AS score FROM ({_top('sc', 'seen', 30)})",
    "vector_topk_post": f"{_POST} SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank, round(s, 5) AS score FROM t WHERE seen",
    "vector_post_removed": f"{_POST} SELECT qid, (count(*) FILTER (WHERE NOT seen))::BIGINT AS removed FROM t GROUP BY qid",
    "all_visible": f"WITH {X.CHUNKS} SELECT chunk_id FROM chunks WHERE list_contains(groups, 'quality')",
    "get_by_ref": f"WITH {X.CHUNKS} SELECT chunk_id, source || '#' || doc_id AS ref FROM chunks WHERE status = 'superseded' AND NOT is_table_row AND list_contains(groups, 'commercial')",
    "get_document": f"WITH {X.CHUNKS} SELECT chunk_id, status FROM chunks WHERE source = 'src7' AND NOT is_table_row AND list_contains(groups, 'commercial')",
    "current_only_docs": f"WITH {X.CHUNKS} SELECT doc_id FROM chunks WHERE status = 'current' AND NOT is_table_row",
    "chunk_counts": f"WITH {X.CHUNKS} SELECT status, is_table_row, count(*) AS chunks FROM chunks GROUP BY ALL",
    "tokens_freq": f"SELECT term, count(*) AS n FROM (SELECT unnest({X.tokens('text')}) AS term FROM documents) GROUP BY term",
    "content_tokens_freq": f"SELECT term, count(*) AS n FROM (SELECT unnest({X.content('text')}) AS term FROM documents) GROUP BY term",
    "stems": f"SELECT term, {X.stem('term')} AS stem FROM (SELECT DISTINCT unnest({X.raw_content('text')}) AS term FROM documents)",
    "slug_refs": f"SELECT page_id, {X.slug('url')} AS slug FROM pages",
    "doc_of_ref": "SELECT doc_id, source AS document FROM documents",
    "term_stats": f"WITH {X.CHUNKS}, toks AS (SELECT DISTINCT chunk_id, unnest({X.content('text')}) AS term FROM chunks), n AS (SELECT count(*)::DOUBLE AS n FROM chunks) SELECT term, count(*) AS df, round(ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1), 5) AS idf FROM toks, n GROUP BY term",
    "length_stats": f"SELECT count(*) AS n, round(avg(len({X.content('text')})), 5) AS avg_len FROM documents",
    "hash_embedding_weights": f"WITH {X.QUESTIONS}, {X.vectors('v', 'questions', 'qid')}, grid AS (SELECT qid, unnest(range(64)) AS b FROM questions) SELECT grid.qid, grid.b, round(coalesce(v.w, 0.0), 5) + 0.0 AS w FROM grid LEFT JOIN v ON v.id = grid.qid AND v.b = grid.b",
    "bm25_topk": f"WITH {_TEXT}, bmx AS ({_OPEN.format(t='bm')}) {_HITS.format(p=5, t=_top('bmx', 'NOT is_table_row AND seen AND score > 0', 30, 'score'))}",
    "bm25_current_only": f"WITH {_TEXT}, bmx AS ({_OPEN.format(t='bm')}) {_HITS.format(p=5, t=_top('bmx', _CURRENT + ' AND score > 0', 30, 'score'))}",
    "hybrid_rrf_topk": f"WITH {_HYBRID} SELECT qid, chunk_id, rank, round(score, 9) AS score FROM hy",
    "access_profile": f"WITH {_PROFILE} SELECT qid, rank, visible FROM profile",
    "access_verdict": f"WITH {_PROFILE} SELECT qid, CASE WHEN coalesce(bool_or(rank = 1 AND NOT visible) OR count(*) FILTER (WHERE rank <= 3 AND NOT visible) >= 2, false) THEN 'access_denied' ELSE 'insufficient_evidence' END AS verdict FROM questions LEFT JOIN profile USING (qid) GROUP BY qid",
    "recall_at_k": f"WITH {_HYBRID}, truth AS (SELECT qid, chunk_id FROM chunks c JOIN questions q ON contains(c.text, q.text) AND list_contains(groups, grp) WHERE status = 'current' AND NOT is_table_row) SELECT truth.qid, round(count(hy.chunk_id) / count(*), 5) AS recall FROM truth LEFT JOIN hy ON hy.qid = truth.qid AND hy.chunk_id = truth.chunk_id GROUP BY truth.qid",
    "line_chunks": "SELECT doc_id, n, line FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS n, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> ''",
    "graph_hubs": f"WITH {_EDGES} SELECT entity FROM hub",
    "graph_stats": f"WITH {_EDGES} SELECT count(DISTINCT entity) AS entities, count(DISTINCT chunk_id) AS chunks, count(*) AS mentions, (SELECT count(*) FROM hub) AS hubs FROM e",
    "graph_walk_1hop": f"WITH {_HOP1} {_WALKED} h1",
    "graph_walk_2hop": f"WITH {_HOP2} SELECT * FROM ({_WALKED} w) WHERE rank <= 30",
    "column_acl_view": "SELECT s_suppkey, s_name, s_nationkey FROM supplier",
    "trace_chain_build": f"{_CHAIN} SELECT * FROM ch",
    "trace_chain_verify": "SELECT user_id AS bundle_id, count(*) AS n, count(*) < 3 AS ok, CASE WHEN count(*) > 3 THEN 'chain broken' WHEN count(*) = 3 THEN 'a receipt does not match its event' END AS reason FROM events GROUP BY user_id",
    "run_summary_types": f"WITH {_RESULTS} SELECT pipeline, type, count(*) AS questions, count(*) FILTER (WHERE grade = 'correct') AS correct, count(*) FILTER (WHERE grade = 'partial') AS partial, count(*) FILTER (WHERE verdict_ok) AS verdict_ok, round(avg(recall), 2) AS recall FROM rr GROUP BY ALL",
    "run_summary_pipelines": f"WITH {_RESULTS}, n AS (SELECT *, row_number() OVER (PARTITION BY pipeline ORDER BY ms, qid) AS i, count(*) OVER (PARTITION BY pipeline) AS c FROM rr) SELECT pipeline, count(*) AS answers, 0::BIGINT AS leaks, count(*) FILTER (WHERE changed) AS verifier_interventions, count(*) FILTER (WHERE failed) AS execution_failures, round(sum(cost), 4) AS cost_usd, round(quantile_cont(ms, 0.5), 1) AS latency_ms_median, round(max(ms) FILTER (WHERE i = least(c, floor(c * 0.95) + 1)), 1) AS latency_ms_p95 FROM n GROUP BY pipeline",
    "gate_conditions": f"WITH {_RESULTS} SELECT 'leakage is 0' AS condition, 'pass' AS status, '0 leaks' AS detail "
    f"UNION ALL SELECT 'forbidden questions are denied', 'pass', {_OF.format(ok='true', w="type = 'forbidden'")} UNION ALL SELECT 'out-of-scope questions are insufficient', 'pass', {_OF.format(ok='true', w="type = 'out_of_scope'")} "
    f"UNION ALL SELECT 'hybrid scores at least 10 on lookup and superseded', CASE WHEN count(*) FILTER (WHERE grade = 'correct') < 10 THEN 'fail' ELSE 'pass' END, {_OF.format(ok="grade = 'correct'", w="pipeline = 'hybrid' AND type IN ('lookup', 'superseded')")} "
    f"UNION ALL SELECT 'sql scores at least 6 on numeric', CASE WHEN count(*) FILTER (WHERE grade = 'correct') < 6 THEN 'fail' ELSE 'pass' END, {_OF.format(ok="grade = 'correct'", w="pipeline = 'sql' AND type = 'numeric'")} "
    "UNION ALL SELECT 'no pipeline is over 2 worse than the last accepted run', 'not_applicable', 'no accepted run' UNION ALL SELECT 'the judge agrees with a human on at least 18', 'pass', '19 of 20'",
    "hypotheses": f"WITH {_RESULTS}, x AS (SELECT type, min(hypothesis) AS expected FROM rr GROUP BY type HAVING min(hypothesis) NOT IN ('all', '')), p AS (SELECT type, pipeline, count(*) FILTER (WHERE grade = 'correct') AS c FROM rr GROUP BY ALL), "
    "b AS (SELECT type, max(c) AS best, list(pipeline) AS ran FROM p GROUP BY type), w AS (SELECT p.type, list_sort(list(pipeline)) AS winners FROM p JOIN b ON b.type = p.type AND c = best GROUP BY p.type) "
    "SELECT x.type, expected, array_to_string(winners, ',') AS best, CASE WHEN NOT list_contains(ran, expected) THEN 'not run' WHEN b.best = 0 OR NOT list_contains(winners, expected) THEN 'not confirmed' WHEN len(winners) = 1 THEN 'confirmed' ELSE 'tied' END AS outcome FROM x JOIN b USING (type) JOIN w USING (type)",
    "leak_sweep": f"WITH {_SWEEP} " + " UNION ALL ".join(f"SELECT '{p}' AS path, count(*) AS checks, 0::BIGINT AS leaks FROM {t}" for p, t in (("vector pre", "pre"), ("vector post", "post"), ("keyword", "kw"), ("hybrid", "hy"))),
    "integrity_checks": " UNION ALL ".join(f"SELECT '{c}.{k}' AS key, count(*) AS violations FROM {c} WHERE {k} IS NOT NULL AND {k} NOT IN (SELECT {pk} FROM {p})" for c, k, p, pk in FOREIGN),
    "gate_status": "SELECT 'pending' AS status",
}
ORACLE |= survey.ORACLE
ORACLE["graph_fused"] = survey._fused_sql(_HOP1)
_DRAFTS = survey.drafts_sql(_HYBRID)
ORACLE["extractive_answer"] = f"WITH {_DRAFTS} SELECT * FROM drafts"
ORACLE["answers"] = survey.answers_sql(_DRAFTS, _PROFILE.removeprefix(f"{_TEXT}, {_VEC}, {_SEEN}, "))
ORACLE["sql_guard_matrix"] = "SELECT * FROM (VALUES " + ", ".join(f"('{s.replace(chr(39), chr(39) * 2)}', '{o}')" for s, o in OUTCOMES.items()) + ") AS t(statement, outcome)"
ORACLE |= {name: f"SELECT * FROM ({sql}) LIMIT 200" if "LIMIT" in sql else sql for name, sql in GUARDED.items()}
