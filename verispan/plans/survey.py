"""Further queries, one for each operator that the tables at hand don't reach by themselves; each stands beside its SQL.

Texts with record ids, citations, figures, tables and front matter are made from whole
numbers and names of the tables, so that Spark and SQL make the same ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verispan.functions import text as T
from verispan.models import MESSAGES, FunctionLLM
from verispan.operators import ann
from verispan.operators import answer as A
from verispan.operators import evaluate as E
from verispan.operators import graph as G
from verispan.operators import ingest as I
from verispan.operators import modelled as M
from verispan.operators import search as S
from verispan.operators import trace as R
from verispan.operators.guard import as_text
from verispan.plans import bindings as B
from verispan.plans import sqltext as X
from verispan.plans.queries import QUERIES, _walk, guard
from verispan.session import shared_folder
from verispan.sources import corpus, sinks

ORACLE: dict[str, str] = {}


def query(sql: str) -> Callable:
    """Register a query with its SQL."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return keep


# --- record ids, figures, sentences -------------------------------------------------------

#: RE2 has no look-around: each sign but a dot is doubled, so that one can end a figure and another begin the next.
_IDS = r"\b(?:SOP|DEV|CC|DR|AF|MEMO|SPEC|P|B)-[0-9A-Z]+(?:-[0-9A-Za-z]+)*\b"
_W = r"\p{L}\p{M}\p{N}_"


def _sql_numbers(t: str) -> str:
    doubled = rf"regexp_replace(regexp_replace({t}, '{_IDS}', ' ', 'g'), '([^{_W}.-])', '\1\1', 'g')"
    found = rf"regexp_extract_all({doubled}, '(?:^|[^{_W}.-])(-?\d+(?:,,\d{{3}})*(?:\.\d+)?)(?:$|[^{_W}-])', 1)"
    return f"list_transform({found}, lambda n: CASE WHEN contains(n, '.') THEN rtrim(rtrim(replace(n, ',', ''), '0'), '.') ELSE replace(n, ',', '') END)"


def _sql_sentences(t: str) -> str:
    blocks = rf"regexp_replace(regexp_replace(regexp_replace({t}, '^\s+|\s+$', '', 'g'), '\n{{2,}}', chr(1), 'g'), '\n([-|\d])', chr(1) || '\1', 'g')"
    cut = rf"regexp_replace({blocks}, '([.!?])\s+([A-Z0-9\[])', '\1' || chr(1) || '\2', 'g')"
    return rf"list_filter(list_transform(string_split({cut}, chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"


ORACLE["record_ids"] = f"SELECT doc_id, array_to_string(regexp_extract_all(text, '{_IDS}'), ' ') AS ids FROM documents"
ORACLE["numbers"] = f"SELECT doc_id, array_to_string({_sql_numbers('text')}, ' ') AS numbers FROM documents"
ORACLE["sentence_counts"] = f"SELECT doc_id, len({_sql_sentences('text')})::BIGINT AS sentences FROM documents"
ORACLE["embedding_features"] = f"SELECT f AS term, count(*) AS n FROM ({X.feature_rows('benchmark', 'item_id')}) GROUP BY f"

_NOTE = (
    "'Lot B-' || (o_custkey % 40) || 'K-v' || (o_orderkey % 4) || ' follows SPEC-P' || (o_custkey % 7) || '-' || (o_orderkey % 3) || ', see MEMO-' || o_orderkey || '. '"
    " || (o_orderkey % 9) || ',' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') || ' vials, ' || (o_orderkey % 50) || '.' || (o_custkey % 10) || '0 kg; x' || o_orderkey || ' isn''t one.'"
)


def _notes(spark, d) -> DataFrame:
    """Orders as short notes with record ids and figures."""
    note = F.expr(_NOTE.replace("AS VARCHAR", "AS STRING").replace("isn''t", "isn\\'t"))
    return B.table(spark, d, "orders").select("o_orderkey", "o_custkey", note.alias("note"))


_NOTES = f"notes AS (SELECT o_orderkey, o_custkey, {_NOTE} AS note FROM orders)"


@query(f"WITH {_NOTES} SELECT o_orderkey, array_to_string(regexp_extract_all(note, '{_IDS}'), ' ') AS ids, array_to_string({_sql_numbers('note')}, ' ') AS numbers FROM notes")
def note_ids_and_numbers(spark, d):
    n = F.col("note")
    return _notes(spark, d).select("o_orderkey", F.array_join(T.record_ids(n), " ").alias("ids"), F.array_join(T.numbers(n), " ").alias("numbers"))


_NORMAL = rf"regexp_replace(regexp_replace(x, '-v\d+$', ''), '^SPEC-', '')"
_ENTITIES = f"list_sort(list_distinct(list_concat(list_transform(regexp_extract_all(note, '{_IDS}'), lambda x: {_NORMAL}), CASE WHEN contains(lower(note), 'vials') THEN ['site:9'] ELSE [] END)))"


@query(f"WITH {_NOTES} SELECT o_orderkey, array_to_string({_ENTITIES}, ' ') AS entities FROM notes")
def note_entities(spark, d):
    names = F.array(F.struct(F.lit("vials").alias("name"), F.lit("site:9").alias("entity")), F.struct(F.lit("nowhere").alias("name"), F.lit("site:1").alias("entity")))
    return _notes(spark, d).select("o_orderkey", F.array_join(F.sort_array(T.entities(F.col("note"), names)), " ").alias("entities"))


# --- search by identifiers, rerankers, other cuts -----------------------------------------

_NOTE_CHUNKS = (
    f"{_NOTES}, chunks AS (SELECT o_orderkey AS chunk_id, note AS text, {X.groups('o_custkey')} AS groups, 'current' AS status, false AS is_table_row FROM notes), "
    "questions AS (SELECT o_orderkey AS qid, 'which lot follows B-' || (o_custkey % 40) || 'K-v' || (o_orderkey % 4) || ' or MEMO-' || (o_orderkey + 32) AS text, "
    "CASE WHEN o_orderkey % 200 = 0 THEN 'commercial' ELSE 'quality' END AS grp FROM notes WHERE o_orderkey % 100 = 0)"
)


def _note_chunks(spark, d) -> tuple[DataFrame, DataFrame]:
    """Notes as chunks, and of orders with an id divisible by 100 a question for a lot and a memo."""
    notes = _notes(spark, d)
    chunks = notes.select(F.col("o_orderkey").alias("chunk_id"), F.col("note").alias("text"), B.groups_of(F.col("o_custkey")).alias("groups"), F.lit("current").alias("status"), F.lit(False).alias("is_table_row"), F.lit("").alias("context"))
    asked = F.expr("'which lot follows B-' || (o_custkey % 40) || 'K-v' || (o_orderkey % 4) || ' or MEMO-' || (o_orderkey + 32)")
    grp = F.when(F.col("o_orderkey") % 200 == 0, "commercial").otherwise("quality")
    return chunks, notes.filter("o_orderkey % 100 = 0").select(F.col("o_orderkey").alias("qid"), asked.alias("text"), F.array(grp).alias("groups"))


_BOTH_IDS = f"len(list_intersect(list_distinct(regexp_extract_all(c.text, '{_IDS}')), list_distinct(regexp_extract_all(q.text, '{_IDS}'))))"
_BOOSTED = f"SELECT qid, chunk_id, score + 2 * {_BOTH_IDS} AS score FROM bm JOIN chunks c USING (chunk_id) JOIN questions q USING (qid) WHERE score > 0 AND list_contains(groups, grp)"
_RANKED = "row_number() OVER (PARTITION BY qid ORDER BY round(score, 5) DESC, chunk_id)"


@query(f"WITH {_NOTE_CHUNKS}, {X.BM25}, b AS ({_BOOSTED}) SELECT * FROM (SELECT qid, chunk_id, {_RANKED} AS rank, round(score, 5) AS score FROM b) WHERE rank <= 30")
def keyword_with_identifiers(spark, d):
    hits = S.keyword_search(*_note_chunks(spark, d), ident_boost=2.0)
    return hits.select("qid", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 5).alias("score"))


@query(f"WITH {_NOTE_CHUNKS} SELECT q.qid, c.chunk_id FROM chunks c JOIN questions q ON list_contains(groups, grp) AND list_has_any(regexp_extract_all(c.text, '{_IDS}'), regexp_extract_all(q.text, '{_IDS}'))")
def identifier_matches(spark, d):
    return S.by_identifiers(*_note_chunks(spark, d)).select("qid", "chunk_id")


_VECS = (
    "qv AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS q, CASE WHEN (vec_id // 100) % 2 = 0 THEN 'commercial' ELSE 'quality' END AS grp FROM embeddings WHERE vec_id % 100 = 0), "
    f"sc AS (SELECT qid, vec_id AS chunk_id, list_dot_product(embedding::DOUBLE[], q) AS score FROM embeddings, qv WHERE list_contains({X.groups('label')}, grp))"
)
_TOP30 = f"top AS (SELECT * FROM (SELECT *, {_RANKED} AS rank FROM sc) WHERE rank <= 30)"


@query(f"WITH {_VECS}, cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS r FROM sc) WHERE r <= 30) SELECT qid, chunk_id, {_RANKED} AS rank, round(score, 5) AS score FROM cut")
def vector_topk_unrounded_cut(spark, d):
    hits = S.vector_search(B.vector_chunks(spark, d), B.vector_questions(spark, d), cut_places=None).hits
    return hits.select("qid", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 5).alias("score"))


@query(f"WITH {_VECS}, {_TOP30}, f AS (SELECT qid, chunk_id, 1.0::DOUBLE / (rank + 60) AS score FROM top), r AS (SELECT qid, chunk_id, score * (1 + chunk_id % 3) AS score FROM f) SELECT qid, chunk_id, rank FROM (SELECT *, {_RANKED} AS rank FROM r) WHERE rank <= 8")
def reranked_topk(spark, d):
    """Fused candidates under a reranker, here one that prefers some ids."""
    hits = S.vector_search(B.vector_chunks(spark, d), B.vector_questions(spark, d)).hits
    prefer = lambda df: df.withColumn("score", F.col("score") * (1 + F.col("chunk_id") % 3))
    return S.reranked(S.rrf([hits], limit=30), prefer, 8).select("qid", "chunk_id", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_VECS}, {_TOP30}, r AS (SELECT qid, 'page-' || (chunk_id % 9) AS ref, min(rank) AS r FROM top GROUP BY ALL) SELECT qid, string_agg(ref, ' ' ORDER BY r, ref) AS refs FROM r GROUP BY qid")
def distinct_refs_in_order(spark, d):
    chunks = B.vector_chunks(spark, d).withColumn("ref", F.concat(F.lit("page-"), (F.col("chunk_id") % 9).cast("string")))
    hits = S.vector_search(chunks, B.vector_questions(spark, d)).hits
    return A.retrieved_refs(hits, chunks).select("qid", F.array_join("retrieved_refs", " ").alias("refs"))


@query(f"WITH {_VECS}, {_TOP30} SELECT qid, string_agg('[' || rank || '] (v' || chunk_id || ' / part)' || chr(10) || 'text of ' || chunk_id, chr(10) || chr(10) ORDER BY rank) AS sources FROM top GROUP BY qid")
def numbered_sources(spark, d):
    c = F.col("chunk_id").cast("string")
    chunks = B.vector_chunks(spark, d).withColumns({"title": F.concat(F.lit("v"), c), "section": F.lit("part"), "text": F.concat(F.lit("text of "), c)})
    return A.numbered_sources(S.vector_search(chunks, B.vector_questions(spark, d)).hits, chunks)


_POST = (
    "qv AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS q, CASE WHEN (vec_id // 100) % 2 = 0 THEN 'commercial' ELSE 'quality' END AS grp FROM embeddings WHERE vec_id % 100 = 0), "
    f"al AS (SELECT qid, vec_id AS chunk_id, list_dot_product(embedding::DOUBLE[], q) AS score, list_contains({X.groups('label')}, grp) AS seen FROM embeddings, qv), "
    f"t8 AS (SELECT * FROM (SELECT *, {_RANKED} AS r FROM al) WHERE r <= 8)"
)


@query(
    f"WITH {_POST}, n AS (SELECT qid, count(*) FILTER (WHERE NOT seen) AS gone, coalesce(string_agg(chunk_id::VARCHAR, ' ' ORDER BY r) FILTER (WHERE seen), '') AS refs FROM t8 GROUP BY qid) SELECT qid, refs, "
    "CASE WHEN gone > 0 THEN gone END AS removed, CASE WHEN gone = 1 THEN '1 inaccessible candidate was removed after ranking.' WHEN gone > 1 THEN gone || ' inaccessible candidates were removed after ranking.' END AS note FROM n"
)
def trace_visible_hits(spark, d):
    """The public payload of a search, read back from its JSON."""
    found = S.vector_search(B.vector_chunks(spark, d), B.vector_questions(spark, d), k=8, mode="post")
    p = F.from_json("payload", "hits array<struct<ref:string,score:double,source:string>>, note string, removed_by_access_filter long")
    rows = R.visible_hits(found.hits, found.removed).select("qid", p.alias("p"))
    return rows.select("qid", F.array_join(F.transform("p.hits", lambda h: h["ref"]), " ").alias("refs"), F.col("p.removed_by_access_filter").alias("removed"), F.col("p.note").alias("note"))


@query("SELECT user_id, event_id, array_to_string(['SOP-' || user_id || '#x', 'd#' || (event_id % 7)], ' ') AS refs FROM events")
def refs_in_payloads(spark, d):
    payload = F.expr("""'{"hits": [{"ref": "SOP-' || user_id || '#x"}, {"ref":   "d#' || (event_id % 7) || '"}], "refs": 1}'""")
    return B.table(spark, d, "events").select("user_id", "event_id", F.array_join(R.refs_in(payload), " ").alias("refs"))


@query("SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN event_type END AS action, CASE WHEN event_id % 5 <> 0 THEN 'user ' || user_id END AS input FROM events")
def model_actions(spark, d):
    """Replies of a model with a JSON action inside; every fifth has none."""
    said = F.expr("""CASE event_id % 5 WHEN 0 THEN 'no {"input": "x"} here' ELSE 'so: {"action": "' || event_type || '", "input": "user ' || user_id || '"}. Done' END""")
    got = T.action(said)
    return B.table(spark, d, "events").select("event_id", got["action"].alias("action"), got["input"].alias("input"))


# --- citations, claims, answers, facts ----------------------------------------------------

_MARKS = "'[' || (conv_id % 7) || '] then [' || (turn % 4) || '] and [2][' || (conv_id % 7) || '] [99]'"
_ALL_MARKS = "[conv_id % 7, turn % 4, 2, conv_id % 7, 99]"


@query(f"WITH x AS (SELECT conv_id, turn, {_ALL_MARKS} AS l FROM conversations) SELECT conv_id, turn, array_to_string(list_filter(l, lambda n, i: n BETWEEN 1 AND 5 AND list_position(l, n) = i), ' ') AS cited FROM x")
def citations_parsed(spark, d):
    return B.table(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.cited_numbers(F.expr(_MARKS), F.lit(5)).cast("array<string>"), " ").alias("cited"))


_ANSWER = "'Lot ' || p_partkey || ' is kept. It weighs ' || p_size || ' kg [1][' || (p_partkey % 5) || ']. Doors stay shut [3]. No source for ' || p_size"


@query(
    "SELECT p_partkey, 0 AS c, 'Lot ' || p_partkey || ' is kept.' AS claim, '1 ' || (p_partkey % 5) AS cites FROM part UNION ALL "
    "SELECT p_partkey, 1, 'It weighs ' || p_size || ' kg', '1 ' || (p_partkey % 5) FROM part UNION ALL "
    "SELECT p_partkey, 2, 'Doors stay shut', '3' FROM part UNION ALL SELECT p_partkey, 3, 'No source for ' || p_size, '' FROM part"
)
def claims_split(spark, d):
    rows = B.table(spark, d, "part").select("p_partkey", F.posexplode(T.claims(F.expr(_ANSWER))).alias("c", "x"))
    return rows.select("p_partkey", "c", F.col("x.text").alias("claim"), F.array_join(F.col("x.cites").cast("array<string>"), " ").alias("cites"))


_CONV = (
    "t AS (SELECT conv_id || '-' || turn AS qid, role, coalesce(text, '') AS said, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, text) AS asked FROM conversations), "
    "a AS (SELECT qid, said, asked FROM t WHERE role = 'assistant' AND asked IS NOT NULL)"
)
# The marker stands after the last sentence, so each sentence of the turn cites the turn before; the stop after the marker is no claim.
_CLAIMS = f"c AS (SELECT qid, asked, unnest({_sql_sentences('said')}) AS claim FROM a), cc AS (SELECT qid, asked, claim FROM c WHERE regexp_replace(claim, '^[ .\\n]+|[ .\\n]+$', '', 'g') <> '')"
_HOLDS = (
    f"coalesce(len(list_intersect(list_distinct({X.content('claim')}), {X.content('asked')}))::DOUBLE / nullif(len(list_distinct({X.content('claim')})), 0), 1.0) >= 0.6 "
    f"AND list_has_all({_sql_numbers('asked')}, {_sql_numbers('claim')}) AND list_has_all(regexp_extract_all(asked, '{_IDS}'), regexp_extract_all(claim, '{_IDS}'))"
)
ORACLE["claim_verify"] = (
    f"WITH {_CONV}, {_CLAIMS}, j AS (SELECT qid, {_HOLDS} AS ok FROM cc), n AS (SELECT qid, count(*) AS claims, count(*) FILTER (WHERE NOT ok) AS bad FROM j GROUP BY qid) "
    "SELECT qid, coalesce(claims, 0)::BIGINT AS claims, coalesce(bad, 0)::BIGINT AS unsupported, coalesce(bad, 0) = 0 AS supported, round(coalesce((claims - bad)::DOUBLE / claims, 1.0), 5) AS support FROM a LEFT JOIN n USING (qid)"
)

_FACT_TEXT = "'It took ' || (p_partkey % 30) || ' hours and weighs ' || p_size || '.50 kg, says ' || p_brand"


@query(
    "WITH n AS (SELECT p_partkey, (p_partkey % 30 = 4)::INT + 1 + (p_partkey % 30 = p_size OR regexp_extract(p_brand, '[0-9]+')::INT = p_size OR p_partkey % 2 = 0)::INT + 1 AS found FROM part) "
    "SELECT p_partkey, found, CASE found WHEN 4 THEN 'correct' ELSE 'partial' END AS grade FROM n"
)
def facts_graded(spark, d):
    """A figure led by a digit, a figure with a trailing zero, one of two alternatives, and a name."""
    p = B.table(spark, d, "part")
    s = F.col("p_size").cast("string")
    facts = F.array(
        F.array(F.lit("4 hours")),
        F.array(F.concat(s, F.lit(".5"))),
        F.array(s, F.when(F.col("p_partkey") % 2 == 0, "it took").otherwise("nowhere")),
        F.array(F.lower("p_brand")),
    )
    text = F.expr(_FACT_TEXT)
    return p.select("p_partkey", T.facts_found(facts, text).alias("found"), E.grade(facts, text).alias("grade"))


def _scored(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Orders as golden questions, answers to them, an access list, and traces."""
    o = B.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("qid"), F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    none = F.array().cast("array<string>")
    s = lambda c: c.cast("string")
    doc = F.concat(F.lit("D"), s(F.col("c") % 10))
    questions = o.select(
        "qid", F.when(F.col("k") % 3 == 0, "numeric").otherwise("lookup").alias("type"), F.lit("").alias("hypothesis"),
        F.when(F.col("k") % 7 == 0, "access_denied").otherwise("answered").alias("expected_verdict"), F.array(F.lit("quality")).alias("groups"),
        F.array(F.array(s(F.col("c")))).alias("key_facts"), F.array(F.lit("90210")).alias("secret_facts"), F.array(F.concat(doc, F.lit("#a"))).alias("section_refs"),
        F.when(F.col("k") % 3 == 0, F.array(F.lit("table:batch"))).otherwise(none).alias("table_refs"),
    )
    cite = F.array(F.struct(F.lit(1).alias("n"), F.lit("chunk").alias("kind"), F.concat(F.lit("D"), s(F.col("k") % 12), F.lit("#c")).alias("ref")))
    text = F.concat(F.lit("It is "), s(F.col("c") + (F.col("k") % 2)), F.when(F.col("k") % 13 == 0, " or 90,210").otherwise(""), F.lit("."))
    answers = o.select(
        "qid", text.alias("text"), F.when(F.col("k") % 5 == 0, "access_denied").otherwise("answered").alias("verdict"), cite.alias("citations"),
        F.concat(F.array(F.concat(doc, F.lit("#a"))), F.when(F.col("k") % 6 == 0, F.array(F.lit("table:batch"))).otherwise(none)).alias("retrieved_refs"),
        F.lit(False).alias("verifier_changed"), F.lit(1.0).alias("support"),
    )
    acl = spark.createDataFrame([("D3", ["commercial"]), ("D4", ["quality", "commercial"]), ("D11", ["commercial"]), ("D8", ["admin"])], "document_id string, groups array<string>")
    payload = F.concat(F.lit('{"hits":[{"ref": "D'), s(F.col("k") % 17), F.lit('#t"}]}'))
    return questions, answers, acl, o.select("qid", payload.alias("payload"))


_LEAK = (
    "CASE WHEN o_custkey % 10 IN (3, 8) THEN 'restricted evidence reached the answer: D' || (o_custkey % 10) || '#a' "
    "WHEN o_orderkey % 12 IN (3, 8, 11) THEN 'restricted evidence reached the answer: D' || (o_orderkey % 12) || '#c' "
    "WHEN o_orderkey % 17 IN (3, 8, 11) THEN 'restricted reference in the public trace: D' || (o_orderkey % 17) || '#t' "
    "WHEN o_orderkey % 13 = 0 OR o_custkey + o_orderkey % 2 = 90210 THEN 'restricted value stated in the answer' ELSE '' END"
)


@query(f"SELECT o_orderkey::VARCHAR AS qid, {_LEAK} AS detail FROM orders")
def leaks_found(spark, d):
    return E.leaks(*_scored(spark, d))


@query(
    f"WITH o AS (SELECT *, o_orderkey % 5 = 0 AS denied, o_orderkey % 7 <> 0 AS expects, {_LEAK} <> '' AS leaked FROM orders), "
    "g AS (SELECT *, CASE WHEN NOT expects THEN NULL WHEN denied OR o_orderkey % 2 = 1 THEN 'wrong' ELSE 'correct' END AS first FROM o), "
    "l AS (SELECT *, coalesce(first, '') = 'correct' AND o_orderkey % 3 = 0 AND o_orderkey % 6 <> 0 AS luck FROM g) "
    "SELECT o_orderkey::VARCHAR AS qid, denied <> expects AS verdict_ok, CASE WHEN luck THEN 'wrong' ELSE first END AS grade, "
    "CASE WHEN expects THEN round((1 + (o_orderkey % 6 = 0)::INT)::DOUBLE / (1 + (o_orderkey % 3 = 0)::INT), 5) END AS recall, leaked, luck AS coincidental FROM l"
)
def answers_scored(spark, d):
    return E.score(*_scored(spark, d)).select("qid", "verdict_ok", "grade", F.round("recall", 5).alias("recall"), "leaked", "coincidental")


@query(
    f"WITH {_NOTES}, e AS (SELECT o_orderkey, len(list_intersect(list_distinct({X.content('note')}), list_distinct(['lot', {X.stem(chr(39) + 'vials' + chr(39))}, (o_custkey % 11)::VARCHAR, '3']))) AS hit, o_custkey % 100 AS qid FROM notes) "
    "SELECT * FROM (SELECT qid, o_orderkey AS chunk_id, row_number() OVER (PARTITION BY qid ORDER BY hit DESC, o_orderkey) AS rank FROM e) WHERE rank <= 12"
)
def agent_evidence(spark, d):
    rows = _notes(spark, d).select(
        (F.col("o_custkey") % 100).alias("qid"), F.col("o_orderkey").alias("chunk_id"), F.col("o_orderkey").alias("seen"), F.col("note").alias("text"), F.lit("").alias("context"),
        F.concat(F.lit("lot vials 3 "), (F.col("o_custkey") % 11).cast("string")).alias("question"),
    )
    return S.evidence_rank(rows).select("qid", "chunk_id", F.col("rank").cast("long").alias("rank"))


# --- documents, sections, tables -----------------------------------------------------------

_PAGE = (
    "'---\nid: SOP-' || s_suppkey || '\ntitle: \"' || s_name || '\"\ntype: sop\nversion: ' || (s_suppkey % 3) || '\ngroups: [quality, g' || (s_suppkey % 4) || ']\n' || CASE WHEN s_suppkey % 2 = 0 THEN 'status: superseded\nsuperseded_by: SOP-1\n' ELSE '' END "
    "|| '---\n# ignored\n\n## Cold & dry storage\nKept at ' || (s_suppkey % 9) || ' degrees.\n\n## Limits\n| Name | Limit | Name |\n|---|---|---|\n| heat | ' || s_nationkey || ' | last |\n| dust | none |\n'"
)


def _pages(spark, d) -> DataFrame:
    """Suppliers as documents with front matter and two sections."""
    return corpus.parse_documents(B.table(spark, d, "supplier").select(F.expr(_PAGE.replace("\n", "\\n")).alias("value")))


@query(
    "SELECT 'SOP-' || s_suppkey AS document_id, s_name AS title, 'sop' AS doc_type, (s_suppkey % 3)::VARCHAR AS version, CASE WHEN s_suppkey % 2 = 0 THEN 'superseded' ELSE 'current' END AS status, "
    "CASE WHEN s_suppkey % 2 = 0 THEN 'SOP-1' END AS superseded_by, 'quality g' || (s_suppkey % 4) AS groups, 2 AS sections FROM supplier"
)
def front_matter(spark, d):
    return _pages(spark, d).select("document_id", "title", "doc_type", "version", "status", "superseded_by", F.array_join("groups", " ").alias("groups"), F.size("sections").alias("sections"))


@query(
    "WITH s AS (SELECT 'SOP-' || s_suppkey AS id, * FROM supplier) SELECT id || '#cold-dry-storage' AS chunk_id, s_name || '. Section: Cold & dry storage.' AS context, 'Kept at ' || (s_suppkey % 9) || ' degrees.' AS text, false AS is_table_row FROM s UNION ALL "
    "SELECT id || '#limits', s_name || '. Section: Limits.', '| Name | Limit | Name |' || chr(10) || '|---|---|---|' || chr(10) || '| heat | ' || s_nationkey || ' | last |' || chr(10) || '| dust | none |', false FROM s UNION ALL "
    "SELECT id || '#limits@row1', s_name || '. Section: Limits.', 'Name: last; Limit: ' || s_nationkey, true FROM s UNION ALL SELECT id || '#limits@row2', s_name || '. Section: Limits.', 'Name: dust; Limit: none', true FROM s"
)
def section_chunks(spark, d):
    return I.chunk_documents(_pages(spark, d)).select("chunk_id", "context", "text", "is_table_row")


@query(
    "SELECT n_nationkey, 0 AS i, 'Before it.' AS unit FROM nation UNION ALL SELECT n_nationkey, 1, 'Name: ' || n_name || '; Key: ' || n_regionkey FROM nation UNION ALL SELECT n_nationkey, 2, 'Name: x; Key: y' FROM nation "
    "UNION ALL SELECT n_nationkey, 3, 'After it.' FROM nation"
)
def table_units(spark, d):
    t = F.expr("'Before it.\\n| Name | Key |\\n|---|---|\\n| ' || n_name || ' | ' || n_regionkey || ' |\\n| x | y |\\n\\nAfter it.'")
    return B.table(spark, d, "nation").select("n_nationkey", F.posexplode(T.table_units(t)).alias("i", "unit"))


@query("SELECT n_nationkey, 1 AS n, 'Name: ' || n_name || '; Key: ' || n_regionkey AS text FROM nation UNION ALL SELECT n_nationkey, 2, 'Name: x' FROM nation")
def markdown_rows(spark, d):
    t = F.expr("'text\\n| Name | Key |\\n|---|---|\\n| ' || n_name || ' | ' || n_regionkey || ' |\\n| x |\\nend'")
    rows = B.table(spark, d, "nation").select("n_nationkey", F.explode(T.markdown_rows(t)).alias("r"))
    return rows.select("n_nationkey", "r.n", "r.text")


_FILE = "'intro of ' || p_partkey || '\r\n# First\nbody ' || p_size || '\n\nmore\n## !!\nlast'"


@query(
    "SELECT 'file-' || p_partkey || '#1' AS chunk_id, 'Part 1' AS section, 'intro of ' || p_partkey AS text FROM part UNION ALL SELECT 'file-' || p_partkey || '#first-2', 'First', 'body ' || p_size || chr(10) || chr(10) || 'more' FROM part "
    "UNION ALL SELECT 'file-' || p_partkey || '#-3', '!!', 'last' FROM part"
)
def uploads_in_sections(spark, d):
    files = B.table(spark, d, "part").select(F.expr("'File_' || p_partkey || '.md'").alias("name"), F.expr(_FILE.replace("\r", "\\r").replace("\n", "\\n")).alias("text"))
    return I.chunk_uploads(files).select("chunk_id", "section", "text")


@query("SELECT p_partkey, unnest([1, 2]) AS n, unnest([repeat('a', 700) || chr(10) || chr(10) || repeat('b', p_size), repeat('c', 1199 - p_size % 7)]) AS text FROM part")
def packed_windows(spark, d):
    """Paragraphs of 700, up to 50 and 1,199 characters or less in windows of 1,200."""
    t = F.expr("repeat('a', 700) || '\\n \\n' || repeat('b', p_size) || '\\n\\n' || repeat('c', 1199 - p_size % 7)")
    return B.table(spark, d, "part").select("p_partkey", F.posexplode(I.windows(t)).alias("n", "text")).withColumn("n", F.col("n") + 1)


@query("SELECT p_partkey, unnest([1, 2]) AS n, unnest([repeat('ab. ', 299) || 'ab.', repeat('ab. ', 199 + p_size) || 'ab.']) AS text FROM part")
def cut_windows(spark, d):
    """One paragraph of over 1.5 windows, cut after its last sentence before 1,200 characters."""
    t = F.expr("repeat('ab. ', 499 + p_size) || 'ab.'")
    return B.table(spark, d, "part").select("p_partkey", F.posexplode(I.windows(t)).alias("n", "text")).withColumn("n", F.col("n") + 1)


@query(
    f"WITH {X.CHUNKS}, c AS (SELECT chunk_id, source, source || ' ' || text AS t FROM chunks WHERE status = 'current' AND NOT is_table_row), "
    f"m AS (SELECT chunk_id, unnest(list_concat(list_transform(regexp_extract_all(t, '{_IDS}'), lambda x: {_NORMAL}), [source])) AS entity FROM c) SELECT DISTINCT chunk_id, entity FROM m"
)
def graph_mentions(spark, d):
    return G.mentions(B.document_chunks(spark, d)).select("chunk_id", "entity")


@query(f"WITH {_NOTES} SELECT DISTINCT o_orderkey AS qid, 'B-' || (o_custkey % 40) || 'K' AS entity FROM notes WHERE o_orderkey % 100 = 0 AND o_custkey % 40 IN (SELECT DISTINCT o_custkey % 40 FROM notes WHERE o_orderkey % 2 = 1)")
def graph_seeds(spark, d):
    """Record ids of questions that the graph knows; the graph has those of odd orders."""
    chunks, questions = _note_chunks(spark, d)
    edges = chunks.filter("chunk_id % 2 = 1").select("chunk_id", "groups", F.explode(T.entities(F.regexp_extract("text", r"B-\w+", 0))).alias("entity"))
    return G.question_seeds(questions, edges)


_BASE = "base AS (SELECT * FROM (SELECT o.o_orderkey AS qid, p.o_orderkey AS chunk_id, row_number() OVER (PARTITION BY o.o_orderkey ORDER BY p.o_orderkey DESC) AS rank FROM orders o JOIN orders p ON p.o_orderkey BETWEEN o.o_orderkey - 50 AND o.o_orderkey + 50 WHERE o.o_orderkey % 100 = 0) WHERE rank <= 30)"


def _fused_sql(hop1: str) -> str:
    return (
        f"WITH {hop1}, {_BASE}, tied AS (SELECT h.qid, h.chunk_id, row_number() OVER (PARTITION BY h.qid ORDER BY score DESC, coalesce(b.rank, 10000), h.chunk_id) AS rank FROM h1 h LEFT JOIN base b ON b.qid = h.qid AND b.chunk_id = h.chunk_id), "
        "bb AS (SELECT qid, chunk_id, 1.5::DOUBLE / (rank + 60) AS s FROM tied WHERE rank <= 30 UNION ALL SELECT qid, chunk_id, 1.0::DOUBLE / (rank + 60) FROM base), f AS (SELECT qid, chunk_id, sum(s) AS score FROM bb GROUP BY ALL) "
        "SELECT * FROM (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, chunk_id) AS rank FROM f) WHERE rank <= 8"
    )


def graph_fused(spark, d):
    """Walked orders, ties by their place among the neighbours by number, fused with these."""
    o = B.table(spark, d, "orders").select("o_orderkey")
    q = o.filter("o_orderkey % 100 = 0").select(F.col("o_orderkey").alias("qid"), F.explode(F.sequence(F.col("o_orderkey") - 50, F.col("o_orderkey") + 50)).alias("chunk_id"))
    near = q.join(o.withColumnRenamed("o_orderkey", "chunk_id"), "chunk_id").withColumn("score", F.col("chunk_id").cast("double"))
    return G.fuse_with(_walk(spark, d, 1), S.best(near, 30)).select("qid", "chunk_id", F.col("rank").cast("long").alias("rank"))


QUERIES["graph_fused"] = graph_fused


# --- sources and sinks ----------------------------------------------------------------------


@query("SELECT o_orderkey AS chunk_id, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 2 = 1 THEN 'new ' || o_custkey ELSE 'old' END AS text FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def chunk_upsert(spark, d):
    o = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.concat(F.lit("new "), F.col("o_custkey").cast("string")).alias("text"))
    fresh = o.filter("chunk_id % 3 = 0")
    return sinks.upsert(o.filter("chunk_id % 2 = 0").withColumn("text", F.lit("old")), fresh.union(fresh))


_KINDS = ("lookup", "superseded", "numeric", "forbidden", "out_of_scope", "table")


@query(
    "SELECT ['naive','hybrid','graph','sql'][event_id % 4 + 1] AS pipeline, "
    + ", ".join(f"count(*) FILTER (WHERE event_id % 7 < 4 AND user_id % 6 = {i}) AS \"{k}\"" for i, k in enumerate(_KINDS))
    + " FROM events GROUP BY 1"
)
def result_matrix(spark, d):
    return sinks.matrix(E.summarise_types(B.results(spark, d)))


@query("SELECT 'i' AS name, 'INTEGER' AS kind UNION ALL SELECT 'r', 'REAL' UNION ALL SELECT 't', 'TEXT' UNION ALL SELECT 'n', 'INTEGER'")
def column_kinds(spark, d):
    s = lambda c: F.collect_list(F.col(c).cast("string"))
    p = B.table(spark, d, "part").agg(s("p_partkey").alias("i"), F.collect_list(F.concat(F.col("p_size").cast("string"), F.lit(".25"))).alias("r"), s("p_name").alias("t"), F.array(F.lit(None).cast("string")).alias("n"))
    each = [p.select(F.lit(c).alias("name"), corpus.infer_type(F.col(c)).alias("kind")) for c in "irtn"]
    return each[0].union(each[1]).union(each[2]).union(each[3])


@query("SELECT lower(p_name) AS name, p_partkey::VARCHAR AS entity FROM part UNION ALL SELECT lower(n_name), 'site:' || n_nationkey FROM nation")
def gazetteer_names(spark, d):
    named = lambda t, k, n: B.table(spark, d, t).select(F.col(k).cast("string").alias("id"), F.col(n).alias("name"))
    return corpus.gazetteer({"product": named("part", "p_partkey", "p_name"), "site": named("nation", "n_nationkey", "n_name")})


@query("SELECT 'r_regionkey | r_name' || chr(10) || string_agg(r_regionkey || ' | ' || r_name, chr(10) ORDER BY r_regionkey) AS text, 5 AS rows FROM region UNION ALL SELECT count(*)::VARCHAR, 1 FROM region")
def rows_as_text(spark, d):
    out = []
    for sql in ("SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey", "SELECT count(*) AS n FROM region"):
        df = guard(spark, d).run(sql, ["quality"])
        rows = [tuple(r) for r in df.collect()]  # at most the guard's limit
        out.append((as_text(df.columns, rows), len(rows)))
    return spark.createDataFrame(out, "text string, rows int")


# --- models, traces, checks -----------------------------------------------------------------


def _asked_vectors(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks, questions and hits of the vectors, with texts that a scripted model can be asked about."""
    c = F.col("chunk_id").cast("string")
    chunks = B.vector_chunks(spark, d).withColumns({"title": F.lit("t"), "section": F.lit("s"), "text": F.concat(F.lit("value "), c), "ref": c})
    questions = B.vector_questions(spark, d).withColumn("text", F.concat(F.lit("what of "), F.col("qid").cast("string")))
    return chunks, questions, S.vector_search(chunks, questions.filter("qid % 500 != 0"), k=3).hits


def _said(system: str, user: str) -> str:
    """A scripted model: declines every third hundred, else repeats its first source; grades and verdicts by the numbers asked about."""
    import re

    n = int(re.search(r"\d+", user)[0])
    if system.startswith("Grade"):
        return ("It is correct.", "Partial", "no idea")[n // 100 % 3]
    if system.startswith("Reply"):
        return ("[true, false]", "[true, true]", "unsure")[len(user) % 3]
    return "So: INSUFFICIENT_EVIDENCE." if n // 100 % 3 == 0 else "It holds " + re.search(r"value \d+", user)[0] + " [1]."


_HUNDREDS = "SELECT vec_id AS qid FROM embeddings WHERE vec_id % 100 = 0"
_FIRST = f"{_VECS}, f1 AS (SELECT qid, chunk_id FROM (SELECT *, {_RANKED} AS rank FROM sc) WHERE rank = 1)"


@query(
    f"WITH {_FIRST} SELECT h.qid, CASE WHEN h.qid % 500 = 0 OR (h.qid // 100) % 3 = 0 THEN '' ELSE 'It holds value ' || chunk_id || ' [1].' END AS draft, "
    f"h.qid % 500 = 0 OR (h.qid // 100) % 3 = 0 AS insufficient FROM ({_HUNDREDS}) h LEFT JOIN f1 USING (qid)"
)
def model_drafts(spark, d):
    chunks, questions, hits = _asked_vectors(spark, d)
    return M.generate(questions, hits, chunks, FunctionLLM(_said))


@query(f"SELECT qid, CASE (qid // 100) % 3 WHEN 0 THEN 'correct' WHEN 1 THEN 'partial' ELSE 'wrong' END AS grade FROM ({_HUNDREDS})")
def model_grades(spark, d):
    _, questions, _ = _asked_vectors(spark, d)
    q = questions.withColumn("expected_answer", F.lit("x"))
    return M.judge(q, q.select("qid", "text"), FunctionLLM(_said))


def _verdict(system: str, user: str) -> str:
    import re

    return {"0": "Here: [true, false]", "1": "[true, true]", "2": "I can't tell", "3": "[true]"}[re.search(r"lot (\d)", user)[1]]


@query(
    "SELECT p_partkey AS qid, 2::BIGINT AS claims, CASE p_partkey % 4 WHEN 0 THEN 'It is here' WHEN 1 THEN '' ELSE 'See lot ' || (p_partkey % 4) || '. It is here' END AS unsupported, "
    "p_partkey % 4 = 1 AS supported, CASE p_partkey % 4 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1.0 ELSE 0.0 END AS support FROM part"
)
def model_verdicts(spark, d):
    """A model's verdicts on two claims: a list, an unreadable one, one of the wrong length."""
    answers = B.table(spark, d, "part").select(F.col("p_partkey").alias("qid"), F.expr("'See lot ' || (p_partkey % 4) || '. It is here [1].'").alias("draft"))
    hits = answers.select("qid", F.lit("c").alias("chunk_id"), F.lit(1).alias("rank"))
    chunks = spark.createDataFrame([("c", "t", "s", "x")], "chunk_id string, title string, section string, text string")
    return M.verify(answers, hits, chunks, FunctionLLM(_verdict)).withColumn("unsupported", F.array_join("unsupported", " "))


@query(f"SELECT qid AS bundle_id, 3::BIGINT AS n, true AS ok, NULL::VARCHAR AS reason FROM ({_HUNDREDS})")
def answer_traces(spark, d):
    """Traces of answers to every hundredth vector, chained and verified against their manifest."""
    chunks, questions, hits = _asked_vectors(spark, d)
    answers = questions.select("qid", F.lit("answered").alias("verdict")).join(A.retrieved_refs(hits, chunks), "qid", "left")
    events = R.of_answers(questions, hits, answers)
    return R.verify_chain(events, R.chain(events), events.groupBy("bundle_id").agg(F.count(F.lit(1)).alias("event_count")))


@query(f"SELECT qid, 3 AS events, 'what of ' || qid AS asked, 0::BIGINT AS in_public FROM ({_HUNDREDS})")
def traces_by_audience(spark, d):
    """Events written for the public and for administrators, read back: the question's text is in the latter's only."""
    chunks, questions, hits = _asked_vectors(spark, d)
    answers = questions.select("qid", F.lit("answered").alias("verdict"), F.array().cast("array<string>").alias("retrieved_refs"))
    public, admin = (f"{shared_folder(spark)}/trace-{uuid.uuid4().hex}" for _ in range(2))
    sinks.write_trace(R.of_answers(questions, hits, answers), public, admin)
    seen = spark.read.parquet(public).groupBy("bundle_id").agg(F.count(F.lit(1)).cast("int").alias("events"), F.count_if(F.contains("event_json", F.lit("what of"))).alias("in_public"))
    return seen.join(spark.read.parquet(admin).select("bundle_id", "admin"), "bundle_id").select(F.col("bundle_id").alias("qid"), "events", F.col("admin").alias("asked"), "in_public")


@query(
    "SELECT 'orders.o_orderkey' AS name, count(*) - count(DISTINCT o_orderkey) AS violations FROM orders UNION ALL SELECT 'lineitem.l_orderkey', count(*) - count(DISTINCT l_orderkey) FROM lineitem UNION ALL SELECT 'superseded', 0 "
    "UNION ALL SELECT 'shipped after order', count(*) FILTER (WHERE l_shipdate < o_orderdate) FROM lineitem JOIN orders ON o_orderkey = l_orderkey"
)
def corpus_checks(spark, d):
    rows = B.table(spark, d, "lineitem").join(B.table(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.col("o_orderkey") == F.col("l_orderkey"))
    parts = {
        "orders.o_orderkey": E.counted_keys(B.table(spark, d, "orders"), "o_orderkey"),
        "lineitem.l_orderkey": E.counted_keys(B.table(spark, d, "lineitem"), "l_orderkey"),
        "superseded": E.superseded_pointers(B.document_chunks(spark, d)),
        "shipped after order": E.date_order(rows, "o_orderdate", "l_shipdate"),
    }
    out = None
    for name, df in parts.items():
        one = df.select(F.lit(name).alias("name"), "violations")
        out = one if out is None else out.union(one)
    return out


def ann_topk(spark, d):
    """Approximate search over all vectors; no SQL, as the cells are fitted. Recall is tested against exact search."""
    hits = ann.search(ann.build(B.vector_chunks(spark, d)), B.vector_questions(spark, d)).hits
    return hits.select("qid", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 5).alias("score"))


QUERIES["ann_topk"] = ann_topk


# --- extractive answers --------------------------------------------------------------------


def drafts_sql(hybrid: str) -> str:
    """CTEs up to drafts(qid, draft, insufficient). hybrid: those up to hy(qid, chunk_id, rank). The driver's texts hold no table rows, so units are sentences."""
    return (
        f"{hybrid}, dtok AS (SELECT DISTINCT chunk_id, term FROM toks), nn AS (SELECT count(*)::DOUBLE AS n FROM chunks), "
        "dfx AS (SELECT term, count(*)::DOUBLE AS df FROM dtok GROUP BY term), "
        "w AS (SELECT qid, qt.term, coalesce(ln((n - df + 0.5) / (df + 0.5) + 1), ln(n + 1)) AS w FROM qt LEFT JOIN dfx USING (term), nn), tw AS (SELECT qid, sum(w) AS total FROM w GROUP BY qid), "
        f"u AS (SELECT hy.qid, rank AS n, unnest(range(len({_sql_sentences('c.text')}))) AS i, unnest({_sql_sentences('c.text')}) AS sent FROM hy JOIN chunks c USING (chunk_id)), "
        f"ut AS (SELECT DISTINCT qid, n, i, sent, unnest({X.content('sent')}) AS term FROM u WHERE length(sent) >= 12), "
        "cvr AS (SELECT qid, n, i, sent, sum(w) / any_value(total) AS cov FROM ut JOIN w USING (qid, term) JOIN tw USING (qid) GROUP BY qid, n, i, sent), "
        "rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(cov, 9) DESC, n, i) AS r, max(cov) OVER (PARTITION BY qid) AS best FROM cvr WHERE cov > 0), "
        "pk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY r) AS k FROM rk WHERE best >= 0.4 AND (r = 1 OR cov >= greatest(0.4, best * 0.9) - 1e-9)), "
        r"ln AS (SELECT qid, k, n, regexp_replace(regexp_replace(regexp_replace(sent, '^[-0-9. ]+', ''), '^\s+|\s+$', '', 'g'), '\.+$', '') || '. [' || n || ']' AS s FROM pk WHERE k <= 2), "
        "drafts AS (SELECT q.qid, coalesce(string_agg(s, ' ' ORDER BY k), '') AS draft, count(s) = 0 AS insufficient FROM questions q LEFT JOIN ln USING (qid) GROUP BY q.qid)"
    )


def answers_sql(drafts: str, profile: str) -> str:
    """drafts, profile: CTEs up to drafts and profile(qid, rank, visible). A sentence of its own source holds against it, so every draft is supported."""
    message = " ".join(f"WHEN '{v}' THEN '{m}'" for v, m in MESSAGES.items())
    return (
        f"WITH {drafts}, {profile}, why AS (SELECT qid, CASE WHEN coalesce(bool_or(rank = 1 AND NOT visible) OR count(*) FILTER (WHERE rank <= 3 AND NOT visible) >= 2, false) THEN 'access_denied' ELSE 'insufficient_evidence' END AS why FROM questions LEFT JOIN profile USING (qid) GROUP BY qid), "
        "hr AS (SELECT qid, rank, source || '#' || doc_id AS ref FROM hy JOIN chunks USING (chunk_id)), refs AS (SELECT qid, string_agg(ref, ' ' ORDER BY rank) AS refs FROM hr GROUP BY qid), "
        "ct AS (SELECT qid, n, min(k) AS k FROM ln WHERE k <= 2 GROUP BY ALL), cj AS (SELECT ct.qid, '[' || string_agg('{\"n\":' || n || ',\"kind\":\"chunk\",\"ref\":\"' || ref || '\"}', ',' ORDER BY k) || ']' AS c FROM ct JOIN hr ON hr.qid = ct.qid AND hr.rank = n GROUP BY ct.qid), "
        "v AS (SELECT qid, draft, insufficient, CASE WHEN insufficient THEN why ELSE 'answered' END AS verdict FROM drafts JOIN why USING (qid)) "
        f"SELECT qid, verdict, CASE verdict WHEN 'answered' THEN draft {message} END AS text, coalesce(c, '[]') AS citations, coalesce(refs, '') AS refs, CASE WHEN NOT insufficient THEN 1.0::DOUBLE END AS support FROM v LEFT JOIN cj USING (qid) LEFT JOIN refs USING (qid)"
    )
