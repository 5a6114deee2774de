"""The registered queries over the driver's tables, one for each operator or family of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verispan.functions import text as T
from verispan.functions.vectors import features
from verispan.models import HashingEmbedder
from verispan.operators import answer as A
from verispan.operators import evaluate as E
from verispan.operators import graph as G
from verispan.operators import ingest as I
from verispan.operators import search as S
from verispan.operators import trace as R
from verispan.operators.guard import SqlAccessDenied, SqlGuard, SqlRejected, column_view
from verispan.plans import bindings as B

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
HUB_FRACTION = 0.02


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _hits(df: DataFrame, places: int = 5) -> DataFrame:
    return df.select("qid", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", places).alias("score"))


# --- access and vector search ---


@query
def vector_topk_pre(spark, d):
    return _hits(S.vector_search(B.vector_chunks(spark, d), B.vector_questions(spark, d)).hits)


@query
def vector_topk_post(spark, d):
    return _hits(S.vector_search(B.vector_chunks(spark, d), B.vector_questions(spark, d), mode="post").hits)


@query
def vector_post_removed(spark, d):
    return S.vector_search(B.vector_chunks(spark, d), B.vector_questions(spark, d), mode="post").removed


@query
def all_visible(spark, d):
    return S.all_visible(B.document_chunks(spark, d), ["quality"]).select("chunk_id")


@query
def get_by_ref(spark, d):
    chunks = B.document_chunks(spark, d)
    return S.by_ref(chunks, chunks.filter("status = 'superseded'").select("ref"), ["commercial"]).select("chunk_id", "ref")


@query
def get_document(spark, d):
    return S.document(B.document_chunks(spark, d), "src7", ["commercial"]).select("chunk_id", "status")


@query
def current_only_docs(spark, d):
    return B.document_chunks(spark, d).filter(S.eligible(current_only=True)).select("doc_id")


@query
def chunk_counts(spark, d):
    return B.document_chunks(spark, d).groupBy("status", "is_table_row").agg(F.count(F.lit(1)).alias("chunks"))


# --- text ---


def _freq(df: DataFrame, toks) -> DataFrame:
    return df.select(F.explode(toks).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query
def tokens_freq(spark, d):
    return _freq(B.texts(spark, d), T.tokens(F.col("text")))


@query
def content_tokens_freq(spark, d):
    return _freq(B.texts(spark, d), T.content_tokens(F.col("text")))


@query
def stems(spark, d):
    raw = _freq(B.texts(spark, d), T.raw_content_tokens(F.col("text")))
    return raw.select("term", T.stem(F.col("term")).alias("stem"))


@query
def record_ids(spark, d):
    return B.table(spark, d, "documents").select("doc_id", F.array_join(T.record_ids(F.col("text")), " ").alias("ids"))


@query
def numbers(spark, d):
    return B.table(spark, d, "documents").select("doc_id", F.array_join(T.numbers(F.col("text")), " ").alias("numbers"))


@query
def sentence_counts(spark, d):
    return B.table(spark, d, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("sentences"))


@query
def slug_refs(spark, d):
    return B.table(spark, d, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


@query
def doc_of_ref(spark, d):
    ref = F.concat("source", F.lit("#"), F.col("doc_id").cast("string"), F.lit("@row"), F.col("n_chars").cast("string"))
    return B.table(spark, d, "documents").select("doc_id", T.document_of(ref).alias("document"))


@query
def term_stats(spark, d):
    terms = S.text_index(B.indexed_chunks(spark, d)).terms
    return terms.select("term", "df", F.round("idf", 5).alias("idf"))


@query
def length_stats(spark, d):
    return S.text_index(B.indexed_chunks(spark, d)).totals.select("n", F.round("avg_len", 5).alias("avg_len"))


@query
def hash_embedding_weights(spark, d):
    q = B.benchmark_questions(spark, d, embed=True)
    return q.select("qid", F.posexplode("embedding").alias("b", "w")).select("qid", F.col("b").cast("long").alias("b"), (F.round("w", 5) + 0.0).alias("w"))


@query
def embedding_features(spark, d):
    return _freq(B.table(spark, d, "benchmark"), features(F.col("text")))


# --- keyword and hybrid search, access profile ---


@query
def bm25_topk(spark, d):
    return _hits(S.keyword_search(B.indexed_chunks(spark, d), B.benchmark_questions(spark, d)))


@query
def bm25_current_only(spark, d):
    return _hits(S.keyword_search(B.indexed_chunks(spark, d), B.benchmark_questions(spark, d), current_only=True))


def _embedded(spark, d):
    return B.indexed_chunks(spark, d), B.benchmark_questions(spark, d, embed=True)


@query
def hybrid_rrf_topk(spark, d):
    return _hits(S.hybrid(*_embedded(spark, d)), 9)


@query
def access_profile(spark, d):
    return S.access_profile(*_embedded(spark, d)).select("qid", F.col("rank").cast("long").alias("rank"), "visible")


@query
def access_verdict(spark, d):
    chunks, questions = _embedded(spark, d)
    return S.empty_verdict(S.access_profile(chunks, questions), questions)


@query
def recall_at_k(spark, d):
    """Share of the documents that hold a question's text word for word, visible and current ones, among its hybrid hits."""
    chunks, questions = _embedded(spark, d)
    hits = S.hybrid(chunks, questions)
    rows = chunks.filter(S.eligible(current_only=True)).select("chunk_id", "groups", F.col("text").alias("body"))
    q = S.small(questions.select("qid", F.col("groups").alias("_asker"), F.col("text").alias("wanted")))
    truth = rows.join(q, S.visible("groups", F.col("_asker")) & F.contains("body", F.col("wanted"))).select("qid", "chunk_id")
    found = truth.join(hits.select("qid", "chunk_id", F.lit(1).alias("hit")), ["qid", "chunk_id"], "left")
    return found.groupBy("qid").agg(F.round(F.count("hit") / F.count(F.lit(1)), 5).alias("recall"))


# --- ingest ---


@query
def line_chunks(spark, d):
    lines = B.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.filter(F.trim("line") != "").select("doc_id", F.col("n").cast("long").alias("n"), "line")


@query
def upload_chunks(spark, d):
    files = B.texts(spark, d).select(F.concat("source", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("name"), "text")
    return I.chunk_uploads(files).select("chunk_id", "document_id", "section", F.length("text").alias("chars"), "is_table_row")


# --- graph ---


def _walk(spark, d, hops, k=None):
    """Every question is an order with an id divisible by 100; its seeds are the order's parts."""
    edges = B.order_edges(spark, d)
    asked = edges.filter(F.col("chunk_id") % 100 == 0)
    questions = asked.select(F.col("chunk_id").alias("qid"), "groups").distinct()
    seeds = asked.filter(F.startswith("entity", F.lit("p"))).select(F.col("chunk_id").alias("qid"), "entity")
    return G.walk(edges, seeds, questions, hops, HUB_FRACTION, k=k)


@query
def graph_hubs(spark, d):
    return G.hubs(B.order_edges(spark, d), HUB_FRACTION, 8)


@query
def graph_stats(spark, d):
    return G.stats(B.order_edges(spark, d), HUB_FRACTION)


@query
def graph_walk_1hop(spark, d):
    return _hits(_walk(spark, d, 1))


@query
def graph_walk_2hop(spark, d):
    return _hits(_walk(spark, d, 2, S.CANDIDATES))


# --- guarded SQL ---

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
RESTRICTED = {"supplier.s_acctbal": ["commercial"], "customer.c_acctbal": ["commercial"]}
GUARDED = {
    "sql_join_agg": "SELECT n.n_name AS nation, count(*) AS orders, round(sum(o.o_totalprice), 2) AS total FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY n.n_name",
    "sql_cte": "WITH per AS (SELECT o_custkey AS cust, count(*) AS n FROM orders GROUP BY o_custkey) SELECT n AS orders, count(*) AS customers FROM per GROUP BY n",
    "sql_semi": "SELECT c_mktsegment AS segment, count(*) AS customers FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY c_mktsegment",
    "sql_anti": "SELECT o_orderstatus AS status, count(*) AS orders FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 45) GROUP BY o_orderstatus",
    "sql_dates": "SELECT cast(extract(YEAR FROM o_orderdate) AS bigint) AS y, cast(extract(MONTH FROM o_orderdate) AS bigint) AS m, count(*) AS n, min(cast(date_trunc('month', o_orderdate) AS date)) AS first FROM orders GROUP BY extract(YEAR FROM o_orderdate), extract(MONTH FROM o_orderdate)",
    "sql_window": "SELECT nation, orders, rnk FROM (SELECT n.n_name AS nation, count(*) AS orders, rank() OVER (ORDER BY count(*) DESC) AS rnk FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY n.n_name) t WHERE rnk <= 10",
    "sql_having": "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, min(l_shipdate) AS first_ship, max(l_quantity) AS most FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10",
    "sql_distinct_agg": "SELECT p_brand AS brand, count(DISTINCT p_type) AS kinds, min(p_size) AS least, max(p_retailprice) AS dearest FROM part GROUP BY p_brand",
    "sql_left_join": "SELECT r.r_name AS region, count(s.s_suppkey) AS suppliers FROM region r LEFT JOIN nation n ON n.n_regionkey = r.r_regionkey LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey GROUP BY r.r_name",
    "sql_nested_union": "SELECT kind, count(*) AS n FROM (SELECT 'c' AS kind, c_nationkey AS k FROM customer UNION ALL SELECT 's' AS kind, s_nationkey AS k FROM supplier) t GROUP BY kind",
    "sql_order_limit": "SELECT o_orderkey AS id, o_totalprice AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 500",
}


def guard(spark: SparkSession, d: str) -> SqlGuard:
    return SqlGuard(spark, {t: B.table(spark, d, t) for t in TABLES}, restricted=RESTRICTED)


for _name, _sql in GUARDED.items():
    QUERIES[_name] = lambda spark, d, sql=_sql: guard(spark, d).run(sql, ["quality"])

#: Statements by what becomes of them for an asker of group quality.
STATEMENTS = {
    "allowed": (
        "SELECT count(*) FROM orders", "SELECT count(*) FROM supplier", "SELECT s_name FROM supplier", "SELECT count(*) FROM orders NATURAL JOIN lineitem",
        "WITH t AS (SELECT s_name AS n FROM supplier) SELECT count(*) FROM t", "SELECT max(date_trunc('month', o_orderdate)) FROM orders", "SELECT s_name FROM supplier AS s WHERE s.s_nationkey = 3",
    ),
    "rejected": (
        "DROP TABLE orders", "DELETE FROM orders", "UPDATE orders SET o_custkey = 1", "INSERT INTO orders VALUES (1)", "CREATE TABLE t AS SELECT 1", "ALTER TABLE orders RENAME TO o", "TRUNCATE TABLE orders",
        "SELECT 1; SELECT 2", "SELECT * FROM secrets", "SELECT * FROM sys.orders", "SELECT * FROM parquet.`/tmp`", "SELECT java_method('a', 'b')", "SELECT a FROM orders UNION SELECT b FROM part", "SET x = 1",
        "SELECT TRANSFORM(o_custkey) USING 'cat' FROM orders", "SELECT * FROM range(10)", "SELECT o_custkey FROM orders LIMIT 1 + 1", "WITH orders AS (SELECT 1 AS x) SELECT x FROM orders",
        "SELECT nothing FROM supplier", "SELECT x FROM region AS t(x, y, z)", "EXPLAIN SELECT 1", "TABLE supplier", "VALUES (1)", "SELECT `(s_acct)?.+` FROM supplier", "not SQL at all", "SHOW TABLES", "CACHE TABLE orders",
        "SELECT strftime('%Y', o_orderdate) FROM orders", "SELECT current_catalog()",
    ),
    "denied": (
        "SELECT s_acctbal FROM supplier", "SELECT * FROM supplier", "SELECT s_name FROM supplier WHERE s_acctbal > 0", "SELECT s_name FROM supplier ORDER BY s_acctbal", "SELECT sum(c_acctbal) FROM customer",
        "SELECT x FROM supplier AS t(a, b, c, x)", "SELECT count(*) FROM supplier JOIN (SELECT 1 AS s_acctbal) t USING (s_acctbal)", "SELECT count(*) FROM supplier NATURAL JOIN (SELECT 1 AS s_acctbal) t",
        "SELECT s.s_acctbal FROM supplier s", "SELECT (SELECT max(s_acctbal) FROM supplier) AS m FROM orders", "SELECT count(*) FROM orders WHERE EXISTS (SELECT 1 FROM supplier WHERE s_acctbal > 0)",
        "SELECT t.* FROM (SELECT * FROM supplier) t", "SELECT max(x) FROM (SELECT s_acctbal AS x FROM supplier) t", "SELECT s_name FROM supplier GROUP BY s_name, s_acctbal",
        "WITH v(a, b, c, d) AS (SELECT * FROM supplier) SELECT d FROM v", "SELECT rank() OVER (ORDER BY s_acctbal) FROM supplier", "SELECT count(S_AcctBal) FROM SUPPLIER",
        "SELECT count(*) FROM supplier a JOIN supplier b ON a.s_acctbal = b.s_acctbal", "SELECT s_name FROM supplier HAVING max(s_acctbal) > 0",
    ),
}
OUTCOMES = {sql: outcome for outcome, statements in STATEMENTS.items() for sql in statements}


@query
def sql_guard_matrix(spark, d):
    g, rows = guard(spark, d), []
    for sql in OUTCOMES:
        try:
            g.check(sql, ["quality"])
            rows.append((sql, "allowed"))
        except SqlAccessDenied:
            rows.append((sql, "denied"))
        except SqlRejected:
            rows.append((sql, "rejected"))
    return spark.createDataFrame(rows, "statement string, outcome string")


@query
def column_acl_view(spark, d):
    hidden = guard(spark, d).hidden_columns(["quality"])
    return column_view(B.table(spark, d, "supplier"), "supplier", hidden)


# --- answers, verification, traces ---


def _turns(spark, d):
    """Assistant turns as answers that cite the user's turn before them, which is their only source."""
    turns = B.table(spark, d, "conversations").withColumn("qid", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    before = turns.withColumn("asked", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "text")))
    said = before.filter("role = 'assistant' AND asked IS NOT NULL")
    answers = said.select("qid", F.concat(F.coalesce("text", F.lit("")), F.lit(" [1].")).alias("draft"))
    chunks = said.select(F.col("qid").alias("chunk_id"), F.lit("").alias("context"), F.col("asked").alias("text"))
    return answers, said.select("qid", F.col("qid").alias("chunk_id"), F.lit(1).alias("rank")), chunks


@query
def claim_verify(spark, d):
    answers, hits, chunks = _turns(spark, d)
    return A.verify(answers, hits, chunks).select("qid", "claims", F.size("unsupported").cast("long").alias("unsupported"), "supported", F.round("support", 5).alias("support"))


@query
def extractive_answer(spark, d):
    chunks, questions = _embedded(spark, d)
    return A.extract(questions, S.hybrid(chunks, questions), chunks)


@query
def answers(spark, d):
    chunks, questions = _embedded(spark, d)
    got = A.answer(questions, S.hybrid(chunks, questions), chunks)
    return got.select("qid", "verdict", "text", F.to_json("citations").alias("citations"), F.array_join("retrieved_refs", " ").alias("refs"), "support")


def _events(spark, d):
    e = B.table(spark, d, "events")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    body = R.canonical(event_id=F.col("event_id"), event_type=F.col("event_type"), user_id=F.col("user_id"))
    return e.select(F.col("user_id").alias("bundle_id"), seq.cast("long").alias("sequence"), body.alias("event_json"))


@query
def trace_chain_build(spark, d):
    return R.chain(_events(spark, d))


@query
def trace_chain_verify(spark, d):
    """Receipts of which those at every bundle's third event were forged."""
    events = _events(spark, d)
    forged = F.when(F.col("sequence") == 3, F.concat("hash", F.lit("0"))).otherwise(F.col("hash"))
    return R.verify_chain(events, R.chain(events).withColumn("hash", forged)).select("bundle_id", "n", "ok", "reason")


# --- evaluation ---


@query
def run_summary_types(spark, d):
    return E.summarise_types(B.results(spark, d))


@query
def run_summary_pipelines(spark, d):
    return E.summarise_pipelines(B.results(spark, d))


@query
def gate_conditions(spark, d):
    return E.gate(B.results(spark, d), human=(19, 20))


@query
def gate_status(spark, d):
    return E.gate_status(E.gate(B.results(spark, d)))


@query
def hypotheses(spark, d):
    return E.hypotheses(B.results(spark, d))


@query
def leak_sweep(spark, d):
    """Benchmark texts asked by each group over four search paths, without table rows; leak_sweep_hidden is the whole sweep."""
    chunks, q = _embedded(spark, d)
    both = F.explode(F.array(F.lit("commercial"), F.lit("quality")))
    q = q.withColumn("grp", both).select(F.concat_ws("-", F.col("qid").cast("string"), "grp").alias("qid"), "text", F.array("grp").alias("groups"), "embedding")
    found = {
        "vector pre": S.vector_search(chunks, q).hits,
        "vector post": S.vector_search(chunks, q, mode="post").hits,
        "keyword": S.keyword_search(chunks, q),
        "hybrid": S.hybrid(chunks, q),
    }
    return E.sweep(chunks, found, q)


@query
def leak_sweep_hidden(spark, d):
    """The whole sweep over all documents; the texts asked are those of hidden documents with an id divisible by 100."""
    chunks = B.indexed_chunks(spark, d)
    groups = chunks.select(F.explode("groups").alias("grp")).distinct()
    return E.sweep_hidden(chunks, groups, HashingEmbedder(B.DIM), G.mentions(chunks), chunks.filter("doc_id % 100 = 0"))


FOREIGN = (("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("labels", "doc_id", "documents", "doc_id"))


@query
def integrity_checks(spark, d):
    parts = [E.foreign_key(B.table(spark, d, c), k, B.table(spark, d, p), pk).select(F.lit(f"{c}.{k}").alias("key"), "violations") for c, k, p, pk in FOREIGN]
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out
