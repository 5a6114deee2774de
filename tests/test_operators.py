import json

import pytest
from pyspark.sql import functions as F

from verispan.engine import build_engine, parse_action
from verispan.models import ScriptedLLM
from verispan.operators import answer as A
from verispan.operators import evaluate as E
from verispan.operators import graph as G
from verispan.operators import search as S
from verispan.operators import trace as R
from verispan.service import ServiceError, Workspaces, authorized
from verispan.sources import corpus, sinks

OPEN = "---\nid: SOP-001\ntitle: \"Cold storage\"\ntype: sop\ngroups: [quality, commercial]\n---\n# t\n\n## Limits\nVials are stored at 4 degrees for 36 hours. Doors stay shut.\n\n## Table\n| Parameter | Limit |\n|---|---|\n| humidity | 55 |\n"
HIDDEN = "---\nid: MEMO-01\ntitle: Prices\ntype: memo\ngroups: [commercial]\n---\n# t\n\n## Discount\nThe discount for Northwind is 17 percent this quarter.\n"


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("docs")
    (folder / "a.md").write_text(OPEN)
    (folder / "b.md").write_text(HIDDEN)
    e = build_engine(spark, corpus.read_documents(spark, str(folder)))
    e.chunks = e.chunks.cache()
    return e


def test_parser_rejects_documents_without_groups(spark):
    bad = spark.createDataFrame([(OPEN.replace("[quality, commercial]", "[]"),)], "value string")
    with pytest.raises(Exception, match="at least one group"):
        corpus.parse_documents(bad).collect()


def test_chunks(engine):
    rows = {r["chunk_id"]: r for r in engine.chunks.collect()}
    assert set(rows) == {"SOP-001#limits", "SOP-001#table", "SOP-001#table@row1", "MEMO-01#discount"}
    assert rows["SOP-001#table@row1"]["text"] == "Parameter: humidity; Limit: 55"


def test_answers_and_denials(engine):
    q = engine.ask_table([("a", "How long are vials stored at 4 degrees?", ["quality"]), ("b", "What is the discount for Northwind?", ["quality"]), ("c", "What is the discount for Northwind?", ["commercial"])])
    got = {r["qid"]: r for r in engine.answer("hybrid", q).collect()}
    assert got["a"]["verdict"] == "answered" and "36 hours" in got["a"]["text"]
    assert got["b"]["verdict"] == "access_denied" and "17" not in got["b"]["text"]
    assert got["c"]["verdict"] == "answered" and "17 percent" in got["c"]["text"]


def test_post_filter_loses_and_counts(engine):
    q = engine.ask_table([("b", "discount Northwind", ["quality"])])
    post = S.vector_search(engine.chunks, q, 3, "post")
    assert post.removed.first()["removed"] == 1 and post.hits.count() == 2
    assert S.vector_search(engine.chunks, q, 3).hits.filter("chunk_id = 'MEMO-01#discount'").count() == 0


def test_graph_walk_stops_at_hidden_chunks(spark):
    edges = spark.createDataFrame([("a", ["q"], "X"), ("b", ["c"], "X"), ("b", ["c"], "Y"), ("d", ["q"], "Y")], "chunk_id string, groups array<string>, entity string")
    hub = spark.createDataFrame([], "entity string")
    seeds = spark.createDataFrame([("1", "X")], "qid string, entity string")
    walk = lambda g: {r["chunk_id"]: r["score"] for r in G.walk(edges, seeds, spark.createDataFrame([("1", g)], "qid string, groups array<string>"), hub=hub).collect()}
    assert walk(["q"]) == {"a": 2.0}
    assert walk(["q", "c"]) == {"a": 2.0, "b": 2.25, "d": 0.25}


def test_verifier(spark):
    hits = spark.createDataFrame([(q, "c", 1) for q in "abcde"], "qid string, chunk_id string, rank int")
    chunks = spark.createDataFrame([("c", "", "Vials are stored at 4 degrees for 36 hours.")], "chunk_id string, context string, text string")
    drafts = [("a", "Vials are stored for 36 hours [1]."), ("b", "Vials are stored for 48 hours [1]."), ("c", "Vials are stored for 36 hours."), ("d", "Vials are stored per SOP-9 for 36 hours [1]."), ("e", "Vials are stored for 36 hours [7].")]
    got = {r["qid"]: r["supported"] for r in A.verify(spark.createDataFrame(drafts, "qid string, draft string"), hits, chunks).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": False, "e": False}


@pytest.mark.parametrize("change", ["edit", "remove", "swap", "none"])
def test_trace_changes_are_found(spark, change):
    rows = [("t", i, f'{{"n":{i}}}') for i in range(1, 5)]
    events = spark.createDataFrame(rows, "bundle_id string, sequence int, event_json string")
    receipts = R.chain(events)
    if change == "edit":
        events = events.withColumn("event_json", F.when(F.col("sequence") == 2, '{"n":9}').otherwise(F.col("event_json")))
    if change == "remove":
        events, receipts = events.filter("sequence != 2"), receipts.filter("sequence != 2")
    if change == "swap":
        events = events.withColumn("event_json", F.when(F.col("sequence") == 2, '{"n":3}').when(F.col("sequence") == 3, '{"n":2}').otherwise(F.col("event_json")))
    manifest = spark.createDataFrame([("t", 4)], "bundle_id string, event_count int")
    assert R.verify_chain(events, receipts, manifest).first()["ok"] == (change == "none")


def test_gate_rejects_leaks_and_coincidence(spark):
    rows = [("hybrid", "forbidden", "access_denied", None, True)]
    r = spark.createDataFrame(rows, "pipeline string, type string, verdict string, grade string, leaked boolean")
    assert E.gate_status(E.gate(r)).first()["status"] == "rejected"
    q = spark.createDataFrame([("1", "numeric", "sql", "answered", ["q"], [["4"]], [], [], ["table:batch"])], "qid string, type string, hypothesis string, expected_verdict string, groups array<string>, key_facts array<array<string>>, secret_facts array<string>, section_refs array<string>, table_refs array<string>")
    a = spark.createDataFrame([("1", "It is 4.", "answered", [], ["SOP-1#x"], False, 1.0)], "qid string, text string, verdict string, citations array<struct<n:int,kind:string,ref:string>>, retrieved_refs array<string>, verifier_changed boolean, support double")
    acl = spark.createDataFrame([("SOP-1", ["c"])], "document_id string, groups array<string>")
    s = E.score(q, a, acl).first()
    assert s["grade"] == "wrong" and s["coincidental"] and s["leaked"]


def test_upsert_and_runs(spark, tmp_path):
    old = spark.createDataFrame([("a", "1"), ("b", "1")], "chunk_id string, text string")
    new = spark.createDataFrame([("b", "2"), ("c", "2"), ("c", "2")], "chunk_id string, text string")
    assert sorted(map(tuple, sinks.upsert(old, new).collect())) == [("a", "1"), ("b", "2"), ("c", "2")]
    sinks.save_run(old, str(tmp_path / "run"), "r1")
    assert sinks.read_run(str(tmp_path / "run" / "run_id=r1"), old).count() == 2


def test_sql_and_agent_pipelines(engine, spark):
    engine.tables = {"batch": spark.createDataFrame([("b1", 5, 9.0), ("b2", 7, 8.0)], "id string, units long, price double")}
    engine.restricted = {"batch.price": ["commercial"]}
    run = lambda *replies: (setattr(engine, "llm", ScriptedLLM(list(replies))), engine.sql("How many units?", ["quality"]))[1]
    got = run("```sql\nSELECT sum(units) AS units FROM batch\n```", "There are 99 units [1].")
    assert got["verdict"] == "answered" and got["text"].startswith("12") and got["refs"] == ["table:batch"]
    assert run("SELECT price FROM batch")["verdict"] == "access_denied"
    assert run("DROP TABLE batch")["verdict"] == "execution_failed"
    assert run("NO_SQL")["verdict"] == "insufficient_evidence"
    engine.llm = ScriptedLLM([json.dumps({"action": "search", "input": "vials stored hours"}), '{"action": "finish"}'])
    got = engine.agent("How long are vials stored at 4 degrees?", ["quality"])
    assert got["verdict"] == "answered" and got["steps"] == ["search", "finish"]
    engine.llm = ScriptedLLM(["?", "?"])
    assert engine.agent("x", ["quality"])["error"] == "AgentProtocolError"
    assert parse_action('so: {"action": "read"}') == {"action": "read"} and parse_action("{}") is None


def test_workspaces(spark):
    w = Workspaces(spark)
    assert authorized("Bearer x", "x") and not authorized("Bearer x", None)
    assert w.upload("workspace1", "notes.md", b"# Storage\nVials are stored for 36 hours at 4 degrees.\n") == 1
    got = w.ask("workspace1", "How long are vials stored at 4 degrees?", ["hybrid"])[0]
    assert got["verdict"] == "answered" and got["sources"][0]["ref"] == "notes#storage-1"
    for args, status in ((("x", "a.md", b"a"), 400), (("workspace1", "a.exe", b"a"), 415), (("workspace1", "a.md", b"a" * 2_000_001), 413), (("workspace1", "a.md", b" "), 422)):
        with pytest.raises(ServiceError) as e:
            w.upload(*args)
        assert e.value.status == status
    with pytest.raises(ServiceError):
        w.ask("workspace2", "x")


def test_tables_in_workspaces_over_http(spark):
    import threading
    import urllib.error
    import urllib.request

    from verispan.models import FunctionLLM
    from verispan.service import serve

    said = lambda system, user: "SELECT sum(amount) AS total FROM t_2024_sales" if system.startswith("Tables") else "The total is 7 [1]."
    server = serve(Workspaces(spark, llm=FunctionLLM(said)), 0, "secret")
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"

    def call(method, path, body=None, token="secret"):
        request = urllib.request.Request(base + path, body, {"Authorization": f"Bearer {token}"}, method=method)
        try:
            with urllib.request.urlopen(request, timeout=120) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    assert call("GET", "/healthz", token="")[0] == 200 and call("GET", "/describe", token="bad")[0] == 401
    assert call("POST", "/workspaces/workspace9/files?name=2024%20sales.csv", b"Id,Amount\n1,3\n2,4\n")[0] == 200
    assert call("POST", "/workspaces/workspace9/files?name=empty.csv", b"Id,Amount\n")[0] == 422
    assert call("GET", "/workspaces/workspace9")[1]["tables"] == {"t_2024_sales": {"id": "bigint", "amount": "bigint"}}
    got = call("POST", "/ask", json.dumps({"workspace": "workspace9", "question": "What is the total?", "pipelines": ["sql"]}).encode())
    assert got[0] == 200 and got[1][0]["verdict"] == "answered" and "7" in got[1][0]["text"]
    assert call("POST", "/ask", b"nothing")[0] == 400 and call("GET", "/nowhere")[0] == 404
    assert call("DELETE", "/workspaces/workspace9")[0] == 200 and call("GET", "/workspaces/workspace9")[0] == 410
    server.shutdown()


def test_runaway_statement_is_stopped(spark):
    from verispan.operators.guard import SqlGuard, SqlRejected, with_budget

    guard = SqlGuard(spark, {"big": spark.range(400_000).withColumnRenamed("id", "a"), "few": spark.range(40_000).withColumnRenamed("id", "a")})
    with pytest.raises(SqlRejected, match="more work"):
        guard.run("SELECT count(*) FROM big x, big y, big z WHERE x.a + y.a + z.a = -1", [])
    # What passes the estimate is stopped by the time that it takes.
    df = guard.run("SELECT count(*) FROM big x, few y WHERE x.a + y.a = -1", [])
    with pytest.raises(Exception, match="(?i)cancel"):
        with_budget(spark, df, 1.0)


def test_large_tables_meet_on_equal_keys(spark):
    from verispan.operators.guard import SqlGuard, SqlRejected

    t = lambda n: spark.range(n).withColumnRenamed("id", "a")
    guard = SqlGuard(spark, {"big": t(400_000), "more": t(300_000), "few": t(200_000)})
    assert guard.run("SELECT count(*) FROM big x JOIN more y ON x.a = y.a JOIN few z ON y.a = z.a", []).first()[0] == 200_000
    assert guard.run("SELECT count(*) FROM (SELECT a, count(*) AS n FROM (SELECT x.a FROM big x JOIN more y ON x.a = y.a JOIN few z ON y.a = z.a) GROUP BY a) t WHERE n > 1", []).first()[0] == 0
    for sql in (
        "SELECT count(*) FROM big x JOIN more y ON x.a = y.a JOIN few z ON y.a < z.a JOIN few w ON z.a < w.a",
        "SELECT count(*) FROM big WHERE a IN (SELECT x.a FROM big x, more y, few z WHERE x.a + y.a + z.a = 1)",
        "SELECT (SELECT count(*) FROM big x, more y, few z WHERE x.a + y.a + z.a = 1) AS n FROM few",
    ):
        with pytest.raises(SqlRejected, match="more work"):
            guard.run(sql, [])


def test_pairs_by_identifier_are_told_once_and_not_moved(spark):
    texts = ["SOP-1 and DEV-2, SOP-1", "DEV-2 CC-3", "nothing", None, "CC-3 DEV-2 SOP-1"]
    chunks = spark.createDataFrame([(i, t, "", [g], "current", i == 9) for i, (t, g) in enumerate((t, g) for t in texts for g in "xy")], "chunk_id long, text string, context string, groups array<string>, status string, is_table_row boolean")
    questions = spark.createDataFrame([(1, "SOP-1 DEV-2 CC-3", ["x"]), (2, "CC-3 or DEV-2", ["y", "x"]), (3, "SOP-1", ["z"]), (4, "no id", ["x"])], "qid int, text string, groups array<string>")
    got = S.by_identifiers(chunks, questions)
    assert sorted(map(tuple, got.collect())) == [(1, 0), (1, 2), (1, 8), (2, 0), (2, 1), (2, 2), (2, 3), (2, 8)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]


def test_the_best_of_two_hops_are_those_of_the_whole_walk(spark):
    import random

    rnd = random.Random(5)
    groups = [["x"], ["y"], ["x", "y"]]
    rows = {(c, f"e{int(30 * rnd.random() ** 2)}") for c in range(120) for _ in range(rnd.randrange(1, 8))}
    edges = spark.createDataFrame([(c, groups[c % 3], e) for c, e in sorted(rows)], "chunk_id long, groups array<string>, entity string")
    questions = spark.createDataFrame([(q, ["xy"[q % 2]]) for q in range(8)], "qid int, groups array<string>")
    seeds = spark.createDataFrame([(q, f"e{29 - 3 * q + j}") for q in range(8) for j in range(1 + q % 2)], "qid int, entity string")
    told = lambda df, k: sorted((r["qid"], r["rank"], r["chunk_id"], r["score"]) for r in df.filter(F.col("rank") <= k).collect())
    whole = G.walk(edges, seeds, questions, 2, 0.2).cache()
    for k in (1, 3, 10, 60):
        part = G.walk(edges, seeds, questions, 2, 0.2, k=k)
        assert told(part, k) == told(whole, k) and part.agg(F.max("rank")).first()[0] <= k


def test_pages_are_read_and_verified(engine):
    q = "How long are vials stored at 4 degrees?"
    engine.renderer = lambda ref: b"png"
    engine.llm = ScriptedLLM(["Vials are stored for 36 hours [1].", "", ""])
    got = engine.multimodal(q, ["quality"])
    assert got["verdict"] == "answered" and "36 hours" in got["text"] and got["refs"] == ["SOP-001#limits"]
    engine.llm = ScriptedLLM(["Vials are stored for 99 hours [1].", "", ""])
    got = engine.multimodal(q, ["quality"])
    assert got["verdict"] == "answered" and "99" not in got["text"]
    engine.llm = engine.renderer = None


def test_traces_and_evaluation_of_all_pipelines(engine, spark):
    from verispan.engine import evaluate
    from verispan.models import FunctionLLM

    engine.tables = {"batch": spark.createDataFrame([("b1", 5)], "id string, units long")}
    rows = [("1", "How long are vials stored at 4 degrees?", "lookup", "answered", [["36 hours"]], ["SOP-001#limits"]), ("2", "What is the discount for Northwind?", "forbidden", "access_denied", [], [])]
    q = spark.createDataFrame([(i, t, k, "", v, ["quality"], f, ["17"], r, []) for i, t, k, v, f, r in rows], "qid string, text string, type string, hypothesis string, expected_verdict string, groups array<string>, key_facts array<array<string>>, secret_facts array<string>, section_refs array<string>, table_refs array<string>")
    q = q.withColumn("embedding", engine.embedder.embed(F.col("text"))).withColumn("expected_answer", F.lit("x"))
    acl = engine.chunks.select("document_id", "groups").distinct()
    engine.llm = FunctionLLM(lambda system, user: "NO_SQL" if system.startswith("Tables") else '{"action": "finish"}')
    out = evaluate(engine, ["naive", "hybrid", "sql", "agentic"], q, acl).cache()
    assert {(r["pipeline"], r["qid"]) for r in out.collect()} == {(p, i) for p in ("naive", "hybrid", "sql", "agentic") for i in "12"}
    got = {(r["pipeline"], r["qid"]): r for r in out.collect()}
    assert not any(r["leaked"] for r in got.values()) and all(r["ms"] > 0 for r in got.values())
    assert got["hybrid", "1"]["grade"] == "correct" and got["hybrid", "2"]["verdict_ok"] and got["sql", "1"]["grade"] == "wrong"
    engine.llm = None
    assert evaluate(engine, ["hybrid", "sql"], q, acl).select("pipeline").distinct().count() == 1
    answers, events, receipts = engine.traced("naive", q)
    assert events.filter("event_json LIKE '%Northwind%'").count() == 0 and events.filter("admin LIKE '%Northwind%'").count() == 1
    assert R.verify_chain(events, receipts).filter("ok").count() == 2
    judged = FunctionLLM(lambda system, user: "partial, I'd say")
    assert {r["grade"] for r in evaluate(engine, ["hybrid"], q, acl, judge=judged).collect()} == {"partial", None}


def test_agent_reads_nothing_restricted(engine):
    engine.llm = ScriptedLLM([json.dumps({"action": "read", "input": "MEMO-01"}), '{"action": "finish"}'])
    got = engine.agent("What is the discount for Northwind?", ["quality"])
    assert got["verdict"] != "answered" and got["refs"] == []
    engine.llm = None


def test_approximate_search_finds_nine_of_ten(spark):
    from verispan.operators import ann
    from verispan.plans import bindings as B

    d = "/root/testdata/sf0.01"
    chunks, questions = B.vector_chunks(spark, d), B.vector_questions(spark, d)
    found = {(r["qid"], r["chunk_id"]) for r in ann.search(ann.build(chunks), questions).hits.collect()}
    true = {(r["qid"], r["chunk_id"]) for r in S.vector_search(chunks, questions).hits.collect()}
    assert len(found & true) / len(true) >= 0.9
    index = ann.build(chunks.limit(0))
    assert ann.search(index, questions).hits.count() == 0


def test_approximate_search_moves_each_task_s_best_only(spark):
    from verispan.operators import ann
    from verispan.plans import bindings as B

    d = "/root/testdata/sf0.01"
    chunks, questions = B.vector_chunks(spark, d), B.vector_questions(spark, d)
    index = ann.build(chunks)
    hits = ann.search(index, questions).hits
    assert "Join" not in hits._jdf.queryExecution().optimizedPlan().toString()
    index.probes = len(index.centroids)  # all cells give the exact search
    told = lambda df: {(r["qid"], r["rank"], r["chunk_id"], round(r["score"], 6)) for r in df.collect()}
    assert told(ann.search(index, questions).hits) == told(S.vector_search(chunks, questions).hits)


def test_csv(spark, tmp_path):
    f = tmp_path / "t.csv"
    f.write_text("Id,Amount (EUR),Region\n1,2.5,north\n2,,\n")
    df = corpus.read_csv(spark, str(f))
    assert df.dtypes == [("id", "bigint"), ("amount_eur", "double"), ("region", "string")]
    assert [tuple(r) for r in df.collect()] == [(1, 2.5, "north"), (2, None, None)]


def test_streams(spark, tmp_path):
    from verispan.streaming.live import event_counts, stream_uploads

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# H\nbody of text\n")
    stream_uploads(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).select("chunk_id").first()[0] == "a#h-1"
    e = spark.createDataFrame([("x", 1.0)], "event_type string, value double").withColumn("ts", F.lit("2024-01-01 05:00:00").cast("timestamp"))
    assert event_counts(e).first()["n"] == 1


def test_whole_leak_sweep(spark):
    from verispan.models import HashingEmbedder

    rows = [
        ("c1", "D1", "D1#a", "Alpha costs rose. SOP-1001 grew. Third one.", ["x"], False),
        ("c2", "D1", "D1#b", "Open notes on SOP-1001 and alpha.", ["x", "y"], False),
        ("c3", "D2", "D2#a", "Beta plan for SOP-2002. It is secret.", ["y"], False),
        ("c4", "D2", "D2#a", "Beta row | 5", ["x", "y"], True),
        ("c5", "D3", "D2#a", "Shared beta ref with SOP-1001.", ["x"], False),
    ]
    chunks = spark.createDataFrame([(*r, f"Title {r[1]}", "s", "current", "", "upload") for r in rows], "chunk_id string, document_id string, ref string, text string, groups array<string>, is_table_row boolean, title string, section string, status string, context string, doc_type string")
    emb = HashingEmbedder(16)
    chunks = chunks.withColumn("embedding", emb.embed(F.col("text")))
    groups = chunks.select(F.explode("groups").alias("grp")).distinct()
    q = E.sweep_questions(chunks, groups, emb)
    n = {r["grp"]: r["count"] for r in q.groupBy("grp").count().collect()}
    assert n == {"x": 3, "y": 5}
    got = {r["path"]: (r["checks"], r["leaks"]) for r in E.sweep_hidden(chunks, groups, emb, G.mentions(chunks)).collect()}
    assert set(got) == {"vector pre", "vector post", "keyword", "document", "by_ref", "graph"}
    assert all(leaks == 0 and checks > 0 for checks, leaks in got.values())
    # x sees c1, c2, c4, c5 and y sees c2, c3, c4, table rows too.
    assert got["vector pre"] == got["vector post"] == (3 * 4 + 5 * 3, 0)
    # y is refused c1 and c5: D1 gives c2, ref D2#a gives c3. x is refused c3: ref D2#a gives c5.
    assert got["document"] == (1, 0) and got["by_ref"] == (2, 0)
