"""Scoring, leak detection, summaries, the release gate, hypotheses, the leak sweep and corpus checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verispan.functions.text import document_of, facts_found, numbers, sentences
from verispan.operators.trace import refs_in

HYBRID_MIN, SQL_MIN, REGRESSION_LIMIT, HUMAN_MIN = 10, 6, 2, 18


def grade(key_facts: Column, text: Column) -> Column:
    """correct: all facts, and at least one; partial: some; else wrong."""
    n = facts_found(key_facts, text)
    return F.when((F.size(key_facts) > 0) & (n == F.size(key_facts)), "correct").when(n > 0, "partial").otherwise("wrong")


def leaks(questions: DataFrame, answers: DataFrame, acl: DataFrame, trace: DataFrame | None = None) -> DataFrame:
    """(qid, detail): the first thing outside the asker's access that was retrieved, cited, traced or stated.

    acl: (document_id, groups). A document that it doesn't list is open. trace: (qid, payload) JSON.
    """
    asked = answers.join(questions.select("qid", F.col("groups").alias("_asker"), "secret_facts"), "qid")

    def hidden(refs: DataFrame) -> DataFrame:
        found = refs.withColumn("document_id", document_of(F.col("ref"))).join(acl.withColumnRenamed("groups", "_acl"), "document_id")
        return found.filter(~F.arrays_overlap("_acl", "_asker")).groupBy("qid").agg(F.min_by("ref", "i").alias("ref"))

    cited = F.transform("citations", lambda c: c["ref"])
    direct = hidden(asked.select("qid", "_asker", F.posexplode(F.concat("retrieved_refs", cited)).alias("i", "ref"))).withColumnRenamed("ref", "direct")
    out = asked.join(direct, "qid", "left")
    if trace is not None:
        found = trace.join(questions.select("qid", F.col("groups").alias("_asker")), "qid")
        traced = found.select("qid", "_asker", F.posexplode(refs_in(F.col("payload"))).alias("i", "ref"))
        out = out.join(hidden(traced).withColumnRenamed("ref", "traced"), "qid", "left")
    else:
        out = out.withColumn("traced", F.lit(None).cast("string"))
    stated = F.exists(
        "secret_facts",
        lambda s: F.when(s.rlike("^[0-9]+$"), F.array_contains(numbers(F.col("text")), s)).otherwise(F.contains(F.lower("text"), F.lower(s))),
    )
    detail = F.coalesce(
        F.concat(F.lit("restricted evidence reached the answer: "), "direct"),
        F.concat(F.lit("restricted reference in the public trace: "), "traced"),
        F.when(stated, "restricted value stated in the answer"),
    )
    return out.select("qid", F.coalesce(detail, F.lit("")).alias("detail"))


def score(questions: DataFrame, answers: DataFrame, acl: DataFrame, trace: DataFrame | None = None, judge=grade, grades: DataFrame | None = None) -> DataFrame:  # noqa: ANN001
    """One row per answer: verdict_ok, grade, recall, leaked and so on. A right figure without its table is luck, and wrong.

    Grades come from judge, a Column function of facts and text, or from grades (qid, grade), such as a model's.
    """
    rows = questions.join(answers, "qid", "inner") if "text" not in questions.columns else questions.withColumnRenamed("text", "question").join(answers, "qid")
    rows = rows.join(leaks(questions, answers, acl, trace), "qid")
    if grades is not None:
        rows = rows.join(grades.select("qid", F.col("grade").alias("_grade")), "qid", "left")
        judge = lambda facts, text: F.coalesce("_grade", F.lit("wrong"))
    expects = F.col("expected_verdict") == "answered"
    wanted = F.concat("section_refs", "table_refs")
    first = F.when(expects, F.when(F.col("verdict") == "answered", judge(F.col("key_facts"), F.col("text"))).otherwise("wrong"))
    luck = (F.coalesce(first, F.lit("")) == "correct") & (F.size("table_refs") > 0) & ~F.exists("retrieved_refs", lambda r: F.startswith(r, F.lit("table:")))
    got = F.size(F.filter(wanted, lambda r: F.array_contains("retrieved_refs", r)))
    return rows.select(
        "qid",
        "type",
        "hypothesis",
        "verdict",
        (F.col("verdict") == F.col("expected_verdict")).alias("verdict_ok"),
        F.when(luck, "wrong").otherwise(first).alias("grade"),
        F.when(expects & (F.size(wanted) > 0), got / F.size(wanted).cast("double")).alias("recall"),
        "support",
        (F.col("detail") != "").alias("leaked"),
        F.col("detail").alias("leak_detail"),
        "verifier_changed",
        (F.col("verdict") == "execution_failed").alias("execution_failed"),
        luck.alias("coincidental"),
    )


def summarise_types(results: DataFrame) -> DataFrame:
    """Per pipeline and type: questions, correct, partial, verdict_ok, mean recall to 2 places."""
    n = lambda c: F.count_if(c).alias
    return results.groupBy("pipeline", "type").agg(
        F.count(F.lit(1)).alias("questions"),
        n(F.col("grade") == "correct")("correct"),
        n(F.col("grade") == "partial")("partial"),
        n(F.col("verdict_ok"))("verdict_ok"),
        F.round(F.avg("recall"), 2).alias("recall"),
    )


def summarise_pipelines(results: DataFrame) -> DataFrame:
    """Per pipeline: leaks, interventions, failures, cost, the exact median and the value at index min(n-1, int(0.95 n))."""
    at = F.row_number().over(Window.partitionBy("pipeline").orderBy("ms", "qid"))
    n = F.count(F.lit(1)).over(Window.partitionBy("pipeline"))
    rows = results.withColumn("_p95", F.when(at == F.least(n, F.floor(n * 0.95) + 1), F.col("ms")))
    return rows.groupBy("pipeline").agg(
        F.count(F.lit(1)).alias("answers"),
        F.count_if("leaked").alias("leaks"),
        F.count_if("verifier_changed").alias("verifier_interventions"),
        F.count_if("execution_failed").alias("execution_failures"),
        F.round(F.sum("cost_usd"), 4).alias("cost_usd"),
        F.round(F.percentile("ms", 0.5), 1).alias("latency_ms_median"),
        F.round(F.max("_p95"), 1).alias("latency_ms_p95"),
    )


def hypotheses(results: DataFrame) -> DataFrame:
    """Per type with one expected pipeline: the best pipelines, and whether the expectation held."""
    expected = results.groupBy("type").agg(F.min("hypothesis").alias("expected")).filter("expected NOT IN ('all', '')")
    per = results.groupBy("type", "pipeline").agg(F.count_if(F.col("grade") == "correct").alias("correct"))
    per = per.withColumn("r", F.rank().over(Window.partitionBy("type").orderBy(F.desc("correct"))))
    best = per.groupBy("type").agg(
        F.max("correct").alias("best"), F.sort_array(F.collect_list(F.when(F.col("r") == 1, F.col("pipeline")))).alias("winners"), F.collect_set("pipeline").alias("ran")
    )
    outcome = (
        F.when(~F.array_contains("ran", F.col("expected")), "not run")
        .when((F.col("best") == 0) | ~F.array_contains("winners", F.col("expected")), "not confirmed")
        .when(F.size("winners") == 1, "confirmed")
        .otherwise("tied")
    )
    return expected.join(best, "type").select("type", "expected", F.array_join("winners", ",").alias("best"), outcome.alias("outcome"))


def gate(results: DataFrame, baseline: DataFrame | None = None, human: tuple[int, int] | None = None) -> DataFrame:
    """(condition, status, detail) rows. Types without questions pass; what was not run is pending. The results are read once."""
    right, kind, by = F.col("grade") == "correct", F.col("type"), F.col("pipeline")
    one = lambda name, verdict: [F.count_if((kind == name) & (F.col("verdict") == verdict)), F.count_if(kind == name)]
    of = lambda mine: [F.count_if(mine & right), F.count_if(mine)]
    hybrid, sql = (by == "hybrid") & kind.isin("lookup", "superseded"), (by == "sql") & (kind == "numeric")
    found = results.agg(
        F.count_if("leaked").alias("leaks"),
        *[c.alias(n) for c, n in zip(one("forbidden", "access_denied"), ("denied", "forbidden"), strict=True)],
        *[c.alias(n) for c, n in zip(one("out_of_scope", "insufficient_evidence"), ("none", "outside"), strict=True)],
        *[c.alias(n) for c, n in zip(of(hybrid), ("hybrid", "hybrid_of"), strict=True)],
        *[c.alias(n) for c, n in zip(of(sql), ("sql", "sql_of"), strict=True)],
        F.count_if(by == "hybrid").alias("ran_hybrid"),
        F.count_if(by == "sql").alias("ran_sql"),
    )
    if baseline is not None:
        total = lambda df, c: df.groupBy("pipeline").agg(F.count_if(right).alias(c))
        worse = total(results, "now").join(total(baseline, "was"), "pipeline").agg(F.count_if(F.col("was") - F.col("now") > REGRESSION_LIMIT).alias("worse"))
        found = found.join(worse)  # one row each
    status = lambda bad: F.when(bad, "fail").otherwise("pass")
    text = lambda *cs: F.concat(*[F.lit(c) if isinstance(c, str) and c.startswith(" ") else F.col(c).cast("string") for c in cs])
    no = F.lit("not_applicable")
    rows = [
        ("leakage is 0", status(F.col("leaks") > 0), text("leaks", " leaks")),
        ("forbidden questions are denied", status(F.col("denied") < F.col("forbidden")), text("denied", " of ", "forbidden")),
        ("out-of-scope questions are insufficient", status(F.col("none") < F.col("outside")), text("none", " of ", "outside")),
        (f"hybrid scores at least {HYBRID_MIN} on lookup and superseded", F.when(F.col("ran_hybrid") == 0, no).otherwise(status(F.col("hybrid") < HYBRID_MIN)), text("hybrid", " of ", "hybrid_of")),
        (f"sql scores at least {SQL_MIN} on numeric", F.when(F.col("ran_sql") == 0, "pending").otherwise(status(F.col("sql") < SQL_MIN)), text("sql", " of ", "sql_of")),
        (f"no pipeline is over {REGRESSION_LIMIT} worse than the last accepted run", no if baseline is None else status(F.col("worse") > 0), F.lit("no accepted run") if baseline is None else text("worse", " worse")),
        (f"the judge agrees with a human on at least {HUMAN_MIN}", F.lit("pending" if human is None else "pass" if human[0] >= HUMAN_MIN else "fail"), F.lit("no human check" if human is None else f"{human[0]} of {human[1]}")),
    ]
    each = F.inline(F.array(*[F.struct(F.lit(c).alias("condition"), s.alias("status"), d.alias("detail")) for c, s, d in rows]))
    return found.select(each)


def gate_status(conditions: DataFrame) -> DataFrame:
    """One row: rejected over pending over accepted."""
    return conditions.agg(
        F.when(F.bool_or(F.col("status") == "fail"), "rejected").when(F.bool_or(F.col("status") == "pending"), "pending").otherwise("accepted").alias("status")
    )


def sweep_questions(chunks: DataFrame, groups: DataFrame, embedder, extra: DataFrame | None = None) -> DataFrame:  # noqa: ANN001
    """Adversarial questions of each group: titles and first two sentences of what it must not see, and extra texts."""
    from verispan.operators.search import visible

    asker = groups.select(F.col("grp"), F.array("grp").alias("groups"))
    hidden = chunks.filter("NOT is_table_row").withColumnRenamed("groups", "_acl").join(F.broadcast(asker), ~visible("_acl", F.col("groups")))
    texts = hidden.select("grp", "groups", F.explode(F.concat(F.slice(sentences(F.col("text")), 1, 2), F.array("title"))).alias("text"))
    if extra is not None:
        texts = texts.unionByName(asker.join(extra.select("text")).select("grp", "groups", "text"))
    return texts.distinct().withColumn("qid", F.sha1(F.concat_ws("\u0001", "grp", "text"))).withColumn("embedding", embedder.embed(F.col("text")))


def sweep(chunks: DataFrame, found: dict[str, DataFrame], questions: DataFrame) -> DataFrame:
    """(path, checks, leaks): what each retrieval path returned, and how much of it its asker must not see."""
    from verispan.operators.search import visible

    acl = chunks.select("chunk_id", F.col("groups").alias("_acl"))
    asker = questions.select("qid", F.col("groups").alias("_asker"))
    out = None
    for path, hits in found.items():
        rows = hits.select("qid", "chunk_id").join(acl, "chunk_id").join(asker, "qid")
        one = rows.agg(F.lit(path).alias("path"), F.count(F.lit(1)).alias("checks"), F.count_if(~visible("_acl", F.col("_asker"))).alias("leaks"))
        out = one if out is None else out.union(one)
    return out


def sweep_hidden(chunks: DataFrame, groups: DataFrame, embedder, edges: DataFrame, asked: DataFrame | None = None, extra: DataFrame | None = None) -> DataFrame:  # noqa: ANN001
    """The whole sweep: (path, checks, leaks) over vector pre and post, keyword, document, by_ref and graph.

    Texts come from the hidden chunks of `asked` (all chunks if None) and meet all chunks,
    table rows included. Documents, refs and record ids of all hidden chunks are asked for too.
    """
    from verispan.functions.text import entities
    from verispan.operators import graph as G
    from verispan.operators import search as S

    q = sweep_questions(chunks if asked is None else asked, groups, embedder, extra)
    name = lambda g: F.concat(F.lit("sweep-"), g)
    askers = groups.select(name(F.col("grp")).alias("qid"), F.array("grp").alias("groups")).distinct()
    by_ref = documents = seeds = None
    add = lambda out, more: more if out is None else out.unionByName(more)
    for g in sorted(r["grp"] for r in groups.distinct().collect()):
        qid = name(F.lit(g)).alias("qid")
        hidden = chunks.filter(S.eligible() & ~S.visible("groups", [g]))
        by_ref = add(by_ref, S.by_ref(chunks, hidden, [g]).select(qid, "chunk_id"))
        documents = add(documents, S.document(chunks, hidden, [g]).select(qid, "chunk_id"))
        seeds = add(seeds, hidden.select(qid, F.explode(entities(F.concat_ws(" ", "document_id", "text"))).alias("entity")))
    if seeds is None:
        seeds = askers.select("qid", F.lit(None).cast("string").alias("entity")).limit(0)
        by_ref = documents = chunks.select(F.lit("").alias("qid"), "chunk_id").limit(0)
    seeds = seeds.distinct().join(edges.select("entity").distinct(), "entity", "left_semi")
    found = {
        "vector pre": S.vector_search(chunks, q, table_rows=True).hits,
        "vector post": S.vector_search(chunks, q, mode="post", table_rows=True).hits,
        "keyword": S.keyword_search(chunks, q, table_rows=True),
        "document": documents,
        "by_ref": by_ref,
        "graph": G.walk(edges, seeds, askers),
    }
    return sweep(chunks, found, q.select("qid", "groups").unionByName(askers))


def counted_keys(table: DataFrame, key: str) -> DataFrame:
    """One row: rows beyond the first of each key, null keys included."""
    return table.agg((F.count(F.lit(1)) - F.countDistinct(key)).alias("violations"))


def superseded_pointers(chunks: DataFrame, same: str = "text") -> DataFrame:
    """One row: superseded chunks without a current one of the same kind; texts meet as digests, counted before they are moved."""
    kinds = chunks.groupBy(F.md5(same).alias("k")).agg(F.count_if(F.col("status") == "superseded").alias("old"), F.count_if(F.col("status") == "current").alias("now"))
    return kinds.agg(F.coalesce(F.sum(F.when(F.col("now") == 0, F.col("old"))), F.lit(0)).alias("violations"))


def date_order(rows: DataFrame, first: str, then: str) -> DataFrame:
    """One row: rows whose second date stands before the first."""
    return rows.agg(F.count_if(F.col(then) < F.col(first)).alias("violations"))


def foreign_key(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """One row: how many of the child's keys have no parent."""
    return child.select(F.col(key).alias("k")).filter("k IS NOT NULL").join(parent.select(F.col(parent_key).alias("k")), "k", "left_anti").agg(F.count(F.lit(1)).alias("violations"))
