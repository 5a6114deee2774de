"""The engine: pipelines that answer tables of questions, and an assembly of them over one store of chunks."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verispan.models import ANSWERED, DENIED, FAILED, INSUFFICIENT, LLM, MESSAGES, HashingEmbedder, Metered, PageRenderer, Reranker
from verispan.operators import answer as A
from verispan.operators import graph as G
from verispan.operators import modelled as M
from verispan.operators import search as S
from verispan.operators import trace as R
from verispan.operators.guard import SqlAccessDenied, SqlGuard, SqlRejected, as_text, described, with_budget
from verispan.operators.ingest import embedding_text
from verispan.session import settled

PAGES, EVIDENCE, MAX_STEPS, SQL_SECONDS = 3, 12, 4, 30.0


@dataclass
class Engine:
    """chunks: ingest's columns and an embedding. Pipelines take (qid, text, groups, embedding) and give answers."""

    spark: SparkSession
    chunks: DataFrame
    embedder: object = field(default_factory=HashingEmbedder)
    tables: Mapping[str, DataFrame] = field(default_factory=dict)
    restricted: Mapping[str, Sequence[str]] = field(default_factory=dict)
    names: DataFrame | None = None
    llm: LLM | None = None
    reranker: Reranker | None = None
    renderer: PageRenderer | None = None
    reveal: bool = True
    strict_verify: bool = False
    #: Let the model draft and verify the retrieval pipelines' answers too.
    model_answers: bool = False

    def ask_table(self, texts: Sequence[tuple[str, str, Sequence[str]]]) -> DataFrame:
        """Questions from (qid, text, groups)."""
        rows = self.spark.createDataFrame([(q, t, list(g)) for q, t, g in texts], "qid string, text string, groups array<string>")
        return rows.withColumn("embedding", self.embedder.embed(F.col("text")))

    # --- retrieval ---

    def hits(self, pipeline: str, questions: DataFrame) -> DataFrame:
        if pipeline == "naive":
            return S.vector_search(self.chunks, questions, S.TOP, "post").hits
        base = S.hybrid(self.chunks, questions, table_rows=pipeline == "multimodal", reranker=self.reranker)
        if pipeline == "graph":
            edges = G.mentions(self.chunks, self.names)
            walked = G.walk(edges, G.question_seeds(questions, edges, self.names), questions)
            return G.fuse_with(walked, S.hybrid(self.chunks, questions, S.CANDIDATES, reranker=self.reranker))
        return base

    def answer(self, pipeline: str, questions: DataFrame) -> DataFrame:
        """(qid, text, verdict, citations, retrieved_refs, verifier_changed, support, withheld) of a retrieval pipeline."""
        return self._answered(questions, settled(self.hits(pipeline, questions), "hits"))

    def _answered(self, questions: DataFrame, hits: DataFrame) -> DataFrame:
        if self.llm is None or not self.model_answers:
            return A.answer(questions, hits, self.chunks, reveal=self.reveal)
        drafts = M.generate(questions, hits, self.chunks, self.llm)
        return A.answer(questions, hits, self.chunks, drafts, self.reveal, check=partial(M.verify, model=self.llm))

    def traced(self, pipeline: str, questions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(answers, events, receipts): the answers with a trace of each, a bundle to a question, its receipts chained."""
        if pipeline == "naive":
            found = S.vector_search(self.chunks, questions, S.TOP, "post")
            hits, removed = settled(found.hits, "hits"), found.removed
        else:
            hits, removed = settled(self.hits(pipeline, questions), "hits"), None
        answers = settled(self._answered(questions, hits), "answers")
        events = settled(R.of_answers(questions, hits, answers, removed), "events")
        return answers, events, R.chain(events)

    def page_refs(self, questions: DataFrame) -> DataFrame:
        """(qid, ref): of each question's multimodal hits the first distinct pages that an image would be made of."""
        held = self.hits("multimodal", questions).join(self.chunks.select("chunk_id", "ref"), "chunk_id")
        first = held.groupBy("qid", "ref").agg(F.min("rank").alias("rank"))
        return S.best(first.withColumn("score", -F.col("rank").cast("double")), PAGES, ident="ref").select("qid", "ref", "rank")

    # --- one question through a model ---

    def guard(self) -> SqlGuard:
        return SqlGuard(self.spark, self.tables, restricted=self.restricted)

    def sql(self, question: str, groups: Sequence[str]) -> dict:
        """A model's SQL under the guard. The last verification is recorded; with strict_verify it also decides."""
        if self.llm is None:
            raise ValueError("the sql pipeline needs a model")
        g = self.guard()
        prompt = f"Tables:\n{described(g.views(groups))}\nAnswer with one SELECT, or NO_SQL."
        said = re.sub(r"^```\w*\s*|\s*```$", "", self.llm.complete(prompt, question).text.strip()).strip()
        if not said or said.upper().startswith("NO_SQL"):
            return _result(INSUFFICIENT)
        try:
            columns, rows = with_budget(self.spark, g.run(said, groups), SQL_SECONDS)
        except SqlAccessDenied:
            return _result(DENIED if self.reveal else INSUFFICIENT, sql=said)
        except SqlRejected as e:
            return _result(FAILED, sql=said, error=str(e))
        if not rows:
            return _result(INSUFFICIENT, sql=said)
        text = as_text(columns, rows)
        evidence = f"{question}\n{text}"
        phrased = self.llm.complete("Phrase the rows as an answer; cite [1].", evidence).text.strip()
        kept = phrased if phrased and self._supported(phrased, evidence) else f"{text} [1]"
        ok = self._supported(kept, evidence)
        verdict = ANSWERED if ok or not self.strict_verify else "verification_failed"
        return _result(verdict, kept if verdict == ANSWERED else None, sql=said, refs=[f"table:{t}" for t in g.tables_of(said)], support=1.0 if ok else 0.0)

    def _supported(self, text: str, evidence: str) -> bool:
        one = self.spark.createDataFrame([("q", text, 1, "e", "", evidence)], "qid string, draft string, rank int, chunk_id string, context string, text string")
        return bool(A.verify(one.select("qid", "draft"), one.select("qid", "chunk_id", "rank"), one.select("chunk_id", "context", "text")).first()["supported"])

    def agent(self, question: str, groups: Sequence[str], max_steps: int = MAX_STEPS) -> dict:
        """A model picks search, read, related, sql or finish; all that it finds is pooled and answered by the common tail."""
        if self.llm is None:
            raise ValueError("the agentic pipeline needs a model")
        asked = self.ask_table([("q", question, groups)])
        pool: list[str] = []
        notes, bad, sql_note, log = [], 0, None, []
        for _ in range(max_steps):
            action = parse_action(self.llm.complete("Reply with a JSON action: search, read, related, sql or finish.", "\n".join([question, *notes])).text)
            if action is None:
                bad += 1
                if bad == 2:
                    return _result(FAILED, error="AgentProtocolError")
                notes.append("That was not a JSON action.")
                continue
            kind, value = action["action"], str(action.get("input", ""))
            log.append(kind)
            if kind == "finish":
                break
            if kind == "search":
                found = self._ids(self.hits("hybrid", self.ask_table([("q", value or question, groups)])))
            elif kind == "read":
                found = [r[0] for r in S.document(self.chunks, value, groups).select("chunk_id").limit(EVIDENCE).collect()]
            elif kind == "related":
                edges = G.mentions(self.chunks, self.names)
                seeds = self.spark.createDataFrame([("q", value)], "qid string, entity string")
                found = self._ids(G.walk(edges, seeds, asked).filter(F.col("rank") <= EVIDENCE))
            elif kind == "sql":
                got = self.sql(value or question, groups)
                sql_note = got["text"] if got["verdict"] == ANSWERED else sql_note
                notes.append(f"sql: {got['text'] or got['verdict']}")
                continue
            else:
                notes.append(f"There is no action {kind}.")
                continue
            pool += [x for x in found if x not in pool]
            notes.append(f"{kind}: {len(found)} hits")
        return self._agent_answer(asked, pool, sql_note) | {"steps": log}

    @staticmethod
    def _ids(hits: DataFrame) -> list[str]:
        return [r["chunk_id"] for r in hits.orderBy("rank").select("chunk_id").collect()]  # k of them

    def _agent_answer(self, asked: DataFrame, pool: list[str], sql_note: str | None) -> dict:
        """Evidence by how many of the question's terms it holds, then as first seen; an SQL note stands first."""
        seen = self.spark.createDataFrame([(x, i) for i, x in enumerate(pool)], "chunk_id string, seen int")
        held = self.chunks.join(F.broadcast(seen), "chunk_id")
        rows = held.join(F.broadcast(asked.select("qid", F.col("text").alias("question"))))
        hits = S.evidence_rank(rows, EVIDENCE).select("qid", "chunk_id", "score", F.lit("read").alias("source"), "rank")
        chunks = self.chunks
        if sql_note is not None:
            note = {"chunk_id": F.lit("table:sql"), "ref": F.lit("table:sql"), "text": F.lit(sql_note), "context": F.lit(""), "groups": asked.select("groups").first()[0], "status": F.lit("current"), "is_table_row": F.lit(False)}
            cols = [(note[c] if not isinstance(note[c], list) else F.array(*map(F.lit, note[c]))) if c in note else F.lit(None) for c in chunks.columns]
            one = self.spark.range(1).select(*[x.cast(chunks.schema[c].dataType).alias(c) for x, c in zip(cols, chunks.columns, strict=True)])
            chunks = chunks.unionByName(one)
            first = asked.select("qid", F.lit("table:sql").alias("chunk_id"), F.lit(0.0).alias("score"), F.lit("sql").alias("source"), F.lit(1).alias("rank"))
            hits = hits.withColumn("rank", F.col("rank") + 1).unionByName(first)
        got = A.answer(asked, hits, chunks, reveal=self.reveal).first()
        return _result(got["verdict"], got["text"] if got["verdict"] == ANSWERED else None, refs=list(got["retrieved_refs"]), support=got["support"])

    def read_pages(self, question: str, groups: Sequence[str]) -> list[tuple[str, str]]:
        """(ref, text) of what a model reads on the images of the first pages found; what the page's own text doesn't hold is left out."""
        if self.llm is None or self.renderer is None:
            return []
        refs = [r["ref"] for r in self.page_refs(self.ask_table([("q", question, groups)])).orderBy("rank").collect()]
        held = {r["ref"]: r["text"] for r in S.by_ref(self.chunks, refs, groups).select("ref", "text").collect()}  # PAGES pages at most
        out = []
        for ref in refs:
            image = self.renderer(ref) if ref in held else None
            said = self.llm.complete("Answer from the page in a sentence; cite it as [1].", question, images=[image]).text.strip() if image else ""
            if said and self._supported(said, held[ref]):
                out.append((ref, said))
        return out

    def multimodal(self, question: str, groups: Sequence[str]) -> dict:
        """An answer read from pages where their texts hold it, else that of the common tail over hits with table rows."""
        if pages := self.read_pages(question, groups):
            text = " ".join(re.sub(r"\[\d+\]", f"[{i}]", said) for i, (_, said) in enumerate(pages, 1))
            return _result(ANSWERED, text, refs=[ref for ref, _ in pages], support=1.0)
        got = self.answer("multimodal", self.ask_table([("q", question, groups)])).first()
        return _result(got["verdict"], got["text"], refs=list(got["retrieved_refs"]), support=got["support"])

    def guarded(self, run: Callable[[], dict]) -> dict:
        """Any error becomes a verdict; its type is public, its message is the administrators'."""
        try:
            return run()
        except Exception as e:
            return _result(FAILED, error=type(e).__name__) | {"admin": str(e)}


def parse_action(text: str) -> dict | None:
    """The first {...} of a reply, to its last brace, if it is JSON with an action."""
    m = re.search(r"\{.*\}", text, re.S)
    try:
        found = json.loads(m[0]) if m else None
    except ValueError:
        return None
    return found if isinstance(found, dict) and "action" in found else None


def _result(verdict: str, text: str | None = None, **more) -> dict:  # noqa: ANN003
    return {"verdict": verdict, "text": text if text is not None else MESSAGES.get(verdict), **more}


def build_engine(spark: SparkSession, documents: DataFrame, embedder=None, **options) -> Engine:  # noqa: ANN001
    """An engine over parsed documents: sections and table rows as chunks, with embeddings."""
    from verispan.operators.ingest import chunk_documents

    embedder = embedder or HashingEmbedder()
    chunks = chunk_documents(documents).withColumn("embedding", embedder.embed(embedding_text()))
    return Engine(spark, chunks, embedder, **options)


RETRIEVAL, BY_MODEL = ("naive", "hybrid", "graph", "multimodal"), ("sql", "agentic")
_ANSWERS = "qid string, text string, verdict string, citations array<struct<n:int,kind:string,ref:string>>, retrieved_refs array<string>, verifier_changed boolean, support double"


def _one_by_one(engine: Engine, pipeline: str, questions: DataFrame) -> DataFrame:
    """Answers of a pipeline that talks to a model for each question; the set of questions is a golden set's."""
    rows = []
    for q in questions.select("qid", "text", "groups").collect():
        got = engine.guarded(partial(engine.sql if pipeline == "sql" else engine.agent, q["text"], q["groups"]))
        rows.append((q["qid"], got["text"], got["verdict"], [], got.get("refs", []), False, got.get("support")))
    return engine.spark.createDataFrame(rows, _ANSWERS)


def evaluate(engine: Engine, pipelines: Sequence[str], questions: DataFrame, acl: DataFrame, judge: LLM | None = None) -> DataFrame:
    """Results of all pipelines over all questions, one row for each of both, with time and cost per question.

    Pipelines that need a model are left out where there is none. Traces of retrieval pipelines are
    searched for leaks, and their chains are verified: a broken one stops the run.
    """
    from verispan.operators.evaluate import score

    questions = settled(questions, "questions")
    n, out = max(1, questions.count()), None
    for p in pipelines:
        if p in BY_MODEL and engine.llm is None:
            continue
        plain, engine.llm = engine.llm, engine.llm and Metered(engine.llm)
        began, trace = time.perf_counter(), None
        try:
            if p in BY_MODEL:
                answers = _one_by_one(engine, p, questions)
            else:
                answers, events, receipts = engine.traced(p, questions)
                bad = R.verify_chain(events, settled(receipts, "receipts")).filter("NOT ok").first()
                if bad:
                    raise ValueError(f"the trace of {bad['bundle_id']} does not verify: {bad['reason']}")
                trace = events.filter("sequence = 2").select(F.col("bundle_id").alias("qid"), F.get_json_object("event_json", "$.payload").alias("payload"))
            took, spent = (time.perf_counter() - began) * 1000 / n, engine.llm.spent[2] / n if engine.llm else 0.0
        finally:
            engine.llm = plain
        grades = M.judge(questions, answers, judge) if judge else None
        rows = score(questions, answers, acl, trace, grades=grades).withColumn("pipeline", F.lit(p)).withColumns({"ms": F.lit(took), "cost_usd": F.lit(spent)})
        out = rows if out is None else out.unionByName(rows)
    return out
