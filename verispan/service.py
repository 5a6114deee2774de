"""Workspaces of uploaded files, asked through several pipelines at once; and a command line."""

from __future__ import annotations

import argparse
import hmac
import re
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verispan.engine import BY_MODEL, RETRIEVAL, Engine, build_engine
from verispan.models import LLM, HashingEmbedder
from verispan.operators.ingest import chunk_uploads, embedding_text

MAX_FILES, MAX_BYTES, MAX_CHUNKS, MAX_QUESTION, SOURCE_CHARS, THREADS = 20, 2_000_000, 3000, 600, 1500, 6
PIPELINES = RETRIEVAL


class ServiceError(Exception):
    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


def authorized(header: str | None, token: str | None) -> bool:
    """Whether a bearer header has the token; without a token nobody is let in."""
    return bool(token) and hmac.compare_digest((header or "").encode(), f"Bearer {token}".encode())


class Workspaces:
    """Files of visitors, each workspace apart; a workspace is built again as a whole at each upload."""

    def __init__(self, spark: SparkSession, embedder=None, groups: Sequence[str] = ("owner",), llm: LLM | None = None):  # noqa: ANN001
        self.llm = llm
        self.spark, self.embedder, self.groups = spark, embedder or HashingEmbedder(), tuple(groups)
        self.files: dict[str, dict[str, str]] = {}
        self.tables: dict[str, dict[str, DataFrame]] = {}
        self.engines: dict[str, Engine] = {}

    def upload(self, workspace: str, name: str, data: bytes) -> int:
        """The number of chunks after the upload."""
        from verispan.sources.corpus import csv_table, extract_text, table_name

        if not re.fullmatch(r"[A-Za-z0-9_-]{8,80}", workspace):
            raise ServiceError(400, "bad workspace id")
        if not re.search(r"(?i)\.(md|txt|pdf|csv)$", name):
            raise ServiceError(415, "unsupported kind of file")
        if len(data) > MAX_BYTES:
            raise ServiceError(413, "the file is too large")
        held, tables = self.files.get(workspace, {}), dict(self.tables.get(workspace, {}))
        if name not in held and len(held) >= MAX_FILES:
            raise ServiceError(409, "too many files")
        try:
            files = held | {name: extract_text(name, data)}
            if name.lower().endswith(".csv"):
                tables[table_name(name)] = csv_table(self.spark, name, data)
        except ValueError as e:
            raise ServiceError(422, str(e)) from e
        rows = self.spark.createDataFrame(sorted((n, t) for n, t in files.items() if not n.lower().endswith(".csv")), "name string, text string")
        chunks = chunk_uploads(rows, groups=self.groups)
        if not files[name].strip():
            raise ServiceError(422, "the file has no text")
        n = chunks.count()
        if n > MAX_CHUNKS:
            raise ServiceError(413, "too many chunks")
        self.files[workspace], self.tables[workspace] = files, tables
        embedded = chunks.withColumn("embedding", self.embedder.embed(embedding_text()))
        self.engines[workspace] = Engine(self.spark, embedded, self.embedder, tables=tables, llm=self.llm, reveal=False)
        return n

    def describe(self, workspace: str | None = None) -> dict:
        """Limits and pipelines; of a workspace its files, tables and chunks."""
        about = {"pipelines": list(self.pipelines()), "max_files": MAX_FILES, "max_bytes": MAX_BYTES, "max_question": MAX_QUESTION}
        if workspace is None:
            return about
        if workspace not in self.engines:
            raise ServiceError(410, "no such workspace")
        tables = {t: {c: k for c, k in df.dtypes} for t, df in self.tables[workspace].items()}
        return about | {"files": sorted(self.files[workspace]), "tables": tables, "chunks": self.engines[workspace].chunks.count()}

    def pipelines(self) -> tuple[str, ...]:
        """Those that can run: the ones that need a model are left out without one."""
        return PIPELINES + (BY_MODEL if self.llm else ())

    def delete(self, workspace: str) -> None:
        self.files.pop(workspace, None)
        self.tables.pop(workspace, None)
        self.engines.pop(workspace, None)

    def ask(self, workspace: str, question: str, pipelines: Sequence[str] | None = None) -> list[dict]:
        pipelines = self.pipelines() if pipelines is None else pipelines
        if unknown := sorted(set(pipelines) - set(self.pipelines())):
            raise ServiceError(400, f"no such pipeline: {unknown[0]}")
        if not question.strip() or len(question) > MAX_QUESTION:
            raise ServiceError(400, "bad question")
        if workspace not in self.engines:
            raise ServiceError(410, "no such workspace")
        engine = self.engines[workspace]

        def one(pipeline: str) -> dict:
            def run() -> dict:
                if pipeline in BY_MODEL:
                    found = engine.sql(question, self.groups) if pipeline == "sql" else engine.agent(question, self.groups)
                    return {"verdict": found["verdict"], "text": found["text"], "sources": [{"ref": r} for r in found.get("refs", [])]}
                asked = engine.ask_table([("q", question, self.groups)])
                got = engine.answer(pipeline, asked).first()
                return {"verdict": got["verdict"], "text": got["text"], "sources": sources(engine.chunks, got["retrieved_refs"], self.groups)}

            return {"pipeline": pipeline} | engine.guarded(run)

        with ThreadPoolExecutor(THREADS) as pool:
            return list(pool.map(one, pipelines))


def sources(chunks: DataFrame, refs: Sequence[str], groups: Sequence[str]) -> list[dict]:
    """The cited chunks, fetched once more as the asker, each text cut for display."""
    from verispan.operators.search import by_ref

    rows = by_ref(chunks, list(refs), list(groups)).select("ref", "title", "section", F.left("text", F.lit(SOURCE_CHARS)).alias("text")).collect()
    return [r.asDict() for r in rows]


def handler(workspaces: Workspaces, token: str | None) -> type:
    """A request handler: GET /healthz, /describe and /workspaces/<id>; POST /workspaces/<id>/files?name= and /ask; DELETE /workspaces/<id>.

    All but /healthz want the bearer token; without one set nobody is let in.
    """
    import json
    from http.server import BaseHTTPRequestHandler
    from urllib.parse import parse_qs, urlsplit

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args) -> None:  # noqa: ANN002
            pass

        def _send(self, status: int, body: object) -> None:
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _body(self) -> bytes:
            n = int(self.headers.get("Content-Length") or 0)
            if n > MAX_BYTES:
                raise ServiceError(413, "the request is too large")
            return self.rfile.read(n)

        def _route(self, method: str) -> object:
            url = urlsplit(self.path)
            where = [x for x in url.path.split("/") if x]
            if method == "GET" and where == ["healthz"]:
                return {"ok": True}
            if not authorized(self.headers.get("Authorization"), token):
                raise ServiceError(401, "not authorized")
            if method == "GET" and where == ["describe"]:
                return workspaces.describe()
            if len(where) >= 2 and where[0] == "workspaces":
                if method == "GET" and len(where) == 2:
                    return workspaces.describe(where[1])
                if method == "DELETE" and len(where) == 2:
                    workspaces.delete(where[1])
                    return {"deleted": where[1]}
                if method == "POST" and where[2:] == ["files"]:
                    return {"chunks": workspaces.upload(where[1], parse_qs(url.query).get("name", [""])[0], self._body())}
            if method == "POST" and where == ["ask"]:
                try:
                    said = json.loads(self._body())
                    asked = str(said["workspace"]), str(said["question"]), said.get("pipelines")
                except (ValueError, KeyError, TypeError, AttributeError) as e:
                    raise ServiceError(400, "the body must be JSON with a workspace and a question") from e
                return workspaces.ask(*asked)
            raise ServiceError(404, "no such place")

        def _do(self, method: str) -> None:
            try:
                self._send(200, self._route(method))
            except ServiceError as e:
                self._send(e.status, {"error": str(e)})

        def do_GET(self) -> None:  # noqa: N802
            self._do("GET")

        def do_POST(self) -> None:  # noqa: N802
            self._do("POST")

        def do_DELETE(self) -> None:  # noqa: N802
            self._do("DELETE")

    return Handler


def serve(workspaces: Workspaces, port: int, token: str | None, host: str = "127.0.0.1"):  # noqa: ANN201
    """An HTTP server over workspaces, not started yet: serve_forever() runs it."""
    from http.server import ThreadingHTTPServer

    return ThreadingHTTPServer((host, port), handler(workspaces, token))


def main(argv: Sequence[str] | None = None) -> int:
    """ask, eval, sweep and gate over a folder of documents; 1 for a rejected gate or a leak."""
    from verispan.operators import evaluate as E
    from verispan.operators import graph as G
    from verispan.session import local_session, settled
    from verispan.sources import corpus, sinks

    p = argparse.ArgumentParser()
    p.add_argument("command", choices=("ask", "eval", "sweep", "gate"))
    p.add_argument("--documents", required=True)
    p.add_argument("--golden")
    p.add_argument("--out")
    p.add_argument("--baseline", help="the folder of a saved run that the gate compares with")
    p.add_argument("--group", default="quality")
    p.add_argument("--pipeline", default="hybrid")
    p.add_argument("question", nargs="?", default="")
    a = p.parse_args(argv)
    spark = local_session()
    engine = build_engine(spark, corpus.read_documents(spark, a.documents))
    if a.command == "ask":
        got = engine.answer(a.pipeline, engine.ask_table([("q", a.question, [a.group])])).first()
        print(f"{got['verdict']}: {got['text']}")
        return 0
    if a.command == "sweep":
        groups = engine.chunks.select(F.explode("groups").alias("grp")).distinct()
        rows = E.sweep_hidden(engine.chunks, groups, engine.embedder, G.mentions(engine.chunks, engine.names)).collect()
        print("\n".join(f"{r['path']}: {r['checks']} checks, {r['leaks']} leaks" for r in rows))
        return int(any(r["leaks"] for r in rows))
    from verispan.engine import evaluate

    questions, version = corpus.read_golden(spark, a.golden)
    questions = questions.withColumn("embedding", engine.embedder.embed(F.col("text")))
    results = evaluate(engine, PIPELINES + BY_MODEL, questions, corpus.access_lists(spark, a.documents))
    if a.out:
        sinks.save_run(results, a.out, version)
    if a.command == "eval":
        print(sinks.format_matrix(E.summarise_types(results)))
    baseline = sinks.read_run(a.baseline, results) if a.baseline else None
    status = E.gate_status(E.gate(settled(results, "results"), baseline)).first()["status"]
    print(status)
    return int(status == "rejected")


if __name__ == "__main__":
    raise SystemExit(main())
