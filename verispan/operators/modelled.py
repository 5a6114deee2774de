"""Drafts, verification and grades by a model, for tables of questions: one prompt a row, sent from the tasks.

A model is any object with complete(system, user) that can be shipped to the executors. What
it says is read strictly: an unreadable verdict supports nothing, an unreadable grade is wrong.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verispan.functions.text import claims
from verispan.operators.answer import numbered_sources, support_rate
from verispan.session import ship

#: What a model says when its sources don't hold the answer.
SENTINEL = "INSUFFICIENT_EVIDENCE"


def asked(rows: DataFrame, model, system: str, prompt: str = "prompt", out: str = "reply") -> DataFrame:  # noqa: ANN001
    """rows with the model's reply to each prompt; a null prompt is not sent and has a null reply."""
    from pyspark.sql.types import StringType, StructField, StructType

    ship(rows.sparkSession)
    at = rows.columns.index(prompt)
    names = [*rows.columns, out]

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            said = [None if p is None else model.complete(system, p).text for p in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(said, pa.string())], names)

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(out, StringType())]))


def generate(questions: DataFrame, hits: DataFrame, chunks: DataFrame, model) -> DataFrame:  # noqa: ANN001
    """(qid, draft, insufficient): a question without hits is insufficient and not sent; so is what the model declines."""
    rows = questions.select("qid", F.col("text").alias("question")).join(numbered_sources(hits, chunks), "qid", "left")
    prompt = F.when(F.col("sources").isNotNull(), F.concat("question", F.lit("\n\nSources:\n"), "sources"))
    said = asked(rows.select("qid", prompt.alias("prompt")), model, f"Answer from the sources only and cite them as [n]. If they don't hold the answer, say {SENTINEL}.")
    none = F.col("reply").isNull() | F.contains("reply", F.lit(SENTINEL)) | (F.trim("reply") == "")
    return said.select("qid", F.when(none, "").otherwise(F.trim("reply")).alias("draft"), none.alias("insufficient"))


def verify(answers: DataFrame, hits: DataFrame, chunks: DataFrame, model, text: str = "draft") -> DataFrame:  # noqa: ANN001
    """(qid, claims, unsupported, supported, support): a model says of each claim whether the sources hold it, as a JSON list of booleans."""
    rows = answers.select("qid", F.transform(claims(F.coalesce(text, F.lit(""))), lambda c: c["text"]).alias("cs")).join(numbered_sources(hits, chunks), "qid", "left")
    listed = F.array_join(F.transform("cs", lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c)), "\n")
    prompt = F.when(F.size("cs") > 0, F.concat(F.lit("Claims:\n"), listed, F.lit("\n\nSources:\n"), F.coalesce("sources", F.lit(""))))
    said = asked(rows.select("qid", "cs", prompt.alias("prompt")), model, "Reply with a JSON list of booleans, one for each claim: whether the sources hold it.")
    found = F.from_json(F.regexp_extract("reply", r"(?s)\[.*\]", 0), "array<boolean>")
    fits = F.coalesce(F.size(found) == F.size("cs"), F.lit(False))
    ok = F.when(fits, F.transform(found, lambda x: F.coalesce(x, F.lit(False)))).otherwise(F.transform("cs", lambda c: F.lit(False)))
    bad = F.transform(F.filter(F.arrays_zip(F.col("cs"), ok.alias("ok")), lambda x: ~x["ok"]), lambda x: x["cs"])
    n = F.size("cs").cast("long")
    return said.withColumn("bad", bad).select("qid", n.alias("claims"), F.col("bad").alias("unsupported"), (F.size("bad") == 0).alias("supported"), support_rate(n, F.size("bad")).alias("support"))


def judge(questions: DataFrame, answers: DataFrame, model) -> DataFrame:  # noqa: ANN001
    """(qid, grade): correct, partial or wrong as a model says; anything else is wrong."""
    q = questions.select("qid", F.col("text").alias("question"), "expected_answer")
    rows = q.join(answers.select("qid", "text"), "qid")
    prompt = F.concat("question", F.lit("\nExpected: "), F.coalesce("expected_answer", F.lit("")), F.lit("\nGiven: "), F.coalesce("text", F.lit("")))
    said = asked(rows.select("qid", prompt.alias("prompt")), model, "Grade the given answer in one word: correct, partial or wrong.")
    word = F.lower(F.regexp_extract("reply", r"(?i)\b(correct|partial|wrong)\b", 1))
    return said.select("qid", F.when(word.isin("correct", "partial"), word).otherwise("wrong").alias("grade"))


def read_verdicts(text: str, n: int) -> list[bool]:
    """The same reading for one reply on the driver."""
    m = re.search(r"\[.*\]", text, re.S)
    try:
        found = json.loads(m[0]) if m else None
    except ValueError:
        found = None
    return [x is True for x in found] if isinstance(found, list) and len(found) == n else [False] * n
