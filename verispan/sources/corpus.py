"""Readers: front-matter documents, JSON and CSV tables, uploads, questions and access lists."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verispan.functions.text import strip

_FRONT = r"(?s)^---\n(.*?)\n---\n(.*)$"


def _meta(head: Column, key: str) -> Column:
    """The value of a front-matter line, null where there is none; of several the last."""
    hits = F.regexp_extract_all(head, F.lit(rf"(?m)^[ \t]*{key}[ \t]*:(.*)$"), F.lit(1))
    return F.when(F.size(hits) > 0, strip(F.element_at(hits, -1)))


def parse_documents(raw: DataFrame, text: str = "value") -> DataFrame:
    """One row per document. A text without front matter or without groups stops the query with its reason."""
    head = F.regexp_extract(text, _FRONT, 1)
    body = F.regexp_extract(text, _FRONT, 2)
    groups = F.filter(F.transform(F.split(F.regexp_replace(_meta(head, "groups"), r"^\[+|\]+$", ""), ","), strip), lambda g: g != "")
    parts = F.split(body, "\n## ")
    sections = F.transform(
        F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda p: F.struct(
            strip(F.substring_index(p, "\n", 1)).alias("heading"),
            strip(F.when(F.contains(p, F.lit("\n")), F.regexp_replace(p, r"^[^\n]*\n", "")).otherwise(F.lit(""))).alias("body"),
        ),
    )
    checked = F.when(~F.regexp_like(text, F.lit(_FRONT)), F.raise_error(F.lit("document has no front matter"))).otherwise(_meta(head, "id"))
    listed = F.when(F.coalesce(F.size(groups), F.lit(0)) == 0, F.raise_error(F.concat(_meta(head, "id"), F.lit(": a document must list at least one group")))).otherwise(groups)
    blank = lambda c: F.when(c != "", c)
    return raw.select(
        checked.cast("string").alias("document_id"),
        F.regexp_replace(_meta(head, "title"), '^"+|"+$', "").alias("title"),
        _meta(head, "type").alias("doc_type"),
        F.coalesce(_meta(head, "version"), F.lit("1")).alias("version"),
        F.coalesce(_meta(head, "status"), F.lit("current")).alias("status"),
        blank(_meta(head, "superseded_by")).alias("superseded_by"),
        listed.cast("array<string>").alias("groups"),
        F.coalesce(_meta(head, "effective"), F.lit("")).alias("effective"),
        sections.alias("sections"),
    )


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """All *.md files of a folder, in the order of their names."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md")
    return parse_documents(raw.withColumn("_file", F.input_file_name()).orderBy("_file"))


def read_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Each *.json array of a folder as a table named by its file."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = fs.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, "*.json"))
    out = {}
    for x in sorted(str(f.getPath()) for f in found or []):
        out[os.path.basename(x)[:-5]] = spark.read.option("multiLine", True).option("primitivesAsString", False).json(x)
    return out


def register_tables(tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def infer_type(values: Column) -> Column:
    """INTEGER, REAL or TEXT for an array of a column's cells; nulls don't count, and none at all is INTEGER."""
    known = F.filter(values, lambda v: v.isNotNull())
    return (
        F.when(F.forall(known, lambda v: v.rlike(r"^-?\d+$")), "INTEGER")
        .when(F.forall(known, lambda v: v.rlike(r"^-?\d+(\.\d+)?$")), "REAL")
        .otherwise("TEXT")
    )


def column_name(name: str, i: int = 0) -> str:
    import re

    return re.sub(r"\W+", "_", name.strip().lower()).strip("_") or f"col{i}"


def table_name(file: str) -> str:
    import re

    stem = re.sub(r"^-|-$", "", re.sub(r"[^a-z0-9]+", "-", file.rsplit(".", 1)[0].lower())).replace("-", "_")
    return re.sub(r"^(\d)", r"t_\1", stem) or "data"


#: An uploaded table keeps its first rows; that is the feature's own limit.
UPLOAD_ROWS = 20_000


def read_csv(spark: SparkSession, path: str, limit: int = UPLOAD_ROWS) -> DataFrame:
    """A CSV with a header: names normalised, '' as null, columns of whole numbers BIGINT, of numbers DOUBLE."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return typed(raw.toDF(*[column_name(c, i) for i, c in enumerate(raw.columns)]).limit(limit), os.path.basename(path))


def csv_table(spark: SparkSession, name: str, data: bytes, limit: int = UPLOAD_ROWS) -> DataFrame:
    """The same of an upload's bytes, which are few and on the driver. Short lines are filled with nulls, long ones cut."""
    import csv
    import io

    lines = list(csv.reader(io.StringIO(extract_text(name, data))))
    if len(lines) < 2 or not any(x.strip() for x in lines[0]):
        raise ValueError(f"there are no rows in {name}")
    names = [column_name(c, i) for i, c in enumerate(lines[0])]
    names = [n if n not in names[:i] else f"{n}_{i}" for i, n in enumerate(names)]
    rows = [tuple((*x, *[None] * len(names))[: len(names)]) for x in lines[1 : limit + 1] if x]
    return typed(spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names)), name)


def typed(raw: DataFrame, name: str) -> DataFrame:
    """Text columns as what all of their cells are: whole numbers BIGINT, numbers DOUBLE, else STRING; '' is null."""
    raw = raw.select(*[F.when(F.trim(f"`{c}`") != "", F.trim(f"`{c}`")).alias(c) for c in raw.columns])
    checks = []
    for i, c in enumerate(raw.columns):
        x = F.col(f"`{c}`")
        checks += [F.coalesce(F.bool_and(x.rlike(r"^-?\d+$")), F.lit(True)).alias(f"i{i}"), F.coalesce(F.bool_and(x.rlike(r"^-?\d+(\.\d+)?$")), F.lit(True)).alias(f"r{i}")]
    kinds = raw.agg(F.count(F.lit(1)).alias("n"), *checks).first()
    if not kinds["n"]:
        raise ValueError(f"there are no rows in {name}")
    kind = lambda i: "bigint" if kinds[f"i{i}"] else "double" if kinds[f"r{i}"] else "string"
    return raw.select(*[F.col(f"`{c}`").cast(kind(i)).alias(c) for i, c in enumerate(raw.columns)])


def extract_text(name: str, data: bytes) -> str:
    """An upload's text: PDF by its pages where a PDF library is there, else UTF-8, else Latin-1."""
    if name.lower().endswith(".pdf"):
        try:
            from pypdf import PdfReader
        except ImportError as e:
            raise ValueError("reading PDF files needs pypdf") from e
        import io

        text = "\n\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages)
        if not text.strip():
            raise ValueError(f"no text could be read from {name}; pages that are images only can't be read")
        return text
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of text files by the binaryFile source; bytes that aren't UTF-8 are read as Latin-1."""
    files = spark.read.format("binaryFile").load(path)
    utf8 = F.try_validate_utf8(F.col("content").cast("string"))
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.coalesce(utf8, F.decode("content", F.lit("ISO-8859-1"))).alias("text"))


GOLDEN = (
    "id string, type string, text string, ask_as_group string, expected_verdict string, expected_answer string, expected_value double, "
    "key_facts array<string>, secret_facts array<string>, supporting_refs array<struct<kind:string,ref:string,table:string>>, hypothesis string"
)


def read_golden(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """The question set, and the first 12 digits of its file's SHA-256 as its version.

    A key fact is a string or a list of alternatives; both become array<string> of alternatives.
    """
    raw = spark.read.schema(GOLDEN).option("multiLine", True).json(path)
    listed = F.transform(
        F.coalesce("key_facts", F.array().cast("array<string>")),
        lambda f: F.when(F.startswith(f, F.lit("[")), F.from_json(f, "array<string>")).otherwise(F.array(f)),
    )
    refs = lambda kind: F.filter("supporting_refs", lambda r: r["kind"] == kind)
    questions = raw.select(
        F.col("id").alias("qid"),
        "type",
        "text",
        F.array("ask_as_group").alias("groups"),
        "expected_verdict",
        "expected_answer",
        "expected_value",
        listed.alias("key_facts"),
        F.coalesce("secret_facts", F.array().cast("array<string>")).alias("secret_facts"),
        F.transform(refs("section"), lambda r: r["ref"]).alias("section_refs"),
        F.transform(refs("rows"), lambda r: F.concat(F.lit("table:"), r["table"])).alias("table_refs"),
        F.coalesce("hypothesis", F.lit("")).alias("hypothesis"),
    )
    content = spark.read.format("binaryFile").load(path).select(F.substring(F.sha2("content", 256), 1, 12)).first()[0]
    return questions, content


def access_lists(spark: SparkSession, folder: str) -> DataFrame:
    """(document_id, groups) from the source files, not from any store."""
    return read_documents(spark, folder).select("document_id", "groups")


def gazetteer(tables: dict[str, DataFrame]) -> DataFrame | None:
    """(name, entity): products by id and sites as site:<id>, names in lower case."""
    parts = []
    if "product" in tables:
        parts.append(tables["product"].select(F.lower("name").alias("name"), F.col("id").alias("entity")))
    if "site" in tables:
        parts.append(tables["site"].select(F.lower("name").alias("name"), F.concat(F.lit("site:"), "id").alias("entity")))
    return None if not parts else parts[0] if len(parts) == 1 else parts[0].union(parts[1])

