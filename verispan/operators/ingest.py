"""From documents and uploads to chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verispan.functions.text import WHITE, bind, markdown_rows, slug, strip

CHUNK_COLUMNS = (
    "chunk_id", "document_id", "ref", "text", "groups", "title", "section", "doc_type", "status",
    "is_table_row", "page_no", "context", "metadata",
)


def embedding_text(context: Column | str = "context", text: Column | str = "text") -> Column:
    c, t = (F.col(x) if isinstance(x, str) else x for x in (context, text))
    return F.when(F.coalesce(c, F.lit("")) == "", t).otherwise(F.concat_ws("\n", c, t))


def analysed(chunks: DataFrame, text: Column, dim: int) -> DataFrame:
    """chunks with `toks`, the content tokens of text, and `embedding`, its hashed features: content_tokens and hash_embedding in bulk."""
    from pyspark.sql.types import ArrayType, DoubleType, StringType, StructType

    from verispan.functions import bulk
    from verispan.session import ship

    ship(chunks.sparkSession)
    schema = StructType(chunks.schema.fields).add("toks", ArrayType(StringType())).add("embedding", ArrayType(DoubleType()))
    return chunks.withColumn("_low", F.lower(text)).mapInArrow(lambda batches: bulk.analysed(batches, dim), schema)


def _with_rows(chunks: DataFrame, table_rows: bool) -> DataFrame:
    """Chunks and, under the same ref, one more for each row of a Markdown table in them."""
    if not table_rows:
        return chunks.select(*CHUNK_COLUMNS)
    # A chunk and its rows come from one explode, so that what made the chunk runs once; an outer one, as others test for empty arrays by making them again.
    whole = F.array(F.struct(F.lit(0).alias("n"), F.lit(None).cast("string").alias("text")))
    rows = F.coalesce(markdown_rows(F.col("text")), F.array().cast("array<struct<n:int,text:string>>"))
    each = chunks.select(*CHUNK_COLUMNS, F.explode_outer(F.concat(whole, rows)).alias("_row"))
    is_row = F.col("_row.n") > 0
    changed = {
        "chunk_id": F.concat("ref", F.lit("@row"), F.col("_row.n").cast("string")),
        "text": F.col("_row.text"),
        "is_table_row": F.lit(True),
        "metadata": F.create_map(F.lit("row"), F.col("_row.text")),
    }
    return each.select(*[F.when(is_row, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in CHUNK_COLUMNS])


def chunk_documents(documents: DataFrame, enrich: bool = True, table_rows: bool = True) -> DataFrame:
    """One chunk per section, with its title and heading as context."""
    s = documents.withColumn("s", F.explode("sections"))
    ref = F.concat("document_id", F.lit("#"), slug(F.col("s.heading")))
    context = F.concat("title", F.lit(". Section: "), F.col("s.heading"), F.lit(".")) if enrich else F.lit("")
    chunks = s.select(
        ref.alias("chunk_id"),
        "document_id",
        ref.alias("ref"),
        F.col("s.body").alias("text"),
        "groups",
        "title",
        F.col("s.heading").alias("section"),
        "doc_type",
        "status",
        F.lit(False).alias("is_table_row"),
        F.lit(None).cast("int").alias("page_no"),
        context.alias("context"),
        F.create_map().cast("map<string,string>").alias("metadata"),
    )
    return _with_rows(chunks, table_rows)


def windows(text: Column, size: int = 1200) -> Column:
    """Passages of about `size` characters: paragraphs packed in order, over-long ones cut after a sentence.

    A fold over the paragraphs, and inside it one over a long paragraph's cuts.
    """
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), strip), lambda p: p != "")
    start = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

    def cut_at(para: Column) -> Column:
        head = F.left(para, F.lit(size))
        # The last ". " that lies wholly before size.
        at = F.length(head) - F.locate(" .", F.reverse(head))
        return F.when(F.contains(head, F.lit(". ")), at).otherwise(F.lit(size))

    def step(acc: Column, para: Column) -> Column:
        # Two cuts one after the other take a window or more: the first takes the last ". " in it. So this many are enough; more do nothing.
        first = F.struct(acc["cur"].alias("cur"), acc["out"].alias("out"), para.alias("para"))

        def cut(a: Column, _: Column) -> Column:
            n = F.greatest(cut_at(a["para"]), F.lit(1))
            piece = F.left(a["para"], n)
            packed = F.when(a["cur"] == "", strip(piece)).otherwise(strip(F.concat(a["cur"], F.lit("\n\n"), piece)))
            done = F.struct(
                F.lit("").alias("cur"),
                F.concat(a["out"], F.array(packed)).alias("out"),
                F.ltrim(F.substr(a["para"], n + 1), F.lit(WHITE)).alias("para"),
            )
            return F.when(F.length(a["para"]) > size * 1.5, done).otherwise(a)

        most = F.sequence(F.lit(0), 2 * F.floor(F.length(para) / size).cast("int") + 1)
        reduced = F.when(F.length(para) > size * 1.5, F.aggregate(most, first, cut)).otherwise(first)

        def pack(a: Column) -> Column:
            full = (a["cur"] != "") & (F.length(a["cur"]) + F.length(a["para"]) > size)
            joined = F.when(a["cur"] == "", a["para"]).otherwise(F.concat(a["cur"], F.lit("\n\n"), a["para"]))
            return F.struct(
                F.when(full, a["para"]).otherwise(joined).alias("cur"),
                F.when(full, F.concat(a["out"], F.array(a["cur"]))).otherwise(a["out"]).alias("out"),
            )

        return bind(reduced, pack)

    return F.aggregate(paragraphs, start, step, lambda a: F.when(a["cur"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(a["cur"]))))


def chunk_uploads(files: DataFrame, size: int = 1200, groups: tuple[str, ...] = ("owner",), table_rows: bool = True) -> DataFrame:
    """Chunks of headerless files (name, text): headings part sections, windows part sections, n counts over the file."""
    stem = F.when(F.contains("name", F.lit(".")), F.regexp_replace("name", r"\.[^.]*$", "")).otherwise(F.col("name"))
    doc = F.when(slug(stem) == "", F.lit("document")).otherwise(slug(stem))
    lines = files.select("name", doc.alias("document_id"), F.posexplode(F.split(F.regexp_replace("text", "\r\n", "\n"), "\n")).alias("i", "line"))
    heading = F.col("line").rlike(r"^#{1,6}\s+(.*)$")
    by_line = Window.partitionBy("name").orderBy("i")
    lines = lines.withColumn("s", F.sum(heading.cast("int")).over(by_line))
    body = F.sort_array(F.collect_list(F.when(~heading, F.struct("i", "line"))))
    sections = lines.groupBy("name", "document_id", "s").agg(
        F.coalesce(F.max(F.when(heading, strip(F.regexp_extract("line", r"^#{1,6}\s+(.*)$", 1)))), F.lit("")).alias("heading"),
        F.array_join(F.transform(body, lambda x: x["line"]), "\n").alias("body"),
    )
    parts = sections.select("name", "document_id", "s", "heading", F.posexplode_outer(windows(F.col("body"), size)).alias("w", "text")).filter("w IS NOT NULL")
    parts = parts.withColumn("n", F.row_number().over(Window.partitionBy("name").orderBy("s", "w")))
    titled = F.col("heading") != ""
    n = F.col("n").cast("string")
    section = F.when(titled, F.col("heading")).otherwise(F.concat(F.lit("Part "), n))
    ref = F.concat("document_id", F.lit("#"), F.when(titled, F.concat(slug(F.col("heading")), F.lit("-"))).otherwise(F.lit("")), n)
    chunks = parts.select(
        ref.alias("chunk_id"),
        "document_id",
        ref.alias("ref"),
        "text",
        F.array(*map(F.lit, groups)).alias("groups"),
        F.col("name").alias("title"),
        section.alias("section"),
        F.lit("upload").alias("doc_type"),
        F.lit("current").alias("status"),
        F.lit(False).alias("is_table_row"),
        F.lit(None).cast("int").alias("page_no"),
        F.when(titled, F.concat("name", F.lit(". Section: "), section, F.lit("."))).otherwise(F.concat("name", F.lit("."))).alias("context"),
        F.create_map().cast("map<string,string>").alias("metadata"),
    )
    return _with_rows(chunks, table_rows)
