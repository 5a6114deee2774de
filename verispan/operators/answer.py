"""Answers from evidence: extractive drafts, claim-by-claim verification, and the verdict tail, for all questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verispan.functions.text import bind, cited_numbers, claims, content_tokens, numbers, record_ids, strip, table_units
from verispan.models import ANSWERED, MESSAGES, UNVERIFIED
from verispan.session import settled
from verispan.operators.search import access_profile, empty_verdict, small, tokens_of

MIN_COVERAGE, NEAR_BEST, MAX_SENTENCES, MIN_SENTENCE = 0.4, 0.9, 2, 12
MIN_OVERLAP = 0.6


def term_weights(chunks: DataFrame, terms: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(term, idf) over distinct terms of chunks, or of those of `terms` only, and one row with the weight of an unseen term."""
    toks = tokens_of(chunks).select(F.explode(F.array_distinct("toks")).alias("term"))
    toks = toks if terms is None else toks.join(small(terms.select("term").distinct()), "term", "left_semi")
    n = chunks.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).cast("double").alias("n"))
    df = toks.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    idf = df.join(F.broadcast(n)).select("term", F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))
    return idf, n.select(F.ln(F.col("n") + 1).alias("unseen"))


def question_terms(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, terms array<struct(term, w)>, total): a question's distinct terms with their weights."""
    q = questions.select("qid", F.explode(F.array_distinct(content_tokens(F.col("text")))).alias("term"))
    idf, unseen = term_weights(chunks, q)
    w = q.join(idf, "term", "left").join(F.broadcast(unseen)).withColumn("w", F.coalesce("idf", "unseen"))
    return w.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("terms"), F.sum("w").alias("total"))


def extract(questions: DataFrame, hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, draft, insufficient): the sentences of the evidence that best cover each question's rarer terms."""
    terms = question_terms(questions, chunks)
    held = hits.select("qid", "chunk_id", F.col("rank").alias("n")).join(chunks.select("chunk_id", "context", "text"), "chunk_id")
    units = held.select("qid", "n", content_tokens(F.coalesce("context", F.lit(""))).alias("ctx"), F.posexplode(table_units(F.col("text"))).alias("i", "sent"))
    units = units.filter(F.length("sent") >= MIN_SENTENCE).withColumn("own", content_tokens(F.col("sent"))).join(terms, "qid").filter("total > 0")
    cover = lambda of: F.aggregate(F.filter("terms", lambda t: of(t["term"])), F.lit(0.0), lambda a, t: a + t["w"]) / F.col("total")
    in_own = lambda t: F.array_contains("own", t)
    scored = units.withColumn("own_cov", cover(in_own)).withColumn("cov", cover(lambda t: in_own(t) | F.array_contains("ctx", t))).filter("own_cov > 0")
    order = Window.partitionBy("qid").orderBy(F.round("cov", 9).desc(), F.round("own_cov", 9).desc(), "n", "i")
    ranked = scored.withColumn("r", F.row_number().over(order)).withColumn("best", F.max("cov").over(Window.partitionBy("qid")))
    near = F.greatest(F.lit(MIN_COVERAGE), F.col("best") * NEAR_BEST) - 1e-9
    picked = ranked.filter((F.col("best") >= MIN_COVERAGE) & ((F.col("r") == 1) | (F.col("cov") >= near)))
    picked = picked.withColumn("k", F.row_number().over(Window.partitionBy("qid").orderBy("r"))).filter(F.col("k") <= MAX_SENTENCES)
    line = F.concat(F.regexp_replace(strip(F.regexp_replace("sent", r"^[-0-9. ]+", "")), r"\.+$", ""), F.lit(". ["), F.col("n").cast("string"), F.lit("]"))
    drafts = picked.groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", line.alias("s")))), lambda x: x["s"]), " ").alias("draft"))
    return questions.select("qid").join(drafts, "qid", "left").select("qid", F.coalesce("draft", F.lit("")).alias("draft"), F.col("draft").isNull().alias("insufficient"))


def verify(answers: DataFrame, hits: DataFrame, chunks: DataFrame, text: str = "draft") -> DataFrame:
    """(qid, claims, unsupported, supported, support): each claim against the sources that it cites.

    A claim holds when it cites a source in range, most of its content words, and all of
    its numbers and record ids are there. An answer without claims holds.
    """
    sources = hits.select("qid", "chunk_id", F.col("rank").alias("n")).join(
        chunks.select("chunk_id", F.concat_ws(" ", F.coalesce("context", F.lit("")), "text").alias("evidence")), "chunk_id"
    )
    c = answers.select("qid", F.posexplode(claims(F.coalesce(text, F.lit("")))).alias("c", "claim")).select("qid", "c", "claim.text", F.array_distinct("claim.cites").alias("cites"))
    cited = c.select("qid", "c", F.explode("cites").alias("n")).join(sources, ["qid", "n"])
    found = cited.groupBy("qid", "c").agg(F.array_join(F.collect_list("evidence"), " ").alias("evidence"))
    judged = c.join(found, ["qid", "c"], "left").withColumn("ok", F.coalesce(holds(F.col("text"), F.col("evidence")), F.lit(False)))
    per = judged.groupBy("qid").agg(
        F.count(F.lit(1)).alias("claims"),
        F.transform(F.sort_array(F.collect_list(F.when(~F.col("ok"), F.struct("c", "text")))), lambda x: x["text"]).alias("unsupported"),
    )
    n = F.coalesce("claims", F.lit(0)).cast("long")
    bad = F.coalesce("unsupported", F.array().cast("array<string>"))
    return answers.select("qid").join(per, "qid", "left").select(
        "qid", n.alias("claims"), bad.alias("unsupported"), (F.size(bad) == 0).alias("supported"), support_rate(n, F.size(bad)).alias("support")
    )


def support_rate(n_claims: Column, n_bad: Column) -> Column:
    return F.when(n_claims == 0, F.lit(1.0)).otherwise((n_claims - n_bad) / n_claims.cast("double"))


def holds(claim: Column, evidence: Column, least: float = MIN_OVERLAP) -> Column:
    """Whether one claim is supported by a text."""

    def of(toks: Column) -> Column:
        share = F.size(F.array_intersect(toks, content_tokens(evidence))) / F.size(toks).cast("double")
        return F.when(F.size(toks) == 0, F.lit(1.0)).otherwise(share)

    within = lambda xs, ys: F.size(F.array_except(xs, ys)) == 0
    overlap = bind(F.array_distinct(content_tokens(claim)), of)
    return (overlap >= least) & within(numbers(claim), numbers(evidence)) & within(record_ids(claim), record_ids(evidence))


def citations(answers: DataFrame, hits: DataFrame, chunks: DataFrame, text: str = "draft", kind: str = "chunk") -> DataFrame:
    """(qid, citations array<struct(n, kind, ref)>) in the order in which they are first seen."""
    counts = hits.groupBy("qid").agg(F.count(F.lit(1)).cast("int").alias("k"))
    marks = answers.join(counts, "qid").select("qid", F.posexplode(cited_numbers(F.col(text), F.col("k"))).alias("i", "n"))
    named = marks.join(hits.select("qid", F.col("rank").alias("n"), "chunk_id"), ["qid", "n"]).join(chunks.select("chunk_id", "ref"), "chunk_id")
    ordered = F.sort_array(F.collect_list(F.struct("i", "n", "ref")))
    return named.groupBy("qid").agg(F.transform(ordered, lambda x: F.struct(x["n"].alias("n"), F.lit(kind).alias("kind"), x["ref"].alias("ref"))).alias("citations"))


def retrieved_refs(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, retrieved_refs): distinct refs in rank order."""
    first = hits.join(chunks.select("chunk_id", "ref"), "chunk_id").groupBy("qid", "ref").agg(F.min("rank").alias("r"))
    return first.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "ref"))), lambda x: x["ref"]).alias("retrieved_refs"))


def numbered_sources(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, sources): "[1] (title / section)" blocks for a model's prompt."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] ("), "title", F.lit(" / "), "section", F.lit(")\n"), "text")
    held = hits.join(chunks.select("chunk_id", "title", "section", "text"), "chunk_id").select("qid", "rank", block.alias("b"))
    return held.groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "b"))), lambda x: x["b"]), "\n\n").alias("sources"))


def answer(questions: DataFrame, hits: DataFrame, chunks: DataFrame, drafts: DataFrame | None = None, reveal: bool = True, kind: str = "chunk", check=verify) -> DataFrame:  # noqa: ANN001
    """The common tail: draft, then verify or decide why there is nothing; an unsupported draft is withheld.

    drafts: (qid, draft, insufficient), extractive by default; a model's drafts fit in here. check: a verifier
    such as verify. Returns (qid, text, verdict, citations, retrieved_refs, verifier_changed, support, withheld);
    withheld, an unsupported draft, is for administrators.
    """
    hits = settled(hits, "hits")
    drafts = settled(extract(questions, hits, chunks) if drafts is None else drafts, "drafts")
    checked = check(drafts.filter("NOT insufficient"), hits, chunks)
    # Only questions without a draft need the profile that ignores access.
    open_ = questions.join(drafts.filter("insufficient").select("qid"), "qid", "left_semi")
    none = empty_verdict(access_profile(chunks, open_), open_, reveal).withColumnRenamed("verdict", "why")
    cites = citations(drafts.filter("NOT insufficient"), hits, chunks, kind=kind)
    rows = drafts.join(checked, "qid", "left").join(none, "qid", "left").join(cites, "qid", "left").join(retrieved_refs(hits, chunks), "qid", "left")
    verdict = F.when(F.col("insufficient"), F.col("why")).when(F.col("supported"), ANSWERED).otherwise(UNVERIFIED)
    said = F.lit(None).cast("string")
    for v, message in MESSAGES.items():
        said = F.when(F.col("verdict") == v, message).otherwise(said)
    empty = F.array().cast("array<struct<n:int,kind:string,ref:string>>")
    return rows.withColumn("verdict", verdict).select(
        "qid",
        F.when(F.col("verdict") == ANSWERED, F.col("draft")).otherwise(said).alias("text"),
        "verdict",
        F.when(F.col("verdict") == ANSWERED, F.coalesce("citations", empty)).otherwise(empty).alias("citations"),
        F.coalesce("retrieved_refs", F.array().cast("array<string>")).alias("retrieved_refs"),
        (F.col("verdict") == UNVERIFIED).alias("verifier_changed"),
        F.when(~F.col("insufficient"), F.col("support")).alias("support"),
        F.when(F.col("verdict") == UNVERIFIED, F.col("draft")).alias("withheld"),
    )
