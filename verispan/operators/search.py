"""Access filters, exact vector search, BM25, rank fusion and hybrid retrieval for a table of questions.

questions: (qid, text, groups array<string>, embedding). chunks: the columns of the ingest
step and an embedding. All questions are answered in one plan. Questions are a stated set,
broadcast behind a check of their number; chunks are never gathered: per-question ranking
goes through row_number() <= k, which Spark prunes inside each task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verispan.functions.text import content_tokens
from verispan.operators.ingest import embedding_text
from verispan.session import settled

K1, B = 1.5, 0.75
RRF_K = 60
CANDIDATES, TOP = 30, 8
#: Questions up to this many are broadcast, and so many at a time meet the chunks' vectors as one matrix.
MOST_QUESTIONS, BLOCK = 10_000, 1024
#: Record ids up to this many are broadcast.
MOST_IDS = 200_000
#: Questions whose terms meet the chunks' tokens at a time.
WORD_BLOCK = 256


# --- filters ---------------------------------------------------------------------------


def visible(groups: Column | str, principal: Column | Sequence[str]) -> Column:
    """Row-level access: the chunk's groups and the asker's have one in common."""
    asker = principal if isinstance(principal, Column) else F.array(*map(F.lit, principal)).cast("array<string>")
    return F.coalesce(F.arrays_overlap(groups, asker), F.lit(False))


def eligible(current_only: bool = False, table_rows: bool = False) -> Column:
    ok = F.lit(True)
    if current_only:
        ok = ok & (F.col("status") == "current")
    if not table_rows:
        ok = ok & ~F.col("is_table_row")
    return ok


def by_ref(chunks: DataFrame, refs: Sequence[str] | DataFrame, principal: Sequence[str]) -> DataFrame:
    """Chunks of some refs that the asker may see, without table rows."""
    found = chunks.filter(eligible() & visible("groups", principal))
    if isinstance(refs, DataFrame):
        return found.join(refs.select("ref").distinct(), "ref", "left_semi")
    return found.filter(F.col("ref").isin(*refs)) if refs else found.limit(0)


def document(chunks: DataFrame, document_id: str | DataFrame, principal: Sequence[str]) -> DataFrame:
    """A document's visible chunks by id, superseded ones too; or those of a table of documents."""
    found = chunks.filter(eligible() & visible("groups", principal))
    if isinstance(document_id, DataFrame):
        return found.join(document_id.select("document_id").distinct(), "document_id", "left_semi")
    return found.filter(F.col("document_id") == document_id).orderBy("chunk_id")


def all_visible(chunks: DataFrame, principal: Sequence[str]) -> DataFrame:
    return chunks.filter(visible("groups", principal))


def identifiers_match(idents: Column, wanted: Column) -> Column:
    return F.arrays_overlap(idents, wanted)


def by_identifiers(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, chunk_id) of visible chunks that share a record id with the question: an index lookup by id, not a scan per question.

    Pairs may be as many as questions times chunks, so they are made last and never moved or
    compared: an id's chunks and questions meet as packed lists, and a pair that shares several
    ids is told under the first of them only.
    """
    from verispan.functions.text import record_ids

    def packed(df: DataFrame, text: Column, ident: str, parts: int, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        ids = df.select(ident, "groups", F.sort_array(F.array_distinct(record_ids(text))).alias("_ids"))
        each = ids.select(ident, "groups", "_ids", F.posexplode_outer("_ids").alias("_at", "_id")).filter("_id IS NOT NULL")
        each = each if wanted is None else each.join(wanted, "_id", "left_semi")
        each = each.withColumn("before", F.slice("_ids", F.lit(1), F.col("_at")))
        part = F.pmod(F.xxhash64(F.col(ident).cast("string")), F.lit(parts))
        return each, each.groupBy("_id", "groups", "before", part).agg(F.collect_list(ident).alias(f"{ident}s")).select("_id", "groups", "before", f"{ident}s")

    spark = chunks.sparkSession
    each, asked = packed(questions, F.col("text"), "qid", 4)
    asked = asked.withColumnsRenamed({"groups": "_asker", "before": "_before"})
    held = packed(chunks.filter(eligible()), embedding_text(), "chunk_id", 64, small(each.select("_id").distinct(), MOST_IDS))[1]
    met = held.join(asked, "_id").filter(visible("groups", F.col("_asker")) & ~F.arrays_overlap("before", "_before")).select("qids", "chunk_ids")
    # A given number of parts, since Spark would bring the short lists into few.
    dealt = met.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))
    return dealt.select(F.explode("qids").alias("qid"), "chunk_ids").select("qid", F.explode("chunk_ids").alias("chunk_id"))


# --- ranking ---------------------------------------------------------------------------


def small(questions: DataFrame, most: int = MOST_QUESTIONS) -> DataFrame:
    """Questions (or seeds, terms) for a join on a key: broadcast behind a check of their number; more of them are joined by a shuffle."""
    n = questions.limit(most + 1).count()
    return F.broadcast(questions) if n <= most else questions


def best(scored: DataFrame, k: int, by: str = "score", places: int | None = 5, per: str = "qid", ident: str = "chunk_id") -> DataFrame:
    """The k best rows per question: rounded score first, then id, so float noise can't reorder."""
    value = F.round(by, places) if places is not None else F.col(by)
    order = Window.partitionBy(per).orderBy(value.desc(), F.col(ident))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


@dataclass
class Found:
    """hits: (qid, chunk_id, score, source, rank); removed: (qid, removed), a row for every question."""

    hits: DataFrame
    removed: DataFrame


def vector_search(
    chunks: DataFrame, questions: DataFrame, k: int = CANDIDATES, mode: str = "pre", current_only: bool = False, table_rows: bool = False, cut_places: int | None = 5
) -> Found:
    """Exact top k by dot product. mode pre: hidden chunks never rank. mode post: rank, cut, then drop and count them.

    cut_places: the places to which scores are rounded for the cut at k; None cuts by the plain score. What is kept is ranked by 5 places.
    """
    rows = chunks.filter(eligible(current_only, table_rows)).select("chunk_id", "groups", "embedding")
    scored = candidates_of(rows, questions, k, mode == "pre")
    top = best(scored, k) if cut_places == 5 else best(best(scored, k, places=cut_places), k)
    if mode == "pre":
        hits, removed = top, questions.select("qid", F.lit(0).cast("long").alias("removed"))
    else:
        gone = top.groupBy("qid").agg(F.count_if(~F.col("_seen")).alias("removed"))
        removed = questions.select("qid").join(gone, "qid", "left").withColumn("removed", F.coalesce("removed", F.lit(0)).cast("long"))
        hits = best(top.filter("_seen"), k)
    return Found(hits.select("qid", "chunk_id", "score", F.lit("vector").alias("source"), "rank"), removed)


def _task_best(chunks: DataFrame, content: str, questions: DataFrame, k: int, masked: bool, scorer: Callable, block_size: int) -> DataFrame:
    """(qid, chunk_id, score, _seen): of each task, the chunks among which its k best of every question are.

    Questions (qid, groups and what the scorer wants) come in blocks of at most about
    block_size, each broadcast; scorer(rows of a block) gives a function from a batch of the
    content column to scores (chunks, questions), -inf for none, which is shipped with it.
    Rows within 2e-5 of a task's k-th best stay, so a later cut by rounded scores loses
    nothing. masked: hidden chunks don't count.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.types import BooleanType, DoubleType, StructType

    from verispan.session import ship

    spark = chunks.sparkSession
    ship(spark)
    blocks = max(1, -(-questions.count() // block_size))
    block = F.pmod(F.xxhash64(F.col("qid").cast("string")), F.lit(blocks))
    schema = StructType([questions.schema["qid"], chunks.schema["chunk_id"]]).add("score", DoubleType()).add("_seen", BooleanType())

    def run_for(held):  # noqa: ANN001, ANN202
        def run(batches):  # noqa: ANN001, ANN202
            qids, groups, scores_of, step = held.value
            may: dict[tuple, np.ndarray] = {}
            kept: list[tuple] = []  # per step: question places, chunk ids, scores, seen

            def cut(parts: list[tuple]) -> list[tuple]:
                q, c, s, v = (np.concatenate([p[0] for p in parts]), pa.concat_arrays([p[1] for p in parts]), *(np.concatenate([p[i] for p in parts]) for i in (2, 3)))
                order = np.lexsort((-s, q))
                first = np.searchsorted(q[order], np.arange(len(qids)))
                sizes = np.diff(np.append(first, len(q)))
                least = np.where(sizes > k, s[order][np.minimum(first + k - 1, max(len(q) - 1, 0))] - 2e-5, -np.inf) if len(q) else np.zeros(len(qids))
                some = np.flatnonzero(s >= least[q])
                return [(q[some], c.take(pa.array(some)), s[some], v[some])]

            for b in batches:
                for at in range(0, b.num_rows, step):
                    part = b.slice(at, step)
                    scores = scores_of(part.column(2))
                    rows = [tuple(g or ()) for g in part.column(1).to_pylist()]
                    for g in set(rows) - may.keys():
                        may[g] = np.array([not x.isdisjoint(g) for x in groups], bool)
                    seen = np.array([may[g] for g in rows], bool).reshape(part.num_rows, -1)
                    if masked:
                        scores = np.where(seen, scores, -np.inf)
                    if part.num_rows > k:  # the k best of the step and what is as good as them
                        scores = np.where(scores >= np.partition(scores, -k, axis=0)[-k] - 2e-5, scores, -np.inf)
                    i, q = np.nonzero(scores > -np.inf)
                    kept.append((q, part.column(0).take(pa.array(i)), scores[i, q], seen[i, q]))
                    if sum(len(x[0]) for x in kept) > 4 * k * len(qids) + 100_000:
                        kept = cut(kept)
            if kept:
                q, c, s, v = cut(kept)[0]
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(q)), c, pa.array(s), pa.array(v)], schema.names)

        return run

    out = None
    for b in range(blocks):
        rows = questions.filter(block == b).toArrow()  # at most about block_size questions
        if not rows.num_rows:
            continue
        scores_of, step = scorer(rows)
        held = spark.sparkContext.broadcast((rows.column("qid").combine_chunks(), [frozenset(g or ()) for g in rows.column("groups").to_pylist()], scores_of, step))
        found = chunks.select("chunk_id", "groups", content).mapInArrow(run_for(held), schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


class _Dots:
    """Scores by dot product: a batch of chunks is one matrix product."""

    def __init__(self, vectors) -> None:  # noqa: ANN001
        self.matrix = vectors.T

    def __call__(self, embeddings):  # noqa: ANN001, ANN204
        import numpy as np

        return np.array(embeddings.to_pylist(), np.float64).reshape(len(embeddings), -1) @ self.matrix


class _Weights:
    """BM25 scores: a batch's term weights times the questions' terms."""

    def __init__(self, terms, idf, asked, avg_len: float) -> None:  # noqa: ANN001
        self.terms, self.idf, self.asked, self.avg_len = terms, idf, asked, avg_len

    def __call__(self, toks):  # noqa: ANN001, ANN204
        import numpy as np
        import pyarrow.compute as pc

        n, width = len(toks), len(self.terms)
        size = pc.list_value_length(toks).fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
        term = pc.index_in(toks.flatten(), self.terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(n), size.astype(np.int64))
        at, tf = np.unique((row * width + term)[term >= 0], return_counts=True)
        row, term = at // max(width, 1), at % max(width, 1)
        weights = np.zeros((n, width))
        weights[row, term] = self.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[row] / self.avg_len))
        scores = weights @ self.asked
        return np.where(scores > 0, scores, -np.inf)


def candidates_of(chunks: DataFrame, questions: DataFrame, k: int, masked: bool) -> DataFrame:
    """The tasks' best chunks of each question by dot product."""
    import numpy as np

    asked = questions.select("qid", "groups", F.col("embedding").cast("array<double>").alias("e"))

    def scorer(rows):  # noqa: ANN001, ANN202
        return _Dots(np.array(rows.column("e").to_pylist(), np.float64).reshape(rows.num_rows, -1)), 1024

    return _task_best(chunks, "embedding", asked, k, masked, scorer, BLOCK)


def keyword_candidates(rows: DataFrame, chunks: DataFrame, questions: DataFrame, k: int, masked: bool) -> DataFrame:
    """The tasks' best chunks of each question by BM25, among rows; statistics are over all chunks.

    Of the statistics only those of the questions' own terms come to the driver.
    """
    import numpy as np
    import pyarrow as pa

    asked = questions.select("qid", "groups", F.array_distinct(content_tokens(F.col("text"))).alias("terms"))
    toks = tokens_of(chunks)
    total = toks.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(F.size("toks")).alias("avg_len")).first()
    seen = toks.select(F.explode(F.array_distinct("toks")).alias("term"))
    terms = asked.select("qid", F.explode("terms").alias("term"))
    df = settled(seen.join(small(terms.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df")), "term-counts")

    def scorer(block):  # noqa: ANN001, ANN202
        lists = block.column("terms").to_pylist()
        wanted = chunks.sparkSession.createDataFrame([(t,) for t in sorted({t for ts in lists for t in ts})], "term string")
        found = df.join(F.broadcast(wanted), "term").toArrow()  # the terms of a block's questions
        known = found.column("term").to_pylist()
        place = {t: i for i, t in enumerate(known)}
        counts = np.array(found.column("df").to_pylist(), np.float64)
        idf = np.log((total["n"] - counts + 0.5) / (counts + 0.5) + 1)
        asks = np.zeros((len(known), len(lists)))
        for q, ts in enumerate(lists):
            asks[[place[t] for t in ts if t in place], q] = 1
        return _Weights(pa.array(known, pa.string()), idf, asks, total["avg_len"] or 1.0), max(16, (1 << 22) // max(1, len(known)))

    held = rows.select("chunk_id", "groups", "toks") if "toks" in rows.columns else rows.withColumn("toks", content_tokens(embedding_text())).select("chunk_id", "groups", "toks")
    return _task_best(held, "toks", asked, k, masked, scorer, WORD_BLOCK)


@dataclass
class TextIndex:
    """Term statistics over all chunks, restricted and superseded ones included."""

    postings: DataFrame  # chunk_id, term, tf
    terms: DataFrame  # term, df, idf
    lengths: DataFrame  # chunk_id, len
    totals: DataFrame  # one row: n, avg_len


def tokens_of(chunks: DataFrame) -> DataFrame:
    """(chunk_id, toks): the tokens that an ingest has stored, else those of the text."""
    return chunks.select("chunk_id", F.col("toks") if "toks" in chunks.columns else content_tokens(embedding_text()).alias("toks"))


def text_index(chunks: DataFrame) -> TextIndex:
    toks = tokens_of(chunks)
    lengths = toks.select("chunk_id", F.size("toks").cast("long").alias("len"))
    totals = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))
    postings = toks.select("chunk_id", F.explode("toks").alias("term")).groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    # Counted from each chunk's distinct terms, not from the postings, so that only terms with counts are moved.
    df = toks.select(F.explode(F.array_distinct("toks")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    terms = df.join(F.broadcast(totals.select("n"))).withColumn("idf", F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)).drop("n")
    return TextIndex(postings, terms, lengths, totals)


def bm25(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, chunk_id, score) of every chunk with a question's term.

    Only the questions' own terms are counted and joined: the chunks' tokens are cut to
    those before anything is shuffled, and lengths come from the same pass.
    """
    q = questions.select("qid", F.explode(F.array_distinct(content_tokens(F.col("text")))).alias("term"))
    toks = tokens_of(chunks)
    totals = toks.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(F.size("toks")).alias("avg_len"))
    tf = (
        toks.select("chunk_id", F.size("toks").alias("len"), F.explode("toks").alias("term"))
        .join(small(q.select("term").distinct()), "term", "left_semi")
        .groupBy("chunk_id", "len", "term")
        .agg(F.count(F.lit(1)).cast("double").alias("tf"))
    )
    df = tf.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    idf = df.join(F.broadcast(totals)).select("term", "avg_len", F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    # Terms with their idf are as many as the questions have.
    return tf.join(small(q).join(idf, "term"), "term").groupBy("qid", "chunk_id").agg(F.sum(part).alias("score"))


def keyword_search(
    chunks: DataFrame, questions: DataFrame, k: int = CANDIDATES, current_only: bool = False, table_rows: bool = False, ident_boost: float = 0.0
) -> DataFrame:
    """BM25 top k among chunks that the asker may see; statistics are over all chunks.

    ident_boost adds that much for each record id that question and chunk have in common.
    """
    from verispan.functions.text import record_ids

    rows = chunks.filter(eligible(current_only, table_rows))
    if not ident_boost:
        found = best(keyword_candidates(rows, chunks, questions, k, True), k)
        return found.select("qid", "chunk_id", "score", F.lit("keyword").alias("source"), "rank")
    held = rows.select("chunk_id", "groups", F.array_distinct(record_ids(embedding_text())).alias("_ids"))
    q = small(questions.select("qid", F.col("groups").alias("_asker"), F.array_distinct(record_ids(F.col("text"))).alias("_want")))
    scored = bm25(chunks, questions).filter("score > 0").join(held, "chunk_id").join(q, "qid").filter(visible("groups", F.col("_asker")))
    scored = scored.withColumn("score", F.col("score") + ident_boost * F.size(F.array_intersect("_ids", "_want")))
    return best(scored, k).select("qid", "chunk_id", "score", F.lit("keyword").alias("source"), "rank")


def rrf(lists: Sequence[DataFrame], weights: Sequence[float] | None = None, k: int = RRF_K, limit: int | None = None) -> DataFrame:
    """Reciprocal rank fusion: the sum of weight / (k + rank); no limit, or 0, keeps all."""
    weights = weights or [1.0] * len(lists)
    parts = [x.select("qid", "chunk_id", (F.lit(float(w)) / (F.col("rank") + k)).alias("s")) for x, w in zip(lists, weights, strict=True)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    fused = union.groupBy("qid", "chunk_id").agg(F.sum("s").alias("score"))
    order = Window.partitionBy("qid").orderBy(F.round("score", 12).desc(), F.col("chunk_id"))
    out = fused.withColumn("rank", F.row_number().over(order)).select("qid", "chunk_id", "score", F.lit("fused").alias("source"), "rank")
    return out.filter(F.col("rank") <= limit) if limit else out


def hybrid(chunks: DataFrame, questions: DataFrame, k: int = TOP, candidates: int = CANDIDATES, table_rows: bool = False, reranker=None) -> DataFrame:  # noqa: ANN001
    """Vector and keyword candidates, both filtered before ranking and current only, fused; an optional reranker over them."""
    v = vector_search(chunks, questions, candidates, "pre", True, table_rows).hits
    w = keyword_search(chunks, questions, candidates, True, table_rows)
    fused = rrf([v, w], limit=candidates if reranker else k)
    return reranked(fused, reranker, k) if reranker else fused


def reranked(hits: DataFrame, reranker, k: int = TOP) -> DataFrame:  # noqa: ANN001
    """The k best of some hits by a reranker's scores."""
    return best(reranker(hits), k).withColumn("source", F.lit("rerank"))


def evidence_rank(rows: DataFrame, k: int = 12) -> DataFrame:
    """rows (qid, question, chunk_id, context, text, seen): the k that hold most of the question's terms, then as first seen."""
    common = F.size(F.array_intersect(F.array_distinct(content_tokens(F.col("question"))), content_tokens(embedding_text())))
    order = Window.partitionBy("qid").orderBy(F.desc("_common"), F.col("seen"))
    ranked = rows.withColumn("_common", common).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.withColumn("score", F.col("_common").cast("double"))


def access_profile(chunks: DataFrame, questions: DataFrame, k: int = TOP) -> DataFrame:
    """(qid, rank, visible): whether the asker may see each of the k best chunks when access plays no part.

    Booleans only leave this function. Superseded chunks count, table rows don't.
    """
    rows = chunks.filter(eligible())
    v = best(candidates_of(rows, questions, 3 * k, False), 3 * k)
    w = best(keyword_candidates(rows, chunks, questions, 3 * k, False), 3 * k)
    top = rrf([v, w], limit=k)
    asker = small(questions.select("qid", F.col("groups").alias("_asker")))
    return top.join(rows.select("chunk_id", "groups"), "chunk_id").join(asker, "qid").select("qid", "rank", visible("groups", F.col("_asker")).alias("visible"))


def empty_verdict(profile: DataFrame, questions: DataFrame, reveal: bool = True) -> DataFrame:
    """(qid, verdict) where there is no evidence: denied if the best hit, or two of the best three, are hidden."""
    hidden = profile.groupBy("qid").agg(
        F.bool_or((F.col("rank") == 1) & ~F.col("visible")).alias("first"), F.count_if((F.col("rank") <= 3) & ~F.col("visible")).alias("three")
    )
    denied = F.coalesce(F.col("first") | (F.col("three") >= 2), F.lit(False)) & F.lit(reveal)
    return questions.select("qid").join(hidden, "qid", "left").select(
        "qid", F.when(denied, "access_denied").otherwise("insufficient_evidence").alias("verdict")
    )
