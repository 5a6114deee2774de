"""Hash-chained traces as rows: building receipts and verifying them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "genesis"


def receipt_hash(prev: Column, event_json: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(prev, F.lit("\n"), event_json), 256))


def canonical(**fields: Column) -> Column:
    """JSON with its keys in order and no spaces."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def chain(events: DataFrame, bundle: str = "bundle_id", seq: str = "sequence", event: str = "event_json") -> DataFrame:
    """(bundle, seq, prev_hash, hash): each receipt's hash covers the one before it.

    A bundle's events stream through one task in their order; nothing of it is held but the last hash.
    """
    import hashlib

    import pyarrow as pa
    from pyspark.sql.types import StringType, StructType

    from verispan.session import ship

    ship(events.sparkSession)
    rows = events.select(bundle, seq, event)
    schema = StructType([rows.schema[bundle], rows.schema[seq]]).add("prev_hash", StringType()).add("hash", StringType())

    def run(batches):  # noqa: ANN001, ANN202
        held, prev = None, GENESIS
        for b in batches:
            before, after = [], []
            for name, said in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if (name,) != held:
                    held, prev = (name,), GENESIS
                before.append(prev)
                prev = "sha256:" + hashlib.sha256(f"{prev}\n{said}".encode()).hexdigest()
                after.append(prev)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(before), pa.array(after)], schema.names)

    return rows.repartition(bundle).sortWithinPartitions(bundle, seq).mapInArrow(run, schema)


def of_answers(questions: DataFrame, found_hits: DataFrame, answers: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """(bundle_id, sequence, event_json, admin): the public events of each answer in order, and what only administrators may read.

    asked: who asks (groups); searched: visible hits and how many were removed; answered: the
    verdict and the refs. The question's text, and a draft that was withheld, are the administrators'.
    """
    none = F.lit(None).cast("string")
    q = questions.select(F.col("qid").alias("bundle_id"), F.lit(1).alias("sequence"), canonical(groups=F.array_sort("groups"), kind=F.lit("asked")).alias("event_json"), (F.col("text") if "text" in questions.columns else none).alias("admin"))
    seen = questions.select("qid").join(visible_hits(found_hits, removed), "qid", "left")
    s = seen.select(F.col("qid").alias("bundle_id"), F.lit(2).alias("sequence"), canonical(kind=F.lit("searched"), payload=F.coalesce("payload", F.lit("{}"))).alias("event_json"), none.alias("admin"))
    a = answers.select(
        F.col("qid").alias("bundle_id"), F.lit(3).alias("sequence"), canonical(kind=F.lit("answered"), refs=F.col("retrieved_refs"), verdict=F.col("verdict")).alias("event_json"),
        (F.col("withheld") if "withheld" in answers.columns else none).alias("admin"),
    )
    return q.unionByName(s).unionByName(a)


def verify_chain(
    events: DataFrame, receipts: DataFrame, manifest: DataFrame | None = None, bundle: str = "bundle_id", seq: str = "sequence", event: str = "event_json"
) -> DataFrame:
    """(bundle, n, ok, reason): links, recomputed hashes and counts, without folding."""
    both = events.select(bundle, seq, event).join(receipts.select(bundle, seq, "prev_hash", "hash"), [bundle, seq], "full")
    order = Window.partitionBy(bundle).orderBy(seq)
    rows = both.withColumn("want", F.lag("hash", 1, GENESIS).over(order))
    linked = F.coalesce(F.col("prev_hash") == F.col("want"), F.lit(False))
    same = F.coalesce(F.col("hash") == receipt_hash(F.col("prev_hash"), F.col(event)), F.lit(False))
    per = rows.groupBy(bundle).agg(
        F.count(event).alias("n"),
        F.count("hash").alias("n_receipts"),
        F.bool_and(linked).alias("linked"),
        F.bool_and(same).alias("same"),
    )
    counted = F.col("n") == F.col("n_receipts")
    if manifest is not None:
        per = per.join(manifest.select(bundle, "event_count"), bundle, "left")
        counted = counted & (F.col("n") == F.coalesce("event_count", F.lit(-1)))
    reason = F.when(~counted, "event, receipt and manifest counts differ").when(~F.col("linked"), "chain broken").when(~F.col("same"), "a receipt does not match its event")
    return per.select(bundle, "n", (counted & F.col("linked") & F.col("same")).alias("ok"), reason.alias("reason"))


def refs_in(payload: Column) -> Column:
    """All refs named in an event's JSON, in order."""
    return F.regexp_extract_all(payload, F.lit(r'"ref":\s*"([^"]+)"'), F.lit(1))


def visible_hits(hits: DataFrame, removed: DataFrame | None = None, limit: int = 20) -> DataFrame:
    """(qid, payload): refs and rounded scores of visible hits for the public trace, and how many were removed."""
    item = F.struct(F.col("rank"), F.struct(F.col("chunk_id").alias("ref"), F.round("score", 4).alias("score"), "source").alias("hit"))
    per = hits.filter(F.col("rank") <= limit).groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["hit"]).alias("hits"))
    if removed is None:
        return per.select("qid", F.to_json(F.struct("hits")).alias("payload"))
    per = removed.join(per, "qid", "left")
    n = F.when(F.col("removed") > 0, F.col("removed"))
    note = F.when(F.col("removed") > 0, F.concat(F.col("removed").cast("string"), F.when(F.col("removed") == 1, " inaccessible candidate was").otherwise(" inaccessible candidates were"), F.lit(" removed after ranking.")))
    return per.select("qid", F.to_json(F.struct(F.coalesce("hits", F.array().cast("array<struct<ref:string,score:double,source:string>>")).alias("hits"), note.alias("note"), n.alias("removed_by_access_filter"))).alias("payload"))
