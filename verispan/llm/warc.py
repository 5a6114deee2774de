"""WARC archives: write pages with revisit records, an index first, and reads by coalesced ranges.

Each task writes gzip-per-record archives into a shared folder and returns an index row
per record: file, offset, length, URL and payload digest. The index is a written table,
so only the files of task attempts that succeeded are ever referred to; a file that a
lost attempt left is read by nobody. A read takes any selection of index rows, deals it
out by file and offset, and joins neighbouring byte ranges into one read each.

Of pages with equal payloads of at least `least` bytes, the one with the largest page_id
is written in full and the others as revisits of it. Equality is by SHA-1 and length, as
the format has it. Pages of a hot payload are not gathered: a partial aggregation finds
each payload's largest id, and only payloads that occur again are joined back.

Defined results. A null html counts as an empty payload; a null url is left out of the
record. A null page_id sorts below all others and stays null; where all ids of a payload
are null, or several rows have the largest id, each of these is a full response. Repeated
rows give a record each. Extra columns are not written. An empty table gives an empty
index and an empty read.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verispan.llm.common import fresh_path, written
from verispan.session import ship

INDEX = "page_id long, url string, file string, offset long, length long, digest string, record_type string"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
#: Ranges at most this far apart become one read, of at most READ bytes if it has several records.
GAP, READ = 64 << 10, 8 << 20
#: An archive is closed at this size.
ROLL = 256 << 20
#: Archive bytes that a task of a read gets on average.
TASK_BYTES = 4 << 20
#: Repeated payloads up to this many are broadcast as (digest, id) rows; more are joined by a shuffle, each payload's pages dealt out by SALTS.
BROADCAST_ROWS, SALTS = 200_000, 16
_DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _header(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, date: str = _DATE) -> bytes:
    """One WARC/1.1 record, uncompressed; a revisit if refers_to is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.insert(3, f"WARC-Target-URI: {_header(url)}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's fields; payload is None for a revisit."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    number = lambda x: int(x[len("<urn:page:") : -1]) if x and x != "<urn:page:>" else None
    revisit = fields["WARC-Type"] == "revisit"
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "refers_to": number(fields.get("WARC-Refers-To")),
        "payload_bytes": size,
        "payload_digest": base64.b32decode(fields["WARC-Payload-Digest"].split(":")[1]).hex(),
        "payload": None if revisit else payload,
    }


def write(pages: DataFrame, folder: str | None = None, least: int = 1000, roll: int = ROLL) -> DataFrame:
    """Write the archives; returns the index, a table already written to the shared folder."""
    spark = pages.sparkSession
    ship(spark)
    folder = folder or fresh_path(spark, "warc")
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(folder)
    store.create_dir(at, recursive=True)

    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("sha1", F.sha1("payload"))
    again = (
        rows.filter(F.octet_length("payload") >= least)
        .groupBy("sha1", F.octet_length("payload").alias("size"))
        .agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 AND top IS NOT NULL")
        .select("sha1", "size", "top")
    )
    again = written(again, "repeated-payloads")
    rows = rows.withColumn("size", F.octet_length("payload"))
    if again.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(again), ["sha1", "size"], "left")
    else:
        again = again.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(again, ["sha1", "size", "salt"], "left")
    rows = rows.withColumn("refers_to", F.when(F.coalesce(F.col("page_id") != F.col("top"), F.col("top").isNotNull()), F.col("top")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        stem = f"part-{task.partitionId():06d}-{task.attemptNumber()}-{uuid.uuid4().hex[:8]}"
        out, name, offset, files = None, "", 0, 0
        for b in batches:
            index: dict[str, list] = {f: [] for f in ("page_id", "url", "file", "offset", "length", "digest", "record_type")}
            for i in range(b.num_rows):
                page, url, payload, sha1, ref = (b.column(c)[i].as_py() for c in range(5))
                if out is None or offset >= roll:
                    if out is not None:
                        out.close()
                    name, offset, files = f"{stem}-{files:04d}.warc.gz", 0, files + 1
                    out = store.open_output_stream(f"{at}/{name}", compression=None)
                z = zlib.compressobj(1, zlib.DEFLATED, 31)
                data = z.compress(record(page, url, payload, sha1, ref)) + z.flush()
                out.write(data)
                for f, x in zip(index, (page, url, name, offset, len(data), sha1, "response" if ref is None else "revisit"), strict=True):
                    index[f].append(x)
                offset += len(data)
            yield pa.RecordBatch.from_pydict(index, schema=_schema(INDEX))
        if out is not None:
            out.close()

    index = rows.select("page_id", "url", "payload", "sha1", "refers_to").mapInArrow(run, INDEX)
    return written(index.select("*", F.lit(folder).alias("folder")), "warc-index")


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def read(index: DataFrame, gap: int = GAP, most: int = READ) -> DataFrame:
    """The records of the selected index rows, payloads included. The number of tasks follows the bytes to be read, not the index's own."""
    ship(index.sparkSession)
    tasks = max(1, -(-(index.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES))
    dealt = (
        index.select("folder", "file", "offset", "length")
        .repartitionByRange(tasks, F.col("folder"), F.col("file"), F.col("offset"))
        .sortWithinPartitions("folder", "file", "offset")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        stores: dict[str, tuple] = {}

        def fetch(spans: list[tuple[str, str, int, int]]) -> pa.RecordBatch:
            folder, file = spans[0][:2]
            if folder not in stores:
                stores[folder] = fs.FileSystem.from_uri(folder)
            store, at = stores[folder]
            lo = spans[0][2]
            with store.open_input_file(f"{at}/{file}") as f:
                f.seek(lo)
                data = f.read(spans[-1][2] + spans[-1][3] - lo)
            got = [parse(zlib.decompress(data[o - lo : o - lo + n], 31)) for _, _, o, n in spans]
            return pa.RecordBatch.from_pylist(got, schema=_schema(RECORDS))

        spans: list[tuple[str, str, int, int]] = []
        for b in batches:
            for folder, file, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if spans:
                    end = spans[-1][2] + spans[-1][3]
                    if (folder, file) != spans[-1][:2] or offset > end + gap or offset + length - spans[0][2] > most:
                        yield fetch(spans)
                        spans = []
                spans.append((folder, file, offset, length))
        if spans:
            yield fetch(spans)

    return dealt.mapInArrow(run, RECORDS)
