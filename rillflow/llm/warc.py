"""WARC archives: a writer of one record per page and a splittable reader.

Writing: a task writes its records, each a gzip member of its own, to one file in the shared folder,
under a name of its attempt; the file counts only if the task returns it in the manifest, so lost or
repeated attempts do no harm. Of records with equal payloads of at least ``REVISIT`` bytes, the one
of the largest page_id is a response and the others are revisits, which carry headers only.

Reading: files are cut into byte ranges. A task scans its range for gzip magic, tells members from
chance matches by decoding them as far as the WARC version line, and owns the records that start
inside, whether or not they end there. From the first record on, the end of one is the start of the
next.

Defined cases: a null html is an empty payload; a null page_id is written as such and never becomes a
revisit's target unless all of its group are null; repeated rows are records of their own; payloads
that occur twice under the largest page_id are all responses; an empty table writes no file and reads
as an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm import common

REVISIT = 1000
SPLIT = 4 << 20
#: Payloads that occur more than once are broadcast up to this many.
FEW = 100_000
MAGIC = b"\x1f\x8b\x08"
_STEP = 1 << 18
_LEVEL = 6
_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def marked(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest and refers_to (null: a response) of every page."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8"))).withColumn("large", F.octet_length("html") >= REVISIT)
    groups = rows.where("large").groupBy("digest").agg(F.max("page_id").alias("target"), F.count("*").alias("copies"))
    groups, _ = common.materialize(groups.where("copies > 1").select(F.col("digest").alias("_d"), "target"), "warc-copies")
    if groups.count() <= FEW:  # else both sides are shuffled
        groups = F.broadcast(groups)
    target = F.when(~F.col("page_id").eqNullSafe(F.col("target")), F.col("target"))
    return rows.join(groups, F.col("large") & (F.col("digest") == F.col("_d")), "left").select("page_id", "url", "html", "digest", target.alias("refers_to"))


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": " ".join((url or "").split()),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    if refers_to is not None:
        fields |= {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write(pages: DataFrame, folder: str) -> DataFrame:
    """The manifest (path, bytes, records) of the archives written under ``folder``, a shared place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        path = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        out, size, records = None, 0, 0
        for batch in batches:
            for row in zip(*batch.columns):
                page_id, url, html, digest, refers_to = (x.as_py() for x in row)
                if out is None:
                    fs, place = _opened(path)
                    fs.create_dir(place.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(place, compression=None)  # members are compressed one by one
                member = _member(_record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, refers_to))
                out.write(member)
                size, records = size + len(member), records + 1
        if out is not None:
            out.close()
            yield pa.record_batch([[path], [size], [records]], names=["path", "bytes", "records"])

    return common.in_arrow(pages.select("page_id", "url", "html", "digest", "refers_to"), run, "path string, bytes long, records long")


class _Range:
    """A file's bytes from a place on, read as far as asked."""

    def __init__(self, file: pa.NativeFile, start: int, size: int):
        self.file, self.base, self.size, self.data = file, start, size, b""

    def upto(self, end: int) -> None:
        end = min(end, self.size)
        if (have := self.base + len(self.data)) < end:
            self.file.seek(have)
            self.data += self.file.read(max(end - have, min(_STEP, self.size - have)))

    def drop(self, before: int) -> None:
        if before - self.base > 4 * _STEP:
            self.data, self.base = self.data[before - self.base :], before

    def byte(self, at: int) -> bytes:
        self.upto(at + _STEP)
        return self.data[at - self.base : at - self.base + _STEP]


def _starts_record(part: _Range, at: int) -> bool:
    """Whether a gzip member that begins a WARC record stands here: its header, however long, and first bytes decode."""
    z, out = zlib.decompressobj(31), b""
    try:
        while len(out) < 7 and not z.eof and (data := z.unconsumed_tail or part.byte(at)):
            at += len(data) if data is not z.unconsumed_tail else 0
            out += z.decompress(data, 64)
    except zlib.error:
        return False
    return out.startswith(b"WARC/1.")


def _inflate(part: _Range, at: int) -> tuple[bytes, int]:
    z, out = zlib.decompressobj(31), []
    while not z.eof:
        chunk = part.byte(at)
        if not chunk:
            raise EOFError("a WARC record ends before its gzip member does")
        out.append(z.decompress(chunk))
        at += len(chunk) - len(z.unused_data)
    return b"".join(out), at


def _parsed(data: bytes) -> tuple:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    page = lambda x: int(x[10:-1]) if x and x != "<urn:page:>" else None
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    return page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], size, digest, kind, page(fields.get("WARC-Refers-To")), payload if kind == "response" else None


def records(path: str, start: int, stop: int, size: int) -> Iterator[tuple]:
    """The records of a file that begin in [start, stop)."""
    fs, place = _opened(path)
    with fs.open_input_file(place) as file:
        part, at = _Range(file, start, size), start
        while at < stop:  # to the first record
            part.upto(at + _STEP)
            found = part.data.find(MAGIC, at - part.base)
            if found < 0:
                at = max(at + 1, part.base + len(part.data) - len(MAGIC) + 1)
            elif _starts_record(part, at := part.base + found):
                break
            else:
                at += 1
            part.drop(at)
        while at < min(stop, size):
            data, at = _inflate(part, at)
            part.drop(at)
            yield _parsed(data)


def read(files: DataFrame, payloads: bool = False, split: int = SPLIT) -> DataFrame:
    """The records of the archives ``files`` (path, bytes), whatever the files' sizes."""
    spark = files.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long")))
    splits = files.where("bytes > 0").select("path", "bytes", first.alias("first")).repartition(parts, "path", "first")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _RECORD.split(", ")]
        for path, size, at in zip(*(c.to_pylist() for c in batch.columns)):
            lot, held = [], 0
            for row in records(path, at, min(at + split, size), size):
                lot.append(row if payloads else (*row[:-1], None))
                held += len(row[-1] or b"") if payloads else 64
                if held > 4 << 20:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*lot), _TYPES)], names=names)
                    lot, held = [], 0
            if lot:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*lot), _TYPES)], names=names)

    return common.map_arrow(splits, run, _RECORD)


_TYPES = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages as archives in the shared folder and read them back."""
    spark = pages.sparkSession
    folder = f"{common.work_dir(spark)}/warc-{uuid.uuid4().hex}"
    manifest, _ = common.materialize(write(marked(pages), folder), "warc-manifest")
    return read(manifest)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = round_trip(common.table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


OP3_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
g AS (SELECT payload_digest, max(page_id) AS target FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN g.target IS NULL OR g.target = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN g.target <> d.page_id THEN g.target END AS refers_to,
       d.url
FROM d LEFT JOIN g ON d.payload_bytes >= 1000 AND g.payload_digest = d.payload_digest
"""
