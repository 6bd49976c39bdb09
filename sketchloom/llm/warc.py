"""WARC archives as a chunked record table.

Writing: each task streams its records into one archive of gzip members, one member per record; a payload is cut
into chunks of a view of its Arrow batch as it is written, so it exists once in the row that Spark reads and once in the batch. Of records
with equal payloads of some length, the one with the smallest identifier is a ``response``; the others are ``revisit``
records, which carry the HTTP header and the digest but no payload. Copies are found by digest; payloads aren't shuffled as long as
digests that occur twice are few enough to be broadcast. Reading: each archive is a row; a task inflates it as a
stream and yields one row per chunk with the bytes and the digest of the payload so far, and holds no more of a
payload than one chunk and the batch it travels in.

Archives go to the shared folder under names that no other attempt uses, and a table lists those of
the attempts that Spark accepted, so a task that runs twice leaves no record twice.

Defined cases: a null payload is an empty one; empty payloads give one chunk row of no bytes. A null
identifier stays null and never is referred to. Rows that repeat the smallest identifier of equal
payloads are all responses. Line breaks in an address are percent-encoded in the header. A payload of any length
becomes as many chunk rows as it needs. Columns besides the named ones are not used, so their
names can't clash with any.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.functions.storage import join_checked, materialise, scratch_path
from sketchloom.functions.workers import frugal

CHUNK = 1 << 20
REVISIT_FROM = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:x-record:"
CHUNK_SCHEMA = pa.schema(
    [
        ("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()),
        ("declared_bytes", pa.int64()), ("declared_digest", pa.string()),
        ("chunk_no", pa.int64()), ("last", pa.bool_()), ("chunk", pa.binary()),
        ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()),
    ]
)
CHUNK_DDL = "record_id string, record_type string, refers_to string, target_uri string, declared_bytes long, declared_digest string, chunk_no long, last boolean, chunk binary, bytes_so_far long, digest_so_far string"


def classified(records: DataFrame, record_id: str, payload: str, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """``records`` with _bytes, _digest, _type and _refers.

    Copies are found on lengths and digests alone; what goes back to the payloads is a row per digest that occurs
    more than once, broadcast if that is few bytes.
    """
    known = F.coalesce(F.col(payload), F.lit(""))
    marks = records.select(F.col(record_id).alias("_id"), F.octet_length(known).alias("_bytes"), F.sha2(known, 256).alias("_d"))
    first = marks.filter((F.col("_bytes") >= revisit_from) & F.col("_id").isNotNull()).groupBy("_d").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_copies"))
    first = materialise(first.filter("_copies > 1").select(F.col("_d").alias("_digest"), "_first"), "copied-payloads")
    sized = records.withColumn("_bytes", F.octet_length(known).cast("long")).withColumn("_digest", F.sha2(known, 256))
    again = F.coalesce(F.col("_first") < F.col(record_id), F.lit(False))
    joined = join_checked(sized, first, ["_digest"], "left")
    return joined.withColumn("_type", F.when(again, "revisit").otherwise("response")).withColumn("_refers", F.when(again, F.col("_first"))).drop("_first")


def _header_value(text: str | None) -> str:
    return (text or "").replace("\r", "%0D").replace("\n", "%0A")


def _write_partition(folder: str, date: str, step: int = CHUNK):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        name, out, records = f"{base}/{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("rid", "url", "type", "refers", "n_bytes", "digest")), batch.column("known"))
            for rid, url, kind, refers, n_bytes, digest, payload in rows:
                if out is None:
                    out = fs.open_output_stream(name)
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
                length = len(http) + (n_bytes if kind == "response" else 0)
                head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{ID}{_header_value(rid)}>\r\nWARC-Date: {date}\r\nWARC-Target-URI: {_header_value(url)}\r\nWARC-Payload-Digest: sha256:{digest}\r\n"
                if kind == "revisit":
                    head += f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: <{ID}{_header_value(refers)}>\r\n"
                head += f"Content-Type: application/http; msgtype=response\r\nContent-Length: {length}\r\n\r\n"
                gz, records = zlib.compressobj(1, zlib.DEFLATED, 31), records + 1
                out.write(gz.compress(head.encode() + http))
                whole = payload.as_buffer()  # a view of the batch, cut as it is written
                for at in range(0, whole.size, step):
                    out.write(gz.compress(whole.slice(at, min(step, whole.size - at))))
                out.write(gz.compress(b"\r\n\r\n") + gz.flush())
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "n_records": [records]}, schema=pa.schema([("path", pa.string()), ("n_records", pa.int64())]))

    return write


def write_archives(records: DataFrame, record_id: str, url: str, payload: str, folder: str | None = None, date: str = "2024-01-01T00:00:00Z", chunk_chars: int = CHUNK // 4) -> DataFrame:
    """Write one archive per task and return the table (path, n_records) of those that count."""
    folder = folder or scratch_path(records.sparkSession, "warc")
    _make_dir(records.sparkSession, folder)
    plain = records.select(F.col(record_id).alias("rid"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("known"))
    rows = classified(plain, "rid", "known").select(
        F.col("rid").cast("string").alias("rid"), "url", F.col("_type").alias("type"), F.col("_refers").cast("string").alias("refers"), F.col("_bytes").alias("n_bytes"), F.col("_digest").alias("digest"),
        F.when(F.col("_type") == "response", F.col("known")).otherwise("").alias("known"),
    )
    return materialise(rows.mapInArrow(frugal(_write_partition(folder, date, 4 * chunk_chars)), "path string, n_records long"), "warc-files")


def _make_dir(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)


class _Members:
    """The bytes of a file of gzip members, inflated as they are asked for."""

    def __init__(self, raw, step: int):
        self.raw, self.step, self.buffer, self.rest, self.inflate, self.ended = raw, step, b"", b"", zlib.decompressobj(31), False

    def _more(self) -> bool:
        while not self.ended:
            if self.inflate.eof:
                self.rest, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
            data = self.inflate.unconsumed_tail or self.rest or self.raw.read(self.step)
            self.rest = b""
            if not data:
                self.ended = True
                return False
            got = self.inflate.decompress(data, self.step)
            if got:
                self.buffer += got
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.buffer.find(mark)) < 0:
            if not self._more():
                return None
        found, self.buffer = self.buffer[: at + len(mark)], self.buffer[at + len(mark) :]
        return found

    def some(self, most: int) -> bytes:
        """At least one byte, and ``most`` at the most."""
        while len(self.buffer) < most and self._more():
            pass
        found, self.buffer = self.buffer[:most], self.buffer[most:]
        return found


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if v}


def _read_archive(fs, path: str, chunk_bytes: int) -> Iterator[tuple]:
    with fs.open_input_stream(path) as raw:
        members = _Members(raw, 1 << 16)
        while (head := members.until(b"\r\n\r\n")) is not None:
            warc = _fields(head)
            left = int(warc["content-length"])
            http = members.until(b"\r\n\r\n") if left else b""
            left -= len(http)
            declared = int(_fields(http).get("content-length", left)) if http else 0
            strip = lambda v: v.strip("<>").removeprefix(ID) if v else None
            about = (strip(warc.get("warc-record-id")) or None, warc.get("warc-type"), strip(warc.get("warc-refers-to")), warc.get("warc-target-uri"), declared, warc.get("warc-payload-digest", "").removeprefix("sha256:"))
            digest, done, number = hashlib.sha256(), 0, 0
            while True:
                chunk = members.some(min(chunk_bytes, left)) if left else b""
                if left and not chunk:
                    raise ValueError(f"{path}: the archive ends within a record")
                left -= len(chunk)
                done += len(chunk)
                digest.update(chunk)
                yield (*about, number, left == 0, chunk, done, digest.hexdigest())
                number += 1
                if not left:
                    break
            if members.until(b"\r\n\r\n") is None:
                raise ValueError(f"{path}: the archive ends within a record")


def _read_partition(folder_uri: str, chunk_bytes: int, batch_bytes: int = 4 << 20):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(folder_uri)
        rows, held = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                for row in _read_archive(fs, path, chunk_bytes):
                    rows.append(row)
                    held += len(row[8]) + 300
                    if held >= batch_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), CHUNK_SCHEMA.types)], schema=CHUNK_SCHEMA)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), CHUNK_SCHEMA.types)], schema=CHUNK_SCHEMA)

    return read


def read_chunks(archives: DataFrame, folder: str, chunk_bytes: int = CHUNK) -> DataFrame:
    """One row per chunk of every record in ``archives`` (path). ``folder``: any URI of their file system."""
    n = max(1, archives.count())
    return archives.select("path").repartition(n).mapInArrow(frugal(_read_partition(folder, chunk_bytes)), CHUNK_DDL)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record, from its last chunk; a revisit's length and digest are those its header declares."""
    own = F.col("record_type") == "response"
    return chunks.filter("last").select(
        "record_id", "record_type", "refers_to", "target_uri",
        F.when(own, F.col("bytes_so_far")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
        F.when(own, F.col("digest_so_far")).otherwise(F.col("declared_digest")).alias("payload_digest"),
        (~own | ((F.col("digest_so_far") == F.col("declared_digest")) & (F.col("bytes_so_far") == F.col("declared_bytes")))).alias("intact"),
    )
