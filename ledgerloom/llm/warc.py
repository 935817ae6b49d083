"""WARC archives: a writer, and a sequential reader that verifies what it reads.

Every record is a gzip member of its own. The reader takes a file as a stream: it inflates a member
piece by piece, reads the header lines, then the body by its Content-Length, and checks the digests
of block and payload against the record's. It holds one record at a time; a file is never loaded.

Records with equal payloads: the one with the largest id is the response, the others revisit it and
carry no payload. Only digests and ids are compared in Spark; payloads aren't shuffled for that
unless the winners of repeated payloads are too many to send to every task.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import KEY, bound_batches, column, keyed, saved, shared_dir

VERSION = "WARC/1.1"
#: A new file begins after so many compressed bytes.
FILE_BYTES = 64 << 20
_READ = 1 << 16
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """A file that isn't framed as its headers say, or whose digests differ."""


@dataclass
class Record:
    headers: dict[str, str] = field(default_factory=dict)
    body: bytes = b""

    @property
    def payload(self) -> bytes:
        return self.body.partition(b"\r\n\r\n")[2] if self.headers.get("content-type", "").startswith("application/http") else self.body


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]+", " ", value).strip()


def member(headers: list[tuple[str, str]], body: bytes, level: int = 6) -> bytes:
    """One record as one gzip member."""
    lines = [VERSION, *(f"{k}: {_clean(v)}" for k, v in headers), f"WARC-Block-Digest: sha1:{sha1(body)}", f"Content-Length: {len(body)}"]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    head = "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n"
    return packer.compress(head) + packer.compress(body) + packer.compress(b"\r\n\r\n") + packer.flush()


class _Members:
    """The inflated bytes of each gzip member of a stream, without reading ahead of need."""

    def __init__(self, stream: BinaryIO):
        self.stream, self.rest, self.inflater, self.ready = stream, b"", None, b""

    def begin(self) -> bool:
        """Go to the next member; False at the end of the file."""
        if not self.rest:
            self.rest = bytes(self.stream.read(_READ))
        self.inflater, self.ready = zlib.decompressobj(31), b""
        return bool(self.rest)

    def more(self) -> bool:
        """Inflate one more piece; False at the end of the member."""
        if self.inflater.eof:
            return False
        if not self.rest:
            self.rest = bytes(self.stream.read(_READ))
            if not self.rest:
                raise WarcError("the file ends inside a gzip member")
        try:
            self.ready += self.inflater.decompress(self.rest, _READ)
        except zlib.error as e:
            raise WarcError(f"bad gzip member: {e}") from e
        self.rest = self.inflater.unused_data if self.inflater.eof else self.inflater.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes:
        while mark not in self.ready:
            if not self.more():
                raise WarcError("the member ends inside a record's header")
        out, _, self.ready = self.ready.partition(mark)
        return out

    def take(self, n: int) -> bytes:
        parts, size = [self.ready[:n]], min(n, len(self.ready))
        self.ready = self.ready[n:]
        while size < n:
            if not self.more():
                raise WarcError("the member ends inside a record's body")
            piece, self.ready = self.ready[: n - size], self.ready[n - size :]
            parts.append(piece)
            size += len(piece)
        return b"".join(parts)

    def end(self) -> None:
        while self.more():
            pass
        if self.ready:
            raise WarcError("bytes after the end of a record")


def read(stream: BinaryIO, verify: bool = True) -> Iterator[Record]:
    """The records of an archive in order."""
    members = _Members(stream)
    while members.begin():
        first, *lines = members.until(b"\r\n\r\n").decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise WarcError(f"not a WARC record: {first[:20]!r}")
        headers = {}
        for line in lines:
            name, colon, value = line.partition(":")
            if not colon:
                raise WarcError(f"not a header: {line[:60]!r}")
            headers[name.strip().lower()] = value.strip()
        length = headers.get("content-length", "")
        if not re.fullmatch(r"\d+", length):
            raise WarcError("no Content-Length")
        record = Record(headers, members.take(int(length)))
        if members.take(4) != b"\r\n\r\n":
            raise WarcError("a record doesn't end where its Content-Length says")
        members.end()
        if verify:
            check(record)
        yield record


def check(record: Record) -> None:
    kinds = [("warc-block-digest", record.body)]
    if record.headers.get("warc-type") != "revisit":  # a revisit's payload is elsewhere
        kinds.append(("warc-payload-digest", record.payload))
    for name, data in kinds:
        given = record.headers.get(name)
        if given and given != f"sha1:{sha1(data)}":
            raise WarcError(f"{name} differs in {record.headers.get('warc-record-id')}")


def _name(id: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, id)}>"


def _write(folder: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, path, size, records = None, "", 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for row in batch.slice(at, 256).to_pylist():
                    if out is None:
                        path, size, records = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = store.open_output_stream(path, compression=None)
                        data = member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _name(path)), ("WARC-Date", "2000-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                        out.write(data)
                        size += len(data)
                    payload = row["payload"] or b""
                    id, revisit = row["id"], row["refers_to"] is not None
                    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _name(str(id))), ("WARC-Date", "2000-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{sha1(payload)}"), ("Content-Type", "application/http; msgtype=response")]
                    headers += [("WARC-Target-URI", row["url"])] if row["url"] is not None else []
                    headers += [("X-Record-Key", str(id))] if id is not None else []
                    if revisit:
                        headers += [("WARC-Profile", REVISIT), ("WARC-Refers-To", _name(str(row["refers_to"]))), ("X-Refers-To-Key", str(row["refers_to"]))]
                    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
                    data = member(headers, head + (b"" if revisit else payload))
                    out.write(data)
                    size, records = size + len(data), records + 1
                    if size >= file_bytes:
                        out.close()
                        yield pa.record_batch({"path": [path], "bytes": [size], "records": [records]})
                        out = None
        if out is not None:
            out.close()
            yield pa.record_batch({"path": [path], "bytes": [size], "records": [records]})

    return run


def write_warc(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, folder: str | None = None, file_bytes: int = FILE_BYTES) -> tuple[str, DataFrame]:
    """Write a record for each row; (folder, manifest of path, bytes, records).

    Of rows with equal payloads of ``min_bytes`` bytes or more, that with the largest id (of equal
    ids, the last row) is the response and the others revisit it; a null id never wins over another,
    and if all are null, all are responses. A null payload is an empty one, a null url has no
    WARC-Target-URI. An empty table gives no files. A task that is run again writes new files; only
    those in the manifest are the archive.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    body = F.coalesce(column(payload).cast("string"), F.lit(""))
    rows = keyed(pages.select(column(id).cast("long").alias("id"), column(url).cast("string").alias("url"), body.cast("binary").alias("payload")), KEY)
    rows = rows.withColumn("digest", F.when(F.octet_length("payload") >= min_bytes, F.sha2("payload", 256)))
    best = rows.where("digest is not null and id is not null").groupBy("digest").agg(F.max(F.struct("id", KEY)).alias("winner"))
    often = rows.where("digest is not null").groupBy("digest").count().where("count > 1")
    best = saved(best.join(often, "digest").select("digest", "winner"), "winners")
    refers = F.when(F.col("winner").isNotNull() & (F.col(KEY) != F.col(f"winner.{KEY}")), F.col("winner.id"))
    named = rows.join(best, "digest", "left").select("id", "url", "payload", refers.alias("refers_to"))
    return folder, saved(named.mapInArrow(_write(folder, file_bytes), "path string, bytes long, records long"), "manifest")


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        names = ("id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload")
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

        for given in batches:
            for path in given.column("path").to_pylist():
                rows, size = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for record in read(stream):
                        h = record.headers
                        if h["warc-type"] not in ("response", "revisit"):
                            continue
                        number = lambda name, h=h: int(h[name]) if name in h else None
                        told = h["warc-payload-digest"].removeprefix("sha1:")
                        if h["warc-type"] == "response":  # as read, not as told
                            payload, to = record.payload, None
                            length, digest = len(payload), sha1(payload)
                        else:
                            payload, to, length, digest = None, number("x-refers-to-key"), None, told
                        rows.append((number("x-record-key"), h.get("warc-target-uri"), h["warc-type"], length, digest, to, payload))
                        size += len(record.body)
                        if len(rows) >= 1000 or size > 8 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    return run


def read_warc(spark, folder: str, manifest: DataFrame) -> DataFrame:
    """id, url, record_type, payload_bytes, payload_digest, refers_to, payload of every record.

    payload_bytes and payload_digest are those of the payload that was read; a revisit, which has
    none, has the digest it names and no bytes (see resolved()). A file is one task's, and files are
    at most about ``file_bytes`` long. A damaged archive fails with a WarcError. An empty manifest
    gives no rows.
    """
    # An explicit number of partitions, which Spark doesn't merge: a file each, up to eight rounds of all cores.
    tasks = max(1, min(manifest.count(), max(200, 8 * spark.sparkContext.defaultParallelism)))
    files = manifest.select("path").coalesce(1).repartition(tasks) if tasks <= 1000 else manifest.select("path").repartition(tasks)
    return files.mapInArrow(_read(folder), "id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def resolved(records: DataFrame) -> DataFrame:
    """records without payload, each revisit with the payload_bytes of the response that it refers to.

    A revisit whose response, by id and digest, isn't among the records fails.
    """
    rows = saved(records.drop("payload"), "records")
    own = rows.where("record_type = 'response'").select(F.col("id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("found"))
    lost = F.raise_error(F.concat(F.lit("no response for the revisit with digest "), "payload_digest")).cast("long")
    size = F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(F.coalesce("found", lost))
    return rows.join(own.dropDuplicates(["refers_to", "payload_digest"]), ["refers_to", "payload_digest"], "left").select(*(size.alias(c) if c == "payload_bytes" else F.col(c) for c in rows.columns))
