"""WARC archives: one gzip member per record, written and read sequentially.

The writer rolls archives in the shared folder; the reader inflates them piece by piece, frames
each block by its Content-Length and verifies block and payload digests.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import lean, shared_dir

#: Payloads shorter than this are always stored in full.
REVISIT_BYTES = 100
#: An archive is closed once it has reached this size.
ARCHIVE_BYTES = 32_000_000
_PIECE = 1 << 16


class WarcError(ValueError):
    pass


@dataclass
class Record:
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""

    @property
    def payload(self) -> bytes:
        """The body of an HTTP block; a block of another type is its own payload."""
        if not self.headers.get("content-type", "").startswith("application/http"):
            return self.block
        return self.block.partition(b"\r\n\r\n")[2]


def _line(value: str) -> str:
    return "".join(c if c not in "\r\n" else " " for c in value)


def write_record(kind: str, uri: str | None, record_id: str, date: str, block: bytes, extra: dict[str, str]) -> bytes:
    """One record as a gzip member of its own."""
    headers = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": date}
    if uri is not None:
        headers["WARC-Target-URI"] = _line(uri)
    headers |= extra
    headers |= {"WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + "\r\n"
    pack = zlib.compressobj(3, zlib.DEFLATED, 31)
    return pack.compress(head.encode()) + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def inflate_members(pieces: Iterable[bytes]) -> Iterator[bytes | None]:
    """Inflated bytes of a stream of gzip members, piece by piece; None ends each member."""
    left, member = b"", None
    for piece in pieces:
        left += piece
        while left:
            if member is None:
                member = zlib.decompressobj(31)
            try:
                out = member.decompress(left, _PIECE)
            except zlib.error as e:
                raise WarcError(f"not a gzip member: {e}") from None
            left = member.unused_data if member.eof else member.unconsumed_tail
            if out:
                yield out
            if member.eof:
                yield None
                member = None
            elif not out and not left:
                break
    if member is not None:
        while out := member.decompress(left, _PIECE):
            left = member.unconsumed_tail
            yield out
        if not member.eof:
            raise WarcError("the last gzip member is cut off")
        yield None


def read_records(pieces: Iterable[bytes]) -> Iterator[Record]:
    """The records of an archive, in order. Holds one record at a time. Raises WarcError for a
    broken frame or a digest that does not fit."""
    have = bytearray()
    record: Record | None = None
    for out in inflate_members(pieces):
        if out is not None:
            have += out
            if record is None and (at := have.find(b"\r\n\r\n")) >= 0:
                record = Record(_headers(bytes(have[:at])))
                del have[: at + 4]
            continue
        if record is None:
            raise WarcError("a member without a record header")
        length = int(record.headers.get("content-length", "-1"))
        if length < 0 or len(have) != length + 4 or have[length:] != b"\r\n\r\n":
            raise WarcError(f"a record's block has {len(have) - 4} bytes; its header says {length}")
        record.block = bytes(have[:length])
        _verify(record)
        yield record
        have.clear()
        record = None


def _headers(head: bytes) -> dict[str, str]:
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise WarcError(f"not a WARC record: {first[:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def _verify(record: Record) -> None:
    said = record.headers.get("warc-block-digest", "").removeprefix("sha256:")
    if said and said != hashlib.sha256(record.block).hexdigest():
        raise WarcError(f"block digest of {record.headers.get('warc-record-id')} does not fit")
    said = record.headers.get("warc-payload-digest", "").removeprefix("sha256:")
    if said and record.headers.get("warc-type") == "response" and said != hashlib.sha256(record.payload).hexdigest():
        raise WarcError(f"payload digest of {record.headers.get('warc-record-id')} does not fit")


def classify(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """pages(page_id, url, html) with payload_digest, payload_bytes and first: the smallest page_id
    of equal payloads of at least REVISIT_BYTES bytes (null for smaller payloads)."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    named = pages.select(F.col(id_col).alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"))
    named = named.withColumn("payload_digest", F.sha2("html", 256)).withColumn("payload_bytes", F.octet_length("html").cast("long"))
    firsts = named.filter(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("payload_digest", "first")
    return named.join(firsts, "payload_digest", "left")


_STATUS = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a whole URI, and the path in it."""
    scheme, _, rest = folder.partition(":")
    return pafs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + (rest if rest.startswith("//") else f"//{rest}"))


def whole_uri(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme that Spark finds it by; without one, that of its default file
    system. Raises where tasks could not write there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    try:
        _store(uri)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError) as e:
        raise ValueError(f"archives cannot be written to {uri}: {e}") from None
    return uri


def _writer(folder: str, date: str):
    def run(batches):
        from pyspark import TaskContext

        fs, root = _store(folder)
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        sink, name, n, size, part = None, "", 0, 0, 0

        def close():
            sink.close()
            fs.move(f"{root}/{name}.open", f"{root}/{name}.warc.gz")
            return pa.RecordBatch.from_pydict({"archive": [f"{name}.warc.gz"], "records": [n], "bytes": [size]})

        for batch in batches:
            for row in (r for i in range(0, len(batch), 500) for r in batch.slice(i, 500).to_pylist()):
                if sink is None:
                    name, n, size = f"part-{task:06d}-{part:04d}-{uuid.uuid4().hex}", 0, 0
                    sink, part = fs.open_output_stream(f"{root}/{name}.open"), part + 1
                again = row["first"] is not None and row["first"] != row["page_id"]
                extra = {"WARC-Payload-Digest": f"sha256:{row['payload_digest']}", "X-Page-ID": "" if row["page_id"] is None else str(row["page_id"]), "X-Payload-Length": str(row["payload_bytes"])}
                if again:
                    extra |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{row['first']}>"}
                block = _STATUS + (b"" if again else row["html"].encode())
                data = write_record("revisit" if again else "response", row["url"], f"<urn:page:{row['page_id']}:{name}:{n}>", date, block, extra)
                sink.write(data)
                n, size = n + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    sink = None
        if sink is not None:
            yield close()

    return lean(run)


def write_archives(pages: DataFrame, folder: str | None = None, date: str = "2024-01-01T00:00:00Z") -> tuple[str, DataFrame]:
    """(folder, manifest of archive, records, bytes). Each row becomes one record.

    Archives are moved to their name when whole, and every attempt of a task writes names of its
    own: the manifest, which is cut here, lists each record's archive exactly once, also after a
    task ran twice or an executor was lost. Record ids are unique; that of page 7 begins with
    ``urn:page:7``, by which revisits name it. folder: as Spark would find it, in a store that pyarrow
    can write; by default a fresh one in the shared folder, deleted when the driver ends.
    """
    spark = pages.sparkSession
    fresh = folder is None
    folder = whole_uri(spark, folder or f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}")
    fs, root = _store(folder)
    fs.create_dir(root, recursive=True)
    if fresh:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    rows = classify(pages).select("page_id", "url", "html", "payload_digest", "payload_bytes", "first")
    manifest = rows.mapInArrow(_writer(folder, date), "archive string, records long, bytes long")
    shared_dir(spark)
    return folder, manifest.checkpoint(eager=True)


def _pieces(stream) -> Iterator[bytes]:
    with stream:
        while piece := stream.read(_PIECE):
            yield piece


def _reader(folder: str):
    def run(batches):
        fs, root = _store(folder)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                rows: list[tuple] = []
                for r in read_records(_pieces(fs.open_input_stream(f"{root}/{name}", compression=None))):
                    h = r.headers
                    again = h["warc-type"] == "revisit"
                    refers = int(h["warc-refers-to"].removeprefix("<urn:page:").removesuffix(">")) if again else None
                    length = int(h["x-payload-length"]) if again else len(r.payload)
                    digest = h["warc-payload-digest"].removeprefix("sha256:") if again else hashlib.sha256(r.payload).hexdigest()
                    rows.append((int(h["x-page-id"]) if h["x-page-id"] else None, h.get("warc-target-uri"), length, digest, h["warc-type"], refers))
                    if len(rows) == 5000:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    return lean(run)


_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_archives(folder: str, manifest: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of every record of the
    archives that the column ``archive`` of the manifest names. Each is read as a stream, piece by
    piece; archives of one partition of the manifest are read by one task."""
    return manifest.select("archive").mapInArrow(_reader(whole_uri(manifest.sparkSession, folder)), _READ)


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) and read the archives back.

    Nulls: a null html is an empty payload, a null url gives a record without a target, a null
    page_id comes back as null and revisits an equal payload that has an id. Rows with one page_id and one payload are each a response. Other columns are
    ignored; an empty table gives no archive and an empty result.
    """
    folder, manifest = write_archives(pages, folder)
    return read_archives(folder, manifest)
