"""WARC archives as chunked record tables.

Payloads are cut into chunk rows where the pages are read; shuffles, sorts, the writer and the reader see a chunk at a time. A chunk row that is read
back has the record's identifier, the chunk's number, its bytes and the digest of the payload up to its end, so that the
last chunk's digest is the payload's. Only the source's own cell holds a whole payload. Archives are gzip WARC/1.1 files, a member a record, written
under a temporary name and renamed, one to a task; the manifest of the attempts that committed says which
files count, so a lost executor costs the repeated tasks only.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shared_dir, small

CHUNK = 1 << 20
#: Equal payloads of at least so many bytes are written once and revisited.
LEAST = 100
MANIFEST = "archive string, records long, bytes long"
CHUNKS = "page_id long, record_type string, refers_to long, url string, length long, stated string, chunk_no long, n_bytes long, is_last boolean, digest string, data binary"


def _body(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select("page_id", "url", payload.alias("payload")).withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))


def repeated(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(digest, first_id) of the payloads of at least `least` bytes that occur more than once: digests alone are shuffled, pre-aggregated."""
    digests = _body(pages).where(F.col("payload_bytes") >= least).groupBy(F.col("payload_digest").alias("digest"))
    return digests.agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("digest", "first_id")


def chunk_rows(pages: DataFrame, chunk: int = CHUNK, least: int = LEAST) -> DataFrame:
    """pages (page_id, url, html) -> rows (rid, chunk_no, last, page_id, url, record_type, refers_to, payload_digest, payload_bytes, data) for the writer, sorted
    by (rid, chunk_no) in each partition and a record's rows in one.

    rid numbers the rows of pages. A revisit is one row without data, an empty payload one row. Chunks meet the repeated digests, broadcast if
    they are few; short payloads never repeat and get keys of their own, so that no key gathers them.
    """
    first = cut(repeated(pages, least), "repeated")
    body = _body(pages).withColumn("rid", F.monotonically_increasing_id())
    body = body.withColumn("key", F.when(F.col("payload_bytes") >= least, F.col("payload_digest")).otherwise(F.col("rid").cast("string")))
    parts = F.greatest(F.ceil(F.col("payload_bytes") / F.lit(chunk)), F.lit(1))
    rows = body.select("*", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("chunk_no"))
    rows = rows.select("rid", "key", "page_id", "url", "payload_digest", "payload_bytes", "chunk_no", (F.col("chunk_no") == parts - 1).alias("last"), F.substring("payload", (F.col("chunk_no") * chunk + 1).cast("int"), F.lit(chunk)).alias("data"))
    joined = rows.join(small(first, first.count()), F.col("key") == F.col("digest"), "left")
    revisit = F.coalesce(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.lit(False))
    out = joined.select("rid", "chunk_no", (F.col("last") | revisit).alias("last"), "page_id", "url", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to"), "payload_digest", "payload_bytes", F.when(~revisit, F.col("data")).alias("data"))
    return out.where("record_type = 'response' OR chunk_no = 0").sortWithinPartitions("rid", "chunk_no")


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _header(page_id, url, kind, refers, digest, n) -> tuple[bytes, bytes]:
    """WARC header and HTTP header of a record; the HTTP header states the whole payload's length, also in a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = len(http) + (n if kind == "response" else 0)
    name = lambda x: f"<urn:page:{'null' if x is None else x}>"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {re.sub('[\\x00-\\x20\\x7f]', lambda m: f'%{ord(m[0]):02X}', url or '')}", f"WARC-Payload-Digest: sha256:{digest}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {block}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode(), http


class _Writer:
    """A gzip WARC file, a member a record, opened under a temporary name."""

    def __init__(self, folder: str):
        self.folder, self.name, self.records = folder, f"{uuid.uuid4().hex}.warc.gz", 0
        self.where, self.path = _open(folder)
        self.where.create_dir(self.path, recursive=True)
        self.out = self.where.open_output_stream(f"{self.path}/.{self.name}", compression=None)

    def add(self, row: dict, data: pa.Buffer | None) -> None:
        if row["chunk_no"] == 0:
            self.gz = zlib.compressobj(1, zlib.DEFLATED, 31)
            for part in _header(row["page_id"], row["url"], row["record_type"], row["refers_to"], row["payload_digest"], row["payload_bytes"]):
                self.out.write(self.gz.compress(part))
        if data is not None and data.size:
            self.out.write(self.gz.compress(data))
        if row["last"]:
            self.out.write(self.gz.compress(b"\r\n\r\n") + self.gz.flush())
            self.records += 1

    def close(self) -> pa.RecordBatch:
        self.out.close()
        self.where.move(f"{self.path}/.{self.name}", f"{self.path}/{self.name}")
        size = self.where.get_file_info(f"{self.path}/{self.name}").size
        return pa.RecordBatch.from_pydict({"archive": [f"{self.folder}/{self.name}"], "records": pa.array([self.records], pa.int64()), "bytes": pa.array([size], pa.int64())})


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write chunk_rows, an archive a task; the manifest (archive, records, bytes), already durable."""
    head = ["chunk_no", "last", "page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in batches:
            for i in range(batch.num_rows):
                writer = writer or _Writer(folder)
                data = batch.column("data")[i]
                writer.add({c: batch.column(c)[i].as_py() for c in head}, data.as_buffer() if data.is_valid else None)
        if writer is not None:
            yield writer.close()

    return cut(rows.select("rid", *head, "data").mapInArrow(run, MANIFEST), "manifest")


class _Reader:
    """Bytes of a gzip file of many members, a bounded piece at a time."""

    def __init__(self, source, step: int = 1 << 18):
        self.source, self.step, self.z, self.raw, self.have = source, step, None, b"", bytearray()

    def fill(self) -> bool:
        while True:
            if not self.raw:
                self.raw = self.source.read(self.step)
                if not self.raw:
                    return False
            if self.z is None:
                self.z = zlib.decompressobj(31)
            data = self.z.decompress(self.raw, self.step)
            self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if self.z.eof:
                self.z = None
            if data:
                self.have += data
                return True

    def line(self) -> bytes:
        while (at := self.have.find(b"\r\n")) < 0:
            if not self.fill():
                return b""
        out = bytes(self.have[:at])
        del self.have[: at + 2]
        return out

    def take(self, most: int) -> bytes:
        while not self.have and self.fill():
            pass
        out = bytes(self.have[:most])
        del self.have[:most]
        return out


def records_of(source, chunk: int = CHUNK) -> Iterator[dict]:
    """Chunk rows of a WARC stream."""
    r = _Reader(source)
    while True:
        first = r.line()
        while first == b"" and (r.have or r.fill()):
            first = r.line()
        if not first:
            return
        head = {}
        while line := r.line():
            k, _, v = line.decode().partition(": ")
            head[k] = v
        left, http = int(head["Content-Length"]), {}
        while True:
            line = r.line()
            left -= len(line) + 2
            if not line:
                break
            k, _, v = line.decode().partition(": ")
            http[k] = v
        ident = lambda k: None if "null" in (x := head.get(k, "null")) else int(x[len("<urn:page:") : -1])
        row = {"page_id": ident("WARC-Record-ID"), "record_type": head["WARC-Type"], "refers_to": ident("WARC-Refers-To"), "url": head.get("WARC-Target-URI"), "length": int(http["Content-Length"]), "stated": head["WARC-Payload-Digest"].removeprefix("sha256:")}
        sha, no, have = hashlib.sha256(), 0, bytearray()
        while True:
            while len(have) < min(chunk, left):
                piece = r.take(min(chunk, left) - len(have))
                if not piece:
                    raise ValueError("archive ends inside a record")
                have += piece
            left -= len(have)
            sha.update(have)
            yield row | {"chunk_no": no, "n_bytes": len(have), "is_last": left == 0, "digest": sha.copy().hexdigest(), "data": bytes(have)}
            have, no = bytearray(), no + 1
            if not left:
                break


def read_archives(manifest: DataFrame, data: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table of the archives of a manifest, a task a few archives; data=False leaves the bytes out."""
    schema = CHUNKS if data else CHUNKS.removesuffix(", data binary")
    types = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("length", pa.int64()), ("stated", pa.string()), ("chunk_no", pa.int64()), ("n_bytes", pa.int64()), ("is_last", pa.bool_()), ("digest", pa.string()), *([("data", pa.binary())] if data else [])])

    def run(batches):
        for batch in batches:
            for uri in batch.column("archive").to_pylist():
                where, path = _open(uri)
                with where.open_input_stream(path, compression=None) as source:
                    rows, held = [], 0
                    for row in records_of(source, chunk):
                        rows.append({k: row[k] for k in types.names})
                        held += len(row["data"]) if data else 200
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, types)
                            rows, held = [], 0
                    yield pa.RecordBatch.from_pylist(rows, types)

    n = max(1, min(manifest.count(), 10_000))
    return manifest.select("archive").repartition(n).mapInArrow(run, schema)


def op10(pages: DataFrame) -> DataFrame:
    """Write every page as a WARC record, read the archives back and fold the chunks to one row a record.

    A null page is the empty payload; a null page_id stays null; a payload under LEAST bytes is always a response; of equal
    larger payloads the smallest page_id is the response (rows that repeat that id are responses too). The digest is
    computed from the bytes read; a revisit's is the one its header states. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    chunks = read_archives(write_archives(chunk_rows(pages), folder), data=False)
    # a record is done at its last chunk, whose number, size and running digest give the whole payload's
    kind = F.col("record_type")
    return chunks.where("is_last").select(
        "page_id",
        F.when(kind == "revisit", F.col("length")).otherwise(F.col("chunk_no") * CHUNK + F.col("n_bytes")).alias("payload_bytes"),
        F.when(kind == "revisit", F.col("stated")).otherwise(F.col("digest")).alias("payload_digest"),
        kind.alias("record_type"),
        "refers_to",
    )


def payloads(chunks: DataFrame) -> DataFrame:
    """Payloads joined together again, for tests and small archives (it holds whole records)."""
    w = Window.partitionBy("page_id").orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return chunks.where("record_type = 'response'").withColumn("all", F.collect_list("data").over(w)).where("is_last").select("page_id", F.expr("aggregate(all, cast('' as binary), (a, x) -> concat(a, x))").alias("payload"), "digest")
