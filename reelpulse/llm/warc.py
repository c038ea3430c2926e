"""WARC archives: a writer with payload deduplication and a sequential reader.

Every record is one gzip member, so a reader can start at any member and a damaged one costs one record.
Tasks write one archive each into a shared folder, through the file system of the folder's URI; a file's name
holds a random part, so a retried or speculative task never writes over another's file, and only the files of
tasks that succeeded are in the manifest.  The reader takes compressed blocks of fixed size, inflates them
incrementally, frames each record by its Content-Length and checks both digests.  A task holds one record
and one block, whatever the size of the archive.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, saved, scratch_path, text_of

VERSION, CRLF = b"WARC/1.1", b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"           # pages carry no capture time
MIN_PAYLOAD = 100                       # smaller payloads are never revisits
SALTS = 8
READ_BLOCK = 1 << 18
_IDS = uuid.UUID("6b0f2f52-9c58-5d0e-8a35-0c3c5a3d7f11")

RECORD_SCHEMA = ("page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, "
                 "payload_digest string, payload binary")


class DamagedRecord(ValueError):
    """A record whose framing or digest does not hold."""


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_IDS, str(page_id))}>"


def _value(text: str) -> str:
    """A header value on one line: control characters become percent codes."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def pack(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int,
         refers_to: int | None) -> bytes:
    """One compressed record; ``payload`` is left out of a revisit."""
    revisit = refers_to is not None
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n").encode()
    block += b"" if revisit else payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)),
            ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", _value(url)))
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)),
                 ("X-Refers-To-Page-ID", str(refers_to))]
    head += [("WARC-Payload-Digest", f"sha256:{digest}"),
             ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"),
             ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in head), b"", b""]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(CRLF.join(lines) + block + CRLF + CRLF) + squeeze.flush()


def members(stream, read_block: int = READ_BLOCK) -> Iterator[bytes]:
    """The inflated gzip members of a stream, one after another."""
    left = b""
    while True:
        inflate, out = zlib.decompressobj(31), bytearray()
        while not inflate.eof:
            left = left or stream.read(read_block)
            if not left:
                if out or inflate.unconsumed_tail:
                    raise DamagedRecord("the archive ends inside a record")
                return
            try:
                out += inflate.decompress(left)
            except zlib.error as e:
                raise DamagedRecord(str(e)) from e
            left = inflate.unused_data
        yield bytes(out)


def _headers(block: bytes, start: int) -> tuple[str, dict[str, str], int]:
    end = block.find(CRLF + CRLF, start)
    if end < 0:
        raise DamagedRecord("headers do not end")
    first, *lines = block[start:end].decode("utf-8").split("\r\n")
    return first, {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}, end + 4


def unpack(member: bytes) -> dict:
    """A record's fields; raises :class:`DamagedRecord` if its framing or a digest is wrong."""
    version, head, at = _headers(member, 0)
    size = int(head.get("content-length", -1))
    block, rest = member[at:at + size], member[at + size:]
    if version.encode() != VERSION or size < 0 or len(block) != size or rest != CRLF + CRLF:
        raise DamagedRecord("the record is not framed by its Content-Length")
    if head.get("warc-block-digest") != f"sha1:{hashlib.sha1(block).hexdigest()}":
        raise DamagedRecord("the block digest does not match")
    _, http, at = _headers(block, 0)
    digest, payload = head["warc-payload-digest"].removeprefix("sha256:"), block[at:]
    if head["warc-type"] == "response" and (hashlib.sha256(payload).hexdigest() != digest
                                            or len(payload) != int(http["content-length"])):
        raise DamagedRecord("the payload digest does not match")
    page, refers = head.get("x-page-id"), head.get("x-refers-to-page-id")
    return {"page_id": int(page) if page else None, "url": head.get("warc-target-uri"),
            "record_type": head["warc-type"], "refers_to": int(refers) if refers else None,
            "payload_bytes": int(http["content-length"]), "payload_digest": digest,
            "payload": payload if head["warc-type"] == "response" else None}


def plan_records(pages: DataFrame) -> DataFrame:
    """Rows to write: page_id, url, payload (null for revisits), digest, size, refers_to.

    Of equal payloads of at least MIN_PAYLOAD bytes those with the smallest page_id are responses, the rest
    refer to it.  Rows with a null page_id refer too when a row with an id has the payload, and are responses
    otherwise.  A null html is the empty payload.  Hot payloads are joined over SALTS salts.
    """
    rows = (pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         text_of("html").alias("payload"))
            .withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
            .withColumn("size", F.octet_length("payload").cast("long")))
    first = (rows.filter(F.col("size") >= MIN_PAYLOAD).groupBy("digest")
             .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
             .select("digest", "first_id", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt")))
    joined = (rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
              .join(first, ["digest", "salt"], "left"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return (joined.withColumn("refers_to", refers)
            .select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"),
                    "digest", "size", "refers_to"))


def _opened(uri: str):
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def write(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write one archive per task into ``folder`` (a new one in the shared folder by default); returns the
    manifest (archive, records), already materialised.  An empty table gives an empty manifest."""
    folder = folder or scratch_path(pages.sparkSession, "warc")

    def run(batches):
        store, path = _opened(folder)
        name, out, n = f"{path}/{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for part in (p for b in batches for p in rows_of([b])):
                if out is None:
                    store.create_dir(path, recursive=True)
                    out = store.open_output_stream(name)
                for row in part.to_pylist():
                    payload = row["payload"].encode("utf-8") if row["payload"] is not None else None
                    out.write(pack(row["page_id"], row["url"], payload, row["digest"], row["size"], row["refers_to"]))
                    n += 1
        finally:
            if out is not None:
                out.close()
        if n:
            yield pa.RecordBatch.from_pydict({"archive": [name], "records": pa.array([n], pa.int64())})

    return saved(plan_records(pages).mapInArrow(run, "archive string, records bigint"))


def read(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """All records of the archives in a manifest, RECORD_SCHEMA; payloads are null for revisits and, if not
    asked for, for all.  Raises if an archive does not hold as many records as its manifest row says."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                        ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("payload", pa.binary())])

    def run(batches):
        store, _ = _opened(folder)
        for batch in batches:
            for row in batch.to_pylist():
                held, size, n = [], 0, 0
                with store.open_input_stream(row["archive"]) as stream:
                    for record in map(unpack, members(stream)):
                        if not payloads:
                            record["payload"] = None
                        held.append(record)
                        n, size = n + 1, size + len(record["payload"] or b"") + 200
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)
                if n != row["records"]:
                    raise DamagedRecord(f"{row['archive']} holds {n} records instead of {row['records']}")

    return manifest.mapInArrow(run, RECORD_SCHEMA)
