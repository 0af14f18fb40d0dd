"""Operator 4: WARC archives, and the normaliser for those that came as one gzip stream.

A monolithic archive can only be read from its start. The normaliser inflates it once, writes every record again as a gzip
member of its own, and beside it an index of offsets, after which any record can be read alone."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagflow.llm.common import own, prepared, removed_from, shared_dir, stored, table

#: Uncompressed bytes after which a task begins its next archive, bytes read at once, and gzip's level.
ARCHIVE_BYTES, READ_BYTES, LEVEL = 256 << 20, 1 << 20, 5
#: Bytes of archives that make a task.
TASK_BYTES = 32 << 20
#: Copies (36 bytes each) whose list may be sent to every task; a longer one is joined, with the same records.
SENT_COPIES = 100_000
DATE = "2024-01-01T00:00:00Z"

MANIFEST = "path string, records bigint, bytes bigint"
NORMALISED = "path string, index string, records bigint, bytes bigint"
RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, archive string, offset bigint, length bigint"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder, from an executor as well as from the driver."""
    return fs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def name_of(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def id_of(name: str | None) -> int | None:
    value = (name or "").strip("<>").rpartition(":")[2]
    return int(value) if value.lstrip("-").isdigit() else None


def record(page_id, url, kind: str, refers_to, digest: str, size: int, payload: bytes) -> bytes:
    """A response, or a revisit, which has the HTTP header of the full payload but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = [("WARC-Type", kind), ("WARC-Record-ID", name_of(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    head.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if kind == "revisit":
        head += [("WARC-Refers-To", name_of(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(http) + len(payload)))]
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + http + payload + b"\r\n\r\n"


def inflated(stream) -> Iterator[bytes]:
    """The bytes of a gzip file in pieces, read once from its start, whatever its number of members."""
    inflate = zlib.decompressobj(31)
    while piece := stream.read(READ_BYTES):
        while piece:
            yield inflate.decompress(piece)
            piece = inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(31)
            else:
                break
    yield inflate.flush()


def headers(block: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in block.decode("utf-8", "replace").split("\r\n")[1:] if line)}


def split_records(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and whole bytes of every record of a WARC stream; no more than one record and one piece is held."""
    held = bytearray()
    pieces = iter(pieces)
    need = 0

    def fill() -> bool:
        piece = next(pieces, None)
        if piece is None:
            return False
        held.extend(piece)
        return True

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not fill():
                if held.strip():
                    raise ValueError("the archive ends inside a record's header")
                return
        head = headers(bytes(held[:end]))
        need = end + 4 + int(head["content-length"]) + 4
        while len(held) < need:
            if not fill():
                raise ValueError("the archive ends inside a record")
        yield head, bytes(held[:need])
        del held[:need]


def parsed(head: dict[str, str], whole: bytes) -> dict:
    """The columns of a record; size and digest of a revisit are those it states of the full payload."""
    block = whole[whole.index(b"\r\n\r\n") + 4 : -4]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = head["warc-type"]
    full = kind == "response"
    return {
        "page_id": id_of(head["warc-record-id"]),
        "payload_bytes": len(payload) if full else int(headers(http)["content-length"]),
        "payload_digest": base32(hashlib.sha1(payload).digest()) if full else head["warc-payload-digest"].partition(":")[2],
        "record_type": kind,
        "refers_to": id_of(head.get("warc-refers-to")),
        "url": head.get("warc-target-uri"),
    }


def _writer(folder: str) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, path = opened(folder)
        store.create_dir(path, recursive=True)
        out = stream = None
        done: list[tuple] = []
        raw = records = 0
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(batch.num_columns)), strict=True):
                page_id, url, kind, refers_to, digest, size, payload = (x.as_py() for x in row)
                if out is None:
                    # a name of the attempt's own: a task that is run again never touches what another has written
                    name = f"{path}/{task.partitionId():06d}-{task.taskAttemptId()}-{len(done)}.warc.gz"
                    stream, out, raw, records = store.open_output_stream(name, compression=None), zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0
                data = record(page_id, url, kind, refers_to, base32(bytes.fromhex(digest)), size, payload or b"")
                stream.write(out.compress(data))
                raw, records = raw + len(data), records + 1
                if raw >= ARCHIVE_BYTES:
                    stream.write(out.flush())
                    stream.close()
                    done.append((name, records, raw))
                    out = None
        if out is not None:
            stream.write(out.flush())
            stream.close()
            done.append((name, records, raw))
        root = folder[: -len(path)] if folder.endswith(path) else ""
        yield pa.RecordBatch.from_arrays([pa.array([root + d[0] for d in done], pa.string()), *(pa.array([d[i] for d in done], pa.int64()) for i in (1, 2))], ["path", "records", "bytes"])

    return write


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    attempt = TaskContext.get().taskAttemptId()
    for batch in batches:
        for uri in batch.column("path").to_pylist():
            store, path = opened(uri)
            to = path.replace(".warc.gz", f".{attempt}.members.warc.gz")
            index = to.replace(".warc.gz", ".index.jsonl")
            at = records = 0
            with store.open_input_stream(path, compression=None) as source, store.open_output_stream(to, compression=None) as out, store.open_output_stream(index, compression=None) as side:
                for head, whole in split_records(inflated(source)):
                    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    member = squeeze.compress(whole) + squeeze.flush()
                    out.write(member)
                    side.write(json.dumps({"offset": at, "length": len(member), "id": head["warc-record-id"], "type": head["warc-type"], "uri": head.get("warc-target-uri")}).encode() + b"\n")
                    at, records = at + len(member), records + 1
            root = uri[: -len(path)] if uri.endswith(path) else ""
            yield pa.RecordBatch.from_pylist([{"path": root + to, "index": root + index, "records": records, "bytes": at}], schema=pa.schema([("path", pa.string()), ("index", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))


_RECORD_SCHEMA = pa.schema([(n, pa.int64() if n in ("page_id", "payload_bytes", "refers_to", "offset", "length") else pa.string()) for n in (x.split()[0] for x in RECORDS.split(", "))])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, index in zip(batch.column("path").to_pylist(), batch.column("index").to_pylist(), strict=True):
            store, path = opened(uri)
            rows: list[dict] = []
            with store.open_input_file(path) as archive, store.open_input_stream(opened(index)[1], compression=None) as side:
                for line in _lines(side):
                    entry = json.loads(line)
                    whole = zlib.decompress(archive.read_at(entry["length"], entry["offset"]), 31)
                    head = headers(whole[: whole.index(b"\r\n\r\n")])
                    rows.append(parsed(head, whole) | {"archive": uri, "offset": entry["offset"], "length": entry["length"]})
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema=_RECORD_SCHEMA)
                        rows = []
            yield pa.RecordBatch.from_pylist(rows, schema=_RECORD_SCHEMA)


def _lines(stream) -> Iterator[bytes]:
    held = b""
    while piece := stream.read(READ_BYTES):
        *whole, held = (held + piece).split(b"\n")
        yield from whole


def record_plan(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", sent: int = SENT_COPIES) -> DataFrame:
    """Every page with its record's type. Only digests and ids are grouped, and a digest's copies are counted before the
    shuffle, so a payload that a third of all pages share costs one row per task. The list of copies then meets the pages: it is
    sent to where they are read if it is small; else both are dealt by (page_id, digest), which spreads the copies."""
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    base = own(pages, page_id=F.col(key).cast("long"), url=url, payload=body).withColumn("digest", F.sha1("payload"))
    first = base.select("page_id", "digest").groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = base.select("page_id", "digest").join(first, "digest").where("first_id is not null and (page_id is null or page_id <> first_id)")
    later = stored(later.select(F.col("page_id").alias("later_id"), F.unhex("digest").alias("later_digest"), "first_id").distinct())
    copies = F.broadcast(later) if later.count() <= sent else later
    met = base.join(copies, F.col("page_id").eqNullSafe(F.col("later_id")) & (F.unhex("digest") == F.col("later_digest")), "left")
    again = F.col("first_id").isNotNull()
    return met.select(
        "page_id", "url", F.when(again, "revisit").otherwise("response").alias("kind"), F.col("first_id").alias("refers_to"), "digest",
        F.octet_length("payload").cast("long").alias("size"), F.when(~again, F.col("payload")).alias("payload"),
    )


def write_archives(plan: DataFrame, folder: str) -> DataFrame:
    """Writes monolithic .warc.gz files; the manifest of those that count is written to the shared folder, so that files of lost
    attempts are never read."""
    return stored(plan.mapInArrow(_writer(folder), MANIFEST))


def dealt_out(manifest: DataFrame) -> DataFrame:
    """Archives over tasks: one to a task if they are large, several if they are small."""
    seen = manifest.agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).first()
    tasks = max(2 * manifest.sparkSession.sparkContext.defaultParallelism, -(-(seen["bytes"] or 0) // TASK_BYTES))
    return manifest.repartition(max(1, min(seen["n"], tasks)))


def normalise_archives(manifest: DataFrame) -> DataFrame:
    """One gzip member per record and a sidecar index for each archive. A task streams its archives: it holds one record."""
    return stored(dealt_out(manifest).mapInArrow(_normalise, NORMALISED))


def read_archives(normalised: DataFrame) -> DataFrame:
    """Every record of the archives, read by its place in the sidecar index."""
    return dealt_out(normalised).mapInArrow(_read, RECORDS)


def archived(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Pages written as WARC, normalised, and read back: one row per page.

    Null html is an empty payload. Of equal payloads the page with the smallest id is the response (all rows of that id, if
    it is repeated), the others revisit it; a null id revisits, and where a payload has null ids only, all are responses.
    A null url writes no target. An empty table gives no rows. Further columns are ignored."""
    spark = prepared(pages.sparkSession)
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    return read_archives(normalise_archives(write_archives(record_plan(pages, key, url, html), folder)))


def op4_warc(spark, sf_dir):
    return archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The bare upper-case base32 of a SHA-1: 32 groups of five bits.
BASE32_SQL = """list_aggregate(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + list_sum(list_transform(range(0, 5), lambda j:
        cast(substr(bits, cast(i * 5 + j + 1 as bigint), 1) as integer) * cast(pow(2, 4 - j) as integer))) as bigint), 1)), 'string_agg', '')"""

ORACLE = f"""
with p as (select page_id, coalesce(html, '') as body from pages),
d as (select page_id, cast(strlen(body) as bigint) as payload_bytes, sha1(body) as hex,
        cast(cast(unhex(sha1(body)) as bit) as varchar) as bits, min(page_id) over (partition by sha1(body)) as first_id from p)
select page_id, payload_bytes, {BASE32_SQL} as payload_digest,
    case when page_id = first_id then 'response' else 'revisit' end as record_type,
    case when page_id = first_id then null else first_id end as refers_to
from d
"""
