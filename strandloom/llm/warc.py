"""WARC archives: writing records, reading them back, and resolving repeated payloads to revisit records.

Archives are written and read through Spark's own writers and readers, so they can be in any shared store and a task that
is lost leaves nothing behind. Each record is a gzip member of its own. The text writer ends each row with a NUL, which
is the last byte of a member below 16 MiB (the upper byte of its length); so a row is a member without that byte.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import bounded_batches
from strandloom.operators.joins import heavy_split_join
from strandloom.session import materialize, new_path, remove, scratch

#: Compressed bytes from which on an archive file is full (one record more, at most): bounds what a task holds of one file.
ARCHIVE_BYTES = 64 << 20
#: Revisits whose decisions are sent to the workers at once (some 30 bytes each); more files are written in further jobs.
REVISITS_AT_ONCE = 1_000_000
MEMBER_BYTES, LEVEL = 15 << 20, 4
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

HEADS = "path string, nth long, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def payload_digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, salt: str) -> str:
    h = hashlib.md5(f"{salt}:{page_id}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _line(text: str) -> str:
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unline(text: str) -> str:
    return text.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(page_id: int | None, url: str | None, payload: bytes | None, n_bytes: int, digest: str, refers_to: int | None = None, salt: str = "raw") -> bytes:
    """A response record, or without ``payload`` a revisit of the record of page ``refers_to``."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode() + (payload or b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if payload is None else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, salt)}",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if page_id is not None:
        head.append(f"Page-Id: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if payload is None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, salt)}"]
        if refers_to is not None:
            head.append(f"Refers-To-Page-Id: {refers_to}")
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


def gzip_row(data: bytes, level: int = LEVEL) -> bytes:
    """The gzip members of a record without the final NUL."""
    out = b""
    for at in range(0, len(data), MEMBER_BYTES):
        c = zlib.compressobj(level, zlib.DEFLATED, 31)
        out += c.compress(data[at : at + MEMBER_BYTES]) + c.flush()
    return out[:-1]


def members(content: bytes) -> Iterator[bytes]:
    """The decompressed members of a file."""
    view, at = memoryview(content), 0
    while at < len(view):
        d, parts = zlib.decompressobj(31), []
        while not d.eof:
            if at >= len(view):
                raise ValueError("a record is cut short")
            part = view[at : at + 16384]
            parts.append(d.decompress(part))
            at += len(part) - len(d.unused_data)
        yield b"".join(parts)


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, HTTP head, payload) of each record of an archive file."""
    held = b""
    for part in members(content):
        held = held + part if held else part
        cut = held.index(b"\r\n\r\n")
        head = dict(x.split(": ", 1) for x in held[:cut].decode().split("\r\n")[1:])
        begin, size = cut + 4, int(head["Content-Length"])
        if len(held) < begin + size + 4:
            continue
        http = held.index(b"\r\n\r\n", begin) + 4
        yield head, held[begin:http], held[http : begin + size]
        held = b""
    if held:
        raise ValueError("a record is cut short")


def payload_size(http: bytes) -> int:
    """Bytes of the payload that an HTTP head announces; a revisit has the head alone."""
    return int(http.split(b"Content-Length: ", 1)[1].split(b"\r\n", 1)[0])


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def archives(rows: Iterator[bytes], archive_bytes: int = ARCHIVE_BYTES) -> Iterator[pa.RecordBatch]:
    """The members of many records (each without its final NUL) as few large rows, each one archive file."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row) + 1
        if size >= archive_bytes:
            yield pa.RecordBatch.from_arrays([pa.array([b"\x00".join(held)], pa.binary())], names=["row"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([b"\x00".join(held)], pa.binary())], names=["row"])


def write_rows(rows: DataFrame, path: str) -> None:
    """Write rows of gzip members (column ``row``, binary), each as an archive file below ``path``."""
    rows.selectExpr("cast(`row` as string) as value").write.mode("append").option("lineSep", "\x00").option("maxRecordsPerFile", 1).text(path)


def write_responses(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write each row (page_id, url, html) as a response record."""

    def members_of(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for b in batches:
            for page_id, url, html in zip(*b.columns, strict=True):
                payload = (html.as_py() or "").encode()
                yield gzip_row(record(page_id.as_py(), url.as_py(), payload, len(payload), payload_digest(payload)))

    rows = pages.selectExpr("cast(page_id as long) as page_id", "url", "html")
    write_rows(rows.mapInArrow(lambda batches: archives(members_of(batches), archive_bytes), "row binary"), path)


def _files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_heads(spark: SparkSession, path: str) -> DataFrame:
    """A row of headers for each record below ``path``; a payload that doesn't have its digest is an error. Only headers are
    shuffled by what follows; contents stay in the task that reads them."""
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = []
                for k, (head, http, payload) in enumerate(records(content.as_py())):
                    digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                    if kind == "response" and payload_digest(payload) != digest:
                        raise ValueError(f"{name}: the payload of record {k} doesn't have its digest")
                    url = head.get("WARC-Target-URI")
                    rows.append((name, k, _number(head.get("Page-Id")), None if url is None else _unline(url), kind, payload_size(http), digest, _number(head.get("Refers-To-Page-Id"))))
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in HEADS.split(", ")])

    return _files(spark, path).mapInArrow(run, HEADS)


def write_deduplicated(spark: SparkSession, source: str, revisits: DataFrame, target: str, archive_bytes: int = ARCHIVE_BYTES, at_once: int = REVISITS_AT_ONCE) -> None:
    """Write the archives below ``source`` again with fresh headers: the records in ``revisits`` without a payload.

    ``revisits`` has (path, nth, refers_to). They are sent to the files, never contents to them: gathered by file and
    broadcast, so many files at once as have ``at_once`` revisits (or one file, whose records are bounded by its bytes).
    What the driver lists are files.
    """
    counts = revisits.groupBy("path").agg(F.count("*").alias("n")).collect()
    n_of, chunks, room = {r["path"]: r["n"] for r in counts}, [], 0
    for name in sorted(r["path"] for r in _files(spark, source).select("path").collect()):
        room -= n_of.get(name, 0)
        if room < 0 or not chunks:
            chunks.append([])
            room = at_once - n_of.get(name, 0)
        chunks[-1].append(name)
    plan = spark.createDataFrame([(name, k) for k, names in enumerate(chunks) for name in names if name in n_of], "path string, chunk int")
    by_file = revisits.join(F.broadcast(plan), "path").groupBy("chunk", "path").agg(F.collect_list(F.struct("nth", "refers_to")).alias("told"))
    by_file = materialize(by_file, "warc-told")

    def members_of(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for b in batches:
            for content, told in zip(b.column(0), b.column(1), strict=True):
                refers = {t["nth"]: t["refers_to"] for t in told.as_py() or ()}
                for k, (head, http, payload) in enumerate(records(content.as_py())):
                    url, digest = head.get("WARC-Target-URI"), head["WARC-Payload-Digest"].removeprefix("sha1:")
                    yield gzip_row(record(_number(head.get("Page-Id")), None if url is None else _unline(url), None if k in refers else payload, payload_size(http), digest, refers.get(k), "deduplicated"))

    if not chunks:
        write_rows(spark.createDataFrame([], "row binary"), target)
    for k, names in enumerate(chunks):
        told = F.broadcast(by_file.where(F.col("chunk") == k).select("path", "told"))
        rows = _files(spark, names).join(told, "path", "left").select("content", "told")
        write_rows(rows.mapInArrow(lambda batches: archives(members_of(batches), archive_bytes), "row binary"), target)


def resolve_revisits(spark: SparkSession, source: str, target: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, at_once: int = REVISITS_AT_ONCE) -> DataFrame:
    """Resolve the records below ``source`` and write deduplicated archives below ``target``; the heads of those.

    Headers are shuffled by payload digest. Of the responses with equal payloads of at least ``min_bytes`` that with the
    largest page_id (ties: the later place) stays a response, with its payload, and the others become revisits of it. Revisit
    records of the source are joined to that response as well, by their digest, and refer to it from then on; where the
    source has no response with their digest they stay as they are. The winners are found by a partial maximum, and digests
    that many records share are joined by a table of bounded size, so none is gathered in a task. A record whose compressed
    members exceed 2 GB, which no Spark row holds, fails.
    """
    with scratch(spark):
        heads = materialize(read_heads(spark, source).drop("url"), "warc-heads")
        place, response = F.struct("page_id", "path", "nth"), F.col("record_type") == "response"
        best = heads.groupBy("payload_digest").agg(F.max(F.when(response, place)).alias("best"), F.count("*").alias("n"))
        best = materialize(best.where("n > 1 and best is not null"), "warc-originals")
        joined = heavy_split_join(heads, best, "payload_digest", "n", heads.count())
        loses = response & F.col("best").isNotNull() & (F.col("payload_bytes") >= min_bytes) & ~F.col("best").eqNullSafe(place)
        refers = F.when(F.col("best").isNotNull(), F.col("best.page_id")).otherwise(F.col("refers_to"))
        revisits = materialize(joined.where(~response | loses).select("path", "nth", refers.alias("refers_to")), "warc-revisits")
        write_deduplicated(spark, source, revisits, target, archive_bytes, at_once)
    return read_heads(spark, target)


def deduplicate_pages(pages: DataFrame, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives, resolve revisits, and return the heads of the final archives.

    A null html counts as an empty payload; a null page_id is smaller than any other; rows with equal page_id are records
    of their own; an empty table gives an empty result; other columns are left out. The final archives, which the result
    reads, stay in the shared folder; the first ones are removed.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    raw, final = new_path(spark, "warc-raw"), new_path(spark, "warc-final")
    write_responses(pages, raw, archive_bytes)
    heads = resolve_revisits(spark, raw, final, min_bytes, archive_bytes)
    remove(spark, raw)
    return heads.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
