"""WARC archives: one gzip member a record, written by tasks into shared storage and read back in sequence."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lrforge.llm.common import as_table, bounded_batches, named, read, shared_path

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WRITE_DATE = "2000-01-01T00:00:00Z"  # constant, so that equal input gives equal archives
FILE_BYTES = 256 << 20
READ_BYTES = 1 << 16
MOST_HEAD = 1 << 20  # bytes of a record's header, which is read before anything else of it
EXACT_URL = "X-Exact-Target"
END = b"\r\n"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base 32 of the SHA-1: 40 bits are ten hex or eight base-32 digits."""
    digits = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def with_revisits(pages: DataFrame, id_col: str, payload_col: str, least_bytes: int = 0) -> DataFrame:
    """id_col and payload_col with payload_digest, payload_bytes and refers_to: of equal payloads the largest id is the response.

    Equal payloads are found on (id, digest) rows: a count and maximum a digest,
    combined before the shuffle. Payloads themselves are joined only with the rows
    that refer to another, on id and digest.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.withColumn("payload_digest", base32_sha1(payload)).withColumn("payload_bytes", F.length(payload).cast("long"))
    narrow = rows.where(F.col("payload_bytes") >= least_bytes).select(F.col(id_col).alias("_id"), F.col("payload_digest").alias("_digest"))
    first = narrow.groupBy("_digest").agg(F.max("_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = as_table(narrow.join(first, "_digest").where("_id is null or _id <> refers_to").distinct(), "warc-revisits")
    return rows.join(later, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left").drop("_id", "_digest")


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record as a gzip member. A revisit keeps the HTTP head, with the payload's length, and no payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {WRITE_DATE}",
    ]
    if url is not None:
        uri = quote(url, safe=":/?#[]@!$&()*+,;=%~-._")
        lines.append(f"WARC-Target-URI: {uri}")
        if uri != url:  # an extension field, so that a reader gets the very text back
            lines.append(f"{EXACT_URL}: {json.dumps(url)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{_digest(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(wbits=31)
    return packer.compress("\r\n".join(lines).encode() + END * 2 + block + END * 2) + packer.flush()


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes archives below folder, a URI that every executor reaches, and returns their table (path, records).

    A task writes its own files under names of their own, a new one from FILE_BYTES
    on; only files of tasks that ended well are listed, so a task that is run again
    leaves a file that nobody reads. Null payloads are empty; repeated rows are
    repeated records; a null id is written as an empty one. Ids are whole numbers of up
    to 64 bits. An empty table gives no file. Other columns are not looked at.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        out, path, size, count, listed = None, "", 0, 0, []
        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if out is None:
                    path, size, count = f"{top}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                member = record(page_id, url, (payload or "").encode("utf-8", "surrogatepass"), digest, refers_to)
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= FILE_BYTES:
                    out.close()
                    out = listed.append({"path": path, "records": count})
        if out is not None:
            out.close()
            listed.append({"path": path, "records": count})
        yield pa.RecordBatch.from_pylist(listed, pa.schema([("path", pa.string()), ("records", pa.int64())]))

    plain = pages.select(named(id_col).cast("long").alias("id"), named(url_col).alias("url"), named(payload_col).alias("payload"))
    rows = with_revisits(plain, "id", "payload", least_bytes).select("id", "url", "payload", F.col("payload_digest").alias("digest"), "refers_to")
    return as_table(bounded_batches(rows).mapInArrow(write, "path string, records long"), "warc-files")


def pieces_of(chunks: Iterator[bytes]) -> Iterator[tuple[bytes, bool]]:
    """(bytes, whether they end a gzip member) of a stream, decompressed as it comes in, at most READ_BYTES at a time."""
    unpack, begun = zlib.decompressobj(wbits=31), False
    for chunk in chunks:
        while chunk:
            data = unpack.decompress(chunk, READ_BYTES)
            while len(data) == READ_BYTES and not unpack.eof:  # there may be more of it without further input
                yield data, False
                data = unpack.decompress(unpack.unconsumed_tail, READ_BYTES)
            begun = not unpack.eof
            yield data, unpack.eof
            chunk = unpack.unconsumed_tail
            if unpack.eof:
                chunk, unpack = unpack.unused_data, zlib.decompressobj(wbits=31)
    if begun:
        raise ValueError("the archive ends within a record")


class _Record:
    """One record as its bytes come in: header first, then a block of just Content-Length bytes, then two line ends."""

    def __init__(self, payload: bool):
        self.keep, self.held, self.fields, self.left = payload, b"", None, 0
        self.block, self.payload, self.http, self.parts, self.size = hashlib.sha1(), hashlib.sha1(), b"", [], None

    def add(self, data: bytes) -> None:
        if self.fields is None:
            self.held += data
            head, found, rest = self.held.partition(END * 2)
            if not found:
                if len(self.held) > MOST_HEAD:
                    raise ValueError("a record doesn't have the framing that its header states")
                return
            version, *lines = head.decode("utf-8").split("\r\n")
            self.fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
            self.left, self.held, data = int(self.fields["content-length"]), b"", rest
            if not version.startswith("WARC/"):
                raise ValueError("a record doesn't have the framing that its header states")
        body, data = data[: self.left], data[self.left :]
        self.left -= len(body)
        self.block.update(body)
        if self.size is None:
            self.http += body
            head, found, rest = self.http.partition(END * 2)
            if found:
                sizes = [int(x.partition(b":")[2]) for x in head.split(END) if x.lower().startswith(b"content-length:")]
                if len(sizes) != 1:
                    raise ValueError("the HTTP head of a record doesn't state one length")
                self.size, self.seen, body, self.http = sizes[0], 0, rest, b""
            elif len(self.http) > MOST_HEAD:
                raise ValueError("the HTTP head of a record doesn't end")
        if self.size is not None:
            self.payload.update(body)
            self.seen += len(body)
            if self.keep:
                self.parts.append(body)
        self.held += data
        if len(self.held) > 4:
            raise ValueError("a record doesn't have the framing that its header states")

    def close(self) -> dict:
        f = self.fields
        if f is None or self.left or self.held != END * 2 or self.size is None:
            raise ValueError("a record doesn't have the framing that its header states")
        text = lambda digest: base64.b32encode(digest.digest()).decode()
        if f.get("warc-block-digest", "") != f"sha1:{text(self.block)}":
            raise ValueError(f"block digest of {f.get('warc-record-id')} doesn't match")
        response = f["warc-type"] == "response"
        if response and (f["warc-payload-digest"] != f"sha1:{text(self.payload)}" or self.size != self.seen):
            raise ValueError(f"payload digest of {f.get('warc-record-id')} doesn't match")
        number = lambda name: int(x) if (x := f.get(name, "").removeprefix("<urn:page:").removesuffix(">")) else None
        row = {
            "page_id": number("warc-record-id"), "url": json.loads(f[EXACT_URL.lower()]) if EXACT_URL.lower() in f else f.get("warc-target-uri"), "record_type": f["warc-type"], "refers_to": number("warc-refers-to"),
            "payload_bytes": self.size, "payload_digest": f["warc-payload-digest"].removeprefix("sha1:"),
        }
        return row | {"payload": b"".join(self.parts) if response else None} if self.keep else row


def records(chunks: Iterator[bytes], payload: bool = True) -> Iterator[dict]:
    """The records of an archive, one gzip member each, in sequence. Without payload, no more than READ_BYTES of a block are held."""
    one = _Record(payload)
    for data, end in pieces_of(chunks):
        one.add(data)
        if end:
            yield one.close()
            one = _Record(payload)


COLUMNS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"
ARROW = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]


def read_warc(files: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """Reads the archives of a table (path, ...), a task a file, record by record.

    Returns page_id, url, record_type, refers_to, payload_bytes, payload_digest and,
    if asked for, payload (null for revisits). A record that is cut short, framed
    wrongly or whose digests differ fails the read. A table without files gives no rows.
    """
    schema = pa.schema(ARROW + [("payload", pa.binary())] * payload)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_stream(path, compression=None) as stream:
                    rows, held = [], 0
                    for row in records(iter(lambda: stream.read(READ_BYTES), b""), payload):
                        rows.append(row)
                        held += 1000 + (len(row["payload"] or b"") if payload else 0)
                        if held >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    n = max(1, files.count())
    return files.select("path").repartition(n).mapInArrow(go, COLUMNS + ", payload binary" * payload)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "warc")
    files = write_warc(read(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return read_warc(files, folder, payload=False).drop("url").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
         array_to_string(list_transform(range(0, 32), lambda i: substr('{BASE32}', (((('0x' || substr(h, (1 + (i // 8) * 10)::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
         max(page_id) OVER (PARTITION BY html) AS last_id
  FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last_id THEN last_id END AS refers_to FROM d
"""
