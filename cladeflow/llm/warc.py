"""WARC archives: a writer through Spark's own committer, and a sequential reader.

Each record is one gzip member. The writer gives a row per member to Spark's text writer, which puts
its line separator after each row. A member ends with the high byte of the 32-bit length of its
content, which is zero below 16 MiB; so that byte is left off and the separator is the zero byte. The
files are then plain .warc.gz content, written by Spark's commit protocol to any store that it knows:
a task that is lost and run again leaves no half archive. A record of 16 MiB or more is followed by an
empty member, whose last byte is zero.

The reader feeds a file to zlib piece by piece, takes one member after the other, frames the block by
Content-Length and checks both digests.

Defined cases: a null payload is an empty one; a null url leaves out WARC-Target-URI, control
characters and blanks in it are percent-encoded; a null id leaves out the id field and is read back as
null. Of records with equal payloads (SHA-1 and length) of at least `min_bytes` the one with the
largest id is the response, the others revisit it; rows that repeat that id are responses as well,
rows without an id are revisits where any row has one, else responses. Empty tables make no archive.
A damaged record ends its archive: a row whose error says where, nothing is left out silently.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeflow.session import scratch, ship, table, trimmed

ID_FIELD = "WARC-Source-Row"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EMPTY_MEMBER = zlib.compress(b"", 1, 31)
RECORD = "source_id long, url string, record_type string, record_id string, refers_to_record string, refers_to long, payload_bytes long, payload_digest string, payload binary, archive string, offset long, error string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(row: int | None, digest: str, url: str | None = None) -> str:
    """The same for the same row in every run; the url counts only where there is no row id."""
    name = f"{'' if row is None else row}\n{digest}\n{(url or '') if row is None else ''}".encode()
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(name).digest()[:16], version=5)}>"


def safe_uri(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record_bytes(row: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A whole WARC record; a revisit keeps the HTTP head, whose length tells the payload's size."""
    digest = base32_sha1(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(row, digest, url)}", f"WARC-Date: {date}"]
    if url is not None:
        fields.append(f"WARC-Target-URI: {safe_uri(url)}")
    if refers_to is not None:
        fields += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Source-Row: {refers_to}"]
    if row is not None:
        fields.append(f"{ID_FIELD}: {row}")
    fields += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes, level: int) -> bytes:
    """The record as a gzip member that ends with a zero byte."""
    out = zlib.compress(record, level, 31)
    return out if out[-1] == 0 else out + EMPTY_MEMBER


def members(stream: io.BufferedIOBase, piece: int = 1 << 16) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of every gzip member that is not empty, decompressed piece by piece."""
    offset, rest = 0, b""
    while True:
        rest = rest or stream.read(piece)
        if not rest:
            return
        z, parts, used = zlib.decompressobj(wbits=31), [], 0
        while not z.eof:
            if not rest:
                rest = stream.read(piece)
                if not rest:
                    raise ValueError(f"member at {offset} is cut off")
            used += len(rest)
            try:
                parts.append(z.decompress(rest))
            except zlib.error as e:
                raise ValueError(f"member at {offset}: {e}") from e
            rest = b""
        rest = z.unused_data
        used -= len(rest)
        if content := b"".join(parts):
            yield offset, content
        offset += used


def parse(record: bytes) -> dict:
    """The fields and block of a record; ValueError where framing or a digest is wrong."""
    at = record.find(b"\r\n\r\n")
    if at < 0 or not record.startswith(b"WARC/1."):
        raise ValueError("no WARC head")
    fields = {}
    for line in record[:at].decode("utf-8").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        fields[k.strip().lower()] = v.strip()
    n = int(fields["content-length"])
    block, tail = record[at + 4 : at + 4 + n], record[at + 4 + n :]
    if len(block) != n or tail != b"\r\n\r\n":
        raise ValueError("Content-Length does not frame the block")
    if (want := fields.get("warc-block-digest")) and want != f"sha1:{base32_sha1(block)}":
        raise ValueError("block digest differs")
    return {"fields": fields, "block": block}


def read_archive(stream: io.BufferedIOBase) -> Iterator[dict]:
    """One dict per record; the last has an error where the archive is damaged."""
    offset = 0
    try:
        for offset, content in members(stream):
            r = parse(content)
            f, block = r["fields"], r["block"]
            kind = f["warc-type"]
            if kind not in ("response", "revisit"):
                continue
            cut = block.find(b"\r\n\r\n")
            head, body = block[:cut], block[cut + 4 :]
            size = next((int(x[15:]) for x in head.lower().split(b"\r\n") if x.startswith(b"content-length:")), len(body))
            digest = f["warc-payload-digest"].removeprefix("sha1:")
            if kind == "response" and (size != len(body) or digest != base32_sha1(body)):
                raise ValueError("payload digest or length differs")
            row, refers = f.get(ID_FIELD.lower()), f.get("warc-refers-to-source-row")
            yield {"source_id": int(row) if row else None, "url": f.get("warc-target-uri"), "record_type": kind, "record_id": f["warc-record-id"], "refers_to_record": f.get("warc-refers-to"), "refers_to": int(refers) if refers else None, "payload_bytes": size, "payload_digest": digest, "payload": body if kind == "response" else None, "offset": offset, "error": None}
    except (ValueError, KeyError) as e:
        yield {"offset": offset, "error": str(e) or repr(e)}


def mark_revisits(rows: DataFrame, min_bytes: int) -> DataFrame:
    """rows (id, url, payload) with refers_to: the id of the response that a revisit points to, else null.

    Ids are grouped by digest with map-side combining, so a payload that a third of all pages share
    costs a row a task; the join back may be split by Spark where such a digest is hot.
    """
    marked = rows.withColumn("digest", F.when(F.octet_length("payload") >= min_bytes, F.concat(F.sha1("payload"), F.lit(":"), F.octet_length("payload"))))
    repeated = marked.where("digest is not null").groupBy("digest").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "last")
    # Payloads below min_bytes stay out of the join: all of them would meet in one partition.
    joined = marked.where("digest is not null").join(repeated, "digest", "left")
    if min_bytes > 0:
        joined = joined.unionByName(marked.where("digest is null"), allowMissingColumns=True)
    other = F.col("last").isNotNull() & ~F.col("id").eqNullSafe(F.col("last"))
    return joined.select("id", "url", "payload", F.when(other, F.col("last")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", level: int = 6, archive_bytes: int = 16 << 20) -> None:
    """Write a record per row below `path`; a new archive begins after `archive_bytes`.

    Folder archive=n has the n-th archive of every task, so there are as many folders as archives of the largest task.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.encode(F.col(body_col).cast("string"), "UTF-8"), F.lit(b"")).alias("payload"))

    def compress(batches):
        number, size = 0, 0
        for b in batches:
            out, archives = [], []
            for i, url, payload, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out.append(member(record_bytes(i, url, payload, refers, date), level))
                archives.append(f"{number:06d}")
                size += len(out[-1])
                if size >= archive_bytes:
                    number, size = number + 1, 0
            yield pa.record_batch({"archive": pa.array(archives, pa.string()), "body": pa.array([m[:-1] for m in out], pa.binary())})

    packed = mark_revisits(rows, min_bytes).mapInArrow(trimmed(compress), "archive string, body binary")
    packed.select("archive", F.col("body").cast("string").alias("value")).write.partitionBy("archive").option("lineSep", "\x00").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """RECORD rows of every archive below `path`."""
    ship(spark)
    schema = pa.schema([("source_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to_record", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("archive", pa.string()), ("offset", pa.int64()), ("error", pa.string())])

    def read(batches):
        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                stream, rows, size = io.BytesIO(memoryview(content.as_buffer())), [], 0
                for r in read_archive(stream):
                    rows.append({"archive": name.as_py()} | r)
                    size += len(r.get("payload") or b"") + 200
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(trimmed(read), RECORD)


def round_trip(pages: DataFrame, min_bytes: int = 0, **options) -> DataFrame:
    """Write all rows to archives in the shared folder and read them back (RECORD)."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_archives(pages, path, min_bytes=min_bytes, **options)
    return read_archives(spark, path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every page written to WARC archives and read back."""
    records = round_trip(table(spark, sf_dir, "pages"), min_bytes=0)
    bad = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("damaged archive: "), F.col("archive"), F.lit(" "), F.col("error")))).otherwise(F.col("record_type"))
    return records.select(F.col("source_id").alias("page_id"), "payload_bytes", "payload_digest", bad.cast("string").alias("record_type"), "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT *, max(page_id) OVER (PARTITION BY h, payload_bytes) AS last FROM p
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT) >> (15 - 5 * (i % 4))) & 31)::BIGINT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM d
"""
