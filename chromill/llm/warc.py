"""WARC archives whose repeated payloads are revisit records."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lookup

# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EOL = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Uncompressed bytes of an archive file, about; a file is parsed by one task.
FILE_BYTES = 32 << 20
#: Bytes of payload in one Arrow batch that the reader hands on.
BATCH_BYTES = 16 << 20


def base32_sha1(data: Column) -> Column:
    """SHA-1 in bare upper-case base 32: 8 groups of 5 hexadecimal digits give 4 letters each."""
    digits = F.sha1(data)
    groups = [F.conv(F.substring(digits, 5 * g + 1, 5), 16, 10).cast("int") for g in range(8)]
    return F.concat(*[F.substring(F.lit(BASE32), (F.shiftright(g, 15 - 5 * i).bitwiseAND(F.lit(31))) + 1, F.lit(1)) for g in groups for i in range(4)])


def _record_id(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _lines(*pairs: tuple[str, Column]) -> Column:
    """Header lines; a null value leaves its line out. Line ends inside a value are percent-encoded."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(F.regexp_replace(value.cast("string"), "\r", "%0D"), "\n", "%0A"), F.lit(EOL)), F.lit("")) for name, value in pairs])


def _records(rows: DataFrame, date: str, revisit: bool) -> DataFrame:
    """The text of each record: of responses (page_id, url, digest, bytes, payload), or of revisits (page_id, url, digest, bytes, first)."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("bytes").cast("string"), F.lit(EOL + EOL))
    block = http if revisit else F.concat(http, F.col("payload"))
    refers = [
        ("WARC-Profile", F.lit(PROFILE)),
        ("WARC-Refers-To", _record_id(F.coalesce(F.col("first.page_id").cast("string"), F.lit("")), F.coalesce("first.url", F.lit("")))),
        ("WARC-Refers-To-Target-URI", F.coalesce("first.url", F.lit("urn:unknown"))),
        ("WARC-Refers-To-Date", F.lit(date)),
    ] if revisit else []
    head = _lines(
        ("WARC-Type", F.lit("revisit" if revisit else "response")),
        ("WARC-Record-ID", _record_id(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", F.coalesce("url", F.lit("urn:unknown"))),
        ("Page-ID", F.col("page_id")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        *refers,
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length(block)),
    )
    return rows.select(F.concat(F.lit(VERSION + EOL), head, F.lit(EOL), block).alias("value"))


def write_deduplicated(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes (page_id, url, html) as gzipped WARC files below path; repeated payloads become revisits.

    Headers (digest, page_id, url, bytes) are shuffled by payload digest; of equal payloads that with the smallest
    page_id (null last) is the response, and the headers of the others are joined to it and make revisit records by
    themselves. Payloads are read again for the responses, without the pages that are revisits: these are sent along
    if they are few, else payloads are shuffled by page, never by digest. A payload is the html in UTF-8, a null html is
    empty. Rows alike in page_id and payload are written alike, so repeats of the response's row are responses too.
    Spark's text writer does the writing: a record ends with two line ends, which is its line separator; so any store
    that Spark writes to will do, and retried tasks leave no half files.
    """
    payload = F.coalesce("html", F.lit(""))
    hashed = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", base32_sha1(F.col("payload"))).withColumn("bytes", F.octet_length("payload").cast("long"))
    headers = cut(hashed.select("page_id", "url", "digest", "bytes"))
    firsts = headers.groupBy("digest").agg(F.min_by(F.struct("page_id", "url"), F.struct(F.col("page_id").isNull(), "page_id", F.coalesce("url", F.lit("")))).alias("first"), F.count("*").alias("n"))
    firsts = cut(firsts.where("n > 1").select("digest", "first"))
    total, rows = headers.agg(F.sum("bytes"), F.count("*")).first()
    revisits = cut(lookup(headers, firsts, "digest", "inner").where(~F.col("page_id").eqNullSafe(F.col("first.page_id"))))
    of = revisits.select(F.col("page_id").alias("of_page"), F.col("digest").alias("of_digest")).distinct()
    responses = lookup(hashed, cut(of), F.col("page_id").eqNullSafe(F.col("of_page")) & (F.col("digest") == F.col("of_digest")), "left_anti")
    records = _records(responses, date, False).unionByName(_records(revisits, date, True))
    per_file = max(1, int(FILE_BYTES * rows / max(total or 0, 1))) if rows else 1
    records.write.option("lineSep", EOL + EOL).option("compression", "gzip").option("maxRecordsPerFile", min(per_file, 2**31 - 1)).text(path)


def _members(data: bytes) -> bytes:
    """All gzip members of a file, one after the other; a file without gzip's mark is taken as it is."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        unzip = zlib.decompressobj(31)
        out.append(unzip.decompress(data))
        data = unzip.unused_data
    return b"".join(out)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """The records of an archive file: header fields by lower-case name, and the block. Lengths come from Content-Length."""
    at, view = 0, memoryview(data)
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            raise ValueError("a WARC header without an end")
        fields = dict(line.split(": ", 1) for line in data[at:end].decode("utf-8").split("\r\n")[1:] if ": " in line)
        fields = {k.lower(): v for k, v in fields.items()}
        start, length = end + 4, int(fields["content-length"])
        if start + length > len(data):
            raise ValueError("a WARC block is cut short")
        yield fields, view[start : start + length]
        at = start + length


RECORDS = "record_type string, record_id string, page_id long, uri string, refers_to_id string, digest string, http_length long, payload_bytes long, payload_digest string, payload binary"


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives below path, as RECORDS says; payload is null without payloads.

    digest is what the header claims, payload_digest and payload_bytes are taken from the payload itself;
    a response whose payload does not have the digest of its header fails the read.
    """
    schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (f.split() for f in RECORDS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for fields, block in parse(_members(content.as_py())):
                    block = bytes(block)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = next((int(x[16:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length: ")), None)
                    own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    claimed = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                    if fields["warc-type"] == "response" and claimed != own:
                        raise ValueError(f"payload of {fields['warc-record-id']} does not have its digest")
                    page = fields.get("page-id")
                    rows.append((fields["warc-type"], fields["warc-record-id"], None if page is None else int(page), fields.get("warc-target-uri"), fields.get("warc-refers-to"), claimed, length, len(payload), own, payload if payloads else None))
                    held += len(payload) if payloads else 200
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORDS)


def resolve(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: revisits take the figures of the response they refer to.

    Revisits are joined to responses by payload digest; one that no response matches keeps the length its
    HTTP header gives. Only headers are shuffled.
    """
    records = records.select("record_type", "page_id", "digest", "http_length", "payload_bytes", "payload_digest")
    responses = records.where("record_type = 'response'")
    ranked = F.struct(F.col("page_id").isNull(), "page_id")
    originals = responses.groupBy("digest").agg(F.min_by(F.struct("page_id", "payload_bytes"), ranked).alias("first"))
    revisits = records.where("record_type = 'revisit'").join(originals, "digest", "left")
    own = responses.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return own.unionByName(revisits.select("page_id", F.coalesce("first.payload_bytes", "http_length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.col("first.page_id").alias("refers_to")))
