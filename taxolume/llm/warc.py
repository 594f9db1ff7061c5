"""WARC archives: writing captures, reading records, assembling transactions.

A capture is three records: a request and a metadata record, each concurrent to the main one, which is a response or,
for a payload that another response holds, a revisit. Archives are written by Spark's text writer, a file for each row,
which holds whole transactions up to a number of bytes, gzipped, into the folder that all executors share; they are read
back as binary files, inflated and parsed as streams by their records' lengths, so payloads may hold anything.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolume.storage import Scratch, delete, join_hot, multiplied, shared_dir

#: Payloads of fewer bytes are always stored.
LEAST_REVISIT = 1000
#: Bytes of an archive before compression, about, unless one capture has more.
FILE_BYTES = 16 << 20
#: Bytes of repeated payloads' digests and urls up to which they are broadcast; beyond, the join shuffles.
BROADCAST_BYTES = 16 << 20
#: Fixed value: the date that records bear unless the caller gives one.
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "id string, type string, concurrent_to string, refers_to string, uri string, page long, has_page boolean, payload_bytes long, payload_digest string, payload binary"


def _id(kind: str, digest: Column, page: str = "page", url: str = "url") -> Column:
    h = F.md5(F.concat_ws(":", F.lit(kind), F.coalesce(F.col(page).cast("string"), F.lit("null")), F.coalesce(F.col(url), F.lit("null")), digest))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(kind: str, id_: Column, fields: list[tuple[str, Column]], block: Column, end: str = "\r\n\r\n") -> Column:
    lines = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: "), id_, F.lit("\r\n")]
    for name, value in fields:  # a null field is left out
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")))
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block, F.lit(end))


def transactions(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", date: str = DATE, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """(value): each row of pages as the text of its three records, without the last CRLF.

    Of rows with equal payloads of at least `least_revisit` bytes the largest key's is a response, with all rows that
    repeat that key; the others are revisits of it. A null payload is empty; a null url has no target; line breaks in
    a url are percent-encoded. Null and repeated keys are kept, an empty table gives no rows, other columns are ignored.
    """
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("page"), F.regexp_replace(F.regexp_replace(F.col(f"`{url}`"), "\r", "%0D"), "\n", "%0A").alias("url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.col("payload").cast("binary"))).withColumn("bytes", F.octet_length("payload").cast("long"))
    large = rows.filter(F.col("bytes") >= least_revisit)
    first = large.groupBy("digest").agg(F.max(F.struct("page", "url")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    first = Scratch(pages.sparkSession, "digests").put(first)
    few = (first.agg(F.sum(F.octet_length("first.url") + 64)).first()[0] or 0) <= BROADCAST_BYTES
    # Smaller payloads have no digest in common with these; they pass through the same join.
    judged = rows.join(F.broadcast(first), "digest", "left") if few else join_hot(rows, first, "digest", F.xxhash64("page", "url"), how="left")
    every = judged.withColumn("revisit", F.col("first").isNotNull() & ~F.col("first.page").eqNullSafe(F.col("page")))
    main = _id("main", F.col("digest"))
    refers = _id("main", F.col("digest"), "first.page", "first.url")
    host = F.coalesce(F.regexp_extract("url", r"^(?s:.*?)://([^/?#]*)", 1), F.lit(""))
    target = F.coalesce(F.nullif(F.regexp_extract("url", r"^(?s:.*?)://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/"))
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url"))]
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    seen = [*common, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), ("Content-Type", F.lit("application/http;msgtype=response"))]
    response = _record("response", main, seen, F.concat(http, F.col("payload")))
    revisit = _record("revisit", main, [*seen, ("WARC-Refers-To", refers), ("WARC-Profile", F.lit(PROFILE))], http)
    request = _record("request", _id("request", F.col("digest")), [*common, ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/http;msgtype=request"))], F.concat(F.lit("GET "), target, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n")))
    about = _record("metadata", _id("metadata", F.col("digest")), [*common, ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/warc-fields"))], F.coalesce(F.concat(F.lit("pageId: "), F.col("page").cast("string"), F.lit("\r\n")), F.lit("")), end="\r\n")
    whole = F.concat(request, F.when(F.col("revisit"), revisit).otherwise(response), about)
    return every.select(whole.alias("value"))


def _filled(most: int):
    """Rows of whole transactions joined by CRLF, of about `most` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for value in batch.column(0):
                own = value.as_py()
                if rows and held + len(own) > most:
                    yield pa.RecordBatch.from_arrays([pa.array(["\r\n".join(rows)])], ["value"])
                    rows, held = [], 0
                rows.append(own)
                held += len(own)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(["\r\n".join(rows)])], ["value"])

    return run


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES, **how) -> None:
    """Gzipped WARC files of all rows of pages in `folder`, of about file_bytes each before compression."""
    files = transactions(pages, **how).mapInArrow(_filled(file_bytes), "value string")
    files.write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", 1).mode("overwrite").text(folder)


def _plain(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """An archive's bytes some at a time: gzipped as a whole, by record, or not at all."""
    if data[:2] != b"\x1f\x8b":
        for at in range(0, len(data), step):
            yield data[at : at + step]
        return
    while data:
        d = zlib.decompressobj(31)
        while not d.eof:
            part = d.decompress(data, step)
            data = d.unconsumed_tail
            if part:
                yield part
            elif not data and not d.eof:
                raise ValueError("an archive that ends within its compressed data")
        data = d.unused_data


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of an archive, one record held at a time. Bytes that are no record, or end
    within one, raise ValueError once the records before them are told."""
    parts, held, at = _plain(data), bytearray(), 0

    def more() -> bool:
        nonlocal at
        try:
            part = next(parts, None)
        except zlib.error as e:
            raise ValueError(f"not gzip: {e}") from e
        del held[:at]
        at = 0
        held.extend(part or b"")
        return part is not None

    while True:
        while held.startswith(b"\r\n", at):
            at += 2
        if len(held) < at + 5:
            if more():
                continue
            if held.strip():
                raise ValueError("bytes after the last record")
            return
        if not held.startswith(b"WARC/", at):
            raise ValueError("no WARC record")
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            if not more():
                raise ValueError("a record without an end of its header")
        fields = {}
        for line in bytes(held[at:end]).split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
        head, size = end + 4 - at, int(fields.get("content-length", "none"))
        while len(held) < at + head + size:
            if not more():
                raise ValueError("a record that is cut off")
        yield fields, bytes(held[at + head : at + head + size])
        at += head + size


def _told(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """As parse, but what is wrong with an archive is a record of type malformed, its last."""
    try:
        yield from parse(data)
    except ValueError as e:
        yield {"warc-type": "malformed", "warc-target-uri": str(e)}, b""


def _rows(keep_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = [pa.string()] * 5 + [pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.binary()]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for f, block in _told(content.as_py()):
                    kind = f.get("warc-type", "")
                    payload, size, digest, page, has = None, None, None, None, False
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                    elif kind == "metadata":
                        has = True
                        for line in block.split(b"\r\n"):
                            if line.startswith(b"pageId:") and line[7:].strip().lstrip(b"-").isdigit():
                                page = int(line[7:])
                    rows.append((f.get("warc-record-id"), kind, f.get("warc-concurrent-to"), f.get("warc-refers-to"), f.get("warc-target-uri"), page, has, size, digest, payload if keep_payload else None))
                    held += len(payload) if keep_payload and payload else 100
                    if held > 4 << 20:
                        yield out(rows)
                        rows, held = [], 0
                if rows:
                    yield out(rows)

    return run


def read_records(spark: SparkSession, folder: str, keep_payload: bool = False) -> DataFrame:
    """The records of all archives in a folder; only responses have a payload, whose size and digest are taken here. Of
    a malformed archive come the records before the fault, and one of type malformed whose uri says what is wrong."""
    files = spark.read.format("binaryFile").load(folder).select("content")
    return files.mapInArrow(_rows(keep_payload), RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One row a capture: capture (the main record's id), page, request, response, metadata, refers_to_page.

    Records are joined through the id that they are concurrent to. response has type, uri, payload_bytes,
    payload_digest and payload, for a revisit those of the response that it refers to, null if that is missing. Main
    records with one id, from repeated rows, give a row each; a capture without a main record gives none, one without a
    request or metadata record has nulls there. Records that are concurrent to nothing, or malformed, are left out.
    """
    store = Scratch(records.sparkSession, "records")
    records = store.put(records)
    main = F.col("type").isin("response", "revisit")
    same = ["id", "type", "uri", "refers_to", "payload_digest"]
    mains = records.filter(main).groupBy(*same).agg(F.first("payload_bytes").alias("payload_bytes"), F.first("payload").alias("payload"), F.count("*").alias("n"))
    about = records.filter(F.col("type").isin("request", "metadata")).groupBy(F.col("concurrent_to").alias("id")).agg(
        F.max(F.when(F.col("type") == "request", F.struct("id", "uri"))).alias("request"),
        F.max(F.when(F.col("type") == "metadata", F.struct("id", "page"))).alias("metadata"),
    )
    each = mains.join(about, "id", "left")
    body = F.struct("type", "uri", "refers_to", "payload_bytes", "payload_digest", "payload")
    fresh = each.filter("type = 'response'").select(F.col("id").alias("capture"), "request", "metadata", body.alias("response"), F.lit(None).cast("long").alias("refers_to_page"), "n")
    held = each.filter("type = 'response'").groupBy(F.col("id").alias("refers_to")).agg(F.first(F.struct(F.col("metadata.page").alias("page"), "payload_bytes", "payload_digest", "payload")).alias("r"))
    again = each.filter("type = 'revisit'").drop("payload_bytes", "payload_digest", "payload")
    again = join_hot(again, held, "refers_to", F.xxhash64("id"), how="left")
    whole = F.struct("type", "uri", "refers_to", F.col("r.payload_bytes").alias("payload_bytes"), F.col("r.payload_digest").alias("payload_digest"), F.col("r.payload").alias("payload"))
    again = again.select(F.col("id").alias("capture"), "request", "metadata", whole.alias("response"), F.col("r.page").alias("refers_to_page"), "n")
    every = fresh.union(again)
    out = every.filter("n = 1").drop("n")
    if not records.filter(main).groupBy("id").count().filter("count > 1").isEmpty():
        out = out.union(multiplied(every.filter("n > 1"), "n", "i", ["capture"]).drop("n", "i"))
    return out.select("capture", F.col("metadata.page").alias("page"), "request", "response", "metadata", "refers_to_page")


def captures(pages: DataFrame, folder: str | None = None, keep_payload: bool = False, **how) -> DataFrame:
    """pages written to archives in folder, read back and assembled; without a folder, in a new one in the shared folder
    that is deleted once it was read. A row for each row of pages: null keys and urls, empty and very long payloads and
    repeated rows included."""
    spark = pages.sparkSession
    at = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4()}"
    write_archives(pages, at, **how)
    found = assemble(read_records(spark, at, keep_payload))  # which has read all records once it returns
    if folder is None:
        delete(spark, at)
    return found


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS d, strlen(coalesce(html, '')) AS n FROM pages
), m AS (SELECT d, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
  CASE WHEN m.first IS NOT NULL AND m.first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN m.first <> page_id THEN m.first END AS refers_to
FROM p LEFT JOIN m ON p.d = m.d AND p.n >= 1000
"""
