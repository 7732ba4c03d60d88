"""WARC archives: written by Spark's text writer, read as a stream of records, assembled to captures.

A page becomes three records: the request, the response or a revisit, and metadata with the page's id; the first and
the last name the second in WARC-Concurrent-To. A record is one string, and the writer's line separator is the two empty
lines that end a record, so that files are written, committed and retried by Spark. Files are gzip as a whole, which
also keeps each in one task when it is read.

The reader has Spark cut the stream at empty lines and joins the pieces again by Content-Length, so that payloads
may hold empty lines, or whole records; it holds one record at a time. ``assemble`` joins requests and metadata to the
responses through the concurrent-to identifiers, in either direction, one nested row a capture.

Results in odd cases: null html is an empty payload, null url no WARC-Target-URI, null page_id an empty field and
null again. Of rows with equal payloads and equal largest page_id (ties, repeated rows) one is the response and the others
revisit it. Payloads of any length are whole; a record that its file's end cuts short is marked ``truncated``. Line ends in
a url are percent-encoded. Only the three named columns are read, so that no other can clash; an empty table gives an
archive without records and no row. ``pages`` must give its rows in the same order each time, as a written table does.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from adjudica.llm.common import scratch_path, stored

END = "\r\n\r\n"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAIN = ("response", "revisit", "resource")
FRAME_BYTES = 4 << 20

RECORD = "record_id string, type string, date string, target_uri string, concurrent_to array<string>, refers_to string, content_type string, payload_digest string, http_head string, payload binary, truncated boolean"


def _record(kind: str, record_id: Column, date: str, uri: Column, extra: list[tuple[str, Column | str]], content_type: str, block: Column) -> Column:
    """One record without the empty lines after it; fields that are null are left out."""
    fields = [("WARC-Type", F.lit(kind)), ("WARC-Record-ID", record_id), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", uri), *extra, ("Content-Type", F.lit(content_type)), ("Content-Length", F.octet_length(block).cast("string"))]
    return F.concat_ws("\r\n", F.lit("WARC/1.1"), *[F.concat(F.lit(f"{name}: "), value) for name, value in fields], F.lit(""), block)


def _name(*of: Column) -> Column:
    h = F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in of]), 256)
    at = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in at]), F.lit(">"))


def write_warc(pages: DataFrame, path: str, min_bytes: int = 1000, date: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes the pages' records under ``path``. Of equal payloads of ``min_bytes`` or more that of the largest id is a response, the
    others are revisits without payload. One shuffle of the pages, by payload; adaptive execution splits a payload that has many copies."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    uri = F.replace(F.replace(F.col(url_col).cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), uri.alias("uri"), html.alias("html"), F.monotonically_increasing_id().alias("n"), F.sha2(html, 256).alias("same"))
    copies = rows.where(F.octet_length("html") >= min_bytes).groupBy("same").agg(F.max(F.struct("id", "n")).alias("kept"), F.count("*").alias("copies")).where("copies > 1")
    rows = rows.join(copies.select("same", "kept"), "same", "left")
    own, kept = _name(F.col("id"), F.col("n"), F.lit("main")), _name(F.col("kept.id"), F.col("kept.n"), F.lit("main"))
    revisit = F.coalesce(F.col("kept.n") != F.col("n"), F.lit(False))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(END))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1("html")))
    http = "application/http;msgtype=response"
    response = _record("response", own, date, F.col("uri"), [digest], http, F.concat(head, F.col("html")))
    again = _record("revisit", own, date, F.col("uri"), [("WARC-Profile", F.lit(IDENTICAL)), ("WARC-Refers-To", kept), digest], http, head)
    beside = [("WARC-Concurrent-To", own)]
    asked = F.concat(F.lit("GET "), F.coalesce(F.col("uri"), F.lit("/")), F.lit(" HTTP/1.1" + END))
    request = _record("request", _name(F.col("id"), F.col("n"), F.lit("request")), date, F.col("uri"), beside, "application/http;msgtype=request", asked)
    told = F.concat(F.lit("page-id: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("\r\n"))
    metadata = _record("metadata", _name(F.col("id"), F.col("n"), F.lit("metadata")), date, F.col("uri"), beside, "application/warc-fields", told)
    rows.select(F.explode(F.array(request, F.when(revisit, again).otherwise(response), metadata)).alias("record")).write.option("lineSep", END).option("compression", "gzip").text(path)


def _parsed(head: bytes, block: bytes, truncated: bool) -> tuple:
    fields: dict[str, list[str]] = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields.setdefault(name.strip().lower(), []).append(value.strip())
    one = {k: v[0] for k, v in fields.items()}.get
    named = lambda v: v and v.strip("<>")
    kind, http_head = one("content-type"), None
    if kind and kind.startswith("application/http"):
        top, _, block = block.partition(END.encode())
        http_head = top.decode("utf-8", "replace")
    return named(one("warc-record-id")), one("warc-type"), one("warc-date"), one("warc-target-uri"), [named(v) for v in fields.get("warc-concurrent-to", [])], named(one("warc-refers-to")), kind, one("warc-payload-digest"), http_head, block, truncated


def _content_length(head: bytes) -> int:
    found = [line.partition(b":")[2] for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:")]
    return int(found[0]) if found else 0


def records_of(pieces: Iterator[tuple[str, bytes]]) -> Iterator[tuple]:
    """Records of (file, piece) in order, where the pieces of a file, joined by empty lines, are its bytes."""
    file, head, need, parts, size = None, None, 0, [], 0

    def rest() -> Iterator[tuple]:
        if head is not None:
            yield _parsed(head, b"".join(parts)[: -len(END)], True)

    for at, piece in pieces:
        if at != file:
            yield from rest()
            file, head, parts, size = at, None, [], 0
        parts += [piece, END.encode()]
        size += len(piece) + len(END)
        while size >= need if head is not None else parts:
            data = b"".join(parts)
            if head is None:
                data = data.lstrip(b"\r\n")
                head, found, data = data.partition(END.encode())
                if not found:
                    head, parts, size = None, [head] if head else [], len(head)
                    break
                need = _content_length(head)
            else:
                yield _parsed(head, data[:need], False)
                head, data = None, data[need:]
            parts, size = [data] if data else [], len(data)
    yield from rest()


def _records(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names, held, size = [c.split()[0] for c in RECORD.split(", ")], [], 0
    for record in records_of(p for frame in frames for p in zip(frame.file, frame.piece)):
        held.append(record)
        size += len(record[9]) + 500
        if size >= FRAME_BYTES:
            yield pd.DataFrame(held, columns=names)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=names)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``RECORD`` of every record of the gzip archives under ``path``."""
    pieces = spark.read.option("lineSep", END).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))
    return pieces.mapInPandas(_records, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: capture_id, target_uri, date, type, refers_to, response, requests, metadata.

    A capture is a response, revisit or resource; a request or metadata record belongs to the one that it names in
    WARC-Concurrent-To, or that names it. What belongs to no capture of the archive is a row without response under the
    identifier that it names, or its own.
    """
    main = records.where(F.col("type").isin(*MAIN))
    naming = main.select(F.explode("concurrent_to").alias("record_id"), F.col("record_id").alias("by"))
    beside = records.where(F.col("type").isin("request", "metadata")).join(naming, "record_id", "left")
    beside = beside.withColumn("capture_id", F.explode(F.when(F.col("by").isNotNull(), F.array("by")).when(F.size("concurrent_to") > 0, F.col("concurrent_to")).otherwise(F.array("record_id"))))
    part = F.struct("record_id", "content_type", "http_head", "payload", "truncated")
    beside = beside.groupBy("capture_id").agg(
        F.collect_list(F.when(F.col("type") == "request", part)).alias("requests"), F.collect_list(F.when(F.col("type") == "metadata", part)).alias("metadata"),
        F.min("target_uri").alias("its_uri"), F.min("date").alias("its_date"),
    )
    main = main.select(F.col("record_id").alias("capture_id"), "target_uri", "date", "type", "refers_to", F.struct("content_type", "payload_digest", "http_head", "payload", "truncated").alias("response"))
    return main.join(beside, "capture_id", "full").select(
        "capture_id", F.coalesce("target_uri", "its_uri").alias("target_uri"), F.coalesce("date", "its_date").alias("date"), "type", "refers_to", "response",
        *[F.coalesce(c, F.array().cast(beside.schema[c].dataType)).alias(c) for c in ("requests", "metadata")],
    )


def page_captures(captures: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): revisits have what the response that they refer to has."""
    told = F.str_to_map(F.decode(F.col("metadata")[0]["payload"], "UTF-8"), F.lit("\r\n"), F.lit(": "))
    payload = F.col("response.payload")
    rows = captures.where(F.col("type").isNotNull()).select(
        "capture_id", F.col("type").alias("record_type"), "refers_to", F.nullif(F.get(F.map_values(F.map_filter(told, lambda k, v: k == "page-id")), F.lit(0)), F.lit("")).cast("long").alias("page_id"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("payload_digest"),
    )
    rows = stored(rows, "warc-captures")
    first = rows.where("record_type <> 'revisit'")
    seen = first.select(F.col("capture_id").alias("refers_to"), F.col("page_id").alias("first_id"), "payload_bytes", "payload_digest")
    again = rows.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to").join(seen, "refers_to", "left")
    out = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    return first.select(*out, F.lit(None).cast("long").alias("refers_to")).unionByName(again.select(*out, F.col("first_id").alias("refers_to")))


def contract(pages: DataFrame) -> DataFrame:
    spark, path = pages.sparkSession, scratch_path(pages.sparkSession, "warc")
    write_warc(pages, path)
    return page_captures(assemble(read_warc(spark, path)))
