"""WARC writing, reading and transaction assembly.

Writing: every row becomes a request, a response (or revisit) and a metadata record; request and metadata name the response
in ``WARC-Concurrent-To``, a revisit names the response with its payload in ``WARC-Refers-To``. Rows get a number and a digest
in one pass; roles come from narrow columns of it (one row per repeated digest is joined back, broadcast by Spark if it is
small), so payloads are not shuffled for their roles. Records go out through Spark's text writer with the record terminator as
line separator, so the files are gzip WARC files in any store that Spark writes (one gzip member a file: Spark's writers make
no others). Rows are written by size class, so that a file is bounded both in captures and in bytes.

Reading: archives may have any number of gzip members, one for each record as is usual or one for all; they are inflated bit
by bit, and records are found by ``Content-Length`` (a payload may hold any bytes, record separators too). Assembly groups the
records by the response that they are concurrent to and emits one nested row per capture; a capture's records meet by partial
aggregation, so even an identifier that many records name never gathers them in one task.

Defined results: every row gives one capture, also where rows repeat or ids are null (a number of its own tells it apart); null
html is an empty payload; a null url leaves out the target header; line breaks in a url are percent-encoded; a null page_id
comes back null and its row is a response; of several rows with the smallest page_id and equal payload each is a response; a
very long payload or url is written whole; an empty table gives an archive without records; other columns are ignored, whatever
their names. Requests or metadata whose response is missing give a capture with a null response; a cut-off archive is an error.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, scratch_dir

CRLF = "\r\n"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
CAPTURES_PER_FILE = 2048
SMALL_PAYLOAD = 1 << 17  # up to it, a file has CAPTURES_PER_FILE captures; each doubling halves them
MIN_REVISIT_BYTES = 100

RECORD_SCHEMA = (
    "record_id string, warc_type string, concurrent_to string, target_uri string, refers_to string, header_digest string, "
    "payload_bytes bigint, payload_digest string, payload binary, fields map<string,string>"
)


def _uuid(*parts: Column) -> Column:
    """A name-based ``urn:uuid`` from the md5 of the parts."""
    h = F.md5(F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("\u0002")) for p in parts]).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, r"(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """Header lines (those with a null value are left out), an empty line, the block."""
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v, F.lit(CRLF))).otherwise("") for k, v in headers]
    return F.concat(F.lit("WARC/1.1" + CRLF), *lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block)


def with_roles(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``row, page_id, url, payload, payload_digest, payload_bytes, first_id, first_row`` (the response that a revisit refers to, else null)."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "pages")
    known = rows.where(F.col("payload_bytes") >= min_bytes).select("payload_digest", "page_id", F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row")).alias("_at"))
    first = known.groupBy("payload_digest").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).where("_n > 1 and _first is not null")
    first = materialize(first.select("payload_digest", F.col("_first.page_id").alias("first_id"), F.col("_first.row").alias("first_row")), "firsts")
    joined = rows.join(first, "payload_digest", "left")
    later = F.col("page_id") > F.col("first_id")
    return joined.withColumns({"first_row": F.when(later, F.col("first_row")), "first_id": F.when(later, F.col("first_id"))})


def write_archive(pages: DataFrame, path: str) -> None:
    """Writes ``page_id, url, html`` rows as gzip WARC files under ``path``."""
    r = with_roles(pages.select("page_id", "url", "html"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    r = r.withColumns({"_resp": _uuid(F.lit("response"), F.col("row")), "_url": url})
    is_revisit = F.col("first_row").isNotNull()
    common = [("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", F.col("_url"))]
    path_query = F.regexp_extract(F.coalesce("_url", F.lit("")), r"^[^:]*://[^/?#]*([^#]*)", 1)
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", _uuid(F.lit("request"), F.col("row"))), *common, ("WARC-Concurrent-To", F.col("_resp")), ("Content-Type", F.lit("application/http;msgtype=request"))],
        F.concat(F.lit("GET "), F.when(path_query == "", F.lit("/")).otherwise(path_query), F.lit(" HTTP/1.1\r\nHost: "), F.regexp_extract(F.coalesce("_url", F.lit("")), r"://([^/?#]*)", 1), F.lit("\r\n\r\n"))
    )
    main = _record(
        [
            ("WARC-Type", F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response"))),
            ("WARC-Record-ID", F.col("_resp")),
            *common,
            ("WARC-Profile", F.when(is_revisit, F.lit(REVISIT_PROFILE))),
            ("WARC-Refers-To", F.when(is_revisit, _uuid(F.lit("response"), F.col("first_row")))),
            ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
            ("Content-Type", F.lit("application/http;msgtype=response")),
        ],
        F.concat(F.lit(HTTP_HEAD), F.when(is_revisit, F.lit("")).otherwise(F.col("payload"))),
    )
    fields = F.concat(
        F.when(F.col("page_id").isNotNull(), F.concat(F.lit("pageId: "), F.col("page_id").cast("string"), F.lit(CRLF))).otherwise(""),
        F.lit("payloadLength: "), F.col("payload_bytes").cast("string"), F.lit(CRLF),
    )
    metadata = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _uuid(F.lit("metadata"), F.col("row"))), *common, ("WARC-Concurrent-To", F.col("_resp")), ("Content-Type", F.lit("application/warc-fields"))], fields
    )
    gap = F.lit(CRLF + CRLF)
    size_class = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("payload_bytes"), F.lit(1)) / SMALL_PAYLOAD))).cast("int")
    largest = r.agg(F.max(size_class)).first()[0] or 0
    for k in range(largest + 1):  # at most 14: a payload has less than 2 GB
        (
            r.where(size_class == k).select(F.concat(request, gap, main, gap, metadata).alias("value"))
            .write.mode("append")
            .option("lineSep", CRLF + CRLF)
            .option("compression", "gzip")
            .option("maxRecordsPerFile", max(1, CAPTURES_PER_FILE >> k))
            .text(path)
        )


def inflate(data: bytes, step: int = 1 << 22, piece: int = 1 << 15) -> Iterator[bytes]:
    """The bytes of all gzip members of a file, at most ``step`` at a time.

    A member is fed pieces of the file and the next one begins where it stopped reading, so no rest of the file is ever copied.
    """
    view, at = memoryview(data), 0
    while at < len(view):
        member = zlib.decompressobj(31)
        while not member.eof:
            fed = view[at : at + piece]
            out = member.decompress(fed, step)
            at += len(fed) - len(member.unconsumed_tail) - len(member.unused_data)
            if out:
                yield out
            elif not fed:
                raise ValueError("the archive ends within a gzip member")


def parse_records(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(headers, block)`` of the records of one archive, found by ``Content-Length``; one record is held at a time."""
    chunks, held = iter(chunks), bytearray()

    def reach(n: int) -> bool:
        """Reads on until ``n`` bytes are held."""
        while len(held) < n:
            more = next(chunks, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while reach(2):
        if held.startswith(b"\r\n"):
            del held[:2]
            continue
        while (stop := held.find(b"\r\n\r\n")) < 0:
            if not reach(len(held) + 1):
                raise ValueError("the archive ends within a record header")
        first, *lines = held[:stop].decode("utf-8").split(CRLF)
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record where one is due: {first[:80]!r}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        end = stop + 4 + int(head["content-length"])
        if not reach(end):
            raise ValueError("the archive ends within a record")
        yield head, bytes(held[stop + 4 : end])
        del held[:end]
    if held.strip():
        raise ValueError("bytes after the last record")


def _row(head: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    fields, payload, kind = {}, None, head["warc-type"]
    if kind == "response":
        payload = block[block.find(b"\r\n\r\n") + 4 :] if b"\r\n\r\n" in block else b""
    elif kind == "metadata":
        fields = {k.strip(): v.strip() for k, sep, v in (x.partition(":") for x in block.decode("utf-8").split(CRLF)) if sep}
    known = None if payload is None else (len(payload), hashlib.sha256(payload).hexdigest())
    return (
        head["warc-record-id"], kind, head.get("warc-concurrent-to"), head.get("warc-target-uri"), head.get("warc-refers-to"), head.get("warc-payload-digest"),
        *(known or (None, None)), payload if with_payload else None, list(fields.items()),
    )


def read_archive(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record. Payload digest and length are those of the bytes that were read."""
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    types = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.binary(), pa.map_(pa.string(), pa.string())]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for content in batch.column(0):
                for head, block in parse_records(inflate(content.as_py())):
                    rows.append(_row(head, block, with_payload))
                    held += len(block) if with_payload else 0
                    if held > 4 << 20 or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(parse, RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id, request, response, metadata``.

    ``response`` is the response or revisit record. Where several requests (or metadata records) name one response,
    that with the smallest record id stands.
    """
    main = F.col("warc_type").isin("response", "revisit")
    anchor = F.when(main, F.col("record_id")).otherwise(F.col("concurrent_to"))
    body = F.struct("record_id", "warc_type", "target_uri", "refers_to", "header_digest", "payload_bytes", "payload_digest", "payload", F.map_entries("fields").alias("fields"))
    keyed = records.where(main | F.col("warc_type").isin("request", "metadata")).select(anchor.alias("capture_id"), "warc_type", body.alias("b"))
    pick = lambda *kinds: F.min(F.when(F.col("warc_type").isin(*kinds), F.col("b")))
    return keyed.where("capture_id is not null").groupBy("capture_id").agg(pick("request").alias("request"), pick("response", "revisit").alias("response"), pick("metadata").alias("metadata"))


def capture_digest(captures: DataFrame) -> DataFrame:
    """The digest columns of each capture, from its records; ``refers_to`` is the page of the response that a revisit names."""
    field = lambda k: F.get(F.filter("metadata.fields", lambda e: e["key"] == k), 0)["value"].cast("long")
    rows = captures.select(
        "capture_id",
        field("pageId").alias("page_id"),
        F.coalesce("response.payload_bytes", field("payloadLength")).alias("payload_bytes"),
        F.coalesce("response.payload_digest", F.regexp_replace("response.header_digest", "^sha256:", "")).alias("payload_digest"),
        F.col("response.warc_type").alias("record_type"),
        F.col("response.refers_to").alias("_named"),
        F.col("request.target_uri").alias("target_uri"),
    )
    rows = materialize(rows, "captures")
    # one row for each response that is referred to, however many revisits name it
    named = rows.where("_named is not null").select("_named").distinct()
    pages = materialize(rows.select(F.col("capture_id").alias("_named"), F.col("page_id").alias("refers_to")).join(named, "_named"), "referred")
    return rows.join(pages, "_named", "left").drop("_named", "capture_id")


def round_trip(pages: DataFrame, path: str | None = None, with_payload: bool = False) -> DataFrame:
    """Writes the archives, reads them back, assembles the captures."""
    spark = pages.sparkSession
    path = path or scratch_dir(spark, "warc")
    write_archive(pages, path)
    return assemble(read_archive(spark, path, with_payload))
