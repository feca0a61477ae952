"""WARC archives: written as text by Spark, read back by length, and assembled to one row for each capture."""

from __future__ import annotations

import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import looked_up, shared_folder, small_batches, written

#: Payloads of at least so many bytes are stored once and revisited.
REVISIT_BYTES = 1000
#: Captures that one archive file holds at most, by the bytes of their payloads: so no file is of more than 32 MB, but for single payloads longer than that.
FILE_CAPTURES = ((16 << 10, 2048), (512 << 10, 64), (None, 1))
#: Bytes of an archive that are inflated at a time.
CHUNK = 1 << 20
#: Bytes of blocks in one Arrow batch of the reader.
BATCH_BYTES = 4 << 20
DATE, REVISIT = "2024-01-01T00:00:00Z", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "file string, record_no int, type string, record_id string, concurrent_to string, target_uri string, payload_digest string, headers map<string,string>, block binary"


def _record(kind: str, record_id: Column, content: str, block: Column, *more: tuple[str, Column]) -> Column:
    """A record without the two line ends that close it; headers whose value is null are left out."""
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in more]
    head = F.concat_ws(
        "\r\n", F.lit(f"WARC/1.1\r\nWARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit(f"WARC-Date: {DATE}"), *lines,
        F.lit(f"Content-Type: {content}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return F.concat(head, F.lit("\r\n\r\n"), block)


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("/", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_bytes: int = REVISIT_BYTES) -> None:
    """Writes a request, a response or revisit, and a metadata record for every row, as gzipped WARC files.

    Of rows with equal payloads of ``revisit_bytes`` or more, those with the largest identifier are responses and the others revisit
    them, which only counts payload digests; payloads are not shuffled, and a payload that a third of all rows hold is joined like any.
    A null payload is empty; a null url has no target; a null identifier ranks lowest.  Rows alike in
    identifier and payload are captures of their own and of one type.  Files hold payloads of one range of sizes
    (FILE_CAPTURES), so that their bytes are bounded; each range is one pass over the rows.  The payload's own header line takes its
    length in bytes, so payloads may hold anything.
    """
    html = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.regexp_replace(url_col, r"[\x00-\x20]", "").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest")
    )
    groups = rows.where(F.octet_length("html") >= revisit_bytes).groupBy("digest").agg(F.max("id").alias("first"), F.count("*").alias("n"))
    groups = written(groups.where("n > 1").select("digest", "first"), "payloads")  # only payloads that occur again
    rows = looked_up(rows, groups, ["digest"], "left").withColumn("again", F.col("first").isNotNull() & (F.octet_length("html") >= revisit_bytes) & ~F.col("id").eqNullSafe(F.col("first")))
    size = F.octet_length("html").cast("string")
    reply = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    own = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    number = F.col("number").cast("string")
    ids = {k: _urn(F.lit(k), own, "digest", number) for k in ("response", "request", "metadata")}
    target, digest = ("WARC-Target-URI", F.col("url")), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    asked = F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n"))
    about = F.concat(F.lit("page-id: "), own, F.lit("\r\n"))
    records = F.array(
        _record("request", ids["request"], "application/http; msgtype=request", asked, target, ("WARC-Concurrent-To", ids["response"])),
        F.when(F.col("again"), _record("revisit", ids["response"], "application/http; msgtype=response", reply, target, digest, ("WARC-Profile", F.lit(REVISIT)))).otherwise(
            _record("response", ids["response"], "application/http; msgtype=response", F.concat(reply, "html"), target, digest)
        ),
        _record("metadata", ids["metadata"], "application/warc-fields", about, target, ("WARC-Concurrent-To", ids["response"])),
    )
    low = 0
    for high, captures in FILE_CAPTURES:
        own = F.octet_length("html") >= low
        part = rows.where(own & (F.octet_length("html") < high) if high else own).withColumn("number", F.monotonically_increasing_id())
        lines = part.select(F.explode(records).alias("value"))
        lines.write.mode("append").option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", 3 * captures).text(path)
        low = high


_field = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def _inflated(data, chunk: int = CHUNK):
    """The bytes of an archive piece by piece: as they are, of one gzip stream, or of a member for each record."""
    data = memoryview(data)
    if bytes(data[:2]) != b"\x1f\x8b":
        for at in range(0, len(data), chunk):
            yield bytes(data[at : at + chunk])
        return
    at = 0
    while bytes(data[at : at + 2]) == b"\x1f\x8b":
        one = zlib.decompressobj(31)
        while not one.eof:
            given = one.unconsumed_tail
            if not given:
                given = data[at : at + chunk]
                at += len(given)
            out = one.decompress(given, chunk)
            if not (out or len(given) or one.eof):
                raise ValueError("a gzip member is cut off")
            yield out
        at -= len(one.unused_data)


def _parsed(pieces):
    """(headers, block) of each record of an archive that comes in pieces; blocks are taken by Content-Length, so they may hold anything.

    What is held is a record and a piece.
    """
    pieces = iter(pieces)
    buffer, at = bytearray(), 0

    def more() -> bool:
        nonlocal at
        piece = next(pieces, None)
        if piece is None:
            return False
        if at:
            del buffer[:at]
            at = 0
        buffer.extend(piece)
        return True

    while True:
        while True:  # line ends between records
            while buffer[at : at + 2] == b"\r\n":
                at += 2
            if len(buffer) - at > 2 or not more():
                break
        if at >= len(buffer):
            return
        stop = buffer.find(b"\r\n\r\n", at)
        while stop < 0 and buffer[at : at + 5] == b"WARC/"[: len(buffer) - at] and more():
            stop = buffer.find(b"\r\n\r\n", at)
        if buffer[at : at + 5] != b"WARC/" or stop < 0:
            raise ValueError("no WARC record, or one cut off in its headers")
        begin = buffer.index(b"\r\n", at) + 2
        headers = {k.decode().strip().lower(): v.decode("utf-8", "replace").strip() for k, v in _field.findall(bytes(buffer[begin : stop + 2]))}
        size, at = int(headers["content-length"]), stop + 4
        parts, have = [], 0
        while have < size:
            piece = bytes(buffer[at : at + size - have])
            parts.append(piece)
            have += len(piece)
            at += len(piece)
            if have < size and not more():
                raise ValueError("a record is cut off")
        yield headers, b"".join(parts)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives under ``path`` (gzipped whole, by record, or not at all), in any order.

    A task holds a file as it is stored, and of its inflated bytes a record at a time; headers have lower-case names.  A record that is cut
    off or malformed fails the job.
    """

    def run(batches):
        names = [x.split()[0] for x in RECORD.split(", ")]
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, size = [], 0
                for number, (h, block) in enumerate(_parsed(_inflated(content.as_buffer()))):
                    get = h.get
                    rows.append((file.as_py(), number, get("warc-type"), get("warc-record-id"), get("warc-concurrent-to"), get("warc-target-uri"), get("warc-payload-digest"), list(h.items()), block))
                    size += len(block)
                    if size > BATCH_BYTES:
                        yield _batch(rows, names)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, names)

    small_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!._]*").load(path).select("path", "content")
    return files.mapInArrow(run, RECORD)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), *[pa.string()] * 5, pa.map_(pa.string(), pa.string()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def captures(records: DataFrame) -> DataFrame:
    """One nested row for each response or revisit: (record_id, target_uri, response, requests, metadata), by concurrent-to identifiers.

    ``requests`` and ``metadata`` are the arrays of all such records concurrent to it, in order of file and place; empty where there
    are none.  Requests and metadata of nothing are left out.  All sides are keyed by the response's record id,
    which the format has unique.  Other columns of ``records`` are kept inside the structs.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in records.columns))
    reply = F.col("type").isin("response", "revisit")
    keyed = records.withColumn("__key", F.when(reply, F.col("record_id")).otherwise(F.col("concurrent_to"))).where(F.col("__key").isNotNull())
    keyed = keyed.select(F.col("__key").alias("record_id"), F.when(reply, "reply").otherwise(F.col("type")).alias("kind"), whole.alias("record"))
    gathered = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("record"))), _in_order)
    one = keyed.where(F.col("kind").isin("reply", "request", "metadata")).groupBy("record_id").agg(gathered("reply").alias("replies"), gathered("request").alias("requests"), gathered("metadata").alias("metadata"))
    return one.select("record_id", F.explode("replies").alias("response"), "requests", "metadata").select("record_id", F.col("response.target_uri").alias("target_uri"), "response", "requests", "metadata")


def _in_order(a: Column, b: Column) -> Column:
    before = lambda x, y: (x["file"] < y["file"]) | (x["file"].eqNullSafe(y["file"]) & (x["record_no"] < y["record_no"]))
    return F.when(before(a, b), -1).when(before(b, a), 1).otherwise(0)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, read back: of each capture the digest of what was read, and where its payload lies."""
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    # Digests are taken from the blocks before anything is shuffled.
    text = F.col("block")
    cut = F.instr(text.cast("string"), "\r\n\r\n")  # our own replies' headers are ASCII
    payload = F.substring(text, cut + 4, (1 << 31) - 1)
    length = F.regexp_extract(F.decode(F.substring(text, F.lit(1), cut + 1), "ISO-8859-1"), r"Content-Length: (\d+)\r\n", 1).cast("long")
    records = read_archives(spark, path).select(
        "file", "record_no", "type", "record_id", "concurrent_to", "target_uri", "payload_digest",
        F.when(F.col("type") == "response", F.octet_length(payload).cast("long")).when(F.col("type") == "revisit", length).alias("bytes"),
        F.when(F.col("type") == "response", F.sha1(payload)).when(F.col("type") == "revisit", F.substring("payload_digest", 6, 40)).alias("digest"),
        F.when(F.col("type") == "metadata", F.expr("try_cast(regexp_extract(decode(block, 'UTF-8'), 'page-id: (-?[0-9]+)', 1) AS bigint)")).alias("page_id"),
    )
    found = captures(written(records, "records"))
    rows = found.select(F.get("metadata.page_id", F.lit(0)).alias("page_id"), F.col("response.bytes").alias("payload_bytes"), F.col("response.digest").alias("payload_digest"), F.col("response.type").alias("record_type"))
    rows = written(rows, "captures")
    needed = rows.where("record_type = 'revisit'").select("payload_digest").distinct()
    targets = rows.where(F.col("record_type") == "response").join(needed, "payload_digest", "left_semi").groupBy("payload_digest").agg(F.max("page_id").alias("target"))
    rows = looked_up(rows, written(targets, "targets"), ["payload_digest"], "left")
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", F.col("target")).alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to FROM g
"""
