"""WARC archives: writing captures, reading records, assembling transactions."""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import shared_folder, stage_boundary
from ._arrow import map_batches
from .prefix_trie import look_up

#: Payloads below this are never revisits.
LEAST_BYTES = 1000
#: Captures of one archive file, so that a reader holds a bounded file.
RECORDS_PER_FILE = 500
DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"


def _header(kind: str, record: Column, length: Column, *more: Column) -> Column:
    lines = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Date: {DATE}\r\nWARC-Record-ID: "), record, *more, F.lit("\r\nContent-Length: "), length.cast("string"), F.lit(END)]
    return F.concat(*lines)


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"\r\n{name}: "), value)


def plan_revisits(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Pages with their payload's length and digest, and the page that they revisit, if any.

    Of equal payloads of LEAST_BYTES or more the largest key is the response; payloads are equal if their lengths and two digests are.  Only these
    and the key are aggregated, map-side first.  Digests that stand once need no partner, so only repeated ones are joined back, to bodies that stay
    where they are if the repeated digests are few in bytes, and else are dealt over several tasks per digest.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    p = pages.select(F.col(key).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), body.alias("body"))
    p = p.withColumn("payload_bytes", F.octet_length("body").cast("long")).withColumn("payload_digest", F.sha1("body"))
    p = p.withColumn("_second", F.md5("body"))
    same = ("payload_bytes", "payload_digest", "_second")
    large = p.where(F.col("payload_bytes") >= LEAST_BYTES).groupBy(*same).agg(F.max("page_id").alias("holder"), F.count("*").alias("n"))
    joined = look_up(p, stage_boundary(large.where("n > 1").select(*same, "holder")), same, "page_id")
    big = (F.col("payload_bytes") >= LEAST_BYTES) & (F.col("page_id") != F.col("holder"))
    return joined.withColumn("refers_to", F.when(big, F.col("holder"))).drop("_second", "holder")


def capture_records(plan: DataFrame) -> Column:
    """The text of a capture's three records: request, response or revisit, metadata; tied by WARC-Concurrent-To."""
    urn = lambda kind, key: F.concat(F.lit(f"<urn:capture:{kind}:"), key.cast("string"), F.lit(">"))
    # The URL goes percent-free of line breaks so that no header can be broken.
    target = _line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    response, request, metadata = urn("response", page), urn("request", page), urn("metadata", page)
    ask = F.lit("GET / HTTP/1.1\r\nUser-Agent: granary\r\n\r\n")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    digest = _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest")))
    facts = F.lit("fetchTimeMs: 0\r\n")
    full = F.concat(_header("response", response, F.octet_length(http) + F.col("payload_bytes"), target, digest, F.lit("\r\nContent-Type: application/http; msgtype=response")), http, F.col("body"))
    refers = _line("WARC-Refers-To", urn("response", F.col("refers_to")))
    profile = F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    again = F.concat(_header("revisit", response, F.octet_length(http), target, digest, refers, profile, F.lit("\r\nContent-Type: application/http; msgtype=response")), http)
    tied = _line("WARC-Concurrent-To", response)
    first = F.concat(_header("request", request, F.octet_length(ask), target, tied, F.lit("\r\nContent-Type: application/http; msgtype=request")), ask)
    last = F.concat(_header("metadata", metadata, F.octet_length(facts), target, tied, F.lit("\r\nContent-Type: application/warc-fields")), facts)
    return F.concat(first, F.lit(END), F.when(F.col("refers_to").isNull(), full).otherwise(again), F.lit(END), last)


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", compression: str = "gzip") -> str:
    """Archives of all pages below path, in any store that Spark writes; repeated writes of a lost task replace its file."""
    plan = plan_revisits(pages, key, url, html)
    text = plan.select(capture_records(plan).alias("value"))
    text.write.mode("overwrite").option("lineSep", END).option("compression", compression).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)
    return path


def parse_records(raw: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """Headers (lower-case names) and block of each record; Content-Length alone ends a block."""
    view, at, n = memoryview(raw), 0, len(raw)
    while at < n:
        if raw[at : at + 5] != b"WARC/":
            nxt = raw.find(b"WARC/", at)
            if nxt < 0:
                return
            at = nxt
        stop = raw.find(b"\r\n\r\n", at)
        if stop < 0:
            return
        lines = raw[at:stop].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(headers.get("content-length", "0"))
        yield headers, view[stop + 4 : stop + 4 + size]
        at = stop + 4 + size
        while raw[at : at + 2] == b"\r\n":
            at += 2


RECORDS = "record_id string, kind string, concurrent_to string, url string, refers_to string, payload_digest string, payload_bytes long, intact boolean, payload binary, head string"


def read_records(spark, path: str) -> DataFrame:
    """All records of the archives below path, .gz ones unpacked; response payloads are hashed again (``intact``)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)

    def batch(b):
        names = [x.split()[0] for x in RECORDS.split(", ")]
        for value in b.column(0):
            raw = value.as_py()
            if raw[:2] == b"\x1f\x8b":
                raw = gzip.decompress(raw)
            rows = []
            for h, block in parse_records(raw):
                kind, payload, head, digest, size, intact = h.get("warc-type"), None, None, None, None, None
                if kind in ("response", "revisit"):
                    whole = bytes(block)
                    front = whole.find(b"\r\n\r\n")
                    front = front + 4 if front >= 0 else len(whole)  # no separator: a header without payload
                    head = whole[:front].decode("utf-8", "replace")
                    digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
                    size = next((int(x.partition(":")[2]) for x in head.split("\r\n") if x.lower().startswith("content-length:")), None)
                    if kind == "response":
                        payload = whole[front:]
                        intact = hashlib.sha1(payload).hexdigest() == digest and len(payload) == size
                elif kind is not None:
                    head = bytes(block).decode("utf-8", "replace")
                rows.append((h.get("warc-record-id"), kind, h.get("warc-concurrent-to"), h.get("warc-target-uri"), h.get("warc-refers-to"), digest, size, intact, payload, head))
            if rows:
                yield dict(zip(names, zip(*rows, strict=True), strict=True))

    return map_batches(files, RECORDS, batch, "content")


def assemble(records: DataFrame, payload: bool = True) -> DataFrame:
    """One nested row per capture: request, response or revisit, and metadata, joined on the identifiers they are concurrent to.

    A capture's key is its response's identifier, its own or the one named by WARC-Concurrent-To; records that tie to none give no row.
    Where an identifier repeats (a page archived twice), each response or revisit gives a row, and any one of the equal requests and metadata records stands for all.
    """
    r = records.withColumn("capture", F.coalesce("concurrent_to", "record_id"))
    main = r.where("kind in ('response', 'revisit')")
    side = r.where("kind in ('request', 'metadata')").groupBy("capture").agg(
        *[F.max_by(F.struct("record_id", "url", "head"), F.when(F.col("kind") == k, F.lit(1))).alias(k) for k in ("request", "metadata")]
    )
    fields = ["record_id", "kind", "url", "refers_to", "payload_digest", "payload_bytes", "intact", "head"] + ["payload"] * payload
    return main.select("capture", F.struct(*fields).alias("response")).join(side, "capture", "left")


def archive_and_read(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write all pages to archives in the shared folder, read these back and assemble their captures.

    One row per page row.  Null html is the empty payload, a null url the empty one; a page_id that occurs twice, or is null, gives a row each.
    Raises if a stored payload does not match its digest.  An empty table gives no rows; further columns are ignored.
    """
    spark = pages.sparkSession
    path = write_archives(pages, f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}", key, url, html)
    captures = assemble(read_records(spark, path), payload=False)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, ':([^:>]*)>$', 1) as long)")
    digest = F.when(F.col("response.kind").eqNullSafe("response") & ~F.coalesce("response.intact", F.lit(False)), F.raise_error(F.lit("a stored payload differs from its digest")))
    return captures.select(
        number("capture").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.coalesce(digest.cast("string"), F.col("response.payload_digest")).alias("payload_digest"),
        F.col("response.kind").alias("record_type"),
        number("response.refers_to").alias("refers_to"),
        F.col("response.url").alias("url"),
        F.col("request.record_id").alias("request_id"),
        F.col("metadata.record_id").alias("metadata_id"),
    )
