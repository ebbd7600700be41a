"""WARC archives: writing captures, reading records, assembling transactions.

A capture is three records: a request, a response (or a revisit of an earlier response with the
same payload digest) and metadata; request and metadata name the response in WARC-Concurrent-To,
and a revisit names the response's record in WARC-Refers-To.

Each record is a gzip member of its own, and the two line breaks that end it are another, constant
one; so a file decompresses to a plain WARC, and a record can be read from its offset. Spark's text
source writes and reads them with the constant member as line separator: files go through its
commit protocol to any store, are split between tasks, and no file is held in memory.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batchwise, setting, shared_dir

END = "\r\n\r\n"
#: The member that ends a record; its bytes stand in no member of a record in UTF-8 but by chance of 2^-192.
END_MEMBER = gzip.compress(END.encode(), mtime=0)
_TEXT = {"lineSep": END_MEMBER.decode("latin-1"), "encoding": "ISO-8859-1"}
#: Shuffled payloads of one writing task, about: they are sorted and made into records in its memory.
TASK_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def payload_digest(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of the text in UTF-8: each 5 hexadecimal digits are 4 of base 32."""
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
    sha = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(sha, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), digits, _BASE32)


def _stem(page_id: Column, url: Column, missing: Column, digest: Column, copy: Column) -> Column:
    """What a capture's record ids have in common."""
    return F.concat_ws("-", F.coalesce(page_id.cast("string"), F.lit("null")), F.lower(F.hex(F.xxhash64(url, missing, digest))), copy.cast("string"))


def captures(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", min_payload: int = 0) -> DataFrame:
    """Rows (capture, page_id, url, payload, payload_bytes, digest, revisit, refers_to), one for each row of pages.

    A null body is an empty payload. Of captures whose payloads are equal and have at least
    min_payload bytes, that with the smallest key is the response; the others are revisits, have no
    payload here, and refer to its capture. Of equal keys the first by url is the response; rows
    that repeat key, url and body are one capture each, numbered, the first of them the response. Null
    keys come last and a null url after an empty one; it is written as 'about:blank'. A very long body is
    one record like any other. An empty table gives no rows. Other columns are ignored.

    Payloads move once, one of each digest (a digest that many pages share is one on the map side
    already); what is ranked and joined beside them is narrow.
    """
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(body).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", payload_digest(F.col("payload")))
    narrow = rows.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("payload_bytes"))
    narrow = narrow.groupBy("page_id", "url", "digest", "payload_bytes").agg(F.count(F.lit(1)).alias("n"))
    rank = F.struct(F.col("page_id").isNull().alias("last"), F.col("page_id").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.col("url").isNull().alias("missing"))
    first = narrow.where(F.col("payload_bytes") >= min_payload).groupBy(F.col("digest").alias("d")).agg(F.min(rank).alias("first"), F.sum("n").alias("all")).where("all > 1").drop("all")
    rows_of = narrow.join(first, F.col("digest") == F.col("d"), "left").drop("d").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    revisit = F.col("first").isNotNull() & ~((F.col("first") == rank) & (F.col("copy") == 1))
    own = _stem(F.col("page_id"), F.coalesce("url", F.lit("")), F.col("url").isNull(), F.col("digest"), F.col("copy"))
    target = _stem(F.col("first.page_id"), F.col("first.url"), F.col("first.missing"), F.col("digest"), F.lit(1))
    caps = rows_of.select(own.alias("capture"), "page_id", "url", "payload_bytes", "digest", revisit.alias("revisit"), F.when(revisit, target).alias("refers_to"))
    payloads = rows.groupBy(F.col("digest").alias("d")).agg(F.first("payload").alias("payload"))
    return caps.join(payloads, (F.col("digest") == F.col("d")) & ~F.col("revisit"), "left").drop("d")


def _block(kind: str, headers: list, block: Column) -> Column:
    """One record's text: head, headers, length, block."""
    lines = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Date: {DATE}")]
    for name, value in headers:
        lines.append(F.when(value.isNotNull(), F.concat(F.lit(f"\r\n{name}: "), value)).otherwise(""))
    return F.concat(*lines, F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def records(caps: DataFrame) -> DataFrame:
    """One row (value) for each record of each capture."""
    uri = lambda kind, stem: F.concat(F.lit("<urn:capture:"), stem, F.lit(f":{kind}>"))
    at = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7F]", ""), F.lit("about:blank"))
    kind = F.when(F.col("revisit"), "revisit").otherwise("response")
    own = F.concat(F.lit("<urn:capture:"), F.col("capture"), F.lit(":"), kind, F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    target = [("WARC-Target-URI", at)]
    digest = [("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))]
    msg = lambda what: [("Content-Type", F.lit(f"application/http; msgtype={what}"))]
    request = _block("request", [("WARC-Record-ID", uri("request", F.col("capture"))), ("WARC-Concurrent-To", own), *target, *msg("request")], F.concat(F.lit("GET "), at, F.lit(f" HTTP/1.1\r\nUser-Agent: archiver{END}")))
    response = _block("response", [("WARC-Record-ID", own), *target, *digest, *msg("response")], F.concat(http, F.col("payload")))
    revisit = _block(
        "revisit",
        [("WARC-Record-ID", own), *target, *digest, ("WARC-Profile", F.lit(_PROFILE)), ("WARC-Refers-To", uri("response", F.col("refers_to"))), *msg("response")],
        http,
    )
    about = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit("\r\nhas-url: "), F.when(F.col("url").isNull(), "no").otherwise("yes"), F.lit("\r\n"))
    metadata = _block("metadata", [("WARC-Record-ID", uri("metadata", F.col("capture"))), ("WARC-Concurrent-To", own), *target, ("Content-Type", F.lit("application/warc-fields"))], about)
    return caps.select(F.explode(F.array(request, F.when(F.col("revisit"), revisit).otherwise(response), metadata)).alias("value"))


def write(caps: DataFrame, path: str) -> None:
    """The captures' records below the path, each a gzip member followed by END_MEMBER."""

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                z = zlib.compressobj(level=6, wbits=31)
                out.append(z.compress(text.encode()) + z.flush())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    packed = records(caps).transform(batchwise(pack, "value binary"))
    with setting(caps.sparkSession, "spark.sql.adaptive.advisoryPartitionSizeInBytes", str(TASK_BYTES)):
        packed.select(F.col("value").cast("string").alias("value")).write.options(**_TEXT).text(path)


_LENGTH = re.compile(rb"\r\nContent-Length: *(\d+)", re.I)


def split_records(raw: bytes):
    """(headers dict, block) of each record of an uncompressed file, by Content-Length."""
    at = 0
    while at < len(raw):
        if not raw.startswith(b"WARC/1.", at):
            raise ValueError(f"no WARC record at byte {at}")
        stop = raw.index(b"\r\n\r\n", at)
        head = raw[at:stop]
        n = int(_LENGTH.search(head)[1])
        lines = head.decode().split("\r\n")[1:]
        yield {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, raw[stop + 4 : stop + 4 + n]
        at = stop + 4 + n + 4


RECORD = "type string, id string, concurrent_to string, target string, digest string, refers_to string, http_bytes bigint, payload binary, fields map<string,string>"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under the path, one member at a time.

    A response's payload is checked against its digest header; a mismatch, or a member that is no
    record, raises.
    """

    def run(batches):
        import pyarrow as pa

        kinds = pa.schema([("type", pa.string()), ("id", pa.string()), ("concurrent_to", pa.string()), ("target", pa.string()), ("digest", pa.string()), ("refers_to", pa.string()), ("http_bytes", pa.int64()), ("payload", pa.binary()), ("fields", pa.map_(pa.string(), pa.string()))])
        for batch in batches:
            rows = []
            for member in batch.column(0).to_pylist():
                for h, block in split_records(gzip.decompress(member)):
                    kind, payload, http, fields = h["warc-type"], None, None, []
                    if kind in ("response", "revisit"):
                        head, _, body = block.partition(b"\r\n\r\n")
                        http = int(_LENGTH.search(head)[1])
                        if kind == "response":
                            payload = body
                            if "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode() != h["warc-payload-digest"] or len(body) != http:
                                raise ValueError(f"payload of {h['warc-record-id']} doesn't have its digest")
                    elif kind == "metadata":
                        fields = [(k, v.strip()) for k, _, v in (x.partition(":") for x in block.decode().split("\r\n")) if k]
                    rows.append((kind, h["warc-record-id"], h.get("warc-concurrent-to"), h.get("warc-target-uri"), h.get("warc-payload-digest"), h.get("warc-refers-to"), http, payload, fields))
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(columns, kinds, strict=True)], schema=kinds)

    members = spark.read.options(**_TEXT).text(path).select(F.col("value").cast("binary").alias("value"))
    return members.transform(batchwise(run, RECORD))


def assemble(recs: DataFrame) -> DataFrame:
    """One nested row for each capture: (id, request, response, metadata), joined through concurrent-to.

    A transaction is keyed by its response's (or revisit's) record id. Records that name no present
    response keep their row with a null response; records that repeat an id count once (the smallest).
    Payloads are part of the response if recs has them; without them less is moved.
    """
    body = F.struct("id", "type", "target", "digest", "refers_to", "http_bytes", *(["payload"] if "payload" in recs.columns else []))
    side = F.struct("id", "target")
    about = F.struct("id", "target", F.col("fields")["page-id"].alias("page_id"), F.col("fields")["has-url"].alias("has_url"))
    main = F.col("type").isin("response", "revisit")
    return recs.groupBy(F.when(main, F.col("id")).otherwise(F.col("concurrent_to")).alias("transaction")).agg(
        F.min(F.when(F.col("type") == "request", side)).alias("request"),
        F.min(F.when(main, body)).alias("response"),
        F.min(F.when(F.col("type") == "metadata", about)).alias("metadata"),
    )


def round_trip(pages: DataFrame, payloads: bool = True, **names) -> DataFrame:
    """Write the pages' captures as archives, read them back and assemble them, with or without payloads."""
    path = shared_dir(pages.sparkSession, "warc")
    write(captures(pages, **names), path)
    recs = read_records(pages.sparkSession, path)
    return assemble(recs if payloads else recs.drop("payload"))


def digests(transactions: DataFrame) -> DataFrame:
    r = F.col("response")
    number = lambda c: F.expr(f"try_cast({c} AS BIGINT)")
    return transactions.select(
        number("metadata.page_id").alias("page_id"),
        r["http_bytes"].alias("payload_bytes"),
        F.substring_index(r["digest"], ":", -1).alias("payload_digest"),
        r["type"].alias("record_type"),
        F.regexp_extract(r["refers_to"], r"^<urn:capture:(-?\d+)-", 1).alias("to"),
    ).select("page_id", "payload_bytes", "payload_digest", "record_type", F.expr("try_cast(to AS BIGINT)").alias("refers_to"))
