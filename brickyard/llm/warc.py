"""WARC archives: writing, reading, and revisit resolution by payload digest.

An archive is a folder of gzip-compressed WARC/1.1 files that Spark writes as text parts whose
line separator is the two line ends that close a record. Only headers are shuffled by digest; payloads move
once, to the file they are written to. Files are dealt out by total size, so one file fits in
a task when it is read back.

Defined results: null html is an empty payload, and empty payloads are equal like any other.
Of equal payloads the record with the largest id is the response. A row without id is never
referred to: it revisits the response with an id, or is a response where there is none. Rows
that repeat an id with an equal payload are responses alike.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brickyard.llm.common import keep_path, parts, stage
from brickyard.session import new_path

FILE_BYTES = 8 << 20
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
_HEADER = ("record_id string, record_type string, url string, refers_to string, "
           "payload_digest string, payload_bytes bigint, block_bytes bigint")


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 as a column expression (40 bits at a time)."""
    hexed = F.sha1(payload)
    digits = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV",
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _safe(col: Column) -> Column:
    """A header value on one line."""
    out = F.coalesce(col, F.lit(""))
    for char, code in (("\r", "%0D"), ("\n", "%0A")):
        out = F.replace(out, F.lit(char), F.lit(code))
    return out


def originals(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(digest, response_id, response_url) of the record each payload is kept in."""
    return (headers.filter((F.col("bytes") >= min_bytes) & F.col("id").isNotNull())
            .groupBy("digest").agg(F.max(F.struct("id", "url")).alias("r"))
            .select("digest", F.col("r.id").alias("response_id"),
                    F.col("r.url").alias("response_url")))


def _write(rows: DataFrame, path: str) -> None:
    """Write rows (id, url, digest, bytes, original, response_id, response_url, payload).

    The payload is needed for originals only.
    """
    original = F.col("original")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                          "Content-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.when(original, F.concat(http, "payload")).otherwise(http)
    uid = F.md5(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("-")), "url", "digest"))
    uuid = F.concat_ws("-", *[F.substring(uid, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4),
                                                                 (21, 12))])
    lines = [F.lit("WARC/1.1"),
             F.concat(F.lit("WARC-Type: "), F.when(original, "response").otherwise("revisit")),
             F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), uuid, F.lit(">")),
             F.lit(f"WARC-Date: {DATE}"),
             F.concat(F.lit("WARC-Target-URI: "), "url"),
             F.concat(F.lit("WARC-Payload-Digest: sha1:"), "digest"),
             F.when(F.col("id").isNotNull(),
                    F.concat(F.lit("X-Source-Id: "), F.col("id").cast("string"))),
             F.when(~original, F.lit(f"WARC-Profile: {PROFILE}")),
             F.when(~original, F.concat(F.lit("X-Refers-To-Id: "),
                                        F.col("response_id").cast("string"))),
             F.when(~original, F.concat(F.lit("WARC-Refers-To-Target-URI: "), "response_url")),
             F.when(~original, F.lit(f"WARC-Refers-To-Date: {DATE}")),
             F.lit("Content-Type: application/http;msgtype=response"),
             F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    rows.select(F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block).alias("value")) \
        .write.option("lineSep", END).option("compression", "gzip").text(path)


def _decided(rows: DataFrame, min_bytes: int, file_bytes: int) -> DataFrame:
    """Rows (id, url, digest, bytes, ...) with their payload's response, dealt out to files.

    Headers are aggregated by digest, so a payload that a third of all records holds is
    combined before the shuffle. Rows then meet their payload's response on (digest, salt):
    responses are one row a digest, repeated for every salt, and rows of a hot digest spread
    over all salts.
    """
    salts = 32
    headers = stage(rows.select("id", "url", "digest", "bytes"), "warc-headers")
    total = headers.agg(F.sum(F.col("bytes") + 1000)).first()[0]
    known = stage(originals(headers, min_bytes), "warc-originals")
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(salts)).cast("int"))
    both = salted.repartition(parts(total, file_bytes), "digest", "salt").join(
        known, ["digest", "salt"], "left")
    return both.withColumn("original", (F.col("bytes") < min_bytes) | F.col("response_id").isNull()
                           | F.col("id").eqNullSafe(F.col("response_id")))


def write_archive(records: DataFrame, path: str, min_bytes: int = 0,
                  file_bytes: int = FILE_BYTES) -> None:
    """Write records (id bigint, url, payload string) as deduplicated WARC files."""
    rows = (records.select(F.col("id").cast("bigint").alias("id"), _safe(F.col("url")).alias("url"),
                           F.coalesce("payload", F.lit("")).alias("payload"))
            .withColumns({"digest": base32_sha1(F.col("payload")),
                          "bytes": F.octet_length("payload").cast("bigint")}))
    _write(_decided(rows, min_bytes, file_bytes), path)


def _records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record; blocks are taken by Content-Length only."""
    at = 0
    while at < len(raw):
        stop = raw.index(b"\r\n\r\n", at)
        first, *lines = raw[at:stop].decode("utf-8", "surrogateescape").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(head["content-length"])
        yield head, raw[stop + 4:stop + 4 + size]
        at = stop + 4 + size + 4


def _row(head: dict[str, str], block: bytes) -> tuple:
    kind = head.get("warc-type", "")
    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
    digest = head.get("warc-payload-digest", "").rpartition(":")[2] or None
    if payload is not None:
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if digest not in (None, found):
            raise ValueError(f"payload of {head.get('warc-record-id')} does not match its digest")
        digest = found
    return (head.get("x-source-id"), kind, head.get("warc-target-uri"), head.get("x-refers-to-id"),
            digest, None if payload is None else len(payload), len(block), payload)


def read_archive(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Records of an archive: headers, digest and size, with the payload bytes if asked for."""
    names = [c.split()[0] for c in _HEADER.split(", ")] + ["payload"] * payloads

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for raw in batch["content"]:
                whole = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else bytes(raw)
                rows = [_row(h, b)[:len(names)] for h, b in _records(whole)]
                yield pd.DataFrame(rows, columns=names).astype(
                    {"payload_bytes": "Int64", "block_bytes": "Int64"})

    return (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
            .select("content").mapInPandas(parse, _HEADER + ", payload binary" * payloads))


def resolve(records: DataFrame) -> DataFrame:
    """Archive headers with every revisit joined, by digest, to its response.

    Responses are unique per digest; a hot digest on the revisit side is split by the
    adaptive skew join, as both sides are shuffled for it.
    """
    res = (records.filter("record_type = 'response'").groupBy("payload_digest")
           .agg(F.max(F.struct(F.col("record_id").cast("bigint").alias("id"), "payload_bytes"))
                .alias("r"))
           .select("payload_digest", F.col("r.id").alias("response_id"),
                   F.col("r.payload_bytes").alias("response_bytes")))
    res = stage(res, "warc-responses")
    revisit = F.col("record_type") == "revisit"
    return records.join(res, "payload_digest", "left").select(
        F.col("record_id").cast("bigint").alias("page_id"),
        F.coalesce("payload_bytes", "response_bytes").alias("payload_bytes"), "payload_digest",
        "record_type", F.when(revisit, F.col("response_id")).alias("refers_to"), "url")


def deduplicate_archive(spark: SparkSession, source: str, target: str, min_bytes: int = 0,
                        file_bytes: int = FILE_BYTES) -> None:
    """Rewrite an archive: equal payloads are kept once, revisits are resolved and re-pointed.

    Payloads move to the one record of each digest that keeps them, not to revisits.
    """
    records = stage(read_archive(spark, source, payloads=True), "warc-records")
    solved = stage(resolve(records.drop("payload")), "warc-resolved")
    if solved.filter("payload_bytes IS NULL").limit(1).count():
        raise ValueError("a revisit record without its response")
    rows = stage(_decided(solved.select(F.col("page_id").alias("id"), "url",
                                        F.col("payload_digest").alias("digest"),
                                        F.col("payload_bytes").alias("bytes")),
                          min_bytes, file_bytes), "warc-decided")
    bodies = (records.filter("record_type = 'response'")
              .select(F.col("payload_digest").alias("digest"), F.col("payload").cast("string"))
              .groupBy("digest").agg(F.first("payload").alias("payload")))
    files = parts(solved.agg(F.sum(F.col("payload_bytes") + 1000)).first()[0], file_bytes)
    kept = rows.filter("original").join(bodies, "digest", "left")
    rest = rows.filter("NOT original").withColumn("payload", F.lit(None).cast("string"))
    _write(kept.unionByName(rest).repartition(files, "digest", "salt"), target)


def pages_archive(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write a record per page to a new archive, read it back and resolve the revisits."""
    spark = pages.sparkSession
    path = keep_path(new_path(spark, "warc"))
    write_archive(pages.select(F.col("page_id").alias("id"), "url", F.col("html").alias("payload")),
                  path, min_bytes)
    return resolve(stage(read_archive(spark, path), "warc-read")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
