"""Content-addressed WARC archive.

``write_archive`` stores each distinct payload once under its SHA-256, and every record's exact header bytes apart with
that digest. ``records`` rebuilds the exact bytes of the original records through the join of headers and payloads;
``read_archive`` rebuilds them so, parses each, and takes all it gives from the parsed record.

Of rows with equal payloads of at least ``least_bytes`` the one with the smallest page_id is the response and the
others revisit it; smaller payloads are all responses. Only digests and ids are grouped, a payload is taken once per
task and digest before the shuffle, and only responses are joined with payloads, so thousands of copies move one.

Defined results: a null html is an empty payload. Rows that repeat both page_id and payload are one record written
again and share its type. A null page_id comes after all others and is referred to only if all equal ones are null.
A null url is an empty target. An empty table gives an empty archive. Other columns are ignored. A changed or missing
payload makes ``verified`` false for its response and all its revisits.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_hot, new_path, staged, written

#: The capture time in all headers, so that writing again gives the same bytes.
DATE = "2024-01-01T00:00:00Z"
#: What a record's id begins with; its page_id and a closing bracket follow.
URN = "<urn:x-page:"
#: The base32 alphabet. A fixed value.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(digest: Column) -> Column:
    """Base32 of a hexadecimal digest whose length is a multiple of ten bytes' (SHA-1: 40 digits to 32 characters)."""
    out = []
    for k in range(8):  # five hexadecimal digits are 20 bits, four characters
        value = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(ALPHABET), F.shiftright(value, 15 - 5 * j).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for j in range(4)]
    return F.concat(*out)


def _lines(*pairs: tuple[str, Column]) -> Column:
    return F.concat(F.lit("WARC/1.1\r\n"), *[F.concat(F.lit(f"{k}: "), v, F.lit("\r\n")) for k, v in pairs], F.lit("\r\n"))


def record_id(page_id: Column) -> Column:
    """The urn of a page's record."""
    return F.concat(F.lit(URN), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def header(page_id: Column, url: Column, kind: Column, digest: Column, size: Column, refers_to: Column) -> Column:
    """The exact header text of a record; a revisit has no block of its own."""
    common = [("WARC-Record-ID", record_id(page_id)), ("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", F.regexp_replace(F.coalesce(url, F.lit("")), "[\r\n]", "%0A")), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest))]
    revisit = [("WARC-Type", F.lit("revisit")), ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("WARC-Refers-To", record_id(refers_to)), *common, ("Content-Length", F.lit("0"))]
    response = [("WARC-Type", F.lit("response")), *common, ("Content-Type", F.lit("text/html; charset=utf-8")), ("Content-Length", size.cast("string"))]
    return F.when(kind == "revisit", _lines(*revisit)).otherwise(_lines(*response))


def write_archive(pages: DataFrame, path: str, least_bytes: int = 0) -> str:
    """Write ``payloads`` (sha256, first page, uses, payload) and ``headers`` (sha256, header bytes)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    key = F.unhex(F.sha2(payload, 256)).alias("sha256")
    stored = pages.select(key, F.col("page_id").cast("long").alias("page_id"), payload.alias("payload"))
    written(stored.groupBy("sha256").agg(F.min("page_id").alias("first_page"), F.count("*").alias("uses"), F.encode(F.first("payload"), "utf-8").alias("payload")), f"{path}/payloads")
    store = _payloads(pages.sparkSession, path).select("sha256", "first_page", "uses")
    rows = pages.select(key, F.col("page_id").cast("long").alias("page_id"), "url", F.octet_length(payload).cast("long").alias("size"), base32_of_hex(F.sha1(payload)).alias("sha1"))
    joined = join_hot(rows, store, "sha256", "uses")
    again = ~F.col("page_id").eqNullSafe(F.col("first_page")) & (F.col("size") >= least_bytes)
    text = header(F.col("page_id"), F.col("url"), F.when(again, "revisit").otherwise("response"), F.col("sha1"), F.col("size"), F.col("first_page"))
    written(joined.select("sha256", F.encode(text, "utf-8").alias("header")), f"{path}/headers")
    return path


def _payloads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("sha256 binary, first_page long, uses long, payload binary").parquet(f"{path}/payloads")


def records(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, record): the exact bytes of each record, headers joined with payloads; a missing payload leaves an empty block."""
    heads = spark.read.schema("sha256 binary, header binary").parquet(f"{path}/headers")
    revisit = F.decode("header", "utf-8").startswith("WARC/1.1\r\nWARC-Type: revisit\r\n")  # the order that :func:`header` writes
    end = F.lit(b"\r\n\r\n")
    with_block = heads.filter(~revisit).join(_payloads(spark, path).select("sha256", "payload"), "sha256", "left")
    return with_block.select("sha256", F.concat("header", F.coalesce("payload", F.lit(b"")), end).alias("record")).unionByName(heads.filter(revisit).select("sha256", F.concat("header", end).alias("record")))


def parsed_records(found: DataFrame) -> DataFrame:
    """From (sha256, record): page_id, record_type, refers_to, payload_digest, payload_bytes and ``ok``, all out of the record's bytes.

    ``ok``: the record ends as it should, its length is the one it names, and a response's block has the SHA-1 it
    names and the SHA-256 it is stored under.
    """

    def number(urn: str) -> int | None:
        digits = urn.removeprefix(URN).removesuffix(">")
        return int(digits) if digits.lstrip("-").isdigit() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for key, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                head, _, rest = record.partition(b"\r\n\r\n")
                fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                block, kind, named = rest[:-4], fields.get("WARC-Type"), fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")
                ok = rest[-4:] == b"\r\n\r\n" and fields.get("Content-Length") == str(len(block))
                digest = named
                if kind == "response":
                    digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
                    ok = ok and digest == named and hashlib.sha256(block).digest() == key
                row = (key, number(fields.get("WARC-Record-ID", "")), kind, number(fields.get("WARC-Refers-To", "")), digest, len(block), ok)
                for c, v in zip(cols, row):
                    c.append(v)
            kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["sha256", "page_id", "record_type", "refers_to", "payload_digest", "payload_bytes", "ok"])

    return found.mapInArrow(run, "sha256 binary, page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, ok boolean")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, verified, all from the rebuilt records.

    A revisit has no block: its payload's length is that of the response it refers to, whose digest must be the same.
    """
    rows = staged(parsed_records(records(spark, path)), "records")
    responses = rows.filter(F.col("record_type") == "response")
    firsts = responses.groupBy("sha256").agg(F.min("page_id").alias("r_page"), F.first("payload_bytes").alias("r_bytes"), F.first("payload_digest").alias("r_digest"), F.bool_and("ok").alias("r_ok"))
    firsts = staged(firsts.join(_payloads(spark, path).select("sha256", "uses"), "sha256"), "responses")
    revisits = join_hot(rows.filter(F.col("record_type") == "revisit"), firsts, "sha256", "uses", "left")
    good = F.col("ok") & F.col("r_ok") & (F.col("payload_digest") == F.col("r_digest")) & F.col("refers_to").eqNullSafe(F.col("r_page"))
    out = revisits.select("page_id", F.col("r_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", F.coalesce(good, F.lit(False)).alias("verified"))
    return out.unionByName(responses.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("ok").alias("verified")))


def op9_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archive(spark, write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_path(spark, "warc")))
