"""Content-addressed web archive: payloads stored once by digest, record headers kept apart, records rebuilt by joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder

#: The base32 alphabet (fixed value).
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"


@dataclass(frozen=True)
class Archive:
    """Folders of an archive: `headers` has a row per record, `payloads` a row per different payload."""

    headers: str
    payloads: str


def sha1_base32(payload: Column) -> Column:
    """SHA-1 of the bytes in base32, upper case: 160 bits are 32 letters, taken from 8 groups of 20 bits."""
    digest = F.sha1(payload)
    groups = [F.conv(F.substring(digest, 5 * g + 1, 5), 16, 10).cast("int") for g in range(8)]
    letters = [
        F.substring(F.lit(BASE32), F.shiftright(groups[i // 4], 15 - 5 * (i % 4)).bitwiseAND(F.lit(31)) + 1, F.lit(1))
        for i in range(32)
    ]
    return F.concat(*letters)


def _field(value: Column) -> Column:
    """A header value on one line: %, carriage return and line feed are percent-encoded, null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    for plain, coded in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def _unfield(text: Column) -> Column:
    for plain, coded in (("\n", "%0A"), ("\r", "%0D"), ("%", "%25")):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def write_archive(
    pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit_bytes: int = 0, folder: str | None = None,
) -> Archive:
    """Write one record per row of `pages`; the payload is the html in UTF-8 (empty for null).

    Payloads are stored once per SHA-256. Before a digest stands for its rows, their lengths, SHA-1 and xxhash64
    values must agree, else the write fails. Of records with equal payloads of at least `min_revisit_bytes` bytes
    the one with the largest page_id (null is smallest) is the response, the others revisit it; records with smaller
    payloads are all responses. Rows that agree in page_id, url and payload become as many records, numbered from 1;
    if the largest page_id occurs more than once, the smallest url's first record is the response.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    archive = Archive(f"{folder}/headers", f"{folder}/payloads")
    payload = F.coalesce(F.encode(F.col(html).cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    # a payload's bytes are shuffled once for each task that has it, not once for each record
    (
        rows.select("digest", "payload", F.octet_length("payload").alias("n"), F.xxhash64("payload").alias("x"))
        .groupBy("digest")
        .agg(F.first("payload").alias("payload"), F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
        .select(
            "digest",
            F.when((F.col("n0") == F.col("n1")) & (F.col("x0") == F.col("x1")), F.col("payload"))
            .otherwise(F.raise_error(F.concat(F.lit("different payloads have the digest "), F.col("digest"))).cast("binary"))
            .alias("payload"),
        )
        .write.parquet(archive.payloads)
    )
    records = (
        rows.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("n_bytes"), sha1_base32(F.col("payload")).alias("sha1"))
        .groupBy("page_id", "url", "digest", "n_bytes", "sha1")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    first = F.max(F.struct(F.coalesce("page_id", F.lit(-(2**63))).alias("id"))).alias("top")
    owners = records.groupBy(F.col("digest").alias("_digest")).agg(first)
    # ties on the largest page_id: the smallest url
    named = records.join(owners, F.col("digest") == F.col("_digest")).withColumn(
        "at_top", F.coalesce("page_id", F.lit(-(2**63))) == F.col("top.id")
    )
    tie = (
        named.where("at_top")
        .groupBy(F.col("digest").alias("_owned"))
        .agg(F.min(F.struct(F.col("url").isNull().alias("no_url"), F.col("url").alias("url"))).alias("owner"), F.first("page_id").alias("owner_id"))
    )
    numbered = (
        named.join(tie, F.col("digest") == F.col("_owned"))
        .withColumn("record", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
        .withColumn(
            "response",
            (F.col("n_bytes") < min_revisit_bytes)
            | (F.col("at_top") & F.col("url").eqNullSafe(F.col("owner.url")) & (F.col("record") == 1)),
        )
    )
    page_name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    lines = [
        F.lit("WARC/1.0"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("response"), "response").otherwise("revisit")),
        F.concat(F.lit("WARC-Record-ID: "), page_name("page_id")),
        F.concat(F.lit("WARC-Record-Number: "), F.col("record").cast("string")),
        F.when(F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), _field(F.col("url")))),
        F.when(~F.col("response"), F.concat(F.lit("WARC-Refers-To: "), page_name("owner_id"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(F.col("response"), F.col("n_bytes")).otherwise(0).cast("string")),
    ]
    header = F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF))  # concat_ws leaves nulls out
    numbered.select(F.encode(header, "UTF-8").alias("header"), "digest", F.col("n_bytes").alias("payload_length")).write.parquet(archive.headers)
    return archive


def _value(name: str) -> Column:
    header = F.decode("header", "UTF-8")
    return F.when(header.rlike(f"(?md)^{name}: "), F.regexp_extract(header, rf"(?md)^{name}: ([^\r\n]*)\r$", 1))


def _page(name: str) -> Column:
    return F.regexp_extract(F.coalesce(_value(name), F.lit("")), r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def read_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """Rebuild all records: page_id, url, record_type, refers_to, header, payload, payload_bytes, payload_digest, record.

    Every stored payload is hashed again, and a payload that isn't what its digest names fails the read; so do a
    record without its payload, and one whose length or SHA-1 isn't what its header says. `payload` is the full
    payload, of revisits too; `record` is the exact record, header, body and closing blank lines (a revisit has
    no body).
    """
    stored = spark.read.parquet(archive.payloads).withColumn("right", F.sha2("payload", 256) == F.col("digest"))
    stored = stored.select(
        F.when(F.col("right"), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest"))).cast("string")).alias("_digest"),
        "payload",
        F.octet_length("payload").cast("long").alias("_bytes"),
        sha1_base32(F.col("payload")).alias("_sha1"),
    )
    headers = spark.read.parquet(archive.headers)
    joined = headers.join(stored, F.col("digest") == F.col("_digest"), "left")
    said = F.concat(F.lit("sha1:"), F.col("_sha1"))
    agrees = (F.col("_bytes") == F.col("payload_length")) & (_value("WARC-Payload-Digest") == said)
    kind = _value("WARC-Type")
    return joined.select(
        _page("WARC-Record-ID").alias("page_id"),
        _unfield(_value("WARC-Target-URI")).alias("url"),
        F.when(agrees, kind).otherwise(F.raise_error(F.lit("a record and its payload disagree")).cast("string")).alias("record_type"),
        _page("WARC-Refers-To").alias("refers_to"),
        "header",
        "payload",
        F.col("_bytes").alias("payload_bytes"),
        F.col("_sha1").alias("payload_digest"),
        F.concat("header", F.when(kind == "response", F.col("payload")).otherwise(F.lit(b"")), F.lit(b"\r\n\r\n")).alias("record"),
    )
