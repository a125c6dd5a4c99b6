"""A content-addressed archive of WARC records, in DataFrame functions.

Two tables make an archive: `payloads` holds the bytes of every payload once,
under its sha256, and `records` the exact header bytes of every record with the
sha256 of its payload. A header is all that is kept of a record besides, so
types, ids and references are read from it, and whole records come back through
a join. The digest is verified twice: rows that share one must agree in length
and checksum when they are stored, and the stored bytes must give it again when
they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST_SHARED = 1000  # bytes; equal payloads below it stay responses of their own
RECORDS = "payload_id binary, header string"
PAYLOADS = "payload_id binary, payload binary, copies long, keeper long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EOL = "\r\n"


def write_archive(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write one record per row of pages(page_id, url, html) to the new folder `path`.

    The payload is the html in UTF-8 (null: no bytes). Of the records with equal
    payloads of LEAST_SHARED bytes or more, that with the largest page_id is a
    response and the others are revisits of it; all smaller ones are responses.
    Rows that repeat the page_id of a response with its payload are that
    response again. A null page_id is smaller than all; if all are null, all are
    responses. A null url leaves its field out; line ends in a url are written
    as %0D and %0A. Other columns are ignored; an empty table makes an empty
    archive. `date` is the WARC-Date of all records.
    """
    spark = pages.sparkSession
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).select(
        "page_id", "url", "payload", F.unhex(F.sha2("payload", 256)).alias("payload_id"),
        F.octet_length("payload").cast("long").alias("n"),
    )
    # partial aggregates leave one copy of a payload per task, also of one that a third of all rows have
    same = (F.min("n") == F.max("n")) & (F.min(F.crc32("payload")) == F.max(F.crc32("payload")))
    clash = F.raise_error(F.concat(F.lit("different payloads of one sha256: "), F.hex("payload_id")))
    rows.groupBy("payload_id").agg(
        F.any_value("payload").alias("payload"), F.count(F.lit(1)).alias("copies"), F.max("page_id").alias("keeper"), same.alias("same")
    ).select(
        "payload_id", "payload", F.when(F.col("same"), F.col("copies")).otherwise(clash.cast("long")).alias("copies"), "keeper"
    ).write.parquet(f"{path}/payloads")
    shared = (
        spark.read.schema(PAYLOADS).parquet(f"{path}/payloads")
        .filter((F.col("copies") > 1) & (F.octet_length("payload") >= LEAST_SHARED)).select("payload_id", "keeper")
    )
    heads = rows.select("page_id", "url", "payload_id", "n", F.sha1("payload").alias("sha1"))
    placed = heads.join(shared, "payload_id", "left")
    placed.select("payload_id", _header(date).alias("header")).write.parquet(f"{path}/records")


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(":"), F.col("sha1"), F.lit(">"))


def _header(date: str) -> Column:
    """WARC header and HTTP header of a record, up to its payload."""
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("n").cast("string"), F.lit(EOL * 2)
    )
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    fields = (
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        ("WARC-Record-ID", _record_id(F.col("page_id"))),
        ("WARC-Page-ID", F.col("page_id").cast("string")),
        ("WARC-Date", F.lit(date)),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        ("WARC-Refers-To", F.when(revisit, _record_id(F.col("keeper")))),
        ("WARC-Profile", F.when(revisit, PROFILE)),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n"))).cast("string")),
        ("WARC-Target-URI", url),
    )
    lines = [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(EOL)), F.lit("")) for name, value in fields]
    return F.concat(F.lit(f"WARC/1.1{EOL}"), *lines, F.lit(EOL), http)


def _field(name: str, pattern: str) -> Column:
    """The first group of the pattern in the value of a header field; null without the field."""
    found = F.regexp_extract("header", rf"{EOL}{name}: {pattern}", 1)
    return F.when(found != "", found)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest, header, payload, record, problem: one row per record.

    Everything but the payload comes from the header; payload_bytes and
    payload_digest (SHA-1) are those of the stored bytes, also for revisits.
    `record` is the record as a WARC file holds it. `problem` says why a record
    cannot be trusted (payload missing, stored bytes with another digest, header
    with another digest); it is null for sound ones.
    """
    stored = spark.read.schema(PAYLOADS).parquet(f"{path}/payloads").select(
        "payload_id", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"),
        (F.unhex(F.sha2("payload", 256)) == F.col("payload_id")).alias("sound"),
    )
    heads = spark.read.schema(RECORDS).parquet(f"{path}/records").select(
        "payload_id", "header", _field("WARC-Page-ID", r"(-?\d+)").cast("long").alias("page_id"),
        _field("WARC-Target-URI", r"([^\r\n]*)").alias("url"), _field("WARC-Type", r"(\w+)").alias("record_type"),
        _field("WARC-Refers-To", r"<urn:page:(-?\d+):").cast("long").alias("refers_to"),
        _field("WARC-Payload-Digest", r"sha1:(\w+)").alias("said"),
    )
    problem = (
        F.when(F.col("sound").isNull(), "payload is missing")
        .when(~F.col("sound"), "stored payload has another sha256")
        .when(F.col("said") != F.col("payload_digest"), "header names another payload digest")
    )
    own = F.when(F.col("record_type") == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload"))
    return heads.join(stored, "payload_id", "left").select(
        "page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "header", "payload",
        F.concat(F.col("header").cast("binary"), own, F.lit(EOL * 2).cast("binary")).alias("record"), problem.alias("problem"),
    )


def sound(records: DataFrame) -> DataFrame:
    """The records without `problem`; a record that has one raises an error."""
    fine = F.when(F.col("problem").isNull(), True).otherwise(F.raise_error(F.concat(F.lit("damaged record: "), "problem")).cast("boolean"))
    return records.filter(fine).drop("problem")
