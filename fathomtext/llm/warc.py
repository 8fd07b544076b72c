"""A content-addressed WARC archive: payload bytes once, exact record headers apart.

``write`` makes two tables under a folder: ``payloads`` (digest, payload) holds every
distinct payload once, ``headers`` (page_id, copy, digest, header) holds each record's
header bytes as they stand in a WARC 1.1 file. ``read`` verifies each stored payload
against its SHA-256, parses the headers and joins them; ``records`` joins header and
payload bytes back into the original records.

Of records with equal payloads of at least ``LEAST`` bytes the one with the smallest page_id
is the response, the others revisit it; smaller ones are all responses.

Defined cases: null html has an empty payload; a null page_id comes last; of repeated rows,
and of equal page_ids, one record (smallest url, first copy) is the response and the others
revisit it; a null url leaves the target line out; line ends inside a url are written
percent-encoded; an empty table makes an empty archive; other columns aren't archived.

A revisit names its response by the response's record id (WARC-Refers-To), so any reader can
resolve it; the response's page_id stands in a field of its own beside that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomtext.llm._spark import drop, keep
from fathomtext.llm.mixing import unfold

LEAST = 100
DATE = "2024-02-29T00:00:00Z"


def _urn(record: Column) -> Column:
    return F.concat(F.lit("<urn:sha1:"), record, F.lit(">"))


def _record(page_id: Column, url: Column, copy: Column) -> Column:
    """A record's name: digest of its page, url, payload digest and copy number."""
    return F.sha1(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("null")), F.coalesce(url, F.lit("")), "digest", copy.cast("string")))


def _header(kind: Column) -> Column:
    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(name + ": "), value, F.lit("\r\n"))

    revisit = F.col("record_type") == "revisit"
    nothing = F.lit("")
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    return F.encode(
        F.concat(
            F.lit("WARC/1.1\r\n"),
            line("WARC-Type", kind),
            line("WARC-Record-ID", _urn(F.col("record"))),
            line("WARC-Date", F.lit(DATE)),
            F.coalesce(line("WARC-Target-URI", url), nothing),
            line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
            F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", _urn(F.col("refers_record"))), F.coalesce(line("X-Refers-To-Page", F.col("refers").cast("string")), nothing))).otherwise(nothing),
            line("Content-Type", F.lit("text/html; charset=utf-8")),
            line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
            F.lit("\r\n"),
        ),
        "UTF-8",
    )


def write(pages: DataFrame, path: str) -> None:
    """Archive the pages under ``path``: one pass over pages for the payloads, one for a narrow table that headers are made from."""
    own = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    own = own.withColumn("digest", F.sha2("payload", 256))
    own.groupBy("digest").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")
    # equal rows are counted before the shuffle and unfolded after it
    rows = keep(own.groupBy("page_id", "url", "digest", F.octet_length("payload").cast("bigint").alias("bytes")).agg(F.count("*").alias("n")), "records")
    order = F.struct(F.col("page_id").isNull().alias("a"), F.col("page_id").alias("b"), F.col("url").isNull().alias("c"), F.col("url").alias("d"))
    # both sides of the join are written tables, so Spark can split a digest that very many pages have
    first = keep(rows.where(F.col("bytes") >= LEAST).groupBy("digest").agg(F.min(order).alias("m")), "responses")
    joined = unfold(rows.join(first, "digest", "left"), "n")
    response = (F.col("bytes") < LEAST) | ((F.col("copy") == 0) & (order == F.col("m")))
    joined = joined.withColumn("record_type", F.when(response, "response").otherwise("revisit")).withColumn("refers", F.when(~response, F.col("m.b")))
    joined = joined.withColumn("record", _record(F.col("page_id"), F.col("url"), F.col("copy"))).withColumn("refers_record", _record(F.col("m.b"), F.col("m.d"), F.lit(0)))
    joined.select("page_id", "copy", "digest", _header(F.col("record_type")).alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")
    drop(rows, first)


def _field(name: str) -> Column:
    found = F.regexp_extract(F.decode("header", "UTF-8"), rf"\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """digest, payload of the archive; a payload that isn't what its digest says fails the read."""
    p = spark.read.parquet(f"{path}/payloads")
    good = F.sha2("payload", 256) == F.col("digest")
    return p.select("digest", F.when(good, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest"))).cast("binary")).alias("payload"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records parsed from the archive: page_id, copy, record_type, payload_digest, payload_bytes, refers_to, target_uri, content_length."""
    h = spark.read.parquet(f"{path}/headers")
    kind = h.schema["page_id"].dataType
    sizes = payloads(spark, path).select("digest", F.octet_length("payload").cast("bigint").alias("payload_bytes"))
    h = h.select("page_id", "copy", _field("WARC-Type").alias("record_type"), F.regexp_extract(_field("WARC-Payload-Digest"), "^sha256:(.*)$", 1).alias("digest"), _field("X-Refers-To-Page").alias("r"), _field("WARC-Target-URI").alias("target_uri"), _field("Content-Length").cast("bigint").alias("content_length"))
    return h.join(sizes, "digest").select("page_id", "copy", "record_type", F.col("digest").alias("payload_digest"), "payload_bytes", F.col("r").cast(kind).alias("refers_to"), "target_uri", "content_length")


def records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, copy, record: the bytes of each record as in a WARC file, with its payload unless it is a revisit."""
    h = spark.read.parquet(f"{path}/headers").withColumn("own", F.when(_field("WARC-Type") == "response", F.col("digest")))
    p = payloads(spark, path).withColumnRenamed("digest", "own")
    end = F.encode(F.lit("\r\n\r\n"), "UTF-8")
    return h.join(p, "own", "left").select("page_id", "copy", F.concat("header", F.coalesce("payload", F.lit(b"")), end).alias("record"))
