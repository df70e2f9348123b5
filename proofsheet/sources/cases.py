"""Stored cases and their sinks: JSON scans with a fixed schema, reports as CSV and Markdown, append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FLAG = "struct<reason: string, note: string>"
REVIEW = f"struct<done: boolean, fields: map<string, struct<seen: boolean, flag: {FLAG}>>, rejection: struct<reasons: array<string>, note: string>>"
PACKET = f"struct<index: int, name: string, pages: array<int>, confidence: string, flags: array<string>, matchedBy: string, review: {REVIEW}>"
CASE = f"id string, name string, createdAt string, status string, pdfName string, rosterName string, error string, packets array<{PACKET}>, _corrupt_record string"
REVIEW_EVENTS = "case_id string, packet int, stt int, document string, to_status string, reason string, seq bigint"


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """All cases below a path; unreadable files are left out, and a case that was left processing is an error."""
    raw = spark.read.schema(CASE).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    good = raw.filter("id is not null").drop("_corrupt_record")
    orphan = F.col("status") == "processing"
    return good.withColumn("error", F.when(orphan, "interrupted").otherwise(F.col("error"))).withColumn("status", F.when(orphan, "error").otherwise(F.col("status")))


def newest_first(cases: DataFrame) -> DataFrame:
    return cases.orderBy(F.col("createdAt").desc_nulls_last(), "id")


def packets_of(cases: DataFrame) -> DataFrame:
    """A row per packet, with the number of fields seen and flagged."""
    p = cases.select(F.col("id").alias("case_id"), F.explode("packets").alias("p")).select("case_id", "p.*")
    values = F.coalesce(F.map_values("review.fields"), F.array())
    return p.withColumn("seen", F.size(F.filter(values, lambda f: F.coalesce(f["seen"], F.lit(False))))).withColumn("flagged", F.size(F.filter(values, lambda f: f["flag"].isNotNull()))).withColumn("done", F.coalesce("review.done", F.lit(False)))


def write_report_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("lineSep", "\r\n").option("quoteAll", False).option("escape", '"').csv(path)


def append_events(events: DataFrame, path: str) -> None:
    """Decisions are appended, never changed; the current state is the last record of each key."""
    events.write.mode("append").parquet(path)


def write_manifests(manifests: DataFrame, path: str) -> None:
    """One JSON line per packet, in a folder per case; a folder's files are committed together."""
    manifests.write.mode("overwrite").partitionBy("case_id").json(path)


def read_manifests(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """The manifests below a path, with file and error: the way back of write_manifests, or of whole files (multi_line).

    A record that is no JSON, or that is not of a manifest's shape, is a row with error (corrupt) and what could be read of it.
    """
    from proofsheet.operators.assembly import MANIFEST

    text = spark.read.schema("value string" if multi_line else "value string, case_id string").text(path, wholetext=multi_line, recursiveFileLookup=multi_line)
    shape = f"case_id string, packet int, {MANIFEST}, _corrupt_record string"
    seen = text.withColumn("m", F.from_json("value", shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})).withColumn("file", F.col("_metadata.file_path"))
    at = lambda k: F.nullif(F.regexp_extract("file", "([^/]+)/packets/([0-9]+)/[^/]+$", k), F.lit(""))  # noqa: E731  (<case>/packets/<packet>/manifest.json)
    case, packet = (F.coalesce("m.case_id", at(1)), F.coalesce("m.packet", at(2).cast("int"))) if multi_line else (F.col("case_id"), F.col("m.packet"))
    names = ("id", "name", "product", "heading", "status", "exempt", "docs", "fields")
    error = F.when(F.col("m").isNull() | F.col("m._corrupt_record").isNotNull(), "corrupt")
    return seen.select(case.alias("case_id"), packet.alias("packet"), *(F.col(f"m.{n}") for n in names), "file", error.alias("error"))
