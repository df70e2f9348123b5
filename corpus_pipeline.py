"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, redaction of personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents,
with n_chars as the length of the text that is left. The last returns a row for each packed piece.

Defined results: a null or empty text fails the quality rules; of rows with equal doc_id and text the rules keep all or
none, near dedup one; rows without doc_id are never near-duplicates; other columns stay as they are, whatever their
names; a table without rows gives one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofsheet.llm import common as C
from proofsheet.llm.line_dedup import line_dedup
from proofsheet.llm.minhash_dedup import near_duplicates
from proofsheet.llm.packing import best_fit_packing
from proofsheet.llm.pii import redacted
from proofsheet.llm.quality import quality_rules

BROADCAST_BYTES = 16 << 20


def _without(docs: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """docs without the rows whose keys `gone` has; null equals null."""
    gone = C.staged(gone.select(*keys).distinct(), "gone")
    beside = F.broadcast(gone) if C.staged_bytes(gone) <= BROADCAST_BYTES else gone
    return docs.alias("d").join(beside.alias("g"), C.same_row("d", "g", keys), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; of rows with equal doc_id and text all or none."""
    verdicts = quality_rules(docs)
    key = C.fresh(docs, "text_key")
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    return _without(keyed, verdicts.filter(~F.col("kept")).withColumnRenamed("text_key", key), ["doc_id", key]).drop(key)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go."""
    return line_dedup(docs).select(*docs.columns).withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of least doc_id; of rows with equal doc_id one stays."""
    out = _without(docs, near_duplicates(docs).filter(~F.col("kept")), ["doc_id"])
    if not docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        out = out.filter("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(out.filter("doc_id is null"))
    return out


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind."""
    return redacted(docs).withColumn("n_chars", F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096, best-fit packed."""
    import public_tokenizers

    return best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json")).drop("ids")


STAGES = [("quality rules", quality), ("line dedup", lines), ("near dedup", near_dedup), ("personal data", personal_data), ("packing", packing)]
#: SQL cannot express near-duplicate search, trained trees and tokenization; tests hold stages and run() against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage; each stage's output is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = C.staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
