"""Reviewers' lists: lifecycle, attention, filters, resubmission, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofsheet.functions import text as T
from proofsheet.functions.session import plain_unions


def lifecycle(seen: Column, flagged: Column, done: Column) -> Column:
    """unseen, reviewing, completed or flagged, from the number of fields seen and flagged and whether the review is done."""
    return F.when(flagged > 0, "flagged").when(done, "completed").when(seen > 0, "reviewing").otherwise("unseen")


def attention_reasons(matched_by: Column, flags: Column) -> Column:
    """Why a packet should be looked at first, in a fixed order, each once."""
    of_match = {"unmatched": "not on the roster", "name": "matched by name only", "no-roster": "no roster"}
    of_flag = {"auto-merged": "cover merged", "near-threshold": "uncertain boundary", "length-out-of-range": "unusual length", "no-roster-match": "no roster line", "inferred-boundary": "inferred boundary", "roster-unmatched": "not on the roster", "duplicate-roster-identity": "same person twice"}
    tests = [F.when(matched_by == k, v) for k, v in of_match.items()] + [F.when(F.array_contains(flags, k), v) for k, v in of_flag.items()]
    return F.array_distinct(F.array_compact(F.array(*tests)))


def needs_resubmit(rejected: Column, n_flags: Column, standing: Column) -> Column:
    """A rejection, a flag, or a standing decision of no or missing (standing: array of statuses). A weak match does not count."""
    return rejected | (n_flags > 0) | F.arrays_overlap(standing, F.array(F.lit("no"), F.lit("missing")))


def needs_resubmit_in_report(rejected: Column, n_flags: Column, matched_by: Column) -> Column:
    """The report's own rule, in which a match by name or none counts."""
    return rejected | (n_flags > 0) | matched_by.isin("name", "unmatched")


def case_status(base: Column, packets: Column, done: Column, touched: Column) -> Column:
    return F.when(base.isin("processing", "error"), base).when((packets > 0) & (done == packets), "done").when(touched > 0, "in_review").otherwise("ready")


def filter_packets(packets: DataFrame, name: str = "", ai: str | None = None, reviewer: str | None = None, missing: bool | None = None, commitment: bool | None = None) -> DataFrame:
    """Packets whose name contains the text (any case) and which equal the given choices; an unknown commitment fits neither choice."""
    tests = [F.contains(F.lower(T.text_of(F.col("name"))), F.lit(name.lower()))] if name else []
    tests += [F.col(c) == v for c, v in (("ai_status", ai), ("fa_status", reviewer), ("has_commitment", commitment)) if v is not None]
    if missing is not None:
        tests.append((F.size("missing") > 0) == missing)
    return reduce(lambda df, t: df.filter(t), tests, packets)


def exception_first(fields: DataFrame, severity: Column) -> list[Column]:
    """Sort order: the worst verdict first, then page and place (unknown last), then as given."""
    return [severity, F.col("page").asc_nulls_last(), F.col("y").asc_nulls_last(), F.col("idx")]


#: Columns of the resubmission report, in order.
REPORT = ("case_id", "packet", "name", "family", "item", "document", "page", "status", "note")


def report_rows(*families: DataFrame) -> DataFrame:
    """One table of the report's row families; columns that a family lacks are empty."""
    def filled(df: DataFrame) -> DataFrame:
        return df.select(*(T.text_of(F.col(c)).alias(c) if c in df.columns else F.lit("").alias(c) for c in REPORT))

    return plain_unions(reduce(DataFrame.unionByName, map(filled, families)))


def absent_documents(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, document, blocks: documents that are missing and the criteria that wait for them, ascending."""
    gone = cells.filter("status = 'missing'")
    return gone.groupBy(*keys, "document").agg(F.array_sort(F.collect_set("stt")).alias("blocks"))


def markdown(rows: DataFrame, keys: list[str], line: Column, order: list[str]) -> DataFrame:
    """keys, text: the lines of a group in order; groups are single reports, so one fits a row."""
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))).alias("x"))
    return listed.select(*keys, F.array_join(F.col("x.line"), "\n").alias("text"))


def progress(packets: DataFrame, keys: list[str]) -> DataFrame:
    """keys, done, total, flagged (to be sent again) and candidates (with findings): packets: keys, done, resubmit, findings (null: not evaluated)."""
    return packets.groupBy(*keys).agg(F.count_if(F.coalesce("done", F.lit(False))).alias("done"), F.count("*").alias("total"), F.count_if(F.coalesce("resubmit", F.lit(False))).alias("flagged"), F.count_if(F.coalesce("findings", F.lit(0)) > 0).alias("candidates"))
