"""Operator 6: site-relative line dedup, with DataFrame functions only.

A line (trimmed of ASCII white space) is boilerplate on a host if the host's pages that contain it are more than
`ratio` of all pages of that host, and at least `min_pages`. Boilerplate lines are dropped; lines without a word stay.

Each page adds a line once. Counting has map-side combine, so a line on every page of a huge host is one row per
task. A host has at most (mean lines a page / ratio) boilerplate lines, so the answer is one short array a host; it
is joined back by host, broadcast only if its measured size is small, and else as a join that Spark can split.
Lines are compared by 128 bits of hash.

Defined results: null text stays null, empty stays empty; a null host is one host; repeated rows are pages of their
own; a text of which every line is dropped becomes empty; a table without rows gives none. All columns of the input
are returned as they were, but for the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofsheet.llm import common as C
from proofsheet.llm import native as N

BROADCAST_BYTES = 8 << 20


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(N.SPACES))
    return F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit(1), bare).alias("b"))


def boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = 0.1, min_pages: int = 5) -> DataFrame:
    """host, drop: the keys of a host's boilerplate lines; hosts without any are left out."""
    pages = docs.select(F.col(f"`{host_col}`").cast("string").alias("host"), F.col(f"`{text_col}`").cast("string").alias("text"))
    total = pages.groupBy("host").agg(F.count("*").alias("pages"))
    total = C.staged(total, "hosts")
    own = F.array_distinct(F.transform(F.filter(N.lines(F.col("text")), N.has_word), line_key))
    counts = pages.select("host", F.explode(own).alias("key")).groupBy("host", "key").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    beside = F.broadcast(total) if C.staged_bytes(total) <= BROADCAST_BYTES else total
    often = counts.alias("c").join(beside.alias("t"), F.expr("c.host <=> t.host")).filter(F.col("n") > ratio * F.col("pages"))
    return often.groupBy(F.col("c.host").alias("host")).agg(F.collect_list("key").alias("drop"))


def line_dedup(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = 0.1, min_pages: int = 5) -> DataFrame:
    """docs with boilerplate lines taken out of the text, and n_lines and n_dropped (so named unless these names are taken)."""
    drop = C.staged(boilerplate(docs, host_col, text_col, ratio, min_pages), "boilerplate")
    beside = F.broadcast(drop) if C.staged_bytes(drop) <= BROADCAST_BYTES else drop
    names = {k: C.fresh(docs, k) for k in ("n_lines", "n_dropped")}
    every, left = C.fresh(docs, "lines_of_text"), C.fresh(docs, "lines_that_stay")
    both = docs.alias("d").join(beside.alias("b"), F.col(f"d.`{host_col}`").cast("string").eqNullSafe(F.col("b.host")), "left")
    text = F.col(f"d.`{text_col}`").cast("string")
    keep = lambda x: ~(N.has_word(x) & F.array_contains(F.col("b.drop"), line_key(x)))
    kept = F.when(F.col("b.drop").isNull(), N.lines(text)).otherwise(F.filter(N.lines(text), keep))
    columns = [F.col(f"d.`{c}`") for c in docs.columns if c != text_col]
    out = both.select(*columns, N.lines(text).alias(every), kept.alias(left))
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    final = {c: F.col(f"`{c}`") for c in docs.columns} | {text_col: F.array_join(left, "\n")}
    return out.select(*(v.alias(c) for c, v in final.items()), F.greatest(size(every), F.lit(0)).alias(names["n_lines"]), F.greatest(size(every) - size(left), F.lit(0)).alias(names["n_dropped"]))
