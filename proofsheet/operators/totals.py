"""Printed totals read from the lines of a listing: in digits, in words, over wrapped cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofsheet.functions import text as T
from proofsheet.functions import values as V
from proofsheet.operators import layout, quotes

#: Folded labels of the total, the two words that announce it in words, how many lines a cell may go on below, and how far apart words of one of its lines may lie.
LABELS, SPELLED, GOES_ON, TOLERANCE = ("tong gia tri hang hoa", "dich vu mua vao", "mua vao:"), ("bang", "chu"), 3, 25


def first(a: Column, test) -> Column:
    return F.get(F.filter(a, test), F.lit(0))


def texts(line: Column) -> Column:
    return F.transform(line, lambda w: w["text"])


def announced(tokens: Column) -> Column:
    """Number of the token at which the words of the amount are announced; null without them."""
    bare = F.transform(tokens, lambda t: F.regexp_replace(T.fold_accents(t), "[^\\p{L}\\p{N}_]", ""))
    return layout.let(bare, lambda b: first(layout.upto(F.lit(0), F.size(b)), lambda i: (F.get(b, i) == SPELLED[0]) & (F.get(b, i + 1) == SPELLED[1])))


def spelled_out(line: Column, below: Column) -> Column:
    """The amount in words behind its announcement, up to the closing bracket; a cell that is not closed goes on over the lines below, up to the one that closes it."""
    closes = lambda tokens: F.exists(tokens, lambda t: F.contains(t, F.lit(")")))
    last = first(layout.upto(F.lit(0), F.size(below)), lambda i: closes(texts(F.get(below, i))))
    more = F.flatten(F.transform(F.slice(below, F.lit(1), F.coalesce(last + 1, F.size(below))), texts))
    own = texts(line)

    def amount(tokens: Column) -> Column:
        return layout.let(announced(tokens), lambda at: F.when(at.isNotNull(), behind(layout.rest(tokens, at + len(SPELLED)))))

    def behind(tail: Column) -> Column:
        stop = lambda t: first(layout.upto(F.lit(0), F.size(t)), lambda i: F.contains(F.get(t, i), F.lit(")")))
        said = layout.let(tail, lambda t: layout.let(F.coalesce(stop(t), F.size(t)), lambda n: F.concat(F.slice(t, F.lit(1), n), F.array(F.coalesce(F.split_part(F.get(t, n), F.lit(")"), F.lit(1)), F.lit(""))))))
        return quotes.spelled_amount(F.array_join(said, " "))

    return layout.let(F.when(announced(own).isNotNull() & closes(own), own).otherwise(F.concat(own, more)), amount)


def total_reads(pages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, line_no, digits, words, amount, reason, repaired, box, confidence of every line of page_rows' pages with a total's label.

    The amount counts if digits and words say the same or only one of them is there. Digits that do not read are taken
    for damaged if one way to repair them says what the words say; else they contradict the words.
    """
    y = lambda line: F.transform(line, lambda w: w["y"])
    each = F.transform("lines", lambda line, i: F.struct(i.alias("line_no"), line.alias("line"), F.slice(F.filter("lines", lambda m: F.array_min(y(m)) > F.array_max(y(line))), F.lit(1), F.lit(GOES_ON)).alias("below")))
    whole = F.array_join(layout.folded(F.col("line")), " ")
    x = pages.select(*keys, F.inline(each)).filter(F.greatest(*(F.contains(whole, F.lit(a)) for a in LABELS)))
    reads = lambda w: F.when(w["text"].rlike("[0-9]"), V.money_token(w["text"]))  # noqa: E731  (most words have no digit)
    x = x.withColumn("words", spelled_out(F.col("line"), F.col("below"))).withColumn("__money", first("line", lambda w: reads(w).isNotNull()))
    x = x.withColumn("digits", V.money_token(F.col("__money.text")))
    unsure = F.col("digits").isNull() & F.col("words").isNotNull()
    x = x.withColumn("__fixed", F.when(unsure, first("line", lambda w: F.array_contains(quotes.digit_repairs(w["text"]), F.col("words")))))
    broken = first("line", lambda w: w["text"].rlike("\\p{Nd}") & w["text"].rlike("[.,]") & reads(w).isNull())
    x = x.withColumn("__broken", F.when(unsure & F.col("__fixed").isNull(), broken))
    settled = quotes.settled_total(F.col("digits"), F.col("words"), F.when(F.col("__fixed").isNotNull(), F.array("words")).otherwise(F.array().cast("array<bigint>")))
    contradicted = F.struct(F.lit(None).cast("long").alias("amount"), F.lit("digits-and-words-disagree").alias("reason"), F.lit(False).alias("repaired"))
    x = x.withColumn("__t", F.when(F.col("__broken").isNotNull(), contradicted).otherwise(settled))
    seen = F.coalesce("__money", "__fixed", "__broken")
    mean = F.aggregate("line", F.lit(0.0), lambda n, w: n + w["conf"], lambda n: n / F.size("line"))
    sure = F.when(seen.isNotNull(), seen["conf"].cast("double")).when(F.col("words").isNotNull(), mean).otherwise(0.0)
    place = F.when(seen.isNotNull(), layout.box(F.array(seen)))
    digits = F.coalesce("digits", F.when(F.col("__fixed").isNotNull(), F.col("words")))
    return x.select(*keys, "line_no", digits.alias("digits"), "words", "__t.amount", "__t.reason", "__t.repaired", place.alias("box"), sure.alias("confidence"))
