"""Operator 9: bottom-k fingerprints of documents, with DataFrame functions only.

A fingerprint is the k least of a text's distinct shingle hashes (five words; a text with fewer words is one
shingle, one without words has none). Fingerprints of parts merge into that of the whole, and two of them estimate
resemblance, containment and the number of distinct shingles. With fewer than k shingles the estimates are exact.

`edited_fingerprints` also needs the next document, by descending doc_id, of every document. Ids are cut into
ranges at quantiles of all ids, so many that a range holds about RANGE_BYTES of text (rows without an id are cut by
text hash): first into about the square root of so many coarse ones, then each of these by a row of its own quantiles,
so that there are as many ranges as the text asks for. Each range is sorted by itself, and gets a copy of the first
document of the range below, so every text is shuffled once and no range follows another's work.

Defined results: null text is empty; the likeness of two empty fingerprints is 1, of an empty and another one 0;
rows with equal doc_id follow each other by text hash; null doc_ids come last; the next document of a lone one is
itself; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofsheet.llm import common as C
from proofsheet.llm import native as N

K = 128
RANGE_BYTES = 16 << 20


def sketch(text: Column, k: int = K, words: int = 5) -> Column:
    """The k least distinct shingle hashes, ascending."""
    def of(w: Column) -> Column:
        some = F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) < words, F.array(F.xxhash64(F.array_join(w, " "))))
        return some.otherwise(F.slice(F.sort_array(F.array_distinct(N.shingle_hashes(w, words))), 1, k))

    return N.let(N.words(text), of)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of a text that holds the shingles of both."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of shingles in both among those in either."""
    both = lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b))
    return N.let(merged(a, b, k), lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(both(u) / F.size(u)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles."""
    share = (F.element_at(a, -1).cast("double") + F.lit(float(2**63))) / F.lit(float(2**64))
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too."""
    r = resemblance(a, b, k)
    shared = r * (distinct_shingles(a, k) + distinct_shingles(b, k)) / (1 + r)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    """A sketch as one string: 16 hex digits a hash."""
    return F.lower(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def halved(bounds: Column, most: int, value: Column) -> Column:
    """How many of at most `most` ascending bounds (an array) are below a value, by halving."""
    steps = [1 << i for i in reversed(range(max(1, most).bit_length()))]
    move = lambda at, step: F.when(F.coalesce(F.get(bounds, at + step - 1) < value, F.lit(False)), at + step).otherwise(at)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), move)


def with_ranges(rows: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """rows (doc_id, text_key, ...) with `part`, rising with doc_id, about `parts` of them; and how many there are at most."""
    each = max(1, math.isqrt(parts - 1) + 1) if parts > 1 else 1
    ids = rows.filter("doc_id is not null").select("doc_id")
    cuts = lambda n: F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 10 * n))
    coarse = sorted(set(ids.agg(cuts(each)).first()[0] or [])) if each > 1 else []
    place = halved(F.array(*map(F.lit, coarse)).cast("array<bigint>"), len(coarse), F.col("doc_id"))
    # rows without an id come after all others, by descending text hash: -1, -2, ...
    bits = max(1, (parts - 1).bit_length())
    nulls = F.shiftrightunsigned(F.col("text_key").bitwiseXOR(F.lit(-(2**63))), 64 - bits).cast("int") - (1 << bits)
    if each == 1:
        return rows.withColumn("part", F.when(F.col("doc_id").isNull(), nulls).otherwise(0)), 1 + (1 << bits)
    # a row of at most `each` bounds for each coarse range; Spark broadcasts it by its size, or joins
    fine = C.staged(ids.withColumn("coarse", place).groupBy("coarse").agg(cuts(each).alias("bounds")), "bounds")
    own = rows.withColumn("coarse", F.when(F.col("doc_id").isNotNull(), place)).join(fine, "coarse", "left")
    part = F.when(F.col("doc_id").isNull(), nulls).otherwise(F.col("coarse") * each + halved(F.col("bounds"), each, F.col("doc_id")))
    return own.withColumn("part", part).select(*rows.columns, "part"), each * each + (1 << bits)


def edited_fingerprints(docs: DataFrame, k: int = K, words: int = 5, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, n_chars, edited_text, sketch, edited_sketch, near_edited, near_next of every row.

    The edited text is the text with its last floor(n_chars / 3) code points replaced by the first as many of the next document.
    """
    own = C.source(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    own = own.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    own, ranges = with_ranges(own, max(1 + size // range_bytes, C.shuffle_partitions(docs.sparkSession)))
    heads = C.staged(own.groupBy("part").agg(F.max(F.struct("doc_id", "text_key")).alias("head")), "heads")  # a row a range
    by_part = Window.orderBy("part")
    below = heads.select("part", F.coalesce(F.lag("head").over(by_part), F.last("head").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("head"))
    below = below.select(F.col("part").alias("to_part"), "head.doc_id", "head.text_key")
    extra = own.alias("d").join(F.broadcast(below).alias("h"), C.same_row("d", "h")).select("d.doc_id", "d.text", "d.text_key", F.col("h.to_part").alias("part")).dropDuplicates(["part"])
    rows = own.withColumn("ahead", F.lit(False)).unionByName(extra.withColumn("ahead", F.lit(True)))
    rows = rows.repartition(ranges, "part").withColumn("sketch", sketch(F.col("text"), k, words))
    order = Window.partitionBy("part").orderBy("ahead", F.col("doc_id").desc_nulls_last(), F.desc("text_key"))
    rows = rows.select("*", F.lead(F.struct("text", "sketch")).over(order).alias("next")).filter(~F.col("ahead"))
    size = F.length("text")
    cut = F.floor(size / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), size - cut), F.substring(F.col("next.text"), F.lit(1), cut))
    rows = rows.select("doc_id", size.cast("long").alias("n_chars"), edited.alias("edited_text"), "sketch", F.col("next.sketch").alias("next_sketch"))
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited_text"), k, words))
    near = lambda c: resemblance(F.col("sketch"), F.col(c), k)
    return rows.select("doc_id", "n_chars", "edited_text", "sketch", "edited_sketch", near("edited_sketch").alias("near_edited"), near("next_sketch").alias("near_next"))
