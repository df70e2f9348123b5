"""Operator 3: near-duplicate detection by MinHash, banding, verification and connected components.

A document's set is its distinct `words`-word shingles (as 64-bit hashes) after lower-casing A-Z; with fewer words
the whole sequence is its one shingle; without words it is empty and linked with nothing.

1. Signatures: `bands` * `rows` minima of universal hashes. There are so many bands of `rows` that a pair at the
   threshold shares none with probability below 1e-6 (20 at 0.85: 4e-7; 27 at 0.8: 7e-7), more similar ones less.
2. Documents with equal sets are one class, represented by its least doc_id; copies never become pairs.
3. In each band bucket all representatives are compared with one pivot: a bucket of n makes n - 1 pairs. Pairs
   whose signatures agree too little for the threshold are dropped (probability below 1e-12 for a true link), and
   the rest are verified on full sets; the shared pivot's set is held once while its partners stream past.
4. Components are built from the links. Only pairs in one bucket and still in different components can matter.
   Round 2 compares such members with one other pivot a bucket. The rest is settled exactly without pairing whole
   buckets: among the members of buckets that still hold several components, each document's shingles are put in
   one order, rare ones first, and two similar documents must share one early in both orders. Only documents that
   do become pairs, so a crowd of copies that all differ too much yields none. Nothing is capped.

Defined results: null and empty texts have no shingles and are their own component; rows with equal doc_id and text
fall in one class; rows with null doc_id take part in no class and have a null component. Empty tables give empty
results; other columns are ignored. Rows with equal doc_id and different texts are not told apart: one of the texts,
no particular one, stands for that id in its class.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofsheet.llm import common as C
from proofsheet.llm.components import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BROADCAST_BYTES = 16 << 20
SALT = 500  # partners of one pivot that a verification group holds


def shingles(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, one after another, and the cuts between texts."""
    size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    offset = np.cumsum(size) - size
    buffer = np.frombuffer(b"\n".join(texts).lower(), np.uint8)
    start, end = C.word_bounds(buffer)
    h = C.word_hashes(buffer, start, end)[0]
    doc = np.searchsorted(offset, start, "right") - 1
    n = max(0, len(h) - words + 1)
    whole = np.flatnonzero(doc[:n] == doc[words - 1:]) if n else np.empty(0, np.int64)
    value, owner = C.window_hashes(h, words, C.BASES[0])[whole], doc[whole]
    count = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(count) - count
    few = np.flatnonzero((count > 0) & (count < words))
    short = np.array([int(C.mix(np.array([sum(int(x) * pow(C.BASES[1], j + 1, 1 << 64) for j, x in enumerate(h[first[d]:first[d] + count[d]])) + int(count[d]) & (1 << 64) - 1], np.uint64))[0]) for d in few], np.uint64)
    value, owner = np.concatenate((value, short)), np.concatenate((owner, few))
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (np.diff(value) != 0) | (np.diff(owner) != 0)
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(len(texts) + 1))


SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_1", pa.int64()), ("set_2", pa.int64()), ("signature", pa.binary())])
SIGNED_SQL = "doc_id long, n_shingles long, set_1 long, set_2 long, signature binary"


def sign_batches(words: int, hashes: int):
    def run(batches):
        a = C.byte_table(11, hashes) | np.uint64(1)
        c = C.byte_table(12, hashes)
        for batch, texts in C.rows_of(batches, 1 << 20):
            value, cuts = shingles(texts, words)
            n = np.diff(cuts)
            full = np.flatnonzero(n)
            first = cuts[:-1][full]
            low = np.zeros((len(texts), hashes), np.uint32)
            sums = np.zeros((2, len(texts)), np.uint64)
            if len(full):
                for k in range(hashes):
                    low[full, k] = np.minimum.reduceat(a[k] * value + c[k], first) >> np.uint64(32)
                for k in range(2):
                    sums[k][full] = np.add.reduceat(C.mix(value ^ C.byte_table(20 + k)[0]), first)
            yield C.record(SIGNED, batch.column(0), n, sums[0].view(np.int64), sums[1].view(np.int64), C.blobs(low.ravel(), np.arange(len(texts) + 1) * hashes))

    return run


BANDED = pa.schema([("bucket", pa.int64()), ("rep", pa.int64()), ("n", pa.int64())])


def band_batches(bands: int, rows: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            low = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, bands, rows).astype(np.uint64)
            key = np.broadcast_to(C.mix(np.arange(1, bands + 1, dtype=np.uint64)), low.shape[:2]).copy()
            for r in range(rows):
                key = C.mix(key ^ low[:, :, r])
            yield C.record(BANDED, key.ravel().view(np.int64), np.repeat(batch.column(0).to_numpy(), bands), np.repeat(batch.column(1).to_numpy(), bands))

    return run


def agreeing(least: int):
    """Pairs whose signatures agree in at least so many places."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for i in (2, 3))
                keep = pa.array((x == y).sum(1) >= least)
                yield C.record(schema, batch.column(0).filter(keep), batch.column(1).filter(keep))

    return run


LINKED = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def verify_sorted(words: int, percent: int):
    """Rows arrive sorted by (a, salt, role): a pivot's text, then its partners'. Columns: a, salt, b (null: the pivot), text."""

    def run(batches):
        pivot, own = None, np.empty(0, np.uint64)
        for batch, texts in C.rows_of(batches):
            value, cuts = shingles(texts, words)
            left, right = [], []
            for i, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                s = value[cuts[i]:cuts[i + 1]]
                if b is None:
                    pivot, own = a, s.copy()
                elif a == pivot:
                    same = len(np.intersect1d(own, s, assume_unique=True))
                    if same and 100 * same >= percent * (len(own) + len(s) - same):
                        left.append(a)
                        right.append(b)
            if left:
                yield C.record(LINKED, left, right)

    return run


def _beside(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its files are small enough."""
    return F.broadcast(df) if C.staged_bytes(df) <= BROADCAST_BYTES else df


def _verified(pairs: DataFrame, reps: DataFrame, texts: DataFrame, words: int, percent: int, least: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar enough."""
    spark = pairs.sparkSession
    n = C.shuffle_partitions(spark)
    signed = reps.select("rep", "signature")
    near = pairs.join(signed.withColumnRenamed("signature", "x"), pairs.a == F.col("rep")).drop("rep")
    near = near.join(signed.withColumnRenamed("signature", "y"), near.b == F.col("rep")).select("a", "b", "x", "y")
    near = C.staged(C.map_arrow(near, agreeing(least), "a long, b long"), "near")
    many = near.groupBy("a").agg(F.count("*").alias("partners"))
    salted = near.join(many, "a").withColumn("salts", F.expr(f"1 + partners div {SALT}"))
    salted = salted.select("a", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"), "b")
    salted = C.staged(salted, "salted")
    wanted = salted.select("a", "salt", "b", F.col("b").alias("doc_id"))
    pivots = salted.select("a", "salt").distinct().select("a", "salt", F.lit(None).cast("long").alias("b"), F.col("a").alias("doc_id"))
    wanted = C.staged(wanted.unionByName(pivots), "wanted")
    dealt = texts.join(_beside(wanted), "doc_id").select("a", "salt", "b", "text").repartition(n, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return C.staged(C.map_arrow(dealt, verify_sorted(words, percent), "a long, b long"), "links")


TOKENS = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("part", pa.int64()), ("token", pa.int64())])


def token_batches(words: int):
    def run(batches):
        for batch, texts in C.rows_of(batches, 1 << 20):
            value, cuts = shingles(texts, words)
            times = np.diff(cuts)
            yield C.record(TOKENS, *(np.repeat(batch.column(i).to_numpy(), times) for i in range(3)), value.view(np.int64))

    return run


def _early_sharers(members: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) of members (rep, n, part) in different parts that can be similar, by prefix and position.

    Put every document's shingles in one order. If x is not larger than y and they are similar, their first common
    shingle lies so early in both that what follows can still make up the overlap. Shingles that only one member has
    come first in the order and match nothing, so they need not be joined, only counted.
    """
    own = texts.join(_beside(members), texts.doc_id == members.rep).select("rep", "n", "part", "text")
    tokens = C.map_arrow(own, token_batches(words), "rep long, n long, part long, token long")
    often = tokens.groupBy("token").agg(F.count("*").alias("times"), F.min("part").alias("low"), F.max("part").alias("high"))
    often = often.filter("times > 1").select("token", "times", (F.col("low") < F.col("high")).alias("mixed"))
    order = Window.partitionBy("rep").orderBy("times", "token")
    whole = Window.partitionBy("rep")
    placed = tokens.join(often, "token").withColumn("rank", F.dense_rank().over(order))
    placed = placed.withColumn("at", F.col("n") - F.max("rank").over(whole) + F.col("rank") - 1).filter("mixed")
    placed = C.staged(placed.filter(f"100 * at <= (100 - {percent}) * n").select("rep", "n", "part", "token", "at"), "placed")
    small = placed.filter(f"{100 + percent} * (n - at) >= {2 * percent} * n")
    large = placed.select("token", F.col("rep").alias("b"), F.col("n").alias("m"), F.col("part").alias("other"), F.col("at").alias("place"))
    fits = f"part <> other and n <= m and 100 * n >= {percent} * m and {100 + percent} * least(n - at, m - place) >= {percent} * (n + m)"
    return small.join(large, "token").filter(fits).select(F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, bands: int | None = None, rows: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (doc_id is the least of its component) of every row.

    Documents are linked if 100 * intersection >= percent * union of their sets.
    """
    texts = C.source(docs, id_col, text_col)
    if bands is None:
        bands = max(20, math.ceil(math.log(1e-6) / math.log(1 - min(0.999, percent / 100) ** rows)))
    hashes = bands * rows
    # seven standard deviations below what a link at the threshold expects
    p = percent / 100
    least = max(rows, int(hashes * p - 7 * (hashes * p * (1 - p)) ** 0.5))
    signed = C.staged(C.map_arrow(texts, sign_batches(words, hashes), SIGNED_SQL), "signed")
    of_set = ["n_shingles", "set_1", "set_2"]
    full = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy(*of_set).agg(F.min("doc_id").alias("rep"))
    reps = full.join(classes, of_set).filter("doc_id = rep").dropDuplicates(["rep"]).select("rep", F.col("n_shingles").alias("n"), "signature")
    reps = C.staged(reps, "reps")
    banded = C.map_arrow(reps.select("rep", "n", "signature"), band_batches(bands, rows), "bucket long, rep long, n long")
    shared = banded.groupBy("bucket").agg(F.count("*").alias("size"), F.min("rep").alias("pivot")).filter("size > 1").select("bucket", "pivot")
    crowd = C.staged(banded.join(shared, "bucket"), "crowd")  # members of buckets of two or more
    # one text for each representative: of repeated rows with its id, the one in its class has the same set
    alone = texts.filter("doc_id is not null")

    fits = f"100 * least(n, m) >= {percent} * greatest(n, m)"
    size_of = reps.select(F.col("rep").alias("pivot"), F.col("n").alias("m"))
    pairs = crowd.filter("rep <> pivot").select("pivot", "rep", "n").distinct().join(size_of, "pivot").filter(fits)
    pairs = C.staged(pairs.select(F.col("pivot").alias("a"), F.col("rep").alias("b")), "pairs")
    links = _verified(pairs, reps, alone, words, percent, least)
    tried, found = pairs, links
    parts = C.staged(components(found.select(F.col("a").alias("u"), F.col("b").alias("v"))), "parts")
    for rest in (False, True):
        named = crowd.join(_beside(parts), crowd.rep == parts.node, "left").select("bucket", "rep", "n", F.coalesce("component", "rep").alias("part"))
        split = named.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.min(F.col("rep").bitwiseXOR(F.col("bucket"))).alias("key"))
        split = split.filter("low < high").select("bucket", F.col("key").bitwiseXOR(F.col("bucket")).alias("pivot"))
        if rest:
            members = C.staged(named.join(split, "bucket").select("rep", "n", "part").distinct(), "open")
            pairs = _early_sharers(members, alone, words, percent)
        else:
            of_pivot = named.select("bucket", F.col("rep").alias("pivot"), F.col("n").alias("m"), F.col("part").alias("other"))
            pairs = named.join(split.join(of_pivot, ["bucket", "pivot"]), "bucket").filter("part <> other").filter(fits).select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b"))
        pairs = C.staged(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            continue
        tried = tried.unionByName(pairs)
        links = _verified(pairs, reps, alone, words, percent, least)
        if not links.isEmpty():
            found = found.unionByName(links)
            parts = C.staged(components(found.select(F.col("a").alias("u"), F.col("b").alias("v"))), "parts")

    out = signed.select("doc_id", *of_set).join(classes, of_set, "left")
    out = out.join(_beside(parts), F.col("rep") == F.col("node"), "left")
    out = out.withColumn("component_id", F.coalesce("component", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
