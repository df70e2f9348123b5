"""Operator 12: hard negatives by Fagin's threshold algorithm.

Every component becomes the whole number floor(256 c); a score is the integer inner product with the anchor, higher ones
come first, ties by smaller id (a null id last, then by place in the input). An anchor's positives are its best other
rows of the same label; for each positive, its negatives are the best rows of another label whose score lies between
`low` and `high` percent of the positive's.

Candidates are dealt by row number into buckets of bounded size, whatever their labels, and anchors into chunks; a task
gets one chunk and one bucket. There each dimension's candidates are sorted once; an anchor reads the lists from the end
that its component's sign prefers, all at equal depth, scores every row it meets by random access, and stops once the
threshold (its product with the values at that depth) is strictly below the kth score of each of its windows, or below
the window's lower end: nothing that it has not met can enter. The first pass, over the anchor's own label, finds the
positives; the second, with their windows, the negatives. The best of each bucket meet in a ranked window that keeps at
most k rows a task and anchor before the shuffle. Equal rows lie in different buckets, so no label, vector or id is hot.

Defined results: rows with a null label, or a vector that is null or holds null or non-finite entries, take no part, nor
do vectors of another length than the most common one; rows with equal ids are separate rows, and an anchor is no
partner of itself alone; an anchor without positives, or a positive without negatives in its window, gives no row (so
does one of negative score, whose window is empty). Values are saturated at long, scores of saturated values as well.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofsheet.llm import common as C
from proofsheet.llm.vectors import matrix, whole_vectors

BUCKET = 16384  # candidates of a task at most, about
CHUNK = 4096  # anchors of a task, about
DEPTH = 16  # of the first round of sorted access; each round doubles it


def saturated(scores: np.ndarray) -> np.ndarray:
    """Scores within long; only Python's numbers can be beyond."""
    return np.clip(scores, -(1 << 63), (1 << 63) - 1) if scores.dtype == object and len(scores) else scores


class Lists:
    """The candidates of a bucket with their sorted lists, one a dimension and direction."""

    def __init__(self, x: np.ndarray) -> None:
        n, d = x.shape
        self.x = x
        order = np.argsort(x, axis=0, kind="stable").T.astype(np.int32)
        self.order = np.stack((order[:, ::-1], order))  # for components of at least 0, below 0
        depths = [DEPTH]
        while depths[-1] < n:
            depths.append(depths[-1] * 2)
        self.depths = [min(t, n) for t in depths]
        last = self.order[:, :, [t - 1 for t in self.depths]]
        self.last = x[last, np.arange(d)[None, :, None]]

    def threshold(self, a: np.ndarray) -> np.ndarray:
        """For each depth, a bound for the score of every row that is not met by then."""
        side = (a < 0).astype(int)
        return a @ self.last[side, np.arange(len(a))]

    def met(self, a: np.ndarray, enough: Callable[[np.ndarray, object], bool], limit: object, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The rows met by sorted access, and their scores, when `enough(scores, threshold)` first holds; no depth above `limit` can end it."""
        dims = np.flatnonzero(a)
        side = (a[dims] < 0).astype(int)
        seen = np.zeros(len(self.x), bool) if allowed is None else ~allowed
        rows, scores, start = [], [], 0
        bounds = saturated(self.threshold(a))
        for depth, bound in zip(self.depths, bounds):
            if bound >= limit and depth < len(self.x):
                continue
            if not len(dims):  # all scores are 0, nothing tells the rows apart
                fresh = np.flatnonzero(~seen)
                seen[:] = True
            else:
                before = seen.copy()
                seen[self.order[side, dims, start:depth]] = True
                fresh = np.flatnonzero(seen & ~before)
            start = depth
            rows.append(fresh)
            scores.append(saturated(self.x[fresh] @ a))
            if depth < len(self.x) and enough(np.concatenate(scores), bound):
                break
        return np.concatenate(rows), np.concatenate(scores)


def kth(scores: np.ndarray, k: int) -> object:
    return np.partition(scores, len(scores) - k)[len(scores) - k]


def numbers(x: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in a type in which their inner products are exact: doubles below 2^53, longs below 2^63, else Python's numbers."""
    most = x.shape[1] * max(1, *(abs(int(v)) for v in (x.min(), x.max()))) * max(1, *(abs(int(v)) for v in (a.min(), a.max()))) if x.size and a.size else 0
    kind = float if most < 1 << 53 else np.int64 if most < 1 << 63 else object
    return x.astype(kind), a.astype(kind)


def best(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """The k first positions by score, id and place."""
    if len(rows) > k:
        keep = np.flatnonzero(scores >= kth(scores, k))  # with all ties
    else:
        keep = np.arange(len(rows))
    r = rows[keep]
    return keep[np.lexsort((place[r], ids[r], no_id[r], -scores[keep]))[:k]]


FOUND = pa.schema([("anchor", pa.int64()), ("pos", pa.int32()), ("row", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
FOUND_SQL = "anchor long, pos int, row long, id long, score long"


def unpacked(t: pa.Table, x: str) -> np.ndarray:
    return np.frombuffer(b"".join(t[x].to_pylist()), np.int64).reshape(t.num_rows, -1)


def ids_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    c = t["id"].combine_chunks()
    return c.fill_null(0).to_numpy(zero_copy_only=False), c.is_null().to_numpy(zero_copy_only=False)


def positives_in(k: int) -> Callable:
    """The k best rows of each anchor's own label in a bucket."""
    def run(anchors: pa.Table, bucket: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if anchors.num_rows and bucket.num_rows:
            x, a = numbers(unpacked(bucket, "x"), unpacked(anchors, "v"))
            ids, no_id = ids_of(bucket)
            place = bucket["row"].to_numpy()
            labels, wanted = (np.array(c.to_pylist(), object) for c in (bucket["label"], anchors["own"]))
            mine = anchors["of"].to_numpy()
            for label in set(wanted.tolist()):
                at = np.flatnonzero(labels == label)
                if not len(at):
                    continue
                lists = Lists(x[at])
                for i in np.flatnonzero(wanted == label):
                    other = place[at] != mine[i]
                    enough = lambda s, bound: len(s) >= k and bound < kth(s, k)
                    rows, scores = lists.met(a[i], enough, float("inf"), other)
                    for j in best(rows, scores, ids[at], no_id[at], place[at], k):
                        r = at[rows[j]]
                        out.append((int(mine[i]), 0, int(place[r]), None if no_id[r] else int(ids[r]), int(scores[j])))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 5, FOUND)], schema=FOUND)

    return run


def negatives_in(k: int, low: int, high: int) -> Callable:
    """The k best rows of another label in a bucket, for each window of each anchor."""
    def run(anchors: pa.Table, bucket: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if anchors.num_rows and bucket.num_rows:
            x, a = numbers(unpacked(bucket, "x"), unpacked(anchors, "v"))
            ids, no_id = ids_of(bucket)
            place = bucket["row"].to_numpy()
            labels, own = (np.array(c.to_pylist(), object) for c in (bucket["label"], anchors["own"]))
            other = {label: labels != label for label in set(own.tolist())}
            lists = Lists(x)
            for i, (row, windows) in enumerate(zip(anchors["of"].to_pylist(), anchors["windows"].to_pylist())):
                windows = [int(w) for w in windows]
                ends = {w: (-(-low * w // 100), high * w // 100) for w in windows}  # the whole scores within
                ends = {w: e for w, e in ends.items() if e[0] <= e[1]}
                if not ends:
                    continue

                def enough(s: np.ndarray, bound: object) -> bool:
                    for least, most in ends.values():
                        within = s[s <= most]
                        if not (bound < least or len(within) >= k and bound < kth(within, k)):
                            return False
                    return True

                rows, scores = lists.met(a[i], enough, min(most for _, most in ends.values()), other[own[i]])
                for pos, w in enumerate(windows):
                    if w in ends:
                        within = np.flatnonzero((scores >= ends[w][0]) & (scores <= ends[w][1]))
                        for j in best(rows[within], scores[within], ids, no_id, place, k):
                            r = rows[within[j]]
                            out.append((row, pos, int(place[r]), None if no_id[r] else int(ids[r]), int(scores[within[j]])))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 5, FOUND)], schema=FOUND)

    return run


PACKED = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("label", pa.string()), ("anchor", pa.bool_()), ("x", pa.binary())])


def packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            x = matrix(b.column(4))
            yield C.record(PACKED, *(b.column(i) for i in range(4)), C.blobs(x.ravel(), np.arange(len(x) + 1) * x.shape[1]))


def top(found: DataFrame, k: int) -> DataFrame:
    """The k first of each anchor and window, numbered from 1."""
    order = Window.partitionBy("anchor", "pos").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    df: DataFrame, anchors: Column | None = None, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
    id_col: str = "vec_id", vec_col: str = "embedding", label: Column | None = None, bucket_rows: int | None = None, chunk_rows: int = CHUNK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; anchors are by default the rows whose id is divisible by 100."""
    spark = df.sparkSession
    key = F.col(f"`{id_col}`").cast("long")
    anchors = key % 100 == 0 if anchors is None else anchors
    label = F.col("label") if label is None else label
    kept = {"row": F.monotonically_increasing_id(), "id": key, "label": label.cast("string"), "anchor": F.coalesce(anchors, F.lit(False))}
    rows, _ = whole_vectors(df.filter(label.isNotNull()), kept, vec_col)
    rows = C.staged(C.map_arrow(rows, packed_rows, "row long, id long, label string, anchor boolean, x binary"), "vectors")
    n, asked = rows.agg(F.count("*"), F.count(F.when(F.col("anchor"), 1))).first()
    tasks = C.shuffle_partitions(spark)
    size = bucket_rows or max(1024, min(BUCKET, n // (2 * tasks)))
    buckets, chunks = -(-n // size) or 1, -(-asked // chunk_rows) or 1
    dealt = lambda c, m, row: F.pmod(F.xxhash64(F.lit(c), F.col(row)), F.lit(m)).cast("int").alias(c)
    every = lambda c, m: F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(c)
    parts = max(tasks, min(buckets * chunks, 4 * tasks))
    right = rows.select("row", "id", "label", "x", dealt("bucket", buckets, "row"), every("chunk", chunks)).repartition(parts, "chunk", "bucket")

    def meet(asking: DataFrame, f: Callable) -> DataFrame:
        left = asking.select("*", dealt("chunk", chunks, "of"), every("bucket", buckets)).repartition(parts, "chunk", "bucket")
        return left.groupBy("chunk", "bucket").cogroup(right.groupBy("chunk", "bucket")).applyInArrow(f, FOUND_SQL)

    asking = rows.filter("anchor").select(F.col("row").alias("of"), F.col("label").alias("own"), F.col("x").alias("v"), F.col("id").alias("anchor_id"))
    near = C.staged(top(meet(asking.drop("anchor_id"), positives_in(positives)), positives), "positives")
    windows = near.groupBy("anchor").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda r: r["score"]).alias("windows"))
    far = top(meet(asking.join(windows, F.col("of") == F.col("anchor")).select("of", "own", "v", "windows"), negatives_in(negatives, low, high)), negatives)
    near = near.select(F.col("anchor").alias("to"), (F.col("rank") - 1).alias("to_pos"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = far.join(near, (F.col("anchor") == F.col("to")) & (F.col("pos") == F.col("to_pos"))).join(asking.select("of", "anchor_id"), F.col("anchor") == F.col("of"))
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
