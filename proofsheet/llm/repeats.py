"""Which anchors occur more than once in a corpus: Count-min sketches of partitions, merged by shard.

An anchor is a 64-bit hash that stands for something in a text. Counters stop at two, which is all the question needs,
and never underestimate. Each batch of texts is a sparse partition sketch; a shard adds up the cells of its range.

While the merged sketch (a bit for each cell that reached two) is small, it is broadcast. Beyond `max_log2` there is
one row of cells, as many as the corpus needs; the cells stay where they were counted, and documents meet the full ones
in joins, so no task holds more than its share, and the share of cells that fill by chance stays as it is at any size.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofsheet.llm import common as C

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHARDS = 64
ROWS = 2

#: Of a list of texts, the anchors and the number of each one's text.
Anchors = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


def cells(anchor: np.ndarray, row: int, log2: int) -> np.ndarray:
    return C.mix(anchor + np.uint64(0x632BE59BD9B4E019 * (row + 1) & (2**64 - 1))) >> np.uint64(64 - log2)


SKETCH = pa.schema([("row", pa.int32()), ("shard", pa.int32()), ("cells", pa.binary())])
SKETCH_SQL = "row int, shard int, cells binary"


def sketch_batches(anchors_of: Anchors, log2: int, most: int):
    """Cells that a batch hits, ascending, one or two times each; kept as low and high halves of their differences."""

    def run(batches):
        for _, texts in C.rows_of(batches, most):
            anchors, _ = anchors_of(texts)
            out = []
            for row in range(ROWS):
                cell, count = np.unique(cells(anchors, row, log2).astype(np.uint32), return_counts=True)
                cell = np.repeat(cell, np.minimum(count, 2))
                cuts = np.searchsorted(cell >> np.uint32(log2 - 6), np.arange(SHARDS + 1))
                for k, (a, z) in enumerate(zip(cuts[:-1], cuts[1:])):
                    if z > a:
                        step = np.diff(cell[a:z] & np.uint32((1 << (log2 - 6)) - 1), prepend=np.uint32(0))
                        out.append((row, k, (step & np.uint32(0xFFFF)).astype(np.uint16).tobytes() + (step >> np.uint32(16)).astype(np.uint16).tobytes()))
            if out:
                yield C.record(SKETCH, *map(list, zip(*out)))

    return run


def merge_sketches(log2: int):
    """Running totals, stopped at two, of the cells that each shard was sent."""
    size = 1 << (log2 - 6)

    def run(batches):
        seen: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row, shard, data in zip(*(c.to_pylist() for c in batch.columns)):
                one, two = seen.setdefault((row, shard), (np.zeros(size // 8, np.uint8), np.zeros(size // 8, np.uint8)))
                low, high = np.frombuffer(data, np.uint16).reshape(2, -1).astype(np.uint32)
                cell, count = np.unique(np.cumsum(low | high << np.uint32(16), dtype=np.uint32), return_counts=True)
                byte, bit = cell >> np.uint32(3), (1 << (cell & np.uint32(7))).astype(np.uint8)
                again = (count > 1) | ((one[byte] & bit) > 0)
                np.bitwise_or.at(two, byte[again], bit[again])
                np.bitwise_or.at(one, byte, bit)
        for (row, shard), (_, two) in seen.items():
            yield C.record(SKETCH, [row], [shard], [two.tobytes()])

    return run


def full_cells(texts: DataFrame, anchors_of: Anchors, log2: int, most: int) -> np.ndarray:
    """The merged sketch: one bit for each cell that was hit at least twice. Its size depends on log2 alone."""
    n = C.shuffle_partitions(texts.sparkSession)
    parts = C.map_arrow(texts.select("text"), sketch_batches(anchors_of, log2, most), SKETCH_SQL)
    out = np.zeros((ROWS, SHARDS, (1 << (log2 - 6)) // 8), np.uint8)
    for r in parts.repartition(n, "row", "shard").mapInArrow(merge_sketches(log2), SKETCH_SQL).toLocalIterator():
        out[r.row, r.shard] = np.frombuffer(r.cells, np.uint8)
    return out.reshape(ROWS, -1)


HITS = pa.schema([("cell", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("times", pa.int8())])


def cell_batches(anchors_of: Anchors, log2: int, most: int):
    """The cells of each document, once each."""

    def run(batches):
        for batch, texts in C.rows_of(batches, most):
            anchors, doc = anchors_of(texts)
            if not len(anchors):
                continue
            cell = cells(anchors, 0, log2)
            order = np.lexsort((cell, doc))
            cell, doc = cell[order], doc[order]
            first = np.flatnonzero(np.concatenate(([True], (np.diff(doc) != 0) | (cell[1:] != cell[:-1]))))
            times = np.minimum(np.diff(np.concatenate((first, [len(cell)]))), 2)
            at = pa.array(doc[first], pa.int64())
            yield C.record(HITS, cell[first].view(np.int64), batch.column(0).take(at), batch.column(1).take(at), times.astype(np.int8))

    return run


class Hits:
    """Whether anchors of a batch may occur more than once."""

    def __init__(self, log2: int, shared=None):
        self.log2, self.shared = log2, shared

    def of(self, batch: pa.RecordBatch, anchor: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """doc: the row of each anchor in the batch."""
        if self.shared is not None:
            hit = np.ones(len(anchor), bool)
            for row in range(ROWS):
                cell = cells(anchor, row, self.log2)
                hit &= (self.shared.value[row][cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            return hit
        own = batch.column(batch.schema.get_field_index("cells"))
        row = np.repeat(np.arange(batch.num_rows, dtype=np.uint64), own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        key = lambda cell, i: C.mix(cell ^ C.mix(i + np.uint64(1)))
        return np.isin(key(cells(anchor, 0, self.log2), doc.astype(np.uint64)), key(own.flatten().to_numpy().astype(np.int64).view(np.uint64), row))


def with_hits(texts: DataFrame, anchors_of: Anchors, anchors: float, cells_each: int, max_log2: int, most: int) -> tuple[DataFrame, Hits]:
    """texts (doc_id, text_key, text) as `Hits.of` needs them, and the Hits. anchors: about how many there are."""
    log2 = max(16, math.ceil(math.log2(max(1, anchors * cells_each))))
    if log2 <= max_log2:
        return texts, Hits(log2, texts.sparkSession.sparkContext.broadcast(full_cells(texts, anchors_of, log2, most)))
    log2 = min(63, log2 + 1)
    own = C.map_arrow(texts, cell_batches(anchors_of, log2, most), "cell long, doc_id long, text_key long, times byte")
    full = own.groupBy("cell").agg(F.sum("times").alias("n")).filter("n > 1").select("cell")
    found = own.join(full, "cell", "left_semi").groupBy("doc_id", "text_key").agg(F.collect_set("cell").alias("cells"))
    both = texts.alias("d").join(found.alias("f"), C.same_row("d", "f"), "left").select("d.doc_id", "d.text_key", "d.text", "f.cells")
    return both, Hits(log2)
