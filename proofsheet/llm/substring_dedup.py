"""Operator 1: removal of repeated word windows, with a Count-min prefilter.

A window is `window` consecutive words of one document. Every word covered by a window that also starts
anywhere else (another document, or elsewhere in the same one) is removed; windows are judged on the input.

Pass 1 counts. Equal windows have the same minimiser (the least hash among their word grams, leftmost at ties) at
the same place, so a minimiser occurs at least as often as any window around it: its Count-min estimate never
falls below the window's count. The sketches of partitions are merged as `repeats` says: with sixteen cells for each
minimiser, and documents meet them in joins at any size (unless `max_log2` allows to broadcast them).

Pass 2 is exact: the windows estimated as repeated, and only they, are grouped by minimiser and window hash (128
bits together). Inside a batch equal windows are folded into one representative first, so a passage that a third
of all documents share reaches its group a few times, not once a document. A fuller sketch lets more windows
through to pass 2; it never loses one.

Defined results: null or empty text has no words; a text shorter than the window keeps everything; rows with equal
doc_id and text repeat each other; rows with null doc_id are kept. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofsheet.llm import common as C
from proofsheet.llm.repeats import Hits, with_hits

cloudpickle.register_pickle_by_value(sys.modules[__name__])

GRAM = 8
SPAN = 4 << 20  # bytes of text that are worked on at a time
BROADCAST_BYTES = 32 << 20
PART_BYTES = 16 << 20  # of candidates in a shuffle partition


class Windows:
    """The windows of some texts, with the words and grams behind them."""

    def __init__(self, texts: list[bytes], window: int):
        gram = min(GRAM, window)
        size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        offset = np.concatenate(([0], np.cumsum(size)[:-1])) if len(texts) else np.empty(0, np.int64)
        buffer = np.frombuffer(b"\n".join(texts), np.uint8)
        start, end = C.word_bounds(buffer)
        words = C.word_hashes(buffer, start, end, 2)
        doc = np.searchsorted(offset, start, "right") - 1
        n = max(0, len(start) - window + 1)
        self.at = np.flatnonzero(doc[:n] == doc[window - 1:]) if n else np.empty(0, np.int64)
        self.doc = doc[self.at]
        self.start = self.at - np.searchsorted(start, offset)[self.doc]
        grams = C.window_hashes(words[0], gram, C.BASES[0])
        least = C.sliding_argmin(grams, window - gram + 1) if n else np.empty(0, np.int64)
        self.anchor_at = least[self.at]
        self.anchor = grams[self.anchor_at]
        self.grams, self.words, self.window = grams, words, window

    def hashes(self, which: np.ndarray) -> np.ndarray:
        return C.window_hashes(self.words[1], self.window, C.BASES[1])[self.at[which]]


def anchors_of(window: int):
    """The minimisers of texts, one for each place."""

    def run(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        w = Windows(texts, window)
        at, first = np.unique(w.anchor_at, return_index=True)
        return w.grams[at], w.doc[first]

    return run


PARTS = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("first", pa.int32()), ("kind", pa.int8()), ("data", pa.binary())])
PARTS_SQL = "key long, doc_id long, text_key long, first int, kind byte, data binary"
ALONE, SHARED, DONE = 0, 1, 2


def take(values: pa.Array, index: np.ndarray) -> pa.Array:
    return values.take(pa.array(index, pa.int64()))


def spans_by_doc(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive starts, given in order of (doc, start): the documents, where their runs begin, and the runs as pairs of int32."""
    first = np.flatnonzero(np.concatenate(([True], (np.diff(doc) != 0) | (np.diff(start) != 1))))
    pairs = np.stack([start[first], np.diff(np.concatenate((first, [len(start)])))], 1).astype(np.int32)
    head = np.flatnonzero(np.concatenate(([True], np.diff(doc[first]) != 0)))
    return doc[first][head], np.concatenate((head, [len(first)])), pairs


def candidate_batches(window: int, hits: Hits):
    """Windows whose cells all reached two, as ALONE rows (consecutive windows of a document around one minimiser), SHARED rows
    (hashes that the batch itself holds twice) and DONE rows (spans of windows that are settled by that)."""

    def run(batches):
        for batch, texts in C.rows_of(batches, SPAN):
            w = Windows(texts, window)
            which = np.flatnonzero(hits.of(batch, w.anchor, w.doc))
            if not len(which):
                continue
            anchor, h, doc, start = w.anchor[which], w.hashes(which), w.doc[which], w.start[which]
            order = np.lexsort((h, anchor))
            new = np.concatenate(([True], (np.diff(anchor[order]) != 0) | (np.diff(h[order]) != 0)))
            size = np.diff(np.concatenate((np.flatnonzero(new), [len(order)])))
            twice = np.zeros(len(which), bool)
            twice[order] = np.repeat(size > 1, size)
            ids, keys = batch.column(0), batch.column(1)
            # settled here
            if twice.any():
                at, cuts, pairs = spans_by_doc(doc[twice], start[twice])
                n = len(at)
                yield C.record(PARTS, np.arange(n) * 2654435761, take(ids, at), take(keys, at), np.full(n, -1, np.int32), np.full(n, DONE, np.int8), C.blobs(pairs.view("V8").ravel(), cuts))
                head = order[np.flatnonzero(new)[size > 1]]
                a, hh = anchor[head], h[head]
                cut = np.flatnonzero(np.concatenate(([True], np.diff(a) != 0)))
                n, none = len(cut), pa.nulls(len(cut), pa.int64())
                yield C.record(PARTS, a[cut].view(np.int64), none, none, np.full(n, -1, np.int32), np.full(n, SHARED, np.int8), C.blobs(hh, np.concatenate((cut, [len(a)]))))
            one = ~twice
            if one.any():
                anchor, h, doc, start = anchor[one], h[one], doc[one], start[one]
                cut = np.flatnonzero(np.concatenate(([True], (np.diff(anchor) != 0) | (np.diff(doc) != 0) | (np.diff(start) != 1))))
                n = len(cut)
                yield C.record(PARTS, anchor[cut].view(np.int64), take(ids, doc[cut]), take(keys, doc[cut]), start[cut].astype(np.int32), np.full(n, ALONE, np.int8), C.blobs(h, np.concatenate((cut, [len(h)]))))

    return run


DEALT = PARTS.append(pa.field("salt", pa.int64()))
#: Bytes of window hashes around one minimiser beyond which they are dealt by window hash too.
HOT_BYTES = 8 << 20


def by_window(batches):
    """Rows of hot minimisers, cut into one row a window, whose hash is the salt: equal windows still meet."""
    for batch in batches:
        n = np.fromiter((len(d) // 8 for d in batch["data"].to_pylist()), np.int64, batch.num_rows)
        if not n.sum():
            continue
        row = np.repeat(np.arange(len(n)), n)
        within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        h = np.frombuffer(b"".join(batch["data"].to_pylist()), np.uint64)
        first = batch["first"].to_numpy(zero_copy_only=False)[row] + np.where(batch["kind"].to_numpy(zero_copy_only=False)[row] == SHARED, 0, within)
        yield C.record(DEALT, take(batch["key"], row), take(batch["doc_id"], row), take(batch["text_key"], row), first.astype(np.int32), take(batch["kind"], row), C.blobs(h, np.arange(len(h) + 1)), h.view(np.int64))


def dealt(parts: DataFrame, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """parts with a salt: 0, but the window's hash around minimisers with more than `hot_bytes` of hashes. Those are at most the size of parts over hot_bytes, so they are broadcast."""
    load = parts.filter(F.col("kind") != DONE).groupBy("key").agg(F.sum(F.octet_length("data")).alias("bytes"))
    hot = F.broadcast(C.staged(load.filter(F.col("bytes") > hot_bytes).select("key"), "hot"))
    crowd = parts.filter(F.col("kind") != DONE).join(hot, "key", "left_semi").select(*PARTS.names)
    rest = parts.filter(F.col("kind") != DONE).join(hot, "key", "left_anti").unionByName(parts.filter(F.col("kind") == DONE))
    return rest.withColumn("salt", F.lit(0).cast("long")).unionByName(crowd.mapInArrow(by_window, PARTS_SQL + ", salt long"))


SPANS = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("spans", pa.binary())])


def group_windows(batches):
    """Exact grouping by (minimiser, window hash) of what one shuffle partition holds."""
    table = pa.Table.from_batches(list(batches), PARTS)
    kind = table["kind"].to_numpy()
    done = table.filter(pa.array(kind == DONE))
    yield from pa.table([done["doc_id"], done["text_key"], done["data"]], SPANS).to_batches()
    table = table.filter(pa.array(kind != DONE)).combine_chunks()
    if not table.num_rows:
        return
    data = table["data"].to_pylist()
    n = np.fromiter((len(d) // 8 for d in data), np.int64, len(data))
    h = np.frombuffer(b"".join(data), np.uint64)
    row = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
    key = table["key"].to_numpy()[row]
    shared = (table["kind"].to_numpy() == SHARED)[row]
    order = np.lexsort((h, key))
    new = np.concatenate(([True], (np.diff(key[order]) != 0) | (np.diff(h[order]) != 0)))
    group = np.cumsum(new) - 1
    weight = np.bincount(group, 1 + shared[order])
    twice = np.zeros(len(h), bool)
    twice[order] = weight[group] > 1
    twice &= ~shared
    if not twice.any():
        return
    row, start = row[twice], table["first"].to_numpy()[row[twice]] + within[twice]
    at, cuts, pairs = spans_by_doc(row, start)
    yield C.record(SPANS, take(table["doc_id"].combine_chunks(), at), take(table["text_key"].combine_chunks(), at), C.blobs(pairs.view("V8").ravel(), cuts))


KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])


def strip(window: int):
    def run(batches):
        for batch, texts in C.rows_of(batches):
            spans = batch.column(2).to_pylist()
            words, gone, kept = [], [], []
            for text, parts in zip(texts, spans):
                w = text.split()
                words.append(len(w))
                if parts:
                    cover = np.zeros(len(w) + 1, np.int64)
                    pairs = np.frombuffer(b"".join(parts), np.int32).reshape(-1, 2)
                    np.add.at(cover, pairs[:, 0], 1)
                    np.add.at(cover, pairs[:, 0] + pairs[:, 1] + window - 1, -1)
                    keep = np.cumsum(cover[:-1]) == 0
                    w = [w[i] for i in np.flatnonzero(keep)]
                gone.append(words[-1] - len(w))
                kept.append(b" ".join(w))
            yield C.record(KEPT, batch.column(0), words, gone, pa.array(kept, pa.binary()).cast(pa.string()))

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, max_log2: int = 0, broadcast_bytes: int = BROADCAST_BYTES, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one space) of every row."""
    spark = docs.sparkSession
    texts = C.source(docs, id_col, text_col)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    keyed = texts.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    ready, hits = with_hits(keyed, anchors_of(window), size / 80, 16, max_log2, SPAN)  # about one minimiser in fourteen words
    parts = C.staged(C.map_arrow(ready, candidate_batches(window, hits), PARTS_SQL), "parts")
    n = max(C.shuffle_partitions(spark), 1 + C.staged_bytes(parts) // PART_BYTES)
    found = dealt(parts, hot_bytes).repartition(n, "key", "salt").drop("salt").mapInArrow(group_windows, "doc_id long, text_key long, spans binary")
    spans = C.staged(found.groupBy("doc_id", "text_key").agg(F.collect_list("spans").alias("spans")), "spans")
    right = F.broadcast(spans) if C.staged_bytes(spans) <= broadcast_bytes else spans
    both = keyed.alias("d").join(right.alias("s"), C.same_row("d", "s"), "left").select("d.doc_id", "d.text", "s.spans")
    return C.map_arrow(both, strip(window), "doc_id long, n_words long, n_removed long, kept_text string")
