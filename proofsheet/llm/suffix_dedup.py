"""Operator 2: removal of repeated byte strings by a distributed difference-cover suffix sort.

Every byte covered by a `width`-byte string that also starts in a document with a smaller doc_id is removed;
strings are judged on the input, overlaps count, and none crosses documents.

Spark deals out the suffixes so that equal strings meet: the minimiser of a `width`-byte string (the least hash of
its grams, leftmost at ties) depends on its bytes only, so consecutive strings around one minimiser travel together
as a short context, keyed by the minimiser. Strings whose minimiser occurs once in the corpus (by the merged sketches
of `repeats`, which never underestimate) equal no other and stay at home. Equal contexts fold into the one of least
doc_id, in each batch before the shuffle and again after it, so a passage that a third of all documents share is a few
rows, not one a document.

Each task then sorts the suffixes of its distinct contexts, a bounded number of bytes at a time, by the
difference-cover algorithm for {1, 2} modulo 3: sort the triples at sampled positions, name them, recurse on the
names (until names span `width` bytes), sort the remaining suffixes by first byte and the rank behind it, merge.
Neighbours in that order that agree in `width` bytes are compared by doc_id. A minimiser with more than `hot_bytes` of
contexts in one task is passed on instead: its strings, one by one, are grouped by their bytes in a join of their own.

Defined results: null and empty texts have no bytes; a text shorter than `width` stays; documents with equal doc_id
do not remove each other's bytes; null doc_ids count as larger than all others and as equal. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofsheet.llm import common as C
from proofsheet.llm.repeats import Hits, with_hits

cloudpickle.register_pickle_by_value(sys.modules[__name__])

GRAM = 24
SPAN = 1 << 20  # bytes of text that are worked on at a time
STEP = 1 << 15  # bytes that are hashed at a time
CHUNK = 1 << 19  # bytes of contexts whose suffixes are sorted at a time
HOT_BYTES = 4 << 20
PART_BYTES = 32 << 20  # of text for each shuffle partition
BROADCAST_BYTES = 32 << 20
LAST = 2**63 - 1


# ---------------------------------------------------------------- difference cover

def suffix_order(s: np.ndarray, depth: int) -> np.ndarray:
    """Positions of s (values from 1 on) in the order of their suffixes, right for at least `depth` values; later ties are arbitrary."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: tuple(s[i:])), np.int64)
    t = np.concatenate((s, np.zeros(4, s.dtype)))
    sampled = np.arange(n + (n % 3 == 1))
    sampled = sampled[sampled % 3 > 0]
    sampled = np.concatenate((sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]))
    top = int(t.max()) + 1
    pair = t[sampled + 1] * top + t[sampled + 2]
    if top**3 < 2**62:
        order = np.argsort(t[sampled] * (top * top) + pair, kind="stable")
    else:
        order = np.lexsort((pair, t[sampled]))
    a, b = t[sampled][order], pair[order]
    new = np.concatenate(([True], (np.diff(a) != 0) | (np.diff(b) != 0)))
    names = np.empty(len(sampled), np.int64)
    names[order] = np.cumsum(new)
    if depth > 3 and not new.all():
        order = suffix_order(names, math.ceil(depth / 3))
    first = sampled[order]
    rank = np.zeros(n + 4, np.int64)
    rank[first] = np.arange(1, len(first) + 1)
    first = first[first < n]
    rest = np.arange(0, n, 3)
    m = len(sampled) + 2
    rest = rest[np.argsort(t[rest] * m + rank[rest + 1], kind="stable")]
    # merge: compare by one value and the rank behind it, or by two where only that rank is sampled
    one = lambda i: t[i] * m + rank[i + 1]
    if top * top * m < 2**62:
        two = lambda i: (t[i] * top + t[i + 1]) * m + rank[i + 2]
        key_1, key_2 = one(rest), two(rest)
        mod_1 = first % 3 == 1
        below = np.where(mod_1, np.searchsorted(key_1, one(first)), np.searchsorted(key_2, two(first)))
    else:
        lead, at = np.unique(np.concatenate((t[rest] * top + t[rest + 1], t[first] * top + t[first + 1])), return_inverse=True)
        two_rest, two_first = at[:len(rest)] * m + rank[rest + 2], at[len(rest):] * m + rank[first + 2]
        below = np.where(first % 3 == 1, np.searchsorted(one(rest), one(first)), np.searchsorted(two_rest, two_first))
    below = np.maximum.accumulate(below)
    out = np.empty(n, np.int64)
    slot = below + np.arange(len(first))
    out[slot] = first
    free = np.ones(n, bool)
    free[slot] = False
    out[free] = rest
    return out


def packed(b: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number; b ends in at least seven bytes of padding."""
    out = np.zeros(len(b) - 7, np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | b[k:len(b) - 7 + k]
    return out


def smaller_elsewhere(contexts: list[bytes], docs: np.ndarray, width: int) -> list[np.ndarray]:
    """For each of some distinct contexts the offsets of its strings that also occur in a context with a smaller doc."""
    size = np.fromiter(map(len, contexts), np.int64, len(contexts))
    start = np.cumsum(size + 1) - size - 1
    b = np.frombuffer(b"\0".join(contexts) + b"\0" * (width + 8), np.uint8)
    n = int(size.sum()) + len(size)
    # 0 ends a context and is a byte too: both sort alike, and only strings inside a context are compared
    order = suffix_order(b[:n].astype(np.int64) + 1, width)
    owner = np.repeat(np.arange(len(size)), size + 1)
    offset = np.arange(n) - start[owner]
    order = order[(offset <= size[owner] - width)[order]]
    if not len(order):
        return [np.empty(0, np.int64)] * len(contexts)
    words = packed(b)
    new = np.ones(len(order), bool)
    for k in [*range(0, width - 8, 8), width - 8]:  # width is 8 at least
        new[1:] &= words[order[1:] + k] == words[order[:-1] + k]
    new[1:] = ~new[1:]
    head = np.flatnonzero(new)
    least = np.minimum.reduceat(docs[owner[order]], head)
    group = np.cumsum(new) - 1
    gone = np.sort(order[docs[owner[order]] > least[group]])
    cuts = np.searchsorted(gone, np.concatenate((start, [n])))
    return [gone[a:z] - s for a, z, s in zip(cuts[:-1], cuts[1:], start)]


# ---------------------------------------------------------------- minimisers

def minimisers(b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of `width`-byte strings around one minimiser begin, and its hash (40 bits)."""
    n = len(b) - width + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    gram = min(GRAM, width)
    grams = width - gram + 1
    begins, hashes = [], []
    table = C.byte_table(5)
    for at in range(0, n, STEP):
        stop = min(n, at + STEP)
        h = C.window_hashes(table[b[at:stop + width - 1]], gram, C.BASES[0])
        v = (h & np.uint64(2**64 - 2**24)) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while span * 2 <= grams:
            v = np.minimum(v[:-span], v[span:])
            span *= 2
        if span < grams:
            v = np.minimum(v[:stop - at], v[grams - span:grams - span + stop - at])
        v = v[:stop - at]
        cut = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
        begins.append(cut + at)
        hashes.append(v[cut] >> np.uint64(24))
    return np.concatenate(begins), np.concatenate(hashes)


class Runs:
    """The `width`-byte strings of some texts, in runs around one minimiser: begin in the buffer, count, text and minimiser of each."""

    def __init__(self, texts: list[bytes], width: int):
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        end = np.cumsum(size)
        self.offset = end - size
        self.buffer = b"".join(texts)
        begin, anchor = minimisers(np.frombuffer(self.buffer, np.uint8), width)
        # no string crosses documents: cut there, and leave out what begins too late in its own
        last = np.maximum(end - width + 1, self.offset)
        cut = np.unique(np.concatenate((begin, self.offset, last)))
        stop = np.append(cut[1:], len(self.buffer)) if len(cut) else cut
        doc = np.searchsorted(end, cut, "right")
        keep = doc < len(texts)
        cut, stop, doc = cut[keep], stop[keep], doc[keep]
        keep = cut < last[doc]
        self.begin, self.doc = cut[keep], doc[keep]
        self.count = stop[keep] - self.begin
        self.anchor = anchor[np.searchsorted(begin, self.begin, "right") - 1]


def anchors_of(width: int):
    def run(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        runs = Runs(texts, width)
        return runs.anchor, runs.doc

    return run


# ---------------------------------------------------------------- contexts

PARTS = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("starts", pa.binary()), ("counts", pa.binary()), ("context", pa.binary())])
PARTS_SQL = "anchor long, doc_id long, text_key long, starts binary, counts binary, context binary"


def fold(contexts: list[bytes], docs: list[int]) -> tuple[dict[bytes, int], list[bool]]:
    """The least doc of each distinct context, and which rows have a larger one."""
    least: dict[bytes, int] = {}
    for c, d in zip(contexts, docs):
        if d < least.get(c, LAST + 1):
            least[c] = d
    return least, [d > least[c] for c, d in zip(contexts, docs)]


def context_batches(width: int, hits: Hits):
    """Contexts of strings whose minimiser may occur again, one row for each context and document with all its starts. What a batch
    settles by itself comes as starts and counts of strings, without context."""

    def run(batches):
        for batch, texts in C.rows_of(batches, SPAN):
            r = Runs(texts, width)
            which = np.flatnonzero(hits.of(batch, r.anchor, r.doc))
            if not len(which):
                continue
            begin, count, doc, anchor = r.begin[which], r.count[which], r.doc[which], r.anchor[which]
            contexts = [r.buffer[a:z] for a, z in zip(begin.tolist(), (begin + count + (width - 1)).tolist())]
            ids, keys = C.listed(batch.column(0)), C.listed(batch.column(1))
            order_of = [LAST if d is None else d for d in ids]
            rows = doc.tolist()
            _, later = fold(contexts, [order_of[i] for i in rows])
            starts, counts = (begin - r.offset[doc]).astype(np.int32), count.astype(np.int32)
            later = np.array(later)
            out = []
            # settled: the runs of each document together
            over = np.flatnonzero(later)
            cut = np.flatnonzero(np.concatenate(([True], np.diff(doc[over]) != 0))) if len(over) else []
            for a, z in zip(cut, [*cut[1:], len(over)]):
                i, own = rows[over[a]], over[a:z]
                out.append((i * 7919 + int(z), ids[i], keys[i], starts[own].tobytes(), counts[own].tobytes(), None))
            kept: dict[tuple[bytes, int], list[int]] = {}
            for k in np.flatnonzero(~later).tolist():
                kept.setdefault((contexts[k], rows[k]), []).append(k)
            for (c, i), own in kept.items():
                out.append((int(anchor[own[0]]), ids[i], keys[i], starts[own].tobytes(), None, c))
            yield C.record(PARTS, *map(list, zip(*out)))

    return run


FOUND = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("starts", pa.binary()), ("counts", pa.binary()), ("string", pa.binary())])
FOUND_SQL = "doc_id long, text_key long, starts binary, counts binary, string binary"


def moved(starts: bytes, by: int) -> bytes:
    return starts if not by else (np.frombuffer(starts, np.int32) + np.int32(by)).tobytes()


def sort_contexts(width: int, hot_bytes: int):
    """Rows come sorted by anchor; those of whole anchors are settled, about CHUNK bytes at a time. Rows with a string are not settled yet."""

    def settle(rows: list[tuple]) -> list[tuple]:
        anchors, docs, keys, starts, _, contexts = zip(*rows)
        least, later = fold(contexts, [LAST if d is None else d for d in docs])
        of_anchor: dict[int, list[bytes]] = {}
        for c, a in dict(zip(contexts, anchors)).items():
            of_anchor.setdefault(a, []).append(c)
        # contexts that only one document has cannot remove anything from each other
        distinct = [c for group in of_anchor.values() if len(group) > 1 and len({least[c] for c in group}) > 1 for c in group]
        gone: dict[bytes, list[tuple[int, bytes]]] = {}
        if distinct:
            found = smaller_elsewhere(distinct, np.array([least[c] for c in distinct], np.int64), width)
            for c, offsets in zip(distinct, found):
                if len(offsets):
                    first, size = C.runs(offsets)
                    gone[c] = [(f, n.to_bytes(4, "little")) for f, n in zip(first.tolist(), size.tolist())]
        out = []
        for doc, key, at, c, over in zip(docs, keys, starts, contexts, later):
            if over:
                out.append((doc, key, at, (len(c) - width + 1).to_bytes(4, "little") * (len(at) // 4), None))
            elif c in gone:
                for first, n in gone[c]:
                    out.append((doc, key, moved(at, first), n * (len(at) // 4), None))
        return out

    def strings(rows: list[tuple]) -> list[tuple]:
        one = (1).to_bytes(4, "little")
        return [(doc, key, moved(at, k), one * (len(at) // 4), c[k:k + width]) for _, doc, key, at, _, c in rows for k in range(len(c) - width + 1)]

    def run(batches):
        held: list[tuple] = []
        size, hot = 0, None
        for batch in batches:
            out = []
            for row in zip(*map(C.listed, batch.columns)):
                if row[5] is None:
                    out.append((*row[1:5], None))
                elif row[0] == hot:
                    out += strings([row])
                else:
                    if size > CHUNK and row[0] != held[-1][0]:
                        out += settle(held)
                        held, size = [], 0
                    held.append(row)
                    size += len(row[5]) + len(row[3])
                    if size > CHUNK + hot_bytes:
                        hot = row[0]
                        first = next(i for i, r in enumerate(held) if r[0] == hot)
                        out += (settle(held[:first]) if first else []) + strings(held[first:])
                        held, size = [], 0
            if out:
                yield C.record(FOUND, *map(list, zip(*out)))
        if held and (out := settle(held)):
            yield C.record(FOUND, *map(list, zip(*out)))

    return run


def of_strings(rows: DataFrame) -> DataFrame:
    """Those rows (of strings one by one) whose string a smaller document has."""
    doc = F.coalesce("doc_id", F.lit(LAST))
    least = rows.groupBy("string").agg(F.min(doc).alias("least"))
    return rows.join(least, "string").filter(doc > F.col("least")).select("doc_id", "text_key", "starts", "counts")


SPANS = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("spans", pa.binary())])


def merge_spans(batches):
    """The runs of strings of each document as few as possible: ascending, none touching another."""
    for batch in batches:
        out = []
        for doc, key, starts, counts in zip(*(c.to_pylist() for c in batch.columns)):
            start, count = (np.frombuffer(b"".join(x), np.int32).astype(np.int64) for x in (starts, counts))
            order = np.argsort(start, kind="stable")
            start = start[order]
            end = np.maximum.accumulate(start + count[order])
            head = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))
            last = np.append(head[1:], len(start)) - 1
            out.append((doc, key, np.stack([start[head], end[last] - start[head]], 1).astype(np.int32).tobytes()))
        if out:
            yield C.record(SPANS, *map(list, zip(*out)))


KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def strip(width: int):
    def run(batches):
        for batch, texts in C.rows_of(batches):
            out = []
            for text, parts in zip(texts, batch.column(2).to_pylist()):
                if not parts:
                    out.append((len(text), 0, 0, text))
                    continue
                pairs = np.frombuffer(parts, np.int32).reshape(-1, 2).astype(np.int64)
                cover = np.zeros(len(text) + 1, np.int64)
                np.add.at(cover, pairs[:, 0], 1)
                np.add.at(cover, pairs[:, 0] + pairs[:, 1] + width - 1, -1)
                gone = np.cumsum(cover[:-1]) > 0
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                out.append((len(text), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), kept))
            yield C.record(KEPT, batch.column(0), *map(list, zip(*out)))

    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, max_log2: int = 28, broadcast_bytes: int = BROADCAST_BYTES, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (remaining bytes) of every row."""
    spark = docs.sparkSession
    texts = C.source(docs, id_col, text_col)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    keyed = texts.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    ready, hits = with_hits(keyed, anchors_of(width), size / 14, 4, max_log2, SPAN)  # about one minimiser in fourteen bytes
    parts = C.map_arrow(ready, context_batches(width, hits), PARTS_SQL)
    n = max(C.shuffle_partitions(spark), 1 + size // PART_BYTES)
    dealt = parts.repartition(n, "anchor").sortWithinPartitions("anchor")
    found = C.staged(dealt.mapInArrow(sort_contexts(width, hot_bytes), FOUND_SQL), "found")
    done, rest = found.filter("string is null").drop("string"), found.filter("string is not null")
    if not rest.isEmpty():
        done = done.unionByName(of_strings(rest))
    listed = done.groupBy("doc_id", "text_key").agg(F.collect_list("starts").alias("starts"), F.collect_list("counts").alias("counts"))
    spans = C.staged(listed.mapInArrow(merge_spans, "doc_id long, text_key long, spans binary"), "spans")
    right = F.broadcast(spans) if C.staged_bytes(spans) <= broadcast_bytes else spans
    both = keyed.alias("d").join(right.alias("s"), C.same_row("d", "s"), "left").select("d.doc_id", "d.text", "s.spans")
    return C.map_arrow(both, strip(width), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
