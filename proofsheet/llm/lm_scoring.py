"""Operator 10: language-model scoring by logistic mixing of hashed-context bit predictors.

A word's 64-bit hash is its code. Its first BITS bits are predicted one by one; which word it is among those with
equal first bits follows from their counts, and a word that training never saw is spelled, byte by byte and bit by
bit, with predictors hashed from the last one to three bytes. Every decision is binary, so the probabilities of all
texts sum to at most one whatever contexts collide.

Bit predictors: the code's prefix alone (together with the counts this is the unigram model), and the prefix in
three hashed contexts: the last common word, the previous word, and the one before. A mixer adds their differences
to the first one's logit, with weights gated by the bit's place. The weights that every text starts with, 36 numbers, are
learned on all training documents: each of them moves the weights by the gradient, and Spark averages where they end.
A caller may set `fit_rows`, so that these 36 alone come from the distinct texts of that many least hashes. In
scoring, too, weights follow the gradient through the text, a block of tokens at a time, so a text's score depends on
the text and the statistics only.

What is gathered over all training documents: the count of every word (a Spark aggregation that grows with the
vocabulary), and per task the context tables, of fixed size, which are added up by slices. The `common` most
frequent words go to every task (a bounded table); the rest of a text's words meet their counts in a shuffled join,
so the vocabulary may be of any size.

Defined results: null and empty texts are the end token alone; a null doc_id is held out; rows with equal doc_id
and text are scored alike; without training documents nothing is known and the base is taken as 0.1 / 0.1. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofsheet.llm import common as C
from proofsheet.llm import native as N

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 12
LEAVES = 1 << BITS
TOP = 255  # common words that serve as contexts
CLASSES = (TOP + 1, 512, 512)  # of each context
CELLS = 1 << 19  # of each spelling order
ORDERS = 3
END = np.uint64(0x5851F42D4C957F2D)
COMMON = 1 << 20
SLICE = 1 << 16
BLOCK = 32
START = (0.5, 0.25, 0.15)  # weights before anything is learned
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Places:
    """Where hashes stand among ascending ones: a table of their first bits tells where to begin."""

    def __init__(self, held: np.ndarray, bits: int):
        self.held, self.shift = held, np.uint64(64 - bits)
        self.low = np.searchsorted(held, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def of(self, h: np.ndarray) -> np.ndarray:
        """As np.searchsorted, but no place is behind the last."""
        last = len(self.held) - 1
        at = np.minimum(self.low[h >> self.shift], max(last, 0))
        behind = np.flatnonzero((at < last) & (self.held[at] < h)) if last > 0 else np.empty(0, int)
        while len(behind):
            at[behind] += 1
            now = at[behind]
            behind = behind[(now < last) & (self.held[now] < h[behind])]
        return at


class Tokens:
    """The lower-cased words of some texts and one end after each, in order."""

    def __init__(self, texts: list[bytes]):
        size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        offset = np.cumsum(size) - size
        self.buffer = np.frombuffer(b"\n".join(texts).lower(), np.uint8)
        self.start, self.stop = C.word_bounds(self.buffer)
        doc = np.searchsorted(offset, self.start, "right") - 1
        count = np.bincount(doc, minlength=len(texts)) + 1
        self.first = np.cumsum(count) - count
        self.count = count
        self.h = np.full(int(count.sum()), END, np.uint64)
        self.place = np.arange(len(doc)) + doc  # of each word among the tokens
        self.h[self.place] = C.word_hashes(self.buffer, self.start, self.stop)[0]
        self.doc = np.repeat(np.arange(len(texts)), count)

    def contexts(self, top: np.ndarray) -> list[np.ndarray]:
        """Class of each token in each context; top: ascending hashes of the most common words."""
        n = len(self.h)
        within = np.arange(n) - self.first[self.doc]
        at = Places(top, 16).of(self.h)
        known = top[at] == self.h if len(top) else np.zeros(n, bool)
        last = np.maximum.accumulate(np.where(known, np.arange(n), -1))
        last = np.concatenate(([-1], last[:-1]))
        near = last >= self.first[self.doc]
        out = [np.where(near, at[np.maximum(last, 0)] + 1, 0)]
        for back, classes in zip((1, 2), CLASSES[1:]):
            before = np.concatenate((np.zeros(back, np.uint64), self.h[:-back] if n > back else np.empty(0, np.uint64)))[:n]
            out.append(np.where(within >= back, (C.mix(before + np.uint64(back)) >> np.uint64(64 - 9)).astype(np.int64) % classes, 0))
        return out


# ---------------------------------------------------------------- tables that are added up by slices

SLICES = pa.schema([("slice", pa.int32()), ("data", pa.binary())])


def slices_of(table: np.ndarray):
    for i in range(0, len(table), SLICE):
        part = table[i:i + SLICE]
        if part.any():
            yield C.record(SLICES, [i // SLICE], [zlib.compress(part.tobytes(), 1)])


def add_slices(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = np.frombuffer(zlib.decompress(data), np.int64)
            sums[i] = sums[i] + part if i in sums else part
    for i, part in sums.items():
        yield C.record(SLICES, [i], [zlib.compress(part.tobytes(), 1)])


def added_up(df: DataFrame, f, size: int) -> np.ndarray:
    """The sum of the tables that f makes of each partition of df; their size is fixed."""
    n = C.shuffle_partitions(df.sparkSession)
    parts = C.map_arrow(df, f, "slice int, data binary").repartition(n, "slice").mapInArrow(add_slices, "slice int, data binary")
    out = np.zeros(size, np.int64)
    for r in parts.toLocalIterator():
        part = np.frombuffer(zlib.decompress(r.data), np.int64)
        out[r.slice * SLICE:r.slice * SLICE + len(part)] = part
    return out


def context_tables(top: np.ndarray):
    """How often each leaf follows each context class."""

    def run(batches):
        base = np.concatenate(([0], np.cumsum(CLASSES)[:-1])) * LEAVES
        table = np.zeros(sum(CLASSES) * LEAVES, np.int64)
        for _, texts in C.rows_of(batches):
            t = Tokens(texts)
            leaf = (t.h >> np.uint64(64 - BITS)).astype(np.int64)
            for b, c, classes in zip(base, t.contexts(top), CLASSES):
                table[b:b + classes * LEAVES] += np.bincount(c * LEAVES + leaf, minlength=classes * LEAVES)
        yield from slices_of(table)

    return run


def spelling(buffer: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The bits of words and their terminators: word of each bit, its cell in each order, and the bit."""
    size = stop - start + 1
    first = np.cumsum(size) - size
    within = np.arange(int(size.sum())) - np.repeat(first, size)
    word = np.repeat(np.arange(len(size)), size)
    final = within == size[word] - 1
    chars = np.where(final, 32, buffer[np.minimum(start[word] + within, len(buffer) - 1)]).astype(np.uint64)
    bits = (chars[:, None] >> np.arange(7, -1, -1, dtype=np.uint64)) & np.uint64(1)
    prefix = (chars[:, None] | np.uint64(256)) >> np.arange(8, 0, -1, dtype=np.uint64)
    cells, context = [], np.zeros(len(chars), np.uint64)
    for k in range(1, ORDERS + 1):
        before = np.where(within >= k, np.concatenate((np.zeros(k, np.uint64), chars))[:len(chars)], 1)
        context = context * np.uint64(257) + before + np.uint64(1)
        key = C.mix((context * np.uint64(8) + np.uint64(k))[:, None] * np.uint64(512) + prefix)
        cells.append((key >> np.uint64(64 - 19)).astype(np.int64).ravel())
    return np.repeat(word, 8), cells, bits.ravel().astype(np.int64)


def spelling_tables(batches):
    """Zeros and ones of each spelling cell, over the kinds of words."""
    table = np.zeros(ORDERS * CELLS * 2, np.int64)
    for _, words in C.rows_of(batches, 1 << 18):
        buffer = np.frombuffer(b" ".join(words) or b" ", np.uint8)
        _, cells, bits = spelling(buffer, *C.word_bounds(buffer))
        for k, cell in enumerate(cells):
            table[k * CELLS * 2:(k + 1) * CELLS * 2] += np.bincount(cell * 2 + bits, minlength=CELLS * 2)
    yield from slices_of(table)


HASHED = pa.schema([("h", pa.int64()), ("n", pa.int64())])


def hashed_words(batches):
    for batch, words in C.rows_of(batches):
        buffer = np.frombuffer(b" ".join(words), np.uint8)
        yield C.record(HASHED, C.word_hashes(buffer, *C.word_bounds(buffer))[0].view(np.int64), batch.column(1))


PACKED = pa.schema([("h", pa.binary()), ("n", pa.binary())])


def packed_words(batches):
    """A batch of words as two arrays, so that the driver gets numbers and not rows."""
    for batch in batches:
        if batch.num_rows:
            yield C.record(PACKED, [batch.column(0).to_numpy().tobytes()], [batch.column(1).to_numpy().tobytes()])


# ---------------------------------------------------------------- the model

class Model:
    """Everything that scoring needs, of bounded size."""

    def __init__(self, h: np.ndarray, n: np.ndarray, leaves: np.ndarray, tables: np.ndarray, spelled: np.ndarray, total: int, kinds: int, once: int):
        order = np.argsort(h)
        self.h, self.n = h[order], n[order]  # common words
        self.leaves = leaves  # training tokens below each leaf
        self.total, self.kinds = total, kinds
        # of tokens that training saw once, about as many will be new
        self.new = min(0.5, max(1e-9, (once + 0.5) / (total + 1)))
        nodes = self.nodes(leaves[None, :])
        ones = nodes[:, 1::2][:, :LEAVES]
        p0 = (ones[0] + 0.4) / (nodes[0, :LEAVES] + 0.8)
        self.s0 = self.logit(p0)
        self.s = []
        base = 0
        for classes in CLASSES:
            own = self.nodes(tables[base * LEAVES:(base + classes) * LEAVES].reshape(classes, LEAVES))
            p = (own[:, 1::2][:, :LEAVES] + 8 * p0) / (own[:, :LEAVES] + 8)
            self.s.append((self.logit(p) - self.s0).astype(np.float32).ravel())
            base += classes
        cells = spelled.reshape(ORDERS, CELLS, 2)
        self.spelled = [np.stack((c[:, 1], c.sum(1)), 1).astype(np.float32) for c in cells]  # ones and all of a cell

    @staticmethod
    def nodes(leaves: np.ndarray) -> np.ndarray:
        """Counts of all nodes of the code tree: children of i are 2i and 2i + 1, leaf j is LEAVES + j."""
        out = np.zeros((len(leaves), 2 * LEAVES), np.float32 if len(leaves) > 1 else np.float64)
        out[:, LEAVES:] = leaves
        size = LEAVES
        while size > 1:
            out[:, size // 2:size] = out[:, size:2 * size:2] + out[:, size + 1:2 * size:2]
            size //= 2
        return out

    @staticmethod
    def logit(p: np.ndarray) -> np.ndarray:
        p = np.clip(p, 1e-7, 1 - 1e-7)
        return np.log(p / (1 - p)).astype(np.float32)

    def spell(self, buffer: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Natural log probability of the spelling of each word."""
        out = np.zeros(len(start))
        size = stop - start
        i = 0
        while i < len(start):
            j = max(i + 1, i + int(np.searchsorted(np.cumsum(size[i:i + 20_000]), 1 << 17)))
            word, cells, bit = spelling(buffer, start[i:j], stop[i:j])
            p = np.full(len(bit), 0.5, np.float32)
            for counts, cell in zip(self.spelled, cells):
                own = np.take(counts, cell, axis=0, mode="clip")
                p = (own[:, 0] + 2 * p) / (own[:, 1] + 2)
            p = np.where(bit == 1, p, 1 - p)
            out[i:j] = np.bincount(word, np.log(np.maximum(p, 1e-7)), minlength=j - i)
            i = j
        return out


def mixed(model: Model, t: Tokens, contexts: list[np.ndarray], start: np.ndarray, rate: float = 0.02, scored: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Natural log probability of each token's code bits, and the weights that each text ends with; the weights of all texts advance a block at a time, side by side."""
    out = np.zeros(len(t.h))  # left so unless scored
    leaf = (t.h >> np.uint64(64 - BITS)).astype(np.int64)
    order = np.argsort(-t.count, kind="stable")
    length, first = t.count[order], t.first[order]
    weights = np.tile(np.asarray(start, np.float32), (len(order), 1, 1))
    # of each leaf, bit by bit: the node, what the prefix alone says there, and 1 or -1 for the bit
    shift = np.arange(BITS, 0, -1)
    every = np.arange(LEAVES)[:, None]
    nodes, signs = (every + LEAVES) >> shift, (((every >> (shift - 1)) & 1) * 2 - 1).astype(np.float32)
    alone = model.s0[nodes]
    step = np.arange(BLOCK)
    for at in range(0, int(length[0]) if len(length) else 0, BLOCK):
        active = int(np.searchsorted(-length, -at, "left"))  # longer than at
        for lo in range(0, active, 128):
            hi = min(active, lo + 128)
            live = at + step[None, :] < length[lo:hi, None]
            index = np.where(live, first[lo:hi, None] + at + step[None, :], first[lo:hi, None])
            own = leaf[index]
            node, sign, z = (np.take(x, own, axis=0, mode="clip") for x in (nodes, signs, alone))
            parts = []
            for k, c in enumerate(contexts):
                d = np.take(model.s[k], (c[index] * LEAVES)[:, :, None] + node, mode="clip")
                parts.append(d)
                z += weights[lo:hi, None, :, k] * d
            # the odds against each bit: one power serves the probability and the gradient
            z *= sign
            odds = np.exp(-np.clip(z, -60, 60, out=z))
            if scored:
                out[index[live]] = -np.log1p(odds).sum(2)[live]
            miss = odds / (1 + odds)
            miss *= sign
            miss *= live[:, :, None]
            for k, d in enumerate(parts):
                weights[lo:hi, :, k] += rate * np.einsum("ijk,ijk->ik", miss, d)
            np.clip(weights[lo:hi], -0.2, 1.5, out=weights[lo:hi])
    ends = np.empty_like(weights)
    ends[order] = weights
    return out, ends


FITTED = pa.schema([("place", pa.int32()), ("weight", pa.float64()), ("tokens", pa.float64())])


def top_words(model: Model) -> np.ndarray:
    return model.h[np.sort(np.argsort(-model.n, kind="stable")[:TOP])]


def restored(shared) -> Model:
    model = Model.__new__(Model)
    vars(model).update(shared.value)
    return model


def fit_batches(shared):
    """Weights that texts end with, a longer text counting for more."""

    def run(batches):
        model = restored(shared)
        top, start = top_words(model), np.tile(START, (BITS, 1))
        for _, texts in C.rows_of(batches):
            t = Tokens(texts)
            _, ends = mixed(model, t, t.contexts(top), start, scored=False)
            yield C.record(FITTED, np.arange(start.size, dtype=np.int32), (ends.astype(np.float64) * t.count[:, None, None]).sum(0).ravel(), np.full(start.size, float(t.count.sum())))

    return run


def fitted(texts: DataFrame, shared) -> np.ndarray:
    """The mean of those weights over the texts; START without any."""
    found = C.map_arrow(texts.select("text"), fit_batches(shared), "place int, weight double, tokens double").groupBy("place").agg((F.sum("weight") / F.sum("tokens")).alias("w"))
    out = np.tile(START, (BITS, 1)).astype(np.float64)
    for r in found.collect():  # BITS times three rows
        out.flat[r.place] = r.w
    return out


SCORED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.int64())), ("if_seen", pa.list_(pa.float64())), ("if_new", pa.list_(pa.float64()))])
SCORED_SQL = "doc_id long, n_tokens long, n_bytes long, known long, base double, score double, rare array<long>, if_seen array<double>, if_new array<double>"


def score_batches(shared, start: np.ndarray):
    """Sums over the common words of each text; its other words, with what each adds if training saw it (but for its count) or not."""

    def run(batches):
        model = restored(shared)
        ten = np.log(10)
        top = top_words(model)
        scale = np.log10(model.total + 0.1 * (model.kinds + 1))
        places = Places(model.h, 20)
        for batch, texts in C.rows_of(batches):
            t = Tokens(texts)
            bits = mixed(model, t, t.contexts(top), start)[0] / ten + np.log10(1 - model.new)
            leaf = (t.h >> np.uint64(64 - BITS)).astype(np.int64)
            bits -= np.log10(np.maximum(model.leaves[leaf], 1))
            at = places.of(t.h)
            common = model.h[at] == t.h if len(model.h) else np.zeros(len(t.h), bool)
            n = np.where(common, model.n[at] if len(model.h) else 0, 0)
            add = lambda v, m: np.bincount(t.doc[m], v[m], minlength=len(texts))
            logn = np.log10(np.maximum(n, 1))
            base = add(np.log10(n + 0.1) - scale, common)
            score = add(bits + logn, common)
            is_word = np.full(len(t.h), -1)
            is_word[t.place] = np.arange(len(t.place))
            rare = np.flatnonzero(~common)
            word = is_word[rare]
            new = np.full(len(rare), np.log10(model.new))
            new[word >= 0] += model.spell(t.buffer, t.start[word[word >= 0]], t.stop[word[word >= 0]]) / ten
            cuts = pa.array(np.searchsorted(t.doc[rare], np.arange(len(texts) + 1)), pa.int32())
            listed = lambda v, kind: pa.ListArray.from_arrays(cuts, pa.array(v, kind))
            yield C.record(
                SCORED, batch.column(0), t.count, [len(x) for x in texts], add(np.ones(len(t.h)), common & (n > 0)).astype(np.int64), base, score,
                listed(t.h[rare].view(np.int64), pa.int64()), listed(bits[rare], pa.float64()), listed(new, pa.float64()),
            )

    return run


def held_out() -> Column:
    """Whether crc32 of doc_id as text is a multiple of ten."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", common: int = COMMON, fit_rows: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability), bits_per_byte of every row."""
    spark = docs.sparkSession
    texts = C.source(docs, id_col, text_col)
    train = texts.filter(~held_out())
    lower = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    counts = train.select(F.explode(N.words(lower)).alias("text")).groupBy("text").agg(F.count("*").alias("n"))
    counts = C.staged(counts, "words")
    hashed = C.staged(C.map_arrow(counts, hashed_words, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "hashed")
    ends = train.count()
    size = hashed.agg(F.sum("n"), F.count("*"), F.count(F.when(F.col("n") == 1, 1))).first()
    total, kinds, once = (size[0] or 0) + ends, size[1] + (ends > 0), size[2]
    # the count from which words are common: few enough of them, by a histogram of at most 256 rows
    band = F.floor(F.log2("n") * 4).cast("int")
    above, cutoff = 0, 1 << 62
    for r in sorted(hashed.groupBy(band.alias("band")).agg(F.count("*").alias("m"), F.min("n").alias("low")).collect(), key=lambda r: -r.band):
        above += r.m
        if above >= common:
            break
        cutoff = r.low
    chosen = hashed.filter(F.col("n") >= cutoff).mapInArrow(packed_words, "h binary, n binary").collect()  # `common` words at most
    h = np.append(np.frombuffer(b"".join(r.h for r in chosen), np.uint64), END)
    n = np.append(np.frombuffer(b"".join(r.n for r in chosen), np.int64), ends)
    del chosen
    order = np.argsort(h)
    h, n = h[order], n[order]
    top = h[np.sort(np.argsort(-n, kind="stable")[:TOP])]

    tables = added_up(train.select("text"), context_tables(top), sum(CLASSES) * LEAVES)
    leaves = tables[:CLASSES[0] * LEAVES].reshape(-1, LEAVES).sum(0)
    spelled = added_up(counts.select("text"), spelling_tables, ORDERS * CELLS * 2)
    shared = spark.sparkContext.broadcast(vars(Model(h, n, leaves, tables, spelled, total, kinds, once)))  # arrays alone: workers need not import this package

    taught = train.select("text")
    if fit_rows is not None:  # the distinct texts of that many least hashes, each once
        key = F.xxhash64("text")
        least = train.select(key.alias("k")).distinct().orderBy("k").limit(fit_rows).agg(F.max("k")).first()[0]
        taught = train.filter(key <= F.lit(least)).groupBy(key.alias("k")).agg(F.min("text").alias("text")).select("text")
    start = fitted(taught, shared)
    scored = C.map_arrow(texts, score_batches(shared, start), SCORED_SQL)
    scored = C.staged(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    shared.destroy()  # from here on the staged files are read
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "if_seen", "if_new")).alias("x")).select("row", "x.*")
    tail = hashed.filter(F.col("n") < cutoff)
    scale = F.log10(F.lit(float(total + 0.1 * (kinds + 1))))
    met = rare.join(tail, F.col("rare") == F.col("h"), "left").withColumn("c", F.coalesce("n", F.lit(0)))
    sums = met.groupBy("row").agg(
        F.count(F.when(F.col("c") > 0, 1)).alias("known_2"),
        F.sum(F.log10(F.col("c") + 0.1) - scale).alias("base_2"),
        F.sum(F.when(F.col("c") > 0, F.col("if_seen") + F.log10(F.greatest("c", F.lit(1)))).otherwise(F.col("if_new"))).alias("score_2"),
    )
    both = scored.select("row", "doc_id", "n_tokens", "n_bytes", "known", "base", "score").join(sums, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    both = both.withColumn("score", F.col("score") + zero("score_2"))
    return both.select(
        "doc_id", held_out().alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("known_2", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("base_2")).alias("base_score"), "score", (-F.col("score") / F.log10(F.lit(2.0)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
