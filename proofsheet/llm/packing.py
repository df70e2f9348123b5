"""Operator 5: best-fit packing of token sequences after Martello-Toth dominance reduction.

Documents become pieces of at most `size` tokens. What the packing depends on is the number of pieces of each
length: at most `size` numbers, however large the corpus, and only they reach the driver. There the reduction
fixes, from the longest piece down, every set that provably dominates its alternatives (a piece that nothing fits
beside, a perfect pair, a pair when no three pieces fit, or when the partner is as long as any fitting pair), and
best-fit decreasing packs the rest; both treat all bins of the same content as one group. The plan is a short table
of slots: pieces of length L and rank r to r' go to sequences s, s+1, ... at an offset. Spark ranks the pieces
within their length (in two steps, so that a length which half the corpus shares is spread) and joins them with
the slots.

Defined results: null and empty texts are one piece holding the end token; rows with equal doc_id are packed as
rows of their own; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofsheet.llm import common as C

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CACHE = 300_000  # words that a Python worker remembers
LONG = 100  # bytes; longer words go to the library
BUCKET = 1 << 20  # pieces of one length that are ranked together

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
PIECES_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


class WordBpe:
    """The tokenizer of a file, for single words.

    Most of the library's time goes into offsets that nobody asks for. So Latin words (up to U+017F, where lower-casing
    and NFC are plain) are cut into pieces here, and all of them merged by one call, with a sign MARK behind each piece
    that stands for the vocabulary's end of word. A token's rank is that of the merge that makes it; the marked letters
    come first. Other words, and those that may hold a special token, go to the library.
    """

    MARK, SPACE = "\0", ord(" ")
    ODD = r"[^!-~\u00a1-\u012f\u0131-\u017f]|<\|"

    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path) as f:
            model = json.load(f)
        split = next(x for x in model["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.split, self.odd = regex.compile(split["pattern"]["Regex"]), regex.compile(self.ODD)
        vocab, suffix = model["model"]["vocab"], model["model"]["end_of_word_suffix"]
        # byte-level vocabularies write printable Latin-1 bytes as themselves and the others, in order, from U+0100 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = iter(range(256, 512))
        letter = [chr(i) if i in plain else chr(next(others)) for i in range(256)]
        value = {c: bytes([i]) for i, c in enumerate(letter)}
        mark = self.MARK.encode()
        made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["model"]["merges"]]
        tokens = dict.fromkeys([*letter, *(c + suffix for c in letter), *made])
        spelled = [b"".join(map(value.__getitem__, t.removesuffix(suffix))) + mark * t.endswith(suffix) for t in tokens]
        self.ids = np.array([vocab[t] for t in tokens], "<u4")
        self.merger = tiktoken.Encoding("pieces", pat_str=f"[^{self.MARK} ]+{self.MARK}| ", mergeable_ranks={t: i for i, t in enumerate(spelled)}, special_tokens={})
        self.path, self._library = path, None
        self.words: dict[bytes, bytes] = {}

    @property
    def library(self):
        """The library's tokenizer, loaded when the first word needs it."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def merge(self, marked: str) -> list[bytes]:
        """Ids of each word of a text in which a MARK follows every piece and a space every word."""
        tokens = self.merger.encode_to_numpy(marked, disallowed_special=())
        data, ends = self.ids[tokens].tobytes(), (4 * np.flatnonzero(tokens == self.SPACE)).tolist()
        return [data[a:z] for a, z in zip([0, *(z + 4 for z in ends)], ends)]

    def encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids (little-endian, unsigned 32-bit) of each word."""
        letters, mixed, others = [], [], []
        for w in words:
            if len(w) > LONG:
                others.append(w)
            elif w.isalpha():  # ASCII letters: one piece
                letters.append(w)
            else:
                (others if self.odd.search(w.decode()) else mixed).append(w)
        out = {w: np.array(self.library.encode(w.decode(), add_special_tokens=False).ids, "<u4").tobytes() for w in others}
        if letters:
            out.update(zip(letters, self.merge((b"\0 ".join(letters) + b"\0 ").lower().decode())))
        if mixed:
            out.update(zip(mixed, self.merge(self.split.sub("\\g<0>\0", (b" ".join(mixed) + b" ").decode().lower()))))
        return out

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """A table that has at least these words; when it is full, only the words that are needed now stay."""
        new = words.difference(self.words)
        if len(self.words) + len(new) > CACHE:
            self.words = {w: self.words[w] for w in words.difference(new)}
        self.words.update(self.encode(list(new)))
        return self.words


def cut_batches(path: str, end_id: int, size: int, keep_ids: bool):
    """White space never joins tokens of this vocabulary, so the words of a text are encoded one by one and remembered."""

    def run(batches):
        own = C.worker_cache("word_bpe")
        if getattr(own, "made_from", None) != path:
            own.bpe, own.made_from = WordBpe(path), path
        end = np.array([end_id], "<u4").tobytes()
        for batch, texts in C.rows_of(batches, 2 << 20):
            split = [t.split() for t in texts]
            known = own.bpe.learn(set().union(*split))
            out = []
            for doc, words in zip(batch.column(0).to_pylist(), split):
                ids = b"".join(map(known.__getitem__, words)) + end
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at:at + 4 * size]
                    out.append((doc, k, k * size, len(part) // 4, zlib.crc32(part), part if keep_ids else None))
            yield C.record(PIECES, *map(list, zip(*out)))

    return run


def cut_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, size: int = 4096, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids (little-endian unsigned 32-bit, null unless kept)."""
    return C.map_arrow(C.source(docs, id_col, text_col), cut_batches(tokenizer_path, end_id, size, keep_ids), PIECES_SQL)


#: what a sequence holds: (length, how many), ...
Content = tuple[tuple[int, int], ...]


def reduce(counts: dict[int, int], size: int) -> tuple[list[tuple[Content, int]], dict[int, int]]:
    """Martello-Toth reduction: closed sequences (content, how many) and what is left. Each closed one holds, with the
    longest piece, a set that dominates every other set which could lie beside it."""
    left = {w: n for w, n in counts.items() if n > 0}
    lengths = sorted(left)
    closed: list[tuple[Content, int]] = []

    def use(w: int, n: int) -> None:
        left[w] -= n
        if not left[w]:
            del left[w]
            lengths.pop(bisect.bisect_left(lengths, w))

    def smallest(n: int, but: int) -> list[int]:
        """The n least pieces that are left, without one of length but."""
        out: list[int] = []
        for w in lengths:
            out += [w] * min(n - len(out), left[w] - (w == but))
            if len(out) == n:
                break
        return out

    def best_pair(room: int, but: int) -> int:
        """The largest sum within room of two pieces, without one of length but."""
        free = [w for w in lengths if left[w] > (w == but)]
        best, i, j = 0, 0, len(free) - 1
        while i <= j:
            a, b = free[i], free[j]
            if a + b > room:
                j -= 1
                continue
            if i < j or left[a] - (a == but) >= 2:
                best = max(best, a + b)
            i += 1
        return best

    for w in sorted(left, reverse=True):
        while w in left:
            room = size - w
            at = bisect.bisect_right(lengths, room) - 1
            if at >= 0 and lengths[at] == w and left[w] == 1:
                at -= 1
            if at < 0:
                closed.append((((w, 1),), n := left[w]))
                use(w, n)
                break
            k = lengths[at]
            three, two = smallest(3, w), smallest(2, w)
            fixed = w + k == size or len(two) < 2 or sum(two) > room or ((len(three) < 3 or sum(three) > room) and best_pair(room, w) <= k)
            if not fixed:
                break
            if k == w:
                closed.append((((w, 2),), n := left[w] // 2))
                use(w, 2 * n)
            elif w + k == size:
                closed.append((((w, 1), (k, 1)), n := min(left[w], left[k])))
                use(w, n)
                use(k, n)
            else:
                # the proof looks at what is left: it holds for the next ones too while none of the lengths runs out
                n = max(1, min(left[w] - 2, left[k] - 3))
                closed.append((((w, 1), (k, 1)), n))
                use(w, n)
                use(k, n)
    return closed, left


def best_fit(left: dict[int, int], size: int) -> list[tuple[Content, int]]:
    """Best-fit decreasing; sequences of the same content are one group."""
    out: list[tuple[Content, int]] = []
    rooms: list[int] = []  # rooms that some open sequences have
    groups: dict[int, list[tuple[Content, int]]] = {}

    def put(content: Content, n: int, room: int) -> None:
        if not n:
            return
        if not room:
            out.append((content, n))
            return
        if room not in groups:
            bisect.insort(rooms, room)
            groups[room] = []
        groups[room].append((content, n))

    for w in sorted(left, reverse=True):
        n = left[w]
        while n:
            at = bisect.bisect_left(rooms, w)
            if at < len(rooms):
                room = rooms[at]
                content, m = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, content, m = size, (), 1 << 62
            each = room // w
            full = min(m, n // each)
            rest = n - full * each if full < m else 0
            if full:
                put(content + ((w, each),), full, room - each * w)
            if rest and rest < each:
                put(content + ((w, rest),), 1, room - rest * w)
                m -= 1
                n = 0
            else:
                n -= full * each
            if content:
                put(content, m - full, room)
    for room in rooms:
        out += groups[room]
    return out


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, first rank, end rank, first sequence, pieces a sequence, offset) for so many pieces of each length."""
    closed, left = reduce(counts, size)
    packed = closed + best_fit(left, size)
    slots, rank, sequence = [], dict.fromkeys(counts, 0), 0
    for content, n in packed:
        offset = 0
        for w, each in content:
            slots.append((w, rank[w], rank[w] + n * each, sequence, each, offset))
            rank[w] += n * each
            offset += w * each
        sequence += n
    return slots


def pack(pieces: DataFrame, size: int = 4096) -> DataFrame:
    """pieces with sequence_id and offset: sequences of at most `size` tokens, as few as best fit makes."""
    spark = pieces.sparkSession
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    slots = spark.createDataFrame(plan(counts, size) or [(0, 0, 0, 0, 1, 0)], "length long, rank_from long, rank_to long, first_sequence long, each long, first_offset long")
    # a length that very many pieces share is ranked in as many buckets as it needs
    many = {w: -(-n // BUCKET) for w, n in counts.items() if n > BUCKET}
    buckets = F.coalesce(F.create_map(*(F.lit(x) for item in many.items() for x in item))[F.col("length")], F.lit(1)) if many else F.lit(1)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), buckets))
    before = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))  # at most `size` rows, and one for each BUCKET pieces
    before = before.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("within", F.row_number().over(order) - 1).join(F.broadcast(before), ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("within"))
    placed = ranked.join(F.broadcast(slots), (ranked.length == slots.length) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))).drop(slots.length)
    step = F.col("rank") - F.col("rank_from")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", "ids",
        (F.col("first_sequence") + F.expr("(rank - rank_from) div each")).alias("sequence_id"),
        (F.col("first_offset") + (step % F.col("each")) * F.col("length")).alias("offset"),
    )


def best_fit_packing(docs: DataFrame, tokenizer_path: str, end_id: int = 1, size: int = 4096, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    pieces = C.staged(cut_pieces(docs, tokenizer_path, end_id, size, keep_ids, id_col, text_col), "pieces")
    return pack(pieces, size)
