"""Operator 7: byte-level BPE encoding and decoding by monoid tree reduction.

Each match of the split pattern is encoded separately, by one tree: it is halved down to single bytes, and from the
leaves up two encodings are joined. A join re-encodes a window of tokens around the seam, first one token on either
side, then two, four and so on, until the tokens outside provably stay: a token sequence is the BPE encoding of its
bytes exactly if each pair of neighbours is the encoding of the pair's bytes, and all pairs outside the window come
from finished encodings, so only the two pairs at the window's edges are left to check. Subtrees of a few bytes and
windows of two tokens recur all the time, so a worker remembers them. Decoding concatenates up the same tree: tokens
to matches, matches to the document.

Defined results: null and empty texts have no tokens; texts without white space or with one endless run of a
character are matches like others, of more levels; no special tokens: their strings are ordinary text. Rows stay one to one, repeated or
not; other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from proofsheet.llm import common as C

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CACHE = 250_000  # matches that a Python worker remembers in each of two generations, and as many subtrees and pairs of tokens
SHORT = 64  # bytes; longer matches are rarely met again
TWIG = 8  # bytes of a subtree that is remembered


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Bpe:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {v: k for k, v in ranks.items()}
        self.pairs: dict[tuple[int, int], tuple[int, ...]] = {}
        self.twigs: dict[bytes, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Re-encode a window: merge the neighbours of least rank, leftmost first, until none can be merged."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        if n > 48:
            return self.merge_long(piece)
        parts = [piece[i:i + 1] for i in range(n)]
        near = [ranks.get(parts[i] + parts[i + 1], 1 << 30) for i in range(n - 1)]
        while near:
            low = min(near)
            if low == 1 << 30:
                break
            i = near.index(low)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del near[i]
            if i < len(near):
                near[i] = ranks.get(parts[i] + parts[i + 1], 1 << 30)
            if i:
                near[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 30)
        return [ranks[p] for p in parts]

    def merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap and linked neighbours, for n log n steps."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))
        left = list(range(-1, n - 1))
        heap = [(ranks[piece[i:i + 2]], i, i + 1, i + 2) for i in range(n - 1) if piece[i:i + 2] in ranks]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, j, stop = heapq.heappop(heap)
            if not (alive[i] and j < n and alive[j] and end[i] == j and end[j] == stop):
                continue
            end[i], alive[j] = stop, False
            if stop < n:
                left[stop] = i
                r = ranks.get(piece[i:end[stop]])
                if r is not None:
                    heapq.heappush(heap, (r, i, stop, end[stop]))
            k = left[i]
            if k >= 0:
                r = ranks.get(piece[k:stop])
                if r is not None:
                    heapq.heappush(heap, (r, k, i, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:end[i]]])
            i = end[i]
        return out

    def pair(self, a: int, b: int) -> tuple[int, ...]:
        """The encoding of the bytes of two tokens."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) > CACHE:
                self.pairs.clear()
            found = self.pairs[a, b] = tuple(self.merge(self.token[a] + self.token[b]))
        return found

    def join(self, a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of two finished encodings' bytes."""
        known, i, j = self.pairs.get, len(a) - 1, 1
        seam = known((a[-1], b[0])) or self.pair(a[-1], b[0])
        k = 1
        while True:
            if i and (known((a[i - 1], seam[0])) or self.pair(a[i - 1], seam[0])) != (a[i - 1], seam[0]):
                pass
            elif j < len(b) and (known((seam[-1], b[j])) or self.pair(seam[-1], b[j])) != (seam[-1], b[j]):
                pass
            else:
                return a[:i] + seam + b[j:]
            k *= 2
            i, j = max(0, len(a) - k), min(len(b), k)
            seam = tuple(self.merge(self.decode(a[i:]) + self.decode(b[:j])))

    def encode(self, piece: bytes) -> tuple[int, ...]:
        rank = self.ranks.get(piece)
        if rank is not None:  # a leaf: one byte, or a whole token
            return (rank,)
        half = len(piece) // 2
        x, y = piece[:half], piece[half:]
        return self.join(self.twigs.get(x) or self.twig(x), self.twigs.get(y) or self.twig(y))

    def twig(self, piece: bytes) -> tuple[int, ...]:
        """encode, remembered if it is short."""
        found = self.encode(piece)
        if len(piece) <= TWIG:
            if len(self.twigs) > CACHE:
                self.twigs.clear()
            self.twigs[piece] = found
        return found

    def decode(self, ids: tuple[int, ...]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


CODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.string()), ("decoded", pa.binary())])


def code_batches(path: str, pattern: str):
    def run(batches):
        import regex

        own = C.worker_cache("byte_bpe")
        if getattr(own, "made_from", None) != (path, pattern):
            own.bpe, own.split, own.known, own.before = Bpe(load_ranks(path)), regex.compile(pattern), {}, {}
            own.names = {i: str(i) for i in own.bpe.token}
            own.made_from = (path, pattern)
        bpe, split, name = own.bpe, own.split, own.names.__getitem__
        for batch, texts in C.rows_of(batches):
            count, ids, back = [], [], []
            matches = [split.findall(t.decode()) for t in texts]
            need = set().union(*matches)
            new = need.difference(own.known)
            if len(own.known) + len(new) > CACHE:  # what is needed again survives the next time
                own.before, own.known, new = own.known, {}, need
            known, before, long = own.known, own.before.get, []
            for m in new:  # its ids, and the bytes that they stand for
                seen = before(m)
                if seen is None:
                    b = m.encode()
                    coded = bpe.encode(b)
                    seen = " ".join(map(name, coded)), bpe.decode(coded)
                    if len(b) > SHORT:
                        long.append(m)
                known[m] = seen
            for found in matches:
                told, read = zip(*map(known.__getitem__, found)) if found else ((), ())
                line = " ".join(told)
                count.append(line.count(" ") + 1 if line else 0)
                ids.append(line)
                back.append(b"".join(read))
            for m in long:
                del known[m]
            yield C.record(CODED, batch.column(0), count, ids, back)

    return run


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by one space) and decoded (the bytes that these ids stand for) of every row.

    ranks_path is a file that every executor has; it is read once a Python worker.
    """
    return C.map_arrow(C.source(docs, id_col, text_col), code_batches(ranks_path, pattern), "doc_id long, n_tokens long, ids string, decoded binary")
