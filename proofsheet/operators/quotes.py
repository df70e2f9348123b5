"""Finding values and quotes in text: exact location, anchored extraction, fuzzy windows, spelled and damaged amounts."""

from __future__ import annotations

import sys
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from proofsheet.functions import text as T
from proofsheet.functions import values as V
from proofsheet.functions.session import plain_unions
from proofsheet.operators import layout, segments

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def locate_exact(quotes: DataFrame, texts: DataFrame, quote_id: str, quote: str, text_id: str, text: str, grams: int = 4) -> DataFrame:
    """quote_id, text_id, at (place of the first word, from 0): folded quotes inside folded texts at word boundaries.

    Both sides are keyed by their runs of `grams` words. A quote asks with its rarest run only, so a run that every
    text has draws no crowd; the hit is then confirmed on the whole quote. Shorter quotes ask with all their words. Texts
    are folded once for their runs, and those with a hit once more to confirm it.
    """
    q = quotes.select(F.col(quote_id).alias("q"), T.fold_words(F.col(quote)).alias("quote")).filter("quote <> ''").withColumn("w", F.split("quote", " "))
    words = lambda some: some.select(F.col(text_id).alias("t"), F.split(T.fold_words(F.col(text)), " ").alias("w"))
    t = words(texts)
    # lengths of runs are bounded by grams, so every text has at most that many keys a word
    sizes = [r.n for r in q.select(F.least(F.size("w"), F.lit(grams)).alias("n")).distinct().collect()]
    runs = lambda w, n: F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.struct(F.lit(n).alias("n"), F.xxhash64(F.slice(w, i + 1, n)).alias("key"), i.alias("at")))
    keys_t = F.flatten(F.array(*(F.when(F.size("w") >= n, runs(F.col("w"), n)).otherwise(F.array().cast("array<struct<n:int,key:bigint,at:int>>")) for n in sizes)))
    posts = t.select("t", F.explode(keys_t).alias("k")).select("t", "k.*")
    asks = q.select("q", "quote", F.size("w").alias("len"), F.explode(F.expr(f"transform(sequence(0, size(w) - least(size(w), {grams})), i -> struct(least(size(w), {grams}) as n, xxhash64(slice(w, i + 1, least(size(w), {grams}))) as key, i as off))")).alias("k")).select("q", "quote", "len", "k.*")
    # what is asked for is kept: it is counted and then met, and all texts are folded for it once
    met = posts.join(asks.select("n", "key").distinct(), ["n", "key"], "left_semi").checkpoint()
    common = met.groupBy("n", "key").agg(F.count("*").alias("df"))
    best = asks.join(common, ["n", "key"]).groupBy("q").agg(F.min_by(F.struct("quote", "len", "n", "key", "off"), F.struct("df", "off")).alias("b")).select("q", "b.*")
    hits = met.join(best, ["n", "key"]).withColumn("start", F.col("at") - F.col("off")).filter("start >= 0")
    hit_texts = words(texts.join(hits.select(F.col("t").alias(text_id)).distinct(), text_id, "left_semi"))
    sure = hits.join(hit_texts, "t").filter(F.array_join(F.slice("w", F.col("start") + 1, F.col("len")), " ") == F.col("quote"))
    return sure.groupBy("q", "t").agg(F.min("start").alias("at")).select(F.col("q").alias(quote_id), F.col("t").alias(text_id), "at")


def locate_verbatim(quotes: DataFrame, texts: DataFrame, quote_id: str, quote: str, text_id: str, text: str, grams: int = 4) -> DataFrame:
    """quote_id, text_id: quotes that stand in texts letter by letter, wherever words begin; empty ones stand nowhere.

    A quote's first and last words may be parts of a text's; those between are the text's own, so a quote asks with its rarest
    run of up to `grams` of them and is then looked for in the texts that have it. Quotes of one or two words meet every text.
    """
    q = quotes.select(F.col(quote_id).alias("q"), F.col(quote).alias("quote")).filter("quote <> ''").withColumn("w", F.split("quote", r"\s+"))
    q = q.withColumn("w", F.slice("w", F.lit(2), F.greatest(F.size("w") - 2, F.lit(0)))).withColumn("n", F.least(F.size("w"), F.lit(grams)))
    t = texts.select(F.col(text_id).alias("t"), F.col(text).alias("text")).filter("text is not null")
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.xxhash64(F.slice("w", i, n)))
    asks = q.filter("n > 0").select("q", "quote", "n", F.explode(runs(F.col("n"))).alias("key"))
    sizes = [r.n for r in asks.select("n").distinct().collect()]  # `grams` numbers at most
    split = t.withColumn("w", F.split("text", r"\s+"))
    own = F.flatten(F.array(*(F.when(F.size("w") >= n, F.transform(F.array_distinct(runs(F.lit(n))), lambda k: F.struct(F.lit(n).alias("n"), k.alias("key")))).otherwise(F.array().cast("array<struct<n:int,key:bigint>>")) for n in sizes)))
    posts = split.select("t", F.explode(own).alias("k")).select("t", "k.*") if sizes else t.select("t", F.lit(0).alias("n"), F.lit(0).cast("long").alias("key"))
    common = posts.join(asks.select("n", "key").distinct(), ["n", "key"], "left_semi").groupBy("n", "key").agg(F.count("*").alias("df"))
    best = asks.join(common, ["n", "key"]).groupBy("q").agg(F.min_by(F.struct("quote", "n", "key"), F.struct("df", "key")).alias("b")).select("q", "b.*")
    hits = posts.join(best, ["n", "key"]).select("q", "t", "quote").join(t, "t").filter(F.contains("text", F.col("quote")))
    short = t.join(F.broadcast(q.filter("n = 0").select("q", "quote")), F.contains("text", F.col("quote")))
    return hits.select(F.col("q").alias(quote_id), F.col("t").alias(text_id)).unionByName(plain_unions(short).select(F.col("q").alias(quote_id), F.col("t").alias(text_id)))


QUOTE_WORDS = (8, 60)
#: How many quotes of a document meet its pages in one task.
TOGETHER = 32


def place_quotes(quotes: DataFrame, pages: DataFrame, doc: str, quote_id: str, quote: str, claimed: str, page: str, words: str) -> DataFrame:
    """quote_id, page, box, exact, ratio of quotes that a page of their own document holds.

    words: a page's words in reading order (structs with text, x, y, w, h). A verbatim hit begins and ends with whole
    words; on any page it comes before a near one on any other. Of equal hits the claimed page counts first, then the
    earliest. The most alike stretch of a page is its near hit, if its digits are the quote's. Quotes of fewer than 8 words,
    counted with or without punctuation, are refused, as are those of more than 60. Documents meet their own pages only,
    and near hits are looked for only for quotes without a verbatim one.
    """
    # quotes and pages of a document multiply, so a document of many quotes is dealt in parts, each with all of its pages
    many = quotes.groupBy(doc).agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("__parts")).filter("__parts > 1")
    parts = F.coalesce("__parts", F.lit(1))
    quotes = quotes.join(many, doc, "left").withColumn("__part", F.pmod(F.xxhash64(quote_id), parts).cast("int"))
    plain = F.size(F.split(T.collapse(T.fold_accents(F.col(quote))), " "))
    # explode holds what is folded, so that filters and joins do not fold it again
    keys = [doc, "__part", quote_id, claimed]
    q = quotes.select(*keys, F.explode(F.array(F.struct(T.fold_words(F.col(quote)).alias("__q"), plain.alias("__n")))).alias("__a")).select(*keys, "__a.*")
    words_asked = F.size(F.split("__q", " "))
    q = q.filter((F.least("__n", words_asked) >= QUOTE_WORDS[0]) & (words_asked <= QUOTE_WORDS[1])).drop("__n")
    spot = lambda w: F.struct(*(w[c].alias(c) for c in ("x", "y", "w", "h")))
    told = layout.let(T.fold_each(F.transform(words, lambda w: w["text"])), lambda f: F.filter(F.transform(words, lambda w, i: F.struct(F.get(f, i).alias("f"), spot(w).alias("w"))), lambda t: t["f"] != ""))
    # a page's words as lines, since a word may hold blanks when it is folded
    told = layout.let(told, lambda t: F.struct(F.transform(t, lambda x: x["w"]).alias("__w"), F.array_join(F.transform(t, lambda x: x["f"]), "\n").alias("__text")))
    p = pages.select(doc, F.col(page).alias("page"), F.explode(F.array(told)).alias("__p")).select(doc, "page", "__p.*").filter("__text is not null")
    p = p.join(many, doc, "left").select(doc, F.explode(F.sequence(F.lit(0), parts - 1)).alias("__part"), "page", "__w", "__text")
    box = lambda start, stop: segments.union_box(F.slice("__w", start + 1, stop - start))
    order = lambda at: (F.coalesce(at != F.col(claimed), F.lit(True)).alias("other"), at.alias("page"))

    def hit(words_: Column) -> Column:
        """Number of the first word of the first verbatim hit and of the one behind it; null without one."""
        breaks = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
        # folded words hold nothing that means something in a pattern
        upto = F.regexp_substr(words_, F.concat(F.lit(r"(?s)\A(?:|.*?\n)"), F.replace(F.col("__q"), F.lit(" "), F.lit(r"[ \n]")), F.lit(r"(?=\n|\z)")))
        return layout.let(upto, lambda u: F.when(u.isNotNull(), F.struct((breaks(u) - breaks(F.right(u, F.length("__q")))).alias("start"), (breaks(u) + 1).alias("stop"))))

    verbatim = F.when(F.contains(F.replace("__text", F.lit("\n"), F.lit(" ")), F.col("__q")), hit(F.col("__text")))
    placed = layout.let(verbatim, lambda h: F.when(h.isNotNull(), F.struct("page", box(h["start"], h["stop"]).alias("box"))))
    tried = q.join(p, [doc, "__part"]).select(*keys, "__q", F.explode(F.array(placed)).alias("__h"))
    settled = tried.groupBy(*keys, "__q").agg(F.min_by("__h", F.when(F.col("__h").isNotNull(), F.struct(*order(F.col("__h.page"))))).alias("__h"))
    open_ = settled.join(p.withColumnsRenamed({doc: "__doc", "__part": "__of"}), (F.col(doc) == F.col("__doc")) & (F.col("__part") == F.col("__of")) & F.col("__h").isNull(), "left").withColumn("b", best_window(F.split("__text", "\n"), F.col("__q")))
    start, stop = F.col("b.start"), F.col("b.start") + F.col("b.words")
    said = F.translate(F.array_join(F.slice(F.split("__text", "\n"), start + 1, stop - start), " "), "\n", " ")
    found = lambda at, box_, exact, ratio: F.struct(at.alias("page"), box_.alias("box"), F.lit(exact).alias("exact"), ratio.alias("ratio"))
    near = F.when(F.col("b.ratio").isNotNull() & (T.digits(said) == T.digits(F.col("__q"))), found(F.col("page"), box(start, stop), False, F.col("b.ratio")))
    best = F.when(F.col("__h").isNotNull(), found(F.col("__h.page"), F.col("__h.box"), True, F.lit(1.0))).otherwise(near)
    hits = open_.select(quote_id, claimed, F.explode(F.array_compact(F.array(best))).alias("h"))
    return hits.groupBy(quote_id).agg(F.min_by("h", F.struct(~F.col("h.exact"), -F.col("h.ratio"), *order(F.col("h.page")))).alias("h")).select(quote_id, "h.*")


def locate_quotes(quotes: DataFrame, pages: DataFrame, doc: str, quote_id: str, quote: str, claimed: str, page: str, text: str) -> DataFrame:
    """quote_id, page, exact, ratio: place_quotes for pages of bare text."""
    word = lambda w: F.struct(w.alias("text"), *(F.lit(0).alias(c) for c in ("x", "y", "w", "h")))
    told = pages.withColumn("__words", F.transform(F.split(T.text_of(F.col(text)), r"\s+"), word))
    return place_quotes(quotes, told, doc, quote_id, quote, claimed, page, "__words").drop("box")


def anchored(lines: Column, anchor: str, pattern: str, lookahead: int = 1) -> Column:
    """For each line that holds the folded anchor: its place, the first match of the pattern on it or on the next lines, and on which; an empty value if there is none."""
    def at(i: Column) -> Column:
        tries = [F.regexp_extract(F.coalesce(F.get(lines, i + k), F.lit("")), pattern, 0) for k in range(lookahead + 1)]
        value, where = F.lit(""), F.lit(-1)
        for k in reversed(range(lookahead + 1)):
            value, where = F.when(tries[k] != "", tries[k]).otherwise(value), F.when(tries[k] != "", k).otherwise(where)
        return F.struct(i.alias("line"), value.alias("value"), where.alias("ahead"))

    places = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.contains(T.fold_accents(F.get(lines, i)), F.lit(anchor)))
    return F.transform(places, at)


def printed_at_label(near: Column, expected: Column, anchors: tuple[str, ...], within: int = 8) -> Column:
    """Whether the expected digits stand, as a run of whole tokens, among the `within` tokens behind one of the folded labels."""
    whole = lambda p: F.filter(F.split(F.when(F.startswith(p, F.lit(" ")), p).otherwise(F.regexp_replace(p, "^[^ ]+", "")), " "), lambda w: w != "")  # noqa: E731  (a label may end inside a token)

    def behind(parts: Column, label: str) -> Column:
        """What follows each appearance of the label."""
        return F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda p, i: F.array_join(F.slice(parts, i + 2, F.size(parts)), label))

    def at_label(text: Column, label: str) -> Column:
        return layout.let(F.split(text, label), lambda parts: F.exists(behind(parts, label), lambda p: digits_at_label(whole(p), expected, F.lit(0), within)))

    def at_any(text: Column) -> Column:
        return reduce(Column.__or__, (at_label(text, " ".join(a.split())) for a in anchors))

    return layout.let(T.fold_words(near), at_any)


def digits_at_label(tokens: Column, expected: Column, label_end: Column, within: int = 8) -> Column:
    """Whether a run of the next `within` tokens after a label spells exactly the expected digits."""
    def found(near: Column) -> Column:
        runs = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.size(near), F.lit(1))), lambda i: F.transform(F.sequence(F.lit(1), F.greatest(F.size(near) - i + 1, F.lit(1))), lambda n: T.digits(F.array_join(F.slice(near, i, n), "")))))
        return (T.digits(expected) != "") & F.array_contains(runs, T.digits(expected))

    return layout.let(F.slice(tokens, label_end + 1, within), found)


#: Number words.
UNITS = {"khong": 0, "mot": 1, "hai": 2, "ba": 3, "bon": 4, "nam": 5, "sau": 6, "bay": 7, "tam": 8, "chin": 9, "tu": 4, "lam": 5}
TENS = {"muoi": 10, "chuc": 10, "tram": 100}
SCALES = {"nghin": 1_000, "ngan": 1_000, "trieu": 1_000_000, "ty": 1_000_000_000, "ti": 1_000_000_000}
FILLERS = ("le", "linh")


def spelled_amount(text: Column) -> Column:
    """The amount that number words spell; null if they spell none. Other words are passed over.

    It is a sum over words: a unit counts as often as the ten or hundred right behind it says, a ten or hundred without
    a unit counts once, and each is scaled by the next scale word that follows.
    """
    kinds = {**dict.fromkeys(UNITS, "unit"), **dict.fromkeys(TENS, "ten"), **dict.fromkeys(SCALES, "scale"), **dict.fromkeys(FILLERS, "filler")}
    values = {**dict.fromkeys(FILLERS, 0), **UNITS, **TENS, **SCALES}
    kind_of = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))
    value_of = F.create_map(*(F.lit(x).cast("long") if isinstance(x, int) else F.lit(x) for kv in values.items() for x in kv))
    known = F.filter(F.split(T.fold_words(text), "[ _]+"), lambda w: kind_of[w].isNotNull())
    said = F.transform(known, lambda w: F.struct(kind_of[w].alias("kind"), value_of[w].alias("value")))

    def total(s: Column) -> Column:
        def share(x: Column, i: Column) -> Column:
            after, before = F.get(s, i + 1), F.get(s, i - 1)
            times = F.when(after["kind"] == "ten", after["value"]).otherwise(F.lit(1).cast("long"))
            own = F.when(x["kind"] == "unit", x["value"] * times).when((x["kind"] == "ten") & (F.coalesce(before["kind"], F.lit("")) != "unit"), x["value"])
            scales = F.filter(s, lambda y, j: (j > i) & (y["kind"] == "scale"))
            return F.coalesce(own, F.lit(0).cast("long")) * F.coalesce(F.get(scales, F.lit(0))["value"], F.lit(1).cast("long"))

        amount = F.aggregate(F.transform(s, share), F.lit(0).cast("long"), lambda a, x: a + x)
        return F.when(F.exists(s, lambda x: x["kind"].isin("unit", "ten")), amount)

    return F.element_at(F.transform(F.array(said), total), 1)


#: What a printed sign may be instead of a digit.
CONFUSIONS = {"§": "58", "s": "5", "S": "5", "$": "5", "o": "0", "O": "0", "Q": "0", "D": "0", "l": "1", "I": "1", "i": "1", "|": "1", "z": "2", "Z": "2", "b": "6", "G": "6", "t": "7", "T": "7", "?": "7", "B": "8", "g": "9", "q": "9", "a": "4", "A": "4"}
MOST_DAMAGED = 3


def digit_repairs(token: Column) -> Column:
    """All amounts that a token could be if up to three of its signs are damaged digits, ascending."""
    meant = F.create_map(*(F.lit(x) for kv in CONFUSIONS.items() for x in kv))
    damaged = lambda signs: F.size(F.filter(signs, lambda c: meant[c].isNotNull()))
    options = lambda c: F.filter(F.split(F.concat(c, F.coalesce(meant[c], F.lit(""))), ""), lambda x: x != "")

    def amounts(signs: Column) -> Column:
        longer = lambda ways, c: F.flatten(F.transform(ways, lambda w: F.transform(options(c), lambda o: F.concat(w, o))))
        ways = F.aggregate(signs, F.array(F.lit("")), longer)
        return F.array_sort(F.array_distinct(F.array_compact(F.transform(ways, V.money_token))))

    # a currency behind the number and the sentence's punctuation are no digits, damaged or not
    number = F.regexp_extract(F.trim(T.text_of(token)), r"^(.*?)\s*(?:[Vv][Nn][DdĐđ]|[Đđ])?[.,;:]*$", 1)
    signs = F.filter(F.split(number, ""), lambda x: x != "")
    return F.element_at(F.transform(F.array(signs), lambda s: F.when(damaged(s) > MOST_DAMAGED, F.array().cast("array<bigint>")).otherwise(amounts(s))), 1)


def settled_total(digits: Column, words: Column, repairs: Column) -> Column:
    """amount, reason, repaired: a total read in digits and in words; a repaired read counts only if the words say the same."""
    fixed = digits.isNull() & words.isNotNull() & F.coalesce(F.array_contains(repairs, words), F.lit(False))
    d = F.when(fixed, words).otherwise(digits)
    amount = F.when(d.isNotNull() & words.isNotNull(), F.when(d == words, d)).otherwise(F.coalesce(d, words))
    reason = F.when(d.isNull() & words.isNull(), "no-amount-on-the-line").when(words.isNull(), "digits-only").when(d.isNull(), "words-only").when(d == words, "digits-and-words-agree").otherwise("digits-and-words-disagree")
    return F.struct(amount.alias("amount"), reason.alias("reason"), fixed.alias("repaired"))


@F.pandas_udf(StructType().add("start", IntegerType()).add("words", IntegerType()).add("ratio", DoubleType()))
def best_window(tokens: pd.Series, quote: pd.Series) -> pd.DataFrame:
    """The stretch of folded tokens that is most like a folded quote (two words more or fewer), the first at ties, if it is at least 0.9 alike; else nulls.

    Alike are stretches by the letters of their matching blocks; these are a common subsequence, so its greatest length,
    carried on from word to word, bounds them and leaves few stretches to compare. One pass over the letters comes first: it
    leaves the words that such a stretch can end with. Tokens may hold several words.
    """
    from itertools import accumulate

    def matching(a: str, b: str) -> int:
        """Letters of difflib's matching blocks: the longest common block, the first of a and then of b at ties, and so on left and right of it."""
        total, todo = 0, [(a, b)]
        while todo:
            a, b = todo.pop()
            at = size = 0
            for i in range(len(a)):
                if i + size >= len(a):
                    break
                while i + size < len(a) and a[i:i + size + 1] in b:
                    at, size = i, size + 1
            if size:
                total += size
                j = b.find(a[at:at + size])
                todo += [(x, y) for x, y in ((a[:at], b[:j]), (a[at + size:], b[j + size:])) if x and y]
        return total

    def close(t: list[str], quote: str, places: dict[str, int], every: int) -> list[bool]:
        """For each token whether a stretch that ends with it can be 0.9 alike: such ones need at most 2 edits for 9 letters of the quote.

        The least number of edits between the quote and what ends at a letter, wherever that starts (Myers' bit vectors).
        """
        if not quote:
            return [True] * len(t)
        most, top, edits, up, down, ends = 2 * len(quote) // 9, len(quote) - 1, len(quote), every, 0, []
        for i, token in enumerate(t):
            for c in " " + token if i else token:
                same = places.get(c, 0)
                v = same | down
                h = ((same & up) + up ^ up) | same
                more, less = down | ~(h | up) & every, up & h
                edits += (more >> top & 1) - (less >> top & 1)
                more, less = more << 1 & every, less << 1 & every
                up, down = less | ~(v | more) & every, more & v
            ends.append(edits <= most)
        return ends

    def hopeful(texts: list[str], quotes: list[str]) -> list[bool]:
        """Whether a text has a stretch that few enough edits part from its quote: `close` for all pairs at once.

        Quotes are cut into parts of a machine word; edits of the whole fall on parts, so one part has no more than its share.
        """
        wide = [max(1, -(-len(q) // 64)) for q in quotes]
        cuts = [(i, q[len(q) * k // n:len(q) * (k + 1) // n], (2 * len(q) // 9) // n) for i, (q, n) in enumerate(zip(quotes, wide)) for k in range(n)]
        cuts.sort(key=lambda c: -len(texts[c[0]]))
        found = [not q for q in quotes]
        for first in range(0, len(cuts), 2048):
            own = [c for c in cuts[first:first + 2048] if c[1]]
            if not own:
                continue
            letters = sorted({c for _, part, _ in own for c in part})
            number = {c: n for n, c in enumerate(letters, 1)}
            code = np.zeros(0x110000, np.int32)
            code[[ord(c) for c in letters]] = range(1, len(letters) + 1)
            sizes = np.array([len(texts[i]) for i, _, _ in own])
            at = np.zeros((len(own), sizes[0]), np.int32)
            same = np.zeros((len(own), len(letters) + 1), np.uint64)
            for n, (i, part, _) in enumerate(own):
                at[n, :sizes[n]] = code[np.frombuffer(texts[i].encode("utf-32-le", "surrogatepass"), np.uint32)]
                for place, c in enumerate(part):
                    same[n, number[c]] |= np.uint64(1 << place)
            at += np.arange(len(own), dtype=np.int32)[:, None] * same.shape[1]
            at, same = np.ascontiguousarray(at.T), same.ravel()
            edits = np.array([len(part) for _, part, _ in own])
            top, least, one = (edits - 1).astype(np.uint64), edits.copy(), np.uint64(1)
            up, down = np.full(len(own), 2**64 - 1, np.uint64), np.zeros(len(own), np.uint64)
            live = len(own) - np.searchsorted(sizes[::-1], np.arange(sizes[0]), side="right")  # the longest texts come first
            for letter, n in zip(at, live):
                u, d, e, t = up[:n], down[:n], edits[:n], top[:n]
                eq = same[letter[:n]]
                v = eq | d
                h = ((eq & u) + u ^ u) | eq
                more, less = d | ~(h | u), u & h
                e += (more >> t & one).astype(np.int64)
                e -= (less >> t & one).astype(np.int64)
                np.minimum(least[:n], e, out=least[:n])
                more, less = more << one, less << one
                u[:], d[:] = less | ~(v | more), more & v
            for (i, _, most), n in zip(own, least):
                found[i] |= bool(n <= most)
        return found

    def of(t: list[str], quote: str) -> tuple[int | None, int | None, float | None]:
        wanted, best = len(quote.split()), (0.0, 0, 0)
        upto = [0, *accumulate(len(w.split()) for w in t)]
        every = (1 << len(quote)) - 1
        places: dict[str, int] = {}
        for i, c in enumerate(quote):
            places[c] = places.get(c, 0) | 1 << i
        ends = close(t, quote, places, every)
        following, last = [0] * len(t), 0
        for stop in range(len(t), 0, -1):
            last = stop if ends[stop - 1] else last
            following[stop - 1] = last
        for start in range(len(t)):
            if not following[start] or upto[following[start]] - upto[start] > wanted + 2:
                continue
            free, size = every, -1  # letters of the quote that are not in the subsequence; length of the stretch
            for stop in range(start + 1, len(t) + 1):
                words = upto[stop] - upto[start]
                if words > wanted + 2:
                    break
                for c in t[stop - 1] if stop == start + 1 else " " + t[stop - 1]:
                    seen = free & places.get(c, 0)
                    free = (free + seen | free - seen) & every
                size += 1 + len(t[stop - 1])
                both = size + len(quote)
                if ends[stop - 1] and words >= wanted - 2 and (not both or 2 * (len(quote) - free.bit_count()) / both >= max(0.9, best[0])):
                    r = 2.0 * matching(" ".join(t[start:stop]), quote) / both if both else 1.0
                    if r >= 0.9 and r > best[0]:
                        best = (r, start, stop)
        return (best[1], best[2] - best[1], best[0]) if best[0] else (None, None, None)

    pairs = [(list(a) if a is not None else [], b or "") for a, b in zip(tokens, quote)]
    some = hopeful([" ".join(a) for a, _ in pairs], [b for _, b in pairs])
    return pd.DataFrame([of(a, b) if one else (None, None, None) for (a, b), one in zip(pairs, some)], columns=["start", "words", "ratio"]).astype({"start": "Int32", "words": "Int32", "ratio": "Float64"})


def parts_coverage(parts: list[str], reads: Column) -> Column:
    """found, missing, unplaced (in declared order) and coverage of a document's required parts.

    reads: map of part to struct(value, located). A part is found if it was placed on the page, whether or not it could be
    read; a value without a place is not found.
    """
    declared = F.array(*map(F.lit, parts))
    has = lambda p: F.trim(T.text_of(reads[p]["value"])) != ""
    placed = lambda p: F.coalesce(reads[p]["located"], F.lit(False))
    found = F.filter(declared, placed)
    unplaced = F.filter(declared, lambda p: has(p) & ~placed(p))
    missing = F.filter(declared, lambda p: ~has(p) & ~placed(p))
    coverage = F.when(F.size(found) == len(parts), "complete").when(F.size(found) == 0, "none").otherwise("partial")
    return F.struct(found.alias("found"), missing.alias("missing"), unplaced.alias("unplaced"), coverage.alias("coverage"))
