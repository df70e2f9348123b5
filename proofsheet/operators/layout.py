"""Printed pages as geometry: visual rows, two-column blocks, value slots, what stands at a label, and names.

A page's words (structs with at, text, x, y, w, h, conf; `at` is the word's number on its page) become lines and visual
rows once (`page_rows`, `page_lines`); everything else is an expression over one line, its row and the lines below, so a
page is one row of a table and pages are dealt freely.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofsheet.functions import text as T
from proofsheet.functions.session import plain_unions
from proofsheet.operators import extract, segments

WORD = ("at", "text", "x", "y", "w", "h", "conf")
#: Folded labels of a name in the order in which they count, the one that either party's column carries, and the heading of the second party's column.
NAME_ANCHORS = ("ben cung ung dich vu", "ten nguoi nop thue", "ten toi la", "en toi la", "ho va ten")
EITHER_PARTY = ("ho va ten",)
SECOND_PARTY = "ben cung ung dich vu"
#: Every label that a field is known by: none of them is a value.
KNOWN = tuple(dict.fromkeys((*NAME_ANCHORS, *(a for anchors, _, _ in extract.FIELDS.values() for a in anchors))))
#: Confidence of print, share of a page's width that parts columns, rows that make a block, room behind a label, width of an empty slot (share of the page, pixels), length of what is kept beside a label.
PRINT, GUTTER, BLOCK_ROWS, PAD, SLOT_SHARE, SLOT_LEAST, NEAR_CHARS = 50, 0.045, 2, 4, 0.3, 40, 120
SAME_ROW = 0.5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def upto(start: Column, end: Column) -> Column:
    """start ... end - 1; none if that is empty."""
    return F.when(end > start, F.sequence(start, F.greatest(end - 1, start))).otherwise(F.array().cast("array<int>"))


def rest(a: Column, start: Column, end: Column | None = None) -> Column:
    """a[start:end]."""
    end = F.size(a) if end is None else end
    return F.slice(a, start + 1, F.greatest(end - start, F.lit(0)))


def by_x(words: Column) -> Column:
    return segments.ordered_by(words, "x")


def right(words: Column) -> Column:
    return F.array_max(F.transform(words, lambda w: w["x"] + w["w"]))


def span(line: Column) -> Column:
    """Upper and lower end of a line."""
    top, bottom = F.array_min(F.transform(line, lambda w: w["y"])), F.array_max(F.transform(line, lambda w: w["y"] + w["h"]))
    return F.struct(top.alias("top"), bottom.alias("bottom"))


def same_row(a: Column, b: Column) -> Column:
    """Whether two spans share at least half of the shorter one; spans without height share nothing."""
    shared = F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"])
    shorter = F.least(a["bottom"] - a["top"], b["bottom"] - b["top"])
    return (shorter > 0) & (shared / F.nullif(shorter, F.lit(0)) >= SAME_ROW)


def page_rows(words: DataFrame, keys: list[str], tolerance: int = 8) -> DataFrame:
    """keys, lines, rows, width: a page's lines from top to bottom, the visual row of each (the words of all lines on its height, from left to right), and how far to the right the page reaches."""
    # a word is folded once, here: labels are looked for many times
    pages = words.withColumn("folded", T.fold_accents(F.col("text"))).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*WORD, "folded"))).alias("words"))
    pages = pages.select(*keys, segments.group_lines(F.col("words"), tolerance).alias("lines"), right(F.col("words")).alias("width"))
    pages = pages.withColumn("spans", F.transform("lines", span))
    beside = lambda s: by_x(F.flatten(F.filter("lines", lambda _, j: same_row(s, F.get("spans", j)))))
    return pages.select(*keys, "lines", F.transform("spans", beside).alias("rows"), "width")


def page_lines(pages: DataFrame, keys: list[str], below: int = 3) -> DataFrame:
    """A row a line: keys, line_no, line, row, below (the next lines), width, and blocks if the pages have them."""
    more = [c for c in ("width", "blocks") if c in pages.columns]
    each = F.transform("lines", lambda line, i: F.struct(i.alias("line_no"), line.alias("line"), F.get("rows", i).alias("row"), F.slice("lines", i + 2, below).alias("below")))
    return pages.select(*keys, *more, F.inline(each))


# ---------------------------------------------------------------- two-column blocks

def places(texts: Column) -> Column:
    """Where each of the texts starts when they are joined by blanks."""
    return F.transform(texts, lambda _, i: i + F.aggregate(F.slice(texts, F.lit(1), i), F.lit(0), lambda n, t: n + F.length(t)))


def covered(texts: Column, start: Column, length: Column) -> Column:
    """Numbers of the texts that a stretch of their join touches."""
    def touched(at: Column) -> Column:
        return F.filter(upto(F.lit(0), F.size(texts)), lambda i: (F.get(at, i) + F.length(F.get(texts, i)) > start) & (F.get(at, i) < start + length))

    return let(places(texts), touched)


def folded(words: Column) -> Column:
    return F.transform(words, lambda w: w["folded"])


def anchor_words(words: Column, anchor: str) -> Column:
    """Numbers of the words that hold the first appearance of a folded phrase; none if it does not appear."""
    at = lambda t: F.instr(F.array_join(t, " "), anchor)
    return let(folded(words), lambda t: F.when(at(t) > 0, covered(t, at(t) - 1, F.lit(len(anchor)))).otherwise(F.array().cast("array<int>")))


def header_band(row: Column, least: Column) -> Column:
    """lo, hi: the clear band left of the second party's heading, if that heading ends the row and something stands before the band; else null."""
    def band(words: Column) -> Column:
        def of(own: Column) -> Column:
            lo, hi = right(F.slice(words, F.lit(1), own[0])), F.get(words, own[0])["x"]
            fits = (F.size(own) > 0) & (own[0] > 0) & (F.element_at(own, -1) == F.size(words) - 1) & (hi - lo >= least)
            return F.when(fits, F.struct(lo.alias("lo"), hi.alias("hi")))

        return let(F.coalesce(F.nullif(anchor_words(words, SECOND_PARTY), F.array().cast("array<int>")), F.array(F.lit(0))), of)

    return let(F.filter(row, lambda w: w["conf"] >= PRINT), band)


def clear_part(lo: Column, hi: Column, row: Column, width: Column) -> Column:
    """size, lo, hi of the widest stretch of lo ... hi that no word of a row (from left to right) covers, the leftmost at ties."""
    def stretch(k: Column) -> Column:
        before = F.when(k == 0, F.lit(0)).otherwise(right(F.slice(row, F.lit(1), k)))
        a = F.greatest(lo, before)
        z = F.least(hi, F.when(k < F.size(row), F.get(row, k)["x"]).otherwise(F.greatest(width, before)))
        return F.struct((z - a).alias("size"), (-k).alias("first"), a.alias("lo"), z.alias("hi"))

    return F.array_max(F.transform(F.sequence(F.lit(0), F.size(row)), stretch))


def column_blocks(rows: Column, width: Column) -> Column:
    """top, bottom, gutter of a page's two-column blocks.

    A block opens at a row with the second party's heading. Below it the clear band narrows row by row; rows with words
    on both sides of it extend the block, the second row in turn that has not ends it, and so does one that leaves no band.
    At least two rows make a block; its gutter is the middle of the band that all of them leave clear.
    """
    least = F.greatest(F.rint(width * GUTTER).cast("int"), F.lit(1))
    top = lambda r: span(r)["top"]
    ordered = F.array_sort(F.array_distinct(F.filter(rows, lambda r: F.size(r) > 0)), lambda a, b: F.when(top(a) < top(b), -1).when(top(a) > top(b), 1).otherwise(0))

    def state(lo: Column, hi: Column, bottom: Column, n: Column, one_sided: Column, open_: Column) -> Column:
        return F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), bottom.cast("int").alias("bottom"), n.cast("int").alias("n"), one_sided.cast("int").alias("one_sided"), open_.alias("open"))

    def extend(s: Column, row: Column) -> Column:
        def by(c: Column) -> Column:
            closed = state(s["lo"], s["hi"], s["bottom"], s["n"], s["one_sided"], F.lit(False))
            both = F.exists(row, lambda w: w["x"] + w["w"] <= c["lo"]) & F.exists(row, lambda w: w["x"] >= c["hi"])
            skipped = state(s["lo"], s["hi"], s["bottom"], s["n"], s["one_sided"] + 1, s["one_sided"] < 1)
            longer = state(c["lo"], c["hi"], span(row)["bottom"], s["n"] + 1, F.lit(0), F.lit(True))
            return F.when(~s["open"], s).when(c["size"] < least, closed).when(both, longer).otherwise(skipped)

        return let(clear_part(s["lo"], s["hi"], row, width), by)

    def blocks(all_rows: Column) -> Column:
        def block(row: Column, i: Column) -> Column:
            def grown(band: Column) -> Column:
                first = state(band["lo"], band["hi"], span(row)["bottom"], F.lit(0), F.lit(0), F.lit(True))
                last = F.aggregate(rest(all_rows, i + 1), first, extend)
                return let(last, lambda s: F.when(s["n"] >= BLOCK_ROWS, F.struct(top(row).alias("top"), s["bottom"].alias("bottom"), F.floor((s["lo"] + s["hi"]) / 2).cast("int").alias("gutter"))))

            return let(header_band(row, least), lambda b: F.when(b.isNotNull(), grown(b)))

        return F.filter(F.transform(all_rows, block), lambda b: b.isNotNull())

    return let(ordered, blocks)


def party_of(box: Column, blocks: Column) -> Column:
    """a or b for the column of the first block on the box's middle height that it stands in, straddle if it crosses the gutter; null outside of blocks."""
    middle = box["y"] + box["height"] / 2
    of = lambda g: F.when(box["x"] + box["width"] <= g, "a").when(box["x"] >= g, "b").when(g.isNotNull(), "straddle")
    return let(F.get(F.filter(blocks, lambda b: middle.between(b["top"], b["bottom"])), F.lit(0))["gutter"], of)


def party_boxes(boxes: DataFrame, blocks: DataFrame, keys: list[str], order: str) -> DataFrame:
    """boxes (keys, x, y, width, height, ...) with party, by blocks (keys, `order`, top, bottom, gutter), as party_of has it.

    Neither side is paired: what each block, from the top, adds to those before it is a stretch of its own, and one running
    pass over the bounds of these stretches and the boxes' middles gives each middle the stretch that it is in. A page is
    passed by its heights, not by its boxes and blocks: each middle stands there once, and of the blocks with one top those
    that reach further than the ones before them. So a page's pass is as long as its print is high, however many boxes it
    has; these are dealt by page and height when they meet their stretch. Boxes with blank keys or heights are in no block.
    """
    same = blocks.groupBy(*keys, "top", "bottom").agg(F.min(F.struct(order, "gutter")).alias("__o"))
    level = Window.partitionBy(*keys, "top").orderBy(f"__o.{order}").rowsBetween(Window.unboundedPreceding, -1)
    same = same.withColumn("__reached", F.max("bottom").over(level)).filter("__reached is null or bottom > __reached")
    before = Window.partitionBy(*keys).orderBy("top", f"__o.{order}").rowsBetween(Window.unboundedPreceding, -1)
    own = same.select(*keys, "top", "bottom", "__o.gutter", F.max("bottom").over(before).alias("covered")).filter("covered is null or bottom > covered")
    own = own.withColumn("after", F.coalesce(F.col("covered") >= F.col("top"), F.lit(False)))  # such a stretch begins just behind the one before
    middle = F.col("y") + F.col("height") / 2
    start = F.when(F.col("after"), F.col("covered")).otherwise(F.col("top")).cast("double")
    # of equal heights: stretches that include their start, the middles, then stretches that begin behind it
    marks = own.select(*keys, start.alias("__at"), F.when(F.col("after"), 2).otherwise(0).alias("__turn"), F.struct(F.col("bottom").cast("double").alias("bottom"), "gutter").alias("__b"))
    heights = plain_unions(boxes).select(*keys, middle.cast("double").alias("__at")).distinct().withColumn("__turn", F.lit(1))
    running = Window.partitionBy(*keys).orderBy("__at", "__turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = heights.unionByName(marks, allowMissingColumns=True).withColumn("__s", F.last("__b", ignorenulls=True).over(running))
    inside = seen.filter("__turn = 1 and __at <= __s.bottom").select(*keys, "__at", F.col("__s.gutter").alias("__g"))
    g = F.col("__g")
    party = F.when(F.col("x") + F.col("width") <= g, "a").when(F.col("x") >= g, "b").when(g.isNotNull(), "straddle")
    return boxes.withColumn("__at", middle.cast("double")).join(inside, [*keys, "__at"], "left").withColumn("party", party).select(*boxes.columns, "party")


# ---------------------------------------------------------------- labels, slots, values

def cleaned(words: Column) -> Column:
    """page_rows' words folded, without the punctuation around them."""
    return F.transform(folded(words), lambda f: F.btrim(f, F.lit(" :;.,")))


def tokens_at(tokens: Column, i: Column, phrase: str) -> Column:
    return F.slice(tokens, i + 1, len(phrase.split(" "))) == F.split(F.lit(phrase), " ")


def occurrences(tokens: Column, anchors: Iterable[str]) -> Column:
    """at, n, anchor: the anchors that appear as whole tokens, from left to right without overlap; of several at one place the first of `anchors`."""
    return let(tokens, lambda own: _occurrences(own, tuple(anchors)))  # the tokens are looked at over and over


def _occurrences(tokens: Column, anchors: tuple[str, ...]) -> Column:
    none = F.array().cast("array<struct<at:int,n:int,anchor:int>>")

    def step(s: Column, i: Column) -> Column:
        opens = F.get(tokens, i).isin(sorted({a.split(" ")[0] for a in anchors}))  # few tokens do; the others meet no phrase
        hit = F.coalesce(*(F.when(opens & tokens_at(tokens, i, a), F.struct(i.alias("at"), F.lit(len(a.split(" "))).alias("n"), F.lit(k).alias("anchor"))) for k, a in enumerate(anchors)))
        return let(F.when(i >= s["free"], hit), lambda h: F.when(h.isNull(), s).otherwise(F.struct((h["at"] + h["n"]).alias("free"), F.concat(s["found"], F.array(h)).alias("found"))))

    return F.aggregate(upto(F.lit(0), F.size(tokens)), F.struct(F.lit(0).alias("free"), none.alias("found")), step, lambda s: s["found"])


def next_label(line: Column, start: Column, most: int = 4) -> Column:
    """Number of the first word from `start` on at which another label begins: a known one, or up to four printed words without digits, the last with a colon; null if there is none."""
    short = [a for a in KNOWN if len(a.split(" ")) <= most]
    wordy = lambda w: let(F.trim(F.rtrim(w["text"], F.lit(":;., "))), lambda c: (c != "") & ~c.rlike("\\p{Nd}") & (w["conf"] >= PRINT))

    def begins(i: Column) -> Column:
        ahead = F.slice(line, i + 1, most)
        known = let(F.concat(F.array_join(folded(ahead), " "), F.lit(" ")), lambda t: F.greatest(*(F.startswith(t, F.lit(a + " ")) for a in short)))
        run = F.exists(F.sequence(F.lit(1), F.size(ahead)), lambda n: F.forall(F.slice(ahead, F.lit(1), n), wordy) & F.endswith(F.rtrim(F.element_at(ahead, n)["text"]), F.lit(":")))
        return known | run

    return F.get(F.filter(upto(start, F.size(line)), begins), F.lit(0))


def box(words: Column) -> Column:
    return segments.union_box(words)


def value_slot(line: Column, label: Column, start: Column, width: Column) -> Column:
    """The box in which a label's value must stand: from its right end to the next label of the line, or about a third of the page."""
    room = F.greatest(F.rint(width * SLOT_SHARE).cast("int"), F.lit(SLOT_LEAST))
    facts = F.struct((right(label) + PAD).alias("x0"), F.get(line, next_label(line, start))["x"].alias("next"), span(line).alias("s"))

    def slot(f: Column) -> Column:
        edge, s = f["next"] - f["x0"], f["s"]
        return F.struct(f["x0"].alias("x"), s["top"].alias("y"), F.when(edge > 0, edge).otherwise(room).alias("width"), (s["bottom"] - s["top"]).alias("height"))

    return let(facts, slot)


def label_slot(line: Column, anchors: tuple[str, ...], width: Column) -> Column:
    """The slot of the first of the anchors that the line holds; the whole line if none does."""
    tries = [let(anchor_words(line, a), lambda own: F.when(F.size(own) > 0, value_slot(line, F.transform(own, lambda i: F.get(line, i)), F.element_at(own, -1) + 1, width))) for a in anchors]
    return F.coalesce(*tries, box(line))


def matched(line: Column, pattern: str) -> Column:
    """value (without white space), box and confidence of a pattern's first match on a line, from the words that it covers; null without one."""
    def of(texts: Column) -> Column:
        joined = F.array_join(texts, " ")
        found, at = F.regexp_extract(joined, pattern, 0), F.regexp_instr(joined, F.lit(pattern)) - 1
        own = lambda i: F.transform(i, lambda k: F.get(line, k))
        hit = let(covered(texts, at, F.length(found)), lambda i: F.when(F.size(i) > 0, F.struct(F.regexp_replace(found, "\\s+", "").alias("value"), box(own(i)).alias("box"), (F.array_min(F.transform(own(i), lambda w: w["conf"])) / 100).alias("confidence"))))
        return F.when(found != "", hit)

    return let(F.transform(line, lambda w: w["text"]), of)


def near_label(row: Column, below: Column, anchors: tuple[str, ...]) -> Column:
    """What is printed at a label: from it to the next known label, over its row and the lines below that may hold its value; 120 signs at most."""
    mine = [KNOWN.index(a) for a in anchors]

    def of(words: Column, found: Column) -> Column:
        first = F.get(F.filter(upto(F.lit(0), F.size(found)), lambda i: F.get(found, i)["anchor"].isin(mine)), F.lit(0))
        start, stop = F.coalesce(F.get(found, first)["at"], F.lit(0)), F.coalesce(F.get(found, first + 1)["at"], F.size(words))
        return F.substring(T.collapse(F.array_join(F.transform(rest(words, start, stop), lambda w: w["text"]), " ")), 1, NEAR_CHARS)

    return let(F.concat(row, F.flatten(below)), lambda words: let(occurrences(cleaned(words), KNOWN), lambda found: of(words, found)))


HIT = "struct<value:string,box:struct<x:int,y:int,width:int,height:int>,confidence:double>"


def field_hits(lines: DataFrame, field: str) -> DataFrame:
    """page_lines' lines that hold a label of the field, with value, box, confidence and near.

    Each pattern is tried on the line, on its row, then on the lines below, the nearest first; a label without a value
    gives an empty value, confidence 0 and the slot where it must stand.
    """
    anchors, patterns, ahead = extract.FIELDS[field]
    whole = F.array_join(folded(F.col("line")), " ")
    held = lines.filter(F.greatest(*(F.contains(whole, F.lit(a)) for a in anchors)) if len(anchors) > 1 else F.contains(whole, F.lit(anchors[0])))
    tries = []
    for name in patterns:
        p = extract.PATTERNS[name]
        tries += [matched(F.col("line"), p), matched(F.col("row"), p), *(F.when(F.size("below") > k, matched(F.get("below", F.lit(k)), p)) for k in range(ahead))]
    unread = F.struct(F.lit("").alias("value"), label_slot(F.col("line"), anchors, F.col("width")).alias("box"), F.lit(0.0).alias("confidence"))
    near = near_label(F.col("row"), F.slice("below", F.lit(1), F.lit(ahead)), anchors)
    out = held.withColumn("__hit", F.coalesce(*(t.cast(HIT) for t in tries), unread.cast(HIT))).withColumn("near", near)
    return out.select(*(c for c in lines.columns if c not in ("line", "row", "below", "blocks", "width")), F.lit(field).alias("field_key"), "__hit.*", "near")


# ---------------------------------------------------------------- names

def person(words: Column) -> Column:
    """Two to five words of letters alone, each with a capital."""
    return F.size(words).between(2, 5) & F.forall(words, lambda w: F.btrim(w["text"], F.lit(" :;.,")).rlike("^\\p{Lu}\\p{L}*$"))


def printed(words: Column) -> Column:
    return (F.size(words) > 0) & F.forall(words, lambda w: w["conf"] >= PRINT)


def without_colon(words: Column) -> Column:
    return F.when(F.trim(F.get(words, F.lit(0))["text"]) == ":", rest(words, F.lit(1))).otherwise(words)


def behind(row: Column, found: Column, start: Column) -> Column:
    """The words of a row from `start` to the next anchor."""
    stop = F.coalesce(F.array_min(F.filter(F.transform(found, lambda o: o["at"]), lambda at: at >= start)), F.size(row))
    return without_colon(rest(row, start, stop))


def opens_label(words: Column) -> Column:
    """Whether the words end in the beginning of a name's label."""
    def tail(tokens: Column, k: Column) -> Column:
        own = rest(tokens, k)
        return F.greatest(*(F.slice(F.split(F.lit(a), " "), F.lit(1), F.size(own)) == own for a in NAME_ANCHORS))

    return let(cleaned(words), lambda t: F.exists(upto(F.lit(0), F.size(t)), lambda k: tail(t, k)))


NAME_HIT = "struct<value:string,box:struct<x:int,y:int,width:int,height:int>,confidence:double,rank:int>"


def read_name(value: Column, label: Column, own_label: Column, blocks: Column) -> Column:
    """The hit of a readable name: sure if it and its label are in the second party's column, or, outside of columns, if the
    label is only that party's; null in the first party's column under a label of either; unread if columns and label disagree."""
    def of(b: Column) -> Column:
        known = F.struct(F.array_join(F.transform(value, lambda w: w["text"]), " ").alias("value"), b.alias("box"), (F.array_min(F.transform(value, lambda w: w["conf"])) / 100).alias("confidence"))
        hit = lambda rank: F.struct(known["value"].alias("value"), b.alias("box"), known["confidence"].alias("confidence"), rank.alias("rank")).cast(NAME_HIT)
        unread = F.struct(F.lit("").alias("value"), b.alias("box"), F.lit(0.0).alias("confidence"), F.lit(0).alias("rank")).cast(NAME_HIT)
        parties = F.struct(party_of(box(label), blocks).alias("label"), party_of(b, blocks).alias("value"))
        return let(parties, lambda p: F.when(p["label"].isNull() & p["value"].isNull(), hit(own_label.cast("int"))).when((p["label"] == "b") & (p["value"] == "b"), hit(F.lit(1))).when((p["label"] == "a") & ~own_label, F.lit(None).cast(NAME_HIT)).otherwise(unread))

    return let(box(value), of)


def name_hits(lines: DataFrame, keys: list[str], next_line: bool = True) -> DataFrame:
    """keys, line_no, at, value, box, confidence, rank of every labelled place of a name on page_lines' lines (with blocks).

    The first label of a line (by order of NAME_ANCHORS) reads the rest of its line, or the next line; the label's visual
    row counts where it only goes on from there, or where the columns say that it is the second party's. Other labels of
    the row count in the second party's column alone. What cannot be read is an empty value at its slot.
    """
    line, row, blocks, width = (F.col(c) for c in ("line", "row", "blocks", "width"))
    # a label ends in one of these words; lines without any are left out before anything is matched
    last = [a.split(" ")[-1] for a in NAME_ANCHORS]
    ends = lambda words: F.exists(words, lambda w: F.btrim(w["folded"], F.lit(" :;.,")).isin(last))
    x = lines.filter(ends(line) | ends(row)).withColumn("__t", cleaned(line)).withColumn("__o", occurrences(cleaned(row), NAME_ANCHORS))
    first = lambda a: F.get(F.filter(upto(F.lit(0), F.size("__t")), lambda i: tokens_at(F.col("__t"), i, a)), F.lit(0))
    tries = [F.struct(first(a).alias("at"), F.lit(len(a.split(" "))).alias("n"), F.lit(k).alias("anchor")) for k, a in enumerate(NAME_ANCHORS)]
    x = x.withColumn("__p", F.coalesce(*(F.when(t["at"].isNotNull(), t) for t in tries))).filter(F.col("__p").isNotNull() | (F.size("__o") > 0))
    own = lambda k: ~k.isin([NAME_ANCHORS.index(a) for a in EITHER_PARTY])
    said = lambda words: F.array_join(F.transform(words, lambda w: w["text"]), " ")
    labelled = lambda words, at, n: extract.is_labelled(said(F.slice(words, at + 1, n)), F.get(words, at + n)["text"])
    unread = lambda words, label, start: F.struct(F.lit("").alias("value"), value_slot(words, label, start, width).alias("box"), F.lit(0.0).alias("confidence"), F.lit(0).alias("rank")).cast(NAME_HIT)

    p = F.col("__p")
    word = F.get(line, p["at"])["at"]  # the label's first word
    place = F.array_position(F.transform(row, lambda w: w["at"]), word).cast("int") - 1
    after = without_colon(rest(line, p["at"] + p["n"]))
    x = x.withColumn("__label", F.slice(line, p["at"] + 1, p["n"])).withColumn("__place", place)
    x = x.withColumn("__line", F.when((F.size(after) == 0) & F.lit(next_line), F.coalesce(F.get("below", F.lit(0)), after)).otherwise(after))
    same = F.exists("__o", lambda o: (o["at"] == F.col("__place")) & (o["n"] == p["n"]) & (o["anchor"] == p["anchor"]))
    x = x.withColumn("__row", F.when(same, behind(row, F.col("__o"), F.col("__place") + p["n"])).otherwise(F.slice(row, 1, 0)))
    a, r = F.col("__line"), F.col("__row")
    good = printed(r) & person(r)
    goes_on = (F.size(a) > 0) & (F.size(r) > F.size(a)) & (F.slice(F.transform(r, lambda w: w["at"]), F.lit(1), F.size(a)) == F.transform(a, lambda w: w["at"])) & ~opens_label(rest(r, F.size(a)))
    ours = party_of(box(F.col("__label")), blocks) == "b"
    x = x.withColumn("__value", F.when(good & (F.coalesce(ours, F.lit(False)) | goes_on), r).otherwise(a))
    value, label = F.col("__value"), F.col("__label")
    main = F.when(p.isNotNull() & labelled(line, p["at"], p["n"]), F.when(person(value), read_name(value, label, own(p["anchor"]), blocks)).otherwise(unread(line, label, p["at"] + p["n"])))

    def further(o: Column) -> Column:
        """Another label of the row, in the second party's column."""
        at, n = o["at"], o["n"]
        mark = F.slice(row, at + 1, n)
        got = behind(row, F.col("__o"), at + n)
        hit = let(got, lambda v: F.when(printed(v) & person(v), read_name(v, mark, own(o["anchor"]), blocks)).otherwise(unread(row, mark, at + n)))
        return F.when(labelled(row, at, n) & (party_of(box(mark), blocks) == "b"), hit)

    held = F.transform(line, lambda w: w["at"])
    others = F.filter("__o", lambda o: let(F.get(row, o["at"])["at"], lambda at: F.array_contains(held, at) & ~F.coalesce(at == word, F.lit(False))))
    every = F.concat(F.array(main), F.transform(others, further))
    return x.select(*keys, "line_no", F.posexplode(every).alias("at", "h")).filter("h is not null").select(*keys, "line_no", "at", "h.*")


def find_names(pages: DataFrame, keys: list[str], most: int = 3) -> DataFrame:
    """keys, value, box, confidence, rank, place: the names of page_rows' pages, equal ones as one, by rank and confidence, in order of first sight at ties."""
    held = pages.withColumn("blocks", column_blocks(F.col("rows"), F.col("width")))
    hits = name_hits(page_lines(held, keys, 1), keys)
    order = F.struct("line_no", "at")
    one = hits.groupBy(*keys, "value").agg(F.max_by(F.struct("box", "confidence", "rank"), F.struct("rank", "confidence", -F.col("line_no"), -F.col("at"))).alias("h"), F.min(order).alias("first"))
    w = Window.partitionBy(*keys).orderBy(F.desc("h.rank"), F.desc("h.confidence"), "first")
    return one.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select(*keys, "value", "h.box", "h.confidence", "h.rank", "place")
