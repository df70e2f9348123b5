"""Identity cards as words: which side it is, where its number stands, whose name it bears."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofsheet.functions import text as T
from proofsheet.operators import layout

#: Folded phrases that only one side has, least confidence of a readable word, length of a machine-readable token and how the first one begins, room around a number.
FRONT, BACK = ("can cuoc cong dan", "so", "ho va ten", "ngay sinh"), ("dac diem nhan dang", "ngay cap", "co quan cap", "bo cong an")
READABLE, ZONE, ZONE_START, PAD, NAME, NUMBER = 50, 20, "IDVNM", 6, "ho va ten", "so"


def cleaned(line: Column) -> Column:
    """Folded words of a card's line without the punctuation around them."""
    return F.transform(line, lambda w: F.btrim(T.fold_accents(w["text"]), F.lit(" :;.,")))


def digits(w: Column) -> Column:
    return T.digits(w["text"])


def phrase_at(line: Column, phrase: str) -> Column:
    """Number of the first word of a phrase's first appearance on a line; null without one."""
    return layout.let(cleaned(line), lambda t: F.get(F.filter(layout.upto(F.lit(0), F.size(t)), lambda i: layout.tokens_at(t, i, phrase)), F.lit(0)))


def markers(lines: Column, phrases: tuple[str, ...]) -> Column:
    """For each phrase that a line holds, the confidence of its surest appearance: that of its least sure word."""
    def surest(phrase: str) -> Column:
        n = len(phrase.split(" "))
        of = lambda line: layout.let(phrase_at(line, phrase), lambda i: F.array_min(F.transform(F.slice(line, i + 1, n), lambda w: w["conf"])))
        return F.array_max(F.transform(lines, of))

    return F.array_compact(F.array(*(surest(p) for p in phrases)))


def zone_confidence(words: Column) -> Column:
    """Confidence of a machine-readable zone: two long tokens with its signs, one of them its beginning; null without one."""
    token = lambda w: F.upper(F.regexp_replace(w["text"], "\\s", ""))
    long_ = F.filter(words, lambda w: (F.length(token(w)) >= ZONE) & (F.contains(w["text"], F.lit("<")) | F.contains(F.upper(w["text"]), F.lit("VNM"))))
    begins = F.filter(words, lambda w: (w["conf"] >= READABLE) & F.startswith(token(w), F.lit(ZONE_START)) & (F.length(token(w)) >= ZONE))
    conf = lambda a: F.transform(a, lambda w: w["conf"])
    return F.when((F.size(begins) > 0) & (F.size(long_) >= 2), F.least(F.array_max(conf(begins)), F.array_min(conf(long_))))


def only_number(words: Column) -> Column:
    """The one word of twelve digits; null if there is none or another."""
    found = F.filter(words, lambda w: (F.length(digits(w)) == 12) & (w["w"] > 0) & (w["h"] > 0) & (w["conf"] >= 0))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def card_side(words: Column, lines: Column) -> Column:
    """side (front, back, unknown) and confidence (0 to 1): two phrases of a side, or one and the number (front), or the machine-readable zone (back); both sides at once are unknown."""
    facts = F.struct(markers(lines, FRONT).alias("front"), markers(lines, BACK).alias("back"), only_number(words)["conf"].alias("number"), zone_confidence(words).alias("zone"))

    def decide(f: Column) -> Column:
        strong, numbered = F.size(f["front"]) >= 2, f["number"].isNotNull() & (F.size(f["front"]) > 0)
        front, back = strong | numbered, (F.size(f["back"]) >= 2) | f["zone"].isNotNull()
        marked = F.when(strong, F.array_min(f["front"])).otherwise(F.array_max(f["front"]))
        sure = F.when(numbered, F.least(marked, f["number"])).otherwise(marked)
        behind = F.when(F.size(f["back"]) >= 2, F.array_min(f["back"])).otherwise(f["zone"])
        side = F.when(front & back, "unknown").when(front, "front").when(back, "back").otherwise("unknown")
        return F.struct(side.alias("side"), F.when(side == "front", sure / 100).when(side == "back", behind / 100).otherwise(0.0).alias("confidence"))

    return layout.let(facts, decide)


def number_box(words: Column, lines: Column, width: Column, height: Column) -> Column:
    """Where the number stands, with a little room: the readable digits right of the first label that has any, or on the line below it, else the only word of twelve digits; null without any."""
    readable = lambda w: (w["conf"] >= READABLE) & (digits(w) != "")

    def at_label(line: Column, i: Column) -> Column:
        def of(start: Column) -> Column:
            edge = layout.right(F.slice(line, start + 1, 1))
            beside = F.filter(layout.rest(line, start + 1), lambda w: (w["x"] >= edge) & readable(w))
            below = F.filter(F.coalesce(F.get(lines, i + 1), F.slice(line, 1, 0)), readable)
            return F.when(start.isNotNull(), F.when(F.size(beside) > 0, beside).when(F.size(below) > 0, below))

        return layout.let(phrase_at(line, NUMBER), of)

    labelled = F.get(F.filter(F.transform(lines, at_label), lambda a: a.isNotNull()), F.lit(0))
    target = F.coalesce(labelled, F.when(only_number(words).isNotNull(), F.array(only_number(words))))

    def padded(b: Column) -> Column:
        x0, y0 = F.greatest(b["x"] - PAD, F.lit(0)), F.greatest(b["y"] - PAD, F.lit(0))
        x1, y1 = F.least(b["x"] + b["width"] + PAD, width), F.least(b["y"] + b["height"] + PAD, height)
        return F.when(b.isNotNull(), F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("width"), (y1 - y0).alias("height")))

    return layout.let(target, lambda t: F.when(t.isNotNull(), layout.let(layout.box(t), padded)))


def card_name(lines: Column) -> Column:
    """name and confidence (0 to 1): the readable words without digits behind the name's label, or on the next line if that stands below the label; empty and 0 without any."""
    wordy = lambda line: F.filter(line, lambda w: (w["conf"] >= READABLE) & (digits(w) == "") & (F.btrim(T.fold_accents(w["text"]), F.lit(" :;,.\t\n")) != ""))

    def at_label(line: Column, i: Column) -> Column:
        def of(start: Column) -> Column:
            label, after = F.slice(line, start + 1, 3), wordy(layout.rest(line, start + 3))
            below = F.get(lines, i + 1)
            low = lambda ws, f: F.array_min(F.transform(ws, f))
            left, bottom = low(label, lambda w: w["x"]), F.array_max(F.transform(label, lambda w: w["y"] + w["h"]))
            shift, gap = low(below, lambda w: w["x"]) - left, low(below, lambda w: w["y"]) - bottom
            room = F.greatest(F.lit(40), 2 * F.array_max(F.transform(label, lambda w: w["h"])))
            fits = shift.between(-40, layout.right(label) - left + 40) & gap.between(F.lit(0), room)
            return F.when(start.isNotNull(), F.when(F.size(after) > 0, after).when(below.isNotNull() & fits & (F.size(wordy(below)) > 0), wordy(below)))

        return layout.let(phrase_at(line, NAME), of)

    found = F.get(F.filter(F.transform(lines, at_label), lambda a: a.isNotNull()), F.lit(0))
    said = lambda ws: F.struct(F.array_join(F.transform(ws, lambda w: F.btrim(w["text"], F.lit(" :;,.\t\n"))), " ").alias("name"), (F.array_min(F.transform(ws, lambda w: w["conf"])) / 100).alias("confidence"))
    return layout.let(found, lambda ws: F.when(ws.isNotNull(), said(ws)).otherwise(F.struct(F.lit("").alias("name"), F.lit(0.0).alias("confidence"))))
