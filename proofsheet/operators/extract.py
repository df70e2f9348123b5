"""From printed lines to fields: values at labels, the best hit of each document, placeholders, name candidates, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofsheet.functions import text as T
from proofsheet.functions.session import plain_unions

#: What a field's value looks like.
PATTERNS = {"mst": r"\d{10,13}", "cccd_spaced": r"\d(?:\s*\d){8,12}", "money": r"\d{1,3}(?:[.,]\d{3})+", "date": r"\d{1,2}/\d{1,2}/\d{4}", "account": r"\d{6,16}"}
#: Folded labels, patterns in the order they are tried, and how many lines below the label count.
FIELDS = {
    "cccd": (("can cuoc", "can cuoc ho", "can cuo ho", "so cccd", "cccd so", "cœccd so"), ("cccd_spaced", "mst"), 1),
    "mst": (("msttncn", "ma so thue thu nhap ca nhan", "mst tncn", "ma so thue ca nhan"), ("cccd_spaced", "mst"), 1),
    "tk": (("so tai khoan", "tk so"), ("account",), 1),
    "ngaysinh": (("ngay sinh",), ("date",), 1),
    "phi": (("phi dich vu",), ("money",), 3),
}
CANDIDATE_HEIGHTS, CANDIDATE_CHARS, MOST_CANDIDATES = 5, 80, 24


def locate(lines: Column, anchors: tuple[str, ...], patterns: tuple[str, ...], lookahead: int = 1, rows: Column | None = None) -> Column:
    """Exactly one hit for each line that holds a folded anchor: line, value (without white space; empty if unread), pattern, ahead.

    Patterns are tried in order; each on the line, on its visual row (rows[i], if given), then on the lines below, the
    nearest first. ahead is how far below the value stood, null if there is none.
    """
    def at(i: Column) -> Column:
        tries = []
        for p in patterns:
            places = [(F.get(lines, i), 0)] + ([(F.get(rows, i), 0)] if rows is not None else []) + [(F.get(lines, i + k), k) for k in range(1, lookahead + 1)]
            for text, k in places:
                value = F.regexp_replace(F.regexp_extract(F.coalesce(text, F.lit("")), p, 0), r"\s+", "")
                tries.append(F.when(value != "", F.struct(value.alias("value"), F.lit(p).alias("pattern"), F.lit(k).alias("ahead"))))
        none = F.struct(F.lit("").alias("value"), F.lit(None).cast("string").alias("pattern"), F.lit(None).cast("int").alias("ahead"))
        hit = F.coalesce(*tries, none)
        return F.struct(i.alias("line"), hit["value"].alias("value"), hit["pattern"].alias("pattern"), hit["ahead"].alias("ahead"))

    def holds(i: Column) -> Column:
        folded = T.fold_accents(F.get(lines, i))
        out = F.lit(False)
        for a in anchors:
            out = out | F.contains(folded, F.lit(a))
        return out

    return F.transform(F.filter(F.sequence(F.lit(0), F.size(lines) - 1), holds), at)


def is_labelled(anchor: Column, following: Column) -> Column:
    """Whether an anchor stands as a label: a colon ends it or comes next, or it is all capitals."""
    return F.rtrim(anchor).endswith(":") | F.startswith(F.trim(T.text_of(following)), F.lit(":")) | (anchor.rlike("\\p{L}") & (anchor == F.upper(anchor)))


def best_hits(hits: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One hit for each of keys: one with a value if there is any, then by rank and confidence, the first at ties."""
    rest = [c for c in hits.columns if c not in keys]
    place = F.struct((F.col("value") != "").alias("readable"), F.coalesce("rank", F.lit(0)).alias("rank"), F.col("confidence"), (-F.col(order)).alias("order"))
    return hits.groupBy(*keys).agg(F.max_by(F.struct(*rest), place).alias("h")).select(*keys, *(F.col(f"h.{c}") for c in rest))


def best_values(hits: DataFrame, keys: list[str], order: str, most: int = 3) -> DataFrame:
    """keys, value, rank, confidence, place: equal values as one, by rank and confidence; at ties in order of first sight; the first `most`."""
    score = F.struct(F.coalesce("rank", F.lit(0)).alias("rank"), F.col("confidence").alias("confidence"))
    own = hits.groupBy(*keys, "value").agg(F.max(score).alias("s"), F.min(order).alias("first"))
    w = Window.partitionBy(*keys).orderBy(F.desc("s.rank"), F.desc("s.confidence"), "first")
    return own.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select(*keys, "value", "s.rank", "s.confidence", "place")


def with_placeholders(best: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """best, and an empty source (no document, page 0, confidence 0) for each wanted field that no document has."""
    empty = {"doc_id": F.lit(""), "page": F.lit(0), "value": F.lit(""), "confidence": F.lit(0.0)}
    own = best.select(*keys, *empty)
    types = dict(own.dtypes)
    gone = wanted.select(*keys).distinct().join(own, keys, "left_anti")
    return plain_unions(own).unionByName(gone.select(*keys, *(v.cast(types[c]).alias(c) for c, v in empty.items())))


def attach_places(reads: DataFrame, places: DataFrame, keys: list[str]) -> DataFrame:
    """reads with page and box of their quote and located; reads whose quote was not found stay, with located false."""
    p = places.select(*keys, "page", "box", F.lit(True).alias("located"))
    return reads.join(p, keys, "left").withColumn("located", F.coalesce("located", F.lit(False)))


def requested_reads(reads: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Of what a reader returned, the requested fields that have a value and a quote."""
    full = reads.filter((F.trim(T.text_of(F.col("value"))) != "") & (F.trim(T.text_of(F.col("quote"))) != ""))
    return full.join(wanted.select(*keys).distinct(), keys, "left_semi")


def last_anchors(hits: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last hit, in reading order, of each of keys (document and party): earlier ones are mentions in the body."""
    rest = [c for c in hits.columns if c not in keys]
    return hits.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("h")).select(*keys, *(F.col(f"h.{c}") for c in rest))


def name_candidates(lines: DataFrame, keys: list[str], page: str, order: str, within: float = CANDIDATE_HEIGHTS, most: int = MOST_CANDIDATES) -> DataFrame:
    """keys, page, text, gap, place: lines within five line heights of a labelled line of their page, the nearest first.

    lines: keys, page, order, text, y, h, labelled. Pages meet themselves only, so the pairs of a page are its lines
    times its labels. Blank and long lines are left out.
    """
    label = lines.filter("labelled").select(*keys, page, F.col("y").alias("__y"), F.greatest("h", F.lit(1)).alias("__h"))
    gap = F.min(F.abs(F.col("y") - F.col("__y")) / F.col("__h"))
    near = lines.join(label, [*keys, page]).groupBy(*keys, page, order, "text").agg(gap.alias("gap")).filter(F.col("gap") <= within)
    text = F.trim("text")
    near = near.withColumn("text", text).filter((F.col("text") != "") & (F.length("text") <= CANDIDATE_CHARS))
    w = Window.partitionBy(*keys).orderBy("gap", page, order)
    return near.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select(*keys, page, "text", "gap", "place")


#: How far the reading of a total is to be trusted, the best first.
READS = ("digits-and-words-agree", "digits-and-words-disagree", "digits-only", "words-only")
FRONT_PAGES = 40


def best_total(reads: DataFrame, keys: list[str]) -> DataFrame:
    """The most trustworthy read (reason, page, amount) of each of keys, the earliest page, then the least amount, at ties; reads without an amount do not count."""
    rank = F.array_position(F.array(*map(F.lit, READS)), F.col("reason"))
    return reads.filter(rank > 0).groupBy(*keys).agg(F.min_by(F.struct("page", "reason", "amount"), F.struct(rank, F.col("page"), F.col("amount"))).alias("r")).select(*keys, "r.*")


def listing_total(front: DataFrame, totals: DataFrame, keys: list[str], most: int = FRONT_PAGES) -> DataFrame:
    """keys, page, reason, amount: the last page before the first packet that holds a total, no further back than `most` pages.

    front: keys, front_pages; totals: keys, page, reason, amount (of best_total by page). Without a hit the reason is
    front-matter-too-long if pages were left out; else the key is left out.
    """
    seen = totals.join(front, keys).filter(F.expr(f"page < front_pages and page >= front_pages - {most}"))
    last = seen.groupBy(*keys).agg(F.max_by(F.struct("page", "reason", "amount"), F.col("page")).alias("r"))
    both = front.filter("front_pages > 0").join(last, keys, "left")
    out = both.filter(F.col("r").isNotNull() | (F.col("front_pages") > most))
    return out.select(*keys, "r.page", F.coalesce("r.reason", F.lit("front-matter-too-long")).alias("reason"), "r.amount")


def upright_turn(turn: Column, confidence: Column, least: float = 1.5) -> Column:
    """Degrees to turn a page counter-clockwise: what is left to a whole turn, 0 if the reading is not one of the three turns or too unsure."""
    return F.when(turn.isin(90, 180, 270) & (confidence >= least), (360 - turn) % 360).otherwise(0)


def scaled(words: DataFrame, factor: Column) -> DataFrame:
    """words (x, y, w, h) in other pixels, half to even."""
    return words.withColumns({c: F.bround(F.col(c) * factor, 0).cast("int") for c in ("x", "y", "w", "h")})
