"""Cutting pages into packets and documents with windows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofsheet.functions import text as T
from proofsheet.functions.session import plain_unions


def largest_gap(scores: DataFrame, keys: list[str], score: str, order: str) -> DataFrame:
    """keys, threshold: the middle of the widest step between neighbours in ascending order, the first at ties; a lone score is its own threshold."""
    w = Window.partitionBy(*keys).orderBy(score, order)
    steps = scores.withColumn("__next", F.lead(score).over(w)).withColumn("__at", F.row_number().over(w))
    gap = F.struct((F.col("__next") - F.col(score)).alias("gap"), (-F.col("__at")).alias("at"))
    return steps.groupBy(*keys).agg(F.max_by(F.when(F.col("__next").isNotNull(), (F.col(score) + F.col("__next")) / 2), F.when(F.col("__next").isNotNull(), gap)).alias("__mid"), F.max(score).alias("__lone")).select(*keys, F.coalesce("__mid", "__lone").alias("threshold"))


def packet_bounds(starts: DataFrame, keys: list[str], start: str, total: Column) -> DataFrame:
    """page_start, page_end of each packet: to before the next start, the last to the end; pages before the first start belong to none."""
    w = Window.partitionBy(*keys).orderBy(start)
    return starts.select(*keys, F.col(start).alias("page_start"), F.coalesce(F.lead(start).over(w) - 1, total - 1).alias("page_end"), (F.row_number().over(w) - 1).alias("packet"))


def containing(points: DataFrame, ranges: DataFrame, keys: list[str], at: str) -> DataFrame:
    """points with the range (page_start, page_end, packet) that holds them, if any; the keys keep this a hash join."""
    r = ranges.select(*[F.col(k).alias(f"__{k}") for k in keys], "page_start", "page_end", "packet")
    on = [F.col(k) == F.col(f"__{k}") for k in keys] + [F.col(at).between(F.col("page_start"), F.col("page_end"))]
    return points.join(r, on, "left").drop(*[f"__{k}" for k in keys])


def nearest_start(covers: DataFrame, starts: DataFrame, keys: list[str], cover: str, start: str, within: int = 6) -> DataFrame:
    """covers with found_start, the latest start at or before them and not further back than `within`.

    A running last-value over both tables in page order: linear however many starts a key has, where a range join is not.
    """
    both = covers.select(*keys, F.col(cover).alias("__p"), F.lit(1).alias("__c")).unionByName(starts.select(*keys, F.col(start).alias("__p"), F.lit(0).alias("__c")))
    both = plain_unions(both)
    w = Window.partitionBy(*keys).orderBy("__p", "__c")
    last = F.last(F.when(F.col("__c") == 0, F.col("__p")), ignorenulls=True).over(w)
    found = both.withColumn("__s", last).filter("__c = 1")
    return found.select(*keys, F.col("__p").alias(cover), F.when(F.col("__p") - F.col("__s") <= within, F.col("__s")).alias("found_start"))


def consensus_offset(found: DataFrame, keys: list[str], cover: str, share: float = 0.8, evidence: float = 0.5) -> DataFrame:
    """keys, offset: the offset cover - start that at least `share` of located covers agree in (the one seen first at ties),
    if at least `evidence` of all covers were located; else null."""
    each = found.withColumn("offset", F.col(cover) - F.col("found_start"))
    count = each.groupBy(*keys).agg(F.count("*").alias("covers"), F.count("offset").alias("located"))
    votes = each.filter("offset is not null").groupBy(*keys, "offset").agg(F.count("*").alias("n"), F.min(cover).alias("first"))
    top = votes.groupBy(*keys).agg(F.max_by(F.struct("offset", "n"), F.struct("n", (-F.col("first")).alias("f"))).alias("top"))
    both = count.join(top, keys, "left")
    good = (F.col("located") >= evidence * F.col("covers")) & (F.col("top.n") >= share * F.col("located"))
    return both.select(*keys, F.when(good, F.col("top.offset")).alias("offset"))


def snapped(covers: DataFrame, offsets: DataFrame, keys: list[str], cover: str) -> DataFrame:
    """covers moved back by the agreed offset; those that would leave the file stay."""
    both = covers.join(offsets, keys, "left")
    return both.withColumn(cover, F.when(F.col("offset").isNotNull() & (F.col(cover) >= F.col("offset")), F.col(cover) - F.col("offset")).otherwise(F.col(cover))).drop("offset")


def typical_length(bounds: DataFrame, keys: list[str]) -> DataFrame:
    """keys, typical (most frequent packet length, the smaller at ties), median."""
    length = F.col("page_end") - F.col("page_start") + 1
    return bounds.groupBy(*keys).agg(F.mode(length, True).alias("typical"), F.median(length).alias("median"))


def missed_starts(bounds: DataFrame, starts: DataFrame, keys: list[str], start: str, ratio: float = 1.5) -> DataFrame:
    """Start pages inside packets of at least `ratio` times the typical length, half a typical length (two pages at least) from either end; keys with one packet have none."""
    several = bounds.groupBy(*keys).agg(F.count("*").alias("__n")).filter("__n > 1").drop("__n")
    typical = typical_length(bounds, keys).join(several, keys).select(*keys, "typical")
    long = bounds.join(typical, keys).filter(F.expr(f"page_end - page_start + 1 >= {ratio} * typical"))
    inside = containing(starts, long, keys, start).filter("packet is not null").join(typical, keys)
    margin = "greatest(2, typical div 2)"
    return inside.filter(F.expr(f"{start} - page_start >= {margin} and {start} <= page_end - {margin} + 1")).select(*keys, start)


def with_missed(bounds: DataFrame, missed: DataFrame, keys: list[str], start: str) -> DataFrame:
    """keys, start: the packets' starts and the missed ones, each once."""
    return bounds.select(*keys, F.col("page_start").alias(start)).unionByName(missed.select(*keys, start)).transform(plain_unions).distinct()


def covers_without_start(covers: DataFrame, starts: DataFrame, keys: list[str], cover: str, start: str, within: int = 6) -> DataFrame:
    """Covers that no start page lies at or closely before."""
    return nearest_start(covers, starts, keys, cover, start, within).filter("found_start is null").select(*keys, cover)


def covers_above(scores: DataFrame, thresholds: DataFrame, keys: list[str], score: str) -> DataFrame:
    """The pages whose score lies above (not at) their threshold."""
    return scores.join(thresholds, keys).filter(F.col(score) > F.col("threshold")).drop("threshold")


def prune_covers(covers: DataFrame, key: str, cover: str, score: str, expected: str, min_len: int = 5) -> DataFrame:
    """covers without the surplus ones: while a submission has more covers than expected, the cover closest behind another
    (nearer than min_len) goes; at ties the one whose removal leaves the gap closest to the median of the gaps that are long
    enough (min_len if there is none), then the lowest score.

    Each removal depends on the one before, so a submission's covers (tens) are one array, walked as a list of numbers;
    rows without a number as cover stay away from it and are kept.
    """
    @F.pandas_udf("array<int>")
    def left_covers(pages: pd.Series, scores: pd.Series, wanted: pd.Series) -> pd.Series:
        """Numbers of the covers that stay; null for null."""
        from bisect import bisect_left, insort

        def of(page: list, score: list, wanted: float) -> list[int]:
            left = list(range(len(page)))
            gaps = [0, *(b - a for a, b in zip(page, page[1:]))]  # of each cover to the one before
            long_enough = sorted(g for g in gaps[1:] if g >= min_len)
            while len(left) > wanted:
                least = min((g for g in gaps[1:] if g < min_len), default=None)
                if least is None:
                    break
                n = len(long_enough)
                typical = (long_enough[(n - 1) // 2] + long_enough[n // 2]) / 2 if n else min_len
                ahead = [*gaps[1:], 0]
                i = min((abs(least + ahead[i] - typical), score[left[i]], i) for i in range(1, len(gaps)) if gaps[i] == least)[2]
                del left[i]
                gap = gaps.pop(i)
                if i < len(gaps):
                    if gaps[i] >= min_len:
                        del long_enough[bisect_left(long_enough, gaps[i])]
                    gaps[i] += gap
                    if gaps[i] >= min_len:
                        insort(long_enough, gaps[i])
            return left

        return pd.Series([None if p is None else of(p.tolist(), s.tolist(), w) for p, s, w in zip(pages, scores, wanted)], dtype=object)

    others = [c for c in covers.columns if c not in (key, cover, score)]
    rows = covers.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(cover, score, *others))).alias("__rows"))
    wanted = F.get("__rows", F.lit(0))[expected].cast("double")
    surplus = F.size("__rows") > wanted
    kept = left_covers(F.when(surplus, F.col(f"__rows.{cover}")), F.when(surplus, F.col(f"__rows.{score}")), wanted)
    rows = rows.withColumn("__kept", kept)
    left = F.when(F.col("__kept").isNull(), F.col("__rows")).otherwise(F.transform("__kept", lambda i: F.get("__rows", i)))
    return rows.select(key, F.inline(left)).select(*covers.columns)


def segment_documents(pages: DataFrame, keys: list[str], order: str, kind: str, in_top: str, default: str = "contract") -> DataFrame:
    """pages with segment, seg_kind and ordinal. A page that classifies opens a document, unless the open one is of its kind
    and the sign was outside the top third; pages that do not classify continue. Pages before any sign are the default kind."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    first = F.row_number().over(w) == 1
    own = F.when(first, F.coalesce(F.col(kind), F.lit(default))).otherwise(F.col(kind))
    marked = pages.withColumn("__own", own).withColumn("__first", first)
    prior = F.last("__own", ignorenulls=True).over(before)
    begins = F.col("__first") | (F.col("__own").isNotNull() & ((F.col("__own") != prior) | F.col(in_top)))
    marked = marked.withColumn("__b", begins.cast("int"))
    out = marked.withColumn("segment", F.sum("__b").over(w) - 1).withColumn("seg_kind", F.last("__own", ignorenulls=True).over(w))
    per_kind = Window.partitionBy(*keys, "seg_kind").orderBy(order)
    return out.withColumn("ordinal", F.sum("__b").over(per_kind) - 1).drop("__own", "__first", "__b")


#: Phrase in a folded heading, kind; the first that fits counts.
TITLE_PHRASES = (
    ("thanh ly hop dong", "bbnt"),
    ("nghiem thu", "bbnt"),
    ("ban cam ket", "commitment"),
    ("phu luc", "appendix"),
    ("bang thong tin tra cuu", "pit"),
    ("nguoi nop thue tncn", "pit"),
    ("can cuoc cong dan", "id_front"),
    ("bien ban", "bbnt"),
    ("cam ket", "commitment"),
    ("hop dong dich vu", "contract"),
    ("tra cuu", "pit"),
)
#: Words a short heading must all have, kind.
TITLE_WORDS = ((("hop", "dich", "vu"), "contract"),)
#: Marks that may stand anywhere on a page, kind.
PAGE_MARKS = (
    (("ban cam ket", "08/ck-tncn", "mau so: 08"), "commitment"),
    (("bang thong tin tra cuu", "thong tin ve nguoi nop thue", "tra cuu thong tin", "gdt.gov.vn"), "pit"),
    (("danh gia chat luong dich vu", "sow", "kpi"), "appendix"),
)


def classify_page(text: Column, phrases=TITLE_PHRASES, words=TITLE_WORDS, marks=PAGE_MARKS) -> Column:
    """Kind of a page by its headings (the top third first), then by heading words, then by marks anywhere; null if none fits."""
    lines = F.transform(F.split(T.text_of(text), "\r\n|\n|\r"), T.collapse)
    top = F.slice(lines, 1, F.greatest(F.lit(1), F.floor(F.size(lines) / 3).cast("int")))

    def headings(group: Column) -> Column:
        short = lambda x: (x != "") & (F.size(F.split(x, " ")) <= 10)
        pair = F.zip_with(F.slice(group, 1, F.greatest(F.size(group) - 1, F.lit(0))), F.slice(group, 2, F.greatest(F.size(group), F.lit(1))), lambda a, b: F.when(short(a) & short(b), F.concat_ws(" ", a, b)))
        every = F.concat(F.filter(group, short), F.filter(pair, lambda x: x.isNotNull()))
        return F.transform(F.filter(every, lambda x: T.is_heading(x)), T.fold_label)

    tests = []
    for group in (top, lines):
        found = headings(group)
        tests += [(F.contains(F.array_join(found, "\n"), F.lit(p)), k) for p, k in phrases]
    for group in (top, lines):
        found = F.filter(headings(group), lambda x: F.size(F.split(x, " ")) <= 5)
        for need, k in words:
            all_of = F.array(*map(F.lit, need))
            tests.append((F.exists(found, lambda x: F.size(F.array_except(all_of, F.split(x, " "))) == 0), k))
    whole = T.fold_label(text)
    tests += [(F.greatest(*(F.contains(whole, F.lit(m)) for m in group)) if len(group) > 1 else F.contains(whole, F.lit(group[0])), k) for group, k in marks]
    out = F.lit(None).cast("string")
    for test, k in reversed(tests):
        out = F.when(test, k).otherwise(out)
    return out


def ordered_by(words: Column, field: str) -> Column:
    """Structs by one of their numbers, ascending, in their order at ties; the key and the place are compared, not an expression."""
    def of(own: Column) -> Column:
        keyed = F.sort_array(F.transform(own, lambda w, i: F.struct(w[field].alias("k"), i.alias("i"))))
        return F.transform(keyed, lambda k: F.get(own, k["i"]))

    return F.element_at(F.transform(F.array(words), of), 1)


def group_lines(words: Column, tolerance: int = 8) -> Column:
    """Lines of words (structs with x, y), each by x: words in order of y join the line while within tolerance of its first word.

    The baseline is the line's first word, so this is a fold, not a gap between neighbours.
    """
    by_y = ordered_by(words, "y")
    by_x = lambda line: ordered_by(line, "x")
    # the state is where lines start and the last baseline; words are copied once, when lines are cut
    none = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(None).cast("double").alias("base"), F.lit(0).alias("i"))

    def step(s: Column, w: Column) -> Column:
        begins = s["base"].isNull() | (w["y"] - s["base"] > tolerance)
        return F.struct(F.when(begins, F.concat(s["starts"], F.array(s["i"]))).otherwise(s["starts"]).alias("starts"), F.when(begins, w["y"].cast("double")).otherwise(s["base"]).alias("base"), (s["i"] + 1).alias("i"))

    def cut(ordered: Column) -> Column:
        starts = F.aggregate(ordered, none, step, lambda s: s["starts"])
        lines = lambda at: F.transform(at, lambda start, k: by_x(F.slice(ordered, start + 1, F.coalesce(F.get(at, k + 1), F.size(ordered)) - start)))
        return F.element_at(F.transform(F.array(starts), lines), 1)

    return F.element_at(F.transform(F.array(by_y), cut), 1)


def union_box(line: Column) -> Column:
    """The box around words (structs with x, y, w, h)."""
    x, y = F.array_min(F.transform(line, lambda w: w["x"])), F.array_min(F.transform(line, lambda w: w["y"]))
    return F.struct(x.alias("x"), y.alias("y"), (F.array_max(F.transform(line, lambda w: w["x"] + w["w"])) - x).alias("width"), (F.array_max(F.transform(line, lambda w: w["y"] + w["h"])) - y).alias("height"))


def recurrence_scores(bands: DataFrame, key: str, item: str, band: str) -> DataFrame:
    """key, item, score: how much an item looks like its likeliest fellows, the sum of its top normalised correlations
    (a twentieth of its group, three at least, itself left out). Groups are the pages of one submission."""
    import numpy as np
    import pandas as pd

    kinds = dict(bands.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.array(pdf[band].tolist(), np.float64)
        v = v - v.mean(1, keepdims=True)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        k = min(max(3, len(v) // 20), max(len(v) - 1, 0))
        out = np.zeros(len(v))
        for a in range(0, len(v), 256):  # a block of rows at a time
            sim = v[a:a + 256] @ v.T
            sim[np.arange(len(sim)), np.arange(a, a + len(sim))] = -np.inf
            out[a:a + 256] = np.sort(sim, 1)[:, len(v) - k:].sum(1) if k else 0.0
        return pd.DataFrame({key: pdf[key], item: pdf[item], "score": out})

    return bands.select(key, item, band).groupBy(key).applyInPandas(run, f"`{key}` {kinds[key]}, `{item}` {kinds[item]}, score double")


def implausible_structure(covers: Column, pages: Column, expected: Column) -> Column:
    """More than twice as many covers as people, or more than one in four pages."""
    return F.coalesce(covers > 2 * expected, F.lit(False)) | (covers > pages / 4)


def coarse_label(is_cover: Column, aspect: Column, ink: Column) -> Column:
    return F.when(is_cover, "cover").when(aspect > 1.15, "landscape").when(ink >= 0.002, "text").otherwise("blank")


def packet_flags(length: Column, score: Column, threshold: Column, expected: Column, packet: Column) -> Column:
    """Signs of a doubtful packet, in a fixed order."""
    return F.array_compact(F.array(F.when(F.abs(score - threshold) < 0.05, "near-threshold"), F.when(~length.between(5, 12), "length-out-of-range"), F.when(packet >= expected, "no-roster-match")))


def packet_filename(packet: Column, name: Column, start: Column, end: Column) -> Column:
    """0001-an-le_p3-9.pdf: number and pages from one, the name folded, unnamed if there is none."""
    person = T.slug(name)
    return F.concat(F.lpad((packet + 1).cast("string"), 4, "0"), F.lit("-"), F.when(person == "", "unnamed").otherwise(person), F.lit("_p"), (start + 1).cast("string"), F.lit("-"), (end + 1).cast("string"), F.lit(".pdf"))


def missing_numbers(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """keys, missing: the gaps in running numbers from 1 to the largest, as rows (low, high), found between neighbours."""
    steps = rows.select(*keys, F.col(number).cast("long").alias("high")).distinct().withColumn("low", F.coalesce(F.lag("high").over(Window.partitionBy(*keys).orderBy("high")), F.lit(0)))
    return steps.filter("high - low > 1").select(*keys, (F.col("low") + 1).alias("low"), (F.col("high") - 1).alias("high"))
