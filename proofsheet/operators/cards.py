"""Embedded images: kinds, rows, pairs of card sides, decisions about whose card it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofsheet.functions import text as T
from proofsheet.functions.session import plain_unions

ID_CONFIDENCE, NAME_CONFIDENCE = 0.85, 0.8


def row_tops(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (row, height) with top and bottom, running sums of heights."""
    w = Window.partitionBy(*keys).orderBy("row")
    return rows.withColumn("bottom", F.sum("height").over(w)).withColumn("top", F.col("bottom") - F.col("height"))


def sheet_tops(rows: DataFrame, keys: list[str], default: int) -> DataFrame:
    """rows (row from 0, height) with top and bottom on a sheet whose other rows are `default` high."""
    before = Window.partitionBy(*keys).orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    top = F.col("row") * default + F.coalesce(F.sum(F.col("height") - default).over(before), F.lit(0))
    return rows.withColumn("top", top).withColumn("bottom", F.col("top") + F.col("height"))


def row_at(points: DataFrame, rows: DataFrame, keys: list[str], at: str, default: int) -> DataFrame:
    """points with at_row: the row whose height holds the point, the inverse of sheet_tops; of rows without height the last.

    Points and listed rows meet in one sorted pass: the last listed row above a point and how many default rows fit between.
    """
    marks = sheet_tops(rows, keys, default).select(*keys, F.col("top").cast("long").alias("__at"), F.lit(0).alias("__turn"), F.col("row").cast("long").alias("__row"), F.col("bottom").cast("long").alias("__bottom"))
    both = plain_unions(points).withColumns({"__at": F.col(at).cast("long"), "__turn": F.lit(1)}).unionByName(marks, allowMissingColumns=True)
    above = Window.partitionBy(*keys).orderBy("__at", "__turn", "__row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("__turn") == 0, F.struct("__row", "__bottom")), ignorenulls=True).over(above)
    seen = both.withColumn("__l", last).filter("__turn = 1")
    more = F.col("__at") - F.col("__l.__bottom")
    own = F.when(more < 0, F.col("__l.__row")).when(more >= 0, F.col("__l.__row") + 1 + F.floor(more / default)).otherwise(F.floor(F.col("__at") / default))
    return seen.withColumn("at_row", F.greatest(own, F.lit(0)).cast("long")).select(*points.columns, "at_row")


def drawing_kind(drawings: DataFrame, columns: DataFrame, keys: list[str]) -> DataFrame:
    """drawings with kind: that of the leftmost classified column they cover."""
    c = columns.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("col").alias("__col"), F.col("kind").alias("__kind"))
    on = [F.col(k) == F.col(f"__{k}") for k in keys] + [F.col("__col").between(F.col("from_col"), F.col("to_col"))]
    hit = drawings.join(c, on).groupBy(*keys, "drawing_id").agg(F.min_by("__kind", "__col").alias("kind"))
    return drawings.drop("kind").join(hit, [*keys, "drawing_id"], "left")


def card_candidates(drawings: DataFrame, parts: DataFrame) -> DataFrame:
    """A row per candidate: component, front, back, single and issue. Two drawings side by side are front and back;
    more, or two at one place, are ambiguous singles.

    drawings: drawing_id, x, side; parts: node, component.
    """
    placed = drawings.join(parts, drawings.drawing_id == parts.node, "left").withColumn("component", F.coalesce("component", "drawing_id"))
    one = placed.groupBy("component").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("x", "drawing_id", "side"))).alias("d"), F.countDistinct("x").alias("places"))
    pair = (F.col("n") == 2) & (F.col("places") == 2)
    left, right = F.get("d", F.lit(0)), F.get("d", F.lit(1))
    odd = pair & ((left["side"] == "back") | (right["side"] == "front"))
    paired = one.filter(pair).select("component", left["drawing_id"].alias("front"), right["drawing_id"].alias("back"), F.lit(None).cast(dict(drawings.dtypes)["drawing_id"]).alias("single"), F.when(odd, "layout-conflict").alias("issue"))
    rest = one.filter(~pair).select("component", F.explode("d").alias("x"), F.when(F.col("n") > 1, "ambiguous").alias("issue"))
    side = lambda s: F.when(F.col("x.side") == s, F.col("x.drawing_id"))
    single = rest.select("component", side("front").alias("front"), side("back").alias("back"), F.when(~F.coalesce(F.col("x.side").isin("front", "back"), F.lit(False)), F.col("x.drawing_id")).alias("single"), "issue")
    return plain_unions(paired).unionByName(single)


#: Issues of a pair that forbid a match.
BLOCKING = ("ambiguous", "layout-conflict")


def resolve_cards(cards: DataFrame, roster: DataFrame) -> DataFrame:
    """card_id, state, matched_row, matched_by, issues: whose card each one is, and if nobody's, why.

    cards: card_id, number, number_confidence, located (whether the number's place on the image is known), name,
    name_confidence, and if known front (false: no front side), issues (what was found odd about the pair before; those of
    BLOCKING forbid a match) and blocked (such an issue by itself). The reason is added to the issues, unless it is among them.
    roster: row, cccd, name. A card claims the one row with its number, and the one row with its folded name if that
    row's own number is sound and its alone. The tests follow in order of weight; the first that holds decides.
    """
    rows = roster.select("row", T.digits(F.col("cccd")).alias("id"), T.fold_accents(F.trim(F.col("name"))).alias("who"))
    counted = lambda c, n, r: rows.filter(F.col(c) != "").groupBy(c).agg(F.count("*").alias(n), F.min("row").alias(r))
    ids, names = counted("id", "n_id", "id_row").filter("length(id) = 12"), counted("who", "n_who", "name_row")
    # of each row: whether its own number is sound and its alone, and whether its name is another's too
    own = rows.join(ids.filter("n_id = 1").select("id", F.lit(True).alias("sound")), "id", "left").join(names.select("who", "n_who"), "who", "left")
    own = own.select("row", F.coalesce("sound", F.lit(False)).alias("sound"), (F.coalesce("n_who", F.lit(0)) > 1).alias("namesake"))

    c = cards.withColumns({n: v for n, v in (("front", F.lit(True)), ("blocked", F.lit(None).cast("string")), ("issues", F.array().cast("array<string>"))) if n not in cards.columns})
    c = c.withColumn("issues", F.coalesce("issues", F.array().cast("array<string>")))
    forbids = F.get(F.filter("issues", lambda i: i.isin(*BLOCKING)), F.lit(0))
    c = c.select("card_id", "front", F.coalesce("blocked", forbids).alias("blocked"), F.col("issues").alias("known"), "located", F.coalesce("number_confidence", F.lit(0.0)).alias("sure"), T.digits(F.col("number")).alias("id"), F.when(F.col("name_confidence") >= NAME_CONFIDENCE, T.fold_accents(F.trim(F.col("name")))).alias("who"))
    c = c.join(ids, "id", "left").join(names, "who", "left")
    c = c.withColumn("id_row", F.when(F.col("located") & (F.col("n_id") == 1), F.col("id_row"))).withColumn("name_row", F.when(F.col("n_who") == 1, F.col("name_row")))
    c = c.join(own.select(F.col("row").alias("name_row"), "sound"), "name_row", "left").join(own.select(F.col("row").alias("id_row"), "namesake"), "id_row", "left")
    free = F.col("front") & F.col("blocked").isNull()
    claims = F.array_distinct(F.array_compact(F.array(F.when(free, F.col("id_row")), F.when(free & F.col("sound"), F.col("name_row")))))
    c = c.withColumn("claims", claims)
    contested = c.select("card_id", F.explode("claims").alias("target")).groupBy("target").agg(F.count("*").alias("n")).filter("n > 1").select("target")
    rival = c.select("card_id", F.explode("claims").alias("target")).join(contested, "target", "left_semi").select("card_id").distinct().withColumn("rival", F.lit(True))
    c = c.join(rival, "card_id", "left").join(contested.select(F.col("target").alias("name_row"), F.lit(True).alias("name_rival")), "name_row", "left")

    yes = lambda n: F.coalesce(F.col(n), F.lit(False))
    told = lambda state, issue, by=None: F.struct(F.lit(state).alias("state"), F.lit(issue).cast("string").alias("issue"), F.lit(by).cast("string").alias("by"))
    both = F.col("id_row").isNotNull() & F.col("name_row").isNotNull()
    many = lambda n: F.coalesce(F.col(n) > 1, F.lit(False))
    verdict = (
        F.when(~F.col("front"), told("manual", "no-front"))
        .when(F.col("blocked").isNotNull(), F.struct(F.lit("conflict").alias("state"), F.col("blocked").alias("issue"), F.lit(None).cast("string").alias("by")))
        .when(~yes("located") & many("n_who"), told("conflict", "duplicate-name"))
        .when(~yes("located") & yes("name_rival"), told("conflict", "competing-candidate"))
        .when(~yes("located") & yes("sound"), told("suggested", "no-number-region", "name"))
        .when(~yes("located"), told("manual", "no-number-region"))
        .when((F.col("id") != "") & (F.length("id") != 12), told("manual", "non-12-digit-cccd"))
        .when(many("n_id"), told("conflict", "duplicate-cccd"))
        .when(many("n_who") | yes("namesake"), told("conflict", "duplicate-name"))
        .when(both & (F.col("id_row") != F.col("name_row")), told("conflict", "conflicting-identity"))
        .when(yes("rival"), told("conflict", "competing-candidate"))
        .when(F.col("id_row").isNotNull() & (F.col("sure") >= ID_CONFIDENCE), told("exact", None, "cccd"))
        .when(yes("sound"), told("suggested", None, "name"))
        .when(F.col("id") == "", told("manual", "unreadable-identity"))
        .when(F.col("id_row").isNotNull(), told("manual", "low-cccd-confidence"))
        .otherwise(told("manual", "no-exact-roster-match"))
    )
    c = c.withColumn("v", verdict)
    row = F.when(F.col("v.by") == "cccd", F.col("id_row")).when(F.col("v.by") == "name", F.col("name_row"))
    return c.select("card_id", "v.state", row.alias("matched_row"), F.col("v.by").alias("matched_by"), F.array_distinct(F.concat("known", F.array_compact(F.array("v.issue")))).alias("issues"))


def without_stale(evidence: DataFrame, keep: DataFrame, keys: list[str], owned: str) -> DataFrame:
    """Evidence rows that are not owned, or are owned and still to be kept."""
    return plain_unions(evidence).filter(~F.col(owned)).unionByName(evidence.filter(owned).join(keep, keys, "left_semi").select(evidence.columns))


def replace_pages(local: DataFrame, fresh: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """Sources of re-read pages from the fresh read, all others from the local one."""
    return plain_unions(local).join(pages, keys, "left_anti").unionByName(fresh.join(pages, keys, "left_semi"), allowMissingColumns=True)


def best_reads(sources: DataFrame, keys: list[str], order: str, value: str = "value", confidence: str = "confidence") -> DataFrame:
    """keys, value, confidence: the most confident source that has a value, the first at ties; one without confidence ranks last. Nulls if nothing was read."""
    has = F.trim(T.text_of(F.col(value))) != ""
    rank = F.when(has, F.struct(F.coalesce(F.col(confidence).cast("double"), F.lit(0.0)).alias("c"), (-F.col(order)).alias("o")))
    best = F.max_by(F.struct(F.trim(F.col(value)).alias("v"), F.col(confidence).alias("c")), rank)
    return sources.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.v").alias("value"), F.col("b.c").alias("confidence"))


def weak_fields(sources: DataFrame, keys: list[str], order: str, value: str = "value", confidence: str = "confidence", least: float = 0.7) -> DataFrame:
    """keys, value, confidence of the best read, and weak: unread (no source has a value), low-confidence (the best read is below the line), or null. No confidence is not low."""
    best = best_reads(sources, keys, order, value, confidence)
    return best.withColumn("weak", F.when(F.col("value").isNull(), "unread").when(F.col("confidence") < least, "low-confidence"))


def pages_to_reread(weak: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """doc_id, page: the pages that sources of weak fields (with keys and weak) point to, each once; a source without document points nowhere."""
    fields = weak.filter("weak is not null").select(*keys)
    return sources.filter("doc_id <> ''").join(fields, keys, "left_semi").select("doc_id", "page").distinct()


def card_packets(resolved: DataFrame, roster: DataFrame, packets: DataFrame) -> DataFrame:
    """card_id, packet, reason: the packet an exact card belongs to, by the row's 12-digit id; the reason is the first test that fails.

    resolved: card_id, state, matched_row; roster: row, cccd; packets: packet, cccd.
    """
    ids = roster.select(F.col("row").alias("matched_row"), T.digits(F.col("cccd")).alias("id"))
    alone = packets.select("packet", T.digits(F.col("cccd")).alias("id")).filter("id <> ''").groupBy("id").agg(F.count("*").alias("n"), F.min("packet").alias("packet"))
    both = resolved.join(ids, "matched_row", "left").join(alone, "id", "left")
    reason = F.when(F.col("state") != "exact", "not-exact").when(F.coalesce(F.length("id"), F.lit(0)) != 12, "row-id-unusable").when(F.col("n").isNull(), "no-packet").when(F.col("n") > 1, "several-packets")
    return both.select("card_id", F.when(reason.isNull(), F.col("packet")).alias("packet"), reason.alias("reason"))


def sheet_evidence(drawings: DataFrame, people: DataFrame, roster: DataFrame, packets: DataFrame) -> DataFrame:
    """drawing_id, packet, reason: screenshots by the person on the row of their own sheet that their centre lies in.

    drawings: drawing_id, sheet, center_row; people: sheet, row, cccd, mst, name; roster: row, cccd, mst, name; packets: packet, cccd.
    """
    from proofsheet.operators.matching import key_cascade

    p = people.select("sheet", F.col("row").alias("center_row"), T.digits(F.col("cccd")).alias("k1"), T.digits(F.col("mst")).alias("k2"), T.fold_accents(F.col("name")).alias("k3"))
    placed = drawings.select("drawing_id", "sheet", "center_row").join(p, ["sheet", "center_row"], "left")
    keys = [("cccd", F.col("k1"), T.digits(F.col("cccd"))), ("mst", F.col("k2"), T.digits(F.col("mst"))), ("name", F.col("k3"), T.fold_accents(F.col("name")))]
    named = key_cascade(placed, roster.withColumn("id", T.digits(F.col("cccd"))), keys, "row", ["id"], "drawing_id")
    rows = roster.groupBy(T.digits(F.col("cccd")).alias("id")).agg(F.count("*").alias("rows"))
    alone = packets.groupBy(T.digits(F.col("cccd")).alias("id")).agg(F.count("*").alias("packets"), F.min("packet").alias("packet"))
    both = named.join(rows, "id", "left").join(alone, "id", "left")
    nobody = F.concat_ws("", "k1", "k2", "k3") == ""
    reason = F.when(nobody, "no-person-on-row").when(F.col("method") == "unmatched", "not-on-roster").when(F.coalesce("id", F.lit("")) == "", "row-without-id").when(F.col("rows") > 1, "shared-id").when(F.col("packets").isNull(), "no-packet").when(F.col("packets") > 1, "several-packets")
    return both.select("drawing_id", F.when(reason.isNull(), F.col("packet")).alias("packet"), reason.alias("reason"))


def evidence_summary(attributed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, attached, refused, reasons (distinct, ascending)."""
    return attributed.groupBy(*keys).agg(F.count("packet").alias("attached"), F.count("reason").alias("refused"), F.array_sort(F.collect_set("reason")).alias("reasons"))


def cards_by_packet(packets: DataFrame, cards: DataFrame) -> DataFrame:
    """A row per packet and card: packets without cards and cards of no known packet (floating) included."""
    p, c = packets.select(F.col("packet").alias("p")), cards.select("card_id", F.col("packet").alias("q"))
    return p.join(c, F.col("p") == F.col("q"), "full_outer").select(F.col("p").alias("packet"), "card_id", (F.col("p").isNull() & F.col("card_id").isNotNull()).alias("floating"))


#: Folded phrases of headings over images.
CARD_HEADINGS, IMAGE_HEADINGS, BANK_HEADINGS = ("hinh cccd", "anh cccd", "hinh the"), ("hinh anh", "hinh", "anh"), ("stk", "tai khoan")


def heading_kind(text: Column, left: Column, sheet: Column) -> Column:
    """Kind of image below a folded heading: card, or for a general heading bank or tax by the folded heading on its left or the sheet's name; else null."""
    any_of = lambda c, phrases: F.greatest(*(T.has_phrase(c, p) for p in phrases)) if len(phrases) > 1 else T.has_phrase(c, phrases[0])
    tax = T.has_phrase(T.fold_label(sheet), "mst") | T.has_phrase(left, "mst")
    return F.when(any_of(text, CARD_HEADINGS), "card").when(any_of(text, IMAGE_HEADINGS), F.when(any_of(left, BANK_HEADINGS), "bank").when(tax, "tax"))


def image_kinds(headers: DataFrame, keys: list[str], sheet: str) -> DataFrame:
    """keys, col, kind of image columns (headers: keys, sheet, col, text): card, or for a general heading bank or tax by the heading
    right beside it on the left (or the sheet's name); columns that nothing says are left out. Phrases count as whole words."""
    flat = headers.withColumn("__t", T.fold_label(F.col("text")))
    w = Window.partitionBy(*keys).orderBy("col")
    left = F.when(F.lag("col").over(w) == F.col("col") - 1, F.lag("__t").over(w))
    flat = flat.withColumn("__left", F.coalesce(left, F.lit("")))
    return flat.select(*keys, "col", heading_kind(F.col("__t"), F.col("__left"), F.col(sheet)).alias("kind")).filter("kind is not null")


def image_columns(drawings: DataFrame, keys: list[str]) -> DataFrame:
    """keys, from_col, n, kind: how many drawings begin in each column, and the kind of the last one."""
    return drawings.groupBy(*keys, "from_col").agg(F.count("*").alias("n"), F.max_by("kind", "drawing_id").alias("kind"))


def mappable(people: DataFrame, keys: list[str]) -> DataFrame:
    """keys, expected: how many cards a roster leads one to expect, its different numbers of twelve digits. people: keys, cccd."""
    number = T.digits(F.col("cccd"))
    return people.groupBy(*keys).agg(F.count_distinct(F.when(F.length(number) == 12, number)).alias("expected"))
