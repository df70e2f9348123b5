"""Packets as reviewers see them: rows, counters, orders, grids, claims to look at, report items, prototype checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofsheet.functions import text as T
from proofsheet.functions import values as V
from proofsheet.functions.session import plain_unions
from proofsheet.operators import status as S

NO_NAME = "(no name)"


def filled(*names: Column) -> Column:
    """The first that is not empty; null if all are."""
    return F.coalesce(*(F.nullif(n, F.lit("")) for n in names))


def product_of(note: Column) -> Column:
    """What stands before ' - ' in a note."""
    return F.trim(F.substring_index(F.trim(T.text_of(note)), " - ", 1))


def display_name(roster: Column, packet: Column, read: Column) -> Column:
    return F.coalesce(filled(roster, packet, read), F.lit(NO_NAME))


def documents_label(span: Column, missing: Column) -> Column:
    """complete or missing, with how many of how many documents are there; empty without any."""
    have = F.concat((span - missing).cast("string"), F.lit("/"), span.cast("string"))
    return F.when(F.coalesce(span, F.lit(0)) == 0, "").when(missing == 0, F.concat(F.lit("complete "), have)).otherwise(F.concat(F.lit("missing "), have))


def packet_rows(packets: DataFrame) -> DataFrame:
    """packet, number (two digits from 01), name, complete, label of packets (packet, roster_name, name, read_name, span, missing)."""
    return packets.select(
        "packet", F.lpad((F.col("packet") + 1).cast("string"), 2, "0").alias("number"), display_name(F.col("roster_name"), F.col("name"), F.col("read_name")).alias("shown"),
        (F.col("missing") == 0).alias("complete"), documents_label(F.col("span"), F.col("missing")).alias("label"),
    ).withColumn("number", F.when(F.col("packet") >= 99, (F.col("packet") + 1).cast("string")).otherwise(F.col("number")))


def in_lifecycle(packets: DataFrame, wanted: str, column: str = "lifecycle") -> DataFrame:
    """Packets of one lifecycle state; all of them for 'all'."""
    return packets if wanted == "all" else packets.filter(F.col(column) == wanted)


def spanned_documents(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, document: the columns of the matrix, those documents alone that a criterion shown in it spans."""
    return cells.filter("render = 'matrix'").select(*keys, "document").distinct()


def needs_attention(sheet: Column, people: Column, classified: Column, unclassified: Column) -> Column:
    """Whether an upload should be looked at: no roster sheet, nobody on it, or some images of known kind and others not."""
    return sheet.isNull() | (people == 0) | ((classified > 0) & (unclassified > 0))


def split_summary(packets: DataFrame, keys: list[str]) -> DataFrame:
    """keys, found, matched, merged, duplicates of packets (matched_by, flags)."""
    has = lambda f: F.array_contains("flags", f)
    return packets.groupBy(*keys).agg(F.count("*").alias("found"), F.count_if(~F.col("matched_by").isin("unmatched", "no-roster")).alias("matched"), F.count_if(has("auto-merged")).alias("merged"), F.count_if(has("duplicate-roster-identity")).alias("duplicates"))


def counters(packets: DataFrame, keys: list[str], status: str = "ai_status") -> DataFrame:
    """keys, total, one count for each status, unrated, and shown: the statuses that occur, the worst first."""
    own = F.col(status)
    out = packets.groupBy(*keys).agg(F.count("*").alias("total"), *(F.count_if(own == s).alias(f"n_{s}") for s in S.STATUSES), F.count_if(own.isNull()).alias("unrated"))
    return out.withColumn("shown", F.array_compact(F.array(*(F.when(F.col(f"n_{s}") > 0, F.lit(s)) for s in S.STATUSES))))


def automated_count(automatic: Column) -> Column:
    """Aggregate: how many criteria are automatic; null if one does not say."""
    return F.when(F.bool_or(automatic.isNull()), F.lit(None)).otherwise(F.count_if(automatic))


GRID = ("mismatch", "review", "match", "na")


def source_grid(sources: DataFrame, documents: DataFrame, fields: DataFrame, keys: list[str]) -> DataFrame:
    """keys, field, document, status: the worst of a field's sources in a document, na if it has none; field null: the document's worst.

    sources: keys, field, document, verdict (null: unread); documents: keys, document; fields: keys, field.
    """
    rank = F.when(F.col("verdict") == "mismatch", 0).when(F.col("verdict") == "match", 2).otherwise(1)
    own = sources.groupBy(*keys, "field", "document").agg(F.min(rank).alias("rank"))
    cells = fields.select(*keys, "field").distinct().join(documents.select(*keys, "document").distinct(), keys).join(own, [*keys, "field", "document"], "left").withColumn("rank", F.coalesce("rank", F.lit(3)))
    whole = cells.groupBy(*keys, "document").agg(F.min("rank").alias("rank")).withColumn("field", F.lit(None).cast(dict(cells.dtypes)["field"]))
    name = F.get(F.array(*map(F.lit, GRID)), F.col("rank"))
    return plain_unions(cells).unionByName(whole.select(cells.columns)).select(*keys, "field", "document", name.alias("status"))


def worst_first(status: Column, number: Column) -> list[Column]:
    """Sort order of criteria: the worst status first, na last, then by number."""
    return [F.coalesce(S.rank_of(status), F.lit(len(S.RANKED))), number]


def attention_first(reasons: Column, order: Column) -> list[Column]:
    """Sort order of packets: those with a reason to look first, each part as it was."""
    return [F.size(reasons) == 0, order]


def claims(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, document, status, read, page, reference: every value that was read off a page at a place, beside the criterion's first roster value.

    cells: keys, doc_ord, document, status, evidence (array of struct(value, page, box, provenance)).
    """
    listed = cells.select(*keys, "doc_ord", "document", "status", F.posexplode("evidence").alias("at", "e"))
    told = listed.filter((F.col("e.provenance") == "roster") & (F.coalesce(F.col("e.value"), F.lit("")) != "")).groupBy(*keys).agg(F.min_by("e.value", F.struct("doc_ord", "at")).alias("reference"))
    seen = listed.filter((F.coalesce(F.col("e.provenance"), F.lit("")) != "roster") & F.col("e.box").isNotNull())
    return seen.join(told, keys, "left").select(*keys, "document", "status", F.coalesce("e.value", F.lit("")).alias("read"), "e.page", F.coalesce("reference", F.lit("")).alias("reference"))


UNSEEN = "to be looked at"


def report_items(flags: DataFrame, fields: DataFrame, sources: DataFrame, documents: DataFrame, keys: list[str]) -> DataFrame:
    """keys, field, label, document, page (from 1), expected, read, reason of every flagged field, by its first source.

    flags: keys, field, reason; fields: keys, field, label, expected; sources: keys, field, idx, doc_id, page, value;
    documents: keys, doc_id, label.
    """
    first = sources.groupBy(*keys, "field").agg(F.min_by(F.struct("doc_id", "page", "value"), F.col("idx")).alias("s")).select(*keys, "field", "s.*")
    named = documents.select(*keys, "doc_id", F.col("label").alias("document"))
    out = flags.join(fields, [*keys, "field"], "left").join(first, [*keys, "field"], "left").join(named, [*keys, "doc_id"], "left")
    return out.select(*keys, "field", F.coalesce("label", F.col("field").cast("string")).alias("label"), F.coalesce("document", F.lit("—")).alias("document"), (F.col("page") + 1).alias("page"), F.coalesce("expected", F.lit("")).alias("expected"), F.coalesce(filled(F.col("value")), F.lit(UNSEEN)).alias("read"), "reason")


def disagreements(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells at no, and those a reviewer cleared (computed no); cleared says whether all of keys' cells were cleared."""
    kept = cells.filter("status = 'no' or computed_status = 'no'")
    whole = kept.groupBy(*keys).agg((~F.bool_or(F.col("status") == "no")).alias("cleared"))
    return kept.join(whole, keys)


def roster_row_by_id(packets: DataFrame, people: DataFrame, packet: str, row: str) -> DataFrame:
    """packet, row: the first roster row with the packet's id; no other key counts in a report."""
    own = people.select(T.digits(F.col("cccd")).alias("id"), row).filter("id <> ''").groupBy("id").agg(F.min(row).alias(row))
    return packets.select(packet, T.digits(F.col("cccd")).alias("id")).join(own, "id", "left").select(packet, row)


def page_url(base: Column, path: Column) -> Column:
    """Where a service shows a page: the file's own name below base/page/."""
    return F.concat(base, F.lit("/page/"), F.substring_index(path, "/", -1))


def percent_done(done: Column, total: Column, finished: Column) -> Column:
    """0 to 100, rounded half up; without a total 100 if finished, else 0."""
    return F.when(F.coalesce(total, F.lit(0)) == 0, F.when(finished, 100).otherwise(0)).otherwise(F.floor(F.least(F.lit(1.0), done / total) * 100 + 0.5)).cast("int")


def positional_names(packets: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """packets (keys, packet) with the name of equal place (keys, place, name) and unnamed, true beyond a roster that there is."""
    n = names.groupBy(*keys).agg(F.lit(True).alias("listed"))
    own = names.select(*keys, F.col("place").alias("packet"), "name")
    both = packets.join(own, [*keys, "packet"], "left").join(n, keys, "left")
    return both.withColumn("unnamed", F.coalesce("listed", F.lit(False)) & F.col("name").isNull()).drop("listed")


def flag_union(a: Column, b: Column) -> Column:
    """Flags of both, in order, each once."""
    return F.array_distinct(F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))))


def attach_decision(reads: DataFrame, roster: DataFrame, read: str) -> DataFrame:
    """read, row, action, reason: a card is attached only if its number is one row's alone and the folded name agrees; else a reviewer decides.

    reads: read, recognised, number, name; roster: row, cccd, name.
    """
    own = roster.select(T.digits(F.col("cccd")).alias("number"), "row", F.col("name").alias("roster_name")).filter("number <> ''")
    own = own.groupBy("number").agg(F.count("*").alias("n"), F.min_by(F.struct("row", "roster_name"), F.col("row")).alias("r"))
    both = reads.join(own, "number", "left")
    known, name = F.coalesce(F.col("n"), F.lit(0)), T.text_of(F.col("name"))
    reason = (
        F.when(~F.col("recognised"), "not-recognised-as-id").when(T.text_of(F.col("number")) == "", "no-identity-number").when(known == 0, "no-roster-match").when(known > 1, "duplicate-roster-cccd")
        .when(name == "", "no-name-to-corroborate").when(T.fold_accents(name) != T.fold_accents(F.col("r.roster_name")), "name-disagrees").otherwise("number-and-name-agree")
    )
    row = F.when(reason.isin("no-name-to-corroborate", "name-disagrees", "number-and-name-agree"), F.col("r.row"))
    return both.select(read, row.alias("row"), F.when(reason == "number-and-name-agree", "attach").otherwise("review").alias("action"), reason.alias("reason"))


def box_of(a: Column, b: Column, c: Column, d: Column) -> Column:
    """A box from four numbers: two corners if the last two exceed the first two, else origin and size; null without an area."""
    corners = (c > a) & (d > b)
    w, h = F.when(corners, c - a).otherwise(c), F.when(corners, d - b).otherwise(d)
    whole = lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("int")
    return F.when((w > 0) & (h > 0), F.struct(whole(a).alias("x"), whole(b).alias("y"), whole(w).alias("width"), whole(h).alias("height")))


def has_place(width: Column, height: Column) -> Column:
    """Whether a box shows a place: the empty one that stands for 'nowhere' does not."""
    return F.coalesce((width != 0) & (height != 0), F.lit(False))


def pairable(kind: Column) -> Column:
    """Drawings that may be a card's side: cards, and those of unknown kind."""
    return kind.isNull() | (kind == "card")


def reads_as_front(number: Column, located: Column) -> Column:
    return F.coalesce(located, F.lit(False)) & (F.length(T.digits(number)) == 12)


#: Order of a prototype field's verdicts.
FIELD_SEVERITY = ("mismatch", "fuzzy", "review", "low_conf", "match")


def field_rank(verdict: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, FIELD_SEVERITY)), verdict) - 1


def expiry_verdict(value: Column, on: str = "2026-07-13") -> Column:
    """mismatch if a printed day (d/m/yyyy) lies before the review date or is none."""
    day = F.try_to_timestamp(F.regexp_extract(T.text_of(value), "([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})", 1), F.lit("d/M/yyyy")).cast("date")
    return F.when(day.isNull() | (day < F.to_date(F.lit(on))), V.MISMATCH).otherwise(V.MATCH)


def leading_number(c: Column) -> Column:
    d = T.digits(c)
    return F.when(d == "", 0).otherwise(d.cast("long")).cast("long")


def math_verdict(key: Column, claimed: Column, gross: Column, pit: Column, exempt: Column) -> Column:
    """match if the tax is a tenth of gross (half up; 0 if exempt) or, for net, gross less tax."""
    tax = F.when(exempt, 0).otherwise(F.floor(leading_number(gross) * 0.1 + 0.5).cast("long"))
    due = F.when(key == "pit", tax).otherwise(leading_number(gross) - leading_number(pit))
    return F.when(leading_number(claimed) == due, V.MATCH).otherwise(V.MISMATCH)


def policy_verdict(exempt: Column, pledged: Column) -> Column:
    """An exemption needs a pledge."""
    return F.when(exempt & ~pledged, V.MISMATCH).otherwise(V.MATCH)


def page_pair(page: Column) -> Column:
    """Which spread of two pages a page lies on."""
    return F.floor(page / 2).cast("int")


def cell_action(document: Column, status: Column, batch: str, kinds: dict[str, tuple[str, ...]]) -> Column:
    """What a cell opens: nothing if it does not apply, the summary for the document that concerns the batch, else a document of its kind."""
    known = F.create_map(*(F.lit(x) for d, k in kinds.items() for x in (d, k[0])))
    return F.when(status == "na", "none").when(document == batch, "summary").otherwise(F.coalesce(F.concat(F.lit("open "), known[document]), F.lit("none")))


def is_decided(status: Column, computed: Column) -> Column:
    """Whether a reviewer moved a cell away from what was computed."""
    return F.coalesce((computed != "") & (computed != status), F.lit(False))
