"""Rosters: header location, people and totals, self-checks, control totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofsheet.functions import text as T
from proofsheet.functions import values as V
from proofsheet.functions.session import plain_unions
from proofsheet.operators.matching import shared_keys

#: Patterns that folded headers must hold, by field.
HEADERS = {
    "stt": "^stt$",
    "name": "ho va ten|ho ten",
    "cccd": "cccd|cmnd|can cuoc",
    "mst": "^mst|ma so thue",
    "dob": "ngay.*sinh",
    "gender": "gioi tinh",
    "account": "so tk|so tai khoan",
    "bank": "ngan hang",
    "period": "thoi gian lam viec",
    "fee": "phi dich vu",
    "gross": "^gross",
    "commitment": "ban cam ket",
    "pit": "thue pit|^pit",
    "net": "thuc nhan",
    "note": "^note$|ghi chu",
}
REQUIRED = ("name", "cccd")
AMOUNTS = ("gross", "net", "pit")
NEEDED = ("cccd", "gross", "pit", "net")
SHEET = ["case_id", "sheet"]


def is_numbered() -> Column:
    """Whether a row's first cell is a number."""
    return F.trim(T.text_of(F.get("cells", F.lit(0)))).rlike("^[0-9]+$")


def first_data(numbered: Column | None = None) -> Column:
    """Aggregate: the first numbered row of a sheet; beyond the last row if there is none."""
    return F.coalesce(F.min(F.when(is_numbered() if numbered is None else numbered, F.col("row"))), F.max("row") + 1)


def fields_of(cell: Column) -> Column:
    """The fields that a folded header names."""
    return F.filter(F.array(*(F.when(cell.rlike(p), F.lit(f)) for f, p in HEADERS.items())), lambda x: x.isNotNull())


def first_data_rows(rows: DataFrame) -> DataFrame:
    """case_id, sheet, first_data: the first row whose first cell is a number; beyond the last row if there is none."""
    return rows.groupBy(*SHEET).agg(first_data().alias("first_data"))


def locate_columns(rows: DataFrame) -> DataFrame:
    """case_id, sheet, field, col: for each field its first header cell, by row then column, above the first data row."""
    head = rows.join(first_data_rows(rows), SHEET).filter("row < first_data")
    cells = head.select(*SHEET, "row", F.posexplode("cells").alias("col", "cell")).withColumn("cell", T.fold_label(F.col("cell")))
    hits = cells.filter("cell <> ''").select(*SHEET, "row", "col", F.explode(fields_of(F.col("cell"))).alias("field"))
    return hits.groupBy(*SHEET, "field").agg(F.min(F.struct("row", "col")).alias("at")).select(*SHEET, "field", "at.col")


def select_sheet(rows: DataFrame) -> DataFrame:
    """case_id, sheet, fields: the sheet that most fields map in, the earlier at ties; it must have name and id."""
    found = locate_columns(rows).groupBy(*SHEET).agg(F.collect_set("field").alias("fields"))
    order = rows.groupBy(*SHEET).agg(F.min("sheet_idx").alias("sheet_idx"))
    scored = found.join(order, SHEET).filter(F.array_contains("fields", "name") & F.array_contains("fields", "cccd"))
    best = Window.partitionBy("case_id").orderBy(F.size("fields").desc(), "sheet_idx")
    return scored.withColumn("__r", F.row_number().over(best)).filter("__r = 1").select(*SHEET, F.array_sort("fields").alias("fields"))


def missing_required(fields: Column) -> Column:
    """Required fields that an array of located fields lacks; any one amount stands for amount."""
    lacking = F.array_except(F.array(*map(F.lit, REQUIRED)), fields)
    amount = F.when(~F.arrays_overlap(fields, F.array(*map(F.lit, AMOUNTS))), F.array(F.lit("amount"))).otherwise(F.array().cast("array<string>"))
    return F.concat(lacking, amount)


def read_people(rows: DataFrame) -> DataFrame:
    """A row per numbered or total row: case_id, sheet, row, is_total, the fields as text (null where not located), and located, their names."""
    where = locate_columns(rows).groupBy(*SHEET).agg(F.map_from_entries(F.collect_list(F.struct("field", "col"))).alias("cols"))
    body = rows.join(first_data_rows(rows), SHEET).filter("row >= first_data").join(where, SHEET)
    head = F.trim(T.text_of(F.get("cells", F.lit(0))))
    number, total = head.rlike("^[0-9]+$"), T.fold_label(head).rlike("tong|total")
    return body.filter(number | total).select(*SHEET, "row", (~number).alias("is_total"), *(F.get(F.col("cells"), F.col("cols")[f]).alias(f) for f in HEADERS), F.map_keys("cols").alias("located"))


def rows_until_blank(rows: DataFrame) -> DataFrame:
    """Rows from the first that is not blank to before the next blank one, per sheet."""
    blank = ~F.exists("cells", lambda c: F.trim(T.text_of(c)) != "")
    order = Window.partitionBy(*SHEET).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("__blank", blank).withColumn("__begun", F.max((~F.col("__blank")).cast("int")).over(order))
    return marked.withColumn("__ended", F.max((F.col("__blank") & (F.col("__begun") == 1)).cast("int")).over(order)).filter("__begun = 1 and __ended = 0").drop("__blank", "__begun", "__ended")


def amount_check(gross: Column, pit: Column, net: Column) -> Column:
    """missing, mismatch or ok: whether gross - pit is net."""
    return F.when(gross.isNull() | pit.isNull() | net.isNull(), "missing").when(gross - pit != net, "mismatch").otherwise("ok")


def control_totals(rows: DataFrame, keys: list[str], amount: Column, stated: DataFrame, stated_col: str) -> DataFrame:
    """keys, summed, stated, gap, status: the sum of amounts (unreadable ones count 0) against what is stated; pending without rows or statement."""
    sums = rows.groupBy(*keys).agg(F.sum(F.coalesce(amount, F.lit(0))).alias("summed"))
    both = stated.select(*keys, F.col(stated_col).alias("stated")).join(sums, keys, "left")
    status = F.when(F.col("summed").isNull() | F.col("stated").isNull(), "pending").when(F.col("summed") == F.col("stated"), "ok").otherwise("no")
    return both.select(*keys, "summed", "stated", (F.col("summed") - F.col("stated")).alias("gap"), status.alias("status"))


def findings(people: DataFrame) -> DataFrame:
    """case_id, code, rows: all self-checks of rosters read by read_people. Cases are checked side by side.

    A check whose column was not located is left out, as is every other check if an id or amount column is missing
    (code missing-columns). Without a column `located` all count as located.
    """
    if "located" not in people.columns:
        people = people.withColumn("located", F.array(*map(F.lit, HEADERS)))
    lacking = F.array_except(F.array(*map(F.lit, NEEDED)), F.col("located"))
    # people are read once: each is a row for its case and, for each of its keys, a row for those who share it
    people = people.withColumn("__lacking", lacking).withColumn("__whole", F.size("__lacking") == 0)
    person = F.col("__whole") & ~F.col("is_total")
    keyed = [F.when(person, F.struct(F.lit(key).alias("kind"), T.digits(F.col(key)).alias("digits"))) for key in ("cccd", "mst", "account")]
    case = F.struct(F.lit("").alias("kind"), F.lit("").alias("digits"))
    x = people.withColumn("__k", F.explode(F.filter(F.array(case, *keyed), lambda k: (k["kind"] == "") | (k["digits"] != ""))))
    base = F.col("__k.kind") == ""
    person, total, has = person & base, F.col("__whole") & F.col("is_total") & base, lambda f: F.array_contains("located", f)
    place = F.struct("row", F.coalesce(F.nullif(T.text_of(F.col("stt")), F.lit("")), F.lit("?")).alias("label"))
    gross, pit, net = (V.money(F.col(c)) for c in ("gross", "pit", "net"))
    state = amount_check(gross, pit, net)
    tests = {
        "amount-missing": state == "missing", "formula-mismatch": state == "mismatch", "cccd-format": F.length(T.digits(F.col("cccd"))) != 12,
        "dob-format": has("dob") & ~V.is_roster_date(F.col("dob")), "account-missing": has("account") & (T.digits(F.col("account")) == ""),
    }
    x = x.groupBy("case_id", "__k").agg(
        *(F.sort_array(F.collect_list(F.when(person & t, place))).alias(code) for code, t in tests.items()),
        F.first(F.when(base & ~F.col("__whole"), F.col("__lacking")), ignorenulls=True).alias("blind"), F.count(F.when(person, 1)).alias("persons"), F.count(F.when(total, 1)).alias("totals"),
        *(F.min_by(F.when(total, F.col(c)), F.when(total, F.col("row"))).alias(f"stated_{c}") for c in AMOUNTS), *(F.sum(F.when(person, F.coalesce(V.money(F.col(c)), F.lit(0)))).alias(f"summed_{c}") for c in AMOUNTS),
        F.sort_array(F.collect_list(F.when(~base, place))).alias("sharing"),
    )
    none = F.array().cast("array<string>")
    found = lambda code, rows, holds: F.when(holds, F.struct(F.lit(code).alias("code"), rows.alias("rows")))
    out = [found(code, F.col(f"`{code}`.label"), F.size(F.col(f"`{code}`")) > 0) for code in tests]
    out += [found("missing-columns", F.col("blind"), F.col("blind").isNotNull()), found("no-total-row", none, (F.col("persons") > 0) & (F.col("totals") == 0))]
    for c in AMOUNTS:
        stated, summed = V.money(F.col(f"stated_{c}")), F.col(f"summed_{c}")
        out.append(found(f"total-missing-{c}", none, (F.col("totals") > 0) & stated.isNull()))
        out.append(found(f"total-mismatch-{c}", F.array((summed - stated).cast("string")), (F.col("totals") > 0) & (summed != stated)))
    own = F.when(F.col("__k.kind") == "", F.array_compact(F.array(*out)))
    shared = F.when(F.size("sharing") > 1, F.array(F.struct(F.concat(F.lit("duplicate-"), F.col("__k.kind")).alias("code"), F.array(F.array_join("sharing.label", "+")).alias("rows"))))
    each = x.select("case_id", F.inline(F.coalesce(own, shared)))
    # groups that share a number come one by one; every other code is there once a case
    return each.groupBy("case_id", "code").agg(F.sort_array(F.flatten(F.collect_list("rows"))).alias("many"), F.first("rows").alias("one")).select("case_id", "code", F.when(F.startswith("code", F.lit("duplicate-")), F.col("many")).otherwise(F.col("one")).alias("rows"))


#: What a heading of the name column holds.
NAME_HEADINGS = ("họ và tên", "họ tên", "tên", "name")


def names_below_heading(rows: DataFrame, headings: tuple[str, ...] = NAME_HEADINGS) -> DataFrame:
    """case_id, sheet, place, name: what stands in the column of the first cell that holds a heading, below it, up to the first blank row once rows have begun."""
    cells = rows.select(*SHEET, "row", F.posexplode("cells").alias("col", "cell")).withColumn("cell", F.lower(F.trim(T.text_of(F.col("cell")))))
    holds = F.lit(False)
    for h in headings:
        holds = holds | F.contains("cell", F.lit(h))
    head = cells.filter(holds).groupBy(*SHEET).agg(F.min(F.struct("row", "col")).alias("h")).select(*SHEET, F.col("h.row").alias("head"), "h.col")
    body = rows_until_blank(rows.join(head, SHEET).filter("row > head"))
    named = body.select(*SHEET, "row", F.trim(T.text_of(F.get("cells", F.col("col")))).alias("name")).filter("name <> ''")
    return named.select(*SHEET, (F.row_number().over(Window.partitionBy(*SHEET).orderBy("row")) - 1).alias("place"), "name")


def heading_columns(rows: DataFrame) -> DataFrame:
    """case_id, sheet, head, field, col: the columns of sheets without numbers in front. The heading is the first row with a name
    and an id; fields that it lacks may stand in rows below it, before the first that has something in the name column."""
    fields = F.filter(F.array(*(F.when(F.col("cell").rlike(p), F.lit(f)) for f, p in HEADERS.items())), lambda x: x.isNotNull())
    cells = rows.select(*SHEET, "row", F.posexplode("cells").alias("col", "cell")).withColumn("cell", T.fold_label(F.col("cell")))
    hits = cells.filter("cell <> ''").select(*SHEET, "row", "col", F.explode(fields).alias("field"))
    own = hits.groupBy(*SHEET, "row").agg(F.min(F.when(F.col("field") == "name", F.col("col"))).alias("name_col"), F.bool_or(F.col("field") == "cccd").alias("has_id"))
    head = own.filter("name_col is not null and has_id").groupBy(*SHEET).agg(F.min(F.struct("row", "name_col")).alias("h")).select(*SHEET, F.col("h.row").alias("head"), "h.name_col")
    named = rows.join(head, SHEET).filter((F.col("row") > F.col("head")) & (F.trim(T.text_of(F.get("cells", F.col("name_col")))) != ""))
    until = named.groupBy(*SHEET).agg(F.min("row").alias("until"))
    near = hits.join(head.select(*SHEET, "head"), SHEET).join(until, SHEET, "left").filter("row >= head and row < coalesce(until, row + 1)")
    return near.groupBy(*SHEET, "head", "field").agg(F.min(F.struct("row", "col")).alias("at")).select(*SHEET, "head", "field", "at.col")


def read_rows(rows: DataFrame) -> DataFrame:
    """case_id, sheet, row, name, cccd, mst, dob, account, fee, product: rows with a name below such a heading, up to the first blank row
    once rows have begun; trimmed text, empty where there is no column. The fee may be headed as gross; the product comes from the note."""
    where = heading_columns(rows).groupBy(*SHEET, "head").agg(F.map_from_entries(F.collect_list(F.struct("field", "col"))).alias("cols"))
    body = rows_until_blank(rows.join(where, SHEET).filter("row > head"))
    cell = lambda f: F.trim(T.text_of(F.get("cells", F.col("cols")[f])))
    fee = F.when(F.map_contains_key("cols", "fee"), cell("fee")).otherwise(cell("gross"))
    out = body.select(*SHEET, "row", *(cell(f).alias(f) for f in ("name", "cccd", "mst", "dob", "account")), fee.alias("fee"), F.trim(F.substring_index(cell("note"), " - ", 1)).alias("product"))
    return out.filter("name <> ''")
