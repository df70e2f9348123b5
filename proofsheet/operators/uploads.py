"""What was understood of uploaded workbooks, shown before anything is decided on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofsheet.functions import text as T
from proofsheet.functions.session import plain_unions
from proofsheet.operators import roster


def inspection(rows: DataFrame, images: DataFrame) -> DataFrame:
    """A row per case: case_id, sheet (the chosen roster sheet, null if none qualifies), fields (located, ascending), people
    (numbered rows of that sheet) and images: column, kind, n by sheet and column, empty if there are none.

    rows: as of sources.workbook, error rows included; images: as of sources.drawings.described. A case with pictures alone is a row.
    """
    # rows are read once: a sheet is what its rows add up to, a case what its sheets and pictures do, so nothing is joined
    # and sent whole to driver and executors
    hits = F.flatten(F.transform("cells", lambda c: roster.fields_of(T.fold_label(c))))
    told = rows.select(*roster.SHEET, "sheet_idx", "row", "error", roster.is_numbered().alias("numbered"), hits.alias("hits"))
    first = {f: F.min(F.when(F.array_contains("hits", f), F.col("row"))).alias(f"__{f}") for f in roster.HEADERS}
    sheets = told.groupBy(*roster.SHEET).agg(F.max("error").alias("error"), F.min("sheet_idx").alias("sheet_idx"), F.count_if("numbered").alias("people"), roster.first_data(F.col("numbered")).alias("first_data"), *first.values())
    fields = F.array_compact(F.array(*(F.when(F.col(f"__{f}") < F.col("first_data"), F.lit(f)) for f in sorted(roster.HEADERS))))
    sheets = sheets.select(*roster.SHEET, "error", "sheet_idx", "people", F.explode(F.array(fields)).alias("fields"))
    fit = F.col("sheet").isNotNull() & F.col("error").isNull() & F.forall(F.array(*map(F.lit, roster.REQUIRED)), lambda f: F.array_contains("fields", f))
    told = sheets.select("case_id", "error", F.when(fit, F.struct((-F.size("fields")).alias("few"), "sheet_idx", "sheet", "fields", "people")).alias("s"))
    pictures = images.select("case_id", F.struct("sheet", "from_col", "column", "kind", "n").alias("i"))
    every = plain_unions(told).unionByName(pictures, allowMissingColumns=True)
    per_case = every.groupBy("case_id").agg(F.max("error").alias("error"), F.min("s").alias("s"), F.array_sort(F.collect_list("i")).alias("i"))
    found = F.transform("i", lambda i: F.struct(i["sheet"].alias("sheet"), i["column"].alias("column"), i["kind"].alias("kind"), i["n"].alias("n")))
    return per_case.select("case_id", "s.sheet", F.coalesce("s.fields", F.array().cast("array<string>")).alias("fields"), F.coalesce("s.people", F.lit(0)).alias("people"), found.alias("images"), "error")
