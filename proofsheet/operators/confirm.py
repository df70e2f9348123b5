"""Is the name that the roster states printed on a document? Asked only where no name could be read there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofsheet.functions import text as T
from proofsheet.operators import evaluate, quotes

NAME_STT = 1


def confirmed_names(packets: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """keys, document, doc_id, page, place, ratio: of each document column the first line that holds the stated name, by its
    documents' order (doc_ord), then by place.

    packets: keys, expected (blank or null: nobody is looked for); candidates: keys, doc_ord, doc_id, kind, page, place,
    text, the lines near a label of identity (extract.name_candidates). A line holds the name if a stretch of its words,
    two more or fewer than the name's, is at least 0.9 like it. Lines with the name's very words reach Python as nulls.
    """
    column = F.create_map(*(F.lit(x) for name, kinds in evaluate.DOCUMENT_KINDS.items() for k in kinds for x in (k, name)))
    asked = packets.select(*keys, T.fold_words(F.col("expected")).alias("__name")).filter("__name <> ''")
    # behind the explode a folded line is a plain column: filters and branches do not fold it again
    lines = candidates.select(*keys, "doc_ord", "doc_id", column[F.col("kind")].alias("document"), "page", "place", F.explode(F.array(T.fold_words(F.col("text")))).alias("__text"))
    both = lines.filter("__text <> '' and document is not null").join(asked, keys)
    told = F.contains(F.concat(F.lit(" "), "__text", F.lit(" ")), F.concat(F.lit(" "), "__name", F.lit(" ")))
    open_ = lambda c: F.when(~told, c)
    alike = quotes.best_window(open_(F.split("__text", " ")), open_(F.col("__name")))["ratio"]
    hits = both.withColumn("__alike", alike).withColumn("ratio", F.when(told, 1.0).otherwise(F.col("__alike"))).filter("ratio is not null")
    first = F.min(F.struct("doc_ord", "place", "doc_id", "page", "ratio"))
    return hits.groupBy(*keys, "document").agg(first.alias("h")).select(*keys, "document", "h.doc_id", "h.page", "h.place", "h.ratio")


def with_confirmed(cells: DataFrame, confirmed: DataFrame) -> DataFrame:
    """cells (of evaluate.evaluate) with confirmed: cells of the name that are pending are settled (ok) where the stated name was found.

    A name that was read, rightly or not, stays as it is, and so do the roster's own cell and that of the whole submission.
    """
    keys = evaluate.KEYS
    found = confirmed.select(*keys, "document", F.lit(NAME_STT).alias("stt"), F.lit(True).alias("__found")).distinct()
    both = cells.join(found, [*keys, "stt", "document"], "left")
    settled = F.coalesce("__found", F.lit(False)) & (F.col("status") == "pending") & ~F.col("document").isin(evaluate.EXCEL, evaluate.LISTING)
    out = both.withColumn("confirmed", settled).withColumns({"status": F.when(F.col("confirmed"), "ok").otherwise(F.col("status")), "pending_reason": F.when(~F.col("confirmed"), F.col("pending_reason"))})
    return out.select(*cells.columns, "confirmed")
