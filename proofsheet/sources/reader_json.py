"""Words from a page reader's JSON, whose shape differs by version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofsheet.operators import packets


def reader_words(replies: DataFrame, keys: list[str], reply: str) -> DataFrame:
    """keys, at, text, x, y, w, h, conf (0 to 100) of every item with a text and a box in the replies, in their order.

    An item's text is its extracted_value or text, its confidence extracted_prob or confidence; one without any is taken
    for sure. Items without a box, or with one that has no area, are left out; so is a reply that is no JSON or has no
    documents (see `unreadable`). Only the parts that are asked for are taken out of the variant.
    """
    every = lambda v, path: F.try_variant_get(v, path, "array<variant>")
    x = replies.select(*keys, F.try_parse_json(F.col(reply)).alias("v"))
    for path, name in (("$.data.documents", "d"), ("$.ocr_data", "g"), ("$.value", "i")):
        x = x.select(*keys, *(c for c in ("d_at", "g_at") if c in x.columns), F.posexplode(every(F.col("v"), path)).alias(f"{name}_at", "v"))
    field = lambda name, kind: F.try_variant_get(F.col("v"), f"$.{name}", kind)
    # parts are taken out of an item once; behind the explode they are plain columns, however often they are used
    taken = F.struct(field("coordinates", "array<double>").alias("__corners"), field("extracted_value", "string").alias("__value"), field("text", "string").alias("__text"), field("extracted_prob", "double").alias("__prob"), field("confidence", "double").alias("__confidence"))
    x = x.select(*keys, F.struct("d_at", "g_at", "i_at").alias("at"), F.inline(F.array(taken)))
    corners = F.col("__corners")
    box = F.when(F.size(corners) == 4, packets.box_of(*(F.get(corners, F.lit(i)) for i in range(4))))
    text = F.trim(F.coalesce("__value", "__text", F.lit("")))
    sure = F.coalesce("__prob", "__confidence", F.lit(1.0)) * 100
    x = x.select(*keys, "at", text.alias("text"), box.alias("b"), sure.alias("conf")).filter((F.col("text") != "") & F.col("b").isNotNull())
    return x.select(*keys, "at", "text", "b.x", "b.y", F.col("b.width").alias("w"), F.col("b.height").alias("h"), "conf")


def unreadable(replies: DataFrame, keys: list[str], reply: str) -> DataFrame:
    """keys and reason of replies that give no words: not-json, no-documents."""
    v = F.try_parse_json(F.col(reply))
    reason = F.when(v.isNull(), "not-json").when(F.coalesce(F.size(F.try_variant_get(v, "$.data.documents", "array<variant>")), F.lit(0)) <= 0, "no-documents")
    return replies.select(*keys, reason.alias("reason")).filter("reason is not null")
