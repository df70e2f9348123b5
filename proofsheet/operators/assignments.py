"""Cards given to packets by hand: an ordered log of assignments, each accepted or refused by the state before it."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofsheet.functions.session import plain_unions

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Why an assignment is refused.
NO_CARD, NO_PACKET, NO_IMAGE, TAKEN = "unknown-card", "unknown-packet", "card-has-no-image", "packet-already-has-card"


def _decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of case, turn (0 packets, 1 cards, 2 events) and place; the state is one case's cards and packets, however long its log."""
    case, packets, held, holder, bare = None, set(), {}, {}, set()
    for pdf in batches:
        out = []
        for key, turn, seq, card, packet, image in zip(pdf["__case"], pdf["__turn"], pdf["__seq"], pdf["__card"], pdf["__packet"], pdf["__image"]):
            if key != case:
                case, packets, held, holder, bare = key, set(), {}, {}, set()
            card, packet = (None if pd.isna(v) else int(v) for v in (card, packet))
            if turn == 0:
                packets.add(packet)
                continue
            if turn == 1:
                held[card] = packet
                if packet is not None:
                    holder[packet] = card
                if not image:
                    bare.add(card)
                continue
            owner = holder.get(packet, card) if packet is not None else card
            why = NO_CARD if card not in held else None if packet is None else NO_PACKET if packet not in packets else TAKEN if owner != card else NO_IMAGE if card in bare else None
            if why is None:
                if holder.get(held[card]) == card:
                    del holder[held[card]]  # a move frees the packet it comes from
                held[card] = packet
                if packet is not None:
                    holder[packet] = card
            out.append((key, seq, why, held.get(card)))
        if out:
            yield pd.DataFrame(out, columns=["__case", "__seq", "refused", "attached"]).astype({"attached": "Int64"})


def decided(events: DataFrame, cards: DataFrame, packets: DataFrame, case: str, order: str) -> DataFrame:
    """events (case, order, card_id, packet; a null packet detaches) with refused (null if accepted) and attached, the card's packet after the event.

    cards: case, card_id, packet (at the start, or null), has_image; packets: case, packet. Numbers are whole. A case's log
    passes one task in order, row by row, and leaves nothing behind but the present state of its cards.
    """
    kind = dict(events.dtypes)[case]
    none = lambda t: F.lit(None).cast(t)
    columns = lambda df, turn, seq, card, packet, image: df.select(F.col(case).cast("string").alias("__case"), F.lit(turn).alias("__turn"), seq.cast("long").alias("__seq"), card.cast("long").alias("__card"), packet.cast("long").alias("__packet"), image.alias("__image"))
    rows = plain_unions(columns(packets, 0, F.lit(0), none("long"), F.col("packet"), none("boolean")))
    rows = rows.unionByName(columns(cards, 1, F.lit(0), F.col("card_id"), F.col("packet"), F.coalesce("has_image", F.lit(False)))).unionByName(columns(events, 2, F.col(order), F.col("card_id"), F.col("packet"), none("boolean")))
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(parts, "__case").sortWithinPartitions("__case", "__turn", "__seq", "__card")
    said = ordered.mapInPandas(_decide, "__case string, __seq long, refused string, attached long")
    said = said.select(F.col("__case").cast(kind).alias(case), F.col("__seq").alias(order), "refused", "attached")
    return events.join(said, [case, order])


def attached_now(cards: DataFrame, log: DataFrame, case: str, order: str) -> DataFrame:
    """case, card_id, packet, by_hand: cards after their last accepted event; one that was touched is no automatic match any more."""
    last = log.filter("refused is null").groupBy(case, "card_id").agg(F.max_by(F.struct("attached"), order).alias("l"))
    packet = F.when(F.col("l").isNotNull(), F.col("l.attached")).otherwise(F.col("packet"))
    return cards.join(last, [case, "card_id"], "left").select(case, "card_id", packet.alias("packet"), F.col("l").isNotNull().alias("by_hand"))


def card_list(cards: DataFrame, sides: DataFrame, case: str) -> DataFrame:
    """cards (case, card_id, order, packet, state, number, issues) in workbook order, with their images (card_id, side, width, height): front, back, unknown."""
    ranked = F.array_position(F.array(*map(F.lit, ("front", "back", "unknown"))), F.col("side"))
    own = sides.filter(ranked > 0).groupBy(case, "card_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(ranked.alias("rank"), "side", "width", "height"))), lambda s: F.struct(s["side"].alias("side"), s["width"].alias("width"), s["height"].alias("height"))).alias("sides"))
    listed = cards.join(own, [case, "card_id"], "left").withColumn("place", F.row_number().over(Window.partitionBy(case).orderBy("order")))
    return listed.select(case, "place", "card_id", "state", F.col("packet").alias("attached"), F.coalesce("number", F.lit("")).alias("number"), F.coalesce("issues", F.array().cast("array<string>")).alias("issues"), F.coalesce("sides", F.array().cast("array<struct<side:string,width:int,height:int>>")).alias("sides"))
