"""Connected components and spatial neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofsheet.functions.session import plain_unions


def overlap(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    """Shared length over the shorter length, 0 to 1."""
    shared = F.greatest(F.least(a_to, b_to) - F.greatest(a_from, b_from), F.lit(0))
    return shared / F.nullif(F.least(a_to - a_from, b_to - b_from), F.lit(0))


def neighbours(items: DataFrame, keys: list[str], item: str, top: str, bottom: str, least: float = 0.5) -> DataFrame:
    """Pairs (u, v), u < v, of items with equal keys whose vertical extents overlap by at least `least` of the shorter one."""
    a = items.select(*keys, F.col(item).alias("u"), F.col(top).alias("a0"), F.col(bottom).alias("a1"))
    b = items.select(*keys, F.col(item).alias("v"), F.col(top).alias("b0"), F.col(bottom).alias("b1"))
    return a.join(b, keys).filter("u < v").filter(overlap(F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1")) >= least).select(*keys, "u", "v")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every end of the edges (u, v); component is the least node that is reachable.

    Every round hands each node the least label among its neighbours' and its label's label, so labels jump along
    trees instead of walking edge by edge. Rounds end when no label changes; each is checkpointed.
    """
    both = plain_unions(edges).select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct().checkpoint()
    label = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")).checkpoint()
    for _ in range(rounds):
        near = both.join(label.select(F.col("u").alias("v"), F.col("label").alias("near")), "v").groupBy("u").agg(F.min("near").alias("near"))
        jump = label.select(F.col("u").alias("label"), F.col("label").alias("jump"))
        new = label.join(near, "u").join(jump, "label", "left").select("u", F.least("label", "near", F.coalesce("jump", "label")).alias("new"), F.col("label").alias("old")).checkpoint()
        if new.filter("new <> old").isEmpty():
            return label.select(F.col("u").alias("node"), F.col("label").alias("component"))
        label = new.select("u", F.col("new").alias("label"))
    raise RuntimeError(f"components are not settled after {rounds} rounds")
