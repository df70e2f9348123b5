"""A setting that results depend on."""

from __future__ import annotations

from pyspark.sql import DataFrame

UNION = "spark.sql.unionOutputPartitioning"


def plain_unions(df: DataFrame) -> DataFrame:
    """df, in a session whose unions claim no partitioning.

    Spark 4.1 takes a union of tables that are each dealt by a key for dealt by that key and leaves out the shuffle before
    a join or window on it, which gives wrong rows (seen with two windows, a union and an outer self-join, with and
    without adaptive execution). Versions without that setting have no such claim.
    """
    df.sparkSession.conf.set(UNION, "false")
    return df
