"""Column expressions that several JVM-side operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
GAP = "[\\x20\\x09-\\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, whatever the optimiser merges."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Runs of anything but ASCII white space, in order; no text, no words."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(bare, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES)) != ""


def indices(n: Column) -> Column:
    """0 ... n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def shingle_hashes(w: Column, size: int) -> Column:
    """A 64-bit hash of each run of `size` words of the array w (a lambda variable)."""
    return F.transform(indices(F.size(w) - (size - 1)), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(size))))
