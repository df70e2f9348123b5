"""Money, dates, formats and comparison verdicts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofsheet.functions import text as T

MATCH, FUZZY, MISMATCH = "match", "fuzzy", "mismatch"
NAME_SIMILARITY, LOW_CONFIDENCE = 0.8, 0.7


def money(c: Column) -> Column:
    """A cell as a whole number, half to even; null if it is none (two points, as in grouped text, make none)."""
    bare = F.regexp_replace(T.text_of(c), "[^0-9.\\-]", "")
    return F.bround(bare.try_cast("double"), 0).cast("long")


def money_token(c: Column) -> Column:
    """The amount that one printed token spells; it needs a group separator, else it may be a quantity or an id."""
    bare = F.regexp_replace(F.trim(T.fold_accents(c)), "[.,;:]+$", "")
    group = F.regexp_extract(bare, "^([0-9]{1,4}(?:[.,][0-9]{3})+)\\s*(?:vnd|d)?$", 1)
    return F.when(group != "", F.regexp_replace(group, "[.,]", "")).cast("long")


def grouped(c: Column, mark: str = ",") -> Column:
    """A whole number with thousands grouped."""
    return F.translate(F.format_number(c, 0), ",", mark)


def plain_date(c: Column) -> Column:
    """d-m-yyyy from day or year first with - / or a point between; other text trimmed. The calendar is not consulted."""
    bare = F.trim(T.text_of(c))
    first = "^([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})$"
    last = "^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4})$"
    part = lambda p, i: F.regexp_extract(bare, p, i).try_cast("int").cast("string")
    return F.when(bare.rlike(first), F.concat_ws("-", part(first, 3), part(first, 2), part(first, 1))).when(bare.rlike(last), F.concat_ws("-", part(last, 1), part(last, 2), part(last, 3))).otherwise(bare)


def is_printed_date(c: Column) -> Column:
    """dd/mm/yyyy as printed values allow it."""
    return F.trim(T.text_of(c)).rlike("^[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4}$")


def is_roster_date(c: Column) -> Column:
    """dd/mm/yyyy as rosters must hold it: no points."""
    return F.trim(T.text_of(c)).rlike("^[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{4}$")


FORMATS = {
    "id12": lambda c: F.length(T.digits(c)) == 12,
    "tax10": lambda c: F.length(T.digits(c)) == 10,
    "tax12": lambda c: F.length(T.digits(c)) == 12,
    "passport8": lambda c: F.trim(T.text_of(c)).rlike("^[\\p{L}\\p{N}]{8}$"),
    "dd/mm/yyyy": is_printed_date,
}


def matches_format(c: Column, formats: tuple[str, ...]) -> Column:
    """Whether any of the formats fits; no format accepts all, an unknown one raises KeyError."""
    out = F.lit(not formats)
    for name in formats:
        out = out | FORMATS[name](c)
    return out


def _verdict(match: Column, fuzzy: Column) -> Column:
    return F.when(match, MATCH).when(fuzzy, FUZZY).otherwise(MISMATCH)


def compare(expected: Column, value: Column, kind: str, allowed: tuple[str, ...] = ()) -> Column:
    """match, fuzzy or mismatch of two values under the rule for the kind; an unknown kind raises KeyError.

    Confidence plays no part: how legible a value was says nothing about what it is.
    """
    a, b = F.trim(T.text_of(expected)), F.trim(T.text_of(value))
    same, no = (a != "") & (a == b), F.lit(False)
    if kind in ("digits", "money"):
        x, y = T.digits(expected), T.digits(value)
        if kind == "money":
            x, y = (F.when(z != "", F.regexp_replace(F.regexp_replace(z, "^0+", ""), "^$", "0")).otherwise("") for z in (x, y))
        return _verdict((x != "") & (x == y), no)
    if kind == "date":
        return _verdict((a != "") & (b != "") & (plain_date(expected) == plain_date(value)), no)
    if kind == "text":
        return _verdict(same, no)
    if kind == "enum":
        options = [T.fold_accents(F.lit(x)) for x in allowed]
        x, y = T.fold_accents(expected), T.fold_accents(value)
        both = (x == y) & (x != "") & x.isin(*options)
        return _verdict(both & (a == b), both)
    if kind == "person":
        x, y = T.person_key(expected), T.person_key(value)
        words = F.size(F.split(x, " ")) == F.size(F.split(y, " "))
        return _verdict(same, (x != "") & (y != "") & ((x == y) | (words & (T.edit_ratio(x, y) >= NAME_SIMILARITY))))
    if kind in ("organisation", "name"):
        x, y = T.organisation_key(expected), T.organisation_key(value)
        return _verdict(same, (x != "") & (y != "") & (T.contained_ratio(x, y) >= NAME_SIMILARITY))
    raise KeyError(f"no comparator for kind {kind!r}")


KINDS = ("digits", "money", "date", "text", "enum", "person", "organisation")


def compare_by(kind: Column, expected: Column, value: Column, allowed: tuple[str, ...] = (), kinds: tuple[str, ...] = KINDS) -> Column:
    """compare with the kind in a column, one of `kinds`; null for any other."""
    out = F.lit(None).cast("string")
    for k in kinds:
        out = F.when(kind == k, compare(expected, value, k, allowed)).otherwise(out)
    return out


def fuzzy_reason(expected: Column, value: Column, kind: str, allowed: tuple[str, ...] = ()) -> Column:
    """Why a verdict is fuzzy: folded (same letters but for accents or case), near, or empty."""
    key = {"person": T.person_key, "organisation": T.organisation_key, "name": T.organisation_key}.get(kind, T.fold_accents)
    return F.when(compare(expected, value, kind, allowed) != FUZZY, "").when(key(expected) == key(value), "folded").otherwise("near")


def verdict_status(verdict: Column) -> Column:
    return F.when(verdict == MATCH, "ok").when(verdict == MISMATCH, "no").when(verdict == FUZZY, "rv")


def digit_gap(expected: Column, value: Column) -> Column:
    """Edits between two digit strings if they are one or two, else null: a likely misread."""
    d = F.levenshtein(T.digits(expected), T.digits(value))
    return F.when(d.between(1, 2), d)


def legacy_verdict(expected: Column, value: Column, kind: str, confidence: Column, allowed: tuple[str, ...] = ()) -> Column:
    """The reviewers' older rule: a match below the confidence line is low_conf."""
    v = compare(expected, value, kind, allowed)
    return F.when((v == MATCH) & (confidence < LOW_CONFIDENCE), "low_conf").otherwise(v)


def severity(verdict: Column) -> Column:
    """Mismatches first."""
    return F.when(verdict == MISMATCH, 0).when(verdict == FUZZY, 1).when(verdict == "low_conf", 2).otherwise(3)
