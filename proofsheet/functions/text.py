"""Text normalisation as column expressions: accents, digits, names, organisations, phrases, keys."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@cache
def accent_map() -> tuple[str, str]:
    """Letters whose canonical decomposition is one base letter and marks, and these base letters; from the Unicode data."""
    source, target = ["đ", "Đ"], ["d", "D"]
    for code in range(0xC0, 0x2000):
        base = "".join(x for x in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(x))
        if len(base) == 1 and base != chr(code):
            source.append(chr(code))
            target.append(base)
    return "".join(source), "".join(target)


def text_of(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def fold_accents(c: Column) -> Column:
    """Lower case without accents; white space as it was. Null is empty."""
    bare = F.regexp_replace(F.replace(text_of(c), F.lit("ß"), F.lit("ss")), "\\p{Mn}", "")
    return F.lower(F.translate(bare, *accent_map()))


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, "\\s+", " "))


def fold_label(c: Column) -> Column:
    """fold_accents and collapse: how headers are compared."""
    return collapse(fold_accents(c))


def fold_words(c: Column) -> Column:
    """fold_accents with punctuation as blanks, collapsed: how quotes are compared."""
    return collapse(F.regexp_replace(fold_accents(c), "[^\\p{L}\\p{N}_\\s]", " "))


def fold_each(texts: Column) -> Column:
    """fold_words of every text of an array, by one pass over all of them."""
    lines = F.array_join(F.transform(texts, lambda t: F.translate(text_of(t), "\n", " ")), "\n")
    bare = F.regexp_replace(F.regexp_replace(fold_accents(lines), "[^\\p{L}\\p{N}_\\s]", " "), "[ \\t\\x0B\\f\\r]+", " ")
    return F.when(texts.isNotNull(), F.split(F.trim(F.replace(F.replace(bare, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))), "\n"))


def digits(c: Column) -> Column:
    """The digits 0-9 of a value, as text: leading zeros are data."""
    return F.regexp_replace(text_of(c), "[^0-9]", "")


def person_key(c: Column) -> Column:
    return collapse(F.regexp_replace(fold_accents(c), "[^a-z0-9 ]", " "))


#: Words that say a name is a company's.
COMPANY_WORDS = "cong ty|cty|tnhh|cp|co|ltd|jsc|corporation|corp|tap doan"


def organisation_key(c: Column) -> Column:
    return person_key(F.regexp_replace(fold_accents(c), rf"\b(?:{COMPANY_WORDS})\b", " "))


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for two empty texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def contained_ratio(a: Column, b: Column) -> Column:
    """edit_ratio, at least 0.9 if one set of words holds the other."""
    x, y = F.split(a, " "), F.split(b, " ")
    inside = (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)
    return F.when(inside, F.greatest(edit_ratio(a, b), F.lit(0.9))).otherwise(edit_ratio(a, b))


def has_phrase(text: Column, phrase: Column | str) -> Column:
    """Whether a folded text holds a folded phrase at word boundaries."""
    phrase = F.lit(phrase) if isinstance(phrase, str) else phrase
    return F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def is_person_name(c: Column) -> Column:
    """Two to five words, each of letters and capitalised."""
    words = F.split(collapse(text_of(c)), " ")
    return F.size(words).between(2, 5) & F.forall(words, lambda w: w.rlike("^\\p{Lu}\\p{L}*$"))


def is_heading(c: Column, most: int = 10) -> Column:
    """At most `most` words, all cased letters upper-case, at least one of them."""
    return (F.size(F.split(collapse(c), " ")) <= most) & (c == F.upper(c)) & c.rlike("\\p{Lu}")


def slug(c: Column, join: str = "-") -> Column:
    return F.regexp_replace(F.regexp_replace(fold_accents(c), "[^a-z0-9]+", join), f"^{join}+|{join}+$", "")


def override_key(number: Column, document: Column) -> Column:
    return F.concat(F.lpad(number.cast("string"), 2, "0"), F.lit(":"), document)


def parse_override_key(key: Column) -> Column:
    parts = F.split(key, ":", 2)
    return F.struct(F.get(parts, F.lit(0)).try_cast("int").alias("number"), F.get(parts, F.lit(1)).alias("document"))


def column_index(letters: Column) -> Column:
    """0 for A, 26 for AA."""
    value = F.aggregate(F.split(F.upper(letters), ""), F.lit(0), lambda a, x: F.when(x == "", a).otherwise(a * 26 + F.ascii(x) - 64))
    return value - 1


def column_letters(index: Column) -> Column:
    """A for 0, AA for 26; up to two letters."""
    one = lambda i: F.char(i + 65)
    return F.when(index < 26, one(index)).otherwise(F.concat(one(F.floor(index / 26) - 1), one(index % 26)))
