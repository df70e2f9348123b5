"""Operator 4: quality rules by distribution divergence, with DataFrame functions only.

Two histograms of a document are compared with those of its language over all documents: character classes, and
the language's most common words (by count over all documents, then alphabetically; the rest is one more class).
The distance is Jensen-Shannon (square root of the divergence in bits, 0 to 1). Guards: the character test needs
`min_chars` characters, the word test `min_words` words; a shorter text is not judged by it. A small sample strays from
any reference by about 1 / sqrt(size), so each limit is widened by `..._noise` / sqrt(size). Documents that fail a
base rule (fewer than 50 words, or more than half of them in repeated three-word windows) are rejected anyway.

Repeats of three-word windows are found per text by 64-bit hashes of its windows: a set of them shows whether there
is any repeat, and only then are they sorted, so a text of n words takes n log n steps; no text is exploded or shuffled
for it. Common words are looked for among those words alone whose hash falls into a slot that a common word has.

Defined results: null and empty texts have zeros and fail; a null language is a language of its own; repeated rows
are judged alike and count each in the references; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofsheet.llm import common as C
from proofsheet.llm import native as N

#: in the order in which they are taken out of a text, the commonest first
CLASSES = {"lower": "[a-z]+", "space": N.GAP, "stop": "[.,;:'\"()?-]+", "upper": "[A-Z]+", "symbol": "[#*$%&|<>]+", "digit": "[0-9]+"}
COMMON = 40
SLOTS = 1024
BROADCAST_BYTES = 8 << 20


def repeat_words(w: Column) -> Column:
    """Words of the array w that lie in a three-word window which the array holds at least twice."""
    n = F.size(w)

    def covered(starts: Column) -> Column:
        step = lambda acc, i: F.struct(F.greatest(acc["end"], i + 3).alias("end"), (acc["sum"] + i + 3 - F.greatest(acc["end"], i)).alias("sum"))
        return F.aggregate(starts, F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum")), step, lambda acc: acc["sum"])

    def few(h: Column, twice: Column) -> Column:
        return F.filter(N.indices(F.size(h)), lambda i: F.array_contains(twice, F.get(h, i)))

    def many(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        near = lambda p, x, j: (j >= 0) & F.coalesce(F.get(p, j)["h"] == x["h"], F.lit(False))
        return N.let(pairs, lambda p: F.sort_array(F.transform(F.filter(p, lambda x, j: near(p, x, j - 1) | near(p, x, j + 1)), lambda x: x["i"])))

    def repeated(h: Column) -> Column:
        return N.let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, j: (j > 0) & (F.get(s, F.greatest(j - 1, F.lit(0))) == x))))

    def count(h: Column) -> Column:
        return N.let(repeated(h), lambda twice: F.when(F.size(twice) == 0, F.lit(0)).when(F.size(twice) <= 128, covered(few(h, twice))).otherwise(covered(many(h))))

    some = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(count(h))
    return F.when(n < 4, F.lit(0)).otherwise(N.let(N.shingle_hashes(w, 3), some)).cast("long")


def slot(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(SLOTS)).cast("int")


def slots(common: Column) -> Column:
    """For each slot whether a word of the array `common` has it."""
    return N.let(F.transform(common, slot), lambda own: F.transform(N.indices(F.lit(SLOTS)), lambda i: F.array_contains(own, i)))


def common_counts(w: Column, common: Column, taken: Column) -> Column:
    """(rank, n) of those words of the array `common` (with these slots) that the array w holds; ranks begin at 1."""
    likely = F.filter(w, lambda x: F.get(taken, slot(x)))
    ranks = F.sort_array(F.filter(F.transform(likely, lambda x: F.array_position(common, x)), lambda i: i > 0))
    first = lambda s: F.filter(N.indices(F.size(s)), lambda j: (j == 0) | (F.get(s, F.greatest(j - 1, F.lit(0))) != F.get(s, j)))
    end = lambda s, f, k: F.coalesce(F.get(f, k + 1), F.size(s))
    each = lambda s, f: F.transform(f, lambda j, k: F.struct(F.get(s, j).cast("int").alias("rank"), (end(s, f, k) - j).alias("n")))
    return N.let(ranks, lambda s: N.let(first(s), lambda f: each(s, f)))


def text_features(docs: DataFrame, common: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang, n_chars, one count per character class (n_lower ...), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, said.

    common: lang, words (the language's common words), slots; said: how often the text says them.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    df = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), text.alias("text"))
    beside = F.broadcast(common) if C.staged_bytes(common) <= BROADCAST_BYTES else common
    df = df.alias("d").join(beside.alias("c"), F.expr("d.lang <=> c.lang"), "left").select("d.*", F.coalesce("c.words", F.array().cast("array<string>")).alias("common"), F.coalesce("c.slots", F.array().cast("array<boolean>")).alias("slots"))
    size = F.length("text").cast("long")
    kinds, rest = [], F.col("text")
    for k, pattern in CLASSES.items():  # each class is looked for in what the ones before leave
        less = F.regexp_replace(rest, pattern, "")
        kinds.append((F.length(rest) - F.length(less)).cast("long").alias(f"n_{k}"))
        rest = less
    full = F.filter(N.lines(F.col("text")), N.has_word)
    dup = N.let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")
    said = lambda w: common_counts(F.transform(w, F.lower), F.col("common"), F.col("slots"))
    counted = N.let(N.words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words"), said(w).alias("said")))
    df = df.select("doc_id", "lang", F.xxhash64("text").alias("text_key"), size.alias("n_chars"), *kinds, dup.alias("n_dup_lines"), counted.alias("counted"))
    return df.select("*", "counted.n_words", "counted.n_repeat_words", "counted.said", (F.col("n_chars") - F.col("n_space")).alias("word_chars"), F.col("n_symbol").alias("n_symbols")).drop("counted")


def js_part(p: Column, q: Column) -> Column:
    m = (p + q) / 2
    return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, y: a + y)


def js_distance(parts: Column) -> Column:
    """Jensen-Shannon distance of two histograms, from an array of (p, q) shares; what either lacks to 1 is one more class, and where p is 0 q may be left out."""
    def whole(x: Column) -> Column:
        p, q = (F.greatest(1 - total(F.transform(x, lambda y: y[c])), F.lit(0.0)) for c in "pq")
        return F.sqrt(F.greatest((total(F.transform(x, lambda y: js_part(y["p"], y["q"]))) + js_part(p, q)) / 2, F.lit(0.0)))

    return N.let(parts, whole)


def common_words(docs: DataFrame, lang_col: str, text_col: str, most: int = COMMON) -> DataFrame:
    """lang, words, counts, slots: the most common words of each language over all documents; ties alphabetically."""
    said = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.explode(N.words(F.lower(F.col(f"`{text_col}`").cast("string")))).alias("word"))
    ranked = said.groupBy("lang", "word").agg(F.count("*").alias("n")).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word")))
    best = ranked.filter(F.col("rank") <= most).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "word", "n"))).alias("top"))
    return best.select("lang", F.col("top.word").alias("words"), F.col("top.n").alias("counts"), slots(F.col("top.word")).alias("slots"))


def quality_rules(docs: DataFrame, char_limit: float = 0.2, word_limit: float = 0.25, char_noise: float = 1.5, word_noise: float = 1.2, min_chars: int = 200, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance, text_key of every row."""
    common = C.staged(common_words(docs, lang_col, text_col), "common")  # a row a language
    feats = C.staged(text_features(docs, common, lang_col, id_col, text_col), "features")
    kinds = [f"n_{k}" for k in CLASSES]
    reference = feats.groupBy("lang").agg(F.sum("n_chars").alias("all_chars"), F.sum("n_words").alias("all_words"), *(F.sum(k).alias(f"all_{k}") for k in kinds))
    reference = reference.alias("a").join(common.alias("b"), F.expr("a.lang <=> b.lang"), "left").select("a.*", "counts")
    reference = C.staged(reference, "reference")  # a row a language
    beside = F.broadcast(reference) if C.staged_bytes(reference) <= BROADCAST_BYTES else reference
    x = feats.alias("f").join(beside.alias("r"), F.expr("f.lang <=> r.lang"), "left").drop(F.col("r.lang"))

    share = lambda a, b: a / F.greatest(b, F.lit(1))
    chars = F.array(*(F.struct(share(F.col(k), F.col("n_chars")).alias("p"), share(F.col(f"all_{k}"), F.col("all_chars")).alias("q")) for k in kinds))
    # ranks that the text lacks: their q goes to a class of its own with p = 0, which weighs as the ranks would
    held = F.transform("said", lambda y: F.struct(share(y["n"], F.col("n_words")).alias("p"), share(F.get(F.col("counts"), y["rank"] - 1), F.col("all_words")).alias("q")))
    lacking = share(F.aggregate("counts", F.lit(0).cast("long"), lambda a, y: a + y), F.col("all_words")) - total(F.transform("said", lambda y: share(F.get(F.col("counts"), y["rank"] - 1), F.col("all_words"))))
    spoken = F.concat(held, F.array(F.struct(F.lit(0.0).alias("p"), F.coalesce(F.greatest(lacking, F.lit(0.0)), F.lit(0.0)).alias("q"))))
    x = x.select("*", js_distance(chars).alias("char_distance"), js_distance(spoken).alias("word_distance"))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    odd = ((F.col("n_chars") >= min_chars) & (F.col("char_distance") > char_limit + char_noise / F.sqrt("n_chars"))) | ((F.col("n_words") >= min_words) & (F.col("word_distance") > word_limit + word_noise / F.sqrt("n_words")))
    return x.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & ~odd).alias("kept"), "char_distance", "word_distance", "text_key")
