"""Quotes and pages: folded in one pass, dealt in parts where a document has many, compared word by word only where that can help."""

import random

from pyspark.sql import functions as F

from proofsheet.functions import text as T
from proofsheet.operators import quotes


def test_fold_each_is_fold_words_of_each(spark):
    rows = [(1, ["Đây là", None, "", " - ", "a\nB\t c", "x-y", "STRASSE ß", "ΟΔΟΣ", "é", "…", "𝐀-1"]), (2, []), (3, None), (4, [""]), (5, ["\n"]), (6, ["a", " "])]
    df = spark.createDataFrame(rows, "id int, t array<string>")
    got = {r.id: (r.each, r.one) for r in df.select("id", F.transform("t", lambda x, i: F.get(T.fold_each(F.col("t")), i)).alias("each"), F.transform("t", T.fold_words).alias("one")).collect()}
    assert len(got) == 6 and all(each == one for each, one in got.values())


def test_document_of_many_quotes_is_dealt_in_parts(spark):
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice(["ba", "da", "la", "ma", "na", "ra"]) + str(rnd.randrange(1000)) for _ in range(12)) for _ in range(3 * quotes.TOGETHER)]
    pages = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)] + [("e", 0, texts[0])], "doc string, page int, text string")
    asked = pages.select("doc", F.struct("doc", "page").alias("id"), F.when(F.col("page") % 2 == 0, F.concat(F.lit("ж"), F.substring("text", 2, 1000))).otherwise(F.col("text")).alias("quote"), F.lit(None).cast("int").alias("claimed"))
    found = quotes.locate_quotes(asked, pages, "doc", "id", "quote", "claimed", "page", "text")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("(__part#") > 1
    got = {(r.id.doc, r.id.page): (r.page, r.exact) for r in found.collect()}
    assert got == {("d", i): (i, i % 2 == 1) for i in range(len(texts))} | {("e", 0): (0, False)}


def test_pairs_that_cannot_be_alike_are_left_before_stretches_are_compared():
    import time

    import pandas as pd

    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("aeinrst") for _ in range(rnd.randint(2, 8)))
    tokens = [[word() for _ in range(150)] for _ in range(2000)]
    asked = [" ".join(word() for _ in range(12)) for _ in tokens]
    asked[7] = " ".join(tokens[7][40:50] + ["x"])
    began = time.process_time()
    got = quotes.best_window.func(pd.Series(tokens), pd.Series(asked))
    assert time.process_time() - began < 3  # 14.7 s with every stretch, 0.8 s since
    assert got.ratio.notna().sum() == 1 and got.start[7] in (39, 40)
