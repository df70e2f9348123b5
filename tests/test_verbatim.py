"""Quotes that stand in texts letter by letter."""

from proofsheet.operators import quotes
from proofsheet.plans import catalog


def test_letter_by_letter(spark):
    texts = {1: "xthe cat sat ony", 2: "The Cat sat on", 3: None, 4: "one, two", 5: "a  b c d", 6: "one two"}
    asked = {1: "the cat sat on", 2: "The cat", 3: "", 4: None, 5: "e,", 6: "a b c d", 7: "ne two", 8: "the cat sat on the mat", 9: "c", 10: " b c "}
    t = spark.createDataFrame(list(texts.items()), "t long, text string")
    q = spark.createDataFrame(list(asked.items()), "q long, text string")
    got = {tuple(r) for r in quotes.locate_verbatim(q, t, "q", "text", "t", "text").collect()}
    assert got == {(k, i) for k, a in asked.items() for i, b in texts.items() if a and b and a in b}


def test_placed_quotes_goes_by_letters(spark, tmp_path):
    spark.createDataFrame([(1, "the cat sat on"), (2, "the dog sat on")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(5, "THE DOG SAT ON"), (7, "xthe cat sat ony"), (8, "the cat sat on")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in catalog.QUERIES["placed_quotes"](spark, str(tmp_path)).collect()}
    assert got == {(1, 7, True), (2, None, False)}
