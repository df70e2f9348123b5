"""What is costly is done once: plans read their table once and fold or parse a text once."""

from proofsheet.operators import matching
from proofsheet.plans import catalog
from proofsheet.sources import reader_json

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_documents_are_folded_once_for_first_rows_and_their_number(spark):
    text = plan(catalog.QUERIES["first_row_index"](spark, SF))
    assert text.count("Relation [") == 1 and text.count("translate(") == 1


def test_first_row_with_its_number(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("", 2), (None, 4), ("b", 5)], "k string, n int")
    got = matching.first_row_index(df, df.k, "n", "many")
    assert sorted(map(tuple, got.collect())) == [("a", "a", 1, 2), ("b", "b", 5, 1)]


def test_people_are_read_once_for_all_findings(spark):
    people, all_findings = (plan(catalog.QUERIES[q](spark, SF)).count("Relation [") for q in ("roster_people", "roster_findings"))
    assert all_findings == people


def test_parts_of_a_reply_are_taken_out_once(spark):
    df = spark.createDataFrame([(1, '{"data": {"documents": []}}')], "k int, reply string")
    assert plan(reader_json.reader_words(df, ["k"], "reply")).count("$.coordinates") == 1


def test_lines_and_names_are_folded_once_for_confirmed_names(spark):
    assert plan(catalog.QUERIES["confirmed_names"](spark, SF)).count("translate(") <= 6  # 14 before; four of them draw the names


def test_best_window_is_the_one_that_difflib_finds():
    import random
    from difflib import SequenceMatcher

    import pandas as pd

    from proofsheet.operators import quotes

    rnd, words = random.Random(2), ["an", "a", "binh", "tran thi", "", "hoang", "nan"]
    tokens = [[rnd.choice(words) for _ in range(rnd.randint(0, 8))] for _ in range(400)]
    asked = [" ".join(t[1:5])[rnd.randint(0, 1):] + rnd.choice(["", "x"]) for t in tokens]
    got = quotes.best_window.func(pd.Series(tokens), pd.Series(asked))
    for t, q, start, n, ratio in zip(tokens, asked, got.start, got.words, got.ratio):
        best = (0.0, None, None)
        for i in range(len(t)):
            for j in range(i + 1, len(t) + 1):
                size = sum(len(w.split()) for w in t[i:j]) - len(q.split())
                r = SequenceMatcher(None, " ".join(t[i:j]), q, autojunk=False).ratio()
                if size > 2:
                    break
                if size >= -2 and r >= 0.9 and r > best[0]:
                    best = (r, i, j - i)
        assert best == ((ratio, start, n) if not pd.isna(ratio) else (0.0, None, None))


def test_words_behind_a_label_are_gathered_once_for_a_field(spark):
    assert plan(catalog.QUERIES["fields_with_boxes"](spark, SF)).count("flatten(") <= 2  # 24 when each look at a token gathered them


def test_announced_words_are_looked_for_once_a_line(spark):
    assert plan(catalog.QUERIES["listing_reads"](spark, SF)).count("[^\\p{L}\\p{N}_]") <= 2  # its line, and its line with those below
