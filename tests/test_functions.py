"""Text and value functions against plain Python models and stated examples."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from proofsheet.functions import text as T
from proofsheet.functions import values as V
from proofsheet.operators import quotes


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def many(spark, f, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"c{k} string" for k in range(len(rows[0]))))
    return [r.x for r in df.select("i", f(*(F.col(f"c{k}") for k in range(len(rows[0])))).alias("x")).orderBy("i").collect()]


def fold(s):
    s = (s or "").replace("đ", "d").replace("Đ", "D").replace("ß", "ss")
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)).lower()


def test_fold_accents(spark):
    rng = random.Random(1)
    texts = ["Nguyễn Văn Đức", "", "ß É", "Áe"] + ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0xC0, 0x17F), rng.randint(0x1EA0, 0x1EF9)])) for _ in range(20)) for _ in range(200)]
    assert many(spark, T.fold_accents, [(t,) for t in texts]) == [fold(t) for t in texts]


def test_ratios_and_phrases(spark):
    rng = random.Random(2)

    def edit(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    pairs = [("".join(rng.choice("ab ") for _ in range(rng.randint(0, 9))), "".join(rng.choice("ab ") for _ in range(rng.randint(0, 9)))) for _ in range(200)]
    got = many(spark, T.edit_ratio, pairs)
    assert all(abs(g - (1 - edit(a, b) / max(len(a), len(b)) if a or b else 1)) < 1e-12 for g, (a, b) in zip(got, pairs))
    assert many(spark, T.has_phrase, [("so tai khoan", "tai khoan"), ("taikhoan", "khoan")]) == [True, False]
    assert many(spark, T.contained_ratio, [("abc", "abc def ghi"), ("abc", "xyz")]) == [0.9, 0.0]


def test_money(spark):
    cells = ["8000000", "8.000.000", "", None, "1,234", "abc", "2.5", "3.5", "-7"]
    assert many(spark, V.money, [(c,) for c in cells]) == [8000000, None, None, None, 1234, None, 2, 4, -7]
    tokens = ["8.888.889", "8888889", "8333.333", "25,000 VND", "1.000.", "12.34"]
    assert many(spark, V.money_token, [(t,) for t in tokens]) == [8888889, None, 8333333, 25000, 1000, None]


def test_dates(spark):
    assert many(spark, V.plain_date, [("05/06/2020",), ("2020-6-5",), ("5.6.2020",), (" x ",), (None,)]) == ["5-6-2020", "5-6-2020", "5-6-2020", "x", ""]
    assert many(spark, V.is_printed_date, [("1.2.2020",), ("1/2/20",)]) == [True, False]
    assert many(spark, V.is_roster_date, [("1.2.2020",), ("1-2-2020",)]) == [False, True]


@pytest.mark.parametrize("kind, a, b, want", [
    ("digits", "012 345", "012345", "match"), ("digits", "12345", "012345", "mismatch"), ("digits", "", "", "mismatch"),
    ("money", "0012", "12", "match"), ("money", "000", "0", "match"), ("money", "", "0", "mismatch"),
    ("date", "5/6/2020", "2020-06-05", "match"), ("date", "", "", "mismatch"),
    ("person", "Nguyễn Văn An", "Nguyễn Văn An", "match"), ("person", "Nguyễn Văn An", "NGUYEN VAN AN", "fuzzy"), ("person", "Nguyen Van An", "Nguyen Van Am", "fuzzy"),
    ("person", "Nguyen Van An", "Nguyen An", "mismatch"), ("person", "Nguyen Van An", "Tran Thi Binh", "mismatch"),
    ("organisation", "Cong ty TNHH Abc", "ABC", "fuzzy"), ("organisation", "Abc", "Abc", "match"), ("organisation", "Abc", "Xyz", "mismatch"),
    ("text", " a ", "a", "match"), ("text", "", "", "mismatch"), ("enum", "Nam", "Nam", "match"), ("enum", "Nữ", "nu", "fuzzy"), ("enum", "Nam", "Khác", "mismatch"),
])
def test_compare(spark, kind, a, b, want):
    assert one(spark, V.compare(F.col("a"), F.col("b"), kind, ("Nam", "Nữ")), a=a, b=b) == want


def test_unknown_names_raise(spark):
    with pytest.raises(KeyError):
        V.compare(F.lit("a"), F.lit("b"), "colour")
    with pytest.raises(KeyError):
        V.matches_format(F.lit("a"), ("id13",))


def test_formats_and_reasons(spark):
    assert many(spark, lambda c: V.matches_format(c, ("id12", "passport8")), [("012345678901",), ("B1234567",), ("B123 567",), ("1",)]) == [True, True, False, False]
    assert many(spark, lambda a, b: V.fuzzy_reason(a, b, "person"), [("Lê An", "LE AN"), ("Le An", "Le Am"), ("Le An", "Le An")]) == ["folded", "near", ""]
    assert many(spark, V.digit_gap, [("123456", "123457"), ("123456", "123456"), ("123456", "999999")]) == [1, None, None]


def test_spelled_amounts(spark):
    said = ["ba trăm lẻ năm", "hai triệu ba trăm nghìn", "mười hai", "nghìn", "Nguyễn", "tám triệu tám trăm tám mươi tám nghìn tám trăm tám mươi chín đồng", "một tỷ"]
    assert many(spark, quotes.spelled_amount, [(s,) for s in said]) == [305, 2300000, 12, None, None, 8888889, 1000000000]


def test_damaged_amounts(spark):
    got = many(spark, quotes.digit_repairs, [("25§.638.890",), ("1.000",), ("§§§§.000",), ("x",)])
    assert 258638890 in got[0] and got[1] == [1000] and got[2] == [] and got[3] == []


def test_keys_and_columns(spark):
    assert many(spark, lambda c: T.override_key(c, F.lit("BBNT")), [("7",), ("21",)]) == ["07:BBNT", "21:BBNT"]
    assert [tuple(x) for x in many(spark, T.parse_override_key, [("07:a:b",)])] == [(7, "a:b")]
    assert many(spark, T.column_index, [("A",), ("Z",), ("AA",), ("AZ",)]) == [0, 25, 26, 51]
    assert many(spark, lambda c: T.column_letters(c.cast("int")), [("0",), ("25",), ("26",), ("51",)]) == ["A", "Z", "AA", "AZ"]
    assert many(spark, T.is_person_name, [("Nguyễn Văn An",), ("An",), ("nguyen van",), ("Bên A ký 2",)]) == [True, False, False, False]
