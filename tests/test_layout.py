"""Page geometry against pages drawn by hand and against plain Python."""

import random

from pyspark.sql import functions as F

from proofsheet.operators import layout as L
from proofsheet.operators import segments

WORDS = "page int, at int, text string, x int, y int, w int, h int, conf int"


def page(number, *lines, conf=95):
    """Words of lines given as (y, [(x, text) ...]); a word is 10 wide a letter."""
    out = []
    for y, words in lines:
        for x, text, *c in words:
            out.append((number, len(out), text, x, y, 10 * len(text), 20, c[0] if c else conf))
    return out


def run(spark, *pages):
    words = spark.createDataFrame([w for p in pages for w in p], WORDS)
    return L.page_rows(words, ["page"])


def spread(x, text, *conf):
    out = []
    for t in text.split(" "):
        out.append((x, t, *conf))
        x += 10 * len(t) + 10
    return out


HEAD = (100, [*spread(100, "VNG"), *spread(700, "BÊN CUNG ỨNG DỊCH VỤ")])


def two(y, left, right):
    return y, [*spread(100, left), *spread(700, right)]


FULL = (400, spread(100, "một dòng chữ dài đi qua cả hai cột và che kín khoảng trống ở giữa trang giấy này"))


ROWS = [two(140, "Ông A", "Ông B"), two(180, "Email: a", "Email: b")]
LATE = two(300, "muộn", "hơn")
NOTE = (220, spread(100, "ghi chú"))
#: lines of a page, and its blocks
BLOCKS = [
    ([HEAD, two(140, "Họ và tên: Lê An", "Họ và tên: Trần Bình"), ROWS[1]], [(100, 200, (260 + 700) // 2)]),
    ([HEAD, ROWS[0]], []),  # one row is none
    (ROWS, []),  # no heading
    ([HEAD, ROWS[0], FULL], []),
    ([(100, [*spread(100, "của"), *spread(700, "BÊN CUNG ỨNG DỊCH VỤ sẽ")]), *ROWS], []),  # the heading does not end its row
    ([(100, spread(100, "và BÊN CUNG ỨNG DỊCH VỤ")), *ROWS], []),  # no clear band beside it
    ([(100, [*HEAD[1], (1000, "|", 20), (400, "+}", 30)]), *ROWS], [(100, 200, 440)]),  # what is not printed does not count in the heading
    ([HEAD, *ROWS, NOTE, LATE], [(100, 320, 440)]),  # one one-sided row
    ([HEAD, *ROWS, NOTE, (260, spread(100, "thêm")), LATE], [(100, 200, 440)]),  # two of them
    ([HEAD, *ROWS, FULL, two(440, "sau", "đó")], [(100, 200, 440)]),
    ([HEAD, ROWS[0], two(180, "một cột rất rộng ở phía bên trái đấy nhé ạ", "b"), two(220, "x", "y")], [(100, 240, (100 + 420 + 700) // 2)]),
    ([HEAD, *ROWS, (500, HEAD[1]), two(540, "c", "d"), two(580, "e", "f")], [(100, 600, 440), (500, 600, 415)]),
    ([], []),
]


def test_blocks(spark):
    pages = [page(i, *lines) for i, (lines, _) in enumerate(BLOCKS)]
    got = {r.page: [(b.top, b.bottom, b.gutter) for b in r.b] for r in run(spark, *pages).select("page", L.column_blocks(F.col("rows"), F.col("width")).alias("b")).collect()}
    assert got == {i: want for i, (lines, want) in enumerate(BLOCKS) if lines}


PAIR = [two(140, "Họ và tên: Lê Văn An", "Họ và tên: Trần Thị Bình"), two(180, "Email: a", "Email: b")]
MANY = [(100 + 40 * i, [*spread(100, "Họ và tên:"), *spread(300, n, c)]) for i, (n, c) in enumerate([("Lê An", 60), ("Lê Ba", 90), ("Lê Ca", 70), ("Lê Da", 90)])]
#: lines of a page, and its names with rank and confidence
NAMES = [
    ([HEAD, *PAIR], [("Trần Thị Bình", 1, 0.95), ("", 0, 0.0)]),
    (PAIR, [("", 0, 0.0)]),  # no heading
    ([HEAD, (140, spread(100, "Họ và tên: Lê Văn An")), (149, spread(700, "Họ và tên: Trần Thị Bình")), PAIR[1]], [("Trần Thị Bình", 1, 0.95), ("", 0, 0.0)]),  # the first party's name is no source; the heading is a label without a name
    ([HEAD, PAIR[0], (148, [(960, "Hà")]), PAIR[1]], [("Trần Thị Bình Hà", 1, 0.95), ("", 0, 0.0)]),
    ([(100, spread(100, "BÊN CUNG ỨNG DỊCH VỤ: Bùi Quang Vinh"))], [("Bùi Quang Vinh", 1, 0.95)]),
    ([(100, spread(100, "Họ và tên: Bùi Quang Vinh"))], [("Bùi Quang Vinh", 0, 0.95)]),
    ([(100, spread(100, "Họ và tên:")), (140, spread(100, "Bùi Quang Vinh"))], [("Bùi Quang Vinh", 0, 0.95)]),
    ([(100, spread(100, "Bên cung ứng dịch vụ sẽ làm"))], []),  # prose
    ([(100, spread(100, "Họ và tên: 12x"))], [("", 0, 0.0)]),
    ([(100, spread(100, "Tên tôi là : Lê An")), (200, spread(100, "Tên tôi là : Lê An"))], [("Lê An", 1, 0.95)]),
    ([(100, spread(100, "không có nhãn"))], []),
    # a row that was cut: the rest of the name stands a little lower; a speck at the margin or another label spoils it
    ([(100, spread(100, "BÊN CUNG ỨNG DỊCH VỤ : Bùi Quang")), (109, [(500, "Vinh")])], [("Bùi Quang Vinh", 1, 0.95)]),
    ([(100, spread(100, "BÊN CUNG ỨNG DỊCH VỤ : Bùi Quang")), (109, [(500, "ZZ", 2)])], [("Bùi Quang", 1, 0.95)]),
    ([(100, spread(100, "BÊN CUNG ỨNG DỊCH VỤ : Bùi Quang")), (109, [(500, "Họ")])], [("Bùi Quang", 1, 0.95)]),
    ([*MANY, (400, spread(100, "TÊN TÔI LÀ Lê Ê", 55))], [("Lê Ê", 1, 0.55), ("Lê Ba", 0, 0.9), ("Lê Da", 0, 0.9)]),  # three at most
]


def test_names(spark):
    got: dict[int, list] = {i: [] for i in range(len(NAMES))}
    for r in L.find_names(run(spark, *(page(i, *lines) for i, (lines, _) in enumerate(NAMES))), ["page"]).orderBy("page", "place").collect():
        got[r.page].append((r.value, r.rank, round(r.confidence, 2)))
    assert got == {i: want for i, (_, want) in enumerate(NAMES)}


def beside(text):
    return (100, [*spread(100, "Số CCCD:"), *spread(400, text)])


#: field, lines of a page, and its hits: value, box, confidence, near
FIELDS = [
    ("cccd", [(100, [*spread(100, "Số CCCD:"), (200, "001", 80), (240, "203004005", 70), *spread(400, "Ngày cấp: 1/1/2020")])], [("001203004005", (200, 100, 130, 20), 0.7, "Số CCCD: 001 203004005 Ngày cấp: 1/1/2020")]),
    ("cccd", [(100, spread(100, "không có"))], []),
    ("cccd", [(100, [*spread(100, "Số CCCD:"), (250, "~~", 10), *spread(400, "Ngày sinh: 1/1/2000"), (990, "x", 10)])], [("", (184, 100, 216, 20), 0.0, "Số CCCD: ~~")]),
    ("cccd", [beside("Nơi cấp: đâu")], [("", (184, 100, 216, 20), 0.0, "Số CCCD: Nơi cấp: đâu")]),
    ("cccd", [(100, [*spread(100, "Số CCCD:"), (990, "x", 10)])], [("", (184, 100, 300, 20), 0.0, "Số CCCD: x")]),
    ("cccd", [(100, spread(100, "Số CCCD:"))], [("", (184, 100, 54, 20), 0.0, "Số CCCD:")]),
    ("phi", [(100, spread(100, "Phí dịch vụ")), (140, spread(100, "trả một lần")), (180, spread(150, "là 1.500.000 đồng"))], [("1.500.000", (180, 180, 90, 20), 0.95, "Phí dịch vụ trả một lần là 1.500.000 đồng")]),
    ("tk", [(91, [(400, "0123456789")]), (100, spread(100, "Số tài khoản"))], [("0123456789", (400, 91, 100, 20), 0.95, "Số tài khoản 0123456789")]),  # cut into a line of its own above its label
    ("tk", [(100, spread(100, "Số tài khoản: " + "chữ " * 60))], [("", None, 0.0, ("Số tài khoản: " + "chữ " * 60)[:120])]),
    ("mst", [(100, spread(100, "MST TNCN: chưa có Số CCCD: 001203004005"))], [("001203004005", (370, 100, 120, 20), 0.95, "MST TNCN: chưa có")]),
]


def test_fields_with_boxes(spark):
    lines = L.page_lines(run(spark, *(page(i, *lines) for i, (_, lines, _) in enumerate(FIELDS))), ["page"])
    for field in sorted({f for f, _, _ in FIELDS}):
        got: dict[int, list] = {i: [] for i, (f, _, _) in enumerate(FIELDS) if f == field}
        for r in L.field_hits(lines, field).orderBy("page", "line_no").collect():
            if r.page in got:
                got[r.page].append((r.value, tuple(r.box) if FIELDS[r.page][2][0][1] else None, round(r.confidence, 2), r.near))
        assert got == {i: FIELDS[i][2] for i in got}


def test_lines_and_rows(spark):
    got = run(spark, page(1, (100, [(50, "b"), (10, "a")]), (107, [(90, "c")]), (115, [(130, "d")]), (300, [(10, "e")]))).first()
    assert [[w.text for w in line] for line in got.lines] == [["a", "b", "c"], ["d"], ["e"]]
    assert [[w.text for w in row] for row in got.rows] == [["a", "b", "c", "d"], ["a", "b", "c", "d"], ["e"]] and got.width == 140


def test_words_without_height_are_on_no_row(spark):
    flat = spark.createDataFrame([(1, 0, "a", 0, 10, 10, 0, 90)], WORDS)
    assert L.page_rows(flat, ["page"]).first().rows == [[]]
    assert L.find_names(L.page_rows(flat.limit(0), ["page"]), ["page"]).count() == 0


def test_parties_of_boxes_by_running_pass_and_by_page(spark):
    rng = random.Random(4)
    spots, walls = [], []
    for p in range(6):
        for i in range(rng.choice([0, 1, 7, 200])):
            top = rng.randrange(0, 400)
            walls.append((p, i, top, top + rng.choice([0, 5, 40, 300]), rng.randrange(0, 100)))
        spots += [(p, i, rng.randrange(0, 100), rng.randrange(0, 500), rng.randrange(0, 30), rng.choice([0, 1, 2, 9])) for i in range(80)]
    boxes = spark.createDataFrame(spots, "page int, id int, x int, y int, width int, height int")
    blocks_ = spark.createDataFrame(walls, "page int, n int, top int, bottom int, gutter int")
    want = {}
    for p, i, x, y, w, h in spots:
        first = next((b for b in sorted(b for b in walls if b[0] == p) and sorted((b for b in walls if b[0] == p), key=lambda b: (b[2], b[1])) if b[2] <= y + h / 2 <= b[3]), None)
        want[p, i] = None if first is None else "a" if x + w <= first[4] else "b" if x >= first[4] else "straddle"
    got = L.party_boxes(boxes, blocks_, ["page"], "n")
    assert got.columns == [*boxes.columns, "party"] and {(r.page, r.id): r.party for r in got.collect()} == want
    held = blocks_.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("top", "n", "bottom", "gutter"))).alias("blocks"))
    same = boxes.join(held, "page", "left").withColumn("blocks", F.coalesce("blocks", F.array().cast("array<struct<top:int,n:int,bottom:int,gutter:int>>")))
    assert {(r.page, r.id): r.party for r in same.select("page", "id", L.party_of(F.struct("x", "y", "width", "height"), F.col("blocks")).alias("party")).collect()} == want


def test_long_pages_are_cut_into_lines(spark):
    rng = random.Random(1)
    words = [(1, i, "w", rng.randrange(900), rng.randrange(3000), 10, 10, 90) for i in range(600)]
    got = spark.createDataFrame(words, WORDS).groupBy("page").agg(segments.group_lines(F.sort_array(F.collect_list(F.struct("at", "x", "y")))).alias("g")).first().g
    want: list[list] = []
    for w in sorted(words, key=lambda w: (w[4], w[1])):
        if want and w[4] - want[-1][0][4] <= 8:
            want[-1].append(w)
        else:
            want.append([w])
    assert [[w["at"] for w in line] for line in got] == [[w[1] for w in sorted(line, key=lambda w: w[3])] for line in want]


def test_quotes_with_boxes(spark):
    from proofsheet.operators import quotes

    clause = "bên A trả phí 1.500.000 đồng cho bên B trong vòng mười ngày"
    pages = [("d", 0, f"mở đầu {clause} - hết"), ("d", 1, f"{clause} lần nữa"), ("d", 2, clause.replace("mười", "muời bốn")), ("e", 0, clause.replace("1.500.000", "1.600.000")), ("e", 1, "trang khác hẳn " * 9), ("f", 0, "")]
    asked = [
        ("d", 1, clause, 1), ("d", 2, clause, None), ("d", 3, clause, 9), ("d", 4, clause.upper() + " !", 0),
        ("d", 5, clause[1:], 1),  # begins within a word
        ("d", 6, "bên A trả phí 500.000 đồng cho bên B trong vòng mười ngày", 1),  # within a number: near, but other digits
        ("d", 7, clause.replace("vòng", "vong vong"), 2), ("d", 8, "một hai ba - - - - - -", 0), ("d", 9, "quá dài " * 31, 0), ("d", 10, None, 0),
        ("e", 11, clause, 0), ("f", 12, clause, 0), ("g", 13, clause, 0),
    ]
    told = spark.createDataFrame(pages, "doc string, page int, text string")
    told = told.withColumn("words", F.transform(F.split("text", " "), lambda w, i: F.struct(w.alias("text"), (i * 10).alias("x"), F.lit(5).alias("y"), F.lit(8).alias("w"), F.lit(2).alias("h"))))
    got = quotes.place_quotes(spark.createDataFrame(asked, "doc string, id int, quote string, claimed int"), told, "doc", "id", "quote", "claimed", "page", "words")
    got = {r.id: (r.page, r.box.x, r.box.width, r.exact, round(r.ratio, 2)) for r in got.collect()}
    assert {i: got.get(i) for i in (1, 2, 3, 4)} == {1: (1, 0, 128, True, 1.0), 2: (0, 20, 128, True, 1.0), 3: (0, 20, 128, True, 1.0), 4: (0, 20, 128, True, 1.0)}
    assert got[5][:1] == (1,) and not got[5][3] and got[5][4] > 0.97
    assert 6 not in got and got[7][3] is False and got[7][0] == 0
    assert not {8, 9, 10, 11, 12, 13} & set(got)
