"""Registered queries on printed pages: blocks, names, fields with boxes, parties, quotes with boxes, totals of lines.

Pages are drawn from the tables: a customer is a page, its orders are rows of words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofsheet.functions.session import plain_unions
from proofsheet.functions import text as T
from proofsheet.operators import assignments, card_words, cards, layout, quotes, segments, totals
from proofsheet.plans.catalog import FOLD, query, table
from proofsheet.sources import reader_json

# Every customer's page: a title row, in two of three a heading of two columns, then a row for each order: words on the
# left, and on the right unless o_orderkey % 4 = 0; the left reaches further where o_orderkey % 11 = 0.
HEADING = "BÊN CUNG ỨNG DỊCH VỤ"


def drawn(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A word a row from rows with y and parts (array of x, text): words of a part are 10 wide a letter, 10 apart."""
    w = F.posexplode(F.filter(F.split("part.text", " "), lambda t: t != ""))
    parts = rows.select(*keys, "y", F.posexplode("parts").alias("p", "part"))
    words = parts.select(*keys, "y", "p", "part", w.alias("i", "text"))
    before = F.aggregate(F.slice(F.split("part.text", " "), F.lit(1), F.col("i")), F.lit(0), lambda n, t: n + F.length(t) * 10 + 10)
    return words.select(*keys, (F.col("y") * 1000 + F.col("p") * 100 + F.col("i")).cast("int").alias("at"), "text", (F.col("part.x") + before).cast("int").alias("x"), F.col("y").cast("int").alias("y"), (F.length("text") * 10).alias("w"), F.lit(20).alias("h"), F.lit(95).alias("conf"))


def _part(x, text):
    return F.struct((F.lit(x) if isinstance(x, int) else x).cast("int").alias("x"), (F.lit(text) if isinstance(text, str) else text).alias("text"))


def customer_pages(spark, sf_dir) -> DataFrame:
    """page_rows of the customers' pages."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), k, F.row_number().over(Window.partitionBy("o_custkey").orderBy(k)).alias("n"))
    named = F.when(k % 3 == 0, "Họ và tên: ").otherwise("Ghi ")
    left = _part(100, F.concat(named, F.when(k % 11 == 0, "một dòng chữ dài che kín tất cả khoảng trống ở giữa").when(k % 7 == 0, "một cột khá rộng bên trái").otherwise("Lê An")))
    right = _part(700, F.concat(named, F.when(k % 5 == 0, "12").otherwise("Trần Thị Bình")))
    body = o.select("c_custkey", (F.col("n") * 40 + 160).alias("y"), F.when(k % 4 == 0, F.array(left)).otherwise(F.array(left, right)).alias("parts"))
    title = c.select("c_custkey", F.lit(100).alias("y"), F.array(_part(300, "BIÊN BẢN")).alias("parts"))
    heads = c.filter("c_custkey % 3 > 0").select("c_custkey", F.lit(160).alias("y"), F.array(_part(100, "VNX"), _part(700, HEADING)).alias("parts"))
    return layout.page_rows(drawn(plain_unions(title).unionByName(heads).unionByName(body), ["c_custkey"]), ["c_custkey"])


#: The rows below a heading with where their left part ends, and the walk down them: a band narrows to the left parts' ends.
BLOCKS_SQL = """r AS (SELECT o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
 s AS (SELECT c, n, k, k % 4 <> 0 AS two, CASE WHEN k % 3 = 0 THEN 'Họ và tên: ' ELSE 'Ghi ' END || CASE WHEN k % 11 = 0 THEN 'một dòng chữ dài che kín tất cả khoảng trống ở giữa' WHEN k % 7 = 0 THEN 'một cột khá rộng bên trái' ELSE 'Lê An' END AS t FROM r),
 e AS (SELECT *, 100 + 10 * length(t) AS stop FROM s),
 g AS (SELECT c, CAST(round_even(0.045::DOUBLE * greatest(900, max(CASE WHEN two THEN 700 + 10 * length(CASE WHEN k % 3 = 0 THEN 'Họ và tên: ' ELSE 'Ghi ' END || CASE WHEN k % 5 = 0 THEN '12' ELSE 'Trần Thị Bình' END) ELSE stop END), max(stop)), 0) AS INTEGER) AS least FROM e GROUP BY c),
 w AS (SELECT c, 0::BIGINT AS n, 130 AS lo, 180::BIGINT AS bottom, 0 AS m, 0 AS one, true AS open FROM g WHERE c % 3 > 0
  UNION ALL SELECT w.c, e.n, CASE WHEN w.open AND fits AND two THEN greatest(w.lo, stop) ELSE w.lo END, CASE WHEN w.open AND fits AND two THEN 180 + 40 * e.n ELSE w.bottom END, CASE WHEN w.open AND fits AND two THEN m + 1 ELSE m END,
   CASE WHEN fits AND two THEN 0 ELSE one + 1 END, w.open AND fits AND (two OR one < 1) FROM w JOIN (SELECT e.*, g.least FROM e JOIN g USING (c)) e ON e.c = w.c AND e.n = w.n + 1 CROSS JOIN LATERAL (SELECT 700 - greatest(w.lo, e.stop) >= e.least AS fits)),
 b AS (SELECT c, arg_max(lo, n) AS lo, arg_max(bottom, n) AS bottom, arg_max(m, n) AS m FROM w GROUP BY c HAVING arg_max(m, n) >= 2)"""


@query(f"""WITH RECURSIVE {BLOCKS_SQL} SELECT c AS c_custkey, 160 AS top, CAST(bottom AS INTEGER) AS bottom, CAST((lo + 700) // 2 AS INTEGER) AS gutter FROM b""")
def column_blocks(spark, sf_dir):
    pages = customer_pages(spark, sf_dir)
    return pages.select("c_custkey", F.inline(layout.column_blocks(F.col("rows"), F.col("width"))))


@query(f"""WITH RECURSIVE {BLOCKS_SQL}, i AS (SELECT e.*, coalesce(170 + 40 * n <= bottom, false) AS inside FROM e LEFT JOIN b USING (c)),
 v AS (SELECT c, '' AS value FROM i WHERE k % 3 = 0 AND (two OR k % 7 = 0 OR k % 11 = 0) UNION ALL SELECT c, 'Trần Thị Bình' FROM i WHERE k % 3 = 0 AND two AND inside AND k % 5 <> 0
  UNION ALL SELECT c, 'Lê An' FROM i WHERE k % 3 = 0 AND NOT two AND NOT inside AND k % 7 <> 0 AND k % 11 <> 0
  UNION ALL SELECT c_custkey, CASE WHEN i.k % 3 <> 0 AND NOT two AND i.k % 7 <> 0 AND i.k % 11 <> 0 AND NOT inside THEN 'Ghi Lê An' ELSE '' END FROM customer LEFT JOIN i ON i.c = c_custkey AND n = 1 WHERE c_custkey % 3 > 0),
 d AS (SELECT DISTINCT c, value, CASE WHEN value IN ('Trần Thị Bình', 'Ghi Lê An') THEN 1 ELSE 0 END AS rank, CASE WHEN value = '' THEN 0.0 ELSE 0.95 END::DOUBLE AS confidence FROM v)
 SELECT c AS c_custkey, value, rank, confidence, CAST(row_number() OVER (PARTITION BY c ORDER BY rank DESC, confidence DESC) AS INTEGER) AS place FROM d""")
def found_names(spark, sf_dir):
    return layout.find_names(customer_pages(spark, sf_dir), ["c_custkey"]).select("c_custkey", "value", "rank", "confidence", "place")


@query("""SELECT o_orderkey, CASE WHEN m IN (2, 4) THEN '' ELSE a END AS value, CASE m WHEN 0 THEN 300 WHEN 1 THEN 100 + o_orderkey % 50 WHEN 3 THEN 300 ELSE 234 END AS x, CASE m WHEN 1 THEN 140 WHEN 3 THEN 91 ELSE 100 END AS y,
 CASE m WHEN 2 THEN 266 WHEN 4 THEN CAST(round_even(0.3::DOUBLE * (750 + o_orderkey % 97), 0) AS INTEGER) ELSE 90 END AS width, CASE WHEN m IN (2, 4) THEN 0.0 ELSE 0.95 END::DOUBLE AS confidence, 'Số tài khoản:' || CASE m WHEN 2 THEN '' WHEN 4 THEN ' trang' ELSE ' ' || a || CASE m WHEN 3 THEN ' trang' ELSE '' END END AS near
 FROM (SELECT o_orderkey, o_orderkey % 5 AS m, lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS a FROM orders)""")
def fields_with_boxes(spark, sf_dir):
    """Each order a page with one account label: its value on the line, below, nowhere (twice), or beside it in a line of its own."""
    k, none = F.col("o_orderkey"), F.array().cast("array<struct<y:int,parts:array<struct<x:int,text:string>>>>")
    a, m = F.lpad(k.cast("string"), 9, "0"), k % 5
    row = lambda y, *parts: F.struct(F.lit(y).cast("int").alias("y"), F.array(*parts).alias("parts"))
    label, other, foot = _part(100, "Số tài khoản:"), _part(500, "Ngày sinh: 1/2/1999"), row(400, _part(700 + k % 97, "trang"))
    lines = F.when(m == 0, F.array(row(100, label, _part(300, a), other), foot)).when(m == 1, F.array(row(100, label), row(140, _part(100 + k % 50, a)), foot))
    lines = lines.when(m == 2, F.array(row(100, label, other), foot)).when(m == 3, F.array(row(91, _part(300, a)), row(100, label), foot)).otherwise(F.array(row(100, label), foot))
    pages = layout.page_rows(drawn(table(spark, sf_dir, "orders").select("o_orderkey", F.inline(F.coalesce(lines, none))), ["o_orderkey"]), ["o_orderkey"])
    return layout.field_hits(layout.page_lines(pages, ["o_orderkey"]), "tk").select("o_orderkey", "value", "box.x", "box.y", "box.width", "confidence", "near")


@query("""WITH x AS (SELECT row_number() OVER () AS id, l_orderkey, l_linenumber, CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_suppkey % 20 END AS page, l_partkey % 900 AS x, l_orderkey * 7 % 5000 AS y, CAST(l_quantity AS BIGINT) AS width, l_linenumber AS height FROM lineitem),
 b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey % 20 END AS page, o_orderkey * 13 % 5000 AS top, o_orderkey * 13 % 5000 + o_custkey % 40 AS bottom, o_custkey % 900 AS gutter FROM orders),
 j AS (SELECT id, arg_min(gutter, top * 1000000000 + o_orderkey) AS g FROM x JOIN b ON b.page = x.page AND y + height / 2.0 BETWEEN top AND bottom GROUP BY id)
 SELECT l_orderkey, l_linenumber, CASE WHEN x.x + x.width <= g THEN 'a' WHEN x.x >= g THEN 'b' WHEN g IS NOT NULL THEN 'straddle' END AS party FROM x LEFT JOIN j USING (id)""")
def party_boxes(spark, sf_dir):
    """Line items as boxes and orders as blocks on twenty pages, a third of both on one of them."""
    page = lambda k, other: F.when(F.col(k) % 3 == 0, 0).otherwise(F.col(other) % 20).alias("page")
    boxes = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", page("l_orderkey", "l_suppkey"), (F.col("l_partkey") % 900).alias("x"), (F.col("l_orderkey") * 7 % 5000).alias("y"), F.col("l_quantity").cast("long").alias("width"), F.col("l_linenumber").alias("height"))
    top = F.col("o_orderkey") * 13 % 5000
    blocks = table(spark, sf_dir, "orders").select("o_orderkey", page("o_orderkey", "o_custkey"), top.alias("top"), (top + F.col("o_custkey") % 40).alias("bottom"), (F.col("o_custkey") % 900).alias("gutter"))
    return layout.party_boxes(boxes, blocks, ["page"], "o_orderkey").select("l_orderkey", "l_linenumber", "party")


FOLD_WORD = "trim(regexp_replace(regexp_replace(" + FOLD + r", '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"""WITH t AS (SELECT conv_id, turn, string_split_regex(coalesce(text, ''), '\\s+') AS w FROM conversations),
 f AS (SELECT conv_id, turn, list_filter(list_transform(w, lambda x, i: {{'f': {FOLD_WORD.format('x')}, 'x': 10 * (i - 1)}}), lambda x: x.f <> '') AS f FROM t),
 p AS (SELECT conv_id, turn, f, list_transform(f, lambda x: x.f) AS l, array_to_string(l, ' ') AS text, list_transform(range(1, len(f) + 1), lambda e: length(array_to_string(l[1:e], ' '))) AS stops FROM f),
 q AS (SELECT conv_id, turn, array_to_string(l[1:12], ' ') AS q, CASE WHEN conv_id % 16 = 1 THEN true WHEN conv_id % 16 = 2 THEN NULL ELSE false END AS odd FROM p WHERE len(string_split(array_to_string(l[1:12], ' '), ' ')) >= 8 AND len(f) >= 8 AND length(l[1]) > 0),
 h AS (SELECT q.conv_id, q.turn, p.turn AS page, q.q, q.odd, p.f, list_filter(range(1, len(p.f) + 1), lambda s: substring(p.text, p.stops[s] - length(p.l[s]) + 1, length(q.q)) = q.q AND list_contains(p.stops, p.stops[s] - length(p.l[s]) + length(q.q)))[1] AS s, p.stops, p.l FROM q JOIN p ON p.conv_id = q.conv_id AND contains(p.text, q.q) WHERE odd IS NOT NULL),
 r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY page <> turn + 1, page) AS r FROM h WHERE s IS NOT NULL)
 SELECT conv_id, turn, page, NOT odd AS exact, CASE WHEN odd THEN (length(q) - 1) / length(q) ELSE 1.0 END AS ratio, CAST(f[s].x AS INTEGER) AS x, CAST(f[list_position(stops, stops[s] - length(l[s]) + length(q))].x + 8 - f[s].x AS INTEGER) AS width FROM r WHERE r = 1""")
def quote_boxes(spark, sf_dir):
    """The first twelve words of each turn, claimed to stand in the next one, looked for in its conversation; of every
    sixteenth conversation with a strange letter at the front (near hits), of every other sixteenth with a digit (none)."""
    word = lambda w, i: F.struct(w.alias("text"), (i * 10).alias("x"), F.lit(0).alias("y"), F.lit(8).alias("w"), F.lit(4).alias("h"))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.transform(F.split(T.text_of(F.col("text")), r"\s+"), word).alias("words"))
    told = F.filter(T.fold_each(F.transform("words", lambda w: w["text"])), lambda x: x != "")
    front = F.when(F.col("conv_id") % 16 == 1, "ж").when(F.col("conv_id") % 16 == 2, "7")
    quote = lambda said: F.when(front.isNotNull(), F.concat(front, F.substring(said, 2, 1 << 30))).otherwise(said)
    asked = layout.let(told, lambda t: F.when(F.size(t) >= 8, layout.let(F.array_join(F.slice(t, 1, 12), " "), quote)))
    own = c.select("conv_id", F.struct("conv_id", "turn").alias("id"), asked.alias("quote"), (F.col("turn") + 1).alias("claimed"))
    found = quotes.place_quotes(own, c, "conv_id", "id", "quote", "claimed", "turn", "words")
    return found.select("id.conv_id", "id.turn", "page", "exact", "ratio", "box.x", "box.width")


#: Orders as pages with a total of 1 to 9 million, by o_orderkey % 10: both agree, they differ, digits, words, neither, wrapped over two lines, damaged, past repair, no label, a date behind.
NUMBERS = ("một", "hai", "ba", "bốn", "năm", "sáu", "bảy", "tám", "chín")


@query("""SELECT o_orderkey, d AS digits, w AS words, CASE WHEN reason LIKE '%disagree' THEN NULL ELSE coalesce(d, w) END AS amount, reason, m = 6 AS repaired, CASE WHEN m IN (0, 1, 2, 5, 6, 7, 9) THEN 600 END AS x, CASE WHEN m = 4 THEN 0.0 ELSE 95.0 END::DOUBLE AS confidence FROM
 (SELECT *, CASE WHEN m IN (1, 7) THEN 'digits-and-words-disagree' WHEN m = 2 THEN 'digits-only' WHEN m = 3 THEN 'words-only' WHEN m = 4 THEN 'no-amount-on-the-line' ELSE 'digits-and-words-agree' END AS reason FROM
 (SELECT o_orderkey, o_orderkey % 10 AS m, (o_orderkey // 10 % 9 + 1) * 1000000 AS n, CASE WHEN m IN (3, 4, 7) THEN NULL WHEN m = 1 THEN n + 1000 ELSE n END AS d, CASE WHEN m IN (2, 4) THEN NULL ELSE n END AS w FROM orders) WHERE m <> 8)""")
def listing_reads(spark, sf_dir):
    k = F.col("o_orderkey")
    m, n = k % 10, F.floor(k / 10).cast("long") % 9
    row = lambda y, *parts: F.struct(F.lit(y).cast("int").alias("y"), F.array(*parts).alias("parts"))
    label, money = _part(100, "Tổng giá trị hàng hóa, dịch vụ mua vào:"), lambda tail: _part(600, F.concat((n + 1).cast("string"), F.lit(tail)))
    said = F.concat(F.get(F.array(*map(F.lit, NUMBERS)), n.cast("int")), F.lit(" triệu đồng"))
    opened = F.concat(F.lit("(Số tiền bằng chữ : "), said)
    closed = _part(800, F.concat(opened, F.lit(").")))
    pages = {
        0: [row(290, label, money(".000.000VNĐ"), closed)], 1: [row(290, label, money(".001.000"), closed)], 2: [row(290, label, money(".000.000"))], 3: [row(290, label, closed)], 4: [row(290, label)],
        5: [row(290, label, money(".000.000"), _part(800, "(Số tiền bằng chữ :")), row(320, _part(100, "-")), row(350, _part(100, F.concat(said, F.lit(").")))), row(390, _part(100, "năm nghìn"))],
        6: [row(290, label, money(".OO0.000"), closed)], 7: [row(290, label, money(".0x0.000"), closed)], 8: [row(290, _part(100, "Tên người bán"), money(".000.000"), closed)],
        9: [row(290, label, money(".000.000"), _part(800, F.concat(opened, F.lit("). Ngày 26 tháng 07 năm 2026"))))],
    }
    lines = F.coalesce(*(F.when(m == i, F.array(*p)) for i, p in pages.items()))
    drawn_pages = layout.page_rows(drawn(table(spark, sf_dir, "orders").select("o_orderkey", F.inline(lines)), ["o_orderkey"]), ["o_orderkey"], totals.TOLERANCE)
    return totals.total_reads(drawn_pages, ["o_orderkey"]).select("o_orderkey", "digits", "words", "amount", "reason", "repaired", "box.x", "confidence")


@query("""WITH l AS (SELECT o_custkey, CAST(3 * row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT) AS row, o_orderkey % 5 * 10 AS height FROM orders), c AS (SELECT DISTINCT o_custkey FROM orders),
 r AS (SELECT c.o_custkey, g.row, coalesce(height, 15) AS height FROM c CROSS JOIN range(250) g(row) LEFT JOIN l ON l.o_custkey = c.o_custkey AND l.row = g.row), t AS (SELECT *, sum(height) OVER (PARTITION BY o_custkey ORDER BY row) - height AS top FROM r)
 SELECT o_orderkey, greatest(coalesce(max(row), 0), 0) AS at_row FROM (SELECT o_orderkey, o_custkey, o_orderkey % 997 - 20 AS spot FROM orders) p LEFT JOIN t ON t.o_custkey = p.o_custkey AND top <= spot GROUP BY o_orderkey""")
def rows_of_points(spark, sf_dir):
    """Customers as sheets whose every third row has a height of its own, their orders as points on them."""
    o = table(spark, sf_dir, "orders")
    rows = o.select("o_custkey", (3 * F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("row"), (F.col("o_orderkey") % 5 * 10).alias("height"))
    return cards.row_at(o.select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 997 - 20).alias("at")), rows, ["o_custkey"], "at", 15).select("o_orderkey", "at_row")


# ---------------------------------------------------------------- cards

@query("""SELECT c_custkey, CASE WHEN m IN (0, 1, 5) THEN 'front' WHEN m IN (2, 3) THEN 'back' ELSE 'unknown' END AS side, CASE m WHEN 0 THEN 0.9 WHEN 1 THEN 0.8 WHEN 2 THEN 0.9 WHEN 3 THEN 0.7 WHEN 5 THEN 0.9 ELSE 0.0 END::DOUBLE AS confidence,
 CASE m WHEN 0 THEN 194 WHEN 1 THEN 94 WHEN 5 THEN 94 WHEN 4 THEN 194 END AS x, CASE m WHEN 0 THEN 94 WHEN 1 THEN 134 WHEN 4 THEN 94 WHEN 5 THEN 174 END AS y, CASE WHEN m IN (0, 4) THEN least(132, 300 - 194) WHEN m IN (1, 5) THEN 132 END AS width,
 CASE WHEN m IN (0, 4, 5) THEN name ELSE '' END AS name FROM (SELECT c_custkey, c_custkey % 7 AS m, 'Lê ' || CASE WHEN c_nationkey % 2 = 0 THEN 'An' ELSE 'Bình' END AS name FROM customer)""")
def card_readings(spark, sf_dir):
    """Customers as cards of 300 by 300: number beside or below its label or alone, backs by phrases or by zone, both at once, nothing."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    name = F.concat(F.lit("Lê "), F.when(F.col("c_nationkey") % 2 == 0, "An").otherwise("Bình"))
    number = F.lpad(k.cast("string"), 12, "0")
    row = lambda y, conf, *parts: F.struct(F.lit(y).cast("int").alias("y"), F.array(*parts).alias("parts"), F.lit(conf).alias("sure"))
    told = F.concat(F.lit("Họ và tên: "), name)
    fronts = [row(60, 95, _part(100, "CĂN CƯỚC CÔNG DÂN")), row(100, 90, _part(100, "Số:"), _part(200, number)), row(200, 95, _part(100, told))]
    kinds = {
        0: fronts,
        1: [row(60, 80, _part(100, "Ngày sinh")), row(100, 90, _part(100, "Số")), row(140, 90, _part(100, number)), row(180, 40, _part(100, name))],
        2: [row(60, 90, _part(100, "Ngày cấp")), row(100, 95, _part(100, "Bộ Công an"))],
        3: [row(200, 70, _part(10, "IDVNM0123456789012345<<")), row(240, 85, _part(10, "LE<<AN<<<<<<<<<<<<<<<<<"))],
        4: [*fronts, row(240, 90, _part(100, "Ngày cấp")), row(270, 95, _part(100, "Bộ Công an"))],
        5: [row(100, 95, _part(100, "Họ và tên")), row(130, 95, _part(90, name)), row(180, 90, _part(100, number))],
        6: [row(60, 95, _part(100, "không rõ"))],
    }
    lines = F.coalesce(*(F.when(k % 7 == i, F.array(*rows)) for i, rows in kinds.items()))
    rows = c.select("c_custkey", F.inline(lines))
    words = drawn(rows, ["c_custkey", "sure"]).withColumn("conf", F.col("sure"))
    read = words.groupBy("c_custkey").agg(F.array_sort(F.collect_list(F.struct(*layout.WORD))).alias("words")).withColumn("lines", segments.group_lines(F.col("words")))
    got = read.select("c_custkey", card_words.card_side(F.col("words"), F.col("lines")).alias("s"), card_words.number_box(F.col("words"), F.col("lines"), F.lit(300), F.lit(300)).alias("b"), card_words.card_name(F.col("lines")).alias("n"))
    return got.select("c_custkey", "s.side", "s.confidence", "b.x", "b.y", "b.width", "n.name")


EVENTS_SQL = """SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, CASE WHEN event_id % 11 = 0 THEN 9 ELSE event_id % 4 END AS card, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 8 ELSE CAST(floor(value) AS BIGINT) % 3 END AS packet FROM events"""


@query(f"""WITH RECURSIVE e AS ({EVENTS_SQL}),
 w AS (SELECT user_id, 0::BIGINT AS n, [0::BIGINT, NULL, NULL, NULL] AS held, NULL::VARCHAR AS refused, NULL::BIGINT AS event_id, NULL::BIGINT AS attached FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL SELECT e.user_id, e.n, CASE WHEN why IS NULL THEN list_transform(w.held, lambda p, i: CASE WHEN i - 1 = e.card THEN e.packet ELSE p END) ELSE w.held END, why, e.event_id, CASE WHEN e.card = 9 THEN NULL WHEN why IS NULL THEN e.packet ELSE w.held[e.card + 1] END
   FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1 CROSS JOIN LATERAL (SELECT CASE WHEN e.card = 9 THEN 'unknown-card' WHEN e.packet IS NULL THEN NULL WHEN e.packet > 2 THEN 'unknown-packet'
    WHEN len(list_filter(w.held, lambda p, i: p = e.packet AND i - 1 <> e.card)) > 0 THEN 'packet-already-has-card' WHEN e.card = 3 THEN 'card-has-no-image' END AS why))
 SELECT user_id, event_id, refused, attached FROM w WHERE n > 0""")
def hand_assignments(spark, sf_dir):
    """Users as cases with cards 0 to 3 (0 attached to packet 0, 3 without images) and packets 0 to 2; their events assign and detach."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    log = e.select("user_id", "event_id", F.when(k % 11 == 0, 9).otherwise(k % 4).cast("long").alias("card_id"), F.when(k % 5 == 0, None).when(k % 7 == 0, 8).otherwise(F.floor("value").cast("long") % 3).alias("packet"))
    users = e.select("user_id").distinct()
    owned = users.select("user_id", F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("card_id"), F.lit(0 if i == 0 else None).cast("long").alias("packet"), F.lit(i < 3).alias("has_image")) for i in range(4)))).alias("c")).select("user_id", "c.*")
    have = users.select("user_id", F.explode(F.array(*(F.lit(i).cast("long") for i in range(3)))).alias("packet"))
    return assignments.decided(log, owned, have, "user_id", "event_id").select("user_id", "event_id", "refused", "attached")


# ---------------------------------------------------------------- replies of page readers

@query("""SELECT o_orderkey, CAST(i AS INTEGER) AS item, CASE i WHEN 0 THEN 'T' || o_orderkey ELSE o_orderstatus END AS text, CAST(o_orderkey % 90 AS INTEGER) AS x, 5 AS y, CASE i WHEN 0 THEN 20 ELSE 30 END AS w, CASE WHEN i = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 50.0 ELSE 25.0 END ELSE 100.0 END::DOUBLE AS conf
 FROM orders, range(2) t(i) WHERE o_orderkey % 6 < 4 AND NOT (i = 1 AND o_orderkey % 3 = 1)""")
def reader_words(spark, sf_dir):
    """Orders as replies in two shapes; every sixth is cut off, every sixth has no documents; a third of second items has no box."""
    k = F.col("o_orderkey")
    x = (k % 90).cast("string")
    even = F.concat(F.lit('{"extracted_value": "T'), k.cast("string"), F.lit('", "extracted_prob": 0.5, "coordinates": ['), x, F.lit(", 5, "), (k % 90 + 20).cast("string"), F.lit(", 15]}"))
    odd = F.concat(F.lit('{"text": " T'), k.cast("string"), F.lit(' ", "confidence": 0.25, "coordinates": ["'), x, F.lit('", 5, '), (k % 90 + 20).cast("string"), F.lit(", 15]}"))
    second = F.concat(F.lit('{"extracted_value": null, "text": "'), F.col("o_orderstatus"), F.when(k % 3 == 1, '", "coordinates": [1, 2]}').otherwise(F.concat(F.lit('", "coordinates": ['), x, F.lit(", 5, "), (k % 90 + 30).cast("string"), F.lit(", 9]}"))))
    whole = F.concat(F.lit('{"data": {"documents": [{"ocr_data": [{"value": ['), F.when(k % 2 == 0, even).otherwise(odd), F.lit(", 7, "), second, F.lit("]}]}]}}"))
    reply = F.when(k % 6 == 4, F.substring(whole, 1, 40)).when(k % 6 == 5, '{"data": {"documents": null}}').otherwise(whole)
    words = reader_json.reader_words(table(spark, sf_dir, "orders").withColumn("reply", reply), ["o_orderkey"], "reply")
    return words.select("o_orderkey", F.when(F.col("at.i_at") == 0, 0).otherwise(1).alias("item"), "text", "x", "y", "w", "conf")


@query("""WITH r AS (SELECT c_custkey AS row, lpad(CAST(c_custkey % 1000 AS VARCHAR), 12, '0') AS id, 'ten ' || CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 300 ELSE c_custkey END AS who FROM customer),
 i AS (SELECT id, count(*) AS n, min(row) AS row FROM r GROUP BY id), w AS (SELECT who, count(*) AS n, min(row) AS row FROM r GROUP BY who),
 k AS (SELECT c_custkey AS k, CASE WHEN k % 6 = 0 THEN '' WHEN k % 17 = 0 THEN '12345' ELSE lpad(CAST(k + CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END AS VARCHAR), 12, '0') END AS id, k % 4 > 0 AS located, k % 5 > 0 AS sure,
  CASE WHEN k % 7 > 0 THEN 'ten ' || CASE WHEN (k + shift) % 3 = 0 THEN (k + shift) % 300 ELSE k + shift END END AS who, k % 13 > 0 AS front, k % 19 = 0 AS blocked, k % 23 = 0 AS noted FROM (SELECT *, CASE WHEN c_custkey % 9 = 0 THEN 1 ELSE 0 END AS shift FROM customer)),
 m AS (SELECT k.*, coalesce(i.n, 0) AS ids, coalesce(w.n, 0) AS whos, CASE WHEN located AND i.n = 1 THEN i.row END AS id_row, CASE WHEN w.n = 1 THEN w.row END AS name_row FROM k LEFT JOIN i ON i.id = k.id LEFT JOIN w ON w.who = k.who),
 n AS (SELECT m.*, coalesce((SELECT count(*) FROM i WHERE i.row = name_row AND i.n = 1), 0) > 0 AS sound, coalesce((SELECT w.n > 1 FROM r JOIN w USING (who) WHERE r.row = id_row), false) AS namesake FROM m),
 c AS (SELECT DISTINCT k, t FROM (SELECT k, unnest([id_row, CASE WHEN sound THEN name_row END]) AS t FROM n WHERE front AND NOT blocked) WHERE t IS NOT NULL), d AS (SELECT t FROM c GROUP BY t HAVING count(*) > 1),
 v AS (SELECT *, CASE WHEN NOT front THEN 'no-front' WHEN blocked THEN 'layout-conflict'
  WHEN NOT located THEN CASE WHEN whos > 1 THEN 'duplicate-name' WHEN name_row IN (FROM d) THEN 'competing-candidate' ELSE 'no-number-region' END
  WHEN id = '12345' THEN 'non-12-digit-cccd' WHEN ids > 1 THEN 'duplicate-cccd' WHEN whos > 1 OR namesake THEN 'duplicate-name' WHEN id_row <> name_row THEN 'conflicting-identity'
  WHEN k IN (SELECT k FROM c JOIN d USING (t)) THEN 'competing-candidate' WHEN id_row IS NOT NULL AND sure THEN '' WHEN sound THEN '' WHEN id = '' THEN 'unreadable-identity' WHEN id_row IS NOT NULL THEN 'low-cccd-confidence' ELSE 'no-exact-roster-match' END AS why FROM n)
 SELECT k AS card_id, CASE WHEN why IN ('layout-conflict', 'duplicate-name', 'competing-candidate', 'duplicate-cccd', 'conflicting-identity') THEN 'conflict' WHEN why = '' AND id_row IS NOT NULL AND sure THEN 'exact' WHEN why = '' OR (why = 'no-number-region' AND sound) THEN 'suggested' ELSE 'manual' END AS state,
 CASE WHEN why = '' AND id_row IS NOT NULL AND sure THEN id_row WHEN why = '' OR (why = 'no-number-region' AND sound) THEN name_row END AS matched_row,
 array_to_string(list_filter([CASE WHEN noted THEN 'side-conflict' END, CASE WHEN blocked THEN 'layout-conflict' END, CASE WHEN why NOT IN ('', 'layout-conflict') THEN why END], lambda x: x IS NOT NULL), ',') AS issues FROM v""")
def card_identities(spark, sf_dir):
    """Customers as roster rows, some sharing a number or a name, and as cards with numbers, names and issues: every reason of a decision."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    pad = lambda x: F.lpad(x.cast("string"), 12, "0")
    named = lambda x: F.concat(F.lit("Tên "), F.when(x % 3 == 0, x % 300).otherwise(x).cast("string"))
    people = c.select(k.alias("row"), pad(k % 1000).alias("cccd"), named(k).alias("name"))
    number = F.when(k % 6 == 0, "").when(k % 17 == 0, "12345").otherwise(pad(k + F.when(k % 10 == 0, 1).otherwise(0)))
    issues = F.array_compact(F.array(F.when(k % 23 == 0, "side-conflict"), F.when(k % 19 == 0, "layout-conflict")))
    read = c.select(k.alias("card_id"), number.alias("number"), F.when(k % 5 > 0, 0.9).otherwise(0.5).alias("number_confidence"), (k % 4 > 0).alias("located"), F.upper(named(k + F.when(k % 9 == 0, 1).otherwise(0))).alias("name"), F.when(k % 7 > 0, 0.9).otherwise(0.5).alias("name_confidence"), (k % 13 > 0).alias("front"), issues.alias("issues"))
    return cards.resolve_cards(read, people).select("card_id", "state", "matched_row", F.array_join("issues", ",").alias("issues"))


# ---------------------------------------------------------------- titles

@query(f"""WITH p AS (SELECT page_id, page_id % 6 AS m, {FOLD.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS t, len(string_split(trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\\s+', ' ', 'g')), ' ')) AS n FROM pages)
 SELECT page_id, CASE m WHEN 0 THEN 'bbnt' WHEN 1 THEN 'contract' WHEN 2 THEN 'commitment' WHEN 3 THEN 'appendix' WHEN 4 THEN 'bbnt' END AS kind FROM p""")
def classified_pages(spark, sf_dir):
    """Pages of a title and prose: a phrase in a heading of two lines, heading words in another order, marks in prose, a heading below the top, prose that only mentions one."""
    k = F.col("page_id")
    fill = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.concat(F.lit("dòng chữ thường số "), i.cast("string"), F.lit(" của một trang giấy rất là dài và vô vị"))), "\n")
    kinds = {0: F.concat(F.lit("BIÊN\nBẢN\n"), fill), 1: F.concat(F.lit("DỊCH VỤ HỢP ĐỒNG\n"), fill), 2: F.concat(fill, F.lit("\ntheo mẫu số: 08 của bộ")), 3: F.concat(fill, F.lit("\nvà các kpi khác")), 4: F.concat(fill, F.lit("\nNGHIỆM THU\n"), fill)}
    text = F.coalesce(*(F.when(k % 6 == i, t) for i, t in kinds.items()), F.concat(fill, F.lit("\nxem biên bản này")))
    return table(spark, sf_dir, "pages").select("page_id", segments.classify_page(text).alias("kind"))


@query("""WITH RECURSIVE c AS (SELECT o_custkey AS k, 3 * row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + o_orderkey % 3 * 2 AS page, o_orderkey AS score FROM orders),
 s AS (SELECT k, list({'page': page, 'score': score} ORDER BY page) AS l, CAST(count(*) * 2 // 3 AS BIGINT) AS expected FROM (SELECT k, page, min(score) AS score FROM c GROUP BY ALL) GROUP BY k),
 w AS (SELECT k, l, expected, true AS more FROM s
  UNION ALL SELECT k, CASE WHEN best IS NULL THEN l ELSE list_filter(l, lambda x, i: i <> best.i) END, expected, best IS NOT NULL FROM (SELECT k, l, expected, list_sort([{'gap': l[i].page - l[i - 1].page, 'off': abs((CASE WHEN i < len(l) THEN l[i + 1].page ELSE l[i].page END) - l[i - 1].page - typical), 'score': l[i].score, 'i': i} FOR i IN range(2, len(l) + 1) IF l[i].page - l[i - 1].page < 5])[1] AS best
   FROM (SELECT *, coalesce(list_median([l[i].page - l[i - 1].page FOR i IN range(2, len(l) + 1) IF l[i].page - l[i - 1].page >= 5]), 5) AS typical FROM w WHERE more AND len(l) > expected)))
 SELECT k AS o_custkey, unnest(l).page AS page FROM (SELECT k, arg_min(l, len(l)) AS l FROM w GROUP BY k)""")
def pruned_covers(spark, sf_dir):
    """Customers as submissions with a cover an order, of which two thirds are expected."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    c = table(spark, sf_dir, "orders").select("o_custkey", (3 * F.row_number().over(w) + F.col("o_orderkey") % 3 * 2).alias("page"), F.col("o_orderkey").alias("score"))
    c = c.groupBy("o_custkey", "page").agg(F.min("score").alias("score")).withColumn("expected", F.floor(F.count("*").over(Window.partitionBy("o_custkey")) * 2 / 3))
    return segments.prune_covers(c, "o_custkey", "page", "score", "expected").select("o_custkey", "page")
