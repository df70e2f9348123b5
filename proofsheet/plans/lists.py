"""Registered queries on the small steps between readings and decisions: sheets, asked fields, labels, pages to read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofsheet.functions.session import plain_unions
from proofsheet.operators import cards, extract, quotes, roster
from proofsheet.plans.catalog import query, table

KINDS = (("STT", "Họ và tên", "Số CCCD", "Ngày sinh", "Gross"), ("STT", "Họ và tên", "Số CCCD"), ("STT", "Ghi chú"), ("STT", "Họ và tên", "Số CCCD", "Gross", "Thuế PIT", "Thực nhận"))


@query("""WITH s AS (SELECT c_custkey AS k, i, (c_custkey + i) % 4 AS m FROM customer, range(3) t(i) WHERE i <= c_custkey % 3),
 b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY [3, 1, 0, 4][m + 1] DESC, i) AS r FROM s WHERE m <> 2)
 SELECT CAST(k AS VARCHAR) AS case_id, 's' || i AS sheet, CASE WHEN m = 1 THEN 'amount' ELSE '' END AS missing FROM b WHERE r = 1""")
def selected_sheets(spark, sf_dir):
    """Customers as workbooks of one to three sheets with different headings."""
    k = F.col("c_custkey")
    heads = F.array(*(F.array(*map(F.lit, h)) for h in KINDS))
    c = table(spark, sf_dir, "customer").select(k, F.explode(F.sequence(F.lit(0).cast("long"), k % 3)).alias("i"))
    c = c.select(k.cast("string").alias("case_id"), F.concat(F.lit("s"), F.col("i").cast("string")).alias("sheet"), F.col("i").cast("int").alias("sheet_idx"), F.get(heads, ((k + F.col("i")) % 4).cast("int")).alias("head"))
    rows = plain_unions(c.select("case_id", "sheet", "sheet_idx", F.lit(1).alias("row"), F.col("head").alias("cells"))).unionByName(c.select("case_id", "sheet", "sheet_idx", F.lit(2).alias("row"), F.array(F.lit("1")).alias("cells")))
    return roster.select_sheet(rows).select("case_id", "sheet", F.array_join(roster.missing_required(F.col("fields")), ",").alias("missing"))


@query("""SELECT event_id FROM events WHERE event_id % 3 <> 0 AND event_id % 4 <> 0 AND (user_id + length(event_type)) % 2 = 0""")
def requested_reads(spark, sf_dir):
    """Events as a reader's answers, some without value or quote; of half of all users' kinds a value was asked."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    reads = e.select("event_id", "user_id", "event_type", F.when(k % 3 > 0, "v").otherwise(" ").alias("value"), F.when(k % 4 > 0, "q").alias("quote"))
    wanted = e.filter((F.col("user_id") + F.length("event_type")) % 2 == 0).select("user_id", "event_type")
    return extract.requested_reads(reads, wanted, ["user_id", "event_type"]).select("event_id")


@query("""WITH s AS (SELECT user_id, event_type, event_id, event_id % 7 AS page, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'd' || event_id % 11 END AS doc_id, event_id % 4 <> 0 AS has, value AS c FROM events),
 w AS (SELECT user_id, event_type FROM s GROUP BY ALL HAVING count(*) FILTER (has) = 0 OR max(c) FILTER (has) < 20)
 SELECT DISTINCT doc_id, page FROM s JOIN w USING (user_id, event_type) WHERE doc_id <> ''""")
def reread_pages(spark, sf_dir):
    """Events as reads of fields (a user's kind); the pages of fields that were not read or read unsurely."""
    k = F.col("event_id")
    s = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", (k % 7).alias("page"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("d"), (k % 11).cast("string"))).alias("doc_id"), F.when(k % 4 > 0, k.cast("string")).otherwise("").alias("value"), F.col("value").alias("confidence"))
    keys = ["user_id", "event_type"]
    return cards.pages_to_reread(cards.weak_fields(s, keys, "event_id", least=20), s, keys)


@query("""SELECT o_orderkey, o_orderkey % 6 IN (0, 1, 3) AS labelled FROM orders""")
def labelled_anchors(spark, sf_dir):
    """A colon at its end, one next to it, prose, capitals, digits alone, prose with a colon further on."""
    k = F.col("o_orderkey") % 6
    anchor = F.get(F.array(*map(F.lit, ("Họ và tên: ", "Họ và tên", "Họ và tên", "HỌ VÀ TÊN", "123", "của bên"))), k.cast("int"))
    after = F.get(F.array(*map(F.lit, ("An", " : An", "là An", "An", "An", "An :"))), k.cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", extract.is_labelled(anchor, after).alias("labelled"))


@query("""SELECT o_orderkey, o_orderkey % 7 IN (0, 1, 2) AS confirmed FROM orders""")
def confirmed_at_label(spark, sf_dir):
    """The expected number at its label as one token, in groups, behind other words; beyond eight tokens, within a longer run of digits, at another label, and nothing expected."""
    k, n = F.col("o_orderkey") % 7, F.lpad(F.col("o_orderkey").cast("string"), 12, "7")
    near = F.coalesce(*(F.when(k == i, t) for i, t in {
        0: F.concat(F.lit("MST TNCN: "), n), 1: F.concat(F.lit("MST TNCN : "), F.substring(n, 1, 4), F.lit(" "), F.substring(n, 5, 4), F.lit("."), F.substring(n, 9, 4)), 2: F.concat(F.lit("mst tncn là số "), n),
        3: F.concat(F.lit("MST TNCN a b c d e f g h "), n), 4: F.concat(F.lit("MST TNCN: 1"), n), 5: F.concat(F.lit("CCCD: "), n), 6: F.lit("MST TNCN: 1"),
    }.items()))
    expected = F.when(k == 6, "").otherwise(n)
    return table(spark, sf_dir, "orders").select("o_orderkey", quotes.printed_at_label(near, expected, extract.FIELDS["mst"][0]).alias("confirmed"))
