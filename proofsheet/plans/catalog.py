"""The registered queries of the reconciliation engine, each with its SQL twin where SQL can say it.

Every query runs one operator over a whole table of the data folder; the tables stand in for rosters, packets and logs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofsheet.functions import text as T
from proofsheet.functions import values as V
from proofsheet.operators import cards, components, evaluate, matching, quotes, review, roster, segments, status

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(c: str):
    return F.round(F.col(c) * 100).cast("long")


#: SQL for fold_accents
FOLD = "replace(lower(strip_accents(replace(replace({0}, 'đ', 'd'), 'Đ', 'D'))), 'ß', 'ss')"


@query(f"SELECT doc_id, length({FOLD.format('text')}) AS n, md5({FOLD.format('text')}) AS folded_md5 FROM documents")
def fold_text(spark, sf_dir):
    folded = T.fold_accents(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(folded).cast("long").alias("n"), F.md5(folded).alias("folded_md5"))


@query("""SELECT c_custkey, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits, length(regexp_replace(c_name, '[^0-9]', '', 'g')) = 12 AS is_id12,
 length(regexp_replace(c_name, '[^0-9]', '', 'g')) IN (10, 12) AS is_tax FROM customer""")
def digits_format(spark, sf_dir):
    c = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", T.digits(c).alias("digits"), V.matches_format(c, ("id12",)).alias("is_id12"), V.matches_format(c, ("tax10", "tax12")).alias("is_tax"))


@query(f"""SELECT md5(k) AS key_md5, min(doc_id) AS doc_id, count(*) AS n FROM (SELECT doc_id, trim(regexp_replace({FOLD.format('text')}, '\\s+', ' ', 'g')) AS k FROM documents) WHERE k <> '' GROUP BY k""")
def first_row_index(spark, sf_dir):
    # the texts are folded once: a filter on the key would fold them again, so it meets the dealt keys
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.md5(F.nullif(T.fold_label(F.col("text")), F.lit(""))))).alias("k"))
    return matching.first_row_index(docs, F.col("k"), "doc_id", "n").select(F.col("key").alias("key_md5"), "doc_id", "n")


@query("""SELECT l_orderkey, l_linenumber, gross, pit, net, CASE WHEN gross - pit <> net THEN 'mismatch' ELSE 'ok' END AS state FROM (
 SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS gross, CAST(round(l_extendedprice * l_discount * 100) AS BIGINT) AS pit,
 CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT) - CASE WHEN l_orderkey % 9 = 0 THEN 100 ELSE 0 END AS net FROM lineitem)""")
def recompute_formula(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    gross, pit = cents("l_extendedprice"), F.round(F.col("l_extendedprice") * F.col("l_discount") * 100).cast("long")
    net = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("long") - F.when(F.col("l_orderkey") % 9 == 0, 100).otherwise(0)
    df = li.select("l_orderkey", "l_linenumber", gross.alias("gross"), pit.alias("pit"), net.alias("net"))
    return df.withColumn("state", roster.amount_check(F.col("gross"), F.col("pit"), F.col("net")))


@query("""SELECT md5(text) AS key, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), '+' ORDER BY doc_id) AS rows FROM documents WHERE text <> '' GROUP BY text HAVING count(*) > 1""")
def shared_keys(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text <> ''")
    return matching.shared_keys(docs, F.md5("text"), "doc_id", "doc_id").select("key", "n", "rows")


@query("""SELECT o_orderkey, summed, stated, summed - stated AS gap, CASE WHEN summed IS NULL OR stated IS NULL THEN 'pending' WHEN summed = stated THEN 'ok' ELSE 'no' END AS status FROM (
 SELECT o_orderkey, summed, CASE WHEN o_orderkey % 7 = 0 THEN summed + 100 ELSE summed END AS stated FROM orders LEFT JOIN
 (SELECT l_orderkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS summed FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)""")
def control_total(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), cents("l_extendedprice").alias("amount"))
    sums = lines.groupBy("o_orderkey").agg(F.sum("amount").alias("s"))
    said = table(spark, sf_dir, "orders").select("o_orderkey").join(sums, "o_orderkey", "left").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, F.col("s") + 100).otherwise(F.col("s")).alias("stated"))
    return roster.control_totals(lines, ["o_orderkey"], F.col("amount"), said, "stated")


CASCADE_LEFT = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS k1, CASE WHEN o_orderkey % 15 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) || '#' END AS k2 FROM orders"


@query(f"""SELECT o_orderkey, coalesce(a.c_name, b.c_name) AS c_name, CASE WHEN a.c_name IS NOT NULL THEN 'id' WHEN b.c_name IS NOT NULL THEN 'name' ELSE 'unmatched' END AS method
 FROM ({CASCADE_LEFT}) o LEFT JOIN customer a ON k1 <> '' AND CAST(a.c_custkey AS VARCHAR) = k1 LEFT JOIN customer b ON k2 <> '' AND CAST(b.c_custkey AS VARCHAR) || '#' = k2""")
def key_cascade(spark, sf_dir):
    cust = F.col("o_custkey").cast("string")
    left = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(cust).alias("k1"), F.when(F.col("o_orderkey") % 15 == 0, "").otherwise(F.concat(cust, F.lit("#"))).alias("k2"))
    right = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    own = F.col("c_custkey").cast("string")
    keys = [("id", F.col("k1"), own), ("name", F.col("k2"), F.concat(own, F.lit("#")))]
    return matching.key_cascade(left, right, keys, "c_custkey", ["c_name"], "o_orderkey").select("o_orderkey", "c_name", "method")


EVENT_STATUS = "CASE event_type WHEN 'error' THEN 'no' WHEN 'click' THEN 'rv' WHEN 'view' THEN 'ok' WHEN 'purchase' THEN 'pending' WHEN 'signup' THEN 'missing' ELSE 'na' END"
RANK_SQL = "CASE {0} WHEN 'no' THEN 0 WHEN 'missing' THEN 1 WHEN 'rv' THEN 2 WHEN 'pending' THEN 3 WHEN 'ok' THEN 4 END"


def _event_cells(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("status", F.expr(EVENT_STATUS))


@query(f"""SELECT user_id, coalesce(['no', 'missing', 'rv', 'pending', 'ok'][min({RANK_SQL.format(EVENT_STATUS)}) + 1], 'na') AS status,
 {", ".join(f"count(*) FILTER ({EVENT_STATUS} = '{s}') AS n_{s}" for s in ("no", "missing", "rv", "pending", "ok", "na"))} FROM events GROUP BY user_id""")
def worst_wins(spark, sf_dir):
    e = _event_cells(spark, sf_dir).select("user_id", "status")
    return status.worst_wins(e, ["user_id"]).join(status.status_counts(e, ["user_id"]), "user_id")


@query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) r FROM events) WHERE r = 1""")
def latest_override(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return status.latest(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query(f"""WITH c AS (SELECT user_id, event_type, {EVENT_STATUS} AS status, event_id FROM events), o AS (SELECT user_id, event_type, arg_max(event_id, event_id) AS eid FROM events GROUP BY ALL),
 d AS (SELECT user_id, event_type, CASE WHEN eid % 2 = 0 THEN 'ok' ELSE 'no' END AS to_status FROM o WHERE eid % 3 = 0)
 SELECT event_id, CASE WHEN c.status <> 'na' AND to_status IS NOT NULL THEN to_status ELSE c.status END AS status, c.status AS computed_status, c.status <> 'na' AND to_status IS NOT NULL AND to_status <> c.status AS overridden FROM c LEFT JOIN d USING (user_id, event_type)""")
def override_overlay(spark, sf_dir):
    e = _event_cells(spark, sf_dir).select("user_id", "event_type", "event_id", "status")
    last = status.latest(e.select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"])
    said = last.filter("event_id % 3 = 0").select("user_id", "event_type", F.when(F.col("event_id") % 2 == 0, "ok").otherwise("no").alias("to_status"), F.lit("seen").alias("reason"))
    return status.overlay(e, said, ["user_id", "event_type"]).select("event_id", "status", "computed_status", "overridden")


PAGES = "SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS page FROM events"


def _pages(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", (F.row_number().over(w) - 1).alias("page"), F.count("*").over(Window.partitionBy("user_id")).alias("pages"))


@query(f"""SELECT user_id, page AS page_start, coalesce(lead(page) OVER w - 1, pages - 1) AS page_end, row_number() OVER w - 1 AS packet FROM
 (SELECT *, count(*) OVER (PARTITION BY user_id) AS pages FROM ({PAGES})) WHERE event_type = 'error' WINDOW w AS (PARTITION BY user_id ORDER BY page)""")
def packet_bounds(spark, sf_dir):
    starts = _pages(spark, sf_dir).filter("event_type = 'error'")
    return segments.packet_bounds(starts, ["user_id"], "page", F.col("pages"))


@query(f"""WITH p AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS pages FROM ({PAGES})), b AS (SELECT user_id, page AS page_start, coalesce(lead(page) OVER w - 1, pages - 1) AS page_end, row_number() OVER w - 1 AS packet FROM p WHERE event_type = 'error' WINDOW w AS (PARTITION BY user_id ORDER BY page))
 SELECT event_id, packet FROM p LEFT JOIN b ON p.user_id = b.user_id AND page BETWEEN page_start AND page_end""")
def page_packets(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    bounds = segments.packet_bounds(pages.filter("event_type = 'error'"), ["user_id"], "page", F.col("pages"))
    return segments.containing(pages, bounds, ["user_id"], "page").select("event_id", "packet")


@query("""WITH p AS (SELECT conv_id, turn, CASE WHEN turn = f THEN coalesce(k, 'contract') ELSE k END AS own, turn = f AS first, turn % 2 = 0 AS top FROM
 (SELECT conv_id, turn, nullif(role, 'system') AS k, min(turn) OVER (PARTITION BY conv_id) AS f FROM conversations)),
 q AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior, last_value(own IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS kind FROM p),
 r AS (SELECT *, CAST(first OR (own IS NOT NULL AND (own <> prior OR top)) AS INT) AS b FROM q)
 SELECT conv_id, turn, CAST(sum(b) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS segment, kind AS seg_kind, CAST(sum(b) OVER (PARTITION BY conv_id, kind ORDER BY turn) - 1 AS BIGINT) AS ordinal FROM r""")
def segment_docs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.nullif(F.col("role"), F.lit("system")).alias("kind"), (F.col("turn") % 2 == 0).alias("top"))
    return segments.segment_documents(c, ["conv_id"], "turn", "kind", "top").select("conv_id", "turn", F.col("segment").cast("long"), "seg_kind", F.col("ordinal").cast("long"))


@query("""SELECT label, coalesce(arg_max((s + n) / 2, struct_pack(g := n - s, r := -r)) FILTER (n IS NOT NULL), max(s)) AS threshold FROM (SELECT label, s, r, lead(s) OVER (PARTITION BY label ORDER BY s, vec_id) AS n FROM
 (SELECT label, vec_id, CAST(list_max(embedding) AS DOUBLE) AS s, row_number() OVER (PARTITION BY label ORDER BY CAST(list_max(embedding) AS DOUBLE), vec_id) AS r FROM embeddings)) GROUP BY label""")
def gap_threshold(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.array_max("embedding").cast("double").alias("s"))
    return segments.largest_gap(e, ["label"], "s", "vec_id")


@query("""SELECT o_custkey, min(m) AS typical, max(med) AS median FROM (SELECT o_custkey, n AS m, row_number() OVER (PARTITION BY o_custkey ORDER BY c DESC, n) AS r, max(med) OVER (PARTITION BY o_custkey) AS med FROM
 (SELECT o_custkey, n, count(*) AS c, any_value(med) AS med FROM (SELECT *, median(n) OVER (PARTITION BY o_custkey) AS med FROM (SELECT o_custkey, o_orderkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)) GROUP BY ALL)) WHERE r = 1 GROUP BY o_custkey""")
def mode_typical(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    b = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(n, "o_orderkey").select("o_custkey", F.lit(0).cast("long").alias("page_start"), (F.col("n") - 1).alias("page_end"))
    return segments.typical_length(b, ["o_custkey"])


@query(f"""WITH p AS ({PAGES}) SELECT c.user_id, c.page, CASE WHEN c.page - max(s.page) <= 6 THEN max(s.page) END AS found_start FROM p c LEFT JOIN p s ON c.user_id = s.user_id AND s.event_type = 'view' AND s.page <= c.page WHERE c.event_type = 'click' GROUP BY c.user_id, c.page""")
def nearest_start(spark, sf_dir):
    p = _pages(spark, sf_dir)
    return segments.nearest_start(p.filter("event_type = 'click'"), p.filter("event_type = 'view'"), ["user_id"], "page", "page")


@query(f"""WITH p AS ({PAGES}), g AS (SELECT c.user_id, c.page, max(s.page) AS s FROM p c LEFT JOIN p s ON c.user_id = s.user_id AND s.event_type = 'view' AND s.page <= c.page WHERE c.event_type = 'click' GROUP BY c.user_id, c.page),
 f AS (SELECT user_id, page, CASE WHEN page - s <= 6 THEN page - s END AS gap FROM g), n AS (SELECT user_id, count(*) AS covers, count(gap) AS located FROM f GROUP BY user_id),
 v AS (SELECT user_id, gap, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS r FROM (SELECT user_id, gap, count(*) AS n, min(page) AS first FROM f WHERE gap IS NOT NULL GROUP BY user_id, gap))
 SELECT n.user_id, CASE WHEN located >= 0.2 * covers AND v.n >= 0.4 * located THEN gap END AS "offset" FROM n LEFT JOIN v ON n.user_id = v.user_id AND r = 1""")
def consensus_offset(spark, sf_dir):
    p = _pages(spark, sf_dir)
    found = segments.nearest_start(p.filter("event_type = 'click'"), p.filter("event_type = 'view'"), ["user_id"], "page", "page")
    return segments.consensus_offset(found, ["user_id"], "page", 0.4, 0.2)


PERSON = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g'))"
NAMES = "SELECT p_partkey, p_name, lag(p_name) OVER (ORDER BY p_partkey) AS other FROM part"


@query(f"""SELECT a, b, CASE WHEN a = b THEN 'match' WHEN x = y THEN 'fuzzy' WHEN length(x) - length(replace(x, ' ', '')) = length(y) - length(replace(y, ' ', '')) AND 1 - levenshtein(x, y) / CAST(greatest(length(x), length(y)) AS DOUBLE) >= 0.8 THEN 'fuzzy' ELSE 'mismatch' END AS verdict
 FROM (SELECT a, b, {PERSON.format('a')} AS x, {PERSON.format('b')} AS y FROM (SELECT DISTINCT p_name AS a FROM part) JOIN (SELECT DISTINCT p_name AS b FROM part) ON left(a, 1) = left(b, 1))""")
def person_verdict(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("a"), F.left("p_name", F.lit(1)).alias("k")).distinct()
    both = names.join(names.select(F.col("a").alias("b"), "k"), "k")
    return both.select("a", "b", V.compare(F.col("a"), F.col("b"), "person").alias("verdict"))


@query(f"""SELECT p_partkey, CASE WHEN 1.0 * levenshtein(x, y) IS NULL THEN 'mismatch' WHEN (list_has_all(string_split(y, ' '), string_split(x, ' ')) OR list_has_all(string_split(x, ' '), string_split(y, ' ')))
 OR 1 - levenshtein(x, y) / CAST(greatest(length(x), length(y)) AS DOUBLE) >= 0.8 THEN 'fuzzy' ELSE 'mismatch' END AS verdict FROM (SELECT p_partkey, {PERSON.format('p_name')} AS x, {PERSON.format("p_type || ' ' || p_name")} AS y FROM part)""")
def org_containment(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", V.compare(F.col("p_name"), F.concat_ws(" ", "p_type", "p_name"), "organisation").alias("verdict"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS printed, day(o_orderdate) || '-' || month(o_orderdate) || '-' || year(o_orderdate) AS plain, CASE WHEN o_orderkey % 4 = 0 THEN 'mismatch' ELSE 'match' END AS verdict FROM orders""")
def date_verdict(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    shown = F.date_format("o_orderdate", "dd/MM/yyyy")
    other = F.when(F.col("o_orderkey") % 4 == 0, F.date_format(F.date_add(F.to_date("o_orderdate"), 1), "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyy.MM.dd"))
    return o.select("o_orderkey", shown.alias("printed"), V.plain_date(shown).alias("plain"), V.compare(shown, other, "date").alias("verdict"))


WORDS_SQL = "trim(regexp_replace(regexp_replace(" + FOLD + r", '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"""SELECT item_id, doc_id FROM (SELECT item_id, {WORDS_SQL.format('text')} AS q FROM benchmark) JOIN (SELECT doc_id, {WORDS_SQL.format('text')} AS t FROM documents) ON q <> '' AND contains(' ' || t || ' ', ' ' || q || ' ')""")
def locate_quote(spark, sf_dir):
    return quotes.locate_exact(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "text", "doc_id", "text").select("item_id", "doc_id")


@query("""SELECT doc_id, line, value FROM (SELECT doc_id, i - 1 AS line, regexp_extract(lines[i], '[0-9]{16}', 0) AS a, CASE WHEN i < len(lines) THEN regexp_extract(lines[i + 1], '[0-9]{16}', 0) ELSE '' END AS b, CASE WHEN a <> '' THEN a ELSE b END AS value, lines[i] AS l
 FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))) WHERE contains(lower(strip_accents(l)), 'the')""")
def anchored_extract(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    hit = F.explode(quotes.anchored(F.split("text", "\n"), "the", "[0-9]{16}"))
    return docs.select("doc_id", hit.alias("h")).select("doc_id", F.col("h.line").cast("long").alias("line"), "h.value")


@query(f"""SELECT page_id, CASE WHEN n > 10 THEN NULL WHEN contains(t, 'ing') THEN 'contract' WHEN contains(t, 'th') THEN 'bbnt' WHEN contains(t, 'en') THEN 'pit' END AS kind FROM
 (SELECT page_id, {FOLD.format('title')} AS t, len(string_split(trim(regexp_replace(title, '\\s+', ' ', 'g')), ' ')) AS n FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages))""")
def classify_titles(spark, sf_dir):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    kind = segments.classify_page(F.upper(title), (("ing", "contract"), ("th", "bbnt"), ("en", "pit")), (), ())
    return table(spark, sf_dir, "pages").select("page_id", kind.alias("kind"))


@query("""WITH s AS (SELECT user_id, event_type, event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS c FROM events WHERE event_id % 4 <> 0),
 b AS (SELECT user_id, event_type, event_id, c FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY coalesce(c, 0) DESC, event_id) AS r FROM s) WHERE r = 1)
 SELECT k.user_id, k.event_type, CAST(event_id AS VARCHAR) AS value, c AS confidence, CASE WHEN event_id IS NULL THEN 'unread' WHEN c < 20 THEN 'low-confidence' END AS weak FROM (SELECT DISTINCT user_id, event_type FROM events) k LEFT JOIN b USING (user_id, event_type)""")
def weak_pages(spark, sf_dir):
    """Events as reads: every fourth is blank, every third has no confidence."""
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.when(k % 4 == 0, "").otherwise(k.cast("string")).alias("value"), F.when(k % 3 != 0, F.col("value")).alias("confidence"))
    return cards.weak_fields(e, ["user_id", "event_type"], "event_id", least=20)


@query("""WITH local AS (SELECT user_id, event_type, event_id FROM events WHERE event_id % 2 = 0), fresh AS (SELECT user_id, event_type, event_id FROM events WHERE event_id % 2 = 1), pages AS (SELECT DISTINCT user_id, event_type FROM events WHERE value < 10)
 SELECT user_id, event_type, event_id FROM local ANTI JOIN pages USING (user_id, event_type) UNION ALL SELECT user_id, event_type, event_id FROM fresh SEMI JOIN pages USING (user_id, event_type)""")
def replace_pages(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    pages = e.filter("value < 10").select("user_id", "event_type").distinct()
    cols = ["user_id", "event_type", "event_id"]
    return cards.replace_pages(e.filter("event_id % 2 = 0").select(cols), e.filter("event_id % 2 = 1").select(cols), pages, ["user_id", "event_type"])


@query("""SELECT family, item, count(*) AS n FROM (SELECT 'rejection' AS family, o_orderpriority AS item FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'identity', c_mktsegment FROM customer WHERE c_acctbal < 0
 UNION ALL SELECT 'flag', event_type FROM events WHERE value > 50 UNION ALL SELECT 'missing', p_type FROM part WHERE p_size < 5 UNION ALL SELECT 'cell', l_returnflag FROM lineitem WHERE l_linestatus = 'O') GROUP BY ALL""")
def report_union(spark, sf_dir):
    def family(name, table_name, item, where):
        return table(spark, sf_dir, table_name).filter(where).select(F.lit(name).alias("family"), F.col(item).alias("item"))

    rows = review.report_rows(family("rejection", "orders", "o_orderpriority", "o_orderstatus = 'F'"), family("identity", "customer", "c_mktsegment", "c_acctbal < 0"), family("flag", "events", "event_type", "value > 50"), family("missing", "part", "p_type", "p_size < 5"), family("cell", "lineitem", "l_returnflag", "l_linestatus = 'O'"))
    return rows.groupBy("family", "item").agg(F.count("*").alias("n"))


@query(f"""SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY coalesce({RANK_SQL.format(EVENT_STATUS)}, 9), value NULLS LAST, event_id) AS r FROM events""")
def exception_sort(spark, sf_dir):
    """Every event of a user in the order of its status, all on one page."""
    e = _event_cells(spark, sf_dir).select("user_id", "event_id", "status", F.lit(0).alias("page"), F.col("value").alias("y"), F.col("event_id").alias("idx"))
    w = Window.partitionBy("user_id").orderBy(*review.exception_first(e, F.coalesce(status.rank_of(F.col("status")), F.lit(9))))
    return e.select("user_id", "event_id", F.row_number().over(w).alias("r"))


@query("""SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END,
 CASE WHEN event_type <> 'signup' THEN floor(value / 25) END NULLS LAST, CASE WHEN event_type <> 'signup' THEN value END NULLS LAST, event_id) AS r FROM events""")
def exception_order(spark, sf_dir):
    """Events as fields, users as packets; a sign-up has no place."""
    verdict = F.expr("CASE event_type WHEN 'error' THEN 'mismatch' WHEN 'click' THEN 'fuzzy' WHEN 'view' THEN 'low_conf' ELSE 'match' END")
    placed = F.when(F.col("event_type") != "signup", F.col("value"))
    fields = table(spark, sf_dir, "events").select("user_id", "event_id", verdict.alias("verdict"), F.floor(placed / 25).alias("page"), placed.alias("y"), F.col("event_id").alias("idx"))
    w = Window.partitionBy("user_id").orderBy(*review.exception_first(fields, V.severity(F.col("verdict"))))
    return fields.select("user_id", "event_id", F.row_number().over(w).alias("r"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 2 * s_suppkey AS u, 2 * CAST(s_nationkey AS BIGINT) + 1 AS v FROM supplier), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
 r AS (SELECT u AS node, u AS seen FROM b UNION SELECT node, v FROM r JOIN b ON seen = u) SELECT node, min(seen) AS component FROM r GROUP BY node""")
def linked_suppliers(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return components.components(s.select((F.col("s_suppkey") * 2).alias("u"), (F.col("s_nationkey").cast("long") * 2 + 1).alias("v")))


@query("""SELECT nation, least(2 * any_value(lo), 2 * nation + 1) AS component, n FROM (SELECT CAST(s_nationkey AS BIGINT) AS nation, min(s_suppkey) AS lo, count(*) AS n FROM supplier GROUP BY 1) GROUP BY nation, n""")
def linked_suppliers_all(spark, sf_dir):
    """The nations' components with the number of suppliers in each."""
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2).alias("u"), (F.col("s_nationkey").cast("long") * 2 + 1).alias("v"))
    found = components.components(s)
    own = found.filter("node % 2 = 1").select(F.expr("node div 2").alias("nation"), "component")
    return own.join(found.filter("node % 2 = 0").groupBy("component").agg(F.count("*").alias("n")), "component").select("nation", "component", "n")


@query("""SELECT l_orderkey, a.l_linenumber AS u, b.l_linenumber AS v FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_linenumber < b.l_linenumber
 AND greatest(least(a.l_suppkey + a.l_quantity, b.l_suppkey + b.l_quantity) - greatest(a.l_suppkey, b.l_suppkey), 0) / least(a.l_quantity, b.l_quantity) >= 0.5""")
def side_by_side(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").cast("double").alias("top"), (F.col("l_suppkey") + F.col("l_quantity")).alias("bottom"))
    return components.neighbours(li, ["l_orderkey"], "l_linenumber", "top", "bottom")


@query("""SELECT o_orderkey, array_to_string(list_sort(list_filter(others, lambda x: x <> o_orderkey)), '+') AS others FROM orders JOIN
 (SELECT k, list(o_orderkey) AS others FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN '1' || o_custkey WHEN o_orderkey % 2 = 0 THEN '2' || o_custkey % 100 ELSE 'own' || o_orderkey END AS k FROM orders) GROUP BY k)
 ON k = CASE WHEN o_orderkey % 3 <> 0 THEN '1' || o_custkey WHEN o_orderkey % 2 = 0 THEN '2' || o_custkey % 100 ELSE 'own' || o_orderkey END""")
def duplicate_packets(spark, sf_dir):
    """Orders as packets: customers as ids, which every third order lacks; half of those have a name."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    strong = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey").cast("string")).otherwise("")
    weak = F.when(F.col("o_orderkey") % 2 == 0, (F.col("o_custkey") % 100).cast("string")).otherwise("")
    return matching.duplicate_identities(o, "o_orderkey", strong, weak).select("o_orderkey", F.array_join("duplicate_of", "+").alias("others"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'flagged' WHEN o_totalprice > 100000 THEN 'completed' WHEN o_orderpriority LIKE '1%' THEN 'reviewing' ELSE 'unseen' END AS lifecycle FROM orders""")
def packet_lifecycle(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", review.lifecycle(F.when(F.col("o_orderpriority").startswith("1"), 1).otherwise(0), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0), F.col("o_totalprice") > 100000).alias("lifecycle"))


@query("""SELECT o_orderkey, CAST(round_even(o_totalprice, 0) AS BIGINT) AS whole, format('{:,}', CAST(round_even(o_totalprice, 0) AS BIGINT)) AS shown, replace(format('{:,}', CAST(round_even(o_totalprice, 0) AS BIGINT)), ',', '.') AS local,
 CASE WHEN o_totalprice >= 999.5 THEN CAST(round_even(o_totalprice, 0) AS BIGINT) END AS token FROM orders""")
def money_cells(spark, sf_dir):
    """Cells as whole numbers, how they are shown, and read back from what is shown: less than a thousand has no separator."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", V.money(F.format_string("%.2f d", "o_totalprice")).alias("whole"))
    local = V.grouped(F.col("whole"), ".")
    return o.select("o_orderkey", "whole", V.grouped(F.col("whole")).alias("shown"), local.alias("local"), V.money_token(F.concat(local, F.lit(" VNĐ."))).alias("token"))


@query("""WITH u AS (SELECT label, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) - list_avg(list_transform(embedding, lambda y: CAST(y AS DOUBLE)))) AS c FROM embeddings),
 n AS (SELECT label, vec_id, list_transform(c, lambda x: x / sqrt(list_inner_product(c, c))) AS v, greatest(3, count(*) OVER (PARTITION BY label) // 20) AS k FROM u),
 p AS (SELECT a.label, a.vec_id, a.k, list_inner_product(a.v, b.v) AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.v, b.v) DESC) AS r FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id)
 SELECT label, vec_id, round(sum(s), 4) AS score FROM p WHERE r <= k GROUP BY label, vec_id""")
def recurrence_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding")
    return segments.recurrence_scores(e, "label", "vec_id", "embedding").select("label", "vec_id", F.round("score", 4).alias("score"))


@query("""SELECT o_custkey, low, high FROM (SELECT o_custkey, coalesce(lag(n) OVER (PARTITION BY o_custkey ORDER BY n), 0) + 1 AS low, n - 1 AS high FROM (SELECT DISTINCT o_custkey, CAST(o_orderkey % 50 + 1 AS BIGINT) AS n FROM orders)) WHERE high >= low""")
def missing_numbers(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 50 + 1).alias("n"))
    return segments.missing_numbers(o, ["o_custkey"], "n")


REGISTRY_SQL = ", ".join(
    f"({stt}, '{kind}', {f"'{field}'" if field else 'NULL'}, {f"'{key}'" if key else 'NULL'}, '{doc}', {doc in optional})"
    for stt, (_, docs, kind, _, _, optional, field, key) in evaluate.CRITERIA.items() for doc in docs
)
#: Packet facts of the criteria queries; how a source of field f in document d reads follows from (k + 3 f + 5 d) % 12: 0 another value, 1 blank, 2 other case, 3 no source.
ALL_CRITERIA_SQL = f"""WITH x AS (SELECT o_orderkey AS k, o_custkey % 7 <> 0 AS matched, CASE WHEN o_orderkey % 29 = 0 THEN 0 ELSE CAST(round(o_totalprice) AS BIGINT) END AS g, CASE WHEN o_orderkey % 23 = 0 THEN 0 ELSE g // 10 END AS p, g - p + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS n,
 MAP {{'name': CASE WHEN k % 11 = 0 THEN '' ELSE 'Tran Van An' END, 'cccd': lpad(CAST(o_custkey AS VARCHAR), CASE WHEN k % 13 = 0 THEN 11 ELSE 12 END, '0'), 'dob': strftime(o_orderdate, '%d/%m/%Y'), 'gender': CASE WHEN k % 10 = 0 THEN 'X' ELSE 'Nam' END,
 'mst': CASE WHEN k % 17 = 0 THEN '1' ELSE lpad(CAST(o_custkey AS VARCHAR), 10, '0') END, 'account': lpad(CAST(k AS VARCHAR), 9, '0'), 'gross': CASE WHEN k % 19 = 0 THEN '' ELSE CAST(g AS VARCHAR) END, 'pit': CAST(p AS VARCHAR), 'net': CAST(n AS VARCHAR)}} AS roster FROM orders),
 reg(stt, kind, field, key, doc, optional) AS (VALUES {REGISTRY_SQL}),
 c AS (SELECT *, coalesce(roster[key], '') AS ref, k % 4 = 0 AS pledged, CASE WHEN optional THEN 'na' ELSE 'missing' END AS absent,
 CASE doc WHEN '{evaluate.ID}' THEN k % 2 = 0 WHEN '{evaluate.CONTRACT}' THEN k % 3 = 0 WHEN '{evaluate.BBNT}' THEN k % 5 <> 1 WHEN '{evaluate.APPENDIX}' THEN k % 4 = 1 WHEN '{evaluate.LOOKUP}' THEN k % 8 <> 0 WHEN '{evaluate.COMMITMENT}' THEN k % 4 = 0 ELSE true END AS present,
 (k + 3 * list_position(['hoten', 'cccd', 'ngaysinh', 'mst', 'tk', 'phi'], field) - 3 + 5 * list_position(['{evaluate.ID}', '{evaluate.CONTRACT}', '{evaluate.BBNT}', '{evaluate.APPENDIX}'], doc) - 5) % 12 AS s FROM x, reg),
 t AS (SELECT k, stt, doc, matched, CASE
 WHEN kind = 'presence' THEN CASE WHEN present THEN 'rv' ELSE absent END
 WHEN kind = 'external' THEN CASE WHEN present THEN 'rv' ELSE 'missing' END
 WHEN kind = 'conditional' THEN CASE WHEN pledged THEN 'rv' ELSE 'na' END
 WHEN stt = 14 AND matched AND roster['gross'] <> '' AND g <= 0 THEN 'no'
 WHEN stt = 12 OR doc = '{evaluate.LISTING}' THEN 'pending'
 WHEN doc = 'Excel' THEN CASE WHEN NOT matched OR (stt <> 17 AND ref = '') OR (stt = 17 AND roster['gross'] = '') OR (stt = 15 AND p <> 0) THEN 'pending'
  WHEN stt = 2 AND length(ref) <> 12 OR stt = 4 AND ref NOT IN ('Nam', 'Nữ') OR stt = 5 AND length(ref) NOT IN (10, 12) OR stt = 15 AND NOT pledged OR stt = 16 AND n <= 0 OR stt = 17 AND g - p <> n THEN 'no' ELSE 'ok' END
 WHEN NOT present THEN absent
 WHEN field IS NULL OR s IN (1, 3) OR NOT matched OR ref = '' THEN 'pending'
 WHEN s = 0 THEN 'no' WHEN s = 2 AND field = 'hoten' THEN 'rv' ELSE 'ok' END AS status FROM c)
 SELECT k AS o_orderkey, stt, coalesce(['no', 'missing', 'rv', 'pending', 'ok'][min({RANK_SQL.format('status')}) + 1], 'na') AS status,
 CASE WHEN stt IN (1, 2, 3, 5, 7) THEN true WHEN stt IN (12, 14, 16, 17) THEN true WHEN stt = 15 THEN NOT (min(k) % 23 <> 0 AND bool_and(doc = 'Excel') AND bool_and(status = 'pending') AND min(matched)) ELSE false END AS automatic FROM t GROUP BY k, stt"""


def criteria_cells(spark, sf_dir, readers: bool = False) -> DataFrame:
    """The cells of every packet, with a source in each document for each field that is compared.

    readers: what was printed at the labels of tax number and account is known too, and a reader of parts has seen some contracts and acceptances.
    """
    k, shown = F.col("o_orderkey"), lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    o = table(spark, sf_dir, "orders")
    gross = F.when(k % 29 == 0, 0).otherwise(F.round("o_totalprice").cast("long"))
    pit = F.when(k % 23 == 0, 0).otherwise(F.floor(gross / 10)).cast("long")
    net = gross - pit + F.when(k % 5 == 0, 1).otherwise(0)
    roster_values = {
        "name": F.when(k % 11 == 0, "").otherwise("Tran Van An"), "cccd": F.when(k % 13 == 0, shown("o_custkey", 11)).otherwise(shown("o_custkey", 12)), "dob": F.date_format("o_orderdate", "dd/MM/yyyy"),
        "gender": F.when(k % 10 == 0, "X").otherwise("Nam"), "mst": F.when(k % 17 == 0, "1").otherwise(shown("o_custkey", 10)), "account": shown("o_orderkey", 9),
        "gross": F.when(k % 19 == 0, "").otherwise(gross.cast("string")), "pit": pit.cast("string"), "net": net.cast("string"),
    }
    key = [F.lit("all").alias("case_id"), k.alias("packet")]
    packets = o.select(*key, (F.col("o_custkey") % 7 != 0).alias("matched"), F.create_map(*(x for n, v in roster_values.items() for x in (F.lit(n), v))).alias("roster"))
    kinds = {"id_front": k % 2 == 0, "contract": k % 3 == 0, "bbnt": k % 5 != 1, "appendix": k % 4 == 1, "pit": k % 8 != 0, "commitment": k % 4 == 0}
    documents = o.select(*key, F.explode(F.array_compact(F.array(*(F.when(there, n) for n, there in kinds.items())))).alias("kind")).withColumn("doc_id", F.col("kind"))
    fields = {"hoten": ("name", "Le Thi Binh"), "cccd": ("cccd", None), "ngaysinh": ("dob", "31/12/1900"), "mst": ("mst", None), "tk": ("account", None), "phi": ("gross", None)}
    labels = {"mst": "MST TNCN: ", "tk": "Số tài khoản : "}
    read = []
    for f, (field, (name, other)) in enumerate(fields.items()):
        for d, kind in enumerate(list(kinds)[:4]):
            s, value = (F.col("packet") + 3 * f + 5 * d) % 12, F.col("roster")[name]
            wrong = F.lit(other) if other else F.concat(F.lit("9"), value)
            source = [F.lit(field).alias("field_key"), F.lit(kind).alias("doc_id"), F.when(s == 0, wrong).when(s == 1, "").when(s == 2, F.upper(value)).otherwise(value).alias("value")]
            if readers:
                printed = F.concat(F.lit(labels[field]), F.when(F.col("packet") % 6 == 0, value).otherwise("000"), F.lit(" ngày")) if field in labels else F.lit(None).cast("string")
                source.append(printed.alias("near"))
            read.append(F.when(s != 3, F.struct(*source)))
    sources = packets.select("case_id", "packet", F.explode(F.array_compact(F.array(*read))).alias("r")).select("case_id", "packet", "r.*")
    if not readers:
        return evaluate.evaluate(packets, documents, sources)
    bank, terms = (evaluate.PARTS[n][1] for n in (8, 13))
    part = lambda name, doc, sure=1.0, located=True: F.struct(F.lit(name).alias("part"), F.lit(doc).alias("doc_id"), F.lit("v").alias("value"), F.lit(located).alias("located"), F.lit(sure).alias("confidence"))
    told = [
        (k % 5 == 0, [part(b, "contract") for b in bank]), (k % 5 == 1, [part(b, "contract") for b in bank[:2]]), (k % 5 == 2, [part(b, "contract", 0.9) for b in bank]),
        (k % 7 == 0, [part(t, "contract") for t in terms]), (k % 4 == 3, [part(b, "bbnt", located=b != bank[1]) for b in bank]),
    ]
    none = F.array().cast("array<struct<part:string,doc_id:string,value:string,located:boolean,confidence:double>>")
    reads = o.select(*key, F.explode(F.concat(*(F.when(test, F.array(*parts)).otherwise(none) for test, parts in told))).alias("r")).select("case_id", "packet", "r.*")
    return evaluate.evaluate(packets, documents, sources, evaluate.parts_cells(reads, documents))


CELLS_SQL = ALL_CRITERIA_SQL[:ALL_CRITERIA_SQL.rindex(" SELECT k AS o_orderkey")] + " SELECT k AS o_orderkey, stt, doc AS document, status FROM t"


@query(ALL_CRITERIA_SQL)
def criteria_all(spark, sf_dir):
    """Every criterion of every packet."""
    return evaluate.criterion_results(criteria_cells(spark, sf_dir)).select(F.col("packet").alias("o_orderkey"), "stt", "status", "automatic")


READ_SQL = CELLS_SQL.replace("WHEN s = 0 THEN 'no'", "WHEN s = 0 THEN CASE WHEN field IN ('mst', 'tk') AND k % 6 = 0 THEN 'rv' ELSE 'no' END").replace(
    "WHEN NOT present THEN absent\n", f"""WHEN NOT present THEN absent
 WHEN stt = 8 AND doc = '{evaluate.CONTRACT}' AND k % 5 < 3 THEN CASE WHEN k % 5 = 0 THEN 'ok' ELSE 'rv' END WHEN stt = 13 AND doc = '{evaluate.CONTRACT}' AND k % 7 = 0 THEN 'ok' WHEN stt = 8 AND doc = '{evaluate.BBNT}' AND k % 4 = 3 THEN 'rv'
""")


@query(READ_SQL)
def criteria_read(spark, sf_dir):
    """Every cell where readers have told what is printed at labels and which parts they found."""
    return criteria_cells(spark, sf_dir, True).select(F.col("packet").alias("o_orderkey"), "stt", "document", "status")


@query(CELLS_SQL)
def criteria_matrix(spark, sf_dir):
    """Every cell of every packet: criterion by document."""
    return criteria_cells(spark, sf_dir).select(F.col("packet").alias("o_orderkey"), "stt", "document", "status")


@query("""WITH f AS (SELECT o_custkey AS c, bool_or(o_orderkey % 40 = 0) AS off, bool_or(o_orderkey % 40 = 1) AS untotalled, bool_or(o_orderkey % 40 = 2) AS shared, bool_or(o_orderkey % 40 = 3) AS blind FROM orders GROUP BY 1),
 p AS (SELECT o_custkey AS c, CASE WHEN o_orderkey % 4 <> 0 THEN '1' || o_orderkey % 50 WHEN o_orderkey % 8 <> 0 THEN '2' || o_orderkey % 20 END AS k FROM orders),
 d AS (SELECT c, bool_or(k IS NOT NULL AND n > 1) AS twice, bool_or(k IS NOT NULL) AS identified FROM (SELECT c, k, count(*) AS n FROM p GROUP BY ALL) GROUP BY c),
 x AS (SELECT c_custkey, c_custkey % 5 <> 0 AS listed, coalesce(off, false) AS off, coalesce(untotalled, false) AS untotalled, coalesce(shared, false) AS shared, coalesce(blind, false) AS blind, twice, identified FROM customer LEFT JOIN f ON f.c = c_custkey LEFT JOIN d ON d.c = c_custkey)
 SELECT c_custkey, 20 AS stt, CASE WHEN NOT listed OR untotalled OR blind THEN 'pending' WHEN off THEN 'no' ELSE 'ok' END AS status FROM x
 UNION ALL SELECT c_custkey, 26, 'rv' FROM x
 UNION ALL SELECT c_custkey, 30, CASE WHEN NOT listed OR blind THEN 'pending' WHEN shared THEN 'no' ELSE 'ok' END FROM x
 UNION ALL SELECT c_custkey, 31, CASE WHEN NOT coalesce(identified, false) THEN 'pending' WHEN twice THEN 'no' ELSE 'ok' END FROM x
 UNION ALL SELECT c_custkey, 32, 'pending' FROM x""")
def batch_criteria(spark, sf_dir):
    """Customers as submissions, their orders as packets; findings and identities follow from the keys."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    codes = F.array(*map(F.lit, ("total-mismatch", "no-total-row", "duplicate-cccd", "missing-columns")))
    found = o.select(F.col("o_custkey").alias("case_id"), F.coalesce(F.get(codes, (k % 40).cast("int")), F.lit("bad-id")).alias("code"))
    cases = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"), (F.col("c_custkey") % 5 != 0).alias("has_roster"))
    cccd, name = F.lpad((k % 50).cast("string"), 12, "0"), F.concat(F.lit("Name "), (k % 20).cast("string"))
    packets = o.select(F.col("o_custkey").alias("case_id"), k.alias("packet"), F.when(k % 4 == 0, "").otherwise(cccd).alias("cccd"), F.when(k % 8 == 0, "").otherwise(name).alias("name"))
    return evaluate.batch_results(found, cases, packets).select(F.col("case_id").alias("c_custkey"), "stt", "status")


@query("""SELECT o_orderkey, shown, CASE WHEN damaged > 3 OR length(shown) < 5 THEN '' ELSE array_to_string(list_sort(list_distinct(list_transform(list_reduce(list_transform(string_split(shown, ''), lambda c: CASE c WHEN 'S' THEN ['5'] WHEN '§' THEN ['5', '8'] ELSE [c] END),
 lambda a, x: flatten(list_transform(a, lambda w: list_transform(x, lambda o: w || o)))), lambda w: CAST(replace(w, '.', '') AS BIGINT)))), ',') END AS repairs FROM
 (SELECT *, length(shown) - length(replace(replace(shown, 'S', ''), '§', '')) AS damaged FROM (SELECT o_orderkey, translate(replace(format('{:,}', CAST(round(o_totalprice) AS BIGINT)), ',', '.'), '58', 'S§') AS shown FROM orders))""")
def damaged_amounts(spark, sf_dir):
    shown = F.translate(V.grouped(F.round("o_totalprice").cast("long"), "."), "58", "S§")
    return table(spark, sf_dir, "orders").select("o_orderkey", shown.alias("shown"), F.array_join(quotes.digit_repairs(shown).cast("array<string>"), ",").alias("repairs"))


#: Number words by digit.
SPELLED = ("khong", "mot", "hai", "ba", "bon", "nam", "sau", "bay", "tam", "chin")


@query("""SELECT o_orderkey, CAST(o_orderkey % 1000 * 1000 + o_custkey % 10 AS BIGINT) AS amount FROM orders""")
def number_words(spark, sf_dir):
    """Thousands in full (hundreds, tens, units) and a unit behind them."""
    n = F.col("o_orderkey") % 1000
    word = lambda c: F.get(F.array(*map(F.lit, SPELLED)), c.cast("int"))
    hundreds, tens, units = F.floor(n / 100), F.floor(n / 10) % 10, n % 10
    ten = F.when(tens == 0, F.when(units != 0, "lẻ")).when(tens == 1, "mười").otherwise(F.concat_ws(" ", word(tens), F.lit("mươi")))
    group = F.concat_ws(" ", word(hundreds), F.lit("trăm"), ten, F.when(units != 0, word(units)))
    said = F.concat_ws(" ", F.lit("Bằng chữ:"), group, F.lit("nghìn"), word(F.col("o_custkey") % 10), F.lit("đồng"))
    return table(spark, sf_dir, "orders").select("o_orderkey", quotes.spelled_amount(said).alias("amount"))


@query("""SELECT o_orderkey, CAST(o_custkey % 10 * 1000000 + o_orderkey % 10 * 100 AS BIGINT) AS amount FROM orders""")
def number_words_all(spark, sf_dir):
    word = lambda c: F.get(F.array(*map(F.lit, SPELLED)), (F.col(c) % 10).cast("int"))
    said = F.concat_ws(" ", word("o_custkey"), F.lit("triệu"), word("o_orderkey"), F.lit("trăm đồng"))
    return table(spark, sf_dir, "orders").select("o_orderkey", quotes.spelled_amount(said).alias("amount"))


@query("""WITH RECURSIVE w AS (SELECT l_orderkey AS k, CAST(l_suppkey AS INTEGER) AS x, CAST(l_quantity AS INTEGER) AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS i FROM lineitem),
 r AS (SELECT k, i, x, y, y AS base, 0 AS line FROM w WHERE i = 1 UNION ALL SELECT w.k, w.i, w.x, w.y, CASE WHEN w.y - base > 8 THEN w.y ELSE base END, line + CASE WHEN w.y - base > 8 THEN 1 ELSE 0 END FROM r JOIN w ON w.k = r.k AND w.i = r.i + 1)
 SELECT k AS l_orderkey, line, count(*) AS n, min(x) AS x, min(y) AS y, max(x) + 1 - min(x) AS width, max(y) + 1 - min(y) AS height FROM r GROUP BY k, line""")
def line_grouping(spark, sf_dir):
    """Order lines as words on a page: lines within 8 units of each line's first word."""
    word = F.struct(F.col("l_suppkey").cast("int").alias("x"), F.col("l_quantity").cast("int").alias("y"), F.lit(1).alias("w"), F.lit(1).alias("h"), F.col("l_linenumber").alias("id"))
    pages = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(word).alias("words"))
    lines = pages.select("l_orderkey", F.posexplode(segments.group_lines(F.col("words"))).alias("line", "words"))
    return lines.select("l_orderkey", "line", F.size("words").cast("long").alias("n"), segments.union_box(F.col("words")).alias("box")).select("l_orderkey", "line", "n", "box.*")


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["control_total"](spark, sf_dir)


from proofsheet.plans import lists, pages, payloads, records, workbooks  # noqa: E402, F401  (add their queries)
