"""Operators against plain Python models of the rules."""

import random

from pyspark.sql import functions as F

from proofsheet.operators import cards, components, evaluate, matching, quotes, review, roster, segments, status


def test_worst_wins(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice(status.STATUSES)) for k in range(60) for _ in range(rng.randint(1, 5))]
    got = {r.k: r.status for r in status.worst_wins(spark.createDataFrame(rows, "k int, status string"), ["k"]).collect()}
    for k in range(60):
        live = [s for j, s in rows if j == k and s != "na"]
        assert got[k] == (min(live, key=status.RANKED.index) if live else "na")


def test_overlay(spark):
    cells = spark.createDataFrame([(1, "rv"), (2, "na"), (3, "ok")], "k int, status string")
    said = spark.createDataFrame([(1, "ok", "seen"), (2, "ok", "no"), (3, "ok", "same")], "k int, to_status string, reason string")
    got = {r.k: (r.status, r.computed_status, r.overridden, r.override_reason) for r in status.overlay(cells, said, ["k"]).collect()}
    assert got == {1: ("ok", "rv", True, "seen"), 2: ("na", "na", False, None), 3: ("ok", "ok", False, None)}


def test_key_cascade_prefers_strong_keys_and_first_rows(spark):
    left = spark.createDataFrame([(1, "11", "x"), (2, "", "b"), (3, "", ""), (4, "99", "b")], "p int, id string, name string")
    right = spark.createDataFrame([(0, "11", "a", "r0"), (1, "11", "b", "r1"), (2, "", "b", "r2"), (3, "", "", "r3")], "row int, rid string, rname string, who string")
    out = matching.key_cascade(left, right, [("id", F.col("id"), F.col("rid")), ("name", F.col("name"), F.col("rname"))], "row", ["who"], "p")
    assert {r.p: (r.who, r.method) for r in out.collect()} == {1: ("r0", "id"), 2: ("r1", "name"), 3: (None, "unmatched"), 4: ("r1", "name")}


def test_duplicate_identities(spark):
    p = spark.createDataFrame([(0, "1", "a"), (1, "1", "b"), (2, "", "a"), (3, "", "a"), (4, "", "")], "i int, id string, name string")
    got = {r.i: r.duplicate_of for r in matching.duplicate_identities(p, "i", F.col("id"), F.col("name")).collect()}
    assert got == {0: [1], 1: [0], 2: [3], 3: [2], 4: []}


def sheet(*rows, case="c", name="s", idx=0):
    return [(case, name, idx, k, list(r)) for k, r in enumerate(rows)]


ROWS = "case_id string, sheet string, sheet_idx int, row int, cells array<string>"
HEAD = ("STT", "Họ và tên", "Số CCCD", "MST", "Ngày sinh", "Số TK", "Gross (1)", "Thuế PIT (2)", "Thực nhận")


def test_roster_findings(spark):
    rows = sheet(
        ("Bảng kê",), HEAD, ("1", "An", "012345678901", "1", "1/2/1990", "777", "100", "10", "90"), ("2", "Bình", "12345678901", "2", "1990-02-01", "", "200", "20", "181"),
        ("3", "Chi", "012345678901", "3", "3/4/1991", "777", "", "", ""), ("Tổng cộng", None, None, None, None, None, "300", "31", None),
    )
    df = spark.createDataFrame(rows, ROWS)
    assert {r.field: r.col for r in roster.locate_columns(df).collect()} == {"stt": 0, "name": 1, "cccd": 2, "mst": 3, "dob": 4, "account": 5, "gross": 6, "pit": 7, "net": 8}
    people = roster.read_people(df)
    assert people.filter("not is_total").count() == 3
    got = {r.code: list(r.rows) for r in roster.findings(people).collect()}
    assert got == {
        "amount-missing": ["3"], "formula-mismatch": ["2"], "cccd-format": ["2"], "dob-format": ["2"], "account-missing": ["2"],
        "duplicate-cccd": ["1+3"], "duplicate-account": ["1+3"], "total-mismatch-pit": ["-1"], "total-missing-net": [],
    }


def test_sheet_choice_and_missing_columns(spark):
    rows = sheet(("a", "b"), name="notes") + sheet(HEAD, ("1",), name="list", idx=1) + sheet(HEAD[:4], ("1",), name="short", idx=2)
    best = roster.select_sheet(spark.createDataFrame(rows, ROWS)).first()
    assert best.sheet == "list"
    lacking = spark.range(1).select(roster.missing_required(F.array(F.lit("name"))).alias("x")).first().x
    assert lacking == ["cccd", "amount"]


def test_rows_until_blank(spark):
    df = spark.createDataFrame(sheet(("",), ("1",), ("2",), (" ", None), ("3",)), ROWS)
    assert [r.row for r in roster.rows_until_blank(df).orderBy("row").collect()] == [1, 2]


def test_segmentation_is_the_sequential_rule(spark):
    rng, rows = random.Random(3), []
    for k in range(200):
        rows += [(k, i, rng.choice([None, "a", "b", "contract"]), rng.random() < 0.5) for i in range(rng.randint(1, 9))]
    got = {(r.k, r.i): (r.segment, r.seg_kind, r.ordinal) for r in segments.segment_documents(spark.createDataFrame(rows, "k int, i int, kind string, top boolean"), ["k"], "i", "kind", "top").collect()}
    for k in range(200):
        open_, seg, seen = None, -1, {}
        for _, i, kind, top in [r for r in rows if r[0] == k]:
            if open_ is None or (kind is not None and (kind != open_ or top)):
                open_, seg = (kind or "contract") if open_ is None else kind, seg + 1
                seen[open_] = seen.get(open_, -1) + 1
            assert got[k, i] == (seg, open_, seen[open_])


def test_packets_from_covers(spark):
    starts = spark.createDataFrame([(0, 2), (0, 5), (0, 9)], "k int, page int")
    got = [(r.page_start, r.page_end) for r in segments.packet_bounds(starts, ["k"], "page", F.lit(12)).orderBy("page_start").collect()]
    assert got == [(2, 4), (5, 8), (9, 11)]


def test_nearest_start_and_consensus(spark):
    covers, starts = [(0, c) for c in (11, 19, 27, 90)], [(0, s) for s in (8, 16, 24)]
    found = segments.nearest_start(spark.createDataFrame(covers, "k int, page int"), spark.createDataFrame(starts, "k int, page int"), ["k"], "page", "page")
    assert {r.page: r.found_start for r in found.collect()} == {11: 8, 19: 16, 27: 24, 90: None}
    offset = segments.consensus_offset(found, ["k"], "page")
    assert offset.first().offset == 3
    moved = segments.snapped(spark.createDataFrame(covers + [(0, 2)], "k int, page int"), offset, ["k"], "page")
    assert sorted(r.page for r in moved.collect()) == [2, 8, 16, 24, 87]


def test_largest_gap_takes_the_first_of_equal_ones(spark):
    scores = spark.createDataFrame([(0, i, s) for i, s in enumerate([1.0, 3.0, 5.0, 5.5])] + [(1, 9, 2.0)], "k int, i int, s double")
    got = {r.k: r.threshold for r in segments.largest_gap(scores, ["k"], "s", "i").collect()}
    assert got == {0: 2.0, 1: 2.0}


def test_missed_starts(spark):
    starts = spark.createDataFrame([(0, s) for s in (0, 8, 16, 32)], "k int, page int")
    bounds = segments.packet_bounds(starts, ["k"], "page", F.lit(48))
    seen = spark.createDataFrame([(0, s) for s in (0, 8, 16, 24, 32, 40, 47)], "k int, page int")
    assert sorted(r.page for r in segments.missed_starts(bounds, seen, ["k"], "page").collect()) == [24, 40]


def test_prune_covers(spark):
    pages = [178, 186, 193, 197, 201, 209, 216]
    df = spark.createDataFrame([(0, p, 1.0, 6) for p in pages], "k int, page int, score double, expected int")
    assert sorted(r.page for r in segments.prune_covers(df, "k", "page", "score", "expected").collect()) == [178, 186, 193, 201, 209, 216]


def test_prune_covers_deals_submissions_in_batches(spark):
    rows = [(k, p, float(p % 7), len(set(pages)) - k % 4) for k in range(60) for pages in [[(k * 7 + i * i * 3 % 11 + i * 4) for i in range(9)]] for p in sorted(set(pages))] + [(99, 1, 1.0, None), (99, 2, 1.0, None)]
    df = segments.prune_covers(spark.createDataFrame(rows, "k int, page int, score double, expected int"), "k", "page", "score", "expected")
    assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().optimizedPlan().toString()

    def left(own, wanted):
        own = sorted(own)
        while wanted is not None and len(own) > wanted:
            gaps = [b[0] - a[0] for a, b in zip(own, own[1:])]
            far = sorted(g for g in gaps if g >= 5)
            typical = (far[(len(far) - 1) // 2] + far[len(far) // 2]) / 2 if far else 5
            options = [(gaps[i - 1], abs(gaps[i - 1] + (gaps[i] if i < len(gaps) else 0) - typical), own[i][1], i) for i in range(1, len(own)) if gaps[i - 1] < 5]
            if not options:
                break
            del own[min(options)[3]]
        return own

    want = [(k, p) for k in {r[0] for r in rows} for p, _ in left([(r[1], r[2]) for r in rows if r[0] == k], next(r[3] for r in rows if r[0] == k))]
    assert sorted((r.k, r.page) for r in df.collect()) == sorted(want)


def test_line_grouping_is_the_greedy_fold(spark):
    rng = random.Random(4)
    pages = [[(rng.randint(0, 50), rng.randint(0, 60), i) for i in range(rng.randint(1, 15))] for _ in range(60)]
    df = spark.createDataFrame([(k, [dict(x=x, y=y, w=1, h=1, id=i) for x, y, i in p]) for k, p in enumerate(pages)], "k int, words array<struct<x:int,y:int,w:int,h:int,id:int>>")
    for r in df.select("k", segments.group_lines(F.col("words")).alias("lines")).collect():
        lines = []
        for w in sorted(pages[r.k], key=lambda w: w[1]):
            if lines and abs(w[1] - lines[-1][0][1]) <= 8:
                lines[-1].append(w)
            else:
                lines.append([w])
        assert [[w.id for w in line] for line in r.lines] == [[w[2] for w in sorted(line, key=lambda w: w[0])] for line in lines]


def test_page_kinds(spark):
    pages = ["BIÊN BẢN NGHIỆM THU\nnội dung", "HỢP ĐỒNG DỊCH VỤ\nx\ny", "ĐÔNG\nHỢP DỊCH VỤ\nx", "theo Hợp đồng dịch vụ số 1", "bảng\nhttp://gdt.gov.vn/x", "CĂN CƯỚC CÔNG DÂN", "thường", None]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, t string")
    got = [r.x for r in df.select("i", segments.classify_page(F.col("t")).alias("x")).orderBy("i").collect()]
    assert got == ["bbnt", "contract", "contract", None, "pit", "id_front", None, None]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_cards(spark):
    d = spark.createDataFrame([("a", 1, "front"), ("b", 5, "back"), ("c", 1, "front"), ("e", 1, None)], "drawing_id string, x int, side string")
    parts = spark.createDataFrame([("a", "a"), ("b", "a")], "node string, component string")
    got = {(r.front, r.back, r.single, r.issue) for r in cards.card_candidates(d, parts).collect()}
    assert got == {("a", "b", None, None), ("c", None, None, None), (None, None, "e", None)}


def test_card_resolution(spark):
    people = spark.createDataFrame([(0, "012345678901", "Lê An"), (1, "012345678902", "Trần Bình"), (2, "", "Võ Chi")], "row int, cccd string, name string")
    read = spark.createDataFrame([
        ("k1", "012345678901", 0.9, True, "le an", 0.9), ("k2", "012345678902", 0.5, True, "Tran Binh", 0.9), ("k3", "", 0.0, False, "Vo Chi", 0.9), ("k4", "012345678999", 0.9, True, "x", 0.1),
    ], "card_id string, number string, number_confidence double, located boolean, name string, name_confidence double")
    got = {r.card_id: (r.state, r.matched_row) for r in cards.resolve_cards(read, people).collect()}
    assert got == {"k1": ("exact", 0), "k2": ("suggested", 1), "k3": ("manual", None), "k4": ("manual", None)}


def packet(spark, roster_row=None, docs=(), sources=()):
    packets = spark.createDataFrame([("c", 0, roster_row is not None, roster_row or {})], "case_id string, packet int, matched boolean, roster map<string,string>")
    documents = spark.createDataFrame([("c", 0, f"{k}-{i}", k) for i, k in enumerate(docs)], "case_id string, packet int, doc_id string, kind string")
    values = spark.createDataFrame([("c", 0, f, d, v) for f, d, v in sources], "case_id string, packet int, field_key string, doc_id string, value string")
    return evaluate.evaluate(packets, documents, values)


CLEAN = {"name": "Lê An", "cccd": "012345678901", "mst": "0123456789", "dob": "1/2/1990", "gender": "Nam", "account": "777", "gross": "100", "pit": "10", "net": "90"}


def test_empty_packet_passes_only_the_amounts(spark):
    results = evaluate.criterion_results(packet(spark, CLEAN))
    got = {r.stt: r.status for r in results.collect()}
    assert len(got) == 25 and {k for k, s in got.items() if s == "ok"} == {16, 17}
    assert sum(s == "missing" for s in got.values()) > 9


def test_zero_tax_needs_a_pledge(spark):
    row = CLEAN | {"pit": "0", "net": "100"}
    state = lambda docs: {r.stt: r.status for r in packet(spark, row, docs).filter("stt in (15, 18)").collect()}
    assert state(()) == {15: "no", 18: "na"} and state(("commitment",)) == {15: "ok", 18: "rv"}


def test_copies_and_reasons(spark):
    cells = packet(spark, CLEAN, ("contract", "contract", "id_front"), [("hoten", "contract-0", "LE AN"), ("hoten", "contract-1", ""), ("cccd", "contract-0", "012345678901"), ("cccd", "contract-1", "999"), ("hoten", "id_front-2", "")])
    got = {(r.stt, r.document): (r.status, r.pending_reason) for r in cells.collect()}
    assert got[1, evaluate.CONTRACT] == ("rv", None) and got[2, evaluate.CONTRACT] == ("no", None) and got[1, evaluate.ID] == ("pending", "unread")
    assert got[1, evaluate.BBNT] == ("missing", None) and got[9, evaluate.APPENDIX] == ("na", None) and got[1, evaluate.LISTING] == ("pending", "roster-level")
    assert {r.pending_reason for r in packet(spark).filter("document = 'Excel' and stt = 1").collect()} == {"unmatched"}


def test_what_settles_without_a_person(spark):
    says = lambda cells: {r.stt: r.automatic for r in evaluate.criterion_results(cells).collect()}
    bare = says(packet(spark, CLEAN))
    assert {k for k, v in bare.items() if v} == {1, 2, 3, 5, 7, 12, 14, 15, 16, 17} - {15}  # tax above zero has no check of its own
    assert says(packet(spark, CLEAN | {"pit": "0"}))[15] and says(packet(spark))[17]
    docs = spark.createDataFrame([("c", 0, "k", "contract")], "case_id string, packet int, doc_id string, kind string")
    reads = spark.createDataFrame([("c", 0, "bank", "k", "v", True, 1.0)], "case_id string, packet int, part string, doc_id string, value string, located boolean, confidence double")
    people = spark.createDataFrame([("c", 0, True, CLEAN)], "case_id string, packet int, matched boolean, roster map<string,string>")
    none = spark.createDataFrame([], "case_id string, packet int, field_key string, doc_id string, value string")
    read = says(evaluate.evaluate(people, docs, none, evaluate.parts_cells(reads, docs)))
    assert read[8] and not read[13] and not bare[8]
    touched = spark.createDataFrame([("c", 0, 1), ("c", 0, 2)], "case_id string, packet int, stt int")
    cells = packet(spark, CLEAN)
    assert evaluate.packet_rollup(cells).first().findings - evaluate.packet_rollup(cells, touched).first().findings == 2


def test_rollup(spark):
    r = evaluate.packet_rollup(packet(spark, CLEAN, ("commitment",))).first()
    assert r.has_commitment and r.ai_status == "missing" and evaluate.CONTRACT in r.missing


def test_review_lists(spark):
    reasons = spark.range(1).select(review.attention_reasons(F.lit("unmatched"), F.array(F.lit("near-threshold"), F.lit("roster-unmatched"))).alias("x")).first().x
    assert reasons == ["not on the roster", "uncertain boundary"]
    a = spark.createDataFrame([("c", 1, "x", "ok")], "case_id string, packet int, item string, status string")
    rows = review.report_rows(a, a.drop("item"))
    assert rows.columns == list(review.REPORT) and rows.count() == 2
    text = review.markdown(a, ["case_id"], F.concat(F.lit("- "), "item"), ["packet"]).first().text
    assert text == "- x"


def test_card_packets_and_sheet_evidence(spark):
    resolved = spark.createDataFrame([("k1", "exact", 0), ("k2", "suggested", 0), ("k3", "exact", 1), ("k4", "exact", 2)], "card_id string, state string, matched_row int")
    people = spark.createDataFrame([(0, "012345678901", "1", "An"), (1, "123", "2", "Binh"), (2, "012345678903", "3", "Chi")], "row int, cccd string, mst string, name string")
    packets = spark.createDataFrame([(0, "012345678901"), (1, "012345678903"), (2, "012345678903")], "packet int, cccd string")
    got = {r.card_id: (r.packet, r.reason) for r in cards.card_packets(resolved, people, packets).collect()}
    assert got == {"k1": (0, None), "k2": (None, "not-exact"), "k3": (None, "row-id-unusable"), "k4": (None, "several-packets")}
    sheet_people = spark.createDataFrame([("s", 4, "012345678901", "", ""), ("s", 5, "", "3", ""), ("s", 6, "", "", "")], "sheet string, row int, cccd string, mst string, name string")
    drawings = spark.createDataFrame([("d1", "s", 4), ("d2", "s", 5), ("d3", "s", 6), ("d4", "t", 4)], "drawing_id string, sheet string, center_row int")
    found = cards.sheet_evidence(drawings, sheet_people, people, packets)
    assert {r.drawing_id: (r.packet, r.reason) for r in found.collect()} == {"d1": (0, None), "d2": (None, "several-packets"), "d3": (None, "no-person-on-row"), "d4": (None, "no-person-on-row")}
    total = cards.evidence_summary(found.withColumn("c", F.lit(1)), ["c"]).first()
    assert (total.attached, total.refused, total.reasons) == (1, 3, ["no-person-on-row", "several-packets"])
    linked = cards.cards_by_packet(packets, spark.createDataFrame([("k1", 0), ("k9", 7)], "card_id string, packet int"))
    assert sorted((str(r.packet), str(r.card_id), r.floating) for r in linked.collect()) == [("0", "k1", False), ("1", "None", False), ("2", "None", False), ("None", "k9", True)]


def test_fuzzy_window_and_parts(spark):

    text = "mot hai ba ben cung cap dich vu thuc hien cong viec theo hop dong so 12 ky ngay"
    df = spark.createDataFrame([(text, "cung cap dich vu thuc hien cong viec theo hop dong"), (text, "cung cep dich vu thuc hien cong viec theo hop dong"), (text, "cung cap dich vu thuc hien cong viec theo hop dong so 13"), (text, "ngan")], "t string, q string")
    got = [(r.w.start, r.w.words) if r.w.start is not None else None for r in df.select(quotes.best_window(F.split("t", " "), "q").alias("w")).collect()]
    assert got == [(4, 11), (4, 11), (4, 13), None]  # whether digits agree is asked afterwards
    reads = F.create_map(F.lit("bank"), F.struct(F.lit("x").alias("value"), F.lit(True).alias("located")), F.lit("branch"), F.struct(F.lit("y").alias("value"), F.lit(False).alias("located")))
    x = spark.range(1).select(quotes.parts_coverage(["bank", "branch", "province"], reads).alias("x")).first().x
    assert (x.found, x.missing, x.unplaced, x.coverage) == (["bank"], ["province"], ["branch"], "partial")


def test_batch_results(spark):
    found = spark.createDataFrame([("a", "duplicate-cccd"), ("b", "total-mismatch-net"), ("c", "no-total-row")], "case_id string, code string")
    every = spark.createDataFrame([("a", True), ("b", True), ("c", True), ("d", False)], "case_id string, has_roster boolean")
    packets = spark.createDataFrame([("a", 0, "1", "x"), ("a", 1, "1", "y"), ("b", 0, "1", "x"), ("c", 0, "", "")], "case_id string, packet int, cccd string, name string")
    got = {(r.case_id, r.stt): r.status for r in evaluate.batch_results(found, every, packets).collect()}
    assert [got[c, 20] for c in "abcd"] == ["ok", "no", "pending", "pending"] and [got[c, 30] for c in "abcd"] == ["no", "ok", "ok", "pending"]
    assert [got[c, 31] for c in "abcd"] == ["no", "ok", "pending", "pending"] and {got[c, 26] for c in "abcd"} == {"rv"} and {got[c, 32] for c in "abcd"} == {"pending"}


def test_packet_names_and_gaps(spark):
    name = spark.range(1).select(segments.packet_filename(F.lit(0), F.lit("Lê Văn Đức"), F.lit(2), F.lit(8)).alias("x")).first().x
    assert name == "0001-le-van-duc_p3-9.pdf"
    gaps = segments.missing_numbers(spark.createDataFrame([(0, 2), (0, 3), (0, 7)], "k int, n int"), ["k"], "n")
    assert sorted((r.low, r.high) for r in gaps.collect()) == [(1, 1), (4, 6)]


def test_parts_cells(spark):
    parts = {8: ((evaluate.CONTRACT,), ("bank", "branch"))}
    docs = spark.createDataFrame([("c", k, f"d{n}", "contract") for k, n in ((0, 0), (1, 0), (2, 0), (2, 1), (3, 0), (4, 0))], "case_id string, packet int, doc_id string, kind string")
    reads = [(0, "bank", 1.0, True), (0, "branch", 1.0, True), (1, "bank", 1.0, True), (1, "branch", 0.9, True), (2, "bank", 1.0, True), (2, "branch", 1.0, True), (3, "bank", 1.0, True), (3, "branch", 1.0, False), (4, "other", 1.0, True)]
    df = spark.createDataFrame([("c", k, p, "d0", "x", at, conf) for k, p, conf, at in reads], "case_id string, packet int, part string, doc_id string, value string, located boolean, confidence double")
    cells = evaluate.parts_cells(df, docs, parts)
    assert {r.packet: r.status for r in cells.collect()} == {0: "ok", 1: "rv", 2: "rv", 3: "rv"}
    people = spark.createDataFrame([("c", k, True, {"name": "An"}) for k in range(5)], "case_id string, packet int, matched boolean, roster map<string, string>")
    none = spark.createDataFrame([], "case_id string, packet int, field_key string, doc_id string, value string")
    got = {r.packet: (r.status, r.pending_reason) for r in evaluate.evaluate(people, docs, none, cells).filter(f"stt = 8 and document = '{evaluate.CONTRACT}'").collect()}
    assert got == {0: ("ok", None), 1: ("rv", None), 2: ("rv", None), 3: ("rv", None), 4: ("pending", "not-automated")}
    assert evaluate.requested_parts()[evaluate.CONTRACT] == ("bank", "branch", "province", "amount_basis", "term", "term_start", "method", "account")


def test_misreads_are_reviewed(spark):
    near = {0: "MSTTNCN : 0123 456 789 Ngày sinh", 1: "MSTTNCN : 0999 Số CCCD 0123456789", 2: "so tai khoan 0123456789", 3: ""}
    people = spark.createDataFrame([("c", k, True, {"mst": "0123456789"}) for k in near], "case_id string, packet int, matched boolean, roster map<string, string>")
    docs = spark.createDataFrame([("c", k, "d", "contract") for k in near], "case_id string, packet int, doc_id string, kind string")
    sources = spark.createDataFrame([("c", k, "mst", "d", "0123456780", n) for k, n in near.items()], "case_id string, packet int, field_key string, doc_id string, value string, near string")
    got = {r.packet: r.status for r in evaluate.evaluate(people, docs, sources).filter(f"stt = 5 and document = '{evaluate.CONTRACT}'").collect()}
    assert got == {0: "rv", 1: "rv", 2: "no", 3: "no"}


def test_amounts_that_no_document_can_agree_with(spark):
    cells = packet(spark, CLEAN | {"gross": "0", "pit": "10", "net": "-10"}, ("contract",), [("phi", "contract-0", "0")])
    got = {(r.stt, r.document): (r.status, r.pending_reason) for r in cells.collect()}
    assert {s for (n, _), s in got.items() if n == 14} == {("no", None)} and got[15, evaluate.EXCEL] == ("pending", "not-automated") and got[16, evaluate.EXCEL] == ("no", None)


def test_unions_of_dealt_tables_join_right(spark):
    """Two windows by one key, their union, and an outer self-join: each key finds its own row."""
    from pyspark.sql import Window

    spark.conf.unset("spark.sql.unionOutputPartitioning")
    w = Window.partitionBy("k").orderBy("i")
    rows = spark.range(4000).select((F.col("id") % 40).alias("k"), F.col("id").alias("i"), (F.col("id") % 3 == 0).alias("cover")).withColumn("page", F.row_number().over(w) - 1)
    found = segments.nearest_start(rows.filter("cover"), rows.filter("not cover"), ["k"], "page", "page")
    offsets = segments.consensus_offset(found, ["k"], "page", 0.1, 0.1)
    assert {r.k: r.offset for r in offsets.collect()} == {k: 1 for k in range(40)}
    assert all(r.offset == 1 for k in range(0, 40, 7) for r in offsets.filter(f"k = {k}").collect())


def test_quotes_are_located_exactly_before_nearly(spark):
    text = "Bên B cung cấp dịch vụ theo hợp đồng số 15 ngày 1 tháng 2"
    pages = spark.createDataFrame([("d", 0, "mở đầu " + text.replace("cung", "cunq") + " hết"), ("d", 1, "x " + text), ("d", 2, text + " y"), ("e", 0, text.replace("cung", "cunq")), ("f", 0, text.replace("15", "16"))], "doc string, page int, text string")
    asked = spark.createDataFrame([(1, "d", text, 0), (2, "d", text, 2), (3, "e", text, 0), (4, "f", text, 0), (5, "d", "cung cấp dịch vụ", 1), (6, "d", "a " * 61, 1), (7, "d", "1 - 2 - 3 - 4", 1)], "id int, doc string, quote string, claimed int")
    got = {r.id: (r.page, r.exact) for r in quotes.locate_quotes(asked, pages, "doc", "id", "quote", "claimed", "page", "text").collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (0, False)}


def test_card_resolution_tells_why(spark):
    people = spark.createDataFrame([(0, "012345678901", "An"), (1, "012345678902", "Binh"), (2, "012345678903", "Chi"), (3, "012345678904", "Chi"), (4, "012345678905", "Dung"), (5, "012345678905", "Em"), (6, "012345678906", "Gia"), (7, "012345678907", "Ha")], "row int, cccd string, name string")
    cases = {
        "front": ("", 0.0, True, "", 0.0, False, None), "pair": ("012345678901", 0.9, True, "", 0.0, True, "layout-conflict"), "short": ("123", 0.9, True, "", 0.0, True, None), "twins": ("012345678905", 0.9, True, "", 0.0, True, None),
        "namesake": ("012345678903", 0.9, True, "", 0.0, True, None), "differ": ("012345678902", 0.9, True, "Gia", 0.9, True, None), "rival": ("012345678906", 0.9, True, "", 0.0, True, None), "low": ("012345678907", 0.5, True, "", 0.0, True, None),
        "blank": ("", 0.0, True, "", 0.0, True, None), "nobody": ("999999999999", 0.9, True, "", 0.0, True, None), "no place": ("012345678901", 0.9, False, "An", 0.9, True, None), "hidden": ("012345678901", 0.9, False, "", 0.0, True, None),
    }
    df = spark.createDataFrame([(k, *v) for k, v in cases.items()], "card_id string, number string, number_confidence double, located boolean, name string, name_confidence double, front boolean, blocked string")
    got = {r.card_id: (r.state, r.matched_row, *r.issues) for r in cards.resolve_cards(df, people).collect()}
    assert got == {
        "front": ("manual", None, "no-front"), "pair": ("conflict", None, "layout-conflict"), "short": ("manual", None, "non-12-digit-cccd"), "twins": ("conflict", None, "duplicate-cccd"), "namesake": ("conflict", None, "duplicate-name"),
        "differ": ("conflict", None, "conflicting-identity"), "rival": ("conflict", None, "competing-candidate"), "low": ("manual", None, "low-cccd-confidence"), "blank": ("manual", None, "unreadable-identity"), "nobody": ("manual", None, "no-exact-roster-match"),
        "no place": ("suggested", 0, "no-number-region"), "hidden": ("manual", None, "no-number-region"),
    }
