"""A page's boxes meet its blocks by height: no task passes all boxes of a page."""

from proofsheet.operators import layout


def test_a_page_is_passed_by_its_heights(spark):
    boxes = spark.createDataFrame([(p, i, i % 50, i % 3, 4, 2) for p in (0, None) for i in range(300)], "page int, id int, x int, y int, width int, height int")
    blocks = spark.createDataFrame([(0, 5, 1, 2, 20), (0, 3, 1, 2, 30), (0, 9, 1, 3, 10), (None, 1, 0, 9, 25)], "page int, n int, top int, bottom int, gutter int")
    got = layout.party_boxes(boxes, blocks, ["page"], "n")
    rows = {(r.page, r.id): r.party for r in got.collect()}
    gutter = {0: 30, 1: 30, 2: 10}  # middles 1, 2 and 3
    assert rows == {(p, i): None if p is None else "a" if i % 50 + 4 <= gutter[i % 3] else "b" if i % 50 >= gutter[i % 3] else "straddle" for p in (0, None) for i in range(300)}
    windows = [line for line in got._jdf.queryExecution().analyzed().toString().splitlines() if "Window [last(" in line]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Window [last("):]
    assert windows and "width#" not in below.split("LogicalRDD")[0] and "Join LeftOuter" in plan[:plan.index("Window [last(")]
