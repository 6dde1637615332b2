from pyspark.sql import functions as F

from ledgerleaf.functions import geometry
from ledgerleaf.functions.geometry import box
from ledgerleaf.operators import layout

SCHEMA = "element_id string, doc_id string, page int, idx int, kind string, ymin int, xmin int, ymax int, xmax int"


def frame(spark, rows):
    return spark.createDataFrame([(f"e{i}", "d", 1, i, *r) for i, r in enumerate(rows)], SCHEMA)


def test_touching_boxes_have_no_overlap(spark):
    e = frame(spark, [("TEXT", 0, 0, 10, 10), ("TEXT", 10, 0, 20, 10), ("TEXT", 0, 0, 10, 10)])
    got = {(r.a, r.b): r.iou for r in layout.overlapping_pairs(e, -1).collect()}
    assert got == {(0, 1): 0.0, (0, 2): 1.0, (1, 2): 0.0}


def test_invalid_and_repeated_rows_are_dropped(spark):
    e = spark.createDataFrame([("a", "d", 1, 0, "TEXT", 0, 0, 1, None), ("b", "d", 1, 1, None, 0, 0, 1, 1), ("c", "d", 1, 2, "TEXT", 0, 0, 1, 1), ("c", "d", 1, 2, "TEXT", 0, 0, 1, 1)], SCHEMA)
    assert [r.element_id for r in layout.valid(e).collect()] == ["c"]


def test_smallest_region_wins_and_ties_go_to_the_earlier(spark):
    regions = frame(spark, [("TEXT", 0, 0, 100, 100), ("TEXT", 0, 0, 50, 50), ("TEXT", 0, 0, 50, 50)])
    lines = spark.createDataFrame([("d", 1, 0, 0, 0, 10, 10, "x"), ("d", 1, 1, 300, 300, 310, 310, "y")], "doc_id string, page int, line int, ymin int, xmin int, ymax int, xmax int, content string")
    assert {r.line: r.region for r in layout.lines_in_regions(lines, regions).collect()} == {0: 1, 1: None}


def test_an_element_no_block_meets_keeps_its_box(spark):
    e = frame(spark, [("TABLE", 500, 500, 600, 600)])
    r = layout.refined_boxes(e, frame(spark, [("TEXT", 0, 0, 10, 10)])).first()
    assert (r.new_ymin, r.new_xmin, r.new_ymax, r.new_xmax, r.refined) == (500, 500, 600, 600, False)


def greedy(rows):
    used, out = set(), []
    for v, (k, y0, x0, y1, x1) in enumerate(rows):
        if k not in ("TABLE", "FIGURE"):
            continue
        best = None
        for c, (kk, a0, b0, a1, b1) in enumerate(rows):
            if kk not in ("TEXT", "CAPTION") or c in used or abs((x0 + x1) / 2 - (b0 + b1) / 2) > 200:
                continue
            gap = a0 - y1 if a0 >= y1 else y0 - a1 if y0 >= a1 else None
            if gap is not None and gap < 50 and (best is None or gap < best[0]):
                best = (gap, c)
        if best:
            used.add(best[1])
            out.append((v, best[1]))
    return out


def test_captions_are_matched_greedily(spark):
    import random

    rnd = random.Random(3)
    rows = []
    for _ in range(60):
        y, x = rnd.randrange(900), rnd.randrange(600)
        rows.append((rnd.choice(["TABLE", "FIGURE", "TEXT", "CAPTION", "HEADER"]), y, x, y + rnd.randrange(10, 80), x + rnd.randrange(50, 300)))
    got = sorted((r.visual, r.caption) for r in layout.matched_captions(frame(spark, rows)).collect())
    assert got == greedy(rows) and got


def test_two_column_merge_puts_ties_to_the_right(spark):
    rows = [("HEADER", 500, 0, 510, 900)] + [("TEXT", y, x, y + 10, x + 100) for y in (10, 30) for x in (0, 800)] + [("TEXT", 50, 0, 60, 100)]
    order = [r.idx for r in layout.reading_order(frame(spark, rows)).orderBy("place").collect()]
    assert order[:3] == [0, 2, 1]


def test_pixels_truncate(spark):
    e = frame(spark, [("TEXT", 1, 999, 3, 1000)])
    assert tuple(e.select(*geometry.to_pixels(box(), 1500, 999)).first()) == (1498, 0, 1500, 2)


def test_empty_page_tables(spark):
    e = spark.createDataFrame([], SCHEMA)
    for out in (layout.overlapping_pairs(e), layout.reading_order(e), layout.matched_captions(e), layout.two_columns(e), layout.page_kinds(e), layout.section_anchors(layout.reading_order(e).withColumn("content", F.lit("x")))):
        assert out.count() == 0
