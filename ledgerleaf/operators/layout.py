"""Operators on layout elements: validity, overlaps, reading order, captions, lines in regions, section anchors.

Elements have ``doc_id, page, idx, kind, ymin, xmin, ymax, xmax`` (0 to 1000). Joins carry the page as equi-key, so that the theta condition is
a residual of a hash or merge join over the few boxes of a page. Elements without a coordinate are invalid and dropped by ``valid``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.functions import geometry, text
from ledgerleaf.functions.geometry import box

PAGE = ["doc_id", "page"]
VISUALS = ("TABLE", "FIGURE", "CHART")


def valid(elements: DataFrame) -> DataFrame:
    """Elements with a type and four coordinates; repeated rows once."""
    have = F.col("kind").isNotNull()
    for c in ("ymin", "xmin", "ymax", "xmax"):
        have = have & F.col(c).isNotNull()
    return elements.where(have).dropDuplicates(["element_id"])


def routed(kind: Column) -> Column:
    """Which extractor an element goes to."""
    return F.when(kind.isin(*VISUALS), "vision").otherwise("text")


def client_routed(kind: Column) -> Column:
    """The client's routing, which has no place for charts and captions."""
    return F.when(kind.isin("TEXT", "HEADER", "FOOTER"), "text").when(kind.isin("TABLE", "FIGURE"), "vision")


def overlapping_pairs(elements: DataFrame, more_than: float = 0.3) -> DataFrame:
    """``doc_id, page, a, b, iou`` of elements of a page (a before b) whose IoU exceeds the bound."""
    a = elements.select(*PAGE, F.col("idx").alias("a"), *(F.col(c).alias("l_" + c) for c in box()._fields))
    b = elements.select(*PAGE, F.col("idx").alias("b"), *(F.col(c).alias("r_" + c) for c in box()._fields))
    pairs = a.join(b, PAGE).where(F.col("a") < F.col("b")).withColumn("iou", geometry.iou(box("l_"), box("r_")))
    return pairs.where(F.col("iou") > more_than).select(*PAGE, "a", "b", "iou")


def with_overlap_flag(elements: DataFrame, more_than: float = 0.3) -> DataFrame:
    """Elements with ``has_overlap``."""
    hit = overlapping_pairs(elements, more_than).select(*PAGE, F.explode(F.array("a", "b")).alias("idx")).distinct().withColumn("has_overlap", F.lit(True))
    return elements.join(hit, [*PAGE, "idx"], "left").withColumn("has_overlap", F.coalesce("has_overlap", F.lit(False)))


def merged_with_images(layout: DataFrame, images: DataFrame, most: float = 0.5) -> DataFrame:
    """The layout and those images that cover no FIGURE of it by an IoU over the bound; all have the layout's columns."""
    figures = layout.where("kind = 'FIGURE'").select(*(F.col(c).alias("f_" + c) for c in (*PAGE, *box()._fields)))
    cond = (images.doc_id == figures.f_doc_id) & (images.page == figures.f_page) & (geometry.iou(box(), box("f_")) > most)
    return layout.unionByName(images.join(figures, cond, "left_anti"), allowMissingColumns=True)


def lines_in_regions(lines: DataFrame, regions: DataFrame, more_than: float = 0.5) -> DataFrame:
    """Every line with the smallest region that covers more than half of it, ``region`` null for none. Ties go to the earlier region.

    lines: ``doc_id, page, line`` and a box; regions: elements.
    """
    r = regions.select(*PAGE, F.col("idx").alias("region"), *(F.col(c).alias("r_" + c) for c in box()._fields))
    hit = lines.join(r, PAGE).where(geometry.coverage(box(), box("r_")) > more_than)
    best = hit.groupBy(*PAGE, "line").agg(F.min_by("region", F.struct(box("r_").area, "r_ymin", "r_xmin", "region")).alias("region"))
    return lines.join(best, [*PAGE, "line"], "left")


def region_texts(assigned: DataFrame, content: str = "content") -> DataFrame:
    """``doc_id, page, region, text``: the region's lines in order; lines of no region that aren't in the margin form one text with region -1."""
    region = F.coalesce("region", F.lit(-1))
    rows = assigned.where(F.col("region").isNotNull() | ~geometry.in_margin(box()))
    joined = rows.groupBy(*PAGE, region.alias("region")).agg(F.sort_array(F.collect_list(F.struct("line", F.col(content).alias("c")))).alias("all"))
    return joined.select(*PAGE, "region", text.strip(F.array_join(F.transform("all", lambda x: x["c"]), "\n")).alias("text"))


def captions(targets: DataFrame, lines: DataFrame, radius: int = 100, sideways: int = 50, page: int = 1000) -> DataFrame:
    """``doc_id, page, idx, caption``: lines around a target that start like a caption, in order, joined by ``" | "``."""
    near = geometry.Box(F.greatest(F.lit(0), F.col("t_ymin") - radius), F.greatest(F.lit(0), F.col("t_xmin") - sideways), F.least(F.lit(page), F.col("t_ymax") + radius), F.least(F.lit(page), F.col("t_xmax") + sideways))
    t = targets.select(*PAGE, "idx", *(F.col(c).alias("t_" + c) for c in box()._fields))
    hit = lines.where(text.is_caption(F.col("content"))).join(t, PAGE).where(geometry.coverage(box(), near) > 0.5)
    found = hit.groupBy(*PAGE, "idx").agg(F.sort_array(F.collect_list(F.struct("line", "content"))).alias("all"))
    return found.select(*PAGE, "idx", F.array_join(F.transform("all", lambda x: text.strip(x["content"])), " | ").alias("caption"))


def matched_captions(elements: DataFrame, sideways: int = 200, gap: int = 50) -> DataFrame:
    """``doc_id, page, visual, caption``: each TABLE or FIGURE, in order, takes the nearest unused TEXT or CAPTION.

    Nearest is the least vertical gap in [0, gap) among those whose centres are at most ``sideways`` apart. Boxes that overlap vertically are
    no match. Which is taken depends on what is taken before, so the greedy choice runs over a page's candidate pairs; those are
    found by a join, and a page with one pair per visual and caption needs none of it. A page's pairs are read as a stream.
    """
    v = elements.where(F.col("kind").isin("TABLE", "FIGURE")).select(*PAGE, F.col("idx").alias("visual"), *(F.col(c).alias("v_" + c) for c in box()._fields))
    c = elements.where(F.col("kind").isin("TEXT", "CAPTION")).select(*PAGE, F.col("idx").alias("caption"), *(F.col(x).alias("c_" + x) for x in box()._fields))
    below, above = F.col("c_ymin") - F.col("v_ymax"), F.col("v_ymin") - F.col("c_ymax")
    pairs = v.join(c, PAGE).where(F.abs(box("v_").center_x - box("c_").center_x) <= sideways)
    pairs = pairs.withColumn("gap", F.when(below >= 0, below).when(above >= 0, above)).where(F.col("gap") < gap).select(*PAGE, "visual", "caption", "gap")

    def greedy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page, used, current, best = None, set(), None, None
        for batch in batches:
            out = []
            for doc, number, visual, caption, distance in batch.itertuples(index=False):
                if ((doc, number), visual) != (page, current):
                    if best is not None:
                        out.append((*page, current, best))
                        used.add(best)
                    if (doc, number) != page:
                        page, used = (doc, number), set()
                    current, best = visual, None
                if best is None and caption not in used:
                    best = caption
            yield pd.DataFrame(out, columns=["doc_id", "page", "visual", "caption"])
        if best is not None:
            yield pd.DataFrame([(*page, current, best)], columns=["doc_id", "page", "visual", "caption"])

    ordered = pairs.repartition(*PAGE).sortWithinPartitions(*PAGE, "visual", "gap", "caption")
    return ordered.mapInPandas(greedy, "doc_id string, page int, visual int, caption int")


def two_columns(elements: DataFrame) -> DataFrame:
    """``doc_id, page, mid, multi``: whether a page's boxes stand in two columns, and the middle of their centres.

    True for at least three elements, two of them no headers, whose widest gap between sorted centres exceeds three times the mean gap.
    """
    body = elements.where("kind <> 'HEADER'").withColumn("x", box().center_x)
    w = Window.partitionBy(*PAGE).orderBy("x", "idx")
    gaps = body.withColumn("gap", F.col("x") - F.lag("x").over(w))
    stats = gaps.groupBy(*PAGE).agg(F.max("gap").alias("widest"), F.avg("gap").alias("mean"), F.count(F.lit(1)).alias("n_body"), ((F.min("x") + F.max("x")) / 2).alias("mid"))
    total = elements.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n"))
    multi = (F.col("n") >= 3) & (F.col("n_body") >= 2) & (F.col("widest") > 3 * F.col("mean"))
    return total.join(stats, PAGE, "left").select(*PAGE, "mid", F.coalesce(multi, F.lit(False)).alias("multi"), "widest", "mean")


def reading_order(elements: DataFrame) -> DataFrame:
    """Elements with ``place`` (from 0): headers first from the top, then the body, by rows or, on two-column pages, merged from both columns.

    A merge of two columns sorted from the top with ties to the right is an order by top edge, then right before left.
    """
    columns = two_columns(elements).select(*PAGE, "mid", "multi")
    e = elements.join(columns, PAGE, "left")
    head = F.col("kind") == "HEADER"
    left = F.when(F.col("multi") & (box().center_x < F.col("mid")), 1).otherwise(0)
    key = [F.when(head, 0).otherwise(1), F.col("ymin"), F.when(head, 0).when(F.col("multi"), left).otherwise(F.col("xmin")), F.when(head, 0).when(F.col("multi"), F.col("xmin")).otherwise(0), F.col("idx")]
    w = Window.partitionBy(*PAGE).orderBy(*key)
    return e.withColumn("place", F.row_number().over(w) - 1).drop("mid", "multi")


def section_anchors(ordered: DataFrame, content: str = "content", least: int = 5, default: str = "Document Content") -> DataFrame:
    """Elements with ``anchor``: the last header of more than ``least`` characters, across pages, until a footer that ends the section.

    Elements are in reading order, in which a page's headers precede its body, so its body gets the last of them.
    """
    c = text.strip(F.col(content))
    event = F.when((F.col("kind") == "HEADER") & (F.length(c) > least), c).when((F.col("kind") == "FOOTER") & text.ends_section(F.col(content)), F.lit(default))
    w = Window.partitionBy("doc_id").orderBy("page", "place").rowsBetween(Window.unboundedPreceding, 0)
    return ordered.withColumn("anchor", F.coalesce(F.last(event, ignorenulls=True).over(w), F.lit(default)))


def page_anchors(ordered: DataFrame, content: str = "content", least: int = 3, default: str = "Document Start") -> DataFrame:
    """Elements with ``anchor`` as the client sets it: it starts anew on every page and a header's own row already carries it."""
    c = text.strip(F.col(content))
    event = F.when((F.col("kind") == "HEADER") & (F.length(c) > least), c)
    w = Window.partitionBy(*PAGE).orderBy("ymin", "xmin", "idx").rowsBetween(Window.unboundedPreceding, 0)
    return ordered.withColumn("anchor", F.coalesce(F.last(event, ignorenulls=True).over(w), F.lit(default)))


def hierarchy(elements: DataFrame) -> DataFrame:
    """Elements by position with the constant section context the client gives."""
    w = Window.partitionBy(*PAGE).orderBy("ymin", "xmin", "idx")
    return elements.withColumn("position", F.row_number().over(w) - 1).withColumn("section_context", F.lit("Document Start"))


def title_sections(labels: DataFrame) -> DataFrame:
    """``context`` from titles and section headers: a title resets it, a section header gives ``Title > Section``; blanks change nothing.

    labels: ``doc_id, seq, label, content`` with labels Title and Section-header.
    """
    w = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    c = text.strip(F.col("content"))
    filled = c != ""
    title = F.last(F.when((F.col("label") == "Title") & filled, c), ignorenulls=True).over(w)
    made = labels.withColumn("_title", title)
    event = F.when((F.col("label") == "Title") & filled, c).when((F.col("label") == "Section-header") & filled, F.expr("trim(BOTH ' >' FROM concat(coalesce(_title, ''), ' > ', content))"))
    return made.withColumn("_event", event).withColumn("context", F.coalesce(F.last("_event", ignorenulls=True).over(w), F.lit("Document Start"))).drop("_title", "_event")


def refined_boxes(elements: DataFrame, blocks: DataFrame, padding: float = 2.0, least: float = 0.3) -> DataFrame:
    """Elements with the envelope of the text blocks that meet them, clipped and padded; kept as they were if under 30 % of the area is left.

    Adds ``new_ymin`` and so on and ``refined``.
    """
    b = blocks.select(*PAGE, *(F.col(c).alias("b_" + c) for c in box()._fields))
    hit = elements.join(b, PAGE).where(geometry.intersection(box(), box("b_")) > 0)
    env = hit.groupBy(*PAGE, "idx").agg(
        F.min(F.greatest("ymin", "b_ymin")).alias("e_ymin"), F.min(F.greatest("xmin", "b_xmin")).alias("e_xmin"), F.max(F.least("ymax", "b_ymax")).alias("e_ymax"), F.max(F.least("xmax", "b_xmax")).alias("e_xmax")
    )
    pad = F.lit(padding / 100 * 1000)
    lo = lambda c: F.greatest(F.lit(0.0), F.col("e_" + c) - pad).cast("int")
    hi = lambda c: F.least(F.lit(1000.0), F.col("e_" + c) + pad).cast("int")
    e = elements.join(env, [*PAGE, "idx"], "left").select("*", lo("ymin").alias("p_ymin"), lo("xmin").alias("p_xmin"), hi("ymax").alias("p_ymax"), hi("xmax").alias("p_xmax"))
    # greatest and least skip nulls, so an element that no block meets must be told apart here
    good = F.col("e_ymin").isNotNull() & F.coalesce(box("p_").area >= least * box().area, F.lit(False))
    return e.select(*elements.columns, *(F.when(good, F.col("p_" + c)).otherwise(F.col(c)).alias("new_" + c) for c in box()._fields), good.alias("refined"))


def page_kinds(elements: DataFrame, heavy: float = 0.5) -> DataFrame:
    """``doc_id, page, text_area, visual_area, page_kind``: data-heavy where visuals hold at least half of the covered area."""
    area = box().area
    sums = elements.groupBy(*PAGE).agg(F.sum(F.when(F.col("kind").isin(*VISUALS), area).otherwise(0)).alias("visual_area"), F.sum(F.when(F.col("kind").isin(*VISUALS), 0).otherwise(area)).alias("text_area"))
    return sums.select(*PAGE, "text_area", "visual_area", F.when(F.col("visual_area") >= heavy * (F.col("visual_area") + F.col("text_area")), "data_heavy").otherwise("text_heavy").alias("page_kind"))
