"""Queries on layout elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerleaf.functions import geometry, text
from ledgerleaf.functions.geometry import box
from ledgerleaf.operators import layout
from ledgerleaf.plans.common import BOXES, boxes, query

INTER = "case when least({a}.ymax, {b}.ymax) > greatest({a}.ymin, {b}.ymin) and least({a}.xmax, {b}.xmax) > greatest({a}.xmin, {b}.xmin) then (least({a}.ymax, {b}.ymax) - greatest({a}.ymin, {b}.ymin)) * (least({a}.xmax, {b}.xmax) - greatest({a}.xmin, {b}.xmin)) else 0 end"
AREA = "(({a}.ymax - {a}.ymin) * ({a}.xmax - {a}.xmin))"


def _inter(a: str, b: str) -> str:
    return INTER.format(a=a, b=b)


def _area(a: str) -> str:
    return AREA.format(a=a)


def _iou(a: str, b: str) -> str:
    u = f"({_area(a)} + {_area(b)} - ({_inter(a, b)}))"
    return f"case when {u} > 0 then cast({_inter(a, b)} as double) / {u} else 0.0 end"


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("f5_valid_layout", f"with {BOXES} select element_id, kind, ymin, xmin, ymax, xmax from boxes")
def f5_valid(spark: SparkSession, d: str) -> DataFrame:
    return boxes(spark, d).select("element_id", "kind", "ymin", "xmin", "ymax", "xmax")


@query(
    "f6_f8_f10_m2_m11_m12_m15_box_functions",
    f"""with {BOXES} select element_id, {_area("b")} / 10000.0 area_percentage, {_area("b")} / 10000.0 >= 1 large_enough, (b.ymin < 50 or b.ymax > 950) in_margin,
 case when kind in ('TABLE', 'FIGURE', 'CHART') then 'vision' else 'text' end route, case when kind in ('TEXT', 'HEADER', 'FOOTER') then 'text' when kind in ('TABLE', 'FIGURE') then 'vision' end client_route,
 cast(trunc(xmin / 1000.0 * 1240) as integer) x0, cast(trunc(ymin / 1000.0 * 1754) as integer) y0, cast(trunc(xmax / 1000.0 * 1240) as integer) x1, cast(trunc(ymax / 1000.0 * 1754) as integer) y1,
 cast(trunc((xmax - xmin + 1000) * least(1.0, 1600.0 / greatest(xmax - xmin + 1000, ymax - ymin + 1000))) as integer) crop_width,
 case when kind = 'HEADER' then 'blue' when kind = 'TABLE' then 'green' when kind in ('FIGURE', 'CHART') then 'orange' when kind = 'FOOTER' then 'gray' else 'black' end color from boxes b""",
)
def box_functions(spark: SparkSession, d: str) -> DataFrame:
    b, kind = box(), F.col("kind")
    px = geometry.to_pixels(b, 1240, 1754)
    width, _ = geometry.resized(b.xmax - b.xmin + 1000, b.ymax - b.ymin + 1000)
    return boxes(spark, d).select(
        "element_id", geometry.area_percentage(b).alias("area_percentage"), (geometry.area_percentage(b) >= 1).alias("large_enough"), geometry.in_margin(b).alias("in_margin"), layout.routed(kind).alias("route"),
        layout.client_routed(kind).alias("client_route"), px[0].alias("x0"), px[1].alias("y0"), px[2].alias("x1"), px[3].alias("y1"), width.alias("crop_width"),
        geometry.overlay_color(kind, F.lit(0.9), F.lit(False)).alias("color"),
    )


@query("s14_crop_rectangles", f"with {BOXES} select element_id, greatest(0, cast(trunc(xmin / 1000.0 * 1240) as integer) - 20) x0, greatest(0, cast(trunc(ymin / 1000.0 * 1754) as integer) - 20) y0, least(1240, cast(trunc(xmax / 1000.0 * 1240) as integer) + 20) x1, least(1754, cast(trunc(ymax / 1000.0 * 1754) as integer) + 20) y1 from boxes where kind in ('TABLE', 'FIGURE', 'CHART')")
def s14_crops(spark: SparkSession, d: str) -> DataFrame:
    c = geometry.crop(box(), 1240, 1754, 20)
    return boxes(spark, d).where(F.col("kind").isin(*layout.VISUALS)).select("element_id", *(x.alias(n) for x, n in zip(c, ("x0", "y0", "x1", "y1"))))


@query("f7_f9_header_footer_predicates", f"with {BOXES} select element_id, length(hint) > 5 long_enough, (kind = 'HEADER' and length(hint) > 5) is_anchor, (kind = 'FOOTER' and (contains(lower(hint), 'end of section') or contains(hint, '***') or contains(hint, '---'))) ends_section from boxes where hint is not null")
def f7_f9(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("hint")
    return boxes(spark, d).where(h.isNotNull()).select("element_id", (F.length(h) > 5).alias("long_enough"), ((F.col("kind") == "HEADER") & (F.length(h) > 5)).alias("is_anchor"), ((F.col("kind") == "FOOTER") & text.ends_section(h)).alias("ends_section"))


_J1 = f"select a.doc_id, a.page, a.idx a, b.idx b, {_iou('a', 'b')} iou from boxes a join boxes b on a.doc_id = b.doc_id and a.page = b.page and a.idx < b.idx"


@query("j1_m1_overlapping_pairs", f"with {BOXES} select doc_id, page, a, b, round(iou, 6) iou from ({_J1}) where iou > 0.05")
def j1(spark: SparkSession, d: str) -> DataFrame:
    """Pairs over 0.05, since few boxes of the test pages overlap by the default of 0.3."""
    return _rounded(layout.overlapping_pairs(boxes(spark, d), 0.05), "iou")


@query("j2_overlap_flags", f"with {BOXES}, pairs as (select * from ({_J1}) where iou > 0.05), hit as (select doc_id, page, a idx from pairs union select doc_id, page, b from pairs) select b.element_id, h.idx is not null has_overlap from boxes b left join hit h on h.doc_id = b.doc_id and h.page = b.page and h.idx = b.idx")
def j2(spark: SparkSession, d: str) -> DataFrame:
    return layout.with_overlap_flag(boxes(spark, d), 0.05).select("element_id", "has_overlap")


@query("a8_overlay_counts", f"with {BOXES} select (select count(*) from boxes) n_elements, (select count(*) from ({_J1}) where iou > 0.05) n_pairs")
def a8(spark: SparkSession, d: str) -> DataFrame:
    e = boxes(spark, d)
    both = e.select(F.lit(1).alias("e"), F.lit(0).alias("p")).unionByName(layout.overlapping_pairs(e, 0.05).select(F.lit(0).alias("e"), F.lit(1).alias("p")))
    return both.agg(F.sum("e").alias("n_elements"), F.sum("p").alias("n_pairs"))


@query(
    "j3_u1_images_merged",
    f"""with {BOXES}, images as (select element_id || '_img' element_id, doc_id, page, idx + 100 idx, 'IMAGE' kind, ymin, xmin, ymax - 5 ymax, xmax from boxes where kind in ('FIGURE', 'CHART'))
 select element_id, kind from boxes union all select i.element_id, i.kind from images i where not exists (select 1 from boxes b where b.kind = 'FIGURE' and b.doc_id = i.doc_id and b.page = i.page and {_iou('i', 'b')} > 0.5)""",
)
def j3(spark: SparkSession, d: str) -> DataFrame:
    e = boxes(spark, d)
    images = e.where(F.col("kind").isin("FIGURE", "CHART")).select(F.concat("element_id", F.lit("_img")).alias("element_id"), "doc_id", "page", (F.col("idx") + 100).alias("idx"), F.lit("IMAGE").alias("kind"), "ymin", "xmin", (F.col("ymax") - 5).alias("ymax"), "xmax")
    return layout.merged_with_images(e, images).select("element_id", "kind")


def _lines(e: DataFrame) -> DataFrame:
    """Upper thirds of text boxes as lines."""
    third = ((F.col("ymax") - F.col("ymin")) / 3).cast("int")
    return e.where("kind in ('TEXT', 'CAPTION')").select("doc_id", "page", F.col("idx").alias("line"), "ymin", "xmin", (F.col("ymin") + third).alias("ymax"), "xmax", F.concat(F.lit("Figure "), F.coalesce("hint", F.lit(""))).alias("content"))


LINES = "lines as (select doc_id, page, idx line, ymin, xmin, ymin + (ymax - ymin) // 3 ymax, xmax, 'Figure ' || coalesce(hint, '') content from boxes where kind in ('TEXT', 'CAPTION'))"
_J4 = f"""{BOXES}, {LINES}, hit as (select l.doc_id, l.page, l.line, b.idx region, row_number() over (partition by l.doc_id, l.page, l.line order by {_area('b')}, b.ymin, b.xmin, b.idx) r
 from lines l join boxes b on b.doc_id = l.doc_id and b.page = l.page where {_area('l')} > 0 and cast({_inter('l', 'b')} as double) / {_area('l')} > 0.5),
 assigned as (select l.*, h.region from lines l left join hit h on h.doc_id = l.doc_id and h.page = l.page and h.line = l.line and h.r = 1)"""


@query("j4_m3_lines_in_regions", f"with {_J4} select doc_id, page, line, region from assigned")
def j4(spark: SparkSession, d: str) -> DataFrame:
    e = boxes(spark, d)
    return layout.lines_in_regions(_lines(e), e).select("doc_id", "page", "line", "region")


@query("j5_a9_u3_region_texts", f"with {_J4} select doc_id, page, coalesce(region, -1) region, trim(string_agg(content, chr(10) order by line)) as text from assigned where region is not null or not (ymin < 50 or ymax > 950) group by all")
def j5(spark: SparkSession, d: str) -> DataFrame:
    """Lines against tables, figures and headers only would leave orphans; here all regions take part."""
    e = boxes(spark, d)
    return layout.region_texts(layout.lines_in_regions(_lines(e), e))


@query(
    "j6_captions_nearby",
    f"""with {BOXES}, {LINES}, near as (select doc_id, page, idx, greatest(0, ymin - 100) ymin, greatest(0, xmin - 50) xmin, least(1000, ymax + 100) ymax, least(1000, xmax + 50) xmax from boxes where kind in ('TABLE', 'FIGURE'))
 select n.doc_id, n.page, n.idx, string_agg(trim(l.content), ' | ' order by l.line) caption from near n join lines l on l.doc_id = n.doc_id and l.page = n.page where {_area('l')} > 0 and cast({_inter('l', 'n')} as double) / {_area('l')} > 0.5 group by all""",
)
def j6(spark: SparkSession, d: str) -> DataFrame:
    e = boxes(spark, d)
    return layout.captions(e.where("kind in ('TABLE', 'FIGURE')"), _lines(e))


@query(
    "j7_matched_captions",
    f"""with recursive {BOXES}, gaps as (select v.doc_id, v.page, v.idx visual, c.idx caption, case when c.ymin >= v.ymax then c.ymin - v.ymax when v.ymin >= c.ymax then v.ymin - c.ymax end gap
  from boxes v join boxes c on v.doc_id = c.doc_id and v.page = c.page and v.kind in ('TABLE', 'FIGURE') and c.kind in ('TEXT', 'CAPTION') and abs((v.xmin + v.xmax) / 2.0 - (c.xmin + c.xmax) / 2.0) <= 200),
 v as (select doc_id, page, visual, row_number() over (partition by doc_id, page order by visual) n, list(caption order by gap, caption) options from gaps where gap < 50 group by doc_id, page, visual),
 walk as (select doc_id, page, n, visual, options[1] pick, [options[1]] used from v where n = 1 union all
  select doc_id, page, n, visual, pick, list_append(used, pick) from (select v.doc_id, v.page, v.n, v.visual, w.used, list_filter(v.options, lambda c: not list_contains(w.used, c))[1] pick from walk w join v on v.doc_id = w.doc_id and v.page = w.page and v.n = w.n + 1))
 select doc_id, page, visual, pick caption from walk where pick is not null""",
)
def j7(spark: SparkSession, d: str) -> DataFrame:
    """Greedy: the SQL walks a page's visuals one by one; a test holds it against a plain loop too."""
    return layout.matched_captions(boxes(spark, d))


_T6 = f"""{BOXES}, gaps as (select doc_id, page, (xmin + xmax) / 2.0 x, (xmin + xmax) / 2.0 - lag((xmin + xmax) / 2.0) over (partition by doc_id, page order by (xmin + xmax) / 2.0, idx) gap from boxes where kind <> 'HEADER'),
 stats as (select doc_id, page, max(gap) widest, avg(gap) mean, count(*) n_body, (min(x) + max(x)) / 2.0 mid from gaps group by doc_id, page),
 total as (select doc_id, page, count(*) n from boxes group by doc_id, page),
 cols as (select t.doc_id, t.page, s.mid, s.widest, s.mean, coalesce(t.n >= 3 and s.n_body >= 2 and s.widest > 3 * s.mean, false) multi from total t left join stats s on s.doc_id = t.doc_id and s.page = t.page)"""


@query("t6_a11_two_columns", f"with {_T6} select doc_id, page, multi, round(widest, 6) widest, round(mean, 6) mean from cols")
def t6(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(layout.two_columns(boxes(spark, d)).select("doc_id", "page", "multi", "widest", "mean"), "widest", "mean")


_T5 = f"""{_T6}, placed as (select b.*, row_number() over (partition by b.doc_id, b.page order by case when kind = 'HEADER' then 0 else 1 end, b.ymin,
 case when kind = 'HEADER' then 0 when c.multi then case when (b.xmin + b.xmax) / 2.0 < c.mid then 1 else 0 end else b.xmin end, case when kind = 'HEADER' then 0 when c.multi then b.xmin else 0 end, b.idx) - 1 place
 from boxes b join cols c on c.doc_id = b.doc_id and c.page = b.page)"""


@query("t5_t7_w8_reading_order", f"with {_T5} select element_id, cast(place as integer) place from placed")
def t5(spark: SparkSession, d: str) -> DataFrame:
    return layout.reading_order(boxes(spark, d)).select("element_id", "place")


@query("t8_w4_hierarchy", f"with {BOXES} select element_id, cast(row_number() over (partition by doc_id, page order by ymin, xmin, idx) - 1 as integer) as position, 'Document Start' section_context from boxes")
def t8(spark: SparkSession, d: str) -> DataFrame:
    return layout.hierarchy(boxes(spark, d)).select("element_id", "position", "section_context")


@query(
    "w2_section_anchors",
    f"""with {_T5}, ev as (select *, case when kind = 'HEADER' and length(trim(hint)) > 5 then trim(hint) when kind = 'FOOTER' and (contains(lower(hint), 'end of section') or contains(hint, '***') or contains(hint, '---')) then 'Document Content' end event from placed)
 select element_id, coalesce(last_value(event ignore nulls) over (partition by doc_id order by page, place rows unbounded preceding), 'Document Content') anchor from ev""",
)
def w2(spark: SparkSession, d: str) -> DataFrame:
    return layout.section_anchors(layout.reading_order(boxes(spark, d)), "hint").select("element_id", "anchor")


@query(
    "w3_page_anchors",
    f"""with {BOXES}, ev as (select *, case when kind = 'HEADER' and length(trim(hint)) > 3 then trim(hint) end event from boxes)
 select element_id, coalesce(last_value(event ignore nulls) over (partition by doc_id, page order by ymin, xmin, idx rows unbounded preceding), 'Document Start') anchor from ev""",
)
def w3(spark: SparkSession, d: str) -> DataFrame:
    return layout.page_anchors(boxes(spark, d), "hint").select("element_id", "anchor")


_LABELS = "labels as (select doc_id, row_number() over (partition by doc_id order by page, idx) seq, case when idx % 2 = 0 then 'Title' else 'Section-header' end label, coalesce(hint, '') content from boxes where kind = 'HEADER')"


@query(
    "w5_title_sections",
    f"""with {BOXES}, {_LABELS}, t as (select *, last_value(case when label = 'Title' and trim(content) <> '' then trim(content) end ignore nulls) over (partition by doc_id order by seq rows unbounded preceding) title from labels),
 ev as (select *, case when trim(content) = '' then null when label = 'Title' then trim(content) else trim(coalesce(title, '') || ' > ' || content, ' >') end event from t)
 select doc_id, cast(seq as integer) seq, coalesce(last_value(event ignore nulls) over (partition by doc_id order by seq rows unbounded preceding), 'Document Start') context from ev""",
)
def w5(spark: SparkSession, d: str) -> DataFrame:
    h = boxes(spark, d).where("kind = 'HEADER'").withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "idx")))
    labels = h.select("doc_id", "seq", F.when(F.col("idx") % 2 == 0, "Title").otherwise("Section-header").alias("label"), F.coalesce("hint", F.lit("")).alias("content"))
    return layout.title_sections(labels).select("doc_id", "seq", "context")


@query(
    "a10_m4_refined_boxes",
    f"""with {BOXES}, env as (select e.doc_id, e.page, e.idx, min(greatest(e.ymin, b.ymin)) y0, min(greatest(e.xmin, b.xmin)) x0, max(least(e.ymax, b.ymax)) y1, max(least(e.xmax, b.xmax)) x1
  from boxes e join boxes b on b.doc_id = e.doc_id and b.page = e.page and b.kind in ('TEXT', 'CAPTION') where {_inter('e', 'b')} > 0 group by all),
 pad as (select doc_id, page, idx, greatest(0, y0 - 20) ymin, greatest(0, x0 - 20) xmin, least(1000, y1 + 20) ymax, least(1000, x1 + 20) xmax from env),
 paired as (select b.*, p.ymin py0, p.xmin px0, p.ymax py1, p.xmax px1, coalesce((p.ymax - p.ymin) * (p.xmax - p.xmin) >= 0.3 * {_area('b')}, false) ok from boxes b left join pad p on p.doc_id = b.doc_id and p.page = b.page and p.idx = b.idx)
 select element_id, case when ok then py0 else ymin end new_ymin, case when ok then px0 else xmin end new_xmin, case when ok then py1 else ymax end new_ymax, case when ok then px1 else xmax end new_xmax, ok refined from paired""",
)
def a10(spark: SparkSession, d: str) -> DataFrame:
    e = boxes(spark, d)
    return layout.refined_boxes(e, e.where("kind in ('TEXT', 'CAPTION')")).select("element_id", "new_ymin", "new_xmin", "new_ymax", "new_xmax", "refined")


@query(
    "r5_page_kinds",
    f"""with {BOXES}, s as (select doc_id, page, sum(case when kind in ('TABLE', 'FIGURE', 'CHART') then 0 else {_area('b')} end) text_area, sum(case when kind in ('TABLE', 'FIGURE', 'CHART') then {_area('b')} else 0 end) visual_area from boxes b group by doc_id, page)
 select doc_id, page, cast(text_area as bigint) text_area, cast(visual_area as bigint) visual_area, case when visual_area >= 0.5 * (visual_area + text_area) then 'data_heavy' else 'text_heavy' end page_kind from s""",
)
def r5(spark: SparkSession, d: str) -> DataFrame:
    return layout.page_kinds(boxes(spark, d))
