"""From pages of text blocks to elements in reading order with their contents: detect, cluster, order, extract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.functions import scores, text
from ledgerleaf.operators import layout
from ledgerleaf.sources import providers

_REPLY = "array<struct<type:string,box:array<double>>>"


def scaled(blocks: DataFrame) -> DataFrame:
    """``doc_id, page, line, content`` and a box in 0 to 1000 of the blocks of ``sources.providers.read_pages``; a page is as large as its blocks reach."""
    w = Window.partitionBy("path", "page")
    width, height = F.max("x2").over(w), F.max("y2").over(w)
    part = lambda c, whole: F.when(whole > 0, F.round(F.col(c) / whole * 1000)).otherwise(0).cast("int")
    return blocks.where(F.col("page").isNotNull()).select(
        F.col("path").alias("doc_id"), "page", "line", F.col("text").alias("content"), part("y1", height).alias("ymin"), part("x1", width).alias("xmin"), part("y2", height).alias("ymax"), part("x2", width).alias("xmax")
    )


def detected(lines: DataFrame, detector: providers.Model = providers.BlockDetector()) -> DataFrame:
    """Elements ``doc_id, page, idx, element_id, kind`` and a box, and ``problem`` of pages whose detection failed (one row without a kind).

    A page's blocks are what the model is given; a page is one row, so its size bounds the row.
    """
    block = F.struct("line", F.col("content").alias("text"), "ymin", "xmin", "ymax", "xmax")
    pages = lines.groupBy("doc_id", "page").agg(F.to_json(F.sort_array(F.collect_list(block))).alias("blocks"))
    replies = providers.mapped(pages, detector, "blocks", "reply", "string")
    elements = F.from_json(F.coalesce(F.get_json_object("reply", "$.elements"), F.get_json_object("reply", "$.layout"), F.lit("[]")), _REPLY)
    each = replies.select("doc_id", "page", F.posexplode_outer(elements).alias("idx", "e"), F.col("reply_error").alias("problem"))
    at = lambda i: F.get("e.box", i).cast("int")
    return each.select(
        "doc_id", "page", "idx", text.element_id(F.col("doc_id"), F.col("page"), F.coalesce("idx", F.lit(0))).alias("element_id"), F.upper("e.type").alias("kind"),
        at(0).alias("ymin"), at(1).alias("xmin"), at(2).alias("ymax"), at(3).alias("xmax"), "problem",
    )


def extracted(elements: DataFrame, lines: DataFrame, reader: providers.Model = providers.TableReader()) -> DataFrame:
    """Elements with ``content, caption, vision_prompt, status, quality, keywords``: text from the lines they cover, visuals through the reader.

    A visual the reader gives nothing for has the status FAIL and no content.
    """
    covered = layout.region_texts(layout.lines_in_regions(lines, elements)).select("doc_id", "page", F.col("region").alias("idx"), F.col("text").alias("covered"))
    pairs = layout.matched_captions(elements).withColumnRenamed("visual", "idx")
    named = pairs.join(covered.select("doc_id", "page", F.col("idx").alias("caption"), F.col("covered").alias("caption_text")), ["doc_id", "page", "caption"], "left").drop("caption")
    e = elements.join(covered, [*layout.PAGE, "idx"], "left").join(named, [*layout.PAGE, "idx"], "left")
    visual = layout.routed(F.col("kind")) == "vision"
    e = e.withColumn("vision_prompt", F.when(visual, text.vision_context(F.col("anchor"), F.col("caption_text")))).withColumn("asked", F.when(visual, F.col("covered")))
    read = providers.mapped(e, reader, "asked", "seen", "string")
    content = F.when(visual, F.col("seen")).otherwise(F.col("covered"))
    status = F.when(visual & F.col("seen").isNull(), "FAIL").otherwise("PASS")
    out = read.withColumn("content", content).withColumn("status", status)
    return out.withColumns({"quality": scores.quality(F.col("content"), F.col("status"), F.col("kind") == "TABLE", F.lit(None).cast("double")), "keywords": text.keywords(F.coalesce("content", F.lit("")))}).drop("asked", "seen", "seen_error", "covered")


def page_elements(blocks: DataFrame, detector: providers.Model = providers.BlockDetector(), reader: providers.Model = providers.TableReader()) -> DataFrame:
    """The elements of all pages, ready for chunking: ``doc_id, seq, element_id, kind, content, section_anchor, page, keywords`` and what extraction adds.

    blocks: of ``read_pages``. A file or page that can't be read or detected gives one row with its ``problem`` and no kind.
    """
    lines = scaled(blocks)
    found = detected(lines, detector)
    good = layout.valid(found.where(F.col("kind").isNotNull())).drop("problem")
    headers = layout.region_texts(layout.lines_in_regions(lines, good)).select("doc_id", "page", F.col("region").alias("idx"), F.col("text").alias("heading"))
    ordered = layout.reading_order(good.join(headers, [*layout.PAGE, "idx"], "left"))
    placed = layout.section_anchors(ordered, "heading").drop("heading")
    seq: Column = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "place")) - 1
    out = extracted(placed.withColumn("seq", seq), lines, reader).withColumnRenamed("anchor", "section_anchor")
    bad = blocks.where(F.col("problem").isNotNull()).select(F.col("path").alias("doc_id"), "page", "problem").unionByName(found.where(F.col("problem").isNotNull()).select("doc_id", "page", "problem"))
    names = ["doc_id", "page", "seq", "element_id", "kind", "content", "section_anchor", "caption_text", "vision_prompt", "status", "quality", "keywords"]
    return out.select(*names).unionByName(bad, allowMissingColumns=True)
