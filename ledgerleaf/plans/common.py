"""Registration of named queries and the input views that several share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.operators.layout import valid
from ledgerleaf.sources.tables import load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with the SQL that must give the same rows."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """Valid layout elements with ``kind`` in capitals; a missing column number stays null."""
    e = load(spark, d, "layout_elements").select("element_id", "doc_id", "page", "idx", F.upper("elem_type").alias("kind"), "ymin", "xmin", "ymax", "xmax", "hint", "col_no")
    return valid(e)


BOXES = """boxes as (select distinct element_id, doc_id, page, idx, upper(elem_type) kind, ymin, xmin, ymax, xmax, hint, col_no from layout_elements
where elem_type is not null and ymin is not null and xmin is not null and ymax is not null and xmax is not null)"""


def elements(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as the elements of their documents, each once: ``doc_id, seq, element_id, kind, content, section_anchor, page, keywords``."""
    c = load(spark, d, "document_chunks", ["chunk_id", "doc_id", "content", "chunk_type", "section_anchor", "pages", "keywords"])
    once = c.groupBy(F.col("chunk_id").alias("element_id")).agg(*(F.min(x).alias(x) for x in ("doc_id", "content", "chunk_type", "section_anchor", "pages", "keywords")))
    kind = F.when(F.col("chunk_type").isin("table", "figure"), F.upper("chunk_type")).when(F.col("chunk_type").isNotNull(), "TEXT")
    return once.select("doc_id", F.regexp_extract("element_id", r"_chunk_(\d+)$", 1).cast("int").alias("seq"), "element_id", kind.alias("kind"), "content", "section_anchor", F.try_element_at("pages", F.lit(1)).alias("page"), "keywords")


ELEMENTS = r"""elements as (select min(doc_id) doc_id, cast(regexp_extract(chunk_id, '_chunk_(\d+)$', 1) as integer) seq, chunk_id element_id,
 case when min(chunk_type) in ('table', 'figure') then upper(min(chunk_type)) when min(chunk_type) is not null then 'TEXT' end kind,
 min(content) content, min(section_anchor) section_anchor, min(pages)[1] page, min(keywords) keywords from document_chunks group by chunk_id)"""
