"""Queries on sections, chunk assembly and semi-structured payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerleaf.functions import scores, semistructured, text
from ledgerleaf.operators import chunking, pages
from ledgerleaf.plans.common import ELEMENTS, elements, query
from ledgerleaf.plans.texts import stripped
from ledgerleaf.sources import providers
from ledgerleaf.sources.tables import load

_RUNS = f"""{ELEMENTS}, named as (select *, coalesce(section_anchor, 'Document Content') anchor from elements),
 steps as (select *, lag(anchor) over (partition by doc_id order by seq) prev from named),
 runs as (select *, sum(case when prev is null or prev <> anchor then 1 else 0 end) over (partition by doc_id order by seq rows unbounded preceding) - 1 section_no from steps)"""


@query("w1_section_runs", f"with {_RUNS} select element_id, cast(section_no as integer) section_no from runs")
def w1(spark: SparkSession, d: str) -> DataFrame:
    return chunking.section_runs(elements(spark, d)).select("element_id", "section_no")


@query("w6_chunk_numbers", f"with {ELEMENTS} select element_id, doc_id || '_chunk_' || (row_number() over (partition by doc_id order by seq, element_id) - 1) new_id from elements")
def w6(spark: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq", "element_id")) - 1
    return elements(spark, d).select("element_id", F.concat("doc_id", F.lit("_chunk_"), n.cast("string")).alias("new_id"))


@query(
    "a1_a2_a3_assembled_sections",
    f"""with {_RUNS}, kws as (select doc_id, section_no, list_sort(list(distinct k))[1:10] keywords from (select doc_id, section_no, unnest(keywords) k from runs where keywords is not null) group by doc_id, section_no),
 g as (select doc_id, section_no, string_agg(case when kind in ('TABLE', 'FIGURE') then '[' || kind || ']' || chr(10) || coalesce(content, '') else coalesce(content, '') end, chr(10) || chr(10) order by seq) content,
  list_sort(list(distinct coalesce(kind, 'TEXT'))) element_types, list_sort(list(distinct page) filter (where page is not null and page <> 0)) pages, list(element_id order by seq) element_ids, cast(count(*) as integer) source_count from runs group by doc_id, section_no)
 select g.doc_id || '#' || g.section_no group_id, md5(content) content_md5, element_types, coalesce(pages, []) pages, element_ids, coalesce(k.keywords, []) keywords, source_count,
  case when len(element_types) > 1 then 'multimodal' when element_types[1] = 'TABLE' then 'table' when element_types[1] = 'FIGURE' then 'figure' else 'text' end chunk_type, cast(length(content) // 4 as integer) token_count
 from g left join kws k on k.doc_id = g.doc_id and k.section_no = g.section_no""",
)
def a1(spark: SparkSession, d: str) -> DataFrame:
    runs = chunking.section_runs(elements(spark, d)).withColumn("group_id", F.concat("doc_id", F.lit("#"), F.col("section_no").cast("string")))
    return chunking.assembled(runs).withColumn("content_md5", F.md5("content")).drop("content")


@query("c1_w7_x9_section_chunks")
def c1(spark: SparkSession, d: str) -> DataFrame:
    """An ordered fold, so without SQL; a test holds random documents against a plain restatement."""
    return chunking.chunk_sections(elements(spark, d))


@query(
    "a5_chunking_stats",
    f"""with {ELEMENTS}, t as (select kind, coalesce(length(content) // 4, 0) n from elements)
 select count(*) elements_processed, count(*) filter (where kind = 'TABLE' and n > 150) tables_preserved, count(*) filter (where n > 1024 and not coalesce(kind = 'TABLE' and n > 150, false)) splits_performed from t""",
)
def a5(spark: SparkSession, d: str) -> DataFrame:
    e = elements(spark, d)
    return chunking.chunking_stats(e, e.select(F.lit(0).alias("token_count")).limit(0)).select("elements_processed", "tables_preserved", "splits_performed")


@query("a5_chunks_created")
def a5_chunks(spark: SparkSession, d: str) -> DataFrame:
    """All figures, chunks created and their tokens among them; these come from the ordered fold of c1, so without SQL."""
    e = elements(spark, d)
    return chunking.chunking_stats(e, chunking.chunk_sections(e))


@query("f3_f4_valid_chunks", f"with {ELEMENTS} select element_id, length(content) // 4 > 0 has_tokens from elements where length({stripped('content')}) > 5")
def f3(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    return elements(spark, d).where(F.length(text.strip(c)) > 5).select("element_id", (text.token_count(c) > 0).alias("has_tokens"))


@query(
    "m5_u2_neighbour_similarity",
    f"""with {ELEMENTS}, n as (select element_id, section_anchor a1, keywords k1, lead(section_anchor) over w a2, lead(keywords) over w k2, lead(element_id) over w other from elements window w as (partition by doc_id order by seq, element_id)),
 c as (select *, len(list_intersect(k1, k2)) both_n, len(list_distinct(list_concat(k1, k2))) any_n from n where other is not null)
 select element_id, round((case when a1 is not distinct from a2 then 0.4 else 0.0 end) + 0.4 * coalesce(case when len(k1) > 0 and len(k2) > 0 then cast(both_n as double) / any_n else 0.0 end, 0.0), 6) similarity from c""",
)
def m5(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("seq", "element_id")
    n = elements(spark, d).select("element_id", "section_anchor", "keywords", F.lead("section_anchor").over(w).alias("a2"), F.lead("keywords").over(w).alias("k2"), F.lead("element_id").over(w).alias("other"))
    s = scores.keyword_similarity(F.col("section_anchor"), F.col("a2"), F.col("keywords"), F.col("k2"))
    return n.where(F.col("other").isNotNull()).select("element_id", F.round(s, 6).alias("similarity"))


@query(
    "m7_quality_scores",
    f"""with {ELEMENTS}, s as (select *, case seq % 3 when 0 then 'PASS' when 1 then 'FAIL' else 'PARTIAL' end status from elements)
 select element_id, case when contains(coalesce(content, ''), 'EXTRACTION_FAILED') then 0.0 else round(greatest(0.0, least(1.0, 0.7 - (case when length(coalesce(content, '')) < 10 then 0.2 else 0.0 end)
  - (case status when 'FAIL' then 0.3 when 'PARTIAL' then 0.1 else 0.0 end) + (case when kind = 'TABLE' then 0.1 else 0.0 end))), 6) end quality from s""",
)
def m7(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("seq") % 3 == 0, "PASS").when(F.col("seq") % 3 == 1, "FAIL").otherwise("PARTIAL")
    q = scores.quality(F.col("content"), status, F.coalesce(F.col("kind") == "TABLE", F.lit(False)), F.lit(0.7))
    return elements(spark, d).select("element_id", F.round(q, 6).alias("quality"))


@query(
    "k1_k3_k5_k6_chart_payloads",
    f"""with {ELEMENTS}, t as (select element_id, trim(regexp_replace(regexp_replace(replace(content, '[FIGURE]' || chr(10), ''), '^\\s*```[a-z]*\\n', ''), '\\n```\\s*$', '')) j from elements where contains(content, '"chart_type"')),
 v as (select element_id, j from t where json_valid(j))
 select element_id, json_extract_string(j, '$.chart_type') chart_type, json_extract_string(j, '$.title') title, json_type(j, '$.title') is not null and (json_array_length(j, '$.data_series') > 0 or json_array_length(j, '$.key_insights') > 0) has_data from v""",
)
def k1(spark: SparkSession, d: str) -> DataFrame:
    """Charts whose payload is whole; those cut off or within other text are left to the repair, which tests cover."""
    body = F.replace("content", F.lit("[FIGURE]\n"), F.lit(""))
    e = elements(spark, d).where(F.col("content").contains('"chart_type"')).select("element_id", semistructured.unfenced(body).alias("j")).where(F.try_parse_json("j").isNotNull())
    c = e.withColumn("c", F.from_json("j", semistructured.CHART))
    return c.select("element_id", "c.chart_type", "c.title", (semistructured.chart_problem(F.col("c"), F.col("j")) == "Valid chart data").alias("has_data"))


@query(
    "k1_repaired_json",
    rf"""with {ELEMENTS}, t as (select element_id, {stripped('content')} t from elements where contains(content, '{{')),
 u as (select element_id, case when starts_with(t, '```') then {stripped("regexp_replace(regexp_replace(t, '^```[^\n]*\n?', ''), '\n?[ \t]*```[ \t]*$', '')")} else t end t from t),
 f as (select element_id, t, list_filter(regexp_extract_all(t, '(?s)\{{[^{{}}]*(?:\{{[^{{}}]*\}}[^{{}}]*)*\}}'), lambda m: json_valid(m)) objects, list_filter(regexp_extract_all(t, '(?s)\[[^\[\]]*(?:\[[^\[\]]*\][^\[\]]*)*\]'), lambda m: json_valid(m)) arrays from u)
 select element_id, case when json_valid(t) then t else coalesce(objects[-1], arrays[-1], '{{"layout":[]}}') end json from f""".replace("\\\\", "\\"),
)
def k1_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Every payload with a brace, repaired."""
    e = elements(spark, d).where(F.col("content").contains("{"))
    return e.select("element_id", semistructured.repaired_json(F.col("content")).alias("json"))


_NO_VALUE = ", ".join(f"'{v}'" for v in sorted(semistructured.NO_VALUE))
_CELL = "string_split(lines[r], ',')[j]"


@query(
    "k2_k4_csv_tables",
    rf"""with {ELEMENTS}, t as (select element_id, case when starts_with(content, '[TABLE]' || chr(10)) then substring(content, 9) else content end body from elements where kind = 'TABLE'),
 l as (select element_id, body, list_filter(string_split(body, chr(10)), lambda x: {stripped('x')} <> '') lines from t),
 s as (select *, string_split(lines[1], ',') header, len(lines) - 1 n, list_max(list_transform(lines, lambda x: len(string_split(x, ',')))) widest from l),
 m as (select element_id, lines, header, n, case when body is null or length({stripped('body')}) < 10 then 'CSV string too short' when widest > len(header) then 'Parse error' when n < 1 then 'No data rows' when len(header) < 2 then 'Less than 2 columns'
  when len(list_filter(header, lambda h: h = '' or contains(h, 'Unnamed'))) > 0 then 'Unnamed columns detected' else 'Valid CSV' end message from s),
 cells as (select element_id, j, {_CELL} cell from (select element_id, lines, r, unnest(range(1, len(header) + 1)) j from (select element_id, lines, header, unnest(range(2, n + 2)) r from m where message = 'Valid CSV'))),
 full_ as (select element_id, count(distinct j) n_columns from cells where coalesce(cell, '') not in ({_NO_VALUE}) group by element_id)
 select element_id, message = 'Valid CSV' ok, cast(case when message in ('CSV string too short', 'Parse error') then 0 else n end as integer) n_rows, cast(case when message = 'Valid CSV' then coalesce(f.n_columns, 0) when message in ('CSV string too short', 'Parse error') then 0 else len(header) end as integer) n_columns, message
 from m left join full_ f using (element_id)""",
)
def k2(spark: SparkSession, d: str) -> DataFrame:
    """The test tables hold no quoted cell, so plain cutting says the same in SQL; tests cover quotes."""
    body = F.regexp_replace("content", r"\A\[TABLE\]\n", "")
    return elements(spark, d).where("kind = 'TABLE'").select("element_id", semistructured.validated_csv(body).alias("r")).select("element_id", "r.ok", "r.n_rows", "r.n_columns", "r.message")


@query("k8_arrays_as_json", "select chunk_id, to_json(min(pages)) pages_json, to_json(min(element_types)) types_json from document_chunks where pages is not null and element_types is not null group by chunk_id")
def k8(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "document_chunks", ["chunk_id", "pages", "element_types"]).where(F.col("pages").isNotNull() & F.col("element_types").isNotNull())
    return c.groupBy("chunk_id").agg(F.to_json(F.min("pages")).alias("pages_json"), F.to_json(F.min("element_types")).alias("types_json"))


@query("x15_vision_context", f"with {ELEMENTS} select element_id, 'Section: ' || coalesce(section_anchor, 'Document Content') || '.' || case when keywords[1] is null then '' else ' Caption: ' || keywords[1] || '.' end context from elements where kind in ('TABLE', 'FIGURE')")
def x15(spark: SparkSession, d: str) -> DataFrame:
    """What stands before the prompt for a table or figure; its first keyword takes the caption's place."""
    e = elements(spark, d).where(F.col("kind").isin("TABLE", "FIGURE"))
    return e.select("element_id", text.vision_context(F.coalesce("section_anchor", F.lit("Document Content")), F.try_element_at("keywords", F.lit(1))).alias("context"))


@query("s2_page_elements")
def s2(spark: SparkSession, d: str) -> DataFrame:
    """All documents' texts as files of one page: blocks, detection, captions, order, sections and extraction, with the stand-in models."""
    files = load(spark, d, "documents", ["doc_id", "text"]).where(F.col("text").isNotNull()).select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "utf-8").alias("content"))
    return pages.page_elements(providers.read_pages(files)).select("doc_id", "page", "seq", "element_id", "kind", "content", "section_anchor", "status", "quality", "problem")
