"""The named queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerleaf.llm import leakage, markup, neardup, packing, repeated_lines, scan_noise, sentences, shared_spans, splitting
from ledgerleaf.sources.stages import stage
from ledgerleaf.sources.tables import load

Query = Callable[[SparkSession, str], DataFrame]


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "document_chunks", ["chunk_id", "content"]).select(F.col("chunk_id").alias("doc"), F.col("content").alias("text"))


def _scans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = load(spark, d, "document_chunks", ["chunk_id", "doc_id", "content"]).select(F.col("chunk_id").alias("doc"), F.col("doc_id").alias("owner"), F.col("content").alias("text"))
    title = F.when(F.trim("title") != "", F.trim("title"))
    titles = load(spark, d, "document_metadata", ["doc_id", "title"]).groupBy(F.col("doc_id").alias("owner")).agg(F.max(title).alias("title"))
    return docs, titles


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return scan_noise.find_noise(*_scans(spark, d)).withColumnRenamed("doc", "chunk_id")


def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk's text, repaired."""
    return scan_noise.repair(*_scans(spark, d)).select(F.col("doc").alias("chunk_id"), F.col("text").alias("content"), "n_repairs")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of chunks whose three-word sequences agree to at least 0.6, as TESTDATA.md asks."""
    return neardup.near_pairs(_chunks(spark, d), threshold=0.6, k=3, min_words=20).select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """The groups of such chunks, with the number of meetings each group touches."""
    groups = neardup.near_groups(_chunks(spark, d), threshold=0.6, k=3, min_words=20)
    where = load(spark, d, "document_chunks", ["chunk_id", "doc_id"]).distinct()
    meetings = load(spark, d, "document_metadata", ["doc_id", "meeting_date"]).groupBy("doc_id").agg(F.min("meeting_date").alias("meeting_date"))
    dated = where.join(meetings, "doc_id", "left").groupBy(F.col("chunk_id").alias("doc")).agg(F.min("meeting_date").alias("meeting_date"))
    dated = groups.join(dated, "doc", "left")
    meetings = dated.groupBy("group_id").agg(F.countDistinct("meeting_date").alias("n_meetings"))
    return dated.join(meetings, "group_id").select(F.col("doc").alias("chunk_id"), "group_id", "n_links", "n_copies", "meeting_date", "n_meetings")


def p2_corpus_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of documents alike in five-word sequences to at least 0.8; those of fewer than five words only if their words are equal."""
    return neardup.near_groups(_texts(spark, d), min_words=1).withColumnRenamed("doc", "doc_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    queue = load(spark, d, "sentence_queue", ["chunk_id"]).select(F.col("chunk_id").alias("doc")).distinct()
    return sentences.sentence_units(_chunks(spark, d).join(queue, "doc", "left_semi")).withColumnRenamed("doc", "chunk_id")


def p3_units(spark: SparkSession, d: str) -> DataFrame:
    """The units with their texts, numbered from 0."""
    queue = load(spark, d, "sentence_queue", ["chunk_id"]).select(F.col("chunk_id").alias("doc")).distinct()
    docs = _chunks(spark, d).join(queue, "doc", "left_semi")
    once = docs.where(F.col("text").isNotNull()).groupBy("doc").agg(F.min("text").alias("text"))
    each = sentences.sentence_units(docs).join(once, "doc")
    nth = F.row_number().over(Window.partitionBy("doc").orderBy("start_pos")) - 1
    return each.select(F.col("doc").alias("chunk_id"), nth.alias("unit_no"), "start_pos", "n_chars", F.substring("text", F.col("start_pos"), F.col("n_chars")).alias("unit"))


def p3_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """The units of each chunk put together again, without white space: they must be the content's."""
    u = p3_units(spark, d).groupBy("chunk_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("unit_no", "unit"))), lambda x: x["unit"]), "").alias("t"), F.count(F.lit(1)).alias("n"))
    return u.select("chunk_id", F.md5(F.regexp_replace("t", r"(?U)[\s\x1c-\x1f]+", "")).alias("md5"))


def _doc_types(spark: SparkSession, d: str) -> DataFrame:
    """``doc_id, source``: every document's type without case and padding; blank types are none."""
    kind = F.lower(F.trim("doc_type"))
    return load(spark, d, "document_metadata", ["doc_id", "doc_type"]).select("doc_id", F.when(kind != "", kind).alias("source")).groupBy("doc_id").agg(F.min("source").alias("source"))


def _repeated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    chunks = load(spark, d, "document_chunks", ["chunk_id", "doc_id", "content"])
    sources = chunks.select("chunk_id", "doc_id").distinct().join(_doc_types(spark, d), "doc_id").groupBy(F.col("chunk_id").alias("doc")).agg(F.min("source").alias("source"))
    return chunks.select(F.col("chunk_id").alias("doc"), F.col("content").alias("text")), sources


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    docs, sources = _repeated(spark, d)
    return repeated_lines.repeated_lines(docs, sources).select(F.col("doc").alias("chunk_id"), "line_no")


def p4_cleaned(spark: SparkSession, d: str) -> DataFrame:
    docs, sources = _repeated(spark, d)
    once = docs.groupBy("doc").agg(F.min("text").alias("text"))
    return repeated_lines.remove_lines(once, repeated_lines.repeated_lines(docs, sources)).select(F.col("doc").alias("chunk_id"), F.col("text").alias("content"))


def _pages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every chunk as a page, and the host of every document: that of its url."""
    host = F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1)
    hosts = load(spark, d, "document_metadata", ["doc_id", "url"]).groupBy(F.col("doc_id").alias("owner")).agg(F.min(host).alias("host"))
    return load(spark, d, "document_chunks", ["chunk_id", "doc_id", "content"]).select(F.col("chunk_id").alias("page"), F.col("doc_id").alias("owner"), F.col("content").alias("text")), hosts


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.find_markup(*_pages(spark, d)).select(F.col("page").alias("chunk_id"), "markup")


def p5_tokens(spark: SparkSession, d: str) -> DataFrame:
    """How many traces of each language of each chunk belong to the host's template, and how many were left in slots."""
    return markup.find_markup(*_pages(spark, d)).withColumnRenamed("page", "chunk_id")


def p5_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk's clean text and, where it held markup, its blocks."""
    return markup.clean(_chunks(spark, d)).select(F.col("doc").alias("chunk_id"), F.col("text").alias("content"), "blocks")


def p5_templates(spark: SparkSession, d: str) -> DataFrame:
    """The templates of all hosts."""
    return markup.deduce_templates(*_pages(spark, d))


def p5_slots(spark: SparkSession, d: str) -> DataFrame:
    """The contents of the templates' slots on every chunk."""
    return markup.template_slots(*_pages(spark, d)).withColumnRenamed("page", "chunk_id")


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(load(spark, d, "document_chunks", ["chunk_id", "content", "section_anchor"]), load(spark, d, "size_limits"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that the split_default limit (1,024 tokens) cuts into pieces."""
    return p6_pieces(spark, d).where((F.col("limit_id") == "split_default") & (F.col("piece_no") == 1)).select("chunk_id").distinct()


def p6_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of each chunk put together again without their overlaps, and whether all keep the limit and the stated overlap."""
    limits = F.broadcast(load(spark, d, "size_limits").where("purpose = 'split'").select("limit_id", "max_tokens", F.coalesce("overlap_tokens", F.lit(0)).alias("lap")))
    p = p6_pieces(spark, d).join(limits, "limit_id")
    own = F.struct("piece_no", F.expr("substring(content, overlap_chars + 1, n_chars)").alias("t"))
    kept = (F.col("token_count") <= F.col("max_tokens")) & (F.col("overlap_chars") == F.when(F.col("piece_no") == 0, 0).otherwise(F.least(4 * F.col("lap"), F.col("start_pos") - 1 + F.col("overlap_chars"))))
    whole = p.groupBy("limit_id", "chunk_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(own)), lambda x: x["t"]), "").alias("t"), F.bool_and(kept).alias("kept"))
    return whole.select("limit_id", "chunk_id", F.md5("t").alias("md5"), "kept")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_texts(spark, d), load(spark, d, "size_limits")).withColumnRenamed("doc", "doc_id")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How well each capacity's containers are filled."""
    limits = load(spark, d, "size_limits")
    return packing.fill_summary(packing.pack(_texts(spark, d), limits), limits)


def p7_checked(spark: SparkSession, d: str) -> DataFrame:
    """Per capacity: documents packed, containers over the capacity, documents cut though they fit, documents whose pieces don't follow one another."""
    limits = load(spark, d, "size_limits")
    packed = stage(packing.pack(_texts(spark, d), limits), "packed").join(limits.select("limit_id", "max_tokens"), "limit_id")
    over = packed.groupBy("limit_id", "container_id").agg((F.sum("n_tokens") > F.max("max_tokens")).cast("int").alias("over")).groupBy("limit_id").agg(F.sum("over").alias("n_over"))
    docs = packed.groupBy("limit_id", "doc").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("tokens"), F.max(F.col("token_start") + F.col("n_tokens")).alias("end"), F.max("max_tokens").alias("most"))
    docs = docs.groupBy("limit_id").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if((F.col("n") > 1) & (F.col("tokens") <= F.col("most"))).alias("n_cut"), F.count_if(F.col("end") != F.col("tokens")).alias("n_gaps"))
    return docs.join(over, "limit_id").select("limit_id", "n_docs", "n_over", "n_cut", "n_gaps")


def _items(spark: SparkSession, d: str) -> DataFrame:
    each = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in ("query_text", "expected_answer")))
    return load(spark, d, "eval_questions").select(F.col("question_id").alias("item"), F.explode(each).alias("x")).select("item", "x.*")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents", ["doc_id", "text"]).select(F.col("doc_id").alias("doc"), "text")
    return leakage.find_leaks(docs, _items(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select(F.col("doc").alias("doc_id"), F.col("item").alias("question_id")).distinct()


def p8_matches(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select(F.col("doc").alias("doc_id"), F.col("item").alias("question_id"), "field", "n_words", "doc_word", "item_word")


def p8_kept(spark: SparkSession, d: str) -> DataFrame:
    """Ids and texts of the documents without a leak."""
    return load(spark, d, "documents", ["doc_id", "text"]).join(p8_found(spark, d), "doc_id", "left_anti")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents", ["doc_id", "text"]).select(F.col("doc_id").alias("doc"), "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_pairs(_texts(spark, d)).select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    """All maximal stretches between different texts; a copy has one row with the least id of its text."""
    return shared_spans.shared_spans(_texts(spark, d)).select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"), "start_a", "start_b", "n_chars")


def p9_shared(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_amounts(_texts(spark, d)).withColumnRenamed("doc", "doc_id")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_repaired, p2_found, p2_groups, p2_corpus_groups, p3_found, p3_units, p3_rejoined, p4_found, p4_cleaned, p5_found, p5_tokens, p5_cleaned, p5_templates, p5_slots, p6_found, p6_pieces, p6_rejoined, p7_containers, p7_fill, p7_checked, p8_found, p8_matches, p8_kept, p9_found, p9_spans, p9_shared)}
_LONG = """docs as (select doc_id, text, length(text) n from documents where length(text) >= 200),
reps as (select min(doc_id) doc_id, min(n) n, text, count(*) n_copies from docs group by text),
copies as (select d.doc_id, r.doc_id rep, r.n_copies, d.n from docs d join reps r on d.text = r.text where r.n_copies > 1),
windows as (select doc_id, i, md5(substring(text, i, 200)) w from (select doc_id, text, unnest(range(1, n - 198)) i from reps))"""
_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
_LEAKS = f"""ws as (select doc_id, {_WORDS.format('text')} w from documents),
grams as (select doc_id, array_to_string(w[i : i + 7], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 6)) i from ws)),
items as (select question_id, {_WORDS.format('query_text')} w from eval_questions union all select question_id, {_WORDS.format('expected_answer')} from eval_questions),
asked as (select distinct question_id, array_to_string(w[i : i + 7], ' ') g from (select question_id, w, unnest(range(1, len(w) - 6)) i from items)),
leaks as (select distinct doc_id, question_id from grams join asked using (g))"""
_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_REPEATED = r"""
with types as (select doc_id, min(nullif(lower(trim(doc_type)), '')) source from document_metadata group by doc_id),
chunks as (select distinct chunk_id, doc_id, content from document_chunks),
typed as (select chunk_id, min(source) source, any_value(content) content from chunks join types using (doc_id) where source is not null group by chunk_id),
cut as (select chunk_id, source, string_split(content, chr(10)) parts from typed where content is not null),
lines as (select chunk_id, source, unnest(parts) raw, unnest(range(1, len(parts) + 1)) line_no from cut),
plain as (select chunk_id, source, line_no, lower(trim(regexp_replace(raw, '[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))) line from lines),
often as (select source, line from plain where length(line) >= 25 group by source, line
  having count(distinct chunk_id) >= 10 and count(distinct chunk_id) * 1000 >= (select count(*) from typed t where t.source = plain.source))"""


def _groups(src: str, k: int, least: int, threshold: float) -> str:
    """SQL of the groups of near-duplicates of a table ``src(doc, text)``."""
    gram = " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    return f"""{src}, ws as (select doc, {_WORDS.format('min(text)')} w from src where text is not null group by doc),
keyed as (select doc, w, array_to_string(w, ' ') key from ws where len(w) >= {least}),
classes as (select min(doc) rep, key, any_value(w) w, count(*) n_copies from keyed group by key),
grams as (select distinct rep, {gram} g from (select rep, w, unnest(range(1, len(w) - {k - 2})) i from classes where len(w) >= {k})),
sizes as (select rep, count(*) n from grams group by rep),
met as (select a.rep a, b.rep b, count(*) n from grams a join grams b on a.g = b.g and a.rep < b.rep group by all),
links as (select a, b from met join sizes x on x.rep = a join sizes y on y.rep = b where met.n >= {threshold} * (x.n + y.n - met.n) - 1e-9),
edges as (select a, b from links union all select b, a from links), degree as (select a rep, count(*) n_links from edges group by a),
reach as (select a, b from edges union select r.a, e.b from reach r join edges e on e.a = r.b),
names as (select a rep, least(a, min(b)) group_id from reach group by a),
groups as (select doc, coalesce(group_id, c.rep) group_id, coalesce(n_links, 0) n_links, n_copies from keyed join classes c using (key) left join degree d on d.rep = c.rep left join names n on n.rep = c.rep where n_links is not null or n_copies > 1)"""


ORACLES: dict[str, str] = {
    "p2_groups": f"""with recursive {_groups('src as (select chunk_id doc, content as text from document_chunks)', 3, 20, 0.6)},
meetings as (select doc_id, min(meeting_date) meeting_date from document_metadata group by doc_id),
dated as (select chunk_id doc, min(meeting_date) meeting_date from document_chunks left join meetings using (doc_id) group by chunk_id)
select doc chunk_id, group_id, n_links, n_copies, meeting_date, count(distinct meeting_date) over (partition by group_id) n_meetings from groups left join dated using (doc)""",
    "p2_corpus_groups": f"with recursive {_groups('src as (select doc_id doc, text from documents)', 5, 1, 0.8)} select doc doc_id, group_id, n_links, n_copies from groups",
    "p8_matches": f"""with ws as (select doc_id, {_WORDS.format('text')} w from documents),
grams as (select doc_id, i, array_to_string(w[i : i + 7], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 6)) i from ws)),
items as (select question_id, 'query_text' field, {_WORDS.format('query_text')} w from eval_questions union all select question_id, 'expected_answer', {_WORDS.format('expected_answer')} from eval_questions),
asked as (select question_id, field, j, array_to_string(w[j : j + 7], ' ') g from (select question_id, field, w, unnest(range(1, len(w) - 6)) j from items)),
met as (select doc_id, question_id, field, i, j, i - row_number() over (partition by doc_id, question_id, field, i - j order by i) run from grams join asked using (g)),
runs as (select doc_id, question_id, field, count(*) + 7 n, min(i) - 1 i, min(j) - 1 j from met group by doc_id, question_id, field, i - j, run)
select doc_id, question_id, field, cast(n as integer) n_words, cast(i as integer) doc_word, cast(j as integer) item_word from runs qualify row_number() over (partition by doc_id, question_id, field order by n desc, i, j) = 1""",
    "p2_found": f"""with ws as (select chunk_id, {_WORDS.format('any_value(content)')} w from document_chunks where content is not null group by chunk_id),
grams as (select distinct chunk_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] g from (select chunk_id, w, unnest(range(1, len(w) - 1)) i from ws where len(w) >= 20)),
sizes as (select chunk_id, count(*) n from grams group by chunk_id),
met as (select a.chunk_id a, b.chunk_id b, count(*) n from grams a join grams b on a.g = b.g and a.chunk_id < b.chunk_id group by all)
select a chunk_id_a, b chunk_id_b from met join sizes x on x.chunk_id = a join sizes y on y.chunk_id = b where met.n >= 0.6 * (x.n + y.n - met.n) - 1e-9""",
    "p8_found": f"with {_LEAKS} select doc_id, question_id from leaks",
    "p8_kept": f"with {_LEAKS} select doc_id, text from documents where doc_id not in (select doc_id from leaks)",
    "p9_found": f"""with {_LONG}, links as (select distinct a.doc_id a, b.doc_id b from windows a join windows b on a.w = b.w and a.doc_id < b.doc_id),
members as (select doc_id, coalesce(rep, doc_id) rep from docs left join copies using (doc_id)),
pairs as (select x.doc_id x, y.doc_id y from links join members x on x.rep = a join members y on y.rep = b union all select x.doc_id, y.doc_id from copies x join copies y on x.rep = y.rep and x.doc_id < y.doc_id)
select least(x, y) doc_id_a, greatest(x, y) doc_id_b from pairs""",
    "p9_spans": f"""with {_LONG}, met as (select a.doc_id a, b.doc_id b, a.i i, b.i j from windows a join windows b on a.w = b.w and a.doc_id < b.doc_id),
runs as (select *, i - row_number() over (partition by a, b, j - i order by i) run from met),
spans as (select a, b, min(i) i, min(j) j, count(*) + 199 n from runs group by a, b, j - i, run)
select a doc_id_a, b doc_id_b, cast(i as integer) start_a, cast(j as integer) start_b, cast(n as integer) n_chars from spans
union all select rep, doc_id, 1, 1, cast(n as integer) from copies where doc_id <> rep""",
    "p9_shared": f"""with {_LONG}, often as (select w from windows group by w having count(distinct doc_id) > 1),
steps as (select doc_id, i - lag(i, 1, -200) over (partition by doc_id order by i) step from windows semi join often using (w)),
part as (select doc_id, sum(least(step, 200)) shared from steps group by doc_id)
select doc_id, d.n n_chars, cast(case when c.rep is not null then d.n else shared end as bigint) shared_chars, round(cast(case when c.rep is not null then d.n else shared end as double) / d.n, 6) shared_share, coalesce(n_copies, 1) n_copies
from docs d left join part using (doc_id) left join copies c using (doc_id) where shared is not null or c.rep is not null""",
    "p4_found": _REPEATED + """
select chunk_id, cast(line_no as integer) line_no from plain join often using (source, line)""",
    "p4_cleaned": _REPEATED + """,
gone as (select chunk_id, list(distinct line_no) gone from plain join often using (source, line) group by chunk_id),
once as (select chunk_id, min(content) content from document_chunks group by chunk_id)
select chunk_id, case when gone is null then content else array_to_string(list_filter(string_split(content, chr(10)), lambda x, i: not list_contains(gone, i)), chr(10)) end content from once left join gone using (chunk_id)""",
    "p3_rejoined": rf"""with once as (select chunk_id, min(content) content from document_chunks semi join sentence_queue using (chunk_id) where content is not null group by chunk_id),
bare as (select chunk_id, regexp_replace(content, '{_SPACE}+', '', 'g') t from once) select chunk_id, md5(t) md5 from bare where t <> ''""",
    "p6_rejoined": "select distinct limit_id, chunk_id, md5(content) md5, true kept from document_chunks, size_limits where purpose = 'split' and length(content) // 4 > max_tokens",
    "p7_checked": "select limit_id, count(distinct doc_id) n_docs, 0::bigint n_over, 0::bigint n_cut, 0::bigint n_gaps from size_limits, documents where purpose = 'pack' and text is not null group by limit_id",
    "p6_found": "select distinct chunk_id from document_chunks where length(content) // 4 > 1024",
}
