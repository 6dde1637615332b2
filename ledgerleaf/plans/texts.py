"""Queries on text: sentences, packing, keywords, clean-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerleaf.functions import text
from ledgerleaf.operators import chunking
from ledgerleaf.plans.common import ELEMENTS, elements, query
from ledgerleaf.sources.tables import load

WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def stripped(sql: str) -> str:
    """SQL for a value without white space at its ends."""
    return f"regexp_replace({sql}, '^{WS}+|{WS}+$', '', 'g')"


#: Sentences of a table ``src(id, body)``: candidate gaps are marked, then pieces whose tail rules a gap out are joined again.
SENTENCES = rf"""
cuts as (select id, string_split(body, chr(10) || chr(10)) ps from src where body is not null),
paras as (select id, para, {stripped("replace(p, chr(10), ' ')")} body from (select id, unnest(range(1, len(ps) + 1)) para, unnest(ps) p from cuts)),
numbered as (select id, para, body from paras where body <> ''),
cut as (select id, para, string_split(regexp_replace(body, '([.?!])({WS}+)([A-Z"''])', '\1' || chr(1) || '\2' || chr(2) || '\3', 'g'), chr(1)) parts from numbered),
piece as (select id, para, unnest(range(1, len(parts) + 1)) n, unnest(parts) raw from cut),
parted as (select id, para, n, case when n = 1 then '' else string_split(raw, chr(2))[1] end gap, case when n = 1 then raw else string_split(raw, chr(2))[2] end body from piece),
tails as (select *, lag(body) over (partition by id, para order by n) prev from parted),
kinds as (select *, case
   when prev is null then 'new'
   when regexp_matches(prev, '([\p{{L}}\p{{N}}_]\.[\p{{L}}\p{{N}}_].|[A-Z][a-z]\.|[A-Z]\.)$') then 'raw'
   when regexp_matches(lower(prev), '(^|[^\p{{L}}\p{{N}}_])(dr|mr|mrs|ms|prof|sr|jr|inc|ltd|corp|co|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|u\.s|u\.k|e\.g|i\.e|etc|vs|ph\.d|b\.a|m\.a|fig|no|vol|pp|ed|al)\.$') then 'space'
   else 'new' end kind from tails),
grouped as (select *, sum(case when kind = 'new' then 1 else 0 end) over (partition by id, para order by n rows unbounded preceding) g from kinds),
sents as (select id, para, g, {stripped("string_agg(case kind when 'new' then body when 'raw' then gap || body else ' ' || body end, '' order by n)")} sentence from grouped group by id, para, g),
sentences as (select id, row_number() over (partition by id order by para, g) - 1 pos, sentence from sents)"""


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents", ["doc_id", "text"])


@query("x1_sentences", f"with src as (select doc_id id, text body from documents), {SENTENCES} select id doc_id, cast(pos as integer) pos, sentence from sentences")
def x1_sentences(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("pos", "sentence"))


@query(
    "x2_x6_x7_sizes",
    rf"""select doc_id, cast(length(text) // 4 as integer) token_count, cast(len(list_filter(regexp_split_to_array(text, '{WS}+'), lambda w: w <> '')) as integer) word_count,
 length(text) char_count, regexp_matches(text, '\p{{Nd}}') has_number from documents""",
)
def x2_sizes(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return _docs(spark, d).select("doc_id", text.token_count(t).alias("token_count"), text.word_count(t).alias("word_count"), F.length(t).cast("long").alias("char_count"), text.has_number(t).alias("has_number"))


_NW = r"[^\p{L}\p{N}_]"


def _whole_words(pattern: str) -> str:
    """SQL for all whole-word matches in lower case: each boundary sign is doubled, so that neighbours need not share one."""
    doubled = rf"regexp_replace(lower(text), '({_NW})', '\1\1', 'g')"
    return rf"list_transform(regexp_extract_all({doubled}, '(?:^|{_NW})({pattern})(?:{_NW}|$)', 1), lambda x: replace(replace(x, '//', '/'), '  ', ' '))"


@query(
    "x3_keywords",
    rf"""with words as (select doc_id, unnest(list_concat(list_concat(
 {_whole_words('gdp|inflation|unemployment|rate|growth|projection|estimate|forecast|basis  points?|percent')},
 {_whole_words('revenue|profit|loss|margin|assets|liabilities|equity|earnings')}),
 {_whole_words('[0-9]{4}|q[1-4]|[0-9]{1,2}//[0-9]{1,2}//[0-9]{2,4}')})) w from documents)
 select doc_id, list_sort(list(distinct w))[1:10] keywords from words group by doc_id""",
)
def x3_keywords(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", text.keywords(F.col("text")).alias("keywords")).where(F.size("keywords") > 0)


@query(
    "x4_entities",
    r"""select doc_id, list_concat(regexp_extract_all(text, '\b(Federal Reserve|FOMC|Board of Governors|Federal Reserve Bank)\b', 1),
 regexp_extract_all(text, '\b([A-Z][a-z]+ [A-Z][a-z]+ (?:Committee|Board|Bank|Corporation|Inc\.))\b', 1)) organizations,
 regexp_extract_all(text, '\b((?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4})\b', 1) dates from documents""",
)
def x4_entities(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", text.entities(F.col("text")).alias("e")).select("doc_id", "e.organizations", "e.dates")


@query(
    "x5_clean_text",
    rf"""with src as (select chunk_id, min(content) body from document_chunks where content is not null group by chunk_id),
 base as (select chunk_id, regexp_replace(regexp_replace(body, '\n{{3,}}', chr(10) || chr(10), 'g'), '-\n', '', 'g') body from src),
 cut as (select chunk_id, string_split(body, chr(10)) parts from base),
 lines as (select chunk_id, unnest(range(1, len(parts) + 1)) n, {stripped("unnest(parts)")} line from cut),
 before as (select *, lag(line) over (partition by chunk_id order by n) prev from lines),
 kept as (select * from before where not (line = '' and (prev is null or prev = ''))),
 marked as (select *, case when line = '' or coalesce(prev, '') = '' or regexp_matches(line, '^\p{{Lu}}') or regexp_matches(prev, '[.:!?]$') then 1 else 0 end fresh from kept),
 grouped as (select *, sum(fresh) over (partition by chunk_id order by n rows unbounded preceding) g from marked),
 joined as (select chunk_id, g, string_agg(line, ' ' order by n) line from grouped group by chunk_id, g),
 whole as (select chunk_id, string_agg(line, chr(10) order by g) body from joined group by chunk_id)
 select b.chunk_id, {stripped("regexp_replace(coalesce(w.body, ''), ' +', ' ', 'g')")} cleaned from base b left join whole w using (chunk_id)""",
)
def x5_clean_text(spark: SparkSession, d: str) -> DataFrame:
    once = load(spark, d, "document_chunks", ["chunk_id", "content"]).where(F.col("content").isNotNull()).groupBy("chunk_id").agg(F.min("content").alias("content"))
    return once.select("chunk_id", text.clean_layout_text(F.col("content")).alias("cleaned"))


@query(
    "x8_trailing_text",
    f"""with src as (select doc_id id, text body from documents), {SENTENCES},
 back as (select id, pos, sentence, sum(length(sentence) // 4) over (partition by id order by pos desc rows unbounded preceding) total, row_number() over (partition by id order by pos desc) r from sentences)
 select id doc_id, string_agg(sentence, ' ' order by pos) trailing_text from back where total <= 50 or r = 1 group by id""",
)
def x8_trailing_text(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", text.trailing_text(text.sentences(F.col("text")), 50).alias("trailing_text")).where(F.col("trailing_text").isNotNull())


@query(
    "x10_x12_x13_x14_labels",
    r"""select chunk_id, case when length(content) > 200 then substring(content, 1, 200) || '...' else content end preview, 'query: ' || coalesce(section_anchor, '') query_text,
 printf('%s_p%d_%d', doc_id, pages[1], token_count) element_id, coalesce(regexp_matches(lower(trim(content, ' ' || chr(9) || chr(10))), '^(figure|fig|table|chart|exhibit)'), false) is_caption
 from (select chunk_id, min(content) content, min(section_anchor) section_anchor, min(doc_id) doc_id, min(pages) pages, min(token_count) token_count from document_chunks group by chunk_id) where pages[1] is not null and token_count is not null""",
)
def x10_labels(spark: SparkSession, d: str) -> DataFrame:
    names = ("content", "section_anchor", "doc_id", "pages", "token_count")
    once = load(spark, d, "document_chunks").groupBy("chunk_id").agg(*(F.min(c).alias(c) for c in names))
    page = F.try_element_at("pages", F.lit(1))
    return once.where(page.isNotNull() & F.col("token_count").isNotNull()).select(
        "chunk_id",
        text.preview(F.col("content")).alias("preview"),
        text.query_prefix(F.coalesce("section_anchor", F.lit("")), "bge-small").alias("query_text"),
        text.element_id(F.col("doc_id"), page, F.col("token_count")).alias("element_id"),
        F.coalesce(text.is_caption(F.col("content")), F.lit(False)).alias("is_caption"),
    )


def _packed(budget: int, src: str) -> str:
    return f"""with recursive src as ({src}), {SENTENCES},
 counted as (select id, pos, sentence, length(sentence) // 4 t, max(pos) over (partition by id) last_pos from sentences),
 packed(id, pos, last_pos, piece, content, last, tokens, done) as (
  select id, pos, last_pos, 0, sentence, sentence, t, cast(null as struct(content varchar, tokens bigint)) from counted where pos = 0
  union all
  select c.id, c.pos, c.last_pos, case when p.tokens + c.t > {budget} then p.piece + 1 else p.piece end,
   case when p.tokens + c.t > {budget} then p.last || ' ' || c.sentence else p.content || ' ' || c.sentence end, c.sentence,
   case when p.tokens + c.t > {budget} then length(p.last) // 4 + c.t else p.tokens + c.t end,
   case when p.tokens + c.t > {budget} then struct_pack(content := p.content, tokens := p.tokens) end
  from packed p join counted c on c.id = p.id and c.pos = p.pos + 1)
 , pieces as (select id, piece - 1 n, done.content content, done.tokens tokens from packed where done is not null union all select id, piece, content, tokens from packed where pos = last_pos)"""


@query("c2_split_large", _packed(64, "select doc_id id, text body from documents") + " select id doc_id, cast(n as integer) piece_no, content, cast(tokens as integer) token_count from pieces")
def c2_split_large(spark: SparkSession, d: str) -> DataFrame:
    """Sentences packed to 64 tokens."""
    docs = _docs(spark, d)
    packed = docs.select("doc_id", F.posexplode(text.pack_sentences(text.sentences(F.col("text")), 64)).alias("piece_no", "x"))
    return packed.select("doc_id", "piece_no", "x.content", "x.token_count")


@query("c3_f3_fixed_size", _packed(512, "select doc_id id, text body from documents") + rf""" select id doc_id, id || '_chunk_' || n chunk_id, content, cast(tokens as integer) token_count, 'Full Document' section_anchor, 'full_doc' element_id from pieces where length({stripped("content")}) > 5""")
def c3_fixed_size(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_fixed(_docs(spark, d))


@query(
    "x11_prompts",
    f"""with {ELEMENTS}, top as (select doc_id, seq, content, row_number() over (partition by doc_id order by seq, element_id) r from elements where content is not null)
 select doc_id, 'Context:' || chr(10) || string_agg('[Document ' || r || ']' || chr(10) || content, chr(10) || chr(10) order by r) || chr(10) || chr(10) || 'Question: What changed?' || chr(10) || chr(10) || 'Answer only from the context and cite passages as [Document n].' prompt from top where r <= 3 group by doc_id""",
)
def x11_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Prompts over the first three chunks of every document (a prompt's context is a top-k)."""
    r = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq", "element_id"))
    top = elements(spark, d).where(F.col("content").isNotNull()).withColumn("r", r).where("r <= 3").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("r", "content"))).alias("all"))
    return top.select("doc_id", text.rag_prompt(F.lit("What changed?"), F.transform("all", lambda x: x["content"])).alias("prompt"))
