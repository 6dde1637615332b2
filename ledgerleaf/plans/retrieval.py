"""Queries on vectors, the store, lexical search, the uncertainty gate and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerleaf.functions import filters, records, scores, vectors
from ledgerleaf.functions.text import abstention_prompt
from ledgerleaf.operators import evaluation, lexical, rag, search
from ledgerleaf.plans.common import query
from ledgerleaf.sources import ingest, store
from ledgerleaf.sources.providers import HashEmbedder, generated
from ledgerleaf.sources.stages import new_path, stage
from ledgerleaf.sources.tables import load
from ledgerleaf.streaming.ingestion import document_stream, latest_statistics, rolling_statistics, rolling_stream, stream_into


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All rows, and the stated query set: every row whose id is divisible by 100."""
    rows = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return rows, rows.where(F.col("id") % 100 == 0).select(F.col("id").alias("query"), "vector")


_V = "v as (select vec_id id, cast(embedding as double[]) e, label from embeddings), q as (select id as query, e qe from v where id % 100 = 0)"
_COS = "1 - list_dot_product(qe, e) / (sqrt(list_dot_product(qe, qe)) * sqrt(list_dot_product(e, e)))"
_METRIC = {"cosine": _COS, "ip": "1 - list_dot_product(qe, e)", "l2": "list_dot_product(qe, qe) + list_dot_product(e, e) - 2 * list_dot_product(qe, e)"}


def _topk(k: int, metric: str = "cosine", where: str = "true") -> str:
    return f"""with {_V}, dist as (select query, id, round({_METRIC[metric]}, 9) distance from q cross join v where {where}),
 r as (select *, row_number() over (partition by query order by distance, id) rank from dist) select query, id, round(distance, 6) distance, cast(rank as integer) rank from r where rank <= {k}"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("distance", F.round("distance", 6))


@query("t1_vector_topk", _topk(5, where="label in (1, 2, 3) and id >= 10"))
def t1(spark: SparkSession, d: str) -> DataFrame:
    """Nearest five under a metadata filter."""
    rows, q = _vectors(spark, d)
    return _rounded(search.top_k(rows, q, 5, where=filters.where({"label": {"$in": [1, 2, 3]}, "id": {"$gte": 10}})))


@query("t2_j9_m8_cosine_topk", _topk(5))
def t2(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(search.top_k(*_vectors(spark, d), k=0))


@query("m8_l2_topk", _topk(5, "l2"))
def m8_l2(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(search.top_k(*_vectors(spark, d), metric="l2"))


@query("m8_ip_topk", _topk(5, "ip"))
def m8_ip(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(search.top_k(*_vectors(spark, d), metric="ip"))


@query("m9_normalized", "select vec_id, list_transform(cast(embedding as double[]), lambda x: round(x / sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[]))), 6)) unit from embeddings")
def m9(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "embeddings").select("vec_id", F.transform(vectors.normalized(F.col("embedding")), lambda x: F.round(x, 6)).alias("unit"))


@query("f1_metadata_filter", "select vec_id, label from embeddings where (label = 3 or label in (5, 7)) and vec_id >= 20 and label <> 5")
def f1(spark: SparkSession, d: str) -> DataFrame:
    spec = {"$and": [{"$or": [{"label": 3}, {"label": {"$in": [5, 7]}}]}, {"vec_id": {"$gte": 20}}, {"label": {"$ne": 5}}]}
    return load(spark, d, "embeddings", ["vec_id", "label"]).where(filters.where(spec))


@query("f2_content_filter", "select doc_id from documents where contains(text, 'inflation') and not contains(text, 'Inflation')")
def f2(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents", ["doc_id", "text"]).where(filters.where_document({"$and": [{"$contains": "inflation"}, {"$not_contains": "Inflation"}]}, "text")).select("doc_id")


@query(
    "t3_adaptive_topk",
    f"""with {_V}, dist as (select query, id, round({_COS}, 9) distance from q cross join v), r as (select *, row_number() over (partition by query order by distance, id) rank from dist)
 select query, id, cast(rank as integer) rank from r where rank <= case when query % 200 = 0 then 10 else 5 end""",
)
def t3(spark: SparkSession, d: str) -> DataFrame:
    rows, q = _vectors(spark, d)
    decisions = q.select("query", (F.col("query") % 200 == 0).alias("should_expand"), F.lit(False).alias("should_abstain"))
    return search.adaptive(search.top_k(rows, q, 10), decisions).select("query", "id", "rank")


@query(
    "t4_sources",
    f"""with {_V}, dist as (select query, id, round({_COS}, 9) distance from q cross join v), r as (select *, row_number() over (partition by query order by distance, id) rank from dist)
 select query, cast(count(*) as integer) n_sources, string_agg(id || ':' || case when length(text) > 200 then substring(text, 1, 200) || '...' else text end, ' | ' order by rank) sources from r join documents on doc_id = id where rank <= 5 group by query""",
)
def t4(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents", ["doc_id", "text"]).select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    s = rag.sources(search.top_k(*_vectors(spark, d)).join(docs, "id"))
    shown = F.transform("sources", lambda x: F.concat(x["id"].cast("string"), F.lit(":"), x["content"]))
    return s.select("query", F.size("sources").alias("n_sources"), F.array_join(shown, " | ").alias("sources"))


@query(
    "d14_pivoted_reply",
    f"with {_V}, dist as (select query, id, round({_COS}, 9) distance from q cross join v), r as (select *, row_number() over (partition by query order by distance, id) rank from dist) select query, cast(rank as integer) rank, id, 'row ' || id as content, round(distance, 6) distance from r where rank <= 3",
)
def p2_reply(spark: SparkSession, d: str) -> DataFrame:
    hits = search.top_k(*_vectors(spark, d), k=3)
    lists = hits.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "distance"))).alias("x"))
    pick = lambda n: F.transform("x", lambda v: v[n])
    replies = lists.select("query", pick("id").alias("ids"), F.transform("x", lambda v: F.concat(F.lit("row "), v["id"].cast("string"))).alias("contents"), pick("distance").alias("distances"))
    return _rounded(search.pivoted_reply(replies))


@query("t10_verification_queries")
def t10(spark: SparkSession, d: str) -> DataFrame:
    """Top three chunks for the stated query set of questions by the stand-in embedder; hashing has no SQL."""
    e = HashEmbedder()
    once = load(spark, d, "document_chunks", ["chunk_id", "content"]).where(F.col("content").isNotNull()).groupBy("chunk_id").agg(F.min("content").alias("content"))
    rows = e.documents(once).select(F.col("chunk_id").alias("id"), F.col("embedding").alias("vector"))
    n = F.regexp_extract("question_id", r"(\d+)$", 1).cast("long")
    asked = load(spark, d, "eval_questions", ["question_id", "query_text"]).select(n.alias("query"), F.col("query_text").alias("content")).where(F.col("query") % 100 == 0)
    return search.top_k(rows, e.queries(asked).select("query", F.col("embedding").alias("vector")), 3).select("query", "rank", F.col("id").alias("chunk_id"), F.round("distance", 6).alias("distance"))


def _logprobs(spark: SparkSession, d: str) -> DataFrame:
    """Slices of the vectors as log-probabilities: three tokens of twenty alternatives for every row."""
    e = load(spark, d, "embeddings", ["vec_id", "embedding"])
    return e.select(F.col("vec_id").alias("id"), F.posexplode(F.array(*(F.transform(F.slice("embedding", 1 + 20 * i, 20), lambda x: x.cast("double") * 8) for i in range(3)))).alias("pos", "logprobs"))


_ENTROPY = """tok as (select vec_id id, p, list_transform(cast(embedding[1 + 20 * p : 20 + 20 * p] as double[]), lambda x: exp(x * 8)) w from embeddings, range(3) t(p)),
 pr as (select id, p, list_transform(w, lambda x: x / list_sum(w)) pr from tok), h as (select id, p, -list_sum(list_transform(pr, lambda x: x * ln(x))) h from pr), e as (select id, count(*) n_tokens, avg(h) entropy from h group by id)"""


@query("m6_a12_m13_m14_entropy_gate", f"with {_ENTROPY} select id, n_tokens, round(entropy, 6) entropy, case when entropy > 2.0 then 'high' when entropy >= 1.5 then 'medium' else 'low' end uncertainty_level, case when entropy > 2.0 then 'NONE' when entropy >= 1.5 then 'MEDIUM' else 'HIGH' end confidence from e")
def m6(spark: SparkSession, d: str) -> DataFrame:
    g = rag.gated(rag.sequence_entropy(_logprobs(spark, d)))
    return g.select("id", "n_tokens", F.round("entropy", 6).alias("entropy"), "uncertainty_level", scores.confidence(F.col("uncertainty_level"), F.col("should_abstain")).alias("confidence"))


@query(
    "m6_deduplicated_entropy",
    """with tops as (select vec_id id, i, 't' || (i * 7 % 13) token, cast(embedding[i] as double) * 8 x from embeddings, range(1, 31) r(i)), last as (select id, token, arg_max(x, i) x from tops group by id, token),
 e as (select id, exp(x) / sum(exp(x)) over (partition by id) p from last) select id, cast(count(*) as integer) n_tokens, round(-sum(p * ln(p)), 6) entropy from e group by id""",
)
def m6_deduplicated(spark: SparkSession, d: str) -> DataFrame:
    """One token of thirty alternatives in which tokens recur: the last of each counts."""
    top = F.transform(F.slice("embedding", 1, 30), lambda x, i: F.struct(F.concat(F.lit("t"), ((i + 1) * 7 % 13).cast("string")).alias("token"), (x.cast("double") * 8).alias("logprob")))
    e = load(spark, d, "embeddings", ["vec_id", "embedding"]).select(F.col("vec_id").alias("id"), rag.deduplicated(top).alias("logprobs"))
    return e.select("id", F.size("logprobs").alias("n_tokens"), F.round(scores.token_entropy(F.col("logprobs")), 6).alias("entropy"))


_LOG = "log as (select user_id, event_id, case when event_type <> 'view' then value / 10 end entropy, value latency, event_type = 'click' expanded, event_type = 'error' abstained from events)"


def _log(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    return load(spark, d, "events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("seq"), F.when(kind != "view", F.col("value") / 10).alias("entropy"), F.col("value").alias("latency"), (kind == "click").alias("expanded"), (kind == "error").alias("abstained"))


@query("a7_query_statistics", f"with {_LOG} select count(*) total_queries, count(*) filter (where expanded) expanded_queries, count(*) filter (where abstained) abstained_queries, cast(count(*) filter (where expanded) as double) / count(*) expansion_rate, cast(count(*) filter (where abstained) as double) / count(*) abstention_rate, round(avg(entropy), 6) avg_entropy, round(avg(latency), 6) avg_latency from log")
def a7(spark: SparkSession, d: str) -> DataFrame:
    return rag.query_statistics(_log(spark, d))


@query(
    "a6_running_means",
    """with log as (select user_id, event_id, case when event_type <> 'view' then cast(round(value * 100) as bigint) end entropy, cast(round(value * 100) as bigint) latency from events)
 select user_id stream, event_id seq, round(avg(entropy) over w, 6) avg_entropy, round(avg(latency) over w, 6) avg_latency from log window w as (partition by user_id order by event_id rows unbounded preceding)""",
)
def a6(spark: SparkSession, d: str) -> DataFrame:
    """In whole hundredths, whose sums are exact in any order."""
    units = F.round(F.col("latency") * 100).cast("long")
    return rag.running_statistics(_log(spark, d).select("stream", "seq", F.when(F.col("entropy").isNotNull(), units).alias("entropy"), units.alias("latency")))


@query("stream_rolling_statistics", "select date_trunc('hour', ts) as start, event_type, count(*) n, round(avg(value), 6) mean_value from events group by all")
def rolling(spark: SparkSession, d: str) -> DataFrame:
    """The windowed aggregation of the streaming extension, over the finished table."""
    e = load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rolling_statistics(e).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("mean_value", 6).alias("mean_value"))


def _store(spark: SparkSession, **options) -> store.VectorStore:
    return store.VectorStore(spark, new_path(spark, "store"), dimension=2, **options)


def _records(spark: SparkSession, d: str, *names: str) -> DataFrame:
    """Every chunk once, with a vector of two numbers; the store is what is looked at, not the vectors."""
    e = load(spark, d, "document_chunks", ["chunk_id", "doc_id", "content", *names]).groupBy("chunk_id").agg(F.min("doc_id").alias("doc_id"), *(F.min(n).alias(n) for n in ("content", *names)))
    return e.withColumn("embedding", F.array(F.length("chunk_id").cast("float"), F.coalesce(F.length("content"), F.lit(0)).cast("float")))


@query("stream_rolling_run", "select date_trunc('hour', ts) as start, event_type, count(*) n, round(avg(value), 6) mean_value from events group by all")
def rolling_run(spark: SparkSession, d: str) -> DataFrame:
    """The same as a stream over the events' file, run to its end."""
    schema = load(spark, d, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))
    target = new_path(spark, "rolling")
    rolling_stream(events, target, new_path(spark, "rolling-state")).awaitTermination()
    return latest_statistics(spark, target).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("mean_value", 6).alias("mean_value"))


_UPSERT = """with e as (select chunk_id, min(doc_id) doc_id, min(content) content from document_chunks group by chunk_id),
 old as (select * from e where right(doc_id, 1) < 'm'), inc as (select chunk_id, doc_id, content || ' (new)' content from e where right(doc_id, 1) >= '6')
 select chunk_id, doc_id, md5(content) md5 from old where doc_id not in (select doc_id from inc) union all select chunk_id, doc_id, md5(content) from inc"""


@query("s7_f11_upsert", _UPSERT)
def s7(spark: SparkSession, d: str) -> DataFrame:
    """The operator alone: documents whose id ends before m are there, those from 6 on come in; both together are all documents, and they overlap."""
    e, end = _records(spark, d), F.substring("doc_id", -1, 1)
    return store.upserted(e.where(end < "m"), e.where(end >= "6").withColumn("content", F.concat("content", F.lit(" (new)")))).select("chunk_id", "doc_id", F.md5("content").alias("md5"))


@query("s7_store_upsert", _UPSERT)
def s7_store(spark: SparkSession, d: str) -> DataFrame:
    """The same through a store."""
    e, end, s = _records(spark, d), F.substring("doc_id", -1, 1), _store(spark)
    s.upsert(e.where(end < "m"))
    s.upsert(e.where(end >= "6").withColumn("content", F.concat("content", F.lit(" (new)"))))
    return s.read().select("chunk_id", "doc_id", F.md5("content").alias("md5"))


@query("s8_delete", "select chunk_id, coalesce(chunk_type, '') chunk_type from (select chunk_id, min(chunk_type) chunk_type, min(token_count) n from document_chunks group by chunk_id) where not coalesce(chunk_type = 'table' and n >= 100, false)")
def s8(spark: SparkSession, d: str) -> DataFrame:
    s = _store(spark)
    s.upsert(_records(spark, d, "chunk_type", "token_count"))
    s.delete({"chunk_type": "table", "token_count": {"$gte": 100}})
    return s.read().select("chunk_id", F.coalesce("chunk_type", F.lit("")).alias("chunk_type"))


@query(
    "s6_s9_s10_store_life",
    """with n as (select count(distinct chunk_id) n from document_chunks) select 'created' step, 'l2' metric, 0::bigint n_chunks union all select 'filled', 'l2', n from n union all select 'opened again', 'l2', n from n
 union all select 'filled again', 'l2', n from n union all select 'reset', 'l2', 0""",
)
def s9(spark: SparkSession, d: str) -> DataFrame:
    """A collection's life: what it is measured by stays, and opening it again makes no new one."""
    e, s = _records(spark, d), _store(spark, metric="l2")
    life = [("created", s.manifest.metric, s.count())]
    s.upsert(e)
    life.append(("filled", s.manifest.metric, s.count()))
    again = store.VectorStore(spark, s.path, "cosine", 3)
    life.append(("opened again", again.manifest.metric, again.count()))
    again.upsert(e)
    life.append(("filled again", again.manifest.metric, s.count()))
    again.reset()
    life.append(("reset", s.manifest.metric, s.count()))
    return spark.createDataFrame(life, "step string, metric string, n_chunks long")


@query("s9_count", "select count(distinct chunk_id) n_chunks, count(distinct doc_id) n_docs from document_chunks")
def s9_count(spark: SparkSession, d: str) -> DataFrame:
    s = _store(spark)
    s.upsert(_records(spark, d))
    return s.read().agg(F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("doc_id").alias("n_docs"))


@query(
    "t1_store_query",
    r"""with c as (select chunk_id, min(doc_id) doc_id, min(content) content, min(token_count) n from document_chunks group by chunk_id),
 v as (select chunk_id, content, cast(length(chunk_id) as double) x, cast(coalesce(length(content), 0) as double) y from c where n >= 20 and contains(coalesce(content, ''), 'e')),
 q as (select cast(regexp_extract(question_id, '(\d+)$', 1) as bigint) as query, cast(length(question_id) as double) x, cast(length(query_text) as double) y from eval_questions where cast(regexp_extract(question_id, '(\d+)$', 1) as bigint) % 100 = 0),
 r as (select query, chunk_id, (q.x - v.x) ** 2 + (q.y - v.y) ** 2 distance, row_number() over (partition by query order by (q.x - v.x) ** 2 + (q.y - v.y) ** 2, chunk_id) rank from q cross join v)
 select query, cast(rank as integer) rank, chunk_id, distance from r where rank <= 5""",
)
def t1_store(spark: SparkSession, d: str) -> DataFrame:
    """The nearest chunks of a store under filters of both kinds; equal distances go to the lesser chunk_id."""
    s = _store(spark, metric="l2")
    s.upsert(_records(spark, d, "token_count"))
    n = F.regexp_extract("question_id", r"(\d+)$", 1).cast("long")
    asked = load(spark, d, "eval_questions", ["question_id", "query_text"]).where(n % 100 == 0).select(n.alias("query"), F.array(F.length("question_id").cast("double"), F.length("query_text").cast("double")).alias("vector"))
    return s.query(asked, 5, {"token_count": {"$gte": 20}}, {"$contains": "e"}).select("query", "rank", "chunk_id", "distance")


@query("s5_point_scan", "select chunk_id, token_count from document_chunks where doc_id = (select min(doc_id) from document_chunks)")
def s5(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "document_chunks", ["chunk_id", "doc_id", "token_count"])
    return c.where(F.col("doc_id") == c.agg(F.min("doc_id")).first()[0]).select("chunk_id", "token_count")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """Chunks nested below their documents, as the processed files hold them."""
    names = ("content", "chunk_type", "token_count", "section_anchor", "pages", "element_ids", "element_types", "keywords", "source_count", "source_file")
    c = load(spark, d, "document_chunks").groupBy("doc_id", "chunk_id").agg(*(F.min(n).alias(n) for n in names))
    chunk = F.struct("chunk_id", "content", "chunk_type", "token_count", "section_anchor", "pages", "element_ids", "element_types", F.struct("keywords", "source_count").alias("metadata"))
    meta = load(spark, d, "document_metadata").groupBy("doc_id").agg(F.max("title").alias("title"), F.date_format(F.min("doc_date"), "yyyy-MM-dd").alias("creation_date"))
    nested = c.groupBy("doc_id").agg(F.collect_list(chunk).alias("chunks"), F.min("source_file").alias("source_file")).join(meta, "doc_id", "left")
    return nested.select("doc_id", F.struct("title", "creation_date", "source_file").alias("metadata"), "chunks", F.lit(None).cast("string").alias("_corrupt_record"))


_CHUNK_ROWS = """with c as (select doc_id, chunk_id, min(content) content, min(chunk_type) chunk_type, min(token_count) token_count, min(section_anchor) section_anchor, min(keywords) keywords from document_chunks group by doc_id, chunk_id),
 m as (select doc_id, max(title) title, strftime(min(doc_date), '%Y-%m-%d') creation_date from document_metadata group by doc_id)
 select chunk_id, doc_id, md5(coalesce(content, '')) md5, coalesce(chunk_type, 'text') chunk_type, coalesce(token_count, 0) token_count, coalesce(section_anchor, '') section_anchor, coalesce(title, '') doc_title, coalesce(creation_date, '') doc_date, coalesce(keywords, []) keywords from c left join m using (doc_id)"""


def _chunk_rows(documents: DataFrame) -> DataFrame:
    return ingest.chunk_rows(documents).select("chunk_id", "doc_id", F.md5("content").alias("md5"), "chunk_type", "token_count", "section_anchor", "doc_title", "doc_date", "keywords")


@query("s3_p1_j10_chunk_rows", _CHUNK_ROWS)
def p1_rows(spark: SparkSession, d: str) -> DataFrame:
    return _chunk_rows(_documents(spark, d))


@query("s3_s4_documents_written_and_read", _CHUNK_ROWS)
def s3_files(spark: SparkSession, d: str) -> DataFrame:
    """The documents are written as JSON, a folder for each, and read again."""
    at = new_path(spark, "processed")
    ingest.write_documents(_documents(spark, d), at)
    return _chunk_rows(ingest.read_written(spark, at))


@query("s4_stream_into_store", "select chunk_id, min(doc_id) doc_id, md5(coalesce(min(content), '')) md5 from document_chunks group by chunk_id")
def s4_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same files as a stream into a store, with the stand-in embedder; run to its end."""
    at, e = new_path(spark, "processed"), HashEmbedder(dimension=2)
    ingest.write_documents(_documents(spark, d), at)
    s = _store(spark)
    stream_into(document_stream(spark, at), s, e.documents, new_path(spark, "stream")).awaitTermination()
    return s.read().select("chunk_id", "doc_id", F.md5("content").alias("md5"))


@query("a4_ingestion_stats", "select count(distinct doc_id) docs_processed, count(*) chunks, cast(sum(coalesce(n, 0)) as bigint) tokens from (select doc_id, chunk_id, min(token_count) n from document_chunks group by doc_id, chunk_id)")
def a4(spark: SparkSession, d: str) -> DataFrame:
    return ingest.ingestion_stats(_documents(spark, d)).select("docs_processed", "chunks", "tokens")


def _asked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = load(spark, d, "documents", ["doc_id", "text"]).select(F.col("doc_id").alias("id"), "text")
    return docs, load(spark, d, "eval_questions", ["question_id", "query_text"]).select(F.col("question_id").alias("query"), F.col("query_text").alias("text"))


_BM25 = r"""d as (select doc_id id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') ts from documents), s as (select count(*) n, avg(len(ts)) mean from d),
 qt as (select distinct question_id as query, unnest(regexp_extract_all(lower(query_text), '[\p{L}\p{N}]+')) term from eval_questions), voc as (select distinct term from qt),
 tf as (select id, len, term, count(*) tf from (select id, len(ts) len, unnest(ts) term from d) semi join voc using (term) group by id, len, term),
 df as (select term, count(*) df from tf group by term),
 w as (select term, id, ln(1 + (s.n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / s.mean)) w from tf join df using (term) cross join s),
 sc as (select query, id, round(sum(w), 6) score from qt join w using (term) group by query, id),
 ranked as (select query, id, score, cast(row_number() over (partition by query order by score desc, id) as integer) rank from sc)"""


@query("r1_bm25", f"with {_BM25} select query, id, score, rank from ranked where rank <= 5")
def r1(spark: SparkSession, d: str) -> DataFrame:
    return lexical.bm25(*_asked(spark, d)).select("query", "id", "score", "rank")


@query("r2_routes", "select question_id as query, case when regexp_matches(query_text, '[0-9]|[\"“”]') then 0.6 else 0.4 end lexical_weight, case when regexp_matches(query_text, '[0-9]|[\"“”]') then 0.4 else 0.6 end vector_weight from eval_questions")
def r2(spark: SparkSession, d: str) -> DataFrame:
    return lexical.routes(_asked(spark, d)[1])


@query(
    "r3_rank_fusion",
    f"""with {_V}, dc as (select query, id, round({_COS}, 9) x from q cross join v), di as (select query, id, round({_METRIC["l2"]}, 9) x from q cross join v where label <> 3),
 a as (select query, id, row_number() over (partition by query order by x, id) r from dc qualify r <= 10), b as (select query, id, row_number() over (partition by query order by x, id) r from di qualify r <= 10),
 f as (select coalesce(a.query, b.query) as query, coalesce(a.id, b.id) id, round(coalesce(1.0::double / (60 + a.r), 0) + coalesce(1.0::double / (60 + b.r), 0), 9) score from a full join b on a.query = b.query and a.id = b.id),
 o as (select *, row_number() over (partition by query order by score desc, id) rank from f) select query, id, round(score, 6) score, cast(rank as integer) rank from o where rank <= 5""",
)
def r3(spark: SparkSession, d: str) -> DataFrame:
    rows, q = _vectors(spark, d)
    both = lexical.fused(search.top_k(rows, q, 10), search.top_k(rows, q, 10, "l2", where=F.col("label") != 3))
    return both.withColumn("score", F.round("score", 6))


@query(
    "r4_reranked",
    f"""with {_BM25}, best as (select query, id from ranked where rank <= 10), qd as (select query, list(distinct term) qs from qt group by query),
 o as (select query, id, cast(len(list_intersect(qs, list_distinct(ts))) as double) / len(qs) rerank_score from best join qd using (query) join d using (id)),
 x as (select *, cast(row_number() over (partition by query order by rerank_score desc, id) as integer) rank from o) select query, id, rerank_score, rank from x where rank <= 5""",
)
def r4(spark: SparkSession, d: str) -> DataFrame:
    """Lexical candidates reranked by the stand-in scorer."""
    docs, asked = _asked(spark, d)
    hits = lexical.bm25(docs, asked, 10).join(docs.select("id", F.col("text").alias("content")), "id").join(asked.select("query", F.col("text").alias("question")), "query")
    return lexical.reranked(hits, lexical.term_overlap(F.col("question"), F.col("content"))).select("query", "id", "rerank_score", "rank")


_PRED = "p as (select (event_id * 37 % 101) / 100.0 confidence, event_type in ('click', 'purchase') correct from events)"


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select(((F.col("event_id") * 37 % 101) / 100.0).alias("confidence"), F.col("event_type").isin("click", "purchase").alias("correct"))


@query("r7_calibration", f"with {_PRED} select cast(least(floor(cast(confidence as double) * 10), 9) as integer) bin, count(*) n, round(avg(cast(confidence as double)), 6) mean_confidence, round(avg(correct::int), 6) accuracy, round(abs(avg(cast(confidence as double)) - avg(correct::int)), 6) gap from p group by 1")
def r7(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.calibration(_predictions(spark, d))


def _grades(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    return e.select(F.col("user_id").alias("question_id"), F.col("event_id").alias("answer_id"), *(((F.col("event_id") * m % 11).cast("double")).alias(k) for m, k in ((7, "accuracy"), (5, "completeness"), (3, "clarity"), (2, "citations"))))


@query(
    "r8_preferences",
    """with g as (select user_id question_id, event_id answer_id, round(0.4 * (event_id * 7 % 11) + 0.3 * (event_id * 5 % 11) + 0.2 * (event_id * 3 % 11) + 0.1 * (event_id * 2 % 11), 6) grade from events),
 b as (select *, row_number() over (partition by question_id order by grade desc, answer_id) rb, row_number() over (partition by question_id order by grade, answer_id) rw from g)
 select x.question_id, x.answer_id chosen, y.answer_id rejected, cast(round(x.grade - y.grade, 6) as double) gap from b x join b y on x.question_id = y.question_id and x.rb = 1 and y.rw = 1 where x.grade >= 7 and x.grade - y.grade >= 0.5""",
)
def r8(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.preferences(evaluation.graded(_grades(spark, d)))


@query("j8_citations", "select event_id as query, n, event_id * 10 + n id from events, (select unnest([1, 3]) n)")
def j8(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events", ["event_id"])
    hits = e.select(F.col("event_id").alias("query"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("rank")).withColumn("id", F.col("query") * 10 + F.col("rank"))
    return rag.cited(e.select(F.col("event_id").alias("query"), F.lit("Up [Document 1], then down [Document 3][Document 1]; [Document 9] is not there.").alias("answer")), hits)


@query("u3_responses")
def u3(spark: SparkSession, d: str) -> DataFrame:
    """Questions to answers: lexical retrieval to ten, prompts over five, the stand-in generator, the gate, and a second answer where the first is unsure."""
    docs, asked = _asked(spark, d)
    hits = lexical.bm25(docs, asked, 10).join(docs.select("id", F.col("text").alias("content")), "id").withColumn("distance", -F.col("score"))
    out = rag.answered(asked, stage(hits, "hits"), generated)
    return out.select("query", "answer", F.round("entropy", 6).alias("entropy"), "abstained", "expanded", "confidence", "n_sources")


@query(
    "x11_abstention_prompts",
    r"""select question_id as query, 'The documents at hand leave the answer to this question too uncertain (entropy ' || printf('%.2f', 2 + difficulty / 4.0) || ').' || chr(10) || chr(10) || 'Question: ' || query_text || chr(10) || chr(10)
 || 'Say in one or two sentences that no reliable answer can be given, and what kind of document would be needed.' prompt from eval_questions where difficulty is not null""",
)
def x11_abstention(spark: SparkSession, d: str) -> DataFrame:
    q = load(spark, d, "eval_questions", ["question_id", "query_text", "difficulty"]).where(F.col("difficulty").isNotNull())
    return q.select(F.col("question_id").alias("query"), abstention_prompt(F.col("query_text"), 2 + F.col("difficulty") / 4.0).alias("prompt"))


@query("s15_question_records", "select question_id, query_text, expected_answer, question_type, difficulty, requires_table, requires_multi_doc, source_documents, key_values from eval_questions")
def s15(spark: SparkSession, d: str) -> DataFrame:
    """Questions to JSON text and back."""
    return records.from_records(records.to_records(load(spark, d, "eval_questions"), records.QUESTION), records.QUESTION)


@query(
    "s15_date_metadata_records",
    """select distinct doc_id, case when lower(trim(doc_type)) in ('statement', 'minutes', 'presconf', 'sep', 'implementation') then lower(trim(doc_type)) end doc_type, strftime(doc_date, '%Y-%m-%dT%H:%M:%S') iso_date, doc_date, meeting_date, pages from document_metadata""",
)
def s15_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Metadata to JSON text with ISO dates and back to times."""
    m = records.from_records(records.to_records(load(spark, d, "document_metadata"), records.METADATA), records.METADATA)
    return m.select("doc_id", records.document_type(F.col("doc_type")).alias("doc_type"), F.col("doc_date").alias("iso_date"), records.from_iso(F.col("doc_date")).alias("doc_date"), records.from_iso(F.col("meeting_date")).alias("meeting_date"), "pages").distinct()
