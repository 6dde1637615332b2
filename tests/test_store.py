import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerleaf.functions import filters
from ledgerleaf.sources import ingest, providers, stages
from ledgerleaf.sources.store import VectorStore, deleted, upserted


def test_upsert_replaces_documents_and_adds_rows_without_one(spark):
    old = spark.createDataFrame([("c1", "a"), ("c2", "b"), ("c3", None)], "chunk_id string, doc_id string")
    new = spark.createDataFrame([("c4", "a"), ("c5", None), ("c6", "")], "chunk_id string, doc_id string")
    once = upserted(old, new)
    assert sorted(r.chunk_id for r in once.collect()) == ["c2", "c3", "c4", "c5", "c6"]


def test_delete_keeps_rows_of_unknown_truth(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "i int, k string")
    assert sorted(r.i for r in deleted(df, filters.where({"k": "x"})).collect()) == [2, 3]


def test_filters(spark):
    df = spark.range(10).withColumn("k", (F.col("id") % 3).cast("string"))
    assert df.where(filters.where({"$or": [{"id": {"$lt": 2}}, {"$and": [{"id": {"$gt": 7}}, {"k": {"$nin": ["0"]}}]}]})).count() == 3
    assert df.where(filters.where({})).count() == 10
    for bad in ({"id": {"$like": 1}}, {"$xor": []}, {"$or": []}):
        with pytest.raises(ValueError):
            filters.where(bad)


def test_store_round_trip(spark, tmp_path):
    e = providers.HashEmbedder()
    rows = e.documents(spark.createDataFrame([("c1", "a", "inflation rose"), ("c2", "b", "employment fell")], "chunk_id string, doc_id string, content string"))
    s = VectorStore(spark, str(tmp_path / "store"), "l2", e.dimension)
    q = e.queries(spark.createDataFrame([(7, "inflation rose")], "query long, content string")).select("query", F.col("embedding").alias("vector"))
    assert s.count() == 0 and s.query(q).count() == 0
    s.upsert(rows)
    s.upsert(rows)
    assert s.count() == 2 and s.query(q, 1).first().chunk_id == "c1"
    assert s.query(q, 5, {"doc_id": "b"}).first().chunk_id == "c2" and s.query(q, 5, None, {"$contains": "zzz"}).count() == 0
    with pytest.raises(ValueError):
        s.upsert(rows.withColumn("embedding", F.slice("embedding", 1, 3)))
    s.delete({"doc_id": "a"})
    assert s.count() == 1
    s.reset()
    assert s.count() == 0 and VectorStore(spark, str(tmp_path / "store")).manifest.metric == "l2"


def test_documents_good_bad_hidden_and_missing(spark, tmp_path):
    good = {"doc_id": "a", "metadata": {"title": "T"}, "chunks": [{"chunk_id": "a_0", "content": "x", "token_count": 3}]}
    for name, body in (("a", json.dumps(good)), ("b", "{broken"), (".hidden", json.dumps(good)), ("c", json.dumps({"doc_id": "c"}))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "rag_chunks.json").write_text(body)
    docs = ingest.read_documents(spark, str(tmp_path)).cache()
    assert tuple(ingest.ingestion_stats(docs).first()) == (1, 1, 1, 1, 3)
    row = ingest.chunk_rows(docs).first()
    assert (row.chunk_id, row.doc_title, row.doc_date, row.pages, row.source_count) == ("a_0", "T", "", [], 0)
    assert ingest.imported(ingest.exported(ingest.chunk_rows(docs))).first() == row
    assert ingest.read_documents(spark, str(tmp_path / "none")).count() == 0
    assert ingest.read_documents(spark, str(tmp_path), "a").count() == 1


def test_stream_into_store(spark, tmp_path):
    from ledgerleaf.streaming import ingestion

    (tmp_path / "in" / "a").mkdir(parents=True)
    (tmp_path / "in" / "a" / "rag_chunks.json").write_text(json.dumps({"doc_id": "a", "chunks": [{"chunk_id": "a_0", "content": "x y"}]}))
    e = providers.HashEmbedder()
    s = VectorStore(spark, str(tmp_path / "s"), dimension=e.dimension)
    ingestion.stream_into(ingestion.document_stream(spark, str(tmp_path / "in")), s, e.documents, str(tmp_path / "cp")).awaitTermination()
    assert s.count() == 1


def test_rolling_stream_updates_windows(spark, tmp_path):
    from ledgerleaf.streaming import ingestion

    schema = "ts timestamp, event_type string, value double"

    def feed(*rows):
        spark.createDataFrame(spark.createDataFrame(rows, "ts string, event_type string, value double").selectExpr("cast(ts as timestamp) ts", "event_type", "value").collect(), schema).write.mode("append").parquet(str(tmp_path / "in"))
        events = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        ingestion.rolling_stream(events, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        return sorted((str(r.start), r.event_type, r.n, r.mean_value) for r in ingestion.latest_statistics(spark, str(tmp_path / "out")).collect())

    assert feed(("2020-01-01 10:05:00", "a", 1.0), ("2020-01-01 10:10:00", "a", 3.0)) == [("2020-01-01 10:00:00", "a", 2, 2.0)]
    # a second batch goes on with the first's window; what is later than the watermark allows is dropped
    assert feed(("2020-01-01 10:59:00", "a", 5.0), ("2020-01-01 08:00:00", "a", 9.0), ("2020-01-01 12:00:00", "b", 1.0)) == [("2020-01-01 10:00:00", "a", 3, 3.0), ("2020-01-01 12:00:00", "b", 1, 1.0)]


def test_provider_failure_is_a_message_not_zeros(spark):
    class Broken:
        def load(self):
            def call(x):
                raise RuntimeError("down")

            return call

    r = providers.mapped(spark.createDataFrame([("x",)], "c string"), Broken(), "c", "out", "array<float>").first()
    assert r.out is None and "down" in r.out_error


def test_retry_policy():
    waits, temperatures = [], []

    def call(t):
        temperatures.append(t)
        return "ok" if len(temperatures) == 3 else None

    assert providers.RetryPolicy(temperature=0.1).run(call, waits.append) == "ok"
    assert temperatures == pytest.approx([0.1, 0.15, 0.2]) and waits == [1, 2]
    with pytest.raises(LookupError):
        providers.RetryPolicy().run(lambda t: None, waits.append)


def test_pages_of_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\fthree")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe\xff")
    rows = providers.read_pages(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert sorted((r.page, r.text) for r in rows if r.problem is None) == [(1, "one"), (1, "two"), (2, "three")]
    assert [r.problem[:7] for r in rows if r.problem] == ["Unicode"]


def test_shared_folder_is_the_sessions(spark):
    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Session:
        """The setting can't be changed in a running session, so a stand-in carries it."""

        conf = Conf({"spark.checkpoint.dir": "file:///shared/x/"})

    assert stages.shared_dir(Session()) == "file:///shared/x"
    path = stages.new_path(spark, "label")
    assert path.startswith(stages.shared_dir(spark)) and path != stages.new_path(spark, "label")
    assert stages.stage(spark.range(3), "x").count() == 3


def test_a_change_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    schema = "chunk_id string, doc_id string, content string, embedding array<float>"
    rows = spark.createDataFrame([(f"c{i}", f"d{i}", "x", [1.0, 2.0]) for i in range(40)], schema)
    s = VectorStore(spark, str(tmp_path / "s"), dimension=2, buckets=8)
    s.upsert(rows)
    before = s.manifest
    s.upsert(spark.createDataFrame([("c3", "d3", "y", [1.0, 2.0])], schema).withColumn("more", F.lit(7)))
    after = s.manifest
    assert after.number == before.number + 1 and sum(after.parts[b] != before.parts[b] for b in before.parts) == 1
    assert {(r.chunk_id, r.content, r.more) for r in s.read().where("chunk_id in ('c3', 'c4')").collect()} == {("c3", "y", 7), ("c4", "x", None)} and s.count() == 40
    s.delete({"doc_id": "d5"})
    assert s.count() == 39 and sum(s.manifest.parts.get(b) != after.parts[b] for b in after.parts) == 1
    # versions that no recent manifest names are gone
    names = {p.name for p in (tmp_path / "s" / "data").iterdir()}
    assert names == set(after.parts.values()) | set(s.manifest.parts.values()) and len(list((tmp_path / "s" / "manifests").glob("*.json"))) == 2


def test_of_two_writers_the_second_fails(spark, tmp_path):
    s = VectorStore(spark, str(tmp_path / "s"), dimension=2)
    stale = s.manifest
    s.reset()
    with pytest.raises(RuntimeError):
        s._publish(stale.__class__(stale.number + 1, "l2", 2, 8))
    assert s.manifest.metric == "cosine"


def test_embeddings_are_worked_out_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = spark.createDataFrame([(f"c{i}", "d", "x", [1.0, 2.0]) for i in range(10)], "chunk_id string, doc_id string, content string, embedding array<float>")
    s = VectorStore(spark, str(tmp_path / "s"), dimension=2)
    for n in (10, 20):
        s.upsert(rows.mapInPandas(count, rows.schema))
        assert seen.value == n and s.count() == 10


def test_hits_carry_chunk_ids_and_ties_go_to_the_lesser(spark, tmp_path):
    rows = spark.createDataFrame([(c, "d", c, [1.0, 0.0]) for c in ("b", "a", "c10", "c9")], "chunk_id string, doc_id string, content string, embedding array<float>")
    s = VectorStore(spark, str(tmp_path / "s"), dimension=2)
    s.upsert(rows)
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query long, vector array<double>")
    assert [r.chunk_id for r in s.query(q, 3).orderBy("rank").collect()] == ["a", "b", "c10"]


def test_documents_written_and_read(spark, tmp_path):
    docs = spark.createDataFrame([("a b", ("T", None, "f"), [("c1", "x\ny")])], "doc_id string, metadata struct<title:string,creation_date:string,source_file:string>, chunks array<struct<chunk_id:string,content:string>>")
    ingest.write_documents(docs, str(tmp_path / "out"))
    row = ingest.chunk_rows(ingest.read_written(spark, str(tmp_path / "out"))).first()
    assert (row.chunk_id, row.doc_id, row.content, row.doc_title) == ("c1", "a b", "x\ny", "T")
    assert ingest.read_written(spark, str(tmp_path / "out"), "a b").count() == 1


def test_stages_can_be_cleared(spark):
    df = stages.stage(spark.range(3), "gone")
    path = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:")
    assert os.path.exists(path) and stages.clear(spark) >= 1 and not os.path.exists(path)
