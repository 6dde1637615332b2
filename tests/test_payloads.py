import pytest
from pyspark.sql import functions as F

from ledgerleaf import config
from ledgerleaf.functions import scores, semistructured
from ledgerleaf.operators import evaluation, lexical, rag, search


def repaired(spark, values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").orderBy("i").select(semistructured.repaired_json(F.col("t"))).collect()]


def test_repair(spark):
    got = repaired(spark, ['{"a": 1}', '```json\n{"a": 1}\n```', 'Here: {"a": 1} and {"b": {"c": 2}} done', "see [1, [2]] only", "nothing", None])
    assert got == ['{"a": 1}', '{"a": 1}', '{"b": {"c": 2}}', "[1, [2]]", semistructured.FAILED, None]


def test_chart_fields_present_but_null_are_not_missing(spark):
    rows = ['{"chart_type": "bar", "title": null, "key_insights": ["x"]}', '{"title": "T"}', '{"chart_type": "bar"}', '{"chart_type": "bar", "title": "T", "data_series": [], "key_insights": []}', '{"chart_type": "bar", "title": "T", "data_series": [{"name": "s"}]}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, j string").withColumn("c", F.from_json("j", semistructured.CHART))
    got = [r[0] for r in df.orderBy("i").select(semistructured.chart_problem(F.col("c"), F.col("j"))).collect()]
    assert got == ["Valid chart data", "Missing required field: chart_type", "Missing required field: title", "No data or insights extracted", "Valid chart data"]
    assert [r[0].status for r in df.orderBy("i").select(semistructured.chart_result(F.col("c"), F.col("j"))).collect()] == ["PASS", "PARTIAL", "PARTIAL", "PARTIAL", "PASS"]


@pytest.mark.parametrize(
    ("text", "message"),
    [("a,b\n1,2\n3,4", "Valid CSV"), ("a,b", "CSV string too short"), (None, "CSV string too short"), ("aaaaaa,bbbbbb", "No data rows"), ("aaaaaaaa\n1\n2\n3", "Less than 2 columns"), ("a,,ccccccc\n1,2,3", "Unnamed columns detected")],
)
def test_csv(text, message):
    assert semistructured.check_csv(text)[3] == message


def test_csv_drops_empty_columns():
    assert semistructured.check_csv("a,bbbb,cccc\n1,,2\n3,,4")[4] == [{"a": "1", "cccc": "2"}, {"a": "3", "cccc": "4"}]


def test_csv_quotes_blank_lines_and_wide_rows():
    assert semistructured.check_csv('a,"b, c"\n"1\n2",3\n\n4,NA\n')[4] == [{"a": "1\n2", "b, c": "3"}, {"a": "4"}]
    assert semistructured.check_csv("a,bbbbbbb\n1,2,3")[3] == "Parse error" == semistructured.check_csv('a,bbbbb\n"1,2')[3]
    assert semistructured.check_csv("a,a,bbbbb\n1,2\n3,4,5")[4] == [{"a": "1", "a.1": "2"}, {"a": "3", "a.1": "4", "bbbbb": "5"}]


def test_gate_boundaries(spark):
    rows = spark.createDataFrame([(1, 1.5), (2, 2.0), (3, 2.000001), (4, 1.4), (5, None)], "id int, entropy double")
    got = {r.id: (r.uncertainty_level, r.should_expand, r.should_abstain) for r in rag.gated(rows).collect()}
    assert got == {1: ("medium", True, False), 2: ("medium", True, False), 3: ("high", False, True), 4: ("low", False, False), 5: (None, False, False)}


def test_entropy_and_repeated_tokens(spark):
    df = spark.createDataFrame([([("a", -1.0), ("b", -2.0), ("a", -3.0)],)], "top array<struct<token:string,logprob:double>>")
    assert df.select(rag.deduplicated(F.col("top"))).first()[0] == [-2.0, -3.0]
    assert df.select(scores.token_entropy(F.array().cast("array<double>"))).first()[0] is None


def test_empty_retrieval(spark):
    q = spark.createDataFrame([(1, "x")], "query long, text string")
    hits = spark.createDataFrame([], "query long, rank int, id long, content string, distance double")
    gen = spark.createDataFrame([], "query long, answer string, entropy double")
    r = rag.responses(q, hits, gen).first()
    assert (r.answer, r.confidence, r.n_sources, r.abstained) == (rag.NOTHING_FOUND, "UNKNOWN", 0, False)


def test_statistics_of_an_empty_log(spark):
    r = rag.query_statistics(spark.createDataFrame([], "entropy double, latency double, expanded boolean, abstained boolean")).first()
    assert (r.total_queries, r.expansion_rate, r.avg_entropy) == (0, 0.0, None)


def test_topk_ties_zero_vectors_and_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0]), (6, [0.0, 2.0])], "id long, vector array<double>")
    q = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 1.0])], "query long, vector array<double>")
    monkeypatch.setattr(search, "BLOCK_BYTES", 1)
    got = {(r.query, r.rank): r.id for r in search.top_k(rows, q, 2).collect()}
    assert got == {(10, 1): 1, (10, 2): 2, (11, 1): 6, (11, 2): 1}
    assert search.top_k(rows.limit(0), q).count() == 0 and search.top_k(rows, q.limit(0)).count() == 0


def test_topk_is_monotone_in_k(spark):
    import numpy as np

    v = np.random.default_rng(1).normal(size=(300, 8)).tolist()
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "id long, vector array<double>")
    q = rows.where("id < 3").withColumnRenamed("id", "query")
    small, large = ({(r.query, r.id) for r in search.top_k(rows, q, k).collect()} for k in (3, 40))
    assert small < large and len(large) == 120


def test_bm25_on_empty_and_null(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "rates rose")], "id long, text string")
    q = spark.createDataFrame([("a", "rates"), ("b", None), ("c", "")], "query string, text string")
    assert [(r.query, r.id) for r in lexical.bm25(docs, q).collect()] == [("a", 3)]


def test_calibration(spark):
    p = spark.createDataFrame([(1.0, True), (0.95, False), (None, True), (0.0, False)], "confidence double, correct boolean")
    assert {r.bin: r.n for r in evaluation.calibration(p).collect()} == {0: 1, 9: 2}
    assert evaluation.expected_calibration_error(p).first().n == 3


def test_settings(spark):
    spark.conf.set("ledgerleaf.retrieval.top_k", "7")
    try:
        assert config.settings(spark).retrieval.top_k == 7
    finally:
        spark.conf.unset("ledgerleaf.retrieval.top_k")
    with pytest.raises(ValueError):
        config.Generation(temperature=3.0)
