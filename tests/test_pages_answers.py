"""Composed operators: pages to elements, expanding answers, endpoints, records, logs."""

import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from ledgerleaf.functions import records, text
from ledgerleaf.operators import chunking, lexical, pages, rag
from ledgerleaf.sources import logs, providers

PAGE = "MINUTES OF THE COMMITTEE\nRates rose in the year.\nThey may fall.\nTable 1: Rates\na | b | c\n1 | 2 | 3\f\fSECOND PART HERE\nMore inflation text."


def files(spark, **contents):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in contents.items()], "path string, content binary")


def test_pages_become_elements_in_order(spark):
    blocks = providers.read_pages(files(spark, a=PAGE.encode(), b=b"\xff\xfe"))
    rows = pages.page_elements(blocks).orderBy("doc_id", "seq").collect()
    good = [(r.page, r.kind, r.content, r.section_anchor) for r in rows if r.doc_id == "a"]
    assert good == [
        (1, "HEADER", "MINUTES OF THE COMMITTEE", "MINUTES OF THE COMMITTEE"), (1, "TEXT", "Rates rose in the year.\nThey may fall.", "MINUTES OF THE COMMITTEE"), (1, "CAPTION", "Table 1: Rates", "MINUTES OF THE COMMITTEE"),
        (1, "TABLE", "a | b | c\n1 | 2 | 3", "MINUTES OF THE COMMITTEE"), (3, "HEADER", "SECOND PART HERE", "SECOND PART HERE"), (3, "TEXT", "More inflation text.", "SECOND PART HERE"),
    ]
    table = next(r for r in rows if r.kind == "TABLE")
    assert table.caption_text == "Table 1: Rates" and table.vision_prompt == "Section: MINUTES OF THE COMMITTEE. Caption: Table 1: Rates." and table.status == "PASS" and table.quality == pytest.approx(0.8)
    bad = [r for r in rows if r.doc_id == "b"]
    assert len(bad) == 1 and bad[0].kind is None and "Unicode" in bad[0].problem
    # what comes out can be chunked
    chunks = chunking.chunk_sections(pages.page_elements(blocks).where(F.col("kind").isNotNull())).collect()
    assert {c.section_anchor for c in chunks} == {"MINUTES OF THE COMMITTEE", "SECOND PART HERE"}
    assert pages.page_elements(blocks.limit(0)).count() == 0


def test_failing_detector_and_reader_leave_a_message(spark):
    class Broken:
        def load(self):
            def call(x):
                raise RuntimeError("down")

            return call

    blocks = providers.read_pages(files(spark, a=PAGE.encode()))
    rows = pages.page_elements(blocks, detector=Broken()).collect()
    assert {r.page for r in rows} == {1, 3} and all(r.kind is None and "down" in r.problem for r in rows)
    rows = pages.page_elements(blocks, reader=Broken()).where("kind = 'TABLE'").collect()
    assert [(r.status, r.content) for r in rows] == [("FAIL", None)]


def fixed(entropies):
    """A generator whose uncertainty is set by the question and the number of passages."""

    def generate(prompts):
        n = F.size(F.regexp_extract_all("prompt", F.lit(r"\[Document (\d+)\]\n"), F.lit(1)))
        kind = F.regexp_extract("prompt", r"Question: (\w+)", 1)
        spread = F.create_map(*(x for k, v in entropies.items() for x in (F.lit(k), F.lit(v))))[kind]
        equal = F.when(spread == "sure", F.array(F.lit(0.0))).when((spread == "unsure") & (n <= 2), F.array_repeat(F.lit(-1.6), 5)).when(spread == "unsure", F.array(F.lit(0.0))).otherwise(F.array_repeat(F.lit(-3.0), 20))
        return prompts.select("query", F.concat(F.lit("from "), n.cast("string")).alias("answer"), F.array(equal).alias("logprobs"))

    return generate


def test_unsure_questions_are_asked_again_over_more(spark):
    q = spark.createDataFrame([(1, "sure x"), (2, "unsure x"), (3, "lost x"), (4, "none x")], "query long, text string")
    hits = spark.createDataFrame([(k, r, 10 * k + r, f"p{r}", float(r)) for k in (1, 2, 3) for r in (1, 2, 3, 4)], "query long, rank int, id long, content string, distance double")
    got = {r.query: r for r in rag.answered(q, hits, fixed({"sure": "sure", "unsure": "unsure", "lost": "lost"}), 2).collect()}
    assert (got[1].answer, got[1].expanded, got[1].n_sources, got[1].confidence) == ("from 2", False, 2, "HIGH")
    assert (got[2].answer, got[2].expanded, got[2].n_sources, got[2].confidence) == ("from 4", True, 4, "HIGH") and got[2].first_entropy == pytest.approx(1.609, abs=1e-3) and got[2].entropy == 0
    assert (got[3].answer, got[3].abstained, got[3].expanded, got[3].n_sources) == (rag.ABSTENTION, True, False, 2)
    assert (got[4].answer, got[4].confidence, got[4].expanded) == (rag.NOTHING_FOUND, "UNKNOWN", False)


def test_expanded_context_has_no_passage_twice(spark):
    df = spark.createDataFrame([([1, 2], [2, 3, 1, 4])], "a array<int>, b array<int>")
    assert df.select(rag.expanded_context(F.col("a"), F.col("b"))).first()[0] == [1, 2, 3, 4]


def test_bm25_against_brute_force_with_stop_words(spark):
    import math
    import random

    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(["the", "of"] * rnd.randrange(1, 3) + [vocabulary[min(29, int(rnd.expovariate(0.15)))] for _ in range(rnd.randrange(1, 30))])) for i in range(400)] + [(400, None), (401, "")]
    asked = [(f"q{i}", "the of " + " ".join(rnd.sample(vocabulary, 3))) for i in range(12)] + [("stop", "the of"), ("twice", "w1 w1 the")]
    words = {i: (t or "").split() for i, t in docs}
    mean = sum(map(len, words.values())) / len(words)

    def score(query, i):
        total = 0.0
        for t in set(query.split()):
            df, tf = sum(t in w for w in words.values()), words[i].count(t)
            if tf:
                total += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words[i]) / mean))
        return round(total, 6)

    for k in (1, 5):
        got = {}
        for r in lexical.bm25(spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(asked, "query string, text string"), k).orderBy("query", "rank").collect():
            got.setdefault(r.query, []).append((r.id, pytest.approx(r.score, abs=2e-6)))
        for name, query in asked:
            best = sorted(((score(query, i), i) for i in words if score(query, i) > 0), key=lambda x: (-x[0], x[1]))[:k]
            assert [(i, s) for s, i in best] == got[name]


@pytest.fixture
def endpoint():
    """A server of chat completions and layouts that fails at its first call."""
    calls = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            calls.append((self.path, body, self.headers.get("Authorization")))
            if self.path == "/layout":
                reply = {"layout": [{"type": "TEXT", "box": [0, 0, 10, 10]}]}
            elif len(calls) == 1:
                self.send_error(500)
                return
            else:
                tops = [[{"token": "a", "logprob": -0.5}, {"token": "b", "logprob": -1.5}, {"token": "a", "logprob": -0.7}], []]
                reply = {"choices": [{"message": {"content": "yes " + json.loads(body)["messages"][1]["content"]}, "logprobs": {"content": [{"top_logprobs": t} for t in tops]}}], "usage": {"prompt_tokens": 7, "completion_tokens": 2}}
            data = json.dumps(reply).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}", calls
    server.shutdown()


def test_chat_endpoint(spark, endpoint):
    url, calls = endpoint
    chat = providers.ChatEndpoint(f"{url}/chat", "m", token="t", policy=providers.RetryPolicy(base=0.0))
    row = providers.generated(spark.createDataFrame([(1, "p")], "query long, prompt string"), chat).first()
    assert (row.answer, row.prompt_tokens, row.logprobs) == ("yes p", 7, [[-0.7, -1.5]]) and row.generation_error is None
    sent = json.loads(calls[-1][1])
    assert len(calls) == 2 and calls[-1][2] == "Bearer t" and sent["messages"][0]["role"] == "system" and sent["top_logprobs"] == 20 and sent["temperature"] == pytest.approx(0.1)
    assert chat.reachable() and not providers.ChatEndpoint("http://127.0.0.1:9/x", "m", policy=providers.RetryPolicy(1)).reachable()


def test_layout_endpoint(endpoint):
    url, _ = endpoint
    assert json.loads(providers.LayoutEndpoint(f"{url}/layout").load()(b"page")) == [{"type": "TEXT", "box": [0, 0, 10, 10]}]


def test_batches_keep_good_rows_of_a_failing_one(spark):
    class Model:
        batch = 3

        def load_batch(self):
            def call(xs):
                if "bad" in xs:
                    raise ValueError("no")
                return [len(xs)] * len(xs)

            return call

    df = spark.createDataFrame([(x,) for x in ("a", "b", None, "c", "bad", "d", "e")], "c string").coalesce(1)
    got = {r.c: (r.out, r.out_error) for r in providers.mapped(df, Model(), "c", "out", "int").collect()}
    assert got["a"] == (2, None) and got[None] == (None, None) and got["c"] == (1, None) and got["bad"][0] is None and "no" in got["bad"][1] and got["e"] == (1, None)


def test_records_round_trip_and_dates(spark):
    df = spark.sql("select 'd' doc_id, ' SEP ' doc_type, timestamp_ntz'2020-05-03 01:02:03' doc_date, timestamp_ntz'2020-05-03 01:02:03.5' meeting_date, cast(null as timestamp_ntz) download_date, 3 pages, 'x' clash")
    rec = records.to_records(df, records.METADATA)
    assert json.loads(rec.first()[0]) == {"doc_id": "d", "doc_type": " SEP ", "doc_date": "2020-05-03T01:02:03", "meeting_date": "2020-05-03T01:02:03.500000", "pages": 3}
    back = records.from_records(rec, records.METADATA).select(records.from_iso(F.col("doc_date")).alias("a"), records.from_iso(F.col("meeting_date")).alias("b"), records.from_iso(F.lit("x")).alias("c"), records.from_iso(F.lit("2020-05-03")).alias("d"), records.document_type(F.col("doc_type")).alias("t")).first()
    assert str(back.a) == "2020-05-03 01:02:03" and str(back.b) == "2020-05-03 01:02:03.500000" and back.c is None and str(back.d) == "2020-05-03 00:00:00" and back.t == "sep"
    broken = spark.createDataFrame([("{",), (None,)], "record string")
    assert [tuple(set(r)) for r in records.from_records(broken, records.QUESTION).collect()] == [(None,), (None,)]


def test_prompts(spark):
    r = spark.range(1).select(text.abstention_prompt(F.lit("why?"), F.lit(2.5)).alias("a"), text.chat(F.lit("p")).alias("c")).first()
    assert "(entropy 2.50)" in r.a and "why?" in r.a and [m.role for m in r.c] == ["system", "user"]


def test_log_file_and_no_doubled_handlers(tmp_path):
    at = tmp_path / "x" / "run.log"
    for _ in range(2):
        log = logs.logger("test", str(at))
    log.info("once")
    assert len(log.handlers) == 2 and not log.propagate and at.read_text().count("once") == 1
