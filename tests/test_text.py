from pyspark.sql import functions as F

from ledgerleaf.functions import text
from ledgerleaf.operators import chunking


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("t"))).collect()]


def test_sentences_cases(spark):
    texts = [None, "", "  \n\n ", "Dr. Smith went. He left.", "ñco. Then more. End", "Head\n\nOne. Two!", "It was U.S. Then J. R. Doe said.\tNext one. \"Quoted\" end.", "etc."]
    got = column(spark, texts, text.sentences)
    assert got[:3] == [None, [], []]
    assert [list(g) for g in got[3:]] == [chunking.split_sentences(t) for t in texts[3:]]


def test_sentences_agree_with_the_plain_restatement(spark):
    import random

    rnd = random.Random(7)
    parts = ["Dr.", "Fed", "rates.", "rose", "No.", "A.", "U.S.", "e.g.", "Up!", "why?", "\"Then", "\n\n", "\n", " ", "\t", "Co.", "x.y.", "'q", "é.", "Fig."]
    texts = ["".join(p + rnd.choice([" ", "  ", "", "\n"]) for p in rnd.choices(parts, k=rnd.randint(1, 25))) for _ in range(400)]
    assert [list(g) for g in column(spark, texts, text.sentences)] == [chunking.split_sentences(t) for t in texts]


def test_long_sentence_stays_whole_and_last_is_repeated(spark):
    long = "Word " * 100 + "end."
    got = column(spark, [f"Short one here. {long} After it comes this."], lambda c: text.pack_sentences(text.sentences(c), 20))[0]
    assert [g.content for g in got] == ["Short one here.", f"Short one here. {long}", f"{long} After it comes this."]
    assert [g.token_count for g in got] == [3, 3 + len(long) // 4, len(long) // 4 + 5]


def test_trailing_text_takes_at_least_one(spark):
    long = "A" + "b" * 400 + "."
    assert column(spark, [f"First. {long}", None, ""], lambda c: text.trailing_text(text.sentences(c), 10)) == [long, None, None]


def test_clean_layout_text(spark):
    assert column(spark, ["The rate moved up-\nward and\nthen down.\nNext Line\n\n\n\nEnd", "", None], text.clean_layout_text) == ["The rate moved upward and then down.\nNext Line\n\nEnd", "", None]


def test_counts(spark):
    assert column(spark, [None, "abc", "abcd"], text.token_count) == [0, 0, 1]
    assert column(spark, ["", "  a  b\n"], text.word_count) == [0, 2]
    assert column(spark, ["x" * 201, "x" * 200], text.preview) == ["x" * 200 + "...", "x" * 200]
    assert column(spark, ["Q", None], lambda c: text.query_prefix(c, "intfloat/e5")) == ["query: Q", None]
    assert column(spark, ["Q"], lambda c: text.query_prefix(c, "instructor")) == ["Q"]


def test_sentences_end_as_the_plain_split_does(spark):
    import random

    from ledgerleaf.operators.chunking import split_sentences

    rnd = random.Random(2)
    bits = ["Rates rose.", "Dr.", "Vore said no.", "U.S.", "It fell!", "etc.", "Why?", "The end", "\n\n", "No. 7 is it."]
    texts = [" ".join(rnd.choice(bits) for _ in range(rnd.randrange(12))) for _ in range(150)] + ["", "etc.", "Dr. Mr. Ms.", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.s for r in df.select("i", text.sentences(F.col("t")).alias("s")).collect()}
    assert all(got[i] == (None if t is None else split_sentences(t)) for i, t in enumerate(texts))
