"""Operators against brute force, exact round trips and hand-made cases."""

import itertools
import random
import re
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ledgerleaf.llm import blocks, leakage, markup, neardup, packing, repeated_lines, scan_noise, sentences, shared_spans, splitting
from ledgerleaf.sources import stages

DOCS = "doc string, text string"


def docs(spark, texts, extra=True):
    """Texts under ids a0, a1, ...; with columns of clashing names."""
    df = spark.createDataFrame([(f"a{i}", t) for i, t in enumerate(texts)], DOCS)
    return df.withColumns({c: F.lit("clash") for c in ("n", "h", "key", "line", "source_", "rid")}) if extra else df


# ---- p1


def noise(spark, texts, titles=None):
    df = spark.createDataFrame([(f"a{i}", f"o{i}", t) for i, t in enumerate(texts)], "doc string, owner string, text string")
    t = spark.createDataFrame([(f"o{i}", x) for i, x in enumerate(titles or [None] * len(texts))], "owner string, title string")
    return df, t


def found(spark, texts, titles=None):
    out = {}
    for r in scan_noise.find_noise(*noise(spark, texts, titles)).collect():
        out.setdefault(r.doc, set()).add(r.noise)
    return out


PLAIN = "The inflation outlook and longer-run housing surveys moved. " * 40


def test_noise_kinds(spark):
    assert found(spark, [PLAIN, "The inﬂation moved"]) == {"a1": {"char_error"}}
    texts = [PLAIN, "The infla-\ntion moved", "The longer-\nrun moved", "The inflatiori moved", "Growth was\n- 12 -\nslow", "Votes for it:\n11\nVotes against:\n5", "slow\n14    Norford Note, Vore Session, May 3, 2020\ngrowth", None, "", "   ", "Plain Heading for Norford, Second Quarter 2020\n\nText"]
    got = found(spark, texts, [None] * 6 + ["Norford Note, Vore Session"] + [None] * 3 + ["Another Title, Said Here"])
    assert got == {"a1": {"hyphen_break"}, "a3": {"char_error"}, "a4": {"page_number"}, "a6": {"page_number", "running_header"}}


def test_noise_of_empty_table_and_repeated_rows(spark):
    df, t = noise(spark, [PLAIN + "The inflatiori moved"])
    assert scan_noise.find_noise(df.limit(0), t.limit(0)).count() == 0
    assert scan_noise.find_noise(df.unionByName(df), t).count() == 1


def test_repair_round_trip(spark):
    df, t = noise(spark, [PLAIN, "The infla-\n\n- 7 -\n\ntion outlook\nand hou5ing moved."])
    got = {r.doc: r.text for r in scan_noise.repair(df, t).collect()}
    assert got["a0"] == PLAIN and got["a1"] == "The inflation outlook and housing moved."


def test_exclamation_mark_within_a_word(spark):
    title = "Norford Committee Note, Vore Session"
    texts = [PLAIN, "The !nflation moved", "The infla-\nt!on moved", "It moved! The outlook!!Housing moved!", f"slow\n14    {title.replace('mitt', 'm!tt')}, Apr!l 3, 2020\ngrowth", "Well! The outlook moved"]
    assert found(spark, texts, [None] * 4 + [title, "Well The outlook moved"]) == {"a1": {"char_error"}, "a2": {"char_error", "hyphen_break"}, "a4": {"page_number", "running_header"}}
    got = {r.doc: r.text for r in scan_noise.repair(*noise(spark, texts, [None] * 4 + [title, None])).collect()}
    assert got["a1"] == "The inflation moved" and got["a2"] == "The inflation moved" and got["a3"] == texts[3] and got["a4"] == "slow growth"


def test_confusion_costs():
    assert scan_noise.confusion_cost("rebounded", "reboundecl") == pytest.approx(0.4)
    assert scan_noise.confusion_cost("turnover", "tumover") == pytest.approx(0.4)
    assert scan_noise.confusion_cost("inflation", "inﬂation") == pytest.approx(0.4)
    assert scan_noise.confusion_cost("rose", "rise") == 1 and scan_noise.confusion_cost("same", "same") == 0


def test_bits_agree_with_spark(spark):
    words = [f"w{i}" for i in range(300)] + ["é", "†icked"]
    bits = scan_noise.bloom(spark.createDataFrame([(w,) for w in words], "word string"), scan_noise.n_bits(len(words)))
    known = scan_noise._Known(bits)
    assert all(known[w] for w in words) and sum(known[f"x{i}"] for i in range(2000)) < 200
    assert scan_noise.n_bits(10**7) >= 16 * 10**7


@pytest.mark.parametrize("most", [1 << 29, 1 << 16])
def test_full_arrays_take_several_passes(spark, monkeypatch, most):
    """With at most 65,536 bits and 60,000 bits a word there is nearly a pass for each suspect."""
    monkeypatch.setattr(scan_noise, "MOST_BITS", most)
    monkeypatch.setattr(scan_noise, "BITS_A_WORD", 16 if most > 1 << 16 else 30_000)
    texts = [PLAIN, "The inflatiori moved", "and hou5ing too", "The surve9s rnoved", "nothing here"]
    assert found(spark, texts) == {"a1": {"char_error"}, "a2": {"char_error"}, "a3": {"char_error"}}
    got = {r.doc: r.text for r in scan_noise.repair(*noise(spark, texts)).collect()}
    assert got["a1"] == "The inflation moved" and got["a4"] == "nothing here"


def test_accents_and_long_words(spark):
    long = "Rinderkennzeichnungsfleischetikettierungsüberwachungsaufgabenübertragungsgesetzentwurf"
    plain = f"Le chômage et la commune évoluent, {long} auch. " * 40
    texts = [plain, "Le chôrnage baisse", "la comrnune évolue", long.replace("fleisch", "f1eisch"), long.replace("kenn", "kerin") + " x", "a" * 100_000, "élevé eleve"]
    assert found(spark, texts) == {"a1": {"char_error"}, "a2": {"char_error"}, "a3": {"char_error"}, "a4": {"char_error"}}
    for n in (63, 64, 65, 66):
        word = ("abcdefghijklmnopqrstuvwxyz" * 3)[:n]
        for k in (0, 20, n // 2, n - 2):
            misread = word[:k] + "rn" + word[k + 1 :]
            right = word[:k] + "m" + word[k + 1 :]
            assert scan_noise.one_confusion_cost(right, misread) == pytest.approx(0.4)


def test_keys_meet_at_every_length(spark):
    rows = []
    for n in (5, 62, 63, 64, 65, 66, 90):
        for k in (0, n // 3, n // 2, n - 1):
            w = "".join(chr(97 + (i * 7) % 20) for i in range(n))
            rows.append((w[:k] + "m" + w[k + 1 :], w[:k] + "rn" + w[k + 1 :]))
    df = spark.createDataFrame(rows, "a string, b string")
    assert df.where(~F.arrays_overlap(scan_noise.keys(F.col("a")), scan_noise.keys(F.col("b")))).count() == 0


# ---- p2


def shingles(text, k):
    w = re.findall(r"[^\W_]+", text.lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= 20 else set()


def edited(rnd, base, n):
    w = base.split()
    for _ in range(n):
        i = rnd.randrange(len(w))
        w[i : i + 1] = rnd.choice([[], [f"new{rnd.randrange(99)}"], [w[i], "more"]])
    return " ".join(w)


def family(rnd, n_bases=12, copies=9):
    out = []
    for _ in range(n_bases):
        base = " ".join(f"w{rnd.randrange(400)}" for _ in range(120))
        out += [base, base] + [edited(rnd, base, rnd.randrange(1, 14)) for _ in range(copies)]
    return out


@pytest.mark.parametrize(("threshold", "k"), [(0.6, 3), (0.8, 5)])
def test_near_pairs_against_brute_force(spark, threshold, k):
    texts = family(random.Random(k)) + [None, "", "too short"]
    sets = {f"a{i}": shingles(t, k) for i, t in enumerate(texts) if t}
    true = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}
    got = {tuple(r) for r in neardup.near_pairs(docs(spark, texts), threshold, k).collect()}
    assert not got - true and len(got) >= 0.97 * len(true)


def test_hot_node_is_dealt_to_blocks(spark, monkeypatch):
    rnd = random.Random(5)
    base = " ".join(f"w{rnd.randrange(400)}" for _ in range(150))
    texts = [edited(rnd, base, 2) for _ in range(60)]
    plain = {tuple(r) for r in neardup.near_pairs(docs(spark, texts), 0.6, 3).collect()}
    rows = neardup.signatures(docs(spark, texts), 3, 20).withColumn("rid", F.monotonically_increasing_id())
    most = neardup.radius(0.6)
    dealt = neardup.hot_pairs(rows.select("rid", F.explode("keys").alias("key"), "f1", "f2"), most, 8)
    assert dealt.groupBy("key", "a", "b").count().where("count > 1").count() == 0
    few = {tuple(r) for r in neardup.candidates(rows, most, hot=8).collect()}
    many = {tuple(r) for r in neardup.candidates(rows, most).collect()}
    assert few == many and len(many) >= len(plain)


def test_copies_of_one_text_are_dealt_to_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 3)
    text = " ".join(f"w{i}" for i in range(40))
    got = [tuple(r) for r in neardup.near_pairs(docs(spark, [text] * 20)).collect()]
    assert len(got) == len(set(got)) == 190


def test_gray_index_equals_all_pairs():
    rng = np.random.default_rng(2)
    for n in (1, 2, 17, 700):
        p = rng.integers(0, 2**64, (n, 2), np.uint64)
        p[n // 2 :] = p[: n - n // 2] ^ (np.uint64(1) << rng.integers(0, 64, (n - n // 2, 2)).astype(np.uint64))
        want = {(i, j) for i in range(n) for j in range(i + 1, n) if int(np.bitwise_count(p[i] ^ p[j]).sum()) <= 20}
        got = {tuple(sorted(x)) for x in neardup.GrayIndex(p).pairs_within(20).tolist()}
        assert got == want


def test_gray_neighbours_differ_in_one_bit():
    order = sorted(range(16), key=lambda v: int(neardup.gray_rank(np.array([[0, v]], np.uint64))[0, 1]))
    assert all(bin(a ^ b).count("1") == 1 for a, b in itertools.pairwise(order))


def test_components_and_groups(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in neardup.components(links).collect()}
    assert {got[i] for i in range(41)} == {0} and got[101] == 100 and 7 in got
    rnd = random.Random(1)
    texts = family(rnd, 3, 3)
    rows = {r.doc: r for r in neardup.near_groups(docs(spark, texts)).collect()}
    assert rows["a0"].group_id == rows["a1"].group_id and rows["a0"].n_copies == 2
    assert neardup.near_groups(docs(spark, texts).limit(0)).count() == 0


def test_groups_of_short_texts(spark):
    texts = ["通胀放缓，增长放缓。", "通胀放缓, 增长放缓", "Rates rose", "rates ROSE!", "Rates fell", "one two three four five six seven", "One two three four five six seven.", "...", "!!", None]
    rows = {r.doc: (r.group_id, r.n_copies) for r in neardup.near_groups(docs(spark, texts), min_words=1).collect()}
    assert rows == {"a0": ("a0", 2), "a1": ("a0", 2), "a2": ("a2", 2), "a3": ("a2", 2), "a5": ("a5", 2), "a6": ("a5", 2)}


# ---- p3


def units(spark, text):
    return [text[r.start_pos - 1 : r.start_pos - 1 + r.n_chars] for r in sentences.sentence_units(docs(spark, [text])).orderBy("start_pos").collect()]


@pytest.mark.parametrize(
    "parts",
    [
        ["Dr. Vore and Mr. Ost of Trust Co. asked about 3.5 percent.", "See fig. 7 and Sec. 7.2 in vol. IV, pp. 30-77, for it.", "e-payments rose."],
        ['Governor Vore remarked: "It firmed. The outlook is unclear."', '"Will it?" asked Prof. Ost of St. Hes.', "“It takes time,” said she, “and we wait.”"],
        ["It closed at 3 p.m.", "The U.S. sector rose, i.e. as said.", "It fell across the U.S.", "In May it rose... or so it seemed... again."],
        ["Am 12. Mai sagte Dr. Vore, es sei z. B. um 2,5 Prozent gestiegen.", "„Hat es wirklich zugenommen?“, fragte Präsident Ost.", "Frau Ost erklärte: „Es stieg. Wir warten.“", "Gut."],
        ["¿Por qué subió en EE. UU. la deuda?", "La Dra. Vore declaró: «Bajó. Esperaremos».", "Fue a las 2.48 p. m.", "El Sr. Ost vino."],
        ["Ο κ. Vore είπε: «Ανέκαμψε. Θα δούμε».", "Γιατί μειώθηκε το 2001;", "Βλ. σελ. 7, π.χ. εδώ."],
        ["क्या ऋण 9.5 पर टिकेगी?", "डॉ. ए. के. वर्णिल ने कहा, “घटी। रुकेंगे।”", "समिति ने रु. 5 दिए।"],
        ["هل ارتفع؟", "قال د. فرناب: «تعافى. سننتظر».", "بلغ 2.5 نقطة!"],
    ],
)
def test_sentence_units(spark, parts):
    for gap in (" ", "\n", "\n\n", "  "):
        assert units(spark, gap.join(parts)) == parts


def test_scripts_without_spaces(spark):
    parts = ["委員会は4.2%に上昇したと報告した。", "総裁は「低下した。あと待つ。」と述べた。", "なぜか？", "修正された……ただし支持した！"]
    assert units(spark, "".join(parts)) == parts
    parts = ["行长说：“上升到6.9%。还要等。”", "工作人员认为如此。"]
    assert units(spark, "".join(parts)) == parts
    parts = ["คณะกรรมการรายงานว่าลดลงร้อยละ 2.5 ในปี 2009 ตามที่คาดไว้", "การบริโภคทรงตัวประมาณ 9 จุด คณะกรรมการจึงยังไม่เปลี่ยนนโยบาย"]
    assert units(spark, " ".join(parts)) == parts


def test_units_cover_all_text(spark):
    rnd = random.Random(9)
    texts = ["".join(rnd.choice(["A", "b", ".", "?", " ", "\n", "\n\n", "“", "”", '"', "«", "»", "…", "。", "3", "ก", "�", "", "🙂"]) for _ in range(rnd.randrange(60))) for _ in range(150)]
    got = {}
    for r in sentences.sentence_units(docs(spark, texts)).collect():
        got.setdefault(r.doc, []).append((r.start_pos, r.n_chars))
    for i, t in enumerate(texts):
        rest = list(t)
        for at, n in got.get(f"a{i}", []):
            rest[at - 1 : at - 1 + n] = " " * n
        assert not "".join(rest).strip()


def test_units_of_null_blank_and_headings(spark):
    assert sentences.sentence_units(docs(spark, [None, "", " \n "])).count() == 0
    assert units(spark, "A Heading\n\nText without mark") == ["A Heading", "Text without mark"]


# ---- p4


def test_bitmaps_round_trip():
    rng = np.random.default_rng(1)
    for v in ([], [0], [65535], range(5000), sorted(rng.choice(65536, 300, False)), sorted(rng.choice(65536, 30000, False)), range(0, 65536, 2)):
        v = np.array(list(v), np.int64)
        assert repeated_lines.decode_container(repeated_lines.encode_container(v)).tolist() == v.tolist()
    a, b = np.array([1, 5, 9]), np.array([5, 7])
    assert repeated_lines.decode_container(repeated_lines.unite([repeated_lines.encode_container(a), repeated_lines.encode_container(b)])).tolist() == [1, 5, 7, 9]


def test_repeated_lines_cases(spark):
    line = "This notice is repeated in every document"
    texts = [f"Own text {i}\n  {line.upper() if i % 2 else line}  \nthis one is only  in   a few of them" if i < 3 else f"{line}\n{line}\nown {i}" for i in range(12)] + [None, "", "short"]
    d = docs(spark, texts)
    kinds = spark.createDataFrame([(f"a{i}", "s" if i != 11 else None) for i in range(15)], "doc string, source string")
    got = sorted((r.doc, r.line_no) for r in repeated_lines.repeated_lines(d, kinds).collect())
    assert got == sorted([(f"a{i}", 2) for i in range(3)] + [(f"a{i}", n) for i in range(3, 11) for n in (1, 2)])
    clean = {r.doc: r.text for r in repeated_lines.remove_lines(d.select("doc", "text"), repeated_lines.repeated_lines(d, kinds)).collect()}
    assert clean["a5"] == "own 5" and clean["a11"] == texts[11] and clean["a12"] is None
    assert repeated_lines.repeated_lines(d.limit(0), kinds.limit(0)).count() == 0


@pytest.mark.parametrize("most", [1 << 26, 8])
def test_repeated_lines_against_brute_force(spark, monkeypatch, most):
    """With a bound of 8 bits the frequent lines are joined instead of sent as bits; containers of few documents split every line's bitmap."""
    monkeypatch.setattr(repeated_lines, "MOST_BITS", most)
    monkeypatch.setattr(repeated_lines, "CONTAINER_BITS", 16 if most > 8 else 2)
    rnd = random.Random(11)
    shared = [f"this is the shared legal notice number {k}" for k in range(12)]
    texts = ["\n".join(rnd.choice([rnd.choice(shared), rnd.choice(shared).upper() + "  ", f"own line of text with number {rnd.randrange(9999)}", "short"]) for _ in range(rnd.randrange(9))) for _ in range(90)]
    source = [rnd.choice(["s", "s", "t", None]) for _ in texts]
    kinds = spark.createDataFrame([(f"a{i}", x) for i, x in enumerate(source)], "doc string, source string")
    plain = lambda s: " ".join(s.lower().split())
    holders = {}
    for i, t in enumerate(texts):
        for line in t.split("\n"):
            if len(plain(line)) >= 25 and source[i]:
                holders.setdefault((source[i], plain(line)), set()).add(i)
    want = {(f"a{i}", n) for i, t in enumerate(texts) for n, line in enumerate(t.split("\n"), 1) if len(holders.get((source[i], plain(line)), ())) >= 10}
    got = [(r.doc, r.line_no) for r in repeated_lines.repeated_lines(docs(spark, texts).union(docs(spark, texts[:9])), kinds).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


# ---- p5


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("x <b>y", ["html"]), ("a&nbsp;b", ["html"]), ("<!-- c", ["html"]), ("R&D and 3 < 5 > 2", []), ("# Head", ["markdown"]), ("item #9", []), ("**bold** text", ["markdown"]), ("2 * 3 * 4", []), ("***\n---", []),
        ('```json\n{"a": 1}\n```', ["markdown"]), ('{"a_b": [[1, 2]]}', []), ("use `x_1` now", ["markdown"]), ("series a_b_c", []), ("see [a](https://b.example)", ["markdown"]), ("\n> Quote", ["markdown"]), ("2\n> 3", []),
        ("== Head ==", ["wiki"]), ("[[a|b]]", ["wiki"]), ("x {{cn|May}}", ["wiki"]), ("''it'' is", ["wiki"]), ("\\section{A}", ["latex"]), ("C:\\archive\\rents_1", []), ("10\\% of", ["latex"]), ("$5 billion to $7 million", []),
        ("$r_t = 3$ holds", ["latex"]), ("[TABLE]\na,b", []), ("[FIGURE]", []), ("• item\n- item", []), ("", []),
    ],
)
def test_markup_languages(text, want):
    assert markup.languages(text) == want


def test_markup_prefilter_lets_all_traces_through(spark):
    texts = ["x <b>y", "a&nbsp;b", "# H", "**b** t", "`x`", "[a](b)", "> Q", "a|b\n-|-", "~~x~~", "== H ==", "[[a]]", "{{a}}", "''i'' x", "\\emph{x}", "$r_t = 3$", "10\\%", "c -->", "| a |\n|---|"]
    texts = [t for t in texts if markup.languages(t)]
    assert docs(spark, texts).where(markup.may_hold_markup(F.col("text"))).count() == len(texts)


def test_markup_prefilter_holds_every_alternative(spark):
    """Each alternative of the patterns alone, in its widest forms."""
    texts = ["| --- | --- |", "--- | ---", "| :--- | ---: |", "---: | ---:", "---:|", "! Year !! Rate", "$π = 3.14$", "$|x| = 3$", "$-x_1$", "~~~\nx", "```", "**x", "x**", "_x_", "*x*", "__x__", "<!-- x", "<!DOCTYPE x", "</p>", "&#65;", "&#x41;", "|}", "|-", "{| x", "''x'' y", "__TOC__", "\\begin{x", "\\(", "\\]", "\\&"]
    assert [t for t in texts if not markup.languages(t)] == []
    assert {r.text for r in docs(spark, texts).where(~markup.may_hold_markup(F.col("text"))).collect()} == set()
    got = [markup.convert(t)[0] for t in ("Year | Rate\n--- | ---\n2020 | 1", "! Year !! Rate", "$π = 3.14$")]
    assert got == ["Year | Rate\n2020 | 1", "Year | Rate", "π = 3.14"]


def test_conversion_keeps_structure():
    text, blocks = markup.convert("<h2>Head</h2>\n<p>One &amp; two.<br/>Three</p>\n<ul>\n<li>a</li>\n<li>b</li>\n</ul>\n<TABLE>\n<tr><td>x</td><td align=right>1</td></tr>\n</TABLE>\n<pre><code>y = 2 * z</code></pre>")
    assert [b[0] for b in blocks] == ["heading", "text", "list", "table", "code"] and blocks[1][2] == "One & two.\nThree" and blocks[3][2] == "x | 1" and blocks[4][2] == "y = 2 * z"
    text, blocks = markup.convert("\\section{A}\nWe see \\textbf{b}~to \\$5.\n\\begin{equation}\ni_t = \\frac{1}{2}\n\\end{equation}\n\\begin{itemize}\n\\item c\n\\end{itemize}")
    assert ("formula", 0, "i_t = \\frac{1}{2}") in blocks and blocks[0][:1] == ("heading",) and "We see b to $5." in text
    for raw in ("== A ==\n''b'' [[c|d]].{{cn|May}}\n{| class=x\n! e !! f\n|-\n| g || 1\n|}", "# A\n\n- **b**: c\n\n| e | f |\n|---|---:|\n| g | 1 |\n\n> Quoted", "plain text"):
        text, _ = markup.convert(raw)
        assert [k for k in markup.languages(text) if not (k == "markdown" and text.startswith("#"))] == []
    assert markup.convert("plain text") == ("plain text", [("text", 0, "plain text")])


def site(spark, rows):
    """Pages and hosts of (host, page, text)."""
    pages = spark.createDataFrame([(p, f"o{h}", t) for h, p, t in rows], "page string, owner string, text string").withColumn("host", F.lit("clash")).withColumn("token", F.lit("clash"))
    return pages, spark.createDataFrame(sorted({(f"o{h}", h) for h, _, _ in rows}, key=str), "owner string, host string")


def test_templates_classes_and_nesting(spark):
    rows = [("h", f"p{i}", f"<div><h2>T{i}</h2><ul>" + "".join(f"<li>x{k}</li>" for k in range(i + 1)) + "</ul></div>") for i in range(4)] + [("h", "q", None), (None, "r", "<b>x</b>"), ("k", "s", "<p>lone")]
    got = {tuple(t.split()[0] for t in r.tokens): r for r in markup.deduce_templates(*site(spark, rows)).collect()}
    outer, item = got[("<div>", "<h2>", "</h2>", "<ul>", "</ul>", "</div>")], got[("<li>", "</li>")]
    assert set(got) == {("<div>", "<h2>", "</h2>", "<ul>", "</ul>", "</div>"), ("<li>", "</li>")}
    assert outer.parent_id is None and item.parent_id == outer.class_id and (item.host, item.n_pages) == ("h", 4)


def test_class_out_of_order_is_not_valid(spark):
    rows = [("h", f"p{i}", "<b>x</b> <i>y</i>" if i else "<i>y</i> <b>x</b>") for i in range(5)]
    assert markup.deduce_templates(*site(spark, rows)).count() == 0
    # equal vectors, but in the slots of another class they can be told apart
    rows = [("h", f"p{i}", f"<p>{i} <b>x</b></p>" + ("<p> <i>y</i></p>" if i % 2 else "<p> <i>z</i></p>")) for i in range(6)]
    assert markup.deduce_templates(*site(spark, rows)).count() >= 1


def test_slots_are_what_the_template_leaves(spark):
    rows = [("h", f"p{i}", f"== H{i} ==\n<div>one {i}</div>\n''two {i}'' &amp;" + (" **lone**" if i == 2 else "")) for i in range(4)]
    got = {}
    for r in markup.template_slots(*site(spark, rows + rows[:2])).orderBy("page", "slot_no").collect():
        got.setdefault(r.page, []).append(r.text)
    assert got["p1"] == ["one 1"] and got["p2"] == ["one 2", "**lone**"]
    found = {(r.page, r.markup): (r.n_template, r.n_slots) for r in markup.find_markup(*site(spark, rows + rows[:2])).collect()}
    assert found["p2", "markdown"] == (0, 1) and found["p0", "html"] == (3, 0) and found["p0", "wiki"] == (2, 0)


def test_found_languages_are_those_of_the_lexer(spark):
    rnd = random.Random(3)
    bits = ["<b>x</b>", "&nbsp;", "# H\n", "**a**", "== W ==\n", "[[l]]", "\\emph{x}", "$r_t = 3$", "plain", "5 < 6", "<p>", "\n"]
    rows = [(rnd.choice(["h", "k", None]), f"p{i}", " ".join(rnd.choice(bits) for _ in range(rnd.randrange(6)))) for i in range(200)]
    got = {(r.page, r.markup) for r in markup.find_markup(*site(spark, rows)).collect()}
    assert got == {(p, k) for _, p, t in rows for k in markup.languages(t)}
    empty = site(spark, rows)[0].limit(0), site(spark, rows)[1].limit(0)
    assert markup.find_markup(*empty).count() == markup.deduce_templates(*empty).count() == markup.template_slots(*empty).count() == 0


def test_clean_of_null_and_empty(spark):
    assert markup.clean(docs(spark, ["<b>x</b>"]).union(docs(spark, ["<b>x</b>"]))).count() == 1
    got = {r.doc: (r.text, r.blocks) for r in markup.clean(docs(spark, [None, "", "x"])).collect()}
    assert got == {"a0": (None, None), "a1": ("", None), "a2": ("x", None)}


# ---- p6


def test_pieces_tile_the_text_and_stay_under_the_limit():
    rnd = random.Random(4)
    for text in ["word. " * 3000, "x" * 9999, "\n\n".join("s " * rnd.randrange(400) for _ in range(30)), "é́" * 4000, "。".join(["漢" * 30] * 200)]:
        for most, lap in ((1024, 50), (64, 0), (16, 15)):
            pieces = splitting.bisect_text(text, most, lap)
            assert "".join(text[a:b] for a, b, _ in pieces) == text
            for k, (a, b, before) in enumerate(pieces):
                assert (b - a + before) // 4 <= most and before == (min(4 * lap, a) if k else 0)


def test_cut_prefers_the_strongest_boundary():
    text = "a " * 300 + "\n\n" + "b. " * 300
    assert text[: splitting.bisect_text(text, 200, 0)[0][1]].endswith("\n\n")
    with pytest.raises(ValueError):
        splitting.bisect_text(text, 10, 10)


def test_split_cases(spark):
    limits = spark.createDataFrame([("s", "split", 64, 4), ("p", "pack", 8, None)], "limit_id string, purpose string, max_tokens int, overlap_tokens int")
    d = spark.createDataFrame([("a", "x " * 300, " A "), ("a", "x " * 300, " A "), ("b", "y" * 259, None), ("c", None, None), (None, "z " * 400, None), ("d", "z " * 400, None)], "chunk_id string, content string, section_anchor string")
    got = splitting.split_oversized(d, limits).collect()
    assert {r.chunk_id for r in got} == {"a", "d"} and {r.section_anchor for r in got} == {"A", None}
    text = dict((r.chunk_id, r.content) for r in d.collect())
    assert all(text[r.chunk_id][r.start_pos - 1 : r.start_pos - 1 + r.n_chars] == r.content for r in got)
    assert splitting.split_oversized(d.limit(0), limits).count() == 0


# ---- p7


def test_packing_never_overfills_and_is_tight():
    rnd = random.Random(8)
    for cap in (10, 100, 512):
        sizes = [rnd.randrange(0, cap + 1) for _ in range(2000)]
        bins = packing.pack_sizes(sizes, cap)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= cap for b in bins)
        assert len(bins) <= len(packing.best_fit(sorted(sizes, reverse=True), cap))
    assert packing.pack_sizes([], 5) == [] and packing.pack_sizes([0, 0], 5) == [[0, 1]]


def test_exchanges_empty_a_bin_that_best_fit_keeps():
    # best fit from a bad start leaves three bins for two bins' worth
    start, sizes = [[0, 1], [2, 3], [4]], [6, 3, 5, 4, 2]
    assert len(packing.improve([list(b) for b in start], sizes, 10)) == 2


def test_exchanges_behind_many_offers_that_do_not_fit():
    """Offers whose own item is too large stand before the one that fits, and the pair that fits is of the smallest items."""
    full = [[k] for k in range(200)]
    sizes = [95] * 200 + [3, 2] + [97]
    assert len(packing.improve([*full, [200, 201], [202]], sizes, 100)) == 201
    many = [40] * 14 + [1, 2]
    bins = packing.improve([[0, 1], [2, 3], [4, 5], [6, 7], [8, 9], [10, 11], [12, 13, 14, 15]], many, 83)
    assert sorted(i for b in bins for i in b) == list(range(16)) and all(sum(many[i] for i in b) <= 83 for b in bins)


def test_offers_find_the_first_key_with_a_small_item():
    rnd = random.Random(3)
    held, offers = [], packing._Offers(64)
    for n in range(400):
        key, y = rnd.randrange(1, 128), rnd.randrange(64)
        held.append((key, y, n))
        offers.add(key, y, n)
        low, below, high = rnd.randrange(128), rnd.randrange(64), rnd.randrange(140)
        want = min(((k, v) for k, v, _ in held if low <= k < high and v < below), default=None)
        got = offers.first(low, high, below, lambda n: True)
        assert (got and got[:2]) == want


def test_pack_cases(spark):
    limits = spark.createDataFrame([("p8", "pack", 8, None), ("s", "split", 5, 1)], "limit_id string, purpose string, max_tokens int, overlap_tokens int")
    d = spark.createDataFrame([(1, "one two three " * 10), (2, "hi"), (2, "hi"), (3, ""), (4, None)], "doc long, text string")
    got = packing.pack(d, limits).collect()
    tokens = {r.doc: r.n_tokens for r in packing.token_sizes(d).collect()}
    for doc in (1, 2, 3):
        mine = sorted((r.token_start, r.n_tokens) for r in got if r.doc == doc)
        assert sum(n for _, n in mine) == tokens[doc] and mine[0][0] == 0
    assert {r.doc for r in got} == {1, 2, 3}
    fill = {}
    for r in got:
        fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
    assert max(fill.values()) <= 8 and packing.pack(d.limit(0), limits).count() == 0


# ---- p8


def leaks(spark, texts, items, n=8):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc long, text string")
    it = spark.createDataFrame([(k, "f", t) for k, t in items], "item string, field string, text string")
    return {(r.doc, r.item): r.n_words for r in leakage.find_leaks(df, it, n).collect()}


def longest(a, b):
    a, b = leakage.words(a), leakage.words(b)
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            best = max(best, k)
    return best


def test_leaks_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(leakage, "SHARD_CHARS", 300)
    rnd = random.Random(6)
    items = [(f"q{i}", " ".join(f"w{rnd.randrange(9)}" for _ in range(rnd.randrange(3, 25)))) for i in range(12)]
    texts = [" ".join(rnd.choice([f"w{rnd.randrange(9)}", rnd.choice(items)[1], "other"]) for _ in range(30)) for _ in range(25)] + ["", None, items[3][1].upper() + "!"]
    want = {(i, k): n for i, t in enumerate(texts) for k, q in items if (n := longest(t, q)) >= 4}
    assert leaks(spark, texts, items, 4) == want


def test_no_items_and_blocks(spark, monkeypatch):
    assert leaks(spark, ["a b c d"], [("q", None), ("r", "")], 2) == {}
    assert leaks(spark, [], [("q", "a b c")], 2) == {} == leaks(spark, [None, ""], [("q", "a b c")], 2)
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 2)
    assert leaks(spark, ["a b c d", "a b c d"], [(f"q{i}", "a b c") for i in range(5)], 3) == {(d, f"q{i}"): 3 for i in range(5) for d in (0, 1)}


def test_suffix_array_is_sorted():
    rnd = random.Random(7)
    for n, k in ((0, 1), (1, 1), (40, 1), (300, 2), (300, 50)):
        seq = np.array([rnd.randrange(k) for _ in range(n)], np.uint64)
        assert leakage.suffix_array(seq).tolist() == sorted(range(n), key=lambda i: seq[i:].tolist())


def test_each_shard_of_an_index_is_a_row_group(spark, monkeypatch):
    monkeypatch.setattr(leakage, "SHARD_CHARS", 10)
    df = spark.createDataFrame([(i, f"one two three w{i}") for i in range(30)], "doc long, text string").coalesce(1)
    items = spark.createDataFrame([("q", "f", "one two three")], "item string, field string, text string")
    assert leakage.find_leaks(df, items, 3).count() == 30
    path = next(p for p in reversed(stages._made) if "/suffix-arrays-" in p)
    (file,) = Path(path).glob("*.parquet")
    meta = pq.ParquetFile(file).metadata
    assert [meta.row_group(k).num_rows for k in range(meta.num_row_groups)] == [1] * 30


def test_places_of_leaks_and_a_second_test_set(spark):
    df = spark.createDataFrame([(1, "x y one two three four z one two three"), (2, "three four five")], "doc long, text string").withColumn("docs", F.lit("clash"))
    index = leakage.stage(leakage.build_index(df), "index")
    it = lambda t: spark.createDataFrame([("q", "f", t)], "item string, field string, text string")
    assert [tuple(r) for r in leakage.search_index(index, it("so ONE, two; three four!"), 3).collect()] == [(1, "q", "f", 4, 2, 1)]
    assert [tuple(r) for r in leakage.search_index(index, it("four five"), 2).collect()] == [(2, "q", "f", 2, 1, 0)]


# ---- p9


def test_stretches():
    rnd = random.Random(2)  # text without a period, else it shares stretches with itself at other places
    a = "x" * 30 + "".join(chr(97 + rnd.randrange(23)) for _ in range(300)) + "tail"
    assert shared_spans.shared_stretches(a, "zz" + a[20:260] + "yy", 200) == [(20, 2, 240)]
    assert shared_spans.shared_stretches(a, a, 200) == [(0, 0, len(a))]
    assert shared_spans.shared_stretches("", "", 200) == [] == shared_spans.shared_stretches(a, "short", 200)
    # a period gives as many stretches as there are shifts, not as there are pairs of windows
    assert len(shared_spans.shared_stretches("a" * 3000, "a" * 2500, 200)) == 2801 + 2301 - 1


def maximal(a, b, n):
    """Brute force over diagonals."""
    out = []
    for d in range(-len(b) + 1, len(a)):
        i, run = max(0, d), 0
        while i <= len(a) and i - d <= len(b):
            if i < len(a) and i - d < len(b) and a[i] == b[i - d]:
                run += 1
            else:
                if run >= n:
                    out.append((i - run, i - run - d, run))
                run = 0
            i += 1
    return sorted(out)


def test_stretches_are_all_maximal_ones():
    rnd = random.Random(5)
    word = lambda n: "".join(chr(97 + rnd.randrange(26)) for _ in range(n))
    for _ in range(12):
        parts = [word(30), word(45), word(60), "ab" * 20]
        a, b = ("".join(rnd.choice([*parts, word(9)]) + word(rnd.randrange(3)) for _ in range(6)) for _ in range(2))
        for s, t in ((a, b), (b, a)):
            assert shared_spans.shared_stretches(s, t, 25) == maximal(s, t, 25)
    p, x, y = word(300), word(50), word(250)
    assert shared_spans.shared_stretches(p + y, p[:210] + x + p + y, 200) == [(0, 0, 210), (0, 260, 550)]
    assert shared_spans.shared_stretches("1" + p + "2", "3" + p + "4" + p + "5" + p, 200) == [(1, 1, 300), (1, 302, 300), (1, 603, 300)]


def planted(seed):
    rnd = random.Random(seed)
    texts = ["".join(rnd.choice("abcdefgh 漢🙂") for _ in range(rnd.randrange(150, 900))) for _ in range(40)]
    for _ in range(25):
        i, j, n = rnd.randrange(40), rnd.randrange(40), rnd.choice([150, 199, 200, 201, 260])
        at = rnd.randrange(max(1, len(texts[i]) - n))
        cut = rnd.randrange(len(texts[j]))
        texts[j] = texts[j][:cut] + texts[i][at : at + n] + texts[j][cut:]
    return texts + [texts[0], None, "short"]


def brute(texts, n):
    seen = {}
    for i, t in enumerate(texts):
        for k in range(len(t or "") - n + 1):
            seen.setdefault(t[k : k + n], set()).add(i)
    return {(a, b) for s in seen.values() for a, b in itertools.combinations(sorted(s), 2)}


@pytest.mark.parametrize("hot", [64, 1])
def test_shared_spans_against_brute_force(spark, monkeypatch, hot):
    """With hot at 1 nearly every shared fingerprint takes the way of the hot ones, and blocks of two rows deal all groups."""
    monkeypatch.setattr(shared_spans, "HOT", hot)
    monkeypatch.setattr(blocks, "BLOCK", 1000 if hot > 1 else 2)
    texts = planted(3) + [planted(3)[0]] * 3
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc long, text string").withColumn("h", F.lit("clash"))
    got = [(r.a, r.b) for r in shared_spans.shared_pairs(df.unionByName(df.limit(5)), 200).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(texts, 200)


def test_spans_and_amounts_against_brute_force(spark):
    texts = planted(4)
    texts += [texts[1] + "|" + texts[1][:230], texts[1] * 2]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc long, text string")
    reps = {i: t for i, t in enumerate(texts) if t and texts.index(t) == i}
    want = {(i, j, p + 1, q + 1, n) for (i, s), (j, t) in itertools.combinations(reps.items(), 2) for p, q, n in shared_spans.shared_stretches(s, t, 200)}
    copies = {(texts.index(t), i, 1, 1, len(t)) for i, t in enumerate(texts) if t and texts.index(t) != i and len(t) >= 200}
    assert {(r.a, r.b, r.start_a, r.start_b, r.n_chars) for r in shared_spans.shared_spans(df).collect()} == want | copies
    places = {}
    for i, t in reps.items():
        for k in range(len(t) - 199):
            places.setdefault(t[k : k + 200], set()).add(i)
    covered = {i: {c for k in range(len(t) - 199) if len(places[t[k : k + 200]]) > 1 for c in range(k, k + 200)} for i, t in reps.items()}
    amounts = {i: len(t) if texts.count(t) > 1 and len(t) >= 200 else len(covered[texts.index(t)]) for i, t in enumerate(texts) if t}
    got = {r.doc: r for r in shared_spans.shared_amounts(df).collect()}
    assert {i: r.shared_chars for i, r in got.items()} == {i: n for i, n in amounts.items() if n}
    assert got[0].n_copies == texts.count(texts[0]) and got[0].shared_share == 1.0


def test_log_compacts_and_keeps_all_rows(spark):
    log = shared_spans.FingerprintLog(spark, buckets=2, fan_out=2)
    for k in range(5):
        log.add(spark.createDataFrame([(k, k), (9, k)], "h long, doc long"))
        log.compact()
    assert sorted(r.h for n in log.runs for r in spark.table(n).collect()) == [0, 1, 2, 3, 4, 9, 9, 9, 9, 9] and len(log.runs) <= 3
    log.clear()


def test_queries_compact_and_a_kept_log_meets_later_batches(spark):
    texts = planted(6)
    rows = [(i, t) for i, t in enumerate(texts)]
    first, later = (spark.createDataFrame(x, "doc long, text string") for x in (rows[:30], rows[30:40]))
    assert shared_spans.search(first).n_compacted == 1
    at = shared_spans.new_path(spark, "kept-log")
    a = {(r.a, r.b) for r in shared_spans.shared_pairs(first, log=shared_spans.FingerprintLog(spark, at)).collect()}
    # another session has the folder, not the tables
    for name in shared_spans.FingerprintLog(spark, at).runs:
        spark.sql(f"DROP TABLE {name}")
    again = shared_spans.FingerprintLog(spark, at)
    b = {(r.a, r.b) for r in shared_spans.shared_pairs(later, batches=1, log=again, earlier=first).collect()}
    assert a | b == brute(texts[:40], 200) and not a & b
    again.clear()


def test_a_failed_search_leaves_no_runs(spark, monkeypatch):
    logs = []
    made = shared_spans.FingerprintLog.__init__
    monkeypatch.setattr(shared_spans.FingerprintLog, "__init__", lambda self, *a, **k: (made(self, *a, **k), logs.append(self))[0])
    monkeypatch.setattr(shared_spans.FingerprintLog, "probe", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        shared_spans.shared_pairs(spark.createDataFrame([(1, "x" * 300), (2, "y" * 300)], "doc long, text string"))
    assert len(logs) == 1 and logs[0].runs == [] and shared_spans.read_text(spark, f"{logs[0].at}/manifest.json") is None


def test_spans_of_nothing(spark):
    empty = spark.createDataFrame([], "doc long, text string")
    nothing = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (None, "x" * 300)], "doc long, text string")
    for df in (empty, nothing):
        assert shared_spans.shared_pairs(df).count() == 0 and shared_spans.shared_spans(df).count() == 0 and shared_spans.shared_amounts(df).count() == 0
