from ledgerleaf.operators import chunking
from ledgerleaf.operators.chunking import ChunkPolicy

SCHEMA = "doc_id string, seq int, element_id string, kind string, content string, section_anchor string, page int, keywords array<string>"


def frame(spark, rows):
    return spark.createDataFrame([("d", i, f"e{i}", k, c, a, p, None) for i, (k, c, a, p) in enumerate(rows)], SCHEMA)


def chunks(spark, rows, **policy):
    return sorted(chunking.chunk_sections(frame(spark, rows), ChunkPolicy(**policy)).collect(), key=lambda r: int(r.chunk_id.rsplit("_", 1)[1]))


def sent(n, word="word"):
    return " ".join([word] * n).capitalize() + "."


def test_header_and_text_are_multimodal(spark):
    got = chunks(spark, [("HEADER", "A long header", "S", 1), ("TEXT", sent(10), "S", 2)])
    assert [(r.chunk_type, r.pages, r.source_count) for r in got] == [("multimodal", [1, 2], 2)]


def test_table_threshold(spark):
    got = chunks(spark, [("TABLE", "x" * 600, "S", 1), ("TABLE", "y" * 604, "S", 1)])
    assert [r.reason for r in got] == ["before_kept", "kept"] and got[0].content.startswith("[TABLE]\n")


def test_same_anchor_in_two_runs_is_two_sections(spark):
    rows = [("TEXT", sent(5), "A", 1), ("TEXT", sent(5), "B", 1), ("TEXT", sent(5), "A", 1)]
    assert [r.section_no for r in chunking.section_runs(frame(spark, rows)).orderBy("seq").collect()] == [0, 1, 2]
    assert [r.section_anchor for r in chunks(spark, rows)] == ["A", "B", "A"]


def test_overlap_flows_into_the_next_section(spark):
    got = chunks(spark, [("TEXT", "First words here. Last sentence of it.", "A", 1), ("TEXT", sent(8), "B", 1)])
    assert got[1].has_overlap and "Last sentence of it." in got[1].content and got[1].source_count == 1


def test_group_of_overlap_only_can_come_out(spark):
    rows = [("TEXT", sent(60), "A", 1), ("TEXT", sent(200), "B", 1)]
    got = chunks(spark, rows, target=200, most=210, overlap=50)
    assert any(r.source_count == 0 and r.chunk_type == "text" for r in got) or len(got) >= 2


def test_oversize_is_split_and_ids_have_gaps(spark):
    got = chunks(spark, [("TEXT", "ab c", "A", 1), ("TABLE", "z" * 700, "A", 1), ("TEXT", " ".join(sent(30) for _ in range(40)), "A", 1)])
    assert got[0].chunk_id == "d_chunk_1" and {r.reason for r in got} == {"kept", "split"}
    assert all(r.token_count <= 512 for r in got if r.reason == "split")


def test_nulls_and_empty(spark):
    got = chunks(spark, [(None, sent(5), None, None), ("TEXT", None, None, 0), ("TEXT", "", None, 1), ("TEXT", "abc", None, 1)])
    assert [(r.section_anchor, r.pages, r.element_types) for r in got] == [("Document Content", [], ["TEXT"])]
    assert chunking.chunk_sections(spark.createDataFrame([], SCHEMA)).count() == 0


def test_every_sentence_of_a_text_appears(spark):
    rows = [("TEXT", " ".join(f"Sentence number {i}-{j} says something about prices." for j in range(20)), "S" + str(i // 3), i) for i in range(12)]
    whole = "\n".join(r.content for r in chunks(spark, rows, target=64, most=400))
    assert all(f"number {i}-{j} " in whole for i in range(12) for j in range(20))


def restated(rows, target, overlap, most, small):
    """The rules of section chunking once more, plainly: a list of (content, kind, tokens, anchor, source count) with numbering."""
    size = lambda t: len(t) // 4
    sents = chunking.split_sentences

    def tail(t):
        out, n = [], 0
        for s in sents(t)[::-1]:
            if out and n + size(s) > overlap:
                break
            out, n = [s, *out], n + size(s)
        return " ".join(out)

    def build(group):
        real = [g for g in group if not g["lap"]]
        kinds = {g["kind"] for g in real}
        text = "\n\n".join(f"[{g['kind']}]\n{g['text']}" if not g["lap"] and g["kind"] in ("TABLE", "FIGURE") else g["text"] for g in group)
        kind = "multimodal" if len(kinds) > 1 else "table" if kinds == {"TABLE"} else "figure" if kinds == {"FIGURE"} else "text"
        return text, kind, size(text), len(real)

    sections = []
    for kind, text, anchor, _ in rows:
        name = "Document Content" if anchor is None else anchor
        if not sections or sections[-1][0] != name:
            sections.append((name, []))
        sections[-1][1].append({"kind": kind or "TEXT", "raw": kind, "text": text or "", "n": size(text or ""), "anchor": anchor, "lap": False})
    out, carry = [], None
    for name, members in sections:
        mine, group, n = [], [], 0
        if carry and size(carry) < 1.5 * overlap:
            group, n = [{"kind": "TEXT", "raw": "TEXT", "text": carry, "n": size(carry), "anchor": None, "lap": True}], size(carry)
        for e in members:
            if not e["n"]:
                continue
            if (e["kind"] == "TABLE" and e["n"] > small) or e["n"] > most:
                if group:
                    mine.append(build(group))
                group, n = [], 0
                if e["kind"] == "TABLE" and e["n"] > small:
                    mine.append(build([e]))
                    continue
                held, t = [], 0
                for s in sents(e["text"]):
                    if held and t + size(s) > target:
                        mine.append((" ".join(held), "text", t, 1))
                        held, t = [held[-1]], size(held[-1])
                    held, t = [*held, s], t + size(s)
                if held:
                    mine.append((" ".join(held), "text", t, 1))
                continue
            both = n + e["n"]
            # similarity never passes 0.7 here, as there are no keywords
            if group and (both > most or both > target):
                mine.append(build(group))
                source = next((g for g in group[::-1] if g["raw"] == "TEXT" and not g["lap"]), None)
                lap = tail(source["text"]) if source else ""
                group, n = ([{"kind": "TEXT", "raw": "TEXT", "text": lap, "n": size(lap), "anchor": None, "lap": True}], size(lap)) if lap else ([], 0)
            group, n = [*group, e], n + e["n"]
        if group:
            mine.append(build(group))
        carry = tail(mine[-1][0]) if mine and mine[-1][1] in ("text", "multimodal") else None
        out += [(*m[:3], name, m[3]) for m in mine]
    return [(f"d_chunk_{i}", *m) for i, m in enumerate(out) if len(m[0].strip()) > 5]


def test_random_documents_equal_the_restatement(spark):
    import random

    lengths = []
    for seed in range(25):
        rnd = random.Random(seed)
        rows = []
        for _ in range(rnd.randrange(1, 40)):
            text = " ".join(" ".join(["Word", *["word"] * rnd.randrange(1, 14)]) + rnd.choice([".", "!", " e.g.", ""]) for _ in range(rnd.choice([0, 1, 2, 5, 30])))
            rows.append((rnd.choice(["TEXT", "TEXT", "HEADER", "TABLE", "FIGURE", None]), rnd.choice([text, text, text, None, "abc"]), rnd.choice(["A", "A", "B", None]), 1))
        got = [(r.chunk_id, r.content, r.chunk_type, r.token_count, r.section_anchor, r.source_count) for r in chunks(spark, rows, target=40, overlap=12, most=90, small_table=20)]
        assert got == restated(rows, 40, 12, 90, 20), seed
        lengths.append(len(got))
    assert sum(lengths) > 200


def test_chunks_created_are_counted(spark, smallest):
    import __spark_entry__

    queries = __spark_entry__.queries()
    got, part = (queries[k](spark, smallest).first().asDict() for k in ("a5_chunks_created", "a5_chunking_stats"))
    chunks = queries["c1_w7_x9_section_chunks"](spark, smallest).collect()
    assert got == part | {"chunks_created": len(chunks), "tokens": sum(c.token_count or 0 for c in chunks)} and chunks
