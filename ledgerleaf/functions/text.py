"""Column functions on text: sentences, sizes, keywords, entities, clean-up and prompts.

All are JVM expressions. ``\\s`` and ``\\w`` follow Unicode through ``(?U)``. Null in, null out, unless stated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns on which results depend.
ABBREVIATIONS = "dr mr mrs ms prof sr jr inc ltd corp co jan feb mar apr may jun jul aug sep oct nov dec u.s u.k e.g i.e etc vs ph.d b.a m.a fig no vol pp ed al".split()
SENTENCE_GAP = r"(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<![A-Z]\.)(?<=\.|\?|!)\s+(?=[A-Z\"'])"
KEYWORDS = {
    "economic": r"\b(gdp|inflation|unemployment|rate|growth|projection|estimate|forecast|basis points?|percent)\b",
    "financial": r"\b(revenue|profit|loss|margin|assets|liabilities|equity|earnings)\b",
    "dates": r"\b(\d{4}|q[1-4]|\d{1,2}/\d{1,2}/\d{2,4})\b",
}
ORGANIZATIONS = [r"\b(Federal Reserve|FOMC|Board of Governors|Federal Reserve Bank)\b", r"\b([A-Z][a-z]+ [A-Z][a-z]+ (?:Committee|Board|Bank|Corporation|Inc\.))\b"]
LONG_DATE = r"\b((?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4})\b"
CAPTION_WORDS = ("figure", "fig", "table", "chart", "exhibit")
SECTION_ENDS = ("end of section", "***", "---")

CHARS_PER_TOKEN = 4
_SPACE = r"(?U)[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, rf"{_SPACE}+\z|\A{_SPACE}+", "")


def token_count(text: Column) -> Column:
    """The fallback token count, characters divided by four, rounded down; 0 for null."""
    return F.coalesce(F.floor(F.length(text) / CHARS_PER_TOKEN), F.lit(0)).cast("int")


def word_count(text: Column) -> Column:
    """Words between white space; 0 for blank."""
    return F.size(F.filter(F.split(text, _SPACE + "+"), lambda w: w != ""))


def has_number(text: Column) -> Column:
    return text.rlike(r"\p{Nd}")


def preview(text: Column, n: int = 200) -> Column:
    """The first n characters, with three dots if there are more."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def _ends_in_abbreviation(text: Column) -> Column:
    words = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    return text.rlike(rf"(?iU)(?<![\w])(?:{words})\.\z")


def _pieces(segment: Column) -> Column:
    return F.filter(F.transform(F.split(segment, "(?U)" + SENTENCE_GAP), strip), lambda p: p != "")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it; within a lambda an expression is worked out at each mention."""
    return F.get(F.transform(F.array(value), use), 0)


def sentences(text: Column) -> Column:
    """Sentences of noisy text: paragraphs at blank lines, cuts behind ``.?!`` before a capital or quote, and pieces that end in an abbreviation merged on.

    Null gives null, blank text an empty array.
    """
    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), lambda p: strip(F.replace(p, F.lit("\n"), F.lit(" ")))), lambda p: p != "")

    def merged(pieces: Column) -> Column:
        """Pieces up to and with one that ends in no abbreviation (or the last) are a sentence; the ends of sentences are found once."""
        n = F.size(pieces)
        ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | ~_ends_in_abbreviation(F.element_at(pieces, i)))

        def cut(ends: Column) -> Column:
            start = lambda k: F.when(k == 0, 1).otherwise(F.get(ends, k - 1) + 1)
            return F.transform(ends, lambda e, k: F.array_join(F.slice(pieces, start(k), e - start(k) + 1), " "))

        return _bound(ends, cut)

    # most paragraphs hold no abbreviation before a gap, and their pieces are their sentences
    split = lambda p: _bound(_pieces(p), lambda x: F.when(F.exists(x, _ends_in_abbreviation), merged(x)).otherwise(x))
    return F.flatten(F.transform(paragraphs, split))


def pack_sentences(sents: Column, budget: int) -> Column:
    """``array<struct<content, token_count>>``: sentences packed up to the budget, the last one repeated at the head of the next piece.

    A sentence over the budget stays whole; the count is the sum of the sentences' counts.
    """
    start = F.struct(
        F.array().cast("array<struct<content:string,token_count:int>>").alias("done"),
        F.lit(None).cast("string").alias("content"),
        F.lit(None).cast("string").alias("last"),
        F.lit(0).alias("tokens"),
    )

    def step(acc: Column, s: Column) -> Column:
        n = token_count(s)
        full = acc["content"].isNotNull() & (acc["tokens"] + n > budget)
        done = F.concat(acc["done"], F.array(F.struct(acc["content"].alias("content"), acc["tokens"].alias("token_count"))))
        head, before = F.when(full, acc["last"]).otherwise(acc["content"]), F.when(full, token_count(acc["last"])).otherwise(acc["tokens"])
        return F.struct(
            F.when(full, done).otherwise(acc["done"]).alias("done"), F.when(head.isNull(), s).otherwise(F.concat(head, F.lit(" "), s)).alias("content"), s.alias("last"), (before + n).alias("tokens")
        )

    return F.aggregate(sents, start, step, lambda acc: F.when(acc["content"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(F.struct(acc["content"].alias("content"), acc["tokens"].alias("token_count"))))))


def trailing_text(sents: Column, target: int) -> Column:
    """Sentences from the end while they stay within the target, at least one; null if there are none."""
    start = F.struct(F.lit(None).cast("string").alias("text"), F.lit(0).alias("tokens"), F.lit(False).alias("full"))

    def step(acc: Column, s: Column) -> Column:
        n = token_count(s)
        stop = acc["full"] | (acc["text"].isNotNull() & (acc["tokens"] + n > target))
        return F.struct(
            F.when(stop, acc["text"]).when(acc["text"].isNull(), s).otherwise(F.concat(s, F.lit(" "), acc["text"])).alias("text"), F.when(stop, acc["tokens"]).otherwise(acc["tokens"] + n).alias("tokens"), stop.alias("full")
        )

    return F.aggregate(F.reverse(sents), start, step, lambda acc: acc["text"])


def keywords(text: Column, most: int = 10) -> Column:
    """Distinct keywords of three families in order, the first ten."""
    low = F.lower(text)
    found = [F.regexp_extract_all(low, F.lit("(?U)" + p), F.lit(1)) for p in KEYWORDS.values()]
    return F.slice(F.array_sort(F.array_distinct(F.concat(*found))), 1, most)


def entities(text: Column) -> Column:
    """``struct<organizations, locations, dates>``; repeats stay, locations are never found."""
    orgs = F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in ORGANIZATIONS))
    return F.struct(orgs.alias("organizations"), F.array().cast("array<string>").alias("locations"), F.regexp_extract_all(text, F.lit(LONG_DATE), F.lit(1)).alias("dates"))


def clean_layout_text(text: Column) -> Column:
    """Extracted text with hyphens at line ends closed and lines that go on joined; blank lines stay as paragraph breaks."""
    base = F.regexp_replace(F.regexp_replace(text, "\n{3,}", "\n\n"), "-\n", "")
    lines = F.transform(F.split(base, "\n"), strip)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("last"))

    def step(acc: Column, line: Column) -> Column:
        starts_new = line.rlike(r"^\p{Lu}")
        goes_on = acc["last"].isNotNull() & (acc["last"] != "") & ~starts_new & ~acc["last"].rlike(r"[.:!?]\z")
        flushed = F.when(acc["last"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["last"])))
        blank = line == ""
        keep = blank & (acc["last"].isNull() | (acc["last"] == ""))
        return F.when(keep, acc).when(~blank & goes_on, F.struct(acc["done"].alias("done"), F.concat(acc["last"], F.lit(" "), line).alias("last"))).otherwise(F.struct(flushed.alias("done"), line.alias("last")))

    joined = F.aggregate(lines, start, step, lambda acc: F.array_join(F.when(acc["last"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["last"]))), "\n"))
    return strip(F.regexp_replace(joined, " +", " "))


def is_caption(text: Column) -> Column:
    return F.lower(strip(text)).rlike("^(?:" + "|".join(CAPTION_WORDS) + ")")


def ends_section(text: Column) -> Column:
    low = F.lower(text)
    return low.contains(SECTION_ENDS[0]) | low.contains(SECTION_ENDS[1]) | low.contains(SECTION_ENDS[2])


def query_prefix(text: Column, model: str) -> Column:
    """Queries of the e5 and bge model families carry a prefix, documents never do."""
    return F.concat(F.lit("query: "), text) if any(k in model.lower() for k in ("e5", "bge")) else text


def element_id(stem: Column, page: Column, idx: Column) -> Column:
    return F.format_string("%s_p%d_%d", stem, page, idx)


def vision_context(section: Column, caption: Column) -> Column:
    """The sentences put before a vision prompt."""
    return F.concat_ws(" ", F.concat(F.lit("Section: "), section, F.lit(".")), F.concat(F.lit("Caption: "), caption, F.lit(".")))


SYSTEM_PROMPT = (
    "You answer questions about monetary-policy documents. Use the numbered context passages only, name those you rely on as [Document n], "
    "give figures as they are written, and say so where the passages do not hold the answer."
)


def abstention_prompt(question: Column, entropy: Column) -> Column:
    """The prompt that asks for a short refusal instead of an answer, with the reason."""
    return F.concat(
        F.lit("The documents at hand leave the answer to this question too uncertain (entropy "), F.format_number(entropy, 2), F.lit(").\n\nQuestion: "), question,
        F.lit("\n\nSay in one or two sentences that no reliable answer can be given, and what kind of document would be needed."),
    )


def chat(prompt: Column, system: str = SYSTEM_PROMPT) -> Column:
    """``array<struct<role, content>>``: the system message and the user's prompt."""
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), prompt.alias("content")))


def rag_prompt(question: Column, contents: Column) -> Column:
    """Numbered context passages followed by the question."""
    blocks = F.transform(contents, lambda c, i: F.concat(F.lit("[Document "), (i + 1).cast("string"), F.lit("]\n"), c))
    return F.concat(F.lit("Context:\n"), F.array_join(blocks, "\n\n"), F.lit("\n\nQuestion: "), question, F.lit("\n\nAnswer only from the context and cite passages as [Document n]."))
