"""Markup residue in text: HTML, Markdown, wiki and LaTeX, by deducing the templates of a host's pages.

A lexer cuts every page's markup into tokens: what a mark looks like without its content, its language and its role (the element around a
tag, or whether a mark begins a line). Tokens of a host with the same occurrence vector (so many times on each page) form an
equivalence class. A class is valid if on every page its tokens come in one order, as often as the class occurs; tokens of other classes get a
narrower role, the slot they stand in, and are grouped once more. Valid classes are nested by the places of their occurrences
on the pages and make up the host's template; what stands between template tokens are the slots. A page holds residue of a language if a
template token of it stands there, or if a token is left in a slot: a trace that stands once on one page has no partner with
which to form a class, so the exact check of the slots is what finds it.

A converter turns marked texts into clean text and a list of blocks that keep headings, lists, tables, code and formulas.

Look-alikes that are none: ``[TABLE]`` and ``[FIGURE]``, CSV, JSON, bullets, file paths, money, comparison signs, ``R&D``, snake_case
names, lone stars and rows of stars or dashes.

Cases: null and empty text hold no markup and clean to null and to the empty text. Unclosed and stray marks count. Pages without a
host form a group of their own. Rows that repeat an id count once (``clean`` takes the least text). Extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.functions.text import strip
from ledgerleaf.sources.stages import stage

LANGUAGES = ("html", "markdown", "wiki", "latex")
#: Element names of the HTML standard, current and obsolete (fixed values).
_ELEMENTS = (
    "a abbr address article aside b blockquote body br button caption center cite code col colgroup dd del details dfn div dl dt em embed "
    "fieldset figcaption figure font footer form frame h[1-6] head header hr html i iframe img input ins kbd label legend li link main map mark "
    "meta nav noscript object ol option p param pre q s samp script section select small span strike strong style sub summary sup table tbody "
    "td textarea tfoot th thead title tr tt u ul var video"
).replace(" ", "|")
TAG = rf"</?(?:{_ELEMENTS})(?:\s[^<>]*|/)?>"
REFERENCE = r"&(?:[A-Za-z][A-Za-z0-9]{1,31}|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});"
PATTERNS = {
    "html": re.compile(rf"<!--|-->|<!DOCTYPE\b|{TAG}|{REFERENCE}", re.I),
    "markdown": re.compile(
        r"""^[ ]{0,3}\#{1,6}[ ]+\S                                  # heading
        | ``` | ^~~~                                                # fence
        | (?<!`)`[^`\n]+`(?!`)                                      # code
        | \*\*(?=[^\s*])[^*\n]*[^\s*]\*\* | (?<!\w)__(?=[^\s_])[^_\n]*[^\s_]__(?!\w)
        | (?<![\w*\\])\*(?=[^\s*])[^*\n]*[^\s*]\*(?![\w*]) | (?<![\w\\_$^{(])_(?=[^\s_{])[^_\n]*[^\s_]_(?!\w)
        | !?\[[^\[\]\n]*\]\([^()\s]+\)                              # link
        | ^[ ]{0,3}>[ ]+(?=[^\W\d_]|["“'(\[])                       # quotation, not a comparison that wraps
        | ^[ ]*\|?[ ]*:?-{3,}:?[ ]*\|[-|:\ ]*$                      # rule below a table's head
        | ~~[^~\n]+~~ | (?<!\w)\*\*(?=\w) | (?<=\w)\*\*(?!\w)""",
        re.M | re.X,
    ),
    "wiki": re.compile(
        r"""\[\[(?=[^\W\d_]|[:\#])[^\[\]\n]+\]\] | (?<![\\{])\{\{(?=[^\W\d_]|[\#:!])[^{}\n]*\}\}
        | (?<!')'{2,3}(?=[^'\s])[^'\n`]+(?:'[^'\n`]+)*(?<!\s)'{2,3}(?!')
        | ^={2,6}[^=\n]+={2,6}[ ]*$ | ^\{\|(?![^\n]*\|\}) | ^\|\}[ ]*$ | ^\|-+[ ]*$ | ^![ ][^\n]*!!
        | __(?:TOC|NOTOC|FORCETOC|NOEDITSECTION)__""",
        re.M | re.X,
    ),
    "latex": re.compile(
        r"""(?<![A-Za-z0-9_:\\])\\[A-Za-z]+(?![A-Za-z]*\\) | \\(?:begin|end)\{ | (?<![A-Za-z:\\])\\[$%&\#_{}]
        | \$(?![\d\s.,$])[^$\n]*[\\^_=][^$\n]*(?<!\s)\$(?!\d) | (?<!\\)\\[\[\]()]""",
        re.M | re.X,
    ),
}
#: Text without any of these holds no trace; it is told in the JVM and never travels to Python. Every alternative of PATTERNS needs one.
_SIGNS = r"""[<`\\*_#]|&[#A-Za-z]|\[\[|\{\{|''|==|\{\||\|\}|\|-|-{3}:? *\||!!|\]\(|(?m:^ {0,3}> )|~~|-->|\$[^\s\d.,$]"""
_MARK_OF = {"html": ("<", "&", "-->"), "markdown": ("`", "*", "_", "#", "](", "> ", "---", "~~"), "wiki": ("[[", "{{", "''", "==", "{|", "|}", "|-", "!!", "__"), "latex": ("\\", "$")}


def languages(text: str) -> list[str]:
    """The markup languages of which text holds a trace."""
    return [k for k in LANGUAGES if any(s in text for s in _MARK_OF[k]) and PATTERNS[k].search(text)]


def may_hold_markup(text: Column) -> Column:
    """Whether text has a sign that markup can't do without."""
    return text.rlike(_SIGNS)


_VOID = {"br", "hr", "img", "input", "meta", "link", "col"}
#: Elements that end an open one of their own kind.
_CLOSING = {"p", "li", "tr", "td", "th", "dd", "dt", "option"}
_EDGES = re.compile(r"^([^\w\s]*)(?:.*?)([^\w\s]*)$", re.S)


def _form(language: str, mark: str) -> str:
    """What a mark looks like without its content."""
    if language == "latex" and mark[0] == "\\":
        return mark
    if re.fullmatch(r"[-|: ]+", mark):
        return "|---"
    lead, trail = _EDGES.match(mark.strip()).groups()
    return f"{lead}…{trail}"


def lex(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, language, token) of every mark, in order; a token is the mark's form and its role."""
    found = sorted((m.start(), m.end(), k, m[0]) for k in LANGUAGES if any(s in text for s in _MARK_OF[k]) for m in PATTERNS[k].finditer(text))
    out, open_ = [], []
    for start, end, language, mark in found:
        if language != "html":
            role = "line" if not text[:start].rpartition("\n")[2].strip() else "inside"
            out.append((start, end, language, f"{_form(language, mark)} {role}"))
        elif mark[0] == "<" and mark[1] != "!":
            name = re.match(r"</?(\w+)", mark)[1].lower()
            if mark[1] == "/":
                if name in open_:
                    del open_[len(open_) - 1 - open_[::-1].index(name) :]
                out.append((start, end, language, f"</{name}> {open_[-1] if open_ else ''}"))
            else:
                if open_ and open_[-1] == name and name in _CLOSING:
                    open_.pop()
                out.append((start, end, language, f"<{name}> {open_[-1] if open_ else ''}"))
                if name not in _VOID and not mark.endswith("/>"):
                    open_.append(name)
        else:
            out.append((start, end, language, f"{mark.lower() if mark[0] == '<' else mark} {open_[-1] if open_ else ''}"))
    return out


def page_tokens(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """``host, page, at, start, end, language, token`` of all marks. pages: ``page, owner, text``; hosts: ``owner, host``, one row per owner.

    Only tokens travel; pages without markup are told in the JVM. Owners without a host have the host "".
    """
    page, owner = dict(pages.dtypes)["page"], dict(pages.dtypes)["owner"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, o, n, *t) for p, o, text in batch[["page", "owner", "text"]].itertuples(index=False) for n, t in enumerate(lex(text))]
            yield pd.DataFrame(rows, columns=["page", "owner", "at", "start", "end", "language", "token"])

    marked = pages.select("page", "owner", "text").where(may_hold_markup(F.col("text")))
    tokens = marked.mapInPandas(run, f"page {page}, owner {owner}, at int, start int, end int, language string, token string").distinct()
    named = tokens.join(hosts.where(F.col("host").isNotNull()), "owner", "left")
    return named.select(F.coalesce("host", F.lit("")).alias("host"), "page", "at", "start", "end", "language", "token")


def _classes(tokens: DataFrame, min_pages: int, label: str) -> DataFrame:
    """``host, token, class_id, n_pages, n_tokens, no`` of the members of valid classes.

    The occurrence vector of a token is kept as a sum of hashes of (page, count), so that no vector is ever gathered. A class's tokens all
    stand on one page, so they are no more than a page has.
    """
    each = tokens.groupBy("host", "page", "token").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    vectors = each.groupBy("host", "token").agg(F.sum(F.xxhash64("page", "n").cast("decimal(38,0)")).alias("v"), F.count(F.lit(1)).alias("n_pages"), F.sum("first").alias("first"))
    equal = vectors.where(F.col("n_pages") >= min_pages).groupBy("host", "v", "n_pages").agg(F.sort_array(F.collect_list(F.struct("first", "token"))).alias("x")).where(F.size("x") >= 2)
    members = equal.select("host", F.xxhash64("host", "v", "n_pages").alias("class_id"), "n_pages", F.size("x").alias("n_tokens"), F.posexplode("x").alias("no", "t")).select("host", F.col("t.token").alias("token"), "class_id", "n_pages", "n_tokens", "no")
    members = stage(members, label)
    # on every page the tokens must follow one another as the class has them, again and again
    turn = F.row_number().over(Window.partitionBy("host", "page", "class_id").orderBy("at")) - 1
    wrong = tokens.join(members, ["host", "token"]).withColumn("turn", turn).where(F.col("turn") % F.col("n_tokens") != F.col("no")).select("class_id").distinct()
    return members.join(wrong, "class_id", "left_anti")


def templated(tokens: DataFrame, min_pages: int = 3) -> tuple[DataFrame, DataFrame]:
    """(all tokens with ``class_id, no`` of their valid class or null, members of the valid classes)."""
    tokens = stage(tokens, "markup-tokens")
    first = stage(_classes(tokens, min_pages, "markup-classes"), "markup-valid")
    place = first.select("host", "token", "class_id", "no")
    known = tokens.join(place, ["host", "token"], "left")
    # what is in no valid class is told apart by the slot it stands in, then grouped again
    before = Window.partitionBy("host", "page").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    slot = F.last(F.when(F.col("class_id").isNotNull(), F.xxhash64("class_id", "no")), ignorenulls=True).over(before)
    known = stage(known.withColumn("slot", slot), "markup-slots")
    narrow = known.where(F.col("class_id").isNull() & F.col("slot").isNotNull()).withColumn("token", F.concat("token", F.lit(" @"), F.col("slot").cast("string"))).drop("class_id", "no", "slot")
    second = stage(_classes(narrow, min_pages, "markup-classes"), "markup-valid")
    narrow = narrow.join(second.select("host", "token", "class_id", "no"), ["host", "token"], "left")
    rest = known.where(F.col("class_id").isNotNull() | F.col("slot").isNull()).drop("slot")
    return rest.unionByName(narrow), first.unionByName(second)


def find_markup(pages: DataFrame, hosts: DataFrame, min_pages: int = 3) -> DataFrame:
    """``page, markup, n_template, n_slots``: a row for each language on each page, with its tokens in the template and in the slots."""
    tokens, _ = templated(page_tokens(pages, hosts), min_pages)
    inside = F.col("class_id").isNotNull()
    return tokens.groupBy("page", F.col("language").alias("markup")).agg(F.count_if(inside).alias("n_template"), F.count_if(~inside).alias("n_slots"))


def _parents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The innermost occurrence around every occurrence of a class, page by page."""
    for batch in batches:
        out = []
        for spans in batch["spans"]:
            open_: list[tuple[int, int]] = []
            for lo, hi, own in sorted(((s["lo"], s["hi"], s["class_id"]) for s in spans), key=lambda s: (s[0], -s[1])):
                open_ = [o for o in open_ if o[0] > lo]
                around = next((c for h, c in reversed(open_) if h > hi and c != own), None)
                out.append((own, around))
                open_.append((hi, own))
        yield pd.DataFrame({"class_id": pd.array([x for x, _ in out], "Int64"), "parent_id": pd.array([y for _, y in out], "Int64")})


def deduce_templates(pages: DataFrame, hosts: DataFrame, min_pages: int = 3) -> DataFrame:
    """``host, class_id, n_pages, n_tokens, tokens, parent_id`` of all valid classes: each host's template.

    A class is nested in another if on every page each of its occurrences lies within one of that other's, and none nearer.
    """
    tokens, members = templated(page_tokens(pages, hosts), min_pages)
    w = Window.partitionBy("host", "page", "class_id").orderBy("at")
    sizes = members.select("class_id", "n_tokens").distinct()
    turns = tokens.where(F.col("class_id").isNotNull()).join(sizes, "class_id").withColumn("k", F.floor((F.row_number().over(w) - 1) / F.col("n_tokens")))
    spans = turns.groupBy("host", "page", "class_id", "k").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    around = spans.groupBy("host", "page").agg(F.collect_list(F.struct("lo", "hi", "class_id")).alias("spans")).select("spans").mapInPandas(_parents, "class_id long, parent_id long")
    nested = around.groupBy("class_id").agg(F.when((F.min("parent_id") == F.max("parent_id")) & (F.count("parent_id") == F.count(F.lit(1))), F.min("parent_id")).alias("parent_id"))
    classes = members.groupBy("host", "class_id", "n_pages", "n_tokens").agg(F.transform(F.sort_array(F.collect_list(F.struct("no", "token"))), lambda x: x["token"]).alias("tokens"))
    return classes.join(nested, "class_id", "left").select("host", "class_id", "n_pages", "n_tokens", "tokens", "parent_id")


def template_slots(pages: DataFrame, hosts: DataFrame, min_pages: int = 3) -> DataFrame:
    """``page, slot_no, class_id, token_no, text``: what stands on a page behind each template token, up to the next; blank slots are left out."""
    tokens, _ = templated(page_tokens(pages, hosts), min_pages)
    marks = tokens.where(F.col("class_id").isNotNull()).groupBy("page").agg(F.sort_array(F.collect_set(F.struct("start", "end", "class_id", "no"))).alias("marks"))
    once = pages.where(may_hold_markup(F.col("text"))).groupBy("page").agg(F.min("text").alias("text"))
    until = lambda i: F.coalesce(F.try_element_at("marks", i + 2)["start"], F.length("text"))
    slots = F.transform("marks", lambda m, i: F.struct(m["class_id"].alias("class_id"), m["no"].alias("token_no"), F.substring("text", m["end"] + 1, F.greatest(F.lit(0), until(i) - m["end"])).alias("text")))
    each = once.join(marks, "page").select("page", F.posexplode(slots).alias("slot_no", "s"))
    return each.select("page", "slot_no", "s.class_id", "s.token_no", strip(F.col("s.text")).alias("text")).where(F.col("text") != "")


_FENCE = re.compile(r"^[ ]{0,3}```[^\n`]*\n(.*?)(?:^[ ]{0,3}```[ ]*$|\Z)", re.M | re.S)
_PRE = re.compile(r"<pre[^>]*>\s*(?:<code[^>]*>)?(.*?)(?:</code>)?\s*</pre>", re.I | re.S)
_DISPLAY = re.compile(r"\\begin\{(equation\*?|align\*?|displaymath)\}(.*?)\\end\{\1\}|\\\[(.*?)\\\]|\$\$(.+?)\$\$", re.S)
_INLINE = re.compile(r"\\\((.+?)\\\)|\$(?![\d\s.,$])([^$\n]*[\\^_=][^$\n]*)(?<!\s)\$(?!\d)")
_KEEP = re.compile("\ue000(\\d+)\ue001")


def _html(t: str) -> str:
    t = re.sub(r"<!--.*?(?:-->|\Z)", "", t, flags=re.S)
    t = re.sub(r"<(script|style)\b.*?</\1>", "", t, flags=re.S | re.I)
    t = re.sub(r"<h([1-6])[^>]*>(.*?)</h\1>", lambda m: f"\n\ue010{m[1]}\ue011{' '.join(m[2].split())}\n", t, flags=re.S | re.I)
    t = re.sub(r"<tr[^>]*>(.*?)</tr>", lambda m: "\n\ue012" + " | ".join(" ".join(re.sub(TAG, "", c, flags=re.I).split()) for c in re.split(r"</t[dh]>\s*", m[1], flags=re.I)[:-1] or [m[1]]), t, flags=re.S | re.I)
    t = re.sub(r"<li[^>]*>\s*", "\n\ue013", t, flags=re.I)
    t = re.sub(r"<br\s*/?>", "\n", t, flags=re.I)
    t = re.sub(r"</?(?:p|div|ul|ol|table|tr|section|article|blockquote|body|html|li)\b[^<>]*>", "\n", t, flags=re.I)
    t = re.sub(TAG, "", t, flags=re.I)
    return html.unescape(t)


def _wiki(t: str) -> str:
    t = re.sub(r"^(={2,6})\s*([^=\n]+?)\s*\1[ ]*$", lambda m: f"\ue010{len(m[1])}\ue011{m[2]}", t, flags=re.M)
    t = re.sub(r"\[\[(?:Category|File|Image):[^\[\]\n]*\]\][ ]?", "", t, flags=re.I)
    t = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]\n]+)\]\]", r"\1", t)
    t = re.sub(r"(?<![\\{])\{\{val\|([^{}|\n]*)[^{}\n]*\}\}", r"\1", t)
    t = re.sub(r"(?<![\\{])[ ]?\{\{(?=[^\W\d_]|[#:!])[^{}\n]*\}\}", "", t)
    t = re.sub(r"(?<!')'{2,3}(?=[^'\s])([^'\n`]+(?:'[^'\n`]+)*)(?<!\s)'{2,3}(?!')", r"\1", t)
    if re.search(r"^\{\||^\|\}[ ]*$|^\|-+[ ]*$|^![ ][^\n]*!!", t, re.M):
        t = re.sub(r"^(?:\{\|.*|\|\}[ ]*|\|-+[ ]*)$\n?", "", t, flags=re.M)
        t = re.sub(r"^[|!][ ]?(.*)$", lambda m: "\ue012" + " | ".join(c.strip() for c in re.split(r"\|\||!!", m[1])), t, flags=re.M)
    return re.sub(r"^[:;]+[ ]+", "", t, flags=re.M)


def _latex(t: str) -> str:
    t = re.sub(r"\\(section|subsection|subsubsection|chapter)\*?\{([^{}]*)\}", lambda m: f"\n\ue010{1 + len(m[1].split('sub')) - 1}\ue011{m[2]}\n", t)
    t = re.sub(r"^[ ]*\\item[ ]*", "\ue013", t, flags=re.M)
    t = re.sub(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]\n]*\])?", "", t)
    t = re.sub(r"[ ]?\\(?:label|cite[a-z]*|ref|eqref|pageref|index)\{[^{}]*\}", "", t)
    for _ in range(3):
        t = re.sub(r"\\footnote\{([^{}]*)\}", r"(\1)", t)
        t = re.sub(r"(?<![A-Za-z0-9_:\\])\\(?:textbf|textit|emph|texttt|underline|textsc|text|mbox)\{([^{}]*)\}", r"\1", t)
    t = re.sub(r"\\([$%&#_{}])", r"\1", t)
    return t


def _markdown(t: str) -> str:
    t = re.sub(r"^[ ]{0,3}(#{1,6})[ ]+(.+?)[ ]*#*$", lambda m: f"\ue010{len(m[1])}\ue011{m[2]}", t, flags=re.M)
    t = re.sub(r"^[ ]*\|?[ ]*:?-{3,}:?[ ]*\|[-|: ]*$\n?", "", t, flags=re.M)
    t = re.sub(r"^\|(.*)\|[ ]*$", lambda m: "\ue012" + " | ".join(c.strip() for c in m[1].split("|")), t, flags=re.M)
    t = re.sub(r"!?\[([^\[\]\n]*)\]\([^()\s]+\)", r"\1", t)
    t = re.sub(r"(?<!`)`([^`\n]+)`(?!`)", r"\1", t)
    t = re.sub(r"^([ ]*)[-*+][ ]+", "\ue013", t, flags=re.M) if re.search(r"\*\*|__|^[ ]*-[ ]", t, re.M) else t
    t = re.sub(r"\*\*(?=[^\s*])([^*\n]*[^\s*])\*\*", r"\1", t)
    t = re.sub(r"(?<!\w)__(?=[^\s_])([^_\n]*[^\s_])__(?!\w)", r"\1", t)
    t = re.sub(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]*[^\s*])\*(?![\w*])", r"\1", t)
    t = re.sub(r"(?<![\w\\_$^{(])_(?=[^\s_{])([^_\n]*[^\s_])_(?!\w)", r"\1", t)
    t = re.sub(r"^[ ]{0,3}>[ ]+(?=[^\W\d_]|[\"“'(\[])", "", t, flags=re.M)
    return re.sub(r"~~([^~\n]+)~~|(?<!\w)\*\*(?=\w)|(?<=\w)\*\*(?!\w)", r"\1", t)


def convert(text: str) -> tuple[str, list[tuple[str, int, str]]]:
    """(clean text, blocks ``(kind, level, text)``); kinds are heading, list, table, code, formula and text."""
    found = languages(text)
    kept: list[tuple[str, str]] = []

    def keep(kind: str, body: str) -> str:
        kept.append((kind, body))
        return f"\ue000{len(kept) - 1}\ue001"

    t = text
    if "markdown" in found:
        t = _FENCE.sub(lambda m: "\n" + keep("code", m[1].rstrip("\n")) + "\n", t).replace("```", "")
    if "html" in found:
        t = _PRE.sub(lambda m: "\n" + keep("code", html.unescape(m[1])) + "\n", t)
    if "latex" in found:
        t = _DISPLAY.sub(lambda m: "\n" + keep("formula", (m[2] or m[3] or m[4] or "").strip()) + "\n", t)
        t = _INLINE.sub(lambda m: keep("inline", (m[1] or m[2]).strip()), t)
        t = re.sub(r"^[^\n]*\\(?:frac|rho|pi|phi|sum|alpha|beta)\b[^\n]*$", lambda m: keep("formula", m[0].strip()), t, flags=re.M)
        t = _latex(re.sub(r"(?<=\})~|~(?=\\)", " ", t))
    if "html" in found:
        t = _html(t)
    if "wiki" in found:
        t = _wiki(t)
    if "markdown" in found:
        t = _markdown(t)
    blocks: list[tuple[str, int, str]] = []
    lines: list[str] = []
    for line in (re.sub(r"\n{3,}", "\n\n", t).split("\n") if found else t.split("\n")):
        kind, level, body = "text", 0, line
        if line.startswith("\ue010") and "\ue011" in line:
            head, body = line[1:].split("\ue011", 1)
            kind, level = "heading", int(head)
        elif line.startswith(("\ue012", "\ue013")):
            kind, body = ("table" if line[0] == "\ue012" else "list"), line[1:]
        elif whole := re.fullmatch(r"\s*\ue000(\d+)\ue001\s*", line):
            kind = kept[int(whole[1])][0].replace("inline", "formula")
        body = _KEEP.sub(lambda m: kept[int(m[1])][1], body)
        body = re.sub("[\ue010-\ue013]", "", body)
        if found:
            body = body if kind == "code" else body.strip()
        lines.append({"heading": "#" * max(1, level) + " " + body, "list": "- " + body}.get(kind, body))
        if body.strip():
            if blocks and blocks[-1][0] == kind and kind in ("list", "table", "text"):
                blocks[-1] = (kind, 0, blocks[-1][2] + "\n" + body)
            else:
                blocks.append((kind, level, body))
    return ("\n".join(lines).strip() if found else text), blocks


def clean(docs: DataFrame) -> DataFrame:
    """``doc, text, blocks`` of every record: converted where it holds markup, else unchanged with a null list of blocks."""
    kind = dict(docs.dtypes)["doc"]
    schema = f"doc {kind}, text string, blocks array<struct<kind:string,level:int,text:string>>"
    once = docs.groupBy("doc").agg(F.min("text").alias("text"))
    marked = F.coalesce(may_hold_markup(F.col("text")), F.lit(False))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for d, t in zip(batch["doc"], batch["text"]):
                text, blocks = convert(t) if languages(t) else (t, None)
                out.append((d, text, blocks and [{"kind": k, "level": n, "text": s} for k, n, s in blocks]))
            yield pd.DataFrame(out, columns=["doc", "text", "blocks"])

    plain = once.where(~marked).select("doc", "text", F.lit(None).cast("array<struct<kind:string,level:int,text:string>>").alias("blocks"))
    return once.where(marked).mapInPandas(run, schema).unionByName(plain)
