"""Section-aware and fixed-size chunking.

``chunk_sections`` is an ordered fold: whether an element joins a chunk depends on all before it. It runs over rows sorted by document and
place and keeps only the current group in memory, so a document of any size streams through one task without being gathered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.functions import text
from ledgerleaf.functions.text import ABBREVIATIONS, CHARS_PER_TOKEN, SENTENCE_GAP

DEFAULT_ANCHOR = "Document Content"
CHUNK = "doc_id string, chunk_id string, content string, chunk_type string, token_count int, section_anchor string, pages array<int>, element_ids array<string>, element_types array<string>, keywords array<string>, source_count int, has_overlap boolean, reason string"


@dataclass(frozen=True)
class ChunkPolicy:
    """Sizes in tokens."""

    target: int = 512
    overlap: int = 50
    most: int = 1024
    small_table: int = 150
    similarity: float = 0.7
    keep_large_tables: bool = True
    multimodal: bool = True


def section_runs(elements: DataFrame) -> DataFrame:
    """Elements with ``section_no`` (from 0): consecutive elements of a document with the same anchor; an anchor that returns starts anew."""
    anchor = F.coalesce("section_anchor", F.lit(DEFAULT_ANCHOR))
    w = Window.partitionBy("doc_id").orderBy("seq")
    new = F.when(F.lag(anchor).over(w).isNull() | (F.lag(anchor).over(w) != anchor), 1).otherwise(0)
    return elements.withColumn("_new", new).withColumn("section_no", (F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int")).drop("_new")


_GAP = re.compile(SENTENCE_GAP)
_ABBREVIATION = re.compile(r"\b(?:" + "|".join(map(re.escape, ABBREVIATIONS)) + r")\.$", re.I)


def split_sentences(content: str) -> list[str]:
    """The sentences of a text, as ``functions.text.sentences`` gives them."""
    out: list[str] = []
    for paragraph in (content or "").split("\n\n"):
        held: list[str] = []
        for piece in filter(None, map(str.strip, _GAP.split(paragraph.replace("\n", " ").strip()))):
            held.append(piece)
            if not _ABBREVIATION.search(" ".join(held)):
                out.append(" ".join(held))
                held = []
        if held:
            out.append(" ".join(held))
    return out


def _size(content: str) -> int:
    return len(content) // CHARS_PER_TOKEN


def _tail(content: str, target: int) -> str | None:
    taken: list[str] = []
    total = 0
    for sentence in reversed(split_sentences(content)):
        total += _size(sentence)
        if taken and total > target:
            break
        taken.append(sentence)
    return " ".join(reversed(taken)) if taken else None


@dataclass
class _Element:
    kind: str | None
    content: str
    tokens: int
    id: str | None = None
    page: int | None = None
    anchor: str | None = None
    keywords: frozenset = frozenset()
    overlap: bool = False


@dataclass
class _Folder:
    """The state of one document's fold; ``put`` takes its elements in order and gives finished chunks."""

    doc: str
    policy: ChunkPolicy
    group: list[_Element] = field(default_factory=list)
    tokens: int = 0
    number: int = 0
    anchor: str | None = None
    last: tuple[str, str] | None = None
    started: bool = False

    def _row(self, content: str, kind: str, tokens: int, members: list[_Element], types: set[str], reason: str, pages: bool = True) -> tuple:
        self.last = (kind, content)
        real = [e for e in members if not e.overlap]
        row = (
            self.doc,
            f"{self.doc}_chunk_{self.number}",
            content,
            kind,
            tokens,
            self.anchor,
            sorted({e.page for e in real if e.page}) if pages else [],
            [e.id for e in real if e.id],
            sorted(types),
            sorted(set().union(*(e.keywords for e in real)))[:10],
            len(real),
            any(e.overlap for e in members),
            reason,
        )
        self.number += 1
        return row

    def _close(self, members: list[_Element], reason: str) -> tuple:
        types = {e.kind or "TEXT" for e in members if not e.overlap}
        parts = [f"[{e.kind}]\n{e.content}" if e.kind in ("TABLE", "FIGURE") and not e.overlap else e.content for e in members]
        kind = "multimodal" if len(types) > 1 else {"TABLE": "table", "FIGURE": "figure"}.get(next(iter(types), ""), "text")
        whole = "\n\n".join(parts)
        return self._row(whole, kind, _size(whole), members, types, reason)

    def _flush(self, reason: str) -> list[tuple]:
        out = [self._close(self.group, reason)] if self.group else []
        self.group, self.tokens = [], 0
        return out

    def _seed(self, content: str | None, most: float | None) -> None:
        if content:
            n = _size(content)
            if most is None or n < most:
                self.group, self.tokens = [_Element("TEXT", content, n, overlap=True)], n

    def _fits(self, e: _Element) -> bool:
        p, both = self.policy, self.tokens + e.tokens
        if not self.group or both <= p.target:
            return both <= p.most or not self.group
        if both > min(p.most, p.target * 1.2):
            return False
        before = self.group[-1]
        score = 0.4 if before.anchor == e.anchor else 0.0
        if before.keywords and e.keywords:
            score += 0.4 * len(before.keywords & e.keywords) / len(before.keywords | e.keywords)
        return score > p.similarity

    def section(self, anchor: str | None) -> list[tuple]:
        """A new section begins; the last chunk's end goes before it unless it was a table or figure."""
        out = self._flush("end") if self.started else []
        carried = _tail(self.last[1], self.policy.overlap) if self.last and self.last[0] in ("text", "multimodal") else None
        self.anchor, self.started, self.last = anchor, True, None
        self._seed(carried, self.policy.overlap * 1.5)
        return out

    def put(self, e: _Element) -> list[tuple]:
        if e.tokens == 0:
            return []
        p = self.policy
        alone = (e.kind == "TABLE" and p.keep_large_tables and e.tokens > p.small_table) or (e.kind == "FIGURE" and not p.multimodal)
        if alone:
            return [*self._flush("before_kept"), self._close([e], "kept")]
        if e.tokens > p.most:
            return [*self._flush("before_split"), *self._pieces(e)]
        out = []
        if not self._fits(e):
            tail = next((m for m in reversed(self.group) if m.kind == "TEXT" and not m.overlap), None)
            carried = _tail(tail.content, p.overlap) if tail else None
            out = self._flush("full")
            self._seed(carried, None)
        self.group.append(e)
        self.tokens += e.tokens
        return out

    def _pieces(self, e: _Element) -> list[tuple]:
        out, held, total = [], [], 0
        for s in split_sentences(e.content):
            n = _size(s)
            if held and total + n > self.policy.target:
                out.append(self._row(" ".join(held), "text", total, [e], set(), "split", pages=False))
                held, total = [held[-1]], _size(held[-1])
            held.append(s)
            total += n
        if held:
            out.append(self._row(" ".join(held), "text", total, [e], set(), "split", pages=False))
        return out

    def end(self) -> list[tuple]:
        return self._flush("end") if self.started else []


def chunk_sections(elements: DataFrame, policy: ChunkPolicy = ChunkPolicy()) -> DataFrame:
    """Chunks of ``doc_id, seq, element_id, kind, content, section_anchor, page, keywords``.

    Chunks of five characters or fewer are dropped after numbering, which leaves gaps. An element's size is its content's; a null anchor is
    its own section under the default name. Groups that hold only overlap can come out, with no source.
    """
    columns = ["doc_id", "seq", "element_id", "kind", "content", "section_anchor", "page", "keywords"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CHUNK.split(", ")]
        folder: _Folder | None = None
        for batch in batches:
            rows: list[tuple] = []
            for doc, _, key, kind, content, anchor, page, words in batch[columns].itertuples(index=False):
                if folder is None or folder.doc != doc:
                    rows += folder.end() if folder else []
                    folder = _Folder(doc, policy)
                name = anchor if isinstance(anchor, str) else DEFAULT_ANCHOR
                if not folder.started or name != folder.anchor:
                    rows += folder.section(name)
                content = content if isinstance(content, str) else ""
                rows += folder.put(_Element(kind, content, _size(content), key, None if pd.isna(page) else int(page), anchor, frozenset(words if words is not None else ())))
            yield pd.DataFrame([r for r in rows if len(r[2].strip()) > 5], columns=names)
        if folder:
            yield pd.DataFrame([r for r in folder.end() if len(r[2].strip()) > 5], columns=names)

    ordered = elements.select(*columns).where(F.col("doc_id").isNotNull()).repartition("doc_id").sortWithinPartitions("doc_id", "seq", "element_id")
    return ordered.mapInPandas(run, CHUNK)


def chunk_fixed(docs: DataFrame, budget: int = 512) -> DataFrame:
    """``doc_id, chunk_id, content, token_count, section_anchor, element_id`` of whole texts packed by sentences. docs: ``doc_id, text``."""
    pieces = docs.select("doc_id", F.posexplode(text.pack_sentences(text.sentences(F.col("text")), budget)).alias("n", "x"))
    return pieces.where(F.length(text.strip(F.col("x.content"))) > 5).select(
        "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("_chunk_"), F.col("n").cast("string")).alias("chunk_id"), "x.content", "x.token_count", F.lit("Full Document").alias("section_anchor"), F.lit("full_doc").alias("element_id")
    )


def assembled(members: DataFrame) -> DataFrame:
    """One row per group of ``group_id, seq, kind, content, page, element_id, keywords``: joined content with markers, sorted sets, the type rule."""
    marked = F.when(F.col("kind").isin("TABLE", "FIGURE"), F.concat(F.lit("["), "kind", F.lit("]\n"), F.coalesce("content", F.lit("")))).otherwise(F.coalesce("content", F.lit("")))
    kinds = F.array_sort(F.collect_set(F.coalesce("kind", F.lit("TEXT"))))
    g = members.groupBy("group_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", marked.alias("c")))), lambda x: x["c"]), "\n\n").alias("content"),
        kinds.alias("element_types"),
        F.array_sort(F.collect_set(F.when(F.col("page") != 0, F.col("page")))).alias("pages"),
        F.transform(F.sort_array(F.collect_list(F.when(F.coalesce("element_id", F.lit("")) != "", F.struct("seq", "element_id")))), lambda x: x["element_id"]).alias("element_ids"),
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("keywords", F.array().cast("array<string>")))))), 1, 10).alias("keywords"),
        F.count(F.lit(1)).cast("int").alias("source_count"),
    )
    only = F.element_at("element_types", 1)
    kind = F.when(F.size("element_types") > 1, "multimodal").when(only == "TABLE", "table").when(only == "FIGURE", "figure").otherwise("text")
    return g.withColumn("chunk_type", kind).withColumn("token_count", text.token_count(F.col("content")))


def chunking_stats(elements: DataFrame, chunks: DataFrame, policy: ChunkPolicy = ChunkPolicy()) -> DataFrame:
    """One row: elements processed, chunks kept, tables kept whole, splits, tokens."""
    n = text.token_count(F.col("content"))
    kept = (F.col("kind") == "TABLE") & (n > policy.small_table)
    e = elements.agg(F.count(F.lit(1)).alias("elements_processed"), F.count_if(kept).alias("tables_preserved"), F.count_if((n > policy.most) & ~F.coalesce(kept, F.lit(False))).alias("splits_performed"))
    c = chunks.agg(F.count(F.lit(1)).alias("chunks_created"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"))
    both = e.unionByName(c, allowMissingColumns=True)
    return both.agg(*(F.sum(k).alias(k) for k in ("elements_processed", "tables_preserved", "splits_performed", "chunks_created", "tokens")))
