"""Cutting oversized items at natural boundaries by recursive bisection.

Size is the fallback token count: characters divided by 4, rounded down. An item over the limit is cut at the
strongest boundary near its midpoint; a half is cut again while it exceeds the limit minus the overlap. Then every piece
but the first is given the end of its predecessor's text as overlap, so that no piece exceeds the limit.

Cases: null, empty or small content yields no piece (it is not oversized). Content without any boundary is cut at the
midpoint, never between a character and its combining marks. Rows that repeat an id give their pieces once.
Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 4
#: Boundaries, strongest first; a cut falls behind the match.
BOUNDARIES = [
    re.compile(r"\n[ \t]*\n\s*"),
    re.compile(r"\n"),
    re.compile(r"[.!?…।؟۔][\"'”’»)\]]*\s+|[。！？][”」』）]*"),
    re.compile(r"[;:,،、，；：]\s*"),
    re.compile(r"\s+"),
]
MAX_LIMITS = 1000


def token_count(text: Column) -> Column:
    """Characters divided by 4, rounded down; null for null."""
    return F.floor(F.length(text) / CHARS_PER_TOKEN).cast("int")


def _cut(text: str, lo: int, hi: int, most: int) -> int:
    """The place to cut ``text[lo:hi]``: the strongest boundary in the middle half, the nearest to the midpoint."""
    mid, reach = (lo + hi) // 2, (hi - lo) // 4
    start, end = mid - reach, mid + reach
    for kind in BOUNDARIES:
        # a boundary may begin before the window and end in it; none is longer than this margin in ordinary text
        ends = [m.end() for m in kind.finditer(text, max(lo, start - 8), min(hi, end + 8))]
        if near := [e for e in ends if start <= e <= end and lo < e < hi]:
            return min(near, key=lambda e: (abs(e - mid), e))
    at = mid
    while at < end and (unicodedata.combining(text[at]) or unicodedata.category(text[at]) in ("Mn", "Mc", "Me")):
        at += 1
    return at


def bisect_text(text: str, max_tokens: int, overlap_tokens: int) -> list[tuple[int, int, int]]:
    """(start, end, characters of overlap before start) of each piece; the bodies cover the text without gaps."""
    if not 0 <= overlap_tokens < max_tokens:
        raise ValueError("the overlap must be smaller than the limit")
    whole = CHARS_PER_TOKEN * max_tokens + CHARS_PER_TOKEN - 1
    if len(text) <= whole:
        return [(0, len(text), 0)]
    body, lap = whole - CHARS_PER_TOKEN * overlap_tokens, CHARS_PER_TOKEN * overlap_tokens
    todo, done = [(0, len(text))], []
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= body:
            done.append((lo, hi))
            continue
        at = _cut(text, lo, hi, body)
        todo += [(at, hi), (lo, at)]
    return [(lo, hi, min(lap, lo)) for lo, hi in done]


def split_oversized(items: DataFrame, limits: DataFrame, id_col: str = "chunk_id", text_col: str = "content", anchor_col: str | None = "section_anchor") -> DataFrame:
    """Pieces of all items over a ``split`` limit.

    ``limits`` is a parameter table (``limit_id, purpose, max_tokens, overlap_tokens``) of at most 1,000 rows, which is checked.
    Returns ``limit_id, <id>, piece_no, start_pos, n_chars, overlap_chars, token_count, section_anchor, content``; ``start_pos``
    is 1-based and counts the overlap, so that ``substring(text, start_pos, n_chars)`` is the piece. Padded anchors are trimmed.
    """
    rows = limits.where(F.col("purpose") == "split").select("limit_id", "max_tokens", "overlap_tokens").limit(MAX_LIMITS + 1).collect()
    if len(rows) > MAX_LIMITS:
        raise ValueError(f"more than {MAX_LIMITS} limits")
    todo = sorted((r.limit_id, r.max_tokens, r.overlap_tokens or 0) for r in rows if r.max_tokens)
    least = min((m for _, m, _ in todo), default=2**30)
    schema = f"limit_id string, {id_col} string, piece_no int, start_pos int, n_chars int, overlap_chars int, token_count int, section_anchor string, content string"

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, text, anchor in batch.itertuples(index=False):
                for name, most, lap in todo:
                    if len(text) // CHARS_PER_TOKEN > most:
                        for k, (lo, hi, before) in enumerate(bisect_text(text, most, lap)):
                            piece = text[lo - before : hi]
                            out.append((name, key, k, lo - before + 1, len(piece), before, len(piece) // CHARS_PER_TOKEN, anchor, piece))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")]).astype({"piece_no": "int32", "start_pos": "int32", "n_chars": "int32", "overlap_chars": "int32", "token_count": "int32"})

    anchor = F.trim(F.col(anchor_col)) if anchor_col else F.lit(None).cast("string")
    over = items.select(F.col(id_col).cast("string").alias("k"), F.col(text_col).alias("t"), anchor.alias("a")).where(token_count(F.col("t")) > least)
    # only oversized items travel, each once
    once = over.groupBy("k").agg(F.min_by("t", F.struct(F.length("t"), F.xxhash64("t"), "a")).alias("t"), F.min("a").alias("a")).where(F.col("k").isNotNull())
    return once.mapInPandas(pieces, schema)
