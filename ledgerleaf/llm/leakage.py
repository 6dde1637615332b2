"""Evaluation texts that leaked into training text, found with suffix arrays.

The corpus is cut into shards of bounded size. A shard's index is the sequence of its word hashes and the array of all its suffixes, sorted
whole; it is staged, or written where the caller wants it (as Parquet with ``INDEX_OPTIONS``, else a file's shards are one row group, which
tasks hold whole), and knows nothing of any test set, so it serves every later one. Every suffix of
every test item is found in every shard by binary search, one word deeper at a time; what is left after ``min_words`` words are the
places of verbatim matches, which are then extended to the longest ones.

A word is a maximal run of letters or digits after lower-casing, known by its 64-bit hash.

Cases: null or empty texts match nothing. Equal texts each give their rows. Items shorter than ``min_words`` match nothing. Rows that repeat
an id are searched each, and the longest match counts. Test items are taken in blocks of bounded size, each against the index of all
rows, and a block's matches are staged before the next is read. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.sources.stages import stage

WORD = re.compile(r"[^\W_]+")
SHARD_CHARS = 2_000_000
#: Characters of a block of test items, on average.
BLOCK_CHARS = 8_000_000
_PAIRS = 1_000_000
_VOCAB = 500_000
END = np.uint64(0)
#: A row group for each shard. By default Parquet looks at a row group's size after 100 rows, which here hold some 350 MB.
INDEX_OPTIONS = {"parquet.block.row.count.limit": "1"}


class _Hashes(dict):
    """64-bit hashes of words, never 0; kept while there are not too many words."""

    def __missing__(self, word: str) -> int:
        if len(self) > _VOCAB:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word) or 1
        return h


def words(text: str | None) -> list[str]:
    """The words of a text."""
    return WORD.findall(text.lower()) if text else []


def sequence(texts: list[str | None], hashes: dict) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all texts, each text ended by 0; where each text begins)."""
    parts, starts, at = [], [], 0
    for text in texts:
        w = words(text)
        parts.append(np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w)))
        parts.append(np.zeros(1, np.uint64))
        starts.append(at)
        at += len(w) + 1
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.array(starts, np.int32)


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """The places of ``seq`` in the order of the suffixes that begin there.

    Ranks are doubled: suffixes sorted by h numbers are sorted by 2h through the ranks of what follows. A rank is the first place of its
    group in the array, so only groups that are not yet told apart are sorted again.
    """
    n = len(seq)
    order = np.argsort(seq, kind="stable")
    first = np.ones(n, bool)
    first[1:] = np.diff(seq[order]) != 0
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    slots, h = np.flatnonzero(~(first & np.append(first[1:], True))), 1
    while len(slots):
        some = order[slots]
        after = np.where(some + h < n, rank[np.minimum(some + h, n - 1)] + 1, 0)
        key = rank[some] * (n + 1) + after
        sort = np.argsort(key, kind="stable")
        some, key = some[sort], key[sort]
        order[slots] = some
        first = np.ones(len(some), bool)
        first[1:] = np.diff(key) != 0
        rank[some] = slots[np.maximum.accumulate(np.where(first, np.arange(len(some)), 0))]
        slots, h = slots[~(first & np.append(first[1:], True))], 2 * h
    return order.astype(np.int32)


def build_index(docs: DataFrame) -> DataFrame:
    """``docs, starts, words, suffixes``, a row per shard: ids, where each text begins, word hashes and suffix array. docs: ``doc, text``."""
    kind = dict(docs.dtypes)["doc"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        keys, texts, size = [], [], 0

        def shard() -> pd.DataFrame:
            seq, starts = sequence(texts, hashes)
            suffixes = suffix_array(seq)
            suffixes = suffixes[int(np.count_nonzero(seq == END)) :]  # those of the ends come first
            return pd.DataFrame({"docs": [keys], "starts": [starts], "words": [seq.view(np.int64)], "suffixes": [suffixes]})

        for batch in batches:
            for key, text in zip(batch["doc"], batch["text"]):
                keys.append(key)
                texts.append(text)
                size += len(text)
                if size >= SHARD_CHARS:
                    yield shard()
                    keys, texts, size = [], [], 0
        if keys:
            yield shard()

    return docs.select("doc", "text").where(F.length("text") > 0).mapInPandas(run, f"docs array<{kind}>, starts array<int>, words array<long>, suffixes array<int>")


class TestItems:
    """All suffixes of a block of test items that have ``min_words`` words."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str, str | None]], min_words: int):
        self.min_words, self.item = min_words, [(i, f) for i, f, _ in items]
        self.seq, self.first = sequence([t for _, _, t in items], _Hashes())
        ends = np.flatnonzero(self.seq == END)
        at = np.arange(len(self.seq))
        self.owner = np.searchsorted(ends, at)
        self.starts = np.flatnonzero(ends[self.owner] - at >= min_words) if len(at) else at

    def __len__(self) -> int:
        return len(self.starts)


def _bound(seq: np.ndarray, suffixes: np.ndarray, depth: int, want: np.ndarray, lo: np.ndarray, hi: np.ndarray, right: bool) -> np.ndarray:
    """For every range [lo, hi) of suffixes that agree in ``depth`` words, the first whose next word is not less (greater) than wanted."""
    lo, hi, last = lo.copy(), hi.copy(), len(seq) - 1
    while len(open_ := np.flatnonzero(lo < hi)):
        mid = (lo[open_] + hi[open_]) // 2
        word = seq[np.minimum(suffixes[mid].astype(np.int64) + depth, last)]
        less = word <= want[open_] if right else word < want[open_]
        lo[open_[less]] = mid[less] + 1
        hi[open_[~less]] = mid[~less]
    return lo


def search_shard(items: TestItems, starts: np.ndarray, seq: np.ndarray, suffixes: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(text number, item number): (words matched, first word in the text, first word in the item) of the longest match of each pair."""
    t = items.starts
    lo, hi = np.zeros(len(t), np.int64), np.full(len(t), len(suffixes), np.int64)
    for depth in range(items.min_words):
        want = items.seq[t + depth]
        lo, hi = _bound(seq, suffixes, depth, want, lo, hi, False), _bound(seq, suffixes, depth, want, lo, hi, True)
        keep = lo < hi
        t, lo, hi = t[keep], lo[keep], hi[keep]
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    sizes = np.cumsum(hi - lo)
    at = 0
    while at < len(t):
        # so many suffixes at once that their places stay below a bound, one at least
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + _PAIRS, "right")))
        n = hi[at:to] - lo[at:to]
        a = np.repeat(t[at:to], n)
        b = suffixes[np.repeat(lo[at:to] - np.cumsum(n) + n, n) + np.arange(n.sum())].astype(np.int64)
        inner = (a > 0) & (b > 0) & (items.seq[a - 1] != END) & (items.seq[a - 1] == seq[b - 1])  # part of a match that begins earlier
        a, b = a[~inner], b[~inner]
        long = np.full(len(a), items.min_words, np.int64)
        going = np.arange(len(a))
        while len(going):
            x = items.seq[a[going] + long[going]]
            going = going[(x != END) & (x == seq[b[going] + long[going]])]
            long[going] += 1
        text, item = np.searchsorted(starts, b, "right") - 1, items.owner[a]
        for k in np.lexsort((a, b, long)).tolist():
            key = (int(text[k]), int(item[k]))
            if long[k] > best.get(key, (0, 0, 0))[0]:
                best[key] = (int(long[k]), int(b[k] - starts[text[k]]), int(a[k] - items.first[item[k]]))
        at = to
    return best


def search_index(index: DataFrame, items: DataFrame, min_words: int = 8) -> DataFrame:
    """All leaks: ``doc, item, field, n_words, doc_word, item_word`` (places are 0-based word numbers of the longest match).

    index: of ``build_index``; items: ``item, field, text``, dealt to blocks by a hash of the item, with a pass over the index for each.
    """
    spark, kind = index.sparkSession, dict(index.dtypes)["docs"][6:-1]
    schema = f"doc {kind}, item string, field string, n_words int, doc_word int, item_word int"
    asked = items.select(F.col("item").cast("string").alias("item"), "field", "text").where(F.length("text") >= 2 * min_words - 1)
    blocks = max(1, -(-(asked.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS))

    def searched(block: TestItems):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for docs, starts, seq, suffixes in batch[["docs", "starts", "words", "suffixes"]].itertuples(index=False):
                    found = search_shard(block, np.asarray(starts), np.asarray(seq).view(np.uint64), np.asarray(suffixes))
                    rows = [(docs[k], *block.item[i], *m) for (k, i), m in found.items()]
                    yield pd.DataFrame(rows, columns=["doc", "item", "field", "n_words", "doc_word", "item_word"])

        return run

    out = None
    for k in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).orderBy("item", "field").collect()
        if block := TestItems([tuple(r) for r in rows], min_words):
            found = stage(index.mapInPandas(searched(block), schema), "leaks")
            out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], schema)
    longest = F.max_by(F.struct("n_words", "doc_word", "item_word"), F.struct("n_words", -F.col("doc_word"), -F.col("item_word"))).alias("x")
    return out.groupBy("doc", "item", "field").agg(longest).select("doc", "item", "field", "x.*")


def find_leaks(docs: DataFrame, items: DataFrame, min_words: int = 8) -> DataFrame:
    """``search_index`` over a staged index of ``docs``."""
    return search_index(stage(build_index(docs), "suffix-arrays", INDEX_OPTIONS), items, min_words)
