"""Long spans that stand character for character in more than one record, through a log-structured fingerprint index.

Fingerprints are winnowed window hashes: of the rolling hashes of all ``GRAM`` characters the least of every
``min_chars - GRAM + 1`` neighbours is kept, so two texts that share ``min_chars`` characters share a fingerprint. The index is
a log of sorted immutable runs, bucketed by hash, with a manifest in its folder, so that a later session can open it and hold new
batches against it. A batch is written as a run of its own and merge-joined with itself and with every older run (a sort-merge
join without exchange, since all runs have the same buckets); when ``FAN_OUT`` runs of a level have gathered they are compacted into
one of the next. Candidate pairs are verified on the texts.

Records of equal text form a class; only its least id is indexed. A fingerprint held by more than ``HOT`` records of a run would give
more pairs than there are true ones. For these the windows of ``min_chars`` characters around the fingerprint are compared instead.
Occurrences with the same surroundings are one, and two occurrences meet only in the first window of what they share, so no
pair is made once for every character it shares; holders of one window are dealt to pairs of blocks.

How much of a record is shared needs no pairs at all: windows are counted by their holders (in each task before they travel), and those of
two or more records are merged to intervals.

Cases: null texts and texts shorter than ``min_chars`` share nothing. Equal texts share all of their length. Rows that repeat an id
are one record (the text with the least digest). White space counts, and case does. Extra columns are ignored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerleaf.llm.blocks import dealt_pairs
from ledgerleaf.sources.stages import drop, new_path, read_text, stage, write_text

GRAM = 96  # shorter ones are shared by many texts that share no span
FAN_OUT = 4
BATCHES = FAN_OUT + 1  # the last one is held against a compacted run
HOT = 64
_CHARS = 1_000_000
_ROWS = 200_000
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    out = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Mixed 64-bit hashes of all windows of k numbers."""
    n = len(codes)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = _powers(1 << max(20, int(n).bit_length()))
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * down[: n - k + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """The least of every w neighbours."""
    n = len(h)
    if n < w:
        return h[:0]
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = h
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def fingerprints(texts: list[str], min_chars: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, fingerprint), each pair once; every text has at least min_chars characters."""
    sizes = np.array([len(t) for t in texts])
    codes, w = _codes("".join(texts)), min_chars - gram + 1
    h = gram_hashes(codes, gram)
    least = window_minima(h, w)
    ends = np.cumsum(sizes)
    own = np.repeat(np.arange(len(texts)), sizes)[: len(least)]
    inside = np.arange(len(least)) + min_chars <= ends[own]  # windows that cross into the next text don't count
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (own[1:] != own[:-1]) | ~inside[:-1]
    at = np.flatnonzero(new & inside)
    pairs = pd.DataFrame({"k": own[at], "h": least[at]}).drop_duplicates()
    return pairs["k"].to_numpy(), pairs["h"].to_numpy()


def _batched(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list[str]]]:
    keys, texts, size = [], [], 0
    for batch in batches:
        for key, text in zip(batch["doc"], batch["text"]):
            keys.append(key)
            texts.append(text)
            size += len(text)
            if size >= _CHARS:
                yield keys, texts
                keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def fingerprint_rows(docs: DataFrame, min_chars: int = 200, gram: int = GRAM) -> DataFrame:
    """``h, doc`` of all fingerprints."""
    kind = dict(docs.dtypes)["doc"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for keys, texts in _batched(batches):
            k, h = fingerprints(texts, min_chars, gram)
            yield pd.DataFrame({"h": h.view(np.int64), "doc": pd.Series(keys, dtype=object if isinstance(keys[0], str) else "int64").to_numpy()[k]})

    return docs.select("doc", "text").where(F.length("text") >= min_chars).mapInPandas(run, f"h long, doc {kind}")


class FingerprintLog:
    """A log of sorted immutable runs of fingerprints in a folder.

    ``add`` writes a batch as a run of level 0 and returns it; ``runs`` are the tables of the log, oldest first. ``compact`` merges the
    runs of a level when there are FAN_OUT of them. All runs are bucketed by hash and sorted within buckets. The manifest is written last,
    so a failed batch leaves the log as it was; ``FingerprintLog(spark, at)`` opens the log that a folder holds.
    """

    def __init__(self, spark: SparkSession, at: str | None = None, buckets: int | None = None, fan_out: int = FAN_OUT):
        self.spark, self.fan_out, self.at = spark, fan_out, at or new_path(spark, "span-log")
        self.buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.levels: list[list[str]] = [[]]
        self.n_compacted = 0
        if (text := read_text(spark, f"{self.at}/manifest.json")) is not None:
            held = json.loads(text)
            self.buckets, self.levels = held["buckets"], held["levels"]
            for name in self.runs:
                if not spark.catalog.tableExists(name):
                    spark.sql(f"CREATE TABLE {name} (h BIGINT, doc {held['kind']}) USING parquet CLUSTERED BY (h) SORTED BY (h, doc) INTO {self.buckets} BUCKETS LOCATION '{self.at}/{name}'")

    @property
    def runs(self) -> list[str]:
        return [name for level in reversed(self.levels) for name in level]

    @property
    def full(self) -> bool:
        return len(self.levels[0]) >= self.fan_out

    def _save(self, kind: str) -> None:
        write_text(self.spark, f"{self.at}/manifest.json", json.dumps({"buckets": self.buckets, "levels": self.levels, "kind": kind}))

    def _write(self, rows: DataFrame) -> str:
        name = f"run_{uuid.uuid4().hex}"
        (
            rows.repartition(self.buckets, "h")
            .sortWithinPartitions("h", "doc")
            .write.bucketBy(self.buckets, "h")
            .sortBy("h", "doc")
            .option("path", f"{self.at}/{name}")
            .option("compression", "zstd")
            .format("parquet")
            .saveAsTable(name)
        )
        return name

    def add(self, rows: DataFrame) -> str:
        name = self._write(rows.select("h", "doc"))
        self.levels[0].append(name)
        self._save(dict(rows.dtypes)["doc"])
        return name

    def compact(self) -> None:
        """Merge full levels; the merged runs' files are deleted, so probe a batch before this."""
        for k, level in enumerate(self.levels):
            if len(level) >= self.fan_out:
                merged = self.spark.table(level[0])
                for name in level[1:]:
                    merged = merged.unionByName(self.spark.table(name))
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self._write(merged))
                self.levels[k] = []
                self._save(dict(merged.dtypes)["doc"])
                self.drop(level)
                self.n_compacted += 1

    def drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            drop(self.spark, f"{self.at}/{name}")

    def clear(self) -> None:
        self.drop(self.runs)
        drop(self.spark, self.at)
        self.levels = [[]]

    def hot(self, name: str) -> DataFrame:
        """``h`` of the fingerprints that more than HOT records of a run hold; no exchange, since a bucket has all of them."""
        return self.spark.table(name).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("h")

    def probe(self, name: str, hot: DataFrame) -> DataFrame:
        """Pairs ``a, b`` (a < b, some several times) of the run ``name`` with itself and the older runs by fingerprints that aren't hot."""
        new, pairs = self.spark.table(name), None
        x = new.join(hot, "h", "left_anti").select("h", F.col("doc").alias("x"))
        for other in self.runs[: self.runs.index(name) + 1]:
            both = x.join(self.spark.table(other).select("h", F.col("doc").alias("y")), "h")
            both = both.where(F.col("x") < F.col("y")) if other == name else both.where(F.col("x") != F.col("y"))
            both = both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            pairs = both if pairs is None else pairs.unionByName(both)
        return pairs


def _common(a: str, b: str, i: int, j: int, n: int) -> int:
    """How far a from i and b from j agree, known to for n characters; by blocks that double."""
    step = 256
    while True:
        s, t = a[i + n : i + n + step], b[j + n : j + n + step]
        if s == t and len(s) == step:
            n, step = n + step, 2 * step
            continue
        m = min(len(s), len(t))
        differ = np.flatnonzero(_codes(s[:m]) != _codes(t[:m]))
        return n + (int(differ[0]) if len(differ) else m)


def shared_stretches(a: str, b: str, min_chars: int) -> list[tuple[int, int, int]]:
    """All maximal equal stretches (start in a, start in b, length) of at least min_chars characters; equal texts give at least one.

    A stretch begins at every two places whose windows are equal and whose characters before are not. Hashes of all windows, sorted by
    the character before, give these beginnings and no others; comparing the characters proves them. So the work follows the number
    of stretches, also in texts with a period.
    """
    if min(len(a), len(b)) < min_chars:
        return []
    ca, cb = _codes(a), _codes(b)
    x, y = gram_hashes(ca, min_chars), gram_hashes(cb, min_chars)
    value, inverse = np.unique(np.concatenate([x, y]), return_inverse=True)
    # the character before; a text's begin equals nothing
    before = lambda c, n, none: np.concatenate([[none], c[: n - 1].astype(np.int64)])
    ix, iy = inverse[: len(x)].astype(np.int64) << 21, inverse[len(x) :].astype(np.int64) << 21
    kx, ky = ix + before(ca, len(x), 0x1FFFFE), iy + before(cb, len(y), 0x1FFFFF)
    order = np.argsort(kx, kind="stable")
    kx = kx[order]
    lo, hi = np.searchsorted(kx, iy), np.searchsorted(kx, iy + (1 << 21))
    same_lo, same_hi = np.searchsorted(kx, ky), np.searchsorted(kx, ky, "right")
    out: list[tuple[int, int, int]] = []
    for j in np.flatnonzero(hi - lo > same_hi - same_lo):
        for part in (order[lo[j] : same_lo[j]], order[same_hi[j] : hi[j]]):
            for i in part.tolist():
                if a[i : i + min_chars] == b[j : j + min_chars]:
                    out.append((i, int(j), _common(a, b, i, int(j), min_chars)))
    return sorted(out)


class _Windows:
    """Sorted window hashes of texts, kept while there are not too many characters."""

    def __init__(self, min_chars: int):
        self.min_chars, self.size, self.held = min_chars, 0, {}

    def __call__(self, key, text: str) -> tuple[np.ndarray, np.ndarray]:
        if key not in self.held:
            if self.size > _CHARS:
                self.held.clear()
                self.size = 0
            self.size += len(text)
            h = gram_hashes(_codes(text), self.min_chars)
            order = np.argsort(h, kind="stable")
            self.held[key] = h[order], order
        return self.held[key]


def _share_any(min_chars: int):
    """Pairs that share a span; one is enough, so the search ends with the first that is proven."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        windows = _Windows(min_chars)
        for batch in batches:
            rows = []
            for a, b, s, t in batch[["a", "b", "text_a", "text_b"]].itertuples(index=False):
                h, order = windows(a, s)
                y, other = windows(b, t)
                at = np.minimum(np.searchsorted(h, y), len(h) - 1)
                for k in np.flatnonzero(h[at] == y):
                    i, j = int(order[at[k]]), int(other[k])
                    if s[i : i + min_chars] == t[j : j + min_chars]:
                        rows.append((a, b))
                        break
            yield pd.DataFrame(rows, columns=["a", "b"])

    return run


def _all_stretches(min_chars: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for a, b, s, t in batch[["a", "b", "text_a", "text_b"]].itertuples(index=False):
                rows += [(a, b, i + 1, j + 1, n, len(s), len(t)) for i, j, n in shared_stretches(s, t, min_chars)]
            yield pd.DataFrame(rows, columns=["a", "b", "start_a", "start_b", "n_chars", "size_a", "size_b"])

    return run


def _hot_pairs(docs: DataFrame, held: DataFrame, min_chars: int, gram: int) -> DataFrame:
    """Pairs of records that agree in a window of min_chars around a hot fingerprint. held: ``doc, held``, the hot ones of each record."""
    kind = dict(docs.dtypes)["doc"]

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, text, hot in zip(batch["doc"], batch["text"], batch["held"]):
                codes = _codes(text)
                whole = gram_hashes(codes, min_chars).view(np.int64)
                keep = np.zeros(len(whole), bool)
                for i in np.flatnonzero(np.isin(gram_hashes(codes, gram).view(np.int64), np.asarray(hot))):
                    keep[max(0, i - min_chars + gram) : i + 1] = True
                edges = np.flatnonzero(np.diff(np.concatenate([[0], keep.view(np.int8), [0]])))
                # a stretch of windows that all stand around hot fingerprints; equal stretches have equal marks
                for lo, hi in edges.reshape(-1, 2):
                    w = whole[lo:hi]
                    mark = int(gram_hashes(w.view(np.uint64), len(w)).view(np.int64)[0])
                    yield pd.DataFrame({"w": w, "before": pd.Series(np.concatenate([[0], w[:-1]])), "first": np.arange(len(w)) == 0, "mark": mark, "doc": [key] * len(w)})

    rows = stage(docs.join(held, "doc").select("doc", "text", "held").mapInPandas(windows, f"w long, before long, first boolean, mark long, doc {kind}"), "hot-windows")
    holders = stage(rows.select("mark", "doc").distinct(), "hot-holders")
    kinds = rows.groupBy("mark", "w", "before", "first").agg(F.count(F.lit(1)).alias("n")).select("mark", "w", "before", "first")
    met = dealt_pairs(kinds, ["w"], ["mark", "before", "first"]).where("x.mark < y.mark and (x.first or y.first or x.before != y.before)")
    met = met.select(F.col("x.mark").alias("m"), F.col("y.mark").alias("mark")).distinct()
    other = met.join(holders.select(F.col("mark").alias("m"), F.col("doc").alias("x")), "m").select("mark", "x").distinct()
    across = other.join(holders.withColumnRenamed("doc", "y"), "mark").select("x", "y")
    within = dealt_pairs(holders, ["mark"], ["doc"]).select(F.col("x.doc").alias("x"), F.col("y.doc").alias("y"))
    both = across.unionByName(within.where(F.col("x") < F.col("y"))).where(F.col("x") != F.col("y"))
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


@dataclass(frozen=True)
class Shared:
    """What the log gives: candidate pairs ``a, b`` of classes of equal texts, copies ``doc, rep, n_copies, n_chars`` of classes of several
    records, the classes' texts ``doc, text``, their fingerprints ``h, doc``, and how often the log was compacted."""

    pairs: DataFrame
    copies: DataFrame
    texts: DataFrame
    prints: DataFrame
    n_compacted: int


def _digest(text: str = "text") -> Column:
    return F.unhex(F.md5(text))


def text_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows ``doc, text`` without those whose text a lesser id has, ``doc, rep, n_copies, n_chars`` of texts of several records)."""
    once = docs.groupBy("doc").agg(F.min(F.struct(_digest().alias("digest"), F.length("text").alias("n_chars"))).alias("x")).select("doc", "x.*")
    several = once.groupBy("digest").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("n_copies")).where(F.col("n_copies") > 1)
    copies = stage(once.join(several, "digest").select("doc", "rep", "n_copies", "n_chars"), "span-copies")
    return docs.join(copies.where(F.col("doc") != F.col("rep")).select("doc"), "doc", "left_anti"), copies


def search(docs: DataFrame, min_chars: int = 200, batches: int = BATCHES, gram: int = GRAM, log: FingerprintLog | None = None, earlier: DataFrame | None = None) -> Shared:
    """Candidates of all records, which come in ``batches`` batches (by a hash of the id, as if they arrived one after another), each
    held against the log of the earlier ones. A log that is given is kept, else it is deleted. ``earlier`` (``doc, text``) are the records that
    a given log holds from before; of their classes the representatives are met.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc"]
    docs = docs.select("doc", "text").where(F.col("doc").isNotNull() & (F.length("text") >= min_chars))
    texts, copies = text_classes(docs)
    prints = stage(fingerprint_rows(texts, min_chars, gram).withColumn("batch", F.pmod(F.xxhash64("doc"), F.lit(batches)).cast("int")), "fingerprints")
    known = texts if earlier is None else texts.unionByName(earlier.select("doc", "text"))
    own = log or FingerprintLog(spark)
    try:
        pairs = _candidates(own, prints, batches, known, min_chars, gram)
        pairs = stage(pairs.select(F.col("a").cast(kind), F.col("b").cast(kind)).distinct(), "span-candidates")
    finally:
        if log is None:
            own.clear()
    return Shared(pairs, copies, known, prints.select("h", "doc"), own.n_compacted)


def _candidates(log: FingerprintLog, prints: DataFrame, batches: int, texts: DataFrame, min_chars: int, gram: int) -> DataFrame:
    """``a, b`` of all batches with themselves and with what the log holds before them; prints: ``h, doc, batch``."""
    spark, pairs, waiting = prints.sparkSession, None, []
    hot = spark.createDataFrame([], "h long")
    for name in log.runs:
        hot = hot.unionByName(log.hot(name))
    for k in range(batches):
        waiting.append(log.add(prints.where(F.col("batch") == k)))
        if log.full or k + 1 == batches:  # compaction deletes runs, so what waits is probed before
            for name in waiting:
                hot = hot.unionByName(log.hot(name))
            hot = stage(hot.distinct(), "span-hot")
            found = log.probe(waiting[0], hot)
            for name in waiting[1:]:
                found = found.unionByName(log.probe(name, hot))
            found, waiting = stage(found.distinct(), "span-pairs"), []
            pairs = found if pairs is None else pairs.unionByName(found)
            log.compact()
    if not hot.isEmpty():
        held = None
        for name in log.runs:
            x = spark.table(name).join(hot, "h", "left_semi")
            held = x if held is None else held.unionByName(x)
        pairs = pairs.unionByName(_hot_pairs(texts, stage(held.groupBy("doc").agg(F.collect_set("h").alias("held")), "hot-held"), min_chars, gram))
    return pairs


def _sides(found: Shared) -> DataFrame:
    """``a, b, text_a, text_b`` of the candidates."""
    members = found.pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    texts = stage(found.texts.join(members, "doc", "left_semi").groupBy("doc").agg(F.min_by("text", _digest()).alias("text")), "span-texts")
    return found.pairs.join(texts.toDF("b", "text_b"), "b").join(texts.toDF("a", "text_a"), "a").sortWithinPartitions("a").select("a", "b", "text_a", "text_b")


def shared_pairs(docs: DataFrame, min_chars: int = 200, batches: int = BATCHES, gram: int = GRAM, log: FingerprintLog | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """All pairs ``a, b`` (ids, a < b) of records that share a span, pairs of equal texts included."""
    found = search(docs, min_chars, batches, gram, log, earlier)
    kind = dict(docs.dtypes)["doc"]
    links = stage(_sides(found).mapInPandas(_share_any(min_chars), f"a {kind}, b {kind}"), "span-links")
    x = found.copies.select(F.col("rep").alias("a"), F.col("doc").alias("x"))
    y = found.copies.select(F.col("rep").alias("b"), F.col("doc").alias("y"))
    across = links.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
    within = dealt_pairs(found.copies.select("rep", "doc"), ["rep"], ["doc"]).select(F.col("x.doc").alias("x"), F.col("y.doc").alias("y")).where(F.col("x") < F.col("y"))
    return across.unionByName(within).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def shared_spans(docs: DataFrame, min_chars: int = 200, batches: int = BATCHES, gram: int = GRAM, log: FingerprintLog | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """All maximal stretches ``a, b, start_a, start_b, n_chars, size_a, size_b`` (a < b, places 1-based, sizes of the texts).

    Of equal texts the least id stands for all: the others have one row each, with that id and the whole text.
    """
    found = search(docs, min_chars, batches, gram, log, earlier)
    kind = dict(docs.dtypes)["doc"]
    spans = _sides(found).mapInPandas(_all_stretches(min_chars), f"a {kind}, b {kind}, start_a int, start_b int, n_chars int, size_a int, size_b int")
    one, size = F.lit(1), F.col("n_chars")
    copies = found.copies.where(F.col("doc") != F.col("rep")).select(F.col("rep").alias("a"), F.col("doc").alias("b"), one.alias("start_a"), one.alias("start_b"), size, size.alias("size_a"), size.alias("size_b"))
    return spans.unionByName(copies)


def shared_amounts(docs: DataFrame, min_chars: int = 200, batches: int = BATCHES, gram: int = GRAM) -> DataFrame:
    """``doc, n_chars, shared_chars, shared_share, n_copies`` of every record of which a window of min_chars stands in another too.

    n_copies counts the records of the same text. Fingerprints in the log tell which windows can be shared; each is known by its own hash and
    its fingerprint's, 128 bits together. No pair of records is made.
    """
    marked, copies = search_windows(docs, min_chars, batches, gram)
    w = Window.partitionBy("doc").orderBy("at")
    fresh = F.least(F.lit(min_chars), F.col("at") - F.coalesce(F.lag("at").over(w), F.lit(-min_chars)))
    part = marked.withColumn("fresh", fresh).groupBy("doc").agg(F.sum("fresh").alias("shared_chars"), F.max("size").alias("n_chars"))
    whole = copies.select("doc", F.col("n_chars").alias("size"), "n_copies")
    both = part.join(whole, "doc", "full").select(
        "doc", F.coalesce("size", "n_chars").cast("long").alias("n_chars"), F.coalesce("size", "shared_chars").cast("long").alias("shared_chars"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies")
    )
    return both.select("doc", "n_chars", "shared_chars", F.round(F.col("shared_chars") / F.col("n_chars"), 6).alias("shared_share"), "n_copies")


def search_windows(docs: DataFrame, min_chars: int, batches: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """(``doc, at, size`` of windows that stand in two or more different texts, copies as ``text_classes`` gives them)."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc"]
    docs = docs.select("doc", "text").where(F.col("doc").isNotNull() & (F.length("text") >= min_chars))
    texts, copies = text_classes(docs)
    prints = stage(fingerprint_rows(texts, min_chars, gram).withColumn("batch", F.pmod(F.xxhash64("doc"), F.lit(batches)).cast("int")), "fingerprints")
    log = FingerprintLog(spark)
    try:
        for k in range(batches):
            log.add(prints.where(F.col("batch") == k))
            log.compact()
        runs = None
        for name in log.runs:
            x = spark.table(name).groupBy("h").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"))
            runs = x if runs is None else runs.unionByName(x)
        several = stage(runs.groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where(F.col("lo") != F.col("hi")).select("h"), "shared-prints")
    finally:
        log.clear()
    held = prints.join(several, "h", "left_semi").groupBy("doc").agg(F.collect_set("h").alias("held"))

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, parts, n = [], [], 0

        def rows() -> pd.DataFrame:
            w, h, at, size = (np.concatenate(x) for x in zip(*parts))
            named = pd.Series(keys, dtype=object if isinstance(keys[0], str) else "int64").repeat([len(p[0]) for p in parts]).to_numpy()
            return pd.DataFrame({"w": w, "h": h, "doc": named, "at": at, "size": size})

        for batch in batches:
            for key, text, shared in zip(batch["doc"], batch["text"], batch["held"]):
                codes = _codes(text)
                least = window_minima(gram_hashes(codes, gram), min_chars - gram + 1).view(np.int64)
                at = np.flatnonzero(np.isin(least, np.asarray(shared)))
                keys.append(key)
                parts.append((gram_hashes(codes, min_chars).view(np.int64)[at], least[at], at.astype(np.int32), np.full(len(at), len(text), np.int32)))
                n += len(at)
                if n >= _ROWS:
                    yield rows()
                    keys, parts, n = [], [], 0
        if keys:
            yield rows()

    once = texts.join(held, "doc").groupBy("doc").agg(F.min_by("text", _digest()).alias("text"), F.first("held").alias("held"))
    rows = stage(once.mapInPandas(windows, f"w long, h long, doc {kind}, at int, size int"), "shared-windows")
    known = rows.groupBy("w", "h").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where(F.col("lo") != F.col("hi")).select("w", "h")
    return rows.join(known, ["w", "h"], "left_semi").select("doc", "at", "size"), copies
