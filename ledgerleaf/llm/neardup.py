"""Near-duplicate records through a hierarchical index over fingerprints in Gray order.

A record's fingerprint is its min-hash values over word shingles, a long bit pattern. The upper nodes of the index are masked
patterns: for every band the fingerprint with all bits but the band's masked out. Records that share a masked pattern hang
below one upper node. Below it the records' short fingerprints (two bits of every min-hash value) are sorted by Gray rank, so
that neighbours differ in few bits; runs of neighbours form inner nodes that keep the bits all members share and a mask of them,
and the members keep only the rest. A search adds up differences on the way down and leaves a whole group as soon as they
exceed the radius. What remains is compared exactly.

Records whose word sequences are equal form a class and are indexed once. A node with more than ``HOT`` records is not held in one
task: its records are dealt to salted blocks and each pair of blocks is a group of its own, which gives the pairs across the two only.
So are the copies of one text where their pairs are asked for.

Cases: null texts and texts under ``min_words`` words are in no pair, nor are texts without a word; those
of fewer words than a sequence has are alike only if their words are equal. Ties do not arise: links are sets. Rows that repeat an id
are one record. Texts of any length are used whole. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm.blocks import dealt_pairs
from ledgerleaf.sources.stages import stage

WORD = re.compile(r"[^\W_]+")
BANDS, ROWS = 18, 3
HOT = 20_000
NODE = 16
_VOCAB = 500_000
_rng = np.random.default_rng(20240229)
_MULT = _rng.integers(0, 2**32, BANDS * ROWS, np.uint32) | np.uint32(1)
_PLUS = _rng.integers(0, 2**32, BANDS * ROWS, np.uint32)
_MIX = _rng.integers(0, 2**64, ROWS + 3, np.uint64) | np.uint64(1)
BITS = 2 * BANDS * ROWS


class _Words(dict):
    """64-bit hashes of words, kept while there are not too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > _VOCAB:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def word_hashes(text: str, cache: dict) -> np.ndarray:
    w = WORD.findall(text.lower())
    return np.fromiter(map(cache.__getitem__, w), np.uint64, len(w))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all sequences of k words."""
    n = len(words) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = words[:n] * _MIX[0]
    for j in range(1, k):
        h = (h ^ (h >> np.uint64(31))) * _MIX[1] + words[j : n + j]
    h ^= h >> np.uint64(29)
    h *= _MIX[2]
    return h ^ (h >> np.uint64(32))


def min_hashes(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Min-hash values, a row per record; ``starts`` are the records' first shingles."""
    x = (shingles >> np.uint64(16)).astype(np.uint32)
    out = np.empty((len(starts), BANDS * ROWS), np.uint32)
    for j in range(BANDS * ROWS):
        v = x * _MULT[j] + _PLUS[j]
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        out[:, j] = np.minimum.reduceat(v, starts)
    return out


def band_keys(mins: np.ndarray) -> np.ndarray:
    """The masked patterns of all bands as 64-bit keys, (records, bands)."""
    m = mins.reshape(len(mins), BANDS, ROWS).astype(np.uint64)
    h = np.arange(BANDS, dtype=np.uint64) * _MIX[3]
    for r in range(ROWS):
        h = (h ^ (h >> np.uint64(30))) * _MIX[4] + m[:, :, r]
    h *= _MIX[5]
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def short_prints(mins: np.ndarray) -> np.ndarray:
    """Two bits of every min-hash value, as two 64-bit words."""
    bits = np.stack([(mins >> np.uint32(9)) & np.uint32(1), (mins >> np.uint32(21)) & np.uint32(1)], 2).reshape(len(mins), -1)
    padded = np.zeros((len(mins), 128), np.uint8)
    padded[:, : bits.shape[1]] = bits
    return np.packbits(padded, axis=1).view(">u8").astype(np.uint64)


def radius(threshold: float) -> int:
    """Differing bits that a pair of the threshold exceeds with a chance of about one in two thousand."""
    n = BANDS * ROWS
    differ = 1 - threshold
    mean = n * differ
    return math.ceil(mean + 3.3 * math.sqrt(4 * 0.25 * n * differ * (1 - differ) + 2 * mean * 0.25))


def gray_rank(prints: np.ndarray) -> np.ndarray:
    """Rank of each 128-bit pattern in the reflected Gray code, as two words: the prefix parities of its bits."""
    out = prints.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    out[:, 1] ^= np.where(out[:, 0] & np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
    return out


class GrayIndex:
    """A hierarchical index over 128-bit patterns in Gray order; inner nodes hold the bits that all members share."""

    def __init__(self, prints: np.ndarray, node: int = NODE):
        rank = gray_rank(prints)
        self.order = np.lexsort((rank[:, 1], rank[:, 0]))
        level = prints[self.order]
        self.leaves = level
        # levels from the leaves up: (shared bits, mask of shared bits), NODE children each
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        same, mask = level, np.full_like(level, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.node = node
        while len(same) > 1:
            starts = np.arange(0, len(same), node)
            ones = np.bitwise_and.reduceat(same, starts)
            any_ = np.bitwise_or.reduceat(same, starts)
            kept = np.bitwise_and.reduceat(mask, starts) & ~(ones ^ any_)
            # bits in which a child's members differ are not shared; those were cleared in its pattern
            same, mask = ones & kept, kept
            self.levels.append((same, mask))

    def pairs_within(self, most: int) -> np.ndarray:
        """(i, j) of all pairs of patterns within the radius, i before j in Gray order."""
        n = len(self.leaves)
        if n < 2:
            return np.zeros((0, 2), np.int64)
        if not self.levels:
            return np.zeros((0, 2), np.int64)
        # search all leaves at once: pairs (query, node) that are still within the radius, level by level
        top = len(self.levels) - 1
        out = []
        for lo in range(0, n, 512):
            q = np.arange(lo, min(n, lo + 512))
            queries, nodes = np.repeat(q, len(self.levels[top][0])), np.tile(np.arange(len(self.levels[top][0])), len(q))
            for depth in range(top, -1, -1):
                same, mask = self.levels[depth]
                far = np.bitwise_count((self.leaves[queries] ^ same[nodes]) & mask[nodes]).sum(1)
                span = self.node ** (depth + 1)
                near = (far <= most) & ((nodes + 1) * span > queries + 1)
                queries, nodes = queries[near], nodes[near]
                children = nodes[:, None] * self.node + np.arange(self.node)
                size = len(self.levels[depth - 1][0]) if depth else n
                queries, nodes = np.repeat(queries, self.node), children.ravel()
                inside = nodes < size
                queries, nodes = queries[inside], nodes[inside]
            keep = nodes > queries
            queries, nodes = queries[keep], nodes[keep]
            near = np.bitwise_count(self.leaves[queries] ^ self.leaves[nodes]).sum(1) <= most
            out.append(np.stack([self.order[queries[near]], self.order[nodes[near]]], 1))
        return np.concatenate(out)


def signatures(docs: DataFrame, k: int, min_words: int) -> DataFrame:
    """``doc, cls, keys, f1, f2`` of every text with at least min_words words; cls is a hash of the word sequence.

    Texts of fewer than k words have no keys, so they meet only their copies.
    """
    kind = dict(docs.dtypes)["doc"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = _Words()
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.iloc[lo : lo + 500]
                rows, shingles, cls, short = [], [], [], []
                for doc, text in zip(part["doc"], part["text"]):
                    w = word_hashes(text, cache)
                    if len(w) >= min_words:
                        s = shingle_hashes(w, k)
                        if len(s):
                            rows.append(doc)
                            shingles.append(s)
                            cls.append(xxhash.xxh3_128_digest(w.tobytes()))
                        elif len(w):
                            short.append((doc, xxhash.xxh3_128_digest(w.tobytes()), [], 0, 0))
                if short:
                    yield pd.DataFrame(short, columns=["doc", "cls", "keys", "f1", "f2"])
                if rows:
                    sizes = np.array([len(s) for s in shingles])
                    mins = min_hashes(np.concatenate(shingles), np.cumsum(sizes) - sizes)
                    f = short_prints(mins).view(np.int64)
                    yield pd.DataFrame({"doc": rows, "cls": cls, "keys": list(band_keys(mins)), "f1": f[:, 0], "f2": f[:, 1]})

    return docs.select("doc", "text").where(F.length("text") >= 2 * min_words - 1).mapInPandas(run, f"doc {kind}, cls binary, keys array<long>, f1 long, f2 long")


def _node_pairs(most: int, hot: int):
    """Pairs below each upper node, from rows sorted by key; a node with more than ``hot`` rows gives a marker instead."""

    def group(rid: np.ndarray, prints: np.ndarray) -> np.ndarray:
        p = GrayIndex(prints).pairs_within(most)
        return np.sort(rid[p], axis=1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        skipping: int | None = None

        def groups(key: np.ndarray, rid: np.ndarray, prints: np.ndarray) -> Iterator[pd.DataFrame]:
            starts = np.flatnonzero(np.diff(key, prepend=key[0] - 1 if len(key) else 0))
            sizes = np.diff(np.append(starts, len(key)))
            out = []
            two = starts[sizes == 2]
            if len(two):
                near = np.bitwise_count(prints[two] ^ prints[two + 1]).sum(1) <= most
                out.append(np.sort(np.stack([rid[two[near]], rid[two[near] + 1]], 1), axis=1))
            for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
                out.append(group(rid[s : s + n], prints[s : s + n]))
            if out:
                found = np.concatenate(out)
                if len(found):
                    yield pd.DataFrame({"a": found[:, 0], "b": found[:, 1], "hot": False})

        def columns(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return batch["key"].to_numpy(), batch["rid"].to_numpy(), batch[["f1", "f2"]].to_numpy().view(np.uint64)

        for batch in batches:
            if batch.empty:
                continue
            held.append(columns(batch))
            key, rid, prints = (np.concatenate(x) for x in zip(*held))
            if skipping is not None:
                keep = key != skipping
                key, rid, prints = key[keep], rid[keep], prints[keep]
                if not len(key):
                    held = []
                    continue
                skipping = None
            last = int(np.searchsorted(key, key[-1])) if np.all(key[1:] >= key[:-1]) else int(len(key) - np.argmax(key[::-1] != key[-1])) if np.any(key != key[-1]) else 0
            if last:
                yield from groups(key[:last], rid[:last], prints[:last])
            held = [(key[last:], rid[last:], prints[last:])]
            if len(key) - last > hot:
                skipping, held = int(key[-1]), []
                yield pd.DataFrame({"a": [skipping], "b": [0], "hot": True})
        if held:
            key, rid, prints = (np.concatenate(x) for x in zip(*held))
            if skipping is not None:
                keep = key != skipping
                key, rid, prints = key[keep], rid[keep], prints[keep]
            if len(key):
                yield from groups(key, rid, prints)

    return run


def _block_pairs(most: int):
    """Pairs within a block of a hot node, or across two; rows carry the block they belong to."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rid, side, prints = rows["rid"].to_numpy(), rows["block"].to_numpy(), rows[["f1", "f2"]].to_numpy().view(np.uint64)
        p = GrayIndex(prints).pairs_within(most)
        if key[1] != key[2]:
            p = p[side[p[:, 0]] != side[p[:, 1]]]
        out = pd.DataFrame(np.sort(rid[p], axis=1), columns=["a", "b"])
        return out.assign(key=key[0])[["key", "a", "b"]]

    return run


def hot_pairs(rows: DataFrame, most: int, hot: int) -> DataFrame:
    """``key, a, b``, each once: pairs within the radius below nodes of many records, block by block. rows: ``rid, key, f1, f2``."""
    size = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(max(1, hot // 4))).cast("int").alias("blocks"))
    dealt = rows.join(size, "key").withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    # every pair of blocks is a group: a row goes to the pairs that hold its block
    dealt = dealt.select("key", "rid", "f1", "f2", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "rid", "f1", "f2", "block")
    return dealt.groupBy("key", "i", "j").applyInPandas(_block_pairs(most), "key long, a long, b long")


def candidates(reps: DataFrame, most: int, hot: int = HOT) -> DataFrame:
    """``a, b`` of records whose fingerprints meet below an upper node within the radius. reps: ``rid, keys, f1, f2``."""
    rows = reps.select("rid", F.explode("keys").alias("key"), "f1", "f2")
    found = stage(rows.repartition("key").sortWithinPartitions("key").mapInPandas(_node_pairs(most, hot), "a long, b long, hot boolean").distinct(), "node-pairs")
    pairs = found.where(~F.col("hot")).select("a", "b")
    keys = found.where("hot").select(F.col("a").alias("key"))
    if not keys.isEmpty():
        pairs = pairs.unionByName(hot_pairs(stage(rows.join(keys, "key"), "hot-nodes"), most, hot).select("a", "b"))
    return pairs.distinct()


def _likeness(k: int, threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, seen = _Words(), {}

        def shingles(key: int, text: str) -> np.ndarray:
            if key not in seen:
                if len(seen) > 2000:
                    seen.clear()
                seen[key] = np.unique(shingle_hashes(word_hashes(text, cache), k))
            return seen[key]

        for batch in batches:
            out = []
            for a, b, s, t in batch[["a", "b", "text_a", "text_b"]].itertuples(index=False):
                x, y = shingles(a, s), shingles(b, t)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both and both >= threshold * (len(x) + len(y) - both) - 1e-9:
                    out.append((a, b, both / (len(x) + len(y) - both)))
            yield pd.DataFrame(out, columns=["a", "b", "likeness"])

    return run


def links_and_members(docs: DataFrame, threshold: float, k: int, min_words: int) -> tuple[DataFrame, DataFrame]:
    """(links ``a, b, likeness`` between class representatives, members ``doc, rep``).

    docs: ``doc, text``. Numbers of records are places in a staged table, so they fit 64 bits at any size.
    """
    docs = docs.select("doc", "text").where(F.col("doc").isNotNull())
    sig = stage(signatures(docs, k, min_words).withColumn("rid", F.monotonically_increasing_id()), "signatures")
    # equal word sequences, among them rows that repeat an id, are one class
    copies = sig.groupBy("cls").agg(F.min("rid").alias("rep"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("cls", "rep")
    others = stage(sig.select("rid", "cls", "doc").join(copies, "cls").where(F.col("rid") != F.col("rep")).select("rid", "rep", "doc"), "copies")
    reps = sig.join(others.select("rid"), "rid", "left_anti")
    pairs = stage(candidates(reps.select("rid", "keys", "f1", "f2"), radius(threshold)), "near-pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct()
    named = sig.select("rid", "doc").join(ends, "rid")
    texts = stage(docs.join(named, "doc").groupBy("rid").agg(F.min("text").alias("text")), "near-texts")
    sides = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b").sortWithinPartitions("a")
    links = stage(sides.mapInPandas(_likeness(k, threshold), "a long, b long, likeness double"), "near-links")
    members = reps.select("doc", F.col("rid").alias("rep")).unionByName(others.select("doc", "rep")).distinct()
    return links, members


def near_pairs(docs: DataFrame, threshold: float = 0.8, k: int = 5, min_words: int = 20) -> DataFrame:
    """All pairs ``a, b`` (ids, a < b) of different records of at least the threshold, pairs of copies included."""
    links, members = links_and_members(docs, threshold, k, min_words)
    linked = links.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    alone = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("rep")
    members = stage(members.join(linked.unionByName(alone).distinct(), "rep", "left_semi"), "near-members")
    x, y = members.select(F.col("rep").alias("a"), F.col("doc").alias("x")), members.select(F.col("rep").alias("b"), F.col("doc").alias("y"))
    across = links.join(x, "a").join(y, "b").select("x", "y")
    copies = dealt_pairs(members, ["rep"], ["doc"]).select(F.col("x.doc").alias("x"), F.col("y.doc").alias("y")).where(F.col("x") < F.col("y"))
    both = across.unionByName(copies).where(F.col("x") != F.col("y"))
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """``node, component`` of every node of ``a, b``: the least node of its component.

    Large-star and small-star steps in turn (Kiveris et al., 2014), each staged, until no edge changes; the number of rounds grows with
    the logarithm of the number of nodes, and no step gathers a component in one task.
    """
    edges = stage(links.select("a", "b").where(F.col("a") != F.col("b")).distinct(), label)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where(F.col("a") != F.col("b"))
        new = stage(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
        state = [x.select(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() for x in (edges, new)]
        edges = new
        if state[0] == state[1]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def near_groups(docs: DataFrame, threshold: float = 0.8, k: int = 5, min_words: int = 20) -> DataFrame:
    """``doc, group_id, n_links, n_copies``: a row per record that is like another.

    group_id is the least id of the group; n_links counts the different texts it is linked to, n_copies the records of equal words.
    """
    links, members = links_and_members(docs, threshold, k, min_words)
    comp = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    copies = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n_copies"))
    all_ = members.join(copies, "rep").join(degree, "rep", "left").join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left")
    all_ = stage(all_.where(F.col("n_links").isNotNull() | (F.col("n_copies") > 1)).select("doc", F.coalesce("component", "rep").alias("c"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies"), "near-groups")
    names = all_.groupBy("c").agg(F.min("doc").alias("group_id"))
    return all_.join(names, "c").select("doc", "group_id", "n_links", "n_copies")
