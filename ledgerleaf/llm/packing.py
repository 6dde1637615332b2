"""Filling containers of fixed capacity with texts of varying length, by swap-based local search.

Sizes are tokens of a public tokenizer. A text over the capacity is cut into full pieces and a rest; nothing else is cut. Items are
spread over shards of bounded size by a hash; in a shard a best-fit start is improved by exchanges between underfull bins:
the emptiest bin gives items away by a move, a one-for-one or a two-for-one exchange with another underfull bin. An exchange
happens only if it increases the sum of squared fills, and the one that leaves the receiver least room is taken. All items and all
pairs of the giving bin are tried against all offers, which a tree holds by what they take in and what they give back. A bin that
has given everything away is gone; a bin that finds no exchange is left as it is.

Cases: null text is no item; an empty text has size 0 and lies in some container. Rows that repeat an id are one item (its largest size).
Equal sizes are told apart by id, so results do not depend on row order. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.sources.stages import stage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published pattern that splits text before the merges of this vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHARD_ITEMS = 20_000
MAX_CAPACITIES = 100


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The byte-level tokenizer of a rank file."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_sizes(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``doc, n_tokens`` of every text that is not null."""
    kind = dict(docs.dtypes)["doc"]
    docs.sparkSession.sparkContext.addFile(path)  # executors need not have it
    name = os.path.basename(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(SparkFiles.get(name)).encode_ordinary
        for batch in batches:
            yield pd.DataFrame({"doc": batch["doc"], "n_tokens": np.array([len(encode(t)) for t in batch["text"]], np.int64)})

    return docs.select("doc", "text").where(F.col("doc").isNotNull() & F.col("text").isNotNull()).mapInPandas(run, f"doc {kind}, n_tokens long")


class _ByRoom:
    """Entries by an integer key, with the least key of at least some value; the keys in use are the bits of a number."""

    def __init__(self):
        self.at: dict[int, list] = {}
        self.mask = 0

    def add(self, key: int, entry) -> None:
        if key in self.at:
            self.at[key].append(entry)
        else:
            self.at[key] = [entry]
            self.mask |= 1 << key

    def least(self, key: int) -> int:
        """The least key in use from ``key`` on, or -1."""
        rest = self.mask >> key
        return key + (rest & -rest).bit_length() - 1 if rest else -1

    def pop(self, key: int):
        entry = self.at[key].pop()
        if not self.at[key]:
            del self.at[key]
            self.mask &= ~(1 << key)
        return entry


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers; items in the given order, each into the bin it leaves least room in."""
    bins, rooms, room = [], _ByRoom(), []
    for i, s in enumerate(sizes):
        key = rooms.least(s)
        if key < 0:
            b = len(bins)
            bins.append([])
            room.append(capacity)
        else:
            b = rooms.pop(key)
        bins[b].append(i)
        room[b] -= s
        if room[b] > 0:
            rooms.add(room[b], b)
    return bins


class _Offers:
    """Offers by key (what a bin has room for if it gives its item y) with, in a tree, the least y of every range of keys."""

    def __init__(self, capacity: int):
        self.width = 1 << (2 * capacity + 1).bit_length()
        self.none = 2 * capacity + 2
        self.least = [self.none] * (2 * self.width)
        self.at: dict[int, list] = {}

    def _set(self, key: int) -> None:
        held = self.at.get(key)
        k = key + self.width
        self.least[k] = held[0][0] if held else self.none
        k >>= 1
        while k and self.least[k] != (new := min(self.least[2 * k], self.least[2 * k + 1])):
            self.least[k] = new
            k >>= 1

    def add(self, key: int, y: int, entry) -> None:
        heapq.heappush(self.at.setdefault(key, []), (y, entry))
        self._set(key)

    def first(self, low: int, high: int, below: int, good: Callable) -> tuple | None:
        """(key, y, entry) of the least key in [low, high) with a y of less than ``below``; entries that aren't good are dropped on the way."""
        while True:
            key = self._leftmost(low, below)
            if key < 0 or key >= high:
                return None
            held = self.at[key]
            if good(held[0][1]):
                return key, *held[0]
            heapq.heappop(held)
            self._set(key)

    def _leftmost(self, low: int, below: int) -> int:
        if low >= self.width:
            return -1
        k = low + self.width
        while self.least[k] >= below:
            while k & 1:  # the right neighbour of the smallest subtree that k ends
                k >>= 1
                if k <= 1:
                    return -1
            k += 1
        while k < self.width:
            k *= 2
            if self.least[k] >= below:
                k += 1
        return k - self.width


def improve(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Exchanges between underfull bins while they increase the sum of squared fills."""
    fill = [sum(sizes[i] for i in b) for b in bins]
    version = [0] * len(bins)
    # What a bin can take in for what it gives: its room for nothing, its room and y for its item y
    offers = _Offers(capacity)

    def offer(b: int) -> None:
        room = capacity - fill[b]
        if room > 0 and bins[b]:
            offers.add(room, 0, (b, version[b], -1))
            for i in {sizes[i]: i for i in bins[b]}.values():
                if sizes[i]:
                    offers.add(room + sizes[i], sizes[i], (b, version[b], i))

    def taker(amount: int, giver: int):
        """The offer that ``amount`` leaves least room in and that makes its bin fuller than the giver was."""
        found = offers.first(amount, capacity + amount - fill[giver], amount, lambda entry: entry[1] == version[entry[0]])
        return found and found[2]

    order = sorted((b for b in range(len(bins)) if fill[b] < capacity), key=lambda b: fill[b])
    for b in order:
        offer(b)
    least_bins = -(-sum(sizes) // capacity)
    alive = sum(1 for b in bins if b)
    for a in order:
        if alive <= least_bins:
            break
        version[a] += 1  # its own offers are no longer good
        while bins[a] and fill[a] < capacity:
            held: dict[int, list[int]] = {}
            for i in bins[a]:
                if sizes[i]:
                    held.setdefault(sizes[i], []).append(i)
            distinct = sorted(held, reverse=True)
            done = _exchange({s: (held[s][0],) for s in distinct}, a, taker)
            if done is None:
                twos: dict[int, tuple] = {2 * s: (held[s][0], held[s][1]) for s in distinct if len(held[s]) > 1}
                for k, s in enumerate(distinct):
                    for t in distinct[k + 1 :]:
                        twos.setdefault(s + t, (held[s][0], held[t][0]))
                done = _exchange(dict(sorted(twos.items(), reverse=True)), a, taker)
            if done is None:
                break
            give, (b, _, y) = done
            for i in give:
                bins[a].remove(i)
                bins[b].append(i)
            amount, back = sum(sizes[i] for i in give), 0
            if y >= 0:
                bins[b].remove(y)
                bins[a].append(y)
                back = sizes[y]
            fill[a] -= amount - back
            fill[b] += amount - back
            version[b] += 1
            offer(b)
            if all(sizes[i] == 0 for i in bins[a]):  # only empty texts are left; they fit anywhere
                if others := [b for b in order if b != a and bins[b]]:
                    bins[others[-1]] += bins[a]
                    bins[a] = []
        if bins[a]:
            offer(a)
        else:
            alive -= 1
    return [b for b in bins if b]


def _exchange(tries: dict[int, tuple], giver: int, taker: Callable) -> tuple | None:
    """(items to give, offer) of the first amount that an offer takes."""
    for amount, give in tries.items():
        if offer := taker(amount, giver):
            return give, offer
    return None


def pack_sizes(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers for items of at most ``capacity``, largest first."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    ranked = [sizes[i] for i in order]
    return [[order[i] for i in b] for b in improve(best_fit(ranked, capacity), ranked, capacity)]


def pack(docs: DataFrame, limits: DataFrame, path: str = TOKENIZER, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``limit_id, container_id, doc, piece_no, token_start, n_tokens`` of every piece of every text for every ``pack`` capacity.

    limits: at most 100 capacities, checked. A shard holds about ``shard_items`` items, so the work of a task is bounded; no more
    than the last bins of a shard are underfull.
    """
    rows = limits.where(F.col("purpose") == "pack").select("limit_id", "max_tokens").limit(MAX_CAPACITIES + 1).collect()
    if len(rows) > MAX_CAPACITIES:
        raise ValueError(f"more than {MAX_CAPACITIES} capacities")
    kind = dict(docs.dtypes)["doc"]
    sized = stage(token_sizes(docs, path), "token-sizes").groupBy("doc").agg(F.max("n_tokens").alias("n_tokens"))
    shards = max(1, -(-sized.count() // shard_items))
    wanted = F.array(*(F.struct(F.lit(r.limit_id).alias("limit_id"), F.lit(r.max_tokens).cast("long").alias("capacity")) for r in rows if r.max_tokens and r.max_tokens > 0))
    if not rows:
        wanted = F.array().cast("array<struct<limit_id:string,capacity:bigint>>")
    items = sized.select("doc", "n_tokens", F.explode(wanted).alias("x")).select("doc", "n_tokens", "x.*")
    schema = f"limit_id string, container_id string, doc {kind}, piece_no int, token_start long, n_tokens long"

    def run(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        limit, shard = key
        capacity = int(items["capacity"].iloc[0])
        items = items.sort_values("doc", kind="stable")
        size = items["n_tokens"].to_numpy()
        docs_, full = items["doc"].to_numpy(), np.where(size > capacity, size // capacity, 0)
        rest = size - full * capacity
        left = np.flatnonzero((rest > 0) | (full == 0))
        whole = np.repeat(np.arange(len(size)), full)
        nth = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
        bins = pack_sizes(rest[left].tolist(), capacity)
        at = np.concatenate([np.asarray(b) for b in bins]) if bins else np.zeros(0, int)
        owner = np.repeat(np.arange(len(bins)), [len(b) for b in bins]) + len(whole)
        which = np.concatenate([whole, left[at]]).astype(int)
        number = np.concatenate([np.arange(len(whole)), owner])
        piece = np.concatenate([nth, full[left[at]]])
        return pd.DataFrame(
            {
                "limit_id": limit,
                "container_id": [f"{limit}/{shard}/{n}" for n in number],
                "doc": docs_[which],
                "piece_no": piece.astype(np.int32),
                "token_start": piece * capacity,
                "n_tokens": np.concatenate([np.full(len(whole), capacity), rest[left[at]]]).astype(np.int64),
            }
        )

    # a number of partitions that adaptive execution leaves alone, since small groups of rows are much work
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("doc"), F.lit(shards)).cast("int")).repartition(max(1, 4 * len(rows) * shards), "limit_id", "shard")
    return dealt.groupBy("limit_id", "shard").applyInPandas(run, schema)


def fill_summary(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """Per capacity: containers, tokens, the least possible number of containers and the share of used space."""
    each = packed.groupBy("limit_id").agg(F.countDistinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"), F.countDistinct("doc").alias("n_docs"))
    out = each.join(limits.select("limit_id", F.col("max_tokens").alias("capacity")), "limit_id")
    return out.select("limit_id", "capacity", "n_docs", "n_tokens", "n_containers", F.ceil(F.col("n_tokens") / F.col("capacity")).alias("least_containers"), F.round(F.col("n_tokens") / F.col("capacity") / F.col("n_containers"), 6).alias("used"))
