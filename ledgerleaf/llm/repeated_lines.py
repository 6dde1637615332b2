"""Lines repeated across one source's documents.

A line is compared without letter case, outer white space and repeated inner white space, by a 128-bit hash. For every source and raw line
the documents that hold it are kept as compressed bitmaps; the bitmaps of variant lines (equal after normalising) are united,
their exact cardinalities are held against the threshold, and the bits of what remains name the documents and lines to delete.

A document's bit is its place in a staged table of the distinct documents: the high part names a container of 65,536 places,
the low 16 bits the place in it. A group never spans more than a container, so a source or a line that a third of all rows holds
is spread over as many groups as it has containers. Texts are cut once, and only hashes of lines travel: counts are added up in each task
before they are shuffled, a bit array tells in the task which lines can't pass, and the rest is keyed by document or container, never by line.

Cases: null or empty text has no lines. Documents without a source, or whose source is blank, are in no group, and nothing is
removed from them. A line that repeats within one document counts once but is removed at every place. Rows that repeat a
document id count once (if their texts differ, lines of either are removed by their numbers). Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

from ledgerleaf.sources.stages import stage

CONTAINER_BITS = 16
#: Most bits of the array that tells frequent lines, 8 MB; beyond it they are joined.
MOST_BITS = 1 << 26
_ARRAY_MOST = 4096  # entries of two bytes; a plain bitmap of a container has 8,192 bytes


def encode_container(values: np.ndarray) -> bytes:
    """Compressed bitmap of sorted distinct 16-bit values: runs, an array or plain bits, whichever is smallest."""
    v = values.astype(np.uint16)
    if not len(v):
        return b"a"
    starts = np.flatnonzero(np.diff(v.astype(np.int32), prepend=-2) != 1)
    if 4 * len(starts) < min(2 * len(v), 8192):
        ends = np.append(starts[1:], len(v)) - 1
        return b"r" + np.stack([v[starts], v[ends]], 1).astype("<u2").tobytes()
    if len(v) <= _ARRAY_MOST:
        return b"a" + v.astype("<u2").tobytes()
    bits = np.zeros(1 << CONTAINER_BITS, np.uint8)
    bits[v] = 1
    return b"b" + np.packbits(bits).tobytes()


def decode_container(data: bytes) -> np.ndarray:
    """The sorted values of a compressed bitmap."""
    kind, body = data[:1], data[1:]
    if kind == b"a":
        return np.frombuffer(body, "<u2")
    if kind == b"b":
        return np.flatnonzero(np.unpackbits(np.frombuffer(body, np.uint8))).astype(np.uint16)
    runs = np.frombuffer(body, "<u2").reshape(-1, 2).astype(np.int64)
    return np.concatenate([np.arange(a, b + 1) for a, b in runs]).astype(np.uint16) if len(runs) else np.zeros(0, np.uint16)


def unite(containers: list[bytes]) -> bytes:
    """The union of compressed bitmaps."""
    if len(containers) == 1:
        return containers[0]
    return encode_container(np.unique(np.concatenate([decode_container(c) for c in containers])))


def normal_line(line: Column) -> Column:
    """Lower case, inner white space single, outer white space gone."""
    return F.lower(F.trim(F.regexp_replace(line, r"(?U)[\s\x1c-\x1f]+", " ")))


@F.pandas_udf(BinaryType())
def _encode(values: pd.Series) -> pd.Series:
    return values.map(lambda v: encode_container(np.unique(np.asarray(v, np.int64))))


@F.pandas_udf(BinaryType())
def _unite(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unite(list(v)))


@F.pandas_udf(IntegerType())
def _cardinality(values: pd.Series) -> pd.Series:
    return values.map(lambda v: len(decode_container(v))).astype("int32")


@F.pandas_udf(ArrayType(IntegerType()))
def _decode(values: pd.Series) -> pd.Series:
    return values.map(lambda v: decode_container(v).astype(np.int32))


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """Candidate lines by their hashes: ``doc, line_no, h, k, v``; h and k together are the line's, v the raw line's."""
    each = docs.select("doc", F.posexplode(F.split("text", "\n")).alias("at", "raw")).where(F.length("raw") >= min_chars)
    line = each.select("doc", (F.col("at") + 1).alias("line_no"), F.xxhash64("raw").alias("v"), normal_line(F.col("raw")).alias("line")).where(F.length("line") >= min_chars)
    return line.select("doc", "line_no", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("k"), "v")


def _often(lines: DataFrame, min_docs: int) -> DataFrame:
    """The lines of at least min_docs rows, and others that share a bit with them, as fewer can't pass the threshold."""
    counts = stage(lines.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("h"), "line-counts")
    n = counts.count()
    bits = 1 << max(16, (16 * n).bit_length())
    if bits > MOST_BITS:
        return lines.join(counts, "h", "left_semi")
    at = F.pmod(F.col("h"), F.lit(bits))
    held = np.zeros(bits // 8, np.uint8)
    pieces = counts.select((at + 1).alias("b")).groupBy(F.bitmap_bucket_number("b").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits"))
    for r in pieces.collect():  # 4 KB each, at most 8 MB together
        held[(r.bucket - 1) * 4096 : (r.bucket - 1) * 4096 + 4096] = np.frombuffer(bytes(r.bits), np.uint8)[: bits // 8]
    byte = F.conv(F.hex(F.substring(F.lit(held.tobytes()), F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return lines.where(F.pmod(F.floor(byte / F.pow(F.lit(2), at.bitwiseAND(F.lit(7)))), F.lit(2)) == 1)


def line_bitmaps(docs: DataFrame, sources: DataFrame, min_docs: int, share: float, min_chars: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(occurrences ``doc, line_no, h, k`` of candidate lines, places ``doc, source, container, low``, bitmaps ``source, h, k, container, bits`` of
    the lines to remove).

    docs: ``doc, text``; sources: one row ``doc, source`` per document.
    """
    # every document's place: the part file it is written to and its number there, in containers
    row = F.monotonically_increasing_id()
    places = stage(
        sources.where(F.col("source").isNotNull()).select("doc", "source", F.shiftright(row, CONTAINER_BITS).alias("container"), row.bitwiseAND(F.lit((1 << CONTAINER_BITS) - 1)).cast("int").alias("low")),
        "line-places",
    )
    # places shrink so much on disk that they look small enough to be sent to all tasks, which they are not
    places = places.hint("merge")
    found = stage(_often(stage(_lines(docs, min_chars), "lines"), min_docs), "line-candidates")
    raw = found.join(places, "doc").groupBy("source", "h", "k", "v", "container").agg(F.collect_set("low").alias("lows")).select("source", "h", "k", "container", _encode("lows").alias("bits"))
    united = raw.groupBy("source", "h", "k", "container").agg(F.collect_list("bits").alias("all")).select("source", "h", "k", "container", _unite("all").alias("bits"))
    united = stage(united.withColumn("n", _cardinality("bits")), "line-bitmaps")
    sizes = places.groupBy("source").agg(F.count(F.lit(1)).alias("size"))
    total = united.groupBy("source", "h", "k").agg(F.sum("n").alias("n_docs")).join(sizes, "source").where((F.col("n_docs") >= min_docs) & (F.col("n_docs") >= F.col("size") * share))
    return found, places, united.join(total.select("source", "h", "k"), ["source", "h", "k"])


def repeated_lines(docs: DataFrame, sources: DataFrame, min_docs: int = 10, share: float = 0.001, min_chars: int = 25) -> DataFrame:
    """Every line to remove: ``doc, line_no`` (1-based, of the text cut at line feeds)."""
    found, places, bitmaps = line_bitmaps(docs, sources, min_docs, share, min_chars)
    bits = bitmaps.select("h", "k", "container", F.explode(_decode("bits")).alias("low"))
    doomed = bits.join(places.select("doc", "container", "low").hint("merge"), ["container", "low"]).select("doc", "h", "k")
    return found.join(doomed, ["doc", "h", "k"]).select("doc", "line_no").distinct()


def remove_lines(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """``doc, text`` without the given lines; documents that lose none are unchanged."""
    drop = lines.groupBy("doc").agg(F.collect_set("line_no").alias("gone"))
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("gone", i + 1))
    return docs.join(drop, "doc", "left").select("doc", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))
