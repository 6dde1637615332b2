"""Noise in text from scanned pages: words cut at line ends, misread characters, running headers and page numbers.

Words are repaired against the corpus itself. One scan counts all words (counts are added up in each task before they travel) and gives
the places that may be noise. A symmetric-delete index over the counted words joins each word to the much more frequent words that it
equals after leaving out a character or a pair of neighbours on either side; a weighted edit distance with confusion pairs keeps
the candidates that a misreading explains; where a word has several, the counts of the pairs it forms with its neighbours
(bigrams) pick one. A second scan finds the occurrences: a bit array of 16 bits or more for each suspect tells most words apart in the task,
an exact join follows; suspects that would need more than 64 MB of bits are sought in several passes. A cut word is rejoined if the joined word is known better than the compound or if a part is no word of its own.
A header is a line that equals the document's title, give or take misread characters, around a date.

Cases: null and empty texts hold no noise. A number below a line that ends in a colon is a count. Documents without a title have
headers only where a date or capitals throughout set them off. Words of any length count; repairs are words of Latin letters, accented
ones too. Rows that repeat an id give their noise once, but their words count as
they stand. Ties between repairs go to the smaller distance, then the stronger context, the greater count, the lesser word.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ledgerleaf.sources.stages import stage

#: Public knowledge of optical character recognition: what is read for what (fixed values).
CONFUSIONS = [("d", "cl"), ("m", "rn"), ("n", "ri"), ("u", "ii"), ("w", "vv"), ("h", "li"), ("e", "c"), ("h", "b"), ("g", "q"), ("v", "y"), ("l", "1"), ("l", "|"), ("i", "1"), ("i", "|"), ("o", "0"), ("s", "5"), ("b", "6"), ("t", "†"), ("a", "@"), ("g", "9"), ("b", "8"), ("z", "2"), ("e", "€"), ("t", "7"), ("i", "!"), ("l", "!"), ("f", "ſ"), ("k", "lc"), ("a", "ci"), ("y", "v"), ("t", "f"), ("n", "u"), ("u", "n"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("ff", "ﬀ")]
#: Pairs whose misreading gives another common letter pattern weigh more.
WEAK = {("t", "f"), ("n", "u"), ("u", "n"), ("y", "v"), ("a", "ci"), ("k", "lc")}
MONTH = "January|February|March|April|May|June|July|August|September|October|November|December"
DATE = rf"(?:{MONTH}|[A-Z!][\w†@|!]{{2,9}}) [0-9OlI]{{1,2}}, (?:1[5-9]|2[01])[0-9]{{2}}"
#: An exclamation mark is part of a word if a letter follows it, since it is what an i or l was read as.
_MARK = r"(?<!!)!(?=[^\W\d_])"
WORD = re.compile(rf"(?:[\w|†‡@€]+|{_MARK})+")
_UNMARKED = re.compile(r"[\w|†‡@€]+")
CUT = re.compile(rf"(?:(?<=[\w|†‡@€])|(?<=[^\W\d_]!))[-­‐][ \t]*\n\s*(?=((?:[\w|†‡@€]+|{_MARK})+))")
_CHAR = re.compile(r"[\w|†‡@€!]")
_LEFT = re.compile(r"(?:[^\W\d_]|(?<!!)!(?=[^\W\d_]))[\w|†‡@€!]*")
COMPOUND = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)+")
PAGE = re.compile(r"^[ \t]*(?:\d{1,4}|[-–—] ?\d{1,4} ?[-–—]|p{1,2}\. ?\d{1,4}|\[\d{1,4}\]|\(\d{1,4}\)|(?:Page|page|PAGE) \d{1,4}(?: of \d{1,4})?|\d{1,4} ?/ ?\d{1,4}|\d{1,4} of \d{1,4}|[ivxl]{1,7})[ \t]*$", re.M)
HEADER = re.compile(r"^[ \t]*(?:\d{1,4}[ \t]{2,})?[A-Z0-9!](?:[^\n.;:!?]|!(?=[\w|†‡@€])){13,139}[\w†|@)][ \t]*$", re.M)
_SMALL = {"of", "and", "the", "for", "on", "in", "to", "a", "an", "—", "–", "|", "-", "&"}
RATIO = 20
LEAST = 4
FLUSH = 200_000
#: Bits of the arrays that tell suspects: at least, for each word, at most (64 MB).
LEAST_BITS, BITS_A_WORD, MOST_BITS = 1 << 16, 16, 1 << 29
#: Words of more letters are indexed by their ends, as their deletes would be long and many.
LONG = 64
_END = 30


def header_phrase(line: str) -> tuple[str, bool, bool] | None:
    """(title part, whether a date or capitals set it off, whether a page number stands beside it) of a line that may be a header."""
    s = line.strip()
    number = re.match(r"\d{1,4}\s{2,}", s) or re.search(r"\s{2,}\d{1,4}$", s)
    s = re.sub(r"^\d{1,4}\s{2,}|\s{2,}\d{1,4}$", "", s)
    dated = re.sub(rf"\s*[|—–,-]?\s*{DATE}\s*[|—–,-]?\s*", "", s)
    parts = dated.split()
    if not 3 <= len(parts) <= 14 or not all(p in _SMALL or p[0].isupper() or p[0].isdigit() or p[0] in "†|@'!" for p in parts):
        return None
    return dated, dated != s or dated.isupper(), bool(number)


def prepare(text: str) -> tuple[str, list[tuple[str, str]], bool, list[tuple[str, bool, bool]]]:
    """(text with cut words joined across noise lines and headers put last, cuts, whether a page number stands alone, header candidates)."""
    if "\n" not in text:
        return text, [], False, []
    pages, heads, gone, lines = False, [], [], []
    for m in PAGE.finditer(text):
        if m[0].strip() and not text[: m.start()].rstrip().endswith(":"):
            pages = True
            gone.append(m.span())
    for m in HEADER.finditer(text):
        if found := header_phrase(m[0]):
            heads.append(found)
            if found[1]:
                gone.append(m.span())
                lines.append(m[0])
    if gone:
        at, rest = 0, []
        for lo, hi in sorted(gone):
            rest.append(text[at:lo])
            at = max(at, hi)
        text = "".join([*rest, text[at:]])
    cuts: list[tuple[str, str]] = []

    def join(left: str, right: str) -> str:
        cuts.append((_plain(left), _plain(right)))
        return ""

    text = _at_cuts(text, join)
    return "\n".join([text, *lines]), cuts, pages, heads


def _at_cuts(text: str, replace: Callable[[str, str], str]) -> str:
    """text with the mark and line end of every cut replaced; the mark is sought first, as it is rarer than words are."""

    def at(m: re.Match) -> str:
        lo = m.start()
        while lo and _CHAR.match(text, lo - 1, lo):
            lo -= 1
        left = _LEFT.search(text, lo, m.start())
        return replace(left[0], m[1]) if left else m[0]

    return CUT.sub(at, text)


def _plain(word: str) -> str:
    """Lower case; a capital I after a small letter is kept apart, since it is an l misread."""
    return re.sub(r"(?<=[a-z])I", "|", word).lower()


def compounds(text: str) -> list[str]:
    """Hyphenated words; none holds white space, so only pieces with a hyphen are searched."""
    return [c for piece in text.split() if "-" in piece for c in COMPOUND.findall(piece)]


def tokens(text: str) -> list[str]:
    if "I" in text:
        text = re.sub(r"(?<=[a-z])I", "|", text)
    return (WORD if "!" in text else _UNMARKED).findall(text.lower())


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter = Counter()

    def flush() -> pd.DataFrame:
        keep = [(w, n) for w, n in counts.items() if len(w) > 1 and not w.isdigit()]
        counts.clear()
        return pd.DataFrame([("w", None, None, w, None, n) for w, n in keep], columns=["kind", "doc", "owner", "a", "b", "n"], dtype=object)

    for batch in batches:
        rows = []
        for doc, owner, text in zip(batch["doc"], batch["owner"], batch["text"]):
            text, cuts, pages, heads = prepare(text)
            counts.update(tokens(text))
            if "-" in text:
                counts.update(compounds(text.lower()))
            if pages:
                rows.append(("p", doc, None, None, None, 1))
            for a, b in cuts:
                rows.append(("h", doc, None, a, b, 1))
            for phrase, strong, number in heads:
                rows.append(("t", doc, owner, phrase, None, strong + 2 * number))
        if rows:
            yield pd.DataFrame(rows, columns=["kind", "doc", "owner", "a", "b", "n"], dtype=object)
        if len(counts) > FLUSH:
            yield flush()
    yield flush()


def scan(docs: DataFrame) -> DataFrame:
    """``kind, doc, owner, a, b, n``: word counts (w), page numbers (p), cuts (h) and header candidates (t). docs: ``doc, owner, text``."""
    return stage(docs.select("doc", "owner", "text").where(F.length("text") > 0).mapInPandas(_scan, "kind string, doc string, owner string, a string, b string, n long"), "scan")


def confusion_cost(right: str, read: str) -> float:
    """Weighted edit distance of a right word and what was read: 0.4 for a confusion, 0.8 for a weak one, 1 for any other edit."""
    m, n = len(right), len(read)
    best = np.full((m + 1, n + 1), np.inf)
    best[0, 0] = 0
    for i in range(m + 1):
        for j in range(n + 1):
            v = best[i, j]
            if v == np.inf:
                continue
            if i < m and j < n:
                best[i + 1, j + 1] = min(best[i + 1, j + 1], v + (right[i] != read[j]))
            if i < m:
                best[i + 1, j] = min(best[i + 1, j], v + 1)
            if j < n:
                best[i, j + 1] = min(best[i, j + 1], v + 1)
            for a, b in CONFUSIONS:
                for x, y in ((a, b), (b, a)) if len(b) == 2 else ((a, b),):
                    if right.startswith(x, i) and read.startswith(y, j):
                        c = 0.8 if (a, b) in WEAK else 0.4
                        best[i + len(x), j + len(y)] = min(best[i + len(x), j + len(y)], v + c)
    return float(best[m, n])


def one_confusion_cost(right: str, read: str) -> float:
    """``confusion_cost`` where it is that of one confusion; words that differ over more than a few characters cost infinity unread."""
    if max(len(right), len(read)) > LONG:
        most = min(len(right), len(read))
        lo = len(os.path.commonprefix([right, read]))
        hi = min(most - lo, len(os.path.commonprefix([right[::-1], read[::-1]])))
        lo, hi = max(0, lo - 2), max(0, hi - 2)  # what stands beside the difference may belong to a pair
        right, read = right[lo : len(right) - hi], read[lo : len(read) - hi]
        if max(len(right), len(read)) > 12:
            return float("inf")
    return confusion_cost(right, read)


@F.pandas_udf(DoubleType())
def _cost(right: pd.Series, read: pd.Series) -> pd.Series:
    return pd.Series([one_confusion_cost(a, b) for a, b in zip(right, read)], dtype="float64")


def keys(word: Column) -> Column:
    """What two words have in common that one confusion makes of each other: their deletes, or one end of long words.

    A confusion changes two neighbouring characters at most, so of the 30 first and the 30 last of a word of 64 either stay. Words of 64
    and 65 letters have keys of both kinds, since a confusion may lead from one to the other.
    """
    n = F.length(word)
    ends = F.array(F.concat(F.lit("<"), F.substring(word, 1, _END)), F.concat(F.lit(">"), F.substring(word, -_END, _END)))
    return F.when(n < LONG, deletes(word)).when(n > LONG + 1, ends).otherwise(F.concat(deletes(word), ends))


def deletes(word: Column) -> Column:
    """The word, the word without one character and without one pair of neighbours."""
    n = F.length(word)
    one = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n)))
    two = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 2, n)))
    return F.array_distinct(F.concat(F.array(word), one, two))


def lexicon(scanned: DataFrame) -> DataFrame:
    """``word, n`` over all texts."""
    return stage(scanned.where("kind = 'w'").groupBy(F.col("a").alias("word")).agg(F.sum("n").alias("n")), "lexicon")


def candidates(words: DataFrame) -> DataFrame:
    """``word, repair, cost, n_repair`` of the words that a misreading of a word at least 20 times as frequent explains."""
    fit = words.where((F.length("word") >= LEAST - 1) & ~F.col("word").contains("-") & ~F.col("word").contains("_"))
    # a misread word is in letters of a script whose confusions are listed, with at most a third of other signs
    letters = F.length(F.regexp_replace("word", r"\P{IsLatin}", ""))
    read = fit.where((letters * 3 >= F.length("word") * 2) & (F.length("word") >= LEAST)).select(F.col("word").alias("w"), F.col("n").alias("m"))
    right = fit.where((F.col("n") >= RATIO) & F.col("word").rlike("^[\\p{IsLatin}&&[^ſﬀ-ﬆ]]+$")).select("word", "n")
    # the length is part of the key, given by the fewer right words for all lengths that a confusion may lead to
    x = read.select("w", "m", F.length("w").alias("size"), F.explode(keys(F.col("w"))).alias("key"))
    size = F.explode(F.array(*(F.length("word") + d for d in (-1, 0, 1))))
    y = right.select("word", "n", F.explode(keys(F.col("word"))).alias("key")).select("word", "n", "key", size.alias("size"))
    pairs = x.join(y, ["key", "size"]).where((F.col("n") >= F.col("m") * RATIO) & (F.col("w") != F.col("word"))).select("w", "word", "n").distinct()
    costs = pairs.select(F.col("w").alias("word"), F.col("word").alias("repair"), _cost("word", "w").alias("cost"), F.col("n").alias("n_repair"))
    return stage(costs.where(F.col("cost") <= 0.5), "repairs")


def n_bits(n_words: int) -> int:
    """Bits of an array for so many words: a power of two, 16 for each word or more."""
    return max(LEAST_BITS, 1 << (BITS_A_WORD * n_words).bit_length())


def bloom(words: DataFrame, size: int) -> np.ndarray:
    """``size`` bits, set for the given words; gathered in pieces of 4 KB that are united before they travel."""
    each = words.select((F.pmod(F.xxhash64("word"), F.lit(size)) + 1).alias("h"))
    rows = each.groupBy(F.bitmap_bucket_number("h").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits")).toLocalIterator()
    out = np.zeros(size // 8, np.uint8)
    for r in rows:
        out[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


class _Known(dict):
    """Whether a word's bit is set; kept while there are not too many words."""

    def __init__(self, bits: np.ndarray):
        super().__init__()
        self.bits = bits

    def __missing__(self, word: str) -> bool:
        if len(self) > FLUSH:
            self.clear()
        h = xxhash.xxh64_intdigest(word.encode(), 42) % (8 * len(self.bits))  # Spark's xxhash64; the number of bits divides 2**64, so its sign is of no account
        found = self[word] = bool(self.bits[h >> 3] >> (h & 7) & 1)
        return found


def occurrences(docs: DataFrame, suspects: DataFrame, unsure: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``doc, word, before, after`` of words that may be suspects, ``a, b, n`` of pairs in which a word may be unsure's).

    suspects and unsure: ``word``; both are told by bit arrays, so exact joins must follow. What needs more bits than an array may have is
    dealt to several by hash, with a pass over the texts for each.
    """
    spark = docs.sparkSession
    sizes = [n_bits(w.count()) for w in (suspects, unsure)]
    passes = max(1, *(-(-n // MOST_BITS) for n in sizes))
    part = F.pmod(F.hash("word"), F.lit(passes))
    found = pairs = None
    for k in range(passes):
        arrays = tuple(bloom(w.where(part == k), min(n, MOST_BITS)) for w, n in zip((suspects, unsure), sizes))
        out = _pass(docs, spark.sparkContext.broadcast(arrays))
        one = out.where("doc is not null").select("doc", "word", F.col("a").alias("before"), F.col("b").alias("after"))
        two = out.where("doc is null").groupBy("a", "b").agg(F.sum("n").alias("n"))
        found, pairs = (one, two) if found is None else (found.unionByName(one), pairs.unionByName(two))
    # a pair may be met in two passes, once for each of its words; each time it was counted whole
    return found.distinct(), pairs.groupBy("a", "b").agg(F.max("n").alias("n"))


def _pass(docs: DataFrame, bits) -> DataFrame:
    """``doc, word, a, b, n``: words whose bit is set with their neighbours, and with a null doc the counts of pairs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, open_ = (_Known(b) for b in bits.value)
        pairs: Counter = Counter()

        def flush() -> pd.DataFrame:
            out = pd.DataFrame([(None, None, a, b, n) for (a, b), n in pairs.items()], columns=["doc", "word", "a", "b", "n"], dtype=object)
            pairs.clear()
            return out

        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc"], batch["text"]):
                w = tokens(prepare(text)[0])
                distinct = set(w)
                if any(map(known.__getitem__, distinct)):
                    for i, x in enumerate(w):
                        if known[x]:
                            rows.append((doc, x, w[i - 1] if i else "", w[i + 1] if i + 1 < len(w) else "", 1))
                if any(map(open_.__getitem__, distinct)):
                    pairs.update((a, b) for a, b in zip(w, w[1:]) if open_[a] or open_[b])
            if rows:
                yield pd.DataFrame(rows, columns=["doc", "word", "a", "b", "n"], dtype=object)
            if len(pairs) > FLUSH:
                yield flush()
        yield flush()

    return stage(docs.select("doc", "text").where(F.length("text") > 0).mapInPandas(run, "doc string, word string, a string, b string, n long"), "occurrences")


def repairs(docs: DataFrame, words: DataFrame) -> DataFrame:
    """``doc, word, before, after, repair, cost`` of every misread word of every text, repaired by distance and context."""
    options = candidates(words)
    several = options.groupBy("word").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > 1)
    unsure = options.join(several, "word", "left_semi").select(F.col("repair").alias("word")).distinct()
    found, pairs = occurrences(docs, options.select("word").distinct(), unsure)
    found = found.join(options, "word")
    left, right = pairs.select(F.col("a").alias("before"), F.col("b").alias("repair"), F.col("n").alias("n_before")), pairs.select(F.col("a").alias("repair"), F.col("b").alias("after"), F.col("n").alias("n_after"))
    scored = found.join(left, ["before", "repair"], "left").join(right, ["repair", "after"], "left")
    context = F.log1p(F.coalesce("n_before", F.lit(0))) + F.log1p(F.coalesce("n_after", F.lit(0)))
    best = F.max_by(F.struct("repair", "cost"), F.struct(-F.round("cost", 3), context, F.col("n_repair"), -F.xxhash64("repair").cast("decimal(38,0)")))
    picked = scored.groupBy("doc", "word", "before", "after").agg(best.alias("x"))
    return picked.select("doc", "word", "before", "after", "x.repair", "x.cost")


def breaks(scanned: DataFrame, words: DataFrame) -> DataFrame:
    """``doc, a, b`` of the cuts that must be rejoined."""
    cuts = scanned.where("kind = 'h'").select("doc", "a", "b")
    kinds = cuts.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_cuts"))
    known = kinds.select("a", "b", "n_cuts", F.concat("a", "b").alias("k_joined"), F.concat("a", F.lit("-"), "b").alias("k_compound"), F.col("a").alias("k_left"), F.col("b").alias("k_right"))
    for name in ("joined", "compound", "left", "right"):
        counts = words.select(F.col("word").alias(f"k_{name}"), F.col("n").alias(f"n_{name}"))
        known = known.join(counts, f"k_{name}", "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)))
    # the scan joins every cut, so each was counted once as a joined word
    elsewhere = F.col("n_joined") - F.col("n_cuts")
    both = (F.col("n_left") >= RATIO) & (F.col("n_right") >= RATIO)
    whole = (elsewhere > F.col("n_compound")) | ((F.col("n_compound") == 0) & ~both)
    return cuts.distinct().join(known.where(whole).select("a", "b"), ["a", "b"])


def headers(scanned: DataFrame, titles: DataFrame) -> DataFrame:
    """``doc, phrase, numbered`` of running headers. titles: ``owner, title``, one row per document, null if it has none."""
    lines = scanned.where("kind = 't'").select("doc", "owner", F.col("a").alias("phrase"), F.col("n").alias("flags")).distinct()
    each = lines.join(titles, "owner", "left")
    near = F.levenshtein(F.upper("phrase"), F.upper("title")) <= F.length("title") / 6
    lone = F.col("title").isNull() & (F.col("flags").bitwiseAND(F.lit(1)) == 1) & F.col("phrase").contains(",")
    return each.where(F.coalesce(near, F.lit(False)) | lone).select("doc", "phrase", (F.col("flags") >= 2).alias("numbered"))


def find_noise(docs: DataFrame, titles: DataFrame) -> DataFrame:
    """``doc, noise``: a row for each kind of noise in each text. docs: ``doc, owner, text``; titles: ``owner, title``."""
    scanned = scan(docs)
    words = lexicon(scanned)
    heads = stage(headers(scanned, titles), "headers")
    kinds = [
        (scanned.where("kind = 'p'").select("doc"), "page_number"),
        (heads.where("numbered").select("doc"), "page_number"),
        (heads.select("doc"), "running_header"),
        (breaks(scanned, words).select("doc"), "hyphen_break"),
        (repairs(docs, words).select("doc"), "char_error"),
    ]
    out = None
    for rows, name in kinds:
        rows = rows.withColumn("noise", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def _case(like: str, word: str) -> str:
    return word.upper() if like.isupper() and len(like) > 1 else word.capitalize() if like[:1].isupper() or not like[:1].isalpha() and like[1:2].isupper() else word


def repair_text(text: str, words: dict[str, str], joins: set[tuple[str, str]], phrases: set[str]) -> str:
    """Continuous paragraphs: noise lines gone, cut words rejoined, misread words replaced, lines of a paragraph joined."""
    gone = []
    for m in PAGE.finditer(text):
        if m[0].strip() and not text[: m.start()].rstrip().endswith(":"):
            gone.append(m.span())
    for m in HEADER.finditer(text):
        if (found := header_phrase(m[0])) and found[0] in phrases:
            gone.append(m.span())
    if gone:
        at, rest = 0, []
        for lo, hi in sorted(gone):
            before = text[at:lo]
            rest.append(before)
            at = max(at, hi)
            # within a sentence the gap closes, else the paragraph break stays
            if re.search(r"[^\s.!?:]\s*\Z", before) and (m := re.match(r"\s*", text[at:])):
                rest[-1] = before.rstrip() + "\n"  # a cut word at its end is rejoined below like any other
                at += m.end()
        text = "".join([*rest, text[at:]])
    text = _at_cuts(text, lambda left, right: "" if (_plain(left), _plain(right)) in joins else "-")
    if words:
        text = WORD.sub(lambda m: _case(m[0], words[k]) if (k := _plain(m[0])) in words else m[0], text)
    return re.sub(r"(?<=\S)[ \t]*\n(?=\S)(?![-*•#|\[{<]|\d+[.)] )", " ", text)


def repair(docs: DataFrame, titles: DataFrame) -> DataFrame:
    """``doc, text, n_repairs`` of every text, repaired. Texts without noise come back as they are."""
    scanned = scan(docs)
    words = lexicon(scanned)
    fixes = repairs(docs, words).groupBy("doc").agg(F.collect_set(F.struct("word", "repair")).alias("words"))
    cuts = breaks(scanned, words).groupBy("doc").agg(F.collect_set(F.struct("a", "b")).alias("joins"))
    heads = headers(scanned, titles).groupBy("doc").agg(F.collect_set("phrase").alias("phrases"))
    pages = scanned.where("kind = 'p'").select("doc", F.lit(True).alias("paged")).distinct()
    todo = fixes.join(cuts, "doc", "full").join(heads, "doc", "full").join(pages, "doc", "full")
    once = docs.groupBy("doc").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text, w, j, p in batch[["doc", "text", "words", "joins", "phrases"]].itertuples(index=False):
                fix = {x["word"]: x["repair"] for x in (w if w is not None else [])}
                cut = {(x["a"], x["b"]) for x in (j if j is not None else [])}
                out.append((doc, repair_text(text, fix, cut, set(p if p is not None else [])), len(fix) + len(cut)))
            yield pd.DataFrame(out, columns=["doc", "text", "n_repairs"])

    have = once.join(todo, "doc").where(F.col("text").isNotNull()).mapInPandas(run, "doc string, text string, n_repairs int")
    return have.unionByName(once.join(todo, "doc", "left_anti").select("doc", "text", F.lit(0).alias("n_repairs")))
