"""Sentence units across languages and scripts, in SQL expressions only.

Marks that end no sentence (decimals, URLs, initials, abbreviations, ellipses that go on, everything inside a quotation) are masked
by private-use placeholders of the same length; terminators of the script at hand then give the ends of units. As placeholders
keep the length, a unit's place in the masked text is its place in the text, and restoring it is taking the substring of the text.

Rules: a blank line always ends a unit, a single line break does not. A quotation with its introduction or its following attribution
is one unit. Scripts without spaces end after 。！？ and closing quotes. Thai, which has no mark, ends at white space between Thai letters
unless a connective follows. Greek uses ``;`` as its question mark, Devanagari the danda, Arabic ؟ and ۔.

Cases: null and blank texts have no units. A text without any mark is one unit per paragraph. Text of any length is used whole. Rows that
repeat an id give their units once. Private-use characters U+E000 to U+E01F of the input are treated as letters. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Placeholders: a masked mark, a masked mark within a quotation, the line feed of a blank line, straight quotes that open and close.
DOT, INNER, BLANK, OPEN, CLOSE, CUT = "", "", "", "", "", ""
_OWN = "-"

#: Abbreviations by what may follow them if they end no sentence (fixed values).
TITLES = "Dr Mr Mrs Ms Prof Gov Sen Rep Gen Hon Col Lt Capt Rev St Mt Messrs Sr Sra Srta Srs Dra Dña MM Hr Hrn Fr Mme Mlle Mgr κ κα κκ Δρ Καθ Αγ".split()
BEFORE_NUMBER = "No Nos no nos Nr Nrn Art Arts art arts al fig figs Fig Figs Sec Secs sec secs vol vols Vol Vols pp p Pp P ch chap eq Eq ed Abs Bd S Kap Ziff n núm num pág págs cap nº σελ αρ τ κεφ Jan Feb Mar Apr Jun Jul Aug Sept Sep Oct Nov Dec vs cca ca c".split()
INSIDE = "Inc Co Corp Ltd Bros Jr Esq al etc approx bn mn tn cf viz resp incl est ex env av bzw usw vgl evtl ggf inkl zzgl sog Mio Tsd UU Ud Uds Βλ βλ λ κλπ κτλ".split()
ALWAYS = "cf vs viz Βλ βλ Mrd bzw vgl EE".split()
MONTHS_DE = "Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Quartals?|Halbjahr(?:es)?|Jahrhundert|Sitzung|Auflage|Kapitel|Absatz"
_NOT_IN_WORD = rf"(?<![\p{{L}}\p{{M}}\p{{N}}{DOT}])"
_QUOTES = f"“”„«»「」『』‹›{OPEN}{CLOSE}{BLANK}"
_MARKS = r".!?…;؟۔।॥。！？；"
_CLOSERS = f"\"”’»›“){CLOSE}\\]」』）】"


def _word(names: list[str]) -> str:
    return _NOT_IN_WORD + "(?:" + "|".join(sorted(names, key=len, reverse=True)) + ")"


def _steps() -> list[tuple[str, str]]:
    """(pattern, replacement) in order; all keep the length."""
    dot = rf"\."
    return [
        # a line feed with a blank line after it; the rest of the white space stays
        (r"\n(?=[^\S\n]*\n)", BLANK),
        # straight quotes that open and close
        (rf'(?<![^\s(\[{BLANK}])"(?=\S)', OPEN),
        (rf'"(?=$|[\s.,;:!?)\]{BLANK}—–-])', CLOSE),
        # dots between letters or digits, before digits
        (rf"(?<=[\p{{L}}\p{{N}}\p{{M}}]){dot}(?=[\p{{L}}\p{{N}}])|{dot}(?=\p{{Nd}})", DOT),
        # ellipses that go on
        (rf"{dot}(?={dot}+\s+\p{{Ll}})|(?<=[.{DOT}]){dot}(?=\s+\p{{Ll}})(?<=[.{DOT}]{{2}}{dot})|…(?!…?\s+\p{{Lu}}|…?\s*$)", DOT),
        # dotted abbreviations (e.g., U.S., π.χ.): before small letters; except for times of day and a final name also before capitals
        (rf"(?<=[\p{{L}}]{DOT}\p{{L}}){dot}(?=\s+[\p{{Ll}}\p{{N}}$€£(])", DOT),
        (rf"(?<={_NOT_IN_WORD}(?:[ei]{DOT}[ge]|π{DOT}χ|δ{DOT}η|[dz]{DOT}[hB]|u{DOT}a)){dot}(?=\s)", DOT),
        (rf"(?<=(?<![Tt]he\s)(?<![\p{{L}}{DOT}])[UE]{DOT}[SKNU]){dot}(?=\s+\p{{Lu}})|(?<=[UE]{DOT}[SKNU]){dot}(?=\s+(?:Treasury|Congress|Government|Senate|House|Department|Federal|President|Supreme|Census)\b)", DOT),
        # spaced ones: z. B., d. h., p. ex., p. m., EE. UU.
        (rf"(?<={_NOT_IN_WORD}[zduiosp]){dot}(?=\s(?:B|h|a|Ä|ä|U|u|ex|m)\.)|(?<={_NOT_IN_WORD}a){dot}(?=\s(?:m|C|de)\b)", DOT),
        (rf"(?<={_NOT_IN_WORD}(?:z{DOT}\s(?:B|T)|[du]{DOT}\s[hauÄä]|p{DOT}\sex|i{DOT}\sd{DOT}\sR)){dot}(?=\s)", DOT),
        (rf"(?<=[pa]{DOT}\sm){dot}(?=\s+[\p{{Ll}}\p{{N}}(])", DOT),
        # initials, Latin, Greek, Cyrillic and Arabic
        (rf"(?<={_NOT_IN_WORD}\p{{Lu}}){dot}(?=\s+\p{{Lu}})|(?<={_NOT_IN_WORD}[ء-ي]){dot}(?=\s)", DOT),
        # Devanagari has its own full stop
        (rf"(?<=[ऀ-ॿ]){dot}(?=\s*[^\s{BLANK}])", DOT),
        # ordinal numbers in dates
        (rf"(?<={_NOT_IN_WORD}\p{{Nd}}{{1,2}}){dot}(?=\s+(?:{MONTHS_DE})\b)", DOT),
        # abbreviations
        (rf"(?<={_word(TITLES)}){dot}(?=\s+\p{{L}})", DOT),
        (rf"(?<={_word(BEFORE_NUMBER)}){dot}(?=\s*(?:\p{{Nd}}|[IVXLC]+\b))", DOT),
        (rf"(?<={_word(INSIDE)}){dot}(?=\s+[\p{{Ll}}\p{{Nd}}($€£,])", DOT),
        (rf"(?<={_word(ALWAYS)}){dot}(?=\s)", DOT),
    ]


def _inner(text: Column, raw: Column) -> Column:
    """Marks within quotations masked: those whose next quotation sign closes. ``raw`` is the text before any masking.

    The text is cut behind every such sign, so that one look at a part's last character decides on all its marks; a look ahead from each
    mark would read a text with few quotations over and over.
    """
    parts = F.split(F.regexp_replace(text, f"[{_QUOTES}]", f"$0{CUT}"), CUT)
    closing = list(f"”»」』›{CLOSE}")
    # the sign that opens an English quotation closes a German one; asked of the raw text, since what a lambda refers to is worked out for every part
    german = F.contains(raw, F.lit("„"))

    def mask(part: Column) -> Column:
        last = F.substring(part, -1, 1)
        return F.when(last.isin(closing) | (german & (last == "“")), F.regexp_replace(part, f"[{_MARKS}]", INNER)).otherwise(part)

    return F.array_join(F.transform(parts, mask), "")


def _ends() -> str:
    """What a unit ends with; the cut goes behind it."""
    after = rf"(?=\s|$|{BLANK})"
    starts = rf"(?=\s+(?:[^\s\p{{Ll}},;:]|\p{{Ll}}[\p{{Ll}}]{{0,3}}-\p{{L}}|\p{{Ll}}+\p{{Lu}}))"
    return "|".join(
        [
            BLANK,
            # marks with closing signs, before white space and something that can begin a unit
            rf"[.!?؟۔।॥…]+[{_CLOSERS}]*(?:{starts}|(?=\s*(?:$|{BLANK})))",
            # scripts without spaces
            rf"[。！？]+[{_CLOSERS}]*",
            # a quotation that ends with its own mark and is not followed by its attribution
            rf"{INNER}+[{_CLOSERS}]+(?:{starts}|(?=\s*(?:$|{BLANK}))|(?<=[”」』])(?=[぀-ヿ㐀-鿿가-힯A-Za-z0-9])(?![とというて他她]|[、，,]))",
            # Thai: white space between letters unless a connective goes on
            r"(?<=[฀-๿])(?=\s+[฀-๿])(?!\s+(?:\S*จึง|แต่|และ|หรือ|ซึ่ง|ที่|โดย|เพราะ|เนื่องจาก|ว่า))",
        ]
    ) + rf"|;{after}(?<=[Ͱ-Ͽ]\s?[\p{{L}}\p{{N}} ,%]{{0,40}};)"


def masked(text: Column) -> Column:
    """text with everything that ends no unit masked; characters stay in place."""
    own = F.regexp_replace(text, f"[{_OWN}]", "")
    return _inner(reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), [("(?U)" + p, r) for p, r in _steps()], own), text)


def _parts(text: Column) -> Column:
    """The pieces of the masked text that end a unit each; they tile it."""
    return F.split(F.regexp_replace(masked(text), "(?U)" + _ends(), f"$0{CUT}"), CUT)


def sentence_units(docs: DataFrame) -> DataFrame:
    """``doc, start_pos, n_chars`` of every unit of ``doc, text``, places 1-based, without outer white space.

    A piece's place is the running sum of the lengths before it, over rows that lie together by ``doc`` already.
    """
    once = docs.where(F.col("doc").isNotNull() & F.col("text").isNotNull()).groupBy("doc").agg(F.min("text").alias("text"))
    pieces = once.select("doc", F.posexplode(_parts(F.col("text"))).alias("nth", "p"))
    sized = pieces.select(
        "doc", "nth", F.length("p").alias("size"), F.length(F.regexp_replace("p", rf"(?U)^[\s{BLANK}]+", "")).alias("rest"), F.length(F.regexp_replace("p", rf"(?U)^[\s{BLANK}]+|[\s{BLANK}]+$", "")).alias("n_chars")
    )
    w = Window.partitionBy("doc").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.select("doc", (F.sum("size").over(w) - F.col("rest") + 1).cast("int").alias("start_pos"), F.col("n_chars").cast("int").alias("n_chars"))
    return placed.where(F.col("n_chars") > 0)
