"""Personal data in plain and in disguised form, as spans of source characters.

Plain identifiers are found in the text itself (the base spans). Disguised ones are found by three transducers that rewrite the
text and keep, for every piece of their output, where it came from:

1. ``fold``: characters that are compatible with one ASCII character (full-width, mathematical, circled and the like), look-alikes of other scripts
   and their digits become ASCII, and invisible characters vanish;
2. ``spell``: runs of spelled-out numbers, alone or among digits, become digits, ``dot`` between them a full stop; counting is left alone;
3. ``unmask``: ``[at]``, ``(dot)``, `` at `` and `` dot `` become the characters they stand for, and spaces beside an ``@`` and the dots behind it go, where
   an address can stand around them.

The detectors of the base spans then read the rewritten text, and what they find is mapped back through the transducers.
A found span is added if it contains something rewritten and does not lie in a base span of its kind.
Documents in which nothing is rewritten cost one search for triggers.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm.endings import ENDINGS
from wayfare.llm.tables import map_column, prefixed, text_of, unused

KINDS = ("email", "ip", "card", "phone")
ADDED = ["spans"]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
# Starting inside a run of digits never helps: what follows the run decides. So only its start is tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_CARD_SIZE = re.compile(r"[0-9](?:[\x20-]?[0-9]){15}")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * d, 10)) for d in values[1::2])) % 10 == 0


def emails(text: str) -> list[Span]:
    """From each ``@`` outwards, which finds what a search from the left finds without trying every start."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text, start - 1):
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            found.append(("email", start, match.end()))
        free = match.end() if match else at + 1
        at = text.find("@", free)
    return found


def plain_spans(text: str) -> list[Span]:
    """Base spans by kind, then start. A match that fails its kind's test is dropped and the search goes on behind it."""
    found = emails(text)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:] if p.lstrip("0") else "0") <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    if _CARD_SIZE.search(text):
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


class Tape:
    """A rewritten text whose pieces know their source. Pieces are copies, or replacements of a source range."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        """``edits``: source start and end, and what to put there; in order and not overlapping."""
        out, self.starts, self.pieces, at, size = [], [], [], 0, 0
        for start, end, new in [*edits, (len(text), len(text), "")]:
            if start > at:
                self.starts.append(size)
                self.pieces.append((at, start, True))
                out.append(text[at:start])
                size += start - at
            if new:
                self.starts.append(size)
                self.pieces.append((start, end, False))
                out.append(new)
                size += len(new)
            at = end
        self.text = "".join(out)

    def back(self, start: int, end: int) -> tuple[int, int]:
        """Source range of the rewritten range."""
        first, last = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        a, _, copied = self.pieces[first]
        begin = a + (start - self.starts[first] if copied else 0)
        a, b, copied = self.pieces[last]
        return begin, (a + end - self.starts[last] if copied else b)


# Letters of other scripts that look like ASCII letters, and those letters (Cyrillic, Greek, Armenian, Latin).
LOOKALIKES = dict(zip(
    "АВЕКМНОРСТУХЅІЈаеорсухіјѕԁһԛԝҽүӏгΑΒΕΖΗΙΚΜΝΟΡΤΥΧανιορυγօոսհցɡɑıⅼ",
    "ABEKMHOPCTYXSIJaeopcyxijsdhqweylrABEZHIKMNOPTYXaviopuyonuhggail",
))
# Digits in words, from zero to nine.
DIGIT_WORDS = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
# Characters without width.
INVISIBLE = "­​‌‍⁠﻿"


def _folds() -> dict[str, str]:
    """By rule every character whose compatibility form is one visible ASCII character, and decimal digits of other scripts; then look-alikes."""
    table = {}
    for c in map(chr, range(0x80, 0x1FBFA)):
        plain = unicodedata.normalize("NFKC", c)
        if len(plain) == 1 and "!" <= plain <= "~":
            table[c] = plain
        elif unicodedata.category(c) == "Nd":
            table[c] = str(unicodedata.digit(c))
    return table | LOOKALIKES


_FOLDS = _folds()
_FOLDED = frozenset(_FOLDS) | frozenset(INVISIBLE)
# A superset of what is folded, quick to search for: all from U+0300 on, and the keys below.
_MAY_FOLD = re.compile(f"[{''.join(re.escape(c) for c in sorted(_FOLDED) if c < chr(0x300))}\u0300-\U0010ffff]")
# From ten to nineteen, the tens from twenty, and how often a word in front says a digit stands in all.
TEENS = "ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen"
TENS = "twenty thirty forty fifty sixty seventy eighty ninety"
TIMES = {"double": 2, "triple": 3, "treble": 3}
_VALUES = {w: str(i) for line in DIGIT_WORDS for i, w in enumerate(line.split())} | {"oh": "0"}
_VALUES |= {w: str(i) for i, w in enumerate(TEENS.split(), 10)} | {w: str(10 * i) for i, w in enumerate(TENS.split(), 2)} | dict.fromkeys(TIMES, "")
_WORDS = "|".join(sorted(_VALUES, key=len, reverse=True))


def _branching(words: list[str]) -> str:
    """A pattern of the words that branches letter by letter, so that a search seldom tries more than a few of them."""
    heads = sorted({w[0] for w in words if w})
    branches = [re.escape(h) + _branching([w[1:] for w in words if w[:1] == h]) for h in heads]
    if not branches:
        return ""
    return f"(?:{'|'.join(branches)})" + "?" * ("" in words)


_ANY_WORD = _branching(list(_VALUES))
_SPELLED_TRIGGER = re.compile(rf"\b{_ANY_WORD}(?:[\s,-]{{1,3}}(?:{_ANY_WORD}|[0-9]{{1,4}}|dot|point|punkt|punto)){{3}}")
_SPELLED = re.compile(rf"\b(?:plus[\s-]+)?(?:{_WORDS}|[0-9]{{1,4}})(?:[\s,-]{{1,3}}(?:{_WORDS}|[0-9]{{1,4}}|dot|point|punkt|punto)){{3,}}(?!\w)", re.I)
#: Words that a run of spelled and written digits has at least; fewer are words beside a number.
_LEAST_WORDS = 3
_SPELLED_PART = re.compile(r"\w+")
_BRACKETED = re.compile(r"[\[({<]\s{0,3}(?:at|dot|@|\.)\s{0,3}[\])}>]", re.I)
_PLAIN_AT = re.compile(r"at\s{1,3}[a-z0-9-]{1,63}\.[a-z0-9]")  # of lower case; begins with letters, which a search finds quickly
_DOT = r"(?:\s{0,3}[\[({<]\s{0,3}(?:dot|\.)\s{0,3}[\])}>]\s{0,3}|\s{1,3}dot\s{1,3})"
# Written in plain words ("look at this dot on the map") an address must end in a top-level domain. Behind a full stop it is written in one case, as
# in "stay at home.It rained" a sentence begins.
_ANY_ENDING = _branching(ENDINGS)
_WRITTEN_ENDING = rf"(?-i:{_ANY_ENDING}|{_branching([e.upper() for e in ENDINGS])})"
_LABEL = r"[A-Za-z0-9-]{1,63}"
_MASKED_AT = re.compile(
    rf"(?<=[A-Za-z0-9_%+-])(?:\s{{0,3}}[\[({{<]\s{{0,3}}(?:at|@)\s{{0,3}}[\])}}>]\s{{0,3}}(?=[A-Za-z0-9])"
    rf"|\s{{1,3}}at\s{{1,3}}(?={_LABEL}(?:(?:{_DOT}|\.){_LABEL}){{0,126}}?(?:{_DOT}{_ANY_ENDING}|\.{_WRITTEN_ENDING})(?![A-Za-z0-9_-])))",
    re.I,
)
_MASKED_DOT = re.compile(rf"(?<=[A-Za-z0-9_%+-]){_DOT}(?=[A-Za-z0-9])", re.I)


# Spaces beside an @ or the dots behind it. The address ends in a top-level domain, as above.
_SPACED = re.compile(rf"(?<=[A-Za-z0-9_%+-])\s{{0,3}}@\s{{0,3}}(?:{_LABEL}\s{{0,3}}\.\s{{0,3}}){{1,9}}?(?:{_WRITTEN_ENDING})(?![A-Za-z0-9_-]|\s{{0,3}}\.\s{{0,3}}(?:{_WRITTEN_ENDING})(?![A-Za-z0-9_-]))")
_SPACES = re.compile(r"\s+")


def fold(text: str) -> list[tuple[int, int, str]]:
    if text.isascii() or not _MAY_FOLD.search(text) or not (present := _FOLDED.intersection(text)):
        return []
    return [(m.start(), m.end(), _FOLDS.get(m[0], "")) for m in re.finditer(f"[{''.join(map(re.escape, sorted(present)))}]", text)]


def _worth(text: str, start: int, end: int) -> tuple[list[tuple[int, int, str]], list[int]]:
    """What each word of a run stands for (start, end, digits, ``+`` or ``.``), and the amounts said, with tens and ones together."""
    parts = [(m.start(), m.end(), m[0].lower()) for m in _SPELLED_PART.finditer(text, start, end)]
    words, amounts = [], []
    for k, (a, b, word) in enumerate(parts):
        following = _VALUES.get(parts[k + 1][2], "") if k + 1 < len(parts) else ""
        before = parts[k - 1][2] if k else ""
        if word in TIMES:
            value = following * (TIMES[word] - 1) if len(following) == 1 else ""
        elif word.isdigit():
            value = word
        else:
            value = _VALUES.get(word, "+" if word == "plus" else ".")
        if word in TENS.split() and len(following) == 1 and following != "0":
            value = value[0]
        if value.isdigit() and word not in TIMES:
            joined = before in TENS.split() and word not in TENS.split() and len(value) == 1 and value != "0" and not word.isdigit()
            if joined and amounts:
                amounts[-1] += int(value)
            else:
                amounts.append(int(_VALUES.get(word, value)))
        words.append((a, b, value))
    return words, amounts


def _numbers(text: str, start: int, end: int, breaks: tuple[str, ...] = ("\r\n", ",")) -> list[list[tuple[int, int, str]]]:
    """The spelled numbers of a run of words: start, end and value of each word. A run that is no number is tried by lines, then by what commas part."""
    words, amounts = _worth(text, start, end)
    digits = "".join(v for _, _, v in words if v not in "+.")
    dots = sum(v == "." for _, _, v in words)
    right = dots == 3 or not dots and (8 <= len(digits) <= 15 or 16 <= len(digits) <= 19 and luhn(digits))
    if not right:
        for k, marks in enumerate(breaks):
            cuts = [i for i, (a, b) in enumerate(zip(words, words[1:]), 1) if any(c in text[a[1] : b[0]] for c in marks)]
            parts = [words[a:b] for a, b in zip([0, *cuts], [*cuts, len(words)])]
            found = [n for p in parts for n in _numbers(text, p[0][0], p[-1][1], breaks[k + 1 :])] if cuts else []
            if found:
                return found
    if len(digits) < 8 and dots != 3 or len(set(digits)) < 2:
        return []  # too short, or one word over and over
    if {b - a for a, b in zip(amounts, amounts[1:])} in ({1}, {-1}):
        return []  # counting up or down
    return [words] if sum(not text[a].isdigit() for a, _, _ in words) >= _LEAST_WORDS else []


def spell(text: str) -> list[tuple[int, int, str]]:
    """Edits that turn spelled numbers into digits: eight digits or more, or the four parts of a network address."""
    edits = []
    if not _SPELLED_TRIGGER.search(text.lower()):
        return edits
    for run in _SPELLED.finditer(text):
        for words in _numbers(text, *run.span()):
            plain = words[0][2] != "+" and all(v != "." for _, _, v in words)
            for k, (start, end, value) in enumerate(words):
                # a spelled number of that length is one that can be called, or a card
                edits.append((start, end, "+" + value if plain and not k else value))
                if k + 1 < len(words):
                    edits.append((end, words[k + 1][0], ""))
    return edits


def unmask(text: str) -> list[tuple[int, int, str]]:
    small = text.lower()
    edits = []
    if "@" in text:
        edits = [(*gap.span(), "") for m in _SPACED.finditer(text) for gap in _SPACES.finditer(text, *m.span())]
    if "dot" in small or _BRACKETED.search(text) or _PLAIN_AT.search(small):
        edits += [(m.start(), m.end(), "@") for m in _MASKED_AT.finditer(text)]
        edits += [(m.start(), m.end(), ".") for m in _MASKED_DOT.finditer(text)]
    out, free = [], 0
    for start, end, new in sorted(edits):
        if start >= free:
            out.append((start, end, new))
            free = end
    return out


def disguised_spans(text: str, base: list[Span]) -> list[Span]:
    tapes, current = [], text
    for transducer in (fold, spell, unmask):
        if edits := transducer(current):
            tapes.append(Tape(current, edits))
            current = tapes[-1].text
    if not tapes:
        return []
    found = []
    for kind, start, end in plain_spans(current):
        plain = current[start:end]
        for tape in reversed(tapes):
            start, end = tape.back(start, end)
        if text[start:end] != plain and not any(k == kind and s <= start and end <= e for k, s, e in base):
            found.append((kind, start, end))
    return found


def find_spans(text: str) -> list[tuple[str, int, int, bool]]:
    """All spans by kind, then start, each with whether it is a base span."""
    base = plain_spans(text)
    spans = [(*s, True) for s in base] + [(*s, False) for s in disguised_spans(text, base)]
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), *s[1:]))


_SPAN = "array<struct<kind:string,start:int,end:int,base:boolean>>"
_ARROW_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows with ``spans``: kind, start, end (code points, end exclusive) and whether it is a base span; an existing column is replaced.

    A null text counts as empty and has no spans. Texts are read whole, however long, in time that is linear in their length.
    Repeated rows have the same spans. An empty table gives no rows. Other columns pass through unchanged.
    """
    docs = prefixed(docs, ADDED)
    work = unused(docs, "pii_text")

    def spans(texts: pa.Array) -> list[pa.Array]:
        found = [[dict(zip(("kind", "start", "end", "base"), s)) for s in find_spans(t)] for t in texts.to_pylist()]
        return [pa.array(found, _ARROW_SPAN)]

    return map_column(docs.withColumn(work, text_of(text_col)), work, {"spans": _SPAN}, spans)


def op8_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and digest are of the base spans; ``spans`` and ``n_added`` also tell of the disguised ones."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    found = find_pii(docs).drop("text")
    base = F.filter("spans", lambda s: s["base"])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[number(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"),
    )
