"""Personal data in texts, also where it is disguised, with the places it has in the source.

The plain identifiers (mail addresses, IP addresses, card and phone numbers) are found in the
text as it is. For the disguised ones the text passes through a chain of transducers: look-alike
characters, invisible characters, spelled digits, digits written as letters, and the many
ways to write "at" and "dot". Each yields a new text and remembers which source characters
every piece of it came from, so a span found behind the last one is mapped back step by step
to characters of the source. A span counts as disguised only if a rewriting took place
inside it; texts that no transducer changes are read once.

All scans are linear in the text: patterns begin at rare characters or take whole runs at once.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


class Span(NamedTuple):
    kind: str
    start: int
    end: int  # after the last character
    base: bool


# ------------------------------------------------------------------ identifiers in plain text

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, read backwards from each ``@``."""
    free = 0  # where the last match ended
    for found in _DOMAIN.finditer(text):
        start = at = found.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            free = found.end()
            yield start, free


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers of at most 255 joined by points; a longer chain is read four by four."""
    for found in _DOTTED.finditer(text):
        numbers = found.group().split(".")
        at = found.start()
        for i in range(0, len(numbers) - 3, 4):
            four = numbers[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(n.lstrip("0")) <= 3 and int(n.lstrip("0") or 0) <= 255 for n in four):
                yield at, end
            at = end + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    """Runs of 13 to 19 digits, singly divided by spaces or hyphens, that pass Luhn's check."""
    for found in _DIGITS.finditer(text):
        digits = [int(c) for c in found.group() if c not in " -"] if found.end() - found.start() < 40 else []
        if 13 <= len(digits) <= 19:
            doubled = [2 * d - 9 * (d > 4) for d in digits[-2::-2]]
            if (sum(doubled) + sum(digits[-1::-2])) % 10 == 0:
                yield found.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    """A plus sign and 9 to 15 digits with spaces, brackets, points and hyphens between them."""
    for found in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in found.group()) <= 15:
            yield found.span()


_FINDERS: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = dict(zip(KINDS, (emails, addresses, cards, phones), strict=True))

# ------------------------------------------------------------------ transducers


class Rewriting:
    """``text`` after edits (start, end, replacement) to a source, and the way back."""

    def __init__(self, source: str, edits: list[tuple[int, int, str]]):
        pieces, self._at, self._from = [], [], []
        done = length = 0
        for start, end, new in sorted(edits):
            if start < done:
                continue  # inside an earlier edit
            for piece, a, b in ((source[done:start], done, None), (new, start, end)):
                if piece:
                    self._at.append(length)
                    self._from.append((a, b))
                    pieces.append(piece)
                    length += len(piece)
            done = end
        if done < len(source):
            self._at.append(length)
            self._from.append((done, None))
            pieces.append(source[done:])
        self.text = "".join(pieces)

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The source span of a span of ``text``; a replacement stands for all it replaced."""
        i, j = bisect_right(self._at, start) - 1, bisect_right(self._at, end - 1) - 1
        (a, whole), (b, last) = self._from[i], self._from[j]
        first = a if whole is not None else a + start - self._at[i]
        return first, last if last is not None else b + end - self._at[j]


# Letters of other scripts that look like Latin ones, by script.
_LOOKALIKES = dict(
    zip(
        "АВЕКМНОРСТУХІЈЅԚԜаекорсухіјѕԁһԛԝᴀӏɡ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανιρυχ" "·•。‐‑‒–—―−",
        "ABEKMHOPCTYXIJSQWaekopcyxijsdhqwalg" "ABEZHIKMNOPTYXoavipux" "..." "-------",
        strict=True,
    )
)
# Characters that take no place.
_INVISIBLE = re.compile("[­͏᠎​-‏‪-‮⁠-⁤⁦-⁩﻿]+")


def _folded_characters() -> dict[int, str]:
    """Every character that stands for one ASCII character: digits and compatibility forms by Unicode's rules."""
    table = {}
    for code in range(0x80, 0x20000):
        char = chr(code)
        if unicodedata.decomposition(char).startswith(("<super>", "<sub>")):
            continue  # the mark of a note, say, after an address
        plain = str(unicodedata.decimal(char, "")) or unicodedata.normalize("NFKC", char)
        if len(plain) == 1 and 0x20 <= ord(plain) < 0x7F:
            table[code] = plain
    return table | {ord(a): b for a, b in _LOOKALIKES.items()}


_FOLDED = _folded_characters()


# The digits as words, from 0 to 9, by language.
_SPELLED = {
    "en": "zero one two three four five six seven eight nine",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
    "other ways": "oh ein zwo",
}
_DIGIT_OF = {word: str(i) for words in list(_SPELLED.values())[:4] for i, word in enumerate(words.split())}
_DIGIT_OF |= {"oh": "0", "ein": "1", "zwo": "2"}

# Ways to write a point and an at sign, in brackets or between spaces.
_POINT_WORD = r"(?:dot|punkt|point|punto)"
_OPEN, _CLOSE = r"[ \t]{0,2}[\[({<][ \t]{0,2}", r"[ \t]{0,2}[\])}>][ \t]{0,2}"
_BRACKETED_POINT = rf"{_OPEN}(?:{_POINT_WORD}|\.){_CLOSE}"
_SPACED_POINT = rf"[ \t]{{1,2}}{_POINT_WORD}[ \t]{{1,2}}|[_-]{_POINT_WORD}[_-]"
_REFERENCE_POINT = r"&#0*46;|&#[xX]0*2[eE];|&period;"
_POINT = rf"(?:{_BRACKETED_POINT}|{_SPACED_POINT}|{_REFERENCE_POINT})"
_BRACKETED_AT = rf"{_OPEN}(?:at|ät|arroba|arobase|@){_CLOSE}"
_REFERENCE_AT = r"&#0*64;|&#[xX]0*40;|&commat;"
_SPACED_AT = r"[ \t]{1,2}(?:at|arroba|arobase)[ \t]{1,2}|[_-]at[_-]"
_WIDE_AT = r"[ \t]{1,2}@[ \t]{1,2}|[ \t]{1,2}@|@[ \t]{1,2}"

_GAP = r"[ \t\n,-]{1,2}"
_WORD = "|".join(sorted(_DIGIT_OF, key=len, reverse=True))
_NUMBER = rf"(?:(?:{_WORD})\b|[0-9]++)"
_RUN = re.compile(rf"\b(?=[0-9{''.join(sorted({w[0] for w in _DIGIT_OF}))}]){_NUMBER}(?:(?:{_POINT}|{_GAP}){_NUMBER})++", re.I)
_ITEM = re.compile(rf"(?P<word>\b(?:{_WORD})\b)|(?P<number>[0-9]+)|(?P<point>{_POINT})|(?P<gap>{_GAP})", re.I)
_PLUS = re.compile(r"\b(?:plus|más|mas)[ \t]{1,2}$", re.I)


def spelled_digits(text: str) -> Iterator[tuple[int, int, str]]:
    """Digits as words, three at least in a run, and points between numbers, three at least."""
    for run in _RUN.finditer(text):
        if run.group().isdigit():
            continue
        items = [(m.lastgroup, *m.span()) for m in _ITEM.finditer(text, run.start(), run.end())]
        kinds = [kind for kind, _, _ in items]
        if kinds.count("word") < 3 and kinds.count("point") < 3:
            continue
        if kinds[0] == "word" and (sign := _PLUS.search(text[max(0, run.start() - 6) : run.start()])):
            yield run.start() - len(sign.group()), run.start(), "+"
        for i, (kind, start, end) in enumerate(items):
            if kind == "word":
                yield start, end, _DIGIT_OF[text[start:end].lower()]
            elif kind == "point":
                yield start, end, "."
            elif kind == "gap" and kinds[i - 1] == kinds[i + 1] == "word":
                yield start, end, ""


_LETTERED = re.compile(r"(?<![A-Za-z0-9])[0-9OoIl](?:[ ().-]{0,2}[0-9OoIl]){5,}+")


def lettered_digits(text: str) -> Iterator[tuple[int, int, str]]:
    """O and l for 0 and 1, in numbers most of which are digits."""
    for run in _LETTERED.finditer(text):
        found = run.group()
        letters = [i for i, c in enumerate(found) if c in "OoIl"]
        digits = sum(c.isdigit() for c in found)
        if letters and digits >= 2 * len(letters) and not text[run.end() : run.end() + 1].isalpha():
            if digits + len(letters) >= 9 or found.count(".") == 3:
                for i in letters:
                    yield run.start() + i, run.start() + i + 1, "0" if found[i] in "Oo" else "1"


_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?+"
_END = r"(?![A-Za-z0-9])"
_AT = re.compile(
    rf"(?P<sure>{_BRACKETED_AT}|{_REFERENCE_AT})|(?P<wide>{_WIDE_AT})|(?P<word>{_SPACED_AT})|(?P<plain>@)", re.I
)
_ANY_POINT = re.compile(rf"(?P<plain>\.)|{_POINT}", re.I)
_LABELS = re.compile(_LABEL)
_TOP = re.compile(rf"[A-Za-z]{{2,24}}{_END}")
_BEFORE = re.compile(rf"(?P<name>[A-Za-z0-9_%+-]{{1,64}})(?P<point>{_POINT})$", re.I)
#: What divides a span from the text beside it, and what joins them nevertheless.
_DIVIDED = re.compile(r"[\s·•]")
_JOINED = re.compile(rf"{_BRACKETED_POINT}|{_REFERENCE_POINT}", re.I)
_BEFORE_PLAIN = re.compile(rf"(?P<name>[A-Za-z0-9_%+-]{{1,64}})(?P<point>{_BRACKETED_POINT}|{_REFERENCE_POINT})$", re.I)
_USER = re.compile(r"[A-Za-z0-9%+-]+[._][A-Za-z0-9._%+-]*$|[A-Za-z]+[0-9]+$")


def disguised_addresses(text: str) -> Iterator[tuple[int, int, str]]:
    """At signs and points of addresses that are written in other ways.

    An at sign in brackets or as a reference counts with any domain. The bare word needs
    a disguised point in the domain as well, or a user name that is no plain word.
    """
    for at in _AT.finditer(text):
        if at.start() == 0 or text[at.start() - 1] not in _LOCAL:
            continue
        points, end, label = [], at.end(), _LABELS.match(text, at.end())
        top = False
        while label:
            end = label.end()
            point = _ANY_POINT.match(text, end)
            follows = point and _LABELS.match(text, point.end())
            if not follows or not (point["plain"] or _TOP.match(text, point.end()) or _ANY_POINT.match(text, follows.end())):
                break
            points.append(point)
            top = bool(_TOP.match(text, point.end()))
            label = follows
        if not points or not top:
            continue
        disguised = [p for p in points if not p["plain"]]
        before = text[max(0, at.start() - 66) : at.start()]
        name = re.search(r"[A-Za-z0-9._%+-]+$", before)
        if at["word"] and not disguised and not _USER.search(name.group()):
            continue
        if not at["plain"]:
            yield at.start(), at.end(), "@"
        # Points of the name, from right to left. Before a plain at sign a bare word is a word.
        start, point = at.start() - len(name.group()), _BEFORE_PLAIN if at["plain"] else _BEFORE
        while m := point.search(text[max(0, start - 90) : start]):
            offset = max(0, start - 90)
            yield offset + m.start("point"), offset + m.end("point"), "."
            start = offset + m.start("name")
        for p in disguised:
            yield p.start(), p.end(), "."


def invisible(text: str) -> Iterator[tuple[int, int, str]]:
    """Characters that take no place."""
    for found in _INVISIBLE.finditer(text):
        yield *found.span(), ""


_RULES = (invisible, spelled_digits, lettered_digits, disguised_addresses)


def normalised(text: str) -> tuple[str, list[Rewriting]]:
    """The text behind all transducers, and the steps to go back through."""
    if not text.isascii():
        text = text.translate(_FOLDED)  # one character for one: no place changes
    steps = []
    for rule in _RULES:
        if (rule is not invisible or not text.isascii()) and (edits := list(rule(text))):
            steps.append(Rewriting(text, edits))
            text = steps[-1].text
    return text, steps


def _class(codes: list[int]) -> str:
    """The codes as a class of characters, in a form that Arrow's patterns read as well."""
    parts, first = [], None
    for code, after in zip(codes, [*codes[1:], 0], strict=True):
        first = code if first is None else first
        if after != code + 1:
            parts.append(f"\\x{{{first:x}}}-\\x{{{code:x}}}")
            first = None
    return "[" + "".join(parts) + "]"


_LETTER_OR_DIGIT = "[A-Za-z0-9]"
#: What a text must contain for any transducer to change it.
_SIGNS = (
    _class(sorted(_FOLDED)),
    _class(sorted(c for c in range(0x80, 0x10000) if _INVISIBLE.match(chr(c)))),
    rf"(?i)\b(?:{_WORD})(?:(?:{_POINT}|{_GAP})[0-9]|(?:{_POINT}|{_GAP})(?:{_WORD})\b)|[0-9](?:{_POINT}[0-9]|(?:{_POINT}|{_GAP})(?:{_WORD})\b)",
    r"[0-9][ ().-]{0,2}[OoIl]|[OoIl][ ().-]{0,2}[0-9]",
    rf"(?i)(?:{_BRACKETED_AT}|{_REFERENCE_AT}|{_SPACED_AT}|{_WIDE_AT}){_LETTER_OR_DIGIT}[A-Za-z0-9-]*(?:\.|{_POINT}){_LETTER_OR_DIGIT}"
    rf"|@[A-Za-z0-9.-]+{_POINT}|(?:{_BRACKETED_POINT}|{_REFERENCE_POINT})[A-Za-z0-9._%+-]+@",
)


def may_be_disguised(texts: pa.Array) -> list[bool | None]:
    """Whether a transducer may change each text; Arrow looks for the signs in whole columns at once."""
    found = [pc.match_substring_regex(texts, sign) for sign in _SIGNS]
    return reduce(pc.or_, found).to_pylist()


def _completes(text: str, start: int, end: int, base: Span) -> bool:
    """Whether a span holds a plain one that a disguise has cut short, rather than what happens to stand beside it."""
    beside = [part for part in (text[start : base.start], text[base.end : end]) if part]
    held = start <= base.start and base.end <= end
    return held and bool(beside) and all(not _DIVIDED.search(part) or _JOINED.search(part) for part in beside)


def identifiers(text: str | None, disguised: bool = True) -> list[Span]:
    """Spans of personal data in code points, by kind and place.

    ``disguised=False`` says that ``may_be_disguised`` has found no sign of a disguise.
    """
    if not text:
        return []
    spans = {kind: [Span(kind, a, b, True) for a, b in find(text)] for kind, find in _FINDERS.items()}
    plain, steps = normalised(text) if disguised else (text, [])
    if plain != text:
        for kind, find in _FINDERS.items():
            base, added = spans[kind], []
            starts, ends = [s.start for s in base], [s.end for s in base]
            for a, b in find(plain):
                start, end = a, b
                for step in reversed(steps):
                    start, end = step.back(start, end)
                # Base spans that it overlaps; they do not overlap each other.
                met = base[bisect_right(ends, start) : bisect_left(starts, end)]
                if text[start:end] != plain[a:b] and (not met or len(met) == 1 and _completes(text, start, end, met[0])):
                    added.append(Span(kind, start, end, False))
            spans[kind] = sorted(base + added, key=lambda s: (s.start, s.end))
    return [s for kind in KINDS for s in spans[kind]]


# ------------------------------------------------------------------ tables


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, pii``: the spans of every row, plain ones with ``base`` true.

    A null or empty text has none. Repeated and missing ids are rows of their own;
    other columns are ignored. Texts are searched one at a time, whatever their length.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = may_be_disguised(batch.column(1))
            found = [[s._asdict() for s in identifiers(t.as_py(), sign)] for t, sign in zip(batch.column(1), signs, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _ARROW)], ["doc_id", "pii"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(f"`{text}`").alias("text")).mapInArrow(find, f"doc_id {kind}, pii {SPANS}")


_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def mask_pii(docs: DataFrame, text: str = "text", mask: str = "[{kind}]") -> DataFrame:
    """``docs`` with every identifier replaced by ``mask``; overlapping ones by that of the first. Null stays null."""
    marks = {kind: mask.format(kind=kind) for kind in KINDS}

    @F.pandas_udf("string")
    def masked(texts):
        signs = may_be_disguised(pa.array(texts, pa.string(), from_pandas=True))
        return texts.combine(pd.Series(signs, texts.index, object), lambda t, sign: None if t is None else _masked(t, marks, sign))

    return docs.withColumn(text, masked(F.col(f"`{text}`")))


def _masked(text: str, marks: dict[str, str], sign: bool) -> str:
    edits = [(s.start, s.end, marks[s.kind]) for s in identifiers(text, sign)]
    return Rewriting(text, edits).text if edits else text


def _told(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def _of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def pii_digest(found: DataFrame) -> DataFrame:
    """The columns of the query from those of ``find_pii``: counts and digest of the plain spans, all spans as text."""
    base = F.filter("pii", lambda s: s["base"])
    counts = [F.size(_of_kind(base, kind)).cast("bigint").alias(f"n_{kind}") for kind in KINDS]
    added = (F.size("pii") - F.size(base)).cast("bigint").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(_told(base), 256).alias("base_sha256"), _told(F.col("pii")).alias("spans"), added)
