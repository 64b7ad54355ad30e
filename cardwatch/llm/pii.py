"""Personal data: detection behind disguises, with positions in the source text."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

KINDS = ("email", "ip", "card", "phone")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")

#: Letters of other scripts that look like these; fixed values.
HOMOGLYPHS = {
    "а": "a", "в": "B", "е": "e", "к": "k", "м": "M", "н": "H", "о": "o", "р": "p", "с": "c",
    "т": "T", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q",
    "ԝ": "w", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "α": "a", "ο": "o",
    "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ε": "e", "Α": "A",
    "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "ɡ": "g", "ℓ": "l", "․": ".", "。": ".",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹫": "@",
}
#: Digits and letters that Unicode has in several rows of their own.
HOMOGLYPHS |= {chr(0xFEE0 + c): chr(c) for c in range(0x21, 0x7F)}
for _zero in (0x660, 0x6F0, 0x966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6):
    HOMOGLYPHS |= {chr(_zero + d): str(d) for d in range(10)}
INVISIBLE = "­​‌‍⁠﻿"
ODD = re.compile("[" + re.escape("".join(HOMOGLYPHS) + INVISIBLE) + "]")

#: Spoken digits; fixed values.
DIGIT_WORDS = {
    word: str(d)
    for words in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for d, word in enumerate(words.split())
}
_WORD = r"(?<!\w)(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + r")(?!\w)"
SPOKEN = re.compile(_WORD, re.I)
#: Fewer than three spoken digits in a row are ordinary words.
SPOKEN_RUN = re.compile(_WORD + r"(?:[\s,-]{1,3}" + _WORD + r"){2,}", re.I)
PLUS = re.compile(r"(?<!\w)plus\s+(?=[0-9])", re.I)
COMMA = re.compile(r"(?<=[0-9])\s*,\s*(?=[0-9])")
OPEN, CLOSE = r"\s*[\[({<]\s*", r"\s*[\])}>]\s*"
AT = re.compile(OPEN + r"(?:at|@|arroba|arobase)" + CLOSE, re.I)
DOT = re.compile(OPEN + r"(?:dot|\.|punkt|punto|point)" + CLOSE, re.I)
PLAIN_AT = re.compile(r"(?<=[A-Za-z0-9])\s+at\s+(?=[A-Za-z0-9-]+\s+dot\s+[A-Za-z0-9])", re.I)
PLAIN_DOT = re.compile(r"(?<=[A-Za-z0-9])\s+dot\s+(?=[A-Za-z0-9])", re.I)
#: What finds a match where AT and DOT do, without their quantified ends.
AT_CORE = re.compile(r"[\[({<]\s*(?:at|@|arroba|arobase)\s*[\])}>]", re.I)
DOT_CORE = re.compile(r"[\[({<]\s*(?:dot|\.|punkt|punto|point)\s*[\])}>]", re.I)
ODD_CHARS = frozenset(HOMOGLYPHS) | frozenset(INVISIBLE)
#: Letters that match s, i and k without case, but have another lower case.
FOLDED = frozenset("ſİ\u212a")
WORDS = re.compile(r"\w+")

#: The mark of a spoken digit on a tape.
SPOKEN_MARK = 2

Span = tuple[str, int, int]


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ backwards, which keeps long words linear."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            done = domain.end()
            yield start, done
        else:
            done = max(done, at + 1)
        at = text.find("@", done)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def detect(text: str) -> list[Span]:
    """All identifiers as written, by kind and start; per kind they don't overlap."""
    found = [("email", a, b) for a, b in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            parts = [p.lstrip("0") for p in m[0].split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                found.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            if m.end() - m.start() < 38 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                found.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(_digits(m[0])) <= 15:
                    found.append(("phone", *m.span()))
    return found


@dataclass
class Tape:
    """A text and, for each of its characters, the source span that it stands for.

    A transducer rewrites matches of a pattern; what it writes stands for the match's
    whole source span, so positions survive any number of them.
    """

    text: str
    starts: list[int]
    ends: list[int]
    changed: list[int]

    @classmethod
    def of(cls, text: str) -> Tape:
        return cls(text, list(range(len(text))), list(range(1, len(text) + 1)), [0] * len(text))

    def rewrite(self, pattern: re.Pattern, write, mark: int = 1) -> None:
        """write: the text for a match; empty removes it and marks its neighbours.

        What is written has `mark` in `changed`.
        """
        parts, starts, ends, changed, done = [], [], [], [], 0
        gaps = []
        for m in pattern.finditer(self.text):
            a, b = m.span()
            new = write(m)
            if new == m[0]:
                continue
            parts += [self.text[done:a], new]
            starts += self.starts[done:a] + [self.starts[a]] * len(new)
            ends += self.ends[done:a] + [self.ends[b - 1]] * len(new)
            changed += self.changed[done:a] + [mark] * len(new)
            done = b
            if not new:
                gaps += [len(changed) - 1, len(changed)]
        if done:
            self.text = "".join([*parts, self.text[done:]])
            self.starts = starts + self.starts[done:]
            self.ends = ends + self.ends[done:]
            self.changed = changed + self.changed[done:]
            for k in gaps:
                if 0 <= k < len(self.changed):
                    self.changed[k] = 1


def _spoken(text: str):
    """Writes the digit of a word that stands in a run, and other words as they are."""
    runs = [m.span() for m in SPOKEN_RUN.finditer(text)]
    starts = [a for a, _ in runs]

    def write(m: re.Match) -> str:
        k = bisect_right(starts, m.start()) - 1
        # Capitals that match without case but have another lower case: long s, dotted I.
        word = m[0].replace("İ", "i").casefold()
        return DIGIT_WORDS[word] if k >= 0 and m.end() <= runs[k][1] else m[0]

    return write


def _between_spoken(changed: list[int]):
    """Writes a space for a comma that has a spoken digit on one side at least."""

    def write(m: re.Match) -> str:
        sides = changed[m.start() - 1], changed[m.end()]
        return " " if SPOKEN_MARK in sides else m[0]

    return write


def plain(text: str) -> Tape:
    """The text without disguises."""
    tape = Tape.of(text)
    tape.rewrite(ODD, lambda m: HOMOGLYPHS.get(m[0], ""))
    tape.rewrite(SPOKEN, _spoken(tape.text), mark=SPOKEN_MARK)
    tape.rewrite(PLUS, lambda m: "+")
    # Lists of numbers keep their commas; only digits that were spoken are put together.
    tape.rewrite(COMMA, _between_spoken(tape.changed))
    tape.rewrite(AT, lambda m: "@")
    tape.rewrite(PLAIN_AT, lambda m: "@")
    tape.rewrite(DOT, lambda m: ".")
    tape.rewrite(PLAIN_DOT, lambda m: ".")
    return tape


def disguised(text: str) -> bool:
    """Whether any transducer changes the text: each one's pattern, searched in it.

    The first that changes it sees it as it is written, so no other text has to be tried.
    A pattern is spared only where a word that all its matches hold is missing.
    """
    chars = frozenset(text)
    if not chars.isdisjoint(ODD_CHARS):
        return True
    low, folded = text.lower(), not chars.isdisjoint(FOLDED)
    if (folded or "plus" in low) and PLUS.search(text):
        return True
    if "dot" in low and (PLAIN_DOT.search(text) or PLAIN_AT.search(text)):
        return True
    if not chars.isdisjoint("[({<") and (AT_CORE.search(text) or DOT_CORE.search(text)):
        return True
    spoken = folded or not DIGIT_WORDS.keys().isdisjoint(WORDS.findall(low))
    return bool(spoken and SPOKEN_RUN.search(text))


def spans(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, whether written plainly), by kind as listed, then start.

    A disguised identifier counts if a changed character is in it and no plain one of
    its kind covers it; it may overlap a plain one that sees only a part.
    """
    base = detect(text)
    found = [(*s, True) for s in base]
    if disguised(text):
        tape = plain(text)
        changed = [k for k, c in enumerate(tape.changed) if c]
        for kind, a, b in detect(tape.text) if changed else ():
            k = bisect_left(changed, a)
            if k == len(changed) or changed[k] >= b:
                continue
            start, end = tape.starts[a], tape.ends[b - 1]
            if not any(x == kind and p <= start and end <= q for x, p, q in base):
                found.append((kind, start, end, False))
    return sorted(found, key=lambda s: (KINDS.index(s[0]), s[1:3], not s[3]))


SPANS = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
)
SPANS_DDL = "array<struct<kind: string, start: bigint, end: bigint, base: boolean>>"


def with_spans(docs: DataFrame, *, text_col: str = "text", out: str = "pii") -> DataFrame:
    """Appends the spans of personal data; a column named `out` is replaced.

    Positions are code points of the source, end exclusive; `base` marks identifiers as
    written, others were found behind homoglyphs, invisible characters, spoken digits or
    written-out at and dot signs. Overlapping spans of different kinds all stand.

    Null and empty text: no spans. Very long texts are read whole, in linear time. Ties and
    repeated rows: each by itself. Empty table: no rows.
    """

    @F.arrow_udf(SPANS_DDL)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = ("kind", "start", "end", "base")
        for texts in batches:
            found = (spans(t.as_py() or "") for t in texts)
            yield pa.array([[dict(zip(names, s, strict=True)) for s in x] for x in found], SPANS)

    return docs.drop(out).withColumn(out, run(F.col(text_col).cast("string")))


def spans_text(out: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(out, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact_text(text: str) -> str:
    """Each run of overlapping spans becomes the mark of its first kind."""
    found = sorted((a, -b, kind) for kind, a, b, _ in spans(text))
    parts, done = [], 0
    for a, end, kind in found:
        if a >= done:
            parts += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, -end)
    return "".join([*parts, text[done:]])


def redact(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The same rows and columns with every span replaced by a mark. Null text stays."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            clean = (t.as_py() for t in texts)
            yield pa.array([None if t is None else redact_text(t) for t in clean], pa.string())

    return docs.withColumn(text_col, run(F.col(text_col).cast("string")))
