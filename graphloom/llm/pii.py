"""Personal data in texts, disguised or not, with places in the source text.

Base identifiers are found by the fixed patterns below. For disguised ones a chain of transducers rewrites the text (homoglyphs
to ASCII, spelled digits to digits, bracketed or spelled "at" and "dot" to @ and .) and keeps, for each rewritten piece, where
in its input it stood. The same patterns run over the rewritten text, and their spans are mapped back through the chain to
source characters. Every pattern is applied in time linear in the text.

Spelled words are those of English, French, German and Spanish. "at" before an unmarked "point" counts only where the domain ends
in a "point" and a label of ``POINT_ENDS`` ("at this point in" is no address); French "chez" and German "bei" for "at" aren't taken.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_series, fresh

KINDS = ("email", "ip", "card", "phone")
# The base patterns of the identifiers.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS = (13, 19), (9, 15)

# Characters that look like an ASCII one.
HOMOGLYPHS = str.maketrans(
    {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}  # full-width forms
    | {chr(base + i): str(i) for base in (0x660, 0x6F0, 0x966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for i in range(10)}  # other digits
    | dict(zip("аеорсухіјѕһԁɡ", "aeopcyxijshdg", strict=True))  # Cyrillic and phonetic small letters
    | dict(zip("АВЕКМНОРСТХІЈЅ", "ABEKMHOPCTXIJS", strict=True))
    | dict(zip("αονρικ", "aovpik", strict=True))
    | dict(zip("․。｡‐‑‒–−   ﹫", "...-----   @", strict=True))
)
#: Of English, French, German and Spanish, in this order.
_DIGITS = "zero one two three four five six seven eight nine", "zéro un deux trois quatre cinq six sept huit neuf", "null eins zwei drei vier fünf sechs sieben acht neun", "cero uno dos tres cuatro cinco seis siete ocho nueve"
_FORMS = {"ze\u0301ro": "0", "une": "1", "zwo": "2", "fu\u0308nf": "5", "fuenf": "5"}
DIGIT_WORDS = {w: str(i) for words in _DIGITS for i, w in enumerate(words.split())} | _FORMS
_AT, _DOT, _PLUS = "arroba|arobase|arrobase|klammeraffe", "dot|punto|punkt|point", "plus|más|ma\u0301s|mas"
POINT_ENDS = "fr|com|org|net|eu|be|ch|ca|lu|info"
ODD = re.compile("[" + "".join(map(re.escape, map(chr, HOMOGLYPHS))) + "]")
WORDS = re.compile(r"[^\W\d_]+(?:[\u0300-\u036f][^\W\d_]*)*")
INVISIBLE = re.compile("[​-‍⁠﻿­]")
_DIGIT = "(?:" + "|".join(sorted(DIGIT_WORDS, key=lambda w: (-len(w), w))) + ")"
#: Spelled digits in a row, with spaces or hyphens between them.
SPELLED = re.compile(rf"(?i)\b(?<![^\W_]){_DIGIT}(?:[ -]{_DIGIT})*(?![^\W_\u0300-\u036f]|[\u0300-\u036f])")
PLUS_WORD = re.compile(rf"(?i)(?<![^\W_])(?:{_PLUS}) (?=[0-9])")
DOT_BETWEEN_DIGITS = re.compile(rf"(?i)(?<=[0-9]) (?:{_DOT}) (?=[0-9])")


def _marked(words: str) -> str:
    return r"\s{0,2}(?:" + "|".join(rf"{a}\s?(?:{words})\s?{b}" for a, b in ((r"\[", r"\]"), (r"\(", r"\)"), (r"\{", r"\}"), ("<", ">"))) + r")\s{0,2}"


_LABEL, _DOT_MARK = "[A-Za-z0-9-]{1,63}", _marked(rf"{_DOT}|\.")
AT_MARK = re.compile(rf"(?i)(?<=[A-Za-z0-9_%+-]){_marked(f'at|@|{_AT}')}(?=[A-Za-z0-9])")
DOT_MARK = re.compile(rf"(?i)(?<=[A-Za-z0-9-]){_DOT_MARK}(?=[A-Za-z0-9])")
#: "name at host dot org": the spelled at counts only with a spelled or marked dot in the domain; its other names, with any dot.
AT_WORD = re.compile(
    rf"(?i)(?<=[A-Za-z0-9_%+-])(?: at (?={_LABEL}(?:(?:\.| point ){_LABEL})*(?:(?: (?:dot|punto|punkt) |{_DOT_MARK})[A-Za-z0-9-]| point (?:{POINT_ENDS})(?![A-Za-z0-9-])))"
    rf"| (?:{_AT}) (?={_LABEL}(?:\.| (?:{_DOT}) |{_DOT_MARK})[A-Za-z0-9-]))"
)
DOT_WORD = re.compile(rf"(?i) (?:{_DOT}) ")
#: A domain with spelled dots, any number of them.
DOTTED = re.compile(rf"(?i)@[A-Za-z0-9-]+(?:(?:\.| (?:{_DOT}) )[A-Za-z0-9-]+)+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """For each @: the run of local characters before it, back to the last match's end, and the longest domain after it."""
    done = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > done and (c := text[begin - 1]) < "\x80" and (c.isalnum() or c in "._%+-"):
            begin -= 1
        m = DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            yield "email", begin, m.end()
            done = m.end()
        else:
            done = max(done, begin)  # nothing that ends at a later @ can begin before this one
        at = text.find("@", max(at + 1, done))


def identifiers(text: str) -> list[Span]:
    """The base patterns' matches, by kind, then place."""
    out = list(emails(text))
    out += (("ip", *m.span()) for m in IP.finditer(text) if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= CARD_DIGITS[0]:
            digits = m[0].replace(" ", "").replace("-", "")
            if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += (("phone", *m.span()) for m in PHONE.finditer(text) if PHONE_DIGITS[0] <= sum("0" <= c <= "9" for c in m[0]) <= PHONE_DIGITS[1])
    return out


class Transducer:
    """One rewriting of a text: ``edits`` are (start, end, new text), in order and apart."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        parts, at, out = [], 0, 0
        self.starts, self.pieces = [0], [(0, 0, 0)]  # where a piece starts in the output; its source span, of width 0 if kept
        for start, end, new in edits:
            parts += text[at:start], new
            out += start - at
            self.starts.append(out)
            self.pieces.append((start, end, len(new)))
            out += len(new)
            self.starts.append(out)
            self.pieces.append((end, end, 0))
            at = end
        self.text = "".join([*parts, text[at:]])

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The source span of output characters start to end: a rewritten piece counts as a whole, once any of it is in."""
        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        (s, _, new_s), (t, t_end, new_t) = self.pieces[i], self.pieces[j]
        return s if new_s else s + start - self.starts[i], t_end if new_t else t + end - self.starts[j]


def _spelled(m: re.Match) -> str:
    return "".join(DIGIT_WORDS[w] for w in re.split("[ -]", m[0].lower()))


def rewrite(text: str) -> list[Transducer]:
    """The chain of rewritings that change this text. Marked dots become dots after spelled ats, which look for them."""
    chain: list[Transducer] = []

    def add(edits: list[tuple[int, int, str]]) -> None:
        nonlocal text
        if edits:
            chain.append(Transducer(text, edits))
            text = chain[-1].text

    if not text.isascii():
        if INVISIBLE.search(text):
            add([(*m.span(), "") for m in INVISIBLE.finditer(text)])
        if ODD.search(text):
            add([(*m.span(), m[0].translate(HOMOGLYPHS)) for m in ODD.finditer(text)])
    low = text.lower()
    if not DIGIT_WORDS.keys().isdisjoint(WORDS.findall(low)):
        add([(*m.span(), _spelled(m)) for m in SPELLED.finditer(text)])
    if any(f"{w} " in low for w in _PLUS.split("|")):
        add([(*m.span(), "+") for m in PLUS_WORD.finditer(text)])
    spelled_dots = any(f" {w} " in low for w in _DOT.split("|"))
    if spelled_dots:
        add([(*m.span(), ".") for m in DOT_BETWEEN_DIGITS.finditer(text)])
    marks = any(c in text for c in "[({<")
    if marks:
        add([(*m.span(), "@") for m in AT_MARK.finditer(text)])
    if " at " in low or any(f" {w} " in low for w in _AT.split("|")):
        add([(*m.span(), "@") for m in AT_WORD.finditer(text)])
    if marks:
        add([(*m.span(), ".") for m in DOT_MARK.finditer(text)])
    if spelled_dots and "@" in text:
        add([(*d.span(), ".") for m in DOTTED.finditer(text) for d in DOT_WORD.finditer(text, *m.span())])
    return chain


def find(text: str | None) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) by kind as listed, then start. A disguised span that meets a base one of its kind is not added."""
    if not text:
        return []
    base = identifiers(text)
    out = [(*s, True) for s in base]
    if chain := rewrite(text):
        taken = {k: [(s, e) for kind, s, e in base if kind == k] for k in KINDS}
        for kind, start, end in identifiers(chain[-1].text):
            for t in reversed(chain):
                start, end = t.back(start, end)
            near = taken[kind]
            i = bisect_right(near, (start, end))
            if not any(s < end and start < e for s, e in near[max(0, i - 1) : i + 1]):
                out.append((kind, start, end, False))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), *s[1:3]))


def masked(text: str | None) -> str | None:
    """The text with each span, or each run of spans that overlap, replaced by the first one's kind in angle brackets."""
    parts, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e, _ in find(text)):
        if start >= at:
            parts += text[at:start], f"<{kind}>"
        at = max(at, end)
    return "".join([*parts, text[at:]]) if parts else text


SPANS = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"


def spans(text: Column) -> Column:
    """All spans of a text; a null text has none."""
    return F.pandas_udf(by_series(lambda t: [{"kind": k, "start": s, "end": e, "base": b} for k, s, e, b in find(t)]), SPANS)(text.cast("string"))


def detect(docs: DataFrame, text: str = "text", name: str = "spans") -> DataFrame:
    """The rows with a column of all their spans.

    Defined results: a null or empty text has none; texts of any length are read whole; repeated rows and null ids stay as
    they are; an empty table stays empty; a column of that name already there is replaced, all others stay.
    """
    return docs.withColumn(name, spans(F.col(f"`{text}`")))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base identifiers, the hash of their spans, and all spans as text; also how many are disguised."""
    written = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("bigint")
    base = F.filter("spans", lambda s: s["base"])
    found = detect(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).select("doc_id", "spans")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(F.array_join(F.transform(base, written), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", written), ",").alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["base"])).cast("bigint").alias("n_disguised"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """The documents with their spans masked; n_chars, if there is such a column, follows the text; all else stays."""
    (new,) = fresh(docs.columns, "masked")
    out = docs.withColumn(new, F.pandas_udf(by_series(masked), "string")(F.col("text").cast("string")))
    return out.select(*(F.col(new).alias(c) if c == "text" else F.length(new).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))
