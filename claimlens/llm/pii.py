"""Operator 13: personal data in texts, also where it is disguised, as spans of the source's characters.

Four detectors (email, ip, card, phone) read the text as it stands; what they find is the base. A text that shows signs of disguise
goes through three transducers, each of which rewrites some runs of characters and keeps, for every character of its output,
the range of source characters that it stands for:

1. characters: look-alike letters, digits of other scripts, wide, narrow and mathematical forms become ASCII; characters without
   width go;
2. spelled digits: three digit words in a row or more, also with "double", "triple", "plus" and "dot", become digits;
3. at and dot: bracketed, underlined or spaced disguises of @ and . become the character itself.

The detectors then read the rewritten text, and what they find is mapped back. A found span is added unless a base span of its kind
covers it, and only if no letter or digit adjoins it; base spans all stay.

The detectors need time in proportion to the text, however long its runs of digits or letters are: an address is read outwards from
its @, and numbers start only where a run of digits does.

Defined results: a null text is empty and has no spans; repeated rows are searched each; a table without rows gives none; further
columns pass through, and give way to a result's name. Offsets count code points, and end behind the last one.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import with_columns

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses. An address has one @, so each @ is tried once, with the longest local part before it."""
    done, at, before = 0, text.find("@"), 0
    while at >= 0:
        low = max(done, before)
        start = low + len(text[low:at].rstrip(LOCAL))
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            yield start, domain.end()
            done = domain.end()
        before, at = at + 1, text.find("@", at + 1)


def small(part: str) -> bool:
    digits = part.lstrip("0")
    return len(digits) < 4 and int(digits or "0") <= 255


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def detected(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the detectors find, by start and then by kind."""
    found = [(a, 0, b) for a, b in emails(text)]
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(small, m[0].split(".")))]
    found += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 12 and 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(found)


class Aligned:
    """A rewritten text; its character i stands for the source's characters from first[i] up to last[i], exclusive."""

    def __init__(self, text: str):
        self.text, self.first, self.last = text, range(len(text)), range(1, len(text) + 1)

    def rewritten(self, edits: list[tuple[int, int, str]]) -> Aligned:
        """With each edit's characters (start, end, replacement; in order, apart from each other) replaced."""
        if not edits:
            return self
        out, text, first, last, at = Aligned(""), [], [], [], 0
        for a, b, new in edits:
            text += (self.text[at:a], new)
            first += [*self.first[at:a], *[self.first[a]] * len(new)]
            last += [*self.last[at:a], *[self.last[b - 1]] * len(new)]
            at = b
        text.append(self.text[at:])
        out.text, out.first, out.last = "".join(text), [*first, *self.first[at:]], [*last, *self.last[at:]]
        return out


#: Letters of other scripts that look like Latin ones, beside what Unicode itself calls a form of an ASCII character.
LOOK_ALIKES = dict(zip("АВЕКМНОРСТХаеорсухіјѕһԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαıɡ․。·‐‑‒–—−", "ABEKMHOPCTXaeopcyxijshdqwABEZHIKMNOPTYXoaig...------", strict=True))
FORMS = ("<wide>", "<narrow>", "<small>", "<font>", "<circle>", "<noBreak>")


def character_table() -> dict[str, str]:
    """What the first transducer makes of a character: ASCII, or nothing for one without width."""
    table = dict(LOOK_ALIKES)
    for code in (*range(0x80, 0x3100), *range(0xFE00, 0x10000), *range(0x1D400, 0x1D800)):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind == "Cf":
            table[c] = ""
        elif kind == "Nd":
            table[c] = str(unicodedata.digit(c))
        elif unicodedata.decomposition(c).startswith(FORMS):
            plain = unicodedata.normalize("NFKC", c)
            if len(plain) == 1 and plain.isascii():
                table[c] = plain
    return table


#: Digit words in English, German, Spanish and French: fixed values.
DIGIT_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
}
TIMES = {"double": 2, "triple": 3}
DOT_WORDS, AT_WORDS = "dot|point|punkt|punto", "at|arroba|arobase"

_D = "(?:(?:double|triple)[ -])?(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
_GAP = r"[ \t\n,-]{1,3}"
_RUN = re.compile(rf"(?<!\w)(?:plus[ ]+)?{_D}(?:{_GAP}(?:(?:{DOT_WORDS}){_GAP})?{_D}){{2,}}(?!\w)", re.I)
_ITEM = re.compile(rf"plus[ ]+|{_GAP}(?:{DOT_WORDS}){_GAP}|{_GAP}(?!\w*(?:{DOT_WORDS}))|{_D}", re.I)


def digit_edits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for run in _RUN.finditer(text):
        for m in _ITEM.finditer(text, run.start(), run.end()):
            words = m[0].lower().replace("-", " ").split()
            if words and words[-1] in DIGIT_WORDS:
                new = str(DIGIT_WORDS[words[-1]]) * (TIMES[words[0]] if len(words) > 1 else 1)
            elif words and words[0] == "plus":
                new = "+"
            else:
                new = "." if m[0].strip(" \t\n,-") else ""
            edits.append((m.start(), m.end(), new))
    return edits


_LABEL = "[A-Za-z0-9-]{1,63}"
_PART = "[A-Za-z0-9_%+-]{1,64}"
_OPEN, _SHUT = r"[ ]{0,2}[\[({<][ ]{0,2}", r"[ ]{0,2}[\])}>][ ]{0,2}"
_AT_FORM = rf"(?:{_OPEN}(?:{AT_WORDS}|@){_SHUT}|[ ]{{1,2}}(?:{AT_WORDS})[ ]{{1,2}}|_(?:{AT_WORDS})_|[ ]@[ ])"
_BRACKET_AT = rf"(?:{_OPEN}(?:{AT_WORDS}|@){_SHUT}|_(?:{AT_WORDS})_|[ ]@[ ]|@)"
_DOT_FORM = rf"(?:{_OPEN}(?:{DOT_WORDS}|\.){_SHUT}|[ ]{{1,2}}(?:{DOT_WORDS})[ ]{{1,2}}|_(?:{DOT_WORDS})_|[ ]\.[ ])"
#: A plain word "at" needs a dot that is spelled or bracketed too; "look at example.com" is no address.
_ADDRESS = re.compile(
    rf"(?<![\w.%+-]){_PART}(?:(?:\.|{_DOT_FORM}){_PART}){{0,5}}"
    rf"(?:{_BRACKET_AT}{_LABEL}(?:(?:\.|{_DOT_FORM}){_LABEL}){{0,5}}(?:\.|{_DOT_FORM})[A-Za-z]{{2,24}}|{_AT_FORM}{_LABEL}(?:{_DOT_FORM}{_LABEL}){{0,5}}{_DOT_FORM}[A-Za-z]{{2,24}})(?![\w])",
    re.I,
)
#: Numbers with disguised dots: 10 [dot] 0 [dot] 0 [dot] 1
_NUMBERS = re.compile(rf"(?<![\w.])[0-9]{{1,3}}(?:(?:\.|{_DOT_FORM})[0-9]{{1,3}}){{3}}(?![\w])", re.I)
_SIGN = re.compile(rf"(?P<at>{_AT_FORM})|(?P<dot>{_DOT_FORM})", re.I)


def sign_edits(text: str) -> list[tuple[int, int, str]]:
    edits = set()
    for shape in (_ADDRESS, _NUMBERS):
        for found in shape.finditer(text):
            edits |= {(m.start(), m.end(), "@" if m["at"] else ".") for m in _SIGN.finditer(text, found.start(), found.end())}
    kept, end = [], 0
    for a, b, new in sorted(edits):
        if a >= end:
            kept.append((a, b, new))
            end = b
    return kept


_B, _E = r"[\[({<] {0,2}", r" {0,2}[\])}>]"
#: Any sign of disguise, for RE2, which reads all texts: wider than the transducers' own patterns. A plain " at " needs a disguised dot.
_WORDS = "(?i)" + "|".join(
    (
        rf"(?:(?:{'|'.join(DIGIT_WORDS)})[ \t\n,-]{{1,3}}){{2}}",
        rf"{_B}(?:{AT_WORDS}|@){_E}|_(?:{AT_WORDS})_| @ ",
        rf"{_B}(?:{DOT_WORDS}|\.){_E}|_(?:{DOT_WORDS})_| (?:{DOT_WORDS}) | \. ",
    )
)


class Transducers:
    def __init__(self, table: dict[str, str]):
        self.table = table
        self.special = re.compile("[" + "".join(map(re.escape, sorted(table))) + "]")

    def __call__(self, text: str) -> Aligned:
        out = Aligned(text).rewritten([(m.start(), m.end(), self.table[m[0]]) for m in self.special.finditer(text)])
        for edits in (digit_edits, sign_edits):
            out = out.rewritten(edits(out.text))
        return out


def added(text: str, base: list[tuple[int, int, int]], normal: Aligned) -> list[tuple[int, int, int]]:
    """The spans that the rewritten text shows beside those of the base."""
    found = set()
    for a, kind, b in detected(normal.text):
        if (a and normal.text[a - 1].isalnum()) or (b < len(normal.text) and normal.text[b].isalnum()):
            continue
        start, end = normal.first[a], normal.last[b - 1]
        if not any(k == kind and s <= start and end <= e for s, k, e in base):
            found.add((start, kind, end))
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


RESULTS = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def finder(table: dict[str, str]) -> Callable[[pa.Array], list]:
    transduce = Transducers(table)

    def columns(texts: pa.Array) -> list:
        plain = pc.match_substring_regex(texts, "[@0-9]").to_pylist()
        worded = pc.match_substring_regex(texts, _WORDS).to_pylist()
        counts, hashes, spans, more = [[], [], [], []], [], [], []
        for text, some, words in zip(texts.to_pylist(), plain, worded, strict=True):
            base = detected(text) if some else []
            new = added(text, base, transduce(text)) if words or (not text.isascii() and transduce.special.search(text)) else []
            for kind, held in enumerate(counts):
                held.append(sum(k == kind for _, k, _ in base))
            hashes.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append(joined(sorted(base + new)))
            more.append(len(new))
        return [*counts, hashes, spans, more]

    return columns


def with_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """df with counts and digest of the base spans, all spans as kind:start:end, and the number of added ones."""
    table = character_table()
    return with_columns(df, text, RESULTS, lambda: finder(table))
