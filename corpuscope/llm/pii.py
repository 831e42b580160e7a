"""Personal data: detectors over the text as written and over a deobfuscated form of it.

Two transducers rewrite disguises: one works on characters (homoglyphs, other scripts' digits,
invisible characters, entities), one on words (spelled digits, letters among digits, spelled or
bracketed "at" and "dot"). Each remembers which stretch of its input every rewritten stretch came
from, so whatever the detectors find in the last form is told in offsets of the source.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]
#: An edit of a text: begin, end, replacement.
Edit = tuple[int, int, str]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGITS = re.compile(r"[^0-9]")


def emails(text: str) -> Iterator[Span]:
    """Leftmost addresses, found from their "@", so long words without one cost nothing."""
    low, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > low and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        low = domain.end() if domain else at + 1
        if domain:
            yield begin, low
        at = text.find("@", low)


def ips(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
            yield m.span()


def luhn(digits: str) -> bool:
    """Whether the check digit of a number fits."""
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NO_DIGITS.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[Span]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NO_DIGITS.sub("", m[0])) <= 15:
                yield m.span()


DETECTORS: tuple[Callable[[str], Iterator[Span]], ...] = (emails, ips, cards, phones)


@dataclass
class Rewritten:
    """A text after edits, with the way back for offsets."""

    text: str
    #: Begin and end of the edits in the rewritten text, and in its source.
    begins: list[int]
    ends: list[int]
    source: list[Span]

    def back(self, begin: int, end: int) -> Span:
        """The stretch of the source that a stretch of the rewritten text came from."""
        return self._back(begin, False), self._back(end - 1, True)

    def _back(self, at: int, last: bool) -> int:
        i = bisect_right(self.begins, at) - 1
        while i >= 0 and self.begins[i] == self.ends[i] and not last and i and self.begins[i - 1] == at:
            i -= 1  # something deleted right here
        if i < 0:
            return at + last
        if at < self.ends[i]:
            return self.source[i][last]
        return self.source[i][1] + at - self.ends[i] + last

    def touched(self, begin: int, end: int) -> bool:
        """Whether an edit lies in a stretch of the rewritten text (deletions within it count)."""
        i = bisect_right(self.begins, end - 1) - 1
        return i >= 0 and (self.ends[i] > begin or self.begins[i] > begin)


def rewrite(text: str, edits: Iterable[Edit]) -> Rewritten:
    """The text with edits applied, in order of their places; overlapping ones are left out."""
    parts, at, n = [], 0, 0
    out = Rewritten("", [], [], [])
    for begin, end, new in sorted(edits):
        if begin < at:
            continue
        parts += [text[at:begin], new]
        n += begin - at
        out.begins.append(n)
        n += len(new)
        out.ends.append(n)
        out.source.append((begin, end))
        at = end
    out.text = "".join(parts) + text[at:]
    return out


# Letters of other scripts that look like Latin ones, each above its twin.
_LOOK = "АВЕЗКМНОРСТУХЅІЈаеорсухѕіјԁһԛԝгпӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορυχι"
_LIKE = "ABE3KMHOPCTYXSIJaeopcyxsijdhqwrnlABEZHIKMNOPTYXavopuxi"
# Dashes, dots and blanks beside those that compatibility folding gives.
_MARKS = {"‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "·": ".", "•": ".", "。": ".", "․": ".", "∙": "."}
# Words for the digits from 0 to 9 in four languages.
DIGIT_WORDS = (
    ("zero", "null", "zéro", "cero"), ("one", "eins", "un", "uno"), ("two", "zwei", "deux", "dos"),
    ("three", "drei", "trois", "tres"), ("four", "vier", "quatre", "cuatro"), ("five", "fünf", "cinq", "cinco"),
    ("six", "sechs", "seis"), ("seven", "sieben", "sept", "siete"), ("eight", "acht", "huit", "ocho"),
    ("nine", "neun", "neuf", "nueve"))
# Words for "at" and "dot" that go together, and endings of domains asked for where neither is marked off.
AT_WORDS, DOT_WORDS = ("at", "arroba", "arobase"), ("dot", "punto", "point", "punkt")
ENDINGS = frozenset("com org net edu gov mil int info io co de fr es uk us eu ch at it nl be pt br mx ar cl ca au in cn jp ru".split())


def _characters() -> dict[str, str]:
    """Characters that are read as an ASCII one, or as nothing."""
    table = {}
    for code in (*range(0x80, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200)):
        c = chr(code)
        digit = unicodedata.decimal(c, None)
        folded = str(digit) if digit is not None else unicodedata.normalize("NFKC", c)
        if unicodedata.category(c) == "Cf":
            table[c] = ""
        elif len(folded) == 1 and " " <= folded <= "~":
            table[c] = folded
    return table | dict(zip(_LOOK, _LIKE)) | _MARKS


CHARACTERS = _characters()
_ENTITY = re.compile(r"&(?:#x([0-9A-Fa-f]{1,6})|#([0-9]{1,7})|(commat|period|plus|nbsp));?")
_NAMED = {"commat": "@", "period": ".", "plus": "+", "nbsp": " "}


def character_edits(text: str) -> list[Edit]:
    """Homoglyphs, digits of other scripts, invisible characters and entities of single characters."""
    edits: list[Edit] = []
    if not text.isascii():
        met = CHARACTERS.keys() & set(text)
        if met:
            found = re.compile("[" + "".join(map(re.escape, met)) + "]")
            edits = [(m.start(), m.end(), CHARACTERS[m[0]]) for m in found.finditer(text)]
    if "&" in text:
        for m in _ENTITY.finditer(text):
            code = int(m[1], 16) if m[1] else int(m[2]) if m[2] else ord(_NAMED[m[3]])
            if 32 <= code < 127:
                edits.append((*m.span(), chr(code)))
    return edits


def _any(words: Iterable[str]) -> str:
    return "|".join(sorted(words, key=lambda w: (-len(w), w)))


_OPEN, _CLOSE = r"[ \t]{0,2}[\[({<][ \t]?", r"[ \t]?[\])}>][ \t]{0,2}"
_TOGETHER = {"at": ("dot", "punkt", "."), "arroba": ("dot", "punto", "."), "arobase": ("dot", "point", ".")}
_AT_MARKED = rf"{_OPEN}(?:{_any(AT_WORDS)}|@){_CLOSE}"
_DOT_MARKED = rf"{_OPEN}(?:{_any(DOT_WORDS)}|\.){_CLOSE}"
_DOT = rf"(?:\.|{_DOT_MARKED}|[ ]\.[ ]|[ ](?:{_any(DOT_WORDS)})[ ])"
_AT = re.compile(rf"(?P<marked>{_AT_MARKED})|(?P<bare>[ ](?:{_any(AT_WORDS)})[ ])|(?P<spaced>[ ]@[ ])|(?P<plain>@)", re.I)
_RIGHT = re.compile(rf"[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+", re.I)
_LEFT = re.compile(rf"(?:[A-Za-z0-9_%+-]+{_DOT}){{0,4}}[A-Za-z0-9_%+-]+\Z", re.I)
_DOTS = re.compile(_DOT, re.I)
#: How far before an "at" spelled dots are looked for.
_REACH = 120
_MAYBE_AT = re.compile(rf"@|[\[({{<][ \t]?(?:{_any(AT_WORDS)})[ \t]?[\])}}>]|[ ](?:{_any(AT_WORDS)})[ ]", re.I)


def address_edits(text: str) -> list[Edit]:
    """Disguised "at" and "dot" where a name stands before and a domain after them.

    An "at" in brackets is enough. A bare word needs a spelled or marked dot in the domain, or a name
    that no word looks like (a digit, dot or underscore in it), and a usual ending of the domain; so
    do blanks around "@". Spelled dots between them become dots.
    """
    edits: list[Edit] = []
    for m in _AT.finditer(text):
        right = _RIGHT.match(text, m.end())
        if right is None:
            continue
        base = max(0, m.start() - _REACH)
        left = _LEFT.search(text[base:m.start()])
        if left is None:
            continue
        dots = [(d.start() + m.end(), d.end() + m.end()) for d in _DOTS.finditer(right[0])]
        # words go on after an address: it ends with the first usual ending behind a spelled dot
        last, spelled = m.end() + right.end() - right.start(), [d for d in dots if text[d[0]:d[1]] != "."]
        for d, after in zip(dots, [*dots[1:], (last, last)]):
            if d in spelled and text[d[1]:after[0]].lower() in ENDINGS and (after not in dots or after in spelled):
                if after in dots and text[after[1]:].split(None, 1)[:1] and re.match(
                        rf"(?:{_any(ENDINGS)})\b", text[after[1]:after[1] + 8], re.I):
                    continue
                last = after[0]
                break
        dots = [d for d in dots if d[1] < last]
        spelled = [d for d in dots if text[d[0]:d[1]] != "."]
        if m["bare"] and any(text[a:b].strip().lower() not in _TOGETHER[m[0].strip().lower()] for a, b in spelled):
            continue
        usual = re.split(r"[^A-Za-z0-9-]+", text[m.end():last])[-1].lower() in ENDINGS
        name = text[base + left.start():m.start()]
        if not dots or m["plain"] and not spelled:
            continue
        if not m["marked"] and not (usual and (spelled or m["spaced"] or re.search(r"[0-9._]", name))):
            continue
        if spelled and not usual and any(text[d[0]] == " " for d in spelled if not re.search(r"[\])}>]", text[d[0]:d[1]])):
            continue
        if not m["plain"]:
            edits.append((m.start(), m.end(), "@"))
        edits += [(a, b, ".") for a, b in spelled]
        for d in _DOTS.finditer(name):
            if _spells_dot(d[0]):
                edits.append((base + left.start() + d.start(), base + left.start() + d.end(), "."))
    return edits


_VALUE = {w: str(i) for i, words in enumerate(DIGIT_WORDS) for w in words}
_DIGIT_WORD = rf"(?:{_any(_VALUE)})"
_UNIT = rf"(?:{_DIGIT_WORD}|[0-9]+)"
_GAP = rf"(?:[ ](?:{_any(DOT_WORDS)})[ ]|{_DOT_MARKED}|,[ ]|[ ]?[.-][ ]?|[ ]?[()][ ]?|[ ])"
_SPELLED = re.compile(rf"(?<!\w)(?:(?P<plus>plus)[ ]{_UNIT}(?:{_GAP}{_UNIT})*|(?:\+[ ]?)?{_UNIT}(?:{_GAP}{_UNIT})+)(?!\w)", re.I)
_PARTS = re.compile(rf"(?P<word>{_DIGIT_WORD})|(?P<digits>[0-9]+)|(?P<gap>{_GAP})", re.I)
#: What a run needs somewhere, in lower case: two units with a word among them, or a digit and a spelled or marked dot.
_MAYBE_WORD = re.compile(rf"[ (\[.,:;=+\n-]{_DIGIT_WORD}[ ,.-]{{1,2}}(?:{_DIGIT_WORD}|[0-9])")
_MAYBE_DOT = re.compile(rf"[0-9](?:[ ,.-]{{1,2}}{_DIGIT_WORD}|[ ]{{0,2}}[\[({{<][ ]?(?:\.|{_any(DOT_WORDS)})|[ ](?:{_any(DOT_WORDS)})[ ])")


def _spells_dot(gap: str) -> bool:
    return gap.strip(" ").strip("[](){}<> ").lower() in DOT_WORDS or "." in gap and gap.strip(" ") != "." and gap.strip(" ")[0] in "[({<"


def digit_edits(text: str) -> list[Edit]:
    """Spelled digits and spelled dots in runs of digits.

    Blanks, hyphens and commas between two spelled digits go; other marks stay. A run without a
    spelled digit, dot or plus stays as it is.
    """
    edits: list[Edit] = []
    for m in _SPELLED.finditer(text):
        parts, at = [], m.end("plus") + 1 if m["plus"] else m.start() + len(re.match(r"\+?[ ]?", m[0])[0])
        while at < m.end() and (p := _PARTS.match(text, at)):
            parts.append((p.lastgroup, *p.span()))
            at = p.end()
        if at < m.end() or not m["plus"] and not any(k == "word" or k == "gap" and _spells_dot(text[a:b]) for k, a, b in parts):
            continue
        if m["plus"]:
            edits.append((m.start(), m.end("plus") + 1, "+"))
        kinds = ["", *(k for k, _, _ in parts), ""]
        for i, (kind, a, b) in enumerate(parts, 1):
            if kind == "word":
                edits.append((a, b, _VALUE[text[a:b].lower()]))
            elif kind == "gap":
                mark = text[a:b].strip(" ")
                if mark == "." or _spells_dot(text[a:b]):
                    new = "."
                elif kinds[i - 1] == kinds[i + 1] == "word" and mark in ("", ",", "-"):
                    new = ""
                else:
                    new = " " if mark == "," else text[a:b]
                if new != text[a:b]:
                    edits.append((a, b, new))
    return edits


_MAYBE_LETTER = re.compile(r"[0-9][ .-]?[OoIl]|[OoIl][ .-]?[0-9]")
_MIXED = re.compile(r"(?<!\w)[0-9OoIl](?:[ .()-]{0,2}[0-9OoIl])+(?!\w)")
_AS_DIGIT = {"O": "0", "o": "0", "I": "1", "l": "1"}


def letter_edits(text: str) -> list[Edit]:
    """Letters that look like digits, in runs that are digits for two thirds at least."""
    edits: list[Edit] = []
    for m in _MIXED.finditer(text):
        digits = sum(c.isdigit() for c in m[0])
        letters = [i for i in range(*m.span()) if text[i] in _AS_DIGIT]
        if letters and digits >= 2 * len(letters):
            edits += [(i, i + 1, _AS_DIGIT[text[i]]) for i in letters]
    return edits


def word_edits(text: str) -> list[Edit]:
    edits = address_edits(text) if _MAYBE_AT.search(text) else []
    low = f" {text.lower()}"
    if _MAYBE_WORD.search(low) or _MAYBE_DOT.search(low) or "plus " in low:
        edits += digit_edits(text)
    if _MAYBE_LETTER.search(text):
        edits += letter_edits(text)
    return edits


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(begin, kind, end)`` of what stands in the text as written, in order."""
    return sorted((a, k, b) for k, find in enumerate(DETECTORS) for a, b in find(text))


def hidden_spans(text: str) -> list[tuple[int, int, int]]:
    """``(begin, kind, end)`` in the source of what the detectors find where something was rewritten."""
    first = rewrite(text, character_edits(text))
    second = rewrite(first.text, word_edits(first.text))
    if not first.source and not second.source:
        return []
    found = set()
    for kind, find in enumerate(DETECTORS):
        for a, b in find(second.text):
            c, d = second.back(a, b)
            if second.touched(a, b) or first.touched(c, d):
                begin, end = first.back(c, d)
                found.add((begin, kind, end))
    return sorted(found)


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """What stands in the text as written, and all spans: those and the hidden ones that lie in none of their kind."""
    base = base_spans(text)
    added = [s for s in hidden_spans(text) if not any(b[1] == s[1] and b[0] <= s[0] and s[2] <= b[2] for b in base)]
    return base, sorted([*base, *added]) if added else base


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every found stretch replaced by the name of its kind; overlapping ones become one."""
    out, at = [], 0
    for begin, kind, end in spans:
        if begin >= at:
            out += [text[at:begin], f"<{KINDS[kind]}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string"


def personal_data(text: Column) -> Column:
    """A struct of ``SCHEMA`` for every whole text.

    ``n_email`` to ``n_phone`` and ``base_sha256`` (of ``kind:start:end`` of each span, comma-joined) tell
    what stands in the text as written, ``n_added`` how many disguised spans come on top, ``spans`` all of
    them, ordered by begin, kind and end, in code points with the end left out. A null text counts as
    an empty one, which has none.
    """
    @F.pandas_udf(SCHEMA)
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts.where(texts.notna(), ""):
            base, spans = all_spans(text)
            kinds = [k for _, k, _ in base]
            rows.append((*map(kinds.count, range(len(KINDS))), len(spans) - len(base),
                         hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return scan(text)


def redact(text: Column) -> Column:
    """Whole texts with every found stretch replaced by its kind in angle brackets; null stays null."""
    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else redacted(t, all_spans(t)[1]) for t in texts.where(texts.notna(), None)], dtype=object)

    return clean(text)
