"""Personal data in free text: found as typed spans, and replaced by placeholders.

Method: a semi-Markov conditional random field. Whole candidate spans (not tokens) carry the features. For phone
and identity numbers all segments of up to ``MOST_GROUPS`` groups near a cue word are candidates, so forms of no list
are found too; mail and street addresses have the known shapes as candidates, names all pairs and triples of name-like
words. Features are a span's shape, how name-like their words are, and the cue words on either side. A dynamic programme over the ends of
the candidates of a text chooses the best set of spans that don't overlap, so boundaries and types are decided
together (a bounded entity per candidate; text between candidates scores 0). Weights maximise the
conditional likelihood of sentences made by rule from invented values and contexts, hard negatives included;
how name-like a word is comes from an n-gram model fitted on the known names against ordinary words.

Kinds: ``email``, ``phone``, ``idnum``, ``address``, ``name``. Texts without any trigger (a digit, an at
sign or a name-like word) are passed over by one scan.

Defined results: null and blank texts have no spans and stay as they are; spans never overlap; the text
outside spans is unchanged; texts are processed whole; empty tables give an empty result.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from math import exp, log
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convograph.llm.pairs import FUNCTION_WORDS
from convograph.session import cut
from convograph.sources.exports import CHATGPT, SESSIONS, session_rows, table

KINDS = ("email", "phone", "idnum", "address", "name")
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "idnum": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}

# ---------------------------------------------------------------- candidate shapes
_SP = r" \u00a0\u202f"  # spaces inside numbers
_HY = r"\-\u2010\u2011\u2013"  # hyphens inside numbers
_S = rf"[{_SP}]"
_DIGIT_WORD = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
_TOWN = r"[A-ZÄÖÜ][^\W\d_]{2,}(?:[ -][A-ZÄÖÜ][^\W\d_]{2,}){0,2}"
#: a town that ends an address: words after the first belong to it only after one of these
_LAST = r"(?:(?:New|San|Santa|Los|Las|El|La|Le|Saint|Sankt|St\.?|Bad|Port|Fort|North|South|East|West|Upper|Lower|Great) )?[A-ZÄÖÜ][^\W\d_]{2,}(?:-[A-ZÄÖÜa-z][^\W\d_]+)*"
_NO = r"\d{1,4}[a-zA-Z]?"
_ZIP = r"\d{5}"
_GAP = r"(?:, ?|,?[ \t]*\r?\n[ \t]*)"
_STREET = r"(?:Street|St\.?|Road|Rd\.?|Lane|Ln\.?|Avenue|Ave\.?|Drive|Dr\.?|Boulevard|Blvd\.?|Court|Ct\.?|Way|Close|Terrace|Square|Place|Crescent)"
_UNIT = r"(?:Apt\.?|Apartment|Unit|Suite|Ste\.?|Flat|Room|#)"
_ROADS = r"[^\W\d_]*(?:straße|strasse|str\.|weg|allee|gasse|platz|ring|damm|ufer)"
_STATE = r"[A-Z]{2}"
_UKPC = r"[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}"
_NAMED = r"[A-ZÄÖÜ][^\W\d_]+(?:[ -][A-ZÄÖÜ][^\W\d_]+){0,2}"

ADDRESS_SHAPES = {
    "us": rf"\b{_NO} {_NAMED} {_STREET}(?:,? {_UNIT} ?\w{{1,4}})?{_GAP}{_TOWN},? {_STATE} \d{{5}}(?:-\d{{4}})?(?!\d)",
    "us_unit": rf"\b{_NO} {_NAMED} {_STREET},? {_UNIT} ?\w{{1,4}}{_GAP}{_LAST}(?!\w)",
    "uk": rf"\b{_NO} {_NAMED} {_STREET}{_GAP}{_TOWN},? {_UKPC}\b",
    "uk_flat": rf"\b(?:Flat|Apartment|Unit|Room) {_NO},? {_NO} {_NAMED} {_STREET}{_GAP}{_LAST}(?:,? {_UKPC}\b)?(?!\w)",
    "plain": rf"\b{_NO} {_NAMED} {_STREET}{_GAP}{_LAST}(?!\w)",
    "de": rf"\b(?:{_NAMED} )?(?:[A-ZÄÖÜ]{_ROADS}|[A-ZÄÖÜ][^\W\d_]+[ -](?:Straße|Strasse|Weg|Allee|Gasse|Platz|Ring|Damm|Ufer)) {_NO}{_GAP}{_ZIP} {_LAST}(?!\w)",
    "es": rf"\b(?:Calle|Avenida|Avda\.?|Plaza|Paseo|Camino|Via|Viale|Piazza|Rua) (?:(?:de|del|la|las|los) )*{_NAMED},? {_NO}{_GAP}{_ZIP} {_LAST}(?!\w)",
    "fr": rf"\b{_NO},? (?:bis |ter )?(?:rue|avenue|boulevard|place|allée|chemin|impasse|quai) (?:(?:de|du|des|la|le|les) |de l['’]|d['’]|l['’])*{_NAMED}{_GAP}{_ZIP} {_LAST}(?!\w)",
    "box": rf"\b(?:P\.? ?O\.? ?Box|PO Box|Postfach|BP|Apartado) \d{{1,6}}{_GAP}(?:{_ZIP} )?{_LAST}(?:,? {_STATE} \d{{5}}|,? {_UKPC})?(?![\w])",
}
PHONE_SHAPES = {
    "plus": rf"(?<![\w+.])\+\d{{1,3}}(?:[.{_SP}{_HY}]?\(\d{{1,4}}\))?(?:[./{_SP}{_HY}]?\d{{1,5}}){{1,6}}(?![\w]|[.,]\d)",
    "exit": rf"(?<![\w+.])00\d{{2}}{_S}\d{{1,4}}(?:[/{_SP}{_HY}]?\d{{2,6}}){{1,4}}(?![\w]|[.,]\d)",
    "area": rf"(?<![\w+.])\(0?\d{{2,4}}\){_S}?\d{{3,5}}[.{_SP}{_HY}]?\d{{3,4}}(?![\w]|[.,]\d)",
    "nanp": rf"(?<![\w+.\-])\d{{3}}([.{_HY}])\d{{3}}\1\d{{4}}(?![\w-]|[.,]\d)",
    "uk": rf"(?<![\w+.\-])0\d{{2,4}}{_S}\d{{3,4}}{_S}\d{{3,4}}(?![\w-]|[.,]\d)",
    "de": rf"(?<![\w+.\-])0\d{{2,4}}[/{_SP}]\d{{4,6}}(?:[{_SP}{_HY}]\d{{2,4}})?(?![\w-]|[.,]\d)",
    "fr": rf"(?<![\w+.\-])0[1-9](?:([.{_SP}{_HY}])\d\d)(?:\1\d\d){{3}}(?![\w-]|[.,]\d)",
    "words": rf"(?i)(?<![\w-]){_DIGIT_WORD}(?:[ -]{_DIGIT_WORD}){{6,14}}(?![\w-])",
}
ID_SHAPES = {
    "ssn": r"(?<![\w.+-])\d{3}([- ])\d{2}\1\d{4}(?![\w-]|\.\d)",
    "nine": r"(?<![\w.+-])\d{9}(?![\w-]|\.\d)",
    "two_seven": r"(?<![\w-])[A-Z]{2}\d{7}(?![\w-])",
    "one_eight": r"(?<![\w-])[A-Z]\d{8}(?![\w-])",
    "split": r"(?<![\w-])[A-Z]\d{2} \d{6}(?![\w-])",
    "nino": r"(?<![\w-])[A-Z]{2}( ?)\d{2}\1\d{2}\1\d{2}\1[A-D](?![\w-])",
    "licence": r"(?<![\w-])[A-Z]-\d{3}-\d{4}-\d{4}(?![\w-])",
    "dni": r"(?<![\w-])\d{8}-?[A-Z](?![\w-])",
}
_LOCAL = r"[A-Za-z0-9][A-Za-z0-9._%+'’-]*"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
EMAIL_SHAPES = {
    "plain": rf"(?<![\w.%+-]){_LOCAL}[@＠](?:{_LABEL}\.)+[A-Za-z]{{2,}}(?![\w-]|\.\w|@)",
    "paren": rf"(?<![\w.%+-]){_LOCAL} ?[(\[{{] ?at ?[)\]}}] ?{_LABEL}(?:\.{_LABEL}| ?[(\[{{] ?dot ?[)\]}}] ?{_LABEL})*(?:\.| ?[(\[{{] ?dot ?[)\]}}] ?)[A-Za-z]{{2,}}(?![\w-])",
    "words": rf"(?<![\w.%+-]){_LOCAL} at {_LABEL}(?: dot {_LABEL})* dot [A-Za-z]{{2,}}(?![\w-])",
}
_ALL = [("email", k, re.compile(p)) for k, p in EMAIL_SHAPES.items()]
_DIGITAL = [(kind, k, re.compile(p)) for kind, ps in (("address", ADDRESS_SHAPES), ("phone", PHONE_SHAPES), ("idnum", ID_SHAPES)) for k, p in ps.items() if k != "words"]
#: spelled numbers use two of these at least
_DIGIT_NAMES = ("zero", "two", "three", "four", "five", "six", "seven", "eight", "nine")
_HAS_DIGIT = re.compile(r"\d")
_SPELLED = re.compile(PHONE_SHAPES["words"])
#: runs that can hold a phone or an identity number
_RUN = re.compile(rf"\d(?:[./(){_SP}{_HY}]{{0,2}}\d){{4,}}")
#: every address shape holds a number before a capital or a French street word, and one of the fragments
_NUMBER_THEN = re.compile(r"\d[a-zA-Z]?(?:,? ?\r?\n[ \t]*|,? )(?:[A-ZÄÖÜ]|rue |avenue |boulevard |place |allée |chemin |impasse |quai |bis |ter )")
_ADDRESS_PARTS = (
    "Street", "St.", "St,", "St\n", "Road", "Rd", "Lane", "Ln", "Ave", "Drive", "Dr.", "Dr,", "Boulevard", "Blvd", "Court", "Ct.", "Ct,", "Way,", "Way\n", "Close", "Terrace",
    "Square", "Place", "Crescent", "rue ", "avenue ", "boulevard ", "place ", "allée ", "chemin ", "impasse ", "quai ", "straße ", "strasse ", "str. ", "weg ", "allee ", "gasse ",
    "platz ", "ring ", "damm ", "ufer ", "Straße ", "Strasse ", "Weg ", "Allee ", "Gasse ", "Platz ", "Ring ", "Damm ", "Ufer ", "Calle ", "Avenida ", "Avda", "Plaza ", "Paseo ",
    "Camino ", "Via ", "Viale ", "Piazza ", "Rua ", "Box ", "Postfach ", "BP ", "Apartado ",
)


def _may_hold_address(text: str) -> bool:
    return _NUMBER_THEN.search(text) is not None and any(p in text for p in _ADDRESS_PARTS)


# ---------------------------------------------------------------- cues (fixed values)
CUES = {
    "phone": "call phone tel telephone mobile cell fax dial reach contact voicemail text sms number ring whatsapp telefon handy móvil portable",
    "idnum": "passport ssn social security insurance national identity id licence license driver driver's ausweisnummer ausweis personalausweis nino dni card tax identification reisepass pasaporte passeport",
    "address": "live lives address ship deliver moved office letter pickup send mailing billing lieferung adresse wohne",
    "email": "mail email e-mail write contact cc reply-to send login report",
    "name": "dear ask author by name regards hi hello from thanks wrote told reviewed signed colleague meet yours sincerely",
    "code": "row rows ticket build version port hash printed order invoice page pages chapter column columns rate commit error line package pinned step issue pr batch layout",
}
_CUE_OF = {w: k for k, v in CUES.items() for w in v.split()}
_NUMBER_CUES = ("phone", "idnum")
_CUE_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_TITLES = frozenset("mr mrs ms miss dr prof professor sir madam herr frau señor señora monsieur madame".split())
_NOT_AFTER = frozenset("method index theorem effect street road lane avenue ave box institute university model algorithm test scale award prize school hotel bridge".split())


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    features: tuple[str, ...]


def _around(text: str, start: int, end: int) -> list[str]:
    """Cue classes left and right of a span."""
    left = [w.lower() for w in _CUE_WORD.findall(text[max(0, start - 40) : start])][-5:]
    right = [w.lower() for w in _CUE_WORD.findall(text[end : end + 32])][:3]
    return [*{f"L:{_CUE_OF[w]}" for w in left if w in _CUE_OF}, *{f"R:{_CUE_OF[w]}" for w in right if w in _CUE_OF}]


# ---------------------------------------------------------------- how name-like a word is
class NameModel:
    """Naive Bayes over character n-grams of given names, family names and other words."""

    CLASSES = ("given", "family", "other")

    def __init__(self, given: list[str], family: list[str], other: list[str]) -> None:
        self.known = {"given": {x.lower() for x in given}, "family": {x.lower() for x in family}}
        self.ordinary = {x.lower() for x in other} - self.known["given"] - self.known["family"]
        self.tables: list[dict[str, float]] = []
        self.floor: list[float] = []
        for group in (given, family, other):
            counts: dict[str, int] = {}
            for w in {x.lower() for x in group}:
                for g in self._grams(w):
                    counts[g] = counts.get(g, 0) + 1
            total = sum(counts.values()) + 2_000
            self.tables.append({g: log((c + 0.2) / total) for g, c in counts.items()})
            self.floor.append(log(0.2 / total))
        self.memo: dict[str, tuple[str, str]] = {}

    @staticmethod
    def _grams(word: str) -> list[str]:
        w = f"^{word}$"
        return [w[i : i + 3] for i in range(len(w) - 2)] + [w[-n:] for n in (4, 5, 6)] + [w[:4]]

    def classes(self, word: str) -> tuple[str, str]:
        """(given-like, family-like) of one word: ``K`` known, ``L`` likely, ``U`` unlikely."""
        w = word.lower()
        if (out := self.memo.get(w)) is None:
            if len(self.memo) > 200_000:  # bounds the memo only
                self.memo.clear()
            out = self.memo[w] = self._classes(w)
        return out

    def _classes(self, w: str) -> tuple[str, str]:
        if "-" in w and all(w.split("-")):
            parts = [self.classes(p) for p in w.split("-")]
            return tuple(max((p[i] for p in parts), key="KLU".index) for i in (0, 1))  # type: ignore[return-value]
        known = ["K" if w in self.known[kind] else "U" for kind in ("given", "family")]
        if len(w) < 3 or w in self.ordinary:
            return (known[0], known[1])
        score = [sum(t.get(g, f) for g in self._grams(w)) for t, f in zip(self.tables, self.floor)]
        best = []
        for i, kind in enumerate(("given", "family")):
            likely = score[i] > score[2] + 1.0 and score[i] > score[1 - i] - 6.0
            best.append("K" if w in self.known[kind] else "L" if likely else "U")
        return (best[0], best[1])


_NAME_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*\.?")
_BETWEEN = re.compile(r"[  \t]+\Z|[  \t]*\r?\n[  \t]*\Z")
_COMMA = re.compile(r",[  ]\Z")
_EDGES = "\"'“”‘’()[]{}<>*_.,;:!?|`"


def _case(word: str) -> str:
    return "U" if word.isupper() and len(word) > 1 else "T" if word[:1].isupper() else "l"


class _Flags(dict):
    """Stretch between white space → ``n`` (holds a name-like word), ``l`` (one in lower case), ``i`` (an initial) or ``.``; bounded, for speed only."""

    def __init__(self, model: NameModel) -> None:
        self.model = model

    def __missing__(self, token: str) -> str:
        if len(self) > 400_000:
            self.clear()
        out = "."
        for p in _NAME_WORD.findall(token) if "@" not in token else ():
            p = p.rstrip(".")
            c = self.model.classes(p) if len(p) > 1 else ""
            if "K" in c or "L" in c and p[0].isupper():
                out = "n"
            elif "L" in c and out == ".":
                out = "l"
            elif len(p) == 1 and p.isupper() and out == ".":
                out = "i"
        self[token] = out
        return out


_NAMES_NEAR = re.compile(r"[nil]i*n|n[il]")


def name_spans(text: str, model: NameModel) -> list[Span]:
    """Candidate full names: two or three neighbouring words in the orders names take."""
    words = [(m.start(), m.end() - (m.group().endswith(".") and len(m.group()) > 2), m.group()) for m in _NAME_WORD.finditer(text)]
    out: list[Span] = []

    def cls(i: int) -> tuple[str, str]:
        return model.classes(words[i][2].rstrip("."))

    def initial(i: int) -> bool:
        w = words[i][2]
        return len(w) <= 2 and w[0].isupper() and (w.endswith(".") or len(w) == 1)

    def add(i: int, j: int, order: str, given: str, family: str, family_at: int) -> None:
        start, end = words[i][0], words[j][1]
        if initial(j) and words[j][2].endswith("."):
            end = words[j][0] + 2
        if "K" not in (given, family) and any(words[k][2][0].islower() for k in (i, j)):
            return  # in lower case only a known name tells a name from ordinary words
        if start and (text[start - 1] in "@＠/\\#_+=-" or text[start - 1].isdigit()) and text[start - 1] != "_" or end < len(text) and (text[end] in "@＠/\\_+=" or text[end].isdigit()):
            return
        before, after = (words[i - 1][2].rstrip(".").lower() if i else ""), (words[j + 1][2].lower().rstrip(".") if j + 1 < len(words) else "")
        f = [f"o:{order}", f"g:{given}", f"f:{family}", f"gf:{given}{family}", f"c:{_case(words[family_at][2])}", f"gfc:{given}{family}{_case(words[i][2])}{_case(words[j][2])}"]
        if "\n" in text[start:end]:
            f.append("break")
        if before == "the":
            f.append("the")
        if before in _TITLES:
            f.append("title")
        if after in _NOT_AFTER and not text[end : end + 2].strip(" ").startswith((".", ",")):
            f.append("noun after")
        out.append(Span(start, end, "name", (*(f"name:{x}" for x in f), *(f"name:{x}" for x in _around(text, start, end)))))

    for i in range(len(words) - 1):
        gap = text[words[i][0] + len(words[i][2]) : words[i + 1][0]]
        if _BETWEEN.match(gap):
            (g1, f1), (g2, f2) = cls(i), cls(i + 1)
            if f2 != "U" and (g1 != "U" or initial(i)):
                add(i, i + 1, "IF" if initial(i) else "GF", "I" if initial(i) else g1, f2, i + 1)
            if f1 != "U" and g2 != "U" and not initial(i):
                add(i, i + 1, "FG", g2, f1, i)
            if i + 2 < len(words) and _BETWEEN.match(text[words[i + 1][0] + len(words[i + 1][2]) : words[i + 2][0]]):
                g3, f3 = cls(i + 2)
                if initial(i + 1) and f3 != "U" and (g1 != "U" or initial(i)):
                    add(i, i + 2, "GIF", "I" if initial(i) else g1, f3, i + 2)
                elif g1 != "U" and g2 != "U" and f3 != "U" and words[i + 1][2][0].isupper():
                    add(i, i + 2, "GGF", max(g1, g2, key="KLU".index), f3, i + 2)
        elif _COMMA.match(gap):
            (_, f1), (g2, _) = cls(i), cls(i + 1)
            if f1 != "U" and (g2 != "U" or initial(i + 1)):
                add(i, i + 1, "F,G", "I" if initial(i + 1) else g2, f1, i)
                if i + 2 < len(words) and initial(i + 2) and not initial(i + 1) and _BETWEEN.match(text[words[i + 1][1] : words[i + 2][0]]):
                    add(i, i + 2, "F,GI", g2, f1, i)
    return out


#: most groups in a segment of a number
MOST_GROUPS = 8
_GROUP = re.compile(r"[A-Z]{0,2}\d+[A-Z]?(?![a-z])|[A-Z]{1,2}(?![\w'’])")
_JOINT = re.compile(rf"[./(){_SP}{_HY}]{{1,2}}\Z")


_DATE = re.compile(r"(?:19|20)\d\d([-./])(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])(?:\s\d\d?)?|(?:0?[1-9]|[12]\d|3[01])([-./])(?:0?[1-9]|[12]\d|3[01])\2(?:19|20)\d\d(?:\s\d\d?)?")
_QUAD = re.compile(r"\d{1,3}(?:\.\d{1,3}){2,3}")


def number_segments(text: str, taken: set[tuple[int, int]]) -> list[Span]:
    """All segments of up to ``MOST_GROUPS`` neighbouring groups of digits and capitals with 6 to 17 digits, as phone and as identity number.

    Their form is a feature only: lead, digits, groups, separators and the characters on either side. ``taken``
    are the spans that a known shape gives already.
    """
    groups = list(_GROUP.finditer(text))
    out: list[Span] = []
    for i, g in enumerate(groups):
        before = text[g.start() - 1 : g.start()]
        if before.isalnum() or before == "_":
            continue
        start = g.start() - (before in ("+", "(")) - (text[g.start() - 2 : g.start()] == "+(")
        digits, at = 0, g.start()
        for j in range(i, min(i + MOST_GROUPS, len(groups))):
            h = groups[j]
            if j > i and not _JOINT.match(text[at : h.start()]):
                break
            at, digits = h.end(), digits + sum(map(str.isdigit, h.group()))
            if digits > 17:
                break
            after = text[at : at + 2]
            if digits < 6 or (start, at) in taken or after[:1].isalnum() or after[:1] == "_":
                continue
            value = text[start:at]
            letters = sum(map(str.isalpha, value))
            form = ["other", f"lead {value[0] if value[0] in '+(0' else 'A' if value[0].isalpha() else '9'}", f"digits {digits}", f"groups {j - i + 1}", f"letters {min(letters, 3)}"]
            form.append("joint " + "".join(sorted({"-" if c in "-\u2010\u2011\u2013" else "_" if c.isspace() else c for c in value if not c.isalnum()})))
            if after[:1] in ".,:-/@" and after[1:].isdigit() or after[:1] == "-" or text[start - 1 : start] in (".", ":", "-", "/", "@", "="):
                form.append("goes on")
            if _DATE.fullmatch(value):
                form.append("date")
            if _QUAD.fullmatch(value):
                form.append("quad")
            cues = _around(text, start, at)
            for kind in ("phone", "idnum"):
                out.append(Span(start, at, kind, (*(f"{kind}:{f}" for f in form), *(f"{kind}:other+{c}" for c in cues), f"{kind}:other+{'no ' * (not any(c.endswith(kind) for c in cues))}cue")))
    return out


def candidates(text: str, model: NameModel, flags: _Flags) -> list[Span]:
    """All candidate spans of a text with their features."""
    out: list[Span] = []

    def add(kind: str, shape: str, m: re.Match) -> None:
        cues = [c for c in _around(text, m.start(), m.end()) if kind in ("phone", "idnum") or c[0] == "L"]
        out.append(Span(m.start(), m.end(), kind, (f"{kind}:{shape}", *(f"{kind}:{c}" for c in cues), *((f"{kind}:{shape}+{c}" for c in cues)))))

    if "@" in text or "＠" in text or "at)" in text or "at]" in text or "at )" in text or "at ]" in text or "at}" in text or " dot " in text:
        for kind, shape, p in _ALL:
            for m in p.finditer(text):
                add(kind, shape, m)
    if _HAS_DIGIT.search(text):
        run, street = _RUN.search(text), _may_hold_address(text)
        for kind, shape, p in _DIGITAL if run or street else ():
            if street if kind == "address" else run:
                for m in p.finditer(text):
                    add(kind, shape, m)
        if run and any(c in _NUMBER_CUES for c in map(_CUE_OF.get, _CUE_WORD.findall(text.lower()))):
            out += number_segments(text, {(s.start, s.end) for s in out})
    low = text.lower()
    if sum(w in low for w in _DIGIT_NAMES) >= 2:
        for m in _SPELLED.finditer(text):
            add("phone", "words", m)
    if _NAMES_NEAR.search("".join(map(flags.__getitem__, text.split()))):
        out += name_spans(text, model)
    return out


# ---------------------------------------------------------------- the random field
def best_spans(spans: list[Span], weights: dict[str, float]) -> list[Span]:
    """Highest-scoring set of spans that don't overlap (semi-Markov Viterbi over candidate ends)."""
    if not spans:
        return []
    spans = sorted(spans, key=lambda s: (s.end, s.start))
    ends = sorted({s.end for s in spans})
    best: list[tuple[float, Span | None, int]] = [(0.0, None, -1)]  # best[k]: up to ends[k - 1]
    at = 0
    for k, end in enumerate(ends, 1):
        state = (best[k - 1][0], None, k - 1)
        while at < len(spans) and spans[at].end == end:
            s = spans[at]
            prior = _last_before(ends, s.start, k)
            score = best[prior][0] + sum(weights.get(f, 0.0) for f in s.features) + weights.get("bias:" + s.kind, 0.0)
            if score > state[0] + 1e-12:
                state = (score, s, prior)
            at += 1
        best.append(state)
    out, k = [], len(best) - 1
    while k > 0:
        _, s, prior = best[k]
        if s:
            out.append(s)
        k = prior
    return out[::-1]


def _last_before(ends: list[int], start: int, k: int) -> int:
    k -= 1
    while k > 0 and ends[k - 1] > start:
        k -= 1
    return k


def _log_add(a: float, b: float) -> float:
    return max(a, b) + log(1 + exp(-abs(a - b)))


def _expectations(spans: list[Span], scores: list[float]) -> list[float]:
    """Probability of each span under the field (forward and backward sums over span ends)."""
    marks = sorted({0, *(s.start for s in spans), *(s.end for s in spans)})
    place = {p: i for i, p in enumerate(marks)}
    n = len(marks)
    forward, backward = [0.0] * n, [0.0] * n
    for i in range(1, n):
        forward[i] = forward[i - 1]
        for s, v in zip(spans, scores):
            if place[s.end] == i:
                forward[i] = _log_add(forward[i], forward[place[s.start]] + v)
    for i in range(n - 2, -1, -1):
        backward[i] = backward[i + 1]
        for s, v in zip(spans, scores):
            if place[s.start] == i:
                backward[i] = _log_add(backward[i], backward[place[s.end]] + v)
    return [exp(forward[place[s.start]] + v + backward[place[s.end]] - forward[-1]) for s, v in zip(spans, scores)]


def train(sentences: list[tuple[str, set[tuple[int, int, str]]]], model: NameModel, rounds: int = 30, rate: float = 0.4, decay: float = 0.002) -> dict[str, float]:
    """Weights by gradient ascent on the penalised conditional log-likelihood."""
    flags = _Flags(model)
    data = [(c, [1.0 if (s.start, s.end, s.kind) in gold else 0.0 for s in c]) for text, gold in sentences if (c := candidates(text, model, flags))]
    w: dict[str, float] = {}
    seen: dict[str, float] = {}
    for _ in range(rounds):
        for spans, gold in data:
            names = [(*s.features, "bias:" + s.kind) for s in spans]
            p = _expectations(spans, [sum(w.get(f, 0.0) for f in fs) for fs in names])
            for fs, y, q in zip(names, gold, p):
                if abs(y - q) > 1e-3:
                    for f in fs:
                        g = y - q - decay * w.get(f, 0.0)
                        seen[f] = seen.get(f, 1e-3) + g * g
                        w[f] = w.get(f, 0.0) + rate * g / seen[f] ** 0.5
    return w


# ---------------------------------------------------------------- sentences made by rule for training
#: frames around a value; written for training, in no table
_CARRIERS = {
    "email": ["You can reach our desk under {}.", "mail me: {}", "Reply to {} by Friday", "user={} expired", "from:{}", "We forwarded it to ({}) already.", "{}", "his email, {}, bounced"],
    "phone": ["Ring {} after nine.", "tel. {}", "Her mobile is {}.", "Fax {} or wait outside.", "{}", "Contact {}", "Dial {} to cancel.", "phone={}", "Text {} when you land.", "Our number changed to {}."],
    "idnum": ["his passport {} expired", "SSN {}", "Enter the national insurance number {} below.", "{} (passport) must go.", "Strike {} (SSN) from the list.", "{} (identity card) is void.", "Ausweis {}", "identity card: {}", "The driver's licence {} was scanned.", "Whose social security number is {}?", "ID {}", "tax id {}", "Reisepass {}", "DNI {}", "Replace {} (national id) please."],
    "address": ["We live at {} since May.", "Ship everything to {}, thanks.", "The office sits at {}.", "Address: {}", "A letter came back from {}.", "{}", "Deliver to {} only."],
    "name": ["Let us ask {} first.", "author: {}", "{} signed the lease.", "The cake was baked by {} alone.", "Dear {}, come in.", "My name is {} and I paint.", "as {} wrote, it rains", "Best regards,\n{}", "{}", "{} sings.", "Tell {} that dinner is ready.", "Kind regards\n{}", "{} wrote a song.", "{} told nobody.", "Dear {}, the tea is warm.", "Hello {}!", "A note from {}.", "Thanks to {} we slept."],
}
_NEGATIVES = [
    "They counted {d8} ants.", "About {d9} visitors came in all.", "Invoice 2025-{d2}-{d4} is paid.", "Offset 0x{d9} is free.", "Release 12.{d2}.{d2} is out.", "Lines 300-{d2}-{d3} repeat.", "Take ticket 2023-{d2}-{d4} with you.",
    "The router at 198.51.100.{d2}:{d4} sleeps.", "Install tool@{d2}.{d2}.1 first.", "Use @{G} as a tag, it took {d2} ms.", "A slope of 0.00{d4} is flat.", "Unit {d2} Lane Keeping fills {d2} slides.", "The {F} Street project needs {d2} tables.",
    "The {F} Theorem holds.", "The {F} Algorithm wants {d2} rounds.", "Meet at 5 dot {d2} of the plan.", "Mr. {F} slept.", "{G} laughed.", "Order {d9} is late.", "Parcel {d4}b{d3}f{d3} is lost.", "2025-{d2}-{d2} 09:08:07 WARN waited {d4} ms",
    "seven eight nine", "Job {d9} ended", "Der Ofen brennt, und Alte Steine liegen da.", "Das Zimmer Glänzt Der Garten später.", "Luego Parece Buen camino.", "Le Jardin Brille encore.", "Quiet Harbor and Broken Ladder differ.", "Compare Silver Bridge with Paper Lantern.", "Step {d3}-{d2}-{d4}y is done.",
    "Error {d8} on page {d3}", "Version 4.{d3}.{d3} of 20{d2}", "build {d9}", "port {d4}, row {d8}", "The batch {d3} {d3} {d3} of rows ran.", "columns {d3}-{d3}-{d3}",
    "20{d2}-0{n}-1{n} 09:08:07 INFO the {cue} waited {d3} ms", "The {cue} ran on 20{d2}-1{z}-2{n} at noon.", "A {cue} at 198.51.100.{d2} slept.", "Our {cue} needs release {n}.{d2}.{d3} or 1{n}.{d2}.{d2}.{n}", "the {cue} of 1{n}.0{n}.20{d2}", "{cue} {d2}:{d2}:{d2}.{d3}",
]


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _value(r: random.Random, kind: str, given: list[str], family: list[str]) -> str:
    d = lambda n: _digits(r, n)
    g, f, f2 = r.choice(given), r.choice(family), r.choice(family)
    up = lambda n: "".join(r.choice("ABCKXZT") for _ in range(n))
    town = r.choice(family)[:4].capitalize() + r.choice(["ville", "ton", "burg", "field", "mouth", "dorf", "stad"])
    road = r.choice(given)[:5].capitalize() + r.choice(["oak", "dale", "holt", "mere"])
    if kind == "email":
        local = r.choice([f"{g}.{f}", f"{g}{d(2)}", f"{g[0]}{f}", f"{g}_{f}{d(2)}", f"o'{f}", f"{f}+tag"]).lower()
        return r.choice([f"{local}@example.com", f"{local}@mail.example.org", f"{local}@EXAMPLE.NET", f"{local}＠desk.invalid", f"{local}(at)inbox.test", f"{local} [at] example [dot] com", f"{local} at mail dot example dot org"])
    if kind == "phone" and r.random() < 0.15:  # formats of no list: groups of any size
        lead = r.choice(["+", "0", "", "("])
        groups = [d(r.randint(2, 4)) for _ in range(r.randint(3, 4))]
        return (f"({groups[0]}) " + r.choice(" -").join(groups[1:])) if lead == "(" else lead + r.choice([" ", "-", "."]).join(groups)
    if kind == "phone":
        return r.choice([f"+1 212 555 {d(4)}", f"({d(3)}) 555-{d(4)}", f"{d(3)}-555-{d(4)}", f"{d(3)}.555.{d(4)}", f"+44 20 7946 {d(4)}", f"020 7946 {d(4)}", f"+49 30 23125 {d(3)}", f"(030) 23125 {d(3)}", f"0049 30 23125-{d(3)}",
                         f"+33 1 99 00 {d(2)} {d(2)}", f"01.99.00.{d(2)}.{d(2)}", f"+1415555{d(4)}", f"+61 2 5550 {d(4)}", f"+1 (312) 555‑{d(4)}", " ".join(r.choice("zero one two three four five six seven eight nine".split()) for _ in range(10))])
    if kind == "idnum" and r.random() < 0.15:
        sep = r.choice(["", "-", " "])
        return sep.join([up(r.randint(1, 2)), d(r.randint(3, 5)), d(r.randint(3, 5))]) + r.choice(["", up(1)])
    if kind == "idnum":
        return r.choice([f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", d(9), up(2) + d(7), up(1) + d(8), f"{up(1)}{d(2)} {d(6)}", f"QQ{d(6)}A", f"QQ {d(2)} {d(2)} {d(2)} C", f"D-{d(3)}-{d(4)}-{d(4)}", d(8) + up(1)])
    if kind == "address":
        n = str(r.randint(1, 299)) + r.choice(["", "", "a", "b"])
        return r.choice([f"{n} {road} Street, {town}, ZZ {d(5)}", f"{n} {road} Street\n{town}, ZZ {d(5)}", f"{n} {road} Ave., Apt. {d(2)}, {town}", f"Flat {d(2)}, {n} {road} Lane, {town}", f"{n} {road} Road, {town} ZZ{d(1)} {d(1)}QQ",
                         f"{road}straße {n}, {d(5)} {town}", f"{road}weg {n}, {d(5)} {town}", f"Calle {road} {n}, {d(5)} {town}", f"{n}, rue de {road}, {d(5)} {town}", f"P.O. Box {d(3)}, {town}"])
    return r.choice([f"{g} {f}", f"{g} {f}", f"{g} {f}", f"{f}, {g}", f"{g} {r.choice('ABKM')}. {f}", f"{r.choice('ABKM')}. {f}", f"{f}, {r.choice('ABKM')}.", f"{g} {f}-{f2}", f"{g} {f.upper()}", f"{g.upper()} {f.upper()}", f"{g.lower()} {f.lower()}"])


def training_sentences(given: list[str], family: list[str], seed: int = 5, n: int = 2000) -> list[tuple[str, set[tuple[int, int, str]]]]:
    """Sentences with one to three invented values or hard negatives, and the true spans."""
    r, out = random.Random(seed), []
    for _ in range(n):
        text, gold = "", set()
        for _ in range(r.randint(1, 3)):
            text += r.choice(["", " ", "\n\n", " "]) if text else ""
            if r.random() < 0.35:
                t = r.choice(_NEGATIVES)
                for k in (9, 8, 4, 3, 2):
                    while f"{{d{k}}}" in t:
                        t = t.replace(f"{{d{k}}}", _digits(r, k), 1)
                t = t.replace("{n}", str(r.randint(1, 9))).replace("{z}", str(r.randint(0, 2))).replace("{cue}", r.choice(CUES[r.choice(("phone", "idnum", "code"))].split()))
                text += t.replace("{F}", r.choice(family)).replace("{G}", r.choice(given))
            else:
                kind = r.choice(KINDS)
                head, tail = r.choice(_CARRIERS[kind]).split("{}")
                value = _value(r, kind, given, family)
                if text and not text[-1].isspace():
                    text += " "
                gold.add((len(text) + len(head), len(text) + len(head) + len(value), kind))
                text += head + value + tail
        out.append((text, gold))
    return out


# ---------------------------------------------------------------- operators
class Finder:
    """A fitted model: finds and replaces personal data in one text."""

    def __init__(self, model: NameModel, weights: dict[str, float]) -> None:
        self.model, self.weights, self.flags = model, weights, _Flags(model)

    def __reduce__(self):
        return (Finder, (self.model, self.weights))

    def find(self, text: str) -> list[Span]:
        return best_spans(candidates(text, self.model, self.flags), self.weights)

    def replace(self, text: str) -> str:
        out, at = [], 0
        for s in self.find(text):
            out += [text[at : s.start], PLACEHOLDERS[s.kind]]
            at = s.end
        return "".join([*out, text[at:]])


def fit(known_names: list[tuple[str, str]], ordinary: list[str]) -> Finder:
    """Finder from known names (name, ``given`` or ``family``) and ordinary words."""
    given = sorted({n for n, k in known_names if k == "given"}) or ["Anna"]
    family = sorted({n for n, k in known_names if k == "family"}) or ["Miller"]
    names = {n.lower() for n, _ in known_names}
    other = [w for w in ordinary if w.lower() not in names]
    # Half the names are withheld while the weights are fitted, so that names not known get weights too.
    half = NameModel(given[::2], family[::2], other)
    return Finder(NameModel(given, family, other), train(training_sentences(given, family), half))


#: ordinary words are met LEAST times in texts, and make up one in RARE of the words counted in their table; so there are at most RARE per table
LEAST, RARE = 5, 75_000


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        counts: Counter[tuple[str, str]] = Counter()
        for kind, text in zip(pdf.kind, pdf.text):
            if kind == "text":
                counts.update((kind, w) for w in re.findall(r"[^\W\d_]+", text) if w.islower())
            else:
                counts.update((kind, w) for w in re.split(r"[\W\d_]+", text.lower()) if w)
        yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["kind", "word", "n"])


def frequent_words(texts: DataFrame, nodes: DataFrame, least: int = LEAST, rare: int = RARE) -> list[str]:
    """Lower-case words of ``texts`` and parts of ``nodes`` (both ``text``), counted over all rows.

    Words of texts are met ``least`` times or more; both make up one in ``rare`` of their kind at least, so the
    vocabulary has at most ``2 * rare`` words at any size and doesn't grow with the table.
    """
    both = texts.select(F.lit("text").alias("kind"), "text").unionByName(nodes.select(F.lit("node").alias("kind"), "text"))
    counted = both.where(F.col("text").isNotNull()).mapInPandas(_count_words, "kind string, word string, n long")
    counts = cut(counted.groupBy("kind", "word").agg(F.sum("n").alias("n")))
    total = counts.groupBy("kind").agg(F.sum("n").alias("total"))
    kept = counts.join(F.broadcast(total), "kind").where((F.col("n") * rare >= F.col("total")) & ((F.col("kind") == "node") | (F.col("n") >= least)))
    return [r.word for r in kept.select("word").distinct().collect()]


def fitted(spark: SparkSession, where: str, max_names: int = 20_000, max_rows: int = 3_000) -> Finder:
    """Fits on the known names (at most ``max_names``) and on ordinary words: those of at most ``max_rows`` graded
    samples, and the frequent words of all chunks and node names."""
    names = [(r.name, r.name_kind) for r in table(spark, where, "known_names").where("name is not null").orderBy("name", "name_kind").limit(max_names).collect()]
    samples = [r[0] for r in table(spark, where, "level_samples").where("text is not null").select("text").limit(max_rows).collect()]
    nodes = table(spark, where, "edges").select(F.col("source").alias("text"))
    return fit(names, ordinary_words(samples, frequent_words(table(spark, where, "chunks").select("text"), nodes)))


def ordinary_words(samples: list[str], frequent: list[str]) -> list[str]:
    """Words that stand for "no name", sorted."""
    words = {w.lower() for t in samples for w in re.findall(r"[^\W\d_]+", t)}
    return sorted(words | set(frequent) | {w for v in FUNCTION_WORDS.values() for w in v.split()})


def personal_texts(spark: SparkSession, where: str) -> DataFrame:
    """``tab, rec_id, part, text``: message parts, session messages and chunks; every row counts."""
    node = table(spark, where, CHATGPT).select(F.explode("mapping").alias("rec_id", "node"))
    parts = node.select(F.lit(CHATGPT).alias("tab"), "rec_id", F.posexplode("node.message.content.parts").alias("part", "text"))
    lines = session_rows(table(spark, where, SESSIONS)).select(F.lit(SESSIONS).alias("tab"), F.col("line_id").cast("string").alias("rec_id"), F.lit(0).alias("part"), "text")
    chunks = table(spark, where, "chunks").select(F.lit("chunks").alias("tab"), F.col("id").alias("rec_id"), F.lit(0).alias("part"), "text")
    return parts.unionByName(lines).unionByName(chunks).where(F.col("text").isNotNull() & (F.col("text") != "") & F.col("rec_id").isNotNull())


def found_spans(texts: DataFrame, finder: Finder) -> DataFrame:
    """``tab, rec_id, part, kind, val, start`` of each span of personal data."""
    shared = texts.sparkSession.sparkContext.broadcast(finder)  # a model of bounded size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = shared.value.find
        for pdf in batches:
            out = [(tab, rec, part, s.kind, text[s.start : s.end], s.start) for tab, rec, part, text in zip(pdf.tab, pdf.rec_id, pdf.part, pdf.text) for s in find(text)]
            yield pd.DataFrame(out, columns=["tab", "rec_id", "part", "kind", "val", "start"])

    return texts.select("tab", "rec_id", "part", "text").mapInPandas(run, "tab string, rec_id string, part int, kind string, val string, start int")


def redacted(texts: DataFrame, finder: Finder) -> DataFrame:
    """``tab, rec_id, part, text`` with each span replaced by its typed placeholder."""
    shared = texts.sparkSession.sparkContext.broadcast(finder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        replace = shared.value.replace
        for pdf in batches:
            yield pdf.assign(text=[t if t is None else replace(t) for t in pdf.text])

    return texts.select("tab", "rec_id", "part", "text").mapInPandas(run, "tab string, rec_id string, part int, text string")
