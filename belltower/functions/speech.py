"""What a voice should say: replies without markup, in parts worth a request each; numbers, units and capitals in words."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# What ends a sentence, other signs that a voice can use, marks of emphasis and of list items, beginnings of addresses.
ENDS, SIGNS, EMPHASIS, BULLETS, ADDRESSES = "।॥?!.", ",;:-–—()'\"%/&+₹", "*`_", "-•·—", ("http://", "https://", "www.")
BLANKS = " \t\r\n"


def without_targets(line: str) -> str:
    """Links by their names, and addresses left out."""
    out, at, low = [], 0, line.lower()
    while at < len(line):
        if line[at] == "[":
            name = line.find("]", at)
            end = line.find(")", name) if 0 < at + 1 < name and line.startswith("](", name) else -1
            if end > 0:
                out.append(without_targets(line[at + 1 : name]))
                at = end + 1
                continue
        if low.startswith(ADDRESSES, at):
            rest = line[at:].split(None, 1)[0]
            if len(rest) > len(next(a for a in ADDRESSES if low.startswith(a, at))):
                at += len(rest)
                continue
        out.append(line[at])
        at += 1
    return "".join(out)


def unlisted(line: str) -> tuple[str, bool]:
    """A line without what makes it a heading, a quotation, a table row or a list item; and whether it was an item."""
    bare = line.strip()
    if len(bare) > 1 and bare[0] == bare[-1] == "|":
        return "", False
    for sign, most in (("#", 6), (">", 1)):
        body = line.lstrip()
        if len(line) - len(body) <= 3 and body.startswith(sign):
            line = body[min(len(body) - len(body.lstrip(sign)), most) :]
    line = line.translate({ord(c): None for c in EMPHASIS})
    body = line.lstrip()
    head, blank, rest = body.partition(" ")
    numbered = head[-1:] in (".", ")") and head[:-1].isdecimal() and len(head) < 4
    if blank and len(line) - len(body) <= 4 and (numbered or head in tuple(BULLETS)):
        return rest.strip(), True
    return body.strip(), False


def speakable(c: str) -> bool:
    return c in BLANKS or c in ENDS or c in SIGNS or unicodedata.category(c)[0] in "LMN"


def spoken(text: str | None) -> str:
    """What a voice should say of a marked-up reply: links by name, no addresses, tables or marks; list items end like sentences. One pass over the characters that can be said settles blanks and repeated ends."""
    lines = []
    for raw in (text or "").splitlines():
        line, item = unlisted(without_targets(raw))
        if line:
            lines.append(line + ENDS[0] if item and line[-1] not in ENDS else line)
    out: list[str] = []
    last, gap = "", False
    for c in filter(speakable, " ".join(lines)):
        if c in BLANKS:
            gap = True
        elif c in ENDS or c == ",":
            if c != last:
                out.append(c)
                gap = False
        else:
            out += [" ", c] if gap and out else [c]
            gap = False
        last = c
    return "".join(out)


def speech_parts(text: str | None, cut_off: bool = False, least: int = 40, first_least: int = 24) -> list[str]:
    """Sentences merged to parts worth a voice request each; an unfinished last sentence of a cut-off reply goes."""
    sentences = [s.strip() for s in re.split(r"(?<=[।॥?!.])\s+", spoken(text)) if s.strip()]
    if cut_off and len(sentences) > 1 and sentences[-1][-1] not in ENDS:
        sentences.pop()
    parts: list[str] = []
    held = ""
    for s in sentences:
        held = f"{held} {s}".strip()
        if len(held) >= (least if parts else first_least):
            parts.append(held)
            held = ""
    if held and parts and len(held) < first_least:
        parts[-1] += f" {held}"
    elif held:
        parts.append(held)
    return parts


@F.pandas_udf(StringType())
def spoken_text(text: pd.Series) -> pd.Series:
    return text.map(spoken)


@F.pandas_udf(ArrayType(StringType()))
def speech_chunks(text: pd.Series) -> pd.Series:
    return text.map(speech_parts)


# The numbers from 0 to 99 in words; the names of a number's places above its last two digits, with how much each holds, and of what lies beyond.
NUMBERS = (
    "शून्य एक दो तीन चार पाँच छह सात आठ नौ दस ग्यारह बारह तेरह चौदह पंद्रह सोलह सत्रह अठारह उन्नीस बीस "
    "इक्कीस बाईस तेईस चौबीस पच्चीस छब्बीस सत्ताईस अट्ठाईस उनतीस तीस इकतीस बत्तीस तैंतीस चौंतीस पैंतीस छत्तीस सैंतीस अड़तीस उनतालीस चालीस "
    "इकतालीस बयालीस तैंतालीस चौवालीस पैंतालीस छियालीस सैंतालीस अड़तालीस उनचास पचास इक्यावन बावन तिरपन चौवन पचपन छप्पन सत्तावन अट्ठावन उनसठ साठ "
    "इकसठ बासठ तिरसठ चौंसठ पैंसठ छियासठ सड़सठ अड़सठ उनहत्तर सत्तर इकहत्तर बहत्तर तिहत्तर चौहत्तर पचहत्तर छिहत्तर सतहत्तर अठहत्तर उन्यासी अस्सी "
    "इक्यासी बयासी तिरासी चौरासी पचासी छियासी सत्तासी अट्ठासी नवासी नब्बे इक्यानवे बानवे तिरानवे चौरानवे पंचानवे छियानवे सत्तानवे अट्ठानवे निन्यानवे"
).split()
PLACES, BEYOND, MINUS, POINT = ((10, "सौ"), (100, "हज़ार"), (100, "लाख")), "करोड़", "ऋण", "दशमलव"


def number_words(n: int) -> str:
    """A whole number in words, from its last place to its first."""
    rest, two = divmod(abs(n), 100)
    said = [NUMBERS[two]] if two or not rest else []
    for holds, name in PLACES:
        rest, digit = divmod(rest, holds)
        if digit:
            said.append(f"{NUMBERS[digit]} {name}")
    if rest:
        said.append(f"{number_words(rest)} {BEYOND}")
    return " ".join([MINUS] * (n < 0) + said[::-1])


def number_in_words(n: Column) -> Column:
    """The same of a column of whole numbers, null for null; without leaving the JVM."""
    listed = F.split(F.lit(" ".join(NUMBERS)), " ")
    whole = lambda x, y: F.call_function("div", x, F.lit(y).cast("long"))

    def said(v: Column, more: int) -> Column:
        """Of a number that isn't negative; more: how often its part beyond can have one itself."""
        parts, held = [], 100
        for holds, name in PLACES:
            digit = whole(v, held) % holds
            parts.append(F.when(digit > 0, F.concat(F.get(listed, digit.cast("int")), F.lit(f" {name}"))))
            held *= holds
        rest = whole(v, held)
        beyond = [F.when(rest > 0, F.concat(said(rest, more - 1), F.lit(f" {BEYOND}")))] if more else []
        two = F.when((v % 100 > 0) | (v == 0), F.get(listed, (v % 100).cast("int")))
        return F.concat_ws(" ", *beyond, *parts[::-1], two)

    n = n.cast("long")
    # the least number has no positive one of its size: its parts have
    size, ten = 10**7, F.lit(10**7).cast("long")
    above, below = F.abs(whole(n, size)), F.abs(n % ten)
    small = F.when((below > 0) | (above == 0), said(below, 0))
    large = F.when(above > 0, F.concat(said(above, 1), F.lit(f" {BEYOND}")))
    return F.when(n.isNotNull(), F.concat_ws(" ", F.when(n < 0, MINUS), large, small))


# Units after a number, letters as they are spelled, and the words of ranges, shares, money and joining.
UNITS = {"mg": "मिलीग्राम", "ml": "मिलीलीटर", "kg": "किलो", "gm": "ग्राम", "g": "ग्राम", "cm": "सेंटीमीटर", "mm": "मिलीमीटर", "l": "लीटर", "°c": "डिग्री सेल्सियस", "°f": "डिग्री फ़ारेनहाइट", "°": "डिग्री"}
LETTERS = {
    "A": "ए", "B": "बी", "C": "सी", "D": "डी", "E": "ई", "F": "एफ", "G": "जी", "H": "एच", "I": "आई",
    "J": "जे", "K": "के", "L": "एल", "M": "एम", "N": "एन", "O": "ओ", "P": "पी", "Q": "क्यू", "R": "आर",
    "S": "एस", "T": "टी", "U": "यू", "V": "वी", "W": "डब्ल्यू", "X": "एक्स", "Y": "वाई", "Z": "ज़ेड",
}
RANGE, SHARE, MONEY, JOIN = "से", "प्रतिशत", "रुपये", "और"
DASHES, BRACKETS = "-–—", "()[]{}"
#: A text's tokens: numbers, Latin words, units with a degree sign, blanks, and single signs.
TOKEN = re.compile(r"(?P<number>[0-9]+(?:,[0-9]{2,3})*(?:\.[0-9]+)?)|(?P<word>[A-Za-z][A-Za-z']*)|(?P<degree>°[CcFf]?(?![A-Za-z]))|(?P<blank>\s+)|(?P<sign>.)", re.S)
ASCII = {ord("०") + d: str(d) for d in range(10)}


class Reading:
    """A walk over the tokens of a text; each rule says what it reads and how many tokens that takes."""

    def __init__(self, text: str, glossary: dict[str, str]):
        self.tokens = [(m.lastgroup, m[0]) for m in TOKEN.finditer(text)]
        self.glossary = glossary

    def at(self, i: int) -> tuple[str, str]:
        return self.tokens[i] if 0 <= i < len(self.tokens) else ("", "")

    def past_blank(self, i: int) -> int:
        return i + (self.at(i)[0] == "blank")

    @staticmethod
    def amount(token: str) -> str:
        whole, _, part = token.replace(",", "").partition(".")
        return " ".join([number_words(int(whole)), *([POINT] if part else []), *(NUMBERS[int(d)] for d in part)])

    def after_number(self, i: int) -> tuple[str, int] | None:
        """The number at i with what follows it: a range, a share, a unit or nothing."""
        token, j = self.tokens[i][1], self.past_blank(i + 1)
        kind, sign = self.at(j)
        if kind == "sign" and sign in DASHES and token.isdecimal():
            k = self.past_blank(j + 1)
            beyond = self.at(k + 1)[1][:1]
            if self.at(k)[0] == "number" and self.at(k)[1].isdecimal() and not (beyond.isalnum() or beyond in ("_", ".")):
                return f"{self.amount(token)} {RANGE} {self.amount(self.at(k)[1])}", k + 1
        if sign == "%":
            return f"{self.amount(token)} {SHARE}", j + 1
        if kind in ("word", "degree") and (unit := UNITS.get(sign.lower())):
            return f"{self.amount(token)} {unit}", j + 1
        beyond = self.at(i + 1)[1][:1]
        return None if beyond.isalnum() or beyond == "_" else (self.amount(token), i + 1)

    def money(self, i: int) -> tuple[str, int] | None:
        """An amount that a sign of money at i announces."""
        kind, sign = self.tokens[i]
        if sign != "₹" and not (kind == "word" and sign.endswith("Rs")):
            return None
        j = i + 1 + (sign != "₹" and self.at(i + 1)[1] == ".")
        j = self.past_blank(j)
        return (f"{sign.removesuffix('Rs') if sign != '₹' else ''}{self.amount(self.at(j)[1])} {MONEY}", j + 1) if self.at(j)[0] == "number" else None

    def word(self, token: str) -> str:
        head, mark, tail = token.partition("'")
        if 2 <= len(head) <= 6 and head.isupper() and not tail[:1].isalpha() or head.isupper() and 2 <= len(head) <= 6 and mark:
            return (self.glossary.get(head) or " ".join(LETTERS[c] for c in head)) + mark + tail
        return self.glossary.get(token, token)

    def said(self) -> str:
        out: list[str] = []
        i, before = 0, ""
        while i < len(self.tokens):
            kind, token = self.tokens[i]
            found = self.money(i)
            if not found and kind == "number" and not (before.isalnum() or before in ("_", ".")):
                found = self.after_number(i)
            if found:
                out.append(found[0])
                before, i = self.tokens[found[1] - 1][1][-1:], found[1]
                if self.at(i)[0] == "number":  # what follows a spoken sign of money or share isn't part of it
                    before = ""
                continue
            if token in ("/", *BRACKETS):
                while out and not out[-1].rstrip():
                    out.pop()
                out[-1:] = [x.rstrip() for x in out[-1:]]
                out.append(" " if token == "/" else ", ")
                i = self.past_blank(i + 1)
            else:
                out.append(f" {JOIN} " if token == "&" else self.word(token) if kind == "word" else token)
                i += 1
            before = token[-1:]
        return self.settled("".join(out))

    @staticmethod
    def settled(text: str) -> str:
        """No comma where another end of a phrase follows, no runs of blanks."""
        kept: list[str] = []
        for c in text:
            if c in ",।?!.":
                back = len(kept)
                while back and kept[back - 1].isspace():
                    back -= 1
                if back and kept[back - 1] == ",":
                    del kept[back - 1 :]
            elif c in " \t" and kept and kept[-1] in " \t":
                kept[-1] = " "
                continue
            kept.append(c)
        return "".join(kept).strip()


def voiced(text: str | None, glossary: dict[str, str]) -> str | None:
    """Digits, ranges, shares, money, units and capitals of a reply in words; what is in the glossary as it says. Other texts stay as they are."""
    if not text:
        return text
    plain = text.translate(ASCII)
    reading = Reading(plain, glossary)
    if not any(kind in ("number", "word", "degree") or token in ("%", "₹", "/", *BRACKETS) for kind, token in reading.tokens):
        return text
    said = reading.said()
    return text if said == text.strip() else said


def tts_text(c: Column, glossary: dict[str, str] | None = None) -> Column:
    """`voiced` over a column; the glossary is the caller's own."""
    words = dict(glossary or {})
    read: Callable[[str | None], str | None] = lambda t: voiced(t, words)

    @F.pandas_udf(StringType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(read)

    return run(c)


def unspoken_latin(voiced_text: Column) -> Column:
    """The Latin words left, sorted."""
    return F.sort_array(F.array_distinct(F.regexp_extract_all(voiced_text, F.lit(r"([A-Za-z][A-Za-z']*)"), F.lit(1))))
