"""Personal data: exact patterns, and a linear-chain conditional random field over word shapes.

The field is trained in numpy from a small labelled table, and decoded by Viterbi over
batches of lines. It finds what the patterns leave: local telephone numbers, access tokens,
addresses with odd endings. Pattern spans always stay; a span of the field is added where it
overlaps none of them.

Cases: a null or empty text has no spans; long texts are read whole; repeated rows give
repeated results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from belltower.llm.common import in_arrow, sha256, slices, texts

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: A match can't begin inside a run of digits, nor end inside one: so says this form, which takes time in proportion to the text.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LABELS = ("O", "email", "ip", "card", "phone", "secret")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Every span must hold one of these, so only lines with one are decoded, and texts without one have no spans.
MARKED = re.compile(r"[0-9@]")
FEATURES = 4096
#: Characters of texts whose marked lines are decoded at a time, at most, but for a longer text; words, and looks of words, that a task remembers.
TOGETHER, KNOWN, LOOKS = 20_000, 20_000, 2_000
#: Shapes of ASCII letters and digits.
ASCII_SHAPES = {c: "A" if chr(c).isupper() else "a" if chr(c).islower() else "0" for c in range(128) if chr(c).isalnum()}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def octet(s: str) -> bool:
    """Whether a run of ASCII digits, however long, is at most 255."""
    return len(s := s.lstrip("0")) < 4 and int(s or 0) <= 255


def emails(text: str) -> list[tuple[int, int]]:
    """What `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+` finds: from each sign back to where its name begins, then on through its domain."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = last + len(text[last:at].rstrip(LOCAL))
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", last)
    return found


def pattern_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; matches that fail their test are dropped, without another try."""
    found = []
    if "@" in text:
        found += [("email", *x) for x in emails(text)]
    if "." in text:
        found += [("ip", *m.span()) for m in IP.finditer(text) if all(map(octet, m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return found


def shape(word: str) -> str:
    """Character classes with runs cut to two: letters a, capitals A, digits 0, other signs as they are."""
    if word.isascii():
        s = word.translate(ASCII_SHAPES)
    else:
        s = re.sub(r"[^\W\d_]", lambda m: "A" if m[0].isupper() else "a", word)
        s = re.sub(r"[0-9]", "0", s)
    return re.sub(r"(.)\1\1+", r"\1\1", s)[:24]


NAMES = ("token", "key", "password", "secret", "tel", "phone", "call", "card", "mail", "email", "api_key", "ip")


def look(word: str) -> tuple:
    """What the features of a word tell: words of the same look have the same features."""
    core = word.strip(".,;:!?()\"'")
    size = min(len(core), 40) // 4
    name = core.lower() if core.lower() in NAMES else None
    if core.isalpha():  # no digits and no signs
        return shape(core), size, 0, False, False, False, 0, False, False, False, name
    digits = len(digits_of(core))
    letters = sum(c.isalpha() for c in core)
    hexadecimal = len(core) >= 20 and all(c in "0123456789abcdefABCDEF\"'" for c in core)
    octets = core.count(".") == 3 and all(p.isascii() and p.isdecimal() and octet(p) for p in core.split("."))
    return shape(core), size, min(digits, 20), digits > 2 and letters > 2, hexadecimal and digits > 3 and letters > 1, "@" in core, min(core.count("."), 4), core.endswith("=") or core.startswith("="), core.isascii() and core.isdecimal() and luhn(core), octets, name


#: The features of a look, in its order; the last one only if there is a name.
ASPECTS = ("shape", "size", "digits", "mixed", "hex", "at", "dots", "equals", "luhn", "octets", "word")


def word_features(seen: tuple) -> list[str]:
    """The features of words of a look."""
    return ["bias", *(f"{a}={x}" for a, x in zip(ASPECTS, seen, strict=True) if x is not None)]


def slots(seen: tuple, where: str) -> list[int]:
    """Places of a look's features in the weights; where: this word, the one before or after."""
    return [zlib.crc32(f"{where}|{f}".encode()) % FEATURES for f in word_features(seen)]


@dataclass
class Field:
    emit: np.ndarray  # (FEATURES, K)
    move: np.ndarray  # (K, K)

    def of_word(self, word: str, memory: tuple[dict, dict]) -> np.ndarray:
        """What a word adds to its own scores, to the next word's and to those of the word before. memory: of words, and of looks."""
        words, looks = memory
        if (s := words.get(word)) is None:
            if (s := looks.get(seen := look(word))) is None:
                if len(looks) >= LOOKS:
                    looks.clear()
                looks[seen] = s = np.concatenate([self.emit[slots(seen, x)].sum(0) for x in ("this", "before", "after")])
            if len(words) >= KNOWN:
                words.clear()
            words[word] = s
        return s

    def scores(self, lines: list[list[str]], memory: tuple[dict, dict]) -> list[np.ndarray]:
        """Emission scores of the words of lines that have some."""
        k, ends = self.emit.shape[1], np.cumsum([len(x) for x in lines])
        parts = np.concatenate([self.of_word(w, memory) for x in lines for w in x]).reshape(-1, 3, k)
        inner = np.ones(len(parts) - 1, bool)  # whether a word's next one is of its line
        inner[ends[:-1] - 1] = False
        out = parts[:, 0].copy()
        out[1:][inner] += parts[:-1, 1][inner]
        out[:-1][inner] += parts[1:, 2][inner]
        return np.split(out, ends[:-1])


def viterbi(lines: list[np.ndarray], move: np.ndarray) -> list[np.ndarray]:
    """Best label sequences of many lines at once, longest first so that the batch shrinks as lines end."""
    order = sorted(range(len(lines)), key=lambda i: -len(lines[i]))
    sizes = np.array([len(lines[i]) for i in order], int)
    if not len(sizes) or not sizes[0]:
        return [np.zeros(0, int) for _ in lines]
    # the lines one after the other; step by step, how many still go on
    words, starts = np.concatenate([lines[i] for i in order]), np.cumsum(sizes) - sizes
    live = np.searchsorted(-sizes, -np.arange(sizes[0]))
    best = words[starts[: live[0]]]
    back = []
    for t in range(1, sizes[0]):
        n = live[t]
        reach = best[:n, :, None] + move
        back.append(reach.argmax(1).astype(np.int8))
        best[:n] = reach.max(1) + words[starts[:n] + t]
    label, path = best.argmax(1), np.zeros(len(words), int)
    for t in range(sizes[0] - 1, 0, -1):
        n = live[t]
        path[starts[:n] + t] = label[:n]
        label[:n] = back[t - 1][np.arange(n), label[:n]]
    path[starts[: live[0]]] = label
    found = dict(zip(order, np.split(path, starts[1:]), strict=True))
    return [found[i] for i in range(len(lines))]


#: The labelled sentences: what stands in braces is of the kind named, all other words are nobody's. Values are made for each.
SENTENCES = """
Please write to {email} before the end of the week .
Questions ? Send them to {email} , we answer within two days .
Contact : {email}
Our office can be reached at {phone} or by mail at {email} .
Call {phone} between nine and five .
Ring me on {local} after lunch , thanks !
The number is {local} .
Tel {local} and fax {local}
Reach the front desk : {phone} , extension 12 .
Llame al {phone} si tiene preguntas .
Schreiben Sie bitte an {email} oder rufen Sie {phone} an .
Le bureau est ouvert ; appelez le {local} .
My card {card} was charged twice last month .
Pay with {card} and keep the receipt .
Cards on file : {card} {card}
Card {card} , expires 11/27 .
The server at {ip} does not answer .
Requests from {ip} and {ip} were blocked .
ping {ip} took 30 ms
api_key = {secret}
token = "{secret}"
The secret {secret} must not be shared .
password : {secret} .
key "{secret}" is for tests , rotate it
the token "{secret}" and the key {secret}
{email}
{phone}
{local}
{ip}
{card}
{secret}
Version 4.2.1 was released in 2019 with 35 fixes .
The ratio rose from 0.25 to 0.75 , that is 200% .
On 2021-03-14 about 1,500 people came .
Chapter 7 has 12 pages and 3 tables .
It costs 19.99 a month or 199 a year .
Order {number} was shipped on day 3 .
Room 101 , floor 2 , building B12 .
Meet @ noon , table 4 .
See section 999.888.777.666 of the index .
Item == 5 , count != 10 , total >= 100 ###
Il y a 3 chats et 12 chiens dans la rue .
Der Zug um 14:35 hat 10 Minuten Verspätung .
Hay 25 alumnos en la clase número 8 !!
THE TOTAL IS 42 && THE REST IS 7 ...
The score was 3-2 after 90 minutes .
Add 250 g of flour , 2 eggs and 100 ml of milk .
"""


def labelled_table(rounds: int = 8) -> list[tuple[list[str], list[str]]]:
    """The small labelled table: words and their labels of SENTENCES with made values, the same each time."""
    rng = np.random.default_rng(7)
    pick = lambda x: x[int(rng.integers(len(x)))]
    number = lambda n: "".join(str(int(d)) for d in rng.integers(0, 10, n))

    def checked(n: int, valid: bool) -> str:
        head = number(n - 1)
        return next(x for x in (head + str(d) for d in range(10)) if luhn(x) == valid)

    def value(kind: str) -> tuple[list[str], str]:
        if kind == "email":
            return [f"{pick(['anna', 'j.smith', 'office', 'maria', 'b_lee', 'info', 'karl'])}{pick(['', number(2)])}@{pick(['example', 'mail', 'post', 'my-firm'])}{pick(['', number(1)])}.{pick(['com', 'org', 'net', 'co.uk'])}"], "email"
        if kind == "ip":
            return [".".join(str(int(x)) for x in rng.integers(0, 256, 4))], "ip"
        if kind == "card":
            return [checked(16, True)], "card"
        if kind == "phone":
            return [f"+{number(1)}", f"({number(3)})", f"{number(3)}-{number(4)}"], "phone"
        if kind == "local":
            return [f"({number(3)})", f"{number(3)}-{number(4)}"], "phone"
        if kind == "secret":
            return ["".join(pick("0123456789abcdef") for _ in range(40))], "secret"
        return [checked(16, False)], "O"

    rows = []
    for sentence in SENTENCES.strip().splitlines() * rounds:
        words: list[str] = []
        labels: list[str] = []
        for w in sentence.split():
            if m := re.fullmatch(r"(\W*)\{(\w+)\}(\W*)", w):
                found, label = value(m[2])
                words += [m[1] + found[0], *found[1:]] if m[1] else found
                words[-1] += m[3] or pick(["", "", ".", ","])
                labels += [label] * len(found)
            else:
                words.append(w)
                labels.append("O")
        rows.append((words, labels))
    return rows


def summed(rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows (m, k) of each place, in their order: (n, k)."""
    return np.stack([np.bincount(at, column, n) for column in rows.T], 1)


def trained(rows: list[tuple[list[str], list[str]]], rounds: int = 60, ridge: float = 1e-3) -> Field:
    """Weights that maximise the penalised log-likelihood, by gradient steps with per-weight rates over the whole (small, bounded) table."""
    k = len(LABELS)
    size = max(len(w) for w, _ in rows)
    gold = np.zeros((len(rows), size), int)
    mask = np.zeros((len(rows), size), bool)
    entries, owner = [], []
    for r, (words, labels) in enumerate(rows):
        mask[r, : len(words)] = True
        gold[r, : len(words)] = [LABELS.index(x) for x in labels]
        for i, _ in enumerate(words):
            s = slots(look(words[i]), "this") + (slots(look(words[i - 1]), "before") if i else []) + (slots(look(words[i + 1]), "after") if i + 1 < len(words) else [])
            entries += s
            owner += [r * size + i] * len(s)
    entries, owner = np.array(entries), np.array(owner)
    emit, move = np.zeros((FEATURES, k)), np.zeros((k, k))
    g2e, g2m = np.full_like(emit, 1e-8), np.full_like(move, 1e-8)
    hot = np.eye(k)[gold] * mask[:, :, None]
    both = mask[:, 1:] & mask[:, :-1]
    seen_moves = np.einsum("rta,rtb->ab", hot[:, :-1] * both[:, :, None], hot[:, 1:])
    for _ in range(rounds):
        s = summed(emit[entries], owner, len(rows) * size).reshape(len(rows), size, k)
        a, b = np.zeros_like(s), np.zeros_like(s)
        a[:, 0] = s[:, 0]
        for t in range(1, size):
            step = s[:, t] + np.logaddexp.reduce(a[:, t - 1, :, None] + move, axis=1)
            a[:, t] = np.where(mask[:, t, None], step, a[:, t - 1])
        for t in range(size - 2, -1, -1):
            step = np.logaddexp.reduce(move + (s[:, t + 1] + b[:, t + 1])[:, None, :], axis=2)
            b[:, t] = np.where(mask[:, t + 1, None], step, 0)
        z = np.logaddexp.reduce(a[:, -1], axis=1)
        p = np.exp(np.where(mask[:, :, None], a + b - z[:, None, None], -np.inf))
        pair = np.exp(np.where(both[:, :, None, None], a[:, :-1, :, None] + move + (s[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None], -np.inf)).sum((0, 1))
        ge = summed((hot - p).reshape(-1, k)[owner], entries, FEATURES)
        ge, gm = ge - ridge * len(rows) * emit, seen_moves - pair - ridge * len(rows) * move
        g2e += ge**2
        g2m += gm**2
        emit += 0.5 * ge / np.sqrt(g2e)
        move += 0.5 * gm / np.sqrt(g2m)
    return Field(emit, move)


def whole(label: str, word: str) -> bool:
    """Whether a word is an entity by itself, so that what follows it is another one."""
    return label in ("email", "ip", "secret") or label == "card" and len(digits_of(word)) >= 16


def field_spans(field: Field, texts: list[str], memory: tuple[dict, dict]) -> list[list[tuple[str, int, int]]]:
    """For each text the spans of equal labels in its marked lines; edge punctuation is no part of a span, and a card must pass its check digit."""
    lines, words = [], []
    for n, text in enumerate(texts):
        start = 0
        for line in text.split("\n"):
            if MARKED.search(line) and (own := WORD.findall(line)):
                lines.append((n, start, line))
                words.append(own)
            start += len(line) + 1
    found: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    paths = viterbi(field.scores(words, memory), field.move) if lines else []
    for (n, start, line), own, labels in zip(lines, words, paths, strict=True):
        if not labels.any():
            continue
        text, path, places = texts[n], labels.tolist(), [start + m.start() for m in WORD.finditer(line)]
        i = 0
        while i < len(path):
            j = i
            while j + 1 < len(path) and path[j + 1] == path[i] and not whole(LABELS[path[i]], own[j]):
                j += 1
            if path[i]:
                a, b = places[i], places[j] + len(own[j])
                while a < b and text[a] in "\"'<[":
                    a += 1
                while b > a and text[b - 1] in ".,;:!?\"'>]#$%&*|":
                    b -= 1
                if MARKED.search(text, a, b) and (LABELS[path[i]] != "card" or luhn(digits_of(text[a:b]))):
                    found[n].append((LABELS[path[i]], a, b))
            i = j + 1
    return found


def spans(field: Field, texts: list[str], memory: tuple[dict, dict]) -> Iterator[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """For each text its pattern spans; and all its spans, by kind as listed (others after), then start."""
    order = {x: i for i, x in enumerate((*KINDS, "secret"))}
    for text, added in zip(texts, field_spans(field, texts, memory), strict=True):
        base, more = pattern_spans(text), []
        if added:
            taken = sorted((a, b) for _, a, b in base)
            starts = np.array([a for a, _ in taken] or [len(text) + 1])
            ends = np.maximum.accumulate(np.array([b for _, b in taken] or [len(text) + 1]))
            for kind, a, b in added:
                k = int(np.searchsorted(starts, b))
                if not taken or k == 0 or ends[k - 1] <= a:
                    more.append((kind, a, b))
        yield base, sorted(base + more, key=lambda x: (order[x[0]], x[1], x[2]))


def grouped(texts: list[str], size: int = TOGETHER) -> Iterator[list[str]]:
    """The texts in runs that have size characters at most, or are one text."""
    held, n = [], 0
    for text in texts:
        if held and n + len(text) > size:
            yield held
            held, n = [], 0
        held.append(text)
        n += len(text)
    if held:
        yield held


def written(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, counts and digest of pattern spans, and all spans of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(field or trained(labelled_table()))

    def f(b: pa.RecordBatch, memory: tuple[dict, dict]) -> pa.RecordBatch:
        column = b.column("text")
        marked = pc.fill_null(pc.match_substring_regex(column, MARKED.pattern), False)
        found = chain.from_iterable(spans(shared.value, some, memory) for some in grouped(texts(column.filter(marked))))
        counts: dict[str, list[int]] = {k: [] for k in KINDS}
        digests, everything = [], []
        for some in marked.to_pylist():
            base, both = next(found) if some else ([], [])
            for k in KINDS:
                counts[k].append(sum(x == k for x, _, _ in base))
            digests.append(sha256(written(base).encode()))
            everything.append(written(both))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(digests), pa.array(everything)], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: tuple[dict, dict] = ({}, {})
        for b in batches:
            for part in slices(b):
                yield f(part, memory)

    return in_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
