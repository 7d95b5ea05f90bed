"""Text pages of PDF files read with the binaryFile source.

A bounded reader for what text PDFs hold: numbered objects (also in object streams), the page
tree, content streams packed with Flate, and the text operators Tj, ' and ". Strings are read
as Latin letters, or by the font's ToUnicode table where it has one. Pages that hold pictures
alone give empty texts, as do encrypted files; what isn't a PDF gives a row with the error.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from belltower.functions.text import normalized

OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)(?:\bendobj\b|\Z)", re.S)
STREAM = re.compile(rb"stream\r?\n")
REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R")
#: In a content stream: strings, hexadecimal strings, arrays, names, numbers and operators.
PIECE = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|[\[\]]|/[^\s/\[\]()<>]*|[-+.0-9]+|[A-Za-z'\"*]+", re.S)
ESCAPE = re.compile(rb"\\([nrtbf()\\]|[0-7]{1,3}|\r?\n)")
PLAIN = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"(": b"(", b")": b")", b"\\": b"\\"}
#: A gap in an array of strings, in thousandths of the letter size, that is as wide as a blank.
GAP = -180


def stream_of(body: bytes, most: int) -> bytes:
    """An object's stream, unpacked to at most so many bytes."""
    m = STREAM.search(body)
    if not m:
        return b""
    data = body[m.end() : body.rfind(b"endstream")]
    if b"/FlateDecode" in body[: m.start()]:
        try:
            return zlib.decompressobj().decompress(data, most)
        except zlib.error:
            return b""
    return data if b"/Filter" not in body[: m.start()] else b""


def objects_of(data: bytes, most: int) -> dict[int, bytes]:
    """Bodies by number; later ones replace earlier ones."""
    found = {int(m[1]): m[2] for m in OBJECT.finditer(data)}
    for body in list(found.values()):
        if b"/ObjStm" in body[:400] and (first := re.search(rb"/First\s+(\d+)", body)):
            inner = stream_of(body, most)
            numbers = [int(x) for x in inner[: int(first[1])].split()]
            starts = numbers[1::2]
            for n, a, b in zip(numbers[::2], starts, [*starts[1:], len(inner)], strict=False):
                found.setdefault(n, inner[int(first[1]) + a : int(first[1]) + b])
    return found


def pages_of(objects: dict[int, bytes]) -> list[bytes]:
    """Bodies of the pages in reading order; without a page tree in the order of their numbers."""
    root = next((b for b in objects.values() if re.search(rb"/Type\s*/Catalog\b", b) and b"/Pages" in b), None)
    out: list[bytes] = []
    top = re.search(rb"/Pages\s+(\d+)", root) if root else None
    todo, seen = [int(top[1])] if top else [], set()
    while todo:
        n = todo.pop()
        body = objects.get(n, b"")
        if n in seen:
            continue
        seen.add(n)
        kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
        if kids:
            todo += [int(x) for x in REFERENCE.findall(kids[1])][::-1]
        elif re.search(rb"/Type\s*/Page\b", body):
            out.append(body)
    return out or [objects[n] for n in sorted(objects) if re.search(rb"/Type\s*/Page\b(?!s)", objects[n])]


def referred(body: bytes, name: bytes, objects: dict[int, bytes]) -> list[bytes]:
    """What an entry refers to: one object or an array of them."""
    m = re.search(name + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
    return [objects.get(int(n), b"") for n in REFERENCE.findall(m[1])] if m else []


def letters_of(font: bytes, objects: dict[int, bytes], most: int) -> dict[bytes, str] | None:
    """Letters by code, from a font's ToUnicode table."""
    table = b"".join(stream_of(x, most) for x in referred(font, b"/ToUnicode", objects))
    if not table:
        return None
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    found: dict[bytes, str] = {}
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", table, re.S):
        found |= {bytes.fromhex(a.decode()): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part)}
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", table, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            size, low, start = len(a) // 2, int(a, 16), text(c)
            for k in range(min(int(b, 16) - low + 1, 65_536)):
                found[(low + k).to_bytes(size, "big")] = start[:-1] + chr(ord(start[-1]) + k)
    return found


def shown(piece: bytes, letters: dict[bytes, str] | None) -> str:
    """A string of a content stream as text."""
    if piece[:1] == b"<":
        raw = re.sub(rb"\s", b"", piece[1:-1])
        raw = bytes.fromhex((raw + b"0" * (len(raw) % 2)).decode())
    else:
        raw = ESCAPE.sub(lambda m: PLAIN.get(m[1]) or (bytes([int(m[1], 8) & 255]) if m[1].isdigit() else b""), piece[1:-1])
    if not letters:
        return raw.decode("utf-16-be", "replace")[1:] if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")
    size = max(map(len, letters))
    return "".join(letters.get(raw[k : k + size], "") for k in range(0, len(raw), size))


def page_text(page: bytes, objects: dict[int, bytes], most: int) -> str:
    """What a page's text operators show; a new line for each move to another line."""
    resources = b"".join([page, *referred(page, b"/Resources", objects)])
    fonts = re.search(rb"/Font\s*<<(.*?)>>", b"".join([resources, *(b"/Font<<" + x + b">>" for x in referred(resources, b"/Font", objects))]), re.S)
    tables = {name: letters_of(objects.get(int(n), b""), objects, most) for name, n in re.findall(rb"(/[^\s/]+)\s+(\d+)\s+\d+\s+R", fonts[1])} if fonts else {}
    out: list[str] = []
    held: list[bytes] = []
    letters = None
    for piece in PIECE.findall(b"\n".join(stream_of(x, most) for x in referred(page, b"/Contents", objects))):
        if piece[:1] in b"(<[]/" or piece[:1] in b"+-.0123456789":
            held.append(piece)
            continue
        if piece == b"Tf":
            letters = next((tables.get(x) for x in held if x[:1] == b"/"), None)
        elif piece in (b"Td", b"TD", b"Tm", b"T*", b"ET"):
            moved = piece not in (b"Td", b"TD") or len(held) < 2 or float(held[-1] or 0) != 0
            out.append("\n" if moved else " ")
        elif piece in (b"Tj", b"'", b'"', b"TJ"):
            out += ["\n"] if piece in (b"'", b'"') else []
            for x in held:
                if x[:1] in b"(<":
                    out.append(shown(x, letters))
                elif piece == b"TJ" and x[:1] not in b"[]/" and float(x) < GAP:
                    out.append(" ")
        held.clear()
    return "".join(out)


def pages(files: DataFrame, most: int = 64_000_000) -> DataFrame:
    """(path, page_number, text, error): a row for each page, or one with the error of an unreadable file. most: bytes that a stream may unpack to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                found: list[str | None] = []
                error = None
                if not data.lstrip(b"\0").startswith(b"%PDF-"):
                    error = "no PDF header"
                else:
                    try:
                        objects = objects_of(data, most)
                        found = ["" if b"/Encrypt" in data else page_text(p, objects, most) for p in pages_of(objects)]
                    except (ValueError, IndexError, OverflowError) as e:
                        error = str(e) or type(e).__name__
                    if not found and not error:
                        error = "no pages"
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * max(n, 1)), pa.array(range(1, n + 1) if n else [None], pa.int32()), pa.array(found or [None], pa.string()), pa.array([error] * max(n, 1), pa.string())],
                    names=["path", "page_number", "text", "error"],
                )

    made = files.select("path", "content").mapInArrow(run, "path string, page_number int, text string, error string")
    return made.withColumn("text", normalized(F.col("text")))
