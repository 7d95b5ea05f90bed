"""Media columns: Netpbm and BMP files to numpy arrays, area resizing by integral images, NPY tiles, difference hashes.

Cases: a null or unreadable file gives null tile and hash, and the reason in `error`; repeated
files give equal rows; an empty table gives an empty result; other columns are not read.
Payload columns: a null text is empty and fills one row of samples with zeros.
"""

from __future__ import annotations

import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from belltower.llm.common import by_batch, sha256, utf8

#: Samples in a row of the images that hold payloads.
WIDTH = 64
_HEADER = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


def netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as uint8 (uint16 where maxval is over 255): (h, w) or (h, w, 3). Bitmaps: 0 is black."""
    kind, at, fields = data[:2], 2, []
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not Netpbm")
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        m = _HEADER.match(data, at)
        if not m:
            raise ValueError("short header")
        fields.append(int(m[1]))
        at = m.end()
    w, h, top = (*fields, 1)[:3]
    if w < 1 or h < 1 or not 0 < top < 65536:
        raise ValueError("bad size")
    shape = (h, w, 3) if kind in (b"P3", b"P6") else (h, w)
    count = int(np.prod(shape))
    if kind in (b"P4", b"P5", b"P6"):
        body = data[at + 1 :]
        if kind == b"P4":
            row = (w + 7) // 8
            bits = np.unpackbits(np.frombuffer(body, np.uint8, row * h).reshape(h, row), axis=1)[:, :w]
            return ((1 - bits) * 255).astype(np.uint8)
        if top < 256:
            return np.frombuffer(body, np.uint8, count).reshape(shape)
        return np.frombuffer(body, ">u2", count).astype(np.uint16).reshape(shape)
    body = re.sub(rb"#[^\n]*", b" ", data[at:])
    values = [c for c in body if c in b"01"] if kind == b"P1" else body.split()
    if len(values) < count:
        raise ValueError("short data")
    if kind == b"P1":
        return ((49 - np.array(values[:count])) * 255).astype(np.uint8).reshape(shape)
    return np.array([int(v) for v in values[:count]]).astype(np.uint8 if top < 256 else np.uint16).reshape(shape)


def bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits a pixel as uint8 (h, w, 3)."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not BMP")
    start, head, w, h, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if bits not in (8, 24, 32) or packed not in (0, 3) or w < 1 or h == 0:
        raise ValueError("unsupported BMP")
    row = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, row * abs(h), start).reshape(abs(h), row)
    if h > 0:
        rows = rows[::-1]
    if bits == 8:
        n = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.zeros((256, 3), np.uint8)
        palette[:n] = np.frombuffer(data, np.uint8, 4 * n, 14 + head).reshape(n, 4)[:, 2::-1]
        return palette[rows[:, :w]]
    return rows[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1]


def decoded(data: bytes) -> np.ndarray:
    return bmp(data) if data[:2] == b"BM" else netpbm(data)


def pgm(samples: np.ndarray) -> bytes:
    """A grey image of 8-bit samples as binary Netpbm."""
    h, w = samples.shape
    return b"P5\n%d %d\n255\n" % (w, h) + samples.tobytes()


def grey(image: np.ndarray) -> np.ndarray:
    return image.astype(np.float64) if image.ndim == 2 else image.astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the source area under every target pixel, from one integral image read at fractional corners."""
    h, w = image.shape
    total = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(image, axis=0), axis=1, out=total[1:, 1:])
    y, x = np.linspace(0, h, height + 1), np.linspace(0, w, width + 1)
    y0, x0 = np.minimum(y.astype(int), h - 1), np.minimum(x.astype(int), w - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    top, low = total[y0], total[y0 + 1]
    rows = top * (1 - fy) + low * fy
    at = rows[:, x0] * (1 - fx) + rows[:, x0 + 1] * fx
    return (at[1:, 1:] - at[:-1, 1:] - at[1:, :-1] + at[:-1, :-1]) / ((h / height) * (w / width))


def difference_hash(image: np.ndarray) -> str:
    """64 bits: whether each pixel of an 8 x 9 reduction is darker than its right neighbour."""
    small = np.round(resized(image, 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(array), allow_pickle=False)
    return out.getvalue()


def tiles(media: DataFrame, key: str, data: str, height: int = 32, width: int = 32) -> DataFrame:
    """For every file: its shape, an NPY tile of height x width grey samples, the difference hash, or the error."""

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        h, w, tile, mark, error = [], [], [], [], []
        for x in b.column(data).to_pylist():
            try:
                if x is None:
                    raise ValueError("null")
                image = grey(decoded(x))
                row = (*image.shape, npy(np.round(resized(image, height, width)).astype(np.uint8)), difference_hash(image), None)
            except (ValueError, struct.error, IndexError) as e:
                row = (None, None, None, None, str(e)[:200])
            for out, v in zip((h, w, tile, mark, error), row, strict=True):
                out.append(v)
        return pa.RecordBatch.from_arrays([b.column(key), pa.array(h, pa.int32()), pa.array(w, pa.int32()), pa.array(tile, pa.binary()), pa.array(mark, pa.string()), pa.array(error, pa.string())], names=[key, "height", "width", "tile", "dhash", "error"])

    kept = media.select(key, data)
    return by_batch(kept, f, f"`{key}` {kept.schema[key].dataType.simpleString()}, height int, width int, tile binary, dhash string, error string")


def payload(text: bytes) -> bytes:
    """The text followed by zeros up to a positive multiple of WIDTH bytes."""
    return text.ljust(max(WIDTH, -(-len(text) // WIDTH) * WIDTH), b"\0")


def stored(text: bytes) -> bytes:
    """The payload as the samples of a grey image, losslessly."""
    return pgm(np.frombuffer(payload(text), np.uint8).reshape(-1, WIDTH))


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id and, for its text stored as an image: the stored file, the samples read back from it, an NPY tile and the hash."""

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        files = [stored(t) for t in utf8(b.column("text"))]
        images = [decoded(x) for x in files]
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(files, pa.binary()), pa.array([x.tobytes() for x in images], pa.binary()), pa.array([npy(np.round(resized(grey(x), 32, 32)).astype(np.uint8)) for x in images], pa.binary()), pa.array([difference_hash(grey(x)) for x in images])],
            names=["doc_id", "media", "samples", "tile", "dhash"],
        )

    return by_batch(docs.select("doc_id", "text"), f, "doc_id long, media binary, samples binary, tile binary, dhash string")


def digest(docs: DataFrame) -> DataFrame:
    """Sizes and digests of every stored text, all computed from the bytes read back."""

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[list] = [[] for _ in range(7)]
        for text in utf8(b.column("text")):
            media = stored(text)
            image = decoded(media)
            back = image.tobytes()
            tile = npy(np.round(resized(grey(image), 32, 32)).astype(np.uint8))
            for out, v in zip(rows, (len(text), len(back), sha256(back), zlib.crc32(back[-WIDTH:]), len(media), sha256(media), f"{difference_hash(grey(image))}:{zlib.crc32(tile):08x}"), strict=True):
                out.append(v)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(r, pa.string() if k in (2, 5, 6) else pa.int64()) for k, r in enumerate(rows))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return by_batch(docs.select("doc_id", "text"), f, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
