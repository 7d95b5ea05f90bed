"""WAV files to rows and back."""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Samples of one output row: a long clip becomes several rows.
BLOCK = 65_536
#: Bytes of a plain header and, at most, of the samples of a short clip; rows that are looked at together.
HEADER, SHORT, TOGETHER = 44, 8192, 1000


def mono(raw: bytes, width: int, channels: int) -> np.ndarray:
    """PCM of 8, 16, 24 or 32 bits as -1..1, channels averaged; a broken last frame is left out."""
    size = width * channels
    raw = raw[: len(raw) // size * size]
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(float) - 128
    elif width in (2, 4):
        x = np.frombuffer(raw, f"<i{width}").astype(float)
    elif width == 3:
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        x = wide.reshape(-1).view("<i4").astype(float) / 256
    else:
        raise ValueError(f"{width} bytes a sample")
    return (x / 2.0 ** (8 * width - 1)).reshape(-1, channels).mean(axis=1)


def usual(content: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which files are short clips as `wav_bytes` writes them (16 bits, mono, a plain header and nothing else), and of these the rates, the ends of each one's samples in all, and the samples in -1..1."""
    content = content.cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(content.buffers()[1], np.int64)[content.offset : content.offset + len(content) + 1]
    data = np.frombuffer(content.buffers()[2] or b"", np.uint8)
    size = np.diff(at)
    some = np.flatnonzero((size >= HEADER) & (size <= HEADER + SHORT))
    head = data[at[some][:, None] + np.arange(HEADER)]
    number = lambda k, n: np.ascontiguousarray(head[:, k : k + n]).view(f"<u{n}")[:, 0].astype(np.int64)
    words = np.frombuffer(b"RIFFWAVEfmt data", np.uint8)
    plain = (head[:, [*range(4), *range(8, 16), *range(36, 40)]] == words).all(axis=1)
    for k, n, value in ((4, 4, size[some] - 8), (16, 4, 16), (20, 2, 1), (22, 2, 1), (34, 2, 16), (40, 4, size[some] - HEADER)):
        plain &= number(k, n) == value
    rate = number(24, 4)
    plain &= (rate > 0) & (size[some] % 2 == 0)
    some, rate = some[plain], rate[plain]
    n = size[some] - HEADER
    ends = np.cumsum(n)
    raw = data[np.arange(n.sum()) + np.repeat(at[some] + HEADER - (ends - n), n)]
    return some, rate, ends // 2, raw.view("<i2") / 2.0**15


def clips(files: DataFrame) -> DataFrame:
    """(path, rate, channels, width, seconds, part, samples, error) of WAV files read with the binaryFile source; unreadable ones give one row with the error. Short plain clips are read together."""
    names = ["path", "rate", "channels", "width", "seconds", "part", "samples", "error"]

    def each(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
            try:
                with wave.open(io.BytesIO(data)) as w:
                    rate, channels, width, n = w.getframerate(), w.getnchannels(), w.getsampwidth(), w.getnframes()
                    x = mono(w.readframes(n), width, channels)
                parts = [x[k : k + BLOCK] for k in range(0, max(len(x), 1), BLOCK)]
                error = None
            except (wave.Error, EOFError, ValueError, ZeroDivisionError) as e:
                rate = channels = width = n = None
                parts, error = [None], str(e) or type(e).__name__
            m = len(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * m), pa.array([rate] * m, pa.int32()), pa.array([channels] * m, pa.int32()), pa.array([width] * m, pa.int32()), pa.array([n / rate if rate else None] * m, pa.float64()), pa.array(range(m), pa.int32()), pa.array(parts, pa.list_(pa.float64())), pa.array([error] * m, pa.string())],
                names=names,
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(k, TOGETHER) for k in range(0, whole.num_rows, TOGETHER)):
                some, rate, ends, x = usual(b.column("content"))
                m, same = len(some), lambda v, n: pa.array(np.full(n, v, np.int32))
                if m:
                    samples = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(x))
                    yield pa.RecordBatch.from_arrays([b.column("path").take(pa.array(some)), pa.array(rate, pa.int32()), same(1, m), same(2, m), pa.array(np.diff(ends, prepend=0) / rate), same(0, m), samples, pa.nulls(m, pa.string())], names=names)
                yield from each(b.take(pa.array(np.setdiff1d(np.arange(b.num_rows), some))))

    return files.select("path", "content").mapInArrow(run, "path string, rate int, channels int, width int, seconds double, part int, samples array<double>, error string")


def sample_rows(found: DataFrame) -> DataFrame:
    """(clip_id, i, x), as the level functions take it."""
    return found.where("error IS NULL").select(F.col("path").alias("clip_id"), "part", F.posexplode("samples").alias("k", "x")).select("clip_id", (F.col("part") * BLOCK + F.col("k")).alias("i"), "x")


def wav_bytes(samples: Column, rate: int) -> Column:
    """Samples of -1..1 as a 16-bit mono WAV file, rounded and clipped."""

    @F.arrow_udf("binary")
    def run(values: pa.Array) -> pa.Array:
        n = np.asarray(pc.fill_null(pc.list_value_length(values), 0), np.int64)
        x = np.nan_to_num(np.asarray(values.flatten().cast(pa.float64()).fill_null(0.0)), posinf=2.0, neginf=-2.0)
        pcm = np.clip(np.round(x * 32767), -32768, 32767).astype("<i2").view(np.uint8)
        heads = np.tile(np.frombuffer(struct.pack("<4sI8sIHHIIHH4sI", b"RIFF", 0, b"WAVEfmt ", 16, 1, 1, rate, 2 * rate, 2, 16, b"data", 0), np.uint8), (len(n), 1))
        for k, size in ((4, 2 * n + HEADER - 8), (40, 2 * n)):
            heads[:, k : k + 4] = size.astype("<u4")[:, None].view(np.uint8)
        ends = np.cumsum(2 * n + HEADER)
        at = (ends - 2 * n - HEADER)[:, None] + np.arange(HEADER)
        out, media = np.empty(ends[-1] if len(ends) else 0, np.uint8), np.ones(ends[-1] if len(ends) else 0, bool)
        out[at], media[at] = heads, False
        out[media] = pcm
        made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(out)])
        return pc.if_else(values.is_valid(), made, pa.scalar(None, pa.large_binary())).cast(pa.binary())

    return run(samples)
