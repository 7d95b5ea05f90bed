"""Audio of packet flows: payloads put in order, gaps filled, joined in runs of bounded length; levels and comparison with a reference run by run."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from belltower.operators.scan import MOST, running, scanned
from belltower.operators.sequences import beside, quantiles, unwrapped, with_previous
from belltower.sources.stored import settled

PCMU, PCMA = 0, 8
#: Samples of a run, about; samples of a frame; the longest part of a reference that is searched for.
RUN, FRAME, SEGMENT = 80_000, 160, 16_000
#: Samples of short runs that are worked on at once.
TOGETHER = 2_000_000
FULL = 32768.0


def tables() -> dict[int, np.ndarray]:
    """The 16-bit sample of every byte, by payload type."""
    u, a = np.arange(256) ^ 0xFF, np.arange(256) ^ 0x55
    of_u = ((u & 15) * 8 + 132) * (1 << (u >> 4 & 7)) - 132
    of_a = np.where(a >> 4 & 7, ((a & 15) * 16 + 0x108) << np.maximum((a >> 4 & 7) - 1, 0), (a & 15) * 16 + 8)
    return {PCMU: np.where(u >= 128, -of_u, of_u), PCMA: np.where(a >= 128, of_a, -of_a)}


def placed(packets: DataFrame, key: str, seq: str, media: str, *order: str, usual: int = FRAME, most: int = MOST) -> DataFrame:
    """packets with `extended` number and `at`: the sample that each begins at when every missing number stands for `usual` samples of silence. Of packets of one number the first stays; only G.711 counts (column payload_type)."""
    names = packets.columns
    voice = unwrapped(packets, key, seq, *order, most=most).where(F.col("payload_type").isin(PCMU, PCMA))
    first = voice.groupBy(key, "extended").agg(F.min_by(F.struct(*names), F.struct(*order)).alias("p")).select("extended", "p.*")
    p = with_previous(first, key, {"__before": "extended"}, ("extended",), most)
    p = p.withColumn("__gap", F.coalesce(F.col("extended") - F.col("__before") - 1, F.lit(0)) * usual).withColumn("__n", F.octet_length(media))
    p = scanned(p, key, ("extended",), {"__to": running(F.col("__gap") + F.col("__n"))})
    return p.select(*names, "extended", (F.col("__to") - F.col("__n")).alias("at"))


def bounded(sizes: np.ndarray, most: int = TOGETHER) -> Iterator[slice]:
    """Rows one after the other, as many together as come to about `most` in all."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")), at + 1)
        yield slice(at, to)
        at = to


def bytes_of(media: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an array of binaries, and how many each has."""
    media = media.cast(pa.large_binary())
    at = np.frombuffer(media.buffers()[1], np.int64)[media.offset : media.offset + len(media) + 1]
    return np.frombuffer(media.buffers()[2] or b"", np.uint8)[at[0] : at[-1]], np.diff(at)


def runs(found: DataFrame, key: str, media: str, run: int = RUN) -> DataFrame:
    """(key, run, start, samples): the 16-bit samples from the first packet that begins in a run up to the first of the next, with silence in place of what is missing. found: as `placed` gives it."""
    one = found.groupBy(key, F.floor(F.col("at") / run).alias("run")).agg(F.sort_array(F.collect_list(F.struct("at", "payload_type", F.col(media).alias("media")))).alias("p"))
    type_ = found.schema[key].dataType.simpleString()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = tables()
        linear = np.concatenate([of[PCMU], of[PCMA]]).astype(np.int16)
        for b in batches:
            p = b.column("p")
            first, ends = np.asarray(p.offsets)[:-1], np.asarray(p.offsets)[1:]
            size = np.diff(np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(p.flatten().field("media")), np.int64))])[np.asarray(p.offsets) - p.offsets[0].as_py()])
            for rows in bounded(size):
                lo, hi = first[rows][0], ends[rows][-1]
                parts = p.values.slice(lo, hi - lo)
                at, type_of = np.asarray(parts.field("at"), np.int64), np.asarray(parts.field("payload_type"))
                data, n = bytes_of(parts.field("media"))
                begins, last = first[rows] - lo, ends[rows] - lo - 1
                start = at[begins]
                length = at[last] + n[last] - start
                base = np.cumsum(length) - length
                out = np.zeros(int(length.sum()), np.int16)
                place = at + np.repeat(base - start, ends[rows] - first[rows])
                out[np.arange(len(data)) + np.repeat(place - (np.cumsum(n) - n), n)] = linear[np.repeat(np.where(type_of == PCMA, 256, 0), n) + data]
                samples = pa.ListArray.from_arrays(pa.array(np.concatenate([base, [len(out)]]), pa.int32()), pa.array(out))
                yield pa.RecordBatch.from_arrays([b.column(key)[rows], b.column("run")[rows], pa.array(start), samples], names=[key, "run", "start", "samples"])

    return settled(one.mapInArrow(join, f"`{key}` {type_}, run long, start long, samples array<short>"))


def each_run(rows: DataFrame, key: str, schema: str, f) -> DataFrame:
    """Rows (key, *schema) that f(start, samples, row) yields for every run; row: its other columns."""
    type_ = rows.schema[key].dataType.simpleString()
    names = [part.split()[0] for part in schema.split(", ")]
    others = [c for c in rows.columns if c not in (key, "samples")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                samples = np.asarray(b.column("samples")[i].values).astype(float)
                made = list(f(samples, {c: b.column(c)[i].as_py() for c in others}))
                if made:
                    keys = pa.array([b.column(key)[i].as_py()] * len(made), b.column(key).type)
                    yield pa.RecordBatch.from_arrays([keys, *(pa.array([m[n] for m in made]) for n in range(len(names)))], names=[key, *names])

    return rows.mapInArrow(run, f"`{key}` {type_}, {schema}")


def decibel(v: Column) -> Column:
    return F.round(F.when(v > 1e-9, 20 * F.log10(v)).otherwise(-120.0), 1)


def levels(rows: DataFrame, key: str, rate: int = 8000) -> DataFrame:
    """Length, peak, RMS, noise floor (the tenth percentile of whole frames' mean size), clipping and offset of every flow, from sums of its runs."""

    names = [key, "frame", "n", "size", "power", "peak", "total", "clipped"]

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            some = whole.filter(pc.greater(pc.list_value_length(whole.column("samples")), 0))
            length = np.asarray(pc.list_value_length(some.column("samples")), np.int64)
            for rows in bounded(length):
                b, n = some.slice(rows.start, rows.stop - rows.start), length[rows]
                x, start = np.asarray(b.column("samples").flatten()) / FULL, np.asarray(b.column("start"), np.int64)
                # a run's frames, and the place in x where each begins
                first = start // FRAME
                count = (start + n - 1) // FRAME - first + 1
                frame = np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)
                edges = np.maximum(frame * FRAME - np.repeat(start, count), 0) + np.repeat(np.cumsum(n) - n, count)
                size, add = np.abs(x), np.add.reduceat
                columns = (frame, np.diff(edges, append=len(x)), add(size, edges), add(x * x, edges), np.maximum.reduceat(size, edges), add(x, edges), add((size >= 0.999).astype(np.int64), edges))
                yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(np.repeat(np.arange(len(n)), count))), *map(pa.array, columns)], names=names)

    # a frame that a border of runs parts has a row on both sides
    type_ = rows.schema[key].dataType.simpleString()
    each = rows.select(key, "start", "samples").mapInArrow(frames, f"`{key}` {type_}, frame long, n long, size double, power double, peak double, total double, clipped long")
    each = settled(each.groupBy(key, "frame").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.sum("power").alias("power"), F.max("peak").alias("peak"), F.sum("total").alias("total"), F.sum("clipped").alias("clipped")))
    floor = quantiles(each.where(F.col("n") == FRAME).select(key, (F.col("size") / FRAME).alias("v")), key, "v", {"floor": 0.1})
    whole = each.groupBy(key).agg(F.sum("n").alias("n"), F.sum("power").alias("power"), F.max("peak").alias("peak"), F.sum("total").alias("total"), F.sum("clipped").alias("clipped"))
    n = F.col("n")
    return beside(whole, floor, key).select(
        key, n.alias("samples"), F.round(n / rate, 2).alias("duration_s"), decibel(F.col("peak")).alias("peak_dbfs"), decibel(F.sqrt(F.col("power") / n)).alias("rms_dbfs"), decibel(F.coalesce("floor", F.lit(0.0))).alias("noise_floor_dbfs"),
        F.round(100 * F.col("clipped") / n, 4).alias("clipped_percent"), (F.round(100 * F.col("total") / n, 4) + 0.0).alias("dc_offset_percent_fs"),
    )


def likeness(x: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Correlation of the segment with x at every place where it fits, 1 for equal shapes, by FFT."""
    m = len(segment)
    if len(x) < m:
        return np.zeros(0)
    size = 1 << (len(x) + m - 1).bit_length()
    dots = np.fft.irfft(np.fft.rfft(x, size) * np.conj(np.fft.rfft(segment, size)), size)[: len(x) - m + 1]
    energy = np.concatenate([[0.0], np.cumsum(x * x)])
    own = np.sqrt(np.maximum(energy[m:] - energy[:-m], 0) * (segment @ segment))
    return np.where(own > 1e-6, dots / np.maximum(own, 1e-6), 0.0)


def with_next(rows: DataFrame, key: str, samples: int, run: int = RUN) -> DataFrame:
    """Every run with the beginnings (from, head) of the following ones that so many samples after its end can reach, and its flow's `end`: each beginning is sent to the few runs before it."""
    total = rows.groupBy(key).agg(F.max(F.col("start") + F.size("samples")).alias("end"))
    back = -(-samples // run) + 1
    head = rows.select(F.col(key).alias("__key"), F.explode(F.sequence(F.col("run") - back, F.col("run") - 1)).alias("__run"), F.struct(F.col("start").alias("from"), F.slice("samples", 1, samples).alias("head")).alias("h"))
    near = head.groupBy("__key", "__run").agg(F.sort_array(F.collect_list("h")).alias("after"))
    both = rows.join(near, F.col(key).eqNullSafe(F.col("__key")) & (F.col("run") == F.col("__run")), "left")
    return beside(both.drop("__key", "__run"), total, key)


def compared(rows: DataFrame, key: str, reference: np.ndarray, segment: int = SEGMENT, run: int = RUN) -> DataFrame:
    """(key, offset, compared, correlation, snr_db, clean_snr_db): where each flow plays the reference (16-bit samples, broadcast) and how well.

    The place is that of the greatest correlation with the reference's first `segment` samples,
    the earliest of equals. Runs are searched one by one with what the next ones bring to their
    last places (overlap-save), and the comparison is sums over the runs that the reference
    reaches, so no flow is held whole. Flows shorter than the segment have no row.
    """
    ref = np.asarray(reference, float)
    # the reference, the part that is searched for, and what a mu-law round trip alone adds to each sample
    shared = rows.sparkSession.sparkContext.broadcast((ref, ref[:segment], round_trip(ref) - ref))

    def search(x: np.ndarray, row: dict):
        part = shared.value[1]
        whole = np.zeros(min(len(x) + len(part) - 1, row["end"] - row["start"]))
        whole[: len(x)] = x
        for after in row["after"] or []:
            at = after["from"] - row["start"]
            head = np.asarray(after["head"], float)[: max(len(whole) - at, 0)]
            whole[at : at + len(head)] = head
        found = np.round(likeness(whole, part)[: len(x)], 9)
        if len(found):
            best = int(found.argmax())
            yield row["start"] + best, float(found[best])

    places = each_run(with_next(rows, key, len(ref[:segment]), run), key, "place long, score double", search)
    best = settled(places.groupBy(key).agg(F.max_by("place", F.struct("score", -F.col("place"))).alias("offset")))

    def sums(x: np.ndarray, row: dict):
        ref, _, noise = shared.value
        first = row["start"] - row["offset"]
        a, b = max(first, 0), min(first + len(x), len(ref))
        if a < b:
            d, r, e = x[a - first : b - first], ref[a:b], noise[a:b]
            yield b - a, float(d.sum()), float(r.sum()), float(d @ d), float(r @ r), float(d @ r), float(e @ e)

    each = each_run(beside(rows, best, key).where("offset IS NOT NULL"), key, "n long, d double, r double, dd double, rr double, dr double, ee double", sums)
    s = each.groupBy(key).agg(*(F.sum(c).alias(c) for c in ("n", "d", "r", "dd", "rr", "dr", "ee")))
    n = F.col("n")
    spread = F.sqrt((n * F.col("dd") - F.col("d") ** 2) * (n * F.col("rr") - F.col("r") ** 2))
    snr = lambda noise: F.round(10 * F.log10(F.col("rr") / n / F.greatest(noise / n, F.lit(1e-9))), 1)
    return beside(s, best, key).select(key, "offset", n.alias("compared"), F.round(F.try_divide(n * F.col("dr") - F.col("d") * F.col("r"), spread), 4).alias("correlation"), snr(F.col("dd") - 2 * F.col("dr") + F.col("rr")).alias("snr_db"), snr(F.col("ee")).alias("clean_snr_db"))


def round_trip(samples: np.ndarray) -> np.ndarray:
    """16-bit samples as mu-law leaves them."""
    x = np.minimum(np.abs(samples), 32635).astype(int) + 132
    e = np.floor(np.log2(x)).astype(int) - 7
    return tables()[PCMU][(np.where(samples < 0, 128, 0) + e * 16 + (x >> (e + 3)) % 16) ^ 0xFF].astype(float)
