from __future__ import annotations

import random
import struct

import pytest

from belltower.sources import capture, packets


BASE = 1_700_000_000


def written(path, frames, order="<", nano=False):
    magic = {("<", False): b"\xd4\xc3\xb2\xa1", (">", False): b"\xa1\xb2\xc3\xd4", ("<", True): b"\x4d\x3c\xb2\xa1", (">", True): b"\xa1\xb2\x3c\x4d"}[order, nano]
    body = magic + struct.pack(order + "HHiIII", 2, 4, 0, 0, 65535, 1)
    for t, f in frames:
        body += struct.pack(order + "IIII", int(t), int((t % 1) * (10**9 if nano else 10**6)), len(f), len(f)) + f
    path.write_bytes(body)


def made(rng, n):
    """Frames of which some hold bytes that look like record headers."""
    out = []
    for i in range(n):
        f = bytes(rng.choice([0, 0, 1, 255, rng.randint(0, 255)]) for _ in range(rng.randint(0, 300)))
        if i % 5 == 0:
            f += struct.pack("<IIII", BASE + i, 5, 20, 20) + bytes(20) + struct.pack("<IIII", BASE + i, 6, 4, 4)
        out.append((BASE + i + 0.25, f))
    return out


def got(df):
    return sorted((r["path"].rsplit("/", 1)[1], r["linktype"], round(r["t"], 6), bytes(r["frame"])) for r in df.collect())


@pytest.mark.parametrize(("order", "nano"), [("<", False), (">", True)])
def test_a_file_in_parts_has_the_same_frames(spark, tmp_path, order, nano):
    capture.register(spark)
    frames = made(random.Random(3), 400)
    written(tmp_path / "a.pcap", frames, order, nano)
    size = (tmp_path / "a.pcap").stat().st_size
    want = sorted(("a.pcap", 1, round(t, 6), f) for t, f in frames)
    for parts in (1, 8, 61):
        df = spark.read.format("pcap").option("partBytes", size // parts + 1).load(str(tmp_path))
        assert df.rdd.getNumPartitions() == len(range(0, size, size // parts + 1)) and got(df) == want
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.pcap"))
    assert got(packets.frames(files)) == want


def test_every_part_of_a_file_finds_its_first_record(tmp_path):
    frames = made(random.Random(9), 60)
    written(tmp_path / "a.pcap", frames)
    size, starts, at = (tmp_path / "a.pcap").stat().st_size, [], capture.FILE_HEADER
    for _, f in frames:
        starts.append(at)
        at += capture.RECORD + len(f)
    store, inside = capture.store_of(str(tmp_path / "a.pcap"))
    with store.open_input_file(inside) as file:
        records = capture.Records(file)
        for start in range(0, size, 7):
            assert records.first(start) == next((s for s in starts if s >= start), size if start > starts[-1] else None)


def test_new_files_come_as_a_stream(spark, tmp_path):
    capture.register(spark)
    folder = tmp_path / "in"
    folder.mkdir()
    rng, seen = random.Random(1), []

    def run():
        q = spark.readStream.format("pcap").option("partBytes", 2000).load(str(folder)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="0 seconds").start()
        q.processAllAvailable()
        q.stop()

    for name in ("a", "b"):
        frames = made(rng, 40)
        written(tmp_path / name, frames)
        (tmp_path / name).rename(folder / f"{name}.pcap")
        seen += [(f"{name}.pcap", 1, round(t, 6), f) for t, f in frames]
        run()
        assert got(spark.read.parquet(str(tmp_path / "out"))) == sorted(seen)


def test_other_files_and_missing_paths_are_told(spark, tmp_path):
    capture.register(spark)
    (tmp_path / "x.pcap").write_bytes(b"no capture")
    with pytest.raises(Exception, match="no classic pcap"):
        spark.read.format("pcap").load(str(tmp_path)).count()
    with pytest.raises(Exception, match="needs a path|nowhere"):
        spark.read.format("pcap").load(str(tmp_path / "nowhere")).count()
