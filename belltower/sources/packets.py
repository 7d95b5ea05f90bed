"""Packet sources: classic pcap files, UDP datagrams, RTP headers; timing lines of logs; JSON events."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# First bytes of a classic pcap file -> byte order, fractions a second; and bytes before the IP header by link type (None: see the header).
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1e6), b"\x4d\x3c\xb2\xa1": ("<", 1e9), b"\xa1\xb2\xc3\xd4": (">", 1e6), b"\xa1\xb2\x3c\x4d": (">", 1e9)}
ETHERNET, SLL, RAW, NULL = 1, 113, 101, 0


def frames(files: DataFrame) -> DataFrame:
    """(path, linktype, t, frame) of pcap files read with the binaryFile source; one file is read by one task, record by record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                if data[:4] not in MAGIC:
                    raise ValueError(f"{path} is no classic pcap file")
                order, unit = MAGIC[data[:4]]
                link, at, t, found = struct.unpack_from(order + "I", data, 20)[0], 24, [], []
                while at + 16 <= len(data):
                    sec, part, size = struct.unpack_from(order + "III", data, at)
                    t.append(sec + part / unit)
                    found.append(data[at + 16 : at + 16 + size])
                    at += 16 + size
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(t)), pa.array([link] * len(t), pa.int32()), pa.array(t, pa.float64()), pa.array(found, pa.binary())], names=["path", "linktype", "t", "frame"])

    return files.select("path", "content").mapInArrow(run, "path string, linktype int, t double, frame binary")


def u(data: Column, start: int | Column, size: int) -> Column:
    """A big-endian unsigned number of so many bytes from a place counted from 0."""
    s = F.lit(start) + 1 if isinstance(start, int) else start + 1
    return F.conv(F.hex(F.substring(data, s, F.lit(size))), 16, 10).cast("long")


def rest(data: Column, start: Column | int) -> Column:
    s = F.lit(start) if isinstance(start, int) else start
    return F.substring(data, s + 1, F.octet_length(data))


def datagrams(found: DataFrame) -> DataFrame:
    """UDP over IPv4 in frames of Ethernet (with or without a VLAN tag), Linux cooked, raw and null links: t, src, sport, dst, dport, payload."""
    f = F.col("frame")
    tagged = u(f, 12, 2) == 0x8100
    start = F.when(F.col("linktype") == ETHERNET, F.when(tagged, 18).otherwise(14)).when(F.col("linktype") == SLL, 16).when(F.col("linktype") == RAW, 0).when(F.col("linktype") == NULL, 4)
    kind = F.when(F.col("linktype") == ETHERNET, F.when(tagged, u(f, 16, 2)).otherwise(u(f, 12, 2))).when(F.col("linktype") == SLL, u(f, 14, 2)).otherwise(0x0800)
    ip = found.where(kind == 0x0800).select("t", rest(f, start).alias("ip"))
    ip = ip.where((F.octet_length("ip") >= 20) & (F.shiftright(u(F.col("ip"), 0, 1), 4) == 4) & (u(F.col("ip"), 9, 1) == 17))
    d = ip.withColumn("udp", rest(F.col("ip"), u(F.col("ip"), 0, 1).bitwiseAND(15).cast("int") * 4)).where(F.octet_length("udp") >= 8)
    address = lambda at: F.concat_ws(".", *[u(F.col("ip"), at + k, 1) for k in range(4)])
    size = F.greatest(u(F.col("udp"), 4, 2) - 8, F.lit(0)).cast("int")
    return d.select("t", address(12).alias("src"), u(F.col("udp"), 0, 2).alias("sport"), address(16).alias("dst"), u(F.col("udp"), 2, 2).alias("dport"), F.substring(F.col("udp"), F.lit(9), size).alias("payload"))


def rtp(rows: DataFrame, data: str = "payload") -> DataFrame:
    """rows with the RTP fields and media of their packets; what is not version 2 is dropped."""
    p = F.col(data)
    first, second = u(p, 0, 1), u(p, 1, 1)
    out = rows.where((F.octet_length(p) >= 12) & (F.shiftright(first, 6) == 2))
    fixed = (12 + 4 * first.bitwiseAND(15)).cast("int")
    extended = first.bitwiseAND(0x10) != 0
    head = F.when(extended, fixed + 4 + 4 * u(p, fixed + 2, 2).cast("int")).otherwise(fixed)
    out = out.where(~extended | (F.octet_length(p) >= fixed + 4)).withColumn("media", rest(p, head))
    pad = u(F.col("media"), F.octet_length("media") - 1, 1)
    n = F.octet_length("media")
    padded = (first.bitwiseAND(0x20) != 0) & (n > 0) & pad.between(F.lit(1), n)
    media = F.when(padded, F.substring(F.col("media"), F.lit(1), (n - pad).cast("int"))).otherwise(F.col("media"))
    return out.select("*", second.bitwiseAND(127).alias("payload_type"), (second >= 128).alias("marker"), u(p, 2, 2).alias("sequence"), u(p, 4, 4).alias("timestamp"), u(p, 8, 4).alias("ssrc")).withColumn("media", media)


def built(payload_type: Column, sequence: Column, timestamp: Column, ssrc: Column, media: Column, marker: Column) -> Column:
    """An RTP packet with a plain header."""
    number = lambda c, size: F.unhex(F.lpad(F.hex(c.cast("long").bitwiseAND((1 << 8 * size) - 1)), 2 * size, "0"))
    return F.concat(F.unhex(F.lit("80")), number(payload_type.bitwiseAND(127) + F.when(marker, 128).otherwise(0), 1), number(sequence, 2), number(timestamp, 4), number(ssrc, 4), media)


def timing_lines(lines: DataFrame, mark: str = "Turn timing") -> DataFrame:
    """The key=value pairs of marked log lines as a map; `-` is null."""
    rows = lines.where(F.contains("value", F.lit(mark)))
    keys = F.regexp_extract_all("value", F.lit(r"(\w+)=(\S+)"), F.lit(1))
    values = F.transform(F.regexp_extract_all("value", F.lit(r"(\w+)=(\S+)"), F.lit(2)), lambda v: F.nullif(v, F.lit("-")))
    return rows.select("value", F.map_from_arrays(F.array_distinct(keys), F.slice(values, F.lit(1), F.size(F.array_distinct(keys)))).alias("fields"))


def json_events(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Events of JSON lines; lines that aren't JSON objects are skipped."""
    parsed = lines.withColumn("__e", F.from_json(column, schema, {"mode": "PERMISSIVE"}))
    return parsed.where(F.get_json_object(column, "$").isNotNull() & F.trim(column).startswith("{")).select("__e.*")
