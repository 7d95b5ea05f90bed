from __future__ import annotations

import os
import struct
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from belltower import registry
from belltower.functions import signal, speech, voice
from belltower.functions.chunking import chunked
from belltower.operators import directory, lexical, reporting, sequences, vectors
from belltower.sources import audio, lists, packets, pdf, sinks
from belltower.streaming import turns

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_its_sql(spark, name):
    df = registry.QUERIES[name](spark, SF)
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got = con.execute(registry.ORACLE_SQL[name])
    names = [x[0] for x in got.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in got.fetchall()), key=key)
    assert sorted((tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()), key=key) == want


def test_spoken_text_and_parts():
    assert speech.spoken("# Head\n- **one** item\n1. two.\nSee [this](http://x.y) at www.z.com  !!") == "Head one item। two. See this at!"
    assert speech.spoken("| a | b |\n> quote `x` ✅ , done") == "quote x, done"
    assert speech.spoken(None) == ""
    parts = speech.speech_parts("Short. This sentence is clearly long enough to be a part. Tail")
    assert parts == ["Short. This sentence is clearly long enough to be a part. Tail"]
    assert speech.speech_parts("A first sentence of some length. And unfinished", cut_off=True) == ["A first sentence of some length."]


@pytest.mark.parametrize(("n", "words"), [(0, "शून्य"), (21, "इक्कीस"), (120, "एक सौ बीस"), (2500, "दो हज़ार पाँच सौ"), (-7, "ऋण सात"), (10_000_000, "एक करोड़")])
def test_number_words(n, words):
    assert speech.number_words(n) == words


def test_number_words_of_columns(spark):
    rng = np.random.default_rng(3)
    some = {0, 7, 10, 100, 101, 1000, 99_999, 100_000, 9_999_999, 10**7, 10**14, 2**63 - 1, -(2**63), -5, *(int(x) for x in rng.integers(-(10**18), 10**18, 200)), *(int(x) for x in rng.integers(0, 10**8, 200))}
    rows = spark.createDataFrame([(x,) for x in some] + [(None,)], "n long").select("n", speech.number_in_words(F.col("n")).alias("w")).collect()
    assert all(r["w"] == (None if r["n"] is None else speech.number_words(r["n"])) for r in rows) and len(rows) == len(some) + 1


def test_chunks():
    assert chunked([(1, "  \n\n ")]) == []
    assert [c["text"] for c in chunked([(1, "aaaa bbbb"), (2, "cc")], 10, 2)] == ["aaaa bbbb", "bb\n\ncc"]
    out = chunked([(1, " ".join(["word"] * 60))], 50, 10)
    assert [c["chunk_index"] for c in out] == list(range(len(out))) and all(len(c["text"]) <= 62 for c in out)
    assert chunked([(3, "x" * 90)], 50, 10)[0]["text"] == "x" * 90
    for size, overlap in ((0, 0), (10, 10), (10, -1)):
        with pytest.raises(ValueError):
            chunked([], size, overlap)


def test_equal_gap_begins_a_burst(spark):
    rows = spark.createDataFrame([("a", t) for t in (0.0, 0.25, 0.5, 0.875, 1.25)], "k string, t double")
    out = sequences.bursts(rows, "k", "t", 0.375).orderBy("start").collect()
    assert [(r["start"], r["packets"]) for r in out] == [(0.0, 3), (0.875, 1), (1.25, 1)]


def test_jitter_equals_the_recurrence(spark):
    rng = np.random.default_rng(1)
    t = np.cumsum(rng.uniform(0.01, 0.03, 200))
    rows = spark.createDataFrame([("a", float(x), 160 * k) for k, x in enumerate(t)], "k string, t double, s long")
    j = most = 0.0
    for k in range(1, 200):
        j += (abs((t[k] - t[k - 1]) * 8000 - 160) - j) / 16
        most = max(most, j)
    r = sequences.jitter(rows, "k", F.col("t"), "s").first()
    assert (r["jitter"], r["jitter_max"]) == (round(j / 8, 2), round(most / 8, 2))


def test_dashboard_of_nothing_and_bounds(spark):
    calls = spark.createDataFrame([], "status string, started_at timestamp, ai_handled boolean, routed_to_staff_number string, duration_seconds long, id long")
    r = reporting.dashboard(calls, "2024-01-01", 24).first()
    assert r["total_calls"] == 0 and r["average_duration_seconds"] is None
    for bad in (0, 721):
        with pytest.raises(ValueError):
            reporting.since(calls, "2024-01-01", bad)
    with pytest.raises(ValueError):
        reporting.call_list(calls, 501)


def test_pcap_to_rtp(spark, tmp_path):
    def frame(media, seq, vlan=False, pad=False):
        p = struct.pack("!BBHII", 0x80 | (0x20 if pad else 0), 0x80, seq, seq * 160, 7) + media + (b"\0\0\3" if pad else b"")
        udp = struct.pack("!HHHH", 4000, 5000, 8 + len(p), 0) + p
        ip = bytes([0x45, 0]) + struct.pack("!H", 20 + len(udp)) + bytes([0, 0, 0, 0, 64, 17, 0, 0, 10, 0, 0, 1, 10, 0, 0, 2])
        return bytes(12) + (b"\x81\x00\x00\x01" if vlan else b"") + b"\x08\x00" + ip + udp

    found = [frame(b"abc", 1), frame(b"de", 2, vlan=True), frame(b"f", 3, pad=True), bytes(12) + b"\x86\xdd" + bytes(40), b"short"]
    for order in "<>":
        body = (b"\xd4\xc3\xb2\xa1" if order == "<" else b"\xa1\xb2\xc3\xd4") + struct.pack(order + "HHiIII", 2, 4, 0, 0, 65535, 1)
        for k, f in enumerate(found):
            body += struct.pack(order + "IIII", 100, k * 20_000, len(f), len(f)) + f
        (tmp_path / f"{ord(order)}.pcap").write_bytes(body)
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.pcap"))
    out = packets.rtp(packets.datagrams(packets.frames(files))).orderBy("sequence").collect()
    assert [(r["sequence"], bytes(r["media"]), r["src"], r["dport"], r["marker"], r["payload_type"]) for r in out] == [(s, m, "10.0.0.1", 5000, True, 0) for s, m in ((1, b"abc"), (1, b"abc"), (2, b"de"), (2, b"de"), (3, b"f"), (3, b"f"))]


def test_resampling_keeps_tones_below_the_limit_only():
    t = np.arange(48000) / 48000
    rms = lambda f: np.sqrt(np.mean(signal.resampled(np.sin(2 * np.pi * f * t), 48000, 8000)[800:-800] ** 2))
    assert abs(rms(1000) - 0.7071) < 0.01 and rms(6000) < 1e-3
    quiet = np.concatenate([np.zeros(4000), np.sin(np.arange(4000)), np.zeros(4000)])
    assert len(signal.trimmed(quiet, 8000)) == 4000 + 2 * 480
    assert abs(np.abs(signal.levelled(quiet)).max() - 10 ** (-3 / 20)) < 1e-9
    assert len(signal.resampled(np.zeros(0), 8000, 16000)) == 0


TURNS = [
    ("talk", 0.0, "started", None), ("talk", 1.0, "finished", 800.0), ("talk", 9.0, "started", None),
    ("click", 0.0, "started", None), ("click", 0.2, "finished", 100.0), ("click", 5.0, "counters", None),
    ("again", 0.0, "started", None), ("again", 1.0, "finished", 900.0), ("again", 1.5, "started", None), ("again", 2.0, "finished", 400.0), ("again", 8.0, "counters", None),
]


def turn_rows(spark):
    rows = [(c, t, k, d, 0, 0) for c, t, k, d in TURNS] + [("voice", 0.2 * i, "counters", None, 10 * min(i, 5), 1600 * min(i, 5)) for i in range(15)]
    return spark.createDataFrame(rows, turns.INPUT)


EXPECTED = {("talk", turns.TALK, 0.8, 800, 2.0), ("again", turns.TALK, 1.8, 1300, 3.0), ("voice", turns.VOICE, 1.0, 1000, 2.2)}


def rounded(rows):
    return {(r["channel_id"], r["reason"], round(r["last_speech_at"], 6), r["speech_ms"], round(r["decided_at"], 6)) for r in rows}


def test_turn_ends_over_a_table(spark):
    assert rounded(turns.ends_of_turns(turn_rows(spark)).collect()) == EXPECTED


def test_turn_ends_over_a_stream(spark, tmp_path):
    rows = turn_rows(spark).withColumn("t", F.col("t") + 1024)  # a stream drops what is as old as the epoch
    for k, part in enumerate((rows.where("t < 1025.2"), rows.where("t >= 1025.2"))):
        part.coalesce(1).write.parquet(str(tmp_path / "in"), mode="append" if k else "overwrite")
    stream = spark.readStream.schema(turns.INPUT).parquet(str(tmp_path / "in"))
    q = turns.streamed_ends(stream).writeStream.format("memory").queryName("ends").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = rounded(spark.table("ends").selectExpr("channel_id", "reason", "last_speech_at - 1024 AS last_speech_at", "speech_ms", "decided_at - 1024 AS decided_at").collect())
    assert len({x[0] for x in got}) == len(got) and got <= EXPECTED


def test_everything_outside_llm_stands_alone():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(os.path.join(root, "belltower")):
        if "llm" not in folder:
            for n in names:
                if n.endswith(".py"):
                    assert "belltower.llm" not in open(os.path.join(folder, n), encoding="utf-8").read()


def test_stretching_keeps_pitch_and_changes_length():
    x = np.sin(2 * np.pi * 150 * np.arange(16000) / 8000)
    y = voice.stretched(x, 8000, 1.25)
    assert abs(len(y) - len(x) / 1.25) < 500
    peak = lambda v: np.abs(np.fft.rfft(v[800:-800])).argmax() / (len(v) - 1600) * 8000
    assert abs(peak(y) - 150) < 5 and voice.stretched(x, 8000, 1.005) is x
    with pytest.raises(ValueError):
        voice.stretched(x, 8000, 0)
    assert len(voice.stretched(np.zeros(720), 8000, 40.0)) == 0


def test_speech_level_and_silence():
    x = np.concatenate([np.zeros(8000), 0.05 * np.sin(np.arange(8000) * 0.3), np.zeros(8000)])
    y = voice.rendered(x, 8000, 1.0, "speech")
    assert abs(voice.loudness(y, 8000) / voice.loudness(x, 8000) - 10 ** (9 / 20)) < 0.05 and len(y) < 10_000
    assert voice.rendered(np.zeros(8000), 8000, 1.0, "speech") is None and voice.rendered(np.zeros(0), 8000, 1.0, "peak") is None
    assert len(voice.prepared_for_recognition(x, 8000)) == 2 * (8000 + 2 * 2000)


def test_a_clip_is_found_in_a_longer_one():
    rng = np.random.default_rng(3)
    ref = rng.normal(size=4000) * np.repeat(rng.uniform(0.1, 1, 50), 80)
    heard = np.concatenate([np.zeros(1234), 0.5 * ref, np.zeros(900)]) + rng.normal(size=6134) * 1e-3
    start, likeness, snr = voice.placed(ref, heard)
    assert start == 1234 and likeness > 0.999 and 40 < snr < 60
    assert voice.placed(ref, heard[:100]) is None and voice.placed(np.zeros(4000), heard) is None


def test_roughness_of_a_steady_tone_and_of_silence(spark):
    t = np.arange(4000) / 8000
    rows = [(1, i, float(v)) for i, v in enumerate(0.5 * np.sin(2 * np.pi * 200 * t))] + [(2, i, 0.0) for i in range(4000)]
    out = {r["clip_id"]: r for r in voice.roughness(spark.createDataFrame(rows, "clip_id long, i long, x double")).collect()}
    assert out[1]["voiced_frames"] > 20 and out[1]["f0_jitter_median_pct"] == 0 and out[1]["hnr_mean_db"] > 20
    assert out[2]["voiced_frames"] == 0 and out[2]["hnr_mean_db"] is None
    d = {r["clip_id"]: r for r in voice.described(spark.createDataFrame(rows, "clip_id long, i long, x double")).collect()}
    assert d[1]["estimated_f0_hz"] == 200 and d[2]["spectral_centroid_hz"] is None and d[2]["spectral_rolloff_95_hz"] is None


def test_top_k_in_blocks_equals_one_block(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(60, 8))
    v[10:20] = v[10]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(90, None), (91, [0.0] * 8), (92, [1.0]), (93, [float("nan")] * 8)], "vec_id long, embedding array<double>")
    q = rows.where("vec_id % 5 = 0 AND embedding IS NOT NULL").selectExpr("vec_id AS query_id", "embedding AS q").where("query_id < 60")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, rank + 1, j) for i in range(0, 60, 5) for rank, j in enumerate(sorted((j for j in range(60) if j != i), key=lambda j, i=i: (-round(float(unit[i] @ unit[j]), 6), j))[:3])}
    for block in (2000, 4):
        assert {(r["query_id"], r["rank"], r["vec_id"]) for r in vectors.top_k(rows, q, 3, block).collect()} == want
    assert vectors.top_k(rows, q.limit(0), 3).count() == 0


def made_pdf(pages, packed):
    """A PDF of one text line for each entry of each page."""
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{' '.join(f'{3 + 2 * k} 0 R' for k in range(len(pages)))}] /Count {len(pages)} >>"]
    out = [b"%PDF-1.4\n"]
    for k, lines in enumerate(pages):
        stream = b"BT /F1 12 Tf 72 720 Td " + b" 0 -14 Td ".join(b"(" + x.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)").encode("cp1252") + b") Tj" for x in lines) + b" ET" if lines else b"q Q"
        body, how = (zlib.compress(stream), "/Filter /FlateDecode ") if packed else (stream, "")
        objects += [f"<< /Type /Page /Parent 2 0 R /Contents {4 + 2 * k} 0 R >>", b"<< " + how.encode() + f"/Length {len(body)} >>\nstream\n".encode() + body + b"\nendstream"]
    for n, x in enumerate(objects, 1):
        out.append(f"{n} 0 obj\n".encode() + (x if isinstance(x, bytes) else x.encode()) + b"\nendobj\n")
    return b"".join([*out, b"trailer << /Root 1 0 R >>\n%%EOF"])


def test_pdf_pages(spark, tmp_path):
    text = [["First (page) of a file", "its second   line"], ["Page two: caf\xe9 \\ 5"], []]
    (tmp_path / "a.pdf").write_bytes(made_pdf(text, False))
    (tmp_path / "b.pdf").write_bytes(made_pdf(text, True))
    (tmp_path / "c.pdf").write_bytes(b"no pdf at all")
    (tmp_path / "d.pdf").write_bytes(b"%PDF-1.4\n%%EOF")
    (tmp_path / "e.pdf").write_bytes(b"%PDF-1.4\n3 0 obj << /Type /Page /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >> endobj 4 0 obj << >>\nstream\nBT /F1 9 Tf [<0001> -300 <00020001>] TJ T* (x) Tj ET\nendstream endobj 5 0 obj << /ToUnicode 6 0 R >> endobj 6 0 obj << >>\nstream\n1 beginbfchar <0001> <0905> endbfchar 1 beginbfrange <0002> <0003> <0041> endbfrange\nendstream endobj")
    out = {}
    for r in pdf.pages(spark.read.format("binaryFile").load(str(tmp_path / "*.pdf"))).collect():
        out.setdefault(r["path"][-5], []).append((r["page_number"], r["text"], r["error"]))
    want = [(1, "First (page) of a file\nits second line", None), (2, "Page two: caf\xe9 \\ 5", None), (3, "", None)]
    assert sorted(out["a"]) == sorted(out["b"]) == want
    assert out["c"] == [(None, None, "no PDF header")] and out["d"] == [(None, None, "no pages")]
    assert out["e"] == [(1, "\u0905 A\u0905", None)]


def test_wav_files_and_broken_ones(spark, tmp_path):
    x = np.sin(np.arange(1000) / 9) * 0.5
    made = spark.createDataFrame([("a", x.tolist())], "path string, v array<double>").select("path", audio.wav_bytes(F.col("v"), 8000).alias("content"))
    rows = made.unionByName(spark.createDataFrame([("b", bytearray(b"RIFFxx")), ("c", bytearray(b""))], "path string, content binary"))
    out = {r["path"]: r for r in audio.clips(rows).collect()}
    assert np.abs(np.array(out["a"]["samples"]) - x).max() < 1e-4 and out["a"]["rate"] == 8000 and out["b"]["error"] and out["c"]["error"]
    assert np.allclose(audio.mono(bytes([0, 0, 64, 0, 0, 192]), 3, 2), [0.0]) and np.allclose(audio.mono(bytes([128, 255]), 1, 1), [0, 127 / 128])


def test_json_lists(spark, tmp_path):
    files = {"bare": '[["a", "b"], ["c"], 7, ["b", "d"]]', "named": '{"groups": [["a", "b"], ["b", "d"]]}', "broken": '{"groups": [["a"', "other": '{"x": 1}'}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    found = {n: {(r["term"], r["synonym"]) for r in lists.synonym_groups(spark, str(tmp_path / n)).collect()} for n in [*files, "missing"]}
    assert found["bare"] == found["named"] == {("a", "b"), ("b", "a"), ("b", "d"), ("d", "b")} and not found["broken"] and not found["other"] and not found["missing"]
    centre = '{"district": " North Side of the Old Town ", "name": "N", "aliases": ["one two three four five six"]}, {"district": "", "name": "x"}, {"district": "South", "name": "S"}'
    (tmp_path / "c1").write_text(f"[{centre}]")
    (tmp_path / "c2").write_text('{"centres": [' + centre + "]}")
    one, two = (lists.centres(spark, str(tmp_path / n)) for n in ("c1", "c2"))
    assert [r["name"] for r in one.orderBy("ordinal").collect()] == ["N", "S"] == [r["name"] for r in two.orderBy("ordinal").collect()]
    texts = spark.createDataFrame([(1, "to One, two three FOUR five six!"), (2, "southern"), (3, "the south of north side of the old town"), (4, None)], "k long, text string")
    assert {(r["k"], r["name"]) for r in directory.named_centres(texts, one, "k").collect()} == {(1, "N"), (3, "N")}


def test_jitter_over_many_runs(spark):
    rng = np.random.default_rng(2)
    t = np.cumsum(rng.uniform(0.01, 0.03, 500))
    rows = spark.createDataFrame([("a", float(x), 160 * k) for k, x in enumerate(t)] + [("b", 1.0, 0)], "k string, t double, s long")
    whole, parts = ({tuple(r) for r in sequences.jitter(rows, "k", F.col("t"), "s", run=n).collect()} for n in (4096, 7))
    assert whole == parts and ("b", 0.0, 0.0) in whole


def test_worst_between_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    samples = [("a", float(t), float(v)) for t, v in zip(rng.uniform(0, 100, 200).round(2), rng.normal(size=200), strict=True)]
    spans = [("a", float(a), float(a + n)) for a, n in zip(rng.uniform(-5, 100, 60).round(2), rng.choice([0.0, 0.5, 3.0, 40.0], 60), strict=True)]
    got = {(r["a"], r["b"]): r["worst"] for r in sequences.worst_between(spark.createDataFrame(spans, "k string, a double, b double"), spark.createDataFrame(samples, "k string, t double, value double"), "k", 2.0).collect()}
    assert got == {(a, b): max((v for _, t, v in samples if a <= t <= b), default=None) for _, a, b in spans}


@pytest.mark.parametrize(("text", "said"), [
    ("5-10 days", "पाँच से दस days"), ("10 mg", "दस मिलीग्राम"), ("2.5% off", "दो दशमलव पाँच प्रतिशत off"), ("₹1,200 only", "एक हज़ार दो सौ रुपये only"), ("Rs. 50/day", "पचास रुपये day"),
    ("CT (head)", "सी टी, head,"), ("98°F", "अट्ठानवे डिग्री फ़ारेनहाइट"), ("a1 b", "a1 b"), ("१२", "बारह"), ("x & y", "x और y"), ("OK then", "ठीक है then"), ("कुछ नहीं", "कुछ नहीं"), (None, None), ("", ""),
])
def test_voiced(text, said):
    assert speech.voiced(text, {"OK": "ठीक है"}) == said


def test_first_claims_of_a_stream(spark, tmp_path):
    spark.createDataFrame([("a", 1, 10), ("a", 1, 11), ("a", 2, 12), ("b", 1, 13)], "channel_id string, seq long, s long").selectExpr("channel_id", "seq", "timestamp_seconds(s) AS at").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("channel_id string, seq long, at timestamp").parquet(str(tmp_path / "in"))
    q = turns.first_claims(stream).writeStream.format("memory").queryName("claims").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["channel_id"], r["seq"]) for r in spark.table("claims").collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_recall_on_answerable_and_unanswerable_questions(spark):
    topics = {"fever": "high fever and shivering last three days", "teeth": "brush your teeth twice a day with soft paste", "diet": "eat fruit greens and drink plenty of water", "bones": "a broken bone needs a plaster for six weeks"}
    chunks = spark.createDataFrame([(k, t) for k, t in topics.items()], "chunk_id string, text string")
    index = lexical.Index(chunks, F.split(F.lower("text"), " "), ["a", "and", "the", "your", "of", "with", "for"])
    asked = {1: ("fever", "shivering fever"), 2: ("teeth", "soft paste teeth"), 3: ("bones", "plaster broken"), 4: ("diet", "fruit watar")}
    q = spark.createDataFrame([(k, w) for k, (_, t) in asked.items() for w in t.split()] + [(9, "parliament"), (9, "election")], "query_id long, term string")
    found = {r["query_id"]: r["chunk_id"] for r in lexical.search(index, q, 1).collect()}
    assert found == {k: c for k, (c, _) in asked.items()}
    none = spark.createDataFrame([(1, "x")], "query_id long, term string").limit(0)
    assert lexical.search(lexical.Index(chunks.limit(0), F.split(F.lower("text"), " "), ["a"]), q, 1).count() == 0 and lexical.search(index, none, 1).count() == 0


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a|b", None), (2, "two\nlines", 0.5)], "k long, text string, v double")
    for _ in range(2):
        sinks.append(rows, str(tmp_path / "t"), ("k",))
        sinks.json_lines(rows, str(tmp_path / "j"))
    assert spark.read.parquet(str(tmp_path / "t")).where("k = 2").count() == 2
    assert spark.read.schema(rows.schema).json(str(tmp_path / "j")).where("v IS NULL").count() == 2
    sinks.markdown(rows, str(tmp_path / "m"), ["k"])
    assert [r["value"] for r in spark.read.text(str(tmp_path / "m")).collect()] == ["| k | text | v |", "| --- | --- | --- |", "| 1 | a\\|b |  |", "| 2 | two lines | 0.5 |"]
    line = rows.select(sinks.timing_line({"call": F.col("k"), "v_ms": F.col("v")}).alias("value"))
    assert {(r["fields"]["call"], r["fields"]["v_ms"]) for r in packets.timing_lines(line).collect()} == {("1", None), ("2", "0.5")}
    q = sinks.streamed(spark.readStream.schema(rows.schema).json(str(tmp_path / "j")), str(tmp_path / "s"), str(tmp_path / "c"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 4


def test_clip_report(spark):
    t = np.arange(4800) / 48000
    x = np.concatenate([np.zeros(4800), 0.25 * np.sin(2 * np.pi * 300 * t)])
    y = voice.rendered(x, 48000, 1.0, "peak")
    rows = lambda v: spark.createDataFrame([(1, i, float(s)) for i, s in enumerate(v)], "clip_id long, i long, x double")
    r = signal.clip_report(rows(x), rows(y), "peak", 48000).first()
    assert abs(r["peak_dbfs"] + 3) < 0.2 and abs(r["source_peak_dbfs"] + 12.04) < 0.2 and abs(r["gain_db"] - 9) < 0.3 and r["resampled"] and not r["tempo_applied"]
    assert abs(r["trimmed_s"] - (0.2 - len(y) / 8000)) < 1e-6 and r["final_rate"] == 8000
