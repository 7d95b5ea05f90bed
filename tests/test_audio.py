import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from belltower.sources import audio


def file_of(x, rate=8000, width=2, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((channels, width, rate, 0, "NONE", ""))
        w.writeframes(x)
    return out.getvalue()


def test_wav_bytes_are_those_of_the_wave_module(spark):
    clips = [[0.5, -1.0, 1.0, 0.1234], [], None, [2.0, -3.0], [0.25] * 3000]
    rows = spark.createDataFrame(list(enumerate(clips)), "i int, v array<double>")
    for df in (rows, rows.where("i < 0"), rows.coalesce(1)):
        for r in df.select("v", audio.wav_bytes(F.col("v"), 16000).alias("b")).collect():
            want = None if r["v"] is None else file_of(np.clip(np.round(np.array(r["v"]) * 32767), -32768, 32767).astype("<i2").tobytes(), 16000)
            assert (None if r["b"] is None else bytes(r["b"])) == want


def test_short_clips_are_read_together_and_as_the_others(spark):
    rng = np.random.default_rng(1)
    pcm = lambda n: rng.integers(-32768, 32768, n).astype("<i2").tobytes()
    plain = [file_of(pcm(n), r) for n, r in ((3, 8000), (0, 8000), (4096, 44100), (1, 1))]
    others = [file_of(pcm(5000)), file_of(pcm(70_000)), file_of(pcm(8), channels=2), file_of(bytes(range(9)), width=1), plain[0] + b"LIST\x02\0\0\0ab", plain[0][:-1], b"RIFF", None, plain[0][:48]]
    found = audio.usual(pa.array([*plain, *others]).slice(1))
    assert found[0].tolist() == [0, 1, 2] and found[1].tolist() == [8000, 44100, 1] and found[2].tolist() == [0, 4096, 4097]
    files = spark.createDataFrame([(str(i), c) for i, c in enumerate([*plain, *others]) if c is not None], "path string, content binary")
    got = {(r["path"], r["part"]): r for r in audio.clips(files).collect()}
    for r in files.collect():
        try:
            with wave.open(io.BytesIO(bytes(r["content"]))) as w:
                x = audio.mono(w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels())
                parts = [got[r["path"], k] for k in range(max(-(-len(x) // audio.BLOCK), 1))]
                assert np.concatenate([p["samples"] for p in parts]).tolist() == x.tolist() and all((p["rate"], p["channels"], p["width"], p["seconds"], p["error"]) == (w.getframerate(), w.getnchannels(), w.getsampwidth(), w.getnframes() / w.getframerate(), None) for p in parts)
        except (wave.Error, EOFError):
            assert got[r["path"], 0]["error"] and got[r["path"], 0]["samples"] is None
    assert len(got) == 4 + 9
