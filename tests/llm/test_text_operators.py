from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from belltower.llm import bpe, language_model, media, pii, sharding, toxicity
from tests.llm.helpers import HARD, documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_bpe_equals_the_library_on_odd_texts():
    own, theirs = bpe.Codec(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(5)
    letters = "ab c'd  \n\t\x1c\x85 　é1٣'ll\x00!?हि🙂‍"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(1500)] + ["", "a<|endoftext|>b  <|endoftext|>", "x" * 3000]
    for t in texts:
        ids = theirs.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == (ids, ",".join(map(str, ids)))
        assert own.decode(ids) == theirs.decode(ids, skip_special_tokens=False)


def test_bpe_query_and_general_form(spark):
    rows = bpe.digest(documents(spark, HARD), PATH).collect()
    assert len(rows) == len(HARD)
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_tokens"] == by[2]["n_tokens"] == 0
    assert by[1]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by[7]["decoded_sha256"] == hashlib.sha256(dict(HARD)[7].encode()).hexdigest()
    out = bpe.encoded(documents(spark, HARD), PATH, keep=("doc_id", "row")).collect()
    assert all((r["decoded"] or "") == (t or "") for r, t in zip(sorted(out, key=lambda r: (r["doc_id"] is None, r["doc_id"])), [t for _, t in sorted(HARD, key=lambda x: (x[0] is None, x[0]))], strict=True))
    assert bpe.digest(documents(spark, []), PATH).count() == 0


def test_a_worker_lets_go_of_what_other_operators_keep():
    from belltower.llm import common

    bpe.codec(PATH).encode("some words")
    common.lets_go("bpe")
    assert bpe.codec(PATH).known
    common.lets_go()
    assert not bpe.codec(PATH).known


def test_bpe_memory_is_bounded_and_keeps_what_is_met_again(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 40 * (bpe.WEIGHT + 30))
    own, theirs, met = bpe.Codec(PATH), Tokenizer.from_file(PATH), 0
    for k in range(300):
        text = f"often w{chr(97 + k % 26)}{chr(97 + k // 26)}z"
        met += "often" in own.known or "often" in own.older
        assert own.encode(text)[0] == theirs.encode(text, add_special_tokens=False).ids
        assert len(own.known) + len(own.older) < 50
    assert met == 299


def test_a_task_gives_back_memory_and_holds_none_of_other_operators(monkeypatch):
    from belltower.llm import common

    class Frame:
        def mapInArrow(self, f, schema):
            return list(f(iter([])))

    said = []
    monkeypatch.setattr(common, "_KEPT", {})
    monkeypatch.setattr(common, "gives_back", lambda: said.append("back"))
    common.keeps("bpe", lambda: said.append("bpe let go"))
    common.keeps("x", lambda: said.append("x let go"))
    common.in_arrow(Frame(), lambda batches: iter(said.append("run") or []), "", "x")
    assert said == ["bpe let go", "run", "back"]


def test_netpbm_and_bmp_round_trips():
    rng = np.random.default_rng(2)
    g = rng.integers(0, 256, (5, 7), dtype=np.uint8)
    assert (media.decoded(media.pgm(g)) == g).all()
    plain = b"P2 # c\n7 5\n255\n" + b" ".join(str(int(v)).encode() for v in g.ravel())
    assert (media.decoded(plain) == g).all()
    rgb = rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    assert (media.decoded(b"P6\n7 5\n255\n" + rgb.tobytes()) == rgb).all()
    assert media.decoded(b"P1\n2 2\n10\n01").tolist() == [[0, 255], [255, 0]]
    assert media.decoded(b"P4\n3 1\n" + bytes([0b01000000])).tolist() == [[255, 0, 255]]
    rows = b"".join(rgb[y, :, ::-1].tobytes().ljust(24, b"\0") for y in range(4, -1, -1))
    head = b"BM" + (54 + len(rows)).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (7).to_bytes(4, "little") + (5).to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24)
    assert (media.decoded(head + rows) == rgb).all()
    small = media.resized(g.astype(float), 5, 7)
    assert np.allclose(small, g)
    assert np.isclose(media.resized(g.astype(float), 1, 1)[0, 0], g.mean())


def test_media_query_and_tiles(spark):
    rows = {r["doc_id"]: r for r in media.digest(documents(spark, HARD)).collect()}
    for i, t in HARD:
        raw = (t or "").encode()
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert rows[3]["feature"] == rows[4]["feature"] and rows[1]["media_sha256"] == rows[2]["media_sha256"]
    files = spark.createDataFrame([(1, bytearray(media.pgm(np.zeros((3, 3), np.uint8)))), (2, None), (3, bytearray(b"P5\n9 9\n255\nshort")), (4, bytearray(b"BMxx"))], "id int, file binary")
    out = {r["id"]: r for r in media.tiles(files, "id", "file").collect()}
    assert out[1]["error"] is None and out[1]["height"] == 3 and all(out[k]["tile"] is None and out[k]["error"] for k in (2, 3, 4))


def test_pattern_spans():
    text = "a.b@mail1.example.com 300.1.1.1 10.0.0.255, 4539 1488 0343 6467 x 4539148803436468 +1 (555) 555-1234 +1 2"
    found = pii.pattern_spans(text)
    assert [(k, text[a:b]) for k, a, b in found] == [("email", "a.b@mail1.example.com"), ("ip", "10.0.0.255"), ("card", "4539 1488 0343 6467"), ("phone", "+1 (555) 555-1234")]
    assert pii.pattern_spans("") == []


OLD = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"}


@settings(max_examples=500, deadline=None)
@given(st.text("a1.@- ", max_size=30))
def test_linear_patterns_find_what_the_plain_ones_do(text):
    assert pii.emails(text) == [m.span() for m in re.finditer(OLD["email"], text)]
    assert [m.span() for m in pii.IP.finditer(text)] == [m.span() for m in re.finditer(OLD["ip"], text)]


def test_hostile_texts_end(spark):
    rows = [(1, "a" * 200_000 + " @"), (2, "9" * 200_000 + ".1 1." + "8" * 5000 + ".1.1"), (3, "1.2.3." + "7" * 6000), (4, "+" + "1 " * 50_000), (5, "@" * 50_000), (6, "0" * 9000 + "1.2.3.4")]
    out = {r["doc_id"]: r for r in pii.personal_data(documents(spark, rows)).collect()}
    assert [out[i]["n_ip"] for i in range(1, 7)] == [0, 0, 0, 0, 0, 1] and pii.personal_data(documents(spark, [])).count() == 0


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(4)
    move = rng.normal(size=(3, 3))
    lines = [rng.normal(size=(n, 3)) for n in (4, 1, 6)]
    for scores, path in zip(lines, pii.viterbi(lines, move), strict=True):
        def total(p, scores=scores):
            return sum(scores[i, x] for i, x in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:], strict=False))
        import itertools
        best = max(itertools.product(range(3), repeat=len(scores)), key=total)
        assert tuple(path) == best


def test_personal_data_keeps_pattern_spans_and_leaves_clean_texts(spark):
    token = "0a1b2c3d4e5f60718293a4b5c6d7e8f901234567"
    rows = [*HARD, (20, f'call +1 (555) 555-1234 or token = "{token}" end'), (21, "4539148803436468 is no card, 1.2.3 no ip"), (22, "the card 4539148803436467 4539148803436467 twice")]
    out = {r["doc_id"]: r for r in pii.personal_data(documents(spark, rows)).collect()}
    assert out[20]["n_phone"] == 1 and "phone:5:22" in out[20]["spans"] and "secret:" in out[20]["spans"]
    assert out[22]["n_card"] == 0 and out[22]["spans"] == "card:9:25,card:26:42"
    assert out[21]["spans"] == "" and out[3]["spans"] == "" and out[1]["spans"] == ""
    assert out[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_words_that_look_alike_are_scored_once(monkeypatch):
    field, real, asked = pii.trained(pii.labelled_table(1), 2), pii.slots, []
    monkeypatch.setattr(pii, "slots", lambda *x: asked.append(x) or real(*x))
    lines = [["abcd", "bcde,", "Ab1", "cdef"], ["7"], ["dcba", "4539148803436467", "éa²", "bcde"]]
    found = field.scores(lines, ({}, {}))
    assert len(asked) == 3 * 5
    for line, scores in zip(lines, found, strict=True):
        part = lambda w, x: field.emit[real(pii.look(w), x)].sum(0)
        for i, w in enumerate(line):
            want = part(w, "this")
            want = want + part(line[i - 1], "before") if i else want
            want = want + part(line[i + 1], "after") if i + 1 < len(line) else want
            assert (scores[i] == want).all()


def test_texts_decoded_together_have_the_spans_they_have_alone(spark, monkeypatch):
    field = pii.trained(pii.labelled_table())
    texts = ["", "no marks\nat all", "call (555) 123-4567 now\n\n \x1c \ncards 4539148803436467 4539148803436467", "token = 0a1b2c3d4e5f60718293a4b5c6d7e8f901234567", "a@b.co " * 50, " ٣ ² 9\r@\n9", "call (555) 123-4567 now"]
    alone = [next(pii.spans(field, [t], ({}, {}))) for t in texts]
    assert list(pii.spans(field, texts, ({}, {}))) == alone and sum(len(more) - len(base) for base, more in alone) >= 4
    assert [len(x) for x in pii.grouped(texts, 60)] == [2, 1, 1, 1, 2] and list(pii.grouped([])) == []
    rows = [(i, t) for i, t in enumerate([*texts, None, *texts])]
    for name in ("KNOWN", "LOOKS"):  # what is remembered changes nothing
        monkeypatch.setattr(pii, name, 2)
    assert [next(pii.spans(field, [t], ({}, {}))) for t in texts] == alone
    out = {r["doc_id"]: r for r in pii.personal_data(documents(spark, rows)).collect()}
    assert [out[i]["spans"] for i in range(len(rows))] == [pii.written(x) for _, x in [*alone, ([], []), *alone]]
    assert out[len(texts)]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_sums_by_place_keep_the_order_of_their_rows():
    rng = np.random.default_rng(2)
    rows, at = rng.normal(size=(500, 3)), rng.integers(0, 7, 500)
    want = np.zeros((9, 3))
    np.add.at(want, at, rows)
    assert (pii.summed(rows, at, 9) == want).all()


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(9)
    plain = [f"w{k}" for k in range(60)]
    rows, marks = [], []
    for i in range(700):
        toxic = i % 4 == 0
        words = [rng.choice(plain) for _ in range(rng.randint(20, 60))]
        for _ in range(3 * toxic):
            words.insert(rng.randint(0, len(words)), rng.choice(["idiot", "scum", "moron"]))
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(toxic)))
    docs = documents(spark, [*rows, (2000, None), (2001, ""), (None, "w1 idiot")])
    labels = spark.createDataFrame([*marks, (None, 1, 1), (5000, 0, None)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in toxicity.query(docs, labels).collect()}
    assert len(out) == 703 and 0 <= out[2000]["score"] <= 1 and out[2000]["score"] == out[2001]["score"]
    held = [i for i in range(700) if out[i]["held_out"]]
    assert held and all(zlib.crc32(str(i).encode()) % 5 == 0 for i in held)
    assert sum(out[i]["predicted"] == (i % 4 == 0) for i in held) / len(held) > 0.95
    assert toxicity.query(docs, labels.limit(0)).agg({"score": "max"}).first()[0] == 0
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id = 2000").count() == 1


class Textbook:
    """Interpolated Kneser-Ney of one class, from its distinct bigrams of texts, with shared continuation counts below; no cutoff."""

    def __init__(self, own, every):
        self.times, self.d = own, 0.75
        self.after = {}
        for (v, w), n in own.items():
            self.after.setdefault(v, {})[w] = n
        self.before = {w: sum(x == w for _, x in own) for w in {w for _, w in own}}
        self.shared = {w: sum(x == w for _, x in every) for w in {w for _, w in every}}

    def lowest(self, w):
        n, kinds = sum(self.shared.values()), len(self.shared)
        return max(self.shared.get(w, 0) - self.d, 0) / n + self.d * kinds / n / (kinds + 1)

    def middle(self, w):
        n = sum(self.before.values())
        return max(self.before.get(w, 0) - self.d, 0) / n + self.d * len(self.before) / n * self.lowest(w)

    def chance(self, v, w):
        if v not in self.after:
            return self.middle(w)
        n = sum(self.after[v].values())
        return max(self.after[v].get(w, 0) - self.d, 0) / n + self.d * len(self.after[v]) / n * self.middle(w)


def class_texts():
    rng = random.Random(2)
    return [(" ".join(rng.choice([f"w{k}" for k in range(30)] + ["foul"] * 4 * (i % 3 == 0)) for _ in range(25)), int(i % 3 == 0)) for i in range(60)]


def bigrams(text):
    w = toxicity.WORD.findall(text.lower())
    return list(zip(["", *w], w, strict=False))


def test_toxicity_models_without_cutoff_are_textbook_kneser_ney(spark):
    import math
    from collections import Counter

    rows = class_texts()
    times = [Counter(x for t, y in rows if y == c for x in set(bigrams(t))) for c in (0, 1)]
    o, t = (Textbook(times[c], set(times[0]) | set(times[1])) for c in (0, 1))
    words = {*o.shared, "never seen"}
    for m in (o, t):
        assert all(abs(sum(m.chance(v, w) for w in words) - 1) < 1e-9 for v in ["", "w1", "foul", "never seen"])
    counts = toxicity.counted(spark.createDataFrame([(x, y, 0) for x, y in rows], "text string, toxic int, half int"))
    model = toxicity.model_of(counts.select("previous", "word", F.col("o0").alias("o"), F.col("t0").alias("t")), (40, 20), 0.0, (0, 0), 0.0)
    for text in [rows[0][0], rows[1][0], "w1 w2 foul " * 3, "never w3 seen foul foul", "w9"]:
        want = sum(math.log(t.chance(v, w) / o.chance(v, w)) for v, w in bigrams(text)) / len(bigrams(text))
        assert abs(toxicity.evidence(model, [text])[0] - 100 * want) < 1e-9


def test_toxicity_models_with_cutoff_sum_to_one_and_smooth_rare_expressions(spark):
    import math
    from collections import Counter

    rows = [*class_texts(), *((f"foul w3 w{k}", 1) for k in range(20)), ("rare w1 foul", 1), ("w2 scarce", 0)]
    size = (41, 41)
    times = [Counter(x for t, y in rows if y == c for x in set(bigrams(t))) for c in (0, 1)]
    held = [Counter(w for t, y in rows if y == c for w in set(toxicity.WORD.findall(t))) for c in (0, 1)]
    o, t = (Textbook(times[c], set(times[0]) | set(times[1])) for c in (0, 1))

    def stays(n, c, x, least=toxicity.TEXTS):  # the cutoff, from its definition
        scaled = [n[k][x] * min(size) / size[k] for k in (0, 1)]
        return n[c][x] > 0 and scaled[c] >= max(least, toxicity.SHARE * min(size)) + toxicity.TIMES * scaled[1 - c]

    def chance(m, c, v, w):
        n = sum(m.before.values())
        own = {x: (k - m.d) / n for x, k in m.before.items() if stays(held, c, x)}
        lower = own.get(w, 0) + (1 - sum(own.values())) * m.lowest(w)
        after = {x: (k - m.d) / sum(m.after[v].values()) for x, k in m.after.get(v, {}).items() if stays(times, c, (v, x), toxicity.PAIR_TEXTS)}
        return after.get(w, 0) + (1 - sum(after.values())) * lower

    words = {*o.shared, "never seen"}
    assert all(abs(sum(chance(m, c, v, w) for w in words) - 1) < 1e-9 for c, m in ((0, o), (1, t)) for v in ("", "foul", "w3"))
    counts = toxicity.counted(spark.createDataFrame([(x, y, 0) for x, y in rows], "text string, toxic int, half int"))
    first, second, both = toxicity.models(counts, {(0, 0): 41, (1, 0): 41})
    assert second is None and first.word["foul"] > 0.5 and not {"rare", "scarce"} & set(both.word) and both.pair
    for text in [rows[0][0], "w1 w2 foul " * 3, "rare scarce never seen", "foul foul w3 foul"]:
        want = sum(math.log(chance(t, 1, v, w) / chance(o, 0, v, w)) for v, w in bigrams(text)) / len(bigrams(text))
        assert abs(toxicity.evidence(both, [text])[0] - 100 * want) < 1e-9
    both.slope = 0.5
    texts = ["w1 w2 " * 10, "w1 w2 foul " * 3 + "w1 " * 11, "foul " * 20, ""]
    score = {r["doc_id"]: r["score"] for r in toxicity.scored(documents(spark, list(enumerate(texts))), both).collect()}
    assert score[0] < score[1] < score[2] and score[0] >= 0 and score[3] < 0.5


def test_toxicity_slope_and_empty_tables(spark):
    assert toxicity.logistic(np.array([1.0, 2, 3, 0]), np.array([0.0, 0, 0, 1]))[1] == toxicity.SLOPE
    assert toxicity.query(documents(spark, []), spark.createDataFrame([(1, 0, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")).count() == 0


def test_frequent_words_come_from_all_training_texts(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["aa", "bb", "cc"]) if rng.random() < 0.5 else f"x{rng.randint(0, 10**6)}" for _ in range(60)) for _ in range(300)]
    found = language_model.hot_words(documents(spark, list(enumerate(texts))).repartition(7), 20)
    assert set(found[:3]) == {b"aa", b"bb", b"cc"} and len(found) <= 20
    from collections import Counter

    kept = language_model.shortened(Counter({b"a": 9, b"b": 5, b"c": 5, b"d": 1}), 2)
    assert kept == Counter({b"a": 4}) and language_model.shortened(Counter({b"a": 2}), 5) == Counter({b"a": 2})


def test_language_model_base_and_normalisation(spark):
    docs = documents(spark, HARD + [(k, f"alpha beta gamma{k % 3} delta.") for k in range(30, 60)])
    out = language_model.scored(docs).collect()
    assert len(out) == len(HARD) + 30 and all(r["score"] < 0 for r in out)
    from collections import Counter
    counts = Counter()
    texts = HARD + [(k, f"alpha beta gamma{k % 3} delta.") for k in range(30, 60)]
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    for i, t in texts:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(tokens(t))
    total, size = sum(counts.values()), len(counts)
    want = {i: sum(np.log10((counts[w] + 1) / (total + size + 1)) for w in tokens(t)) for i, t in texts}
    for r in out:
        assert r["train_tokens"] == total and abs(r["base_score"] - want[r["doc_id"]]) < 1e-6 * abs(want[r["doc_id"]])
    net = language_model.trained([[b"a", b"b"] * 40] * 80)
    every = [np.array([s, net.end]) for s in range(net.p["bw"].shape[0])]
    first = [np.array([s]) for s in range(net.p["bw"].shape[0])]
    assert len(every) == len(first) and abs((10 ** language_model.log_likelihoods(net, first)).sum() - 1) < 1e-3
    text = np.array([net.words[b"a"], net.words[b"b"]] * 400)
    alone = language_model.log_likelihoods(net, [text])[0]
    assert abs(language_model.log_likelihoods(net, [text, text[:3], text[:500]])[0] - alone) < 1e-3 * abs(alone)


def test_language_model_learns_from_what_lies_beyond_a_sample(spark):
    noise = " ".join(f"w{k % 50}" for k in range(1024))
    rows = [(k, noise + " left right" * 400) for k in range(60)]
    docs = spark.createDataFrame(rows + [(k, "left right" + " left right" * 200) for k in range(60, 100)], "doc_id long, text string").where(~language_model.held_out() & (F.col("doc_id") < 60) | language_model.held_out() & (F.col("doc_id") >= 60))
    out = [r for r in language_model.scored(docs).collect() if r["held_out"]]
    assert out and all(r["score"] > r["base_score"] for r in out)


def test_empty_tables(spark):
    assert language_model.scored(documents(spark, [])).count() == 0 and media.digest(documents(spark, [])).count() == 0
    assert pii.personal_data(documents(spark, [])).count() == 0 and sharding.query(documents(spark, [])).count() == 0


def test_gradients_match_differences():
    net = language_model.trained([[b"a", b"b", b"c"] * 3])
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, net.p["bw"].shape[0], (2, 3, 4))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    h = np.zeros((3, language_model.HIDDEN))

    def loss():
        out, at = 0.0, h
        for t in range(4):
            z, _, c = language_model.step(net.p, at, net.p["x"][x[:, t]])
            at = (1 - z) * c + z * at
            cls = net.class_of(y[:, t])
            logp = language_model.log_softmax(at @ net.p["c"] + net.p["bc"])[np.arange(3), cls]
            for r in range(3):
                lo, hi = net.bounds[cls[r]], net.bounds[cls[r] + 1]
                logp[r] += language_model.log_softmax(at[r : r + 1] @ net.p["w"][:, lo:hi] + net.p["bw"][lo:hi])[0, y[r, t] - lo]
            out -= logp.sum()
            at = np.where((y[:, t] == net.end)[:, None], 0, at)
        return out / 12

    grads, _ = language_model.backward(net, x, y, h)
    for name, at in (("u", (1, 5)), ("u", (2, language_model.HIDDEN * 2 + 3)), ("x", (x[0, 0], 4)), ("c", (0, 0)), ("bw", (int(y[0, 0]),))):
        kept = net.p[name][at]
        net.p[name][at] = kept + 1e-5
        up = loss()
        net.p[name][at] = kept - 1e-5
        down = loss()
        net.p[name][at] = kept
        assert abs((up - down) / 2e-5 - grads[name][at]) < 1e-4


def test_hilbert_curve_steps_by_one():
    import itertools
    for dims, bits in ((2, 3), (3, 2)):
        points = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        at = sharding.curve_index(points, bits)
        assert sorted(at) == list(range(len(points)))
        assert np.abs(np.diff(points[np.argsort(at)], axis=0)).sum(1).max() == 1


@pytest.mark.parametrize("rows", [HARD, [], [(i, "x" * (i % 50)) for i in range(500)]])
def test_shards_are_even_and_gapless(spark, rows):
    out = sharding.query(documents(spark, rows)).toPandas()
    assert len(out) == len(rows)
    for _, part in out.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    if len(rows) == 500:
        sizes = out.groupby("shard")["size"].sum()
        assert len(sizes) == 16 and sizes.max() - sizes.min() <= 120


def test_equal_texts_share_a_shard_and_sizes_stay_near(spark):
    rng = random.Random(12)
    texts = [f"t{k} " * rng.randint(1, 60) for k in range(900)]
    rows = [(i, rng.choice(texts)) for i in range(3000)] + [(5000 + k, "a large group of equal texts " * 4) for k in range(60)] + [(7000 + k, "the hot one " * 9) for k in range(900)]
    out = sharding.query(documents(spark, rows)).toPandas()
    assert len(out) == len(rows)
    sizes = out.groupby("shard")["size"].sum()
    assert len(sizes) == 16 and sizes.max() - sizes.min() < 0.05 * sizes.mean()
    for _, part in out.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    by_group = out.groupby("text_crc32")["shard"].nunique()
    hot = zlib.crc32(("the hot one " * 9).encode())
    assert by_group[by_group > 1].index.tolist() == [hot]  # alone larger than a shard


def test_written_shards_hold_every_row(spark, tmp_path):
    docs = documents(spark, HARD)
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(HARD)


def test_language_model_splits_texts_twice(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(text):
        made.add(1)
        return text

    read = F.udf(seen, "string").asNondeterministic()
    docs = spark.createDataFrame([(k, f"alpha beta gamma{k % 3}") for k in range(70)], "doc_id long, text string")
    assert len(language_model.scored(docs.withColumn("text", read("text"))).collect()) == 70
    assert 70 <= made.value <= 140


def test_language_model_words_and_kinds():
    texts = [None, "", " ", "\x0b\x0cA\tb\r\nC ", "\u00c9\u00a0x Y\u2003y \x1c z\x85", "a\0b  c.", "abcdef, abcdefghij\u00e9", " a"]
    words, ids, owner = language_model.split(pa.array(["cut off", *texts])[1:])
    words = words.to_pylist()
    assert b"" not in words and len(set(words)) == len(words)
    assert [(int(o), words[i]) for i, o in zip(ids, owner, strict=True)] == [(k, w) for k, t in enumerate(texts) for w in (t or "").encode().lower().split()]
    odd = [*words, b"\xc3", b".", b",", b"abcdef\xc3"]
    keys, kinds = language_model.keys_of(pa.array([b"x", *odd], pa.binary())[1:])
    assert kinds.tolist() == [language_model.kind_of(w) for w in odd] == (keys & np.uint64(127)).tolist() and len(set(keys.tolist())) == len(set(odd))
    assert language_model.split(pa.array([], pa.string()))[1].size == language_model.keys_of(pa.array([], pa.binary()))[0].size == 0


@pytest.mark.parametrize("larger", [1, 60])
def test_language_model_scores_equal_plain_sums(larger):
    net = language_model.trained([[b"a", b"b", b"c", b"dd."] * 9] * 5)
    net.p = {k: v * larger for k, v in net.p.items()}
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, net.p["bw"].shape[0], n) for n in (1, 40, 7, 7, 300, *[3] * language_model.TOGETHER)]
    found = language_model.log_likelihoods(net, texts)
    p = net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    for text, got in zip(texts[:8], found[:8], strict=True):
        h, last, want = np.zeros((1, language_model.HIDDEN)), net.end, 0.0
        for s in text:
            z, _, c = language_model.step(p, h, p["x"][[last]])
            h, last, k = (1 - z) * c + z * h, s, net.class_of(s)
            lo, hi = net.bounds[k], net.bounds[k + 1]
            want += language_model.log_softmax(h @ p["c"] + p["bc"])[0, k] + language_model.log_softmax(h @ p["w"][:, lo:hi] + p["bw"][lo:hi])[0, s - lo]
        assert abs(got - want / np.log(10)) < 1e-3 * abs(want)
