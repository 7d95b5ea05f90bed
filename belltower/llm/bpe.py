"""Byte-level BPE: encoding by a priority queue of merge ranks, decoding by joining vocabulary strings.

Cases: null and empty texts give no tokens; a text of any length is encoded whole; equal
texts give equal rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
from functools import cache
from heapq import heapify, heappop, heappush
from itertools import pairwise

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from belltower.llm.common import by_batch, keeps, sha256, texts

#: Fixed values of the vocabulary file's own pre-tokenizer: contractions, words, numbers, other signs, white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What the pieces that a worker remembers may weigh, in bytes; beyond half of it a new half begins, and those of the older half that aren't met meanwhile go. Longer pieces aren't remembered.
MEMORY, WEIGHT, LONGEST = 40_000_000, 220, 64


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters, spare = [], 0x100
    for b in range(256):
        letters.append(chr(b) if b in shown else chr(spare))
        spare += b not in shown
    return letters


class Codec:
    """Encoder and decoder over one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        of_letter = {c: b for b, c in enumerate(letters)}
        vocab = spec["model"]["vocab"]
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.first = [vocab[c] for c in letters]  # id of each single byte
        self.strings = {str(i): bytes(of_letter[c] for c in s) for s, i in vocab.items()} | {str(i): s.encode() for s, i in added.items()}
        self.ranks: dict[int, int] = {}  # of a pair of ids, packed in one number
        self.made: list[int] = []  # what the pair of each rank becomes
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault(vocab[a] << 32 | vocab[b], rank)
            self.made.append(vocab[a + b])
        self.added = added
        self.split_added = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.pieces = regex.compile(PATTERN)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, str] = {}  # of a piece, its ids as decimals joined by commas
        self.older: dict[str, str] = {}
        self.held = 0  # by known

    def merge(self, data: bytes) -> tuple[int, ...]:
        """BPE of one piece. Symbols are a doubly linked list; the queue holds ranks and places packed in one number, and an entry whose rank is no longer that of the pair at its place is stale."""
        ids = [self.first[b] for b in data]
        n = len(ids)
        if n < 2:
            return tuple(ids)
        ranks, made, none = self.ranks.get, self.made, -1
        now = [ranks(a << 32 | b, none) for a, b in pairwise(ids)]  # of the pair that begins at each place
        now.append(none)
        bits = n.bit_length()
        place = (1 << bits) - 1
        queue = [r << bits | i for i, r in enumerate(now) if r >= 0]
        heapify(queue)
        before, after = list(range(-1, n)), list(range(1, n + 1))
        while queue:
            x = heappop(queue)
            i = x & place
            if now[i] != x >> bits:
                continue  # stale
            j = after[i]
            k = after[j]
            ids[i] = a = made[x >> bits]
            ids[j] = now[j] = none
            after[i], before[k] = k, i
            now[i] = r = ranks(a << 32 | ids[k], none) if k < n else none
            if r >= 0:
                heappush(queue, r << bits | i)
            if (h := before[i]) >= 0:
                now[h] = r = ranks(ids[h] << 32 | a, none)
                if r >= 0:
                    heappush(queue, r << bits | h)
        return tuple(x for x in ids if x >= 0)

    def learn(self, piece: str) -> None:
        ids = self.older.pop(piece, None)
        self.known[piece] = ",".join(map(str, self.merge(piece.encode()))) if ids is None else ids
        self.held += WEIGHT + 4 * len(piece)

    def shown(self, text: str) -> str:
        """Token ids as decimals joined by commas."""
        if not text:
            return ""
        if self.split_added is not None and self.split_added.search(text):
            return ",".join(str(self.added[part]) if k % 2 else self.shown(part) for k, part in enumerate(self.split_added.split(text)) if part)
        pieces = self.pieces.findall(text)
        if self.held > MEMORY // 2:
            self.known, self.older, self.held = {}, self.known, 0
        new = set(pieces).difference(self.known)
        for p in new:
            self.learn(p)
        out = ",".join(map(self.known.__getitem__, pieces))
        for p in new:
            if len(p) > LONGEST:
                self.held -= WEIGHT + 4 * len(p)
                del self.known[p]
        return out

    def encode(self, text: str) -> tuple[list[int], str]:
        """Token ids, and the same as decimals joined by commas."""
        shown = self.shown(text)
        return list(map(int, split(shown))), shown

    def read(self, decimals: list[str]) -> str:
        """The text of ids given as decimals."""
        return b"".join(map(self.strings.__getitem__, decimals)).decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        return self.read(list(map(str, ids)))


def split(ids: str) -> list[str]:
    return ids.split(",") if ids else []


@cache
def codec(path: str) -> Codec:
    """One codec for each worker process and file, until the process works for another operator."""
    keeps("bpe", codec.cache_clear)
    return Codec(path)


def encoded(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, the token ids of each whole text, and the text decoded from them."""

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        ids = [c.encode(t)[0] for t in texts(b.column(text))]
        return pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(ids, pa.list_(pa.int32())), pa.array([c.decode(x) for x in ids], pa.string())], names=[*keep, "ids", "decoded"])

    kept = docs.select(*dict.fromkeys((*keep, text)))
    types = ", ".join(f"`{k}` {kept.schema[k].dataType.simpleString()}" for k in keep)
    return by_batch(kept, f, f"{types}, ids array<int>, decoded string", "bpe")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text; the ids themselves stay in the task."""

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        n, of_ids, of_text = [], [], []
        for t in texts(b.column("text")):
            shown = c.shown(t)
            ids = split(shown)
            n.append(len(ids))
            of_ids.append(sha256(shown.encode()))
            of_text.append(sha256(c.read(ids).encode()))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_text)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return by_batch(docs.select("doc_id", "text"), f, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", "bpe")
