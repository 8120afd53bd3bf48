"""Byte-level BPE by a pair occurrence index over each partition's distinct words.

The distinct pre-tokens of a slice of a partition are laid out as one array of symbols. An index maps every
adjacent pair that has a merge rank to all its positions; ranks that are active are taken in ascending order,
each merge is applied to all its positions at once, and the lists of the pairs that arise are updated.
As words don't touch, that equals merging each word by its own lowest rank. Results are kept per word.

Defined results: null text counts as empty (no tokens); the special token's string in a text becomes its id,
as the tokenizers library has it; any whole text is encoded, however long; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, forget_unused, small_batches, texts_of, worker_cache

VOCABULARY = "byte_bpe_50k.json"
SLICE_BYTES, CACHE_WORDS = 8 << 20, 300_000

_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"  # white space as the library has it
PRE_TOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: A run of blanks and line ends with the word behind it is pre-tokenised the same wherever it stands, if a text holds no other white space.
UNIT = re.compile(rb"[ \n]*[^ \n]+|[ \n]+")
OTHER_SPACE = re.compile(rb"[\t\x0b\x0c\r]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary -> the byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """One vocabulary with its merges."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, chars = spec["model"]["vocab"], byte_characters()
        self.size = max(vocab.values()) + 1
        self.of_byte = np.zeros(256, dtype=np.int32)
        end = spec["model"].get("end_of_word_suffix") or ""
        self.of_last = self.of_byte.copy()
        for char, byte in chars.items():
            self.of_byte[byte] = vocab[char]
            self.of_last[byte] = vocab[char + end]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.parts = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        self.rank = {a * self.size + b: r for r, (a, b, _) in reversed(list(enumerate(self.parts)))}
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(chars[c] for c in token) if all(c in chars for c in token) else token.encode() for token, i in vocab.items()}
        self.bytes_of |= {i: token for token, i in self.special.items()}
        self.split = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + b")") if self.special else None
        self.words: dict[bytes, bytes] = {}

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, which must not be empty, as little-endian 32-bit integers."""
        if not words:
            return []
        size, lengths = self.size, np.array([len(w) for w in words])
        symbol = self.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        n, ends = len(symbol), np.cumsum(lengths)
        symbol[ends - 1] = self.of_last[np.frombuffer(b"".join([w[-1:] for w in words]), dtype=np.uint8)]
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[ends - 1] = -1
        before[ends - lengths] = -1
        where: dict[int, list[np.ndarray]] = defaultdict(list)
        active: list[int] = []

        def index(at: np.ndarray) -> None:
            """Enter the pairs that start at these positions."""
            at = at[after[at] >= 0]
            if not len(at):
                return
            pair = symbol[at].astype(np.int64) * size + symbol[after[at]]
            order = np.argsort(pair, kind="stable")
            pair, at = pair[order], at[order]
            edges = np.flatnonzero(np.diff(pair)) + 1
            for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(at)], strict=True):
                if (rank := self.rank.get(int(pair[start]))) is not None:
                    if rank not in where:
                        heapq.heappush(active, rank)
                    where[rank].append(at[start:end])

        index(np.arange(n, dtype=np.int32))
        while active:
            rank = heapq.heappop(active)
            lists = where.pop(rank)
            left, right, made = self.parts[rank]
            at = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            at = at[(symbol[at] == left) & (after[at] >= 0)]
            at = at[symbol[after[at]] == right]
            if left == right and len(at) > 1:  # of a run of overlapping pairs, every other one
                chained = np.zeros(len(at), dtype=bool)
                chained[1:] = after[at[:-1]] == at[1:]
                starts = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - starts) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            symbol[at] = made
            symbol[gone] = -1
            after[at] = beyond = after[gone]
            inner = beyond >= 0
            before[beyond[inner]] = at[inner]
            ahead = before[at]
            index(np.unique(np.concatenate([at, ahead[ahead >= 0]])))
        kept = symbol >= 0
        ids = symbol[kept].astype("<u4").tobytes()
        bounds = np.concatenate([[0], np.cumsum(kept)[ends - 1]]) * 4
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def learn(self, units: set[bytes], whole: bool) -> None:
        """Add the ids of units; whole: they are pre-tokens already."""
        new = [u for u in units if u not in self.words]
        parts = [[u] if whole else [p.encode() for p in PRE_TOKEN.findall(u.decode())] for u in new]
        tokens = list({p for ps in parts for p in ps if len(ps) > 1 or p not in self.words})
        ids = dict(zip(tokens, self.merge(tokens), strict=True))
        self.words.update((u, b"".join(map(ids.__getitem__, ps))) for u, ps in zip(new, parts, strict=True))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        self.words = worker_cache("bpe")
        plans: list[list[tuple[list[bytes] | None, bytes]]] = []
        units, tokens = set(), set()
        for text in texts:
            plan = []
            for piece in self.split.split(text) if self.split else [text]:
                if piece in self.special:
                    plan.append((None, self.special[piece].to_bytes(4, "little")))
                elif OTHER_SPACE.search(piece):
                    found = [p.encode() for p in PRE_TOKEN.findall(piece.decode())]
                    tokens.update(found)
                    plan.append((found, b""))
                elif piece:
                    found = UNIT.findall(piece)
                    units.update(found)
                    plan.append((found, b""))
            plans.append(plan)
        self.learn(units, whole=False)
        self.learn(tokens, whole=True)
        out = [b"".join(b"".join(map(self.words.__getitem__, found)) if found is not None else ids for found, ids in plan) for plan in plans]
        forget_unused(self.words, units | tokens, CACHE_WORDS)
        return out

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text that the ids spell; what is no valid UTF-8 becomes U+FFFD."""
        data = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        return data.decode("utf-8", errors="replace").encode()


def encoder(vocabulary: str) -> Encoder:
    kept = worker_cache("bpe vocabularies")
    if vocabulary not in kept:
        kept[vocabulary] = Encoder(public_tokenizers.path(vocabulary))
    return kept[vocabulary]


def slices(frames: Iterator[pa.RecordBatch], most: int = SLICE_BYTES, owner: str = "") -> Iterator[pa.Table]:
    """Row batches gathered to about `most` bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches(frames, most, owner):
        held.append(batch)
        if sum(b.nbytes for b in held) >= most:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def bpe_round_trip(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (binary, unsigned 32-bit little-endian), decoded (string)."""
    small_batches(docs.sparkSession)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for table in slices(frames, SLICE_BYTES, "bpe"):
            encoded = bpe.encode(texts_of(table.column(1)))
            yield from pa.table({
                "doc_id": table.column(0),
                "n_tokens": pa.array([len(x) // 4 for x in encoded], pa.int64()),
                "ids": pa.array(encoded, pa.binary()),
                "decoded": pa.array([bpe.decode(x).decode() for x in encoded], pa.string()),
            }).to_batches()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")
