"""Hierarchical packing of token streams into windows of several context sizes.

Every full longest window is cut off a document; what remains goes to the tier of the smallest window that
holds it. Tiers are packed from the longest: the longest remainder opens a window, the gap is filled by the
longest remainders of the same or a shorter tier that fit, and the last of the gap by a piece cut off the
shortest. The one window left unfilled at the end is split into powers of two, so no window needs padding.
Windows are dealt to step groups of equal token totals: those of one size as they come, and at the end of the task what is left of all sizes together, longest
first, so that a task has one short group. Each task packs its own rows, in
slices of bounded size, so nothing is shuffled and a task that is run again gives the same windows.

Defined results: a null or empty text is the end id alone; ties go by order within the task; a text of any
length is cut; repeated rows are packed each; other columns are not read.
"""

from __future__ import annotations

import bisect
import os
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Encoder, slices
from .common import small_batches, worker_cache

VOCABULARY, END_ID = "word_bpe_49k.json", 1
TIERS, STEP_TOKENS, SLICE_BYTES = (2048, 1024, 512, 256), 16384, 4 << 20
#: The vocabulary's own split of lower-cased text, and the words that it is applied to here.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
LATIN = regex.compile(r"[\n!-~\u00a1-\u012f\u0131-\u0240]*")
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, step_group long"


class Merges:
    """A vocabulary's merges, applied to many words at once: in each round every word merges its own lowest rank."""

    NONE = np.int32(2**31 - 1)

    def __init__(self, path: str) -> None:
        plain = Encoder(path)
        self.of_byte, self.of_last, self.size = plain.of_byte, plain.of_last, plain.size
        # an open hash table, so that a look-up is a few reads: places follow one another from a pair's hash on
        pairs, places = np.array([*plain.rank], np.int64), 1 << 19
        self.key, self.value, self.probes = np.full(places + 64, -1, np.int64), np.full(places + 64, self.NONE, np.int32), 0
        for pair, at in zip(pairs.tolist(), self.place(pairs).tolist(), strict=True):
            first = at
            while self.key[at] >= 0:
                at += 1
            self.key[at], self.value[at] = pair, plain.rank[pair]
            self.probes = max(self.probes, at - first + 1)
        self.made = np.array([c for _, _, c in plain.parts], np.int32)
        self.twin = np.array([a == b for a, b, _ in plain.parts])

    @staticmethod
    def place(pair: np.ndarray) -> np.ndarray:
        return ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(45)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left.astype(np.int64) * self.size + right
        at = self.place(pair)
        out = np.where(self.key[at] == pair, self.value[at], self.NONE)
        open_ = np.flatnonzero((self.key[at] != pair) & (self.key[at] >= 0))
        for step in range(1, self.probes):
            if not len(open_):
                break
            here = at[open_] + step
            hit = self.key[here] == pair[open_]
            out[open_[hit]] = self.value[here[hit]]
            open_ = open_[~hit & (self.key[here] >= 0)]
        return out

    def __call__(self, words: list[bytes], block: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, which must not be empty, one after another, and the number of each word's; in blocks that fit a cache."""
        parts = [self.merged(words[at : at + block]) for at in range(0, len(words), block)] or [(np.zeros(0, np.uint32), np.zeros(0, np.int64))]
        ids, sizes = zip(*parts, strict=True)
        return np.concatenate(ids), np.concatenate(sizes)

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        count = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        symbol, last = self.of_byte[data], np.cumsum(count) - 1
        symbol[last] = self.of_last[data[last]]
        rank = np.full(len(symbol), self.NONE, np.int32)
        head = np.ones(len(symbol), bool)
        head[last] = False
        inner = np.flatnonzero(head)
        rank[inner] = self.ranks(symbol[inner], symbol[inner + 1])
        word, done = np.arange(len(words)), []
        while len(word):
            least = np.minimum.reduceat(rank, np.cumsum(count) - count)
            over = least == self.NONE
            if over.any():  # these words are ready
                own = np.repeat(over, count)
                done.append((word[over], count[over], symbol[own]))
                symbol, rank, word, count, least = symbol[~own], rank[~own], word[~over], count[~over], least[~over]
                if not len(word):
                    break
            at = np.flatnonzero(rank == np.repeat(least, count))
            if self.twin[rank[at]].any():  # of a run of overlapping pairs of one symbol, every other one
                chained = np.zeros(len(at), bool)
                chained[1:] = (at[1:] == at[:-1] + 1) & self.twin[rank[at[1:]]] & (rank[at[1:]] == rank[at[:-1]])
                starts = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - starts) % 2 == 0]
            ends = np.cumsum(count)
            symbol[at] = self.made[rank[at]]
            stays = np.ones(len(symbol), bool)
            stays[at + 1] = False
            place = at - np.arange(len(at))  # of the merged symbols when what they took is gone
            gone = np.bincount(np.searchsorted(ends, at, side="right"), minlength=len(word))
            symbol, rank, count = symbol[stays], rank[stays], count - gone
            ends = np.cumsum(count)
            final = np.zeros(len(symbol), bool)
            final[ends - 1] = True
            begun = np.zeros(len(symbol), bool)
            begun[ends - count] = True
            new = np.concatenate([place, place[~begun[place]] - 1])
            rank[new] = self.NONE
            new = new[~final[new]]
            rank[new] = self.ranks(symbol[new], symbol[new + 1])
        sizes = np.zeros(len(words), np.int64)
        for which, size, _ in done:
            sizes[which] = size
        at, out = np.cumsum(sizes) - sizes, np.zeros(sizes.sum(), np.uint32)
        for which, size, ids in done:
            out[np.repeat(at[which] - (np.cumsum(size) - size), size) + np.arange(len(ids))] = ids
        return out, sizes


def gathered(known: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of `known` (of these sizes, one after another) that the codes name, one after another, and where each ends; fewer than 2^31 values."""
    size = sizes[codes]
    ends = np.cumsum(size)
    at = np.repeat(((np.cumsum(sizes) - sizes)[codes] - (ends - size)).astype(np.int32), size)
    at += np.arange(len(at), dtype=np.int32)
    return known[at], ends


class WordTokens:
    """Ids per white-space separated word; the vocabulary drops white space, so words are independent.

    A slice's distinct words are split into their distinct pre-tokens, and these merged together. Words of other than
    Latin letters, digits and signs go to the tokenizers library.
    """

    def __init__(self, path: str) -> None:
        self.path = path
        self.merges = Merges(path)

    @cached_property
    def tokenizer(self):  # noqa: ANN201
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words, one after another, and the number of each word's."""
        plain = [t.isascii() and t.isprintable() and "<|" not in t or bool(LATIN.fullmatch(t)) and "<|" not in t for t in words]
        others = [t for t, ok in zip(words, plain, strict=True) if not ok]
        texts = unicodedata.normalize("NFC", "\n".join([t if ok else "" for t, ok in zip(words, plain, strict=True)])).lower().split("\n") if words else []
        tokens: dict[str, int] = {}
        code = tokens.setdefault
        parts = [(t,) if t.isalpha() else (t[:-1], t[-1]) if t[:-1].isalpha() else PRE_TOKEN.findall(t) for t in texts]
        codes = np.array([code(p, len(tokens)) for some in parts for p in some], np.int64)
        count = np.fromiter(map(len, parts), np.int64, len(parts))
        known, sizes = self.merges([t.encode() for t in tokens])
        if others:  # each is a token of its own
            found = [e.ids for at in range(0, len(others), 8192) for e in self.tokenizer.encode_batch_fast(others[at : at + 8192], add_special_tokens=False)]
            known = np.concatenate([known, *(np.array(x, np.uint32) for x in found)])
            where = np.flatnonzero(~np.array(plain))
            codes = np.insert(codes, np.cumsum(count)[where], len(sizes) + np.arange(len(others)))
            sizes = np.concatenate([sizes, np.fromiter(map(len, found), np.int64, len(found))])
            count[where] += 1
        ids, ends = gathered(known, sizes, codes)
        last = np.concatenate([[0], ends])[np.cumsum(count)]
        return ids, np.diff(last, prepend=0)

    def encode(self, texts: pa.Array | pa.ChunkedArray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, `end` behind each, and the offset at which each text starts and the last one stops."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))  # a text that starts or ends in white space has an empty word there
        split = split.combine_chunks() if isinstance(split, pa.ChunkedArray) else split
        if isinstance(split, pa.ChunkedArray):
            split = pa.concat_arrays(split.chunks)
        coded = split.flatten().dictionary_encode()
        known, sizes = self.learn(coded.dictionary.to_pylist())
        bounds, codes = np.asarray(split.offsets).astype(np.int64), coded.indices.to_numpy()
        bounds -= bounds[0]
        if end is not None:
            codes = np.insert(codes, bounds[1:], len(sizes))
            known, sizes = np.append(known, np.uint32(end)), np.append(sizes, 1)
            bounds = bounds + np.arange(len(bounds))
        ids, ends = gathered(known, sizes, codes)
        return ids, np.concatenate([[0], ends])[bounds]


def word_tokens(vocabulary: str) -> WordTokens:
    kept = worker_cache("packing vocabularies")
    if vocabulary not in kept:
        kept[vocabulary] = WordTokens(public_tokenizers.path(vocabulary))
    return kept[vocabulary]


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (document, start, length); all but powers of two are full. tiers: powers of two, descending."""
    longest, windows, pool = tiers[0], [], []
    for doc, n in enumerate(lengths):
        whole = n - n % longest
        windows += [[(doc, at, longest)] for at in range(0, whole, longest)]
        if n > whole:
            pool.append((n - whole, doc, whole))
    pool.sort()
    while pool:
        tier = min(t for t in tiers if t >= pool[-1][0])
        n, doc, start = pool.pop()
        window, gap = [(doc, start, n)], tier - n
        while gap and pool:
            i = bisect.bisect_right(pool, (gap, len(lengths), 0)) - 1
            if i >= 0:
                n, doc, start = pool.pop(i)
                window.append((doc, start, n))
                gap -= n
            else:  # all are longer than the gap: cut the shortest
                n, doc, start = pool.pop(0)
                window.append((doc, start, gap))
                bisect.insort(pool, (n - gap, doc, start + gap))
                gap = 0
        if not gap:
            windows.append(window)
            continue
        left = tier - gap
        while left:  # the last one: into powers of two
            size, part = 1 << (left.bit_length() - 1), []
            left -= size
            while size:
                doc, start, n = window[0]
                take = min(n, size)
                part.append((doc, start, take))
                size -= take
                window[:1] = [(doc, start + take, n - take)] if take < n else []
            windows.append(part)
    return windows


class StepGroups:
    """Deals windows to groups of `step_tokens`, numbered from `first`. Sizes are powers of two up to it, so every group but the last is full; what waits is less than a group of each size."""

    def __init__(self, first: int, step_tokens: int) -> None:
        self.group, self.step, self.waiting = first, step_tokens, defaultdict(list)

    def full(self, size: int, window: object) -> tuple[int, list] | None:
        """The group's number and windows, once this one fills it."""
        own = self.waiting[size]
        own.append(window)
        if len(own) * size < self.step:
            return None
        self.group += 1
        return self.group - 1, self.waiting.pop(size)

    def rest(self) -> Iterator[tuple[int, list]]:
        total = 0
        for size in sorted(self.waiting, reverse=True):
            for window in self.waiting[size]:
                yield self.group + total // self.step, [window]
                total += size


def pack_documents(docs: DataFrame, vocabulary: str = VOCABULARY, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per piece of a document; see PIECES. slice_bytes: of texts that are packed together; a task holds some tens of times that."""
    small_batches(docs.sparkSession)
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(tiers, reverse=True):
        raise ValueError("tiers must be powers of two, descending")
    if step_tokens & (step_tokens - 1) or step_tokens < tiers[0]:
        raise ValueError("a step must be a power of two, and hold a window")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, task = word_tokens(vocabulary), TaskContext.get().partitionId()
        first, groups = task << 40, StepGroups(task << 40, step_tokens)
        names = [x.split()[0] for x in PIECES.split(", ")]

        def batch(rows: list) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

        for table in slices(frames, slice_bytes, "packing"):
            doc_ids = table.column(0).to_pylist()
            ids, bounds = tokens.encode(table.column(1), END_ID)
            data, starts, lengths = memoryview(ids).cast("B"), bounds[:-1].tolist(), np.diff(bounds).tolist()
            rows, windows = [], pack(lengths, tiers)
            for i, window in enumerate(windows):
                size, offset, own = sum(n for _, _, n in window), 0, []
                for doc, start, n in window:
                    at = starts[doc] + start
                    own.append((doc_ids[doc], start, n, zlib.crc32(data[4 * at : 4 * (at + n)]), lengths[doc], first + i, offset, size))
                    offset += n
                if full := groups.full(size, own):
                    rows += [(*row, full[0]) for some in full[1] for row in some]
            first += len(windows)
            for at in range(0, len(rows), 20_000):
                yield batch(rows[at : at + 20_000])
        if rows := [(*row, group) for group, some in groups.rest() for own in some for row in own]:
            yield batch(rows)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)
