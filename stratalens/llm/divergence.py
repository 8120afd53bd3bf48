"""Source divergence audit: how far each source's use of terms lies from the other sources of its language.

A byte-level tokenizer finds terms: the texts of a slice lie one behind another in a UTF-8 buffer, a look-up table folds
A-Z and blanks out what is no letter, and the edges of what is left are the boundaries. Slices are grouped by XXH64; every slice
is compared byte by byte with the first of its hash, and those that differ get a group of their own. Counts and numbers
of documents are summed per (lang, source, term) within the slice, then by Spark. Each language keeps the terms of at least
`least_docs` of its documents.

Kept terms are dealt into blocks by their hash, all sources' counts of a term into one. A block is a CSR matrix of sources by
terms; a source's absent terms all have the same share, so its distance to every other source is one scatter and one
add.reduceat over the stored counts of the others, plus sums for the terms they lack. Blocks give partial sums of
distances and their own best terms, of which Spark sums and ranks. Shares are integers, worked out by long division.

Defined results: null text, lang and source count as empty; a group without terms takes part with counts of zero; a language
that keeps no terms has distances of 0; a language of one source has no pairs and no terms; repeated rows count each;
ties go by item in UTF-8 order; any whole text is read, however long; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batches, checked_broadcast, materialize, small_batches

LEAST_DOCS, SMOOTH, SCALE, BEST_TERMS = 30, 5, 1_000_000_000, 50
SLICE_BYTES, BLOCK_CELLS, MOST_CELLS = 4 << 20, 4096, 1 << 20
TERMS = "lang string, source string, term string, n long, docs long"
FOUND = "lang string, source string, part string, item string, value long"
#: What a byte is within a term: A-Z become a-z, other letters and all bytes from 0x80 stay, 0 ends a term.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one behind another, and where each starts and the last one ends; null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, and the start and end of each term; no term reaches from one text into the next."""
    folded = FOLD[data]
    inside = np.concatenate([[False], folded != 0, [False]])
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:] & (cut | ~inside[:-1]))
    ends = np.flatnonzero(inside[:-1] & (cut | ~inside[1:]))
    return folded, starts, ends


def grouped(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray, digest=xxhash.xxh64_intdigest) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
    """The group of each slice and one slice of each group: slices are in one group only if their bytes are equal."""
    view = memoryview(folded.tobytes())
    hashes = np.fromiter((digest(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    _, first, code = np.unique(hashes, return_index=True, return_inverse=True)
    size, model = ends - starts, first[code]
    same = size == size[model]
    at = np.flatnonzero(same)
    total = np.cumsum(size[at])
    inner = np.arange(total[-1] if len(at) else 0) - np.repeat(total - size[at], size[at])
    equal = folded[np.repeat(starts[at], size[at]) + inner] == folded[np.repeat(starts[model[at]], size[at]) + inner]
    if len(at):
        same[at] = np.logical_and.reduceat(equal, total - size[at])
    others: dict[bytes, int] = {}
    extra = []
    for i in np.flatnonzero(~same).tolist():  # equal hashes of different bytes
        term = bytes(view[starts[i] : ends[i]])
        if term not in others:
            others[term] = len(first) + len(extra)
            extra.append(i)
        code[i] = others[term]
    return code, np.concatenate([first, np.array(extra, first.dtype)])


def count_terms(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of TERMS for a batch of (lang, source, text)."""
    data, offsets = joined(batch.column(2))
    folded, starts, ends = boundaries(data, offsets)
    code, models = grouped(folded, starts, ends)
    named = [pc.fill_null(c, "").dictionary_encode() for c in batch.columns[:2]]
    langs, sources = (c.indices.to_numpy().astype(np.int64) for c in named)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    width, deep = max(1, len(models)), max(1, len(named[1].dictionary))
    key = (langs * deep + sources)[doc] * width + code
    order = np.argsort(key, kind="stable")
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    new[1:] |= doc[1:] != doc[:-1]
    docs = np.add.reduceat(new, at, dtype=np.int64) if len(at) else np.zeros(0, np.int64)
    n, key = np.diff(np.append(at, len(key))), key[at]
    text = folded.tobytes()
    terms = pa.array([text[a:b] for a, b in zip(starts[models].tolist(), ends[models].tolist(), strict=True)], pa.binary()).cast(pa.string())
    group = key // width
    columns = [named[0].dictionary.take(pa.array(group // deep)), named[1].dictionary.take(pa.array(group % deep)), terms.take(pa.array(key % width)), pa.array(n, pa.int64()), pa.array(docs, pa.int64())]
    return pa.record_batch(columns, [x.split()[0] for x in TERMS.split(", ")])


def shares(count: np.ndarray, of: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * count / of) for count <= of < 2^53, digit by digit in base 1000."""
    rest, out = count.astype(np.int64), np.zeros(len(count), np.int64)
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // of, rest % of
    return out + 1


def compare(counts: pa.Table, groups: pa.Table, best: int, smooth: int) -> pa.Table:
    """Rows of FOUND of one block: counts (source, term, n), and its language's groups (lang, source, total, n_terms), of which none may lack."""
    groups = groups.sort_by("source")
    sources, total, n_terms = groups["source"].to_pylist(), groups["total"].to_numpy(), groups["n_terms"].to_numpy()
    coded, place = counts["term"].combine_chunks().dictionary_encode(), {s: i for i, s in enumerate(sources)}
    terms = coded.dictionary.to_pylist()
    row, col, n = np.array([place[s] for s in counts["source"].to_pylist()], np.int64), coded.indices.to_numpy().astype(np.int64), counts["n"].to_numpy()
    order = np.lexsort((col, row))
    row, col, n = row[order], col[order], n[order]
    start = np.searchsorted(row, np.arange(len(sources) + 1))
    of = np.maximum(total + smooth * n_terms, 1)
    absent = shares(np.full(len(sources), smooth, np.int64), of) if len(terms) else np.zeros(len(sources), np.int64)
    p = shares(n + smooth, of[row])

    by_term = np.argsort(col, kind="stable")
    heads = np.searchsorted(col[by_term], np.arange(len(terms)))
    q = shares(np.add.reduceat(n[by_term], heads) + smooth, int(total.sum()) + smooth * int(n_terms[0])) if len(terms) else np.zeros(0, np.int64)
    rank = np.zeros(len(terms), np.int64)
    rank[sorted(range(len(terms)), key=lambda i: terms[i].encode())] = np.arange(len(terms))
    more = np.flatnonzero(p > q[col])
    gain = p[more] - q[col[more]]
    order = np.lexsort((rank[col[more]], -gain, row[more]))
    more, gain = more[order], gain[order]
    among = np.arange(len(more)) - np.searchsorted(row[more], row[more])
    more, gain = more[among < best], gain[among < best]
    found = [pa.table({"source": pa.array([sources[i] for i in row[more]], pa.string()), "part": pa.array(["term"] * len(more), pa.string()), "item": pa.array([terms[i] for i in col[more]], pa.string()), "value": pa.array(gain, pa.int64())})]

    for s in range(len(sources) - 1):
        own, used = np.full(len(terms), absent[s]), slice(start[s], start[s + 1])
        own[col[used]] = p[used]
        have = np.sort(p[used])
        sums = np.concatenate([[0], np.cumsum(have)])
        theirs = absent[s + 1 :]
        k = np.searchsorted(have, theirs)
        value = theirs * (2 * k - len(have)) - 2 * sums[k] + sums[-1] + (len(terms) - len(have)) * np.abs(theirs - absent[s])  # as if they had no term
        rest = slice(start[s + 1], None)
        here = own[col[rest]]
        change = np.abs(p[rest] - here) - np.abs(absent[row[rest]] - here)
        if len(change):
            others, heads = np.unique(row[rest], return_index=True)
            value[others - s - 1] += np.add.reduceat(change, heads)
        one, two = [sources[s]] * len(value), sources[s + 1 :]
        found += [pa.table({"source": pa.array(a, pa.string()), "part": pa.array(["pair"] * len(value), pa.string()), "item": pa.array(b, pa.string()), "value": pa.array(value, pa.int64())}) for a, b in ((one, two), (two, one))]
    return pa.concat_tables(found)


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, best: int = BEST_TERMS, smooth: int = SMOOTH, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: each source's distance to every other of its language, and the terms it uses more than its language."""
    small_batches(docs.sparkSession)

    def scan(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames, SLICE_BYTES, "divergence"):
            yield count_terms(batch)

    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(to) for c, to in ((lang_col, "lang"), (source_col, "source")))
    found = docs.select(lang, source, F.col(text_col).alias("text")).mapInArrow(scan, TERMS)
    counts = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = W.partitionBy("lang", "term")
    kept = counts.withColumn("in_docs", F.sum("docs").over(term)).filter(F.col("in_docs") >= least_docs)
    kept = materialize(kept.withColumn("lead", (F.col("source") == F.min("source").over(term)).cast("long")).select("lang", "source", "term", "n", "lead"), "kept-terms")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("lead").alias("leads"), F.count(F.lit(1)).alias("cells"))
    groups = docs.select(lang, source).distinct().join(sums, ["lang", "source"], "left").fillna(0, ["total", "leads", "cells"])
    groups = materialize(groups, "term-groups")  # one row a group
    cells = F.greatest(F.lit(BLOCK_CELLS), F.least(F.lit(MOST_CELLS), F.count(F.lit(1)) * F.count(F.lit(1))))
    langs = groups.groupBy("lang").agg(F.sum("leads").alias("n_terms"), F.greatest(F.lit(1), F.ceil(F.sum("cells") / cells)).cast("int").alias("blocks"))
    langs = checked_broadcast(materialize(langs, "langs"))
    cut = kept.join(langs, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "source", "term", "n")
    met = groups.join(langs, "lang").select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", "total", "n_terms")

    def block(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = compare(left, right, best, smooth)
        return out.add_column(0, "lang", pa.array([key[0].as_py()] * len(out), pa.string()))

    parts = materialize(cut.groupBy("lang", "block").cogroup(met.groupBy("lang", "block")).applyInArrow(block, FOUND), "divergences")
    pairs = parts.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = parts.filter("part = 'term'").withColumn("rank", rank).filter(F.col("rank") <= best)
    return pairs.withColumn("rank", rank).unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
