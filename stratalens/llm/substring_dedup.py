"""Substring deduplication by de Bruijn compaction of repeated token k-mers.

Every run of WINDOW words is an edge from its first to its last WINDOW-1 words. Consecutive edges of a document
that share their minimizer (the least hash of ANCHOR words inside) are one piece of path; equal edges share it,
so a minimizer's pieces hold all occurrences of its edges. A piece's content is a 128-bit digest of its words, read at
their source coordinates. A Spark aggregation over minimizers tells the pieces
whose minimizer occurs once (no edge of theirs repeats), those whose minimizer always has the same content
(nonbranching: all their edges repeat) and the rest, where contents differ (branching). A join brings that back
to the documents, runs of nonbranching pieces compact into one path each, and only the edges of branching
pieces are compared one by one, by such a digest too. The union of what repeats is removed.

Texts with a repeated piece are shuffled once, others not at all; of documents with branching pieces the text is kept
until their edges are decided. Documents are told apart by 96 bits of hashes of doc_id and text.

Defined results: null text has no words; documents of fewer than WINDOW words lose none; rows that repeat doc_id
and text repeat each other's words; overlaps within one document count; a null doc_id is a document like any
other; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import apart, batches, materialize, scratch, small_batches, texts_of

WINDOW, ANCHOR, SLICE_BYTES = 35, 8, 1 << 20
U = np.uint64


def word_hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of each word."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0x9E3779B97F4A7C15)
    return h ^ (h >> U(29))


def run_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` items, joined from runs of powers of two."""
    out, at, width = None, 0, 1
    while True:
        if size & width:
            out = h[: len(h)] if out is None else mixed(out[: max(0, len(h) - at)] * U(0xC2B2AE3D27D4EB4F) + h[at:])
            at += width
        if (width := width * 2) > size:
            return out
        h = mixed(h[:-width // 2 or None] * U(0x165667B19E3779F9) + h[width // 2 :])


def least_positions(h: np.ndarray, size: int) -> np.ndarray:
    """For each run of `size` items the position of the least, the first of equal ones."""
    def lesser(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = min(len(a), len(b))
        return np.where(h[a[:n]] <= h[b[:n]], a[:n], b[:n])

    out, at, width, best = None, 0, 1, np.arange(len(h))
    while True:
        if size & width:
            out = best if out is None else lesser(out, best[at:])
            at += width
        if (width := width * 2) > size:
            return out
        best = lesser(best, best[width // 2 :])


def pieces_of(counts: np.ndarray, hashes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """document, minimizer, first edge, number of edges and first word among all words of each piece; counts: words of each document."""
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    if len(hashes) < window:
        return (np.zeros(0, np.int64),) * 5
    short = run_hashes(hashes, anchor)
    n_edges = len(hashes) - window + 1
    where = least_positions(short, window - anchor + 1)[:n_edges]
    doc = np.repeat(np.arange(len(counts)), counts)[:n_edges]
    first = np.arange(n_edges)
    valid = first + window <= (starts + counts)[doc]
    first, where, doc = first[valid], where[valid], doc[valid]
    if not len(first):
        return (np.zeros(0, np.int64),) * 5
    new = np.ones(len(first), bool)
    new[1:] = (where[1:] != where[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    n = np.diff(np.concatenate([at, [len(first)]]))
    return doc[at], short[where[at]].astype(np.int64), first[at] - starts[doc[at]], n, first[at]


def digests(words: list[bytes], first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """128-bit digest, as two integers, of each run of n words from `first` on."""
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(joined[a:b]) for a, b in zip(starts[first].tolist(), ends[first + n - 1].tolist(), strict=True)]), "<i8").reshape(-1, 2)


def spans_of(first: list[int], n: list[int], window: int) -> list[tuple[int, int]]:
    """Word spans (start, end) that runs of edges cover, merged."""
    out: list[tuple[int, int]] = []
    for a, k in sorted(zip(first, n, strict=True)):
        end = a + k + window - 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((a, end))
    return out


def without(words: list[bytes], spans: list[tuple[int, int]]) -> list[bytes]:
    out, at = [], 0
    for a, b in spans:
        out += words[at:a]
        at = b
    return out + words[at:]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key and check (hashes that name the document), name, doc_id, text and the document's other columns as one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    doc_id: Column = F.col(id_col).cast("long")
    return docs.select(F.xxhash64(doc_id, text).alias("key"), F.hash(text, doc_id).alias("check"), F.coalesce(doc_id.cast("string"), F.lit("null")).alias("name"), doc_id.alias("doc_id"), text.alias("text"), F.struct(F.lit(True).alias("__any"), *(c for c in docs.columns if c != text_col)).alias("row"))


PIECE = ("least", "c", "d", "key", "check", "first", "n")
FOUND = "key long, name string, doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, text string, first array<int>, n array<int>, edges array<struct<a:long,b:long,first:int>>"


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, and with_text: kept (what is left, by one space between words if any is removed) and row (its other columns)."""
    small_batches(docs.sparkSession)
    rows = keyed(docs if with_text else docs.select(id_col, text_col), id_col, text_col)
    if not with_text:
        rows = rows.withColumn("row", F.struct(F.lit(True).alias("none")))
    carried = f"row {rows.schema['row'].dataType.simpleString()}"

    def cut(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in slices(frames, SLICE_BYTES):
            split = [t.split() for t in texts_of(table.column(2))]
            words = [w for some in split for w in some]
            doc, least, first, n, at_word = pieces_of(np.array([len(w) for w in split], np.int64), word_hashes(words), window, anchor)
            content = digests(words, at_word, n + window - 1) if len(doc) else np.zeros((0, 2), np.int64)
            columns = (least, content[:, 0], content[:, 1], table.column(0).to_numpy()[doc], table.column(1).to_numpy()[doc], first, n)
            for at in range(0, len(doc), 50_000):
                yield pa.record_batch([pa.array(x[at : at + 50_000], pa.int32() if name in ("check", "first", "n") else pa.int64()) for x, name in zip(columns, PIECE, strict=True)], PIECE)

    def decide(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames, SLICE_BYTES):
            out: dict[str, list] = {c: [] for c in ("n_words", "n_removed", "kept_sha256", "kept", "text", "first", "n")}
            found, sizes = [], []
            for text, pieces in zip(texts_of(batch.column(3)), batch.column(4).to_pylist(), strict=True):
                words = text.split()
                # nonbranching pieces that follow one another are one path
                paths: list[list[int]] = []
                for p in pieces or ():
                    if p["single"]:
                        if paths and p["first"] <= paths[-1][0] + paths[-1][1]:
                            paths[-1][1] = max(paths[-1][1], p["first"] + p["n"] - paths[-1][0])
                        else:
                            paths.append([p["first"], p["n"]])
                firsts, lengths = [a for a, _ in paths], [k for _, k in paths]
                spans = spans_of(firsts, lengths, window)
                row: dict = {"n_words": len(words)}
                branching = [p for p in pieces or () if not p["single"]]
                sizes.append(None)
                if branching:
                    edges = np.concatenate([np.arange(p["first"], p["first"] + p["n"]) for p in branching])
                    found.append((digests(words, edges, np.full(len(edges), window)), edges))
                    sizes[-1] = len(edges)
                    # the end of the last span that starts at the edge or before it; 0: none does
                    last = np.array([0, *(b for _, b in spans)])[np.searchsorted([a for a, _ in spans], edges, side="right")]
                if branching and not (edges + window <= last).all():
                    row |= {"text": text.decode(), "first": firsts, "n": lengths}
                else:
                    row |= finished(text, words, spans, with_text)
                for c, values in out.items():
                    values.append(row.get(c))
            content, at = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
            ends = np.cumsum([x or 0 for x in sizes]).tolist()
            offsets = pa.array([*(None if x is None else end - x for x, end in zip(sizes, ends, strict=True)), ends[-1] if ends else 0], pa.int32())
            edge = pa.StructArray.from_arrays([pa.array(content[:, 0]), pa.array(content[:, 1]), pa.array(at.astype(np.int32))], ["a", "b", "first"])
            kinds = {"n_words": pa.int64(), "n_removed": pa.int64(), "first": pa.list_(pa.int32()), "n": pa.list_(pa.int32())}
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), *(pa.array(v, kinds.get(c, pa.string())) for c, v in out.items()), pa.ListArray.from_arrays(offsets, edge), batch.column(5)], [x.split()[0] for x in FOUND.split(", ")] + ["row"])

    with scratch(docs.sparkSession) as keep:
        pieces = materialize(rows.select("key", "check", "text").mapInArrow(cut, "least long, c long, d long, key long, check int, first int, n int"), "pieces")
        same = (F.min("c") == F.max("c")) & (F.min("d") == F.max("d"))
        repeated = materialize(pieces.groupBy("least").agg(F.count(F.lit(1)).alias("times"), same.alias("single")).filter("times > 1").drop("times"), "minimizers")
        held, _ = apart(pieces, F.col("least"), repeated, F.col("least"))
        found = held.join(repeated, "least").select("key", "check", F.struct("first", "n", "single").alias("piece"))
        by_doc = materialize(found.groupBy("key", "check").agg(F.sort_array(F.collect_set("piece")).alias("pieces")), "repeated-pieces")
        maybe, surely = apart(rows, F.col("key"), by_doc, F.col("key"))
        names = ["key", "name", "doc_id", "text", "pieces", "row"]
        whole = maybe.join(by_doc, ["key", "check"], "left").select(names).unionByName(surely.withColumn("pieces", F.lit(None).cast(by_doc.schema["pieces"].dataType)).select(names))
        decided = keep(whole.mapInArrow(decide, f"{FOUND}, {carried}"), "decided")
        edges = materialize(decided.filter("edges is not null").select("key", "name", F.col("text").isNotNull().alias("open"), F.explode("edges").alias("e")).select("key", "name", "open", "e.*"), "edges")
        twice = materialize(edges.groupBy("a", "b").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").drop("times"), "repeated-edges")
        more = keep(edges.filter("open").join(twice, ["a", "b"]).groupBy("key", "name").agg(F.collect_set("first").alias("more")), "repeated-firsts")

    def finish(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames, SLICE_BYTES):
            out = []
            for r in batch.select(["doc_id", "text", "first", "n", "more"]).to_pylist():
                text = r["text"].encode()
                words = text.split()
                spans = spans_of(r["first"] + (r["more"] or []), r["n"] + [1] * len(r["more"] or []), window)
                out.append({"doc_id": r["doc_id"], "n_words": len(words)} | finished(text, words, spans, with_text))
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])).append_column("row", batch.column(5))

    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "row"]
    still = decided.filter("text is not null").select("key", "name", "doc_id", "text", "first", "n", "row").join(more, ["key", "name"], "left").select("doc_id", "text", "first", "n", "more", "row")
    done = decided.filter("text is null").select(names).union(still.mapInArrow(finish, f"doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, {carried}"))
    return done if with_text else done.drop("kept", "row")


def finished(text: bytes, words: list[bytes], spans: list[tuple[int, int]], with_text: bool) -> dict:
    left = b" ".join(without(words, spans) if spans else words)
    return {"n_removed": sum(b - a for a, b in spans), "kept_sha256": hashlib.sha256(left).hexdigest(), "kept": (left if spans else text).decode() if with_text else None}


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with their repeated words removed; texts that lose nothing stay as they are, but a null text becomes empty."""
    found = remove_repeats(docs, id_col=id_col, text_col=text_col, with_text=True)
    return found.select(*(F.col("kept" if c == text_col else f"row.{c}").alias(c) for c in docs.columns))
