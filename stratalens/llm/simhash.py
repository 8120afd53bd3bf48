"""SimHash near-duplicates by the generalised pigeonhole principle.

Bits of the fingerprint that go together are grouped into partitions, from the co-occurrence counts of all
fingerprints. If the thresholds t_i of m partitions sum to tau - m + 1, two fingerprints at distance tau or less
are within t_i on some partition i. Dynamic programming chooses the unequal thresholds (-1: partition unused),
and the number of partitions, at the least estimated count of probe rows and candidate pairs. Fingerprints are
probed by their value on each partition with up to t_i bits flipped, verified on all bits in the join itself,
and only links become rows. Equal fingerprints are one node, so copies are never paired.

near_duplicate_clusters is the form for texts that share most of their shingles without sharing nearly all bits.
Two texts of similarity 0.8 on five-word shingles differ in about ten of 64 majority bits, and a fingerprint of more
bits needs hundreds of partitions a text once the corpus is large. So the same pigeonhole is applied to another
fingerprint of the same shingle hashes: MIN_WORDS words, each the least value of one hash function (two texts agree on
a word with a chance equal to their similarity). The bits of a word go together, so partitions are BAND whole words,
with threshold 0: a pair at 0.8 shares one of the PARTS partitions with a chance of 0.998, whatever the number of
texts, and a pair at 0.3 with one of 0.1. Each text meets the first text of its buckets: of EARLY partitions, then of all, and then of all by other orders (SALTS), each time only where
it isn't yet in the first one's group; so a large group is joined by a few pairs a text. Then every pair of a bucket whose texts
are not yet in one group meets, in blocks, the likely pairs before the doubtful: in the end each pair of a bucket is decided or within one
group. A bucket in which over MOST_OUTSIDE texts are outside the first one's group is not met whole, as its pairs would grow with its square: two of its texts meet if
they share a second such bucket as well (a pair at 0.8 shares two of PARTS with a chance of 0.983, at 0.85 of 0.998).

Sets whose sizes differ by more than the similarity allows are never alike. The share of bits that differ between two
majority fingerprints of WIDE 64-bit words gives their cosine and so an estimate of the similarity; where both sets have SMALL shingles or
more, pairs estimated below it by more than DOUBT, four standard deviations, are left out. All others, and so every pair with a smaller set,
are links only if the two whole shingle sets say so. Texts of equal shingle sets are one node, so copies are never paired.

Defined results: null text counts as empty; a text of no words has fingerprint zero, linked like any other;
repeated rows get the same component; a null doc_id takes part but is no component's smallest unless all are
null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, batches, materialize, scratch, small_batches, texts_of, without_keys
from .components import components

BITS, SEED = 64, 42
PROBE_COST, PAIR_COST = 8.0, 1.0


def shingle_hashes(data: bytes, size: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of `size` words, or of all words if they are fewer."""
    words = data.lower().split()  # bytes: A-Z only, at ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(text[a:b], seed) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)), np.uint64, len(words) - size + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Signed 64-bit integer: a bit is 1 if set in over half of the hashes."""
    return int(majority(hashes.reshape(-1, 1))[0])


def majority(hashes: np.ndarray) -> np.ndarray:
    """For each column of 64-bit hashes the signed integer of the bits that are set in over half of its rows."""
    n, width = hashes.shape
    total = np.zeros(width * BITS, np.int64)
    for at in range(0, n, 255):  # counts of 255 rows fit a byte
        part = np.ascontiguousarray(hashes[at : at + 255], dtype="<u8")
        total += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * total > n, bitorder="little").view("<i8")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", carried: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, fp for each document, and the carried columns (longs)."""
    small_batches(docs.sparkSession)
    more = carried or {}
    names = ["doc_id", "fp", *more]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames):
            yield pa.record_batch([batch.column(0), pa.array([fingerprint(shingle_hashes(t, shingle)) for t in texts_of(batch.column(1))], pa.int64()), *batch.columns[2:]], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(c.alias(n) for n, c in more.items()))
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def bit_counts(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and how many have both of two bits set, over all of them."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros((BITS, BITS))
        for batch in frames:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(len(fps), 8), axis=1, bitorder="little").astype(np.float64)
            n, total = n + len(x), total + x.T @ x
        yield pa.record_batch([pa.array([[n, *total.astype(np.int64).ravel().tolist()]], pa.list_(pa.int64()))], ["counts"])

    sums = nodes.select("fp").mapInArrow(run, "counts array<long>").select(F.posexplode("counts")).groupBy("pos").agg(F.sum("col").alias("n"))
    found = dict(sums.collect())  # 1 + 64 * 64 rows
    return found.get(0, 0), np.array([found.get(i + 1, 0) for i in range(BITS * BITS)], dtype=float).reshape(BITS, BITS)


def correlated_groups(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of bits of near equal size; each grows by the free bit that correlates most with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(np.outer(p * (1 - p), p * (1 - p)), 1e-12))
    strength = np.abs(both / max(n, 1) - np.outer(p, p)) / spread
    np.fill_diagonal(strength, 0)
    free, groups = set(range(BITS)), []
    for i in range(m):
        size = BITS // m + (i < BITS % m)
        order = sorted(free)
        group = [max(order, key=lambda b: (strength[b, order].max(), -b))]
        free.discard(group[0])
        while len(group) < size:
            best = max(sorted(free), key=lambda b: (strength[b, group].mean(), -b))
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def within(p: np.ndarray, most: int) -> list[float]:
    """Chance that two fingerprints differ in exactly 0..most of these bits, taken as independent."""
    chances = [1.0] + [0.0] * most
    for d in 2 * p * (1 - p):
        chances = [c * (1 - d) + (chances[i - 1] * d if i else 0.0) for i, c in enumerate(chances)]
    return chances


def allocate(cost: list[list[float]], tau: int) -> tuple[float, list[int]]:
    """Thresholds, each from -1, whose t + 1 sum to tau + 1, at the least cost; cost[i][t + 1] is that of t on partition i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in cost:
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for t1, x in enumerate(own):
                if used + t1 <= tau + 1 and (used + t1 not in after or c + x < after[used + t1][0]):
                    after[used + t1] = (c + x, [*ts, t1 - 1])
        best = after
    return best[tau + 1]


def plan_probes(nodes: DataFrame, tau: int, counts: tuple[int, ...] = (2, 3, 4)) -> list[tuple[int, list[int], int]]:
    """(mask, bits, threshold) of each partition in use; nodes: distinct fp."""
    n, both = bit_counts(nodes)
    p = np.diag(both) / max(n, 1)
    layouts = {m: correlated_groups(n, both, m) for m in counts}
    masks = [(m, i, signed(sum(1 << b for b in bits))) for m in counts for i, bits in enumerate(layouts[m])]
    keys = F.array(*(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(mask)).alias("v")) for k, (_, _, mask) in enumerate(masks)))
    per_value = nodes.select(F.explode(keys).alias("x")).groupBy("x.k", "x.v").agg(F.count(F.lit(1)).alias("n"))
    pairs = dict(per_value.groupBy("k").agg((F.sum(F.col("n").cast("double") * F.col("n") - F.col("n")) / 2).alias("pairs")).collect())
    choices = []
    for m in counts:
        cost = []
        for i, bits in enumerate(layouts[m]):
            k = next(k for k, x in enumerate(masks) if x[:2] == (m, i))
            chance = within(p[bits], tau)
            equal, per = pairs.get(k, 0.0), max(chance[0], 1e-300)
            near = [equal + (equal / per + n) * sum(chance[1 : t + 1]) for t in range(tau + 1)]
            cost.append([0.0] + [PROBE_COST * n * sum(comb(len(bits), d) for d in range(t + 1)) + PAIR_COST * near[t] for t in range(tau + 1)])
        choices.append((*allocate(cost, tau), m))
    _, thresholds, m = min(choices)
    return [(signed(sum(1 << b for b in bits)), bits, t) for bits, t in zip(layouts[m], thresholds, strict=True) if t >= 0]


def differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links_of(nodes: DataFrame, tau: int) -> DataFrame:
    """a, b: distinct fingerprints that differ in tau bits or fewer, each pair at least once; nodes: distinct fp."""
    probes, index = [], []
    for k, (mask, bits, t) in enumerate(plan_probes(nodes, tau)):
        value = F.col("fp").bitwiseAND(F.lit(mask))
        index.append(nodes.select(F.lit(k).alias("k"), value.alias("key"), F.col("fp").alias("b")))
        flips = [0, *(signed(sum(1 << b for b in some)) for d in range(1, t + 1) for some in combinations(bits, d))]
        flipped = nodes.select("fp", F.explode(F.from_json(F.lit(str(flips)), "array<long>")).alias("flip"))
        if t >= 1:  # of two that differ in one bit, the one that lacks it probes
            lone = F.bit_count("flip") == 1
            flipped = flipped.filter(~lone | (F.col("fp").bitwiseAND(F.col("flip")) == 0))
        probes.append(flipped.select(F.lit(k).alias("k"), value.bitwiseXOR(F.col("flip")).alias("key"), F.col("fp").alias("a"), "flip"))
    p, i = reduce(DataFrame.union, probes).alias("p"), reduce(DataFrame.union, index).alias("i")
    near = (F.col("p.k") == F.col("i.k")) & (F.col("p.key") == F.col("i.key")) & (differing(F.col("a"), F.col("b")) <= tau) & ((F.col("flip") != 0) | (F.col("a") < F.col("b")))
    return p.join(i, near).select("a", "b")


def near_duplicates(docs: DataFrame, tau: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fp, component_id (smallest doc_id reachable by links)."""
    prints = materialize(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "nodes")
    roots = components(links_of(nodes.select("fp"), tau)).withColumnRenamed("node", "fp")
    placed = materialize(nodes.join(roots, "fp", "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root")), "placed")
    linked = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    named = placed.join(materialize(linked, "linked"), "root", "left").select("fp", F.coalesce("component_id", "doc_id").alias("component_id"))
    return prints.join(materialize(named, "named"), "fp").select("doc_id", "fp", "component_id")


MIN_WORDS, BAND, WIDE, SHINGLE, SIMILARITY, DOUBT, SMALL, EARLY, SALTS = 48, 4, 32, 5, 0.8, 0.08, 32, 2, 4
PARTS = MIN_WORDS // BAND
BLOCK, MOST_OUTSIDE = 256, 4096  # members of a bucket that meet all others in one task; and of which more are not met whole
#: Odd multipliers that derive the hash functions from one hash.
MULTIPLIERS = np.array([xxhash.xxh64_intdigest(bytes([i]), 1) | 1 for i in range(MIN_WORDS)], dtype=np.uint64)
PRINTS = "row_id long, doc_id long, h long, d1 long, d2 long, n int, keys array<long>, fp array<long>, shingles array<long>"


def least_words(hashes: np.ndarray) -> np.ndarray:
    """For each hash function the least of its values over the hashes, of which there is at least one."""
    best = np.full(MIN_WORDS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 4096):
        h = hashes[at : at + 4096, None] * MULTIPLIERS[None, :]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        np.minimum(best, h.min(axis=0), out=best)
    return best


def partition_keys(words: np.ndarray) -> list[int]:
    """The value of each partition, with its number in it."""
    data = words.astype("<u8").tobytes()
    return [signed(xxhash.xxh64_intdigest(data[8 * BAND * i : 8 * BAND * (i + 1)], i)) for i in range(PARTS)]


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WIDE signed integers of majority bits of as many hash functions over the hashes."""
    h = hashes[:, None] * MULTIPLIERS[None, :WIDE]
    return majority((h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15))


def likely(a: str, b: str, least: float, similarity: float) -> Column:
    """Whether nodes a and b (prefixes of the columns fp and n) may have the similarity, by their sizes and, of larger sets, by an estimate of `least` or more."""
    apart_by = reduce(Column.__add__, (differing(F.col(f"{a}fp")[i], F.col(f"{b}fp")[i]) for i in range(WIDE)))
    one, two = F.col(f"{a}n").cast("double"), F.col(f"{b}n").cast("double")
    shared = F.cos(apart_by * (np.pi / (WIDE * BITS))) * F.sqrt(one * two)
    return (F.least(one, two) >= similarity * F.greatest(one, two)) & ((F.least(one, two) < SMALL) | (shared / (one + two - shared) >= least))


def ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def with_mains(members: DataFrame) -> DataFrame:
    """members (node, band, key, root) with main, the group that most members of the bucket are in."""
    sizes = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    mains = sizes.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    return members.join(mains, "key").select("node", "band", "key", "root", "main")


def split_wide(members: DataFrame, most: int) -> DataFrame:
    """members (node, band, key, root, main), with the buckets that have over `most` members outside the main group replaced by what pairs of them share; these have band -1."""
    wide = materialize(members.filter(F.col("root") != F.col("main")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("key"), "wide-buckets")
    if wide.isEmpty():
        return members
    held = members.join(wide, "key").groupBy("node", "root").agg(F.array_sort(F.collect_set("key")).alias("keys"))  # PARTS at most
    both = held.select("node", "root", F.explode("keys").alias("one"), "keys").select("node", "root", "one", F.explode("keys").alias("two")).filter("one < two")
    narrow = materialize(both.select("node", F.lit(-1).alias("band"), F.xxhash64("one", "two").alias("key"), "root"), "narrow-buckets")
    return members.join(wide, "key", "left_anti").select("node", "band", "key", "root", "main").union(with_mains(narrow))


def pairs_across(members: DataFrame, nodes: DataFrame, least: float, similarity: float) -> DataFrame:
    """a, b: pairs of a bucket in different groups that may have the similarity (see likely).

    members: node, band, key, root, main (a group of the bucket); nodes: node, fp, n. Those outside the main group
    meet all members, in blocks of about BLOCK; a pair meets in the first bucket that it shares.
    """
    members = split_wide(members, MOST_OUTSIDE)
    few = members.filter(F.col("root") != F.col("main")).groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    held = materialize(members.join(few, "key"), "contested-members")
    keys = held.groupBy("node").agg(F.array(*(F.max(F.when(F.col("band") == i, F.col("key"))) for i in range(PARTS))).alias("keys"))  # null where the node's bucket isn't contested
    contested = materialize(held.join(keys.join(nodes.select("node", "fp", "n"), "node"), "node"), "contested")
    a = contested.filter(F.col("root") != F.col("main")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).alias("x")
    b = contested.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("y")
    once = (F.col("y.root") == F.col("y.main")) | (F.col("x.node") < F.col("y.node"))
    first = reduce(Column.__and__, ((F.col("x.band") <= i) | F.coalesce(F.col("x.keys")[i] != F.col("y.keys")[i], F.lit(True)) for i in range(PARTS)))
    met = (F.col("x.key") == F.col("y.key")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.root") != F.col("y.root")) & once & first
    return a.join(b, met & likely("x.", "y.", least, similarity)).select(*ordered("x.node", "y.node")).distinct()


def key_of(doc_id: str, h: str) -> tuple[Column, Column]:
    """What names a row: doc_id as text and the hash of its text."""
    return F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).alias("name"), F.col(h).alias("h")


def likely_pairs(pairs: DataFrame, nodes: DataFrame, least: float, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of nodes that may have the similarity (see likely)."""
    one, two = (nodes.select(F.col("node").alias(c), F.col("fp").alias(f"{c}fp"), F.col("n").alias(f"{c}n")) for c in "ab")
    both = pairs.join(one, "a").alias("x").join(two.alias("y"), (F.col("x.b") == F.col("y.b")) & likely("a", "b", least, similarity))
    return both.select("x.a", "x.b")


def similar_pairs(pairs: DataFrame, nodes: DataFrame, prints: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose whole shingle sets have the similarity."""
    asked = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "row_id"), "node"), "asked")
    held, _ = apart(prints.select("row_id", "shingles"), F.col("row_id"), asked, F.col("row_id"))
    known = materialize(held.join(asked, "row_id").select("node", "shingles"), "shingle-sets")
    both = pairs.join(known.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(known.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return materialize(both.filter(common >= similarity * (F.size("sa") + F.size("sb") - common)).select("a", "b"), "similar")


def near_duplicate_clusters(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """name, h (of each row: doc_id as text, XXH64 of text), keep (whether it is the first of its group).

    A text of no words has no shingles and is like no other: it stays.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames, 1 << 20):
            sets = [np.unique(shingle_hashes(t, shingle)) for t in texts_of(batch.column(3))]
            names = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "<i8").reshape(-1, 2)
            words = [least_words(s) if len(s) else None for s in sets]
            keys = [None if w is None else partition_keys(w) for w in words]
            wide = [wide_fingerprint(s) if len(s) else None for s in sets]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array([len(s) for s in sets], pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(wide, pa.list_(pa.int64())), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                [x.split()[0] for x in PRINTS.split(", ")],
            )

    prints = materialize(rows.mapInArrow(run, PRINTS), "prints")
    one = prints.filter("keys is not null").groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "h", "row_id")).alias("r"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("fp").alias("fp"), F.count(F.lit(1)).alias("rows"))
    nodes = materialize(one.select(F.monotonically_increasing_id().alias("node"), "d1", "d2", "r.*", "n", "keys", "fp", "rows"), "nodes")
    own = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    salts = [0, *(signed(xxhash.xxh64_intdigest(bytes([i]), SEED)) for i in range(1, SALTS))]
    firsts = own.groupBy("key").agg(*(F.min(F.col("node").bitwiseXOR(F.lit(x))).alias(f"low{i}") for i, x in enumerate(salts)), F.count(F.lit(1)).alias("size")).filter("size > 1")
    firsts = firsts.select("key", *(F.col(f"low{i}").bitwiseXOR(F.lit(x)).alias(f"first{i}") for i, x in enumerate(salts)))
    shared = materialize(own.join(firsts, "key"), "shared-buckets")
    nodes = materialize(nodes.drop("keys"), "narrow-nodes")
    links = pairs = None

    def members_now(order: int = 0) -> DataFrame:
        """node, band, key, root, first, main: the members of all buckets of two or more, by the groups that the links so far make; first: of the bucket, by this order."""
        held = shared.select("node", "band", "key", F.col(f"first{order}").alias("first"))
        if links is None:
            return held.withColumns({"root": F.col("node"), "main": F.col("first")})
        groups = materialize(components(links), "groups")  # of linked nodes only
        own_root, main = groups.select("node", "root"), groups.select(F.col("node").alias("first"), F.col("root").alias("main"))
        return held.join(own_root, "node", "left").join(main, "first", "left").select("node", "band", "key", "first", F.coalesce("root", "node").alias("root"), F.coalesce("main", "first").alias("main"))

    for bands, order in ((EARLY, 0), *((PARTS, i) for i in range(SALTS))):  # what a round joins needs no pairs in the next
        met = members_now(order).filter((F.col("root") != F.col("main")) & (F.col("band") < bands))
        new = met.select(*ordered("node", "first")).distinct()
        new = materialize(new if pairs is None else new.join(pairs, ["a", "b"], "left_anti"), "pairs")
        found = similar_pairs(materialize(likely_pairs(new, nodes, similarity - DOUBT, similarity), "likely-pairs"), nodes, prints, similarity)
        links, pairs = (found, new) if links is None else (links.union(found), pairs.union(new))
    for least in (similarity, similarity - DOUBT):  # the likely pairs before the doubtful, for the same reason
        members = materialize(with_mains(members_now().select("node", "band", "key", "root")), "members")
        across = materialize(pairs_across(members, nodes, least, similarity).join(pairs, ["a", "b"], "left_anti"), "pairs-across")
        links, pairs = links.union(similar_pairs(across, nodes, prints, similarity)), pairs.union(across)
    roots = components(links).withColumnRenamed("root", "group")
    placed = nodes.select("node", "d1", "d2", "doc_id", "h", "rows").join(roots, "node", "left").filter("rows > 1 or group is not null").withColumn("group", F.coalesce("group", "node"))
    placed = materialize(placed, "placed")
    first = placed.groupBy("group").agg(F.min(F.struct("doc_id", "h")).alias("first"))
    stays = materialize(placed.select("d1", "d2", "group").join(materialize(first, "firsts"), "group").select("d1", "d2", "first"), "stays")
    keep = F.col("first").isNull() | F.struct("doc_id", "h").eqNullSafe(F.col("first"))
    return prints.select("doc_id", "h", "d1", "d2").join(stays, ["d1", "d2"], "left").select(*key_of("doc_id", "h"), keep.alias("keep"))


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first document of each group (smallest doc_id), with all columns; rows that repeat doc_id and text stay or go together."""
    with scratch(docs.sparkSession) as keep:
        clusters = near_duplicate_clusters(docs, similarity, id_col=id_col, text_col=text_col)
        gone = keep(clusters.filter(~F.col("keep")).select(F.col("name").alias("__name"), F.col("h").alias("__h")).distinct(), "near-copies")
    return without(docs, gone, id_col, text_col)


def drop_near_copies(docs: DataFrame, tau: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first document (smallest doc_id) of each group that near_duplicates' links make, with all columns; rows that repeat doc_id and text stay or go together.

    A text without words is like no other here: it stays.
    """
    with scratch(docs.sparkSession) as keep:
        text = F.coalesce(F.col(text_col), F.lit(""))
        worded = docs.filter(text.rlike(r"[^\x20\x09-\x0D]"))
        prints = materialize(fingerprints(worded, shingle, id_col, text_col, {"h": F.xxhash64(text)}), "fingerprints")
        nodes = materialize(prints.groupBy("fp").agg(F.min(F.struct("doc_id", "h")).alias("first"), F.count(F.lit(1)).alias("rows")), "nodes")
        roots = components(links_of(nodes.select("fp"), tau)).withColumnRenamed("node", "fp")
        placed = materialize(nodes.join(roots, "fp", "left").filter("rows > 1 or root is not null").select("fp", "first", F.coalesce("root", "fp").alias("root")), "placed")
        firsts = placed.groupBy("root").agg(F.min("first").alias("stays"))
        named = materialize(placed.join(materialize(firsts, "firsts"), "root").select("fp", "stays"), "named")
        met, _ = apart(prints, F.col("fp"), named, F.col("fp"))
        clusters = met.join(named, "fp").filter(~F.struct("doc_id", "h").eqNullSafe(F.col("stays")))
        gone = keep(clusters.select(*(c.alias(f"__{n}") for n, c in zip(("name", "h"), key_of("doc_id", "h"), strict=True))).distinct(), "near-copies")
    return without(docs, gone, id_col, text_col)


def without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The documents but those that `gone` (__name, __h) names."""
    marked = docs.select(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("null")).alias("__name"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("__h"), F.struct(*docs.columns).alias("row"))
    return without_keys(marked, ["__name", "__h"], gone).select("row.*")  # a struct, so that no column's name can clash
