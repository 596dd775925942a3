"""Documents whose sets of word n-grams have a Jaccard similarity of a threshold or more: a grouped prefix join.

Shingles are ordered by how often the corpus holds them, the rarest first, ties by hash:
as often as their words' frequencies let them meet by chance, or as their counter tells
where it is far above the others, or as they were counted among all prefixes of such an
order. So prefixes hold what hardly any document shares but its near copies, at any size
of the corpus. Any one order finds the same links. Two sets of the threshold share a
shingle of both prefixes (the first n - ceil(t * n) + 1).
Shingles that only one prefix holds are left out; documents of equal size and equal
remaining prefix are one group, and groups with a common prefix shingle meet in its bucket.

1. Equal sets are one node. Of the least nodes of its first shingles' buckets each node is
   verified with the likeliest, on full sets. What is linked becomes a component.
2. Nodes are collapsed to groups. In buckets that still hold several components, group
   pairs of compatible size, prefix places and prefix bits join their components to
   families. What isn't joined can't link.
3. In families of several components the groups are expanded, and members of different
   components are compared by sketches of their whole sets, in blocks of bounded size.
   Of the pairs that these allow a forest is verified on full sets, round by round, until
   none is left between different components that wasn't verified.

Links inside a component are never needed again, so no step gives more rows than it
has members, and every pair is verified, in one component already, or excluded by a bound.
"""

from __future__ import annotations

import copy
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import connected_components, materialise, passing_tables, prepare, slices, utf8
from tracewell.llm.neardup import distinct_sets, restrict, shingle_hashes, shingle_sets

#: Counters of the corpus's shingles and of its words, powers of two: each task's array of them, and what comes to the driver, is of this size.
COUNTERS, WORDS = 1 << 18, 1 << 16
#: Steps of a logarithm to base 2; levels for each power of two, and the power of level 0: what is expected less often is as good as unique.
STEPS, LEVELS, RARE = 16, 2, -16
#: Documents that a shingle is common in, if so many prefixes hold it; slots of the levels of these, a power of two; what is counted, in lengths of a prefix.
COMMON, SLOTS, COUNTED = 9, 1 << 22, 1.25
#: Nodes up to which a table of them is broadcast (32 bytes each); beyond, the join shuffles.
BROADCAST_NODES = 500_000
#: Shared shingles of a prefix, the rarest, whose buckets give a node its first partner.
FIRST = 16
#: Bits of a prefix; groups of a bucket, and shingles of a family's members, that one block holds; pairs compared at once.
BITS, GROUPS, SHINGLES, PAIRS = 128, 4096, 1 << 22, 1 << 18
#: Bits of a sketch for each shingle of a set, at least; rounds after which all pairs that the sketches allow are verified at once.
SKETCHED, ROUNDS = 8, 3


def corpus_counts(plain: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """How many documents hold the shingles of each counter, and how often the words of each occur: an order of shingles needs no exact counts, only one and the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS + WORDS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                words, *rest = shingle_hashes(*utf8(part.column(0)), k)
                total[:COUNTERS] += np.bincount(np.concatenate(distinct_sets(words, *rest, k)) & np.uint64(COUNTERS - 1), minlength=COUNTERS) if part.num_rows else 0
                total[COUNTERS:] += np.bincount(words & np.uint64(WORDS - 1), minlength=WORDS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], names=["counter", "n"])

    found = plain.select("text").mapInArrow(run, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNTERS + WORDS, np.int64)
    counts[found.column("counter").to_numpy()] = found.column("n").to_numpy()
    return counts[:COUNTERS], counts[COUNTERS:]


def logarithm(n: np.ndarray | int) -> np.ndarray:
    return np.round(STEPS * np.log2(n)).astype(np.int32)


class Order:
    """The corpus's order of shingles, by seven bits of how often they are expected and 56 of their hash; whole numbers, so that it is one and the same on all machines."""

    def __init__(self, shingles: np.ndarray, words: np.ndarray, k: int):
        self.k = k
        total = max(1, int(words.sum()))
        # a shingle is expected as often as there are words, times the share of each of its own
        self.share, self.total = logarithm(np.maximum(1, words)) - logarithm(total), logarithm(total)
        # what a counter holds beyond twice the usual is one shingle's, such as a line that many documents have
        self.beyond = logarithm(np.maximum(1, shingles - 2 * np.median(shingles)))
        self.beyond[self.beyond == 0] = STEPS * RARE
        self.common = np.zeros(SLOTS, np.uint8)

    def level(self, expected: np.ndarray) -> np.ndarray:
        return np.clip((expected - STEPS * RARE) * LEVELS // STEPS, 0, 127).astype(np.uint8)

    def tokens(self, words: np.ndarray, joint: np.ndarray) -> np.ndarray:
        """Each shingle's place in the order, from what shingle_hashes() gives."""
        share = self.share[words & np.uint64(len(self.share) - 1)]
        expected = self.total + sum(share[j : j + len(joint)] for j in range(self.k))
        expected = np.maximum(expected, self.beyond[joint & np.uint64(len(self.beyond) - 1)])
        low = joint >> np.uint64(8)
        level = np.maximum(self.level(expected), self.common[low & np.uint64(len(self.common) - 1)]).astype(np.uint64)
        return (level << np.uint64(56) | low).view(np.int64)

    def with_common(self, plain: DataFrame, percent: int) -> Order:
        """This order after what many prefixes hold has gone behind, by how many hold it."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    words, edge, joint = shingle_hashes(*utf8(part.column(0)), self.k)
                    tokens = self.tokens(words, joint)
                    sets = (np.unique(tokens[a : b - self.k + 1]) for a, b in zip(edge, edge[1:], strict=False) if b - a >= self.k)
                    first = [s[: int(COUNTED * (len(s) - beyond_prefix(len(s), percent)))] for s in sets]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*first, np.zeros(0, np.int64)]))], names=["token"])

        counts = plain.select("text").mapInArrow(run, "token long").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
        found = counts.groupBy(F.col("token").bitwiseAND(SLOTS - 1).cast("int").alias("slot")).agg(F.max("n").alias("n")).toArrow()
        made = copy.copy(self)
        made.common = np.zeros(SLOTS, np.uint8)
        made.common[found.column("slot").to_numpy()] = self.level(logarithm(found.column("n").to_numpy()))
        return made


def least_overlap(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Least intersection of sets of n and m elements with 100 * intersection >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


def beyond_prefix(n, percent: int):
    """Elements of a set of n behind its prefix."""
    return -(-percent * n // 100) - 1


def least_shared(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Least number of shingles that both prefixes must share: what the set that ends first in the order holds beyond its prefix is all else that can be common."""
    return np.maximum(1, least_overlap(n, m, percent) - np.maximum(beyond_prefix(n, percent), beyond_prefix(m, percent)))


def sized(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return np.minimum(n, m) * 100 >= np.maximum(n, m) * percent


def prefixes(plain: DataFrame, k: int, percent: int) -> DataFrame:
    """(id, n, digest, prefix) of docs (id, text): prefix holds 8 bytes for each shingle; empty sets and those that only an equal set can be linked with have none."""
    order = Order(*corpus_counts(plain, k), k).with_common(plain, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words, edge, joint = shingle_hashes(*utf8(part.column(1)), k)
                sets, tokens = distinct_sets(words, edge, joint, k), order.tokens(words, joint)
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                first = [np.unique(tokens[a : b - k + 1])[: len(s) - beyond_prefix(len(s), percent)].tobytes() if len(s) * (100 - percent) >= percent else None for s, a, b in zip(sets, edge, edge[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(first, pa.binary())], names=["id", "n", "digest", "prefix"])

    return plain.mapInArrow(run, "id long, n long, digest binary, prefix binary")


def prefix_rows(nodes: DataFrame) -> DataFrame:
    """(token, node): a row for each shingle of each node's prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(data[at[0] : at[-1]].view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), np.diff(at) // 8))], names=["token", "node"])

    return nodes.where("prefix is not null").select("node", "prefix").mapInArrow(run, "token long, node long")


def described(kept: DataFrame) -> DataFrame:
    """(node, n, tokens, same, bits): same is equal for equal n and tokens; bits are those that the tokens set out of BITS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, lists = batch.column(1).to_numpy(), batch.column(2)
            flat, at = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            marks = np.zeros((len(n), BITS), np.uint8)
            marks[np.repeat(np.arange(len(n)), np.diff(at)), flat % BITS] = 1
            same = [hashlib.blake2b(n[i].tobytes() + flat[at[i] : at[i + 1]].tobytes(), digest_size=16).digest() for i in range(len(n))]
            bits = [row.tobytes() for row in np.packbits(marks, axis=1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(same, pa.binary()), pa.array(bits, pa.binary())], names=["node", "n", "tokens", "same", "bits"])

    return kept.mapInArrow(run, "node long, n long, tokens array<long>, same binary, bits binary")


def bit_rows(column: pa.Array) -> np.ndarray:
    data, at = utf8(column)
    return data[at[0] : at[-1]].view(np.uint64).reshape(len(column), -1) if len(column) else np.zeros((0, BITS // 64), np.uint64)


def may_link(n: tuple, k: tuple, bits: tuple, percent: int, bound: np.ndarray) -> np.ndarray:
    """Which pairs of groups may hold links, by their sizes n, prefix lengths k and prefix bits; bound is what their places in a bucket allow them to share."""
    need = least_shared(*n, percent)
    out = sized(*n, percent) & (bound >= need)
    some = np.flatnonzero(out)
    x, y = bits[0][some], bits[1][some]
    missing = (np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64) for a, b in ((x, y), (y, x)))
    shared = np.minimum(*(k[s][some] - m for s, m in zip((0, 1), missing, strict=True)))
    out[some] = shared >= need[some]
    return out


def first_pairs(shared: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b): of each node b that pivot a of its first buckets (token, node, pivot) which it meets most often and which is of like size."""
    first = shared.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("token"))).where(F.col("rank") <= FIRST)
    pairs = first.where(F.col("node") != F.col("pivot")).groupBy(F.col("pivot").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("common"))
    one, two = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}")) for x in "ab")
    near = pairs.join(two, "b").join(one, "a").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    best = near.groupBy("b").agg(F.max(F.struct("common", (-F.col("a")).alias("first"))).alias("m"))
    return best.select((-F.col("m.first")).alias("a"), "b")


def sketch(found: np.ndarray) -> bytes:
    """Bits that a set's shingles set, a power of two of them, most of them 0 and so compressed: in two sketches each bit that one alone sets is a shingle that the other set lacks."""
    width = 1 << max(6, int(np.ceil(np.log2(max(1, SKETCHED * len(found))))))
    marks = np.zeros(width, np.uint8)
    marks[(found >> np.uint64(8)) & np.uint64(width - 1)] = 1
    return zlib.compress(np.packbits(marks, bitorder="little").tobytes(), 1)


def unpacked(column: pa.Array) -> list[np.ndarray]:
    """The sketches of a column as bytes."""
    return [np.frombuffer(zlib.decompress(x.as_buffer()), np.uint8) for x in (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)]


def sets_of(nodes: DataFrame, wanted: DataFrame, plain: DataFrame, k: int, sketched: bool = False) -> DataFrame:
    """(node, found binary): the full sets of the wanted nodes, 8 bytes for each shingle, or their sketches."""
    some = materialise(nodes.join(wanted.select("node").distinct(), "node", "left_semi").select("node", "id", "digest"), "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(*utf8(part.column(1)), k)
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digest, pa.binary()), pa.array([sketch(s) if sketched else s.tobytes() for s in sets], pa.binary())], names=["id", "digest", "found"])

    number = some.count()
    small = F.broadcast(some) if number <= BROADCAST_NODES else some
    found = restrict(plain, some.select("id").distinct()).mapInArrow(run, "id long, digest binary, found binary")
    made = materialise(found.join(small, ["id", "digest"]).select("node", "found"), "sets")
    return made if made.count() == number else made.dropDuplicates(["node"])  # repeated rows


def numbers(column: pa.Array) -> list[np.ndarray]:
    data, at = utf8(column)
    return [data[a:b].view(np.uint64) for a, b in zip(at, at[1:], strict=False)]


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked by their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(numbers(batch.column(2)), numbers(batch.column(3)), strict=True):
                both = np.sort(np.concatenate([x, y]))
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one, two = (sets.select(F.col("node").alias(x), F.col("found").alias(f"f{x}")) for x in "ab")
    return materialise(pairs.join(one, "a").join(two, "b").select("a", "b", "fa", "fb").mapInArrow(run, "a long, b long").distinct(), "links")


def allowed(pairs: DataFrame, nodes: DataFrame, plain: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) that may be linked by their sketches."""
    sketches = sets_of(nodes, pairs.select(F.explode(F.array("a", "b")).alias("node")), plain, k, sketched=True).join(nodes.select("node", "n"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            n = np.concatenate([batch.column(c).to_numpy() for c in ("na", "nb")])
            found = [s for c in ("fa", "fb") for s in unpacked(batch.column(c))]
            x = np.arange(rows)
            good = overlap_bounds(x, x + rows, n, found) >= least_overlap(n[:rows], n[rows:], percent)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    one, two = (sketches.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("found").alias(f"f{x}")) for x in "ab")
    return materialise(pairs.join(two, "b").join(one, "a").select("a", "b", "na", "nb", "fa", "fb").mapInArrow(run, "a long, b long"), "allowed")


def dealt(rows: DataFrame, room: int) -> DataFrame:
    """rows (key, part, row, weight, ...) and (g, i, j, own): two rows of a key but of different parts meet in one group (g, i, j).

    Keys of a weight of up to `room` are dealt into bins by hash, the others into blocks by
    the hash of `row`. The heaviest part's blocks meet those of the other parts only, and
    a group weighs about twice `room` at most. Keys of one part are left out.
    """
    parts = rows.groupBy("key", "part").agg(F.sum("weight").alias("w"))
    keys = parts.groupBy("key").agg(F.max(F.struct("w", "part")).alias("most"), F.sum("w").alias("whole"), F.count("*").alias("parts")).where("parts > 1")
    keys = materialise(keys.select("key", F.col("most.part").alias("main"), "whole", (F.col("whole") - F.col("most.w")).alias("others")), "keys")
    bins = max(1, -(-(keys.agg(F.sum("whole")).first()[0] or 0) // room))
    full = rows.join(keys, "key")
    names, other = [*rows.columns, "g", "i", "j", "own"], F.col("part") != F.col("main")
    at = lambda i, j, own, g: (g.alias("g"), i.alias("i"), j.alias("j"), own.alias("own"))
    none = F.lit(-1)
    small = full.where(F.col("whole") <= room).select(*rows.columns, *at(none, none, none, F.pmod(F.xxhash64("key"), F.lit(bins))))
    first, last = (F.ceil(c / room).cast("int") for c in (F.col("others"), F.col("whole") - F.col("others")))
    large = full.where(F.col("whole") > room).withColumn("own", F.when(other, F.pmod(F.xxhash64("row"), first)).otherwise(first + F.pmod(F.xxhash64("row"), last)).cast("int"))
    large = large.withColumn("met", F.explode(F.sequence(F.lit(0), F.when(other, first + last).otherwise(first) - 1)))
    large = large.select(*rows.columns, *at(F.least("own", "met"), F.greatest("own", "met"), F.col("own"), F.xxhash64("key")))
    return small.unionByName(large).select(names)


def meetings(key: np.ndarray, own: np.ndarray, i: int, j: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one key and of blocks i and j, each once, about PAIRS at a time."""
    order = np.lexsort((own, key))
    edges = np.concatenate([[0], np.flatnonzero(np.diff(key[order])) + 1, [len(order)]])
    left, until = [], []
    for a, b in zip(edges, edges[1:], strict=False) if i != j else ():
        middle = a + int(np.searchsorted(own[order[a:b]], j))
        left += range(a, middle)
        until += [(middle, b)] * (middle - a)
    if i == j:
        ends = np.repeat(edges[1:], np.diff(edges))
        left, low, high = np.arange(len(order)), np.arange(1, len(order) + 1), ends
    else:
        left = np.array(left, np.int64)
        low, high = (np.array([u[s] for u in until], np.int64) for s in (0, 1))
    size = high - low
    done = np.concatenate([[0], np.cumsum(size)])
    start = 0
    while start < len(left):
        end = max(start + 1, int(np.searchsorted(done, done[start] + PAIRS, "right")) - 1)
        s = size[start:end]
        x = np.repeat(left[start:end], s)
        y = np.repeat(low[start:end] - (done[start:end] - done[start]), s) + np.arange(int(s.sum()))
        yield order[x], order[y]
        start = end


class Labels:
    """Parts of a task's rows, joined as links are found; joins holds what was joined."""

    def __init__(self, parts: np.ndarray):
        self.names, self.at = np.unique(parts, return_inverse=True)
        self.top = np.arange(len(self.names))
        self.joins: list[tuple[int, int]] = []

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return self.top[self.at[x]] != self.top[self.at[y]]

    def join(self, x: int, y: int) -> bool:
        """Whether the parts of rows x and y were apart until now."""
        p, q = self.top[self.at[x]], self.top[self.at[y]]
        if p != q:
            self.top[self.top == max(p, q)] = min(p, q)
            self.joins.append((int(self.names[self.at[x]]), int(self.names[self.at[y]])))
        return p != q


def pairs_table(rows: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([r[0] for r in rows], pa.int64()), "b": pa.array([r[1] for r in rows], pa.int64())})


def family_joins(units: DataFrame, percent: int) -> DataFrame:
    """(a, b): joins of components, from units (key, part, row, weight, place, k, n, bits, size) of buckets of `size` rows; a task gives fewer than it has components."""

    def run(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        key, own, part, place, k, n = (table.column(c).to_numpy() for c in ("key", "own", "part", "place", "k", "n"))
        bits, labels = bit_rows(table.column("bits")), Labels(part)
        for x, y in meetings(key, own, i, j):
            some = labels.apart(x, y)
            x, y = x[some], y[some]
            good = may_link((n[x], n[y]), (k[x], k[y]), (bits[x], bits[y]), percent, np.minimum(k[x] - place[x], k[y] - place[y]))
            x, y = x[good], y[good]
            while len(x):
                labels.join(x[0], y[0])
                some = labels.apart(x, y)
                x, y = x[some], y[some]
        return pairs_table(labels.joins)

    bins, none = max(1, -(-units.count() // GROUPS)), F.lit(-1)
    small = units.where(F.col("size") <= GROUPS).withColumns({"g": F.pmod(F.xxhash64("key"), F.lit(bins)), "i": none, "j": none, "own": none})
    large = units.where(F.col("size") > GROUPS)
    rows = small if large.isEmpty() else small.unionByName(dealt(large, GROUPS))
    return materialise(rows.groupBy("g", "i", "j").applyInArrow(run, "a long, b long").distinct(), "joins")


def overlap_bounds(x: np.ndarray, y: np.ndarray, n: np.ndarray, sketches: list[np.ndarray]) -> np.ndarray:
    """For each pair of rows the most shingles that both can hold; the wider sketch of a pair is folded to the other's width."""
    out = np.empty(len(x), np.int64)
    width = np.array([len(s) for s in sketches])
    target = np.minimum(width[x], width[y])
    for w in np.unique(target).tolist():
        some = np.flatnonzero(target == w)
        used = np.unique(np.concatenate([x[some], y[some]]))
        folded = np.stack([np.bitwise_or.reduce(sketches[r].reshape(-1, w), axis=0) for r in used]).view(np.uint64)
        step = max(1, (1 << 23) // w)
        for k in range(0, len(some), step):
            part = some[k : k + step]
            a, b = folded[np.searchsorted(used, x[part])], folded[np.searchsorted(used, y[part])]
            out[part] = np.minimum(n[x[part]] - np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64), n[y[part]] - np.bitwise_count(b & ~a).sum(axis=1, dtype=np.int64))
    return out


def likely_pairs(members: DataFrame, percent: int, every: bool) -> DataFrame:
    """(a, b): rows of different components that may be linked, from members (key, part, row, weight, found, failed) of families.

    found are sketches, failed the greater rows that a row was verified with in vain. Unless
    `every` pair is wanted a task gives a forest of its components, the likeliest pairs first.
    """

    def run(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        key, own, part, n, row = (table.column(c).to_numpy() for c in ("key", "own", "part", "weight", "row"))
        sketches = unpacked(table.column("found"))
        failed = {(r, f) for r, fs in zip(row.tolist(), table.column("failed").to_pylist(), strict=True) for f in fs or ()}  # a < b
        labels, out = Labels(part), []
        for x, y in meetings(key, own, i, j):
            some = labels.apart(x, y) & sized(n[x], n[y], percent)
            x, y = x[some], y[some]
            spare = overlap_bounds(x, y, n, sketches) - least_overlap(n[x], n[y], percent)
            good = np.flatnonzero(spare >= 0)
            for r in good[np.argsort(-spare[good], kind="stable")]:
                pair = tuple(sorted((int(row[x[r]]), int(row[y[r]]))))
                if pair not in failed and (labels.join(x[r], y[r]) or every):
                    out.append(pair)
        return pairs_table(out)

    return materialise(dealt(members, SHINGLES).groupBy("g", "i", "j").applyInArrow(run, "a long, b long").distinct(), "likely")


def joined_by_members(parts: DataFrame, members: DataFrame, nodes: DataFrame, plain: DataFrame, k: int, percent: int) -> DataFrame:
    """parts after joining components by all links between members (key, node, n) of one family."""
    members = materialise(members.join(sets_of(nodes, members.select("node"), plain, k, sketched=True), "node"), "members")
    failed = None
    for number in range(ROUNDS + 1):
        rows = with_component(members, parts).select("key", F.col("component").alias("part"), F.col("node").alias("row"), F.col("n").alias("weight"), "found")
        if failed is None:
            rows = rows.withColumn("failed", F.lit(None).cast("array<bigint>"))
        else:
            rows = rows.join(failed.groupBy(F.col("a").alias("row")).agg(F.collect_list("b").alias("failed")), "row", "left")
        pairs = likely_pairs(rows, percent, every=number == ROUNDS)
        if pairs.isEmpty():
            return parts
        links = verified(pairs, sets_of(nodes, pairs.select(F.explode(F.array("a", "b")).alias("node")), plain, k), percent)
        top = lambda x: parts.select(F.col("node").alias(x), F.col("component").alias(f"p{x}"))
        between = links.join(top("a"), "a", "left").join(top("b"), "b", "left")
        parts = joined(parts, between.select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b")))
        vain = materialise(pairs.join(links, ["a", "b"], "left_anti"), "vain")
        if vain.isEmpty():  # what was left out hung on pairs that are all linked
            return parts
        failed = materialise(vain if failed is None else failed.unionByName(vain), "failed")
        # a family goes on where a pair of it failed; the others have no pair left
        again = members.select("key", F.col("node").alias("a")).join(vain, "a").select("key").distinct()
        members = materialise(members.join(again, "key", "left_semi"), "members")
    return parts


def with_component(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """nodes and their component in parts (node, component), themselves where they have none."""
    return nodes.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))


def joined(parts: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after joining components by links (a, b) between them; components without links are left as they were."""
    more = connected_components(links).select(F.col("node").alias("component"), F.col("component").alias("higher"))
    alone = more.select(F.col("component").alias("node"), F.col("component"))
    known = parts.unionByName(alone.join(parts.select("node"), "node", "left_anti"))
    return materialise(known.join(more, "component", "left").select("node", F.coalesce("higher", "component").alias("component")), "parts")


def linked_components(nodes: DataFrame, plain: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, component) of the nodes (node, id, digest, n, prefix) that are linked with others, component being any node of theirs."""
    bucket = Window.partitionBy("token")
    shared = prefix_rows(nodes).withColumns({"size": F.count("*").over(bucket), "pivot": F.min("node").over(bucket)})
    shared = materialise(shared.where("size > 1").drop("size"), "shared")
    pairs = allowed(materialise(first_pairs(shared, nodes, percent), "pairs"), nodes, plain, k, percent)
    links = verified(pairs, sets_of(nodes, pairs.select(F.explode(F.array("a", "b")).alias("node")), plain, k), percent)
    parts = materialise(connected_components(links), "parts")
    kept = shared.groupBy("node").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    kept = with_component(described(kept.join(nodes.select("node", "n"), "node").select("node", "n", "tokens")), parts)
    kept = materialise(kept, "kept")
    # a group's members of one component are one unit; all that is compared is alike within a group
    units = kept.groupBy("same", F.col("component").alias("part")).agg(*(F.first(c).alias(c) for c in ("n", "tokens", "bits")))
    units = units.select("part", "n", "bits", F.size("tokens").cast("long").alias("k"), F.xxhash64("same", "part").alias("row"), F.posexplode("tokens").alias("place", "key"))
    key = Window.partitionBy("key")
    units = units.withColumns({"low": F.min("part").over(key), "high": F.max("part").over(key), "size": F.count("*").over(key)}).where("low <> high")
    units = materialise(units.select("key", "part", "row", F.lit(1).cast("long").alias("weight"), F.col("place").cast("long").alias("place"), "k", "n", "bits", "size"), "units")
    families = connected_components(family_joins(units, percent)).select(F.col("node").alias("part"), F.col("component").alias("key"))
    some = kept.select("node", "n", F.col("component").alias("part")).join(families, "part").select("key", "node", "n")
    return joined_by_members(parts, materialise(some, "open"), nodes, plain, k, percent)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, percent: int = 90) -> DataFrame:
    """(id, n_shingles long, component_id long) of every document.

    Words are separated by white space (20, 09 to 0D), A-Z lower-cased. Documents are
    linked where 100 * intersection >= percent * union of their sets of `shingle`-word
    shingles; component_id is the least id that links reach. Texts of fewer words are one
    shingle; null, empty and blank texts have none and are linked with nothing. Repeated
    rows give repeated rows, an empty table none; an id with several texts belongs to
    each text's component. A null id has no component and links nothing. Ids are
    integers; other columns are ignored. Shingles are compared by 64-bit hashes, set
    equality by 128 bits; beyond these, no link is missed.
    """
    with passing_tables(prepare(docs.sparkSession)):
        plain = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
        known = materialise(prefixes(plain, shingle, percent), "prefixes")
        whole = known.where("digest is not null and id is not null")
        nodes = whole.groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
        nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
        parts = linked_components(nodes.where("prefix is not null"), plain, shingle, percent)
        placed = with_component(nodes.select("node", "id", "digest"), parts)
        least = placed.groupBy("component").agg(F.min("id").alias("found"))
        found = placed.join(least, "component").select("digest", "found")
        out = known.select("id", "n", "digest").join(found, "digest", "left")
        component = F.when(F.col("id").isNotNull(), F.coalesce("found", "id"))
        return materialise(out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id")), "jaccard", outside=True)
