"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact sets.

Documents with equal shingle sets form one class and are represented by their least
id. Representatives that share a band of their signatures are candidates. A candidate
pair's signatures are compared batch by batch; it is dropped as soon as the posterior
probability that its similarity reaches the threshold falls below MISS. Pairs that
survive all batches are verified on their full sets.

First each document is compared with the least id of each of its buckets, and the
likeliest of these pairs is verified; what is linked becomes one component. Pairs that
are similar at all, linked or not, make families, so a hot bucket of one family costs no
more than its members. Members of a bucket that are of different families are compared
by their signatures in blocks of bounded size, and plausible pairs join their families.
Then members of one family in different components are compared, in blocks that give no
more links than they have members. So every pair that shares a band is compared,
already joined, or implausible.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import connected_components, forest_roots, free_name, materialise, passing_tables, prepare, slices, utf8

BANDS, ROWS, BATCH, MISS = 32, 5, 32, 1e-6
HASHES = BANDS * ROWS
#: Similarity of signatures from which documents of a bucket are of one family; members of a block.
FAMILY, BLOCK = 0.5, 512
#: Ids up to which a table of them is broadcast (16 bytes each); beyond, the join shuffles.
BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(20_240_601)
LETTER = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE, INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
PLACE = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TIMES, FLIP = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) for _ in range(2))
TIMES |= np.uint32(1)
BAND_TIMES = _rng.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BAND_SEED = _rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)
GAP = np.zeros(256, bool)
GAP[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """x with all its bits mixed, as 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0 to n at least; kept for slices of usual size."""
    if len(_powers.get("up", ())) <= n:
        size = max(n + 1, 1 << 17)
        made = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, b, np.uint64))]) for b in (BASE, INVERSE)]
        if size > 1 << 21:
            return made[0], made[1]
        _powers["up"], _powers["down"] = made
    return _powers["up"], _powers["down"]


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, its document) of texts that lie one after the other; words end at white space and at a text's end."""
    at = at - at[0] if len(at) else at
    word = ~GAP[data]
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    begins = word & (first[:-1] | ~np.append(False, word[:-1]))
    ends = word & (first[1:] | ~np.append(word[1:], False))
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = powers(len(data))
    total = np.append(np.uint64(0), np.cumsum(LETTER[LOWER[data]] * up[: len(data)]))
    return mixed((total[end] - total[start]) * down[start]), np.searchsorted(at, start, "right") - 1


def shingle_hashes(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every word, edges of the texts' words, hash of every k words in a row) of texts; those that reach over a text's end are no shingles."""
    data = data[at[0] : at[-1]]
    words, owner = word_hashes(data, at)
    edge = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(at) - 1))])
    m = max(0, len(words) - k + 1)
    joint = words[:m] * PLACE[0]
    for j in range(1, k):
        joint = joint + words[j : j + m] * PLACE[j]
    return words, edge, mixed(joint)


def distinct_sets(words: np.ndarray, edge: np.ndarray, joint: np.ndarray, k: int) -> list[np.ndarray]:
    """The sets of shingle_sets() from what shingle_hashes() gives."""
    out = []
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(joint[a : b - k + 1]))
        elif b > a:
            out.append(mixed(np.array([(words[a:b] * PLACE[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's k-word shingles; fewer words make one shingle, none an empty set."""
    return distinct_sets(*shingle_hashes(data, at, k), k)


def signature(found: np.ndarray) -> np.ndarray:
    """HASHES minima of a set, 16 bits of each."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    short = (found >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(short), 1024):
        np.minimum(low, ((short[k : k + 1024, None] ^ FLIP) * TIMES).min(axis=0), out=low)
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """(documents, BANDS) 64-bit keys."""
    rows = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64)
    return mixed((rows * BAND_TIMES).sum(axis=2, dtype=np.uint64) + BAND_SEED).view(np.int64)


def least_matches(share: float) -> np.ndarray:
    """For each number of compared hashes, the matches below which similarity >= share is less likely than MISS (uniform prior)."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    need = np.zeros(HASHES + 1, np.int64)
    for n in range(BATCH, HASHES + 1, BATCH):
        m = np.arange(n + 1)[:, None]
        log = m * np.log(grid) + (n - m) * np.log1p(-grid)
        mass = np.exp(log - log.max(axis=1, keepdims=True))
        need[n] = np.argmax(mass[:, grid >= share].sum(axis=1) / mass.sum(axis=1) >= MISS)
    return need


def plausible(a: np.ndarray, b: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Which pairs of signatures survive every batch; a pair that is dropped isn't compared further."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    for n in range(0, HASHES, BATCH):
        matches[alive] += (a[alive, n : n + BATCH] == b[alive, n : n + BATCH]).sum(axis=1)
        alive = alive[matches[alive] >= need[n + BATCH]]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def matrix(column: pa.Array) -> np.ndarray:
    data, at = utf8(column)
    return data[at[0] : at[-1]].view(np.uint16).reshape(-1, HASHES) if len(at) > 1 else np.zeros((0, HASHES), np.uint16)


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """(id, n, digest, signature) of docs (id, text); digest and signature are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(*utf8(part.column(1)), k)
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                sign = [signature(s).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(sign, pa.binary())], names=["id", "n", "digest", "signature"])

    return docs.mapInArrow(run, "id long, n long, digest binary, signature binary")


def bucket_rows(reps: DataFrame) -> DataFrame:
    """(key, id): BANDS rows for each representative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = band_keys(matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS))], names=["key", "id"])

    return reps.select("id", "signature").mapInArrow(run, "key long, id long")


def compared(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """(a, b, matches, likely) of the pairs that may be of one family, similar by FAMILY or more.

    likely tells whether the sizes allow the similarity and every batch leaves it plausible.
    """
    need, family = least_matches(percent / 100), least_matches(FAMILY)
    one, two = (reps.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("signature").alias(f"s{x}")) for x in "ab")
    sizes = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).alias("fits")
    rows = pairs.join(one, "a").join(two, "b").select("a", "b", sizes, "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = matrix(batch.column(3)), matrix(batch.column(4))
            near = plausible(x, y, family)
            kept, x, y = batch.filter(pa.array(near)), x[near], y[near]
            likely = plausible(x, y, need) & kept.column(2).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array((x == y).sum(axis=1, dtype=np.int32)), pa.array(likely)], names=["a", "b", "matches", "likely"])

    return rows.mapInArrow(run, "a long, b long, matches int, likely boolean")


def restrict(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """docs (id, ...) with or without the ids; these are broadcast while they are few, else the join shuffles."""
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "id", how)


def packed_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, found binary): six bytes of each hash of the sets of the documents (id, text) with these ids."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [np.unique(s & np.uint64((1 << 48) - 1)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for s in shingle_sets(*utf8(part.column(1)), k)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], names=["id", "found"])

    return materialise(restrict(docs, ids).mapInArrow(sets, "id long, found binary"), "sets")


def numbers(column: pa.Array) -> list[np.ndarray]:
    """The sets of packed_sets() as sorted 64-bit numbers."""
    data, at = utf8(column)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        wide = np.zeros(((b - a) // 6, 8), np.uint8)
        wide[:, :6] = data[a:b].reshape(-1, 6)
        out.append(wide.view(np.uint64).ravel())
    return out


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on full sets."""
    ids = materialise(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    known = packed_sets(docs, ids, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(numbers(batch.column(2)), numbers(batch.column(3)), strict=True):
                both = np.sort(np.concatenate([x, y]))
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one, two = (known.select(F.col("id").alias(x), F.col("found").alias(f"f{x}")) for x in "ab")
    rows = pairs.join(two, "b").join(one, "a").select("a", "b", "fa", "fb")
    return materialise(rows.mapInArrow(run, "a long, b long").distinct(), "links")


def root(parent: dict[int, int], x: int) -> int:
    while parent.get(x, x) != x:
        parent[x] = parent.get(parent[x], parent[x])
        x = parent[x]
    return x


def bucket_families(shared: DataFrame, families: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """(id, family): families (id, family), joined wherever a pair of a bucket is plausible; shared has (key, id) of all buckets but their pivots.

    In a bucket the members of the commonest family needn't be compared with each other,
    only the others with all. The others' blocks come first and meet every block; the
    blocks of the commonest family meet those of the others only. Small buckets are dealt
    into bins by hash. A task gives fewer joins of families than it has members.
    """
    need = least_matches(percent / 100)
    own = F.coalesce("family", "id")
    held = materialise(shared.join(families, "id", "left").select("key", "id", own.alias("family")), "buckets")
    counts = held.groupBy("key", "family").agg(F.count("*").alias("n"))
    buckets = counts.groupBy("key").agg(F.max(F.struct("n", "family")).alias("most"), F.sum("n").alias("size"), F.count("*").alias("families")).where("families > 1")
    buckets = materialise(buckets.select("key", F.col("most.family").alias("main"), "size", (F.col("size") - F.col("most.n")).alias("others")), "mixed")
    total = buckets.agg(F.sum("size")).first()[0]
    if not total:
        return families
    bins = max(1, -(-total // BLOCK))
    full = held.join(buckets, "key").join(reps.select("id", "n", "signature"), "id").withColumn("other", F.col("family") != F.col("main"))
    first, last = (F.ceil(c / BLOCK).cast("int") for c in (F.col("others"), F.col("size") - F.col("others")))
    small = full.where(F.col("size") <= BLOCK).select(F.pmod(F.xxhash64("key"), F.lit(bins)).alias("g"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(-1).alias("own"), "key", "family", "id", "other", "n", "signature")
    place = F.when(F.col("other"), F.pmod(F.xxhash64("id"), first)).otherwise(first + F.pmod(F.xxhash64("id"), last)).cast("int")
    met = F.when(F.col("other"), first + last).otherwise(first) - 1
    large = full.where(F.col("size") > BLOCK).withColumn("own", place).withColumn("block", F.explode(F.sequence(F.lit(0), met)))
    large = large.select(F.col("key").alias("g"), F.least("own", "block").alias("i"), F.greatest("own", "block").alias("j"), "own", "key", "family", "id", "other", "n", "signature")

    def run(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        own, key, family, other, n = (table.column(c).to_numpy() for c in ("own", "key", "family", "other", "n"))
        sign = matrix(table.column("signature"))
        parent: dict[int, int] = {}
        out = []
        for left, right in pairings(own, key, i, j):
            for x in left:
                y = right if i != j else right[right > x]
                y = y[(other[y] | other[x]) & (family[y] != family[x]) & (np.minimum(n[y], n[x]) * 100 >= np.maximum(n[y], n[x]) * percent)]
                if len(y):
                    y = y[(sign[y, :BATCH] == sign[x, :BATCH]).sum(axis=1) >= need[BATCH]]
                if len(y):
                    y = y[plausible(np.broadcast_to(sign[x], (len(y), HASHES)), sign[y], need)]
                for v in y:
                    p, q = root(parent, family[v]), root(parent, family[x])
                    if p != q:
                        parent[max(p, q)] = min(p, q)
                        out.append((min(p, q), max(p, q)))
        return pa.table({"a": pa.array([r[0] for r in out], pa.int64()), "b": pa.array([r[1] for r in out], pa.int64())})

    joins = materialise(small.unionByName(large).groupBy("g", "i", "j").applyInArrow(run, "a long, b long"), "joins")
    whole = materialise(connected_components(joins), "joined")
    known = families.unionByName(whole.select(F.col("node").alias("id"), F.col("node").alias("family"))).distinct()
    return known.join(whole.select(F.col("node").alias("family"), "component"), "family", "left").select("id", F.coalesce("component", "family").alias("family"))


def pairings(own: np.ndarray, key: np.ndarray, i: int, j: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of blocks i and j, for each key apart."""
    order = np.argsort(key, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
        yield rows[own[rows] == i], rows[own[rows] == j]


def links_between(members: DataFrame, reps: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Verified links (a, b) between components of one family, from members (family, size, id, component).

    Small families are dealt into bins by hash, large ones into blocks of which every
    pair meets in one task; a task holds about twice BLOCK members at most. In a task
    plausible pairs are verified on full sets, the likeliest first, unless its own links
    join their components already; so it gives fewer links than it has members.
    """
    need = least_matches(percent / 100)
    total = members.count()
    bins, blocks = max(1, -(-total // BLOCK)), F.ceil(F.col("size") / BLOCK).cast("int")
    sets = packed_sets(docs, members.select("id").distinct(), k)
    full = members.join(reps.select("id", "n", "signature"), "id").join(sets, "id")
    small = full.where(F.col("size") <= BLOCK).select(F.pmod(F.xxhash64("family"), F.lit(bins)).alias("g"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(-1).alias("own"), "family", "id", "component", "n", "signature", "found")
    large = full.where(F.col("size") > BLOCK).withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    large = large.select(F.col("family").alias("g"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "family", "id", "component", "n", "signature", "found")

    def run(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        own, family, ids, component, n = (table.column(c).to_numpy() for c in ("own", "family", "id", "component", "n"))
        sign, sets = matrix(table.column("signature")), numbers(table.column("found"))
        flat, at = np.concatenate([*sets, np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        parent: dict[int, int] = {}
        out = []
        for x in left:
            y = right if i != j else right[right > x]
            y = y[(family[y] == family[x]) & (component[y] != component[x]) & (np.minimum(n[y], n[x]) * 100 >= np.maximum(n[y], n[x]) * percent)]
            if len(y):
                y = y[plausible(np.broadcast_to(sign[x], (len(y), HASHES)), sign[y], need)]
            y = np.array([v for v in y if root(parent, component[v]) != root(parent, component[x])], np.int64)
            if not len(y):
                continue
            elements = np.concatenate([flat[at[v] : at[v + 1]] for v in y])
            place = np.minimum(np.searchsorted(sets[x], elements), len(sets[x]) - 1)
            edge = np.concatenate([[0], np.cumsum(at[y + 1] - at[y])])
            hit = np.concatenate([[0], np.cumsum(sets[x][place] == elements)])
            shared = hit[edge[1:]] - hit[edge[:-1]]
            for v in y[100 * shared >= percent * (n[x] + n[y] - shared)]:
                p, q = root(parent, component[v]), root(parent, component[x])
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    out.append((min(ids[x], ids[v]), max(ids[x], ids[v])))
        return pa.table({"a": pa.array([r[0] for r in out], pa.int64()), "b": pa.array([r[1] for r in out], pa.int64())})

    return materialise(small.unionByName(large).groupBy("g", "i", "j").applyInArrow(run, "a long, b long"), "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles long, component_id long, kept boolean) of every document.

    Words are separated by white space (20, 09 to 0D), A-Z lower-cased. Documents are
    linked where 100 * intersection >= percent * union of their sets of `shingle`-word
    shingles; component_id is the least id that links reach. Texts of fewer words are one
    shingle; null, empty and blank texts have none and are linked with nothing. Repeated
    rows give repeated rows, an empty table none. A null id belongs to no component. Ids
    are integers; other columns are ignored. A pair at the threshold is missed with a
    probability of about MISS for each batch, and that its bands never meet.
    """
    with passing_tables(prepare(docs.sparkSession)):
        plain = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
        sketch = materialise(sketches(plain, shingle), "sketches")
        whole = sketch.where("digest is not null and id is not null")
        reps = materialise(whole.groupBy("digest").agg(F.min("id").alias("id"), F.min_by(F.struct("n", "signature"), "id").alias("x")).select("digest", "id", "x.n", "x.signature"), "representatives")
        classes = components_of(reps, plain, shingle, percent)
        component = F.when(F.col("id").isNotNull(), F.coalesce("found", "id"))
        out = sketch.select("id", "n", "digest").join(classes, "digest", "left").select("id", F.col("n").alias("n_shingles"), component.alias("component_id"))
        out = out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
        return materialise(out, "near_duplicates", outside=True)


def components_of(reps: DataFrame, plain: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(digest, found) of the representatives (digest, id, n, signature), found being the least id that links reach; plain holds their texts."""
    rows = bucket_rows(reps)
    keys = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("pivot")).where("size > 1")
    shared = materialise(rows.join(keys, "key").where("id <> pivot"), "shared")
    stars = shared.select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    near = materialise(compared(stars, reps, percent), "near")
    best = near.where("likely").groupBy("b").agg(F.max(F.struct("matches", (-F.col("a")).alias("first"))).alias("m"))
    links = verified(materialise(best.select((-F.col("m.first")).alias("a"), "b"), "pairs"), plain, shingle, percent)
    parts = forest_roots(links).withColumnRenamed("node", "id")
    families = connected_components(near.select("a", "b")).select(F.col("node").alias("id"), F.col("component").alias("family"))
    families = bucket_families(shared.where("size > 2").select("key", "id"), families, reps, percent)
    labelled = materialise(families.join(parts, "id", "left").select("family", "id", F.coalesce("component", "id").alias("component")), "families")
    open_ones = labelled.groupBy("family").agg(F.count("*").alias("size"), F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("family", "size")
    more = links_between(materialise(labelled.join(open_ones, "family"), "open"), reps, plain, shingle, percent)
    top = lambda x: parts.select(F.col("id").alias(x), F.col("component").alias(f"r{x}"))
    between = more.join(top("a"), "a", "left").join(top("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    joined = connected_components(between).select(F.col("node").alias("part"), F.col("component").alias("whole"))
    own = reps.select("digest", "id").join(parts, "id", "left").select("digest", F.coalesce("component", "id").alias("part"))
    return own.join(joined, "part", "left").select("digest", F.coalesce("whole", "part").alias("found"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, of which near_duplicates() keeps one for each component: that of the least id.

    Rows are judged each for itself: of repeated rows one stays, and where an id occurs
    with several texts each is compared. Rows with null ids take part and stay only where
    no other row of their component has an id. Null, empty and blank texts stay, an empty
    table stays empty.
    """
    row = free_name(docs, "row")
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(numbered, row, text_col, shingle, percent)
    several = found.join(found.where("not kept").select("component_id").distinct(), "component_id").select(row, "component_id")
    several = materialise(several.join(numbered.select(row, F.struct(F.col(id_col).isNull(), F.col(id_col), F.col(row).alias("row")).alias("place")), row), "several")
    first = several.groupBy("component_id").agg(F.min("place").alias("first"))
    gone = materialise(several.join(first, "component_id").where(F.col(row) != F.col("first.row")).select(row), "ids")
    few = gone.count() <= BROADCAST_IDS
    return numbered.join(F.broadcast(gone) if few else gone, row, "left_anti").select(docs.columns)
