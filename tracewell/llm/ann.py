"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by a sum of codewords, one from each of CODEBOOKS codebooks
over all dimensions, found by beam search over the residuals. What is coded is the
vector's direction; each code stores the vector's norm and how far the approximation is
off. A query's inner products with all codewords form a lookup table; a code's score is
the sum of its entries times the stored norm. The best SHORTLIST of each block by that
score are ranked exactly; so are all other rows that, as far as their approximation may
be off, could still beat the k-th of these.

Codes lie in inverted lists by their vector's nearest centre. A query first looks into
the lists whose centres have the largest inner products with it; how many that are is
found on the data: as many as hold FOUND of the true neighbours of TRIED rows. Then it
looks into each other list whose farthest and longest vectors leave room for a better
one than the k-th found. So no neighbour is missed, whatever the vectors; codes and
lists only save work.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.llm.common import first_by_hash, materialise, prepare

CODEBOOKS, WORDS, BEAM = 16, 256, 4
#: Vectors that codebooks are fitted on at most, rounds of k-means for each, and rounds of joint refinement.
SAMPLE, ROUNDS, REFINEMENTS, SEED = 6000, 8, 2, 5
#: Codes of a block, queries that meet a block at once, codes that are ranked exactly for each query and block.
BLOCK, QUERIES, SHORTLIST = 16_384, 8_192, 400
#: Inverted lists at most (one for each LIST_ROOT square roots' worth of rows), rows that
#: the number of lists to look into is found on, and the share of their neighbours in these.
LISTS, LIST_ROOT, TRIED, FOUND = 1024, 8, 128, 0.96
#: What a bound of single precision may be wrong by, for vectors of length 1.
SLACK = 2e-5


def k_means(x: np.ndarray, words: int, rng: np.random.Generator) -> np.ndarray:
    """(words, dimensions) centres after ROUNDS rounds; a centre without vectors is moved to one."""
    centre = x[rng.choice(len(x), words, replace=len(x) < words)]
    for _ in range(ROUNDS):
        near = (x @ centre.T - (centre**2).sum(axis=1) / 2).argmax(axis=1)
        count = np.bincount(near, minlength=words)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        centre = np.where(count[:, None] > 0, total / np.maximum(1, count)[:, None], x[rng.integers(0, len(x), words)])
    return centre


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vectors of length 1, their norms), also where the squares of components are beyond a double."""
    x = x.astype(np.float64)
    most = np.abs(x).max(axis=1, initial=0)
    y = x / np.where(most > 0, most, 1)[:, None]
    length = np.sqrt((y**2).sum(axis=1))
    with np.errstate(over="ignore"):
        return y / np.where(length > 0, length, 1)[:, None], np.minimum(most * length, np.finfo(np.float64).max)


class InvertedLists:
    """Centres of the lists, and how many of them a query looks into."""

    def __init__(self, centres: np.ndarray, probes: int = 1):
        self.centres, self.probes = centres.astype(np.float32), probes

    @staticmethod
    def fit(x: np.ndarray, rows: int) -> InvertedLists:
        """Centres fitted on a sample x of a table of `rows` vectors."""
        number = int(max(1, min(LISTS, rows**0.5 / LIST_ROOT)))
        return InvertedLists(k_means(directions(x)[0].astype(np.float32), number, np.random.default_rng(SEED)))

    def of(self, x: np.ndarray) -> np.ndarray:
        """The list of each vector: the centre's that is nearest to its direction."""
        return (directions(x)[0].astype(np.float32) @ self.centres.T - (self.centres**2).sum(axis=1) / 2).argmax(axis=1).astype(np.int32)

    def order(self, queries: np.ndarray) -> np.ndarray:
        """(queries, lists): all lists, that with the largest inner product first."""
        return np.argsort(-(directions(queries)[0].astype(np.float32) @ self.centres.T), axis=1, kind="stable").astype(np.int32)


class AdditiveQuantiser:
    """CODEBOOKS x WORDS codewords of the vectors' own dimension."""

    def __init__(self, books: np.ndarray):
        self.books = books.astype(np.float32)
        self.square = (self.books**2).sum(axis=2)

    def __reduce__(self):
        return AdditiveQuantiser, (self.books,)  # what is derived from the books isn't sent to executors

    @cached_property
    def cross(self) -> np.ndarray:
        """Inner products of all codewords, as [book, word, book, word]."""
        flat = self.books.reshape(-1, self.books.shape[2])
        return (flat @ flat.T).reshape(len(self.books), -1, *self.books.shape[:2])

    @staticmethod
    def fit(x: np.ndarray, codebooks: int = CODEBOOKS, words: int = WORDS) -> AdditiveQuantiser:
        """k-means on the directions' residuals book by book, then all books refitted to the codes by least squares."""
        rng = np.random.default_rng(SEED)
        x = directions(x)[0]
        rest, books = x.astype(np.float32).copy(), []
        for _ in range(codebooks):
            centre = k_means(rest, words, rng)
            rest -= centre[(rest @ centre.T - (centre**2).sum(axis=1) / 2).argmax(axis=1)]
            books.append(centre)
        made = AdditiveQuantiser(np.stack(books))
        for _ in range(REFINEMENTS):
            codes = made.encode(x)
            place = codes.astype(np.int64) + np.arange(codebooks) * words
            size = codebooks * words
            gram = np.zeros((size, size), np.float32)
            for m in range(codebooks):
                np.add.at(gram.reshape(-1), (place[:, m, None] * size + place).ravel(), np.float32(1))
            right = np.zeros((size, x.shape[1]), np.float32)
            for m in range(codebooks):
                np.add.at(right, place[:, m], x.astype(np.float32))
            ridge = np.float32(0.1)
            gram[np.arange(size), np.arange(size)] += ridge
            right += ridge * made.books.reshape(size, -1)
            made = AdditiveQuantiser(np.linalg.solve(gram, right).reshape(made.books.shape))
        return made

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """(n, CODEBOOKS) codes: the best `beam` partial sums are kept after each codebook."""
        out = np.empty((len(x), len(self.books)), np.uint8)
        for k in range(0, len(x), 2048):
            out[k : k + 2048] = self._encode(x[k : k + 2048].astype(np.float32), beam)
        return out

    def _encode(self, x: np.ndarray, beam: int) -> np.ndarray:
        n, words = len(x), self.books.shape[1]
        codes = np.zeros((n, 1, 0), np.uint8)
        cost = np.zeros((n, 1), np.float32)  # squared error less the vector's own square
        rows = np.arange(n)[:, None]
        for m, book in enumerate(self.books):
            step = self.square[m] - 2 * (x @ book.T)  # (n, words)
            new = cost[:, :, None] + step[:, None, :]
            for j in range(m):
                new += 2 * self.cross[j, codes[:, :, j], m]
            new = new.reshape(n, -1)
            keep = min(beam, new.shape[1])
            best = np.argpartition(new, keep - 1, axis=1)[:, :keep] if keep < new.shape[1] else np.tile(np.arange(keep), (n, 1))
            cost = new[rows, best]
            codes = np.concatenate([codes[rows, best // words], (best % words).astype(np.uint8)[:, :, None]], axis=2)
        return codes[np.arange(n), cost.argmin(axis=1)]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[m][codes[:, m]] for m in range(len(self.books)))

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(CODEBOOKS, WORDS, queries) inner products, queries last so that a code's entries are added as rows."""
        return np.einsum("mwd,qd->mwq", self.books, queries.astype(np.float32), optimize=True)


def usable(vector: Column) -> Column:
    """Vectors that take part: not null or empty, every component a finite number, not all zero."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def stacked(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def sampled(vectors: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """`sample` of the vectors (id, v) at most, the first by the hash of their id; the bound holds at any size."""
    picked = first_by_hash(vectors, "id", sample).orderBy("id").select("v").toArrow()
    return stacked(picked.column("v")).astype(np.float64)


def build_index(vectors: DataFrame, quantiser: AdditiveQuantiser, lists: InvertedLists) -> DataFrame:
    """(id, v, code binary, norm, off, list, far, row) of every vector (id, v), written to the shared folder.

    off is the distance of the direction from its approximation, far that from the list's centre.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = stacked(batch.column(1)).astype(np.float64)
            unit, norm = directions(x)
            codes, own = quantiser.encode(unit), lists.of(x)
            off, far = (np.sqrt(((unit - y) ** 2).sum(axis=1)) for y in (quantiser.decode(codes), lists.centres[own]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), *map(pa.array, (norm, off, own, far))], names=["id", "v", "code", "norm", "off", "list", "far"])

    coded = vectors.select("id", "v").mapInArrow(run, "id long, v array<double>, code binary, norm double, off double, list int, far double")
    return materialise(coded.withColumn("row", F.monotonically_increasing_id()), "codes")


def probes_for(index: DataFrame, lists: InvertedLists, k: int, tried: int = TRIED, found: float = FOUND) -> int:
    """How many lists a query must look into so that they hold `found` of the true k nearest of `tried` rows.

    The rows are the first by the hash of their id. Their neighbours are found by one
    exact scan of the whole index, in which each task keeps the k best for each row.
    """
    picked = first_by_hash(index.select("id", "v"), "id", tried).orderBy("id").toArrow()
    own, q = picked.column("id").to_numpy(), stacked(picked.column("v")).astype(np.float64)
    order = lists.order(q)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1], dtype=np.int32)[None, :], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.zeros(0, kind) for kind in (np.int32, np.float64, np.int64, np.int32)]
        floor = np.full(len(q), -np.inf)
        for batch in batches:
            ids, score = batch.column(0).to_numpy(), q @ stacked(batch.column(1)).astype(np.float64).T
            score[own[:, None] == ids[None, :]] = -np.inf
            if len(ids) > k:
                floor = np.maximum(floor, np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k])
            row, col = np.nonzero((score >= floor[:, None]) & (score > -np.inf))
            new = row.astype(np.int32), score[row, col], ids[col], place[row, batch.column(2).to_numpy()[col]]
            best = [np.concatenate(pair) for pair in zip(best, new, strict=True)]
            by = np.lexsort((best[2], -best[1], best[0]))
            best = [column[by] for column in best]
            nth = np.arange(len(by)) - np.searchsorted(best[0], best[0])
            best = [column[nth < k] for column in best]
        yield pa.RecordBatch.from_arrays(list(map(pa.array, best)), names=["row", "score", "id", "place"])

    scanned = index.select("id", "v", "list").mapInArrow(run, "row int, score double, id long, place int")
    nearest_first = Window.partitionBy("row").orderBy(F.desc("score"), "id")
    places = scanned.withColumn("nth", F.row_number().over(nearest_first)).where(F.col("nth") <= k).select("place").toArrow().column("place").to_numpy()
    return int(np.sort(places)[int(np.ceil(found * len(places))) - 1]) + 1 if len(places) else 1


def search(index: DataFrame, queries: DataFrame, quantiser: AdditiveQuantiser, lists: InvertedLists, k: int, shortlist: int = SHORTLIST) -> DataFrame:
    """(query_id, rank, id, score): the k nearest found of each query (row, id, v), rows of its id left out, ties to the smaller id.

    Each query goes to the first lists.probes lists in its order, and to as many more as
    hold k others together, so it never gets fewer rows than there are; then to all others
    that may hold a better one than its k-th.
    """
    held = {r["list"]: r for r in index.groupBy("list").agg(F.count("*").alias("n"), F.max("norm").alias("norm"), F.max("far").alias("far")).collect()}  # LISTS rows at most
    size, longest, far = (np.array([held[i][c] if i in held else 0 for i in range(len(lists.centres))]) for c in ("n", "norm", "far"))
    schema = "query_row long, query_id long, q array<double>, floor double, lists array<int>"
    names = [c.split()[0] for c in schema.split(", ")]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = lists.order(stacked(batch.column(2)))
            short = (size[order].cumsum(axis=1) <= k).sum(axis=1)  # lists that hold k rows or fewer, the query's own among them
            chosen = [row[: max(lists.probes, n + 1)] for row, n in zip(order, short, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, -np.inf)), pa.array(chosen, pa.list_(pa.int32()))], names=names)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, norm = directions(stacked(batch.column(2)))
            room = np.maximum(unit @ lists.centres.T.astype(np.float64) + far + SLACK, 0)
            open_ = (room * longest >= (batch.column(3).to_numpy() / norm)[:, None]) & (size > 0)
            for row, seen in enumerate(batch.column(4).to_pylist()):
                open_[row, seen] = False
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([np.flatnonzero(row).astype(np.int32) for row in open_], pa.list_(pa.int32()))], names=names)

    nearest_first = Window.partitionBy("query_row").orderBy(F.desc("score"), "id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= k)
    asked = materialise(queries.select("row", "id", "v").mapInArrow(first, schema), "probes")
    found = materialise(ranked(meet(index, asked, quantiser, k, shortlist)).drop("rank"), "found")
    # a query with fewer than k rows has looked into all lists
    floor = found.groupBy("query_row").agg(F.min("score").alias("floor"))
    again = asked.drop("floor").join(floor, "query_row").select(*names).mapInArrow(others, schema).where(F.size("lists") > 0)
    more = meet(index, materialise(again, "probes"), quantiser, k, shortlist)
    return ranked(found.unionByName(more)).select("query_id", "rank", "id", "score")


def meet(index: DataFrame, asked: DataFrame, quantiser: AdditiveQuantiser, k: int, shortlist: int = SHORTLIST) -> DataFrame:
    """(query_row, query_id, id, score): for each query (query_row, query_id, q, floor, lists) and block of its lists the k nearest with a score of floor or more.

    A list's codes are dealt into blocks, and the queries that look into it into groups, of
    bounded size by hashes of their ids; each group meets each block of its list in one
    task. It scores the block's codes by lookup tables, ranks `shortlist` of them (more
    where the block is smaller) exactly in double precision, and then all rows that these
    leave possible. What is joined is k rows for each query and block.
    """
    held = index.groupBy("list").agg(F.count("*").alias("n"))
    parts = lambda column, size: F.ceil(F.col(column) / size).cast("int")
    deal = lambda column, number: F.pmod(F.xxhash64(column), F.col(number)).cast("int")
    every = lambda number: F.explode(F.sequence(F.lit(0), F.col(number) - 1))
    number = asked.select(F.explode("lists").alias("list")).groupBy("list").agg(F.count("*").alias("m"))
    # a row for each list, of which there are LISTS at most
    dealt = F.broadcast(held.join(number, "list").select("list", parts("n", BLOCK).alias("blocks"), parts("m", QUERIES).alias("groups")))
    left = asked.select("query_row", "query_id", "q", "floor", F.explode("lists").alias("list")).join(dealt, "list").select("query_row", "query_id", "q", "floor", "list", deal("query_row", "groups").alias("g"), every("blocks").alias("b"))
    right = index.join(dealt, "list").withColumns({"b": deal("row", "blocks"), "g": every("groups")}).drop("row", "far", "blocks", "groups")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list[np.ndarray]] = {"query_row": [], "query_id": [], "id": [], "score": []}
        if left.num_rows and right.num_rows:
            ids = right.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], stacked(right.column("v")).astype(np.float64)[order]
            codes = np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)[order]
            norm, off = right.column("norm").to_numpy()[order], right.column("off").to_numpy()[order].astype(np.float32)
            longest = norm.max()
            norm = (norm / longest).astype(np.float32)
            query_rows, query_ids, floors, every_q = left.column("query_row").to_numpy(), left.column("query_id").to_numpy(), left.column("floor").to_numpy(), stacked(left.column("q")).astype(np.float64)
            keep = min(len(ids), shortlist + 1)
            for a in range(0, len(every_q), 256):
                q, own, least = every_q[a : a + 256], query_ids[a : a + 256], floors[a : a + 256].copy()
                unit, scale = directions(q)
                with np.errstate(over="ignore"):
                    scale = np.minimum(scale * longest, np.finfo(np.float64).max)
                table = quantiser.tables(unit)
                score = table[0][codes[:, 0]]
                for book in range(1, len(table)):
                    score += table[book][codes[:, book]]
                upper = ((score + off[:, None]) * norm[:, None]).T
                score = (score * norm[:, None]).T
                for row, approximate in enumerate(score):
                    floor = np.partition(approximate, len(ids) - keep)[len(ids) - keep]
                    near = np.flatnonzero(approximate >= floor)
                    if len(near) > 2 * keep:  # many equal scores: all above the floor, then the smallest ids at it
                        near = np.concatenate([near[approximate[near] > floor], near[approximate[near] == floor][:keep]])
                    near = near[ids[near] != own[row]]
                    if len(near) >= k:
                        exact = (x[near] * q[row]).sum(axis=1)
                        least[row] = max(least[row], np.partition(exact, len(near) - k)[len(near) - k])
                possible = upper >= (least / scale - SLACK)[:, None]
                at = np.flatnonzero(possible.any(axis=0))
                possible = possible[:, at] & (q @ x[at].T >= (least - 1e-9 * scale)[:, None])
                for row, better in enumerate(possible):
                    near = at[better]
                    near = near[ids[near] != own[row]]
                    exact = (x[near] * q[row]).sum(axis=1)
                    top = np.lexsort((ids[near], -exact))[:k]
                    out["query_row"].append(np.full(len(top), query_rows[a + row]))
                    out["query_id"].append(np.full(len(top), own[row]))
                    out["id"].append(ids[near[top]])
                    out["score"].append(exact[top])
        join = lambda name, kind: np.concatenate(out[name]).astype(kind) if out[name] else np.zeros(0, kind)
        return pa.table({"query_row": join("query_row", np.int64), "query_id": join("query_id", np.int64), "id": join("id", np.int64), "score": join("score", np.float64)})

    return left.groupBy("list", "g", "b").cogroup(right.groupBy("list", "g", "b")).applyInArrow(run, "query_row long, query_id long, id long, score double")


def nearest(table: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id long, rank int, vec_id long, score double): the k nearest of every row whose id is divisible by `every`.

    Vectors that are null, empty, zero, or hold null or non-finite components take no
    part, nor do those whose length isn't the commonest (the longest of equally common
    ones; their inner product with others isn't defined, so as queries they get no rows),
    nor null ids. Rows of a query's own id are never its neighbours. Where an id
    occurs more than once each of its rows is a query, with k rows of its own, and each is
    a candidate. An empty table gives no rows; other columns are ignored.
    """
    spark = prepare(table.sparkSession)
    rows = table.select(table[id_col].cast("long").alias("id"), table[vector_col].cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    empty = "query_id long, rank int, id long, score double"
    if common is None:
        found = spark.createDataFrame([], empty)
    else:
        rows = rows.where(F.size("v") == common["d"])
        sample = sampled(rows)
        quantiser, lists = AdditiveQuantiser.fit(sample), InvertedLists.fit(sample, common["n"])
        index = build_index(rows, quantiser, lists)
        lists.probes = probes_for(index, lists, k)
        found = search(index, index.where(F.col("id") % every == 0), quantiser, lists, k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
