"""How far the sources of a language differ in their words: exact distances of smoothed word shares, and each source's most typical words.

Each language keeps the terms of at least LEAST_DOCS of its documents. A group (language,
source) gives each kept term the share p = 1 + floor(SCALE * (count + 5) / (N + 5 * V)).
The distance of two groups is the sum of |p - q| over all kept terms.

A term that most groups lack costs nothing for each pair of them: with z the share of a
term that a group lacks, a pair's sum is V * |z - z'| and corrections for the terms that
one of both holds. Light terms, held by few groups, are corrected one by one: first as if
the other group lacked them (from a histogram of each group's shares), then for the
pairs that both hold, from their postings. Heavy terms, held by many groups, are dense
tiles of numpy matrices (terms by groups) whose rows are subtracted as a whole. All
sums are of integers, so the parts add up exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import materialise, passing_tables, prepare, utf8

#: Documents that a kept term is in at least; parts that a share is counted in; what is added to each count.
LEAST_DOCS, SCALE, ADDED = 30, 1_000_000_000, 5
#: Ranks of the typical terms.
TYPICAL = 50
#: A term is heavy if a DENSE-th of its language's groups hold it, MANY at least; terms of a tile; groups of a tile's side.
DENSE, MANY, TILE, SIDE = 8, 3, 1024, 256
#: Entries of a worker's counters, and characters of their terms, before they are handed on.
HELD, HELD_BYTES = 200_000, 64 << 20

#: Bytes that end a term; all others are its letters, of which A-Z are lower-cased.
GAPS = bytes([*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
LETTERS = bytes(32 if b in GAPS else b + 32 if 65 <= b <= 90 else b for b in range(256))


def term_counts(docs: DataFrame, id_free: tuple[str, str, str] = ("text", "lang", "source")) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term, added up by each task in a bounded memory, so terms recur."""
    text_col, lang_col, source_col = id_free

    def handed(held: dict) -> pa.RecordBatch:
        rows = [(*group, term, n, d) for group, terms in held.items() for term, (n, d) in terms.items()]
        lang, source, term, n, d = zip(*rows, strict=True) if rows else ((),) * 5
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.int64())], names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, list[int]]] = {}
        entries = size = 0
        for batch in batches:
            data, at = utf8(batch.column(0))
            for lang, source, a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), at.tolist(), at[1:].tolist(), strict=False):
                found: dict[bytes, int] = {}
                for term in data[a:b].tobytes().translate(LETTERS).split(b" "):
                    found[term] = found.get(term, 0) + 1
                found.pop(b"", None)
                known = held.setdefault((lang, source), {})
                for term, n in found.items():
                    count = known.get(term)
                    if count:
                        count[0] += n
                        count[1] += 1
                    else:
                        known[term] = [n, 1]
                        entries += 1
                        size += len(term)
                if entries > HELD or size > HELD_BYTES:
                    yield handed(held)
                    held, entries, size = {}, 0, 0
        yield handed(held)

    plain = docs.select(docs[text_col].alias("text"), *(F.coalesce(docs[c], F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))))
    return plain.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + ADDED) / (total + ADDED * terms)), in decimals that hold the product."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", wide(n + ADDED) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + ADDED * terms)).cast("long") + 1


def numbered_groups(docs: DataFrame, kept: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, at, groups, v, total, lang_total, z): every group, its number in its language, and the share z of a term that it lacks (0 without kept terms)."""
    occur = docs.select(*(F.coalesce(docs[c], F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source")))).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.count_distinct("term").alias("v"), F.sum("n").alias("lang_total"))
    whole = Window.partitionBy("lang")
    out = occur.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "v", "lang_total"])
    out = out.withColumns({"at": F.row_number().over(whole.orderBy("source")).cast("int") - 1, "groups": F.count("*").over(whole)})
    return materialise(out.withColumn("z", F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("v"))).otherwise(0)), "groups")


def heavy_sums(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, i, j, value) over the heavy terms' rows (lang, term, at, p), i < j: tiles of TILE terms by SIDE groups a side."""
    tile = rows.withColumns({"tile": F.pmod(F.xxhash64("term"), F.col("tiles")), "block": F.floor(F.col("at") / SIDE).cast("int"), "blocks": F.ceil(F.col("groups") / SIDE).cast("int")})
    # the tile's terms that a group lacks have its share z; each block pair gets both blocks' rows, and the groups' z come along as rows without a term
    bare = groups.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("tile"), F.lit(None).cast("string").alias("term"), "at", F.col("z").alias("p"), F.floor(F.col("at") / SIDE).cast("int").alias("block"), F.ceil(F.col("groups") / SIDE).cast("int").alias("blocks"))
    both = tile.select("lang", "tile", "term", "at", "p", "block", "blocks").unionByName(bare)
    both = both.withColumn("met", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    both = both.select("lang", "tile", F.least("block", "met").alias("x"), F.greatest("block", "met").alias("y"), "term", "at", "p")

    def run(table: pa.Table) -> pa.Table:
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        at, p = table.column("at").to_numpy(), table.column("p").to_numpy()
        codes = table.column("term").combine_chunks().dictionary_encode()
        n, term = len(codes.dictionary), codes.indices.to_numpy(zero_copy_only=False)
        groups, own = np.unique(at, return_inverse=True)
        bare = np.isnan(term) if term.dtype.kind == "f" else np.zeros(len(term), bool)
        empty = np.zeros(len(groups), np.int64)
        empty[own[bare]] = p[bare]
        shares = np.repeat(empty[:, None], n, axis=1)
        shares[own[~bare], term[~bare].astype(np.int64)] = p[~bare]
        left, right = np.flatnonzero(groups // SIDE == x), np.flatnonzero(groups // SIDE == y)
        i, j, value = [], [], []
        for a in left:
            b = right[groups[right] > groups[a]]
            i.append(np.full(len(b), groups[a]))
            j.append(groups[b])
            value.append(np.abs(shares[b] - shares[a]).sum(axis=1))
        i, j, value = (np.concatenate([*c, np.zeros(0, np.int64)]).astype(np.int64) for c in (i, j, value))
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(i), pa.string()), "i": i, "j": j, "value": value})

    return both.groupBy("lang", "tile", "x", "y").applyInArrow(run, "lang string, i long, j long, value long")


def light_sums(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, i, j, value) of what the light terms' rows (lang, term, at, p) add to groups that lack all of them."""
    other = groups.select("lang", F.col("at").alias("b"), F.col("z").alias("zb"))
    own = rows.groupBy("lang", "at", "z", "p").agg(F.count("*").alias("n"))
    lacking = own.join(other, "lang").where("at <> b")
    lacking = lacking.groupBy("lang", F.least("at", "b").cast("long").alias("i"), F.greatest("at", "b").cast("long").alias("j")).agg(F.sum(F.col("n") * (F.abs(F.col("p") - F.col("zb")) - F.abs(F.col("z") - F.col("zb")))).alias("value"))
    # both hold the term: |p - q| instead of what was added from either side
    postings = rows.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("at", "p", "z"))).alias("held")).where(F.size("held") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for lang in batch.column(0).unique().to_pylist():
                lists = batch.filter(pa.compute.equal(batch.column(0), lang)).column(1)
                flat = lists.flatten()
                at, p, z = (flat.field(k).to_numpy().astype(np.int64) for k in range(3))
                edge = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
                later = np.repeat(edge[1:], np.diff(edge)) - np.arange(len(at)) - 1
                start = 0
                done = np.concatenate([[0], np.cumsum(later)])
                while start < len(at):
                    end = max(start + 1, int(np.searchsorted(done, done[start] + (1 << 20), "right")) - 1)
                    s = later[start:end]
                    a = np.repeat(np.arange(start, end), s)
                    b = a + 1 + np.arange(len(a)) - np.repeat(done[start:end] - done[start], s)
                    value = np.abs(p[a] - p[b]) - np.abs(p[a] - z[b]) - np.abs(p[b] - z[a]) + np.abs(z[a] - z[b])
                    codes, sums = total.get(lang, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                    codes, inverse = np.unique(np.concatenate([codes, at[a] << 31 | at[b]]), return_inverse=True)
                    added = np.zeros(len(codes), np.int64)
                    np.add.at(added, inverse, np.concatenate([sums, value]))
                    if len(codes) > HELD:
                        yield handed(lang, codes, added)
                        codes, added = codes[:0], added[:0]
                    total[lang] = (codes, added)
                    start = end
        for lang, (codes, sums) in total.items():
            yield handed(lang, codes, sums)

    def handed(lang: str, codes: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes >> 31), pa.array(codes & 0x7FFFFFFF), pa.array(sums)], names=["lang", "i", "j", "value"])

    return lacking.unionByName(postings.select("lang", "held").mapInArrow(run, "lang string, i long, j long, value long"))


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, typical: int = TYPICAL) -> DataFrame:
    """(lang, source, part, item, value long, rank int): distances and typical terms of every group.

    Part `pair` has each other source of the language with the sum of |p - q| over all
    kept terms; part `term` the terms whose share in the group is above that in its whole
    language, by the difference, to rank `typical`. Ranks are by value, descending, then
    by the item's bytes. Null texts, languages and sources count as ''; groups without
    terms take part, a language without kept terms has distances of 0, repeated rows
    count each, an empty table gives none; other columns are ignored.
    """
    with passing_tables(prepare(docs.sparkSession)):
        counts = term_counts(docs, (text_col, lang_col, source_col)).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        each = Window.partitionBy("lang", "term")
        counts = counts.withColumns({"all_docs": F.sum("docs").over(each), "all_n": F.sum("n").over(each), "holders": F.count("*").over(each)})
        kept = materialise(counts.where(F.col("all_docs") >= least_docs).select("lang", "source", "term", "n", "all_n", "holders"), "kept")
        groups = numbered_groups(docs, kept, lang_col, source_col)
        rows = kept.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("v")))
        rows = rows.withColumn("heavy", F.col("holders") >= F.greatest(F.lit(MANY), F.ceil(F.col("groups") / DENSE)))
        tiles = rows.where("heavy").groupBy("lang").agg(F.ceil(F.count_distinct("term") / TILE).alias("tiles"), F.count_distinct("term").alias("dense"))
        rows = materialise(rows.select("lang", "source", "term", "n", "all_n", "at", "groups", "p", "z", "v", "lang_total", "heavy"), "rows")
        tiles = materialise(tiles, "tiles")
        heavy = heavy_sums(rows.where("heavy").join(tiles, "lang"), groups.join(tiles, "lang"))
        light = light_sums(rows.where("not heavy"), groups)
        one = groups.select("lang", F.col("at").cast("long").alias("i"), F.col("source").alias("source"), F.col("z").alias("za"), "v")
        two = groups.select("lang", F.col("at").cast("long").alias("j"), F.col("source").alias("other"), F.col("z").alias("zb"))
        sums = heavy.unionByName(light).groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
        pairs = one.join(two, "lang").where("i < j").join(sums, ["lang", "i", "j"], "left").join(tiles, "lang", "left")
        # the dense tiles hold whole sums of the heavy terms, the light ones what differs from lacking them
        value = F.coalesce("value", F.lit(0)) + (F.col("v") - F.coalesce("dense", F.lit(0))) * F.abs(F.col("za") - F.col("zb"))
        pairs = materialise(pairs.select("lang", "source", "other", value.alias("value")), "pairs")
        pairs = pairs.unionByName(pairs.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value"))
        pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
        above = (F.col("p") - share(F.col("all_n"), F.col("lang_total"), F.col("v"))).alias("value")
        terms = rows.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), above).where("value > 0")
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= typical)
        out = pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)
        return materialise(out, "divergence", outside=True)


#: The same rows in DuckDB's SQL.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
keep AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN keep USING (lang, term) GROUP BY lang, source, term),
cl AS (SELECT lang, term, sum(n)::BIGINT AS n FROM c GROUP BY lang, term),
v AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS total FROM cl GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
gt AS (SELECT g.lang, g.source, coalesce((SELECT sum(n) FROM c WHERE c.lang = g.lang AND c.source = g.source), 0)::BIGINT AS total FROM g),
p AS (SELECT gt.lang, gt.source, cl.term, coalesce(c.n, 0) AS n,
             (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (gt.total + 5 * v.v))::BIGINT AS p,
             (1 + (1000000000::HUGEINT * (cl.n + 5)) // (v.total + 5 * v.v))::BIGINT AS q
      FROM gt JOIN v USING (lang) JOIN cl USING (lang) LEFT JOIN c ON c.lang = gt.lang AND c.source = gt.source AND c.term = cl.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q),
every AS (SELECT * FROM pair UNION ALL SELECT * FROM term),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM every)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
