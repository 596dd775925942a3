"""Connected components of edges by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.sources.tables import at_rest, passing_tables


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the least node reachable over edges (a, b), for every node that has an edge.

    Alternates large-star and small-star steps, each a join and an aggregation with
    map-side combine, and writes the edges between rounds, until all are stars. No group is gathered:
    a hub's neighbours stay separate rows, and its join can be split by AQE. Null
    ends and self-loops are ignored; repeated edges count once; no edges give no rows.
    """
    with passing_tables(edges.sparkSession):
        pairs = edges.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")).where("u is not null and v is not null and u <> v")
        pairs = at_rest(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        for _ in range(max_rounds):
            if settled(pairs):
                break
            both = both_ways(pairs)
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            pairs = at_rest(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        found = pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        return at_rest(found, "components", outside=True)


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))


def settled(pairs: DataFrame) -> bool:
    """Whether distinct edges u > v are stars around the least node of each component: then every node with a lesser neighbour has no other."""
    nodes = both_ways(pairs).groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return nodes.agg(F.count_if((F.col("m") < F.col("u")) & (F.col("n") > 1))).first()[0] == 0
