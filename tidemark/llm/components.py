"""Connected components of a link table, in a logarithmic number of rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.scratch import discard, freeze


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links(a, b)``; the component is its smallest node.

    Each round hangs every node's larger neighbours on its smallest neighbour,
    and then its smaller ones, until all links point at a component's smallest
    node.  A round's links are written, so none depends on an earlier one.  Only
    minima are grouped, which combine before the shuffle.
    """
    empty = links.select(F.col("a").alias("node"), F.col("b").alias("component")).where("false")
    edges = freeze(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    if edges.isEmpty():
        return empty
    while True:
        # every node and its smallest neighbour, itself included
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        outward = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        star = freeze(outward.where("a <> b").distinct(), "links")
        least = star.groupBy("a").agg(F.min("b").alias("m"))
        inward = star.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        after = freeze(inward.where("a <> b").distinct(), "links")
        roots = after.select(F.col("b").alias("root")).distinct()
        discard(edges, star)
        settled = after.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
        if settled and after.join(roots, after["a"] == roots["root"], "left_semi").isEmpty():
            break
        edges = after
    own = after.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return after.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(own)
