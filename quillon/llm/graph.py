"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import save


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` (the least id reachable) for every id in ``edges(a, b)``.

    Each round links every neighbour to the least id of its neighbourhood, once
    over the larger and once over the smaller neighbours; the number of rounds
    is logarithmic in the number of ids.  Minima are combined before the
    shuffle, so a star's centre is no hot key.  Rounds are written tables.
    """
    edges = save(edges.filter("a <> b").selectExpr("greatest(a, b) as a", "least(a, b) as b").distinct(), "edges")
    while True:
        # Larger neighbours of u are tied to the least of u and its neighbours.
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = save(large.filter("a <> b").distinct(), "large-star")
        # Smaller neighbours of u, and u, are tied to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        small = save(small.filter("a <> b").distinct(), "small-star")
        # Done when every id hangs on one id that hangs on none.
        tied = small.groupBy("a").agg(F.count("*").alias("n"))
        open_ = tied.filter("n > 1").unionByName(
            small.select(F.col("b").alias("a")).join(small.select("a"), "a", "left_semi").withColumn("n", F.lit(0).cast("long"))
        )
        edges = small
        if open_.isEmpty():
            break
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
