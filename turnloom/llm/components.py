"""Connected components of an edge table, for any number of edges and any group size.

Alternating large-star and small-star contraction: every round hangs nodes on smaller ones with
one aggregation by node; nothing is collected and no group of neighbours is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    hung = down.join(low, "a")
    return hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge (a, b): root is the smallest node of its component.

    Self loops and repeated edges do no harm; no edges give no rows.
    """
    kind = edges.schema["a"].dataType
    edges = C.cut(edges.select(F.col("a").cast(kind), F.col("b").cast(kind)).where("a <> b").distinct(), "edges")
    before = None
    while True:
        last, edges = edges, C.cut(_small_star(_large_star(edges)), "stars")
        C.forget(last)
        # order-free digest of the edges: unchanged means every component is one star
        now = edges.select(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
