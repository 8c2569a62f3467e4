"""Connected components of an edge table, as joins and grouped minima until nothing moves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.plans.shared import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``: root is the smallest node of its component.

    Alternates two steps: every node hands its larger neighbours to the smallest node around it, then its
    smaller ones (the "large star" and "small star" of Kiveris et al., 2014).  Each round's edges are a
    written table, so a lost executor costs tasks of one round.  No adjacency list is ever gathered:
    neighbours meet only in a minimum (combined before the shuffle) and an equi-join that adaptive
    execution can split.  Self-loops, repeats and either direction are allowed; nodes must not be null.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, "edges")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large, "large")
        # small star: below each node only its smallest neighbour remains; the others move to it
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a")
        small = moved.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        small = materialize(small, "small")
        # finished when every edge is (node, root): no upper end has two lower ends, and no lower end is an upper end
        roots = small.select(F.col("b").alias("a")).distinct()
        open_ends = small.join(roots, "a", "left_semi").limit(1).count() + moved.where("b <> m").limit(1).count()
        edges = small
        if not open_ends:
            return small.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select(F.col("a").alias("node"), F.col("a").alias("root")))
