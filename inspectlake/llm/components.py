"""Connected components of an edge table, by alternating large-star and small-star steps."""

from pyspark.sql import functions as F


def _state(edges):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("node", "root"))).first()


def components(edges, save):
    """(node, root) for every node with an edge: root is the smallest node of its component.

    ``edges`` has bigint columns (a, b).  Each round rewrites the edges to point at
    smaller nodes with aggregations that combine before the shuffle and joins that
    adaptive execution splits, and saves them; the rounds grow with the logarithm of
    the longest chain.  A root has no row of its own.
    """
    a, b = F.col("a"), F.col("b")
    now = save(edges.where(a != b).select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root")).distinct())
    state = _state(now)
    while state[0]:
        both = now.select(F.col("node").alias("v"), F.col("root").alias("u")).unionByName(now.select(F.col("root").alias("v"), F.col("node").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("node"), F.col("m").alias("root")).distinct()
        least = large.groupBy("node").agg(F.min("root").alias("m"))
        small = large.join(least, "node")
        moved = small.select(F.col("root").alias("node"), F.col("m").alias("root")).where("node <> root")
        now = save(moved.unionByName(small.select("node", F.col("m").alias("root"))).distinct())
        last, state = state, _state(now)
        if last == state:
            break
    return now
