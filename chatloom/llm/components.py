"""Connected components by alternating large-star and small-star."""

from pyspark.sql import functions as F

from chatloom.llm.columns import with_checkpoints


def _star(edges, small):
    """One pass: every node sends its smallest neighbour to (large) greater or (small) not greater neighbours.

    ``edges`` holds both directions (large) or those to smaller nodes (small). The smallest
    neighbour is a plain minimum, so it is found before the shuffle, and a node with very
    many neighbours is a skewed join key that Spark splits.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = edges.join(least, "u")
    if small:
        moved = joined.select(F.col("v").alias("a"), "m").union(least.select(F.col("u").alias("a"), "m"))
    else:
        moved = joined.where("v > u").select(F.col("v").alias("a"), "m")
    return moved.where("a <> m").select(F.col("a").alias("u"), F.col("m").alias("v")).distinct()


def components(edges, most_rounds=60):
    """The smallest node of the component of every linked node: ``node``, ``component``.

    ``edges`` has columns ``u`` and ``v`` in any direction, repeats and loops allowed. A
    round halves the depth of the trees at least; lineage is cut with a checkpoint. Nodes
    without a link to another node are not in the result.
    """
    low, high = F.least("u", "v"), F.greatest("u", "v")
    edges = with_checkpoints(edges).select(high.alias("u"), low.alias("v")).where("u <> v").distinct().checkpoint()
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        after = _star(_star(both, small=False), small=True).checkpoint()
        # Stable when all edges are where they were: then every node points to its root.
        if after.count() == edges.count() and after.exceptAll(edges).isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        edges = after
    raise RuntimeError(f"no stable components after {most_rounds} rounds")
