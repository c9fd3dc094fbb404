"""Connected components: weak ones by star contraction, strong ones by reachability inside weak parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duewise.storage import written


def _down(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()


def weak_components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes of ``links`` (a, b), whatever their direction: the smallest node in reach.

    Two kinds of steps take turns. A large-star step ties a node's larger neighbours to its smallest neighbour, a small-star
    step its smaller ones; paths halve, so the rounds follow the logarithm of the longest one. Null ends are ignored.
    """
    edges, state = written(_down(links.filter("a is not null and b is not null"))), None
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        edges = _down(both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        edges = written(_down(edges.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))))
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    loops = links.filter("a = b").select("a", F.col("a").alias("b"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").union(loops.join(edges.select("a"), "a", "left_anti")).distinct())


def strong_components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes of directed ``links`` (a, b): the smallest node of the strong component.

    Rounds of colouring: the largest label that reaches a node is its colour; what reaches a colour's root inside the colour is
    one component and leaves. Nodes without an edge in or out are trimmed first, which takes acyclic parts away at once.
    """
    edges = written(links.select("a", "b").distinct())
    nodes = written(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct())
    done = nodes.select("node", F.col("node").alias("component")).limit(0)
    alive, edges = nodes, edges.filter("a <> b")
    while True:
        while True:  # trim
            ends = edges.select(F.col("a").alias("node")).intersect(edges.select("b"))
            kept = written(edges.join(ends.withColumnRenamed("node", "a"), "a", "left_semi").join(ends.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b"))
            if kept.count() == edges.count():
                break
            edges = kept
        inside = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
        done = done.union(alive.join(inside, "node", "left_anti").select("node", F.col("node").alias("c")))
        alive = written(inside)
        if alive.isEmpty():
            return done
        colour = written(alive.select("node", F.col("node").alias("c")))
        while True:
            pushed = edges.join(colour, edges["a"] == colour["node"]).select(F.col("b").alias("node"), "c")
            new = written(colour.union(pushed).groupBy("node").agg(F.max("c").alias("c")))
            if new.exceptAll(colour).isEmpty():
                break
            colour = new
        found = written(colour.filter("node = c"))
        while True:  # backwards from each colour's root
            back = edges.join(found.select(F.col("node").alias("b"), "c"), "b").select(F.col("a").alias("node"), "c").join(colour, ["node", "c"], "left_semi")
            new = written(found.union(back).distinct())
            if new.count() == found.count():
                break
            found = new
        low = found.groupBy("c").agg(F.min("node").alias("component"))
        done = written(done.union(found.join(low, "c").select("node", "component")))
        alive = written(alive.join(found.select("node"), "node", "left_anti"))
        edges = written(edges.join(alive.select(F.col("node").alias("a")), "a", "left_semi").join(alive.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b"))
