"""Connected components of a link table, by rewiring every node towards its smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import stage


def _rewire(edges: DataFrame, downwards: bool) -> DataFrame:
    """One star step over distinct edges (a > b).

    Upwards: the larger neighbours of a node go to its smallest neighbour.  Downwards: a node and
    its smaller neighbours do.  Minima are partial aggregates, so a hub is one row per task."""
    flipped = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    near = edges if downwards else edges.unionByName(flipped)
    least = near.groupBy("a").agg(F.min("b").alias("m"))
    if downwards:
        moved = near.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
    else:
        least = least.select("a", F.least("a", "m").alias("m"))
        moved = near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of links (a, b).

    Both steps together shorten all paths by a constant factor, so the number of rounds is
    logarithmic in the longest; they end when a round changes nothing.  Each round is a written
    table in the shared folder.  Null ends and loops are ignored."""
    pairs = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = stage(pairs.where("a > b").distinct(), "links")
    state = None
    while True:
        # equal sums of two hashes and equal counts: the round changed nothing
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if now == state or not now[0]:
            break
        state = now
        edges = stage(_rewire(_rewire(edges, False), True), "links")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
