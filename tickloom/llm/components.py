"""Connected components of an edge table by alternating star contractions (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickloom.llm.shared import release, save


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("least"))
    return both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("least").alias("dst"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them; edges come as src > dst."""
    least = edges.groupBy("src").agg(F.min("dst").alias("least"))
    joined = edges.join(least, "src").where("dst <> least").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    return joined.unionByName(least.select("src", F.col("least").alias("dst")))


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(src, dst)``; ``root`` is the smallest node reachable.

    Nodes are longs without nulls; loops and repeated edges may occur. A hub never meets in one row:
    each step joins the edges with one pre-aggregated minimum per node, and every round is a table
    in the shared folder.
    """
    table = save(
        edges.where("src <> dst")
        .select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        .distinct(),
        "edges",
    )
    state = _fingerprint(table)
    while state[0]:
        after = save(_small_star(_large_star(table).where("src <> dst").distinct()).where("src <> dst").distinct(), "edges")
        release(table)
        table, before, state = after, state, _fingerprint(after)
        if before == state:
            break
    roots = table.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct()
    return table.select(F.col("src").alias("node"), F.col("dst").alias("root")).unionByName(roots)


def _fingerprint(table: DataFrame) -> tuple:
    return tuple(table.agg(F.count("*"), F.bit_xor(F.xxhash64("src", "dst")), F.bit_xor(F.xxhash64("dst"))).first())
