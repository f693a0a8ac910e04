"""Connected components of an edge table, by alternating star contractions.

Each round makes every node's larger neighbours point to its smallest neighbour, then every node and its smaller neighbours to the smallest
of those, until the edges are stars. Minima come from partial sums and meet the edges in joins that adaptive execution splits, so a hub
with a third of all edges never gathers in one task. Each round is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def _hooked(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with m: the smallest of u's neighbours v and u itself."""
    least = C.staged(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return pairs.join(least.hint("merge"), "u")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge between two nodes: root is the smallest node of its component. Null ends and loops are
    ignored; repeated edges count once; no edges give no rows."""
    own = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    own, before = C.staged(own.distinct(), "edges"), None
    while True:
        both = own.unionByName(own.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hooked(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = C.staged(large, "large")
        hooked = _hooked(large)
        small = hooked.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        own = C.staged(small.filter("u != v").distinct(), "edges")
        now = own.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if now == before:
            break
        before = now
    roots = own.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return own.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
