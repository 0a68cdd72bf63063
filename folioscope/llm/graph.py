"""Connected components of an edge table, without gathering any node's neighbours in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import materialise


#: Edges from which a node is hot, and hot nodes that may be sent to all tasks.
MANY_EDGES, BROADCAST_ROWS = 100, 500_000


def _joined(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges with their u's row of least (u, m, n edges). Nodes of many edges are few: they are sent to
    their edges, wherever these are, so no task gets all edges of one node."""
    hot = least.filter(F.col("n") >= MANY_EDGES)
    if hot.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return edges.join(least, "u").select("u", "v", "m")
    hot, cold = F.broadcast(hot), least.filter(F.col("n") < MANY_EDGES)
    out = edges.join(hot, "u").select("u", "v", "m")
    return out.unionByName(edges.join(hot, "u", "left_anti").join(cold, "u").select("u", "v", "m"))


def components(edges: DataFrame) -> DataFrame:
    """(a long, b long) edges -> (node, root): every node that has an edge, and the least of its component.

    Large-star and small-star steps in turn until nothing changes. A step takes minima by key,
    which are pre-aggregated before they are shuffled, and joins them back; joins split hot keys.
    Each round is written to the shared folder, so lost executors cost one round at most.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = materialise(now, "components"), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            # one frame, not a union of scans and sums, whose tasks would be of very different sizes
            both = F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("root")), F.struct(F.col("v").alias("node"), F.col("v").alias("root")))
            return now.select(F.explode(both).alias("n")).select("n.node", "n.root").distinct()
        before = state
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        least = materialise(least, "least-neighbours")
        large = _joined(both, least).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialise(small.union(low.select("u", "m")).distinct(), "components")
