"""Connected components of an edge table by alternating large-star and small-star rounds.

(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014.)  Every round is two
aggregations and joins over the edges; nothing but the count of changes reaches the driver.  The
edges of a star's centre, which may be a third of all, are dealt to many tasks before the joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.shared import spread_join, stored


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges of longs, a != b -> (node, root): root is the smallest node reachable; roots themselves are left out.

    Goes on until a large-star and a small-star round leave the edges unchanged, which are then stars;
    that takes about as many rounds as the logarithm of the nodes.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        seen = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if seen == before or not seen[0]:
            break
        before = seen
        # Large star: each node links its larger neighbours to its smallest neighbour or itself.
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = spread_join(both.where("b > a"), least, "a", "b", rows=seen[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: each node links itself and its smaller neighbours to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = spread_join(large, least, "a", "b", rows=seen[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        now = stored(small.where("a != b").distinct(), "edges")
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
