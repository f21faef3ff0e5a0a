"""Connected components by contraction, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import materialize


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, comp) for every node of links (a, b): comp is the same for all nodes of a component.

    Each round maps a node to the least of itself and its neighbours, and goes on with the links between the images
    that are still apart. A star vanishes in one round, a path of n nodes in about log n. Each round's map is written
    out; the maps are joined backwards at the end. Nothing but row counts reaches the driver.
    """
    edges = materialize(links.where("a <> b").select("a", "b").distinct(), "cc-edges")
    maps = []
    for _ in range(max_rounds):
        if edges.isEmpty():
            break
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select(F.col("b"), F.col("a")))
        least = materialize(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("comp")), "cc-map")
        maps.append(least)
        edges = materialize(
            edges.join(least.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a")
            .join(least.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b")
            .where("ca <> cb")
            .select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"))
            .distinct(),
            "cc-edges",
        )
    else:
        raise RuntimeError(f"components need more than {max_rounds} rounds")
    if not maps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("comp")).limit(0)
    out = maps[0]
    for later in maps[1:]:
        out = out.join(later.select(F.col("node").alias("comp"), F.col("comp").alias("next")), "comp", "left").select("node", F.coalesce("next", "comp").alias("comp"))
    return materialize(out, "cc") if len(maps) > 1 else out
