"""Connected components of an edge table, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.llm.store import materialize, release


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of one orderable type -> (node, label): the least node that can be reached.

    Each round takes every node to the least of itself and its neighbours and keeps the edges between what is left;
    a component's least node stays where it is, so in the end all of it is there.  Stars are gone after one or two
    rounds, and where the order of names has nothing to do with the edges the rest shrinks by a
    constant factor each round; a round is a map-side combined minimum and two joins that Spark splits where
    they are skewed.  The rounds' maps are put together from the last, which is the smallest, to the first.
    Null ends are ignored, self-loops give a node of its own, repeated edges change nothing,
    and no edges give no rows.
    """
    left = edges.select("a", "b").where("a is not null and b is not null")
    maps: list[DataFrame] = []
    while True:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        maps.append(materialize(least.select("node", F.least("node", "low").alias("label")), "labels", few=True))
        to = maps[-1]
        moved = left
        for end in "ab":
            moved = moved.join(to.select(F.col("node").alias(end), F.col("label").alias(f"to_{end}")), end)
        moved = moved.where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()
        moved = materialize(moved, "edges", few=True)
        if len(maps) > 1:
            release(left)
        left = moved
        if left.isEmpty():
            release(left)
            break
    labels = maps.pop()
    while maps:
        first = maps.pop()
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        joined = materialize(first.join(far, "label", "left").select("node", F.coalesce("far", "label").alias("label")), "labels", few=True)
        release(first, labels)
        labels = joined
    return labels
