"""Connected components of an undirected graph, for any number of nodes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import checkpointed


#: Different edges up to which one task finds the components, at about a hundred bytes each.
IN_ONE_TASK = 200_000


def _in_one_task(pairs: DataFrame) -> DataFrame:
    kind = pairs.schema["u"].dataType.simpleString()

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        parent: dict = {}

        def root(x):
            top = x
            while parent.setdefault(top, top) != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for u, v in zip(pdf["u"], pdf["v"], strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        return pd.DataFrame({"node": list(parent), "label": [root(x) for x in parent]})

    return pairs.groupBy(F.lit(1).alias("all")).applyInPandas(kernel, f"node {kind}, label {kind}")


def connected(edges: DataFrame, one_task: int | None = None) -> DataFrame:
    """``node, label`` with the smallest node of each connected component. ``edges``: ``u, v`` of one comparable type.

    The different edges are counted; up to ``one_task`` (IN_ONE_TASK) they are one task's work. Beyond that large-star and
    small-star steps take turns until nothing changes; each round is checkpointed, so executors may be lost. Neighbour lists
    are never collected: a step takes the minimum per node, then joins. Both give the same labels.

    Defined cases: loops and repeated edges do not matter; nodes without edges have no row; no edges give no rows.
    """
    pairs = checkpointed(
        edges.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    # how many edges, and the sum of their hashes: equal ones are the same edges
    digest = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    now = digest(pairs)
    if now["n"] <= (IN_ONE_TASK if one_task is None else one_task):
        return _in_one_task(pairs)
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        small = small.select("u", F.col("m").alias("v")).union(
            small.where(F.col("v") != F.col("m")).select("v", "m")
        )
        after = checkpointed(small.where(F.col("u") != F.col("v")).distinct())
        before, now, pairs = now, digest(after), after
        if now == before:
            break
    return pairs.union(pairs.select(F.col("v").alias("u"), "v")).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))
