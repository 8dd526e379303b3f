"""Connected components by repeated contraction.

In each round every node points at its smallest neighbour (or itself), pointers are
followed to their roots by doubling, and edges are rewritten between roots.  Each round
at least halves the nodes that still have edges, whatever the shape of the graph; a hot
node is only ever aggregated, never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.plans.durable import durable


def _as_step(root: DataFrame) -> DataFrame:
    return root.select(F.col("node").alias("root"), F.col("root").alias("next"))


def _follow(root: DataFrame, by: DataFrame) -> DataFrame:
    """Pointers ``root`` followed by those of ``by``."""
    return root.join(_as_step(by), "root", "left").select("node", F.coalesce("next", "root").alias("root"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of ``edges``; a component is named by its smallest node.

    Self loops name a node without linking it; null ends are ignored.
    """
    half = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    half = durable(half.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "cc-edges")
    labels = None
    while True:
        both = half.unionByName(half.select(F.col("v").alias("u"), F.col("u").alias("v")))
        root = durable(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low")).select("node", F.least("node", "low").alias("root")), "cc-point")
        while True:
            # four steps up and a look at the fifth, in one plan
            root = durable(_follow(_follow(root, root), _follow(root, root)), "cc-jump")
            if not root.join(_as_step(root), "root").where("next <> root").limit(1).count():
                break
        if labels is None:
            labels = root
        else:
            labels = durable(_follow(labels, root), "cc-labels")
        to = lambda a, b: root.select(F.col("node").alias(a), F.col("root").alias(b))
        half = half.join(to("u", "ru"), "u").join(to("v", "rv"), "v").where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct()
        half = durable(half, "cc-edges")
        if half.limit(1).count() == 0:
            return labels.select("node", F.col("root").alias("component"))
