"""Connected components of a link table by alternating large and small stars, each round a few shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialise


def _star(directed: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every neighbour of a node, and the smallest of the node's neighbours and itself (a map-side minimum, then a join that skew handling can split)."""
    least = candidates.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return directed.join(least, "u")


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links (u, v): node -> root, the smallest node reachable. Nodes without a link are absent; self links are ignored.

    Nulls and repeated links are dropped. An empty table gives an empty result.
    """
    edges = materialise(
        links.filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc"
    )
    last = None
    for _ in range(rounds):
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or tuple(state) == last:
            break
        last = tuple(state)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the larger neighbours of a node: each link once, from its smaller end
        upward = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        large = _star(upward, both).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialise(large, "cc-large")
        starred = _star(large, large)
        small = starred.select(F.col("v").alias("u"), F.col("m").alias("v")).union(starred.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = materialise(small, "cc-small")
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def joined_components(root: DataFrame, links: DataFrame) -> DataFrame:
    """root (node, root) of connected_components with more links (u, v): the components of all links.

    The links are taken between the roots, so what is joined already isn't walked again: a round costs what is new. Each
    root is the smallest node of its group, and so is the smallest of the roots that the links join.
    """
    met = links.join(root.toDF("u", "ru"), "u", "left").join(root.toDF("v", "rv"), "v", "left")
    top = materialise(connected_components(met.select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"))), "cc-joined")
    old = root.join(top.toDF("root", "top"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return old.unionByName(top.join(root, "node", "left_anti"))
