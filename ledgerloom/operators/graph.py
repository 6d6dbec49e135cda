"""The graph of sessions: edges, late parents, trees, merged identities (GR-1..5, JN-6, JN-9, JN-15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.sources.scratch import kept

MOST_DEPTH = 16


def edges(sessions: DataFrame) -> DataFrame:
    """child, parent_native, kind: subagent and fork edges that sessions name (GR-1)."""
    sub = sessions.filter("thread_kind = 'subagent' and coalesce(parent_native, '') <> ''").select(F.col("session_id").alias("child"), F.col("parent_native").alias("parent_native"), F.lit("subagent").alias("kind"))
    fork = sessions.filter("coalesce(forked_from, '') <> ''").select(F.col("session_id").alias("child"), F.col("forked_from").alias("parent_native"), F.lit("fork").alias("kind"))
    return sub.unionByName(fork).distinct()


def resolve(edges_: DataFrame, sessions: DataFrame) -> DataFrame:
    """Edges with the parent's id: of equal native ids of the provider the lowest, never the child itself; null while the parent is unknown (JN-6, JN-9, GR-3)."""
    s = sessions.select(F.col("session_id").alias("parent"), F.col("provider").alias("_p"), F.col("native_id").alias("_n"))
    child = sessions.select(F.col("session_id").alias("child"), "provider")
    e = edges_.join(child, "child")
    met = e.join(s, (F.col("provider") == F.col("_p")) & (F.col("parent_native") == F.col("_n")) & (F.col("child") != F.col("parent")), "left")
    return met.groupBy("child", "kind", "parent_native").agg(F.min("parent").alias("parent"))


def tree(links: DataFrame, roots: DataFrame, order: Column, depth: int = MOST_DEPTH) -> DataFrame:
    """node, root, depth, path of everything below the roots, in preorder by path (GR-4).

    links (parent, child) with an order key for siblings. Each round doubles how far down is known: paths of 1, 2, 4, ...
    steps are joined with themselves and with what is reached, so depth 16 takes five rounds; each is a table in the
    scratch folder. A node that is on its own path already ends there.
    """
    key = F.struct(order.alias("k"), F.col("child").alias("c"))
    jump = links.select(F.col("parent").alias("from"), F.col("child").alias("to"), F.array("child").alias("steps"), F.array(key).alias("keys")).filter("from <> to")
    kind = jump.schema["keys"].dataType.elementType["k"].dataType
    out = roots.select("node", F.col("node").alias("root"), F.lit(0).alias("depth"), F.array("node").alias("seen"), F.array(F.struct(F.lit(None).cast(kind).alias("k"), F.col("node").alias("c"))).alias("path"))
    length = 1
    while length <= depth:
        jump = kept(jump, "jumps")
        if not jump.head(1):
            break
        further = out.filter(F.col("depth") + length <= depth).join(jump, F.col("node") == F.col("from")).filter(~F.arrays_overlap("seen", "steps"))
        further = further.select(F.col("to").alias("node"), "root", (F.col("depth") + length).alias("depth"), F.concat("seen", "steps").alias("seen"), F.concat("path", "keys").alias("path"))
        out = kept(out.unionByName(further), "reached")
        on = jump.select(F.col("from").alias("_at"), F.col("to").alias("_to"), F.col("steps").alias("_steps"), F.col("keys").alias("_keys"))
        joined = jump.join(on, F.col("to") == F.col("_at")).filter(~F.arrays_overlap("steps", "_steps") & ~F.array_contains("_steps", F.col("from")))
        jump = joined.select("from", F.col("_to").alias("to"), F.concat("steps", "_steps").alias("steps"), F.concat("keys", "_keys").alias("keys"))
        length *= 2
    return out


def preorder(nodes: DataFrame, root: str = "root") -> DataFrame:
    """place of every node in its root's preorder, from 0.

    One range shuffle deals the nodes out however large a tree is; a partition numbers its own, and what stands before
    them in their tree is a running sum over a row for each partition and tree.
    """
    at = F.monotonically_increasing_id()
    dealt = nodes.repartitionByRange(root, "path").sortWithinPartitions(root, "path").withColumn("_at", at).withColumn("_part", F.shiftright("_at", 33))
    dealt = kept(dealt, "preorder")  # numbered once and for all
    ends = dealt.groupBy(root, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(root).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(root, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return dealt.join(ends, [root, "_part"]).withColumn("place", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def canonical_ids(ids: DataFrame, aliases: DataFrame) -> DataFrame:
    """ids with canonical: the id that a retired one stands for, else itself (JN-15)."""
    a = aliases.select(F.col("alias").alias("_a"), F.col("canonical").alias("_c"))
    return ids.join(a, F.col("id") == F.col("_a"), "left").withColumn("canonical", F.coalesce("_c", "id")).drop("_a", "_c")


def unsupported(edges_: DataFrame, supports: DataFrame, key: list[str]) -> DataFrame:
    """Edges that no source supports any more (JN-4)."""
    return edges_.join(supports.select(*key), key, "left_anti")


def supported(edges_: DataFrame, supports: DataFrame, key: list[str]) -> DataFrame:
    """Edges that some source still supports (GR-2)."""
    return edges_.join(supports.select(*key), key, "left_semi")
