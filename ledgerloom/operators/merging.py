"""Sessions that turn out to be one: chains of merges flattened, and all that hangs on the donors moved to the recipient (GR-5, JN-15)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.sources.scratch import kept

#: A chain of 2 ** 40 merges isn't met; more rounds mean that the merges run in a circle.
MOST_ROUNDS = 40


def flattened(merges: DataFrame) -> DataFrame:
    """donor, canonical of merges (donor, recipient): the end of each donor's chain.

    Every round doubles how far a donor looks, so a chain of n merges takes log n rounds, each a join. A donor that is
    named with several recipients goes to the smallest of them; merges that run in a circle are an error.
    """
    at = kept(merges.filter("donor <> recipient").groupBy("donor").agg(F.min("recipient").alias("canonical")), "merges")
    for _ in range(MOST_ROUNDS):
        on = at.select(F.col("donor").alias("_d"), F.col("canonical").alias("_c"))
        nxt = at.join(on, F.col("canonical") == F.col("_d"), "left").select("donor", F.coalesce("_c", "canonical").alias("canonical"), F.col("_c").isNotNull().alias("_moved"))
        nxt = kept(nxt, "merges")
        if not nxt.filter("_moved").head(1):
            return nxt.drop("_moved")
        if nxt.filter("donor = canonical").head(1):
            break
        at = nxt.drop("_moved")
    raise ValueError("merges run in a circle")


def moved(rows: DataFrame, column: str, to: DataFrame, old: str = "donor", new: str = "canonical") -> DataFrame:
    """rows with `column` replaced by what `to` (old, new) says of it."""
    m = to.select(F.col(old).alias("_old"), F.col(new).alias("_new"))
    return rows.join(m, F.col(column) == F.col("_old"), "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")


@dataclass
class Merged:
    sessions: DataFrame
    prompts: DataFrame
    occurrences: DataFrame
    edges: DataFrame
    supports: DataFrame
    aliases: DataFrame


def merge_sessions(merges: DataFrame, sessions: DataFrame, prompts: DataFrame, occurrences: DataFrame, edges: DataFrame, supports: DataFrame, aliases: DataFrame) -> Merged:
    """Everything after the merges (donor, recipient).

    sessions (session_id, first_ts, last_ts and more): donors are gone; times span all that were merged, of other
    columns the recipient's value counts, else the smallest donor's that has one. prompts (prompt_id, session_id,
    logical_key): a donor's prompt moves, unless the recipient has one of that key (of several donors' the first one
    stays), where it becomes an alias of it and its occurrences (prompt_id, location_id) move there, each once. edges
    (child, parent, kind) and supports (child, parent, kind, location_id) are rehomed, each once; a session is never its
    own parent. aliases (alias, canonical, kind): what stood for a donor stands for the recipient now.
    """
    to = flattened(merges.join(sessions.select(F.col("session_id").alias("donor")), "donor", "left_semi"))
    own = sessions.join(to, F.col("session_id") == F.col("donor"), "left").withColumn("_at", F.coalesce("canonical", "session_id"))
    order = F.struct(F.col("donor").isNotNull().alias("donated"), F.col("session_id").alias("id"))
    rest = [c for c in sessions.columns if c not in ("session_id", "first_ts", "last_ts")]
    whole = own.groupBy(F.col("_at").alias("session_id")).agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), *[F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in rest])

    placed = moved(prompts.withColumn("_was", F.col("session_id")), "session_id", to)
    first = Window.partitionBy("session_id", "logical_key").orderBy(F.col("_was") != F.col("session_id"), "_was", "prompt_id")
    # only sessions that merged are compared, and in them prompts of one key
    met = placed.join(to.select(F.col("canonical").alias("session_id")).distinct(), "session_id", "left_semi").withColumn("_first", F.first("prompt_id").over(first))
    same = kept(met.filter(F.col("prompt_id") != F.col("_first")).select(F.col("prompt_id").alias("donor"), F.col("_first").alias("canonical")), "merged-prompts")
    stay = placed.join(same.select(F.col("donor").alias("prompt_id")), "prompt_id", "left_anti").drop("_was")
    held = moved(occurrences, "prompt_id", same).dropDuplicates(["prompt_id", "location_id"])

    def rehomed(rows: DataFrame) -> DataFrame:
        return moved(moved(rows, "child", to), "parent", to).filter("child <> parent").distinct()

    fresh = to.select(F.col("donor").alias("alias"), "canonical", F.lit("session").alias("kind")).unionByName(same.select(F.col("donor").alias("alias"), "canonical", F.lit("prompt").alias("kind")))
    known = aliases.join(fresh.select(F.col("alias").alias("_a"), F.col("canonical").alias("_c"), F.col("kind").alias("_k")), (F.col("canonical") == F.col("_a")) & (F.col("kind") == F.col("_k")), "left")
    known = known.select("alias", F.coalesce("_c", "canonical").alias("canonical"), "kind").join(fresh.select("alias", "kind"), ["alias", "kind"], "left_anti").select(*fresh.columns)
    return Merged(whole.select(*sessions.columns), stay.select(*prompts.columns), held.select(*occurrences.columns), rehomed(edges), rehomed(supports), known.unionByName(fresh))
