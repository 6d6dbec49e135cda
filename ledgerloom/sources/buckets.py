"""Tables of which only parts are written: buckets by hash of a key, and a manifest for each generation (ING-18, DML-1, DML-6, STR-6).

A generation's manifest names for each bucket the version that holds it; a run writes the buckets that its changes fall
in, under a version of their own, and then the next manifest. Nothing that a manifest names is ever changed, so a run
that fails leaves the last generation, and what it has written is named by none.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
MANIFEST = "bucket int, version string"


def bucket_of(*keys: str | Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def manifest(spark: SparkSession, root: str, generation: int) -> dict[int, str]:
    """bucket -> version; no more rows than buckets."""
    return {r["bucket"]: r["version"] for r in spark.read.schema(MANIFEST).parquet(f"{root}/manifest/{generation}").collect()} if generation else {}


def read(spark: SparkSession, root: str, generation: int, schema: str, only: list[int] | None = None) -> DataFrame:
    """The rows of a generation (of some buckets), from the folders that its manifest names."""
    held = manifest(spark, root, generation)
    paths = [f"{root}/version={v}/bucket={b}" for b, v in sorted(held.items()) if only is None or b in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def touched(keys: DataFrame, *columns: str, buckets: int = BUCKETS) -> list[int]:
    """The buckets in which these keys fall: a list no longer than the number of buckets."""
    return sorted(r["b"] for r in keys.select(bucket_of(*columns, buckets=buckets).alias("b")).distinct().collect())


def replace(root: str, generation: int, parts: list[int], rows: DataFrame, *columns: str, buckets: int = BUCKETS) -> int:
    """The next generation: `rows` are all that the buckets `parts` hold from now on; a bucket without rows is named no more."""
    spark, version = rows.sparkSession, uuid.uuid4().hex
    held = {b: v for b, v in manifest(spark, root, generation).items() if b not in parts}
    if parts:
        made = rows.withColumn("bucket", bucket_of(*columns, buckets=buckets))
        made.repartition("bucket").write.partitionBy("bucket").parquet(f"{root}/version={version}")
        written = spark.read.schema(f"{rows.schema[0].name} {rows.schema[0].dataType.simpleString()}, bucket int").parquet(f"{root}/version={version}")
        held |= {r["bucket"]: version for r in written.select("bucket").distinct().collect()}
    spark.createDataFrame(sorted(held.items()), MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/{generation + 1}")
    return generation + 1


def add_counts(spark: SparkSession, root: str, generation: int, changes: DataFrame, group: list[str], kinds: str, buckets: int = BUCKETS) -> int:
    """The next generation of stored counts (group, n), from signed changes (group, delta): only the buckets of changed groups are read and written; a group of none is no row (DML-6, SMP-7).

    kinds: the group's columns as DDL. A null in a group is a value like any other.
    """
    changes = changes.groupBy(*group).agg(F.sum("delta").cast("long").alias("n")).filter("n <> 0")
    parts = touched(changes, *group, buckets=buckets)
    if not parts:
        return replace(root, generation, [], changes, *group, buckets=buckets)
    stored = read(spark, root, generation, f"{kinds}, n long", parts)
    rows = stored.unionByName(changes.select(*group, "n")).groupBy(*group).agg(F.sum("n").alias("n")).filter("n <> 0")
    return replace(root, generation, parts, rows, *group, buckets=buckets)


def signed_changes(before: DataFrame, after: DataFrame, key: str, group: list[str]) -> DataFrame:
    """(group, delta): what rows that came, went or changed their group add to its count; rows that stay as they are cancel out in the join and don't move on."""
    a = before.select(F.col(key).alias("_a"), F.struct(*group).alias("_old"))
    b = after.select(F.col(key).alias("_b"), F.struct(*group).alias("_new"))
    both = a.join(b, F.col("_a") == F.col("_b"), "full_outer").filter(~F.col("_old").eqNullSafe(F.col("_new")))
    sides = F.array(F.struct(F.col("_old").alias("g"), F.lit(-1).alias("delta")), F.struct(F.col("_new").alias("g"), F.lit(1).alias("delta")))
    # a side that a full join has no row for is null as a whole
    sides = F.filter(sides, lambda s: s["g"].isNotNull())
    return both.select(F.explode(sides).alias("s")).select("s.g.*", F.col("s.delta").cast("long").alias("delta"))
