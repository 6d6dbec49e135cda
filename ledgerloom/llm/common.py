"""Helpers that the training-data operators share: tables, scratch tables, batch sizes and gapless numbering."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.sources.scratch import scratch_root

TEXT_BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared scratch folder and read it back: lineage ends there and a lost executor costs nothing."""
    path = f"{scratch_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = TEXT_BATCH_ROWS) -> None:
    """Bound what one Arrow batch of whole texts can hold in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def number_rows(df: DataFrame, order: list[str], group: str | None = None, name: str = "slot", label: str = "numbered") -> DataFrame:
    """Gapless numbers from 0 in the order given, for all rows or within each value of `group` (few values, no nulls).

    One range shuffle deals the rows out evenly however large a group is; each partition numbers its own rows,
    and the offset of a partition is a running sum over one row per (partition, group).
    """
    keys = ([group] if group else []) + order
    dealt = df.repartitionByRange(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    placed = materialise(dealt.withColumn("_at", at), label)
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    by = ["_part"] + ([group] if group else [])
    ends = placed.groupBy(*by).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    # one row per (partition, group): bounded by partitions times groups, whatever the number of rows
    before = (Window.partitionBy(group) if group else Window).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.select(*by, (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return placed.join(F.broadcast(offsets), by).withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def without(docs: DataFrame, rejected: DataFrame, doc_id: str = "doc_id", text: str = "text", broadcast_rows: int = 1_000_000) -> DataFrame:
    """docs less the rows whose id and text hash are in `rejected` (doc_id, text_hash). Broadcast only if those are counted and few; else texts and ids meet in a shuffle."""
    keys = rejected.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    keys = F.broadcast(keys) if keys.count() <= broadcast_rows else keys
    return docs.join(keys, docs[doc_id].cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(docs[text]) == F.col("_hash")), "left_anti")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
