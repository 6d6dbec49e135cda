"""Tables in the order of their page or sample keys, of which a page or a walk reads only the files that it stands in (SRT-4..8, SMP-1, SMP-2).

The rows are dealt out by range of the keys and sorted, and an index says of each file what keys it holds and how many
rows. A page finds its files in the index, from the seek on until they hold enough rows, and reads those alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators.pagination import after, encode_cursor
from ledgerloom.operators.sampling import keyed, pivot

#: Rows of a file, about.
FILE_ROWS = 200_000
#: Ranges that the rows are dealt to, at most: a range is written as files of `file_rows`, so that what the driver samples and collects doesn't grow with the files.
MOST_RANGES = 200


def write(rows: DataFrame, keys: list[tuple[str, bool]], path: str, file_rows: int = FILE_ROWS) -> None:
    """rows in the order of keys (column, descending; nulls last), and the index of the files. The keys name each row."""
    counted = rows.count()
    order = [F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in keys]
    dealt = rows.repartitionByRange(min(MOST_RANGES, max(1, -(-counted // file_rows))), *order).sortWithinPartitions(*order)
    dealt.write.option("maxRecordsPerFile", file_rows).mode("overwrite").parquet(f"{path}/rows")
    at = F.struct(*[c for c, _ in keys])
    held = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows").select(F.col("_metadata.file_path").alias("file"), at.alias("at"), F.col("_metadata.row_index").alias("_p"))
    # a file is sorted: its first and last rows are those of the keys' order
    ends = held.groupBy("file").agg(F.min_by("at", "_p").alias("first"), F.max_by("at", "_p").alias("last"), F.count(F.lit(1)).alias("rows"))
    ends.write.mode("overwrite").parquet(f"{path}/files")


@dataclass
class Sorted:
    """A table of `write`, opened; `opened` lists the files that pages have read."""

    spark: SparkSession
    path: str
    keys: list[tuple[str, bool]]
    opened: list[str]

    def _order(self, inside: str | None = None) -> list[Column]:
        name = (lambda c: f"{inside}.{c}") if inside else (lambda c: c)
        return [F.desc_nulls_last(name(c)) if down else F.asc_nulls_last(name(c)) for c, down in self.keys]

    def page(self, size: int, last: list[Any] | None = None, stop: Column | None = None) -> DataFrame:
        """`size` rows and one to look ahead, past `last` (see pagination.page), in order; `stop`: rows that don't count any more, all of them at the end."""
        if not 1 <= size <= 500:
            raise ValueError("a page has 1 to 500 rows")
        index = self.spark.read.parquet(f"{self.path}/files")
        ends = index.select("file", "rows", "first", "last.*")
        beyond = ends.filter(after(self.keys, last)) if last is not None else ends
        # the first file may hold little beyond the seek; each of the others is there whole, and none is empty
        near = [(r["file"], r["rows"]) for r in beyond.orderBy(*self._order("first")).select("file", "rows").limit(size + 2).collect()]
        taken, rows = [], 0
        for k, (file, n) in enumerate(near):
            taken.append(file)
            rows += n if k or last is None else 1
            if rows > size:
                break
        schema = self.spark.read.parquet(f"{self.path}/rows").schema
        self.opened += taken
        found = self.spark.read.schema(schema).parquet(*taken) if taken else self.spark.createDataFrame([], schema)
        found = found.filter(after(self.keys, last)) if last is not None else found
        return (found.filter(~stop) if stop is not None else found).orderBy(*self._order()).limit(size + 1)


def open_sorted(spark: SparkSession, path: str, keys: list[tuple[str, bool]]) -> Sorted:
    return Sorted(spark, path, keys, [])


def paged(spark: SparkSession, path: str, keys: list[tuple[str, bool]], size: int, filters: str, generation: int) -> DataFrame:
    """All rows of a table of `write` with their page (from 0) and `cursor`, the one that leads to that page (null: the first): what a walk from page to page gives.

    A row's place is the rows of the files before its own, summed over the index, and its place in its file. So all
    pages are found in one pass, and only each page's last row becomes a cursor.
    """
    table = open_sorted(spark, path, keys)
    index = spark.read.parquet(f"{path}/files")
    # a row for each file of the index
    before = F.coalesce(F.sum("rows").over(Window.orderBy(*table._order("first")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = index.select("file", before.alias("_before"))
    rows = spark.read.parquet(f"{path}/rows")
    names = rows.columns
    placed = rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("_at")).join(F.broadcast(starts), "file")
    placed = placed.withColumn("_slot", F.col("_before") + F.col("_at"))
    page = F.call_function("div", F.col("_slot"), F.lit(size).cast("long"))

    @F.udf("string")
    def cursor(last) -> str:
        return encode_cursor(list(last), filters, generation)

    ends = placed.filter(F.col("_slot") % size == size - 1).select((page + 1).alias("page"), cursor(F.struct(*[c for c, _ in keys])).alias("cursor"))
    return placed.select(*names, page.alias("page")).join(ends, "page", "left").select(*names, "page", "cursor")


def write_sampled(units: DataFrame, unit_id: str, path: str, file_rows: int = FILE_ROWS) -> None:
    """Units in the order of their sample keys."""
    write(keyed(units, unit_id), [("sample_key", False), (unit_id, False)], path, file_rows)


def walk(spark: SparkSession, path: str, unit_id: str, count: int, seed: str) -> tuple[DataFrame, list[str]]:
    """sampling.random_sample from a table of write_sampled, and the files that it read: from the seed's key up, then from the lowest."""
    table = open_sorted(spark, path, [("sample_key", False), (unit_id, False)])
    at = pivot(seed)
    # no id stands before the least of its key: the seek is to the key alone
    index = spark.read.parquet(f"{path}/files").select("file", "rows", "first.sample_key", F.col("last.sample_key").alias("_last"))
    taken, rows = [], 0
    for part in (index.filter(F.col("_last") >= at), index.filter(F.col("sample_key") < at)):
        for k, r in enumerate(part.orderBy("sample_key", "_last").limit(count + 1).collect()):
            if rows >= count:
                break
            taken += [r["file"]] if r["file"] not in taken else []
            rows += r["rows"] if k else 0  # of the first file it isn't known how much lies on this side
    schema = spark.read.parquet(f"{path}/rows").schema
    found = spark.read.schema(schema).parquet(*taken) if taken else spark.createDataFrame([], schema)
    table.opened += taken
    return found.orderBy(F.col("sample_key") < at, "sample_key", unit_id).limit(count), table.opened
