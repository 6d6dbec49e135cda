"""Backups: tables written under a stamp, the newest few kept (SRC-21, AGG-45)."""

from __future__ import annotations

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.sources.tail import file_system


def backup(tables: dict[str, DataFrame], root: str, stamp: str, keep: int) -> list[str]:
    """Writes every table below root/stamp, and when all are whole removes the backups beyond the newest `keep`; the stamps that were removed. Stamps sort by age; one without its mark isn't whole and doesn't count."""
    if keep < 1:
        raise ValueError("at least one backup is kept")
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/{stamp}/{name}")
    fs, folder = file_system(root)
    with fs.open_output_stream(f"{folder}/{stamp}/complete") as f:
        f.write(",".join(sorted(tables)).encode())
    gone = stamps(root)[:-keep]
    for old in gone:
        fs.delete_dir(f"{folder}/{old}")
    return gone


def stamps(root: str) -> list[str]:
    """Stamps of the whole backups, oldest first."""
    fs, folder = file_system(root)
    found = fs.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == pyarrow.fs.FileType.Directory and fs.get_file_info(f"{f.path}/complete").is_file)


def statistics(root: str) -> dict:
    """How many backups there are, their bytes, and the newest one's stamp."""
    fs, folder = file_system(root)
    found = stamps(root)
    size = sum(f.size or 0 for s in found for f in fs.get_file_info(pyarrow.fs.FileSelector(f"{folder}/{s}", recursive=True)) if f.is_file)
    return {"count": len(found), "bytes": size, "newest": found[-1] if found else None}


def restored(spark: SparkSession, root: str, name: str, stamp: str | None = None) -> DataFrame:
    """A table of a backup, the newest unless one is named."""
    stamp = stamp or (stamps(root) or [None])[-1]
    if stamp is None:
        raise LookupError("there is no whole backup")
    return spark.read.parquet(f"{root}/{stamp}/{name}")
