"""Keyed tables: last write wins, change detection, merge and cascading deletes as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key: that with the greatest order. Planned with a window group limit, so each task forwards one row a key."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def changed(current: DataFrame, stored: DataFrame, path: str = "path", hash_: str = "hash", force: bool = False) -> DataFrame:
    """Rows whose (path, hash) isn't stored; all with force."""
    return current if force else current.join(stored.select(path, hash_), [path, hash_], "left_anti")


def merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace the old ones of their keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def delete_where(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def delete_of_files(entries: DataFrame, symbols: DataFrame, sections: DataFrame, files: DataFrame, key: str = "entity_id") -> DataFrame:
    """Index entries without those of any symbol or section of the given files."""
    ids = symbols.join(files, "file_path", "left_semi").select(F.col("id").alias(key)).union(sections.join(files, "file_path", "left_semi").select(F.col("id").alias(key)))
    return entries.join(ids.distinct(), key, "left_anti")


def pruned(stored: DataFrame, current: DataFrame, path: str = "path") -> DataFrame:
    """Stored rows whose path is still listed."""
    return stored.join(current.select(path), path, "left_semi")
