"""Incremental tables: last-wins writes, upserts with change detection, staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_wins(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first in the given order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: str, text: str, embedding: str) -> DataFrame:
    """New rows over old ones; the old embedding stays only where the text is the same.

    Both tables have the key, the text and other columns alike; old has the embedding
    too. Returns new's columns, the embedding and needs_embedding. Keys are unique on
    both sides (last_wins); old rows without a new one stay as they are.
    """
    o, n = old.alias("o"), new.alias("n")
    newer = F.col(f"n.{key}").isNotNull()
    columns = [F.when(newer, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in new.columns]
    kept = F.when(~newer | F.col(f"o.{text}").eqNullSafe(F.col(f"n.{text}")), F.col(f"o.{embedding}"))
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(*columns, kept.alias(embedding))
    return joined.withColumn("needs_embedding", F.col(embedding).isNull())


def changed_files(listing: DataFrame, cache: DataFrame) -> DataFrame:
    """(path, modified) against the cached state: new, changed, unchanged or deleted."""
    joined = listing.select("path", F.col("modified").alias("m_new")).join(cache.select("path", F.col("modified").alias("m_old")), "path", "full_outer")
    state = F.when(F.col("m_new").isNull(), "deleted").when(F.col("m_old").isNull(), "new").when(F.col("m_new") > F.col("m_old"), "changed").otherwise("unchanged")
    return joined.select("path", state.alias("state"))


def safe_to_replace(old_rows: int, new_rows: int, guarded_from: int = 1000, most_lost: float = 0.5) -> bool:
    """Whether a rebuilt cache may replace a large one: not if more than half of it would be lost."""
    return old_rows <= guarded_from or new_rows >= old_rows * (1 - most_lost)


def is_stale(index_rows: int, table_rows: int, index_model: str | None, model: str) -> bool:
    """An index is rebuilt when its row count or its model differs."""
    return index_rows != table_rows or (index_model is not None and index_model != model)
