"""Orphan references: keys that are deleted, missing or came later.

Parent keys are turned into integers, sorted and compressed into contiguous runs;
a reference is matched as of the run that starts at or before it and is an orphan
if it lies beyond that run's end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Width of one key bucket. A bucket holds at most this many distinct keys, so the
#: windows below have a fixed bound whatever the size of the tables.
BUCKET = 1 << 16
_NUMBERED = r"^([^0-9]*)([0-9]{1,18})$"


def key_space(key: Column) -> Column:
    """The part of a key that isn't its number: prefix and digit count, or the whole key."""
    digits = F.regexp_extract(key, _NUMBERED, 2)
    return F.when(
        key.rlike(_NUMBERED),
        F.concat(F.lit("n"), F.length(digits).cast("string"), F.lit(":"), F.regexp_extract(key, _NUMBERED, 1)),
    ).otherwise(F.concat(F.lit("s:"), key))


def key_number(key: Column) -> Column:
    """The key's number; 0 for keys without one (their space is then the key itself)."""
    return F.when(key.rlike(_NUMBERED), F.regexp_extract(key, _NUMBERED, 2).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def _keyed(df: DataFrame, key: str) -> DataFrame:
    return df.select(
        F.col(key).alias("_key"),
        key_space(F.col(key)).alias("_space"),
        key_number(F.col(key)).alias("_num"),
    ).withColumn("_bucket", F.expr(f"_num div {BUCKET}"))


def contiguous_runs(parents: DataFrame, key: str) -> DataFrame:
    """Distinct keys -> runs (_space, _bucket, run_start, run_end), cut at bucket borders."""
    w = W.partitionBy("_space", "_bucket").orderBy("_num")
    return (
        _keyed(parents, key)
        .withColumn("_island", F.col("_num") - F.row_number().over(w))
        .groupBy("_space", "_bucket", "_island")
        .agg(F.min("_num").alias("run_start"), F.max("_num").alias("run_end"))
        .drop("_island")
    )


def asof_presence(keys: DataFrame, key: str, runs: DataFrame) -> DataFrame:
    """Distinct keys -> (key, present): as-of match to the preceding run start."""
    both = _keyed(keys, key).select("_space", "_bucket", "_num", "_key", F.lit(1).alias("_is_ref"), F.lit(None).cast("bigint").alias("_end")).unionByName(
        runs.select("_space", "_bucket", F.col("run_start").alias("_num"), F.lit(None).cast("string").alias("_key"), F.lit(0).alias("_is_ref"), F.col("run_end").alias("_end"))
    )
    w = W.partitionBy("_space", "_bucket").orderBy("_num", "_is_ref").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        both.withColumn("_asof_end", F.last("_end", ignorenulls=True).over(w))
        .filter("_is_ref = 1")
        .select(F.col("_key").alias(key), (F.coalesce(F.col("_asof_end"), F.lit(-1)) >= F.col("_num")).alias("present"))
    )


def orphan_references(references: DataFrame, parents: DataFrame, deleted: DataFrame) -> DataFrame:
    """References to parents that are deleted, missing or were added later.

    references: (src_table, row_key, missing_id, created_at); parents: (id, added_at);
    deleted: (paper_id, deleted_at). Returns distinct (src_table, row_key, missing_id,
    kind, created_at) with the first kind that fits: deleted, missing, late.

    Null and empty references aren't cases; ids are compared exactly; a null created_at
    or added_at is never late; repeats give one row (with the earliest created_at);
    empty tables give no rows or, without parents, only missing ones. Other columns of
    the inputs are ignored.
    """
    refs = (
        references.select("src_table", "row_key", "missing_id", "created_at")
        .filter(F.col("missing_id").isNotNull() & (F.col("missing_id") != ""))
        .groupBy("src_table", "row_key", "missing_id")
        .agg(F.min("created_at").alias("created_at"))
    )
    keys = refs.groupBy("missing_id").agg(F.min("created_at").alias("first_ref"))
    added = (
        parents.filter(F.col("id").isNotNull())
        .groupBy(F.col("id").alias("missing_id"))
        .agg(F.min("added_at").alias("first_added"), F.max("added_at").alias("last_added"))
    )
    gone = deleted.filter(F.col("paper_id").isNotNull()).groupBy(F.col("paper_id").alias("missing_id")).agg(F.max("deleted_at").alias("deleted_at"), F.lit(True).alias("is_deleted"))
    presence = asof_presence(keys, "missing_id", contiguous_runs(added, "missing_id"))
    status = (
        keys.join(presence, "missing_id")
        .join(added, "missing_id", "left")
        .join(gone, "missing_id", "left")
        .select(
            "missing_id",
            "first_added",
            F.when(F.col("is_deleted") & ~F.coalesce(F.col("last_added") >= F.col("deleted_at"), F.lit(False)), "deleted").when(~F.col("present"), "missing").alias("key_kind"),
            (F.col("first_added") > F.col("first_ref")).alias("may_be_late"),
        )
        .filter("key_kind is not null or may_be_late")
    )
    return (
        refs.join(status, "missing_id")
        .withColumn("kind", F.coalesce("key_kind", F.when(F.col("first_added") > F.col("created_at"), "late")))
        .filter("kind is not null")
        .select("src_table", "row_key", "missing_id", "kind", "created_at")
    )


def orphans_by_month(orphans: DataFrame) -> DataFrame:
    """Number of orphan references per table, month of created_at ('' if null) and kind."""
    return orphans.groupBy("src_table", F.coalesce(F.date_format("created_at", "yyyy-MM"), F.lit("")).alias("month"), "kind").agg(F.count(F.lit(1)).alias("n_references"))
