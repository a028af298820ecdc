"""Running totals over a whole table without putting a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running_total(df: DataFrame, group: list[str], bucket: Column, order: list[str], value: str, out: str) -> DataFrame:
    """Inclusive running sum of value per group in the order of (bucket, *order).

    bucket must rise with the wanted order. The sum over earlier buckets comes from
    one small row per (group, bucket), the sum inside a bucket from a window over
    that bucket only; so a group of any size is spread over its buckets. Null
    values count as 0; an empty table stays empty; the helper columns _bucket and
    _before must not exist in df.
    """
    df = df.withColumn("_bucket", bucket)
    totals = df.groupBy(*group, "_bucket").agg(F.sum(F.coalesce(F.col(value), F.lit(0))).alias("_total"))
    earlier = W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(*group, "_bucket", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    inside = W.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        df.join(before, [*group, "_bucket"])
        .withColumn(out, F.col("_before") + F.sum(F.coalesce(F.col(value), F.lit(0))).over(inside))
        .drop("_before", "_bucket")
    )
