"""Streams: quiet-period triggers and incremental embedding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quiet_sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None, key: str = "user_id", time: str = "ts") -> DataFrame:
    """One trigger a key after each period of events without a pause of gap.

    Works on batches and, with a watermark of late, on streams: a session is emitted
    once the watermark passes its end. Null keys form sessions of their own; null times
    are left out.
    """
    rows = events.filter(F.col(time).isNotNull())
    if late:
        rows = rows.withWatermark(time, late)
    return rows.groupBy(key, F.session_window(time, gap).alias("_w")).agg(F.count(F.lit(1)).alias("n_events")).select(key, F.col("_w.start").alias("started"), F.col("_w.end").alias("fires_at"), "n_events")


def matching_lines(lines: DataFrame, patterns: list[str], text: str = "line") -> DataFrame:
    """Lines that one of the patterns matches; patterns that aren't valid are ignored."""
    import re

    valid = []
    for p in patterns:
        try:
            re.compile(p)
            valid.append(p)
        except re.error:
            continue
    return lines.filter(F.col(text).rlike("|".join(f"(?:{p})" for p in valid))) if valid else lines.limit(0)


def embed_new(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Micro-batches of whatever has arrived, each handed to an upsert; returns the started query."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
