"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.operators.prefix import running_total

#: Buckets of one source's shuffled order, and of the virtual time up to the budget.
BUCKETS = 512
SEED = 20


def mix_sources(documents: DataFrame, targets: DataFrame, budget: float | None = None, seed: int = SEED) -> DataFrame:
    """Documents drawn so that each source has its target share of all tokens.

    documents: (doc_id, source, tokens); targets: (source, target_share, max_repeats).
    Every source's documents are shuffled by a seeded hash and queued max_repeats times,
    one pass after another. A document's virtual finish time is the source's cumulative
    tokens divided by its weight; all copies are sorted by it and cut at the budget.

    Without a budget it is the largest at which every source that has tokens still
    reaches its share within its repeats. Shares of targets without documents are
    divided among the others in proportion. Returns (doc_id, source, copy, tokens,
    finish). Sources without a target (and null ones) and documents without tokens are
    never drawn; a null or non-positive share or repeat number counts as 0; a source
    given twice in targets takes the larger share; no rows give no rows.
    """
    weights = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).filter("source is not null and target_share > 0 and max_repeats > 0")
    docs = documents.select("doc_id", "source", "tokens").filter("tokens > 0 and source is not null")
    # One row a target: the sources are few by their nature, the documents many.
    supply = weights.join(docs.groupBy("source").agg(F.sum("tokens").alias("source_tokens")), "source")
    total = supply.agg(F.sum("target_share").alias("all_shares"), F.min(F.col("max_repeats") * F.col("source_tokens") / F.col("target_share")).alias("most"))
    plan = supply.crossJoin(F.broadcast(total)).select(
        "source",
        "max_repeats",
        "source_tokens",
        (F.col("target_share") / F.col("all_shares")).alias("weight"),
        (F.lit(float(budget)) if budget else F.col("most") * F.col("all_shares")).alias("budget"),
    )
    h = F.xxhash64(F.lit(seed), "doc_id")
    shuffled = docs.withColumn("_h", h)
    width = (1 << 64) // BUCKETS
    cumulated = running_total(shuffled, ["source"], F.floor(F.col("_h") / F.lit(width)).cast("int"), ["_h", "doc_id"], "tokens", "_cum")
    queued = (
        cumulated.join(plan, "source")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("max_repeats", F.ceil(F.col("budget") * F.col("weight") / F.col("source_tokens")).cast("int") + 1))))
        .withColumn("finish", ((F.col("copy") - 1) * F.col("source_tokens") + F.col("_cum")) / F.col("weight"))
        # The queue serves at most its weight of the virtual time: later ones can't be in the budget.
        .filter("finish <= budget * (1 + 1e-9)")
    )
    spread = running_total(queued.withColumn("_all", F.lit(1)), ["_all"], F.floor(F.col("finish") / F.col("budget") * BUCKETS).cast("int"), ["finish", "source", "doc_id", "copy"], "tokens", "_served")
    return spread.filter("_served <= budget * (1 + 1e-9)").select("doc_id", "source", "copy", "tokens", "finish")


def mix_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: documents, copies, tokens, target share and the share really got (0 without any)."""
    got = mixed.groupBy("source").agg(F.countDistinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("copies"), F.sum("tokens").alias("tokens"), F.max("copy").alias("most_copies"))
    every = got.agg(F.sum("tokens").alias("_every"))
    return (
        targets.groupBy("source").agg(F.max("target_share").alias("target_share"))
        .join(got, "source", "left")
        .crossJoin(F.broadcast(every))
        .select(
            "source",
            "target_share",
            *(F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "copies", "tokens", "most_copies")),
            F.round(F.coalesce(F.col("tokens") / F.col("_every"), F.lit(0.0)), 6).alias("actual_share"),
        )
    )
