"""Queries of the general (non-text) problems over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators.orphans import orphan_references, orphans_by_month
from folio.session import load


def _references(spark: SparkSession, d: str) -> DataFrame:
    def side(table: str, key: str, ref: str) -> DataFrame:
        return load(spark, d, table).select(F.lit(table).alias("src_table"), F.col(key).alias("row_key"), F.col(ref).alias("missing_id"), "created_at")

    return side("chunks", "id", "paper_id").unionByName(side("contexts", "id", "paper_id")).unionByName(side("reference_sets", "paper_id", "neighbor_id"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(_references(spark, d), load(spark, d, "papers").select("id", "added_at"), load(spark, d, "deleted_papers").select("paper_id", "deleted_at"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("src_table", "row_key", "missing_id", "kind")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans_by_month(_orphans(spark, d))


_ORPHANS_SQL = """
with refs as (
  select src_table, row_key, missing_id, min(created_at) as created_at from (
    select 'chunks' as src_table, id as row_key, paper_id as missing_id, created_at from chunks
    union all select 'contexts', id, paper_id, created_at from contexts
    union all select 'reference_sets', paper_id, neighbor_id, created_at from reference_sets)
  where missing_id is not null and missing_id <> '' group by 1, 2, 3),
added as (select id, min(added_at) as first_added, max(added_at) as last_added from papers group by 1),
kinds as (
  select r.*, case
    when d.paper_id is not null and (a.last_added is null or a.last_added < d.deleted_at) then 'deleted'
    when a.id is null then 'missing'
    when a.first_added > r.created_at then 'late' end as kind
  from refs r left join added a on a.id = r.missing_id left join deleted_papers d on d.paper_id = r.missing_id)
"""

QUERIES = {"p5_found": p5_found, "p5_report": p5_report}
SQL = {
    "p5_found": _ORPHANS_SQL + "select src_table, row_key, missing_id, kind from kinds where kind is not null",
    "p5_report": _ORPHANS_SQL + "select src_table, coalesce(strftime(created_at, '%Y-%m'), '') as month, kind, count(*) as n_references from kinds where kind is not null group by 1, 2, 3",
}
