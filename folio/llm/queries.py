"""Queries of the training-data operators over the test tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.matching import match_records
from folio.llm.mixing import mix_shares, mix_sources
from folio.llm.names import link_names, linked_pairs
from folio.llm.near_duplicates import near_duplicate_groups, near_duplicate_pairs
from folio.llm.scans import repair_scans
from folio.llm.spam_pages import label_pages
from folio.llm.splitting import explode_pieces, split_texts
from folio.llm.tokens import token_counts, token_ids
from folio.session import cut_lineage, load


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return token_ids(load(spark, d, "documents"), ["doc_id"], "text")


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    # Only documents of the targets' sources are counted; the join drops the others before their texts are read on.
    targets = load(spark, d, "mix_targets")
    docs = load(spark, d, "documents").join(targets.select("source").distinct(), "source", "left_semi")
    # The sizes are read several times; they are a few bytes a document.
    return mix_sources(cut_lineage(token_counts(docs, ["doc_id", "source"], "text")), targets)


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix_shares(_mixed(spark, d), load(spark, d, "mix_targets"))


def _page_texts(spark: SparkSession, d: str) -> DataFrame:
    chunks = load(spark, d, "chunks").select(F.lit("chunks").alias("src_table"), F.col("id").alias("row_key"), "text")
    return chunks.unionByName(load(spark, d, "pdf_extractions").select(F.lit("pdf_extractions").alias("src_table"), F.col("extraction_id").alias("row_key"), F.col("full_text").alias("text")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return repair_scans(_page_texts(spark, d), with_text=False).select("src_table", "row_key", F.explode("kinds").alias("kind")).distinct()


def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    return repair_scans(_page_texts(spark, d))


def p2_matches(spark: SparkSession, d: str) -> DataFrame:
    return match_records(load(spark, d, "papers"), load(spark, d, "catalog_records"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_matches(spark, d).select("paper_id", "record_id").distinct()


def p3_entities(spark: SparkSession, d: str) -> DataFrame:
    return link_names(load(spark, d, "papers").select(F.explode("authors").alias("name")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return linked_pairs(p3_entities(spark, d))


def _long_texts(spark: SparkSession, d: str) -> DataFrame:
    chunks = load(spark, d, "chunks").select(F.lit("chunks").alias("src_table"), F.col("id").alias("row_key"), "source", "text")
    pdfs = load(spark, d, "pdf_extractions").select(F.lit("pdf_extractions").alias("src_table"), F.col("extraction_id").alias("row_key"), "source", F.col("full_text").alias("text"))
    return split_texts(chunks.unionByName(pdfs), load(spark, d, "split_specs"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _long_texts(spark, d).filter("n_pieces > 1").select("src_table", "row_key").distinct()


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return explode_pieces(_long_texts(spark, d))


def _edited_texts(spark: SparkSession, d: str) -> DataFrame:
    contexts = load(spark, d, "contexts").select(F.lit("contexts").alias("src_table"), "id", "text")
    return contexts.unionByName(load(spark, d, "papers").select(F.lit("papers").alias("src_table"), "id", F.col("abstract").alias("text")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicate_pairs(_edited_texts(spark, d))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicate_groups(_edited_texts(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return label_pages(load(spark, d, "documents"), ["doc_id"], "text").filter("is_spam").select("doc_id")


def p9_labels(spark: SparkSession, d: str) -> DataFrame:
    return label_pages(load(spark, d, "documents"), ["doc_id"], "text")


QUERIES = {
    "p1_found": p1_found,
    "p1_repaired": p1_repaired,
    "p2_found": p2_found,
    "p2_matches": p2_matches,
    "p3_found": p3_found,
    "p3_entities": p3_entities,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p6_found": p6_found,
    "p6_groups": p6_groups,
    "p7_ids": p7_ids,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_labels": p9_labels,
}
SQL: dict[str, str] = {
    "p4_found": """
select distinct src_table, row_key from (
  select 'chunks' as src_table, id as row_key, source, text from chunks
  union all select 'pdf_extractions', extraction_id, source, full_text from pdf_extractions) t
join split_specs s using (src_table)
where s.source = coalesce((select o.source from split_specs o where o.src_table = t.src_table and o.source = t.source), 'default')
  and length(t.text) > s.max_chars""",
    "p6_found": """
with t as (select distinct 'contexts' as src_table, id, text from contexts where text <> ''
  union select distinct 'papers', id, abstract from papers where abstract <> ''),
w as (select src_table, id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from t),
p as (select src_table, id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as p from w where len(w) > 1),
e as (select src_table, id, len(p) as n, unnest(p) as x from p),
c as (select a.src_table, a.id as id_a, b.id as id_b, a.n as na, b.n as nb, count(*) as k
  from e a join e b on a.src_table = b.src_table and a.x = b.x and a.id < b.id group by 1, 2, 3, 4, 5)
select src_table, id_a, id_b from c where k >= 0.5 * na and k >= 0.5 * nb""",
}
