"""Schemas and lenient readers of the JSON-lines tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.text import is_bibliography

PAPER = "id STRING, title STRING, abstract STRING, authors ARRAY<STRING>, year INT, doi STRING, bibtex_key STRING, journal STRING, full_text STRING, paragraphs ARRAY<STRING>, source_file STRING, llm_description STRING, zotero_uri STRING"
CHUNK = "id STRING, paper_id STRING, text STRING, section STRING, char_offset INT, page_number INT, source STRING, context_text STRING, parent_text STRING"
CONTEXT = "id STRING, local_context STRING, narrow_context STRING, broad_context STRING, section_context STRING, global_context STRING, source_paper_id STRING, ground_truth_ids ARRAY<STRING>, reference_set_ids ARRAY<STRING>, mentioned_authors ARRAY<STRING>, mentioned_years ARRAY<INT>, reformulated_query STRING, difficulty STRING"
FULLTEXT = "paper_id STRING, body_text ARRAY<STRUCT<section: STRING, text: STRING, cite_spans: ARRAY<STRUCT<start: INT, `end`: INT, ref_id: STRING>>>>, bib_entries MAP<STRING, STRUCT<bib_entry_raw: STRING, ids: STRUCT<open_alex_id: STRING, doi: STRING, arxiv_id: STRING>>>"


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """One paper a line; missing abstract '' and lists empty; lines without id or title are left out."""
    df = spark.read.schema(PAPER).json(path).filter("id <> '' and title <> ''")
    return df.withColumn("abstract", F.coalesce("abstract", F.lit(""))).withColumn("authors", F.coalesce("authors", F.array().cast("array<string>"))).withColumn("paragraphs", F.coalesce("paragraphs", F.array().cast("array<string>")))


def read_contexts(spark: SparkSession, path: str) -> DataFrame:
    """Citation contexts; reference sets without repeats in their order."""
    return spark.read.schema(CONTEXT).json(path).filter("id <> ''").withColumn("reference_set_ids", F.array_distinct("reference_set_ids"))


def read_chunks(spark: SparkSession, path: str, without_bibliography: bool = True) -> DataFrame:
    df = spark.read.schema(CHUNK).json(path).filter("id <> ''").withColumn("char_offset", F.coalesce("char_offset", F.lit(0)))
    return df.filter(~is_bibliography(F.col("section"), F.col("text"))) if without_bibliography else df


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank stripped lines as queries, numbered in the file's order."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "text"))
    return rows.withColumn("text", F.trim("text")).filter("text <> ''").select(F.col("line").cast("long").alias("query_id"), "text")


def fulltext_paragraphs(documents: DataFrame) -> DataFrame:
    """Body texts -> (paper_id, pos, para): up to the references, citation spans cut out, 50 characters and 30 % letters at least."""
    stop = F.expr(r"array_position(transform(body_text, p -> coalesce(regexp_replace(lower(trim(p.section)), '^[0-9.]+\\s*', '') in ('references', 'bibliography', 'works cited', 'literature cited'), false)), true)")
    kept = documents.withColumn("_stop", stop).select("paper_id", F.posexplode(F.expr("if(_stop > 0, slice(body_text, 1, cast(_stop as int) - 1), body_text)")).alias("pos", "p"))
    cut = F.expr(
        """aggregate(reverse(array_sort(filter(coalesce(p.cite_spans, cast(array() as array<struct<start: int, `end`: int, ref_id: string>>)), s -> s.start >= 0 and s.start < s.`end` and s.`end` <= length(trim(p.text))))),
           trim(p.text), (t, s) -> concat(substring(t, 1, s.start), substring(t, s.`end` + 1)))"""
    )
    text = kept.select("paper_id", "pos", F.trim(F.regexp_replace(cut, r"\s+", " ")).alias("para"))
    return text.filter((F.length("para") >= 50) & (F.length(F.regexp_replace("para", r"[^\p{L}]", "")) / F.length("para") >= 0.30))


def cited_entries(documents: DataFrame) -> DataFrame:
    """(paper_id, pos, ref_id, open_alex_id) of the citation spans whose entry has an id."""
    spans = documents.select("paper_id", "bib_entries", F.posexplode("body_text").alias("pos", "p")).select("paper_id", "pos", "bib_entries", F.explode("p.cite_spans").alias("s"))
    entry = F.try_element_at("bib_entries", F.col("s.ref_id"))
    return spans.select("paper_id", "pos", F.col("s.ref_id").alias("ref_id"), F.element_at(F.split(entry["ids"]["open_alex_id"], "/"), -1).alias("open_alex_id")).filter("open_alex_id is not null")
