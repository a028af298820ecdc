"""Matching and enriching bibliographic metadata."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import fuzzy_title


def word_set(text: Column) -> Column:
    """Distinct lower-case ASCII words of three characters or more."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda x: F.length(x) >= 3))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def titles_match(a: Column, b: Column, least: float = 0.8) -> Column:
    """Equal, contained (over 20 characters), or overlapping words against the larger title."""
    x, y = fuzzy_title(a), fuzzy_title(b)
    wx, wy = F.array_distinct(F.split(x, " ")), F.array_distinct(F.split(y, " "))
    contained = (F.length(x) > 20) & (F.length(y) > 20) & (x.contains(y) | y.contains(x))
    overlap = F.when((x != "") & (y != ""), F.size(F.array_intersect(wx, wy)) / F.greatest(F.size(wx), F.size(wy)) >= least).otherwise(False)
    return (x == y) | contained | overlap


def _indel_ratio(a: str, b: str) -> float:
    if not a and not b:
        return 100.0
    prev = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(prev[j] + 1 if x == y else max(prev[j + 1], row[-1]))
        prev = row
    return 200.0 * prev[-1] / (len(a) + len(b))


def _token_sort(a: pd.Series, b: pd.Series) -> pd.Series:
    order = lambda s: " ".join(sorted((s or "").split()))
    return pd.Series([_indel_ratio(order(x), order(y)) for x, y in zip(a, b)], dtype="float64")


def token_sort_ratio(a: Column, b: Column) -> Column:
    """Indel similarity (0 to 100) of the words in sorted order."""
    return F.pandas_udf(_token_sort, "double")(a, b)


def not_in_corpus(items: DataFrame, corpus: DataFrame) -> DataFrame:
    """Items whose DOI (any case) and title (any case, trimmed) the corpus doesn't have: two anti joins."""
    dois = corpus.filter("doi <> ''").select(F.lower("doi").alias("_doi")).distinct()
    titles = corpus.filter("title is not null").select(F.lower(F.trim("title")).alias("_title")).distinct()
    keyed = items.withColumn("_doi", F.lower("doi")).withColumn("_title", F.lower(F.trim("title")))
    return keyed.join(dois, "_doi", "left_anti").join(titles, "_title", "left_anti").drop("_doi", "_title")


def enrich(papers: DataFrame, sources: list[DataFrame], key: str, column: str) -> DataFrame:
    """Missing values of column filled from the first source (key, value) that has one, with its number."""
    value = F.when(F.col(column) != "", F.col(column))
    origin = F.when(value.isNotNull(), F.lit(0))
    for i, s in enumerate(sources, 1):
        papers = papers.join(s.filter("value <> ''").select(F.col(key), F.col("value").alias(f"_v{i}")), key, "left")
        origin = F.coalesce(origin, F.when(F.col(f"_v{i}").isNotNull(), F.lit(i)))
        value = F.coalesce(value, F.col(f"_v{i}"))
    return papers.withColumn("_origin", origin).withColumn(column, value).drop(*(f"_v{i}" for i in range(1, len(sources) + 1))).withColumnRenamed("_origin", "origin")


def abstract_from_index(inverted: DataFrame, key: str) -> DataFrame:
    """(key, inverted MAP<word, ARRAY<position>>) -> (key, abstract), words in the order of their positions."""
    rows = inverted.select(key, F.explode("inverted").alias("word", "positions")).select(key, "word", F.explode("positions").alias("pos"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("abstract"))


def fields_to_columns(eav: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, value) rows -> one column a field; the pivot's fields are given, so it is one aggregation."""
    return eav.filter(F.col("field").isin(fields)).groupBy(key).pivot("field", fields).agg(F.min("value"))


def covered(references: DataFrame, resolved: DataFrame, least: float = 0.3, least_size: int = 1) -> DataFrame:
    """(paper_id, ref_id) against resolved (ref_id): papers whose share of resolved references is large enough."""
    known = resolved.select("ref_id").distinct().withColumn("_known", F.lit(1))
    counted = references.join(known, "ref_id", "left").groupBy("paper_id").agg(F.count(F.lit(1)).alias("n_refs"), F.count("_known").alias("n_resolved"))
    return counted.withColumn("coverage", F.round(F.col("n_resolved") / F.col("n_refs"), 6)).filter((F.col("n_resolved") / F.col("n_refs") >= least) & (F.col("n_resolved") >= least_size))
