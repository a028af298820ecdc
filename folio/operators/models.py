"""Model surface: embedding, reranking and text generation as injected functions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.operators.retrieval import min_max, top_k

# Prefixes that models expect in front of queries and documents.
PREFIXES = {"e5": ("query: ", "passage: "), "nomic": ("search_query: ", "search_document: "), "plain": ("", "")}
#: Storage keys of models that share an index.
ALIASES: dict[str, str] = {"minilm-onnx": "minilm", "granite-onnx": "granite"}


def hash_embedding(text: str, dims: int = 8) -> np.ndarray:
    """A deterministic unit vector of a text, for tests."""
    seed = int(hashlib.md5(text.encode()).hexdigest(), 16) % 2**31
    v = np.random.RandomState(seed).randn(dims).astype(np.float32)
    return v / np.linalg.norm(v)


def embed(df: DataFrame, text: str, make: Callable[[], Callable[[list[str]], np.ndarray]], prefix: str = "") -> DataFrame:
    """Adds embedding; make builds the model once a task, and equal texts of a batch are embedded once."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for batch in batches:
            filled = batch.fillna("")
            distinct = filled.drop_duplicates().tolist()
            vectors = dict(zip(distinct, model([prefix + t for t in distinct]))) if distinct else {}
            yield filled.map(lambda t: np.asarray(vectors[t], dtype=np.float32))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn("embedding", F.pandas_udf(run, "array<float>")(text))


def weighted_query_vectors(sentences: DataFrame, decay: float = 0.5) -> DataFrame:
    """(query_id, pos, focus, embedding) -> weighted mean vectors, weight decay^|pos - focus|, not normalised again."""
    weight = F.pow(F.lit(decay), F.abs(F.col("pos") - F.col("focus")))
    parts = sentences.select("query_id", weight.alias("w"), F.posexplode("embedding").alias("dim", "x"))
    summed = parts.groupBy("query_id", "dim").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"))
    return summed.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("embedding"))


def rerank(candidates: DataFrame, score: Callable[[pd.Series, pd.Series], pd.Series], k: int = 10, blend: float | None = None, max_per_paper: int | None = None) -> DataFrame:
    """(query_id, doc_id, query_text, doc_text, score[, paper_id]) scored anew by an injected function.

    With blend the result is blend times the normalised old score plus the rest times the
    normalised new one (0.5 where all are equal); max_per_paper keeps the best of a paper.
    """
    judge = F.pandas_udf(score, "double")
    scored = candidates.withColumn("old", F.col("score")).withColumn("new", judge("query_text", "doc_text"))
    value: Column = F.col("new")
    if blend is not None:
        value = blend * min_max(F.col("old"), constant=0.5) + (1 - blend) * min_max(F.col("new"), constant=0.5)
    scored = scored.withColumn("score", F.round(value, 6))
    if max_per_paper:
        w = W.partitionBy("query_id", "paper_id").orderBy(F.col("score").desc(), "doc_id")
        scored = scored.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= max_per_paper).drop("_n")
    return top_k(scored.drop("old", "new", "query_text", "doc_text"), k)


def generated(df: DataFrame, prompt: Column, write: Callable[[pd.Series], pd.Series], out: str = "generated") -> DataFrame:
    """Text written by an injected function for a prompt column."""
    return df.withColumn(out, F.pandas_udf(write, "string")(prompt))


def valid_contexts(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """(paper_id, title, answer) with JSON answers, maybe in a code fence -> (paper_id, type, text).

    One text of each allowed type, the first; with [CITE], 30 characters or more, and without the title.
    """
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim("answer"), r"^```[a-z]*\s*", ""), r"\s*```$", ""))
    parsed = rows.select("paper_id", "title", F.posexplode(F.from_json(bare, "array<struct<type: string, text: string>>")).alias("pos", "c"))
    text = F.col("c.text")
    good = parsed.filter(F.col("c.type").isin(kinds) & text.contains("[CITE]") & (F.length(text) >= 30) & ~F.lower(text).contains(F.lower("title")))
    w = W.partitionBy("paper_id", "c.type").orderBy("pos")
    return good.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("paper_id", F.col("c.type").alias("type"), F.col("c.text").alias("text"))


def principal_plane(vectors: DataFrame, id_: str = "doc_id") -> DataFrame:
    """(id, embedding) -> (id, x, y): the first two principal components, in place of a neighbour-graph projection.

    The moments are summed in the cluster; only a dims x dims matrix reaches the driver.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = vectors.select(id_, array_to_vector(F.col("embedding").cast("array<double>")).alias("_v"))
    model = PCA(k=2, inputCol="_v", outputCol="_p").fit(v)
    p = vector_to_array("_p")
    return model.transform(v).select(id_, F.round(p[0], 6).alias("x"), F.round(p[1], 6).alias("y"))
