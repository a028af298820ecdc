"""Batch retrieval: lexical and vector ranking, fusion, aggregation, two stages.

Every operator takes a table of queries and returns ranked rows
(query_id, doc_id, score, rank), rank 1 to k by descending score and ascending id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions.text import tokens
from folio.session import cut_lineage, never_broadcast, spread

#: Rows of one block of vectors and of queries in the blocked product.
VECTOR_BLOCK, QUERY_BLOCK = 4096, 512
#: Tokens of one block of documents in lexical retrieval, and those from which a table is spread over the cores.
LEXICAL_BLOCK, LEAST_LEXICAL_BLOCK = 8_000_000, 250_000


def top_k(scored: DataFrame, k: int, query: str = "query_id", doc: str = "doc_id", score: str = "score") -> DataFrame:
    """Ranked best k of each query; the limit sits on the window, so Spark prunes before the shuffle."""
    w = W.partitionBy(query).orderBy(F.col(score).desc(), F.col(doc))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def bm25(queries: DataFrame, documents: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, words: Callable[[Column], Column] = tokens) -> DataFrame:
    """Okapi BM25 of queries (query_id, text) over documents (doc_id, text), doc_id being unique.

    Idf is ln((N - df + .5) / (df + .5)); a negative one becomes epsilon times the mean
    idf of the vocabulary. Repeated query words count again; scores are rounded to six
    places; only positive ones are kept; words splits a text (with stems, for one). Documents without a token count in N. Null
    texts are empty.
    """
    return bm25_tiers(queries, documents, {"bm25": b}, k, k1, epsilon, words).drop("tier")


def bm25_tiers(queries: DataFrame, documents: DataFrame, tiers: dict[str, float], k: int = 10, k1: float = 1.5, epsilon: float = 0.25, words: Callable[[Column], Column] = tokens) -> DataFrame:
    """Ranked lists of bm25 for several length normalisations (tier: b) at once, with the column tier.

    Documents are gathered in blocks of about LEXICAL_BLOCK tokens, each in one partition;
    all queries pass by every block, which adds up the scores of its documents in one
    array and hands on its best k. So no pair of query and document is ever a row. Words
    are told apart by 64-bit hashes.
    """
    hashed = lambda df, id_: df.select(id_, F.transform(words(F.col("text")), lambda x: F.xxhash64(x)).alias("w"))
    docs = hashed(spread(documents.select("doc_id", "text")), "doc_id").filter(F.size("w") > 0)
    n_docs = max(1, documents.count())
    # A document's length is counted at the first of its words.
    each = docs.select(F.size("w").alias("len"), F.posexplode(F.array_distinct("w")).alias("at", "term"))
    df = cut_lineage(each.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("at") == 0, F.col("len")).otherwise(0)).alias("n")))
    raw = F.log((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    n_tokens, mean = df.agg(F.sum("n"), F.avg(raw)).first()
    n_tokens = n_tokens or 0
    idf = df.select("term", F.when(raw < 0, F.lit(epsilon * (mean or 0.0))).otherwise(raw).alias("idf"))
    asked = hashed(queries, "query_id").select("query_id", F.explode("w").alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    weighted = asked.join(never_broadcast(idf), "term").groupBy("query_id").agg(F.collect_list(F.struct("term", (F.col("qtf") * F.col("idf")).alias("weight"))).alias("t"))
    cores = documents.sparkSession.sparkContext.defaultParallelism
    blocks = max(-(-n_tokens // LEXICAL_BLOCK), min(cores, -(-n_tokens // LEAST_LEXICAL_BLOCK)), 1)
    own = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), F.col("doc_id").alias("id"), "w", F.array().cast("array<double>").alias("weights"))
    passing = weighted.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), F.col("query_id").alias("id"), F.col("t.term").alias("w"), F.col("t.weight").alias("weights"))
    placed = own.unionByName(passing).repartitionById(blocks, F.col("block")).sortWithinPartitions("kind").select("kind", "id", "w", "weights")
    scored = placed.mapInArrow(_lexical_block(k, k1, tiers, n_tokens / n_docs), "query_id long, doc_id long, tier string, score double")
    w = W.partitionBy("query_id", "tier").orderBy(F.col("score").desc(), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


class _Postings(NamedTuple):
    """A block's documents by word: the words in order, where each one's postings begin (and the last one's end), documents and impacts by tier."""

    ids: np.ndarray
    terms: np.ndarray
    begin: np.ndarray
    docs: np.ndarray
    impacts: dict[str, np.ndarray]


def _postings(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k1: float, tiers: dict[str, float], avg_len: float) -> _Postings:
    """(ids, lengths, words) of a block's documents -> its postings."""
    ids, length, terms = (np.concatenate(x) for x in zip(*parts))
    row = np.repeat(np.arange(len(ids), dtype=np.int32), length)
    order = np.argsort(terms, kind="stable")  # rows stay in order inside a word
    terms, row = terms[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], (terms[1:] != terms[:-1]) | (row[1:] != row[:-1])]))
    tf = np.diff(np.append(first, len(terms))).astype(np.float64)
    terms, row = terms[first], row[first]
    begin = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]]))
    impacts = {name: tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[row] / avg_len)) for name, b in tiers.items()}
    return _Postings(ids, terms[begin], np.append(begin, len(terms)), row, impacts)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and rounded scores of the best k positive ones, ties to the smaller id."""
    border = np.partition(scores, -k)[-k] - 1e-6 if k < len(scores) else 0.0  # what rounding can lift to the border is kept
    at = np.flatnonzero((scores >= border) & (scores > 0))
    rounded = np.floor(scores[at] * 1e6 + 0.5) / 1e6
    order = np.lexsort((ids[at], -rounded))[:k]
    order = order[rounded[order] > 0]
    return ids[at[order]], rounded[order]


def _lexical_block(k: int, k1: float, tiers: dict[str, float], avg_len: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        block, scores = None, np.zeros(0)
        lists = lambda rows, name: rows.column(name).flatten().to_numpy(zero_copy_only=False)
        for batch in batches:
            n = int(np.searchsorted(batch.column("kind").to_numpy(), 1))  # documents come before the queries
            if n:
                own = batch.slice(0, n)
                parts.append((own.column("id").to_numpy(), pc.list_value_length(own.column("w")).to_numpy(), lists(own, "w")))
            if n == batch.num_rows or not parts and block is None:
                continue
            if block is None:
                block = _postings(parts, k1, tiers, avg_len)
                parts, scores = [], np.zeros(len(block.ids))
            asked = batch.slice(n)
            terms, weights = lists(asked, "w"), lists(asked, "weights")
            at = np.minimum(np.searchsorted(block.terms, terms), len(block.terms) - 1)
            known = block.terms[at] == terms
            begin, end = block.begin[at].tolist(), block.begin[at + 1].tolist()
            ends = np.cumsum(pc.list_value_length(asked.column("w")).to_numpy())
            found: list[tuple[int, str, np.ndarray, np.ndarray]] = []
            for query, start, stop in zip(asked.column("id").to_pylist(), [0, *ends.tolist()], ends.tolist()):
                here = [i for i in range(start, stop) if known[i]]
                for name, impact in block.impacts.items():
                    scores.fill(0.0)
                    for i in here:
                        p = slice(begin[i], end[i])
                        scores[block.docs[p]] += weights[i] * impact[p]
                    ids, best = _best(scores, block.ids, k)
                    found.append((query, name, ids, best))
            size = [len(ids) for _, _, ids, _ in found]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.array([q for q, *_ in found], dtype=np.int64), size)),
                    pa.array(np.concatenate([x for _, _, x, _ in found]).astype(np.int64)),
                    pa.array(np.repeat(np.array([t for _, t, *_ in found], dtype=object), size), pa.string()),
                    pa.array(np.concatenate([x for *_, x in found])),
                ],
                names=["query_id", "doc_id", "tier", "score"],
            )

    return run


def _block_top(k: int, per_group: int | None = None):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for _, r in f.iterrows():
                q = np.stack([np.asarray(x, dtype=np.float64) for x in r["q_vectors"]])
                v = np.stack([np.asarray(x, dtype=np.float64) for x in r["vectors"]])
                scores = np.round(q @ v.T, 6)
                ids = np.asarray(r["ids"])
                own = np.asarray(r["q_ids"])
                keep = min(k, len(ids))
                for i in range(len(q)):
                    # Ties at the border are all kept; the window on top decides by id.
                    border = np.partition(scores[i], -keep)[-keep] if keep < len(ids) else -np.inf
                    at = np.flatnonzero(scores[i] >= border)
                    yield pd.DataFrame({"query_id": own[i], "doc_id": ids[at], "score": scores[i][at]})

    return run


def vector_scores(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Inner products of (query_id, embedding) with (doc_id, embedding), at least the best k of each query and block.

    Both sides are gathered in blocks of a fixed number of rows, and a task multiplies
    one pair of blocks; so neither side has to fit anywhere as a whole. Null vectors are
    left out.
    """
    block = lambda df, id_, size, n: df.filter("embedding is not null").withColumn("_b", F.pmod(F.xxhash64(id_), F.lit(n))).groupBy("_b").agg(F.collect_list(F.struct(id_, "embedding")).alias("_r"))  # noqa: E731, ARG005
    nv = max(1, vectors.count() // VECTOR_BLOCK + 1)
    nq = max(1, queries.count() // QUERY_BLOCK + 1)
    left = block(vectors, "doc_id", VECTOR_BLOCK, nv).select(F.col("_r.doc_id").alias("ids"), F.col("_r.embedding").alias("vectors"))
    right = block(queries, "query_id", QUERY_BLOCK, nq).select(F.col("_r.query_id").alias("q_ids"), F.col("_r.embedding").alias("q_vectors"))
    return left.crossJoin(right).mapInPandas(_block_top(k), "query_id long, doc_id long, score double")


def vector_top(queries: DataFrame, vectors: DataFrame, k: int = 10, drop_self: bool = False) -> DataFrame:
    """Exact nearest vectors by inner product."""
    scored = vector_scores(queries, vectors, k + drop_self)
    return top_k(scored.filter("query_id <> doc_id") if drop_self else scored, k)


def prefix_vectors(df: DataFrame, dims: int) -> DataFrame:
    """Vectors cut to their first dims numbers and brought to length 1 again."""
    cut = F.transform(F.slice("embedding", 1, dims), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(cut, F.lit(0.0), lambda a, x: a + x * x))
    return df.withColumn("embedding", F.transform(cut, lambda x: F.when(norm > 0, x / norm).otherwise(x)))


def two_phase_vector_top(queries: DataFrame, vectors: DataFrame, k: int = 10, candidates: int = 100, dims: int = 16) -> DataFrame:
    """Best candidates by the vectors' prefixes, ranked by the whole vectors."""
    first = vector_top(prefix_vectors(queries, dims), prefix_vectors(vectors, dims), candidates).select("query_id", "doc_id")
    full = first.join(queries.select("query_id", F.col("embedding").alias("q")), "query_id").join(vectors.select("doc_id", F.col("embedding").alias("v")), "doc_id")
    dot = F.aggregate(F.zip_with("q", "v", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return top_k(full.select("query_id", "doc_id", F.round(dot, 6).alias("score")), k)


def rrf(ranked: DataFrame, rrf_k: int = 60, weights: dict[str, float] | None = None) -> DataFrame:
    """Reciprocal rank fusion of (query_id, doc_id, tier, rank, score): one shuffle on (query, document)."""
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("tier")], F.lit(1.0)) if weights else F.lit(1.0)
    return ranked.groupBy("query_id", "doc_id").agg(
        F.round(F.sum(weight / (rrf_k + F.col("rank"))), 9).alias("score"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("tier", "rank")))).alias("tier_ranks"),
        F.min("rank").alias("best_rank"),
    )


def weighted_fusion(ranked: DataFrame, weights: dict[str, float]) -> DataFrame:
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("tier")], F.lit(1.0))
    return ranked.groupBy("query_id", "doc_id").agg(F.round(F.sum(weight * F.col("score")), 6).alias("score"))


def aggregate_chunks(hits: DataFrame, mode: str, alpha: float = 0.7, best: int = 3, bonus: float = 0.02) -> DataFrame:
    """Chunk hits (query_id, chunk_id, paper_id, score) -> papers, in one of seven ways, with the best chunk."""
    s, n = F.col("score"), F.count(F.lit(1))
    value = {
        "max": F.max(s),
        "mean": F.avg(s),
        "sum": F.sum(s),
        "weighted_max": alpha * F.max(s) + (1 - alpha) * F.avg(s),
        "top_k_mean": F.aggregate(F.slice(F.sort_array(F.collect_list(s), asc=False), 1, best), F.lit(0.0), lambda a, x: a + x) / F.least(F.lit(best), n),
        "coverage": F.max(s) + bonus * (n - 1),
        "log_normalized": F.max(s) + bonus * F.log1p(n - 1),
    }[mode]
    return hits.groupBy("query_id", "paper_id").agg(
        F.round(value, 9).alias("score"), n.alias("n_chunks"), F.min_by("chunk_id", F.struct(-s, F.col("chunk_id"))).alias("best_chunk")
    )


def min_max(col: Column, query: str = "query_id", constant: float = 1.0) -> Column:
    """Scores of a query between 0 and 1; constant where all are equal."""
    w = W.partitionBy(query)
    low, high = F.min(col).over(w), F.max(col).over(w)
    return F.when(high > low, (col - low) / (high - low)).otherwise(constant)


def candidate_chunks(papers: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Scores of all chunks of each query's candidate papers: (query_id, paper_id, chunk_id, score).

    papers: (query_id, paper_id); queries: (query_id, embedding); vectors: (chunk_id,
    paper_id, embedding). An equi join on the paper; vectors of other papers are never read
    into a product.
    """
    asked = papers.select("query_id", "paper_id").join(queries.select("query_id", F.col("embedding").alias("_q")), "query_id")
    dot = F.aggregate(F.zip_with("_q", "embedding", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return asked.join(vectors.filter("embedding is not null"), "paper_id").select("query_id", "paper_id", "chunk_id", F.round(dot, 6).alias("score"))


def two_stage(papers: DataFrame, chunk_hits: DataFrame, alpha: float = 0.6, k: int = 10, per_paper: int = 3, evidence_from: float = 0.35) -> DataFrame:
    """Papers (query_id, paper_id, score) blended with their best chunks (query_id, chunk_id, paper_id, score).

    Score is alpha times the normalised paper score plus the rest times the best chunk
    score (0 without chunks); evidence counts the best per_paper chunks from the threshold on.
    """
    wanted = chunk_hits.join(papers.select("query_id", "paper_id"), ["query_id", "paper_id"])
    w = W.partitionBy("query_id", "paper_id").orderBy(F.col("score").desc(), "chunk_id")
    near = wanted.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= per_paper)
    chunks = near.groupBy("query_id", "paper_id").agg(F.max("score").alias("best_chunk_score"), F.sum((F.col("score") >= evidence_from - 1e-6).cast("int")).alias("evidence"))
    stage1 = papers.withColumn("norm", min_max(F.col("score"))).withColumnRenamed("score", "paper_score")
    blended = stage1.join(chunks, ["query_id", "paper_id"], "left").withColumn("best_chunk_score", F.coalesce("best_chunk_score", F.lit(0.0)))
    scored = blended.withColumn("score", F.round(alpha * F.col("norm") + (1 - alpha) * F.col("best_chunk_score"), 6))
    return top_k(scored, k, doc="paper_id").select("query_id", "paper_id", "score", "rank", F.round("best_chunk_score", 6).alias("best_chunk_score"), F.coalesce("evidence", F.lit(0)).alias("evidence"))


def author_boost(results: DataFrame, boost: float = 1.2, places: int = 6) -> DataFrame:
    """results (query_text, lastnames, score): times boost where a last name is a word of the query."""
    edge = r"(^|[^\p{L}\p{N}_])"
    form = lambda x: F.concat(F.lit(edge), F.regexp_replace(F.lower(x), r"([^\p{L}\p{N}_\s])", r"\\$1"), F.lit(r"($|[^\p{L}\p{N}_])"))
    named = F.exists("lastnames", lambda x: F.regexp_like(F.lower(F.col("query_text")), form(x)))
    return results.withColumn("author_match", F.coalesce(named, F.lit(False))).withColumn("score", F.round(F.when(F.col("author_match"), F.col("score") * boost).otherwise(F.col("score")), places))


def hybrid(tiers: DataFrame, queries: DataFrame, documents: DataFrame, k: int = 10, fusion: str = "rrf", rrf_k: int = 10, weights: dict[str, float] | None = None, boost: float = 1.2, graph: DataFrame | None = None, graph_boost: float = 1.1, deduplicate: bool = False) -> DataFrame:
    """Ranked lists of several retrievers (query_id, doc_id, tier, rank, score) fused, boosted and cut: (query_id, doc_id, score, rank).

    queries: (query_id, text); documents: (doc_id, lastnames, title_key, has_abstract).
    Scores are multiplied by boost where a last name is a word of the query and by
    graph_boost where the document's graph score (graph: doc_id, graph_score) is above the
    upper quartile of the query's results; of equal titles one stays, from twice k. Lists
    should hold 3 * candidates(k) results, so that boosts can bring some up.
    """
    fused = rrf(tiers, rrf_k, weights) if fusion == "rrf" else weighted_fusion(tiers, weights or {})
    known = fused.select("query_id", "doc_id", "score").join(documents, "doc_id", "left").join(queries.select("query_id", F.col("text").alias("query_text")), "query_id")
    scored = author_boost(known, boost, places=9) if boost > 1 else known
    if graph is not None:
        scored = scored.join(graph.select("doc_id", "graph_score"), "doc_id", "left").withColumn("graph_score", F.coalesce("graph_score", F.lit(0.0)))
        limit = upper_quartile_rank(scored, "query_id", "graph_score")
        high = (F.col("threshold") > 0) & (F.col("graph_score") >= F.col("threshold"))
        scored = scored.join(limit, "query_id").withColumn("score", F.round(F.when(high, F.col("score") * graph_boost).otherwise(F.col("score")), 9))
    best = top_k(scored, 2 * k if deduplicate else k)
    if deduplicate:
        whole = best.select("query_id", "doc_id", "score", "rank", F.coalesce("title_key", F.lit("")).alias("title_key"), F.coalesce("has_abstract", F.lit(False)).alias("has_abstract"))
        best = deduplicate_titles(whole).filter(F.col("rank") <= k)
    return best.select("query_id", "doc_id", "score", "rank")


def candidates(k: int, boosted: bool = True) -> int:
    """How many results each retriever of a hybrid is asked for: three times what is fused, which is twice k with boosts or deduplication."""
    return 3 * (2 * k if boosted else k)


def upper_quartile_rank(values: DataFrame, group: str, value: str) -> DataFrame:
    """sorted[int(n * 0.75)] of the positive values, 0 with fewer than four; ranks, so no group is collected."""
    positive = values.filter(F.col(value) > 0)
    n = positive.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    ranked = positive.withColumn("r", F.row_number().over(W.partitionBy(group).orderBy(value)))
    at = ranked.join(n, group).filter((F.col("n") >= 4) & (F.col("r") == F.floor(F.col("n") * 0.75) + 1)).select(group, F.col(value).alias("threshold"))
    return values.select(group).distinct().join(at, group, "left").select(group, F.coalesce("threshold", F.lit(0.0)).alias("threshold"))


def deduplicate_titles(results: DataFrame, close: float = 0.95) -> DataFrame:
    """One result a query and title key, in the order of their ranks; results without a key all stay.

    results: (query_id, doc_id, score, rank, title_key, has_abstract). The best copy of a
    title stands for it, unless it lacks an abstract: then the next one that has an
    abstract and more than close of its score does.
    """
    copies = W.partitionBy("query_id", "title_key").orderBy("rank")
    whole = copies.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first_score, first_has = F.first("score").over(whole), F.first("has_abstract").over(whole)
    better = F.col("has_abstract") & ~first_has & (first_score > 0) & (F.col("score") > close * first_score)
    chosen = results.withColumn("_better", better).withColumn("_rank", F.coalesce(F.min(F.when(F.col("_better"), F.col("rank"))).over(whole), F.min("rank").over(whole)))
    kept = chosen.filter((F.col("rank") == F.col("_rank")) | (F.col("title_key") == "")).drop("_better", "_rank")
    return kept.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).select(*results.columns)


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Per query: recall@k, reciprocal rank and nDCG@10 with binary gain; queries without relevant documents are left out."""
    n = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    hits = ranked.join(relevant, ["query_id", "doc_id"])
    per = hits.groupBy("query_id").agg(
        *(F.sum((F.col("rank") <= k).cast("int")).alias(f"hits_{k}") for k in ks),
        F.min("rank").alias("first"),
        F.sum(F.when(F.col("rank") <= 10, 1 / F.log2(F.col("rank") + 1))).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_relevant", F.lit(10)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    return n.join(per, "query_id", "left").select(
        "query_id",
        *(F.round(F.coalesce(F.col(f"hits_{k}"), F.lit(0)) / F.col("n_relevant"), 6).alias(f"recall_{k}") for k in ks),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"),
        F.round(F.coalesce(F.col("dcg"), F.lit(0.0)) / ideal, 6).alias("ndcg_10"),
    )


def bootstrap_interval(scores: pd.Series | np.ndarray, resamples: int = 10_000, seed: int = 42) -> tuple[float, float]:
    """95 % interval of the mean of per-query scores."""
    values = np.asarray(scores, dtype=np.float64)
    if not len(values):
        return 0.0, 0.0
    rng = np.random.default_rng(seed)
    means = values[rng.integers(0, len(values), (resamples, len(values)))].mean(1)
    return tuple(float(x) for x in np.percentile(means, [2.5, 97.5]))
