from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folio.functions import text as X
from folio.operators import chunking, metadata, models, retrieval, upsert
from folio.operators.components import connected_components
from folio.operators.orphans import contiguous_runs, orphan_references
from folio.operators.prefix import running_total

T0 = datetime(2024, 1, 1)
REF = "src_table string, row_key string, missing_id string, created_at timestamp"


def test_orphans_against_brute_force(spark):
    rnd = random.Random(1)
    ids = [f"p{n:09d}" for n in [*range(10, 60), *range(65530, 65545), *range(10**6, 10**6 + 30, 3)]] + ["odd-key", "P000000011", "p11", "x99999999999999999999"]
    parents = [(i, T0 + timedelta(days=rnd.randrange(100))) for i in ids if rnd.random() < 0.7 for _ in range(rnd.choice([1, 2]))] + [(None, T0), ("p000000012", None)]
    deleted = [(i, T0 + timedelta(days=50)) for i in ids if rnd.random() < 0.2]
    refs = [(rnd.choice("ab"), f"r{rnd.randrange(40)}", rnd.choice([*ids, None, "", "p000000061", "never"]), rnd.choice([None, T0 + timedelta(days=rnd.randrange(100))])) for _ in range(400)]
    refs += refs[:50]
    got = orphan_references(
        spark.createDataFrame(refs, REF).withColumn("id", F.lit("clash")), spark.createDataFrame(parents, "id string, added_at timestamp").withColumn("created_at", F.lit(None)), spark.createDataFrame(deleted, "paper_id string, deleted_at timestamp").withColumn("id", F.lit(1))
    )
    got = {(r.src_table, r.row_key, r.missing_id, r.kind) for r in got.collect()}
    added = {}
    for i, t in parents:
        if i is not None:
            added.setdefault(i, []).append(t)
    gone = dict(deleted)
    want = set()
    first = {}
    for s, k, m, t in refs:
        if m:
            old = first.get((s, k, m))
            first[s, k, m] = t if old is None else old if t is None else min(old, t)
    for (s, k, m), t in first.items():
        times = [x for x in added.get(m, []) if x]
        if m in gone and not any(x >= gone[m] for x in times):
            want.add((s, k, m, "deleted"))
        elif m not in added:
            want.add((s, k, m, "missing"))
        elif times and t and min(times) > t:
            want.add((s, k, m, "late"))
    assert got == want and {k[3] for k in want} == {"deleted", "missing", "late"}


def test_orphans_of_empty_tables(spark):
    refs = spark.createDataFrame([], REF)
    parents, deleted = spark.createDataFrame([], "id string, added_at timestamp"), spark.createDataFrame([], "paper_id string, deleted_at timestamp")
    assert orphan_references(refs, parents, deleted).count() == 0
    some = spark.createDataFrame([("a", "r", "p1", T0)], REF)
    assert [r.kind for r in orphan_references(some, parents, deleted).collect()] == ["missing"]


def test_runs_are_contiguous_and_cut_at_buckets(spark):
    df = spark.createDataFrame([(f"p{n:09d}",) for n in [*range(65530, 65540), 70000]], "id string")
    runs = {(r.run_start, r.run_end) for r in contiguous_runs(df, "id").collect()}
    assert runs == {(65530, 65535), (65536, 65539), (70000, 70000)}


def test_running_total(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice("ab"), i, rnd.choice([None, rnd.randrange(9)])) for i in range(300)]
    got = {(r.g, r.i): r.s for r in running_total(spark.createDataFrame(rows, "g string, i int, v int"), ["g"], F.expr("i div 7"), ["i"], "v", "s").collect()}
    total = {"a": 0, "b": 0}
    for g, i, v in rows:
        total[g] += v or 0
        assert got[g, i] == total[g]
    assert running_total(spark.createDataFrame([], "g string, i int, v int"), ["g"], F.col("i"), ["i"], "v", "s").count() == 0


def test_components_against_union_find(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 130)] + [(5, 5), (None, 3), (200, 201), (200, 201)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


@pytest.mark.parametrize(
    "text,heading", [("1. Introduction", True), ("2 METHODS", True), ("IV. Results", True), ("Related Work", True), ("DATA AND TOOLS", True), ("NASA", False), ("414 B. Rabe", False), ("A sentence that ends.", False), ("Ab", False), ("x" * 120, False)]
)
def test_headings(spark, text, heading):
    assert spark.range(1).select(X.looks_like_heading(F.lit(text))).first()[0] is heading


@pytest.mark.parametrize("section,yes", [("References", True), ("7. References", True), ("VIII. Bibliography", True), ("References and Notes", True), ("Results", False), (None, False), ("", False)])
def test_reference_sections(spark, section, yes):
    assert spark.range(1).select(X.is_reference_section(F.lit(section).cast("string"))).first()[0] is yes


def test_text_functions(spark):
    row = spark.range(1).select(
        X.clean_markers(F.lit("As shown [CITE], {{cite:ab12}} it ( ) holds, , well, .")).alias("markers"),
        X.author_string(F.array()).alias("a0"), X.author_string(F.array(F.lit("A"))).alias("a1"), X.author_string(F.array(F.lit("A"), F.lit("B"))).alias("a2"), X.author_string(F.array(F.lit("A"), F.lit("B"), F.lit("C"))).alias("a3"),
        X.last_names(F.array(F.lit("Smith, J."), F.lit("Ann Lee"), F.lit("X"))).alias("names"), X.tokens(F.lit("The Self-Attention of a model (2020)")).alias("tokens"),
        X.confidence(F.create_map(F.lit("neural"), F.lit(0.65), F.lit("bm25"), F.lit(15.0))).alias("c1"), X.confidence(F.create_map(F.lit("bm25"), F.lit(10.0))).alias("c2"),
        X.is_corrupted(F.lit("")).alias("empty"), X.clean_html(F.lit("Some text [1] with citations [2,3].")).alias("html"), X.bare_doi(F.lit("https://doi.org/10.1/x")).alias("doi"), X.paragraphs(F.lit("a\nb\n\n c ")).alias("paras"),
    ).first()
    assert row.markers == "As shown , it holds well" and (row.a0, row.a1, row.a2, row.a3) == ("", "A", "A and B", "A et al.")
    assert row.names == ["Smith", "Lee"] and row.tokens == ["self", "attention", "model", "2020"]
    assert row.c1 == 0.65 and row.c2 == 0.5 and row.empty is True and row.html == "Some text with citations." and row.doi == "10.1/x" and row.paras == ["a b", "c"]


def _bm25_rows(docs, queries, k, b, k1=1.5):
    """Okapi BM25 by hand, of texts whose words are parted by blanks."""
    import math
    from collections import Counter

    tf = {i: Counter(t.split()) for i, t in docs}
    df = Counter(w for c in tf.values() for w in c)
    raw = {w: math.log((len(docs) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    mean = sum(raw.values()) / len(raw)
    avg = sum(sum(c.values()) for c in tf.values()) / len(docs)
    out = []
    for q, text in queries:
        score = lambda c, text=text: sum(n * (raw[w] if raw[w] >= 0 else 0.25 * mean) * c[w] * (k1 + 1) / (c[w] + k1 * (1 - b + b * sum(c.values()) / avg)) for w, n in Counter(text.split()).items() if w in c)
        best = sorted((-round(score(c), 6), i) for i, c in tf.items())
        out += [(q, i, -s, r) for r, (s, i) in enumerate(best[:k], 1) if s < 0]
    return sorted(out)


def test_bm25_in_blocks_without_a_row_a_pair(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "LEXICAL_BLOCK", 500, raising=False)
    rnd = random.Random(3)
    words = [f"w{i}x" for i in range(60)]
    docs = [(i, " ".join(rnd.choices(words, weights=range(1, 61), k=rnd.randrange(1, 30)))) for i in range(300)]
    docs += [(300 + i, docs[i][1]) for i in range(40)]  # ties, also between blocks
    df = spark.createDataFrame(docs, "doc_id long, text string")
    queries = docs[:25]
    got = retrieval.bm25(df.filter("doc_id < 25").withColumnRenamed("doc_id", "query_id"), df, 7)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Aggregate" in x and "query_id" in x and "doc_id" in x for x in plan.splitlines())
    rows = sorted((r.query_id, r.doc_id, r.score, r["rank"]) for r in got.collect())
    assert [(q, d, r) for q, d, _, r in rows] == [(q, d, r) for q, d, _, r in _bm25_rows(docs, queries, 7, 0.75)]
    assert all(abs(x[2] - y[2]) < 2e-6 for x, y in zip(rows, _bm25_rows(docs, queries, 7, 0.75)))


def test_bm25_tiers_split_texts_once(spark, monkeypatch):
    from folio.plans import reference
    from tests.conftest import SMALL

    split = []
    monkeypatch.setattr(retrieval, "cut_lineage", lambda df, cut=retrieval.cut_lineage: split.append(df) or cut(df))
    got = {(r.tier, r.query_id, r.doc_id, r.score, r["rank"]) for r in reference._tiers(spark, SMALL).collect()}
    assert len(split) == 1
    docs, asked = reference._documents(spark, SMALL), reference._document_queries(spark, SMALL)
    assert got == {(tier, r.query_id, r.doc_id, r.score, r["rank"]) for tier, b in (("bm25", 0.75), ("flat", 0.0)) for r in retrieval.bm25(asked, docs, b=b).collect()}


def test_bm25_stemmed_sends_no_table_through_the_driver(spark):
    from folio.plans import reference
    from tests.conftest import SMALL

    assert "Broadcast" not in reference.bm25_stemmed(spark, SMALL)._jdf.queryExecution().executedPlan().toString()


def test_bm25_ties_and_empty(spark):
    docs = spark.createDataFrame([(1, "sea level rise"), (2, "deep learning"), (3, "ocean currents"), (4, "sea level rise"), (5, None), (6, "")], "doc_id long, text string")
    got = retrieval.bm25(spark.createDataFrame([(7, "sea level"), (8, ""), (9, None)], "query_id long, text string"), docs).collect()
    assert [(r.query_id, r.doc_id, r.rank) for r in sorted(got, key=lambda r: r["rank"])] == [(7, 1, 1), (7, 4, 2)]
    assert retrieval.bm25(spark.createDataFrame([], "query_id long, text string"), docs).count() == 0


def test_vectors_in_blocks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 7)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    v = np.random.default_rng(4).normal(size=(50, 6))
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(99, None)]
    df = spark.createDataFrame(rows, "doc_id long, embedding array<float>")
    got = retrieval.vector_top(df.filter("doc_id < 8").withColumnRenamed("doc_id", "query_id"), df, 5, drop_self=True).collect()
    scores = np.round(v.astype(np.float32).astype(float) @ v.astype(np.float32).astype(float).T, 6)
    for q in range(8):
        want = sorted((j for j in range(50) if j != q), key=lambda j: (-scores[q, j], j))[:5]
        assert [r.doc_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want


def test_two_stage_borders(spark):
    papers = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.7), (1, "c", 0.5)], "query_id long, paper_id string, score double")
    hits = spark.createDataFrame([(1, 1, "a", 0.3), (1, 2, "a", 0.2), (1, 3, "b", 0.9), (1, 4, "b", 0.7), (1, 5, "b", 0.4)], "query_id long, chunk_id long, paper_id string, score double")
    order = lambda alpha: [r.paper_id for r in retrieval.two_stage(papers, hits, alpha).orderBy("rank").collect()]
    assert order(1.0) == ["a", "b", "c"] and order(0.0) == ["b", "a", "c"]


def test_title_dedup_order(spark):
    rows = [(1, 10, 1.0, 1, "t", False), (1, 11, 0.98, 2, "t", True), (1, 12, 0.5, 3, "u", False), (1, 13, 0.4, 4, "", False), (2, 14, 1.0, 1, "t", False), (2, 15, 0.5, 2, "t", True)]
    got = retrieval.deduplicate_titles(spark.createDataFrame(rows, "query_id long, doc_id long, score double, rank int, title_key string, has_abstract boolean")).collect()
    assert sorted((r.query_id, r["rank"], r.doc_id) for r in got) == [(1, 1, 11), (1, 2, 12), (1, 3, 13), (2, 1, 14)]


def test_upper_quartile_and_metrics(spark):
    values = spark.createDataFrame([("a", float(i)) for i in range(1, 9)] + [("b", 5.0), ("b", 0.0)], "g string, v double")
    assert {r.g: r.threshold for r in retrieval.upper_quartile_rank(values, "g", "v").collect()} == {"a": 7.0, "b": 0.0}
    low, high = retrieval.bootstrap_interval([0.0, 1.0] * 50)
    assert 0.38 < low < 0.5 < high < 0.62 and retrieval.bootstrap_interval([]) == (0.0, 0.0)


def brute_cutoff(flags):
    if len(flags) < 10:
        return None
    run = gap = 0
    first = None
    for i in range(int(len(flags) * 0.6), len(flags)):
        if flags[i]:
            first = i if run == 0 else first
            run, gap = run + 1, 0
            if run >= 3:
                return first
        elif run >= 2 and gap == 0:
            gap = 1
        else:
            run = gap = 0
    return None


def test_reference_cutoff(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.random() < 0.5 for _ in range(rnd.choice([5, 10, 17, 30]))]) for i in range(150)]
    got = {r.i: r.c for r in spark.createDataFrame(rows, "i int, flags array<boolean>").select("i", chunking.reference_cutoff("flags").alias("c")).collect()}
    assert got == {i: brute_cutoff(f) for i, f in rows}


def test_split_long(spark):
    text = "Aa bb. " * 9 + "Tail."
    df = spark.createDataFrame([(text.strip(),)], "para string")
    parts = df.select(chunking.split_long("para", 30, 8).alias("p")).first().p
    assert all(len(p) <= 36 for p in parts) and " ".join(parts) == text.strip()


def test_paragraph_chunks(spark):
    long = "The survey of many sites found a stable pattern in each of the years that were covered by it, as the following pages describe in more detail for the reader. "
    paras = ["1. Introduction", long, "short", long * 20, "Figure 3. " + long, "References", long]
    df = spark.createDataFrame([("d", paras), ("e", None)], "paper_id string, paragraphs array<string>")
    got = chunking.chunk_paragraphs(chunking.document_paragraphs(df), 500, 100).orderBy("chunk_no").collect()
    assert got[0].section == "1. Introduction" and got[0].char_offset == len("1. Introduction") + 2
    assert [r.chunk_no for r in got] == list(range(len(got))) and all(len(r.text) <= 700 for r in got) and len(got) > 3


def test_citation_windows(spark):
    rows = [("a", "One is. Two is. Three [CITE] is. Four is. Five is.", None), ("b", "Cited [CITE] here. After it.", "A first sentence that is long. Second one.")]
    got = {r.id: r for r in chunking.citation_windows(spark.createDataFrame(rows, "id string, text string, previous_text string")).collect()}
    assert got["a"].narrow == "One is. Two is. Three [CITE] is. Four is."
    assert got["b"].narrow == "A first sentence that is long. Second one. Cited [CITE] here. After it."


def test_upsert_keeps_embeddings_of_same_text(spark):
    old = spark.createDataFrame([("a", "x", "T", [1.0]), ("b", "x", "T", [2.0]), ("d", "z", "T", [4.0])], "id string, text string, title string, emb array<double>")
    new = spark.createDataFrame([("a", "x", "New"), ("b", "y", "New"), ("c", "w", "New")], "id string, text string, title string")
    got = {r.id: (r.title, r.emb, r.needs_embedding) for r in upsert.upsert(old, new, "id", "text", "emb").collect()}
    assert got == {"a": ("New", [1.0], False), "b": ("New", None, True), "c": ("New", None, True), "d": ("T", [4.0], False)}
    assert upsert.safe_to_replace(900, 1) and not upsert.safe_to_replace(2000, 900) and upsert.is_stale(5, 6, "m", "m") and upsert.is_stale(5, 5, "m", "n") and not upsert.is_stale(5, 5, None, "n")


def test_metadata(spark):
    df = spark.createDataFrame([("climate change effects", "effects climate change"), ("abc", "xyz"), (None, "x")], "a string, b string")
    assert [round(r[0]) for r in df.select(metadata.token_sort_ratio(F.col("a"), F.col("b"))).collect()] == [100, 0, 0]
    corpus = spark.createDataFrame([("A Title ", "10.1/X"), ("Other", None)], "title string, doi string")
    items = spark.createDataFrame([(1, "new", "10.1/x"), (2, "a title", None), (3, "new", "10.2/y"), (4, None, None)], "i int, title string, doi string")
    assert {r.i for r in metadata.not_in_corpus(items, corpus).collect()} == {3, 4}


def test_models(spark):
    import numpy as np

    df = models.embed(spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "t string"), "t", lambda: lambda texts: np.stack([models.hash_embedding(t) for t in texts]))
    rows = df.collect()
    assert rows[0].embedding == rows[2].embedding and abs(sum(x * x for x in rows[0].embedding) - 1) < 1e-5
    answers = [("p", "My Title", '```json\n[{"type": "method", "text": "We follow the scheme of [CITE] for all the sites."}, {"type": "method", "text": "Second one of the same type as [CITE] shows."}, {"type": "odd", "text": "Not an allowed type at all [CITE] here."}, {"type": "result", "text": "My title is named here by [CITE] verbatim."}]\n```'), ("q", "T", "no json")]
    got = models.valid_contexts(spark.createDataFrame(answers, "paper_id string, title string, answer string"), ["method", "result"]).collect()
    assert [(r.paper_id, r.type, r.text[:9]) for r in got] == [("p", "method", "We follow")]


def test_reference_lists_are_whole(spark, tmp_path):
    from folio.plans import reference

    spark.range(60).selectExpr("'p' as paper_id", "concat('n', id) as neighbor_id", "cast(id as int) as rank").write.parquet(str(tmp_path / "reference_sets.parquet"))
    assert reference.reference_lists(spark, str(tmp_path)).first().neighbours.split(",") == [f"n{i}" for i in range(60)]


BODY = "The survey of site {} found a stable pattern in each of the years that were covered by it, as the following pages describe in more detail for the reader of the text."
ENTRY = "Smith, J. ({}). On the pattern of {}. Journal of Things, Vol. 3, pp. 4-9. doi: 10.1000/{}"


def test_blank_paragraphs_are_counted_but_no_text(spark):
    body = [BODY.format(i) for i in range(14)]
    entries = [ENTRY.format(1990 + i, i, i) for i in range(4)]
    rows = [("plain", body + entries), ("front", [" "] * 6 + body + entries), ("between", [x for b in body for x in (b, "")] + entries)]
    paras = chunking.document_paragraphs(spark.createDataFrame(rows, "paper_id string, paragraphs array<string>"))
    assert {r.paper_id: r.cutoff for r in chunking.document_cutoffs(paras).collect()} == {"plain": 14, "front": 20, "between": 28}
    for chunks in (chunking.chunk_paragraphs(paras), chunking.chunk_sentences(paras)):
        got = [(r.paper_id, r.chunk_no, r.text) for r in chunks.collect()]
        assert sorted(got) == sorted((p, i, x) for p in ("plain", "front", "between") for i, x in enumerate(body))


def test_sentence_windows_and_places(spark):
    a, b, c = (BODY.format(x) for x in "abc")
    rows = [("d", ["Results", f"{a}  {b}", "Results", c, "References", BODY.format("z")], None, None, "T")]
    df = spark.createDataFrame(rows, "paper_id string, paragraphs array<string>, full_text string, abstract string, title string")
    got = chunking.chunk_sentences(chunking.document_paragraphs(df)).orderBy("chunk_no").collect()
    assert [(r.text, r.previous, r.char_offset) for r in got] == [(a, None, 9), (b, a, 9 + len(a) + 2), (c, None, 9 + len(a) + len(b) + 4 + 9)]
    assert got[1].parent_text == f"{a}  {b}" and got[1].context_text == f"T | Results | {a}" and got[2].context_text == "T | Results"


def test_documents_fall_back_on_text_and_abstract(spark):
    x, y = BODY.format("x"), BODY.format("y")
    rows = [("a", [], f"{x}\r\n\r\n{y}", "no"), ("b", None, None, y), ("c", None, "", ""), ("d", [x], y, y)]
    paras = chunking.document_paragraphs(spark.createDataFrame(rows, "paper_id string, paragraphs array<string>, full_text string, abstract string"))
    assert sorted((r.paper_id, r.pos, r.para, r.n_paras) for r in paras.collect()) == [("a", 0, x, 2), ("a", 1, y, 2), ("b", 0, y, 1), ("d", 0, x, 1)]


def test_structured_pages_keep_their_sections(spark):
    x, y = BODY.format("x"), BODY.format("y")
    df = spark.createDataFrame([("a", [x, y, "References", x], ["Intro", None, "Late"])], "paper_id string, paragraphs array<string>, sections array<string>")
    got = chunking.chunk_paragraphs(chunking.structured_paragraphs(df)).orderBy("chunk_no").collect()
    assert [(r.text, r.section) for r in got] == [(x, "Intro"), (y, "Intro"), (x, "Late")]


def brute_dedup(rows, close=0.95):
    kept = {}
    for i, (score, title, has) in enumerate(rows):
        if not title:
            kept[i] = i
        elif title not in kept:
            kept[title] = i
        else:
            old = rows[kept[title]]
            if has and not old[2] and old[0] > 0 and score > close * old[0]:
                kept[title] = i
    return sorted(kept.values())


def test_title_dedup_against_brute_force(spark):
    rnd = random.Random(9)
    rows, want = [], {}
    for q in range(60):
        found = sorted(((round(rnd.uniform(0.8, 1), 3), rnd.choice(["", "t", "u", "v"]), rnd.random() < 0.4) for _ in range(rnd.randrange(1, 9))), reverse=True)
        rows += [(q, i, s, i + 1, t, h) for i, (s, t, h) in enumerate(found)]
        want[q] = brute_dedup(found)
    got = retrieval.deduplicate_titles(spark.createDataFrame(rows, "query_id long, doc_id long, score double, rank int, title_key string, has_abstract boolean")).orderBy("query_id", "rank").collect()
    assert {q: [r.doc_id for r in got if r.query_id == q] for q in want} == want


def test_components_of_a_long_path(spark):
    edges = spark.range(300).selectExpr("id as a", "id + 1 as b")
    from folio.operators.components import connected_components

    assert {r.component for r in connected_components(edges).collect()} == {0}
