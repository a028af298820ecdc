"""Matching files to papers by what their names hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions.text import last_name
from folio.operators.metadata import jaccard, word_set
from folio.session import cut_lineage


def _squeezed(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def _one_to_one(candidates: DataFrame) -> DataFrame:
    """Greedy in paper order, each paper taking its first file that is left.

    Papers that all share the same files (copies of a title) are settled at once, the
    n-th paper with the n-th file. The others take rounds in which a pair is kept if it is
    the first of its paper and the first of its file among all open pairs; the least open
    paper is always settled, and in practice nearly all are.
    """
    pairs = candidates.distinct()
    of_paper, of_file = (F.bit_xor(F.xxhash64(c)).over(W.partitionBy(by)) for c, by in (("file", "paper_id"), ("paper_id", "file")))
    signed = cut_lineage(pairs.withColumn("_p", of_paper.cast("string")).withColumn("_f", of_file.cast("string")).withColumn("_d", F.count(F.lit(1)).over(W.partitionBy("file"))))
    alike = signed.groupBy("_p").agg(F.count_distinct("_f").alias("_kinds"), F.count_distinct("paper_id").alias("_n"), F.count_distinct("file").alias("_m"), F.max("_d").alias("_d"), F.count(F.lit(1)).alias("_all"))
    whole = signed.join(alike.filter("_kinds = 1 and _n * _m = _all and _d = _n").select("_p"), "_p", "left_semi")
    ranked = whole.withColumn("_i", F.dense_rank().over(W.partitionBy("_p").orderBy("paper_id"))).withColumn("_j", F.dense_rank().over(W.partitionBy("_p").orderBy("file")))
    kept = cut_lineage(ranked.filter("_i = _j").select("paper_id", "file"))
    open_pairs = cut_lineage(signed.join(whole.select("_p").distinct(), "_p", "left_anti").select("paper_id", "file"))
    while not open_pairs.isEmpty():
        first_file = F.row_number().over(W.partitionBy("paper_id").orderBy("file"))
        first_paper = F.row_number().over(W.partitionBy("file").orderBy("paper_id"))
        won = cut_lineage(open_pairs.withColumn("_i", first_file).withColumn("_j", first_paper).filter("_i = 1 and _j = 1").select("paper_id", "file"))
        kept = kept.unionByName(won)
        open_pairs = cut_lineage(open_pairs.join(won.select("paper_id"), "paper_id", "left_anti").join(won.select("file"), "file", "left_anti"))
    return kept


def _rarest(rows: DataFrame, key: str, words: str, counts: DataFrame) -> DataFrame:
    """rows (key, words) -> (key, words, w, n), one row for each of the rarest words that a match must share one of.

    Half of either's words and three at least are in common, so in one order of all words
    both sides have the first common word among these.
    """
    each = rows.select(key, words, F.explode(words).alias("w")).join(counts, "w", "left").select(key, words, F.struct(F.coalesce("n", F.lit(0)).alias("n"), "w").alias("_r"))
    ranked = each.groupBy(key, words).agg(F.array_sort(F.collect_list("_r")).alias("_r"))
    length = F.size(words) - F.greatest(F.ceil(F.size(words) / 2), F.lit(3)).cast("int") + 1
    return ranked.filter(F.size(words) >= 3).select(key, words, F.explode(F.slice("_r", F.lit(1), length)).alias("_r")).select(key, words, "_r.w", "_r.n")


def match_files(files: DataFrame, papers: DataFrame, common: int = 200) -> DataFrame:
    """(file) and papers (id, title, authors, year, doi, bibtex_key) -> (paper_id, file, rule), each at most once.

    Five passes over what is still open: citation key; DOI in the name; the title's
    first 40 characters; half of the words in common and three at least; first author
    and year. Papers come in the order of their ids, files in the order of their names.
    Every pass is an equi join: on the key, on every beginning of what follows a 10. in
    the name, on ten characters of the title or of the name (fewer for shorter names), on
    the rarest words of both, on author and year. Titles with a word of more than common
    titles meet the files in blocks of about so many. A name without letters a-z and
    digits holds no title.
    """
    f = files.filter("file <> ''").select("file").distinct().withColumn("stem", F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[A-Za-z0-9]{1,5}$", ""))
    p = papers.filter("id is not null and title is not null")
    squeezed_title = _squeezed(F.col("title"))
    counts = p.select(F.explode(word_set(F.col("title"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    author = _squeezed(last_name(F.get("authors", F.lit(0))))
    found, of, op = [], f, p

    def settle(rule: str, pairs: DataFrame) -> None:
        nonlocal of, op
        won = cut_lineage(_one_to_one(pairs.select(F.col("id").alias("paper_id"), "file")).withColumn("rule", F.lit(rule)))
        found.append(won)
        of = of.join(won.select("file"), "file", "left_anti")
        op = op.join(won.select(F.col("paper_id").alias("id")), "id", "left_anti")

    settle("key", op.filter("bibtex_key <> ''").withColumn("k", _squeezed(F.col("bibtex_key"))).filter("k <> ''").join(of.withColumn("k", _squeezed(F.col("stem"))), "k"))
    flat = lambda c: F.regexp_replace(F.lower(c), "[/:.-]", "_")
    named = of.withColumn("s", flat("stem")).withColumn("at", F.explode(F.sequence(F.lit(1), F.greatest(F.length("s"), F.lit(1))))).filter(F.substr("s", F.col("at"), F.lit(3)) == "10_")
    named = named.withColumn("k", F.explode(F.transform(F.sequence(F.lit(3), F.length("s") - F.col("at") + 1), lambda n: F.substr("s", F.col("at"), n))))
    settle("doi", op.filter("length(doi) >= 5").withColumn("k", flat(F.regexp_extract("doi", "(10[.].*)$", 1))).filter("k <> ''").join(named, "k").select("id", "file"))
    starts = of.withColumn("s", _squeezed(F.col("stem"))).withColumn("at", F.explode(F.sequence(F.lit(1), F.greatest(F.length("s") - 9, F.lit(1))))).withColumn("k", F.substr("s", F.col("at"), F.lit(10))).filter("length(k) = 10")
    titles = op.withColumn("t", squeezed_title).filter("length(t) >= 10").withColumn("k", F.left("t", F.lit(10)))
    in_name = titles.join(starts, "k").filter(F.col("s").contains(F.left("t", F.lit(40)))).select("id", "file")
    parts = of.withColumn("s", _squeezed(F.col("stem"))).filter("s <> ''").withColumn("k", F.left("s", F.lit(10)))
    lengths = [x[0] for x in parts.select(F.length("k")).distinct().collect()]
    places = titles.select("id", "t", F.explode(F.sequence(F.lit(1), F.length("t"))).alias("at")).select("id", "t", F.explode(F.array(*(F.substr("t", F.col("at"), F.lit(n)) for n in lengths)) if lengths else F.array().cast("array<string>")).alias("k")).distinct()
    settle("title", in_name.unionByName(places.join(parts, "k").filter(F.col("t").contains(F.col("s"))).select("id", "file")))
    blocks = F.ceil(F.greatest("n", F.lit(1)) / common).cast("int")
    pw = _rarest(op.select("id", word_set(F.col("title")).alias("a")), "id", "a", counts).withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int")).drop("n")
    fw = _rarest(of.select("file", word_set(F.regexp_replace("stem", "_", " ")).alias("b")), "file", "b", counts).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("n")
    settle("words", pw.join(fw, ["w", "block"]).filter((jaccard(F.col("a"), F.col("b")) >= 0.5) & (F.size(F.array_intersect("a", "b")) >= 3)))
    years = of.withColumn("y", F.explode(F.regexp_extract_all("stem", F.lit(r"((?:19|20)[0-9]{2})"), F.lit(1)))).withColumn("n", F.explode(F.array_distinct(F.split(F.lower("stem"), "[^a-z]+"))))
    settle("author_year", op.filter("year <> 0").withColumn("n", author).filter("length(n) >= 3").withColumn("y", F.col("year").cast("string")).join(years, ["n", "y"]))
    return reduce(DataFrame.unionByName, found)
