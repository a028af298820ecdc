from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from folio.functions import prose
from folio.functions.stem import stem, stemmed
from folio.operators.files import match_files


@pytest.mark.parametrize(
    "word,want",
    [
        ("running", "run"), ("happily", "happili"), ("generously", "generous"), ("conditional", "condit"), ("skies", "sky"), ("dying", "die"), ("ties", "tie"), ("cries", "cri"), ("gas", "gas"), ("gaps", "gap"), ("kiwis", "kiwi"), ("hopping", "hop"), ("hoping", "hope"), ("agreed", "agre"), ("luxuriated", "luxuri"),
        ("relational", "relat"), ("sensitivities", "sensit"), ("consign", "consign"), ("consisted", "consist"), ("knightly", "knight"), ("replacement", "replac"), ("adoption", "adopt"), ("news", "news"), ("proceed", "proceed"), ("by", "by"), ("enjoy", "enjoy"), ("generations", "generat"), ("communities", "communiti"), ("fall", "fall"), ("controlled", "control"),
    ],
)
def test_stem(word, want):
    assert stem(word) == want


def test_stemmed_column(spark):
    df = spark.createDataFrame([(["running", "models"],), ([],), (None,)], "t array<string>")
    assert [r[0] for r in df.select(stemmed(F.col("t"))).collect()] == [["run", "model"], [], None]


def test_sentences(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    text = F.lit('See Fig. 3 for this. "Quoted" next, cf. Smith et al. Here it ends. Dr. Lee came.')
    assert one(prose.cautious_sentences(text)) == ["See Fig. 3 for this.", '"Quoted" next, cf. Smith et al. Here it ends.', "Dr. Lee came."]
    assert one(prose.cautious_sentences(F.lit("It was studied. Then it rained."))) == ["It was studied. Then it rained."]
    assert one(prose.cautious_sentences(F.lit("It was studied. Then it rained."), strict=True)) == ["It was studied.", "Then it rained."]
    assert one(prose.highlight(F.lit("a b c"), F.lit("b"))) == "a **b** c" and one(prose.highlight(F.lit("a c"), F.lit("b"))) == "b"
    assert [one(prose.arxiv_month(F.lit(x))) for x in ("0808.0242", "gr-qc/9808081", "2103")] == ["0808", "9808", "2103"]
    ids = one(prose.identifiers(F.lit("https://doi.org/10.1038%2Fs41?x=1")))
    assert ids.doi == "10.1038/s41" and ids.arxiv_id is None and one(prose.identifiers(F.lit("http://arxiv.org/abs/2103.13020v2"))).arxiv_id == "2103.13020"
    latex = "\\documentclass{a}\\begin{document}\\section{One} Some \\emph{text} \\cite{k} here. % note\n\\begin{equation}x\\end{equation} And $y$ more.\\end{document}"
    assert one(prose.strip_latex(F.lit(latex))).split("\n\n")[0] == "One" and "Some text here." in one(prose.strip_latex(F.lit(latex))) and "note" not in one(prose.strip_latex(F.lit(latex)))
    assert one(prose.prompt("Do it.", title=F.lit("T"), abstract=F.lit(""))) == "Do it.\n\nTitle: T"
    df = spark.createDataFrame([(["a", "b", "c", "d", "e"], 2)], "s array<string>, c int")
    assert df.select(prose.cursor_window("s", "c", 3)).first()[0] == "b c d"


def test_match_files(spark):
    papers = [
        ("p1", "Climate change and tropical forests of the world", ["Smith, Jane"], 2020, "10.1038/s41-02", "Smith2020"), ("p2", "Neural ranking models in practice", ["Ann Lee"], 2022, None, "x"), ("p3", "Another study about the deep oceans", ["Kim, B."], 2019, "10.5555/ab.1", None),
        ("p4", "Climate change and tropical forests of the world", ["Smith, Jane"], 2020, None, None), ("p5", "Rivers", ["Brook, C."], 2001, None, None), (None, "Rivers", None, None, None, None),
    ]
    files = ["a/smith2020.pdf", "Climate_change_and_tropical_forests_of_the_world.pdf", "neural models practice ranking.pdf", "10.5555_ab.1.pdf", "Brook 2001.pdf", "unrelated.pdf", "", "unrelated.pdf", None]
    p = spark.createDataFrame(papers, "id string, title string, authors array<string>, year int, doi string, bibtex_key string")
    got = {r.paper_id: (r.file, r.rule) for r in match_files(spark.createDataFrame([(f,) for f in files], "file string"), p).collect()}
    assert got == {"p1": (files[0], "key"), "p3": (files[3], "doi"), "p4": (files[1], "title"), "p2": (files[2], "words"), "p5": (files[4], "author_year")}
    assert match_files(spark.createDataFrame([], "file string"), p).count() == 0


def test_match_files_by_common_words_and_parts(spark):
    """Words above common, a name that is a later part of a title or a short one, text around a DOI."""
    papers = [(f"p{i}", f"Wide deep {w} basin", ["Nobody, N."], 0, None, None) for i, w in enumerate(("river", "ocean", "valley", "forest"))]
    papers += [("q1", "A long account of glacial sediment cores", ["Nobody, N."], 0, None, None), ("q2", "All about Zyxw in the field", ["Nobody, N."], 0, None, None), ("q3", "Quite something else", ["Nobody, N."], 0, "10.5555/cd-7", None)]
    files = ["basin deep wide.pdf", "glacial_sediment.pdf", "zyxw.pdf", "copy of 10.5555_cd-7_final.pdf"]
    p = spark.createDataFrame(papers, "id string, title string, authors array<string>, year int, doi string, bibtex_key string")
    got = {r.file: (r.paper_id, r.rule) for r in match_files(spark.createDataFrame([(f,) for f in files], "file string"), p, common=2).collect()}
    assert got == {files[0]: ("p0", "words"), files[1]: ("q1", "title"), files[2]: ("q2", "title"), files[3]: ("q3", "doi")}


def greedy(pairs):
    taken, out = set(), {}
    for p in sorted({a for a, _ in pairs}):
        for f in sorted(b for a, b in pairs if a == p):
            if f not in taken:
                taken.add(f)
                out[p] = f
                break
    return out


def test_files_go_to_papers_in_their_order(spark):
    import random

    from folio.operators.files import _one_to_one

    rnd = random.Random(4)
    cases = [[("p1", "a"), ("p2", "a"), ("p2", "b"), ("p3", "b")], [(f"p{i}", f"f{j}") for i in range(3) for j in range(5)]]
    cases.append([(f"p{rnd.randrange(12):02d}", f"f{rnd.randrange(12):02d}") for _ in range(40)])
    for pairs in cases:
        got = {r.paper_id: r.file for r in _one_to_one(spark.createDataFrame(pairs, "paper_id string, file string")).collect()}
        assert got == greedy(pairs)


def test_titles_of_many_papers_are_matched(spark):
    papers = [(f"p{i:03d}", "Wide deep river basins", ["Nobody, N."], 0, None, None) for i in range(300)]
    p = spark.createDataFrame(papers, "id string, title string, authors array<string>, year int, doi string, bibtex_key string")
    got = match_files(spark.createDataFrame([("basins of the deep wide river.pdf",)], "file string"), p).collect()
    assert [(r.paper_id, r.file, r.rule) for r in got] == [("p000", "basins of the deep wide river.pdf", "words")]


def test_cut_keeps_the_marked_part(spark):
    def cut(text, most):
        return spark.range(1).select(prose.highlight_cut(F.lit(text), most)).first()[0]

    text = "a" * 30 + " " + "b" * 50 + " **" + "c" * 20 + "** " + "d" * 80
    got = cut(text, 60)
    assert "**" + "c" * 20 + "**" in got and got.startswith("...") and got.endswith("...") and len(got) <= 66
    assert cut("x" * 50, 20) == "x" * 20 + "..." and cut("**a** b", 60) == "**a** b" and cut("**a b", 60) == "**a b"
