"""Citation exports as columns: BibTeX, RIS, plain text and templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import escape_latex, last_name, missing


def _field(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"  {name} = {{"), value, F.lit("}")))


def citation_key() -> Column:
    """The given key, else author, year and the first title word of three letters; else the id."""
    words = F.filter(F.transform(F.split("title", r"\s+"), lambda x: F.regexp_replace(x, "[^a-zA-Z]", "")), lambda x: F.length(x) >= 3)
    author = F.when(F.size("authors") > 0, last_name(F.get("authors", F.lit(0))))
    made = F.regexp_replace(F.lower(F.concat_ws("", author, F.when(F.col("year") != 0, F.col("year").cast("string")), F.get(words, F.lit(0)))), "[^a-z0-9]", "")
    return F.coalesce(missing(F.col("bibtex_key")), missing(made), F.col("id"))


def bibtex_entry() -> Column:
    authors = F.when(F.size("authors") > 0, escape_latex(F.array_join("authors", " and ")))
    fields = F.concat_ws(
        ",\n",
        _field("title", escape_latex(F.col("title"))),
        _field("author", authors),
        _field("year", F.col("year").cast("string")),
        _field("journal", escape_latex(missing(F.col("journal")))),
        _field("doi", missing(F.col("doi"))),
        _field("abstract", escape_latex(missing(F.col("abstract")))),
    )
    return F.concat(F.lit("@article{"), citation_key(), F.lit(",\n"), fields, F.lit("\n}"))


def ris_record() -> Column:
    line = lambda tag, v: F.when(v.isNotNull(), F.concat(F.lit(f"{tag}  - "), v))
    authors = F.when(F.size("authors") > 0, F.array_join(F.transform("authors", lambda a: F.concat(F.lit("AU  - "), a)), "\n"))
    return F.concat_ws("\n", F.lit("TY  - JOUR"), line("TI", F.col("title")), authors, line("PY", F.col("year").cast("string")), line("DO", missing(F.col("doi"))), line("JO", missing(F.col("journal"))), line("AB", missing(F.col("abstract"))), F.lit("ER  - "))


def plain_entry() -> Column:
    """Names, (year) or (n.d.), title, journal and DOI address."""
    names = F.transform("authors", last_name)
    n = F.size(names)
    people = F.when(n <= 0, None).when(n <= 2, F.array_join(names, " & ")).otherwise(F.concat(F.array_join(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(", & "), F.element_at(names, -1)))
    year = F.when(F.col("year").isNotNull(), F.concat(F.lit("("), F.col("year").cast("string"), F.lit(")."))).otherwise("(n.d.).")
    return F.concat_ws(" ", people, year, F.concat("title", F.lit(".")), F.concat(missing(F.col("journal")), F.lit(".")), F.concat(F.lit("https://doi.org/"), missing(F.col("doi"))))


def grouped_citation(papers: DataFrame, group: str, style: str = "latex") -> DataFrame:
    """One reference string a group: \\cite{a,b} or [@a; @b], keys in order."""
    keys = F.array_sort(F.collect_set(F.coalesce(missing(F.col("bibtex_key")), F.col("id"))))
    text = F.concat(F.lit("\\cite{"), F.array_join(keys, ","), F.lit("}")) if style == "latex" else F.concat(F.lit("[@"), F.array_join(keys, "; @"), F.lit("]"))
    return papers.groupBy(group).agg(text.alias("citation"))


def write_lines(papers: DataFrame, entry: Column, path: str) -> None:
    """One entry a record, blank lines between, through the commit protocol of the sink."""
    papers.select(F.concat(entry, F.lit("\n")).alias("value")).write.mode("overwrite").text(path)
