"""Sentences with abbreviations, cursor windows, highlights, LaTeX and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations whose full stop doesn't end a sentence. As there is no word
# border in front, any word with such an ending is protected too; strict asks for the border.
ABBREVIATIONS = r"(Dr|Mr|Mrs|Ms|Prof|Sr|Jr|etc|Fig|Figs|Eq|Eqs|al|vs|i\.e|e\.g|cf|no|vol|pp|ed|Rev|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"


def cautious_sentences(text: Column, strict: bool = False) -> Column:
    """Sentences cut in front of a capital or a quote, but not behind an abbreviation."""
    border = r"(?i)\b" if strict else "(?i)"
    kept = F.regexp_replace(text, border + ABBREVIATIONS + r"\.\s*", "$1\u0001")
    # An abbreviation with an inner full stop is protected as a whole.
    kept = F.regexp_replace(F.regexp_replace(kept, "(?i)(i)\\.(e)\u0001", "$1\u0001$2\u0001"), "(?i)(e)\\.(g)\u0001", "$1\u0001$2\u0001")
    parts = F.split(kept, r"(?<=[.!?])\s+(?=[A-Z\"])")
    return F.filter(F.transform(parts, lambda s: F.trim(F.replace(s, F.lit("\u0001"), F.lit(". ")))), lambda s: s != "")


def cursor_window(sentences: str, cursor: str, n: int) -> Column:
    """n sentences around the sentence number cursor (from 0), half of them before it."""
    return F.expr(f"array_join(slice({sentences}, greatest(1, {cursor} + 1 - {n // 2}), least({n}, greatest(1, size({sentences})))), ' ')")


def highlight(parent: Column, focus: Column) -> Column:
    """The focus within its parent in **; the focus alone where the parent lacks it."""
    at = F.instr(parent, focus)
    marked = F.concat(F.left(parent, at - 1), F.lit("**"), focus, F.lit("**"), F.substr(parent, at + F.length(focus)))
    return F.when((F.coalesce(parent, F.lit("")) != "") & (F.coalesce(at, F.lit(0)) > 0), marked).otherwise(focus)


def highlight_cut(text: Column, most: int) -> Column:
    """Text with its ** part kept whole: 30 % of the room that part leaves of most goes before it, the rest behind.

    Without a marked part, the first most characters. A cut beginning goes on behind the
    next blank if that is near.
    """
    first = F.instr(text, F.lit("**"))
    last = F.when(first > 0, F.instr(F.substr(text, first + 2), F.lit("**"))).otherwise(0)
    end = first + 2 + last  # the place of the closing mark's second star
    room = most - (end - first + 1)
    before = F.floor(room * 0.3).cast("int")
    start = F.greatest(F.lit(1), first - before)
    stop = F.least(F.length(text), end + room - before)
    inner = F.substr(text, start, stop - start + 1)
    blank = F.instr(inner, F.lit(" "))
    shown = F.when(start > 1, F.concat(F.lit("..."), F.when((blank > 1) & (blank <= 20), F.substr(inner, blank + 1)).otherwise(inner))).otherwise(inner)
    plain = F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)
    return F.when((first == 0) | (last == 0), plain).otherwise(F.concat(shown, F.when(stop < F.length(text), F.lit("...")).otherwise("")))


def arxiv_month(arxiv_id: Column) -> Column:
    """YYMM of a new (0808.0242) or old (hep-th/0301150) identifier."""
    return F.when(arxiv_id.contains("/"), F.left(F.split_part(arxiv_id, F.lit("/"), F.lit(2)), F.lit(4))).when(arxiv_id.contains("."), F.split_part(arxiv_id, F.lit("."), F.lit(1))).otherwise(F.left(arxiv_id, F.lit(4)))


def identifiers(url: Column) -> Column:
    """(doi, arxiv_id) that an address names."""
    plain = F.url_decode(url)
    doi = F.regexp_extract(plain, r"(?i)doi\.org/(10\.[0-9]{4,9}/[^?#\s]+)", 1)
    arxiv = F.regexp_extract(plain, r"(?i)arxiv\.org/(?:abs|pdf)/([a-z.-]*/?[0-9.]+?[0-9])(?:v[0-9]+)?(?:\.pdf)?(?:[?#].*)?$", 1)
    return F.struct(F.when(doi != "", doi).alias("doi"), F.when(arxiv != "", arxiv).alias("arxiv_id"))


def strip_latex(text: Column) -> Column:
    """Plain paragraphs of a LaTeX body: comments, environments of floats and mathematics, commands and braces go."""
    body = F.regexp_extract(text, r"(?s)\\begin\{document\}(.*?)(?:\\end\{document\}|$)", 1)
    out = F.when(body != "", body).otherwise(text)
    for pattern, with_ in (
        (r"(?m)(?<!\\)%.*$", ""), (r"(?s)\\begin\{thebibliography\}.*", ""), (r"(?s)\\bibliography\{.*", ""), (r"(?s)\\begin\{(figure|table|equation|align|eqnarray|displaymath)(\*?)\}.*?\\end\{\1\2\}", " "), (r"(?s)\$\$.*?\$\$|\$[^$]*\$", " "),
        (r"\\(?:cite|ref|label|eqref|citep|citet)[a-z]*(?:\[[^\]]*\])*\{[^}]*\}", ""), (r"\\(?:section|subsection|subsubsection|paragraph)\*?\{([^}]*)\}", "\n\n$1\n\n"), (r"\\(?:textit|textbf|emph|text|textrm|mbox)\{([^{}]*)\}", "$1"), (r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?", " "), (r"[{}]", ""), (r"[ \t]+", " "),
    ):
        out = F.regexp_replace(out, pattern, with_)
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def prompt(instruction: str, **parts: Column) -> Column:
    """An instruction followed by its named parts, each on its lines; missing ones are left out."""
    return F.concat_ws("\n\n", F.lit(instruction), *(F.when(v != "", F.concat(F.lit(f"{k.replace('_', ' ').capitalize()}: "), v)) for k, v in parts.items()))


def as_json(*columns: str) -> Column:
    """A row as JSON without its nulls."""
    return F.to_json(F.struct(*columns))
