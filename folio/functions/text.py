"""Column functions over titles, names, chunks and query texts.

Patterns are written so that Spark's and other engines' dialects agree: explicit
classes, no lookaround unless noted. Empty strings, empty lists and year 0 count as missing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words left out of lexical retrieval.
STOPWORDS = """a an the and or but if then else when at by for with about against between into through during before after
above below to from up down in out on off over under again further once here there where why how all each few more most
other some such no nor not only own same so than too very can will just should now also as is are was were be been being
have has had having do does did doing would could ought i me my myself we our ours ourselves you your yours yourself
yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom
this that these those am of paper study research work approach method methods propose proposed present presented show
shows shown use used using based results result however therefore thus hence although while since because furthermore
moreover additionally specifically particularly generally typically often usually recently previously first second third
finally example examples e.g i.e et al etc fig figure table section""".split()

# Forms of section headings, references, captions and boilerplate.
HEADING = r"^(\d+\.?\s+[A-Z][a-z]|\d+\.?\s+[A-Z]{2,}|[IVX]+\.?\s+[A-Z]|(Abstract|Introduction|Background|Methods?|Results?|Discussion|Conclusions?|References|Acknowledgments?|Related Work|Appendix|Summary|Overview))"
PAGE_AUTHOR = r"^\d{2,}\s+[A-Z]\.?\s+[A-Z][a-z]+$"
REFERENCE_SECTION = r"^(references|bibliography|works\s+cited|literature\s+cited|cited\s+literature)"
BIB_SIGNALS = [r"\(\d{4}[a-z]?\)", r"\d{4}\.\s", r"doi:\s*10\.", r"https?://", r"\bp+\.\s*\d+", r"\bVol\.\s*\d+", r"Journal of|Proceedings of|Trans\.|Rev\.", r"\bet\s+al\.", r"arXiv:\d+\.\d+", r"ISBN[\s:-]*[\dX-]+"]
BIB_STARTS = r"^(\[\d+\]\s*[A-Z]|[A-Z][a-z]+,\s+[A-Z]\.|[A-Z]{2,},\s+[A-Z]\.|\d+\.\s+[A-Z][a-z]+,\s+[A-Z])"
BIB_QUICK = r"\(\d{4}[a-z]?\)|\d{4}\.\s|doi:\s*10\.|https?://|\bVol\.\s*\d+|Journal of|Proceedings of|\bet\s+al\."
CAPTION = r"^(Figure|Fig\.|Table|Supplementary Figure|Supplementary Table|Extended Data)\s+\d"
BOILERPLATE = (
    r"^(This content downloaded from|Downloaded from\b|All use subject to|Copyright\s+(©|\(c\))?\s*\d{4}|©\s*\d{4}|Licensed under|This article is licensed under|(Published|Received|Accepted)\s+\d{1,2}\s+\w+\s+\d{4}"
    r"|This is an open.access article|Authorized licensed use limited to|All rights reserved\.|For permissions,?\s+please|(Sign in|Log in|Create (an )?account)\b|(Share|Tweet|Email|Print)\s+(this|article)|(Accept|Reject)\s+(all\s+)?cookies?\b"
    r"|We use cookies|(View|Show)\s+(all\s+)?(references|citations|figures|tables)|(Cited by|Metrics|Altmetrics)\b|Subscribe to\b|(Access|Read)\s+the full|Author (contributions?|information)\b|Data (availability|sharing)\b)"
)
JOURNAL_HEADER = r"^(PNAS|Nature|Science|PLoS|Journal of)\b.*\d{4}.*\b(Vol|doi|https?://)"
PAGE_OF = r"^\d+\s+(of|/)\s+\d+\b"
ACKNOWLEDGMENT = (
    r"^(This work was (supported|funded)|We (thank|acknowledge|are grateful)|The authors? (thank|acknowledge|are grateful|declare|contributed)|Author contributions?:?\s|Funding\b|This research was (funded|supported)"
    r"|Conflicts? of interest|Declaration of (competing )?interests?|Data availability|Supplementary (data|materials?|information)\b)"
)
NUMBER_TOKEN = r"^[\d.,±%<>≤≥$€£]+$"
MATH_SIGNS = "∑∏∫∂∇≈≠≤≥±×÷αβγδεζηθλμνξπρσφψω∀∃∈∉⊂⊃∪∩⟨⟩‖→←↑↓↔⊕⊗¼½¾ð"
SHORT_REFERENCE = r"^((See\s+)?(Figure|Fig\.|Table|Equation|Eq\.)\s+\d|\([^)]{0,30}\)\.?$)"
FRONT_MATTER = (
    r"^(Department|School|Faculty|Institute|College|Center|Centre|Laboratory)\s+of\b|^\d+\s+(Department|School|Faculty|Institute|College|Center|Centre)\b|^[a-z]\s+(Department|School|Faculty|Institute|College|Center|Centre)\b"
    r"|\b(email|e-mail|correspondence):\s*\S+@|\S+@\S+\.\S+|\bORCID\b|^\*\s*(Corresponding|To whom)"
)
CITE_MARKERS = [r"\[CITE\]", r"\{\{cite:[a-f0-9]*\}?\}?", r"\{\{formula:[a-f0-9\-]*\}?\}?", r"\((e\.g\.|i\.e\.|cf\.)?\s*,?\s*\)", r"\(\s*\)", r",\s*,", r",\s*\."]
EDITOR_CITATIONS = [(r"\[@[^\]]*\]", ""), (r"(?i)\[cite\]", ""), (r"\\cite\{[^}]*\}", ""), (r"\s{2,}", " ")]
HTML_CLEAN = [("[\u00a0\u200b\u200c\u200d\ufeff]", " "), (r"\[(\d+([,\s]*\d+)*(\s*[-–]\s*\d+)?)\]", ""), ("[⁰¹²³⁴⁵⁶⁷⁸⁹]+", ""), ("  +", " "), (r" ([.,;:!?])", "$1")]


def either(col: Column, pattern: str) -> Column:
    """Case-insensitive search."""
    return col.rlike("(?i)" + pattern)


def missing(col: Column) -> Column:
    """Null for the empty string."""
    return F.when(col != "", col)


def last_name(author: Column) -> Column:
    """Before the comma, else the last word."""
    return F.trim(F.when(author.contains(","), F.split_part(author, F.lit(","), F.lit(1))).otherwise(F.element_at(F.split(F.trim(author), r"\s+"), -1)))


def last_names(authors: Column) -> Column:
    return F.filter(F.transform(F.coalesce(authors, F.array().cast("array<string>")), last_name), lambda x: F.length(x) >= 2)


def author_string(names: Column) -> Column:
    """'', A, 'A and B' or 'A et al.'."""
    n = F.size(names)
    return F.when(n <= 0, "").when(n == 1, F.get(names, F.lit(0))).when(n == 2, F.concat_ws(" and ", names)).otherwise(F.concat(F.get(names, F.lit(0)), F.lit(" et al.")))


def paper_text(with_abstract: bool = True, description: Column | None = None) -> Column:
    """Title, authors, year, journal, abstract and description joined by '. ', missing parts left out."""
    parts = [F.col("title"), missing(author_string(last_names(F.col("authors")))), F.when(F.col("year") != 0, F.col("year").cast("string")), missing(F.col("journal"))]
    if with_abstract:
        parts.append(missing(F.col("abstract")))
    if description is not None:
        parts.append(missing(description))
    return F.concat_ws(". ", *parts)


def passage_text(text: Column, prefix: Column) -> Column:
    return F.when(F.coalesce(prefix, F.lit("")) != "", F.concat(prefix, F.lit("\n\n"), text)).otherwise(text)


def clean_markers(text: Column) -> Column:
    """Citation markers and what they leave behind -> one blank."""
    return F.trim(F.regexp_replace(reduce(lambda c, p: F.regexp_replace(c, p, " "), CITE_MARKERS, text), r"\s+", " "))


def query_text(scale: str, clean: bool = True, prefix_section: bool = False) -> Column:
    """Query text of a citation context at a scale, from the columns local, narrow, broad, section, wide and reformulated.

    local, narrow and broad are windows around the citation; section puts the section in
    front of local, global wide and section; reformulated is taken as it stands. What is
    missing falls back on narrow or local; an unknown scale is an error.
    """
    c = F.col
    narrow = F.coalesce(missing(c("narrow")), c("local"))
    text = {
        "local": c("local"),
        "narrow": narrow,
        "broad": F.coalesce(missing(c("broad")), c("local")),
        "section": F.concat_ws(" ", missing(c("section")), c("local")),
        "global": F.concat_ws(" ", missing(c("wide")), missing(c("section")), c("local")),
        "reformulated": narrow,
    }.get(scale)
    if text is None:
        raise ValueError(f"unknown scale: {scale}")
    if prefix_section and scale not in ("section", "global", "reformulated"):
        text = F.concat_ws(" ", missing(c("section")), text)
    text = clean_markers(text) if clean else text
    return F.coalesce(missing(c("reformulated")), text) if scale == "reformulated" else text


def strip_editor_citations(text: Column) -> Column:
    return F.trim(reduce(lambda c, p: F.regexp_replace(c, p[0], p[1]), EDITOR_CITATIONS, text))


def clean_html(text: Column) -> Column:
    return F.trim(reduce(lambda c, p: F.regexp_replace(c, p[0], p[1]), HTML_CLEAN, text))


def tokens(text: Column) -> Column:
    """Lower-case words without stop words and single characters; hyphened parts stand alone."""
    words = F.split(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s-]", " "), "-", " "), r"\s+")
    # isin becomes one look into a hash set; array_contains would compare with every stop word.
    return F.filter(F.coalesce(words, F.array().cast("array<string>")), lambda x: (F.length(x) > 1) & ~x.isin(*STOPWORDS))


def looks_like_heading(text: Column) -> Column:
    """5 to 100 characters, no final full stop, a heading's form or short capitals of several words."""
    short = (F.length(text) <= 100) & (F.length(F.trim(text)) >= 5) & ~F.rtrim(text).endswith(".") & ~text.rlike(PAGE_AUTHOR)
    capitals = (F.length(text) < 50) & (F.upper(text) == text) & (F.size(F.split(F.trim(text), r"\s+")) > 1)
    return short & (either(text, HEADING) | capitals)


def is_reference_section(section: Column) -> Column:
    return F.coalesce(either(F.trim(F.regexp_replace(section, r"^[\d.IVX]+\.?\s*", "")), REFERENCE_SECTION), F.lit(False))


def bibliography_signals(text: Column) -> Column:
    return reduce(Column.__add__, [either(text, p).cast("int") for p in BIB_SIGNALS])


def is_bibliography_entry(text: Column) -> Column:
    return (F.length(text) <= 600) & (bibliography_signals(text) >= 3)


def is_bibliography(section: Column, text: Column) -> Column:
    """By its section, by three signals, or by an entry's opening and one signal."""
    return is_reference_section(section) | is_bibliography_entry(text) | ((F.length(text) <= 600) & either(text, BIB_QUICK) & text.rlike(BIB_STARTS))


def is_corrupted(text: Column, least: float = 0.30) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", True).otherwise(F.length(F.regexp_replace(text, r"[^\p{L}]", "")) / F.length(text) < least)


def is_caption(text: Column) -> Column:
    return either(text, CAPTION)


def is_boilerplate(text: Column) -> Column:
    return either(F.substring(text, 1, 120), BOILERPLATE) | either(F.substring(text, 1, 150), JOURNAL_HEADER) | F.substring(text, 1, 20).rlike(PAGE_OF)


def is_acknowledgment(text: Column) -> Column:
    return either(text, ACKNOWLEDGMENT)


def _parts(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def is_table_data(text: Column) -> Column:
    """At least five words, more than half of them numbers."""
    w = _parts(text)
    return (F.size(w) >= 5) & (F.size(F.filter(w, lambda x: x.rlike(NUMBER_TOKEN))) / F.size(w) > 0.5)


def is_equation_heavy(text: Column) -> Column:
    n = F.length(text)
    w = _parts(text)
    math = n - F.length(F.translate(text, MATH_SIGNS, ""))
    singles = F.size(F.filter(w, lambda x: F.length(x) == 1))
    digits = n - F.length(F.regexp_replace(text, "[0-9]", ""))
    return (n >= 50) & ((math / n > 0.03) | ((F.size(w) > 10) & (singles / F.size(w) > 0.20)) | ((n > 100) & (digits / n > 0.30)))


def is_short_reference(text: Column) -> Column:
    return either(text, SHORT_REFERENCE)


def is_front_matter(text: Column) -> Column:
    return either(F.substring(text, 1, 200), FRONT_MATTER)


def paragraphs(text: Column) -> Column:
    """Pieces between blank lines, inner line breaks and blanks collapsed."""
    unified = F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\r", "\n")
    return F.filter(F.transform(F.split(unified, r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")


def sentences(text: Column) -> Column:
    """Cut behind . ! ? and blanks in front of a capital."""
    return F.split(text, r"(?<=[.!?])\s+(?=[A-Z])")


def bare_doi(doi: Column) -> Column:
    """Without the resolver's address; null if nothing is left."""
    return missing(F.trim(F.regexp_replace(doi, r"https?://(dx\.)?doi\.org/", "")))


def title_key(title: Column) -> Column:
    """Lower case ASCII letters and digits without a leading article; accents are stripped by the caller."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(title), r"^(the|a|an)\s+", ""), r"[^a-z0-9\s]", ""), r"\s+", " "))


def fuzzy_title(title: Column) -> Column:
    """Letters, digits and blanks for word overlaps."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def first_year(text: Column) -> Column:
    """The first 19xx or 20xx that isn't part of a longer number; null without one."""
    form = r"(^|[^0-9])((19|20)[0-9]{2})([^0-9]|$)"
    return F.when(text.rlike(form), F.regexp_extract(text, form, 2).cast("int"))


def escape_latex(text: Column) -> Column:
    """Backslash and braces first, then the other special characters."""
    out = F.replace(text, F.lit("\\"), F.lit("\u0001"))
    out = F.replace(F.replace(out, F.lit("{"), F.lit("\\{")), F.lit("}"), F.lit("\\}"))
    out = F.replace(out, F.lit("\u0001"), F.lit("\\textbackslash\\{\\}"))
    for sign in "&%#_":
        out = F.replace(out, F.lit(sign), F.lit("\\" + sign))
    return F.replace(F.replace(out, F.lit("~"), F.lit("\\textasciitilde{}")), F.lit("^"), F.lit("\\textasciicircum{}"))


def display_mode(has_paragraph: Column, best: Column, n_chunks: Column, paragraph_from: float = 0.65, several: int = 3) -> Column:
    return F.when(~has_paragraph, "paper").when(best >= paragraph_from, "paragraph").when(n_chunks >= several, "paper_with_summary").otherwise("paper")


def lexical_confidence(score: Column) -> Column:
    """Sigmoid with its middle at 10; 0 without a positive score."""
    return F.when(score > 0, 1.0 / (1.0 + F.exp(-0.2 * (score - 10)))).otherwise(0.0)


def confidence(scores: Column, mode: str = "hybrid") -> Column:
    """Confidence of a MAP<STRING, DOUBLE> of scores by the mode of retrieval."""
    s = lambda k: F.coalesce(F.try_element_at(scores, F.lit(k)), F.lit(0.0))
    if mode == "paragraph":
        return s("best_chunk_score")
    if mode == "two_stage":
        return F.greatest(s("best_chunk_score"), s("neural"), F.lit(0.0))
    if mode == "multi_scale":
        return F.greatest(s("best_evidence_score"), s("paper_score"))
    lexical = F.when(s("bm25") != 0, s("bm25")).otherwise(s("bm25_score"))
    return F.when(s("neural") > 0, s("neural")).when(s("neural_score") > 0, s("neural_score")).otherwise(lexical_confidence(lexical))


def confidence_band(value: Column) -> Column:
    return F.when(value >= 0.55, "HIGH").when(value >= 0.35, "MED").otherwise("LOW")
