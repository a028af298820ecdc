"""Chunking documents into paragraphs and sentences with rule-based filters, as window plans.

Input rows are paragraphs (paper_id, pos, para, n_paras), pos from 0; windows run over one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions import text as X


def document_paragraphs(papers: DataFrame, array: str = "paragraphs") -> DataFrame:
    """(paper_id, paragraphs ARRAY[, full_text, abstract, title]) -> (paper_id[, title], pos, para, n_paras).

    A document without paragraphs is cut at the blank lines of its full text, without that
    its abstract is the only paragraph. Blank paragraphs are left out but counted, in pos
    and n_paras. Documents without any text give nothing.
    """
    empty = F.array().cast("array<string>")
    whole = X.paragraphs(F.col("full_text")) if "full_text" in papers.columns else empty
    abstract = F.when(F.coalesce(F.col("abstract"), F.lit("")) != "", F.array("abstract")) if "abstract" in papers.columns else empty
    chosen = F.when(F.size(array) > 0, F.col(array)).when(F.size(whole) > 0, whole).otherwise(F.coalesce(abstract, empty))
    title = ["title"] if "title" in papers.columns else []
    rows = papers.select("paper_id", *title, chosen.alias("_a")).select("paper_id", *title, F.size("_a").alias("n_paras"), F.posexplode("_a").alias("pos", "para"))
    return rows.withColumn("para", F.trim("para")).filter("para <> ''")


def structured_paragraphs(documents: DataFrame) -> DataFrame:
    """(paper_id, paragraphs ARRAY, sections ARRAY) -> paragraph rows with the section that was given for each or carried on.

    Sections may be fewer than paragraphs and hold nulls, which carry the last one on.
    """
    rows = documents.select("paper_id", F.size("paragraphs").alias("n_paras"), "sections", F.posexplode("paragraphs").alias("pos", "para"))
    w = W.partitionBy("paper_id").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = rows.withColumn("given", F.get("sections", F.col("pos"))).withColumn("para", F.trim("para")).filter("para <> ''")
    return placed.withColumn("given", F.last("given", ignorenulls=True).over(w)).drop("sections")


def reference_cutoff(flags: str, n: str | None = None) -> Column:
    """Position of the first of three entry-like paragraphs in the last 40 % (one gap allowed after two); null without.

    flags: name of an ARRAY<BOOLEAN> column of bibliography-like paragraphs, or with n (the
    number of paragraphs, blank ones too) of an ARRAY<STRUCT<pos, bib>> of the others in
    their order; documents under 10 have none.
    """
    held = flags if n else f"transform({flags}, (x, i) -> named_struct('pos', i, 'bib', x))"
    many = n or f"size({flags})"
    state = "named_struct('run', 0, 'gap', 0, 'first', cast(null as int), 'done', cast(null as int))"
    step = """(a, x) -> case
        when a.done is not null then a
        when x.bib then named_struct('run', a.run + 1, 'gap', 0, 'first', if(a.run = 0, x.pos, a.first), 'done', if(a.run + 1 >= 3, if(a.run = 0, x.pos, a.first), cast(null as int)))
        when a.run >= 2 and a.gap = 0 then named_struct('run', a.run, 'gap', 1, 'first', a.first, 'done', cast(null as int))
        else named_struct('run', 0, 'gap', 0, 'first', cast(null as int), 'done', cast(null as int)) end"""
    return F.expr(f"case when {many} >= 10 then aggregate(filter({held}, x -> x.pos >= floor({many} * 0.6)), {state}, {step}, a -> a.done) end")


def document_cutoffs(paras: DataFrame) -> DataFrame:
    """Paragraph rows -> (paper_id, cutoff): the pos of the first of the entries at the end."""
    folded = paras.groupBy("paper_id").agg(F.max("n_paras").alias("n"), F.array_sort(F.collect_list(F.struct("pos", X.is_bibliography_entry(F.col("para")).alias("bib")))).alias("f"))
    return folded.select("paper_id", reference_cutoff("f", "n").alias("cutoff"))


def before_references(placed: DataFrame, paras: DataFrame) -> DataFrame:
    """Paragraph rows (with is_heading) in front of the reference section, by its heading or by a run of entries."""
    stops = placed.filter(F.col("is_heading") & X.is_reference_section(F.col("para"))).groupBy("paper_id").agg(F.min("pos").alias("stop"))
    return (
        placed.join(stops, "paper_id", "left")
        .join(document_cutoffs(paras), "paper_id", "left")
        .filter(F.col("pos") < F.coalesce(F.least("stop", "cutoff"), "stop", "cutoff", F.lit(2**31 - 1)))
        .drop("stop", "cutoff")
    )


def carry_sections(paras: DataFrame) -> DataFrame:
    """Adds is_heading, the section that holds at each paragraph, the number of headings so far and the running character offset."""
    w = W.partitionBy("paper_id").orderBy("pos")
    heading = X.looks_like_heading(F.col("para"))
    return (
        paras.withColumn("is_heading", heading)
        .withColumn("section", F.last(F.when(F.col("is_heading"), F.col("para")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .withColumn("part_no", F.sum(F.col("is_heading").cast("int")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .withColumn("char_offset", F.coalesce(F.sum(F.length("para") + 2).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    )


def split_long(text: str, most: int, least: int) -> Column:
    """Sentences of the column named text gathered up to most characters; a small last group joins the one before, a small inner one is dropped."""
    state = "named_struct('done', cast(array() as array<string>), 'cur', cast(null as string), 'n', 0)"
    step = f"""(a, s) -> if(a.cur is not null and a.n + length(s) > {most},
        named_struct('done', if(length(a.cur) >= {least}, concat(a.done, array(a.cur)), a.done), 'cur', s, 'n', length(s)),
        named_struct('done', a.done, 'cur', concat_ws(' ', a.cur, s), 'n', a.n + length(s) + 1))"""
    end = f"""a -> case when a.cur is null then a.done when length(a.cur) >= {least} then concat(a.done, array(a.cur))
        when size(a.done) > 0 then concat(slice(a.done, 1, size(a.done) - 1), array(concat(element_at(a.done, -1), ' ', a.cur))) else a.done end"""
    return F.expr(f"aggregate(split({text}, '(?<=[.!?])\\\\s+'), {state}, {step}, {end})")


def chunk_paragraphs(paras: DataFrame, most: int = 2048, least: int = 150) -> DataFrame:
    """Paragraph rows -> chunks (paper_id, chunk_no, text, section, char_offset).

    Stops at the reference section (by heading or by a run of entries) and leaves out
    headings, short, corrupted, caption, boilerplate, late acknowledgement,
    equation, table and bibliography paragraphs. Null paragraphs give nothing.
    """
    w = W.partitionBy("paper_id").orderBy("pos")
    p = F.col("para")
    if "given" in paras.columns:
        # Pages come with their sections and without headings and references.
        inside = carry_sections(paras).withColumn("section", F.col("given")).withColumn("is_heading", F.lit(False))
    else:
        inside = before_references(carry_sections(paras), paras)
    noise = X.is_corrupted(p) | X.is_caption(p) | X.is_boilerplate(p) | ((F.col("pos") > F.col("n_paras") * 0.7) & X.is_acknowledgment(p)) | X.is_equation_heavy(p) | X.is_table_data(p) | X.is_bibliography(F.lit(None).cast("string"), p)
    kept = inside.withColumn("keep", ~F.col("is_heading") & (F.length(p) >= least) & ~noise).withColumn("parts", F.when(F.col("keep"), F.when(F.length(p) > most, split_long("para", most, least)).otherwise(F.array(p))).otherwise(F.array().cast("array<string>")))
    # Split paragraphs advance the offset by their parts as well.
    extra = F.when(F.length(p) > most, F.aggregate("parts", F.lit(0), lambda a, x: a + F.length(x))).otherwise(0)
    shifted = kept.withColumn("char_offset", F.col("char_offset") + F.coalesce(F.sum(extra).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rows = shifted.select("paper_id", "pos", "section", "char_offset", "parts", F.posexplode("parts").alias("part", "text"))
    before = F.aggregate(F.slice("parts", F.lit(1), F.col("part")), F.lit(0), lambda a, x: a + F.length(x))
    return rows.select("paper_id", (F.row_number().over(W.partitionBy("paper_id").orderBy("pos", "part")) - 1).alias("chunk_no"), "text", "section", (F.col("char_offset") + before).alias("char_offset"))


def chunk_sentences(paras: DataFrame, least: int = 50) -> DataFrame:
    """Paragraph rows -> sentences (paper_id, chunk_no, text, section, previous, char_offset, parent_text[, context_text]).

    Stops at the reference section. previous is the sentence before under the same
    heading (equal headings are different ones), none after a corrupted one. With a title
    among the columns, context_text joins title, section and previous.
    """
    placed = before_references(carry_sections(paras), paras).filter(~F.col("is_heading") & ~X.is_boilerplate(F.col("para")))
    # Pieces keep the blanks behind them, so that their lengths add up to their places.
    pieces = F.split(F.regexp_replace("para", r"(?<=[.!?])(\s+)(?=[A-Z])", "$1\u0001"), "\u0001")
    rows = placed.withColumn("_p", pieces).select(*placed.columns, "_p", F.posexplode("_p").alias("sent", "piece"))
    before = F.aggregate(F.slice("_p", F.lit(1), F.col("sent")), F.lit(0), lambda a, x: a + F.length(x))
    rows = rows.withColumn("char_offset", (F.col("char_offset") + before).cast("long")).withColumn("text", F.trim(F.regexp_replace("piece", r"\s+$", ""))).filter("text <> ''")
    w = W.partitionBy("paper_id", "part_no").orderBy("pos", "sent")
    s = F.col("text")
    marked = rows.withColumn("previous", F.lag(F.when(~X.is_corrupted(s) | (F.length(s) < least), s)).over(w))
    kept = marked.filter((F.length(s) >= least) & ~X.is_corrupted(s) & ~X.is_caption(s) & ~X.is_short_reference(s))
    context = [F.concat_ws(" | ", "title", "section", "previous").alias("context_text")] if "title" in paras.columns else []
    number = (F.row_number().over(W.partitionBy("paper_id").orderBy("pos", "sent")) - 1).alias("chunk_no")
    return kept.select("paper_id", number, "text", "section", "previous", "char_offset", F.col("para").alias("parent_text"), *context)


def citation_windows(contexts: DataFrame, narrow: int = 2, broad: int = 5, forward: int = 1) -> DataFrame:
    """(id, text, previous_text) -> narrow and broad windows of sentences around the first [CITE].

    Sentences of the paragraph before are borrowed if it has 30 characters or more.
    """
    s = X.sentences(F.col("text"))
    prev = F.when(F.length(F.trim(F.coalesce("previous_text", F.lit("")))) >= 30, X.sentences(F.col("previous_text"))).otherwise(F.array().cast("array<string>"))
    at = F.expr("greatest(coalesce(array_position(transform(_s, x -> contains(x, '[CITE]')), true), 1), 1)")
    base = contexts.withColumn("_s", s).withColumn("_p", prev).withColumn("_at", at.cast("int"))

    def window(n: int) -> Column:
        return F.expr(
            f"""trim(array_join(concat(
                if({n} - (_at - 1) > 0 and size(_p) > 0, slice(_p, greatest(1, size(_p) - ({n} - (_at - 1)) + 1), {n}), cast(array() as array<string>)),
                slice(_s, greatest(1, _at - {n}), least(_at + {forward}, size(_s)) - greatest(1, _at - {n}) + 1)), ' '))"""
        )

    return base.select("id", window(narrow).alias("narrow"), window(broad).alias("broad"))
