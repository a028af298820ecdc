"""Splitting long texts at natural boundaries, with overlap, by bounded-quantifier patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a piece may end behind, strongest first.
PARAGRAPH = r"(?<=\n[ \t\r]{0,8}\n)"
SENTENCE = r"(?<=[.!?…][\"'”’)\]]{0,2}\s)"
LINE = r"(?<=\n)"
CLAUSE = r"(?<=[;:,]\s)"
BLANK = r"(?<=\s)"


def piece_pattern(limit: Column) -> Column:
    """The pattern whose successive matches are the pieces' bodies, at most limit characters each.

    The rest of the text if it fits; else up to the last strong boundary in the second
    half of the limit; else any boundary; else the characters themselves, if possible
    not in front of a combining mark.
    """
    top = limit.cast("string")
    low = F.greatest(F.floor(limit / 2), F.lit(1)).cast("string")
    late = [F.concat(F.lit("[\\s\\S]{"), low, F.lit(","), top, F.lit("}" + b)) for b in (PARAGRAPH, SENTENCE)]
    anywhere = [F.concat(F.lit("[\\s\\S]{1,"), top, F.lit("}" + b)) for b in (PARAGRAPH, SENTENCE, LINE, CLAUSE, BLANK, "(?!\\p{M})", "")]
    return F.concat_ws("|", F.concat(F.lit("[\\s\\S]{1,"), top, F.lit("}\\z")), *late, *anywhere)


def split_texts(texts: DataFrame, specs: DataFrame) -> DataFrame:
    """Texts over their limit -> (src_table, row_key, n_pieces, pieces ARRAY<STRUCT<start, text>>).

    texts: (src_table, row_key, source, text); specs: (src_table, source, max_chars,
    overlap_chars), a few rows of settings; the spec of source `default` holds for null
    and unlisted sources. start is the 0-based offset of a piece in its text, in code
    points. Without their overlap the pieces joined give the text. A piece begins with
    the last overlap_chars characters of the one before, fewer by the rest of a cut word,
    or with all of the part before it where that is shorter than the overlap.

    Null, empty and short texts give no row, as do texts without a spec (one with a null
    limit is none, so the default holds); repeats give one row; a null overlap is 0, and one of the limit or more is
    taken as half of it; other columns are left out.
    """
    specs = specs.groupBy("src_table", "source").agg(F.max_by(F.struct("max_chars", "overlap_chars"), "max_chars").alias("_s"))
    own = specs.select("src_table", "source", F.col("_s").alias("_own"))
    default = specs.filter("source = 'default'").select("src_table", F.col("_s").alias("_default"))
    spec = F.coalesce("_own", "_default")
    limited = (
        texts.select("src_table", "row_key", "source", "text")
        .join(own, ["src_table", "source"], "left")
        .join(default, "src_table", "left")
        .withColumn("_max", spec["max_chars"])
        .withColumn("_overlap", F.coalesce(spec["overlap_chars"], F.lit(0)))
        .filter("_max > 0 and length(text) > _max")
        .withColumn("_overlap", F.when(F.col("_overlap") >= F.col("_max"), F.floor(F.col("_max") / 2).cast("int")).otherwise(F.greatest("_overlap", F.lit(0))))
        .dropDuplicates(["src_table", "row_key", "text"])
    )
    cut = limited.withColumn("_body", F.regexp_extract_all("text", piece_pattern(F.col("_max") - F.col("_overlap")), F.lit(0))).withColumn("_len", F.transform("_body", F.length))
    # begins[i] is where body i begins; lookback gives the overlap in front of it.
    begins = F.expr("aggregate(_len, array(0), (a, n) -> concat(a, array(element_at(a, -1) + n)))")
    placed = cut.withColumn("_begin", begins)
    back = placed.withColumn(
        "_start",
        F.expr(
            """transform(_body, (b, i) -> case
                 when i = 0 or _overlap = 0 then _begin[i]
                 when _len[i - 1] < _overlap then _begin[i - 1]
                 when substring(text, _begin[i] - _overlap, 2) rlike '^\\\\S\\\\S'
                   then _begin[i] - _overlap + least(length(regexp_extract(substring(text, _begin[i] - _overlap + 1, _overlap), '^\\\\S*\\\\s+', 0)), _overlap div 2)
                 else _begin[i] - _overlap end)"""
        ),
    )
    pieces = F.expr("transform(_body, (b, i) -> struct(_start[i] as start, substring(text, _start[i] + 1, _begin[i] + _len[i] - _start[i]) as text))")
    return back.select("src_table", "row_key", F.size("_body").alias("n_pieces"), pieces.alias("pieces"))


def explode_pieces(split: DataFrame) -> DataFrame:
    """One row a piece: (src_table, row_key, piece_no from 0, n_pieces, start, text).

    The outer form keeps the optimiser from inferring a filter that would cut twice.
    """
    return split.select("src_table", "row_key", "n_pieces", F.posexplode_outer("pieces").alias("piece_no", "_p")).select("src_table", "row_key", "piece_no", "n_pieces", F.col("_p.start").alias("start"), F.col("_p.text").alias("text"))
