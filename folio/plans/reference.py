"""Queries of the retrieval and citation operators over the test tables, with their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import prose
from folio.functions import text as X
from folio.functions.stem import stemmed
from folio.operators import chunking, metadata, models, retrieval, upsert
from folio.operators.files import match_files
from folio.sinks import citations
from folio.streaming.triggers import matching_lines, quiet_sessions
from folio.session import load, spread

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- shared inputs -------------------------------------------------------------------


def _papers(s: SparkSession, d: str) -> DataFrame:
    """The latest row of each paper."""
    order = [F.col("updated_at").desc(), F.col("added_at").desc(), F.coalesce("doi", F.lit("")), F.coalesce("year", F.lit(0)), F.coalesce("journal", F.lit(""))]
    return upsert.last_wins(load(s, d, "papers"), ["id"], order)


_PAPERS = """p as (select * from papers qualify row_number() over (partition by id order by updated_at desc, added_at desc, coalesce(doi, ''), coalesce(year, 0), coalesce(journal, '')) = 1)"""
_LAST = "trim(case when contains(a, ',') then split_part(a, ',', 1) else list_last(string_split_regex(trim(a), '\\s+')) end)"
_NAMED = f"""n as (select p.*, list_filter(list_transform(coalesce(authors, []), lambda a: {_LAST}), lambda x: length(x) >= 2) as lastnames from p),
f as (select n.*, case when len(lastnames) = 0 then '' when len(lastnames) = 1 then lastnames[1] when len(lastnames) = 2 then lastnames[1] || ' and ' || lastnames[2] else lastnames[1] || ' et al.' end as author_string from n),
t as (select f.*, concat_ws('. ', title, nullif(author_string, ''), cast(nullif(year, 0) as varchar), nullif(journal, '')) as prefix,
  concat_ws('. ', title, nullif(author_string, ''), cast(nullif(year, 0) as varchar), nullif(journal, ''), nullif(abstract, '')) as embedding_text from f)"""


def _chunks(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "chunks").select("id", "paper_id", "text", "section").distinct()


def _q(p: str) -> str:
    return p.replace("'", "''")


def _i(col: str, p: str) -> str:
    return f"regexp_matches({col}, '{_q(p)}', 'i')"


# ---- texts of papers and passages -------------------------------------------------------


@query(f"with {_PAPERS} select id, title, year, doi, journal, updated_at from p")
def papers_latest(s, d):
    return _papers(s, d).select("id", "title", "year", "doi", "journal", "updated_at")


@query(f"with {_PAPERS}, {_NAMED} select id, array_to_string(lastnames, '|') as lastnames, author_string, prefix as metadata_prefix, embedding_text from t")
def paper_texts(s, d):
    names = X.last_names(F.col("authors"))
    return _papers(s, d).select("id", F.array_join(names, "|").alias("lastnames"), X.author_string(names).alias("author_string"), X.paper_text(False).alias("metadata_prefix"), X.paper_text().alias("embedding_text"))


@query(f"""with {_PAPERS}, {_NAMED}, c as (select distinct id, paper_id, text from chunks)
select c.id, coalesce(case when coalesce(t.prefix, '') <> '' then t.prefix || chr(10) || chr(10) || c.text else c.text end, '') as passage from c left join t on t.id = c.paper_id""")
def passage_texts(s, d):
    prefix = _papers(s, d).select(F.col("id").alias("paper_id"), X.paper_text(False).alias("prefix"))
    joined = _chunks(s, d).select("id", "paper_id", "text").distinct().join(prefix, "paper_id", "left")
    return joined.select("id", F.coalesce(X.passage_text(F.col("text"), F.col("prefix")), F.lit("")).alias("passage"))


_CLEAN = "text"
for _p in X.CITE_MARKERS:
    _CLEAN = f"regexp_replace({_CLEAN}, '{_q(_p)}', ' ', 'g')"


@query(f"select distinct id, trim(regexp_replace({_CLEAN}, '\\s+', ' ', 'g')) as local_context from contexts where text is not null")
def context_queries(s, d):
    return load(s, d, "contexts").filter("text is not null").select("id", X.clean_markers(F.col("text")).alias("local_context")).distinct()


_SCALES = {
    "local": "local", "narrow": "coalesce(nullif(narrow, ''), local)", "broad": "coalesce(nullif(broad, ''), local)", "section": "concat_ws(' ', nullif(section, ''), local)",
    "global": "concat_ws(' ', nullif(wide, ''), nullif(section, ''), local)", "reformulated": "coalesce(nullif(narrow, ''), local)",
}


def _clean_sql(x: str) -> str:
    return f"trim(regexp_replace({_CLEAN.replace('regexp_replace(text,', f'regexp_replace({x},')}, '\\s+', ' ', 'g'))"


@query(f"""with {_PAPERS}, c as (select distinct id, paper_id, text, section_hint from contexts where text is not null),
s as (select *, string_split(regexp_replace(text, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) as s from c),
a as (select *, coalesce(nullif(list_position(list_transform(s, lambda x: contains(x, '[CITE]')), true), 0), 1) as k from s),
w as (select a.id, text as local, trim(array_to_string(s[greatest(1, k - 2):least(k + 1, len(s))], ' ')) as narrow, trim(array_to_string(s[greatest(1, k - 5):least(k + 1, len(s))], ' ')) as broad,
  section_hint as section, p.title as wide from a left join p on p.id = a.paper_id)
""" + " union all ".join(f"select distinct id, '{k}' as scale, {_clean_sql(v)} as query_text from w" for k, v in _SCALES.items()))
def context_scales(s, d):
    """Each context's query at every scale; no query was reformulated, so that scale falls back."""
    c = load(s, d, "contexts").filter("text is not null").select("id", "paper_id", "text", F.col("section_hint").alias("section")).distinct()
    windows = chunking.citation_windows(c.select("id", "text").distinct().withColumn("previous_text", F.lit(None).cast("string")))
    wide = c.join(windows, "id").join(_papers(s, d).select(F.col("id").alias("paper_id"), F.col("title").alias("wide")), "paper_id", "left").withColumnRenamed("text", "local").withColumn("reformulated", F.lit(None).cast("string"))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("scale"), X.query_text(k).alias("query_text")) for k in _SCALES))).alias("q")
    return wide.select("id", each).select("id", "q.scale", "q.query_text").distinct()


_SIGNALS = " + ".join(f"cast({_i('x', p)} as int)" for p in X.BIB_SIGNALS)
_SINGLES = "len(list_filter(w, lambda t: length(t) = 1))"


@query(f"""with c as (select distinct id, text as x, section from chunks where text is not null),
w as (select *, list_filter(string_split_regex(x, '\\s+'), lambda t: t <> '') as w from c)
select id, length(x) <= 100 and length(trim(x)) >= 5 and rtrim(x) not like '%.' and not regexp_matches(x, '{X.PAGE_AUTHOR}')
    and ({_i('x', X.HEADING)} or (length(x) < 50 and upper(x) = x and len(string_split_regex(trim(x), '\\s+')) > 1)) as is_heading,
  coalesce({_i("trim(regexp_replace(section, '^[0-9.IVX]+\\.?\\s*', ''))", X.REFERENCE_SECTION)}, false) as in_references,
  length(x) <= 600 and ({_SIGNALS}) >= 3 as is_entry,
  case when x = '' then true else length(regexp_replace(x, '[^\\p{{L}}]', '', 'g')) / length(x) < 0.30 end as is_corrupted,
  {_i('x', X.CAPTION)} as is_caption,
  {_i('substr(x, 1, 120)', X.BOILERPLATE)} or {_i('substr(x, 1, 150)', X.JOURNAL_HEADER)} or regexp_matches(substr(x, 1, 20), '{X.PAGE_OF}') as is_boilerplate,
  {_i('x', X.ACKNOWLEDGMENT)} as is_acknowledgment,
  len(w) >= 5 and len(list_filter(w, lambda t: regexp_matches(t, '{X.NUMBER_TOKEN}'))) / greatest(len(w), 1) > 0.5 as is_table,
  length(x) >= 50 and ((len(w) > 10 and {_SINGLES} / greatest(len(w), 1) > 0.20) or (length(x) > 100 and (length(x) - length(regexp_replace(x, '[0-9]', '', 'g'))) / length(x) > 0.30)
    or (length(x) - length(regexp_replace(x, '[{X.MATH_SIGNS}]', '', 'g'))) / length(x) > 0.03) as is_equation,
  {_i('x', X.SHORT_REFERENCE)} as is_short_reference, {_i('substr(x, 1, 200)', X.FRONT_MATTER)} as is_front_matter,
  length(x) >= 150 as is_long_enough from w""")
def chunk_predicates(s, d):
    t = F.col("text")
    return _chunks(s, d).filter("text is not null").select(
        "id", X.looks_like_heading(t).alias("is_heading"), X.is_reference_section(F.col("section")).alias("in_references"), X.is_bibliography_entry(t).alias("is_entry"), X.is_corrupted(t).alias("is_corrupted"),
        X.is_caption(t).alias("is_caption"), X.is_boilerplate(t).alias("is_boilerplate"), X.is_acknowledgment(t).alias("is_acknowledgment"), X.is_table_data(t).alias("is_table"), X.is_equation_heavy(t).alias("is_equation"),
        X.is_short_reference(t).alias("is_short_reference"), X.is_front_matter(t).alias("is_front_matter"), (F.length(t) >= 150).alias("is_long_enough"),
    )


@query(f"""with c as (select distinct id, text as x, section from chunks where text is not null)
select id from c where not (coalesce({_i("trim(regexp_replace(section, '^[0-9.IVX]+\\.?\\s*', ''))", X.REFERENCE_SECTION)}, false) or (length(x) <= 600 and ({_SIGNALS}) >= 3)
  or (length(x) <= 600 and {_i('x', X.BIB_QUICK)} and regexp_matches(x, '{X.BIB_STARTS}')))""")
def chunks_without_bibliography(s, d):
    return _chunks(s, d).filter("text is not null").filter(~X.is_bibliography(F.col("section"), F.col("text"))).select("id")


@query("select distinct id, regexp_extract(id, '^(.*)::chunk_(\\d+)$', 1) as parsed_paper, try_cast(regexp_extract(id, '^(.*)::chunk_(\\d+)$', 2) as int) as parsed_no, substr(md5(id), 1, 16) as hash_id from chunks")
def chunk_ids(s, d):
    form = r"^(.*)::chunk_(\d+)$"
    return load(s, d, "chunks").select("id", F.regexp_extract("id", form, 1).alias("parsed_paper"), F.expr(r"try_cast(regexp_extract(id, '^(.*)::chunk_(\\d+)$', 2) as int)").alias("parsed_no"), F.substring(F.md5("id"), 1, 16).alias("hash_id")).distinct()


@query(f"""with {_PAPERS} select id, nullif(trim(regexp_replace(doi, 'https?://(dx\\.)?doi\\.org/', '', 'g')), '') as bare_doi,
  try_cast(nullif(regexp_extract(source_file, '(^|[^0-9])((19|20)[0-9][0-9])([^0-9]|$)', 2), '') as int) as file_year,
  trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower(title)), '^(the|a|an)\\s+', ''), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) as title_key,
  trim(regexp_replace(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) as fuzzy_title,
  case when length(abstract) > 300 then left(abstract, 300) || '...' else abstract end as preview,
  list_filter(list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+')), lambda x: length(x) >= 3).len() as n_words from p""")
def paper_keys(s, d):
    bare = F.pandas_udf(_strip_accents, "string")
    return _papers(s, d).select(
        "id", X.bare_doi(F.col("doi")).alias("bare_doi"), X.first_year(F.col("source_file")).alias("file_year"), X.title_key(bare(F.lower("title"))).alias("title_key"), X.fuzzy_title(F.col("title")).alias("fuzzy_title"),
        F.when(F.length("abstract") > 300, F.concat(F.left("abstract", F.lit(300)), F.lit("..."))).otherwise(F.col("abstract")).alias("preview"), F.size(metadata.word_set(F.col("title"))).cast("long").alias("n_words"),
    )


def _strip_accents(x: pd.Series) -> pd.Series:
    import unicodedata

    return x.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)))


_HTML = "text"
for _p, _r in X.HTML_CLEAN:
    _HTML = f"regexp_replace({_HTML}, '{_q(_p)}', '{_r.replace('$1', chr(92) + '1')}', 'g')"
_EDIT = "text"
for _p, _r in X.EDITOR_CITATIONS:
    _EDIT = f"regexp_replace({_EDIT}, '{_q(_p)}', '{_r}', 'g')"


@query(f"select distinct id, trim({_HTML}) as html_clean, trim({_EDIT}) as without_citations from chunks where text is not null")
def cleaned_texts(s, d):
    return load(s, d, "chunks").filter("text is not null").select("id", X.clean_html(F.col("text")).alias("html_clean"), X.strip_editor_citations(F.col("text")).alias("without_citations")).distinct()


@query("""with c as (select distinct id, text from contexts where text is not null),
s as (select id, string_split(regexp_replace(text, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) as s from c)
select id, len(s) as n_sentences, s[1] as first_sentence, list_last(s) as last_sentence from s""")
def sentence_split(s, d):
    sent = X.sentences(F.col("text"))
    return load(s, d, "contexts").filter("text is not null").select("id", F.size(sent).cast("long").alias("n_sentences"), F.get(sent, F.lit(0)).alias("first_sentence"), F.element_at(sent, -1).alias("last_sentence")).distinct()


@query("""with c as (select distinct id, text from contexts where text is not null),
s as (select id, string_split(regexp_replace(text, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) as s from c),
a as (select id, s, coalesce(nullif(list_position(list_transform(s, lambda x: contains(x, '[CITE]')), true), 0), 1) as k from s)
select id, trim(array_to_string(s[greatest(1, k - 2):least(k + 1, len(s))], ' ')) as narrow, trim(array_to_string(s[greatest(1, k - 5):least(k + 1, len(s))], ' ')) as broad from a""")
def context_windows(s, d):
    c = load(s, d, "contexts").filter("text is not null").select("id", "text").distinct().withColumn("previous_text", F.lit(None).cast("string"))
    return chunking.citation_windows(c)


# ---- documents into paragraphs and chunks ------------------------------------------------


def _paragraphs(s, d):
    pdf = load(s, d, "pdf_extractions").filter("paragraphs is not null").select(F.col("extraction_id").alias("paper_id"), "paragraphs").distinct()
    return chunking.document_paragraphs(pdf)


def _texts_in_paragraphs(s, d):
    """Every extraction by its paragraphs or its full text, and every paper by its abstract."""
    pdf = load(s, d, "pdf_extractions").select(F.col("extraction_id").alias("paper_id"), "paragraphs", "full_text", F.lit(None).cast("string").alias("abstract"), F.lit("").alias("title")).distinct()
    own = _papers(s, d).select(F.col("id").alias("paper_id"), F.lit(None).cast("array<string>").alias("paragraphs"), F.lit(None).cast("string").alias("full_text"), "abstract", "title")
    return chunking.document_paragraphs(pdf.unionByName(own))


@query(f"""with e as (select distinct extraction_id as paper_id, paragraphs from pdf_extractions where paragraphs is not null),
q as (select paper_id, unnest(range(0, len(paragraphs))) as pos, unnest(paragraphs) as x from e),
r as (select paper_id, cast(pos as int) as pos, trim(x) as x from q where trim(x) <> ''),
h as (select *, length(x) <= 100 and length(trim(x)) >= 5 and rtrim(x) not like '%.' and not regexp_matches(x, '{X.PAGE_AUTHOR}')
    and ({_i('x', X.HEADING)} or (length(x) < 50 and upper(x) = x and len(string_split_regex(trim(x), '\\s+')) > 1)) as is_heading from r)
select paper_id, pos, is_heading, last_value(case when is_heading then x end ignore nulls) over (partition by paper_id order by pos rows between unbounded preceding and current row) as section,
  cast(coalesce(sum(length(x) + 2) over (partition by paper_id order by pos rows between unbounded preceding and 1 preceding), 0) as bigint) as char_offset from h""")
def section_carry(s, d):
    return chunking.carry_sections(_paragraphs(s, d)).select("paper_id", "pos", "is_heading", "section", F.col("char_offset").cast("long").alias("char_offset"))


@query()
def paragraph_chunks(s, d):
    return chunking.chunk_paragraphs(_texts_in_paragraphs(s, d))


@query()
def sentence_chunks(s, d):
    return chunking.chunk_sentences(_texts_in_paragraphs(s, d))


@query(f"""with e as (select distinct extraction_id as paper_id, paragraphs, len(paragraphs) as n from pdf_extractions where len(paragraphs) > 0),
q as (select paper_id, n, unnest(range(0, n)) as pos, unnest(paragraphs) as x from e),
r as (select paper_id, n, pos, length(trim(x)) <= 600 and ({_SIGNALS.replace('x,', 'trim(x),').replace('(x ', '(trim(x) ')}) >= 3 as bib from q where trim(x) <> ''),
f as (select paper_id, any_value(n) as n, string_agg(case when bib then '1' else '0' end, '' order by pos) filter (where pos >= floor(n * 0.6)) as flags,
  list(pos order by pos) filter (where pos >= floor(n * 0.6)) as places from r group by paper_id)
select paper_id, case when n >= 10 and regexp_matches(flags, '111|1101') then cast(places[length(regexp_extract(flags, '^(.*?)(?:111|1101)', 1)) + 1] as int) end as cutoff from f""")
def reference_cutoffs(s, d):
    return chunking.document_cutoffs(_paragraphs(s, d))


# ---- lexical retrieval -----------------------------------------------------------------------

_STOP = "[" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "]"
_BM25 = f"""d as (select doc_id, list_filter(string_split_regex(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}_\\s-]', ' ', 'g'), '-', ' ', 'g'), '\\s+'),
    lambda x: length(x) > 1 and not list_contains({_STOP}, x)) as w from documents),
tot as (select count(*) as n_docs, avg(len(w)) as avg_len from d),
tf as (select doc_id, any_value(len) as len, term, count(*) as tf from (select doc_id, len(w) as len, unnest(w) as term from d) group by doc_id, term),
raw as (select term, ln((n_docs - count(*) + 0.5) / (count(*) + 0.5)) as raw_idf, any_value(avg_len) as avg_len from tf, tot group by term, n_docs),
idf as (select term, avg_len, case when raw_idf < 0 then 0.25 * (select avg(raw_idf) from raw) else raw_idf end as idf from raw),
qt as (select doc_id as query_id, term, count(*) as qtf from (select doc_id, unnest(w) as term from d where doc_id % 100 = 0) group by 1, 2)"""


def _bm25_sql(b: float, k: int = 10) -> str:
    return f"""select query_id, tf.doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - {b} + {b} * len / avg_len))), 6) as score from qt join idf using (term) join tf using (term) group by 1, 2"""


def _ranked_sql(inner: str, k: int = 10, doc: str = "doc_id") -> str:
    return f"select *, row_number() over (partition by query_id order by score desc, {doc}) as rank from ({inner}) where score > 0 qualify rank <= {k}"


def _documents(s, d):
    return load(s, d, "documents").select("doc_id", "text")


def _document_queries(s, d):
    return _documents(s, d).filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text")


def _tiers(s, d) -> DataFrame:
    """Two ranked lists a query: with and without length normalisation."""
    return retrieval.bm25_tiers(_document_queries(s, d), _documents(s, d), {"bm25": 0.75, "flat": 0.0})


_TIERS = f"""{_BM25}, r1 as ({_ranked_sql(_bm25_sql(0.75))}), r2 as ({_ranked_sql(_bm25_sql(0.0))}),
u as (select query_id, doc_id, score, rank, 'bm25' as tier from r1 union all select query_id, doc_id, score, rank, 'flat' from r2)"""


@query(f"with {_BM25} select query_id, doc_id, score, rank from ({_ranked_sql(_bm25_sql(0.75))})")
def bm25_topk(s, d):
    return retrieval.bm25(_document_queries(s, d), _documents(s, d)).select("query_id", "doc_id", "score", "rank")


@query(f"with {_BM25} select term, any_value(round(raw_idf, 6)) as raw_idf, count(*) as df, sum(tf) as n from raw join tf using (term) group by term")
def bm25_statistics(s, d):
    n = _documents(s, d).count()
    docs = spread(_documents(s, d)).select("doc_id", X.tokens(F.col("text")).alias("w"))
    tf = docs.select("doc_id", F.explode("w").alias("term")).groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))
    stats = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("n"))
    return stats.select("term", F.round(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("raw_idf"), "df", "n")


@query(f"""with {_TIERS}, z as (select query_id, doc_id, round(sum(case tier when 'bm25' then 2.0 else 1.0 end / (10 + rank)), 9) as score, min(rank) as best_rank from u group by 1, 2)
select query_id, doc_id, score, best_rank, row_number() over (partition by query_id order by score desc, doc_id) as rank from z qualify rank <= 10""")
def rrf_fuse(s, d):
    fused = retrieval.rrf(_tiers(s, d), 10, {"bm25": 2.0, "flat": 1.0}).select("query_id", "doc_id", "score", "best_rank")
    return retrieval.top_k(fused, 10)


@query(f"""with {_TIERS}, z as (select query_id, doc_id, round(sum(case tier when 'bm25' then 0.7 else 0.3 end * score), 6) as score from u group by 1, 2)
select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from z qualify rank <= 10""")
def weighted_fuse(s, d):
    return retrieval.top_k(retrieval.weighted_fusion(_tiers(s, d), {"bm25": 0.7, "flat": 0.3}), 10)


@query(f"""with {_BM25}, r as ({_ranked_sql(_bm25_sql(0.75))}), c as (select *, round(1 / (1 + exp(-0.2 * (score - 10))), 6) as confidence from r)
select query_id, doc_id, confidence, case when confidence >= 0.55 then 'HIGH' when confidence >= 0.35 then 'MED' else 'LOW' end as band from c""")
def confidence_bands(s, d):
    ranked = retrieval.bm25(_document_queries(s, d), _documents(s, d))
    value = F.round(X.confidence(F.create_map(F.lit("bm25"), F.col("score"))), 6)
    return ranked.select("query_id", "doc_id", value.alias("confidence"), X.confidence_band(value).alias("band"))


@query(f"""with {_BM25}, r as ({_ranked_sql(_bm25_sql(0.75), 11)}), k as (select doc_id, paper_id from documents where paper_id is not null),
rel as (select a.doc_id as query_id, b.doc_id from k a join k b using (paper_id) where a.doc_id % 100 = 0 and a.doc_id <> b.doc_id),
n as (select query_id, count(*) as n from rel group by 1),
h as (select query_id, sum(cast(rank <= 1 as int)) as h1, sum(cast(rank <= 5 as int)) as h5, sum(cast(rank <= 10 as int)) as h10, min(rank) as first, sum(case when rank <= 10 then 1 / log2(rank + 1) end) as dcg from r join rel using (query_id, doc_id) group by 1)
select query_id, round(coalesce(h1, 0) / n, 6) as recall_1, round(coalesce(h5, 0) / n, 6) as recall_5, round(coalesce(h10, 0) / n, 6) as recall_10, round(coalesce(1 / first, 0), 6) as reciprocal_rank,
  round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 6) as ndcg_10 from n left join h using (query_id)""")
def evaluation(s, d):
    known = load(s, d, "documents").filter("paper_id is not null").select("doc_id", "paper_id")
    own = known.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "paper_id")
    relevant = own.join(known, "paper_id").filter("query_id <> doc_id").select("query_id", "doc_id")
    return retrieval.ranking_metrics(retrieval.bm25(_document_queries(s, d), _documents(s, d), 11), relevant)


@query()
def bm25_stemmed(s, d):
    return retrieval.bm25(_document_queries(s, d), _documents(s, d), words=lambda c: stemmed(X.tokens(c))).select("query_id", "doc_id", "score", "rank")


@query(f"""with {_BM25},
sc as (select query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))), 6) as score from qt join idf using (term) join tf using (term) group by 1, 2),
rk as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from sc where score > 0 qualify rank <= 10),
t as (select doc_id, coalesce(trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower(split_part(text, chr(10), 1))), '^(the|a|an)\\s+', ''), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')), '') as title_key, coalesce(length(text) > 500, false) as has_abstract from documents),
g as (select *, first_value(score) over w as s1, first_value(has_abstract) over w as h1 from rk join t using (doc_id) window w as (partition by query_id, title_key order by rank)),
c as (select *, coalesce(min(case when has_abstract and not h1 and s1 > 0 and score > 0.95 * s1 then rank end) over v, min(rank) over v) as chosen from g window v as (partition by query_id, title_key))
select query_id, doc_id, score, cast(row_number() over (partition by query_id order by rank) as int) as rank, title_key, has_abstract from c where rank = chosen or title_key = ''""")
def title_dedup(s, d):
    titles = load(s, d, "documents").select("doc_id", X.title_key(F.pandas_udf(_strip_accents, "string")(F.lower(F.split_part("text", F.lit("\n"), F.lit(1))))).alias("title_key"), (F.length("text") > 500).alias("has_abstract"))
    return retrieval.deduplicate_titles(retrieval.bm25(_document_queries(s, d), _documents(s, d)).join(titles, "doc_id").select("query_id", "doc_id", "score", "rank", F.coalesce("title_key", F.lit("")).alias("title_key"), F.coalesce("has_abstract", F.lit(False)).alias("has_abstract")))


# ---- vectors ----------------------------------------------------------------------------------

_DOT = "round(list_inner_product(q.embedding::double[], v.embedding::double[]), 6)"
_SCORED = f"select q.vec_id as query_id, v.vec_id as doc_id, {_DOT} as score, v.label from embeddings q, embeddings v where q.vec_id % 100 = 0"


def _vectors(s, d):
    return load(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def _query_vectors(s, d):
    return load(s, d, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _top_sql(inner: str, k: int, where: str = "true") -> str:
    return f"select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from ({inner}) where {where} qualify rank <= {k}"


@query(f"select query_id, doc_id, score, rank from ({_top_sql(_SCORED, 10)})")
def vector_topk(s, d):
    return retrieval.vector_top(_query_vectors(s, d), _vectors(s, d))


@query(f"select query_id, doc_id, score, rank from ({_top_sql(_SCORED, 5, 'query_id <> doc_id')})")
def find_similar(s, d):
    return retrieval.vector_top(_query_vectors(s, d), _vectors(s, d), 5, drop_self=True)


@query(f"""with e as (select vec_id, embedding, embedding[1:16]::double[] as c from embeddings), g as (select vec_id, embedding, list_transform(c, lambda x: x / sqrt(list_inner_product(c, c))) as c from e),
a as (select q.vec_id as query_id, v.vec_id as doc_id, round(list_inner_product(q.c, v.c), 6) as pre, {_DOT} as score from g q, g v where q.vec_id % 100 = 0),
b as (select * from a qualify row_number() over (partition by query_id order by pre desc, doc_id) <= 100)
select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from b qualify rank <= 10""")
def two_phase_vector_topk(s, d):
    return retrieval.two_phase_vector_top(_query_vectors(s, d), _vectors(s, d))


_TITLE_SQL = "coalesce(trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower(split_part(text, chr(10), 1))), '^(the|a|an)\\s+', ''), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')), '')"
_EDGES = "[^\\p{L}\\p{N}_]"


def _document_facts(s, d):
    """What a hybrid needs of a document: its paper's last names, its title and whether it is long."""
    names = _papers(s, d).select(F.col("id").alias("paper_id"), X.last_names(F.col("authors")).alias("lastnames"))
    docs = load(s, d, "documents").select("doc_id", "paper_id", X.title_key(F.pandas_udf(_strip_accents, "string")(F.lower(F.split_part("text", F.lit("\n"), F.lit(1))))).alias("title_key"), (F.length("text") > 500).alias("has_abstract"))
    return docs.join(names, "paper_id", "left").drop("paper_id")


@query(f"""with {_PAPERS}, {_NAMED}, {_BM25}, b as ({_ranked_sql(_bm25_sql(0.75), 60)}), v as ({_top_sql(_SCORED, 60)}),
u as (select query_id, doc_id, rank from b union all select query_id, doc_id, rank from v),
fu as (select query_id, doc_id, round(sum(1 / (10 + rank)), 9) as score from u group by 1, 2),
g as (select fu.*, o.text, lower(q.text) as asked, t.lastnames from fu join documents q on q.doc_id = fu.query_id left join documents o on o.doc_id = fu.doc_id left join t on t.id = o.paper_id),
m as (select query_id, doc_id, {_TITLE_SQL} as title_key, coalesce(length(text) > 500, false) as has_abstract,
  round(case when len(list_filter(coalesce(lastnames, []), lambda l: regexp_matches(asked, '(^|{_EDGES})' || regexp_escape(lower(l)) || '($|{_EDGES})'))) > 0 then score * 1.2 else score end, 9) as score from g),
k as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from m qualify rank <= 20),
w as (select *, first_value(score) over (partition by query_id, title_key order by rank) as s1, first_value(has_abstract) over (partition by query_id, title_key order by rank) as h1 from k),
c as (select *, coalesce(min(case when has_abstract and not h1 and s1 > 0 and score > 0.95 * s1 then rank end) over z, min(rank) over z) as chosen from w window z as (partition by query_id, title_key))
select query_id, doc_id, score, cast(row_number() over (partition by query_id order by rank) as int) as rank from c where rank = chosen or title_key = '' qualify rank <= 10""".replace("qualify rank <= 10", "qualify row_number() over (partition by query_id order by rank) <= 10"))
def hybrid(s, d):
    """Lexical and vector retrieval fused, boosted by authors, without repeated titles."""
    n = retrieval.candidates(10)
    asked = _document_queries(s, d)
    lexical = retrieval.bm25(asked, _documents(s, d), n).select("query_id", "doc_id", "score", "rank", F.lit("bm25").alias("tier"))
    neural = retrieval.vector_top(_query_vectors(s, d), _vectors(s, d), n).select("query_id", "doc_id", "score", "rank", F.lit("neural").alias("tier"))
    return retrieval.hybrid(lexical.unionByName(neural), asked, _document_facts(s, d), deduplicate=True)


_HITS = f"h as ({_top_sql(_SCORED, 50)})"
_MODE_SQL = {
    "max": "max(score)", "mean": "avg(score)", "sum": "sum(score)", "weighted_max": "0.7 * max(score) + 0.3 * avg(score)", "top_k_mean": "list_avg(list_sort(list(score), 'DESC')[1:3])",
    "coverage": "max(score) + 0.02 * (count(*) - 1)", "log_normalized": "max(score) + 0.02 * ln(1 + count(*) - 1)",
}


def _hits(s, d):
    labels = load(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("paper_id"))
    return retrieval.vector_top(_query_vectors(s, d), _vectors(s, d), 50).join(labels, "doc_id").select("query_id", F.col("doc_id").alias("chunk_id"), "paper_id", "score")


def _mode_query(mode: str):
    def run(s, d):
        return retrieval.aggregate_chunks(_hits(s, d), mode).select("query_id", "paper_id", "score", "n_chunks", "best_chunk")

    run.__name__ = f"chunks_{mode}"
    query(f"""with {_HITS} select query_id, label as paper_id, round({_MODE_SQL[mode]}, 9) as score, count(*) as n_chunks, arg_min(doc_id, rank) as best_chunk from h group by 1, 2""")(run)


for _mode in _MODE_SQL:
    _mode_query(_mode)

_PAPER_SCORES = f"s1 as (select query_id, label as paper_id, round(avg(score), 6) as score from ({_top_sql(_SCORED, 200)}) group by 1, 2)"


def _paper_scores(s, d):
    labels = load(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("paper_id"))
    wide = retrieval.vector_top(_query_vectors(s, d), _vectors(s, d), 200).join(labels, "doc_id")
    return wide.groupBy("query_id", "paper_id").agg(F.round(F.avg("score"), 6).alias("score"))


@query(f"""with {_PAPER_SCORES}, h as (select x.* from ({_SCORED}) x join s1 on s1.query_id = x.query_id and s1.paper_id = x.label), top as (select *, row_number() over (partition by query_id, label order by score desc, doc_id) as n from h qualify n <= 3),
c as (select query_id, label as paper_id, max(score) as best, sum(cast(score >= 0.35 - 1e-6 as int)) as evidence from top group by 1, 2),
m as (select *, case when max(score) over w > min(score) over w then (score - min(score) over w) / (max(score) over w - min(score) over w) else 1.0 end as norm from s1 window w as (partition by query_id)),
b as (select query_id, paper_id, round(0.6 * norm + 0.4 * coalesce(best, 0), 6) as score, round(coalesce(best, 0), 6) as best_chunk_score, cast(coalesce(evidence, 0) as bigint) as evidence from m left join c using (query_id, paper_id))
select *, row_number() over (partition by query_id order by score desc, paper_id) as rank from b qualify rank <= 10""")
def two_stage(s, d):
    vectors = load(s, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("paper_id"), "embedding")
    papers = _paper_scores(s, d)
    return retrieval.two_stage(papers, retrieval.candidate_chunks(papers, _query_vectors(s, d), vectors))


@query(f"""with {_HITS}, {_PAPER_SCORES}, a as (select query_id, paper_id, row_number() over (partition by query_id order by score desc, paper_id) as rank from s1),
b as (select query_id, label as paper_id, max(score) as sc from h group by 1, 2), c as (select query_id, paper_id, row_number() over (partition by query_id order by sc desc, paper_id) as rank from b),
u as (select query_id, paper_id, rank from a union all select query_id, paper_id, rank from c)
select query_id, paper_id, round(sum(1 / (60 + rank)), 9) as score, min(rank) as best_rank from u group by 1, 2""")
def multi_scale(s, d):
    papers = retrieval.top_k(_paper_scores(s, d), 10**6, doc="paper_id").withColumn("tier", F.lit("paper"))
    chunks = retrieval.top_k(_hits(s, d).groupBy("query_id", "paper_id").agg(F.max("score").alias("score")), 10**6, doc="paper_id").withColumn("tier", F.lit("paragraph"))
    both = papers.select("query_id", F.col("paper_id").alias("doc_id"), "score", "rank", "tier").unionByName(chunks.select("query_id", F.col("paper_id").alias("doc_id"), "score", "rank", "tier"))
    return retrieval.rrf(both, 60).select("query_id", F.col("doc_id").alias("paper_id"), "score", "best_rank")


@query(f"""with {_HITS}, e as (select query_id, label as paper_id, doc_id as chunk_id, score from h where score >= 0.35 qualify row_number() over (partition by query_id, label order by score desc, doc_id) <= 3),
g as (select query_id, paper_id, max(score) as best, count(*) as n, array_to_string(list(chunk_id order by score desc, chunk_id), ',') as chunks from e group by 1, 2)
select query_id, paper_id, chunks, case when best >= 0.65 then 'paragraph' when n >= 3 then 'paper_with_summary' else 'paper' end as display_mode from g""")
def evidence_modes(s, d):
    w = retrieval.W.partitionBy("query_id", "paper_id").orderBy(F.col("score").desc(), "chunk_id")
    best = _hits(s, d).filter("score >= 0.35").withColumn("n", F.row_number().over(w)).filter("n <= 3")
    grouped = best.groupBy("query_id", "paper_id").agg(F.max("score").alias("best"), F.count(F.lit(1)).alias("k"), F.array_sort(F.collect_list(F.struct("n", "chunk_id"))).alias("c"))
    return grouped.select("query_id", "paper_id", F.array_join(F.transform("c", lambda x: x["chunk_id"].cast("string")), ",").alias("chunks"), X.display_mode(F.lit(True), F.col("best"), F.col("k")).alias("display_mode"))


@query(f"""with {_HITS}, r as (select query_id, doc_id, label as paper_id, score, cast(doc_id % 7 as double) as new from h),
m as (select *, case when max(score) over w > min(score) over w then (score - min(score) over w) / (max(score) over w - min(score) over w) else 0.5 end as a,
  case when max(new) over w > min(new) over w then (new - min(new) over w) / (max(new) over w - min(new) over w) else 0.5 end as b from r window w as (partition by query_id)),
c as (select query_id, doc_id, paper_id, round(0.4 * a + 0.6 * b, 6) as score from m), t as (select * from c qualify row_number() over (partition by query_id, paper_id order by score desc, doc_id) <= 2)
select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from t qualify rank <= 10""")
def rerank_blend(s, d):
    rows = _hits(s, d).select("query_id", F.col("chunk_id").alias("doc_id"), "paper_id", "score", F.lit("").alias("query_text"), F.col("chunk_id").cast("string").alias("doc_text"))
    return models.rerank(rows, _last_digit, 10, blend=0.4, max_per_paper=2)


def _last_digit(q: pd.Series, t: pd.Series) -> pd.Series:
    """Stands in for a cross-encoder."""
    return t.astype("int64").mod(7).astype("float64")


@query()
def projection(s, d):
    return models.principal_plane(_vectors(s, d))


@query(f"""with p as (select *, pow(0.5, abs(doc_id - query_id) % 4) as w from ({_top_sql(_SCORED, 5)})), e as (select query_id, w, unnest(range(1, 65)) as dim, unnest(v.embedding::double[]) as x from p join embeddings v on v.vec_id = p.doc_id)
select query_id, dim, round(sum(w * x) / sum(w), 6) as x from e group by 1, 2""")
def weighted_vectors(s, d):
    top = retrieval.vector_top(_query_vectors(s, d), _vectors(s, d), 5).join(_vectors(s, d), "doc_id")
    rows = top.select("query_id", F.pmod(F.abs(F.col("doc_id") - F.col("query_id")), F.lit(4)).alias("pos"), F.lit(0).alias("focus"), "embedding")
    return models.weighted_query_vectors(rows).select("query_id", F.posexplode("embedding").alias("dim", "x")).select("query_id", (F.col("dim") + 1).cast("long").alias("dim"), F.round("x", 6).alias("x"))


# ---- boosts, joins, statistics ------------------------------------------------------------------

_EDGE = "[^\\p{L}\\p{N}_]"


@query(f"""with {_PAPERS}, {_NAMED}, c as (select distinct id, paper_id, text from contexts where text is not null)
select c.id, c.paper_id, cast(case when m then 1.2 else 1.0 end as double) as score, m as author_match from (select c.*, len(list_filter(t.lastnames, lambda l: regexp_matches(lower(c.text), '(^|{_EDGE})' || regexp_escape(lower(l)) || '($|{_EDGE})'))) > 0 as m from c join t on t.id = c.paper_id) c""")
def author_boosts(s, d):
    names = _papers(s, d).select(F.col("id").alias("paper_id"), X.last_names(F.col("authors")).alias("lastnames"))
    c = load(s, d, "contexts").filter("text is not null").select("id", "paper_id", F.col("text").alias("query_text")).distinct().join(names, "paper_id").withColumn("score", F.lit(1.0))
    return retrieval.author_boost(c).select("id", "paper_id", "score", "author_match")


@query("""with r as (select distinct paper_id, neighbor_id from reference_sets where neighbor_id is not null), g as (select neighbor_id, count(*) as cited from r group by 1),
v as (select r.paper_id, r.neighbor_id, g.cited from r join g using (neighbor_id)), n as (select paper_id, count(*) as n from v group by 1),
k as (select v.*, n, row_number() over (partition by v.paper_id order by cited) as i from v join n using (paper_id)),
t as (select paper_id, cited as threshold from k where n >= 4 and i = floor(n * 0.75) + 1)
select v.paper_id, v.neighbor_id, cast(case when v.cited > coalesce(t.threshold, 0) then 1.1 else 1.0 end as double) as boost from v left join t using (paper_id)""")
def graph_boosts(s, d):
    edges = load(s, d, "reference_sets").filter("neighbor_id is not null").select("paper_id", "neighbor_id").distinct()
    cited = edges.groupBy("neighbor_id").agg(F.count(F.lit(1)).alias("cited"))
    valued = edges.join(cited, "neighbor_id")
    bars = retrieval.upper_quartile_rank(valued, "paper_id", "cited")
    return valued.join(bars, "paper_id").select("paper_id", "neighbor_id", F.when(F.col("cited") > F.col("threshold"), 1.1).otherwise(1.0).alias("boost"))


@query("""with r as (select distinct paper_id, neighbor_id, rank from reference_sets where neighbor_id is not null and rank is not null)
select paper_id, array_to_string(list(neighbor_id order by rank, neighbor_id)[1:50], ',') as neighbours from r group by 1""")
def reference_lists(s, d):
    r = load(s, d, "reference_sets").filter("neighbor_id is not null and rank is not null").select("paper_id", "neighbor_id", "rank").distinct()
    return r.groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "neighbor_id"))), lambda x: x["neighbor_id"]), ",").alias("neighbours"))


@query("""with r as (select distinct paper_id, neighbor_id from reference_sets where neighbor_id is not null), p as (select distinct id from papers),
c as (select paper_id, count(*) as n_refs, count(p.id) as n_resolved from r left join p on p.id = r.neighbor_id group by 1)
select paper_id, n_refs, n_resolved, round(n_resolved / n_refs, 6) as coverage from c where n_resolved / n_refs >= 0.3 and n_resolved >= 2""")
def coverage_gate(s, d):
    r = load(s, d, "reference_sets").filter("neighbor_id is not null").select("paper_id", F.col("neighbor_id").alias("ref_id")).distinct()
    return metadata.covered(r, load(s, d, "papers").select(F.col("id").alias("ref_id")), 0.3, 2)


@query("""with r as (select distinct record_id, title, doi from catalog_records)
select record_id from r where not exists (select 1 from papers p where p.doi <> '' and lower(p.doi) = lower(r.doi)) and not exists (select 1 from papers p where lower(trim(p.title)) = lower(trim(r.title)))""")
def records_not_in_corpus(s, d):
    return metadata.not_in_corpus(load(s, d, "catalog_records").select("record_id", "title", "doi").distinct(), load(s, d, "papers").select("title", "doi")).select("record_id")


@query("""with r as (select distinct record_id, title, lower(doi) as k from catalog_records where doi like '10.%'), p as (select distinct id, title, lower(doi) as k from papers where doi like '10.%'),
j as (select record_id, id, list_filter(list_distinct(regexp_extract_all(lower(coalesce(r.title, '')), '[a-z0-9]+')), lambda x: length(x) >= 3) as a, list_filter(list_distinct(regexp_extract_all(lower(p.title), '[a-z0-9]+')), lambda x: length(x) >= 3) as b from r join p using (k))
select record_id, id, round(case when len(list_distinct(a || b)) > 0 then len(list_intersect(a, b)) / len(list_distinct(a || b)) else 0 end, 6) as similarity from j""")
def doi_title_similarity(s, d):
    r = load(s, d, "catalog_records").filter("doi like '10.%'").select("record_id", F.coalesce("title", F.lit("")).alias("r_title"), F.lower("doi").alias("k")).distinct()
    p = load(s, d, "papers").filter("doi like '10.%'").select("id", "title", F.lower("doi").alias("k")).distinct()
    return r.join(p, "k").select("record_id", "id", F.round(metadata.jaccard(metadata.word_set(F.col("r_title")), metadata.word_set(F.col("title"))), 6).alias("similarity"))


_FUZZY = "trim(regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"""with r as (select distinct record_id, coalesce(title, '') as title, lower(doi) as k from catalog_records where doi like '10.%'), p as (select distinct id, title, lower(doi) as k from papers where doi like '10.%'),
j as (select record_id, id, {_FUZZY.format('r.title')} as x, {_FUZZY.format('p.title')} as y from r join p using (k)),
w as (select *, list_distinct(string_split(x, ' ')) as a, list_distinct(string_split(y, ' ')) as b from j)
select record_id, id, x = y or (length(x) > 20 and length(y) > 20 and (contains(x, y) or contains(y, x))) or (x <> '' and y <> '' and len(list_intersect(a, b)) / greatest(len(a), len(b)) >= 0.8) as same from w""")
def fuzzy_title_matches(s, d):
    r = load(s, d, "catalog_records").filter("doi like '10.%'").select("record_id", F.coalesce("title", F.lit("")).alias("r_title"), F.lower("doi").alias("k")).distinct()
    p = load(s, d, "papers").filter("doi like '10.%'").select("id", "title", F.lower("doi").alias("k")).distinct()
    return r.join(p, "k").select("record_id", "id", metadata.titles_match(F.col("r_title"), F.col("title")).alias("same"))


@query()
def fuzzy_gate(s, d):
    """Candidates by DOI; accepted at a token-sort ratio of 90, or of 80 with a year within one and a first author at 80; an unknown year or author accepts nothing."""
    ratio = metadata.token_sort_ratio
    r = load(s, d, "catalog_records").filter("doi like '10.%' and title is not null").select("record_id", F.col("title").alias("r_title"), F.col("year").alias("r_year"), F.split_part(F.coalesce("authors", F.lit("")), F.lit(";"), F.lit(1)).alias("r_author"), F.lower("doi").alias("k")).distinct()
    p = load(s, d, "papers").filter("doi like '10.%'").select("id", "title", "year", F.coalesce(F.get("authors", F.lit(0)), F.lit("")).alias("author"), F.lower("doi").alias("k")).distinct()
    scored = r.join(p, "k").withColumn("ratio", ratio(F.lower("r_title"), F.lower("title"))).withColumn("a_ratio", ratio(F.lower(X.last_name(F.col("r_author"))), F.lower(X.last_name(F.col("author")))))
    years = F.coalesce(F.abs(F.col("r_year") - F.col("year")) <= 1, F.lit(False))
    authors = (F.col("r_author") != "") & (F.col("author") != "") & (F.col("a_ratio") >= 80)
    return scored.select("record_id", "id", F.round("ratio", 3).alias("ratio"), ((F.col("ratio") >= 90) | ((F.col("ratio") >= 80) & years & authors)).alias("accepted"))


@query(f"""with {_PAPERS}, r as (select lower(doi) as k, min(container) as v from catalog_records where doi <> '' and container <> '' group by 1), t as (select title as k, min(container) as v from catalog_records where container <> '' group by 1)
select p.id, coalesce(nullif(p.journal, ''), r.v, t.v) as journal, case when p.journal <> '' then 0 when r.v is not null then 1 when t.v is not null then 2 end as origin from p left join r on r.k = lower(p.doi) left join t on t.k = p.title""")
def journal_enrichment(s, d):
    c = load(s, d, "catalog_records").filter("container <> ''")
    by_doi = c.filter("doi <> ''").groupBy(F.lower("doi").alias("doi_key")).agg(F.min("container").alias("value"))
    by_title = c.groupBy("title").agg(F.min("container").alias("value_t"))
    first = metadata.enrich(_papers(s, d).select("id", "title", "journal", F.lower("doi").alias("doi_key")), [by_doi], "doi_key", "journal").withColumnRenamed("origin", "o1")
    second = metadata.enrich(first, [by_title.withColumnRenamed("value_t", "value")], "title", "journal")
    return second.select("id", "journal", F.coalesce("o1", F.when(F.col("origin") == 1, 2)).cast("int").alias("origin"))


@query(f"""with {_PAPERS} select count(*) as n_papers, count(*) filter (abstract <> '') as with_abstract, count(year) as with_year, count(*) filter (len(authors) > 0) as with_authors, count(*) filter (doi <> '') as with_doi from p""")
def corpus_statistics(s, d):
    return _papers(s, d).agg(F.count(F.lit(1)).alias("n_papers"), F.count_if(F.col("abstract") != "").alias("with_abstract"), F.count("year").alias("with_year"), F.count_if(F.size("authors") > 0).alias("with_authors"), F.count_if(F.col("doi") != "").alias("with_doi"))


@query("with c as (select distinct id, paper_id, citation_type from contexts) select citation_type, count(*) as n_contexts, count(distinct paper_id) as n_papers from c group by 1")
def context_statistics(s, d):
    return load(s, d, "contexts").select("id", "paper_id", "citation_type").distinct().groupBy("citation_type").agg(F.count(F.lit(1)).alias("n_contexts"), F.count_distinct("paper_id").alias("n_papers"))


@query("select distinct id, paper_id, citation_type, difficulty from contexts where citation_type = 'background' and difficulty is not null")
def contexts_filtered(s, d):
    return load(s, d, "contexts").filter("citation_type = 'background' and difficulty is not null").select("id", "paper_id", "citation_type", "difficulty").distinct()


@query(f"with {_PAPERS} select count(*) as n_calls, cast(sum(length(title) // 4 + coalesce(length(abstract), 0) // 4) as bigint) as tokens from p where length(abstract) >= 50")
def enrichment_cost(s, d):
    p = _papers(s, d).filter("length(abstract) >= 50")
    return p.agg(F.count(F.lit(1)).alias("n_calls"), F.sum(F.expr("length(title) div 4 + coalesce(length(abstract), 0) div 4")).alias("tokens"))


@query(f"with {_PAPERS} select id, title, cast(year as varchar) as year, journal from p where title is not null or year is not null or journal is not null")
def fields_pivot(s, d):
    p = _papers(s, d).select("id", F.explode(F.create_map(F.lit("title"), F.col("title"), F.lit("year"), F.col("year").cast("string"), F.lit("journal"), F.col("journal"))).alias("field", "value")).filter("value is not null")
    return metadata.fields_to_columns(p, "id", ["title", "year", "journal"])


@query(f"with {_PAPERS} select id, array_to_string(list_filter(string_split_regex(abstract, '\\s+'), lambda x: x <> ''), ' ') as abstract from p where abstract <> ''")
def abstracts_from_index(s, d):
    words = _papers(s, d).filter("abstract <> ''").select("id", F.posexplode(F.filter(F.split("abstract", r"\s+"), lambda x: x != "")).alias("pos", "word"))
    inverted = words.groupBy("id", "word").agg(F.collect_list("pos").alias("p")).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("word", "p"))).alias("inverted"))
    return metadata.abstract_from_index(inverted, "id")


@query(f"with {_PAPERS} select count(*) as n from p where contains(lower(title), 'basin') or contains(lower(array_to_string(authors, ' ')), 'basin')")
def explorer_search(s, d):
    return _papers(s, d).filter(F.lower("title").contains("basin") | F.coalesce(F.lower(F.array_join("authors", " ")).contains("basin"), F.lit(False))).agg(F.count(F.lit(1)).alias("n"))


@query()
def file_matches(s, d):
    p = load(s, d, "papers")
    return match_files(p.select(F.col("source_file").alias("file")), _papers(s, d).select("id", "title", "authors", "year", "doi", "bibtex_key"))


@query()
def cautious_sentences(s, d):
    """Abbreviation-aware sentences; DuckDB's patterns have no lookaround."""
    return load(s, d, "contexts").filter("text is not null").select("id", prose.cautious_sentences(F.col("text")).alias("sentences")).distinct()


@query("""with r as (select distinct record_id, doi from catalog_records where doi is not null)
select record_id, nullif(regexp_extract(doi, 'doi\\.org/(10\\.[0-9]{4,9}/[^?#\\s]+)', 1, 'i'), '') as doi from r""")
def address_identifiers(s, d):
    return load(s, d, "catalog_records").filter("doi is not null").select("record_id", "doi").distinct().select("record_id", prose.identifiers(F.col("doi"))["doi"].alias("doi"))


@query(f"""with {_PAPERS}, c as (select distinct id, paper_id, text from contexts where text <> ''), r as (select distinct paper_id, neighbor_id, rank from reference_sets where neighbor_id is not null and rank is not null),
l as (select paper_id, list(neighbor_id order by rank, neighbor_id) as refs from r group by 1)
select c.id, array_to_string(case when l.refs is null then [c.paper_id] when list_contains(l.refs, c.paper_id) then l.refs else list_prepend(c.paper_id, l.refs) end, ',') as reference_set from c join p on p.id = c.paper_id left join l on l.paper_id = c.paper_id""")
def export_contexts(s, d):
    """Contexts with their reference sets, the paper itself put in where it is missing."""
    r = load(s, d, "reference_sets").filter("neighbor_id is not null and rank is not null").select("paper_id", "neighbor_id", "rank").distinct()
    lists = r.groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "neighbor_id"))), lambda x: x["neighbor_id"]).alias("refs"))
    c = load(s, d, "contexts").filter("text <> ''").select("id", "paper_id", "text").distinct().join(_papers(s, d).select(F.col("id").alias("paper_id")), "paper_id").join(lists, "paper_id", "left")
    own = F.when(F.col("refs").isNull(), F.array("paper_id")).when(F.array_contains("refs", F.col("paper_id")), F.col("refs")).otherwise(F.array_prepend("refs", F.col("paper_id")))
    return c.select("id", F.array_join(own, ",").alias("reference_set"))


@query(f"""with {_PAPERS} select id, 'Describe the paper.' || chr(10) || chr(10) || 'Title: ' || title || coalesce(chr(10) || chr(10) || 'Abstract: ' || nullif(abstract, ''), '') as prompt from p where title <> ''""")
def enrichment_prompts(s, d):
    return _papers(s, d).filter("title <> ''").select("id", prose.prompt("Describe the paper.", title=F.col("title"), abstract=F.col("abstract")).alias("prompt"))


# ---- incremental tables and triggers --------------------------------------------------------------


@query(f"""with {_PAPERS}, {_NAMED}, o as (select id, any_value(length(title)) as old_len, min(year) as old_year from papers group by id having count(*) > 1)
select t.id, t.title, o.id is null or coalesce(o.old_year, -1) <> coalesce(t.year, -1) as needs_embedding from t left join o on o.id = t.id""")
def upsert_papers(s, d):
    raw = load(s, d, "papers")
    old = raw.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("year").alias("y")).filter("n > 1").select("id", F.coalesce("y", F.lit(-1)).cast("string").alias("text"), F.lit("kept").alias("embedding"))
    new = _papers(s, d).select("id", "title", F.coalesce("year", F.lit(-1)).cast("string").alias("text"))
    return upsert.upsert(old.withColumn("title", F.lit(None).cast("string")), new, "id", "text", "embedding").select("id", "title", "needs_embedding")


@query("""with a as (select distinct id, max(updated_at) as m from papers group by 1), b as (select id, min(updated_at) as m from papers where id not like '%7' group by 1)
select coalesce(a.id, b.id) as path, case when a.id is null then 'deleted' when b.id is null then 'new' when a.m > b.m then 'changed' else 'unchanged' end as state from (select * from a where id not like '%3') a full outer join b on a.id = b.id""")
def changed_sources(s, d):
    p = load(s, d, "papers")
    now = p.filter("id not like '%3'").groupBy(F.col("id").alias("path")).agg(F.max("updated_at").alias("modified"))
    then = p.filter("id not like '%7'").groupBy(F.col("id").alias("path")).agg(F.min("updated_at").alias("modified"))
    return upsert.changed_files(now, then)


@query("""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hours then 0 else 1 end as fresh from events where ts is not null),
n as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows between unbounded preceding and current row) as k from g)
select user_id, min(ts) as started, max(ts) + interval 6 hours as fires_at, count(*) as n_events from n group by user_id, k""")
def quiet_triggers(s, d):
    return quiet_sessions(load(s, d, "events"), "6 hours")


@query("select event_id from events where regexp_matches(props, '\"k\": 1[0-9]') or regexp_matches(event_type, '^pur')")
def pattern_triggers(s, d):
    lines = load(s, d, "events").select("event_id", F.concat_ws("\n", "event_type", "props").alias("line"))
    return matching_lines(lines, [r'"k": 1[0-9]', "^pur", "(broken"]).select("event_id")


# ---- exports ------------------------------------------------------------------------------------

_ESC = "replace(replace(replace(replace({0}, '\\', chr(1)), '{{', '\\{{'), '}}', '\\}}'), chr(1), '\\textbackslash\\{{\\}}')"
for _sign in "&%#_":
    _ESC = f"replace({_ESC}, '{_sign}', '\\{_sign}')"
_ESC = f"replace(replace({_ESC}, '~', '\\textasciitilde{{{{}}}}'), '^', '\\textasciicircum{{{{}}}}')"


@query(f"""with {_PAPERS}, k as (select *, regexp_replace(lower(concat_ws('', case when len(authors) > 0 then list_transform(authors[1:1], lambda a: {_LAST})[1] end, cast(nullif(year, 0) as varchar),
  list_filter(list_transform(string_split_regex(title, '\\s+'), lambda x: regexp_replace(x, '[^a-zA-Z]', '', 'g')), lambda x: length(x) >= 3)[1])), '[^a-z0-9]', '', 'g') as made from p)
select id, '@article{{' || coalesce(nullif(bibtex_key, ''), nullif(made, ''), id) || ',' || chr(10) || concat_ws(',' || chr(10), '  title = {{' || {_ESC.format('title')} || '}}',
  case when len(authors) > 0 then '  author = {{' || {_ESC.format("array_to_string(authors, ' and ')")} || '}}' end, '  year = {{' || cast(year as varchar) || '}}', '  journal = {{' || {_ESC.format("nullif(journal, '')")} || '}}',
  '  doi = {{' || nullif(doi, '') || '}}', '  abstract = {{' || {_ESC.format("nullif(abstract, '')")} || '}}') || chr(10) || '}}' as entry from k""")
def export_bibtex(s, d):
    return _papers(s, d).select("id", citations.bibtex_entry().alias("entry"))


@query(f"""with {_PAPERS} select id, concat_ws(chr(10), 'TY  - JOUR', 'TI  - ' || title, case when len(authors) > 0 then array_to_string(list_transform(authors, lambda a: 'AU  - ' || a), chr(10)) end,
  'PY  - ' || cast(year as varchar), 'DO  - ' || nullif(doi, ''), 'JO  - ' || nullif(journal, ''), 'AB  - ' || nullif(abstract, ''), 'ER  - ') as entry from p""")
def export_ris(s, d):
    return _papers(s, d).select("id", citations.ris_record().alias("entry"))


@query(f"""with {_PAPERS}, n as (select *, list_transform(coalesce(authors, []), lambda a: {_LAST}) as names from p)
select id, concat_ws(' ', case when len(names) = 0 then null when len(names) <= 2 then array_to_string(names, ' & ') else array_to_string(names[1:len(names) - 1], ', ') || ', & ' || list_last(names) end,
  case when year is not null then '(' || cast(year as varchar) || ').' else '(n.d.).' end, title || '.', nullif(journal, '') || '.', 'https://doi.org/' || nullif(doi, '')) as entry from n""")
def export_plain(s, d):
    return _papers(s, d).withColumn("authors", F.coalesce("authors", F.array().cast("array<string>"))).select("id", citations.plain_entry().alias("entry"))


@query(f"""with {_PAPERS}, r as (select distinct c.paper_id as grp, p.bibtex_key, p.id from contexts c join p on p.id = c.paper_id)
select journal_group, '\\cite{{' || array_to_string(list_sort(list_distinct(list(coalesce(nullif(bibtex_key, ''), id)))), ',') || '}}' as citation from (select coalesce(journal, '') as journal_group, bibtex_key, id from p) group by 1""")
def export_grouped(s, d):
    return citations.grouped_citation(_papers(s, d).withColumn("journal_group", F.coalesce("journal", F.lit(""))), "journal_group")
