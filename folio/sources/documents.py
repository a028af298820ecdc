"""Sources of structured documents: BibTeX, TEI and web pages, parsed per file inside tasks."""

from __future__ import annotations

import hashlib
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BIBTEX = "id string, bibtex_key string, entry_type string, title string, authors array<string>, year int, doi string, abstract string, journal string"
TEI = "path string, title string, authors array<string>, abstract string, sections array<struct<heading: string, paragraphs: array<string>>>, refs array<struct<title: string, authors: array<string>, year: int, doi: string, journal: string>>"
PAGE = "page_id long, title string, authors array<string>, doi string, abstract string, headings array<string>, paragraphs array<string>"


def parse_bibtex(text: str) -> list[dict]:
    """Entries of a BibTeX text: type, key and fields; braces and quotes may be nested, @comment and the like are skipped."""
    entries, at = [], 0
    while (start := text.find("@", at)) >= 0:
        head = re.compile(r"@\s*(\w+)\s*[{(]\s*").match(text, start)
        if not head:
            at = start + 1
            continue
        at = head.end()
        depth, end = 1, at
        while end < len(text) and depth:
            depth += (text[end] in "{(" and text[end] != "(") - (text[end] == "}")
            end += 1
        body, at = text[at : end - 1], end
        if head.group(1).lower() in ("comment", "preamble", "string"):
            continue
        key, _, rest = body.partition(",")
        fields, i = {}, 0
        while m := re.compile(r"\s*([\w:.+-]+)\s*=\s*").match(rest, i):
            i = m.end()
            value = ""
            while i < len(rest):
                if rest[i] == "{":
                    depth, j = 1, i + 1
                    while j < len(rest) and depth:
                        depth += (rest[j] == "{") - (rest[j] == "}")
                        j += 1
                    value, i = value + rest[i + 1 : j - 1], j
                elif rest[i] == '"':
                    depth, j = 0, i + 1
                    while j < len(rest) and (rest[j] != '"' or depth):
                        depth += (rest[j] == "{") - (rest[j] == "}")
                        j += 1
                    value, i = value + rest[i + 1 : j], j + 1
                else:
                    word = re.compile(r"[^,#\s]*").match(rest, i)
                    value, i = value + word.group(), word.end()
                glue = re.compile(r"\s*#\s*").match(rest, i)
                if not glue:
                    break
                i = glue.end()
            fields[m.group(1).lower()] = value
            comma = re.compile(r"\s*,?").match(rest, i)
            i = comma.end()
        entries.append({"type": head.group(1).lower(), "key": key.strip(), "fields": fields})
    return entries


def _plain(latex: str) -> str:
    text = re.sub(r"\\(?:textit|textbf|emph)\s*\{([^{}]*)\}", r"\1", latex)
    text = re.sub(r"[{}]", "", text)
    for mark, sign in (("\\'", "'"), ('\\"', '"'), ("\\&", "&")):
        text = text.replace(mark, sign)
    return " ".join(text.split())


def _address_free(doi: str) -> str | None:
    return re.sub(r"https?://(dx\.)?doi\.org/", "", doi).strip() or None


def bibtex_row(entry: dict) -> dict | None:
    """A paper of an entry, None without a title; 'Last, First' becomes 'First Last'; booktitle and address fields stand in."""
    f = entry["fields"]
    title = _plain(f.get("title", ""))
    if not title:
        return None
    authors = []
    for name in re.split(r"\s+and\s+", _plain(f.get("author", "")), flags=re.I):
        last, comma, first = (x.strip() for x in name.partition(","))
        if last or first:
            authors.append(f"{first} {last}" if comma else last)
    digits = re.sub(r"\D", "", f.get("year", ""))
    doi = _address_free(f["doi"]) if f.get("doi") else None
    for other in ("bdsk-url-1", "bdsk-url-2", "url"):
        if not doi and "doi.org" in f.get(other, ""):
            doi = _address_free(f[other])
    journal = f.get("journal", f.get("booktitle"))
    return {
        "id": "bib_" + hashlib.md5(entry["key"].encode()).hexdigest()[:12], "bibtex_key": entry["key"], "entry_type": entry["type"], "title": title, "authors": authors,
        "year": int(digits) if digits and len(digits) < 9 else None, "doi": doi, "abstract": _plain(f["abstract"]) if "abstract" in f else None, "journal": _plain(journal) if journal else None,
    }


def _frame(rows: list[dict], schema: str) -> pd.DataFrame:
    names = re.findall(r"(\w+) (?:string|int|long|array)", re.sub(r"<[^<>]*(?:<[^<>]*(?:<[^<>]*>[^<>]*)*>[^<>]*)*>", "", schema))
    frame = pd.DataFrame(rows, columns=names).astype(object)
    return frame.where(frame.map(lambda x: isinstance(x, (list, dict)) or pd.notna(x)), None)


def read_bibtex(spark: SparkSession, path: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield _frame([r for text in f["value"] for e in parse_bibtex(text) if (r := bibtex_row(e))], BIBTEX)

    return spark.read.text(path, wholetext=True).mapInPandas(run, BIBTEX)


def parse_tei(xml: str) -> dict | None:
    """Header, body sections and references of a TEI document, whatever its namespace; None if it isn't XML."""
    try:
        root = ET.fromstring(re.sub(r'\sxmlns(:\w+)?="[^"]*"', "", xml))
    except ET.ParseError:
        return None
    clean = lambda s: " ".join((s or "").split())
    whole = lambda e: clean(" ".join(e.itertext())) if e is not None else ""

    def people(e: ET.Element) -> list[str]:
        names = (clean(" ".join(filter(None, (a.findtext(".//forename"), a.findtext(".//surname"))))) for a in e.findall(".//author"))
        return [n for n in names if n]

    refs = []
    for b in root.findall(".//back//listBibl/biblStruct"):
        when = (b.find(".//date[@when]").get("when") if b.find(".//date[@when]") is not None else "")[:4]
        title = b.find(".//title[@level='a']")
        title = title if title is not None else b.find(".//title")
        refs.append({"title": clean(title.text) if title is not None else None, "authors": people(b), "year": int(when) if when.isdigit() else None, "doi": clean(b.findtext(".//idno[@type='DOI']")) or None, "journal": clean(b.findtext(".//title[@level='j']")) or None})
    sections = [{"heading": clean(d.findtext("head")) or None, "paragraphs": [t for p in d.findall("p") if (t := whole(p))]} for d in root.findall(".//body//div")]
    source = root.find(".//sourceDesc")
    return {"title": clean(root.findtext(".//titleStmt/title")), "authors": people(source) if source is not None else [], "abstract": whole(root.find(".//profileDesc/abstract")), "sections": sections, "refs": refs}


def read_tei(spark: SparkSession, path: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield _frame([{"path": p, **r} for p, text in zip(f["path"], f["value"]) if (r := parse_tei(text))], TEI)

    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value").mapInPandas(run, TEI)


class _Page(HTMLParser):
    """Meta tags, headings and paragraphs of a page; navigation and the like is noise."""

    NOISE = frozenset(("nav", "header", "footer", "aside", "script", "style", "form", "button", "noscript"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, list[str]] = {}
        self.title, self.headings, self.paragraphs = "", [], []
        self.noise, self.into, self.text = 0, "", []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "meta" and (a.get("name") or a.get("property")) and a.get("content"):
            self.meta.setdefault((a.get("name") or a["property"]).lower(), []).append(a["content"].strip())
        if tag in self.NOISE:
            self.noise += 1
        elif tag in ("title", "h1", "h2", "h3", "h4", "p", "li"):
            self.close_block()
            self.into = tag

    def handle_endtag(self, tag):
        if tag in self.NOISE:
            self.noise = max(0, self.noise - 1)
        elif tag == self.into:
            self.close_block()

    def handle_data(self, data):
        if self.into and not self.noise:
            self.text.append(data)

    def close_block(self):
        text = " ".join("".join(self.text).split())
        if text and self.into == "title":
            self.title = self.title or text
        elif text and self.into in ("h2", "h3", "h4"):
            self.headings.append(text)
        elif self.into == "p" and len(text) > 30:
            self.paragraphs.append(text)
        self.into, self.text = "", []


def parse_page(html: str) -> dict:
    """citation_*, DC.* and og:* metadata, headings and paragraphs over 30 characters of a web page."""
    p = _Page()
    p.feed(html or "")
    p.close_block()
    first = lambda *names: next((p.meta[n][0] for n in names if n in p.meta), None)
    return {
        "title": first("citation_title", "dc.title", "og:title") or p.title or None, "authors": p.meta.get("citation_author", p.meta.get("dc.creator", [])), "doi": _address_free(first("citation_doi", "dc.identifier") or "") if first("citation_doi", "dc.identifier") else None,
        "abstract": first("citation_abstract", "dc.description", "og:description", "description"), "headings": p.headings, "paragraphs": p.paragraphs,
    }


def parse_pages(pages: DataFrame) -> DataFrame:
    """(page_id, html) -> metadata and structure of each page."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield _frame([{"page_id": i, **parse_page(h)} for i, h in zip(f["page_id"], f["html"])], PAGE)

    return pages.select("page_id", "html").mapInPandas(run, PAGE)


def list_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """Files below a folder with size and time, without reading them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def largest_attachment(files: DataFrame, key: str) -> DataFrame:
    """The largest file of each item, the first path among equals."""
    return files.groupBy(key).agg(F.min_by("path", F.struct(-F.col("size"), F.col("path"))).alias("path"), F.max("size").alias("size"))
