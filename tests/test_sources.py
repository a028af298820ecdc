from __future__ import annotations

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from folio.sinks import citations
from folio.sources import documents, schemas
from folio.streaming.triggers import matching_lines, quiet_sessions

BIB = """@comment{x, y}
@article{smith2023, title = {The {Climate} of \\emph{X}}, author = "Smith, Jane and Bob Lee", year = 2023, journal = {J. One}, doi = {https://doi.org/10.1/a}, abstract = {Some {nested {braces}} here.}}
@inproceedings{lee, title={A, B = C}, booktitle = {Proc. Two}, url = {https://doi.org/10.2/b} }
@misc{none, author={X}}
@article{min, title = "Minimal" # " joined"}
"""
TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>On  Things</title></titleStmt><sourceDesc><biblStruct><author><persName><forename>Ann</forename><surname>Lee</surname></persName></author></biblStruct></sourceDesc></fileDesc>
<profileDesc><abstract><p>Short abstract.</p></abstract></profileDesc></teiHeader><text><body><div><head>Intro</head><p>First <ref>[1]</ref> text.</p></div></body><back><listBibl><biblStruct><analytic><title level="a">Ref</title><author><persName><surname>Kim</surname></persName></author><idno type="DOI">10.3/c</idno></analytic>
<monogr><title level="j">J</title><imprint><date when="2019-05"/></imprint></monogr></biblStruct></listBibl></back></text></TEI>"""
HTML = """<html><head><title>t</title><meta name="citation_title" content="Page Title"><meta name="citation_author" content="Ann"><meta name="citation_author" content="Bob"><meta name="citation_doi" content="https://doi.org/10.4/d"></head>
<body><nav><p>Navigation text that is longer than thirty characters</p></nav><h2>Part</h2><p>A paragraph with <b>more</b> than thirty characters in it.</p><p>short</p></body></html>"""


def test_bibtex(spark, tmp_path):
    (tmp_path / "a.bib").write_text(BIB)
    got = {r.bibtex_key: r for r in documents.read_bibtex(spark, str(tmp_path)).collect()}
    assert set(got) == {"smith2023", "lee", "min"}
    s = got["smith2023"]
    assert (s.title, s.authors, s.year, s.doi, s.journal, s.abstract) == ("The Climate of X", ["Jane Smith", "Bob Lee"], 2023, "10.1/a", "J. One", "Some nested braces here.")
    assert got["lee"].journal == "Proc. Two" and got["lee"].doi == "10.2/b" and got["lee"].year is None and got["min"].title == "Minimal joined" and s.id.startswith("bib_") and len(s.id) == 16


def test_tei(spark, tmp_path):
    (tmp_path / "a.xml").write_text(TEI)
    (tmp_path / "b.xml").write_text("<broken")
    rows = documents.read_tei(spark, str(tmp_path)).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.title, r.authors, r.abstract) == ("On Things", ["Ann Lee"], "Short abstract.")
    assert r.sections[0].heading == "Intro" and r.sections[0].paragraphs == ["First [1] text."] and (r.refs[0].title, r.refs[0].year, r.refs[0].doi, r.refs[0].journal) == ("Ref", 2019, "10.3/c", "J")


def test_pages(spark):
    r = documents.parse_pages(spark.createDataFrame([(1, HTML), (2, None)], "page_id long, html string")).orderBy("page_id").collect()
    assert (r[0].title, r[0].authors, r[0].doi, r[0].headings, r[0].paragraphs) == ("Page Title", ["Ann", "Bob"], "10.4/d", ["Part"], ["A paragraph with more than thirty characters in it."])
    assert r[1].title is None and r[1].paragraphs == []


def test_json_lines(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"id": "a", "title": "T"}\n\n{"id": "", "title": "U"}\n{"id": "b", "title": "V", "authors": ["X"], "year": 2020}\n')
    got = {r.id: r for r in schemas.read_papers(spark, str(tmp_path / "p.jsonl")).collect()}
    assert got["a"].abstract == "" and got["a"].authors == [] and got["b"].year == 2020 and len(got) == 2
    (tmp_path / "q.txt").write_text("first\n\n  second  \n")
    assert [(r.query_id, r.text) for r in schemas.read_queries(spark, str(tmp_path / "q.txt")).collect()] == [(0, "first"), (2, "second")]


def test_fulltext(spark, tmp_path):
    body = "x" * 60
    doc = {"paper_id": "p", "body_text": [{"section": "1 Intro", "text": f"Text {{{{cite:1}}}} {body}", "cite_spans": [{"start": 5, "end": 15, "ref_id": "r1"}]}, {"section": "References", "text": body, "cite_spans": []}], "bib_entries": {"r1": {"bib_entry_raw": "raw", "ids": {"open_alex_id": "https://openalex.org/W1"}}}}
    (tmp_path / "d.jsonl").write_text(json.dumps(doc))
    df = spark.read.schema(schemas.FULLTEXT).json(str(tmp_path / "d.jsonl"))
    assert [r.para for r in schemas.fulltext_paragraphs(df).collect()] == [f"Text {body}"]
    assert [(r.ref_id, r.open_alex_id) for r in schemas.cited_entries(df).collect()] == [("r1", "W1")]


def test_files(spark, tmp_path):
    (tmp_path / "k1").mkdir()
    (tmp_path / "k1" / "a.pdf").write_bytes(b"12")
    (tmp_path / "k1" / "b.pdf").write_bytes(b"123")
    (tmp_path / "k1" / "c.txt").write_bytes(b"1234")
    files = documents.list_files(spark, str(tmp_path)).withColumn("k", F.element_at(F.split("path", "/"), -2))
    assert [r.path[-5:] for r in documents.largest_attachment(files, "k").collect()] == ["b.pdf"]


def test_exports(spark, tmp_path):
    schema = "id string, title string, abstract string, authors array<string>, year int, doi string, journal string, bibtex_key string"
    df = spark.createDataFrame([("p1", "50% of A_B", "", ["Smith, J.", "Lee, A.", "Kim, B."], 2020, "10.1/x", "J & K", None), ("p2", "On it", None, [], None, None, None, "key")], schema)
    r = df.select(citations.bibtex_entry().alias("b"), citations.ris_record().alias("r"), citations.plain_entry().alias("p")).collect()
    assert r[0].b.startswith("@article{smith2020") and r[1].b.startswith("@article{key,")
    assert "50\\% of A\\_B" in r[0].b and "J \\& K" in r[0].b and r[1].b.startswith("@article{key,")
    assert r[0].r.startswith("TY  - JOUR\nTI  - 50% of A_B\nAU  - Smith, J.") and r[1].r.endswith("\nER  - ")
    assert r[0].p == "Smith, Lee, & Kim (2020). 50% of A_B. J & K. https://doi.org/10.1/x" and r[1].p == "(n.d.). On it."
    citations.write_lines(df, citations.ris_record(), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() > 5


def test_stream_agrees_with_batch(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(u, t0 + timedelta(minutes=m)) for u in (1, 2) for m in (0, 5, 8, 60, 61, 200)] + [(1, None)]
    schema = "user_id long, ts timestamp"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    far = [(9, t0 + timedelta(days=2))]
    spark.createDataFrame(far, schema).write.mode("append").parquet(str(tmp_path / "in"))
    stream = quiet_sessions(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "30 minutes", "1 minute")
    q = stream.writeStream.outputMode("append").format("memory").queryName("fired").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.user_id, r.started, r.n_events) for r in spark.table("fired").collect()}
    batch = {(r.user_id, r.started, r.n_events) for r in quiet_sessions(spark.createDataFrame(rows, schema), "30 minutes").collect()}
    assert got == batch and len(batch) == 6


def test_line_patterns(spark):
    df = spark.createDataFrame([("cite \\cite{",), ("plain",), (None,)], "line string")
    assert matching_lines(df, [r"\\cite\{", "(broken"]).count() == 1 and matching_lines(df, ["("]).count() == 0
