"""Bibliography scan: parser cases, rejects, counts, missing files."""

import os
import tempfile

from feedrank.sources import bibtex

BIB = """% leading comment
@article{smith2020,
  title = {Deep {Learning} for Things},
  author = {John Smith and  Jane
   Doe},
  abstract = "An abstract with {braces}, and @ at signs",
  year = 2020,
  eprint = {2001.00001}
}

@inproceedings{noabs,
  title={Only annote},
  annote={The annote text},
  author={A and B}
}
@string{jan = "January"}
@misc{notitle, author={X}}
@article{broken, title={Oops
@article{after, title = "Concat" # { more}, doi = {10.1/x}, url={http://x.org/a}}
@book(paren, title = {Paren style})
"""


def _write(text, name="lib.bib"):
    d = tempfile.mkdtemp(prefix="feedrank-bib-", dir=os.environ.get("TMPDIR", "/tmp"))
    with open(os.path.join(d, name), "w") as f:
        f.write(text)
    return d


def test_scan_entries_and_rejects(spark):
    raw = bibtex.scan_bib(spark, _write(BIB))
    entries, rejects = bibtex.library_entries(raw)
    e = {r["entry_id"]: r for r in entries.orderBy(*bibtex.PLACE).collect()}
    assert list(e) == ["smith2020", "noabs", "after", "paren"]
    s = e["smith2020"]
    assert s["title"] == "Deep {Learning} for Things"
    assert s["authors"] == ["John Smith", "Jane Doe"]
    assert s["abstract"] == "An abstract with {braces}, and @ at signs"
    assert s["year"] == "2020" and s["arxiv_id"] == "2001.00001" and s["doi"] is None
    assert e["noabs"]["abstract"] == "The annote text"
    assert e["after"]["title"] == "Concat more" and e["after"]["url"] == "http://x.org/a"
    assert e["after"]["abstract"] == "" and e["after"]["authors"] == []
    assert e["paren"]["entry_type"] == "book"
    reasons = {r["entry_id"]: r["reason"] for r in rejects.collect()}
    assert reasons == {"notitle": "empty title", "broken": "unbalanced braces"}


ODD = """Notes before anything, mail me @ home.
@string{jcs = "Journal of " # {Codes}}
@string(long = jcs # ", long series")
@article{one, title = {First}, journal = jcs, year = 2001} text after an entry
   @article{two,
     title = {Indented}, journal = long # { (reprint)}, month = jan}
@article{three, title = {A value
@ line and
@twitter handle}, year = "2003"}  @misc{four, title = {Same line}}
% a comment line
@comment{@article{no, title = {Never}}}
@string{jcs = {Renamed}}
@article{five, title = {Later}, journal = JCS}
@article{six, title = {Never closed,
  @article{seven, title = {After the broken one}}
"""


def test_text_between_entries_indented_heads_and_string_names(spark):
    raw = bibtex.scan_bib(spark, _write(ODD))
    got = {r["entry_id"]: r for r in raw.orderBy(*bibtex.PLACE).collect()}
    assert list(got) == ["one", "two", "three", "four", "five", "six", "seven"]
    assert {k for k, r in got.items() if r["error"]} == {"six"}
    assert got["one"]["fields"] == {"title": "First", "journal": "Journal of Codes", "year": "2001"}
    assert got["two"]["fields"] == {"title": "Indented", "journal": "Journal of Codes, long series (reprint)", "month": "jan"}
    assert got["three"]["fields"] == {"title": "A value\n@ line and\n@twitter handle", "year": "2003"}
    assert got["five"]["fields"]["journal"] == "Renamed"
    c = bibtex.ingest_counts(raw).first()
    assert (c["n_raw"], c["n_processed"], c["n_skipped"]) == (7, 6, 1)


def test_any_split_gives_the_same_entries(spark):
    text = ODD.replace("one,", "zero,", 1) + "".join(
        f"@article{{e{i}, title = {{Title {i}\n@ more\n@ and more}}, journal = jcs}}\n  @misc{{m{i}, title={{M}}}} tail\n" for i in range(12))
    path = _write(text)

    def entries():
        rows = bibtex.scan_bib(spark, path).orderBy(*bibtex.PLACE).collect()
        return [(r["entry_id"], r["fields"], r["error"]) for r in rows]

    whole = entries()
    assert len(whole) == 31 and whole[7][1] == {"title": "Title 0\n@ more\n@ and more", "journal": "Renamed"}
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in (90, 700):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 0)
            assert entries() == whole, size
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_empty_file(spark):
    assert bibtex.scan_bib(spark, _write("")).count() == 0
    assert bibtex.scan_bib(spark, _write("no entries here, only @ signs\n")).count() == 0


def test_counts_and_order(spark):
    raw = bibtex.scan_bib(spark, _write(BIB))
    c = bibtex.ingest_counts(raw).first()
    assert (c["n_raw"], c["n_processed"], c["n_skipped"]) == (6, 4, 2)
    first = bibtex.load_library(spark, _write(BIB), debug_limit=2).collect()
    assert [r["entry_id"] for r in first] == ["smith2020", "noabs"]


def test_missing_path_is_empty(spark):
    assert bibtex.scan_bib(spark, "/nonexistent/feedrank/path").count() == 0


def test_scanner_direct():
    assert bibtex.scan_entry("@article{k, title={a}, title={b}}")[3] == "duplicate field title"
    assert bibtex.scan_entry("comment{whatever}")[0] == "comment"
    t, k, f, err = bibtex.scan_entry('article{k,\n  title = "A {"}B" ,\n}')
    assert err is None and f["title"] == 'A {"}B'
