"""Atom feed dumps -> feed papers -> day window with cross-listed categories."""

import os
import tempfile

from pyspark.sql import functions as F

from feedrank.sources import feed

ATOM = """<?xml version="1.0" encoding="UTF-8"?>
<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom">
  <entry>
    <id>http://arxiv.org/abs/2305.15334v1</id>
    <published>2023-05-24T17:01:21Z</published>
    <title>A paper on language</title>
    <summary>First line
second line</summary>
    <author><name>Ann Author</name></author>
    <author><name>Bob Writer</name></author>
    <link href="http://arxiv.org/abs/2305.15334v1" rel="alternate" type="text/html"/>
    <link title="pdf" href="http://arxiv.org/pdf/2305.15334v1" rel="related" type="application/pdf"/>
    <arxiv:primary_category term="cs.CL" scheme="http://arxiv.org/schemas/atom"/>
    <category term="cs.CL" scheme="http://arxiv.org/schemas/atom"/>
    <category term="stat.ML" scheme="http://arxiv.org/schemas/atom"/>
  </entry>
  <entry>
    <id>http://arxiv.org/abs/2305.20000v2</id>
    <published>2023-05-23T09:00:00Z</published>
    <title>Another one</title>
    <summary>Robots.</summary>
    <author><name>Solo</name></author>
    <link title="pdf" href="http://arxiv.org/pdf/2305.20000v2" rel="related" type="application/pdf"/>
    <arxiv:primary_category term="cs.RO" scheme="http://arxiv.org/schemas/atom"/>
    <category term="cs.RO" scheme="http://arxiv.org/schemas/atom"/>
  </entry>
</feed>
"""


def test_atom_to_feed_and_window(spark):
    d = tempfile.mkdtemp(prefix="feedrank-atom-", dir=os.environ.get("TMPDIR", "/tmp"))
    with open(os.path.join(d, "day.xml"), "w") as f:
        f.write(ATOM)
    papers = feed.read_atom(spark, d)
    rows = {r["paper_id"]: r for r in papers.collect()}
    p = rows["2305.15334v1"]
    assert p["abstract"] == "First line second line"
    assert p["authors"] == ["Ann Author", "Bob Writer"]
    assert p["url"] == "http://arxiv.org/pdf/2305.15334v1"
    assert p["primary_category"] == "cs.CL" and p["categories"] == ["cs.CL", "stat.ML"]
    assert rows["2305.20000v2"]["authors"] == ["Solo"]
    # run date 2023-05-25 -> papers submitted on 2023-05-24 (UTC), any listed category
    day = feed.feed_for_day(papers, "2023-05-25", ["stat.ML"])
    assert [r["paper_id"] for r in day.collect()] == ["2305.15334v1"]
    none = feed.feed_for_day(papers, "2023-05-25", ["cs.RO"])
    assert none.count() == 0
    default = feed.feed_for_day(papers, "2023-05-24", "not-a-list")      # default categories
    assert [r["paper_id"] for r in default.collect()] == ["2305.20000v2"]
    top = feed.newest_first(papers, 1).collect()
    assert top[0]["paper_id"] == "2305.15334v1" and top[0]["rank"] == 1
    assert papers.select(F.hour("published")).first()[0] == 17
