"""Prompt templates, score parsing, and the flat / report sinks."""

import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from feedrank import sinks
from feedrank.functions import scores, text
from feedrank.session import scratch_path


def test_parse_template_cases():
    assert text.parse_template("a {x} b", {"x"}) == [("lit", "a "), ("field", "x"), ("lit", " b")]
    assert text.parse_template("{{x}} {x}", {"x"}) == [("lit", "{x} "), ("field", "x"), ("lit", "")]
    assert text.parse_template("{y}", {"x"}) is None
    assert text.parse_template("a { b", {"x"}) is None


def test_fill_does_not_reexpand_values(spark):
    df = spark.createDataFrame([("T {abstract}", "A")], "title string, abstract string")
    out = df.select(text.fill_template("{title}|{abstract}|{target_language}", "D {title}",
                                       {"title": F.col("title"), "abstract": F.col("abstract"),
                                        "target_language": "English"}).alias("p")).first()["p"]
    assert out == "T {abstract}|A|English"
    fallback = df.select(text.fill_template("{title} only", "D {title} {abstract} {target_language}",
                                            {"title": F.col("title"), "abstract": F.col("abstract"),
                                             "target_language": "English"}).alias("p")).first()["p"]
    assert fallback == "D T {abstract} A English"


@pytest.mark.parametrize("reply,want", [("0.7", 0.7), (" 1.4 ", 1.0), ("-2", 0.0), ("nan", 1.0), ("inf", 1.0),
                                        ("-inf", 0.0), ("abc", 0.0), ("", 0.0), (None, 0.0)])
def test_clamp_score(spark, reply, want):
    df = spark.createDataFrame([(reply,)], "r string")
    assert df.select(scores.clamp_score("r").alias("s")).first()["s"] == pytest.approx(want)


def test_flat_json_sink_is_dated_and_ordered(spark):
    out = scratch_path(spark, f"test-sink/{uuid.uuid4().hex}")
    ranked = spark.createDataFrame([(2, 11, -0.5), (1, 10, -0.25)], "rank int, paper_id bigint, score double")
    sinks.write_ranked_json(ranked.coalesce(1), out, "2024-03-05")
    folder = out.replace("file:", "") + "/run_date=20240305"
    lines = [json.loads(x) for f in sorted(os.listdir(folder)) if f.endswith(".json") for x in open(f"{folder}/{f}")]
    assert [r["rank"] for r in lines] == [1, 2]
    sinks.write_ranked_json(ranked.limit(1).coalesce(1), out, "2024-03-06")      # other date kept
    assert os.path.isdir(folder)


def test_parts_of_a_sink_follow_the_order(spark):
    out = scratch_path(spark, f"test-sink/{uuid.uuid4().hex}")
    n = 500
    ranked = spark.range(n).select(((F.col("id") * 181) % n + 1).cast("int").alias("rank"), F.col("id").alias("paper_id")).repartition(7)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", False)          # several parts even of few rows
    try:
        sinks.write_ranked_json(ranked, f"{out}/json", "2024-03-05")
        lines = ranked.select((F.col("rank") % 3).alias("cluster_id"), F.col("rank").alias("line_no"),
                              F.concat(F.lit("line "), "rank").alias("line"))
        sinks.write_report(lines, f"{out}/text", "2024-03-05")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)

    def joined(kind):
        folder = f"{out}/{kind}".replace("file:", "") + "/run_date=20240305"
        parts = sorted(f for f in os.listdir(folder) if f.startswith("part-"))
        return len(parts), [x.rstrip("\n") for f in parts for x in open(f"{folder}/{f}")]

    parts, got = joined("json")
    assert parts > 1 and [json.loads(x)["rank"] for x in got] == list(range(1, n + 1))
    parts, got = joined("text")
    assert parts > 1 and got == [f"line {r}" for r in sorted(range(1, n + 1), key=lambda r: (r % 3, r))]
    again = sinks.read_in_order(spark, f"{out}/text/run_date=20240305", "text").orderBy("_part", "_block", "_row")
    assert [r["value"] for r in again.collect()] == got


def test_report_lines_format(spark):
    labels = spark.createDataFrame([(0, "Cluster 0"), (1, "Vision")], "cluster_id int, label string")
    ranked = spark.createDataFrame([(0, 1, 2305.0, "T", ["A", "B"], "cs.CL", -0.12345)],
                                   "cluster_id int, rank int, paper_id double, title string, "
                                   "authors array<string>, category string, score double")
    ranked = ranked.withColumn("paper_id", F.lit("2305.15334"))
    rows = {(r["cluster_id"], r["line_no"]): r["line"] for r in sinks.report_lines(labels, ranked).collect()}
    assert rows[(0, 0)] == "<h2>Cluster 0</h2><ol>"
    assert rows[(0, 1)] == ('<li><a href="https://arxiv.org/abs/2305.15334" target="_blank">T</a><br>'
                            "<small><i>A, B</i> [cs.CL]</small> – score -0.123</li>")
    assert rows[(0, 2)] == "</ol>" and rows[(1, 1)] == "</ol>"
