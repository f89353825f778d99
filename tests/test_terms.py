"""Terms of texts are counted in their rows."""

from feedrank.operators import lexical


def test_term_counts_in_the_row_need_no_shuffle_and_equal_the_grouped_ones(spark):
    rows = [(1, "b a b, c A b"), (2, ""), (3, None), (4, "x"), (5, "zz Zz y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    own = lexical.term_counts(df, ["doc_id"], by_key=True)
    assert "Exchange" not in own._jdf.queryExecution().executedPlan().toString()
    assert sorted(own.collect()) == sorted(lexical.term_counts(df, ["doc_id"]).collect())
    idf, n = lexical.idf_table(df.unionByName(df.filter("doc_id = 1")), "doc_id")        # a repeated key counts once
    assert n == 5 and {r["term"]: round(r["idf"], 9) for r in idf.collect()} == {
        r["term"]: round(r["idf"], 9) for r in lexical.idf_table(df, "doc_id")[0].collect()}


def _explained(spark, docs):
    return lexical.extractive_summary(docs, docs)


def test_lines_look_up_frequent_terms_without_moving_tokens_or_sorting_texts(spark, monkeypatch):
    rows = [(i, f"the of w{i % 3}\nthe rare{chr(97 + i)} of\nof of the\nw1 the") for i in range(8)] + [(8, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    whole = sorted(_explained(spark, docs).collect())
    monkeypatch.setattr(lexical, "LOOKUP_BROADCAST_ROWS", 5)      # the vocabulary is larger, its frequent part is not
    idf, _ = lexical.idf_table(docs, "doc_id")
    common, rare = lexical.by_frequency(idf, 5)
    assert {"the", "of"} <= {r["term"] for r in common.collect()} and 0 < common.count() <= 5
    assert common.count() + rare.count() == idf.count()
    got = _explained(spark, docs)
    assert sorted(got.collect()) == whole and len(whole) == 8
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "ShuffledHashJoin" in plan


def test_attached_explanations_read_the_recommended_texts_only(spark):
    from __spark_entry__ import queries
    from conftest import SF_SMALL
    got = queries()["explain_attach"](spark, SF_SMALL)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan
    assert got.count() > 0
