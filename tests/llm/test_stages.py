"""Pipeline stages and filters on odd tables: ordinary column names, nulls, repeated rows, empty tables."""

import pytest

import corpus_pipeline
from conftest import SF_SMALL
from feedrank.llm import common, jaccard_join, quality_model, quality_rules
from feedrank.operators.lineage import cut

GOOD = "A plain sentence about the weather of the coast. Another one tells of ships and their long way home. "


def _docs(spark):
    rows = [(1, GOOD, "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, "#### $$ %%", "en", "a"),
            (5, GOOD, "en", "a"), (5, GOOD, "en", "a"), (None, GOOD.upper(), None, "b"), (7, "word " * 5000, "fr", "b")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr(
        "*", "length(text) as n_chars", "1 as `my col`", "2 as `a-b`", "named_struct('x', 3) as `a.b`", "'k' as n_words", "4 as score", "5 as doc",
        "6 as _c0", "'z' as row")


def _labels(spark):
    return spark.createDataFrame([(1, 1), (4, 0), (5, 1), (5, None), (None, 1)], "doc_id long, quality int")


def test_filters_keep_columns_of_any_name(spark):
    docs = _docs(spark)
    for kept in (quality_rules.keep_documents(docs), quality_model.keep_documents(docs, _labels(spark)),
                 jaccard_join.keep_representatives(docs)):
        assert kept.columns == docs.columns and [f.dataType for f in kept.schema] == [f.dataType for f in docs.schema]
        assert {(r["my col"], r["a-b"], r["a.b"]["x"], r["_c0"]) for r in kept.collect()} == {(1, 2, 3, 6)}
    ids = sorted(str(r["doc_id"]) for r in quality_rules.keep_documents(docs).collect())
    assert ids == ["1", "5", "5", "None"]
    assert sorted(str(r["doc_id"]) for r in jaccard_join.keep_representatives(docs).collect()) == ["1", "2", "3", "4", "7"]       # the null key's text is a copy


def test_representatives_do_not_depend_on_the_order_of_rows(spark):
    rows = [(1, GOOD, x) for x in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra int")
    assert len({jaccard_join.keep_representatives(df.repartition(n)).first()["extra"] for n in (1, 3, 7)}) == 1


def test_labelled_rows_reach_the_driver_bounded(spark, monkeypatch):
    docs = spark.range(500).selectExpr("1L as doc_id", "concat('text number ', id) as text")
    seen = []
    monkeypatch.setattr(quality_model, "train", lambda rows: seen.append(len(rows)) or quality_model.QualityModel(*[None] * 2))
    quality_model.fit(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"), max_train=40)
    assert seen == [40]


def test_parts_bound_what_becomes_python_objects(spark):
    import pyarrow as pa
    b = pa.record_batch({"t": ["x" * 1000] * 5000})
    sizes = [p.num_rows for p in common.parts(b, most=100_000)]
    assert sum(sizes) == 5000 and max(sizes) <= 100
    assert [p.num_rows for p in common.parts(pa.record_batch({"t": ["x" * 1000] * 2}), most=10)] == [1, 1]
    assert list(common.parts(pa.record_batch({"t": pa.array([], pa.string())}))) == []


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


def test_stages_on_odd_and_empty_tables(spark, small):
    odd = cut(small.limit(60).unionByName(small.limit(5)).unionByName(spark.createDataFrame(
        [(None, None, None, None, None), (9_000_001, "", "en", "s", 0), (9_000_002, " \n ", None, None, 3)], small.schema)), "odd")
    for table in (odd, small.limit(0)):
        docs = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = cut(stage(spark, docs, SF_SMALL), "stage")
            assert kept.columns == small.columns and kept.exceptAll(docs).count() == 0, name
            docs = kept
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL)
        assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_rules_and_classifier_stages_equal_their_scores(spark, small):
    """What the first two stages keep is what the row-by-row scores of the same input say."""
    scored = {r["doc_id"]: r["kept"] for r in quality_rules.score_documents(small).collect()}
    kept = cut(corpus_pipeline.rules(spark, small, SF_SMALL), "rules-kept")
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {k for k, v in scored.items() if v}
    model = quality_model.fit(kept, spark.read.parquet(f"{SF_SMALL}/labels.parquet"))
    want = {r["doc_id"] for r in kept.collect() if model.scores([r["text"] or ""])[0] >= 0.3}
    got = corpus_pipeline.classifier(spark, kept, SF_SMALL)
    assert {r["doc_id"] for r in got.select("doc_id").collect()} == want
    assert len(want) > 0
