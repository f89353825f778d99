"""Join helpers give the plain join's rows on every path."""

from pyspark.sql import functions as F

from feedrank.operators import joins


def _tables(spark):
    big = spark.range(0, 3000).select((F.col("id") % 7).alias("term"), F.col("id").alias("doc"))
    small = spark.range(0, 5).select(F.col("id").alias("term"), (F.col("id") * 1.5).alias("idf"))
    return big, small


def _rows(df):
    return sorted(tuple(r) for r in df.select("term", "doc", "idf").collect())


def test_lookup_paths_agree(spark):
    big, small = _tables(spark)
    plain = _rows(big.join(small, "term", "left"))
    assert _rows(joins.lookup_join(big, small, "term", "left")) == plain                      # broadcast
    assert _rows(joins.lookup_join(big, small, "term", "left", max_broadcast_rows=2)) == plain  # shuffle
    assert _rows(joins.salted_join(big, small, "term", "left", salts=4)) == plain




def test_is_bounded_counts(spark):
    df = spark.range(10)
    assert joins.is_bounded(df, 10) and not joins.is_bounded(df, 9)
