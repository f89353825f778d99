"""Model-free text scorers built from term joins (native defaults of INF1-INF4).

All of them start from term frequencies ``(key..., term, tf)``.  Where a key has
one text, its terms are counted within its row, so neither texts nor tokens are
shuffled and a task holds one text's terms; where keys repeat, tokens are
exploded and counted with a partial aggregation.  Term weights are ``tf * idf`` with the smoothed
``idf(t) = ln((1 + N) / (1 + df(t))) + 1`` over a reference collection.

Joins against per-term tables (idf, a profile) are many-to-one on ``term``;
a frequent term is a hot key, so they go through ``lookup_join``: broadcast
when the term table is proven small, salted otherwise.  Scoring lines looks up
every token, so there the frequent terms are broadcast whatever the vocabulary.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import tokens
from .joins import LOOKUP_BROADCAST_ROWS, is_bounded, lookup_join
from .lineage import cut


def term_counts(df: DataFrame, keys: list[str], text: str = "text", by_key: bool = False) -> DataFrame:
    """``(keys..., term, tf)`` for every token of every text.

    ``by_key`` says that every key has one row: equal tokens of the sorted text
    are counted in place.  Never used for group keys, whose texts are summed.
    """
    if not by_key:
        # outer: an inner explode would be given a filter that tokenises once more
        ex = df.select(*keys, F.explode_outer(tokens(text)).alias("term")).filter("term is not null")
        return ex.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))
    row = df.select(*keys, F.sort_array(tokens(text)).alias("_s"))
    run = F.filter(F.sequence(F.lit(1), F.size("_s")),
                   lambda i: F.coalesce(F.get("_s", i - 2) != F.get("_s", i - 1), F.lit(True)))
    row = row.select(*keys, "_s", F.when(F.size("_s") > 0, run).otherwise(F.array().cast("array<int>")).alias("_at"))
    each = F.transform("_at", lambda p, k: F.struct(F.get("_s", p - 1).alias("term"), (
        F.coalesce(F.get("_at", k + 1), F.size("_s") + 1) - p).cast("bigint").alias("tf")))
    return row.select(*keys, F.explode_outer(each).alias("_t")).select(*keys, "_t.term", "_t.tf").filter("term is not null")


def _spread(df: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by key where its ``source`` has fewer splits than cores (and so no more than a few of them to move)."""
    few = source.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(key) if few else df


def idf_table(df: DataFrame, key: str, text: str = "text") -> tuple[DataFrame, int]:
    """Per-term idf over the texts of ``df`` and the collection size N.

    The table is written once (a lineage cut with real size statistics), so
    the size checks and joins that follow read it instead of re-tokenising
    the collection.
    """
    n_docs, most = df.groupBy(key).count().agg(F.count(F.lit(1)), F.max("count")).first()
    if (most or 0) <= 1:        # one text a key: its distinct terms, one row each
        terms = _spread(df, df, key).select(F.explode_outer(F.array_distinct(tokens(text))).alias("term")).filter("term is not null")
    else:
        terms = term_counts(df, [key], text)
    idf = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select(
        "term", (F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf"))
    return cut(idf, "idf"), n_docs


def unseen_idf(n_docs: int) -> float:
    """idf of a term absent from the reference collection (df = 0)."""
    return math.log(1.0 + n_docs) + 1.0


def by_frequency(idf: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """``idf`` as its most frequent terms, at most ``most``, and the rest (None if there is none)."""
    if is_bounded(idf, most):
        return idf, None
    level = F.floor(F.col("idf") * 4)           # a few dozen levels; the idf falls as the frequency rises
    held, top = 0, -1
    for r in idf.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).orderBy("level").collect():
        held += r["n"]
        if held > most:
            break
        top = r["level"]
    return idf.filter(level <= top), idf.filter(level > top)


def weights(tf: DataFrame, idf: DataFrame, n_docs: int) -> DataFrame:
    """Attach ``w = tf * idf``; terms unknown to the collection use df = 0."""
    j = lookup_join(tf, idf, "term", "left")
    return j.withColumn("w", F.col("tf") * F.coalesce(F.col("idf"), F.lit(unseen_idf(n_docs)))).drop("idf")


def cosine_scores(pairs: DataFrame, profile_w: DataFrame, cand_w: DataFrame,
                  group: str = "group_id", cand: str = "cand_id") -> DataFrame:
    """Cosine similarity of each ``(group, cand)`` pair's weighted term vectors.

    ``profile_w``: ``(group, term, w)``; ``cand_w``: ``(cand, term, w)``.
    One aggregation over the candidate terms gives both the dot product and
    the candidate norm.  Pairs without shared terms score 0.0.
    """
    return _cosine(pairs, profile_w, cand_w.join(pairs.select(group, cand), cand), group, cand)


def _cosine(pairs: DataFrame, profile_w: DataFrame, paired_w: DataFrame, group: str, cand: str) -> DataFrame:
    """``cosine_scores`` from the terms ``(group, cand, term, w)`` of paired candidates."""
    p_norm = profile_w.groupBy(group).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("pn"))
    j = lookup_join(paired_w, profile_w.withColumnRenamed("w", "pw"), [group, "term"], "left")
    agg = j.groupBy(group, cand).agg(F.sum(F.col("w") * F.coalesce(F.col("pw"), F.lit(0.0))).alias("dot"),
                                     F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("cn"))
    s = pairs.join(agg, [group, cand], "left").join(p_norm, group, "left")
    score = F.when((F.col("pn") > 0) & (F.col("cn") > 0),
                   F.coalesce(F.col("dot"), F.lit(0.0)) / (F.col("pn") * F.col("cn"))).otherwise(F.lit(0.0))
    return s.select(*pairs.columns, score.alias("score"))


def rerank_lexical(pairs: DataFrame, profiles: DataFrame, candidates: DataFrame, collection: DataFrame,
                   group: str = "group_id", cand: str = "cand_id", text: str = "text",
                   collection_key: str = "doc_id") -> DataFrame:
    """Native relevance score of candidate texts to profile texts (INF2).

    ``profiles``: ``(group, text)`` rows (several rows per group are summed,
    so a profile made of many texts is never concatenated); ``candidates``:
    ``(cand, text)``; ``collection`` supplies the idf.
    """
    idf, n = idf_table(collection, collection_key, text)
    pw = cut(weights(term_counts(profiles, [group], text), idf, n).select(group, "term", "w"), "profile-weights")
    # candidates meet their groups as texts, one row a pair, before they are taken apart
    wanted = pairs.select(group, cand).distinct()
    if is_bounded(wanted, LOOKUP_BROADCAST_ROWS):
        wanted = F.broadcast(wanted)
    paired = candidates.select(cand, text).join(wanted, cand)
    most = candidates.groupBy(cand).count().agg(F.max("count")).first()[0] or 0
    cw = weights(term_counts(paired, [group, cand], text, by_key=most <= 1), idf, n)
    return _cosine(pairs, pw, cw.select(group, cand, "term", "w"), group, cand)


def top_terms(docs: DataFrame, group: str, n_terms: int = 3, text: str = "text") -> DataFrame:
    """Class-based TF-IDF label per group: its ``n_terms`` heaviest terms (INF3).

    ``tf`` is counted over the group's texts, ``idf`` over groups.
    """
    tf = term_counts(docs, [group], text)
    n_groups = docs.select(group).distinct().count()
    gdf = tf.groupBy("term").agg(F.count(F.lit(1)).alias("gdf"))
    w = lookup_join(tf, gdf, "term").withColumn(
        "w", F.col("tf") * (F.log((F.lit(1.0) + n_groups) / (F.lit(1.0) + F.col("gdf"))) + 1.0))
    win = Window.partitionBy(group).orderBy(F.round("w", 9).desc(), F.col("term"))
    top = w.withColumn("r", F.row_number().over(win)).filter(F.col("r") <= n_terms)
    agg = top.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("r", "term"))).alias("s"))
    return agg.select(group, F.array_join(F.transform("s", lambda x: x["term"]), " ").alias("label"))


def extractive_summary(docs: DataFrame, collection: DataFrame, key: str = "doc_id", text: str = "text",
                       n_lines: int = 2, collection_key: str = "doc_id") -> DataFrame:
    """Native explanation: the ``n_lines`` lines with the highest mean token idf,
    kept in their original order and joined by a space (INF4).

    Returns ``(key, explanation, n_lines)`` for texts with at least one scored line.
    """
    idf, n = idf_table(collection, collection_key, text)
    split = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    lines = _spread(docs, collection, key).select(key, F.posexplode_outer(split).alias("pos", "line"))
    toks = lines.select(key, "pos", F.explode_outer(tokens("line")).alias("term")).filter("term is not null")
    common, rare = by_frequency(idf, LOOKUP_BROADCAST_ROWS)
    each = toks.join(F.broadcast(common), "term", "left")
    unseen = F.coalesce(F.col("idf"), F.lit(unseen_idf(n)))
    if rare is None:
        each = each.select(key, "pos", unseen.alias("idf"), F.lit(1).alias("n"))
    else:       # a token counts in its line where it stands; only the rare ones move, to fetch their idf
        few = toks.join(F.broadcast(common.select("term")), "term", "left_anti").join(rare, "term", "left")
        each = each.select(key, "pos", "idf", F.lit(1).alias("n")).unionByName(few.select(key, "pos", unseen.alias("idf"), F.lit(0).alias("n")))
    scored = each.groupBy(key, "pos").agg((F.sum("idf") / F.sum("n")).alias("score"))
    win = Window.partitionBy(key).orderBy(F.round("score", 9).desc(), F.col("pos"))
    best = scored.withColumn("r", F.row_number().over(win)).filter(F.col("r") <= n_lines)
    picks = best.groupBy(key).agg(F.collect_list("pos").alias("picks"))            # at most n_lines numbers
    # the texts meet their few places, which are hashed, so texts stream past unsorted; lines are not moved
    chosen = docs.select(key, text).join(picks.hint("shuffle_hash"), key).select(key, F.filter(F.transform("picks", lambda p: F.struct(
        p.alias("pos"), F.get(split, p).alias("line"))), lambda x: x["line"].isNotNull()).alias("s"))
    agg = chosen.groupBy(key).agg(F.array_sort(F.flatten(F.collect_list("s"))).alias("s"))
    return agg.select(key, F.array_join(F.transform("s", lambda x: x["line"]), " ").alias("explanation"),
                      F.size("s").alias("n_lines"))


def hashed_embedding(docs: DataFrame, key: str = "doc_id", text: str = "text", dim: int = 256) -> DataFrame:
    """Native text embedding (INF1 default): hashed term frequencies, idf-weighted
    and L2-normalised, as ``(key, vector ARRAY<FLOAT>)``.

    Built from ``HashingTF -> IDF -> Normalizer`` so it stays JVM-side.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    t = docs.select(key, tokens(text).alias("tokens"))
    if t.limit(1).count() == 0:       # nothing to fit on: an empty table of the same shape
        return t.select(key, F.array().cast("array<float>").alias("vector")).limit(0)
    pipe = Pipeline(stages=[HashingTF(inputCol="tokens", outputCol="tf", numFeatures=dim),
                            IDF(inputCol="tf", outputCol="tfidf"),
                            Normalizer(inputCol="tfidf", outputCol="nv", p=2.0)])
    out = pipe.fit(t).transform(t)
    return out.select(key, vector_to_array("nv", "float32").alias("vector"))
