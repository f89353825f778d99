"""Recommendation plans (PIPE1 flat, PIPE2 clustered) as DataFrame compositions.

Inputs are keyed tables, never positional lists:

* ``library``: ``(entry_id, vector[, cluster_id, src_pos])``
* ``library_texts`` / ``corpus_texts``: ``(id, text)``
* ``corpus``: ``(paper_id, vector)``
* ``collection``: ``(doc_id, text)`` for term statistics of the native scorer
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import groups, knn, lexical, vectors
from ..operators.lineage import cut
from ..operators.store import cached_clusters
from .models import DOCUMENT, QUERY, Models, embedded, explained, labelled, scored


def flat_candidates(library: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """``(paper_id, distance, crank)``: the k corpus papers nearest the profile mean."""
    prof = vectors.profile_mean(library)
    nn = knn.knn_join(prof, corpus, k, left_id="profile_id", right_id="paper_id")
    return nn.select(F.col("neighbor_id").alias("paper_id"), "distance", F.col("rank").alias("crank"))


def rerank(cands: DataFrame, scores: DataFrame, group: list[str], k: int) -> DataFrame:
    """Order by score (desc), ties keep candidate order; cut to k (WIN3)."""
    s = cands.join(scores, group + ["paper_id"])
    return knn.top_per_group(s, group, [F.round("score", 9).desc(), F.col("crank")], k)


def recommend_flat(library: DataFrame, library_texts: DataFrame, corpus: DataFrame,
                   corpus_texts: DataFrame, collection: DataFrame, topk: int = 200,
                   oversample: int = 4, use_rerank: bool = True, scorer=None) -> DataFrame:
    """``(rank, paper_id, score, distance)`` for the single pseudo-cluster 0.

    ``scorer(pairs, profiles, texts, group, cand)`` replaces the native scorer;
    its profile is the first 8 library texts in the order of their ids.
    """
    if not use_rerank:
        c = flat_candidates(library, corpus, topk)
        return c.select(F.col("crank").alias("rank"), "paper_id", (-F.col("distance")).alias("score"), "distance")
    c = flat_candidates(library, corpus, topk * oversample).join(
        corpus_texts.select("paper_id"), "paper_id")                       # only candidates with a text
    # k * oversample rows, read twice below: write once (Python-UDF plans are not exchange-reused)
    c = cut(c.withColumn("group_id", F.lit(0)), "flat-candidates")
    prof = library.select(F.col("entry_id").alias("paper_id")).join(library_texts, "paper_id").select(
        F.lit(0).alias("group_id"), "text")
    cand_t = corpus_texts.select(F.col("paper_id").alias("cand_id"), "text")
    pairs = c.select("group_id", F.col("paper_id").alias("cand_id"))
    if scorer is not None:
        few = library.join(library_texts.withColumnRenamed("paper_id", "entry_id"), "entry_id").orderBy("entry_id").limit(8)
        sc = scorer(pairs, few.select(F.lit(0).alias("group_id"), "text"), cand_t, "group_id", "cand_id")
    else:
        sc = lexical.rerank_lexical(pairs, prof, cand_t, collection, "group_id", "cand_id")
    sc = sc.withColumnRenamed("cand_id", "paper_id")
    r = rerank(c, sc, ["group_id"], topk)
    return r.select("rank", "paper_id", "score", "distance")


def cluster_samples(library: DataFrame, library_texts: DataFrame, max_samples: int = 8) -> DataFrame:
    """Long sample rows per cluster (AGG4) from library entries that have a text."""
    e = library.join(library_texts.withColumnRenamed("paper_id", "entry_id"), "entry_id")
    return groups.samples(e, max_samples=max_samples)


def cluster_candidates(corpus: DataFrame, cents: DataFrame, k: int) -> DataFrame:
    """``(cluster_id, paper_id, distance, crank)``: per cluster the k nearest assigned papers."""
    a = knn.assign_nearest(corpus, cents)
    return knn.top_per_group(a, ["cluster_id"], [F.round("distance", 9), F.col("paper_id")], k,
                             rank_col="crank")


def recommend_clustered(library: DataFrame, library_texts: DataFrame, corpus: DataFrame,
                        corpus_texts: DataFrame, collection: DataFrame, topk: int = 200,
                        oversample: int = 4, use_rerank: bool = True,
                        cents: DataFrame | None = None, scorer=None) -> DataFrame:
    """``(cluster_id, rank, paper_id, score, distance)`` given cluster ids on ``library``."""
    cents = cents if cents is not None else vectors.centroids(library)
    if not use_rerank:
        c = cluster_candidates(corpus, cents, topk)
        return c.select("cluster_id", F.col("crank").alias("rank"), "paper_id",
                        (-F.col("distance")).alias("score"), "distance")
    c = cluster_candidates(corpus, cents, topk * oversample).join(corpus_texts.select("paper_id"), "paper_id")
    c = cut(c, "cluster-candidates")      # bounded by clusters * k * oversample, read twice below
    prof = cluster_samples(library, library_texts).select("cluster_id", "text")
    cand_t = corpus_texts.select(F.col("paper_id").alias("cand_id"), "text")
    pairs = c.select("cluster_id", F.col("paper_id").alias("cand_id"))
    sc = (scorer(pairs, prof, cand_t, "cluster_id", "cand_id") if scorer is not None else
          lexical.rerank_lexical(pairs, prof, cand_t, collection, "cluster_id", "cand_id"))
    sc = sc.withColumnRenamed("cand_id", "paper_id")
    r = rerank(c, sc, ["cluster_id"], topk)
    return r.select("cluster_id", "rank", "paper_id", "score", "distance")


def cluster_library(library: DataFrame, n_components: int = 50, n_neighbors: int = 50,
                    min_cluster_size: int = 40, random_state: int = 0, method: str = "graph",
                    id_col: str = "entry_id", vec: str = "vector", n_epochs: int = 50):
    """Reduce, density-cluster and average in the original space (CL3).

    Returns ``(labels (entry_id, cluster_id), centroids (cluster_id, centroid, n))``.
    Empty input is an error, as in the reference.
    """
    from ..operators import density, reduce as rd
    if library.limit(1).count() == 0:
        raise ValueError("No vectors provided for clustering.")
    if method == "graph":
        red = cut(rd.reduce_graph(library, n_components, n_neighbors, random_state, n_epochs=n_epochs,
                                  id_col=id_col, vec=vec), "cluster-reduced")
    elif method == "pca":
        dim = library.select(F.max(F.size(vec))).first()[0]
        red = rd.reduce_pca(library, min(n_components, dim), id_col, vec)
    else:
        red = library.select(id_col, F.col(vec).alias("reduced"))
    labels = density.density_cluster(red, min_cluster_size, id_col=id_col, vec="reduced")
    cents = vectors.centroids(library.join(labels, id_col))
    return labels, cents


def _one_version(day: DataFrame) -> DataFrame:
    """``(paper_id, published, title, abstract, authors, category)``: each paper once, the newest version."""
    category = F.col("category") if "category" in day.columns else F.get("categories", F.lit(0))
    row = F.struct("published", "title", "abstract", "authors", category.alias("category"))
    return day.groupBy("paper_id").agg(F.max(row).alias("r")).select("paper_id", "r.*")


def run_daily(spark, bib_paths, feed: DataFrame, run_date: str | None, out_dir: str, topk: int = 200,
              oversample: int = 4, cluster: bool = False, categories=None, use_rerank: bool = False,
              embed_dim: int = 256, min_cluster_size: int = 40, debug_limit: int | None = None,
              models: Models | None = None, cache_dir: str | None = None, cluster_method: str = "graph",
              max_papers: int = 2000):
    """The whole daily run (PIPE3): bibliography + feed -> :func:`run_library`.

    ``feed``: ``(paper_id, title, abstract, authors, published, category |
    categories)``; of the day's papers the ``max_papers`` newest take part.  A
    paper listed several times counts once, in its newest version; library
    entries with the same citation key stay separate.
    """
    from ..functions.text import paper_text
    from ..sources.bibtex import PLACE, load_library
    from ..sources.feed import feed_for_day, newest_first

    lib = load_library(spark, bib_paths, debug_limit=debug_limit)
    # an entry is its place in the files: two entries may carry the same citation key
    place = F.struct(*PLACE)
    lib_t = lib.select(F.to_json(place).alias("entry_id"), place.alias("src_pos"),
                       paper_text("title", "abstract", "authors").alias("text")).filter(F.col("text") != "")
    lib_t = cut(lib_t, "run-library")          # one scan of the files numbers the entries
    day = newest_first(_one_version(feed_for_day(feed, run_date, categories)), max_papers).drop("rank")
    papers = day.withColumn("text", paper_text("title", "abstract", "authors")).filter(F.col("text") != "")
    return run_library(lib_t, cut(papers, "run-papers"), out_dir, run_date, topk, oversample, cluster, use_rerank, embed_dim,
                       min_cluster_size, models, cache_dir, cluster_method)


def run_library(lib_t: DataFrame, papers: DataFrame, out_dir: str, run_date: str | None, topk: int = 200, oversample: int = 4,
                cluster: bool = False, use_rerank: bool = False, embed_dim: int = 256, min_cluster_size: int = 40,
                models: Models | None = None, cache_dir: str | None = None, cluster_method: str = "graph"):
    """Library and papers of the day -> vectors -> flat or clustered recommendation -> dated nested JSON and report rows.

    ``lib_t (entry_id, src_pos, text)``, ``papers (paper_id, text, title,
    authors, category)``.  Vectors, scores, labels and explanations come from
    ``models`` where given, through the caches in ``cache_dir``, and else from
    the native scorers; the native embedder is fitted on both sides' texts.
    With ``cache_dir`` the clustering of an unchanged library is read back.
    Returns ``(cluster_id, rank, paper_id, score)``; an empty library or feed
    gives an empty result.
    """
    from .. import sinks

    spark, models = lib_t.sparkSession, models or Models()
    if (models.embed or models.label or models.explain) and not cache_dir:
        raise ValueError("models need a cache_dir for their results")
    lib_d = lib_t.withColumn("doc_key", F.concat(F.lit("L:"), "entry_id"))
    feed_d = papers.select("paper_id", "text").withColumn("doc_key", F.concat(F.lit("F:"), F.col("paper_id").cast("string")))
    both = lib_d.select("doc_key", "text").unionByName(feed_d.select("doc_key", "text"))
    if models.embed is not None:
        fine = lambda t, task: embedded(t, cache_dir, models, task).filter("vector is not null")
        library = cut(fine(lib_t, QUERY).select("entry_id", "src_pos", "vector"), "run-vectors")
        corpus = cut(fine(papers.select("paper_id", "text"), DOCUMENT).select("paper_id", "vector"), "run-vectors")
    else:
        vecs = cut(lexical.hashed_embedding(both, "doc_key", "text", dim=embed_dim), "run-vectors")
        library = lib_d.select("entry_id", "src_pos", "doc_key").join(vecs, "doc_key").drop("doc_key")
        corpus = feed_d.select("paper_id", "doc_key").join(vecs, "doc_key").select("paper_id", "vector")
    lib_texts = lib_t.select(F.col("entry_id").alias("paper_id"), "text")
    corpus_texts = papers.select("paper_id", "text")
    collection = both.withColumnRenamed("doc_key", "doc_id")
    scorer = None
    if models.score is not None:
        scorer = lambda pairs, profiles, texts, group, cand: scored(pairs, profiles, texts, models, group, cand)
    if cluster:
        def compute(rows):
            return cluster_library(rows, min_cluster_size=min_cluster_size, method=cluster_method)

        given = library.select("entry_id", "vector")
        if cache_dir:
            labels, cents, _ = cached_clusters(given, f"{cache_dir}/clusters", compute, f"{cluster_method}-{min_cluster_size}")
        else:
            labels, cents = compute(given)
        lib_c = library.join(labels, "entry_id")
        ranked = recommend_clustered(lib_c, lib_texts, corpus, corpus_texts, collection, topk, oversample,
                                     use_rerank, cents=cents, scorer=scorer)
        clusters = cents.select("cluster_id")
        shown = cluster_samples(lib_c, lib_texts)
        named = labelled(shown, cache_dir, models) if models.label is not None else lexical.top_terms(shown, "cluster_id")
    else:
        ranked = recommend_flat(library, lib_texts, corpus, corpus_texts, collection, topk, oversample,
                                use_rerank, scorer=scorer).withColumn("cluster_id", F.lit(0))
        clusters = ranked.select("cluster_id").distinct()
        named = spark.createDataFrame([], "cluster_id int, label string")
    ranked = cut(ranked.select("cluster_id", "rank", "paper_id", "score"), "run-ranked")
    hydrated = ranked.join(papers.select("paper_id", "title", "authors", "category"), "paper_id")
    items = ["paper_id", "title", "score"]
    if models.explain is not None:                # once a recommended paper
        wanted = corpus_texts.join(ranked.select("paper_id").distinct(), "paper_id", "left_semi")
        hydrated = hydrated.join(explained(wanted, cache_dir, models), "paper_id", "left")
        items.append("explanation")
    nested = groups.nest_results(clusters, hydrated, items)
    labels_tbl = groups.attach_labels(clusters, named)
    sinks.write_nested_json(nested.join(labels_tbl, "cluster_id"), f"{out_dir}/json", run_date)
    sinks.write_report(sinks.report_lines(labels_tbl, hydrated), f"{out_dir}/report", run_date)
    return ranked
