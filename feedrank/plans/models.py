"""User models of a run, and the steps that call them through the caches (INF1-5).

A model is a function on a pandas frame; ``operators.infer`` batches, retries and
paces it.  Every step is keyed by content -- text, model and task -- so a second
run asks for nothing that is stored, and a failed row is asked again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.ids import config_hash
from ..operators import infer
from ..operators.cache import content_key
from ..operators.groups import PROFILE_SEP
from ..operators.store import ResultStore, cached_results

Model = Callable[[pd.DataFrame], pd.DataFrame]
QUERY, DOCUMENT = "retrieval_query", "retrieval_document"        # tasks of the embedding model


@dataclass
class Models:
    """Functions a run uses instead of the native scorers; None keeps the native one.

    ``embed``: ``text`` -> ``vector``; ``score``: ``profile, text`` -> ``score``;
    ``label``: ``samples`` -> ``label``; ``explain``: ``text`` -> ``explanation``.
    """

    embed: Model | None = None
    score: Model | None = None
    label: Model | None = None
    explain: Model | None = None
    names: dict[str, str] = field(default_factory=dict)          # model name by step, part of the cache key
    language: str = "English"
    retry: dict[str, dict] = field(default_factory=dict)         # arguments of batch_infer by step

    def name(self, step: str) -> str:
        return self.names.get(step, step)

    def run(self, step: str, fn: Model, inputs: list[str], schema: str, keys: list[str]) -> Callable[[DataFrame], DataFrame]:
        presets = {"embed": infer.EMBED_RETRY, "score": infer.RERANK_RETRY}
        args = presets.get(step, {}) | self.retry.get(step, {})
        return lambda rows: infer.batch_infer(rows, fn, keys, inputs, StructType.fromDDL(schema), **args)


def _keyed(rows: DataFrame, text, model: str, task: str) -> DataFrame:
    return (rows.withColumn("_model", F.lit(model)).withColumn("_task", F.lit(task)).withColumn("_text", text)
            .withColumn("key", content_key("_text", "_model", "_task")).drop("_model", "_task", "_text"))


def embedded(texts: DataFrame, cache_dir: str, models: Models, task: str) -> DataFrame:
    """``texts (..., text)`` with ``vector``; a text is embedded once a model and task, whatever its row."""
    store = ResultStore(texts.sparkSession, f"{cache_dir}/vectors", "key string, vector array<float>", ["key"])
    asked = _keyed(texts, F.col("text"), models.name("embed"), task)
    return cached_results(asked, store, models.run("embed", models.embed, ["text"], "vector array<float>", ["key"])).drop("key")


def labelled(samples: DataFrame, cache_dir: str, models: Models) -> DataFrame:
    """``(cluster_id, label)`` from sample rows ``(cluster_id, sample_rank, text)``; a failed label stays null.

    The key is the samples' content: a good label is used again as long as its
    cluster shows the same samples, whatever the cluster's number.
    """
    row = F.array_sort(F.collect_list(F.struct("sample_rank", "text")))               # at most 8 samples
    each = samples.groupBy("cluster_id").agg(F.array_join(F.transform(row, lambda x: x["text"]), PROFILE_SEP).alias("samples"))
    store = ResultStore(samples.sparkSession, f"{cache_dir}/labels", "key string, label string", ["key"])
    asked = _keyed(each, F.col("samples"), models.name("label"), "label")
    got = cached_results(asked, store, models.run("label", models.label, ["samples"], "label string", ["key"]),
                         valid=F.col("label").isNotNull() & (F.trim("label") != ""))
    return got.select("cluster_id", F.when(F.trim("label") != "", F.col("label")).alias("label"))


def scored(pairs: DataFrame, profiles: DataFrame, texts: DataFrame, models: Models, group: str, cand: str) -> DataFrame:
    """``(group, cand, score)``: the model's relevance of every pair; a failed one scores 0."""
    each = profiles.groupBy(group).agg(F.array_join(F.array_sort(F.collect_list("text")), PROFILE_SEP).alias("profile"))
    rows = pairs.select(group, cand).join(each, group).join(texts.select(cand, "text"), cand)
    got = models.run("score", models.score, ["profile", "text"], "score double", [group, cand])(rows)
    return got.select(group, cand, F.coalesce(F.when(F.isnan("score"), None).otherwise(F.col("score")), F.lit(0.0)).alias("score"))


def explained(papers: DataFrame, cache_dir: str, models: Models) -> DataFrame:
    """``(paper_id, explanation)`` of ``papers (paper_id, text)``, once a paper and configuration."""
    store = ResultStore(papers.sparkSession, f"{cache_dir}/explanations",
                        f"paper_id {papers.schema['paper_id'].dataType.simpleString()}, config_hash string, explanation string",
                        ["paper_id", "config_hash"])
    asked = papers.withColumn("config_hash", config_hash(F.lit(models.name("explain")), F.lit(models.language)))
    got = cached_results(asked, store, models.run("explain", models.explain, ["text"], "explanation string", ["paper_id", "config_hash"]),
                         valid=F.col("explanation").isNotNull() & (F.col("explanation") != ""))
    return got.select("paper_id", "explanation")
