"""Landed binary files (SRC5): PDFs keyed by paper id, text extraction pluggable.

The download itself is not part of this library; files already landed under a
folder named ``<file-safe id>.pdf`` are read with the ``binaryFile`` source
and joined to papers by id.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import file_safe_id


def read_landed(spark: SparkSession, folder: str, glob: str = "*.pdf") -> DataFrame:
    """``(file_id, path, length, content)`` for the landed files."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    name = F.regexp_extract(F.col("path"), r"([^/]+)\.[^./]+$", 1)
    return df.select(name.alias("file_id"), "path", "length", "content")


def attach_files(papers: DataFrame, files: DataFrame, id_col: str = "paper_id") -> DataFrame:
    """Left-join landed files to papers on the file-safe id."""
    return papers.withColumn("file_id", file_safe_id(id_col)).join(files, "file_id", "left").drop("file_id")


def _printable(b: bytes | None) -> str | None:
    if b is None:
        return None
    return b.decode("utf-8", errors="ignore")


def extract_text(df: DataFrame, extractor: Callable[[bytes], str | None] = _printable,
                 content: str = "content", out: str = "full_text") -> DataFrame:
    """Run a per-file extractor over ``content`` in Arrow batches; failures give NULL."""
    out_schema = df.drop(content).schema.add(out, "string")

    def run(batches):
        for pdf in batches:
            texts = []
            for b in pdf[content]:
                try:
                    texts.append(extractor(b) if b is not None else None)
                except Exception:  # noqa: BLE001
                    texts.append(None)
            res = pdf.drop(columns=[content])
            res[out] = pd.Series(texts, dtype="object")
            yield res

    return df.mapInPandas(run, out_schema)
