"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ..session import scratch_path
from .units import forget_encoders

# ASCII white space: the only separators of a word in this package
# (words are runs of [^\x20\x09-\x0D]; ``bytes.split()`` splits on exactly these).
PART_BYTES = 4 << 20         # bytes of a batch turned into Python objects at a time
SPACES = " \t\n\x0b\x0c\r"


def fold(col: str | Column, folds: int = 5) -> Column:
    """crc32 of the value as text, modulo ``folds`` (null stays null)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(c.cast("string").cast("binary")) % F.lit(folds)


def col(name: str) -> Column:
    """A column by its exact name (dots, spaces and back quotes are part of it)."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_or_empty(name: str) -> Column:
    return F.coalesce(col(name).cast("string"), F.lit(""))


def words(text: str) -> list[bytes]:
    """UTF-8 words of a text (runs without ASCII white space)."""
    return text.encode("utf-8").split()


def lower_words(text: str) -> list[bytes]:
    """The same with A-Z (only) lower-cased; ``bytes.lower`` leaves other bytes alone."""
    return text.encode("utf-8").lower().split()


def parts(batch: pa.RecordBatch, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``most`` bytes, so what becomes Python objects at a time does not grow with a batch's rows."""
    step = max(1, batch.num_rows * most // max(batch.nbytes, 1))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def map_batches(df: DataFrame, fn: Callable[[dict], dict], schema: str) -> DataFrame:
    """Apply ``fn`` (columns as Python lists in, columns as lists or arrays out) to slices of Arrow batches."""
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        for b in batches:
            for part in parts(b):
                yield to_batch(fn(part.to_pydict()), arrow)

    return df.mapInArrow(run, schema)


def with_computed(df: DataFrame, text_col: str, fn: Callable[[list[str]], dict], added: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``(rows, restore)``: ``df`` with columns computed from its texts (null texts are empty).

    Only the texts become Python objects; the other columns pass through as they
    came.  The input's columns are named by place in ``rows``, so no name can
    clash or needs quoting; ``restore`` selects them under their own names again.
    """
    names = df.columns
    places = [f"_c{i}" for i in range(len(names))]
    k = names.index(text_col)
    src = df.toDF(*places)
    if not isinstance(src.schema[k].dataType, StringType):
        src = src.withColumn("_text", text_or_empty(places[k]))
        k = len(places)
    more = StructType.fromDDL(added)
    out = StructType([*src.schema.fields, *more.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        types = to_arrow_schema(more)
        forget_encoders()
        for b in batches:
            for part in parts(b):
                got = fn([t or "" for t in part.column(k).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(got[f.name], type=f.type) for f in types]],
                                                 names=[*part.schema.names, *types.names])

    return src.mapInArrow(run, out), lambda rows: rows.select(*places).toDF(*names)


def to_batch(cols: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in schema], schema=schema)


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(StructType.fromDDL(schema))


def text_bytes(df: DataFrame, text_col: str) -> int:
    """Total UTF-8 bytes of a text column (0 for an empty table)."""
    return int(df.agg(F.sum(F.octet_length(col(text_col)).cast("long"))).first()[0] or 0)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder URI under the shared checkpoint location."""
    path = scratch_path(spark, f"{name}/{uuid.uuid4().hex}")
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    return path


class SharedFiles:
    """Files in the shared store, opened from inside tasks (file, hdfs, s3, gs URIs).

    A task attempt writes under a name of its own and reports that name in its
    rows, so a retried or speculative attempt can never be mixed with the one
    whose rows Spark kept.
    """

    def __init__(self, folder: str):
        from pyarrow import fs
        self.fs, self.root = fs.FileSystem.from_uri(folder)

    def create(self, stem: str, suffix: str):
        self.fs.create_dir(self.root, recursive=True)
        name = f"{stem}-{uuid.uuid4().hex}{suffix}"
        return name, self.fs.open_output_stream(f"{self.root}/{name}", compression=None)

    def open(self, name: str):
        return self.fs.open_input_file(f"{self.root}/{name}")
