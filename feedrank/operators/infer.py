"""Batch inference with retry, pacing and rejects (INF0), and cached inference (INF1-4).

``batch_infer`` runs a user function over sub-batches of rows inside
``mapInArrow``: Spark partitions the work, Arrow moves the rows, and the
function (a model client, or a native scorer) sees pandas frames of at most
``batch_size`` rows.  Failures after the retry budget do not stop the job;
they yield NULL outputs and an ``infer_error`` message so the caller can route
them to a rejects table instead of silently shifting rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .cache import write_cache
from .lineage import cut


def exponential_backoff(base: float) -> Callable[[int], float]:
    """Wait ``base ** attempt`` seconds before retry ``attempt`` (1-based)."""
    return lambda attempt: base ** attempt


def doubling_backoff(first: float) -> Callable[[int], float]:
    """Wait ``first``, then ``2 * first``, ... seconds."""
    return lambda attempt: first * (2 ** (attempt - 1))


# Fixed retry budgets of the reference: embeddings 5 tries with 1.5**n s on
# quota errors only; re-ranking 3 tries waiting 10 s then 20 s on any error.
EMBED_RETRY = dict(retries=5, backoff=exponential_backoff(1.5), pacing=0.05)
RERANK_RETRY = dict(retries=3, backoff=doubling_backoff(10.0), pacing=0.0)


def batch_infer(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], keys: list[str],
                in_cols: list[str], out_schema: StructType, batch_size: int = 32, retries: int = 3,
                backoff: Callable[[int], float] | None = None,
                retryable: Callable[[BaseException], bool] | None = None,
                pacing: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Apply ``fn`` to sub-batches of ``df``; returns ``keys + outputs + infer_error``.

    ``fn`` receives a pandas frame with ``in_cols`` and must return a frame
    with the ``out_schema`` columns, one row per input row, in order.
    ``retryable`` decides whether an exception is retried (default: all);
    a non-retryable error or an exhausted budget marks the rows failed.
    """
    backoff = backoff or (lambda attempt: 0.0)
    retryable = retryable or (lambda exc: True)
    out_fields = list(out_schema.fields)
    key_fields = [df.schema[k] for k in keys]
    schema = StructType(key_fields + out_fields + [StructField("infer_error", StringType(), True)])
    out_names = [f.name for f in out_fields]

    def frame(part: pa.RecordBatch) -> pd.DataFrame:
        pdf = part.to_pandas()
        for name in pdf:
            if isinstance(pdf[name].dtype, pd.DatetimeTZDtype):
                pdf[name] = pdf[name].dt.tz_localize(None)
        return pdf

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        types = to_arrow_schema(StructType(out_fields))
        first = True
        for batch in batches:
            # only the rows the model is shown become Python objects, however large a batch is
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)
                shown = part.select(in_cols)
                if not first and pacing > 0:
                    sleep(pacing)
                first = False
                result, error = None, None
                for attempt in range(1, retries + 1):
                    try:
                        result = fn(frame(shown))
                        if len(result) != part.num_rows:
                            raise ValueError(f"model returned {len(result)} rows for {part.num_rows}")
                        break
                    except Exception as exc:  # noqa: BLE001
                        error = f"{type(exc).__name__}: {exc}"
                        result = None
                        if attempt == retries or not retryable(exc):
                            break
                        sleep(backoff(attempt))
                outs = [pa.array(result[f.name], type=f.type, from_pandas=True) if result is not None else pa.nulls(part.num_rows, f.type)
                        for f in types]
                errors = pa.array([None if result is not None else error] * part.num_rows, pa.string())
                yield pa.RecordBatch.from_arrays([*part.select(keys).columns, *outs, errors], names=schema.names)
        pa.default_memory_pool().release_unused()       # the worker is used again

    asked = df.select(*[F.col("`" + c.replace("`", "``") + "`") for c in dict.fromkeys([*keys, *in_cols])])
    return asked.mapInArrow(run, schema)


def cached_inference(requests: DataFrame, cache: DataFrame, keys: list[str],
                     infer: Callable[[DataFrame], DataFrame], cache_path: str | None = None,
                     valid=None, partition_by: list[str] | None = None) -> DataFrame:
    """Serve hits from ``cache`` and run ``infer`` on misses only.

    ``infer`` maps the miss rows, one a distinct key, to rows with ``keys``
    plus outputs (and may carry ``infer_error``).  Returns one row per request
    row: ``keys``, the outputs and, where ``infer`` gives it, ``infer_error``.
    A failed row stays in the result with its error and NULL outputs; only
    successful new rows are appended to ``cache_path``.  Of several cached
    rows of one key one is used.  A request with a NULL key matches nothing
    and has NULL outputs.
    """
    good = (cache.filter(valid) if valid is not None else cache).dropDuplicates(keys)
    asked = requests.dropDuplicates(keys).dropna(subset=keys)
    new = infer(asked.join(good.select(*keys), keys, "left_anti"))
    if cache_path:
        new = cut(new, "inferred")        # run the model once; reuse for the write and the result
        done = new
        if "infer_error" in new.columns:
            done = new.filter(F.col("infer_error").isNull()).drop("infer_error")
        write_cache(done, cache_path, partition_by)
    known = good.select(*[c for c in new.columns if c in good.columns])
    return requests.select(*keys).join(known.unionByName(new, allowMissingColumns=True), keys, "left")
