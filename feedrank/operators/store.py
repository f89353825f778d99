"""Result stores with a commit protocol, and the caches built on them (SNK5-7, SRC6-9, INF1-4).

A store is a folder of Parquet *attempts*, each under a name of its own, and one
manifest row an attempt, written after the attempt's data and in a folder of its
own.  Readers list the manifest first, so a write that was killed (no manifest
row) is never read, a retried one is another attempt, and two writers cannot
disturb each other.  Of several rows of one key a reader uses the least by its
row hash, so repeated work gives the same answer everywhere.  Compaction writes
what is live as one attempt whose manifest row replaces the others' rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .lineage import cut

MANIFEST = "attempt string, tag string, rows bigint, replaces array<string>"
MANY_ATTEMPTS = 64              # attempts after which a store compacts itself


class ResultStore:
    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def attempts(self, tag: str | None = None) -> list[str]:
        """Committed attempts that no other one replaces (one manifest row each)."""
        try:
            rows = self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest/*").filter("attempt is not null").collect()
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        gone = {a for r in rows for a in r["replaces"] or []}
        return sorted(r["attempt"] for r in rows if r["attempt"] not in gone and (tag is None or r["tag"] == tag))

    def read(self, tag: str | None = None) -> DataFrame:
        """One row a key; an empty table where nothing is committed."""
        live = self.attempts(tag)
        if not live:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{a}" for a in live])
        if len(live) == 1:
            return rows             # an attempt holds a key once
        whole = F.struct(*self.schema.names)
        return rows.groupBy(*self.keys).agg(F.min_by(whole, F.xxhash64(whole)).alias("r")).select("r.*")

    def write(self, df: DataFrame) -> str:
        """Write an attempt's data; nothing reads it before :meth:`commit`."""
        attempt = uuid.uuid4().hex
        df.select(*self.schema.names).dropDuplicates(self.keys).write.parquet(f"{self.path}/data/{attempt}")
        return attempt

    def commit(self, attempt: str, tag: str = "", replaces: list[str] | None = None) -> None:
        rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{attempt}").count()
        row = self.spark.createDataFrame([(attempt, tag, rows, replaces or [])], MANIFEST)
        row.coalesce(1).write.json(f"{self.path}/manifest/{attempt}")

    def append(self, df: DataFrame, tag: str = "") -> str:
        attempt = self.write(df)
        self.commit(attempt, tag)
        return attempt

    def compact(self) -> None:
        """One attempt in place of all untagged ones; what is appended meanwhile stays live beside it."""
        live = self.attempts("")
        if len(live) > 1:
            self.commit(self.write(self.read("")), "", live)


def cached_results(requests: DataFrame, store: ResultStore, infer: Callable[[DataFrame], DataFrame],
                   valid: Column | None = None) -> DataFrame:
    """Serve requests from the store and run ``infer`` on the distinct missing keys only.

    Returns one row a request row: its columns, the store's other columns,
    ``origin`` (``cache`` or ``model``) and ``infer_error``.  ``infer`` gets the
    missing requests, one a key, and gives keys, results and, for failed rows,
    ``infer_error``; failed rows are returned with their error and not stored,
    so they are asked again next time.  A stored row counts if ``valid`` holds.
    Requests with a null key match nothing.
    """
    keys, outs = store.keys, [c for c in store.schema.names if c not in store.keys]
    known = store.read("")
    known = (known.filter(valid) if valid is not None else known).withColumn("origin", F.lit("cache")).withColumn(
        "infer_error", F.lit(None).cast("string"))
    missing = requests.dropna(subset=keys).dropDuplicates(keys).join(known.select(*keys), keys, "left_anti")
    missing = cut(missing, "cache-missing")
    if missing.limit(1).count():
        new = infer(missing)
        if "infer_error" not in new.columns:
            new = new.withColumn("infer_error", F.lit(None).cast("string"))
        new = cut(new.select(*keys, *outs, "infer_error").withColumn("origin", F.lit("model")), "cache-inferred")   # the model runs once
        done = new.filter("infer_error is null")
        if done.limit(1).count():
            store.append(done)
            if len(store.attempts("")) > MANY_ATTEMPTS:
                store.compact()
        known = known.unionByName(new)
    return requests.join(known, keys, "left")


def fingerprint(df: DataFrame, salt: str = "") -> str:
    """128-bit digest of a table's rows (any order, repeated rows count) and ``salt``.

    Two independent 64-bit row hashes are summed exactly.
    """
    cols = [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
    sums = [F.sum(F.xxhash64(F.lit(seed), F.lit(salt), *cols).cast("decimal(38,0)")) for seed in (1, 2)]
    row = df.agg(F.count(F.lit(1)), *sums).first()
    return "-".join([str(row[0]), *[format(int(v or 0) % (1 << 64), "016x") for v in row[1:]]])


def cached_clusters(library: DataFrame, path: str, compute: Callable[[DataFrame], tuple[DataFrame, DataFrame]], config: str = "",
                    id_col: str = "entry_id", vec: str = "vector") -> tuple[DataFrame, DataFrame, bool]:
    """``(labels, centroids, hit)`` of a library, computed once for the same vectors and ``config`` (SNK6, SRC7).

    The result is stored under the fingerprint of ``(id, vector)``: any changed,
    added or removed vector misses, another order of rows does not.  Labels are
    committed before centroids and both are needed for a hit.
    """
    spark = library.sparkSession
    kind = library.schema[id_col].dataType.simpleString()
    labels = ResultStore(spark, f"{path}/labels", f"{id_col} {kind}, cluster_id int", [id_col])
    cents = ResultStore(spark, f"{path}/centroids", "cluster_id int, centroid array<double>", ["cluster_id"])
    tag = fingerprint(library.select(id_col, vec), config)
    hit = bool(cents.attempts(tag)) and bool(labels.attempts(tag))
    if not hit:
        found, centroids = compute(library)
        labels.append(cut(found.select(id_col, F.col("cluster_id").cast("int")), "clusters"), tag)
        cents.append(centroids.select(F.col("cluster_id").cast("int"), F.col("centroid").cast("array<double>")), tag)
    return labels.read(tag), cents.read(tag), hit
