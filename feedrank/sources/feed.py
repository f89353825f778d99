"""Feed queries over a landed paper table (SRC3, SRC4, SRT1, FLT4, FLT5).

The feed is a table ``(paper_id, category | categories, published, ...)``,
ideally partitioned by submission date so the day predicate prunes files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import feed_day, in_day
from ..operators.joins import DEFAULT_BROADCAST_ROWS, is_bounded
from ..operators.knn import top_overall

# Fixed default category list of the reference.
DEFAULT_CATEGORIES = ["cs.AI", "cs.CL", "cs.CV", "cs.LG", "cs.NE", "cs.RO"]


def category_filter(df: DataFrame, cats) -> DataFrame:
    """Any-of category predicate; non-list or empty -> the default list."""
    if not isinstance(cats, (list, tuple)) or not cats:
        cats = DEFAULT_CATEGORIES
    cats = list(cats)
    if "categories" in df.columns:  # cross-lists: any listed category matches
        return df.filter(F.arrays_overlap(F.col("categories"), F.array(*[F.lit(c) for c in cats])))
    return df.filter(F.col("category").isin(cats))


def feed_for_day(df: DataFrame, run_date, cats=None, ts: str = "published") -> DataFrame:
    """Papers of the requested categories submitted the day before ``run_date``.

    ``run_date`` is ``YYYY-MM-DD``; ``today``, NULL or a malformed value mean
    today (UTC).  The window is half-open, ``[day, day + 1)``.
    """
    return category_filter(df, cats).filter(in_day(ts, feed_day(run_date)))


def newest_first(df: DataFrame, max_results: int = 2000, ts: str = "published",
                 key: str = "paper_id") -> DataFrame:
    """At most ``max_results`` newest papers with a rank (``TakeOrderedAndProject``)."""
    return top_overall(df, [F.col(ts).desc(), F.col(key)], max_results)


def lookup_ids(papers: DataFrame, ids: DataFrame, key: str = "paper_id",
               max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS):
    """Split requested ids into found papers and missing ids (SRC4, INF6).

    The id list is broadcast only when its row count is proven small.
    """
    req = ids.select(key).distinct()
    side = F.broadcast(req) if is_bounded(req, max_broadcast_rows) else req
    found = papers.join(side, key, "left_semi")
    missing = req.join(papers.select(key), key, "left_anti")
    return found, missing


# Atom dumps of feed API responses, read with the built-in XML source.  The
# schema is explicit: inference would make single and repeated elements
# (authors, categories, links) differ between files.
ATOM_SCHEMA = (
    "id STRING, published STRING, title STRING, summary STRING, "
    "author ARRAY<STRUCT<name: STRING>>, "
    "link ARRAY<STRUCT<_href: STRING, _rel: STRING, _title: STRING, _type: STRING>>, "
    "`arxiv:primary_category` STRUCT<_term: STRING>, category ARRAY<STRUCT<_term: STRING>>"
)


def read_atom(spark, path) -> DataFrame:
    """Feed papers from Atom files: ``(paper_id, title, abstract, published,
    url, authors, primary_category, categories)``.

    ``paper_id`` is the last segment of the entry id (version kept), the
    abstract has newlines replaced by spaces, ``url`` is the PDF link.
    """
    from ..functions.ids import id_tail
    raw = spark.read.schema(ATOM_SCHEMA).option("rowTag", "entry").xml(path)
    pdf = F.filter("link", lambda l: l["_title"] == "pdf")
    return raw.select(
        id_tail("id").alias("paper_id"),
        F.col("title").alias("title"),
        F.translate(F.col("summary"), "\n", " ").alias("abstract"),
        F.to_timestamp("published").alias("published"),
        F.when(F.size(pdf) > 0, pdf[0]["_href"]).alias("url"),
        F.transform("author", lambda a: a["name"]).alias("authors"),
        F.col("`arxiv:primary_category`._term").alias("primary_category"),
        F.transform("category", lambda c: c["_term"]).alias("categories"),
    )
