"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Per document four integer rates are measured (``RATES``).  Their distribution
per (language, source) is kept as a quantile sketch: a histogram over
logarithmic-linear buckets, where a value keeps its five leading bits, so
every quantile is within 1/16 of the true one.  Sketches merge by adding
counts: tasks add theirs into a source's sketch, sources into a language's,
languages into one for all.  The sketch of a source decides, unless it holds
fewer than ``MIN_DOCS`` documents; then the language's does, then the whole's.

A rate's limit is ``median + max(slack, SPREAD * (median - 10th percentile))``:
the lower half of the distribution sets the scale, so junk in the upper half
does not widen it; and the limit of a source is at most its language's limit
plus the slack, so a source that is mostly junk does not pass as normal.
Only documents that pass the base rules enter the sketches.  Everything is
integer arithmetic, so results do not depend on task order.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import is_bounded, salted_join
from ..operators.lineage import cut
from .common import SPACES, col, text_or_empty, with_computed, words

SYMBOLS = "#*$%&|<>"
WINDOW_WORDS = 5
MIN_WORDS = 10               # base rule: fewer words fail
MAX_REPEAT = 20              # base rule: more than this percentage of repeated words fails
MIN_DOCS = 50                # documents a sketch needs to decide
SPREAD = 8
KEEP_BITS = 5                # leading bits a sketch bucket keeps
# rate name -> slack, all in thousandths (symbols and duplicate lines per word or line; word length in characters)
RATES = {"symbol": 100, "dup_line": 500, "repeat": 200, "word_len": 2_000}
THRESHOLD_ROWS = 200_000     # thresholds are broadcast up to this many (language, source) pairs
MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def repeated_words(w: list[bytes], size: int = WINDOW_WORDS) -> int:
    """Words covered by a window of ``size`` words that occurs at least twice in the text."""
    n = len(w) - size + 1
    if n < 2:
        return 0
    lut: dict[bytes, int] = {}
    ids = np.array([lut.setdefault(x, len(lut)) for x in w], dtype=np.int64)
    if len(lut) == len(w):
        return 0
    # windows as exact codes: (rank of the window's head, its last word), rank by rank
    code = ids
    for k in range(1, size):
        code = code[:-1] * len(lut) + ids[k:]
        if k < size - 1:
            code = np.unique(code, return_inverse=True)[1]
    _, inv, cnt = np.unique(code, return_inverse=True, return_counts=True)
    hit = cnt[inv] > 1
    if not hit.any():
        return 0
    edge = np.zeros(len(w) + 1, dtype=np.int64)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str) -> tuple[int, int, int, int, int, int]:
    """The numbers of ``MEASURES`` for one whole text."""
    w = words(text)
    chars = len(text) - sum(map(text.count, SPACES))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (len(w), chars, sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated_words(w))


def measures(texts: list[str]) -> dict:
    return dict(zip((x.split()[0] for x in MEASURES.split(", ")), zip(*map(measure, texts))))


def rate(name: str) -> Column:
    """A rate of ``RATES`` as an integer in thousandths."""
    over = {"symbol": ("n_symbols", "n_words"), "dup_line": ("n_dup_lines", "n_lines"),
            "repeat": ("n_repeat_words", "n_words"), "word_len": ("word_chars", "n_words")}[name]
    a, b = map(F.col, over)
    return F.when(b > 0, F.floor(F.lit(1000) * a / b)).otherwise(0).cast("long")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def bucket(v: Column) -> Column:
    """Lower end of the value's bucket: the value with all but its leading bits cleared."""
    drop = F.greatest(F.length(F.bin(v)) - KEEP_BITS, F.lit(0))
    step = F.expr("1L") * F.pow(F.lit(2), drop).cast("long")
    return v - F.pmod(v, step)


def sketches(measured: DataFrame) -> DataFrame:
    """Histogram sketches ``(lang, source, rate, bucket, n)`` of the documents that pass the base rules."""
    rates = F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), bucket(rate(r)).alias("bucket")) for r in RATES]))
    return (measured.filter(~base_failed()).select("lang", "source", rates.alias("x"))
            .groupBy("lang", "source", F.col("x.rate").alias("rate"), F.col("x.bucket").alias("bucket"))
            .agg(F.count(F.lit(1)).alias("n")))


def limits(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Merge sketches to ``keys`` and read the limits: ``(keys..., rate, docs, limit)``."""
    at = [*keys, "rate"]
    w = Window.partitionBy(*at).orderBy("bucket")            # at most a few hundred buckets a sketch
    run = (sketch.groupBy(*at, "bucket").agg(F.sum("n").alias("n"))
           .withColumn("cum", F.sum("n").over(w)).withColumn("docs", F.sum("n").over(Window.partitionBy(*at))))

    def q(percent: int) -> Column:
        return F.min(F.when(F.col("cum") * 100 >= F.col("docs") * percent, F.col("bucket")))

    slack = F.create_map(*[F.lit(x) for r, s in RATES.items() for x in (r, s)])[F.col("rate")]
    return (run.groupBy(*at).agg(F.max("docs").alias("docs"), q(50).alias("mid"), q(10).alias("low"))
            .select(*at, "docs", (F.col("mid") + F.greatest(slack, SPREAD * (F.col("mid") - F.col("low")))).alias("limit"),
                    slack.alias("slack")))


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row per (lang, source): its limit of every rate as a column ``max_<rate>``."""
    own = limits(sketch, ["lang", "source"])
    lang = limits(sketch, ["lang"]).select("lang", "rate", F.col("docs").alias("l_docs"), F.col("limit").alias("l_limit"))
    whole = limits(sketch, []).select("rate", F.col("limit").alias("w_limit"))
    every = own.join(lang, ["lang", "rate"]).join(whole, ["rate"])
    up = F.when(F.col("l_docs") >= MIN_DOCS, F.col("l_limit")).otherwise(F.col("w_limit"))
    lim = F.when(F.col("docs") >= MIN_DOCS, F.least(F.col("limit"), up + F.col("slack"))).otherwise(up)
    return every.groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("rate") == r, lim)).alias(f"max_{r}") for r in RATES])


def _with_keys(df: DataFrame, lang_col: str, source_col: str) -> tuple[Column, Column]:
    def key(c: str) -> Column:
        return text_or_empty(c) if c in df.columns else F.lit("")
    return key(lang_col), key(source_col)


def judge(measured: DataFrame, limit: DataFrame) -> DataFrame:
    """Add ``base_failed`` and ``kept``: the joined filter.

    A pair without thresholds (all of its documents fail the base rules) keeps nothing.
    """
    if is_bounded(limit, THRESHOLD_ROWS):
        got = measured.join(F.broadcast(limit), ["lang", "source"], "left")
    else:
        got = salted_join(measured, limit, ["lang", "source"], "left")
    over = F.lit(False)
    for r in RATES:
        over = over | (rate(r) > F.col(f"max_{r}"))
    return got.withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & ~F.coalesce(over, F.lit(True)))


def fit(slim: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``slim (text, lang, source, ...)`` without nulls in its keys: every row's measures (written, without texts) and the thresholds (written)."""
    rows, _ = with_computed(slim, "text", measures, MEASURES)
    kept = [F.col(f"_c{i}").alias(c) for i, c in enumerate(slim.columns) if c != "text"]
    got = cut(rows.select(*kept, *[x.split()[0] for x in MEASURES.split(", ")]), "rules")
    return got, cut(thresholds(sketches(got)), "limits")


def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    source_col: str = "source") -> DataFrame:
    """One row per document with its measures, limits and verdict.

    Null or empty texts have no word and fail the base rules.  Null languages
    or sources count as the empty string.  Rows with equal keys are judged
    one by one.  An empty table gives no row.
    """
    lang, source = _with_keys(df, lang_col, source_col)
    measured, limit = fit(df.select(col(id_col).alias("doc_id"), col(text_col).alias("text"), lang.alias("lang"), source.alias("source")))
    names = [x.split()[0] for x in MEASURES.split(", ")]
    return judge(measured, limit).select("doc_id", *names, "base_failed", "kept", *[f"max_{r}" for r in RATES])


def keep_documents(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The documents that pass, with all their columns, whatever their names.

    Null, empty and wordless texts fail the base rules; null languages and
    sources count as the empty string; repeated rows stay or go together; an
    empty table gives no row.  Texts are measured again while the rows stream
    by, so no text is shuffled to be joined with its verdict.
    """
    lang, source = _with_keys(df, lang_col, source_col)
    _, limit = fit(df.select(col(text_col).alias("text"), lang.alias("lang"), source.alias("source")))
    rows, restore = with_computed(df, text_col, measures, MEASURES)
    place = {c: F.col(f"_c{i}") for i, c in enumerate(df.columns)}

    def key(c: str) -> Column:
        return F.coalesce(place[c].cast("string"), F.lit("")) if c in place else F.lit("")

    rows = rows.withColumn("lang", key(lang_col)).withColumn("source", key(source_col))
    return restore(judge(rows, limit).filter("kept"))


_RATE_SQL = {"symbol": "n_symbols / n_words", "dup_line": "n_dup_lines / n_lines", "repeat": "n_repeat_words / n_words",
             "word_len": "word_chars / n_words"}


def oracle(table: str = "documents") -> str:
    """The same rules as DuckDB SQL over a table with doc_id, text, lang and source."""
    def ratio(r: str) -> str:
        a, b = _RATE_SQL[r].split(" / ")
        return f"CASE WHEN {b} > 0 THEN (1000 * {a}) // {b} ELSE 0 END"
    rates = " UNION ALL ".join(f"SELECT lang, source, '{r}' AS rate, {s} AS slack, {ratio(r)} AS v FROM m WHERE NOT base_failed"
                               for r, s in RATES.items())

    def level(name: str, keys: str) -> str:
        by = f"{keys}, rate" if keys else "rate"
        return (f"{name}_h AS (SELECT {by}, any_value(slack) AS slack, bucket, count(*) AS n FROM b GROUP BY {by}, bucket), "
                f"{name}_c AS (SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY bucket) AS cum, "
                f"sum(n) OVER (PARTITION BY {by}) AS docs FROM {name}_h), "
                f"{name} AS (SELECT {by}, any_value(slack) AS slack, max(docs) AS docs, "
                f"min(CASE WHEN cum * 100 >= docs * 50 THEN bucket END) AS mid, "
                f"min(CASE WHEN cum * 100 >= docs * 10 THEN bucket END) AS low FROM {name}_c GROUP BY {by})")

    lim = "{0}.mid + greatest({0}.slack, {1} * ({0}.mid - {0}.low))"
    up = f"CASE WHEN l.docs >= {MIN_DOCS} THEN {lim.format('l', SPREAD)} ELSE {lim.format('w', SPREAD)} END"
    maxes = ", ".join(f"max(CASE WHEN rate = '{r}' THEN lim END) AS max_{r}" for r in RATES)
    over = " OR ".join(f"({ratio(r)}) > max_{r}" for r in RATES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text,
                  row_number() OVER () AS rid FROM {table}),
ws AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w,
              list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, array_to_string(list_slice(w, i, i + {WINDOW_WORDS - 1}), ' ') AS k
        FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - {WINDOW_WORDS - 2}, 1))) AS i FROM ws)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + {WINDOW_WORDS})) AS p FROM dup) GROUP BY rid),
m0 AS (SELECT ws.doc_id, lang, source, len(w)::BIGINT AS n_words,
        length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[{SYMBOLS}]', '', 'g')))::BIGINT AS n_symbols,
        len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM ws LEFT JOIN cov USING (rid)),
m AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM m0),
r AS ({rates}),
b AS (SELECT *, v - v % (2 ** greatest(length(bin(v)) - {KEEP_BITS}, 0))::BIGINT AS bucket FROM r),
{level('o', 'lang, source')}, {level('l', 'lang')}, {level('w', '')},
t AS (SELECT lang, source, {maxes} FROM (
        SELECT o.lang, o.source, o.rate, CASE WHEN o.docs >= {MIN_DOCS}
               THEN least({lim.format('o', SPREAD)}, {up} + o.slack) ELSE {up} END AS lim
        FROM o JOIN l ON o.lang = l.lang AND o.rate = l.rate JOIN w ON o.rate = w.rate) GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce({over}, true) AS kept, {', '.join(f'max_{r}::BIGINT AS max_{r}' for r in RATES)}
FROM m LEFT JOIN t USING (lang, source)
"""
