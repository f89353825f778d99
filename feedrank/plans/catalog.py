"""The checked query catalog: one builder per operator key of the inventory.

Every builder reads whole driver tables (``sources.tables``) and calls library
operators; the SQL next to it is the DuckDB oracle for the same result.
Floating results are rounded to 6 decimals and ranks ordered by
``round(x, 9)`` then an id, in both engines.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import knn, vectors
from ..operators.joins import DEFAULT_BROADCAST_ROWS, is_bounded
from ..operators.lineage import cut
from ..sources import tables as T
from .registry import register
from .sqlparts import ASSIGN, CENT, COR, LIB, PAPERS, PROFILE, PTEXT, density_sql, l2, tree_ctes

# Fixed parameters of the checked queries.
K_NEIGHBOURS = 10       # knn_exact
K_GLOBAL = 50           # knn_global
TOPK = 10               # results per list
OVERSAMPLE = 4          # re-rank candidates = TOPK * OVERSAMPLE


def _r6(c):
    return F.round(c, 6)


# ======================================================================= vectors
@register("l2_distance", sql=f"""
SELECT a.vec_id, b.vec_id AS next_id, round({l2('a.embedding', 'b.embedding')}, 6) AS distance
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
""")
def l2_distance(spark, sf):
    from ..functions.vectors import l2sq
    e = T.read(spark, sf, "embeddings")
    a, b = e.alias("a"), e.alias("b")
    return (a.join(b, F.col("b.vec_id") == F.col("a.vec_id") + 1)
            .select(F.col("a.vec_id"), F.col("b.vec_id").alias("next_id"),
                    _r6(l2sq("a.embedding", "b.embedding")).alias("distance")))


@register("profile_mean", sql=f"""
WITH lib AS ({LIB})
SELECT CAST(i AS INTEGER) AS dim, round(avg(x), 6) AS value FROM (
  SELECT generate_subscripts(vector, 1) AS i, unnest(vector)::DOUBLE AS x FROM lib) GROUP BY i
""")
def profile_mean(spark, sf):
    p = vectors.profile_mean(T.library_vectors(spark, sf))
    return p.select(F.posexplode("vector").alias("pos", "v")).select(
        (F.col("pos") + 1).cast("int").alias("dim"), _r6("v").alias("value"))


def _centroids(spark, sf):
    return vectors.centroids(T.library_vectors(spark, sf))


@register("centroids", sql=f"""
WITH lib AS ({LIB}), cent AS ({CENT})
SELECT cluster_id, n, CAST(i AS INTEGER) AS dim, round(centroid[i], 6) AS value
FROM (SELECT *, generate_subscripts(centroid, 1) AS i FROM cent)
""")
def centroids(spark, sf):
    c = _centroids(spark, sf)
    return c.select("cluster_id", "n", F.posexplode("centroid").alias("pos", "v")).select(
        "cluster_id", "n", (F.col("pos") + 1).cast("int").alias("dim"), _r6("v").alias("value"))


@register("cluster_count", sql=f"""
WITH lib AS ({LIB})
SELECT count(DISTINCT CASE WHEN cluster_id <> -1 THEN cluster_id END) AS n_clusters,
       count(*) FILTER (WHERE cluster_id = -1) AS n_noise, count(*) AS n_entries FROM lib
""")
def cluster_count(spark, sf):
    return vectors.cluster_count(T.library_vectors(spark, sf))


@register("knn_exact", sql=f"""
WITH lib AS ({LIB}), cor AS ({COR}),
d AS (SELECT l.entry_id AS query_id, c.paper_id AS neighbor_id, {l2('l.vector', 'c.vector')} AS distance
      FROM lib l, cor c),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), neighbor_id) AS rank FROM d)
SELECT query_id, neighbor_id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank
FROM r WHERE rank <= {K_NEIGHBOURS}
""")
def knn_exact(spark, sf):
    nn = knn.knn_join(T.library_vectors(spark, sf), T.corpus_vectors(spark, sf), K_NEIGHBOURS,
                      left_id="entry_id", right_id="paper_id")
    return nn.select("query_id", "neighbor_id", _r6("distance").alias("distance"), "rank")


def global_candidates(spark, sf, k):
    """Profile mean of the library -> k nearest corpus papers (SRT2)."""
    prof = vectors.profile_mean(T.library_vectors(spark, sf))
    nn = knn.knn_join(prof, T.corpus_vectors(spark, sf), k, left_id="profile_id", right_id="paper_id")
    return nn.select(F.col("neighbor_id").alias("paper_id"), "distance", "rank")


@register("knn_global", sql=f"""
WITH lib AS ({LIB}), cor AS ({COR}), prof AS ({PROFILE}), papers AS ({PAPERS}),
d AS (SELECT c.paper_id, {l2('c.vector', 'p.vector')} AS distance FROM cor c, prof p),
r AS (SELECT *, row_number() OVER (ORDER BY round(distance, 9), paper_id) AS rank FROM d)
SELECT CAST(r.rank AS INTEGER) AS rank, r.paper_id, round(r.distance, 6) AS distance, p.title
FROM r JOIN papers p USING (paper_id) WHERE r.rank <= {K_GLOBAL}
""")
def knn_global(spark, sf):
    cand = global_candidates(spark, sf, K_GLOBAL)
    return cand.join(T.papers(spark, sf).select("paper_id", "title"), "paper_id").select(
        "rank", "paper_id", _r6("distance").alias("distance"), "title")


def _assign(spark, sf):
    return knn.assign_nearest(T.corpus_vectors(spark, sf), _centroids(spark, sf))


@register("assign", sql=f"""
WITH lib AS ({LIB}), cor AS ({COR}), cent AS ({CENT})
SELECT paper_id, cluster_id, round(distance, 6) AS distance FROM ({ASSIGN})
""")
def assign(spark, sf):
    return _assign(spark, sf).select("paper_id", "cluster_id", _r6("distance").alias("distance"))


def _per_cluster_sql(k):
    return f"""
WITH lib AS ({LIB}), cor AS ({COR}), cent AS ({CENT}), a AS ({ASSIGN}),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round(distance, 9), paper_id) AS rank FROM a)
SELECT cluster_id, CAST(rank AS INTEGER) AS rank, paper_id, round(-distance, 6) AS score FROM r WHERE rank <= {k}
"""


def cluster_candidates(spark, sf, k):
    """Per cluster the k papers nearest to its centroid (WIN1/WIN2)."""
    return knn.top_per_group(_assign(spark, sf), ["cluster_id"],
                             [F.round("distance", 9), F.col("paper_id")], k)


@register("assign_topk", sql=_per_cluster_sql(TOPK))
def assign_topk(spark, sf):
    return cluster_candidates(spark, sf, TOPK).select(
        "cluster_id", "rank", "paper_id", _r6(-F.col("distance")).alias("score"))


@register("oversample", sql=_per_cluster_sql(TOPK * OVERSAMPLE))
def oversample(spark, sf):
    return cluster_candidates(spark, sf, TOPK * OVERSAMPLE).select(
        "cluster_id", "rank", "paper_id", _r6(-F.col("distance")).alias("score"))


@register("zip_centroids", sql=f"""
WITH lib AS ({LIB}), cent AS ({CENT})
SELECT cluster_id, CAST(i AS INTEGER) AS dim, round(centroid[i], 6) AS value
FROM (SELECT *, generate_subscripts(centroid, 1) AS i FROM cent)
""")
def zip_centroids(spark, sf):
    packed = vectors.pack_parallel(_centroids(spark, sf), "cluster_id", "centroid")
    z = vectors.zip_pairs(packed, "ids", "vectors")
    return z.select("cluster_id", F.posexplode("centroid").alias("pos", "v")).select(
        "cluster_id", (F.col("pos") + 1).cast("int").alias("dim"), _r6("v").alias("value"))


@register("vector_append", sql="""
SELECT vec_id AS set_id, vec_id AS src_id, 'base' AS origin FROM embeddings WHERE vec_id % 10 = 0
UNION ALL
SELECT (SELECT coalesce(max(vec_id) + 1, 0) FROM embeddings WHERE vec_id % 10 = 0)
       + row_number() OVER (ORDER BY vec_id) - 1 AS set_id, vec_id AS src_id, 'added' AS origin
FROM embeddings WHERE vec_id % 10 <> 0
""")
def vector_append(spark, sf):
    lib = T.library_vectors(spark, sf).select(F.col("entry_id").alias("set_id"),
                                              F.col("entry_id").alias("src_id"), "vector")
    new = T.corpus_vectors(spark, sf).select(F.col("paper_id").alias("src_id"), "vector")
    out = vectors.append_vectors(lib.withColumn("origin", F.lit("base")),
                                 new.withColumn("origin", F.lit("added")), dim=64)
    return out.select("set_id", "src_id", "origin")


# ======================================================================= text, ids, dates
from ..functions import dates as D  # noqa: E402
from ..functions import ids as I  # noqa: E402
from ..functions import scores as S  # noqa: E402
from ..functions import text as X  # noqa: E402
from ..operators import sequence  # noqa: E402
from .sqlparts import strip_ws as _sql_strip  # noqa: E402

# Fixed values from the reference configuration: the explanation prompt, the
# built-in default prompt, the target language and the date used by the checks.
PROMPT_TEMPLATE = ("以下の論文について、主要な貢献と新規性を中心に{target_language}で簡潔に解説してください。\n"
                   "Title: {title}\n"
                   "Abstract: {abstract}\n")
DEFAULT_PROMPT = ("以下の論文について、主要な貢献と新規性を中心に{target_language}で簡潔に解説してください。\n"
                  "専門用語は必要に応じて簡単な言葉で補足してください。\n"
                  "\n"
                  "Title: {title}\n"
                  "\n"
                  "Abstract: {abstract}")
TARGET_LANGUAGE = "Japanese"
RUN_DATE = "2024-01-15"
MAX_RESULTS = 2000
BATCH_SIZE = 10
DEBUG_ROWS = 100


def _sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _sql_template(tpl: str, values: dict) -> str:
    parts = X.parse_template(tpl, set(values))
    out = []
    for kind, v in parts:
        if kind == "lit":
            if v:
                out.append(_sql_lit(v))
        else:
            out.append(values[v])
    return " || ".join(out)


_AUTHORS_SQL = (
    "SELECT conv_id, list_transform(string_split(trim(regexp_replace(author_raw, '\\s+', ' ', 'g')), ' and '),"
    " lambda x: trim(x)) AS authors FROM (SELECT conv_id, string_agg(role, ' and ' ORDER BY turn) AS author_raw"
    " FROM conversations GROUP BY conv_id)")


def authors(spark, sf):
    a = T.raw_authors(spark, sf)
    return a.select("conv_id", X.split_authors("author_raw").alias("authors"))


@register("paper_text", sql=f"""
WITH p AS ({PAPERS}), au AS ({_AUTHORS_SQL}),
t AS (SELECT p.paper_id, {_sql_strip("concat_ws(chr(10), nullif(p.title, ''), nullif(p.abstract, ''), "
                                     "CASE WHEN array_to_string(au.authors, ', ') <> '' "
                                     "THEN 'Authors: ' || array_to_string(au.authors, ', ') END)")} AS text
      FROM p LEFT JOIN au ON au.conv_id = p.paper_id)
SELECT paper_id, md5(text) AS text_md5, CAST(strlen(text) AS BIGINT) AS n_bytes FROM t WHERE text <> ''
""")
def paper_text(spark, sf):
    p = T.papers(spark, sf).join(authors(spark, sf), F.col("paper_id") == F.col("conv_id"), "left")
    t = p.select("paper_id", X.paper_text("title", "abstract", "authors").alias("text")).filter(F.col("text") != "")
    return t.select("paper_id", F.md5("text").alias("text_md5"), F.octet_length("text").cast("bigint").alias("n_bytes"))


@register("abstract_fallback", sql=f"""
WITH p AS ({PAPERS})
SELECT paper_id, md5(coalesce(abstract, source, '')) AS abstract_md5,
       CASE WHEN abstract IS NOT NULL THEN 'abstract' WHEN source IS NOT NULL THEN 'annote' ELSE 'none' END AS used
FROM p
""")
def abstract_fallback(spark, sf):
    p = T.papers(spark, sf)
    used = (F.when(F.col("abstract").isNotNull(), "abstract")
            .when(F.col("source").isNotNull(), "annote").otherwise("none"))
    return p.select("paper_id", F.md5(X.abstract_fallback("abstract", "source")).alias("abstract_md5"),
                    used.alias("used"))


@register("flatten_text", sql=f"""
WITH p AS ({PAPERS})
SELECT paper_id, md5(replace(coalesce(abstract, ''), chr(10), ' ')) AS flat_md5,
       CAST(strlen(coalesce(abstract, '')) - strlen(replace(coalesce(abstract, ''), chr(10), '')) AS BIGINT) AS n_breaks
FROM p
""")
def flatten_text(spark, sf):
    a = F.coalesce(F.col("abstract"), F.lit(""))
    return T.papers(spark, sf).select(
        "paper_id", F.md5(X.flatten(a)).alias("flat_md5"),
        (F.octet_length(a) - F.octet_length(F.regexp_replace(a, "\n", ""))).cast("bigint").alias("n_breaks"))


def _latex_input():
    return F.concat(F.lit("{\\textbf{"), F.col("title"), F.lit("}\\footnote{"), F.col("source"), F.lit("} "),
                    F.coalesce(F.col("abstract"), F.lit("")), F.lit(" \\textit{"), F.col("lang"), F.lit("}}"))


_LATEX_SQL = ("'{\\textbf{' || title || '}\\footnote{' || source || '} ' || coalesce(abstract, '') "
              "|| ' \\textit{' || lang || '}}'")


def _latex_sql(x):
    s = f"regexp_replace({x}, '(?s)\\\\footnote\\{{.*?\\}}', '', 'g')"
    for cmd in ("textbf", "textit", "texttt"):
        s = f"regexp_replace({s}, '(?s)\\\\{cmd}\\{{(.*?)\\}}', '\\1', 'g')"
    return _sql_strip(f"trim({s}, '{{}}')")


@register("latex_strip", sql=f"""
WITH p AS ({PAPERS})
SELECT paper_id, md5({_latex_sql(_LATEX_SQL)}) AS clean_md5, CAST(strlen({_latex_sql(_LATEX_SQL)}) AS BIGINT) AS n_bytes
FROM p
""")
def latex_strip(spark, sf):
    t = T.papers(spark, sf).select("paper_id", X.latex_strip(_latex_input()).alias("c"))
    return t.select("paper_id", F.md5("c").alias("clean_md5"), F.octet_length("c").cast("bigint").alias("n_bytes"))


_PROMPT_VALUES_SQL = {"title": "title", "abstract": "coalesce(abstract, '')",
                      "target_language": _sql_lit(TARGET_LANGUAGE)}
_BROKEN_TEMPLATE = "Title: {title}\n{target_language}"


@register("prompt_fill", sql=f"""
WITH p AS ({PAPERS})
SELECT paper_id, md5({_sql_template(PROMPT_TEMPLATE, _PROMPT_VALUES_SQL)}) AS prompt_md5,
       md5({_sql_template(DEFAULT_PROMPT, _PROMPT_VALUES_SQL)}) AS fallback_md5
FROM p
""")
def prompt_fill(spark, sf):
    vals = {"title": F.col("title"), "abstract": F.coalesce(F.col("abstract"), F.lit("")),
            "target_language": TARGET_LANGUAGE}
    good = X.fill_template(PROMPT_TEMPLATE, DEFAULT_PROMPT, vals)
    broken = X.fill_template(_BROKEN_TEMPLATE, DEFAULT_PROMPT, vals)
    return T.papers(spark, sf).select("paper_id", F.md5(good).alias("prompt_md5"), F.md5(broken).alias("fallback_md5"))


@register("fence_strip", sql="""
SELECT doc_id,
  md5(regexp_replace(regexp_replace('```markdown' || chr(10) || text || chr(10) || '```',
      '\\A```markdown\\n', ''), '\\n```\\z', '')) AS wrapped_md5,
  md5(regexp_replace(regexp_replace(text, '\\A```markdown\\n', ''), '\\n```\\z', '')) AS plain_md5
FROM documents
""")
def fence_strip(spark, sf):
    d = T.read(spark, sf, "documents")
    wrapped = F.concat(F.lit("```markdown\n"), F.col("text"), F.lit("\n```"))
    return d.select("doc_id", F.md5(X.fence_strip(wrapped)).alias("wrapped_md5"),
                    F.md5(X.fence_strip("text")).alias("plain_md5"))


@register("label_clean", sql=f"""
SELECT doc_id, nullif(split_part({_sql_strip('text')}, chr(10), 1), '') AS label FROM documents
""")
def label_clean(spark, sf):
    return T.read(spark, sf, "documents").select("doc_id", X.label_clean("text").alias("label"))


@register("batch_ids", sql=f"""
WITH t AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents
           WHERE {_sql_strip("coalesce(text, '')")} <> '')
SELECT CAST(floor(pos / {BATCH_SIZE}) AS BIGINT) AS batch_id, count(*) AS n_rows,
       min(doc_id) AS first_id, max(doc_id) AS last_id FROM t GROUP BY 1
""")
def batch_ids(spark, sf):
    d = T.read(spark, sf, "documents").filter(X.strip_ws(F.coalesce(F.col("text"), F.lit(""))) != "")
    b = sequence.batch_numbers(d.select("doc_id"), "doc_id", BATCH_SIZE)
    return b.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_rows"), F.min("doc_id").alias("first_id"),
                                     F.max("doc_id").alias("last_id"))


@register("seq_ids", sql="""
SELECT doc_id, (SELECT coalesce(max(doc_id) + 1, 0) FROM labels) + row_number() OVER (ORDER BY doc_id) - 1 AS seq_id
FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
""")
def seq_ids(spark, sf):
    lab = T.read(spark, sf, "labels")
    new = T.read(spark, sf, "documents").select("doc_id").join(lab.select("doc_id"), "doc_id", "left_anti")
    return sequence.with_sequence(new, "doc_id", out="seq_id", start=sequence.next_id(lab, "doc_id"))


@register("debug_limit", sql=f"""
SELECT doc_id, source FROM documents ORDER BY source, doc_id LIMIT {DEBUG_ROWS}
""")
def debug_limit(spark, sf):
    return T.read(spark, sf, "documents").select("doc_id", "source").orderBy("source", "doc_id").limit(DEBUG_ROWS)


@register("ingest_counts", sql=f"""
WITH p AS ({PAPERS})
SELECT count(*) AS n_raw, count(*) FILTER (WHERE title <> '') AS n_processed,
       count(*) FILTER (WHERE title = '') AS n_skipped FROM p
""")
def ingest_counts(spark, sf):
    p = T.papers(spark, sf)
    return p.agg(F.count(F.lit(1)).alias("n_raw"), F.count_if(F.col("title") != "").alias("n_processed"),
                 F.count_if(F.col("title") == "").alias("n_skipped"))


# a value may hold no braces; a document's entry follows the definition of its journal's name
_BIB_TITLE, _BIB_ABSTRACT = (f"coalesce(translate({c}, '{{}}', '()'), '')" for c in ("title", "abstract"))


@register("bib_entries", sql=f"""
WITH p AS ({PAPERS})
SELECT 'd' || p.paper_id AS entry_id, 'article' AS entry_type, {_BIB_TITLE} AS title, md5({_BIB_ABSTRACT}) AS abstract_md5,
       len({_BIB_ABSTRACT}) AS abstract_chars, coalesce(d.source, '') || ' papers' AS journal, CAST(p.paper_id AS VARCHAR) AS year
FROM p JOIN documents d ON d.doc_id = p.paper_id WHERE {_BIB_TITLE} <> ''
""")
def bib_entries(spark, sf):
    """All documents written as a bibliography - names, indented heads, remarks between entries - and read back."""
    from ..session import scratch_path
    from ..sources import bibtex
    p = T.papers(spark, sf)
    folder = scratch_path(spark, f"bib/{uuid.uuid4().hex}")
    p.select(F.concat(F.lit("@string{j"), "paper_id", F.lit(" = {"), F.coalesce("source", F.lit("")), F.lit("}}\nA remark, with one @ sign.\n  @article{d"),
                      "paper_id", F.lit(",\n  title = {"), F.expr(_BIB_TITLE), F.lit("},\n  journal = j"), "paper_id",
                      F.lit(' # " papers",\n  year = '), "paper_id", F.lit(",\n  abstract = {"), F.expr(_BIB_ABSTRACT),
                      F.lit("}} and a remark behind it"))).write.text(folder)
    entries, _ = bibtex.library_entries(bibtex.scan_bib(spark, folder), more=("journal",))
    return entries.select(
        "entry_id", "entry_type", "title", F.md5("abstract").alias("abstract_md5"),
        F.char_length("abstract").cast("bigint").alias("abstract_chars"), "journal", "year")


@register("authors_split", sql=f"""
WITH au AS ({_AUTHORS_SQL})
SELECT conv_id, CAST(len(authors) AS INTEGER) AS n_authors, array_to_string(authors, '|') AS authors FROM au
""")
def authors_split(spark, sf):
    a = authors(spark, sf)
    return a.select("conv_id", F.size("authors").alias("n_authors"), F.array_join("authors", "|").alias("authors"))


@register("person_names", sql="""
WITH per AS (
  SELECT conv_id, turn, concat_ws(' ', nullif(role, ''), NULL, nullif(regexp_extract(text, '^(\\p{L}+)', 1), ''), NULL) AS name
  FROM conversations),
au AS (SELECT conv_id, list(name ORDER BY turn) FILTER (WHERE name <> '') AS names FROM per GROUP BY conv_id)
SELECT conv_id, array_to_string(names, '; ') AS names FROM au
""")
def person_names(spark, sf):
    c = T.read(spark, sf, "conversations")
    person = F.struct(F.col("role").alias("first"), F.lit("").alias("von"),
                      F.regexp_extract("text", r"^(\p{L}+)", 1).alias("last"), F.lit("").alias("jr"))
    per = c.select("conv_id", "turn", X.person_name(person).alias("name"))
    g = per.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "name"))).alias("s"))
    names = F.filter(F.transform("s", lambda x: x["name"]), lambda n: n != "")
    return g.select("conv_id", F.array_join(names, "; ").alias("names"))


@register("id_tail", sql="SELECT page_id, string_split(url, '/')[-1] AS tail FROM pages")
def id_tail(spark, sf):
    return T.read(spark, sf, "pages").select("page_id", I.id_tail("url").alias("tail"))


@register("safe_ids", sql="""
SELECT page_id, replace(url, '/', '_') AS file_id, translate(url, './', '-_') AS html_id,
       translate(url, '/:', '--') AS model_key FROM pages
""")
def safe_ids(spark, sf):
    p = T.read(spark, sf, "pages")
    return p.select("page_id", I.file_safe_id("url").alias("file_id"), I.html_safe_id("url").alias("html_id"),
                    I.model_key("url").alias("model_key"))


@register("config_hash", sql="""
SELECT DISTINCT source, lang, substr(md5(source || '-' || lang), 1, 8) AS config_hash FROM documents
""")
def config_hash(spark, sf):
    d = T.read(spark, sf, "documents").select("source", "lang").distinct()
    return d.select("source", "lang", I.config_hash("source", "lang").alias("config_hash"))


_ISO_SQL = ("strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 <> 0 THEN '.' || "
            "lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') ELSE '' END || '+00:00'")
_CATS_SQL = ", ".join(f"'{c}'" for c in T.FEED_CATEGORIES)


def feed(spark, sf):
    """The feed stand-in: ``(paper_id, category, published)`` from ``events``."""
    e = T.read(spark, sf, "events")
    return e.select(F.col("event_id").alias("paper_id"), F.col("event_type").alias("category"),
                    F.col("ts").alias("published"), "user_id")


@register("feed_window", sql=f"""
SELECT event_id AS paper_id, event_type AS category, {_ISO_SQL} AS published FROM events
WHERE event_type IN ({_CATS_SQL})
  AND ts >= CAST(coalesce(try_strptime('{RUN_DATE}', '%Y-%m-%d')::DATE, current_date) - 1 AS TIMESTAMP)
  AND ts < CAST(coalesce(try_strptime('{RUN_DATE}', '%Y-%m-%d')::DATE, current_date) AS TIMESTAMP)
""")
def feed_window(spark, sf):
    from ..sources.feed import feed_for_day
    f = feed_for_day(feed(spark, sf), RUN_DATE, list(T.FEED_CATEGORIES))
    return f.select("paper_id", "category", D.iso_utc("published").alias("published"))


@register("feed_recent", sql=f"""
SELECT CAST(row_number() OVER (ORDER BY ts DESC, event_id) AS INTEGER) AS rank, event_id AS paper_id,
       {_ISO_SQL} AS published
FROM events WHERE event_type IN ({_CATS_SQL}) ORDER BY ts DESC, event_id LIMIT {MAX_RESULTS}
""")
def feed_recent(spark, sf):
    from ..sources.feed import newest_first
    f = feed(spark, sf).filter(F.col("category").isin(list(T.FEED_CATEGORIES)))
    top = newest_first(f, MAX_RESULTS)
    return top.select("rank", "paper_id", D.iso_utc("published").alias("published"))


_RAW_DATE_SQL = ("CASE event_type WHEN 'view' THEN strftime(ts, '%Y-%m-%d') WHEN 'click' THEN 'today' "
                 "WHEN 'error' THEN 'not-a-date' WHEN 'purchase' THEN strftime(ts, '%Y/%m/%d') END")


@register("run_date", sql=f"""
SELECT event_id, strftime(coalesce(try_strptime({_RAW_DATE_SQL}, '%Y-%m-%d')::DATE, current_date), '%Y%m%d') AS file_date
FROM events
""")
def run_date(spark, sf):
    e = T.read(spark, sf, "events")
    t = e.event_type
    raw = (F.when(t == "view", F.date_format("ts", "yyyy-MM-dd")).when(t == "click", "today")
           .when(t == "error", "not-a-date").when(t == "purchase", F.date_format("ts", "yyyy/MM/dd")))
    return e.select("event_id", D.file_date(raw).alias("file_date"))


# Model replies exercised by score parsing (fixed cases from the reference's handling).
REPLY_CASES = ("0.7", " 1.4 ", "-2", "nan", "inf", "abc", "", "-inf")


@register("score_clamp", sql=f"""
WITH r AS (SELECT event_id, CASE WHEN event_id % 9 < 8
             THEN [{", ".join(_sql_lit(c) for c in REPLY_CASES)}][event_id % 9 + 1]
             ELSE '0.' || json_extract_string(props, '$.k') END AS reply FROM events)
SELECT event_id, round(greatest(0.0, least(1.0, coalesce(TRY_CAST({_sql_strip('reply')} AS DOUBLE), 0.0))), 6) AS score
FROM r
""")
def score_clamp(spark, sf):
    e = T.read(spark, sf, "events")
    cases = F.array(*[F.lit(c) for c in REPLY_CASES])
    m = F.pmod(F.col("event_id"), F.lit(9))
    reply = F.when(m < 8, F.element_at(cases, (m + 1).cast("int"))).otherwise(
        F.concat(F.lit("0."), F.get_json_object("props", "$.k")))
    return e.select("event_id", _r6(S.clamp_score(reply)).alias("score"))


# ======================================================================= groups, plans, caches, scorers
from ..operators import cache as C  # noqa: E402
from ..operators import groups as G  # noqa: E402
from ..operators import lexical as LX  # noqa: E402
from ..sources.feed import lookup_ids as _lookup_ids  # noqa: E402
from . import recommend as R  # noqa: E402
from .sqlparts import IDF, PTEXT, SAMPLES, UNSEEN, cosine, tok, weights  # noqa: E402,F401

# The explanation model of the reference configuration.
EXPLAIN_MODEL = "gemini-2.0-flash-lite"
LABEL_MAX_WORDS = 10
MISSING_ID_OFFSET = 1_000_000


def texts(spark, sf):
    """Paper texts ``(paper_id, text)`` (PRJ1 without authors), empty ones dropped (FLT2)."""
    p = T.papers(spark, sf)
    t = p.select("paper_id", X.paper_text("title", "abstract", F.array().cast("array<string>")).alias("text"))
    return t.filter(F.col("text") != "")


def collection(spark, sf):
    return T.read(spark, sf, "documents").select("doc_id", "text")


def _samples(spark, sf):
    return R.cluster_samples(T.library_vectors(spark, sf), texts(spark, sf))


_BASE = f"lib AS ({LIB}), cor AS ({COR}), papers AS ({PAPERS}), pt AS ({PTEXT})"


@register("samples", sql=f"""
WITH {_BASE}, s AS ({SAMPLES})
SELECT cluster_id, CAST(count(*) AS INTEGER) AS n_samples, string_agg(CAST(entry_id AS VARCHAR), '|' ORDER BY entry_id) AS sample_ids
FROM s GROUP BY cluster_id
""")
def samples(spark, sf):
    g = G.gather_samples(_samples(spark, sf))
    return g.select("cluster_id", F.size("ids").alias("n_samples"),
                    F.array_join(F.transform("ids", lambda x: x.cast("string")), "|").alias("sample_ids"))


@register("profile_text", sql=f"""
WITH {_BASE}, s AS ({SAMPLES}),
p AS (SELECT cluster_id, string_agg(text, chr(10) || '---' || chr(10) ORDER BY entry_id) AS profile_text FROM s GROUP BY cluster_id)
SELECT cluster_id, md5(profile_text) AS profile_md5, CAST(strlen(profile_text) AS BIGINT) AS n_bytes FROM p
""")
def profile_text(spark, sf):
    p = G.profile_text(G.gather_samples(_samples(spark, sf)))
    return p.select("cluster_id", F.md5("profile_text").alias("profile_md5"),
                    F.octet_length("profile_text").cast("bigint").alias("n_bytes"))


def _clusters_with_far(spark, sf):
    """Centroids plus one far-away centroid that no paper is nearest to."""
    cents = _centroids(spark, sf)
    far = cents.agg((F.max("cluster_id") + 1).cast("int").alias("cluster_id"),
                    F.array_repeat(F.lit(10.0), F.max(F.size("centroid"))).alias("centroid"),
                    F.lit(0).cast("bigint").alias("n"))
    return cents.unionByName(far)


_CENT_FAR = ("SELECT cluster_id, centroid FROM cent UNION ALL SELECT max(cluster_id) + 1, "
             "list_transform(range(max(len(centroid))), lambda x: 10.0) FROM cent")


def _labels(spark, sf):
    """Stand-in label cache: first line of a cluster's first sample; a label
    longer than the word limit counts as failed (NULL)."""
    first = _samples(spark, sf).filter(F.col("sample_rank") == 1)
    lab = X.label_clean("text")
    ok = F.size(F.split(lab, " ")) <= LABEL_MAX_WORDS
    return first.select("cluster_id", F.when(ok, lab).alias("label"))


_LABELS_SQL = (f"SELECT cluster_id, CASE WHEN len(string_split(lab, ' ')) <= {LABEL_MAX_WORDS} THEN lab END AS label "
               f"FROM (SELECT cluster_id, nullif(split_part({_sql_strip('text')}, chr(10), 1), '') AS lab "
               f"FROM s WHERE sr = 1)")
_LABEL_DEFAULT_SQL = ("SELECT k.cluster_id, coalesce(l.label, 'Cluster ' || CAST(k.cluster_id AS VARCHAR)) AS label "
                      "FROM kf k LEFT JOIN lab l USING (cluster_id)")


@register("label_default", sql=f"""
WITH {_BASE}, cent AS ({CENT}), kf AS ({_CENT_FAR}), s AS ({SAMPLES}), lab AS ({_LABELS_SQL})
{_LABEL_DEFAULT_SQL}
""")
def label_default(spark, sf):
    lab = G.attach_labels(_clusters_with_far(spark, sf).select("cluster_id"), _labels(spark, sf))
    return lab.select("cluster_id", "label")


@register("hydrate", sql=f"""
WITH {_BASE}, cent AS ({CENT}), a AS ({ASSIGN}),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round(distance, 9), paper_id) AS rank FROM a)
SELECT r.cluster_id, CAST(r.rank AS INTEGER) AS rank, r.paper_id, p.title FROM r JOIN papers p USING (paper_id)
WHERE r.rank <= {TOPK}
""")
def hydrate(spark, sf):
    top = cluster_candidates(spark, sf, TOPK)
    return top.join(T.papers(spark, sf).select("paper_id", "title"), "paper_id").select(
        "cluster_id", "rank", "paper_id", "title")


_CAND_SQL = (f"cand AS (SELECT k.* FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round(distance, 9), "
             f"paper_id) AS crank FROM a) k JOIN pt USING (paper_id) WHERE k.crank <= {TOPK * OVERSAMPLE})")


@register("pairs", sql=f"""
WITH {_BASE}, cent AS ({CENT}), a AS ({ASSIGN}), {_CAND_SQL}, s AS ({SAMPLES}),
p AS (SELECT cluster_id, string_agg(text, chr(10) || '---' || chr(10) ORDER BY entry_id) AS profile_text FROM s GROUP BY cluster_id)
SELECT c.cluster_id, c.paper_id, md5(p.profile_text) AS profile_md5, md5(t.text) AS cand_md5
FROM cand c JOIN p USING (cluster_id) JOIN pt t USING (paper_id)
""")
def pairs(spark, sf):
    t = texts(spark, sf)
    cand = R.cluster_candidates(T.corpus_vectors(spark, sf), _centroids(spark, sf), TOPK * OVERSAMPLE).join(
        t.select("paper_id"), "paper_id")
    prof = G.profile_text(G.gather_samples(_samples(spark, sf)))
    j = cand.join(prof, "cluster_id").join(t, "paper_id")   # profiles: one row per cluster
    return j.select("cluster_id", "paper_id", F.md5("profile_text").alias("profile_md5"),
                    F.md5("text").alias("cand_md5"))


def _ranked_far(spark, sf):
    cents = _clusters_with_far(spark, sf)
    a = knn.assign_nearest(T.corpus_vectors(spark, sf), cents)
    top = knn.top_per_group(a, ["cluster_id"], [F.round("distance", 9), F.col("paper_id")], TOPK)
    return cents, top.withColumn("score", _r6(-F.col("distance")))


_ASSIGN_FAR = ASSIGN.replace("FROM cor c, cent k", "FROM cor c, kf k")
_RANKED_FAR = (f"ranked AS (SELECT cluster_id, paper_id, round(-distance, 6) AS score, rank FROM ("
               f"SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round(distance, 9), paper_id) AS rank "
               f"FROM ({_ASSIGN_FAR})) WHERE rank <= {TOPK})")


@register("result_nested", sql=f"""
WITH {_BASE}, cent AS ({CENT}), kf AS ({_CENT_FAR}), {_RANKED_FAR}
SELECT k.cluster_id, CAST(count(r.paper_id) AS INTEGER) AS n_items,
       coalesce(string_agg(CAST(r.paper_id AS VARCHAR) || ':' || printf('%.6f', r.score), ';' ORDER BY r.rank), '') AS items
FROM kf k LEFT JOIN ranked r USING (cluster_id) GROUP BY k.cluster_id
""")
def result_nested(spark, sf):
    cents, ranked = _ranked_far(spark, sf)
    nested = G.nest_results(cents, ranked, ["paper_id", "score"])
    item = lambda x: F.concat(x["paper_id"].cast("string"), F.lit(":"), F.format_string("%.6f", x["score"]))
    return nested.select("cluster_id", F.size("items").alias("n_items"),
                         F.array_join(F.transform("items", item), ";").alias("items"))


_AUTH_JOINED_SQL = f"SELECT conv_id AS paper_id, array_to_string(authors, ', ') AS authors FROM ({_AUTHORS_SQL})"


@register("report_rows", sql=f"""
WITH {_BASE}, cent AS ({CENT}), kf AS ({_CENT_FAR}), s AS ({SAMPLES}), lab AS ({_LABELS_SQL}),
lbl AS ({_LABEL_DEFAULT_SQL}), {_RANKED_FAR}, au AS ({_AUTH_JOINED_SQL}),
items AS (SELECT r.cluster_id, CAST(r.rank AS INTEGER) AS line_no,
  '<li><a href="https://arxiv.org/abs/' || CAST(r.paper_id AS VARCHAR) || '" target="_blank">' || p.title
  || '</a><br><small><i>' || coalesce(au.authors, '') || '</i> [' || p.lang || ']</small> – score '
  || printf('%.3f', round(r.score, 3)) || '</li>' AS line
  FROM ranked r JOIN papers p USING (paper_id) LEFT JOIN au USING (paper_id))
SELECT cluster_id, 0 AS line_no, '<h2>' || label || '</h2><ol>' AS line FROM lbl
UNION ALL SELECT * FROM items
UNION ALL SELECT l.cluster_id, CAST(coalesce(max(i.line_no), 0) + 1 AS INTEGER), '</ol>' FROM lbl l
  LEFT JOIN items i USING (cluster_id) GROUP BY l.cluster_id
""")
def report_rows(spark, sf):
    from ..sinks import report_lines
    cents, ranked = _ranked_far(spark, sf)
    labels = G.attach_labels(cents.select("cluster_id"), _labels(spark, sf))
    au = authors(spark, sf).select(F.col("conv_id").alias("paper_id"), "authors")
    papers = T.papers(spark, sf).select("paper_id", "title", F.col("lang").alias("category")).join(au, "paper_id", "left")
    return report_lines(labels, ranked.join(papers, "paper_id"))


_FLAT_SQL = f"""
WITH {_BASE}, prof AS ({PROFILE}), {IDF},
d AS (SELECT c.paper_id, {l2('c.vector', 'p.vector')} AS distance FROM cor c, prof p),
cand AS (SELECT 0 AS group_id, k.* FROM (SELECT paper_id, distance, row_number() OVER (ORDER BY round(distance, 9), paper_id) AS crank
         FROM d) k JOIN pt USING (paper_id) WHERE k.crank <= {TOPK * OVERSAMPLE}),
ptf AS (SELECT g AS group_id, term, count(*) AS tf FROM ({tok('(SELECT t.text FROM lib l JOIN pt t ON t.paper_id = l.entry_id)', '0 AS g')}) GROUP BY g, term),
pw AS ({weights('ptf', 'group_id')}),
ctf AS (SELECT paper_id, term, count(*) AS tf FROM ({tok('(SELECT * FROM pt WHERE paper_id IN (SELECT paper_id FROM cand))', 'paper_id')}) GROUP BY paper_id, term),
cw AS ({weights('ctf', 'paper_id')}),
prs AS (SELECT group_id, paper_id FROM cand),
{cosine('pw', 'cw', 'prs', 'group_id', 'paper_id')},
fin AS (SELECT s.paper_id, s.score, c.distance, row_number() OVER (ORDER BY round(s.score, 9) DESC, c.crank) AS rank
        FROM scored s JOIN cand c USING (paper_id))
SELECT CAST(rank AS INTEGER) AS rank, paper_id, round(score, 6) AS score, round(distance, 6) AS distance FROM fin WHERE rank <= {TOPK}
"""


@register("recommend_flat", sql=_FLAT_SQL)
def recommend_flat(spark, sf):
    r = R.recommend_flat(T.library_vectors(spark, sf), texts(spark, sf), T.corpus_vectors(spark, sf),
                         texts(spark, sf), collection(spark, sf), topk=TOPK, oversample=OVERSAMPLE)
    return r.select("rank", "paper_id", _r6("score").alias("score"), _r6("distance").alias("distance"))


_CLUSTERED_SQL = f"""
WITH {_BASE}, cent AS ({CENT}), a AS ({ASSIGN}), {_CAND_SQL}, s AS ({SAMPLES}), {IDF},
ptf AS (SELECT cluster_id, term, count(*) AS tf FROM ({tok('s', 'cluster_id')}) GROUP BY cluster_id, term),
pw AS ({weights('ptf', 'cluster_id')}),
ctf AS (SELECT paper_id, term, count(*) AS tf FROM ({tok('(SELECT * FROM pt WHERE paper_id IN (SELECT paper_id FROM cand))', 'paper_id')}) GROUP BY paper_id, term),
cw AS ({weights('ctf', 'paper_id')}),
prs AS (SELECT cluster_id, paper_id FROM cand),
{cosine('pw', 'cw', 'prs', 'cluster_id', 'paper_id')},
fin AS (SELECT s.cluster_id, s.paper_id, s.score, c.distance,
        row_number() OVER (PARTITION BY s.cluster_id ORDER BY round(s.score, 9) DESC, c.crank) AS rank
        FROM scored s JOIN cand c USING (cluster_id, paper_id))
SELECT cluster_id, CAST(rank AS INTEGER) AS rank, paper_id, round(score, 6) AS score, round(distance, 6) AS distance
FROM fin WHERE rank <= {TOPK}
"""


@register("recommend_clustered", sql=_CLUSTERED_SQL)
def recommend_clustered(spark, sf):
    r = R.recommend_clustered(T.library_vectors(spark, sf), texts(spark, sf), T.corpus_vectors(spark, sf),
                              texts(spark, sf), collection(spark, sf), topk=TOPK, oversample=OVERSAMPLE)
    return r.select("cluster_id", "rank", "paper_id", _r6("score").alias("score"), _r6("distance").alias("distance"))


@register("cache_split", sql="""
SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'hit' ELSE 'miss' END AS status
FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 0) l USING (doc_id)
""")
def cache_split(spark, sf):
    req = T.read(spark, sf, "documents").select("doc_id")
    hits, misses = C.split_cache(req, T.read(spark, sf, "labels"), ["doc_id"], valid=F.col("toxic") == 0)
    return hits.select("doc_id", F.lit("hit").alias("status")).unionByName(
        misses.select("doc_id", F.lit("miss").alias("status")))


@register("cache_upsert", sql="""
WITH new AS (SELECT d.doc_id, CASE WHEN d.n_chars >= 1000 THEN 1 ELSE 0 END AS quality, 0 AS toxic
             FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0))
SELECT doc_id, quality, toxic, 'old' AS origin FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM new)
UNION ALL SELECT doc_id, quality, toxic, 'new' AS origin FROM new
""")
def cache_upsert(spark, sf):
    d = T.read(spark, sf, "documents")
    lab = T.read(spark, sf, "labels")
    _, misses = C.split_cache(d.select("doc_id", "n_chars"), lab, ["doc_id"], valid=F.col("toxic") == 0)
    new = misses.select("doc_id", F.when(F.col("n_chars") >= 1000, 1).otherwise(0).cast("int").alias("quality"),
                        F.lit(0).cast("int").alias("toxic"), F.lit("new").alias("origin"))
    old = lab.select("doc_id", "quality", "toxic", F.lit("old").alias("origin"))
    return C.upsert(old, new, ["doc_id"])


@register("explain_cache", sql=f"""
WITH papers AS ({PAPERS}),
req AS (SELECT paper_id, substr(md5('{EXPLAIN_MODEL}' || '-' || lang), 1, 8) AS config_hash, abstract FROM papers),
cache AS (SELECT p.paper_id, substr(md5('{EXPLAIN_MODEL}' || '-' || p.lang), 1, 8) AS config_hash, p.title AS explanation
          FROM labels l JOIN papers p ON p.paper_id = l.doc_id WHERE l.quality = 1),
gen AS (SELECT r.paper_id, r.config_hash, nullif(split_part({_sql_strip("coalesce(r.abstract, '')")}, chr(10), 1), '') AS explanation
        FROM req r ANTI JOIN cache c USING (paper_id, config_hash))
SELECT r.paper_id, r.config_hash, 'cache' AS origin, md5(c.explanation) AS explanation_md5
FROM req r JOIN cache c USING (paper_id, config_hash)
UNION ALL SELECT paper_id, config_hash, CASE WHEN explanation IS NULL THEN 'none' ELSE 'generated' END,
       md5(explanation) FROM gen
""")
def explain_cache(spark, sf):
    p = T.papers(spark, sf)
    req = p.select("paper_id", I.config_hash(F.lit(EXPLAIN_MODEL), "lang").alias("config_hash"), "abstract")
    cached = (T.read(spark, sf, "labels").filter(F.col("quality") == 1).select(F.col("doc_id").alias("paper_id"))
              .join(p, "paper_id").select("paper_id", I.config_hash(F.lit(EXPLAIN_MODEL), "lang").alias("config_hash"),
                                         F.col("title").alias("explanation")))
    hits, misses = C.split_cache(req, cached, ["paper_id", "config_hash"])
    gen = misses.select("paper_id", "config_hash", X.label_clean(F.coalesce(F.col("abstract"), F.lit(""))).alias("explanation"))
    return hits.select("paper_id", "config_hash", F.lit("cache").alias("origin"), F.md5("explanation").alias("explanation_md5")
                       ).unionByName(gen.select("paper_id", "config_hash",
                                                F.when(F.col("explanation").isNull(), "none").otherwise("generated").alias("origin"),
                                                F.md5("explanation").alias("explanation_md5")))


@register("lookup_ids", sql=f"""
WITH papers AS ({PAPERS}),
req AS (SELECT doc_id AS paper_id FROM labels UNION SELECT doc_id + {MISSING_ID_OFFSET} FROM labels)
SELECT r.paper_id, p.paper_id IS NOT NULL AS found, p.title FROM req r LEFT JOIN papers p USING (paper_id)
""")
def lookup_ids(spark, sf):
    lab = T.read(spark, sf, "labels")
    ids = lab.select(F.col("doc_id").alias("paper_id")).unionByName(
        lab.select((F.col("doc_id") + MISSING_ID_OFFSET).alias("paper_id")))
    found, missing = _lookup_ids(T.papers(spark, sf).select("paper_id", "title"), ids)
    return found.select("paper_id", F.lit(True).alias("found"), "title").unionByName(
        missing.select("paper_id", F.lit(False).alias("found"), F.lit(None).cast("string").alias("title")))


_RERANK_SQL = f"""
WITH {IDF},
ptf AS (SELECT g AS group_id, term, count(*) AS tf FROM ({tok('benchmark', '0 AS g')}) GROUP BY g, term),
pw AS ({weights('ptf', 'group_id')}),
cw AS ({weights('dtf', 'doc_id')}),
prs AS (SELECT 0 AS group_id, doc_id FROM documents),
{cosine('pw', 'cw', 'prs', 'group_id', 'doc_id')}"""


def _rerank_scores(spark, sf):
    docs = collection(spark, sf)
    prof = T.read(spark, sf, "benchmark").select(F.lit(0).alias("group_id"), "text")
    prs = docs.select(F.lit(0).alias("group_id"), F.col("doc_id").alias("cand_id"))
    cand = docs.select(F.col("doc_id").alias("cand_id"), "text")
    return LX.rerank_lexical(prs, prof, cand, docs, "group_id", "cand_id").select(
        F.col("cand_id").alias("doc_id"), "score")


@register("rerank_lexical", sql=_RERANK_SQL + "\nSELECT doc_id, round(score, 6) AS score FROM scored")
def rerank_lexical(spark, sf):
    return _rerank_scores(spark, sf).select("doc_id", _r6(S.clamp_score(F.col("score").cast("string"))).alias("score"))


RERANK_K = 20


@register("rerank_topk", sql=_RERANK_SQL + f"""
SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank, doc_id,
  round(score, 6) AS score FROM scored) WHERE rank <= {RERANK_K}
""")
def rerank_topk(spark, sf):
    s = _rerank_scores(spark, sf)
    top = knn.top_overall(s, [F.round("score", 9).desc(), F.col("doc_id")], RERANK_K)
    return top.select("rank", "doc_id", _r6("score").alias("score"))


@register("label_terms", sql=f"""
WITH {_BASE}, s AS ({SAMPLES}),
ctf AS (SELECT cluster_id, term, count(*) AS tf FROM ({tok('s', 'cluster_id')}) GROUP BY cluster_id, term),
g AS (SELECT term, count(*) AS gdf FROM ctf GROUP BY term),
w AS (SELECT c.cluster_id, c.term, c.tf * (ln((1 + (SELECT count(DISTINCT cluster_id) FROM s)) / (1 + g.gdf)) + 1) AS w
      FROM ctf c JOIN g USING (term)),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round(w, 9) DESC, term) AS r FROM w)
SELECT cluster_id, string_agg(term, ' ' ORDER BY r) AS label FROM r WHERE r <= 3 GROUP BY cluster_id
""")
def label_terms(spark, sf):
    s = _samples(spark, sf).select("cluster_id", "text")
    return LX.top_terms(s, "cluster_id", 3)


_EXTRACT_SQL = f"""{IDF},
lines AS (SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos,
          unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM docs),
lt AS ({tok('lines', 'doc_id, pos', 'line')}),
sc AS (SELECT lt.doc_id, lt.pos, avg(coalesce(i.idf, {UNSEEN})) AS score FROM lt LEFT JOIN idf i USING (term) GROUP BY lt.doc_id, lt.pos),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, pos) AS r FROM sc),
ex AS (SELECT rk.doc_id, string_agg(l.line, ' ' ORDER BY rk.pos) AS explanation, CAST(count(*) AS INTEGER) AS n_lines
       FROM rk JOIN lines l USING (doc_id, pos) WHERE rk.r <= 2 GROUP BY rk.doc_id)"""


@register("explain_extractive", sql=f"""
WITH docs AS (SELECT doc_id, text FROM documents), {_EXTRACT_SQL}
SELECT doc_id, md5(explanation) AS explanation_md5, n_lines FROM ex
""")
def explain_extractive(spark, sf):
    docs = collection(spark, sf)
    e = LX.extractive_summary(docs, docs)
    return e.select("doc_id", F.md5("explanation").alias("explanation_md5"), "n_lines")


@register("explain_attach", sql=f"""
WITH {_BASE}, cent AS ({CENT}), a AS ({ASSIGN}),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round(distance, 9), paper_id) AS rank FROM a)
        WHERE rank <= {TOPK}),
docs AS (SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT paper_id FROM top)), {_EXTRACT_SQL}
SELECT t.cluster_id, CAST(t.rank AS INTEGER) AS rank, t.paper_id, md5(ex.explanation) AS explanation_md5
FROM top t LEFT JOIN ex ON ex.doc_id = t.paper_id
""")
def explain_attach(spark, sf):
    top = cut(cluster_candidates(spark, sf, TOPK), "explain-top")           # at most TOPK a cluster, read twice below
    docs = collection(spark, sf)
    ids = top.select(F.col("paper_id").alias("doc_id")).distinct()
    wanted = cut(docs.join(F.broadcast(ids) if is_bounded(ids, DEFAULT_BROADCAST_ROWS) else ids, "doc_id", "left_semi"), "explain-texts")
    ex = LX.extractive_summary(wanted, docs)       # once per distinct recommended id
    j = top.join(ex.withColumnRenamed("doc_id", "paper_id"), "paper_id", "left")
    return j.select("cluster_id", "rank", "paper_id", F.md5("explanation").alias("explanation_md5"))


# ======================================================================= approximate search (rows-only checks)
from ..operators import ann  # noqa: E402

IVF_NLIST, IVF_NPROBE = 16, 4
LSH_BUCKET, LSH_TABLES = 0.125, 8


@register("knn_ivf")
def knn_ivf(spark, sf):
    nn = ann.knn_ivf(T.library_vectors(spark, sf), T.corpus_vectors(spark, sf), K_NEIGHBOURS,
                     nlist=IVF_NLIST, nprobe=IVF_NPROBE, query_id="entry_id", index_id="paper_id")
    return nn.select("query_id", "neighbor_id", _r6("distance").alias("distance"), "rank")


@register("knn_lsh")
def knn_lsh(spark, sf):
    nn = ann.knn_lsh(T.library_vectors(spark, sf), T.corpus_vectors(spark, sf), K_NEIGHBOURS,
                     bucket_length=LSH_BUCKET, num_tables=LSH_TABLES, query_id="entry_id", index_id="paper_id")
    return nn.select("query_id", "neighbor_id", _r6("distance").alias("distance"), "rank")


# ======================================================================= inference, streaming (rows-only checks)
EMBED_DIM = 256


@register("embed_native")
def embed_native(spark, sf):
    e = LX.hashed_embedding(collection(spark, sf), "doc_id", "text", dim=EMBED_DIM)
    from ..functions.vectors import norm2
    return e.select("doc_id", F.size(F.filter("vector", lambda x: x != 0)).alias("n_nonzero"),
                    _r6(norm2("vector")).alias("norm"))


@register("stream_assign", sql=f"""
WITH lib AS ({LIB}), cor AS ({COR}), cent AS ({CENT})
SELECT paper_id, cluster_id, round(distance, 6) AS distance FROM ({ASSIGN})
""")
def stream_assign(spark, sf):
    """Corpus vectors landed as files (with a timestamp from ``events``), scored
    by the streaming job; returns what the stream wrote."""
    import uuid

    from ..session import scratch_path
    from ..streaming.assign_stream import start_assign_stream
    run = scratch_path(spark, f"stream_assign/{uuid.uuid4().hex}")
    ev = T.read(spark, sf, "events").select(F.col("event_id").alias("paper_id"), F.col("ts").alias("published"))
    landed = T.corpus_vectors(spark, sf).join(ev, "paper_id", "left").withColumn(
        "published", F.coalesce(F.col("published"), F.lit("2024-01-01")).cast("timestamp"))
    landed.write.parquet(f"{run}/landing")
    q = start_assign_stream(spark, f"{run}/landing", landed.schema, _centroids(spark, sf),
                            f"{run}/sink", f"{run}/checkpoint")
    q.awaitTermination()
    return spark.read.parquet(f"{run}/sink").select("paper_id", "cluster_id", _r6("distance").alias("distance"))


# ======================================================================= reduction and clustering (rows-only checks)
from ..operators import density as DN  # noqa: E402
from ..operators import reduce as RD  # noqa: E402

# Fixed parameters of the reference's clustering step.
N_COMPONENTS, N_NEIGHBORS, MIN_CLUSTER_SIZE, RANDOM_STATE = 50, 50, 40, 0
LAYOUT_EPOCHS = 30


@register("reduce_pca")
def reduce_pca(spark, sf):
    lib = T.all_vectors(spark, sf)
    r = RD.reduce_pca(lib, N_COMPONENTS, "entry_id")
    return r.select("entry_id", F.size("reduced").alias("dims"), _r6(F.aggregate(
        "reduced", F.lit(0.0), lambda acc, x: acc + x * x)).alias("sq_norm"))


@register("reduce_graph")
def reduce_graph(spark, sf):
    lib = T.all_vectors(spark, sf)
    r = RD.reduce_graph(lib, N_COMPONENTS, N_NEIGHBORS, RANDOM_STATE, n_epochs=LAYOUT_EPOCHS, id_col="entry_id")
    return r.select("entry_id", F.size("reduced").alias("dims"))


# The given vectors hardly cluster; these sizes form several clusters at every scale.
DENSE_SIZE, DENSE_SAMPLES = 5, 3


@register("core_distance", sql=f"""
SELECT id AS entry_id, round(c, 6) AS core FROM (
  WITH RECURSIVE {tree_ctes(DENSE_SAMPLES)} SELECT pts.id, core.c FROM core JOIN pts USING (i))
""")
def core_distance(spark, sf):
    r = DN.core_distances(T.all_vectors(spark, sf), DENSE_SAMPLES, "entry_id")
    return r.select("entry_id", _r6("core").alias("core"))


@register("spanning_tree", sql=f"""
WITH RECURSIVE {tree_ctes(DENSE_SAMPLES)}
SELECT count(w) AS edges, round(sum(w), 6) AS weight, round(max(w), 6) AS heaviest FROM seq
""")
def spanning_tree(spark, sf):
    points = T.all_vectors(spark, sf)
    near, core = DN.neighbours_and_cores(points, DENSE_SAMPLES, "entry_id")
    mst = DN.mutual_reachability_mst(points, core, "entry_id", near=near)
    return mst.agg(F.count("w").alias("edges"), _r6(F.sum("w")).alias("weight"), _r6(F.max("w")).alias("heaviest"))


@register("density_cluster", sql=density_sql(DENSE_SIZE, DENSE_SAMPLES))
def density_cluster(spark, sf):
    return DN.density_cluster(T.all_vectors(spark, sf), DENSE_SIZE, DENSE_SAMPLES, id_col="entry_id")


@register("cluster_pipeline")
def cluster_pipeline(spark, sf):
    from .recommend import cluster_library
    labels, cents = cluster_library(T.all_vectors(spark, sf),
                                    n_components=N_COMPONENTS, n_neighbors=N_NEIGHBORS,
                                    min_cluster_size=MIN_CLUSTER_SIZE, random_state=RANDOM_STATE)
    sizes = labels.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_members"))
    return sizes.join(cents.select("cluster_id", F.size("centroid").alias("dims")), "cluster_id", "left")


# ======================================================================= caches and the daily run
import uuid  # noqa: E402

import pandas as pd  # noqa: E402

from ..operators.store import ResultStore, cached_clusters, cached_results  # noqa: E402
from ..session import scratch_path  # noqa: E402
from .models import Models  # noqa: E402
from .recommend import run_library  # noqa: E402

LETTERS = "etaoinshrd"


def letter_vectors(pdf: pd.DataFrame) -> pd.DataFrame:
    """A model that SQL can repeat: how often each of ten letters stands in a text, per thousand characters."""
    size = pdf["text"].str.len().clip(lower=1)
    return pd.DataFrame({"vector": [[float(t.count(c)) * 1000 / n for c in LETTERS] for t, n in zip(pdf["text"], size)]})


def _letters_sql(text: str) -> str:
    return "[" + ", ".join(f"((length({text}) - length(replace({text}, '{c}', ''))) * 1000.0 / greatest(length({text}), 1))::FLOAT" for c in LETTERS) + "]"


@register("cached_embed", sql=f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
known AS (SELECT DISTINCT text FROM t JOIN labels USING (doc_id))
SELECT doc_id, CASE WHEN k.text IS NULL THEN 'model' ELSE 'cache' END AS first_origin, 'cache' AS second_origin,
       round(list_sum({_letters_sql('t.text')}::DOUBLE[]), 3) AS mass
FROM t LEFT JOIN known k ON k.text = t.text
""")
def cached_embed(spark, sf):
    """Vectors of labelled documents are stored; a run infers the other texts, a second run none."""
    docs = T.read(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = docs.withColumn("key", F.sha2("text", 256))
    store = ResultStore(spark, scratch_path(spark, f"cached-embed/{uuid.uuid4().hex}"), "key string, vector array<float>", ["key"])
    model = Models(embed=letter_vectors, retry={"embed": {"pacing": 0.0}})
    infer = model.run("embed", letter_vectors, ["text"], "vector array<float>", ["key"])
    known = T.read(spark, sf, "labels").select("doc_id").distinct()
    store.append(infer(texts.join(known, "doc_id", "left_semi").dropDuplicates(["key"])))
    first = cut(cached_results(texts, store, infer).select("doc_id", F.col("origin").alias("first_origin")), "first-run")

    def never(rows):
        raise RuntimeError("the second run must not infer")

    second = cached_results(texts, store, never)
    return second.select("doc_id", F.col("origin").alias("second_origin"), F.round(F.aggregate(
        "vector", F.lit(0.0), lambda a, x: a + x.cast("double")), 3).alias("mass")).join(first, "doc_id")


@register("cluster_cache", sql=f"""
WITH lib AS ({LIB}), c AS ({CENT})
SELECT l.entry_id, l.cluster_id, (SELECT count(*) FROM c) AS clusters, false AS first_hit, true AS again_hit, false AS changed_hit FROM lib l
""")
def cluster_cache(spark, sf):
    """A clustering is computed once; the same vectors in another order hit, one changed vector misses."""
    lib = T.library_vectors(spark, sf)
    path = scratch_path(spark, f"cluster-cache/{uuid.uuid4().hex}")

    def given(rows):
        member = rows.join(lib.select("entry_id", "cluster_id"), "entry_id")
        return member.select("entry_id", "cluster_id"), vectors.centroids(member)

    def never(rows):
        raise RuntimeError("an unchanged library must not be clustered again")

    points = lib.select("entry_id", "vector")
    _, _, first = cached_clusters(points, path, given, "labels")
    labels, cents, again = cached_clusters(points.orderBy(F.desc("entry_id")), path, never, "labels")
    least = F.col("entry_id") == points.agg(F.min("entry_id")).first()[0]
    moved = points.withColumn("vector", F.when(least, F.transform("vector", lambda x: x + F.lit(1).cast("float"))).otherwise(F.col("vector")))
    _, _, changed = cached_clusters(moved, path, given, "labels")
    return labels.select("entry_id", "cluster_id", F.lit(cents.count()).alias("clusters"), F.lit(first).alias("first_hit"),
                         F.lit(again).alias("again_hit"), F.lit(changed).alias("changed_hit"))


@register("run_daily", sql=f"""
WITH papers AS ({PAPERS}), pt AS (SELECT paper_id, text FROM ({PTEXT})),
lib AS (SELECT paper_id, {_letters_sql('text')} AS v FROM pt WHERE paper_id % 10 = 0),
cor AS (SELECT 'p' || paper_id AS paper_id, {_letters_sql('text')} AS v FROM pt WHERE paper_id % 10 <> 0),
profile AS (SELECT list(m ORDER BY i) AS v FROM (SELECT i, avg(x) AS m FROM (
  SELECT generate_subscripts(v, 1) AS i, unnest(v)::DOUBLE AS x FROM lib) GROUP BY i)),
d AS (SELECT paper_id, {l2('profile.v', 'cor.v')} AS distance FROM cor, profile),
r AS (SELECT *, row_number() OVER (ORDER BY round(distance, 9), paper_id) AS rank FROM d)
SELECT 0 AS cluster_id, rank::INTEGER AS rank, paper_id, round(-distance, 4) AS score FROM r WHERE rank <= {TOPK}
""")
def daily_run(spark, sf):
    """The run from texts to dated outputs with a user's embedding model, string ids and caches, twice; the second result."""
    texts = T.papers(spark, sf).withColumn("text", X.paper_text("title", "abstract", F.array().cast("array<string>"))).filter("text <> ''")
    lib = texts.filter(T.is_library("paper_id")).select(F.col("paper_id").cast("string").alias("entry_id"), F.col("paper_id").alias("src_pos"), "text")
    papers = texts.filter(~T.is_library("paper_id")).select(
        F.concat(F.lit("p"), F.col("paper_id").cast("string")).alias("paper_id"), "text", "title", F.array("source").alias("authors"),
        F.col("lang").alias("category"))
    base = scratch_path(spark, f"daily-run/{uuid.uuid4().hex}")
    for name in ("first", "second"):
        ranked = run_library(lib, papers, f"{base}/{name}", "2024-01-02", TOPK, cache_dir=f"{base}/cache",
                             models=Models(embed=letter_vectors, retry={"embed": {"pacing": 0.0}}))
    return ranked.select("cluster_id", "rank", "paper_id", F.round("score", 4).alias("score"))
