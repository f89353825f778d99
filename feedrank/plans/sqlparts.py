"""DuckDB SQL fragments for the oracle queries (mirrors of ``sources.tables``)."""

LIB = ("SELECT vec_id AS entry_id, embedding AS vector, "
       "CAST(CASE WHEN label = 9 THEN -1 ELSE label END AS INTEGER) AS cluster_id "
       "FROM embeddings WHERE vec_id % 10 = 0")
COR = "SELECT vec_id AS paper_id, embedding AS vector FROM embeddings WHERE vec_id % 10 <> 0"
PAPERS = ("SELECT doc_id AS paper_id, split_part(coalesce(text, ''), chr(10), 1) AS title, "
          "CASE WHEN strpos(coalesce(text, ''), chr(10)) > 0 "
          "THEN substr(text, strpos(text, chr(10)) + 1) END AS abstract, lang, source, text "
          "FROM documents")
WS = r"[ \t\n\r\f\x0B]"


def l2(a: str, b: str) -> str:
    return (f"list_reduce(list_transform(range(1, len({a}) + 1), lambda i: "
            f"({a}[i]::DOUBLE - {b}[i]::DOUBLE) * ({a}[i]::DOUBLE - {b}[i]::DOUBLE)), lambda x, y: x + y)")


def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, '\\A{WS}+|{WS}+\\z', '', 'g')"


CENT = ("SELECT cluster_id, list(m ORDER BY i) AS centroid, max(n) AS n FROM ("
        " SELECT cluster_id, i, avg(x) AS m, count(*) AS n FROM ("
        "  SELECT cluster_id, generate_subscripts(vector, 1) AS i, unnest(vector)::DOUBLE AS x"
        "  FROM lib WHERE cluster_id <> -1) GROUP BY cluster_id, i) GROUP BY cluster_id")
PROFILE = ("SELECT list(m ORDER BY i) AS vector FROM ("
           " SELECT i, avg(x) AS m FROM ("
           "  SELECT generate_subscripts(vector, 1) AS i, unnest(vector)::DOUBLE AS x FROM lib) GROUP BY i)")
ASSIGN = (f"SELECT paper_id, cluster_id, distance FROM ("
          f" SELECT c.paper_id, k.cluster_id, {l2('c.vector', 'k.centroid')} AS distance,"
          f"  row_number() OVER (PARTITION BY c.paper_id ORDER BY round({l2('c.vector', 'k.centroid')}, 9),"
          f"  k.cluster_id) AS rn FROM cor c, cent k) WHERE rn = 1")


def tok(src: str, keys: str, text: str = "text") -> str:
    """Token rows ``(keys..., term)`` of a text column (same rule as functions.tokens)."""
    return (f"SELECT {keys}, unnest(list_filter(regexp_split_to_array(lower(coalesce({text}, '')), "
            f"'[^\\p{{L}}]+'), lambda t: t <> '')) AS term FROM {src}")


PTEXT = ("SELECT paper_id, text FROM (SELECT paper_id, "
         + strip_ws("concat_ws(chr(10), nullif(title, ''), nullif(abstract, ''))")
         + " AS text FROM papers) WHERE text <> ''")

IDF = (f"dtf AS (SELECT doc_id, term, count(*) AS tf FROM ({tok('documents', 'doc_id')}) GROUP BY doc_id, term),\n"
       "ndoc AS (SELECT count(DISTINCT doc_id) AS n FROM documents),\n"
       "idf AS (SELECT term, ln((1 + (SELECT n FROM ndoc)) / (1 + count(*))) + 1 AS idf FROM dtf GROUP BY term)")
UNSEEN = "(ln(1 + (SELECT n FROM ndoc)) + 1)"


def weights(tf: str, key: str) -> str:
    return (f"SELECT t.{key}, t.term, t.tf * coalesce(i.idf, {UNSEEN}) AS w "
            f"FROM {tf} t LEFT JOIN idf i ON i.term = t.term")


def cosine(pw: str, cw: str, pairs: str, group: str, cand: str) -> str:
    """CTEs ending in ``scored(pairs.*, score)``."""
    return f"""pn AS (SELECT {group}, sqrt(sum(w * w)) AS pn FROM {pw} GROUP BY {group}),
cn AS (SELECT {cand}, sqrt(sum(w * w)) AS cn FROM {cw} GROUP BY {cand}),
dots AS (SELECT pr.{group}, pr.{cand}, sum(c.w * p.w) AS dot FROM {pairs} pr
         JOIN {cw} c ON c.{cand} = pr.{cand} JOIN {pw} p ON p.{group} = pr.{group} AND p.term = c.term
         GROUP BY pr.{group}, pr.{cand}),
scored AS (SELECT pr.*, CASE WHEN pn.pn > 0 AND cn.cn > 0 THEN coalesce(d.dot, 0) / (pn.pn * cn.cn) ELSE 0.0 END AS score
           FROM {pairs} pr LEFT JOIN dots d ON d.{group} = pr.{group} AND d.{cand} = pr.{cand}
           LEFT JOIN pn ON pn.{group} = pr.{group} LEFT JOIN cn ON cn.{cand} = pr.{cand})"""


SAMPLES = ("SELECT * FROM (SELECT l.cluster_id, l.entry_id, t.text, row_number() OVER "
           "(PARTITION BY l.cluster_id ORDER BY l.entry_id) AS sr FROM lib l JOIN pt t ON t.paper_id = l.entry_id "
           "WHERE l.cluster_id <> -1) WHERE sr <= 8")


# Mutual reachability of all vectors and its spanning tree in Prim's order: ``seq (pos, node, w)``, w the edge to an
# earlier node.  Cutting the order where w >= e gives the components of the edges lighter than e.
def tree_ctes(min_samples: int) -> str:
    return f"""pts AS (SELECT row_number() OVER (ORDER BY vec_id) AS i, vec_id AS id, embedding AS v FROM embeddings),
d AS (SELECT a.i, b.i AS j, sqrt({l2('a.v', 'b.v')}) AS d FROM pts a, pts b),
core AS (SELECT i, list_sort(list(d))[{min_samples}] AS c FROM d GROUP BY i),
m AS (SELECT d.i, list(CASE WHEN d.i <> d.j THEN greatest(d.d, a.c, b.c) END ORDER BY d.j) AS w
      FROM d JOIN core a ON a.i = d.i JOIN core b ON b.i = d.j GROUP BY d.i),
prim AS (
  SELECT 1::BIGINT AS pos, 1::BIGINT AS node, NULL::DOUBLE AS w, m.w AS best FROM m WHERE i = 1
  UNION ALL
  SELECT pos + 1, pick, least, list_transform(range(1, len(best) + 1), lambda k:
           CASE WHEN best[k] IS NOT NULL AND k <> pick THEN least(best[k], m.w[k]) END)
  FROM (SELECT *, list_min(best) AS least, list_position(best, list_min(best))::BIGINT AS pick FROM prim) p
  JOIN m ON m.i = p.pick WHERE pos < len(best)),
seq AS (SELECT pos, node, w FROM prim)"""


def density_sql(min_cluster_size: int, min_samples: int) -> str:
    """Density labels: components at every weight, the condensed tree of those that are large enough, excess of mass."""
    return f"""
WITH RECURSIVE {tree_ctes(min_samples)},
lv AS (SELECT row_number() OVER (ORDER BY w DESC) AS level, w AS e FROM (SELECT DISTINCT w FROM seq WHERE w IS NOT NULL)
       UNION ALL SELECT 0, 'Infinity'::DOUBLE),
lam AS (SELECT level, CASE WHEN level = 0 THEN 0 ELSE 1 / greatest(e, 1e-12) END AS lam FROM lv),
cell AS (SELECT level, pos, max(CASE WHEN w IS NULL OR w >= e THEN pos END) OVER (PARTITION BY level ORDER BY pos) AS start FROM lv, seq),
big AS (SELECT level, start FROM cell GROUP BY ALL HAVING count(*) >= {min_cluster_size}),
bigp AS (SELECT b.level, b.start, count(*) OVER (PARTITION BY b.level, c.start) AS siblings
         FROM big b LEFT JOIN cell c ON c.level = b.level - 1 AND c.pos = b.start),
live AS (SELECT c.level, c.pos, max(CASE WHEN c.level = 0 OR siblings <> 1 THEN {{'b': c.level, 's': c.start}} END)
                OVER (PARTITION BY c.pos ORDER BY c.level) AS cid
         FROM cell c JOIN bigp b ON b.level = c.level AND b.start = c.start),
member AS (SELECT pos, cid, max(level) + 1 AS gone FROM live GROUP BY pos, cid),
stab AS (SELECT cid, sum(x.lam - y.lam) AS stab, min(pts.id) AS least
         FROM member JOIN lam x ON x.level = gone JOIN lam y ON y.level = cid.b JOIN seq USING (pos) JOIN pts ON pts.i = seq.node GROUP BY cid),
cl AS (SELECT s.*, l.cid AS pcid, row_number() OVER (ORDER BY s.cid.b DESC, s.cid.s) AS k
       FROM stab s LEFT JOIN live l ON l.level = s.cid.b - 1 AND l.pos = s.cid.s),
kid AS (SELECT p.k, p.stab, p.pcid, list(c.k) FILTER (c.k IS NOT NULL) AS kids FROM cl p LEFT JOIN cl c ON c.pcid = p.cid GROUP BY p.k, p.stab, p.pcid),
eom AS (
  SELECT 0::BIGINT AS k, []::DOUBLE[] AS best, []::BOOLEAN[] AS sel
  UNION ALL
  SELECT n.k, list_append(best, greatest(stab, kmass)), list_append(sel, pcid IS NOT NULL AND stab >= kmass)
  FROM (SELECT kid.*, best, sel, coalesce(list_sum(list_transform(kids, lambda x: best[x])), 0.0) AS kmass
        FROM eom JOIN kid ON kid.k = eom.k + 1) n),
picked AS (SELECT cl.cid, cl.least FROM cl, (SELECT sel FROM eom ORDER BY k DESC LIMIT 1) WHERE sel[cl.k]),
topmost AS (SELECT cid, least FROM picked p WHERE NOT EXISTS (
              SELECT 1 FROM member mp JOIN picked q ON q.cid = mp.cid WHERE mp.pos = p.cid.s AND q.cid.b < p.cid.b)),
numbered AS (SELECT cid, row_number() OVER (ORDER BY least) - 1 AS n FROM topmost),
found AS (SELECT pos, n FROM member JOIN numbered USING (cid))
SELECT pts.id AS entry_id, coalesce(n, -1)::INTEGER AS cluster_id
FROM seq JOIN pts ON pts.i = seq.node LEFT JOIN found USING (pos)"""
