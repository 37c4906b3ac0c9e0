"""The results of factloom.plans.queries in DuckDB SQL."""

from __future__ import annotations

BASE = """
WITH facts AS (
  SELECT 'placedBy' AS p, 'order/' || o_orderkey AS s, 'customer/' || o_custkey AS o FROM orders
  UNION SELECT 'hasPart', 'order/' || l_orderkey, 'part/' || l_partkey FROM lineitem
  UNION SELECT 'shippedBy', 'order/' || l_orderkey, 'supplier/' || l_suppkey FROM lineitem
  UNION SELECT 'suppliedBy', 'part/' || l_partkey, 'supplier/' || l_suppkey FROM lineitem
  UNION SELECT 'custNation', 'customer/' || c_custkey, 'nation/' || c_nationkey FROM customer
  UNION SELECT 'suppNation', 'supplier/' || s_suppkey, 'nation/' || s_nationkey FROM supplier
  UNION SELECT 'inRegion', 'nation/' || n_nationkey, 'region/' || n_regionkey FROM nation
), types AS (
  SELECT 'order/' || o_orderkey AS e, 'Order' AS t FROM orders UNION ALL SELECT 'order/' || o_orderkey, 'Order:' || o_orderstatus FROM orders
  UNION ALL SELECT 'customer/' || c_custkey, 'Customer' FROM customer UNION ALL SELECT 'customer/' || c_custkey, 'Customer:' || c_mktsegment FROM customer
  UNION ALL SELECT 'part/' || p_partkey, 'Part' FROM part UNION ALL SELECT 'part/' || p_partkey, 'Part:' || p_type FROM part
  UNION ALL SELECT 'supplier/' || s_suppkey, 'Supplier' FROM supplier
  UNION ALL SELECT 'nation/' || n_nationkey, 'Nation' FROM nation
  UNION ALL SELECT 'region/' || r_regionkey, 'Region' FROM region
), tset AS (
  SELECT e, list_sort(list(DISTINCT t)) AS ts FROM types GROUP BY e
), subclass AS (
  SELECT DISTINCT t AS child, CASE WHEN t LIKE '%:%' THEN split_part(t, ':', 1) ELSE 'Thing' END AS parent FROM types
), up AS (
  SELECT child, parent FROM subclass UNION SELECT child, 'Thing' FROM subclass
), ends AS (
  SELECT * FROM (VALUES ('placedBy', 'Order', 'Customer'), ('hasPart', 'Order', 'Part'), ('shippedBy', 'Order', 'Supplier'), ('suppliedBy', 'Part', 'Supplier'),
    ('custNation', 'Customer', 'Nation'), ('suppNation', 'Supplier', 'Nation'), ('inRegion', 'Nation', 'Region')) AS x(p, d, r)
)"""
SCORES = """
, w AS (SELECT p, t, count(*) / (SELECT count(*) FROM facts)::DOUBLE AS w FROM facts JOIN types ON o = e GROUP BY p, t)
, norm AS (SELECT p, sqrt(sum(w * w)) AS norm FROM w GROUP BY p)
, scores AS (
  SELECT f.p, f.s, f.o, round(sum(w.w) / (sqrt(count(*)) * any_value(norm.norm)), 9) AS score
  FROM facts f JOIN types t ON f.o = t.e JOIN w ON w.p = f.p AND w.t = t.t JOIN norm ON norm.p = f.p GROUP BY f.p, f.s, f.o
)"""


def h(seed: int, *parts: str) -> str:
    """The hash that sampling uses."""
    return f"('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(parts)})), 1, 8))::BIGINT"


JUDGED = (
    SCORES
    + f"""
, judged AS (SELECT *, {h(9, "p", "s", "o")} % 50 = 0 AS is_error FROM scores)
, ranks AS (SELECT *, row_number() OVER (ORDER BY score, p, s, o) AS rank FROM judged)
, eranks AS (SELECT p, s, o, rank, rank - row_number() OVER (ORDER BY rank) + 1 AS filtered_rank FROM ranks WHERE is_error)
, cv AS (
  SELECT score, count(*) FILTER (WHERE is_error) AS pos, count(*) FILTER (WHERE NOT is_error) AS neg FROM judged GROUP BY score
), cum AS (
  SELECT *, sum(pos) OVER (ORDER BY score) AS tp, sum(neg) OVER (ORDER BY score) AS fp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM cv
)"""
)
POSITIVES = f"""
, pos AS (
  SELECT p, s, o FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY {h(42, "p", "s", "o")}, s, o) AS k FROM facts) WHERE k <= 300
)"""
EXAMPLES = (
    POSITIVES
    + f"""
, pool AS (
  SELECT p, e, row_number() OVER (PARTITION BY p ORDER BY e) - 1 AS i, count(*) OVER (PARTITION BY p) AS n
  FROM (SELECT p, s AS e FROM pos UNION SELECT p, o FROM pos)
), draw AS (
  SELECT a.p, a.s, a.o, {h(43, "a.p", "a.s", "a.o", "1")} % 2 AS coin, {h(44, "a.p", "a.s", "a.o", "1")} % b.n AS i
  FROM pos a JOIN (SELECT p, max(n) AS n FROM pool GROUP BY p) b ON a.p = b.p
), neg AS (
  SELECT DISTINCT d.p, CASE WHEN coin = 0 THEN x.e ELSE d.s END AS s, CASE WHEN coin = 0 THEN d.o ELSE x.e END AS o FROM draw d JOIN pool x ON x.p = d.p AND x.i = d.i
), ex AS (
  SELECT p, s, o, 1 AS label FROM pos UNION ALL SELECT n.p, n.s, n.o, 0 FROM neg n LEFT JOIN facts f ON n.p = f.p AND n.s = f.s AND n.o = f.o WHERE f.p IS NULL
), cnt AS (
  SELECT p, count(*)::DOUBLE AS n, sum(label)::DOUBLE AS n1 FROM ex GROUP BY p
), ff AS (
  SELECT ex.p, label, 's:' || t AS feature FROM ex JOIN types ON s = e UNION ALL SELECT ex.p, label, 'o:' || t FROM ex JOIN types ON o = e
), fc AS (
  SELECT ff.p, feature, count(*)::DOUBLE AS f, sum(label)::DOUBLE AS f1, any_value(n) AS n, any_value(n1) AS n1 FROM ff JOIN cnt ON ff.p = cnt.p GROUP BY ff.p, feature
), fs AS (
  SELECT p, feature, round(
      coalesce((f1 - f * n1 / n) ^ 2 / nullif(f * n1 / n, 0), 0) + coalesce((f - f1 - f * (n - n1) / n) ^ 2 / nullif(f * (n - n1) / n, 0), 0), 9) AS chi2,
    round(CASE WHEN f1 > 0 THEN f1 / n * ln(f1 * n / (f * n1)) ELSE 0 END + CASE WHEN f - f1 > 0 THEN (f - f1) / n * ln((f - f1) * n / (f * (n - n1))) ELSE 0 END
      + CASE WHEN n1 - f1 > 0 THEN (n1 - f1) / n * ln((n1 - f1) * n / ((n - f) * n1)) ELSE 0 END
      + CASE WHEN n - f - n1 + f1 > 0 THEN (n - f - n1 + f1) / n * ln((n - f - n1 + f1) * n / ((n - f) * (n - n1))) ELSE 0 END, 9) AS mi
  FROM fc
)"""
)


def errors(kind: int) -> str:
    if kind == 1:
        pool = f"SELECT e, row_number() OVER (ORDER BY {h(42, 'e')}, e) - 1 AS i FROM tset"
        number, on = "(SELECT count(*) FROM tset)", "x.i = d.i"
    else:
        pool = "SELECT e, ts, row_number() OVER (PARTITION BY ts ORDER BY e) - 1 AS i FROM tset"
        number, on = "n_same", "x.i = d.i AND x.ts = d.ts"
    return f"""
, picked AS (
  SELECT p, s, o, coin, CASE WHEN coin = 0 THEN s ELSE o END AS e
  FROM (SELECT *, {h(43, "p", "s", "o")} % 2 AS coin FROM facts WHERE {h(42, "p", "s", "o")} < {int(0.01 * 2**32)})
), sized AS (
  SELECT k.*, t.ts, g.n_same FROM picked k JOIN tset t ON k.e = t.e JOIN (SELECT ts, count(*) AS n_same FROM tset GROUP BY ts HAVING count(*) > 1) g ON g.ts = t.ts
), d AS (
  SELECT z.*, y.try, {h(44, "p", "s", "o", "y.try")} % {number} AS i FROM sized z, (SELECT unnest(range(4)) AS try) y
), pool2 AS ({pool}
), made AS (
  SELECT d.p, CASE WHEN coin = 0 THEN x.e ELSE d.s END AS s2, CASE WHEN coin = 0 THEN d.o ELSE x.e END AS o2, d.s, d.o, try FROM d JOIN pool2 x ON {on} WHERE x.e <> d.e
), legal AS (
  SELECT m.* FROM made m ANTI JOIN facts f ON m.p = f.p AND m.s2 = f.s AND m.o2 = f.o
), errs AS (
  SELECT DISTINCT p, s2 AS s, o2 AS o FROM (SELECT *, row_number() OVER (PARTITION BY p, s, o ORDER BY try) AS k FROM legal) WHERE k = 1
)"""


def hop(a: str, b: str) -> str:
    side = lambda r, x: (f"(SELECT s, o FROM facts WHERE p = '{r}')" if r[0] != "^" else f"(SELECT o AS s, s AS o FROM facts WHERE p = '{r[1:]}')") + f" {x}"
    return f"SELECT DISTINCT '{a}/{b}' AS path, a.s, b.o FROM {side(a, 'a')} JOIN {side(b, 'b')} ON a.o = b.s"


HOPS = ", hops AS (" + " UNION ALL ".join(hop(a, b) for a, b in (("custNation", "inRegion"), ("placedBy", "custNation"), ("suppNation", "inRegion"), ("^hasPart", "placedBy"))) + ")"
INDUCED = """
, de AS (SELECT DISTINCT p, s AS e, 's' AS "end" FROM facts UNION ALL SELECT DISTINCT p, o, 'o' FROM facts)
, den AS (SELECT p, "end", count(*) AS n FROM de GROUP BY p, "end")
, cov AS (SELECT de.p, de."end", t, count(*) AS k FROM de JOIN types ON de.e = types.e GROUP BY de.p, de."end", t)
, ind AS (
  SELECT p, t, prob, "end" FROM (
    SELECT cov.p, cov.t, k / n::DOUBLE AS prob, cov."end", row_number() OVER (PARTITION BY cov.p, cov."end" ORDER BY inst, cov.t) AS r
    FROM cov JOIN den ON den.p = cov.p AND den."end" = cov."end" JOIN (SELECT t, count(*) AS inst FROM types GROUP BY t) i ON i.t = cov.t WHERE k / n::DOUBLE > 0.95
  ) WHERE r = 1
)"""
TOKENS = """
WITH tok AS (SELECT DISTINCT e, unnest(regexp_extract_all(regexp_replace(lower(name), '_?\\(.*\\)', '', 'g'), '[a-z]+')) AS token FROM ({}))
"""
PARTS = TOKENS.format("SELECT p_partkey AS e, p_name AS name FROM part")
VECTORS = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
x AS (SELECT a.vec_id, a.v AS s, b.v AS r, c.v AS o FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 JOIN v c ON c.vec_id = a.vec_id + 2)
"""
LINKS = """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
c AS (
  SELECT a.vec_id AS q, b.vec_id AS answer, round(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])), 6) AS score,
    b.vec_id = min(CASE WHEN b.vec_id > a.vec_id THEN b.vec_id END) OVER (PARTITION BY a.vec_id) AS is_true
  FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
), r AS (
  SELECT t.q, t.answer, 1 + count(*) FILTER (WHERE c.score > t.score) AS rank, 1 + count(*) FILTER (WHERE c.score > t.score AND NOT c.is_true AND c.answer % 3 <> 0) AS filtered_rank
  FROM c t JOIN c ON t.q = c.q WHERE t.is_true GROUP BY t.q, t.answer
)
"""


def sum_over(n: int, term: str) -> str:
    return f"list_sum(list_transform(range({n}), lambda i: {term}))"


def through(vec: str, width: int = 8) -> str:
    """Element j of a vector times the matrix in r, as SQL of the loop variable i."""
    return " + ".join(f"{vec}[{k + 1}] * r[{width * k} + i + 1]" for k in range(width))


def exact_errors() -> str:
    """errors(1) of the floor(n * 0.01) facts of least hash."""
    drawn = f"WHERE {h(42, 'p', 's', 'o')} < {int(0.01 * 2**32)}"
    return errors(1).replace(drawn, f"QUALIFY row_number() OVER (ORDER BY {h(42, 'p', 's', 'o')}, p, s, o) <= floor((SELECT count(*) FROM facts) * 0.01)")


HALF = f", half AS (SELECT * FROM facts WHERE {h(5, 'p', 's', 'o')} % 2 = 0), other AS (SELECT * FROM facts WHERE {h(5, 'p', 's', 'o')} % 2 = 1)"
NEW = """
, w AS (SELECT p, t, count(*) / (SELECT count(*) FROM half)::DOUBLE AS w FROM half JOIN types ON o = e GROUP BY p, t)
, norm AS (SELECT p, sqrt(sum(w * w)) AS norm FROM w GROUP BY p)
SELECT f.p, f.s, f.o, coalesce(round(sum(w.w) / (sqrt(count(*)) * any_value(norm.norm)), 9), 0.0::DOUBLE) AS score
FROM other f LEFT JOIN types t ON f.o = t.e LEFT JOIN w ON w.p = f.p AND w.t = t.t LEFT JOIN norm ON norm.p = f.p GROUP BY f.p, f.s, f.o"""
ASKED = "WITH v AS (SELECT vec_id AS e, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), q AS (SELECT e AS q, v AS vec FROM v WHERE e % 20 = 0)"
NOISY = errors(1) + ", noisyf AS (SELECT p, s, o FROM facts UNION ALL SELECT p, s, o FROM errs)" + SCORES.replace("facts", "noisyf")


def path_rows() -> str:
    """The pairs of followed_paths, a SELECT for each path."""
    wanted = {"suppliedBy": ["^hasPart/shippedBy", "suppliedBy", "^hasPart/hasPart"], "shippedBy": ["hasPart/suppliedBy", "shippedBy"], "placedBy": ["hasPart/^hasPart", "placedBy"], "hasPart": ["shippedBy/^suppliedBy"], "custNation": ["^placedBy/placedBy", "custNation"]}
    one = lambda r, x, a, b: f"facts {x} ON {x}.p = '{r.removeprefix('^')}' AND {x}.{'o' if r[0] == '^' else 's'} = {a}" + (f" AND {x}.{'s' if r[0] == '^' else 'o'} = {b}" if b else "")
    out = []
    for p, own in wanted.items():
        for path in own:
            r = path.split("/")
            joins = f"JOIN {one(r[0], 'a', 'ex.s', 'ex.o')}" if len(r) == 1 else f"JOIN {one(r[0], 'a', 'ex.s', '')} JOIN {one(r[1], 'b', 'a.' + ('s' if r[0][0] == '^' else 'o'), 'ex.o')}"
            out.append(f"SELECT DISTINCT ex.p, ex.s, ex.o, 'path:{path}' AS feature FROM ex {joins} WHERE ex.p = '{p}'")
    return " UNION ALL ".join(out)


ORACLE: dict[str, str] = {
    "kg_facts": BASE + " SELECT * FROM facts",
    "kg_types": BASE + " SELECT * FROM types",
    "relation_counts": BASE + " SELECT p, count(*) AS n FROM facts GROUP BY p",
    "endpoint_counts": BASE + " SELECT p, count(DISTINCT s) AS n_subjects, count(DISTINCT o) AS n_objects FROM facts GROUP BY p",
    "inverse_facts": BASE + " SELECT p, s, o FROM facts UNION ALL SELECT '^' || p, o, s FROM facts",
    "symmetric_relations": BASE + " SELECT f.p, count(*) = count(b.p) AS symmetric FROM facts f LEFT JOIN facts b ON f.p = b.p AND f.s = b.o AND f.o = b.s GROUP BY f.p",
    "object_type_distribution": BASE + SCORES + " SELECT * FROM w",
    "subject_type_distribution": BASE + " SELECT p, t, count(*) / (SELECT count(*) FROM facts)::DOUBLE AS w FROM facts JOIN types ON s = e GROUP BY p, t",
    "relative_predicate_frequency": BASE + " SELECT p, o, count(*) / sum(count(*)) OVER (PARTITION BY o)::DOUBLE AS rpf FROM facts GROUP BY p, o",
    "sdvalidate_scores": BASE + SCORES + " SELECT * FROM scores",
    "sdvalidate_ranked": BASE + SCORES + " SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS rank, score, p, s, o FROM scores",
    "threshold_predictions": BASE + SCORES + " SELECT *, (score > 0.9)::INT::DOUBLE AS label FROM scores",
    "domran_induced": BASE + INDUCED + ' SELECT p, t, prob, "end" FROM ind',
    "domran_scores": BASE
    + INDUCED
    + """ SELECT f.p, f.s, f.o, round(least(
      CASE WHEN a.t IS NULL THEN 1.0 WHEN list_contains(x.ts, a.t) THEN a.prob ELSE 1 - a.prob END,
      CASE WHEN b.t IS NULL THEN 1.0 WHEN list_contains(y.ts, b.t) THEN b.prob ELSE 1 - b.prob END)::DOUBLE, 9) AS score
    FROM facts f LEFT JOIN ind a ON a.p = f.p AND a."end" = 's' LEFT JOIN ind b ON b.p = f.p AND b."end" = 'o' LEFT JOIN tset x ON x.e = f.s LEFT JOIN tset y ON y.e = f.o""",
    "zscore_outliers": BASE
    + SCORES
    + """ SELECT p, s, o, round(CASE WHEN score < mean THEN CASE WHEN std = 0 THEN 1.0 ELSE (score - mean) / std END ELSE 1.0 END::DOUBLE, 6) AS score FROM (
      SELECT *, round(avg(score) OVER w, 9) AS mean, round(stddev_pop(score) OVER w, 9) AS std FROM scores WINDOW w AS (PARTITION BY p))""",
    "type_groups": BASE + " SELECT array_to_string(ts, ',') AS ts, count(*) AS n FROM tset GROUP BY ts",
    "omnipresent_types": BASE + " SELECT t FROM types WHERE e LIKE 'customer/%' GROUP BY t HAVING count(*) = (SELECT count(*) FROM customer)",
    "universal_type": BASE + " SELECT e, t FROM types WHERE t <> 'Nation' UNION ALL SELECT e, 'Anything' FROM (SELECT s AS e FROM facts UNION SELECT o FROM facts)",
    "two_hop_paths": BASE + HOPS + " SELECT * FROM hops",
    "path_support": BASE + HOPS + " SELECT path, count(*) AS n FROM hops GROUP BY path HAVING count(*) BETWEEN 1000 AND 9999999",
    "path_size_bound": BASE + " SELECT sum(a.n * b.n)::BIGINT AS bound FROM (SELECT o, count(*) AS n FROM facts WHERE p = 'suppliedBy' GROUP BY o) a JOIN (SELECT o, count(*) AS n FROM facts WHERE p = 'shippedBy' GROUP BY o) b ON a.o = b.o",
    "path_relevance": BASE
    + """, s AS (SELECT DISTINCT p, s AS e FROM facts), o AS (SELECT DISTINCT p, o AS e FROM facts), n AS (SELECT p, count(*) AS n FROM facts GROUP BY p)
    , i AS (SELECT o.p AS p1, s.p AS r, count(*) AS inter FROM o JOIN s ON o.e = s.e GROUP BY o.p, s.p)
    , b AS (SELECT s.p AS p1, o.p AS r, count(*) AS k FROM s JOIN o ON o.e = s.e GROUP BY o.p, s.p)
    , u AS (SELECT x.p AS p1, y.p AS r, (SELECT count(*) FROM (SELECT e FROM s WHERE p = x.p UNION SELECT e FROM o WHERE p = y.p)) AS k FROM n x, n y)
    SELECT i.p1, i.r, inter, x.n * y.n AS mult, inter / (coalesce(b.k, 0) + 1)::DOUBLE AS m1, inter * u.k AS m2
    FROM i LEFT JOIN b ON b.p1 = i.p1 AND b.r = i.r JOIN u ON u.p1 = i.p1 AND u.r = i.r JOIN n x ON x.p = i.p1 JOIN n y ON y.p = i.r""",
    "path_features": BASE + " SELECT DISTINCT f.s, f.o FROM facts f JOIN facts a ON a.p = 'hasPart' AND a.o = f.s JOIN facts b ON b.p = 'shippedBy' AND b.s = a.s AND b.o = f.o WHERE f.p = 'suppliedBy'",
    "type_features": BASE + ", f AS (SELECT DISTINCT s, o FROM facts) SELECT s, o, 's:' || t AS feature FROM f JOIN types ON s = e UNION ALL SELECT s, o, 'o:' || t FROM f JOIN types ON o = e",
    "end_features": BASE
    + """, f AS (SELECT DISTINCT s, o FROM facts), k AS (SELECT DISTINCT p, 'out' AS k, s AS e FROM facts UNION ALL SELECT DISTINCT p, 'in', o FROM facts)
    SELECT s, o, k || '_s:' || k.p AS feature FROM f JOIN k ON f.s = k.e UNION ALL SELECT s, o, k || '_o:' || k.p FROM f JOIN k ON f.o = k.e""",
    "training_examples": BASE + EXAMPLES + " SELECT * FROM ex",
    "feature_scores": BASE + EXAMPLES + " SELECT p, feature, chi2, mi FROM fs",
    "best_features_chi2": BASE + EXAMPLES + " SELECT p, feature, chi2, rank FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY chi2 DESC, feature) AS rank FROM fs) WHERE rank <= 5",
    "best_features_mi": BASE + EXAMPLES + " SELECT p, feature, mi, rank FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY mi DESC, feature) AS rank FROM fs) WHERE rank <= 5",
    "errors_kind1": BASE + errors(1) + " SELECT * FROM errs",
    "errors_kind2": BASE + errors(2) + " SELECT * FROM errs",
    "co_occurring_negatives": BASE
    + POSITIVES
    + f""", seen AS (SELECT DISTINCT s, o AS e FROM facts), c AS (
      SELECT a.p, a.s, a.o AS was, x.e AS o, row_number() OVER (PARTITION BY a.p, a.s, a.o ORDER BY {h(42, "a.p", "a.s", "a.o", "x.e")}, x.e) AS k
      FROM pos a JOIN seen x ON x.s = a.s AND x.e <> a.o ANTI JOIN facts f ON f.p = a.p AND f.s = a.s AND f.o = x.e
    ) SELECT DISTINCT p, s, o FROM c WHERE k = 1""",
    "error_ranks": BASE + JUDGED + " SELECT * FROM eranks",
    "rank_metrics": BASE + JUDGED + " SELECT round(avg(rank), 9) AS mean_rank, round(avg(1.0::DOUBLE / rank), 9) AS mrr, round(avg(filtered_rank), 9) AS filtered_mean_rank, round(avg(1.0::DOUBLE / filtered_rank), 9) AS filtered_mrr FROM eranks",
    "roc_auc": BASE + JUDGED + " SELECT round(sum(pos * (nn - fp + neg / 2.0::DOUBLE)) / max(np * nn), 9)::DOUBLE AS roc_auc FROM cum",
    "pr_auc": BASE + JUDGED + " SELECT round(sum(pos / np::DOUBLE * (tp / (tp + fp)::DOUBLE + coalesce((tp - pos) / nullif(tp - pos + fp - neg, 0)::DOUBLE, 1.0)) / 2), 9)::DOUBLE AS pr_auc FROM cum",
    "best_f1": BASE + JUDGED + " SELECT round(max(2 * tp / (tp + fp + np)::DOUBLE), 9)::DOUBLE AS best_f1 FROM cum",
    "worst_facts": BASE + SCORES + " SELECT * FROM (SELECT *, row_number() OVER (ORDER BY score, p, s, o) AS rank FROM scores) WHERE rank <= floor((SELECT count(*) FROM scores) * 0.01)",
    "subclass_closure": BASE + " SELECT * FROM up",
    "inherited_types": BASE + " SELECT e, t FROM types UNION SELECT e, parent FROM types JOIN up ON t = child",
    "inherited_facts": BASE + " SELECT p, s, o FROM facts UNION SELECT 'involves', s, o FROM facts WHERE p IN ('hasPart', 'shippedBy') UNION SELECT 'related', s, o FROM facts WHERE p IN ('hasPart', 'shippedBy')",
    "domain_range_types": BASE + " SELECT e, t FROM types WHERE t <> 'Customer' UNION SELECT s, d FROM facts JOIN ends ON facts.p = ends.p UNION SELECT o, r FROM facts JOIN ends ON facts.p = ends.p",
    "equivalent_types": BASE + " SELECT e, t FROM types UNION SELECT e, unnest(['Buyer', 'Client']) FROM types WHERE t = 'Customer'",
    "hierarchy_levels": BASE + " SELECT 'Thing' AS node, 0 AS level UNION SELECT child, CASE WHEN parent = 'Thing' THEN 1 ELSE 2 END FROM subclass",
    "hierarchy_roots": BASE + " SELECT 'Thing' AS node",
    "hierarchy_tree": BASE + " SELECT child, min(parent) AS parent FROM up GROUP BY child",
    "ntriples_facts": BASE + " SELECT * FROM facts",
    "tsv_triples": "SELECT c_name AS s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, c_mktsegment AS o FROM customer WHERE c_custkey % 7 <> 0",
    "disambiguation_links": "SELECT 'customer/' || a.c_custkey AS a, 'customer/' || b.c_custkey AS b FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey <> b.c_custkey",
    "name_tokens": PARTS + " SELECT token, count(*) AS freq FROM tok GROUP BY token",
    "deletion_variants": PARTS + " SELECT DISTINCT token, token AS variant FROM tok UNION SELECT token, substr(token, 1, i - 1) || substr(token, i + 1) FROM (SELECT DISTINCT token, unnest(range(1, length(token) + 1)) AS i FROM tok WHERE length(token) > 1)",
    "similar_tokens": TOKENS.format("SELECT p_partkey AS e, p_name AS name FROM part UNION ALL SELECT n_nationkey, n_name FROM nation")
    + ", t AS (SELECT DISTINCT token FROM tok) SELECT a.token AS query, b.token, damerau_levenshtein(a.token, b.token)::INT AS dist FROM t a JOIN t b ON damerau_levenshtein(a.token, b.token) <= 1",
    "type_set_similarity": BASE
    + """, g AS (SELECT DISTINCT ts FROM tset) SELECT array_to_string(a.ts, ',') AS a, array_to_string(b.ts, ',') AS b,
      round(len(list_intersect(a.ts, b.ts)) / len(list_distinct(list_concat(a.ts, b.ts)))::DOUBLE, 9) AS jaccard FROM g a JOIN g b ON a.ts < b.ts AND len(list_intersect(a.ts, b.ts)) > 0""",
    "embedding_scores": VECTORS
    + f""" SELECT vec_id, round(-{sum_over(64, "(s[i + 1] + r[i + 1] - o[i + 1]) ^ 2")}, 5) AS transe, round(-{sum_over(64, "abs(s[i + 1] + r[i + 1] - o[i + 1])")}, 5) AS transe_l1,
      round({sum_over(4096, "r[i // 64 + 1] * s[i % 64 + 1] * o[(i // 64 + i % 64) % 64 + 1]")}, 5) AS hole,
      round({sum_over(32, "s[i + 1] * r[i + 1] * o[i + 1] + s[i + 33] * r[i + 1] * o[i + 33] + s[i + 1] * r[i + 33] * o[i + 33] - s[i + 33] * r[i + 33] * o[i + 1]")}, 5) AS complex,
      round({sum_over(8, f"({through('s')}) * o[i + 1]")}, 5) AS rescal, round(-{sum_over(8, f"abs({through('s')} - o[i + 1])")}, 5) AS rescal_l1,
      round(-sqrt({sum_over(8, f"({through('s')} + r[i + 1] - ({through('o')})) ^ 2")}), 5) AS transr,
      round({sum_over(64, "tanh(s[i + 1] + r[i + 1]) * (s[i + 1] + o[i + 1])")} / 2, 5) AS proje FROM x""",
    "link_ranks": LINKS + " SELECT * FROM r",
    "link_metrics": LINKS + " SELECT round(avg(rank), 9) AS mean_rank, round(avg(1.0::DOUBLE / rank), 9) AS mrr, round(100 * avg((rank <= 10)::INT), 9) AS hits FROM r",
    "constraint_violations": BASE
    + """ SELECT f.s, f.o FROM facts f WHERE p = 'placedBy' AND EXISTS (SELECT 1 FROM types WHERE e = f.s AND t = 'Order:F')
      AND NOT EXISTS (SELECT 1 FROM types WHERE e = f.o AND t = 'Customer:BUILDING') AND EXISTS (SELECT 1 FROM facts x WHERE x.p = 'custNation' AND x.s = f.o)""",
    "best_correction": BASE
    + f""", c AS (
      SELECT f.*, n.s AS cand, {h(42, "f.p", "f.s", "f.o")} / 4294967296.0::DOUBLE AS score, {h(42, "f.s", "f.o", "n.s")} / 4294967296.0::DOUBLE AS cand_score, {h(42, "n.s", "f.s")} % 3 AS dist
      FROM facts f JOIN facts m ON m.p = 'inRegion' AND m.s = f.o JOIN facts n ON n.p = 'inRegion' AND n.o = m.o AND n.s <> f.o WHERE f.p = 'custNation'
    ) SELECT p, s, o, cand, dist FROM (SELECT *, row_number() OVER (PARTITION BY p, s, o ORDER BY cand_score DESC, dist, cand) AS k FROM c WHERE cand_score > 0.75 AND cand_score >= 1.5 * score) WHERE k = 1""",
    "stream_model_scores": BASE + SCORES + " SELECT * FROM scores",
    "detect_injected_errors": BASE
    + NOISY
    + """, judged AS (SELECT x.score, e.p IS NOT NULL AS is_error FROM scores x LEFT JOIN errs e ON x.p = e.p AND x.s = e.s AND x.o = e.o)
    , cv AS (SELECT score, count(*) FILTER (WHERE is_error) AS pos, count(*) FILTER (WHERE NOT is_error) AS neg FROM judged GROUP BY score)
    , cum AS (SELECT *, sum(neg) OVER (ORDER BY score) AS fp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM cv)
    SELECT round(sum(pos * (nn - fp + neg / 2.0::DOUBLE)) / max(np * nn), 9)::DOUBLE AS roc_auc FROM cum""",
    "name_suggestions": PARTS
    + """, asked AS (SELECT e AS q, token FROM tok WHERE e % 20 = 0), n AS (SELECT q, count(*) AS nq FROM asked GROUP BY q)
    , sim AS (SELECT a.token AS query, b.token, damerau_levenshtein(a.token, b.token) AS dist FROM (SELECT DISTINCT token FROM asked) a JOIN (SELECT DISTINCT token FROM tok) b ON damerau_levenshtein(a.token, b.token) <= 1)
    , hit AS (SELECT q, t.e, query, min(dist) AS dist FROM asked JOIN sim ON asked.token = sim.query JOIN tok t ON t.token = sim.token GROUP BY q, t.e, query)
    , got AS (SELECT q, e, count(*) AS matches, sum(dist)::BIGINT AS dist FROM hit GROUP BY q, e)
    SELECT * FROM (SELECT got.*, row_number() OVER (PARTITION BY got.q ORDER BY dist, e)::INT AS rank FROM got JOIN n ON got.q = n.q WHERE matches = nq) WHERE rank <= 10""",
    "agreement_on_new_facts": BASE + HALF + NEW,
    "induced_ends_on_new_facts": BASE
    + HALF
    + INDUCED.replace("FROM facts", "FROM half").replace("0.95", "0.6")
    + """ SELECT f.p, f.s, f.o, round(least(
      CASE WHEN a.t IS NULL THEN 1.0 WHEN list_contains(x.ts, a.t) THEN a.prob ELSE 1 - a.prob END,
      CASE WHEN b.t IS NULL THEN 1.0 WHEN list_contains(y.ts, b.t) THEN b.prob ELSE 1 - b.prob END)::DOUBLE, 9) AS score
    FROM other f LEFT JOIN ind a ON a.p = f.p AND a."end" = 's' LEFT JOIN ind b ON b.p = f.p AND b."end" = 'o' LEFT JOIN tset x ON x.e = f.s LEFT JOIN tset y ON y.e = f.o""",
    "errors_exact": BASE + exact_errors() + " SELECT * FROM errs",
    "chained_negatives": BASE
    + EXAMPLES
    + f""", d1 AS (SELECT d.p, pos.s, pos.o, CASE WHEN coin = 0 THEN x.e ELSE d.s END AS s1, CASE WHEN coin = 0 THEN d.o ELSE x.e END AS o1 FROM draw d JOIN pos ON pos.p = d.p AND pos.s = d.s AND pos.o = d.o JOIN pool x ON x.p = d.p AND x.i = d.i)
    , d2 AS (SELECT d.p, CASE WHEN {h(43, "d.p", "d.s", "d.o", "2")} % 2 = 0 THEN x.e ELSE d.s1 END AS s1, CASE WHEN {h(43, "d.p", "d.s", "d.o", "2")} % 2 = 0 THEN d.o1 ELSE x.e END AS o1
      FROM d1 d JOIN (SELECT p, max(n) AS n FROM pool GROUP BY p) b ON b.p = d.p JOIN pool x ON x.p = d.p AND x.i = {h(44, "d.p", "d.s", "d.o", "2")} % b.n)
    SELECT n.p, n.s, n.o FROM (SELECT p, s1 AS s, o1 AS o FROM d1 UNION SELECT p, s1, o1 FROM d2) n LEFT JOIN facts f ON n.p = f.p AND n.s = f.s AND n.o = f.o WHERE f.p IS NULL""",
    "type_facts": BASE + " SELECT p, s, o FROM facts UNION ALL SELECT 'rdf:type', e, 'type:' || t FROM types",
    "entity_dictionary": BASE + " SELECT DISTINCT e FROM types",
    "value_neighbours": "SELECT x, (SELECT max(s_acctbal::DOUBLE) FROM supplier WHERE s_acctbal::DOUBLE <= x) AS floor, (SELECT min(s_acctbal::DOUBLE) FROM supplier WHERE s_acctbal::DOUBLE >= x) AS ceiling FROM (SELECT DISTINCT c_acctbal::DOUBLE AS x FROM customer)",
    "word_suggestions": PARTS
    + """, f AS (SELECT token, count(*) AS freq FROM tok GROUP BY token)
    SELECT *, row_number() OVER (PARTITION BY query ORDER BY dist, freq DESC, token)::INT AS rank FROM (SELECT a.token AS query, b.token, damerau_levenshtein(a.token, b.token)::INT AS dist, b.freq FROM f a JOIN f b ON damerau_levenshtein(a.token, b.token) <= 1)""",
    "one_vs_all_top": ASKED
    + """, s AS (SELECT q, e, round(list_sum(list_transform(range(1, len(v) + 1), lambda i: vec[i] * v[i])), 9) AS score FROM q, v)
    SELECT q, e, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, e)::INT AS rank FROM s) WHERE rank <= 10""",
    "one_vs_all_ranks": ASKED
    + """, s AS (SELECT q, e, round(-list_sum(list_transform(range(1, len(v) + 1), lambda i: (vec[i] - v[i]) ^ 2)), 9) AS score FROM q, v)
    SELECT t.q, 1 + count(*) FILTER (WHERE s.score > t.score) AS rank, 1 + count(*) FILTER (WHERE s.score > t.score AND NOT (s.e % 3 = 0 AND s.e BETWEEN 3 * s.q AND 3 * (s.q + 40) AND s.e <> t.e)) AS filtered_rank
    FROM s t JOIN s ON s.q = t.q WHERE t.e = t.q + 1 GROUP BY t.q""",
    "external_ranks": LINKS + " SELECT q, answer, rank, filtered_rank FROM r",
    "rank_pooling": BASE
    + f""", test AS (SELECT p, s, o FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY {h(42, "p", "s", "o")}, s, o) AS k, count(*) OVER (PARTITION BY p) AS n FROM facts) WHERE k <= ceil(n * 0.01))
    , asked AS (SELECT 'tail|' || t.p || '|' || t.s || '|' || t.o AS q, (SELECT count(*) FROM facts f WHERE f.p = t.p AND f.s = t.s) - 1 AS hidden FROM test t
      UNION ALL SELECT 'head|' || t.p || '|' || t.s || '|' || t.o, (SELECT count(*) FROM facts f WHERE f.p = t.p AND f.o = t.o) - 1 FROM test t)
    , r AS (SELECT {h(3, "q")} % 100 + 1 AS rank, greatest(1, {h(3, "q")} % 100 + 1 - least(hidden, 5)) AS filtered_rank FROM asked)
    SELECT round(avg(rank), 9) AS mean_rank, round(avg(1.0::DOUBLE / rank), 9) AS mrr, round(100 * avg((rank <= 10)::INT), 9) AS hits,
      round(avg(filtered_rank), 9) AS filtered_mean_rank, round(avg(1.0::DOUBLE / filtered_rank), 9) AS filtered_mrr, round(100 * avg((filtered_rank <= 10)::INT), 9) AS filtered_hits FROM r""",
    "followed_paths": BASE + EXAMPLES + " " + path_rows(),
    "corrections": BASE
    + NOISY
    + """, worst AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY score, p, s, o) AS rank FROM scores) WHERE rank <= floor((SELECT count(*) FROM scores) * 0.005))
    , num AS (SELECT DISTINCT e, split_part(e, '/', 2) AS k FROM types)
    , c AS (
      SELECT w.p, w.s, w.o, w.score, b.e AS cand FROM worst w JOIN num a ON a.e = w.o JOIN num b ON b.k = a.k AND b.e <> w.o JOIN ends ON ends.p = w.p
      JOIN types t ON t.e = b.e AND t.t = ends.r JOIN (SELECT e FROM types GROUP BY e HAVING count(*) > 1) m ON m.e = w.o
      LEFT JOIN noisyf f ON f.p = w.p AND f.s = w.s AND f.o = b.e WHERE f.p IS NULL
    ), cs AS (
      SELECT c.p, c.cand, round(sum(w.w) / (sqrt(count(*)) * any_value(norm.norm)), 9) AS cand_score
      FROM (SELECT DISTINCT p, cand FROM c) c JOIN types t ON t.e = c.cand LEFT JOIN w ON w.p = c.p AND w.t = t.t JOIN norm ON norm.p = c.p GROUP BY c.p, c.cand
    ) SELECT p, s, o, score, 'entity' AS kind, 'o' AS "end", cand, cand_score, 0::BIGINT AS dist
    FROM (SELECT c.*, cand_score, row_number() OVER (PARTITION BY c.p, s, o ORDER BY cand_score DESC, c.cand) AS k FROM c JOIN cs ON cs.p = c.p AND cs.cand = c.cand WHERE cand_score > 0.75 AND cand_score >= 1.5 * score) WHERE k = 1""",
}
