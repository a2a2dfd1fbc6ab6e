"""Named queries over the given tables, each with the SQL that states its result.

`query(name, sql)` registers a function ``(spark, sf_dir) -> DataFrame``; queries whose
semantics SQL cannot state reasonably are registered without SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rounded(digits: int, *names: str) -> list[F.Column]:
    return [F.round(F.col(n), digits).alias(n) for n in names]


# ---- SQL building blocks -----------------------------------------------------------------

TRADE = """trade AS (
  SELECT c_mktsegment AS subj, least(c_nationkey, s_nationkey)::BIGINT AS i,
         greatest(c_nationkey, s_nationkey)::BIGINT AS j,
         ((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1)::BIGINT AS t, sum(l_quantity) AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY 1, 2, 3, 4)"""

FLOWS = """flows AS (
  SELECT c_mktsegment AS subj, c_nationkey::BIGINT AS i, s_nationkey::BIGINT AS j,
         ((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1)::BIGINT AS t, sum(l_quantity) AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN supplier ON l_suppkey = s_suppkey
  GROUP BY 1, 2, 3, 4)"""

BOTH = """ends AS (SELECT subj, i, j, t, w FROM trade UNION ALL SELECT subj, j, i, t, w FROM trade)"""

MEAN = """mean AS (SELECT i, j, t, sum(w) / 5 AS w FROM trade GROUP BY 1, 2, 3)"""

PAIRS = """pairs AS (SELECT a.range AS i, b.range AS j FROM range(25) a JOIN range(25) b ON a.range < b.range)"""

FRAMES = """frames AS (SELECT range AS t FROM range(83))"""

ZSCORES = f"""{TRADE}, {MEAN}, {PAIRS}, {FRAMES},
 dense AS (SELECT i, j, t, coalesce(w, 0) AS w FROM (SELECT * FROM pairs, frames) LEFT JOIN mean USING (i, j, t)),
 z AS (SELECT i, j, t, CASE WHEN sd > 0 THEN (w - mu) / sd ELSE 0 END AS z FROM (
   SELECT *, avg(w) OVER (PARTITION BY i, j) AS mu, stddev_pop(w) OVER (PARTITION BY i, j) AS sd FROM dense))"""

PREFIX = f"""{ZSCORES},
 pre AS (SELECT i, j, t + 1 AS pos, sum(z) OVER (PARTITION BY i, j ORDER BY t) AS s,
                sum(z * z) OVER (PARTITION BY i, j ORDER BY t) AS q FROM z)"""

# exact two-change-point segmentation with at least 10 frames per segment
SEGMENTS = f"""{PREFIX},
 pre0 AS (SELECT * FROM pre UNION ALL SELECT i, j, 0, 0, 0 FROM pairs),
 cost AS (SELECT a.pos AS s, b.pos AS e, sum(b.q - a.q) - sum((b.s - a.s) * (b.s - a.s)) / (b.pos - a.pos) AS c
   FROM pre0 a JOIN pre0 b ON a.i = b.i AND a.j = b.j AND b.pos - a.pos >= 10 GROUP BY 1, 2),
 best AS (SELECT x.e AS b1, y.e AS b2, x.c + y.c + z.c AS sse FROM cost x JOIN cost y ON y.s = x.e
   JOIN cost z ON z.s = y.e WHERE x.s = 0 AND z.e = 83 ORDER BY sse, b2, b1 LIMIT 1)"""

THIRDS = """iv(interval, s, e) AS (VALUES ('pre', 0, 28), ('core', 28, 56), ('post', 56, 83))"""

GRAPHS = f"""{TRADE}, {THIRDS},
 graphs AS (SELECT interval, subj, i, j, CAST(sum(w) / any_value(e - s) AS FLOAT)::DOUBLE AS w
   FROM trade JOIN iv ON t >= s AND t < e GROUP BY 1, 2, 3, 4)"""

GMEAN = f"""{GRAPHS}, gmean AS (SELECT interval, i, j, sum(w) / 5 AS w FROM graphs GROUP BY 1, 2, 3)"""

LABELS = """lab AS (SELECT n_nationkey::BIGINT AS node, (n_regionkey + 1)::BIGINT AS community FROM nation)"""

RANKS = f"""{GRAPHS}, {LABELS},
 gends AS (SELECT interval, subj, i, j, w FROM graphs UNION ALL SELECT interval, subj, j, i, w FROM graphs),
 spine AS (SELECT interval, subj, a.range AS i, b.range AS j
   FROM (SELECT DISTINCT interval FROM graphs), (SELECT DISTINCT c_mktsegment AS subj FROM customer),
        range(25) a, range(25) b WHERE a.range <> b.range),
 ranks AS (SELECT interval, subj, i, j, row_number() OVER (
     PARTITION BY interval, subj, i ORDER BY coalesce(w, 0) DESC, j) AS rank
   FROM spine LEFT JOIN gends USING (interval, subj, i, j))"""

HISTS = f"""{RANKS},
 raw AS (SELECT interval, a.community, rank, sum((a.community = b.community)::BIGINT)::BIGINT AS intra,
     sum((a.community <> b.community)::BIGINT)::BIGINT AS inter
   FROM ranks JOIN lab a ON i = a.node JOIN lab b ON j = b.node GROUP BY 1, 2, 3),
 hist AS (SELECT interval, community, rank, coalesce(intra, 0) AS intra, coalesce(inter, 0) AS inter
   FROM (SELECT * FROM (SELECT DISTINCT interval FROM graphs), (SELECT DISTINCT community FROM lab), (SELECT range AS rank FROM range(1, 26)))
   LEFT JOIN raw USING (interval, community, rank))"""

CLUSTERS = f"""{HISTS},
 tot AS (SELECT interval, community, sum(intra) AS ti, sum(inter) AS tx FROM hist GROUP BY 1, 2),
 pq AS (SELECT interval, community, CASE WHEN ti > 0 THEN intra / ti ELSE 1 / 25.0 END AS p,
     CASE WHEN tx > 0 THEN inter / tx ELSE 1 / 25.0 END AS q FROM hist JOIN tot USING (interval, community)),
 clusters AS (SELECT interval, community, n AS size, entropy, n / 25.0 * greatest(0, 1 - entropy / log2(25)) AS h,
     greatest(0, least(1, js)) AS c FROM (
   SELECT interval, community, sum(CASE WHEN p > 0 THEN -p * log2(p) ELSE 0 END) AS entropy,
     0.5 * sum(CASE WHEN p > 0 THEN p * log2(p / (0.5 * (p + q))) ELSE 0 END)
     + 0.5 * sum(CASE WHEN q > 0 THEN q * log2(q / (0.5 * (p + q))) ELSE 0 END) AS js
   FROM pq GROUP BY 1, 2) JOIN (SELECT community, count(*) AS n FROM lab GROUP BY 1) USING (community))"""

ENERGY = f"""{TRADE}, {MEAN}, {FRAMES},
 en AS (SELECT t, coalesce(v, 0) AS v FROM frames LEFT JOIN
   (SELECT t, sqrt(2 * sum(w * w)) AS v FROM mean GROUP BY 1) USING (t))"""

TRIALS = """ranked AS (SELECT label AS ch, embedding, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::BIGINT AS k
   FROM embeddings),
 parts AS (SELECT k % 4 AS subj, CASE WHEN (k // 4) % 2 = 0 THEN 'Correct' ELSE 'Incorrect' END AS cond,
     k // 8 AS trial, ch, embedding FROM ranked),
 x AS (SELECT subj, cond, trial, ch, unnest(range(64)) AS t, unnest(embedding)::DOUBLE AS v FROM parts)"""

# circular kernels of the ideal 4..8 Hz filter at 64 Hz and of the Hilbert transform, 64 samples
BAND = f"""{TRIALS},
 g AS (SELECT n.range AS n, sum(2 * cos(2 * pi() * k.range * n.range / 64)) / 64 AS g
   FROM range(64) n, range(4, 9) k GROUP BY 1),
 y AS (SELECT subj, cond, trial, ch, o.range AS t, sum(x.v * g.g) AS v
   FROM x, range(64) o JOIN g ON g.n = (o.range - x.t + 64) % 64 GROUP BY 1, 2, 3, 4, 5)"""

ANALYTIC = f"""{BAND},
 h AS (SELECT range AS n, CASE WHEN range % 2 = 1 THEN 2.0 / 64 / tan(pi() * range / 64) ELSE 0 END AS h FROM range(64)),
 im AS (SELECT subj, cond, trial, ch, o.range AS t, sum(y.v * h.h) AS v
   FROM y, range(64) o JOIN h ON h.n = (o.range - y.t + 64) % 64 GROUP BY 1, 2, 3, 4, 5),
 a AS (SELECT subj, cond, trial, ch, t, y.v AS re, im.v AS im FROM y JOIN im USING (subj, cond, trial, ch, t))"""

EVENTS = """ev AS (SELECT user_id AS subj, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000000 AS sample, event_id,
   CASE WHEN event_type = 'error' THEN 'Incorrect' ELSE 'Correct' END AS code FROM events)"""




def projector(name: str, gram: str, rank: int, keys: str = "", floor: float = 0.0) -> str:
    """SQL for the projector ``name``(*keys, r, c, p) onto the ``rank`` leading eigenvectors of a complete symmetric table ``gram``(*keys, r, c, g).

    A matrix squared again and again, its trace kept at 1, tends to the projector onto its strongest direction; that
    direction is taken off (deflation) and the next one follows. Directions whose singular value (root of the eigenvalue) is below ``floor`` times the
    first one's are left out.
    """
    square = "list_transform({0}, lambda a: list_transform({0}, lambda b: list_dot_product(a, b)))"
    trace = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: {0}[i][i]))"
    scaled = "list_transform({0}, lambda a: list_transform(a, lambda x: x / {1}))"
    each = "list_transform(range(1, len(p) + 1), lambda i: list_transform(range(1, len(p) + 1), lambda j: {0}))"
    k_ = f"{keys}, " if keys else ""
    join = f"JOIN {name}_m USING ({keys})" if keys else f", {name}_m"
    return f"""{name}_m AS MATERIALIZED (SELECT {k_}list(v ORDER BY r) AS m, list(r ORDER BY r) AS names FROM (SELECT {k_}r, list(g ORDER BY c) AS v FROM {gram} GROUP BY {k_}r) {"GROUP BY " + keys if keys else ""}),
 {name}_it({k_}eig, sq, g, p, sum, top) AS (
  SELECT {k_}1, 0, m, {scaled.format("m", trace.format("m"))}, list_transform(m, lambda a: list_transform(a, lambda x: 0.0::DOUBLE)), 0.0::DOUBLE FROM {name}_m
  UNION ALL
  SELECT {k_}CASE WHEN sq < 32 THEN eig ELSE eig + 1 END, CASE WHEN sq < 32 THEN sq + 1 ELSE 0 END, next_g,
    CASE WHEN sq < 32 THEN {scaled.format("q", trace.format("q"))} ELSE {scaled.format("next_g", trace.format("next_g"))} END,
    CASE WHEN sq < 32 OR l < {floor * floor} * top THEN sum ELSE {each.format("sum[i][j] + p[i][j]")} END, CASE WHEN sq < 32 THEN top ELSE greatest(top, l) END
  FROM (SELECT *, CASE WHEN sq < 32 THEN {square.format("p")} ELSE p END AS q, CASE WHEN sq < 32 THEN g ELSE {each.format("g[i][j] - l * p[i][j]")} END AS next_g
   FROM (SELECT *, list_sum(list_transform(range(1, len(p) + 1), lambda i: list_dot_product(p[i], g[i]))) AS l FROM {name}_it WHERE eig <= {rank}))),
 {name} AS MATERIALIZED (SELECT {k_}names[i] AS r, names[j] AS c, sum[i][j] AS p FROM {name}_it {join},
   (SELECT unnest(range(1, 200)) AS i), (SELECT unnest(range(1, 200)) AS j) WHERE eig = {rank + 1} AND sq = 0 AND i <= len(names) AND j <= len(names))"""


def register_all() -> None:
    from netweave.plans import network_queries, regime_queries, signal_queries, storage_queries  # noqa: F401
