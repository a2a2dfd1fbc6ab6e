"""Tensors, reductions, graph metrics, rank quality and communities."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from netweave.operators import communities as cm
from netweave.operators import frames as fr
from netweave.operators import graphs as gr
from netweave.operators import large_graphs as lg
from netweave.operators import lowrank as lr
from netweave.operators import quality as ql
from netweave.operators import segmentation as seg
from netweave.operators import subspace as ss
from netweave.operators import tensor as tn
from netweave.operators.spectral import gap_parts
from netweave.plans import catalog as cat
from netweave.plans.catalog import query, rounded
from netweave.shape import pair_spine
from netweave.sources import networks as nw
from netweave.sources.tables import table
from netweave.stage import stage

GRAPH_KEYS = ["cond", "interval"]
CELL = ["subj", "i", "j", "t", "w"]


def thirds(spark, d):
    rows = [("trade", *iv) for iv in seg.equal_thirds(nw.trade_shape(spark, d).n_frames)]
    return spark.createDataFrame(rows, "cond string, interval string, start bigint, end bigint")


def trade_graphs(spark, d):
    return tn.interval_graphs(nw.trade_edges(spark, d), thirds(spark, d))


def mean_graphs(spark, d):
    return tn.group_mean(trade_graphs(spark, d), nw.trade_shape(spark, d))


def interval_labels(spark, d):
    """The given partition by region, for every interval."""
    names = F.array(*[F.lit(iv[0]) for iv in seg.equal_thirds(nw.trade_shape(spark, d).n_frames)])
    return nw.region_labels(spark, d).select(F.lit("trade").alias("cond"), F.explode(names).alias("interval"), "node", "community")


# ---- tensors -----------------------------------------------------------------------------


@query("trade_tensor", f"WITH {cat.TRADE} SELECT subj, i, j, t, w FROM trade")
def trade_tensor(spark, d):
    return nw.trade_edges(spark, d).select(*CELL)


@query("planted_tensor", f"""WITH {cat.TRADE} SELECT subj, i, j, t, w * CASE WHEN a.n_regionkey = b.n_regionkey THEN 8 ELSE 1 END AS w
FROM trade JOIN nation a ON i = a.n_nationkey JOIN nation b ON j = b.n_nationkey""")
def planted_tensor(spark, d):
    return nw.planted_edges(spark, d).select(*CELL)


@query("event_tensor", """
WITH c AS (SELECT (user_id % 8)::VARCHAR AS subj, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 3600000000 AS t,
  event_type, count(*) AS n FROM events GROUP BY 1, 2, 3),
 k AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS node FROM (SELECT DISTINCT event_type FROM events)),
 s AS (SELECT subj, t, node, n FROM c JOIN k USING (event_type))
SELECT a.subj, a.node AS i, b.node AS j, a.t, (a.n * b.n)::DOUBLE AS w FROM s a JOIN s b ON a.subj = b.subj AND a.t = b.t AND a.node < b.node""")
def event_tensor(spark, d):
    return nw.event_edges(spark, d).select(*CELL)


@query("tensor_layout", f"WITH {cat.TRADE}, {cat.BOTH} SELECT i, j, subj, t, w FROM ends")
def tensor_layout(spark, d):
    both = tn.mirrored(nw.trade_edges(spark, d))
    return tn.reorder(both, tn.PAPER_LAYOUT).drop("cond")


DIRTY = f"""WITH {cat.FLOWS},
 dirty AS (SELECT subj, i, j, t, CASE WHEN i = 0 AND j = 1 THEN 'nan'::DOUBLE WHEN i = 2 AND j = 3 THEN 'inf'::DOUBLE ELSE w - 40 END AS w FROM flows),
 clean AS (SELECT subj, least(i, j) AS i, greatest(i, j) AS j, t, sum(CASE WHEN isfinite(w) THEN w ELSE 0 END) / 2 AS w
   FROM dirty WHERE i <> j GROUP BY 1, 2, 3, 4)"""


def dirty_flows(spark, d):
    bad = F.when((F.col("i") == 0) & (F.col("j") == 1), float("nan")).when(
        (F.col("i") == 2) & (F.col("j") == 3), float("inf")
    )
    return nw.trade_flows(spark, d).withColumn("w", bad.otherwise(F.col("w") - 40))


@query("tensor_sanitize", DIRTY + " SELECT subj, i, j, t, greatest(w, 0) AS w FROM clean")
def tensor_sanitize(spark, d):
    return tn.symmetrise(dirty_flows(spark, d)).select(*CELL)


@query("low_rank_sanitize", DIRTY + " SELECT subj, i, j, t, w FROM clean")
def low_rank_sanitize(spark, d):
    return tn.symmetrise(dirty_flows(spark, d), clip=False).select(*CELL)


@query("positive_edges", DIRTY + " SELECT subj, i, j, t, w FROM clean WHERE w > 0")
def positive_edges(spark, d):
    return tn.positive_edges(tn.symmetrise(dirty_flows(spark, d))).select(*CELL)


@query("soft_threshold", DIRTY + " SELECT subj, i, j, t, sign(w) * greatest(abs(w) - 7.5, 0) AS w FROM clean")
def soft_threshold(spark, d):
    return tn.shrink(tn.symmetrise(dirty_flows(spark, d), clip=False), 7.5).select(*CELL)


@query("subject_mean_edges", f"WITH {cat.TRADE}, {cat.MEAN} SELECT i, j, t, w FROM mean")
def subject_mean_edges(spark, d):
    return tn.subject_mean(nw.trade_edges(spark, d), nw.trade_shape(spark, d)).select("i", "j", "t", "w")


@query("global_profile", f"WITH {cat.TRADE} SELECT t, sum(w) * 2 / 3125 AS mean_w FROM trade GROUP BY 1")
def global_profile(spark, d):
    return tn.global_profile(nw.trade_edges(spark, d), nw.trade_shape(spark, d)).select("t", "mean_w")


@query("frobenius_energy", f"WITH {cat.ENERGY} SELECT t, round(v, 4) AS v FROM en")
def frobenius_energy(spark, d):
    from netweave.operators.detectors import fill_signal

    energy = fill_signal(tn.mean_graph_energy(nw.trade_edges(spark, d), nw.trade_shape(spark, d)), nw.trade_shape(spark, d))
    return energy.select("t", *rounded(4, "v"))


@query("component_energy", f"""WITH {cat.TRADE}
SELECT t, round(sum(sqrt(ss)) / 5, 4) AS mean_norm, sum(ss) / 3125 AS mean_square
FROM (SELECT t, subj, 2 * sum(w * w) AS ss FROM trade GROUP BY 1, 2) GROUP BY 1""")
def component_energy(spark, d):
    return tn.component_energy(nw.trade_edges(spark, d), nw.trade_shape(spark, d)).select("t", F.round("mean_norm", 4).alias("mean_norm"), "mean_square")


@query("time_slice", f"""WITH {cat.TRADE}, {cat.MEAN}, {cat.PAIRS}
SELECT i, j, coalesce(w, 0) AS w FROM pairs LEFT JOIN (SELECT * FROM mean WHERE t = 44) USING (i, j)""")
def time_slice(spark, d):
    """Subject-mean matrix of one frame; the scan reads the frame's days only."""
    from netweave.shape import densify

    frame = nw.trade_edges(spark, d, frames=(44, 45))
    return densify(tn.subject_mean(frame, nw.trade_shape(spark, d)).drop("t"), nw.trade_shape(spark, d)).select("i", "j", "w")


@query("overview_metrics", f"""WITH {cat.TRADE}, {cat.BOTH}
SELECT count(DISTINCT subj) AS subjects, max(i) + 1 AS nodes, max(t) + 1 AS frames FROM ends""")
def overview_metrics(spark, d):
    """Dimensions discovered from the data."""
    edges = nw.trade_edges(spark, d)
    return edges.agg(
        F.countDistinct("subj").alias("subjects"), (F.max(F.greatest("i", "j")) + 1).alias("nodes"), (F.max("t") + 1).alias("frames")
    )


@query("first_occurrences", "SELECT user_id AS subj, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def first_occurrences(spark, d):
    """Distinct event types per user in the order they first appear."""
    events = table(spark, d, "events").select(F.col("user_id").alias("subj"), "event_type", "event_id")
    return gr.first_occurrences(events, ["subj"], "event_type", "event_id").select("subj", "event_type", "event_id")


@query("mode_product", f"""WITH {cat.TRADE}, {cat.BOTH}
SELECT subj, n_regionkey::BIGINT AS region, j, t, sum(w * 0.5) AS w FROM ends JOIN nation ON i = n_nationkey GROUP BY 1, 2, 3, 4""")
def mode_product(spark, d):
    """Contract one node mode with the region membership matrix (entries 1/2)."""
    matrix = table(spark, d, "nation").select(
        F.col("n_regionkey").cast("bigint").alias("row"), F.col("n_nationkey").cast("bigint").alias("col"), F.lit(0.5).alias("m")
    )
    out = tn.mode_product(tn.mirrored(nw.trade_edges(spark, d)), matrix, "i")
    return out.select("subj", F.col("i").alias("region"), "j", "t", "w")


@query("mode_gram", f"""WITH {cat.TRADE}, {cat.BOTH}
SELECT 'subject' AS mode, a.subj AS r, b.subj AS c, sum(a.w * b.w) AS g
FROM ends a JOIN ends b ON a.i = b.i AND a.j = b.j AND a.t = b.t GROUP BY 1, 2, 3
UNION ALL
SELECT 'node', a.i::VARCHAR, b.i::VARCHAR, sum(a.w * b.w) FROM ends a JOIN ends b ON a.subj = b.subj AND a.j = b.j AND a.t = b.t
GROUP BY 1, 2, 3""")
def mode_gram(spark, d):
    grams = fr.frame_grams(fr.pack_frames(nw.trade_edges(spark, d), nw.trade_shape(spark, d)), nw.trade_shape(spark, d))
    names = F.array(*[F.lit(s) for s in nw.trade_shape(spark, d).subjects])

    def name(c):
        return F.when(F.col("mode") == "subject", F.get(names, F.col(c).cast("int"))).otherwise(F.col(c).cast("string"))

    return grams.filter("g <> 0").select("mode", name("r").alias("r"), name("c").alias("c"), "g")


@query("subgraph", f"""WITH {cat.TRADE}, k AS (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')
SELECT subj, i, j, t, w FROM trade WHERE i IN (FROM k) AND j IN (FROM k)""")
def subgraph(spark, d):
    asia = table(spark, d, "region").filter("r_name = 'ASIA'")
    nodes = table(spark, d, "nation").join(asia, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    return tn.subgraph(nw.trade_edges(spark, d), nodes.select(F.col("n_nationkey").cast("bigint").alias("node"))).select(*CELL)


@query("interval_graphs", f"WITH {cat.GRAPHS} SELECT interval, subj, i, j, w FROM graphs")
def interval_graphs(spark, d):
    return trade_graphs(spark, d).select("interval", "subj", "i", "j", "w")


@query("mean_adjacency", f"WITH {cat.GMEAN} SELECT interval, i, j, round(w, 6) AS w FROM gmean")
def mean_adjacency(spark, d):
    return mean_graphs(spark, d).select("interval", "i", "j", *rounded(6, "w"))


@query("pooled_adjacency", f"""{DIRTY}, {cat.THIRDS}
SELECT interval, i, j, round(greatest(sum(w) / (any_value(e - s) * 5), 0), 6) AS w
FROM clean JOIN iv ON t >= s AND t < e GROUP BY 1, 2, 3""")
def pooled_adjacency(spark, d):
    edges = tn.symmetrise(dirty_flows(spark, d), clip=False)
    return tn.pooled_mean(edges, thirds(spark, d), nw.trade_shape(spark, d)).select("interval", "i", "j", *rounded(6, "w"))


# ---- low rank ----------------------------------------------------------------------------


@query("hosvd_low_rank", f"""WITH RECURSIVE {cat.TRADE}, {cat.BOTH},
 gs AS MATERIALIZED (SELECT a.subj AS r, b.subj AS c, sum(a.w * b.w) AS g FROM ends a JOIN ends b USING (i, j, t) GROUP BY 1, 2),
 gn AS MATERIALIZED (SELECT a.i AS r, b.i AS c, sum(a.w * b.w) AS g FROM ends a JOIN ends b USING (subj, j, t) GROUP BY 1, 2),
 su(k, r, x) AS (SELECT 0, r, 1.0::DOUBLE FROM (SELECT DISTINCT r FROM gs) UNION ALL
   SELECT k + 1, r, y / sqrt(sum(y * y) OVER ()) FROM (
     SELECT any_value(k) AS k, gs.r AS r, sum(g * x) AS y FROM su JOIN gs ON gs.c = su.r GROUP BY gs.r) WHERE k < 80),
 nu(k, r, x) AS (SELECT 0, r, 1.0::DOUBLE FROM (SELECT DISTINCT r FROM gn) UNION ALL
   SELECT k + 1, r, y / sqrt(sum(y * y) OVER ()) FROM (
     SELECT any_value(k) AS k, gn.r AS r, sum(g * x) AS y FROM nu JOIN gn ON gn.c = nu.r GROUP BY gn.r) WHERE k < 80),
 s1 AS MATERIALIZED (SELECT r, x FROM su WHERE k = 80), n1 AS MATERIALIZED (SELECT r, x FROM nu WHERE k = 80),
 core AS (SELECT t, sum(w * s1.x * a.x * b.x) AS c FROM ends JOIN s1 ON s1.r = subj JOIN n1 a ON a.r = i JOIN n1 b ON b.r = j GROUP BY 1)
SELECT s1.r AS subj, a.r AS i, b.r AS j, t, round(s1.x * a.x * b.x * c, 3) AS w FROM core, s1, n1 a, n1 b WHERE a.r < b.r""")
def hosvd_low_rank(spark, d):
    """Every cell of the projection onto the leading subject and node directions."""
    shape = nw.trade_shape(spark, d)
    low = lr.hosvd_low_rank(fr.stage_frames(nw.trade_edges(spark, d), shape), shape, (1, 1))
    return low.select("subj", "i", "j", "t", *rounded(3, "w"))


PLANTED = f"""{cat.TRADE}, planted AS (SELECT subj, i, j, t, w * CASE WHEN a.n_regionkey = b.n_regionkey THEN 8.0 ELSE 1.0 END::DOUBLE AS w
   FROM trade JOIN nation a ON a.n_nationkey = i JOIN nation b ON b.n_nationkey = j),
 pe AS (SELECT subj, i, j, t, w FROM planted UNION ALL SELECT subj, j, i, t, w FROM planted)"""

# ranks (3, 6): every cell of the projection by the projectors of both modes
HOSVD = f"""WITH RECURSIVE {PLANTED},
 subj_names AS (SELECT DISTINCT c_mktsegment AS s FROM customer WHERE c_mktsegment IS NOT NULL),
 pgs AS MATERIALIZED (SELECT x.s AS r, y.s AS c, coalesce(g, 0)::DOUBLE AS g FROM subj_names x CROSS JOIN subj_names y LEFT JOIN
   (SELECT a.subj AS r, b.subj AS c, sum(a.w * b.w) AS g FROM pe a JOIN pe b USING (i, j, t) GROUP BY 1, 2) k ON k.r = x.s AND k.c = y.s),
 pgn AS MATERIALIZED (SELECT x.range AS r, y.range AS c, coalesce(g, 0)::DOUBLE AS g FROM range(25) x CROSS JOIN range(25) y LEFT JOIN
   (SELECT a.i AS r, b.i AS c, sum(a.w * b.w) AS g FROM pe a JOIN pe b USING (subj, j, t) GROUP BY 1, 2) k ON k.r = x.range AND k.c = y.range),
 {cat.projector("ps", "pgs", 3)},
 {cat.projector("pn", "pgn", 6)},
 l1 AS MATERIALIZED (SELECT ps.r AS subj, i, j, t, sum(p * w) AS w FROM pe JOIN ps ON ps.c = subj GROUP BY 1, 2, 3, 4),
 l2 AS MATERIALIZED (SELECT subj, pn.r AS i, j, t, sum(p * w) AS w FROM l1 JOIN pn ON pn.c = i GROUP BY 1, 2, 3, 4),
 l3 AS (SELECT subj, i, pn.r AS j, t, sum(p * w) AS w FROM l2 JOIN pn ON pn.c = j WHERE i < pn.r GROUP BY 1, 2, 3, 4)
SELECT subj, i, j, t, round(w, 4) AS w FROM l3"""


@query("hosvd_edges", HOSVD)
def hosvd_edges(spark, d):
    frames = fr.stage_frames(nw.planted_edges(spark, d), nw.trade_shape(spark, d))
    return lr.hosvd_low_rank(frames, nw.trade_shape(spark, d), (3, 6)).select("subj", "i", "j", "t", *rounded(4, "w"))


@query("hosvd_block_edges", HOSVD)
def hosvd_block_edges(spark, d):
    """The same projection by block iteration over the edge table, as large modes need."""
    shape = nw.trade_shape(spark, d)
    cells = stage(pair_spine(spark, shape, by_subject=True))
    return ss.fitted_at(nw.planted_edges(spark, d), cells, (3, 6)).select("subj", "i", "j", "t", *rounded(4, "w"))


# the mean over months of what a customer buys from a supplier, nodes being customers (even) and suppliers (odd)
PARTIES = """party AS (SELECT least(2 * o_custkey, 2 * l_suppkey + 1)::BIGINT AS i, greatest(2 * o_custkey, 2 * l_suppkey + 1)::BIGINT AS j,
   sum(l_quantity)::DOUBLE AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
 pp AS (SELECT i, j, w FROM party UNION ALL SELECT j, i, w FROM party)"""


@query("party_low_rank", f"""WITH RECURSIVE {PARTIES},
 z(k, r, x) AS (SELECT 0, i, 1.0::DOUBLE FROM (SELECT DISTINCT i FROM pp) UNION ALL
   SELECT k + 1, r, y / sqrt(sum(y * y) OVER ()) FROM (SELECT any_value(k) AS k, a.i AS r, sum(a.w * h) AS y
     FROM (SELECT any_value(k) AS k, b.i AS m, sum(b.w * x) AS h FROM z JOIN pp b ON b.j = z.r GROUP BY b.i) JOIN pp a ON a.j = m GROUP BY a.i) WHERE k < 60),
 u AS (SELECT r, x / sqrt(sum(x * x) OVER (PARTITION BY r % 2)) AS x FROM z WHERE k = 60),
 c AS (SELECT sum(w * a.x * b.x) AS c FROM party JOIN u a ON a.r = i JOIN u b ON b.r = j)
SELECT i, j, round(a.x * b.x * c, 3) AS w FROM party JOIN u a ON a.r = i JOIN u b ON b.r = j, c""")
def party_low_rank(spark, d):
    """What the strongest directions of customers and of suppliers say about each link between them; the mode has no size bound."""
    edges = stage(nw.party_edges(spark, d))
    return ss.fitted_at(edges, edges, (1, 2), ss.SubspaceConfig(tolerance=1e-11)).select("i", "j", *rounded(3, "w"))


# ---- graphs without a size bound ---------------------------------------------------------


# customers and suppliers form two sides: the square of the scaled network has the supplier side alone
PARTY_CUT = f"""WITH RECURSIVE {PARTIES}, deg AS (SELECT i AS node, sum(w) AS d FROM pp GROUP BY 1),
 n AS MATERIALIZED (SELECT i, j, w / sqrt(a.d * b.d) AS n FROM pp JOIN deg a ON a.node = i JOIN deg b ON b.node = j),
 sides AS (SELECT DISTINCT i AS s FROM n WHERE i % 2 = 1),
 total AS (SELECT sum(d) AS t FROM deg WHERE node % 2 = 1),
 h AS MATERIALIZED (SELECT x.s AS r, y.s AS c, coalesce(g, 0) - sqrt(a.d * b.d) / t AS g FROM sides x CROSS JOIN sides y JOIN deg a ON a.node = x.s JOIN deg b ON b.node = y.s
   CROSS JOIN total LEFT JOIN (SELECT a.i AS r, b.i AS c, sum(a.n * b.n) AS g FROM n a JOIN n b USING (j) WHERE a.i % 2 = 1 AND b.i % 2 = 1 GROUP BY 1, 2) k
   ON k.r = x.s AND k.c = y.s),
 {cat.projector("pv", "h", 1)},
 best AS (SELECT c FROM pv WHERE r = c ORDER BY p DESC LIMIT 1),
 su AS (SELECT pv.r AS node, pv.p / sqrt(d.p) AS v FROM pv JOIN best USING (c) JOIN pv d ON d.r = best.c AND d.c = best.c),
 lam AS (SELECT sqrt(sum(a.v * h.g * b.v)) AS l FROM su a JOIN h ON h.r = a.node JOIN su b ON b.node = h.c),
 both_ AS (SELECT node, v / sqrt(2) AS v FROM su UNION ALL
   SELECT n.i, sum(n.n * su.v) / any_value(l) / sqrt(2) FROM n JOIN su ON su.node = n.j, lam WHERE n.i % 2 = 0 GROUP BY 1),
 gaps AS (SELECT v, v - lag(v) OVER (ORDER BY v) AS gap, row_number() OVER (ORDER BY v) - 1 AS below, count(*) OVER () AS n FROM both_),
 w AS (SELECT * FROM gaps WHERE gap IS NOT NULL ORDER BY gap DESC LIMIT 1)"""


@query("party_spectral_cut", PARTY_CUT + """
SELECT round(1 - l, 6) AS eigenvalue, round(1 - l, 6) AS quotient, least(below, n - below) AS smaller, greatest(below, n - below) AS larger FROM w, lam""")
def party_spectral_cut(spark, d):
    """Customers and suppliers cut at the widest gap of the second eigenvector of the normalised Laplacian; its Rayleigh quotient is recomputed."""
    edges = stage(nw.party_edges(spark, d))
    found = lg.normalised_vector(edges, dataclasses.replace(lg.CUT, tolerance=1e-6))  # eigenvalues err by its square
    sizes = lg.gap_cut(found).groupBy("cond").agg(F.count_if(F.col("part") == 1).alias("a"), F.count_if(F.col("part") == 2).alias("b"))
    joined = sizes.join(lg.rayleigh(edges, found.vector), "cond")
    return joined.select(
        F.round(F.lit(found.value["party"]), 6).alias("eigenvalue"), *rounded(6, "quotient"),
        F.least("a", "b").alias("smaller"), F.greatest("a", "b").alias("larger"),
    )


@query("party_communities")
def party_communities(spark, d):
    """Communities of customers and suppliers by parallel modularity moves."""
    return lg.modularity_moves(nw.party_edges(spark, d)).select("node", "community")


# ---- graph views -------------------------------------------------------------------------


@query("topk_edges", f"""WITH {cat.GMEAN}
SELECT interval, i, j, rank FROM (SELECT *, row_number() OVER (PARTITION BY interval ORDER BY w DESC, i, j) AS rank
  FROM gmean WHERE w > 0) WHERE rank <= 35""")
def topk_edges(spark, d):
    top = gr.strongest_edges(mean_graphs(spark, d), GRAPH_KEYS)
    return top.select("interval", "i", "j", F.col("rank").cast("bigint").alias("rank"))


@query("edge_display_scale", f"""WITH {cat.GMEAN},
 top AS (SELECT *, row_number() OVER (PARTITION BY interval ORDER BY w DESC, i, j) AS rank FROM gmean WHERE w > 0)
SELECT interval, i, j, round(CASE WHEN hi - lo <= 1e-12 THEN 1 ELSE (w - lo) / (hi - lo) END, 6) AS scaled FROM (
 SELECT *, min(w) OVER (PARTITION BY interval) AS lo, max(w) OVER (PARTITION BY interval) AS hi FROM top WHERE rank <= 35)""")
def edge_display_scale(spark, d):
    top = gr.strongest_edges(mean_graphs(spark, d), GRAPH_KEYS)
    return gr.display_scale(top, GRAPH_KEYS).select("interval", "i", "j", *rounded(6, "scaled"))


@query("node_metrics", f"""WITH {cat.GMEAN}, {cat.LABELS},
 top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY interval ORDER BY w DESC, i, j) AS rank FROM gmean WHERE w > 0) WHERE rank <= 35),
 e AS (SELECT g.interval, g.i, g.j, g.w, top.w AS tw FROM gmean g LEFT JOIN top ON g.interval = top.interval AND g.i = top.i AND g.j = top.j),
 u AS (SELECT interval, i AS node, w, tw FROM e UNION ALL SELECT interval, j, w, tw FROM e)
SELECT interval, node, community, round(sum(w), 4) AS strength, count(tw) AS top_degree, round(coalesce(sum(tw), 0), 4) AS top_strength
FROM u JOIN lab USING (node) GROUP BY 1, 2, 3""")
def node_metrics(spark, d):
    out = gr.node_metrics(mean_graphs(spark, d), nw.region_labels(spark, d), GRAPH_KEYS)
    return out.select("interval", "node", "community", "top_degree", *rounded(4, "strength", "top_strength")).orderBy(
        "community", F.col("top_strength").desc()
    )


@query("isolated_nodes", f"""WITH {cat.TRADE}, {cat.BOTH}, {cat.LABELS},
 linked AS (SELECT subj, t, i AS node FROM ends JOIN lab a ON i = a.node JOIN lab b ON j = b.node AND a.community = b.community
   GROUP BY 1, 2, 3 HAVING sum(w) > 1e-12)
SELECT subj, t, node, community FROM (SELECT * FROM (SELECT DISTINCT subj, t FROM trade), lab)
ANTI JOIN linked USING (subj, t, node)""")
def isolated_nodes(spark, d):
    graphs = stage(nw.trade_edges(spark, d).select("subj", "t", "i", "j", "w"))
    return gr.isolated_nodes(graphs, nw.region_labels(spark, d), ["subj", "t"]).select("subj", "t", "node", "community")


@query("community_sort", f"""WITH {cat.LABELS}
SELECT node, community, row_number() OVER (ORDER BY community, node) - 1 AS position FROM lab""")
def community_sort(spark, d):
    labels = nw.region_labels(spark, d).withColumn("cond", F.lit("trade"))
    return gr.community_order(labels, ["cond"]).select("node", "community", F.col("position").cast("bigint").alias("position"))


@query("relabel_partition", f"""WITH {cat.TRADE}, {cat.BOTH},
 s AS (SELECT i AS node, (sum(w)::BIGINT) % 7 AS c FROM ends GROUP BY 1),
 f AS (SELECT c, dense_rank() OVER (ORDER BY min(node)) AS community FROM s GROUP BY 1)
SELECT node, community FROM s JOIN f USING (c)""")
def relabel_partition(spark, d):
    strength = tn.mirrored(nw.trade_edges(spark, d)).groupBy("cond", F.col("i").alias("node")).agg(F.sum("w").alias("w"))
    labels = strength.select("cond", "node", (F.col("w").cast("bigint") % 7).alias("community"))
    return gr.relabel(labels, ["cond"]).select("node", "community")


@query("cooccurrence", f"""WITH {cat.TRADE}, {cat.BOTH},
 s AS (SELECT subj, t, i AS node, sum(w)::BIGINT AS w FROM ends GROUP BY 1, 2, 3),
 l AS (SELECT subj, t, node, coalesce(w, 0) % 3 AS c FROM (SELECT * FROM (SELECT DISTINCT subj, t FROM trade), (SELECT range AS node FROM range(25)))
   LEFT JOIN s USING (subj, t, node)),
 n AS (SELECT count(*) AS n FROM (SELECT DISTINCT subj, t FROM trade))
SELECT a.node AS i, b.node AS j, round(count(*) / any_value(n), 6) AS w
FROM l a JOIN l b ON a.subj = b.subj AND a.t = b.t AND a.c = b.c AND a.node < b.node, n GROUP BY 1, 2""")
def cooccurrence(spark, d):
    """Agreement of per-frame labels; the label is the node's traded quantity modulo 3."""
    edges = nw.trade_edges(spark, d)
    strength = tn.mirrored(edges).groupBy("cond", "subj", "t").agg(
        *[F.sum(F.when(F.col("i") == k, F.col("w")).otherwise(0.0)).alias(f"s{k}") for k in range(nw.trade_shape(spark, d).n_nodes)]
    )
    labels = strength.select("cond", "subj", "t", F.posexplode(F.array(*[f"s{k}" for k in range(nw.trade_shape(spark, d).n_nodes)])).alias("node", "s"))
    labels = labels.select("cond", "subj", "t", "node", (F.col("s").cast("bigint") % 3).alias("community"))
    return gr.cooccurrence(labels, ["cond"], ["subj", "t"], nw.trade_shape(spark, d).n_nodes).select("i", "j", *rounded(6, "w"))


@query("modularity", f"""WITH {cat.GMEAN}, {cat.LABELS},
 e AS (SELECT interval, i, j, w FROM gmean UNION ALL SELECT interval, j, i, w FROM gmean),
 p AS (SELECT interval, a.community, sum(w) AS deg, sum(CASE WHEN a.community = b.community THEN w ELSE 0 END) AS ins
   FROM e JOIN lab a ON i = a.node JOIN lab b ON j = b.node GROUP BY 1, 2),
 s AS (SELECT interval, sum(deg) AS m FROM p GROUP BY 1)
SELECT interval, round(sum(ins / m - (deg / m) * (deg / m)), 6) AS q FROM p JOIN s USING (interval) GROUP BY 1""")
def modularity(spark, d):
    return gr.modularity(mean_graphs(spark, d), nw.region_labels(spark, d), GRAPH_KEYS).select("interval", *rounded(6, "q"))


# ---- rank quality ------------------------------------------------------------------------


def ranks(spark, d):
    return ql.rank_bins(trade_graphs(spark, d), nw.trade_shape(spark, d).n_nodes, nw.trade_shape(spark, d).subjects, thirds(spark, d))


def histograms(spark, d):
    return ql.rank_histograms(ql.pooled_ranks(ranks(spark, d)), interval_labels(spark, d))


@query("rank_bins", f"WITH {cat.RANKS} SELECT interval, subj, i, j, rank FROM ranks")
def rank_bins(spark, d):
    return ranks(spark, d).select("interval", "subj", "i", "j", "rank")


@query("rank_hist", f"WITH {cat.HISTS} SELECT interval, community, rank, intra, inter FROM hist")
def rank_hist(spark, d):
    return histograms(spark, d).select("interval", "community", "rank", "intra", "inter")


@query("cluster_entropy", f"WITH {cat.CLUSTERS} SELECT interval, community, round(entropy, 6) AS entropy FROM clusters")
def cluster_entropy(spark, d):
    return ql.cluster_quality(histograms(spark, d)).select("interval", "community", *rounded(6, "entropy"))


@query("cluster_quality", f"""WITH {cat.CLUSTERS} SELECT interval, community, size, round(h, 6) AS h, round(c, 6) AS c FROM clusters""")
def cluster_quality(spark, d):
    return ql.cluster_quality(histograms(spark, d)).select("interval", "community", "size", *rounded(6, "h", "c"))


@query("partition_quality", f"""WITH {cat.CLUSTERS}, m AS (SELECT interval, avg(h) AS h, avg(c) AS c FROM clusters GROUP BY 1)
SELECT interval, round(h, 6) AS h, round(c, 6) AS c, round(CASE WHEN h > 0 AND c > 0 THEN 2 / (1 / h + 1 / c) ELSE 0 END, 6) AS u FROM m""")
def partition_quality(spark, d):
    return ql.partition_quality(ql.cluster_quality(histograms(spark, d))).select("interval", *rounded(6, "h", "c", "u"))


@query("choose_split", f"""WITH {cat.CLUSTERS},
 v AS (SELECT interval, g.range AS g, arg_min(community, struct_pack(z := c * (g.range * 0.1::DOUBLE) + h * (1 - g.range * 0.1::DOUBLE), k := community)) AS community
   FROM clusters, range(11) g WHERE size >= 4 GROUP BY 1, 2),
 n AS (SELECT interval, community, count(*) AS votes FROM v GROUP BY 1, 2)
SELECT interval, arg_max(community, struct_pack(v := votes, k := -community)) AS community, max(votes) AS votes FROM n GROUP BY 1""")
def choose_split(spark, d):
    return ql.choose_split(ql.cluster_quality(histograms(spark, d)), 2).select("interval", "community", "votes")


# ---- communities -------------------------------------------------------------------------


def planted_selection(spark, d):
    graphs = tn.interval_graphs(nw.planted_edges(spark, d), thirds(spark, d))
    return cm.select_communities(graphs, nw.trade_shape(spark, d), k_max=6, min_size=3)


@query("fcca_labels")
def fcca_labels(spark, d):
    labels, _, _ = planted_selection(spark, d)
    return labels.select("interval", "k", "node", "community")


@query("fcca_quality_table")
def fcca_quality_table(spark, d):
    _, quality, _ = planted_selection(spark, d)
    return quality.select("interval", "k", *rounded(6, "selection_score", "u", "h", "c", "q"))


# every subject's interval graph: I + N has the eigenvectors of the normalised Laplacian I - N, in the opposite order; its first one is
# the root of the degrees. Nodes without an edge have eigenvalue 0 in the operator's scaling, where a row of I - N is that of I.
GAP_SPLIT = f"""WITH RECURSIVE {cat.GRAPHS}, keyed AS (SELECT interval || '|' || subj AS key, i, j, w FROM graphs WHERE w > 0),
 fe AS (SELECT key, i, j, w FROM keyed UNION ALL SELECT key, j, i, w FROM keyed),
 fd AS MATERIALIZED (SELECT key, i AS node, sum(w) AS d FROM fe GROUP BY 1, 2),
 ft AS (SELECT key, sum(d) AS total FROM fd GROUP BY 1),
 fh AS MATERIALIZED (SELECT key, x.range AS r, y.range AS c, CASE WHEN x.range = y.range THEN 1 ELSE 0 END + coalesce(w / sqrt(a.d * b.d), 0)
     - 2 * coalesce(sqrt(a.d * b.d), 0) / total AS g
   FROM ft CROSS JOIN range(25) x CROSS JOIN range(25) y LEFT JOIN fe USING (key) LEFT JOIN fd a ON a.key = ft.key AND a.node = x.range
   LEFT JOIN fd b ON b.key = ft.key AND b.node = y.range WHERE fe.i = x.range AND fe.j = y.range
   UNION ALL
   SELECT ft.key, x.range, y.range, CASE WHEN x.range = y.range THEN 1 ELSE 0 END - 2 * coalesce(sqrt(a.d * b.d), 0) / total
   FROM ft CROSS JOIN range(25) x CROSS JOIN range(25) y LEFT JOIN fd a ON a.key = ft.key AND a.node = x.range LEFT JOIN fd b ON b.key = ft.key AND b.node = y.range
   WHERE NOT EXISTS (SELECT 1 FROM fe WHERE fe.key = ft.key AND fe.i = x.range AND fe.j = y.range)),
 {cat.projector("fp", "fh", 1, "key")},
 top_node AS (SELECT key, arg_max(r, p) AS strongest FROM fp WHERE r = c GROUP BY 1),
 fv AS MATERIALIZED (SELECT key, r AS node, p AS v FROM fp JOIN top_node USING (key) WHERE c = strongest),
 gaps AS (SELECT key, lag(v) OVER w AS low, v - lag(v) OVER w AS gap FROM fv WINDOW w AS (PARTITION BY key ORDER BY v)),
 cut AS (SELECT key, arg_max(low, gap) AS low FROM gaps WHERE gap IS NOT NULL GROUP BY 1),
 sides AS (SELECT key, node, v <= low AS side FROM fv JOIN cut USING (key)),
 zero AS (SELECT key, side AS first FROM sides WHERE node = 0)"""


@query("fiedler_cut", GAP_SPLIT + """
SELECT split_part(key, '|', 1) AS interval, split_part(key, '|', 2) AS subj, node, side = first AS with_node_0 FROM sides JOIN zero USING (key)""")
def fiedler_cut(spark, d):
    """The gap split as sets: which nodes of every subject's interval graph fall on the side of node 0 (the vector's sign is open)."""
    labels = stage(fiedler_split(spark, d))
    zero = labels.where("node = 0").select("interval", "subj", F.col("community").alias("first"))
    return labels.join(zero, ["interval", "subj"]).select("interval", "subj", "node", (F.col("community") == F.col("first")).alias("with_node_0"))


@query("fiedler_split")
def fiedler_split(spark, d):
    """Gap split of every subject's interval graph."""
    packed = cm.pack_graphs(trade_graphs(spark, d), ["interval", "subj"], nw.trade_shape(spark, d).n_nodes)
    split = cm.map_graphs(packed, ["interval", "subj"], nw.trade_shape(spark, d).n_nodes, lambda stack, _: (gap_parts(stack), 0.0, "gap"))
    return cm.label_rows(split, ["interval", "subj"])


@query("recursive_fiedler")
def recursive_fiedler(spark, d):
    graphs = tn.interval_graphs(nw.planted_edges(spark, d), thirds(spark, d))
    packed = cm.pack_graphs(graphs, ["interval", "subj"], nw.trade_shape(spark, d).n_nodes)
    split = cm.map_graphs(packed, ["interval", "subj"], nw.trade_shape(spark, d).n_nodes, lambda stack, _: (*cm.recursive_parts(stack), "recursive"))
    return cm.label_rows(split, ["interval", "subj"], base=1)


@query("frame_communities")
def frame_communities(spark, d):
    labelled = cm.frame_communities(nw.planted_edges(spark, d), nw.trade_shape(spark, d))
    return cm.label_rows(labelled, ["subj", "t"])


@query("consensus_communities")
def consensus_communities(spark, d):
    labelled = cm.frame_communities(nw.planted_edges(spark, d), nw.trade_shape(spark, d))
    agreement = cm.interval_agreement(labelled, thirds(spark, d), nw.trade_shape(spark, d))
    found = cm.consensus_communities(agreement, nw.trade_shape(spark, d))
    return found.select("interval", F.round("score", 6).alias("score"), "method", F.explode(F.arrays_zip("nodes", "comms")).alias("x")).select(
        "interval", "score", "method", F.col("x.nodes").alias("node"), F.col("x.comms").alias("community")
    )
