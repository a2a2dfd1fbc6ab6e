"""Segmentation, detectors, trackers and the change points read off them."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Window
from pyspark.sql import functions as F

from netweave.functions import scalar as sc
from netweave.operators import detectors as dt
from netweave.operators import frames as fr
from netweave.operators import lowrank as lr
from netweave.operators import graphs as gr
from netweave.operators import long_signals as ls
from netweave.operators import segmentation as seg
from netweave.operators import tensor as tn
from netweave.operators import tracker as tr
from netweave.operators.tracker_config import Change, Recovery, Selection, Subspace
from netweave.plans import catalog as cat
from netweave.plans import network_queries as nq
from netweave.plans import study
from netweave.plans.catalog import query, rounded
from netweave.sources import networks as nw
from netweave.streaming import tracker as stt

# the month clock of the trade tensor: frame number itself
MONTHS = lambda t: t.cast("double")
TRACKER = tr.TrackerConfig(
    Subspace(train=24, block=6, floor=0.11, node_cap=8, subject_cap=3), selection=Selection(rate=None, window_ms=None)
)
# settings whose thresholds, not rank caps, decide: directions come and go
FREE_TRACKER = tr.TrackerConfig(
    Subspace(train=24, block=6, floor=0.25, node_cap=25, subject_cap=5),
    selection=Selection(rate=None, window_ms=(20.0, 60.0), anchor_ms=44.0),
)


def features(spark, d):
    return tn.zscore_features(tn.subject_mean(nw.trade_edges(spark, d), nw.trade_shape(spark, d)), nw.trade_shape(spark, d))


def energy(spark, d):
    return dt.fill_signal(tn.mean_graph_energy(nw.trade_edges(spark, d), nw.trade_shape(spark, d)), nw.trade_shape(spark, d))


def quantity_signal(spark, d):
    """Whole-valued signal: traded quantity per month."""
    total = nw.trade_edges(spark, d).groupBy("cond", "t").agg(F.sum("w").alias("v"))
    return dt.fill_signal(total, nw.trade_shape(spark, d))


QUANTITY = f"{cat.TRADE}, {cat.FRAMES}, q AS (SELECT t, coalesce(v, 0) AS v FROM frames LEFT JOIN (SELECT t, sum(w) AS v FROM trade GROUP BY 1) USING (t))"


# ---- features and exact segmentation -----------------------------------------------------


@query("zscore_features", f"WITH {cat.ZSCORES} SELECT i, j, t, round(z, 6) AS z FROM z")
def zscore_features(spark, d):
    return features(spark, d).select("i", "j", "t", *rounded(6, "z"))


@query("prefix_sums", f"WITH {cat.PREFIX} SELECT i, j, pos, round(s, 5) + 0 AS s, round(q, 5) + 0 AS q FROM pre")
def prefix_sums(spark, d):
    return seg.prefix_sums(features(spark, d)).select("i", "j", "pos", *rounded(5, "s", "q"))


@query("segment_sse", f"WITH {cat.SEGMENTS} SELECT s AS start, e AS \"end\", round(c, 3) AS sse FROM cost WHERE s = 0 OR s >= 10")
def segment_sse(spark, d):
    costs = seg.segment_costs(seg.stage(seg.prefix_vectors(features(spark, d))), 10)
    return costs.select("start", "end", F.round("cost", 3).alias("sse"))


@query("exact_cp2", f"WITH {cat.SEGMENTS} SELECT b1, b2, round(sse, 3) AS sse FROM best")
def exact_cp2(spark, d):
    found = seg.detect_exact(nw.trade_edges(spark, d), nw.trade_shape(spark, d))
    return found.select(F.col("boundaries")[0].alias("b1"), F.col("boundaries")[1].alias("b2"), F.round("sse", 3).alias("sse"))


REGIMES = f"""{cat.SEGMENTS},
 iv AS (SELECT unnest(['pre', 'core', 'post']) AS interval, unnest([0, b1, b2]) AS s, unnest([b1, b2, 83]) AS e FROM best)"""


@query("intervals_from_cps", f"WITH {REGIMES} SELECT interval, s::BIGINT AS start, e::BIGINT AS \"end\" FROM iv")
def intervals_from_cps(spark, d):
    return seg.intervals_from_points(seg.detect_exact(nw.trade_edges(spark, d), nw.trade_shape(spark, d)), nw.trade_shape(spark, d).n_frames).select("interval", "start", "end")


@query("regime_edges", f"""WITH {REGIMES},
 g AS (SELECT interval, subj, i, j, CAST(sum(w) / any_value(e - s) AS FLOAT)::DOUBLE AS w FROM trade JOIN iv ON t >= s AND t < e GROUP BY 1, 2, 3, 4),
 m AS (SELECT interval, i, j, sum(w) / 5 AS w FROM g GROUP BY 1, 2, 3)
SELECT interval, rank, i, j, round(w, 4) AS w FROM (SELECT *, row_number() OVER (PARTITION BY interval ORDER BY w DESC, i, j) AS rank FROM m WHERE w > 0)
WHERE rank <= 10""")
def regime_edges(spark, d):
    """Regime changes of the trade network and the strongest mean edges of each regime."""
    edges = seg.stage(nw.trade_edges(spark, d))
    intervals = seg.intervals_from_points(seg.detect_exact(edges, nw.trade_shape(spark, d)), nw.trade_shape(spark, d).n_frames)
    mean = tn.group_mean(tn.interval_graphs(edges, intervals), nw.trade_shape(spark, d))
    top = gr.strongest_edges(mean, ["cond", "interval"], 10)
    return top.select("interval", F.col("rank").cast("bigint").alias("rank"), "i", "j", *rounded(4, "w"))


@query("thirds_split", f"""WITH {cat.TRADE}, f AS (SELECT range AS t, ntile(3) OVER (ORDER BY range) AS third FROM range(83))
SELECT CASE third WHEN 1 THEN 'pre' WHEN 2 THEN 'core' ELSE 'post' END AS interval, count(DISTINCT t) AS frames, sum(w) AS total
FROM f JOIN trade USING (t) GROUP BY 1""")
def thirds_split(spark, d):
    """Any change-point count other than 2 or 4 falls back to equal thirds."""
    edges = seg.stage(nw.trade_edges(spark, d))
    peak = edges.groupBy("cond", "t").agg(F.sum("w").alias("v")).groupBy("cond").agg(F.array(F.max_by("t", "v")).alias("boundaries"))
    split = tn.interval_slice(edges, seg.intervals_from_points(peak, nw.trade_shape(spark, d).n_frames))
    return split.groupBy("interval").agg(F.countDistinct("t").alias("frames"), F.sum("w").alias("total"))


# ---- signals and their change points -----------------------------------------------------


@query("rank1_distance", f"""WITH {cat.TRADE}, {cat.BOTH}, {cat.FRAMES},
 s AS (SELECT node, t, coalesce(w, 0) AS w FROM (SELECT * FROM (SELECT range AS node FROM range(25)), frames)
   LEFT JOIN (SELECT i AS node, t, sum(w) AS w FROM ends GROUP BY 1, 2) USING (node, t)),
 u AS (SELECT node, t, coalesce(sum(w) OVER (PARTITION BY node ORDER BY t ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), 0) AS u FROM s),
 p AS (SELECT t, u, lag(u) OVER (PARTITION BY node ORDER BY t) AS p FROM u)
SELECT t, round(CASE WHEN t > 12 THEN 1 - abs(sum(u * p)) / ((sqrt(sum(u * u)) + 1e-8) * (sqrt(sum(p * p)) + 1e-8)) ELSE 0 END, 6) AS v
FROM p GROUP BY t""")
def rank1_distance(spark, d):
    return dt.rank1_shift(nw.trade_edges(spark, d), nw.trade_shape(spark, d), 12).select("t", *rounded(6, "v"))


# node subspaces (rank 5) of trailing windows of ``w`` months, half a window apart
def _windows_sql(width: int, name: str) -> str:
    step = max(width // 2, 1)
    return f"""{name}_w AS (SELECT range AS e FROM range({width}, 83, {step})),
 {name}_g AS MATERIALIZED (SELECT e, r, c, coalesce(g, 0)::DOUBLE AS g FROM (SELECT e, x.range AS r, y.range AS c FROM {name}_w, range(25) x, range(25) y) LEFT JOIN
   (SELECT e, r, c, sum(g) AS g FROM fg JOIN {name}_w ON t >= e - {width} AND t < e GROUP BY 1, 2, 3) USING (e, r, c)),
 {cat.projector(f"{name}_p", f"{name}_g", 5, "e")}"""


FRAME_GRAMS = f"""{cat.TRADE}, {cat.BOTH}, fg AS MATERIALIZED (SELECT a.t, a.i AS r, b.i AS c, sum(a.w * b.w) AS g FROM ends a JOIN ends b USING (subj, j, t) GROUP BY 1, 2, 3)"""


@query("hosvd_grassmann", f"""WITH RECURSIVE {FRAME_GRAMS}, {cat.FRAMES}, {_windows_sql(12, "m")},
 d AS (SELECT a.e - 3 AS t, 1 - sum(a.p * b.p) / 5 AS v FROM m_p a JOIN m_p b ON a.e = b.e + 6 AND a.r = b.r AND a.c = b.c GROUP BY 1)
SELECT t, round(coalesce(v, 0), 6) AS v FROM frames LEFT JOIN d USING (t)""")
def hosvd_grassmann(spark, d):
    frames = fr.pack_frames(nw.trade_edges(spark, d), nw.trade_shape(spark, d))
    return dt.grassmann_shift(frames, nw.trade_shape(spark, d), 12, 5).select("t", *rounded(6, "v"))


@query("window_centres", f"""WITH RECURSIVE {FRAME_GRAMS}, {_windows_sql(12, "m")},
 cells AS (SELECT e - 3 AS t, e, s AS subj, x.range AS i, y.range AS j FROM m_w, (SELECT DISTINCT c_mktsegment AS s FROM customer WHERE c_mktsegment IS NOT NULL), range(25) x, range(25) y),
 low AS (SELECT m_p.e, subj, m_p.r AS i, j, sum(p * w) AS w FROM ends JOIN m_p ON t = m_p.e - 3 AND m_p.c = i GROUP BY 1, 2, 3, 4)
SELECT subj, i, j, t, round(coalesce(low.w, 0), 4) AS low_rank, round(coalesce(ends.w, 0) - coalesce(low.w, 0), 4) AS residual
FROM cells LEFT JOIN low USING (e, subj, i, j) LEFT JOIN ends USING (subj, i, j, t)""")
def window_centres(spark, d):
    frames = fr.pack_frames(nw.trade_edges(spark, d), nw.trade_shape(spark, d))
    out = dt.window_centres(frames, nw.trade_shape(spark, d), 12, 5)
    return out.select("subj", "i", "j", "t", *rounded(4, "low_rank", "residual"))


@query("dmd_shift")
def dmd_shift(spark, d):
    return dt.dmd_shift(nw.trade_edges(spark, d), nw.trade_shape(spark, d), 12, 5).select("t", *rounded(5, "v"))


@query("event_dmd_shift")
def event_dmd_shift(spark, d):
    """The same detector along the 720-frame event tensor."""
    return dt.dmd_shift(nw.event_edges(spark, d), nw.event_shape(spark, d), 48, 3).select("t", *rounded(4, "v"))


# optimal partitioning on multiples of 5, at least 6 frames per segment: one recursion step
# per position, carrying the best total and path of every earlier position
PARTITION = f"""WITH RECURSIVE {cat.ENERGY},
 p AS (SELECT list_prepend(0, list(s ORDER BY t)) AS s, list_prepend(0, list(q ORDER BY t)) AS q FROM (
   SELECT t, sum(v) OVER (ORDER BY t) AS s, sum(v * v) OVER (ORDER BY t) AS q FROM en)),
 pos AS (SELECT list_concat([0], list_concat(range(10, 83, 5), [83])) AS b),
 r(pen, k, tot, path) AS (
  SELECT pen, 1, [0.0::DOUBLE], [[]::BIGINT[]] FROM (SELECT unnest([5.0, 10.0, 20.0, 50.0, 100.0]::DOUBLE[]) AS pen)
  UNION ALL
  SELECT pen, k + 1, list_append(tot, best.c), list_append(path, list_append(path[best.j], b[best.j])) FROM (
   SELECT pen, k, tot, path, b, list_sort([struct_pack(c := tot[j] + q[b[k + 1] + 1] - q[b[j] + 1]
      - pow(s[b[k + 1] + 1] - s[b[j] + 1], 2) / (b[k + 1] - b[j]) + pen, j := j)
      for j in range(1, k + 1) if b[k + 1] - b[j] >= 6])[1] AS best FROM r, p, pos WHERE k < len(b))),
 done AS (SELECT pen, path[len(path)][2:] AS cps FROM r, pos WHERE k = len(b)),
 pick AS (SELECT arg_min(struct_pack(pen := pen, cps := cps), CASE WHEN len(cps) IN (3, 4) THEN pen ELSE 1e6 - pen END) AS x FROM done)"""


@query("pelt_cps", PARTITION + """
SELECT x.pen AS penalty, unnest(range(len(x.cps))) AS ord, unnest(x.cps) AS frame, unnest(x.cps)::DOUBLE - 1 AS ms FROM pick""")
def pelt_cps(spark, d):
    sweep = dt.penalty_sweep(energy(spark, d), nw.trade_shape(spark, d).n_frames, [5.0, 10.0, 20.0, 50.0, 100.0])
    chosen = dt.boundary_times(dt.choose_penalty(sweep), MONTHS)
    return chosen.select("penalty", F.col("ord").cast("bigint").alias("ord"), "frame", "ms")


# Gaussian-kernel scatter of every segment of the faded signal, then four rounds of dynamic
# programming with at least 9 frames per segment
KERNEL = f"""WITH {cat.ENERGY},
 x AS (SELECT t, v * CASE WHEN t >= 75 THEN 1 - (t - 75) / 7.0::DOUBLE WHEN t < 8 THEN t / 7.0::DOUBLE ELSE 1 END AS v FROM en),
 g AS (SELECT 1 / median(pow(a.v - b.v, 2)) AS g FROM x a JOIN x b ON a.t < b.t),
 k AS (SELECT a.t AS a, b.t AS b, CASE WHEN a.t = b.t THEN 1 ELSE exp(-least(greatest(g * pow(a.v - b.v, 2), 0.01), 100)) END AS k FROM x a, x b, g),
 c AS (SELECT s.range AS s, e.range AS e, (e.range - s.range) - sum(k) / (e.range - s.range) AS c
   FROM range(83) s JOIN range(84) e ON e.range - s.range >= 9 JOIN k ON a >= s.range AND a < e.range AND b >= s.range AND b < e.range GROUP BY 1, 2),
 d1 AS (SELECT e, c AS v, []::BIGINT[] AS p FROM c WHERE s = 0),
 d2 AS (SELECT c.e, min(v + c) AS v, arg_min(list_append(p, s), v + c) AS p FROM c JOIN d1 ON d1.e = s GROUP BY 1),
 d3 AS (SELECT c.e, min(v + c) AS v, arg_min(list_append(p, s), v + c) AS p FROM c JOIN d2 ON d2.e = s GROUP BY 1),
 d4 AS (SELECT c.e, min(v + c) AS v, arg_min(list_append(p, s), v + c) AS p FROM c JOIN d3 ON d3.e = s GROUP BY 1),
 d5 AS (SELECT c.e, min(v + c) AS v, arg_min(list_append(p, s), v + c) AS p FROM c JOIN d4 ON d4.e = s WHERE c.e = 83 GROUP BY 1)"""


@query("kernel_cps", KERNEL + " SELECT unnest(range(4)) AS ord, unnest(p) AS frame, unnest(p)::DOUBLE - 1 AS ms FROM d5")
def kernel_cps(spark, d):
    points = dt.kernel_change_points(energy(spark, d), nw.trade_shape(spark, d).n_frames)
    return dt.boundary_times(points, MONTHS).select(F.col("ord").cast("bigint").alias("ord"), "frame", "ms")


@query("hosvd_window_search")
def hosvd_window_search(spark, d):
    """Windows 6, 12 and 24: the one whose change points are spread most."""
    frames = fr.stage_frames(nw.trade_edges(spark, d), nw.trade_shape(spark, d))
    signals = [dt.grassmann_shift(frames, nw.trade_shape(spark, d), w, 5) for w in (6, 12, 24)]
    return dt.sweep_signals(signals, nw.trade_shape(spark, d).n_frames, MONTHS).select("ord", "boundaries", "score")


@query("plot_smoothing", f"""WITH {QUANTITY}
SELECT t, sum(v) OVER (ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS v FROM q""")
def plot_smoothing(spark, d):
    return dt.box_smooth(quantity_signal(spark, d), max(nw.trade_shape(spark, d).n_frames // 20, 5)).select("t", "v")


@query("taper", f"""WITH {QUANTITY}
SELECT t, round(v * CASE WHEN t >= 75 THEN 1 - (t - 75) / 7.0 WHEN t < 8 THEN t / 7.0 ELSE 1 END, 4) AS v FROM q""")
def taper(spark, d):
    return dt.faded(quantity_signal(spark, d), nw.trade_shape(spark, d).n_frames).select("t", *rounded(4, "v"))


@query("moving_average", f"""WITH {QUANTITY}, n AS (SELECT range AS k FROM range(-2, 3))
SELECT a.t, sum(b.v) / 5 AS v FROM q a, n JOIN q b ON b.t = least(greatest(a.t + k, 0), 82) GROUP BY 1""")
def moving_average(spark, d):
    smoothed = tr.smooth_scores(quantity_signal(spark, d), 5, "v", "t")
    return smoothed.select("t", F.col("smoothed").alias("v"))


@query("local_peaks", f"""WITH {QUANTITY}
SELECT t, v FROM (SELECT t, v, coalesce(lag(v) OVER (ORDER BY t), '-inf'::DOUBLE) AS l, coalesce(lead(v) OVER (ORDER BY t), '-inf'::DOUBLE) AS r FROM q)
WHERE v >= l AND v >= r""")
def local_peaks(spark, d):
    return tr.local_peaks(quantity_signal(spark, d), "v", "t").filter("peak").select("t", "v")


@query("spread_score", f"""WITH {QUANTITY},
 p AS (SELECT t FROM (SELECT t, v, lag(v) OVER (ORDER BY t) AS l, lead(v) OVER (ORDER BY t) AS r FROM q) WHERE v > l AND v > r)
SELECT count(*) AS points, coalesce(min(gap), 0)::DOUBLE AS score FROM (SELECT t - lag(t) OVER (ORDER BY t) AS gap FROM p)""")
def spread_score(spark, d):
    times = _strict_peaks(spark, d).select("cond", F.col("t").cast("double").alias("ms"))
    points = times.groupBy("cond").agg(F.count("*").alias("points"))
    return points.join(dt.spread_score(times, "cond"), "cond").select("points", "score")


@query("mad_threshold", f"""WITH {QUANTITY}, m AS (SELECT median(v) AS m, stddev_pop(v) AS sd FROM q),
 s AS (SELECT any_value(m) AS m, any_value(sd) AS sd, median(abs(v - m)) AS mad FROM q, m)
SELECT round(m + 3 * CASE WHEN 1.4826 * mad > 2.220446049250313e-16 THEN 1.4826 * mad ELSE sd END, 4) AS threshold FROM s""")
def mad_threshold(spark, d):
    return tr.robust_threshold(quantity_signal(spark, d), "mad", 3.0, "v").select(*rounded(4, "threshold"))


@query("percentile_threshold", f"WITH {QUANTITY} SELECT round(quantile_cont(v, 0.9), 4) AS threshold FROM q")
def percentile_threshold(spark, d):
    return tr.robust_threshold(quantity_signal(spark, d), "percentile", 90.0, "v").select(*rounded(4, "threshold"))


@query("support_jaccard", f"""WITH {cat.TRADE}, {cat.FRAMES},
 n AS (SELECT t, coalesce(n, 0) AS n FROM frames LEFT JOIN (SELECT t, count(*) AS n FROM trade WHERE w <> 0 GROUP BY 1) USING (t)),
 b AS (SELECT x.t, count(*) AS shared FROM trade x JOIN trade y ON x.t = y.t + 1 AND x.subj = y.subj AND x.i = y.i AND x.j = y.j
   WHERE x.w <> 0 AND y.w <> 0 GROUP BY 1)
SELECT a.t, round(CASE WHEN a.n + p.n = 0 THEN 0 ELSE 1 - coalesce(shared, 0) / (a.n + p.n - coalesce(shared, 0)) END, 6) AS jaccard
FROM n a JOIN n p ON a.t = p.t + 1 LEFT JOIN b ON b.t = a.t""")
def support_jaccard(spark, d):
    """Change of the non-zero cells of all subjects from month to month."""
    frames = fr.pack_frames(nw.trade_edges(spark, d), nw.trade_shape(spark, d))
    return tr.support_change(frames.withColumnRenamed("pos", "support")).filter("jaccard is not null").select("t", *rounded(6, "jaccard"))


# ---- clocks and windows ------------------------------------------------------------------


@query("frame_clocks", f"""WITH {QUANTITY}
SELECT t, v, round(-1000 + t * (2000 / 82.0), 6) AS linspace_ms, round(-1000 + t * 1000 / 1024.0, 6) AS start_ms,
  round((t - 41.0) * 1000 / 1024.0, 6) AS centred_ms FROM q""")
def frame_clocks(spark, d):
    t = F.col("t")
    return quantity_signal(spark, d).select(
        "t", "v",
        F.round(sc.ms_linspace(t, nw.trade_shape(spark, d).n_frames, -1000.0, 1000.0), 6).alias("linspace_ms"),
        F.round(sc.ms_from_start(t, -1000.0, 1024.0), 6).alias("start_ms"),
        F.round(sc.ms_centred(t, nw.trade_shape(spark, d).n_frames, 1024.0), 6).alias("centred_ms"),
    )


@query("ms_to_frame", """
WITH m AS (SELECT event_id, (epoch_us(ts) // 1000000) % 86400 / 43.2 - 1000 AS ms FROM events),
 near AS (SELECT event_id, arg_min(range, struct_pack(g := abs(-1000 + range * (2000 / 82.0::DOUBLE) - ms), k := range)) AS nearest FROM m, range(83) GROUP BY 1)
SELECT event_id, nearest, round_even((ms + 1000) * 41.0 / 1000, 0)::BIGINT AS rounded FROM m JOIN near USING (event_id)""")
def ms_to_frame(spark, d):
    from netweave.sources.tables import table

    second = F.unix_timestamp(F.col("ts").cast("timestamp")) % 86400
    times = table(spark, d, "events").select("event_id", (second / 43.2 - 1000).alias("ms"))
    return times.select(
        "event_id", sc.frame_nearest(F.col("ms"), nw.trade_shape(spark, d).n_frames, -1000.0, 1000.0).alias("nearest"),
        sc.frame_half_even(F.col("ms"), -1000.0, 41.0).alias("rounded"),
    )


@query("analysis_window", f"""WITH {QUANTITY},
 p AS (SELECT t FROM (SELECT t, v, lag(v) OVER (ORDER BY t) AS l, lead(v) OVER (ORDER BY t) AS r FROM q) WHERE v > l AND v > r),
 f AS (SELECT t FROM p WHERE t > 10 AND t < 74)
SELECT min(t) AS first_cp, max(t) AS last_cp FROM f""")
def analysis_window(spark, d):
    """First and last peak month strictly inside -800..800 ms on a 41 Hz clock."""
    return _peak_window(spark, d).select("first_cp", "last_cp")


def _strict_peaks(spark, d):
    w = Window.partitionBy("cond").orderBy("t")
    peaks = quantity_signal(spark, d).withColumn("l", F.lag("v").over(w)).withColumn("r", F.lead("v").over(w))
    return peaks.filter("v > l AND v > r").drop("l", "r")


def _peak_window(spark, d):
    points = _strict_peaks(spark, d).select("cond", F.col("t").alias("point"))
    return seg.analysis_change_points(points, nw.trade_shape(spark, d).n_frames, -800.0, 800.0, -1000.0, 41.0)


@query("two_point_intervals", f"""WITH {QUANTITY},
 p AS (SELECT t FROM (SELECT t, v, lag(v) OVER (ORDER BY t) AS l, lead(v) OVER (ORDER BY t) AS r FROM q) WHERE v > l AND v > r),
 f AS (SELECT min(t) AS a, max(t) AS b FROM p WHERE t > 10 AND t < 74)
SELECT unnest(['pre', 'core', 'post']) AS interval, unnest([6, a + 1, b + 1]) AS first_frame, unnest([a, b, 74]) AS last_frame FROM f""")
def two_point_intervals(spark, d):
    """Intervals around the first and last peak of the analysis window, from -900 ms on."""
    points = _peak_window(spark, d)
    out = seg.two_point_intervals(points, nw.trade_shape(spark, d).n_frames, -800.0, 800.0, -900.0, -1000.0, 41.0)
    return out.select("interval", "first_frame", "last_frame")


@query("boundary_intervals", f"""WITH {QUANTITY},
 top AS (SELECT t + 1 AS b, row_number() OVER (ORDER BY t) AS k FROM (SELECT t FROM q ORDER BY v DESC, t LIMIT 4))
SELECT CASE k WHEN 1 THEN 'pre' WHEN 2 THEN 'core' ELSE 'post' END AS interval, b + CASE WHEN k > 1 THEN 1 ELSE 0 END AS first_frame, nb AS last_frame,
  round(-1000 + (b + CASE WHEN k > 1 THEN 1 ELSE 0 END - 1) * 1000 / 41.0, 6) AS start_ms, round(-1000 + (nb - 1) * 1000 / 41.0, 6) AS end_ms
FROM (SELECT b, k, lead(b) OVER (ORDER BY k) AS nb FROM top) WHERE nb IS NOT NULL""")
def boundary_intervals(spark, d):
    """Intervals between the four busiest months."""
    busy = quantity_signal(spark, d).orderBy(F.col("v").desc(), "t").limit(4)
    four = busy.groupBy("cond").agg(F.sort_array(F.collect_list(F.col("t") + 1)).alias("b"))
    out = seg.boundary_intervals(four, lambda t: sc.ms_from_start(t, -1000.0, 41.0))
    return out.select("interval", "first_frame", "last_frame", *rounded(6, "start_ms", "end_ms"))


@query("context_cps", f"""WITH {QUANTITY}, p AS (SELECT t, v, lag(t) OVER (ORDER BY t) AS b, lead(t) OVER (ORDER BY t) AS a FROM (
   SELECT t, v, lag(v) OVER (ORDER BY t) AS l, lead(v) OVER (ORDER BY t) AS r FROM q) WHERE v > l AND v > r),
 c AS (SELECT arg_min([b, t, a], struct_pack(g := abs(t - 44), s := -v, k := t)) AS ctx FROM p WHERE t BETWEEN 30 AND 60)
SELECT unnest(list_filter(ctx, lambda x: x IS NOT NULL)) AS point FROM c""")
def context_cps(spark, d):
    """Peak month nearest to month 44 within 30..60, with its neighbours."""
    points = _strict_peaks(spark, d).select(
        "cond", F.col("t").alias("point"), F.col("t").cast("double").alias("ms"), F.col("v").alias("score")
    )
    return tr.target_context(points, (30.0, 60.0), 44.0).select("point")


# ---- recursive trackers ------------------------------------------------------------------


@query("tracker_scores")
def tracker_scores(spark, d):
    run = tr.track(fr.stage_frames(nw.trade_edges(spark, d), nw.trade_shape(spark, d)), nw.trade_shape(spark, d), FREE_TRACKER)
    parts = ("reconstruction_error", "support_change", "subspace_angle", "mode_energy", "direction_update", "final_score")
    return run.scores.select("update_time", "reported_time", "changed", "node_rank", "subject_rank", *rounded(5, *parts))


@query("tracker_change_points")
def tracker_change_points(spark, d):
    run = tr.track(fr.stage_frames(nw.trade_edges(spark, d), nw.trade_shape(spark, d)), nw.trade_shape(spark, d), FREE_TRACKER)
    return run.change_point_modes().select("reported_time", "mode", *rounded(5, "score"))


@query("tracker_events")
def tracker_events(spark, d):
    """What every update did to each mode: directions that came and went."""
    shape = nw.trade_shape(spark, d)
    run = tr.track(fr.stage_frames(nw.trade_edges(spark, d), shape), shape, FREE_TRACKER)
    return run.events.drop("cond")


@query("tracker_ranks")
def tracker_ranks(spark, d):
    """Rank history: ranks after training, then after every update."""
    shape = nw.trade_shape(spark, d)
    run = tr.track(fr.stage_frames(nw.trade_edges(spark, d), shape), shape, FREE_TRACKER)
    first = [(0, *(b.shape[1] for b in run.versions.bases[0][c])) for c in shape.conds]
    initial = spark.createDataFrame(first, "update_time bigint, node_rank bigint, subject_rank bigint")
    return initial.unionByName(run.scores.select("update_time", "node_rank", "subject_rank"))


@query("tracker_diagnostics")
def tracker_diagnostics(spark, d):
    """Per month: energies of both parts, residual, and size and change of the sparse support."""
    shape = nw.trade_shape(spark, d)
    frames = fr.stage_frames(nw.trade_edges(spark, d), shape)
    run = tr.track(frames, shape, FREE_TRACKER)
    found = tr.support_change(tr.frame_diagnostics(frames, shape, run.versions, FREE_TRACKER))
    return found.select("t", F.size("support").alias("support"), *rounded(4, "sparse_energy", "low_rank_energy"), *rounded(6, "error", "jaccard"))


@query("tracker_distance_rule")
def tracker_distance_rule(spark, d):
    """Updates that count as changes because a subspace moved far enough."""
    shape = nw.trade_shape(spark, d)
    cfg = dataclasses.replace(FREE_TRACKER, change=Change(rule="distance", distance=0.15))
    run = tr.track(fr.stage_frames(nw.trade_edges(spark, d), shape), shape, cfg)
    return run.scores.select("update_time", "reported_time", "changed", *rounded(5, "subspace_angle", "final_score"))


# the hourly event tensor: five days of training, an update a day
EVENT_TRACKER = tr.TrackerConfig(Subspace(train=120, block=24, floor=0.25, node_cap=5, subject_cap=8), selection=Selection(rate=None))


@query("stream_tracker_scores")
def stream_tracker_scores(spark, d):
    """Scores of the full tracker on a stream of the hourly event tensor's frames; equal to the batch run (`tests/test_streaming.py`)."""
    shape = nw.event_shape(spark, d)
    begin = F.lit("2024-01-01 00:00:00").cast("timestamp")
    frames = fr.pack_frames(nw.event_edges(spark, d), shape).withColumn("at", F.timestamp_seconds(F.unix_timestamp(begin) + F.col("t") * 3600))
    # files written side by side may arrive in any order: no frame counts as missing before all have had their turn
    delay = f"{shape.n_frames} hours"
    scores = stt.replay(frames, lambda s: stt.stream_scores(s, shape, EVENT_TRACKER, 1_704_067_200_000, 3_600_000, delay))
    parts = ("reconstruction_error", "support_change", "subspace_angle", "mode_energy", "direction_update", "final_score")
    return scores.select("update_time", "reported_time", "changed", "node_rank", "subject_rank", *rounded(5, *parts))


@query("tracker_low_rank")
def tracker_low_rank(spark, d):
    """Totals of the low-rank and the sparse part by subject and month."""
    shape = nw.trade_shape(spark, d)
    run = tr.track(fr.stage_frames(nw.trade_edges(spark, d), shape), shape, TRACKER)
    return run.separated().groupBy("subj", "t").agg(
        F.round(F.sum("low_rank"), 3).alias("low_rank"), F.round(F.sum("sparse"), 3).alias("sparse"),
        F.count_if(F.abs("sparse") > 1e-6).alias("sparse_cells"),
    )


@query("separation_energy")
def separation_energy(spark, d):
    """Energy per month of the observed tensor, of its low-rank and of its sparse part; all months."""
    shape = nw.trade_shape(spark, d)
    run = tr.track(fr.stage_frames(nw.trade_edges(spark, d), shape), shape, TRACKER)
    parts = F.explode(F.array(
        F.struct(F.lit("observed").alias("part"), (F.col("low_rank") + F.col("sparse")).alias("w")),
        F.struct(F.lit("low_rank").alias("part"), F.col("low_rank").alias("w")),
        F.struct(F.lit("sparse").alias("part"), F.col("sparse").alias("w")),
    )).alias("x")
    long = run.separated().select("subj", "i", "j", "t", parts).select(F.col("x.part").alias("cond"), "subj", "i", "j", "t", "x.w")
    energy_of = tn.component_energy(long, shape)
    return energy_of.groupBy("t").pivot("cond", ["observed", "low_rank", "sparse"]).agg(F.round(F.first("mean_norm"), 4)).na.fill(0.0)


@query("component_energies")
def component_energies(spark, d):
    """Energy per month of the low-rank and of the sparse part."""
    run = tr.track(fr.stage_frames(nw.trade_edges(spark, d), nw.trade_shape(spark, d)), nw.trade_shape(spark, d), TRACKER)
    parts = F.explode(F.array(
        F.struct(F.lit("low_rank").alias("part"), F.col("low_rank").alias("w")),
        F.struct(F.lit("sparse").alias("part"), F.col("sparse").alias("w")),
    )).alias("x")
    long = run.separated().select(F.col("subj"), "i", "j", "t", parts).select(F.col("x.part").alias("cond"), "subj", "i", "j", "t", "x.w")
    energy_by_part = tn.component_energy(long, nw.trade_shape(spark, d))
    return energy_by_part.select(F.col("cond").alias("part"), "t", *rounded(4, "mean_norm", "mean_square"))


@query("tracker_energy")
def tracker_energy(spark, d):
    frames = fr.stage_frames(nw.trade_edges(spark, d), nw.trade_shape(spark, d))
    signal, _ = tr.sparse_energy(frames, nw.trade_shape(spark, d), 24, 6, 0.11)
    return signal.select("t", *rounded(4, "v"))


PROXY = tr.TrackerConfig(Subspace(train=24, block=6, node_cap=8, subject_cap=3), Recovery("proxy"), selection=Selection(rate=None))
# shrinkage of a month: by the median deviation of all its projected cells, as a rule of the recovery
PROXY_LEVEL = {
    "absolute": f"SELECT t, {PROXY.recovery.level} AS level FROM y GROUP BY 1",
    "relative": f"SELECT t, {PROXY.recovery.level} * max(abs(y)) AS level FROM y GROUP BY 1",
}.get(PROXY.recovery.level_rule, f"""SELECT t, {PROXY.recovery.level} * CASE WHEN 1.4826 * mad > 2.220446049250313e-16 THEN 1.4826 * mad ELSE sd END AS level FROM (
    SELECT t, median(abs(y - m)) AS mad, any_value(sd) AS sd FROM y JOIN (SELECT t, median(y) AS m, stddev_pop(abs(y)) AS sd FROM y GROUP BY 1) USING (t) GROUP BY 1)""")


def _sparse(spark, d, solver):
    cfg = dataclasses.replace(PROXY, recovery=Recovery(solver))
    frames = fr.stage_frames(nw.trade_edges(spark, d), nw.trade_shape(spark, d))
    bases, _ = tr.initial_bases(frames, nw.trade_shape(spark, d), cfg)
    versions = tr.Versions()
    versions.add(0, bases)
    found = tr.separated_edges(frames, nw.trade_shape(spark, d), versions, cfg)
    # the support is what the operator calls so; rounding is for show
    return found.where(F.abs("sparse") > tr.EPS).select("subj", "i", "j", "t", *rounded(4, "sparse"))


@query("sparse_pursuit")
def sparse_pursuit(spark, d):
    return _sparse(spark, d, "omp")


@query("sparse_descent")
def sparse_descent(spark, d):
    return _sparse(spark, d, "fista")


SPARSE_SQL = f"""WITH RECURSIVE {cat.TRADE}, {cat.BOTH}, segments AS (SELECT DISTINCT c_mktsegment AS s FROM customer WHERE c_mktsegment IS NOT NULL),
 gn AS MATERIALIZED (SELECT x.range AS r, y.range AS c, coalesce(g, 0)::DOUBLE AS g FROM range(25) x CROSS JOIN range(25) y LEFT JOIN
   (SELECT a.i AS r, b.i AS c, sum(a.w * b.w) AS g FROM ends a JOIN ends b USING (subj, j, t) WHERE t < 24 GROUP BY 1, 2) k ON k.r = x.range AND k.c = y.range),
 gs AS MATERIALIZED (SELECT x.s AS r, y.s AS c, coalesce(g, 0)::DOUBLE AS g FROM segments x CROSS JOIN segments y LEFT JOIN
   (SELECT a.subj AS r, b.subj AS c, sum(a.w * b.w) AS g FROM ends a JOIN ends b USING (i, j, t) WHERE t < 24 GROUP BY 1, 2) k ON k.r = x.s AND k.c = y.s),
 {cat.projector("pn", "gn", 8, floor=PROXY.subspace.floor)},
 {cat.projector("ps", "gs", 3, floor=PROXY.subspace.floor)},
 qn AS MATERIALIZED (SELECT r, c, CASE WHEN r = c THEN 1 ELSE 0 END - p AS p FROM pn), qs AS MATERIALIZED (SELECT r, c, CASE WHEN r = c THEN 1 ELSE 0 END - p AS p FROM ps),
 l1 AS MATERIALIZED (SELECT qs.r AS subj, i, j, t, sum(p * w) AS w FROM ends JOIN qs ON qs.c = subj GROUP BY 1, 2, 3, 4),
 l2 AS MATERIALIZED (SELECT subj, qn.r AS i, j, t, sum(p * w) AS w FROM l1 JOIN qn ON qn.c = i GROUP BY 1, 2, 3, 4),
 y AS MATERIALIZED (SELECT subj, i, qn.r AS j, t, sum(p * w) AS y FROM l2 JOIN qn ON qn.c = j GROUP BY 1, 2, 3, 4),
 lev AS ({PROXY_LEVEL}),
 s AS (SELECT subj, i, j, t, sign(y) * greatest(abs(y) - level, 0) AS s FROM y JOIN lev USING (t)),
 obs AS (SELECT subj, i, j, t, coalesce(w, 0) AS w, s FROM s LEFT JOIN ends USING (subj, i, j, t)),
 low AS (SELECT a.subj, a.i, a.j, a.t, a.w, (a.w - a.s + b.w - b.s) / 2 AS low FROM obs a JOIN obs b ON a.subj = b.subj AND a.t = b.t AND a.i = b.j AND a.j = b.i WHERE a.i < a.j)"""


@query("sparse_proxy", SPARSE_SQL + "\nSELECT subj, i, j, t, round(w - low, 4) AS sparse FROM low WHERE abs(w - low) > 1e-10")
def sparse_proxy(spark, d):
    return _sparse(spark, d, "proxy")


@query("low_rank_slice", nq.HOSVD.rsplit("SELECT subj, i, j, t", 1)[0] + "SELECT i, j, round(sum(w) / 5, 4) AS w FROM l3 WHERE t = 40 GROUP BY 1, 2")
def low_rank_slice(spark, d):
    """One month of the low-rank part, mean over subjects."""
    shape = nw.trade_shape(spark, d)
    low = lr.hosvd_low_rank(fr.stage_frames(nw.planted_edges(spark, d), shape), shape, (3, 6))
    return tn.subject_mean(low.where("t = 40"), shape).select("i", "j", *rounded(4, "w"))


@query("sparse_slice", SPARSE_SQL + """
SELECT i, j, round(sum(w - low) / 5, 4) AS w FROM low WHERE t = 40 AND abs(w - low) > 1e-10 GROUP BY 1, 2""")
def sparse_slice(spark, d):
    """The same month of the sparse part that one shrinkage finds, mean over subjects."""
    shape = nw.trade_shape(spark, d)
    frames = fr.stage_frames(nw.trade_edges(spark, d), shape)
    bases, _ = tr.initial_bases(frames, shape, PROXY)
    versions = tr.Versions()
    versions.add(0, bases)
    found = tr.separated_edges(frames.where("t = 40"), shape, versions, PROXY).where(F.abs("sparse") > tr.EPS)
    return tn.subject_mean(found.select("cond", "subj", "i", "j", "t", F.col("sparse").alias("w")), shape).select("i", "j", *rounded(4, "w"))


@query("tracker_training", SPARSE_SQL + """
SELECT 'node' AS mode, r::VARCHAR AS r, c::VARCHAR AS c, round(p, 6) AS p FROM pn UNION ALL SELECT 'subject', r, c, round(p, 6) FROM ps""")
def tracker_training(spark, d):
    """Projectors onto the tracker's initial subspaces, by mode."""
    shape = nw.trade_shape(spark, d)
    bases, _ = tr.initial_bases(fr.stage_frames(nw.trade_edges(spark, d), shape), shape, PROXY)
    names = {"node": [str(n) for n in range(shape.n_nodes)], "subject": list(shape.subjects)}
    rows = []
    for mode, basis in zip(("node", "subject"), bases["trade"]):
        p = basis @ basis.T
        rows += [(mode, a, b, float(p[x, y])) for x, a in enumerate(names[mode]) for y, b in enumerate(names[mode])]
    return spark.createDataFrame(rows, "mode string, r string, c string, p double").select("mode", "r", "c", *rounded(6, "p"))


@query("distance_thinning", f"""WITH RECURSIVE {QUANTITY},
 k(point, score, kept) AS (
  SELECT NULL::BIGINT, NULL::DOUBLE, []::BIGINT[]
  UNION ALL
  SELECT t, v, list_append(kept, t) FROM (SELECT arg_max(t, struct_pack(v := v, t := -t)) AS t, max(v) AS v, any_value(kept) AS kept
    FROM k JOIN q ON len(list_filter(kept, lambda x: abs(x - q.t) < 6)) = 0 HAVING count(*) > 0))
SELECT point, score FROM k WHERE point IS NOT NULL""")
def distance_thinning(spark, d):
    """Busiest months at least six apart, greedily by quantity."""
    points = quantity_signal(spark, d).select("cond", F.col("t").alias("point"), F.col("v").alias("score"))
    return ls.thinned(points, 6).select("point", "score")


# ---- studies -----------------------------------------------------------------------------

STUDY = study.StudyConfig(
    ranks=(3, 6), k_range=(2, 6), min_community=3, tracker=TRACKER, windows=(6, 12, 24), shift_window=12,
    alphas=(6, 12), sigmas=(0.05, 0.11),
)


@query("detector_table")
def detector_table(spark, d):
    """Change points of all five detectors side by side."""
    out = study.detector_table(nw.trade_edges(spark, d), nw.trade_shape(spark, d), MONTHS, STUDY)
    return out.select("method", F.col("ord").cast("bigint").alias("ord"), "frame", "ms")


@query("study_summary")
def study_summary(spark, d):
    """Low-rank denoising, exact segmentation and consensus communities of the planted tensor."""
    done = study.run_study(nw.planted_edges(spark, d), nw.trade_shape(spark, d), "hosvd", STUDY)
    out = study.summary_table(done.quality, done.intervals, MONTHS)
    return out.select(
        "interval", "start_frame", "end_frame", "best_k", *rounded(6, "best_selection_score", "best_u", "best_q")
    )


def _detected(spark, d):
    shape = nw.trade_shape(spark, d)
    edges = seg.stage(nw.planted_edges(spark, d))
    frames = fr.stage_frames(edges, shape)
    low = seg.stage(lr.hosvd_low_rank(frames, shape, STUDY.ranks))
    return low, seg.stage(study.detector_table(edges, shape, MONTHS, STUDY, frames)), shape


@query("detector_communities")
def detector_communities(spark, d):
    """Communities between the change points of every detector, summed up by method."""
    low, points, shape = _detected(spark, d)
    out = study.communities_by_detector(low, points, shape, STUDY)
    return out.select("method", "interval", "start_frame", "end_frame", "best_k", *rounded(6, "best_selection_score", "best_u", "best_q"))


@query("detected_consensus")
def detected_consensus(spark, d):
    """Consensus of the frames' communities within the detected intervals of the low-rank tensor."""
    low, points, shape = _detected(spark, d)
    _, found, _ = study.consensus_table(low, points, shape)
    name = F.split("interval", r"\|")
    return found.select(
        name[0].alias("method"), name[1].alias("interval"), F.array_max("comms").alias("last_community"), F.round("score", 6).alias("score"),
        F.col("method").alias("algorithm"),
    )
