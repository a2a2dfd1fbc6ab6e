"""Trials, epochs and phase locking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from netweave.operators import matching as mt
from netweave.operators import signals as sg
from netweave.plans import catalog as cat
from netweave.plans.catalog import query, rounded
from netweave.sources import networks as nw
from netweave.sources.tables import table

RATE, BAND = 64.0, (4.0, 8.0)


def analytic_trials(spark, d):
    trials = nw.trial_arrays(spark, d)
    return trials.withColumn("a", sg.analytic_signal(sg.band_pass(F.col("v"), RATE, *BAND)))


def plv_edges(spark, d):
    n = nw.n_channels(spark, d)
    return sg.locking_edges(sg.phase_locking(analytic_trials(spark, d), n), n, nw.EPOCH_SAMPLES)


@query("channel_pick", """
SELECT ch, count(*) AS n, sum(v)::BIGINT AS total FROM (
  SELECT CASE WHEN event_type = 'view' THEN 'View' WHEN event_type = 'click' THEN 'Click' ELSE event_type END AS ch,
         user_id % 8 AS v FROM events)
WHERE ch IN ('View', 'Click', 'error') GROUP BY 1""")
def channel_pick(spark, d):
    signal = table(spark, d, "events").select(F.col("event_type").alias("ch"), (F.col("user_id") % 8).alias("v"))
    picked = sg.pick_channels(signal, ["View", "Click", "error"], {"view": "View", "click": "Click"})
    return picked.groupBy("ch").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("trial_class", """
SELECT code, CASE WHEN substr(code, 1, 1) = substr(code, 3, 1) THEN 'Correct' ELSE 'Incorrect' END AS class, count(*) AS n
FROM (SELECT o_orderstatus || CASE WHEN substr(o_orderpriority, 1, 1) = '5' THEN '' ELSE substr(o_orderpriority, 1, 1) END
             || l_linestatus AS code FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
WHERE length(code) = 3 GROUP BY 1, 2""")
def trial_class(spark, d):
    level = F.substring("o_orderpriority", 1, 1)
    code = F.concat("o_orderstatus", F.when(level == "5", "").otherwise(level), "l_linestatus")
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linestatus")
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    codes = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(code.alias("code"))
    return sg.classify_trials(codes).groupBy("code", "class").agg(F.count("*").alias("n"))


@query("trial_counts", f"""WITH {cat.EVENTS}
SELECT subj, correct, incorrect,
  CASE WHEN incorrect > 0 THEN 'SUCCESS' ELSE 'SKIPPED: no incorrect trials' END AS status FROM (
  SELECT subj, count(*) FILTER (code = 'Correct') AS correct, count(*) FILTER (code = 'Incorrect') AS incorrect
  FROM ev GROUP BY 1)""")
def trial_counts(spark, d):
    return sg.trial_report(nw.trial_events(spark, d)).select("subj", "correct", "incorrect", "status")


@query("trial_count_means", f"""WITH {cat.EVENTS}
SELECT count(*) AS subjects, round(avg(correct), 6) AS mean_correct, round(avg(incorrect), 6) AS mean_incorrect FROM (
  SELECT subj, count(*) FILTER (code = 'Correct') AS correct, count(*) FILTER (code = 'Incorrect') AS incorrect
  FROM ev GROUP BY 1)""")
def trial_count_means(spark, d):
    return sg.trial_report(nw.trial_events(spark, d)).agg(
        F.count("*").alias("subjects"), F.round(F.avg("correct"), 6).alias("mean_correct"),
        F.round(F.avg("incorrect"), 6).alias("mean_incorrect"),
    )


@query("nearest_correct", f"""WITH {cat.EVENTS},
 near AS (SELECT a.subj, a.event_id, a.sample, arg_min(b.event_id, struct_pack(g := abs(a.sample - b.sample), s := b.sample, k := b.event_id)) AS match_id,
    min(abs(a.sample - b.sample)) AS gap
  FROM ev a JOIN ev b ON a.subj = b.subj AND a.code = 'Incorrect' AND b.code = 'Correct' GROUP BY 1, 2, 3)
SELECT subj, event_id, sample, match_id, gap FROM near""")
def nearest_correct(spark, d):
    return mt.nearest_correct(nw.trial_events(spark, d)).select("subj", "event_id", "sample", "match_id", "gap")


GREEDY = f"""WITH RECURSIVE {cat.EVENTS},
 wrong AS (SELECT *, row_number() OVER (PARTITION BY subj ORDER BY sample, event_id) AS k FROM ev WHERE code = 'Incorrect'),
 fine AS (SELECT * FROM ev WHERE code = 'Correct'),
 m(subj, k, event_id, match_id, used) AS (
  SELECT DISTINCT subj, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, []::BIGINT[] FROM wrong
  UNION ALL
  SELECT subj, k, event_id, pick, list_append(used, pick) FROM (
    SELECT m.subj, w.k, w.event_id, m.used,
      arg_min(f.event_id, struct_pack(g := abs(w.sample - f.sample), s := f.sample, i := f.event_id)) AS pick
    FROM m JOIN wrong w ON w.subj = m.subj AND w.k = m.k + 1
      JOIN fine f ON f.subj = m.subj AND NOT list_contains(m.used, f.event_id)
    GROUP BY 1, 2, 3, 4))"""


@query("greedy_trial_match", f"{GREEDY} SELECT subj, event_id, match_id FROM m WHERE k > 0")
def greedy_trial_match(spark, d):
    return mt.balance_trials(nw.trial_events(spark, d)).select("subj", "event_id", "match_id")


@query("epochs", f"""WITH {cat.EVENTS},
 sig AS (SELECT user_id % 8 AS subj, event_type AS ch, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 3600000000 AS sample,
    count(*) AS v FROM events GROUP BY 1, 2, 3),
 cue AS (SELECT event_id AS trial, subj % 8 AS subj, sample // 3600 AS onset FROM ev WHERE code = 'Incorrect'),
 cut AS (SELECT cue.subj, trial, ch, sample - onset AS t, v FROM cue JOIN sig ON cue.subj = sig.subj
    AND sample BETWEEN onset - 2 AND onset + 2)
SELECT subj, trial, ch, sum(v)::BIGINT AS total, sum(CASE WHEN t = -2 THEN v END)::BIGINT AS head
FROM cut GROUP BY 1, 2, 3 HAVING count(*) = 5""")
def epochs(spark, d):
    events = table(spark, d, "events")
    signal = events.groupBy(
        (F.col("user_id") % 8).alias("subj"), F.col("event_type").alias("ch"), nw.event_hour().alias("sample")
    ).agg(F.count("*").alias("v"))
    cues = nw.trial_events(spark, d).filter("code = 'Incorrect'").select(
        (F.col("subj") % 8).alias("subj"), F.col("event_id").alias("trial"), F.floor(F.col("sample") / 3600).alias("sample")
    )
    cut = sg.cut_epochs(signal, cues, 2, 2)
    total = F.aggregate("v", F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return cut.select("subj", "trial", "ch", total.alias("total"), F.get("v", F.lit(0)).alias("head"))


def hourly_signal(spark, d):
    return table(spark, d, "events").groupBy(
        (F.col("user_id") % 8).alias("subj"), F.col("event_type").alias("ch"), nw.event_hour().alias("sample")
    ).agg(F.count("*").alias("v"))


EPOCH_TOTALS = f"""{GREEDY},
 sig AS (SELECT user_id % 8 AS subj, event_type AS ch, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 3600000000 AS sample,
    count(*) AS v FROM events GROUP BY 1, 2, 3),
 both_ends AS (SELECT event_id AS trial, 'Incorrect' AS code FROM m WHERE k > 0 UNION ALL
   SELECT match_id, 'Correct' FROM m WHERE k > 0 AND match_id IS NOT NULL),
 cue AS (SELECT trial, both_ends.code, subj % 8 AS subj, sample // 3600 AS onset FROM both_ends JOIN ev ON event_id = trial
   WHERE trial IN (SELECT event_id FROM m WHERE match_id IS NOT NULL UNION ALL SELECT match_id FROM m)),
 cut AS (SELECT cue.subj, trial, code, ch, v FROM cue JOIN sig ON cue.subj = sig.subj AND sig.sample BETWEEN onset - 2 AND onset + 2)
SELECT subj, code, trial, ch, sum(v)::BIGINT AS total FROM cut GROUP BY 1, 2, 3, 4"""


def cut_balanced(spark, d):
    """(subj, code, trial, ch, v): epochs of the errors and of the Correct trials matched with them."""
    kept = mt.balanced_events(mt.balance_trials(nw.trial_events(spark, d)))
    codes = F.collect_list("code").over(Window.partitionBy("event_id")).alias("codes")
    cues = kept.select((F.col("subj") % 8).alias("subj"), F.col("event_id").alias("trial"), F.floor(F.col("sample") / 3600).alias("sample"), codes)
    cut = sg.cut_epochs(hourly_signal(spark, d), cues, 2, 2)
    return cut.select("subj", F.explode("codes").alias("code"), "trial", "ch", "v")


@query("balanced_epochs", EPOCH_TOTALS + " HAVING count(*) = 5")
def balanced_epochs(spark, d):
    """Epochs of the errors and of the Correct trials matched with them, as many of either."""
    total = F.aggregate("v", F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return cut_balanced(spark, d).select("subj", "code", "trial", "ch", total.alias("total"))


@query("band_pass", f"""WITH {cat.BAND} SELECT subj, cond, trial, ch, t, round(v, 6) AS v FROM y""")
def band_pass(spark, d):
    filtered = nw.trial_arrays(spark, d).withColumn("y", sg.band_pass(F.col("v"), RATE, *BAND))
    long = filtered.select("subj", "cond", "trial", "ch", F.posexplode("y").alias("t", "v"))
    return long.select("subj", "cond", "trial", F.col("ch"), F.col("t").cast("bigint").alias("t"), *rounded(6, "v"))


@query("analytic_signal", f"""WITH {cat.ANALYTIC}
SELECT subj, cond, trial, ch, t, round(re, 6) AS re, round(im, 6) AS im FROM a""")
def analytic_signal(spark, d):
    n = nw.EPOCH_SAMPLES
    both = F.arrays_zip(F.slice("a", 1, n).alias("re"), F.slice("a", n + 1, n).alias("im"))
    long = analytic_trials(spark, d).select("subj", "cond", "trial", "ch", F.posexplode(both).alias("t", "z"))
    return long.select(
        "subj", "cond", "trial", "ch", F.col("t").cast("bigint").alias("t"), F.round("z.re", 6).alias("re"),
        F.round("z.im", 6).alias("im"),
    )


@query("plv_tensor", f"""WITH {cat.ANALYTIC},
 u AS (SELECT subj, cond, trial, ch, t, re / sqrt(re * re + im * im) AS re, im / sqrt(re * re + im * im) AS im FROM a)
SELECT c.cond, c.subj::VARCHAR AS subj, c.ch::BIGINT AS i, e.ch::BIGINT AS j, c.t,
  round(sqrt(pow(avg(c.re * e.re + c.im * e.im), 2) + pow(avg(c.im * e.re - c.re * e.im), 2)), 5) AS w
FROM u c JOIN u e ON c.subj = e.subj AND c.cond = e.cond AND c.trial = e.trial AND c.t = e.t AND c.ch < e.ch
GROUP BY 1, 2, 3, 4, 5""")
def plv_tensor(spark, d):
    return plv_edges(spark, d).select("cond", "subj", "i", "j", "t", F.round("w", 5).alias("w"))


@query("band_plv", f"""WITH {cat.TRIALS}, wave AS (SELECT m.range AS m, b.range AS bin, (0.5 - 0.5 * cos(2 * pi() * m.range / 16)) AS h, 2 * pi() * b.range * m.range / 16 AS phi
   FROM range(16) m, range(1, 4) b),
 z AS (SELECT subj, cond, trial, ch, o.range AS t, bin, sum(v * h * cos(phi)) AS re, -sum(v * h * sin(phi)) AS im
   FROM range(64) o, wave JOIN x ON x.t = o.range + m - 8 GROUP BY 1, 2, 3, 4, 5, 6),
 u AS (SELECT subj, cond, trial, ch, t, bin, re / sqrt(re * re + im * im) AS re, im / sqrt(re * re + im * im) AS im FROM z),
 p AS (SELECT c.cond, c.subj::VARCHAR AS subj, c.ch::BIGINT AS i, e.ch::BIGINT AS j, c.t, c.bin,
     sqrt(pow(avg(c.re * e.re + c.im * e.im), 2) + pow(avg(c.im * e.re - c.re * e.im), 2)) AS w
   FROM u c JOIN u e ON c.subj = e.subj AND c.cond = e.cond AND c.trial = e.trial AND c.t = e.t AND c.bin = e.bin AND c.ch < e.ch GROUP BY ALL)
SELECT cond, subj, i, j, t, round(avg(w), 5) AS w FROM p GROUP BY 1, 2, 3, 4, 5""")
def band_plv(spark, d):
    """Phase locking by short-time spectra of 16 samples, averaged over the bins of 4 to 12 Hz."""
    found = sg.band_locking(nw.trial_arrays(spark, d), nw.n_channels(spark, d), nw.EPOCH_SAMPLES, 16, (1, 2, 3))
    return found.select("cond", "subj", "i", "j", "t", *rounded(5, "w"))


@query("erp_baseline", f"""WITH {cat.TRIALS},
 m AS (SELECT subj, cond, ch, t - 32 AS t, avg(v) AS v FROM x GROUP BY 1, 2, 3, 4)
SELECT subj, cond, ch, t, round((v - avg(CASE WHEN t BETWEEN -12 AND 0 THEN v END) OVER (PARTITION BY subj, cond, ch)) * 1e6, 3) AS v
FROM m""")
def erp_baseline(spark, d):
    erp = sg.evoked_response(nw.trial_arrays(spark, d), nw.EPOCH_SAMPLES // 2, (-12, 0))
    return erp.select("subj", "cond", "ch", "t", *rounded(3, "v"))


@query("spatial_filter", f"""WITH {cat.TRIALS},
 whole AS (SELECT subj, cond, trial FROM parts GROUP BY 1, 2, 3 HAVING count(*) = 10)
SELECT subj, cond, trial, ch, t, round(v - avg(v) OVER (PARTITION BY subj, cond, trial, t), 6) AS x
FROM x JOIN whole USING (subj, cond, trial)""")
def spatial_filter(spark, d):
    """Average-reference montage as a channel mixing matrix."""
    trials = nw.complete_trials(nw.trial_arrays(spark, d), nw.n_channels(spark, d))
    return _referenced(spark, d, trials)


def _referenced(spark, d, trials):
    n = nw.n_channels(spark, d)
    matrix = (
        spark.range(n).select(F.col("id").cast("int").alias("col")).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        .withColumn("m", F.when(F.col("row") == F.col("col"), 1.0).otherwise(0.0) - 1.0 / n)
    )
    mixed = sg.spatial_filter(trials, matrix)
    return mixed.select("subj", "cond", "trial", "ch", F.col("t").cast("bigint").alias("t"), *rounded(6, "x"))


@query("spatial_filter_gaps", f"""WITH {cat.TRIALS},
 s AS (SELECT subj, cond, trial, t, sum(v) AS total FROM x GROUP BY 1, 2, 3, 4)
SELECT s.subj, s.cond, s.trial, c.range::INT AS ch, s.t, round(coalesce(v, 0) - total / 10, 6) AS x
FROM s CROSS JOIN range(10) c LEFT JOIN x ON x.subj = s.subj AND x.cond = s.cond AND x.trial = s.trial AND x.t = s.t AND x.ch = c.range""")
def spatial_filter_gaps(spark, d):
    """The same reference over all trials: channels that a trial lacks count as 0."""
    return _referenced(spark, d, nw.trial_arrays(spark, d))
