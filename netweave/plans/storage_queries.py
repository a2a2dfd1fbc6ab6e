"""What is written and read again: tensors, epochs, change points, layouts and reports, each against the SQL of its content."""

from __future__ import annotations

from pyspark.sql import functions as F

from netweave.operators import quality as ql
from netweave.operators import segmentation as seg
from netweave.operators import signals as sg
from netweave.plans import catalog as cat
from netweave.plans import network_queries as nq
from netweave.plans import signal_queries as sq
from netweave.plans.catalog import query, rounded
from netweave.sources import networks as nw
from netweave.sources import tables
from netweave.stage import new_path


def _stored_tensor(spark, d) -> str:
    path = new_path(spark, "tensor")
    tables.write_edges(nw.trade_edges(spark, d), path)
    return path


@query("stored_tensor_slice", f"WITH {cat.TRADE} SELECT 'trade' AS cond, subj, i, j, t, w FROM trade WHERE t BETWEEN 24 AND 35")
def stored_tensor_slice(spark, d):
    """The third year of a stored tensor: the frame condition prunes row groups."""
    return tables.read_edges(spark, _stored_tensor(spark, d), (24, 35)).select("cond", "subj", "i", "j", "t", "w")


@query("stored_subjects", f"WITH {cat.TRADE} SELECT DISTINCT subj FROM trade ORDER BY subj LIMIT 3")
def stored_subjects(spark, d):
    """The first three subjects of a stored tensor."""
    return tables.discover_subjects(tables.read_edges(spark, _stored_tensor(spark, d)), 3)


@query("stored_change_points", f"""WITH {cat.SEGMENTS}, p AS (SELECT 0 AS ord, b1 AS frame FROM best UNION ALL SELECT 1, b2 FROM best),
 c AS (SELECT DISTINCT 'trade' AS cond FROM trade UNION ALL SELECT 'other')
SELECT c.cond, ord::INT AS ord, frame::BIGINT AS frame, (frame - 1)::DOUBLE AS ms FROM c JOIN p ON c.cond = 'trade'""")
def stored_change_points(spark, d):
    """Change points written by method and condition, read back with their checks, and looked up for each condition (an unknown one is skipped)."""
    shape = nw.trade_shape(spark, d)
    found = seg.detect_exact(nw.trade_edges(spark, d), shape)
    points = found.select("cond", F.posexplode("boundaries").alias("ord", "frame"), F.lit("exact").alias("method")).select(
        "cond", "method", "ord", "frame", (F.col("frame") - 1).cast("double").alias("ms")
    )
    path = new_path(spark, "points")
    tables.write_result(points, path, "method")
    read = tables.read_change_points(spark, path, expected=2).where("method = 'exact'").drop("method")
    wanted = spark.createDataFrame([(c,) for c in (*shape.conds, "other")], "cond string")
    return wanted.join(read, "cond").select("cond", "ord", "frame", "ms")


@query("stored_epochs", sq.EPOCH_TOTALS + " HAVING count(*) = 5 AND subj IN (2, 5)")
def stored_epochs(spark, d):
    """Balanced epochs of all subjects, written, and those of two subjects read back."""
    path = new_path(spark, "epochs")
    cut = sq.cut_balanced(spark, d)
    tables.write_epochs(cut, path)
    read = tables.read_epochs(spark, path, subjects=[2, 5])
    total = F.aggregate("v", F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return read.select("subj", "code", "trial", "ch", total.alias("total"))


@query("quality_report", f"""WITH {cat.CLUSTERS}
SELECT interval, round(avg(h), 6) AS h, round(avg(c), 6) AS c FROM clusters GROUP BY 1""")
def quality_report(spark, d):
    """Partition quality as a CSV report, read back."""
    path = new_path(spark, "report")
    clusters = ql.cluster_quality(nq.histograms(spark, d))
    tables.write_report(ql.partition_quality(clusters).select("interval", "h", "c"), path)
    return tables.read_report(spark, path, "interval string, h double, c double").select("interval", *rounded(6, "h", "c"))


@query("matrix_report", f"""WITH {cat.GMEAN}
SELECT a.range AS i, b.range AS j, round(coalesce(g.w, 0), 6) AS w FROM range(25) a CROSS JOIN range(25) b
LEFT JOIN (SELECT * FROM gmean WHERE interval = 'core') g ON g.i = least(a.range, b.range) AND g.j = greatest(a.range, b.range)""")
def matrix_report(spark, d):
    """The core interval's mean adjacency as a wide CSV matrix, read back and made long."""
    n, path = nw.trade_shape(spark, d).n_nodes, new_path(spark, "matrix")
    tables.write_report(tables.matrix_wide(nq.mean_graphs(spark, d).where("interval = 'core'"), n), path)
    wide = tables.read_report(spark, path, "i bigint, " + ", ".join(f"`{k}` double" for k in range(n)))
    cells = F.array(*[F.col(f"`{k}`") for k in range(n)])
    return wide.select("i", F.posexplode(cells).alias("j", "w")).select("i", F.col("j").cast("bigint").alias("j"), *rounded(6, "w"))


@query("electrode_layout", """WITH l AS (SELECT s_name AS name, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_acctbal END AS x, s_nationkey * 100.0 - s_suppkey AS y FROM supplier),
 turned AS (SELECT name, -y AS x, x AS y FROM l WHERE x IS NOT NULL AND y IS NOT NULL), r AS (SELECT max(sqrt(x * x + y * y)) AS r FROM turned)
SELECT name, round(x * 0.96 / r, 6) AS x, round(y * 0.96 / r, 6) AS y FROM turned, r""")
def electrode_layout(spark, d):
    """Positions (suppliers stand in for electrodes) through a tab-separated file with n/a, turned and scaled into the head circle."""
    path = new_path(spark, "layout")
    x = F.when(F.col("s_suppkey") % 7 != 0, F.col("s_acctbal"))
    layout = tables.table(spark, d, "supplier").select(
        F.col("s_name").alias("name"), x.alias("x"), (F.col("s_nationkey") * 100.0 - F.col("s_suppkey")).alias("y"), F.lit(None).cast("double").alias("z")
    )
    tables.write_layout(layout, path)
    return tables.electrode_positions(tables.read_electrodes(spark, path)).select("name", *rounded(6, "x", "y"))


@query("subject_status", f"""WITH {cat.TRIALS},
 n AS (SELECT subj, cond, trial, count(*) AS n FROM parts GROUP BY 1, 2, 3),
 f AS (SELECT subj, arg_min(n, (trial, n)) AS n, min(trial) AS trial FROM n WHERE n < 10 GROUP BY 1),
 c AS (SELECT subj, count(*) FILTER (n = 10 AND cond = 'Correct') AS correct, count(*) FILTER (n = 10 AND cond = 'Incorrect') AS incorrect FROM n GROUP BY 1)
SELECT c.subj, CASE WHEN f.subj IS NOT NULL THEN 'FAILED: trial ' || f.trial || ' holds ' || f.n || ' of 10 channels'
  WHEN incorrect > 0 THEN 'SUCCESS' ELSE 'SKIPPED: no incorrect trials' END AS status,
  CASE WHEN f.subj IS NULL THEN correct ELSE 0 END AS correct, CASE WHEN f.subj IS NULL THEN incorrect ELSE 0 END AS incorrect
FROM c LEFT JOIN f USING (subj)""")
def subject_status(spark, d):
    """Report of a step that fails on incomplete trials: failures are captured and named by subject."""
    n = nw.n_channels(spark, d)
    packed = nw.trial_arrays(spark, d).groupBy("subj", "cond", "trial").agg(F.collect_list("ch").alias("chs"))

    def check(row):
        if len(row.chs) < n:
            raise ValueError(f"trial {row.trial} holds {len(row.chs)} of {n} channels")
        return {"channels": len(row.chs)}

    return sg.subject_status(sg.captured(packed, check, "channels int"))
