"""Running values over long orderings, split into buckets so no key is scanned by one task.

A plain window over ``partitionBy(key)`` puts all rows of a hot key into one task. Here
rows are windowed within (key, bucket) and only one summary row per bucket is windowed
over the key; the two parts are combined by an equi-join on (key, bucket).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_COMBINE = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
}


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: Column,
    values: dict[str, tuple],
) -> DataFrame:
    """Add inclusive running values along ``order`` within ``keys``.

    ``values`` maps a name to ``(expr, "sum"|"min"|"max")``, or ``(expr, kind, "back")`` to
    run from the end backwards. ``bucket`` must not decrease along ``order``. The input is
    read twice (rows and bucket summaries): pass a stored table when it is costly.
    """
    df = df.withColumn("_b", bucket)
    specs = {name: (v[0], v[1], len(v) > 2) for name, v in values.items()}

    def ordering(names, back):
        return [F.col(c).desc() if back else F.col(c).asc() for c in names]

    def inner(back):
        w = Window.partitionBy(*keys, "_b").orderBy(*ordering(order, back))
        return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def before(back):
        w = Window.partitionBy(*keys).orderBy(*ordering(["_b"], back))
        return w.rowsBetween(Window.unboundedPreceding, -1)

    totals = df.groupBy(*keys, "_b").agg(*[_COMBINE[k][0](e).alias(f"_c_{n}") for n, (e, k, _) in specs.items()])
    carried = totals.select(
        *keys, "_b", *[_COMBINE[k][0](f"_c_{n}").over(before(back)).alias(f"_c_{n}") for n, (_, k, back) in specs.items()]
    )
    local = df.select("*", *[_COMBINE[k][0](e).over(inner(back)).alias(f"_l_{n}") for n, (e, k, back) in specs.items()])
    joined = local.join(carried, [*keys, "_b"])
    kept = [c for c in df.columns if c != "_b"]
    return joined.select(
        *kept, *[_COMBINE[k][1](F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n) for n, (_, k, _) in specs.items()]
    )
