import os
import sys

import numpy as np
import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def medium():
    return "/root/testdata/sf0.01"


def tensor(n_subjects=3, n_nodes=6, n_frames=40, seed=0, density=1.0):
    """Random symmetric tensor (subjects, nodes, nodes, frames), zero diagonal."""
    rng = np.random.default_rng(seed)
    x = rng.random((n_subjects, n_nodes, n_nodes, n_frames))
    x *= rng.random(x.shape) < density
    x = np.triu(x.transpose(0, 3, 1, 2), 1).transpose(0, 2, 3, 1)
    return x + x.transpose(0, 2, 1, 3)


def edges_of(spark, x, cond="c"):
    from netweave.shape import TensorShape

    s, n, _, t = x.shape
    shape = TensorShape((cond,), tuple(f"s{k}" for k in range(s)), n, t)
    rows = [
        (cond, f"s{a}", i, j, f, float(x[a, i, j, f]))
        for a in range(s) for i in range(n) for j in range(i + 1, n) for f in range(t) if x[a, i, j, f] != 0
    ]
    return spark.createDataFrame(rows, "cond string, subj string, i bigint, j bigint, t bigint, w double"), shape


def dense_of(rows, shape, value):
    x = np.zeros((shape.n_subjects, shape.n_nodes, shape.n_nodes, shape.n_frames))
    for r in rows:
        a = shape.subjects.index(r.subj)
        x[a, r.i, r.j, r.t] = x[a, r.j, r.i, r.t] = r[value]
    return x
