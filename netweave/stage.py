"""Cutting lineage: intermediate tables on the storage the session names."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession

_DIR_KEY = "spark.checkpoint.dir"
_WAREHOUSE_KEY = "spark.sql.warehouse.dir"



class _Scopes(list):
    """Open scopes of this process: never sent along with a function."""

    def __reduce__(self):
        return _Scopes, ([[]],)


_scopes = _Scopes([[]])


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where none is set, a folder below the warehouse if all executors see it.

    That holds for a warehouse on a file system of the cluster and for a local master. Otherwise executors would write
    to folders of their own, so this fails and asks for the setting.
    """
    conf = spark.sparkContext.getConf()
    path = spark.conf.get(_DIR_KEY, None) or conf.get(_DIR_KEY, None)
    if path:
        return path
    warehouse = spark.conf.get(_WAREHOUSE_KEY).rstrip("/")
    files = spark._jvm.org.apache.hadoop.fs.Path(warehouse).getFileSystem(spark._jsc.hadoopConfiguration())
    require_shared(files.getScheme(), spark.sparkContext.master)
    return f"{warehouse}/netweave-staged"


def require_shared(scheme: str, master: str) -> None:
    """Fail where a folder of this scheme is the driver's own."""
    if scheme == "file" and master != "local" and not master.startswith("local["):
        raise ValueError(f"set {_DIR_KEY}: the warehouse is a local folder of the driver and the executors can't see it")


def new_path(spark: SparkSession, label: str = "stage") -> str:
    """A fresh folder name on shared storage, removed with the scope that made it."""
    path = f"{shared_dir(spark)}/netweave-{label}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    _scopes[-1].append((where.getFileSystem(spark._jsc.hadoopConfiguration()), where))
    return path


def stage(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: survives lost executors.

    ``partition_by`` lays the table out by directory so later filters prune files.
    """
    spark = df.sparkSession
    path = new_path(spark)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_rows(rows: RDD, spark: SparkSession, checkpointed: bool) -> RDD:
    """Keep what an iteration reads again on the executors' disks; ``checkpointed``, on the shared folder too, which cuts lineage."""
    rows = rows.persist(StorageLevel.DISK_ONLY)
    if checkpointed:
        spark.sparkContext.setCheckpointDir(new_path(spark, "checkpoint"))
        rows.checkpoint()
    return rows


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """Tables staged inside are deleted at its end: consume results before leaving it."""
    _scopes.append([])
    try:
        yield
    finally:
        _delete(_scopes.pop())


def _delete(paths: list) -> None:
    for files, path in paths:
        with contextlib.suppress(Exception):  # the session's JVM may be gone already
            files.delete(path, True)
    paths.clear()


@atexit.register
def _delete_rest() -> None:
    for paths in _scopes:
        _delete(paths)
