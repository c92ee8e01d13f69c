"""Tables written once to the shared folder, to cut the lineage of iterative plans."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and all runs on one machine
    (tests, local runs) the warehouse folder serves.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir") + "/_staging"


def root(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/quillon-graph-{spark.sparkContext.applicationId}"


_swept: set[str] = set()


def sweep_at_exit(spark: SparkSession, clear_all) -> None:
    """Has the application's tables deleted when its driver ends."""
    key = f"{spark.sparkContext.applicationId} {clear_all.__module__}"

    def sweep() -> None:
        with contextlib.suppress(Exception):  # the session may be gone by then
            clear_all(spark)

    if key not in _swept:
        _swept.add(key)
        atexit.register(sweep)


def staged(df: DataFrame, name: str) -> DataFrame:
    sweep_at_exit(df.sparkSession, clear)
    path = f"{root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with _shuffles_cleaned(df.sparkSession):
        df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._staged = path
    return found


@contextlib.contextmanager
def _shuffles_cleaned(spark: SparkSession):
    """Shuffle files of what runs inside go with it, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    if before is None:  # a Spark without it
        yield
        return
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(df: DataFrame) -> None:
    """Deletes a table of ``staged`` that nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Counts the times that all tables of the application went.
_cleared = 0


def kept(owner, name: str, make) -> DataFrame:
    """``make()`` written once for ``owner`` (an object with a ``spark``), as long as its table is there."""
    memo = owner.__dict__.setdefault("_kept", {})
    found = memo.get(name)
    if found is None or found[0] != _cleared:
        found = memo[name] = (_cleared, staged(make(), name))
    return found[1]


def clear(spark: SparkSession) -> None:
    global _cleared
    _cleared += 1
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
