"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: set[str] = set()


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("shelfmark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SHELFMARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package wherever the driver was started.

    On a cluster the package is shipped with ``--py-files`` or installed.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the cluster's ``spark.checkpoint.dir``.

    Where the setting is absent, a local session gets a temporary folder of
    its own; on a cluster, whose machines would not share it, that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    at = "file://" + tempfile.mkdtemp(prefix="shelfmark-")
    spark.sparkContext.setCheckpointDir(at)
    _made.add(at)
    return at


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/shelfmark-{name}-{uuid.uuid4().hex}"
    _made.add(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        _made.discard(path)


class Stored:
    """A table written to the shared folder; ``df`` reads it back.

    The files cut the lineage and outlive lost executors. ``drop()`` removes
    them once a later table has replaced this one.
    """

    def __init__(self, df: DataFrame, name: str = "table"):
        self.spark = df.sparkSession
        self.path = scratch_folder(self.spark, name)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        _delete(self.spark, self.path)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and return the table read from there."""
    return Stored(df, name).df


@atexit.register
def _clean() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        for path in list(_made):
            _delete(spark, path)
