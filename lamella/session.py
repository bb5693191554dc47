"""Session helpers: tuned builder, and tables written to the shared folder.

Lineage is cut by writing a Parquet table, never by localCheckpoint: an executor
that dies must not take the only copy of an intermediate result with it.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}

_own_folders: dict[str, str] = {}
_dropped_at_exit: set[str] = set()


def session(name: str = "lamella", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or get) a session with the defaults the operators assume."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for k, v in (DEFAULTS | conf).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir`` as the cluster names it.

    Only a local session that names none gets a temporary folder, removed at exit;
    any other session without the setting is an error, as a machine-local folder
    would lose rows there.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.getCheckpointDir():
        named = spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = tempfile.mkdtemp(prefix="lamella-")
        atexit.register(shutil.rmtree, _own_folders[app], True)
    return "file://" + _own_folders[app]


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of what was written."""
    spark = df.sparkSession
    folder = _tables_of(spark)
    if folder not in _dropped_at_exit:
        _dropped_at_exit.add(folder)
        atexit.register(_drop, spark, folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def splittable(lookup: DataFrame) -> DataFrame:
    """``lookup`` behind a shuffle of its own, for a join whose other side may have hot keys.

    Adaptive execution splits a hot key only where both sides of the join are plain
    shuffles; an aggregate on the join key would stand in between. The lookup side has
    one row a key, so this costs little.
    """
    return lookup.repartition(F.xxhash64(*lookup.columns))


def _tables_of(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/lamella-{spark.sparkContext.applicationId}"


def _drop(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone before this process
        pass


def drop_written(spark: SparkSession) -> None:
    """Delete all tables this application has written; results read from them end too.

    That also happens when the driver's process ends.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(_tables_of(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def parallelism(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)
