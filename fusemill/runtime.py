"""Session-level helpers: shared work folder, lineage cuts, table loading."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables written and not yet deleted: path -> session.
_WRITTEN: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir``; only where it is unset (tests) a local one is made."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = known.get() if known.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="fusemill_ckpt_")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back.

    Unlike a local checkpoint this survives the loss of any executor, and the reader prunes columns. :func:`dropped`
    deletes the table as soon as nothing reads it any more; what is left goes when the session stops.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _forget_at_stop(spark)
    _WRITTEN[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, for files a caller writes itself; deleted when the session stops."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _forget_at_stop(spark)
    _WRITTEN[path] = spark
    return path


def dropped(*tables: DataFrame) -> None:
    """Delete tables of :func:`written`; no DataFrame still to be run may read them. Others are left alone."""
    for df in tables:
        path = getattr(df, "__dict__", {}).get("_written_path")
        if path in _WRITTEN:
            _delete(_WRITTEN.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _forget_at_stop(spark: SparkSession) -> None:
    """Once per Spark context: delete what is left before the context stops, be it by ``stop()`` or at exit."""
    context = spark.sparkContext
    if getattr(context, "_fusemill_cleans", False):
        return
    context._fusemill_cleans = True
    stop = context.stop

    def clean_and_stop() -> None:
        for path in [p for p, s in _WRITTEN.items() if s.sparkContext is context]:
            session = _WRITTEN.pop(path)
            try:
                _delete(session, path)
            except Exception:  # noqa: BLE001  one table that cannot be deleted must not keep the others
                continue
        if context._jsc is not None:
            stop()

    context.stop = clean_and_stop
    atexit.register(lambda: context._jsc is not None and clean_and_stop())


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tasks_for(rows: int, per_task: int, least: int = 1) -> int:
    """Number of tasks so that none gets more than about ``per_task`` rows."""
    return max(least, -(-rows // per_task))


def spread(df: DataFrame) -> DataFrame:
    """For work that is heavy per row: use all cores even where the input is a single small file.

    A plan without shuffles knows its partitions; of others only the estimated size is looked at, so no part of the plan runs for it.
    """
    spark = df.sparkSession
    cores, execution = spark.sparkContext.defaultParallelism, df._jdf.queryExecution()
    if execution.executedPlan().nodeName() == "AdaptiveSparkPlan":
        small = execution.optimizedPlan().stats().sizeInBytes() < cores * spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    else:
        small = execution.toRdd().getNumPartitions() < cores
    return df.repartition(2 * cores) if small else df
