"""Session helpers: where intermediate tables go, and how a lineage is cut so that a lost executor costs nothing."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local folder is made if all of Spark runs in one process; on a cluster executors could not read
    each other's files there, so an error is raised instead.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="weftline-")
    return f"file://{_LOCAL[app]}"


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone; the cluster's own clean-up remains
        pass


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a compressed columnar table into the shared folder and read it again.

    Cuts the lineage like ``checkpoint()``, but keeps columns separate, so that each later branch reads only what it
    needs. The table survives the loss of any executor. It is removed by ``release``, at the latest when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftline-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_delete, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.weftline_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` wrote and that no later plan reads."""
    for df in tables:
        path = getattr(df, "weftline_path", None)
        if path:
            _delete(df.sparkSession, path)


def sweep(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that are done: it does so when the driver's garbage is collected, which a large heap puts off."""
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Spread a table that is read in fewer partitions than there are cores, before work in Python that one task would do alone.

    Such a table is small for the cluster: each partition holds ``spark.sql.files.maxPartitionBytes`` at most, so the
    shuffle is bounded by that times the cores. Larger tables are left as they are read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
