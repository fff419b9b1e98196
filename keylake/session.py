"""Session helpers: shared storage for cut lineage, and table access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where none is named and the master is local (tests), a temporary folder is made once and set on the session's context.
    Elsewhere that is an error, as executors would write to their own disks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    own = spark.sparkContext.getCheckpointDir()
    if not own and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not own:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        own = spark.sparkContext.getCheckpointDir()
    return own


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own for one intermediate result, below the run's folder in the shared folder."""
    return f"{shared_dir(spark)}/keylake-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    """Remove a folder, by any path that Spark can write."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop(df: DataFrame) -> None:
    """Remove the files of a materialised DataFrame that nothing will read any more; others are left alone."""
    own = f"/keylake-{df.sparkSession.sparkContext.applicationId}/"
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles() if own in f}:
        remove(df.sparkSession, folder)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like the wanted ones that df does not have, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage is cut and a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df dealt anew over all cores, for work on rows that costs far more than a shuffle of them.

    Files may be few, or hold all rows in one row group, which one task reads whatever its size.
    """
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a dataset folder, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
