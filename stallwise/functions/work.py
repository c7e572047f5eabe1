"""Where intermediate tables go.

The folder must be visible to every executor, so it is the one that the cluster names in
``spark.checkpoint.dir``. A folder of our own is made only in local mode with none set.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="stallwise-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stallwise/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, never used before."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def lasting_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that outlives the application."""
    return f"{shared_folder(spark)}/stallwise/lasting/{name}"


def input_files(spark: SparkSession, path: str) -> dict[str, str]:
    """The data files of a table, one file or a folder with any partitions, and what tells their versions apart."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = {}
    listed = files.listFiles(where, True)
    while listed.hasNext():
        status = listed.next()
        name = status.getPath().toString()
        inside = name.split(path.rstrip("/").rpartition("/")[2], 1)[-1].split("/")
        if not any(part.startswith(("_", ".")) for part in inside if part):
            found[name] = f"{status.getLen()}-{status.getModificationTime()}"
    return found


PART_ROWS = 1 << 20  # that one task sorts or holds at once


def parts_for(spark: SparkSession, rows: int) -> int | None:
    """How many parts that many rows need for none to be larger than PART_ROWS or so.

    None where the session's own number of partitions is enough: adaptive execution may then merge small ones.
    """
    parts = -(-rows // PART_ROWS)
    return parts if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def retire(spark: SparkSession) -> None:
    """Delete every table that this application has written to the shared folder.

    For the end of a job, when no DataFrame that reads them is used any more.
    """
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it from there.

    Later stages then see fixed rows, also after an executor is lost, and what is used
    several times is computed once. As parquet it keeps column pruning and a known size.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
