"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders made by this process that ``clear`` may remove.
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where that is unset, a temporary folder if all runs on this
    machine, as in tests; on a cluster an error, as executors would write to disks of their own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.conf.get("spark.master", "")
        if master.split("[")[0] != "local" or master.startswith("local-cluster"):
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {master})")
        named = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder or file, if it is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def clear(spark: SparkSession) -> int:
    """Removes the intermediate tables that this process has written; returns how many.

    To be called when no DataFrame made so far is needed any more: plans read these tables.
    """
    made = _MADE.copy()
    for path in made:
        delete(spark, path)
        _MADE.remove(path)
    return len(made)


def others(spark: SparkSession, folder: str, kept: set[str]) -> list[str]:
    """What is in ``folder`` besides ``kept``."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in files.listStatus(place)] if files.exists(place) else []
    return [p.toString() for p in found if p.getName() not in kept]


def _numbered(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the complete versions in ``folder``, in order."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return []
    names = [s.getPath().getName() for s in files.listStatus(place)]
    done = [n for n in names if n.isdigit() and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
    return sorted(map(int, done))


def publish(df: DataFrame, folder: str) -> None:
    """Makes the small table ``df`` the current version of ``folder``.

    A version is a new numbered folder that counts once it is complete, so readers find the last one or this
    one, and a crash leaves the last. The version before is kept for those who read it now. There is one writer at a time.
    """
    spark = df.sparkSession
    numbers = _numbered(spark, folder)
    df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{numbers[-1] + 1 if numbers else 1:012d}")
    for n in numbers[:-1]:
        delete(spark, f"{folder}/{n:012d}")


def published(spark: SparkSession, folder: str, schema: str) -> list | None:
    """Rows of the current version of ``folder``, which are few; nothing if there is none."""
    numbers = _numbered(spark, folder)
    return spark.read.schema(schema).parquet(f"{folder}/{numbers[-1]:012d}").collect() if numbers else None


def written(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage: ``df`` written there as Parquet and read again.

    A later failure re-reads the table; nothing is recomputed, and no executor's own copy is needed.
    ``clear`` removes the table.
    """
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
