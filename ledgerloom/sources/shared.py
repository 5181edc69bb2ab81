"""Places in a folder that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path under ``spark.checkpoint.dir``, which lasts as long as the application, or stays; only a local master may do without the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="ledgerloom-")
    root = f"{root.rstrip('/')}/ledgerloom/{name}-{uuid.uuid4().hex}"
    if not keep:
        until_exit(spark, root)
    return f"{root}/tables"


def dealt(rows: DataFrame, by: str) -> DataFrame:
    """rows over as many tasks as shuffles have, which are not joined up again by their bytes: for rows whose judging costs far more than moving them."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)


def few(rows: DataFrame, most: int) -> bool:
    """Whether there are at most so many rows; of each part no more than these are read."""
    return rows.limit(most + 1).count() <= most


#: Rows up to which a side of a join may go to all tasks.
SIDE_ROWS = 10_000


def side(rows: DataFrame, small: bool) -> DataFrame:
    """rows as a side of a join: Spark chooses how if they are few, else both are sorted and merged.

    What goes to all tasks passes through the driver. Spark judges that by the size of
    files, of which names with their signatures unpack to 40 times as much.
    """
    return rows if small else rows.hint("merge")


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Within it, what a query shuffled goes when the query ends, not when the driver happens to collect its garbage.

    For writes: what a DataFrame shuffled for one action is then not there for its next.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def kept(rows: DataFrame, path: str) -> DataFrame:
    """rows, written for later steps and read from there."""
    with freed(rows.sparkSession):
        rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def until_exit(spark: SparkSession, path: str) -> None:
    """Make a folder that goes, with all in it, when the application ends."""
    system, place = files(spark, path)
    system.mkdirs(place)
    system.deleteOnExit(place)


def files(spark: SparkSession, path: str):
    """(file system, path) of a place, as Spark's readers see it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = files(spark, path)
    return system.exists(place)


def create(spark: SparkSession, path: str) -> bool:
    """Create an empty file; False if it is there already. One caller alone gets True."""
    system, place = files(spark, path)
    if system.getUri().getScheme() == "file":  # whose Hadoop wrapper looks first and then creates
        place = system.makeQualified(place).toUri().getPath()
        os.makedirs(os.path.dirname(place), exist_ok=True)
        try:
            os.close(os.open(place, os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            return False
        return True
    try:
        system.create(place, False).close()
    except Py4JJavaError as failed:
        if "AlreadyExists" not in str(failed.java_exception):
            raise
        return False
    return True


def delete(spark: SparkSession, path: str) -> None:
    system, place = files(spark, path)
    system.delete(place, True)


def replace(spark: SparkSession, new, old) -> None:
    """Rename a file (a qualified path) over another in one step, so that readers always find one of the two."""
    jvm = spark.sparkContext._jvm
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(kind, 1)
    over[0] = kind.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(old.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(new, old, over)
