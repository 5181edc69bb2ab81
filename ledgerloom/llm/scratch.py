"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes on disk up to which a saved table is broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: Rows of a narrow table for which a task of its own pays.
ROWS_PER_TASK = 20_000


def few(df: DataFrame, rows: int) -> DataFrame:
    """df in no more tasks than its rows pay for; large tables stay as they are."""
    return df.coalesce(-(-rows // ROWS_PER_TASK) or 1) if rows < 100 * ROWS_PER_TASK else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Scratch:
    """Parquet tables under ``spark.checkpoint.dir``.

    The setting is read from the session. Only on a local master, as in tests, a
    temporary folder of this machine takes its place where it is unset; a cluster
    without the setting is refused, for its executors would write to folders that
    the others cannot see. A table that was saved does not depend on earlier
    stages, so lost executors cost no rerun of them.
    """

    def __init__(self, spark: SparkSession, name: str):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.conf.get("spark.master", "local").startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            root = tempfile.mkdtemp(prefix="ledgerloom-")
        small_batches(spark)
        self.spark, self.root = spark, f"{root.rstrip('/')}/ledgerloom/{name}-{uuid.uuid4().hex}"
        files, path = self._at("")
        files.mkdirs(path)
        files.deleteOnExit(path)  # the folder lasts as long as the application

    def save(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """The table, written and read again. With about how many rows it comes from, small tables take few tasks."""
        if rows is not None:
            df = few(df, rows)
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def side(self, df: DataFrame, name: str) -> DataFrame:
        """The table as one side of a join, saved, and broadcast if what was written is small."""
        saved = self.save(df, name)
        files, path = self._at(name)
        return F.broadcast(saved) if files.getContentSummary(path).getLength() <= BROADCAST_BYTES else saved

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more."""
        for name in names:
            files, path = self._at(name)
            files.delete(path, True)

    def _at(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path


#: Texts that an Arrow batch holds at most.
BATCH_ROWS = 250


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python workers in batches of at most BATCH_ROWS rows, so that long ones fit their memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def shared(spark: SparkSession, model):
    """A broadcast of a dataclass's fields. Broadcast values are pickled by reference, so of the instance workers would need this package."""
    return spark.sparkContext.broadcast(tuple(vars(model).values()))
