"""Micro-batch posting: each key once, over any number of batches, restarts and writers.

The ledger is a folder: ``claims/batch=N`` holds the rows that batch N posts,
written before anything is uploaded, and ``answers/batch=N`` (idempotency_key, ok,
...) what the server said; a row that it refused counts as not posted.
Writing a batch again replaces its folder, so a batch that was cut off half-way is
done over with the very same rows, under the same idempotency keys. Only one
writer holds the ledger at a time, by a lock file that a file system creates once.
"""

from __future__ import annotations

import contextlib
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import workflow
from ..sources import shared

#: Folders by the first signs of a key, so that a small batch reads the few that hold its keys.
PREFIX = 2


@contextlib.contextmanager
def locked(spark: SparkSession, path: str, wait: float = 600.0, step: float = 0.2) -> Iterator[None]:
    """Hold the ledger alone; a TimeoutError names the holder's file after waiting in vain."""
    began = time.monotonic()
    while not shared.create(spark, f"{path}/_lock"):
        if time.monotonic() - began > wait:
            raise TimeoutError(f"{path}/_lock is held; remove it if its writer has died")
        time.sleep(step)
    try:
        yield
    finally:
        shared.delete(spark, f"{path}/_lock")


def posted(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All rows of the ledger (its claims), with the batch that posted them."""
    full = StructType(list(schema.fields)).add("batch", "string").add("prefix", "string")
    if not shared.exists(spark, f"{path}/claims"):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(f"{path}/claims")


ANSWER = "idempotency_key string, job_id string, ok boolean, message string, batch string"


def answers(spark: SparkSession, path: str) -> DataFrame:
    """(idempotency_key, job_id, ok, message, batch): all that the server said; null where an upload does not tell."""
    if not shared.exists(spark, f"{path}/answers"):
        return spark.createDataFrame([], ANSWER)
    return spark.read.schema(ANSWER).parquet(f"{path}/answers")


def done(spark: SparkSession, path: str, schema: StructType, uploading: bool = False) -> DataFrame:
    """Rows of the ledger that count as posted.

    Where rows are uploaded, those that the server took: a claim that it refused, or
    was never asked about because its batch died, may be posted again. Else all but
    those refused.
    """
    rows, keys = posted(spark, path, schema), ["batch", "idempotency_key"]
    if uploading:
        return rows.join(answers(spark, path).where("ok").select(*keys), keys, "left_semi")
    return rows.join(answers(spark, path).where("NOT ok").select(*keys), keys, "left_anti")


def first_answers(spark: SparkSession, path: str) -> DataFrame:
    """(idempotency_key, first_job_id, first_message) of keys that the server took: what duplicates are answered with."""
    taken = answers(spark, path).where("ok").groupBy("idempotency_key").agg(F.min(F.struct("batch", "job_id", "message")).alias("a"))
    return taken.select("idempotency_key", F.col("a.job_id").alias("first_job_id"), F.col("a.message").alias("first_message"))


def unanswered(spark: SparkSession, path: str) -> list[str]:
    """Numbers of batches that claimed rows and have no answers: they are at work, or died before they were through."""
    system, _ = shared.files(spark, path)

    def whole(kind: str) -> set[str]:
        found = system.globStatus(shared.files(spark, f"{path}/{kind}/batch=*/_SUCCESS")[1])
        return {x.getPath().getParent().getName().removeprefix("batch=") for x in found or ()}

    return sorted(whole("claims") - whole("answers"))


def _ask(spark: SparkSession, path: str, number: str, upload: Callable[[DataFrame], DataFrame]) -> None:
    """Upload what a batch claimed, and keep the answers."""
    claimed = spark.read.parquet(f"{path}/claims/batch={number}").drop("prefix")
    upload(claimed).write.mode("overwrite").parquet(f"{path}/answers/batch={number}")


def post_batch(batch: DataFrame, path: str, upload: Callable[[DataFrame], DataFrame] | None = None, number: str | None = None, wait: float = 600.0) -> DataFrame:
    """Post the rows of one batch that are new against the ledger at path; what comes back is read from there.

    With upload, the answers (upload's rows) of the new rows, else the rows; a row
    that another batch posted first is in neither. A number that was posted before
    stands for the same batch: its rows are claimed and uploaded as they were then,
    and answers that exist are not asked for again. Claims of batches that died before
    their answers are uploaded first, under their own keys: nobody else holds the ledger.
    """
    spark = batch.sparkSession
    number = uuid.uuid4().hex if number is None else str(number)
    schema = batch.schema
    mine = F.col("batch") == number
    with locked(spark, path, wait):
        if not shared.exists(spark, f"{path}/answers/batch={number}/_SUCCESS"):
            for other in unanswered(spark, path) if upload is not None else ():
                _ask(spark, path, other, upload)
            if not shared.exists(spark, f"{path}/claims/batch={number}/_SUCCESS"):
                prefix = F.substring("idempotency_key", 1, PREFIX)
                keyed = batch.withColumn("prefix", prefix)
                known = done(spark, path, schema, upload is not None).where(~mine)
                # a small batch is broadcast, and prunes the ledger's folders as well as its rows
                known = known.join(keyed.select("prefix", "idempotency_key").distinct(), ["prefix", "idempotency_key"], "left_semi")
                new = workflow.post_once(batch, known).where("post_status = 'new'").drop("post_status")
                new.withColumn("prefix", prefix).write.mode("overwrite").partitionBy("prefix").parquet(f"{path}/claims/batch={number}")
                if upload is not None:
                    upload(posted(spark, path, schema).where(mine).select(*schema.names)).write.mode("overwrite").parquet(f"{path}/answers/batch={number}")
    if upload is not None:
        return spark.read.parquet(f"{path}/answers/batch={number}")
    return posted(spark, path, schema).where(mine).select(*schema.names)


def start(stream: DataFrame, path: str, checkpoint: str, upload=None, available_now: bool = False):
    """A stream of invoices with idempotency_key and arrival, posted once each; restarts go on from the checkpoint."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex

    def post(batch: DataFrame, n: int) -> None:
        post_batch(batch, path, upload, f"{name}-{n}")

    writer = stream.writeStream.foreachBatch(post).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
