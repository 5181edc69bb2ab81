"""Posting by keyed state: each key is sent once, and every job gets the answer of its key.

What is known of a key (the job that it was sent for, whether the server took it,
and its answer) is streaming state under the checkpoint. The task that holds a key
asks the server, so neither a ledger nor a lock is needed, nobody waits for
another writer, and a batch costs what it brings, however many keys there are.

A batch that is cut off is done over from the state before it: the server may
be asked again then, under the same key, which it must take for the same request.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: ask(xml, key) gives (whether the server took it, its answer); it may raise, which fails the batch.
Ask = Callable[[str, str], tuple[bool, str]]
JOB = "idempotency_key string, job_id string, arrival long, xml string"
STATE = "job_id string, ok boolean, message string"
RESPONSE = "idempotency_key string, job_id string, status string, first_job_id string, message string"
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _place(arrival, job_id, xml) -> tuple:
    """What the first of a key's jobs is least by; nulls come last."""
    late = arrival is None or arrival != arrival
    return late, 0 if late else int(arrival), job_id is None, job_id or "", xml is None, xml or ""


def _answers(ask: Ask):
    names = [c.split()[0] for c in RESPONSE.split(", ")]

    def run(key: tuple, parts: Iterator, state) -> Iterator:
        import numpy as np
        import pandas as pd

        def told(ids: list, mine: str, others: str, first: str, message: str):
            # most keys have few jobs, so a frame is one block of values: making it, or sorting one, would cost more than the rest
            values = np.empty((len(ids), len(names)), dtype=object)
            values[:, 0], values[:, 1], values[:, 3], values[:, 4] = key[0], ids, first, message
            values[:, 2] = [mine if i == first else others for i in ids]
            return pd.DataFrame(values, columns=names, copy=False)

        first, ok, message = state.get if state.exists else (None, False, None)
        waiting, least = [], None
        for pdf in parts:
            ids = pdf["job_id"].tolist()
            if ok:  # ids are not kept: jobs of a known key pass through
                yield told(ids, "posted", "duplicate", first, message)
                continue
            waiting.append(ids)
            place = min(map(_place, pdf["arrival"].tolist(), ids, pdf["xml"].tolist()))
            if least is None or place < least:
                least = place
        if not ok and least is not None:
            first, xml = None if least[2] else least[3], None if least[4] else least[5]
            ok, message = ask(xml, key[0])
            for ids in waiting:
                yield told(ids, *(("posted", "duplicate") if ok else ("failed", "retry_pending")), first, message)
            state.update((first, bool(ok), message))

    return run


def responses(jobs: DataFrame, ask: Ask) -> DataFrame:
    """A stream of jobs (idempotency_key, job_id, arrival, xml) with status, first_job_id and message, one row a job.

    Of the jobs of a new key in one batch the first by arrival (null last), then
    job_id, is sent. If the server takes it, it is posted, and all others of the key,
    now and in later batches, are duplicates with its answer; the same job
    delivered again is posted once more. If not, it is failed and the others are
    retry_pending; a later batch sends the key again. Jobs without a key are unkeyed
    and never sent. No key is forgotten. Jobs of a known key, also of one that makes up
    most of the stream, pass through; of a key that is new in a batch, job ids are
    held, so files of one batch bound them.
    """
    names = [c.split()[0] for c in JOB.split(", ")]
    rows = jobs.select(*(F.col(c).cast(t) for c, t in (x.split() for x in JOB.split(", "))))
    keyed = rows.where("idempotency_key IS NOT NULL").groupBy("idempotency_key").applyInPandasWithState(
        _answers(ask), RESPONSE, STATE, "append", "NoTimeout",
    )
    none = F.lit(None).cast("string")
    unkeyed = rows.where("idempotency_key IS NULL").select(*names[:2], F.lit("unkeyed").alias("status"), none.alias("first_job_id"), none.alias("message"))
    return keyed.unionByName(unkeyed)


def start(jobs: DataFrame, out: str, checkpoint: str, ask: Ask, available_now: bool = False):
    """Start posting a stream of jobs; responses are added to the Parquet folder out, each once, also over restarts with the same checkpoint."""
    spark = jobs.sparkSession
    writer = responses(jobs, ask).writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).option("path", out)
    name, provider = STATE_STORE
    before = spark.conf.get(name)
    spark.conf.set(name, provider)  # the stream takes the setting over when it starts
    try:
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        spark.conf.set(name, before)
