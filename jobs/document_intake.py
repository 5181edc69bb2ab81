"""Document intake: a register of submitted documents, each text once, that grows with its inbox.

    python -m jobs.document_intake INBOX OUT CHECKPOINT [--config jobs/document_intake.json]

INBOX is a folder of Parquet files (doc_id, text, source) that others add files to, or a
pattern of such folders or files. A run takes the files that no earlier run with the same CHECKPOINT took, and ends.
Texts that differ in white space and case alone are one content, sent in again;
the register tells who sent it first, how often it came, its OCR language, and
whether extraction should take it:

- accepted, or empty (no words), or too_long (more pages than extraction takes)

OUT/updates holds, by batch and state, the contents that a batch brought or saw
again, with their figures as of that batch; `register` reads the latest of each.
What is known of a content is streaming state, kept under CHECKPOINT by key, so a
run costs what its new files cost and never reads the older ones. Within a batch
a content is combined before the shuffle, so one that makes up most of the inbox is
no hot spot. A batch that was cut off is done over with the same files, and
replaces its own partitions.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import settings
from ledgerloom.functions.text import collapse
from ledgerloom.sources import documents

log = logging.getLogger("jobs.document_intake")
INBOX = "doc_id long, text string, source string"
UPDATE = (
    "content_key string, first_doc_id long, last_doc_id long, tenant string, language string, n_chars long, n_words long, n_docs long, batch long, "
    "state string"
)
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@dataclass(frozen=True)
class Config:
    """OCR languages by tenant, what extraction takes at most, and files of one batch."""

    languages: dict[str, str] = field(default_factory=dict)
    default_language: str = "eng"
    max_pages: int = 20
    page_chars: int = 1000
    files_per_batch: int = 1000


def contents(docs: DataFrame, config: Config) -> DataFrame:
    """(content_key, first, last_doc_id, n_docs) of docs, streaming or not: first is the row of the least id, rows without an id last."""
    text = F.coalesce("text", F.lit(""))
    plain = F.trim(collapse(F.lower(text)))
    rows = docs.select(
        F.sha2(plain, 256).alias("content_key"), "doc_id", F.col("source").alias("tenant"),
        documents.tenant_language(F.col("source"), config.languages, config.default_language).alias("language"),
        F.length(text).cast("long").alias("n_chars"), F.when(plain == "", 0).otherwise(F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit(""))) + 1).cast("long").alias("n_words"),
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "tenant", "language", "n_chars", "n_words"))
    return rows.groupBy("content_key").agg(first.alias("first"), F.max("doc_id").alias("last_doc_id"), F.count("*").alias("n_docs"))


def run(spark: SparkSession, inbox: str, out: str, checkpoint: str, config: Config = Config()) -> DataFrame:
    """Take what is new in the inbox; the result is the register as it stands then."""
    updates = f"{out}/updates"

    def write(batch: DataFrame, number: int) -> None:
        pages = F.ceil(F.col("first.n_chars") / config.page_chars)
        state = F.when(F.col("first.n_words") == 0, "empty").when(pages > config.max_pages, "too_long").otherwise("accepted")
        rows = batch.select(
            "content_key", F.col("first.doc_id").alias("first_doc_id"), "last_doc_id", "first.tenant", "first.language", "first.n_chars", "first.n_words", "n_docs",
            F.lit(number).cast("long").alias("batch"), state.alias("state"),
        )
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "state").parquet(updates)
        settings.logged(log, f"batch {number} wrote", batch.sparkSession.read.schema(UPDATE).parquet(updates).where(F.col("batch") == number), updates)

    stream = spark.readStream.schema(INBOX).option("maxFilesPerTrigger", config.files_per_batch).parquet(inbox)
    writer = contents(stream, config).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    name, provider = STATE_STORE
    before = spark.conf.get(name)
    spark.conf.set(name, provider)  # the stream takes the setting over when it starts
    try:
        query = writer.trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before)
    query.awaitTermination()
    log.info("read %d rows of new files: %s", sum(p.numInputRows for p in query.recentProgress), inbox)
    return register(spark, out)


def register(spark: SparkSession, out: str) -> DataFrame:
    """(content_key, first_doc_id, last_doc_id, tenant, language, n_chars, n_words, n_docs, state), one row a content; none before the first batch."""
    try:
        rows = spark.read.schema(UPDATE).parquet(f"{out}/updates")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], UPDATE)
    told = [c for c in rows.columns if c not in ("content_key", "batch")]
    return rows.groupBy("content_key").agg(F.max_by(F.struct(*told), "batch").alias("r")).select("content_key", "r.*")


def main() -> None:
    asked = settings.parser(__doc__.splitlines()[0], ("inbox", "folder of Parquet files"), ("out", "folder of the register"), ("checkpoint", "folder of the stream's progress")).parse_args()
    spark = settings.session("document_intake")
    try:
        run(spark, asked.inbox, asked.out, asked.checkpoint, settings.read(spark, asked.config, Config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
