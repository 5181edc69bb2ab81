"""One batch of invoice files from a folder to the accounting server, with what each stage made kept as tables.

The stages that ask something outside (OCR, a language model, the server) write
what they got before the next one reads it, so nobody is asked twice, also when a
batch with the same number is started again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import variants as v
from ..sinks import files, upload
from ..sources import documents, providers, shared
from ..sources import rules as rule_files
from ..streaming import posting
from . import jobs


@dataclass
class Outside:
    """What a batch asks: readers by branch, the extraction provider, and the transport to the server (None: nothing is sent)."""

    readers: dict[str, documents.Reader]
    provider: providers.Provider
    transport: Callable[[str, str], tuple[int, str]] | None = None
    attempts: int = 3
    delay: float = 1.0
    languages: dict[str, str] = field(default_factory=dict)
    default_language: str = "eng"
    flags: dict[str, bool] = field(default_factory=dict)
    limits: documents.Limits = field(default_factory=documents.Limits)


def _once(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, made if it is not there whole."""
    if not shared.exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def run(asked: DataFrame, folder: str, master: DataFrame, rules: DataFrame, root: str, number: str, outside: Outside, config: jobs.JobConfig | None = None) -> DataFrame:
    """asked (job_id, tenant_id, operator, arrival, path) with their final states; tables below root keep every stage.

    raw_text, extracted, processed, learned (rules), ledger (claims and answers of
    posted vouchers), review_queue (JSON lines), vouchers (XML) and jobs are
    partitioned by batch. If asked have approved (boolean), names that a policy created
    for approved jobs of tenants that learn become rules, which later batches go by
    beside those given. Duplicates have the answer that the first of their key got.
    """
    config = config or jobs.JobConfig()
    spark = asked.sparkSession
    place = lambda stage: f"{root}/{stage}/batch={number}"
    read = _once(spark, place("raw_text"), lambda: documents.extract(
        documents.listed(spark, asked.select("path", "tenant_id").distinct(), folder), outside.readers, outside.languages, outside.default_language, outside.flags, outside.limits))
    texts = asked.join(read.select("path", "tenant_id", "text", F.col("error").alias("read_error")), ["path", "tenant_id"], "left")
    told = _once(
        spark, place("extracted"),
        lambda: providers.extract(texts.where("read_error IS NULL"), outside.provider, attempts=outside.attempts, delay=outside.delay),
    )
    found = texts.join(told.select("job_id", "payload", "error"), "job_id", "left")
    approved = F.col("approved") if "approved" in asked.columns else F.lit(False)
    found = found.select(
        approved.alias("approved"), "job_id", "tenant_id", "operator", "arrival", v.parse_json(F.col("payload")).alias("payload"),
        F.coalesce("read_error", "error").alias("payload_error"),
    )
    ledger, keys = f"{root}/ledger", "idempotency_key string"
    sending = outside.transport is not None and not config.dry_run
    known_rules = rules.unionByName(rule_files.learned_before(spark, f"{root}/learned", number).select(*rules.columns))

    def process() -> DataFrame:
        known = posting.done(spark, ledger, spark.createDataFrame([], keys).schema, sending).where(F.col("batch") != number)
        return jobs.process(found, master, known_rules, known.select("idempotency_key"), config)

    done = _once(spark, place("processed"), process)
    if config.learning:
        _once(spark, place("learned"), lambda: rule_files.from_approvals(jobs.learn(done, known_rules, config)))
    if sending:
        waiting = jobs.ready(done).withColumn("arrival", F.lit(0))
        answers = posting.post_batch(waiting, ledger, lambda rows: upload.upload(rows, outside.transport), number)
        done = jobs.finish(done, answers.select("job_id", "ok", "message"), config, posting.first_answers(spark, ledger))
    done = _once(spark, place("jobs"), lambda: done)
    if not shared.exists(spark, f"{place('vouchers')}/_SUCCESS"):
        files.append_review_queue(jobs.review_queue(done), place("review_queue"), "overwrite")
        files.write_voucher_xml(done.where("xml IS NOT NULL"), place("vouchers"))
    return done
