"""Registered queries: sources, routing, posting, audit and replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import variants as v
from ..operators import jobs, workflow
from ..sources import documents, master, providers, shared
from . import bindings as b
from .catalog import query
from .matching import _INVOICE_RES, invoice_report


@query("master_party_filter", """SELECT n_name, count(*) AS n FROM (SELECT c_nationkey, CASE c_custkey % 4 WHEN 0 THEN c_name || ' (Sundry DEBTORS)' WHEN 1 THEN 'Bank ' || c_custkey WHEN 2 THEN 'Vendor ' || c_custkey ELSE c_name END AS name FROM customer)
JOIN nation ON n_nationkey = c_nationkey WHERE regexp_matches(lower(name), 'debtor|creditor|customer|vendor') GROUP BY n_name""")
def master_party_filter(spark, sf_dir):
    n = F.col("c_custkey") % 4
    name = F.when(n == 0, F.concat("c_name", F.lit(" (Sundry DEBTORS)"))).when(n == 1, F.concat(F.lit("Bank "), "c_custkey")).when(n == 2, F.concat(F.lit("Vendor "), "c_custkey")).otherwise(F.col("c_name"))
    rows = b.table(spark, sf_dir, "customer").select("c_nationkey", name.alias("name")).where(master.is_party(F.col("name")))
    return rows.join(b.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


@query("master_collections", """
WITH s AS (SELECT s_suppkey AS n, CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 3 = 0 THEN s_name || ' & Co (Creditors)' ELSE s_name END AS name FROM supplier),
r AS (SELECT name, CASE WHEN n % 2 = 0 THEN 'M' || n END AS code, CASE WHEN n % 2 = 0 THEN 'S ' || n || '|T ' || n ELSE '' END AS aliases FROM s WHERE name IS NOT NULL)
SELECT 'ledger' AS entity_type, * FROM r UNION ALL SELECT 'party', * FROM r WHERE name LIKE '%(Creditors)'""")
def master_collections(spark, sf_dir):
    """Suppliers as ledgers of an XML export, read in parts and kept as a snapshot, which the second call finds."""
    n, text = F.col("s_suppkey"), lambda *c: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in c))
    name = F.when(n % 5 == 0, " ").when(n % 3 == 0, text(F.col("s_name"), " &amp; Co (Creditors)")).otherwise(F.col("s_name"))
    full = text("<LEDGER><Name>", name, "</Name><MASTERID> M", n, " </MASTERID><ALIASES>S ", n, ", T ", n, ",</ALIASES></LEDGER>")
    short = text('<LEDGER NAME="', name, '"/>')
    place = shared.folder(spark, "collections")
    b.table(spark, sf_dir, "supplier").select(F.when(n % 2 == 0, full).otherwise(short)).write.text(f"{place}/export")

    def fetch():
        ledgers = master.read_collection_files(spark, f"{place}/export", "ledger", "LEDGER")
        return ledgers.unionByName(ledgers.where(master.is_party(F.col("name"))).withColumn("entity_type", F.lit("party")))

    for _ in range(2):
        rows = master.cached(spark, f"{place}/cache", fetch)
    return rows.where("source = 'cache'").select("entity_type", "name", "code", F.array_join("aliases", "|").alias("aliases"))


@query("alias_split", "SELECT s_suppkey, s_name || '|S ' || s_suppkey AS aliases, 2 AS n FROM supplier")
def alias_split(spark, sf_dir):
    aliases = master.split_aliases(F.concat(F.lit(" , "), "s_name", F.lit(" ,, S "), "s_suppkey", F.lit(", ")))
    return b.table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(aliases, "|").alias("aliases"), F.size(aliases).alias("n"))


@query("route_by_extension", """SELECT page_id, CASE page_id % 7 WHEN 0 THEN '.pdf' WHEN 1 THEN '.png' WHEN 2 THEN '.docx' WHEN 3 THEN '.gif' WHEN 4 THEN '' WHEN 5 THEN '.tiff' ELSE '.tif' END AS extension,
  CASE page_id % 7 WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' WHEN 2 THEN 'word' WHEN 3 THEN 'image' WHEN 4 THEN 'unsupported' ELSE 'image' END AS branch FROM pages""")
def route_by_extension(spark, sf_dir):
    ends = F.element_at(F.array(*map(F.lit, (".PDF", ".png", ".docx", ".gif", "", ".Tiff", ".TIF"))), (F.col("page_id") % 7 + 1).cast("int"))
    rows = b.table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/in.box/doc"), "page_id", ends).alias("path"))
    return rows.select("page_id", documents.extension(F.col("path")).alias("extension"), documents.branch(F.col("path")).alias("branch"))


@query("page_join_text", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text, count(*) AS n_pages FROM conversations GROUP BY conv_id")
def page_join_text(spark, sf_dir):
    return documents.join_pages(b.table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query("ocr_config_by_tenant", "SELECT doc_id, CASE source WHEN 'src1' THEN 'deu' WHEN 'src2' THEN 'fra' ELSE 'eng' END AS language FROM documents")
def ocr_config_by_tenant(spark, sf_dir):
    return b.table(spark, sf_dir, "documents").select(
        "doc_id", documents.tenant_language(F.col("source"), {"src1": "deu", "src2": "fra", "src3": ""}, "eng").alias("language"),
    )


@query("retry_classification", """SELECT event_id, event_id % 5 IN (0, 1) OR event_id % 7 IN (2, 4) AS transient FROM events""")
def retry_classification(spark, sf_dir):
    message = F.element_at(
        F.array(*map(F.lit, ("Read TIMED OUT", "429 from server", "bad request", "invalid key", "not found"))),
        (F.col("event_id") % 5 + 1).cast("int"),
    )
    status = F.element_at(F.array(*map(F.lit, (200, 404, 503, 400, 408, 401, 499))), (F.col("event_id") % 7 + 1).cast("int"))
    return b.table(spark, sf_dir, "events").select("event_id", workflow.is_transient(message, status).alias("transient"))


@query("route_review", f"""{_INVOICE_RES}, g AS (SELECT invoice_id, count(*) AS n, bool_or(action = 'reject') AS blocking, count(*) FILTER (action = 'manual_review') AS manual FROM iss GROUP BY invoice_id),
r AS (SELECT d.invoice_id, CASE WHEN coalesce(blocking, false) THEN 'validation_failed' WHEN coalesce(manual, 0) > 0 THEN 'manual_review_required' WHEN d.invoice_id % 5 = 0 THEN 'low_confidence' WHEN d.invoice_id % 13 = 0 THEN 'validation_failed' END AS reason,
  CASE WHEN coalesce(blocking, false) THEN n ELSE coalesce(manual, 0) END AS queued FROM d LEFT JOIN g USING (invoice_id))
SELECT invoice_id, CASE WHEN reason IS NULL THEN 'continue' ELSE 'review' END AS route, reason, queued FROM r""")
def route_review(spark, sf_dir):
    confidence = F.when(F.col("invoice_id") % 5 == 0, 0.79).otherwise(0.8)
    rows = invoice_report(spark, sf_dir).withColumn("r", workflow.route(F.col("issues"), confidence, F.col("invoice_id") % 13 == 0))
    return rows.select("invoice_id", "r.route", "r.reason", F.size("r.queued").cast("bigint").alias("queued"))


@query("idempotency_dedup", f"""WITH {b.SQL}, z AS (
  SELECT *, sha256(invoice_number || '|' || strftime(invoice_date, '%Y-%m-%d') || '|' || CAST(total AS VARCHAR) || '|' || coalesce(seller, 'None') || '|' || coalesce(buyer, 'None')) AS idempotency_key FROM inv
), a AS (SELECT invoice_id, idempotency_key, invoice_id * 2 AS arrival FROM z UNION ALL SELECT invoice_id, idempotency_key, invoice_id * 2 + 1 FROM z WHERE invoice_id % 3 = 0)
SELECT arrival, idempotency_key, CASE WHEN invoice_id % 10 <> 0 AND arrival % 2 = 0 THEN 'new' ELSE 'duplicate' END AS post_status FROM a""")
def idempotency_dedup(spark, sf_dir):
    text = lambda c: F.col(c).cast("string")
    rows = b.invoices(spark, sf_dir).withColumn(
        "idempotency_key", workflow.idempotency_key(text("invoice_number"), text("invoice_date"), text("total"), F.col("seller"), F.col("buyer")),
    )
    place = shared.folder(spark, "keys")
    rows.select("invoice_id", "idempotency_key").write.parquet(place)  # read three times
    rows = spark.read.parquet(place)
    batch = rows.select("invoice_id", "idempotency_key", (F.col("invoice_id") * 2).alias("arrival")).unionByName(
        rows.where("invoice_id % 3 = 0").select("invoice_id", "idempotency_key", (F.col("invoice_id") * 2 + 1).alias("arrival"))
    )
    posted = rows.where("invoice_id % 10 = 0").select("idempotency_key")
    return workflow.post_once(batch, posted).select("arrival", "idempotency_key", "post_status")


@query("job_states", f"""WITH {b.SQL}, j AS (
  SELECT invoice_id, invoice_id % 10 AS n, seller IS NULL OR invoice_id % 10 = 2 AS blocked, '' AS again FROM inv UNION ALL SELECT invoice_id, invoice_id % 10, seller IS NULL, 'b' FROM inv WHERE invoice_id % 10 IN (5, 7))
SELECT invoice_id || again AS job_id,
  CASE WHEN n IN (3, 4) THEN 'failed' WHEN n = 0 OR blocked OR n = 1 THEN 'review_required' WHEN n = 7 AND again = 'b' THEN 'retry_pending' WHEN n IN (6, 7) THEN 'failed' ELSE 'posted' END AS state,
  CASE WHEN n IN (3, 4) THEN NULL WHEN n = 0 OR blocked THEN 'validation_failed' WHEN n = 1 THEN 'manual_review_required' END AS reason,
  CASE n WHEN 4 THEN 'OCR_TIMEOUT' WHEN 3 THEN 'FIELD_NORMALIZATION_ERROR' WHEN 0 THEN 'ACCOUNTING_VALIDATION_ERROR' WHEN 6 THEN CASE WHEN blocked THEN NULL ELSE 'UPLOAD_FAILED' END
    WHEN 7 THEN CASE WHEN blocked OR again = 'b' THEN NULL ELSE 'UPLOAD_FAILED' END END AS error_code,
  CASE WHEN n = 4 THEN 3 WHEN n IN (0, 3) THEN 4 WHEN blocked OR n = 1 THEN 5 WHEN n = 5 AND again = 'b' THEN 5 ELSE 6 END AS n_events
FROM j""")
def job_states(spark, sf_dir):
    """Jobs of all invoices from payload to the server's answer, which refuses some; some invoices are sent in twice."""
    n = F.col("invoice_id") % 10
    lines = b.invoice_lines(spark, sf_dir).groupBy("invoice_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "l_partkey", "taxable_value"))).alias("ls"))
    item = lambda x: F.struct(F.concat(F.lit("P"), x["l_partkey"]).alias("description"), F.lit(1).alias("quantity"), x["taxable_value"].alias("unit_price"), x["taxable_value"].alias("total_price"))
    items = F.coalesce(F.transform("ls", item), F.array().cast("array<struct<description:string,quantity:int,unit_price:decimal(18,2),total_price:decimal(18,2)>>"))
    total = F.col("subtotal") + F.col("tax") + F.when(n == 0, 100).otherwise(0)
    doc = F.to_json(F.struct(
        "invoice_number", F.col("invoice_date").cast("string").alias("invoice_date"), F.when(n != 2, F.col("seller")).alias("seller"), F.when(n == 1, "Nobody").otherwise(F.col("buyer")).alias("buyer"), F.lit("INR").alias("currency"),
        "subtotal", "tax", total.alias("total"), items.alias("line_items"),
    ))
    rows = b.invoices(spark, sf_dir).join(lines, "invoice_id", "left")
    again = F.when(n.isin(5, 7), F.array(F.lit(""), F.lit("b"))).otherwise(F.array(F.lit("")))
    # not in one select: beside a generator, fields of structs lose their names
    rows = rows.select("invoice_id", F.when(n == 3, "[1]").otherwise(doc).alias("doc")).select("invoice_id", F.explode(again).alias("again"), "doc")
    asked = rows.select(
        F.concat("invoice_id", "again").alias("job_id"), F.lit("t9").alias("tenant_id"), F.lit("clerk").alias("operator"), F.length("again").alias("arrival"),
        v.parse_json(F.when(n != 4, F.col("doc"))).alias("payload"), F.when(n == 4, "OCR_TIMEOUT").alias("payload_error"),
    )
    config = jobs.JobConfig(review_below=0.6)
    place, made_in = shared.folder(spark, "jobs"), shared.folder(spark, "jobs")
    done = jobs.process(asked, b.master(spark, sf_dir), b.rules(spark), spark.createDataFrame([], "idempotency_key string"), config, made_in)
    done = jobs.write(done, place, made_in)
    answers = jobs.ready(done).select("job_id", (~F.col("job_id").substr(-1, 1).isin("6", "7")).alias("ok"), F.lit("answer").alias("message"))
    return jobs.finish(done, answers, config).select("job_id", "state", "reason", "error_code", F.size("events").alias("n_events"))


@query("audit_latest_state", "SELECT user_id AS job_id, arg_max(event_type, event_id) AS state, count(*) AS n_events FROM events GROUP BY user_id")
def audit_latest_state(spark, sf_dir):
    return workflow.latest_state(
        b.table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("state"))
    )


@query("post_once_ties", """
WITH a AS (SELECT event_type AS idempotency_key, user_id % 50 AS arrival, event_id % 3 AS clerk FROM events),
k AS (SELECT CASE WHEN clerk = 2 AND arrival > 40 THEN NULL ELSE idempotency_key END AS idempotency_key, arrival, clerk FROM a),
n AS (SELECT *, row_number() OVER (PARTITION BY idempotency_key ORDER BY arrival, clerk) AS i FROM k)
SELECT idempotency_key, arrival, clerk, CASE WHEN idempotency_key IS NULL THEN 'unkeyed' WHEN i = 1 AND idempotency_key <> 'click' THEN 'new' ELSE 'duplicate' END AS post_status, count(*) AS n FROM n GROUP BY ALL""")
def post_once_ties(spark, sf_dir):
    """Many rows a key, equal arrivals, rows equal throughout, rows without a key, and a key posted before."""
    rows = b.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("idempotency_key"), (F.col("user_id") % 50).alias("arrival"), (F.col("event_id") % 3).alias("clerk"),
    )
    rows = rows.withColumn("idempotency_key", F.when(~((F.col("clerk") == 2) & (F.col("arrival") > 40)), F.col("idempotency_key")))
    posted = spark.createDataFrame([("click",), ("click",), (None,)], "idempotency_key string")
    return workflow.post_once(rows, posted).groupBy("idempotency_key", "arrival", "clerk", "post_status").agg(F.count("*").alias("n"))


@query("stream_replay_equals_batch", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def stream_replay_equals_batch(spark, sf_dir):
    """Events through a posting stream of several batches, stopped and started again; the ledger it leaves is the answer."""
    from ..streaming import posting

    place = shared.folder(spark, "replay")
    rows = b.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    keyed = rows.withColumn("idempotency_key", F.sha2(F.to_json(F.struct("user_id", "event_type")), 256)).withColumn("arrival", F.col("event_id"))
    bounds = rows.agg(F.min("event_id").alias("a"), F.max("event_id").alias("z")).first()
    step = ((bounds.z or 0) - (bounds.a or 0)) // REPLAY_PARTS + 1
    for start in range(0, REPLAY_PARTS, REPLAY_PARTS // 2):
        # later events reach the folder only once the stream has ended, and is started anew
        for n in range(start, start + REPLAY_PARTS // 2):
            low = (bounds.a or 0) + n * step
            part = keyed.where(F.col("event_id").between(low, low + step - 1))
            part.repartition(REPLAY_FILES).write.mode("append").parquet(f"{place}/arrivals")
        # older files come first, so a batch holds no event that is later than one of a batch after it
        stream = spark.readStream.schema(keyed.schema).option("maxFilesPerTrigger", REPLAY_FILES).parquet(f"{place}/arrivals")
        posting.start(stream, f"{place}/ledger", f"{place}/checkpoint", available_now=True).awaitTermination()
    return posting.posted(spark, f"{place}/ledger", keyed.schema).select("user_id", "event_type", "event_id")


#: Batches of the replayed stream, and files of each, which are written and read by as many tasks.
REPLAY_PARTS, REPLAY_FILES = 4, 16


@query("duplicate_responses", """
WITH e AS (SELECT *, CASE WHEN event_id % 4 = 3 THEN 3 WHEN event_id % 4 = 2 THEN 2 ELSE 1 END AS batch FROM events),
f AS (SELECT *, first_value(event_id) OVER (PARTITION BY user_id, event_type ORDER BY batch, event_id) AS first FROM e)
SELECT 'j' || event_id AS job_id, CASE WHEN user_id % 7 = 0 THEN 'open' WHEN event_id = first THEN 'posted' ELSE 'duplicate' END AS status,
  CASE WHEN user_id % 7 <> 0 THEN 'j' || first END AS first_job_id, CASE WHEN user_id % 7 <> 0 THEN 'took j' || first END AS answer FROM f""")
def duplicate_responses(spark, sf_dir):
    """Three batches into one ledger, of which the second dies before its upload and the third uploads for it; every duplicate has the first answer."""
    from ..streaming import posting

    events = b.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    rows = events.select(
        F.concat(F.lit("j"), "event_id").alias("job_id"), F.concat_ws("-", "user_id", "event_type").alias("idempotency_key"), F.col("event_id").alias("arrival"), "user_id",
    )
    place = shared.folder(spark, "responses")

    def upload(claimed):
        return claimed.select("idempotency_key", "job_id", (F.col("user_id") % 7 != 0).alias("ok"), F.concat(F.lit("took "), "job_id").alias("message"))

    def dies(claimed):
        raise ConnectionError("the batch ends here")

    for number, rest, send in (("1", (0, 1), upload), ("2", (2,), dies), ("3", (3,), upload)):
        try:
            posting.post_batch(rows.where((F.col("arrival") % 4).isin(*rest)), place, send, number)
        except ConnectionError:
            assert posting.unanswered(spark, place) == [number]
    known = posting.first_answers(spark, place)
    found = rows.join(known, "idempotency_key", "left")
    status = F.when(F.col("first_job_id").isNull(), "open").when(F.col("first_job_id") == F.col("job_id"), "posted").otherwise("duplicate")
    return found.select("job_id", status.alias("status"), "first_job_id", F.col("first_message").alias("answer"))


@query("keyed_responses", """
WITH e AS (SELECT *, CASE WHEN event_id % 4 = 3 THEN 3 WHEN event_id % 4 = 2 THEN 2 ELSE 1 END AS batch FROM events),
f AS (SELECT *, first_value(event_id) OVER (PARTITION BY user_id, event_type ORDER BY batch, event_id) AS first,
  first_value(event_id) OVER (PARTITION BY user_id, event_type, batch ORDER BY event_id) AS sent FROM e)
SELECT 'j' || event_id AS job_id, CASE WHEN user_id % 7 <> 0 THEN CASE WHEN event_id = first THEN 'posted' ELSE 'duplicate' END WHEN event_id = sent THEN 'failed' ELSE 'retry_pending' END AS status,
  'j' || CASE WHEN user_id % 7 <> 0 THEN first ELSE sent END AS first_job_id, CASE WHEN user_id % 7 <> 0 THEN 'took j' || first ELSE 'refused j' || sent END AS message FROM f""")
def keyed_responses(spark, sf_dir):
    """Three batches of a stream that is stopped and started between them, posted by keyed state; some keys the server always refuses."""
    from ..streaming import keyed

    events = b.table(spark, sf_dir, "events")
    rows = events.select(
        F.concat_ws("-", "user_id", "event_type").alias("idempotency_key"), F.concat(F.lit("j"), "event_id").alias("job_id"), F.col("event_id").alias("arrival"),
        F.concat(F.lit("j"), "event_id").alias("xml"),
    )
    place = shared.folder(spark, "keyed")

    def ask(xml: str, key: str) -> tuple[bool, str]:
        took = int(key.split("-")[0]) % 7 != 0
        return took, f"{'took' if took else 'refused'} {xml}"

    for rest in ((0, 1), (2,), (3,)):
        rows.where((F.col("arrival") % 4).isin(*rest)).write.mode("append").parquet(f"{place}/arrivals")
        stream = spark.readStream.schema(keyed.JOB).parquet(f"{place}/arrivals")
        keyed.start(stream, f"{place}/responses", f"{place}/checkpoint", ask, available_now=True).awaitTermination()
    return spark.read.schema(keyed.RESPONSE).parquet(f"{place}/responses").select("job_id", "status", "first_job_id", "message")


class _Counting:
    """A provider that tells a text's length, and nothing usable of short ones."""

    name, model = "counting", "1"

    def extract(self, text: str) -> str:
        return f'{{"n": {len(text)}}}' if len(text) >= 40 else "no JSON"

    def repair(self, text: str, broken: str, error: str) -> str:
        return f'{{"short": {len(text)}}}'


@query("extraction_log", """
SELECT conv_id || '-' || turn AS job_id, CASE WHEN length(text) >= 40 THEN '{"n": ' ELSE '{"short": ' END || length(text) || '}' AS payload,
  CASE WHEN length(text) >= 40 THEN 'strict_json' ELSE 'repaired_json' END AS strategy, CASE WHEN length(text) >= 40 THEN 1 ELSE 2 END AS attempts
FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations)""")
def extraction_log(spark, sf_dir):
    """Turns as texts to extract from, in two calls on one log, of which the second asks only for what is new."""
    rows = b.table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("job_id"), "turn", "text")
    place = shared.folder(spark, "answers")
    for asked in (rows.where("turn % 2 = 0"), rows):
        found = providers.extract_logged(asked, _Counting(), place, chunk=4096, tasks=64)
    return found.select("job_id", "payload", "strategy", "attempts")


@query("first_arrivals_window", "SELECT event_type, min(event_id) AS event_id FROM events GROUP BY event_type")
def first_arrivals_window(spark, sf_dir):
    return workflow.first_arrivals(
        b.table(spark, sf_dir, "events").select("event_type", "event_id", "user_id"), "event_type", "event_id",
    ).select("event_type", "event_id")
