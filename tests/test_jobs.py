import json

from pyspark.sql import functions as F

from ledgerloom.functions import variants as v
from ledgerloom.operators import batch, jobs, workflow
from ledgerloom.sources import providers, readers
from ledgerloom.sources import rules as rule_files
from ledgerloom.streaming import posting

MASTER = [("party", 0, "Buyer", "B1", []), ("ledger", 0, "Seller", "S1", []), ("stock_item", 0, "Item", "I1", [])]
GOOD = {
    "invoice_number": "7", "invoice_date": "2025-01-31", "seller": "Seller", "buyer": "Buyer", "currency": "INR", "subtotal": 100, "tax": 18,
    "total": 118, "line_items": [{"description": "Item", "quantity": 1, "unit_price": 100, "total_price": 100}],
}


def run(spark, payloads, posted=(), **config):
    rows = spark.createDataFrame(
        [(f"j{i}", "t", "ann", i, json.dumps(p) if p is not None else None) for i, p in enumerate(payloads)],
        "job_id string, tenant_id string, operator string, arrival long, p string",
    )
    rows = rows.select("job_id", "tenant_id", "operator", "arrival", v.parse_json(F.col("p")).alias("payload"))
    master = spark.createDataFrame(MASTER, "entity_type string, pos int, name string, code string, aliases array<string>")
    rules = spark.createDataFrame([], "scope string, tenant_id string, entity_type string, key string, target string")
    done = spark.createDataFrame([(k,) for k in posted], "idempotency_key string")
    return {r.job_id: r for r in jobs.process(rows, master, rules, done, jobs.JobConfig(**({"review_below": 0.7} | config))).collect()}


def test_states(spark):
    got = run(
        spark,
        [
            GOOD, GOOD, GOOD | {"seller": "Nobody"}, GOOD | {"buyer": "Nobody"}, GOOD | {"total": 300}, [1], None,
            GOOD | {"invoice_number": "8", "invoice_date": "soon"},
        ],
    )
    assert [(got[f"j{i}"].state, got[f"j{i}"].reason, got[f"j{i}"].error_code) for i in range(8)] == [
        ("validated", None, None), ("posted", None, None), ("review_required", "validation_failed", None), ("review_required", "manual_review_required", None), (
            "review_required", "validation_failed", "ACCOUNTING_VALIDATION_ERROR",
        ),
        ("failed", None, "FIELD_NORMALIZATION_ERROR"), ("failed", None, "FIELD_NORMALIZATION_ERROR"), ("failed", None, "VOUCHER_DATE"),
    ]
    assert got["j4"].error.message.startswith("HEADER_OFF") and got["j4"].error.context == {"tenant_id": "t", "invoice_number": "7"} and got["j0"].error is None
    assert got["j7"].error.message == "The voucher could not be made: VOUCHER_DATE."
    parts = got["j6"].confidence_parts
    assert (parts.overall, parts.completeness, parts.schema_valid, parts.accounting, parts.present) == (0.0, 0.0, 0.0, 0.0, 0) and not any(parts.inputs)
    assert (got["j0"].post_status, got["j1"].post_status) == ("new", "duplicate") and got["j0"].xml and not got["j1"].xml
    assert "<AMOUNT>118.00</AMOUNT>" in got["j0"].xml and [e.state for e in got["j0"].events] == ["ingested", "ingested", "extracted", "validated", "validated"]
    told = [("j0", "ann", [(e.state, e.action) for e in got["j0"].events])]
    events = workflow.audit_events(spark.createDataFrame(told, "job_id string, operator string, events array<struct<state:string,action:string>>"))
    assert [(r.seq, r.actor) for r in events.orderBy("seq").collect()][:2] == [(0, "ann"), (1, "system")]


def test_history_dry_run_and_thresholds(spark):
    key = run(spark, [GOOD])["j0"].idempotency_key
    assert run(spark, [GOOD], posted=[key])["j0"].post_status == "duplicate"
    assert run(spark, [GOOD], dry_run=True)["j0"].state == "dry_run"
    assert run(spark, [GOOD], review_below=0.8)["j0"].reason == "low_confidence"
    assert run(spark, [GOOD], strict_reference=True)["j0"].error_code == "SCHEMA_VALIDATION_ERROR"


def test_from_files_to_answers(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.png").write_bytes(b"one")
    (inbox / "b.png").write_bytes(b"two")
    (inbox / "c.txt").write_bytes(b"three")
    (inbox / "d.png").write_bytes(b"four")
    answers = {"one": json.dumps(GOOD), "two": json.dumps(GOOD | {"buyer": "Nobody"}), "four": json.dumps(GOOD | {"invoice_number": "9"})}
    asked = spark.createDataFrame(
        [(x, "t", "ann", i, f"{inbox}/{x}") for i, x in enumerate(("a.png", "b.png", "c.txt", "d.png", "e.png"))],
        "job_id string, tenant_id string, operator string, arrival long, path string",
    )
    master = spark.createDataFrame(MASTER, "entity_type string, pos int, name string, code string, aliases array<string>")
    rules = spark.createDataFrame([], "scope string, tenant_id string, entity_type string, key string, target string")
    sent = tmp_path / "sent"

    def transport(xml, key):
        with open(sent, "a") as f:
            f.write(key + "\n")
        return (400, "") if ">9<" in xml else (200, "<R><CREATED>1</CREATED><ERRORS>0</ERRORS></R>")

    outside = batch.Outside({"image": readers.ocr_image(lambda image, lang=None: image.decode())}, providers.FixtureProvider(answers), transport, delay=0.0)
    for _ in range(2):  # a batch that is started again asks nobody anything
        done = {r.job_id: r for r in batch.run(asked, str(inbox), master, rules, str(tmp_path / "out"), "1", outside, jobs.JobConfig(review_below=0.7)).collect()}
        assert [(k, done[k].state, done[k].error_code) for k in sorted(done)] == [
            ("a.png", "posted", None), ("b.png", "review_required", None), ("c.txt", "failed", "INGESTION_ERROR"), ("d.png", "failed", "UPLOAD_FAILED"), ("e.png", "failed", "INGESTION_ERROR"),
        ]
        assert len(sent.read_text().split()) == 2
        assert done["d.png"].error.code == "UPLOAD_FAILED" and list(done["d.png"].error.context) == ["idempotency_key"] and done["c.txt"].error.code == "INGESTION_ERROR"
    queue = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/out/review_queue").collect()]
    assert [(q["job_id"], q["reason"], q["issues"][0]["suggestions"][0]["name"]) for q in queue] == [("b.png", "manual_review_required", "Buyer")]
    assert done["a.png"].events[-1].action == "system:posted" and done["a.png"].invoice.line_items[0].description == "Item"
    # a later batch: what was posted is a duplicate, what was refused is tried again
    later = {r.job_id: r.state for r in batch.run(asked, str(inbox), master, rules, str(tmp_path / "out"), "2", outside, jobs.JobConfig(review_below=0.7)).collect()}
    assert (later["a.png"], later["d.png"]) == ("posted", "failed") and len(sent.read_text().split()) == 3


def test_refused_uploads_hold_back_their_duplicates(spark):
    rows = spark.createDataFrame(
        [("j0", "t", "ann", 0, json.dumps(GOOD)), ("j1", "t", "ann", 1, json.dumps(GOOD))],
        "job_id string, tenant_id string, operator string, arrival long, p string",
    )
    rows = rows.select("job_id", "tenant_id", "operator", "arrival", v.parse_json(F.col("p")).alias("payload"))
    master = spark.createDataFrame(MASTER, "entity_type string, pos int, name string, code string, aliases array<string>")
    done = jobs.process(
        rows, master, spark.createDataFrame([], "scope string, tenant_id string, entity_type string, key string, target string"),
        spark.createDataFrame([], "idempotency_key string"), jobs.JobConfig(review_below=0.7),
    )
    for ok, strict, want in ((False, False, ["failed", "retry_pending"]), (True, False, ["posted", "posted"]), (False, True, ["posted", "posted"])):
        answers = spark.createDataFrame([("j0", ok, "m")], "job_id string, ok boolean, message string")
        assert [r.state for r in jobs.finish(done, answers, jobs.JobConfig(strict_reference=strict)).orderBy("job_id").collect()] == want


def test_evaluation_of_folders(spark, tmp_path, capsys):
    from ledgerloom.__main__ import main

    for name, rows in (("truth", {"a": GOOD, "b": GOOD | {"invoice_number": "8"}}), ("found", {"a": GOOD, "b": GOOD | {"invoice_number": "x"}, "other": GOOD})):
        (tmp_path / name).mkdir()
        for k, v_ in rows.items():
            (tmp_path / name / f"{k}.json").write_text(json.dumps(v_))
    folders = [str(tmp_path / x) for x in ("truth", "found", "report")]
    assert main(["evaluate", *folders]) == 1 and main(["evaluate", *folders, "--critical", "total"]) == 0
    told = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert told["passed"] and told["summary"]["documents"] == 2 and told["summary"]["exact_rate"] == 0.5 and told["summary"]["line_tp"] == 2
    assert [r.field for r in spark.read.option("header", True).csv(f"{tmp_path}/report/fields").collect()][-1] == "line_items"
    assert {r.doc_id: r.prediction_found for r in spark.read.json(f"{tmp_path}/report/documents").collect()} == {"a": True, "b": True}


NO_RULES = "scope string, tenant_id string, entity_type string, key string, target string"
LEDGER = "job_id string, idempotency_key string, arrival int"


def answering(ok=True, sent=None):
    def upload(claimed):
        rows = claimed.select("job_id", "idempotency_key", F.lit(ok).alias("ok"), F.concat(F.lit("took "), "job_id").alias("message"))
        if sent is not None:
            sent.extend(r.job_id for r in rows.collect())
        return rows

    return upload


def test_claims_of_a_dead_batch_are_uploaded_by_the_next(spark, tmp_path):
    place = str(tmp_path)

    def dies(claimed):
        raise ConnectionError

    one, two, sent = [spark.createDataFrame([r], LEDGER) for r in (("j1", "key-a", 0), ("j2", "key-a", 0))] + [[]]
    try:
        posting.post_batch(one, place, dies, "1")
    except ConnectionError:
        pass
    assert posting.unanswered(spark, place) == ["1"]
    schema = spark.createDataFrame([], "idempotency_key string").schema
    assert posting.done(spark, place, schema, uploading=True).count() == 0  # the server never saw it
    assert posting.post_batch(two, place, answering(sent=sent), "2").count() == 0 and sent == ["j1"]
    assert [tuple(r) for r in posting.first_answers(spark, place).collect()] == [("key-a", "j1", "took j1")]
    assert posting.post_batch(one, place, answering(sent=sent), "1").count() == 1 and sent == ["j1"] and posting.unanswered(spark, place) == []


def test_a_job_that_loses_its_key_ends_with_the_first_answer(spark, tmp_path):
    place = str(tmp_path)
    fields = "job_id string, state string, post_status string, xml string, idempotency_key string, error_code string, events array<struct<state:string,action:string>>"
    # both batches looked at the ledger before either had claimed
    done = {n: spark.createDataFrame([(f"{n}{k}", "validated", "new", "<x/>", k, None, []) for k in ("a", "b")], fields) for n in ("first", "second")}
    posted = {}
    for n, ok in (("first", "a"), ("second", None)):
        waiting = jobs.ready(done[n]).withColumn("arrival", F.lit(0))
        answers = posting.post_batch(waiting, place, lambda rows, ok=ok: rows.select("job_id", "idempotency_key", (F.col("idempotency_key") == (ok or "")).alias("ok"), F.concat(F.lit("to "), "job_id").alias("message")), n)
        posted[n] = {r.job_id: r for r in jobs.finish(done[n], answers, first=posting.first_answers(spark, place)).collect()}
    got = {k: (r.state, r.post_status, r.answer, r.first_job_id, [e.action for e in r.events]) for x in posted.values() for k, r in x.items()}
    assert got["firsta"] == ("posted", "new", "to firsta", None, ["system:posted"]) and got["firstb"][0] == "failed"
    assert got["seconda"] == ("posted", "duplicate", "to firsta", "firsta", ["system:duplicate_post_prevented"])
    assert got["secondb"][0] == "failed"  # the server refused the first one's, so this one asked again


def test_approved_names_are_rules_of_the_next_batch(spark, tmp_path):
    inbox, root = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    master = spark.createDataFrame([*MASTER, ("ledger", 1, "New Seller", None, [])], "entity_type string, pos int, name string, code string, aliases array<string>")
    config = jobs.JobConfig(review_below=0.1, policies={"ledger": "auto_create"}, learning={"t": True, "u": False}, suggestions=0, dry_run=True)
    rules = spark.createDataFrame([("global", None, "party", "x", "Buyer")], NO_RULES)
    outcome = {}
    for number, seller in (("1", "Unheard Of"), ("2", " unheard  of")):
        names = [(f"{number}{t}{i}", t, "ann", i, f"{inbox}/{number}.png", approved) for i, (t, approved) in enumerate((("t", True), ("u", True), ("t", False), ("t", True)))]
        (inbox / f"{number}.png").write_bytes(number.encode())
        asked = spark.createDataFrame(names, "job_id string, tenant_id string, operator string, arrival long, path string, approved boolean")
        outside = batch.Outside({"image": readers.ocr_image(lambda image, lang=None: image.decode())}, providers.FixtureProvider({number: json.dumps(GOOD | {"seller": seller})}), delay=0.0)
        # by the next batch the server has made the ledger
        known = master if number == "1" else master.union(spark.createDataFrame([("ledger", 2, "Unheard Of", None, [])], master.schema))
        done = batch.run(asked, str(inbox), known, rules, root, number, outside, config)
        outcome |= {r.job_id: next(x.source for x in r.resolutions if x.field == "seller") for r in done.collect()}
    learned = [tuple(r) for r in spark.read.parquet(f"{root}/learned").select("tenant_id", "key", "target", "batch").collect()]
    assert learned == [("t", "unheard of", "Unheard Of", 1)]
    assert [outcome[k] for k in ("1t0", "1u1", "2t0", "2u1")] == ["created", "created", "rule", "exact"]


def test_of_two_learners_the_first_holds(spark, tmp_path):
    for number, at, target in (("9", "2025-01-01T00:00:00.000Z", "Early"), ("3", "2025-01-02T00:00:00.000Z", "Late")):
        learned = spark.createDataFrame([("t", "ledger", "k", target, "learned", "ann"), ("t", "ledger", "other", target, "duplicate", "ann")], "tenant_id string, entity_type string, key string, target string, status string, approved_by string")
        rule_files.from_approvals(learned, now=at).write.parquet(f"{tmp_path}/batch={number}")
    got = [(r.scope, r.target, json.loads(r.provenance)["approved_by"]) for r in rule_files.learned_before(spark, str(tmp_path), "1").collect()]
    assert got == [("tenant", "Early", "ann")]
    assert [r.target for r in rule_files.learned_before(spark, str(tmp_path), "9").collect()] == ["Late"]
    assert rule_files.learned_before(spark, f"{tmp_path}/none", "1").collect() == []
