"""Vouchers, reconciliation, workflow, sources and streaming on small cases derived by hand."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import evaluate, reconcile, voucher, workflow
from ledgerloom.sources import documents, labels, master, readers, rules
from ledgerloom.streaming import posting

LINES = "invoice_id int, taxable_value string, cgst_amount string, sgst_amount string, igst_amount string, tax_amount string, total_price string"


def vouch(spark, total, lines, tax=None, config=None):
    invoices = spark.createDataFrame([(1, "Buyer", total, tax)], "invoice_id int, buyer string, total string, tax string")
    rows = spark.createDataFrame([(1, *line) for line in lines], LINES)
    return voucher.ledger_entries(voucher.collect_amounts(invoices, rows), config).first()


@pytest.mark.parametrize(("total", "lines", "tax", "entries", "error"), [
    (
        "1740", [("1000", "90", "90", None, None, None), ("500", "30", "30", None, None, None)], None,
        [("Buyer", 1740, "debit"), ("Sales", 1500, "credit"), ("CGST", 120, "credit"), ("SGST", 120, "credit")], None,
    ),
    ("1000", [("1000", None, None, "180", None, None)], None, None, "ROUND_OFF_LIMIT"), (
        "1181", [("1000", None, None, "180", None, None)], None,
        [("Buyer", 1181, "debit"), ("Sales", 1000, "credit"), ("IGST", 180, "credit"), ("Round Off", 1, "credit")], None,
    ),
    ("10", [("3.333", "3.333", "3.333", None, None, None)], None, None, "UNBALANCED"), (
        "118", [(None, None, None, None, "18", "118")], "18", [("Buyer", 118, "debit"), ("Sales", 100, "credit"), ("IGST", 18, "credit")], None,
    ),
    ("0", [], None, [("Buyer", 0, "debit"), ("Sales", 0, "credit")], None),
])
def test_voucher(spark, total, lines, tax, entries, error):
    r = vouch(spark, total, lines, tax)
    assert r.error == error
    if entries:
        assert [(e.ledger_name, e.amount, e.entry_type) for e in r.entries] == [(n, Decimal(a), k) for n, a, k in entries]


def test_voucher_config_and_xml(spark):
    config = voucher.VoucherConfig(
        ledgers=voucher.VoucherConfig().ledgers | {"round_off": "Round Off Adj", "igst": "Output IGST 18%"}, voucher_type="Receipt", company="A&B",
    )
    invoices = spark.createDataFrame(
        [(1, "B<", "1180.25", None, "7", "20250131", None)],
        "invoice_id int, buyer string, total string, tax string, invoice_number string, voucher_day string, invoice_type string",
    )
    rows = voucher.ledger_entries(voucher.collect_amounts(invoices, spark.createDataFrame([(1, "1000", None, None, "180", None, None)], LINES)), config)
    xml = rows.select(voucher.voucher_xml(rows, config).alias("x")).first().x
    assert 'VCHTYPE="Receipt"' in xml and "<SVCURRENTCOMPANY>A&amp;B<" in xml and "<PARTYLEDGERNAME>B&lt;<" in xml and "Round Off Adj</LEDGERNAME><ISDEEMEDPOSITIVE>No</ISDEEMEDPOSITIVE><AMOUNT>0.25<" in xml


def test_acknowledgement(spark):
    bodies = [
        "<R><CREATED>1</CREATED><ERRORS>0</ERRORS></R>", "<R><IGNORED>1</IGNORED><ERRORS> 1 </ERRORS><LINEERROR> no ledger </LINEERROR></R>",
        "<R><CREATED>", "<R><ERRORS>0</ERRORS><LINEERROR>x</LINEERROR></R>", None,
    ]
    got = voucher.parse_acknowledgement(spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")).orderBy("i").collect()
    assert [r.ok for r in got] == [True, False, False, False, False]
    assert got[0].created == 1 and got[1].line_errors == ["no ledger"] and got[1].message == "REFUSED: no ledger" and got[2].message.startswith("UNREADABLE")


MASTER = [
    ("party", 0, "ACME CORPORATION", "P100", ["ACME CORP LTD"]), ("party", 1, "Acme Corporation", "P101", []),
    ("ledger", 0, "SALES LEDGER", "L200", ["Sales"]), ("stock_item", 0, "WIDGET-A", None, ["Widget A"]),
]
NAMES = "entity_type string, pos int, name string, code string, aliases array<string>"
RULES = "scope string, tenant_id string, entity_type string, key string, target string"


def test_resolution_order(spark):
    entities = spark.createDataFrame(
        [
            (0, "t", "party", " acme  corp "), (1, "t", "ledger", "Sales"), (2, "t", "stock_item", "widget a"), (3, "t", "party", "nobody"),
            (4, "t", "ledger", "nothing"), (5, "t", "party", None), (6, "t", "ledger", "by code"), (7, "t", "ledger", "bad rule"),
            (8, "t", "ledger", "l200"), (9, "t", "party", "acme corporation"),
        ],
        "ord int, tenant_id string, entity_type string, value string",
    )
    rules = spark.createDataFrame(
        [
            ("tenant", "t", "party", "acme corp", "ACME CORPORATION"), ("global", None, "party", "acme corp", "Other"),
            ("db", "t", "ledger", "by code", "L200"), ("tenant", "t", "ledger", "bad rule", "gone"),
        ],
        RULES,
    )
    got = reconcile.resolve(entities, spark.createDataFrame(MASTER, NAMES), rules).orderBy("ord").collect()
    assert [r.source for r in got] == ["rule", "alias", "alias", "unresolved", "unresolved", "unresolved", "rule", "unresolved", "exact", "exact"]
    assert [r.issue.action if r.issue else None for r in got] == [None, None, None, "manual_review", "reject", "manual_review", None, "reject", None, None]
    assert got[5].issue.code == "MISSING_EXTRACTED_VALUE" and got[9].resolved_code == "P100"


def test_suggestions_fold_ocr(spark):
    names = spark.createDataFrame([("party", i, n, None, []) for i, n in enumerate(["ORBITAL VENDORS", "GLOBAL SOLUTIONS LLP", "GLOBE SOLVENTS"])], NAMES)
    got = reconcile.suggest(
        spark.createDataFrame([("party", "GL0BAL S0LUT10NS LLP"), ("party", "0RBITAL VEND0R5")], "entity_type string, value string"), names,
    ).where("rank = 1").orderBy("value").collect()
    assert [r.name for r in got] == ["ORBITAL VENDORS", "GLOBAL SOLUTIONS LLP"] and all(r.ocr_boost == 0.05 for r in got)


def test_learning(spark):
    made = spark.createDataFrame(
        [
            (1, 0, "t", "ledger", "new", "New", "created"), (1, 1, "t", "ledger", "new", "New", "created"),
            (2, 0, "t", "ledger", "old", "Old", "created"), (3, 0, "t", "ledger", "x", "X", "exact"),
        ],
        "invoice_id int, ord int, tenant_id string, entity_type string, key string, resolved_name string, source string",
    )
    rules = spark.createDataFrame([("tenant", "t", "ledger", "old", "Old")], RULES)
    assert sorted(
        (r.invoice_id, r.ord, r.status) for r in reconcile.learn_rules(made, rules, "me").collect()
    ) == [(1, 0, "learned"), (1, 1, "duplicate"), (2, 0, "duplicate")]
    assert reconcile.learn_rules(made, rules, "me", enabled=False).collect() == []


def test_routing(spark):
    issue = "array<struct<field:string,code:string,action:string>>"
    rows = spark.createDataFrame(
        [
            (0, [("b", "M", "reject"), ("s", "M", "manual_review")], 0.9, False),
            (1, [("b", "M", "manual_review"), ("l", "M", "auto_create")], 0.1, False), (2, [], 0.79, False), (3, [], 0.8, False), (4, [], 0.9, True),
            (5, [("l", "M", "auto_create")], 0.9, False),
        ],
        f"i int, issues {issue}, c double, critical boolean",
    )
    got = rows.select("i", workflow.route(F.col("issues"), F.col("c"), F.col("critical")).alias("r")).orderBy("i").collect()
    assert [(r.r.reason, len(r.r.queued)) for r in got] == [
        ("validation_failed", 2), ("manual_review_required", 1), ("low_confidence", 0), (None, 0), ("validation_failed", 0), (None, 0),
    ]


def test_posting_states(spark):
    rows = spark.createDataFrame([("duplicate", True, False), ("new", True, False), ("new", False, True), ("new", False, False)], "s string, dry boolean, up boolean")
    for strict, want in ((False, ["posted", "dry_run", "posted", "failed"]), (True, ["posted"] * 4)):
        assert [r.x for r in rows.select(workflow.outcome(F.col("s"), F.col("dry"), F.col("up"), strict).alias("x")).collect()] == want


def test_evaluation_cases(spark):
    fields = ("invoice_number", "total")
    truth = spark.createDataFrame([(1, "A", "93.5"), (2, "B", "10"), (3, None, "1"), (4, None, None)], "doc_id int, invoice_number string, total string")
    found = spark.createDataFrame([(1, " a", "$93.505"), (3, "X", "2"), (4, None, None)], "doc_id int, invoice_number string, total string")
    got = {(r.doc_id, r.field): (r.matched, r.tp, r.fp, r.fn) for r in evaluate.field_outcomes(truth, found, fields).collect()}
    assert got[1, "total"] == (True, 1, 0, 0) and got[2, "total"] == (False, 0, 0, 1) and got[3, "invoice_number"] == (False, 0, 1, 0) and got[3, "total"] == (False, 0, 1, 1) and got[4, "total"] == (True, 0, 0, 0)


def test_file_routing_and_limits(spark):
    pages = lambda content, language, on: iter(content.decode().split("|"))
    files = spark.createDataFrame(
        [
            ("/a/x.PDF", "t", bytearray(b"one|two")), ("/a/y.gif", "t", bytearray(b"z")), ("/a/z.txt", "t", bytearray(b"q")),
            ("/a/many.pdf", "u", bytearray(b"1|2|3")),
        ],
        "path string, tenant_id string, content binary",
    )
    got = {
        r.path[-5:]: r for r in documents.extract(
            files, {"pdf": pages, "image": pages}, {"t": "deu", "u": ""}, flags={"binarization": True, "deskew": True},
            limits=documents.Limits(max_pages=2),
        ).collect()
    }
    assert got["x.PDF"].text == "one\ntwo" and got["x.PDF"].language == "deu" and got["x.PDF"].preprocessing_steps == ["deskew", "binarization"]
    assert got["y.gif"].error == got["z.txt"].error == "INGESTION_ERROR" and got["y.pdf"].error == "OCR_PAGE_LIMIT_EXCEEDED" and got["y.pdf"].language == "eng"
    assert "split the document" in got["y.pdf"].message and got["y.pdf"].context == {"max_pages": "2", "detected_pages": "over 2"} and "DOCX" in got["z.txt"].message
    assert got["x.PDF"].source == "ocr_pdf" and got["x.PDF"].n_pages is None


def test_readers_and_limits(tmp_path):
    limits, now = documents.Limits(20, 1.0), iter(x / 10 for x in range(1000))
    layer = documents.Pages(iter(["p"] * 25 + [" "]), "pdf_text_layer", limited=False, n_pages=26)
    assert documents.read_pages(layer, limits, lambda: 0).count("p") == 25
    rendered = []
    counted = readers.ocr_pdf(lambda image, lang=None: f"{image} {lang}", lambda c: len(c), lambda c, n: rendered.append(n) or n)
    with pytest.raises(documents.ReadError, match="21 pages"):
        documents.read_pages(counted(b"x" * 21, "eng", []), limits, lambda: 0)
    assert rendered == [] and documents.read_pages(counted(b"xx", "", ["deskew"]), limits, lambda: 0) == "1 None\n2 None" and rendered == [1, 2]
    clock = iter((0, 0.2, 0.9, 1.0, 1.1))
    with pytest.raises(documents.ReadError) as late:  # the third page is never asked for
        documents.read_pages(counted(b"xxxxx", "deu", []), limits, lambda: next(clock))
    assert late.value.code == "OCR_TIMEOUT" and late.value.context == {"timeout_seconds": "1.0", "elapsed_seconds": "1.1", "processed_pages": "3"}
    assert documents.read_one(None, "image", ".png", None, "", [], limits, lambda: next(now))["message"] == "There is no such file."
    assert documents.read_one(readers.doc("no-such-program"), "word", ".doc", b"x", "", [], limits, lambda: next(now))["context"] == {"program": "no-such-program"}
    program = tmp_path / "reader"
    program.write_text("#!/bin/sh\nprintf ' Old \\377 file '")
    program.chmod(0o755)
    assert documents.read_one(readers.word(readers.doc(str(program))), "word", ".doc", b"x", "", [], limits, lambda: next(now))["text"] == "Old  file"
    assert documents.read_one(readers.doc("true"), "word", ".doc", b"x", "", [], limits, lambda: next(now))["error"] == "INGESTION_ERROR"
    assert readers.prepared("image", ["contrast_enhancement", "deskew"]) == ("image", ["deskew", "contrast_enhancement"])
    assert documents.limit_message("OTHER", {}) == "OCR went beyond a limit."


def test_posting_survives_a_restart_and_refusals(spark, tmp_path):
    root, asked = str(tmp_path / "ledger"), []
    rows = spark.createDataFrame([("ab", 1), ("ab", 1), ("cd", 2), (None, 3)], "idempotency_key string, arrival long")

    def upload(claimed):
        asked.append(sorted(r.idempotency_key for r in claimed.collect()))
        if len(asked) == 1:
            raise ConnectionError("cut off")
        return claimed.withColumn("ok", F.col("idempotency_key") != "cd")

    with pytest.raises(ConnectionError):
        posting.post_batch(rows, root, upload, "7")
    assert not (tmp_path / "ledger" / "_lock").exists()
    # the same batch asks for the same rows again, and no more once it has its answers
    for _ in range(2):
        assert {r.idempotency_key: r.ok for r in posting.post_batch(rows, root, upload, "7").collect()} == {"ab": True, "cd": False}
    assert asked == [["ab", "cd"]] * 2
    # what was refused may come again, what was posted may not
    assert [r.idempotency_key for r in posting.post_batch(rows, root, lambda c: c.withColumn("ok", F.lit(True)), "8").collect()] == ["cd"]
    with posting.locked(spark, root), pytest.raises(TimeoutError), posting.locked(spark, root, wait=0.1, step=0.05):
        pass


def test_first_arrivals_and_ties(spark):
    rows = spark.createDataFrame([("a", 2, 1), ("a", 1, 9), ("a", 1, 8), ("a", 1, 8), ("b", None, 1), (None, 1, 1)], "idempotency_key string, arrival int, n int")
    got = sorted(((r.idempotency_key, r.arrival, r.n, r.post_status) for r in workflow.post_once(rows, rows.limit(0)).collect()), key=repr)
    assert got == sorted(
        [
            ("a", 1, 8, "new"), ("a", 1, 8, "duplicate"), ("a", 1, 9, "duplicate"), ("a", 2, 1, "duplicate"), ("b", None, 1, "new"),
            (None, 1, 1, "unkeyed"),
        ],
        key=repr,
    )
    many = spark.range(20_000).select(F.lit("k").alias("idempotency_key"), F.lit(0).alias("arrival"))
    assert {r.post_status: r["count"] for r in workflow.post_once(many, many.limit(0)).groupBy("post_status").count().collect()} == {"new": 1, "duplicate": 19_999}
    assert [tuple(r) for r in workflow.first_arrivals(rows.where("idempotency_key = 'a'"), "idempotency_key", "arrival").collect()] == [("a", 1, 8)]


def test_label_folders(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"total": "10", "line_items": [{"description": "X", "quantity": 1}]}')
    (tmp_path / "a.json").write_text('{"total": 5}')
    (tmp_path / "note.txt").write_text("x")
    truth = labels.read_truth(spark, str(tmp_path))
    assert [r.doc_id for r in truth.collect()] == ["a", "b"]
    fields = labels.fields_of(truth, ("total",))
    rows = evaluate.compared(fields, fields.where("doc_id = 'b'"), ("total",)).orderBy("doc_id").collect()
    assert [(r.prediction_found, r.outcomes[0].matched) for r in rows] == [(False, False), (True, True)]
    assert [(r.doc_id, r.description, r.quantity) for r in labels.lines_of(truth).collect()] == [("b", "X", 1.0)]
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="no ground truth"):
        labels.read_truth(spark, str(tmp_path / "none"))


def test_rules_are_written_back(spark, tmp_path):
    path, now = str(tmp_path / "rules.json"), "2025-01-01T00:00:00Z"
    old = spark.createDataFrame([("tenant", "t", "ledger", "old", "Old", None, None), ("global", None, "party", "a", "A", None, None)], rules.SCHEMA)
    learned = spark.createDataFrame(
        [
            ("t", "ledger", "new", " New ", "learned", "ann"), ("t", "ledger", "old", "Newer", "learned", "ann"),
            ("t", "party", "x", "X", "duplicate", "ann"),
        ],
        "tenant_id string, entity_type string, key string, target string, status string, approved_by string",
    )
    for _ in range(2):
        rules.write_rules(rules.merged(old, learned, now=now), path, {None: True, "t": False})
        got = {(r.scope, r.tenant_id, r.entity_type, r.key): (r.target, r.learned_at) for r in rules.read_rules(spark, path).collect()}
        assert got == {("tenant", "t", "ledger", "old"): ("Newer", now), ("tenant", "t", "ledger", "new"): ("New", now), ("global", None, "party", "a"): ("A", None)}
        old = rules.read_rules(spark, path)
    assert {r.tenant_id: r.enabled for r in rules.learning_enabled(spark, path).collect()} == {None: True, "t": False}
    assert any("ann" in (r.provenance or "") for r in old.collect())


def test_rules_of_a_database(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/rules;create=true"
    assert rules.read_database(spark, url).collect() == []
    learned = spark.createDataFrame(
        [("t", "ledger", "k", "K", "learned", "ann")],
        "tenant_id string, entity_type string, key string, target string, status string, approved_by string",
    )
    for _ in range(2):
        rules.write_database(rules.merged(rules.read_database(spark, url), learned, "db", "2025-01-01"), url)
        assert [(r.scope, r.tenant_id, r.key, r.target, r.learned_at) for r in rules.read_database(spark, url).collect()] == [("db", "t", "k", "K", "2025-01-01")]


def query(spark, url, sql):
    return sorted(map(tuple, spark.read.format("jdbc").options(url=url, query=sql).load().collect()))


def test_upserts_keep_other_writers_rows_and_the_table(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/rules;create=true"
    fields = "scope string, tenant_id string, entity_type string, key string, target string, provenance string, learned_at string"
    one = spark.createDataFrame([("db", "t", "ledger", "k", "K", "{}", "1"), ("db", "t", "ledger", "both", "Old", None, "1"), ("global", None, "ledger", "no", "No", None, None)], fields)
    two = spark.createDataFrame([("db", "u", "ledger", "k", "O'Hara", None, "2"), ("db", "t", "ledger", "both", "New", None, "2"), ("db", "t", "ledger", "both", "Earlier", None, "1")], fields)
    rules.upsert_database(one, url)
    for _ in range(2):
        rules.upsert_database(two, url)
        assert query(spark, url, 'SELECT "tenant_id", "normalized_value", "ledger_name", "learned_at" FROM mapping_rules') == [
            ("t", "both", "New", "2"), ("t", "k", "K", "1"), ("u", "k", "O'Hara", "2"),
        ]
    assert {(r.scope, r.tenant_id, r.target) for r in rules.read_database(spark, url).collect()} == {("db", "t", "New"), ("db", "t", "K"), ("db", "u", "O'Hara")}
    # keys stay, and nothing but the table is left
    assert query(spark, url, "SELECT COUNT(*) AS n FROM sys.sysconstraints WHERE type = 'P'") == [(1,)]
    assert query(spark, url, "SELECT tablename FROM sys.systables WHERE tabletype = 'T'") == [("MAPPING_RULES",)]


def test_upserts_add_columns_that_older_tables_lack(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/rules;create=true"
    old = spark.createDataFrame([("t", "ledger", "k", "K")], "tenant_id string, entity_type string, normalized_value string, ledger_name string")
    old.write.format("jdbc").options(url=url, dbtable="mapping_rules", createTableColumnTypes=", ".join(f"{c} VARCHAR(100)" for c in old.columns)).save()
    rules.upsert_database(spark.createDataFrame([("db", "t", "ledger", "k2", "K2", '{"a":1}', "now")], rules.SCHEMA), url)
    assert sorted((r.key, r.target, r.provenance) for r in rules.read_database(spark, url).collect()) == [("k", "K", None), ("k2", "K2", '{"a":1}')]


def test_only_a_missing_table_is_no_rules(spark, tmp_path):
    assert rules.read_database(spark, f"jdbc:derby:{tmp_path}/new;create=true").collect() == []
    for url in (f"jdbc:derby:{tmp_path}/nowhere", "jdbc:nonsense:there"):
        with pytest.raises(Exception, match="(?i)nowhere|driver"):
            rules.read_database(spark, url)


def test_collections_of_the_server(spark):
    answers = {
        "Ledger": "<E><COLLECTION><LEDGER><NAME>Acme (Sundry Debtors)</NAME></LEDGER><LEDGER NAME=\"Sales\"><MasterId>7</MasterId></LEDGER><LEDGER><Name> </Name></LEDGER></COLLECTION></E>",
        "StockItem": "<E><COLLECTION><STOCKITEM><NAME>W</NAME></STOCKITEM></COLLECTION></E>",
    }
    found = master.fetch_collections(spark, answers.__getitem__)
    assert sorted((r.entity_type, r.name) for r in found.collect()) == [
        ("ledger", "Acme (Sundry Debtors)"), ("ledger", "Sales"), ("party", "Acme (Sundry Debtors)"), ("stock_item", "W"),
    ]
    assert [r.name for r in master.of_type(found, "ledger").collect()] == ["Acme (Sundry Debtors)", "Sales"]


def test_issues_carry_suggestions(spark):
    entities = spark.createDataFrame(
        [(0, "t", "party", "acme corporatlon"), (1, "t", "ledger", None), (2, "t", "ledger", "Sales")],
        "ord int, tenant_id string, entity_type string, value string",
    )
    records = spark.createDataFrame(MASTER, NAMES)
    resolved = reconcile.resolve(entities, records, spark.createDataFrame([], RULES))
    got = {r.ord: r.issue for r in reconcile.advise(resolved, records).collect()}
    assert [s.code for s in got[0].suggestions] == ["P100", "P101"] and got[0].suggestions[0].score >= got[0].suggestions[1].score and "tenant t" in got[0].message
    assert got[1].suggestions == [] and got[1].remedies == ["IMPROVE_EXTRACTION", "MAP_EMPTY_VALUE_BY_RULE"] and got[2] is None


def test_suggestions_in_blocks_equal_all_pairs(spark):
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abl10s5") for _ in range(rng.randint(1, 5)))
    records = spark.createDataFrame(
        [("party", i, f"{word()} {word()}", str(i), [word()] * rng.randint(0, 2)) for i in range(60)] + [("ledger", 0, "x", None, None)], NAMES,
    )
    values = spark.createDataFrame([("party", f"{word()} {word()}") for _ in range(20)] + [("party", None), ("stock_item", "x")], "entity_type string, value string")
    few, one = ({(r.value, r.rank): (r.name, r.code, round(r.score, 9)) for r in reconcile.suggest(values, records, block=b).collect()} for b in (7, 1000))
    assert few == one and len(few) == 3 * len({v for v, _ in few})


def test_master_sources(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"parties": [{"name": "A", "code": "1", "aliases": ["x"]}], "ledgers": [], "stock_items": [{"name": "W", "code": None}]}))
    assert [(r.entity_type, r.pos, r.aliases) for r in master.read_master(spark, str(path)).collect()] == [("party", 0, ["x"]), ("stock_item", 0, [])]
    store, calls = str(tmp_path / "cache"), []

    def fetch():
        calls.append(1)
        return spark.createDataFrame(MASTER, NAMES)

    ages = [master.cached(spark, store, fetch, ttl=300, now=t).select("source").first().source for t in (1000, 1300, 1301)]
    assert ages == ["live", "cache", "live"] and len(calls) == 2


def test_stream_posts_once(spark, tmp_path):
    schema = "idempotency_key string, arrival long"
    for n, rows in enumerate(([("a", 1), ("b", 2), ("a", 3)], [("b", 4), ("c", 5)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        query = stream.writeStream.foreachBatch(
            lambda batch, _: posting.post_batch(batch, f"{tmp_path}/posted")
        ).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination()
        assert sorted(
            (r.idempotency_key, r.arrival) for r in posting.posted(spark, f"{tmp_path}/posted", stream.schema).collect()
        ) == [("a", 1), ("b", 2), ("c", 5)][: 2 + n]


def test_decimals_of_lines_are_summed_as_they_are(spark):
    """Decimals give the sums of their texts; before, each was cast to text and read again."""
    names = ("taxable_value", "cgst_amount", "sgst_amount", "igst_amount", "tax_amount", "total_price")
    values = [(1, "1.005", "0.1", None, "0", "0.2", "9"), (1, None, "0.25", "0.25", None, "1.5", "7.25"), (2, "-3", None, None, "2.5", None, None)]
    texts = spark.createDataFrame(values, "invoice_id int, " + ", ".join(f"{n} string" for n in names))
    exact = texts.select("invoice_id", *(F.col(n).cast("decimal(20,4)").alias(n) for n in names))
    found = [voucher.line_sums(rows).orderBy("invoice_id").collect() for rows in (texts, exact)]
    assert found[0] == found[1] and str(found[1][0]["__t"]) == "6.7550000000"
    assert "as string" not in voucher.line_sums(exact)._jdf.queryExecution().optimizedPlan().toString().lower()
