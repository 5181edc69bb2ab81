"""Posting by keyed state, snapshots of master data, collections in files, and inboxes of which few files are asked for."""

import os

from ledgerloom.sources import documents, master, readers
from ledgerloom.streaming import keyed


def test_answers_over_restarts(spark, tmp_path):
    log = tmp_path / "asked"
    log.mkdir()

    def ask(xml, key):
        (log / f"{key}-{xml}").touch()
        return (key != "no", f"took {xml}") if key != "late" else (xml == "x7", f"said {xml}")

    batches = (
        [("a", "j1", 2, "x1"), ("a", "j2", 1, "x2"), ("no", "j3", 1, "x3"), ("no", "j4", None, "x4"), (None, "j5", 1, "x5"), ("late", "j6", 1, "x6")],
        [("a", "j2", 1, "x2"), ("a", "j8", 0, "x8"), ("b", None, None, None), ("no", "j9", 1, "x9"), ("late", "j7", 5, "x7")],
        [],
        [("late", "j6", 1, "x6"), ("b", "j10", 1, "x10")],
    )
    got = []
    for rows in batches:
        spark.createDataFrame(rows, keyed.JOB).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(keyed.JOB).parquet(f"{tmp_path}/in")
        keyed.start(stream, f"{tmp_path}/out", f"{tmp_path}/check", ask, available_now=True).awaitTermination()
        found = sorted((tuple(r) for r in spark.read.schema(keyed.RESPONSE).parquet(f"{tmp_path}/out").collect()), key=str)
        old = list(got)
        got = found
        new = list(found)
        for r in old:
            new.remove(r)
        rows_, want = new, {
            0: [("a", "j1", "duplicate", "j2", "took x2"), ("a", "j2", "posted", "j2", "took x2"), ("late", "j6", "failed", "j6", "said x6"), ("no", "j3", "failed", "j3", "took x3"), ("no", "j4", "retry_pending", "j3", "took x3"), (None, "j5", "unkeyed", None, None)],
            6: [("a", "j2", "posted", "j2", "took x2"), ("a", "j8", "duplicate", "j2", "took x2"), ("b", None, "posted", None, "took None"), ("late", "j7", "posted", "j7", "said x7"), ("no", "j9", "failed", "j9", "took x9")],
            11: [] if not rows else [("b", "j10", "duplicate", None, "took None"), ("late", "j6", "duplicate", "j7", "said x7")],
        }[len(old)]
        assert rows_ == sorted(want, key=str)
    assert sorted(os.listdir(log)) == ["a-x2", "b-None", "late-x6", "late-x7", "no-x3", "no-x9"]


def test_readers_of_an_older_snapshot_go_on(spark, tmp_path):
    store = str(tmp_path / "cache")

    def fetch(name):
        return lambda: spark.createDataFrame([("party", name)], "entity_type string, name string")

    old = master.cached(spark, store, fetch("A"), now=1000)
    new = master.cached(spark, store, fetch("B"), now=1400)
    assert [r.name for r in old.collect()] == ["A"] and [r.name for r in new.collect()] == ["B"]
    os.makedirs(f"{store}/snapshot-00000000009999.000-torn")  # a writer that died: not whole, so nobody reads it
    again = master.cached(spark, store, fetch("C"), now=1500)
    assert [(r.name, r.source) for r in again.collect()] == [("B", "cache")]
    master.cached(spark, store, fetch("D"), force=True, now=1500 + 2 * master.KEEP_SECONDS)
    assert len(master.snapshots(spark, store)) == 1
    empty = master.cached(spark, f"{store}2", lambda: fetch("x")().where("false"), now=5)
    assert empty.count() == 0 and master.cached(spark, f"{store}2", fetch("y"), now=6).count() == 0


def test_collections_in_files_are_read_in_many_tasks(spark, tmp_path):
    rows = [
        '<LEDGER><NAME>A</NAME><ALIASES>x, y</ALIASES></LEDGER>', '<LEDGER NAME="B"><MasterId> 7 </MasterId>\n</LEDGER>', '<LEDGER NAME="C"/>', "<LEDGER><Name> </Name></LEDGER>",
        "<LEDGER><NAME>A</NAME><MASTERID>9</MASTERID></LEDGER>", "<LEDGERS><NAME>no</NAME></LEDGERS>", "<LEDGER><NAME>D &amp; E</NAME></LEDGER>",
    ]
    body = "<E><COLLECTION>" + "\n".join(rows * 300) + "</COLLECTION></E>"
    (tmp_path / "m.xml").write_text(body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    try:
        found = master.read_collection_files(spark, str(tmp_path), "ledger", "LEDGER")
        assert found.rdd.getNumPartitions() > 10
        got = [(r.name, r.code, r.aliases) for r in found.orderBy("pos").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    whole = master.read_collection(spark.createDataFrame([("<COLLECTION>" + "\n".join(rows * 300) + "</COLLECTION>",)], "body string").selectExpr("concat('<E>', body, '</E>') AS body"), "ledger", "LEDGER")
    assert got == [(r.name, r.code, r.aliases) for r in whole.orderBy("pos").collect()] and len(got) == 5 * 300


def test_only_asked_files_are_opened(spark, tmp_path):
    for n in range(40):
        (tmp_path / f"f{n}.pdf").write_bytes(b"%d" % n)
    (tmp_path / "odd [1] {a}*?.pdf").write_bytes(b"odd")
    names = [f"{tmp_path}/f3.pdf", f"{tmp_path}/f30.pdf", f"{tmp_path}/odd [1] {{a}}*?.pdf", f"{tmp_path}/none.pdf"]
    asked = spark.createDataFrame([(p, t) for p in names for t in ("t", None)], "path string, tenant_id string")
    found = documents.listed(spark, asked, str(tmp_path))
    assert len(found.inputFiles()) == 3
    got = {(r.path, r.tenant_id): None if r.content is None else bytes(r.content) for r in found.collect()}
    assert got == {(p, t): c for p, c in zip(names, (b"3", b"30", b"odd", None), strict=True) for t in ("t", None)}
    assert {r.content for r in documents.listed(spark, asked.where("path LIKE '%none%'"), str(tmp_path)).collect()} == {None}


def test_a_program_that_hangs_is_ended(monkeypatch):
    monkeypatch.setattr(readers, "PROGRAM_SECONDS", 0.2)
    row = documents.read_one(lambda *_: readers.Pages(iter([readers.printed(["sleep", "60"]).decode()]), "word_parser", False), "word", ".doc", b"x", "eng", [], documents.Limits(), lambda: 0.0)
    assert row["error"] == "OCR_TIMEOUT" and row["context"] == {"program": "sleep"} and readers.printed(["cat"], b"told") == b"told"


def test_first_jobs_are_found_without_sorting_frames(monkeypatch):
    """By arrival (null last), job_id and xml, over all parts; each part was sorted as a frame before."""
    import pandas as pd

    class State:
        exists, kept = False, None

        def update(self, value):
            self.kept = value

    def fails(*_, **__):
        raise AssertionError("sorted")

    monkeypatch.setattr(pd.DataFrame, "sort_values", fails)
    frame = lambda *rows: pd.DataFrame(list(rows), columns=["idempotency_key", "job_id", "arrival", "xml"])
    parts = [frame(("k", "a", float("nan"), "x"), ("k", "c", 2.0, "y")), frame(("k", "b", 2.0, "z"), ("k", None, 2.0, None))]
    state, asked = State(), []
    found = pd.concat(keyed._answers(lambda xml, key: asked.append((xml, key)) or (True, "yes"))(("k",), iter(parts), state))
    assert asked == [("z", "k")] and state.kept == ("b", True, "yes")
    assert list(found["status"]) == ["duplicate", "duplicate", "posted", "duplicate"] and set(found["first_job_id"]) == {"b"} and list(found.columns) == [c.split()[0] for c in keyed.RESPONSE.split(", ")]
