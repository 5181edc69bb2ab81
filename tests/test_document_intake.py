"""The intake job over an inbox that grows between runs."""

import json
import re
from collections import defaultdict

import pytest

from jobs import document_intake, settings

from .test_month_close import ROOT

CONFIG = document_intake.Config(languages={"src1": "deu"}, max_pages=2, page_chars=100, files_per_batch=1)


def plain(rows):
    """{content: what the register should say} of (doc_id, text, source) rows."""
    groups = defaultdict(list)
    for doc_id, text, source in rows:
        groups[re.sub(r"\s+", " ", (text or "").lower()).strip(" ")].append((doc_id is None, doc_id or 0, source or "", text or ""))
    out = {}
    for content, found in groups.items():
        none, first, source, text = min(found)
        ids = [i for no, i, *_ in found if not no]
        state = "empty" if not content else "too_long" if len(text) > 200 else "accepted"
        out[content] = (None if none else first, max(ids, default=None), source or None, "deu" if source == "src1" else "eng", len(text), len(content.split(" ")) if content else 0, len(found), state)
    return out


def told(df):
    return sorted(map(repr, ((r.first_doc_id, r.last_doc_id, r.tenant, r.language, r.n_chars, r.n_words, r.n_docs, r.state) for r in df.collect())))


def add(spark, rows, inbox):
    spark.createDataFrame(rows, document_intake.INBOX).withColumn("extra", document_intake.F.lit(1)).coalesce(1).write.mode("append").parquet(inbox)


FIRST = [(1, "One  text", "src1"), (2, "one text ", "src2"), (3, None, "src1"), (4, " \n", None), (5, "x" * 300, "src2"), (None, "nameless", "src1"), (9, "late", "src1")]
SECOND = [(0, "ONE TEXT", "src3"), (6, "one\ttext", "src1"), (7, "new", "src1"), (7, "new", "src1"), (8, "nameless", "src2")]


def test_two_runs_over_a_growing_inbox(spark, tmp_path):
    inbox, out, checkpoint = (str(tmp_path / x) for x in ("inbox", "out", "checkpoint"))
    add(spark, FIRST, inbox)
    assert told(document_intake.run(spark, inbox, out, checkpoint, CONFIG)) == sorted(map(repr, plain(FIRST).values()))
    add(spark, SECOND, inbox)
    assert told(document_intake.run(spark, inbox, out, checkpoint, CONFIG)) == sorted(map(repr, plain(FIRST + SECOND).values()))
    updates = spark.read.parquet(f"{out}/updates")
    # the second batch tells of the contents of its own file alone
    assert updates.where("batch = 1").count() == len(plain(SECOND)) and updates.where("batch = 0").count() == len(plain(FIRST))


def test_nothing_new_changes_nothing(spark, tmp_path):
    inbox, out, checkpoint = (str(tmp_path / x) for x in ("inbox", "out", "checkpoint"))
    add(spark, FIRST, inbox)
    once = told(document_intake.run(spark, inbox, out, checkpoint, CONFIG))
    files = sorted(str(p) for p in (tmp_path / "out").rglob("*.parquet"))
    assert told(document_intake.run(spark, inbox, out, checkpoint, CONFIG)) == once
    assert sorted(str(p) for p in (tmp_path / "out").rglob("*.parquet")) == files


def test_batches_do_not_matter(spark, tmp_path):
    inbox = str(tmp_path / "inbox")
    for rows in (FIRST, SECOND):
        add(spark, rows, inbox)
    one = document_intake.run(spark, inbox, str(tmp_path / "a"), str(tmp_path / "ca"), CONFIG)
    many = document_intake.run(spark, inbox, str(tmp_path / "b"), str(tmp_path / "cb"), document_intake.Config(CONFIG.languages, max_pages=2, page_chars=100))
    assert told(one) == told(many)


def test_state_is_kept_off_the_heap_and_settings_return(spark, tmp_path):
    name, provider = document_intake.STATE_STORE
    before = spark.conf.get(name)
    inbox = str(tmp_path / "inbox")
    add(spark, FIRST, inbox)
    document_intake.run(spark, inbox, str(tmp_path / "out"), str(tmp_path / "checkpoint"), CONFIG)
    assert spark.conf.get(name) == before
    kept = (tmp_path / "checkpoint" / "offsets" / "0").read_text().splitlines()
    assert json.loads(kept[1])["conf"][name] == provider


def test_an_empty_inbox_has_an_empty_register(spark, tmp_path):
    (tmp_path / "inbox").mkdir()
    found = document_intake.run(spark, str(tmp_path / "inbox"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), CONFIG)
    assert found.collect() == []


def test_a_pattern_of_files(spark, tmp_path):
    for n, rows in enumerate((FIRST, SECOND)):
        add(spark, rows, str(tmp_path / f"inbox{n}"))
    found = document_intake.run(spark, str(tmp_path / "inbox[01]"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), CONFIG)
    assert told(found) == sorted(map(repr, plain(FIRST + SECOND).values()))


def test_settings_of_a_file(spark):
    assert settings.read(spark, f"{ROOT}/jobs/document_intake.json", document_intake.Config).max_pages == 20
    with pytest.raises(ValueError, match="no such setting"):
        settings.read(spark, f"{ROOT}/jobs/month_close.json", document_intake.Config)
