"""The month-close job: ranges, reruns, rejected vouchers, settings and the command line."""

import glob
import json
import os
import subprocess
import sys
import tempfile
from dataclasses import replace

import pytest

from jobs import month_close, settings

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture(scope="module")
def tables(spark, sf, tmp_path_factory):
    """Copies of the tables with a buyer that is not in the master data, and one without a name."""
    place = str(tmp_path_factory.mktemp("tables"))
    for name in ("orders", "lineitem", "supplier", "part"):
        spark.read.parquet(f"{sf}/{name}.parquet").where("true").write.parquet(f"{place}/{name}.parquet")
    customers = spark.read.parquet(f"{sf}/customer.parquet")
    customers.where("c_custkey <> 7").selectExpr(
        "c_custkey", "CASE c_custkey WHEN 8 THEN '  ' ELSE c_name END AS c_name", "c_nationkey", "c_acctbal", "c_mktsegment"
    ).write.parquet(f"{place}/customer.parquet")
    return place


def test_a_rerun_gives_the_same_and_books_balance(spark, tables, tmp_path):
    out = str(tmp_path)
    once = rows(month_close.run(spark, tables, out))
    assert once == rows(month_close.run(spark, tables, out))
    balances = spark.read.parquet(f"{out}/balances")
    off = balances.groupBy("month").agg({"debit": "sum", "credit": "sum"}).where("`sum(debit)` <> `sum(credit)`")
    assert balances.count() > 0 and off.count() == 0
    errors = {r.error for r in spark.read.parquet(f"{out}/vouchers").select("error").distinct().collect()}
    assert {None, "MISSING_EXTRACTED_VALUE", "ROUND_OFF_LIMIT"} <= errors


def test_only_the_asked_months_change(spark, tables, tmp_path):
    out = str(tmp_path)
    month_close.run(spark, tables, out)
    months = [r.month for r in spark.read.parquet(f"{out}/balances").where("ledger_name = 'Sales'").select("month").distinct().sort("month").collect()]
    config = month_close.Config(first_month=months[1], last_month=months[2], ledgers={"sales": "Turnover"})
    found = month_close.run(spark, tables, out, config)
    named = {(r.month, r.ledger_name) for r in found.where("kind = 'balance' AND ledger_name IN ('Sales', 'Turnover')").collect()}
    assert {m for m, n in named if n == "Turnover"} == set(months[1:3]) and {m for m, n in named if n == "Sales"} == set(months) - set(months[1:3])
    assert not {m for m, n in named if n == "Turnover"} & {m for m, n in named if n == "Sales"}


def test_rules_name_the_ledger_of_a_buyer(spark, tables, tmp_path):
    rules = tmp_path / "rules.json"
    rules.write_text(json.dumps({"global": {"party": {"customer#000000001": "Customer#000000002"}}}))
    found = month_close.run(spark, tables, str(tmp_path / "out"), month_close.Config(rules=str(rules)))
    assert found.where("ledger_name = 'Customer#000000001'").count() == 0
    assert found.where("ledger_name = 'Customer#000000002' AND kind = 'entry'").count() > 0


def test_no_orders_in_range_writes_nothing(spark, tables, tmp_path):
    out = str(tmp_path)
    before = rows(month_close.run(spark, tables, out))
    assert before == rows(month_close.run(spark, tables, out, month_close.Config(first_month="2090-01")))
    assert month_close.run(spark, tables, f"{out}/new", month_close.Config(first_month="2090-01")).collect() == []


def test_settings_of_a_file(spark, tmp_path):
    assert settings.read(spark, f"{ROOT}/jobs/month_close.json", month_close.Config) == replace(
        month_close.Config(), ledgers={"sales": "Sales", "cgst": "CGST", "sgst": "SGST", "igst": "IGST", "round_off": "Round Off"}
    )
    bad = tmp_path / "bad.json"
    bad.write_text('{"month": 1}')
    with pytest.raises(ValueError, match="no such setting: month"):
        settings.read(spark, str(bad), month_close.Config)


def test_command_line(tables, tmp_path):
    done = subprocess.run(
        [sys.executable, "-m", "jobs.month_close", tables, str(tmp_path / "books"), "--config", "jobs/month_close.json"],
        cwd=ROOT, capture_output=True, text=True, timeout=300, env=os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"},
    )
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read" in done.stderr and "wrote" in done.stderr and (tmp_path / "books" / "balances").is_dir()


def test_what_a_write_shuffled_is_gone_before_the_next(spark, tables, tmp_path):
    """Else two closes leave all their shuffles on the disk at once, and invoices that only later steps read."""
    tracker = spark.sparkContext._jsc.sc().env().mapOutputTracker()
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, left, kept, write = spark.conf.get(setting), [], [], month_close._write

    def told(rows, path):
        found = write(rows, path)
        left.append(tracker.shuffleStatuses().size())
        kept.append(path)
        return found

    spark.sparkContext._jvm.System.gc()
    month_close._write, start = told, tracker.shuffleStatuses().size()
    try:
        month_close.run(spark, tables, str(tmp_path / "books"))
    finally:
        month_close._write = write
    # counting what was written leaves a row of each task, no more
    assert len(kept) == 3 and max(left) <= start + 2 * len(kept) + 4
    assert spark.conf.get(setting) == before
    folders = glob.glob(spark.conf.get("spark.checkpoint.dir", tempfile.gettempdir() + "/ledgerloom-*") + "/ledgerloom/invoices-*/tables")
    assert not [f for f in folders if os.path.getmtime(f) > os.path.getmtime(tmp_path)]
