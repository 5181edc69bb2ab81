"""Artifact tables, the review queue, voucher XML and evaluation reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_artifact(rows: DataFrame, root: str, stage: str) -> None:
    """One table per stage, partitioned by day so that no folder holds one file per job."""
    rows.write.mode("append").partitionBy("day").parquet(f"{root}/{stage}")


def append_review_queue(rows: DataFrame, path: str, mode: str = "append") -> None:
    """One JSON line per row."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode(mode).text(path)


def write_voucher_xml(vouchers: DataFrame, path: str, xml: str = "xml") -> None:
    """One envelope per line."""
    vouchers.select(F.col(xml).alias("value")).write.mode("overwrite").text(path)


def write_report(fields: DataFrame, lines: DataFrame, summary: DataFrame, path: str) -> None:
    """CSV of fields in order, then line_items; and the summary as JSON. Both are a few rows."""
    columns = ("field", "tp", "fp", "fn", "precision", "recall", "f1")
    last = lines.select(F.lit("line_items").alias("field"), *columns[1:])
    both = fields.select(F.lit(0).alias("part"), *columns).unionByName(last.select(F.lit(1).alias("part"), *columns))
    both.orderBy("part", "field").select(*columns).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/fields")
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
