"""Labelled and predicted invoices from folders of JSON files, one file a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import variants as v
from ..operators.evaluate import FIELDS


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, data VARIANT or null) of the *.json files of a folder, sorted by doc_id; doc_id is the name without its ending."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter="*.json")
    return rows.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("doc_id"), v.parse_json(F.col("value")).alias("data")).orderBy("doc_id")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """As read_documents; a folder without any file is an error."""
    found = read_documents(spark, path)
    if found.isEmpty():
        raise ValueError(f"no ground truth in {path}")
    return found


def fields_of(documents: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(doc_id, each field as text) for `evaluate.compared`."""
    return documents.select("doc_id", *(v.text(v.member(F.col("data"), f)).alias(f) for f in fields))


def lines_of(documents: DataFrame) -> DataFrame:
    """(doc_id, description, quantity, unit_price, total_price) for `evaluate.line_outcomes`."""
    rows = documents.select("doc_id", F.explode(v.items(v.member(F.col("data"), "line_items"))).alias("x"))
    m = lambda n: v.member(F.col("x"), n)
    return rows.select("doc_id", v.text(m("description")).alias("description"), *(v.number(m(n)).alias(n) for n in ("quantity", "unit_price", "total_price")))
