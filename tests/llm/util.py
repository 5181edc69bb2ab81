"""Fixtures that every operator is run over."""

from __future__ import annotations

import glob
import os

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, n_removed string, score string, spans string, key string, a string, root string, items string, site string"


def docs(spark, rows):
    """Documents (doc_id, text[, source]) with further columns whose names operators use themselves."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s1", len(r[1] or ""), *(["x"] * 9)) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


LONG = " ".join(f"w{i % 997} v{i % 1009}" for i in range(30_000))
#: Nulls, empty and blank texts, one very long text, ties, repeated rows and ids.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, LONG), (6, "a b c d e f g h i j k l"), (6, "a b c d e f g h i j k l"),
    (7, "a b c d e f g h i j k l"), (None, "a b c d e f g h i j k l"), (8, "x" * 100_000), (8, "other words under one id"),
    (9, "Ünïcode 漢字 \U0001f642 \x00 end"),
]


def numpy_free(value):
    return value.tolist() if hasattr(value, "tolist") else value


def duck(sql: str, sf: str):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con.execute(sql).fetchall(), [d[0] for d in con.description]
