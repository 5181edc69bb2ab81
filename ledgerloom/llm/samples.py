"""Label splits and bounded training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text divides by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def sample_ids(ids: DataFrame, n: int, seed: int) -> DataFrame:
    """At most n rows (doc_id, ...), those with the least hash: the same rows however the table is laid out."""
    return ids.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(n)
