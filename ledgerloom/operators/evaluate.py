"""Extraction quality: field and line precision, recall and F1, document rates, release gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import fresh
from ..functions.numbers import is_close, parse_number, snap
from ..functions.text import strip

FIELDS = ("invoice_number", "invoice_date", "seller", "buyer", "currency", "subtotal", "tax", "total")
CRITICAL = ("invoice_number", "invoice_date", "total")
# Fields compared as numbers.
NUMERIC = ("subtotal", "tax", "total", "quantity", "unit_price", "total_price")


def values_match(field: str, truth: Column, found: Column, tolerance: float = 0.01) -> Column:
    if field in NUMERIC:
        same = F.coalesce(is_close(parse_number(truth), parse_number(found), tolerance), F.lit(False))
    else:
        same = F.lower(strip(truth)) == F.lower(strip(found))
    return F.when(truth.isNull() & found.isNull(), True).when(truth.isNull() | found.isNull(), False).otherwise(same)


def f1(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    p = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    r = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    return {"precision": p, "recall": r, "f1": F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))}


def compared(truth: DataFrame, found: DataFrame, fields: tuple[str, ...] = FIELDS, tolerance: float = 0.01, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, prediction_found, outcomes: array of field, matched, tp, fp, fn) of all true documents; without a prediction all is null."""
    mine = fresh(truth, "p")
    right = found.select(id_col, F.struct(*(F.col(f).cast("string").alias(f) for f in fields)).alias(mine))
    rows = truth.select(id_col, *(F.col(f).cast("string").alias(f) for f in fields)).join(right, id_col, "left")
    outcomes = []
    for f in fields:
        t, p = F.col(f), F.col(f"{mine}.{f}")
        ok = values_match(f, t, p, tolerance)
        both, one = t.isNotNull() & p.isNotNull(), lambda c: c.cast("int")
        outcomes.append(
            F.struct(
                F.lit(f).alias("field"), ok.alias("matched"), one(both & ok).alias("tp"), one(p.isNotNull() & ~(both & ok)).alias("fp"),
                one(t.isNotNull() & ~(both & ok)).alias("fn"),
            )
        )
    return rows.select(id_col, F.col(mine).isNotNull().alias("prediction_found"), F.array(*outcomes).alias("outcomes"))


def field_outcomes(truth: DataFrame, found: DataFrame, fields: tuple[str, ...] = FIELDS, tolerance: float = 0.01, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, field, matched, tp, fp, fn): one row for each field of each true document."""
    return compared(truth, found, fields, tolerance, id_col).select(id_col, F.inline("outcomes"))


def field_prf(rows: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(field, tp, fp, fn, precision, recall, f1) of compared documents, by one aggregation; none without documents."""
    sums = [F.struct(F.lit(f).alias("field"), *(F.sum(F.col("outcomes")[i][c]).alias(c) for c in ("tp", "fp", "fn"))) for i, f in enumerate(fields)]
    rows = rows.agg(F.count("*").alias("n"), *(s.alias(f"f{i}") for i, s in enumerate(sums))).where("n > 0")
    rows = rows.select(F.inline(F.array(*(f"f{i}" for i in range(len(sums))))))
    return rows.select("*", *(c.alias(n) for n, c in f1(F.col("tp"), F.col("fp"), F.col("fn")).items()))


def line_outcomes(truth: DataFrame, found: DataFrame, tolerance: float = 0.01, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, tp, fp, fn): bag intersection of canonical lines of each document with lines on either side."""
    by = [id_col, "d", "q", "u", "t"]

    def canonical(df: DataFrame, side: int) -> DataFrame:
        text = F.coalesce(F.lower(strip(F.col("description"))), F.lit(""))
        return df.select(
            id_col, text.alias("d"), *(snap(F.col(c).cast("double"), tolerance).alias(c[0]) for c in ("quantity", "unit_price", "total_price")),
            F.lit(side).alias("side"),
        )

    # both sides are counted in one aggregation, which nothing has to join
    both = canonical(truth, 0).unionByName(canonical(found, 1)).groupBy(*by).agg(
        F.count_if(F.col("side") == 0).alias("n_truth"), F.count_if(F.col("side") == 1).alias("n_found"),
    )
    tp = F.sum(F.least("n_truth", "n_found"))
    return both.groupBy(id_col).agg(tp.alias("tp"), (F.sum("n_found") - tp).alias("fp"), (F.sum("n_truth") - tp).alias("fn"))


def documents(rows: DataFrame, lines: DataFrame, critical: tuple[str, ...] = CRITICAL, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, prediction_found, exact_match, critical_pass, line_tp, line_fp, line_fn) of compared documents."""
    fields = rows.select(
        id_col, "prediction_found", F.forall("outcomes", lambda x: x["matched"]).alias("all_fields"), F.forall(
            "outcomes", lambda x: x["matched"] | ~x["field"].isin(*critical),
        ).alias("critical_pass"),
    )
    rows = fields.join(lines, id_col, "left").na.fill(0, ["tp", "fp", "fn"])
    return rows.select(
        id_col, "prediction_found", (
            F.col("all_fields") & (F.col("fp") == 0) & (F.col("fn") == 0)
        ).alias("exact_match"), "critical_pass", F.col("tp").alias("line_tp"), F.col("fp").alias("line_fp"), F.col("fn").alias("line_fn"),
    )


def overall(fields: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: micro scores over fields, line scores, and document rates."""
    f = fields.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    f = f.select("*", *(c.alias(n) for n, c in f1(F.col("tp"), F.col("fp"), F.col("fn")).items()))
    d = docs.agg(
        F.count("*").alias("documents"), F.avg(F.col("exact_match").cast("int")).alias("exact_rate"),
        F.avg(F.col("critical_pass").cast("int")).alias("critical_rate"), *(F.sum(f"line_{c}").alias(f"line_{c}") for c in ("tp", "fp", "fn")),
    )
    d = d.select("*", *(c.alias(f"line_{n}") for n, c in f1(F.col("line_tp"), F.col("line_fp"), F.col("line_fn")).items()))
    return f.join(d)  # one row each


def gate(fields: DataFrame, summary: DataFrame, critical: tuple[str, ...] = CRITICAL, least_f1: float = 0.95, least_rate: float = 0.90) -> DataFrame:
    """One row: fields_pass, rate_pass, passed. Critical fields that were not measured are ignored."""
    f = fields.where(F.col("field").isin(*critical)).agg(F.coalesce(F.every(F.col("f1") >= least_f1), F.lit(True)).alias("fields_pass"))
    rows = f.join(summary.select((F.col("critical_rate") >= least_rate).alias("rate_pass")))
    return rows.withColumn("passed", F.col("fields_pass") & F.col("rate_pass"))
