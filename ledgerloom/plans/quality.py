"""Registered queries: evaluation of extraction quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate
from ..sources import shared
from . import bindings as b
from .catalog import query

# A prediction for every invoice but each twelfth: fields dropped, changed or rewritten by order number.
_P = f"""WITH {b.SQL}, t AS (
  SELECT invoice_id AS doc_id, invoice_number, strftime(invoice_date, '%Y-%m-%d') AS invoice_date, seller, buyer, 'INR' AS currency, CAST(subtotal AS VARCHAR) AS subtotal, CAST(tax AS VARCHAR) AS tax, CAST(total AS VARCHAR) AS total, total AS amount FROM inv
), p AS (
  SELECT doc_id, CASE WHEN doc_id % 29 = 0 THEN 'X' ELSE ' ' || invoice_number END AS invoice_number, invoice_date, CASE WHEN doc_id % 6 <> 0 THEN upper(seller) END AS seller, buyer, CASE WHEN doc_id % 4 = 0 THEN 'USD' ELSE 'inr' END AS currency,
    subtotal, CASE WHEN doc_id % 5 <> 0 THEN tax END AS tax, CASE WHEN doc_id % 9 = 0 THEN CAST(amount + 1 AS VARCHAR) ELSE '$ ' || total END AS total FROM t WHERE doc_id % 12 <> 0
), j AS (SELECT t.*, p.doc_id IS NOT NULL AS has, p.invoice_number AS p1, p.invoice_date AS p2, p.seller AS p3, p.buyer AS p4, p.currency AS p5, p.subtotal AS p6, p.tax AS p7, p.total AS p8 FROM t LEFT JOIN p USING (doc_id)
), o AS (
  SELECT doc_id, f.field, f.t AS t, f.p AS p, f.ok AS ok FROM (SELECT doc_id, unnest([
    {{'field': 'invoice_number', 't': invoice_number, 'p': p1, 'ok': lower(trim(p1)) = lower(invoice_number)}}, {{'field': 'invoice_date', 't': invoice_date, 'p': p2, 'ok': p2 = invoice_date}}, {{'field': 'seller', 't': seller, 'p': p3, 'ok': lower(p3) = lower(seller)}},
    {{'field': 'buyer', 't': buyer, 'p': p4, 'ok': p4 = buyer}}, {{'field': 'currency', 't': currency, 'p': p5, 'ok': lower(p5) = lower(currency)}}, {{'field': 'subtotal', 't': subtotal, 'p': p6, 'ok': true}}, {{'field': 'tax', 't': tax, 'p': p7, 'ok': true}}, {{'field': 'total', 't': total, 'p': p8, 'ok': doc_id % 9 <> 0}}]) AS f FROM j)
), oc AS (
  SELECT doc_id, field, (t IS NULL AND p IS NULL) OR (t IS NOT NULL AND p IS NOT NULL AND ok) AS matched, CASE WHEN t IS NOT NULL AND p IS NOT NULL AND ok THEN 1 ELSE 0 END AS tp,
    CASE WHEN p IS NOT NULL AND NOT (t IS NOT NULL AND ok) THEN 1 ELSE 0 END AS fp, CASE WHEN t IS NOT NULL AND NOT (p IS NOT NULL AND ok) THEN 1 ELSE 0 END AS fn FROM o
), fp AS (
  SELECT field, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM oc GROUP BY field
), fs AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0.0) AS recall FROM fp
), tl AS (SELECT invoice_id AS doc_id, 'part ' || (l_partkey % 3) AS d, line_no AS q, count(*) AS n FROM il GROUP BY ALL
), pl AS (SELECT invoice_id AS doc_id, 'part ' || (l_partkey % 3) AS d, CASE WHEN l_partkey % 8 = 0 THEN line_no + 1 ELSE line_no END AS q, count(*) AS n FROM il WHERE l_partkey % 10 <> 0 AND invoice_id % 12 <> 0 GROUP BY ALL
), ll AS (
  SELECT coalesce(tl.doc_id, pl.doc_id) AS doc_id, sum(least(coalesce(tl.n, 0), coalesce(pl.n, 0)))::BIGINT AS tp, (sum(coalesce(pl.n, 0)) - sum(least(coalesce(tl.n, 0), coalesce(pl.n, 0))))::BIGINT AS fp, (sum(coalesce(tl.n, 0)) - sum(least(coalesce(tl.n, 0), coalesce(pl.n, 0))))::BIGINT AS fn
  FROM tl FULL JOIN pl ON tl.doc_id = pl.doc_id AND tl.d = pl.d AND tl.q = pl.q GROUP BY 1
), ds AS (
  SELECT f.doc_id, doc_id % 12 <> 0 AS prediction_found, f.m AND coalesce(ll.fp, 0) = 0 AND coalesce(ll.fn, 0) = 0 AS exact_match, f.c AS critical_pass, coalesce(ll.tp, 0) AS line_tp, coalesce(ll.fp, 0) AS line_fp, coalesce(ll.fn, 0) AS line_fn
  FROM (SELECT doc_id, bool_and(matched) AS m, bool_and(matched OR field NOT IN ('invoice_number', 'invoice_date', 'total')) AS c FROM oc GROUP BY doc_id) f LEFT JOIN ll USING (doc_id)
), ov AS (
  SELECT f.*, d.* FROM (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM fp) f, (SELECT count(*) AS documents, avg(exact_match::INT) AS exact_rate, avg(critical_pass::INT) AS critical_rate, sum(line_tp)::BIGINT AS line_tp, sum(line_fp)::BIGINT AS line_fp, sum(line_fn)::BIGINT AS line_fn FROM ds) d
)"""


def _truth(spark, sf_dir):
    text = lambda c: F.col(c).cast("string").alias(c)
    return b.invoices(spark, sf_dir).select(
        F.col("invoice_id").alias("doc_id"), "invoice_number", text("invoice_date"), "seller", "buyer", F.lit("INR").alias("currency"),
        text("subtotal"), text("tax"), text("total"), F.col("total").alias("amount"),
    )


def _found(truth):
    d = F.col("doc_id")
    return truth.where("doc_id % 12 <> 0").select(
        "doc_id", F.when(d % 29 == 0, "X").otherwise(F.concat(F.lit(" "), "invoice_number")).alias("invoice_number"), "invoice_date", F.when(d % 6 != 0, F.upper("seller")).alias("seller"), "buyer", F.when(d % 4 == 0, "USD").otherwise("inr").alias("currency"),
        "subtotal", F.when(d % 5 != 0, F.col("tax")).alias("tax"), F.when(d % 9 == 0, (F.col("amount") + 1).cast("string")).otherwise(F.concat(F.lit("$ "), "total")).alias("total"),
    )


def _compared(spark, sf_dir):
    """Compared documents, written once: fields and documents are both read off them."""
    place = shared.folder(spark, "evaluation")
    _truth(spark, sf_dir).write.parquet(f"{place}/truth")
    truth = spark.read.parquet(f"{place}/truth")
    evaluate.compared(truth, _found(truth)).write.parquet(f"{place}/compared")
    return spark.read.parquet(f"{place}/compared")


def _lines(spark, sf_dir):
    rows = b.invoice_lines(spark, sf_dir).select(
        F.col("invoice_id").alias("doc_id"), "l_partkey", "line_no", F.concat(F.lit(" Part "), F.col("l_partkey") % 3).alias("description"),
    )
    truth = rows.select("doc_id", "description", F.col("line_no").alias("quantity"), F.lit(1).alias("unit_price"), F.lit(None).cast("double").alias("total_price"))
    kept = rows.where("l_partkey % 10 <> 0 AND doc_id % 12 <> 0")
    found = kept.select(
        "doc_id", F.upper("description").alias("description"),
        F.when(F.col("l_partkey") % 8 == 0, F.col("line_no") + 1).otherwise(F.col("line_no")).alias("quantity"), F.lit(1.001).alias("unit_price"),
        F.lit(None).cast("double").alias("total_price"),
    )
    return evaluate.line_outcomes(truth, found)


_F1 = "coalesce(2 * {p} * {r} / nullif({p} + {r}, 0), 0.0)"


@query("eval_field_prf", f"{_P} SELECT *, {_F1.format(p='precision', r='recall')} AS f1 FROM fs")
def eval_field_prf(spark, sf_dir):
    return evaluate.field_prf(_compared(spark, sf_dir))


@query("eval_line_prf", f"{_P} SELECT doc_id, tp, fp, fn FROM ll")
def eval_line_prf(spark, sf_dir):
    return _lines(spark, sf_dir)


@query("eval_documents", f"{_P} SELECT * FROM ds")
def eval_documents(spark, sf_dir):
    return evaluate.documents(_compared(spark, sf_dir), _lines(spark, sf_dir))


_PR = "{tp}::DOUBLE / ({tp} + {fp})"


@query("eval_overall", f"""{_P}, pr AS (SELECT *, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / (tp + fn) AS recall, line_tp::DOUBLE / (line_tp + line_fp) AS line_precision, line_tp::DOUBLE / (line_tp + line_fn) AS line_recall FROM ov)
SELECT * EXCLUDE (precision, recall, line_precision, line_recall, exact_rate, critical_rate), round(precision, 9) AS precision, round(recall, 9) AS recall, round({_F1.format(p='precision', r='recall')}, 9) AS f1, round(line_precision, 9) AS line_precision, round(line_recall, 9) AS line_recall, round({_F1.format(p='line_precision', r='line_recall')}, 9) AS line_f1,
  round(exact_rate, 9) AS exact_rate, round(critical_rate, 9) AS critical_rate FROM pr""")
def eval_overall(spark, sf_dir):
    o = _compared(spark, sf_dir)
    rows = evaluate.overall(evaluate.field_prf(o), evaluate.documents(o, _lines(spark, sf_dir)))
    return rows.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes))


@query(
    "release_gate",
    f"{_P}, g AS (SELECT bool_and({_F1.format(p='precision', r='recall')} >= 0.95) AS fields_pass FROM fs WHERE field IN ('invoice_number', 'invoice_date', 'total')) SELECT fields_pass, critical_rate >= 0.90 AS rate_pass, fields_pass AND critical_rate >= 0.90 AS passed FROM g, ov",
)
def release_gate(spark, sf_dir):
    o = _compared(spark, sf_dir)
    fields = evaluate.field_prf(o)
    return evaluate.gate(fields, evaluate.overall(fields, evaluate.documents(o, _lines(spark, sf_dir))))
