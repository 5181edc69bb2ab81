"""Invoices, master data and payloads as views of the order tables, in Spark and in SQL."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import voucher


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def invoice_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line as an invoice line; even orders split the tax in two, odd ones carry it whole."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax")
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    tax = (price * F.col("l_tax").cast("decimal(6,2)")).cast("decimal(24,4)")
    half = (tax * F.lit(Decimal("0.5"))).cast("decimal(28,10)")
    none = F.lit(0).cast("decimal(28,10)")
    even = F.col("l_orderkey") % 2 == 0
    return rows.select(
        F.col("l_orderkey").alias("invoice_id"), "l_partkey", "l_suppkey", F.col("l_linenumber").alias("line_no"), F.col("l_quantity").alias("quantity"), price.alias("taxable_value"),
        F.when(even, half).otherwise(none).alias("cgst_amount"), F.when(even, half).otherwise(none).alias("sgst_amount"), F.when(even, none).otherwise(tax.cast("decimal(28,10)")).alias("igst_amount"),
        tax.alias("tax_amount"), (price + tax).cast("decimal(24,4)").alias("total_price"),
    )


def _off(order: Column) -> Column:
    out = F.lit(Decimal("0.00"))
    for n, amount in ((1, "0.25"), (2, "-0.25"), (3, "1.00"), (4, "1.50")):
        out = F.when(order % 7 == n, F.lit(Decimal(amount))).otherwise(out)
    return out.cast("decimal(20,2)")


#: Columns of invoices.
INVOICE = ["invoice_id", "invoice_number", "invoice_date", "buyer", "seller", "invoice_type", "subtotal", "tax", "total", "o_orderpriority"]


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One invoice per order; its total is off by an amount that the order number sets."""
    return summed_invoices(spark, sf_dir).select(*INVOICE)


def summed_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """invoices with the sums of their lines that voucher.amounts takes, from one pass over the lines."""
    return described(bare_invoices(spark, sf_dir)).select(*INVOICE, *SUMS)


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("buyer"))


#: Sums of an invoice's lines.
SUMS = ["__t", "__c", "__s", "__i"]


def bare_invoices(spark: SparkSession, sf_dir: str, buyers: DataFrame | None = None) -> DataFrame:
    """summed_invoices without what `described` adds, which need not be moved. buyers: c_custkey, buyer and what more invoices get (None: customers)."""
    buyers = customers(spark, sf_dir) if buyers is None else buyers
    sums = voucher.line_sums(
        invoice_lines(spark, sf_dir), gross=F.sum("total_price").cast("decimal(28,4)"), net=F.sum("taxable_value").cast("decimal(28,2)"),
        s_suppkey=F.min("l_suppkey"),
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("invoice_id"), F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").cast("date").alias("invoice_date"),
        "o_orderpriority",
    )
    # buyers first, while rows are few columns
    rows = orders.join(buyers, "c_custkey", "left").join(sums, "invoice_id", "left")
    rows = rows.join(table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("seller")), "s_suppkey", "left")
    return rows.select("invoice_id", "invoice_date", *(c for c in buyers.columns if c != "c_custkey"), "seller", "gross", "net", "o_orderpriority", *SUMS)


def described(rows: DataFrame) -> DataFrame:
    """bare_invoices with number, type and amounts."""
    zero = F.lit(0).cast("decimal(28,4)")
    gross, net = F.bround(F.coalesce("gross", zero), 2).cast("decimal(20,2)"), F.coalesce(F.col("net"), F.lit(0)).cast("decimal(20,2)")
    kinds = F.array(*(F.lit(k) for k in ("tax_invoice", "credit_note", "debit_note", "proforma_invoice", "receipt")))
    return rows.select(
        *(c for c in rows.columns if c not in ("gross", "net")), F.col("invoice_id").cast("string").alias("invoice_number"),
        F.element_at(kinds, (F.col("invoice_id") % 5 + 1).cast("int")).alias("invoice_type"), net.alias("subtotal"), (gross - net).cast("decimal(20,2)").alias("tax"),
        (gross + _off(F.col("invoice_id"))).cast("decimal(20,2)").alias("total"),
    )


#: The same views in DuckDB's SQL, as CTEs.
SQL = """
il AS (
  SELECT l_orderkey AS invoice_id, l_partkey, l_suppkey, l_linenumber AS line_no, l_quantity AS quantity, price AS taxable_value,
    CASE WHEN l_orderkey % 2 = 0 THEN CAST(tax * 0.5 AS DECIMAL(28,10)) ELSE 0 END AS cgst_amount,
    CASE WHEN l_orderkey % 2 = 0 THEN CAST(tax * 0.5 AS DECIMAL(28,10)) ELSE 0 END AS sgst_amount,
    CASE WHEN l_orderkey % 2 = 0 THEN 0 ELSE CAST(tax AS DECIMAL(28,10)) END AS igst_amount,
    tax AS tax_amount, CAST(price + tax AS DECIMAL(24,4)) AS total_price
  FROM (SELECT *, CAST(price * CAST(l_tax AS DECIMAL(6,2)) AS DECIMAL(24,4)) AS tax FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(18,2)) AS price FROM lineitem))
), sums AS (
  SELECT invoice_id, CAST(sum(total_price) AS DECIMAL(28,4)) AS gross, CAST(sum(taxable_value) AS DECIMAL(28,2)) AS net, min(l_suppkey) AS s_suppkey FROM il GROUP BY invoice_id
), inv AS (
  SELECT o_orderkey AS invoice_id, CAST(o_orderkey AS VARCHAR) AS invoice_number, CAST(o_orderdate AS DATE) AS invoice_date, c_name AS buyer, s_name AS seller,
    CASE o_orderkey % 5 WHEN 0 THEN 'tax_invoice' WHEN 1 THEN 'credit_note' WHEN 2 THEN 'debit_note' WHEN 3 THEN 'proforma_invoice' ELSE 'receipt' END AS invoice_type,
    CAST(coalesce(net, 0) AS DECIMAL(20,2)) AS subtotal, CAST(round_even(coalesce(gross, 0), 2) AS DECIMAL(20,2)) - CAST(coalesce(net, 0) AS DECIMAL(20,2)) AS tax,
    CAST(round_even(coalesce(gross, 0), 2) AS DECIMAL(20,2)) + CAST(CASE o_orderkey % 7 WHEN 1 THEN 0.25 WHEN 2 THEN -0.25 WHEN 3 THEN 1.00 WHEN 4 THEN 1.50 ELSE 0 END AS DECIMAL(20,2)) AS total, o_orderpriority
  FROM orders LEFT JOIN sums ON sums.invoice_id = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN supplier USING (s_suppkey)
)"""

#: Amounts of each voucher, after SQL.
AMOUNTS_SQL = """
am AS (
  SELECT inv.*, coalesce(s.t, 0) AS t, coalesce(s.c, 0) AS c, coalesce(s.s, 0) AS s, CASE WHEN coalesce(s.c, 0) <> 0 OR coalesce(s.s, 0) <> 0 OR coalesce(s.i, 0) <> 0 THEN s.i ELSE CAST(inv.tax AS DECIMAL(28,10)) END AS i
  FROM inv LEFT JOIN (SELECT invoice_id, CAST(sum(CAST(taxable_value AS DECIMAL(28,10))) AS DECIMAL(28,10)) AS t, CAST(sum(cgst_amount) AS DECIMAL(28,10)) AS c, CAST(sum(sgst_amount) AS DECIMAL(28,10)) AS s, CAST(sum(igst_amount) AS DECIMAL(28,10)) AS i FROM il GROUP BY invoice_id) s USING (invoice_id)
), v AS (
  SELECT *, CAST(round_even(t, 2) AS DECIMAL(20,2)) AS taxable, CAST(round_even(c, 2) AS DECIMAL(20,2)) AS cgst, CAST(round_even(s, 2) AS DECIMAL(20,2)) AS sgst, CAST(round_even(i, 2) AS DECIMAL(20,2)) AS igst,
    CAST(round_even(CAST(total AS DECIMAL(28,10)) - t - c - s - i, 2) AS DECIMAL(20,2)) AS round_off FROM am
), e AS (
  SELECT *, total + CASE WHEN round_off < 0 THEN -round_off ELSE 0 END AS debit,
    taxable + greatest(cgst, 0) + greatest(sgst, 0) + greatest(igst, 0) + CASE WHEN round_off > 0 THEN round_off ELSE 0 END AS credit FROM v
), w AS (SELECT *, CASE WHEN abs(round_off) > 1.00 THEN 'ROUND_OFF_LIMIT' WHEN debit <> credit THEN 'UNBALANCED' END AS error FROM e)"""


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as parties, suppliers as ledgers, parts as stock items; parts share names."""
    spaced = lambda c: F.regexp_replace(c, "#0*", " ")
    c = table(spark, sf_dir, "customer").select(
        F.lit("party").alias("entity_type"), F.col("c_custkey").alias("pos"), F.col("c_name").alias("name"),
        F.concat(F.lit("C"), "c_custkey").alias("code"), F.array(spaced(F.col("c_name"))).alias("aliases"),
    )
    s = table(spark, sf_dir, "supplier").select(
        F.lit("ledger").alias("entity_type"), F.col("s_suppkey").alias("pos"), F.col("s_name").alias("name"),
        F.concat(F.lit("S"), "s_suppkey").alias("code"), F.array(spaced(F.col("s_name"))).alias("aliases"),
    )
    p = table(spark, sf_dir, "part").select(
        F.lit("stock_item").alias("entity_type"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"),
        F.concat(F.lit("P"), "p_partkey").alias("code"), F.array(F.concat("p_name", F.lit(" "), "p_brand")).alias("aliases"),
    )
    return c.unionByName(s).unionByName(p)


MASTER_SQL = """
master AS (
  SELECT 'party' AS entity_type, c_custkey AS pos, c_name AS name, 'C' || c_custkey AS code, regexp_replace(c_name, '#0*', ' ') AS alias FROM customer
  UNION ALL SELECT 'ledger', s_suppkey, s_name, 'S' || s_suppkey, regexp_replace(s_name, '#0*', ' ') FROM supplier
  UNION ALL SELECT 'stock_item', p_partkey, p_name, 'P' || p_partkey, p_name || ' ' || p_brand FROM part
), mname AS (SELECT entity_type, lower(name) AS key, arg_min(name, pos) AS name, arg_min(code, pos) AS code FROM master GROUP BY ALL
), mcode AS (SELECT entity_type, lower(code) AS key, arg_min(name, pos) AS name, arg_min(code, pos) AS code FROM master GROUP BY ALL
), malias AS (SELECT entity_type, lower(trim(alias)) AS key, arg_min(name, pos) AS name, arg_min(code, pos) AS code FROM master GROUP BY ALL
)"""

RULES = (
    ("global", None, "party", "walk-in", "Customer#000000001"), ("global", None, "ledger", "main", "S1"), ("tenant", "t1", "party", "walk-in", "Customer#000000002"),
    ("db", "t1", "party", "walk-in", "C3"), ("tenant", "t2", "ledger", "main", "No such ledger"), ("tenant", "t1", "stock_item", "misc", "P5"), ("global", None, "stock_item", "misc", " "),
)


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES), "scope string, tenant_id string, entity_type string, key string, target string")


RULES_SQL = "rules(scope, tenant_id, entity_type, key, target) AS (VALUES " + ", ".join(
    "(" + ", ".join("NULL" if x is None else f"'{x}'" for x in r) + ")" for r in RULES
) + ")"


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name to resolve for every order, written in ways that only certain steps can resolve."""
    n = F.col("o_orderkey") % 9
    kind = F.when(F.col("o_orderkey") % 3 == 0, "party").when(F.col("o_orderkey") % 3 == 1, "ledger").otherwise("stock_item")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = orders.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey", "left")
    value = (
        F.when(
            n == 0, F.concat(F.lit("  "), F.upper("c_name"), F.lit(" ")),
        ).when(n == 1, "main").when(n == 2, F.lit("misc")).when(n == 3, F.concat(F.lit("c"), F.col("o_custkey")))
        .when(n == 4, F.lit("   ")).when(n == 5, F.concat(F.lit("p"), F.col("o_custkey"))).when(n == 6, F.regexp_replace("c_name", "#0*", " ")).when(n == 7, F.lit(None).cast("string")).otherwise(F.concat(F.lit("Unknown "), F.col("o_custkey")))
    )
    value = F.when((F.col("o_orderkey") % 45) == 18, "walk-in").otherwise(value)
    return rows.select(
        F.col("o_orderkey").alias("invoice_id"),
        F.concat(F.lit("t"), F.col("o_orderkey") % 3 + F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(0)).alias("tenant_id"),
        kind.alias("entity_type"), value.alias("value"),
    )


ENTITIES_SQL = """
ent AS (
  SELECT o_orderkey AS invoice_id, 't' || (o_orderkey % 3 + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END) AS tenant_id,
    CASE o_orderkey % 3 WHEN 0 THEN 'party' WHEN 1 THEN 'ledger' ELSE 'stock_item' END AS entity_type,
    CASE WHEN o_orderkey % 45 = 18 THEN 'walk-in' ELSE CASE o_orderkey % 9 WHEN 0 THEN '  ' || upper(c_name) || ' ' WHEN 1 THEN 'main' WHEN 2 THEN 'misc' WHEN 3 THEN 'c' || o_custkey WHEN 4 THEN '   '
      WHEN 5 THEN 'p' || o_custkey WHEN 6 THEN regexp_replace(c_name, '#0*', ' ') WHEN 7 THEN NULL ELSE 'Unknown ' || o_custkey END END AS value
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey
), k AS (SELECT *, lower(trim(coalesce(value, ''))) AS key FROM ent
), rt AS (
  SELECT CASE WHEN scope <> 'global' THEN tenant_id END AS tenant_id, entity_type, key, arg_min(trim(target), CASE scope WHEN 'db' THEN 1 WHEN 'tenant' THEN 2 ELSE 3 END) AS target
  FROM rules WHERE trim(target) <> '' GROUP BY ALL
), r AS (
  SELECT k.*, coalesce(o.target, g.target) AS rule_target FROM k
  LEFT JOIN rt o ON o.tenant_id = k.tenant_id AND o.entity_type = k.entity_type AND o.key = k.key
  LEFT JOIN rt g ON g.tenant_id IS NULL AND g.entity_type = k.entity_type AND g.key = k.key
), res AS (
  SELECT r.*, CASE WHEN r.key = '' THEN 'unresolved' WHEN coalesce(rn.name, rc.name) IS NOT NULL THEN 'rule' WHEN coalesce(n.name, c.name) IS NOT NULL THEN 'exact' WHEN a.name IS NOT NULL THEN 'alias'
      WHEN r.entity_type = 'ledger' THEN 'created' ELSE 'unresolved' END AS source,
    CASE WHEN r.key <> '' THEN coalesce(rn.name, rc.name, n.name, c.name, a.name, CASE WHEN r.entity_type = 'ledger' THEN trim(r.value) END) END AS resolved_name,
    CASE WHEN r.key <> '' THEN coalesce(rn.code, rc.code, n.code, c.code, a.code) END AS resolved_code,
    CASE WHEN r.key = '' THEN 'MISSING_EXTRACTED_VALUE' WHEN coalesce(rn.name, rc.name, n.name, c.name, a.name) IS NULL THEN 'MASTER_MAPPING_NOT_FOUND' END AS issue
  FROM r LEFT JOIN mname rn ON rn.entity_type = r.entity_type AND rn.key = lower(r.rule_target) LEFT JOIN mcode rc ON rc.entity_type = r.entity_type AND rc.key = lower(r.rule_target)
  LEFT JOIN mname n ON n.entity_type = r.entity_type AND n.key = r.key LEFT JOIN mcode c ON c.entity_type = r.entity_type AND c.key = r.key LEFT JOIN malias a ON a.entity_type = r.entity_type AND a.key = r.key
)"""
