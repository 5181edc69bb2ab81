"""Registered queries: field normalisers, schema violations, checks and confidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, numbers, text
from ..functions import variants as v
from ..operators import checks, normalize
from ..sources import shared
from . import bindings as b
from .catalog import query


@query("parse_amounts", r"""
SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 6 WHEN 0 THEN price WHEN 1 THEN price WHEN 2 THEN TRY_CAST('.' || price AS DOUBLE) WHEN 3 THEN price WHEN 4 THEN NULL ELSE -price END AS amount
FROM (SELECT *, CAST(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS BIGINT) AS DOUBLE) AS price FROM lineitem) WHERE l_linenumber % 6 <> 2
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, TRY_CAST('.' || CAST(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS BIGINT) AS VARCHAR) AS DOUBLE) FROM lineitem WHERE l_linenumber % 6 = 2""")
def parse_amounts(spark, sf_dir):
    n = F.col("l_linenumber") % 6
    whole = F.round(F.col("l_extendedprice").cast("decimal(18,2)"), 0).cast("bigint").cast("string")
    raw = F.when(n == 0, F.concat(F.lit("₹"), whole)).when(n == 1, F.concat(F.lit(" $ "), whole, F.lit(".00 "))).when(n == 2, F.concat(F.lit("Rs. "), whole)).when(n == 3, F.concat(F.lit("("), whole, F.lit(")"))).when(n == 4, F.concat(whole, F.lit("-"))).otherwise(F.concat(F.lit("-"), whole, F.lit(" INR")))
    return b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", numbers.parse_number(text.strip(raw)).alias("amount"))


def _written(day):
    """A date in one of eleven forms, by order."""
    n = F.col("o_orderkey") % 11
    forms = ("yyyy-MM-dd", "dd-MM-yyyy", "d/M/yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "yyyy/M/d")
    out = F.when(n == 8, F.lit("soon")).when(n == 9, F.lit("2024-13-45")).otherwise(F.lit(None).cast("string"))
    for i, f in enumerate(forms):
        out = F.when(n == i, F.concat(F.lit("  " if i == 3 else ""), F.date_format(day, f).alias("d"))).otherwise(out)
    return out


def _dated(spark, sf_dir):
    return b.table(spark, sf_dir, "orders").select("o_orderkey", _written(F.col("o_orderdate").cast("date")).alias("raw"))


@query("parse_dates_flat", """
SELECT o_orderkey, CASE o_orderkey % 11 WHEN 7 THEN year(d) || '/' || month(d) || '/' || day(d) WHEN 8 THEN 'soon' WHEN 9 THEN '2024-13-45' WHEN 10 THEN '' ELSE strftime(d, '%Y-%m-%d') END AS iso, o_orderkey % 11 < 7 AS confident
FROM (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def parse_dates_flat(spark, sf_dir):
    iso, confident, _ = dates.flat_date(F.col("raw"))
    return _dated(spark, sf_dir).select("o_orderkey", iso.alias("iso"), confident.alias("confident"))


@query("parse_dates_v2", """
SELECT o_orderkey, CASE WHEN o_orderkey % 11 IN (8, 10) THEN NULL WHEN o_orderkey % 11 = 9 THEN '2024-13-45' ELSE strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') END AS iso FROM orders""")
def parse_dates_v2(spark, sf_dir):
    return _dated(spark, sf_dir).select("o_orderkey", dates.v2_date(F.col("raw")).alias("iso"))


@query("voucher_date", """
SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN strftime(CAST(o_orderdate AS DATE), '%Y%m%d') END AS day, o_orderkey % 11 <> 0 AS failed FROM orders""")
def voucher_date(spark, sf_dir):
    day = dates.voucher_date(F.col("raw"))
    return _dated(spark, sf_dir).select("o_orderkey", day.alias("day"), day.isNull().alias("failed"))


@query("currency_normalise", """
SELECT n_nationkey, CASE n_nationkey % 9 WHEN 0 THEN 'USD' WHEN 1 THEN 'USD' WHEN 2 THEN 'INR' WHEN 3 THEN 'AUD' WHEN 4 THEN 'INR' WHEN 5 THEN 'US$' WHEN 6 THEN '' WHEN 7 THEN 'CAD' ELSE upper(n_name) END AS code,
  CASE n_nationkey % 9 WHEN 5 THEN false WHEN 6 THEN false WHEN 8 THEN length(n_name) = 3 ELSE true END AS confident,
  CASE n_nationkey % 9 WHEN 1 THEN 'CURRENCY_READ: $100, USD' WHEN 3 THEN 'CURRENCY_READ: A$5, AUD' WHEN 5 THEN 'CURRENCY_UNKNOWN: US$' WHEN 6 THEN 'CURRENCY_MISSING'
    WHEN 8 THEN CASE WHEN length(n_name) = 3 THEN NULL ELSE 'CURRENCY_UNKNOWN: ' || n_name END END AS warning FROM nation""")
def currency_normalise(spark, sf_dir):
    n = F.col("n_nationkey") % 9
    raw = F.col("n_name")
    for i, x in enumerate(("$", "$100", "₹", "A$5", " inr ", "US$", None, "C$")):
        raw = F.when(n == i, F.lit(x)).otherwise(raw)
    code, confident, warning = normalize.currency(raw)
    return b.table(spark, sf_dir, "nation").select("n_nationkey", code.alias("code"), confident.alias("confident"), warning.alias("warning"))


@query("tax_alias_pick", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN n = 0 OR n = 3 OR n = 4 THEN 0.0 ELSE q END AS tax, n IN (1, 2, 5) AS confident,
  CASE n WHEN 0 THEN 'TAX_NOT_A_NUMBER: tax' WHEN 1 THEN 'TAX_TAKEN_FROM: taxes' WHEN 3 THEN 'TAX_MISSING' WHEN 4 THEN 'TAX_NOT_A_NUMBER: vat' WHEN 5 THEN 'TAX_TAKEN_FROM: gst_amount' END AS warning
FROM (SELECT *, CAST(CAST(l_quantity AS BIGINT) AS DOUBLE) AS q, l_linenumber % 6 AS n FROM lineitem)""")
def tax_alias_pick(spark, sf_dir):
    n, q = F.col("l_linenumber") % 6, F.round("l_quantity", 0).cast("bigint").cast("string")
    forms = (
        ('{"tax": null, "gst": ', "}"), ('{"taxes": ', "}"), ('{"vat": 1, "tax": ', "}"), ('{"other": ', "}"), ('{"vat": ["', '"]}'),
        ('{"vat": null, "gst_amount": "', ' INR"}'),
    )
    raw = F.lit(None).cast("string")
    for i, (a, z) in enumerate(forms):
        raw = F.when(n == i, F.concat(F.lit(a), q, F.lit(z))).otherwise(raw)
    amount, confident, warning = normalize.tax(v.parse_json(raw))
    return b.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", amount.alias("tax"), confident.alias("confident"), warning.alias("warning"),
    )


@query("entity_flatten", """
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_name || ' | ' || n_name WHEN 1 THEN c_name WHEN 2 THEN c_name || ' | None | G' || c_custkey WHEN 3 THEN '' ELSE c_name || ' | G' || c_custkey END AS party FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def entity_flatten(spark, sf_dir):
    rows = b.table(spark, sf_dir, "customer").join(b.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    n = F.col("c_custkey") % 5
    raw = F.when(n == 0, F.to_json(F.struct(F.concat(F.lit(" "), "c_name").alias("name"), F.col("n_name").alias("address")))).when(n == 1, F.concat(F.lit('"'), "c_name", F.lit('  "'))).when(
        n == 2, F.concat(F.lit('{"name": "'), "c_name", F.lit('", "address": null, "gst_number": "G'), "c_custkey", F.lit('"}')),
    ).when(n == 3, "[1]").otherwise(F.concat(F.lit('{"name": "'), "c_name", F.lit('", "address": " ", "gst_number": "G'), "c_custkey", F.lit('"}')))
    return rows.select("c_custkey", normalize.entity(v.parse_json(raw)).alias("party"))


def _payloads(spark, sf_dir):
    """Payloads of all invoices as JSON text; a fault in each that the order number sets (see the SQL beside each query)."""
    lines = b.invoice_lines(spark, sf_dir)
    item = F.struct(
        F.concat(F.lit(" part "), "l_partkey", F.lit(" ")).alias("description"),
        F.round("quantity", 0).cast("bigint").cast("string").alias("quantity"), F.when(F.col("line_no") != 2, F.lit(2)).alias("unit_price"),
        F.when(F.col("line_no") != 3, F.col("taxable_value")).alias("total_price"),
    )
    grouped = lines.groupBy("invoice_id").agg(
        F.array_sort(
            F.collect_list(F.struct("line_no", "l_partkey", "l_suppkey", "taxable_value", "quantity", "tax_amount", item.alias("item")))
        ).alias("ls")
    )
    return shared.dealt(b.invoices(spark, sf_dir).join(grouped, "invoice_id", "left"), "invoice_id").withColumn(
        "items",
        F.coalesce(
            F.transform("ls", lambda x: x["item"]),
            F.array().cast("array<struct<description:string,quantity:string,unit_price:int,total_price:decimal(18,2)>>"),
        ),
    )


@query("line_item_normalise", f"""WITH {b.SQL}, q AS (
  SELECT *, CAST(CAST(quantity AS BIGINT) AS DOUBLE) AS n, CAST(CASE WHEN line_no <> 2 THEN 2 ELSE 0 END AS DOUBLE) AS p FROM il)
SELECT invoice_id, 'part ' || l_partkey AS description, n AS quantity, p AS unit_price, CASE WHEN line_no <> 3 THEN CAST(taxable_value AS DOUBLE) ELSE n * p END AS total_price FROM q""")
def line_item_normalise(spark, sf_dir):
    rows = _payloads(spark, sf_dir).withColumn("payload", v.parse_json(F.to_json(F.struct(F.col("items").alias("line_items")))))
    return rows.select("invoice_id", F.inline(normalize.flat_items(F.col("payload"))))


@query("flat_profile", f"""WITH {b.SQL}, l AS (
  SELECT invoice_id, count(*) AS c, bool_and(line_no NOT IN (2, 3)) AS priced,
    string_agg(CASE line_no WHEN 2 THEN 'UNIT_PRICE_NOT_A_NUMBER: ' || pos WHEN 3 THEN 'TOTAL_PRICE_COMPUTED: ' || pos || ', ' || CAST(CAST(CAST(quantity AS BIGINT) * 2 AS DECIMAL(18,2)) AS VARCHAR) END, '; ' ORDER BY pos) AS notes
  FROM (
    SELECT *, row_number() OVER (PARTITION BY invoice_id ORDER BY line_no) AS pos
    FROM (SELECT *, row_number() OVER (PARTITION BY invoice_id ORDER BY line_no, l_partkey, l_suppkey) AS i FROM il) WHERE i = line_no
  ) GROUP BY invoice_id
), q AS (SELECT inv.*, inv.invoice_id % 6 AS n, coalesce(c, 0) AS c, coalesce(priced, true) AS priced, l.notes FROM inv LEFT JOIN l USING (invoice_id))
SELECT invoice_id, n = 5 AS bad,
  CASE n WHEN 5 THEN NULL ELSE concat_ws('; ', CASE n WHEN 1 THEN 'DATE_NOT_READ: soon' END, CASE n WHEN 0 THEN 'CURRENCY_MISSING' WHEN 2 THEN 'CURRENCY_READ: $ 5, USD' END, CASE n WHEN 3 THEN 'SUBTOTAL_NOT_A_NUMBER' END,
    CASE n WHEN 4 THEN 'TAX_MISSING' ELSE 'TAX_TAKEN_FROM: taxes' END, CASE n WHEN 0 THEN 'TOTAL_NOT_A_NUMBER' END, CASE WHEN n = 4 THEN 'LINES_NOT_A_LIST' ELSE notes END) END AS warnings,
  CASE n WHEN 5 THEN NULL ELSE concat_ws(';', 'currency_confident=' || (n <> 0), 'invoice_date_confident=' || (n <> 1), CASE WHEN n <> 4 THEN 'line_item_pricing_confident=' || priced END, CASE WHEN n <> 4 THEN 'line_item_quantity_confident=true' END,
    'line_items_present=' || (n <> 4 AND c > 0), 'tax_confident=' || (n <> 4)) END AS flags,
  CASE WHEN n NOT IN (0, 5) THEN CAST(total AS DOUBLE) WHEN n = 0 THEN 0.0 END AS total
FROM q""")
def flat_profile(spark, sf_dir):
    """Warnings, flags and faults of whole payloads: a bad date, no currency, texts for amounts, no tax, no list of lines, no object."""
    n = F.col("invoice_id") % 6
    lines = F.transform(F.filter("ls", lambda x, i: x["line_no"] == i + 1), lambda x: x["item"])
    doc = F.to_json(F.struct(
        "invoice_number", F.when(n == 1, "soon").otherwise(F.date_format("invoice_date", "yyyy-MM-dd")).alias("invoice_date"), F.when(n == 0, "").when(n == 2, "$ 5").otherwise("INR").alias("currency"),
        F.when(n == 3, "none").otherwise(F.col("subtotal").cast("string")).alias("subtotal"), F.when(n != 4, F.col("tax")).alias("taxes"), F.when(n == 0, "?").otherwise(F.col("total").cast("string")).alias("total"),
        F.when(
            n != 4, F.coalesce(lines, F.array().cast("array<struct<description:string,quantity:string,unit_price:int,total_price:decimal(18,2)>>")),
        ).alias("line_items"),
    ))
    rows = _payloads(spark, sf_dir).select("invoice_id", v.parse_json(F.when(n == 5, "[1]").otherwise(doc)).alias("payload"))
    i = normalize.normalize_flat(rows)
    flags = F.array_join(F.transform(F.array_sort(F.map_entries("flags")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
    return i.select(
        "invoice_id", F.col("error").isNotNull().alias("bad"), F.array_join("warnings", "; ").alias("warnings"), flags.alias("flags"),
        F.col("invoice.total").alias("total"),
    )


_V2 = """WITH {sql}, q AS (SELECT *, invoice_id % 4 AS n FROM inv)
SELECT q.invoice_id, CASE WHEN n = 3 THEN 'UNKNOWN' ELSE invoice_number END AS invoice_number, strftime(invoice_date, '%Y-%m-%d') AS invoice_date, CASE WHEN n = 0 THEN buyer ELSE 'Unknown' END AS buyer, CASE WHEN n = 0 THEN NULL ELSE 'L' || q.invoice_id END AS line1,
  CASE n WHEN 0 THEN true WHEN 1 THEN false END AS reverse_charge, 'INR' AS currency, greatest(coalesce(c, 0), 1) AS n_lines,
  CASE WHEN n = 2 THEN round(coalesce(s, 0), 2) ELSE CAST(subtotal AS DOUBLE) END AS subtotal, CAST(tax AS DOUBLE) AS tax, round(CASE WHEN n = 2 THEN coalesce(s, 0) ELSE CAST(subtotal AS DOUBLE) END + CAST(tax AS DOUBLE), 2) AS total
FROM q LEFT JOIN (SELECT invoice_id, count(*) AS c, CAST(sum(CASE WHEN line_no <> 3 THEN taxable_value ELSE CAST(CAST(quantity AS BIGINT) * 2 AS DECIMAL(18,2)) END) AS DOUBLE) AS s FROM il GROUP BY invoice_id) l ON l.invoice_id = q.invoice_id"""


@query("v2_normalise", _V2.format(sql=b.SQL))
def v2_normalise(spark, sf_dir):
    n = F.col("invoice_id") % 4
    party = F.when(
        n == 0, F.to_json(F.struct(F.struct(F.col("buyer").alias("name"), F.struct(F.lit(" ").alias("line1")).alias("address")).alias("buyer"))),
    ).otherwise(F.to_json(F.struct(F.struct(F.concat(F.lit("L"), "invoice_id").alias("addr"), F.lit("").alias("gstin")).alias("buyer"))))
    head = F.to_json(F.struct(
        F.when(n != 3, F.col("invoice_number")).alias("invoice_number"), F.date_format("invoice_date", "dd-MM-yyyy").alias("invoice_date"), F.element_at(
            F.array(F.lit("Yes"), F.lit(" NA "), F.lit("maybe"), F.lit("")), (n + 1).cast("int"),
        ).alias("reverse_charge"),
        F.when(n != 2, F.col("subtotal")).alias("subtotal"), F.col("tax").alias("taxes"), F.col("items").alias("line_items"),
    ))
    rows = _payloads(spark, sf_dir).select(
        "invoice_id", v.parse_json(F.concat(F.regexp_replace(party, r"\}$", ","), F.regexp_replace(head, r"^\{", ""))).alias("payload"),
    )
    i = normalize.normalize_v2(rows)
    return i.select(
        "invoice_id", "invoice.invoice_number", "invoice.invoice_date", F.col("invoice.buyer.name").alias("buyer"),
        F.col("invoice.buyer.address.line1").alias("line1"), "invoice.reverse_charge", "invoice.currency",
        F.size("invoice.line_items").cast("bigint").alias("n_lines"), F.round("invoice.subtotal", 2).alias("subtotal"), "invoice.tax",
        F.round("invoice.total", 2).alias("total"),
    )


@query(
    "reverse_charge_bool",
    "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN false END AS reverse_charge FROM orders",
)
def reverse_charge_bool(spark, sf_dir):
    words = ('" Applicable "', "true", '"Not Applicable"', "0", '"perhaps"', "null")
    raw = F.element_at(F.array(*map(F.lit, words)), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return b.table(spark, sf_dir, "orders").select("o_orderkey", normalize.boolean(v.parse_json(raw)).alias("reverse_charge"))


def _v2_payloads(spark, sf_dir):
    """A v2 document for every invoice, with one fault by order number; those without lines lack items and a seller's name."""
    n = F.col("invoice_id") % 9
    place = F.struct(*(F.lit(None).cast("string").alias(a) for a in checks.ADDRESS))
    side = lambda name, tin: F.struct(F.col(name).alias("name"), tin.alias("gstin"), F.lit("").alias("pan"), place.alias("address"))
    items = F.transform(
        "ls",
        lambda x: F.struct(
            F.lit("Part").alias("description"), x["quantity"].cast("double").alias("quantity"), F.lit(1.0).alias("unit_price"),
            x["taxable_value"].alias("total_price"),
        ),
    )
    items = F.coalesce(items, F.array().cast("array<struct<description:string,quantity:double,unit_price:double,total_price:decimal(18,2)>>"))
    doc = F.to_json(F.struct(
        F.when(n == 1, "1.0").otherwise("2.0").alias("schema_version"), F.when(n == 2, "").otherwise(F.col("invoice_number")).alias("invoice_number"), F.when(n == 3, "bill").otherwise(F.col("invoice_type")).alias("invoice_type"),
        F.when(n == 4, F.date_format("invoice_date", "dd-MM-yyyy")).otherwise(F.date_format("invoice_date", "yyyy-MM-dd")).alias("invoice_date"), side("seller", F.when(n == 5, "X").otherwise("")).alias("seller"), side("buyer", F.lit("22AAAAA0000A1Z5")).alias("buyer"),
        F.when(n != 6, F.lit("INR")).alias("currency"), items.alias("line_items"), "subtotal", "tax", "total",
    ), {"ignoreNullFields": "false"})
    doc = F.when(n == 7, F.regexp_replace(doc, r"^\{", '{"extra": 1,')).when(n == 8, F.regexp_replace(doc, r'"quantity":[0-9.]+', '"quantity":true')).otherwise(doc)
    return _payloads(spark, sf_dir).select("invoice_id", "subtotal", "tax", "total", v.parse_json(doc).alias("payload"))


@query("schema_violations", f"""WITH {b.SQL}, i AS (SELECT inv.invoice_id, invoice_id % 9 AS n, coalesce(c, 0) AS c, seller FROM inv LEFT JOIN (SELECT invoice_id, count(*) AS c FROM il GROUP BY invoice_id) USING (invoice_id))
SELECT 'schema_version' AS path, 'const' AS keyword, count(*) AS n FROM i WHERE n = 1 UNION ALL SELECT 'invoice_number', 'minLength', count(*) FROM i WHERE n = 2 UNION ALL SELECT 'invoice_type', 'enum', count(*) FROM i WHERE n = 3
UNION ALL SELECT 'invoice_date', 'pattern', count(*) FROM i WHERE n = 4 UNION ALL SELECT 'seller.gstin', 'pattern', count(*) FROM i WHERE n = 5 UNION ALL SELECT 'currency', 'type', count(*) FROM i WHERE n = 6
UNION ALL SELECT 'invoice', 'additionalProperties', count(*) FROM i WHERE n = 7 UNION ALL SELECT 'line_items[].quantity', 'type', CAST(sum(c) AS BIGINT) FROM i WHERE n = 8
UNION ALL SELECT 'line_items', 'minItems', count(*) FROM i WHERE c = 0 HAVING count(*) > 0 UNION ALL SELECT 'seller.name', 'type', count(*) FROM i WHERE seller IS NULL HAVING count(*) > 0""")
def schema_violations(spark, sf_dir):
    found = _v2_payloads(spark, sf_dir).select("invoice_id", F.inline(checks.violations(F.col("payload"))))
    return found.groupBy(F.regexp_replace("path", r"\[[0-9]+\]", "[]").alias("path"), "keyword").agg(F.count("*").alias("n"))


@query("party_violations", f"""WITH {b.SQL}, i AS (SELECT invoice_id % 4 AS n FROM inv)
SELECT 'seller.pan' AS path, 'pattern' AS keyword, count(*) AS n FROM i WHERE n = 1 UNION ALL SELECT 'seller', 'additionalProperties', count(*) FROM i WHERE n = 2
UNION ALL SELECT 'seller.address', 'additionalProperties', count(*) FROM i WHERE n = 3""")
def party_violations(spark, sf_dir):
    """Parties and addresses take no other members, and a PAN has its shape."""
    n = F.col("invoice_id") % 4
    place = F.struct(*(F.lit(None).cast("string").alias(a) for a in checks.ADDRESS))
    seller = F.struct(F.lit("S").alias("name"), F.lit("").alias("gstin"), F.when(n == 1, "12345").otherwise("").alias("pan"), place.alias("address"))
    doc = F.to_json(F.struct(seller.alias("seller")), {"ignoreNullFields": "false"})
    doc = F.when(n == 2, F.replace(doc, F.lit('"pan"'), F.lit('"fax":1,"pan"'))).when(n == 3, F.replace(doc, F.lit('"address":{'), F.lit('"address":{"planet":"x",'))).otherwise(doc)
    rows = shared.dealt(b.invoices(spark, sf_dir).select("invoice_id"), "invoice_id").select(v.parse_json(doc).alias("payload"))
    found = rows.select(F.inline(checks.violations(F.col("payload")))).where(F.col("path").startswith("seller"))
    return found.groupBy("path", "keyword").agg(F.count("*").alias("n"))


@query("v2_transport", f"""WITH {b.SQL}, i AS (SELECT invoice_id, invoice_id % 3 AS n FROM inv)
SELECT invoice_id, CASE n WHEN 0 THEN 'Road' WHEN 1 THEN 'Rail' END AS transport_mode, CAST(NULL AS VARCHAR) AS transporter_name, CASE n WHEN 0 THEN 'V' || invoice_id END AS vehicle_number,
  CASE n WHEN 1 THEN 'L' || invoice_id END AS lr_number, CASE n WHEN 2 THEN 'E' || invoice_id END AS eway_bill_number FROM i""")
def v2_transport(spark, sf_dir):
    """Transport from its own object, from older fields beside it, and from these where the object is none."""
    n = F.col("invoice_id") % 3
    own = F.to_json(F.struct(F.struct(F.lit(" Road ").alias("transport_mode"), F.concat(F.lit("V"), "invoice_id").alias("vehicle_number")).alias("transport")))
    flat = F.to_json(F.struct(F.lit("Rail").alias("transport_mode"), F.concat(F.lit("L"), "invoice_id").alias("lr_number")))
    odd = F.to_json(F.struct(F.lit("by sea").alias("transport"), F.concat(F.lit("E"), "invoice_id").alias("eway_bill_number"), F.lit("").alias("transporter_name")))
    rows = shared.dealt(b.invoices(spark, sf_dir).select("invoice_id"), "invoice_id").select("invoice_id", v.parse_json(F.when(n == 0, own).when(n == 1, flat).otherwise(odd)).alias("payload"))
    return normalize.normalize_v2(rows).select("invoice_id", "invoice.transport.*")


@query("accounting_checks", f"""WITH {b.SQL}, l AS (SELECT invoice_id, CAST(sum(taxable_value) AS DECIMAL(20,2)) AS s FROM il WHERE line_no <> 1 OR invoice_id % 3 <> 0 GROUP BY invoice_id)
SELECT inv.invoice_id, abs(subtotal + tax - total) <= 0.05 AS header_ok, abs(coalesce(l.s, 0) - subtotal) <= 0.05 AS lines_ok, abs(subtotal + tax - total) > 0.05 OR abs(coalesce(l.s, 0) - subtotal) > 0.05 AS critical_failure FROM inv LEFT JOIN l USING (invoice_id)""")
def accounting_checks(spark, sf_dir):
    kept = F.filter("ls", lambda x: (x["line_no"] != 1) | (F.col("invoice_id") % 3 != 0))
    lines = F.coalesce(F.transform(kept, lambda x: F.struct(x["taxable_value"].cast("double").alias("total_price"))), F.array().cast("array<struct<total_price:double>>"))
    invoice = F.struct(*(F.col(c).cast("double").alias(c) for c in ("subtotal", "tax", "total")), lines.alias("line_items"))
    rows = _payloads(spark, sf_dir).select("invoice_id", invoice.alias("invoice"), F.lit(None).cast("struct<code:string,message:string>").alias("error"))
    return checks.report(rows).select("invoice_id", "accounting.header_ok", "accounting.lines_ok", "critical_failure")


@query("confidence_score", f"""WITH {b.SQL}, i AS (SELECT inv.*, invoice_id % 9 AS n, EXISTS (SELECT 1 FROM il WHERE il.invoice_id = inv.invoice_id) AS listed FROM inv),
c AS (
  SELECT invoice_id, (10 - CASE WHEN n IN (2, 6) THEN 1 ELSE 0 END - CASE WHEN listed THEN 0 ELSE 2 END) / 10.0 AS completeness,
    CASE WHEN n = 0 AND listed THEN 1.0 ELSE 0.0 END AS schema_valid, CASE WHEN abs(subtotal + tax - total) <= 0.05 THEN 1.0 ELSE 0.0 END AS accounting
  FROM i
)
SELECT invoice_id, CAST(completeness AS DOUBLE) AS completeness, CAST(schema_valid AS DOUBLE) AS schema_valid, CAST(accounting AS DOUBLE) AS accounting,
  CAST(round(CAST(0.5 * completeness + 0.25 * schema_valid + 0.25 * accounting AS DECIMAL(10,6)), 3) AS DOUBLE) AS overall
FROM c""")
def confidence_score(spark, sf_dir):
    rows = _v2_payloads(spark, sf_dir).select("invoice_id", checks.confidence(F.col("payload")).alias("c"))
    return rows.select("invoice_id", "c.completeness", "c.schema_valid", "c.accounting", "c.overall")


@query(
    "json_strict_parse",
    "SELECT event_id, event_id % 4 IN (0, 1) AS valid, CASE WHEN event_id % 4 IN (0, 1) THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events",
)
def json_strict_parse(spark, sf_dir):
    n = F.col("event_id") % 4
    raw = F.when(n == 0, F.col("props")).when(
        n == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```")),
    ).when(n == 2, F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.concat(F.lit("{"), "props"))
    data = v.parse_json(text.clean_model_output(raw))
    return b.table(spark, sf_dir, "events").select(
        "event_id", v.is_object(data).alias("valid"), F.when(v.is_object(data), F.try_variant_get(data, "$.k", "bigint")).alias("k"),
    )


@query("model_output_clean", "SELECT event_id, props AS answer FROM events")
def model_output_clean(spark, sf_dir):
    n = F.col("event_id") % 4
    raw = F.when(n == 0, F.concat(F.lit(" \t"), "props", F.lit("\n"))).when(
        n == 1, F.concat(F.lit("```JSON\n"), "props", F.lit("\n```  ")),
    ).when(n == 2, F.concat(F.lit("```"), "props", F.lit("```"))).otherwise(F.col("props"))
    return b.table(spark, sf_dir, "events").select("event_id", text.clean_model_output(raw).alias("answer"))
