"""Registered queries: vouchers and their XML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import voucher
from . import bindings as b
from .catalog import query

_DOUBLES = ("taxable", "cgst", "sgst", "igst", "round_off", "total_amount", "debit", "credit")


def _vouchers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voucher.ledger_entries(voucher.amounts(b.summed_invoices(spark, sf_dir), b.INVOICE))


@query("voucher_balance", f"""WITH {b.SQL}, {b.AMOUNTS_SQL}
SELECT invoice_id, buyer, taxable::DOUBLE AS taxable, cgst::DOUBLE AS cgst, sgst::DOUBLE AS sgst, igst::DOUBLE AS igst, round_off::DOUBLE AS round_off, total::DOUBLE AS total_amount, debit::DOUBLE AS debit, credit::DOUBLE AS credit, error FROM w""")
def voucher_balance(spark, sf_dir):
    return _vouchers(spark, sf_dir).select("invoice_id", "buyer", *(F.col(c).cast("double").alias(c) for c in _DOUBLES), "error")


_ENTRIES_SQL = """
x AS (
  SELECT invoice_id, 0 AS o, buyer AS ledger_name, total AS amount, 'debit' AS entry_type FROM w
  UNION ALL SELECT invoice_id, 1, 'Sales', taxable, 'credit' FROM w UNION ALL SELECT invoice_id, 2, 'CGST', cgst, 'credit' FROM w WHERE cgst > 0
  UNION ALL SELECT invoice_id, 3, 'SGST', sgst, 'credit' FROM w WHERE sgst > 0 UNION ALL SELECT invoice_id, 4, 'IGST', igst, 'credit' FROM w WHERE igst > 0
  UNION ALL SELECT invoice_id, 5, 'Round Off', abs(round_off), CASE WHEN round_off > 0 THEN 'credit' ELSE 'debit' END FROM w WHERE round_off <> 0
)"""


@query("voucher_entries", f"""WITH {b.SQL}, {b.AMOUNTS_SQL}, {_ENTRIES_SQL}
SELECT invoice_id, CAST(row_number() OVER (PARTITION BY invoice_id ORDER BY o) - 1 AS INTEGER) AS pos, ledger_name, amount::DOUBLE AS amount, entry_type FROM x""")
def voucher_entries(spark, sf_dir):
    return voucher.explode_entries(_vouchers(spark, sf_dir)).withColumn("amount", F.col("amount").cast("double"))


@query("voucher_roundoff_violations", f"""WITH {b.SQL}, {b.AMOUNTS_SQL}
SELECT invoice_type, coalesce(error, 'none') AS error, count(*) AS n, sum(round_off)::DOUBLE AS round_off FROM w GROUP BY ALL""")
def voucher_roundoff_violations(spark, sf_dir):
    rows = _vouchers(spark, sf_dir).groupBy("invoice_type", F.coalesce("error", F.lit("none")).alias("error"))
    return rows.agg(F.count("*").alias("n"), F.sum("round_off").cast("double").alias("round_off"))


@query("legacy_voucher_rows", f"""WITH {b.SQL}
SELECT invoice_id, 0 AS part, CAST(line_no AS BIGINT) AS pos, 'Sales' AS ledger_name, CAST(total_price AS VARCHAR) AS amount, 'No' AS deemed_positive FROM il
UNION ALL SELECT invoice_id, 1, 0, 'Tax', CAST(tax AS VARCHAR), 'No' FROM inv WHERE tax > 0 UNION ALL SELECT invoice_id, 2, 0, coalesce(buyer, 'None'), CAST(total AS VARCHAR), 'Yes' FROM inv""")
def legacy_voucher_rows(spark, sf_dir):
    return voucher.legacy_entries(b.invoices(spark, sf_dir), b.invoice_lines(spark, sf_dir))


_ESC = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query("voucher_xml", f"""WITH {b.SQL}, {b.AMOUNTS_SQL}, {_ENTRIES_SQL}, l AS (
  SELECT invoice_id, string_agg('<ALLLEDGERENTRIES.LIST><LEDGERNAME>' || {_ESC.format("ledger_name")} || '</LEDGERNAME><ISDEEMEDPOSITIVE>' || CASE entry_type WHEN 'debit' THEN 'Yes' ELSE 'No' END || '</ISDEEMEDPOSITIVE><AMOUNT>' || amount || '</AMOUNT></ALLLEDGERENTRIES.LIST>', '' ORDER BY o) AS entries FROM x GROUP BY invoice_id
)
SELECT invoice_id, '<ENVELOPE><HEADER><TALLYREQUEST>Import Data</TALLYREQUEST></HEADER><BODY><IMPORTDATA><REQUESTDESC><REPORTNAME>Vouchers</REPORTNAME><STATICVARIABLES><SVCURRENTCOMPANY>A &amp; B &lt;Co&gt;</SVCURRENTCOMPANY></STATICVARIABLES></REQUESTDESC><REQUESTDATA><TALLYMESSAGE><VOUCHER VCHTYPE="'
  || CASE invoice_type WHEN 'credit_note' THEN 'Credit Note' WHEN 'debit_note' THEN 'Debit Note' WHEN 'receipt' THEN 'Receipt' ELSE 'Sales' END || '" ACTION="Create"><DATE>' || strftime(invoice_date, '%Y%m%d') || '</DATE><VOUCHERNUMBER>' || invoice_number
  || '</VOUCHERNUMBER><PARTYLEDGERNAME>' || {_ESC.format("buyer")} || '</PARTYLEDGERNAME><NARRATION>Imported invoice</NARRATION>' || entries || '</VOUCHER></TALLYMESSAGE></REQUESTDATA></IMPORTDATA></BODY></ENVELOPE>' AS xml
FROM w JOIN l USING (invoice_id) WHERE error IS NULL""")
def voucher_xml(spark, sf_dir):
    rows = _vouchers(spark, sf_dir).where("error IS NULL").withColumn("voucher_day", dates.voucher_date(F.col("invoice_date").cast("string")))
    return rows.select("invoice_id", voucher.voucher_xml(rows, voucher.VoucherConfig(company="A & B <Co>")).alias("xml"))


@query("xml_response_parse", """
SELECT event_id, CASE event_id % 5 WHEN 4 THEN false ELSE event_id % 5 IN (0, 1) END AS ok, CAST(CASE WHEN event_id % 5 = 4 THEN 0 WHEN event_id % 5 = 1 THEN 0 ELSE user_id END AS INTEGER) AS created,
  CAST(CASE event_id % 5 WHEN 2 THEN 1 ELSE 0 END AS INTEGER) AS errors, CASE event_id % 5 WHEN 3 THEN 'Ledger ' || event_type || ' is unknown' ELSE '' END AS line_errors FROM events""")
def xml_response_parse(spark, sf_dir):
    n = F.col("event_id") % 5
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c.cast("string"), F.lit(f"</{name}>"))
    created = F.when(n == 1, tag("CREATED", F.lit("many"))).otherwise(tag("CREATED", F.col("user_id")))
    errors = F.when(n == 2, tag("ERRORS", F.lit(1))).otherwise(tag("ERRORS", F.lit(0)))
    line = F.when(n == 3, tag("LINEERROR", F.concat(F.lit(" Ledger "), "event_type", F.lit(" is unknown ")))).otherwise(F.lit("<LINEERROR> </LINEERROR>"))
    body = F.when(n == 4, F.lit("<RESPONSE><CREATED>1</CREATED>")).otherwise(F.concat(F.lit("<RESPONSE>"), created, errors, line, F.lit("</RESPONSE>")))
    rows = voucher.parse_acknowledgement(b.table(spark, sf_dir, "events").select("event_id", body.alias("body")))
    return rows.select("event_id", "ok", "created", "errors", F.array_join("line_errors", ";").alias("line_errors"))


@query("xml_redact", "SELECT page_id, substring(regexp_replace(html, '>([^<]+)<', '>***<', 'g'), 1, 300) AS preview FROM pages")
def xml_redact(spark, sf_dir):
    return b.table(spark, sf_dir, "pages").select("page_id", text.redact_xml(F.col("html")).alias("preview"))
