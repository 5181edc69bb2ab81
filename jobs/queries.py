"""Registered queries of the jobs: each runs its job twice into one new folder and returns what lies there then."""

from __future__ import annotations

from jobs import document_intake, month_close
from ledgerloom.plans import bindings as b
from ledgerloom.plans.catalog import query
from ledgerloom.plans.vouchers import _ENTRIES_SQL
from ledgerloom.sources import shared


def _place(spark, name: str) -> str:
    """A new folder that stays."""
    return shared.folder(spark, name, keep=True)


@query("job1_month_close", f"""WITH {b.SQL}, {b.AMOUNTS_SQL}, {_ENTRIES_SQL}, m AS (SELECT invoice_id, strftime(invoice_date, '%Y-%m') AS month, error, buyer, debit, credit FROM w),
n AS (
  SELECT m.month, x.invoice_id, row_number() OVER (PARTITION BY x.invoice_id ORDER BY x.o) - 1 AS pos, CASE x.ledger_name WHEN 'Sales' THEN 'Turnover' ELSE x.ledger_name END AS ledger_name, x.amount, x.entry_type, m.error
  FROM x JOIN m USING (invoice_id)
)
SELECT 'entry' AS kind, month, invoice_id, ledger_name, CASE entry_type WHEN 'debit' THEN amount::DOUBLE END AS debit, CASE entry_type WHEN 'credit' THEN amount::DOUBLE END AS credit, pos AS n, NULL AS error FROM n WHERE error IS NULL
UNION ALL SELECT 'balance', month, NULL, ledger_name, coalesce(sum(amount) FILTER (entry_type = 'debit'), 0)::DOUBLE, coalesce(sum(amount) FILTER (entry_type = 'credit'), 0)::DOUBLE, count(*), NULL FROM n WHERE error IS NULL GROUP BY ALL
UNION ALL SELECT 'rejected', month, m.invoice_id, buyer, debit::DOUBLE, credit::DOUBLE, c.k, error FROM m JOIN (SELECT invoice_id, count(*) AS k FROM n GROUP BY invoice_id) c USING (invoice_id) WHERE error IS NOT NULL""")
def job1_month_close(spark, sf_dir):
    out = _place(spark, "month-close")
    config = month_close.Config(ledgers={"sales": "Turnover"})
    month_close.run(spark, sf_dir, out, config)
    return month_close.run(spark, sf_dir, out, config)


@query("job2_document_intake", r"""WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text, trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')) AS plain FROM documents),
g AS (SELECT plain, min(doc_id) AS first_doc_id, max(doc_id) AS last_doc_id, arg_min(source, doc_id) AS tenant, arg_min(length(text), doc_id) AS n_chars, count(*) AS n_docs FROM t GROUP BY plain)
SELECT sha256(plain) AS content_key, first_doc_id, last_doc_id, tenant, CASE tenant WHEN 'src1' THEN 'deu' WHEN 'src2' THEN 'fra' ELSE 'eng' END AS language, n_chars,
  CAST(CASE WHEN plain = '' THEN 0 ELSE len(string_split(plain, ' ')) END AS BIGINT) AS n_words, n_docs,
  CASE WHEN plain = '' THEN 'empty' WHEN n_chars > 20000 THEN 'too_long' ELSE 'accepted' END AS state FROM g""")
def job2_document_intake(spark, sf_dir):
    place = _place(spark, "document-intake")
    config = document_intake.Config(languages={"src1": "deu", "src2": "fra"})
    for _ in range(2):
        # a pattern, as the table may be one file or a folder of files
        found = document_intake.run(spark, f"{sf_dir}/documents.parque[t]", f"{place}/out", f"{place}/checkpoint", config)
    return found
