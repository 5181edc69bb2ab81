"""Uploads of voucher XML through an injected transport: at least once, with an idempotency key."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from ..operators.voucher import parse_acknowledgement
from ..operators.workflow import TRANSIENT_STATUS

#: A transport takes (xml, idempotency key) and gives (status, body), or raises TimeoutError or ConnectionError.
Transport = Callable[[str, str], tuple[int, str]]


def http_transport(url: str, timeout: float = 15.0) -> Transport:
    """XML by POST, with the idempotency key as a header; a refusal is its status and body, whatever else a ConnectionError or TimeoutError."""

    def ask(xml: str, key: str) -> tuple[int, str]:
        request = urllib.request.Request(url, xml.encode(), {"Content-Type": "application/xml; charset=utf-8", "Idempotency-Key": key})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as found:
                return found.status, found.read().decode("utf-8", errors="replace")
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode("utf-8", errors="replace")
        except TimeoutError:
            raise
        except OSError as e:
            raise (TimeoutError if "timed out" in str(e) else ConnectionError)(str(e)) from e

    return ask


def send(transport: Transport, xml: str, key: str, retries: int = 3, delay: float = 1.0, sleep=time.sleep) -> tuple[str | None, str | None, int]:
    """(body, error, attempts); never raises. Transient failures are tried again, after delays that double."""
    for n in range(retries + 1):
        try:
            status, body = transport(xml, key)
            if status < 400:
                return body, None, n + 1
            error, again = f"status {status}", status in TRANSIENT_STATUS
        except (TimeoutError, ConnectionError) as e:
            error, again = f"{type(e).__name__}: {e}", True
        except Exception as e:  # any other failure is this upload's status
            error, again = f"{type(e).__name__}: {e}", False
        if not again or n == retries:
            return None, error, n + 1
        sleep(delay * 2**n)
    raise ValueError("retries must not be negative")


def upload(vouchers: DataFrame, transport: Transport, retries: int = 3, delay: float = 1.0) -> DataFrame:
    """vouchers (xml, idempotency_key) with body, error, attempts and the parsed acknowledgement. Write the result once."""

    def run(batches: Iterator):
        for pdf in batches:
            sent = [send(transport, x, k, retries, delay) for x, k in zip(pdf["xml"], pdf["idempotency_key"], strict=True)]
            yield pdf.assign(body=[s[0] for s in sent], error=[s[1] for s in sent], attempts=[s[2] for s in sent])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vouchers.schema)
    return parse_acknowledgement(vouchers.mapInPandas(run, f"{fields}, body string, error string, attempts int"))
