"""Settings, rules, providers and sinks."""

import json

import pytest

from ledgerloom import config
from ledgerloom.sinks import files, upload
from ledgerloom.sources import providers, rules


def test_settings():
    s = config.load({"OCR_MAX_PAGES": "0", "OCR_TIMEOUT_SECONDS": "-1", "OCR_DESKEW": " Yes ", "OCR_TENANT_LANGUAGES": '{"t": "deu", "u": ""}', "UPLOAD_RETRIES": "many"})
    assert (s.ocr_max_pages, s.ocr_timeout_seconds, s.deskew, s.ocr_tenant_languages, s.upload_retries) == (1, 0.0, True, {"t": "deu"}, 3)
    assert config.parse_mapping({"x": "[1]"}, "x") == {} == config.parse_mapping({"x": "{"}, "x")
    assert [config.endpoint(u) for u in ("http://h:1", "https://h", "", "http://h")] == ["http://h:1", "http://h:443", "http://localhost:9000", "http://h:9000"]


def test_rules_file(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(
        json.dumps(
            {
                "global": {"party": {"a": " A "}, "settings": {"learn_on_approval": True}},
                "tenants": {"t": {"ledger": {"s": {"value": "S", "learned_at": "now"}, "e": ""}, "settings": {"learn_on_approval": False}}},
            }
        )
    )
    got = {(r.scope, r.tenant_id, r.entity_type, r.key): r.target for r in rules.read_rules(spark, str(path)).collect()}
    assert got == {("global", None, "party", "a"): "A", ("tenant", "t", "ledger", "s"): "S", ("tenant", "t", "ledger", "e"): None}
    assert {r.tenant_id: r.enabled for r in rules.learning_enabled(spark, str(path)).collect()} == {None: True, "t": False}
    assert rules.read_rules(spark, str(tmp_path / "none.json")).collect() == []


def test_extraction(spark):
    provider = providers.FixtureProvider({"a": '```json\n{"x": 1}\n```', "b": '{"x": 1} trailing', "c": "[1]"}, {"b": '{"x": 2}'})
    got = {
        r.job_id: r for r in providers.extract(
            spark.createDataFrame([("a", "a"), ("b", "b"), ("c", "c"), ("d", "d"), ("e", None)], "job_id string, text string"), provider, delay=0.0,
        ).collect()
    }
    assert [(got[k].strategy, got[k].payload, got[k].error) for k in "abcd"] == [
        ("strict_json", '{"x": 1}', None), ("repaired_json", '{"x": 2}', None), ("failed", None, "PROVIDER_FAILURE"),
        ("failed", None, "PROVIDER_FAILURE"),
    ]


def test_retry():
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("503 Service Unavailable")
        return "ok"

    assert providers.with_retry(flaky, "x", 3, 1.0, waits.append)[:2] == ("ok", 3) and waits == [1.0, 2.0]
    with pytest.raises(RuntimeError):
        providers.with_retry(lambda: (_ for _ in ()).throw(RuntimeError("bad key")), "x", 3, 1.0, waits.append)
    assert len(waits) == 2


def test_upload(spark):
    def transport(xml, key):
        if key == "late":
            raise TimeoutError("slow")
        return (400, "") if key == "bad" else (200, "<R><CREATED>1</CREATED><ERRORS>0</ERRORS></R>")

    rows = spark.createDataFrame([("<x/>", "ok"), ("<x/>", "bad"), ("<x/>", "late")], "xml string, idempotency_key string")
    got = {r.idempotency_key: r for r in upload.upload(rows, transport, retries=2, delay=0.0).collect()}
    assert [(got[k].ok, got[k].attempts) for k in ("ok", "bad", "late")] == [(True, 1), (False, 1), (False, 3)]


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("2025-01-01", "j", "why")], "day string, job_id string, reason string")
    files.write_artifact(rows, str(tmp_path), "review")
    files.append_review_queue(rows, f"{tmp_path}/queue")
    files.append_review_queue(rows, f"{tmp_path}/queue")
    assert spark.read.parquet(f"{tmp_path}/review").count() == 1 and spark.read.json(f"{tmp_path}/queue").count() == 2
    prf = spark.createDataFrame(
        [("total", 1, 0, 0, 1.0, 1.0, 1.0), ("buyer", 1, 0, 1, 1.0, 0.5, 0.667)],
        "field string, tp int, fp int, fn int, precision double, recall double, f1 double",
    )
    files.write_report(prf, prf.limit(1), rows, f"{tmp_path}/report")
    assert [r.field for r in spark.read.option("header", True).csv(f"{tmp_path}/report/fields").collect()] == ["buyer", "total", "line_items"]


def test_docx_reader():
    import io
    import zipfile

    from ledgerloom.sources import readers

    body = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Invoice </w:t></w:r><w:r><w:t>7</w:t></w:r></w:p><w:p><w:r><w:t> </w:t></w:r></w:p><w:p><w:r><w:t>Total 5</w:t></w:r></w:p></w:body></w:document>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", body)
    assert list(readers.word()(data.getvalue(), "eng", []).texts) == ["Invoice 7\nTotal 5"]


def test_http_provider_and_transport():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    seen = []

    class Server(BaseHTTPRequestHandler):
        def answer(self, status, body):
            self.send_response(status)
            self.end_headers()
            self.wfile.write(body.encode())

        def do_GET(self):
            self.answer(200, '{"data": [{"id": "b"}, {"id": "a"}]}')

        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"])).decode()
            seen.append((self.path, body, self.headers.get("Idempotency-Key")))
            if self.path == "/xml":
                return self.answer(503 if "busy" in body else 200, f"<R>{len(seen)}</R>")
            text = "" if "nothing" in body else "{}"
            return self.answer(429 if "often" in body else 200, json.dumps({"choices": [{"message": {"content": text}}]}))

        def log_message(self, *told):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    try:
        model = providers.HttpProvider(url, "m", "k")
        assert model.extract("Invoice 7") == "{}" and model.repair("x", "{", "broken") == "{}" and model.models() == ["a", "b"]
        for text, told in (("nothing", "holds no text"), ("often", "429")):
            with pytest.raises(RuntimeError, match=told):
                model.extract(text)
        assert upload.http_transport(f"{url}/xml")("<x/>", "key") == (200, "<R>5</R>") and seen[-1] == ("/xml", "<x/>", "key")
        assert upload.send(upload.http_transport(f"{url}/xml"), "<busy/>", "k", retries=1, delay=0.0) == (None, "status 503", 2)
    finally:
        server.shutdown()
        server.server_close()
    with pytest.raises(ValueError, match="key"):
        providers.HttpProvider(url, "m", "")
    with pytest.raises(RuntimeError, match="connection"):
        providers.HttpProvider(url, "m", "k", timeout=0.5).extract("x")
    with pytest.raises((ConnectionError, TimeoutError)):
        upload.http_transport(url, timeout=0.5)("<x/>", "k")
