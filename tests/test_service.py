"""The HTTP front and the model call, over real sockets."""

import json
import threading
import urllib.error
import urllib.request
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from kryptonym.functions.dictionary import parse
from kryptonym.functions.layers import Lexicon, WordTagger
from kryptonym.operators import evaluate as E
from kryptonym.operators.masker import Config
from kryptonym.service import Service, server

TOKEN = "a-token-of-some-length"


def running(config, status=None, **settings):
    httpd = server(Service(TOKEN, config, status or {"ner": "not installed"}, **settings))
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    return httpd, f"http://127.0.0.1:{httpd.server_port}"


def call(url, body=None, token=TOKEN, raw=None):
    headers = {"Authorization": f"Bearer {token}"} if token else {}
    data = raw if raw is not None else json.dumps(body).encode() if body is not None else None
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data, headers), timeout=20) as r:
            return r.status, json.loads(r.read())
    except urllib.error.HTTPError as e:
        return e.code, json.loads(e.read())


@pytest.fixture(scope="module")
def bare():
    httpd, url = running(Config(dictionary=tuple(parse(["Ромашка"]))), max_body=2000)
    yield url
    httpd.shutdown()


def test_anonymize_and_restore(bare):
    status, got = call(f"{bare}/anonymize", {"text": "Ромашке: a@x.ru и a@x.ru", "use_ner": False})
    assert status == 200 and got["text"] == "[КОМПАНИЯ_1]: [EMAIL_1] и [EMAIL_1]" and got["stats"] == {"total": 2, "by_type": {"company": 1, "email": 1}}
    assert call(f"{bare}/restore", {"text": got["text"], "keys": got["keys"]}) == (200, {"text": "Ромашке: a@x.ru и a@x.ru"})
    assert call(f"{bare}/anonymize", {"text": "Ромашке b@x.ru", "use_ner": False, "use_dict": False})[1]["text"] == "Ромашке [EMAIL_1]"


def test_refusals_carry_no_text(bare):
    secret = "секрет-маркер"
    cases = [({"text": secret}, 503), ({"text": 5, "x": secret}, 422), ([secret], 422), ({"use_ner": secret}, 422), ({"text": secret * 500, "use_ner": False}, 413)]
    for body, want in cases:
        status, got = call(f"{bare}/anonymize", body)
        assert status == want and secret not in json.dumps(got, ensure_ascii=False)
    assert call(f"{bare}/anonymize", raw=b'{"text": ')[0] == 400
    assert call(f"{bare}/restore", {"text": "t", "keys": {"a": {}}})[0] == 422
    assert call(f"{bare}/anonymize", {"text": "t"}, token="another")[0] == 401 and call(f"{bare}/anonymize", {"text": "t"}, token=None)[0] == 401
    assert call(f"{bare}/nothing", {"text": "t"})[0] == 404


def test_health(bare):
    status, got = call(f"{bare}/health", token=None)
    assert status == 503 and got["ready"] is False and len(got["fingerprint"]) == 12
    httpd, url = running(Config(tagger=WordTagger({"Литвинов": "PER"}), morphology=Lexicon()))
    assert call(f"{url}/health", token=None)[0] == 200
    assert call(f"{url}/anonymize", {"text": "был Литвинов"})[1]["text"] == "был [ФИО_1]"
    httpd.shutdown()


def test_failures_name_their_class_only():
    class Broken:
        def spans(self, text):
            raise ValueError(text)

    httpd, url = running(Config(tagger=Broken(), morphology=Lexicon()))
    status, got = call(f"{url}/anonymize", {"text": "секрет-маркер слово"})
    assert status == 500 and got["detail"] == "not done (ValueError)"
    httpd.shutdown()
    with pytest.raises(RuntimeError):
        Service(" ", Config(), {})


def test_model_over_http(spark):
    class Echo(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            raw = json.dumps({"response": f"{asked['model']}: {asked['prompt']} {asked['options']['temperature']} {asked['options']['seed']}"}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *args):
            pass

    httpd = HTTPServer(("127.0.0.1", 0), Echo)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    rows = spark.createDataFrame([("один",), ("два",)], "p string")
    got = E.judged(rows, F.col("p"), E.HttpModel(f"http://127.0.0.1:{httpd.server_port}/", "m")).collect()
    assert {r.answer for r in got} == {"m: один 0 42", "m: два 0 42"}
    httpd.shutdown()


def test_command_line_needs_a_token(monkeypatch):
    from kryptonym.__main__ import main

    monkeypatch.delenv("KRYPTONYM_TOKEN", raising=False)
    with pytest.raises(RuntimeError):
        main(["--serve", "0"])
