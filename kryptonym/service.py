"""A small HTTP front for single requests: POST /anonymize and /restore, GET /health. Tables of requests go through `operators.requests`.

A bearer token is required, bodies are bounded, and neither answers nor the log carry a rejected request's content: an
error is a status and the names of fields, a failure the class of its exception.
"""

from __future__ import annotations

import json
import logging
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from kryptonym.operators.masker import Config, Masker, restore
from kryptonym.operators.requests import MASK_FIELDS, MAX_BODY, MOST_ERRORS, RESTORE_FIELDS, authorised, check_settings, health

log = logging.getLogger("kryptonym.service")
KINDS = {"string": str, "boolean": bool, "object": dict}


class Refused(Exception):
    def __init__(self, status: int, detail: str):
        self.status, self.detail = status, detail


def checked(raw: bytes, fields: dict[str, str]) -> dict:
    """The fields of a body, or a refusal that names them without their values."""
    try:
        body = json.loads(raw.decode("utf-8"))
    except ValueError:
        raise Refused(400, "the body is no JSON in UTF-8") from None
    if not isinstance(body, dict):
        raise Refused(422, "the body is no object")
    wrong = [f"{n}: {kind}_type" for n, kind in fields.items() if n in body and not isinstance(body[n], KINDS[kind])]
    wrong += ["text: missing"] * ("text" not in body) + [f"{n}: extra_forbidden" for n in body if n not in fields]
    entries = body.get("keys", {})
    if not wrong and any(not isinstance(e, dict) or not isinstance(e.get("original"), str) for e in entries.values()):
        wrong = ["keys: original_missing"]
    if wrong:
        raise Refused(422, "; ".join(wrong[:MOST_ERRORS]))
    return body


class Service:
    """What the answers need: settings, layers with a lock around them, and their status."""

    def __init__(self, token: str, config: Config, status: dict[str, str], max_body: int | str = MAX_BODY):
        self.token, self.max_body = check_settings(token, max_body)
        self.config, self.status, self.lock = config, status, threading.Lock()

    def anonymize(self, raw: bytes) -> dict:
        body = checked(raw, MASK_FIELDS)
        ner, words = body.get("use_ner", True), body.get("use_dict", True)
        if ner and not self.config.ready:
            raise Refused(503, "a layer is not there: " + ", ".join(f"{k} {v}" for k, v in self.status.items()))
        c = self.config
        masker = Masker(Config(c.enabled, c.dictionary if words else (), c.tagger if ner else None, c.morphology if ner else None))
        with self.lock:
            text = masker.mask(body["text"])
        by_type: dict[str, int] = {}
        for k in masker.keys:
            by_type[k["type_id"]] = by_type.get(k["type_id"], 0) + 1
        log.info("anonymize: %d characters, %d masks, %d types", len(body["text"]), len(masker.keys), len(by_type))
        return {"text": text, "keys": {k["placeholder"]: {"original": k["original"], "type": k["type"]} for k in masker.keys}, "stats": {"total": len(masker.keys), "by_type": by_type}}

    def restore(self, raw: bytes) -> dict:
        body = checked(raw, RESTORE_FIELDS)
        keys = body.get("keys", {})
        log.info("restore: %d characters, %d keys", len(body["text"]), len(keys))
        return {"text": restore(body["text"], [(p, e["original"]) for p, e in keys.items()])}


def server(service: Service, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """The server, to be run by serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def answer(self, status: int, body: dict) -> None:
            raw = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(raw)))
            if status == 401:
                self.send_header("WWW-Authenticate", "Bearer")
            if status >= 400:
                self.send_header("Connection", "close")
                self.close_connection = True
            self.end_headers()
            self.wfile.write(raw)

        def body(self) -> bytes:
            said = self.headers.get("Content-Length")
            if said is None or not said.isdecimal():
                raise Refused(411 if said is None else 400, "a length in bytes is required")
            if int(said) > service.max_body:
                raise Refused(413, f"the body is over {service.max_body} bytes")
            return self.rfile.read(int(said))

        def handled(self, work) -> None:
            try:
                self.answer(200, work())
            except Refused as e:
                self.answer(e.status, {"error": e.status, "detail": e.detail})
            except Exception as e:
                log.error("failed: %s", type(e).__name__)
                self.answer(500, {"error": 500, "detail": f"not done ({type(e).__name__})"})

        def do_GET(self):  # noqa: N802
            if self.path != "/health":
                self.answer(404, {"error": 404, "detail": "not found"})
                return
            told = health(service.config, service.status)
            self.answer(told.pop("code"), told)

        def do_POST(self):  # noqa: N802
            work = {"/anonymize": service.anonymize, "/restore": service.restore}.get(self.path)

            def run() -> dict:
                if work is None:
                    raise Refused(404, "not found")
                if not authorised(self.headers.get("Authorization"), service.token):
                    raise Refused(401, "a bearer token is required")
                return work(self.body())

            self.handled(run)

        def log_message(self, *args):
            """Nothing of a request but the counters."""

    return ThreadingHTTPServer((host, port), Handler)
