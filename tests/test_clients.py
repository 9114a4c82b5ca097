"""Embedding services: retries, pauses, halving, readiness, hard errors."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from vektora.sources import clients, fixture, readers

QUICK = {"first_pause": 0.01, "longest_pause": 0.02}


@pytest.fixture
def server():
    """A service whose answers come from a list of statuses first, and which fails batches with "bad" in them."""

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *a):
            pass

        def reply(self, status, body):
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def do_GET(self):
            status = self.server.statuses.pop(0) if self.server.statuses else 200
            self.reply(status, {"data": [{"id": "m"}]})

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.server.seen.append((len(body["input"]), self.headers.get("Authorization")))
            status = self.server.statuses.pop(0) if self.server.statuses else 200
            if len(body["input"]) > self.server.most:
                status = 500
            self.reply(status, {"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in enumerate(body["input"])][::-1]} if status == 200 else {})

    s = HTTPServer(("127.0.0.1", 0), Handler)
    s.statuses, s.seen, s.most = [], [], 100
    threading.Thread(target=s.serve_forever, daemon=True).start()
    s.url = f"http://127.0.0.1:{s.server_port}"
    yield s
    s.shutdown()


def test_tries_again_and_keeps_the_order(server):
    server.statuses = [500, 429]
    got = clients.hosted(server.url, "m", "secret", **QUICK).vectors(["a", "bbb"])
    assert got == [[1.0, 1.0], [3.0, 1.0]] and server.seen == [(2, "Bearer secret")] * 3


def test_gives_up(server):
    server.statuses = [500] * 6
    with pytest.raises(RuntimeError, match="6 tries"):
        clients.hosted(server.url, "m", "", **QUICK).vectors(["a"])


def test_raw_service_halves(server):
    server.most = 2
    service = clients.Service(server.url, "m", tries=2, halve=True, **QUICK)
    assert len(service.vectors(["x"] * 5)) == 5 and [n for n, _ in server.seen] == [5, 5, 2, 3, 3, 1, 2]


def test_local_server(server):
    service = clients.local(server.url, "m", **QUICK)
    server.statuses = [503, 502]
    assert service.vectors(["a"]) == [[1.0, 1.0]]
    server.statuses = [400]
    with pytest.raises(clients.HardError):
        service.vectors(["a"])
    server.statuses = [503]
    assert clients.wait_until_ready(service, 5, 0.01) == ["m"]
    with pytest.raises(RuntimeError, match="no answer"):
        clients.wait_until_ready(clients.local("http://127.0.0.1:9", "m"), 0.05, 0.01)


def test_in_a_job(spark, server):
    v = readers.embed(fixture.documents(spark), "_id", "text", clients.embedder(clients.local(server.url, "m", **QUICK), 5.0), 2, 4, halve=False)
    assert v.count() == len(fixture.PAIRS)


def test_fixture_and_order(spark):
    docs, asked = fixture.documents(spark), fixture.questions(spark)
    assert asked.join(docs.withColumnRenamed("_id", "corpus_id").drop("text"), "corpus_id").count() == len(fixture.PAIRS) >= 10
    items = docs.selectExpr("_id", "text", "cast(substring(_id, 2) as int) as seq")
    v = readers.embed(items.repartition(5), "_id", "text", readers.hashing_embedder(8), 8)
    assert [r.seq for r in readers.in_order(v, items, "_id", "seq").collect()] == list(range(len(fixture.PAIRS)))
