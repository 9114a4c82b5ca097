"""Clients of embedding services, for `readers.embed`: made once per task, called with batches of texts.

All speak the common JSON form: a POST of {"model", "input"} answered by {"data": [{"embedding"}]}.
They differ in what they take for temporary.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

#: First and longest pause in seconds, tries of the hosted and of the raw service, statuses of a busy server.
FIRST_PAUSE, LONGEST_PAUSE = 2.0, 60.0
HOSTED_TRIES, RAW_TRIES = 6, 8
BUSY = (429, 502, 503)


class HardError(RuntimeError):
    """An answer that trying again won't change."""


@dataclass(frozen=True)
class Service:
    """Where and how to ask.

    retry: "any" takes every failure for temporary, "busy" only broken connections and the statuses of
    a busy server. halve: a batch whose tries are used up is halved down to single texts."""

    url: str
    model: str
    key: str = ""
    tries: int = HOSTED_TRIES
    retry: str = "any"
    halve: bool = False
    first_pause: float = FIRST_PAUSE
    longest_pause: float = LONGEST_PAUSE
    timeout: float = 120.0

    def ask(self, path: str, body: dict | None = None) -> dict:
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        request = urllib.request.Request(f"{self.url.rstrip('/')}/{path}", None if body is None else json.dumps(body).encode(), head)
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return json.loads(answer.read())

    def once(self, texts: list[str]) -> list[list[float]]:
        try:
            data = self.ask("embeddings", {"model": self.model, "input": texts, "encoding_format": "float"}).get("data")
        except urllib.error.HTTPError as e:
            if self.retry == "busy" and e.code not in BUSY:
                raise HardError(f"HTTP {e.code}") from e
            raise
        if not data or len(data) != len(texts):
            raise ValueError(f"{len(data or [])} vectors for {len(texts)} texts")
        return [d["embedding"] for d in sorted(data, key=lambda d: d.get("index", 0))]

    def vectors(self, texts: list[str]) -> list[list[float]]:
        """The texts' vectors, after as many tries as allowed, with pauses that double."""
        pause, last = self.first_pause, None
        for attempt in range(self.tries):
            try:
                return self.once(texts)
            except HardError:
                raise
            except Exception as e:
                last = e
            if attempt + 1 < self.tries:
                time.sleep(pause)
                pause = min(2 * pause, self.longest_pause)
        if self.halve and len(texts) > 1:
            half = len(texts) // 2
            return self.vectors(texts[:half]) + self.vectors(texts[half:])
        raise RuntimeError(f"no vectors after {self.tries} tries: {last}")


def wait_until_ready(service: Service, most: float = 120.0, every: float = 2.0) -> list[str]:
    """The models that a local server offers, once it answers; RuntimeError after `most` seconds."""
    end = time.monotonic() + most
    while time.monotonic() < end:
        try:
            return [m["id"] for m in service.ask("models").get("data", [])]
        except Exception:
            time.sleep(every)
    raise RuntimeError(f"no answer from {service.url} within {most} s")


def embedder(service: Service, ready: float | None = None) -> Callable[[], Callable[[list[str]], list]]:
    """For `readers.embed`. With `ready`, each task waits so many seconds at most for the server."""

    def make():
        if ready is not None:
            wait_until_ready(service, ready)
        return service.vectors

    return make


def hosted(url: str, model: str, key: str, **more) -> Service:
    return Service(url, model, key, HOSTED_TRIES, "any", **more)


def raw(url: str, model: str, key: str, **more) -> Service:
    return Service(url, model, key, RAW_TRIES, "any", True, **more)


def local(url: str, model: str, **more) -> Service:
    return Service(url, model, "", RAW_TRIES, "busy", **more)
