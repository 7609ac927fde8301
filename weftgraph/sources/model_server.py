"""Client of a local language-model server: generation, and the calls that manage models.

Requests that fail are reported by their result, not raised: ``(None, None)``, ``None`` or ``False``. Lines of a
streamed answer are JSON objects, the last of which has ``done``.
"""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable, Iterator
from urllib.error import URLError

DEFAULT_URL = "http://localhost:11434"


class Client:
    def __init__(self, url: str | None = None, timeout: float | None = 600):
        self.url, self.timeout = (url or os.environ.get("WEFTGRAPH_MODEL_SERVER", DEFAULT_URL)).rstrip("/"), timeout

    def _open(self, method: str, path: str, body: dict | None = None):
        data = None if body is None else json.dumps({k: v for k, v in body.items() if v is not None}).encode()
        request = urllib.request.Request(f"{self.url}{path}", data, {"Content-Type": "application/json"}, method=method)
        return urllib.request.urlopen(request, timeout=self.timeout)

    def _stream(self, path: str, body: dict) -> Iterator[dict]:
        with self._open("POST", path, body) as answer:
            for line in answer:
                if line.strip():
                    yield json.loads(line)

    def _progress(self, path: str, body: dict, callback: Callable[[dict], None] | None) -> list[dict] | None:
        """All status objects, or None; each also goes to ``callback``."""
        seen = []
        try:
            for status in self._stream(path, body):
                seen.append(status)
                if callback:
                    callback(status)
        except (URLError, OSError):
            return None
        return seen

    def generate(self, model: str, prompt: str, system: str | None = None, template: str | None = None, context: list | None = None, options: dict | None = None, callback: Callable[[dict], None] | None = None) -> tuple[str | None, list | None]:
        """The answer's text and final context. With a callback, that gets the parts and the text is empty."""
        text, final = [], None
        try:
            for part in self._stream("/api/generate", {"model": model, "prompt": prompt, "system": system, "template": template, "context": context, "options": options}):
                if callback:
                    callback(part)
                elif not part.get("done"):
                    text.append(part.get("response", ""))
                if part.get("done"):
                    final = part.get("context")
        except (URLError, OSError):
            return None, None
        return "".join(text), final

    def create(self, name: str, path: str, callback: Callable[[dict], None] | None = None) -> list[dict] | None:
        return self._progress("/api/create", {"name": name, "path": path}, callback)

    def pull(self, name: str, insecure: bool = False, callback: Callable[[dict], None] | None = None) -> list[dict] | None:
        return self._progress("/api/pull", {"name": name, "insecure": insecure}, callback)

    def push(self, name: str, insecure: bool = False, callback: Callable[[dict], None] | None = None) -> list[dict] | None:
        return self._progress("/api/push", {"name": name, "insecure": insecure}, callback)

    def _json(self, method: str, path: str, body: dict | None = None) -> dict | None:
        try:
            with self._open(method, path, body) as answer:
                return json.loads(answer.read() or b"{}")
        except (URLError, OSError):
            return None

    def models(self) -> list[dict] | None:
        found = self._json("GET", "/api/tags")
        return None if found is None else found.get("models", [])

    def show(self, name: str) -> dict | None:
        return self._json("POST", "/api/show", {"name": name})

    def copy(self, source: str, destination: str) -> bool:
        return self._json("POST", "/api/copy", {"source": source, "destination": destination}) is not None

    def delete(self, name: str) -> bool:
        return self._json("DELETE", "/api/delete", {"name": name}) is not None

    def alive(self) -> bool:
        try:
            with self._open("HEAD", "/"):
                return True
        except (URLError, OSError):
            return False
