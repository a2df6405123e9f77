"""A model client over HTTP for services that take a list of messages as JSON; standard library only."""

from __future__ import annotations

import json
import os
import time
import urllib.request
from dataclasses import dataclass, field


@dataclass
class HttpClient:
    """complete() posts to <base_url>/chat/completions and gives the answer's text; ``usage`` sums the tokens reported."""

    base_url: str
    model: str
    key: str = ""
    timeout: float = 300.0
    json_mode: bool = True
    stream: bool = False
    usage: dict[str, int] = field(default_factory=dict)
    last_ms: float = 0.0

    @classmethod
    def from_env(cls, prefix: str = "MODEL") -> HttpClient:
        env = lambda name, default="": os.environ.get(f"{prefix}_{name}", default)
        truth = lambda x: x.strip().lower() in ("1", "true", "yes", "on")
        return cls(env("BASE_URL"), env("NAME"), env("KEY"), float(env("TIMEOUT", "300")), truth(env("JSON", "1")), truth(env("STREAM", "0")))

    def complete(self, messages: list[dict[str, str]]) -> str:
        body = {"model": self.model, "messages": messages, "stream": self.stream} | ({"response_format": {"type": "json_object"}} if self.json_mode else {})
        request = urllib.request.Request(f"{self.base_url.rstrip('/')}/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {}))
        began = time.monotonic()
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            text = self._streamed(answer) if self.stream else self._whole(json.load(answer))
        self.last_ms = round((time.monotonic() - began) * 1000, 2)
        return text

    def _count(self, usage: dict | None) -> None:
        for k, v in (usage or {}).items():
            if isinstance(v, int):
                self.usage[k] = self.usage.get(k, 0) + v

    def _whole(self, found: dict) -> str:
        self._count(found.get("usage"))
        return found["choices"][0]["message"].get("content") or ""

    def _streamed(self, lines) -> str:
        """The deltas of an event stream, joined."""
        out = []
        for line in lines:
            data = line.decode().strip().removeprefix("data:").strip()
            if not data or data == "[DONE]":
                continue
            event = json.loads(data)
            self._count(event.get("usage"))
            out += [c["delta"].get("content") or "" for c in event.get("choices", []) if "delta" in c]
        return "".join(out)
