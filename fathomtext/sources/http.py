"""One HTTP request with a deadline that grows with the inputs; answers other than 200 are classified."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

DEFAULT_TIMEOUT, DEFAULT_PER_INPUT, NO_TIMEOUT = 30.0, 2.0, -1.0


@dataclass(frozen=True)
class Timeouts:
    """Seconds; 0 takes the default, a negative base is no deadline, a negative share is none."""

    base: float = 0.0
    per_input: float = 0.0

    def budget(self, inputs: int) -> float | None:
        base = self.base or DEFAULT_TIMEOUT
        if base < 0:
            return None
        share = self.per_input or DEFAULT_PER_INPUT
        return base + max(share, 0.0) * inputs


def post(url: str, body: dict, seconds: float | None, classify: Callable[[str, int, str], Exception], api_key: str = "") -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {api_key}"} if api_key else {}))
    try:
        with urllib.request.urlopen(request, timeout=seconds) as answer:
            text = answer.read().decode("utf-8", "replace")
            if answer.status != 200:
                raise classify(f"status {answer.status}: {text[:500]}", answer.status, text)
            return json.loads(text)
    except urllib.error.HTTPError as e:
        text = e.read().decode("utf-8", "replace")
        raise classify(f"status {e.code}: {text[:500]}", e.code, text) from None
