"""Settings of embedding and reranking backends, from code or from the environment."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from dataclasses import dataclass

from fathomtext.functions.models import DEFAULT, Limits, Registry, parse_aliases
from fathomtext.sources.http import NO_TIMEOUT, Timeouts

OLLAMA, OPENAI, JINA, TEI = "ollama", "openai", "jina", "tei"
#: fixed values: units of durations, spellings of booleans
_UNIT = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "μs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}
_TRUE, _FALSE = {"1", "t", "T", "TRUE", "true", "True"}, {"0", "f", "F", "FALSE", "false", "False"}


@dataclass(frozen=True)
class Config:
    backend: str = ""
    base_url: str = ""
    model: str = ""
    api_key: str = ""
    max_bytes: int = 0
    max_tokens: int = 0
    bytes_per_token: float = 0.0
    strict: bool = False
    strict_model: bool = False
    timeouts: Timeouts = Timeouts()
    tokenizer: Callable[[str], int] | None = None  # exact token budgets where it is given
    on_usage: Callable[[dict], None] | None = None  # told of each request's tokens, in the process that sends it

    def limits(self, registry: Registry = DEFAULT) -> Limits:
        return registry.effective_limits(self.model, Limits(self.max_bytes, self.max_tokens), self.bytes_per_token)


@dataclass(frozen=True)
class RerankConfig:
    backend: str = ""
    base_url: str = ""
    model: str = ""
    api_key: str = ""
    strict: bool = False
    normalize_scores: bool = False
    timeouts: Timeouts = Timeouts()


#: fixed values: the presets
def ollama_local_nomic() -> Config:
    return Config(OLLAMA, "http://localhost:11434", "nomic-embed-text")


def lemonade_nomic() -> Config:
    return Config(OPENAI, "http://localhost:13305", "nomic-embed-text")


default_config = ollama_local_nomic


def parse_duration(text: str) -> float:
    """Seconds of a duration such as 1h30m, 250ms or -5s; a bare number other than 0 is none."""
    body = text[1:] if text[:1] in "+-" and text else text
    if body == "0":
        return 0.0
    parts = re.findall(r"([0-9]*\.?[0-9]*)(ns|us|µs|μs|ms|s|m|h)", body)
    if not parts or "".join(a + b for a, b in parts) != body or any(a in ("", ".") for a, _ in parts):
        raise ValueError(f"invalid duration {text!r}")
    return (-1 if text[0] == "-" else 1) * sum(float(a) * _UNIT[b] for a, b in parts)


def cascade(prefix: str, suffix: str, canonical: str, env=None) -> tuple[str, str]:
    """The first non-empty value and the variable it came from: the prefix's own, then the canonical one's."""
    env = os.environ if env is None else env
    for name in dict.fromkeys((prefix, canonical)):
        if env.get(name + suffix):
            return env[name + suffix], name + suffix
    return "", ""


def _budget(value: str, source: str) -> int:
    if not value:
        return 0
    try:
        n = int(value) if re.fullmatch(r"[+-]?[0-9]+", value) else None
    except ValueError:
        n = None
    if n is None:
        raise ValueError(f"embedding: invalid {source} value {value!r} (want a whole number)")
    if n <= 0:
        raise ValueError(f"embedding: invalid {source} value {value!r} (want more than 0)")
    return n


def _timeout(value: str, source: str) -> float:
    if not value:
        return 0.0
    if value.lower() == "none":
        return NO_TIMEOUT
    try:
        seconds = parse_duration(value)
    except ValueError:
        raise ValueError(f"embedding: invalid {source} value {value!r} (want a duration such as 30s, or none)") from None
    if seconds < 0:
        raise ValueError(f"embedding: invalid {source} value {value!r} (negative; use none for no deadline)")
    return seconds


def _flag(value: str, source: str) -> bool:
    if not value:
        return False
    if value not in _TRUE | _FALSE:
        raise ValueError(f"embedding: invalid {source} value {value!r} (want true or false)")
    return value in _TRUE


def config_from_env(prefix: str = "EMBEDDING", env=None, registry: Registry = DEFAULT) -> Config:
    def get(suffix: str) -> tuple[str, str]:
        return cascade(prefix, suffix, "EMBEDDING", env)

    base = default_config()
    alias, source = get("_MODEL_ALIAS")
    for served, canonical in parse_aliases(source, alias) if alias else ():
        registry.register_alias(served, canonical)
    return Config(
        backend=get("_BACKEND")[0] or base.backend,
        base_url=get("_BASE_URL")[0] or base.base_url,
        model=get("_MODEL")[0] or base.model,
        api_key=get("_API_KEY")[0],
        max_bytes=_budget(*get("_MAX_BYTES")),
        max_tokens=_budget(*get("_MAX_TOKENS")),
        strict=_flag(*get("_STRICT")),
        strict_model=get("_STRICT_MODEL")[0] in ("true", "1"),
        timeouts=Timeouts(_timeout(*get("_TIMEOUT")), _timeout(*get("_PER_INPUT_TIMEOUT"))),
    )


def rerank_config_from_env(prefix: str = "RERANK", env=None) -> RerankConfig:
    def get(suffix: str) -> tuple[str, str]:
        return cascade(prefix, suffix, "RERANK", env)

    return RerankConfig(get("_BACKEND")[0], get("_BASE_URL")[0], get("_MODEL")[0], get("_API_KEY")[0], _flag(*get("_STRICT")), _flag(*get("_NORMALIZE_SCORES")), Timeouts(_timeout(*get("_TIMEOUT")), _timeout(*get("_PER_INPUT_TIMEOUT"))))
