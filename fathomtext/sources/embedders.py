"""Embedders: two HTTP backends, and two offline ones of this project's own."""

from __future__ import annotations

import hashlib
import warnings
from abc import ABC, abstractmethod

import numpy as np

from fathomtext.functions.errors import PermanentError, http_error, is_retryable
from fathomtext.functions.models import DEFAULT, Limits, Registry
from fathomtext.operators.tokens import _WORD, Counter, back_up, truncate
from fathomtext.sources.config import OLLAMA, OPENAI, Config
from fathomtext.sources.http import Timeouts, post

LEAST_BYTES = 256
MOST_USAGE = 4096


class Embedder(ABC):
    model: str = ""
    dim: int = 0

    @abstractmethod
    def embed(self, texts: list[str]) -> list[list[float] | None]: ...

    def take_usage(self) -> list[dict]:
        """Usage rows of the requests since the last call."""
        return []

    @property
    def fingerprint(self) -> tuple[str, int]:
        return self.model, self.dim


def shrink(texts: list[str]) -> tuple[list[str], bool]:
    """Each text over 256 bytes is cut to four fifths (256 at least), between code points."""
    out = []
    for t in texts:
        raw = t.encode()
        out.append(t if len(raw) <= LEAST_BYTES else raw[: back_up(raw, max(len(raw) * 4 // 5, LEAST_BYTES))].decode("utf-8", "replace"))
    return out, out != texts


def embed_shrinking(texts: list[str], send) -> list[list[float] | None]:
    """Sends again with shorter texts while the server says they are too long and can be cut."""
    while True:
        try:
            return send(texts)
        except PermanentError as e:
            if not e.too_long:
                raise
            texts, changed = shrink(texts)
            if not changed:
                raise


def bound(texts: list[str], limits: Limits, model: str, strict: bool, tokenizer: Counter | None = None) -> list[str]:
    """The budget on a list: in strict mode the first text over it fails the whole call."""
    out = []
    for i, t in enumerate(texts):
        raw = t.encode()
        if tokenizer is not None and limits.max_tokens > 0:
            cut = truncate(tokenizer, raw, limits.max_tokens)
            if len(cut) < len(raw) and strict:
                raise PermanentError(f"embedding: input {i} exceeds {model} MaxTokens ({limits.max_tokens})", too_long=True)
        else:
            cut = raw
            if 0 < limits.max_bytes < len(raw):
                if strict:
                    raise PermanentError(f"embedding: input {i} exceeds {model} MaxBytes ({len(raw)} > {limits.max_bytes})")
                cut = raw[: back_up(raw, limits.max_bytes)]
        out.append(cut.decode("utf-8", "replace"))
    return out


class HttpEmbedder(Embedder):
    """Budget, shrinking, one request, token usage. Usage rows gather in ``usage`` until they're taken, the last ``MOST_USAGE`` at most, and go to ``on_usage``."""

    path = ""

    def __init__(self, base_url: str, model: str, limits: Limits = Limits(), strict: bool = False, timeouts: Timeouts = Timeouts(), api_key: str = "", tokenizer: Counter | None = None, on_usage=None):
        self.base_url, self.model, self.limits, self.strict = base_url.rstrip("/"), model, limits, strict
        self.timeouts, self.api_key, self.tokenizer, self.on_usage = timeouts, api_key, tokenizer, on_usage
        self.usage: list[dict] = []

    def take_usage(self) -> list[dict]:
        out, self.usage = self.usage, []
        return out

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        return embed_shrinking(bound(texts, self.limits, self.model, self.strict, self.tokenizer), self._send)

    def _send(self, texts: list[str]) -> list[list[float] | None]:
        answer = post(self.base_url + self.path, {"model": self.model, "input": texts}, self.timeouts.budget(len(texts)), http_error, self.api_key)
        vectors, tokens = self._parse(answer, len(texts))
        self._observe(texts, tokens)
        self.dim = next((len(v) for v in vectors if v), self.dim)
        return vectors

    def _observe(self, texts: list[str], tokens: int) -> None:
        if tokens <= 0:
            return
        clipped = self.limits.max_tokens > 0 and len(texts) == 1 and tokens >= self.limits.max_tokens
        row = {"model": self.model, "inputs": len(texts), "bytes": sum(len(t.encode()) for t in texts), "tokens": tokens, "max_tokens": self.limits.max_tokens, "clipped": clipped}
        self.usage = [*self.usage[1 - MOST_USAGE :], row]
        if self.on_usage:
            self.on_usage(row)
        if clipped and self.strict:
            raise PermanentError(f"embedding: input for model {self.model!r} was clipped by the backend ({tokens} tokens against a {self.limits.max_tokens} budget)")

    def _parse(self, answer: dict, n: int) -> tuple[list, int]:
        raise NotImplementedError


class OllamaEmbedder(HttpEmbedder):
    path = "/api/embed"

    def _parse(self, answer: dict, n: int) -> tuple[list, int]:
        return list(answer.get("embeddings") or []), int(answer.get("prompt_eval_count") or 0)


class OpenAIEmbedder(HttpEmbedder):
    path = "/v1/embeddings"

    def _parse(self, answer: dict, n: int) -> tuple[list, int]:
        data = answer.get("data") or []
        out: list = [None] * len(data)
        for item in data:
            if 0 <= item.get("index", 0) < len(data):
                out[item.get("index", 0)] = item.get("embedding")
        return out, int((answer.get("usage") or {}).get("prompt_tokens") or 0)


class HashEmbedder(Embedder):
    """Feature hashing of words: deterministic and offline (this project's addition)."""

    def __init__(self, dim: int = 64):
        self.model, self.dim = "hash", dim

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            for word in _WORD.findall(t.lower()):
                h = hashlib.md5(word.encode(), usedforsecurity=False).hexdigest()
                out[i, int(h[:13], 16) % self.dim] += 1 if h[13] >= "8" else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm > 0, norm, 1)).astype(np.float32).tolist()


class SizeEmbedder(Embedder):
    """The bytes of each text as its only element; a call with a text beyond the window is refused as too long (this project's addition)."""

    def __init__(self, window: int):
        self.model, self.dim, self.window = "size", 1, window

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        return embed_shrinking(texts, self._send)

    def _send(self, texts: list[str]) -> list[list[float] | None]:
        sizes = [len(t.encode()) for t in texts]
        if max(sizes, default=0) > self.window:
            raise PermanentError(f"embedding: {max(sizes)} bytes are too long", too_long=True)
        return [[float(n)] for n in sizes]


class TableEmbedder(Embedder):
    """Vectors by key from a bounded dict (this project's addition)."""

    def __init__(self, vectors: dict[str, list[float]]):
        self.model, self.vectors = "table", vectors
        self.dim = len(next(iter(vectors.values()), []))

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        return [self.vectors.get(t) for t in texts]


def new_embedder(c: Config, registry: Registry = DEFAULT) -> Embedder:
    for name, value in (("Backend", c.backend), ("BaseURL", c.base_url), ("Model", c.model)):
        if not value:
            raise ValueError(f"embedding: {name} is required")
    kinds = {OLLAMA: OllamaEmbedder, OPENAI: OpenAIEmbedder}
    if c.backend not in kinds:
        raise ValueError(f"embedding: unknown backend {c.backend!r}")
    if c.strict_model:
        registry.check_strict(c.model)
    return kinds[c.backend](c.base_url, c.model, c.limits(registry), c.strict, c.timeouts, c.api_key, c.tokenizer, c.on_usage)


def new_ollama_embedder(base_url: str, model: str) -> OllamaEmbedder:
    warnings.warn("use new_embedder", DeprecationWarning, stacklevel=2)
    return OllamaEmbedder(base_url, model, DEFAULT.effective_limits(model))


def new_openai_embedder(base_url: str, model: str, api_key: str = "") -> OpenAIEmbedder:
    warnings.warn("use new_embedder", DeprecationWarning, stacklevel=2)
    return OpenAIEmbedder(base_url, model, DEFAULT.effective_limits(model), api_key=api_key)


def embed_with_retry(e: Embedder, texts: list[str], tries: int = 3) -> list[list[float] | None]:
    """No pause between tries; a permanent error ends them."""
    for left in reversed(range(tries)):
        try:
            return e.embed(texts)
        except Exception as error:
            if not is_retryable(error):
                raise
            if not left:
                raise RuntimeError(f"embedding: failed after {tries} attempts: {error}") from error
    raise AssertionError


def embed_one(e: Embedder, text: str) -> list[float]:
    vectors = e.embed([text])
    if not vectors or vectors[0] is None:
        raise RuntimeError("embedding: empty response")
    return vectors[0]
