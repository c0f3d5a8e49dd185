"""Protocols, the offline embedder and the provider rules.

Everything here is small and picklable: an object of these classes is shipped to
the executors inside a pandas UDF and called once per Arrow batch.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol

import numpy as np

from tomeweave.constants import (
    EMBED_BACKOFF_SECONDS,
    EMBED_RETRIES,
    RATE_LIMIT_FLOOR_SECONDS,
    RATE_LIMIT_MARKS,
    TRANSIENT_MARKS,
)


class Embedder(Protocol):
    name: str

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class Generator(Protocol):
    name: str

    def generate(self, prompts: Sequence[str]) -> list[dict[str, Any]]:
        """Per prompt: content, input_tokens, output_tokens, finish_reason."""
        ...


@dataclass
class HashedEmbedder:
    """Signed hashed bag of words of unit length: a deterministic stand-in for an embedding service."""

    dim: int = 64
    name: str = "hashed-bow"

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts):
            for word in text.lower().split():
                code = zlib.crc32(word.encode())
                row[code % self.dim] += 1.0 if code >> 31 else -1.0
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms > 0, norms, 1.0)).tolist()


@dataclass
class TemplateGenerator:
    """Answers each prompt with a fixed function of it; stands in for a text model in tests."""

    answer: Callable[[str], str] = field(default=lambda prompt: prompt[:100])
    name: str = "template"

    def generate(self, prompts: Sequence[str]) -> list[dict[str, Any]]:
        replies = [self.answer(p) for p in prompts]
        return [
            {"content": r, "input_tokens": len(p.split()), "output_tokens": len(r.split()), "finish_reason": "stop"}
            for p, r in zip(prompts, replies)
        ]


def error_kind(message: str) -> str:
    text = message.lower()
    if any(m in text for m in RATE_LIMIT_MARKS):
        return "rate_limit"
    return "transient" if any(m in text for m in TRANSIENT_MARKS) else "other"


def retry_delay(
    attempt: int, kind: str, base: float = EMBED_BACKOFF_SECONDS, least: float = 0.0, most: float = float("inf"), floor: float = RATE_LIMIT_FLOOR_SECONDS
) -> float:
    """Doubling delay between ``least`` and ``most``; never below ``floor`` after a rate limit."""
    delay = max(least, min(most, base * 2 ** (attempt - 1)))
    return max(delay, floor) if kind == "rate_limit" else delay


@dataclass
class Retry:
    """Try a call several times; the last error is passed on."""

    attempts: int = EMBED_RETRIES
    base: float = EMBED_BACKOFF_SECONDS
    sleep: Callable[[float], None] = time.sleep
    least: float = 0.0
    most: float = float("inf")
    floor: float = RATE_LIMIT_FLOOR_SECONDS

    def __call__(self, call: Callable[[], Any]) -> Any:
        for attempt in range(1, self.attempts + 1):
            try:
                return call()
            except Exception as error:
                if attempt == self.attempts:
                    raise
                self.sleep(retry_delay(attempt, error_kind(str(error)), self.base, self.least, self.most, self.floor))


# Attempts and waits of the three callers: embedding, category pairs, evaluation pairs.
EMBED_RETRY = Retry()
CATEGORY_RETRY = Retry(attempts=5, base=2.0, least=10.0, most=120.0, floor=0.0)
EVALUATION_RETRY = Retry(attempts=3, base=2.0, least=4.0, most=60.0, floor=0.0)


@dataclass
class Fallback:
    """Try models in order; the last error is passed on when all fail."""

    models: Sequence[Generator]
    name: str = "fallback"

    def generate(self, prompts: Sequence[str]) -> list[dict[str, Any]]:
        last: Exception | None = None
        for model in self.models:
            try:
                return [{**reply, "model": model.name} for reply in model.generate(prompts)]
            except Exception as error:
                last = error
        raise last if last else ValueError("no models")


def choose_provider(available: Sequence[str], wanted: str, purpose: str = "text") -> tuple[str, bool]:
    """(provider, is the wanted one). Embeddings prefer the managed variant of a provider."""
    if not available:
        raise ValueError("no providers available")
    if purpose == "embedding":
        for name in (f"{wanted}_vertex", wanted):
            if name in available:
                return name, True
    if wanted in available:
        return wanted, True
    return available[0], False
