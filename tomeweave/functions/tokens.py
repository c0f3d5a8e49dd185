"""Token counting, either by rule in the JVM or with a byte-pair vocabulary in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomeweave.functions.text import token_estimate


class TokenCounter(Protocol):
    def of(self, text: Column) -> Column:
        """Tokens of a text."""
        ...

    def each(self, texts: Column) -> Column:
        """Tokens of every text of an array."""
        ...


class FourCharacters:
    """Four characters to a token, rounded up; needs no vocabulary and no Python."""

    def of(self, text: Column) -> Column:
        return token_estimate(text)

    def each(self, texts: Column) -> Column:
        return F.transform(texts, token_estimate)

