"""What callers may inject: models, counters, predictors, searches. Functions that run on executors must be importable or picklable."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame


class ProviderError(Exception):
    """A provider could not answer; its message is a stable code. Other errors are bugs and are not caught."""


class SearchFailed(Exception):
    """A search could not be planned or run, for example because its index is not there."""


class EmbeddingProvider(Protocol):
    """(place in texts, vector) for each text, in any order."""

    def __call__(self, texts: list[str]) -> list[tuple[int, list[float]]]: ...


class LanguageModel(Protocol):
    """The answer to a prompt, input tokens and output tokens."""

    def __call__(self, prompt: str) -> tuple[str, int, int]: ...


class TokenCounter(Protocol):
    """The tokens of a text, as a column expression."""

    def __call__(self, text: Column) -> Column: ...


class Predictor(Protocol):
    """Predicted findings of a language under a root."""

    def __call__(self, root: str, language: str) -> DataFrame: ...


class Search(Protocol):
    """(query_id, file_id, score, rank) of the chunks that a search finds."""

    def __call__(self, chunks: DataFrame, queries: DataFrame) -> DataFrame: ...


def unavailable(texts: list[str]) -> list[tuple[int, list[float]]]:
    """An embedding provider that is not configured."""
    raise ProviderError("EMBEDDING_PROVIDER_UNAVAILABLE")
