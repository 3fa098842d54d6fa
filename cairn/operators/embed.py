"""Embedding of documents through a provider, in batches on the executors."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class RateLimited(Exception):
    pass


class Transient(Exception):
    pass


class Provider(Protocol):
    provider: str
    model: str
    dimensions: int
    compatibility_version: str
    max_batch_size: int

    def embed_documents(self, texts: list[str]) -> list[list[float]]: ...

    def embed_query(self, text: str) -> list[float]: ...


class HashProvider:
    """A deterministic provider without a network: components from the bytes of SHA-256 of the text."""

    provider, model, compatibility_version = "offline", "sha256", "v1"

    def __init__(self, dimensions: int = 3, max_batch_size: int = 17):
        self.dimensions, self.max_batch_size = dimensions, max_batch_size

    def embed_query(self, text: str) -> list[float]:
        data = hashlib.sha256(text.encode()).digest()
        return [(int.from_bytes(data[2 * k % 32 : 2 * k % 32 + 2], "big") + 1) / 65537 for k in range(self.dimensions)]

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        return [self.embed_query(t) for t in texts]


def retry_delays(attempts: int = 3, first: float = 0.25, factor: float = 2.0, most: float = 2.0) -> list[float]:
    """Seconds to wait after each attempt but the last."""
    return [min(first * factor**k, most) for k in range(attempts - 1)]


def with_retries(call: Callable, delays: list[float] | None = None, sleep: Callable[[float], None] = time.sleep):
    """Call; wait and call again after RateLimited or Transient, as long as delays last."""
    waits = iter(retry_delays() if delays is None else delays)
    while True:
        try:
            return call()
        except (RateLimited, Transient):
            wait = next(waits, None)
            if wait is None:
                raise
            sleep(wait)


def http_error_class(status: Column) -> Column:
    """The error of an HTTP status."""
    return (
        F.when(status.isin(401, 403), "authentication")
        .when(status == 413, "input_too_large")
        .when(status == 429, "rate_limit")
        .when((status == 408) | (status >= 500), "transient")
        .when(status >= 400, "invalid_request")
    )


def embed(documents: DataFrame, provider: Provider, text: str = "text", known: Column | None = None) -> DataFrame:
    """documents with `embedding`, float32; batches of at most provider.max_batch_size, each answer checked for size.

    A row with a known vector keeps it, and its text isn't sent.
    """

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for batch, kept in batches:
            out, asked = kept.tolist(), [i for i, v in enumerate(kept) if v is None]
            for at in range(0, len(asked), provider.max_batch_size):
                rows = asked[at : at + provider.max_batch_size]
                texts = batch.iloc[rows].tolist()
                answer = with_retries(lambda texts=texts: provider.embed_documents(texts))
                if len(answer) != len(texts) or any(len(v) != provider.dimensions for v in answer):
                    raise ValueError("the provider's answer has another shape")
                for i, v in zip(rows, answer):
                    out[i] = v
            yield pd.Series(out, index=batch.index, dtype=object)

    none = F.lit(None).cast("array<float>")
    return documents.withColumn("embedding", vectors(F.col(text), none if known is None else known))


def vector_valid(vector: Column, dimensions: int) -> Column:
    """Right length, no null, all finite, also as float32."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) <= 3.4028234663852886e38)
    return F.coalesce((F.size(vector) == dimensions) & F.forall(vector, finite), F.lit(False))


def float32(vector: Column) -> Column:
    """Each component as the nearest float32; a finite one that float32 can't hold fails the query."""
    infinite = lambda x: F.abs(x) == float("inf")
    lost = lambda x: infinite(x.cast("float")) & ~infinite(x.cast("double"))
    return F.transform(vector, lambda x: F.when(lost(x), F.raise_error(F.lit("a component is beyond float32")).cast("float")).otherwise(x.cast("float")))
