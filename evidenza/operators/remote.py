"""Embeddings from a provider behind a transport: batches of a task, bounded attempts, answers put in order and counted."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A transport takes texts and gives the provider's items: an index and an embedding each.
Transport = Callable[[list[str]], list[dict]]
BATCH, ATTEMPTS, WAIT = 32, 3, 1.0


class ProviderError(RuntimeError):
    """The provider failed in all attempts, or its answer does not fit the question."""


def asked(texts: list[str], transport: Transport, attempts: int = ATTEMPTS, wait: float = WAIT, sleep=time.sleep) -> list[dict]:
    """The items for texts; an OSError or ValueError of the transport is tried again after waits that double."""
    for attempt in range(attempts):
        try:
            return transport(texts)
        except (OSError, ValueError) as error:
            if attempt + 1 == attempts:
                raise ProviderError(f"the provider failed {attempts} times") from error
            sleep(wait * 2**attempt)
    raise ValueError("at least one attempt")


def vectors_of(texts: list[str], items: list[dict], width: int | None) -> np.ndarray:
    """Embeddings in the order of the texts, of unit length; one of zeros stays. Another count, order or width is an error."""
    items = sorted(items, key=lambda item: item.get("index", 0))
    given = [item["index"] for item in items if "index" in item]
    if len(items) != len(texts) or (given and given != list(range(len(texts)))):
        raise ProviderError(f"{len(items)} embeddings for {len(texts)} texts")
    sizes = {len(item["embedding"]) for item in items}
    if len(sizes) > 1 or (width is not None and sizes - {width}):
        raise ProviderError(f"embeddings of {sorted(sizes)} components, not {width}")
    out = np.array([item["embedding"] for item in items], float)
    if not np.isfinite(out).all():
        raise ProviderError("embeddings that are not finite")
    length = np.sqrt((out * out).sum(1, keepdims=True))
    return np.where(length > 0, out / np.where(length > 0, length, 1), out)


def embedded_remotely(df: DataFrame, text: str, connect: Callable[[], Transport], width: int | None = None, batch: int = BATCH, attempts: int = ATTEMPTS, wait: float = WAIT) -> DataFrame:
    """df with embedding (array<float>): unit vectors from the provider, null for null texts.

    connect makes a transport in each task, so connections are not shipped. Each distinct text of a task's batch is asked
    once. Only texts pass through Python; all other columns stay as they are. A failure fails the task, never a row.
    """

    def embed(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        transport = connect()
        for column in columns:
            ones = list(dict.fromkeys(t for t in column if isinstance(t, str)))
            known: dict[str, list[float]] = {}
            for i in range(0, len(ones), batch):
                part = ones[i : i + batch]
                known.update(zip(part, vectors_of(part, asked(part, transport, attempts, wait), width).astype(np.float32).tolist(), strict=True))
            yield pd.Series([known[t] if isinstance(t, str) else None for t in column], dtype=object)

    return df.withColumn("embedding", F.pandas_udf(embed, "array<float>")(F.col(text)))
