"""Embedders: hashed n-grams as expressions, or an embedding endpoint; both turn texts into (key, vector)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from . import vectors as V

# Fixed value: texts of one request.
BATCH = 16


def unit(vector: list[float]) -> list[float]:
    """The vector at length 1; zero stays zero."""
    norm = sum(x * x for x in vector) ** 0.5 or 1.0
    return [x / norm for x in vector]


class HashEmbedder:
    """The hashed n-gram embedding; needs no service."""

    def __init__(self, dim: int = V.DIM):
        self.dim = dim

    def identity(self) -> str:
        return f"hash:char-ngram-md5-v1:dim={self.dim}"

    def embed(self, df: DataFrame, key: str, text: str) -> DataFrame:
        return V.embed(df, key, text, self.dim)

    def queries(self, texts: list[str]) -> list[list[float]]:
        return [V.embed_query(t, self.dim) for t in texts]


class ClientEmbedder:
    """A client's embeddings, asked for by the tasks, BATCH texts a request; a client is made per task."""

    def __init__(self, make_client: Callable[[], object], model: str, endpoint: str):
        self.make_client, self.model, self.endpoint = make_client, model, endpoint

    def identity(self) -> str:
        """Names the model and, by a digest, the endpoint; neither host nor key."""
        return f"api:{self.model}:endpoint-sha256={hashlib.sha256(self.endpoint.rstrip('/').encode()).hexdigest()}"

    def queries(self, texts: list[str]) -> list[list[float]]:
        client = self.make_client()
        return [unit(v) for i in range(0, len(texts), BATCH) for v in client.embeddings(texts[i : i + BATCH])]

    def embed(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """(key, vector) of every row; null texts count as empty. A failed request fails its task, which Spark runs again."""
        kind = df.schema[key].dataType.simpleString()

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield pd.DataFrame({key: frame[key], "vector": self.queries(["" if t is None else t for t in frame[text]])})

        return df.select(key, text).mapInPandas(run, f"{key} {kind}, vector array<float>")


def choose(config=None, make_client: Callable[[], object] | None = None) -> HashEmbedder | ClientEmbedder:
    """The endpoint if the configuration names an embedding model, else the hashed embedding."""
    if config is None or not config.embedding_model:
        return HashEmbedder()
    if make_client is None:
        from conceptmill.sources.connector import HttpClient

        make_client = lambda: HttpClient(config)
    return ClientEmbedder(make_client, config.embedding_model, config.embedding_base_url or config.base_url)
