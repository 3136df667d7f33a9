"""What the library asks of models: protocols, and stand-ins that need none."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    dim: int

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class Generator(Protocol):
    def __call__(self, prompt: str) -> str: ...


class HashingEmbedder:
    """Signed counts of hashed words, of length one; the same everywhere."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, t in zip(out, texts):
            for w in (t or " ").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                row[h % self.dim] += 1 if h >> 63 else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, size, out=out, where=size > 0)


def embed(rows: DataFrame, key: str, column: str, embedder: Embedder, batch: int = 96) -> DataFrame:
    """(key, embedding): blank texts are sent as one space, ``batch`` texts in a call."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = [t if t and t.strip() else " " for t in part[column]]
            vectors = [v for at in range(0, len(texts), batch) for v in embedder(texts[at : at + batch])]
            yield pd.DataFrame({key: part[key], "embedding": vectors})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, column).mapInPandas(run, f"`{key}` {kind}, embedding array<float>")


def extract(rows: DataFrame, key: str, column: str, extractor: Callable[[str], list[dict]] | None = None) -> DataFrame:
    """(key, name, kind, error): entities by a callable; where it fails, the rule of thumb and the error's text."""
    from .operators.graph import heuristic_entities

    plain = heuristic_entities(rows, key, column).select(key, "name", F.lit("concept").alias("kind"), F.lit("").alias("error"))
    if extractor is None:
        return plain
    kind = rows.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for k, t in zip(part[key], part[column]):
                try:
                    out += [(k, e["name"], e.get("kind", "concept"), "") for e in extractor(t)]
                except Exception as e:  # noqa: BLE001  any failure of a model is the row's, not the job's
                    out.append((k, None, None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(out, columns=[key, "name", "kind", "error"])

    found = rows.select(key, column).mapInPandas(run, f"`{key}` {kind}, name string, kind string, error string")
    failed = found.where("name is null").select(key, F.col("error").alias("__e"))
    return found.where("name is not null").unionByName(plain.join(failed, key).withColumn("error", F.col("__e")).drop("__e"))
