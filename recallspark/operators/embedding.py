"""Text to vectors through a pluggable embedder."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.functions import arrow_udf

from recallspark.functions.models import loaded, name_of
from recallspark.settings import DEFAULTS

Encode = Callable[[list[str]], np.ndarray]


class Embedder(Protocol):
    def load(self) -> Encode:
        """Called once per Python worker; returns texts -> matrix of one row per text."""


class HashEmbedder:
    """Feature hashing: L2-normalised token counts, a fixed function of the text.

    A token is a run of letters, digits and underscores of the lower-cased text;
    its place is the first 32 bits of its MD5 modulo the number of dimensions. It
    stands in for a neural model: same interface, no claim of semantic quality.
    """

    _CACHED_TOKENS = 1 << 18

    def __init__(self, dims: int = DEFAULTS.dims) -> None:
        self.dims = dims

    def load(self) -> Encode:
        tokens = re.compile(r"\w+")
        places: dict[str, int] = {}

        def place(token: str) -> int:
            found = places.get(token)
            if found is None:
                if len(places) >= self._CACHED_TOKENS:
                    places.clear()
                found = int.from_bytes(hashlib.md5(token.encode()).digest()[:4]) % self.dims
                places[token] = found
            return found

        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), self.dims), dtype=np.float64)
            for row, text in zip(out, texts):
                found = [place(token) for token in tokens.findall((text or "").lower())]
                row += np.bincount(found, minlength=self.dims) if found else 0
            norms = np.linalg.norm(out, axis=1, keepdims=True)
            np.divide(out, norms, out=out, where=norms > 0)
            return out.astype(np.float32)

        return encode


def embed(
    df: DataFrame, text: str, embedder: Embedder | None = None, out: str = "embedding"
) -> DataFrame:
    """Add `out`; only the text column travels to the Python worker."""
    model = embedder or HashEmbedder()
    name = name_of(model)

    @arrow_udf("array<float>")
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = loaded(name, model.load)
        for batch in batches:
            matrix = np.ascontiguousarray(encode(batch.to_pylist()), dtype=np.float32)
            rows, dims = matrix.shape
            offsets = np.arange(rows + 1, dtype=np.int32) * dims
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.reshape(-1)))

    # Not to be moved or repeated by the optimiser: the model runs once for each text.
    return df.withColumn(out, vectors.asNondeterministic()(text))
