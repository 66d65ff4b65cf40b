"""Embedders: a small interface, called from Arrow batches."""

from __future__ import annotations

import functools
import json
import urllib.request
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH, TOKENS = 32, 512


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray:
        """One row of `dimension` numbers for each text."""


class HashEmbedder:
    """Deterministic vectors from hashed words, of unit length (zero for a text without words)."""

    def __init__(self, dimension: int = 64, seed: int = 0) -> None:
        self.dimension, self.seed = dimension, seed

    def embed(self, texts: list[str]) -> np.ndarray:
        import re

        import xxhash

        out = np.zeros((len(texts), self.dimension))
        for row, text in zip(out, texts, strict=True):
            for word in re.findall(r"\w+", text.lower()):
                h = xxhash.xxh64_intdigest(word, self.seed)
                row[h % self.dimension] += 1 if h >> 63 else -1
        length = np.sqrt((out**2).sum(1, keepdims=True))
        return out / np.where(length > 0, length, 1)


class HttpEmbedder:
    """Posts texts to a server's /api/embed."""

    def __init__(self, url: str, model: str, dimension: int, timeout: float = 30) -> None:
        if not url.startswith(("http://", "https://")):
            raise ValueError(f"not an http(s) URL: {url}")
        self.url, self.model, self.dimension, self.timeout = url.rstrip("/"), model, dimension, timeout

    def embed(self, texts: list[str]) -> np.ndarray:
        body = json.dumps({"model": self.model, "input": texts}).encode()
        request = urllib.request.Request(f"{self.url}/api/embed", body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return checked(np.array(json.load(answer)["embeddings"], float), len(texts), self.dimension)

    def answers(self, within: float = 2) -> bool:
        try:
            return bool(HttpEmbedder(self.url, self.model, self.dimension, within).embed(["probe"]).size)
        except (OSError, ValueError, KeyError):
            return False


@functools.lru_cache(4)
def onnx_session(model: str, tokenizer: str):
    """A model's session and its tokenizer, loaded once in each worker, whatever the number of tasks and batches that come to it."""
    import onnxruntime
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(tokenizer)
    coder.enable_truncation(TOKENS)
    coder.enable_padding()
    return onnxruntime.InferenceSession(model), coder


class OnnxEmbedder:
    """A transformer with its tokenizer; vectors are means over the tokens that count, made unit length."""

    def __init__(self, model: str, tokenizer: str, dimension: int) -> None:
        self.model, self.tokenizer, self.dimension = model, tokenizer, dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        session, tokenizer = onnx_session(self.model, self.tokenizer)
        coded = tokenizer.encode_batch(texts)
        mask = np.array([c.attention_mask for c in coded], np.int64)
        fields = {"input_ids": np.array([c.ids for c in coded], np.int64), "attention_mask": mask, "token_type_ids": np.array([c.type_ids for c in coded], np.int64)}
        hidden = session.run(None, {i.name: fields[i.name] for i in session.get_inputs()})[0]
        pooled = mean_pool(hidden, mask)
        return checked(pooled / np.maximum(np.sqrt((pooled**2).sum(1, keepdims=True)), 1e-12), len(texts), self.dimension)


class Unavailable:
    """Stands where there is no embedder."""

    dimension = 0

    def embed(self, texts: list[str]) -> np.ndarray:
        raise RuntimeError("no embedder is available")


class Swappable:
    """Holds an embedder that can be exchanged for one of the same dimension."""

    def __init__(self, embedder: Embedder) -> None:
        self.embedder, self.dimension = embedder, embedder.dimension

    def swap(self, other: Embedder) -> None:
        if other.dimension != self.dimension:
            raise ValueError(f"dimension {other.dimension} in place of {self.dimension}")
        self.embedder = other

    def embed(self, texts: list[str]) -> np.ndarray:
        return self.embedder.embed(texts)


def available(server: HttpEmbedder, otherwise: Embedder) -> Embedder:
    """The server if it answers a probe, else the other one."""
    return server if server.answers() else otherwise


def checked(vectors: np.ndarray, count: int, dimension: int) -> np.ndarray:
    if vectors.shape != (count, dimension):
        raise ValueError(f"embeddings of shape {vectors.shape} for {count} texts of dimension {dimension}")
    return vectors


def mean_pool(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Means over the positions whose mask isn't 0; zeros where all are."""
    total = (hidden * mask[:, :, None]).sum(1)
    return total / np.maximum(mask.sum(1, keepdims=True), 1)


def embedded(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """Adds embedding (array<float>) of content, in batches of BATCH; the embedder is loaded once a task.

    If chunks have a column error, rows with one aren't embedded, and a text that the embedder refuses gets one; otherwise the
    job fails.
    """
    lenient = "error" in chunks.columns

    def vectors_of(texts: list[str]) -> np.ndarray:
        return checked(np.asarray(embedder.embed(texts)), len(texts), embedder.dimension)

    def singly(texts: list[str]) -> tuple[list, list]:
        found, failed = [], []
        for text in texts:
            try:
                found.append(vectors_of([text])[0])
                failed.append(None)
            except Exception as error:
                found.append(None)
                failed.append(f"embedding: {error!r}")
        return found, failed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                texts = [t or "" for t in batch.column("content").to_pylist()]
                if not lenient:
                    found = list(vectors_of(texts))
                else:
                    errors = batch.column("error").to_pylist()
                    own = [k for k, e in enumerate(errors) if e is None]
                    try:
                        got, failed = list(vectors_of([texts[k] for k in own])) if own else [], [None] * len(own)
                    except Exception:
                        got, failed = singly([texts[k] for k in own])
                    found = [None] * len(texts)
                    for k, vector, error in zip(own, got, failed, strict=True):
                        found[k], errors[k] = vector, error
                    batch = batch.set_column(batch.schema.get_field_index("error"), "error", pa.array(errors, pa.string()))
                lists = pa.array([None if v is None else v.astype(np.float32) for v in found], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "embedding"])

    schema = chunks.withColumn("embedding", F.lit(None).cast("array<float>")).schema
    return chunks.mapInArrow(run, schema)
