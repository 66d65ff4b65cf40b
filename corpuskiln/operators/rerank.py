"""Rerankers: scores of (query, passage) pairs between 0 and 1."""

from __future__ import annotations

import logging
from pathlib import Path
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clamp, sigmoid, words
from .embedding import BATCH, onnx_session

MOST_MB = 600


class Reranker(Protocol):
    def scores(self, query: str, content: Column) -> Column:
        """A column of scores between 0 and 1."""


class Overlap:
    """The share of the query's distinct words that a passage holds."""

    def scores(self, query: str, content: Column) -> Column:
        asked = F.array_distinct(words(F.lit(query)))
        return F.coalesce(F.size(F.array_intersect(asked, words(content))) / F.nullif(F.size(asked), F.lit(0)), F.lit(0.0))


class OnnxReranker:
    """A cross-encoder; refused if twice its file would not fit in MOST_MB."""

    def __init__(self, model: str, tokenizer: str, logits: bool = True) -> None:
        if 2 * Path(model).stat().st_size / 2**20 > MOST_MB:
            raise MemoryError(f"{model} needs more than {MOST_MB} MB")
        self.model, self.tokenizer, self.logits = model, tokenizer, logits

    def scores(self, query: str, content: Column) -> Column:
        model, file, logits = self.model, self.tokenizer, self.logits

        @F.pandas_udf("double")
        def score(batches: pd.Series) -> pd.Series:
            session, tokenizer = onnx_session(model, file)
            out: list[float] = []
            for at in range(0, len(batches), BATCH):
                coded = tokenizer.encode_batch([(query, p or "") for p in batches[at : at + BATCH]])
                fields = {"input_ids": [c.ids for c in coded], "attention_mask": [c.attention_mask for c in coded], "token_type_ids": [c.type_ids for c in coded]}
                raw = session.run(None, {i.name: np.array(fields[i.name], np.int64) for i in session.get_inputs()})[0]
                out += (raw if raw.ndim == 1 else raw[:, -1]).tolist()
            values = np.array(out)
            return pd.Series(1 / (1 + np.exp(-values)) if logits else np.clip(values, 0, 1))

        return score(content)


def as_probability(raw: Column, model_has_logits: Column) -> Column:
    """A model's raw score within 0 and 1: all of a model's scores go the same way."""
    return clamp(F.when(model_has_logits, sigmoid(raw)).otherwise(raw))


def reranked(results: DataFrame, query: str, reranker: Reranker) -> DataFrame:
    """Results with the reranker's score, best first, ties by chunk_id."""
    return results.withColumn("score", reranker.scores(query, F.col("content"))).orderBy(F.desc("score"), "chunk_id")


def reranked_if_possible(results: DataFrame, query: str, reranker: Reranker) -> DataFrame | None:
    """As reranked, evaluated (results are a search's, at most some hundred rows); None if the reranker fails."""
    try:
        ranked = reranked(results, query, reranker)
        return results.sparkSession.createDataFrame(ranked.collect(), ranked.schema)
    except Exception:  # a model may fail in any way
        logging.getLogger(__name__).warning("the reranker failed; results stay in their order", exc_info=True)
        return None
