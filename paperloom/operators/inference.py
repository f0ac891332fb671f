"""Models as columns: loaded once per worker, called with whole batches of rows."""

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column
from pyspark.sql.types import ArrayType, DoubleType

from paperloom.operators.embedding import Embedder
from paperloom.operators.retrieval import Scorer


def batch_embedder(load: Callable[[], Callable[[np.ndarray], np.ndarray]], batch_size: int = 256) -> Embedder:
    """``load()`` gives a function from an array of texts to a matrix with a row per text; a null text is an empty one."""
    def prepared() -> Callable[[np.ndarray], np.ndarray]:
        model = load()
        return lambda texts: np.asarray(model(_plain(texts)), float)

    return predict_batch_udf(prepared, return_type=ArrayType(DoubleType()), batch_size=batch_size)


def batch_scorer(load: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]], batch_size: int = 64) -> Scorer:
    """``load()`` gives a function from arrays of questions and texts to their logits; for ``retrieval.rerank``."""
    def prepared() -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        model = load()
        return lambda queries, texts: np.asarray(model(_plain(queries), _plain(texts)), float)

    scored = predict_batch_udf(prepared, return_type=DoubleType(), batch_size=batch_size)

    def score(query: Column, text: Column) -> Column:
        return scored(query, text)

    return score


def _plain(texts: np.ndarray) -> np.ndarray:
    return np.array([t or "" for t in texts], object)
