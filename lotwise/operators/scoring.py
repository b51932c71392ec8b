"""Batched model scoring and row-expanding functions: the Python edge of the library."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def score_batches(df: DataFrame, vec: str, keep: list[str], model: Callable[[np.ndarray], np.ndarray], batch: int = 512, out: str = "probs") -> DataFrame:
    """Rows through a model in Arrow batches. Filter before this call: nothing is pushed through Python."""
    schema = StructType([df.schema[k] for k in keep]).simpleString()[7:-1].replace(":", " ")
    columns = [*keep, vec]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i:i + batch]
                probs = model(np.stack([np.asarray(v, dtype=np.float64) for v in part[vec].to_numpy()]))
                yield part[keep].assign(**{out: list(probs)})

    return df.select(*columns).mapInPandas(run, f"{schema}, {out} array<double>")


def linear_softmax(weights: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Softmax of a linear head (classes x dims)."""
    def model(x: np.ndarray) -> np.ndarray:
        z = x @ weights.T
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    return model


@F.udtf(returnType="line_no int, n_words int, n_chars int", useArrow=False)
class TextLines:
    """One row per line of a text; blank lines are dropped."""

    def eval(self, text: str):
        for i, line in enumerate((text or "").split("\n")):
            if line.strip():
                yield i, len([w for w in line.split(" ") if w]), len(line)
