"""Run a vectorised function over whole groups, many groups per Arrow batch.

Rows are hashed by key and sorted inside their partition, so groups arrive in runs. Only
the run cut by a batch border is carried over; one call handles all complete groups of a
batch, which avoids a Python call per group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_ids(pdf: pd.DataFrame, keys: Sequence[str]) -> np.ndarray:
    """0-based number of the run of equal keys each row belongs to; nulls are equal."""
    new = np.zeros(len(pdf), dtype=bool)
    for k in keys:
        v = pdf[k].to_numpy()
        null = pdf[k].isna().to_numpy()
        new[1:] |= (v[1:] != v[:-1]) & ~(null[1:] & null[:-1])
    return np.cumsum(new)


def map_groups(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
               fn: Callable[[pd.DataFrame], pd.DataFrame], schema, ranged: bool = False) -> DataFrame:
    """Apply ``fn`` to sorted frames that hold one or more complete groups of bounded size. ``ranged``: a
    partition holds a range of keys, not the keys of one hash."""
    keys = list(keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry = None
        for pdf in frames:
            if carry is not None:
                pdf = pd.concat([carry, pdf], ignore_index=True)
            ids = group_ids(pdf, keys)
            cut = int(np.searchsorted(ids, ids[-1])) if len(ids) else 0
            if cut:
                yield fn(pdf.iloc[:cut].reset_index(drop=True))
            carry = pdf.iloc[cut:].reset_index(drop=True)
        if carry is not None and len(carry):
            yield fn(carry)

    by_key = [F.col(k) for k in keys]
    dealt = df.repartitionByRange(*by_key) if ranged else df.repartition(*by_key)
    return dealt.sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
