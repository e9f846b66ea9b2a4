"""Sequential folds: rows of a key in order, batch by batch, with the state carried from one to the next."""

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def ordered(df: DataFrame, key: str, order: str, begin: Callable, step: Callable, schema: str) -> DataFrame:
    """step(state, rows) -> a frame for consecutive rows of one key; begin() is a key's first state.

    Keys are dealt over tasks and sorted there; a task holds one Arrow batch and one state, so a
    trace of any length streams through it."""

    def work(batches):
        state, last, any_ = None, None, False
        for pdf in batches:
            codes = pdf[key].to_numpy()
            cuts = np.flatnonzero(codes[1:] != codes[:-1]) + 1
            for part in np.split(np.arange(len(pdf)), cuts):
                if not len(part):
                    continue
                rows = pdf.iloc[part]
                if not any_ or rows[key].iloc[0] != last:
                    state, last, any_ = begin(), rows[key].iloc[0], True
                yield step(state, rows)

    return df.repartition(key).sortWithinPartitions(key, order).mapInPandas(work, schema)


def frame(rows: pd.DataFrame, columns: list[str], **made) -> pd.DataFrame:
    """Some of the rows' columns, and lists beside them."""
    return pd.DataFrame({c: rows[c].to_numpy() for c in columns} | made)
