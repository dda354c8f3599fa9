"""Groups of sorted rows in mapInPandas, many small groups at a time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grouped(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Rows of a key together in one task, in order."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def aside(docs: DataFrame, used: Sequence[str]) -> tuple[DataFrame, dict[str, Column]]:
    """`docs` with all columns but those `used` in one, `_rest`, so that none has the name of another
    table's; and each column's expression in what is joined to it."""
    rest = [c for c in docs.columns if c not in used]
    held = F.struct(F.lit(True).alias("_"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(rest)])
    return docs.select(*used, held.alias("_rest")), {c: F.col(c) for c in used} | {c: F.col(f"_rest.c{k}") for k, c in enumerate(rest)}


def whole_groups(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Frames that hold whole groups, and the first row of each group.

    Arrow batches end anywhere; a group that goes on is held until it is complete.
    """
    kept: list[pd.DataFrame] = []
    for frame in batches:
        if not len(frame):
            continue
        if kept:
            before = tuple(kept[-1][k].iloc[-1] for k in keys)
            if all((frame[k] == v).all() for k, v in zip(keys, before, strict=True)):
                kept.append(frame)
                continue
        frame = pd.concat([*kept, frame], ignore_index=True) if kept else frame.reset_index(drop=True)
        new = changes(frame, keys)
        last = new[-1]
        if last:
            yield frame.iloc[:last].reset_index(drop=True), new[:-1]
        kept = [frame.iloc[last:]]
    if kept:
        frame = pd.concat(kept, ignore_index=True)
        yield frame, changes(frame, keys)


def changes(frame: pd.DataFrame, keys: Sequence[str]) -> np.ndarray:
    new = np.zeros(len(frame), bool)
    new[0] = True
    for k in keys:
        column = frame[k].to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n is connected to by the pairs (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new
