"""Greedy passes over groups of rows, streamed through tasks instead of one Python call for each group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stretches(df: DataFrame, keys: list[str], along: Column, gap: float) -> DataFrame:
    """df with __stretch, which counts on where neighbours along a number lie more than `gap` apart within their keys.

    Rows that have no number are stretches of their own kind (-1). What compares rows within `gap` only never looks beyond a
    stretch, so that a hot key is cut without any change of results.
    """
    order = Window.partitionBy(*keys).orderBy("__along")
    rows = df.withColumn("__along", along)
    new = F.when(F.col("__along") - F.lag("__along").over(order) <= gap, 0).otherwise(1)
    number = F.when(F.col("__along").isNull(), F.lit(-1)).otherwise(F.sum("__new").over(order))
    return rows.withColumn("__new", new).withColumn("__stretch", number).drop("__new", "__along")


def each_group(df: DataFrame, keys: list[str], order: list[str], step: Callable[[pd.DataFrame], pd.DataFrame], schema, alone: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """step(group) for every group of several rows, in order; rows that are groups of their own go through alone() at once.

    Tasks get whole groups, sorted, and hold no more than a batch and one group.
    """

    def steps(rows: pd.DataFrame, start: np.ndarray, size: np.ndarray) -> Iterator[pd.DataFrame]:
        if (size == 1).any():
            yield alone(rows.iloc[start[size == 1]])
        found = [step(rows.iloc[a : a + n].reset_index(drop=True)) for a, n in zip(start[size > 1], size[size > 1], strict=True)]
        if found:
            yield pd.concat(found)

    return each_batch(df, keys, order, steps, schema)


def each_batch(df: DataFrame, keys: list[str], order: list[str], steps: Callable[[pd.DataFrame, np.ndarray, np.ndarray], Iterator[pd.DataFrame]], schema) -> DataFrame:
    """steps(rows, start, size) for batches of whole groups, in order: group k has the size[k] rows from start[k] on. For many small
    groups, whose frames would cost more than what is done with them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def settle(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            code = rows[keys].ne(rows[keys].shift()) & ~(rows[keys].isna() & rows[keys].shift().isna())
            code.iloc[:1] = True
            start = np.flatnonzero(code.any(axis=1).to_numpy())
            yield from steps(rows, start, np.diff(np.append(start, len(rows))))

        for batch in batches:
            if not len(batch):
                continue
            last = batch[keys].iloc[-1]
            same = ((batch[keys] == last) | (batch[keys].isna() & last.isna())).all(axis=1).to_numpy()
            cut = len(batch) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield from settle(pd.concat([*held, batch.iloc[:cut]]))
                held = []
            held.append(batch.iloc[cut:])
        if held:
            yield from settle(pd.concat(held))

    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInPandas(run, schema)
