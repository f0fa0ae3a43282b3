"""Folds over small groups, many to a batch: a grouped pandas function would start anew for each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Columns = dict[str, np.ndarray]


def _chunks(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Whole groups of sorted frames, and where each starts, with the end. A group over many frames is put together once."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if frame.empty:
            continue
        own = frame[keys]
        before = own.shift()
        if held:
            before.iloc[0] = held[-1][keys].iloc[-1]
        same = (own == before) | (own.isna() & before.isna())
        if not held:
            same.iloc[0] = False
        starts = np.flatnonzero(~same.all(axis=1).to_numpy())
        if not len(starts):
            held.append(frame)
            continue
        last = int(starts[-1])
        if held or last:
            head = [*held, frame.iloc[:last]] if last else held
            size = sum(len(f) for f in held)
            inner = [int(s) + size for s in starts[:-1]] if last else []
            yield pd.concat(head, ignore_index=True), np.array(sorted({0, *inner, sum(len(f) for f in head)}))
        held = [frame.iloc[last:]]
    if held:
        whole = pd.concat(held, ignore_index=True)
        yield whole, np.array([0, len(whole)])


def fold_rows(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[Columns, int, int], list[tuple]], schema: str) -> DataFrame:
    """Rows that fold makes of each group: columns as arrays, and the group's place in them. Rows come by order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [part.split()[0] for part in schema.split(", ")]
        for chunk, starts in _chunks(frames, keys):
            columns = {c: chunk[c].to_numpy() for c in chunk}
            out = [row for a, b in zip(starts, starts[1:], strict=False) for row in fold(columns, int(a), int(b))]
            yield pd.DataFrame(out, columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def fold_column(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[Columns, int, int], np.ndarray], name: str, kind: str) -> DataFrame:
    """df with a column that fold makes of each group."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk, starts in _chunks(frames, keys):
            columns = {c: chunk[c].to_numpy() for c in chunk}
            yield chunk.assign(**{name: np.concatenate([fold(columns, int(a), int(b)) for a, b in zip(starts, starts[1:], strict=False)])})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, f"{schema}, {name} {kind}")
