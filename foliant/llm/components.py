"""Connected components by contraction, without a step on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.frames import cut, drop

#: Links that one task may finish. A contracted graph gets there from any size.
FEW = 20_000


def reachable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, to): the smallest id reachable over the links of all batches."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not parts:
        return
    a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, root = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], names=["v", "to"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) links to (id, component): the smallest id reachable, for every id that has a link to another.

    Each round relabels every node by the first of its closed neighbourhood and contracts the graph: first by
    id, which ends stars at once, then by a hash of the id, new each time, and so on in turn; on any graph,
    paths included, hashed rounds take a constant share of the nodes. Joins of a hub's links are joins on a
    key with one row on the other side, which adaptive execution splits. Once few links are left, one task
    finishes them. Null ends and loops are ignored.
    """
    todo = cut(edges.select("a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), narrow=True)
    label = previous = None
    for k in range(rounds):
        n = todo.count()
        if not n:
            break
        if n <= FEW:
            to, new = todo.coalesce(1).mapInArrow(reachable, "v long, to long"), None
        else:
            both = todo.select(F.col("a").alias("v"), F.col("b").alias("u")).unionAll(todo.select(F.col("b").alias("v"), F.col("a").alias("u")))
            rank = lambda c: F.struct((F.xxhash64(F.col(c), F.lit(k)) if k % 2 else F.col(c)).alias("h"), F.col(c).alias("id"))
            to = both.groupBy("v").agg(F.min(rank("u")).alias("u")).select("v", F.least(rank("v"), "u")["id"].alias("to"))
        to = cut(to, narrow=True)
        label = to.select(F.col("v").alias("id"), F.col("to").alias("now")) if label is None else label.join(to.withColumnRenamed("v", "now"), "now", "left").select("id", F.coalesce("to", "now").alias("now"))
        label = cut(label, narrow=True)
        if n > FEW:
            new = todo.join(to.withColumnRenamed("v", "a").withColumnRenamed("to", "x"), "a").join(to.withColumnRenamed("v", "b").withColumnRenamed("to", "y"), "b")
            new = cut(new.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), narrow=True)
        drop(previous, to, todo)
        previous, todo = label, new
        if new is None:
            break
    else:
        raise RuntimeError(f"components: links are left after {rounds} rounds")
    if label is None:
        return todo.select(F.col("a").alias("id"), F.col("a").alias("component"))
    least = label.groupBy("now").agg(F.min("id").alias("component"))
    return label.join(least, "now").select("id", "component")
