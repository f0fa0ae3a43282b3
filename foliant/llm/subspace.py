"""Operator 8: near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with cosine t or more are within squared distance 2 - 2t. After a random rotation the
coordinates fall into blocks; a block's budget is that squared distance times its share of the
coordinates, and some block of every linked pair keeps its budget. In each block vectors go to the cell
of their nearest centre and look into every cell that can hold a point in reach (the bisecting plane
is no farther than the block's radius): a range join in few dimensions. Of two cells that see each other
only one looks, so every pair meets once a block. The number of cells grows with the vectors, without end.

Cells are compared in tiles of bounded size. Vectors travel packed, a row for each batch and tile. Single
precision products decide all pairs that they can decide by their error bounds; what is left is decided in
double precision, with sums in one fixed order, so that every tile decides alike: the cosine on the vectors
as given, and the budgets of the blocks, as a pair counts in the first block that keeps its budget.

Equal vectors are one node with a weight. Tiles return, for each vector, its number of links and the
smallest id of its component within the tile, never pairs, so that a group of n near copies makes no n * n
rows. Counting all links of such a group is work that grows with its square; it is split over tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.components import components
from foliant.llm.frames import bounded, cut

TILE, SAMPLE, BATCH, EDGE = 8192, 8192, 1024, 1e-9
OWN, FOREIGN = 0, 1


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that their squares neither overflow nor vanish; all else is as given."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _summed(a: np.ndarray, b: np.ndarray, apart: bool) -> np.ndarray:
    """Products of rows, or squares of their differences, added up in the order of the coordinates."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        d = a[:, k] - b[:, k]
        out += d * d if apart else a[:, k] * b[:, k]
    return out


def cell_count(n: int) -> int:
    """Cells of a block: between the square root, which costs least in rows sent, and n / 400, which costs least in pairs compared."""
    return max(4, int(n**0.6 / 40))


class Blocks:
    """Rotation, blocks, budgets and cells for vectors of one length."""

    def __init__(self, sample: np.ndarray, threshold: float, cells: int, blocks: int = 4, seed: int = 7):
        size = sample.shape[1]
        rng = np.random.default_rng(seed)
        self.turn = np.linalg.qr(rng.standard_normal((size, size)))[0]
        self.edges = np.linspace(0, size, min(blocks, size) + 1).astype(int)
        self.count, self.threshold = len(self.edges) - 1, threshold
        self.budget = np.array([(2 - 2 * threshold) * (self.edges[b + 1] - self.edges[b]) / size for b in range(self.count)]) + EDGE
        #: What single precision may be off by, many times over.
        self.doubt = np.float32(1e-5 + 4e-7 * size)
        turned = unit(sample) @ self.turn
        self.centres = [self._centres(self.of(turned, b), min(cells, len(sample)), rng) for b in range(self.count)]
        self.between = [np.sqrt(np.maximum(self._squares(c, c), 1e-30)) for c in self.centres]

    def of(self, turned: np.ndarray, block: int) -> np.ndarray:
        return turned[:, self.edges[block] : self.edges[block + 1]]

    @staticmethod
    def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * (x @ y.T)

    def _centres(self, x: np.ndarray, cells: int, rng) -> np.ndarray:
        centres = x[rng.choice(len(x), cells, replace=False)]
        for _ in range(5):
            own = np.concatenate([self._squares(x[at : at + 1024], centres).argmin(axis=1) for at in range(0, len(x), 1024)])
            n = np.bincount(own, minlength=cells)
            sums = np.stack([np.bincount(own, weights=x[:, k], minlength=cells) for k in range(x.shape[1])], axis=1)
            centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        return np.unique(centres, axis=0)

    def reach(self, turned: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
        """The home cell of each vector, and which other cells it has to look into: of two cells, the sum and order of their numbers say which looks."""
        centres = self.centres[block]
        far = self._squares(self.of(turned, block), centres)
        home, rows, cell = far.argmin(axis=1), np.arange(len(far)), np.arange(len(centres))
        gap = (far - far[rows, home][:, None]) / (2 * self.between[block][home])
        looks = (home[:, None] < cell) ^ ((home[:, None] + cell) % 2 == 1)
        look = (gap <= np.sqrt(self.budget[block]) + 1e-7) & looks
        look[rows, home] = False
        return home, look

    def exactly_turned(self, vectors: np.ndarray) -> np.ndarray:
        """Unit vectors after the rotation, the same numbers whatever else is in the batch."""
        x = scaled(vectors)
        x /= np.sqrt(_summed(x, x, False))[:, None]
        out = np.zeros(x.shape)
        for k in range(x.shape[1]):
            out += x[:, k : k + 1] * self.turn[k]
        return out


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows, in double precision."""
    a, b = scaled(a), scaled(b)
    return _summed(a, b, False) / np.sqrt(_summed(a, a, False) * _summed(b, b, False))


def _counted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = shared.value
        homes = [np.zeros(len(c), dtype=np.int64) for c in blocks.centres]
        looks = [np.zeros(len(c), dtype=np.int64) for c in blocks.centres]
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                turned = unit(_matrix(batch.column(0).slice(at, BATCH))) @ blocks.turn
                for b in range(blocks.count):
                    home, look = blocks.reach(turned, b)
                    homes[b] += np.bincount(home, minlength=len(homes[b]))
                    looks[b] += look.sum(axis=0)
        for b in range(blocks.count):
            yield pa.RecordBatch.from_arrays([pa.array([b] * len(homes[b]), pa.int32()), pa.array(range(len(homes[b])), pa.int32()), pa.array(homes[b]), pa.array(looks[b])], names=["block", "cell", "homes", "looks"])

    return run


def _runs(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each place k of n repeated n[k] times, and the count within its repeats."""
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)


_DEALT = "block int, cell int, kind int, a int, b int, x boolean, ids binary, weights binary, vecs binary"


def _dealt(shared, parts: list[np.ndarray]):
    """Packed rows for tiles. parts: by block, (parts of the own vectors, parts of the foreign ones) of each cell.

    Tiles of kind OWN hold parts a <= b of a cell's own vectors, of kind FOREIGN a part a of the vectors that
    look into the cell and a part b of its own; x says which side a vector is on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                ids, weight, vectors = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2))
                spread = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
                turned, rows = unit(vectors) @ blocks.turn, np.arange(len(ids))
                for b in range(blocks.count):
                    home, look = blocks.reach(turned, b)
                    own, foreign = parts[b]
                    n, mine = own[home], spread % own[home]
                    each, other = _runs(n)
                    low, high = np.minimum(mine[each], other), np.maximum(mine[each], other)
                    dealt = [(each, home[each], OWN, low, high, mine[each] <= other)]
                    again = foreign[home]
                    each, other = _runs(again)
                    dealt.append((each, home[each], FOREIGN, other, mine[each], np.zeros(len(each), bool)))
                    r, cell = np.nonzero(look)
                    each, other = _runs(own[cell])
                    dealt.append((r[each], cell[each], FOREIGN, (spread[r] // 7 % foreign[cell])[each], other, np.ones(len(each), bool)))
                    row, cell, kind, a, c, x = (np.concatenate([np.broadcast_to(d[k], d[0].shape) for d in dealt]) for k in range(6))
                    order = np.lexsort((x, c, a, kind, cell))
                    key = np.stack([cell, kind, a, c, x])[:, order].astype(np.int64)
                    edges = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [len(order)]]) if len(order) else np.zeros(1, int)
                    row = row[order]
                    pack = lambda data: pa.array([data[row[i:j]].tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)], pa.binary())  # noqa: E731, B023
                    first = key[:, edges[:-1]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(edges) - 1, b, np.int32)), *(pa.array(c.astype(np.int32)) for c in first[:4]), pa.array(first[4].astype(bool)), pack(ids), pack(weight), pack(vectors)], names=["block", "cell", "kind", "a", "b", "x", "ids", "weights", "vecs"])

    return run


def _merged(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest places reachable (root) after links a-b are added."""
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if not len(apart := np.flatnonzero(low != high)):
            return root
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]


def _pairs(blocks: Blocks, block: int, x: np.ndarray, y: np.ndarray, same: bool, step: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i in x, j in y) of vectors that link and meet first in this block; i < j where x and y are the same vectors."""
    ux, uy = unit(x), unit(y)
    tx, ty = ux @ blocks.turn, uy @ blocks.turn
    ux, uy, tx, ty = (z.astype(np.float32) for z in (ux, uy, tx, ty))
    one = lambda z: np.ones((len(z), 1), np.float32)
    half = lambda z, b: -(blocks.of(z, b) ** 2).sum(axis=1, keepdims=True) / 2
    # Products of these are minus half the squared distance in a block.
    left = [np.hstack([blocks.of(tx, b), half(tx, b), one(tx)]) for b in range(block + 1)]
    right = [np.hstack([blocks.of(ty, b), one(ty), half(ty, b)]).T.copy() for b in range(block + 1)]
    exact: list = [None, None]

    def turned(side: int, at: np.ndarray) -> np.ndarray:
        if exact[side] is None:
            exact[side] = blocks.exactly_turned((x, y)[side])
        return exact[side][at]

    def linked(i, j):
        return cosine(x[i], y[j]) >= blocks.threshold

    def apart(b):
        return lambda i, j: _summed(blocks.of(turned(0, i), b), blocks.of(turned(1, j), b), True) <= blocks.budget[b]

    for at in range(0, len(x), step):
        part, first = slice(at, at + step), at if same else 0
        reach = lambda b: left[b][part] @ right[b][:, first:]  # noqa: E731, B023
        near = reach(block) >= np.float32(-blocks.budget[block] / 2 - blocks.doubt)
        if same:
            near &= np.arange(near.shape[0])[:, None] < np.arange(near.shape[1])
        found = np.count_nonzero(near)
        if not found:
            continue
        dense = found > 0.02 * near.size
        i, j = np.nonzero(near) if not dense else (None, None)
        j = None if dense else j + first

        def decided(value: np.ndarray, edge: float, slow, held: np.ndarray | None) -> np.ndarray:
            """Whether values reach the edge, by slow(i, j) where single precision can't tell; of a matrix, where held."""
            out, close = value >= edge, np.abs(value - np.float32(edge)) <= blocks.doubt
            if held is None:
                if len(k := np.flatnonzero(close)):
                    out[k] = slow(at + i[k], j[k])  # noqa: B023
            else:
                k, m = np.nonzero(close & held)
                if len(k):
                    out[k, m] = slow(at + k, first + m)  # noqa: B023
            return out

        if dense:
            near &= decided(ux[part] @ uy[first:].T, blocks.threshold, linked, near)
        else:
            keep = decided(np.einsum("ij,ij->i", ux[at + i], uy[j]), blocks.threshold, linked, None)
            i, j = i[keep], j[keep]
        for b in range(block + 1):
            if dense:
                within = decided(reach(b), -blocks.budget[b] / 2, apart(b), near)
                near &= within if b == block else ~within
            else:
                d = blocks.of(tx[at + i], b) - blocks.of(ty[j], b)
                within = decided(-(d * d).sum(axis=1) / 2, -blocks.budget[b] / 2, apart(b), None)
                keep = within if b == block else ~within
                i, j = i[keep], j[keep]
        if dense:
            i, j = np.nonzero(near)
            j += first
        if len(i):
            yield at + i, j


def _linked(shared, kind):
    def run(key, group):
        block, same = key[0].as_py(), key[2].as_py() == OWN and key[3].as_py() == key[4].as_py()
        flat = lambda t, name, dtype: np.concatenate([np.zeros(0, dtype), *(np.frombuffer(v, dtype) for v in t.column(name).to_pylist())])
        sides = [group.filter(group.column("x")), group.filter(pc.invert(group.column("x")))]
        ids, weight = ([flat(t, name, np.int64) for t in sides] for name in ("ids", "weights"))
        vec = [flat(t, "vecs", kind).reshape(-1, len(shared.value.turn)) for t in sides]
        if same:
            vec[1] = vec[0]
        all_ids, all_weight, shift = np.concatenate(ids), np.concatenate(weight), 0 if same else len(ids[0])
        order = np.argsort(all_ids, kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        links, root = np.zeros(len(order)), np.arange(len(order))
        for i, j in _pairs(shared.value, block, vec[0], vec[1], same) if len(vec[0]) and len(vec[1]) else ():
            j = j + shift
            links += np.bincount(i, weights=all_weight[j], minlength=len(order)) + np.bincount(j, weights=all_weight[i], minlength=len(order))
            root = _merged(root, rank[i], rank[j])
        out = np.flatnonzero(links > 0)
        return pa.table({"id": pa.array(all_ids[out]), "links": pa.array(links[out].astype(np.int64)), "least": pa.array(all_ids[order][root[rank[out]]])})

    return run


def near_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", threshold: float = 0.95, cells: int | None = None) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of vectors.

    Links are pairs of cosine >= threshold, ties included. Vectors that are null, empty or zero, or hold null
    or non-finite components, link with nothing, nor do vectors of different lengths. Every row is a vector:
    rows that repeat link with each other, and rows that share an id are one node of the components. A null id
    has a null component and is kept. Centres of cells come from a sample of about 8,192 vectors, or four a
    cell; they and `cells` (None: as many as the vectors ask for) decide how fast a pair is found, not whether.
    Other columns are not used, so their names can't clash.
    """
    spark = vectors.sparkSession
    bounded(spark)
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vec"))
    if "float" not in rows.schema["vec"].dataType.simpleString():
        rows = rows.withColumn("vec", F.col("vec").cast("array<double>"))
    fine = F.size("vec") > 0
    fine &= F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vec", lambda x: x != 0)
    nodes = rows.where(fine & F.col("id").isNotNull()).groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("weight"))
    nodes = cut(nodes.select("id", "weight", "vec", F.size("vec").alias("size")))
    kind = np.float32 if "float" in nodes.schema["vec"].dataType.simpleString() else np.float64
    found = None
    for size, n in sorted(tuple(r) for r in nodes.groupBy("size").count().collect()):
        own = nodes.where(F.col("size") == size)
        count = cells or cell_count(n)
        want = max(SAMPLE, 4 * count)
        share = min(1.0, want / n)
        sample = own.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) <= int(share * (1 << 40))).select("vec").limit(2 * want).toPandas()["vec"].tolist() or [own.select("vec").first()[0]]
        sample = np.array(sorted(map(tuple, sample)), dtype=np.float64)
        shared = spark.sparkContext.broadcast(Blocks(sample, threshold, count))
        counts = own.select("vec").mapInArrow(_counted(shared), "block int, cell int, homes long, looks long").groupBy("block", "cell").agg(F.sum("homes").alias("homes"), F.sum("looks").alias("looks"))
        parts = [np.ones((2, len(c)), dtype=np.int64) for c in shared.value.centres]
        for r in counts.collect():
            parts[r["block"]][:, r["cell"]] = max(1, -(-r["homes"] // TILE)), max(1, -(-r["looks"] // TILE))
        dealt = own.select("id", "weight", "vec").mapInArrow(_dealt(shared, parts), _DEALT)
        part = cut(dealt.groupBy("block", "cell", "kind", "a", "b").applyInArrow(_linked(shared, kind), "id long, links long, least long"))
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = spark.createDataFrame([], "id long, links long, least long")
    label = components(found.select(F.col("id").alias("a"), F.col("least").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    whole = nodes.join(links, "id", "left").join(label, "id", "left").select("vec", "weight", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "id").alias("component"))
    good = rows.where(fine & F.col("id").isNotNull()).join(whole, "vec").select("id", (F.col("links") + F.col("weight") - 1).alias("n_links"), "component")
    rest = rows.where(~F.coalesce(fine & F.col("id").isNotNull(), F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    out = good.unionAll(rest)
    return out.select(F.col("id").alias(id_column), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
