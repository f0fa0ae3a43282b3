"""Operator 10: near-duplicate texts by HyperMinHash.

Every text becomes its set of distinct word shingles, held as 64-bit hashes. The set's sketch has 128
registers; the hashes' first seven bits choose a register, and of the smallest hash in it the register
stores the count of leading zeros and the ten bits after the first one. Registers without a hash borrow
from registers drawn by a fixed rule (optimal densification), for the bands only. Bands of four
registers, 32 in all, give candidates: two sets of similarity 0.8 share none with a chance of 5e-8.
Estimates use the raw registers, corrected for registers that agree by accident, and drop only
candidates eight standard errors under the threshold (a link is so lost with a chance of 1e-13, far below that of sharing no band); the rest is confirmed on full sets.

Not all pairs of a bucket are made. Texts with equal sets are one node. First every node is held
against the smallest node of each of its buckets; links found so give classes. Then members of a bucket
whose classes differ are compared by sketches, in tiles of bounded size. Tiles return no pairs but, for
each node, the smallest one that it reaches; nodes so tied are a bundle. In every bundle all members are
held against one of them, drawn anew in each of two rounds, which joins most classes at the cost of a row a
member. What is left are members of small classes: their whole sets are compared with those of all members
of the bundle, in tiles of bounded rows and shingles, so a large class meets the others but not itself. So no
link between different classes is lost whatever the size of a bucket, and no step makes a row for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.arrays import mix, shingles, text_bytes, word_rows
from foliant.llm.components import reachable, components
from foliant.llm.frames import bounded, cut, maybe_in

REGISTERS, ROWS, MANTISSA, REST = 128, 4, 10, 57
BANDS = REGISTERS // ROWS
TILE, BUNDLE, BUNDLE_SHINGLES, PEELS = 1024, 128, 200_000, 2
_LOWEST = (np.arange(REGISTERS, dtype=np.uint64) << np.uint64(REST)).astype(np.uint64)
_DONORS = (mix(np.arange(1, REGISTERS * 96 + 1, dtype=np.uint64)) >> np.uint64(REST)).astype(np.int64).reshape(96, REGISTERS)
_BAND = mix(np.arange(1000, 1000 + REGISTERS, dtype=np.uint64)) | np.uint64(1)
EMPTY = 0xFFFF


def registers(hashes: np.ndarray) -> np.ndarray:
    """The sketch of an ascending set of hashes: 128 numbers of 16 bits, 0xFFFF for a register without a hash."""
    at = np.searchsorted(hashes, _LOWEST)
    least = hashes[np.minimum(at, len(hashes) - 1)]
    here = (at < len(hashes)) & ((least >> np.uint64(REST)) == np.arange(REGISTERS, dtype=np.uint64))
    rest = least & np.uint64((1 << REST) - 1)
    bits = np.frexp(rest.astype(np.float64))[1].astype(np.int64)  # bit length; rounding up at a power of two keeps equal inputs equal
    zeros = np.minimum(REST - np.minimum(bits, REST), 62)
    top = np.where(bits > MANTISSA, rest >> np.maximum(bits - 1 - MANTISSA, 0).astype(np.uint64), rest)
    value = (zeros << MANTISSA) | (top.astype(np.int64) & ((1 << MANTISSA) - 1))
    return np.where(here, value, EMPTY).astype(np.uint16)


def bands(grid: np.ndarray) -> np.ndarray:
    """32 keys for each row of sketches; every sketch has at least one register with a hash."""
    full = grid.copy()
    for r in np.flatnonzero((grid == EMPTY).any(axis=1)):
        sketch = grid[r]
        need = np.flatnonzero(sketch == EMPTY)
        for row in _DONORS:
            full[r, need] = sketch[row[need]]
            need = need[full[r, need] == EMPTY]
            if not len(need):
                break
        if len(need):
            have = np.flatnonzero(sketch != EMPTY)
            full[r, need] = sketch[have[np.searchsorted(have, need) % len(have)]]
    spread = mix(full.astype(np.uint64) + np.uint64(1)) * _BAND
    return mix(spread.reshape(-1, ROWS, BANDS).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def matches(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(estimate, registers of the union) for rows of sketches, corrected for accidental agreement."""
    same = a == b
    used = (a != EMPTY) | (b != EMPTY)
    n = used.sum(axis=1)
    agree = (same & used).sum(axis=1)
    chance = (same.shape[1] and 2.0 ** -(MANTISSA + 1)) * n
    return np.clip((agree - chance) / np.maximum(n - chance, 1e-9), 0, 1), n


def plausible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, similarity: float) -> np.ndarray:
    """Whether pairs of sketches and set sizes can have the similarity."""
    guess, n = matches(a, b)
    slack = 8 * np.sqrt(similarity * (1 - similarity) / np.maximum(n, 1))
    least, most = np.minimum(na, nb), np.maximum(na, nb)
    return (least >= (similarity - 1e-9) * most) & ((guess >= similarity - slack) | (most <= 32))


def _sketched(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, bound, value in word_rows(batch.column(1)):
                n, low, high, regs = [], [], [], []
                for r in range(j - i):
                    own = shingles(value[bound[r] : bound[r + 1]], size)
                    n.append(len(own))
                    low.append(int(mix(own + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)) if len(own) else 0)
                    high.append(int(mix(own ^ np.uint64(0x5DEECE66D1234567)).sum(dtype=np.uint64).view(np.int64)) if len(own) else 0)
                    regs.append(registers(own).tobytes() if len(own) else None)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(regs, pa.binary())], names=["id", "n", "low", "high", "regs"])

    return run


def _grid(column: pa.Array) -> np.ndarray:
    raw, offsets = text_bytes(column)
    return np.frombuffer(raw.tobytes(), dtype=np.uint16).reshape(len(offsets) - 1, REGISTERS)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys = bands(_grid(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(keys)), BANDS))), pa.array(keys.reshape(-1))], names=["id", "key"])


def _filtered(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ok = plausible(_grid(batch.column(4)), _grid(batch.column(5)), batch.column(2).to_numpy(), batch.column(3).to_numpy(), similarity)
                yield batch.select([0, 1]).filter(pa.array(ok))

    return run


def _sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    for i, j, bound, value in word_rows(column):
        for r in range(j - i):
            yield shingles(value[bound[r] : bound[r + 1]], size)


def _confirmed(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(_sets(batch.column(2), size), _sets(batch.column(3), size), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
            if any(ok):
                yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return run


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of complete groups, from batches sorted by keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy() for k in keys])
        new = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        if held and any(held[-1].column(k)[held[-1].num_rows - 1].as_py() != batch.column(k)[0].as_py() for k in keys):
            new = np.concatenate([[0], new])
        if not len(new):
            held.append(batch)
            continue
        held.append(batch.slice(0, int(new[-1])))
        yield pa.Table.from_batches(held).combine_chunks()
        held = [batch.slice(int(new[-1]))]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _forest(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch | None:
    """Links (a, b) as links of each id to the smallest that it reaches over them: one row an id, not one a pair."""
    found = list(reachable(iter([pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])]))) if len(a) else []
    if not found:
        return None
    moved = np.flatnonzero(found[0].column(0).to_numpy() != found[0].column(1).to_numpy())
    return pa.RecordBatch.from_arrays([found[0].column(1), found[0].column(0)], names=["a", "b"]).take(pa.array(moved))


def _groups(table: pa.Table, keys: list[str]) -> np.ndarray:
    key = np.stack([table.column(k).to_numpy() for k in keys])
    return np.cumsum(np.concatenate([[0], (key[:, 1:] != key[:, :-1]).any(axis=0)]))


def _crossed(similarity: float):
    """Of each tile, links that join members whose classes differ and whose sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["key", "x", "y"]):
            ids, label, n, side = (table.column(k).to_numpy() for k in ("id", "label", "n", "side"))
            tile, lone = _groups(table, ["key", "x", "y"]), table.column("x").to_numpy() == table.column("y").to_numpy()
            grid, a, b = _grid(table.column("regs")), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for lag in range(1, int(np.bincount(tile).max())):
                at = np.flatnonzero(tile[lag:] == tile[:-lag])
                at = at[(label[at] != label[at + lag]) & (lone[at] | (side[at] != side[at + lag]))]
                for part in np.array_split(at, len(at) // 65536 + 1):
                    part = part[plausible(grid[part], grid[part + lag], n[part], n[part + lag], similarity)]
                    a.append(ids[part])
                    b.append(ids[part + lag])
            if (out := _forest(np.concatenate(a), np.concatenate(b))) is not None:
                yield out

    return run


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets on the left with all on the right, by products of blocks of the incidence matrix."""
    n, m = len(left), len(right)
    out = np.zeros((n, m), dtype=np.float32)
    value, column = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    row = np.repeat(np.arange(n + m), [len(s) for s in (*left, *right)])
    both = (np.bincount(column[row < n], minlength=len(value)) > 0) & (np.bincount(column[row >= n], minlength=len(value)) > 0)
    number, keep = np.cumsum(both) - 1, both[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, int(both.sum()), width):
        low, high = np.searchsorted(column, [at, at + width])
        block = np.zeros((n + m, width), dtype=np.float32)
        block[row[low:high], column[low:high] - at] = 1
        out += block[:n] @ block[n:].T
    return out


def _held(size: int, percent: int):
    """Of each tile of a bundle, confirmed links between its sides' members whose classes differ, on whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["bundle", "x", "y"]):
            ids, label, side = (table.column(k).to_numpy() for k in ("id", "label", "side"))
            tile = _groups(table, ["bundle", "x", "y"])
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for low, high in zip(edges := np.flatnonzero(np.diff(tile, prepend=-1)), [*edges[1:], len(tile)], strict=True):
                sets = list(_sets(table.column("text").slice(low, high - low), size))
                first, second = (np.flatnonzero(side[low:high] == k) for k in (0, 1))
                if not len(first) or not len(second):
                    continue
                both = shared_counts([sets[k] for k in first], [sets[k] for k in second])
                n = np.array([len(s) for s in sets])
                ok = (100 * both >= percent * (n[first][:, None] + n[second] - both)) & (both > 0) & (label[low + first][:, None] != label[low + second])
                i, j = np.nonzero(ok)
                a.append(ids[low + first[i]])
                b.append(ids[low + second[j]])
            if (out := _forest(np.concatenate(a), np.concatenate(b))) is not None:
                yield out

    return run


def _tiled(members: DataFrame, key: str, size: int) -> DataFrame:
    """Members of groups (key, id, ...) dealt to tiles: pairs x <= y of parts of their group with about `size` rows each."""
    tiles = members.groupBy(key).agg(F.ceil(F.count("*") / size).cast("int").alias("_tiles"))
    rows = members.join(tiles, key).withColumn("_t", F.pmod(F.xxhash64("id"), F.col("_tiles")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    return rows.withColumns({"x": F.least("_t", "_o"), "y": F.greatest("_t", "_o"), "side": (F.col("_t") < F.col("_o")).cast("int")}).drop("_tiles", "_t", "_o")


def _small(table: DataFrame, most: int = 200_000) -> DataFrame:
    """A table of a row a bundle, written, and broadcast if it has few rows: a bundle with many members is then not dealt to one task. Beyond that adaptive execution splits its join."""
    table = cut(table, narrow=True)
    return F.broadcast(table) if table.count() <= most else table


def _against_others(bundle: DataFrame) -> DataFrame:
    """Members of bundles (bundle, id, label, n) dealt to tiles: members outside the largest class of their bundle (side 0) against all members (side 1)."""
    sizes = bundle.groupBy("bundle", "label").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    parts = lambda c, s: F.greatest(F.lit(1), F.ceil(c / F.lit(BUNDLE)), F.ceil(s / F.lit(BUNDLE_SHINGLES))).cast("int")
    whole = sizes.groupBy("bundle").agg(F.max_by(F.struct("label", "c", "s"), F.struct("c", "label")).alias("most"), F.sum("c").alias("c"), F.sum("s").alias("s"))
    whole = whole.select("bundle", F.col("most.label").alias("large"), parts(F.col("c") - F.col("most.c"), F.col("s") - F.col("most.s")).alias("px"), parts(F.col("c"), F.col("s")).alias("py"))
    rows = bundle.join(_small(whole), "bundle").withColumns({"ix": F.pmod(F.xxhash64("id"), F.col("px")).cast("int"), "iy": F.pmod(F.xxhash64("id", F.lit(1)), F.col("py")).cast("int")})
    other = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    small = rows.where("label <> large").select("bundle", "id", "label", F.col("ix").alias("x"), other("py").alias("y"), F.lit(0).alias("side"))
    return small.unionAll(rows.select("bundle", "id", "label", other("px").alias("x"), F.col("iy").alias("y"), F.lit(1).alias("side")))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of docs.

    Texts link whose shingle sets have 100 * intersection >= percent * union, confirmed on whole sets of
    64-bit hashes. kept: the id is its component's smallest. Rows that share an id are one node. A null or
    blank text has the empty set and links with nothing; a row whose id is null has a null component and is
    kept. Other columns of docs are not used, so their names can't clash.
    """
    similarity, spark = percent / 100, docs.sparkSession
    bounded(spark)
    ids = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    sk = cut(ids.mapInArrow(_sketched(size), "id long, n long, low long, high long, regs binary"))
    same = ["n", "low", "high"]
    own = cut(sk.where("n > 0 and id is not null").groupBy(*same).agg(F.min("id").alias("id"), F.max("id").alias("last"), F.any_value("regs").alias("regs")))
    twins = sk.where("id is not null").select("id", *same).join(own.where("id <> last").select(F.col("id").alias("a"), *same), same).where("id <> a").select("a", F.col("id").alias("b"))
    keyed = own.select("id", "regs").mapInArrow(_keyed, "id long, key long")
    lead = keyed.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead <> last").select("key", "lead")
    keyed = cut(keyed.join(lead, "key").select("key", "id", "lead"))
    pairs = cut(keyed.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct(), narrow=True)

    ends = lambda p: p.select(F.explode(F.array("a", "b")).alias("a"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Links among pairs (a, b), already cut: by sketches first, what they allow on whole sets."""
        some = maybe_in(own.select("id", "n", "regs"), "id", ends(pairs))
        sketch = lambda side: some.select(F.col("id").alias(side), F.col("n").alias(f"n{side}"), F.col("regs").alias(f"r{side}"))
        pairs = pairs.join(sketch("a"), "a").join(sketch("b"), "b").select("a", "b", "na", "nb", "ra", "rb").mapInArrow(_filtered(similarity), "a long, b long")
        pairs = cut(pairs, narrow=True)
        given = maybe_in(ids, "id", ends(pairs))
        text = lambda side: given.select(F.col("id").alias(side), F.col("text").alias(f"t{side}"))
        return pairs.join(text("a"), "a").join(text("b"), "b").select("a", "b", "ta", "tb").mapInArrow(_confirmed(size, percent), "a long, b long")

    first = cut(confirmed(pairs).unionAll(twins))
    label = cut(components(first), narrow=True)
    classed = cut(keyed.join(label, "id", "left").select("key", "id", F.coalesce("component", "id").alias("label")), narrow=True)
    mixed = classed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    member = cut(_tiled(classed.join(mixed, "key", "left_semi"), "key", TILE), narrow=True)
    member = member.join(maybe_in(own.select("id", "n", "regs"), "id", member.select("id")), "id")
    crossed = member.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(_crossed(similarity), "a long, b long")
    bundle = components(crossed).withColumnRenamed("component", "bundle")
    bundle = bundle.join(own.select("id", "n"), "id").join(label, "id", "left").select("bundle", "id", "n", F.coalesce("component", "id").alias("start"))
    bundle = cut(bundle.withColumn("label", F.col("start")), narrow=True)
    name = lambda side: bundle.select(F.col("id").alias(side), F.col("start").alias(f"l{side}"))
    classes = lambda links: links.join(name("a"), "a").join(name("b"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    between = None
    for k in range(PEELS + 1):
        if bundle.isEmpty():
            break
        if k < PEELS:
            chosen = bundle.groupBy("bundle").agg(F.min_by(F.struct("id", "label"), F.xxhash64("id", F.lit(k))).alias("lead"))
            some = bundle.join(_small(chosen), "bundle").where("label <> lead.label").select(F.col("lead.id").alias("a"), F.col("id").alias("b"))
            found = classes(confirmed(cut(some, narrow=True)))
        else:
            full = maybe_in(ids, "id", bundle.select("id"))
            held = _against_others(bundle).join(full, "id").select("bundle", "x", "y", "side", "id", "label", "text")
            found = classes(held.repartition("bundle", "x", "y").sortWithinPartitions("bundle", "x", "y").mapInArrow(_held(size, percent), "a long, b long"))
        found = cut(found, narrow=True)
        between = found if between is None else between.unionAll(found)
        merged = cut(components(between), narrow=True)
        if k < PEELS:
            bundle = bundle.join(merged.select(F.col("id").alias("start"), "component"), "start", "left").select("bundle", "id", "n", "start", F.coalesce("component", "start").alias("label"))
            open_ = bundle.groupBy("bundle").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bundle")
            bundle = cut(bundle.join(_small(open_), "bundle", "left_semi"), narrow=True)
    merged = spark.createDataFrame([], "class long, whole long") if between is None else merged.select(F.col("id").alias("class"), F.col("component").alias("whole"))
    out = sk.select("id", "n").join(label, "id", "left").withColumn("class", F.coalesce("component", "id")).drop("component")
    out = out.join(merged, "class", "left").withColumn("component", F.coalesce("whole", "class"))
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
