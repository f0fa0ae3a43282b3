"""Operator 7: benchmark passages in documents, by an FM-index per training shard.

A shard is a run of up to a million and a half words of the documents that a task reads. Words outside the
benchmark's vocabulary end every occurrence of a window, so the indexed text holds the shard's runs of
vocabulary words that are as long as the shortest window, each ended by a separator. Its suffix array
gives the Burrows-Wheeler transform, kept as a wavelet matrix; windows are found by backward search with
the matrix's ranks, all at once, and occurrences located by stepping back to sampled suffix positions.
Marked words merge into removal spans.

The benchmark is taken in blocks of bounded bytes, each a broadcast. Every task applies a pass's blocks, 16 at
most; a larger benchmark takes several passes over the documents, each of which carries on what those before
it marked, and the broadcasts of a pass are gone before the next one's are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.arrays import ALNUM, text_bytes, word_rows, words
from foliant.llm.frames import bounded, cut, drop

WINDOW = 13
SHARD_WORDS = 1_500_000
BLOCK_BYTES = 4_000_000
PASS_BLOCKS = 16
SAMPLE = 8


def windows(items: list[int], texts: list[str], window: int = WINDOW) -> dict:
    """The vocabulary's sorted hashes and, by length, distinct windows of word numbers with their items."""
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    _, _, row, value = words(data, offsets, ALNUM)
    vocabulary, number = np.unique(value, return_inverse=True)
    bound = np.searchsorted(row, np.arange(len(items) + 1))
    found: dict[int, list] = {}
    for k, item in enumerate(items):
        own = number[bound[k] : bound[k + 1]] + 1
        if len(own):
            size = min(window, len(own))
            rows = np.lib.stride_tricks.sliding_window_view(own, size)
            found.setdefault(size, []).append((rows, np.full(len(rows), item)))
    out = {}
    for size, parts in found.items():
        distinct, which = np.unique(np.concatenate([p[0] for p in parts]), axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.reshape(-1), np.concatenate([p[1] for p in parts])], axis=1), axis=0)
        out[size] = (distinct.astype(np.int32), np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1)), pairs[:, 1])
    return {"vocabulary": vocabulary, "windows": out}


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling. Symbol 0 separates, and every 0 is a symbol of its own, in order of place; text ends with 0."""
    n = len(text)
    zero = text == 0
    zeros = int(zero.sum())
    rank = np.where(zero, np.cumsum(zero) - 1, text.astype(np.int64) + zeros - 1)
    bits = np.uint64(max(int(n + text.max(initial=0)).bit_length(), 1))
    small = 3 * int(bits) <= 64
    step = 1
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[: n - step] = rank[step:]
        if small:
            packed = (rank.astype(np.uint64) << (bits + bits)) | (after.astype(np.uint64) << bits) | np.arange(n, dtype=np.uint64)
            packed.sort()
            order = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
            packed >>= bits
            new = np.concatenate([[0], np.cumsum(packed[1:] != packed[:-1])])
        else:
            order = np.lexsort((after, rank))
            new = np.concatenate([[0], np.cumsum((rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1]))])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2


class FMIndex:
    """Backward search and location over a text of word numbers; 0 separates and is never searched."""

    def __init__(self, text: np.ndarray, symbols: int):
        order = suffix_array(text)
        column = text[order - 1]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))]).astype(np.int64)
        self.n, self.levels = len(text), max(int(symbols).bit_length(), 1)
        self.bits, self.ones, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = ((column >> level) & 1).astype(bool)
            self.bits.append(bit)
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]))
            self.zeros.append(int(self.n - self.ones[-1][-1]))
            column = np.concatenate([column[~bit], column[bit]])
        self.base = self._descend(np.arange(symbols + 1), np.zeros(symbols + 1, dtype=np.int64))
        sampled = (order % SAMPLE == 0) | (text[order - 1] == 0)
        self.sampled = np.concatenate([[0], np.cumsum(sampled)])
        self.places = order[sampled]

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            one = self.ones[k][at]
            at = np.where((symbol >> (self.levels - 1 - k)) & 1, self.zeros[k] + one, at - one)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often the symbol stands before `at` in the transform."""
        return self._descend(symbol, at) - self.base[symbol]

    def back(self, at: np.ndarray) -> np.ndarray:
        """Rows of the suffixes that start one place earlier."""
        symbol, k0 = np.zeros(len(at), dtype=np.int64), at
        for k in range(self.levels):
            bit, one = self.bits[k][k0], self.ones[k][k0]
            symbol = (symbol << 1) | bit
            k0 = np.where(bit, self.zeros[k] + one, k0 - one)
        return self.start[symbol] + k0 - self.base[symbol]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of rows whose suffixes start with each row of patterns."""
        low, high = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[live, k].astype(np.int64)
            low[live] = self.start[symbol] + self.rank(symbol, low[live])
            high[live] = self.start[symbol] + self.rank(symbol, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of rows in the text."""
        out, live, steps = np.zeros(len(rows), dtype=np.int64), np.arange(len(rows)), 0
        while len(live):
            done = self.sampled[rows + 1] > self.sampled[rows]
            out[live[done]] = self.places[self.sampled[rows[done]]] + steps
            live, rows = live[~done], rows[~done]
            if len(live):
                rows, steps = self.back(rows), steps + 1
        return out


def marks(value: np.ndarray, row: np.ndarray, block: dict) -> tuple[np.ndarray, np.ndarray]:
    """Whether each word of a shard is hit, and distinct (row, item) pairs."""
    n, vocabulary, by_length = len(value), block["vocabulary"], block["windows"]
    none = np.zeros(n, dtype=bool), np.zeros((0, 2), dtype=np.int64)
    if not n or not by_length:
        return none
    seen = np.zeros(1 << 20, dtype=bool)
    seen[(vocabulary & np.uint64(0xFFFFF)).astype(np.int64)] = True
    maybe = np.flatnonzero(seen[(value & np.uint64(0xFFFFF)).astype(np.int64)])
    number = np.minimum(np.searchsorted(vocabulary, value[maybe]), len(vocabulary) - 1)
    right = vocabulary[number] == value[maybe]
    place, number = maybe[right], number[right].astype(np.int64) + 1
    if not len(place):
        return none
    first = np.concatenate([[True], (np.diff(place) != 1) | (row[place][1:] != row[place][:-1])])
    run = np.cumsum(first) - 1
    keep = np.bincount(run)[run] >= min(by_length)
    place, number, run = place[keep], number[keep], run[keep]
    if not len(place):
        return none
    run = np.cumsum(np.concatenate([[0], np.diff(run) != 0]))
    text = np.zeros(len(place) + int(run[-1]) + 1, dtype=np.int64)
    origin = np.zeros(len(text), dtype=np.int64)
    at = np.arange(len(place)) + run
    text[at], origin[at] = number, place
    index = FMIndex(text, len(vocabulary))
    change, pairs = np.zeros(n + 1, dtype=np.int64), []
    for size, (patterns, begin, items) in by_length.items():
        low, high = index.search(patterns)
        count = high - low
        which = np.repeat(np.arange(len(patterns)), count)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        starts = origin[index.locate(rows)]
        np.add.at(change, starts, 1)
        np.add.at(change, starts + size, -1)
        hit = np.unique(np.stack([row[starts], which], axis=1), axis=0) if len(starts) else np.zeros((0, 2), dtype=np.int64)
        each = begin[hit[:, 1] + 1] - begin[hit[:, 1]]
        item = items[np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(begin[hit[:, 1]], each)]
        pairs.append(np.stack([np.repeat(hit[:, 0], each), item], axis=1))
    return np.cumsum(change[:n]) > 0, np.unique(np.concatenate(pairs), axis=0)


_ROWS = "id long, n_words long, spans array<struct<first: long, after: long>>, items array<long>"


def _found(blocks: list, carried: bool):
    """Of rows (id, text), and with what earlier passes found (spans, items): the same with this pass's."""

    def shard(ids: list, counts: list, values: list, before: list) -> pa.RecordBatch:
        count, value = np.concatenate(counts), np.concatenate(values)
        row = np.repeat(np.arange(len(count)), count)
        begin = np.cumsum(count) - count
        hit, pairs, at = np.zeros(len(value), dtype=bool), [np.zeros((0, 2), dtype=np.int64)], 0
        for spans, items in before:
            for k, (own, found) in enumerate(zip(spans.to_pylist(), items.to_pylist(), strict=True), start=at):
                for x in own:
                    hit[begin[k] + x["first"] : begin[k] + x["after"]] = True
                pairs.append(np.array([(k, x) for x in found], dtype=np.int64).reshape(-1, 2))
            at += len(spans)
        for block in blocks:
            here, found = marks(value, row, block.value)
            hit |= here
            pairs.append(found)
        pairs = np.unique(np.concatenate(pairs), axis=0)
        edge = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else hit
        first = np.flatnonzero(hit & (edge | ~np.concatenate([[False], hit[:-1]]))) if len(row) else np.zeros(0, dtype=np.int64)
        last = np.flatnonzero(hit & (np.concatenate([edge[1:], [True]]) | ~np.concatenate([hit[1:], [False]]))) if len(row) else first
        spans = pa.StructArray.from_arrays([pa.array(first - begin[row[first]], pa.int64()), pa.array(last + 1 - begin[row[first]], pa.int64())], names=["first", "after"])
        place = lambda x: pa.array(np.searchsorted(x, np.arange(len(count) + 1)), pa.int32())
        return pa.RecordBatch.from_arrays([
            pa.concat_arrays(ids), pa.array(count, pa.int64()), pa.ListArray.from_arrays(place(row[first]), spans),
            pa.ListArray.from_arrays(place(pairs[:, 0]), pa.array(pairs[:, 1], pa.int64())),
        ], names=["id", "n_words", "spans", "items"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = ([], [], [], [], []), 0

        def done() -> pa.RecordBatch:
            out = shard(*held[:4])
            if carried:
                out = pa.RecordBatch.from_arrays([*out.columns, pa.concat_arrays(held[4])], names=[*out.schema.names, "text"])
            for part in held:
                part.clear()
            return out

        for batch in batches:
            for i, j, bound, value in word_rows(batch.column(1), ALNUM):
                held[0].append(batch.column(0).slice(i, j - i))
                held[1].append(np.diff(bound))
                held[2].append(value)
                if batch.num_columns > 2:
                    held[3].append((batch.column("spans").slice(i, j - i), batch.column("items").slice(i, j - i)))
                if carried:
                    held[4].append(batch.column(1).slice(i, j - i))
                total += len(value)
                if total >= SHARD_WORDS:
                    yield done()
                    total = 0
        if held[0]:
            yield done()

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """(id, n_words, spans, items, n_hit) for every row of docs.

    spans are the merged ranges of words (first, after) inside occurrences of `window` consecutive words of a
    benchmark item, or of a whole shorter item; items lists the items with occurring windows, ascending. A
    null or wordless text has no words and no hits; repeated rows give repeated results; benchmark rows
    without an id, text or words are ignored, and an empty benchmark hits nothing. Words compare by 64-bit
    hashes. Other columns of either table are not used, so their names can't clash.
    """
    spark = docs.sparkSession
    bounded(spark)
    items = benchmark.select(F.col(item_column).cast("long").alias("item"), F.col(item_text_column).cast("string").alias("text")).where("item is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = int(total // block_bytes) + 1
    found = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    previous = None
    for first in range(0, n, PASS_BLOCKS):
        blocks, last = [], first + PASS_BLOCKS >= n
        for k in range(first, min(first + PASS_BLOCKS, n)):
            rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).orderBy("item", "text").collect()
            blocks.append(spark.sparkContext.broadcast(windows([r[0] for r in rows], [r[1] for r in rows], window)))
        found = found.mapInArrow(_found(blocks, not last), _ROWS if last else f"{_ROWS}, text string")
        if not last:
            found = cut(found)
            for block in blocks:
                block.destroy()
            drop(previous)
            previous, found = found, found.select("id", "text", "spans", "items")
    return found.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["after"] - s["first"])).withColumnRenamed("id", id_column)


def judged(found: DataFrame) -> DataFrame:
    """contamination() with contaminated: at least a twentieth of the words, and at least one, are hit."""
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the words of spans and what stands between them."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    starts, ends, _, _ = words(data, np.array([0, len(data)]), ALNUM, hashed=False)
    raw, out, at = data.tobytes(), [], 0
    for first, after in spans:
        out.append(raw[at : starts[first]])
        at = ends[after - 1]
    return b"".join([*out, raw[at:]]).decode()
