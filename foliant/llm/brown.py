"""Operator 6: language-model scores by a Brown class-based bigram model.

P(w | v) = P(class(w) | class(v)) * P(w | class(w)). Texts are lower-cased words and one end, which also
stands before the first word and is a class of its own.

Counting. Texts are dealt to shards by their id. Each shard sends its distinct words' counts, packed and
cut by hash range; a range's task adds them up over all shards and sends the totals back in the same
order, so that a shard gets the corpus counts of its own words and nobody holds the vocabulary. Shards and
ranges both follow the input, and a shard sends a row to each range that it has words of: never more rows
than it has distinct words, so what is shuffled grows with the input and no faster.

Classes. The `head` most frequent words are items of their own; all other words, unseen ones too, are at
first items by spelling (last two bytes and length). Exchange clustering on the items' bigram counts, on
the driver, moves items between classes while the class bigrams' mutual information grows. These are seeds:
every other word that occurs `least` times then moves to the class where the mutual information gains most
by its own neighbours. Its counts of (word, neighbour's class) are sparse and are added up by hash range,
where the words are exchanged against the seeds' class bigrams; classes go back to the shards beside the
counts. Only rarer and unseen words keep their spelling's class. Class bigrams are then counted anew.

Smoothing. Transitions are drawn to the classes' own shares by `strength` pseudo-counts. Emissions are
discounted absolutely (Ney's estimate from counts of one and two); a class gives the mass so freed to its
unseen words, which count as one type in each class. So the probabilities of all texts sum to one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.arrays import SPACED, mix, text_bytes, slices, words
from foliant.llm.frames import bounded, cut, drop

SPELLINGS = 512
END = np.uint64(0)


def _spelled(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The spelling item of words, 0 up to SPELLINGS."""
    last = codes[ends - 1].astype(np.uint64)
    before = np.where(ends - starts > 1, codes[np.maximum(ends - 2, 0)], 0).astype(np.uint64)
    size = np.minimum((ends - starts - 1) // 3, 3).astype(np.uint64)
    return (mix((last << np.uint64(16)) | (before << np.uint64(8)) | (size + np.uint64(1))) % np.uint64(SPELLINGS)).astype(np.int64)


def _tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For ranges of rows i..j: (i, j, row of each word, its hash, its spelling item)."""
    data, offsets = text_bytes(column)
    for i, j in slices(offsets):
        own, part = offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]
        starts, ends, row, value = words(part, own, SPACED)
        value = np.where(value == END, np.uint64(1), value)
        yield i, j, row, value, _spelled(SPACED[part], starts, ends) if len(row) else row


def _distinct(value: np.ndarray) -> np.ndarray:
    value = np.sort(value)
    return value[np.concatenate([[True], value[1:] != value[:-1]])] if len(value) else value


def _cuts(value: np.ndarray, ranges: int) -> np.ndarray:
    edges = (np.arange(1, ranges, dtype=np.uint64) << np.uint64(64 - ranges.bit_length() + 1)) if ranges > 1 else np.zeros(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(value, edges), [len(value)]]).astype(np.int64)


def _shard_counts(ranges: int):
    def run(key, group):
        train = group.column("train").to_numpy().astype(bool)
        values, weights, spelled = [], [], []
        for i, _, row, value, spelling in _tokens(group.column("text")):
            values.append(value)
            weights.append(train[i:][row])
            spelled.append(spelling)
        value, weight, spelling = np.concatenate(values), np.concatenate(weights), np.concatenate(spelled)
        distinct = _distinct(value)
        at = np.searchsorted(distinct, value)
        count = np.bincount(at, weights=weight, minlength=len(distinct)).astype(np.uint32)
        item = np.zeros(len(distinct), dtype=np.uint16)
        item[at] = spelling
        cuts = _cuts(distinct, ranges)
        full = np.flatnonzero(np.diff(cuts))
        pack = lambda x: pa.array([x[cuts[r] : cuts[r + 1]].tobytes() for r in full], pa.binary())
        return pa.table({"shard": pa.array([key[0].as_py()] * len(full), pa.int64()), "range": pa.array(full, pa.int64()), "words": pack(distinct), "counts": pack(count), "items": pack(item)})

    return run


def _range_totals(head: int):
    """Totals of one hash range: a row for each shard (places of its words among the range's), one of the words, one of figures by spelling item, one of the most frequent words."""

    def run(key, group):
        flat = lambda name, kind: np.concatenate([np.frombuffer(x.as_py(), dtype=kind) for x in group.column(name)])
        value, count, item = flat("words", np.uint64), flat("counts", np.uint32), flat("items", np.uint16)
        distinct = _distinct(value)
        at = np.searchsorted(distinct, value)
        total = np.bincount(at, weights=count, minlength=len(distinct)).astype(np.int64)
        spelling = np.zeros(len(distinct), dtype=np.int64)
        spelling[at] = item
        sizes = np.cumsum([0] + [len(x.as_py()) // 8 for x in group.column("words")])
        seen = total > 0
        figures = np.stack([np.bincount(spelling, weights=total, minlength=SPELLINGS), np.bincount(spelling[seen], minlength=SPELLINGS), np.bincount(spelling, weights=total == 1, minlength=SPELLINGS), np.bincount(spelling, weights=total == 2, minlength=SPELLINGS)]).astype(np.int64)
        top = np.lexsort((distinct, -total))[:head]
        top = np.stack([distinct[top], total[top].astype(np.uint64), spelling[top].astype(np.uint64)])
        n = len(sizes) - 1
        return pa.table({
            "kind": pa.array(["shard"] * n + ["words", "figures", "top"]), "shard": pa.concat_arrays([group.column("shard").combine_chunks().cast(pa.int64()), pa.array([None] * 3, pa.int64())]),
            "range": pa.array([key[0].as_py()] * (n + 3), pa.int64()), "packed": pa.array([at[sizes[k] : sizes[k + 1]].astype(np.uint32).tobytes() for k in range(n)] + [np.stack([distinct, total.astype(np.uint64), spelling.astype(np.uint64)]).tobytes(), figures.tobytes(), top.tobytes()], pa.binary()),
        })

    return run


def _items(value: np.ndarray, spelling: np.ndarray, heads: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Items of words: 1 + SPELLINGS + place in the head, or 1 + spelling; item 0 is the end. heads ascend; order gives their places."""
    if not len(heads):
        return 1 + spelling
    at = np.minimum(np.searchsorted(heads, value), len(heads) - 1)
    return np.where(heads[at] == value, 1 + SPELLINGS + order[at], 1 + spelling)


def _bigrams(shared, size: int):
    """Sparse counts of item bigrams over a task's rows: a row for each left item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, order = shared.value
        counts, any_rows = np.zeros(size * size, dtype=np.int64), False
        for batch in batches:
            any_rows |= batch.num_rows > 0
            for i, j, row, value, spelling in _tokens(batch.column(0)):
                n = np.bincount(row, minlength=j - i)
                line = np.zeros(len(row) + (j - i) + 1, dtype=np.int64)
                line[np.arange(len(row)) + row + 1] = _items(value, spelling, heads, order)
                counts += np.bincount(line[:-1] * size + line[1:], minlength=size * size)
                assert len(line) == n.sum() + len(n) + 1
        if any_rows:
            table = counts.reshape(size, size)
            left = np.flatnonzero(table.any(axis=1))
            right = [np.flatnonzero(table[x]) for x in left]
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array([x.astype(np.int32).tobytes() for x in right], pa.binary()), pa.array([table[x, y].tobytes() for x, y in zip(left, right, strict=True)], pa.binary())], names=["left", "right", "n"])

    return run


def _bigram_sums(size: int):
    def run(key, group):
        total = np.zeros(size, dtype=np.int64)
        for right, n in zip(group.column("right"), group.column("n"), strict=True):
            total[np.frombuffer(right.as_py(), dtype=np.int32)] += np.frombuffer(n.as_py(), dtype=np.int64)
        right = np.flatnonzero(total)
        return pa.table({"left": pa.array([key[0].as_py()], pa.int64()), "right": pa.array([right.astype(np.int32).tobytes()], pa.binary()), "n": pa.array([total[right].tobytes()], pa.binary())})

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(counts: np.ndarray, classes: int, passes: int = 8) -> np.ndarray:
    """Classes of items, 0 for item 0 alone, that raise the class bigrams' mutual information by exchange."""
    size = len(counts)
    counts = counts.astype(np.float64)
    weight = counts.sum(axis=0) + counts.sum(axis=1)
    order = 1 + np.argsort(-weight[1:], kind="stable")
    own = np.zeros(size, dtype=np.int64)
    own[order] = 1 + np.arange(size - 1) % (classes - 1)
    member = np.zeros((size, classes))
    member[np.arange(size), own] = 1
    right, left = counts @ member, counts.T @ member
    joint = member.T @ right
    for _ in range(passes):
        moved = 0
        for w in order:
            if weight[w] == 0:
                continue
            a = own[w]
            r, c, self_ = right[w].copy(), left[w].copy(), counts[w, w]
            r[a] -= self_
            c[a] -= self_
            joint[a] -= r
            joint[:, a] -= c
            joint[a, a] -= self_
            rows, cols = joint.sum(axis=1), joint.sum(axis=0)
            base = _xlogx(joint)
            by_row, by_col = _xlogx(joint + r) - base, _xlogx(joint + c[:, None]) - base
            d = np.diag(joint)
            gain = by_row.sum(axis=1) - np.diag(by_row) + by_col.sum(axis=0) - np.diag(by_col) + _xlogx(d + r + c + self_) - _xlogx(d)
            gain -= _xlogx(rows + r.sum() + self_) - _xlogx(rows) + _xlogx(cols + c.sum() + self_) - _xlogx(cols)
            gain[0] = -np.inf
            b = int(np.argmax(gain))
            b = b if gain[b] > gain[a] + 1e-9 else int(a)
            joint[b] += r
            joint[:, b] += c
            joint[b, b] += self_
            if b != a:
                moved += 1
                own[w] = b
                right[:, a] -= counts[:, w]
                right[:, b] += counts[:, w]
                left[:, a] -= counts[w]
                left[:, b] += counts[w]
        if moved <= size // 200:
            break
    return own


def _neighbours(shared, classes: int, ranges: int, most: int = 2_000_000):
    """Sparse counts of (word, class of the word after it, or classes + class of the word before it) for words outside the head, by hash range."""

    def packed(value, code):
        value, code = np.concatenate(value), np.concatenate(code)
        distinct = _distinct(value)
        pair, n = np.unique(np.searchsorted(distinct, value) * (2 * classes) + code, return_counts=True)
        word, cuts = pair // (2 * classes), _cuts(distinct, ranges)
        each, at = np.bincount(word, minlength=len(distinct)), np.searchsorted(word, cuts)
        full = np.flatnonzero(np.diff(cuts))
        pack = lambda x, c, kind: pa.array([x[c[r] : c[r + 1]].astype(kind).tobytes() for r in full], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pack(distinct, cuts, np.uint64), pack(each, cuts, np.uint32), pack(pair % (2 * classes), at, np.uint16), pack(n, at, np.uint32)], names=["range", "words", "each", "codes", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, order, own, _ = shared.value
        values, codes, held = [], [], 0
        for batch in batches:
            for i, j, row, value, spelling in _tokens(batch.column(0)):
                item, at = _items(value, spelling, heads, order), np.arange(len(row)) + row + 1
                line = np.zeros(len(row) + (j - i) + 1, dtype=np.int64)
                line[at] = own[item]
                tail = np.flatnonzero(item <= SPELLINGS)
                if len(tail):
                    values += [value[tail], value[tail]]
                    codes += [line[at[tail] + 1], classes + line[at[tail] - 1]]
                    held += len(tail)
                if held >= most:
                    yield packed(values, codes)
                    values, codes, held = [], [], 0
        if held:
            yield packed(values, codes)

    return run


def moved(own: np.ndarray, joint: np.ndarray, word: np.ndarray, code: np.ndarray, n: np.ndarray, step: int = 20_000) -> np.ndarray:
    """Classes of words by exchange against the class bigrams joint, which stay as they are.

    own are the words' classes so far; word (ascending), code and n their sparse counts of neighbours, as _neighbours makes them.
    """
    classes, out = len(joint), own.copy()
    sums = np.stack([joint.sum(axis=1), joint.sum(axis=0)])
    both = np.concatenate([joint.T, joint])  # by code: the bigrams that each class has with that neighbour
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    for first in range(0, len(starts), step // 8):
        lead = starts[first : first + step // 8]
        stop = starts[first + step // 8] if first + step // 8 < len(starts) else len(word)
        part, rows = slice(lead[0], stop), word[lead]
        a, m, local = own[rows], n[part].astype(np.float64), np.searchsorted(rows, word[part])

        def added(base: np.ndarray, x: np.ndarray, at: np.ndarray) -> np.ndarray:
            gain = _xlogx(base + x[:, None]) - _xlogx(base)
            k = np.arange(len(x))
            gain[k, at] = _xlogx(base[k, at]) - _xlogx(np.maximum(base[k, at] - x, 0))  # without the word itself
            return gain

        gain = np.add.reduceat(added(both[code[part]], m, a[local]), lead - lead[0], axis=0)
        for side in (0, 1):
            total = np.bincount(local, weights=m * ((code[part] >= classes) == side), minlength=len(rows))
            gain -= added(np.broadcast_to(sums[side], (len(rows), classes)), total, a)
        k = np.arange(len(rows))
        stay = gain[k, a]
        gain[:, sums.sum(axis=0) <= 0] = -np.inf  # words that leave for an empty class at once would not be alike
        gain[:, 0], gain[k, a] = -np.inf, stay
        best = np.argmax(gain, axis=1)
        out[rows] = np.where(gain[k, best] > gain[k, a] + 1e-9, best, a)
    return out


def _classed(shared, least: int, classes: int):
    """Of one hash range: for each shard the totals and classes of its words in their order, and a row of tokens and types by class."""

    def run(key, totals, pairs):
        heads, order, own, joint = shared.value
        packed = lambda kind: totals.filter(pc.equal(totals.column("kind"), kind))
        value, total, spelling = np.frombuffer(packed("words").column("packed")[0].as_py(), dtype=np.uint64).reshape(3, -1)
        total, item = total.astype(np.int64), _items(value, spelling.astype(np.int64), heads, order)
        cls = own[item]
        if pairs.num_rows:
            flat = lambda name, kind: np.concatenate([np.frombuffer(x.as_py(), dtype=kind) for x in pairs.column(name)])
            word = np.repeat(np.searchsorted(value, flat("words", np.uint64)), flat("each", np.uint32))
            code, n = flat("codes", np.uint16).astype(np.int64), flat("n", np.uint32)
            stays = total[word] >= least
            cell, at = np.unique(word[stays] * (2 * classes) + code[stays], return_inverse=True)
            cls = moved(cls, joint, cell // (2 * classes), cell % (2 * classes), np.bincount(at, weights=n[stays], minlength=len(cell)))
        shards = packed("shard")
        places = [np.frombuffer(x.as_py(), dtype=np.uint32) for x in shards.column("packed")]
        wide = bool(total.max(initial=0) >= 1 << 32)
        figures = np.stack([np.bincount(cls, weights=total, minlength=classes), np.bincount(cls[total > 0], minlength=classes)]).astype(np.int64)
        return pa.table({
            "shard": pa.concat_arrays([shards.column("shard").combine_chunks().cast(pa.int64()), pa.array([None], pa.int64())]), "range": pa.array([key[0].as_py()] * (len(places) + 1), pa.int64()), "wide": pa.array([wide] * (len(places) + 1)),
            "packed": pa.array([total[x].astype(np.uint64 if wide else np.uint32).tobytes() for x in places] + [figures.tobytes()], pa.binary()), "classes": pa.array([cls[x].astype(np.uint16).tobytes() for x in places] + [b""], pa.binary()),
        })

    return run


class Model:
    """Emission figures of each class."""

    def __init__(self, total: np.ndarray, types: np.ndarray, discount: float, train_tokens: int, vocabulary: int, ends: int):
        self.discount, self.total = discount, total
        self.train_tokens, self.vocabulary, self.ends = train_tokens, vocabulary, ends
        free = np.divide(discount * types, total, out=np.ones(len(total)), where=(total > 0) & (types > 0))
        self.unseen = np.log10(free)

    def emission(self, own: np.ndarray, count: np.ndarray) -> np.ndarray:
        known = np.log10(np.maximum(count - self.discount, 1e-300) / np.maximum(self.total[own], 1))
        return np.where(count > 0, known, self.unseen[own])


def transitions(joint: np.ndarray, strength: float = 32.0) -> np.ndarray:
    """log10 P(class | class before) from class bigrams."""
    share = (joint.sum(axis=0) + 0.5) / (joint.sum() + 0.5 * len(joint))
    return np.log10((joint + strength * share) / (joint.sum(axis=1, keepdims=True) + strength))


def _emitted(shared, classes: int):
    """A row for each text: its figures, the sum of its words' emissions, and its class bigrams."""

    def run(key, texts, counts):
        model = shared.value
        counts = counts.sort_by("range")
        total = [np.frombuffer(x.as_py(), dtype=np.uint64 if w.as_py() else np.uint32).astype(np.int64) for x, w in zip(counts.column("packed"), counts.column("wide"), strict=True)]
        total = np.concatenate(total) if total else np.zeros(0, dtype=np.int64)
        cls = np.concatenate([np.zeros(0, np.uint16), *(np.frombuffer(x.as_py(), dtype=np.uint16) for x in counts.column("classes"))]).astype(np.int64)
        parts = list(_tokens(texts.column("text")))
        value = np.concatenate([p[3] for p in parts]) if parts else np.zeros(0, np.uint64)
        distinct = _distinct(value)
        assert len(distinct) == len(total) == len(cls)
        base_of = lambda c: np.log10((c + 0.5) / (model.train_tokens + 0.5 * (model.vocabulary + 1)))
        base, out = base_of(total), []
        for i, j, row, value, _ in parts:
            at = np.searchsorted(distinct, value)
            line = np.zeros(len(row) + (j - i) + 1, dtype=np.int64)
            line[np.arange(len(row)) + row + 1] = cls[at]
            step = (line[:-1] * classes + line[1:]).astype(np.uint32 if classes > 256 else np.uint16)
            add = lambda r, x: np.bincount(r, weights=x, minlength=j - i)
            n = np.bincount(row, minlength=j - i)
            cuts = np.concatenate([[0], np.cumsum(n + 1)])
            out.append(pa.table({
                "id": texts.column("id").slice(i, j - i), "train": texts.column("train").slice(i, j - i), "n_tokens": pa.array(n + 1, pa.int64()),
                "n_known": pa.array(add(row, total[at] > 0).astype(np.int64) + (model.ends > 0), pa.int64()), "base_score": add(row, base[at]) + base_of(model.ends),
                "emission": add(row, model.emission(cls[at], total[at])) + 0.0, "steps": pa.array([step[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
            }))
        return pa.concat_tables(out)

    return run


def _steps(column: pa.Array, classes: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32 if classes > 256 else np.uint16).astype(np.int64)


def _class_bigrams(classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(classes * classes, dtype=np.int64)
        for batch in batches:
            counts += np.bincount(_steps(batch.column(0), classes), minlength=classes * classes)
        table = counts.reshape(classes, classes)
        left = np.flatnonzero(table.any(axis=1))
        right = np.arange(classes, dtype=np.int32).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array([right] * len(left), pa.binary()), pa.array([table[x].tobytes() for x in left], pa.binary())], names=["left", "right", "n"])

    return run


def _scored(shared, classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chance = shared.value.reshape(-1)
        for batch in batches:
            tokens = batch.column("n_tokens").to_numpy()
            own = np.repeat(np.arange(batch.num_rows), tokens)
            score = np.bincount(own, weights=chance[_steps(batch.column("steps"), classes)], minlength=batch.num_rows) + batch.column("emission").to_numpy()
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(score, pa.float64())], names=[*batch.schema.names[:5], "score"])

    return run


def _power_of_two(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def brown_scores(docs: DataFrame, train: Column, id_column: str = "doc_id", text_column: str = "text", classes: int = 64, head: int = 1024, least: int = 5, shard_bytes: int = 8_000_000, range_bytes: int = 8_000_000) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) for every row of docs.

    train says which rows the model learns from; null counts as false. base_score adds up the words'
    log10((count + 0.5) / (N + 0.5 * (V + 1))). A null or blank text is its end alone. Rows that repeat are
    counted and scored each. Without training rows every figure rests on smoothing alone; an empty table
    gives an empty result. Words compare by 64-bit hashes.
    """
    spark = docs.sparkSession
    bounded(spark)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.col("train").cast("long")), F.lit(0)).alias("ends")).first()
    shards, ranges = int(size["bytes"] // shard_bytes) + 1, _power_of_two(int(size["bytes"] // range_bytes) + 16)
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id", "text"), F.lit(shards)))
    counted = rows.groupBy("shard").applyInArrow(_shard_counts(ranges), "shard long, range long, words binary, counts binary, items binary")
    totals = cut(counted.groupBy("range").applyInArrow(_range_totals(head), "kind string, shard long, range long, packed binary"))
    figures = np.zeros((4, SPELLINGS), dtype=np.int64)
    for row in totals.where("kind = 'figures'").select("packed").toLocalIterator():
        figures += np.frombuffer(row[0], dtype=np.int64).reshape(4, SPELLINGS)
    top = np.zeros((3, 0), dtype=np.uint64)
    for row in totals.where("kind = 'top'").select("packed").toLocalIterator():
        top = np.concatenate([top, np.frombuffer(row[0], dtype=np.uint64).reshape(3, -1)], axis=1)
        top = top[:, np.lexsort((top[0], -top[1].astype(np.int64)))[:head]]
    top = top[:, top[1] > 0]
    ends = int(size["ends"])
    heads, order = np.sort(top[0]), np.argsort(top[0])
    items = 1 + SPELLINGS + head
    shared = spark.sparkContext.broadcast((heads, order))
    sparse = rows.where("train").select("text").mapInArrow(_bigrams(shared, items), "left long, right binary, n binary")
    sums = sparse.groupBy("left").applyInArrow(_bigram_sums(items), "left long, right binary, n binary")
    counts = np.zeros((items, items))
    for row in sums.toLocalIterator():
        counts[row["left"], np.frombuffer(row["right"], dtype=np.int32)] = np.frombuffer(row["n"], dtype=np.int64)
    own = exchange(counts, classes)
    member = np.zeros((items, classes))
    member[np.arange(items), own] = 1
    seeds = spark.sparkContext.broadcast((heads, order, own, member.T @ counts @ member))
    pairs = rows.where("train").select("text").mapInArrow(_neighbours(seeds, classes, ranges), "range long, words binary, each binary, codes binary, n binary")
    words_ = totals.where("kind in ('shard', 'words')")
    back = cut(words_.groupBy("range").cogroup(pairs.groupBy("range")).applyInArrow(_classed(seeds, least, classes), "shard long, range long, wide boolean, packed binary, classes binary"))
    by_class = np.zeros((2, classes), dtype=np.int64)
    for row in back.where("shard is null").select("packed").toLocalIterator():
        by_class += np.frombuffer(row[0], dtype=np.int64).reshape(2, classes)
    by_class[0, 0] += ends
    ones, twos = int(figures[2].sum()), int(figures[3].sum())
    discount = min(0.9, max(0.1, ones / (ones + 2 * twos) if ones else 0.5))
    train_tokens, vocabulary = int(figures[0].sum()) + ends, int(figures[1].sum()) + (ends > 0)
    model = spark.sparkContext.broadcast(Model(by_class[0], by_class[1], discount, train_tokens, vocabulary, ends))
    emitted = rows.groupBy("shard").cogroup(back.where("shard is not null").groupBy("shard")).applyInArrow(_emitted(model, classes), "id long, train boolean, n_tokens long, n_known long, base_score double, emission double, steps binary")
    emitted = cut(emitted)
    drop(totals, back)
    sums = emitted.where("train").select("steps").mapInArrow(_class_bigrams(classes), "left long, right binary, n binary").groupBy("left").applyInArrow(_bigram_sums(classes), "left long, right binary, n binary")
    joint = np.zeros((classes, classes))
    for row in sums.toLocalIterator():
        joint[row["left"], np.frombuffer(row["right"], dtype=np.int32)] = np.frombuffer(row["n"], dtype=np.int64)
    chance = spark.sparkContext.broadcast(transitions(joint))
    scored = emitted.mapInArrow(_scored(chance, classes), "id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("id").alias(id_column), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
