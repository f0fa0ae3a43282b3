"""Operator 9: language by Bayesian evidence fusion.

log P(language | all) = log P(text | language) + log P(declared | language) + log P(suffix | language)
+ log P(language | host) + constant. The text's likelihood is naive Bayes over hashed byte trigrams, fitted
on a bounded sample of rows of each declared language, and tempered: a trigram counts less the more there
are, as neighbouring ones repeat each other. The other three come from one grouped aggregation over all
rows: how often languages read from text alone meet declarations, address suffixes, hosts and their
domains. A host's prior is its counts drawn to its domain's, which are drawn to the whole corpus's.

One more hypothesis is that the text is in none of the languages: all trigrams are alike to it, declarations
and suffixes have their shares of the corpus, and its prior is NONE. So texts whose trigrams the best
language hasn't seen (another script, random letters) are in none.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from foliant.llm.arrays import slices, text_bytes
from foliant.llm.frames import bounded, cut

BUCKETS, ENOUGH, NONE = 1 << 14, 200.0, 0.001
_LETTER = np.full(256, 1, dtype=np.uint32)
for _b in (*range(0x61, 0x7B), *range(0x80, 0x100)):
    _LETTER[_b] = _b
for _b in range(0x41, 0x5B):
    _LETTER[_b] = _b + 32


def _trigrams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges of rows i..j: (i, j, row, bucket) of trigrams with a letter in their middle."""
    data, offsets = text_bytes(column)
    for i, j in slices(offsets):
        code = _LETTER[data[offsets[i] : offsets[j]]]
        if len(code) < 1:
            yield i, j, np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        own = offsets[i : j + 1] - offsets[i]
        before, after = np.concatenate([[np.uint32(1)], code[:-1]]), np.concatenate([code[1:], [np.uint32(1)]])
        edge = own[:-1][own[:-1] < own[1:]]
        before[edge] = 1
        after[own[1:][own[:-1] < own[1:]] - 1] = 1
        at = np.flatnonzero(code != 1)
        packed = (before[at] << np.uint32(16)) | (code[at] << np.uint32(8)) | after[at]
        bucket = ((packed * np.uint32(2654435761)) >> np.uint32(32 - 14)).astype(np.int64)
        yield i, j, np.searchsorted(own, at, side="right") - 1, bucket


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigrams of a task's rows by language; only languages it met."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        names, own = np.unique(np.array(batch.column(1).to_pylist(), dtype=object), return_inverse=True)
        for i, _, row, bucket in _trigrams(batch.column(0)):
            of = own[i:][row]
            for k in np.unique(of):
                total[names[k]] = total.get(names[k], 0.0) + np.bincount(bucket[of == k], minlength=BUCKETS).astype(float)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([t.tobytes() for t in total.values()], pa.binary())], names=["lang", "n"])


class Trigrams:
    """log P(trigram | language) of the languages that rows declare."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        self.table = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS))


def fit(rows: DataFrame, sample: int = 20_000, least: int = 5, each: int = 500) -> Trigrams:
    """Trigrams of every language that `least` rows declare. rows: (text, declared).

    About sample / languages rows of each are read, `each` at least, or as many as there are.
    """
    known = rows.where("declared is not null and text is not null")
    found = {r[0]: r[1] for r in known.groupBy("declared").count().where(F.col("count") >= least).orderBy(F.desc("count"), "declared").collect()}
    names = list(found)
    counts = np.zeros((len(names), BUCKETS))
    if names:
        want = max(each, sample // len(names))
        share = rows.sparkSession.createDataFrame([(x, int(min(1.0, want / n) * (1 << 40)) + 1) for x, n in found.items()], "_lang string, _share long")
        part = known.join(F.broadcast(share), F.col("declared") == F.col("_lang")).where(F.pmod(F.xxhash64("text"), F.lit(1 << 40)) < F.col("_share"))
        place = {x: k for k, x in enumerate(names)}
        for lang, packed in part.select("text", "declared").mapInArrow(_counted, "lang string, n binary").toLocalIterator():
            counts[place[lang]] += np.frombuffer(packed)
    return Trigrams(names, counts)


def _likely(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for i, j, row, bucket in _trigrams(batch.column(0)):
                n = np.bincount(row, minlength=j - i)
                soft = np.minimum(1.0, ENOUGH / np.maximum(n, 1))
                scores = np.stack([*(np.bincount(row, weights=t[bucket], minlength=j - i) * soft for t in model.table), -np.log(BUCKETS) * n * soft], axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, scores.size + 1, scores.shape[1]), pa.int32()), pa.array(scores.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(1, batch.num_columns)), pa.array(n, pa.int64()), lists], names=[*batch.schema.names[1:], "letters", "scores"])

    return run


def evidence(key: Column, text: Column, declared: Column, host: Column) -> list[Column]:
    """The operator's input: declared languages and hosts lower-cased, blank ones null; the suffix and domain are the host's last labels."""
    tidy = lambda c: F.nullif(F.lower(F.trim(c.cast("string"))), F.lit(""))
    name = tidy(host)
    return [
        text.cast("string").alias("text"), key.alias("key"), F.nullif(F.regexp_extract(tidy(declared), r"^([a-z]+)", 1), F.lit("")).alias("declared"), name.alias("host"),
        F.coalesce(F.nullif(F.regexp_extract(name, r"([^.]+\.[^.]+)$", 1), F.lit("")), name).alias("domain"), F.nullif(F.regexp_extract(name, r"\.([^.]+)$", 1), F.lit("")).alias("suffix"),
    ]


def identify(rows: DataFrame, model: Trigrams, strength: float = 8.0, confidence: float = 0.5, broadcast_rows: int = 200_000) -> DataFrame:
    """(key, declared, language, confidence, accepted) for every row of evidence().

    A row is accepted if its text holds a letter and its best language's posterior, with none of the
    languages as a hypothesis, is `confidence` or more. language is the best one all the same.
    Of equal ones the language that more rows declare wins, then the first by name. Repeated rows are counted
    and judged each, and alike. Null, empty and letterless texts are judged by the other evidence, and not accepted. A null or unknown
    declaration, suffix or host says nothing. Without a fitted language, language is null, and every text
    with a letter is accepted.
    """
    spark, names = rows.sparkSession, model.languages
    bounded(spark)
    if not names:
        return rows.select("key", "declared", F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("confidence"), F.coalesce(F.col("text").rlike(r"[A-Za-z]|[^\x00-\x7F]"), F.lit(False)).alias("accepted"))
    key = rows.schema["key"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model)
    scored = cut(rows.select("text", "key", "declared", "host", "domain", "suffix").mapInArrow(_likely(shared), f"key {key}, declared string, host string, domain string, suffix string, letters long, scores array<double>"))
    best = F.array_position("scores", F.array_max("scores")).cast("int")
    seen = cut(scored.where("letters > 0").groupBy("declared", "host", "domain", "suffix", best.alias("l")).count().where(F.col("l") <= len(names)))
    size = range(1, len(names) + 1)
    vector = [F.coalesce(F.sum(F.when(F.col("l") == k, F.col("count"))), F.lit(0)).cast("double").alias(f"n{k}") for k in size]
    zero = dict.fromkeys((f"n{k}" for k in size), 0.0)
    all_ = seen.agg(*vector).first().asDict()
    total = sum(all_.values())
    root = {k: (all_[f"n{k}"] + 1) / (total + len(names)) for k in size}

    def given(column: str, out: str) -> DataFrame:
        """log P(value | language) for each value of a column, drawn to the value's own share."""
        each = seen.where(F.col(column).isNotNull()).groupBy(column).agg(*vector)
        whole = each.agg(*(F.coalesce(F.sum(f"n{k}"), F.lit(0.0)).alias(f"n{k}") for k in size)).first().asDict()
        share = sum(F.col(f"n{k}") for k in size) / (sum(whole.values()) or 1.0)
        return each.select(F.col(column).alias(f"_{out}"), F.array(*(F.log((F.col(f"n{k}") + strength * share) / (whole[f"n{k}"] + strength)) for k in size), F.log(share)).alias(out))

    domain = seen.where("domain is not null").groupBy("domain").agg(*vector)
    sums = sum(F.col(f"n{k}") for k in size)
    domain = domain.select(F.col("domain").alias("_dom"), *((F.col(f"n{k}") + strength * root[k]).alias(f"d{k}") for k in size), (sums + strength).alias("d"))
    host = seen.where("host is not null").groupBy("host", "domain").agg(*vector).join(domain, F.col("domain") == F.col("_dom"))
    host = host.select(F.col("host").alias("_host"), F.array(*(F.log((F.col(f"n{k}") + strength * F.col(f"d{k}") / F.col("d")) / (sums + strength)) for k in size), F.lit(float(np.log(NONE)))).alias("prior"))
    out = scored
    for table, own, column in ((given("declared", "by_declared"), "_by_declared", "declared"), (given("suffix", "by_suffix"), "_by_suffix", "suffix"), (host, "_host", "host")):
        table = cut(table)
        out = out.join(F.broadcast(table) if table.count() <= broadcast_rows else table, F.col(column) == F.col(own), "left")
    nothing = F.array(*(F.lit(0.0) for _ in (*size, 0)))
    start = F.array(*(F.lit(float(np.log(x))) for x in (*root.values(), NONE)))
    term = lambda c: F.coalesce(F.col(c), nothing)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    post = add(add(F.col("scores"), term("by_declared")), add(term("by_suffix"), F.coalesce("prior", start)))
    out = out.withColumn("post", post).withColumn("top", F.array_max(F.slice("post", 1, len(names))))
    chance = F.lit(1.0) / F.aggregate("post", F.lit(0.0), lambda t, x: t + F.exp(x - F.col("top")))
    name = F.element_at(F.array(*(F.lit(x) for x in names)), F.array_position("post", F.col("top")).cast("int"))
    return out.select("key", "declared", name.alias("language"), chance.alias("confidence"), ((F.col("letters") > 0) & (chance >= confidence)).alias("accepted"))


def page_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)


_SKIPPED = re.compile(r"<(?:!--|(script|style)(?=[\s/>]))", re.I)
_ENDS = {name: re.compile(f"</{name}[^>]*>", re.I) for name in ("script", "style")}
_TAG = re.compile(r"<[^<>]*>")


def visible(html: str) -> str:
    """Text of a page without comments, scripts, styles and tags, in one run over it; what has no end goes to the end of the page."""
    out, at = [], 0
    while found := _SKIPPED.search(html, at):
        out.append(html[at : found.start()])
        name = found[1]
        if name is None:
            stop = html.find("-->", found.end())
            at = len(html) if stop < 0 else stop + 3
        else:
            stop = _ENDS[name.lower()].search(html, found.end())
            at = len(html) if stop is None else stop.end()
    out.append(html[at:])
    return entities.unescape(_TAG.sub(" ", " ".join(out)))


@F.pandas_udf(StringType())
def page_text(html: pd.Series) -> pd.Series:
    """visible() of each page; null for null."""
    return html.map(visible, na_action="ignore")


def page_language(html: Column) -> Column:
    return F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z\-]+)""", 1)
