"""Measuring extraction against what is right, and without it."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from foliant.functions.cells import lenient_number, row_number_value, semantic
from foliant.functions.text import folded
from foliant.operators.grouped import Columns, fold_rows
from foliant.operators.layout import similarity

NUMERIC = ["integer", "decimal", "percentage"]


def cell_correct(kind: Column, truth: Column, value: Column) -> Column:
    """Whether a cell is right.

    Figures of numeric columns may differ by 0.02, and stand for the same absent state, or the same text.
    Elsewhere blank, dash and zero must be the same state, though zero may be any figure of zero, and other
    texts the same but for case and signs.
    """
    a, b = semantic(truth), semantic(value)
    x, y = (lenient_number(F.replace(c, F.lit("%"), F.lit(""))) for c in (truth, value))
    same = (F.trim(truth) == F.trim(value)) | ((folded(truth) == folded(value)) & (folded(truth) != ""))
    absent = a.isin("EMPTY", "NOT_REPORTED", "ZERO")
    near = F.coalesce(F.abs(x - y) <= 0.02 + 1e-9, F.lit(False)) | (absent & (a == b)) | same
    zero = (a == "ZERO") & b.isin("ZERO", "NUMERIC") & F.coalesce(y == 0.0, F.lit(False))
    return F.coalesce(F.when(kind.isin(*NUMERIC), near).when(absent, (a == b) | zero).otherwise(same), F.lit(False))


def accuracy(cells: DataFrame, key: str) -> DataFrame:
    """Per document over cells (key, kind, truth, value): counts and per cents by state. A share of nothing is null."""
    c = cells.withColumns({"ok": cell_correct(F.col("kind"), F.col("truth"), F.col("value")), "st": semantic(F.col("truth")), "sv": semantic(F.col("value")), "num": F.col("kind").isin(*NUMERIC)})
    rate = lambda test: F.round(F.count_if(F.col("ok") & test) * 100.0 / F.nullif(F.count_if(test), F.lit(0)), 2)
    return c.groupBy(key).agg(
        F.count("*").alias("cells"), F.count_if("ok").alias("correct"), rate(F.lit(True)).alias("cell_accuracy"), rate(F.col("num")).alias("numeric_accuracy"), rate(F.col("st") == "EMPTY").alias("blank_accuracy"),
        rate(F.col("st") == "NOT_REPORTED").alias("dash_accuracy"), rate(F.col("st") == "ZERO").alias("zero_accuracy"), F.count_if((F.col("st") != "EMPTY") & (F.col("sv") == "EMPTY")).alias("false_empty"),
        F.count_if((F.col("st") != "NOT_REPORTED") & (F.col("sv") == "NOT_REPORTED")).alias("false_dash"), F.count_if((F.col("st") == "EMPTY") & (F.col("sv") != "EMPTY")).alias("invented"),
    )


def matched_columns(truth: Column, found: Column) -> Column:
    """A map of columns of truth to columns of found, from 0. Each takes the first free one whose folded name equals, holds or is held by its own; where both have as many, those left take the free one at their place."""
    a, b = F.transform(truth, folded), F.transform(found, folded)
    start = F.create_map().cast("map<int,int>")

    def by_name(have, each):
        like = lambda e: (e == each["n"]) | ((each["n"] != "") & e.contains(each["n"])) | ((e != "") & each["n"].contains(e))
        free = F.filter(F.transform(b, lambda e, k: F.when(like(e) & ~F.array_contains(F.map_values(have), k), k)), lambda k: k.isNotNull())
        return F.when(F.size(free) > 0, F.map_concat(have, F.create_map(each["i"], F.get(free, F.lit(0))))).otherwise(have)

    def by_place(have, each):
        free = ~F.map_contains_key(have, each["i"]) & ~F.array_contains(F.map_values(have), each["i"]) & (F.size(a) == F.size(b))
        return F.when(free, F.map_concat(have, F.create_map(each["i"], each["i"]))).otherwise(have)

    names = F.transform(a, lambda n, i: F.struct(n.alias("n"), i.alias("i")))
    return F.aggregate(names, F.aggregate(names, start, by_name), by_place)


def document_scores(documents: DataFrame, cells: DataFrame, key: str) -> DataFrame:
    """Per document: what its cells say, and how many rows and columns were found.

    documents: (key, truth_rows, found_rows, truth_columns and found_columns as names, rows_given: how many
    rows the truth really holds). cells: (key, kind, truth, value), a null truth for a cell that is too many,
    a null value for a missing one. A truth that declares rows but holds none can't be scored: its shares are
    null, and it is marked. Shares of nothing are null.
    """
    c = cells.withColumns({"ok": F.col("truth").isNotNull() & F.col("value").isNotNull() & cell_correct(F.col("kind"), F.col("truth"), F.col("value")), "st": semantic(F.col("truth")), "sv": semantic(F.col("value")), "num": F.col("kind").isin(*NUMERIC)})
    expected, given = F.col("truth").isNotNull(), F.col("value").isNotNull()
    full = F.col("truth").isNotNull() & (F.col("st") != "EMPTY")
    sums = c.groupBy(key).agg(
        F.count_if(expected).alias("expected_cells"), F.count_if("ok").alias("correct_cells"), F.count_if(expected & given & ~F.col("ok")).alias("incorrect_cells"), F.count_if(expected & ~given).alias("missing_cells"),
        F.count_if(~expected).alias("extra_cells"), F.count_if(full).alias("filled_truth"), F.count_if(given & (F.col("sv") != "EMPTY")).alias("filled_found"), F.count_if(full & F.col("ok")).alias("filled_correct"),
        F.count_if(full & (~given | (F.col("sv") == "EMPTY"))).alias("false_empty"), F.count_if(expected & (F.col("st") != "NOT_REPORTED") & (F.col("sv") == "NOT_REPORTED")).alias("false_dash"),
        F.count_if(F.col("num") & expected).alias("numeric_cells"), F.count_if(F.col("num") & F.col("ok")).alias("numeric_correct"), F.count_if(expected & (F.col("st") == "EMPTY") & given & (F.col("sv") != "EMPTY")).alias("invented"),
        *(F.count_if(expected & (F.col("st") == st)).alias(f"{n}_cells") for n, st in (("blank", "EMPTY"), ("dash", "NOT_REPORTED"), ("zero", "ZERO"))),
        *(F.count_if(F.col("ok") & (F.col("st") == st)).alias(f"{n}_correct") for n, st in (("blank", "EMPTY"), ("dash", "NOT_REPORTED"), ("zero", "ZERO"))),
    )
    counts = [x for x in sums.columns if x != key]
    d = documents.join(sums, key, "left").fillna(0, counts)
    share = lambda x, n: F.round(F.col(x) * 100.0 / F.nullif(F.col(n), F.lit(0)), 2)
    both = lambda x, n: F.round(F.least(x, n) * 100.0 / F.greatest(x, n, F.lit(1)), 2)
    scored = ~((F.col("rows_given") == 0) & (F.col("truth_rows") > 0))
    shares = {
        "row_accuracy": both(F.col("truth_rows"), F.col("found_rows")), "column_accuracy": both(F.size("truth_columns"), F.size("found_columns")),
        "column_semantic": F.round(F.size(matched_columns(F.col("truth_columns"), F.col("found_columns"))) * 100.0 / F.greatest(F.size("truth_columns"), F.lit(1)), 2),
        "cell_accuracy": share("correct_cells", "expected_cells"), "numeric_accuracy": share("numeric_correct", "numeric_cells"), "recall": share("filled_correct", "filled_truth"), "precision": share("filled_correct", "filled_found"),
        "blank_accuracy": share("blank_correct", "blank_cells"), "dash_accuracy": share("dash_correct", "dash_cells"), "zero_accuracy": share("zero_correct", "zero_cells"),
    }
    return d.select(key, *counts, *(F.when(scored, v).alias(n) for n, v in shares.items()), scored.alias("scorable"))


def average_delta(scores: DataFrame, left: str, right: str) -> DataFrame:
    """One row: how much better right is than left, over documents that have both."""
    return scores.agg(F.round(F.avg(F.col(right) - F.col(left)), 2).alias("delta"), F.count_if(F.col(left).isNotNull() & F.col(right).isNotNull()).alias("documents"))


def truth_faults(rows: DataFrame, key: str, footed: list[str], placeholders: list[str]) -> DataFrame:
    """(key, fault, place) in what is taken for right: rows (key, row_idx, row_type, names, cells).

    footed: columns whose products must add up to the first total, within 0.05. A first cell with a
    placeholder's word was made up. A field whose value is its own name, or a word of it, was never read.
    """
    cell = rows.select(key, "row_idx", "row_type", F.posexplode(F.arrays_zip(F.col("names").alias("name"), F.col("cells").alias("value"))).alias("k", "c")).select(key, "row_idx", "row_type", "k", "c.*")
    figure = cell.where(F.col("name").isin(*footed)).withColumn("x", row_number_value(F.col("value")))
    total = figure.where("row_type = 'total'").groupBy(key, "name", "k").agg(F.min(F.struct("row_idx", "x")).alias("t"))
    parts = figure.where("row_type = 'product'").groupBy(key, "name").agg(F.round(F.sum("x"), 3).alias("whole"))
    footing = total.join(parts, [key, "name"]).where(F.abs(F.col("whole") - F.col("t.x")) > 0.05).select(key, F.lit("total_differs").alias("fault"), F.col("k").cast("long").alias("place"))
    first = F.lower(F.trim(F.coalesce(F.get("cells", F.lit(0)), F.lit(""))))
    made_up = rows.where(F.exists(F.array(*(F.lit(p) for p in placeholders)), lambda p: first.contains(p))).select(key, F.lit("placeholder_row").alias("fault"), F.col("row_idx").cast("long").alias("place"))
    plain = lambda n: F.replace(F.lower(F.trim(F.get("cells", F.array_position("names", F.lit(n)).cast("int") - 1))), F.lit("_"), F.lit(" "))
    named = rows.where(F.array_contains("names", "field_name") & F.array_contains("names", "field_value")).withColumns({"_n": plain("field_name"), "_v": plain("field_value")})
    label = named.where((F.col("_v") != "") & (F.startswith("_n", "_v") | F.array_contains(F.split("_n", r"\s+"), F.col("_v")))).select(key, F.lit("label_as_value").alias("fault"), F.col("row_idx").cast("long").alias("place"))
    return footing.unionAll(made_up).unionAll(label)


def passes(row: Column, column: Column, semantic_columns: Column, cell: Column, numeric: Column, confidence: Column, review: Column) -> Column:
    """The production gate."""
    return (row >= 95) & (column >= 95) & (semantic_columns >= 95) & (cell >= 95) & (numeric >= 98) & (confidence >= 0.85) & ~review


def aligned(truth: DataFrame, found: DataFrame, key: str, gap: float = 0.7, least: float = 0.35) -> DataFrame:
    """(key, truth_idx, found_idx) of rows (key, idx, text): by place where there are as many, else by the cheapest alignment in order; pairs under `least` stay apart."""

    def fold(c: Columns, low: int, high: int) -> list[tuple]:
        cut = low + int((c["side"][low:high] == 0).sum())
        a, b, x, y = c["idx"][low:cut], c["idx"][cut:high], c["text"][low:cut], c["text"][cut:high]
        own, n, m = c[key][low], len(a), len(b)
        if n == m:
            return [(own, int(p), int(q)) for p, q in zip(a, b, strict=True)]
        like = np.array([[SequenceMatcher(None, s, t).ratio() for t in y] for s in x]).reshape(n, m)
        cost = np.zeros((n + 1, m + 1))
        cost[:, 0], cost[0] = gap * np.arange(n + 1), gap * np.arange(m + 1)
        for i in range(1, n + 1):
            for j in range(1, m + 1):
                cost[i, j] = min(cost[i - 1, j - 1] + 1 - like[i - 1, j - 1], cost[i - 1, j] + gap, cost[i, j - 1] + gap)
        out, i, j = [], n, m
        while i and j:
            if np.isclose(cost[i, j], cost[i - 1, j - 1] + 1 - like[i - 1, j - 1]):
                if like[i - 1, j - 1] >= least:
                    out.append((own, int(a[i - 1]), int(b[j - 1])))
                i, j = i - 1, j - 1
            elif np.isclose(cost[i, j], cost[i - 1, j] + gap):
                i -= 1
            else:
                j -= 1
        return out

    both = truth.select(key, F.lit(0).alias("side"), "idx", "text").unionAll(found.select(key, F.lit(1).alias("side"), "idx", "text"))
    return fold_rows(both, [key], ["side", "idx"], fold, f"{key} {truth.schema[key].dataType.simpleString()}, truth_idx int, found_idx int")


def stability(runs: DataFrame) -> DataFrame:
    """Per field of runs (field, run, value, ok): runs, passes, distinct values (null is none); stable with one."""
    g = runs.groupBy("field").agg(F.count("*").alias("runs"), F.count_if("ok").alias("passed"), F.count_distinct("value").alias("values"))
    return g.withColumn("stable", F.col("values") == 1)


def at_ranks(counted: DataFrame, wanted: DataFrame, buckets: int = 4096) -> DataFrame:
    """(k, rank, value): values of counted (k, s, c) at the ranks wanted (k, low, high, rank), from 1; low and high are a key's least and most.

    A histogram says in which bucket a rank is, and only that bucket's values are sorted, so no key's values
    are all in one task.
    """
    ends = wanted.select("k", "low", "high").distinct()
    at = F.floor((F.col("s") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) * buckets)
    rows = counted.join(ends, "k").select("k", "s", "c", F.coalesce(at, F.lit(0)).alias("b"))
    upto = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    bars = rows.groupBy("k", "b").agg(F.sum("c").alias("n")).withColumn("upto", F.sum("n").over(upto))
    held = bars.join(wanted.select("k", "rank"), "k").where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n")))
    near = rows.join(held.select("k", "b", "rank", (F.col("rank") - F.col("upto") + F.col("n")).alias("own")), ["k", "b"])
    sofar = F.sum("c").over(Window.partitionBy("k", "rank").orderBy("s").rowsBetween(Window.unboundedPreceding, 0))
    return near.withColumn("sofar", sofar).where("sofar >= own").groupBy("k", "rank").agg(F.min("s").alias("value"))


def latency(times: DataFrame, key: str, seconds: str) -> DataFrame:
    """Per key: least, median, 90th per cent, most and documents an hour. The 90th is exclusive: between ranks of n + 1. A null time counts nowhere."""
    counted = times.where(F.col(seconds).isNotNull()).groupBy(F.struct(key).alias("k"), F.col(seconds).cast("double").alias("s")).agg(F.count("*").alias("c"))
    whole = counted.groupBy("k").agg(F.sum("c").alias("n"), F.min("s").alias("low"), F.max("s").alias("high"), (F.sum(F.col("s") * F.col("c")) / F.sum("c")).alias("mean"))
    at = (F.col("n") + 1) * F.lit(0.9)
    first = F.greatest(F.lit(1), F.least(F.floor(at), F.col("n") - 1))
    whole = whole.withColumns({"p": first, "share": at - first, "m": F.floor((F.col("n") + 1) / 2)})
    ranks = whole.select("k", "low", "high", F.explode(F.array_distinct(F.array("p", F.least(F.col("p") + 1, F.col("n")), "m", F.floor((F.col("n") + 2) / 2)))).alias("rank"))
    found = at_ranks(counted, ranks).groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("v"))
    value = lambda r: F.element_at("v", r)
    low, high = value(F.col("p")), value(F.least(F.col("p") + 1, F.col("n")))
    median = (value(F.col("m")) + value(F.floor((F.col("n") + 2) / 2))) / 2
    return whole.join(found, "k").select(F.col(f"k.{key}").alias(key), "n", F.col("low").alias("least"), F.round(median, 4).alias("median"), F.round(low + (high - low) * F.col("share"), 4).alias("p90"), F.col("high").alias("most"), F.round(F.lit(3600) / F.nullif("mean", F.lit(0.0)), 2).alias("per_hour"))


def weighted(metrics: DataFrame, key: str, metric: str, n: str) -> DataFrame:
    """Per key: the metric's mean by n."""
    return metrics.groupBy(key).agg(F.round(F.sum(F.col(metric) * F.col(n)) / F.nullif(F.sum(n), F.lit(0)), 4).alias(metric))


def anomalies(tables: DataFrame, key: str) -> DataFrame:
    """(key, rule, place) for tables (columns, rows): names that absorbed a row, application chrome, labels merged into products, rows without values, garbled figures, repeated descriptions, neighbours of one name of which one is empty."""
    # Signs of an application's own window, words of headers.
    chrome = r"(?i)[\w.+-]+@[\w-]+\.\w+|www\.|\bf[0-9]{1,2}\s*[-:]|\bmobile\s*:|\bhelp\s*line|\besc\b|jline"
    headers = "description|particulars|item|product|packing|opening|receipt|issue|closing|balance|qty|rate|amount"
    texts = "pack|unit|desc|name|item|batch|expiry|day|sh.exp"
    c = tables.select(key, F.posexplode("columns").alias("j", "name"))
    words = F.filter(F.split(F.lower("name"), r"\s+"), lambda w: w != "")
    hits = F.size(F.filter(words, lambda w: w.rlike(headers)))
    names = [
        ("placeholder_column", F.col("name").rlike(r"^Col_Num_[0-9]+_[0-9]+$")),
        ("absorbed_row", (F.size(words) >= 4) & (hits < F.size(words) - 1)),
        ("column_chrome", F.col("name").rlike(chrome)),
    ]
    r = tables.select(key, "columns", F.posexplode("rows").alias("i", "cells")).withColumn("d", F.trim(F.coalesce(F.get("cells", F.lit(0)), F.lit(""))))
    own = F.trim(F.regexp_replace("d", r"(?i)\b(grand\s+)?(s-)?(sub)?total\b[: ]*", ""))
    rows = [
        ("merged_total", F.lower("d").contains("total") & (F.size(F.split("d", r"\s+")) > 2) & (own != "") & ~own.rlike("^[0-9]+$")),
        ("row_chrome", F.exists("cells", lambda x: x.rlike(chrome))),
        ("no_values", (F.col("d") != "") & ~F.exists(F.slice("cells", 2, F.greatest(F.size("cells"), F.lit(1))), lambda x: F.trim(x) != "")),
    ]
    cell = r.select(key, "i", "columns", F.posexplode("cells").alias("j", "v")).where("j > 0").withColumn("v", F.trim("v"))
    figure = ~F.lower(F.coalesce(F.get("columns", F.col("j")), F.lit(""))).rlike(texts)
    cells = [
        ("leading_zeros", F.regexp_replace("v", r"\.", "").rlike("^0{2,}[1-9]")),
        ("letters_in_figure", figure & F.col("v").rlike("[0-9]") & F.col("v").rlike("[A-Za-z]{2,}")),
    ]
    found = [c.where(t).select(key, F.lit(n).alias("rule"), F.col("j").cast("long").alias("place")) for n, t in names]
    found += [r.where(t).select(key, F.lit(n).alias("rule"), F.col("i").cast("long").alias("place")) for n, t in rows]
    found += [cell.where(t).select(key, F.lit(n).alias("rule"), (F.col("i") * 1000 + F.col("j")).cast("long").alias("place")) for n, t in cells]
    filled = F.aggregate("rows", F.lit(0), lambda n, x: n + F.when(F.trim(F.coalesce(F.get(x, F.col("j")), F.lit(""))) != "", 1).otherwise(0))
    after = F.aggregate("rows", F.lit(0), lambda n, x: n + F.when(F.trim(F.coalesce(F.get(x, F.col("j") + 1), F.lit(""))) != "", 1).otherwise(0))
    pair = tables.select(key, "rows", F.posexplode("columns").alias("j", "name"), F.col("columns")).withColumns({"a": folded("name"), "b": folded(F.get("columns", F.col("j") + 1))})
    split = (F.col("a") != "") & (F.col("a") == F.col("b")) & (F.least(filled, after) <= F.greatest(F.lit(1), F.floor(F.size("rows") / 5)))
    found.append(pair.where(split).select(key, F.lit("split_column").alias("rule"), F.col("j").cast("long").alias("place")))
    often = r.where("d <> ''").groupBy(key, F.lower("d").alias("d")).agg(F.count("*").alias("n"), F.min("i").alias("i")).where("n > 2")
    found.append(often.select(key, F.lit("repeated_description").alias("rule"), F.col("i").cast("long").alias("place")))
    out = found[0]
    for f in found[1:]:
        out = out.unionAll(f)
    return out


def matched(mode: Column, expect: Column, value: Column) -> Column:
    """A golden field's verdict: exact, exact_ci, digits, contains or contains_all (expect: array). An empty value never matches."""
    first, v = F.get(expect, F.lit(0)), F.coalesce(F.trim(value), F.lit(""))
    digits = lambda x: F.regexp_replace(x, "[^0-9]", "")
    holds = F.forall(expect, lambda e: F.lower(v).contains(F.lower(e)))
    rule = F.when(mode == "exact", v == F.trim(first)).when(mode == "exact_ci", F.lower(v) == F.lower(F.trim(first))).when(mode == "digits", digits(v) == digits(first)).when(mode == "contains", F.lower(v).contains(F.lower(first))).when(mode == "contains_all", holds)
    return (v != "") & F.coalesce(rule, F.lit(False))


def edit_rate(a: Column, b: Column) -> Column:
    """One less the edit distance by the longer length, to four places."""
    return F.round(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)), 4)


@F.pandas_udf(DoubleType())
def character_errors(truth: pd.Series, found: pd.Series) -> pd.Series:
    """One less the share of letters that both texts have in order, to four places; null counts as empty."""
    return pd.Series([round(1 - SequenceMatcher(None, a or "", b or "").ratio(), 4) for a, b in zip(truth, found, strict=True)], dtype="float64")


def nearest(found: DataFrame, truth: DataFrame, key: list[str], reach: float) -> DataFrame:
    """Per row of truth (key, idx, text, x, y): whether found has its text on the page, and within reach. Joined on page and text."""
    f = found.select(*key, F.col("text"), F.col("x").alias("fx"), F.col("y").alias("fy"))
    d = F.sqrt(F.pow(F.col("x") - F.col("fx"), F.lit(2)) + F.pow(F.col("y") - F.col("fy"), F.lit(2)))
    g = truth.join(f, [*key, "text"], "left").groupBy(*key, "idx").agg(F.min(d).alias("distance"))
    return g.withColumns({"present": F.col("distance").isNotNull(), "near": F.coalesce(F.col("distance") <= reach, F.lit(False))})


__all__ = ["accuracy", "aligned", "anomalies", "at_ranks", "average_delta", "cell_correct", "character_errors", "document_scores", "edit_rate", "latency", "matched", "matched_columns", "nearest", "passes", "similarity", "stability", "truth_faults", "weighted"]
