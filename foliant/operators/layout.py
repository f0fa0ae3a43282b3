"""Positioned tokens to tables. Folds whose steps depend on each other run on one page at a time; all else is joins and windows."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from foliant.operators.grouped import Columns, fold_column, fold_rows

PAGE = ["doc_id", "page"]
FIGURE = r"^[-+(]?[0-9,]*\.?[0-9]+\)?%?$|^[-–—一]+$"


def figure(c: Column) -> Column:
    """Whether a token is a number or a dash."""
    return F.trim(c).rlike(FIGURE)


def page_slope(tokens: DataFrame) -> DataFrame:
    """(doc_id, page, slope): the median slope of five tokens or more, 0 where there are fewer or it is steep."""
    m = tokens.groupBy(*PAGE).agg(F.median("quad_slope").alias("m"), F.count("quad_slope").alias("n"))
    return m.select(*PAGE, F.when((F.col("n") >= 5) & (F.abs("m") <= 0.15), F.col("m")).otherwise(0.0).alias("slope"))


def _slope(slopes: np.ndarray) -> float:
    """What page_slope() says of a page's tokens."""
    known = slopes[~np.isnan(slopes)]
    middle = float(np.median(known)) if len(known) >= 5 else 0.0
    return middle if np.isfinite(middle) and abs(middle) <= 0.15 else 0.0


def lined(tokens: DataFrame, policy: str = "image", tolerance: float | None = None) -> DataFrame:
    """tokens with line_idx, from 0 down the page.

    image: the nearest line within max(7, 0.55 median height) of its mean that the token doesn't overlap, on
    a page put upright where its slope (quad_slope) moves a line's end by more than 1.5 times that;
    first: the first line within the tolerance of its first token (3.5 for words of a digital page);
    light: the first line within 14 of its mean.
    """

    def fold(c: Columns, low: int, high: int) -> np.ndarray:
        x0, x1, y0, y1 = (c[k][low:high].astype(float) for k in ("x0", "x1", "y0", "y1"))
        y = (y0 + y1) / 2
        reach = tolerance if tolerance is not None else max(7.0, 0.55 * float(np.median(y1 - y0))) if policy == "image" else 14.0 if policy == "light" else 3.5
        if policy == "image" and "quad_slope" in c:
            slope = _slope(c["quad_slope"][low:high].astype(float))
            if abs(slope) * (x1.max() - x0.min()) > 1.5 * reach:
                y = y - slope * (x0 + x1) / 2
        mark: list[float] = []
        own: list[list[int]] = []
        line = np.zeros(len(y), dtype=np.int32)

        def collides(k: int, t: int) -> bool:
            return any(min(x1[t], x1[o]) - max(x0[t], x0[o]) > max(20.0, 0.45 * min(x1[t] - x0[t], x1[o] - x0[o])) for o in own[k])

        for t in np.lexsort((c["seq"][low:high], x0, y)):
            near = [k for k in range(len(mark)) if abs(y[t] - mark[k]) <= reach]
            if policy == "image":
                near = sorted((k for k in near if not collides(k, t)), key=lambda k: abs(y[t] - mark[k]))  # noqa: B023
            if near:
                k = near[0]
                own[k].append(t)
                if policy != "first":
                    mark[k] += (y[t] - mark[k]) / len(own[k])
            else:
                k = len(mark)
                mark.append(float(y[t]))
                own.append([t])
            line[t] = k
        rank = np.empty(len(mark), dtype=np.int32)
        rank[np.argsort(mark, kind="stable")] = np.arange(len(mark))
        return rank[line]

    return fold_column(tokens, PAGE, ["seq"], fold, "line_idx", "int")


def line_rows(tokens: DataFrame) -> DataFrame:
    """A row for each line: extent, text, counts of tokens and figures, whether it looks like data."""
    t = F.sort_array(F.collect_list(F.struct("x0", "seq", "text")))
    out = tokens.groupBy(*PAGE, "line_idx").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.array_join(F.transform(t, lambda s: s["text"]), " ").alias("text"), F.count("*").alias("tokens"), F.count_if(figure(F.col("text"))).alias("figures"))
    return out.withColumn("data_like", (F.col("tokens") >= 2) & (F.col("figures") >= 2) & (F.col("figures") >= 0.3 * F.col("tokens")))


def light_lines(tokens: DataFrame) -> DataFrame:
    """(doc_id, page, line_idx, text) of tokens with line_idx: three tokens or more are a row between pipes, two a label and its value."""
    t = F.sort_array(F.collect_list(F.struct("x0", "seq", "text")))
    rows = tokens.groupBy(*PAGE, "line_idx").agg(F.transform(t, lambda s: F.trim(s["text"])).alias("t"))
    piped = F.concat(F.lit("| "), F.array_join("t", " | "), F.lit(" |"))
    labelled = F.concat(F.lit("**"), F.get("t", F.lit(0)), F.lit("**: "), F.get("t", F.lit(1)))
    return rows.select(*PAGE, "line_idx", F.when(F.size("t") > 2, piped).when(F.size("t") == 2, labelled).otherwise(F.get("t", F.lit(0))).alias("text"))


def page_confidence(tokens: DataFrame) -> DataFrame:
    """(doc_id, page, tokens, confidence, needs_more): the mean of the tokens' confidences; a page under 0.95 or of fewer than three tokens needs a better reading."""
    g = tokens.groupBy(*PAGE).agg(F.count("*").alias("tokens"), F.avg("confidence").alias("confidence"))
    return g.select(*PAGE, "tokens", F.round("confidence", 4).alias("confidence"), (F.coalesce(F.col("confidence") < 0.95, F.lit(True)) | (F.col("tokens") < 3)).alias("needs_more"))


def digital_pages(words: DataFrame, fallback: bool = False) -> DataFrame:
    """(doc_id, page, words, letters, accepted): whether a page's own words are enough: more than 30 words and 50 letters; of a second reader 20 words, seven in ten of them valid."""
    valid = F.col("text").rlike(r"(?U)^[\w.,:/%&()'\"+*#@\-]+$")
    g = words.groupBy(*PAGE).agg(F.count("*").alias("words"), F.sum(F.length("text")).alias("letters"), F.avg(valid.cast("double")).alias("valid"))
    enough = (F.col("words") >= 20) & (F.col("valid") >= 0.7) if fallback else (F.col("words") > 30) & (F.col("letters") > 50)
    return g.select(*PAGE, "words", "letters", enough.alias("accepted"))


def over_bands(tokens: DataFrame, bands: DataFrame, reach: float = 45.0) -> DataFrame:
    """(doc_id, page, seq, col_idx): each token with every band (center) that it stands over, give or take `reach`. The join is on page, with the range beside it."""
    t = tokens.select(*PAGE, "seq", (F.col("x0") - reach).alias("_from"), (F.col("x1") + reach).alias("_to"))
    return t.join(bands.select(*PAGE, "col_idx", "center"), PAGE).where(F.col("center").between(F.col("_from"), F.col("_to"))).select(*PAGE, "seq", "col_idx")


def lanes(figures: DataFrame, columns: DataFrame) -> DataFrame:
    """columns (doc_id, page, col_idx, left, right) with bounds moved into the lane between two columns of figures (doc_id, page, x0, x1).

    A bound moves where the figures of the two columns beside it, four or more of eight on the page, form
    exactly two groups with a lane of over 3 between them, and the lane's middle is between both columns'
    outer bounds. Bounds move from left to right, each against those moved before.
    """

    def fold(c: Columns, low: int, high: int) -> list[tuple]:
        side = c["side"][low:high]
        x0, x1, own = (c[k][low:high] for k in ("x0", "x1", "col_idx"))
        cut = side == 0
        edges = [[float(a), float(b)] for a, b in zip(x0[cut], x1[cut], strict=True)]
        spans = np.array(sorted(zip(x0[~cut], x1[~cut], strict=True)), dtype=float).reshape(-1, 2)
        for k in range(len(edges) - 1 if len(spans) >= 8 else 0):
            inner = spans[(spans[:, 0] >= edges[k][0] - 2.0) & (spans[:, 1] <= edges[k + 1][1] + 2.0)]
            if len(inner) < 4:
                continue
            reach = np.maximum.accumulate(inner[:, 1])
            parts = np.flatnonzero(inner[1:, 0] - reach[:-1] > 3.0)
            if len(parts) == 1:
                middle = (reach[parts[0]] + inner[parts[0] + 1, 0]) / 2
                if edges[k][0] < middle < edges[k + 1][1]:
                    edges[k][1] = edges[k + 1][0] = float(middle)
        return [(c["doc_id"][low], c["page"][low], int(i), a, b) for i, (a, b) in zip(own[cut], edges, strict=True)]

    number = lambda c: F.col(c).cast("double")
    rows = columns.select(*PAGE, F.lit(0).alias("side"), F.col("col_idx").cast("int").alias("col_idx"), number("left").alias("x0"), number("right").alias("x1"))
    words = figures.join(columns.select(*PAGE).distinct(), PAGE, "left_semi").select(*PAGE, F.lit(1).alias("side"), F.lit(0).alias("col_idx"), number("x0").alias("x0"), number("x1").alias("x1"))
    return fold_rows(rows.unionAll(words), PAGE, ["side", "col_idx"], fold, f"doc_id {columns.schema['doc_id'].dataType.simpleString()}, page {columns.schema['page'].dataType.simpleString()}, col_idx int, left double, right double")


def body_start(lines: DataFrame, within: int = 25) -> DataFrame:
    """(doc_id, page, body_start): the first line like data with a second one among the next three; else the first like data; else null."""
    ahead = Window.partitionBy(*PAGE).orderBy("line_idx").rowsBetween(0, 3)
    dense = F.sum(F.col("data_like").cast("int")).over(ahead) >= 2
    rows = lines.withColumn("dense", F.col("data_like") & dense & (F.col("line_idx") < within))
    return rows.groupBy(*PAGE).agg(F.coalesce(F.min(F.when(F.col("dense"), F.col("line_idx"))), F.min(F.when(F.col("data_like"), F.col("line_idx")))).alias("body_start"))


def report_line(text: Column) -> Column:
    """Whether a line is about the report: two dates, from .. to, or a long code."""
    date = "[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4}"
    return text.rlike(f"{date}.*{date}") | text.rlike(r"(?i)\bfrom\b.*\bto\b.*[0-9]") | text.rlike("[0-9][0-9A-Za-z]{9,}")


def bands(values: DataFrame, key: list[str], value: str, gap: Column) -> DataFrame:
    """values with band: runs of values no farther than gap from the one before."""
    w = Window.partitionBy(*key).orderBy(value)
    new = F.coalesce((F.col(value) - F.lag(value).over(w) > gap).cast("int"), F.lit(0))
    return values.withColumn("_new", new).withColumn("band", F.sum("_new").over(w).cast("int")).drop("_new")


def anchors(tokens: DataFrame, reach: float = 35.0, least: int = 2, share: float = 0.25) -> DataFrame:
    """(doc_id, page, col_idx, center): middles of figures clustered by a running mean, kept with enough support."""

    def fold(c: Columns, low: int, high: int) -> list[tuple]:
        means, counts = [], []
        for x in np.sort((c["x0"][low:high] + c["x1"][low:high]) / 2):
            if means and abs(x - means[-1]) <= reach:
                counts[-1] += 1
                means[-1] += (x - means[-1]) / counts[-1]
            else:
                means.append(float(x))
                counts.append(1)
        need = max(least, share * len(set(c["line_idx"][low:high])))
        good = [m for m, n in zip(means, counts, strict=True) if n >= need]
        return [(c["doc_id"][low], c["page"][low], k, m) for k, m in enumerate(good)]

    figures = tokens.where(figure(F.col("text"))).select(*PAGE, "line_idx", "x0", "x1")
    return fold_rows(figures, PAGE, [], fold, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, page int, col_idx int, center double")


def bounds(columns: DataFrame, edge: float = 100.0) -> DataFrame:
    """(doc_id, page, col_idx, left, right) half open, between the middles of neighbours (center); the first starts at 0, the last ends `edge` beyond its middle at most."""
    w = Window.partitionBy(*PAGE).orderBy("center", "col_idx")
    before, after = F.lag("center").over(w), F.lead("center").over(w)
    return columns.select(*PAGE, "col_idx", F.coalesce((before + F.col("center")) / 2, F.lit(0.0)).alias("left"), F.coalesce((after + F.col("center")) / 2, F.col("center") + edge).alias("right"))


def projected(tokens: DataFrame, columns: DataFrame) -> DataFrame:
    """(doc_id, page, line_idx, cells): each line's cell texts, blanks kept. A token goes to the first column that its middle is in; others drop.

    The join is on page, with the range beside it, so it never becomes a nested loop.
    """
    t = tokens.withColumn("xc", (F.col("x0") + F.col("x1")) / 2)
    hit = t.join(columns, PAGE).where((F.col("xc") >= F.col("left")) & (F.col("xc") < F.col("right")))
    hit = hit.groupBy(*PAGE, "line_idx", "seq").agg(F.min("col_idx").alias("col_idx"), F.first("x0").alias("x0"), F.first("text").alias("text"))
    cell = hit.groupBy(*PAGE, "line_idx", "col_idx").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "seq", "text"))), lambda s: s["text"]), " ").alias("text"))
    row = cell.groupBy(*PAGE, "line_idx").agg(F.map_from_entries(F.collect_list(F.struct("col_idx", "text"))).alias("m"))
    width = columns.groupBy(*PAGE).agg((F.max("col_idx") + 1).alias("width"))
    return row.join(width, PAGE).select(*PAGE, "line_idx", F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda c: F.coalesce(F.col("m")[c], F.lit(""))).alias("cells"))


def similarity(a: str | None, b: str | None) -> float:
    """0 where lengths, any numbers or the last number differ; else the share of matching letters."""
    if not a or not b or min(len(a), len(b)) / max(len(a), len(b)) < 0.7:
        return 0.0
    end = lambda t: re.search(r"\d*$", t)[0]
    if re.findall(r"\d+", a) != re.findall(r"\d+", b) or end(a) != end(b):
        return 0.0
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def description_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """similarity() of two folded descriptions."""
    return pd.Series([similarity(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
