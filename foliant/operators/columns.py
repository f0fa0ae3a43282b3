"""The columns of a page's table, from where its words stand.

A page is read in four steps: the body is where figures line up; the header is the line above it that stands
over most of the body's bands, with the tiers above and below that belong to it; its words cluster into named
strips; and strips that the body shows but the header misses are added where there is evidence for them. Steps
depend on each other, so a page is one fold; pages are folded many to a batch.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.cells import PACKING
from foliant.operators.grouped import Columns, fold_rows
from foliant.operators.layout import FIGURE, PAGE

# Words that name columns; the short and the listed ones count as whole words only.
LABELS = ["product", "item", "description", "particulars", "code", "pack", "packing", "op", "bal", "balance", "opening", "receipt", "receipts", "issue", "issues", "total", "closing", "stock", "sale", "sales", "purchase", "rate", "amount", "value", "val", "qty", "quantity", "expiry", "exp", "batch", "unit", "sn", "sr", "mrp", "disc", "tax", "free", "dump", "near", "dty", "oty", "aty", "age", "ageing", "aging", "days", "qoh", "stk", "o.stk", "purc", "tot"]
WHOLE_LABELS = {"age", "tot", "days", "qoh", "purc"}
# Parts of the names of description columns; misread labels.
DESCRIBING = ("desc", "particular", "product", "item", "name")
MISREAD = {"aty": "Qty.", "aty.": "Qty.", "oty": "Qty.", "oty.": "Qty.", "dty": "Qty.", "dty.": "Qty.", "nane": "Name"}
# Fixed values, in pixels: how far figures of one band may be apart, how far labels reach beyond themselves, least widths.
BAND, REACH, NAME_REACH, LEAST_GAP, LEAST_LINES = 35.0, 45.0, 60.0, 30.0, 3

_FIGURE = re.compile(FIGURE)
_PLAIN_FIGURE = re.compile(r"-?\d+(\.\d+)?|-{1,3}|一")
_DATES = re.compile(r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}.*\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\bfrom\b.*\bto\b.*\d|\d[\da-z]{9,}", re.I)
_PACK = re.compile(PACKING, re.I)


@dataclass(slots=True)
class Word:
    text: str
    x0: float
    x1: float
    y0: float
    y1: float

    @property
    def middle(self) -> float:
        return (self.x0 + self.x1) / 2

    @property
    def figure(self) -> bool:
        return bool(_FIGURE.search(self.text.strip()))

    def over(self, x: float, reach: float = REACH) -> bool:
        return self.x0 - reach <= x <= self.x1 + reach


@dataclass(slots=True)
class Strip:
    """A column as an interval; made: its name is a stand-in."""

    name: str
    x0: float
    x1: float
    made: bool = False
    words: list[Word] = field(default_factory=list)

    def holds(self, line: list[Word], reach: float) -> bool:
        return any(self.x0 - reach <= w.middle <= self.x1 + reach for w in line)

    @property
    def describes(self) -> bool:
        return any(k in self.name.lower() for k in DESCRIBING)


Lines = list[list[Word]]


def line_text(line: list[Word]) -> str:
    return " ".join(w.text for w in line)


def data_like(line: list[Word]) -> bool:
    n = sum(w.figure for w in line)
    return n >= 2 and n >= 0.3 * len(line)


def clusters(xs: Iterable[float]) -> list[tuple[float, int]]:
    """(mean, members) of ascending values, each no more than BAND beyond the mean of those before it."""
    out: list[tuple[float, int]] = []
    for x in sorted(xs):
        if out and x - out[-1][0] <= BAND:
            mean, n = out[-1]
            out[-1] = (mean + (x - mean) / (n + 1), n + 1)
        else:
            out.append((x, 1))
    return out


def body_bands(lines: Lines) -> list[float]:
    """Middles of the bands that figures of a quarter of the lines, two at least, stand in."""
    need = max(2, int(len(lines) * 0.25))
    return [x for x, n in clusters(w.middle for line in lines for w in line if w.figure) if n >= need]


def body_line(lines: Lines, within: int = 25) -> int | None:
    """The first line like data that has another one among the next three, else the first like data."""
    like = [k for k, line in enumerate(lines) if data_like(line)]
    firm = [k for k, after in zip(like, like[1:], strict=False) if after - k <= 3 and k < within]
    loose = [k for k in like if k < within]
    return firm[0] if firm else loose[0] if loose else None


def label_line(lines: Lines, body: int | None, bands: list[float]) -> int | None:
    """Of six lines above the body the one whose words stand over most of its bands, the lower the better."""
    if not body or len(bands) < 2:
        return None
    low, best = max(0, body - 6), (0.0, None)
    for k in range(low, body):
        line = lines[k]
        if len(line) < 2 or 2 * sum(w.figure for w in line) > len(line) or _DATES.search(line_text(line)):
            continue
        covered = {next((b for b, x in enumerate(bands) if w.over(x)), None) for w in line} - {None}
        best = max(best, (len(covered) / len(bands) + 0.02 * (k - low), k), key=lambda s: s[0])
    return best[1] if best[0] >= 0.4 else None


def is_label(text: str) -> bool:
    word = re.sub(r"[^a-z]", "", text.lower())
    return bool(word) and any(word == k if len(k) <= 2 or k in WHOLE_LABELS else k in word for k in LABELS)


def worded_line(lines: Lines) -> int | None:
    """Without a body to go by: the first of 15 lines with two words that name columns, else the first with four words."""
    for k, line in enumerate(lines[:15]):
        if not _DATES.search(line_text(line)) and sum(is_label(w.text) for w in line) >= 2:
            return k
    return next((k for k, line in enumerate(lines) if len(line) >= 4), None)


def tiers(lines: Lines, at: int, body: int | None, bands: list[float]) -> tuple[int, int]:
    """First and last line of the header about line `at`.

    Up to two lines above join with two words or more, no figure, and two bands under them; up to three below
    with no figure and one band, but never the body's first.
    """
    under = lambda line: sum(any(w.over(x) for w in line) for x in bands)
    top = at
    while top > max(0, at - 2) and bands:
        line = lines[top - 1]
        if len(line) < 2 or any(w.figure for w in line) or _DATES.search(line_text(line)) or under(line) < 2:
            break
        top -= 1
    end = at
    for k in range(at + 1, min(len(lines), at + 4)):
        line, figures = lines[k], sum(w.figure for w in lines[k])
        stop = not line or (body is not None and k >= body) or (figures > 0 or under(line) < 1 if bands else figures >= 2)
        if stop or body is None and not any(is_label(w.text) for w in line) and len(line) < 3:
            break
        end = k
    return top, end


def right_labels(lines: Lines, top: int, end: int) -> list[Word]:
    """Words up to three lines above the header that stand right of it, over bands of the data that it leaves unnamed."""
    right = max((w.x1 for line in lines[top : end + 1] for w in line), default=0.0)
    bands = [x for x in body_bands(lines[end + 1 :]) if x > right - 25.0]
    words = [w for line in lines[max(0, top - 3) : top] for w in line]
    return [w for w in words if w.x0 >= right - 10.0 and not w.figure and any(w.over(x, NAME_REACH) for x in bands)]


def parted(word: Word, bands: list[float]) -> list[Word]:
    """Two labels that were read as one: over two bands, cut where case, a point or a space allows it, nearest to the bands' middle."""
    text = word.text.strip()
    inside = [x for x in bands if word.over(x, 5.0)]
    if len(text) < 6 or len(inside) < 2 or word.x1 <= word.x0:
        return [word]
    cuts = {m.start() + 1 for m in re.finditer(r"[a-z.)\s](?=[A-Z])", text)} | {m.start() for m in re.finditer(r"(?<=\S)\s(?=\S)", text)}
    per_letter = (word.x1 - word.x0) / len(text)
    aim = ((inside[0] + inside[1]) / 2 - word.x0) / per_letter
    for cut in sorted((c for c in cuts if 2 <= c <= len(text) - 2), key=lambda c: (abs(c - aim), c))[:1]:
        left, right, x = text[:cut].strip(), text[cut:].strip(), word.x0 + cut * per_letter
        if left and right:
            return [Word(left, word.x0, x, word.y0, word.y1), Word(right, x, word.x1, word.y0, word.y1)]
    return [word]


def named_strips(header: list[Word], bands: list[float]) -> list[Strip]:
    """Strips of header words that overlap by more than a quarter of the narrower one, lowest words first; a word over several strips names them all."""
    words = sorted((p for w in header for p in parted(w, bands)), key=lambda w: (-w.y0, w.x0))
    found: list[Strip] = []
    for w in words:
        wide = max(1.0, w.x1 - w.x0)
        hits = [s for s in found if min(s.x1, w.x1) - max(s.x0, w.x0) > 0.25 * min(s.x1 - s.x0, wide) and min(s.x1 - s.x0, wide) > 0]
        if not hits:
            found.append(Strip("", w.x0, w.x1, words=[w]))
        for s in hits:
            s.words.append(w)
        if len(hits) == 1:
            hits[0].x0, hits[0].x1 = min(hits[0].x0, w.x0), max(hits[0].x1, w.x1)
    found.sort(key=lambda s: s.x0)
    heights = [w.y1 - w.y0 for w in words if w.y1 > w.y0]
    tier = _baselines(words, float(np.median(heights)) * 0.6 if heights else 6.0)
    shared: dict[int, set[int]] = {}
    for k, s in enumerate(found):
        for w in s.words:
            shared.setdefault(tier(w), set()).add(k)
    for s in found:
        s.words.sort(key=lambda w: (w.y0, w.x0))
        # A line over one strip only is a title that was printed close; of labels on one line the known ones are no misreadings.
        own = [w for w in s.words if len(shared[tier(w)]) >= 2] or s.words
        own = [w for w in own if is_label(w.text)] or own
        names = [MISREAD.get(w.text.strip().lower(), w.text.strip()) for w in own]
        s.name = " ".join(n for k, n in enumerate(names) if not k or n.lower() != names[k - 1].lower()).strip()
    return found


def _baselines(words: list[Word], gap: float) -> Callable[[Word], int]:
    """The number of a word's baseline: runs of heights no farther than gap from the one before."""
    ys = np.sort([(w.y0 + w.y1) / 2 for w in words])
    run = np.concatenate([[0], np.cumsum(np.diff(ys) > gap)]) if len(ys) else ys
    return lambda w: int(run[min(np.searchsorted(ys, (w.y0 + w.y1) / 2 - 1e-9), len(run) - 1)])


def printed_name(header: Lines, x: float) -> str | None:
    """The label nearest to a band among those that reach it."""
    near = [w for line in header for w in line if w.text.strip() and not w.figure and w.over(x, NAME_REACH)]
    return min(near, key=lambda w: abs(w.middle - x)).text.strip() if near else None


class Model:
    """Strips of a header, completed by what the body shows; `uncertain` where evidence was too weak to add one."""

    def __init__(self, header: Lines, data: Lines, verticals: list[tuple[float, float, float, float]], width: float):
        self.header, self.data, self.width, self.uncertain = header, data, width, False
        self.strips = named_strips([w for line in header for w in line], body_bands(data))
        ys = [y for line in data for w in line for y in (w.y0, w.y1)]
        self.rulings = [(x0 + x1) / 2 for x0, x1, y0, y1 in verticals if ys and y1 >= min(ys) and y0 <= max(ys)]
        self.bands = [c for c in clusters(w.middle for line in data for w in line if _PLAIN_FIGURE.fullmatch(w.text.strip())) if c[1] >= 2]
        if self.strips:
            for step in (self._description, self._packing, self._gaps, self._trailing, self._reunited, self._unread):
                step()

    def _description(self) -> None:
        """A first column of texts that start well left of all strips on three lines or more."""
        if any(s.describes for s in self.strips):
            return
        first = self.strips[0].x0
        leads = [min(line, key=lambda w: w.x0) for line in self.data if line]
        edges = [w.x0 for w in leads if w.x0 < first - 20.0 and re.search("[A-Za-z]{2,}", w.text)]
        x0 = max(0.0, min(edges, default=0.0) - 10.0)
        if len(edges) >= LEAST_LINES and first - 5.0 > x0 + 20.0:
            self.strips.insert(0, Strip("Description", x0, first - 5.0))
        else:
            self.uncertain = True

    def _packing(self) -> None:
        """A column of packings between the description and the first band of figures, three or more of them."""
        if any(k in s.name.lower() for s in self.strips for k in ("pack", "unit")):
            return
        at = next((k for k, s in enumerate(self.strips) if s.describes), None)
        right = self.strips[at].x1 if at is not None else 0.0
        figures = self.bands[0][0] if self.bands else self.width * 0.5
        packs = []
        for line in self.data:
            for w in line:
                between = w.middle < figures - 20.0 and w.x0 >= right - 15.0 and _PACK.fullmatch(w.text.strip())
                if between and (w.x0 >= right or any(o.x1 <= w.x0 + 10.0 for o in line if o is not w)):
                    packs.append(w.middle)
        middle = (self.strips[at].x0 + self.strips[at].x1) / 2 if at is not None else 0.0
        if len(packs) >= LEAST_LINES and np.mean(packs) > middle + 40.0:
            x = float(np.mean(packs))
            self.strips.insert((at or 0) + 1, Strip("Packing", x - 30.0, x + 30.0))

    def _band_strip(self, x: float, stand_in: str) -> Strip:
        name = printed_name(self.header, x)
        return Strip(name or stand_in, x - 25.0, x + 25.0, made=name is None)

    def _gaps(self) -> None:
        """Bands of figures between two strips, where a ruling or three lines and a wide enough gap speak for a column."""
        out = []
        for k, (a, b) in enumerate(zip(self.strips, [*self.strips[1:], None], strict=True)):
            out.append(a)
            if b is None:
                continue
            low, high = a.x1 + 15.0, b.x0 - 15.0
            ruled = any(low <= x <= high for x in self.rulings)
            for n, (x, lines) in enumerate([c for c in self.bands if low <= c[0] <= high]):
                if ruled or lines >= LEAST_LINES and b.x0 - a.x1 >= LEAST_GAP:
                    out.append(self._band_strip(x, f"Col_Num_{k}_{n + 1}"))
                else:
                    self.uncertain = True
        self.strips = out

    def _trailing(self) -> None:
        """The last band of figures, right of all strips, on the same evidence."""
        right = self.strips[-1].x1
        if not self.bands or self.bands[-1][0] <= right + 25.0:
            return
        x, lines = self.bands[-1]
        if lines >= LEAST_LINES or any(r > right + 10.0 for r in self.rulings):
            self.strips.append(self._band_strip(x, f"Col_Num_{len(self.strips)}_1"))
        else:
            self.uncertain = True

    def _reunited(self) -> None:
        """A stand-in and a named neighbour that hardly ever hold words on the same line are one column."""
        if len(self.data) < 4:
            return
        filled = [{k for k, line in enumerate(self.data) if s.holds(line, 5.0)} for s in self.strips]
        gone: set[int] = set()
        for k, s in enumerate(self.strips):
            for j in (k - 1, k + 1) if s.made else ():
                if not 0 <= j < len(self.strips) or j in gone or self.strips[j].made:
                    continue
                if len(filled[k] & filled[j]) <= max(1, int(len(self.data) * 0.1)) and filled[k] and filled[j]:
                    o = self.strips[j]
                    s.name, s.x0, s.x1, s.made = o.name, min(s.x0, o.x0), max(s.x1, o.x1), False
                    gone.add(j)
                    break
        self.strips = [s for k, s in enumerate(self.strips) if k not in gone]

    def _unread(self) -> None:
        """Strips without a readable name and without data are misreadings of the header."""
        if len(self.strips) <= 2:
            return
        lost = [s for s in self.strips if (s.made or len(re.sub("[^a-z0-9]", "", s.name.lower())) < 2) and not any(s.holds(line, 0.0 if s.made else 10.0) for line in self.data)]
        self.uncertain |= bool(lost)
        left = [s for s in self.strips if s not in lost]
        self.strips = left if len(left) >= 2 else self.strips

    def bounds(self) -> list[tuple[str, float, float]]:
        """(name, left, right): neighbours meet in the middle, but no column reaches more than 100 to the left; the last ends where the header and the data under it do."""
        edge = max((w.x1 for line in self.header for w in line), default=0.0)
        data = max((w.x1 for line in self.data for w in line if w.x1 <= edge + 60.0), default=edge)
        end, out = min(self.width, max(edge, data) + 25.0), []
        for k, s in enumerate(self.strips):
            left = 0.0 if not k else (self.strips[k - 1].x1 + s.x0) / 2
            if k and s.x0 - left > 100.0:
                left = max(left, s.x0 - max(60.0, 0.8 * (s.x1 - s.x0)))
            right = end if k == len(self.strips) - 1 else (s.x1 + self.strips[k + 1].x0) / 2
            out.append((s.name, left, right))
        return out


def page_columns(lines: Lines, verticals: list[tuple[float, float, float, float]], width: float) -> tuple[int, int, list[tuple[str, float, float]], bool] | None:
    """(first and last header line, columns, uncertain) of a page's lines, or None without a header or with fewer than two columns."""
    body = body_line(lines)
    bands = body_bands(lines[body:]) if body is not None else []
    at = label_line(lines, body, bands)
    at = worded_line(lines) if at is None else at
    if at is None:
        return None
    top, end = tiers(lines, at, body, bands)
    header = lines[top : end + 1]
    header = [*header, extra] if (extra := right_labels(lines, top, end)) else header
    model = Model(header, lines[end + 1 :], verticals, width)
    found = model.bounds()
    return (top, end, found, model.uncertain) if len(found) >= 2 else None


def column_model(tokens: DataFrame, rulings: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, col_idx, name, left, right, header_top, header_end, uncertain) of tokens with line_idx.

    rulings: (doc_id, page, x0, x1, y0, y1) of vertical lines. A page is as wide as its last word, or `width`
    where tokens have it. Pages without a header, or with fewer than two columns, have no rows.
    """
    wide = F.col("width").cast("double") if "width" in tokens.columns else F.lit(None).cast("double")
    number = [F.col(c).cast("double").alias(c) for c in ("x0", "x1", "y0", "y1")]
    rows = tokens.select(*PAGE, F.col("line_idx").cast("int").alias("line_idx"), F.col("seq").cast("long").alias("seq"), F.coalesce("text", F.lit("")).alias("text"), *number, wide.alias("width"))
    if rulings is not None:
        lines = rulings.select(*PAGE, F.lit(-1).alias("line_idx"), F.lit(0).cast("long").alias("seq"), F.lit("").alias("text"), *number, F.lit(None).cast("double").alias("width"))
        rows = rows.unionAll(lines.join(rows.select(*PAGE).distinct(), PAGE, "left_semi"))

    def fold(c: Columns, low: int, high: int) -> list[tuple]:
        at = c["line_idx"][low:high]
        words = list(zip(c["text"][low:high], *(c[k][low:high] for k in ("x0", "x1", "y0", "y1")), strict=True))
        verticals = [w[1:] for w, k in zip(words, at, strict=True) if k < 0]
        lines: Lines = [[] for _ in range(int(at.max()) + 1)]
        for w, k in zip(words, at, strict=True):
            if k >= 0:
                lines[k].append(Word(w[0], *(float(v) for v in w[1:])))
        given = c["width"][low:high]
        width = float(np.nanmax(given)) if not np.isnan(given.astype(float)).all() else max(w[2] for w in words)
        found = page_columns(lines, verticals, width)
        if found is None:
            return []
        top, end, columns, uncertain = found
        return [(c["doc_id"][low], c["page"][low], k, name, left, right, top, end, uncertain) for k, (name, left, right) in enumerate(columns)]

    return fold_rows(rows, PAGE, ["line_idx", "x0", "seq"], fold, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, page {tokens.schema['page'].dataType.simpleString()}, col_idx int, name string, left double, right double, header_top int, header_end int, uncertain boolean")
