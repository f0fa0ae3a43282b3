"""Operator 5: the main text of pages, by a site style tree.

Each page's markup is parsed once into blocks of text, each with the whole path of its elements (tags and all
classes, as a digest), and the pages of a host, all their blocks, are merged into one style tree: a branch's
content importance is one less the mean entropy of its texts over the host's pages, its presentation
importance the entropy of its parent's sequences of children. Where a host shows few pages of a branch, its
importance is drawn to that of the same branch over all hosts, the more the fewer there are. What the markup
says of a block (an article or main element; navigation, footers, forms, comments, hidden elements and the
like) is a prior that is added to its branch's importance, and blocks whose sum is low go. Pages of a host
that are copies count once.
"""

from __future__ import annotations

import functools
import hashlib
import html as entities
import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.frames import bounded, cut

_OPEN = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*"[^"]*"|=\s*'[^']*'|=)*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_LOOSE = re.compile(r"</?[a-zA-Z]|<!--")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Elements below the 512th level count to it, as in browsers.
DEPTH = 512

# Names of HTML elements by what they do.
RAW = {"script", "style", "title", "textarea", "template", "iframe", "noembed", "noframes", "xmp", "svg"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "math", "mi", "mn", "mo", "mrow", "ms", "mtext", "q", "ruby", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CLOSES_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "ul"}
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
SIDE = {"nav", "aside", "footer", "form", "button", "select", "menu", "dialog", "input", "datalist"}
CONTENT = {"article", "main"}
SIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
SIDE_WORDS = {"ad", "ads", "adv", "advert", "advertisement", "advertising", "adverts", "alert", "alerts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "disclaimer", "dropdown", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo", "recommended", "related", "replies", "respond", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget", "widgets"}
SIDE_STARTS = ("advert", "comments", "cookie", "footer", "navbar", "newsletter", "sidebar", "sponsor")
#: Words that say nothing beside one of SIDE_WORDS in a class or id.
PLAIN_WORDS = {"area", "bar", "block", "bottom", "box", "button", "buttons", "container", "content", "form", "global", "holder", "inner", "item", "items", "left", "link", "links", "list", "main", "outer", "panel", "posts", "right", "section", "site", "slot", "text", "title", "top", "unit", "wrap", "wrapper"}

KEEP, DROP, OPEN = 1, 0, 2


def _aside(names: str) -> bool:
    """Whether a class or an id names something beside the content: a side word and plain words alone, hyphened or in camel case."""
    for name in names.split():
        parts = {w.lower() for w in _PART.findall(name)}
        side = {w for w in parts if w in SIDE_WORDS or w.startswith(SIDE_STARTS)}
        if side and parts <= side | PLAIN_WORDS:
            return True
    return False


@functools.lru_cache(maxsize=1 << 16)
def _role(tag: str, attributes: str) -> tuple[int, str]:
    """What an element's own markup says of it, and its label in paths: the tag and all classes."""
    own: dict[str, str] = {}
    if attributes.strip(" /"):
        for m in _ATTRIBUTE.findall(attributes):
            own.setdefault(m[0].lower(), entities.unescape(m[1] or m[2] or m[3]))
    classes = own.get("class", "")
    label = tag + "".join(f".{re.sub('[0-9]+', '9', c.lower())}" for c in sorted(set(classes.split())))
    role = own.get("role", "").lower()
    if "hidden" in own or own.get("aria-hidden", "").lower() == "true" or "display:none" in own.get("style", "").replace(" ", "").lower():
        return DROP, label
    if tag in CONTENT or role in CONTENT or own.get("itemprop") == "articleBody":
        return KEEP, label
    if tag in SIDE or role in SIDE_ROLES:
        return DROP, label
    if tag not in ("html", "body") and (_aside(classes) or _aside(own.get("id", ""))):
        return DROP, label
    return OPEN, label


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


@functools.lru_cache(maxsize=1 << 16)
def _place(above: int, label: str) -> int:
    """The digest of a path: of all labels from the root, by the digest of those above."""
    return _digest(f"{above}>{label}")


def blocks(html: str) -> list[tuple[int, int, str, str, int, int]]:
    """(place, place above, label, text, role, number of the outermost content element so far) of a page's blocks of text in page order.

    Character references are decoded piece by piece, so that none arises over a tag; a tag that never ends
    is dropped with what follows, as in browsers.
    """
    out: list[tuple[int, int, str, str, int, int]] = []
    stack: list[tuple[str, int, tuple[int, int, str]]] = []
    held: list[str] = []
    live: Counter[str] = Counter()
    roots = sides = entered = 0
    root = (_place(0, ""), 0, "")
    at, end, last = 0, len(html), html.rfind(">")

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                out.append((*(stack[-1][2] if stack else root), text, DROP if sides else KEEP if roots else OPEN, entered))

    def pop(to: int) -> None:
        nonlocal roots, sides
        for tag, role, _ in stack[to:]:
            live[tag] -= 1
            roots -= role == KEEP
            sides -= role == DROP
        del stack[to:]

    while at < end:
        start = html.find("<", at)
        if start < 0:
            held.append(entities.unescape(html[at:]))
            break
        if start > at:
            held.append(entities.unescape(html[at:start]))
        if html.startswith("<!--", start):
            stop = html.find("-->", start + 2)
            at = end if stop < 0 else stop + 3
            continue
        if html.startswith(("<!", "<?"), start):
            stop = html.find(">", start)
            at = end if stop < 0 else stop + 1
            continue
        found = _OPEN.match(html, start) if start < last else None
        if found is None:
            if _LOOSE.match(html, start):
                break
            held.append("<")
            at = start + 1
            continue
        at = found.end()
        close, tag, attributes = found.groups()
        tag = tag.lower()
        if close:
            if tag == "br":
                flush()
                continue
            if tag not in INLINE:
                flush()
            if live[tag] > 0:
                k = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag)
                if tag in INLINE and any(s[0] not in INLINE for s in stack[k + 1 :]):
                    live[tag] -= 1
                    roots -= stack[k][1] == KEEP
                    sides -= stack[k][1] == DROP
                    del stack[k]
                else:
                    pop(k)
            continue
        if tag in RAW:
            stop = _ends(tag).search(html, at)
            at = at if attributes.endswith("/") and tag == "svg" else end if stop is None else stop.end()
            continue
        if tag in INLINE:
            if tag in VOID:
                continue
            role, label = _role(tag, attributes)
            if role != OPEN:
                flush()
            where = stack[-1][2] if stack else root
        else:
            flush()
            if tag in CLOSES_P:
                for k in range(len(stack) - 1, -1, -1) if live["p"] else ():
                    if stack[k][0] == "p":
                        pop(k)
                        break
                    if stack[k][0] in ("table", "td", "th", "button"):
                        break
            elif tag in SIBLINGS:
                ends, within = SIBLINGS[tag]
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in within and stack[k][0] not in ends:
                        break
                    if stack[k][0] in ends:
                        pop(k)
                        if tag != "tr":
                            break
            if tag in VOID:
                continue
            role, label = _role(tag, attributes)
            if tag == "header" and not roots:
                role = DROP
            above = (stack[-1][2] if stack else root)[0]
            where = (_place(above, label), above, label)
        if len(stack) < DEPTH:
            stack.append((tag, role, where))
            live[tag] += 1
            entered += role == KEEP and not roots
            roots += role == KEEP
            sides += role == DROP
    flush()
    return out


@functools.lru_cache(maxsize=64)
def _ends(tag: str) -> re.Pattern:
    return re.compile(f"</{tag}(?=[\\s/>])[^>]*>", re.I)


def priors(found: list[tuple[int, int, str, str, int, int]]) -> list[float]:
    """What the markup of a page's blocks() adds to the importance of their branches.

    Text beside content elements loses by their share of the text; several content elements with little of
    it (teasers) lose, too. On a page of declared side branches alone, these lose less.
    """
    size = dict.fromkeys((KEEP, DROP, OPEN), 0)
    for *_, text, role, _ in found:
        size[role] += len(text)
    share = min(1.0, 2 * size[KEEP] / max(size[KEEP] + size[OPEN], 1))
    several = len({entered for *_, role, entered in found if role == KEEP}) > 1
    added = {KEEP: 0.2 - (1.2 * (1 - share) if several else 0.0), OPEN: -0.8 * share, DROP: -0.7 if size[KEEP] + size[OPEN] else -0.5}
    return [added[role] for *_, role, _ in found]


_PARSED = "page long, url string, host string, row long, print long, blocks array<struct<path: long, parent: long, prior: double, text: string>>, styles array<struct<parent: long, style: long>>"
_BLOCK = pa.struct([("path", pa.int64()), ("parent", pa.int64()), ("prior", pa.float64()), ("text", pa.string())])
_STYLE = pa.struct([("parent", pa.int64()), ("style", pa.int64())])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part, prints, rows, styles = batch.slice(at, 200), [], [], []
            for html in part.column(3).to_pylist():
                found = blocks(html or "")
                own, children = [], {}
                for (place, above, label, text, _, _), prior in zip(found, priors(found), strict=True):
                    own.append({"path": place, "parent": above, "prior": prior, "text": text})
                    children.setdefault(above, []).append(label)
                rows.append(own)
                styles.append([{"parent": k, "style": _digest("|".join(v))} for k, v in children.items()])
                prints.append(_digest("\0".join(f"{b['path']} {b['text']}" for b in own)))
            number = [int.from_bytes(os.urandom(8), "big", signed=True) for _ in rows]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(number, pa.int64()), pa.array(prints, pa.int64()), pa.array(rows, pa.list_(_BLOCK)), pa.array(styles, pa.list_(_STYLE))], names=["page", "url", "host", "row", "print", "blocks", "styles"])


def _branches(marks: DataFrame, on: DataFrame, shapes: DataFrame, by: list[str], n: str, weight: float) -> DataFrame:
    """(by, path, pages, importance) of one style tree for each value of `by`, from counts n of its branches' texts, pages and sequences of children."""
    k = F.sum(n)
    once = marks.groupBy(*by, "path", "parent", "mark").agg(k.alias("n")).where("n > 0")
    content = once.groupBy(*by, "path", "parent").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.log("n")).alias("h"))
    seen = on.groupBy(*by, "path").agg(k.alias("pages"))
    shown = shapes.groupBy(*by, "parent", "style").agg(k.alias("n")).where("n > 0").groupBy(*by, "parent").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("g"))
    presentation = F.when(F.col("m") > 1, 1 - F.col("g") / F.col("m") / F.log("m")).otherwise(1.0)
    own = F.when(F.col("pages") > 1, F.greatest(F.lit(0.0), 1 - F.col("h") / F.col("all") / F.log("pages"))).otherwise(1.0)
    return content.join(seen, [*by, "path"]).join(shown, [*by, "parent"]).select(*by, "path", "pages", (weight * own + (1 - weight) * presentation).alias("importance"))


def importance(parsed: DataFrame, weight: float = 0.9, strength: float = 4.0) -> DataFrame:
    """(host, path, pages, importance) of the branches of the hosts' style trees.

    A branch on m pages of its host has its own importance with the weight m - 1, and that of the same path
    in one tree over all hosts with `strength`, at most one less the pages it was seen on there. Of a page's
    copies on a host one counts, and one of all in the tree over all hosts. Texts are first counted by branch
    and digest, in every task for itself, so a host with most of the pages makes no large group.
    """
    first = parsed.groupBy("host", "print").agg(F.min("row").alias("row"))
    everywhere = first.groupBy("print").agg(F.min("host").alias("host"), F.lit(1).alias("a"))
    first = first.join(everywhere, ["print", "host"], "left").select("row", "host", F.coalesce("a", F.lit(0)).alias("a"))
    nodes = F.array_distinct(F.transform("blocks", lambda b: F.struct(b["path"].alias("path"), b["parent"].alias("parent"), F.xxhash64(b["text"]).alias("mark"))))
    page = cut(parsed.select("row", "host", nodes.alias("nodes"), "styles").join(first, ["row", "host"]).select("host", "a", "nodes", "styles"))
    counts = F.count("*").alias("n"), F.sum("a").alias("a")
    marks = page.select("host", "a", F.explode("nodes").alias("b")).groupBy("host", "b.path", "b.parent", "b.mark").agg(*counts)
    on = page.select("host", "a", F.explode(F.array_distinct("nodes.path")).alias("path")).groupBy("host", "path").agg(*counts)
    shapes = page.select("host", "a", F.explode("styles").alias("b")).groupBy("host", "b.parent", "b.style").agg(*counts)
    hosts = _branches(marks, on, shapes, ["host"], "n", weight)
    pool = _branches(marks, on, shapes, [], "a", weight).select("path", F.least(F.lit(strength), F.col("pages") - 1).alias("k"), F.col("importance").alias("all"))
    m = F.col("pages") - 1
    drawn = F.when(m + F.col("k") > 0, (m * F.col("importance") + F.col("k") * F.col("all")) / (m + F.col("k"))).otherwise(1.0)
    return hosts.join(pool, "path").select("host", "path", "pages", drawn.alias("importance"))


def main_text(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", least: float = 0.4, broadcast_rows: int = 200_000) -> DataFrame:
    """(id, url, text, n_chars) for every row of pages.

    Null or empty html gives empty text. A block stays where its branch's importance on the host and its own
    prior add up to `least` or more, equality included; a branch seen on one page in the whole table counts as
    1. Pages without a url share one host. Repeated rows give equal rows. Other columns are not used, so their
    names can't clash.
    """
    bounded(pages.sparkSession, rows=1024)
    host = F.lower(F.coalesce(F.regexp_extract(url_column, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))
    rows = pages.select(F.col(id_column).cast("long").alias("page"), F.col(url_column).cast("string").alias("url"), host.alias("host"), F.col(html_column).cast("string").alias("html"))
    parsed = cut(rows.mapInArrow(_parsed, _PARSED))
    # No prior lets a branch of 0.9 or more go, but for those that always do.
    known = cut(importance(parsed).where("importance < 0.9").select("host", "path", "importance"))
    own = parsed.select("page", "url", "host", "row", "blocks")
    if known.count() <= broadcast_rows:
        tree = known.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("path", "importance"))).alias("tree"))
        joined = own.join(F.broadcast(tree), "host", "left")
    else:
        each = own.select("host", "row", F.explode(F.array_distinct("blocks.path")).alias("path")).join(known, ["host", "path"])
        tree = each.groupBy("host", "row").agg(F.map_from_entries(F.collect_set(F.struct("path", "importance"))).alias("tree"))
        joined = own.join(tree, ["host", "row"], "left")
    stays = F.filter("blocks", lambda b: F.coalesce(F.element_at("tree", b["path"]), F.lit(1.0)) + b["prior"] >= least)
    text = F.array_join(F.transform(stays, lambda b: b["text"]), " ")
    return joined.select(F.col("page").alias(id_column), F.col("url").alias(url_column), text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
