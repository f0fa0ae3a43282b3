"""Operator 5: parsing, and the style tree against brute force."""

from __future__ import annotations

import math
import time
from collections import Counter, defaultdict

import pytest

from foliant.llm.frames import cut
from foliant.llm.pages import _PARSED, _parsed, blocks, importance, main_text


def texts(html):
    return [(text, role) for *_, text, role, _ in blocks(html)]


def test_blocks_by_clause():
    assert texts('<article><p class="social-science">One</p><p id="search-results-study">Two</p></article>') == [("One", 1), ("Two", 1)]
    assert texts("<article>a &am<b>p;</b> &amp;amp; <math><mi>x</mi></math> <noscript>see</noscript></article>") == [("a &amp; &amp; x", 1), ("see", 1)]
    gone = "<nav>n</nav><header>h</header><footer>f</footer><aside>s</aside><form>q<input></form><div class=comment-list>c</div><div class=advertBox>v</div><div id=cookie-notice>k</div><p hidden>z</p>"
    assert {role for _, role in texts(gone)} == {0}
    assert texts("<script>a<b></script><style>p{}</style><title>t</title><!-- c --><!doctype html><svg><text>g</text></svg>") == []
    assert texts("<p>a<p>b<br>c \n\t d&nbsp;e<td>1 < 2<img alt='x>y'> end<a") == [("a", 2), ("b", 2), ("c d e", 2), ("1 < 2 end", 2)]
    assert texts("") == texts("<p> </p>") == []


@pytest.mark.parametrize("piece", ['<a "', '<a ="> ', "<a b='", "<div>", "</span><div>", "<b><div>", "<script>", "<!--", "&", "< ", "<p>x", "<li>y"])
def test_long_pages_take_linear_time(piece):
    t = time.process_time()
    blocks(piece * 100_000)
    assert time.process_time() - t < 12


def test_deep_paths_differ_by_all_their_elements():
    deep = lambda top: f"<div class={top}>" + "<div><p class='a b'>" * 20 + "x"
    assert len({blocks(deep(t))[0][0] for t in ("one", "two")}) == 2
    assert blocks("<p class='b a'>x")[0][0] == blocks("<p class='a b'>x")[0][0] != blocks("<p class='a'>x")[0][0]
    assert len(blocks("<div>" * 3000 + "x" + "</div>" * 3000 + "y")) == 2


def _entropies(pages, by):
    """(by, path): (distinct pages, importance) of the branches of trees over pages of (host, blocks), the plain way."""
    seen, content, shapes, parents, count = set(), defaultdict(Counter), defaultdict(Counter), {}, Counter()
    for host, found in pages:
        marks = tuple(dict.fromkeys((b[0], b[3]) for b in found))
        key = (by(host), marks)
        if key in seen:
            continue
        seen.add(key)
        children = defaultdict(list)
        for place, above, label, *_ in found:
            children[above].append(label)
            parents[place] = above
        for above, labels in children.items():
            shapes[by(host), above][tuple(labels)] += 1
        for place, text in marks:
            content[by(host), place][text] += 1
        for place in {m[0] for m in marks}:
            count[by(host), place] += 1

    def spread(c, n):
        total = sum(c.values())
        return max(0.0, 1 - sum(v * math.log(v) for v in c.values()) / total / math.log(n)) if n > 1 else 1.0

    shape = lambda c: spread(c, sum(c.values()))
    return {k: (count[k], 0.9 * spread(c, count[k]) + 0.1 * shape(shapes[k[0], parents[k[1]]])) for k, c in content.items()}


def _pages():
    page = lambda i, k: f"<body><nav>Way</nav><div class=top>Hello {i % k}</div><article><p>Story {i}</p>{'<p>More</p>' * (i % 3)}<p class=onward>Read on</p></article><div>End</div></body>"
    rows = [(i, "http://a.org/x", page(i % 9, 2)) for i in range(12)] + [(20 + i, "https://u@B.org:8/", page(i, 3)) for i in range(3)] + [(40, "http://c.org", page(0, 1)), (41, None, page(5, 9)), (42, None, None), (43, "http://a.org", ""), (0, "http://a.org/x", page(0, 2))]
    return rows


def test_importance_is_that_of_the_merged_trees(spark):
    rows = _pages()
    hosts = [("a.org" if u and "a.org" in u else "b.org" if u and "B.org" in u else "c.org" if u else "") for _, u, _ in rows]
    given = spark.createDataFrame([(i, u, h, t) for (i, u, t), h in zip(rows, hosts, strict=True)], "page long, url string, host string, html string")
    got = {(r.host, r.path): (r.pages, r.importance) for r in importance(cut(given.mapInArrow(_parsed, _PARSED))).collect()}
    found = [(h, blocks(t or "")) for (_, _, t), h in zip(rows, hosts, strict=True)]
    own, all_ = _entropies(found, lambda h: h), _entropies(found, lambda h: "")
    assert set(got) == set(own) and len(got) > 10
    for (h, path), (n, x) in own.items():
        k = min(4, all_["", path][0] - 1)
        want = ((n - 1) * x + k * all_["", path][1]) / (n - 1 + k) if n - 1 + k else 1.0
        assert got[h, path][0] == n and abs(got[h, path][1] - want) < 1e-9


def test_both_ways_to_join_the_tree_agree(spark):
    df = spark.createDataFrame(_pages(), "page_id long, url string, html string")
    small, large = ({(r.page_id, r.url, r.text, r.n_chars) for r in main_text(df, broadcast_rows=n).collect()} for n in (200_000, 0))
    assert small == large and len(small) == 19
    got = {r[0]: r[2] for r in small}
    assert all(t.startswith("Story") and "Read on" not in t and "End" not in t for i, t in got.items() if i < 40)
    assert got[42] == got[43] == "" and "Way" not in " ".join(got.values())
