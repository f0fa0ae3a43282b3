from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm import arrays
from foliant.llm.brown import exchange
from foliant.llm.decontaminate import FMIndex, suffix_array, without_spans
from foliant.llm.minhash import bands, registers, shared_counts
from foliant.llm.pages import blocks
from foliant.llm.pseudonyms import card, date, ipv4, luhn, permute, pseudonymised

KEY = b"key"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\t\n\x0b\x00-9|ñ ", max_size=30)), max_size=8))
def test_words_are_the_patterns(texts):
    for table, pattern in ((arrays.SPACED, r"[^\x20\x09-\x0D]+"), (arrays.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        got = []
        for i, j, bound, value in arrays.word_rows(pa.array(texts, pa.string()), table):
            got += [list(value[bound[k] : bound[k + 1]]) for k in range(j - i)]
        want = [[arrays.hash_word(w.encode(), table) for w in re.findall(pattern, lower(t or ""))] for t in texts]
        assert got == want


def test_long_rows_are_ranges_of_their_own():
    texts = pa.array(["a b", "x " * arrays.SLICE_BYTES, "c"], pa.string())
    assert [np.diff(b).tolist() for _, _, b, _ in arrays.word_rows(texts)] == [[2], [arrays.SLICE_BYTES], [1]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60))
def test_fm_index_finds_what_is_there(symbols):
    text = np.array([*symbols, 0])
    index = FMIndex(text, 3)
    tails = [text[i:] for i in suffix_array(text)]
    assert sorted(len(t) for t in tails) == list(range(1, len(text) + 1))
    for pattern in ([1], [1, 2], [3, 3], [2, 1, 2]):
        low, high = index.search(np.array([pattern]))
        found = sorted(index.locate(np.arange(low[0], high[0])).tolist())
        assert found == [i for i in range(len(text)) if text[i : i + len(pattern)].tolist() == pattern]


def test_spans_leave_the_rest():
    assert without_spans("One, two three. Four", [(1, 3)]) == "One, . Four"


def test_sketches():
    rng = np.random.default_rng(1)
    own = np.unique(rng.integers(0, 1 << 63, 5).astype(np.uint64))
    assert (bands(np.stack([registers(own), registers(own)]))[0] == bands(registers(own)[None])[0]).all()
    sets = [np.unique(rng.integers(0, 50, 20).astype(np.uint64)) for _ in range(12)]
    counts = shared_counts(sets[:7], sets[3:], width=7)
    assert counts.tolist() == [[len(np.intersect1d(a, b)) for b in sets[3:]] for a in sets[:7]]


def test_exchange_ends_where_no_move_helps():
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 40, (23, 23)) * (rng.random((23, 23)) < 0.4)

    def information(own):
        member = np.zeros((23, 4))
        member[np.arange(23), own] = 1
        joint = member.T @ counts @ member
        f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return f(joint) - f(joint.sum(axis=0)) - f(joint.sum(axis=1))

    own = exchange(counts, 4, passes=50)
    assert own[0] == 0 and (own[1:] > 0).all()
    for w in range(1, 23):
        for c in range(1, 4):
            other = own.copy()
            other[w] = c
            assert information(other) <= information(own) + 1e-6


def test_main_text():
    page = "<html><head><title>t</title></head><body><header>site</header><nav><a>m</a></nav><article><header><h1>H</h1></header><p>a &amp; b<p>c<b>d</b>e<br>f<div class='comments'>no</div><script>'</p>'</script><form>x</form></article><footer>f</footer><p"
    assert " ".join(t for *_, t, r, _ in blocks(page) if r == 1) == "H a & b cde f"
    assert blocks("") == []
    assert [r for *_, r, _ in blocks("<body><div>x</div><div class='ad'>y</div><div class='adBox'>z</div><p id='sidebarleft'>s</p><p class='shadow headline'>k</p>")] == [2, 0, 0, 0, 2]


def test_pseudonyms():
    assert sorted(permute(i, 777, KEY, "t") for i in range(777)) == list(range(777))
    n = "4918187128635271"[:15]
    whole = n + str(luhn(n))
    new = card(whole, KEY)
    assert new != whole and len(new) == 16 and luhn(new[:-1]) == int(new[-1]) and card(whole[:-1] + str((int(whole[-1]) + 1) % 10), KEY) is None
    assert re.fullmatch(r"\d\d/\d\d/\d{4}", date("29/02/2024", KEY)) and date("30/02/2024", KEY) is None
    assert ipv4("256.1.1.1", KEY) is None and re.fullmatch(r"(\d+\.){3}\d+", ipv4("10.1.2.3", KEY))
    text = "from 10.1.2.3 to 10.1.2.3, a.b@x.org, 2024-02-29"
    new, kinds = pseudonymised(text, KEY)
    assert kinds == ["ip", "ip", "email", "date"] and len(set(re.findall(r"\d+\.\d+\.\d+\.\d+", new))) == 1 and "@x.org" in new
    new, kinds = pseudonymised(f"call +1 (578) 555-6437 {whole} 17.252.227.210 or {whole[:4]}-{whole[4:8]}-{whole[8:12]}-{whole[12:]}", KEY)
    assert kinds == ["phone", "card", "ip", "card"] and re.sub("-", "", new.split()[-1]) in new.split()[-4:] and whole not in new
    assert pseudonymised(None, KEY) == (None, []) and pseudonymised("", KEY) == ("", [])


def test_pseudonyms_of_all_values_of_a_format():
    for text, kind in (("+1 (017) 555-7713", "phone"), ("(017) 555-7713", "phone"), ("+44 20 7946 0958", "phone"), ("+49 30 123456", "phone"), ("233.254.104.120", "ip"), ("0.1.2.3", "ip"), ("8.8.8.8", "ip"), ("12/25/2020", "date")):
        new, kinds = pseudonymised(f"at {text} or", KEY)
        assert kinds == [kind] and text not in new and re.sub("[0-9]+", "9", new) == re.sub("[0-9]+", "9", f"at {text} or")
        assert new[3:-3] in pseudonymised(f"12 and {text}, 2020", KEY)[0]
    assert pseudonymised("+442079460958", KEY)[0][3:] == re.sub("[^0-9]", "", pseudonymised("+44 20 7946 0958 10.2.3.4", KEY)[0][4:16])
    assert pseudonymised("+44 20 7946 0958 10.2.3.4", KEY)[1] == ["phone", "ip"] and pseudonymised("abcdef" * 6, KEY)[1] == ["secret"]
    dates = [f"{m:02d}/{d}/2020" for m in range(1, 13) for d in range(13, 29)]
    assert len({date(x, KEY) for x in dates}) == len(dates) and all(int(date(x, KEY)[3:5]) > 12 for x in dates) and date("13/13/2020", KEY) is None
