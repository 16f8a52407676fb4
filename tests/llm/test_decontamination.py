import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidetable.llm import decontamination, fm_index
from tidetable.llm.common import materialize

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return [(m.group(), m.start(), m.end()) for m in WORD.finditer((text or "").translate(LOWER))]


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = [x for x, _, _ in words_of(text)]
        size = min(10, len(w))
        for i in range(len(w) - size + 1) if w else ():
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    out = []
    for doc, text in docs:
        w = words_of(text)
        hit, named = set(), set()
        for i in range(len(w)):
            for size in range(1, 11):
                if (ids := windows.get(tuple(x for x, _, _ in w[i : i + size]))) and i + size <= len(w):
                    hit |= set(range(i, i + size))
                    named |= {x for x in ids if x is not None}
        spans = []
        for i in sorted(hit):
            if i - 1 in hit:
                spans[-1] = (spans[-1][0], w[i][2])
            else:
                spans.append((w[i][1], w[i][2]))
        out.append((doc, len(w), len(hit), tuple(spans), tuple(sorted(map(str, named)))))
    return sorted(out, key=str)


def found(spark, docs, items, extra=False, **options):
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    d = d.selectExpr("*", "1 AS words", "2 AS item", "3 AS n_hit") if extra else d
    b = spark.createDataFrame(items, "item_id bigint, text string")
    b = b.selectExpr("*", "1 AS words", "2 AS item") if extra else b
    got = decontamination.find(d, materialize(decontamination.phrases(b), "phrases"), **options).collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple((s["start"], s["end"]) for s in r["spans"]), tuple(r["items"])) for r in got), key=str)


PASSAGE = "one two three four five six seven eight nine ten eleven twelve"
DOCS = [
    (1, None), (2, ""), (3, "... !?"), (4, f"before {PASSAGE} after"), (4, f"before {PASSAGE} after"), (None, PASSAGE.upper()), (5, "one two three four five six seven eight nine"),
    (6, f"{PASSAGE} {PASSAGE}"), (7, "tiny Übung, tiny übung; TINY"), (8, "one-two.three\x00four,five six\nseven eight nine ten"), (9, "日本語 tiny 日本語"), (10, " ".join(["a"] * 30)), (11, f"{'x ' * 3000}{PASSAGE}{' y' * 3000}"),
]
ITEMS = [(1, PASSAGE), (12, PASSAGE), (2, "tiny"), (3, None), (4, ""), (5, " ?! "), (None, "übung"), (7, " ".join(["a"] * 12)), (7, "日本語 tiny 日本語"), (100, "seven eight nine ten eleven twelve one two three four five")]


@pytest.mark.parametrize("options", [{}, {"block": 2}, {"shard": 12}, {"block": 3, "shard": 25}])
def test_odd_rows(spark, options):
    assert found(spark, DOCS, ITEMS, **options) == brute(DOCS, ITEMS)


def test_extra_columns_and_empty_tables(spark):
    assert found(spark, DOCS, ITEMS, extra=True) == brute(DOCS, ITEMS)
    assert found(spark, [], ITEMS) == []
    assert found(spark, DOCS, []) == brute(DOCS, [])


def test_random_texts(spark):
    rng = np.random.default_rng(3)
    draw = lambda n: " ".join(rng.choice(["a", "b", "C", "é"], n))
    items = [(i, draw(int(rng.integers(0, 14)))) for i in range(40)]
    docs = [(i, draw(int(rng.integers(0, 400)))) for i in range(40)] + [(100 + i, f"{draw(20)} {items[i][1]} {draw(5)}") for i in range(40)]
    assert found(spark, docs, items, shard=300) == brute(docs, items)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=40), min_size=1, max_size=6), st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=6), min_size=1, max_size=8))
def test_index_finds_all_places(texts, patterns):
    words = np.array([w for t in texts for w in t], np.uint64) << np.uint64(40)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    index = fm_index.FmIndex(words, row)
    for p in patterns:
        p = np.array(p, np.uint64) << np.uint64(40)
        low, high = index.search(index.symbols(p)[None, ::-1])
        got = sorted(index.locate(np.arange(low[0], high[0])).tolist())
        assert got == [i for i in range(len(words) - len(p) + 1) if (words[i : i + len(p)] == p).all() and row[i] == row[i + len(p) - 1]]


def test_suffixes_are_sorted():
    rng = np.random.default_rng(0)
    s = np.append(0, np.append(rng.integers(0, 3, 500), 0))
    unique = s + np.where(s == 0, np.arange(len(s)), 10_000)  # separators differ by place and are least
    assert fm_index.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: unique[i:].tolist())


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 37, 1000)
    m = fm_index.WaveletMatrix(s, 37)
    at, symbol = rng.integers(0, 1001, 300), rng.integers(0, 37, 300)
    assert m.rank(symbol, at).tolist() == [int((s[:i] == c).sum()) for c, i in zip(symbol, at)]
    got, rank = m.access(np.arange(1000))
    assert got.tolist() == s.tolist() and rank.tolist() == [int((s[:i] == s[i]).sum()) for i in range(1000)]


def test_digest_of_no_items(spark):
    from tidetable.llm import queries

    rows = queries.queries()["op11_fm_index"](spark, "/root/testdata/sf0.001").collect()
    assert {r["items_sha256"] for r in rows if r["n_items"] == 0} == {hashlib.sha256(b"").hexdigest()}
    assert any(r["contaminated"] for r in rows) and not all(r["contaminated"] for r in rows)
