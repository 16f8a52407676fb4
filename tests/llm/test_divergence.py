import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidetable.llm import divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs, least, top):
    docs = [((lang or ""), (source or ""), TERM.findall((text or "").translate(LOWER))) for text, lang, source in docs]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = Counter(t for _, _, w in mine for t in set(w))
        kept = {t for t, n in seen.items() if n >= least}
        counts = defaultdict(Counter)
        for _, source, w in mine:
            counts[source].update(t for t in w if t in kept)
        every = sum(counts.values(), Counter())

        def share(c, t, v=len(kept)):
            return 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * v)

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        for s, c in counts.items():
            parts = {"pair": [(o, sum(f(share(c, t), share(d, t)) for t in kept)) for o, d in counts.items() if o != s], "term": [(t, f(share(c, t), share(every, t))) for t in kept if c[t] and share(c, t) > share(every, t)]}
            for part, rows in parts.items():
                rows = sorted(rows, key=lambda r: (-r[1], r[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(rows) if part == "pair" or i < top]
    return sorted(out)


def found(spark, docs, least=3, top=4, extra=False):
    df = spark.createDataFrame(docs, "text string, lang string, source string")
    df = df.selectExpr("*", "1 AS term", "2 AS n", "3 AS docs", "4 AS number", "5 AS shard") if extra else df
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in divergence.audit(df, least=least, top=top).collect())


def rows(seed, n):
    rng = np.random.default_rng(seed)
    words = ["the", "The", "of", "Über", "über", "日本", "x", "y9z", "a-b", "tie", "tye", "rare%d"]
    make = lambda: " ".join(w % rng.integers(9) if "%" in w else w for w in rng.choice(words, int(rng.integers(0, 30))))
    return [(make(), str(rng.choice(["en", "de"])), f"s{rng.integers(5)}") for _ in range(n)]


ODD = [(None, None, None), ("", "en", "s0"), ("12 %%", "en", "only marks"), ("the the", None, "a"), ("the", "", None), ("the of", "fr", "alone"), ("the tie " * 3000, "en", "s1")]


def test_equal_to_brute_force(spark):
    docs = rows(1, 120) + ODD + [("of tie", "en", "s2")] * 50
    assert found(spark, docs) == brute(docs, 3, 4)


@pytest.mark.parametrize("name, value", [("SEARCH_SHARD", 2), ("PAIR_SHARD", 3), ("SOURCE_BLOCK", 2), ("CELLS", 4), ("RUN", 1), ("BROADCAST_ROWS", 0)])
def test_parts_of_any_size(spark, monkeypatch, name, value):
    docs = rows(2, 80) + ODD
    expected = brute(docs, 3, 4)
    monkeypatch.setattr(divergence, name, value)
    assert found(spark, docs) == expected


def test_nothing_kept_empty_and_clashing_names(spark):
    docs = rows(3, 30)
    assert found(spark, docs, least=10_000) == brute(docs, 10_000, 4)
    assert found(spark, []) == []
    assert found(spark, docs, extra=True) == brute(docs, 3, 4)


def test_search_stops_early_and_is_exact():
    rng = np.random.default_rng(5)
    n = rng.integers(1, 30, 4000)
    all_n = n + rng.integers(0, 4000, 4000)
    names = [f"t{i:05}" for i in range(4000)]
    size, lang_size, terms = int(n.sum()), int(all_n.sum()), 4000
    p, q = divergence.shares(n, size, terms), divergence.shares(all_n, lang_size, terms)
    value = divergence.divergence(p, q)
    expected = sorted((-int(v), names[i], i) for i, v in enumerate(value) if p[i] > q[i])[:10]
    asked = []

    class Names(list):
        def __getitem__(self, i):
            asked.append(i)
            return names[i]

    at, got = divergence.search_terms(n, all_n, Names(names), size, lang_size, terms)
    assert [(-v, names[i], i) for i, v in zip(at.tolist(), got.tolist())] == expected
    assert len(asked) < 1000


def test_shares_are_exact():
    for count, size, terms in ((0, 0, 1), (10**15, 4 * 10**15, 10**6), (7, 9, 3), (10**12, 10**12, 1)):
        assert divergence.shares(np.array([count]), size, terms).tolist() == [1 + 10**9 * (count + 2) // (size + 2 * terms)]
