import random
import re
from collections import Counter

import numpy as np
import pytest

from colloquy.llm import divergence
from colloquy.llm.divergence import audit_sources, scaled_shares


def brute_force(docs, min_docs=10, top=10):
    """docs: (lang, source, text); rows (lang, source, part, item, value, rank)."""
    counts, seen, groups = {}, {}, {}
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups.setdefault(lang, set()).add(source)
        counts.setdefault((lang, source), Counter()).update(terms)
        for t in set(terms):
            seen[lang, t] = seen.get((lang, t), 0) + 1
    out = []
    for lang, sources in groups.items():
        kept = [t for (own, t), n in seen.items() if own == lang and n >= min_docs]
        v = len(kept)

        def shares(own, kept=kept, v=v):
            n = sum(own[t] for t in kept)
            return {t: 1 + 10**9 * (own[t] + 2) // (n + 2 * v) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s))
            term = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t])[:top]
            out += [(lang, s, "pair", o.decode(), -n, k) for k, (n, o) in enumerate(pair, 1)] + [(lang, s, "term", t.decode(), -n, k) for k, (n, t) in enumerate(term, 1)]
    return sorted(out)


def corpus(seed=1, n=400):
    rng = random.Random(seed)
    words = [f"w{chr(97 + k)}{chr(97 + k % 5)}" for k in range(26)] + ["É", "é", "天气", "Z", "z", "ÿ", "\U0001f600", "￿"]
    docs = []
    for _ in range(n):
        lang, source = rng.choice(["en", "en", "de", None, "only"]), rng.choice(["a", "a", "b", "ü", None, "Z"])
        docs.append((lang, source if lang != "only" else "a", "".join(rng.choice(words).title() + rng.choice(" 1_[\n\x00{") for _ in range(rng.randint(0, 30)))))
    docs += [("xx", "a", "rare words"), ("xx", "b", "123 _"), ("xx", "c", None), ("solo", "s", "one"), docs[0], docs[0]]
    docs += [("same", s, "tie both") for s in "abc" for _ in range(10)]
    return docs


@pytest.mark.parametrize("cells, widths, held", [(1 << 20, (64, 8192), 300_000), (8, (1, 3), 7)])
def test_against_brute_force(spark, monkeypatch, cells, widths, held):
    monkeypatch.setattr(divergence, "CELLS", cells)
    monkeypatch.setattr(divergence, "WIDTHS", widths)
    monkeypatch.setattr(divergence, "HELD_ENTRIES", held)
    docs = corpus()
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "lang string, source string, text string, rank int, term string")
    got = audit_sources(frame)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    expected = brute_force(docs)
    assert sorted(map(tuple, got.collect())) == expected and len(expected) > 100
    assert {r[4] for r in expected if r[0] in ("xx", "same") and r[2] == "pair"} == {0}


def test_very_long_texts_are_counted_in_parts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "LONG_TEXT", 100)
    long = " ".join(["alpha", "beta" * 60, "é" * 70, "x"] * 50)
    assert sorted(t for part in divergence._terms(long.encode()) for t in part) == sorted(divergence.TERM.findall(long.encode()))
    docs = [("en", "a", long)] * 12 + [("en", "b", "alpha x x")] * 3
    frame = spark.createDataFrame(docs, "lang string, source string, text string")
    assert sorted(map(tuple, audit_sources(frame).collect())) == brute_force(docs)


def test_empty_table(spark):
    assert audit_sources(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_shares_are_exact_for_large_counts():
    rng = random.Random(6)
    for _ in range(300):
        total = rng.randint(1, 2**52)
        count = rng.randint(0, total)
        assert int(scaled_shares(np.array([count]), total)[0]) == 10**9 * count // total
    n = np.array([2**40 + 3, 5, 2**50], np.int64)
    assert divergence._exact_bincount(np.array([1, 0, 1]), n, 3).tolist() == [5, 2**40 + 3 + 2**50, 0]
