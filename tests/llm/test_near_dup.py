import itertools
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from colloquy.llm import near_dup
from colloquy.llm.components import components
from colloquy.llm.near_dup import BINS, drop_near_duplicates, icws, near_duplicates


def union_find(pairs, nodes):
    top = {n: n for n in nodes}

    def find(n):
        while top[n] != n:
            n = top[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    links = spark.createDataFrame(pairs, "a long, b long")
    found = {r.node: r.component for r in components(links).df.collect()}
    assert found == union_find(pairs, {n for p in pairs if p[0] != p[1] for n in p})
    assert components(links.limit(0)).df.count() == 0


def shingles(text):
    words = (text or "").lower().split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def corpus(seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 6)))
    docs = []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(60, 300))]
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                copy[rng.randrange(len(copy))] = word()
            docs.append(" ".join(copy))
    docs += [" ".join(word() for _ in range(n)) for n in (1, 2, 4, 5, 6, 400)] + ["one two", "One\ttwo", "", " \n", None, None]
    rng.shuffle(docs)
    return list(enumerate(docs))


def brute_force(docs, threshold=0.8):
    """Classes by the weighted Jaccard similarity of all pairs of multisets of shingles; weights as documented, from plain counts."""
    bags = {i: shingles(t) for i, (_, t) in enumerate(docs)}
    frequency = Counter(s for bag in bags.values() for s in bag)
    worth = {s: round(100 * max(1.0, 1 + math.log((len(docs) + 1) / (f + 1))) ** 0.25) / 100 for s, f in frequency.items()}
    size = {i: sum(n * worth[s] for s, n in bag.items()) for i, bag in bags.items()}
    pairs = []
    for i, j in itertools.combinations(bags, 2):
        small, large = sorted((i, j), key=lambda k: len(bags[k]))
        both = sum(min(n, bags[large][s]) * worth[s] for s, n in bags[small].items() if s in bags[large])
        if both and both >= threshold * (size[i] + size[j] - both) - 1e-9:
            pairs.append((docs[i][0], docs[j][0]))
    return union_find(pairs, [d for d, _ in docs])


def test_against_all_pairs(spark):
    docs = corpus()
    expected = brute_force(docs)
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, class_id string")
    rows = near_duplicates(frame).collect()
    assert {r.doc_id: r.class_id for r in rows} == expected and len(rows) == len(docs)
    kept = drop_near_duplicates(frame)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {d for d, c in expected.items() if d == c}


def test_buckets_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    docs = corpus(6)
    rows = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in rows} == brute_force(docs)


def test_weighted_jaccard_is_that_of_multisets():
    left, right = "a b c d e f a b c d e f", "a b c d e f g a b c d e"
    a, b = shingles(left), shingles(right)
    expected = sum((a & b).values()) / sum((a | b).values())
    plain = lambda *texts: pa.array([bytes([100]) * len(shingles(t)) for t in texts], pa.binary())
    assert np.allclose(near_dup.weighted_jaccard(pa.array([left, "", None]), pa.array([right, "", "x"]), plain(left, "", None), plain(right, "", "x")), [expected, 0, 0])


def test_samples_agree_as_often_as_texts_are_alike():
    rng = np.random.default_rng(0)
    shared, only_a, only_b = (rng.integers(0, 1 << 44, n).astype(np.uint64) for n in (20_000, 3000, 3000))
    for factor in (1.0, 2.0):
        ids = np.concatenate([shared, only_a]), np.concatenate([shared, only_b])
        worth = np.ones(23_000), np.concatenate([np.full(20_000, factor), np.ones(3000)])
        rates = []
        for k in range(40):
            salt = np.uint64(k * 7919)
            one, two = (icws(np.zeros(len(i), np.int64), (i + salt) & near_dup._ID_MASK, w, 1) for i, w in zip(ids, worth, strict=True))
            rates.append((one == two).mean())
        similarity = 20_000 / (20_000 * factor + 6000)
        assert abs(np.mean(rates) - similarity) < 4 * np.sqrt(similarity * (1 - similarity) / (40 * BINS)) + 0.01


def test_rows_without_ids_and_shared_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    frame = spark.createDataFrame([(None, text), (5, text), (5, "another one"), (7, "Another  one"), (9, None), (None, None)], "doc_id long, text string")
    rows = sorted(((r.doc_id, r.class_id) for r in near_duplicates(frame).collect()), key=str)
    assert rows == [(5, 5), (5, 5), (7, 5), (9, 9), (None, None), (None, None)]
    assert drop_near_duplicates(frame).count() == 5
    assert near_duplicates(frame.limit(0)).count() == 0


def test_weights_are_of_exact_frequencies(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "SHARD_BYTES", 20_000)
    run = lambda name, n: [f"{name}{k}" for k in range(n)]
    base, ends = run("base", 124), [run("x", 17), run("y", 17)]
    docs = [(i, " ".join(base + ends[i])) for i in (0, 1)]
    docs += [(2 + i, " ".join(run(f"d{i}w", 60) + ends[i % 2])) for i in range(396)] + [(None, None), (900, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    frequency = Counter(s for _, t in docs for s in shingles(t))
    signed = near_dup.signed_documents(frame).df.collect()
    assert len(signed) == len(docs)
    for r in signed:
        expected = near_dup._codes(len(docs), np.array([frequency[s] for s in shingles(r.text)]))
        assert sorted(r.codes) == sorted(expected.tolist())
    assert {r.doc_id: r.class_id for r in near_duplicates(frame).collect()} == {d: 0 if d == 1 else d for d, _ in docs}


def test_long_texts_are_compared_whole(spark):
    rng = random.Random(11)
    base = [f"w{rng.randrange(5000)}" for _ in range(150_000)]
    other = base[:40_000] + [f"v{rng.randrange(5000)}" for _ in range(110_000)]  # alike at the beginning only
    near = base[:-2000] + ["x"] * 2000
    docs = [(3, " ".join(base)), (4, " ".join(other)), (5, " ".join(near)), (6, " ".join(base)), (7, "short text of six words only")]
    rows = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in rows} == {3: 3, 4: 4, 5: 3, 6: 3, 7: 7}
