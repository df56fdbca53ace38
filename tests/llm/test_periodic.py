import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colloquy.llm import periodic
from colloquy.llm.periodic import collapse_runs, previous_factors, runs_of
from colloquy.llm.queries import op12_periodic_runs


def brute_force(words, least=12):
    """(start, end, period) of every run, by trying all periods."""
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted(((a, b, p) for (a, b), p in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for a, b, p in runs for i in range(a + p, b)}
    return [w for i, w in enumerate(words) if i not in gone]


def random_words(rng, most=120):
    k, words = rng.choice([1, 2, 2, 3, 4, 9]), []
    while len(words) < rng.randint(0, most):
        if rng.random() < 0.5 and words:
            a, n = rng.randrange(len(words)), rng.randint(1, 20)
            words += words[a : a + n] * rng.randint(1, 4)
        else:
            words += [rng.choice("abcdefghi"[:k]) for _ in range(rng.randint(1, 6))]
    return words


@pytest.mark.parametrize("least", [5, 8, 12, 30])
def test_runs_of_random_documents(least, monkeypatch):
    monkeypatch.setattr(periodic, "PAIRS", 50)
    rng = random.Random(least)
    total = 0
    for _ in range(250):
        docs = [random_words(rng) for _ in range(rng.randint(1, 4))]
        expected = [brute_force(d, least) for d in docs]
        assert runs_of([[w.encode() for w in d] for d in docs], least) == expected
        total += sum(map(len, expected))
    assert total > 100


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b"]), max_size=80))
def test_runs_over_two_words(words):
    assert runs_of([words], 5) == [brute_force(words, 5)]


def test_longest_previous_factors():
    rng = random.Random(2)
    for _ in range(200):
        words = [rng.choice("ab") for _ in range(rng.randint(1, 30))]
        n = len(words)
        order = sorted(range(n), key=lambda i: words[i:])
        common = lambda i, j: next((k for k in range(n) if max(i, j) + k >= n or words[i + k] != words[j + k]), n)
        longest, source = previous_factors(order, [0] + [common(a, b) for a, b in zip(order, order[1:], strict=False)], n)
        for i in range(n):
            assert longest[i] == max((common(i, j) for j in range(i)), default=0)
            assert not longest[i] or (source[i] < i and common(i, source[i]) == longest[i])


def test_texts_are_collapsed(spark):
    rng = random.Random(5)
    texts = [" ".join(random_words(rng)) for _ in range(60)]
    texts += [None, "", " \n\t", "a " * 40, "x " + "b c " * 20 + "d", "é e " * 15, ("p q r s t u v w " * 5).replace(" ", "\n", 3), "word " * 30_000, " ".join(str(i % 4000) for i in range(20_000)), texts[3], texts[3]]
    frame = spark.createDataFrame([(None if i % 9 == 8 else i % 50, t, "mine", 7) for i, t in enumerate(texts)], "doc_id long, text string, runs string, start int")
    got = collapse_runs(frame)
    assert got.columns == ["doc_id", "text", "start", "runs"]
    expected = []
    for i, t in enumerate(texts):
        words = (t or "").encode().split()
        runs = brute_force(words) if len(words) < 1000 else {30_000: [(0, 30_000, 1)], 20_000: [(0, 20_000, 4000)]}[len(words)]
        expected.append((None if i % 9 == 8 else i % 50, None if t is None else b" ".join(collapsed(words, runs)).decode(), 7, [(a, b - a, p) for a, b, p in runs]))
    assert sorted(((r.doc_id, r.text, r.start, [tuple(x) for x in r.runs]) for r in got.collect()), key=str) == sorted(expected, key=str)
    assert collapse_runs(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs_of([[b"a"]], 4)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in op12_periodic_runs(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    some = 0
    for d in sorted(docs, key=lambda d: len(d.text or ""))[:150]:
        words = (d.text or "").encode().split()
        h = zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute_force(words)
        best = min(((a - b, a, p) for a, b, p in runs), default=None)
        r = got[d.doc_id]
        sha = lambda data: hashlib.sha256(data).hexdigest()
        assert r.n_runs == len(runs) and r.runs_sha256 == sha("".join(f"{a},{b - a},{p}\n" for a, b, p in runs).encode()) and r.collapsed_sha256 == sha(b" ".join(collapsed(words, runs)))
        assert (r.start, r.length, r.period, r.exponent_milli) == ((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4)
        some += bool(runs)
    assert some > 5
