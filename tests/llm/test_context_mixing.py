import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from colloquy.llm import context_mixing as cm
from colloquy.llm.context_mixing import Asked, Code, Mixer, laid_out, pairs_at, said, score_texts, tails
from colloquy.llm.lexing import text_bytes


class Trained:
    """Code and counts of texts; what `score_texts` does with tables, in one process."""

    def __init__(self, texts, bits=40):
        data, offsets = text_bytes(pa.array(texts, pa.string()))
        buffer, places, _ = laid_out(data, offsets)
        self.code = Code.of(np.bincount(pairs_at(buffer, places), minlength=1 << 16).reshape(256, 256))
        self.bits, self.asked = bits, Asked.of(buffer, places, bits)
        self.counts = self.asked.counts(np.ones(len(places), bool))
        found = np.zeros((len(cm.ORDERS), 1 << cm.TABLE_BITS, 2), np.uint32)
        cm.add_to_tables(found, self.code, buffer, places, np.ones(len(places), bool))
        self.tables = cm._stretched(found[..., 0], found[..., 1])

    def log2(self, data, offsets):
        buffer, places, first = laid_out(data, offsets)
        asked = Asked.of(buffer, places, self.bits)
        keys = np.union1d(asked.keys, self.asked.keys)
        counts = np.zeros(len(keys), np.int64)
        counts[np.searchsorted(keys, self.asked.keys)] = self.counts
        starts, values = said(self.code, keys, counts)
        return Mixer(self.code, self.tables).log2(pairs_at(buffer, places), first, tails(buffer, places), asked.entries, starts[np.searchsorted(keys, asked.keys)], values)


trained = Trained


def twin_places(text):
    """(contexts of each input, byte before, byte) at each place of a text, from its bytes alone."""
    b = bytes(8) + (text or "").encode() + b"\xff"
    blank = lambda i: b[i] in b"\0 \t\n\x0b\x0c\r"
    start = before = last = 8
    for i in range(8, len(b)):
        if i == 8 or blank(i - 1):
            start, last = i, i - 1
            before = last
            while before > 0 and not blank(before - 1):
                before -= 1
        word = b[start:i]
        yield [*((n, b[i - n : i]) for n in (2, 3, 4, 5)), ("word", word), ("after", b[before:last], word)], b[i - 1], b[i]


def twin_log2(code, texts, text):
    """One decision after another; counts are looked up by the contexts themselves."""
    path = lambda before, byte: [(int(code.nodes[s]), int(code.bits[s])) for k in [before << 8 | byte] for s in range(code.first[k], code.first[k] + code.lengths[k])]
    counts = Counter()
    for t in texts:
        for contexts, before, byte in twin_places(t):
            counts.update((c, before, node, bit) for c in contexts for node, bit in path(before, byte))
    stretch = lambda c, before, node: max(-127, min(127, round(16 * math.log((counts[c, before, node, 1] + 0.15) / (counts[c, before, node, 0] + 0.15))))) / 16
    decided = [([stretch(c, before, node) for c in contexts], bit) for contexts, before, byte in twin_places(text) for node, bit in path(before, byte)]
    weights = [list(w) for w in cm.START]
    curve = [1 / (1 + math.exp(-(k / 2 - 8))) for k in range(33)]
    total, at = 0.0, 0
    while at < len(decided):
        block = 16 if at < 256 else 64 if at < 4096 else 256
        changes = []
        for x, bit in decided[at : at + block]:
            gate = 3 if abs(x[5]) > 40 / 16 else 2 if x[5] else int(x[4] != 0)
            z = max(-7.99, min(7.99, sum(a * b for a, b in zip(x, weights[gate], strict=True))))
            p, k = 1 / (1 + math.exp(-z)), round((z + 8) * 2)
            total += math.log2(abs(1 - bit - (p + curve[k]) / 2))
            changes.append((gate, [cm.RATE * 16 * (bit - p) * a for a in x], k, cm.REFINE_RATE * (bit - curve[k])))
        for gate, step, k, move in changes:
            weights[gate] = [w + s for w, s in zip(weights[gate], step, strict=True)]
            curve[k] += move
        curve = [max(1e-4, min(1 - 1e-4, c)) for c in curve]
        at += block
    return total


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgé", k=rng.randint(1, 8))) for _ in range(200)]
    return [" ".join(rng.choices(words, k=rng.choice([0, 1, 5, 80]))) for _ in range(n)] + [None, "", "Abc  x\n", " ".join(rng.choices(words, k=9000))]


def test_scores_are_probabilities():
    mixer = trained(corpus())
    ends = [""] + [chr(c) for c in range(128)] + [chr(c) + chr(d) for c in range(97, 105) for d in range(128)]
    p = np.exp2(mixer.log2(*text_bytes(pa.array(ends))))
    assert p[0] + p[1:129].sum() < 1 and p[0] > 0
    for i in range(8):
        assert p[129 + 128 * i : 257 + 128 * i].sum() < 1 - p[0]


def test_scores_do_not_depend_on_neighbours():
    texts = corpus(40, seed=2)
    mixer = trained(corpus())
    together = mixer.log2(*text_bytes(pa.array(texts)))
    alone = np.concatenate([mixer.log2(*text_bytes(pa.array([t], pa.string()))) for t in texts])
    assert np.allclose(together, alone, rtol=1e-4, atol=0.05)


def test_learnt_texts_cost_less_than_noise():
    mixer = trained(corpus())
    known, noise = corpus(1, seed=1)[-1], "".join(random.Random(9).choices("abcdefgé ", k=3000))
    bits = [-mixer.log2(*text_bytes(pa.array([t])))[0] / len(t.encode()) for t in (known, noise)]
    assert bits[0] < 2.2 < 2.8 < bits[1]


def test_base_score_against_brute_force(spark, tmp_path):
    rows = [(i if i % 7 else None, t, "x") for i, t in enumerate(corpus(120, seed=3))]
    held = {i: i % 5 == 1 for i, _, _ in rows if i is not None} | {None: False}
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    counts = Counter(w for i, t, _ in rows if not held[i] for w in split(t))
    total, distinct = sum(counts.values()), len(counts)
    expected = sorted((str(i), held[i], len(split(t)), sum(counts[w] > 0 for w in split(t)), total, round(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in split(t)), 6)) for i, t, _ in rows)
    for frequent in (5, 1 << 18):
        got = score_texts(frame, F.col("doc_id") % 5 == 1, frequent=frequent).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected
    assert all(r.score < 0 and r.bits_per_byte > 0 for r in got)


def test_nothing_to_learn_from(spark):
    frame = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = score_texts(frame, F.lit(True)).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert score_texts(frame.limit(0), F.lit(False)).count() == 0


def test_against_one_decision_after_another(monkeypatch):
    monkeypatch.setattr(cm, "TABLE_BITS", 25)  # so many slots that hardly two contexts share one
    rng = random.Random(6)
    texts = corpus(25, seed=6)[:26] + ["a b a b\tc", "éa éb"]
    model = trained(texts)
    for text in [texts[3], texts[7], "", "abc  abc\n\nd", "unseen ~~~ words 12", " ".join(rng.choices("ab abc é d".split(), k=4000))]:  # the last has over 2**14 decisions
        expected = twin_log2(model.code, texts, text)
        got = model.log2(*text_bytes(pa.array([text])))[0]
        assert abs(got - expected) < 2e-3 * abs(expected) + 1e-3, (text[:30], got, expected)


def test_tables_give_what_one_process_gives(spark, monkeypatch):
    """Slices and shards of a few hundred bytes, some texts not learnt from."""
    monkeypatch.setattr(cm, "SLICE_BYTES", 600)
    monkeypatch.setattr(cm, "PART_BYTES", 200)
    monkeypatch.setattr(cm, "SHARD_BYTES", 1 << 10)
    monkeypatch.setattr(cm, "SPARE_BITS", 20)  # the gaps of so small a corpus leave room for more bits
    texts = corpus(60, seed=8)
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in score_texts(frame, F.col("doc_id") % 5 == 1).collect()}
    expected = trained([t for i, t in enumerate(texts) if i % 5 != 1]).log2(*text_bytes(pa.array(texts, pa.string()))) * math.log10(2)
    assert len(got) == len(texts) and np.allclose([got[i] for i in range(len(texts))], expected, rtol=1e-4, atol=1e-3)


def test_a_shard_needs_memory_for_its_keys_only():
    """Several slices ask for a million keys together; what is worked out from them by decision may not lie there all at once."""
    rng = np.random.default_rng(3)
    code = Code.of(rng.integers(0, 50, (256, 256)))
    asked, counts = [], []
    for _ in range(4):
        keys = np.unique(rng.integers(0, 1 << 16, 250_000) << 24 | rng.integers(97, 123, 250_000) << 8 | rng.integers(97, 123, 250_000)).astype(np.uint64)
        asked.append(keys)
        counts.append(rng.integers(0, 3, len(keys)))
    blobs = [cm._packed(k >> np.uint64(16), k & np.uint64(0xFFFF), c) for k, c in zip(asked, counts, strict=True)]
    group = pa.table({"shard": pa.array([0] * 4, pa.int64()), "slice": pa.array(range(4), pa.int64()), "entries": pa.array(blobs, pa.binary())})
    tracemalloc.start()
    got = cm._told(code)(group)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    every = np.unique(np.concatenate(asked))
    total = sum(np.bincount(np.searchsorted(every, k), c, len(every)) for k, c in zip(asked, counts, strict=True))
    starts, values = said(code, every, total)
    for k, blob in zip(asked, got.column("said"), strict=True):
        own = np.searchsorted(every, k)
        expected = np.concatenate([values[a:b] for a, b in zip(starts[own].tolist(), starts[own + 1].tolist(), strict=True)])
        told = np.frombuffer(cm._spread(blob.as_py()), np.int8)  # for the bits that the bytes take
        assert np.array_equal(cm.turned(code, (k & np.uint64(0xFFFF)).astype(np.int32), told), expected)
    assert peak < 100 * sum(map(len, asked)), peak
