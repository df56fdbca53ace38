import random
import re

import pytest

from colloquy.llm import passages
from colloquy.llm.passages import dedup_passages


def brute_force(docs, window=13):
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    owner = {}
    for d, words in split:
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if d is not None:
                owner[key] = min(d, owner.get(key, d))
    out = []
    for (d, text), (_, words) in zip(docs, split, strict=True):
        gone = set()
        for i in range(len(words) - window + 1):
            if d is not None and owner[tuple(words[i : i + window])] < d:
                gone.update(range(i, i + window))
        out.append((d, None if text is None else " ".join(w for i, w in enumerate(words) if i not in gone), len(words), len(gone)))
    return out


def corpus(n=120, seed=2):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") * rng.randint(1, 2) + rng.choice(["", "é", "x"])
    text = lambda k: [word() for _ in range(k)]
    shared = [text(rng.choice([11, 12, 13, 14, 19, 40])) for _ in range(15)]
    docs = []
    for d in range(n):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += rng.choice(shared) if rng.random() < 0.6 else text(rng.randint(0, 30))
        docs.append((d * 7 % n, "".join(w + rng.choice([" ", "\n", "  ", "\t"]) for w in words)))
    docs += [(500, docs[3][1]), (501, docs[3][1]), (502, None), (503, ""), (504, " ".join(["a"] * 60)), (505, " ".join(["a"] * 40)), (None, docs[3][1]), (7, docs[5][1]), (506, "x" * 30000)]
    return docs


@pytest.mark.parametrize("shard_bytes", [8 << 20, 500])
def test_against_brute_force(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(passages, "SHARD_BYTES", shard_bytes)
    docs = corpus()
    frame = spark.createDataFrame([(d, t, "z", 1) for d, t in docs], "doc_id long, text string, start string, n_words int")
    result = dedup_passages(frame)
    assert result.columns == ["doc_id", "text", "start", "n_words", "n_removed"]
    got = [(r.doc_id, r.text, r.n_words, r.n_removed) for r in result.collect()]
    expected = brute_force(docs)
    assert sorted(got, key=str) == sorted(expected, key=str) and sum(r[3] for r in expected) > 500


def test_empty_table_and_bad_block(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert dedup_passages(frame).count() == 0
    with pytest.raises(ValueError):
        dedup_passages(frame, block=8)


def test_each_directory_is_a_group_of_its_own(spark):
    docs = spark.createDataFrame([(i, f"{i} " * 20) for i in range(64)], "doc_id long, text string").repartition(8)
    rows = docs.mapInArrow(passages._probes(2, 13, 7), passages.PROBES).filter("shard < 0").groupBy("shard").count().collect()
    assert len(rows) == 8 and all(r["count"] == 1 for r in rows)


def test_a_common_window_is_one_entry_of_a_slice(spark):
    texts = ["a " * 3000] + [" ".join(f"w{k}" for k in range(40))] * 50
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = docs.mapInArrow(passages._probes(2, 13, 7), passages.PROBES).filter("shard >= 0").collect()
    assert sum(len(r["hashes"]) // 4 for r in rows) == 1 + 34
    got = [(r.doc_id, r.n_removed) for r in dedup_passages(docs).collect()]
    assert sorted(got) == [(0, 0), (1, 0)] + [(d, 40) for d in range(2, 51)]


def test_a_very_long_text(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(3000)}" for _ in range(60_000)]
    part = words[20_000:20_060]
    docs = [(1, " ".join(words)), (2, " ".join(["own"] * 5 + part + ["more"] * 20)), (3, " ".join(f"u{i}" for i in range(40_000)) + " " + " ".join(words[59_000:]))]
    got = [(r.doc_id, r.text, r.n_words, r.n_removed) for r in dedup_passages(spark.createDataFrame(docs, "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == brute_force(docs) and [r[3] for r in got] == [0, 60, 1000]
