import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colloquy.llm import quality
from colloquy.llm.queries import op13_quality_rules
from colloquy.llm.quality import FEATURES, Model, features, judge, train
from colloquy.llm.sampling import fold


def counts_of(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    repeated = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(line in lines[:i] for i, line in enumerate(lines)), len(repeated))


def test_counts_against_regular_expressions():
    rng = random.Random(4)
    texts = [None, "", "\n\n", "a", "é b c\x1cd", " x\nx \n x\nx\n", "a b c d e a b c d e", "a " * 9, "#*$%&|<>", "one line\n\none line\n \none line"]
    texts += ["".join(rng.choice(["a", "b", "ab", "é", "#", "|x", "天"]) + rng.choice([" ", " ", "\n", "\t\n", "  "]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    got = features(pa.array(texts, pa.string()))
    assert [tuple(int(x) for x in row) for row in got.T] == [counts_of(t) for t in texts]
    assert features(pa.array([], pa.string())).shape == (5, 0)


def test_a_long_text_is_counted_whole():
    text = " ".join(f"w{i}" for i in range(60_000)) + "\n" + " ".join(f"w{i}" for i in range(100))
    assert tuple(features(pa.array([text])).T[0]) == (60_100, sum(len(w) for w in text.split()), 0, 0, 200)


def corpus(spark, n=600, seed=3):
    rng = random.Random(seed)
    good, bad = [f"{a}{b}" for a in "bcdfg" for b in "aeiou"], ["!!", "$$$", "|"]
    rows, labels = [], []
    for d in range(n):
        junk = d % 5 == 0
        words = [rng.choice(good) + (rng.choice(bad) if junk and rng.random() < 0.7 else "") for _ in range(rng.randint(12, 60))]
        rows.append((d, " ".join(words)))
        if d % 3:
            labels.append((d, 0 if junk else 1))
    rows += [(None, rows[1][1]), (1, rows[1][1]), (2, None), (n, ""), (n + 1, "ba be bi"), (n + 2, "ba be bi bo bu ca ce ci " * 4)]
    labels += [(None, 1), (1, None), (4, 1), (4, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("mine")).withColumn("label", F.lit(7))
    return docs, spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_documents_are_told_apart(spark):
    docs, labels = corpus(spark)
    model = train(docs, labels, fold(F.col("doc_id"), 3) == 1)
    got = judge(docs, model)
    assert got.columns == ["doc_id", "text", "label", *FEATURES, "score", "base_failed", "kept"]
    rows = got.collect()
    assert len(rows) == docs.count()
    unseen = [r for r in rows if r.doc_id is not None and r.doc_id < 600 and r.doc_id % 3 == 0 and r.text]
    assert len(unseen) > 150 and all(r.kept == (r.doc_id % 5 != 0) for r in unseen)
    by = {r.doc_id: r for r in rows}
    assert by[600].base_failed and by[601].base_failed and not by[601].kept and by[602].base_failed and by[602].n_repeat_words == 32
    same = [r for r in rows if r.text == by[1].text]
    assert len(same) == 3 and len({(r.score, r.kept) for r in same}) == 1


def test_the_counts_are_those_of_two_multinomials(spark):
    docs, labels = corpus(spark, 60)
    held_out = fold(F.col("doc_id"), 3) == 1
    model = train(docs, labels, held_out)
    trusted = {r.doc_id for r in labels.filter(~held_out).groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1 AND doc_id IS NOT NULL").collect()}
    raw, own = np.zeros(1 << quality.BUCKET_BITS), np.zeros(1 << quality.BUCKET_BITS)
    for r in docs.collect():
        text = (r.text or "").encode()
        _, buckets = quality.hashed_ngrams(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        np.add.at(raw, buckets, 1)
        np.add.at(own, buckets, r.doc_id in trusted)
    expected = np.log(own + quality.PRIOR) - np.log(raw * own.sum() / raw.sum() + quality.PRIOR)
    assert np.allclose(model.ratios, expected)
    text = docs.filter("doc_id = 7").first().text
    _, buckets = quality.hashed_ngrams(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
    tokens = re.findall(r"[a-z]+|[!$|]+", text)
    assert len(buckets) == 2 * len(tokens) - 1
    assert judge(docs.filter("doc_id = 7"), model).first().score == pytest.approx(expected[buckets].sum() / (len(buckets) + quality.NEUTRAL))


def test_every_trusted_document_counts_and_no_text_is_shuffled(spark):
    n = 21_000  # more labels than were used of old
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("aa bb cc dd ee ff gg hh ii jj w"), F.col("id")).alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    model = train(docs, labels, F.lit(False))
    assert np.allclose(model.ratios, 0)  # all are trusted, so that both multinomials are one


def test_without_labels_every_text_passes(spark):
    docs, labels = corpus(spark, 40)
    for some in (labels.limit(0), labels.filter("quality = 0"), labels.filter("quality = 1")):
        model = train(docs, some, fold(F.col("doc_id"), 3) == 1)
        assert all(r.kept != r.base_failed for r in judge(docs, model).collect())
    model = train(docs.limit(0), labels, fold(F.col("doc_id"), 3) == 1)
    assert judge(docs.limit(0), model).count() == 0 and model.threshold == -np.inf


def test_threshold_in_the_middle_of_the_gap():
    cut = quality._threshold(np.array([-20, -10, 5, 6]), np.array([0, 0, 4, 9]), np.array([3, 5, 0, 0]))
    assert cut == pytest.approx(-2 * quality.BIN)
    assert quality._threshold(np.array([3]), np.array([1]), np.array([0])) == -np.inf


def test_query(spark):
    rows = op13_quality_rules(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        words, chars, symbols, lines, repeated = counts_of(docs[r.doc_id]) if len(docs[r.doc_id] or "") < 6000 else (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (words, chars, symbols, lines, repeated)
        assert r.base_failed == (words < 10 or 100 * repeated > 20 * words) and not (r.base_failed and r.kept)


def test_scores_do_not_depend_on_the_batch():
    rng = np.random.default_rng(1)
    model = Model(rng.normal(size=1 << quality.BUCKET_BITS))
    texts = ["one two, three", "a|b " * 50, "", "é!! x"]
    whole = model.scores(pa.array(texts))
    assert all(model.scores(pa.array([t]))[0] == s for t, s in zip(texts, whole, strict=True)) and whole[2] == 0
