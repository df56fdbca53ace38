import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colloquy.llm import langid, toxicity
from colloquy.llm.queries import op4_language_id, op10_toxicity

SF = "/root/testdata/sf0.01"


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = op4_language_id(spark, SF).join(docs, "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) > 0.95 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_toxicity_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = op10_toxicity(spark, SF).join(labels, "doc_id").filter("held_out").collect()
    toxic, clean = ([r.predicted for r in rows if r.toxic == k] for k in (1, 0))
    assert sum(toxic) > 0.6 * len(toxic) and sum(clean) < 0.05 * len(clean)


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, "the cat and the hat " * (1 + i % 3), "en", i) for i in range(40)] + [(100 + i, "le chat et les chapeaux " * (1 + i % 3), "fr", i) for i in range(40)]
    return spark.createDataFrame([*rows, (300, None, "en", 0), (301, "12 34", None, 0)], "doc_id long, text string, lang string, score int")


def test_unusual_texts_of_languages(spark, labelled):
    model = langid.train(labelled)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 ..."), (4, "the hat"), (5, "les chapeaux"), (6, "the " * 50_000), (None, "le chat")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict(odd.withColumn("rejected", F.lit(1)), model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5, 6, None)] == ["und", "und", "und", "en", "fr", "en", "fr"]
    assert all(got[i].rejected and got[i].score == 0 for i in (1, 2, 3))
    assert langid.predict(odd.limit(0), model).count() == 0
    for none in (labelled.limit(0), labelled.withColumn("lang", F.lit(None).cast("string"))):
        rows = langid.predict(odd, langid.train(none)).collect()
        assert len(rows) == 7 and {(r.lang_pred, r.score, r.rejected) for r in rows} == {("und", 0.0, True)}


def test_pairs_of_terms_count(spark):
    """Neither word alone is toxic, both together are."""
    words = [("apple", "pear", 0), ("apple", "plum", 0), ("stone", "pear", 0), ("stone", "plum", 1)]
    rows = [(i, f"{a} word{i % 17} {b}", t) for i in range(800) for a, b, t in [words[i % 4]]]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(9999, None), (None, "stone plum")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 5] + [(5000, 1), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs.withColumn("score", F.lit("x")), model).collect()}
    held = [r for r in rows if r[0] % 5 == 0]
    assert sum((got[i].score >= 0.5) == bool(t) for i, _, t in held) > 0.97 * len(held)
    assert got[9999].predicted == 0 and all(0 <= r.score <= 1 for r in got.values())
    one_class = toxicity.train(docs, labels.filter("toxic = 1"))
    assert toxicity.score(docs, one_class).count() == docs.count()
    assert toxicity.score(docs, toxicity.train(docs, labels.limit(0))).filter("predicted = 1").count() == 0


@pytest.mark.parametrize("texts", [["ab"], ["é"], ["a", "b"], [None, "ab", ""], ["x" * (1 << 20), "ab"]])
def test_a_slice_of_two_bytes_has_subwords(texts):
    grams = [found for _, _, found in langid.subwords(pa.array(texts, pa.string()))]
    assert [len(g) for g in grams[-1]] == [2] * len(langid.SIZES)
    assert (grams[-1][0] >= 0).sum() == (max(len((t or "").encode()) for t in texts) >= 2) and all((g == -1).all() for g in grams[-1][1:])


def sample_of(rows):
    """rows: (set of buckets, label)."""
    sizes = np.cumsum([0] + [len(t) for t, _ in rows])
    return toxicity.Sample(np.array([float(y) for _, y in rows]), sizes, np.array([b for t, _ in rows for b in sorted(t)], np.int32))


def test_a_task_learns_and_not_the_driver(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "fine words here" if k % 2 else "vile words here") for k in range(200)], "doc_id long, text string")
    labels = docs.select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("toxic"))
    monkeypatch.setattr(toxicity, "Sample", None)  # in the driver only
    model = toxicity.train(docs, labels)
    assert {r.predicted for r in toxicity.score(docs.filter("doc_id % 2 = 0"), model).collect()} == {1}
    assert {r.predicted for r in toxicity.score(docs.filter("doc_id % 2 = 1"), model).collect()} == {0}


@pytest.mark.parametrize("label", [lambda a, b: a != b, lambda a, b: a == b])
def test_terms_that_tell_nothing_alone(label):
    """Exactly one of two terms, or both or none: neither term is associated with the label by itself."""
    rng = random.Random(3)
    rows = []
    for _ in range(8000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(({10 * a, 20 * b, *(rng.randrange(100, 400) for _ in range(12))}, label(a, b)))
    model = toxicity.fit(sample_of(rows[:6000]))
    z = [model.logits(1, np.zeros(len(f), int), f)[0] for f in ([i for i in (model.index[b] for b in t) if i >= 0] for t, _ in rows[6000:])]
    assert np.mean([(x > 0) == y for x, (_, y) in zip(z, rows[6000:], strict=True)]) > 0.95


def test_logits_are_sums_over_pairs():
    rng = np.random.default_rng(4)
    model = toxicity.Model(np.arange(50), -0.3, rng.normal(size=50), rng.normal(size=(50, 8)))
    docs = [rng.choice(50, n, replace=False) for n in (0, 1, 2, 7, 50)]
    rows = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    expected = [-0.3 + sum(model.weights[i] for i in d) + sum(sum(model.factors[i][f] * model.factors[j][f] for f in range(8)) for i, j in itertools.combinations(d, 2)) for d in docs]
    assert np.allclose(model.logits(len(docs), rows, np.concatenate(docs)), expected)


def test_scores_of_whole_long_texts_repeated_rows_and_empty_tables(spark):
    rows = [(i, f"word{i % 13} " + ("awful people" if i % 4 == 0 else "awful weather"), int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    long = "calm " * 600_000
    odd = spark.createDataFrame([(1, long + "awful people"), (1, long), (2, "awful people"), (2, "awful people"), (None, "awful people")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.predicted, r.score) for r in toxicity.score(odd, model).collect()))
    assert [(d, p) for d, p, _ in got] == [(0, 1), (1, 0), (1, 1), (2, 1), (2, 1)] and got[0][2] == got[3][2] == got[4][2]
    assert toxicity.score(odd.limit(0), model).count() == 0
    untaught = toxicity.train(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.predicted for r in toxicity.score(odd, untaught).collect()} == {0}


def naive_probabilities(model, text):
    """Softmax of the mean of the rows of all byte n-grams, one by one."""
    folded = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in text.lower().encode())
    rows = []
    for n in (2, 3, 4):
        for i in range(len(folded) - n + 1):
            gram = int.from_bytes(folded[i : i + n], "little")
            rows.append(model.table[((gram * 2654435761 + n * 40503) % 2**32) >> (32 - langid.BUCKET_BITS)])
    z = (np.mean(np.array(rows, float), axis=0) if rows else 0) + model.bias
    e = np.exp((z - z.max()) / model.temperature)
    return e / e.sum()


def test_probabilities_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.train(docs.filter("doc_id % 3 <> 1"), sample=300)
    texts = [r.text for r in docs.orderBy("doc_id").limit(60).collect()] + ["", "a", "ab", "Ünï  12", "x" * 3000]
    expected = np.array([naive_probabilities(model, t) for t in texts])
    assert np.allclose(model.probabilities(pa.array(texts)), expected, atol=1e-5)
    rows = langid.predict(spark.createDataFrame([(i % 9, t) for i, t in enumerate(texts)] * 2, "doc_id long, text string"), model).collect()
    assert len(rows) == 2 * len(texts)  # repeated ids and rows stay
    by_text = {t: p for t, p in zip(texts, expected, strict=True)}
    for r in rows:
        if any(c.isalpha() for c in r.text):
            assert abs(r.score - by_text[r.text].max()) < 1e-4 and (r.lang_pred == model.languages[by_text[r.text].argmax()] or np.ptp(np.sort(by_text[r.text])[-2:]) < 1e-4)
        else:
            assert (r.lang_pred, r.score) == ("und", 0.0)


def test_repeated_rows_of_languages(spark, labelled):
    """A repeated row teaches again and is predicted alike."""
    twice = labelled.unionByName(labelled)
    rows = langid.predict(twice, langid.train(twice)).collect()
    by_text = {}
    for r in rows:
        by_text.setdefault(r.text, set()).add((r.lang_pred, r.score, r.rejected))
    assert len(rows) == 2 * labelled.count() and all(len(v) == 1 for v in by_text.values())
    assert {v for k, own in by_text.items() if k and k.startswith("le ") for v, _, _ in own} == {"fr"}
