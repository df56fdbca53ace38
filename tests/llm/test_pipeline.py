import random

import pytest
from test_decontamination import found_in
from test_line_dedup import brute_force as line_twin
from test_near_dup import brute_force as near_twin

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 6)))
    line = lambda: " ".join(word() for _ in range(rng.randint(4, 9)))
    common, item = [line() for _ in range(3)], " ".join(word() for _ in range(14))
    docs = []
    for i in range(60):
        lines = [line() for _ in range(rng.randint(3, 8))]
        if i % 4 == 0:
            lines.insert(1, rng.choice(common))
        if i % 9 == 0:
            lines.append(item.upper())
        if i % 5 == 0:
            lines[0] += " nasty nasty"
        docs.append("\n".join(lines))
    docs += [docs[7], docs[8] + " extra", None, ""]
    folder = tmp_path_factory.mktemp("pipeline")
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(docs)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int("nasty" in (t or ""))) for i, t in enumerate(docs)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = {r.doc_id: r.text for r in docs.collect()}
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, docs, sf_dir)
        if name == "packing":
            pieces = out.collect()
            assert {p.doc_id for p in pieces} == set(held)
            assert all(sum(p.length for p in pieces if p.doc_id == d) == next(p.doc_tokens for p in pieces if p.doc_id == d) for d in held)
            continue
        assert out.columns == docs.columns
        rows = out.collect()
        got = {r.doc_id: r.text for r in rows}
        if name == "toxicity":
            expected = {d: t for d, t in held.items() if "nasty" not in (t or "")}
        elif name == "line_dedup":
            expected = {d: t for d, t, _, _ in line_twin(list(held.items()), 20, 3)}
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
        elif name == "near_dedup":
            classes = near_twin(list(held.items()))
            expected = {d: t for d, t in held.items() if classes[d] == d}
        else:
            expected = {d: t for d, t in held.items() if found_in(item, t) is None}
        assert got == expected and len(rows) == len(got), name
        assert name == "line_dedup" or len(got) < len(held), name
        docs, held = spark.createDataFrame([tuple(r) for r in rows], docs.schema), got
    run = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, pieces))


def test_empty_tables(spark, sf_dir, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
