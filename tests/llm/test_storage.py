import os

from colloquy.llm.storage import scratch, stage


def files(staged):
    return os.path.isdir(staged.path.removeprefix("file://"))


def test_scratch_tables_go_unless_kept(spark):
    before = stage(spark.range(3), "before")
    with scratch() as keep:
        inner, kept, gone = stage(spark.range(4), "inner"), keep(stage(spark.range(5), "kept")), stage(spark.range(6), "gone")
        gone.drop()
        assert files(inner) and not files(gone)
    assert files(before) and files(kept) and not files(inner)
    assert kept.df.count() == 5 and before.df.count() == 3
    for s in (before, kept):
        s.drop()
        s.drop()  # no error
        assert not files(s)


def test_inner_names_may_clash(spark):
    """Columns with names that the operators use inside."""
    from colloquy.llm import line_dedup, near_dup, passages, toxicity

    text = "the same long line is here in all of them and it goes on for a while now"
    names = ["__id", "__drop", "__gone", "__repeats", "__copies", "__label", "__Id", "__ID_", "key", "doc", "rep"]
    names = [n for i, n in enumerate(names) if n.lower() not in {m.lower() for m in names[:i]}]
    rows = [(d, text if d < 4 else f"own text number {d} " * 3, *([7] * len(names))) for d in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    for made in (line_dedup.dedup_lines(docs), passages.dedup_passages(docs), near_dup.drop_near_duplicates(docs), toxicity.score(docs, toxicity.train(docs, docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS toxic")))):
        found = made.collect()
        assert set(names) <= set(made.columns) and all(r[n] == 7 for r in found for n in names) and len(found) == (5 if made.columns == docs.columns else 8)


def test_free_names():
    from types import SimpleNamespace as Frame

    from colloquy.llm.storage import free_name

    assert free_name("__id", Frame(columns=["a"])) == "__id" and free_name("__id", Frame(columns=["__ID", "x"]), Frame(columns=["__id_"])) == "__id__"
