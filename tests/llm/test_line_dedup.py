import random
from collections import defaultdict

from colloquy.llm.line_dedup import LineRuns, dedup_lines

BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(docs, min_chars, min_docs):
    key = lambda line: line.strip(BLANKS).translate(LOWER)
    holders = defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            if d is not None and len(key(line)) >= min_chars:
                holders[key(line)].add(d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(key(x)) < min_chars or len(holders[key(x)]) < min_docs or max(holders[key(x)]) == d]
        out.append((d, None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def corpus(n=150, seed=1):
    rng = random.Random(seed)
    pool = ["".join(rng.choices("abcdé ", k=rng.choice([3, 4, 5, 9, 30]))) for _ in range(60)]
    vary = lambda x: rng.choice([x, x.upper(), "  " + x + "\r", x + "\t"])
    docs = [(d, "\n".join(vary(rng.choice(pool)) for _ in range(rng.randint(0, 8)))) for d in range(n)]
    return docs + [(900, None), (901, ""), (None, docs[3][1]), (902, "\n\n"), (5, docs[9][1]), (903, "\n".join(pool * 40))]


def test_against_brute_force(spark):
    docs = corpus()
    frame = spark.createDataFrame([(d, t, 1, "k") for d, t in docs], "doc_id long, text string, n_lines int, key string")
    for batches, fanout in ((1, 2), (4, 3), (7, 2)):
        rows = dedup_lines(frame, min_chars=4, batches=batches, fanout=fanout)
        assert rows.columns == ["doc_id", "text", "key", "n_lines", "n_dropped"]
        assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in rows.collect()), key=str) == sorted(brute_force(docs, 4, 3), key=str)


def test_levels_are_compacted(spark):
    runs = LineRuns(spark, fanout=2)
    for i in range(5):
        marks = runs.add(spark.createDataFrame([(bytes([i]), 10 - i), (b"x", 10 - i)], "key binary, doc_id long"))
        assert [(bytes(r.key), r.doc_id) for r in marks.collect()] == ([(b"x", 10 - i)] if i else [])
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert {(bytes(r.key), r.owner, r.n_docs) for r in runs.compacted().collect()} == {(bytes([i]), 10 - i, 1) for i in range(5)} | {(b"x", 10, 5)}


def test_runs_decide_who_owns_a_key(spark):
    """A known key's owner is the one of its first batch, whatever a later batch holds."""
    batch = lambda *rows: spark.createDataFrame([(k.encode(), d) for k, d in rows], "key binary, doc_id long")
    runs = LineRuns(spark, fanout=2)
    assert [r.doc_id for r in runs.add(batch(("a", 9), ("a", 8), ("b", 9))).collect()] == [8]
    assert sorted((bytes(r.key), r.doc_id) for r in runs.add(batch(("a", 7), ("c", 6), ("c", 7))).collect()) == [(b"a", 7), (b"c", 6)]
    assert [r.doc_id for r in runs.add(batch(("b", 99))).collect()] == [99]
    assert {(bytes(r.key), r.owner, r.n_docs) for r in runs.compacted().collect()} == {(b"a", 9, 3), (b"b", 9, 2), (b"c", 7, 2)}


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_very_long_texts(spark):
    long = "\n".join(f"line number {i} of a very long text" for i in range(60_000))
    docs = [(1, long), (2, long), (3, "line number 7 of a very long text\nalone"), (4, "x" * 2_000_000), (5, "x" * 2_000_000 + "\nb"), (6, "X" * 2_000_000)]
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    without = "\n".join(line for line in long.split("\n") if line != docs[2][1].split("\n")[0])
    assert got[1] == (without, 60_000, 1) == got[2] and got[3] == (docs[2][1], 2, 0)
    assert got[4] == ("", 1, 1) and got[5] == ("b", 2, 1) and got[6][1:] == (1, 0)


def test_runs_are_joined_without_a_shuffle(spark):
    runs = LineRuns(spark, fanout=9, files=4)
    frame = spark.createDataFrame([(bytes([i]), i) for i in range(40)], "key binary, doc_id long")
    for _ in range(3):
        runs.add(frame)
    held = [r.df for r in runs.held()]
    joined = held[0].hint("merge").join(held[1], "key").join(held[2].hint("merge"), "key")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan and joined.count() == 40
