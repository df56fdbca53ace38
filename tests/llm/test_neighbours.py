import numpy as np
from pyspark.sql import functions as F

from colloquy.llm import neighbours
from colloquy.llm.neighbours import MultiIndex, _laid_out, nearest


def brute_force(rows, k=5):
    good = [(i, np.array(v, float) / np.abs(v).max()) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in good:
        if i % 50 == 0:
            scored = [(-float((v * w).sum() / (np.sqrt((v * v).sum()) * np.sqrt((w * w).sum()))), j) for j, w in good if j != i]
            out[i] = sorted(scored)[:k]
    return out


def rows(n=2000, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 8))
    made = [(i, (centres[i % 12] + 0.4 * rng.normal(size=8)).tolist()) for i in range(n)]
    made += [(n + i, made[0][1]) for i in range(300)]
    made += [(9000, None), (9050, [0.0] * 8), (9100, [float("nan")] + [1.0] * 7), (9150, [None] + [1.0] * 7), (9200, [1.0] * 3), (None, [1.0] * 8), (9250, [2e-200] * 8), (9251, [1e200] * 8)]
    return made


def test_recall_and_order(spark):
    data = rows()
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    expected = brute_force(data)
    found = {}
    for r in nearest(frame, F.col("vec_id") % 50 == 0, centroids=8, block=100, pack=7).orderBy("query_id", "rank").collect():
        assert r.rank == len(found.setdefault(r.query_id, [])) + 1
        found[r.query_id].append((-r.score, r.vec_id))
    assert set(found) == set(expected) and 9250 in found
    assert all(x == sorted(x) and len(x) == 5 for x in found.values())
    inner = [i for i in expected if i < 9000]
    hits = sum(len({j for _, j in found[i]} & {j for _, j in expected[i]}) for i in inner)
    assert hits >= 0.9 * 5 * len(inner)
    assert abs(found[9250][0][0] + 1) < 1e-12 and found[9250][0][1] == 9251
    assert [j for _, j in found[0]] == [2000, 2001, 2002, 2003, 2004]


def test_traversal_is_in_order_of_summed_distance():
    rng = np.random.default_rng(1)
    index = MultiIndex(8, (rng.normal(size=(5, 4)), rng.normal(size=(7, 4))), 1.0)
    units = rng.normal(size=(20, 8))
    sizes = rng.integers(0, 9, 35)
    first, second = index.halves(units)
    for q, seen in enumerate(index.visits(units, sizes, 60)):
        summed = (first[q][:, None] + second[q][None]).ravel()
        order = np.argsort(summed, kind="stable")
        n = int(np.searchsorted(np.cumsum(sizes[order]), 60)) + 1
        assert set(np.flatnonzero(seen)) == set(order[:n].tolist())


def test_rows_that_share_an_id(spark):
    """Each row is a candidate of its own; the rows of a query id are ranked together, and none is its own neighbour."""
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (1, [1.0, 0.1]), (2, [0.1, 1.0])], "vec_id long, embedding array<float>")
    got = [(r.rank, r.vec_id) for r in nearest(frame, F.col("vec_id") == 0, k=3).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 1), (3, 2)]


def test_codebooks_grow_with_the_rows(spark):
    rng = np.random.default_rng(4)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(3000, 4)))], "vec_id long, embedding array<double>")
    few, many = ({(r.query_id, r.vec_id) for r in nearest(frame, F.col("vec_id") % 50 == 0, centroids=c, sample=500).collect()} for c in (32, 60))
    assert len(few & many) > 0.9 * len(few)


def test_queries_are_not_broadcast_and_take_turns(spark, monkeypatch):
    """What a pack becomes is many times as large as the pack, which Spark doesn't know."""
    rng = np.random.default_rng(6)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(1500, 4)))], "vec_id long, embedding array<double>")
    plain = nearest(frame, F.col("vec_id") % 5 == 0, block=100)
    expected = sorted(map(tuple, plain.collect()))
    plan = plain._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "FlatMapCoGroupsInArrow" in plan
    monkeypatch.setattr(neighbours, "TURN", 40)
    assert sorted(map(tuple, nearest(frame, F.col("vec_id") % 5 == 0, block=700, pack=9).collect())) == expected


def test_few_and_no_vectors(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = nearest(frame, F.col("vec_id") == 0).collect()
    assert [(r.rank, r.vec_id) for r in got] == [(1, 1), (2, 2)]
    assert nearest(frame.limit(0), F.col("vec_id") == 0).count() == 0
    assert nearest(spark.createDataFrame([(0, None)], frame.schema), F.col("vec_id") == 0).count() == 0


def test_cells_in_blocks():
    first, parts = _laid_out(np.array([3, 0, 4, 4, 25, 2, 10, 1]), 10)
    assert parts.tolist() == [1, 0, 1, 1, 3, 1, 1, 1]
    assert [first[c] for c in (0, 2, 3, 4, 5, 6, 7)] == [0, 0, 1, 2, 5, 6, 7]
