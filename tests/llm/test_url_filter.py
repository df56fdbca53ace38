import random
from datetime import datetime, timezone

from pyspark.sql import functions as F

from colloquy.llm.url_filter import filter_urls

CAPTURES = "page_id long, url string, t long, list string"
ENTRIES = "list string, value string, action string, t long"


def framed(spark, captures, entries):
    moment = lambda df, name: df.withColumn(name, F.timestamp_seconds("t")).drop("t")
    return moment(spark.createDataFrame(captures, CAPTURES), "fetched"), moment(spark.createDataFrame(entries, ENTRIES), "effective")


def active(entries, at, values):
    found = set()
    for name, value in {(e[0], e[1].lower()) for e in entries if None not in e}:
        past = [(t, a != "add") for n, v, a, t in entries if None not in (n, v, a, t) and (n, v.lower()) == (name, value) and a in ("add", "remove") and t <= at]
        if past and value in values and not min(x for x in past if x[0] == max(p[0] for p in past))[1]:
            found.add((name, value))
    return found


def test_against_brute_force(spark):
    rng = random.Random(4)
    hosts = ["a.com", "b.a.com", "c.b.a.com", "d.org", "x.net"]
    day = 86400
    start = int(datetime(2024, 1, 1, tzinfo=timezone.utc).timestamp())
    entries = [(rng.choice(["spam", "adult"]), rng.choice(["A.com", "b.a.com", "d.org", "d.org/p", "x.net/p/q"]), rng.choice(["add", "remove", "other"]), start + rng.randint(0, 300) * day) for _ in range(60)]
    entries += [(None, "a.com", "add", start), ("spam", None, "add", start), ("spam", "a.com", "add", None)]
    captures = [(i, f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/p', '/p/q?z', '/P'])}", start + rng.randint(0, 330) * day, "z") for i in range(200)]
    captures += [(300, None, start, "z"), (301, "nonsense", start, "z"), (302, "http://a.com", None, "z")]
    frames = framed(spark, captures, entries)
    for r in filter_urls(*frames).collect():
        _, url, at, _ = next(c for c in captures if c[0] == r.page_id)
        values = set()
        if url and "://" in url:
            host, _, path = url.split("://")[1].partition("/")
            labels = host.split(".")
            values = {".".join(labels[i:]) for i in range(len(labels))}
            parts = [p for p in path.split("?")[0].split("/") if p]
            values |= {"/".join([host, *parts[: i + 1]]) for i in range(len(parts))}
        expected = active(entries, at, values) if at is not None else set()
        assert (r.blocked, r.n_active, r.lists) == (bool(expected), len(expected), sorted({n for n, _ in expected})), r


def test_empty_tables(spark):
    captures, entries = framed(spark, [(1, "http://a.com", 5, None)], [("spam", "a.com", "add", 1)])
    assert filter_urls(captures.limit(0), entries).count() == 0
    assert [r.blocked for r in filter_urls(captures, entries.limit(0)).collect()] == [False]


def test_repeated_captures_and_long_urls(spark):
    long = "http://x.net/" + "/".join("p" * 40 for _ in range(2000))
    rows = [(1, "http://a.com", 5, None), (1, "http://a.com", 5, None), (1, "http://b.org", 5, None), (2, long, 5, "kept"), (3, "http://" + "s." * 500 + "a.com/", 5, None)]
    captures, entries = framed(spark, rows, [("spam", "a.com", "add", 1), ("adult", "x.net", "add", 2), ("spam", "a.com", "add", 1)])
    got = sorted((r.page_id, r.blocked, r.n_active) for r in filter_urls(captures, entries).collect())
    assert got == [(1, True, 1), (2, True, 1), (3, True, 1)]  # captures that share an id are one row
