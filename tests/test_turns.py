"""The loop, running tools, segmentation, the index, and the stream and sink operators against procedural twins."""

import itertools
import math
import os
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.operators import deltas, finalize, history, loop, retrieval, routing, segmentation
from colloquy.operators.tools import Tool, in_scope, registry, run_tools
from colloquy.sources import search_index, streams
from colloquy.sources.topics import Topics, TopicFiles, Written
from colloquy.streaming import answer_events, hot_context, instances
from colloquy.streaming.compression import Compression

# Segmentation.


def all_paths(run):
    """Every way to cut a run into pieces."""
    for cuts in itertools.product([False, True], repeat=len(run) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(run)]
        yield [run[a:b] for a, b in itertools.pairwise(at)]


def weight(path, words, total):
    return sum(math.log(words[w] / total) if w in words else (-math.log(total) if len(w) == 1 else -math.inf) for w in path)


def test_the_heaviest_of_all_paths():
    rng = random.Random(3)
    letters = "软件工程架构"
    for _ in range(150):
        words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 4))): rng.randint(1, 50) for _ in range(rng.randint(0, 12))}
        total = max(sum(words.values()), 1)
        trie = segmentation.Words(words.items(), total)
        run = "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))
        found = trie.path(run)
        assert "".join(found) == run
        assert weight(found, words, total) == pytest.approx(max(weight(p, words, total) for p in all_paths(run)))


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_search_tokens_of_both_scripts(spark, monkeypatch, limit):
    monkeypatch.setattr(segmentation, "DICTIONARY_BYTES", limit)
    words = [("软件", 30), ("工程", 20), ("软件工程", 25), ("架构", 9), ("今天", 40), ("天天", 2), ("天气", 30), ("很", 50), ("好", 60), (None, 3), ("无", None), ("软件", 1)]
    dictionary = spark.createDataFrame(words, "word string, freq long")
    texts = ["软件工程架构", "今天天气很好", "Use 软件工程, or Python3架构!", "the x Des", "", None, "未知", "今天天气很好今天"]
    rows = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "seq long, content string, terms array<int>")
    found = {r.seq: r.terms for r in segmentation.with_terms(rows, dictionary, "seq").collect()}
    assert found == {
        0: ["软件", "工程", "软件工程", "架构"], 1: ["今天", "天气"], 2: ["use", "软件", "工程", "软件工程", "or", "python3", "架构"], 3: ["the", "des"], 4: [], 5: None, 6: [], 7: ["今天", "天气", "今天"],
    }
    empty = segmentation.with_terms(rows, dictionary.limit(0), "seq")
    assert {r.seq: r.terms for r in empty.collect()}[2] == ["use", "or", "python3"]
    assert segmentation.with_terms(rows.limit(0), dictionary, "seq").count() == 0


@pytest.mark.parametrize("sizes", [(2, 3)])
def test_both_ways_agree_on_random_texts(spark, monkeypatch, sizes):
    rng = random.Random(8)
    han = "天气很好今明软件"
    words = [("".join(rng.choice(han) for _ in range(rng.randint(1, 5))), rng.randint(1, 99)) for _ in range(60)]
    dictionary = spark.createDataFrame(words, "word string, freq long")
    rows = spark.createDataFrame([(i, "".join(rng.choice(han + " a,B") for _ in range(rng.randint(0, 40)))) for i in range(60)], "seq long, content string")
    read = lambda: {r.seq: r.terms for r in segmentation.with_terms(rows, dictionary, "seq").collect()}
    whole = read()
    monkeypatch.setattr(segmentation, "DICTIONARY_BYTES", 0)
    assert read() == whole


def test_a_large_dictionary_is_asked_for_words_only(spark, monkeypatch):
    """Of some 8,000 stretches of characters few go out; texts of many blocks have the tokens of the trie."""
    rng = random.Random(5)
    words = {"".join(chr(0x4E00 + rng.randrange(300)) for _ in range(rng.choice([1, 2, 3, 9]))): rng.randint(1, 50) for _ in range(500)}
    runs = ["".join(rng.choice(list(words) + ["\u4e00\u4e8c\u9fa5"]) for _ in range(20)) for _ in range(30)]
    hashed = segmentation._hashed_words(iter([pa.record_batch({"word": pa.array(list(words)), "freq": pa.array(list(words.values()), pa.float64())})]))
    hashes = next(hashed).column(0).to_numpy().view(np.uint64)
    bits = 17
    stretch = (hashes >> np.uint64(64 - bits) >> np.uint64(16)).view(np.int64)
    marks = b"".join(segmentation._marked(bits)(pa.table({"hash": hashes[stretch == k].view(np.int64), "stretch": stretch[stretch == k]})).column("marks")[0].as_py() for k in range(2))
    held = type("Held", (), {"value": marks})
    asked = list(segmentation._asked(held, bits, [1, 2, 3, 9])(iter([pa.record_batch({"block": pa.array([7] * 30), "pieces": pa.array([[r] for r in runs])})])))
    inside = {h for w, h in zip(words, hashes.view(np.int64).tolist(), strict=True) if any(w in r for r in runs)}
    got = asked[0].column("hash").to_pylist()
    assert len(asked) == 1 and inside <= set(got) and len(got) == len(set(got)) < 1.2 * len(inside)
    rows = spark.createDataFrame([(k, r) for k, r in enumerate(runs)], "seq long, content string").repartition(3)
    dictionary = spark.createDataFrame(list(words.items()), "word string, freq long")
    read = lambda: sorted(map(tuple, segmentation.with_terms(rows, dictionary, "seq").select("seq", "terms").collect()))
    whole = read()
    monkeypatch.setattr(segmentation, "DICTIONARY_BYTES", 0)
    monkeypatch.setattr(segmentation, "BLOCK_BYTES", 500)
    assert read() == whole


def test_a_trie_takes_16_bytes_a_node(monkeypatch):
    rng = random.Random(8)
    words = {"".join(chr(0x4E00 + rng.randrange(300)) for _ in range(rng.randint(1, 5))): rng.randint(1, 9) for _ in range(3000)} | {"\U0002a6d6乙": 4}
    trie = segmentation.Words.of(pa.array(list(words)), np.array(list(words.values()), float))
    prefixes = {w[:k] for w in words for k in range(1, len(w) + 1)}
    assert trie.edges.nbytes + trie.weights.nbytes == 16 * len(prefixes)
    runs = ["".join(rng.choices(list(words), k=9)) for _ in range(9)]
    monkeypatch.setattr(segmentation, "AT_ONCE", 50)
    assert list(trie.tokens(runs)) == [next(trie.tokens([r])) for r in runs] and list(trie.tokens([])) == []
    for run in ("".join(rng.choices(list(words), k=20)), "\U0002a6d6乙", "a", ""):
        letters = np.array([ord(c) for c in run], np.int32)
        every = [(a, b) for a in range(len(run)) for b in range(a + 1, len(run) + 1) if run[a:b] in words]
        assert list(zip(*trie.found(letters)[:2], strict=True)) == every and "".join(trie.path(run)) == run


# The index.


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-(2**53), 2**53), st.integers(0, 2**40))))
def test_places_come_back(places):
    at, seq = (pd.Series([p[k] for p in sorted(places)], dtype="int64").to_numpy() for k in (0, 1))
    again = search_index.decoded_places(search_index.coded_places(at, seq))
    assert [a.tolist() for a in again] == [at.tolist(), seq.tolist()]


def test_blocks_are_coded_and_decoded_together(monkeypatch):
    monkeypatch.setattr(search_index, "BLOCK", 5)
    rng = np.random.default_rng(3)
    keys = np.sort(rng.integers(0, 300, 2000))
    at, seq = rng.integers(-(2**60), 2**60, 2000), rng.integers(0, 2**40, 2000)
    order = np.lexsort((seq, at, keys))
    at, seq = at[order], seq[order]
    columns = [pa.array(keys % 7), pa.array([f"t{k}" for k in keys]), pa.array(["s"] * 2000), pa.array(at), pa.array(seq)]
    blocks = next(search_index._postings(iter([pa.RecordBatch.from_arrays(columns, ["part", "term", "session_id", "at", "seq"])])))
    for row, start in zip(blocks.to_pylist(), np.cumsum(blocks.column(4).to_numpy()) - blocks.column(4).to_numpy(), strict=True):
        own = slice(start, start + row["n"])
        assert row["places"] == search_index.coded_places(at[own], seq[own]) and row["n"] <= 5
        assert (row["term"], row["first_at"], row["last_at"]) == (f"t{keys[start]}", at[own][0], at[own][-1])
    asked = pa.RecordBatch.from_arrays([pa.array(np.arange(len(blocks)).astype(str)), blocks.column(1), pa.array([None] * len(blocks), pa.int64()), pa.array([0] * len(blocks)), blocks.column(4), blocks.column(5)], list("abcdef"))
    found = list(search_index._places(iter([asked, asked.slice(0, 0)])))
    assert len(found) == 1  # not one for each block
    assert found[0].column(2).to_pylist() == seq[at <= 0].tolist() and found[0].column(3).to_pylist() == at[at <= 0].tolist()
    monkeypatch.setattr(search_index, "DECODED", 100)
    assert sum((b.column(2).to_pylist() for b in search_index._places(iter([asked]))), []) == seq[at <= 0].tolist()


class Told:
    """A state, or a handle of timers, that holds one value and notes its calls."""

    def __init__(self, calls, value):
        self.calls, self.value = calls, value

    def __getattr__(self, name):
        return lambda *given: self.calls.append(name) or (self.value if name == "get" else None)


def test_a_session_asks_its_states_for_little(spark):
    at = pd.Timestamp("2024-01-01")
    old = [(k, at, "x") for k in range(2)]
    calls, context = [], hot_context.LiveContext(5, limit=2)
    context.recent, context.stored, context.last, context.handle = Told(calls, old), Told(calls, old), Told(calls, (int(at.value // 1_000_000),)), Told(calls, None)
    rows = next(context.handleInputRows(("s",), iter([pd.DataFrame({"seq": [7], "created_at": [at], "content": ["y"]})]), None))
    assert rows["seq"].tolist() == [0, 1, 7] and sorted(calls) == ["deleteTimer", "get", "get", "get", "put", "registerTimer", "update"]
    calls, events = [], answer_events.AnswerEvents()
    events.flags = Told(calls, (True, False, False))
    fragment = answer_events.Row(seq=3, reasoning_content="r", content=None, last=False)
    assert [(r.seq, r.ord, r.delta) for r in events.handleInputRows((1,), iter([fragment]), None)] == [(3, 1, "r")] and calls == ["get"]


def test_the_index_equals_the_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search_index, "BLOCK", 3)
    rng = random.Random(4)
    words = ["aa", "bb", "cc", "dd", "ee", "é", "天气"]
    rows = [(rng.choice(["s", "t", None]), i, rng.randint(0, 9), [rng.choice(words) for _ in range(rng.randint(0, 4))]) for i in range(300)] + [("s", 900, 3, None), ("s", 901, None, ["aa"]), ("s", 902, 3, [None, "aa", "aa"])]
    messages = spark.createDataFrame(rows, "session_id string, seq long, t long, terms array<string>").withColumn("created_at", F.timestamp_seconds("t"))
    asked = [(1, "s", ["aa"], None, None), (2, None, ["bb", "cc"], None, None), (3, "t", ["aa", "天气"], 2, 5), (4, None, ["aa"], None, 0), (5, "x", ["aa"], None, None), (6, "s", [], None, None), (7, "s", None, None, None), (8, "s", ["zz"], None, None)]
    requests = spark.createDataFrame(asked, "request_id int, session_id string, terms array<string>, a long, b long").withColumn("start", F.timestamp_seconds("a")).withColumn("end", F.timestamp_seconds("b"))
    index = search_index.SearchIndex(spark, str(tmp_path / "index"))
    stored = []
    for batch, part in enumerate(("seq < 100", "seq >= 100 AND seq < 200", "seq >= 200")):
        for _ in range(1 + batch % 2):  # the second append is done twice
            index.append(messages.filter(part), batch)
        stored += [r for r in rows if eval(part.replace("AND", "and"), {"seq": r[1]})]
        expected = sorted(
            (q, s or "", seq) for q, session, terms, a, b in asked for s, seq, t, own in stored
            if t is not None and set(terms or []) & set(own or []) and session in (None, s) and (a is None or t >= a) and (b is None or t <= b)
        )
        assert sorted((r.request_id, r.session_id or "", r.seq) for r in index.search(requests).collect()) == expected
    plan = index.search(requests)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "places" in plan
    index.append(messages.limit(0), 9)
    assert index.search(requests.limit(0)).count() == 0 and index.search(requests).count() == len(expected)


def test_rows_of_one_ask_are_dealt_out(spark, tmp_path, monkeypatch):
    """Where the requests are too many to be broadcast, one ask of all sessions isn't one task's."""
    monkeypatch.setattr(search_index, "TURN", 7)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        messages = spark.range(200).select((F.col("id") % 9).cast("string").alias("session_id"), F.col("id").alias("seq"), F.timestamp_seconds("id").alias("created_at"), F.array(F.lit("aa")).alias("terms"))
        index = search_index.SearchIndex(spark, str(tmp_path / "index"))
        index.append(messages, 0)
        requests = spark.range(20).select(F.col("id").alias("request_id"), F.when(F.col("id") == 3, "4").alias("session_id"), F.array(F.lit("aa")).alias("terms"), *(F.lit(None).cast("timestamp").alias(c) for c in ("start", "end")))
        got = index.search(requests).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((r.request_id, r.seq) for r in got) == sorted((q, k) for q in range(20) for k in range(200) if q != 3 or k % 9 == 4)
    assert len({r.task for r in got if r.request_id == 0}) > 1


# The loop.


def loop_twin(steps, limit):
    """steps: [(step, reason, slots)] of a turn; the steps that run, and whether it ran out."""
    run = []
    for step, reason, slots in steps[:limit]:
        goes_on = reason == "tool_calls" and slots > 0
        run.append((step, goes_on))
        if not goes_on:
            return run, False
    return run, len(run) == limit


@pytest.mark.parametrize("limit", [1, 3, 5])
def test_loop_walked_by_hand(spark, limit):
    rng = random.Random(limit)
    turns, frag, step = {}, [], 0
    for turn in range(60):
        turns[turn] = []
        for number in range(rng.randint(1, 8)):
            step += 1
            reason, slots = rng.choice(["tool_calls", "tool_calls", "tool_calls", "stop", None, ""]), rng.choice([0, 1, 2, 2])
            frag.append((step, step * 100, "r" if rng.random() < 0.3 else None, "t" if rng.random() < 0.5 else "", None, "", "", "", None))
            frag += [(step, step * 100 + 1 + k, None, None, k, f"id{k}", f"f{k}", "{}", None) for k in range(slots)]
            frag.append((step, step * 100 + 50, None, None, None, "", "", "", reason))
            turns[turn].append((step, reason, slots))
    frag = spark.createDataFrame(frag, "step long, seq long, reasoning_content string, content string, slot int, call_id string, call_name string, call_arguments string, finish_reason string")
    order = spark.createDataFrame([(s, t, -len(own) + k) for t, own in turns.items() for k, (s, _, _) in enumerate(own)] + [(9999, 77, 0)], "step long, turn long, number int")
    run = loop.loop_steps(order, frag, limit)
    found = {}
    for r in run.orderBy("turn", "place").collect():
        found.setdefault(r.turn, []).append((r.step, r.goes_on))
    assert found.pop(77) == [(9999, False)]  # a step without deltas
    assert found == {t: loop_twin(own, limit)[0] for t, own in turns.items()}
    late = {r.turn for r in loop.exhausted(run, limit).collect()}
    assert late == {t for t, own in turns.items() if loop_twin(own, limit)[1]}
    calls = deltas.call_results(deltas.parsed_calls(deltas.tool_calls(frag)), spark.createDataFrame([], "step long, place int, output string, error string"), spark.createDataFrame([("f0", False), ("f1", True)], "name string, ephemeral boolean"))
    events = {}
    for r in loop.loop_events(run, frag, calls, limit).orderBy("turn", *loop.ORDER).collect():
        events.setdefault(r.turn, []).append(r.type)
    for turn, own in turns.items():
        steps, out = loop_twin(own, limit)
        got = events[turn]
        assert got.count("start-step") == got.count("finish-step") == len(steps) + out and got[0] == "start-step" and got[-1] == "finish-step"
        slots = {s: n for s, _, n in own}
        assert got.count("tool-output-available") == got.count("tool-input-start") == sum(slots[s] for s, on in steps if on)
        if out:
            assert got[-5:] == ["start-step", "text-start", "text-delta", "text-end", "finish-step"]
    rows = loop.loop_messages(run, frag, calls).orderBy("turn", "place", "row").collect()
    assert [r.role for r in rows if r.turn == 0] == [role for s, on in loop_twin(turns[0], limit)[0] if on for role in ["assistant"] + ["tool"] * {x: n for x, _, n in turns[0]}[s]]
    assert all(len(r.tool_calls) >= 1 for r in rows if r.role == "assistant")


# Tools that run.


def test_tools_run_each_for_itself(spark):
    def fails(context, **given):
        raise KeyError("gone")

    tools = [Tool("say", lambda context, text="": f"{context['user']} {text}"), Tool("fails", fails, ephemeral=True), Tool("quiet", lambda context: None), Tool("secret", lambda context: "seen", reserved=True)]
    rows = [
        (1, 0, "a", "say", '{"text":"hi"}'), (1, 1, "b", "fails", "{}"), (1, 2, "c", "say", '{"text":"on"}'), (1, 3, "d", "none", "{}"), (1, 4, "e", "quiet", None), (2, 0, "f", "say", "{}"), (2, 1, "g", "secret", "{}"),
        (3, 0, "h", "secret", ""), (3, 1, "i", "say", '{"wrong":1}'), (3, 2, "j", "say", "[1]"), (3, 3, "k", None, "{}"),
    ]
    calls = spark.createDataFrame(rows, "step long, place int, call_id string, call_name string, input string").withColumn("user", F.concat(F.lit("u"), "step"))
    scopes = spark.createDataFrame([(2, None, None, ["say"]), (3, ["secret"], None, None)], "step long, exposed array<string>, allow array<string>, deny array<string>")
    got = {(r.step, r.place): (r.output, r.ephemeral) for r in run_tools(in_scope(calls, scopes, registry(spark, tools)), tools, "user").collect()}
    assert [got[1, k][0] for k in range(5)] == ["u1 hi", "[tool failed] KeyError: 'gone'", "u1 on", "[no tool named none]", ""]
    assert got[1, 1][1] and not got[1, 0][1]
    assert got[2, 0][0] == "[no tool named say]" and got[2, 1][0] == "[no tool named secret]"
    assert got[3, 0][0] == "seen" and got[3, 1][0].startswith("[tool failed] TypeError") and got[3, 2][0].startswith("[tool failed] TypeError") and got[3, 3][0] == "[no tool named None]"
    assert run_tools(in_scope(calls.limit(0), scopes, registry(spark, tools)), tools).count() == 0


# Streams.


def test_streamed_events_however_they_are_cut(spark):
    rng = random.Random(9)
    rows = []
    for step in range(12):
        n = rng.randint(1, 9)
        rows += [(step, step + 20 * k, rng.choice([None, "", f"t{k}"]), rng.choice([None, "", f"r{k}", f"r{k}"]), k == n - 1) for k in range(n)]
    frame = spark.createDataFrame(rows, "step long, seq long, content string, reasoning_content string, last boolean")
    key = lambda r: (r.step, r.seq is None, r.seq or 0, r.ord, r.type, r.delta)
    expected = sorted(map(key, deltas.events(frame).collect()), key=str)
    for parts in (1, 4):
        assert sorted(map(key, streams.run_in_parts(frame, "seq", answer_events.answer_events, answer_events.OUTPUT, parts).collect()), key=str) == expected


def pushed_twin(rows):
    known, out = {}, {}
    for service, at, request, usable in sorted(rows, key=lambda r: (r[1], r[2] is not None, r[2] or 0)):
        if request is None:
            known[service] = sorted(set(usable)) or known.get(service, [])
        else:
            own = known.get(service, [])
            out[request] = (own[request % len(own)] if own else None, len(own))
    return out


@pytest.mark.parametrize("parts", [1, 3])
def test_empty_pushes_leave_the_instances(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.randint(0, 2), at, at if rng.random() < 0.6 else None, rng.sample("wxyz", rng.choice([0, 0, 1, 3]))) for at in range(80)]
    pushes = spark.createDataFrame([(s, at, [(a, None, True) for a in own] + [("off", False, None)] * (at % 2)) for s, at, r, own in rows if r is None], "service long, t long, instances array<struct<address string, healthy boolean, enabled boolean>>")
    requests = spark.createDataFrame([(s, at, r) for s, at, r, _ in rows if r is not None], "service long, t long, request_id long")
    timed = lambda f: f.withColumn("at", F.timestamp_seconds("t"))
    both = instances.pushes_and_requests(timed(pushes), timed(requests)).withColumn("number", F.unix_seconds("at"))
    got = {r.request_id: (r.address, r.n_known) for r in streams.run_in_parts(both, "number", instances.answered_requests, instances.OUTPUT, parts).collect()}
    assert got == pushed_twin(rows)


def test_an_expired_session_starts_from_its_stored_history(spark):
    hour = 3600
    old = spark.createDataFrame([("a", 1, 1 * hour), ("a", 2, 2 * hour), ("a", 3, 3 * hour), ("b", 4, 3 * hour)], "session_id string, seq long, t long")
    rows = spark.createDataFrame([("a", 10, 40 * hour), ("a", 11, 41 * hour), ("c", 12, 41 * hour), ("a", 13, 70 * hour), ("c", 14, 64 * hour), ("d", 15, 100 * hour), ("a", 16, 90 * hour)], "session_id string, seq long, t long")
    timed = lambda f: f.select("session_id", "seq", F.timestamp_seconds("t").alias("created_at"), F.lit("x").alias("content"))
    folder = streams._own_folder(spark)
    got = {}
    for run, part in enumerate(("t < 150000", "t >= 150000")):  # the two ends of the silence come in two runs
        timed(rows.filter(part)).write.mode("append").parquet(f"{folder}/source")
        source = spark.readStream.schema(timed(rows).schema).parquet(f"{folder}/source").withWatermark("created_at", "0 seconds")
        streams._run(hot_context.live_context(source, timed(old), 5, limit=2), folder, run, "update", True, 300)
    for r in streams._last(streams._rows(spark, folder, hot_context.OUTPUT), "session_id").collect():
        got.setdefault(r.session_id, []).append(r.seq)
    # a: 40 and 41, silent for 29 hours, so again 1 and 2 (the oldest two), then 13 and 16; c: silent for 36 hours at the end
    assert {k: sorted(v, key=lambda x: (x is None, x)) for k, v in got.items()} == {"a": [1, 2, 13, 16], "c": [None], "d": [15]}


def test_live_rows_ask_one_state_once(spark):
    at = 1_700_000_000_000_000
    calls, context = [], hot_context.LiveRows(5, limit=2)
    context.held, context.handle = Told(calls, ([4], [at], ["x"], [1, 2], [at, at], ["a", "b"], at // 1000)), Told(calls, None)
    row = next(context.handleInputRows(("s",), iter([hot_context.Row(seq=7, at=at + 86_400_000_000, content="y")]), None))
    assert (row.seq, row.content) == ([1, 2, 7], ["a", "b", "y"]) and sorted(calls) == ["deleteTimer", "get", "registerTimer", "update"]


def test_live_messages_have_no_time_limit_and_take_folders(spark, tmp_path, monkeypatch):
    from pyspark.sql.streaming.query import StreamingQuery

    waits, wait = [], StreamingQuery.awaitTermination
    monkeypatch.setattr(StreamingQuery, "awaitTermination", lambda self, timeout=None: waits.append(timeout) or wait(self, timeout))
    day = 1_705_276_800 + 86_400  # the second day after the cut
    events = spark.range(40).select(F.col("id").alias("event_id"), (F.col("id") % 4).alias("user_id"), F.timestamp_seconds(F.lit(day) + (F.col("id") - 20) * 36_000).alias("ts"), F.lit("view").alias("event_type"))
    events.repartition(3).write.parquet(str(tmp_path / "folder/events.parquet"))
    pq.write_table(events.toArrow(), (tmp_path / "events.parquet"))
    got = [sorted(map(tuple, streams.live_messages(spark, str(d), "2024-01-15 00:00:00", size=3, limit=2).collect())) for d in (tmp_path, tmp_path / "folder")]
    assert got[0] == got[1] and len(got[0]) > 0 and waits == [None, None]


# Compression.


@pytest.fixture
def long_sessions(spark):
    rows = [(s, i, "user", f"{s}{i}", 10) for s in "abc" for i in range(6)] + [("short", 0, "user", "x", 1), ("none", 0, "user", None, None)]
    frame = spark.createDataFrame(rows, "session_id string, seq long, role string, content string, token_count long")
    return frame.withColumn("created_at", F.timestamp_seconds(F.col("seq") + 100))


def test_a_batch_done_again_changes_nothing(spark, tmp_path, long_sessions, monkeypatch):
    log = tmp_path / "asked"

    def summarise(requests):
        with open(log, "a") as f:
            f.write("x" * len(requests))
        if any("b0" in r for r in requests):
            raise RuntimeError("no model")
        return [" \n" if "c0" in r else f"s{os.path.getsize(log)}" for r in requests]

    step = Compression(spark, str(tmp_path / "out"), summarise, 60)
    assert step.summaries().count() == 0 and step.recent().count() == 0
    written = []
    real = type(long_sessions.write).parquet

    def fails_at_recent(self, path, *args, **kwargs):
        if "/recent/" in path and not written:
            written.append(path)
            raise OSError("lost")
        return real(self, path, *args, **kwargs)

    monkeypatch.setattr(type(long_sessions.write), "parquet", fails_at_recent)
    with pytest.raises(OSError):
        step.step(long_sessions, 0)
    assert step.summaries().count() == 0  # without a marker nothing counts
    asked = os.path.getsize(log)
    step.step(long_sessions, 0)
    first = [tuple(r) for r in step.summaries().collect()]
    assert [r[0] for r in first] == ["a"] and os.path.getsize(log) == asked  # b failed, c was blank, and no model was asked again
    assert sorted((r.session_id, r.seq) for r in step.recent().collect()) == [("a", 3), ("a", 4), ("a", 5)]
    step.step(long_sessions, 0)
    step.step(long_sessions.limit(0), 1)
    assert [tuple(r) for r in step.summaries().collect()] == first and os.path.getsize(log) == asked
    hot = history.replaced(long_sessions, step.recent().select(long_sessions.columns))
    assert hot.filter("session_id = 'a'").count() == 3 and hot.filter("session_id = 'b'").count() == 6


def test_compression_in_a_stream(spark, tmp_path, long_sessions):
    long_sessions.write.parquet(str(tmp_path / "source"))
    step = Compression(spark, str(tmp_path / "out"), lambda requests: [f"sum {len(r)}" for r in requests], 60)
    stream = spark.readStream.schema(long_sessions.schema).parquet(str(tmp_path / "source"))
    for _ in range(2):  # the second run finds nothing new
        running = stream.writeStream.foreachBatch(step.step).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        running.awaitTermination(300)
    assert sorted(r.session_id for r in step.summaries().collect()) == ["a", "b", "c"]


# Topics.


def test_a_line_counts_once(spark, tmp_path):
    sink = Topics(spark, str(tmp_path))
    rows = spark.createDataFrame([(f"t{i % 2}", f'{{"n":{i},"s":"é"}}') for i in range(50)], "topic string, value string").repartition(4)
    assert sink.send(rows) and sink.failures == 0
    lines = sorted(map(tuple, sink.read().collect()))
    assert lines == sorted(map(tuple, rows.collect()))
    # an attempt that was lost before its commit left files behind
    files = TopicFiles({"path": str(tmp_path)})
    writer = files.streamWriter(rows.schema, False)
    left = writer.write(iter(rows.limit(3).collect()))
    assert sorted(map(tuple, sink.read().collect())) == lines
    # a batch that is committed twice counts once, and its second files go
    again = writer.write(iter(rows.limit(3).collect()))
    writer.commit([left, None], 7)
    writer.commit([again], 7)
    assert len(sink.read().collect()) == 53 and not any((tmp_path / f).exists() for f in again.files)
    lost = writer.write(iter(rows.limit(1).collect()))
    writer.abort([lost, None], 8)
    assert not any((tmp_path / f).exists() for f in lost.files) and isinstance(lost, Written)
    assert not sink.send(rows.withColumn("value", F.lit("two\nlines"))) and sink.failures == 1
    assert len(sink.read().collect()) == 53
    assert not Topics(spark, "/proc/no/such").send(rows)


def test_a_stream_into_topics(spark, tmp_path):
    sink = Topics(spark, str(tmp_path / "topics"))
    rows = spark.createDataFrame([("t", str(i)) for i in range(20)], "topic string, value string")
    for part in ("value < 10", "value >= 10"):
        rows.filter(f"cast({part.split()[0]} as int) {part.split()[1]} 10").write.mode("append").parquet(str(tmp_path / "source"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "source"))
        assert sink.stream(stream, str(tmp_path / "checkpoint")).awaitTermination(300)
    assert sorted(int(r.value) for r in sink.read().collect()) == list(range(20))


# Memory in two stages.


def test_memories_in_the_order_of_their_own_scores(spark):
    memories = spark.createDataFrame([(1, 1, [1.0, 1e-5], "x"), (1, 2, [1.0, 0.0], "y"), (1, 3, [0.0, 0.0], "z"), (2, 4, None, "w")], "user_id int, memory_id int, embedding array<double>, memory string")
    queries = spark.createDataFrame([(1, 9, [1.0, 0.0]), (2, 8, [1.0, 0.0])], "user_id int, query_id int, query array<double>")
    found = retrieval.search_memory(memories, queries)
    assert [(r.memory_id, r.rank) for r in found.filter("query_id = 9").orderBy("rank").collect()] == [(2, 1), (1, 2), (3, 3)]
    scores = {"x": 0.5, "y": 0.5 + 1e-12, "z": None, "w": None}
    again = retrieval.reranked(found, lambda batch: [scores[m] for m in batch.column(0).to_pylist()], "memory")
    assert [(r.query_id, r.memory_id, r.rank) for r in again.orderBy("query_id", "rank").collect()] == [(8, 4, 1), (9, 2, 1), (9, 1, 2), (9, 3, 3)]
    kept = retrieval.reranked(found, lambda batch: [scores[m] for m in batch.column(0).to_pylist()], "memory", threshold=0.1)
    assert sorted(r.memory_id for r in kept.collect()) == [1, 2]
    assert retrieval.reranked(found.limit(0), lambda batch: [], "memory").count() == 0


# Orders that hold at any size.


def test_outputs_follow_all_inputs_of_any_number(spark):
    rows = spark.createDataFrame([(1, 600_000, "a", "t", "{}", "o"), (1, 0, "b", "t", "{}", "o")], "step long, place int, call_id string, name string, input string, output string")
    got = [(r.type, r.call_id) for r in deltas.tool_events(rows).orderBy("phase", "place", "k").collect()]
    assert got == [("tool-input-start", "b"), ("tool-input-available", "b"), ("tool-input-start", "a"), ("tool-input-available", "a"), ("tool-output-available", "b"), ("tool-output-available", "a")]


def test_run_time_tools_come_last_whatever_the_numbers(spark):
    tools = lambda rows: spark.createDataFrame(rows, "seq long, name string")
    got = routing.overlaid_tools(tools([(2**40, "a"), (1, "b")]), tools([(3, "c"), (4, "a")])).orderBy("place_late", "place_seq").collect()
    assert [(r.name, r.seq) for r in got] == [("b", 1), ("a", 4), ("c", 3)]


def test_version_numbers_of_any_length(spark):
    old = spark.createDataFrame([], "skill_id string, version string, created_at long, updated_at long")
    for versions, best in ((["1.10000000000", "1.2"], "1.10000000000"), (["1.2", "1.002.1", "1.x"], "1.002.1"), (["9" * 60, "1" + "0" * 60], "1" + "0" * 60)):
        new = spark.createDataFrame([("s", v, 9) for v in versions], "skill_id string, version string, at long")
        assert finalize.upserted_skills(old, new, by_number=True).first().version == best


def test_each_turn_is_billed_once(spark):
    rows = spark.createDataFrame([("s", 1, 0, 10), ("s", 2, 0, 5), ("s", 2, 1, 7), ("s", 3, 0, None)], "session_id string, turn int, model_id int, token_count int")
    models = spark.createDataFrame([(0, "m", 1, 2)], "model_id int, model_name string, type int, billing_ratio int")
    turns = spark.createDataFrame([("s", t, "u", None, f"trace{t}") for t in (1, 2, 3)], "session_id string, turn int, user_id string, group_id string, trace_id string").withColumn("requested_at", F.timestamp_seconds(F.lit(0)))
    sent = finalize.billing_events(finalize.usage(rows, models), turns).collect()
    assert sorted((r.trace_id, r.value.split('"usageTokens":')[1].split(",")[0]) for r in sent) == [("trace1", "10"), ("trace2", "5"), ("trace2", "7")]


def test_a_session_without_a_title_is_owned(spark):
    sessions = spark.createDataFrame([("a", 1, None), ("b", 2, "t")], "session_id string, user_id int, title string")
    asked = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "b", 2), (4, None, 1)], "request_id int, session_id string, user_id int")
    assert {r.request_id: r.code for r in history.owned_sessions(asked, sessions).collect()} == {1: 200, 2: 40001, 3: 200, 4: 40001}


def test_a_term_in_a_script_without_blanks_is_found(spark):
    dictionary = spark.createDataFrame([("天气", 5), ("今天", 9)], "word string, freq long")
    rows = spark.createDataFrame([("s", 1, "今天天气很好"), ("s", 2, "今天")], "session_id string, seq long, content string").withColumn("created_at", F.timestamp_seconds(F.col("seq")))
    asked = spark.createDataFrame([(1, "天气")], "request_id int, content string")
    terms = segmentation.with_terms(asked, dictionary).select("request_id", "terms")
    found = segmentation.with_terms(rows, dictionary).join(terms.withColumnRenamed("terms", "wanted"), F.arrays_overlap("terms", "wanted"))
    assert [r.seq for r in found.collect()] == [1]
    assert X.search_tokens is not None


def test_answers_out_of_an_index_with_a_dictionary(spark, tmp_path):
    dictionary = spark.createDataFrame([("天气", 5), ("今天", 9)], "word string, freq long")
    rows = spark.createDataFrame([("s", 1, "今天天气很好"), ("s", 2, "今天"), ("t", 1, "Weather 天气"), ("s", 3, "weather")], "session_id string, seq long, content string")
    rows = rows.withColumn("created_at", F.timestamp_seconds(F.lit(10) - F.col("seq"))).withColumn("role", F.lit("user"))
    stored = finalize.with_search_tokens(rows, dictionary)
    assert [r.search_tokens for r in stored.orderBy("session_id", "seq").collect()] == ["今天 天气", "今天", "weather", "weather 天气"]
    index = search_index.SearchIndex(spark, str(tmp_path / "index"))
    index.append(stored.withColumn("terms", F.split("search_tokens", " ")), 0)
    asked = spark.createDataFrame([(1, "s", " 天气 weather!", None, None), (2, None, "天气", "1970-01-01T00:00:09", None), (3, "s", "天", None, None)], "request_id int, session_id string, keyword string, start string, end string")
    found = retrieval.indexed_requests(index, rows, asked, dictionary)
    assert sorted((r.request_id, r.session_id, r.seq) for r in found.collect()) == [(1, "s", 1), (1, "s", 3), (2, "s", 1), (2, "t", 1)]
    assert [(r.request_id, r.session_id, r.seq) for r in retrieval.indexed_requests(index, rows, asked, dictionary, 1).filter("request_id = 1").collect()] == [(1, "s", 3)]


def test_assets_behind_a_cache(spark, tmp_path):
    from datetime import datetime, timedelta, timezone

    from colloquy.sources.asset_cache import AssetCache

    log = tmp_path / "asked"
    log.mkdir()

    def fetch(key):
        (log / f"{key}-{len(list(log.glob(key + '-*')))}").touch()
        if key == "bad":
            raise OSError("away")
        return None if key == "none" else key.encode() * 3

    now = datetime(2024, 1, 1, tzinfo=timezone.utc)
    cache = AssetCache(spark, str(tmp_path / "cache"), fetch)
    assert cache.drop_unused(now, 0) == 0
    asked = spark.createDataFrame([(1, "a"), (2, "a"), (3, "bad"), (4, "none"), (5, ""), (6, None), (7, "é")], "request_id int, object_key string")
    read = lambda batch, at: {r.request_id: (r.outcome, r.data and bytes(r.data).decode()) for r in cache.read(asked, batch, at).collect()}
    first = read(0, now)
    assert first == {1: ("fetched", "aaa"), 2: ("fetched", "aaa"), 3: ("failed", None), 4: ("not_found", None), 5: ("bad_key", None), 6: ("bad_key", None), 7: ("fetched", "ééé")}
    assert read(1, now + timedelta(hours=1)) == {**first, 1: ("cached", "aaa"), 2: ("cached", "aaa"), 7: ("cached", "ééé")}
    assert len(list(log.glob("a-*"))) == 1 and len(list(log.glob("bad-*"))) == 2
    cache.read(asked.filter("request_id = 1"), 2, now + timedelta(hours=3)).count()
    assert cache.drop_unused(now + timedelta(hours=4), 7200) == 1  # what was used an hour ago stays
    assert {k: v[0] for k, v in read(3, now + timedelta(hours=4)).items() if k in (1, 7)} == {1: "cached", 7: "fetched"}
    assert cache.read(asked.limit(0), 4, now).count() == 0
