"""Procedural twins on small random rows, and the odd cases."""

import random

import pytest
from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.operators import deltas, finalize, history, retrieval, routing
from colloquy.sources.tables import read_assets, read_bundles
from colloquy.streaming.hot_context import LatestTable


def page_of(rows, size):
    """rows (created, seq, role) of a session; the page of each visible row, walked from the newest user row."""
    users = sorted((t for t, _, role in rows if role == "user"), reverse=True)
    out = {}
    for first in range(0, len(users), size):
        oldest = users[min(first + size, len(users)) - 1]
        below = users[first - 1] if first else None
        for t, seq, role in rows:
            if t >= oldest and (below is None or t < below) and role in history.VISIBLE:
                out[seq] = first // size + 1
    return out


def groups_of(roles):
    out, n = [], 0
    for i, role in enumerate(roles):
        if i == 0 or role == "user" or roles[i - 1] == "user":
            n += 1
        out.append(n)
    return out


def sessions(seed, count=40):
    rng = random.Random(seed)
    for s in range(count):
        t = 0
        rows = []
        for seq in range(rng.randint(0, 14)):
            t += rng.choice([0, 0, 1, 2])
            rows.append((t, seq, rng.choice(["user", "user", "assistant", "tool", "system"]), rng.choice([None, 0, 3, 10, 25])))
        yield str(s), rows


@pytest.fixture(scope="module")
def chat(spark):
    rows = [(s, seq, role, tokens, t) for s, own in sessions(1) for t, seq, role, tokens in own]
    frame = spark.createDataFrame(rows, "session_id string, seq long, role string, token_count long, t long")
    return frame.withColumn("created_at", F.timestamp_seconds("t")).withColumn("content", F.concat(F.lit("text "), "seq"))


@pytest.mark.parametrize("size", [1, 2, 5])
def test_pages_walked_by_hand(chat, size):
    found = {}
    for r in history.turn_pages(chat, size).collect():
        found.setdefault(r.session_id, {})[r.seq] = r.page
    assert found == {s: p for s, rows in sessions(1) if (p := page_of([x[:3] for x in rows], size))}


def test_token_window_walked_by_hand(chat):
    found = {(r.session_id, r.seq): (r.kept, r.compress) for r in history.token_window(chat, 80).collect()}
    for s, rows in sessions(1):
        total = 0
        for _, seq, _, tokens in sorted(rows, key=lambda r: -r[1]):
            total += tokens or 0
            assert found[s, seq][0] == (total <= 40)
        assert all(found[s, seq][1] == (total >= 64) for _, seq, _, _ in rows)


def test_islands_walked_by_hand(chat):
    found = {(r.session_id, r.seq): r.group_no for r in history.islands(chat).collect()}
    for s, rows in sessions(1):
        assert [found[s, r[1]] for r in rows] == groups_of([r[2] for r in rows])


def test_fallback_takes_the_oldest_rows_unless_recent_is_asked_for(chat):
    name, rows = max(sessions(1), key=lambda x: len(x[1]))
    n = len(rows)
    assert n > 3
    assert [r.seq for r in history.history(chat, name, limit=2).collect()] == [0, 1]
    assert [r.seq for r in history.history(chat, name, limit=2, recent=True).collect()] == [n - 2, n - 1]
    assert history.history(chat, "unknown").count() == 0


def stream_events(rows):
    """The reader's state machine over (seq, reasoning, content)."""
    out, thinking, writing = [], False, False
    for seq, reasoning, content in rows:
        if reasoning:
            if not thinking:
                out.append((seq, "reasoning-start", None))
                thinking = True
            out.append((seq, "reasoning-delta", reasoning))
        if content:
            if not writing:
                if thinking:
                    out.append((seq, "reasoning-end", None))
                    thinking = False
                out.append((seq, "text-start", None))
                writing = True
            out.append((seq, "text-delta", content))
    if thinking:
        out.append((None, "reasoning-end", None))
    if writing:
        out.append((None, "text-end", None))
    return out


def test_delta_events_equal_the_state_machine(spark):
    rng = random.Random(7)
    steps = {s: [(i, rng.choice([None, "", "r"]), rng.choice([None, "", "", "c"])) for i in range(rng.randint(1, 9))] for s in range(80)}
    frame = spark.createDataFrame([(s, *r) for s, rows in steps.items() for r in rows], "step long, seq long, reasoning_content string, content string")
    found = {}
    for r in sorted(deltas.events(frame).collect(), key=lambda r: (r.seq is None, r.seq, r.ord)):
        found.setdefault(r.step, []).append((r.seq, r.type, r.delta))
    assert found == {s: e for s, rows in steps.items() if (e := stream_events(rows))}


def test_redaction(spark):
    rows = [("s", 1, "assistant", "a", None, True), ("s", 2, "tool", "secret", "find", True), ("s", 3, "tool", "x", None, True), ("s", 4, "user", "u", None, True), ("s", 5, "assistant", "b", None, False)]
    frame = spark.createDataFrame(rows, "session_id string, seq long, role string, content string, name string, ephemeral boolean")
    got = [(r.seq, r.content, r.ephemeral) for r in finalize.redacted(frame).orderBy("seq").collect()]
    assert got == [(2, "[output of find omitted]", True), (3, "[output of unknown omitted]", True), (4, "u", False), (5, "b", False)]


def test_rows_without_a_flag_are_kept(spark):
    rows = [("s", 1, "assistant", "a", None, None), ("s", 2, "tool", "t", None, None), ("s", 3, "assistant", "x", None, True)]
    frame = spark.createDataFrame(rows, "session_id string, seq long, role string, content string, name string, ephemeral boolean")
    assert [(r.seq, r.content, r.ephemeral) for r in finalize.redacted(frame).orderBy("seq").collect()] == [(1, "a", False), (2, "t", False)]


def test_prompt_order_holds_for_large_numbers(spark):
    rows = [("s", 5, "user", "old", 90), ("s", 1_500_000, "assistant", "new", 10), ("s", 1_500_001, "user", "newest", 10)]
    messages = spark.createDataFrame(rows, "session_id string, seq long, role string, content string, token_count long")
    sessions = spark.createDataFrame([("s", None)], "session_id string, current_summary string")
    queries = spark.createDataFrame([("s", "q", None, [("k", "v", None), ("off", "v", True), ("none", "", False)])], "session_id string, query string, facts array<string>, states array<struct<key:string,value:string,disabled:boolean>>")
    skills = spark.createDataFrame([("s", [])], "session_id string, skills array<struct<skill_id:string,description:string>>")
    read = lambda **how: [r.content for r in finalize.prompt(messages, sessions, skills, queries, 100, **how).orderBy("section", "place").collect()]
    assert read()[1:] == ["new", "newest", "old", "State of the interface:\nk = v", "q"]
    assert read(chronological=True)[1:4] == ["old", "new", "newest"]


def test_unknown_events_fail_and_every_step_ends(spark):
    outcomes = spark.createDataFrame([(1, "ok", None), (2, "cancelled", None), (3, "failed", "why")], "step long, outcome string, message string")
    events = spark.createDataFrame([(1, 0, "start-step"), (1, 1, "finish-step")], "step long, ord long, type string")
    got = [r.frame for r in deltas.frames(events, ["ord"], outcomes).orderBy("step", "part", "ord").collect()]
    ends = [g.removeprefix("data: ").strip() for g in got]
    assert ends == [
        '{"type":"start","messageId":"msg_1"}', '{"type":"start-step"}', '{"type":"finish-step"}', '{"type":"finish"}', "[DONE]",
        '{"type":"start","messageId":"msg_2"}', '{"type":"abort","reason":"user_cancelled"}', "[DONE]", '{"type":"start","messageId":"msg_3"}', '{"type":"error","errorText":"why"}', "[DONE]",
    ]
    with pytest.raises(Exception, match="unknown event"):
        deltas.frames(events.withColumn("type", F.lit("noise")), ["ord"], outcomes).collect()


def test_appends_assets_and_lookups(spark, tmp_path):
    rows = spark.createDataFrame([("u", "user", "hi")], "user_id string, role string, content string")
    path = str(tmp_path / "store")
    assert finalize.appended(finalize.memory_rows(rows), path) and finalize.appended(rows, path) and not finalize.appended(rows.limit(0), path)
    assert spark.read.parquet(path).count() == 2
    for name in ("demo/1.0/references/a.md", "demo/1.0/b.txt"):
        file = tmp_path / "bundles" / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(name)
    keys = ["skills/demo/1.0/references/a.md", "skills/demo/1.0/../1.0/b.txt", "nonsense", "skills/demo/2.0/c", "skills/demo/2.0/d", None]
    requests = spark.createDataFrame(list(enumerate(keys)), "request_id int, object_key string")
    stored = spark.createDataFrame([("skills/demo/2.0/c", bytearray(b"far"))], "object_key string, data binary")
    got = {r.request_id: (r.outcome, bytes(r.data) if r.data else None) for r in read_assets(spark, str(tmp_path / "bundles"), requests, stored).collect()}
    assert got == {0: ("local", b"demo/1.0/references/a.md"), 1: ("bad_key", None), 2: ("bad_key", None), 3: ("stored", b"far"), 4: ("not_found", None), 5: ("bad_key", None)}
    skills = spark.createDataFrame([("a",), ("b",)], "skill_id string")
    assert routing.skill_by_id(skills, "a").count() == 1 and routing.skill_by_id(skills, "x").count() == 0


def test_many_triggers_go_in_blocks(spark, monkeypatch):
    skills = spark.createDataFrame([(f"s{i}", [f"t{i}", "all"], True) for i in range(30)], "skill_id string, triggers array<string>, enabled boolean")
    queries = spark.createDataFrame([(1, "all t7 t12"), (2, "t29")], "query_id long, text string")
    read = lambda: sorted(map(tuple, retrieval.match_skills(queries, skills, 40).collect()))
    whole = read()
    monkeypatch.setattr(retrieval, "SKILL_BYTES", 400)
    assert read() == whole and len(whole) == 32


def test_requests_in_turn_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(routing, "REQUEST_BLOCK", 7)
    rng = random.Random(2)
    ids = sorted(rng.sample(range(500), 150))
    requests = spark.createDataFrame([(i, "ab"[i % 2]) for i in ids], "request_id long, service string")
    instances = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z"), ("a", "w")], "service string, address string")
    got = {r.request_id: r.address for r in routing.pick_in_turn(instances, requests).collect()}
    order = {"a": ["w", "x", "y"], "b": ["z"]}
    assert got == {i: order[s][n % len(order[s])] for s in "ab" for n, i in enumerate(i for i in ids if "ab"[i % 2] == s)}


def test_skill_matching_counts_repeated_triggers(spark):
    skills = spark.createDataFrame([("b", ["X", "x", ""], True), ("a", ["x"], True), ("c", ["x"], False)], "skill_id string, triggers array<string>, enabled boolean")
    queries = spark.createDataFrame([(1, "an X"), (2, ""), (3, None)], "query_id long, text string")
    got = [(r.query_id, r.skill_id, r.hits, r.rank) for r in retrieval.match_skills(queries, skills).collect()]
    assert sorted(got) == [(1, "a", 1, 2), (1, "b", 2, 1)]
    assert {(r.skill_id, r.rank) for r in retrieval.match_skills(queries, skills.filter("skill_id = 'b'"), distinct=True).collect()} == {("b", 1)}
    assert retrieval.match_skills(queries, skills.limit(0)).count() == 0


def test_versions_in_text_order_or_by_number(spark):
    old = spark.createDataFrame([("s", "0.1", 5, 5)], "skill_id string, version string, created_at long, updated_at long")
    new = spark.createDataFrame([("s", "0.9.0", 9), ("s", "0.10.0", 9)], "skill_id string, version string, at long")
    assert [tuple(r) for r in finalize.upserted_skills(old, new).collect()] == [("s", "0.9.0", 5, 9)]
    assert finalize.upserted_skills(old, new, by_number=True).first().version == "0.10.0"


def test_weights_that_are_not_positive_count_alike(spark):
    rows = spark.createDataFrame([("s", "a", -1.0), ("s", "b", 0.0)], "service string, address string, weight double")
    assert [(r.low, r.high) for r in routing.weighted_shares(rows).orderBy("address").collect()] == [(0.0, 0.5), (0.5, 1.0)]


def test_weighted_pick_meets_a_share_for_every_draw(spark):
    rows = spark.range(3000).select(F.lit(1).alias("service"), F.format_string("%05d", "id").alias("address"), F.when(F.col("id") % 10 != 3, (F.col("id") % 7 + 1) / 10).otherwise(0).alias("weight"))
    shares = [r for r in routing.weighted_shares(rows).orderBy("address").collect() if r.high > r.low]
    draws = [(k, 1, r.high) for k, r in enumerate(shares[:-1])] + [(-1, 1, 0.0), (-2, 1, 1.5), (-3, 1, -0.1), (-4, 1, None), (-5, 2, 0.5)]
    picked = {r.request_id: r.address for r in routing.pick_weighted(rows, spark.createDataFrame(draws, "request_id long, service int, draw double")).collect()}
    assert picked == {k: r.address for k, r in enumerate(shares[1:])} | {-1: shares[0].address}



def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_scalar_functions(spark):
    lit = F.lit
    assert value(spark, X.truncated(lit("a😀bc"), 2)) == "a😀\n[truncated]" and value(spark, X.truncated(lit("ab"), 2)) == "ab"
    assert value(spark, X.tool_arguments(lit('{"a": 1}'))) == '{"a":1}' and value(spark, X.tool_arguments(lit("{bad"))) == value(spark, X.tool_arguments(lit(""))) == "{}"
    assert [value(spark, X.safe_path(lit(p))) for p in ("a/b", "", "/a", "a/../b", "a\\b", "a..b")] == [True, False, False, False, False, True]
    assert value(spark, X.parsed_key(lit("skills/s/1/a/b.md")))[2] == "a/b.md" and value(spark, X.parsed_key(lit("x/s/1/a"))) is None
    assert [value(spark, X.clean_title(lit(t), lit("old"))) for t in (' "Hi" ', "''", "it's")] == ["Hi", "old", "it's"]
    assert [value(spark, X.rpc_outcome(lit(s), lit(b))) for s, b in ((503, "{}"), (200, "<html>"), (200, '{"code": 7}'), (200, '{"code": 200}'))] == ["retry", "fail", "fail", "ok"]
    assert value(spark, X.decoded_utf8(lit(b"\xff\x00"))) == "[binary content, 2 bytes]" and value(spark, X.decoded_utf8(lit("é".encode()))) == "é"
    assert value(spark, X.contains_ignoring_case(lit("ABC"), lit("bc"))) and not value(spark, X.contains_ignoring_case(lit("a"), lit("")))


def test_front_matter(spark):
    whole = "---\nskill_id: demo\nenabled: true\ntriggers:\n  - \"one\"\n  - two words\n---\nBody\n"
    got = value(spark, X.front_matter(F.lit(whole)))
    assert got.body == "Body\n" and value(spark, X.front_value(F.lit(got.head), "skill_id")) == "demo" and value(spark, X.front_value(F.lit(got.head), "missing")) is None
    assert value(spark, X.front_list(F.lit(got.head), "triggers")) == ["one", "two words"]
    heads = {
        'a: "x # y"  # note\nl: [a, "b, c", \'d\'\'e\', ]\n': ("x # y", ["a", "b, c", "d'e"]), 'a: plain text # c\nl:\n  - one # c\n  # comment\n  - "two: x"\n  -   \n\nb: 2\n': ("plain text", ["one", "two: x"]),
        "a: 'it''s'\nl: []\n": ("it's", []), 'a: "say \\"hi\\""\r\nl:\r\n- x\r\n- y\r\nz: 1\r\n': ('say "hi"', ["x", "y"]), "a:\nl: nothing": (None, []), "  a: nested\nl:\n  - q": (None, ["q"]), "a: x#y\nl: [one]": ("x#y", ["one"]), "": (None, []),
    }
    for head, expected in heads.items():
        assert (value(spark, X.front_value(F.lit(head), "a")), value(spark, X.front_list(F.lit(head), "l"))) == expected
    for text in ("no head", "---\nunclosed: 1\n"):
        assert tuple(value(spark, X.front_matter(F.lit(text)))) == ("", text)


def test_bundles(spark, tmp_path):
    for name in ("demo/1.0/SKILL.md", "demo/1.0/references/a.md", "demo/1.0/templates/x/b.md", "demo/2.0/other.txt"):
        path = tmp_path / "bundles" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("text")
    got = {(r.skill_id, r.version, r.asset_path, r.kind, r.object_key, r.size_bytes) for r in read_bundles(spark, str(tmp_path / "bundles")).collect()}
    assert got == {
        ("demo", "1.0", "references/a.md", "reference", "skills/demo/1.0/references/a.md", 4), ("demo", "1.0", "templates/x/b.md", "template", "skills/demo/1.0/templates/x/b.md", 4),
        ("demo", "2.0", "other.txt", "other", "skills/demo/2.0/other.txt", 4),
    }


def test_refresh_keeps_the_last_good_view(spark):
    answers = iter([spark.range(3), spark.range(0), None, spark.range(5)])
    table = LatestTable("fresh", lambda: next(answers))
    sizes = []
    for _ in range(4):
        table.refresh()
        sizes.append(spark.table("fresh").count())
    assert sizes == [3, 3, 3, 5] and table.errors == 1


def test_stream_state_equals_the_batch_form(spark):
    from colloquy.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    stream = {(r.session_id, r.seq) for r in QUERIES["hot_context_stream"](spark, sf).collect()}
    assert stream == {(r.session_id, r.seq) for r in QUERIES["hot_context_last_n"](spark, sf).collect()}


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as Thing

    from colloquy.sources.shared import shared_folder

    session = lambda folder, master: Thing(conf=Thing(get=lambda key, default: folder), sparkContext=Thing(master=master))
    assert shared_folder(session("hdfs://store/tmp/", "yarn")) == "hdfs://store/tmp"
    assert shared_folder(session(None, "local[4]")).startswith("file://")
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_folder(session(None, master))
