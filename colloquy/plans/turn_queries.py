"""Queries of the loop, of running tools, of the index, and of the stream and sink operators, each beside its SQL."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import deltas as D
from ..operators import finalize as Z
from ..operators import history as H
from ..operators import loop as L
from ..operators import retrieval as R
from ..operators import routing as G
from ..operators import segmentation as W
from ..operators import tools as T
from ..sources import asset_cache, search_index
from ..sources import tables as S
from ..sources.shared import temporary_folder
from .queries import AGENT, CALLS, COUNTED, DELTAS, EVENTS, MESSAGES, MODELS, ORACLES, QUERIES, REDACTED, TOKENS, query, search_asked


# The loop over steps.  A user of `events` is a step; seven of them in a row are a turn.

GOING = "step % 5 <> 1"
LOOP = f"""turned AS (SELECT step, step // 7 AS turn, step % 7 AS number, {GOING} AND bool_or(slot IS NOT NULL) AS goes_on FROM deltas GROUP BY step),
ranked AS (SELECT *, row_number() OVER (PARTITION BY turn ORDER BY number) AS place, coalesce(bool_or(NOT goes_on) OVER (PARTITION BY turn ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ended FROM turned),
run AS (SELECT turn, step, CAST(place AS INT) AS place, goes_on FROM ranked WHERE NOT ended AND place <= 5),
late AS (SELECT turn FROM run WHERE place = 5 AND goes_on)"""
LOOP_EVENTS = f"""{LOOP}, loop_events AS (
SELECT turn, place, 0 AS part, 0 AS seq, 0 AS k, 'start-step' AS type, NULL AS delta, NULL AS call_id, NULL AS tool_name, NULL AS input, NULL AS output FROM run
UNION ALL SELECT turn, place, 5, 0, 0, 'finish-step', NULL, NULL, NULL, NULL, NULL FROM run
UNION ALL SELECT turn, place, CASE WHEN seq IS NULL THEN 2 ELSE 1 END, coalesce(seq, 0), ord, type, delta, NULL, NULL, NULL, NULL FROM events_ JOIN run USING (step)
UNION ALL SELECT turn, run.place, 3, c.place, 0, 'tool-input-start', NULL, call_id, name, NULL, NULL FROM called c JOIN run USING (step) WHERE goes_on
UNION ALL SELECT turn, run.place, 3, c.place, 1, 'tool-input-available', NULL, call_id, name, input, NULL FROM called c JOIN run USING (step) WHERE goes_on
UNION ALL SELECT turn, run.place, 4, c.place, 0, 'tool-output-available', NULL, call_id, NULL, NULL, output FROM called c JOIN run USING (step) WHERE goes_on
UNION ALL SELECT turn, 6, part, 0, k, type, delta, NULL, NULL, NULL, NULL FROM late, (VALUES (0, 0, 'start-step', NULL), (1, 0, 'text-start', NULL), (1, 1, 'text-delta', 'out of steps'), (2, 0, 'text-end', NULL), (5, 0, 'finish-step', NULL)) w(part, k, type, delta))"""
CALLED = CALLS.replace(f"{DELTAS}, ", "")


def _turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(deltas, steps that run, tool rows): steps end with `tool_calls` but for one in five."""
    from .queries import _call_rows

    deltas = S.deltas(spark, sf_dir).withColumn("finish_reason", F.when(F.col("step") % 5 != 1, "tool_calls").otherwise("stop"))
    steps = deltas.select("step").distinct().select("step", F.floor(F.col("step") / 7).alias("turn"), (F.col("step") % 7).alias("number"))
    return deltas, L.loop_steps(steps, deltas), _call_rows(spark, sf_dir)


@query(f"""WITH {EVENTS}, {CALLED}, {LOOP_EVENTS} SELECT turn, place, CAST(part AS INT) AS part, CAST(seq AS BIGINT) AS seq, CAST(k AS INT) AS k, type, delta, call_id, tool_name, input, output FROM loop_events""")
def turn_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    deltas, run, calls = _turns(spark, sf_dir)
    return L.loop_events(run, deltas, calls, warning="out of steps")


@query(f"""WITH {EVENTS}, {CALLED}, {LOOP_EVENTS}, texts AS (SELECT turn, place, part, seq, k, '{{"type":"' || type || '"' || coalesce(',"delta":' || to_json(delta), '') || coalesce(',"toolCallId":"' || call_id || '"', '')
 || coalesce(',"toolName":"' || tool_name || '"', '') || coalesce(',"input":' || input, '') || coalesce(',"output":"' || output || '"', '') || '}}' AS body FROM loop_events
 UNION ALL SELECT DISTINCT turn, NULL, -1, NULL, NULL, '{{"type":"start","messageId":"msg_' || turn || '"}}' FROM run
 UNION ALL SELECT DISTINCT turn, NULL, -2, NULL, NULL, '{{"type":"finish"}}' FROM run UNION ALL SELECT DISTINCT turn, NULL, -3, NULL, NULL, '[DONE]' FROM run)
SELECT turn, place, CASE WHEN part < 0 THEN -part ELSE 0 END AS around, CASE WHEN part >= 0 THEN CAST(part AS INT) END AS part, CAST(seq AS BIGINT) AS seq, CAST(k AS INT) AS k, 'data: ' || body || chr(10) || chr(10) AS frame FROM texts""")
def turn_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole turns as server-sent frames, steps included; `around` tells what comes before and after the events."""
    deltas, run, calls = _turns(spark, sf_dir)
    events = L.loop_events(run, deltas, calls, warning="out of steps").withColumnsRenamed({"turn": "step", "part": "event_part"})
    outcomes = run.select(F.col("turn").alias("step"), F.lit("ok").alias("outcome"), F.lit(None).cast("string").alias("message")).distinct()
    made = D.frames(events, ["place", "event_part", "seq", "k"], outcomes)
    around = F.when(F.col("part") == 0, 1).when(F.col("part") == 1, 0).otherwise(F.col("part"))
    return made.select(F.col("step").alias("turn"), "place", around.alias("around"), F.col("event_part").alias("part"), "seq", "k", "frame")


@query(f"""WITH {DELTAS}, {CALLED}, {LOOP}, texts AS (SELECT step, nullif(coalesce(string_agg(content, '' ORDER BY seq), ''), '') AS content, nullif(coalesce(string_agg(reasoning_content, '' ORDER BY seq), ''), '') AS reasoning_content FROM deltas GROUP BY step)
SELECT turn, place, 0 AS row, 'assistant' AS role, content, reasoning_content, (SELECT count(*) FROM called c WHERE c.step = run.step) AS n_calls, NULL AS tool_call_id, NULL AS name, false AS ephemeral FROM run JOIN texts USING (step) WHERE goes_on
UNION ALL SELECT turn, run.place, c.place + 1, 'tool', output, NULL, NULL, call_id, name, ephemeral FROM run JOIN called c USING (step) WHERE goes_on""")
def turn_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.loop_messages(*_turns_in_order(spark, sf_dir))
    return rows.withColumn("n_calls", F.when(F.col("tool_calls").isNotNull(), F.size("tool_calls")).cast("long")).drop("tool_calls")


def _turns_in_order(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    deltas, run, calls = _turns(spark, sf_dir)
    return run, deltas, calls


@query(f"WITH {EVENTS} SELECT step, seq, CAST(ord AS INT) AS ord, type, delta FROM events_")
def delta_events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream form of delta_events, in three runs from one checkpoint; a step's last fragment is marked."""
    from pyspark.sql import Window

    from ..sources import streams  # brings pandas, which a driver without streams does without
    from ..streaming import answer_events

    deltas = S.deltas(spark, sf_dir)
    marked = deltas.select("step", "seq", "content", "reasoning_content", (F.col("seq") == F.max("seq").over(Window.partitionBy("step"))).alias("last"))
    return streams.run_in_parts(marked, "seq", answer_events.answer_events, answer_events.OUTPUT)


# Tools that run.


def _add(context: dict, a: int, b: int) -> str:
    return f"{context['caller']}: {a + b}"


def _odd(context: dict, a: int, b: int) -> str | None:
    if (a + b) % 2:
        raise ValueError(f"{a + b} is odd")
    return None


TOOLS = [T.Tool("tool0", _add, ephemeral=True), T.Tool("tool1", _odd), T.Tool("hidden", _add, reserved=True)]


@query(f"""WITH {DELTAS}, raw AS (SELECT step, slot, coalesce(arg_max(call_id, seq) FILTER (WHERE call_id <> ''), '') AS call_id FROM deltas WHERE slot IS NOT NULL GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY slot) - 1 AS place FROM raw),
named AS (SELECT *, CASE WHEN slot < 2 THEN 'tool' || slot WHEN step % 2 = 0 THEN 'hidden' ELSE 'tool2' END AS name, CASE WHEN step % 11 = 0 THEN '{{"a":1}}' ELSE '{{"a":' || step || ',"b":' || slot || '}}' END AS input FROM placed),
seen AS (SELECT *, CASE name WHEN 'tool2' THEN false WHEN 'hidden' THEN step % 3 = 0 WHEN 'tool0' THEN step % 4 <> 3 ELSE step % 4 <> 2 END AS visible FROM named)
SELECT step, place, call_id, name, input, CASE WHEN NOT visible THEN '[no tool named ' || name || ']' WHEN step % 11 = 0 THEN '[tool failed] TypeError: ' || CASE name WHEN 'tool1' THEN '_odd' ELSE '_add' END || '() missing 1 required positional argument: ''b'''
 WHEN name = 'tool1' THEN CASE WHEN (step + slot) % 2 = 1 THEN '[tool failed] ValueError: ' || (step + slot) || ' is odd' ELSE '' END ELSE 'user' || step || ': ' || (step + slot) END AS output, name = 'tool0' AS ephemeral FROM seen""")
def tool_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    step, slot = F.col("step"), F.col("slot")
    calls = D.parsed_calls(D.tool_calls(S.deltas(spark, sf_dir))).withColumn("call_name", F.when(slot < 2, F.concat(F.lit("tool"), slot)).when(step % 2 == 0, "hidden").otherwise("tool2"))
    calls = calls.withColumn("input", F.when(step % 11 == 0, F.lit('{"a":1}')).otherwise(F.to_json(F.struct(step.alias("a"), slot.alias("b"))))).withColumn("caller", F.concat(F.lit("user"), step))
    scopes = calls.select("step").distinct().select(
        "step", F.when(step % 3 == 0, F.array(F.lit("hidden"))).alias("exposed"), F.when(step % 4 == 2, F.array(F.lit("tool0"))).alias("allow"), F.when(step % 4 == 3, F.array(F.lit("tool0"))).alias("deny")
    )
    return T.run_tools(T.in_scope(calls, scopes, T.registry(spark, TOOLS)), TOOLS, "caller")


# Search: segmentation and the index.


@query(f"""WITH {MESSAGES}, q AS (SELECT n AS request_id, CASE WHEN n % 5 <> 0 THEN CAST(n AS VARCHAR) END AS session_id, CASE n % 3 WHEN 0 THEN ['the', 'des'] WHEN 1 THEN ['que'] ELSE ['zzzz', 'para'] END AS terms,
  CASE WHEN n % 4 = 1 THEN make_timestamp(1704067201000000) END AS a, CASE WHEN n % 4 = 1 THEN make_timestamp(1704067205000000) END AS b FROM (SELECT DISTINCT conv_id AS n FROM conversations))
SELECT request_id, m.session_id, seq, created_at FROM messages m JOIN q ON q.session_id IS NULL OR q.session_id = m.session_id
WHERE list_has_any({TOKENS}, terms) AND (a IS NULL OR created_at >= a) AND (b IS NULL OR created_at <= b)""")
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests answered from an index that two appends have made; every fifth request is over all sessions."""
    rows = S.messages(spark, sf_dir).withColumn("terms", X.search_tokens(F.col("content")))
    index = search_index.SearchIndex(spark, temporary_folder(spark, "index"))
    index.append(rows.filter("seq % 3 <> 0"), 0)
    index.append(rows.filter("seq % 3 = 0"), 1)
    n = F.col("conv_id")
    keyword = F.when(n % 3 == 0, " The des ").when(n % 3 == 1, "QUE?").otherwise("zzzz para")
    bound = lambda at: F.when(n % 4 == 1, F.timestamp_seconds(F.lit(S.EPOCH + at)))
    requests = S.read(spark, sf_dir, "conversations").select("conv_id").distinct().select(
        n.alias("request_id"), F.when(n % 5 != 0, n.cast("string")).alias("session_id"), X.search_tokens(keyword).alias("terms"), bound(1).alias("start"), bound(5).alias("end")
    )
    return index.search(requests)


@query(ORACLES["search_answers"])
def indexed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """search_answers out of an index."""
    rows = S.messages(spark, sf_dir)
    index = search_index.SearchIndex(spark, temporary_folder(spark, "index"))
    index.append(rows.withColumn("terms", X.search_tokens(F.col("content"))), 0)
    requests = search_asked(spark, sf_dir)
    return R.answered(R.indexed_requests(index, rows, requests, n=2), requests, 2, 400)


def unspaced(text):
    """Letters as characters of a script without blanks, by rule, and no blanks between words of a sentence."""
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéèêçñíóáàôœù"
    return F.regexp_replace(F.translate(F.lower(text), letters, "".join(chr(0x4E00 + 7 * k) for k in range(len(letters)))), " ", "")


@query()
def segmented_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written without blanks, cut by a dictionary of the words that occur in them; enumeration of all paths checks it in the tests."""
    rows = S.messages(spark, sf_dir)
    words = rows.select(F.explode(X.search_tokens(F.col("content"))).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))
    dictionary = words.select(unspaced(F.col("word")).alias("word"), "freq")
    found = W.with_terms(rows.withColumn("content", unspaced(F.col("content"))), dictionary, "session_id", "seq")
    return found.select("session_id", "seq", F.array_join("terms", " ").alias("search_tokens"))


# Memory in two stages.


def _nearness(rows: pa.RecordBatch) -> list[float | None]:
    """1 / (1 + city-block distance); none for every fifth memory."""
    a, b = (np.stack(rows.column(k).to_numpy(zero_copy_only=False)).astype(float) for k in (0, 1))
    scores = 1 / (1 + np.abs(a - b).sum(1))
    return [None if m % 5 == 0 else s for s, m in zip(scores.tolist(), rows.column(2).to_pylist(), strict=True)]


@query("""WITH q AS (SELECT label AS user_id, min(vec_id) AS query_id FROM embeddings GROUP BY label), m AS (SELECT e.vec_id AS memory_id, q.query_id, e.embedding::DOUBLE[] AS a, v.embedding::DOUBLE[] AS b
 FROM embeddings e JOIN q ON q.user_id = e.label JOIN embeddings v ON v.vec_id = q.query_id),
s AS (SELECT *, list_sum(list_transform(list_zip(a, b), lambda x: x[1] * x[2])) / sqrt(list_sum(list_transform(a, lambda x: x * x)) * list_sum(list_transform(b, lambda x: x * x))) AS score FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS recall FROM s),
t AS (SELECT query_id, memory_id, CASE WHEN memory_id % 5 = 0 THEN 0 ELSE 1 / (1 + list_sum(list_transform(list_zip(a, b), lambda x: abs(x[1] - x[2])))) END AS again FROM r WHERE recall <= 10)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY again DESC, memory_id) AS rank, memory_id, round(again, 6) AS rerank_score FROM t WHERE again >= 0.05""")
def memory_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = S.read(spark, sf_dir, "embeddings")
    memories = vectors.select(F.col("label").alias("user_id"), F.col("vec_id").alias("memory_id"), "embedding")
    queries = vectors.groupBy(F.col("label").alias("user_id")).agg(F.min("vec_id").alias("query_id"), F.min_by("embedding", "vec_id").alias("query"))
    found = R.reranked(R.search_memory(memories, queries, 10), _nearness, "embedding", "query", "memory_id", threshold=0.05)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "memory_id", F.round("rerank_score", 6).alias("rerank_score"))


def _letters(texts: list[str]) -> list[list[float]]:
    return [[float(len(t)), float(t.count("e")), float(t.count("a"))] for t in texts]


@query(f"""WITH {MESSAGES} SELECT CAST(session_id AS BIGINT) % 7 AS user_id, role, content, CAST(length(content) AS DOUBLE) AS n_chars, CAST(length(content) - length(replace(content, 'e', '')) AS DOUBLE) AS n_e, CAST(length(content) - length(replace(content, 'a', '')) AS DOUBLE) AS n_a FROM messages""")
def stored_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories with embeddings, added in two batches, the second of them twice."""
    rows = S.messages(spark, sf_dir).withColumn("user_id", F.col("session_id").cast("long") % 7)
    path = temporary_folder(spark, "memories")
    Z.remembered(Z.memory_rows(rows.filter("seq < 3"), _letters), path, 0)
    for _ in range(2):
        Z.remembered(Z.memory_rows(rows.filter("seq >= 3"), _letters), path, 1)
    part = lambda k, name: F.get("embedding", F.lit(k)).alias(name)
    return spark.read.parquet(path).select("user_id", "role", "content", part(0, "n_chars"), part(1, "n_e"), part(2, "n_a"))


# Streams and sinks.

CUT = "2024-01-15 00:00:00"


@query(f"""WITH live AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 1 DAY AS gap FROM events WHERE ts >= TIMESTAMP '{CUT}'),
islands AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM live),
newest AS (SELECT user_id, max(island) AS island, max(ts) AS last FROM islands GROUP BY user_id HAVING (SELECT max(ts) FROM live) - max(ts) < INTERVAL 1 DAY),
own AS (SELECT i.user_id, event_id, ts FROM islands i JOIN newest n ON n.user_id = i.user_id AND n.island = i.island),
begins AS (SELECT user_id, min((ts, event_id)) AS first FROM own GROUP BY user_id),
before AS (SELECT e.user_id, e.event_id, e.ts, row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS r FROM events e JOIN begins b ON b.user_id = e.user_id AND (e.ts, e.event_id) < b.first),
held AS (SELECT * FROM own UNION ALL SELECT user_id, event_id, ts FROM before WHERE r <= 20)
SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS seq, least(total, 50) AS n FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age FROM held) WHERE age <= 50""")
def live_context_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recent messages of the sessions that had one in the last 24 hours; those that were silent as long began again from their stored history."""
    from ..sources import streams

    return streams.live_messages(spark, sf_dir, CUT)


@query("""WITH e AS (SELECT event_id, user_id % 5 AS service, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
pushes AS (SELECT event_id, service, list_sort(list_distinct(['h' || (k % 4)] || CASE WHEN k % 3 = 0 THEN [] ELSE ['h' || (k % 5)] END)) AS known FROM e WHERE event_id % 10 = 0 AND event_id % 30 <> 0),
requests AS (SELECT event_id, service FROM e WHERE event_id % 10 <> 0)
SELECT r.service, r.event_id AS request_id, known[1 + r.event_id % len(known)] AS address, CAST(coalesce(len(known), 0) AS INT) AS n_known
FROM requests r ASOF LEFT JOIN pushes p ON p.service = r.service AND p.event_id <= r.event_id""")
def pushed_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth event is a push, every third of those is empty or holds nothing usable; the others are requests."""
    from ..sources import streams
    from ..streaming import instances

    k = F.get_json_object("props", "$.k").cast("long")
    e = S.read(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 5).alias("service"), k.alias("k"), F.timestamp_seconds(F.col("event_id")).alias("at"))
    host = lambda n, healthy: F.struct(F.concat(F.lit("h"), F.col("k") % n).alias("address"), healthy.alias("healthy"), F.lit(None).cast("boolean").alias("enabled"))
    good = F.array(host(4, F.lit(True)), host(5, F.col("k") % 3 != 0))
    nothing = F.when(F.col("event_id") % 60 == 0, F.array(host(4, F.lit(False)))).otherwise(F.slice(good, 1, 0))
    pushes = e.filter("event_id % 10 = 0").select("service", "at", F.when(F.col("event_id") % 30 == 0, nothing).otherwise(good).alias("instances"))
    rows = instances.pushes_and_requests(pushes, e.filter("event_id % 10 <> 0").select("service", "at", F.col("event_id").alias("request_id"))).withColumn("number", F.unix_seconds("at"))
    return streams.run_in_parts(rows, "number", instances.answered_requests, instances.OUTPUT)


def _short(requests: list[str]) -> list[str | None]:
    """Stands for a model: tells a request's length, and nothing for every fifth length."""
    return ["" if len(r) % 5 == 0 else f"of {len(r)}" for r in requests]


def _round(n: int, rows: str, known: str) -> str:
    """SQL of one batch: texts, requests, new summaries, and the recent rows after it."""
    return f"""w{n} AS (SELECT *, sum(token_count) OVER (PARTITION BY session_id ORDER BY seq DESC ROWS UNBOUNDED PRECEDING) <= 40 AS kept, sum(token_count) OVER (PARTITION BY session_id) >= 64 AS compress FROM {rows}),
t{n} AS (SELECT session_id, string_agg(role || ': ' || coalesce(content, 'None'), chr(10) ORDER BY seq) FILTER (WHERE compress AND NOT kept) AS text, max(created_at) AS made FROM w{n} GROUP BY session_id),
q{n} AS (SELECT t.session_id, t.made, length(coalesce('Summary so far:' || chr(10) || s.summary || chr(10) || chr(10), '') || 'New messages:' || chr(10) || text || chr(10) || chr(10) || 'Write one summary of all of this.') AS n FROM t{n} t LEFT JOIN {known} s USING (session_id) WHERE text IS NOT NULL),
s{n} AS (SELECT session_id, made, 'of ' || n AS summary FROM q{n} WHERE n % 5 <> 0), k{n} AS (SELECT w.* EXCLUDE (kept, compress) FROM w{n} w JOIN s{n} USING (session_id) WHERE kept)"""


@query(f"""WITH {MESSAGES}, first AS (SELECT * FROM messages WHERE seq < 6), none AS (SELECT NULL::VARCHAR AS session_id, NULL::VARCHAR AS summary WHERE false), {_round(0, "first", "none")},
second AS (SELECT * FROM first WHERE session_id NOT IN (SELECT session_id FROM k0) UNION ALL SELECT * FROM k0 UNION ALL SELECT * FROM messages WHERE seq >= 6), {_round(1, "second", "s0")},
latest AS (SELECT session_id, 1 AS batch, made, summary FROM s1 UNION ALL SELECT session_id, 0, made, summary FROM s0 WHERE session_id NOT IN (SELECT session_id FROM s1))
SELECT session_id, summary AS current_summary, made AS summary_updated_at, CASE batch WHEN 1 THEN (SELECT count(*) FROM k1 WHERE k1.session_id = b.session_id) ELSE (SELECT count(*) FROM k0 WHERE k0.session_id = b.session_id) END AS n_recent FROM latest b""")
def compression_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches, the second done again after its marker was lost; the summaries and the number of recent rows that are left."""
    from ..streaming import compression

    rows = S.messages(spark, sf_dir)
    step = compression.Compression(spark, temporary_folder(spark, "compression"), _short, 80)
    first = rows.filter("seq < 6")
    step.step(first, 0)
    second = H.replaced(first, step.recent().select(first.columns)).unionByName(rows.filter("seq >= 6"))
    step.step(second, 1)
    step.forget(1)
    step.step(second, 1)
    counts = step.recent().groupBy("session_id").agg(F.count("*").alias("n"))
    return step.summaries().join(counts, "session_id", "left").select("session_id", "current_summary", "summary_updated_at", F.coalesce("n", F.lit(0)).alias("n_recent"))


BILLED = f"""{AGENT}, {REDACTED}, {COUNTED}, {MODELS}, u AS (SELECT session_id, seq % 2 AS turn, model_id, CAST(sum(token_count) AS BIGINT) AS usage_tokens FROM counted GROUP BY ALL HAVING sum(token_count) > 0)"""


@query(f"""WITH {BILLED} SELECT 'billing' || (CAST(session_id AS BIGINT) % 3) AS topic, '{{"session":"' || session_id || '","tokens":' || usage_tokens || ',"name":"é' || coalesce(model_name, '') || '"}}' AS value FROM u LEFT JOIN models m ON m.model_id = u.model_id""")
def billing_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Billed turns sent to topics and read again."""
    from ..sources import topics

    billed = QUERIES["billing_usage"](spark, sf_dir)
    value = F.to_json(F.struct(F.col("session_id").alias("session"), F.col("usage_tokens").alias("tokens"), F.concat(F.lit("é"), F.coalesce("model_name", F.lit(""))).alias("name")))
    sink = topics.Topics(spark, temporary_folder(spark, "topics"))
    sink.send(billed.select(F.concat(F.lit("billing"), F.col("session_id").cast("long") % 3).alias("topic"), value.alias("value")))
    return sink.read()


@query(f"""WITH {MESSAGES} SELECT session_id, seq, role, content FROM messages""")
def stored_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages appended turn by turn; an append of no rows writes nothing."""
    rows, path = S.messages(spark, sf_dir), temporary_folder(spark, "messages")
    for part in ("seq < 2", "seq < 0", "seq >= 2"):
        Z.appended(rows.filter(part), path)
    return spark.read.parquet(path).select("session_id", "seq", "role", "content")


@query("SELECT p_partkey AS id, p_name AS name, p_size % 10 = 0 AS is_large FROM part WHERE p_partkey % 2 = 1")
def refreshed_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view refreshed four times: with other rows, with none, with a failure, and with these."""
    from ..streaming.hot_context import LatestTable

    part = S.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_size") % 10 == 0).alias("is_large"))
    loads = iter([part, part.filter("id % 2 = 1"), part.limit(0), None])
    view = LatestTable(f"refreshed_{uuid.uuid4().hex}", lambda: next(loads))
    for _ in range(4):
        view.refresh()
    return spark.table(view.view)


# Items that need no mechanism of their own.


@query(r"""SELECT page_id, contains(lower(url), lower('WWW')) AS has_www, CASE WHEN page_id % 4 = 0 THEN 'retry' WHEN page_id % 4 = 1 THEN 'fail' WHEN page_id % 4 = 2 THEN 'ok' ELSE 'fail' END AS outcome,
 CASE WHEN page_id % 3 = 0 THEN '[binary content, 3 bytes]' ELSE url END AS data, CASE WHEN length(url) > 20 THEN 'asset p' || page_id || chr(10) || '---' || chr(10) || substr(url, 1, 20) || chr(10) || '[truncated]' || chr(10) || '---'
 ELSE 'asset p' || page_id || chr(10) || '---' || chr(10) || url || chr(10) || '---' END AS document, CASE WHEN page_id % 5 = 0 THEN 'page' ELSE 'p' || page_id END AS title FROM pages""")
def text_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, url = F.col("page_id"), F.col("url")
    status = F.when(n % 4 == 0, 503).otherwise(200)
    body = F.when(n % 4 == 1, F.lit("<html>")).when(n % 4 == 2, F.lit('{"code": 200}')).otherwise(F.lit('{"code": 7}'))
    data = F.when(n % 3 == 0, F.unhex(F.lit("FF00FE"))).otherwise(F.to_binary(url, F.lit("utf-8")))
    title = X.clean_title(F.when(n % 5 == 0, F.lit(" '\"\" ")).otherwise(F.concat(F.lit("\"p"), n, F.lit("' "))), F.lit("page"))
    return S.read(spark, sf_dir, "pages").select(
        "page_id", X.contains_ignoring_case(url, F.lit("WWW")).alias("has_www"), X.rpc_outcome(status, body).alias("outcome"), X.decoded_utf8(data).alias("data"),
        X.asset_document(F.concat(F.lit("p"), n), F.to_binary(url, F.lit("utf-8")), 20).alias("document"), title.alias("title"),
    )


@query(r"""WITH h AS (SELECT p_partkey, 'name: ' || p_name || chr(10) || 'triggers:' || chr(10) || '  - "' || p_brand || '"' || chr(10) || '  - size ' || p_size || chr(10) AS head FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE head[1:-2] END AS head, CASE p_partkey % 3 WHEN 0 THEN '---' || chr(10) || head WHEN 1 THEN 'body ' || p_partkey ELSE NULL END AS body,
 CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS name, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand || ',size ' || p_size END AS triggers FROM h JOIN part USING (p_partkey)""")
def front_matter_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a closed head, an unclosed one, and a head without a body."""
    n = F.col("p_partkey")
    head = F.format_string('name: %s\ntriggers:\n  - "%s"\n  - size %d\n', "p_name", "p_brand", F.col("p_size").cast("int"))
    whole = F.concat(F.lit("---\n"), head, F.when(n % 3 == 0, "").when(n % 3 == 1, F.concat(F.lit("---\nbody "), n)).otherwise("---"))
    cut = X.front_matter(whole)
    rows = S.read(spark, sf_dir, "part").select("p_partkey", cut["head"].alias("head"), cut["body"].alias("body"))
    return rows.select("p_partkey", "head", F.when(n % 3 == 2, F.nullif("body", F.lit(""))).otherwise(F.col("body")).alias("body"), X.front_value(F.col("head"), "name").alias("name"), F.array_join(X.front_list(F.col("head"), "triggers"), ",").alias("triggers"))


@query("""SELECT s_suppkey AS request_id, CASE WHEN s_suppkey % 5 = 0 THEN 'bad_key' WHEN s_suppkey % 5 = 1 THEN 'not_found' WHEN s_suppkey % 5 = 2 THEN 'stored' ELSE 'local' END AS outcome,
 CASE s_suppkey % 5 WHEN 2 THEN 'far ' || s_name WHEN 3 THEN s_name WHEN 4 THEN s_name END AS text FROM supplier""")
def asset_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets of suppliers, written as files of bundles or kept in a store, and read by their keys."""
    n = F.col("s_suppkey")
    rows = S.read(spark, sf_dir, "supplier").select(n.alias("request_id"), X.object_key(F.concat(F.lit("s"), n % 7), F.lit("1.0"), F.concat(F.lit("references/"), n, F.lit(".md"))).alias("object_key"), F.col("s_name").alias("name"))
    root = temporary_folder(spark, "bundles")
    S.write_assets(rows.filter("request_id % 5 IN (0, 3, 4)").select("object_key", F.to_binary("name", F.lit("utf-8")).alias("data")), root)
    stored = rows.filter("request_id % 5 IN (2, 3)").select("object_key", F.to_binary(F.concat(F.lit("far "), "name"), F.lit("utf-8")).alias("data"))
    asked = F.when(F.col("request_id") % 5 == 0, F.replace("object_key", F.lit("references/"), F.lit("references/../"))).otherwise(F.col("object_key"))
    found = S.read_assets(spark, root, rows.select("request_id", asked.alias("object_key")), stored)
    return found.select("request_id", "outcome", F.decode("data", "utf-8").alias("text"))


@query("""SELECT 's' || (s_suppkey % 7) AS skill_id, '1.0' AS version, 'references/' || s_suppkey || '.md' AS asset_path, 'reference' AS kind, 'skills/s' || (s_suppkey % 7) || '/1.0/references/' || s_suppkey || '.md' AS object_key, octet_length(encode(s_name)) AS size_bytes FROM supplier""")
def bundle_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_suppkey")
    rows = S.read(spark, sf_dir, "supplier").select(X.object_key(F.concat(F.lit("s"), n % 7), F.lit("1.0"), F.concat(F.lit("references/"), n, F.lit(".md"))).alias("object_key"), F.to_binary("s_name", F.lit("utf-8")).alias("data"))
    root = temporary_folder(spark, "bundles")
    S.write_assets(rows, root)
    return S.read_bundles(spark, root)


def _fetched(key: str) -> bytes | None:
    """Stands for an object store."""
    n = int(key.rsplit("/", 1)[1].removesuffix(".md"))
    if n % 7 == 0:
        raise TimeoutError(str(n))
    return None if n % 5 == 0 else f"of {n}".encode()


@query("""WITH k AS (SELECT s_suppkey AS n FROM supplier), b AS (SELECT 1 AS batch, n FROM k WHERE n % 2 = 0 UNION ALL SELECT 2, n FROM k UNION ALL SELECT 3, n FROM k)
SELECT batch, n AS request_id, CASE WHEN n % 11 = 0 THEN 'bad_key' WHEN n % 7 = 0 THEN 'failed' WHEN n % 5 = 0 THEN 'not_found' WHEN batch = 1 OR (batch = 2 AND n % 2 = 1) OR (batch = 3 AND n % 2 = 0) THEN 'fetched' ELSE 'cached' END AS outcome,
 CASE WHEN n % 11 <> 0 AND n % 7 <> 0 AND n % 5 <> 0 THEN 'of ' || n END AS text, CASE WHEN n % 11 <> 0 AND n % 7 = 0 THEN 'TimeoutError: ' || n END AS message FROM b""")
def cached_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches of reads: of even suppliers, of all, and of all after the even ones' files had gone unused."""
    n = F.col("s_suppkey")
    keys = S.read(spark, sf_dir, "supplier").select(n.alias("request_id"), F.when(n % 11 != 0, X.object_key(F.concat(F.lit("s"), n % 7), F.lit("1.0"), F.concat(n, F.lit(".md")))).alias("object_key"))
    cache = asset_cache.AssetCache(spark, temporary_folder(spark, "assets"), _fetched)
    at = lambda hour: datetime(2024, 1, 1, hour, tzinfo=timezone.utc)
    first = cache.read(keys.filter("request_id % 2 = 0"), 1, at(1))
    second = cache.read(keys, 2, at(2))
    cache.read(keys.filter("request_id % 2 = 1"), 9, at(5))
    cache.drop_unused(at(6), 2 * 3600)
    third = cache.read(keys, 3, at(7))
    out = [r.select(F.lit(k).alias("batch"), "request_id", "outcome", F.decode("data", "utf-8").alias("text"), "message") for k, r in enumerate((first, second, third), 1)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT 'p7' AS skill_id, p_name AS display_name FROM part WHERE p_partkey = 7")
def skill_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    skills = S.read(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("skill_id"), F.col("p_name").alias("display_name"))
    return G.skill_by_id(skills, "p7")
