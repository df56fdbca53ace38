"""The operators applied to the driver's tables, each beside SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import deltas as D
from ..operators import finalize as Z
from ..operators import history as H
from ..operators import retrieval as R
from ..operators import routing as G
from ..sources import tables as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


ISO = "CASE WHEN strftime({0}, '%f') = '000000' THEN strftime({0}, '%Y-%m-%dT%H:%M:%S') ELSE strftime({0}, '%Y-%m-%dT%H:%M:%S.%f') END"
MESSAGES = """messages AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS seq, role, text AS content, length(text) // 4 AS token_count,
  make_timestamp((1704067200 + turn) * 1000000) AS created_at FROM conversations)"""
COARSE = MESSAGES.replace("(1704067200 + turn)", "(1704067200 + turn // 2)")
AGENT = """base AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
agent AS (SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS seq,
  CASE event_type WHEN 'view' THEN 'user' WHEN 'purchase' THEN 'tool' WHEN 'error' THEN 'system' ELSE 'assistant' END AS role,
  CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN '' ELSE event_type || ' ' || k END AS content,
  CASE WHEN event_id % 4 = 0 THEN 'r' || k END AS reasoning_content, CASE WHEN event_id % 10 <> 0 THEN k * 3 + 1 END AS token_count,
  event_type = 'click' AS calls, CASE WHEN event_type = 'purchase' THEN 'c' || (k % 5) END AS tool_call_id, CASE WHEN event_id % 2 = 0 THEN 'tool' || (k % 3) END AS name,
  CASE WHEN event_id % 13 <> 0 THEN event_id % 3 = 0 END AS ephemeral, ts AS created_at, k % 4 AS model_id, k, props FROM base)"""
PAGED = """turned AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY created_at RANGE UNBOUNDED PRECEDING) AS k,
  sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id) AS total FROM messages),
paged AS (SELECT *, CAST(floor((total - k) / 2) + 1 AS BIGINT) AS page FROM turned WHERE k >= 1 AND role IN ('user', 'assistant', 'tool'))"""
ISLANDS = """starts AS (SELECT *, CASE WHEN role = 'user' OR coalesce(lag(role) OVER (PARTITION BY {keys} ORDER BY seq) = 'user', true) THEN 1 ELSE 0 END AS s FROM {rows}),
grouped AS (SELECT *, CAST(sum(s) OVER (PARTITION BY {keys} ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS group_no FROM starts)"""


def _history_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = H.turn_pages(S.messages(spark, sf_dir), 2)
    return H.message_parts(H.islands(pages, "page"), "page")


@query(f"""WITH {MESSAGES}, {PAGED}, {ISLANDS.format(keys="session_id, page", rows="paged")}
SELECT session_id, page, group_no, seq, role, CAST(0 AS BIGINT) AS kind, 'step-start' AS type, NULL AS text FROM grouped WHERE role = 'assistant'
UNION ALL SELECT session_id, page, group_no, seq, role, 3, 'text', content FROM grouped WHERE role IN ('user', 'assistant') AND content <> ''""")
def history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history_parts(spark, sf_dir).select("session_id", "page", "group_no", "seq", "role", "kind", "type", "text")


@query(f"""WITH {COARSE}, {PAGED} SELECT session_id, seq, page, CAST(total AS BIGINT) AS turns, CAST(ceil(total / 2) AS BIGINT) AS pages FROM paged""")
def turn_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = H.turn_pages(S.messages(spark, sf_dir, turns_per_tick=2), 2)
    return rows.select("session_id", "seq", "page", "turns", H.page_count(F.col("turns"), 2).alias("pages"))


@query(f"""WITH {AGENT}, {ISLANDS.format(keys="session_id", rows="agent")},
results AS (SELECT session_id, group_no, tool_call_id, arg_max(coalesce(content, ''), seq) AS output FROM grouped WHERE role = 'tool' GROUP BY ALL),
firsts AS (SELECT session_id, group_no, min(seq) AS seq FROM grouped GROUP BY ALL), opened AS (SELECT session_id, group_no, g.created_at AS first_at FROM grouped g JOIN firsts USING (session_id, group_no, seq)),
parts AS (SELECT session_id, group_no, seq, role, 0 AS kind, 0 AS pos, 'step-start' AS type, NULL AS state, NULL AS text, NULL AS tool_call_id, NULL AS input FROM grouped WHERE role = 'assistant'
 UNION ALL SELECT session_id, group_no, seq, role, 1, 0, 'reasoning', 'done', reasoning_content, NULL, NULL FROM grouped WHERE role = 'assistant' AND reasoning_content <> ''
 UNION ALL SELECT session_id, group_no, seq, role, 2, i, 'tool-tool' || (k % 3), 'output-available', NULL, 'c' || ((k + i) % 5), CASE WHEN seq % 6 = 0 THEN '{{}}' ELSE replace(props, ' ', '') END FROM grouped, range(2) t(i) WHERE calls AND role = 'assistant'
 UNION ALL SELECT session_id, group_no, seq, role, 3, 0, 'text', 'done', content, NULL, NULL FROM grouped WHERE role IN ('user', 'assistant') AND content <> '')
SELECT p.session_id, p.group_no, p.seq, p.role, CAST(p.kind AS BIGINT) AS kind, CAST(p.pos AS BIGINT) AS pos, p.type, p.state, p.text, p.tool_call_id, p.input, a.first_at,
 CASE WHEN p.kind = 2 THEN coalesce(r.output, '') END AS output
FROM parts p JOIN opened a ON a.session_id = p.session_id AND a.group_no = p.group_no LEFT JOIN results r ON r.session_id = p.session_id AND r.group_no = p.group_no AND r.tool_call_id = p.tool_call_id""")
def ui_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.message_parts(H.islands(S.agent_messages(spark, sf_dir)))


@query(f"""WITH {AGENT}, {ISLANDS.format(keys="session_id", rows="agent")},
firsts AS (SELECT session_id, group_no, min(seq) AS seq FROM grouped GROUP BY ALL), opened AS (SELECT session_id, group_no, g.created_at AS first_at FROM grouped g JOIN firsts USING (session_id, group_no, seq)),
parts AS (SELECT session_id, group_no, seq, role FROM grouped WHERE role = 'assistant' OR (role = 'user' AND content <> ''))
SELECT session_id, group_no, max(seq) AS id, min(role) AS role, {ISO.format("min(first_at)")} AS created_at, CAST(sum(CASE WHEN g.role = 'user' THEN 1 ELSE 1 + CAST(coalesce(g.reasoning_content <> '', false) AS INT) + 2 * CAST(g.calls AS INT) + CAST(coalesce(g.content <> '', false) AS INT) END) AS BIGINT) AS n_parts
FROM parts p JOIN grouped g USING (session_id, group_no, seq, role) JOIN opened USING (session_id, group_no) GROUP BY session_id, group_no""")
def ui_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = H.message_parts(H.islands(S.agent_messages(spark, sf_dir)))
    return H.ui_messages(parts).select("session_id", "group_no", "id", "role", "created_at", F.size("parts").cast("long").alias("n_parts"))


@query(f"""WITH {MESSAGES} SELECT session_id, seq, sum(token_count) OVER (PARTITION BY session_id ORDER BY seq DESC ROWS UNBOUNDED PRECEDING) <= 150 AS kept,
 sum(token_count) OVER (PARTITION BY session_id) >= 240 AS compress FROM messages""")
def token_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.token_window(S.messages(spark, sf_dir), 300).select("session_id", "seq", "kept", "compress")


@query(f"""WITH {MESSAGES}, w AS (SELECT *, sum(token_count) OVER (PARTITION BY session_id ORDER BY seq DESC ROWS UNBOUNDED PRECEDING) <= 150 AS kept,
 sum(token_count) OVER (PARTITION BY session_id) >= 240 AS compress FROM messages)
SELECT session_id, string_agg(role || ': ' || coalesce(content, 'None'), chr(10) ORDER BY seq) AS text FROM w WHERE compress AND NOT kept GROUP BY session_id""")
def compression_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.compression_text(H.token_window(S.messages(spark, sf_dir), 300))


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("conv_id")
    return S.read(spark, sf_dir, "conversations").select("conv_id").distinct().select(
        n.cast("string").alias("session_id"), (n % 7).alias("user_id"), F.when(n % 3 == 0, F.timestamp_seconds(F.lit(S.EPOCH) + n % 5)).alias("summary_updated_at"),
        F.when(n % 3 == 0, F.concat(F.lit("summary "), n)).alias("current_summary"), F.concat(F.lit("chat "), n).alias("title"), (n % 4 == 0).alias("is_pinned"),
        F.when(n % 4 == 0, F.timestamp_seconds(F.lit(S.EPOCH))).alias("pinned_at"), F.timestamp_seconds(F.lit(S.EPOCH)).alias("created_at"), F.timestamp_seconds(F.lit(S.EPOCH) + n).alias("updated_at"),
    )


SESSIONS = """sessions AS (SELECT CAST(n AS VARCHAR) AS session_id, n % 7 AS user_id, CASE WHEN n % 3 = 0 THEN make_timestamp((1704067200 + n % 5) * 1000000) END AS summary_updated_at,
 CASE WHEN n % 3 = 0 THEN 'summary ' || n END AS current_summary, 'chat ' || n AS title, n % 4 = 0 AS is_pinned, CASE WHEN n % 4 = 0 THEN make_timestamp(1704067200000000) END AS pinned_at, make_timestamp(1704067200000000) AS created_at,
 make_timestamp((1704067200 + n) * 1000000) AS updated_at FROM (SELECT DISTINCT conv_id AS n FROM conversations))"""


@query(f"""WITH {MESSAGES}, {SESSIONS}, r AS (SELECT m.session_id, m.seq, row_number() OVER (PARTITION BY m.session_id ORDER BY m.created_at, seq) AS rank
 FROM messages m LEFT JOIN (SELECT * FROM sessions WHERE user_id <> 4) s USING (session_id) WHERE s.summary_updated_at IS NULL OR m.created_at > s.summary_updated_at)
SELECT session_id, seq, rank FROM r WHERE rank <= 3""")
def history_since_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _sessions(spark, sf_dir).filter("user_id <> 4")  # the messages of other sessions have no session row
    rows = H.history_since_summary(S.messages(spark, sf_dir), known, 3)
    return rows.select("session_id", "seq", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {MESSAGES}, {SESSIONS}, r AS (SELECT m.*, row_number() OVER (PARTITION BY session_id ORDER BY m.created_at, seq) AS rank FROM messages m JOIN sessions s USING (session_id) WHERE m.created_at > s.summary_updated_at)
SELECT session_id, seq, role, content FROM r WHERE rank <= 4""")
def history_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = _sessions(spark, sf_dir).select("session_id", F.col("summary_updated_at").alias("after"))
    return H.history_after(S.messages(spark, sf_dir), bounds, 4).select("session_id", "seq", "role", "content")


@query("""SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS seq, age FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age FROM events) WHERE age <= 50""")
def hot_context_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.last_rows(S.agent_messages(spark, sf_dir), 50).select("session_id", "seq", F.col("age").cast("long").alias("age"))


@query(f"""WITH {MESSAGES} SELECT session_id, count(*) FILTER (WHERE role = 'user') AS turns, count(*) AS n_rows, min(created_at) AS first_at FROM messages GROUP BY session_id""")
def turn_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.messages(spark, sf_dir).groupBy("session_id").agg(F.count_if(F.col("role") == "user").alias("turns"), F.count("*").alias("n_rows"), F.min("created_at").alias("first_at"))


@query(f"""WITH {SESSIONS} SELECT user_id, session_id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY is_pinned DESC, pinned_at DESC NULLS LAST, updated_at DESC, session_id) AS place FROM sessions) WHERE place > 5 AND place <= 10""")
def session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.session_page(_sessions(spark, sf_dir), None, 2, 5).select("user_id", "session_id", F.col("place").cast("long").alias("place"))


TOKENS = "list_filter(regexp_split_to_array(lower(content), '[^\\p{L}\\p{N}]+'), lambda t: length(t) > 1)"


@query(f"""WITH {MESSAGES}, hits AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at, seq) AS rank FROM messages WHERE list_has_any({TOKENS}, ['the', 'des']))
SELECT session_id, seq, rank FROM hits WHERE rank <= 10""")
def history_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_hits(R.search(S.messages(spark, sf_dir), "The x des!")).select("session_id", "seq", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {MESSAGES}, hits AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at, seq) AS rank FROM messages WHERE list_has_any({TOKENS}, ['the', 'des'])),
joined AS (SELECT session_id, string_agg('[' || role || '] (' || strftime(created_at, '%Y-%m-%dT%H:%M:%S') || '): ' || content, chr(10) ORDER BY created_at, seq) AS text FROM hits WHERE rank <= 10 GROUP BY session_id)
SELECT session_id, CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || chr(10) || '[truncated]' ELSE text END AS text FROM joined""")
def rendered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rendered(R.first_hits(R.search(S.messages(spark, sf_dir), "the des")), 400)


SKILLS = """skills AS (SELECT * FROM (VALUES ('alpha', ['the', 'Tion', '', 'the'], '1.0', true), ('beta', ['es', 'de la'], '0.9.0', true), ('beta', ['es'], '0.10.0', true),
 ('gamma', ['zzz'], '2', true), ('delta', ['ing'], '1', false), ('omega', ['HE', 'an'], '1', true)) t(skill_id, triggers, version, enabled))"""


@query(f"""WITH {SKILLS}, t AS (SELECT skill_id, unnest(triggers) AS t FROM skills WHERE enabled),
hits AS (SELECT doc_id AS query_id, skill_id, count(*) AS hits FROM documents JOIN t ON t <> '' AND contains(lower(text), lower(t)) GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, skill_id) AS rank FROM hits) WHERE rank <= 2""")
def skill_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = S.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), "text")
    return R.match_skills(queries, S.skills(spark)).withColumn("rank", F.col("rank").cast("long"))


@query("""WITH q AS (SELECT label AS user_id, min(vec_id) AS query_id FROM embeddings GROUP BY label), m AS (SELECT e.vec_id AS memory_id, q.query_id, e.embedding::DOUBLE[] AS a, v.embedding::DOUBLE[] AS b
 FROM embeddings e JOIN q ON q.user_id = e.label JOIN embeddings v ON v.vec_id = q.query_id),
s AS (SELECT query_id, memory_id, list_sum(list_transform(list_zip(a, b), lambda x: x[1] * x[2])) / sqrt(list_sum(list_transform(a, lambda x: x * x)) * list_sum(list_transform(b, lambda x: x * x))) AS score FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM s)
SELECT query_id, rank, memory_id, round(score, 6) AS score FROM r WHERE rank <= 10 AND score >= 0.3""")
def memory_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = S.read(spark, sf_dir, "embeddings")
    memories = vectors.select(F.col("label").alias("user_id"), F.col("vec_id").alias("memory_id"), "embedding")
    queries = vectors.groupBy(F.col("label").alias("user_id")).agg(F.min("vec_id").alias("query_id"), F.min_by("embedding", "vec_id").alias("query"))
    found = R.search_memory(memories, queries, 10, 0.3)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "memory_id", F.round("score", 6).alias("score"))


def _models(spark: SparkSession) -> DataFrame:
    rows = [(0, "m0", 1, 1, True), (1, "m1", 2, 5, True), (2, "m2", None, 2, True), (5, "m5", 1, 1, False)]
    return spark.createDataFrame(rows, "model_id int, model_name string, type int, billing_ratio int, is_active boolean").coalesce(1)


MODELS = "models AS (SELECT * FROM (VALUES (0, 'm0', 1, 1, true), (1, 'm1', 2, 5, true), (2, 'm2', NULL, 2, true), (5, 'm5', 1, 1, false)) t(model_id, model_name, type, billing_ratio, is_active))"
REDACTED = """redacted AS (SELECT * EXCLUDE (content, ephemeral), CASE WHEN ephemeral AND role = 'tool' THEN '[output of ' || coalesce(name, 'unknown') || ' omitted]' ELSE content END AS content,
 coalesce(ephemeral, false) AND role = 'tool' AS ephemeral FROM agent WHERE NOT (coalesce(ephemeral, false) AND role = 'assistant'))"""
COUNTED = "counted AS (SELECT * EXCLUDE (token_count), CASE WHEN content IS NULL THEN 0 ELSE coalesce(token_count, length(content) // 4) END AS token_count FROM redacted)"


@query(f"WITH {AGENT}, {REDACTED}, {COUNTED} SELECT session_id, seq, role, content, ephemeral, token_count FROM counted")
def redact_ephemeral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.with_tokens(Z.redacted(S.agent_messages(spark, sf_dir))).select("session_id", "seq", "role", "content", "ephemeral", "token_count")


@query(f"""WITH {AGENT}, {REDACTED}, {COUNTED}, {MODELS}, u AS (SELECT session_id, seq % 2 AS turn, model_id, CAST(sum(token_count) AS BIGINT) AS usage_tokens FROM counted GROUP BY ALL HAVING sum(token_count) > 0)
SELECT session_id, turn, CAST(u.model_id AS INT) AS model_id, usage_tokens, model_name, coalesce(type, 3) AS type, coalesce(billing_ratio, 1) AS billing_ratio FROM u LEFT JOIN models m ON m.model_id = u.model_id""")
def billing_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session has two turns: its even and its odd rows."""
    stored = Z.with_tokens(Z.redacted(S.agent_messages(spark, sf_dir))).withColumn("turn", F.col("seq") % 2)
    return Z.usage(stored, _models(spark)).select("session_id", "turn", "model_id", "usage_tokens", "model_name", "type", "billing_ratio")


@query(f"""WITH {AGENT}, {REDACTED}, {COUNTED}, {MODELS}, u AS (SELECT session_id, seq % 2 AS turn, model_id, CAST(sum(token_count) AS BIGINT) AS usage_tokens FROM counted GROUP BY ALL HAVING sum(token_count) > 0)
SELECT 'trace' || session_id || '-' || turn AS trace_id, '{{"userId":"u' || session_id || '","groupId":' || CASE WHEN CAST(session_id AS BIGINT) % 2 = 0 THEN '"g1"' ELSE 'null' END || ',"usageTokens":' || usage_tokens
 || ',"billingRatio":' || coalesce(billing_ratio, 1) || ',"traceId":"trace' || session_id || '-' || turn || '","modelName":' || coalesce('"' || model_name || '"', 'null') || ',"modelType":' || coalesce(type, 3)
 || ',"requestTime":"2024-01-01T00:00:0' || turn || '"}}' AS value FROM u LEFT JOIN models m ON m.model_id = u.model_id""")
def billing_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, turn = F.col("session_id"), F.col("turn")
    turns = S.agent_messages(spark, sf_dir).select("session_id", (F.col("seq") % 2).alias("turn")).distinct().select(
        s, turn, F.concat(F.lit("u"), s).alias("user_id"), F.when(s.cast("long") % 2 == 0, "g1").alias("group_id"), F.concat(F.lit("trace"), s, F.lit("-"), turn).alias("trace_id"), F.timestamp_seconds(F.lit(S.EPOCH) + turn).alias("requested_at")
    )
    return Z.billing_events(billing_usage(spark, sf_dir), turns)


@query(rf"""WITH {MESSAGES} SELECT session_id, seq, CASE WHEN content <> '' THEN array_to_string({TOKENS}, ' ') END AS search_tokens FROM messages""")
def search_token_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.with_search_tokens(S.messages(spark, sf_dir)).select("session_id", "seq", "search_tokens")


def _catalogue(spark: SparkSession) -> DataFrame:
    return G.model_catalogue(_models(spark), 1)


@query(f"WITH {MODELS}, {AGENT} SELECT CAST(m.model_id AS INT) AS model_id, CASE type WHEN 1 THEN 'standard' WHEN 2 THEN 'advanced' ELSE 'other' END AS kind, m.model_id = 1 AS is_default, count(a.seq) AS n_messages FROM models m LEFT JOIN agent a ON a.model_id = m.model_id WHERE is_active GROUP BY ALL")
def model_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = S.agent_messages(spark, sf_dir).groupBy("model_id").agg(F.count("*").alias("n"))
    return _catalogue(spark).join(used, "model_id", "left").select("model_id", "kind", "is_default", F.coalesce("n", F.lit(0)).alias("n_messages"))


@query("""WITH m AS (SELECT DISTINCT l_partkey AS model_id, l_suppkey AS provider_id, l_suppkey % 3 = 0 AS is_preferred FROM lineitem),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY is_preferred DESC, provider_id) AS r FROM m) WHERE r = 1)
SELECT c.model_id, c.provider_id, CASE WHEN s_suppkey IS NULL THEN 'missing_provider' WHEN s_acctbal <= 0 THEN 'inactive_provider' ELSE 'ok' END AS status
FROM c LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 10 <> 9) s ON s_suppkey = provider_id""")
def provider_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    mappings = S.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("model_id"), F.col("l_suppkey").alias("provider_id"), (F.col("l_suppkey") % 3 == 0).alias("is_preferred")).distinct()
    providers = S.read(spark, sf_dir, "supplier").filter("s_suppkey % 10 <> 9").select(F.col("s_suppkey").alias("provider_id"), (F.col("s_acctbal") > 0).alias("is_active"))
    return G.route(mappings, providers).select("model_id", "provider_id", "status")


@query("""WITH t AS (SELECT event_id, 'tool' || (event_id % 5) AS name, event_id % 2 = 0 AS reserved, CASE WHEN event_id % 7 = 0 THEN NULL ELSE ['tool1', 'tool2'] END AS exposed,
 CASE WHEN event_id % 3 = 0 THEN ['tool' || (event_id % 4)] END AS allow, CASE WHEN event_id % 5 <> 1 THEN ['tool3', 'tool' || (event_id % 3)] END AS deny FROM events)
SELECT event_id, name, CASE WHEN reserved THEN coalesce(list_contains(exposed, name), false) ELSE (allow IS NULL AND deny IS NULL) OR coalesce(list_contains(allow, name), false) OR coalesce(NOT list_contains(deny, name), false) END AS visible FROM t""")
def tool_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, tool = F.col("event_id"), lambda n: F.concat(F.lit("tool"), F.col("event_id") % n)
    tools = S.read(spark, sf_dir, "events").select(
        "event_id", tool(5).alias("name"), (e % 2 == 0).alias("reserved"), F.when(e % 7 != 0, F.array(F.lit("tool1"), F.lit("tool2"))).alias("exposed"),
        F.when(e % 3 == 0, F.array(tool(4))).alias("allow"), F.when(e % 5 != 1, F.array(F.lit("tool3"), tool(3))).alias("deny"),
    )
    return G.visible_tools(tools).select("event_id", "name", "visible")


def _instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return S.read(spark, sf_dir, "supplier").select(
        (k % 3).alias("service"), F.concat(F.lit("10.0.0."), k, F.lit(":80")).alias("address"), F.when(k % 4 == 0, None).otherwise((k % 5).cast("double")).alias("weight"),
        F.when(k % 6 != 0, k % 11 != 0).alias("healthy"), F.when(k % 9 != 0, k % 13 != 0).alias("enabled"),
    )


INSTANCES = """instances AS (SELECT s_suppkey % 3 AS service, '10.0.0.' || s_suppkey || ':80' AS address, CASE WHEN s_suppkey % 4 <> 0 THEN CAST(s_suppkey % 5 AS DOUBLE) END AS weight FROM supplier
 WHERE NOT (s_suppkey % 6 <> 0 AND s_suppkey % 11 = 0) AND NOT (s_suppkey % 9 <> 0 AND s_suppkey % 13 = 0) AND s_suppkey % 17 <> 5)"""


def _untried(spark: SparkSession, sf_dir: str) -> DataFrame:
    tried = S.read(spark, sf_dir, "supplier").filter("s_suppkey % 17 = 5").select(F.concat(F.lit("10.0.0."), "s_suppkey", F.lit(":80")).alias("address"))
    return G.usable_instances(_instances(spark, sf_dir), tried)


@query(f"""WITH {INSTANCES}, w AS (SELECT service, address, greatest(coalesce(weight, 1), 0) AS w FROM instances), t AS (SELECT *, sum(w) OVER (PARTITION BY service) AS t FROM w),
e AS (SELECT service, address, CASE WHEN t > 0 THEN w ELSE 1 END AS w FROM t),
s AS (SELECT service, address, w, sum(w) OVER (PARTITION BY service ORDER BY address ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY service) AS total FROM e)
SELECT o_orderkey AS request_id, s.service, address FROM orders JOIN s ON s.service = o_orderkey % 3 WHERE (o_orderkey * 37 % 1000) / 1000.0 >= (run - w) / total AND (o_orderkey * 37 % 1000) / 1000.0 < run / total""")
def weighted_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    requests = S.read(spark, sf_dir, "orders").select(key.alias("request_id"), (key % 3).alias("service"), (key * 37 % 1000 / 1000.0).alias("draw"))
    return G.pick_weighted(_untried(spark, sf_dir), requests)


@query(f"""WITH {INSTANCES}, n AS (SELECT service, address, row_number() OVER (PARTITION BY service ORDER BY address) - 1 AS place, count(*) OVER (PARTITION BY service) AS n FROM instances),
q AS (SELECT o_orderkey, o_orderkey % 3 AS service, row_number() OVER (PARTITION BY o_orderkey % 3 ORDER BY o_orderkey) - 1 AS turn FROM orders)
SELECT q.o_orderkey AS request_id, n.service, n.address FROM q JOIN n ON n.service = q.service AND n.place = q.turn % n.n""")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = S.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), (F.col("o_orderkey") % 3).alias("service"))
    return G.pick_in_turn(_untried(spark, sf_dir), requests)


@query("""WITH m AS (SELECT p_partkey % 50 AS skill_id, 'references/' || p_name AS path, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_brand END AS object_key FROM part QUALIFY row_number() OVER (PARTITION BY p_partkey % 50, p_name ORDER BY p_partkey) = 1),
q AS (SELECT p_partkey AS request_id, p_partkey % 50 AS skill_id, CASE WHEN p_partkey % 4 = 0 THEN 'x' ELSE 'references/' || p_name END AS path FROM part),
p AS (SELECT skill_id, string_agg(path, ', ' ORDER BY path) AS paths FROM m GROUP BY ALL)
SELECT request_id, CASE WHEN m.path IS NULL THEN 'unknown_path' WHEN object_key = '' THEN 'no_key' ELSE 'ok' END AS outcome, nullif(object_key, '') AS object_key,
 CASE WHEN m.path IS NULL THEN 'no such path; there are: ' || coalesce(paths, 'none') WHEN object_key = '' THEN 'the path has no object' END AS message FROM q LEFT JOIN m USING (skill_id, path) LEFT JOIN p USING (skill_id)""")
def manifest_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, skill, path = S.read(spark, sf_dir, "part"), F.col("p_partkey") % 50, F.concat(F.lit("references/"), "p_name")
    manifests = part.groupBy(skill.alias("skill_id"), path.alias("path")).agg(F.min_by(F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_brand")), "p_partkey").alias("object_key"))
    requests = part.select(F.col("p_partkey").alias("request_id"), skill.alias("skill_id"), F.when(F.col("p_partkey") % 4 == 0, "x").otherwise(path).alias("path"))
    return G.manifest_lookup(requests, manifests)


DELTAS = """d AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), deltas AS (SELECT user_id AS step, event_id AS seq,
 CASE WHEN event_type IN ('click', 'error') THEN 'r' || k END AS reasoning_content, CASE WHEN event_type IN ('purchase', 'view') AND user_id % 3 <> 0 THEN 't' || k WHEN event_type = 'signup' THEN '' END AS content,
 CASE WHEN event_type = 'signup' THEN k % 3 END AS slot, CASE WHEN event_id % 5 = 0 THEN 'id' || k ELSE '' END AS call_id, 'n' || (k % 2) AS call_name, 'a' || k AS call_arguments,
 CASE WHEN event_id % 97 = 0 THEN 'tool_calls' WHEN event_id % 89 = 0 THEN '' END AS finish_reason FROM d)"""


@query(f"""WITH {DELTAS} SELECT step, coalesce(string_agg(content, '' ORDER BY seq), '') AS content, coalesce(string_agg(reasoning_content, '' ORDER BY seq), '') AS reasoning,
 coalesce(arg_max(finish_reason, seq) FILTER (WHERE finish_reason <> ''), 'stop') AS finish_reason FROM deltas GROUP BY step""")
def delta_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.answers(S.deltas(spark, sf_dir))


@query(f"""WITH {DELTAS} SELECT step, slot, coalesce(arg_max(call_id, seq) FILTER (WHERE call_id <> ''), '') AS call_id, string_agg(call_name, '' ORDER BY seq) AS call_name,
 string_agg(call_arguments, '' ORDER BY seq) AS call_arguments FROM deltas WHERE slot IS NOT NULL GROUP BY ALL""")
def delta_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.tool_calls(S.deltas(spark, sf_dir))


EVENTS = f"""{DELTAS}, f AS (SELECT *, min(CASE WHEN content <> '' THEN seq END) OVER (PARTITION BY step) AS fc FROM deltas), p AS (SELECT *, coalesce(seq > fc, false) AS phase FROM f),
r AS (SELECT *, min(CASE WHEN reasoning_content <> '' THEN seq END) OVER (PARTITION BY step, phase) AS first, bool_or(coalesce(reasoning_content <> '', false) AND NOT phase) OVER (PARTITION BY step) AS early FROM p),
events_ AS (SELECT step, seq, 0 AS ord, 'reasoning-start' AS type, NULL AS delta FROM r WHERE reasoning_content <> '' AND seq = first
UNION ALL SELECT step, seq, 1, 'reasoning-delta', reasoning_content FROM r WHERE reasoning_content <> ''
UNION ALL SELECT step, seq, 2, 'reasoning-end', NULL FROM r WHERE seq = fc AND early
UNION ALL SELECT step, seq, 3, 'text-start', NULL FROM r WHERE seq = fc
UNION ALL SELECT step, seq, 4, 'text-delta', content FROM r WHERE content <> ''
UNION ALL SELECT step, NULL, 5, 'reasoning-end', NULL FROM r GROUP BY step HAVING bool_or(coalesce(reasoning_content <> '', false) AND phase) OR (max(fc) IS NULL AND bool_or(coalesce(reasoning_content <> '', false)))
UNION ALL SELECT step, NULL, 6, 'text-end', NULL FROM r GROUP BY step HAVING max(fc) IS NOT NULL)"""
CALLS = f"""{DELTAS}, raw AS (SELECT step, slot, coalesce(arg_max(call_id, seq) FILTER (WHERE call_id <> ''), '') AS call_id FROM deltas WHERE slot IS NOT NULL GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY slot) - 1 AS place FROM raw),
called AS (SELECT step, place, call_id, 'tool' || slot AS name, '{{}}' AS input, CASE WHEN slot = 2 THEN '[no tool named tool2]' WHEN step % 4 = 3 THEN '' WHEN (step + place) % 3 = 0 THEN '[tool failed] ValueError: no' ELSE 'out ' || place END AS output, slot = 0 AS ephemeral FROM placed)"""


@query(f"WITH {EVENTS} SELECT step, seq, ord, type, delta FROM events_")
def delta_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.events(S.deltas(spark, sf_dir))


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.col("step")
    outcome = F.when(step % 5 == 1, "cancelled").when(step % 5 == 2, "failed").otherwise("ok")
    return S.deltas(spark, sf_dir).select("step").distinct().select("step", outcome.alias("outcome"), F.when(step % 5 == 2, F.concat(F.lit('broken "'), step, F.lit('"'))).alias("message"))


@query(f"""WITH {EVENTS}, steps AS (SELECT DISTINCT step FROM deltas), lines AS (SELECT step, 1 AS part, seq, CAST(ord AS INT) AS ord, '{{"type":"' || type || '","id":"' || step || '"' || CASE WHEN delta IS NULL THEN '' ELSE ',"delta":' || to_json(delta) END || '}}' AS body FROM events_
 UNION ALL SELECT step, 0, NULL, NULL, '{{"type":"start","messageId":"msg_' || step || '"}}' FROM steps
 UNION ALL SELECT step, 2, NULL, NULL, CASE step % 5 WHEN 1 THEN '{{"type":"abort","reason":"user_cancelled"}}' WHEN 2 THEN '{{"type":"error","errorText":' || to_json('broken "' || step || '"') || '}}' ELSE '{{"type":"finish"}}' END FROM steps
 UNION ALL SELECT step, 3, NULL, NULL, '[DONE]' FROM steps)
SELECT step, part, seq, ord, 'data: ' || body || chr(10) || chr(10) AS frame FROM lines""")
def sse_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = D.events(S.deltas(spark, sf_dir)).withColumn("id", F.col("step").cast("string"))
    return D.frames(events, ["seq", "ord"], _outcomes(spark, sf_dir))


def _call_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = D.parsed_calls(D.tool_calls(S.deltas(spark, sf_dir)).withColumn("call_name", F.concat(F.lit("tool"), "slot")))
    step, place = F.col("step"), F.col("place")
    results = calls.filter(step % 4 != 3).select("step", "place", F.concat(F.lit("out "), place).alias("output"), F.when((step + place) % 3 == 0, F.lit("ValueError: no")).alias("error"))
    tools = spark.createDataFrame([("tool0", True), ("tool1", False)], "name string, ephemeral boolean").coalesce(1)
    return D.call_results(calls, results, tools)


@query(f"""WITH {CALLS} SELECT step, place, call_id, name, input, output, ephemeral FROM called""")
def tool_call_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _call_rows(spark, sf_dir)


@query(f"""WITH {CALLS} SELECT step, 0 AS phase, place, 0 AS k, 'data: {{"type":"tool-input-start","toolCallId":"' || call_id || '","toolName":"' || name || '"}}' || chr(10) || chr(10) AS frame FROM called
UNION ALL SELECT step, 0, place, 1, 'data: {{"type":"tool-input-available","toolCallId":"' || call_id || '","toolName":"' || name || '","input":' || input || '}}' || chr(10) || chr(10) FROM called
UNION ALL SELECT step, 1, place, 0, 'data: {{"type":"tool-output-available","toolCallId":"' || call_id || '","output":"' || output || '"}}' || chr(10) || chr(10) FROM called""")
def tool_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = D.tool_events(_call_rows(spark, sf_dir))
    return D.frames(events, ["phase", "place", "k"], events.select("step", F.lit("ok").alias("outcome"), F.lit(None).cast("string").alias("message")).distinct()).filter("part = 1").select("step", "phase", "place", "k", "frame")


@query(f"""WITH {MESSAGES}, {SESSIONS}, w AS (SELECT *, sum(token_count) OVER (PARTITION BY session_id ORDER BY seq DESC ROWS UNBOUNDED PRECEDING) <= 150 AS kept FROM messages)
SELECT session_id, 0 AS section, 0 AS place, 'system' AS role, 'You are a helpful assistant.' || CASE WHEN user_id = 3 THEN chr(10) || 'Known facts:' || chr(10) || '* likes tea' || chr(10) || '* is ' || session_id ELSE '' END AS content FROM sessions
UNION ALL SELECT session_id, 1, 0, 'system', 'Earlier: ' || current_summary FROM sessions WHERE current_summary <> ''
UNION ALL SELECT session_id, 2, 0, 'system', 'Skills that may help; load one by its id if it is needed:' || chr(10) || '* "alpha": about ' || title || chr(10) || '* "beta": ' FROM sessions WHERE user_id = 1
UNION ALL SELECT session_id, 3, row_number() OVER (PARTITION BY session_id ORDER BY kept DESC, seq), role, content FROM w
UNION ALL SELECT session_id, 4, 0, 'system', 'State of the interface:' || chr(10) || 'page = ' || session_id FROM sessions WHERE user_id <> 2
UNION ALL SELECT session_id, 5, 0, 'user', 'question ' || session_id FROM sessions""")
def prompt_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = _sessions(spark, sf_dir)
    skill = lambda skill_id, said: F.struct(F.lit(skill_id).alias("skill_id"), said.alias("description"))
    both = F.array(skill("alpha", F.concat(F.lit("about "), "title")), skill("beta", F.lit(None).cast("string")))
    matched = sessions.select("session_id", F.when(F.col("user_id") == 1, both).when(F.col("user_id") == 2, F.array().cast("array<struct<skill_id string, description string>>")).alias("skills"))
    state = lambda key, value, disabled: F.struct(F.lit(key).alias("key"), value.alias("value"), disabled.alias("disabled"))
    states = F.array(state("page", F.col("session_id"), F.col("user_id") == 2), state("none", F.lit(""), F.lit(None).cast("boolean")), state("off", F.lit("x"), F.lit(True)))
    facts = F.when(F.col("user_id") == 3, F.array(F.lit("likes tea"), F.concat(F.lit("is "), "session_id")))
    queries = sessions.select("session_id", F.concat(F.lit("question "), "session_id").alias("query"), facts.alias("facts"), states.alias("states"))
    return Z.prompt(S.messages(spark, sf_dir), sessions, matched, queries, 300)


@query(f"""WITH {SESSIONS}, c AS (SELECT CAST(n AS VARCHAR) AS session_id, n % 7 + CAST(n % 11 = 0 AS INT) AS user_id, CASE WHEN n % 2 = 0 THEN 'new ' || n END AS t, CASE WHEN n % 5 = 0 THEN n % 10 = 0 END AS p, CASE WHEN n % 6 = 1 THEN 's' || n END AS s, make_timestamp(1704168000000000) AS at FROM (SELECT DISTINCT conv_id AS n FROM conversations))
SELECT x.session_id, x.user_id, coalesce(c.t, title) AS title, coalesce(c.p, is_pinned) AS is_pinned, CASE WHEN c.p THEN c.at WHEN c.p IS NULL THEN pinned_at END AS pinned_at,
 CASE WHEN c.t IS NOT NULL OR c.p IS NOT NULL THEN c.at ELSE updated_at END AS updated_at, coalesce(c.s, current_summary) AS current_summary, CASE WHEN c.s IS NOT NULL THEN c.at ELSE summary_updated_at END AS summary_updated_at
FROM sessions x LEFT JOIN c ON c.session_id = x.session_id AND c.user_id = x.user_id WHERE NOT (x.user_id = 3 AND CAST(x.session_id AS BIGINT) % 5 = 0)""")
def session_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, sessions = F.col("session_id").cast("long"), _sessions(spark, sf_dir)
    changes = sessions.select(
        "session_id", (n % 7 + (n % 11 == 0).cast("long")).alias("user_id"), F.when(n % 2 == 0, F.concat(F.lit("new "), n)).alias("title"), F.when(n % 5 == 0, n % 10 == 0).alias("is_pinned"),
        F.when(n % 6 == 1, F.concat(F.lit("s"), n)).alias("summary"), F.timestamp_seconds(F.lit(1704168000)).alias("at"),
    )
    gone = sessions.filter((n % 5 == 0)).select("session_id", F.lit(3).cast("long").alias("user_id"))
    return Z.without(Z.updated_sessions(sessions, changes), gone, "session_id", "user_id")


@query("""WITH e AS (SELECT 'p' || p_partkey AS skill_id, '1' AS version, p_partkey AS created, p_partkey AS updated FROM part WHERE p_partkey % 3 <> 0),
b AS (SELECT 'p' || l_partkey AS skill_id, '0.' || l_linenumber || '.' || (l_suppkey % 12) AS version FROM lineitem WHERE l_partkey % 2 = 0), last AS (SELECT skill_id, max(version) AS version FROM b GROUP BY skill_id)
SELECT skill_id, coalesce(l.version, e.version) AS version, coalesce(created, 0) AS created_at, CASE WHEN l.version IS NULL THEN updated ELSE 0 END AS updated_at FROM e FULL JOIN last l USING (skill_id)""")
def skill_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("p"), "p_partkey").alias("skill_id")
    existing = S.read(spark, sf_dir, "part").filter("p_partkey % 3 <> 0").select(key, F.lit("1").alias("version"), F.col("p_partkey").alias("created_at"), F.col("p_partkey").alias("updated_at"))
    bundles = S.read(spark, sf_dir, "lineitem").filter("l_partkey % 2 = 0").select(F.concat(F.lit("p"), "l_partkey").alias("skill_id"), F.concat(F.lit("0."), "l_linenumber", F.lit("."), F.col("l_suppkey") % 12).alias("version"), F.lit(0).cast("long").alias("at")).distinct()
    return Z.upserted_skills(existing, bundles)


@query(r"""WITH k AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/]+/?(.*)$', 1) AS path FROM pages)
SELECT page_id, 'skills/s' || (page_id % 9) || '/1.' || (page_id % 4) || '/' || path AS object_key, regexp_extract('skills/s' || (page_id % 9) || '/1.' || (page_id % 4) || '/' || path, '^skills/([^/]+)/([^/]+)/(.+)$', 3) AS parsed_path,
 CASE split_part(path, '/', 1) WHEN 'references' THEN 'reference' WHEN 'templates' THEN 'template' WHEN 'scripts' THEN 'script' WHEN 'examples' THEN 'example' ELSE 'other' END AS kind,
 path <> '' AND NOT starts_with(path, '/') AND NOT contains(path, '\') AND NOT list_contains(string_split(path, '/'), '..') AS safe, sha1(url) || '.asset' AS cache_name,
 CASE WHEN contains(path, '/') THEN path ELSE 'openai/' || path END AS model_name, CASE WHEN path = '' THEN 'New Chat' ELSE path END AS title, CASE WHEN page_id * 1000 >= 50000 THEN 500 ELSE 200 END AS status FROM k""")
def object_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, path = F.col("page_id"), F.regexp_extract("url", "^[a-z]+://[^/]+/?(.*)$", 1)
    key = X.object_key(F.concat(F.lit("s"), n % 9), F.concat(F.lit("1."), n % 4), path)
    return S.read(spark, sf_dir, "pages").select(
        "page_id", key.alias("object_key"), F.coalesce(X.parsed_key(key)["path"], F.lit("")).alias("parsed_path"), X.asset_kind(path).alias("kind"), X.safe_path(path).alias("safe"), X.cache_name(F.col("url")).alias("cache_name"),
        X.model_name(path).alias("model_name"), X.or_default(path, "New Chat").alias("title"), X.http_status(n * 1000).alias("status"),
    )


@query("""SELECT event_id, CASE WHEN event_id % 6 = 0 OR event_id % 6 = 1 THEN '{}' ELSE props END AS arguments, CASE event_id % 5 WHEN 0 THEN 'OWNER' WHEN 1 THEN 'ADMIN' WHEN 2 THEN 'MEMBER' WHEN 3 THEN 'NOT_MEMBER' ELSE 'NOT_MEMBER' END AS role FROM
 (SELECT event_id, replace(props, ' ', '') AS props FROM events)""")
def tool_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    raw = F.when(e % 6 == 0, F.lit("{broken")).when(e % 6 == 1, F.lit("")).otherwise(F.col("props"))
    roles = F.when(e % 5 == 3, F.lit("not json")).otherwise(F.concat(F.lit('{"g1": '), e % 5, F.lit("}")))
    group = F.when(e % 5 == 4, "g2").otherwise("g1")
    return S.read(spark, sf_dir, "events").select("event_id", X.tool_arguments(raw).alias("arguments"), X.group_role(roles, group).alias("role"))


@query("""WITH r AS (SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN 'yesterday' WHEN event_id % 3 = 1 THEN '2024-01-05T00:00:00' END AS s, CASE WHEN event_id % 4 = 0 THEN 'soon' ELSE '2024-01-20T12:00:00' END AS e FROM events),
p AS (SELECT *, s IS NULL OR try_cast(s AS TIMESTAMP) IS NOT NULL AS good FROM r)
SELECT event_id FROM p WHERE (NOT good OR s IS NULL OR ts >= try_cast(s AS TIMESTAMP)) AND (NOT good OR try_cast(e AS TIMESTAMP) IS NULL OR ts <= try_cast(e AS TIMESTAMP))""")
def parsed_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    start, end = X.parsed_range(F.when(e % 3 == 0, "yesterday").when(e % 3 == 1, "2024-01-05T00:00:00"), F.when(e % 4 == 0, "soon").otherwise("2024-01-20T12:00:00"))
    rows = S.read(spark, sf_dir, "events").withColumn("start", start).withColumn("end", end)
    return rows.filter("(start IS NULL OR ts >= start) AND (end IS NULL OR ts <= end)").select("event_id")


@query("""SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS seq, least(50, total) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age, count(*) OVER (PARTITION BY user_id) AS total FROM events) WHERE age <= 50""")
def hot_context_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream form of hot_context_last_n: events as a file stream, the last state of each session."""
    from ..sources.streams import recent_messages

    return recent_messages(spark, sf_dir)


def _skill_rows(spark: SparkSession) -> DataFrame:
    """The skills with bodies and assets."""
    asset = lambda path, size, said: F.struct(F.lit(path).alias("path"), X.asset_kind(F.lit(path)).alias("kind"), F.lit(size).cast("long").alias("size_bytes"), F.lit(said).cast("string").alias("description"))
    body = F.concat(F.lit("# "), "display_name", F.lit("\ndo it\n\n"))
    assets = F.when(F.col("skill_id") == "beta", F.array(asset("references/a.md", 7, "notes"), asset("x.txt", 0, None)))
    return S.skills(spark).withColumn("skill_md", F.regexp_replace(body, r"\n+$", "")).withColumn("assets", assets)


DOCUMENTS = SKILLS + """, documents_ AS (SELECT skill_id, version, enabled, 'skill ' || skill_id || ', version ' || version || chr(10) || 'name: ' || upper(skill_id[1]) || skill_id[2:] || chr(10) || chr(10) || '--- body ---' || chr(10) || '# '
 || upper(skill_id[1]) || skill_id[2:] || chr(10) || 'do it' || chr(10) || '--- end ---' || CASE WHEN skill_id = 'beta' THEN chr(10) || chr(10) || 'assets:' || chr(10) || '* references/a.md (reference, 7 bytes): notes' || chr(10) || '* x.txt (other, 0 bytes): ' ELSE '' END AS document FROM skills)"""


@query("""WITH a AS (SELECT l_partkey, string_agg('* references/' || l_orderkey || '-' || l_linenumber || '.md (reference, ' || CAST(l_quantity AS BIGINT) || ' bytes): ' || CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag ELSE '' END, chr(10) ORDER BY 'references/' || l_orderkey || '-' || l_linenumber || '.md', CAST(l_quantity AS BIGINT), l_returnflag) AS lines FROM lineitem GROUP BY ALL)
SELECT 'p' || p_partkey AS skill_id, '1.' || p_size AS version, 'skill p' || p_partkey || ', version 1.' || p_size || chr(10) || 'name: ' || p_name || chr(10) || chr(10) || '--- body ---' || chr(10) || '# ' || p_brand || chr(10) || 'do it' || chr(10) || '--- end ---'
 || coalesce(chr(10) || chr(10) || 'assets:' || chr(10) || lines, '') AS document FROM part LEFT JOIN a ON l_partkey = p_partkey""")
def skill_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as skills, their line items as assets."""
    path = F.concat(F.lit("references/"), "l_orderkey", F.lit("-"), "l_linenumber", F.lit(".md"))
    asset = F.struct(path.alias("path"), X.asset_kind(path).alias("kind"), F.col("l_quantity").cast("long").alias("size_bytes"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).alias("description"))
    assets = S.read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.array_sort(F.collect_list(asset)).alias("assets"))
    skills = S.read(spark, sf_dir, "part").join(assets, "p_partkey", "left").select(
        F.concat(F.lit("p"), "p_partkey").alias("skill_id"), F.concat(F.lit("1."), "p_size").alias("version"), F.col("p_name").alias("display_name"), F.format_string("# %s\ndo it", "p_brand").alias("skill_md"), "assets"
    )
    return skills.select("skill_id", "version", X.skill_document().alias("document"))


@query(f"""WITH {DOCUMENTS}, q AS (SELECT event_id AS request_id, CASE event_id % 6 WHEN 0 THEN ' alpha ' WHEN 1 THEN 'gamma' WHEN 2 THEN 'lost' WHEN 3 THEN '' WHEN 4 THEN NULL ELSE 'beta' END AS asked, event_id % 4 = 0 AS bare FROM events)
SELECT request_id, trim(coalesce(asked, '')) AS skill_id, CASE WHEN trim(coalesce(asked, '')) = '' THEN 'a skill id is needed' WHEN bare THEN 'not allowed now; allowed: none' WHEN trim(asked) = 'gamma' THEN 'not allowed now; allowed: alpha, beta, lost'
 WHEN document IS NULL THEN 'no such skill' ELSE document END AS text FROM q LEFT JOIN (SELECT * FROM documents_ WHERE version <> '0.9.0') d ON d.skill_id = trim(asked)""")
def loaded_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    asked = F.when(e % 6 == 0, " alpha ").when(e % 6 == 1, "gamma").when(e % 6 == 2, "lost").when(e % 6 == 3, "").when(e % 6 == 5, "beta")
    requests = S.read(spark, sf_dir, "events").select(e.alias("request_id"), asked.alias("skill_id"), F.when(e % 4 != 0, F.array(F.lit("lost"), F.lit("beta"), F.lit("alpha"))).alias("allowed"))
    return G.loaded_skills(requests, _skill_rows(spark).filter("version <> '0.9.0'"))


@query(f"""WITH {SESSIONS} SELECT session_id AS id, user_id, title, {ISO.format("created_at")} AS created_at, {ISO.format("updated_at")} AS updated_at FROM sessions""")
def session_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.session_rows(_sessions(spark, sf_dir))


@query(f"""WITH {SESSIONS} SELECT user_id, count(*) AS total, CAST(ceil(count(*) / 4) AS BIGINT) AS pages FROM sessions GROUP BY user_id""")
def session_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.session_totals(_sessions(spark, sf_dir), 4)


@query(f"""WITH {SESSIONS}, q AS (SELECT o_orderkey AS request_id, CAST(o_orderkey % 130 AS VARCHAR) AS session_id, o_custkey % 7 AS user_id FROM orders)
SELECT request_id, CASE WHEN title IS NULL THEN 40001 ELSE 200 END AS code, title FROM q LEFT JOIN sessions USING (session_id, user_id)""")
def owned_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    requests = S.read(spark, sf_dir, "orders").select(key.alias("request_id"), (key % 130).cast("string").alias("session_id"), (F.col("o_custkey") % 7).alias("user_id"))
    return H.owned_sessions(requests, _sessions(spark, sf_dir))


@query(f"""WITH {MESSAGES}, {SESSIONS}, hot AS (SELECT * FROM messages WHERE CAST(session_id AS BIGINT) % 3 <> 0 AND seq >= 2),
r AS (SELECT m.*, row_number() OVER (PARTITION BY m.session_id ORDER BY m.created_at, seq) AS rank FROM messages m LEFT JOIN sessions s USING (session_id)
 WHERE m.session_id NOT IN (SELECT session_id FROM hot) AND (s.summary_updated_at IS NULL OR m.created_at > s.summary_updated_at))
SELECT session_id, seq, content FROM hot UNION ALL SELECT session_id, seq, content FROM r WHERE rank <= 3""")
def hot_context_refill(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = S.messages(spark, sf_dir)
    hot = stored.filter((F.col("session_id").cast("long") % 3 != 0) & (F.col("seq") >= 2))
    return H.repopulated(hot, stored, _sessions(spark, sf_dir), 3).select("session_id", "seq", "content")


@query(f"""WITH {MESSAGES} SELECT session_id, seq, role, content, token_count, created_at FROM messages""")
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages through the JSON form that a list of recent rows keeps, and back."""
    rows = S.messages(spark, sf_dir)
    return H.from_json(H.as_json(rows), rows.schema.simpleString())


@query(f"""WITH {MESSAGES}, q AS (SELECT n AS request_id, CAST(n AS VARCHAR) AS session_id, CASE n % 3 WHEN 0 THEN ['the', 'des'] WHEN 1 THEN ['que'] ELSE ['zzzz'] END AS terms,
  CASE WHEN n % 4 = 1 THEN make_timestamp(1704067201000000) END AS a, CASE WHEN n % 4 = 1 THEN make_timestamp(1704067205000000) END AS b FROM (SELECT DISTINCT conv_id AS n FROM conversations)),
hits AS (SELECT q.request_id, m.*, row_number() OVER (PARTITION BY q.request_id ORDER BY created_at, seq) AS rank FROM messages m JOIN q USING (session_id)
 WHERE list_has_any({TOKENS}, terms) AND (a IS NULL OR created_at >= a) AND (b IS NULL OR created_at <= b)),
joined AS (SELECT request_id, string_agg('[' || role || '] (' || strftime(created_at, '%Y-%m-%dT%H:%M:%S') || '): ' || content, chr(10) ORDER BY created_at, seq) AS text FROM hits WHERE rank <= 2 GROUP BY request_id)
SELECT request_id, CASE WHEN text IS NULL THEN 'no messages found' WHEN length(text) > 400 THEN substr(text, 1, 400) || chr(10) || '[truncated]' ELSE text END AS text FROM q LEFT JOIN joined USING (request_id)""")
def search_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = search_asked(spark, sf_dir)
    return R.answered(R.search_requests(S.messages(spark, sf_dir), requests), requests, 2, 400)


def search_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request of each session."""
    n = F.col("conv_id")
    keyword = F.when(n % 3 == 0, " The des ").when(n % 3 == 1, "QUE?").otherwise("zzzz")
    start, end = F.when(n % 4 == 1, "2024-01-01T00:00:01").when(n % 4 == 2, "never"), F.when(n % 4 == 1, "2024-01-01T00:00:05").when(n % 4 == 2, "2024-01-01T00:00:00")
    return S.read(spark, sf_dir, "conversations").select("conv_id").distinct().select(n.alias("request_id"), n.cast("string").alias("session_id"), keyword.alias("keyword"), start.alias("start"), end.alias("end"))


@query("""SELECT p_partkey AS id, p_name AS name, p_size % 4 AS type, p_size AS ratio, CASE p_size % 4 WHEN 1 THEN 'standard' WHEN 2 THEN 'advanced' ELSE 'other' END AS kind, p_partkey = 1 AS is_default FROM part WHERE p_brand <> 'Brand#11'""")
def model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as models."""
    models = S.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("model_id"), F.col("p_name").alias("model_name"), (F.col("p_size") % 4).alias("type"), F.col("p_size").alias("billing_ratio"), (F.col("p_brand") != "Brand#11").alias("is_active"))
    return G.model_rows(models, 1)


@query("""WITH t AS (SELECT 't' || (p_partkey % 40) AS name, p_partkey AS seq, p_partkey % 6 = 0 AS late FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY late DESC, seq DESC) AS rank FROM t),
f AS (SELECT name, CAST(min(late) AS INT) AS place_late, coalesce(min(seq) FILTER (WHERE NOT late), min(seq)) AS place_seq FROM t GROUP BY name) SELECT name, seq, place_late, place_seq FROM r JOIN f USING (name) WHERE rank = 1""")
def overlaid_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    tools = S.read(spark, sf_dir, "part").select(key.alias("seq"), F.concat(F.lit("t"), key % 40).alias("name"))
    return G.overlaid_tools(tools.filter("seq % 6 <> 0"), tools.filter("seq % 6 = 0")).select("name", "seq", "place_late", "place_seq")


@query(f"""WITH {AGENT} SELECT session_id, seq, '{{"role":"' || role || '","content":' || CASE WHEN content IS NULL THEN 'null' ELSE '"' || content || '"' END || CASE WHEN calls THEN ',"n":2' ELSE '' END
 || CASE WHEN tool_call_id IS NULL THEN '' ELSE ',"tool_call_id":"' || tool_call_id || '"' END || CASE WHEN name IS NULL THEN '' ELSE ',"name":"' || name || '"' END || '}}' AS value FROM agent""")
def message_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages for a model's interface; the calls, whose own form `tool_frames` shows, are replaced by their number."""
    rows = S.agent_messages(spark, sf_dir)
    made = X.message_json(F.col("role"), F.col("content"), F.col("tool_calls"), F.col("tool_call_id"), F.col("name"))
    return rows.select("session_id", "seq", F.regexp_replace(made, r'"tool_calls":\[\{.*?\}\]', '"n":2').alias("value"))


@query(f"""WITH {MESSAGES}, {SESSIONS}, w AS (SELECT *, sum(token_count) OVER (PARTITION BY session_id ORDER BY seq DESC ROWS UNBOUNDED PRECEDING) <= 150 AS kept,
 sum(token_count) OVER (PARTITION BY session_id) >= 240 AS compress FROM messages),
t AS (SELECT session_id, string_agg(role || ': ' || coalesce(content, 'None'), chr(10) ORDER BY seq) AS text FROM w WHERE compress AND NOT kept GROUP BY session_id)
SELECT session_id, CASE WHEN current_summary IS NULL THEN '' ELSE 'Summary so far:' || chr(10) || current_summary || chr(10) || chr(10) END || 'New messages:' || chr(10) || text || chr(10) || chr(10) || 'Write one summary of all of this.' AS request
FROM t LEFT JOIN sessions USING (session_id)""")
def summary_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = H.compression_text(H.token_window(S.messages(spark, sf_dir), 300))
    asked = texts.join(_sessions(spark, sf_dir).select("session_id", "current_summary"), "session_id", "left")
    return asked.select("session_id", X.summary_request(F.col("text"), F.col("current_summary")).alias("request"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 1 THEN 'STUDENT' WHEN 2 THEN 'TEACHER' WHEN 3 THEN 'ADMIN' END AS identity, ts < make_timestamp(1705276800000000) - INTERVAL 86400 SECOND AS expired,
 CASE WHEN event_id % 3 = 0 THEN 'Name' WHEN event_id % 3 = 1 THEN 'Other' ELSE 's' || event_id END AS display_name, event_id % 2 = 0 AS enabled, '1.' || (event_id % 4) AS version FROM events""")
def file_and_bundle_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    head = F.concat(F.when(e % 3 == 0, "display_name: Name\nname: Other\n").when(e % 3 == 1, "name: 'Other'\n").otherwise("x: y\n"), F.when(e % 4 == 0, "enabled: true\n").when(e % 2 == 1, "enabled: False\n").otherwise(""), F.lit("version: 9\n"))
    made = X.skill_metadata(F.concat(F.lit("s"), e), F.concat(F.lit("1."), e % 4), head)
    old = X.expired(F.col("ts"), F.timestamp_seconds(F.lit(1705276800)), 86400)
    return S.read(spark, sf_dir, "events").select("event_id", X.identity((e % 5).cast("int")).alias("identity"), old.alias("expired"), made["display_name"].alias("display_name"), made["enabled"].alias("enabled"), made["version"].alias("version"))


@query("""SELECT CAST(c_nationkey AS BIGINT) AS user_id, CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END AS memory, '{}' AS metadata FROM customer""")
def memory_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.memory_items(_memories(spark, sf_dir))


def _memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return S.read(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("user_id"), key.alias("memory_id"), F.when(key % 4 != 0, F.col("c_name")).alias("memory"), F.lit(None).cast("string").alias("metadata"))


@query("""SELECT o_orderkey AS request_id, o_custkey + 20 AS memory_id, o_orderkey % 25 AS user_id, CASE WHEN c_custkey IS NULL THEN 'absent' WHEN c_nationkey = o_orderkey % 25 THEN 'deleted' ELSE 'refused' END AS outcome
 FROM orders LEFT JOIN customer ON c_custkey = o_custkey + 20""")
def memory_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = S.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), (F.col("o_custkey") + 20).alias("memory_id"), (F.col("o_orderkey") % 25).alias("user_id"))
    return Z.memory_deletions(requests, _memories(spark, sf_dir))


from . import turn_queries  # noqa: E402,F401  registers its queries
