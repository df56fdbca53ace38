"""History reads, paging, windows and UI messages over a messages table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import iso_time, tool_arguments

VISIBLE = ("user", "assistant", "tool")


def by_session(*order: Column | str) -> Window:
    return Window.partitionBy("session_id").orderBy(*order)


def history(messages: DataFrame, session_id: str | None = None, after: Column | None = None, until: Column | None = None, limit: int | None = None, recent: bool = False) -> DataFrame:
    """A session's rows in order of time, oldest first; `after` is strict.  With `recent` the newest rows are kept instead of the oldest."""
    rows = messages if session_id is None else messages.filter(F.col("session_id") == session_id)
    if after is not None:
        rows = rows.filter(F.col("created_at") > after)
    if until is not None:
        rows = rows.filter(F.col("created_at") <= until)
    if limit is None:
        return rows.orderBy("created_at", "seq")
    if recent:
        rows = rows.orderBy(F.desc("created_at"), F.desc("seq")).limit(limit)
        return rows.orderBy("created_at", "seq")
    return rows.orderBy("created_at", "seq").limit(limit)


def history_since_summary(messages: DataFrame, sessions: DataFrame, limit: int = 20) -> DataFrame:
    """Per session the oldest `limit` rows, of those after its summary where it has one; a session that isn't known has none."""
    joined = messages.join(sessions.select("session_id", "summary_updated_at"), "session_id", "left").filter("summary_updated_at IS NULL OR created_at > summary_updated_at")
    return joined.withColumn("rank", F.row_number().over(by_session("created_at", "seq"))).filter(F.col("rank") <= limit).drop("summary_updated_at")


def history_after(messages: DataFrame, bounds: DataFrame, limit: int = 50) -> DataFrame:
    """Of each session in bounds (session_id, after) its oldest `limit` rows later than `after`."""
    later = messages.join(bounds, "session_id").filter("created_at > after").drop("after")
    return later.withColumn("rank", F.row_number().over(by_session("created_at", "seq"))).filter(F.col("rank") <= limit)


def last_rows(messages: DataFrame, n: int = 50) -> DataFrame:
    """The newest n rows of every session."""
    return messages.withColumn("age", F.row_number().over(by_session(F.desc("created_at"), F.desc("seq")))).filter(F.col("age") <= n)


def turn_pages(messages: DataFrame, size: int) -> DataFrame:
    """Visible rows with their page of `size` turns, 1 being the newest; rows at one time share a page, rows before the first user row have none."""
    own = Window.partitionBy("session_id")
    user = (F.col("role") == "user").cast("long")
    turn = F.sum(user).over(own.orderBy("created_at").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    rows = messages.withColumn("__turn", turn).withColumn("turns", F.sum(user).over(own))
    return (
        rows.filter((F.col("__turn") >= 1) & F.col("role").isin(*VISIBLE))
        .withColumn("page", (F.floor((F.col("turns") - F.col("__turn")) / size) + 1).cast("long")).drop("__turn")
    )


def page_count(total: Column, size: int) -> Column:
    return F.ceil(total / size).cast("long") if size else F.lit(0).cast("long")


def token_window(messages: DataFrame, limit: int = 128_000, low: float = 0.5, high: float = 0.8) -> DataFrame:
    """kept: within the newest low * limit tokens; compress: the session holds high * limit tokens or more.  Null counts are 0."""
    tokens = F.coalesce("token_count", F.lit(0))
    newest = by_session(F.desc("seq")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return messages.withColumn("kept", F.sum(tokens).over(newest) <= int(limit * low)).withColumn("compress", F.sum(tokens).over(Window.partitionBy("session_id")) >= int(limit * high))


def compression_text(windowed: DataFrame) -> DataFrame:
    """Per session that needs it: the rows that are not kept, as lines of text."""
    line = F.concat(F.col("role"), F.lit(": "), F.coalesce("content", F.lit("None")))
    lines = F.array_sort(F.collect_list(F.struct("seq", line.alias("line"))))
    return windowed.filter("compress AND NOT kept").groupBy("session_id").agg(F.array_join(F.transform(lines, lambda s: s["line"]), "\n").alias("text"))


def islands(messages: DataFrame, *keys: str) -> DataFrame:
    """group_no: every user row is a group of its own, and so is each run of other rows."""
    order = Window.partitionBy("session_id", *keys).orderBy("seq")
    starts = (F.col("role") == "user") | F.coalesce(F.lag("role").over(order) == "user", F.lit(True))
    return messages.withColumn("__start", starts.cast("long")).withColumn("group_no", F.sum("__start").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__start")


def _part(kind: int, type_: str, state: str | None = None, pos: Column | None = None, text: Column | None = None, call: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(kind).cast("long").alias("kind"), (F.lit(0) if pos is None else pos).cast("long").alias("pos"), (F.lit(type_) if call is None else F.concat(F.lit(type_ + "-"), F.coalesce(call["name"], F.lit("unknown")))).alias("type"), F.lit(state).cast("string").alias("state"), (none if text is None else text).alias("text"),
        (none if call is None else F.coalesce(call["id"], F.lit(""))).alias("tool_call_id"), (none if call is None else tool_arguments(call["arguments"])).alias("input"),
    )


def message_parts(grouped: DataFrame, *keys: str) -> DataFrame:
    """One row for each UI part of rows with a group_no: steps, reasoning, tool calls with their last result, and texts, in order (seq, kind, pos).

    A call's arguments that are not JSON become {}.  first_at is the time of the group's first row.
    """
    content = F.col("content")
    said = F.when(F.coalesce(content, F.lit("")) != "", F.array(_part(3, "text", "done", text=content)))
    empty = F.array().cast(said_type := "array<struct<kind bigint,pos bigint,type string,state string,text string,tool_call_id string,input string>>")
    said = F.coalesce(said, empty)
    calls, reasoning = empty, empty
    if "tool_calls" in grouped.columns:
        calls = F.coalesce(F.transform("tool_calls", lambda c, i: _part(2, "tool", "output-available", pos=i, call=c)), empty)
    if "reasoning_content" in grouped.columns:
        reasoning = F.coalesce(F.when(F.col("reasoning_content") != "", F.array(_part(1, "reasoning", "done", text=F.col("reasoning_content")))), empty)
    step = F.array(_part(0, "step-start")).cast(said_type)
    parts = F.when(F.col("role") == "user", said).when(F.col("role") == "assistant", F.concat(step, reasoning, calls, said))
    group = ["session_id", *keys, "group_no"]
    timed = grouped.withColumn("first_at", F.first("created_at").over(Window.partitionBy(*group).orderBy("seq")))
    rows = timed.select(*group, "seq", "role", "first_at", F.explode(parts).alias("p")).select(*group, "seq", "role", "first_at", "p.*")
    if "tool_call_id" not in grouped.columns:
        return rows.withColumn("output", F.lit(None).cast("string"))
    results = grouped.filter("role = 'tool' AND tool_call_id IS NOT NULL").groupBy(*group, "tool_call_id").agg(F.max_by(F.coalesce("content", F.lit("")), "seq").alias("output"))
    joined = rows.join(results, [*group, "tool_call_id"], "left")
    return joined.withColumn("output", F.when(F.col("kind") == 2, F.coalesce("output", F.lit(""))))


def ui_messages(parts: DataFrame, *keys: str) -> DataFrame:
    """One row for each UI message, its parts as an ordered array; the id is the last row's seq."""
    part = F.struct("seq", "kind", "pos", "type", "state", "text", "tool_call_id", "input", "output")
    return parts.groupBy("session_id", *keys, "group_no").agg(
        F.max("seq").alias("id"), F.first("role").alias("role"), iso_time(F.min("first_at")).alias("created_at"), F.array_sort(F.collect_list(part)).alias("parts")
    )


def session_rows(sessions: DataFrame) -> DataFrame:
    """Sessions as an interface shows them: texts only, times in ISO form, "" for a null id."""
    return sessions.select(F.coalesce("session_id", F.lit("")).alias("id"), "user_id", "title", iso_time(F.col("created_at")).alias("created_at"), iso_time(F.col("updated_at")).alias("updated_at"))


def session_totals(sessions: DataFrame, size: int) -> DataFrame:
    """Per user the number of sessions and of pages of `size`."""
    return sessions.groupBy("user_id").agg(F.count("*").alias("total")).withColumn("pages", page_count(F.col("total"), size))


def owned_sessions(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """requests (request_id, session_id, user_id): code 200 and the title of the user's own session; 40001 for one that is missing or another's, alike."""
    found = requests.join(sessions.select("session_id", "user_id", "title", F.lit(True).alias("__owned")), ["session_id", "user_id"], "left")
    return found.select("request_id", F.when(F.col("__owned"), 200).otherwise(40001).alias("code"), "title")


def replaced(hot: DataFrame, fresh: DataFrame) -> DataFrame:
    """Recent rows with all those of the sessions in `fresh` replaced; sessions without fresh rows keep theirs, and nothing is trimmed."""
    return hot.join(fresh.select("session_id").distinct(), "session_id", "left_anti").unionByName(fresh)


def repopulated(hot: DataFrame, messages: DataFrame, sessions: DataFrame, limit: int = 20) -> DataFrame:
    """Recent rows; sessions that have none get their stored history since the summary instead."""
    cold = messages.join(hot.select("session_id").distinct(), "session_id", "left_anti")
    return replaced(hot, history_since_summary(cold, sessions, limit).select(hot.columns))


def as_json(messages: DataFrame) -> DataFrame:
    """Rows as JSON beside their session, nulls written out, without the row's id."""
    return messages.select("session_id", "seq", F.to_json(F.struct(*(c for c in messages.columns if c != "id")), {"ignoreNullFields": "false"}).alias("value"))


def from_json(rows: DataFrame, schema: str) -> DataFrame:
    return rows.select(F.from_json("value", schema).alias("v")).select("v.*")


def session_page(sessions: DataFrame, user_id: int | None, page: int, size: int) -> DataFrame:
    """Pinned sessions first, by time of pinning, then by time of change; ties by id."""
    rows = sessions if user_id is None else sessions.filter(F.col("user_id") == user_id)
    order = Window.partitionBy("user_id").orderBy(F.desc("is_pinned"), F.desc_nulls_last("pinned_at"), F.desc("updated_at"), "session_id")
    ranked = rows.withColumn("place", F.row_number().over(order))
    return ranked.filter((F.col("place") > (page - 1) * size) & (F.col("place") <= page * size))
