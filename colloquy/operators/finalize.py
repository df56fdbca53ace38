"""What happens to a turn's rows before and after they are stored."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import estimated_tokens, iso_time, search_tokens


def redacted(messages: DataFrame, placeholder: str = "[output of %s omitted]") -> DataFrame:
    """Ephemeral assistant rows go; ephemeral tool rows keep a placeholder; other ephemeral rows lose the flag."""
    flagged = F.coalesce("ephemeral", F.lit(False))  # a missing flag is none
    kept = messages.filter(~(flagged & (F.col("role") == "assistant")))
    tool = flagged & (F.col("role") == "tool")
    content = F.when(tool, F.format_string(placeholder, F.coalesce("name", F.lit("unknown")))).otherwise(F.col("content"))
    return kept.withColumn("content", content).withColumn("ephemeral", tool)


def with_tokens(messages: DataFrame) -> DataFrame:
    """Counts where they are missing; 0 for null contents even where a count is given."""
    return messages.withColumn("token_count", F.when(F.col("content").isNull(), F.lit(0)).otherwise(F.coalesce("token_count", estimated_tokens(F.col("content")))).cast("long"))


def with_search_tokens(messages: DataFrame, dictionary: DataFrame | None = None, *keys: str) -> DataFrame:
    """search_tokens: the tokens of a content, joined by blanks, by the dictionary (word, freq) where one is given; null for no content."""
    if dictionary is None:
        return messages.withColumn("search_tokens", F.when(F.col("content") != "", F.array_join(search_tokens(F.col("content")), " ")))
    from .segmentation import with_terms

    cut = with_terms(messages, dictionary, *keys, out_col="search_tokens")
    return cut.withColumn("search_tokens", F.when(F.col("content") != "", F.array_join("search_tokens", " ")))


def usage(messages: DataFrame, models: DataFrame) -> DataFrame:
    """Billing rows: tokens of a session's turn and model, with the model's name, type and ratio (3 and 1 where unknown); none for no tokens.

    messages has a column turn, which says what each row was stored with.
    """
    tokens = messages.groupBy("session_id", "turn", "model_id").agg(F.sum(F.coalesce("token_count", F.lit(0))).alias("usage_tokens")).filter("usage_tokens > 0")
    named = tokens.join(models.select("model_id", "model_name", "type", "billing_ratio"), "model_id", "left")
    return named.withColumn("type", F.coalesce("type", F.lit(3))).withColumn("billing_ratio", F.coalesce("billing_ratio", F.lit(1)))


def billing_events(billed: DataFrame, turns: DataFrame) -> DataFrame:
    """Events for a message queue, as JSON: billed rows with the user, group, trace id and time of their turn, so that each is sent once.

    turns: (session_id, turn, user_id, group_id, trace_id, requested_at), one row a turn.  Tokens are raw; the ratio is sent along, not multiplied.
    """
    value = F.struct(
        F.col("user_id").alias("userId"), F.col("group_id").alias("groupId"), F.col("usage_tokens").alias("usageTokens"), F.col("billing_ratio").alias("billingRatio"), F.col("trace_id").alias("traceId"),
        F.col("model_name").alias("modelName"), F.col("type").alias("modelType"), iso_time(F.col("requested_at")).alias("requestTime"),
    )
    return billed.join(turns, ["session_id", "turn"]).select("trace_id", F.to_json(value, {"ignoreNullFields": "false"}).alias("value"))


def updated_sessions(sessions: DataFrame, changes: DataFrame) -> DataFrame:
    """sessions with changes (session_id, user_id, title, is_pinned, summary, at) of their owners.

    A change's null fields leave the session as it is.  Rename and pin set
    updated_at, a summary only its own time; unpinning clears pinned_at.
    """
    c = changes.select("session_id", "user_id", *(F.col(x).alias(f"__{x}") for x in ("title", "is_pinned", "summary", "at")))
    rows = sessions.join(c, ["session_id", "user_id"], "left")
    touched = F.col("__title").isNotNull() | F.col("__is_pinned").isNotNull()
    return rows.select(
        "session_id", "user_id", F.coalesce("__title", "title").alias("title"), F.coalesce("__is_pinned", "is_pinned").alias("is_pinned"),
        F.when(F.col("__is_pinned"), F.col("__at")).when(F.col("__is_pinned").isNull(), F.col("pinned_at")).alias("pinned_at"),
        F.when(touched, F.col("__at")).otherwise(F.col("updated_at")).alias("updated_at"),
        F.coalesce("__summary", "current_summary").alias("current_summary"),
        F.when(F.col("__summary").isNotNull(), F.col("__at")).otherwise(F.col("summary_updated_at")).alias("summary_updated_at"),
    )


def without(rows: DataFrame, deletions: DataFrame, *keys: str) -> DataFrame:
    """rows but those whose keys, owner included, are to be deleted; unknown keys are no error."""
    return rows.join(deletions.select(*keys).distinct(), list(keys), "left_anti")


def upserted_skills(existing: DataFrame, bundles: DataFrame, by_number: bool = False) -> DataFrame:
    """Skills after a seeding run: of each skill the last version in text order (or by its numbers, of any length) replaces what exists, and keeps created_at."""
    digits = lambda p: F.when(F.rlike(p, F.lit("^[0-9]+$")), F.regexp_replace(p, "^0+", "")).otherwise("")
    order = F.transform(F.split("version", r"\."), lambda p: F.struct(F.length(digits(p)).alias("n"), digits(p).alias("digits"))) if by_number else F.col("version")
    last = bundles.withColumn("__rank", F.row_number().over(Window.partitionBy("skill_id").orderBy(order.desc()))).filter("__rank = 1").select("skill_id", F.col("version").alias("__version"), F.col("at").alias("__at"))
    rows = existing.join(last, "skill_id", "full")
    return rows.select("skill_id", F.coalesce("__version", "version").alias("version"), F.coalesce("created_at", "__at").alias("created_at"), F.coalesce("__at", "updated_at").alias("updated_at"))


def active_states(states: Column) -> Column:
    """Of states (key, value, disabled) those that are not disabled and hold something."""
    return F.filter(states, lambda s: ~F.coalesce(s["disabled"], F.lit(False)) & (F.coalesce(s["value"], F.lit("")) != ""))


def prompt(messages: DataFrame, sessions: DataFrame, skills: DataFrame, queries: DataFrame, limit: int, chronological: bool = False) -> DataFrame:
    """Rows of each session's prompt in order (section, place): instructions with facts, summary, skills, history, states, query.

    queries: (session_id, query, facts, states); facts are remembered texts.
    skills: (session_id, skills), an array of (skill_id, description), in order of preference.
    History is the kept window before the older rows unless `chronological`.
    """
    from .history import by_session, token_window

    window = token_window(messages, limit)
    rank = F.row_number().over(by_session(F.lit(0) if chronological else F.desc("kept"), "seq"))
    facts = F.transform(F.coalesce("facts", F.array().cast("array<string>")), lambda f: F.concat(F.lit("\n* "), f))
    told = F.when(F.size(facts) > 0, F.concat(F.lit("\nKnown facts:"), F.array_join(facts, ""))).otherwise("")
    active = active_states(F.col("states"))
    shown = F.array_join(F.transform(active, lambda s: F.format_string("\n%s = %s", s["key"], s["value"])), "")
    offered = F.array_join(F.transform("skills", lambda s: F.format_string('\n* "%s": %s', s["skill_id"], F.coalesce(s["description"], F.lit("")))), "")
    body = [
        queries.select("session_id", F.lit(0).alias("section"), F.lit(0).cast("long").alias("place"), F.lit("system").alias("role"), F.concat(F.lit("You are a helpful assistant."), told).alias("content")),
        sessions.filter("current_summary <> ''").select("session_id", F.lit(1), F.lit(0).cast("long"), F.lit("system"), F.concat(F.lit("Earlier: "), "current_summary")),
        skills.filter(F.size("skills") > 0).select("session_id", F.lit(2), F.lit(0).cast("long"), F.lit("system"), F.concat(F.lit("Skills that may help; load one by its id if it is needed:"), offered)),
        window.select("session_id", F.lit(3), rank.cast("long"), "role", "content"),
        queries.filter(F.size(active) > 0).select("session_id", F.lit(4), F.lit(0).cast("long"), F.lit("system"), F.concat(F.lit("State of the interface:"), shown)),
        queries.select("session_id", F.lit(5), F.lit(0).cast("long"), F.lit("user"), "query"),
    ]
    out = body[0]
    for part in body[1:]:
        out = out.union(part)
    return out


def appended(rows: DataFrame, path: str) -> bool:
    """Appends rows to a table of Parquet files; no rows, no files.  Whether anything was written."""
    if rows.isEmpty():
        return False
    rows.write.mode("append").parquet(path)
    return True


def memory_rows(messages: DataFrame, embed: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """What a turn adds to its user's long-term memory: role and content of each row, and its embedding where a model is given.

    embed gives a vector for each of a list of texts; a null content is embedded as ''.
    """
    rows = messages.select("user_id", "role", "content")
    if embed is None:
        return rows

    def embedded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = embed([t or "" for t in batch.column(2).to_pylist()]) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float64()))], ["user_id", "role", "content", "embedding"])

    return rows.mapInArrow(embedded, f"user_id {rows.schema['user_id'].dataType.simpleString()}, role string, content string, embedding array<double>")


def remembered(memories: DataFrame, path: str, batch: int) -> None:
    """Adds a batch of memories to a table of Parquet files; a batch that is written again replaces itself."""
    memories.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def memory_items(memories: DataFrame) -> DataFrame:
    """A user's memories as an interface shows them: "" and an empty map for what is missing."""
    return memories.select("user_id", F.coalesce(F.col("memory_id").cast("string"), F.lit("")).alias("id"), F.coalesce("memory", F.lit("")).alias("memory"), F.coalesce("metadata", F.lit("{}")).alias("metadata"))


def memory_deletions(requests: DataFrame, memories: DataFrame) -> DataFrame:
    """requests (request_id, memory_id, user_id): deleted, absent (no error), or refused where the memory is another's."""
    found = requests.join(memories.select("memory_id", F.col("user_id").alias("__owner")), "memory_id", "left")
    outcome = F.when(F.col("__owner").isNull(), "absent").when(F.col("__owner") == F.col("user_id"), "deleted").otherwise("refused")
    return found.select("request_id", "memory_id", "user_id", outcome.alias("outcome"))
