"""Keyword search, skill matching and memory search."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import parsed_range, search_tokens, truncated

#: Bytes of triggers in an automaton; where they are more, each block of them is a pass over the queries.
SKILL_BYTES = 10 << 20


def search(messages: DataFrame, keyword: str, session_id: str | None = None, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Rows that hold a token of the keyword, as an OR of terms; both bounds are closed."""
    rows = messages.filter(F.arrays_overlap(search_tokens(F.col("content")), search_tokens(F.lit(keyword))))
    if session_id is not None:
        rows = rows.filter(F.col("session_id") == session_id)
    if start is not None:
        rows = rows.filter(F.col("created_at") >= start)
    if end is not None:
        rows = rows.filter(F.col("created_at") <= end)
    return rows


def search_requests(messages: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (request_id, session_id, keyword, start, end; bounds as text): the rows of the session that hold a term and are within the bounds.

    A keyword is trimmed; bounds are closed, and those that aren't times are dropped as `parsed_range` says.
    """
    start, end = parsed_range(F.col("start"), F.col("end"))
    asked = requests.select("request_id", "session_id", search_tokens(F.trim("keyword")).alias("__terms"), start.alias("__start"), end.alias("__end"))
    hits = messages.join(asked, "session_id").filter(F.arrays_overlap(search_tokens(F.col("content")), "__terms"))
    within = (F.col("__start").isNull() | (F.col("created_at") >= F.col("__start"))) & (F.col("__end").isNull() | (F.col("created_at") <= F.col("__end")))
    return hits.filter(within).drop("__terms", "__start", "__end")


def indexed_requests(index, messages: DataFrame, requests: DataFrame, dictionary: DataFrame | None = None, n: int = 10) -> DataFrame:
    """The oldest n rows of messages for each request, as `search_requests` finds them, out of an index of them.

    requests as there, with a session or null for all.  Messages are met by
    (session_id, seq) after the index has answered, so only what is shown is
    read; keywords are cut as `segmentation.with_terms` cuts texts.
    """
    from .segmentation import with_terms

    start, end = parsed_range(F.col("start"), F.col("end"))
    asked = requests.select("request_id", "session_id", F.trim("keyword").alias("keyword"), start.alias("start"), end.alias("end"))
    asked = asked.withColumn("terms", search_tokens(F.col("keyword"))) if dictionary is None else with_terms(asked, dictionary, "request_id", text_col="keyword")
    oldest = Window.partitionBy("request_id").orderBy("created_at", "seq")
    first = index.search(asked).withColumn("__rank", F.row_number().over(oldest)).filter(F.col("__rank") <= n).select("request_id", "session_id", "seq")
    return messages.join(first, ["session_id", "seq"])


def answered(hits: DataFrame, requests: DataFrame, n: int = 10, limit: int = 4000) -> DataFrame:
    """(request_id, text): the oldest n hits of each request as lines, or a text that says there are none."""
    first = hits.withColumn("rank", F.row_number().over(Window.partitionBy("request_id").orderBy("created_at", "seq"))).filter(F.col("rank") <= n)
    texts = rendered(first, limit, "request_id")
    return requests.select("request_id").join(texts, "request_id", "left").select("request_id", F.coalesce("text", F.lit("no messages found")).alias("text"))


def first_hits(hits: DataFrame, n: int = 10) -> DataFrame:
    """The oldest n hits of every session."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("session_id").orderBy("created_at", "seq"))).filter(F.col("rank") <= n)


def rendered(hits: DataFrame, limit: int = 4000, key: str = "session_id") -> DataFrame:
    """Per session (or other key) its hits as lines, cut at `limit` characters."""
    line = F.format_string("[%s] (%s): %s", "role", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"), F.coalesce("content", F.lit("")))
    lines = F.array_sort(F.collect_list(F.struct("created_at", "seq", line.alias("line"))))
    return hits.groupBy(key).agg(truncated(F.array_join(F.transform(lines, lambda s: s["line"]), "\n"), limit).alias("text"))


def match_skills(queries: DataFrame, skills: DataFrame, k: int = 2, distinct: bool = False) -> DataFrame:
    """(query_id, skill_id, hits, rank): enabled skills by the number of triggers that a query holds, whatever the case; repeated triggers count again unless `distinct`.

    All triggers are found in one walk over a query's text, by an automaton
    that each task builds, so that the time is that of the text whatever their
    number.  Their size is checked: what is over SKILL_BYTES goes in further
    blocks, each a pass of its own, whose counts are summed.
    """
    listed = skills.filter("enabled").select("skill_id", F.posexplode(F.array_distinct("triggers") if distinct else F.col("triggers")).alias("pos", "t")).filter("t <> ''").select(F.col("skill_id").cast("string"), F.lower("t").alias("t"))
    triggers = listed.groupBy("skill_id", "t").agg(F.count("*").alias("times"))
    size = triggers.agg(F.coalesce(F.sum(F.octet_length("t") + F.octet_length("skill_id") + 32), F.lit(0))).first()[0]
    blocks = max(1, -(-size // SKILL_BYTES))
    lowered = queries.select("query_id", F.lower("text").alias("text")).filter("text IS NOT NULL")
    kind = lowered.schema["query_id"].dataType.simpleString()
    met = []
    for number in range(blocks):
        block = triggers if blocks == 1 else triggers.filter(F.pmod(F.xxhash64("skill_id", "t"), F.lit(blocks)) == number)
        met.append(lowered.mapInArrow(_found_triggers(sorted(map(tuple, block.collect()))), f"query_id {kind}, skill_id string, hits long"))  # a block is bounded
    found = met[0]
    for more in met[1:]:
        found = found.unionByName(more)
    hits = found.groupBy("query_id", "skill_id").agg(F.sum("hits").alias("hits"))
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("hits"), "skill_id"))).filter(F.col("rank") <= max(1, k))


def _found_triggers(triggers: list[tuple[str, str, int]]):
    """Per text the skills of the triggers that it holds, with the number of those; triggers: (skill_id, text, times listed)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        of: dict[str, list[tuple[str, int]]] = {}
        for skill, text, times in triggers:
            of.setdefault(text, []).append((skill, times))
        automaton = ahocorasick.Automaton()
        for text in of:
            automaton.add_word(text, text)
        if of:
            automaton.make_automaton()
        for batch in batches:
            rows, skills, hits = [], [], []
            for k, text in enumerate(batch.column(1).to_pylist() if of else []):
                counts: dict[str, int] = {}
                for held in {t for _, t in automaton.iter(text)}:
                    for skill, times in of[held]:
                        counts[skill] = counts.get(skill, 0) + times
                rows += [k] * len(counts)
                skills += counts.keys()
                hits += counts.values()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(skills, pa.string()), pa.array(hits, pa.int64())], ["query_id", "skill_id", "hits"])

    return found


def cosine(left: Column, right: Column) -> Column:
    """In double precision; null where a vector has no length."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.try_divide(dot(left, right), F.sqrt(dot(left, left) * dot(right, right)))


def search_memory(memories: DataFrame, queries: DataFrame, limit: int = 10, threshold: float | None = None) -> DataFrame:
    """Per query of a user the user's nearest memories: the `limit` best by cosine, then those of `threshold` or more; a null score counts as 0.

    The order is that of the scores as they are; ties go to the smaller memory_id.
    """
    scored = memories.join(queries, "user_id").withColumn("score", F.coalesce(cosine(F.col("embedding"), F.col("query")), F.lit(0.0)))
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "memory_id"))).filter(F.col("rank") <= limit)
    return best if threshold is None else best.filter(F.col("score") >= threshold)


def reranked(recalled: DataFrame, scorer: Callable[[pa.RecordBatch], list[float | None]], *given: str, threshold: float | None = None) -> DataFrame:
    """Recalled memories in the order of a second score: rerank_score, and rank renewed.

    recalled: rows of `search_memory`, a query's first `limit` ones.  scorer gives
    a score for each row of a batch of the columns named in `given`, null where
    it has none, which counts as 0.  Rows below the threshold go, however few
    are left; ties go to the smaller memory_id.  Scores are compared unrounded.
    """
    fields = ", ".join(f"`{c}` {recalled.schema[c].dataType.simpleString()}" for c in recalled.columns if c != "rerank_score")
    rows = recalled.drop("rerank_score")
    places = [rows.columns.index(c) for c in given]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = scorer(pa.RecordBatch.from_arrays([batch.column(k) for k in places], list(given))) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([0.0 if s is None else float(s) for s in scores], pa.float64())], [*batch.schema.names, "rerank_score"])

    scored = rows.mapInArrow(score, f"{fields}, rerank_score double")
    kept = scored if threshold is None else scored.filter(F.col("rerank_score") >= threshold)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "memory_id")))
