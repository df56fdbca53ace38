"""URL filters: temporal list join, in DataFrame functions only.

Dated list entries become validity intervals: an entry of a list is in force
from one of its `add` events to the next event of the same list and value.  A
capture is looked up by every parent domain of its host and every prefix of its
path; an as-of join finds the intervals that hold its fetch time.  Intervals are
spread over time buckets, so a join key (value, bucket) meets only the few
intervals of that time, and the join splits when a host is hot, as the entry
side has few rows for a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_SECONDS = 30 * 86400


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port and trailing dot; empty where there is none."""
    return F.rtrim(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit("."))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def lookup_values(url: Column) -> Column:
    """Every parent domain of the host, and host/path for every prefix of whole path segments."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    segments = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.when(
        F.size(segments) > 0,
        F.transform(F.sequence(F.lit(1), F.size(segments)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i), "/"))),
    ).otherwise(F.array().cast("array<string>"))
    return F.when(F.coalesce(host, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.concat(domains, paths))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, value, from_s, until_s) of entries (list, value, action, effective).

    Of events at one time `add` counts.  Rows with a null in any of the four
    columns, and actions other than add and remove, are no events.
    """
    events = (
        entries.select("list", F.lower("value").alias("value"), "action", F.unix_seconds(F.col("effective").cast("timestamp")).alias("at"))
        .dropna().filter(F.col("action").isin("add", "remove"))
        .groupBy("list", "value", "at").agg(F.min("action").alias("action"))
    )
    ordered = Window.partitionBy("list", "value").orderBy("at")
    return (
        events.withColumn("until_s", F.lead("at").over(ordered))
        .filter(F.col("action") == "add")
        .select("list", "value", F.col("at").alias("from_s"), "until_s")
    )


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """Per capture id: blocked, n_active (list entries in force at fetch time) and lists (their names, sorted).

    Several captures may share an id; an entry counts once for an id.  A
    capture with a null or hostless URL, or a null time, matches nothing; so
    does any capture where no list has entries.  Other columns are ignored.
    """
    at = F.unix_seconds(F.col(time_col).cast("timestamp"))
    probes = captures.select(F.col(id_col).alias("id"), at.alias("at"), F.explode_outer(lookup_values(F.col(url_col))).alias("value"))
    probes = probes.withColumn("bucket", F.floor(F.col("at") / BUCKET_SECONDS))
    horizon = captures.agg(F.max(at).alias("last"))
    spread = (
        intervals(entries).join(F.broadcast(horizon), F.col("from_s") <= F.col("last"))  # one row: the time at which open intervals may end
        .withColumn("bucket", F.explode(F.sequence(F.floor(F.col("from_s") / BUCKET_SECONDS), F.floor(F.least(F.coalesce("until_s", "last"), "last") / BUCKET_SECONDS))))
        .select(F.col("value").alias("v"), F.col("bucket").alias("b"), "list", "from_s", "until_s")
    )
    hit = (F.col("value") == F.col("v")) & (F.col("bucket") == F.col("b")) & (F.col("at") >= F.col("from_s")) & (F.col("until_s").isNull() | (F.col("at") < F.col("until_s")))
    found = probes.join(spread, hit, "left")
    entry = F.when(F.col("list").isNotNull(), F.struct("list", "v"))
    return (
        found.groupBy("id").agg(F.collect_set(entry).alias("active"))
        .select(
            F.col("id").alias(id_col), (F.size("active") > 0).alias("blocked"), F.size("active").cast("long").alias("n_active"),
            F.array_sort(F.array_distinct(F.transform("active", lambda e: e["list"]))).alias("lists"),
        )
    )
