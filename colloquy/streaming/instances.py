"""Service instances kept up to date by pushes, and requests that are answered from them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "service long, request_id long, address string, n_known int"


class KnownInstances(StatefulProcessor):
    """Of each service the usable instances last pushed; a push without any is ignored.

    Rows are handled in order of `at`, a push before the requests of its time.
    A request gets the instance of its number modulo theirs, in order of
    address; null where none was ever pushed.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "addresses array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = list(self.known.get()[0]) if self.known.exists() else []
        before, answers = known, []
        for r in sorted((r for frame in rows for r in frame.itertuples()), key=lambda r: (r.at, r.is_request, r.request_id if r.is_request else 0)):
            if not r.is_request:
                fresh = sorted(set(r.addresses)) if r.addresses is not None else []
                known = fresh or known
            else:
                answers.append((int(r.request_id), known[int(r.request_id) % len(known)] if known else None, len(known)))
        if known is not before:
            self.known.update((known,))
        if answers:
            ids, addresses, sizes = zip(*answers, strict=True)
            yield pd.DataFrame({"service": key[0], "request_id": ids, "address": pd.array(addresses, object), "n_known": pd.array(sizes, "int32")})

    def close(self) -> None:
        pass


def answered_requests(rows: DataFrame) -> DataFrame:
    """A stream of pushes and requests of services to rows of OUTPUT, one a request.

    rows: (service long, at timestamp, is_request boolean, request_id long,
    addresses array<string>), what `pushes_and_requests` makes.
    """
    return rows.groupBy("service").transformWithStateInPandas(KnownInstances(), OUTPUT, "Append", "None")


def pushes_and_requests(pushes: DataFrame, requests: DataFrame) -> DataFrame:
    """One stream of both.

    pushes: (service, at, instances), an array of (address, healthy, enabled),
    of which those that are not false on either count; requests: (service, at,
    request_id).
    """
    usable = F.transform(F.filter("instances", lambda i: F.coalesce(i["healthy"], F.lit(True)) & F.coalesce(i["enabled"], F.lit(True))), lambda i: i["address"])
    pushed = pushes.select(F.col("service").cast("long"), "at", F.lit(False).alias("is_request"), F.lit(None).cast("long").alias("request_id"), usable.alias("addresses"))
    return pushed.unionByName(requests.select(F.col("service").cast("long"), "at", F.lit(True).alias("is_request"), F.col("request_id").cast("long"), F.lit(None).cast("array<string>").alias("addresses")))
