"""Tools that run: Python callables over rows of calls, inside the tasks that hold the rows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .routing import visible_tools


@dataclass(frozen=True)
class Tool:
    """run(context, **arguments) gives a call's output, as text; context is a dict that callers can't set."""

    name: str
    run: Callable[..., object]
    ephemeral: bool = False  #: its outputs are for the turn alone
    reserved: bool = False  #: seen only where it is exposed


def registry(spark: SparkSession, tools: Iterable[Tool]) -> DataFrame:
    """(name, ephemeral, reserved) of the tools, as `deltas.call_results` and `routing.visible_tools` take them."""
    return spark.createDataFrame([(t.name, t.ephemeral, t.reserved) for t in tools], "name string, ephemeral boolean, reserved boolean").coalesce(1)


def in_scope(calls: DataFrame, scopes: DataFrame, tools: DataFrame) -> DataFrame:
    """calls with `visible`: whether the step's scope shows the tool that the call names.

    scopes: (step, exposed, allow, deny), arrays of names; a step without a
    row has no lists.  A tool that isn't registered is visible to nobody.
    """
    rows = calls.join(scopes.select("step", "exposed", "allow", "deny"), "step", "left").join(tools.select(F.col("name").alias("call_name"), "reserved"), "call_name", "left")
    seen = visible_tools(rows.withColumn("name", F.col("call_name")))
    return seen.select(*calls.columns, F.coalesce(F.col("visible") & F.col("reserved").isNotNull(), F.lit(False)).alias("visible"))


def run_tools(calls: DataFrame, tools: Iterable[Tool], *context: str) -> DataFrame:
    """(step, place, call_id, name, input, output, ephemeral): what each call gives, one row a call.

    calls: (step, place, call_id, call_name, input, visible), input being a JSON
    object, and the columns named in `context`, which every tool gets as a
    dict.  A call fails alone: what it raises becomes its text, as does an
    input that is no object.  Calls of tools that are not registered or not
    visible say so and run nothing.  A null output is ''.  Where a task is
    repeated its calls run again, so a tool that changes something has to bear
    that.
    """
    known = {t.name: t for t in tools}
    rows = calls.select("step", "place", "call_id", F.col("call_name").alias("name"), "input", "visible", F.struct(*context) if context else F.lit(None).cast("struct<none:string>"))

    def output(name: str | None, text: str | None, visible: bool | None, given: dict | None) -> str:
        tool = known.get(name)
        if tool is None or not visible:
            return f"[no tool named {name}]"
        try:
            result = tool.run(dict(given or {}), **json.loads(text or "{}"))
        except Exception as e:  # whatever a tool raises is its answer
            return f"[tool failed] {type(e).__name__}: {e}"
        return "" if result is None else str(result)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(3).to_pylist()
            outputs = [output(*row) for row in zip(names, *(batch.column(k).to_pylist() for k in (4, 5, 6)), strict=True)]
            flags = [bool(n in known and known[n].ephemeral) for n in names]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(outputs, pa.string()), pa.array(flags)], ["step", "place", "call_id", "name", "input", "output", "ephemeral"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("step", "place", "call_id", "name", "input"))
    return rows.mapInArrow(run, f"{kinds}, output string, ephemeral boolean")
