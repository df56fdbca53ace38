"""The events of streamed answers, as they arrive: the stream form of `operators.deltas.events`."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.deltas import EVENTS

OUTPUT = "step long, seq long, ord int, type string, delta string"


class AnswerEvents(StatefulProcessor):
    """Keeps of each step whether its reasoning and its text are open; a row with `last` closes both and forgets the step.

    Rows of a step arrive in order of batches; inside a batch they are sorted
    by seq.  What comes after the end marker of a step is not sent.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.flags = handle.getValueState("flags", "thinking boolean, talking boolean, ended boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.flags.get()  # each call of a state is a message to the JVM and back
        thinking, talking, ended = before = tuple(held) if held else (False, False, False)
        out: list[tuple] = []
        fragments = sorted(rows, key=lambda r: r.seq)
        for r in fragments:
            if ended:
                break
            thought, said = (x if isinstance(x, str) else "" for x in (r.reasoning_content, r.content))
            events = []
            if thought:
                events += [(1, thought)] if thinking else [(0, None), (1, thought)]
                thinking = True
            if said:
                if not talking:
                    events += [(2, None), (3, None)] if thinking else [(3, None)]
                    thinking, talking = False, True
                events.append((4, said))
            out += [(int(r.seq), n, d) for n, d in events]
            if r.last:
                out += [(None, 5, None)] * thinking + [(None, 6, None)] * talking
                thinking, talking, ended = False, False, True
        if not held or before != (thinking, talking, ended):
            self.flags.update((thinking, talking, ended))
        for seq, ord_, delta in out:
            yield Row(step=key[0], seq=seq, ord=ord_, type=EVENTS[ord_], delta=delta)

    def close(self) -> None:
        pass


def answer_events(stream: DataFrame) -> DataFrame:
    """stream (step long, seq long, content, reasoning_content, last boolean) to rows of OUTPUT; `last` marks a step's end.

    However the stream is cut into batches the rows are those of
    `deltas.events`.  Needs the RocksDB state store; an ended step keeps three
    flags, so that a late fragment opens nothing.
    """
    return stream.groupBy("step").transformWithState(AnswerEvents(), OUTPUT, "Append", "None")
