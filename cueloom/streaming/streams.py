"""Structured Streaming forms of the incremental operators, with batch twins elsewhere.

- cursor: rows past a high-water mark for each task (a cursor poll), each once, whether replayed or live.
- full_batches: count-triggered batches of a fixed size; the rest waits in state until the source ends.
- think_filter: text deltas without think blocks, where a marker may be cut by a chunk boundary.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OPEN, CLOSE = "<think>", "</think>"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Cursor(StatefulProcessor):
    """What a task has delivered: all up to `mark`, and the chunks in `beyond`, those that came before one that is still out."""

    def __init__(self, after: int, idle_ms: int | None, columns: list[str]):
        self.after, self.idle_ms, self.columns = after, idle_ms, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.mark = handle.getValueState("mark", "mark long, due long")
        self.beyond = handle.getMapState("beyond", "idx long", "there boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark, due = self.mark.get() if self.mark.exists() else (self.after, 0)
        for f in rows:
            f = f.drop_duplicates("chunk_idx")
            fresh = [i is not None and i == i and i > mark and not self.beyond.containsKey((int(i),)) for i in f["chunk_idx"]]
            f = f[fresh].sort_values("chunk_idx")
            for i in f["chunk_idx"].astype(int):
                self.beyond.updateValue((int(i),), (True,))
            while self.beyond.containsKey((mark + 1,)):
                mark += 1
                self.beyond.removeKey((mark,))
            if len(f):
                yield f[self.columns]
        if self.idle_ms is not None:
            if due:
                self.handle.deleteTimer(due)
            due = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(due)
        self.mark.update((mark, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.mark.clear()
        self.beyond.clear()
        yield from ()

    def close(self) -> None:
        pass


def deliver(marks: dict, beyond: dict, tasks: list, chunks: list, after: int) -> list[bool]:
    """Which of the chunks are new, in turn; brings a bucket's marks and chunks beyond them (of tasks that have any) up to date."""
    fresh = []
    for t, i in zip(tasks, chunks, strict=True):
        mark, late = marks.get(t, after), beyond.get(t)
        new = i > mark and (late is None or i not in late)
        fresh.append(new)
        if not new:
            continue
        if i > mark + 1:
            beyond.setdefault(t, set()).add(i)
            continue
        while late and i + 1 in late:
            i += 1
            late.remove(i)
        marks[t] = i
        if late is not None and not late:
            del beyond[t]
    return fresh


def _bucket_cursor(chunks: DataFrame, after: int, idle_ms: int | None, buckets: int) -> DataFrame:
    """The cursor with a row of state for each bucket of tasks."""
    columns, task = chunks.columns, chunks.schema["task_id"].dataType

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, at, dues, late_of, late = state.getOption or ([], [], [], [], [])
        marks, due, beyond = dict(zip(known, at, strict=True)), dict(zip(known, dues, strict=False)), {}
        for t, i in zip(late_of, late, strict=True):
            beyond.setdefault(t, set()).add(i)
        now = 0 if idle_ms is None else state.getCurrentProcessingTimeMs()
        for f in frames:
            if not len(f):
                continue
            tasks = [None if none else t for t, none in zip(f["task_id"].tolist(), f["__none"].tolist(), strict=True)]
            new = f[deliver(marks, beyond, tasks, f["chunk_idx"].tolist(), after)]
            if idle_ms is not None:
                due.update(dict.fromkeys(tasks, now + idle_ms))
            if len(new):
                yield new[[*columns, "__none"]].sort_values("chunk_idx", kind="stable")
        for t in [t for t, d in due.items() if d <= now]:
            del due[t]
            marks.pop(t, None)
            beyond.pop(t, None)
        known = list(marks if idle_ms is None else due)
        if known or beyond:
            pairs = [(t, i) for t, late in beyond.items() for i in late]
            state.update((known, [marks.get(t, after) for t in known], list(due.values()), [t for t, _ in pairs], [i for _, i in pairs]))
            if due:
                state.setTimeoutDuration(min(due.values()) - now)
        elif state.exists:
            state.remove()

    # a null among numbers would make floats of them all
    filled = chunks.withColumns({"__none": F.col("task_id").isNull(), "__bucket": F.pmod(F.xxhash64("task_id"), F.lit(buckets)).cast("int"), "task_id": F.coalesce("task_id", F.lit("0").cast(task))})
    kept = f"known array<{task.simpleString()}>, at array<bigint>, dues array<bigint>, late_of array<{task.simpleString()}>, late array<bigint>"
    out = filled.groupBy("__bucket").applyInPandasWithState(run, filled.drop("__bucket").select(*columns, "__none").schema, kept, "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
    return out.withColumn("task_id", F.when(~F.col("__none"), F.col("task_id"))).select(*columns)


def cursor(chunks: DataFrame, after: int = -1, idle_ms: int | None = None, buckets: int | None = None) -> DataFrame:
    """chunks (task_id, chunk_idx, ...), replayed and live ones alike: each past `after` once, those of one Arrow batch in order.

    Chunks are numbered from after + 1. A task's state is one number and the chunks beyond the first that is missing, so it
    stays small where chunks come in order; a late chunk still comes out, a repeated one doesn't. A chunk up to `after` or without a
    number is dropped. With idle_ms a task's state goes once no other chunk came for so long: a chunk repeated later than that comes
    out again. With buckets, for streams of very many tasks, tasks are dealt by hash over so many groups of one row of state
    each, instead of a group for each task; a micro-batch writes the rows of those that it touches. A checkpoint goes on with the
    number that it began with. Needs the RocksDB state store, which it sets for the session.
    """
    chunks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    chunks = chunks.where(F.col("chunk_idx") > after)
    if buckets is not None:
        return _bucket_cursor(chunks, after, idle_ms, buckets)
    return chunks.groupBy("task_id").transformWithStateInPandas(Cursor(after, idle_ms, chunks.columns), chunks.schema, "append", "None" if idle_ms is None else "ProcessingTime")


def full_batches(cues: DataFrame, size: int = 25) -> DataFrame:
    """cues (media, cue_idx, text, done boolean) -> media, batch, n, texts.

    A batch goes out when `size` cues are there; a row with done ends its media, and what is left
    goes out as a short batch. Only the remainder, fewer than `size` cues, is kept in state.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batch, held = state.get if state.exists else (0, [])
        held, done = list(held), False
        for f in frames:
            f = f.sort_values("cue_idx")
            held += [t for t, d in zip(f["text"], f["done"], strict=True) if not d]
            done = done or bool(f["done"].any())
        out = []
        while len(held) >= size or done and held:
            out.append((key[0], batch, min(size, len(held)), "\n".join(held[:size])))
            batch, held = batch + 1, held[size:]
        if done:
            state.remove()
        else:
            state.update((batch, held))
        yield pd.DataFrame(out, columns=["media", "batch", "n", "texts"])

    return cues.groupBy("media").applyInPandasWithState(run, "media string, batch long, n long, texts string", "batch long, held array<string>", "append", GroupStateTimeout.NoTimeout)


def visible(held: str, inside: bool, delta: str) -> tuple[str, str, bool]:
    """What of held + delta can be shown, what must wait, and whether a block is open."""
    text, out = held + delta, []
    while True:
        mark = CLOSE if inside else OPEN
        at = text.find(mark)
        if at >= 0:
            if not inside:
                out.append(text[:at])
            text, inside = text[at + len(mark) :], not inside
            continue
        keep = next((n for n in range(min(len(mark) - 1, len(text)), 0, -1) if text.endswith(mark[:n])), 0)
        if not inside:
            out.append(text[: len(text) - keep])
        return "".join(out), text[len(text) - keep :], inside


def think_filter(deltas: DataFrame) -> DataFrame:
    """deltas (stream, seq, delta, done boolean) -> stream, text: what can be shown after each micro-batch."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, inside = state.get if state.exists else ("", False)
        shown, done = [], False
        for f in frames:
            for d, end in f.sort_values("seq")[["delta", "done"]].itertuples(index=False):
                text, held, inside = visible(held, inside, d or "")
                shown.append(text)
                done = done or bool(end)
        if done:
            shown.append("" if inside else held)  # a part of a marker that never came is text
            state.remove()
        else:
            state.update((held, inside))
        yield pd.DataFrame([(key[0], "".join(shown))], columns=["stream", "text"])

    return deltas.groupBy("stream").applyInPandasWithState(run, "stream string, text string", "held string, inside boolean", "append", GroupStateTimeout.NoTimeout)
