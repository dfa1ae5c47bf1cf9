"""Structured Streaming forms: windowed counts, token streams, import queues, index refresh."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import TimerValues

from gridwright.operators.knowledge import TTL


def log_stream(spark: SparkSession, path: str, schema: str, files: int | None = None) -> DataFrame:
    """An append log as a stream of its new lines, so many files a trigger."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).json(path)


def counts_by_window(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """``events(ts, event_type, value)`` -> counts and sums by window and kind; rows later than ``late`` are left out."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


OPEN, CLOSE = "<think>", "</think>"


def visible(text: str, inside: bool) -> tuple[str, str, bool]:
    """(what may be shown, what is held back, whether a block is open) of text that goes on; a tag that may have begun is held back."""
    shown = ""
    while True:
        tag = CLOSE if inside else OPEN
        at = text.find(tag)
        if at >= 0:
            shown += "" if inside else text[:at]
            text, inside = text[at + len(tag) :], not inside
            continue
        keep = next((n for n in range(min(len(tag) - 1, len(text)), 0, -1) if tag.startswith(text[-n:])), 0)
        cut = len(text) - keep
        return shown + ("" if inside else text[:cut]), text[cut:], inside


def without_thoughts(deltas: DataFrame, repeats: int = 20) -> DataFrame:
    """``deltas(request, seq, delta)`` -> ``(request, seq, shown, stopped)``: thought blocks removed across deltas, and requests stopped once a token came ``repeats`` times on end.

    State is what a tag may still become of, whether a block is open, and the current run: bounded for each request.
    """
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, inside, last, run, stopped = state.get if state.exists else ("", False, "", 0, False)
        for b in batches:
            rows = []
            for seq, delta in b.sort_values("seq")[["seq", "delta"]].itertuples(index=False):
                if stopped:
                    continue
                run = run + 1 if delta == last and delta.strip() else 1
                last, stopped = delta, run >= repeats
                shown, held, inside = visible(held + delta, inside)
                rows.append((key[0], seq, shown, stopped))
            yield pd.DataFrame(rows, columns=["request", "seq", "shown", "stopped"])
        state.update((held, inside, last, run, stopped))

    return deltas.groupBy("request").applyInPandasWithState(step, "request string, seq long, shown string, stopped boolean", "held string, inside boolean, last string, run int, stopped boolean", "append", GroupStateTimeout.NoTimeout)


def sound(answer: str | None, window: int = 10, distinct: int = 2, shortest: int = 20) -> bool:
    """Whether an answer may be kept: long enough, and no window of words with so few different ones (as ``text.repeats_itself`` says of columns)."""
    words = (answer or "").split()
    poor = any(len(set(words[i : i + window])) <= distinct for i in range(len(words) - window + 1)) if len(words) > window else False
    return len((answer or "").strip()) >= shortest and not poor


class AnswerCache(StatefulProcessor):
    """An answer for each key, kept for ``seconds`` from when it was made; the state's own time to live then removes it."""

    def __init__(self, answer: Callable[[str], str | None], seconds: int):
        self.answer, self.seconds = answer, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("answer", "answer string, at long", self.seconds * 1000)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: TimerValues) -> None:
        newest = initialState.sort_values("at").iloc[-1]
        self.kept.update((str(newest["answer"]), int(newest["at"].timestamp() * 1000)))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        held = self.kept.get() if self.kept.exists() else None
        known = held[0] if held and now - held[1] <= self.seconds * 1000 and sound(held[0]) else None
        if held and known is None:
            self.kept.clear()
        for batch in rows:
            out = []
            for request, prompt in batch[["request", "prompt"]].itertuples(index=False):
                cached = known is not None
                made = known if cached else self.answer(prompt)
                if not cached and sound(made):
                    known = made
                    self.kept.update((made, now))
                ok = cached or sound(made)
                out.append((key[0], request, made if ok else None, cached, None if ok else "unusable answer"))
            yield pd.DataFrame(out, columns=["key", "request", "answer", "cached", "error"])


def answered_stream(questions: DataFrame, answer: Callable[[str], str | None], seconds: int = TTL, known: DataFrame | None = None) -> DataFrame:
    """``questions(key, request, prompt)`` -> ``(key, request, answer, cached, error)``: from the state where it has a sound answer that is fresh, else by ``answer``, and then kept.

    ``known(key, answer, at)`` fills the state at the start, with the age that its answers have. An unsound answer is null with an error, is never
    kept, and is asked for again; requests of one key in one batch share the first sound answer. State is one answer for each key.
    Null keys are one key. Time alone changes the state, so such a stream has no last batch: it runs until it is stopped (``availableNow`` doesn't end it). The session's state store must be RocksDB's (``spark.sql.streaming.stateStore.providerClass``).
    """
    start = known.groupBy("key") if known is not None else None
    shape = f"key {questions.schema['key'].dataType.simpleString()}, request {questions.schema['request'].dataType.simpleString()}, answer string, cached boolean, error string"
    return questions.groupBy("key").transformWithStateInPandas(AnswerCache(answer, seconds), shape, "append", "ProcessingTime", start)


def import_queue(spark: SparkSession, folder: str, work: Callable[[DataFrame], DataFrame], done: str, errors: str, checkpoint: str) -> StreamingQuery:
    """Files of a folder, one a trigger, through ``work``; rows without a result go to ``errors`` with their path."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", 1).load(folder)

    def each(batch: DataFrame, n: int) -> None:
        made = work(batch).persist()
        made.where("result is not null").write.mode("append").parquet(done)
        made.where("result is null").select("path").write.mode("append").parquet(errors)
        made.unpersist()

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refreshed(chunks: DataFrame, rebuild: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Rebuild what depends on new chunks once a batch, keyed by the batch's number as its version."""
    return chunks.writeStream.foreachBatch(rebuild).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
