"""Continuous ingestion: messages are buffered by session until a window is due, and windows are merged in micro-batches."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weft.operators.ingest import MIN_CHARS, MIN_MESSAGES, WINDOW

MESSAGE = "session_id string, idx long, role string, text string"
PROMPT = "session_id string, msg_index long, text string"


def window_step(held: list[tuple[int, str]], new: list[tuple[int, str]], most: int = WINDOW, least: int = MIN_MESSAGES, chars: int = MIN_CHARS) -> tuple[list[tuple[int, str]], tuple[int, str] | None]:
    """What is held after new messages (idx, line), and the window (next index, text) if one is due. A message that comes twice counts once."""
    both = sorted(dict(held + new).items())
    if len(both) < least:
        return both, None
    text = "\n".join(line for _, line in both[-most:])
    return ([], (both[-1][0] + 1, text)) if len(text) >= chars else (both, None)


def windows(messages: DataFrame, most: int = WINDOW, least: int = MIN_MESSAGES) -> DataFrame:
    """Streaming counterpart of the batch windows: session_id, msg_index, text whenever ``least`` new messages are there.

    A session's state is its next index, the indices before it that haven't come, and the messages that
    wait: micro-batches of single messages lose nothing, messages that come late go into the next window,
    and those that come again are dropped.
    """

    def step(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, missing, waiting = state.get if state.exists else (0, "[]", "[]")
        held, gaps = [tuple(x) for x in json.loads(waiting)], set(json.loads(missing))
        new = [(int(i), f"{r}: {t}") for b in batches for i, r, t in zip(b["idx"], b["role"], b["text"], strict=True) if i >= last or i in gaps]
        seen = {i for i, _ in held + new}
        held, due = window_step(held, new, most, least)
        if due:
            nxt = max(last, due[0])
            gaps = (gaps | set(range(last, nxt))) - seen
            last = nxt
            yield pd.DataFrame({"session_id": [key[0]], "msg_index": [last], "text": [due[1]]})
        state.update((last, json.dumps(sorted(gaps)), json.dumps(held)))

    return messages.groupBy("session_id").applyInPandasWithState(step, PROMPT, "last long, missing string, waiting string", "append", GroupStateTimeout.NoTimeout)


class Breaker:
    """After ``threshold`` failures in a row, batches are passed over until ``reset`` seconds have gone by."""

    def __init__(self, threshold: int = 3, reset: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.threshold, self.reset, self.clock = threshold, reset, clock
        self.failures, self.open_since = 0, None
        self.error: Exception | None = None

    def call(self, work: Callable[[], None]) -> str:
        """'done', 'failed' or 'open'; what was raised last is in ``error``."""
        if self.open_since is not None:
            if self.clock() - self.open_since < self.reset:
                return "open"
            self.failures, self.open_since = 0, None
        try:
            work()
        except Exception as e:  # noqa: BLE001  counted; what becomes of the batch is the caller's affair
            self.error = e
            self.failures += 1
            if self.failures >= self.threshold:
                self.open_since = self.clock()
            return "failed"
        self.failures = 0
        return "done"


def every(n: int) -> Callable[[int], bool]:
    """Whether a maintenance cycle is due after the batch of that number; n = 0: never."""
    return lambda batch_id: n > 0 and batch_id > 0 and batch_id % n == 0


def ingest(messages: DataFrame, store_batch: Callable[[DataFrame, int], None], checkpoint: str, breaker: Breaker | None = None, maintain: Callable[[int], None] | None = None, due: Callable[[int], bool] = every(0), dead_letter: Callable[[DataFrame, int], None] | None = None) -> DataStreamWriter:
    """A writer that hands each micro-batch of windows to ``store_batch``; ``maintain`` runs after batches that are ``due``.

    Offsets and state are checkpointed: a batch that a crash cuts off is handed over again, so
    ``store_batch`` must bear to see one twice.  What ``store_batch`` raises stops the query before its
    offsets are committed; started again, it hands the same batch over.  With ``dead_letter`` the query
    goes on: the batch goes there, as do all while the breaker is open, and none is lost; what
    ``dead_letter`` raises stops the query.  The source's rate limit takes the place of a bounded queue.
    """
    guard = breaker or Breaker()

    def batch(df: DataFrame, batch_id: int) -> None:
        if dead_letter is None:
            store_batch(df, batch_id)
        else:
            df = df.persist()
            try:
                if guard.call(lambda: store_batch(df, batch_id)) != "done":
                    dead_letter(df, batch_id)
            finally:
                df.unpersist()
        if maintain and due(batch_id):
            maintain(batch_id)

    return windows(messages).writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)


def read_messages(spark: SparkSession, path: str, files_per_batch: int = 50) -> DataFrame:
    return spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files_per_batch).json(path)
