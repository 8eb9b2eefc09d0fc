"""State of streams: the newest turns of each session, and answers until they expire.

Both need a state store that can hold keyed state of several kinds; ``with_state_store`` sets it for
a session. State is part of the query's checkpoint, so a restarted query goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docloom.config import Settings

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


class _Ring(StatefulProcessor):
    """A list of at most ``most`` turns per session, oldest first."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getListState("turns", "turn long, query string, response string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = {t: (q, r) for t, q, r in self.turns.get()} if self.turns.exists() else {}
        for frame in rows:
            # A turn that comes again replaces what was there, so a repeated batch changes nothing.
            held |= {int(t): (q, r) for t, q, r in zip(frame["turn"], frame["query"], frame["response"])}
        # Only the newest turns are kept, whatever order they come in.
        kept = sorted(held.items())[-self.most :]
        self.turns.put([(t, q, r) for t, (q, r) in kept])
        newest = kept[::-1]
        yield pd.DataFrame(
            {
                "session_id": [key[0]] * len(newest),
                "turn": [t for t, _ in newest],
                "query": [q for _, (q, _) in newest],
                "response": [r for _, (_, r) in newest],
                "age": range(1, len(newest) + 1),
            }
        )

    def close(self) -> None:
        pass


def session_ring(pairs: DataFrame, most: int = Settings.max_history) -> DataFrame:
    """The newest turns of each session that a batch touches, ``age`` 1 for the newest.

    ``pairs`` is a stream of ``session_id, turn, query, response``. Rows are those of
    ``memory.last_turns`` over all turns so far (in update mode: of the sessions in the batch).
    """
    kind = pairs.schema["session_id"].dataType.simpleString()
    return pairs.groupBy("session_id").transformWithStateInPandas(
        _Ring(most), f"session_id {kind}, turn long, query string, response string, age int", "Update", "None"
    )


class _Fresh(StatefulProcessor):
    """The live answer of each key; a timer clears it when it expires."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getValueState("live", "expires long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        expires = self.live.get()[0] if self.live.exists() else None
        at, values = [], []
        frames = pd.concat(list(rows)).sort_values(["created_at", "value"], kind="stable")
        for created, value in zip(frames["created_at"], frames["value"]):
            now = int(created.timestamp() * 1000)
            if expires is not None and now < expires:
                continue
            if expires is not None:
                self.handle.deleteTimer(expires)
            expires = now + self.ttl_ms
            self.handle.registerTimer(expires)
            at.append(created)
            values.append(value)
        if at:
            self.live.update((expires,))
            created = pd.Series(at).astype("datetime64[ns]") if at[0].tzinfo is None else pd.Series(at)
            ends = created + pd.Timedelta(milliseconds=self.ttl_ms)
            yield pd.DataFrame({"key": [key[0]] * len(at), "value": values, "created_at": created, "expires_at": ends})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.live.clear()
        yield from ()

    def close(self) -> None:
        pass


def fresh_answers(answers: DataFrame, ttl_seconds: int = Settings.memory_ttl_seconds, late: str = "1 second") -> DataFrame:
    """Of a stream ``key, value, created_at`` the answers that are not repeats of a live one.

    An answer lives from its time until ``ttl_seconds`` later (that instant is no longer in it); the
    next answer of the key starts anew. State goes when the watermark passes the end of its life, so
    it holds live keys only. Rows later than ``late`` behind the newest may be left out.
    """
    live = answers.withWatermark("created_at", late).select("key", "value", "created_at")
    return live.groupBy("key").transformWithStateInPandas(
        _Fresh(ttl_seconds * 1000), "key string, value string, created_at timestamp, expires_at timestamp", "Append", "EventTime"
    )
