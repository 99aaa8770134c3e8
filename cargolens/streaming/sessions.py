"""Session state as a stream: bounded tails and carried values, one row per new turn; and stored sessions that a stream keeps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.sessions import CARRIED, MAX_TURNS, session_append, session_tail
from ..operators.sessions import with_entities as entities
from ..sources.stored import Stored

OUT = ["conv_id", "turn", "n_turns", *(f"{c}_in_force" for c in CARRIED)]
SHAPE = "conv_id long, turn long, n_turns int, " + ", ".join(f"{c} string" for c in OUT[3:])
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Sessions(StatefulProcessor):
    """Last turns, values in force and the time of the last turn of one session, with a timer that drops them."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tail = handle.getListState("tail", "turn bigint")
        self.said = handle.getValueState("said", "named array<string>, latest bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [t[0] for t in self.tail.get()]
        before = self.said.get() if self.said.exists() else None
        values, latest = (list(before[0]), before[1]) if before else ([None] * len(CARRIED), None)
        timer = None if latest is None else latest + self.idle
        for part in rows:  # a chunk of the session at a time
            out = []
            for r in part.sort_values(["ms", "turn"]).itertuples():
                if latest is not None and r.ms - latest >= self.idle:  # whether or not a timer has come before
                    held, values, latest = [], [None] * len(CARRIED), None
                held = [*held, r.turn][-MAX_TURNS:]
                in_force = []
                for i, (name, own) in enumerate(zip(CARRIED, r.named, strict=True)):
                    leans = r.about_last_order if name == "order_token" else r.follow_up
                    in_force.append(own if own is not None else values[i] if leans else None)
                    values[i] = own if own is not None else values[i]
                out.append((key[0], r.turn, len(held), *in_force))
                latest = r.ms if latest is None else max(latest, r.ms)
            yield pd.DataFrame(out, columns=OUT)
        self.tail.put([(t,) for t in held])
        self.said.update((values, latest))
        if timer != latest + self.idle:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(latest + self.idle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.tail.clear()
        self.said.clear()
        return iter(())

    def close(self) -> None:
        pass


def session_stream(turns: DataFrame, timeout: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Per new turn of (conv_id, turn, text, ts): turns held (the last 20 at most) and all values in force.

    ``ts`` is the time of the turn. A turn that comes ``timeout`` or more after the one before
    starts its session anew: that follows from the turns alone, into whatever batches they are
    cut. Timers drop the state of idle sessions once the watermark, the greatest time seen less
    ``delay``, is past that point, from where on no turn can go on with them. Turns at or before
    the watermark are late and dropped; the watermark does depend on batches.

    Turns of a session that come in one batch are read in chunks of Arrow's size, by their time
    inside a chunk; more than one chunk of one session in one batch has to arrive in order. The
    state needs the RocksDB provider (``spark.sql.streaming.stateStore.providerClass``).
    """
    spark = turns.sparkSession
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass"):
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}")
    idle = int(pd.Timedelta(timeout).total_seconds() * 1000)
    d = entities(turns.withWatermark("ts", delay)).select(
        "conv_id", "turn", "ts", F.unix_millis("ts").alias("ms"), F.array(*CARRIED).alias("named"), "follow_up", "about_last_order"
    )
    return d.groupBy("conv_id").transformWithStateInPandas(Sessions(idle), SHAPE, "append", "eventTime")


# ---- stored sessions --------------------------------------------------------------------

SESSION = "conv_id long, turns array<struct<turn:bigint,role:string,text:string>>, created_at string, updated_at string, bucket int"
BUCKETS = 64


def session_store(spark, path: str) -> Stored:
    """Sessions in buckets by a hash of their id."""
    return Stored(spark, path, SESSION, by="bucket")


def upsert(store: Stored, turns: DataFrame, batch: int, now: str, writer: str = "sessions", n: int = MAX_TURNS) -> bool:
    """Adds turns (conv_id, turn, role, text) to stored sessions; a batch that is stored already changes nothing.

    Only the buckets of the batch's sessions are read and written again. ``created_at`` of a
    session stays, ``updated_at`` is that of its last batch, and its last ``n`` turns are kept.
    """
    bucket = F.pmod(F.xxhash64("conv_id"), F.lit(BUCKETS)).cast("int")
    fresh = session_tail(turns.select("conv_id", "turn", "role", "text"), n)
    touched = [r[0] for r in fresh.select(bucket.alias("bucket")).distinct().collect()]  # BUCKETS at most
    before = store.read().filter(F.col("bucket").isin(touched)).drop("bucket")
    return store.write(session_append(before, fresh, F.lit(now), n).withColumn("bucket", bucket), batch=(writer, batch))


def upsert_stream(store: Stored, now: Callable[[int], str], writer: str = "sessions") -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``; ``now`` gives the time of a batch by its number."""

    def step(turns: DataFrame, batch: int) -> None:
        upsert(store, turns, batch, now(batch), writer)

    return step
