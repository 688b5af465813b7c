"""Session tracking over turns (session_id, ts, user, reply): idle expiry and the last turns kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from wireloom.operators.scale import carry_forward, top_k

TTL = 3600
LAST_N = 20


def sessions(turns: DataFrame, ttl: int = TTL, last_n: int = LAST_N) -> DataFrame:
    """Batch form: one row per session episode with its turn count and how many turns are kept.

    A gap of `ttl` seconds or more starts a new episode. The previous turn is carried over day slices,
    so a single busy session is not sorted in one task.
    """
    t = turns.select("session_id", "ts", "turn_id")
    day = F.to_date("ts")
    key = [F.col("ts"), F.col("turn_id")]
    # previous turn: last value strictly before, so carry the turn's own time from the row ahead
    w = Window.partitionBy("session_id", "_day").orderBy(*key)
    t = t.withColumn("_day", day).withColumn("_lag", F.lag("ts").over(w))
    last = t.groupBy("session_id", "_day").agg(F.max("ts").alias("_last"))
    over = Window.partitionBy("session_id").orderBy("_day")
    last = last.select("session_id", "_day", F.lag("_last").over(over).alias("_prev_day"))
    t = t.join(last, ["session_id", "_day"]).withColumn("prev", F.coalesce("_lag", "_prev_day"))
    gap = F.unix_micros("ts") - F.unix_micros("prev")
    new = F.col("prev").isNull() | (gap >= ttl * 1_000_000)
    t = carry_forward(t.drop("_lag", "_prev_day"), ["session_id"], F.col("_day"), key, F.when(new, F.col("ts")), "started")
    g = t.groupBy("session_id", "started").agg(F.max("ts").alias("last_used"), F.count(F.lit(1)).alias("turns"))
    return g.withColumn("kept_turns", F.least("turns", F.lit(last_n)).cast("long"))


def last_turns(turns: DataFrame, last_n: int = LAST_N) -> DataFrame:
    """The newest turns of every session; each task keeps at most `last_n` per session."""
    return top_k(turns, ["session_id"], [F.col("ts").desc(), F.col("turn_id").desc()], last_n, "age")


def stream_sessions(stream: DataFrame, ttl: int = TTL, late: str = "10 minutes") -> DataFrame:
    """Streaming form: a session closes `ttl` seconds after its last turn; turns behind the watermark are dropped."""
    w = F.session_window("ts", f"{ttl} seconds")
    return (stream.withWatermark("ts", late).groupBy("session_id", w).agg(F.count(F.lit(1)).alias("turns"), F.max("ts").alias("last_used"))
            .select("session_id", F.col("session_window.start").alias("started"), "last_used", "turns"))


# ------------------------------------------------------------------ last turns of live sessions
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_KEPT = "session_id {kind}, started long, last_used long, turns long, turn_id long, ts long, age int"


class _Episodes(StatefulProcessor):
    """Open episodes of one session, each with its newest turns. Times are microseconds.

    A turn joins every episode that it is less than `ttl` away from, so episodes that it bridges become one. An episode
    ends with the timer at its last turn plus `ttl`, which the watermark fires; only then are its turns put out.
    """

    def __init__(self, ttl: int, last_n: int):
        self.gap, self.last_n = ttl * 1_000_000, last_n

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getListState("episodes", "started long, last_used long, turns long, ts array<long>, ids array<long>")

    def _merged(self, episodes: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        for started, last, n, kept in sorted(episodes):
            if out and started - out[-1][1] < self.gap:
                a = out[-1]
                out[-1] = (a[0], max(a[1], last), a[2] + n, sorted(a[3] + kept)[-self.last_n:])
            else:
                out.append((started, last, n, kept))
        return out

    def _stored(self) -> list[tuple]:
        return [(int(s), int(e), int(n), [(int(t), int(i)) for t, i in zip(ts, ids, strict=True)]) for s, e, n, ts, ids in self.open.get()]

    def _store(self, episodes: list[tuple]) -> None:
        if episodes:
            self.open.put([(s, e, n, [t for t, _ in kept], [i for _, i in kept]) for s, e, n, kept in episodes])
            for e in episodes:
                self.handle.registerTimer(-(-(e[1] + self.gap) // 1000))
        else:
            self.open.clear()

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        episodes = self._stored()
        for df in rows:  # a busy session comes in pieces, and each is cut down to its newest turns before the next
            new = [(int(t), int(t), 1, [(int(t), int(i))]) for t, i in zip(df["us"], df["turn_id"], strict=True)]
            episodes = self._merged(episodes + new)
        self._store(episodes)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        now, done, left = timerValues.getCurrentWatermarkInMs(), [], []
        for e in self._stored():
            (done if -(-(e[1] + self.gap) // 1000) <= now else left).append(e)
        if left:
            self.open.put([(s, e, n, [t for t, _ in kept], [i for _, i in kept]) for s, e, n, kept in left])
        else:
            self.open.clear()
        yield pd.DataFrame([(key[0], s, last, n, i, t, age) for s, last, n, kept in done for age, (t, i) in enumerate(reversed(kept), 1)],
                           columns=["session_id", "started", "last_used", "turns", "turn_id", "ts", "age"])

    def close(self) -> None:
        pass


def stream_last_turns(stream: DataFrame, ttl: int = TTL, last_n: int = LAST_N, late: str = "10 minutes") -> DataFrame:
    """(session_id, started, last_used, turns, turn_id, ts, age): the newest `last_n` turns of every closed session, newest
    first (ties: the larger turn id), as `sessions` and `last_turns` give them for a table.

    State is one row per open episode with at most `last_n` turns, whatever the session's length. Turns behind the
    watermark are dropped, idle sessions end `ttl` seconds after their last turn. The state store has to hold lists and
    timers, so the session is set to one that does.
    """
    stream.sparkSession.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = stream.schema["session_id"].dataType.simpleString()
    out = (stream.withWatermark("ts", late).select("session_id", "ts", F.unix_micros("ts").alias("us"), "turn_id").groupBy("session_id")
           .transformWithStateInPandas(_Episodes(ttl, last_n), _KEPT.format(kind=kind), "append", "eventTime"))
    return out.select("session_id", *[F.timestamp_micros(c).alias(c) for c in ("started", "last_used")], "turns", "turn_id", F.timestamp_micros("ts").alias("ts"), "age")
