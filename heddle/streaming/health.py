"""Node states from heartbeat logs: missed beats by windows, timeouts, and a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEAT_MS = 3000
MOST_MISSED, SUSPICIOUS = 5, 2


def state(missed: Column) -> Column:
    """FAILED over 5 missed beats in a row, SUSPECTED over 2, else OK; null (never seen) is UNKNOWN."""
    return F.when(missed.isNull(), "UNKNOWN").when(missed > MOST_MISSED, "FAILED").when(missed > SUSPICIOUS, "SUSPECTED").otherwise("OK")


def missed_beats(beats: DataFrame, peer: str, at: str, beat_ms: int = BEAT_MS) -> DataFrame:
    """Each beat with the number missed since the peer's last one and the state just before it; a beat resets the count.

    The clock ticks in milliseconds, as in ``states_at``: a gap is the ticks between two beats, not the whole milliseconds that passed.
    """
    w = Window.partitionBy(peer).orderBy(at, *[F.col(c).asc_nulls_last() for c in beats.columns if c not in (peer, at)][:1])
    gap_ms = F.timestamp_diff("MILLISECOND", F.date_trunc("millisecond", "__last"), F.date_trunc("millisecond", at))
    out = beats.withColumn("__last", F.lag(at).over(w)).withColumn("gap_ms", gap_ms)
    out = out.withColumn("missed", F.when(F.col("gap_ms").isNotNull(), F.greatest(F.lit(0), F.floor((F.col("gap_ms") - 1) / beat_ms))))
    return out.withColumn("state", state(F.col("missed"))).drop("__last")


def states_at(beats: DataFrame, peer: str, at: str, now: Column, beat_ms: int = BEAT_MS) -> DataFrame:
    """(peer, last_beat, missed, state) of every peer at one moment; as in ``missed_beats``, a beat is missed once its time has passed."""
    per = beats.groupBy(peer).agg(F.max(at).alias("last_beat"))
    gap = F.floor(F.unix_millis(now.cast("timestamp")) - F.unix_millis(F.col("last_beat").cast("timestamp")))
    return per.withColumn("missed", F.greatest(F.lit(0), F.floor((gap - 1) / beat_ms))).withColumn("state", state(F.col("missed")))


def timed_out(age_ms: Column, suspect_ms: int, failed_ms: int) -> Column:
    """The state of a peer whose last beat is ``age_ms`` old."""
    return F.when(age_ms.isNull(), "UNKNOWN").when(age_ms > failed_ms, "FAILED").when(age_ms > suspect_ms, "SUSPECTED").otherwise("OK")


def stream_states(beats: DataFrame, peer: str, at: str, timeout_ms: int = 3 * BEAT_MS, late: str = "0 seconds") -> DataFrame:
    """A stream of (peer, beats, state): OK at each batch with beats, FAILED once the event time has gone ``timeout_ms`` past a peer's last beat.

    The watermark (``late`` behind the latest beat of any peer) is the clock, so
    a replay of the log gives the same states. A failed peer's state is let go.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = beats.schema[peer].dataType.simpleString()

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        n, last = held.get if held.exists else (0, 0)
        if held.hasTimedOut:
            now = "FAILED"
            held.remove()
        else:
            now = "OK"
            for b in batches:
                n, last = n + len(b), max(last, int(b["__ms"].max()))
            held.update((n, last))
            held.setTimeoutTimestamp(max(last + timeout_ms, held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({peer: [key[0]], "beats": [n], "state": [now]})

    clock = F.col(at).cast("timestamp")
    rows = beats.select(peer, clock.alias("__at"), F.unix_millis(clock).alias("__ms")).withWatermark("__at", late)
    return rows.groupBy(peer).applyInPandasWithState(step, f"{peer} {kind}, beats long, state string", "beats long, last long", "update", GroupStateTimeout.EventTimeTimeout)
