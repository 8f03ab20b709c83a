"""Heartbeats of clients: who fell silent, when to try again, who came back.

State lives in the state store, one value a client: the runs of beats that aren't settled yet and how often the client
has been tried. A run is a stretch of beats no further apart than the silence that counts as lost, so a client has as
many runs as the watermark's delay has room for, however often it beats. Timers wake a client whose silence ends, with
or without further input; a client that is given up leaves no state behind.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..shipping import ship

NEWS = "client long, at timestamp, event string, attempt int"
STATE = "starts array<long>, ends array<long>, tried int"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Patience:
    """When a client counts as lost and when it is tried again, in seconds. The clients' own defaults."""

    silence: float = 30.0
    first_pause: float = 1.0
    longest_pause: float = 30.0
    attempts: int = 5

    def pauses(self) -> list[int]:
        """Microseconds from the last beat to being lost, to each attempt, and to giving up: the pause doubles up to the longest."""
        steps = [self.silence, *(min(self.first_pause * 2**n, self.longest_pause) for n in range(self.attempts + 1))]
        return [round(1e6 * x) for x in np.cumsum(steps)]


def merged(starts: Sequence[int], ends: Sequence[int], beats: np.ndarray, silence: int) -> tuple[list[int], list[int]]:
    """Runs with further beats: stretches whose gaps are no longer than the silence."""
    order = np.sort(beats)
    cuts = np.flatnonzero(np.diff(order) > silence)
    spans = sorted([*zip(starts, ends, strict=True), *zip(order[np.r_[0, cuts + 1]].tolist(), order[np.r_[cuts, len(order) - 1]].tolist(), strict=True)]) if len(order) else list(zip(starts, ends, strict=True))
    out: list[list[int]] = []
    for s, e in spans:
        if out and s - out[-1][1] <= silence:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [s for s, _ in out], [e for _, e in out]


def settle(starts: list[int], ends: list[int], tried: int, until: int, patience: Patience) -> tuple[list[tuple[int, str, int]], int, int | None]:
    """News (at, event, attempt) of a client up to a moment, what has been told, and when to look again; starts and ends are cut down to what is open.

    ``tried`` counts what has been told of the first run: 1 lost, then the attempts, the last is giving up.
    """
    news: list[tuple[int, str, int]] = []
    pauses = patience.pauses()
    while starts:
        back = starts[1] if len(starts) > 1 else None
        while tried < len(pauses):
            at = ends[0] + pauses[tried]
            if at > until or (back is not None and at >= back):
                break
            news.append((at, "lost" if not tried else "given_up" if tried == len(pauses) - 1 else "retry", tried if tried < len(pauses) - 1 else tried - 1))
            tried += 1
        if tried == len(pauses):  # given up: what comes later begins anew
            del starts[0], ends[0]
        elif back is not None and back <= until:
            news.append((back, "back", max(0, tried - 1)))
            del starts[0], ends[0]
        else:
            waits = [ends[0] + pauses[tried], *([back] if back is not None else [])]
            return news, tried, min(waits)
        tried = 0
    return news, tried, None


class Watch(StatefulProcessor):
    """Beats in, news out. ``by_event``: silence is measured by the beats' own time and the watermark, else by the clock."""

    def __init__(self, patience: Patience, by_event: bool):
        self.patience, self.by_event = patience, by_event

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getValueState("runs", STATE)

    def _look(self, key, starts, ends, tried, until, told=()) -> Iterator[pd.DataFrame]:
        news, tried, again = settle(starts, ends, tried, until, self.patience)
        news = [*told, *news]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if again is None:
            self.runs.clear()
        else:
            self.runs.update((starts, ends, tried))
            self.handle.registerTimer(math.ceil(again / 1000))
        if news:
            at, event, attempt = zip(*news, strict=True)
            yield pd.DataFrame({"client": key[0], "at": pd.to_datetime(list(at), unit="us"), "event": event, "attempt": np.array(attempt, dtype=np.int32)})

    def _now(self, times) -> int:
        return 1000 * (times.getCurrentWatermarkInMs() if self.by_event else times.getCurrentProcessingTimeInMs())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        starts, ends, tried = self.runs.get() if self.runs.exists() else ([], [], 0)
        starts, ends = list(starts), list(ends)
        silence, first = round(1e6 * self.patience.silence), ends[0] if ends else None
        for pdf in rows:
            starts, ends = merged(starts, ends, pdf["micros"].to_numpy(dtype=np.int64), silence)
        told = []
        if tried and ends[0] != first:  # the run goes on, though its end was told: only by the clock, from beats that came late
            told, tried = [(ends[0], "back", tried - 1)], 0
        yield from self._look(key, starts, ends, tried, self._now(timerValues), told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.runs.exists():
            starts, ends, tried = self.runs.get()
            yield from self._look(key, list(starts), list(ends), tried, self._now(timerValues))

    def close(self) -> None:
        pass


def with_store(spark: SparkSession) -> None:
    """The state store that timers need, for streams started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def watched(beats: DataFrame, patience: Patience | None = None, late: str | None = "10 seconds") -> DataFrame:
    """client, at, event, attempt of each change: lost, retry (1 ..), given_up, back; beats have client and ts.

    A client whose next beat comes later than the silence is lost once; attempts follow after pauses that double, until it
    beats again (back, with the number of attempts) or is given up. A beat after that begins anew. With ``late`` time is
    the beats' own, as far as the watermark goes, and beats may come in any order within that delay; with None it is the
    clock, and a trigger at intervals wakes silent clients without input. Beats without client or ts are left out.
    """
    spark = beats.sparkSession
    ship(spark)
    with_store(spark)
    known = beats.select("client", "ts").where("client IS NOT NULL AND ts IS NOT NULL")
    by_event = late is not None
    known = (known.withWatermark("ts", late) if by_event else known).withColumn("micros", F.unix_micros("ts"))
    return known.groupBy("client").transformWithStateInPandas(Watch(patience or Patience(), by_event), NEWS, "append", "eventTime" if by_event else "processingTime")
