"""Timers of silent clients: against a plain version, over batches in any order, and over a restart by the clock."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from framewright.streaming import heartbeats, queue

from .test_streams import files

SECOND = 1_000_000
START = 1_700_000_000 * SECOND


def plain(beats, patience, until):
    """News of one client from its sorted beats, told up to a moment."""
    out, pauses = [], patience.pauses()
    for b, after in zip(beats, [*beats[1:], None], strict=True):
        if after is not None and after - b <= pauses[0]:
            continue
        told = [b + p for p in pauses if after is None or b + p < after]
        out += [(at, "lost" if not i else "retry" if i < len(pauses) - 1 else "given_up", min(i, len(pauses) - 2)) for i, at in enumerate(told)]
        if after is not None and len(told) < len(pauses):
            out.append((after, "back", len(told) - 1))
    return sorted(x for x in out if x[0] <= until)


def test_pauses_double_up_to_the_longest():
    assert [p / SECOND for p in heartbeats.Patience().pauses()] == [30, 31, 33, 37, 45, 61, 91]


def test_settling_at_any_moments_tells_the_same():
    rng = random.Random(4)
    patience = heartbeats.Patience(silence=5, first_pause=1, longest_pause=3, attempts=3)
    for _ in range(300):
        beats = sorted(rng.randrange(0, 80) * SECOND for _ in range(rng.randint(1, 12)))
        starts, ends, tried, got, given = [], [], 0, [], 0
        for until in sorted(rng.randrange(0, 120) * SECOND for _ in range(6)) + [200 * SECOND]:
            known = [b for b in beats[given:] if b <= until]
            given += len(known)
            rng.shuffle(known)
            starts, ends = heartbeats.merged(starts, ends, np.array(known, dtype=np.int64), 5 * SECOND)
            news, tried, _ = heartbeats.settle(starts, ends, tried, until, patience)
            got += news
        assert sorted(got) == plain(beats, patience, 200 * SECOND) and not starts


def test_beats_in_any_order_over_batches(spark, tmp_path):
    """A hot client and small ones, delivered out of order within the delay; a client that is silent gets its news from the watermark alone."""
    rng = random.Random(8)
    patience = heartbeats.Patience(silence=20, first_pause=5, longest_pause=20, attempts=2)
    beats = {0: [n * 100_000 for n in range(9_000)], 1: [0]} | {c: sorted(rng.randrange(0, 900) * SECOND for _ in range(12)) for c in range(2, 8)}
    beats = {c: [START + b for b in own] for c, own in beats.items()}
    rows = sorted((b, c) for c, own in beats.items() for b in own)
    batches = []
    for low in range(START, START + 900 * SECOND, 300 * SECOND):
        part = [(c, b) for b, c in rows if low <= b < low + 300 * SECOND]
        rng.shuffle(part)
        batches.append(part)
    batches[1].append((None, START))
    stream = files(spark, tmp_path, batches, "client long, micros long").select("client", F.timestamp_micros("micros").alias("ts"))
    got = queue.drained(heartbeats.watched(stream, patience, "10 seconds"), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    until = rows[-1][0] // 1000 * 1000 - 10 * SECOND
    want = {(c, *x) for c, own in beats.items() for x in plain(own, patience, until)}
    assert {tuple(r) for r in got.select("client", F.unix_micros("at"), "event", "attempt").collect()} == want and got.count() == len(want)
    assert [x[1] for x in sorted(want) if x[0] == 1] and {x[2] for x in want if x[0] == 1} == {"lost", "retry", "given_up"}


def test_a_silent_client_is_lost_once_by_the_clock(spark, tmp_path):
    """No further input, and the query is stopped and started again between the beat and the end of the silence."""
    patience = heartbeats.Patience(silence=6, first_pause=60, longest_pause=60, attempts=1)
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1,), (2,)], "client long").withColumn("ts", F.current_timestamp()).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = queue.source(spark, str(tmp_path / "in"), "client long, ts timestamp")

    def write(batch, number):
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number:06d}")

    def start():
        return queue.push(heartbeats.watched(stream, patience, None), write, f"{tmp_path}/checkpoint", every="1 second")

    def told():
        found = list(tmp_path.glob("out/batch=*/*.parquet"))
        return sorted((r["client"], r["event"]) for r in spark.read.schema(heartbeats.NEWS).parquet(f"{tmp_path}/out/batch=*").collect()) if found else []

    run = start()
    while not run.lastProgress:
        time.sleep(0.2)
    run.stop()
    run = start()
    end = time.monotonic() + 60
    while len(told()) < 2 and time.monotonic() < end:
        time.sleep(0.5)
    time.sleep(3)  # further timers would tell more
    run.stop()
    assert told() == [(1, "lost"), (2, "lost")]
