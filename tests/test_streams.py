"""Streams against the batch results over the same events."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import functions as F

from lendwright.operators import runlogs
from lendwright.session import scratch_path
from lendwright.streaming import run_state, usage_windows


def test_intervals():
    rng = random.Random(1)
    for _ in range(50):
        intervals, seen = [], set()
        for _ in range(60):
            k = rng.randrange(40)
            assert run_state.add_sequence(intervals, k) == (k not in seen)
            seen.add(k)
        assert [x for a, b in intervals for x in range(a, b + 1)] == sorted(seen)
        assert all(b + 1 < c for (_, b), (c, _) in zip(intervals, intervals[1:]))


def written(spark, rows, schema, waves):
    source = scratch_path(spark, "waves")
    for own in waves:
        spark.createDataFrame([rows[i] for i in own], schema).coalesce(1).write.mode("append").parquet(source)
    return source


def test_run_state_equals_batch(spark):
    """Events in any order, doubled, without sequence or id; a second start continues where the first one stopped."""
    rng = random.Random(5)
    rows = [(f"r{k % 7}", 1 + k // 7, f"e{k}", "running") for k in range(140)]
    rows += [("r1", 5, "e-other", "failed"), ("r2", 21, "e3", "done"), ("r3", None, "e-null", "x"), ("r4", 21, None, "x"), ("r5", 40, "far", "succeeded")]
    rows += [("r6", 21, "e6", "succeeded")]
    order = list(range(len(rows)))
    rng.shuffle(order)
    schema = "run string, seq long, id string, status string"
    source = written(spark, rows, schema, [order[:50], order[50:60], order[60:]])
    target, cursor = scratch_path(spark, "facts"), scratch_path(spark, "cursor")

    def catch_up():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        run_state.follow(run_state.run_facts(stream), target, cursor).awaitTermination()
        return sorted(tuple(r) for r in run_state.current_runs(spark, target).drop("silent").collect())

    def batch(events):
        found = runlogs.event_integrity(spark.createDataFrame(events, schema), "run")
        names = ["run", "n_events", "first_seq", "last_seq", "last_status", "contiguous", "unique_ids"]
        return sorted(tuple(r) for r in found.select(*names).collect())

    assert catch_up() == batch(rows)
    more = [("r0", 21, "new", "succeeded"), ("r9", 1, "one", "running")]
    spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(source)
    assert catch_up() == batch(rows + more)


class OneState:
    """What a keyed state does, for one key."""

    def __init__(self):
        self.value, self.hasTimedOut, self.wait = None, False, None

    @property
    def exists(self):
        return self.value is not None

    @property
    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def setTimeoutDuration(self, ms):
        self.wait = ms


def test_silence_and_forgotten_ids():
    check, state = run_state._checked(2, 5000), OneState()
    part = pd.DataFrame({"seq": [1, 2, 3], "id": ["a", "b", "c"], "status": ["x"] * 3})
    (first,) = check(("r",), iter([part]), state)
    assert first.iloc[0].contiguous and not first.iloc[0].silent and state.wait == 5000
    state.hasTimedOut = True
    (silent,) = check(("r",), iter([]), state)
    assert silent.iloc[0].silent and silent.iloc[0].n_events == 3
    state.hasTimedOut = False
    (again,) = check(("r",), iter([pd.DataFrame({"seq": [4], "id": ["a"], "status": ["x"]})]), state)
    assert again.iloc[0].unique_ids
    (kept,) = check(("r",), iter([pd.DataFrame({"seq": [5], "id": ["a"], "status": ["x"]})]), state)
    assert not kept.iloc[0].unique_ids


def test_window_sums_and_late_rows_equal_batch(spark):
    rng = random.Random(2)
    start = pd.Timestamp("2024-03-01")
    rows = [((start + pd.Timedelta(minutes=rng.randrange(3000))).to_pydatetime(), rng.choice("ab"), rng.randrange(100)) for _ in range(400)]
    rows.append((None, "a", 5))
    schema = "at timestamp_ntz, kind string, tokens long"
    events = spark.createDataFrame(rows, schema)
    source = written(spark, rows, schema, [range(0, 150), range(150, 160), range(160, 401)])
    target, cursor = scratch_path(spark, "sums"), scratch_path(spark, "cursor")

    def catch_up():
        usage_windows.windowed_usage(
            spark, source, events.schema, target, cursor, time="at", keys=["kind"], amount=F.col("tokens"), delay="5 hours", files_per_batch=1
        ).awaitTermination()

    catch_up()
    catch_up()
    late = usage_windows.late_rows(spark, target, events.schema)
    hour = F.window("at", "1 hour")["start"].alias("window_start")
    sums = (F.count("*").alias("requests"), F.sum("tokens").alias("amount"))
    both = usage_windows.window_totals(spark, target, ["kind"]).unionByName(late.groupBy(hour, "kind").agg(*sums))
    both = both.groupBy("window_start", "kind").agg(F.sum("requests"), F.sum("amount"))
    want = events.groupBy(hour, "kind").agg(*sums)
    assert late.count() > 20
    assert sorted(map(tuple, both.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_integrity_stream_resumes_wave_by_wave(spark, tmp_path, monkeypatch):
    """The query follows four waves, resuming from its cursor; the facts are those of the batch check."""
    from lendwright.plans import queries_logs

    conversations = [(c, t, "assistant" if t % 2 else "user", "x") for c in range(40) for t in range(c % 7 + 1)]
    frame = spark.createDataFrame(conversations, "conv_id long, turn long, role string, text string")
    frame.repartition(4).write.parquet(str(tmp_path / "conversations.parquet"))
    waves = []
    plain = queries_logs.run_state.run_facts
    monkeypatch.setattr(queries_logs.run_state, "run_facts", lambda s: waves.append(s) or plain(s))
    got = {r["run"]: r for r in queries_logs.n1_stream(spark, str(tmp_path)).collect()}
    want = queries_logs.n1(spark, str(tmp_path)).collect()
    assert len(waves) == 4 and len(got) == len(want) == 40
    for row in want:
        for name in ("n_events", "first_seq", "last_seq", "last_status", "contiguous", "unique_ids"):
            assert got[str(row["run"])][name] == row[name]
