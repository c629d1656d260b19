"""Window scenarios: the batch evaluator and the streaming operator, which must agree with each other and with a simulation."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logweir.operators import windows
from logweir.streaming.windows import WindowOperator

T0 = datetime(2024, 3, 1)


def frame(spark, batches):
    rows, n = [], 0
    for b, times in enumerate(batches):
        for t in times:
            n += 1
            rows.append((n, T0 + timedelta(seconds=t), b, float(t)))
    return spark.createDataFrame(rows, "global_offset long, ts timestamp, batch int, value double")


def simulated(batches, size, slide, grace, policy):
    slide = min(slide or size, size)
    wm, open_, closed, out, n = None, {}, {}, [], 0
    for times in batches:
        before = wm
        for t in times:
            n += 1
            s = t // slide * slide
            while s > t - size:
                if before is not None and before >= s + size + grace:
                    if policy == "REOPEN" and s in closed:
                        closed[s] += 1
                        out.append((s, closed[s], False))
                else:
                    open_[s] = open_.get(s, 0) + 1
                s -= slide
        wm = max([x for x in (wm, *times) if x is not None], default=None)
        for s in sorted(open_):
            if wm >= s + size + grace:
                out.append((s, open_[s], True))
                closed[s] = open_.pop(s)
        closed = {s: v for s, v in closed.items() if not wm > s + size + 2 * grace}
    return sorted(out)


def batch_result(spark, batches, size, slide, grace, policy):
    events = frame(spark, batches)
    if policy == "REOPEN":
        rows = windows.reopened(events, size, slide, grace).collect()
        return sorted((int((r["window_start"] - T0).total_seconds()), r["state"], r["is_final"]) for r in rows)
    rows = windows.finals(events, {"state": F.count("*")}, size, slide, grace, batched=True).collect()
    return sorted((int((r["window_start"] - T0).total_seconds()), r["state"], True) for r in rows)


def stream_result(spark, path, batches, size, slide, grace, policy):
    op = WindowOperator(spark, str(path), {"state": ("count", "*")}, size, slide, grace, policy)
    events, out = frame(spark, batches), []
    for b in range(len(batches)):
        out += op.process(events.where(F.col("batch") == b)).collect()
    return sorted((int((r["window_start"] - T0).total_seconds()), r["state"], r["is_final"]) for r in out)


SCENARIOS = {
    "tumbling close": ((600, None, 0, "REOPEN"), [[60, 120, 180, 700]], [(0, 3, True)]),
    "nothing": ((60, None, 0, "REOPEN"), [[]], []),
    "watermark is the largest time": ((60, None, 0, "REOPEN"), [[30, 120]], [(0, 1, True)]),
    "disorder in a batch is not late": ((60, None, 0, "REOPEN"), [[30, 90, 45, 130]], [(0, 2, True), (60, 1, True)]),
    "sliding": ((120, 60, 0, "REOPEN"), [[90, 240]], [(0, 1, True), (60, 1, True)]),
    "late inside grace": ((60, None, 120, "REOPEN"), [[30, 90, 45, 240]], [(0, 2, True), (60, 1, True)]),
    "dropped": ((60, None, 10, "DROP"), [[30, 80], [40]], [(0, 1, True)]),
    "reopened": ((60, None, 10, "REOPEN"), [[30, 80], [40]], [(0, 1, True), (0, 2, False)]),
    "evicted": ((60, None, 10, "REOPEN"), [[30, 81], [40]], [(0, 1, True)]),
    "slide beyond size": ((60, 300, 0, "REOPEN"), [[70, 200]], [(60, 1, True)]),
}


@pytest.mark.parametrize("name", SCENARIOS)
def test_scenarios(spark, tmp_path, name):
    args, batches, want = SCENARIOS[name]
    assert simulated(batches, *args) == sorted(want)
    assert batch_result(spark, batches, *args) == sorted(want)
    assert stream_result(spark, tmp_path / "w", batches, *args) == sorted(want)


@pytest.mark.parametrize("seed", range(4))
def test_random_batches(spark, tmp_path, seed):
    rng = random.Random(seed)
    size = rng.choice([20, 30, 60])
    args = size, rng.choice([None, 10, 90]), rng.choice([0, 5, 20]), rng.choice(["DROP", "REOPEN"])
    t, batches = 0, []
    for _ in range(4):
        batches.append([max(0, t + rng.randrange(-60, 40)) for _ in range(rng.randrange(1, 8))])
        t += 40
    want = simulated(batches, *args)
    assert batch_result(spark, batches, *args) == want
    assert stream_result(spark, tmp_path / "w", batches, *args) == want


def test_largest_value_of_earlier_batches(spark, monkeypatch):
    monkeypatch.setattr(windows, "SPAN", 3)
    rows = [(b, (b * 37) % 23) for b in range(-7, 40) if b % 5]
    got = {r["_b"]: r["top"] for r in windows.before(spark.createDataFrame(rows, "batch int, v int"), "batch", "v", "top").collect()}
    assert got == {b: max((v for a, v in rows if a < b), default=None) for b, _ in rows}


def test_redelivered_events_count_once(spark, tmp_path):
    op = WindowOperator(spark, str(tmp_path / "w"), {"n": ("count", "*"), "total": ("sum", "value"), "top": ("max", "value")}, 60, None, 0)
    events = frame(spark, [[10, 20], [130]])
    assert op.process(events.where("batch = 0")).count() == 0
    assert op.process(events.where("batch = 0")).count() == 0
    out = op.process(events).collect()
    assert [(r["n"], r["total"], r["top"], r["is_final"]) for r in out] == [(2, 30.0, 20.0, True)]
    assert op.pointer()["fence"] == 3


def test_a_failed_sink_gets_the_same_emissions_again(spark, tmp_path):
    op = WindowOperator(spark, str(tmp_path / "w"), {"n": ("count", "*")}, 60, None, 0)
    events = frame(spark, [[10, 20], [130], [300]])
    assert op.process(events.where("batch = 0"), 0).count() == 0
    first = op.process(events.where("batch = 1"), 1).collect()
    assert [r["n"] for r in first] == [2] and op.process(events.where("batch = 1"), 1).collect() == first  # the sink failed in between
    assert [r["n"] for r in op.process(events.where("batch = 2"), 2).collect()] == [1] and op.emissions().count() == 2
    seen, fails = [], [True]

    def sink(rows, batch_id):
        if fails.pop() if fails else False:
            raise OSError("no")
        seen.extend(r["n"] for r in rows.collect())

    frame(spark, [[30, 80, 300]]).drop("batch").coalesce(1).write.parquet(str(tmp_path / "in"))
    op = WindowOperator(spark, str(tmp_path / "x"), {"n": ("count", "*")}, 60, None, 0)
    stream = lambda: spark.readStream.schema("global_offset long, ts timestamp, value double").parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="no"):
        op.start(stream(), str(tmp_path / "ck"), sink).awaitTermination()
    op.start(stream(), str(tmp_path / "ck"), sink).awaitTermination()
    assert sorted(seen) == [1, 1]


def test_streaming_query(spark, tmp_path):
    frame(spark, [[30, 80, 300]]).drop("batch").coalesce(1).write.parquet(str(tmp_path / "in"))
    op = WindowOperator(spark, str(tmp_path / "w"), {"n": ("count", "*")}, 60, None, 0)
    stream = spark.readStream.schema("global_offset long, ts timestamp, value double").parquet(str(tmp_path / "in"))
    got = []
    op.start(stream, str(tmp_path / "ck"), lambda rows, _: got.extend(rows.collect())).awaitTermination()
    assert sorted(r["n"] for r in got) == [1, 1]


def test_what_is_refused():
    for bad in ((0, None, 0), (10, 0, 0), (10, None, -1)):
        with pytest.raises(ValueError):
            windows.checked(*bad)
