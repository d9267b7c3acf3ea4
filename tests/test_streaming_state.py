"""Stateful winner counts against batches, with rows in any order."""

import os
import subprocess
import sys
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lumifuzz.functions.membership import Trapezoid, Variable
from lumifuzz.operators.rules import Rule, RuleBase
from lumifuzz.streaming import state

SETS = (Trapezoid("Low", (0, 0, 0.3, 0.6), domain=(0, 1)), Trapezoid("High", (0.3, 0.6, 1, 1), domain=(0, 1)))
BASE = RuleBase((Variable("value", SETS),), (Rule((0,), 0), Rule((1,), 1)), ("low", "high"), 1)
KIND = "event_id long, ts timestamp, value double, kind string"


def batch(rows):
    """Counts by key, day and winner, row by row."""
    out = {}
    for _, ts, value, key in rows:
        if ts is None:
            continue
        low, high = (float(np.nan_to_num(s.at(np.array([np.nan if value is None else value]))[0])) for s in SETS)
        at = (key, ts.replace(hour=0, minute=0, second=0, microsecond=0), int(high > low))
        n, doubtful = out.get(at, (0, 0))
        out[at] = (n + 1, doubtful + (max(low, high) < 0.7))
    return out


def counted(df):
    return {(r["key"], r["window_start"], r["winner"]): (r["n"], r["doubtful"]) for r in df.collect()}


def write(spark, rows, path):
    spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(path)


def test_counts_of_a_stream_are_those_of_a_batch(spark, tmp_path):
    draw = np.random.default_rng(1)
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(minutes=int(30 * i + draw.integers(0, 200))), float(draw.random()), "ab"[int(draw.random() < 0.8)]) for i in range(600)]
    rows += [(1000, None, 0.5, "a"), (1001, start, None, None), (1002, start, 0.4, None)]
    source, folder = f"file://{tmp_path}/source", f"file://{tmp_path}/out"
    for part in (rows[:200], rows[200:400]):
        write(spark, part, source)
    options = {"time": "ts", "key": "kind", "folder": folder, "doubt": 0.7}
    first = state.run(state.read_table(spark, source), BASE, **options)
    assert counted(state.totals(first)) == batch(rows[:400])
    # the state goes on from where it was
    write(spark, rows[400:], source)
    told = state.run(state.read_table(spark, source), BASE, **options)
    assert counted(state.totals(told)) == batch(rows)
    # rows without a value came when their day had been closed
    assert {r["key"] for r in told.where("kind = 'late'").collect()} == {None}
    # every day but those that the watermark has not passed is closed, once, with its last counts
    closed = counted(told.where("kind = 'closed'"))
    last = max(ts for _, ts, _, _ in rows if ts) - timedelta(hours=1)
    assert closed == {k: v for k, v in batch([r for r in rows if r[3]]).items() if k[1] + timedelta(days=1) <= last}
    assert told.where("kind = 'closed'").groupBy("key", "window_start", "winner").count().where("count > 1").count() == 0


def test_drift_is_the_distance_from_closed_days(spark, tmp_path):
    day = [datetime(2024, 1, d, 12) for d in (1, 2, 3, 9)]
    rows = [(0, day[0], 0.1, "k"), (1, day[0], 0.1, "k"), (2, day[0], 0.9, "k"), (3, day[1], 0.9, "k"), (4, day[2], 0.1, "k"), (5, day[3], 0.1, "k")]
    source = f"file://{tmp_path}/source"
    write(spark, rows, source)
    told = state.run(state.read_table(spark, source), BASE, "ts", "kind", folder=f"file://{tmp_path}/out")
    drift = {r["window_start"].day: r["drift"] for r in told.where("kind = 'closed'").select("window_start", F.col("drift")).distinct().collect()}
    assert drift == {1: None, 2: pytest.approx(2 / 3), 3: pytest.approx(0.5)}


def test_settings_of_the_session_are_left_as_they_were(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get(state._PROVIDER)
    source = f"file://{tmp_path}/source"
    write(spark, [(0, datetime(2024, 1, 1), 0.1, "k")], source)
    assert state.totals(state.run(state.read_table(spark, source), BASE, "ts", "kind", folder=f"file://{tmp_path}/out")).count() == 1
    assert (spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get(state._PROVIDER)) == before


def test_runs_where_the_session_leaves_the_number_of_partitions_at_its_default(spark, tmp_path):
    source, name = f"file://{tmp_path}/source", "spark.sql.shuffle.partitions"
    write(spark, [(0, datetime(2024, 1, 1), 0.1, "k")], source)
    before = spark.conf.get(name)
    spark.conf.unset(name)
    try:
        assert state.totals(state.run(state.read_table(spark, source), BASE, "ts", "kind", folder=f"file://{tmp_path}/out")).count() == 1
        assert spark.conf.get(name, None) is None
    finally:
        spark.conf.set(name, before)


def test_the_processor_loads_where_the_library_is_not(tmp_path):
    (tmp_path / "processor").write_bytes(cloudpickle.dumps(state.Winners(1000)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = "import importlib.util, pickle; assert not importlib.util.find_spec('lumifuzz'); print(pickle.load(open('processor', 'rb')).size)"
    ran = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert ran.stdout.split() == ["1000"], ran.stderr[-500:]


def test_times_beyond_those_of_pandas_are_counted(spark, tmp_path):
    rows = [(0, datetime(1, 1, 2, 5), 0.1, "k"), (1, datetime(2024, 1, 1), 0.9, "k"), (2, datetime(9999, 12, 30, 23), 0.9, "k"), (3, datetime(9999, 12, 30, 22), 0.5, "k")]
    source = f"file://{tmp_path}/source"
    write(spark, rows, source)
    told = state.run(state.read_table(spark, source), BASE, "ts", "kind", folder=f"file://{tmp_path}/out", doubt=0.7)
    assert counted(state.totals(told)) == batch(rows)


def test_small_files_share_a_micro_batch(spark, tmp_path):
    source = f"file://{tmp_path}/source"
    rows = [(i, datetime(2024, 1, 1 + i), 0.1, "k") for i in range(5)]
    for row in rows:
        write(spark, [row], source)
    told = state.run(state.read_table(spark, source), BASE, "ts", "kind", folder=f"file://{tmp_path}/out")
    assert told.where("kind = 'running'").select("batch").distinct().count() == 1
    # files of more than the limit come one by one, to the same counts
    apart = state.run(state.read_table(spark, source, 1), BASE, "ts", "kind", folder=f"file://{tmp_path}/apart")
    assert apart.where("kind <> 'closed'").select("batch").distinct().count() == 5
    assert counted(state.totals(told)) == counted(state.totals(apart)) == batch(rows)
