"""Late dropping, run-time lateral, and a folded state that outlives its batch."""

import random
import shutil

import pytest

from spanloom.errors import DialectError
from spanloom.streaming import streams
from spanloom.streaming.lateness import Judge, drop_late
from spanloom.streaming.lateral import per_message


def test_judge_steady():
    """A steady feed passes whole; a row that comes a second late is dropped, the next passes."""
    r, judge = random.Random(1), Judge(0.5, 2.0)
    out = [judge.row(k / 30 + 0.1 + r.random() * 0.004, k / 30) for k in range(900)]
    assert all(out)
    assert judge.bound < 0.1 and judge.spread < 0.05
    assert not judge.row(900 / 30 + 1.2, 900 / 30)
    assert judge.row(901 / 30 + 1.21 - 1.0 + 1.0 - 1.1, 901 / 30)


def test_judge_bursts():
    """Groups of a second handed on at once teach their width."""
    judge = Judge(0.5, 2.0)
    out = [judge.row(g + 1 + k * 0.001, g + k / 30) for g in range(8) for k in range(30)]
    assert all(out) and 0.8 < judge.spread < 1.1


def test_judge_state():
    a, b, r = Judge(), Judge(), random.Random(2)
    for k in range(200):
        at = (k * 0.04 + r.random() * (2 if k % 40 == 0 else 0.02), k * 0.04)
        b = Judge().load(b.save())
        assert a.row(*at) == b.row(*at)
    with pytest.raises(DialectError):
        Judge(0)


def test_drop_late(spark, tmp_path):
    rows = [(key, k / 10 + 0.1 + (3.0 if key and k == 70 else 0), k / 10) for key in (0, 1) for k in range(100)]
    spark.createDataFrame(rows, "k int, a double, t double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, a double, t double").parquet(str(tmp_path / "in"))
    got = streams.drain(drop_late(stream, ["k"], "a", "t")).collect()
    assert len(got) == 199 and not [r for r in got if r.k == 1 and r.t == 7.0]


def test_per_message(spark):
    seen = []
    m = spark.createDataFrame([(2.0, 3.0), (0.0, 1.0)], "s double, z double")
    per_message(m, ["s"], lambda row, n: seen.append((row.s, n)), ("s", "z"))
    assert seen == [(0.0, 0), (2.0, 1)]
    with pytest.raises(DialectError, match="overlaps"):
        per_message(spark.createDataFrame([(0.0, 3.0), (2.0, 4.0)], "s double, z double"), ["s"], lambda *_: None, ("s", "z"))


def test_fold_over_batches(spark, tmp_path):
    for b in range(3):
        spark.createDataFrame([(1, b * 10 + i) for i in range(4)], "k int, i int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, i int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def step(now, row):
        now["n"] += 1
        return [(row.i, now["n"])]

    got = streams.drain(streams.KeyedFold(step, {"n": 0}, "i int, n int", "n int", ["i"])(stream, ["k"])).collect()
    assert sorted(r.n for r in got) == list(range(1, 13))


def test_stream_of_part_files(spark, tmp_path):
    """A folder of part files streams whole, a single file by its own name; a neighbour with the same prefix stays out."""
    from spanloom.plans.queries import QUERIES

    whole = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    (tmp_path / "folder").mkdir()
    (tmp_path / "file").mkdir()
    whole.repartition(3).write.parquet(str(tmp_path / "folder/events.parquet"))
    shutil.copy("/root/testdata/sf0.001/events.parquet", tmp_path / "file/events.parquet")
    for place in ("folder", "file"):
        shutil.copy("/root/testdata/sf0.01/events.parquet", tmp_path / place / "events_old.parquet")
        got = streams.drain(streams.events(spark, str(tmp_path / place)))
        assert sorted(r.event_id for r in got.select("event_id").collect()) == sorted(r.event_id for r in whole.select("event_id").collect())
    for name in ("stream_tumbling", "stream_hold"):
        assert sorted(map(repr, QUERIES[name](spark, str(tmp_path / "folder")).collect())) == sorted(map(repr, QUERIES[name](spark, "/root/testdata/sf0.001").collect()))
