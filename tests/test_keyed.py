"""Tables changed in place: which folders a change touches, odd keys, versions, counts by signed sums."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsloom.operators.keyed import Keyed, Versions
from newsloom.operators.tallies import Tallies, signed


def files(folder):
    return {p.relative_to(folder): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_a_change_leaves_other_folders_as_they_were(spark, tmp_path):
    t = Keyed(spark, str(tmp_path / "t"), "id long, s string", "id", parts=16)
    t.create(spark.range(500).select("id", F.lit("a").alias("s")))
    before = files(tmp_path / "t")
    t.update(F.col("id") == 7, keys=[7], s="b")
    after = files(tmp_path / "t")
    assert len({p.parts[0] for p in before}) == 16 and len({p.parts[0] for p in before.keys() ^ after.keys()}) == 1
    assert rows(t.get(7)) == [(7, "b")] and rows(t.get(8, 500)) == [(8, "a")] and t.read().count() == 500
    assert {f.split("part=")[1].split("/")[0] for f in t.get(7).inputFiles()} == {p.parts[0].removeprefix("part=") for p in before.keys() ^ after.keys()}
    t.upsert(spark.createDataFrame([(7, "c", 1), (900, "n", 2)], "id int, s string, more int"))  # keys of another type, a further column
    assert rows(t.get(7, 900)) == [(7, "c"), (900, "n")] and t.read().count() == 501
    now = files(tmp_path / "t")
    t.update(F.col("s") == "none", s="z")
    t.upsert(t.read().limit(0))
    t.delete(spark.range(0))
    assert files(tmp_path / "t") == now
    with pytest.raises(ValueError, match="key"):
        t.update(F.lit(True), id=1)


def test_null_keys_and_emptied_folders(spark, tmp_path):
    t = Keyed(spark, str(tmp_path / "t"), "id long, s string", "id", parts=4)
    t.create(spark.createDataFrame([], "id long, s string"))
    assert rows(t.read()) == []
    t.upsert(spark.createDataFrame([(None, "x"), (1, None)], "id long, s string"))
    t.upsert(spark.createDataFrame([(None, "y"), (2, "q")], "id long, s string"), update=False)
    assert rows(t.read()) == [(1, None), (2, "q"), (None, "x")]
    t.upsert(spark.createDataFrame([(None, "y")], "id long, s string"))
    assert rows(t.get(None)) == [(None, "y")] and rows(t.get(1, None)) == [(1, None), (None, "y")]
    t.delete(spark.createDataFrame([(None,), (1,), (1,), (2,)], "id long"))
    assert rows(t.read()) == []


def test_versions(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "v"), "id long, s string", "id", parts=4)
    batch = lambda *r: spark.createDataFrame(r, "id long, s string")
    v.append(batch((1, "a"), (2, "b"), (None, "n")), "01")
    before = files(tmp_path / "v")
    v.append(batch((1, "d"), (1, "c"), (None, "m")), "02", ["s"])
    assert before.items() <= files(tmp_path / "v").items()
    want = [(1, "a", 1), (1, "c", 2), (1, "d", 3), (2, "b", 1), (None, "m", 2), (None, "n", 1)]
    assert rows(v.read()) == want
    v.append(batch((1, "d"), (1, "c"), (None, "m")), "02", ["s"])  # the same batch again
    assert rows(v.read()) == want
    assert rows(v.latest(1)) == [(1, "d", 3)] and rows(v.latest(1, 2, k=2)) == [(1, "c", 2), (1, "d", 3), (2, "b", 1)]


def test_tallies_follow_changes(spark, tmp_path):
    rng, at = random.Random(3), datetime(2024, 1, 1)
    one = lambda: (rng.choice("ab") if rng.random() < 0.9 else None, at + timedelta(minutes=rng.randrange(300)) if rng.random() < 0.9 else None)
    df = lambda states: spark.createDataFrame(states, "g string, ts timestamp")
    t, state = Tallies(spark, str(tmp_path / "t"), ["g"], parts=4), {}
    for batch in range(3):
        changed = {k: one() if rng.random() < 0.7 else None for k in rng.sample(range(60), 30)}
        old = [state[k] for k in changed if k in state]
        new = [s for s in changed.values() if s is not None]
        for _ in range(2 if batch == 1 else 1):  # one batch runs twice
            t.add(signed(df(old), df(new), ["g"], "ts"), f"{batch}")
        state = {k: s for k, s in {**state, **changed}.items() if s is not None}
    want = {}
    for g, ts in state.values():
        hour = ts and ts.replace(minute=0)
        want[g, hour] = want.get((g, hour), 0) + 1
    assert {(r.g, r.hour): r.n for r in t.read().collect()} == want
