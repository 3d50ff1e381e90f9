"""Keys that were taken before: against a set, with batches that run again and folders that double or merge."""

import os
import random

from newsloom.operators import seen as module
from newsloom.operators.seen import SeenKeys
from newsloom.operators.storage import folders


def _rows(spark, keys):
    return spark.createDataFrame([(k,) for k in keys], "k string")


def _run(spark, seen, keys, batch):
    fresh = [r.k for r in seen.unseen(_rows(spark, keys), "k", batch).collect()]
    seen.add(_rows(spark, fresh), "k", batch)
    return fresh


def test_batches_against_a_set(spark, tmp_path):
    dice, known = random.Random(1), set()
    seen = SeenKeys(spark, str(tmp_path / "seen"), per_part=20, first_parts=2, most_batches=3)
    for n in range(8):
        keys = [f"k{dice.randrange(150)}" for _ in range(30)] + [None, ""]
        want = [k for k in keys if k not in known]
        for _ in range(2 if n % 3 == 0 else 1):  # some run again
            got = _run(spark, seen, keys, f"{n:04d}")
            assert sorted(got, key=str) == sorted(want, key=str)
        known |= {k for k in keys if k is not None}
    assert seen._parts() > 2 and len([x for x in folders(spark, seen.path) if x.startswith("parts=")]) == 1
    assert {r.key for r in seen._read(seen._parts()).collect()} == known


def test_many_batches_of_a_folder_become_one(spark, tmp_path):
    seen = SeenKeys(spark, str(tmp_path / "seen"), first_parts=1, most_batches=3)
    for n in range(5):
        seen.add(_rows(spark, [f"k{n}"]), "k", f"{n:04d}")
    assert sorted(folders(spark, f"{seen.path}/parts=1/part=0")) == ["batch=0003", "batch=0004", "batch=merged-0003"]
    assert [r.k for r in seen.unseen(_rows(spark, ["k0", "k4", "new"]), "k", "0005").collect()] == ["new"]


def test_an_unfinished_doubling_does_not_count(spark, tmp_path):
    seen = SeenKeys(spark, str(tmp_path / "seen"), per_part=3, first_parts=2)
    seen.add(_rows(spark, ["a", "b", "c"]), "k", "0000")
    os.makedirs(tmp_path / "seen" / "parts=4" / "part=0")
    assert [r.k for r in seen.unseen(_rows(spark, ["a", "z"]), "k", "0001").collect()] == ["z"]
    seen.add(_rows(spark, list("defghij")), "k", "0001")
    assert seen._parts() == 4 and seen.unseen(_rows(spark, list("abcdefghij")), "k", "0002").count() == 0


def test_what_a_batch_reads_does_not_grow_with_the_history(spark, tmp_path):
    seen, asked, read = SeenKeys(spark, str(tmp_path / "seen"), per_part=100, first_parts=2), _rows(spark, ["k7", "other"]), []
    for n, size in enumerate((200, 2_000, 20_000)):
        seen.add(spark.range(size).selectExpr(f"concat('k', id + {n * 100_000}) AS k"), "k", f"{n:04d}")
        read.append(seen.near(asked, "k", "9999").count())
    assert max(read) <= 2 * 2 * 100
    assert [r.k for r in seen.unseen(asked, "k", "9999").collect()] == ["other"]


def test_nothing_is_there_yet(spark, tmp_path):
    seen = SeenKeys(spark, str(tmp_path / "seen"))
    assert seen.unseen(_rows(spark, ["a", None]), "k", "0000").count() == 2
    seen.add(_rows(spark, []), "k", "0000")
    assert seen.unseen(_rows(spark, ["a"]), "k", "0001").count() == 1


def test_a_batch_in_all_folders_costs_no_call_for_each(spark, tmp_path, monkeypatch):
    seen, calls = SeenKeys(spark, str(tmp_path / "seen"), first_parts=32), []
    monkeypatch.setattr(module, "folders", lambda *a: calls.append(a) or folders(*a))
    monkeypatch.setattr(module, "stored", None)  # keys that are told apart already are not copied
    for n in range(3):
        keys = [f"k{n}-{k}" for k in range(500)]
        assert seen.unseen(_rows(spark, keys), "k", f"{n:04d}").count() == 500
        seen.add(_rows(spark, keys), "k", f"{n:04d}", once=True)
    assert len(folders(spark, f"{seen.path}/parts=32")) > 32 and len(calls) < 32
    assert seen.unseen(_rows(spark, ["k0-1", "k2-499", "new"]), "k", "0003").count() == 1
