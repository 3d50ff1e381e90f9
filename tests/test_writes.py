"""Audit rows, free slugs, bridge rows and CSV files over odd rows."""

from pyspark.sql import functions as F

from newsloom.operators import writes as W


def test_audit(spark):
    old = spark.createDataFrame([(1, "a", None, "x"), (2, "b", 1, "x"), (3, None, 2, "y"), (5, "e", 5, "z")], "id int, s string, n int, who string")
    new = spark.createDataFrame([(1, "a", None, "w"), (2, "c", 1, "w"), (3, None, None, None), (4, "d", 4, "v")], "id int, s string, n int, who string")
    got = {tuple(r) for r in W.audited(old, new, "id", ["s", "n"], "thing", "who").collect()}
    assert got == {
        ("w", "UPDATE", "thing", 2, '{"s":"b","n":1}', '{"s":"c","n":1}'), (None, "UPDATE", "thing", 3, '{"s":null,"n":2}', '{"s":null,"n":null}'),
        ("v", "INSERT", "thing", 4, None, '{"s":"d","n":4}'), ("z", "DELETE", "thing", 5, '{"s":"e","n":5}', None),
    }
    assert W.audited(old, old, "id", ["s"], "thing", "who").count() == 0


def test_slugs_and_bridges(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "a")], "id int, base string")
    taken = spark.createDataFrame([("a",), ("a",), ("a-1",), (None,)], "slug string")
    assert {r.id: r.slug for r in W.free_slugs(rows, "base", taken, "slug", F.lit("9")).collect()} == {1: "a-9", 2: "b", 3: None, 4: "a-9"}
    parents = spark.createDataFrame([(1, [1, 2, 2, None]), (2, []), (3, None)], "id int, tags array<int>")
    assert sorted(map(tuple, W.bridge_rows(parents, "id", "tags", "tag").collect())) == [(1, 1), (1, 2)]


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([('say "hi", you', 1, ""), ("b", 2, "x")], "name string, n int, note string").coalesce(1)
    W.write_csv(df, str(tmp_path / "report"))
    (file,) = (tmp_path / "report").glob("*.csv")
    assert file.read_text().splitlines() == ['"name","n","note"', '"say ""hi"", you","1",""', '"b","2","x"']
