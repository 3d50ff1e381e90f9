"""Deep pages and substring search against plain versions."""

import random

from newsloom.operators.deep_pages import Pages, after
from newsloom.operators.text_index import TextIndex


def test_pages(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, 1, 2, 3, 4])) for i in range(300)]
    order = [("v", True), ("id", False)]
    want = sorted(rows, key=lambda r: (r[1] is not None, -(r[1] or 0), r[0]))
    df = spark.createDataFrame(rows, "id long, v int")
    p = Pages(df, order, ranges=7)
    assert p.total == 300 and sum(n > 0 for n in p.sizes) > 2
    for size in (1, 7, 100, 301):
        for number in {1, 2, 150 // size + 1, 299 // size + 1, 301 // size + 1}:
            assert list(map(tuple, p.page(number, size).collect())) == want[(number - 1) * size : number * size]
    p.close()
    for k in (0, 40, 99, 298, 299):
        assert list(map(tuple, after(df, order, (want[k][1], want[k][0]), 10).collect())) == want[k + 1 : k + 11]
    none = Pages(df.limit(0), order, ranges=3)
    assert none.total == 0 and none.page(1, 10).collect() == []


def test_substring_search(spark, tmp_path):
    rows = [(1, "A red Rose", None), (2, "rouge", "coloReD"), (3, None, None), (4, "r e d", "re"), (5, "", "écarté 漢字かな"), (6, "redred", "red")]
    index = TextIndex(spark, str(tmp_path / "x"), "id", ["a", "b"], parts=8)
    index.build(spark.createDataFrame([(*r, 0) for r in rows], "id long, a string, b string, gram int"))
    ids = lambda term: {r.id for r in index.search(term).collect()}
    for term in (" Red ", "red rose", "redred", "r", "re", "漢字か", "é", "CARTÉ", "none at all", "d r"):
        t = term.strip().lower()
        assert ids(term) == {i for i, a, b in rows if any(t in (c or "").lower() for c in (a, b))}, term
    assert ids("") == ids(None) == {1, 2, 3, 4, 5, 6}
    read = {f.split("part=")[1].split("/")[0] for f in index.search("漢字か").inputFiles() if "/rows/" in f}
    assert len(read) == 1  # the folder of the one row that has them
