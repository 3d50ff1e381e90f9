"""Digests as streams: posts that come late, in any micro-batch, against a plain loop."""

import random
from datetime import datetime, timedelta

from newsloom.streaming.digest import digests, run_digests

START = datetime(2024, 1, 1)
HOURS, EVERY, MOST = 9, 3, 5


def plain(articles, posts, until):
    """For each digest before `until`: the newest articles of the hours before it that no post of those hours names."""
    out, at = set(), START
    while at < until:
        since = at - timedelta(hours=HOURS)
        posted = {i for i, t in posts if since <= t <= at}
        left = sorted(((t, i) for i, t in articles if since <= t <= at and i not in posted), key=lambda x: (-x[0].timestamp(), x[1]))
        out |= {(at, i, place + 1) for place, (_, i) in enumerate(left[:MOST])}
        at += timedelta(hours=EVERY)
    return out


def test_posts_that_come_late(spark, tmp_path):
    dice = random.Random(3)
    articles = [(k, START + timedelta(minutes=7 * k + 1)) for k in range(300)] + [(299, START + timedelta(minutes=7 * 299 + 1))]
    posts = [(k, t + timedelta(minutes=dice.choice([5, 100, 400, 700]))) for k, t in articles if k % 3]
    for name in ("articles", "posts"):
        (tmp_path / name).mkdir()
    run = lambda: run_digests(
        spark, spark.readStream.schema("id long, published_at timestamp").parquet(str(tmp_path / "articles")), spark.readStream.schema("article_id long, posted_at timestamp").parquet(str(tmp_path / "posts")),
        str(tmp_path / "out"), str(tmp_path / "at"), HOURS, EVERY,
    )
    # what is told in an hour comes in that half of time; posts of the last hour before the cut come with the second half
    cut = START + timedelta(hours=18)
    halves = [(articles, posts, lambda t, late: t < cut - late), (articles, posts, lambda t, late: t >= cut - late)]
    for a, p, part in halves:
        spark.createDataFrame([x for x in a if part(x[1], timedelta(0))], "id long, published_at timestamp").write.mode("append").parquet(str(tmp_path / "articles"))
        spark.createDataFrame([x for x in p if part(x[1], timedelta(minutes=50))], "article_id long, posted_at timestamp").write.mode("append").parquet(str(tmp_path / "posts"))
        run()
    got = {tuple(r) for r in digests(spark, str(tmp_path / "out"), MOST).collect()}
    closed = max(t for t, _, _ in got)
    assert closed > cut and got == plain(articles, posts, closed + timedelta(minutes=1))
    run()  # nothing came
    assert {tuple(r) for r in digests(spark, str(tmp_path / "out"), MOST).collect()} == got


def test_before_1970_and_run_again(spark, tmp_path):
    """A stream's own watermark begins at 1970 and takes what is older for late."""
    start = datetime(1960, 1, 1)
    for part in (range(20), range(20, 40)):
        spark.createDataFrame([(k, start + timedelta(hours=k)) for k in part], "id long, published_at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "articles"))
        spark.createDataFrame([(k, start + timedelta(hours=k, minutes=30)) for k in part if k % 2 == 0], "article_id long, posted_at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "posts"))

    def run():
        a, p = (spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / n)) for n, s in (("articles", "id long, published_at timestamp"), ("posts", "article_id long, posted_at timestamp")))
        run_digests(spark, a, p, str(tmp_path / "out"), str(tmp_path / "at"), HOURS, EVERY)
        return sorted((r.digest_at, r.id) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    got = run()
    last = max((p for p in (tmp_path / "at" / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    (last.parent / f".{last.name}.crc").unlink()
    last.unlink()  # as if the run had died before its commit
    mark = start + timedelta(hours=38, minutes=30) - timedelta(hours=1)
    digests_ = [start + timedelta(hours=h) for h in range(0, 60, EVERY) if start + timedelta(hours=h) <= mark]
    # an even article is posted half an hour after it came: only a digest at its own hour has it
    want = sorted((d, k) for d in digests_ for k in range(40) if timedelta(0) <= d - start - timedelta(hours=k) <= timedelta(hours=HOURS) and (k % 2 or d == start + timedelta(hours=k)))
    assert len(want) > 50 and got == want and run() == want
