"""
Look-back as an index: which texts are alike to one that came in the days before, without reading what came earlier.

The index is two tables with a folder for each day, and in it one for each batch that wrote there:
classes   class_id (of the words' digest), n, tokens, hours: the first and last time in each hour that the class came
postings  class_id, n, tokens: those that a first common run can start with (see similarity.meetings)

Sets that are alike share runs of their prefixes in any one order of all tokens. The order here never changes, so that days fit together: the longest words first, as they are rare, then by hash. A lookup
reads the folders of the days that its rows can look back to, whatever the history; days beyond that can go. Runs meet only in spans of a few
times `days`, and texts are paired only where their days lie up to `days` apart, so a batch of many days isn't paired with all of them.
A day's classes of one batch are one file, or one for each PER_FILE.

Rows of equal sets are one class; classes are paired, rows never. Rows without tokens or without a time are alike to nothing, and
aren't kept. A batch that writes again takes the place of what it wrote before.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import text as T

from .similarity import DICTIONARY, confirmed, likely, meetings, run_of
from .storage import deleted, discard, exists, folders, spread, stored

HOUR = 3_600_000_000
#: Texts of a day that one file holds, about.
PER_FILE = 50_000
#: Days of a span in which runs meet, in times of the days looked back to and one.
SPANS = 4
_SCHEMA = {
    "classes": "class_id long, n int, tokens array<long>, hours array<struct<first:long,last:long>>, day date, batch string",
    "postings": "class_id long, n int, tokens array<long>, day date, batch string",
}


class LookBack:
    def __init__(self, spark: SparkSession, path: str, days: int = 7, hundredths: int = 70):
        self.spark, self.path, self.days, self.hundredths = spark, path, days, hundredths

    def keyed(self, rows: DataFrame, *more: str) -> DataFrame:
        """
        `rows` (*more, at, text) as add() and repeated() take them, too, so that both cut the texts to tokens once: *more, at (microseconds), day, class_id,
        tokens in the order of the index; stored. The id is 60 bits of the digest of the words; null without words or time.
        """
        words = T.tokens(F.coalesce("text", F.lit("")))
        ordered = F.array_sort(F.transform("words", lambda w: F.struct((-F.length(w)).alias("l"), F.xxhash64(w).alias("h"))))
        known = spread(rows.select(*more, F.col("at").cast("timestamp").alias("ts"), "text")).select(*more, "ts", F.array_sort(words).alias("words"))
        id_ = F.when((F.size("words") > 0) & F.col("ts").isNotNull(), F.conv(F.substring(F.sha2(F.array_join("words", " "), 256), 1, 15), 16, 10).cast("long"))
        return stored(known.select(*more, F.unix_micros("ts").alias("at"), F.to_date("ts").alias("day"), id_.alias("class_id"), F.transform(ordered, lambda x: x["h"]).alias("tokens")), "texts", **DICTIONARY)

    def _head(self) -> Column:
        """Of a set in the order of the index (n, tokens: all or a prefix), the tokens that a first common run can start with."""
        starts = F.floor(F.col("n") * run_of(self.hundredths) * (100 - self.hundredths) / 100).cast("int")
        return F.slice("tokens", F.lit(1), starts + run_of(self.hundredths))

    def _read(self, name: str, first: date, last: date) -> DataFrame:
        """The folders of some days."""
        there = set(folders(self.spark, f"{self.path}/{name}"))
        days = [f"day={first + timedelta(k)}" for k in range((last - first).days + 1)]
        paths = [f"{self.path}/{name}/{d}" for d in days if d in there]
        reader = self.spark.read.schema(_SCHEMA[name]).option("basePath", f"{self.path}/{name}")
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], _SCHEMA[name])

    def add(self, rows: DataFrame, batch: str) -> None:
        """Keeps the texts of `rows` (at, text)."""
        self.remove(batch)
        keyed = rows if "class_id" in rows.columns else self.keyed(rows)
        known = keyed.where(F.col("class_id").isNotNull())
        most = known.groupBy("day").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        # a day's classes are dealt to as few files as their number allows, and made where they are written: no join comes between
        dealt = known.select("class_id", "day", "at", "tokens", F.pmod("class_id", F.lit(most // PER_FILE + 1)).alias("part")).repartition("day", "part")
        hours = dealt.groupBy("day", "part", "class_id", F.floor(F.col("at") / HOUR).alias("hour")).agg(F.first("tokens").alias("tokens"), F.min("at").alias("first"), F.max("at").alias("last"))
        classes = hours.groupBy("day", "part", "class_id").agg(F.first("tokens").alias("tokens"), F.collect_list(F.struct("first", "last")).alias("hours"))
        self._write("classes", classes.select("class_id", F.size("tokens").alias("n"), "tokens", "hours", "day", F.lit(batch).alias("batch")))
        if keyed is not rows:
            discard(keyed)
        # each file of classes gives one of postings
        names = [d for d in folders(self.spark, f"{self.path}/classes") if d.startswith("day=")]
        paths = [f"{self.path}/classes/{d}/batch={batch}" for d in names if exists(self.spark, f"{self.path}/classes/{d}/batch={batch}")]
        if paths:
            written = self.spark.read.schema(_SCHEMA["classes"]).option("basePath", f"{self.path}/classes").parquet(*paths)
            self._write("postings", written.select("class_id", "n", self._head().alias("tokens"), "day", F.lit(batch).alias("batch")))

    def _write(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").options(**DICTIONARY).option("compression", "zstd").partitionBy("day", "batch").parquet(f"{self.path}/{name}")

    def remove(self, batch: str) -> None:
        for name in _SCHEMA:
            for day in folders(self.spark, f"{self.path}/{name}"):
                if day.startswith("day="):
                    deleted(self.spark, f"{self.path}/{name}/{day}/batch={batch}")

    def expire(self, before: date) -> None:
        """Removes days before one."""
        for name in _SCHEMA:
            for day in folders(self.spark, f"{self.path}/{name}"):
                if day.startswith("day=") and date.fromisoformat(day.removeprefix("day=")) < before:
                    deleted(self.spark, f"{self.path}/{name}/{day}")

    def repeated(self, rows: DataFrame, key: str, without: str | None = None, ties: bool = False) -> DataFrame:
        """
        `key` and is_repeat, a row for each of `rows` (key, at, text): whether a text in the index that came before it (with `ties`
        also at the same time), up to `days` days, is alike. What the batch `without` wrote doesn't count.
        """
        whole = rows if "class_id" in rows.columns else self.keyed(rows, key)
        keyed = stored(whole.select(key, "at", "day", "class_id", F.size("tokens").alias("n")), "keyed")
        known = F.col("class_id").isNotNull()
        first, last, total = keyed.where(known).agg(F.min("day"), F.max("day"), F.sum("n")).first()
        if first is None:
            return keyed.select(key, F.lit(False).alias("is_repeat"))
        postings, classes = (self._read(n, first - timedelta(self.days), last) for n in ("postings", "classes"))
        if without is not None:
            postings, classes = postings.where(F.col("batch") != without), classes.where(F.col("batch") != without)
        # a class looks back in its own span and, if its days reach there, in the one before
        day, width = F.unix_date("day"), SPANS * (self.days + 1)
        spans = F.array_distinct(F.array(F.floor(day / width), F.floor((day - self.days) / width)))
        head = [F.col("class_id").alias("id"), "n", self._head().alias("tokens"), day.alias("day")]
        mine = whole.where(known).withColumn("n", F.size("tokens")).select(*head, F.explode(spans).alias("span"), F.lit(1).alias("role"))
        theirs = postings.select(*head, F.floor(day / width).alias("span"), F.lit(2).alias("role"))
        sides = mine.unionByName(theirs).groupBy("id", "span").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.min("day").alias("lo"), F.max("day").alias("hi"), F.bit_or("role").alias("role"))
        total += postings.agg(F.sum("n")).first()[0] or 0
        pairs = stored(meetings(sides, self.hundredths, total, reach=self.days), "pairs")
        # sets that aren't among those asked for come from one folder of the index each
        ids = keyed.where(known).select("class_id").distinct()
        needed = stored(pairs.select(F.col("a").alias("class_id")).unionByName(pairs.select(F.col("b").alias("class_id"))).distinct(), "needed")
        others = needed.join(ids, "class_id", "left_anti")
        found = classes.select("class_id", "day", "batch").join(others, "class_id").groupBy("class_id").agg(F.min(F.struct("day", "batch")).alias("at")).select("class_id", "at.day", "at.batch")
        asked = whole.select("class_id", "tokens").join(needed, "class_id", "left_semi").groupBy("class_id").agg(F.first("tokens").alias("tokens"))
        sets = asked.unionByName(classes.join(found, ["class_id", "day", "batch"]).select("class_id", "tokens"))
        sets = stored(sets.select(F.col("class_id").alias("id"), F.sort_array("tokens").alias("tokens")), "sets", **DICTIONARY)
        near = likely(pairs, sets, self.hundredths)
        alike = confirmed(near, sets, self.hundredths)
        discard(pairs, needed, sets, near, *([] if whole is rows else [whole]))
        alike_both = alike.unionByName(alike.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # a text is alike to what came before with the same words, too
        both = alike_both.unionByName(ids.select(F.col("class_id").alias("a"), F.col("class_id").alias("b")))
        # the hours in which something alike came: at most 24 a day, as one list for each class asked for
        times = classes.select(F.col("class_id").alias("b"), F.explode("hours").alias("t")).join(both, "b")
        times = times.groupBy("a", F.floor(F.col("t.first") / HOUR).alias("hour")).agg(F.min("t.first").alias("first"), F.max("t.last").alias("last"))
        times = stored(times.groupBy(F.col("a").alias("class_id")).agg(F.collect_list(F.struct("first", "last")).alias("times")), "times")
        span = F.lit(self.days * 24 * HOUR)
        discard(alike)
        earlier = (lambda t: t["first"] <= F.col("at")) if ties else (lambda t: t["first"] < F.col("at"))
        before = F.exists("times", lambda t: earlier(t) & (t["last"] >= F.col("at") - span))
        return keyed.join(times, "class_id", "left").select(key, F.coalesce(before, F.lit(False)).alias("is_repeat"))
