"""
Token-set similarity: a join by runs of prefix tokens between classes of equal sets, greedy acceptance, and a look-back in time.

Texts are cut to tokens once. Sets of tokens are moved twice: once to the class that they make, once to the tiles in which
candidates are confirmed. All else moves numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.functions import text as T

from .components import rejected
from .storage import discard, spread, stored

#: Tokens of the sample by which tokens are ranked, about.
SAMPLE = 2_000_000
#: Sets of a tile's side, about.
TILE = 512
#: Runs of tokens that are looked through at once, about, and pairs that are looked at at once.
BUCKET, AT_ONCE = 1_000_000, 1_000_000
#: Tokens of the sets that are looked at at once, about.
CUT = 2_000_000
#: Sketches of a block, about; two blocks meet in a task.
BLOCK = 250_000
#: Tokens repeat, so a dictionary of this many bytes takes most of them where Parquet's usual one is full at once.
DICTIONARY = {"parquet.dictionary.page.size": str(16 << 20)}
DAY = 86_400_000_000


def token_classes(docs: DataFrame, *more: str, at: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """
    (doc_id, *more, key) of all rows, (class_id, key, least, n_rows), and (id, tokens) by class_id: rows of equal token sets share
    a class. A class is known by `key`, a digest of its words (null: no tokens, no class), and numbered by class_id in order of
    its least doc_id, nulls last, and its key; so ids may be repeated or null, and several classes may have one id. Tokens are
    64-bit hashes, in ascending order. `docs` has doc_id, text and the columns `more`. With `at` (microseconds) sets have lo and hi, too: the days
    of the class's first and last row; classes without a time have no set then.
    """
    words = T.tokens(F.coalesce("text", F.lit("")))
    dealt = spread(docs.select("doc_id", "text", *more)).select("doc_id", *more, F.array_sort(words).alias("words"))
    key = F.when(F.size("words") > 0, F.unhex(F.sha2(F.array_join("words", " "), 256)))
    read = dealt.select("doc_id", *more, key.alias("key"), F.sort_array(F.transform("words", lambda w: F.xxhash64(w))).alias("tokens"))
    read = stored(read.withColumn("row", F.monotonically_increasing_id()), "texts", **DICTIONARY)
    rows = stored(read.select("doc_id", *more, "key"), "keys")
    day = F.floor((F.lit(None).cast("long") if at is None else at) / DAY).cast("int")
    of = read.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_rows"), F.min("row").alias("row"), F.min(day).alias("lo"), F.max(day).alias("hi"))
    # sorted by range, so that the numbers ascend
    classes = stored(of.orderBy(F.col("least").asc_nulls_last(), "key").withColumn("class_id", F.monotonically_increasing_id()), "classes")
    chosen = classes if at is None else classes.where("lo IS NOT NULL")
    sets = read.select("row", "tokens").join(chosen.select("row", F.col("class_id").alias("id"), *([] if at is None else ["lo", "hi"])), "row").drop("row")
    sets = stored(sets, "sets", **DICTIONARY)
    discard(read)
    return rows, classes.drop("row", "lo", "hi"), sets


def run_of(hundredths: int) -> int:
    """How many common tokens in a row two sets that are alike must have (see `meetings`; other limits would miss small sets)."""
    return 2 if hundredths >= 70 else 1


def run_starts(n, hundredths: int):
    """Of a set of `n` tokens, a run that is the first common one starts at this place at most."""
    return n * (run_of(hundredths) * (100 - hundredths)) // 100


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _ranks(sets: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """
    Tokens that a sample of the sets, of about SAMPLE tokens, has more than once, sorted, and how often. They only order
    tokens, rare ones first: any order gives the same pairs, and a good one few candidates.
    """
    some = sets.where(F.pmod(F.xxhash64("id"), F.lit(-(-total // SAMPLE) or 1)) == 0).select(F.explode("tokens").alias("token"))
    found = some.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").toArrow().sort_by("token")
    return found.column("token").to_numpy(), found.column("n").to_numpy()


def _pieces(batches):
    """Batches of about CUT tokens at most."""
    for batch in batches:
        ends = np.asarray(batch.column("tokens").offsets).astype(np.int64)
        cuts = np.unique(np.searchsorted(ends - ends[0], np.arange(0, ends[-1] - ends[0] + CUT, CUT)))
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield batch.slice(low, high - low)


#: What is known of a run: its digest, its set's id and number of tokens, its place, the token before.
_RUN = {"key": np.uint64, "id": np.int64, "n": np.int32, "at": np.int32, "back": np.uint64}
#: And where times count: days of the first and last row; 1: looks back, 2: is looked at, 3: both (without it, all do both).
_TIMES = {"lo": np.int32, "hi": np.int32, "role": np.int8}


def _runs(sets: DataFrame, hundredths: int, buckets: int, ranks=None) -> DataFrame:
    """
    Runs of the sets' prefixes (see `meetings`), in blocks for each bucket. Rows of `sets`: id, tokens; n where those are a part of the
    set's; lo, hi, role where times count; span where only sets of one span meet. With `ranks` tokens (ascending) are put in their order, else
    they stay as they are.
    """
    k, timed = run_of(hundredths), [c for c in _TIMES if c in sets.columns]
    names = [*_RUN, *timed]

    def cut(batches):
        for batch in _pieces(batches):
            yield from blocks(batch)

    def blocks(batch):
        column = lambda c: batch.column(c).to_numpy()
        tokens, held = batch.column("tokens").flatten().to_numpy(), np.diff(np.asarray(batch.column("tokens").offsets).astype(np.int64))
        of, start = np.repeat(np.arange(len(held)), held), np.cumsum(held) - held
        if not len(tokens):
            return
        if ranks is not None:
            known, often = ranks.value
            rank = np.zeros(len(tokens), np.int64)
            if len(known):
                place = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                rank = np.where(known[place] == tokens, often[place], 0)
            tokens = tokens[np.argsort((of << 32) + rank, kind="stable")]
        n = column("n").astype(np.int64) if "n" in batch.schema.names else held
        at = np.arange(len(tokens)) - start[of]
        kept = np.flatnonzero((at <= held[of] - k) & (at <= run_starts(n, hundredths)[of]))
        tokens, of, at = tokens.view(np.uint64), of[kept], at[kept]
        key = np.zeros(len(kept), np.uint64)
        if "span" in batch.schema.names:
            key += _mixed(column("span").astype(np.uint64) + np.uint64(1))[of]
        for j in range(k):
            key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + tokens[kept + j])
        ids = column("id")[of]
        # first tokens have none before, which never counts as the same
        back = np.where(at > 0, tokens[kept - 1], _mixed(ids.view(np.uint64)))
        found = {"key": key, "id": ids, "n": n[of], "at": at, "back": back} | {c: column(c)[of] for c in timed}
        bucket = (_mixed(key) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        parts, first = np.unique(bucket[order], return_index=True)
        columns = []
        for c in names:
            values = found[c].astype((_RUN | _TIMES)[c], copy=False)[order]
            offsets = np.append(first, len(order)) * values.itemsize
            columns.append(pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values)]))
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *columns], names=["part", *names])

    return sets.mapInArrow(cut, "part int, " + ", ".join(f"{c} binary" for c in names))


def _meet(t: dict[str, np.ndarray], hundredths: int, reach: int):
    """(a, b) of the runs of one bucket, in chunks."""
    k = run_of(hundredths)
    order = np.argsort(t["key"], kind="stable")
    key = t["key"][order]
    same = key[1:] == key[:-1]
    order = order[np.append(same, False) | np.append(False, same)] if len(key) else order
    if not len(order):
        return
    # by key, those that look back first, then by the token before: runs that have it in common go on from one further to the front
    role = t["role"] if "role" in t else np.full(len(t["key"]), 3, np.int8)
    order = order[np.lexsort((t["back"][order], 1 - (role[order] & 1), t["key"][order]))]
    key, back = t["key"][order], t["back"][order]
    ids, n, at = t["id"][order], t["n"][order], t["at"][order]
    lo, hi = (t[c][order] if c in t else None for c in ("lo", "hi"))
    role = role[order]
    asked = (role & 1) > 0
    ends = lambda new: np.append(np.flatnonzero(new)[1:], len(new))[np.cumsum(new) - 1]
    new = np.append(True, key[1:] != key[:-1])
    end = ends(new)
    begin = ends(new | np.append(True, (back[1:] != back[:-1]) | (asked[1:] != asked[:-1])))
    many = np.where(asked, end - begin, 0)
    total = np.cumsum(many)
    cuts = np.unique(np.append(np.searchsorted(total, np.arange(0, total[-1], AT_ONCE), side="right"), len(many)))
    for low, high in zip(np.append(0, cuts[:-1]).tolist(), cuts.tolist(), strict=True):
        m = many[low:high]
        if not m.sum():
            continue
        x = np.repeat(np.arange(low, high), m)
        y = np.arange(len(x)) - np.repeat(np.cumsum(m) - m, m) + begin[x]
        n_x, n_y, at_x, at_y = n[x], n[y], at[x], at[y]
        need = -(-(n_x.astype(np.int64) + n_y) * hundredths // (100 + hundredths))
        between = np.minimum(np.minimum(at_x, at_y), (at_x.astype(np.int64) + at_y) * (k - 1) // (2 * k - 1))
        ok = between + np.minimum(n_x - at_x, n_y - at_y) >= need
        ok &= np.minimum(n_x, n_y).astype(np.int64) * 100 >= np.maximum(n_x, n_y).astype(np.int64) * hundredths
        x, y = x[ok], y[ok]
        if lo is not None:
            ok = (lo[x] - reach <= hi[y]) & (lo[y] - reach <= hi[x])
            x, y = x[ok], y[ok]
        if "role" in t:
            ok = (back[x] != back[y]) & (ids[x] != ids[y]) & (((role[x] & (role[y] >> 1)) | (role[y] & (role[x] >> 1))) & 1 > 0)
            x, y = x[ok], y[ok]
        a, b = ids[x], ids[y]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def meetings(sets: DataFrame, hundredths: int, total: int, ranks=None, reach: int = 0) -> DataFrame:
    """
    (a, b), a < b, each once: candidates among `sets` (see `_runs`; `total`: their tokens), in one order of all tokens.

    Take the tokens of two sets together. Those that only one has are so few, in sets that are alike, that somewhere `k` common
    ones follow each other, so they do in each of both. The first such run starts at places i and j, behind a token that is not in both, and at most k - 1
    common tokens stand before each of those that aren't: at most (k - 1) * (i + j) / (2 * k - 1) in all. These and what is left
    behind i and j must make up what must be shared. Runs are dealt to buckets by their digests and paired there, so a pair is a row
    only where a run may be its first.
    """
    buckets = max(total * run_of(hundredths) * (100 - hundredths) // 100 // BUCKET + 1, sets.sparkSession.sparkContext.defaultParallelism)
    runs = _runs(sets, hundredths, buckets, ranks)
    kinds = {c: t for c, t in (_RUN | _TIMES).items() if c in runs.columns}

    def met(batches):
        part, held = None, []
        for batch in batches:
            for i, p in enumerate(batch.column("part").to_pylist()):
                if p != part and held:
                    yield from _meet(joined(held), hundredths, reach)
                    held = []
                part = p
                held.append([batch.column(c)[i].as_buffer() for c in kinds])
        if held:
            yield from _meet(joined(held), hundredths, reach)

    def joined(held):
        return {c: np.concatenate([np.frombuffer(h[i], t) for h in held]) for i, (c, t) in enumerate(kinds.items())}

    dealt = runs.repartitionById(buckets, F.col("part")).sortWithinPartitions("part")
    return dealt.mapInArrow(met, "a long, b long").distinct()


def _sketches(batches):
    """id, n, sketch: of each place in it whether an odd number of the set's tokens fall there. So two sketches differ in as many places at most as sets differ in tokens."""
    for batch in _pieces(batches):
        tokens = batch.column("tokens").flatten().to_numpy().view(np.uint64)
        n = np.diff(np.asarray(batch.column("tokens").offsets).astype(np.int64))
        bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64))
        end = np.cumsum(bits)
        place = (_mixed(tokens) & np.repeat(bits - 1, n).view(np.uint64)).astype(np.int64) + np.repeat(end - bits, n)
        odd = np.packbits(np.bincount(place, minlength=end[-1]).astype(np.uint8) & 1, bitorder="little") if len(n) else np.zeros(0, np.uint8)
        offsets = np.append(0, end // 8).astype(np.int32)
        sketch = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(odd)])
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n), sketch], names=["id", "n", "sketch"])


def _likely(hundredths: int):
    def check(pairs: pa.Table, sketches: pa.Table) -> pa.Table:
        pairs = pairs.select(["a", "b"])
        if not pairs.num_rows:
            return pairs
        ids, n = sketches.column("id").to_numpy(), sketches.column("n").to_numpy()
        held = sketches.column("sketch").combine_chunks()
        offsets = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1].astype(np.int64)
        data, length, by_id = np.frombuffer(held.buffers()[2], np.uint8), np.diff(offsets), np.argsort(ids)
        a, b = (by_id[np.searchsorted(ids, pairs.column(c).to_numpy(), sorter=by_id)] for c in ("a", "b"))
        most = n[a] + n[b] + 2 * ((n[a] + n[b]) * hundredths // -(100 + hundredths))
        least, ok = np.minimum(length[a], length[b]), np.zeros(len(a), bool)
        for size in np.unique(least).tolist():
            of = np.flatnonzero(least == size)

            def folded(x, size=size):
                """The sketches of `x` as if made for `size`."""
                out = np.zeros((len(x), size), np.uint8)
                for k in range(int(length[x].max()) // size):
                    longer = np.flatnonzero(length[x] > k * size)
                    out[longer] ^= data[(offsets[x[longer]] + k * size)[:, None] + np.arange(size)]
                return out.view(np.uint64)

            step = max((8 << 20) // size, 1)
            for low in range(0, len(of), step):
                some = of[low : low + step]
                ok[some] = np.bitwise_count(folded(a[some]) ^ folded(b[some])).sum(axis=1, dtype=np.int64) <= most[some]
        return pairs.filter(pa.array(ok))

    return check


def likely(pairs: DataFrame, sets: DataFrame, hundredths: int) -> DataFrame:
    """
    Those of `pairs` (a, b; stored) whose sketches don't rule out that they are alike, so that whole sets are sent for few others than these.
    Sketches have some two bits for a token. They are dealt to blocks, and each two blocks meet in a task with their pairs.
    """
    sketches = stored(sets.select("id", "tokens").mapInArrow(_sketches, "id long, n long, sketch binary"), "sketches")
    # of a task's pairs there are some four million at most
    blocks = max(-(-sketches.count() // BLOCK), int((2 * pairs.count() / 4_000_000) ** 0.5) + 1, int((2 * sets.sparkSession.sparkContext.defaultParallelism) ** 0.5))
    own = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    tile = lambda x, y: (F.least(x, y) * blocks + F.greatest(x, y)).alias("tile")
    sent = sketches.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(tile(own("id"), F.col("other").cast("long")).alias("to"), "id", "n", "sketch")
    dealt = pairs.select(tile(own("a"), own("b")), "a", "b")
    found = stored(dealt.groupBy("tile").cogroup(sent.groupBy("to")).applyInArrow(_likely(hundredths), "a long, b long"), "likely")
    discard(sketches)
    return found


def _places(start: np.ndarray, size: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Places of the tokens of some sets, one set after the other."""
    n = size[of]
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - start[of], n)


def _by_search(tokens, start, size, a, b) -> np.ndarray:
    """How many tokens the sets of each pair share; pairs are sorted by a."""
    cuts, out = np.append(np.flatnonzero(np.append(True, a[1:] != a[:-1])), len(a)), np.zeros(len(a), np.int64)
    for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        x = tokens[start[a[low]] : start[a[low]] + size[a[low]]]
        for first in range(low, high, TILE):
            others = b[first : min(first + TILE, high)]
            y = tokens[_places(start, size, others)]
            found = x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y
            out[first : first + len(others)] = np.add.reduceat(found.astype(np.int64), np.cumsum(size[others]) - size[others])
    return out


def _by_product(tokens, start, size, rows, columns, x, y) -> np.ndarray:
    """The same where most sets of a tile are paired: by products of blocks of the table of sets by tokens that both sides have."""
    of_rows, of_columns = _places(start, size, rows), _places(start, size, columns)
    words = np.intersect1d(tokens[of_rows], tokens[of_columns])
    sides = []
    for of, places in ((rows, of_rows), (columns, of_columns)):
        t, at = tokens[places], np.repeat(np.arange(len(of)), size[of])
        word = np.minimum(np.searchsorted(words, t), len(words) - 1)
        kept = np.flatnonzero(words[word] == t)
        kept = kept[np.argsort(word[kept], kind="stable")]
        sides.append((at[kept], word[kept], len(of)))
    out = np.zeros((len(rows), len(columns)), np.float32)
    for low in range(0, len(words), 4096):
        tables = []
        for at, word, n in sides:
            part = slice(*np.searchsorted(word, [low, low + 4096]))
            table = np.zeros((n, min(4096, len(words) - low)), np.float32)
            table[at[part], word[part] - low] = 1
            tables.append(table)
        out += tables[0] @ tables[1].T
    return out[x, y].astype(np.int64)


def _alike(hundredths: int):
    def confirm(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        if not pairs.num_rows:
            return pairs.select(["a", "b"])
        ids, order = sets.column("id").to_numpy(), np.lexsort((pairs.column("b").to_numpy(), pairs.column("a").to_numpy()))
        lists = sets.column("tokens").combine_chunks()
        tokens, ends = lists.flatten().to_numpy(), np.asarray(lists.offsets).astype(np.int64)
        start, size, by_id = ends[:-1] - ends[0], np.diff(ends), np.argsort(ids)
        a, b = (by_id[np.searchsorted(ids, pairs.column(c).to_numpy()[order], sorter=by_id)] for c in ("a", "b"))
        (rows, x), (columns, y) = np.unique(a, return_inverse=True), np.unique(b, return_inverse=True)
        both = _by_product(tokens, start, size, rows, columns, x, y) if len(a) * 4 > len(rows) * len(columns) and len(a) > 4 * TILE else _by_search(tokens, start, size, a, b)
        return pairs.select(["a", "b"]).take(pa.array(order)).filter(pa.array(both * 100 >= (size[a] + size[b] - both) * hundredths))

    return confirm


def confirmed(pairs: DataFrame, sets: DataFrame, hundredths: int) -> DataFrame:
    """
    Those of `pairs` (a, b; stored, each once) whose whole sets are alike; `sets`: id, tokens. Pairs are dealt by the least partner
    of b, which near copies have in common, to tiles of about TILE sets on each side, so a set is sent once to each of its tiles. Small ones share a tile.
    """
    least = pairs.groupBy("b").agg(F.min("a").alias("hub"))
    of = stored(pairs.join(least, "b").select("a", "b", "hub"), "hubs")
    hubs = of.groupBy("hub").agg(F.count("*").alias("n"), F.approx_count_distinct("a").alias("n_a"), F.approx_count_distinct("b").alias("n_b"))
    hubs = stored(hubs.select("hub", "n", F.ceil(F.col("n_a") / TILE).alias("n_a"), F.ceil(F.col("n_b") / TILE).alias("n_b")), "hubs")
    few = hubs.where(f"n <= {TILE}").agg(F.sum("n")).first()[0] or 0
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    tile = F.when(F.col("n") <= TILE, F.pmod(F.xxhash64("hub"), F.lit(few // TILE + 1))).otherwise(F.xxhash64("hub", own("a", "n_a"), own("b", "n_b")))
    dealt = stored(of.join(hubs, "hub").select(tile.alias("tile"), "a", "b"), "dealt")
    asked = dealt.select("tile", F.col("a").alias("id")).unionByName(dealt.select("tile", F.col("b").alias("id"))).distinct()
    sent = sets.join(asked, "id").select(F.col("tile").alias("to"), "id", "tokens")
    found = stored(dealt.groupBy("tile").cogroup(sent.groupBy("to")).applyInArrow(_alike(hundredths), "a long, b long"), "alike")
    discard(of, hubs, dealt)
    return found


def similar_classes(sets: DataFrame, hundredths: int = 70, reach: int = 0) -> DataFrame:
    """
    (a, b), a < b: ids of `sets` (id, tokens) that are alike. Candidates by their prefixes are confirmed on the whole sets. Where sets have lo
    and hi, only those that lie up to `reach` apart count.
    """
    total = sets.agg(F.sum(F.size("tokens"))).first()[0] or 0
    ranks = sets.sparkSession.sparkContext.broadcast(_ranks(sets, total))
    met = stored(meetings(sets, hundredths, total, ranks, reach), "candidates")
    pairs = likely(met, sets, hundredths)
    found = confirmed(pairs, sets.select("id", "tokens"), hundredths)
    discard(met, pairs)
    return found


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def near_duplicates(docs: DataFrame, hundredths: int = 70) -> DataFrame:
    """doc_id, class_id (the class's least doc_id; null without tokens), n_links: how many other rows are alike, copies among them. A row for each of `docs`."""
    rows, classes, sets = token_classes(docs)
    pairs = similar_classes(sets, hundredths)
    discard(sets)
    size = classes.select("class_id", "n_rows")
    links = _both_ways(pairs).join(size.withColumnRenamed("class_id", "b"), "b").groupBy(F.col("a").alias("class_id")).agg(F.sum("n_rows").alias("others"))
    total = classes.select("class_id", "key", "least", "n_rows").join(links, "class_id", "left").select("key", F.col("least").alias("class_id"), (F.col("n_rows") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return rows.join(stored(total, "links"), "key", "left").select("doc_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def accepted(docs: DataFrame, hundredths: int = 70, standing: Column | None = None) -> DataFrame:
    """
    doc_id, is_accepted, a row for each of `docs`: in order of doc_id (nulls last) a row is taken unless one taken before is
    alike. Rows that are `standing` were taken before all others. Of a class only rows with its least id can be taken; those with
    one id and equal tokens are one item. Classes are settled by components (see `rejected`).
    """
    flag = F.coalesce(standing, F.lit(False)) if standing is not None else F.lit(False)
    rows, classes, sets = token_classes(docs.select("doc_id", "text", flag.alias("standing")), "standing")
    pairs = similar_classes(sets, hundredths)
    discard(sets)
    known, out = classes.select("class_id", "key", "least"), None
    if standing is not None:
        # standing classes settle their neighbours, whatever the order of ids
        kept = rows.where("standing AND key IS NOT NULL").select("key").distinct().join(known, "key").select("class_id")
        kept = stored(kept, "kept")
        out = stored(_both_ways(pairs).join(kept.withColumnRenamed("class_id", "a"), "a", "left_semi").select(F.col("b").alias("class_id")).distinct().unionByName(kept).distinct(), "settled")
        pairs = _without(pairs, out)
    gone = rejected(pairs).select(F.col("id").alias("class_id"))
    gone = (gone if out is None else gone.unionByName(out)).distinct()
    free = stored(known.join(gone, "class_id", "left_anti").select("key", "least", F.lit(True).alias("free")), "free")
    first = F.coalesce("free", F.lit(False)) & F.col("doc_id").eqNullSafe(F.col("least"))
    return rows.join(free, "key", "left").select("doc_id", (F.col("key").isNull() | F.col("standing") | first).alias("is_accepted"))


def _without(links: DataFrame, nodes: DataFrame) -> DataFrame:
    for side in ("a", "b"):
        links = links.join(nodes.withColumnRenamed("class_id", side), side, "left_anti")
    return links


def recent_duplicates(docs: DataFrame, days: int = 7, hundredths: int = 70) -> DataFrame:
    """
    doc_id, is_duplicate, a row for each of `docs`: whether a row that came up to `days` days before is alike. `docs`: doc_id, ts,
    text; rows without a time are no duplicates, nor make others so. Rows are not paired. Of each class and hour only the
    first and last times of rows alike to it are kept: the first tells what came earlier in the same hour, the last what came
    late enough in the hour `days` before, and between the two any hour with such rows will do. So a window's partition has
    two spans of `days` in hours, however many rows a class has.
    """
    rows, classes, sets = token_classes(docs.select("doc_id", "text", F.col("ts").cast("timestamp").alias("ts")), "ts", at=F.unix_micros("ts"))
    hour, span = 3_600_000_000, 24 * days
    named = rows.join(classes.select("key", "class_id"), "key", "left").select("doc_id", "class_id", F.unix_micros("ts").alias("at"))
    named = stored(named.withColumn("hour", F.floor(F.col("at") / hour)), "members")
    member = named.where(F.col("class_id").isNotNull() & F.col("at").isNotNull())
    pairs = _both_ways(similar_classes(sets, hundredths, days))
    discard(sets)
    own = member.groupBy("class_id", "hour").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    near = own.withColumnRenamed("class_id", "b").join(pairs, "b").select(F.col("a").alias("class_id"), "hour", "first", "last")
    near = own.unionByName(near).groupBy("class_id", "hour").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    here = F.floor(F.col("hour") / span)
    spans = near.select("*", F.explode(F.array(here, here + 1)).alias("span"))
    back = Window.partitionBy("class_id", "span").orderBy("hour")
    seen = spans.withColumns({"between": F.count("*").over(back.rangeBetween(1 - span, -1)) > 0, "late": F.max("last").over(back.rangeBetween(-span, -span))})
    seen = stored(seen.where(F.col("span") == here).select("class_id", "hour", "first", "between", "late"), "seen")
    earlier = (F.col("first") < F.col("at")) | F.col("between") | F.coalesce(F.col("late") >= F.col("at") - span * hour, F.lit(False))
    return named.join(seen, ["class_id", "hour"], "left").select("doc_id", F.coalesce(earlier, F.lit(False)).alias("is_duplicate"))
