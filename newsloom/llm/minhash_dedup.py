"""
MinHash near-dedup with odd sketches. BINS MinHash samples of a document's shingle set (one-permutation hashing: the
least hash of each range) are folded into a parity bitmap of SKETCH_BITS bits; the population count of two bitmaps' XOR
estimates their similarity and screens the pairs that bands of MinHash values propose. What passes is confirmed exactly.

Documents with equal sets form a class, and only one of them takes part: the least by doc_id (nulls last), then by the row's
hash, which is its id in all that follows.
1. Stars: each member of a bucket meets the bucket's least id, its hub. Where the screen does not rule out a similarity of
   NEAR, both full sets are asked for from the packed blocks; the outcome is the link, and the set's difference from the
   hub's set. NEAR is below the threshold, as copies of one text are often less alike to each other than to that text.
2. Hub tiles: members of one hub in different components are compared exactly from their differences, as
   |x & y| = |h| - |h - x| - |h - y| + |(x ^ h) & (y ^ h)|. A tile of at most 2 x TILE members emits links that join
   components, never all pairs.
3. Bucket tiles: pairs of one bucket of which at least one member's screen with the hub failed, in different components,
   are screened by sketches; the few that pass are confirmed on full sets.
A pair at the threshold of 0.8 misses all 24 bands of 3 values with probability 4e-8; the screen leaves it five standard
deviations of the estimate.

A document without words or with a null text is linked with nothing. With fewer words than a shingle has, the whole
sequence is one shingle. Rows are told apart by a 64-bit hash of doc_id and text: several texts with one id are rows of
their own, each linked by its text; repeated rows are given equal results. A null doc_id is linked like any, but names a
component only where all its ids are null. Extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, among, block_count, packed_blocks, stored, texts_of, unpacked, window_hashes
from .components import components

BANDS, BAND_ROWS = 24, 3
#: Samples of a sketch, and its bits; powers of two.
BINS, SKETCH_BITS = 512, 1024
#: Standard deviations of the estimate that the screen allows a pair at the threshold.
DEVIATIONS = 5
TILE = 512
CHUNK = 64
#: Similarity to reach, and the one to a hub from which members are compared by their differences, in hundredths.
LIKE, NEAR = 80, 30

_draw = np.random.default_rng(20)
_FACTORS = _draw.integers(0, 2**63, BANDS * BAND_ROWS).astype(U64) * U64(2) + U64(1)
_TERMS = _draw.integers(0, 2**63, BANDS * BAND_ROWS).astype(U64)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of `width` words, in lower case (A-Z only)."""
    words = text.encode().lower().split() if text else []
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))
    return np.unique(window_hashes(h, min(width, len(h)), width)) if len(h) else h


def samples(shingles: np.ndarray) -> np.ndarray:
    """MinHash values for the bands, by multiply-add on hashes that are mixed already."""
    out = np.full(len(_FACTORS), 2**64 - 1, U64)
    for a in range(0, len(shingles), 256):
        np.minimum(out, (shingles[a : a + 256, None] * _FACTORS + _TERMS).min(0), out=out)
    return out


def odd_sketch(shingles: np.ndarray) -> tuple[np.ndarray, int]:
    """Of the sorted hashes the least in each of BINS ranges is a sample; its parity bitmap, and the number of samples."""
    at = shingles >> U64(65 - BINS.bit_length())
    low = shingles[np.flatnonzero(np.append(True, at[1:] != at[:-1]))]
    place = ((low ^ (low >> U64(29))) * U64(0xBF58476D1CE4E5B9)) >> U64(65 - SKETCH_BITS.bit_length())
    odd = (np.bincount(place.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64), len(low)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """Keys of the bands, as 64-bit integers."""
    bands = samples(shingles).reshape(BANDS, BAND_ROWS)
    keys = bands[:, 0] * U64(0x9E3779B97F4A7C15) ^ (bands[:, 1] * U64(0xBF58476D1CE4E5B9) >> U64(1)) ^ bands[:, 2] * U64(0x94D049BB133111EB)
    return (keys + np.arange(BANDS, dtype=U64) * U64(0xD6E8FEB86659FD93)).view(np.int64)


def most_different(n_a, n_b, s_a, s_b, like: int, f=np):
    """
    The most bits that sketches of two sets at the threshold differ in. `n_`: sizes of the sets, `s_`: of their samples;
    numbers and arrays, or columns with f=F. At a similarity of J the union has (n_a + n_b) / (1 + J) shingles, which
    reach BINS (1 - (1 - 1/BINS)^union) ranges, in a share J of which both have the same sample.
    """
    j = like / 100
    union = (n_a + n_b) / (1 + j)
    reached = (1 - f.exp(union * float(np.log1p(-1 / BINS)))) * BINS
    spread = reached * (1 - reached / union) * (j * (1 - j))
    differ = (s_a + s_b - reached * (2 * j)) * (2 / SKETCH_BITS)
    differ = (differ + f.abs(differ)) / 2
    kept = f.exp(-1 * differ)  # how much of a further difference shows in the bits
    bits = (1 - kept) * (SKETCH_BITS / 2)
    noise = (1 - kept * kept) * (SKETCH_BITS / 4) - differ * kept * kept * (SKETCH_BITS / 2)
    return bits + f.sqrt(spread * kept * kept * 4 + (noise + f.abs(noise)) / 2) * DEVIATIONS + 2


def _signed(width: int, text: str, doc_id: str, id_: str):
    def sign(left: pa.Table) -> pa.Table:
        rows, out = unpacked(left.column("payload")), []
        for t in texts_of(left.column("payload"), text):
            s = shingle_set(t, width)
            out.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), band_keys(s), *odd_sketch(s)) if len(s) else (0, None, None, None, None))
        kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32()]
        columns = [rows.column(doc_id).cast(pa.int64()), rows.column(id_), *[pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]]
        return pa.table(columns, names=["doc_id", "id", "n_shingles", "set_key", "bands", "sketch", "n_samples"])

    return sign


def _screened(a: str, b: str, like: int) -> Column:
    """Whether two classes can be alike by their sizes, and seem so by their sketches."""
    differ = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i])) for i in range(SKETCH_BITS // 64)])
    sizes = F.least(f"{a}.n_shingles", f"{b}.n_shingles") * 100 >= F.greatest(f"{a}.n_shingles", f"{b}.n_shingles") * like
    return sizes & (differ <= most_different(*[F.col(f"{t}.{c}") for c in ("n_shingles", "n_samples") for t in (a, b)], like, F))


class _Corpus:
    """Packed blocks of rows with their ids, and the check of pairs on full sets."""

    def __init__(self, docs: DataFrame, width: int, like: int):
        names = docs.columns
        self.docs, self.width, self.like = docs, width, like
        self.column, self.doc_id, self.id = f"c{names.index('text')}", f"c{names.index('doc_id')}", f"c{len(names)}"
        self.n_blocks = block_count(docs)
        rows = docs.select("*", F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string")).alias("row"))
        self.blocks = packed_blocks(rows, self.n_blocks, (len(names),))

    def block(self, c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.n_blocks)).cast("int").alias("block")

    def signed(self) -> DataFrame:
        return stored(self.blocks.groupBy("block").applyInArrow(_signed(self.width, self.column, self.doc_id, self.id), "doc_id long, id long, n_shingles long, set_key binary, bands array<long>, sketch array<long>, n_samples int"), "signatures")

    def compared(self, pairs: DataFrame) -> DataFrame:
        """
        u, v, chunk, alike, n_hub, n_lost, difference: for the pairs (a, b) of distinct ids whether their full sets are
        alike, the size of a's set, how many of its members b's lacks, and the symmetric difference. A hub's partners are
        dealt in chunks.
        """
        pairs = stored(pairs, "pairs")
        chunks = stored(pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("n")).where("n > 1"), "chunks")
        chunk = F.pmod(F.xxhash64("b"), F.coalesce("n", F.lit(1))).cast("int").alias("chunk")
        dealt = pairs.join(chunks, "a", "left").select("a", "b", chunk)
        asked = dealt.select("a", "chunk", F.col("b").alias("id")).unionByName(dealt.select("a", "chunk", F.col("a").alias("id")).distinct())
        asked = asked.select(self.block("id"), "a", "chunk", "id")
        width, like, column, id_ = self.width, self.like, self.column, self.id

        def fetch(left: pa.Table, right: pa.Table) -> pa.Table:
            sets: dict[int, bytes] = {}
            if left.num_rows and right.num_rows:
                wanted = set(right.column("id").to_pylist())
                ids = unpacked(left.column("payload")).column(id_).to_pylist()
                for i, text in zip(ids, texts_of(left.column("payload"), column), strict=True):
                    if i in wanted and i not in sets:
                        sets[i] = shingle_set(text, width).tobytes()
            rows = right.filter(pa.array([i in sets for i in right.column("id").to_pylist()], pa.bool_()))
            return pa.table([rows.column("a"), rows.column("chunk"), rows.column("id"), pa.array([sets[i] for i in rows.column("id").to_pylist()], pa.large_binary()).cast(pa.binary())], names=["a", "chunk", "id", "shingles"])

        def confirm(rows: pa.Table) -> pa.Table:
            sets = {i: np.frombuffer(s, U64) for i, s in zip(rows.column("id").to_pylist(), rows.column("shingles").to_pylist(), strict=True)}
            a, chunk = rows.column("a")[0].as_py(), rows.column("chunk")[0].as_py()
            hub, out = sets.pop(a), []
            for b, s in sets.items():
                differ = np.setxor1d(hub, s, assume_unique=True)
                both = (len(hub) + len(s) - len(differ)) // 2
                out.append((a, b, chunk, 100 * both >= like * (both + len(differ)), len(hub), len(hub) - both, differ.tobytes()))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
            return pa.table([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["u", "v", "chunk", "alike", "n_hub", "n_lost", "difference"])

        sets = self.blocks.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(fetch, "a long, chunk int, id long, shingles binary")
        return sets.groupBy("a", "chunk").applyInArrow(confirm, "u long, v long, chunk int, alike boolean, n_hub long, n_lost long, difference binary")


#: How many tiles a key needs, by its members and by those of them that are minor.
_TILES = lambda members, minor: [F.ceil(members / TILE).cast("int").alias("tiles"), F.ceil(minor / TILE).cast("int").alias("minor_tiles")]


def _tiled(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """
    `rows` with the columns `minor`, tiles and minor_tiles, dealt to tiles (key, i, j) of at most about TILE members and
    TILE minor ones: each minor member meets all members of its key, in copies marked by `minor`.
    """
    own, own_minor = (F.pmod(F.xxhash64("id"), F.col(n)).cast("int") for n in ("tiles", "minor_tiles"))
    as_all = rows.select(key, *columns, F.lit(False).alias("minor"), own.alias("i"), F.explode(F.sequence(F.lit(0), F.col("minor_tiles") - 1)).alias("j"))
    as_minor = rows.where("minor").select(key, *columns, F.lit(True).alias("minor"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("i"), own_minor.alias("j"))
    return as_all.unionByName(as_minor).repartition(key, "i", "j")  # else one key's tiles would stay where the join had them


def _sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    minor = t.column("minor").to_numpy(zero_copy_only=False).astype(bool)
    return np.flatnonzero(minor), np.flatnonzero(~minor)


def _hub_tiles(members: DataFrame, like: int) -> DataFrame:
    """
    Links (u, v) between components of one hub's members, compared by their differences from the hub. `members`: hub,
    chunk, id, component, n_hub, n_lost, difference. In a hub's group those outside its least component meet all. What is
    known of a hub reaches its members chunk by chunk.
    """
    each = members.groupBy("hub", "component").agg(F.count("*").alias("n"), F.max("chunk").alias("last"))
    hubs = each.groupBy("hub").agg(F.min("component").alias("least"), F.sum("n").alias("n"), F.min_by("n", "component").alias("n_least"), F.max("last").alias("last"), F.count("*").alias("components")).where("components > 1")
    hubs = hubs.select("hub", "least", *_TILES(F.col("n"), F.col("n") - F.col("n_least")), F.explode(F.sequence(F.lit(0), F.col("last"))).alias("chunk"))
    rows = members.join(hubs, ["hub", "chunk"]).withColumn("minor", F.col("component") != F.col("least"))

    def compare(t: pa.Table) -> pa.Table:
        ids, comp, lost, n_hub = (t.column(c).to_numpy() for c in ("id", "component", "n_lost", "n_hub"))
        comp = comp.copy()
        differ = [np.frombuffer(d.as_buffer(), U64) for d in t.column("difference")]
        size = n_hub + np.array(list(map(len, differ))) - 2 * lost
        a, b = _sides(t)
        owner = np.repeat(np.arange(len(b)), [len(differ[y]) for y in b])
        values, place = np.unique(np.concatenate([differ[y] for y in b]) if len(b) else np.empty(0, U64), return_inverse=True)
        marked, out = np.zeros(len(values) + 1, bool), []
        for x in a:
            at = np.searchsorted(values, differ[x])
            at = at[among(differ[x], values)]
            marked[at] = True
            shared = np.bincount(owner, marked[place], len(b)).astype(np.int64)
            marked[at] = False
            both = n_hub[x] - lost[x] - lost[b] + shared
            alike = np.flatnonzero((100 * both >= like * (size[x] + size[b] - both)) & (comp[b] != comp[x]))
            found, first = np.unique(comp[b[alike]], return_index=True)
            out += [(ids[x], ids[y]) for y in b[alike[first]]]
            comp[np.isin(comp, found)] = comp[x]
        return pa.table([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return _tiled(rows, "hub", ["id", "component", "n_hub", "n_lost", "difference"]).groupBy("hub", "i", "j").applyInArrow(compare, "u long, v long")


def _bucket_tiles(entries: DataFrame, like: int) -> DataFrame:
    """
    Pairs (a, b) of one bucket in different components that pass the screen, unless both are `near` the bucket's hub.
    `entries`: key, id, component, near, tiles, minor_tiles, n_shingles, sketch, n_samples.
    """
    rows = entries.withColumn("minor", ~F.col("near"))

    def compare(t: pa.Table) -> pa.Table:
        ids, comp, n, s = (t.column(c).to_numpy() for c in ("id", "component", "n_shingles", "n_samples"))
        sketch = np.array(t.column("sketch").to_pylist(), np.int64).view(U64).reshape(len(ids), -1)
        a, b = _sides(t)
        out = []
        for x in a:
            y = b[(np.minimum(n[b], n[x]) * 100 >= np.maximum(n[b], n[x]) * like) & (comp[b] != comp[x])]
            differ = np.bitwise_count(sketch[y] ^ sketch[x]).sum(1)
            out += [(min(ids[x], z), max(ids[x], z)) for z in ids[y[differ <= most_different(n[x], n[y], s[x], s[y], like)]]]
        return pa.table([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return _tiled(rows, "key", ["id", "component", "n_shingles", "sketch", "n_samples"]).groupBy("key", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def _clusters(docs: DataFrame, width: int, like: int) -> tuple[_Corpus, DataFrame]:
    """The corpus; doc_id, id, n_shingles, head (of the row's component: doc_id and id; null without words)."""
    corpus = _Corpus(docs, width, like)
    signed = corpus.signed()
    facts = ["n_shingles", "sketch", "n_samples"]
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "id")
    classes = signed.where(F.col("set_key").isNotNull()).groupBy("set_key").agg(F.min(first).alias("head"), *[F.first(c).alias(c) for c in ("bands", *facts)])
    classes = stored(classes.select("set_key", "head", F.col("head.id").alias("id"), "bands", *facts), "classes")
    entries = classes.select(F.explode("bands").alias("key"), "id")
    facts = classes.select("id", *facts)
    # tables of what is known of a key are stored, so that joins with them split keys that many rows have
    hubs = stored(entries.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", "hub"), "hubs")
    entries = stored(entries.join(hubs, "key").where(F.col("id") != F.col("hub")), "buckets")  # only buckets with company
    stars = entries.select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    stars = stars.join(facts.alias("x"), F.col("a") == F.col("x.id")).join(facts.alias("y"), F.col("b") == F.col("y.id")).where(_screened("x", "y", min(like, NEAR))).select("a", "b")
    compared = stored(corpus.compared(stars), "stars")
    links = compared.where("alike").select("u", "v")
    comps = stored(components(links), "components")
    component = F.coalesce("component", "id").alias("component")

    members = compared.select(F.col("u").alias("hub"), "chunk", F.col("v").alias("id"), "n_hub", "n_lost", "difference").join(comps, "id", "left").select("hub", "chunk", "id", component, "n_hub", "n_lost", "difference")
    links = stored(links.unionByName(_hub_tiles(members, like)), "links")
    comps = stored(components(links), "components")

    near = compared.select(F.col("u").alias("hub"), F.col("v").alias("id"), F.lit(True).alias("near"))
    labelled = stored(entries.join(near, ["hub", "id"], "left").join(comps, "id", "left").select("key", "id", F.coalesce("near", F.lit(False)).alias("near"), component), "labelled")
    several = labelled.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"), *_TILES(F.count("*"), F.count_if(~F.col("near")))).where("least <> most AND minor_tiles > 0").select("key", "tiles", "minor_tiles")
    rest = _bucket_tiles(labelled.join(stored(several, "several"), "key").join(facts, "id"), like)
    more = stored(corpus.compared(rest).where("alike").select("u", "v"), "links")
    if not more.isEmpty():
        comps = stored(components(stored(links.unionByName(more), "links")), "components")
    member = classes.select("set_key", "head", "id").join(comps, "id", "left").select("set_key", "head", component)
    heads = stored(member.groupBy("component").agg(F.min("head").alias("head")), "heads")
    member = member.select("set_key", "component").join(heads, "component").select("set_key", "head")
    return corpus, signed.select("doc_id", "id", "n_shingles", "set_key").join(member, "set_key", "left").select("doc_id", "id", "n_shingles", "head")


def near_duplicates(docs: DataFrame, width: int = 5, like: int = LIKE) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links), kept."""
    _, out = _clusters(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")), width, like)
    out = out.select("doc_id", "n_shingles", F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("component_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_near_duplicates(docs: DataFrame, width: int = 5, like: int = LIKE) -> DataFrame:
    """
    The rows of `docs`, all columns, less near duplicates: of each component one row stays, the first of its head's
    repeated rows; rows without words all stay. Ids travel to the packed blocks, texts stay there.
    """
    names = docs.columns
    corpus, out = _clusters(docs, width, like)
    gone = out.where(F.col("id") != F.col("head.id")).select(corpus.block("id"), "id")
    text, id_ = corpus.column, corpus.id
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(plain.schema)

    def keep(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        rows = unpacked(left.column("payload"))
        stay = ~pa.compute.is_in(rows.column(id_), value_set=right.column("id").combine_chunks()).to_numpy(zero_copy_only=False).astype(bool)
        again = np.ones(rows.num_rows, bool)
        again[np.unique(rows.column(id_).to_numpy(), return_index=True)[1]] = False
        for i in np.flatnonzero(again & stay):
            t = rows.column(text)[int(i)].as_py()
            stay[i] = not (t and t.encode().split())
        return rows.filter(pa.array(stay)).select(schema.names)

    return corpus.blocks.groupBy("block").cogroup(gone.groupBy("block")).applyInArrow(keep, plain.schema).toDF(*names)


def op6_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Two-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 2)
