"""
Near duplicates among embeddings by a forest of random-projection trees. Each tree splits the vectors again and again by
random hyperplanes; those within a margin of a plane go to both sides (spill overlap). Vectors are compared within leaves,
in double precision and on the full vectors, and what is alike is united.

1. Vectors with equal components form a class, which takes part once. Nulls, zeros, and vectors with null or non-finite
   components link with nothing, and vectors of different lengths never do.
2. Trees grow DEPTH levels at a time from a sample of SAMPLE vectors a node, by which planes and places of splits are
   chosen; every vector is routed. Nodes with more than LEAF vectors grow on in the next round, so the number of leaves is
   proportional to the number of vectors.
3. A node that no plane parts well is dense. From a tree without overlap, dense nodes yield balls: vectors so near to a hub
   that any two of them are alike, by the angles. Links in a ball are counted and united without comparing. What of a dense
   leaf is outside its largest ball meets the leaf's vectors in tiles of bounded size; so the work in a group of near
   copies grows with its square only as far as it lies in no ball.
4. A pair that meets in several leaves counts in the least of them, so pairs are never rows: a tile emits a number for each
   vector, and the links that unite its components.

Repeated rows and rows with one id are rows of their own, each linked by its vector. A null vec_id is linked like any, but
names a component only where all its ids are null. An empty table has no rows. Other columns are not read.

`recall` compares a sample of the vectors with all others by brute force, in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, release_memory, spread, stored
from .components import components

LIKE = 0.9
TREES, DEPTH, LEAF = 6, 10, 1024
#: Vectors of a node that a round's planes are chosen by, at most about.
SAMPLE = 32_768
#: Half the margin's width, in standard deviations of what a plane tells apart two vectors at the threshold.
SPILL = 0.4
#: Planes tried for a split, the quantiles of its place, and the share of pairs in a node that a good split may leave together.
PLANES, PLACES, GOOD = 3, (0.3, 0.4, 0.5, 0.6, 0.7), 0.88
#: Hubs of a dense node at most, and vectors of the sample that it takes to tell.
HUBS, TELLING = 8, 64
#: Trees that are broadcast at most, and vectors of a chunk beyond that.
FEW, CHUNK = 64, 50_000
#: What rounding may do to a cosine.
ROUNDING = 1e-9
TILE = 512
SEED = 11


def _vectors(embeddings: DataFrame, column: str, key: str) -> DataFrame:
    """vec_id, key (null where the vector links with nothing), v: the components as given, little-endian, as float or double."""
    single = embeddings.schema[column].dataType.elementType.typeName() == "float"
    kind, arrow = (np.dtype("<f4"), pa.float32()) if single else (np.dtype("<f8"), pa.float64())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import md5

        for b in batches:
            keys, out = [], []
            for x in b.column(1):
                values = x.values
                v = values.cast(arrow).to_numpy() if values is not None and not values.null_count else np.empty(0, kind)
                with np.errstate(over="ignore", invalid="ignore"):
                    length = float(np.square(v.astype(np.float64)).sum())
                good = math.isfinite(length) and length > 0
                v = (v + kind.type(0)).astype(kind).tobytes() if good else None  # -0.0 becomes 0.0
                keys.append(md5(v).digest() if good else None)
                out.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(out, pa.binary())], names=["vec_id", "key", "v"])

    rows = spread(embeddings.select(embeddings[key].cast("long").alias("vec_id"), embeddings[column].cast(f"array<{'float' if single else 'double'}>").alias("e")))
    return rows.mapInArrow(pack, "vec_id long, key binary, v binary")


def _units(v: pa.ChunkedArray | pa.Array, single: bool) -> np.ndarray:
    """Vectors of one length, scaled to length 1, in double precision."""
    x = np.frombuffer(b"".join(v.to_pylist()), "<f4" if single else "<f8").reshape(len(v), -1).astype(np.float64)
    return x / np.sqrt(np.square(x).sum(1))[:, None]


def _planes(tree: int, node: int, at: int, length: int) -> np.ndarray:
    """The planes that may split place `at` of a node, by their normals."""
    draw = np.random.default_rng([SEED, tree, node & (2**63 - 1), at]).standard_normal((PLANES, length))
    return draw / np.sqrt(np.square(draw).sum(1))[:, None]


def _margin(like: float, length: int) -> float:
    """A plane tells apart two vectors at the threshold by a normal deviate of their distance / sqrt(length)."""
    return SPILL * math.sqrt(2 - 2 * like) / math.sqrt(length)


class _Tree:
    """DEPTH levels from a node on. Place 1 is the node, and place k splits into 2k and 2k + 1."""

    def __init__(self, tree: int, node: int, plane: np.ndarray, place: np.ndarray, hubs: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.tree, self.node, self.plane, self.place, self.hubs = tree, node, plane, place, hubs

    @classmethod
    def fit(cls, x: np.ndarray, ids: np.ndarray, tree: int, node: int, n: int, margin: float, near: float, leaf: int, depth: int) -> _Tree:
        """`x`: the sample, `n`: the node's vectors. Without overlap (tree 0) the dense places get hubs."""
        grown = cls(tree, node, np.full(2**depth, -1, np.int8), np.zeros(2**depth), {})
        open_ = [(1, np.arange(len(x)))]
        while open_:
            at, own = open_.pop()
            if at >= 2**depth or len(own) * n <= leaf * len(x) or len(own) < 2:
                continue
            best = (math.inf,)
            for p, normal in enumerate(_planes(tree, node, at, x.shape[1])):
                z = x[own] @ normal
                for place in np.quantile(z, PLACES):
                    left, right = (z <= place + margin).mean(), (z > place - margin).mean()
                    if (z <= place).any() and (z > place).any():
                        best = min(best, (left**2 + right**2, p, place))
            told = len(own) >= TELLING or at == 1  # a few vectors of the sample don't tell; then the next round does
            if best[0] < GOOD or (not told and best[0] < math.inf):
                grown.plane[at], grown.place[at] = best[1:]
                z = x[own] @ _planes(tree, node, at, x.shape[1])[best[1]]
                over = margin if tree else 0
                open_ += [(2 * at, own[z <= best[2] + over]), (2 * at + 1, own[z > best[2] - over])]
            elif told:
                own = own[: 0 if tree else LEAF]
                grown.hubs[at] = cls._hubs(x[own], ids[own], near)
        return grown

    @staticmethod
    def _hubs(x: np.ndarray, ids: np.ndarray, near: float) -> tuple[np.ndarray, np.ndarray]:
        close, open_, found = x @ x.T >= near, np.ones(len(x), bool), []
        while len(x) and len(found) < HUBS and (most := int((close & open_).sum(1).argmax())) not in found and (close[most] & open_).sum() > 1:
            found.append(most)
            open_ &= ~close[most]
        return ids[found], x[found]

    def routed(self, x: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the place that each ends at; rows can end at several."""
        rows, places, open_ = [], [], [(1, np.arange(len(x)))]
        while open_:
            at, own = open_.pop()
            if not len(own):
                continue
            if at >= len(self.plane) or self.plane[at] < 0:
                rows.append(own)
                places.append(np.full(len(own), at))
                continue
            z = x[own] @ _planes(self.tree, self.node, at, x.shape[1])[self.plane[at]]
            open_ += [(2 * at, own[z <= self.place[at] + margin]), (2 * at + 1, own[z > self.place[at] - margin])]
        return np.concatenate(rows), np.concatenate(places)

    def dumped(self) -> bytes:
        import pickle

        return pickle.dumps((self.tree, self.node, self.plane, self.place, self.hubs))

    @classmethod
    def loaded(cls, data: bytes) -> _Tree:
        import pickle

        return cls(*pickle.loads(data))


class _Forest:
    """`classes`: id, n (rows), v; a stored table."""

    def __init__(self, classes: DataFrame, single: bool, like: float, trees: int, leaf: int):
        self.classes, self.single, self.like, self.trees, self.leaf = classes, single, like, trees, leaf
        self.near = math.sqrt((1 + like) / 2) + ROUNDING  # the cosine of half the angle
        self.used: list[DataFrame] = []  # tables that may go once what grown() gave has been written

    def grown(self, trees: list[int]) -> DataFrame:
        """id, leaf, ball: each vector in its leaves (hashes of tree and way); tree 0 has no overlap, and tells balls."""
        first = self.classes.select("id", F.explode(F.array(*map(F.lit, trees))).alias("tree"), F.octet_length("v").cast("long").alias("node"), "v")
        out, open_, sizes = None, first, stored(first.groupBy("tree", "node").agg(F.count("*").alias("n")), "nodes")
        while True:
            routed = self._round(open_, sizes)
            counts = stored(routed.where(~F.col("dense")).groupBy("tree", "leaf").agg(F.count("*").alias("n")).where(F.col("n") > self.leaf), "nodes")
            self.used += [sizes, routed]
            done = routed.join(counts.select("leaf"), "leaf", "left_anti").select("id", "tree", "leaf", "ball")
            out = done if out is None else out.unionByName(done)
            if counts.isEmpty():
                self.used.append(counts)
                return out
            sizes = counts.select("tree", F.col("leaf").alias("node"), "n")
            sizes.stored_at = counts.stored_at
            open_ = routed.join(sizes.select(F.col("node").alias("leaf")), "leaf").select("id", "tree", F.col("leaf").alias("node")).join(self.classes.select("id", "v"), "id").select("id", "tree", "node", "v")

    def _round(self, rows: DataFrame, sizes: DataFrame) -> DataFrame:
        """id, tree, leaf, dense, ball: where `rows` (id, tree, node, v) end by the trees that grow from their nodes."""
        single, near, leaf, depth, margin = self.single, self.near, self.leaf, DEPTH, partial(_margin, self.like)

        def fit(t: pa.Table) -> pa.Table:
            t = t.take(pa.array(np.argsort(t.column("id").to_numpy(), kind="stable")))
            x = _units(t.column("v"), single)
            tree, node, n = (t.column(c)[0].as_py() for c in ("tree", "node", "n"))
            grown = _Tree.fit(x, t.column("id").to_numpy(), tree, node, n, margin(x.shape[1]), near, leaf, depth)
            return pa.table([pa.array([tree], pa.int32()), pa.array([node], pa.int64()), pa.array([grown.dumped()], pa.binary())], names=["tree", "node", "model"])

        def route(grown: _Tree, ids: np.ndarray, v: pa.Array) -> list[pa.Array]:
            x = _units(v, single)
            at, place = grown.routed(x, margin(x.shape[1]) if grown.tree else 0.0)
            ball = np.full(len(at), -1, np.int64)
            for p, (hubs, centres) in grown.hubs.items() if grown.tree == 0 else ():
                here = np.flatnonzero(place == p)
                if len(here) and len(hubs):
                    close = x[at[here]] @ centres.T >= near
                    ball[here] = np.where(close.any(1), hubs[close.argmax(1)], -1)
            dense = np.isin(place, list(grown.hubs))
            return [pa.array(ids[at]), pa.array(np.full(len(at), grown.tree, np.int32)), pa.array(np.full(len(at), grown.node)), pa.array(place.astype(np.int64)), pa.array(dense), pa.array(ball, mask=ball < 0)]

        names, schema = ["id", "tree", "node", "place", "dense", "ball"], "id long, tree int, node long, place long, dense boolean, ball long"

        # about SAMPLE of each node, as hashes have it, whatever its size
        chosen = rows.join(sizes, ["tree", "node"]).where(F.pmod(F.xxhash64("id", "tree"), F.col("n")) < SAMPLE)
        models = stored(chosen.groupBy("tree", "node").applyInArrow(fit, "tree int, node long, model binary"), "trees")
        if sizes.count() <= FEW:
            shared = rows.sparkSession.sparkContext.broadcast({(r.tree, r.node): bytes(r.model) for r in models.collect()})

            def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                grown = {k: _Tree.loaded(m) for k, m in shared.value.items()}
                for b in batches:
                    trees, nodes = b.column(1).to_numpy(), b.column(2).to_numpy()
                    for (tree, node), model in grown.items():
                        own = np.flatnonzero((trees == tree) & (nodes == node))
                        if len(own):
                            yield pa.RecordBatch.from_arrays(route(model, b.column(0).to_numpy()[own], b.column(3).take(pa.array(own))), names=names)
                release_memory()

            found = rows.select("id", "tree", "node", "v").mapInArrow(each, schema)
        else:
            # a node's vectors meet its trees in chunks
            chunks = F.ceil(F.col("n") / CHUNK)
            dealt = rows.join(sizes, ["tree", "node"]).select("id", "tree", "node", "v", F.pmod(F.xxhash64("id"), chunks).alias("chunk"))
            copies = models.join(sizes, ["tree", "node"]).select("tree", "node", "model", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk"))

            def meet(left: pa.Table, right: pa.Table) -> pa.Table:
                if not left.num_rows:
                    return pa.schema([("id", pa.int64()), ("tree", pa.int32()), ("node", pa.int64()), ("place", pa.int64()), ("dense", pa.bool_()), ("ball", pa.int64())]).empty_table()
                return pa.table(route(_Tree.loaded(right.column("model")[0].as_py()), left.column("id").to_numpy(), left.column("v")), names=names)

            keys = ["tree", "node", "chunk"]
            found = dealt.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInArrow(meet, schema)
        routed = stored(found.select("id", "tree", F.xxhash64("tree", "node", "place").alias("leaf"), "dense", "ball"), "routed")
        discard(models)
        return routed

    def compared(self, leaves: DataFrame, balls: DataFrame) -> DataFrame:
        """
        id, gain, other: rows with `gain` say how many rows are alike to a vector in other balls, those with `other` unite.
        `leaves`: id, leaf; `balls`: id, ball.
        """
        single, like = self.single, self.like
        facts = leaves.groupBy("id").agg(F.collect_set("leaf").alias("leaves")).join(balls, "id", "left").join(self.classes, "id")
        rows = stored(facts.select("id", "n", "v", "ball", "leaves"), "placed")
        each = rows.select("id", "ball", F.explode("leaves").alias("leaf"))
        of_ball = each.groupBy("leaf", "ball").agg(F.count("*").alias("c"))
        # nulls are no ball; a leaf that is one ball has nothing to compare
        size = of_ball.groupBy("leaf").agg(F.sum("c").alias("c"), F.max_by("ball", F.when(F.col("ball").isNotNull(), F.col("c"))).alias("major"), F.max(F.when(F.col("ball").isNotNull(), F.col("c"))).alias("c_major"))
        minor = F.col("c") - F.coalesce("c_major", F.lit(0))
        small = F.col("c") <= 2 * self.leaf
        tiles = lambda c: F.when(small, 1).otherwise(F.ceil(c / TILE)).cast("int")
        size = stored(size.where((minor > 0) & (F.col("c") > 1)).select("leaf", "major", tiles(F.col("c")).alias("tiles"), tiles(minor).alias("minor_tiles")), "leaves")
        wide = rows.select("id", "n", "v", "ball", "leaves", F.explode("leaves").alias("leaf")).join(size, "leaf")
        wide = wide.withColumn("is_minor", ~(F.col("ball").eqNullSafe(F.col("major")) & F.col("major").isNotNull()))
        own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        # a leaf that is one tile is sent once
        wide = wide.withColumn("alone", F.col("tiles") * F.col("minor_tiles") == 1)
        columns = ["leaf", "id", "n", "v", "ball", "leaves", "is_minor", "alone"]
        as_all = wide.select(*columns, F.lit(False).alias("ask"), own("tiles").alias("i"), F.explode(F.sequence(F.lit(0), F.col("minor_tiles") - 1)).alias("j"))
        as_minor = wide.where("is_minor AND NOT alone").select(*columns, F.lit(True).alias("ask"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("i"), own("minor_tiles").alias("j"))

        def compare(t: pa.Table) -> pa.Table:
            ask = t.column("ask").to_numpy(zero_copy_only=False).astype(bool)
            alone = t.column("alone")[0].as_py()
            a, b = (t.filter(t.column("is_minor")), t) if alone else (t.filter(pa.array(ask)), t.filter(pa.array(~ask)))
            if not a.num_rows or not b.num_rows:
                return pa.table([pa.array([], pa.int64())] * 3, names=["id", "gain", "other"])
            leaf = t.column("leaf")[0].as_py()
            sides = [_Side(s, leaf, k, single) for k, s in enumerate((a, b))]
            return _alike(*sides, like)

        return as_all.unionByName(as_minor).repartition("leaf", "i", "j").groupBy("leaf", "i", "j").applyInArrow(compare, "id long, gain long, other long")


class _Side:
    """One side of a tile. `earlier`: each vector's leaves before this one, filled up with a number of the side's own."""

    def __init__(self, t: pa.Table, leaf: int, side: int, single: bool):
        self.ids, self.n = t.column("id").to_numpy(), t.column("n").to_numpy()
        self.ball = t.column("ball").fill_null(-1 - side).to_numpy()
        self.minor = t.column("is_minor").to_numpy(zero_copy_only=False).astype(bool)
        self.x = _units(t.column("v"), single)
        before = [[k for k in own if k < leaf] for own in t.column("leaves").to_pylist()]
        self.earlier = np.full((len(before), max(map(len, before))), -(2**63) + side, np.int64)
        for r, own in enumerate(before):
            self.earlier[r, : len(own)] = own


def _alike(a: _Side, b: _Side, like: float) -> pa.Table:
    """Every minor vector meets all of its tile; where both are minor, another tile has them the other way round."""
    gain_a, gain_b = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)
    ids = np.unique(np.concatenate([a.ids, b.ids]))
    at_a, at_b, up, links = np.searchsorted(ids, a.ids), np.searchsorted(ids, b.ids), np.arange(len(ids)), []
    for s in range(0, len(a.ids), 256):
        own = slice(s, s + 256)
        close = (a.x[own] @ b.x.T >= like) & (a.ids[own, None] != b.ids) & (a.ball[own, None] != b.ball)
        p, q = np.nonzero(close)
        p += s
        fresh = np.ones(len(p), bool)
        for c in range(0, len(p), 16_384):
            e = slice(c, c + 16_384)
            fresh[e] = ~(a.earlier[p[e]][:, :, None] == b.earlier[q[e]][:, None, :]).any((1, 2))
        p, q = p[fresh], q[fresh]
        np.add.at(gain_a, p, b.n[q])
        np.add.at(gain_b, q, np.where(b.minor[q], 0, a.n[p]))
        starts = np.flatnonzero(np.append(True, p[1:] != p[:-1])) if len(p) else []
        for k, z in zip(starts, [*starts[1:], len(p)], strict=False):
            x, found = at_a[p[k]], at_b[q[k:z]]
            tops, which = np.unique(up[found], return_index=True)
            for top, w in zip(tops, which, strict=True):
                if top != up[x]:
                    links.append((ids[x], ids[found[w]]))
                    up[up == top] = up[x]
    gain, n = np.concatenate([gain_a, gain_b]), np.concatenate([a.ids, b.ids])
    n, gain = n[gain > 0], gain[gain > 0]
    u, v = np.array(links, np.int64).reshape(-1, 2).T
    return pa.table([pa.array(np.concatenate([n, u])), pa.array(np.concatenate([gain, np.zeros(len(u), np.int64)])), pa.array(np.concatenate([np.zeros(len(n), np.int64), v]), mask=np.arange(len(n) + len(v)) < len(n))], names=["id", "gain", "other"])


def near_duplicates(embeddings: DataFrame, like: float = LIKE, key: str = "vec_id", column: str = "embedding", trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """A row for each of `embeddings`: vec_id, n_links (other rows alike), component_id (least vec_id reachable), kept."""
    single = embeddings.schema[column].dataType.elementType.typeName() == "float"
    rows = stored(_vectors(embeddings, column, key), "vectors")
    named = rows.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("v").alias("v"))
    named = stored(named.withColumn("id", F.monotonically_increasing_id()), "classes")
    forest = _Forest(named.select("id", "n", "v"), single, like, trees, leaf)
    balls = stored(forest.grown([0]).where(F.col("ball").isNotNull()).select("id", "ball"), "balls")
    leaves = stored(forest.grown(list(range(1, trees + 1))).select("id", "leaf"), "leaves")
    discard(*forest.used)
    found = stored(forest.compared(leaves, balls), "found")

    links = found.where(F.col("other").isNotNull()).select(F.col("id").alias("u"), F.col("other").alias("v")).unionByName(balls.select(F.col("id").alias("u"), F.col("ball").alias("v")))
    united = components(links)
    member = stored(named.select("key", "id", "least", "n").join(united, "id", "left").withColumn("component", F.coalesce("component", "id")), "members")
    heads = member.groupBy("component").agg(F.min("least").alias("head"))
    in_ball = stored(member.select("id", "n").join(balls, "id").groupBy("ball").agg(F.sum("n").alias("in_ball")), "ball_sizes")
    gains = found.groupBy("id").agg(F.sum("gain").alias("gain"))
    known = member.join(gains, "id", "left").join(balls, "id", "left").join(in_ball, "ball", "left").join(heads, "component")
    n_links = F.coalesce("in_ball", "n") - 1 + F.coalesce("gain", F.lit(0))
    known = stored(known.select("key", n_links.alias("n_links"), "head"), "known")
    out = rows.select("vec_id", "key").join(known, "key", "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("head"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def recall(embeddings: DataFrame, found: DataFrame, chosen: Column, like: float = LIKE, key: str = "vec_id", column: str = "embedding") -> float:
    """
    The share of links found (n_links of `found`) of those that brute force finds for the `chosen` rows, a bounded set that
    is broadcast. Ids must be distinct.
    """
    single = embeddings.schema[column].dataType.elementType.typeName() == "float"
    rows = _vectors(embeddings, column, key).where(F.col("key").isNotNull())
    asked = [(r.vec_id, bytes(r.v)) for r in rows.where(chosen).select("vec_id", "v").collect()]
    shared = embeddings.sparkSession.sparkContext.broadcast(asked)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.array([i for i, _ in shared.value], np.int64)
        x = _units(pa.array([v for _, v in shared.value], pa.binary()), single)
        total = np.zeros(len(ids), np.int64)
        for b in batches:
            if b.num_rows:
                total += ((x @ _units(b.column(1), single).T >= like) & (ids[:, None] != b.column(0).to_numpy())).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["vec_id", "n"])

    true = rows.select("vec_id", "v").mapInArrow(count, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n"))
    got = true.join(found.select("vec_id", "n_links"), "vec_id").agg(F.sum("n"), F.sum("n_links")).first()
    return 1.0 if not got[0] else got[1] / got[0]


def op11_embedding_forest(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
