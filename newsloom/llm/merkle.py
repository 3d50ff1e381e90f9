"""
Merkle manifest of a dataset: a digest of each row, a tree over each group's rows, one root over the groups, and a proof
for each row, by which anybody can tell from the row and the root alone whether it is unchanged.

1. Spark hashes each row, sorts the digests by group and key in ranges, and numbers them from the counts of the ranges.
2. Runs of fanout^k consecutive leaves are blocks: a task reduces each to one digest and keeps its leaves as one row.
   Blocks grow with the table, so that there are at most TOP of them and one a group.
3. The driver builds the small tree above the blocks and broadcasts each block's path from there to the root.
4. Tasks rebuild their blocks' levels, and append that path: a row's proof. Rows are folded by Spark functions.

The groups' names are taken as a code list: the driver holds one digest for each. A null group comes first, others follow by
their UTF-8 bytes. Null keys come first in a group, rows with one key follow by their digests; equal rows are leaves of
their own. Null fields count as `-`, an empty text as `0:`; texts are hashed whole. An empty table has no rows and no root.
Fields not named are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import release_memory, stored

FANOUT = 2
#: Leaves of a block at least, and the most blocks (besides one a group) that the driver's tree stands on.
BLOCK, TOP = 4096, 16_384
PROOF = "array<struct<before:string,after:string>>"


def H(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def row_digest(*fields: Column) -> Column:
    """sha256 of the fields: each `-` if null, else its UTF-8 byte count, a colon and the value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def raised(nodes: Sequence[str], fanout: int) -> list[str]:
    """The level above: each run of `fanout` consecutive nodes becomes its digest."""
    return [H(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]


def levels(nodes: Sequence[str], fanout: int, least: int = 0) -> list[list[str]]:
    """All levels up to one node, with at least `least` above the first."""
    out = [list(nodes)]
    while len(out[-1]) > 1 or len(out) <= least:
        out.append(raised(out[-1], fanout))
    return out


def beside(tree: list[list[str]], at: int, fanout: int) -> list[tuple[str, str]]:
    """The others of each run from a node to the top: what stands before it, and after it."""
    out = []
    for level in tree[:-1]:
        first = at - at % fanout
        out.append(("".join(level[first:at]), "".join(level[at + 1 : first + fanout])))
        at //= fanout
    return out


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, leaf, lambda node, level: F.sha2(F.concat(level["before"], node, level["after"]), 256))


def _numbered(leaves: DataFrame) -> DataFrame:
    """`leaves` (group, key, leaf, altered) with `at`, their place in the group, and `n`, the group's size."""
    session = leaves.sparkSession
    parts = int(session.conf.get("spark.sql.shuffle.partitions"))
    dealt = leaves.repartitionByRange(parts, F.col("group"), F.col("key").asc_nulls_first(), "leaf", "row").sortWithinPartitions("group", F.col("key").asc_nulls_first(), "leaf", "row")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            groups = np.array(b.column(0).to_pylist(), object)
            place = np.empty(len(groups), np.int64)
            starts = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
            for a, z in zip(starts, [*starts[1:], len(groups)], strict=True):
                seen = seen if groups[a] == last else 0
                place[a:z] = np.arange(seen, seen + z - a)
                last, seen = groups[a], seen + z - a
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(np.full(len(groups), part, np.int32)), pa.array(place)], names=["group", "key", "leaf", "altered", "part", "seq"])

    placed = stored(dealt.select("group", "key", "leaf", "altered").mapInArrow(count, "group string, key long, leaf string, altered string, part int, seq long"), "leaves")
    # one row for each range and each group, as groups lie in consecutive ranges
    counts = placed.groupBy("group", "part").agg(F.count("*").alias("c"))
    own = Window.partitionBy("group")
    before = counts.select("group", "part", (F.sum("c").over(own.orderBy("part")) - F.col("c")).alias("before"), F.sum("c").over(own).alias("n"))
    return placed.join(stored(before, "ranges"), ["group", "part"]).select("group", "key", "leaf", "altered", (F.col("before") + F.col("seq")).alias("at"), "n")


def manifest(docs: DataFrame, key: str = "doc_id", group: str | None = "lang", fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), altered: Column | None = None, fanout: int = FANOUT, block: int = BLOCK, top: int = TOP) -> DataFrame:
    """
    A row for each of `docs`: key, leaf, altered, subroot (of its group), root, proof (of each level from the leaf to the
    root the nodes before and after it in its run, as hex text). `key` is an integer; `group` None: one group. `altered` is a
    string column over `docs` that goes along with each row, such as the digest of what somebody takes the row for.
    """
    name = docs[group].cast("string") if group else F.lit("")
    # '-' stands before '=', so the null group comes first
    named = F.coalesce(F.concat(F.lit("="), name), F.lit("-"))
    rows = docs.select(named.alias("group"), docs[key].cast("long").alias("key"), row_digest(*[docs[f] for f in fields]).alias("leaf"), (F.lit(None).cast("string") if altered is None else altered).alias("altered"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "digests")  # only to part equal rows
    total = rows.count()
    height = 0
    while fanout**height < max(block, -(-total // top)):
        height += 1
    size = fanout**height

    def reduce(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("at").to_numpy(), kind="stable")
        t = t.take(pa.array(order))
        nodes = t.column("leaf").to_pylist()
        several = t.column("n")[0].as_py() > size
        tree = levels(nodes, fanout, height if several else 0)
        digests = b"".join(map(bytes.fromhex, nodes))
        keys = t.column("key").combine_chunks()
        return pa.table([t.column("group")[:1], t.column("block")[:1], pa.array(tree[-1]), pa.array([keys.to_pylist()], pa.list_(pa.int64())), pa.array([digests], pa.binary()), pa.array([t.column("altered").to_pylist()], pa.list_(pa.string()))], names=["group", "block", "node", "keys", "leaves", "altered"])

    placed = _numbered(rows).withColumn("block", F.floor(F.col("at") / size))
    blocks = stored(placed.groupBy("group", "block").applyInArrow(reduce, "group string, block long, node string, keys array<long>, leaves binary, altered array<string>"), "blocks")

    above = _above(blocks, fanout)
    shared = docs.sparkSession.sparkContext.broadcast(above)  # at most `top` blocks and one a group, with a path of a few digests each

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, subroots, paths = shared.value
        for b in batches:
            for g, k, keys, packed, others in zip(*(c.to_pylist() for c in b.columns), strict=True):
                nodes = [packed[i : i + 32].hex() for i in range(0, len(packed), 32)]
                several, path = paths[g, k]
                tree = levels(nodes, fanout, height if several else 0)
                for a in range(0, len(nodes), 4096):
                    z = min(a + 4096, len(nodes))
                    proofs = [[*beside(tree, at, fanout), *path] for at in range(a, z)]
                    flat = list(chain.from_iterable(proofs))
                    steps = pa.StructArray.from_arrays([pa.array([s[i] for s in flat], pa.string()) for i in (0, 1)], ["before", "after"])
                    offsets = np.cumsum([0, *map(len, proofs)]).astype(np.int32)
                    columns = [pa.array(keys[a:z], pa.int64()), pa.array(nodes[a:z]), pa.array(others[a:z], pa.string()), pa.array([subroots[g]] * (z - a)), pa.array([root] * (z - a)), pa.ListArray.from_arrays(pa.array(offsets), steps)]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "leaf", "altered", "subroot", "root", "proof"])
        release_memory()

    out = blocks.select("group", "block", "keys", "leaves", "altered").mapInArrow(prove, f"key long, leaf string, altered string, subroot string, root string, proof {PROOF}")
    return out.withColumnRenamed("key", key)


def _above(blocks: DataFrame, fanout: int) -> tuple[str | None, dict[str, str], dict[tuple[str, int], tuple[bool, list[tuple[str, str]]]]]:
    """The root, each group's subroot, and of each block whether its group has several, and the path from its node to the root."""
    nodes: dict[str, list[tuple[int, str]]] = {}
    for r in blocks.select("group", "block", "node").collect():  # a digest for each of `top` blocks at most, and one a group
        nodes.setdefault(r.group, []).append((r.block, r.node))
    trees = {g: levels([n for _, n in sorted(found)], fanout) for g, found in sorted(nodes.items(), key=lambda x: x[0].encode())}
    subroots = {g: t[-1][0] for g, t in trees.items()}
    upper = levels(list(subroots.values()), fanout) if subroots else [[None]]
    paths = {}
    for k, (g, tree) in enumerate(trees.items()):
        last = beside(upper, k, fanout)
        for at in range(len(tree[0])):
            paths[g, at] = len(tree[0]) > 1, [*beside(tree, at, fanout), *last]
    return upper[-1][0], subroots, paths


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    """One tree a language. Where 7 divides crc32(doc_id), the row is tampered with before it is folded: 1 is added to n_chars."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    hit = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 0
    tampered = row_digest(*[docs[f] + 1 if f == "n_chars" else docs[f] for f in docs.columns])
    out = manifest(docs, altered=F.when(hit, tampered))
    proof = F.concat_ws("", F.transform("proof", lambda s: F.concat(s["before"], s["after"])))
    found = out.select("doc_id", "leaf", "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), folded(F.coalesce("altered", "leaf"), F.col("proof")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELDS = lambda n_chars: "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in ("doc_id::VARCHAR", "source", "lang", f"({n_chars})::VARCHAR", "text")) + ")"
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda c: ascii(c)::BIGINT)), lambda a, b:
    list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"""
_RAISED = "list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], '')))"

OP13_SQL = f"""
WITH RECURSIVE
d AS MATERIALIZED (SELECT doc_id, lang, {_FIELDS("n_chars")} AS leaf, CASE WHEN {_CRC} % 7 = 0 THEN {_FIELDS("n_chars + 1")} END AS tampered FROM documents),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
t AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM p GROUP BY lang
  UNION ALL SELECT lang, level + 1, {_RAISED} FROM t WHERE len(nodes) > 1),
own AS MATERIALIZED (SELECT lang, level, nodes FROM t),
s AS MATERIALIZED (SELECT lang, nodes[1] AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM own WHERE len(nodes) = 1),
u AS (
  SELECT 0 AS level, list(subroot ORDER BY pos) AS nodes FROM s
  UNION ALL SELECT level + 1, {_RAISED} FROM u WHERE len(nodes) > 1),
top AS MATERIALIZED (SELECT level, nodes FROM u),
steps AS (
  SELECT p.lang, p.pos, own.level, p.pos // (1 << own.level) AS place, own.nodes AS nodes
  FROM p JOIN own ON own.lang IS NOT DISTINCT FROM p.lang AND len(own.nodes) > 1
  UNION ALL SELECT p.lang, p.pos, s.height + top.level, s.pos // (1 << top.level), top.nodes
  FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang JOIN top ON len(top.nodes) > 1),
sides AS (SELECT lang, pos, list(CASE WHEN place % 2 = 1 THEN nodes[place] ELSE '' END || '+' || CASE WHEN place % 2 = 0 THEN coalesce(nodes[place + 2], '') ELSE '' END ORDER BY level) AS proof FROM steps GROUP BY lang, pos),
f AS (
  SELECT p.doc_id, p.leaf, s.subroot, (SELECT nodes[1] FROM top WHERE len(nodes) = 1) AS root, coalesce(sides.proof, []) AS proof, coalesce(p.tampered, p.leaf) AS from_leaf
  FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang LEFT JOIN sides ON sides.lang IS NOT DISTINCT FROM p.lang AND sides.pos = p.pos),
g AS (SELECT *, list_reduce(list_concat([from_leaf], proof), lambda a, x: sha256(string_split(x, '+')[1] || a || string_split(x, '+')[2])) AS folded_root FROM f)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(proof, ''), '+', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM g
"""
