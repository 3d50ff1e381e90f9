"""
Chat formatting of reply trees, in DataFrame functions only: iterative self-joins enumerate root-to-leaf paths, branches
are ranked by score, and each chosen path becomes one conversation with a loss mask.

The template writes a turn as `<turn ROLE>`, a line break, the text, `</turn>`, a line break. In roles and texts the
backslash and the angle brackets are written \\b, \\l and \\g, so no text can hold a control string and reading back is
exact. The loss mask is the list of (start, length) spans, in code points, of assistants' texts in the formatted string.

Null texts and roles are empty; rows with a null node are left out, and rows with a null tree are one tree. Of a
conversation, turns without order come first. Rows with one id in a tree are one node, with the least parent; the first by role and text gives the
turn. A node whose parent is missing, null or itself is a root; nodes on a cycle have no root and are left out. Ties of score go to the lesser path of ids.
A path's rows meet in one row of the result, as a conversation must.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, stored

def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(c: Column) -> Column:
    """Each backslash of an escaped string begins an escape, so the order of these is safe with \\b last."""
    return F.replace(F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")), F.lit("\\b"), F.lit("\\"))


def linear_tree(turns: DataFrame) -> DataFrame:
    """tree, node, parent, score, role, text of conversations whose rows follow each other by turn."""
    rows = turns.select(turns["conv_id"].cast("long").alias("tree"), turns["turn"].cast("long").alias("turn"), turns["role"].cast("string").alias("role"), turns["text"].cast("string").alias("text"))
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    return rows.withColumn("node", F.row_number().over(order).cast("long")).select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def paths(nodes: DataFrame) -> DataFrame:
    """
    tree, path (ids from root to leaf), path_score. Round k joins what each leaf has reached with the table of ancestors
    2^k steps up, and that table with itself, so a path of n nodes takes log2(n) rounds and n rows; texts take no part.
    Both are rows of one table, so a round is one join and one write, and the table before it goes. Joins are by merging:
    stored tables are so small as Parquet that Spark would broadcast them through the driver at a multiple of that size.
    Inside, trees are wrapped in structs, which are never null, so that rows without a tree's name are one tree.
    """
    links = nodes.where(F.col("node").isNotNull()).groupBy("tree", "node").agg(F.min("parent").alias("parent"), F.min(F.coalesce("score", F.lit(0.0))).alias("score"))
    links = stored(links.withColumn("tree", F.struct("tree")), "nodes")
    below = links.where(F.col("parent") != F.col("node")).select("tree", F.col("node").alias("start"), F.col("parent").alias("node"))
    inner = below.select("tree", "node").distinct()
    leaves = links.join(inner.hint("merge"), ["tree", "node"], "left_anti").select("tree", F.col("node").alias("start"), "node", "score", F.lit(0).alias("height"), F.lit(True).alias("leaf"))
    jumps = below.join(links.select("tree", "node", "score").hint("merge"), ["tree", "node"]).select("tree", "start", "node", "score", F.lit(1).alias("height"), F.lit(False).alias("leaf"))
    reached = stored(leaves.unionByName(jumps), "reached")
    discard(links)
    most = reached.where(~F.col("leaf")).groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    step = 1
    while step <= most:
        jumps = reached.where(~F.col("leaf")).select("tree", F.col("start").alias("node"), F.col("node").alias("up"), F.col("score").alias("up_score"))
        further = reached.join(jumps.hint("merge"), ["tree", "node"]).select("tree", "start", F.col("up").alias("node"), F.col("up_score").alias("score"), (F.col("height") + step).alias("height"), "leaf")
        before, reached = reached, stored(reached.where("leaf").unionByName(further), "reached")
        discard(before)
        step *= 2
        if step <= most and reached.where(~F.col("leaf")).isEmpty():
            break
    # what still has ancestors so far up hangs on a cycle: no path has more steps than its tree has links
    endless = reached.where(~F.col("leaf")).select("tree", "start")
    rows = reached.where("leaf").join(endless.hint("merge"), ["tree", "start"], "left_anti")
    found = rows.groupBy("tree", "start").agg(F.array_sort(F.collect_list(F.struct((-F.col("height")).alias("at"), "node"))).alias("steps"), F.sum("score").alias("path_score"))
    return found.select("tree.tree", F.transform("steps", lambda x: x["node"]).alias("path"), "path_score")


def best_paths(all_paths: DataFrame, per_tree: int | None = 1) -> DataFrame:
    """tree, rank, path: the `per_tree` paths of highest score (None: all)."""
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("path_score"), "path"))
    ranked = all_paths.select("tree", rank.alias("rank"), "path")
    return ranked if per_tree is None else ranked.where(F.col("rank") <= per_tree)


def formatted(nodes: DataFrame, chosen: DataFrame, trained: str = "assistant") -> DataFrame:
    """tree, rank, formatted string, loss array<struct<start,length>> (0-based code points)."""
    steps = chosen.select(F.col("tree").alias("s_tree"), "rank", F.posexplode("path").alias("at", "step"))
    first = nodes.groupBy("tree", "node").agg(F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("turn")).select("tree", "node", "turn.*")
    rows = steps.join(first.hint("merge"), F.col("s_tree").eqNullSafe(F.col("tree")) & (F.col("step") == F.col("node")))
    head, body = F.concat(F.lit("<turn "), escape(F.col("role")), F.lit(">\n")), escape(F.col("text"))
    turn = F.struct("at", head.alias("head"), body.alias("body"), (F.coalesce("role", F.lit("")) == trained).alias("loss"))
    turns = rows.groupBy("tree", "rank").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit("</turn>\n"))), "")
    step = lambda acc, t: F.struct(
        (acc["at"] + F.length(t["head"]) + F.length(t["body"]) + 8).alias("at"),
        F.when(t["loss"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(t["head"])).alias("start"), F.length(t["body"]).alias("length"))))).otherwise(acc["spans"]).alias("spans"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    return turns.select("tree", "rank", whole.alias("formatted"), F.aggregate("turns", start, step)["spans"].alias("loss"))


def read_back(out: DataFrame) -> DataFrame:
    """tree, rank, turns array<struct<role,text>>, loss_text: parsed from the formatted string and its mask alone."""
    turns = F.expr(
        "transform(filter(split(formatted, '</turn>\\n'), x -> x != ''), x -> named_struct('role', substring(x, 7, instr(x, '>') - 7), 'text', substring(x, instr(x, '>') + 2)))"
    )
    turns = F.transform(turns, lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text")))
    masked = F.array_join(F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return out.select("tree", "rank", turns.alias("turns"), masked.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def op7_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -7 whose texts hold control strings; one path each."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    nodes = linear_tree(turns.unionByName(extra))
    back = read_back(formatted(nodes, best_paths(paths(nodes))))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text"), 256).alias("loss_sha256"), "formatted_chars",
    )


OP7_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(text) + 16 + length(role)
        + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '>', ''))
        + length(role) - length(replace(replace(replace(role, '\', ''), '<', ''), '>', '')) AS chars FROM c)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
