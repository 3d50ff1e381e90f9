"""What goes with a write: audit rows of a change, slugs that are free, reports as CSV files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def audited(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str], entity: str, actor: str) -> DataFrame:
    """
    actor, action (INSERT, UPDATE, DELETE), entity, entity_id, before, after: a row for each key whose `columns` differ between two
    versions of a table, with both states as JSON (null: none). Keys are distinct and not null; actors are a column of the later version,
    or of the earlier one where the row is gone.
    """
    side = lambda df, name: df.select(key, F.struct(*columns).alias(name), F.col(actor).alias(f"{name}_actor"))
    both = side(before, "old").join(side(after, "new"), key, "full")
    action = F.when(F.col("old").isNull(), "INSERT").when(F.col("new").isNull(), "DELETE").otherwise("UPDATE")
    json = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    rows = both.where(~F.col("old").eqNullSafe(F.col("new")))
    who = F.when(F.col("new").isNull(), F.col("old_actor")).otherwise(F.col("new_actor"))
    return rows.select(who.alias("actor"), action.alias("action"), F.lit(entity).alias("entity"), F.col(key).alias("entity_id"), json("old").alias("before"), json("new").alias("after"))


def free_slugs(rows: DataFrame, base: str, taken: DataFrame, slug: str, suffix: Column) -> DataFrame:
    """`rows` with `slug`: their base, or, where a slug is just that already, the base, a hyphen and the suffix."""
    known = taken.select(F.col(slug).alias(base)).distinct().withColumn("_taken", F.lit(True))
    made = F.when(F.col("_taken"), F.concat_ws("-", F.col(base), suffix)).otherwise(F.col(base))
    return rows.join(known, base, "left").withColumn("slug", made).drop("_taken")


def bridge_rows(parents: DataFrame, key: str, children: str, name: str) -> DataFrame:
    """The rows that join parents to the children of their lists, each pair once; parents without children have none."""
    return parents.select(key, F.explode(children).alias(name)).where(F.col(name).isNotNull()).distinct()


def write_csv(report: DataFrame, path: str) -> None:
    """A header and the report's rows, all fields in quotes, quotes doubled, in one file of the folder: for reports, which are small."""
    report.coalesce(1).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(path)
