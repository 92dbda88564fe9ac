"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step on links (u, v) with u > v.

    Large: every node ties its larger neighbours to the least node around it. Small: every node
    ties its smaller neighbours, and itself, to the least of them. Minima are aggregated before
    the shuffle; joining them back puts one row against a node's links. The key of the minima is
    written as an expression, so that both sides are dealt anew for the join: only then does a skew
    join split a node of very many links."""
    around = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = around.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        least = least.select(F.col("u").bitwiseXOR(F.lit(0)).alias("u"), F.least("u", "m").alias("m"))
        out = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links (a, b) -> node, component (the least node reachable) of every node that has a link.

    Nulls and links of a node with itself tie nothing. Nothing but three totals a round comes to
    the driver."""
    df = links.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    df = common.checkpointed(df)
    state = None
    for _ in range(most_rounds):
        total = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if tuple(total) == state:
            break
        state = tuple(total)
        if not state[0]:
            break
        df = common.checkpointed(_star(_star(df, True), False).distinct())
    else:
        raise RuntimeError("components did not settle")
    return df.select(F.col("u").alias("node"), F.col("v").alias("component")).union(df.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
