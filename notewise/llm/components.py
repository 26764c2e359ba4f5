"""Connected components of an edge table by repeated hooking; nothing is collected but two numbers a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewise.session import checkpointed

SALTS = 16


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)`` (long values); root is the component's smallest node.

    Large-star and small-star rounds: all larger neighbours of a node are linked to its smallest neighbour, then the node
    and its smaller neighbours to the smallest of these.  Every round replaces edges one for one, so they never multiply;
    it ends when no edge changes.  Each round is checkpointed in the shared folder.
    """
    def star(pairs: DataFrame) -> DataFrame:
        low = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # the centre of a large group has very many neighbours: they are dealt to SALTS parts
        salted = pairs.withColumn("salt", F.pmod(F.hash("v"), F.lit(SALTS)))
        return salted.join(low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["u", "salt"])

    def summary(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    links = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = summary(links)
    for _ in range(max_rounds):
        both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = star(large.select("u", "v"))
        links = checkpointed(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        after = summary(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
