"""Connected components over links between long ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Steps

#: Copies of a label's row, and parts that its members are dealt to: no task joins all members of a large component.
SALT = 16


def components(links: DataFrame, steps: Steps | None = None) -> DataFrame:
    """node and the smallest node of its component, for every node of links (a, b). No links: no rows.

    Each round gives a node the smallest label among its own and its neighbours', and then its label's label; rounds go
    on until none changes. Labels and links are written each round, so nothing grows with the number of rounds.
    """
    steps = steps or Steps(links.sparkSession, "components")
    one_way = links.select("a", "b").filter("a <> b")
    both = steps.written(one_way.union(one_way.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = steps.written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("_near"))
        stepped = steps.written(labels.join(near, F.col("node") == F.col("a")).select("node", F.least("label", "_near").alias("_new"), F.col("label").alias("_old")), "labels")
        tops = stepped.select(F.col("_new").alias("node")).distinct().join(stepped, "node").select(F.col("node").alias("_new"), F.col("_new").alias("_up"))
        above = tops.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        salted = stepped.withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(SALT)).cast("int"))
        jumped = steps.written(salted.join(above, ["_new", "_salt"]).select("node", F.least("_new", "_up").alias("label"), "_old"), "labels")
        steps.drop(labels, stepped)
        labels = jumped.select("node", "label")
        if jumped.filter(F.col("label") != F.col("_old")).isEmpty():
            steps.drop(both)
            return labels
