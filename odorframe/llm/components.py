"""Connected components of a table of links, without collecting them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odorframe.llm import common


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its smallest node.

    Each round takes the smallest label among the neighbours and then the label's own label;
    rounds grow with the logarithm of a component's diameter. Every round is written.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = common.written(both.distinct(), "links")
    labels = common.written(both.groupBy("a").agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        other = labels.select(F.col("a").alias("b"), F.col("label").alias("seen"))
        least = both.join(other, "b").groupBy("a").agg(F.min("seen").alias("seen"))
        step = labels.join(least, "a").select("a", "label", F.least("label", "seen").alias("next"))
        jump = labels.select(F.col("a").alias("next"), F.col("label").alias("further"))
        new = step.join(jump, "next").select("a", F.least("next", "further").alias("label"), (F.least("next", "further") != F.col("label")).alias("moved"))
        new = common.written(new, "labels")
        if new.filter("moved").isEmpty():
            return new.select(F.col("a").alias("node"), F.col("label").alias("component"))
        labels = new.select("a", "label")
