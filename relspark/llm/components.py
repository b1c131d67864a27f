"""Connected components of an edge table, by the least label of the neighbours and pointer jumping.

Each round is two joins and one aggregation; the table of labels is written to the shared checkpoint folder
after each, which cuts lineage. Nothing but a count of changed labels reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspark.shared import shared_folder


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """v and label (the least v of its component) for every end of an edge; loops and repeated edges do no harm."""
    shared_folder(edges.sparkSession)
    both = edges.select(F.col(left).alias("v"), F.col(right).alias("u")).union(edges.select(F.col(right).alias("v"), F.col(left).alias("u")))
    both = both.distinct().checkpoint()
    labels = both.groupBy("v").agg(F.min("u").alias("least")).select("v", F.least("v", "least").alias("label")).checkpoint()
    while True:
        near = both.join(labels.select(F.col("v").alias("u"), "label"), "u").select("v", "label", F.lit(None).cast(labels.schema["label"].dataType).alias("old"))
        near = near.union(labels.select("v", "label", F.col("label").alias("old"))).groupBy("v").agg(F.min("label").alias("label"), F.min("old").alias("old"))
        # the label's own label is known from the round before
        jumped = near.join(labels.select(F.col("v").alias("label"), F.col("label").alias("next")), "label")
        moved = jumped.select("v", F.least("label", "next").alias("label"), "old").checkpoint()
        changed = moved.filter("label != old").limit(1).count()
        labels = moved.select("v", "label")
        if not changed:
            return labels
