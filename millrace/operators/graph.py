"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.storage import materialize


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(``node``, ``root``): the least node of the component of each node that has an edge.

    Nodes take the least label around them and then their label's label, so labels travel twice as far each round.
    Every round is written to the shared folder; only whether a label changed comes to the driver. Edges may be repeated,
    and loops and nulls are left out. An empty table gives no rows.
    """
    plain = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    both = materialize(plain.union(plain.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = materialize(lower.join(jump, "root").select("node", "old", F.least("root", "far").alias("root")), "labels")
        labels = new.select("node", "root")
        if not new.where("root <> old").limit(1).count():
            return labels
