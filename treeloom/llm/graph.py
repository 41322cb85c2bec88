"""Connected components of a large link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.storage import discard, saved


def connected_components(links: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(id, component): the smallest id reachable over ``links`` (a, b: long); ids without links are left out.

    Every round takes the least label among neighbours (a sum-like aggregate with map-side combining, so a hub with
    very many links is pre-aggregated) and then jumps to the label's own label.  Each round is written to the shared
    folder, so a lost executor costs one round at most.  Self-links, repeated and reversed links and nulls are fine.
    """
    links = links.where("a is not null and b is not null and a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    both = saved(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = saved(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("component")), "labels")
    old = labels
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        best = labels.join(near, labels.id == near.a, "left").select("id", F.col("component").alias("was"), F.least("component", "near").alias("best"))
        jump = labels.select(F.col("id").alias("best"), F.col("component").alias("jumped"))
        after = saved(best.join(jump, "best", "left").select("id", "was", F.least("best", F.coalesce("jumped", "best")).alias("component")), "labels")
        discard(old)
        labels, old = after.select("id", "component"), after
        if not after.where("was <> component").limit(1).count():
            discard(both)
            return labels
    raise RuntimeError(f"links still merge after {max_rounds} rounds")
