"""Connected components of a table of links, without any link on the driver and with hubs split by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.llm.common import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in the links (a, b); component is the smallest id reachable.

    Each round takes the smallest label among the neighbours and then the label of that label. Both
    joins have plain exchanges on both sides, so a hub with very many links is split at run time.
    Links with a null side are left out; no links give an empty table.
    """
    # Cut before it is read four times below, so that the links are found only once.
    links = cut_lineage(links.where("a is not null and b is not null").select("a", "b"))
    both = cut_lineage(
        links.where("a != b")
        .union(links.where("a != b").select("b", "a"))
        .union(links.select("a", "a"))
        .union(links.select("b", "b"))
        .distinct()
    )
    labels = cut_lineage(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")))
    total = None
    while True:
        now = labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return labels
        total = now
        near = (
            both.join(labels, both.b == labels.id)
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("component").alias("near"))
        )
        far = labels.select(F.col("id").alias("near"), "component")
        labels = cut_lineage(near.join(far, "near").select("id", "component"))
