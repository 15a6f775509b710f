"""Connected components of a bipartite graph of members and entities."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder; without spark.checkpoint.dir a temporary folder in local mode, else an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="alertloom-"))
    return context.getCheckpointDir()


def persisted(df: DataFrame) -> DataFrame:
    """df written to the shared folder and cut from its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def entity_components(members: DataFrame, own: str, entity: str) -> DataFrame:
    """(own, component) for every row of (own, entity): members share a component if entities chain them.

    Labels start as a member's own key and are lowered in turn by the least label of each entity and of each member,
    with a jump to the label's own label, until none changes.
    """
    pairs = persisted(members.select(own, entity).distinct())
    labels = persisted(pairs.select(own, F.col(own).alias("component")).distinct())
    while True:
        by_entity = pairs.join(labels, own).groupBy(entity).agg(F.min("component").alias("c"))
        by_entity = persisted(by_entity)  # both sides of the next join are shuffles, so that Spark splits an entity that a third of all rows hold
        near = pairs.join(by_entity, entity).groupBy(own).agg(F.min("c").alias("component"))
        jump = near.join(labels.select(F.col(own).alias("_k"), F.col("component").alias("_c")), near["component"] == F.col("_k"), "left").select(own, F.least("component", F.coalesce("_c", "component")).alias("component"))
        after = persisted(jump)
        changed = after.join(labels.withColumnRenamed("component", "was"), own).where("component != was").limit(1).count()
        labels = after
        if not changed:
            return labels
