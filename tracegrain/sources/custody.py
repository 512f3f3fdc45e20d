"""Who had which evidence when: rows for append-only tables of items, files and custody, and the refusals that keep them sound."""

from __future__ import annotations

import os
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tree

ITEMS = "item_id string, root string, added_at timestamp, by string, n_files long, digest string"
CUSTODY = "item_id string, at timestamp, by string, action string, detail string"


def add(spark: SparkSession, root: str, by: str, at: datetime, items: DataFrame | None = None, case_dir: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(item, files, custody): rows to append for a new item of evidence, from one scan of it.

    Refused are a root that isn't there or can't be read, one that is an item already, and one that overlaps the case's own folder.
    """
    root = os.path.realpath(root)
    if not os.access(root, os.R_OK):
        raise ValueError(f"{root} can't be read")
    if items is not None and not items.where(F.col("root") == root).isEmpty():
        raise ValueError(f"{root} is evidence of this case already")
    if case_dir is not None:
        own = os.path.realpath(case_dir)
        if os.path.commonpath([own, root]) in (own, root):
            raise ValueError(f"{root} and the case's folder {own} overlap")
    item_id = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{root}@{at.isoformat()}"))
    files = tree.scan(spark, root).withColumn("item_id", F.lit(item_id))
    digest = tree.item_digest(files)
    item = spark.createDataFrame([(item_id, root, at, by, files.count(), digest)], ITEMS)
    return item, files, spark.createDataFrame([(item_id, at, by, "acquired", digest)], CUSTODY)


def verified(spark: SparkSession, item_id: str, root: str, files: DataFrame, by: str, at: datetime) -> tuple[DataFrame, DataFrame]:
    """(outcomes, custody): what a new scan says of an item's recorded files, and the row to append for it."""
    out = tree.verify(files, tree.scan(spark, root))
    counts = {r.outcome: r.n for r in out.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad = {k: v for k, v in sorted(counts.items()) if k not in ("ok", "new")}
    action = "verification_failed" if bad else "verified"
    return out, spark.createDataFrame([(item_id, at, by, action, ", ".join(f"{k}: {v}" for k, v in sorted(counts.items())))], CUSTODY)


def counts(**tables: DataFrame) -> dict[str, int]:
    """Rows of each table of a case."""
    return {name: df.count() for name, df in tables.items()}
