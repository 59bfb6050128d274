"""Tables with keys that are changed batch by batch: hash-bucketed Parquet, of which a batch reads and rewrites the touched buckets only.

A merge is three steps: the batch is folded to one row per key, the touched buckets (a partition filter) are joined with it, and the buckets in which a row really differs are written by dynamic
partition overwrite. The new content is complete in the shared folder before the first partition is replaced, and a merge that runs again after a failure, or comes twice, gives the same
table, so nothing has to be undone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from lexgraph.storage import exists, kept

BUCKETS = 64


class KeyedTable:
    """Rows by ``keys`` (never null) with further ``columns``, below ``path``. ``schema`` is a DDL string of all of them.

    ``near`` names the keys that a bucket is chosen by (all unless told): rows that are replaced together should share their bucket."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], near: Sequence[str] | None = None, buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.near, self.buckets = spark, path.rstrip("/"), list(keys), list(near or keys), buckets
        self.schema = StructType.fromDDL(schema)
        self.columns = [f.name for f in self.schema if f.name not in self.keys]

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.near]), F.lit(self.buckets)).cast("int")

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The table, or the given buckets of it, with the column ``bucket``."""
        whole = StructType([*self.schema.fields]).add("bucket", IntegerType())
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], whole)
        table = self.spark.read.schema(whole).parquet(self.path)
        return table if buckets is None else table.where(F.col("bucket").isin(buckets))

    def rows(self) -> DataFrame:
        return self.read().drop("bucket")

    def _touched(self, rows: DataFrame) -> list[int]:
        """Numbers of the buckets of ``rows``: as many as there are buckets at most."""
        return sorted(r[0] for r in rows.select("bucket").distinct().collect())

    def _replace(self, rows: DataFrame) -> None:
        """Write whole buckets; every bucket that ``rows`` has is replaced."""
        dealt = rows.select(*self.keys, *self.columns, "bucket").repartition("bucket").sortWithinPartitions("bucket", *self.keys)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def merge(self, changes: DataFrame, order: str) -> list[int]:
        """SNK-07: per key the last non-null value of each column by ``order``; absent values keep what exists, new keys are added. Returns the rewritten buckets.

        Rows with a null key go. A table without further columns keeps each key once."""
        whole = changes.where(" and ".join(f"`{k}` is not null" for k in self.keys))
        last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"new_{c}") for c in self.columns] or [F.count("*").alias("new")]
        batch = kept(whole.groupBy(*self.keys).agg(*last).withColumn("bucket", self.bucket()), "merge-batch")
        old = self.read(self._touched(batch)).withColumn("known", F.lit(True))
        joined = old.join(batch, ["bucket", *self.keys], "full_outer")
        values = {c: F.coalesce(f"new_{c}", c) for c in self.columns}
        differs = F.col("known").isNull()
        for c in self.columns:
            differs = differs | (F.col(f"new_{c}").isNotNull() & ~F.col(f"new_{c}").eqNullSafe(F.col(c)))
        merged = kept(joined.select("bucket", *self.keys, *[v.alias(c) for c, v in values.items()], differs.alias("differs")), "merged")
        changed = self._touched(merged.where("differs"))
        if changed:
            self._replace(merged.where(F.col("bucket").isin(changed)))
        return changed

    def replace(self, rows: DataFrame, owners: DataFrame) -> list[int]:
        """SNK-09, document-wise: the rows of ``owners`` (the columns ``near``, which keys must include) become ``rows``; an owner without rows loses its own. Returns the rewritten buckets.

        Of rows with equal keys one stays, the one with the greatest values; a table is the same after the same replacement."""
        if not set(self.near) <= set(self.keys):
            raise ValueError("rows are replaced by keys that choose their bucket")
        owned = kept(owners.select(*self.near).dropna().distinct().withColumn("bucket", self.bucket()), "replace-owners")
        mine = rows.join(owned.select(*self.near), self.near, "left_semi")
        value = F.max(F.struct(*self.columns)).alias("v") if self.columns else F.count("*").alias("v")
        once = mine.where(" and ".join(f"`{k}` is not null" for k in self.keys)).groupBy(*self.keys).agg(value)
        fresh = once.select(*self.keys, *[F.col(f"v.{c}").alias(c) for c in self.columns]).withColumn("bucket", self.bucket())
        touched = self._touched(owned)
        old = self.read(touched)
        stays = old.join(owned, ["bucket", *self.near], "left_anti").select(*self.keys, *self.columns, "bucket")
        new = kept(stays.unionByName(fresh), "replaced")
        # a bucket is written when a row came or went; what lost its last row is removed by an empty partition
        before = kept(old.select(*new.columns), "replaced-before")
        changed = self._touched(new.exceptAll(before).union(before.exceptAll(new)))
        if changed:
            self._replace(new.where(F.col("bucket").isin(changed)))
            for number in set(changed) - set(self._touched(new)):
                self._remove(number)
        return changed

    def _remove(self, bucket: int) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket={bucket}")
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def merge_edges(edges: KeyedTable, nodes: KeyedTable, batch: DataFrame) -> list[int]:
    """SNK-08: the edges (src, rel, dst) of ``batch`` whose ends are nodes (id), once each; edges that exist stay as they are."""
    ids = nodes.rows().select("id").distinct()
    ends = batch.select("src", "rel", "dst").where("src is not null and rel is not null and dst is not null").distinct()
    known = ends.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return edges.merge(known.withColumn("ord", F.lit(0)), "ord")
