"""Version texts as stored state: the newest content per provision is a snapshot, and a batch of actions is applied to it instead of the whole history.

Two keyed tables below one path share their bucketing: ``log`` holds every action once, ``snapshots`` the content per key after its last action. A batch reads the buckets it touches. Actions that come after
a key's snapshot are folded onto it; a key that gets an action from before its snapshot is folded anew from its log, the only case that reads a history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgraph.sources.keyed import KeyedTable
from lexgraph.storage import kept

from .temporal import _apply

ACTIONS = "key string, at timestamp, action_id string, op string, old_text string, new_text string"
SNAPSHOTS = "key string, at timestamp, action_id string, text string, n_applied long"


class TextVersions:
    """VB-06, VB-08, SNK-09: contents of provisions under ordered text actions. Actions are ordered by (at, action_id); an action_id is one action of its key."""

    def __init__(self, spark: SparkSession, path: str, start: str = "", buckets: int = 64):
        self.start = start
        self.log = KeyedTable(spark, f"{path.rstrip('/')}/log", ACTIONS, ["key", "action_id"], ["key"], buckets)
        self.snapshots = KeyedTable(spark, f"{path.rstrip('/')}/snapshots", SNAPSHOTS, ["key"], None, buckets)

    def apply(self, actions: DataFrame) -> dict[str, int]:
        """Apply a batch (key, at, action_id, op, old_text, new_text); how many actions were new, and how many keys were folded onto their snapshot or anew.

        Actions that are in the log already go, so a batch that comes twice changes nothing. Rows without key, time or id go; null texts are empty."""
        columns = ["key", "at", "action_id", "op", "old_text", "new_text"]
        texts = {c: F.coalesce(c, F.lit("")) for c in ("old_text", "new_text")}
        whole = actions.select(*columns).withColumns(texts).where("key is not null and at is not null and action_id is not null").dropDuplicates(["key", "action_id"])
        batch = kept(whole.withColumn("bucket", self.log.bucket()), "version-batch")
        touched = self.log._touched(batch)
        fresh = kept(batch.join(self.log.read(touched), ["bucket", "key", "action_id"], "left_anti").select(*columns, "bucket"), "version-fresh")
        n = fresh.count()
        if not n:
            return {"actions": 0, "onto": 0, "anew": 0}
        old = kept(self.snapshots.read(touched).select("bucket", "key", F.struct("at", "action_id").alias("last"), "text", "n_applied"), "version-snapshots")
        first = fresh.groupBy("bucket", "key").agg(F.min(F.struct("at", "action_id")).alias("first"))
        plan = kept(first.join(old, ["bucket", "key"], "left").withColumn("late", F.coalesce(F.col("first") <= F.col("last"), F.lit(False))), "version-plan")
        late = plan.where("late").select("bucket", "key")
        history = self.log.read(touched).select(*columns, "bucket").join(late, ["bucket", "key"], "left_semi")
        todo = fresh.unionByName(history)
        acts = F.sort_array(F.collect_list(F.struct("at", "action_id", "op", "old_text", "new_text")))
        held = todo.groupBy("bucket", "key").agg(acts.alias("acts")).join(plan.select("bucket", "key", "late", "text", "n_applied"), ["bucket", "key"])
        onto = ~F.col("late") & F.col("text").isNotNull()
        state = F.struct(F.when(onto, F.col("text")).otherwise(F.lit(self.start)).alias("text"), F.when(onto, F.col("n_applied")).otherwise(F.lit(0).cast("long")).alias("applied"))
        folded = held.select("bucket", "key", F.element_at("acts", -1).alias("last"), F.aggregate("acts", state, _apply).alias("s"))
        new = kept(folded.select("key", F.col("last.at").alias("at"), F.col("last.action_id").alias("action_id"), F.col("s.text").alias("text"), F.col("s.applied").alias("n_applied")), "version-folded")
        # snapshots first: if the log fails, the batch that comes again isn't known there and finds itself late, so its keys are folded anew from log and batch
        self.snapshots.merge(new.withColumn("ord", F.lit(0)), "ord")
        self.log.merge(fresh.drop("bucket").withColumn("ord", F.lit(0)), "ord")
        counts = plan.agg(F.count_if("late").alias("anew"), F.count("*").alias("keys")).first()
        return {"actions": n, "onto": counts["keys"] - counts["anew"], "anew": counts["anew"]}

    def texts(self) -> DataFrame:
        """key, text, n_applied of every provision."""
        return self.snapshots.rows().select("key", "text", "n_applied")
