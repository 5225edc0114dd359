"""The change stream over events, and the rule catalogue."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stratalens.plans import rules
from stratalens.registry import query
from stratalens.runtime import scratch_dir, table
from stratalens.streaming.watch import changes_between


@query("watch_latest_change", "select user_id as path, arg_max(event_type, struct_pack(ts := ts, id := event_id)) as state, count(*) as n_changes from events group by 1")
def watch_latest_change(spark, sf_dir):
    """Micro-batches fold changes into a state table.  Each batch reads
    the table of the batch before and writes its own, so running one again
    changes nothing and a restart finds the state where the checkpoint is."""
    home = f"{scratch_dir(spark)}/watch-{uuid.uuid4().hex}"
    state = lambda i: f"{home}/state-{i}"

    def step(batch, batch_id):
        rows = batch.select(F.col("user_id").alias("path"), F.struct("ts", "event_id", "event_type").alias("last"), F.lit(1).cast("long").alias("n"))
        if batch_id:
            rows = rows.unionByName(batch.sparkSession.read.parquet(state(batch_id - 1)))
        rows.groupBy("path").agg(F.max("last").alias("last"), F.sum("n").alias("n")).write.mode("overwrite").parquet(state(batch_id))

    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/events*.parquet")
    run = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    last = max(p["batchId"] for p in run.recentProgress if p["numInputRows"])
    return spark.read.parquet(state(last)).select("path", F.col("last.event_type").alias("state"), F.col("n").alias("n_changes"))


@query(
    "watch_snapshot_diff",
    "select cast(doc_id as varchar) as path, case when doc_id % 5 = 0 then null else text || '!' end as source from documents where doc_id % 5 = 0 or doc_id % 5 = 1",
)
def watch_snapshot_diff(spark, sf_dir):
    """Edits and deletions as the difference of two snapshots."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("source"), "doc_id")
    after = docs.where("doc_id % 5 <> 0").withColumn("source", F.when(F.col("doc_id") % 5 == 1, F.concat("source", F.lit("!"))).otherwise(F.col("source")))
    return changes_between(docs.select("path", "source"), after.select("path", "source"))


def _values(rows):
    put = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(put(v) for v in r) + ")" for r in rows)


@query(
    "rule_catalogue",
    f"select name, category, severity, fixable, conflicts from (values {_values((n, c, s, n in rules.FIXABLE, ','.join(rules.CONFLICTS.get(n, []))) for n, c, s, _ in rules.CATALOGUE)}) t(name, category, severity, fixable, conflicts)",
)
def rule_catalogue(spark, sf_dir):
    """The rules with category, level and fixability."""
    return rules.catalogue(spark).select("name", "category", "severity", "fixable", F.concat_ws(",", "conflicts").alias("conflicts"))


@query("rule_conflicts", "select 'directory-must-have-barrel' as first_rule, 'no-barrel-files' as second_rule")
def rule_conflicts(spark, sf_dir):
    """Pairs of enabled rules that contradict each other."""
    on = rules.catalogue(spark).where("severity <> 'off'").select("name", F.explode_outer("conflicts").alias("other"))
    names = on.select(F.col("name").alias("other")).distinct()
    return on.join(names, "other").where("name < other").select(F.col("name").alias("first_rule"), F.col("other").alias("second_rule"))
