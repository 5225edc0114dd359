"""Watching a changing tree with Structured Streaming.

A change stream carries ``(path, source)`` rows, a null source meaning that the file
is gone.  Each micro-batch parses only the files that changed, and lints only what can
have changed: files of the undirected component of any changed file, in the old graph
or the new one, and the few rules that look at the whole tree.  A watcher with a state
folder writes its tables there under the batch's id and starts each batch from the
newest state below that id, so a restart goes on where the checkpoint does, and a
batch that is run again gives the same state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StreamingQuery

from stratalens.functions import paths
from stratalens.operators import graph, post
from stratalens.plans import rules
from stratalens.runtime import materialize
from stratalens.sources import extract

DEBOUNCE = "300 milliseconds"
SCHEMA = "path string, source string, seq long"


def changes_between(before: DataFrame, after: DataFrame) -> DataFrame:
    """Edits and deletions, which a file source does not see, as the
    difference of two snapshots by content hash."""
    old = before.select("path", F.sha2(F.coalesce("source", F.lit("")), 256).alias("old"))
    new = after.select("path", "source", F.sha2(F.coalesce("source", F.lit("")), 256).alias("new"))
    both = new.join(old, "path", "full")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).select("path", F.when(F.col("new").isNotNull(), F.coalesce("source", F.lit(""))).alias("source"))


def relevant(changes: DataFrame) -> DataFrame:
    """Sources and the files that settings come from."""
    return changes.where(paths.is_source(F.col("path")) | paths.base_name(F.col("path")).isin("tsconfig.json", "lint.toml"))


#: Rules whose findings depend on files that no import connects.
WHOLE_TREE = (
    "no-empty-directories", "directory-must-have-barrel", "max-items-per-directory", "min-items-per-directory", "max-directory-depth",
    "no-empty-domain", "no-anemic-domain", "no-god-domain", "no-duplicate-file-names", "no-package-cycle",
)
STATE = ("files", "syn", "edges", "violations")


class Watcher:
    """Keeps files, syntax, edges and findings current; ``apply`` is one batch."""

    def __init__(self, files: DataFrame, config: rules.Config | None = None, names: list[str] | None = None, state: str | None = None):
        self.spark, self.config, self.state = files.sparkSession, config, state
        self.names = [n for n in rules.RULES if names is None or n in names]
        self.rebuild(files)

    def rebuild(self, files: DataFrame) -> None:
        """T4: everything, after settings changed."""
        self.files = materialize(files.select("path", "source"), "files")
        facts = rules.Facts(self.files, self.config)
        self.syn, self.edges = facts.syn, facts.edges
        self.violations = materialize(rules.run(facts, self.names), "violations")

    def _facts(self, files: DataFrame, syn: DataFrame, edges: DataFrame | None = None) -> rules.Facts:
        facts = rules.Facts(files, self.config)
        facts.syn = syn
        if edges is not None:
            facts.edges = edges
        return facts

    def apply(self, changes: DataFrame) -> DataFrame:
        """The findings after ``changes(path, source[, seq])``."""
        changes = relevant(changes)
        if "seq" in changes.columns:
            last = W.partitionBy("path").orderBy(F.desc("seq"))
            changes = changes.withColumn("_n", F.row_number().over(last)).where("_n = 1")
        changes = materialize(changes.select("path", "source"), "changes")
        if changes.isEmpty():
            return self.violations
        live = changes.where("source is not null")
        files = materialize(self.files.join(changes, "path", "left_anti").unionByName(live), "files")
        if not changes.where(~paths.is_source(F.col("path"))).isEmpty():
            self.rebuild(files.where(paths.is_source(F.col("path"))))
            return self.violations
        parsed = extract.syntax(live.where(paths.is_source(F.col("path"))))
        syn = materialize(self.syn.join(changes.select("path"), "path", "left_anti").unionByName(parsed), "syn")
        facts = self._facts(files, syn)
        seeds = changes.select(F.col("path").alias("node"))
        hit = materialize(graph.affected(self.edges, facts.edges, seeds), "affected")
        inside = hit.withColumnRenamed("node", "path")
        few = self._facts(files.join(inside, "path", "left_semi"), syn.join(inside, "path", "left_semi"), facts.edges.join(hit.withColumnRenamed("node", "source"), "source", "left_semi"))
        near = rules.run(few, [n for n in self.names if n not in WHOLE_TREE] or ["-"])
        whole = rules.run(facts, [n for n in self.names if n in WHOLE_TREE] or ["-"])
        old = self.violations.where(~F.col("rule").isin(*WHOLE_TREE))
        merged = post.merged(old, near, hit).unionByName(whole)
        self.files, self.syn, self.edges, self.violations = files, syn, facts.edges, materialize(merged, "violations")
        return self.violations

    def _saved(self) -> list[int]:
        """Ids of complete states, a marker being written last."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.state}/done")
        system = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(int(x.getPath().getName()) for x in system.listStatus(where)) if system.exists(where) else []

    def step(self, changes: DataFrame, batch_id: int) -> DataFrame:
        """One batch of a stream, from the newest state before it."""
        if self.state is None:
            return self.apply(changes)
        before = [i for i in self._saved() if i < batch_id]
        if before:
            for name in STATE:
                setattr(self, name, self.spark.read.parquet(f"{self.state}/{before[-1]}/{name}"))
        self.apply(changes)
        for name in STATE:
            getattr(self, name).write.mode("overwrite").parquet(f"{self.state}/{batch_id}/{name}")
            setattr(self, name, self.spark.read.parquet(f"{self.state}/{batch_id}/{name}"))
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.state}/done/{batch_id}")
        return self.violations


def watch(stream: DataFrame, watcher: Watcher, checkpoint: str, trigger: str = DEBOUNCE, on_batch=None) -> StreamingQuery:
    """Start a query that applies each micro-batch of a change stream."""

    def step(batch: DataFrame, batch_id: int) -> None:
        found = watcher.step(batch, batch_id)
        if on_batch is not None:
            on_batch(found, batch_id)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()


def change_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of change files: JSON lines of ``path``, ``source``, ``seq``."""
    return spark.readStream.schema(SCHEMA).json(folder)
