"""Structured Streaming forms of the incremental operators.

Enrichment is a row map with static lookups, so a stream needs no state. Orphan references are kept as signed counts per
key: every micro-batch appends its summed deltas, which are folded into one table of counts from time to time, and the
current report is the keys with references and no existence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuscle.operators.references import spelled_number

COUNTS = "key string, refs long, there long"


def enrich_stream(documents: DataFrame, stages: list[Callable[[DataFrame], DataFrame]], out: str, checkpoint: str) -> StreamingQuery:
    """Documents of a stream through stateless stages (stream-static joins) to JSON lines, each exactly once."""
    for stage in stages:
        documents = documents.transform(stage)
    return documents.writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reference_deltas(documents: DataFrame, ids: str = "id", links: str = "explicit_related_ids", removed: str = "removed_at") -> DataFrame:
    """(key, refs, there) of new documents: +1 existence of each id, -1 if it is removed, +1 reference of each link.

    Links are read as in problem 5; without a column ``removed`` nothing is removed.
    """
    gone = [F.when(F.col(removed).isNotNull(), F.lit(-1))] if removed in documents.columns else []
    change = F.explode(F.array(F.lit(1), *gone).cast("array<long>")).alias("there")
    there = documents.where(F.col(ids).isNotNull()).select(F.col(ids).alias("key"), F.lit(0).cast("long").alias("refs"), change).where("there is not null")
    refs = documents.select(F.explode(links).alias("entry")).select(spelled_number(F.col("entry")).alias("key")).where("key is not null")
    return there.union(refs.select("key", F.lit(1).cast("long").alias("refs"), F.lit(0).cast("long").alias("there")))


def judgment_deltas(qrels: DataFrame, listed: str = "candidate_ids") -> DataFrame:
    """(key, refs, there) of new judgments: +1 reference of each candidate."""
    refs = qrels.select(F.explode(listed).alias("entry")).select(spelled_number(F.col("entry")).alias("key")).where("key is not null")
    return refs.select("key", F.lit(1).cast("long").alias("refs"), F.lit(0).cast("long").alias("there"))


def merge_counts(counts: DataFrame, deltas: DataFrame) -> DataFrame:
    """Counts with deltas added; keys whose counts are all zero are dropped."""
    both = counts.select("key", "refs", "there").union(deltas.select("key", "refs", "there"))
    return both.groupBy("key").agg(F.sum("refs").alias("refs"), F.sum("there").alias("there")).where("refs <> 0 or there <> 0")


def orphans(counts: DataFrame) -> DataFrame:
    """(key, refs) of keys that are referred to and do not exist."""
    return counts.where("refs > 0 and there <= 0").select("key", "refs")


class OrphanCounts:
    """A table of signed counts in a folder; a repeated micro-batch is not counted twice.

    A batch writes only the sums of its own deltas, ``v<batch>``. Every ``fold`` batches all of them are folded into one,
    ``all<batch>``, and what it replaces is deleted.
    """

    def __init__(self, spark: SparkSession, folder: str, fold: int = 20):
        self.spark, self.folder, self.fold = spark, folder, fold

    def _fs(self):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.folder)
        return jvm.org.apache.hadoop.fs.Path, root, root.getFileSystem(conf)

    def _versions(self) -> tuple[int, list[int]]:
        """The last folded batch (or -1), and the batches after it that are whole."""
        path, root, fs = self._fs()
        if not fs.exists(root):
            return -1, []
        done = [s.getPath().getName() for s in fs.listStatus(root) if fs.exists(path(s.getPath(), "_SUCCESS"))]
        folded = max([int(n[3:]) for n in done if n.startswith("all")], default=-1)
        return folded, sorted(b for n in done if n.startswith("v") and (b := int(n[1:])) > folded)

    def _version(self) -> int:
        folded, later = self._versions()
        return max([folded, *later])

    def counts(self) -> DataFrame:
        folded, later = self._versions()
        paths = [f"{self.folder}/all{folded}"] * (folded >= 0) + [f"{self.folder}/v{b}" for b in later]
        empty = self.spark.createDataFrame([], COUNTS)
        return merge_counts(self.spark.read.schema(COUNTS).parquet(*paths), empty) if paths else empty

    def add(self, deltas: DataFrame, batch: int) -> None:
        """The body of ``foreachBatch``."""
        if batch <= self._version():
            return
        merge_counts(deltas, self.spark.createDataFrame([], COUNTS)).write.mode("overwrite").parquet(f"{self.folder}/v{batch}")
        folded, later = self._versions()
        if len(later) >= self.fold:
            self.counts().write.mode("overwrite").parquet(f"{self.folder}/all{batch}")
            path, _, fs = self._fs()
            for name in [f"v{b}" for b in later] + [f"all{folded}"]:
                fs.delete(path(f"{self.folder}/{name}"), True)

    def start(self, deltas: DataFrame, checkpoint: str) -> StreamingQuery:
        return deltas.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
