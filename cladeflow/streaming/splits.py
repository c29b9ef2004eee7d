"""Newick lines from a folder to an ever longer table of splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cladeflow.functions.text import strip_annotations
from cladeflow.operators import to_splits

LINE = "name string, newick string"


def stream_splits(spark: SparkSession, source: str, target: str, checkpoint: str, rooted: bool = False, once: bool = True) -> StreamingQuery:
    """Append the splits of every new tree below `source` (tab-separated name and Newick text) to Parquet at `target`.

    A tree is known by the hash of its name. Each micro-batch is written under its own number, so a batch
    that is run again after a failure replaces what it had written.
    """
    lines = spark.readStream.schema(LINE).option("sep", "\t").option("quote", "").csv(source)
    trees = lines.select(F.xxhash64("name").alias("tree_id"), "name", strip_annotations(F.col("newick")).alias("newick"))

    def add(batch: DataFrame, number: int) -> None:
        splits = to_splits(batch, rooted).join(batch.select("tree_id", "name"), "tree_id")
        splits.write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = trees.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
