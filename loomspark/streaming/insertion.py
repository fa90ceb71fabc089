"""Incremental insertion: a stream of concepts against a hierarchy kept as a log of changes.

Batch k reads the hierarchy after batch k - 1 and writes its decisions and the nodes that they add
or change; every COMPACT batches the whole hierarchy is written anew. Reading takes the last whole
one and, over it, the last change of each node since. All names follow from k, and a batch
overwrites its own files only, so a replayed batch gives what it gave before. Files live under
root, a folder that all executors share: nodes/v<k>, deltas/b<k> and decisions/b<k>."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomspark.operators import placement, taxonomy

#: Batches from one whole hierarchy to the next.
COMPACT = 16


def version(spark: SparkSession, root: str, batch: int, compact: int = COMPACT) -> DataFrame:
    """The hierarchy after a batch; -1 is the one at the start. compact must be the stream's."""
    whole = (batch + 1) // compact * compact - 1
    base = spark.read.parquet(f"{root}/nodes/v{whole}")
    if whole == batch:
        return base
    logs = [spark.read.schema(base.schema).parquet(f"{root}/deltas/b{k}").withColumn("_batch", F.lit(k)) for k in range(whole + 1, batch + 1)]
    log = logs[0]
    for more in logs[1:]:
        log = log.unionByName(more)
    columns = [F.col(f"`{c}`") for c in base.columns]
    last = log.groupBy(F.col("node_id").alias("_id")).agg(F.max_by(F.struct(*columns), "_batch").alias("_row")).select("_row.*")
    return base.join(last.select("node_id"), "node_id", "left_anti").select(*columns).unionByName(last)


def start_hierarchy(nodes: DataFrame, root: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{root}/nodes/v-1")


def insert_batch(batch: DataFrame, k: int, root: str, reject: float = taxonomy.REJECT, merge: float = taxonomy.MERGE, compact: int = COMPACT) -> None:
    """One batch of concepts, as insert_stream takes them."""
    spark = batch.sparkSession
    nodes = version(spark, root, k - 1, compact)
    decisions = placement.decide_in_order(batch, nodes.select("ord", "embedding"), reject, merge)
    decisions.write.mode("overwrite").parquet(f"{root}/decisions/b{k}")
    decisions = spark.read.parquet(f"{root}/decisions/b{k}")
    delta = placement.changed_nodes(nodes, batch, decisions).select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in nodes.schema.fields])
    delta.write.mode("overwrite").parquet(f"{root}/deltas/b{k}")
    if (k + 1) % compact == 0:
        # the whole one of k is not there yet, so the log up to k is read without it
        changed = spark.read.schema(nodes.schema).parquet(f"{root}/deltas/b{k}")
        nodes.join(changed.select("node_id"), "node_id", "left_anti").select(nodes.columns).unionByName(changed).write.mode("overwrite").parquet(f"{root}/nodes/v{k}")


def insert_stream(concepts: DataFrame, root: str, reject: float = taxonomy.REJECT, merge: float = taxonomy.MERGE, compact: int = COMPACT, **trigger) -> StreamingQuery:
    """concepts: a streaming frame of concept_id, seq (unique, from 0 in each batch's order), name, definition,
    filename, page_number, embedding."""

    def one(batch: DataFrame, k: int) -> None:
        insert_batch(batch, k, root, reject, merge, compact)

    return concepts.writeStream.foreachBatch(one).option("checkpointLocation", f"{root}/stream").trigger(**(trigger or {"availableNow": True})).start()
