"""Answers of a model, kept by the content they answer.

The store is a Parquet folder of key and answer; the key is a hash of the model's name and the
text. Equal texts are asked once, also across jobs. Texts are asked in slices, each written before
the next one begins, and answers are only used as they are read from the store: a job that fails
and is run again asks what is missing and no more."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.frames import written

Model = Callable[[pd.Series], pd.Series]


def answered(rows: DataFrame, text: str, model: Model, store: str, name: str, answer: str = "string", clients: int = 8, slices: int = 8) -> DataFrame:
    """rows with answer: what model gives for text; null texts are not asked. model maps a batch
    of texts to answers of type answer; a null answer is not kept and is asked again the next
    time. clients bound the tasks that ask at once, slices how much a failure can lose."""
    spark = rows.sparkSession
    schema = f"key string, answer {answer}"
    kept = lambda: spark.read.schema(schema).parquet(store)
    try:
        kept()
    except AnalysisException:  # the first job with this store
        spark.createDataFrame([], schema).write.parquet(store)
    keyed = rows.withColumn("key", F.when(F.col(text).isNotNull(), F.sha2(F.concat(F.lit(f"{name}\u0001"), F.col(text)), 256)))
    todo = keyed.filter("key is not null").groupBy("key").agg(F.first(text).alias("text")).join(kept().select("key"), "key", "left_anti")
    todo = written(todo.withColumn("slice", F.pmod(F.crc32("key"), F.lit(slices))), "asked")

    def ask(batches):
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "answer": pd.Series(model(batch["text"]).to_numpy(), index=batch.index, dtype=object)})

    for s in range(slices):
        part = todo.filter(F.col("slice") == s)
        if not part.isEmpty():
            part.repartition(clients).mapInPandas(ask, schema).filter("answer is not null").write.mode("append").parquet(store)
    return keyed.join(kept().dropDuplicates(["key"]), "key", "left").drop("key")
