"""Keyed tables as functions from table to table; every table has id, filename, ord, created."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.frames import numbered


def last_rows(batch: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of every key of the batch; null is a key too."""
    columns = [F.col(f"`{c}`") for c in batch.columns]
    return batch.groupBy(F.col(f"`{key}`").alias("_key")).agg(F.max_by(F.struct(*columns), order).alias("_row")).select("_row.*")


def upsert(base: DataFrame, batch: DataFrame, key: str = "id", order: str = "ord", now: Column | None = None) -> DataFrame:
    """The batch's last row a key replaces the base's row. Rows of the batch come last, in their
    order: order continues behind the base. created, if the base has it, becomes now."""
    top = base.agg(F.coalesce(F.max(order), F.lit(-1)).alias("_top"))
    fresh = continued(last_rows(batch, key, order), order, top, now if "created" in base.columns else None)
    keys = fresh.select(F.col(f"`{key}`").alias("_key"))
    return base.join(keys, F.col(f"`{key}`").eqNullSafe(F.col("_key")), "left_anti").unionByName(fresh)


def continued(rows: DataFrame, order: str, top: DataFrame, now: Column | None) -> DataFrame:
    """rows with order numbered on behind _top, the one value of top, and created set to now."""
    out = numbered(rows, order, name="_n").crossJoin(F.broadcast(top))
    out = out.withColumn(order, (F.col("_top") + 1 + F.col("_n")).cast(rows.schema[order].dataType)).drop("_n", "_top")
    return out if now is None else out.withColumn("created", now)


def by_document(base: DataFrame, filename: str, limit: int = -1, offset: int = 0) -> DataFrame:
    rows = base.filter(F.col("filename") == filename)
    return rows if limit == -1 else rows.orderBy("ord").offset(offset).limit(limit)


def by_keys(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return base.join(keys.select(key).distinct(), key, "left_semi")


def delete(base: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return base.join(keys.select(key).distinct(), key, "left_anti")


def retain(base: DataFrame, days: int, now: Column, created: str = "created") -> DataFrame:
    """Rows not older than days before now."""
    return base.filter(F.col(created) >= now - F.make_interval(days=F.lit(days)))


def truncate(base: DataFrame) -> DataFrame:
    return base.limit(0)


def pack_tags(tags: str) -> Column:
    return F.array_join(tags, "|")


def unpack_tags(packed: str) -> Column:
    return F.when(F.col(packed) == "", F.array().cast("array<string>")).otherwise(F.split(packed, r"\|"))
