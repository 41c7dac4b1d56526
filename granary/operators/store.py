"""Keyed stores (memories, tasks, sessions) as tables of versions: the newest version of a key counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The newest row of each key by updated_at, of equal ones the new table's, then the greatest by its other columns; its created_at is the oldest one's."""
    every = stored.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(key)
    rest = [F.col(c).desc() for c in stored.columns if c not in (key, "updated_at")]
    newest = w.orderBy(F.col("updated_at").desc(), F.col("__new").desc(), *rest)
    return every.withColumn("__n", F.row_number().over(newest)).withColumn("created_at", F.min("created_at").over(w)).where("__n = 1").drop("__n", "__new")


def memory_list(memories: DataFrame, tag: str | None = None, search: str | None = None) -> DataFrame:
    """Memories by tag and by a word in key or value, the newest first."""
    out = memories
    if tag:
        out = out.where(F.array_contains("tags", tag))
    if search:
        out = out.where(F.contains(F.lower("key"), F.lit(search.lower())) | F.contains(F.lower("value"), F.lit(search.lower())))
    return out.orderBy(F.col("updated_at").desc(), "key")


def memory_get(memories: DataFrame, key: str) -> DataFrame:
    return memories.where(F.col("key") == key)


def deleted(rows: DataFrame, key: str, value) -> DataFrame:
    return rows.where(~F.col(key).eqNullSafe(F.lit(value)))


def task_create(tasks: DataFrame, **values) -> DataFrame:
    """``tasks`` and one more: pending, of priority 0 and without tags unless given."""
    row = {"status": "pending", "priority": 0, "tags": []} | values
    return tasks.unionByName(tasks.sparkSession.createDataFrame([tuple(row.get(f.name) for f in tasks.schema)], tasks.schema))


def task_update(tasks: DataFrame, id, **values) -> DataFrame:
    """A task's given values replace the old ones; a null leaves them as they are."""
    here = F.col("id") == F.lit(id)
    return tasks.withColumns({k: F.when(here, F.coalesce(F.lit(v).cast(tasks.schema[k].dataType), F.col(k))).otherwise(F.col(k)) for k, v in values.items()})


def task_list(tasks: DataFrame, status: str | None = None, tag: str | None = None) -> DataFrame:
    out = tasks.where(F.col("status") == status) if status else tasks
    out = out.where(F.array_contains("tags", tag)) if tag else out
    return out.orderBy(F.col("priority").desc(), F.col("created_at").desc(), "id")


def session_snapshot(sessions: DataFrame, name: str, data: str, created_at) -> DataFrame:
    """``sessions`` and one more, of any JSON, with the next id."""
    last = sessions.agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint").alias("id"))
    row = last.select((F.col("id") + 1).cast(sessions.schema["id"].dataType).alias("id"), F.lit(name).alias("name"), F.lit(data).alias("snapshot"), F.lit(created_at).cast(sessions.schema["created_at"].dataType).alias("created_at"))
    return sessions.unionByName(row)


def session_list(sessions: DataFrame, limit: int = 20) -> DataFrame:
    return sessions.orderBy(F.col("created_at").desc(), "id").limit(limit)


def session_restore(sessions: DataFrame, id) -> DataFrame:
    """The snapshot of a session as a variant; null where its JSON is broken."""
    return sessions.where(F.col("id") == F.lit(id)).withColumn("snapshot", F.try_parse_json("snapshot"))
