"""References to records that do not exist, kept as state by key through time.

State of a key is how many rows of the target table hold it. Loads raise and deletions lower that count, references probe it.
The state is carried from day to day: `carried_state` keeps one row for each key and day on which anything happens, with the
count at the day's opening and the changes within the day, so that a key with a third of all references is spread over its days
and no group grows with the number of references.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vankho.runtime import cut


def parent_changes(parents: DataFrame) -> DataFrame:
    """(key, at, change) from parents(key, loaded_at, deleted_at): +1 at loading, -1 at deletion, added up by key and moment.

    Rows without key or loaded_at, and rows deleted at or before loading, never hold a key.
    """
    held = parents.where(F.col("key").isNotNull() & F.col("loaded_at").isNotNull() & (F.col("deleted_at").isNull() | (F.col("deleted_at") > F.col("loaded_at"))))
    both = F.array(F.struct(F.col("loaded_at").alias("at"), F.lit(1).alias("change")), F.struct(F.col("deleted_at").alias("at"), F.lit(-1).alias("change")))
    changes = held.select("key", F.inline(both)).where("at is not null")
    return changes.groupBy("key", "at").agg(F.sum("change").cast("int").alias("change")).where("change <> 0")


def carried_state(changes: DataFrame, days: DataFrame) -> DataFrame:
    """(key, day, opening, within): the count at the opening of each day of `days`(key, day), and the changes within that day."""
    daily = changes.groupBy("key", F.to_date("at").alias("day")).agg(F.sum("change").alias("total"), F.array_sort(F.collect_list(F.struct("at", "change"))).alias("within"))
    both = daily.unionByName(days.select("key", "day", F.lit(0).cast("bigint").alias("total"), F.lit(None).cast(daily.schema["within"].dataType).alias("within")))
    merged = both.groupBy("key", "day").agg(F.sum("total").alias("total"), F.flatten(F.collect_list("within")).alias("within"))
    before = Window.partitionBy("key").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return merged.select("key", "day", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("opening"), "within")


def orphan_references(references: DataFrame, parents: DataFrame) -> DataFrame:
    """References whose key no parent holds at the reference's moment.

    references(key, at, ...), parents(key, loaded_at, deleted_at). Every reference is probed once; references without key or
    moment give no row; a load at the very moment counts as held, a deletion at the very moment does not.
    """
    return _probed(references, parent_changes(parents), None)


def _probed(references: DataFrame, changes: DataFrame, held: DataFrame | None) -> DataFrame:
    """References whose key is not held at their moment, by the changes and, before these, by held(key, held)."""
    asked = references.where(F.col("key").isNotNull() & F.col("at").isNotNull()).withColumn("_day", F.to_date("at"))
    days = asked.select("key", F.col("_day").alias("day")).distinct()
    state = carried_state(changes, days)
    if held is not None:
        state = state.join(held, "key", "left").withColumn("opening", F.col("opening") + F.coalesce("held", F.lit(0)))
    state = state.select(F.col("key").alias("_key"), F.col("day").alias("_d"), "opening", "within")
    found = asked.join(state, (F.col("key") == F.col("_key")) & (F.col("_day") == F.col("_d")), "left")
    since = F.aggregate(F.filter("within", lambda e: e["at"] <= F.col("at")), F.lit(0).cast("bigint"), lambda a, e: a + e["change"])
    now = F.coalesce(F.col("opening"), F.lit(0)) + F.coalesce(since, F.lit(0))
    return found.where(now <= 0).drop("_day", "_key", "_d", "opening", "within")


def advance(state: DataFrame | None, references: DataFrame, changes: DataFrame, group: str = "source_table") -> tuple[DataFrame, DataFrame]:
    """(orphans, state) after one more stretch of time, from the state before it (None: nothing yet) and what came within it.

    state(key, group, held, asked): how many parents hold a key, and how many references of each group have asked for it so far; rows
    without group carry keys that nobody asked for. References probe it, loads and deletions move it; what waits for a key is every
    reference so far while nobody holds it, so arrivals resolve and deletions reopen without touching single references. The state is
    a table by key: it can be written, and the next stretch goes on from it.
    """
    none = F.lit(None).cast("string")
    before = None if state is None else state.groupBy("key").agg(F.max("held").alias("held"))
    orphans = _probed(references, changes, before)
    asked = references.where(F.col("key").isNotNull() & F.col("at").isNotNull()).groupBy("key", group).agg(F.count("*").alias("asked"))
    moved = changes.groupBy("key").agg(F.sum("change").cast("bigint").alias("change"))
    rows = asked.select("key", group, F.lit(0).cast("bigint").alias("change"), "asked").unionByName(moved.select("key", none.alias(group), "change", F.lit(0).cast("bigint").alias("asked")))
    if state is not None:
        rows = rows.unionByName(state.select("key", group, F.when(F.col(group).isNull(), F.col("held")).otherwise(0).alias("change"), "asked"))
    summed = rows.groupBy("key", group).agg(F.sum("change").alias("change"), F.sum("asked").alias("asked"))
    held = summed.where(F.col(group).isNull()).select("key", F.col("change").alias("held"))
    after = summed.join(held, "key", "left").select("key", group, F.coalesce("held", F.lit(0)).alias("held"), "asked")
    return orphans, after


def in_stretches(references: DataFrame, parents: DataFrame, starts: list, group: str = "source_table") -> tuple[DataFrame, DataFrame]:
    """(orphans, state) of the whole history, kept as state from one of `starts` (moments in order) to the next; the state is written at each."""
    changes = parent_changes(parents)
    state, found = None, None
    for i in range(len(starts) + 1):
        after, before = (starts[i - 1] if i else None), (starts[i] if i < len(starts) else None)
        inside = F.lit(True)
        inside = inside if after is None else inside & (F.col("at") >= F.lit(after))
        inside = inside if before is None else inside & (F.col("at") < F.lit(before))
        orphans, state = advance(state, references.where(inside), changes.where(inside), group)
        state = cut(state)
        found = orphans if found is None else found.unionAll(orphans)
    return found, state


def pending_snapshots(references: DataFrame, parents: DataFrame, group: str = "source_table") -> DataFrame:
    """(group, period, opened, pending): orphans that came up in each month, and how many wait at its end.

    An arriving parent resolves all that wait for its key and a deletion of the last one reopens them, so what waits for a key
    at a month's end is every reference so far if its count is 0 then, else none. Counts are added up by key and month first;
    the running sums see one row per key and month.
    """
    month = lambda c: F.date_format(c, "yyyy-MM")
    asked = references.where(F.col("key").isNotNull() & F.col("at").isNotNull()).groupBy("key", group, month("at").alias("period")).agg(F.count("*").alias("asked"))
    keys = references.select("key", group).distinct()
    moved = parent_changes(parents).groupBy("key", month("at").alias("period")).agg(F.sum("change").alias("change"))
    moved = moved.join(keys, "key").select("key", group, "period", F.lit(0).cast("bigint").alias("asked"), "change")
    both = asked.select("key", group, "period", "asked", F.lit(0).cast("bigint").alias("change")).unionByName(moved)
    monthly = both.groupBy("key", group, "period").agg(F.sum("asked").alias("asked"), F.sum("change").alias("change"))
    w = Window.partitionBy("key", group).orderBy("period")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    waits = F.when(F.sum("change").over(run) <= 0, F.sum("asked").over(run)).otherwise(0)
    # a key's waiting count stays until its next row: write it as differences, add those up by month, then run over months
    steps = monthly.withColumn("waits", waits).withColumn("step", F.col("waits") - F.coalesce(F.lag("waits").over(w), F.lit(0)))
    by_month = steps.groupBy(group, "period").agg(F.sum("step").alias("step"), F.sum("asked").alias("asked"))
    opened = orphan_references(references, parents).groupBy(group, month("at").alias("period")).agg(F.count("*").alias("opened"))
    total = Window.partitionBy(group).orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    out = by_month.withColumn("pending", F.sum("step").over(total)).join(opened, [group, "period"], "left")
    return out.select(group, "period", "asked", F.coalesce("opened", F.lit(0).cast("bigint")).alias("opened"), "pending")
