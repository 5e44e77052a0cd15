"""Successive snapshots: outcome events, upserts and nested merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshot_diff(previous: DataFrame, current: DataFrame, account: str, family: str, content: str) -> DataFrame:
    """Deleted, NoChange (new), Updated or Verified for every family of an account that was seen before.

    An account's first snapshot only sets the base and gives no events.
    """
    had = previous.select(account).distinct()
    now = current.select(account).distinct()
    old = previous.select(account, family, F.col(content).alias("_old"), F.lit(True).alias("_was"))
    new = current.select(account, family, F.col(content).alias("_new"), F.lit(True).alias("_is"))
    both = old.join(now, account, "left_semi").join(new.join(had, account, "left_semi"), [account, family], "full_outer")
    outcome = F.when(F.col("_is").isNull(), "Deleted").when(F.col("_was").isNull(), "NoChange").when(~F.col("_old").eqNullSafe(F.col("_new")), "Updated").otherwise("Verified")
    changed = F.col("_is").isNull() | (F.col("_was").isNotNull() & ~F.col("_old").eqNullSafe(F.col("_new")))
    return both.select(account, family, outcome.alias("outcome"), F.when(changed, F.col("_old")).alias("previous"), F.when(changed, F.col("_new")).alias("current"))


def unmatched(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), list(keys), "left_anti")


def upsert(base: DataFrame, patch: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Field by field the patch's last non-null value, else the base's; keys of either side stay.

    ``patch`` has seq, its order.
    """
    rows = base.select(*keys, *fields, F.lit(-1).cast("long").alias("seq")).unionByName(patch.select(*keys, *fields, F.col("seq").cast("long")))
    pick = lambda f: F.max(F.when(F.col(f).isNotNull(), F.struct("seq", f)))[f].alias(f)
    return rows.groupBy(*keys).agg(*[pick(f) for f in fields])


def merged_scalar(base: Column, patch: Column) -> Column:
    """The patch unless it is empty."""
    return F.when(patch.isNull() | (patch.cast("string") == ""), F.coalesce(base, patch)).otherwise(patch)


def merged_map(base: Column, patch: Column) -> Column:
    return F.map_zip_with(base, patch, lambda k, a, b: merged_scalar(a, b))


def merged_list(base: Column, patch: Column) -> Column:
    """The base as it is, its own repeats included, then what only the patch has."""
    return F.concat(base, F.array_except(patch, base))


def merged_keyed_list(base: Column, patch: Column, key: str, value: str) -> Column:
    """Structs of a key and a value: patched in place, new keys at the end."""
    own = lambda items, k: F.get(F.filter(items, lambda x: x[key] == k), F.lit(0))
    kept = F.transform(base, lambda x: F.struct(x[key].alias(key), F.coalesce(merged_scalar(x[value], own(patch, x[key])[value]), x[value]).alias(value)))
    fresh = F.filter(patch, lambda p: ~F.exists(base, lambda x: x[key] == p[key]))
    return F.concat(kept, fresh)


def first_by_content(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Of rows with equal content the first."""
    content = F.to_json(F.struct(*sorted(c for c in df.columns if c != order)))
    w = Window.partitionBy(*keys, "_content").orderBy(order)
    return df.withColumn("_content", content).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_content", "_n")


def higher_status(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], ranks: Sequence[str]) -> DataFrame:
    """The status of the higher rank; on ties the incoming row."""
    rank = F.array_position(F.array(*[F.lit(r) for r in ranks]), F.col("status"))
    rows = existing.withColumn("_side", F.lit(0)).unionByName(incoming.withColumn("_side", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(rank.desc(), F.col("_side").desc())
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_side")


def next_step(status: Column, last_outcome: Column, last_sent: Column, eligible: Column, now: Column, sla_days: int = 30) -> Column:
    """What an account's state allows now, or when it will: tags and next_eligible_at."""
    none = F.array().cast("array<string>")
    due = last_sent + F.expr(f"interval {sla_days} days")
    wait = F.coalesce(now < eligible, F.lit(False))
    outcome = F.lower(F.coalesce(last_outcome, F.lit("")))
    empty = F.lit(None).cast("timestamp")
    pair = lambda tags, at: F.struct(tags.alias("tags"), at.alias("next_eligible_at"))
    tags = lambda *t: F.array(*[F.lit(x) for x in t])
    sent = F.when(last_sent.isNull() | (now >= due), pair(tags("followup"), empty)).otherwise(pair(none, due))
    fsm = F.when(status == "PLANNED", pair(tags("dispute"), empty)).when(status == "SENT", sent).otherwise(pair(none, empty))
    return (
        F.when(status == "COMPLETED", pair(none, eligible)).when(outcome == "verified", pair(tags("mov", "direct_dispute"), empty))
        .when(outcome == "updated", pair(tags("bureau_dispute"), empty)).when(wait, pair(none, eligible))
        .when(outcome == "nochange", pair(tags("mov"), empty)).otherwise(fsm)
    )
