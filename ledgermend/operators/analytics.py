"""Grouped quality metrics of processed letters, counters and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COUNTED_KEYS = ("bureau", "mismatch_type", "cycle", "step")


def heatmap(samples: DataFrame, tag: str, fields: str) -> DataFrame:
    """How often each entry of an array column occurs by tag."""
    return samples.select(tag, F.explode(fields).alias("field")).groupBy(tag, "field").agg(F.count(F.lit(1)).alias("n"))


#: Sections of the report: counted entries, shares, and measures with the names of their mean and percentile.
RATES = ("finalization_pass_rate", "sanitizer_applied_rate")
MEASURES = {"render_ms": ("render_latency_avg_ms", "render_latency_p95_ms"), "ai_cost": ("ai_cost_avg", "ai_cost_p95")}


def batch_report(samples: DataFrame, percent: float = 95.0) -> DataFrame:
    """The whole report as rows of section, category, item, extra and value, from one pass over the samples.

    ``samples`` has action_tag, template, candidate_missing_fields,
    validation_failed_fields, final_missing_fields, sanitizer_overrides, render_ms
    and ai_cost.  Every sample gives one entry for each rate, measure and array element; equal entries are counted
    before they are shuffled, and means and floor ranks follow from the counts.
    """
    failed = F.coalesce(F.size("validation_failed_fields") > 0, F.lit(False))
    cleaned = F.coalesce(F.size("sanitizer_overrides") > 0, F.lit(False))

    def entry(section: str, category: str, item: Column, value: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), F.col(category).alias("category"), item.alias("item"), value.cast("double").alias("v"))

    def listed(section: str, category: str, fields: str, clean=lambda x: x) -> Column:
        return F.transform(F.coalesce(F.col(fields), F.array().cast("array<string>")), lambda x: entry(section, category, clean(x), F.lit(1.0)))

    single = F.array(
        entry(RATES[0], "action_tag", F.lit(""), (~failed).cast("int")), entry(RATES[1], "template", F.lit(""), cleaned.cast("int")),
        *[entry(m, "template", F.lit(""), F.coalesce(F.col(m), F.lit(0.0))) for m in MEASURES],
    )
    many = F.concat(
        single, listed("missing_fields_after_normalization", "action_tag", "candidate_missing_fields"), listed("missing_fields_after_strategy", "action_tag", "final_missing_fields"),
        listed("validation_failed", "template", "validation_failed_fields"), listed("policy_override_reason", "template", "sanitizer_overrides", lambda x: F.replace(x, F.lit(" "), F.lit("_"))),
    )
    group = ["section", "category", "item"]
    counted = samples.select(F.explode(many).alias("e")).select("e.*").groupBy(*group, "v").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*group)
    ranked = counted.withColumn("upto", F.sum("n").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(w))
    reached = F.col("upto") >= F.greatest(F.lit(1), F.floor(F.col("all") * percent / 100))
    summed = ranked.groupBy(*group).agg(F.sum("n").cast("double").alias("all"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"), F.min(F.when(reached, F.col("v"))).alias("rank"))
    named = lambda name, value: F.struct(F.lit(name).alias("section"), F.col(value).alias("value"))
    shown = F.array(F.struct("section", F.when(F.col("section").isin(*RATES), F.col("mean")).otherwise(F.col("all")).alias("value")))
    for measure, (mean, rank) in MEASURES.items():
        shown = F.when(F.col("section") == measure, F.array(named(mean, "mean"), named(rank, "rank"))).otherwise(shown)
    return summed.select("category", "item", F.explode(shown).alias("x")).select("x.section", "category", "item", F.lit("").alias("extra"), "x.value")


def counters(emitted: DataFrame) -> DataFrame:
    """Sums of increments by name; details of the allowed kinds count under ``name.kind.value`` too.

    ``emitted`` has name, increment (null for a counted detail) and details, a map.
    """
    base = emitted.select("name", F.coalesce("increment", F.lit(1.0)).alias("value"))
    more = emitted.select("name", F.explode(F.map_filter("details", lambda k, v: k.isin(*COUNTED_KEYS) & v.isNotNull())).alias("k", "v"))
    more = more.select(F.concat_ws(".", "name", "k", "v").alias("name"), F.lit(1.0).alias("value"))
    return base.union(more).groupBy("name").agg(F.sum("value").alias("value"))


def gauges(emitted: DataFrame, order: str) -> DataFrame:
    """The last value of each name."""
    return emitted.groupBy("name").agg(F.max_by("value", order).alias("value"))


def missing_field_counts(counts: DataFrame) -> DataFrame:
    """Of counters ``router.missing_fields.<tag>.<template>.<field>``: sums by tag and field, without finalize's."""
    rest = counts.where(F.col("name").startswith("router.missing_fields.")).select(F.substring("name", 23, 1 << 20).alias("rest"), "value")
    rest = rest.where(~F.col("rest").startswith("finalize.") & (F.size(F.split("rest", r"\.")) >= 3))
    tag = F.regexp_extract("rest", r"^([^.]*)\.", 1)
    field = F.regexp_extract("rest", r"\.([^.]*)$", 1)
    return rest.groupBy(tag.alias("tag"), field.alias("field")).agg(F.sum(F.col("value").cast("long")).alias("n"))


def skipped_counts(counts: DataFrame) -> DataFrame:
    rest = counts.where(F.col("name").startswith("router.skipped."))
    return rest.groupBy(F.substring("name", 16, 1 << 20).alias("tag")).agg(F.sum(F.col("value").cast("long")).alias("n"))


def usage_totals(calls: DataFrame, keys: list[str], tokens: str, cost: str) -> DataFrame:
    """Tokens, cost (to the cent) and number of calls by key."""
    return calls.groupBy(*keys).agg(F.sum(tokens).alias("tokens"), F.round(F.sum(cost), 2).alias("cost"), F.count(F.lit(1)).alias("calls"))


def nearest_rank(df: DataFrame, keys: list[str], value: str, percent: float, name: str) -> DataFrame:
    """The value at rank ``ceil(n p / 100)`` of each key, as for match confidence."""
    return df.groupBy(*keys).agg(F.expr(f"percentile_disc({percent / 100}) within group (order by `{value}`)").alias(name))


def guardrails(counts: DataFrame, render_ms: float, sanitized: float) -> DataFrame:
    """Per template whether its failures, overrides or rendering break the limits."""
    kinds = {"router.finalized.": "total", "validation.failed.": "fails", "letter.render_ms.": "renders", "sanitizer.applied.": "sanitized"}
    kind = F.lit(None).cast("string")
    for prefix, name in kinds.items():
        kind = F.when(F.col("name").startswith(prefix), name).otherwise(kind)
    long = counts.withColumn("kind", kind).where("kind is not null").withColumn("template", F.regexp_extract("name", r"([^.]*)$", 1))
    wide = long.groupBy("template").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("value"))), F.lit(0.0)).alias(k) for k in kinds.values()])
    broken = ((F.col("total") > 0) & ((F.col("fails") >= 0.01 * F.col("total")) | (F.col("sanitized") > sanitized * F.col("total")))) | (F.col("renders") > render_ms)
    return wide.withColumn("breached", broken)


def eval_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """Mean of each metric before and after, and the difference; absent ones are 0."""
    mean = lambda df, name: df.groupBy("metric").agg(F.avg("value").alias(name))
    joined = mean(before, "pre").join(mean(after, "post"), "metric", "full_outer").na.fill(0.0, ["pre", "post"])
    return joined.withColumn("delta", F.col("post") - F.col("pre"))


def stage_counts(df: DataFrame) -> DataFrame:
    """Results by stage, clamped so that completed never exceeds the total and pending fills the rest."""
    by = df.groupBy("stage").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "pending").alias("pending"))
    done = F.least("completed", "total")
    return by.select("stage", "total", done.alias("completed"), F.greatest(F.col("pending"), F.col("total") - done).alias("pending"))


def latest_stage(df: DataFrame, key: str, order: tuple[str, ...] = ("merge", "validation", "frontend")) -> DataFrame:
    """The stage with the latest of its times; ties to the later stage of the order."""
    place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("stage"))
    when = F.coalesce("last_at", "ended_at", "started_at")
    return df.where(when.isNotNull()).groupBy(key).agg(F.max(F.struct(when.alias("at"), place.alias("place"), "stage")).alias("x")).select(key, F.col("x.stage").alias("stage"), F.col("x.at").alias("at"))


def sampled_steps(df: DataFrame, keys: list[str], order: list[str], every: int) -> DataFrame:
    """All steps that did not succeed; of the successful ones the first and every so many."""
    w = Window.partitionBy(*keys, F.col("status") == "success").orderBy(*order)
    n = F.row_number().over(w)
    return df.withColumn("_n", n).where((F.col("status") != "success") | (F.col("_n") == 1) | (F.col("_n") % every == 0)).drop("_n")
