"""Mixing sources to target weights.

Method: Sainte-Lague apportionment.  Each source's target is cut into blocks of
equally many words; blocks go to sources, and then within a source to its shards,
by highest quotients ``weight / (2 j - 1)``, which gives integer quotas.  A
shard's documents stand in a seeded order and its quota takes the first blocks
of that order, going round again for repeats.

Only contested quotients are enumerated: with ``n`` parties and ``N`` blocks the
Sainte-Lague divisor ``d`` satisfies ``N - n/2 <= W/d <= N + n/2``, so a party of
weight ``w`` surely holds ``ceil(w (N - n/2) / W - 1/2)`` blocks and at most
``floor(w (N + n/2) / W + 1/2)``.  That leaves at most ``3 n`` quotients to rank,
whatever ``N`` is.

Scale: documents are shuffled once, as four numbers each, by (source, shard).
A source has at most ``MAX_SHARDS`` shards and the shards of a hot source grow
in number with its words, so no source meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block; fewer where the smallest target has no ``LEAST_BLOCKS`` of them.
BLOCK_WORDS = 64
LEAST_BLOCKS = 16
SHARD_WORDS = 65536
MAX_SHARDS = 4096
SEED = "mix-1"


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source of ``sizes(source, size)``: its words, index, weight and target.

    Sources in code point order, null last, take ``weights`` in turn.  Targets
    split ``share`` times all words by weight, none above ``cap`` times its
    source; what a capped source leaves is shared again by weight.
    """
    order = F.col("source").asc_nulls_last()
    # One row per source from here on: small, whatever the number of documents.
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    each = each.withColumn("sid", F.row_number().over(Window.orderBy(order)) - 1)
    listed = F.array(*[F.lit(float(w)) for w in weights])
    each = each.withColumn("weight", F.element_at(listed, (F.col("sid") % len(weights) + 1).cast("int")))
    each = each.withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    # Sources are capped in the order of limit / weight.
    ratio = Window.orderBy(F.col("limit") / F.col("weight"), "sid")
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy()
    capped = F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    rest = F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    wanted = F.sum("source_size").over(total) * F.lit(float(share))
    each = each.withColumn("level", (wanted - capped) / rest)
    # The first source in that order that can bear its level sets the level for all; later ones give less.
    each = each.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))).over(total))
    target = F.least(F.col("limit"), F.coalesce(F.col("level") * F.col("weight"), F.col("limit")))
    return each.select("source", "sid", "source_size", target.alias("target"))


def apportion(parties: DataFrame, group: list[str], party: str, weight: str, seats: str) -> DataFrame:
    """``parties`` with its Sainte-Lague ``quota`` of the group's ``seats``; parties of no weight get none.

    Ties between quotients go to the smaller ``party``.
    """
    held = Window.partitionBy(*group)
    w, n, s = F.col(weight).cast("double"), F.col("_n").cast("double"), F.col(seats).cast("double")
    rated = parties.withColumn("_all", F.sum(F.col(weight).cast("double")).over(held)).withColumn("_n", F.sum((F.col(weight) > 0).cast("int")).over(held))
    rated = rated.withColumn("_low", F.when(w > 0, F.greatest(F.lit(0.0), F.ceil(w * (s - n / 2) / F.col("_all") - F.lit(0.5)).cast("double"))).otherwise(0.0).cast("long"))
    rated = rated.withColumn("_high", F.when(w > 0, F.floor(w * (s + n / 2) / F.col("_all") + F.lit(0.5))).otherwise(0).cast("long"))
    rated = rated.withColumn("_open", F.col(seats).cast("long") - F.sum("_low").over(held))
    contested = rated.where(F.col("_high") > F.col("_low")).select(*group, party, "_open", w.alias("_w"), F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))).alias("_j"))
    best = Window.partitionBy(*group).orderBy((F.col("_w") / (2 * F.col("_j") - 1)).desc(), F.col(party))
    won = contested.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= F.col("_open"))
    won = won.groupBy(*group, party).agg(F.count(F.lit(1)).alias("_won"))
    joined = rated.join(won, [*group, party], "left")
    return joined.withColumn("quota", F.col("_low") + F.coalesce("_won", F.lit(0))).drop("_all", "_n", "_low", "_high", "_open", "_won")


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = SEED) -> DataFrame:
    """How many words of every document the mix takes.

    Returns doc_id, size, source_size, target, taken.  Null text has size 0;
    null source is a source of its own; repeated rows are mixed one by one; an
    empty table gives no rows.  Other columns are ignored.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    targets = source_targets(sized, weights, share, cap)
    every = Window.partitionBy()
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(every)
    block = F.coalesce(F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(least / LEAST_BLOCKS))), F.lit(1)).cast("long")
    targets = targets.withColumn("block", block)
    total_blocks = F.floor(F.sum("target").over(every) / F.col("block") + F.lit(0.5)).cast("long")
    by_source = apportion(targets.withColumn("blocks", total_blocks).withColumn("_one", F.lit(1)), ["_one"], "sid", "target", "blocks")
    shard_count = F.greatest(F.lit(1), F.least(F.lit(MAX_SHARDS), F.ceil(F.col("source_size") / SHARD_WORDS))).cast("int")
    by_source = by_source.select("source", "sid", "source_size", "target", "block", F.col("quota").alias("source_quota"), shard_count.alias("shards"))

    key = F.md5(F.concat_ws("/", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    placed = sized.join(by_source, sized["source"].eqNullSafe(by_source["source"])).drop("source")
    placed = placed.withColumn("seeded", key)
    placed = placed.withColumn("shard", (F.conv(F.substring("seeded", 1, 7), 16, 10).cast("long") % F.col("shards")).cast("int"))
    shards = placed.groupBy("sid", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"), F.first("block").alias("block"))
    quotas = apportion(shards, ["sid"], "shard", "shard_size", "source_quota")
    words = F.least(F.col("quota") * F.col("block"), F.floor(F.col("shard_size") * F.lit(float(cap))).cast("long"))
    quotas = quotas.select("sid", "shard", "shard_size", words.alias("quota_words"))

    placed = placed.join(quotas, ["sid", "shard"])
    order = Window.partitionBy("sid", "shard").orderBy("seeded", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(order), F.lit(0))
    rounds = F.when(F.col("shard_size") > 0, F.floor(F.col("quota_words") / F.col("shard_size"))).otherwise(0).cast("long")
    rest = F.col("quota_words") - rounds * F.col("shard_size")
    taken = rounds * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), rest - start))
    return placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def mix_sql(table: str = "documents") -> str:
    """The same mix in SQL, over any table with doc_id, text and source."""
    apportioned = """
{out}_r AS (SELECT *, SUM(CAST({w} AS DOUBLE)) OVER (PARTITION BY {g}) AS w_all,
            CAST(SUM(CASE WHEN {w} > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY {g}) AS DOUBLE) AS n_all FROM {src}),
{out}_b AS (SELECT *, CASE WHEN {w} > 0 THEN GREATEST(0, CAST(CEIL({w} * ({s} - n_all / 2) / w_all - 0.5) AS BIGINT)) ELSE 0 END AS low,
            CASE WHEN {w} > 0 THEN CAST(FLOOR({w} * ({s} + n_all / 2) / w_all + 0.5) AS BIGINT) ELSE 0 END AS high FROM {out}_r),
{out}_o AS (SELECT *, {s} - SUM(low) OVER (PARTITION BY {g}) AS open FROM {out}_b),
{out}_c AS (SELECT {g}, {p}, open, CAST({w} AS DOUBLE) AS w, UNNEST(RANGE(low + 1, high + 1)) AS j FROM {out}_o WHERE high > low),
{out}_w AS (SELECT {g} AS wg, {p} AS wp, COUNT(*) AS won FROM
            (SELECT *, ROW_NUMBER() OVER (PARTITION BY {g} ORDER BY w / (2 * j - 1) DESC, {p}) AS rank FROM {out}_c) WHERE rank <= open GROUP BY 1, 2),
{out} AS (SELECT o.* EXCLUDE (w_all, n_all, low, high, open), CAST(low + COALESCE(won, 0) AS BIGINT) AS quota FROM {out}_o o LEFT JOIN {out}_w ON wg = {g} AND wp = {p})"""
    return f"""
WITH sized AS (SELECT doc_id, source, COALESCE(LEN(REGEXP_EXTRACT_ALL(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size FROM {table}),
e1 AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
e2 AS (SELECT *, ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM e1),
e3 AS (SELECT *, CASE sid % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS lim FROM e2),
e4 AS (SELECT *, (SUM(source_size) OVER () * 1.5::DOUBLE - COALESCE(SUM(lim) OVER pre, 0)) / (SUM(weight) OVER () - COALESCE(SUM(weight) OVER pre, 0)) AS lv
       FROM e3 WINDOW pre AS (ORDER BY lim / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e5 AS (SELECT *, MAX(CASE WHEN lv * weight <= lim THEN lv END) OVER () AS level FROM e4),
e6 AS (SELECT source, sid, source_size, LEAST(lim, COALESCE(level * weight, lim)) AS target, 1 AS one FROM e5),
e6b AS (SELECT *, CAST(COALESCE(GREATEST(1, LEAST({BLOCK_WORDS}, FLOOR(MIN(CASE WHEN target > 0 THEN target END) OVER () / {LEAST_BLOCKS}))), 1) AS BIGINT) AS block FROM e6),
e7 AS (SELECT *, CAST(FLOOR(SUM(target) OVER () / block + 0.5) AS BIGINT) AS blocks FROM e6b),
{apportioned.format(out="src_q", src="e7", g="one", p="sid", w="target", s="blocks")},
placed AS (SELECT doc_id, size, sid, source_size, target, block, quota AS source_quota, MD5('{SEED}/' || COALESCE(CAST(doc_id AS VARCHAR), 'null')) AS seeded,
       GREATEST(1, LEAST({MAX_SHARDS}, CAST(CEIL(source_size / {SHARD_WORDS}) AS BIGINT))) AS shards FROM sized JOIN src_q ON sized.source IS NOT DISTINCT FROM src_q.source),
placed2 AS (SELECT *, CAST('0x' || SUBSTR(seeded, 1, 7) AS BIGINT) % shards AS shard FROM placed),
shards AS (SELECT sid, shard, CAST(SUM(size) AS BIGINT) AS shard_size, MIN(source_quota) AS source_quota, MIN(block) AS block FROM placed2 GROUP BY 1, 2),
{apportioned.format(out="shard_q", src="shards", g="sid", p="shard", w="shard_size", s="source_quota")},
quotas AS (SELECT sid, shard, shard_size, LEAST(quota * block, shard_size * 2) AS quota_words FROM shard_q),
laid AS (SELECT p.*, q.shard_size, CASE WHEN shard_size > 0 THEN quota_words // shard_size ELSE 0 END AS rounds, quota_words,
       COALESCE(SUM(size) OVER (PARTITION BY p.sid, p.shard ORDER BY seeded, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
       FROM placed2 p JOIN quotas q ON p.sid = q.sid AND p.shard = q.shard)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(rounds * size + LEAST(size, GREATEST(0, quota_words - rounds * shard_size - start)) AS BIGINT) AS taken FROM laid"""


QUERIES = {"op2_mix_sources": op2}
ORACLES = {"op2_mix_sources": mix_sql()}
