"""Large JSON arrays: a file of one array of objects, read in byte ranges.

Spark's text source cuts a file at closing braces, so a range of bytes is a
task's share, however long the file's lines are.  Whether a piece begins inside
a string, and how deep, follows from counts of quotes and brackets before it:
sums by range first, then within a range.  A record ends where the depth returns
to that of the array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A range's sums are one row, so the window over a file's ranges has as many rows as the file has splits.
PLACE = ("_file", "_start")


def _running(pieces: DataFrame, value: str, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over all earlier pieces of the file."""
    ranges = pieces.groupBy(*PLACE).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*PLACE).orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.join(ranges, list(PLACE)).withColumn(name, F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_base")


def _count(text: Column, signs: str) -> Column:
    return F.length(text) - F.length(F.translate(text, signs, ""))


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """``file, record, value``: the JSON text of each object of the arrays at ``path``, numbered from 0 by their order.

    Objects hold anything; what else stands in the array between them is passed over.  A file without objects gives no rows.
    The number of tasks follows ``spark.sql.files.maxPartitionBytes``; no task holds more than its range and the records that end in it.
    """
    raw = spark.read.option("lineSep", "}").text(path)
    pieces = raw.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_n"), "value")
    bare = F.regexp_replace("value", r"\\.", "")  # escapes of quotes and of themselves
    pieces = pieces.withColumn("_bare", bare).withColumn("_quotes", _count(F.col("_bare"), '"'))
    pieces = _running(pieces, "_quotes", "_quoted")
    within = F.col("_quoted") % 2 == 1
    # Outside strings: what is left without the strings, the first and last of which may be open.
    opened = F.when(within, F.concat(F.lit('"'), F.col("_bare"))).otherwise(F.col("_bare"))
    outside = F.regexp_replace(opened, r'"[^"]*("|$)', "")
    closes = (F.col("_quoted") + F.col("_quotes")) % 2 == 0  # the brace behind the piece is no part of a string
    pieces = pieces.withColumn("_closes", closes).withColumn("_delta", _count(outside, "{[") - _count(outside, "}]") - F.when(closes, 1).otherwise(0))
    pieces = _running(pieces, "_delta", "_depth").drop("_bare", "_quotes")
    ends = F.col("_closes") & (F.col("_depth") + F.col("_delta") == 1)
    pieces = pieces.withColumn("_ends", ends.cast("int"))
    pieces = _running(pieces, "_ends", "record")
    parts = F.array_sort(F.collect_list(F.struct("_start", "_n", "value")))
    records = pieces.groupBy("_file", "record").agg(parts.alias("_parts"), F.max("_ends").alias("_whole")).where("_whole = 1")
    text = F.concat(F.array_join(F.transform("_parts", lambda p: p["value"]), "}"), F.lit("}"))
    # Before the object stand the array's bracket or a comma, and values that are no objects.
    lead = F.regexp_extract(text, r'^(?:[^{"]|"(?:[^"\\]|\\.)*")*', 0)
    return records.select(F.col("_file").alias("file"), "record", F.substr(text, F.length(lead) + 1).alias("value"))
