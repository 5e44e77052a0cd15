"""Similarity of short texts by matching blocks (Ratcliff and Obershelp), as joins and windows.

The longest common run of two texts is a match; what lies left and right of it
is matched again.  A pair's equal letters are points; a run is an island on a
diagonal.  Every round takes the longest run of each open piece, the first on
ties, and splits the piece, so rounds follow the number of blocks of the worst
pair and everything in them is spread by pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgermend.workspace import discard, stored


def letters(df: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """A row for every letter: the key, the letter and its place."""
    return df.select(key, F.posexplode(F.split(text, "")).alias(name, "letter")).where("letter <> ''")


def matched_letters(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """``key, matched``: how many letters of two texts lie in matching blocks; keys without any have no row.

    Letters of a pair meet, so this is for names and titles.
    """
    points = letters(pairs, key, a, "i").join(letters(pairs, key, b, "j"), [key, "letter"]).select(key, F.lit(0).alias("lo_a"), F.lit(0).alias("lo_b"), "i", "j")
    points = stored(points, "letter-pairs")
    piece, total = [key, "lo_a", "lo_b"], []
    while not points.isEmpty():
        line = Window.partitionBy(*piece, F.col("i") - F.col("j")).orderBy("i")
        runs = points.withColumn("run", F.col("i") - F.row_number().over(line)).groupBy(*piece, (F.col("i") - F.col("j")).alias("d"), "run")
        runs = runs.agg(F.count(F.lit(1)).cast("int").alias("n"), F.min("i").alias("a"), F.min("j").alias("b"))
        best = runs.groupBy(*piece).agg(F.min(F.struct((-F.col("n")).alias("n"), "a", "b")).alias("x")).select(*piece, "x.a", "x.b", (-F.col("x.n")).alias("n"))
        best = stored(best, "blocks")
        total.append(best)
        met = points.join(best, piece)
        left = (F.col("i") < F.col("a")) & (F.col("j") < F.col("b"))
        right = (F.col("i") >= F.col("a") + F.col("n")) & (F.col("j") >= F.col("b") + F.col("n"))
        from_a, from_b = (F.when(right, F.col(c) + F.col("n")).otherwise(F.col(lo)).alias(lo) for c, lo in (("a", "lo_a"), ("b", "lo_b")))
        rest = stored(met.where(left | right).select(key, from_a, from_b, "i", "j"), "letter-pairs")
        discard(points)
        points = rest
    every = points.select(key, F.lit(0).alias("n"))
    for best in total:
        every = every.unionByName(best.select(key, "n"))
    return every.groupBy(key).agg(F.sum("n").alias("matched"))


def ratio(pairs: DataFrame, key: str, a: str, b: str, name: str = "ratio") -> DataFrame:
    """``pairs`` with the share of letters in matching blocks: 1 for two empty texts, 0 if either is null.  ``key`` is unique."""
    size = F.length(a) + F.length(b)
    share = F.when(F.col(a).isNull() | F.col(b).isNull(), 0.0).when(size == 0, 1.0).otherwise(2.0 * F.coalesce("_matched", F.lit(0)) / size)
    found = matched_letters(pairs, key, a, b).withColumnRenamed("matched", "_matched")
    return pairs.join(found, key, "left").withColumn(name, share).drop("_matched")


def closest(names: DataFrame, choices: DataFrame, session: str, name: str, choice: str, cutoff: float = 0.8) -> DataFrame:
    """For each name of a session its most similar choice there, the first by text on ties, if it reaches the cutoff."""
    pairs = names.select(session, name).distinct().join(choices.select(session, choice).distinct(), session)
    pairs = pairs.withColumn("_pair", F.sha2(F.concat_ws("\0", F.col(session).cast("string"), name, choice), 256))
    scored = ratio(pairs, "_pair", name, choice).where(F.col("ratio") >= cutoff)
    best = scored.groupBy(session, name).agg(F.min(F.struct((-F.col("ratio")).alias("r"), F.col(choice).alias("c"))).alias("x"))
    return best.select(session, name, F.col("x.c").alias(choice), (-F.col("x.r")).alias("ratio"))
