"""Target-distribution importance resampling.

Method: hashed n-gram features of words.  A 256-byte table lower-cases A-Z and
blanks separators in UTF-8, ``bytes.split`` gives the words, and a chained
``zlib.crc32`` seeds an n-gram with the hash of the n-gram before it, so no n-gram
is ever built as text.  Counters over buckets are reduced by Spark; the gain of
a bucket compares the target's smoothed share with the corpus's.  Documents are
drawn without replacement by the largest sums of gains with Gumbel noise.

Scale: both passes over the texts are narrow.  Counts are ``BUCKETS`` rows a task
and gains ``BUCKETS`` numbers, broadcast.  The draw finds its lowest score from
a histogram of at most some 100,000 bins, and only what may be drawn is shuffled,
as three numbers a row: ranks are windows within one score, offset by the counts
of higher ones, so neither a window nor a task holds more than ties of a score.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgermend.llm.tokens import slices
from ledgermend.workspace import stored

BUCKETS = 10_000
ORDERS = 3
MIN_WORDS = 20
PERCENT = 5
SEED = "42"
#: Bins of the histogram keep so many leading bits of a score.
BIN_BITS = 10

#: Digits, a-z and all bytes beyond ASCII are of words; A-Z become a-z, every other byte a blank.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def features(text: bytes) -> np.ndarray:
    """Buckets of all runs of one to ``ORDERS`` words, repeats included."""
    words = text.translate(TABLE).split()
    hashes = list(map(zlib.crc32, words))
    found = [hashes]
    following = [b" " + w for w in words[1:]]
    for _ in range(ORDERS - 1):
        # The hash of a longer run goes on from that of the run without its last word.
        hashes = list(map(zlib.crc32, following, hashes[: len(following)]))
        following = following[1:]
        found.append(hashes)
    return np.array([h for x in found for h in x], np.int64) % BUCKETS


def _texts(batch: pa.RecordBatch):
    for rows, data, offsets in slices(batch):
        raw = data.tobytes()
        yield rows, [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _count(batches):
    total: Counter[int] = Counter()
    for batch in batches:
        for _, texts in _texts(batch):
            for text in texts:
                total.update(features(text).tolist())
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(total.keys(), pa.int32()), "n": pa.array(total.values(), pa.int64())})


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of ``texts(text)`` fall into each bucket."""
    rows = texts.select("text").mapInArrow(_count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most BUCKETS rows
    out = np.zeros(BUCKETS, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of every bucket: floor(1000 ln of the target's smoothed share over the corpus's)."""
    all_s, all_t = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_s / ((s + 1.0) * all_t))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(name: str) -> int:
    """Gumbel noise of a document, in thousandths, from the first 32 bits of a hash."""
    h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weigh(shared, seed: str, id_type: pa.DataType):
    def run(batches):
        gain = shared.value
        for batch in batches:
            names = batch.column(1).to_pylist()
            weight, size = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
            for rows, texts in _texts(batch):
                for k, text in enumerate(texts, rows.start):
                    found = features(text)
                    weight[k], size[k] = gain[found].sum(), len(found)
            score = weight + np.fromiter(map(noise, map("{}:{}".format, repeat(seed), names)), np.int64, len(names))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).cast(id_type), "n_features": size, "weight": weight, "score": score})

    return run


def bin_of(score) -> F.Column:
    """A number that grows with the score and keeps its ``BIN_BITS`` leading bits: at most 2 * 64 * 2**BIN_BITS of them."""
    size = F.abs(score)
    bits = F.length(F.bin(size))
    shift = F.greatest(bits - (BIN_BITS + 1), F.lit(0))
    level = shift.cast("long") * (1 << (BIN_BITS + 1)) + F.call_function("shiftright", size, shift)
    return F.when(score < 0, -level).otherwise(level)


def drawn(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """``scored(doc_id, n_features, weight, score)`` with rank, null where a row isn't drawn.

    Of the N rows with at least ``min_words`` words, floor(percent N / 100) of the highest scores, ties
    to the smaller doc_id (null last).  ``scored`` is read three times, so store it.
    """
    least = sum(max(min_words - k, 0) for k in range(ORDERS))  # features grow with words
    able = F.col("n_features") >= least
    rated = scored.withColumn("_bin", F.when(able, bin_of(F.col("score"))))
    bins = sorted(((r["_bin"], r["n"]) for r in rated.where("_bin is not null").groupBy("_bin").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)  # bounded, see bin_of
    wanted = sum(n for _, n in bins) * percent // 100
    offsets, before = [], 0
    for number, n in bins:
        if before >= wanted:
            break
        offsets.append((number, before))
        before += n
    columns = [*scored.columns, F.lit(None).cast("long").alias("rank")]
    if not offsets:
        return scored.select(columns)
    lowest = offsets[-1][0]
    may = rated.where(F.col("_bin") >= lowest)
    base = F.broadcast(scored.sparkSession.createDataFrame(offsets, "_bin long, _before long"))
    # Of each score, how many stand before it: those of higher bins, and higher scores of its bin.
    scores = may.groupBy("_bin", "score").agg(F.count(F.lit(1)).alias("_n")).join(base, "_bin")
    higher = Window.partitionBy("_bin").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    scores = scores.select("score", (F.col("_before") + F.coalesce(F.sum("_n").over(higher), F.lit(0))).alias("_before"))
    ties = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features")
    place = (F.col("_before") + F.row_number().over(ties)).cast("long")
    ranked = may.join(scores, "score").withColumn("_place", place)
    ranked = ranked.select(*scored.columns, F.when(F.col("_place") <= wanted, F.col("_place")).alias("rank"))
    return ranked.unionByName(rated.where(F.coalesce(F.col("_bin") < lowest, F.lit(True))).select(columns))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: str = SEED) -> DataFrame:
    """``percent`` of the rows of ``docs(doc_id, text)``, drawn to look like the texts of ``target(text)``.

    Returns doc_id, n_features, weight, score, rank, one row for every row of ``docs``.  Null and
    empty texts have no features and weight 0.  A null doc_id has the noise of the name ``seed:null``.  Repeated
    rows are counted and drawn one by one; rows of one doc_id and score rank by n_features.
    Without target texts every gain compares with an even share.  An empty table gives no rows; other columns are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(gains(bucket_counts(docs), bucket_counts(target)))
    kind = docs.schema["doc_id"].dataType
    named = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("name"), "text")
    scored = named.mapInArrow(_weigh(shared, seed, to_arrow_type(kind)), f"doc_id {kind.simpleString()}, n_features long, weight long, score long")
    return drawn(stored(scored, "resampling-scores"), percent, min_words)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    return resample(docs, benchmark).select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op12_importance_resampling": op12}
