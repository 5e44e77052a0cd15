"""The corpus pipeline: language ID, near and substring deduplication, decontamination, mixing.

Each stage takes what its predecessor kept, with the columns of ``documents``;
its decisions take effect; the last returns the mix.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermend.llm import decontam, language, mixing, neardup, phrases
from ledgermend.workspace import discard, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

MIN_LANGUAGE_SCORE = 0.5
#: Numbers of 8 bytes; a broadcast of so many takes some 50 MB.
MAX_BROADCAST_IDS = 2_000_000
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def shielded(stage: Stage) -> Stage:
    """``stage`` over documents whose further columns go under reserved names, so that they clash with none of its own."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in DOCUMENT else f"_further_{k}" for k, c in enumerate(docs.columns)]
        out = stage(spark, docs.toDF(*names), sf_dir)
        return out.toDF(*docs.columns) if out.columns == names else out

    return run


@shielded
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; lang becomes the predicted one.

    Rejected are texts without a letter (null and empty ones included), those whose best
    language has a posterior below ``MIN_LANGUAGE_SCORE``, and those whose n-grams are far less
    likely than those of that language's training texts.  Without any labelled text nothing can be told and all are rejected.
    """
    marked = docs.withColumn("_held_out", language.held_out(docs))
    model = language.fit(marked.where(~F.col("_held_out") & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang"))
    kept = language.identify(docs, model, docs.columns).where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE) & (F.col("oddness") <= 1.0))
    return kept.withColumn("lang", F.col("lang_pred")).select(docs.columns)


@shielded
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id.

    Several rows of that doc_id are one document, whatever their texts: the row with the least hash of
    all its columns stays, so reruns agree.  Rows with a null doc_id can't be told apart by it and stay.
    """
    each = neardup.near_duplicates(docs).where("doc_id is not null").groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("rows"))
    other = stored(each.where("not kept or rows > 1"), "copies")
    # What goes is the lesser part; while that is few numbers, the texts needn't be shuffled to find it.
    ids = other.select("doc_id")
    if ids.count() <= MAX_BROADCAST_IDS:
        ids = F.broadcast(ids)
    single = docs.join(ids, "doc_id", "left_anti")
    several = docs.join(other.where("kept").select("doc_id"), "doc_id", "left_semi")
    several = several.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row")).select("row.*")
    return single.select(docs.columns).unionByName(several.select(docs.columns))


@shielded
def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their recurring passages; a document of which nothing is left goes."""
    columns = [c for c in docs.columns if c not in ("text", "n_chars")]
    cut = phrases.remove_repeats(docs, columns, with_text=True).where("n_words > n_removed")
    named = cut.withColumn("text", F.col("kept_text"))
    if "n_chars" in docs.columns:
        named = named.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return named.select(docs.columns)


@shielded
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.decontaminate(docs, benchmark, docs.columns).where(~F.col("contaminated")).select(docs.columns)


@shielded
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: Language ID and sketches have no SQL form: tests/llm/test_pipeline.py holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)  # the table of the stage before; documents themselves stay
    return STAGES[-1][1](spark, docs, sf_dir)
