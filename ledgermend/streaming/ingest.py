"""Ingest with three tries: failed events come again in the next batches, and then go to the dead letters.

A batch's folders are named by its number and written whole, so a batch that is
replayed after a failure replaces what it wrote before and nothing is told twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

MAX_TRIES = 3


def _there(df: DataFrame, path: str) -> bool:
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def ingest_batch(events: DataFrame, batch: int, folder: str, attempt: Callable[[DataFrame], DataFrame], max_tries: int = MAX_TRIES) -> None:
    """One batch: its events and those that failed in the batch before, each tried once.

    ``attempt`` gives its rows with ``error``, null where the event was taken.  Under ``folder``, in ``batch=<number>``: ``ledger`` has the events taken,
    with ``tries``; ``pending`` those to be tried again; ``dead`` those that failed ``max_tries`` times, with the last error.
    """
    waiting = f"{folder}/pending/batch={batch - 1}"
    tried = events.withColumn("tries", F.lit(1))
    if _there(events, waiting):
        again = events.sparkSession.read.schema(tried.schema).parquet(waiting)
        tried = tried.unionByName(again.withColumn("tries", F.col("tries") + 1))
    told = f"{folder}/tried/batch={batch}"
    attempt(tried).write.mode("overwrite").parquet(told)  # once: the three tables below agree on what failed
    result = events.sparkSession.read.parquet(told)
    failed = F.col("error").isNotNull()
    for name, rows in (
        ("ledger", result.where(~failed).drop("error")), ("dead", result.where(failed & (F.col("tries") >= max_tries))), ("pending", result.where(failed & (F.col("tries") < max_tries)).drop("error")),
    ):
        rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")


def ingest(stream: DataFrame, folder: str, attempt: Callable[[DataFrame], DataFrame], max_tries: int = MAX_TRIES, **trigger) -> StreamingQuery:
    """A stream of events into ``folder``, whose checkpoint lies there too.  Failed events wait for the next batch, so a stream that ends has them in ``pending``."""
    writer = stream.writeStream.foreachBatch(lambda df, batch: ingest_batch(df, batch, folder, attempt, max_tries)).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(**trigger) if trigger else writer).start()
