"""Approximate nearest neighbours by cosine.

Method: an inverted file of coarse centroids with product-quantised residuals.
A query probes the cells whose centroids are nearest, ranks their vectors by
asymmetric distance tables, and the best are ranked again by the exact cosine of
the original vectors.  A vector is left out of that only where its code can't be
near enough: the length of what its code misses bounds the error of the tables, so
crowds of almost equal vectors, which share their codes, lose no neighbour.

Centroids and codebooks are fitted on at most about ``FIT_ROWS`` vectors chosen
by a hash; every vector is indexed.  How many cells a query probes is measured: about
``CALIBRATION`` queries are answered by brute force in one pass over the vectors.  Vectors are dealt by (cell, part) and queries
by (cell, part) too, with as many parts as keep both sides of a cell below
``PART_ROWS`` vectors and ``PART_QUERIES`` queries on average, so neither a crowded
cell nor many queries meet in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIT_ROWS = 16_384
MAX_CELLS = 1024
#: So many queries are answered by brute force to see how many cells the true neighbours need.
CALIBRATION = 256
#: Of the true neighbours so many lie in the probed cells.
COVERED = 0.97
MIN_PROBES = 4
SUBSPACES = 16
CODES = 256
#: A query probes cells that hold at least so many ids.
ENOUGH = 40
#: Far above the rounding of a cosine.
ROUNDING = 1e-9
PART_ROWS = 4096
PART_QUERIES = 1024


def usable(embedding: str = "embedding") -> F.Column:
    """Neither null nor zero, all components finite."""
    e = F.col(embedding)
    odd = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return e.isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.exists(e, lambda x: x != 0)


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by the power of two below their largest component: no bit of a cosine changes, and no square over- or underflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's algorithm from distinct rows; empty centres keep their place."""
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.permutation(len(distinct))[: min(k, len(distinct))]].copy()
    for _ in range(rounds):
        owner = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, x)
        counts = np.bincount(owner, minlength=len(centres))
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def fit(sample: np.ndarray, rows: int, seed: int = 7) -> tuple[np.ndarray, list[np.ndarray]]:
    """Coarse centroids (about the square root of the number of rows) and a codebook for each subspace."""
    rng = np.random.default_rng(seed)
    x = unit(sample)
    centres = k_means(x, int(min(MAX_CELLS, max(1, round(rows**0.5)), len(x))), 8, rng)
    rest = x - centres[nearest(x, centres)]
    parts = np.array_split(np.arange(x.shape[1]), min(SUBSPACES, x.shape[1]))
    return centres, [k_means(rest[:, p], CODES, 6, rng) for p in parts]


def _coder(shared):
    def run(batches):
        centres, books, _ = shared.value
        parts = np.array_split(np.arange(centres.shape[1]), len(books))
        for batch in batches:
            x = unit(matrix(batch.column(1)))
            cell = nearest(x, centres)
            rest = x - centres[cell]
            codes = np.stack([nearest(rest[:, p], b) for p, b in zip(parts, books, strict=True)], axis=1).astype(np.uint8)
            for k, (p, b) in enumerate(zip(parts, books, strict=True)):
                rest[:, p] -= b[codes[:, k]]
            missed = np.sqrt((rest * rest).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.list_(pa.float64())), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(missed)], ["vec_id", "embedding", "cell", "codes", "missed"])

    return run


def cell_order(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """For each vector the cells from the nearest on."""
    return np.argsort((centres * centres).sum(axis=1) - 2 * (x @ centres.T), axis=1, kind="stable")


def _true_neighbours(shared, top: int):
    """The nearest of a task's vectors to each calibrating query, with their cells."""

    def run(batches):
        q_ids, q, centres = shared.value
        best = [np.zeros(0)] * len(q_ids), [np.zeros(0, np.int64)] * len(q_ids)
        for batch in batches:
            ids, x = np.array(batch.column(0)), unit(matrix(batch.column(1)))
            for lo in range(0, len(ids), PART_ROWS):
                near = q @ x[lo : lo + PART_ROWS].T
                near[q_ids[:, None] == ids[None, lo : lo + PART_ROWS]] = -np.inf
                cells = nearest(x[lo : lo + PART_ROWS], centres)
                pick = np.argpartition(-near, min(top, near.shape[1]) - 1, axis=1)[:, :top]
                for k in range(len(q_ids)):
                    both = np.concatenate([best[0][k], near[k, pick[k]]]), np.concatenate([best[1][k], cells[pick[k]]])
                    order = np.argsort(-both[0], kind="stable")[:top]
                    best[0][k], best[1][k] = both[0][order], both[1][order]
        number = np.repeat(np.arange(len(q_ids)), [len(x) for x in best[0]])
        yield pa.RecordBatch.from_pydict({"query": number, "near": np.concatenate(best[0]), "cell": np.concatenate(best[1]).astype(np.int64)})

    return run


def probes_needed(good: DataFrame, rows: int, centres: np.ndarray, top: int) -> int:
    """How many cells a query probes so that ``COVERED`` of the true neighbours of about ``CALIBRATION`` queries lie in them.

    Structured vectors need few cells; vectors without any structure, the hardest case, most of them.
    """
    asking = good.where("asks")
    n = asking.count()
    draw = F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(1_000_000))
    sample = asking.where(draw < int(1_000_000 * min(1.0, CALIBRATION / max(n, 1))) + 1).select("vec_id", "embedding").limit(4 * CALIBRATION).toArrow().combine_chunks()
    if not len(sample) or len(centres) <= MIN_PROBES:
        return len(centres)
    q = unit(matrix(sample["embedding"].combine_chunks()))
    shared = good.sparkSession.sparkContext.broadcast((sample["vec_id"].to_numpy(), q, centres))
    found = good.select("vec_id", "embedding").mapInArrow(_true_neighbours(shared, top), "query long, near double, cell long").where("near > double('-inf')")
    best = Window.partitionBy("query").orderBy(F.col("near").desc())
    true = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= top).select("query", "cell").toArrow()  # top rows a calibrating query
    place = np.argsort(cell_order(q, centres), axis=1)[true["query"].to_numpy(), true["cell"].to_numpy()]
    return int(max(MIN_PROBES, np.quantile(place, COVERED, method="higher") + 1)) if len(place) else len(centres)


def _prober(shared):
    def run(batches):
        centres, held, probes = shared.value
        for batch in batches:
            order = cell_order(unit(matrix(batch.column(1))), centres)
            # Further cells where the nearest ones hold too few vectors.
            enough = (np.cumsum(held[order], axis=1) < ENOUGH).sum(axis=1) + 1
            order = [o[: max(probes, n)].tolist() for o, n in zip(order, enough.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.list_(pa.float64())), pa.array(order, pa.list_(pa.int32()))], ["vec_id", "embedding", "cells"])

    return run


def best_of(queries: tuple, rows: tuple, shared: tuple, top: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per query: ids and exact cosines of its ``top`` among these rows, after the shortlist by distance tables.

    A table is off by at most what a vector's code misses, so the shortlist holds whatever may be among the ``top``.
    """
    centres, books, _ = shared
    q_ids, q_raw = queries
    ids, raw, codes, missed, cell = rows
    order = np.argsort(ids, kind="stable")
    ids, raw, codes, missed = ids[order], raw[order], codes[order], missed[order] + ROUNDING
    starts = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))
    q, raw, q_raw = unit(q_raw), scaled(raw), scaled(q_raw)
    parts = np.array_split(np.arange(centres.shape[1]), len(books))
    near = np.repeat((q @ centres[cell])[:, None], len(ids), axis=1)
    for k, (p, book) in enumerate(zip(parts, books, strict=True)):
        near += (q[:, p] @ book.T)[:, codes[:, k]]
    norm, q_norm = np.sqrt((raw * raw).sum(axis=1)), np.sqrt((q_raw * q_raw).sum(axis=1))
    out = []
    for k in range(len(q_ids)):
        approximate = np.where(ids == q_ids[k], -np.inf, near[k])
        # The least cosine that each id surely has; whatever can't reach the top-th of them is out.
        sure = np.maximum.reduceat(approximate - missed, starts)
        bar = np.partition(sure, len(sure) - top)[len(sure) - top] if len(sure) > top else -np.inf
        short = np.flatnonzero((approximate + missed >= bar) & (ids != q_ids[k]))
        if len(short) > len(ids) / 4:
            cosine = (raw @ q_raw[k])[short] / (norm[short] * q_norm[k])
        else:
            cosine = raw[short] @ q_raw[k] / (norm[short] * q_norm[k])
        pick = np.lexsort((ids[short], -cosine))
        # Several vectors of one id are one candidate, with the best of their scores.
        pick = pick[np.sort(np.unique(ids[short][pick], return_index=True)[1])][:top]
        out.append((np.full(len(pick), q_ids[k]), ids[short][pick], cosine[pick]))
    return out


def _searcher(shared, top: int):
    """Streams rows sorted by (cell, part), queries before vectors."""

    def run(batches):
        held: dict = {"key": None, "q": [], "v": []}

        def flush():
            if held["q"] and held["v"]:
                join = lambda k, x: np.concatenate([y[k] for y in x])
                q, v = held["q"], held["v"]
                found = best_of((join(0, q), join(1, q)), (join(0, v), join(1, v), join(2, v), join(3, v), held["key"][0]), shared.value, top)
                a, b, c = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c)], ["query_id", "vec_id", "score"])
            held["v"] = []

        for batch in batches:
            cell, part, kind = (np.array(batch.column(k)) for k in range(3))
            cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if lo == hi:
                    continue
                key = (int(cell[lo]), int(part[lo]))
                if key != held["key"]:
                    yield from flush()
                    held |= {"key": key, "q": [], "v": []}
                rows = batch.slice(lo, hi - lo)
                ids, raw = np.array(rows.column(3)), matrix(rows.column(4))
                if kind[lo] == 0:
                    held["q"].append((ids, raw))
                elif held["q"]:
                    codes = np.frombuffer(b"".join(rows.column(5).to_pylist()), np.uint8).reshape(len(ids), -1)
                    held["v"].append((ids, raw, codes, rows.column(6).to_numpy()))
                    if sum(len(x[0]) for x in held["v"]) >= 4 * PART_ROWS:
                        yield from flush()
        yield from flush()

    return run


def search(vectors: DataFrame, queries: F.Column, top: int = 5) -> DataFrame:
    """The ``top`` nearest other rows of each row of ``vectors(vec_id, embedding)`` for which ``queries`` holds.

    Returns query_id, rank (from 1), vec_id, score (exact cosine in double
    precision), nearest first, ties to the smaller vec_id.  Vectors that are null,
    zero, not finite, of another length than the most common one, or without
    vec_id take no part.  A row is no candidate of a query with its vec_id.  Repeated
    rows count once; different vectors under one vec_id are one query or one candidate,
    with the best score of any pair.  An empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    empty = "query_id long, rank int, vec_id long, score double"
    good = vectors.where(usable() & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.coalesce(queries, F.lit(False)).alias("asks")).distinct()
    sizes = good.groupBy(F.size("embedding").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "size").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], empty)
    size, rows = sizes[0]["size"], sizes[0]["n"]
    good = good.where(F.size("embedding") == size)
    draw = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1_000_000))
    sample = good.where(draw < int(1_000_000 * min(1.0, FIT_ROWS / rows)) + 1).select("embedding").toArrow().combine_chunks()
    if not len(sample):
        sample = good.select("embedding").limit(1).toArrow().combine_chunks()
    centres, books = fit(matrix(sample["embedding"].combine_chunks()), rows)
    probes = min(len(centres), probes_needed(good, rows, centres, top))
    shared = spark.sparkContext.broadcast((centres, books, probes))

    index = good.select("vec_id", "embedding").mapInArrow(_coder(shared), "vec_id long, embedding array<double>, cell int, codes binary, missed double")
    # At most MAX_CELLS rows each: how many ids and vectors a cell holds, and how many parts its vectors and its queries take.
    counts = index.groupBy("cell", "vec_id").agg(F.count(F.lit(1)).alias("n")).groupBy("cell").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("ids")).collect()
    v_parts = {r["cell"]: -(-r["n"] // PART_ROWS) for r in counts}
    held = np.zeros(len(centres), np.int64)
    for r in counts:
        held[r["cell"]] = r["ids"]
    probing = spark.sparkContext.broadcast((centres, held, probes))
    asked = good.where("asks").select("vec_id", "embedding").mapInArrow(_prober(probing), "vec_id long, embedding array<double>, cells array<int>")
    asked = asked.select("vec_id", "embedding", F.explode("cells").alias("cell"))
    q_parts = {r["cell"]: -(-r["n"] // PART_QUERIES) for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    listed = lambda parts: F.array(*[F.lit(parts.get(c, 1)) for c in range(len(centres))])
    v_n, q_n = F.element_at(listed(v_parts), F.col("cell") + 1), F.element_at(listed(q_parts), F.col("cell") + 1)
    own = lambda n: F.pmod(F.xxhash64("vec_id"), n).cast("int")
    v_rows = index.select("cell", F.explode(F.transform(F.sequence(F.lit(0), q_n - 1), lambda k: own(v_n) * q_n + k)).alias("part"), F.lit(1).alias("kind"), "vec_id", "embedding", "codes", "missed")
    q_rows = asked.select("cell", F.explode(F.transform(F.sequence(F.lit(0), v_n - 1), lambda k: k * q_n + own(q_n))).alias("part"), F.lit(0).alias("kind"), "vec_id", "embedding", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("missed"))
    dealt = q_rows.unionByName(v_rows).repartition("cell", "part").sortWithinPartitions("cell", "part", "kind")
    found = dealt.mapInArrow(_searcher(shared, top), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, F.col("vec_id") % 50 == 0)


QUERIES = {"op6_nearest": op6}
