"""Toxicity scores.

Method: a weighted lexicon matched by an Aho-Corasick automaton over text whose
homoglyphs and digit substitutions are folded, normalised by length, with
exception phrases that cancel a match.

The lexicon is learned from labelled rows: whole words and word beginnings that
occur far more often in toxic texts, each judged by itself: a word stays however
many of its texts hold other words of the lexicon.  Equal toxic texts have one vote,
so the words of a text with many copies are not learned from the copies.  Phrases of a lexicon word and its neighbour that only clean texts use become
exceptions.  A logistic function of weighted hits and of hits by length is then
fitted.  All fitting uses about ``FIT_ROWS`` labelled rows, chosen by a hash of
doc_id; scoring is one narrow pass over all texts.  The model is bounded by that
sample: a term stands in ``MIN_DOCS`` different toxic texts of it, an exception in ``MIN_CLEAN`` clean ones.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIT_ROWS = 20_000
MIN_DOCS = 5
MIN_CLEAN = 3
MIN_LOG_ODDS = 3.0
BEGINNINGS = (4, 5, 6, 7)
MAX_BROADCAST_LABELS = 200_000

# Characters that look like Latin letters (Cyrillic and Greek), and digits or signs that stand for one.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "ε": "e", "ι": "i",
    "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ɡ": "g", "ı": "i",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
INVISIBLE = ("​", "‌", "‍", "⁠", "﻿", "­")
_FOLD = str.maketrans(HOMOGLYPHS | DIGITS | dict.fromkeys(INVISIBLE, ""))
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """Lower case, look-alikes and digit substitutions as letters, invisible characters gone."""
    return text.lower().translate(_FOLD)


@dataclass
class Model:
    terms: dict[str, float] = field(default_factory=dict)  # "word " is a whole word, "begin" a beginning
    exceptions: set[str] = field(default_factory=set)
    weights: tuple[float, float, float] = (-3.0, 1.0, 1.0)


def automaton(terms: dict[str, float]):
    found: dict[str, list] = {}
    for term, weight in terms.items():
        found.setdefault(term.strip(), []).append((weight, term.endswith(" ")))
    built = ahocorasick.Automaton()
    for key, values in found.items():
        built.add_word(key, (len(key), values))
    built.make_automaton()
    return built


def matches(folded: str, built):
    """``(weight, start, end)`` of each lexicon word in the text, the whole word as span."""
    if not len(built):
        return
    best: dict[int, tuple[float, int]] = {}
    for last, (size, values) in built.iter(folded):
        start = last - size + 1
        if start and folded[start - 1].isalpha():
            continue
        whole = last + 1 == len(folded) or not folded[last + 1].isalpha()
        for weight, closed in values:
            if (whole or not closed) and weight > best.get(start, (0.0, 0))[0]:
                best[start] = (weight, last + 1)
    for start, (weight, end) in best.items():
        while end < len(folded) and folded[end].isalpha():
            end += 1
        yield weight, start, end


def phrases(folded: str, start: int, end: int) -> list[str]:
    """The matched word with the word before it, and with the word after it."""
    before = _WORD.findall(folded[max(0, start - 40) : start])
    after = _WORD.search(folded[end : end + 40])
    word = folded[start:end]
    return ([f"{before[-1]} {word}"] if before else []) + ([f"{word} {after[0]}"] if after else [])


def measures(text: str | None, built, exceptions: set[str]) -> tuple[float, float]:
    """Weighted hits on a log scale, and weighted hits in a thousand characters on a log scale."""
    folded = fold(text or "")
    hits = 0.0
    for weight, start, end in matches(folded, built):
        if exceptions and any(p in exceptions for p in phrases(folded, start, end)):
            continue
        hits += weight
    return math.log1p(hits), math.log1p(1000.0 * hits / max(200, len(folded)))


def _features(batches):
    toxic: dict[str, set[int]] = {}
    clean: Counter[str] = Counter()
    for batch in batches:
        for vote, label, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            words = set(_WORD.findall(fold(text or "")))
            found = {w + " " for w in words if len(w) > 2} | {w[:n] for w in words for n in BEGINNINGS if len(w) > n}
            if label:
                for x in found:
                    toxic.setdefault(x, set()).add(vote)
            else:
                clean.update(found)
    names = list(toxic.keys() | clean.keys())
    for k in range(0, len(names), 20_000):
        part = names[k : k + 20_000]
        yield pa.RecordBatch.from_pydict({"term": pa.array(part, pa.string()), "votes": pa.array([list(toxic.get(x, ())) for x in part], pa.list_(pa.int64())), "clean": pa.array([clean.get(x, 0) for x in part], pa.int64())})


def _contexts(terms):
    def run(batches):
        built = automaton(terms)
        for batch in batches:
            rows = Counter()
            for label, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                folded = fold(text or "")
                seen = {p for _, s, e in matches(folded, built) for p in phrases(folded, s, e)}
                rows.update((p, label) for p in seen)
            yield pa.RecordBatch.from_pydict({"phrase": pa.array([p for p, _ in rows], pa.string()), "toxic": pa.array([int(x) for _, x in rows], pa.int32()), "n": pa.array(list(rows.values()), pa.int64())})

    return run


def _measured(model):
    def run(batches):
        built = automaton(model.terms)
        for batch in batches:
            got = [measures(t, built, model.exceptions) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_pydict({"toxic": batch.column(1).cast(pa.int32()), "a": pa.array([x for x, _ in got], pa.float64()), "b": pa.array([x for _, x in got], pa.float64())})

    return run


def choose_terms(candidates: list[tuple[str, float]]) -> dict[str, float]:
    """All candidates but those that decide nothing: wherever they match, a beginning of theirs matches with no less weight."""
    found = dict(candidates)

    def shadowed(term: str, weight: float) -> bool:
        word = term.strip()
        return any(found.get(word[:n], -math.inf) >= weight for n in BEGINNINGS if n < len(word))

    return {term: weight for term, weight in candidates if not shadowed(term, weight)}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps; the first column of ``x`` is the constant."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def fit(labelled: DataFrame) -> Model:
    """From a bounded table of doc_id, toxic and text."""
    vote = F.xxhash64("text")
    totals = {r["toxic"]: r for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(vote).alias("votes")).collect()}
    bad, good = totals[1]["votes"] if 1 in totals else 0, totals[0]["n"] if 0 in totals else 0
    if not bad or not good:
        return Model(weights=(-1.0 if good else 0.0, 0.0, 0.0))
    parts = labelled.select(vote, "toxic", "text").mapInArrow(_features, "term string, votes array<long>, clean long")
    summed = parts.groupBy("term").agg(F.size(F.array_distinct(F.flatten(F.collect_list("votes")))).alias("votes"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("votes") + 0.5) / (bad + 1.0)) - F.log((F.col("clean") + 0.5) / (good + 1.0))
    useful = summed.where(F.col("votes") >= MIN_DOCS).withColumn("weight", odds).where(F.col("weight") >= MIN_LOG_ODDS)
    model = Model(choose_terms([(r["term"], r["weight"]) for r in useful.select("term", "weight").orderBy("term").collect()]))
    seen = labelled.select("doc_id", "toxic", "text").mapInArrow(_contexts(model.terms), "phrase string, toxic int, n long")
    only_clean = seen.groupBy("phrase").agg(F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("clean"), F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"))
    only_clean = only_clean.where((F.col("clean") >= MIN_CLEAN) & (F.col("bad") == 0))
    model.exceptions = {r["phrase"] for r in only_clean.collect()}
    rows = labelled.select("doc_id", "toxic", "text").mapInArrow(_measured(model), "toxic int, a double, b double").toArrow()
    x = np.column_stack([np.ones(len(rows)), rows["a"].to_numpy(), rows["b"].to_numpy()])
    model.weights = logistic(x, rows["toxic"].to_numpy().astype(float))
    return model


def _scorer(shared, keep: list[str]):
    def run(batches):
        terms, exceptions, weights = shared.value
        built = automaton(terms)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            got = np.array([measures(t.as_py(), built, exceptions) for t in texts]).reshape(-1, 2)
            z = weights[0] + got @ np.array(weights[1:])
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            kept = {c: batch.column(batch.schema.get_field_index(c)) for c in keep}
            yield pa.RecordBatch.from_pydict(kept | {"score": score, "predicted": (score >= 0.5).astype(np.int32)})

    return run


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep``, with score (0 to 1) and predicted, for every row, repeated ones included.

    A null or empty text scores as one without hits; an even score of 0.5 is predicted as 1.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.terms, model.exceptions, model.weights))
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(_scorer(shared, keep), f"{fields}, score double, predicted int")


def training_rows(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """About ``fit_rows`` labelled texts outside the held-out fifth: doc_id, toxic, text.

    Rows of ``labels`` with a null doc_id or label are left out; of repeated
    labels the highest counts, and of several rows of a document the text with the least hash.
    """
    usable = labels.where("doc_id is not null and toxic is not null").where(~held_out())
    total = usable.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1_000_000))
    drawn = usable.where(draw < int(1_000_000 * min(1.0, fit_rows / max(total, 1))) + 1)
    drawn = drawn.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    if fit_rows <= MAX_BROADCAST_LABELS:  # the sample's size is bounded, whatever the tables hold
        drawn = F.broadcast(drawn)
    found = docs.select("doc_id", "text").join(drawn, "doc_id")
    return found.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def held_out() -> F.Column:
    """True where crc32(doc_id as text) mod 5 is 0; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgermend.workspace import stored

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(stored(training_rows(docs, labels), "toxic-fit"))
    return score(docs.select("doc_id", held_out().alias("held_out"), "text"), model, ["doc_id", "held_out"])


QUERIES = {"op10_toxicity": op10}
