"""Language identification.

Method: multinomial naive Bayes over hashed character n-grams (1 to 3 code
points of the lower-cased text).  The log-probability matrix, ``BINS`` rows by one
column per language, is broadcast: its size depends on the number of languages
alone and is checked.  Batches are scored in numpy by sparse lookups summed per
text.

The model is fitted on a documented sample: about ``FIT_ROWS`` labelled texts per
language, chosen by a hash of doc_id; repeated rows count as often as they stand.  Languages have no prior: how
many texts a language has doesn't bear on a prediction.  Counting and scoring are narrow; only
the counts (at most ``BINS`` per language) are shuffled.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermend.llm.tokens import ranges, tidy

BITS = 16
BINS = 1 << BITS
GRAMS = (1, 2, 3)
FIT_ROWS = 4000
SMOOTH = 0.5
MAX_MODEL_BYTES = 256 << 20
#: Arrays of eight bytes a character are made of a slice of texts, and so many texts leave Arrow at once.
SLICE_CHARS = 1 << 17
SLICE_ROWS = 256
UNKNOWN = "und"
#: What a text may lack in likelihood, in nats an n-gram: texts of its language with odd signs, and what chance does to n n-grams, times the root of n.
MARGIN = 1.5
NOISE = 30.0


def _parts(column: pa.Array):
    """A column's values, some rows at a time, with the number of the first."""
    for at in range(0, len(column), SLICE_ROWS):
        yield at, column.slice(at, SLICE_ROWS).to_pylist()


def _slices(texts: list[str | None]):
    """Consecutive texts of about SLICE_CHARS: the code points of all, lower-cased, and each text's first."""
    at = 0
    while at < len(texts):
        parts, size, start = [], 0, at
        while at < len(texts) and (not parts or size < SLICE_CHARS):
            parts.append((texts[at] or "").lower())
            size += len(parts[-1])
            at += 1
        points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        yield start, points, np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def gram_bins(points: np.ndarray, firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bin of each n-gram that lies inside one text, how many each text has, and where each starts."""
    counts = np.maximum(np.diff(firsts) - width + 1, 0)
    hashed = np.full(max(len(points) - width + 1, 0), width * 0x9E3779B1, np.uint64)
    for k in range(width):
        hashed = (hashed ^ points[k : k + len(hashed)]) * np.uint64(0xD6E8FEB86659FD93)
        hashed ^= hashed >> np.uint64(32)
    starts = ranges(firsts[:-1], counts)
    return (hashed[starts] >> np.uint64(64 - BITS)).astype(np.int32), counts, starts


_LETTERS: np.ndarray | None = None


def letter_table() -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _LETTERS


def _per_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of rows; an empty run sums to 0."""
    out = np.zeros((len(counts), *values.shape[1:]), np.float64)
    full = np.flatnonzero(counts)
    if len(full):
        out[full] = np.add.reduceat(values, (np.cumsum(counts) - counts)[full], axis=0, dtype=np.float64)
    return out


@tidy
def _counts(batches):
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for at, texts in _parts(batch.column(1)):
            for start, points, firsts in _slices(texts):
                for width in GRAMS:
                    bins, counts, _ = gram_bins(points, firsts, width)
                    stops = np.cumsum(counts)
                    for k, stop in enumerate(stops):
                        total = sums.setdefault(langs[at + start + k], np.zeros(BINS, np.int64))
                        np.add.at(total, bins[stop - counts[k] : stop], 1)
    for lang, total in sums.items():
        bins = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(bins), pa.string()), "bin": bins.astype(np.int32), "n": total[bins]})


@dataclass
class Model:
    langs: list[str]
    log_p: np.ndarray
    #: The mean log-probability of an n-gram of each language's training texts.
    usual: np.ndarray | None = None


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """From rows with doc_id, text and non-null lang; about ``fit_rows`` of each language are used."""
    sizes = {r["lang"]: r["n"] for r in labelled.where("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) * BINS * 4 > MAX_MODEL_BYTES:
        raise ValueError(f"{len(sizes)} languages make a matrix of more than {MAX_MODEL_BYTES} bytes")
    draw = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1).cast("long")), F.lit(17)), F.lit(1_000_000))
    wanted = F.lit(False)
    for lang, n in sorted(sizes.items()):
        wanted = wanted | ((F.col("lang") == lang) & (draw < int(1_000_000 * min(1.0, fit_rows / n)) + 1))
    sample = labelled.where(wanted & F.col("text").isNotNull()).select("lang", "text")
    rows = sample.mapInArrow(_counts, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(rows["lang"].to_pylist()))
    counts = np.zeros((BINS, len(langs)))
    place = {x: k for k, x in enumerate(langs)}
    np.add.at(counts, (rows["bin"].to_numpy(), np.array([place[x] for x in rows["lang"].to_pylist()], int)), rows["n"].to_numpy())
    counts += SMOOTH
    log_p = (np.log(counts) - np.log(counts.sum(axis=0))).astype(np.float32)
    seen = counts - SMOOTH
    return Model(langs, log_p, (seen * log_p).sum(axis=0) / np.maximum(seen.sum(axis=0), 1))


def text_scores(texts: list[str | None], log_p: np.ndarray):
    """Slices of (letters, log-probability in each language) of the texts, and (n-grams, log-probability) of their n-grams without a digit."""
    for _, points, firsts in _slices(texts):
        letters = _per_text(letter_table()[points].astype(np.int32), np.diff(firsts))
        total, numbers = (np.zeros((len(firsts) - 1, log_p.shape[1])) for _ in range(2))
        grams = np.zeros(len(firsts) - 1, np.int64)
        digit = np.cumsum(np.concatenate([[0], (points >= 48) & (points <= 57)]))
        for width in GRAMS:
            bins, counts, starts = gram_bins(points, firsts, width)
            for k in range(log_p.shape[1]):
                total[:, k] += _per_text(log_p[:, k][bins], counts)
            some = np.flatnonzero(digit[starts + width] > digit[starts])
            owner = np.searchsorted(firsts, starts[some], "right") - 1
            np.add.at(numbers, owner, log_p[bins[some]])
            grams += counts - np.bincount(owner, minlength=len(counts))
        yield letters, total, grams, total - numbers


def _scorer(shared, extra: list[str]):
    @tidy
    def score(batches):
        langs, log_p, usual = shared.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            best, sure, odd = [], [], []
            for letters, total, grams, plain in (scores for _, texts in _parts(column) for scores in text_scores(texts, log_p)):
                known = (letters > 0) & bool(langs)
                if not langs:
                    total = plain = np.zeros((len(grams), 1))
                top = total.argmax(axis=1)
                chance = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                best += [langs[k] if ok else UNKNOWN for k, ok in zip(top, known, strict=True)]
                sure += np.where(known, chance, 0.0).tolist()
                n = np.maximum(grams, 1)
                lack = usual[top] - plain[np.arange(len(n)), top] / n if usual is not None and langs else np.zeros(len(n))
                odd += np.where(known & (grams > 0), lack / (MARGIN + NOISE / np.sqrt(n)), 0.0).tolist()
            kept = {c: batch.column(batch.schema.get_field_index(c)) for c in extra}
            yield pa.RecordBatch.from_pydict(kept | {"lang_pred": pa.array(best, pa.string()), "score": pa.array(sure, pa.float64()), "oddness": pa.array(odd, pa.float64())})

    return score


def identify(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs``, with lang_pred, score (the model's posterior, 0 to 1) and oddness.

    Oddness is how much less likely the n-grams of a text without digits (which are of no language) are than those of the language's training texts, in terms of what is allowed:
    ``MARGIN`` nats an n-gram and ``NOISE`` over the root of their number.  Above 1 the text is of none of the languages.

    A null text, or one without a letter, is ``und`` with score 0; so is every
    text if the model learned no language.  Ties go to the first language in
    code point order.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.log_p, model.usual))
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    inputs = docs.select(*dict.fromkeys([*keep, "text"]))
    return inputs.mapInArrow(_scorer(shared, keep), f"{fields}, lang_pred string, score double, oddness double")


def held_out(docs: DataFrame) -> F.Column:
    """True for documents whose crc32(doc_id as text) mod 4 is 2; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    marked = docs.select("doc_id", "text", "lang", held_out(docs).alias("held_out"))
    model = fit(marked.where(~F.col("held_out") & F.col("doc_id").isNotNull()))
    return identify(marked.select("doc_id", "held_out", "text"), model, ["doc_id", "held_out"])


QUERIES = {"op3_language_id": op3}
