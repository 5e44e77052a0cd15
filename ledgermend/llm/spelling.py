"""Grouping spelling variants.

Method: blocked Gram matrices.  A word is its vector of letter counts; one
edited letter moves it by a squared distance of at most two, so a matrix product
of two blocks leaves few pairs, and those are compared letter by letter.

Blocks are words of one length whose counts of ``GROUPS`` groups of letters are
equal.  An edit changes the length by at most one and at most two of those counts
by one, so a block meets itself and its ``GROUPS (GROUPS + 1) / 2`` adjacent blocks,
and no pair is lost.  A block's number is linear in the counts, so adjacent ones are
at fixed distances; numbers that coincide (counts beyond 1,023) only cause
more comparisons.

Scale: words are counted with partial sums in each task.  Each distinct word is
sent to its block and the adjacent ones that exist; a block of more than about ``TILE_LETTERS``
letters is dealt to tiles by a hash, so no task holds an unbounded block, and
pairs leave a task only if they are near.  Forms raise a word's count
tenfold, so chains of forms are at most 19 long and five rounds of jumps settle roots.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermend.llm.tokens import ranges
from ledgermend.workspace import discard, stored

MIN_LETTERS = 7
MIN_COUNT = 2
TIMES = 10
EVERY = 31
GROUPS = 6
#: Letters in the order of their frequency in prose, dealt to the groups in turn; others by code point.
FREQUENT = "etaoinshrdlucmfwypvbgkjqxz"
BITS = 10
TILE_LETTERS = 40_000
MAX_TILED_BLOCKS = 2_000_000
MAX_COUNTED = 300_000
MATRIX_CELLS = 1 << 21
LETTERS = [*range(97, 123), *range(0xC0, 0x100)]

#: Latin-1 bytes: letters stay, A-Z become a-z, all else is a blank.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def group_of(letter: str) -> int:
    at = FREQUENT.find(letter)
    return (at if at >= 0 else ord(letter)) % GROUPS


def runs(text: str, doc_id: str) -> list[bytes]:
    """The words of a text in Latin-1, one letter less where the hash of document and run says so."""
    words = text.encode("latin-1", "replace").translate(TABLE).split()
    if not words:
        return words
    joined = b" ".join(words)
    utf8 = words if joined.isascii() else joined.decode("latin-1").encode().split(b" ")
    seed = zlib.crc32(f"{doc_id}:".encode())
    hashes = np.fromiter(map(zlib.crc32, utf8, repeat(seed)), np.int64, len(words))
    for k in np.flatnonzero(hashes % EVERY == 0).tolist():
        at = int(hashes[k]) % len(words[k])
        words[k] = words[k][:at] + words[k][at + 1 :]
    return words


def _count(batches):
    total: Counter[bytes] = Counter()

    def told():
        kept = [(w.decode("latin-1"), n) for w, n in total.items() if len(w) >= MIN_LETTERS]
        total.clear()
        return pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in kept], pa.string()), "n": pa.array([n for _, n in kept], pa.int64())})

    for batch in batches:
        # One text at a time: the column itself is no copy.
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if text.is_valid:
                total.update(runs(text.as_py(), doc_id))
                if len(total) > MAX_COUNTED:
                    yield told()
    yield told()


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, n``: words of at least ``MIN_LETTERS`` letters and ``MIN_COUNT`` occurrences in ``docs(doc_id, text)``."""
    named = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("doc_id"), "text")
    return named.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def block_of(word) -> F.Column:
    """The counts of the letter groups as one number, ``BITS`` bits each."""
    total = F.lit(0).cast("long")
    for g in range(GROUPS):
        own = "".join(chr(c) for c in LETTERS if group_of(chr(c)) == g)
        total = total + (F.length(word) - F.length(F.translate(word, own, ""))).cast("long") * (1 << BITS * g)
    return total


def steps() -> list[int]:
    """From a word's block to those it looks into: its own, one letter more, one letter of a group for one of a later group."""
    one = [1 << BITS * g for g in range(GROUPS)]
    return [0, *one, *(one[a] - one[b] for a in range(GROUPS) for b in range(a + 1, GROUPS))]


class Words:
    """Words of a block as letter counts and as padded rows of letters."""

    def __init__(self, words: list[bytes]) -> None:
        self.words = words
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.frombuffer(b"".join(words), np.uint8)
        owner = np.repeat(np.arange(len(words)), self.size)
        index = np.where(letters >= 0xC0, letters.astype(np.int64) - 0xC0 + 26, letters.astype(np.int64) - 97)
        counts = np.bincount(owner * len(LETTERS) + index, minlength=len(words) * len(LETTERS)).reshape(len(words), -1)
        # Products of counts below 2**10 are exact in single precision.
        self.counts = counts.astype(np.float32 if len(counts) and self.size.max() < 1024 else np.float64)
        self.norm = (self.counts * self.counts).sum(axis=1)
        self.rows = np.zeros((len(words), int(self.size.max(initial=0))), np.uint8)
        self.rows[owner, ranges(np.zeros(len(words), np.int64), self.size)] = letters


def near(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """Whether ``a[i]`` becomes ``b[j]`` by one inserted or replaced letter."""
    width = min(a.rows.shape[1], b.rows.shape[1])
    less = np.minimum(a.size[i], b.size[j])
    same = (a.rows[i, :width] == b.rows[j, :width]) & (np.arange(width) < less[:, None])
    replaced = (a.size[i] == b.size[j]) & (same.sum(axis=1) == less - 1)
    head = np.where(same.all(axis=1), width, same.argmin(axis=1)) if width else np.zeros(len(i), np.int64)
    out = replaced
    longer = np.flatnonzero(a.size[i] + 1 == b.size[j])
    if len(longer):
        i, j, less, head = i[longer], j[longer], less[longer], np.minimum(head[longer], less[longer])
        shifted = b.rows[j][:, 1 : width + 1]
        after = (a.rows[i, : shifted.shape[1]] == shifted) | (np.arange(shifted.shape[1]) < head[:, None]) | (np.arange(shifted.shape[1]) >= less[:, None])
        out[longer] = after.all(axis=1)
    return out


def pairs_of(targets: Words, probes: Words) -> tuple[np.ndarray, np.ndarray]:
    """``(probe, target)`` of the near pairs of two blocks, the probe no longer than the target."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    step = max(1, MATRIX_CELLS // max(len(targets.words), 1))
    few = max(1, MATRIX_CELLS // max(targets.rows.shape[1], 1))
    for lo in range(0, len(probes.words), step):
        some = slice(lo, lo + step)
        twice = 2 * (probes.counts[some] @ targets.counts.T)
        p, t = np.nonzero(probes.norm[some, None] + targets.norm[None, :] - twice <= 2)
        p += lo
        for at in range(0, len(p), few):
            ok = near(probes, p[at : at + few], targets, t[at : at + few])
            found.append((p[at : at + few][ok], t[at : at + few][ok]))
    p, t = zip(*found, strict=True)
    return np.concatenate(p), np.concatenate(t)


def _compare(batches):
    """Rows sorted by (block, tile, role): the words of a tile, then those that look into it."""
    key, held, counts, targets = None, [], [], None
    for batch in batches:
        block, tile, role, step = (np.array(batch.column(k)) for k in range(4))
        words = [w.encode("latin-1") for w in batch.column(4).to_pylist()]
        n = np.array(batch.column(5))
        cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(tile) != 0) | (np.diff(role) != 0)) + 1
        out = []
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if lo == hi:
                continue
            if key != (block[lo], tile[lo]):
                key, held, counts, targets = (block[lo], tile[lo]), [], [], None
            if role[lo] == 0:
                held += words[lo:hi]
                counts.append(n[lo:hi])
            elif held:
                if targets is None:
                    targets, numbers = Words(held), np.concatenate(counts)
                for at in range(lo, hi, 4096):
                    stop = min(at + 4096, hi)
                    p, t = pairs_of(targets, Words(words[at:stop]))
                    for a, b in zip((p + at).tolist(), t.tolist(), strict=True):
                        if step[a] or words[a] < held[b]:
                            out.append((words[a], int(n[a]), held[b], int(numbers[b])))
        if out:
            a, an, b, bn = zip(*out, strict=True)
            text = lambda x: pa.array([w.decode("latin-1") for w in x], pa.string())
            yield pa.RecordBatch.from_arrays([text(a), pa.array(an, pa.int64()), text(b), pa.array(bn, pa.int64())], ["a", "an", "b", "bn"])


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, an, b, bn``: each pair of ``words(word, n)`` that differs by one edit, once.  ``words`` is read twice, so store it."""
    placed = words.withColumn("block", block_of(F.col("word")))
    letters = placed.groupBy("block").agg(F.sum(F.length("word")).alias("letters"))
    # Blocks of several tiles are at most the letters of all words divided by TILE_LETTERS; the bound is checked.
    several = letters.where(F.col("letters") > TILE_LETTERS).select("block", F.ceil(F.col("letters") / TILE_LETTERS).cast("int").alias("tiles"))
    large = several.limit(MAX_TILED_BLOCKS + 1).toArrow()
    if large.num_rows <= MAX_TILED_BLOCKS:
        several = F.broadcast(words.sparkSession.createDataFrame(large.to_pandas(), several.schema))
    tiled = lambda rows: rows.join(several, "block", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    own = tiled(placed).select("block", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int").alias("tile"), F.lit(0).alias("role"), F.lit(0).cast("long").alias("step"), "word", "n")
    looks = placed.select(F.explode(F.array(*[F.lit(s).cast("long") for s in steps()])).alias("step"), "block", "word", "n")
    looks = tiled(looks.withColumn("block", F.col("block") + F.col("step")))
    looks = looks.select("block", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.lit(1).alias("role"), "step", "word", "n")
    dealt = own.unionByName(looks).repartition("block", "tile").sortWithinPartitions("block", "tile", "role")
    return dealt.mapInArrow(_compare, "a string, an long, b string, bn long")


def group(docs: DataFrame) -> DataFrame:
    """The words of ``docs(doc_id, text)`` with the forms that they vary.

    Returns word, form, root, n, n_near, form_n, one row per word.  Two words are near if one
    inserted, deleted or replaced code point makes one the other.  Form is the near word of largest n (ties:
    the smallest in code-point order) if its n is ``TIMES`` the word's at least.
    Null and empty texts have no words; a null doc_id counts as the text ``null``; repeated rows count as
    often as they stand.  An empty table gives no rows; other columns are not read.
    """
    words = stored(vocabulary(docs), "spelling-words")
    pairs = near_pairs(words)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("bn").alias("other_n"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("an").alias("other_n")))
    both = stored(both, "spelling-near")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    rated = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.other").alias("other"), (-F.col("best.less")).alias("other_n"))
    enough = F.col("other_n") >= TIMES * F.col("n")
    rated = stored(rated.select("word", F.when(enough, F.col("other")).alias("form"), "n", "n_near", F.when(enough, F.col("other_n")).alias("form_n")), "spelling-forms")
    discard(words, both)
    hops = written = stored(rated.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = hops.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = stored(hops.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        moved = not jumped.where("moved").isEmpty()
        discard(written)
        written, hops = jumped, jumped.select("word", "root")
        if not moved:  # each round doubles what it jumps over, and a chain is at most 19 long
            return rated.join(hops, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op13_spelling_variants": op13}
