"""Exchanges between blocks of documents and shards of keys.

Questions such as "does this key occur anywhere else" are answered in two
shuffles of packed arrays instead of rows: every block sends each shard the
distinct keys that hash there, the shard compares what all blocks sent, and
answers each block.  A key that a third of all documents hold is sent once per
batch of a block, so no shard grows with the number of its occurrences.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ledgermend.llm.tokens import give_back, tidy
from ledgermend.workspace import partitions

#: A block of documents is held by one task.
BLOCK_BYTES = 32 << 20
#: So many blocks have numbers of two bytes.
NARROW = 65_535
#: kind says what the arrays of a row are.
MAIL = "kind int, shard int, block int, a binary, b binary, c binary"


def shards(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """How many blocks (and shards) ``docs(text)`` is dealt to: about ``block_bytes`` of text each, whatever the table's size."""
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(partitions(docs.sparkSession), -(-total // block_bytes))


def in_blocks(docs: DataFrame, keep: Iterable[str], n: int) -> DataFrame:
    """Documents with their block of ``n``: the columns ``keep`` and text.  Rows of one doc_id are spread by text; only equal rows share a block."""
    return docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("block"), *dict.fromkeys([*keep, "text"]))


def to_shards(mail: DataFrame, n: int, fn: Callable[[int, list], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``fn(shard, rows)`` for each of ``n`` shards; rows are (kind, block, a, b, c) and answers are mail again."""

    @tidy
    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for kind, shard, block, a, b, c in zip(*columns, strict=True):
                held.setdefault(shard, []).append((kind, block, a, b, c))
        for shard in sorted(held):
            yield from fn(shard, held.pop(shard))

    return mail.repartitionById(n, F.col("shard")).mapInArrow(run, MAIL)


def to_blocks(answers: DataFrame, placed: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``fn(block, mail rows, batches of documents)`` for each block; its record batches follow ``schema``.

    Documents and mail have an exchange each, so calls with the same ``placed`` in one
    plan share the documents' exchange.  A block and its mail are held in memory.
    """
    columns = [c for c in placed.columns if c != "block"]
    wanted = to_arrow_schema(StructType.fromDDL(schema))

    def run(key, docs: pa.Table, mail: pa.Table) -> pa.Table:
        letters = list(zip(*(mail.column(c).to_pylist() for c in ("kind", "shard", "a", "b", "c")), strict=True))
        made = fn(key[0].as_py(), letters, iter(docs.select(columns).to_batches()))
        told = pa.Table.from_batches([b.select(wanted.names).cast(wanted) for b in made], wanted)
        del letters
        give_back()
        return told

    return placed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def pack(kind: int, shard: np.ndarray, block: np.ndarray | int, arrays: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Mail of equal-length arrays; rows must be sorted by (block, shard), and one letter goes to each pair."""
    if not len(shard):
        return
    blocks = np.broadcast_to(np.asarray(block), shard.shape)
    cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(blocks) != 0)) + 1
    lo, hi = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(shard)]])
    columns = []
    for x in arrays:
        raw, width = np.ascontiguousarray(x).view(np.uint8), x.dtype.itemsize
        offsets = np.concatenate([lo, hi[-1:]]) * width
        columns.append(pa.Array.from_buffers(pa.large_binary(), len(lo), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())]).cast(pa.binary()))
    columns += [pa.nulls(len(lo), pa.binary())] * (3 - len(arrays))
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(lo), kind, np.int32)), pa.array(shard[lo].astype(np.int32)), pa.array(blocks[lo].astype(np.int32)), *columns], ["kind", "shard", "block", "a", "b", "c"])


def unpack(rows: list, which: int, dtype) -> tuple[np.ndarray, np.ndarray]:
    """One array of all rows joined, and each row's length."""
    parts = [np.frombuffer(r[which], dtype) for r in rows]
    return (np.concatenate(parts) if parts else np.zeros(0, dtype)), np.array([len(p) for p in parts], np.int64)


# -- keys that occur more than once -------------------------------------------------

KEYS, COMMON = 1, 2


def tally(keys: list[np.ndarray], blocks: list[np.ndarray], n: int, kind: int = KEYS) -> Iterator[pa.RecordBatch]:
    """Mail of distinct 64-bit keys as 32 bits within a shard, with how often each occurs (255 at most) and its block.

    One letter goes to each shard, whatever the number of blocks.
    """
    if not keys:
        return
    key, block = np.concatenate(keys), np.concatenate(blocks)
    shard, low = (key >> np.uint64(32)) % np.uint64(n), key & np.uint64(0xFFFFFFFF)
    del key
    if n <= NARROW:  # shard, block and key fit into one number, which sorts in half the memory
        packed, counts = np.unique(((shard * np.uint64(n) + block.astype(np.uint64)) << np.uint64(32)) | low, return_counts=True)
        low, packed = packed.astype(np.uint32), packed >> np.uint64(32)
        shard, block = packed // np.uint64(n), (packed % np.uint64(n)).astype(np.uint16)
    else:
        by = np.lexsort((low, block, shard))
        shard, block, low = shard[by], block[by].astype(np.uint32), low[by].astype(np.uint32)
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (block[1:] != block[:-1]) | (shard[1:] != shard[:-1])
        at = np.flatnonzero(new)
        counts = np.diff(np.append(at, len(low)))
        shard, block, low = shard[at], block[at], low[at]
    yield from pack(kind, shard, 0, [low, np.minimum(counts, 255).astype(np.uint8), block])


def _block_type(rows: list):
    """Blocks are of two bytes or four, by how many there are."""
    return np.uint32 if rows and len(rows[0][4]) == 4 * len(rows[0][3]) else np.uint16


def common_keys(shard: int, rows: list, kind: int = COMMON, many: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Answers: to each block those of its keys that occur more than once anywhere, and whether over ``many`` times."""
    keys, counts, blocks = unpack(rows, 2, np.uint32)[0], unpack(rows, 3, np.uint8)[0], unpack(rows, 4, _block_type(rows))[0].astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts, blocks = keys[order], counts[order], blocks[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    total = np.add.reduceat(counts.astype(np.int64), starts) if len(keys) else counts
    total = np.repeat(total, np.diff(np.concatenate([starts, [len(keys)]])))
    keep = total > 1
    keys, blocks, hot = keys[keep], blocks[keep], (total[keep] > many).astype(np.uint8)
    order = np.argsort(blocks, kind="stable")
    yield from pack(kind, np.full(len(keys), shard), blocks[order], [keys[order], hot[order]])


class Common:
    """The answers that a block got: which of its keys occur more than once."""

    def __init__(self, letters: list, n: int, kind: int = COMMON):
        mine = [r for r in letters if r[0] == kind]
        keys, sizes = unpack(mine, 2, np.uint32)
        hot, _ = unpack(mine, 3, np.uint8)
        full = (np.repeat(np.array([r[1] for r in mine], np.uint64), sizes) << np.uint64(32)) | keys
        order = np.argsort(full)
        self.n, self.keys, self.hot = np.uint64(n), full[order], hot[order]

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is common, and whether it is hot."""
        full = (((key >> np.uint64(32)) % self.n) << np.uint64(32)) | (key & np.uint64(0xFFFFFFFF))
        if not len(self.keys):
            none = np.zeros(len(key), bool)
            return none, none
        at = np.minimum(np.searchsorted(self.keys, full), len(self.keys) - 1)
        known = self.keys[at] == full
        return known, known & (self.hot[at] > 0)


def member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array."""
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values
