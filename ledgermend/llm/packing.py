"""Packing documents into training sequences.

Method: harmonic packing.  Class k holds the pieces that fill a k-th of the
capacity, so a bin of the class closes when it holds exactly k of them, whatever
they are.  No bin asks about another, so every task fills its own: one narrow
pass, no shuffle, and what a task holds open is less than one bin of each class.

A document may be cut, so its ids are divided into the largest pieces that some
class takes whole: whole sequences first, then the rest by decreasing class
size.  With the default classes (halves, quarters, ... of a capacity that is a
power of two) every bin is full.  What a task has open at its end is laid end to end by class
and cut at powers of two, lengths that need no padding.  Other classes are
allowed (``counts``): fewer cuts, and at most k - 1 ids of padding a bin.

Ids come from a vocabulary file of the tokenizers library.  Its tokens never
reach across white space, so a text asks the library only for words that the task
hasn't seen; it remembers a bounded number of them.
"""

from __future__ import annotations

import os
import re
import struct

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermend.llm.tokens import slices

CAPACITY = 2048
END_ID = 1
#: A task numbers its sequences from its partition's number times this.
SEQUENCES_A_TASK = 1 << 33
#: A task remembers so many words and then starts anew.
MAX_WORDS = 600_000
#: Longer words aren't remembered.
MAX_WORD_BYTES = 256
MAX_VOCABULARY_BYTES = 64 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Letters that composition and the library's patterns leave alone, and words of them with marks behind.
PLAIN_LETTERS = "".join(chr(c) for c in (*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100)))
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


class Encoder(dict):
    """Words (UTF-8) and the bytes of their ids; a word that isn't known is asked of the library."""

    def __init__(self, vocabulary: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.model = self.tokenizer.model
        # How the library writes a letter's bytes for its model.
        self.written = {ord(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in PLAIN_LETTERS}

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if plain := PLAIN.fullmatch(text):
            # The library's own pieces of such a word are the letters and the marks: its model takes them as they are.
            letters, marks = plain[1].lower(), plain[2]
            ids = [t.id for t in self.model.tokenize(letters if letters.isascii() else letters.translate(self.written))]
            if marks:
                ids += [t.id for t in self.model.tokenize(marks)]
        else:
            ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        found = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= MAX_WORD_BYTES:
            self[word] = found
        return found

    def encode(self, text: bytes) -> bytes:
        """Ids of a UTF-8 text.  Only ASCII texts are lower-cased here: composition comes before case in others."""
        if len(self) > MAX_WORDS:
            self.clear()
        return b"".join(map(self.__getitem__, (text.translate(_LOWER) if text.isascii() else text).split()))


def class_sizes(capacity: int, counts: tuple[int, ...] | None = None) -> dict[int, int]:
    """Piece size to pieces a bin, largest first; pieces of one id always have a class, so anything can be cut up."""
    if counts is None:
        counts = tuple(1 << k for k in range(capacity.bit_length()) if capacity % (1 << k) == 0)
    sizes = {capacity // k: k for k in sorted({1, capacity, *counts}, reverse=True) if 1 <= k <= capacity}
    return dict(sorted(sizes.items(), reverse=True))


def cut(length: int, sizes: list[int]) -> list[tuple[int, int]]:
    """``(start, size)`` of a document's pieces."""
    out, at = [], 0
    for size in sizes:
        for _ in range((length - at) // size):
            out.append((at, size))
            at += size
    return out


def powers_of(length: int) -> list[int]:
    """Powers of two that add up to ``length``, largest first."""
    return [1 << k for k in reversed(range(length.bit_length())) if length >> k & 1]


class Bins:
    """The open bins of one task, and the rows of those that closed."""

    def __init__(self, sizes: dict[int, int], first_sequence: int) -> None:
        self.sizes, self.next = sizes, first_sequence
        self.open: dict[int, list] = {size: [] for size in sizes}
        self.rows: list[tuple] = []

    def close(self, pieces: list) -> None:
        offset = 0
        for doc_id, start, ids, tokens in pieces:
            self.rows.append((doc_id, start, len(ids) // 4, ids, tokens, self.next, offset))
            offset += len(ids) // 4
        self.next += 1

    def add(self, doc_id, ids: bytes) -> None:
        """A document's ids, four bytes each."""
        for start, size in cut(len(ids) // 4, list(self.sizes)):
            held = self.open[size]
            held.append((doc_id, start, ids[4 * start : 4 * (start + size)], len(ids) // 4))
            if len(held) == self.sizes[size]:
                self.close(held)
                self.open[size] = []

    def finish(self) -> None:
        """Closes what is open: laid end to end and cut at powers of two."""
        for held in self.open.values():
            pieces = iter(held)
            rest = next(pieces, None)
            for room in powers_of(sum(len(p[2]) // 4 for p in held)):
                taken = []
                while room:
                    doc_id, start, ids, tokens = rest
                    taken.append((doc_id, start, ids[: 4 * room], tokens))
                    rest = (doc_id, start + room, ids[4 * room :], tokens) if len(ids) > 4 * room else next(pieces, None)
                    room -= len(taken[-1][2]) // 4
                self.close(taken)


_ENCODERS: dict[int, Encoder] = {}


def _packer(shared, capacity: int, counts: tuple[int, ...] | None, end_id: int, id_type: pa.DataType):
    def run(batches):
        encoder = _ENCODERS.get(shared.id)
        if encoder is None:
            _ENCODERS.clear()
            encoder = _ENCODERS[shared.id] = Encoder(shared.value)
        end = end_id.to_bytes(4, "little")
        bins = Bins(class_sizes(capacity, counts), TaskContext.get().partitionId() * SEQUENCES_A_TASK)

        def told():
            columns = list(zip(*bins.rows, strict=True)) or [[]] * 7
            bins.rows = []
            kinds = (id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for rows, data, offsets in slices(batch):
                raw = data.tobytes()
                for doc_id, a, b in zip(doc_ids[rows], offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    bins.add(doc_id, encoder.encode(raw[a:b]) + end)
                if bins.rows:
                    yield told()
        bins.finish()
        yield told()

    return run


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, counts: tuple[int, ...] | None = None, end_id: int = END_ID) -> DataFrame:
    """Pieces of the rows of ``docs(doc_id, text)``, packed into sequences of at most ``capacity`` ids.

    Returns doc_id, start (the document's ids before the piece), length, ids
    (binary, little-endian unsigned 32-bit), doc_tokens (the document's ids with
    its end), sequence_id and offset (without gaps from 0).  ``vocabulary`` is the
    text of a tokenizers file.  Null and empty texts are one ``end_id``.  Every row is a
    document of its own, repeated ones too; a null doc_id stays null.  An empty table
    gives no rows; other columns are not read.  A task's sequences depend on the order
    of its rows alone, so a task that runs again gives the same.
    """
    if len(vocabulary) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"a vocabulary of more than {MAX_VOCABULARY_BYTES} bytes")
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    fields = f"doc_id {kind.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return docs.select("doc_id", "text").mapInArrow(_packer(_Shared(shared), capacity, counts, end_id, to_arrow_type(kind)), fields)


class _Shared:
    """A broadcast value with a number that tells a worker whether it still holds the same."""

    def __init__(self, broadcast) -> None:
        import uuid

        self.broadcast, self.id = broadcast, uuid.uuid4().int

    @property
    def value(self):
        return self.broadcast.value


def vocabulary_text(path: str | None = None) -> str:
    """The vocabulary file at ``path``; by default the public word-level one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as file:
        return file.read()


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_text())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op11_harmonic_packing": op11}
