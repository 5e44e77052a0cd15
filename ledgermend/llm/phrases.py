"""Substring deduplication by words.

Method: repeated-phrase automata.  A window of ``WINDOW`` words is recurring if
its word sequence starts anywhere else.

1. Confirm.  Every window has two phrases chosen by content (the least hash of those of
   ``PHRASES`` words inside it), which all its copies share.  One exchange counts them.  Windows
   whose phrases both recur go, as text, to the shard of their phrase: consecutive
   windows of one phrase make one segment, and a block sends each different
   segment once.  The shard counts windows and gives each block the passages
   (runs of recurring windows) of its segments.
2. Compile.  The passages that a block was given make one Aho-Corasick automaton, a
   letter a word (eight bits of the word's hash).
3. Locate.  All documents of the block are streamed through its automaton.  A match
   whose words are those of the passage is an occurrence; the words it covers go.

The occurrences alone decide what is removed: nothing is looked up by hash in this step.
A word is covered by a recurring window exactly if a passage occurs over it,
because a passage consists of recurring windows, and every recurring window lies in a
passage that its block was given.

Scale: blocks are of about ``BLOCK_BYTES`` of text, so the number of blocks grows with the
table and what a task holds doesn't.  A passage that a third of all documents hold is sent
once by each block.  A phrase that occurs over ``HOT`` times (a common line)
would crowd its shard: its windows go by their longer phrase, and if that one is
hot too each by its own hash.  That changes where windows meet, not what is found.
Windows are counted by 64-bit hashes within a shard, chosen by another hash.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ledgermend.llm.blocks import MAIL, Common, common_keys, in_blocks, shards, tally, to_blocks, to_shards
from ledgermend.llm.tokens import U64, gram_hashes, marked, mix, seed_positions, slices, span_hashes, within, word_spans

WINDOW = 35
PHRASES = (8, 20)
HOT = 2000
#: Text that one task holds, with the automaton of its passages; more memory bears more and spares letters.
BLOCK_BYTES = 8 << 20
#: Phrases counted together before they are sent.
LETTER_KEYS = 1 << 18
SEGMENTS, PASSAGES = 3, 4
_SPREAD = 0xC2B2AE3D27D4EB4F


class Windows:
    """Words of a slice of texts, the windows that lie inside one text, and each window's phrases."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        self.starts, self.ends, self.firsts = word_spans(data, offsets)
        self.words = span_hashes(data, self.starts, self.ends)
        self.start = within(self.firsts, WINDOW)

    def window(self) -> np.ndarray:
        """Of each window: the hash of its words."""
        return gram_hashes(self.words, WINDOW, _SPREAD)[self.start] if len(self.start) else self.words[:0]

    def phrase(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each window: where its phrase of ``PHRASES[k]`` words starts, and the phrase's key."""
        if not len(self.start):
            return self.start, self.words[:0]
        key = gram_hashes(self.words, PHRASES[k])
        at = seed_positions(key, WINDOW - PHRASES[k] + 1)[self.start]
        return at, mix(key[at] + U64(k))

    def texts(self, first: np.ndarray, last: np.ndarray) -> list[bytes]:
        """The words ``first`` to ``last`` of each pair, joined by one space."""
        raw, starts, ends = self.data.tobytes(), self.starts[first].tolist(), self.ends[last].tolist()
        return [b" ".join(raw[a:b].split()) for a, b in zip(starts, ends, strict=True)]


def _letter(kind: int, shard: int, block: int, texts: list[bytes], counts: bytes = b"") -> pa.RecordBatch:
    columns = [pa.array([x], pa.int32()) for x in (kind, shard, block)] + [pa.array([x], pa.binary()) for x in (b"\n".join(texts), counts, None)]
    return pa.RecordBatch.from_arrays(columns, ["kind", "shard", "block", "a", "b", "c"])


def _phrase_keys(n: int):
    def run(batches):
        for batch in batches:
            block = np.array(batch.column(0))
            keys, blocks = [], []
            for rows, data, offsets in slices(batch):
                w = Windows(data, offsets)
                for k in range(len(PHRASES)):
                    at, key = w.phrase(k)
                    at, one = np.unique(at, return_index=True)
                    keys.append(key[one])
                    blocks.append(block[rows][np.searchsorted(w.firsts, at, "right") - 1])
                if sum(map(len, keys)) > LETTER_KEYS:
                    yield from tally(keys, blocks, n)
                    keys, blocks = [], []
            yield from tally(keys, blocks, n)

    return run


def _common_phrases(shard: int, rows: list):
    return common_keys(shard, rows, many=HOT)


def _segments(n: int):
    """Runs of windows with one home whose phrases recur: their text to the home's shard, and whether it occurs more than once."""

    def run(block, letters, batches):
        common = Common(letters, n)
        held: dict[tuple[int, bytes], int] = {}
        for batch in batches:
            for _, data, offsets in slices(batch):
                w = Windows(data, offsets)
                (at, short), (_, long) = w.phrase(0), w.phrase(1)
                known, hot = common.find(short)
                both, crowded = common.find(long)
                home = np.where(hot, np.where(crowded, w.window(), long), short)
                # A window that goes by its own hash is a segment of its own.
                run_of = np.where(hot, np.where(crowded, np.arange(len(home)), -1), at)
                pick = np.flatnonzero(known & both)
                if not len(pick):
                    continue
                joined = (np.diff(pick) == 1) & (np.diff(w.start[pick]) == 1) & (home[pick][1:] == home[pick][:-1]) & (run_of[pick][1:] == run_of[pick][:-1])
                first = np.flatnonzero(np.concatenate([[True], ~joined]))
                last = np.append(first[1:], len(pick)) - 1
                shard = (home[pick[first]] % U64(n)).tolist()
                for key in zip(shard, w.texts(w.start[pick[first]], w.start[pick[last]] + WINDOW - 1), strict=True):
                    held[key] = held.get(key, 0) + 1
        by_shard: dict[int, list[bytes]] = {}
        for shard, text in held:
            by_shard.setdefault(shard, []).append(text)
        for shard, texts in sorted(by_shard.items()):
            yield _letter(SEGMENTS, shard, block, texts, bytes(min(held[shard, t], 2) for t in texts))

    return run


def _confirm(shard: int, rows: list):
    """To each block the passages of its segments: runs of windows that occur more than once anywhere."""
    texts, counts, blocks = [], [], []
    for _, block, text, count, _ in rows:
        own = text.split(b"\n")
        texts += own
        counts.append(np.frombuffer(count, np.uint8))
        blocks += [block] * len(own)
    if not texts:
        return
    joined = np.frombuffer(b"\n".join(texts), np.uint8)
    w = Windows(joined, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1], [len(joined)]]))
    owner = np.searchsorted(w.firsts, w.start, "right") - 1
    _, number = np.unique(w.window(), return_inverse=True)
    found = np.flatnonzero(np.bincount(number, np.concatenate(counts)[owner])[number] > 1)
    if not len(found):
        return
    first = np.flatnonzero(np.concatenate([[True], (np.diff(found) != 1) | (np.diff(owner[found]) != 0)]))
    last = np.append(first[1:], len(found)) - 1
    passages: dict[int, set[bytes]] = {}
    for text, k in zip(w.texts(w.start[found[first]], w.start[found[last]] + WINDOW - 1), owner[found[first]].tolist(), strict=True):
        passages.setdefault(blocks[k], set()).add(text)
    for block in sorted(passages):
        yield _letter(PASSAGES, shard, block, sorted(passages[block]))


def _spelled(words: np.ndarray) -> str:
    """A letter a word."""
    return (words >> U64(56)).astype(np.uint8).tobytes().decode("latin-1")


def passage_automaton(texts: list[bytes]):
    """An automaton of passages (words joined by one space); passages that are spelled alike share an entry."""
    built = ahocorasick.Automaton()
    joined = np.frombuffer(b"\n".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1], [len(joined)]]) if texts else np.zeros(1, np.int64)
    starts, ends, firsts = word_spans(joined, offsets)
    spelled = _spelled(span_hashes(joined, starts, ends))
    for k, text in enumerate(texts):
        letters = spelled[firsts[k] : firsts[k + 1]]
        built.add_word(letters, (*built.get(letters, (len(letters),)), text))
    built.make_automaton()
    return built


def occurrences(built, w: Windows) -> tuple[np.ndarray, np.ndarray]:
    """First word and the word after the last of each place where a passage of the automaton occurs."""
    first, after = [], []
    if not len(built):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    spelled, raw, starts, ends = _spelled(w.words), w.data.tobytes(), w.starts, w.ends
    for k in range(len(w.firsts) - 1):
        lo = int(w.firsts[k])
        for last, (size, *texts) in built.iter(spelled[lo : w.firsts[k + 1]]):
            stop = lo + last + 1
            text = raw[starts[stop - size] : ends[stop - 1]]
            if text in texts or b" ".join(text.split()) in texts:
                first.append(stop - size)
                after.append(stop)
    return np.array(first, np.int64), np.array(after, np.int64)


def _remove(keep: list[str], with_text: bool):
    def run(_block, letters, batches):
        passages = {t for r in letters if r[0] == PASSAGES for t in r[2].split(b"\n")}
        built = passage_automaton(sorted(passages))
        for batch in batches:
            n_words, n_removed, sums, texts = [], [], [], []
            for rows, data, offsets in slices(batch):
                w = Windows(data, offsets)
                gone = marked(*occurrences(built, w), len(w.words))
                for k in range(len(offsets) - 1):
                    words, out = data[offsets[k] : offsets[k + 1]].tobytes().split(), gone[w.firsts[k] : w.firsts[k + 1]]
                    removed = int(out.sum())
                    kept = b" ".join(words if not removed else [words[i] for i in np.flatnonzero(~out)])
                    n_words.append(len(words))
                    n_removed.append(removed)
                    sums.append(hashlib.sha256(kept).hexdigest())
                    if with_text:
                        texts.append(kept.decode("utf-8") if removed else batch.column(batch.schema.get_field_index("text"))[rows.start + k].as_py())
            columns = {c: batch.column(batch.schema.get_field_index(c)) for c in keep}
            columns |= {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(sums, pa.string())}
            yield pa.RecordBatch.from_pydict(columns | ({"kept_text": pa.array(texts, pa.string())} if with_text else {}))

    return run


def remove_repeats(docs: DataFrame, keep: list[str], with_text: bool = False) -> DataFrame:
    """The columns ``keep`` of every row with n_words, n_removed and kept_sha256, and kept_text if asked for.

    Each word covered by a window of ``WINDOW`` words whose sequence also starts
    anywhere else in the table (the same text and repeated rows included) is
    removed.  Null text has no words.  kept_text is the text itself where nothing
    is removed, else the kept words joined by one space.  An empty table gives no
    rows.  ``keep`` must not name one of the four columns added; other columns are not read.
    """
    n = shards(docs, BLOCK_BYTES)
    placed = in_blocks(docs, [*keep, "doc_id"], n)
    common = to_shards(placed.select("block", "text").mapInArrow(_phrase_keys(n), MAIL), n, _common_phrases)
    passages = to_shards(to_blocks(common, placed, _segments(n), MAIL), n, _confirm)
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{fields}, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return to_blocks(passages, placed, _remove(keep, with_text), schema)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])


QUERIES = {"op5_substring_dedup": op5}
