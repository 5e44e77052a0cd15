"""Suffix-array deduplication by bytes.

Method: linear grouping construction of suffix arrays.  Phase one sorts suffixes into
groups by their Lyndon prefixes: groups are processed in descending order, and
each suffix's previous smaller suffix moves behind its old group by how many of
the group's suffixes point to it.  Phase two emits each group's order in
ascending order from the rank of the suffix that follows the Lyndon prefix, without
renaming and recursion.

Many small texts are built in step: one round processes the next group of every
text with array operations, which leaves the method as it is and makes numpy
worthwhile.  Pointers to the previous smaller suffix come from a linked list of the
suffixes not yet processed: all that remain belong to lower groups.

Where the texts come from: a string of ``WINDOW`` bytes contains a gram of
``GRAM`` bytes, chosen by content, that all its copies share.  Documents send the
grams' hashes to shards, and only stretches around grams that occur elsewhere go
on to a suffix array with the other stretches around that gram.  Before that,
content-defined chunks that a smaller document holds too are settled as a whole, so
near copies of a document cost little.  Everything is sent once per block of
documents, and a gram with over ``HOT`` occurrences is split into single windows,
which copies share: that changes where windows meet, not what is found.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ledgermend.llm.blocks import MAIL, Common, common_keys, in_blocks, pack, shards, tally, to_blocks, to_shards, unpack
from ledgermend.llm.tokens import BASE, U64, WORD_BASE, marked, mix, powers, inverse, ranges, seed_positions, slices, within

WINDOW = 50
GRAM = 20
CHUNK = 16  # grams in a chunk, on average
HOT = 2000
CHUNKS, SETTLED, STRETCHES, COVERED = 10, 11, 12, 13
BATCH_SYMBOLS = 1 << 21
HOMES = np.dtype([("block", "u4"), ("several", "u1")])


# -- suffix arrays ---------------------------------------------------------------------


def suffix_ranks(symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The rank of every suffix among the suffixes of its own text, plus the text's first position.

    ``symbols`` joins texts of the given sizes, each ending in 0, which occurs
    nowhere else.
    """
    n = len(symbols)
    base = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((symbols, text))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    group_first = np.empty(n, bool)
    group_first[:1] = True
    group_first[1:] = (symbols[order][1:] != symbols[order][:-1]) | (text[order][1:] != text[order][:-1])
    firsts = np.flatnonzero(group_first)
    group = np.empty(n, np.int64)  # of a suffix: the first rank of its group
    group[order] = np.repeat(firsts, np.diff(np.append(firsts, n)))
    members_of = np.zeros(n + 1, np.int64)  # of a group: how many suffixes
    members_of[firsts] = np.diff(np.append(firsts, n))
    left, right = np.arange(n) - 1, np.arange(n) + 1
    end = base + sizes  # of a text: ranks from here on are processed
    moved = np.zeros(n, bool)
    rounds = []
    active = np.flatnonzero(sizes > 0)
    while len(active):
        start = group[order[end[active] - 1]]
        count = end[active] - start
        own = np.sort(order[ranges(start, count)])
        # Runs: members next to each other among the suffixes not yet processed.
        head = np.empty(len(own), bool)
        head[:1] = True
        head[1:] = left[own[1:]] != own[:-1]
        heads = np.flatnonzero(head)
        length = np.diff(np.append(heads, len(own)))
        first, last = own[heads], own[heads + length - 1]
        before, after = left[first], right[last]
        rounds.append((own, np.repeat(heads + length, length) - np.arange(len(own)), np.repeat(after, length), group[own]))
        inside = after < n
        left[after[inside]] = before[inside]
        known = before >= 0
        right[before[known]] = after[known]
        # Previous smaller suffixes, by their group and by how many members point to them.
        known[known] = text[before[known]] == text[first[known]]
        p, pointed = before[known], length[known]
        if len(p):
            by = np.lexsort((pointed, group[p]))
            p, pointed = p[by], pointed[by]
            g = group[p]
            new_g = np.empty(len(p), bool)
            new_g[:1] = True
            new_g[1:] = g[1:] != g[:-1]
            at = np.flatnonzero(new_g)
            movers = np.diff(np.append(at, len(p)))
            tail = g[at] + members_of[g[at]] - movers
            target = ranges(tail, movers)
            place = rank[p]
            moved[p] = True
            there = order[target]
            stay = there[~moved[there]]
            vacated = place[place < np.repeat(tail, movers)]
            order[vacated] = stay
            rank[stay] = vacated
            order[target] = p
            rank[p] = target
            moved[p] = False
            members_of[g[at]] -= movers
            new_c = new_g.copy()
            new_c[1:] |= pointed[1:] != pointed[:-1]
            cut = np.flatnonzero(new_c)
            size = np.diff(np.append(cut, len(p)))
            group[p] = np.repeat(target[cut], size)
            members_of[target[cut]] = size
        end[active] = start
        active = active[start > base[active]]
    final = np.zeros(n + 1, np.int64)
    for own, repeats, after, start in reversed(rounds):
        if len(own) > 1:
            by = np.lexsort((final[after], repeats, start))
            own, start = own[by], start[by]
            new = np.empty(len(own), bool)
            new[:1] = True
            new[1:] = start[1:] != start[:-1]
            at = np.flatnonzero(new)
            start = start + np.arange(len(own)) - np.repeat(at, np.diff(np.append(at, len(own))))
        final[own] = start
    return final[:n]


def least_owner(stretches: np.ndarray, starts: np.ndarray, sizes: np.ndarray, bucket: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each stretch, the least owner of an equal window in its bucket.

    Stretches of one bucket must be consecutive.  Returns (first window of each stretch,
    least owners of all windows).
    """
    windows = sizes - WINDOW + 1
    first_window = np.cumsum(windows) - windows
    out = np.empty(int(windows.sum()), np.int64)
    change = np.flatnonzero(np.diff(bucket) != 0) + 1
    b_lo, b_hi = np.concatenate([[0], change]), np.concatenate([change, [len(bucket)]])
    if not len(bucket):
        return first_window, out
    symbols_in = np.add.reduceat(sizes + 1, b_lo) + 1
    symbols_to = np.cumsum(symbols_in)
    at = 0
    while at < len(b_lo):
        stop = max(at + 1, int(np.searchsorted(symbols_to, (symbols_to[at - 1] if at else 0) + BATCH_SYMBOLS, "right")))
        s_lo, s_hi = b_lo[at], b_hi[stop - 1]
        # Each stretch is followed by 1, each text by 0; bytes are 2 and up.
        closing = np.zeros(s_hi - s_lo, np.int64)
        closing[b_hi[at:stop] - 1 - s_lo] = 1
        room = sizes[s_lo:s_hi] + 1 + closing
        place = np.cumsum(room) - room
        symbols = np.zeros(int(room.sum()), np.int16)
        symbols[ranges(place, sizes[s_lo:s_hi])] = stretches[ranges(starts[s_lo:s_hi], sizes[s_lo:s_hi])].astype(np.int16) + 2
        symbols[place + sizes[s_lo:s_hi]] = 1
        rank = suffix_ranks(symbols, symbols_in[at:stop])
        w_pos = ranges(place, windows[s_lo:s_hi])
        w_owner = np.repeat(owner[s_lo:s_hi], windows[s_lo:s_hi])
        by = np.argsort(rank[w_pos])
        pos = w_pos[by]
        same = np.ones(max(len(pos) - 1, 0), bool)
        for lo in range(0, len(same), 1 << 18):
            hi = min(lo + (1 << 18), len(same))
            view = np.lib.stride_tricks.sliding_window_view(symbols, WINDOW)
            rows = view[pos[lo : hi + 1]]
            same[lo:hi] = (rows[1:] == rows[:-1]).all(axis=1)
        # Equal windows of different buckets are neighbours only across a text's end, never in one text.
        bucket_of = np.repeat(bucket[s_lo:s_hi], windows[s_lo:s_hi])[by]
        new = np.concatenate([[True], ~same | (bucket_of[1:] != bucket_of[:-1])]) if len(pos) else np.zeros(0, bool)
        cut = np.flatnonzero(new)
        if len(cut):
            least = np.minimum.reduceat(w_owner[by], cut)
            out[first_window[s_lo] + by] = np.repeat(least, np.diff(np.append(cut, len(pos))))
        at = stop
    return first_window, out


def least_owners(stretches, starts, sizes, bucket, owner) -> tuple[np.ndarray, np.ndarray]:
    """The same, with suffix arrays only for buckets that stretches of several documents share.

    In any other bucket no window has another document's equal.
    """
    windows = sizes - WINDOW + 1
    first_window = np.cumsum(windows) - windows
    out = np.repeat(owner, windows)
    if not len(bucket):
        return first_window, out
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    several = np.repeat(np.minimum.reduceat(owner, cut) < np.maximum.reduceat(owner, cut), np.diff(np.append(cut, len(bucket))))
    part = np.flatnonzero(several)
    _, least = least_owner(stretches, starts[part], sizes[part], bucket[part], owner[part])
    out[ranges(first_window[part], windows[part])] = least
    return first_window, out


# -- documents -------------------------------------------------------------------------


class Bytes:
    """Grams, windows, chunks and stretches of a slice of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, docs: np.ndarray):
        self.data, self.offsets, self.docs = data, offsets, docs
        n = len(data)
        total = np.empty(n + 1, U64)
        total[0] = 0
        np.cumsum((data.astype(U64) + U64(1)) * powers(BASE, n), out=total[1:])
        self._total, self._back = total, powers(inverse(BASE), n + 1)
        self.gram = self.hashes(np.arange(max(n - GRAM + 1, 0)), GRAM)
        self.start = within(offsets, WINDOW)
        chosen = seed_positions(self.gram, WINDOW - GRAM + 1)
        self.seed = chosen[self.start] if len(self.start) else self.start
        self.owner = np.searchsorted(offsets, self.start, "right") - 1
        # Windows of one gram are consecutive: a stretch runs from the first to the end of the last.
        new = np.ones(len(self.start), bool)
        if len(new):
            new[1:] = (self.seed[1:] != self.seed[:-1]) | (self.owner[1:] != self.owner[:-1])
        self.s_first = np.flatnonzero(new)
        self.s_windows = np.diff(np.append(self.s_first, len(self.start)))
        self.s_start = self.start[self.s_first]
        self.s_size = self.s_windows + WINDOW - 1
        self.s_seed = self.seed[self.s_first]
        self.s_owner = self.owner[self.s_first]
        # Chunks: consecutive stretches up to one whose gram's hash says so.
        cut = np.zeros(len(self.s_first), bool)
        if len(cut):
            cut[0] = True
            cut[1:] = (self.s_owner[1:] != self.s_owner[:-1]) | (self.gram[self.s_seed[1:]] % U64(CHUNK) == 0)
        self.c_first = np.flatnonzero(cut)
        self.c_of = np.cumsum(cut) - 1
        last = np.append(self.c_first, len(self.s_first))[1:] - 1 if len(self.c_first) else self.c_first
        self.c_start = self.s_start[self.c_first]
        self.c_size = self.s_start[last] + self.s_size[last] - self.c_start
        self.c_owner = self.s_owner[self.c_first]

    def hashes(self, starts: np.ndarray, size) -> np.ndarray:
        size = np.asarray(size)
        return mix((self._total[starts + size] - self._total[starts]) * self._back[starts] + size.astype(U64))

    def chunk_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """A chunk's hash, and an independent one for its shard (of its first gram)."""
        key = self.hashes(self.c_start, self.c_size)
        return key, mix(self.gram[self.s_seed[self.c_first]] ^ U64(WORD_BASE))


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    """doc_id, null as the largest number: a null id is smaller than none."""
    ids = batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64())
    return ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)


def _first_mail(n: int):
    """Gram hashes, and chunks with the least document that holds each."""

    def run(batches):
        for batch in batches:
            block, ids = np.array(batch.column(0)), _ids(batch)
            keys, blocks, chunks = [], [], []
            for rows, data, offsets in slices(batch):
                x = Bytes(data, offsets, ids[rows])
                keys.append(x.gram[x.s_seed])
                blocks.append(block[rows][x.s_owner])
                key, home = x.chunk_keys()
                chunks.append((block[rows][x.c_owner].astype(np.int64), (home % U64(n)).astype(np.int64), key, ids[rows][x.c_owner]))
            yield from tally(keys, blocks, n)
            if chunks:
                place, shard, key, doc = (np.concatenate(c) for c in zip(*chunks, strict=True))
                by = np.lexsort((doc, key, place, shard))
                place, shard, key, doc = place[by], shard[by], key[by], doc[by]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (shard[1:] != shard[:-1]) | (place[1:] != place[:-1])
                at = np.flatnonzero(new)
                homes = np.zeros(len(at), HOMES)
                homes["block"], homes["several"] = place[at], np.diff(np.append(at, len(key))) > 1
                yield from pack(CHUNKS, shard[at], 0, [key[at], doc[at], homes])

    return run


def _first_answers(shard: int, rows: list, hot: int = HOT):
    yield from common_keys(shard, [r for r in rows if r[0] != CHUNKS], many=hot)
    mine = [r for r in rows if r[0] == CHUNKS]
    keys, docs, homes = unpack(mine, 2, np.uint64)[0], unpack(mine, 3, np.int64)[0], unpack(mine, 4, HOMES)[0]
    several, blocks = homes["several"], homes["block"].astype(np.int64)
    by = np.argsort(keys, kind="stable")
    keys, docs, several, blocks = keys[by], docs[by], several[by], blocks[by]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    reps = np.diff(np.append(at, len(keys)))
    least = np.repeat(np.minimum.reduceat(docs, at), reps) if len(keys) else docs
    keep = (np.repeat(reps, reps) > 1) | (several > 0)
    by = np.argsort(blocks[keep], kind="stable")
    yield from pack(SETTLED, np.full(int(keep.sum()), shard), blocks[keep][by], [keys[keep][by], least[keep][by]])


class Letters:
    """What a block knows: its common grams, and the least document of its chunks that occur elsewhere."""

    def __init__(self, letters: list, n: int):
        self.common = Common(letters, n)
        mine = [r for r in letters if r[0] == SETTLED]
        keys, least = unpack(mine, 2, np.uint64)[0], unpack(mine, 3, np.int64)[0]
        by = np.argsort(keys)
        self.keys, self.least = keys[by], least[by]

    def settled(self, x: Bytes) -> np.ndarray:
        """Stretches in a chunk that a smaller document holds too."""
        key, _ = x.chunk_keys()
        if not len(self.keys) or not len(key):
            return np.zeros(len(x.s_first), bool)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return ((self.keys[at] == key) & (self.least[at] < x.docs[x.c_owner]))[x.c_of]

    def open(self, x: Bytes):
        """Stretches still to compare: (document row, start, size, key of its bucket, hash); hot grams by single windows."""
        gram = x.gram[x.s_seed]
        known, hot = self.common.find(gram)
        known &= ~self.settled(x)
        plain, split = np.flatnonzero(known & ~hot), np.flatnonzero(known & hot)
        windows = ranges(x.s_first[split], x.s_windows[split])
        row = np.concatenate([x.s_owner[plain], x.owner[windows]])
        start = np.concatenate([x.s_start[plain], x.start[windows]])
        size = np.concatenate([x.s_size[plain], np.full(len(windows), WINDOW)]).astype(np.int64)
        own = x.hashes(start, size)
        bucket = np.concatenate([gram[plain], own[len(plain) :]])
        return row, start, size, bucket, mix(own + bucket)


def _stretches(n: int):
    def run(block, letters, batches):
        known = Letters(letters, n)
        for batch in batches:
            ids, found, raw, shift = _ids(batch), [], [], 0
            for rows, data, offsets in slices(batch):
                x = Bytes(data, offsets, ids[rows])
                row, start, size, bucket, key = known.open(x)
                found.append((key, x.docs[row], start + shift, size, bucket))
                raw.append(data)
                shift += len(data)
            if not found:
                continue
            key, doc, start, size, bucket = (np.concatenate(c) for c in zip(*found, strict=True))
            shard = (bucket % U64(n)).astype(np.int64)
            by = np.lexsort((doc, key, shard))
            key, doc, start, size, bucket, shard = key[by], doc[by], start[by], size[by], bucket[by], shard[by]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (shard[1:] != shard[:-1])
            at = np.flatnonzero(new)
            several = np.diff(np.append(at, len(key))) > 1
            key, doc, start, size, bucket, shard = key[at], doc[at], start[at], size[at], bucket[at], shard[at]
            facts = np.zeros(len(key), np.dtype([("key", "u8"), ("doc", "i8"), ("bucket", "u8"), ("size", "u2"), ("several", "u1")]))
            facts["key"], facts["doc"], facts["bucket"], facts["size"], facts["several"] = key, doc, bucket, size, several
            data = np.concatenate(raw)
            cuts = np.flatnonzero(np.diff(shard) != 0) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(shard)], strict=True):
                if lo < hi:
                    text = data[ranges(start[lo:hi], size[lo:hi])]
                    yield pa.RecordBatch.from_arrays([pa.array([STRETCHES], pa.int32()), pa.array([int(shard[lo])], pa.int32()), pa.array([block], pa.int32()), pa.array([facts[lo:hi].tobytes()], pa.binary()), pa.array([text.tobytes()], pa.binary()), pa.nulls(1, pa.binary())], ["kind", "shard", "block", "a", "b", "c"])

    return run


FACTS = np.dtype([("key", "u8"), ("doc", "i8"), ("bucket", "u8"), ("size", "u2"), ("several", "u1")])


def _compare(shard: int, rows: list):
    """Suffix arrays of all buckets of a shard; to each block, the windows of its stretches that a smaller document holds."""
    facts, counts = unpack(rows, 2, FACTS)
    data = np.concatenate([np.frombuffer(r[3], np.uint8) for r in rows]) if rows else np.zeros(0, np.uint8)
    blocks = np.repeat(np.array([r[1] for r in rows], np.int64), counts)
    size = facts["size"].astype(np.int64)
    start = np.cumsum(size) - size
    # Blocks send the same stretch: one copy, with the least document of all, is compared.
    by = np.lexsort((facts["doc"], facts["key"], facts["bucket"]))
    key, bucket = facts["key"][by], facts["bucket"][by]
    new = np.ones(len(by), bool)
    new[1:] = (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])
    at = np.flatnonzero(new)
    one = by[at]
    first_window, least = least_owners(data, start[one], size[one], facts["bucket"][one], facts["doc"][one])
    stretch = np.empty(len(by), np.int64)
    stretch[by] = np.cumsum(new) - 1
    windows = size - WINDOW + 1
    bits = np.zeros(len(by), np.uint64)
    w = ranges(first_window[stretch], windows)
    smaller = least[w] < np.repeat(facts["doc"], windows)
    number = ranges(np.zeros(len(by), np.int64), windows)
    np.bitwise_or.at(bits, np.repeat(np.arange(len(by)), windows)[smaller], U64(1) << number[smaller].astype(U64))
    keep = (bits > 0) | (facts["several"] > 0)
    order = np.argsort(blocks[keep], kind="stable")
    picked = lambda x: np.ascontiguousarray(x[keep][order])
    yield from pack(COVERED, np.full(int(keep.sum()), shard), picked(blocks), [picked(facts["key"]), picked(bits), picked(facts["doc"])])


def _cut(n: int, keep: list[str], with_text: bool):
    def run(_block, letters, batches):
        known = Letters(letters, n)
        mine = [r for r in letters if r[0] == COVERED]
        keys, bits, docs = unpack(mine, 2, np.uint64)[0], unpack(mine, 3, np.uint64)[0], unpack(mine, 4, np.int64)[0]
        # A block's batches may each have sent a stretch: the least document's letter has its windows.
        by = np.lexsort((docs, keys))
        keys, bits, docs = keys[by], bits[by], docs[by]
        new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
        keys, bits, docs = keys[new], bits[new], docs[new]
        for batch in batches:
            ids = _ids(batch)
            n_bytes, n_removed, n_spans, sums, texts = [], [], [], [], []
            for rows, data, offsets in slices(batch):
                x = Bytes(data, offsets, ids[rows])
                whole = known.settled(x)
                spans = [(x.s_start[whole], x.s_start[whole] + x.s_size[whole])]
                row, start, size, _, key = known.open(x)
                if len(keys) and len(key):
                    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    hit = keys[at] == key
                    row, start, size, at = row[hit], start[hit], size[hit], at[hit]
                    later = x.docs[row] > docs[at]
                    spans.append((start[later], start[later] + size[later]))
                    start, size, at = start[~later], size[~later], at[~later]
                    windows = size - WINDOW + 1
                    number = ranges(np.zeros(len(start), np.int64), windows)
                    on = (np.repeat(bits[at], windows) >> number.astype(U64)) & U64(1) > 0
                    w = (np.repeat(start, windows) + number)[on]
                    spans.append((w, w + WINDOW))
                gone = marked(np.concatenate([s for s, _ in spans]), np.concatenate([e for _, e in spans]), len(data))
                for k in range(len(offsets) - 1):
                    lo, hi = offsets[k], offsets[k + 1]
                    out = gone[lo:hi]
                    kept = data[lo:hi][~out].tobytes()
                    n_bytes.append(int(hi - lo))
                    n_removed.append(int(out.sum()))
                    n_spans.append(int(out[:1].sum() + (out[1:] & ~out[:-1]).sum()))
                    sums.append(hashlib.sha256(kept).hexdigest())
                    if with_text:
                        texts.append(kept)
            columns = {c: batch.column(batch.schema.get_field_index(c)) for c in keep}
            columns |= {"n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(sums, pa.string())}
            yield pa.RecordBatch.from_pydict(columns | ({"kept_bytes": pa.array(texts, pa.binary())} if with_text else {}))

    return run


def remove_later_copies(docs: DataFrame, keep: list[str], with_text: bool = False) -> DataFrame:
    """The columns ``keep`` of every row with n_bytes, n_removed, n_spans and kept_sha256, and kept_bytes if asked for.

    Each UTF-8 byte covered by a string of ``WINDOW`` bytes that also starts in a
    row with a smaller doc_id is removed.  Null text is empty.  A null doc_id is
    larger than any other; rows of equal doc_id don't remove each other.  An
    empty table gives no rows.
    """
    n = shards(docs)
    placed = in_blocks(docs, [*keep, "doc_id"], n)
    first = to_shards(placed.select("block", "doc_id", "text").mapInArrow(_first_mail(n), MAIL), n, _first_answers)
    answers = to_shards(to_blocks(first, placed, _stretches(n), MAIL), n, _compare)
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{fields}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_bytes binary" if with_text else "")
    return to_blocks(first.unionByName(answers), placed, _cut(n, keep, with_text), schema)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_later_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])


QUERIES = {"op8_suffix_array_dedup": op8}
