"""Benchmark decontamination.

Method: spaced-seed hashing.  Fixed masks pick some of ``SPAN`` consecutive
tokens and ignore the others, so a substituted token leaves most seeds whole.
Seeds of the texts that equal a seed of a benchmark item give an alignment of
the two; the item is then compared token by token along it, and the best
stretch (match +1, substitution -1) must reach a score that a substitution
tolerant copy reaches and chance doesn't.  For items of fewer than ``SHORT`` tokens
the seed is a run of tokens that every copy scoring enough must hold whole, so no
such copy is missed.

Tokens are runs of letters and digits, A-Z lower-cased; punctuation is ignored.

Scale: a benchmark of at most ``BLOCK_TOKENS`` tokens is broadcast, and one narrow
pass over the texts joins, aligns and scores.  Seeds of a larger one meet those
of the texts in a shuffle join, and blocks of items verify the texts that hit
them, so no task or broadcast grows with the benchmark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermend.llm.tokens import U64, WORD_BASE, lowered, mix, ranges, slices, span_hashes, tidy
from ledgermend.workspace import partitions, stored

SPAN = 10
# The tokens that each mask looks at.
MASKS = ((0, 1, 3, 6, 8, 9), (0, 2, 3, 5, 8, 9), (0, 1, 2, 5, 7, 9), (0, 4, 5, 6, 7, 9), (0, 1, 2, 3, 4, 5), (4, 5, 6, 7, 8, 9))
MIN_SCORE = 10
MIN_SHARE = 0.6
#: A token in lower case: letters and digits of ASCII, and everything beyond it.
TOKEN = r"[a-z0-9[^\x00-\x7F]]+"
BLOCK_TOKENS = 1_000_000
#: Pairs of tokens or hits that are held at once, and alignments that wait for their score.
MAX_PAIRS = 1 << 20
MAX_HELD = 1 << 18
MANY = 4
#: Of the seeds of a benchmark of several blocks: 16 MB, two bits a seed.
FILTER_BITS = 1 << 27
SHORT = 17


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts and the index of each text's first token, with a closing entry."""
    data = lowered(data)
    solid = np.zeros(256, bool)
    solid[48:58] = solid[97:123] = solid[128:] = True
    inside = solid[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside & (cut[:-1] | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & (cut[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    return span_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def seed_hashes(tokens: np.ndarray, mask: tuple[int, ...], number: int) -> np.ndarray:
    """The hash under a mask from each start; the mask's span must fit."""
    n = len(tokens) - max(mask)
    out = np.full(max(n, 0), number + 1, U64)
    for at in mask:
        out = out * U64(WORD_BASE) + tokens[at : at + len(out)]
    return mix(out)


def needed(size):
    """The score that a stretch must reach for an item of ``size`` tokens."""
    return np.minimum(MIN_SCORE, np.ceil(MIN_SHARE * size))


def run_of(size: int) -> int:
    """How many tokens in a row agree at least in a copy that scores enough.

    With k substitutions in the stretch, need + k tokens agree in k + 1 runs, and need + 2 k tokens fit the item.
    """
    need = int(needed(size))
    return min(-(-(need + k) // (k + 1)) for k in range((size - need) // 2 + 1))


def seeds_for(size: int) -> list[tuple[tuple[int, ...], int]]:
    """Masks and their numbers for an item of ``size`` tokens."""
    return [run_seed(run_of(size))] if size < SHORT else [(mask, k) for k, mask in enumerate(MASKS)]


def run_seed(run: int) -> tuple[tuple[int, ...], int]:
    return tuple(range(run)), run << 8


def build(items: pa.Table) -> dict:
    """Sorted seeds of a block of items, with the place of each, and the items' tokens."""
    tokens, owners, ids = [], [], []
    batch = items.combine_chunks().to_batches()
    for part in batch:
        for rows, data, offsets in slices(part):
            hashed, firsts = token_hashes(data, offsets)
            for k in range(len(firsts) - 1):
                if firsts[k + 1] > firsts[k]:
                    tokens.append(hashed[firsts[k] : firsts[k + 1]])
                    ids.append(part.column(0)[rows.start + k].as_py())
    seeds, place, item, runs = [], [], [], set()
    for k, own in enumerate(tokens):
        if len(own) < SHORT:
            runs.add(run_of(len(own)))
        for mask, number in seeds_for(len(own)):
            found = seed_hashes(own, mask, number)
            seeds.append(found)
            place.append(np.arange(len(found)))
            item.append(np.full(len(found), k))
    join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
    seeds, place, item = join(seeds, U64), join(place, np.int64), join(item, np.int64)
    order = np.lexsort((place, item, seeds))
    seeds, place, item = seeds[order], place[order], item[order]
    # Places of one seed in one item stand together: a group.
    start = np.flatnonzero(np.concatenate([[True], (seeds[1:] != seeds[:-1]) | (item[1:] != item[:-1])])) if len(seeds) else np.zeros(0, np.int64)
    sizes = np.array([len(t) for t in tokens], np.int64)
    return {
        "place": place, "seeds": seeds[start], "item": item[start], "start": start, "count": np.diff(np.append(start, len(seeds))), "tokens": join(tokens, U64),
        "first": np.cumsum(sizes) - sizes, "size": sizes, "ids": np.array(ids, np.int64), "short": sorted(runs),
    }


def seed_hits(tokens: np.ndarray, firsts: np.ndarray, bench: dict):
    """Slices of ``(text, place of the seed, its group in the benchmark)``."""
    for mask, number in [(m, k) for k, m in enumerate(MASKS)] + [run_seed(n) for n in bench["short"]]:
        found = seed_hashes(tokens, mask, number)
        if not len(found) or not len(bench["seeds"]):
            continue
        lo = np.searchsorted(bench["seeds"], found, "left")
        hit = np.flatnonzero(bench["seeds"][np.minimum(lo, len(bench["seeds"]) - 1)] == found)
        text = np.searchsorted(firsts, hit, "right") - 1
        inside = hit + max(mask) < firsts[text + 1]
        hit, text = hit[inside], text[inside]
        lo, hi = lo[hit], np.searchsorted(bench["seeds"], found[hit], "right")
        part = np.cumsum(hi - lo) // MAX_PAIRS
        for some in np.split(np.arange(len(hit)), np.flatnonzero(np.diff(part)) + 1):
            n = (hi - lo)[some]
            yield np.repeat(text[some], n), np.repeat(hit[some], n), ranges(lo[some], n)


def alignments(tokens: np.ndarray, firsts: np.ndarray, bench: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, item, share)`` of every alignment with a hit whose best stretch scores enough; share: of the item's tokens that agree.

    A text and an item that repeat the same few tokens hit each other about as often as the product of their lengths.  Such a pair, with
    more than ``MANY`` hits a token, isn't enumerated by hits: all its alignments are compared, and they are only as many as both have tokens.
    """
    n_items = max(len(bench["ids"]), 1)
    pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    hits, n_hits = [], 0
    for text, hit, group in seed_hits(tokens, firsts, bench):
        n_hits += len(hit)
        if n_hits <= MAX_PAIRS:
            hits.append((text, hit, group))
        every = np.concatenate([pairs, text * n_items + bench["item"][group]])
        pairs, place = np.unique(every, return_inverse=True)
        counts = np.bincount(place, np.concatenate([counts, bench["count"][group]]), len(pairs)).astype(np.int64)
    length = np.diff(firsts)[pairs // n_items] + bench["size"][pairs % n_items] if len(pairs) else counts
    heavy = pairs[counts > MANY * length]
    kept, pending, held = [], [], 0

    def score() -> None:
        nonlocal held
        text, item, shift = np.unique(np.concatenate(pending, axis=1), axis=1)
        best, share = overlaps(tokens, firsts, text, item, shift, bench)
        ok = best >= needed(bench["size"][item])
        kept.append((text[ok], item[ok], share[ok]))
        pending.clear()
        held = 0

    def candidates():
        # Few hits are held; many are found again rather than held.
        for text, hit, group in hits if n_hits <= MAX_PAIRS else seed_hits(tokens, firsts, bench):
            light = ~np.isin(text * n_items + bench["item"][group], heavy)
            text, hit, group = text[light], hit[light], group[light]
            part = np.cumsum(bench["count"][group]) // MAX_PAIRS
            for some in np.split(np.arange(len(hit)), np.flatnonzero(np.diff(part)) + 1):
                n = bench["count"][group[some]]
                places = bench["place"][ranges(bench["start"][group[some]], n)]
                yield np.stack([np.repeat(text[some], n), np.repeat(bench["item"][group[some]], n), np.repeat(hit[some], n) - places])
        for pair in heavy.tolist():
            text, item = divmod(pair, n_items)
            for lo in range(int(firsts[text] - bench["size"][item]) + 1, int(firsts[text + 1]), MAX_PAIRS):
                shift = np.arange(lo, min(lo + MAX_PAIRS, int(firsts[text + 1])))
                yield np.stack([np.full(len(shift), text), np.full(len(shift), item), shift])

    for found in candidates():
        pending.append(np.unique(found, axis=1) if found.shape[1] > 1 else found)
        held += pending[-1].shape[1]
        if held >= MAX_HELD:
            score()
    if pending:
        score()
    if not kept:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    text, item, share = (np.concatenate(x) for x in zip(*kept, strict=True))
    return text, item, share


def overlaps(tokens, firsts, text, item, shift, bench) -> tuple[np.ndarray, np.ndarray]:
    """Of each alignment: the score of its best stretch, and the share of the item's tokens that agree."""
    score, share = np.zeros(len(text), np.int64), np.zeros(len(text))
    by_size = np.argsort(bench["size"][item], kind="stable")
    at = 0
    while at < len(by_size):
        width = int(bench["size"][item[by_size[min(len(by_size) - 1, at + max(1, MAX_PAIRS // int(bench["size"][item[by_size[-1]]]))  - 1)]]])
        some = by_size[at : at + max(1, MAX_PAIRS // max(width, 1))]
        at += len(some)
        width = int(bench["size"][item[some]].max())
        steps = np.arange(width)
        size = bench["size"][item[some]][:, None]
        place = shift[some][:, None] + steps
        real = (steps < size) & (place >= firsts[text[some]][:, None]) & (place < firsts[text[some] + 1][:, None])
        same = real & (tokens[np.clip(place, 0, max(len(tokens) - 1, 0))] == bench["tokens"][np.minimum(bench["first"][item[some]][:, None] + steps, len(bench["tokens"]) - 1)])
        total = np.cumsum(np.where(same, 1, -1), axis=1)
        low = np.minimum.accumulate(np.concatenate([np.zeros((len(some), 1), np.int64), total[:, :-1]], axis=1), axis=1)
        score[some] = (total - low).max(axis=1)
        share[some] = same.sum(axis=1) / size[:, 0]
    return score, share


def judged(batch: pa.RecordBatch, bench: dict) -> tuple[np.ndarray, np.ndarray, list]:
    """For each text of a batch: how many items contaminate it, the largest share of one, and that item (the smallest on ties)."""
    n_items, best, best_item = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows), [None] * batch.num_rows
    for rows, data, offsets in slices(batch):
        if not len(bench["seeds"]):
            break
        tokens, firsts = token_hashes(data, offsets)
        text, item, share = alignments(tokens, firsts, bench)
        pairs = np.unique(text * len(bench["ids"]) + item) // max(len(bench["ids"]), 1)
        np.add.at(n_items, rows.start + pairs, 1)
        for t, i, s in zip(text.tolist(), bench["ids"][item].tolist(), share.tolist(), strict=True):
            k = rows.start + t
            if s > best[k] or (s == best[k] and (best_item[k] is None or i < best_item[k])):
                best[k], best_item[k] = s, i
    return n_items, best, best_item


def _marker(shared, keep: list[str]):
    @tidy
    def run(batches):
        for batch in batches:
            n_items, best, best_item = judged(batch, shared.value)
            kept = {c: batch.column(batch.schema.get_field_index(c)) for c in keep}
            yield pa.RecordBatch.from_pydict(kept | {"n_items": n_items, "best_item": pa.array(best_item, pa.int64()), "best_overlap": best})

    return run


def _seeds_of_items(batches):
    for batch in batches:
        bench = build(pa.Table.from_batches([batch.select(["item_id", "text"])]))
        numbers = np.array(batch.column(batch.schema.get_field_index("number")))
        whole = np.array([k for k, n in enumerate(_token_counts(batch)) if n], np.int64)
        yield pa.RecordBatch.from_pydict({"seed": bench["seeds"].view(np.int64), "number": numbers[whole][bench["item"]]})


def _token_counts(batch: pa.RecordBatch) -> list[int]:
    return [int(n) for _, data, offsets in slices(batch) for n in np.diff(token_hashes(data, offsets)[1])]


def bits_of(seeds: np.ndarray) -> np.ndarray:
    """The two bits of the filter that a seed sets."""
    return np.concatenate([seeds & U64(FILTER_BITS - 1), (seeds >> U64(32)) & U64(FILTER_BITS - 1)])


def _seeds_of_texts(shared):
    def run(batches):
        bits, runs = shared.value
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index("text_key"))
            for rows, data, offsets in slices(batch):
                tokens, firsts = token_hashes(data, offsets)
                owner, seeds = [], []
                for mask, number in [(m, k) for k, m in enumerate(MASKS)] + [run_seed(n) for n in runs]:
                    found = seed_hashes(tokens, mask, number)
                    at = bits_of(found).reshape(2, -1)
                    hit = np.flatnonzero((bits[at >> U64(6)] >> (at & U64(63)) & U64(1)).all(axis=0))
                    text = np.searchsorted(firsts, hit, "right") - 1
                    inside = hit + max(mask) < firsts[text + 1]
                    owner.append(text[inside])
                    seeds.append(found[hit[inside]])
                both = np.unique(np.stack([np.concatenate(owner).astype(U64), np.concatenate(seeds)]), axis=1)
                yield pa.RecordBatch.from_pydict({"text_key": keys.take(pa.array(both[0].astype(np.int64) + rows.start)), "seed": both[1].view(np.int64)})

    return run


def _judge(batches):
    """Rows sorted by (block, part, role): the items of a block, then the texts that hit one of them."""
    key, items, bench = None, [], None
    for batch in batches:
        block, part, role = (np.array(batch.column(k)) for k in range(3))
        cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(part) != 0) | (np.diff(role) != 0)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if lo == hi:
                continue
            if key != (block[lo], part[lo]):
                key, items, bench = (block[lo], part[lo]), [], None
            rows = batch.slice(lo, hi - lo)
            if role[lo] == 0:
                items.append(rows.select(["item_id", "text"]))
            elif items:
                bench = bench or build(pa.Table.from_batches(items))
                n_items, best, best_item = judged(rows.select(["text"]), bench)
                yield pa.RecordBatch.from_pydict({"text_key": rows.column(3), "n_items": n_items, "best_item": pa.array(best_item, pa.int64()), "best_overlap": best})


def joined(docs: DataFrame, items: DataFrame, tokens: int) -> DataFrame:
    """``text_key, n_items, best_item, best_overlap`` of the texts that an item contaminates, for a benchmark of many blocks.

    Seeds of items and of texts meet in a shuffle join; a filter of fixed size keeps most other seeds of the texts at home.  Texts then go to
    the blocks of the items that they hit, several parts a block, where the overlaps around the hits are verified.
    """
    spark = docs.sparkSession
    blocks = -(-tokens // BLOCK_TOKENS)
    parts = max(1, partitions(spark) // blocks)
    numbered = stored(items.withColumn("number", F.monotonically_increasing_id()).withColumn("block", F.pmod(F.xxhash64("number"), F.lit(blocks)).cast("int")), "decontam-items")
    seeds = stored(numbered.mapInArrow(_seeds_of_items, "seed long, number long").distinct(), "decontam-seeds")
    low = F.col("seed").bitwiseAND(FILTER_BITS - 1)
    high = F.shiftrightunsigned("seed", 32).bitwiseAND(FILTER_BITS - 1)
    words = seeds.select(F.explode(F.array(low, high)).alias("bit")).groupBy(F.shiftright("bit", 6).alias("word"))
    words = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()  # at most FILTER_BITS / 64 rows
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy()
    sizes = range(1, SHORT)
    shared = spark.sparkContext.broadcast((bits.view(U64), sorted({run_of(n) for n in sizes})))
    texts = docs.select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("text_key"), "text").where("text_key is not null")
    met = texts.mapInArrow(_seeds_of_texts(shared), "text_key binary, seed long").join(seeds, "seed").select("text_key", "number").distinct()
    asked = stored(met.join(numbered.select("number", "block"), "number").select("text_key", "block").distinct(), "decontam-asked")
    own = texts.join(asked.select("text_key").distinct(), "text_key", "left_semi").dropDuplicates(["text_key"]).join(asked, "text_key")
    own = own.select("block", F.pmod(F.xxhash64("text_key"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("role"), "text_key", F.lit(None).cast("long").alias("item_id"), "text")
    each = numbered.select("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("role"), F.lit(None).cast("binary").alias("text_key"), "item_id", "text")
    dealt = each.unionByName(own).repartition("block", "part").sortWithinPartitions("block", "part", "role")
    found = dealt.mapInArrow(_judge, "text_key binary, n_items long, best_item long, best_overlap double").where("n_items > 0")
    best = F.max(F.struct("best_overlap", (-F.col("best_item")).alias("item")))
    return found.groupBy("text_key").agg(F.sum("n_items").alias("n_items"), best.alias("best")).select("text_key", "n_items", (-F.col("best.item")).alias("best_item"), F.col("best.best_overlap").alias("best_overlap"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with contaminated, n_items, best_item and best_overlap.

    A text is contaminated by an item if along one alignment a stretch scores at
    least ``MIN_SCORE``, or ``MIN_SHARE`` of a short item's tokens.  best_overlap is
    the largest share of an item's tokens that agree, best_item its item (the
    smallest on ties, null if none).  Null and empty texts, and items without
    tokens or item_id, match nothing.  One row for every row of ``docs``, repeated ones included;
    ``keep`` must not name a column that is added.
    """
    spark = docs.sparkSession
    if "text" not in keep:
        keep = [*keep, "text"]
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    tokens = items.agg(F.sum(F.regexp_count(F.lower("text"), F.lit(TOKEN)).cast("long"))).first()[0] or 0
    if tokens <= BLOCK_TOKENS:
        fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
        shared = spark.sparkContext.broadcast(build(items.toArrow()))  # bounded by BLOCK_TOKENS, just checked
        out = docs.select(keep).mapInArrow(_marker(shared, keep), f"{fields}, n_items long, best_item long, best_overlap double")
    else:
        found = joined(docs, items, tokens).withColumnRenamed("text_key", "_text_key")
        out = docs.select(*keep, F.unhex(F.md5(F.col("text").cast("binary"))).alias("_own_key")).join(found, F.col("_own_key") == F.col("_text_key"), "left").drop("_own_key", "_text_key")
        out = out.withColumns({"n_items": F.coalesce("n_items", F.lit(0)).cast("long"), "best_overlap": F.coalesce("best_overlap", F.lit(0.0))})
    return out.withColumn("contaminated", F.col("n_items") > 0)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["doc_id"])
    return found.select("doc_id", "contaminated", "n_items", "best_item", "best_overlap")


QUERIES = {"op4_decontaminate": op4}
