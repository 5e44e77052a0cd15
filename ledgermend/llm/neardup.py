"""Near-duplicate detection on word shingles.

Method: bottom-k sketches from one hash function.  Inverted lists of the
retained values generate overlaps, the sketch of the union estimates and filters,
and exact Jaccard on full sets verifies.

Steps, and why they hold on large inputs:

* Texts with equal shingle sets are one node (grouped by a 128-bit fingerprint of
  the set with map-side combining), so thousands of copies cost nothing further.
* Every node has a sketch of ``K`` values.  A link needs ``SHARE`` of it in common
  (at the least similarity of 0.75 that is 4.6 standard deviations below the
  mean), so a node with fewer values that occur elsewhere is out.  That leaves
  the few nodes with much repeated text.
* Only these get a sketch of ``DEEP`` values, of which a link needs ``DEEP_SHARE``
  (4.7 deviations; sets that fit into a sketch need the similarity itself, without
  loss).  A node with ``r`` values that occur elsewhere, of which a link needs ``t``,
  must share one of its ``r - t + 1`` rarest: only these enter inverted lists.
  Values of common lines and phrases drop out, unless they make up most of a text.
* Near copies share many values, so most lists have the same members as another:
  one list of each kind stays.
* Each list gives one pair per member, with its least member as centre; pairs whose
  sketches allow a link are verified and linked members merge.  In lists that still hold several
  components, the members outside the largest are compared with all others in blocks, by deep
  sketches and then by full sets; a block gives only links that join components not yet joined
  in it, so nothing grows with the square of a group but arithmetic inside a task.
* Lists with many members are dealt in parts (``PART``); the join that counts how often
  values occur leaves a very common value to Spark's skew join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermend.llm.components import components
from ledgermend.llm.tokens import U64, gram_hashes, lowered, mix, slices, span_hashes, word_spans, tidy
from ledgermend.workspace import discard, stored

WORDS = 5
SIMILARITY = 75  # per cent
K, SHARE = 64, 0.5
DEEP, DEEP_SHARE = 512, 0.66
PART = 1024
BLOCK, BLOCK_BYTES = 1024, 8 << 20
#: Columns of a block's value matrix held at a time.
STRIP = 1024


def shingle_sets(data: np.ndarray, offsets: np.ndarray):
    """The sorted distinct shingle hashes of each text; a text of fewer words has one for its whole sequence."""
    data = lowered(data)
    starts, ends, firsts = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    grams = gram_hashes(words, WORDS)
    for k in range(len(offsets) - 1):
        lo, hi = firsts[k], firsts[k + 1]
        if hi - lo >= WORDS:
            yield np.unique(grams[lo : hi - WORDS + 1])
        elif hi > lo:
            yield mix(gram_hashes(words[lo:hi], hi - lo) + U64(hi - lo))
        else:
            yield np.zeros(0, U64)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


@tidy
def _sketches(batches):
    for batch in batches:
        for rows, data, offsets in slices(batch):
            n, fp1, fp2, sketch = [], [], [], []
            for own in shingle_sets(data, offsets):
                n.append(len(own))
                with np.errstate(over="ignore"):
                    fp1.append(int(_signed(mix(own + U64(1)).sum(dtype=U64, keepdims=True))[0]))
                    fp2.append(int(_signed(mix(own ^ U64(0x5BD1E995A5A5A5A5)).sum(dtype=U64, keepdims=True))[0]))
                sketch.append(_signed(own[:K]))
            columns = [batch.column(0)[rows], pa.array(n, pa.int64()), pa.array(fp1, pa.int64()), pa.array(fp2, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sketch, pa.list_(pa.int64()))], ["doc_id", "n", "fp1", "fp2", "sketch"])


@tidy
def _sets(batches):
    """``node, deep, whole``: the deep sketch as values, the full set as bytes."""
    for batch in batches:
        for rows, data, offsets in slices(batch):
            own = list(shingle_sets(data, offsets))
            deep = pa.array([_signed(s[:DEEP]) for s in own], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0)[rows], deep, pa.array([s.tobytes() for s in own], pa.binary())], ["node", "deep", "whole"])


def may_link(a: np.ndarray, b: np.ndarray, k: int = K, share: float = SHARE) -> bool:
    """Whether the bottom-k values of the union leave a link of two sorted sets possible."""
    a, b = a[:k], b[:k]
    union = np.union1d(a, b)[:k]
    both = np.intersect1d(a, b, assume_unique=True)
    same = int((both <= union[-1]).sum()) if len(both) else 0
    return same >= (share if len(union) == k else SIMILARITY / 100) * len(union)


@tidy
def _verify(batches):
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            a, b = np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64)
            linked = may_link(a, b)
            if linked:
                same = len(np.intersect1d(a, b, assume_unique=True))
                linked = 100 * same >= SIMILARITY * (len(a) + len(b) - same)
            keep.append(linked)
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def linked_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose sketches allow a link and whose full sets reach the similarity."""
    side = lambda c, v: sets.select(F.col("node").alias(c), F.col("whole").alias(v))
    return pairs.join(side("a", "wa"), "a").join(side("b", "wb"), "b").select("a", "b", "wa", "wb").mapInArrow(_verify, "a long, b long").distinct()


def _needed(size: F.Column, k: int, share: float) -> F.Column:
    """How many values of a sketch a link needs.  Near copies of a set of at most 3/4 k values are sketched whole."""
    return F.ceil(size * F.when(size <= k * SIMILARITY // 100, F.lit(SIMILARITY / 100)).otherwise(F.lit(share))).cast("int")


def _shared(sketches: DataFrame, column: str) -> DataFrame:
    """``node, size, value, uses``: the values of sketches that occur more than once."""
    held = sketches.select("node", F.size(column).alias("size"), F.explode(column).alias("value"))
    return held.join(held.groupBy("value").agg(F.count(F.lit(1)).alias("uses")).where("uses > 1"), "value")


def repeated_nodes(sketches: DataFrame) -> DataFrame:
    """The nodes with as many values of others as a link needs."""
    own = _shared(sketches, "sketch").groupBy("node").agg(F.min("size").alias("size"), F.count(F.lit(1)).alias("found"))
    return own.where(F.col("found") >= _needed(F.col("size"), K, SHARE)).select("node")


def candidate_lists(sets: DataFrame) -> DataFrame:
    """``value, node, members``: inverted lists of each node's rarest values, one of those with equal members."""
    own = _shared(sets, "deep").groupBy("node").agg(F.min("size").alias("size"), F.array_sort(F.collect_set(F.struct("uses", "value"))).alias("values"))
    spare = F.size("values") - _needed(F.col("size"), DEEP, DEEP_SHARE) + 1
    rare = own.where(spare > 0).select("node", F.explode(F.slice("values", F.lit(1), spare)).alias("x")).select("node", F.col("x.value").alias("value"))
    rare = stored(rare, "rare-values")
    mark = lambda seed: F.bit_xor(F.xxhash64("node", F.lit(seed)))
    marks = rare.groupBy("value").agg(F.count(F.lit(1)).alias("members"), mark(1).alias("m1"), mark(2).alias("m2")).where("members > 1")
    chosen = marks.groupBy("members", "m1", "m2").agg(F.min("value").alias("value")).select("value", "members")
    lists = stored(rare.join(chosen, "value"), "lists")
    discard(rare)
    return lists


def with_list_columns(lists: DataFrame, each: DataFrame) -> DataFrame:
    """Members with the columns of their list: ``each(value, members, ...)``; lists of over ``PART`` members are dealt in parts."""
    parts = F.ceil(F.col("members") / PART).cast("int")
    many = each.select("*", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    dealt = lists.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int"))
    return dealt.join(many.drop("members"), ["value", "part"]).drop("part")


def star_pairs(lists: DataFrame) -> DataFrame:
    """Each member of a list with the list's least member."""
    centres = lists.groupBy("value", "members").agg(F.min("node").alias("a"))
    return with_list_columns(lists, centres).where("a < node").select("a", F.col("node").alias("b")).distinct()


def blocks(rows: Column, size: Column) -> Column:
    """How many blocks hold so many rows of so many bytes in all."""
    return F.greatest(F.ceil(rows / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")


def open_lists(lists: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Lists that still hold several components: members with theirs, the list's largest, and the blocks of all members and of those outside it.

    The centre (least member) was compared with every other, so it is left out, and a list of two is settled.
    """
    held = lists.join(sets.select("node", F.octet_length("whole").cast("long").alias("bytes")), "node")
    joined = stored(held.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")), "list-components")
    sizes = joined.groupBy("value", "members", "component").agg(F.count(F.lit(1)).alias("size"), F.sum("bytes").alias("bytes"), F.min("node").alias("least"))
    each = sizes.groupBy("value", "members").agg(F.max(F.struct("size", "component", "bytes")).alias("top"), F.sum("bytes").alias("all"), F.min("least").alias("centre")).where("top.size < members and members > 2")
    inner, outer = blocks(F.col("members"), F.col("all")), blocks(F.col("members") - F.col("top.size"), F.col("all") - F.col("top.bytes"))
    each = each.select("value", "members", "centre", F.col("top.component").alias("largest"), inner.alias("inner_blocks"), outer.alias("outer_blocks"))
    found = stored(with_list_columns(joined, each).where("node <> centre").select("value", "node", "component", "largest", "inner_blocks", "outer_blocks"), "open-lists")
    discard(joined)
    return found


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each pair of arrays of distinct values has in common, as products of strips of 0/1 matrices."""
    flat = lambda rows: (np.repeat(np.arange(len(rows)), [len(x) for x in rows]), np.concatenate(rows))
    (at_l, in_l), (at_r, in_r) = flat(left), flat(right)
    both = np.intersect1d(in_l, in_r)
    count = np.zeros((len(left), len(right)), np.float32)

    def strips(at, values, n):
        column = np.searchsorted(both, values)
        known = column < len(both)
        known[known] = both[column[known]] == values[known]
        at, column = at[known], column[known]
        order = np.argsort(column, kind="stable")
        at, column = at[order], column[order]
        cuts = np.searchsorted(column, np.arange(0, len(both) + STRIP, STRIP))
        for k in range(len(cuts) - 1):
            held = np.zeros((n, min(STRIP, len(both) - k * STRIP)), np.float32)
            held[at[cuts[k] : cuts[k + 1]], column[cuts[k] : cuts[k + 1]] - k * STRIP] = 1
            yield held

    for x, y in zip(strips(at_l, in_l, len(left)), strips(at_r, in_r, len(right)), strict=True):
        count += x @ y.T
    return count


def possible_pairs(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Which pairs of sorted deep sketches (the high 32 bits of each value) don't rule out a link.

    Both sketches are complete up to the smaller of their largest values (a whole set has no
    end), so the values up to there estimate the similarity; of two whole sets they give it.
    Equal high bits of different values take a value or two at most, hence the margin.
    """
    top = np.iinfo(np.uint32).max
    ends = lambda rows: np.array([x[-1] if len(x) == DEEP else top for x in rows], np.uint32)
    upto = lambda rows, tops: np.stack([np.searchsorted(x, tops, "right") for x in rows])
    end_l, end_r = ends(left), ends(right)
    same = shared_counts(left, right)
    union = upto(left, end_r) + upto(right, end_l).T - same
    whole = (end_l == top)[:, None] & (end_r == top)[None, :]
    return same >= np.where(whole, SIMILARITY / 100 - 0.01, DEEP_SHARE) * np.maximum(union, 1)


def joining_links(left: list[tuple], right: list[tuple]) -> list[tuple[int, int]]:
    """Links between ``left`` and ``right`` (node, component, full set) that join different components, one for each join.

    Every pair that sketches don't rule out is verified on full sets, unless links found before have joined its components.
    """
    sets_l, sets_r = ([np.frombuffer(r[2], U64) for r in rows] for rows in (left, right))
    high = lambda rows: [np.unique((x[:DEEP] >> U64(32)).astype(np.uint32)) for x in rows]
    own, at = np.unique(np.array([r[1] for r in left] + [r[1] for r in right], np.int64), return_inverse=True)
    at_l, at_r, label = at[: len(left)], at[len(left) :], np.arange(len(own))
    may, found = possible_pairs(high(sets_l), high(sets_r)), []
    for i in range(len(left)):
        near, x = np.nonzero(may[i])[0], sets_l[i]
        near = near[label[at_r[near]] != label[at_l[i]]]
        while len(near):
            k, near = near[0], near[1:]
            y = sets_r[k]
            same = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * same >= SIMILARITY * (len(x) + len(y) - same):
                found.append((min(left[i][0], right[k][0]), max(left[i][0], right[k][0])))
                label[label == label[at_r[k]]] = label[at_l[i]]
                near = near[label[at_r[near]] != label[at_l[i]]]
    return found


@tidy
def _compare(batches):
    """Rows of one pair of blocks of a list come together; emits the links that join components."""
    held: dict = {"key": None, "left": [], "right": []}

    def flush():
        left, right = held["left"], held["right"]
        held["left"], held["right"] = [], []
        found = joining_links(left, right) if left and right else []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

    for batch in batches:
        for start in range(0, len(batch), 256):
            part = batch.slice(start, 256)
            for key, is_left, is_right, *row in zip(*(part.column(k).to_pylist() for k in range(6)), strict=True):
                if key != held["key"]:
                    yield from flush()
                    held["key"] = key
                for side in ["left"] * is_left + ["right"] * is_right:
                    held[side].append(row)
    yield from flush()


def remaining_links(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between different components within an open list, enough to join all that links join.

    Members outside a list's largest component are compared with all its members, in
    blocks; inside the largest there is nothing left to link.  Rows of a single block are sent once, for both sides.
    """
    placed = lists.join(sets.select("node", "whole"), "node")
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("other")
    key = lambda i, j: F.concat_ws("/", "value", i, j).alias("key")
    row = ["node", "component", "whole"]
    role = lambda is_left, is_right: [is_left.alias("is_left"), is_right.alias("is_right")]
    outside, single = F.col("component") != F.col("largest"), F.col("inner_blocks") * F.col("outer_blocks") == 1
    whole = placed.where(single).select(key(F.lit(0), F.lit(0)), *role(outside, F.lit(True)), *row)
    left = placed.where(~single & outside).select("*", every("inner_blocks")).select(key(block("outer_blocks"), F.col("other")), *role(F.lit(True), F.lit(False)), *row)
    right = placed.where(~single).select("*", every("outer_blocks")).select(key(F.col("other"), block("inner_blocks")), *role(F.lit(False), F.lit(True)), *row)
    return whole.union(left).union(right).repartition("key").sortWithinPartitions("key").mapInArrow(_compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text)``.

    A null or empty text, or one without words, has the empty set and is linked
    with nothing.  Rows that share a doc_id are linked by it, whatever their texts.  Rows
    with a null doc_id are described but linked with nothing, their component_id is null
    and kept is false.  An empty table gives no rows; other columns are not read.
    """
    a = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sketches, "doc_id long, n long, fp1 long, fp2 long, sketch array<long>"), "sketches")
    full = a.where("n > 0 and doc_id is not null")
    classes = stored(full.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("node"), F.first("sketch").alias("sketch")), "classes")
    own = stored(full.select("doc_id", "n", "fp1", "fp2").join(classes.select("fp1", "fp2", "node"), ["fp1", "fp2"]).select("doc_id", "n", "node"), "class-members")
    rest = stored(a.where("n = 0 or doc_id is null").select("doc_id", "n"), "unlinked")
    nodes = stored(repeated_nodes(classes), "repeated-nodes")
    discard(a, classes)
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(nodes, "node", "left_semi").distinct()
    sets = stored(texts.mapInArrow(_sets, "node long, deep array<long>, whole binary").where("octet_length(whole) > 0"), "sets")
    lists = candidate_lists(sets)
    links = stored(linked_pairs(star_pairs(lists), sets).union(_same_id(own)), "links")
    labels = components(links)
    left = open_lists(lists, labels, sets)
    more = stored(remaining_links(left, sets), "links")
    discard(left, lists, sets, nodes)
    if not more.isEmpty():
        labels = components(links.union(more))
    discard(links, more)

    out = own.join(labels, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))
    out = out.union(rest.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def ordered(a: F.Column, b: F.Column) -> list[F.Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _same_id(own: DataFrame) -> DataFrame:
    """Links between the classes that rows of one doc_id belong to."""
    several = own.groupBy("doc_id").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("doc_id")
    return own.join(several, "doc_id").where("node <> doc_id").select(*ordered(F.col("node"), F.col("doc_id")))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_near_duplicates": op1}
