"""Packing, importance resampling and spelling variants against brute-force versions."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgermend.llm import packing, resampling, spelling
from tests.llm.test_llm import DOCS, corpus, docs, nothing, words  # noqa: F401

ODD = ["", None, "a", "don't STOP, now.", "J̌ é ΣΣ", "x\x1cy\xa0z", "<|endoftext|> <|startoftext|>x", "你好 " * 40, "q" * 70_000, "...,,,!!! a.b ,c", "z" * 3 + " " * 5000, "Ä" * 9]


def odd_rows():
    return [*corpus(), *[(1000 + k, t, None, None, None, None) for k, t in enumerate(ODD)], (1003, ODD[3], "en", None, 0, "x")]


ENCODER = packing.Encoder(packing.vocabulary_text())


# -- packing --------------------------------------------------------------------------------


def check_packed(rows, want, capacity):
    """Every id in one piece, sequences without gaps; returns how many ids are padding."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[(r.doc_id, r.doc_tokens)].append(r)
        sequences[r.sequence_id].append(r)
        assert r.length == len(r.ids) // 4 and r.length > 0
    for doc_id, ids in want:
        own = sorted(pieces[(doc_id, len(ids))], key=lambda r: r.start)
        times = sum(1 for d, x in want if d == doc_id and len(x) == len(ids))
        for start in {r.start for r in own}:
            for r in (r for r in own if r.start == start):
                assert np.frombuffer(r.ids, "<u4").tolist() == ids[start : start + r.length]
        assert sum(r.length for r in own) == len(ids) * times
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert sum(r.length for r in rows) == sum(len(x) for _, x in want)
    return padding


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_str(packing.vocabulary_text())


@pytest.mark.parametrize(("capacity", "counts", "limit"), [(2048, None, 0.0), (2048, (2, 3, 5, 8, 64), 0.02), (100, (3, 7, 100, 1000), 0.05)])
def test_packing_holds_every_id_once(spark, tokenizer, capacity, counts, limit):
    rows = odd_rows()
    want = [(r[0], [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1]) for r in rows]
    made = spark.createDataFrame(rows, DOCS).withColumn("ids", F.lit(1)).repartition(3)
    got = packing.pack(made, packing.vocabulary_text(), capacity, counts).collect()
    assert check_packed(got, want, capacity) <= limit * sum(len(x) for _, x in want)


def test_packing_forgets_words_and_keeps_ids(monkeypatch, tokenizer):
    monkeypatch.setattr(packing, "MAX_WORDS", 5)
    encoder = packing.Encoder(packing.vocabulary_text())
    for text in ["one two", "three Four, five six seven", "one two", "", "four"]:
        assert np.frombuffer(encoder.encode(text.encode()), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@settings(deadline=None, max_examples=300)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" '.,stdveÀÉßéÿ̈J̌\x1c\xa0"))))
def test_ids_equal_the_library(tokenizer, text):
    assert np.frombuffer(ENCODER.encode(text.encode()), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_bins_of_a_class_hold_its_count():
    bins = packing.Bins(packing.class_sizes(64, (2, 3, 4)), 10)
    for k in range(40):
        bins.add(k, bytes(4 * (21 if k % 2 else 32)))
    full = Counter(r[5] for r in bins.rows)
    assert set(full.values()) == {2, 3} and bins.next > 10
    bins.finish()
    assert sum(r[2] for r in bins.rows) == 20 * 53
    assert packing.class_sizes(8) == {8: 1, 4: 2, 2: 4, 1: 8} and packing.powers_of(13) == [8, 4, 1]


def test_packing_of_nothing(nothing):  # noqa: F811
    assert packing.pack(nothing, packing.vocabulary_text()).collect() == []


# -- importance resampling ----------------------------------------------------------------------


def plain_features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain_resampled(rows, target, percent):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(plain_features(text)[1])
    for text in target:
        t.update(plain_features(text)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (S + 10000) / ((s[b] + 1.0) * (T + 10000)))) for b in range(10000)]
    out = []
    for doc_id, text in rows:
        n, found = plain_features(text)
        h = int(hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append([n, doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[0] >= 20), key=lambda r: (-r[4], r[1] is None, r[1], r[2]))
    place = {id(r): k + 1 for k, r in enumerate(able[: len(able) * percent // 100])}
    return sorted(([*r[1:], place.get(id(r))] for r in out), key=str)


@pytest.mark.parametrize("percent", [5, 40, 100])
def test_resampling_equals_the_plain_version(spark, percent):
    rows = [(r[0], r[1]) for r in odd_rows()] + [(2000 + k, " ".join(words(30 + k % 5, k % 40, 90))) for k in range(300)]
    target = [" ".join(words(50, k, 60)) for k in range(9)] + [None, ""]
    made = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, rank string")
    got = resampling.resample(made, spark.createDataFrame([(x,) for x in target], "text string"), percent)
    assert sorted(([*r] for r in got.collect()), key=str) == plain_resampled(rows, target, percent)


def test_bins_keep_the_order_of_scores(spark):
    values = sorted({s * (1 << k) + d for k in range(0, 62, 3) for d in (-1, 0, 1) for s in (-1, 1)})
    made = spark.createDataFrame([(v,) for v in values], "v long").select("v", resampling.bin_of(F.col("v")).alias("b")).orderBy("v").collect()
    assert all(x.b <= y.b for x, y in zip(made, made[1:], strict=False))


def test_resampling_of_nothing(spark, nothing):  # noqa: F811
    assert resampling.resample(nothing, nothing).collect() == []
    few = spark.createDataFrame([(1, "few words")], "doc_id long, text string")
    assert [r["rank"] for r in resampling.resample(few, nothing).collect()] == [None]


# -- spelling variants ------------------------------------------------------------------------


def plain_groups(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}

    def edits(w):
        return {w[:k] + "*" + w[k + 1 :] for k in range(len(w))}

    cut, masked = defaultdict(set), defaultdict(set)
    for w in n:
        for m in edits(w):
            masked[m].add(w)
        for k in range(len(w)):
            cut[w[:k] + w[k + 1 :]].add(w)
    near = {w: ({x for m in edits(w) for x in masked[m]} | cut[w] | {w[:k] + w[k + 1 :] for k in range(len(w)) if w[:k] + w[k + 1 :] in n}) - {w} for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def mutated(rng, word):
    k = int(rng.integers(0, len(word) + 1))
    letter = "abcdeÀéß÷"[int(rng.integers(0, 9))]
    return [word[:k] + letter + word[k:], word[: k - 1] + word[k:] if k else word[1:], (word[: k - 1] + letter + word[k:]) if k else letter + word[1:]][int(rng.integers(0, 3))]


@pytest.mark.parametrize("tile_letters", [spelling.TILE_LETTERS, 30])
def test_groups_equal_all_pairs(monkeypatch, spark, tile_letters):
    monkeypatch.setattr(spelling, "TILE_LETTERS", tile_letters)
    rng = np.random.default_rng(3)
    base = ["".join(rng.choice(list("abcdelmnoé"), int(rng.integers(7, 12)))) for _ in range(30)] + ["x" * 1500, "Straßenbahn", "aaaaaaaa"]
    texts = []
    for k in range(120):
        picked = [base[int(x)] for x in rng.integers(0, 33, 40)]
        texts.append(" ".join(mutated(rng, w) if rng.random() < 0.2 else w for w in picked))
    texts += [" ".join([w] * 200) for w in base[:3]] + [" ".join([mutated(rng, base[0])] * 15) for _ in range(20)]
    texts += [" ".join(["chainlink"] * 25)] * 40 + [" ".join(["chainlonk"] * 15)] * 5 + ["chainlomk", "chainlomk", "chainlomk"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(r[0], r[1]) for r in odd_rows()] + [(None, texts[0])]
    got = spelling.group(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, word string"))
    want = plain_groups(rows)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    assert any(r[1] and r[2] != r[1] for r in want) and any(len(r[0]) > 1000 for r in want)


def test_no_words(spark, nothing):  # noqa: F811
    assert spelling.group(nothing).collect() == []
    assert spelling.group(spark.createDataFrame([(1, None), (2, ""), (3, "short words only")], "doc_id long, text string")).collect() == []
