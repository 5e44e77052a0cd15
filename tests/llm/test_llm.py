"""The numbered operators against brute-force versions, with the odd cases each defines."""

import hashlib
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from ledgermend.llm import ann, decontam, language, mixing, neardup, phrases, suffixes, tokens, toolcalls, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def words(n, seed=0, pool=400):
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, pool, n)]


def corpus():
    base, other, shared = words(120, 1), words(90, 2), words(60, 3)
    near = base.copy()
    near[50] = "changed"
    texts = [
        " ".join(base), " ".join(near), " ".join(base), " ".join(other + shared), " ".join(shared + words(40, 4)), None, "", " \n ", "a b c", "A b  C",
        "the only one", " ".join(words(3000, 5, 10**6)), " ".join(["und"] * 300), "Ünïcödé " * 30, "\x0b".join(words(80, 6)), " ".join(base[:100] + words(20, 7)),
    ]
    rows = [(k, t, None if k % 7 == 0 else "en", None if k % 5 == 0 else f"s{k % 3}", k, "x") for k, t in enumerate(texts)]
    return [*rows, (3, texts[3], "en", "s0", 0, "again"), (None, texts[0], None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


# -- near duplicates ---------------------------------------------------------------------


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = {}
    for k, t in rows:
        if k is not None:
            sets.setdefault(k, []).append(shingles(t))
    least = {k: k for k in sets}
    linked = [(a, b) for a, b in combinations(sorted(sets), 2) if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b])]
    for _ in sets:
        for a, b in linked:
            least[a] = least[b] = min(least[a], least[b])
    return least


def test_near_duplicates(spark, docs, nothing):
    want = brute_components((r[0], r[1]) for r in corpus())
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(corpus())
    for r in got:
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None)
        assert r.kept == (r.doc_id is not None and want[r.doc_id] == r.doc_id)
    assert {r.doc_id: r.n_shingles for r in got}[8] == 1
    assert neardup.near_duplicates(nothing).collect() == []


def test_chain_of_near_copies_is_one_component(spark):
    """A large group in which far members are linked only through others."""
    chain, text = [], words(200, 11, 10**6)
    for k in range(120):
        chain.append((k, " ".join(text), None, None, None, None))
        text = text.copy()
        text[(k * 7) % 200] = f"new{k}"
    got = neardup.near_duplicates(spark.createDataFrame(chain, DOCS)).collect()
    want = brute_components((r[0], r[1]) for r in chain)
    assert {r.doc_id: r.component_id for r in got} == want and set(want.values()) == {0}


def test_links_of_a_group_join_it_and_are_no_more():
    """Near copies that all link with each other, those of another text, and a pair just under the similarity."""
    base = np.arange(1, 2001, dtype=np.uint64) << np.uint64(33)
    near = lambda first, k: np.unique(np.concatenate([first[k:], np.arange(k, dtype=np.uint64) + first[-1] + np.uint64(1000 * k)]))
    rows = [(k, k, near(base, k).tobytes()) for k in range(40)] + [(100 + k, 100 + k, near(base + np.uint64(1 << 45), k).tobytes()) for k in range(40)]
    found = neardup.joining_links(rows, rows)
    least = {r[0]: r[0] for r in rows}
    for _ in rows:
        for a, b in found:
            least[a] = least[b] = min(least[a], least[b])
    assert least == {r[0]: r[0] // 100 * 100 for r in rows} and len(found) == 78
    same = 1500 * 2 * 75 // 175
    under = [(k, k, np.concatenate([base[:same], base[same:1500] + np.uint64(k)]).tobytes()) for k in range(2)]
    assert neardup.joining_links(under[:1], under[1:]) == []
    over = [(k, k, np.concatenate([base[: same + 1], base[same + 1 : 1500] + np.uint64(k)]).tobytes()) for k in range(2)]
    assert neardup.joining_links(over[:1], over[1:]) == [(0, 1)]


def test_common_line_links_nothing(spark):
    line = " ".join(words(10, 12))
    rows = [(k, line + " " + " ".join(words(60, 100 + k, 10**6)), None, None, None, None) for k in range(80)]
    assert all(r.kept for r in neardup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect())


# -- mixing ----------------------------------------------------------------------------------


def test_small_sources_come_near_their_targets(spark):
    texts = [("a", "x " * 12), ("b", "y " * 10), ("c", "z " * 3), (None, None)]
    rows = [(k, t, s) for k, (s, t) in enumerate(texts)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.doc_id: (r.size, r.target) for r in got} == {0: (12, 23.625), 1: (10, 7.875), 2: (3, 6.0), 3: (0, 0.0)}
    assert all(abs(r.taken - r.target) <= 1 and r.taken <= 2 * r.size for r in got)


def test_mix_targets_and_limits(spark, docs, nothing):
    got = mixing.mix(docs.drop("extra")).collect()
    assert len(got) == len(corpus())
    rows = {}
    for k, t, _, s, _, _ in corpus():
        rows.setdefault(s, []).append(len(WORD.findall(t or "")))
    order = sorted((s for s in rows if s is not None)) + [None]
    size, weight = {s: sum(rows[s]) for s in order}, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left = dict.fromkeys(order, 0.0), set(order)
    while True:
        level = (1.5 * sum(size.values()) - sum(2 * size[s] for s in order if s not in left)) / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] > 2 * size[s]}
        if not over:
            break
        left -= over
    target = {s: level * weight[s] if s in left else 2.0 * size[s] for s in order}
    assert sorted({(r.source_size, round(r.target, 6)) for r in got}) == sorted({(size[s], round(target[s], 6)) for s in order})
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
    assert sum(r.taken for r in got) == pytest.approx(1.5 * sum(size.values()), rel=0.05)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs.repartition(5)).collect()))
    assert mixing.mix(nothing).collect() == []


@pytest.mark.parametrize("weights,seats", [([5, 3, 1], 7), ([1, 1, 1], 2), ([1000, 1, 1, 1], 50), ([7], 3), ([3, 0, 2], 4)])
def test_apportion_equals_highest_quotients(spark, weights, seats):
    rows = spark.createDataFrame([(1, k, float(w), seats) for k, w in enumerate(weights)], "g int, p int, w double, s int")
    got = {r.p: r.quota for r in mixing.apportion(rows, ["g"], "p", "w", "s").collect()}
    quotients = sorted(((-w / (2 * j - 1), k) for k, w in enumerate(weights) if w for j in range(1, seats + 1)))[:seats]
    want = Counter(k for _, k in quotients)
    assert got == {k: want.get(k, 0) for k in range(len(weights))}


# -- language ----------------------------------------------------------------------------------


def test_language(spark, nothing):
    samples = {"en": "the house and the garden with", "de": "das haus und der garten mit nicht", "fr": "la maison et le jardin avec une"}
    rng = np.random.default_rng(0)
    rows = [(k, " ".join(rng.permutation(samples[lang].split() * 3)), lang, None, None, None) for k, lang in enumerate(list(samples) * 40)]
    rows += [(1000, None, "en", None, None, None), (1001, "12 34 !!", "en", None, None, None), (1002, "", None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    marked = df.withColumn("held_out", language.held_out(df))
    model = language.fit(marked.where(~F.col("held_out")))
    got = {r.doc_id: r for r in language.identify(marked, model, ["doc_id", "held_out"]).collect()}
    assert all(got[k].lang_pred == r[2] for k, r in enumerate(rows[:120]))
    assert [got[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3 and got[1000].score == 0
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k in got)
    unknown = language.fit(nothing)
    assert {r.lang_pred for r in language.identify(df, unknown, ["doc_id"]).collect()} == {"und"}


def test_grams_stay_inside_texts():
    points = np.array([ord(c) for c in "abcde"], np.uint32)
    firsts = np.array([0, 2, 2, 3, 5])
    for width, want in ((1, [2, 0, 1, 2]), (2, [1, 0, 0, 1]), (3, [0, 0, 0, 0])):
        bins, counts, _ = language.gram_bins(points, firsts, width)
        assert counts.tolist() == want and len(bins) == sum(want)


# -- decontamination -----------------------------------------------------------------------------


def test_decontamination(spark, docs, nothing):
    item, short = words(40, 21, 10**6), ["short", "item", "of", "six", "plain", "words"]
    swapped = item.copy()
    for k in (3, 11, 19, 30):
        swapped[k] = f"sub{k}"
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(short)), (3, None), (None, "x y z"), (4, "")], "item_id long, text string")
    rows = [
        (1, " ".join(words(30, 22) + item + words(30, 23)), True), (2, " ".join(words(30, 24) + swapped), True), (3, " ".join(words(100, 25, 10**6)), False),
        (4, "Some SHORT, item of six: plain words!", True), (5, None, False), (6, "", False), (7, " ".join(item[:6]) + " other", False),
    ]
    df = spark.createDataFrame([(k, t, "en", "s", 0, "x") for k, t, _ in rows], DOCS)
    got = {r.doc_id: r for r in decontam.decontaminate(df, bench, ["doc_id"]).collect()}
    assert {k: got[k].contaminated for k in got} == {k: c for k, _, c in rows}
    assert (got[1].best_item, got[1].best_overlap, got[2].best_overlap) == (1, 1.0, 0.9)
    assert decontam.decontaminate(nothing, bench, ["doc_id"]).collect() == []
    assert not any(r.contaminated for r in decontam.decontaminate(docs, bench.limit(0), ["doc_id"]).collect())


def test_short_items_equal_brute_force(spark):
    rng = np.random.default_rng(31)
    items = {n: [f"i{n}x{k}" for k in range(n)] for n in range(1, 17)}
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    texts = []
    for n, w in items.items():
        for _ in range(40):
            copy = [f"z{x}" if rng.random() < 0.2 else word for word, x in zip(w, rng.integers(0, 9, n))]
            texts.append([*words(int(rng.integers(0, 3)), 33), *copy[int(rng.integers(0, 2)) :], *words(int(rng.integers(0, 3)), 34)])

    def leaks(text, item):
        for shift in range(-len(item), len(text)):
            run = 0
            for k, word in enumerate(item):
                run = max(0, run + (1 if 0 <= shift + k < len(text) and text[shift + k] == word else -1))
                if run >= min(10, -(-6 * len(item) // 10)):
                    return True
        return False

    df = spark.createDataFrame([(k, " ".join(t), "en", "s", 0, "x") for k, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.n_items for r in decontam.decontaminate(df, bench, ["doc_id"]).collect()}
    want = {k: sum(leaks(t, w) for w in items.values()) for k, t in enumerate(texts)}
    assert got == want and 0 < sum(want.values()) < len(texts)


# -- repeated words ----------------------------------------------------------------------------------


def test_substring_dedup(spark, docs, nothing):
    rows = [(r[0], r[1], WORD.findall(r[1] or "")) for r in corpus()]
    count = Counter(tuple(w[i : i + 35]) for _, _, w in rows for i in range(len(w) - 34))
    want = Counter()
    for k, _, w in rows:
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if count[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        want[(k, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())] += 1
    got = Counter(tuple(r) for r in phrases.remove_repeats(docs, ["doc_id"]).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == want
    assert phrases.remove_repeats(nothing, ["doc_id"]).collect() == []
    texts = {r.doc_id: r.kept_text for r in phrases.remove_repeats(docs, ["doc_id", "extra"], with_text=True).collect()}
    assert texts[9] == "A b  C" and texts[5] is None


# -- nearest neighbours -----------------------------------------------------------------------------


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 16))
    x[100:300] = x[7]  # a crowd of copies
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [None] + [1.0] * 15), (904, [1.0] * 3)]
    rows = [(k, [float(v) for v in r], 1) for k, r in enumerate(x)] + [(k, v, 1) for k, v in odd]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = total = 0
    for q in range(0, 600, 50):
        near = u @ u[q]
        near[q] = -9
        want = sorted(range(600), key=lambda k: (-round(near[k], 12), k))[:5]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        assert all(abs(s - near[v]) < 1e-12 for _, v, s in mine)
        hits, total = hits + len(set(want) & {v for _, v, _ in mine}), total + 5
    assert hits / total >= 0.9 and set(got) == set(range(0, 600, 50))
    assert ann.search(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


# -- archives ------------------------------------------------------------------------------------------


def test_archives_round_trip(spark, tmp_path):
    long = "<p>" + "x" * 200 + "é</p>"
    rows = [(1, "http://a/ b", long), (2, None, long), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (None, "u", long), (6, "u", "a\r\n\r\nWARC/1.1\r\nb" + "y" * 100)]
    path = f"file://{tmp_path}/w"
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(spark, path).where("kind = 'record'").collect()}
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    size = lambda t: len((t or "").encode())
    first = {1: None, 2: 1, None: 1}
    assert got == {(k, size(t), digest(t), "revisit" if first.get(k) else "response", first.get(k)) for k, _, t in rows}
    assert warc.read_archives(spark, path).where("kind = 'gap'").count() == 0


def record(n, payload):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nWARC-Payload-Digest: sha256:%s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (n, hashlib.sha256(payload).hexdigest().encode(), len(block), block)


@pytest.mark.parametrize("pack", [lambda r: r, __import__("gzip").compress])
def test_salvage_skips_damage_and_covers_all_bytes(pack):
    parts = [pack(record(k, b"payload %d " % k * 20)) for k in range(5)]
    broken = bytearray(b"".join(parts))
    at = len(parts[0]) + len(parts[1]) // 2
    broken[at : at + 4] = b"\0\0\0\0"
    data = b"junk\n" + bytes(broken)[:-3] + b"tail"
    found = list(warc.salvage(data))
    assert [f[3]["warc-record-id"] for f in found if f[0] == "record"][:3] == ["<urn:page:0>", "<urn:page:2>", "<urn:page:3>"]
    assert found[0][:3] == ("gap", 0, 5)
    assert found[0][1] == 0 and found[-1][2] == len(data) and all(a[2] == b[1] for a, b in zip(found, found[1:]))


# -- suffix arrays --------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=25), min_size=1, max_size=5))
def test_suffix_ranks(texts):
    closed = [[*t, 0] for t in texts]
    rank = suffixes.suffix_ranks(np.concatenate([np.array(t, np.int16) for t in closed]), np.array([len(t) for t in closed]))
    at = 0
    for t in closed:
        order = sorted(range(len(t)), key=lambda i: t[i:])
        assert [int(r) - at for r in rank[at : at + len(t)]] == [order.index(i) for i in range(len(t))]
        at += len(t)


def test_suffix_dedup(spark, docs, nothing):
    rows = [(r[0], (r[1] or "").encode()) for r in corpus()]
    big = 10**9
    first: dict = {}
    for k, b in rows:
        for i in range(len(b) - 49):
            w = b[i : i + 50]
            first[w] = min(first.get(w, big), big - 1 if k is None else k)
    want = Counter()
    for k, b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < (big - 1 if k is None else k):
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[(k, len(b), sum(gone), len([1 for s in bytes(gone).split(b"\0") if s]), hashlib.sha256(kept).hexdigest())] += 1
    got = Counter(tuple(r) for r in suffixes.remove_later_copies(docs, ["doc_id"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == want
    assert suffixes.remove_later_copies(nothing, ["doc_id"]).collect() == []


# -- tool calls -------------------------------------------------------------------------------------------


def test_tool_calls(spark):
    schema = "conv_id long, turn long, role string, text string, call_id string, name string, arguments string, depends_on array<string>, extra string"
    tools = {"get": {"x": ("integer", True), "tags": ("array", False)}}
    rows = [
        (1, 0, "assistant", None, "a", "get", '{"tags": [2, 1], "x": 1}', [], None), (1, 1, "tool", "r", "a", None, None, None, None),
        (1, 2, "tool", "early", "b", None, None, None, None), (1, 5, "assistant", None, "b", "get", '{"x": "no"}', ["c"], None),
        (1, 7, "assistant", None, "c", "get", '{"x": 1, "y": 2}', [], None), (1, 8, "tool", "late", "c", None, None, None, None),
        (1, 9, "tool", "lost", "zz", None, None, None, None), (1, 10, "assistant", None, "d", "none", "{", [], None), (2, 0, "user", 'say "hi"', None, None, None, None, None), (2, 1, "user", None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {(r.conv_id, r.turn): r for r in toolcalls.link(df, tools).collect()}
    assert [got[1, t].valid for t in (0, 5, 7, 10)] == [True, False, False, False]
    assert got[1, 0].json == '{"arguments":{"tags":[2,1],"x":1},"id":"a","name":"get","role":"assistant"}'
    assert (got[1, 9].linked, got[1, 2].linked, got[2, 0].linked) == (False, True, None)
    assert got[2, 0].json == '{"content":"say \\"hi\\"","role":"user"}' and got[2, 1].json == '{"content":null,"role":"user"}'
    order = [t for _, t in sorted((k for k in got if k[0] == 1), key=lambda k: (got[k].sort_turn, got[k].sort_step, k[1]))]
    assert order.index(5) > order.index(8) > order.index(7) and order.index(2) > order.index(5) > order.index(0)
    assert toolcalls.link(df.limit(0), tools).collect() == []


# -- toxicity ----------------------------------------------------------------------------------------------


def test_toxicity(spark):
    rng = np.random.default_rng(5)
    bad = ["idiot", "moron", "vequaire", "vequno"]
    rows, labels = [], []
    for k in range(400):
        w = [f"word{x}" for x in rng.integers(0, 50, 60)]
        if k % 4 == 0:
            w[10], w[30] = bad[k // 4 % 4], bad[(k // 4 + 1) % 4]
        rows.append((k, " ".join(w), "en", "s", 0, "x"))
        labels.append((k, 1, int(k % 4 == 0)))
    rows += [(1000, "you 1d10t m0r0n", "en", "s", 0, "x"), (1001, None, "en", "s", 0, "x"), (1002, "", "en", "s", 0, "x"), (1003, "ѕuch an іdіоt", "en", "s", 0, "x")]
    df = spark.createDataFrame(rows, DOCS)
    labelled = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(toxicity.training_rows(df, labelled).cache())
    got = {r.doc_id: r for r in toxicity.score(df, model, ["doc_id"]).collect()}
    assert all(got[k].predicted == t for k, _, t in labels)
    assert (got[1000].predicted, got[1001].predicted, got[1002].predicted, got[1003].predicted) == (1, 0, 0, 1)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_toxic_words_that_come_with_others_are_learned(spark):
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for k in range(400):
        w = [f"word{x}" for x in rng.integers(0, 50, 60)]
        if k % 4 == 0:
            w[10], w[30] = "idiot", ("moron", "scum")[k // 4 % 2]  # each text with moron or scum holds idiot
        rows.append((k, " ".join(w), "en", "s", 0, "x"))
        labels.append((k, 1, int(k % 4 == 0)))
    copied = " ".join(["idiot", *[f"copied{x}" for x in "abcdefghij"], *words(40, 7)])
    rows += [(k, copied, "en", "s", 0, "x") for k in range(500, 520)]
    labels += [(k, 1, 1) for k in range(500, 520)]
    rows += [(1000, "you moron", "en", "s", 0, "x"), (1001, "such scum here", "en", "s", 0, "x"), (1002, "a clean text", "en", "s", 0, "x")]
    df = spark.createDataFrame(rows, DOCS)
    model = toxicity.fit(toxicity.training_rows(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).cache())
    got = {r.doc_id: r.predicted for r in toxicity.score(df, model, ["doc_id"]).collect()}
    assert (got[1000], got[1001], got[1002]) == (1, 1, 0)
    assert not [t for t in model.terms if t.startswith("copied")]


def test_choose_terms_drops_only_what_decides_nothing():
    assert toxicity.choose_terms([("idio", 5.0), ("idiot ", 5.0), ("lose", 3.5), ("loser ", 6.0), ("scum ", 4.0)]) == {"idio": 5.0, "lose": 3.5, "loser ": 6.0, "scum ": 4.0}


def test_exception_phrases_cancel():
    built = toxicity.automaton({"clown ": 5.0})
    assert toxicity.measures("a clown fish", built, {"clown fish"}) == (0.0, 0.0)
    assert toxicity.measures("a clown here", built, {"clown fish"})[0] > 0
    assert toxicity.measures("clownish", built, set())[0] == 0


# -- pipeline ---------------------------------------------------------------------------------------------


def test_pipeline(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(words(90, 2)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept, seen = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, str(tmp_path)).collect(), docs.schema)
        assert kept.columns == docs.columns
        seen.append({r.doc_id for r in kept.select("doc_id").collect()})
    assert not {5, 6, 7} & seen[0] and {1, 2}.isdisjoint(seen[1]) and 0 in seen[1]
    assert 3 not in seen[3]
    assert len(corpus_pipeline.run(spark, str(tmp_path)).collect()) == len(seen[3] - {None}) + (None in seen[3])


def test_words_of_every_kernel():
    raw = "a\x1cb \x0bc d  e".encode()
    starts, ends, firsts = tokens.word_spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert [raw[a:b].decode() for a, b in zip(starts, ends)] == WORD.findall(raw.decode()) and firsts.tolist() == [0, len(starts)]
