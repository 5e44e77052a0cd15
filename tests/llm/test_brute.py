"""Language ID, decontamination, toxicity, nearest neighbours, archives and tool calls against plain versions."""

import base64
import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgermend.llm import ann, blocks, decontam, language, phrases, suffixes, toolcalls, toxicity, warc
from tests.llm.test_llm import DOCS, nothing, record, words  # noqa: F401

M64 = (1 << 64) - 1


# -- language ------------------------------------------------------------------------------


def plain_bin(gram):
    h = len(gram) * 0x9E3779B1
    for c in gram:
        h = ((h ^ ord(c)) * 0xD6E8FEB86659FD93) & M64
        h ^= h >> 32
    return h >> (64 - language.BITS)


def plain_grams(text):
    text = (text or "").lower()
    return [text[i : i + w] for w in language.GRAMS for i in range(len(text) - w + 1)]


def test_language_equals_scalar_naive_bayes(spark, nothing):  # noqa: F811
    rng = np.random.default_rng(9)
    sounds = {"aa": "abcde", "bb": "cdefg", "cc": "efgha"}
    text = lambda lang, n: " ".join("".join(rng.choice(list(sounds[lang]), 4)) for _ in range(n))
    rows = [(k, text(lang, 12), lang, None, None, None) for k, lang in enumerate(list(sounds) * 20)]
    odd = ["", None, "e", "Éé", "12 3", text("aa", 30_000), text("bb", 3), text("bb", 3), "ghİgh", "e1"]
    rows += [(500 + k, t, None, None, None, None) for k, t in enumerate(odd)] + [rows[0]]
    docs = spark.createDataFrame(rows, DOCS)
    model = language.fit(docs)
    counts = {x: {} for x in sounds}
    for r in rows:
        if r[2]:
            for g in plain_grams(r[1]):
                counts[r[2]][plain_bin(g)] = counts[r[2]].get(plain_bin(g), 0) + 1
    smooth = language.SMOOTH
    total = {x: sum(c.values()) + smooth * language.BINS for x, c in counts.items()}
    got = language.identify(docs, model, ["doc_id", "text"]).collect()
    assert len(got) == len(rows)
    for r in got:
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        if r.text and len(r.text) > 10_000:
            assert r.lang_pred == "aa" and r.score > 0.99
            continue
        logs = {x: sum(math.log((counts[x].get(plain_bin(g), 0) + smooth) / total[x]) for g in plain_grams(r.text)) for x in sorted(sounds)}
        top = max(logs.values())
        assert logs[r.lang_pred] >= top - 1e-3
        assert abs(r.score - 1 / sum(math.exp(v - top) for v in logs.values())) < 1e-3
    same = language.Model(["p", "q"], np.zeros((language.BINS, 2), np.float32))
    assert {(r.lang_pred, r.score) for r in language.identify(docs.where("doc_id < 9"), same, ["doc_id"]).collect()} == {("p", 0.5)}
    assert language.identify(nothing, model, ["doc_id"]).collect() == []


# -- decontamination --------------------------------------------------------------------------


def test_long_items_equal_alignment_of_all_pairs(spark):
    rng = np.random.default_rng(17)
    items = {n: words(n, n, 10**6) for n in (17, 24, 40, 90)}
    texts = [[], words(70_000, 50, 10**6) + items[24]]
    for n, item in items.items():
        for k in range(25):
            copy = [f"z{x}" if rng.random() < 0.004 * k else w for w, x in zip(item, rng.integers(0, 9, n))]
            start, stop = int(rng.integers(0, n // 2)), n - int(rng.integers(0, n // 3))
            texts.append([*words(5, k, 10**6), *copy[start:stop], *words(5, 99, 10**6)])
    texts += [texts[-1], items[17] + items[17] + items[90]]

    def score(text, item):
        best = 0
        where = {}
        for k, w in enumerate(text):
            where.setdefault(w, []).append(k)
        for shift in {p - k for k, w in enumerate(item) for p in where.get(w, ())}:
            run = 0
            for k, w in enumerate(item):
                run = max(0, run + (1 if 0 <= shift + k < len(text) and text[shift + k] == w else -1))
                best = max(best, run)
        return best

    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    docs = spark.createDataFrame([(k, " ".join(t), "en", "s", 0, "x") for k, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.n_items for r in decontam.decontaminate(docs, bench, ["doc_id"]).collect()}
    want = {k: sum(score(t, w) >= 10 for w in items.values()) for k, t in enumerate(texts)}
    assert got == want and got[1] == 1 and got[len(texts) - 1] == 2


def test_repetitive_texts_take_little_memory():
    import tracemalloc

    import pyarrow as pa

    for own in ("und", "a b", "a b c"):
        text, item = (" ".join((own.split() * n)[:n]) for n in (20_000, 2000))
        bench = decontam.build(pa.table({"item_id": [1, 2], "text": [item, " ".join(words(50, 3, 10**6))]}))
        tracemalloc.start()
        n_items, best, best_item = decontam.judged(pa.RecordBatch.from_pydict({"text": [text, "other " + item, "und a b c"]}), bench)
        assert tracemalloc.get_traced_memory()[1] < 200e6
        tracemalloc.stop()
        assert n_items.tolist() == [1, 1, 0] and best.tolist() == [1.0, 1.0, 0.0] and best_item == [1, 1, None]


def test_a_large_benchmark_gives_the_same_by_a_join(monkeypatch, spark):
    rng = np.random.default_rng(23)
    items = [words(int(n), int(n), 300) for n in rng.integers(1, 60, 40)] + [[], words(30, 5, 10**6), ["und"] * 40]
    texts = [words(80, 900 + k, 300) + items[k % 43] + words(9, k, 300) for k in range(60)] + [["und"] * 300, [], *[items[41]] * 3]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(None, "x")], "item_id long, text string")
    docs = spark.createDataFrame([(k, " ".join(t), "en", "s", 0, "x") for k, t in enumerate(texts)] + [(None, None, None, None, None, None)], DOCS)
    found = lambda: sorted(map(tuple, decontam.decontaminate(docs, bench, ["doc_id", "extra"]).select("doc_id", "text", "n_items", "best_item", "best_overlap", "contaminated", "extra").collect()), key=str)
    want = found()
    monkeypatch.setattr(decontam, "BLOCK_TOKENS", 300)
    assert found() == want and sum(r[-2] for r in want) >= 40


def test_best_item_on_ties_is_the_smallest(spark):
    item = " ".join(words(20, 1, 10**6))
    bench = spark.createDataFrame([(7, item), (3, item), (3, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, item, "en", "s", 0, "x")] * 2, DOCS)
    assert [(r.best_item, r.best_overlap) for r in decontam.decontaminate(docs, bench, ["doc_id"]).collect()] == [(3, 1.0)] * 2


# -- repeated words and bytes -------------------------------------------------------------------


def test_passages_are_found_by_the_automaton(monkeypatch, spark):
    shared = " ".join(words(50, 3))
    rows = [(k, shared + " " + " ".join(words(40, 60 + k, 10**6)), "en", "s", 0, "x") for k in range(2)]
    docs = spark.createDataFrame(rows, DOCS)
    assert {r.n_removed for r in phrases.remove_repeats(docs, ["doc_id"]).collect()} == {50}
    built = phrases.passage_automaton([b"a b c", b"b c d e"])
    w = phrases.Windows(np.frombuffer(b"x a b c d e a b\tc", np.uint8), np.array([0, 17]))
    assert sorted(zip(*(x.tolist() for x in phrases.occurrences(built, w)))) == [(1, 4), (2, 6), (6, 9)]
    assert len(phrases.occurrences(phrases.passage_automaton([]), w)[0]) == 0


def test_hot_phrases_change_nothing(monkeypatch, spark):
    """A line that all documents hold, and a passage with changing surroundings, on either side of HOT."""
    line, passage = words(12, 1), words(30, 2)
    texts = [words(20, 10 + k // 2, 10**6) + line + passage + words(20, 90 + k // 3, 10**6) for k in range(40)]
    docs = spark.createDataFrame([(k, " ".join(t), "en", "s", 0, "x") for k, t in enumerate(texts)], DOCS)
    plain = sorted(map(tuple, phrases.remove_repeats(docs, ["doc_id"]).collect()))
    cut = sorted(map(tuple, suffixes.remove_later_copies(docs, ["doc_id"]).collect()))
    count = {}
    for t in texts:
        for i in range(len(t) - 34):
            count[tuple(t[i : i + 35])] = count.get(tuple(t[i : i + 35]), 0) + 1
    for k, t in enumerate(texts):
        gone = {j for i in range(len(t) - 34) if count[tuple(t[i : i + 35])] > 1 for j in range(i, i + 35)}
        assert plain[k][:3] == (k, len(t), len(gone))
    assert 0 < sum(r[2] for r in plain) < sum(r[1] for r in plain)
    source = phrases.common_keys
    monkeypatch.setattr(phrases, "_common_phrases", lambda shard, rows: source(shard, rows, many=5))
    assert sorted(map(tuple, phrases.remove_repeats(docs, ["doc_id"]).collect())) == plain
    first = suffixes._first_answers
    monkeypatch.setattr(suffixes, "_first_answers", lambda shard, rows: first(shard, rows, hot=5))
    assert sorted(map(tuple, suffixes.remove_later_copies(docs, ["doc_id"]).collect())) == cut


# -- nearest neighbours --------------------------------------------------------------------------


@pytest.mark.parametrize("clusters", [0, 60])
def test_recall_with_part_of_the_cells_and_repeated_rows(monkeypatch, spark, clusters):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 16))
    if clusters:
        x = rng.normal(size=(clusters, 16))[rng.integers(0, clusters, 2000)] + 0.05 * x
    probed = []
    needed = ann.probes_needed
    monkeypatch.setattr(ann, "probes_needed", lambda *a: probed.append(needed(*a)) or probed[-1])
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)]
    rows += [rows[110], rows[110], rows[50], (110, [float(v) for v in x[111]])]
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    cells = round(2000**0.5)
    assert probed[0] < cells and (not clusters or probed[0] < cells / 4)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 2000, 50):
        near = u @ u[q]
        near[110] = max(near[110], near[111])
        near[q] = -9
        mine = sorted(got[q])
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and len({m[1] for m in mine}) == 5
        hits += len({m[1] for m in mine} & set(np.argsort(-near)[:5].tolist()))
    assert hits / (5 * 40) >= 0.95


@pytest.mark.parametrize("wide", [0.0, 0.5])
def test_recall_in_crowds_of_almost_equal_vectors(spark, wide):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4, 16))[rng.integers(0, 4, 2000)] + 1e-4 * rng.normal(size=(2000, 16))
    lone = rng.random(2000) < wide
    x[lone] = rng.normal(size=(lone.sum(), 16))
    got = {}
    for r in ann.search(spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u[::50] @ u.T
    near[np.arange(40), np.arange(0, 2000, 50)] = -9
    assert sum(len(got[50 * k] & set(np.argsort(-n)[:5].tolist())) for k, n in enumerate(near)) / 200 >= 0.93


def test_cosines_of_extreme_vectors(spark):
    rows = [(0, [1e200, 2e200, 0.0]), (1, [1e200, 2.1e200, 0.0]), (2, [1e-200, 3e-200, 1e-200]), (3, [0.0, 0.0, 5e-324]), (4, [3.0, 1.0, 0.0]), (50, [1e-200, 2e-200, 0.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()

    def cosine(a, b):
        a, b = (np.array(v) / max(v) for v in (a, b))
        return float(a @ b / np.sqrt((a @ a) * (b @ b)))

    vectors = dict(rows)
    for q in (0, 50):
        want = sorted(((-round(cosine(vectors[q], v), 12), k) for k, v in rows if k != q))
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[1] for m in mine] == [k for _, k in want] and all(abs(m[2] + w[0]) < 1e-11 for m, w in zip(mine, want, strict=True))


# -- archives ---------------------------------------------------------------------------------------


def test_digests_in_base_32_and_unknown_ones():
    payload = b"<html>x</html>"
    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    make = lambda label, body=block: b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Payload-Digest: %s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (label, len(body), body)
    sha1 = base64.b32encode(hashlib.sha1(payload).digest())
    for label, kind in ((b"sha1:" + sha1, "record"), (b"SHA-1:" + sha1.lower(), "record"), (b"sha1:" + hashlib.sha1(payload).hexdigest().upper().encode(), "record"), (b"crc:1", "record"), (b"sha1:" + sha1[::-1], "gap")):
        assert [f[0] for f in warc.salvage(make(label))] == [kind], label
    coded = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n0\r\n\r\n"
    assert [f[0] for f in warc.salvage(make(b"sha1:" + sha1, coded))] == ["record"]
    assert [f[0] for f in warc.salvage(record(1, payload))] == ["record"]


def test_repeated_pages_and_large_ones_are_all_written(spark, tmp_path):
    rows = [(1, "u", "x" * 150), (1, "u", "x" * 150), (2, "u", "x" * 150), (3, "u", "y" * 3_000_000)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/w")
    got = sorted((r.page_id, r.record_type, r.payload_bytes) for r in warc.read_archives(spark, f"file://{tmp_path}/w").collect())
    assert got == [(1, "response", 150), (1, "response", 150), (2, "revisit", 150), (3, "response", 3_000_000)]
    none = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(none, f"file://{tmp_path}/none")
    assert warc.read_archives(spark, f"file://{tmp_path}/none").collect() == []


# -- tool calls -----------------------------------------------------------------------------------------


def plain_order(calls, needs):
    """Places by depth-first search; a call that reaches a cycle is unresolved."""
    state, at = {}, {}

    def resolve(c):
        if c in state:
            return state[c] == "done"
        state[c] = "open"
        good = all([resolve(d) for d in needs.get(c, ()) if d in calls])
        state[c] = "done" if good else "stuck"
        return good

    def place(c):
        if c not in at:
            own, _ = calls[c]
            ready = [own]
            for d in needs.get(c, ()):
                if d in calls and state[d] == "done":
                    there, answered = place(d), calls[d][1]
                    done = max((there[0], there[1] + 1), answered) if answered else there
                    ready.append((done[0], done[1] + 1))
            at[c] = max(ready)
        return at[c]

    for c in calls:
        resolve(c)
    return {c: place(c) for c in calls}


def check_order(spark, calls, needs):
    as_struct = "conv_id long, call_id string, at struct<turn:long,step:long>, answered struct<turn:long,step:long>"
    left = spark.createDataFrame([(1, c, at, answered) for c, (at, answered) in calls.items()], as_struct)
    right = spark.createDataFrame([(1, c, d) for c, ds in needs.items() for d in ds], "conv_id long, call_id string, needed string")
    got = {r.call_id: tuple(r["at"]) for r in toolcalls.order_calls(left, right).collect()}
    assert got == plain_order(calls, needs)


def test_tool_order_of_chains_cycles_and_random_graphs(spark):
    chain = {f"c{k}": ((500 - k, 0), (501 - k, 0) if k % 3 else None) for k in range(400)}
    check_order(spark, chain, {f"c{k}": [f"c{k - 1}"] for k in range(1, 400)})
    rng = np.random.default_rng(8)
    for p in (0.03, 0.08):
        calls = {f"r{k}": ((int(rng.integers(0, 50)), 0), (int(rng.integers(0, 50)), 0) if k % 2 else None) for k in range(40)}
        needs = {f"r{k}": [f"r{j}" for j in range(40) if rng.random() < p] + ["unknown"] for k in range(40)}
        check_order(spark, calls, needs)
    ring = {x: ((k, 0), None) for k, x in enumerate("abcdefg")}
    check_order(spark, ring | {"turn": ((2**60, 0), (2**61, 0))}, {"a": ["b"], "b": ["c"], "c": ["a"], "d": ["a", "turn"], "e": ["e"], "f": ["e", "d"], "g": ["turn"]})


# -- toxicity ----------------------------------------------------------------------------------------------


def test_scores_equal_a_search_by_regular_expressions(spark):
    terms, exceptions = {"idio": 4.0, "scum ": 5.0, "clown": 3.5, "clown ": 6.0}, {"clown fish", "the scum"}
    model = toxicity.Model(terms, exceptions, (-2.0, 1.5, 0.25))
    texts = ["an idiotic clown", "clown fish and clowns", "the scum, that scumbag", "5cum 1di0t 1d1o!", "xidiot", "", None, "scum scum. SCUM", "fine words " * 20_000 + "scum", "clown", "сlоwn"]

    def plain(text):
        folded, hits = toxicity.fold(text or ""), 0.0
        for word in re.finditer(r"[^\W\d_]+", folded):
            w = [weight for t, weight in terms.items() if (word[0] == t.strip() if t.endswith(" ") else word[0].startswith(t))]
            before = re.findall(r"[^\W\d_]+", folded[max(0, word.start() - 40) : word.start()])
            after = re.search(r"[^\W\d_]+", folded[word.end() : word.end() + 40])
            around = {f"{x} {word[0]}" for x in before[-1:]} | ({f"{word[0]} {after[0]}"} if after else set())
            if w and not around & exceptions:
                hits += max(w)
        z = -2.0 + 1.5 * math.log1p(hits) + 0.25 * math.log1p(1000 * hits / max(200, len(folded)))
        return 1 / (1 + math.exp(-z))

    docs = spark.createDataFrame([(k, t, "en", "s", 0, "x") for k, t in enumerate(texts + texts[:2])], DOCS)
    got = sorted((r.doc_id, r.score, r.predicted) for r in toxicity.score(docs, model, ["doc_id"]).collect())
    assert len(got) == len(texts) + 2
    for (k, s, p), t in zip(got, texts + texts[:2]):
        assert abs(s - plain(t)) < 1e-9 and p == int(s >= 0.5), (k, t)


def test_toxicity_without_rows_or_labels(spark, nothing):  # noqa: F811
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(toxicity.training_rows(nothing, labels).cache())
    assert toxicity.score(nothing, model, ["doc_id"]).collect() == []
    one = spark.createDataFrame([(1, "text", "en", "s", 0, "x")] * 2, DOCS)
    assert [r.predicted for r in toxicity.score(one, model, ["doc_id"]).collect()] == [1, 1]
    twice = spark.createDataFrame([(1, 1, 0), (1, 1, 1)], labels.schema)
    assert [tuple(r) for r in toxicity.training_rows(one, twice).collect()] == [(1, 1, "text")]


def test_letters_of_few_and_of_many_blocks():
    rng = np.random.default_rng(1)
    key, block = rng.integers(0, 1 << 63, 300).astype(np.uint64), rng.integers(0, 5, 500)
    key = rng.choice(key, 500)
    key[:20] = key[0]
    for n in (7, blocks.NARROW + 1):
        want = {int(k) for k in key if (key == k).sum() > 1}
        found, letters = set(), {}
        for batch in blocks.tally([key[:200], key[200:]], [block[:200], block[200:]], n):
            for row in batch.to_pylist():
                letters.setdefault(row["shard"], []).append((row["kind"], row["block"], row["a"], row["b"], row["c"]))
        answers = [(r["kind"], r["shard"], r["a"], r["b"], r["c"], r["block"]) for shard, rows in letters.items() for batch in blocks.common_keys(shard, rows, many=15) for r in batch.to_pylist()]
        for b in range(5):
            common = blocks.Common([a[:5] for a in answers if a[5] == b], n)
            own = key[block == b]
            known, hot = common.find(own)
            assert {int(k) for k in own[known]} == {int(k) for k in own} & want and set(own[hot].tolist()) <= {int(key[0])}
            found |= {int(k) for k in own[known]}
        assert found == want
