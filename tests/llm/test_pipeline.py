"""Every stage of the pipeline against a brute-force version, on its own input."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgermend.llm import language, mixing
from tests.llm.test_brute import plain_bin, plain_grams
from tests.llm.test_llm import WORD, brute_components, words

#: Names that stages use themselves.
CLASHING = ("score", "lang_pred", "held_out", "_held_out", "n_words", "n_removed", "kept_text", "kept_sha256", "block", "n_items", "best_item", "best_overlap", "contaminated", "size", "kept", "component_id", "rows", "row")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
BENCH = [(1, " ".join(words(30, 70))), (2, "seven plain words make one short item"), (3, None)]


def documents():
    rng = np.random.default_rng(2)
    said = {"en": "the house and the garden with many words", "de": "das haus und der garten mit nicht vielen"}
    rows = []
    for k in range(60):
        lang = ("en", "de")[k % 2]
        rows.append((k, " ".join([*rng.choice(said[lang].split(), 20), *words(30, 200 + k, 10**6)]), lang, f"s{k % 3}" if k % 7 else None))
    base, shared = words(80, 31), words(45, 32)
    near = [*base[:70], "other", *base[71:]]
    rows += [(100, " ".join(base), "en", "s0"), (101, " ".join(near), "en", "s1"), (102, " ".join(base), "en", "s1"), (103, " ".join(base + words(60, 33, 10**6)), "en", "s1")]
    rows += [(k, " ".join(words(25, 40 + k, 10**6) + shared), "en", "s2") for k in (110, 111)] + [(112, " ".join(shared), "en", "s2")]
    rows += [(120, BENCH[0][1] + " " + " ".join(words(40, 50, 10**6)), "en", "s0"), (121, " ".join(words(20, 51, 10**6)) + " Seven, plain words make one short ITEM.", "en", "s0")]
    rows += [(130, None, "en", "s0"), (131, "", "en", "s0"), (132, "12 34 !?", "en", None), (133, " ".join([*rng.choice(said["en"].split(), 9000), *words(5000, 52, 10**6)]), "en", "s0"), (138, "q" * 50_000, None, "s0")]
    rows += [(134, "Совсем другой язык, которого никто не учил. " * 6, None, "s0"), (136, "the house", "en", "s0"), (137, "token = 40d78a45c418324758e099eb7cb89bc0f5fa9f62 the house", "en", "s1")]
    rows += [(140, "one text of a repeated id", "en", "s0"), (140, "another text of that id", "de", "s1"), (140, "one text of a repeated id", "en", "s0"), (None, " ".join(base), "en", "s0"), (None, " ".join(base), "en", "s0")]
    return [(d, t, lang, s, len(t or ""), *[c for c in CLASHING]) for d, t, lang, s in rows]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(documents(), SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Input and output rows of every stage."""
    docs, seen = spark.createDataFrame(documents(), SCHEMA), {}
    for name, stage in corpus_pipeline.STAGES:
        rows = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, sf_dir)
        made = [tuple(r) for r in out.collect()]
        seen[name] = rows, made
        if name != "mixing":
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            docs = spark.createDataFrame(made, SCHEMA).cache()
    return seen


def test_language_stage(spark, stages):
    rows, made = stages["language_id"]
    df = spark.createDataFrame(rows, SCHEMA)
    used = {r.doc_id for r in df.where(~language.held_out(df) & F.col("doc_id").isNotNull()).collect()}
    counts = {}
    for d, t, lang, *_ in rows:
        if d in used and lang:
            own = counts.setdefault(lang, Counter())
            own.update(plain_bin(g) for g in plain_grams(t))
    total = {x: sum(c.values()) + language.SMOOTH * language.BINS for x, c in counts.items()}
    want = []
    for d, t, _, *rest in rows:
        if any(c.isalpha() for c in t or ""):
            logs = {x: sum(math.log((counts[x][plain_bin(g)] + language.SMOOTH) / total[x]) for g in plain_grams(t)) for x in sorted(counts)}
            best = max(logs, key=logs.get)
            log_p = lambda g: math.log((counts[best][g] + language.SMOOTH) / total[best])  # noqa: B023, E731
            usual = sum(n * log_p(g) for g, n in counts[best].items()) / sum(counts[best].values())
            own = [log_p(plain_bin(g)) for g in plain_grams(t) if not re.search("[0-9]", g)]
            if usual - sum(own) / len(own) <= language.MARGIN + language.NOISE / math.sqrt(len(own)):
                want.append((d, t, best, *rest))
    assert Counter(made) == Counter(want) and len(made) == len(rows) - 5
    assert not {134, 138} & {r[0] for r in made} and {133, 136, 137} <= {r[0] for r in made}


def test_near_duplicate_stage(spark, stages, sf_dir):
    rows, made = stages["near_dedup"]
    least = brute_components((r[0], r[1]) for r in rows)
    assert sorted(r[0] for r in made if r[0] is not None) == sorted(k for k, v in least.items() if k == v)
    assert set(made) <= set(rows) and sum(r[0] is None for r in made) == 2
    again = dict(corpus_pipeline.STAGES)["near_dedup"](spark, spark.createDataFrame(rows[::-1], SCHEMA).repartition(3), sf_dir)
    assert Counter(tuple(r) for r in again.collect()) == Counter(made)


def test_substring_stage(stages):
    rows, made = stages["substring_dedup"]
    split = [WORD.findall(r[1] or "") for r in rows]
    count = Counter(tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34))
    want = []
    for (d, t, lang, source, n, *rest), w in zip(rows, split):
        gone = {j for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        text = " ".join(x for j, x in enumerate(w) if j not in gone) if gone else t
        if len(gone) < len(w):
            want.append((d, text, lang, source, len(text), *rest))
    assert Counter(made) == Counter(want) and len(made) < len(rows)


def test_decontamination_stage(stages):
    rows, made = stages["decontamination"]

    def tokens(text):
        return "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in (text or "").lower()).split()

    def leaks(text, item):
        where = {}
        for k, w in enumerate(text):
            where.setdefault(w, []).append(k)
        for shift in {p - k for k, w in enumerate(item) for p in where.get(w, ())}:
            run = 0
            for k, w in enumerate(item):
                run = max(0, run + (1 if 0 <= shift + k < len(text) and text[shift + k] == w else -1))
                if run >= min(10, -(-6 * len(item) // 10)):
                    return True
        return False

    items = [tokens(t) for _, t in BENCH if t]
    want = [r for r in rows if not any(leaks(tokens(r[1]), i) for i in items)]
    assert Counter(made) == Counter(want) and {120, 121} & {r[0] for r in rows} and not {120, 121} & {r[0] for r in made}


def test_mixing_stage_and_run(spark, stages, sf_dir):
    rows, made = stages["mixing"]
    docs = pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "source": [r[3] for r in rows]})
    database = duckdb.connect()
    database.register("kept", docs)
    want = database.sql(mixing.mix_sql("kept")).fetchall()
    plain = lambda found: Counter((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in found)
    assert plain(made) == plain(want)
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()) == Counter(made)


def test_empty_tables(spark, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], SCHEMA), sf_dir).collect() == [], name
