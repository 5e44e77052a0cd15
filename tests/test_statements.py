"""The line automaton, account starts and open rows against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgermend.operators import statements as st

KINDS = [*st.MOVES, "values", None]


@pytest.mark.parametrize("chunk", [2, 3, 64])
def test_scan_equals_a_loop(spark, chunk):
    rng = random.Random(5)
    rows, want = [], {}
    for doc in range(6):
        state = 0
        for k in range((0, 1, 2, 30, 64, 300)[doc]):
            kind = rng.choice([x for x in KINDS if x != "stop" or rng.random() < 0.05])
            rows.append((doc, 2 * k if doc == 3 else k, kind, "x"))
            after = st.MOVES[kind][state] if kind in st.MOVES else state
            want[rows[-1][:2]] = (state, after)
            state = after
    made = spark.createDataFrame(rows, "doc int, n int, kind string, _at string").repartition(5).select("doc", "n", "kind", F.col("_at").alias("extra"))
    got = st.scan_states(made, ["doc"], "n", "kind", st.MOVES, chunk=chunk).collect()
    assert {(r.doc, r.n): (r.before, r.after) for r in got} == want and len(got) == len(rows)
    assert st.scan_states(made.where("doc > 9"), ["doc"], "n", "kind", st.MOVES).collect() == []


def test_a_long_document_is_scanned_without_gathering_it(spark):
    """200,000 lines of one document and of one without a key, in several chunks; the frame's plan gathers no lists."""
    kinds = spark.range(200_000).select(F.col("id").alias("n"), F.element_at(F.array(*[F.lit(k) for k in KINDS if k != "stop"]), (F.pmod(F.xxhash64("id"), F.lit(len(KINDS) - 1)) + 1).cast("int")).alias("kind"))
    made = kinds.select(F.lit(1).alias("doc"), "n", "kind").union(kinds.select(F.lit(None).cast("int"), "n", "kind")).repartition(5)
    found = st.scan_states(made, ["doc"], "n", "kind", st.MOVES)
    assert "collect_list" not in found._jdf.queryExecution().toString()
    state, wrong, seen = 0, 0, 0
    for r in found.orderBy("doc", "n").toLocalIterator():
        state = state if r.n else 0
        after = st.MOVES[r.kind][state] if r.kind in st.MOVES else state
        wrong, seen, state = wrong + ((r.before, r.after) != (state, after)), seen + 1, after
    assert (wrong, seen) == (0, 400_000)


def headline(t):
    core = re.sub(r"[^A-Za-z0-9/&\-]", "", t)
    return len(core) >= 3 and core.isupper()


def triad(t):
    return all(s in t.lower() for s in st.SOURCES)


def plain(t):
    return re.sub("[^a-z0-9]", "", t.lower())


def plain_split(lines):
    """One document's ``(page, text)`` lines, split by a loop."""
    stop = next((k for k, (_, t) in enumerate(lines) if plain(t) == st.STOP_MARKER), len(lines))
    full, lines = lines, lines[:stop]
    accounts = []
    for at, (page, text) in enumerate(lines):
        if not text.startswith("Account #"):
            continue
        near = [k for k in range(at - 1, max(at - 8, -1), -1) if lines[k][0] == page]
        names = next((k for k in near if triad(lines[k][1])), None)
        start, heading, source = (at if names is None else names), None, "anchor_no_heading"
        back = next((k for k in near if not triad(lines[k][1]) and headline(lines[k][1])), None)
        if names is not None and names and lines[names - 1][0] == page and headline(lines[names - 1][1]) and not triad(lines[names - 1][1]):
            start, heading, source = names - 1, lines[names - 1][1], "triad_above"
        elif back is not None:
            start, heading, source = back, lines[back][1], "backtrack"
        elif at - next(k for k in range(len(lines)) if lines[k][0] == page) <= 2:
            foot = [t for p, t in full if p == page - 1][-3:]
            odd = "public information|inquiries|collections|total accounts|credit summary"
            heading = next((t for t in reversed(foot) if headline(t) and not re.search(odd, t.lower())), None)
            source = "cross_page_backtrack" if heading else source
        accounts.append([start, heading, source, None, False])
    starts = [a[0] for a in accounts]
    for s, (_, text) in enumerate(lines):
        if plain(text) in st.SECTION_NAMES:
            k = next((k for k, x in enumerate(starts) if x > s), None)
            if k is not None:
                heads = [j for j in range(s + 1, min(s + 5, len(lines))) if headline(lines[j][1]) and not triad(lines[j][1])]
                at = heads[0] if heads else s + 1
                accounts[k] = [at, lines[at][1], "section+heading", st.SECTION_NAMES[plain(text)], True]
    if any(a[0] > b[0] for a, b in zip(accounts, accounts[1:])):
        return None
    out, section, carried = [], None, []
    for k, (start, heading, source, own, seen) in enumerate(accounts):
        section = own or section
        end = accounts[k + 1][0] if k + 1 < len(accounts) else len(lines)
        cut = next((j for j in range(start, end) if plain(lines[j][1]) in st.SECTION_NAMES), end)
        kept = carried + [j for j in range(start, cut) if not re.search(st.NOISE, lines[j][1])]
        carried = []
        while kept and triad(lines[kept[-1]][1]):
            carried.insert(0, kept.pop())
        out += [(j, k + 1, heading, source, section, seen) for j in kept]
    return sorted(out)


LINES = ["FIRST BANK", "STORE CARD 9", "TransUnion® Experian® Equifax®", "Account # 1 2 3", "Account # --", "Balance: $1 $2 $3", "more words", "Collection", "Unknown", "https://x", "1/2/2024 Credit Report", "ok ok 30", "", "Experian", "Inquiries", "AB", "transunion, EXPERIAN: equifax"]


def test_split_equals_a_loop(spark):
    rng = random.Random(11)
    docs = {d: [(1 + k // rng.choice((4, 9)) if d % 2 else 1 + k // 12, rng.choice(LINES)) for k in range(rng.choice((1, 12, 60)))] for d in range(60)}
    docs = {d: sorted(x, key=lambda r: r[0]) for d, x in docs.items()}
    # Of several section lines before one account only the last counts, and an account moved past the next one has no lines: kept apart here.
    docs = {d: x for d, x in docs.items() if plain_split(x) is not None and not any(plain(a[1]) in st.SECTION_NAMES and any(plain(b[1]) in st.SECTION_NAMES for b in x[k + 1 : k + 6]) for k, a in enumerate(x))}
    docs[100] = [(1, "ONE BANK"), (1, LINES[2]), (1, "Account # 5"), (1, "Public Information"), (1, "Account # 6")]
    docs[101] = [(1, "A"), (1, "LAST WORDS"), (2, "Account # 7"), (2, "Balance: 1")]
    rows = [(d, p, n, t) for d, x in docs.items() for n, (p, t) in enumerate(x)]
    got = st.split_accounts(spark.createDataFrame(rows, "doc int, page int, position int, text string"), ["doc"]).collect()
    found = {}
    for r in got:
        found.setdefault(r.doc, []).append((r.position, r.account, r.heading, r.source, r.section, r.section_start))
    assert len(docs) > 20
    differing = [d for d, x in docs.items() if sorted(found.get(d, []), key=str) != sorted(plain_split(x), key=str)]
    assert not differing, (docs[differing[0]], sorted(found.get(differing[0], [])), plain_split(docs[differing[0]]))
    assert {r.source for r in got} == {"triad_above", "backtrack", "section+heading", "anchor_no_heading", "cross_page_backtrack"}


@pytest.mark.parametrize(("tail", "want"), [
    ("", ["", "", ""]), (None, ["", "", ""]), ("-- -- --", ["--"] * 3), ("—", ["--"] * 3), ("$1 -- $3", ["$1", "$3", ""]), ("5 -- -- 7", ["5", "--", "7"]),
    ("Paid late  Open  Closed now", ["Paid late", "Open", "Closed now"]), ("Jan 2020 Feb. 2021 Mar 22 x", ["Jan 2020", "Feb. 2021", "Mar 22 x"]),
    ("$1 $2 $3", ["$1", "$2", "$3"]), ("a b", ["a", "b", ""]), ("one", ["one", "", ""]), ("a  b  c  d", ["a", "b", "c d"]), ("Jan x y", ["Jan", "x", "y"]), ("–", ["--"] * 3),
])
def test_tails(spark, tail, want):
    assert list(spark.createDataFrame([(tail,)], "t string").select(st.split_tail(F.col("t"))).first()[0]) == want


def test_open_rows(spark):
    texts = ["Balance: 1 2 3", "Account # 11* 22* 33*", "Creditor: ", "FIRST", "Type: Bank  Store  Card", "of record", "-- -- x", "Status: -- -- --", "$5 $6 $7", "no", "$9 $9 $9", "Two-Year Payment History", "Late: 1 2 3", "Account # 5 6 7", "Equifax", "Late: 1 2 3"]
    made = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)] + [(2, 0, None)], "doc int, position int, text string")
    got = sorted(tuple(r) for r in st.triad_rows(made, ["doc"]).collect())
    assert got == [
        (1, 1, "Account", 1, "11*", "22*", "33*"), (1, 2, "Creditor", 2, "", "", ""), (1, 3, "Type", 4, "Bank", "Store", "Card of record x"),
        (1, 4, "Status", 7, "$5", "$6", "$7"), (1, 5, "Account", 13, "5", "6", "7"),
    ]


def test_no_window_reads_to_the_end_from_every_row(spark):
    """Such a frame takes the square of a document's lines."""
    from ledgermend.operators import sequence

    lines = spark.createDataFrame([("d", 1, 0, "BANK"), ("d", 1, 1, "Account # 1")], "doc string, page int, position long, text string")
    months = spark.createDataFrame([("d", 0, 9, None), ("d", 1, 1, 2025)], "doc string, pos int, mon int, anchor int")
    for df in (st.split_accounts(lines, ["doc"]), sequence.carry_years(months, ["doc"], "pos", "mon", "anchor")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "RowFrame" in plan and "currentrow$(), unboundedfollowing$()" not in plan
