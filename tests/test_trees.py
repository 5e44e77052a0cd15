"""Keys dropped at any depth, rulebooks against the plain evaluation, ingest with three tries."""

import json
import random

from pyspark.sql import functions as F

from ledgermend.functions import trees
from ledgermend.operators import rulebook
from ledgermend.streaming import ingest


def scrub(value, banned):
    if isinstance(value, dict):
        return {k: scrub(v, banned) for k, v in value.items() if k not in banned}
    return [scrub(v, banned) for v in value] if isinstance(value, list) else value


def tree(rng, levels):
    kind = rng.randrange(5) if levels else 4
    if kind < 2:
        return {rng.choice(['a', 'ssn', 'b c', 'q"x', "é{"]): tree(rng, levels - 1) for _ in range(rng.randrange(4))}
    if kind < 4:
        return [tree(rng, levels - 1) for _ in range(rng.randrange(4))]
    return rng.choice([1, -2.5, "x", 'say "}"', None, True, "", "ssn", 10**12])


def test_keys_are_dropped_at_every_depth(spark):
    rng = random.Random(2)
    values = [tree(rng, 6) for _ in range(80)] + [{"ssn": {"a": 1}}, {}, [], 5, {"a": [[[[[[[[{"ssn": 1, "b": [1]}]]]]]]]]}]
    rows = [(k, json.dumps(v)) for k, v in enumerate(values)] + [(900, None), (901, "no json {")]
    got = {r.k: r.doc for r in trees.without_keys(spark.createDataFrame(rows, "k int, doc string"), "doc", ["ssn", "b c"]).collect()}
    assert got[900] is None and got[901] is None
    for k, v in enumerate(values):
        assert json.loads(got[k]) == scrub(v, {"ssn", "b c"}), (v, got[k])


def plain_rules(facts, statement, rules, precedence, exclusions, flags):
    """A direct reading of the rulebook for one record."""
    def value(path):
        if path == "statement":
            return statement
        return flags.get(path[6:]) if path.startswith("flags.") else facts.get(path)

    def holds(c):
        if "all" in c or "any" in c:
            return (all if "all" in c else any)(holds(x) for x in c.get("all", c.get("any")))
        v = value(c.get("field", ""))
        for word, fn in (("eq", lambda a, b: a == b), ("ne", lambda a, b: a != b), ("lt", lambda a, b: a < b), ("lte", lambda a, b: a <= b), ("gt", lambda a, b: a > b), ("gte", lambda a, b: a >= b)):
            if word in c:
                return fn(v, c[word]) if v is not None or word in ("eq", "ne") else False
        return False

    order = sorted((r for r in rules if r.get("when") and holds(r["when"])), key=lambda r: precedence.index(r["id"]) if r["id"] in precedence else 99)
    hits, evidence, tags, frame, gone = [], [], [], "", set()
    for r in order:
        if r["id"] in gone:
            continue
        e = r.get("effect", {})
        hits += e.get("rule_hits", [r["id"]])
        evidence += e.get("needs_evidence", [])
        frame = frame or e.get("suggested_dispute_frame", "")
        if e.get("action_tag"):
            tags.append((-{"High": 3, "Medium": 2, "Low": 1}.get(e.get("priority", "Low"), 0), e["action_tag"]))
        gone |= {*e.get("excludes", []), *exclusions.get(r["id"], [])}
    known = [t for t in tags if t[0]]
    tag = min(known, key=lambda t: t[0])[1] if known else (tags[0][1] if tags else "")
    return list(dict.fromkeys(hits)), list(dict.fromkeys(evidence)), frame, tag


def test_rulebook_equals_the_plain_evaluation(spark):
    rng = random.Random(8)
    test = lambda: rng.choice([{"field": "a", "gt": rng.randrange(5)}, {"field": "b", "ne": 1}, {"field": "c", "eq": "x"}, {"field": "flags.on", "eq": True}, {"field": "statement", "ne": "late"}, {"field": "b", "lte": 2}, {"field": "a"}])
    for _ in range(6):
        ids = [f"r{k}" for k in range(8)]
        rules = [{"id": i, "when": rng.choice([test(), {"all": [test(), test()]}, {"any": [test(), {"all": [test(), test()]}]}]), "effect": {
            "excludes": rng.sample(ids, rng.randrange(3)), "needs_evidence": rng.sample(["e1", "e2"], rng.randrange(3)), **({"action_tag": f"t{i}", "priority": rng.choice(["High", "Low", "Odd"])} if rng.random() < 0.7 else {}),
            **({"suggested_dispute_frame": f"f{i}"} if rng.random() < 0.5 else {}), **({"rule_hits": ["h1", i]} if rng.random() < 0.3 else {})}} for i in ids] + [{"id": "never"}]
        precedence, exclusions, flags = rng.sample(ids, 5), {"r1": ["r2", "r3"], "r4": ["r1"]}, {"on": rng.random() < 0.5}
        facts = [(k, rng.choice([None, 0, 3, 9]), rng.choice([None, 1, 2]), rng.choice(["x", None]), rng.choice(["late", "Paid LATE", None])) for k in range(12)]
        got = rulebook.evaluated(spark.createDataFrame(facts, "k int, a int, b int, c string, s string"), "s", rules, precedence, exclusions, flags).collect()
        for r in got:
            want = plain_rules({"a": r.a, "b": r.b, "c": r.c}, r.s or "", rules, precedence, exclusions, flags)
            assert (list(r.rule_hits), list(r.needs_evidence), r.suggested_dispute_frame, r.action_tag) == want
            assert list(r.red_flags) == (["late_payment"] if r.s else [])


def test_ingest_tries_three_times(spark, tmp_path):
    folder, source = str(tmp_path / "out"), str(tmp_path / "in")
    fails = {"good": 0, "shaky": 2, "bad": 9}
    attempt = lambda df: df.withColumn("error", F.when(F.col("tries") <= F.element_at(F.create_map(*[F.lit(x) for p in fails.items() for x in p]), F.col("kind")), F.concat(F.lit("try "), "tries")))
    read = lambda name: sorted(tuple(r) for r in spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/{name}").collect())
    for n, kinds in enumerate((["good", "shaky", "bad"], ["good"], [], ["shaky"], [])):
        spark.createDataFrame([(10 * n + k, kind) for k, kind in enumerate(kinds)], "id int, kind string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id int, kind string").parquet(source)
        ingest.ingest(stream, folder, attempt, availableNow=True).awaitTermination()
    ledger, dead = read("ledger"), read("dead")
    assert (0, "good", 1) in ledger and (10, "good", 1) in ledger and (1, "shaky", 3) in ledger
    assert dead == [(2, "bad", 3, "try 3")]
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "out" / "ledger").iterdir())
    events = spark.read.schema("id int, kind string").parquet(source).where("id = 30")
    before = read("ledger"), read("dead"), read("pending")
    ingest.ingest_batch(events.where("id >= 30") if last == 3 else events.where("false"), last, folder, attempt)
    assert (read("ledger"), read("dead"), read("pending")) == before
    ingest.ingest_batch(events.where("false"), last + 1, folder, attempt)
    ingest.ingest_batch(events.where("false"), last + 2, folder, attempt)
    assert (30, "shaky", 3) in read("ledger")
