"""Large JSON arrays: many byte ranges give the rows of one."""

import json
import random

import pytest

from ledgermend.sources import arrays


def value(rng, levels):
    texts = ['a}"b', "{[", 'q\\"}', "\\", "é}", "x" * 30, "", "\n}"]
    kind = rng.randrange(4) if levels else 3
    if kind == 0:
        return {rng.choice(["text", "}", 'k"']): value(rng, levels - 1) for _ in range(rng.randrange(3))}
    if kind == 1:
        return [value(rng, levels - 1) for _ in range(rng.randrange(3))]
    return rng.choice([*texts, 1, None, True, -2.5])


@pytest.mark.parametrize("indent", [None, 2])
def test_ranges_give_every_object_once(spark, tmp_path, indent):
    rng = random.Random(4)
    records = [{"id": k, "text": value(rng, 3), "v": value(rng, 3)} for k in range(120)]
    (tmp_path / "a.json").write_text(json.dumps(records, indent=indent, ensure_ascii=bool(indent)), encoding="utf-8")
    (tmp_path / "b.json").write_text('[ 1, "x{", {"a": 1} , null, {}]', encoding="utf-8")
    (tmp_path / "c.json").write_text("[]", encoding="utf-8")
    held = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        found = arrays.read_json_array(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        rows = found.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held[0])
        spark.conf.set("spark.sql.files.openCostInBytes", held[1])
    got = {(r.file[-6:], r.record): json.loads(r.value) for r in rows}
    want = {("a.json", k): r for k, r in enumerate(records)} | {("b.json", 0): {"a": 1}, ("b.json", 1): {}}
    assert got == want and len(rows) == len(want)
