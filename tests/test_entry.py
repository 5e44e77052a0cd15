"""The registry: names, oracles and the guard around the optional subpackage."""

import os
import shutil
import subprocess
import sys

from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgermend.operators import letters

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "consensus_orders" in entry.queries()


def test_the_rest_imports_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"], cwd=tmp_path / "r", capture_output=True, text=True, timeout=60)
    count, numbered = said.stdout.split()
    assert int(count) > 60 and numbered == "False", said.stderr


def test_letters(spark):
    row = spark.range(1).select(
        letters.routed(F.lit("MOV"), F.create_map(F.lit("creditor_name"), F.lit("x"), F.lit("cra_last_result"), F.lit(None).cast("string"))).alias("a"),
        letters.routed(F.lit("unheard of"), F.create_map(F.lit("a"), F.lit("b"))).alias("b"),
        letters.filled([F.create_map(F.lit("name"), F.lit("")), F.create_map(F.lit("name"), F.lit("Ann"))], ["name", "dob"]).alias("c"),
    ).first()
    assert row.a.template == "mov_letter_template.html" and list(row.a.missing) == ["account_number_masked", "legal_safe_summary", "cra_last_result", "days_since_cra_result"]
    assert (row.b.template, list(row.b.required)) == (None, [])
    assert row.c == {"name": "Ann", "dob": None}
