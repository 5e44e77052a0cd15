"""Readers of layout tokens, account documents and logs, and writers of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermend.functions.predicates import ExportFilter, missing_exact

TOKENS = "page string, line string, y0 double, y1 double, x0 double, x1 double, text string"
EXPORT_COLUMNS = ("session_id", "family_id", "action_tag", "cycle_id", "outcome", "planner_status", "last_sent_at", "next_eligible_at")
BUREAUS = ("transunion", "experian", "equifax")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated layout tokens; rows whose page or line is no number are dropped."""
    raw = spark.read.option("sep", "\t").option("header", True).schema(TOKENS).csv(path)
    typed = raw.withColumn("page", F.col("page").try_cast("int")).withColumn("line", F.col("line").try_cast("int"))
    return typed.where("page is not null and line is not null")


def line_texts(tokens: DataFrame) -> DataFrame:
    """The text of each line, tokens from left to right."""
    ordered = F.array_sort(F.collect_list(F.struct("x0", "text")))
    return tokens.groupBy("page", "line").agg(F.array_join(F.transform(ordered, lambda t: t["text"]), " ").alias("text"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))


def write_tokens(tokens: DataFrame, path: str) -> None:
    """Tokens in reading order, tabs within texts replaced."""
    clean = tokens.withColumn("text", F.translate("text", "\t", " "))
    clean.orderBy("page", "line", "x0").write.option("sep", "\t").option("header", True).csv(path)


def read_accounts(spark: SparkSession, path: str) -> DataFrame:
    """Account documents (one JSON object a file) as long rows: file, bureau, field, raw; missing values are dropped.

    Session and account come from the folder names ``<session>/.../<account>/bureaus.json``.
    """
    branch = "map<string,string>"
    schema = ", ".join(f"{b} {branch}" for b in BUREAUS)
    docs = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    parts = F.split("file", "/")
    sides = F.array(*[F.struct(F.lit(b).alias("bureau"), F.col(b).alias("fields")) for b in BUREAUS])
    long = docs.select(F.element_at(parts, -2).alias("account"), F.explode(sides).alias("s")).select("account", F.col("s.bureau").alias("bureau"), F.explode("s.fields").alias("field", "raw"))
    return long.where(~missing_exact(F.col("raw")))


def read_records(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines of a known schema, and the lines that don't parse."""
    parsed = F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    rows = spark.read.text(path).select("value", parsed.alias("r"))
    broken = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    return rows.where(~broken).select("r.*").drop("_corrupt"), rows.where(broken).select(F.col("value").alias("line"))


def export_view(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The fixed columns of an analytics view; what the source lacks is null."""
    names = ("session_id", "account_id", "family_id", "tri_merge_snapshot_id", "plan_id", "step_id", "outcome_id", "cycle_id")
    return df.select(*[columns.get(n, F.lit(None)).cast("bigint" if n == "cycle_id" else "string").alias(n) for n in names])


def export_rows(df: DataFrame, wanted: ExportFilter) -> DataFrame:
    condition = wanted.condition()
    rows = df if condition is None else df.where(condition)
    return rows.select(*EXPORT_COLUMNS)


def write_csv_export(rows: DataFrame, path: str) -> None:
    """Text parts that read, in the order of their names, as a version line, a header and the rows, unquoted."""
    head = rows.sparkSession.createDataFrame([("export_version=1\n" + ",".join(EXPORT_COLUMNS),)], "line string")
    head.write.text(f"{path}/part=0-head")
    rows.select(F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in EXPORT_COLUMNS]).alias("line")).write.text(f"{path}/part=1-rows")


def write_json_export(rows: DataFrame, path: str) -> None:
    """Text parts that read, in the order of their names, as one JSON document: a version and an array of rows."""
    spark = rows.sparkSession
    lines = rows.select(F.monotonically_increasing_id().alias("n"), F.to_json(F.struct(*EXPORT_COLUMNS), {"ignoreNullFields": "false"}).alias("line"))
    first = lines.agg(F.min("n")).first()[0]
    spark.createDataFrame([('{"export_version":1,"rows":[',)], "line string").write.text(f"{path}/part=0-head")
    lines.select(F.when(F.col("n") == F.lit(first), F.col("line")).otherwise(F.concat(F.lit(","), "line")).alias("line")).write.text(f"{path}/part=1-rows")
    spark.createDataFrame([("]}",)], "line string").write.text(f"{path}/part=2-tail")


def write_report(rows: DataFrame, path: str) -> None:
    """A report as CSV with a header in every part."""
    rows.write.option("header", True).csv(path)


def append_events(events: DataFrame, path: str) -> None:
    """Events as JSON lines, added to those of earlier calls."""
    events.write.mode("append").json(path)


def account_files(spark: SparkSession, path: str) -> DataFrame:
    """``session, account, file`` of every ``<session>/cases/accounts/<account>/bureaus.json`` under a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "bureaus.json").option("recursiveFileLookup", True).load(path).select("path")
    part = lambda k: F.element_at(F.split("path", "/"), k)
    return found.where(part(-3) == "accounts").select(part(-5).alias("session"), part(-2).alias("account"), F.col("path").alias("file"))


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The elements of files that hold one JSON array each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """``session, body`` of a store that is one JSON object of sessions; bodies are JSON text."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    return whole.select(F.explode("m").alias("session", "body"))


def read_rules(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """A configuration file, one JSON object of rules by name, as rows: ``key`` and the columns of ``schema``."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,struct<{schema}>>").alias("m"))
    return whole.select(F.explode("m").alias(key, "rule")).select(key, "rule.*")


def flattened_tradelines(reports: DataFrame, report: str) -> DataFrame:
    """A row per account of a report ``map<bureau, map<section, array<map>>>``, inquiries left out: bureau, creditor, account_number, data."""
    sides = reports.select("*", F.explode(report).alias("bureau", "_sections")).select("*", F.explode("_sections").alias("_section", "_items")).where("_section <> 'inquiries'")
    rows = sides.select(*[c for c in reports.columns if c != report], "bureau", F.explode("_items").alias("data"))
    named = lambda k: F.try_element_at("data", F.lit(k))
    return rows.withColumns({"creditor": F.coalesce(named("name"), F.lit("")), "account_number": named("account_number")})


def write_by_bureau(df: DataFrame, path: str) -> None:
    """Findings as JSON, a folder per account and bureau; the committer makes the write atomic."""
    df.write.partitionBy("account", "bureau").json(path)


def split_failed(df: DataFrame, error: str, path: str) -> DataFrame:
    """Rows without an error; the others go to a dead-letter folder as JSON."""
    df.where(F.col(error).isNotNull()).write.mode("append").json(path)
    return df.where(F.col(error).isNull()).drop(error)


def bounded_window(df: DataFrame, at: str, end: str, days: int) -> DataFrame:
    """Rows of the last days before a given moment, both ends included."""
    stop = F.to_timestamp(F.lit(end))
    return df.where(F.col(at).between(stop - F.expr(f"interval {days} days"), stop))
