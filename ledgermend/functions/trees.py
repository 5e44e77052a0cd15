"""Documents of any shape: dropping keys at every depth without leaving the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermend.functions.lets import bound


def depth(text: Column) -> Column:
    """How deep objects and arrays of a JSON text stand in each other; brackets within strings don't count."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\\.", ""), r'"[^"]*"', "")
    steps = F.transform(F.regexp_extract_all(bare, F.lit(r"([\[{\]}])"), F.lit(1)), lambda c: F.when(c.isin("[", "{"), 1).otherwise(-1))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.aggregate(steps, start, lambda x, s: F.struct((x["now"] + s).alias("now"), F.greatest(x["most"], x["now"] + s).alias("most")))["most"]


def _quoted(key: Column) -> Column:
    listed = F.to_json(F.array(key))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def _scrubbed(value: Column, banned: list[str], levels: int) -> Column:
    """The JSON text of a variant with ``levels`` levels of containers, keys in order of their text."""
    if not levels:
        return F.to_json(value)
    entry = "array<struct<key string, value variant>>"

    def parts(v: Column) -> Column:
        entries = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
        items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value")))
        return F.struct(entries.isNotNull().alias("object"), F.coalesce(entries, items).cast(entry).alias("entries"), v.alias("self"))

    def text(p: Column) -> Column:
        kept = F.filter(p["entries"], lambda e: e["key"].isNull() | ~e["key"].isin(*banned))
        inner = F.array_join(F.transform(kept, lambda e: F.concat(F.when(p["object"], F.concat(_quoted(e["key"]), F.lit(":"))).otherwise(""), _scrubbed(e["value"], banned, levels - 1))), ",")
        return F.when(p["entries"].isNull(), F.to_json(p["self"])).otherwise(F.concat(F.when(p["object"], "{").otherwise("["), inner, F.when(p["object"], "}").otherwise("]")))

    return bound(parts(value), text)


def without_keys(df: DataFrame, column: str, banned: Iterable[str]) -> DataFrame:
    """``df`` with a JSON text column whose objects, at every depth and within arrays, have none of the ``banned`` keys.

    Keys come in the order of their text.  Null stays null; text that isn't JSON becomes null.  The expression is as deep as the
    deepest document, which one narrow pass finds out.
    """
    levels = df.agg(F.max(depth(F.col(column)))).first()[0] or 0
    return df.withColumn(column, _scrubbed(F.try_parse_json(column), sorted(banned), levels))
