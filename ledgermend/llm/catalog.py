"""Queries of the numbered operators and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgermend.llm import ann, decontam, language, mixing, neardup, packing, phrases, resampling, spelling, suffixes, toolcalls, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

for _module in (mixing, language, warc, toolcalls, toxicity, decontam, ann, neardup, phrases, suffixes, packing, resampling, spelling):
    QUERIES |= _module.QUERIES
    ORACLES |= getattr(_module, "ORACLES", {})
