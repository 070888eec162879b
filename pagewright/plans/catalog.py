"""Every registered query and its reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagewright.plans import extract, queries_flows, queries_pages, queries_scalar

Query = Callable[[SparkSession, str], DataFrame]
_ALL = queries_scalar.QUERIES | queries_pages.QUERIES | queries_flows.QUERIES


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract.extract_pages(pages, keep=("page_id",))


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
