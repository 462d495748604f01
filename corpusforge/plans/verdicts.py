"""Multi-seed comparison of a champion configuration with its baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.runs import median_run, seed_stats, verdict
from ..sources.runs import read_results, write_summary


def multi_seed_verdict(spark: SparkSession, globs: list[str], champion: str, baseline: str,
                       out: str | None = None) -> dict[str, DataFrame]:
    """Seed statistics, verdict per language and the seed to deploy, from result files."""
    rows = read_results(spark, globs)
    tables = {
        "stats": seed_stats(rows), "verdict": verdict(rows, champion, baseline),
        "deploy": median_run(rows.where(f"config = '{champion}'")),
    }
    if out is not None:
        for name, table in tables.items():
            write_summary(table, f"{out}/{name}")
    return tables
