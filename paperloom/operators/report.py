"""Aggregates over runs and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pass_rate(runs: DataFrame, ok: str = "qc_ok") -> DataFrame:
    """(n, n_passed, n_failed, percent): percent is rounded down; an unknown verdict counts as failed."""
    passed = F.count_if(F.coalesce(F.col(ok), F.lit(False)))
    n = F.count(F.lit(1))
    return runs.agg(n.alias("n"), passed.alias("n_passed"), (n - passed).alias("n_failed"), F.when(n > 0, F.floor(100 * passed / n)).alias("percent"))


def reason_counts(runs: DataFrame, reasons: str = "qc_reasons") -> DataFrame:
    return runs.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def mean_loss(log: DataFrame, loss: str = "eval_loss") -> DataFrame:
    return log.agg(F.avg(loss).alias("mean_loss"))
