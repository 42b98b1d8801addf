"""Tuning advice: rules as filters on tables of metrics (entity, ts, metric columns)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Rule:
    """condition: SQL over the metric columns."""

    name: str
    condition: str
    advice: str


def advise(metrics: DataFrame, rules: Sequence[Rule], least: int = 1) -> DataFrame:
    """(entity, rule, advice, n, first_ts, last_ts) for each rule that held at `least` times; one pass over the metrics for all rules."""
    held = F.filter(F.array(*[F.when(F.expr(r.condition), F.struct(F.lit(r.name).alias("rule"), F.lit(r.advice).alias("advice"))) for r in rules]), lambda x: x.isNotNull())
    rows = metrics.select("entity", "ts", F.explode(held).alias("r"))
    out = rows.groupBy("entity", "r.rule", "r.advice").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return out.filter(F.col("n") >= least)


def bursts(metrics: DataFrame, metric: str, window: int, threshold: float) -> DataFrame:
    """Rows where a metric changed by more than the threshold within `window` rows of its entity."""
    w = Window.partitionBy("entity").orderBy("ts")
    change = F.abs(F.col(metric) - F.lag(metric, window).over(w))
    return metrics.withColumn("change", change).filter(F.col("change") > threshold)
