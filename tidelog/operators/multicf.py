"""Several column families read as one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _ranked(families: Sequence[tuple[str, DataFrame]], key: str) -> DataFrame:
    out = None
    for i, (name, df) in enumerate(families):
        part = df.select(F.col(key), F.lit(i).alias("cf_order"), F.lit(name).alias("cf"), "columns")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no column families")
    return out


def coalesce(families: Sequence[tuple[str, DataFrame]], key: str = "user_key") -> DataFrame:
    """(key, columns): the union of the families' entities by key; a column's value is that of the last family in the list that has it."""
    cells = _ranked(families, key).select(key, "cf_order", F.explode("columns").alias("name", "value"))
    best = cells.groupBy(key, "name").agg(F.max(F.struct("cf_order", "value")).alias("b"))
    return best.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", F.col("b.value").alias("value"))))).alias("columns"))


def attribute_groups(families: Sequence[tuple[str, DataFrame]], key: str = "user_key") -> DataFrame:
    """(key, groups): for each key the families that have it, in list order, with their columns."""
    rows = _ranked(families, key).withColumn("entries", F.sort_array(F.map_entries("columns")))
    groups = F.sort_array(F.collect_list(F.struct("cf_order", "cf", "entries")))
    out = rows.groupBy(key).agg(groups.alias("g"))
    return out.select(key, F.transform("g", lambda g: F.struct(g["cf"].alias("cf"), F.map_from_entries(g["entries"]).alias("columns"))).alias("groups"))


def split_groups(entities: DataFrame, key: str = "user_key") -> DataFrame:
    """One row for each family of an entity written as attribute groups: the inverse of attribute_groups()."""
    return entities.select(key, F.explode("groups").alias("g")).select(key, "g.cf", "g.columns")
