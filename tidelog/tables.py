"""Tables between steps: written to the folder that spark.checkpoint.dir names, which driver and executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a local master gets one; on a cluster that would be a folder of each machine, so it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='tidelog-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, label: str = "step") -> DataFrame:
    """df as a table: its lineage ends there, and what a partition holds stays what it was."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with number: 1, 2, ... in the order of the columns, by the counts of parts rather than in one task."""
    tie = "__tie"
    ranged = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*order, tie).sortWithinPartitions(*order, tie)
    kept = written(ranged.withColumn("__at", F.monotonically_increasing_id()).drop(tie), "numbered")
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = kept.groupBy(part.alias("__part")).count()
    before = counts.select("__part", (F.sum("count").over(Window.orderBy("__part")) - F.col("count")).alias("__before"))
    out = kept.withColumn("__part", part).join(F.broadcast(before), "__part")  # a row for each part
    return out.withColumn("number", F.col("__before") + place + 1).drop("__part", "__before", "__at")
