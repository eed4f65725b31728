"""Daily partial sums of a play stream.

The batch plans never read plays again once they are summed up by (season, week, date, team); a stream of landed files can
keep these sums current. Late plays are taken until the watermark has passed their day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import schemas


def read_plays(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    rows = spark.readStream.schema(schemas.PLAYS).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows.withColumn("day", F.to_timestamp("game_date")).where("day is not null")


def partial_sums(plays: DataFrame, stats: Sequence[str], lateness: str = "7 days") -> DataFrame:
    """day, season, week, posteam, play_type: rows, and sum and non-null count of each statistic."""
    sums = [F.sum(c).alias(c) for c in stats] + [F.count(c).alias(f"n_{c}") for c in stats]
    keyed = plays.withWatermark("day", lateness).groupBy(F.window("day", "1 day").alias("w"), "season", "week", "posteam", "play_type").agg(F.count("*").alias("n"), *sums)
    return keyed.select(F.col("w.start").cast("date").alias("game_date"), "season", "week", "posteam", "play_type", "n", *stats, *[f"n_{c}" for c in stats])


def keep_sums(sums: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each day's final sums once its watermark has passed."""
    return sums.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
