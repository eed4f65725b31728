"""Readers and writers: season- and window-partitioned Parquet, CSV with keys in file names, nested JSON, landing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..functions.scalars import file_keys
from . import schemas

WINDOW = ["season", "week", "lookback"]


def parquet(spark: SparkSession, path: str, schema: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """A Parquet table; of the given columns only, if any are given."""
    df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    df = df.select(*columns) if columns else df
    return schemas.nan_to_null(df)


def sched(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The schedule; of the given columns only, if any are given. A column that the files lack is null."""
    return parquet(spark, path, schemas.SCHED, columns)


def plays(spark: SparkSession, path: str, seasons: Sequence[int] | None = None) -> DataFrame:
    """Plays of the given seasons from a dataset partitioned by season. Seasons that aren't there give no rows; undated plays are dropped."""
    df = parquet(spark, path, schemas.PLAYS)
    if seasons is not None:
        df = df.where(F.col("season").isin(list(seasons)))
    return df.withColumn("game_date", F.to_date("game_date")).where("game_date is not null")


def in_seasons(plays: DataFrame, weeks: DataFrame, season: str = "h_season") -> DataFrame:
    """The plays of the weeks' seasons. The seasons (a row each) are broadcast, so a dataset partitioned by season is pruned as the query runs."""
    wanted = weeks.select(F.col(season).alias("season")).distinct()
    return plays.join(F.broadcast(wanted), "season", "left_semi")


def passer_ratings(spark: SparkSession, path: str) -> DataFrame:
    return parquet(spark, path, schemas.PASSER_RATINGS)


def odds(spark: SparkSession, path: str) -> DataFrame:
    """Landed odds feeds, each file one JSON array."""
    return spark.read.schema(schemas.ODDS).json(path, multiLine=True)


def odds_array(spark: SparkSession, path: str, lead: str = '{"commence_time"', schema: str = schemas.ODDS, bad: str = "_bad") -> DataFrame:
    """The elements of landed JSON arrays of any size, one a row, with the text of those that can't be read in column `bad`.

    Lines end wherever an element begins (lead: its first characters, which begin nothing else; inside strings quotes are escaped), so one file is
    read by as many tasks as it has splits, and no task holds an array.
    """
    pieces = spark.read.text(path, lineSep=lead).select(F.regexp_replace("value", r"[,\]\s]*$", "").alias("rest")).where(F.trim("rest") != "[").where("rest != ''")
    parsed = F.from_json(F.concat(F.lit(lead), "rest"), f"{schema}, {bad} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad})
    return pieces.select(parsed.alias("e")).select("e.*")


def window_slice(spark: SparkSession, path: str, season: int, week: int, lookback: int) -> DataFrame:
    """One window's rows of a dataset partitioned by season, week and lookback: a partition filter."""
    return spark.read.parquet(path).where((F.col("season") == season) & (F.col("week") == week) & (F.col("lookback") == lookback))


def keyed_csv(spark: SparkSession, directory: str, schema: str = schemas.PREDICTIONS, bad: str = "_bad") -> DataFrame:
    """All rows of a directory's CSV files with file, season, week, lookback; rows that don't fit the schema have their text in column `bad`.

    The keys are those of a name like `bt_2024_5_20.csv`, of the file or of the folder of that name which a job has written; null where a name has none.
    """
    rows = spark.read.schema(f"{schema}, {bad} string").option("recursiveFileLookup", True).csv(directory, header=True, pathGlobFilter="*.csv", columnNameOfCorruptRecord=bad)
    parts = F.split(F.col("_metadata.file_path"), "/")
    folder, name = F.element_at(parts, -2), F.element_at(parts, -1)
    rows = rows.select("*", F.when(folder.endswith(".csv"), folder).otherwise(name).alias("file"))
    # a row is bad by any of its columns, so all are read even where only `bad` is asked for
    values = F.coalesce(*[F.col(f"`{f.name}`").cast("string") for f in rows.schema if f.name not in (bad, "file")])
    rows = rows.withColumn(bad, F.when(F.col(bad).isNotNull() | values.isNotNull(), F.col(bad)))
    keys = file_keys(F.col("file"))
    return rows.withColumns({"season": keys["season"], "week": keys["week"], "lookback": keys["lookback"]})


def csv_account(spark: SparkSession, directory: str, schema: str = schemas.PREDICTIONS) -> DataFrame:
    """file, keyed, n_rows, n_bad: what a scan of the directory takes and what it leaves out."""
    keyed = F.col("season").isNotNull() & F.col("week").isNotNull()
    return keyed_csv(spark, directory, schema).groupBy("file").agg(F.bool_and(keyed).alias("keyed"), F.count("*").alias("n_rows"), F.count("_bad").alias("n_bad"))


def predictions_csv(spark: SparkSession, directory: str, lookback: int | None = None, schema: str = schemas.PREDICTIONS) -> DataFrame:
    """The rows of `keyed_csv` that have season and week and fit the schema.

    lookback: files whose fourth token starts with it (its first two characters).
    """
    rows = keyed_csv(spark, directory, schema).where("_bad is null").na.drop(subset=["season", "week"])
    if lookback is not None:
        rows = rows.where(F.col("lookback") == str(lookback))
    return rows.drop("file", "lookback", "_bad")


def promoted(spark: SparkSession, path: str) -> DataFrame:
    """A headerless table (CSV lines, no line breaks in fields) whose first line names the columns.

    The first line is the first by file name and place in the file, however rows are dealt out; a name that comes again has its place added (`abbr_2`).
    """
    place = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    lines = spark.read.text(path).select("value", place.alias("place"))
    first = lines.agg(F.min_by("value", "place").alias("head"), F.min("place").alias("place")).first()
    if first["head"] is None:
        raise ValueError(f"{path} holds no line that could name its columns")
    plain = spark.range(1).select(F.from_csv(F.lit(first["head"]), ", ".join(f"c{i} string" for i in range(first["head"].count(",") + 1))).alias("c")).select("c.*").first()
    found = [n for n in plain if n is not None]
    names = [n if n not in found[:i] else f"{n}_{i}" for i, n in enumerate(found)]
    head = F.struct(*[F.lit(first["place"][k]).alias(k) for k in ("file", "start", "at")])
    rows = lines.where(F.col("place") != head).select(F.from_csv("value", ", ".join(f"c{i} string" for i in range(len(names)))).alias("c")).select("c.*")
    return rows.toDF(*names)


def shared_path(spark: SparkSession, name: str) -> str:
    """A path that nothing else uses in the folder that driver and executors share."""
    return scratch.path(spark, name)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_by_season(df: DataFrame, path: str) -> None:
    """Replaces the seasons that df holds and leaves the others. Rows are dealt out by season and size: a large season is written by many tasks."""
    df.hint("rebalance", "season").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("season").parquet(path)


def write_window(df: DataFrame, path: str, season: int, week: int, lookback: int) -> None:
    keyed = df.withColumns({"season": F.lit(season), "week": F.lit(week), "lookback": F.lit(lookback)})
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*WINDOW).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_keyed_csv(df: DataFrame, directory: str, kind: str, lookback: int) -> None:
    """One folder `kind_season_week_lookback.csv` for each window of df, with one job; `keyed_csv` reads them back."""
    name = F.concat_ws("_", F.lit(kind), "season", "week", F.lit(f"{lookback}.csv"))
    df.withColumn("file", name).drop("season", "week", "lookback").hint("rebalance", "file").write.mode("overwrite").option("header", True).partitionBy("file").csv(directory)


def land(spark: SparkSession, source: str, target: str) -> None:
    """An exact copy of a text feed."""
    spark.read.text(source, wholetext=True).write.mode("overwrite").text(target)


def replace_everywhere(df: DataFrame, values: Mapping[str, str]) -> DataFrame:
    """Replaces values in every string column."""
    return df.na.replace(dict(values))


MANIFEST = "season int, week int, lookback int, version string, location string, n_rows long"


def file_version(spark: SparkSession, *paths: str) -> str:
    """Changes when a file of the datasets is added, removed or replaced: names, sizes and times, no contents."""
    out = []
    for p in paths:
        files = spark.read.parquet(p).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
        out.append(files.agg(F.count("*"), F.sum(F.xxhash64(*files.columns).cast("decimal(38,0)"))).first())
    return "/".join(f"{n}-{h or 0}" for n, h in out)


def content_version(df: DataFrame) -> str:
    """Changes when a row changes, whatever the rows' order."""
    return "{}-{}".format(*df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0))).first())


def published(spark: SparkSession, path: str, season: int, week: int, lookback: int, version: str | None = None) -> DataFrame | None:
    """What was last published of a window, empty or not; None if nothing was, or another version than the one asked for."""
    try:
        manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
        row = manifest.where((F.col("season") == season) & (F.col("week") == week) & (F.col("lookback") == lookback)).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if row is None or (version is not None and row["version"] != version):
        return None
    return spark.read.parquet(f"{path}/{row['location']}")


def publish(df: DataFrame, path: str, season: int, week: int, lookback: int, version: str) -> None:
    """Writes df in a folder of its own and then names it in the manifest: readers see the old rows or the new ones, never some of each."""
    spark, location = df.sparkSession, f"data/{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{location}")
    n = spark.read.parquet(f"{path}/{location}").count()
    row = spark.createDataFrame([(season, week, lookback, version, location, n)], MANIFEST)
    row.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*WINDOW).parquet(f"{path}/manifest")


def read_or_compute(spark: SparkSession, path: str, season: int, week: int, lookback: int, compute: Callable[[], DataFrame], version: str = "", reuse: bool = True) -> DataFrame:
    """The published window if it was made from this version of its input (and reuse holds), else computed and published."""
    kept = published(spark, path, season, week, lookback, version) if reuse else None
    if kept is None:
        publish(compute(), path, season, week, lookback, version)
        kept = published(spark, path, season, week, lookback)
    return kept
