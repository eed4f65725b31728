"""Joins as the pipelines need them: semi keys, attribute look-up, role-playing dimensions, matchups, value replacement."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prefixed(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def semi_keys(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct rows whose keys occur in other."""
    return df.join(other.select(*keys).distinct(), list(keys), "left_semi").distinct()


def attr_lookup(df: DataFrame, other: DataFrame, keys: Sequence[str], attribute: str) -> DataFrame:
    """Adds an attribute of other; other is made distinct before the join, the rows after it."""
    return df.join(other.select(*keys, attribute).distinct(), list(keys), "left").distinct()


def role_join(df: DataFrame, dim: DataFrame, dim_key: str, roles: Mapping[str, str], on: Sequence[str] = ()) -> DataFrame:
    """Joins one dimension once for each role: roles maps a key column of df to the prefix of what it brings."""
    for key, prefix in roles.items():
        side = dim.select(*[F.col(c).alias(("__on_" if c in on else prefix) + c) for c in dim.columns])
        match = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__on_{c}") for c in on], F.col(key) == F.col(prefix + dim_key))
        df = df.join(side, match, "left").drop(prefix + dim_key, *[f"__on_{c}" for c in on])
    return df


def role_union(df: DataFrame, common: Sequence[str], roles: Sequence[Mapping[str, str]]) -> DataFrame:
    """One row a role: each mapping says which columns a role gives, and their names."""
    return reduce(DataFrame.unionByName, [df.select(*common, *[F.col(source).alias(name) for source, name in role.items()]) for role in roles])


def right_then_drop(df: DataFrame, other: DataFrame, on: Sequence[str], required: str) -> DataFrame:
    """Right join, then rows whose required column is null are dropped: an inner join if it is never null in df."""
    return df.join(other, list(on), "inner").na.drop(subset=[required])


def nullsafe_left(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join on columns where null meets null; many-to-many matches stay."""
    side = other.select(*[F.col(c).alias(f"__{c}") if c in on else F.col(c) for c in other.columns])
    condition = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on])
    return df.join(side, condition, "left").drop(*[f"__{c}" for c in on])


def matchup(games: DataFrame, stats: DataFrame, keys: Sequence[str], team: str = "team", away: str = "away_team", home: str = "home_team") -> DataFrame:
    """Both teams' statistics beside each distinct pair."""
    pairs = games.select(*keys, away, home).distinct()
    for side, prefix in ((away, "away_"), (home, "home_")):
        pairs = pairs.join(prefixed(stats.withColumnRenamed(team, "__team"), prefix, keep=keys).withColumnRenamed(f"{prefix}__team", side), [*keys, side], "left")
    return pairs


def replace_values(df: DataFrame, mapping: DataFrame, columns: Sequence[str], old: str = "old", new: str = "new") -> DataFrame:
    """Replaces values by a (small) table; what isn't in it stays."""
    for c in columns:
        side = mapping.select(F.col(old).alias("__old"), F.col(new).alias("__new"))
        df = df.join(side, F.col(c) == F.col("__old"), "left").withColumn(c, F.coalesce("__new", c)).drop("__old", "__new")
    return df


def distinct_over(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    return df.select(F.explode(F.array(*columns)).alias(name)).distinct()
