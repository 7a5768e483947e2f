"""Reusable relational operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs as X


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by name; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def dedup_latest(df: DataFrame, keys: list[str], order: tuple[str, ...] = ("ingest_ts", "file_hash"), columns: list[str] | None = None, deal: list[str] | None = None) -> DataFrame:
    """One row for each key, nulls equal: the newest by ``order``, ties by the other columns, so reruns agree.

    The first row of a window: Spark keeps one row of a key in each task before the shuffle, so a hot key is reduced there.  A key column that
    the frame lacks is an error.

    With ``columns`` only the keys and these are kept.  The row is still chosen by all columns (ties by their hash), whichever are kept, and only
    what is kept travels.  With ``deal``, some of the keys, rows are dealt by these first and sorted once, after that: for keys that have few rows,
    as the sort before the shuffle reduces nothing then and spills the whole frame.  Groupings by the columns of ``deal`` need no further shuffle."""
    if lacking := [k for k in keys if k not in df.columns]:
        raise ValueError(f"no such key columns: {', '.join(lacking)}")
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(keys)
    lead = [c for c in order if c in rest]
    kept = df.columns if columns is None else [c for c in df.columns if c in keys or c in columns]
    if columns is not None:
        # A hash passes over nulls: where they are counts too.
        others = [F.col(c) for c in rest if c not in lead]
        tie = F.xxhash64(*others, *[c.isNull() for c in others]) if others else F.lit(0)
        df = df.withColumn("_tie", tie).select(*dict.fromkeys((*keys, *lead, "_tie", *kept)))
        lead = [*lead, "_tie"]
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in (*lead, *(c for c in kept if c not in (*keys, *lead)))])
    dealt = df.repartition(*deal) if deal else df
    return dealt.withColumn("_nth", F.row_number().over(newest)).where("_nth = 1").select(*kept)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order; missing ones are null, values that do not fit become null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def with_rates(df: DataFrame, games: str, wins: str = "wins") -> DataFrame:
    """Adds ``losses`` (games - wins) and ``win_rate`` (null without games)."""
    return df.withColumns({"losses": F.col(games) - F.col(wins), "win_rate": F.when(F.col(games) > 0, X.safe_divide(wins, games))})


AVERAGES = {
    "avg_kills": "kills", "avg_deaths": "deaths", "avg_assists": "assists", "avg_kda": "kda", "avg_gold_earned": "gold_earned", "avg_damage_dealt_to_champions": "total_damage_dealt_to_champions",
    "avg_damage_taken": "total_damage_taken", "avg_vision_score": "vision_score", "avg_cs": "cs",
}
TOTALS = {"total_kills": "kills", "total_deaths": "deaths", "total_assists": "assists"}


COUNTS = {"unique_players": "puuid", "unique_champions": "champion_id"}


def grouped(df: DataFrame, by: list[str]) -> DataFrame:
    """``df`` with its group as one column ``_by``, in which nulls are equal to nulls: frames grouped and joined by it are dealt once."""
    return df.withColumn("_by", F.struct(*by)).drop(*by)


def by_group(parts: list[DataFrame], by: list[str]) -> DataFrame:
    """Frames that have one row for each group ``_by`` side by side, with the group's columns; null groups are groups."""
    out = reduce(lambda a, b: a.join(b, "_by"), parts)
    return out.select(*[F.col("_by")[c].alias(c) for c in by], *[c for c in out.columns if c != "_by"])


def distinct_values(df: DataFrame, c: str, name: str) -> DataFrame:
    """The number ``name`` of values of ``c`` in each group ``_by``, by two groupings: the first is spread by the value too, so a hot group is cut,
    and no row is expanded."""
    return df.groupBy("_by", c).agg(F.lit(1).alias("_")).groupBy("_by").agg(F.count(c).alias(name))


def participant_metrics(df: DataFrame, by: list[str], counts: tuple[str, ...] = tuple(COUNTS), with_totals: bool = True, names: tuple[str, ...] = ()) -> DataFrame:
    """Matches, players and champions (those of ``counts``), wins and averages by any columns; ``names`` are columns whose value in the first match
    that has one is wanted too.

    Sums are first taken by match, so the second grouping counts matches too; each further distinct count is a narrow grouping of its own."""
    summed = list(dict.fromkeys((*AVERAGES.values(), *(TOTALS.values() if with_totals else ()))))
    df = grouped(df, by)
    first = df.groupBy("_by", "match_id").agg(X.true_count("win").alias("wins"), *[F.sum(c).alias(f"_s_{c}") for c in summed], *[F.count(c).alias(f"_n_{c}") for c in summed], *[F.min(c).alias(c) for c in names])
    total = lambda c: F.coalesce(F.sum(f"_s_{c}"), F.lit(0)).cast("long")
    sums = [total(c).alias(k) for k, c in TOTALS.items()] if with_totals else []
    means = [F.try_divide(F.sum(f"_s_{c}").cast("double"), F.sum(f"_n_{c}")).alias(k) for k, c in AVERAGES.items()]
    parts = [first.groupBy("_by").agg(F.count("match_id").alias("matches_played"), F.sum("wins").alias("wins"), *sums, *means, *[first_known(c, "match_id").alias(c) for c in names])]
    return by_group([*parts, *[distinct_values(df, COUNTS[name], name) for name in counts]], by)


def first_struct(c: str, date: str = "game_date") -> Column:
    """The smallest (date, value) of known values, as a struct that can be merged by ``min``."""
    return F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(date).isNull(), F.col(date), F.col(c).alias("value"))))


def first_known(c: str, date: str = "game_date") -> Column:
    """The non-null value of the earliest date, ties by the smaller value: a fixed choice where any known value will do."""
    return first_struct(c, date)["value"]
