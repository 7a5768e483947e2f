"""Dimensions, facts and daily marts, each from a dict of silver frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions import exprs as X
from . import relational as R

Tables = dict[str, DataFrame]


_NAMES = ("summoner_id", "summoner_name", "riot_id_game_name", "riot_id_tagline")
#: What sums and means of the marts are made of.
_MEASURES = ("win", *R.AVERAGES.values())


def participants(t: Tables, *columns: str) -> DataFrame:
    """Participants once each, with role and creep score, and of the other columns those of ``columns`` (none named: all that gold tables hold);
    ``participants_once``, where it is among the tables, is just that."""
    if "participants_once" in t:
        return t["participants_once"]
    wanted = columns or (*S.GOLD["fact_participant_performance"], "champion_name", *_NAMES)
    rows = t["participants"].withColumns({"team_position": X.normalized_role(), "cs": X.creep_score()})
    return R.dedup_latest(rows, S.SILVER_KEYS["participants"], columns=list(wanted), deal=["match_id"])


def teams(t: Tables, *columns: str) -> DataFrame:
    """Teams once each, with side and score, and of the other columns those of ``columns`` (none named: all that gold tables hold)."""
    if "teams_once" in t:
        return t["teams_once"]
    rows = t["teams"].withColumns({"team_side": X.team_side(), "objective_score": X.objective_score()})
    return R.dedup_latest(rows, S.SILVER_KEYS["teams"], columns=list(columns or S.GOLD["fact_team_objectives"]), deal=["match_id"])


def fact_participant_performance(t: Tables) -> DataFrame:
    return participants(t, *S.GOLD["fact_participant_performance"])


def dim_date(t: Tables) -> DataFrame:
    """Dates of all frames given."""
    dates = R.union_all([df.select("game_date") for df in t.values()]).where("game_date is not null").distinct()
    return dates.withColumns(X.date_parts())


def dim_match(t: Tables) -> DataFrame:
    return R.dedup_latest(t["matches"].where("match_id is not null"), ["match_id"], columns=S.GOLD["dim_match"], deal=["match_id"])


def _seen() -> list:
    return [F.min("game_date").alias("first_seen_game_date"), F.max("game_date").alias("last_seen_game_date")]


def dim_summoner(t: Tables) -> DataFrame:
    wanted = ["puuid", "game_date", *(c for c in S.GOLD["dim_summoner"] if c not in ("puuid", "first_seen_game_date", "last_seen_game_date"))]
    frames = [df.select(*[c for c in wanted if c in df.columns]) for k, df in t.items() if k in ("participants", "summoners", "ranked")]
    rows = R.conform(R.union_all(frames), T.StructType([f for f in (*S.LINEAGE_SCHEMA, *S.GOLD_SCHEMAS["dim_summoner"]) if f.name in wanted])).where("puuid is not null")
    names = [R.first_known(c).alias(c) for c in ("summoner_id", "account_id", "summoner_name", "riot_id_game_name", "riot_id_tagline")]
    return rows.groupBy("puuid").agg(*names, *[F.max(c).alias(c) for c in ("profile_icon_id", "revision_date", "summoner_level")], *_seen())


def dim_champion(t: Tables) -> DataFrame:
    return t["participants"].where("champion_id is not null").groupBy("champion_id").agg(R.first_known("champion_name").alias("champion_name"), *_seen())


def dim_team(t: Tables) -> DataFrame:
    return t["teams"].where("team_id is not null").groupBy("team_id", X.team_side().alias("team_side")).agg(*_seen())


def dim_rank(t: Tables) -> DataFrame:
    return t["ranked"].select("queue", "tier", "rank").dropna().distinct().withColumn("rank_order", X.rank_order())


def mart_player_daily(t: Tables) -> DataFrame:
    """By date and player.  Wins count rows and matches are distinct, so losses may be negative for doubled rows."""
    rows = participants(t, "game_date", "puuid", "champion_id", *_MEASURES, *_NAMES).where("puuid is not null")
    return R.with_rates(R.participant_metrics(rows, ["game_date", "puuid"], ("unique_champions",), names=_NAMES), "matches_played")


def mart_champion_daily(t: Tables) -> DataFrame:
    rows = participants(t, "game_date", "champion_id", "champion_name", "puuid", *_MEASURES)
    return R.with_rates(R.participant_metrics(rows, ["game_date", "champion_id", "champion_name"], ("unique_players",)), "matches_played")


def mart_role_daily(t: Tables) -> DataFrame:
    rows = participants(t, "game_date", "team_position", "puuid", "champion_id", *_MEASURES)
    return R.with_rates(R.participant_metrics(rows, ["game_date", "team_position"], with_totals=False), "matches_played")


def mart_rank_daily(t: Tables) -> DataFrame:
    flags = [X.true_count(c).alias(f"{c}_players") for c in ("hot_streak", "veteran", "fresh_blood", "inactive")]
    block = [X.distinct_players().alias("players"), F.avg("league_points").alias("avg_league_points"), X.long_sum("wins").alias("total_wins"), X.long_sum("losses").alias("total_losses"), F.avg("win_rate").alias("avg_win_rate")]
    return t["ranked"].groupBy("game_date", "queue", "tier", "rank").agg(*block, *flags)


def mart_team_objective_daily(t: Tables) -> DataFrame:
    means = [F.avg(c).alias(f"avg_{c}") for c in (*X.OBJECTIVES, "objective_score")]
    by = ["game_date", "team_id", "team_side"]
    rows = R.grouped(teams(t), by)
    main = rows.groupBy("_by").agg(X.true_count("win").alias("wins"), *means)
    return R.with_rates(R.by_group([main, R.distinct_values(rows, "match_id", "games_played")], by), "games_played")


BUILDERS: dict[str, tuple[Callable[[Tables], DataFrame], tuple[str, ...]]] = {
    "dim_date": (dim_date, ("participants",)),
    "dim_match": (dim_match, ("matches",)),
    "dim_summoner": (dim_summoner, ("participants", "summoners", "ranked")),
    "dim_champion": (dim_champion, ("participants",)),
    "dim_team": (dim_team, ("teams",)),
    "dim_rank": (dim_rank, ("ranked",)),
    "fact_participant_performance": (fact_participant_performance, ("participants",)),
    "fact_team_objectives": (teams, ("teams",)),
    "fact_rank_snapshot": (lambda t: t["ranked"], ("ranked",)),
    "fact_timeline_frames": (lambda t: t["timeline_frames"], ("timeline_frames",)),
    "fact_timeline_events": (lambda t: t["timeline_events"], ("timeline_events",)),
    "mart_player_daily_performance": (mart_player_daily, ("participants",)),
    "mart_champion_daily_performance": (mart_champion_daily, ("participants",)),
    "mart_role_daily_performance": (mart_role_daily, ("participants",)),
    "mart_rank_daily_summary": (mart_rank_daily, ("ranked",)),
    "mart_team_objective_daily_summary": (mart_team_objective_daily, ("teams",)),
}
#: Other names of the five marts.
player_metrics, champion_metrics, role_metrics, rank_metrics, team_objective_metrics = mart_player_daily, mart_champion_daily, mart_role_daily, mart_rank_daily, mart_team_objective_daily


def build(t: Tables, tables: list[str] | None = None, once: Tables | None = None) -> tuple[dict[str, DataFrame], dict[str, list[str]]]:
    """The requested gold tables, conformed to their schemas, and those skipped with the sources they lack.  ``once`` may hold
    ``participants_once`` and ``teams_once``, deduplicated already."""
    out, skipped = {}, {}
    for name in tables or BUILDERS:
        builder, sources = BUILDERS[name]
        missing = [s for s in sources if s not in t]
        if missing:
            skipped[name] = missing
        else:
            ready = {k: df for k, df in (once or {}).items() if not name.startswith("dim_") and k.removesuffix("_once") in sources}
            out[name] = R.conform(builder({s: t[s] for s in sources} | ready), S.GOLD_SCHEMAS[name])
    return out, skipped
