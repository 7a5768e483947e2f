"""SQL registries: simple gold forms, feature queries and dashboard queries, run over temporary views."""

from __future__ import annotations

from pyspark.sql import DataFrame

GOLD_SQL = {
    "dim_date": "SELECT DISTINCT game_date FROM participants WHERE game_date IS NOT NULL",
    "dim_match": "SELECT DISTINCT match_id, game_date FROM participants",
    "dim_summoner": "SELECT DISTINCT puuid FROM participants",
    "dim_champion": "SELECT DISTINCT champion_id, champion_name FROM participants",
    "dim_team": "SELECT DISTINCT team_id FROM teams",
    "dim_rank": "SELECT DISTINCT queue, tier, rank FROM ranked",
    "fact_participant_performance": "SELECT match_id, participant_id, puuid, champion_id, win, kills, deaths, assists FROM participants",
    "fact_team_objectives": "SELECT match_id, team_id, win, dragon_kills, baron_kills FROM teams",
    "fact_rank_snapshot": "SELECT puuid, queue, tier, rank, league_points FROM ranked",
    "fact_timeline_frames": "SELECT match_id, frame_index, frame_timestamp FROM timeline_frames",
    "fact_timeline_events": "SELECT match_id, frame_index, event_index, event_type FROM timeline_events",
    "mart_player_daily_performance": "SELECT game_date, puuid, count(DISTINCT match_id) AS matches_played, sum(kills) AS total_kills FROM participants GROUP BY game_date, puuid",
    "mart_champion_daily_performance": "SELECT game_date, champion_id, count(DISTINCT match_id) AS matches_played FROM participants GROUP BY game_date, champion_id",
    "mart_role_daily_performance": "SELECT game_date, lane, count(DISTINCT match_id) AS matches_played FROM participants GROUP BY game_date, lane",
    "mart_rank_daily_summary": "SELECT game_date, queue, tier, rank, count(DISTINCT puuid) AS players FROM ranked GROUP BY game_date, queue, tier, rank",
    "mart_team_objective_daily_summary": "SELECT game_date, team_id, count(DISTINCT match_id) AS games_played FROM teams GROUP BY game_date, team_id",
}
FEATURE_SQL = {
    "match_win_features": "SELECT match_id, team_id, baron_kills, dragon_kills, win AS label FROM fact_team_objectives",
    "player_performance_features": "SELECT match_id, puuid, champion_id, kills, deaths, assists, gold_earned, win AS label FROM fact_participant_performance",
    "champion_meta_features": "SELECT champion_id, champion_name, matches_played AS picks, win_rate FROM mart_champion_daily_performance",
}
BI_SQL = {
    "bi_top50": "SELECT game_date, champion_id, champion_name, matches_played, win_rate FROM mart_champion_daily_performance ORDER BY game_date DESC, matches_played DESC, champion_id LIMIT 50",
    "bi_player": "SELECT game_date, puuid, matches_played, wins, losses FROM mart_player_daily_performance ORDER BY game_date DESC, matches_played DESC, puuid",
    "bi_pick_rate": "SELECT game_date, champion_id, matches_played AS picks, matches_played * 1.0D / sum(matches_played) OVER (PARTITION BY game_date) AS pick_rate FROM mart_champion_daily_performance",
    "bi_matches_per_day": "SELECT game_date, count(DISTINCT match_id) AS matches FROM fact_participant_performance GROUP BY game_date",
    "bi_roles": "SELECT team_position, sum(matches_played) AS matches, sum(wins) AS wins FROM mart_role_daily_performance GROUP BY team_position",
    "bi_tiers": "SELECT tier, count(*) AS entries FROM fact_rank_snapshot GROUP BY tier",
    "bi_objectives": "SELECT team_side, sum(dragon_kills) AS dragons, sum(baron_kills) AS barons, count_if(win) AS wins FROM fact_team_objectives GROUP BY team_side",
}


def run(sql: str, tables: dict[str, DataFrame]) -> DataFrame:
    """The query over the frames it names."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)


def materialise(tables: dict[str, DataFrame], root: str, names: list[str] | None = None, fmt: str = "parquet") -> dict[str, DataFrame]:
    """Write the feature queries to ``root/platinum/name`` and read them back."""
    out = {}
    for name in names or FEATURE_SQL:
        df = run(FEATURE_SQL[name], tables)
        df.write.mode("overwrite").format(fmt).save(f"{root}/platinum/{name}")
        out[name] = df.sparkSession.read.format(fmt).load(f"{root}/platinum/{name}")
    return out
