"""Registered queries over the domain frames, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas as S
from . import views as V
from .functions import exprs as X
from .functions import parse
from .operators import gold as G
from .operators import relational as R
from .plans import features as P
from .quality import report as Q
from .quality import rules as QR

QUERIES: dict = {}
SQL: dict[str, str] = {}
_ROLES = ", ".join(f"'{r}'" for r in X.ROLES)


def _rounded(df: DataFrame) -> DataFrame:
    """Averages are compared to six places: sums of doubles differ in their last bits."""
    return df.select(*[F.round(c, 6).alias(c) if c.startswith("avg_") or c in ("kda", "win_rate", "pick_rate") else F.col(c) for c in df.columns])


def _with(*tables: str, extra: str = "") -> str:
    return "WITH " + ", ".join(f"{t} AS ({V.SQL[t]})" for t in tables) + extra


def _dedup(table: str) -> str:
    keys = ", ".join(S.SILVER_KEYS[table])
    return f", {table}_1 AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ingest_ts DESC, file_hash DESC) AS rn FROM {table}) WHERE rn = 1)"


_BUCKET = lambda c: f"CASE WHEN upper(trim({c})) IN ({_ROLES}) THEN upper(trim({c})) END"
_PEOPLE = _with("participants", extra=_dedup("participants") + f", p AS (SELECT * REPLACE (coalesce({_BUCKET('team_position')}, {_BUCKET('individual_position')}, {_BUCKET('lane')}, {_BUCKET('role')}, 'UNKNOWN') AS team_position), coalesce(total_minions_killed, 0) + coalesce(neutral_minions_killed, 0) AS cs FROM participants_1) ")
_SCORE = " + ".join(f"coalesce({c}, 0)" for c in X.OBJECTIVES)
_SIDES = _with("teams", extra=_dedup("teams") + f", t AS (SELECT *, CASE team_id WHEN 100 THEN 'BLUE' WHEN 200 THEN 'RED' ELSE 'UNKNOWN' END AS team_side, {_SCORE} AS objective_score FROM teams_1) ")
_AVG = ", ".join(f"round(avg({c}), 6) AS {k}" for k, c in R.AVERAGES.items())
_TOT = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {k}" for k, c in R.TOTALS.items())
_FIRST = lambda c, d="game_date": f"arg_min({c}, {d} || '|' || CAST({c} AS VARCHAR)) FILTER ({c} IS NOT NULL) AS {c}"


def _mart(by: str, block: str, source: str, games: str) -> str:
    return f"{source} SELECT * EXCLUDE (g), {games} - wins AS losses, round(CAST(wins AS DOUBLE) / {games}, 6) AS win_rate FROM (SELECT {by}, {block}, 1 AS g FROM {'p' if source == _PEOPLE else 't'} GROUP BY {by})"


_WINS = "CAST(count(*) FILTER (win) AS BIGINT) AS wins"
_N = lambda c, k: f"count(DISTINCT {c}) AS {k}"

GOLD_SQL = {
    "dim_date": _with("participants") + " SELECT DISTINCT game_date, replace(game_date, '-', '') AS date_key, year(CAST(game_date AS DATE)) AS date_year, month(CAST(game_date AS DATE)) AS date_month, day(CAST(game_date AS DATE)) AS date_day, dayofweek(CAST(game_date AS DATE)) + 1 AS day_of_week FROM participants",
    "dim_match": _with("matches") + f" SELECT {', '.join(S.GOLD['dim_match'])} FROM matches",
    "dim_summoner": _with("participants", "summoners", "ranked", extra=""", u AS (SELECT puuid, game_date, summoner_id, NULL::VARCHAR AS account_id, summoner_name, riot_id_game_name, riot_id_tagline, NULL::BIGINT AS profile_icon_id, NULL::BIGINT AS revision_date, NULL::BIGINT AS summoner_level FROM participants
        UNION ALL SELECT puuid, game_date, summoner_id, account_id, NULL, NULL, NULL, profile_icon_id, revision_date, summoner_level FROM summoners UNION ALL SELECT puuid, game_date, summoner_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM ranked)""")
    + f" SELECT puuid, {', '.join(_FIRST(c) for c in ('summoner_id', 'account_id', 'summoner_name', 'riot_id_game_name', 'riot_id_tagline'))}, max(profile_icon_id) AS profile_icon_id, max(revision_date) AS revision_date, max(summoner_level) AS summoner_level, min(game_date) AS first_seen_game_date, max(game_date) AS last_seen_game_date FROM u GROUP BY puuid",
    "dim_champion": _with("participants") + f" SELECT champion_id, {_FIRST('champion_name')}, min(game_date) AS first_seen_game_date, max(game_date) AS last_seen_game_date FROM participants GROUP BY champion_id",
    "dim_team": _with("teams") + " SELECT team_id, CASE team_id WHEN 100 THEN 'BLUE' WHEN 200 THEN 'RED' ELSE 'UNKNOWN' END AS team_side, min(game_date) AS first_seen_game_date, max(game_date) AS last_seen_game_date FROM teams GROUP BY 1, 2",
    "dim_rank": _with("ranked") + f" SELECT DISTINCT queue, tier, rank, CAST(10 * coalesce(list_position({list(X.TIERS)}, upper(tier)), 0) + coalesce(list_position({list(X.DIVISIONS)}, upper(rank)), 0) AS BIGINT) AS rank_order FROM ranked",
    "fact_participant_performance": _PEOPLE + f"SELECT {', '.join('round(kda, 6) AS kda' if c == 'kda' else c for c in S.GOLD['fact_participant_performance'])} FROM p",
    "fact_team_objectives": _SIDES + f"SELECT {', '.join(S.GOLD['fact_team_objectives'])} FROM t",
    "fact_rank_snapshot": _with("ranked") + f" SELECT {', '.join('round(win_rate, 6) AS win_rate' if c == 'win_rate' else c for c in S.GOLD['fact_rank_snapshot'])} FROM ranked",
    "fact_timeline_frames": f"WITH timeline_frames AS ({V.SQL['timeline_frames']}) SELECT {', '.join(S.GOLD['fact_timeline_frames'])} FROM timeline_frames",
    "fact_timeline_events": _with("timeline_events") + f" SELECT {', '.join(S.GOLD['fact_timeline_events'])} FROM timeline_events",
    "mart_player_daily_performance": _mart("game_date, puuid", ", ".join([_N("match_id", "matches_played"), _N("champion_id", "unique_champions"), _WINS, _TOT, _AVG, *(_FIRST(c, "match_id") for c in ("summoner_id", "summoner_name", "riot_id_game_name", "riot_id_tagline"))]), _PEOPLE, "matches_played"),
    "mart_champion_daily_performance": _mart("game_date, champion_id, champion_name", ", ".join([_N("match_id", "matches_played"), _N("puuid", "unique_players"), _WINS, _TOT, _AVG]), _PEOPLE, "matches_played"),
    "mart_role_daily_performance": _mart("game_date, team_position", ", ".join([_N("match_id", "matches_played"), _N("puuid", "unique_players"), _N("champion_id", "unique_champions"), _WINS, _AVG]), _PEOPLE, "matches_played"),
    "mart_rank_daily_summary": _with("ranked") + " SELECT game_date, queue, tier, rank, count(DISTINCT coalesce(summoner_id, puuid)) AS players, round(avg(league_points), 6) AS avg_league_points, CAST(sum(wins) AS BIGINT) AS total_wins, CAST(sum(losses) AS BIGINT) AS total_losses, round(avg(win_rate), 6) AS avg_win_rate, " + ", ".join(f"count(*) FILTER ({c}) AS {c}_players" for c in ("hot_streak", "veteran", "fresh_blood", "inactive")) + " FROM ranked GROUP BY 1, 2, 3, 4",
    "mart_team_objective_daily_summary": _mart("game_date, team_id, team_side", ", ".join([_N("match_id", "games_played"), _WINS, *(f"round(avg({c}), 6) AS avg_{c}" for c in (*X.OBJECTIVES, "objective_score"))]), _SIDES, "games_played"),
}


def _gold_tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    sources = sorted({s for n in names for s in G.BUILDERS[n][1]})
    return G.build(V.silver(spark, sf_dir, *sources), list(names))[0]


def _register_gold(name: str) -> None:
    key = name.replace("_performance", "").replace("_summary", "") if name.startswith("mart_") else name
    QUERIES[key] = lambda spark, d: _rounded(_gold_tables(spark, d, name)[name])
    SQL[key] = GOLD_SQL[name]


for _name in G.BUILDERS:
    _register_gold(_name)


def _silver_query(table: str):
    return lambda spark, d: _rounded(parse.build_silver(V.payloads(spark, d), [table])[table])


def _silver_sql(table: str) -> str:
    """What the payloads' tables hold, lineage included: rows of a match carry its file, rows of a timeline that of its user and day."""
    rows = f"{table}_1" if table == "participants" else table
    own = {c: f"round(r.{c}, 6) AS {c}" if c in ("kda", "win_rate") else f"r.{c}" for c in S.SILVER[table]}
    if table in parse.ROUTES["matches"]:
        own |= {c: f"m.{c}" for c in S.LINEAGE} | {"game_date": "CAST(CAST(make_timestamp(m.game_creation * 1000) AS DATE) AS VARCHAR) AS game_date"}
        people = "(SELECT match_id, count(DISTINCT participant_id) AS n FROM participants GROUP BY 1)"
        source = f"FROM {rows} r JOIN matches m USING (match_id)" + (f" LEFT JOIN {people} p USING (match_id)" if table == "matches" else "")
        if table == "matches":
            own["participant_count"] = "coalesce(p.n, 0) AS participant_count"
        head = _with("matches", "participants", *({table} - {"matches", "participants"}), extra=_dedup("participants"))
    elif table in parse.ROUTES["timelines"]:
        own |= {"source_file": "'raw/timelines/' || r.match_id AS source_file", "file_hash": "r.match_id AS file_hash", "ingest_ts": "'2024-01-01T00:00:00Z' AS ingest_ts"}
        own |= {c: f"'2024-01-01' AS {c}" for c in ("ingest_date", "game_date")}
        head, source = f"WITH {table} AS ({V.SQL[table]})", f"FROM {table} r"
    else:
        head, source = _with(table), f"FROM {table} r"
    return f"{head} SELECT DISTINCT {', '.join(own.values())} {source}"


for _t in S.SILVER:
    QUERIES[f"silver_{_t}"] = _silver_query(_t)
    SQL[f"silver_{_t}"] = _silver_sql(_t)


def expr_all(spark: SparkSession, d: str) -> DataFrame:
    line = spark.read.parquet(f"{d}/lineitem.parquet")
    text = F.when(F.col("l_partkey") % 5 == 0, "x").when(F.col("l_partkey") % 5 == 1, "100").when(F.col("l_partkey") % 5 == 2, " 200 ").when(F.col("l_partkey") % 5 == 3, "300")
    ms = (F.col("l_partkey").cast("long") - 500) * 86_400_000
    return line.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(X.kda("l_quantity", F.round(F.col("l_discount") * 100), "l_tax"), 6).alias("kda"), F.round(X.win_rate("l_linenumber", F.col("l_partkey") % 3), 6).alias("rate"),
        F.round(X.safe_divide("l_quantity", F.col("l_suppkey") % 2), 6).alias("ratio"), X.standard_team(text).alias("team"), X.game_date(ms).alias("day"), X.detect_dataset(F.concat(F.lit("/raw/"), F.when(F.col("l_linenumber") == 1, "Matches").otherwise("other"), F.lit("/a.json"))).alias("dataset"),
        X.non_negative(F.col("l_partkey") - 50).alias("sign_ok"),
    )


QUERIES["expr_all"] = expr_all
SQL["expr_all"] = """SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN round(l_discount * 100) = 0 THEN l_quantity + l_tax ELSE (l_quantity + l_tax) / round(l_discount * 100) END, 6) AS kda,
    round(CASE WHEN l_linenumber + l_partkey % 3 = 0 THEN NULL ELSE l_linenumber::DOUBLE / (l_linenumber + l_partkey % 3) END, 6) AS rate, round(CASE WHEN l_suppkey % 2 = 0 THEN NULL ELSE l_quantity / (l_suppkey % 2) END, 6) AS ratio,
    CASE l_partkey % 5 WHEN 1 THEN 100::BIGINT WHEN 2 THEN 200::BIGINT END AS team, CASE WHEN l_partkey > 500 THEN CAST(CAST(make_timestamp((l_partkey - 500) * 86400000000) AS DATE) AS VARCHAR) END AS day,
    CASE WHEN l_linenumber = 1 THEN 'matches' ELSE 'unknown' END AS dataset, l_partkey >= 50 AS sign_ok FROM lineitem"""


def _sql_query(sql: str, silver: tuple[str, ...] = (), gold: tuple[str, ...] = ()):
    def run(spark: SparkSession, d: str) -> DataFrame:
        tables = (V.silver(spark, d, *silver) if silver else {}) | (_gold_tables(spark, d, *gold) if gold else {})
        return _rounded(P.run(sql, tables))

    return run


for _n, _q in P.GOLD_SQL.items():
    _from = _q.split(" FROM ")[1].split()[0]
    QUERIES[f"sql_{_n}"] = _sql_query(_q, (_from,))
    SQL[f"sql_{_n}"] = (f"WITH timeline_frames AS ({V.SQL[_from]}) " if _from == "timeline_frames" else _with(_from) + " ") + _q.replace("sum(kills)", "CAST(sum(kills) AS BIGINT)")
for _n, _q in (P.FEATURE_SQL | P.BI_SQL).items():
    _from = _q.split(" FROM ")[1].split()[0]
    _key = _n if _n.startswith("bi_") else f"feat_{_n}"
    QUERIES[_key] = _sql_query(_q, gold=(_from,))
    _duck = _q.replace("1.0D", "CAST(1 AS DOUBLE)").replace("matches_played * CAST(1 AS DOUBLE) / sum(matches_played) OVER (PARTITION BY game_date)", "round(CAST(matches_played AS DOUBLE) / sum(matches_played) OVER (PARTITION BY game_date), 6)")
    for _c in ("sum(matches_played)", "sum(wins)", "sum(dragon_kills)", "sum(baron_kills)"):
        _duck = _duck.replace(f"{_c} AS", f"CAST({_c} AS BIGINT) AS")
    SQL[_key] = f"WITH {_from} AS ({GOLD_SQL[_from]}) {_duck}"


def _checked(table: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = V.silver(spark, d, table)[table] if table in S.SILVER else _gold_tables(spark, d, table)[table]
        return QR.evaluate(df, table, QR.rules_for(table))

    return run


for _t in (*S.SILVER, *S.GOLD):
    QUERIES[f"dq_rules_{_t}"] = _checked(_t)


# The catalogue in SQL, written from its description and not from the rules: name, status if violated, violating rows (None: the rule counts
# none), and for rules that count no rows when they are violated.  ``t`` is the table, ``n`` its rows.
def _any(test: str, *columns: str) -> str:
    return f"(SELECT count(*) FROM t WHERE {' OR '.join(f'{c} {test}' for c in columns)})"


def _doubled(*key: str) -> str:
    return f"(SELECT n - count(*) FROM (SELECT DISTINCT {', '.join(key)} FROM t))"


def _common(required: tuple[str, ...], key: tuple[str, ...], signed: tuple[str, ...], flags: bool = False) -> list[tuple]:
    out = [("required_columns", "FAIL", None, "false"), ("column_count_positive", "FAIL", None, "false"), ("table_not_empty", "FAIL", None, "n < 1")]
    out += [("required_values_not_null", "FAIL", _any("IS NULL", *required), None), ("unique_business_key", "FAIL", _doubled(*key), None), ("non_negative_metrics", "FAIL", _any("< 0", *signed), None)]
    return [*out, ("boolean_column_types", "FAIL", None, "false")] if flags else out


_RATE = ("rates_between_zero_and_one", "FAIL", _any("NOT BETWEEN 0 AND 1", "win_rate"), None)
_TEAM = ("team_id_known_values", "WARN", _any("NOT IN (100, 200)", "team_id"), None)
_TIER = ("tier_known_values", "WARN", _any("NOT IN ('IRON', 'BRONZE', 'SILVER', 'GOLD', 'PLATINUM', 'EMERALD', 'DIAMOND', 'MASTER', 'GRANDMASTER', 'CHALLENGER')", "tier"), None)
_ROLE = ("role_known_values", "WARN", _any("NOT IN ('TOP', 'JUNGLE', 'MIDDLE', 'BOTTOM', 'UTILITY', 'UNKNOWN')", "team_position"), None)


def _games(target: str) -> tuple:
    return ("wins_losses_match_games", "FAIL", f"(SELECT count(*) FROM t WHERE coalesce(wins, 0) + coalesce(losses, 0) <> {target})", None)


def _positive(*columns: str) -> tuple:
    return ("positive_metrics", "FAIL", _any("<= 0", *columns), None)


def _tolerated(column: str) -> tuple:
    return (f"{column}_positive_tolerance", "FAIL", _any("<= 0", column), f"{_any('<= 0', column)} > 0.001 * n")


_OBJECTIVE_KILLS = ("baron_kills", "dragon_kills", "rift_herald_kills", "tower_kills", "inhibitor_kills", "champion_kills")
_AVG_KILLS = tuple(f"avg_{c}" for c in _OBJECTIVE_KILLS)
_PERSON = ("kills", "deaths", "assists", "kda", "gold_earned", "total_damage_dealt_to_champions", "total_damage_taken", "vision_score", "total_minions_killed", "neutral_minions_killed")
_MEANS = ("avg_kills", "avg_deaths", "avg_assists", "avg_kda", "avg_gold_earned", "avg_damage_dealt_to_champions", "avg_damage_taken", "avg_vision_score", "avg_cs")
_SUMS, _SCORES = ("total_kills", "total_deaths", "total_assists"), ("wins", "losses", "win_rate")
_MATCH = ("game_id", "queue_id", "game_creation", "game_start_timestamp", "game_end_timestamp", "game_duration", "participant_count")
_EVENT = ("frame_index", "event_index", "event_timestamp", "participant_id", "killer_id", "victim_id", "team_id")
_FRAME = ("frame_index", "frame_timestamp", "participant_frame_count", "event_count")
_RANKS = ("queue", "tier", "rank")
_LEAGUE = ("league_points", "wins", "losses", "win_rate")
RULE_SQL: dict[str, list[tuple]] = {
    "matches": _common(("match_id", "dataset", "game_date"), ("match_id",), _MATCH),
    "participants": [
        *_common(("match_id", "participant_id", "puuid", "champion_id", "team_id", "dataset", "game_date"), ("match_id", "participant_id"), ("participant_id", "champion_id", "team_id", *_PERSON), True),
        _TEAM,
    ],
    "teams": [*_common(("match_id", "team_id", "dataset", "game_date"), ("match_id", "team_id"), ("team_id", *_OBJECTIVE_KILLS), True), _TEAM],
    "summoners": _common(("puuid", "dataset", "game_date"), ("puuid",), ("profile_icon_id", "revision_date", "summoner_level")),
    "ranked": [*_common((*_RANKS, "puuid", "dataset", "game_date"), (*_RANKS, "puuid", "game_date"), _LEAGUE, True), _RATE],
    "timeline_frames": _common(("match_id", "frame_index", "dataset", "game_date"), ("match_id", "frame_index"), _FRAME),
    "timeline_events": _common(("match_id", "frame_index", "event_index", "event_type", "dataset", "game_date"), ("match_id", "frame_index", "event_index"), _EVENT),
    "dim_date": [
        *_common(("date_key", "game_date", "date_year", "date_month", "date_day"), ("date_key",), ("date_year", "date_month", "date_day", "day_of_week")),
        ("date_month_between", "FAIL", _any("NOT BETWEEN 1 AND 12", "date_month"), None),
        ("date_day_between", "FAIL", _any("NOT BETWEEN 1 AND 31", "date_day"), None),
        ("optional_boolean_column_types", "FAIL", "0", None),
    ],
    "dim_match": [
        *_common(("match_id", "game_date"), ("match_id",), _MATCH), ("optional_values_not_null", "FAIL", _any("IS NULL", "queue_id", "game_date"), None),
        _tolerated("game_duration"), _tolerated("participant_count"),
    ],
    "dim_summoner": [
        *_common(("puuid",), ("puuid",), ("profile_icon_id", "revision_date", "summoner_level")),
        ("valid_date_order", "FAIL", "(SELECT count(*) FROM t WHERE first_seen_game_date > last_seen_game_date)", None), ("nullable_identifier_null_rates", "FAIL", "0", None),
    ],
    "dim_champion": [
        *_common(("champion_id", "champion_name"), ("champion_id",), ("champion_id",)), ("row_count_expectation", "WARN", None, "n NOT BETWEEN 100 AND 250"),
        ("non_empty_strings", "FAIL", "(SELECT count(*) FROM t WHERE trim(champion_name) = '')", None),
    ],
    "dim_team": [*_common(("team_id", "team_side"), ("team_id",), ("team_id",)), ("row_count_expectation", "WARN", None, "n <> 2"), _TEAM],
    "dim_rank": [*_common(_RANKS, _RANKS, ("rank_order",)), _TIER],
    "fact_participant_performance": [
        *_common(("game_date", "match_id", "participant_id", "puuid", "champion_id"), ("match_id", "participant_id"), ("participant_id", "champion_id", "team_id", *_PERSON, "cs"), True), _TEAM, _ROLE,
    ],
    "fact_team_objectives": [*_common(("game_date", "match_id", "team_id"), ("match_id", "team_id"), ("team_id", *_OBJECTIVE_KILLS, "objective_score"), True), _TEAM],
    "fact_rank_snapshot": [*_common(("game_date", *_RANKS, "puuid"), ("game_date", *_RANKS, "puuid"), _LEAGUE, True), _RATE, _TIER],
    "fact_timeline_frames": _common(("game_date", "match_id", "frame_index"), ("match_id", "frame_index"), _FRAME),
    "fact_timeline_events": [
        *_common(("game_date", "match_id", "frame_index", "event_index", "event_type"), ("match_id", "frame_index", "event_index"), _EVENT),
        ("team_id_known_values", "WARN", _any("NOT IN (0, 100, 200)", "team_id"), None),
    ],
    "mart_player_daily_performance": [
        *_common(("game_date", "puuid", "matches_played", *_SCORES), ("game_date", "puuid"), ("matches_played", "unique_champions", *_SCORES, *_SUMS, *_MEANS)),
        _positive("matches_played", "unique_champions"), _RATE, _games("matches_played"),
    ],
    "mart_champion_daily_performance": [
        *_common(("game_date", "champion_id", "champion_name", "matches_played", *_SCORES), ("game_date", "champion_id"), ("champion_id", "matches_played", "unique_players", *_SCORES, *_SUMS, *_MEANS)),
        _positive("matches_played"), _RATE, _games("matches_played"),
    ],
    "mart_role_daily_performance": [
        *_common(("game_date", "team_position", "matches_played", *_SCORES), ("game_date", "team_position"), ("matches_played", "unique_players", "unique_champions", *_SCORES, *_MEANS)),
        _positive("matches_played"), _RATE, _games("matches_played"), _ROLE,
    ],
    "mart_rank_daily_summary": [
        *_common(
            ("game_date", *_RANKS, "players", "avg_win_rate"), ("game_date", *_RANKS),
            ("players", "avg_league_points", "total_wins", "total_losses", "avg_win_rate", "hot_streak_players", "veteran_players", "fresh_blood_players", "inactive_players"),
        ),
        _positive("players"), ("rates_between_zero_and_one", "FAIL", _any("NOT BETWEEN 0 AND 1", "avg_win_rate"), None), _TIER,
    ],
    "mart_team_objective_daily_summary": [
        *_common(("game_date", "team_id", "games_played", *_SCORES, *_AVG_KILLS), ("game_date", "team_id"), ("team_id", "games_played", *_SCORES, *_AVG_KILLS, "avg_objective_score")),
        _positive("games_played"), _RATE, _games("games_played"), _TEAM, ("team_count_positive", "FAIL", _any("<= 0", "games_played"), None),
        ("team_objective_summary_non_negative", "FAIL", _any("< 0", "wins", *_AVG_KILLS, "avg_objective_score"), None),
    ],
}


_NULLS = ("summoner_id", "riot_id_game_name", "riot_id_tagline", "summoner_name")
_NULL_COUNTS = " || ',' || ".join(f"'\"{c}\":' || (SELECT count(*) FROM t WHERE {c} IS NULL)" for c in _NULLS)
#: Details of the rules that have one; columns and values are whole in the tables of the catalogue.
DETAIL_SQL = {"required_columns": """'{"missing_columns": []}'""", "nullable_identifier_null_rates": f"'{{' || {_NULL_COUNTS} || '}}'"}


def _rule_sql(table: str) -> str:
    parts = []
    for rule, worst, failed, bad in RULE_SQL[table]:
        count = f"CAST({failed} AS BIGINT)" if failed else "NULL::BIGINT"
        parts.append(f"SELECT '{rule}' AS rule, {count} AS failed_rows, CASE WHEN {bad or f'{failed} > 0'} THEN '{worst}' ELSE 'PASS' END AS status, n AS total_rows, {DETAIL_SQL.get(rule, 'NULL')}::VARCHAR AS detail FROM size")
    return (
        f"WITH t AS ({V.SQL.get(table) or GOLD_SQL[table]}), size AS (SELECT count(*) AS n FROM t) "
        f"SELECT '{table}' AS \"table\", rule, status, failed_rows, total_rows, round(failed_rows::DOUBLE / total_rows, 6) AS failed_rate, detail FROM ({' UNION ALL '.join(parts)})"
    )


for _t in RULE_SQL:
    SQL[f"dq_rules_{_t}"] = _rule_sql(_t)


def dq_rules_damaged(spark: SparkSession, d: str) -> DataFrame:
    """The rules of tables that are damaged: a column missing, a wrong type, no rows, and without the first date of the ranked key."""
    t = V.silver(spark, d, "participants", "teams", "ranked", "summoners")
    frames = {
        "participants": t["participants"].drop("assists"), "teams": t["teams"].withColumn("win", F.col("win").cast("string")), "ranked": t["ranked"].drop("game_date"),
        "summoners": t["summoners"].where("false"),
    }
    return R.union_all([QR.evaluate(df, k, QR.rules_for(k)).where("status in ('FAIL', 'SKIP')").select("table", "rule", "status") for k, df in frames.items()])


QUERIES["dq_rules_damaged"] = dq_rules_damaged
SQL["dq_rules_damaged"] = (
    _with("participants", "teams", "ranked")
    + """, wrong AS (
    SELECT 'participants' AS "table", 'required_columns' AS rule, 'FAIL' AS status UNION ALL SELECT 'participants', 'non_negative_metrics', 'SKIP'
    UNION ALL SELECT 'teams', 'boolean_column_types', 'FAIL' UNION ALL SELECT 'ranked', 'required_columns', 'FAIL' UNION ALL SELECT 'summoners', 'table_not_empty', 'FAIL'
    UNION ALL SELECT 'participants', 'unique_business_key', 'FAIL' FROM (SELECT count(*) AS n, count(DISTINCT match_id || ' ' || participant_id) AS k FROM participants) WHERE n > k
    UNION ALL SELECT 'participants', 'required_values_not_null', 'FAIL' FROM (SELECT count(*) AS n FROM participants WHERE match_id IS NULL OR puuid IS NULL OR game_date IS NULL) WHERE n > 0
    UNION ALL SELECT 'teams', 'unique_business_key', 'FAIL' FROM (SELECT count(*) AS n, count(DISTINCT match_id || ' ' || team_id) AS k FROM teams) WHERE n > k
    UNION ALL SELECT 'ranked', 'non_negative_metrics', 'FAIL' FROM (SELECT count(*) AS n FROM ranked WHERE league_points < 0 OR wins < 0 OR losses < 0 OR win_rate < 0) WHERE n > 0
    UNION ALL SELECT 'ranked', 'rates_between_zero_and_one', 'FAIL' FROM (SELECT count(*) AS n FROM ranked WHERE win_rate NOT BETWEEN 0 AND 1) WHERE n > 0)
    SELECT * FROM wrong"""
)

QUERIES["dq_top_invalid"] = lambda spark, d: QR.top_invalid(V.silver(spark, d, "ranked")["ranked"], "tier", list(X.TIERS))
SQL["dq_top_invalid"] = _with("ranked") + f" SELECT tier AS value, count(*) AS n FROM ranked WHERE tier NOT IN {X.TIERS} GROUP BY 1 ORDER BY n DESC, value LIMIT 10"
QUERIES["dq_duplicate_keys"] = lambda spark, d: QR.duplicate_keys(V.silver(spark, d, "participants")["participants"], ["match_id", "participant_id"])
SQL["dq_duplicate_keys"] = _with("participants") + " SELECT match_id, participant_id, count(*) AS n FROM participants GROUP BY 1, 2 HAVING count(*) > 1"


def dq_fk_checks(spark: SparkSession, d: str) -> DataFrame:
    """All references; then two again, with dimensions cut to show orphans."""
    names = sorted({n for r in Q.REFERENCES for n in (r[0], r[2])})
    t = Q.narrowed(_gold_tables(spark, d, *names))
    cut = t | {"dim_champion": t["dim_champion"].where("champion_id <> 7"), "dim_rank": t["dim_rank"].where("NOT (tier = 'IRON' AND rank = 'I')")}
    again = Q.foreign_keys(cut, [r for r in Q.REFERENCES if r[2] in ("dim_champion", "dim_rank")])
    return Q.foreign_keys(t).withColumn("cut", F.lit(False)).unionAll(again.withColumn("cut", F.lit(True)))


def _fk_sql(fact: str, keys: tuple[str, ...], dim: str, dim_keys: tuple[str, ...], cut: str = "") -> str:
    name, same = f"{fact}({','.join(keys)})->{dim}", " AND ".join(f"f.{a} = d.{b}" for a, b in zip(keys, dim_keys, strict=True))
    known = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    return (
        f"SELECT '{name}' AS \"check\", {str(bool(cut)).lower()} AS cut, count(*) AS keys, count(*) FILTER (NOT EXISTS (SELECT 1 FROM {dim}_t d WHERE {same}{cut})) AS orphans "
        f"FROM (SELECT DISTINCT {', '.join(keys)} FROM {fact}_t WHERE {known}) f"
    )


_PEOPLE_FACT = "fact_participant_performance"
_FK_SQL = [
    _fk_sql(_PEOPLE_FACT, ("match_id",), "dim_match", ("match_id",)), _fk_sql(_PEOPLE_FACT, ("puuid",), "dim_summoner", ("puuid",)), _fk_sql(_PEOPLE_FACT, ("champion_id",), "dim_champion", ("champion_id",)),
    _fk_sql(_PEOPLE_FACT, ("game_date",), "dim_date", ("game_date",)), _fk_sql("fact_team_objectives", ("match_id",), "dim_match", ("match_id",)),
    _fk_sql("fact_team_objectives", ("team_id",), "dim_team", ("team_id",)), _fk_sql("fact_rank_snapshot", _RANKS, "dim_rank", _RANKS), _fk_sql("fact_rank_snapshot", ("puuid",), "dim_summoner", ("puuid",)),
    _fk_sql("fact_timeline_frames", ("match_id",), "dim_match", ("match_id",)), _fk_sql("fact_timeline_events", ("match_id",), "dim_match", ("match_id",)),
    _fk_sql(_PEOPLE_FACT, ("champion_id",), "dim_champion", ("champion_id",), " AND d.champion_id <> 7"),
    _fk_sql("fact_rank_snapshot", _RANKS, "dim_rank", _RANKS, " AND NOT (d.tier = 'IRON' AND d.rank = 'I')"),
]
_FK_TABLES = (_PEOPLE_FACT, "fact_team_objectives", "fact_rank_snapshot", "fact_timeline_frames", "fact_timeline_events", "dim_match", "dim_summoner", "dim_champion", "dim_date", "dim_team", "dim_rank")
QUERIES["dq_fk_checks"] = dq_fk_checks
SQL["dq_fk_checks"] = (
    "WITH " + ", ".join(f"{t}_t AS ({GOLD_SQL[t]})" for t in _FK_TABLES) + f" SELECT *, round(orphans::DOUBLE / keys, 6) AS orphan_rate, CASE WHEN orphans > 0 THEN 'WARN' ELSE 'PASS' END AS status FROM ({' UNION ALL '.join(_FK_SQL)})"
)


def dq_row_alignment(spark: SparkSession, d: str) -> DataFrame:
    """The match dimension against silver matches, whole and without one queue."""
    dim, silver = _gold_tables(spark, d, "dim_match")["dim_match"], V.silver(spark, d, "matches")["matches"]
    return Q.row_alignment(dim, silver).withColumn("whole", F.lit(True)).unionAll(Q.row_alignment(dim.where("queue_id <> 0"), silver).withColumn("whole", F.lit(False)))


QUERIES["dq_row_alignment"] = dq_row_alignment
SQL["dq_row_alignment"] = _with("matches") + """, n AS (SELECT count(*) AS dim_rows, count(*) AS silver_rows, true AS whole FROM matches UNION ALL SELECT count(*) FILTER (queue_id <> 0), count(*), false FROM matches)
    SELECT *, CASE WHEN abs(dim_rows - silver_rows) > 0.01 * silver_rows THEN 'WARN' ELSE 'PASS' END AS status FROM n"""
QUERIES["dq_profile"] = lambda spark, d: Q.profile(V.silver(spark, d, "ranked")["ranked"], "ranked", exact=True).withColumn("avg_value", F.round("avg_value", 6))


def _profile_sql(column: str, kind: str) -> str:
    number, text = kind in ("bigint", "double"), kind == "string"
    stats = f"CAST(min({column}) AS DOUBLE) AS min_value, CAST(max({column}) AS DOUBLE) AS max_value, round(avg({column}), 6) AS avg_value" if number else "NULL::DOUBLE AS min_value, NULL::DOUBLE AS max_value, NULL::DOUBLE AS avg_value"
    empty = f"count(*) FILTER (trim({column}) = '')" if text else "0::BIGINT"
    return f"""SELECT 'ranked' AS "table", '{column}' AS "column", '{kind}' AS type, count(*) FILTER ({column} IS NULL) AS nulls, round((count(*) FILTER ({column} IS NULL))::DOUBLE / count(*), 6) AS null_ratio,
        count(DISTINCT {column}) AS distinct_values, {empty} AS empty_strings, {stats} FROM ranked"""


SQL["dq_profile"] = _with("ranked") + " " + " UNION ALL ".join(_profile_sql(f.name, f.dataType.simpleString()) for f in S.SILVER_SCHEMAS["ranked"])


def dq_profile_approx(spark: SparkSession, d: str) -> DataFrame:
    """Approximate and exact numbers of distinct values side by side: whether each lies within a fifth of the other."""
    t = V.silver(spark, d, "participants")["participants"]
    near, exact = Q.profile(t, "participants"), Q.profile(t, "participants", exact=True).select("column", F.col("distinct_values").alias("exact"))
    return near.join(exact, "column").select("column", "nulls", "exact", (F.abs(F.col("distinct_values") - F.col("exact")) <= 0.2 * F.col("exact")).alias("near"))


QUERIES["dq_profile_approx"] = dq_profile_approx
SQL["dq_profile_approx"] = _with("participants") + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS nulls, count(DISTINCT {c}) AS exact, true AS near FROM participants" for c in S.SILVER["participants"]
)
QUERIES["dq_date_coverage"] = lambda spark, d: Q.date_coverage(Q.rows_by_date(V.silver(spark, d, "participants")["participants"]))
SQL["dq_date_coverage"] = _with("participants") + " SELECT min(game_date) AS min_date, max(game_date) AS max_date, count(DISTINCT game_date) AS dates FROM participants"
QUERIES["dq_top_dates"] = lambda spark, d: Q.top_dates(Q.rows_by_date(V.silver(spark, d, "participants")["participants"]))
SQL["dq_top_dates"] = _with("participants") + " SELECT game_date, count(*) AS n FROM participants GROUP BY 1 ORDER BY n DESC, game_date LIMIT 20"


def _checks(spark: SparkSession, d: str) -> DataFrame:
    return Q.check_tables(V.silver(spark, d, *S.SILVER), spark)


_ALL = " UNION ALL ".join(f"SELECT * FROM ({_rule_sql(t)})" for t in S.SILVER)
_STATUS = f"SELECT \"table\", CASE max(CASE status WHEN 'FAIL' THEN 2 WHEN 'WARN' THEN 1 ELSE 0 END) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'WARN' ELSE 'PASS' END AS status FROM ({_ALL}) GROUP BY 1"
QUERIES["dq_status"] = lambda spark, d: Q.table_status(_checks(spark, d))
SQL["dq_status"] = _STATUS
QUERIES["dq_summary"] = lambda spark, d: Q.summary(_checks(spark, d))
SQL["dq_summary"] = f"SELECT *, tables_expected AS tables_analysed, 0::BIGINT AS tables_missing, CASE WHEN tables_failed > 0 THEN 'FAIL' WHEN tables_warned > 0 THEN 'READY_WITH_WARNINGS' ELSE 'READY' END AS status, tables_failed = 0 AS ready, CASE WHEN tables_failed > 0 THEN 'Mend the failed checks before use.' WHEN tables_warned > 0 THEN 'Fit for use; look at the warnings.' ELSE 'Fit for use.' END AS recommendation FROM (SELECT count(*) AS tables_expected, count(*) FILTER (status = 'PASS') AS tables_passed, count(*) FILTER (status = 'WARN') AS tables_warned, count(*) FILTER (status = 'FAIL') AS tables_failed FROM ({_STATUS}))"
_DETAILS = "from_json(details, 'failed_rows bigint, total_rows bigint, failed_rate double, detail string') AS d"
QUERIES["dq_issues"] = lambda spark, d: Q.issues(_checks(spark, d)).selectExpr("*", _DETAILS).select("table", "rule", "status", "d.*")
SQL["dq_issues"] = f"SELECT \"table\", rule, status, failed_rows, total_rows, failed_rate, detail FROM ({_ALL}) WHERE status IN ('FAIL', 'WARN')"
QUERIES["dq_check_counts"] = lambda spark, d: Q.check_counts(_checks(spark, d))
SQL["dq_check_counts"] = f"SELECT status, count(*) AS n FROM ({_ALL}) GROUP BY 1"


def dq_score(spark: SparkSession, d: str) -> DataFrame:
    """The score of each run: one of all silver tables, one of two of them."""
    checks = _checks(spark, d)
    runs = checks.withColumn("run_id", F.lit("all")).unionAll(checks.where("`table` in ('matches', 'teams')").withColumn("run_id", F.lit("two")))
    return Q.score(runs, "run_id")


QUERIES["dq_score"] = dq_score
SQL["dq_score"] = f"""SELECT *, round(passed::DOUBLE / total, 4) AS score FROM (SELECT run_id, count(*) FILTER (status = 'PASS') AS passed, count(*) AS total
    FROM (SELECT *, 'all' AS run_id FROM ({_ALL}) UNION ALL SELECT *, 'two' FROM ({_ALL}) WHERE "table" IN ('matches', 'teams')) GROUP BY run_id)"""
QUERIES["dq_required_keys"] = lambda spark, d: Q.missing_keys(V.silver(spark, d, "ranked")["ranked"], "puuid", ["summoner_id", "queue", "absent"])
SQL["dq_required_keys"] = _with("ranked") + " SELECT puuid AS \"row\", 'summoner_id' AS field FROM ranked WHERE summoner_id IS NULL UNION ALL SELECT puuid, 'absent' FROM ranked"
