"""Declarative data-quality rules, compiled to one aggregation for each table.

A rule names its type, columns, parameters and severity.  Rules on the schema are decided while compiling; row rules become
counts of violating rows in a single ``agg``; key rules need a grouping of their own.  Nulls violate no value rule.  A rule
whose columns are missing is SKIP; a violated one is FAIL, or WARN where its severity is ``warning``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions import exprs as X


@dataclass(frozen=True)
class Rule:
    name: str
    kind: str
    columns: tuple[str, ...] = ()
    params: dict = field(default_factory=dict)
    severity: str = "error"


RESULT = "table string, rule string, status string, failed_rows bigint, total_rows bigint, failed_rate double, detail string"
_ANY = lambda tests: reduce(lambda a, b: a | b, tests)


def _violation(r: Rule) -> Column | None:
    """Condition of a violating row, for row rules."""
    c, p = [F.col(x) for x in r.columns], r.params
    match r.kind:
        case "not_null":
            return _ANY([x.isNull() for x in c])
        case "non_negative":
            return _ANY([x.isNotNull() & (x < 0) for x in c])
        case "greater_than" | "tolerance":
            return _ANY([x.isNotNull() & (x <= p["min"]) for x in c])
        case "between":
            return _ANY([x.isNotNull() & ((x < p["min"]) | (x > p["max"])) for x in c])
        case "non_empty":
            return _ANY([x.isNotNull() & (F.length(F.trim(x)) == 0) for x in c])
        case "date_order":
            return c[0].isNotNull() & c[1].isNotNull() & (c[0] > c[1])
        case "accepted":
            return _ANY([x.isNotNull() & ~x.isin(*p["values"]) for x in c])
        case "sum_equals":
            total = F.col(p["target"])
            return total.isNotNull() & (reduce(lambda a, b: a + b, [X.zero(x) for x in c]) != total)
    return None


def first_available(candidates: list[list[str]], present: set[str]) -> list[str]:
    """The first candidate key whose columns are all there, else the first."""
    return next((k for k in candidates if set(k) <= present), candidates[0])


def resolve(r: Rule, df: DataFrame) -> Rule:
    """The rule with candidate columns resolved against the frame; what is missing but optional goes to ``params["optional"]``."""
    present, p = set(df.columns), r.params
    if "candidates" in p:  # a key among several
        key = first_available(p["candidates"], present)
        columns = tuple(dict.fromkeys((*r.columns, *key)))
        return Rule(r.name, {"first_available_unique": "unique"}.get(r.kind, r.kind), columns, {k: v for k, v in p.items() if k != "candidates"}, r.severity)
    if r.kind in ("positive_metrics", "non_negative_metrics"):
        found = {metric: next((c for c in options if c in present), None) for metric, options in p["metrics"].items()}
        kind, extra = ("greater_than", {"min": 0}) if r.kind == "positive_metrics" else ("non_negative", {})
        extra["optional"] = [metric for metric, c in found.items() if c is None]
        return Rule(r.name, kind, tuple(c for c in found.values() if c), extra, r.severity)
    if r.kind in ("not_null_if_present", "null_profile"):
        here = tuple(c for c in r.columns if c in present)
        return Rule(r.name, "not_null" if r.kind == "not_null_if_present" else r.kind, here, p | {"optional": [c for c in r.columns if c not in present]}, r.severity)
    return r


@dataclass(frozen=True)
class Compiled:
    """Rules of one table as aggregates of its rows (``_n`` counts them), distinct keys to count apart, and a result row for each rule."""

    values: dict[str, Column]
    keys: dict[str, tuple[str, ...]]
    rows: list[Column]

    @property
    def aggregates(self) -> list[Column]:
        return [c.alias(name) for name, c in self.values.items()]


def evaluate(df: DataFrame, table: str, rules: list[Rule]) -> DataFrame:
    """One row per rule: status, violating rows, rows, rate (six places) and a detail."""
    c = compiled(df, rules)
    return results(df.agg(*c.aggregates), df, c, table)


def results(one: DataFrame, df: DataFrame, c: Compiled, table: str) -> DataFrame:
    """The rows of :func:`evaluate`, given the row ``one`` of the aggregates, however it was got; ``df`` is read for the keys alone."""
    for name, key in c.keys.items():
        # Rows beyond the first of each key, null keys counting as a value.
        beyond = df.groupBy(*key).agg(F.count(F.lit(1)).alias("k")).agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias(name))
        one = one.crossJoin(beyond)  # one row with one row
    return one.select(F.explode(F.array(*c.rows)).alias("x")).select(F.lit(table).alias("table"), "x.*")


def compiled(df: DataFrame, rules: list[Rule]) -> Compiled:
    """The rules with what they lack in ``df`` told; nothing is read."""
    present, kinds = set(df.columns), {f.name: f.dataType for f in df.schema}
    aggs: dict[str, Column] = {"_n": F.count(F.lit(1))}
    keyed: dict[str, tuple[str, ...]] = {}
    rows: list[Column] = []
    n = F.col("_n")

    def result(rule: Rule, failed: Column | None, bad: Column | None = None, detail: Column | None = None) -> Column:
        """``failed`` is None for rules that do not count rows."""
        bad = failed > 0 if bad is None else bad
        status = F.when(bad, "WARN" if rule.severity == "warning" else "FAIL").otherwise("PASS")
        if detail is None:
            detail = F.lit(json.dumps({"missing_optional": rule.params["optional"]}) if rule.params.get("optional") else None).cast("string")
        rate = F.coalesce(F.round(F.try_divide(failed, n), 6), F.lit(0.0)) if failed is not None else F.lit(None).cast("double")
        return row(rule, status, (F.lit(None) if failed is None else failed).cast("long"), rate, detail)

    def skip(rule: Rule, missing: list[str]) -> Column:
        nothing = F.lit(None).cast("long")
        return row(rule, F.lit("SKIP"), nothing, nothing.cast("double"), F.lit(json.dumps({"missing_columns": missing})))

    def row(rule: Rule, status: Column, failed: Column, rate: Column, detail: Column) -> Column:
        return F.struct(
            F.lit(rule.name).alias("rule"), status.alias("status"), failed.alias("failed_rows"), n.alias("total_rows"), rate.alias("failed_rate"), detail.alias("detail")
        )

    for i, given in enumerate(rules):
        r = resolve(given, df)
        missing = [c for c in (*r.columns, *([r.params["target"]] if "target" in r.params else [])) if c not in present]
        if r.kind == "required_columns":
            rows.append(result(r, None, F.lit(bool(missing)), F.lit(json.dumps({"missing_columns": missing}))))
        elif r.kind == "column_count_min":
            rows.append(result(r, None, F.lit(len(df.columns) < r.params["min"])))
        elif r.kind == "row_count_min":
            rows.append(result(r, None, n < r.params["min"]))
        elif r.kind == "row_count":
            p = r.params
            rows.append(result(r, None, (n != p["equals"]) if "equals" in p else ~n.between(p["min"], p["max"])))
        elif r.kind in ("boolean", "boolean_if_present"):
            wrong = [c for c in r.columns if c in kinds and not isinstance(kinds[c], T.BooleanType)]
            counted = F.lit(0) if r.kind == "boolean_if_present" and not set(r.columns) & present else None
            rows.append(skip(r, missing) if r.kind == "boolean" and missing else result(r, counted, F.lit(bool(wrong))))
        elif missing or not r.columns:
            rows.append(skip(r, missing or list(given.columns)))
        elif r.kind == "unique":
            keyed[f"_v{i}"] = r.columns
            rows.append(result(r, F.col(f"_v{i}")))
        elif r.kind == "null_profile":
            aggs |= {f"_v{i}_{j}": F.count_if(F.col(c).isNull()) for j, c in enumerate(r.columns)}
            rows.append(result(r, F.lit(0), detail=F.to_json(F.struct(*[F.col(f"_v{i}_{j}").alias(c) for j, c in enumerate(r.columns)]))))
        else:
            aggs[f"_v{i}"] = F.count_if(_violation(r))
            failed = F.col(f"_v{i}")
            bad = F.try_divide(failed, n) > r.params["max_rate"] if r.kind == "tolerance" else failed > 0
            rows.append(result(r, failed, F.coalesce(bad, F.lit(False))))
    return Compiled(aggs, keyed, rows)


def top_invalid(df: DataFrame, column: str, values: list, limit: int = 10) -> DataFrame:
    """The most frequent values outside ``values``; ties by value."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*values)).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(limit)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def _rule(kind: str, name: str, *columns: str, severity: str = "error", **params: object) -> Rule:
    return Rule(name, kind, columns, params, severity)


def _table(table: str, required: list[str], key: list[str], signed: list[str], *more: Rule) -> list[Rule]:
    """The rules that all tables have, and the table's own."""
    columns = (S.SILVER | S.GOLD)[table]
    flags = S.columns_of(table, T.BooleanType)
    out = [
        _rule("required_columns", "required_columns", *columns),
        _rule("column_count_min", "column_count_positive", min=1),
        _rule("row_count_min", "table_not_empty", min=1),
        *([_rule("not_null", "required_values_not_null", *required)] if required else []),
        *([_rule("unique", "unique_business_key", *key)] if key else []),
        *([_rule("non_negative", "non_negative_metrics", *signed)] if signed else []),
        *more,
    ]
    return [*out, _rule("boolean", "boolean_column_types", *flags)] if flags else out


def _gold(table: str, required: list[str], *more: Rule) -> list[Rule]:
    """A gold table: all its numbers are non-negative."""
    return _table(table, required, S.GOLD_KEYS[table], S.columns_of(table, T.LongType, T.DoubleType), *more)


def _rates(column: str = "win_rate") -> Rule:
    return _rule("between", "rates_between_zero_and_one", column, min=0.0, max=1.0)


def _positive(*columns: str) -> Rule:
    return _rule("greater_than", "positive_metrics", *columns, min=0)


def _games(target: str) -> Rule:
    return _rule("sum_equals", "wins_losses_match_games", "wins", "losses", target=target)


# Names of checks, columns, bounds and accepted values of the catalogue.
_TEAM_IDS = _rule("accepted", "team_id_known_values", "team_id", severity="warning", values=[100, 200])
_EVENT_TEAM_IDS = _rule("accepted", "team_id_known_values", "team_id", severity="warning", values=[0, 100, 200])
_ROLE_NAMES = _rule("accepted", "role_known_values", "team_position", severity="warning", values=["TOP", "JUNGLE", "MIDDLE", "BOTTOM", "UTILITY", "UNKNOWN"])
_TIER_NAMES = _rule("accepted", "tier_known_values", "tier", severity="warning", values=list(X.TIERS))
_RANKED_KEYS = [["queue", "tier", "rank", "puuid", "game_date"], ["queue", "tier", "rank", "puuid", "ingest_date"]]
_KILLS = ["baron_kills", "dragon_kills", "rift_herald_kills", "tower_kills", "inhibitor_kills", "champion_kills"]

CATALOGUE: dict[str, list[Rule]] = {
    "matches": _table(
        "matches", ["match_id", "dataset", "game_date"], ["match_id"],
        ["game_id", "queue_id", "game_creation", "game_start_timestamp", "game_end_timestamp", "game_duration", "participant_count"],
    ),
    "participants": _table(
        "participants", ["match_id", "participant_id", "puuid", "champion_id", "team_id", "dataset", "game_date"], ["match_id", "participant_id"],
        ["participant_id", "champion_id", "team_id", "kills", "deaths", "assists", "kda", "gold_earned", "total_damage_dealt_to_champions",
         "total_damage_taken", "vision_score", "total_minions_killed", "neutral_minions_killed"], _TEAM_IDS,
    ),
    "teams": _table("teams", ["match_id", "team_id", "dataset", "game_date"], ["match_id", "team_id"], ["team_id", *_KILLS], _TEAM_IDS),
    "summoners": _table("summoners", ["puuid", "dataset", "game_date"], ["puuid"], ["profile_icon_id", "revision_date", "summoner_level"]),
    "ranked": _table(
        "ranked", [], [], ["league_points", "wins", "losses", "win_rate"],
        _rule("not_null", "required_values_not_null", "queue", "tier", "rank", "puuid", "dataset", candidates=_RANKED_KEYS),
        _rule("first_available_unique", "unique_business_key", candidates=_RANKED_KEYS), _rates(),
    ),
    "timeline_frames": _table(
        "timeline_frames", ["match_id", "frame_index", "dataset", "game_date"], ["match_id", "frame_index"],
        ["frame_index", "frame_timestamp", "participant_frame_count", "event_count"],
    ),
    "timeline_events": _table(
        "timeline_events", ["match_id", "frame_index", "event_index", "event_type", "dataset", "game_date"], ["match_id", "frame_index", "event_index"],
        ["frame_index", "event_index", "event_timestamp", "participant_id", "killer_id", "victim_id", "team_id"],
    ),
    "dim_date": _gold(
        "dim_date", ["date_key", "game_date", "date_year", "date_month", "date_day"],
        _rule("between", "date_month_between", "date_month", min=1.0, max=12.0), _rule("between", "date_day_between", "date_day", min=1.0, max=31.0),
        _rule("boolean_if_present", "optional_boolean_column_types", "is_weekend"),
    ),
    "dim_match": _gold(
        "dim_match", ["match_id", "game_date"], _rule("not_null_if_present", "optional_values_not_null", "queue_id", "game_date"),
        _rule("tolerance", "game_duration_positive_tolerance", "game_duration", min=0.0, max_rate=0.001),
        _rule("tolerance", "participant_count_positive_tolerance", "participant_count", min=0.0, max_rate=0.001),
    ),
    "dim_summoner": _gold(
        "dim_summoner", ["puuid"], _rule("date_order", "valid_date_order", "first_seen_game_date", "last_seen_game_date"),
        _rule("null_profile", "nullable_identifier_null_rates", "summoner_id", "riot_id_game_name", "riot_id_tagline", "summoner_name"),
    ),
    "dim_champion": _gold(
        "dim_champion", ["champion_id", "champion_name"], _rule("row_count", "row_count_expectation", severity="warning", min=100, max=250),
        _rule("non_empty", "non_empty_strings", "champion_name"),
    ),
    "dim_team": _gold("dim_team", ["team_id", "team_side"], _rule("row_count", "row_count_expectation", severity="warning", equals=2), _TEAM_IDS),
    "dim_rank": _gold("dim_rank", ["queue", "tier", "rank"], _TIER_NAMES),
    "fact_participant_performance": _gold("fact_participant_performance", ["game_date", "match_id", "participant_id", "puuid", "champion_id"], _TEAM_IDS, _ROLE_NAMES),
    "fact_team_objectives": _gold("fact_team_objectives", ["game_date", "match_id", "team_id"], _TEAM_IDS),
    "fact_rank_snapshot": _gold("fact_rank_snapshot", ["game_date", "queue", "tier", "rank", "puuid"], _rates(), _TIER_NAMES),
    "fact_timeline_frames": _gold("fact_timeline_frames", ["game_date", "match_id", "frame_index"]),
    "fact_timeline_events": _gold("fact_timeline_events", ["game_date", "match_id", "frame_index", "event_index", "event_type"], _EVENT_TEAM_IDS),
    "mart_player_daily_performance": _gold(
        "mart_player_daily_performance", ["game_date", "puuid", "matches_played", "wins", "losses", "win_rate"],
        _positive("matches_played", "unique_champions"), _rates(), _games("matches_played"),
    ),
    "mart_champion_daily_performance": _gold(
        "mart_champion_daily_performance", ["game_date", "champion_id", "champion_name", "matches_played", "wins", "losses", "win_rate"],
        _positive("matches_played"), _rates(), _games("matches_played"),
    ),
    "mart_role_daily_performance": _gold(
        "mart_role_daily_performance", ["game_date", "team_position", "matches_played", "wins", "losses", "win_rate"],
        _positive("matches_played"), _rates(), _games("matches_played"), _ROLE_NAMES,
    ),
    "mart_rank_daily_summary": _gold(
        "mart_rank_daily_summary", ["game_date", "queue", "tier", "rank", "players", "avg_win_rate"], _positive("players"), _rates("avg_win_rate"), _TIER_NAMES
    ),
    "mart_team_objective_daily_summary": _gold(
        "mart_team_objective_daily_summary", ["game_date", "team_id", "games_played", "wins", "losses", "win_rate", *(f"avg_{c}" for c in _KILLS)],
        _positive("games_played"), _rates(), _games("games_played"), _TEAM_IDS,
        _rule("positive_metrics", "team_count_positive", metrics={"team_count": ["team_count", "games_played"]}),
        _rule(
            "non_negative_metrics", "team_objective_summary_non_negative",
            metrics={"win_count": ["win_count", "wins"]} | {f"avg_{c}": [f"avg_{c}"] for c in (*_KILLS, "objective_score")},
        ),
    ),
}


def rules_for(table: str) -> list[Rule]:
    """The rule catalogue of a silver or gold table."""
    return CATALOGUE[table]
