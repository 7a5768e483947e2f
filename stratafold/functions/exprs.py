"""Column functions.  Null rules are stated where they differ from Spark's own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ROLES = ("TOP", "JUNGLE", "MIDDLE", "BOTTOM", "UTILITY")
TIERS = ("IRON", "BRONZE", "SILVER", "GOLD", "PLATINUM", "EMERALD", "DIAMOND", "MASTER", "GRANDMASTER", "CHALLENGER")
DIVISIONS = ("IV", "III", "II", "I")
OBJECTIVES = ("baron_kills", "dragon_kills", "rift_herald_kills", "tower_kills", "inhibitor_kills", "champion_kills")
SIDES = {100: "BLUE", 200: "RED"}
#: Milliseconds of 9999-12-31T23:59:59.999Z, the last day with a four-digit year.
LAST_MS = 253_402_300_799_999


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def zero(c: str | Column) -> Column:
    return F.coalesce(_col(c), F.lit(0))


def true_count(c: str | Column) -> Column:
    return F.count_if(F.coalesce(_col(c), F.lit(False)))


def long_sum(c: str | Column) -> Column:
    """Sum with nulls as 0."""
    return F.sum(zero(c)).cast("long")


def creep_score(minions: str = "total_minions_killed", neutral: str = "neutral_minions_killed") -> Column:
    return zero(minions) + zero(neutral)


def objective_score(columns: tuple[str, ...] = OBJECTIVES) -> Column:
    return reduce(lambda a, b: a + b, [zero(c) for c in columns])


def team_side(team: str | Column = "team_id", sides: dict[int, str] = SIDES) -> Column:
    out = F
    for k, v in sides.items():
        out = out.when(_col(team) == k, v)
    return out.otherwise("UNKNOWN")


def role_bucket(c: str | Column, roles: tuple[str, ...] = ROLES) -> Column:
    """The role in upper case without blanks, null unless it is one of ``roles``."""
    role = F.upper(F.trim(_col(c)))
    return F.when(role.isin(*roles), role)


def normalized_role(columns: tuple[str, ...] = ("team_position", "individual_position", "lane", "role"), roles: tuple[str, ...] = ROLES) -> Column:
    return F.coalesce(*[role_bucket(c, roles) for c in columns], F.lit("UNKNOWN"))


def rank_order(tier: str = "tier", rank: str = "rank", tiers: tuple[str, ...] = TIERS, divisions: tuple[str, ...] = DIVISIONS) -> Column:
    """Tier number times ten plus division number, counted from 1; unknown names count 0."""
    number = lambda c, names: F.coalesce(F.create_map(*[F.lit(x) for i, n in enumerate(names, 1) for x in (n, i)])[F.upper(_col(c))], F.lit(0))
    return (number(tier, tiers) * 10 + number(rank, divisions)).cast("long")


def safe_divide(a: str | Column, b: str | Column) -> Column:
    """Null where either is null or the divisor is 0."""
    return F.try_divide(_col(a).cast("double"), _col(b).cast("double"))


def kda(kills: str | Column = "kills", deaths: str | Column = "deaths", assists: str | Column = "assists") -> Column:
    """(kills + assists) / deaths; without deaths kills + assists; null where one is no number."""
    k, d, a = (_col(c).try_cast("double") for c in (kills, deaths, assists))
    return F.when(d == 0, k + a).otherwise(F.try_divide(k + a, d))


def win_rate(wins: str | Column, losses: str | Column) -> Column:
    w, n = _col(wins).try_cast("double"), _col(losses).try_cast("double")
    return F.try_divide(w, w + n)


def standard_team(c: str | Column, teams: tuple[int, ...] = (100, 200)) -> Column:
    """The team as a long if it is one of ``teams``, else null; text and numbers with a fraction are read as whole numbers."""
    text = F.trim(_col(c).cast("string"))
    number = F.coalesce(text.try_cast("long"), text.try_cast("double").try_cast("long"))
    return F.when(number.isin(*teams), number)


def game_date(ms: str | Column) -> Column:
    """UTC day of epoch milliseconds as text; null where not positive, unreadable or beyond year 9999."""
    t = _col(ms).try_cast("long")
    return F.when((t > 0) & (t <= LAST_MS), F.date_format(F.timestamp_millis(F.when(t.between(1, LAST_MS), t)), "yyyy-MM-dd"))


def date_parts(c: str = "game_date") -> dict[str, Column]:
    """Key yyyyMMdd, year, month, day, day of week (1 = Sunday); unreadable dates have null parts."""
    d = F.try_to_date(F.col(c), "yyyy-MM-dd")
    return {"date_key": F.regexp_replace(c, "-", ""), "date_year": F.year(d).cast("long"), "date_month": F.month(d).cast("long"), "date_day": F.dayofmonth(d).cast("long"), "day_of_week": F.dayofweek(d).cast("long")}


def distinct_players(first: str = "summoner_id", second: str = "puuid") -> Column:
    return F.count_distinct(F.coalesce(first, second))


def detect_dataset(path: str | Column, payload: str | Column | None = None, known: tuple[str, ...] = ("matches", "timelines", "summoners", "ranked")) -> Column:
    """Dataset by the parent folder if it is known, else by the payload's keys, else ``unknown``."""
    folder = F.lower(F.regexp_extract(_col(path), r"/([^/]+)/[^/]+$", 1))
    out = F.when(folder.isin(*known), folder)
    if payload is None:
        return out.otherwise("unknown")
    top = F.from_json(_col(payload), "map<string,string>")
    has = lambda m, k: F.coalesce(F.map_contains_key(m, k), F.lit(False))
    info = F.from_json(top["info"], "map<string,string>")
    out = out.when(has(top, "metadata") & has(top, "info"), F.when(has(info, "frames"), "timelines").otherwise("matches"))
    return out.when(has(top, "entries") & has(top, "tier"), "ranked").when(has(top, "puuid") & has(top, "summonerLevel"), "summoners").otherwise("unknown")


def non_negative(c: str | Column) -> Column:
    """Null passes."""
    return _col(c).isNull() | (_col(c) >= 0)


def quality_score(passed: str | Column, total: str | Column) -> Column:
    """Share of passed checks to four places, 1.0 without checks."""
    return F.coalesce(F.round(safe_divide(passed, total), 4), F.lit(1.0))
