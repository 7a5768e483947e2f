"""Nested JSON payloads to the seven silver tables, with Spark's JSON functions.

A payload counts only if it is a JSON object.  It is parsed once; where the parser reports a bad record, a map parse tells an object with a
field of a wrong type from malformed text, arrays and scalars.
A field of the wrong type becomes null.  Null array elements give rows of nulls, null or missing arrays no rows.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators.relational import conform, dedup_latest
from . import exprs as X

_BAD = "bad_record"
_KILLS = "struct<kills:bigint>"
PAYLOADS = {
    "matches": "metadata struct<matchId:string>, info struct<gameId:bigint,platformId:string,queueId:bigint,gameMode:string,gameType:string,gameVersion:string,gameCreation:bigint,gameStartTimestamp:bigint,gameEndTimestamp:bigint,gameDuration:bigint,"
    "participants:array<struct<participantId:bigint,puuid:string,summonerId:string,riotIdGameName:string,riotIdTagline:string,summonerName:string,championId:bigint,championName:string,teamId:string,teamPosition:string,individualPosition:string,lane:string,role:string,win:boolean,kills:bigint,deaths:bigint,assists:bigint,goldEarned:bigint,totalDamageDealtToChampions:bigint,totalDamageTaken:bigint,visionScore:bigint,totalMinionsKilled:bigint,neutralMinionsKilled:bigint>>,"
    f"teams:array<struct<teamId:string,win:boolean,objectives:struct<baron:{_KILLS},dragon:{_KILLS},riftHerald:{_KILLS},tower:{_KILLS},inhibitor:{_KILLS},champion:{_KILLS}>>>>",
    "timelines": "metadata struct<matchId:string>, info struct<gameCreation:bigint,gameStartTimestamp:bigint,frames:array<struct<timestamp:bigint,participantFrames:map<string,string>,events:array<struct<timestamp:bigint,type:string,participantId:bigint,killerId:bigint,victimId:bigint,teamId:bigint,monsterType:string,buildingType:string,laneType:string>>>>>",
    "summoners": "puuid string, id string, accountId string, profileIconId bigint, revisionDate bigint, summonerLevel bigint",
    "ranked": "leagueId string, queue string, tier string, entries array<struct<summonerId:string,puuid:string,rank:string,leaguePoints:bigint,wins:bigint,losses:bigint,hotStreak:boolean,veteran:boolean,freshBlood:boolean,inactive:boolean>>",
}
ROUTES = {"matches": ("matches", "participants", "teams"), "timelines": ("timeline_frames", "timeline_events"), "summoners": ("summoners",), "ranked": ("ranked",)}
_SNAKE = {
    "participants": dict(participant_id="participantId", puuid="puuid", summoner_id="summonerId", riot_id_game_name="riotIdGameName", riot_id_tagline="riotIdTagline", summoner_name="summonerName", champion_id="championId", champion_name="championName", team_position="teamPosition", individual_position="individualPosition", lane="lane", role="role", win="win", kills="kills", deaths="deaths", assists="assists", gold_earned="goldEarned", total_damage_dealt_to_champions="totalDamageDealtToChampions", total_damage_taken="totalDamageTaken", vision_score="visionScore", total_minions_killed="totalMinionsKilled", neutral_minions_killed="neutralMinionsKilled"),
    "matches": dict(game_id="gameId", platform_id="platformId", queue_id="queueId", game_mode="gameMode", game_type="gameType", game_version="gameVersion", game_creation="gameCreation", game_start_timestamp="gameStartTimestamp", game_end_timestamp="gameEndTimestamp", game_duration="gameDuration"),
    "events": dict(event_timestamp="timestamp", event_type="type", participant_id="participantId", killer_id="killerId", victim_id="victimId", team_id="teamId", monster_type="monsterType", building_type="buildingType", lane_type="laneType"),
    "ranked": dict(rank="rank", summoner_id="summonerId", puuid="puuid", league_points="leaguePoints", wins="wins", losses="losses", hot_streak="hotStreak", veteran="veteran", fresh_blood="freshBlood", inactive="inactive"),
    "summoners": dict(puuid="puuid", summoner_id="id", account_id="accountId", profile_icon_id="profileIconId", revision_date="revisionDate", summoner_level="summonerLevel"),
}


def parse(bronze: DataFrame, dataset: str) -> DataFrame:
    """Lineage, ``game_date`` and the parsed payload ``p`` of the dataset's objects."""
    whole = F.from_json("payload_json", f"{PAYLOADS[dataset]}, {_BAD} string", {"columnNameOfCorruptRecord": _BAD})
    # A generator, so that neither filter nor projection parses the text again.
    good = F.filter(F.array(whole), lambda p: p.isNotNull() & (p[_BAD].isNull() | F.from_json(p[_BAD], "map<string,string>").isNotNull()))
    rows = bronze.where(F.col("dataset") == dataset).select(*S.BRONZE[:-1], F.explode(good).alias("p"))
    date = F.col("ingest_date")
    if dataset in ("matches", "timelines"):
        date = F.coalesce(X.game_date("p.info.gameCreation"), X.game_date("p.info.gameStartTimestamp"), date)
    return rows.withColumn("game_date", date)


def _pick(names: dict[str, str], at: str) -> list[Column]:
    return [F.col(f"{at}.{v}").alias(k) for k, v in names.items()]


def flatten(parsed: DataFrame, table: str, deal: bool = False) -> DataFrame:
    """One silver table of the parsed payloads of its dataset, with lineage.

    With ``deal`` the participants or teams of a payload are dealt by match before they become rows, so its lineage travels once."""
    keep = [c for c in S.LINEAGE if c in parsed.columns]
    match = F.col("p.metadata.matchId").alias("match_id")
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")

    def members(path: str) -> DataFrame:
        whole = parsed.select(*keep, match, F.col(path).alias("xs"))
        return (whole.repartition("match_id") if deal else whole).select(*keep, "match_id", F.explode("xs").alias("x"))

    if table == "matches":
        out = parsed.select(*keep, match, *_pick(_SNAKE["matches"], "p.info"), count(F.col("p.info.participants")).alias("participant_count"))
    elif table == "participants":
        rows = members("p.info.participants")
        team = F.col("x.teamId").try_cast("long").alias("team_id")
        out = rows.select(*keep, "match_id", *_pick(_SNAKE["participants"], "x"), team).withColumn("kda", X.kda())
    elif table == "teams":
        rows = members("p.info.teams")
        kills = [F.col(f"x.objectives.{k}.kills").alias(c) for k, c in (("baron", "baron_kills"), ("dragon", "dragon_kills"), ("riftHerald", "rift_herald_kills"), ("tower", "tower_kills"), ("inhibitor", "inhibitor_kills"), ("champion", "champion_kills"))]
        out = rows.select(*keep, "match_id", X.standard_team("x.teamId").alias("team_id"), F.col("x.win").alias("win"), *kills).where("team_id is not null")
    elif table == "summoners":
        out = parsed.select(*keep, *_pick(_SNAKE["summoners"], "p"))
    elif table == "ranked":
        rows = parsed.select(*keep, F.col("p.leagueId").alias("league_id"), F.col("p.queue").alias("queue"), F.col("p.tier").alias("tier"), F.explode("p.entries").alias("x"))
        out = rows.select(*keep, "league_id", "queue", "tier", *_pick(_SNAKE["ranked"], "x")).withColumn("win_rate", X.win_rate("wins", "losses"))
    else:
        frames = parsed.select(*keep, match, F.posexplode("p.info.frames").alias("frame", "x")).withColumn("frame_index", F.col("frame").cast("long"))
        if table == "timeline_frames":
            size = F.coalesce(F.size(F.map_keys("x.participantFrames")), F.lit(0)).cast("long")
            out = frames.select(*keep, "match_id", "frame_index", F.col("x.timestamp").alias("frame_timestamp"), size.alias("participant_frame_count"), count(F.col("x.events")).alias("event_count"))
        else:
            events = frames.select(*keep, "match_id", "frame_index", F.posexplode("x.events").alias("event", "e"))
            out = events.select(*keep, "match_id", "frame_index", F.col("event").cast("long").alias("event_index"), *_pick(_SNAKE["events"], "e"))
    return conform(out, S.SILVER_SCHEMAS[table])


def build_silver(bronze: DataFrame, tables: list[str] | None = None, keys: dict[str, list[str]] | None = None, keep: list[DataFrame] | None = None, level: str = "DISK_ONLY") -> dict[str, DataFrame]:
    """The requested silver tables, once for each key (``keys`` overrides the tables' own).

    With ``keep`` (a list) the parsed payloads of a dataset that several of the tables need are persisted at the storage level named ``level``, so each
    is parsed once; they are added to the list, for the caller to unpersist after use."""
    if keep is not None and not isinstance(getattr(StorageLevel, level, None), StorageLevel):
        raise ValueError(f"unknown storage level: {level}")
    out = {}
    for dataset, made in ROUTES.items():
        wanted = [t for t in made if tables is None or t in tables]
        if wanted:
            parsed = parse(bronze, dataset)
            if keep is not None and len(wanted) > 1:
                keep.append(parsed := parsed.persist(getattr(StorageLevel, level)))
            for t in wanted:
                key = (keys or S.SILVER_KEYS)[t]
                # A match has few rows: all are dealt by it, those of arrays before they are rows.
                deal = ["match_id"] if "match_id" in key else None
                early = bool(deal) and t in ("participants", "teams")
                out[t] = dedup_latest(flatten(parsed, t, early), key, deal=None if early else deal)
    return out
