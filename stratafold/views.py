"""Domain-shaped frames from the order, supplier, customer and event tables, as SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LINEAGE = "concat('raw/', {d}, '/', {k}, '.json') AS source_file, {h} AS file_hash, concat({t}, 'T00:00:00Z') AS ingest_ts, {t} AS ingest_date, {d} AS dataset, {t} AS game_date"


def _lineage(dataset: str, key: str, digest: str, date: str) -> str:
    return _LINEAGE.format(d=f"'{dataset}'", k=key, h=digest, t=date)


_S = lambda x: f"CAST({x} AS STRING)"
_DAY = lambda x: f"CAST(CAST({x} AS DATE) AS STRING)"
# A timeline is one day of a user, its frames the hours with events: no group or payload grows with the days a user has.
_USER_DAY = f"concat({_S('user_id')}, '_', {_DAY('ts')})"
_INT = lambda x: f"CAST(floor({x}) AS BIGINT)"
_ROLE = "CASE {x} % 7 WHEN 0 THEN ' middle ' WHEN 1 THEN 'TOP' WHEN 2 THEN 'Invalid' WHEN 3 THEN '' WHEN 4 THEN NULL WHEN 5 THEN 'bottom' ELSE 'NONE' END"
_KILLS = ", ".join(f"CAST((o_orderkey + t) % {m} AS BIGINT) AS {c}" for c, m in (("baron_kills", 3), ("dragon_kills", 5), ("rift_herald_kills", 2), ("tower_kills", 11), ("inhibitor_kills", 4), ("champion_kills", 31)))
_LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate")
_LINE_HASH = f"concat({_S('l_partkey')}, '-', {_S('l_suppkey')}, '-', {_S(_INT('l_extendedprice * 100 + 0.5'))})"
_KDA_K, _KDA_D, _KDA_A = _INT("l_quantity"), _INT("l_discount * 100 + 0.5"), _INT("l_tax * 100 + 0.5")

SQL = {
    "matches": f"""SELECT concat('M_', {_S('o_orderkey')}) AS match_id, CAST(o_orderkey AS BIGINT) AS game_id, concat('R', {_S('o_custkey % 9')}) AS platform_id, CAST(o_custkey % 6 AS BIGINT) AS queue_id, o_orderpriority AS game_mode, o_orderstatus AS game_type,
        '1.0' AS game_version, CAST(o_orderkey % 1000 AS BIGINT) + 1000 AS game_creation, CAST(o_orderkey % 1000 AS BIGINT) + 2000 AS game_start_timestamp, CAST(o_orderkey % 1000 AS BIGINT) + 3000 AS game_end_timestamp, {_INT('o_totalprice / 100')} AS game_duration,
        CAST(10 AS BIGINT) AS participant_count, {_lineage('matches', _S('o_orderkey'), _S('o_custkey'), _DAY('o_orderdate'))} FROM orders""",
    "participants": f"""SELECT concat('M_', {_S('l_orderkey')}) AS match_id, CAST(l_linenumber AS BIGINT) AS participant_id, concat('p', {_S('l_suppkey')}) AS puuid, concat('s', {_S('l_suppkey % 50')}) AS summoner_id, concat('n', {_S('l_suppkey')}) AS riot_id_game_name,
        concat('t', {_S('l_suppkey % 7')}) AS riot_id_tagline, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE concat('S', {_S('l_suppkey')}) END AS summoner_name, CAST(l_partkey % 150 AS BIGINT) AS champion_id, concat('champ', {_S('l_partkey % 150')}) AS champion_name,
        CAST(CASE WHEN l_linenumber % 2 = 1 THEN 100 ELSE 200 END AS BIGINT) AS team_id, {_ROLE.format(x='l_partkey')} AS team_position, {_ROLE.format(x='(l_partkey + l_suppkey)')} AS individual_position, CASE WHEN l_partkey % 3 = 0 THEN 'JUNGLE' ELSE 'NONE' END AS lane, CASE WHEN l_partkey % 4 = 0 THEN 'Utility' ELSE 'SOLO' END AS role,
        l_returnflag = 'R' AS win, {_KDA_K} AS kills, {_KDA_D} AS deaths, {_KDA_A} AS assists, CASE WHEN {_KDA_D} = 0 THEN CAST({_KDA_K} + {_KDA_A} AS DOUBLE) ELSE CAST({_KDA_K} + {_KDA_A} AS DOUBLE) / {_KDA_D} END AS kda, {_INT('l_extendedprice')} AS gold_earned,
        {_INT('l_extendedprice / 3')} AS total_damage_dealt_to_champions, {_INT('l_extendedprice / 5')} AS total_damage_taken, CAST(l_partkey % 40 AS BIGINT) AS vision_score, CASE WHEN l_suppkey % 6 = 0 THEN NULL ELSE CAST(l_partkey % 200 AS BIGINT) END AS total_minions_killed, CAST(l_suppkey % 30 AS BIGINT) AS neutral_minions_killed,
        {_lineage('matches', _S('l_orderkey'), _LINE_HASH, _DAY('l_shipdate'))} FROM lineitem""",
    "teams": f"""SELECT concat('M_', {_S('o_orderkey')}) AS match_id, CAST(t AS BIGINT) AS team_id, (o_orderkey + t / 100) % 2 = 0 AS win, {_KILLS}, {_lineage('matches', _S('o_orderkey'), _S('o_custkey'), _DAY('o_orderdate'))}
        FROM (SELECT *, 100 AS t FROM orders UNION ALL SELECT *, 200 FROM orders UNION ALL SELECT *, 100 FROM orders WHERE o_orderkey % 7 = 0) AS x""",
    "summoners": f"""SELECT concat('p', {_S('s_suppkey')}) AS puuid, concat('s', {_S('s_suppkey % 50')}) AS summoner_id, concat('a', {_S('s_suppkey')}) AS account_id, CAST(s_nationkey AS BIGINT) AS profile_icon_id, {_INT('s_acctbal')} AS revision_date, CAST(s_suppkey % 500 AS BIGINT) AS summoner_level,
        {_lineage('summoners', _S('s_suppkey'), _S('s_nationkey'), "'2001-01-01'")} FROM supplier""",
    "ranked": f"""SELECT concat('L', {_S('c_nationkey')}) AS league_id, concat('Q', {_S('c_nationkey % 3')}) AS queue, CASE c_mktsegment WHEN 'BUILDING' THEN 'GOLD' WHEN 'MACHINERY' THEN 'silver' WHEN 'AUTOMOBILE' THEN 'IRON' WHEN 'FURNITURE' THEN 'WOOD' ELSE 'DIAMOND' END AS tier,
        CASE c_custkey % 4 WHEN 0 THEN 'I' WHEN 1 THEN 'II' WHEN 2 THEN 'III' ELSE 'IV' END AS rank, CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE concat('s', {_S('c_custkey % 300')}) END AS summoner_id, concat('p', {_S('c_custkey')}) AS puuid, CAST(c_custkey % 100 AS BIGINT) AS league_points,
        {_INT('c_acctbal / 100')} AS wins, CAST(c_custkey % 50 AS BIGINT) AS losses, CASE WHEN {_INT('c_acctbal / 100')} + c_custkey % 50 = 0 THEN NULL ELSE CAST({_INT('c_acctbal / 100')} AS DOUBLE) / ({_INT('c_acctbal / 100')} + c_custkey % 50) END AS win_rate,
        c_custkey % 2 = 0 AS hot_streak, c_custkey % 3 = 0 AS veteran, c_custkey % 5 = 0 AS fresh_blood, c_custkey % 7 = 0 AS inactive, {_lineage('ranked', _S('c_custkey'), _S('c_nationkey'), "concat('2001-02-0', " + _S('1 + c_custkey % 3') + ")")} FROM customer""",
    "timeline_events": f"""SELECT concat('U_', {_USER_DAY}) AS match_id, frame_index, CAST(row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE), frame_index ORDER BY ts, event_id) - 1 AS BIGINT) AS event_index, CAST(event_id AS BIGINT) AS event_timestamp, event_type, CAST(event_id % 10 AS BIGINT) AS participant_id, CAST(event_id % 11 AS BIGINT) AS killer_id, CAST(event_id % 12 AS BIGINT) AS victim_id,
        CAST(100 * (event_id % 3) AS BIGINT) AS team_id, CASE WHEN event_id % 4 = 0 THEN 'DRAGON' END AS monster_type, CASE WHEN event_id % 5 = 0 THEN 'TOWER' END AS building_type, CASE WHEN event_id % 6 = 0 THEN 'MID' END AS lane_type,
        {_lineage('timelines', _USER_DAY, _S('event_id'), _DAY('ts'))} FROM (SELECT *, CAST(dense_rank() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY hour(ts)) - 1 AS BIGINT) AS frame_index FROM events) AS e""",
}
SQL["timeline_frames"] = f"""SELECT match_id, frame_index, min(event_timestamp) AS frame_timestamp, CAST(count(DISTINCT participant_id) AS BIGINT) AS participant_frame_count, CAST(count(*) AS BIGINT) AS event_count, min(source_file) AS source_file, min(file_hash) AS file_hash, min(ingest_ts) AS ingest_ts, min(ingest_date) AS ingest_date, min(dataset) AS dataset, min(game_date) AS game_date
    FROM ({SQL['timeline_events']}) AS ev GROUP BY match_id, frame_index"""
BASE = {"matches": "orders", "participants": "lineitem", "teams": "orders", "summoners": "supplier", "ranked": "customer", "timeline_events": "events", "timeline_frames": "events"}


def silver(spark: SparkSession, sf_dir: str, *tables: str) -> dict[str, DataFrame]:
    """The silver-shaped frames named, over the tables of ``sf_dir``."""
    for base in {BASE[t] for t in tables}:
        spark.read.parquet(f"{sf_dir}/{base}.parquet").createOrReplaceTempView(base)
    return {t: spark.sql(SQL[t]) for t in tables}


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze rows: JSON payloads of matches (with participants and teams), timelines, summoners and ranked leagues, built from the
    same frames, among them objects, arrays and broken text."""
    from .functions.parse import _SNAKE
    from .operators.relational import dedup_latest

    t = silver(spark, sf_dir, "matches", "participants", "summoners", "ranked", "timeline_events")
    # The newest line of each participant is found among the lines as they are stored, dealt by match: the wider frame is made of what is left, and
    # a match's rows, their list and the payload meet without another shuffle.
    lines = spark.table("lineitem").select(*_LINE).repartition("l_orderkey").selectExpr("*", f"{_DAY('l_shipdate')} AS ingest_ts", f"{_LINE_HASH} AS file_hash")
    dedup_latest(lines, ["l_orderkey", "l_linenumber"]).createOrReplaceTempView("lineitem_once")
    persons = spark.sql(SQL["participants"].replace("FROM lineitem", ", l_orderkey AS game_id FROM lineitem_once"))
    camel = lambda names: F.struct(*[F.col(k).alias(v) for k, v in names.items()])
    people = persons.groupBy("game_id").agg(F.collect_list(F.struct(*[F.col(k).alias(v) for k, v in _SNAKE["participants"].items()], F.col("team_id").alias("teamId"))).alias("participants"))
    kills = {"baron": "baron_kills", "dragon": "dragon_kills", "riftHerald": "rift_herald_kills", "tower": "tower_kills", "inhibitor": "inhibitor_kills", "champion": "champion_kills"}
    side = F.struct(F.col("team_id").alias("teamId"), "win", F.struct(*[F.struct(F.col(c).alias("kills")).alias(k) for k, c in kills.items()]).alias("objectives"))
    sides = spark.sql(SQL["teams"].replace("FROM (SELECT", ", o_orderkey AS game_id FROM (SELECT", 1)).select("game_id", "team_id", "win", *kills.values()).repartition("game_id").dropDuplicates(["game_id", "team_id"]).groupBy("game_id").agg(F.collect_list(side).alias("teams"))
    info = F.struct(*[F.col(k).alias(v) for k, v in _SNAKE["matches"].items()], "participants", "teams")
    m = t["matches"].join(people, "game_id", "left").join(sides, "game_id", "left")
    line = ["dataset", "source_file", "file_hash", "ingest_ts", "ingest_date"]
    out = [m.select(*line, F.to_json(F.struct(F.struct(F.col("match_id").alias("matchId")).alias("metadata"), info.alias("info"))).alias("payload_json"))]
    out.append(t["summoners"].select(*line, F.to_json(camel(_SNAKE["summoners"])).alias("payload_json")))
    out.append(t["ranked"].select(*line, F.to_json(F.struct(F.col("league_id").alias("leagueId"), "queue", "tier", F.array(camel(_SNAKE["ranked"])).alias("entries"))).alias("payload_json")))
    e = t["timeline_events"]
    frames = e.groupBy("match_id", "frame_index").agg(F.array_sort(F.collect_list(F.struct("event_index", camel(_SNAKE["events"]).alias("e")))).alias("events"), F.min("event_timestamp").alias("first"), F.collect_set(F.col("participant_id").cast("string")).alias("people"))
    people = F.map_from_arrays("people", "people").alias("participantFrames")
    in_order = lambda a, b: (a["frame_index"] - b["frame_index"]).cast("int")  # noqa: E731 (maps have no order of their own)
    frames = frames.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("frame_index", F.struct(F.col("first").alias("timestamp"), people, F.col("events.e").alias("events")).alias("f"))), in_order).alias("frames"))
    times = frames.select(F.lit("timelines").alias("dataset"), F.concat(F.lit("raw/timelines/"), "match_id").alias("source_file"), F.col("match_id").alias("file_hash"), F.lit("2024-01-01T00:00:00Z").alias("ingest_ts"), F.lit("2024-01-01").alias("ingest_date"), F.to_json(F.struct(F.struct(F.col("match_id").alias("matchId")).alias("metadata"), F.struct(F.col("frames.f").alias("frames")).alias("info"))).alias("payload_json"))
    out.append(times)
    broken = t["summoners"].select(*line, F.element_at(F.array(F.lit("{bad"), F.lit("[1]"), F.lit("7")), (F.length("puuid") % 3 + 1).cast("int")).alias("payload_json"))
    return out[0].unionAll(out[1]).unionAll(out[2]).unionAll(out[3]).unionAll(broken)
