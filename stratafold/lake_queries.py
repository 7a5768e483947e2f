"""Registered queries that go through files: ingestion, greedy batches, registered tables and stored profiles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runners, scratch
from . import schemas as S
from . import views as V
from .quality import report as Q
from .quality import sketches as SK
from .sources import files
from .streaming import ingest

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _raw_summoners(spark: SparkSession, d: str, root: str, where: str, arrival: str) -> None:
    """A JSON file for each supplier, one in ten of them broken text; a folder for each arrival, in it folders of about 1,000 files."""
    rows = spark.read.parquet(f"{d}/supplier.parquet").where(where)
    good = F.format_string('{"puuid":"p%d","id":"s%d","profileIconId":%d,"summonerLevel":%d}', "s_suppkey", F.col("s_suppkey") % 50, "s_nationkey", F.col("s_suppkey") % 500)
    text = F.when(F.col("s_suppkey") % 10 == 3, F.concat(F.lit("{bad"), F.col("s_suppkey"))).otherwise(good)
    folders = 8 + rows.count() // 1000
    named = rows.select(F.pmod(F.xxhash64("s_suppkey"), F.lit(folders)).alias("part"), text.alias("value"))
    # A file holds one row.  A folder is one task's, so the commit moves folders, not files.
    named.repartition(folders, "part").write.option("maxRecordsPerFile", 1).partitionBy("part").text(f"{root}/summoners/{arrival}")


def lake_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Two thirds of the files by stream, the rest by batch, the stream again: each file once, its digest, and the silver row it gives, if any."""
    lake = scratch.fresh(spark, "lake")
    raw, bronze = f"{lake}/raw", f"{lake}/bronze/raw_json"
    _raw_summoners(spark, d, raw, "s_suppkey % 3 <> 0", "first")
    ingest.ingest(spark, raw, bronze, f"{lake}/checkpoint", ("summoners",), max_files=40, max_bytes=2000, glob="*.txt")
    _raw_summoners(spark, d, raw, "s_suppkey % 3 = 0", "second")
    ingest.ingest_pending(spark, raw, bronze, ("summoners",), glob="*.txt")
    ingest.ingest(spark, raw, bronze, f"{lake}/other", ("summoners",), glob="*.txt")
    runners.run_silver(spark, lake, tables=["summoners"], partition_by=())
    silver = spark.read.parquet(f"{lake}/silver/summoners").select("file_hash", "puuid", "profile_icon_id", "summoner_level")
    rows = ingest.read_bronze(spark, bronze).groupBy("dataset", "file_hash", "payload_json").agg(F.count("*").alias("times"))
    taken = ingest.ledger(spark, bronze).select("file_hash", "length", (F.col("reason").isNull()).alias("kept"))
    return rows.join(taken, "file_hash").join(silver, "file_hash", "left")


QUERIES["lake_ingest"] = lake_ingest
SQL["lake_ingest"] = """WITH t AS (SELECT s_suppkey AS k, s_nationkey, CASE WHEN s_suppkey % 10 = 3 THEN '{bad' || s_suppkey
    ELSE '{"puuid":"p' || s_suppkey || '","id":"s' || (s_suppkey % 50) || '","profileIconId":' || s_nationkey || ',"summonerLevel":' || (s_suppkey % 500) || '}' END || chr(10) AS payload_json FROM supplier)
    SELECT 'summoners' AS dataset, sha256(payload_json) AS file_hash, payload_json, 1::BIGINT AS times, length(payload_json)::BIGINT AS length, true AS kept,
    CASE WHEN k % 10 <> 3 THEN 'p' || k END AS puuid, CASE WHEN k % 10 <> 3 THEN s_nationkey::BIGINT END AS profile_icon_id, CASE WHEN k % 10 <> 3 THEN (k % 500)::BIGINT END AS summoner_level FROM t"""


def lake_batches(spark: SparkSession, d: str) -> DataFrame:
    """Greedy batches of the documents as a listing, each source a dataset, at most 20 files and 30,000 characters each."""
    listing = spark.read.parquet(f"{d}/documents.parquet").select(
        F.coalesce("source", F.lit("none")).alias("dataset"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("length")
    )
    cut = files.micro_batches(listing, 20, 30_000)
    return cut.groupBy("dataset", "batch").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.min("path").alias("first"))


QUERIES["lake_batches"] = lake_batches
SQL["lake_batches"] = """WITH RECURSIVE t AS (SELECT coalesce(source, 'none') AS dataset, lpad(doc_id::VARCHAR, 12, '0') AS path, coalesce(length(text), 0) AS len FROM documents),
    f AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY path) AS i FROM t),
    g AS (SELECT dataset, path, len, i, 0 AS batch, 1 AS n, len AS total FROM f WHERE i = 1
        UNION ALL SELECT f.dataset, f.path, f.len, f.i, CASE WHEN g.n >= 20 OR g.total + f.len > 30000 THEN g.batch + 1 ELSE g.batch END,
        CASE WHEN g.n >= 20 OR g.total + f.len > 30000 THEN 1 ELSE g.n + 1 END, CASE WHEN g.n >= 20 OR g.total + f.len > 30000 THEN f.len ELSE g.total + f.len END
        FROM g JOIN f ON f.dataset = g.dataset AND f.i = g.i + 1)
    SELECT dataset, batch, count(*) AS files, sum(len)::BIGINT AS bytes, min(path) AS first FROM g GROUP BY 1, 2"""


def lake_registered(spark: SparkSession, d: str) -> DataFrame:
    """Silver matches and teams written by month, registered twice, and read by name: teams and wins of each date."""
    lake, database = scratch.fresh(spark, "lake"), f"lake_{uuid.uuid4().hex}"
    for t, df in V.silver(spark, d, "matches", "teams").items():
        files.write_table(df.withColumn("month", F.left("game_date", F.lit(7))), f"{lake}/silver/{t}", partition_by=("month",), mode="overwrite")
        files.register_tables(spark, lake, "silver", ["matches", "teams", "absent"], database)
    out = spark.sql(
        f"""SELECT m.game_date, count(*) AS teams, count_if(t.win) AS wins, max(m.game_duration) AS longest
        FROM {database}.silver_matches m JOIN {database}.silver_teams t ON m.match_id = t.match_id AND m.month = t.month GROUP BY m.game_date"""
    )
    # The frame reads the files; the names are not needed any more.
    out = scratch.saved(out, "registered")
    spark.sql(f"DROP DATABASE {database} CASCADE")
    return out


QUERIES["lake_registered"] = lake_registered
SQL["lake_registered"] = f"""WITH m AS ({V.SQL['matches']}), t AS ({V.SQL['teams']})
    SELECT m.game_date, count(*) AS teams, count(*) FILTER (t.win) AS wins, max(m.game_duration) AS longest FROM m JOIN t USING (match_id) GROUP BY 1"""


def dq_profile_daily(spark: SparkSession, d: str) -> DataFrame:
    """Sketches of the ranked table, stored by day in two steps and merged: exact counts, and whether distinct values are within 5 %."""
    t, store = V.silver(spark, d, "ranked")["ranked"], scratch.fresh(spark, "sketches")
    SK.refresh(t.where("game_date < '2001-02-03'"), "ranked", store)
    SK.refresh(t, "ranked", store, ["2001-02-03"])
    exact = Q.profile(t, "ranked", exact=True).select("column", F.col("distinct_values").alias("exact"))
    near = F.abs(F.col("distinct_values") - F.col("exact")) <= 0.05 * F.col("exact")
    return SK.merged(SK.read(spark, store)).join(exact, "column").select("column", "rows", "nulls", "empty_strings", "min_value", "max_value", "exact", near.alias("near"))


def _column(f) -> str:
    c, number = f.name, f.dataType.simpleString() in ("bigint", "double")
    bounds = f"min({c})::DOUBLE AS min_value, max({c})::DOUBLE AS max_value" if number else "NULL::DOUBLE AS min_value, NULL::DOUBLE AS max_value"
    empty = f"count(*) FILTER (trim({c}) = '')" if f.dataType.simpleString() == "string" else "0::BIGINT"
    return f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) FILTER ({c} IS NULL) AS nulls, {empty} AS empty_strings, {bounds}, count(DISTINCT {c}) AS exact, true AS near FROM ranked"


QUERIES["dq_profile_daily"] = dq_profile_daily
SQL["dq_profile_daily"] = f"WITH ranked AS ({V.SQL['ranked']}) " + " UNION ALL ".join(_column(f) for f in S.SILVER_SCHEMAS["ranked"])
