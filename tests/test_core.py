"""Operators of the layered library against known rows, and queries against DuckDB."""

import json
import random
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[1]))

from stratafold import lake_queries, runners  # noqa: E402
from stratafold import queries as C  # noqa: E402
from stratafold import schemas as S  # noqa: E402
from stratafold import views as V  # noqa: E402
from stratafold.functions import exprs as X  # noqa: E402
from stratafold.functions import parse  # noqa: E402
from stratafold.operators import gold as G  # noqa: E402
from stratafold.operators import relational as R  # noqa: E402
from stratafold.plans import features as P  # noqa: E402
from stratafold.quality import report as Q  # noqa: E402
from stratafold.quality import rules as QR  # noqa: E402
from stratafold.quality import sketches as SK  # noqa: E402
from stratafold.sources import files  # noqa: E402
from stratafold.streaming import ingest  # noqa: E402

SF = "/root/testdata/sf0.001"


def plain(df):
    out = []
    for r in df[sorted(df.columns)].itertuples(index=False, name=None):
        out.append(tuple(None if pd.isna(x) else x if isinstance(x, str) else f"{float(x):.5f}" if not hasattr(x, "isoformat") else str(x) for x in r))
    return sorted(out, key=str)


@pytest.mark.parametrize("name", ["mart_player_daily", "mart_team_objective_daily", "dim_summoner", "dim_rank", "silver_teams", "silver_timeline_events", "expr_all", "bi_pick_rate", "dq_rules_participants", "dq_fk_checks", "dq_profile", "dq_status", "dq_required_keys"])
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("customer", "supplier", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = C.QUERIES[name](spark, SF).toPandas(), con.execute(C.SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def bronze(spark, *payloads):
    rows = [(d, f"raw/{d}/{i}.json", f"h{i}", "2024-03-10T00:00:00Z", "2024-03-10", p if isinstance(p, str) else json.dumps(p)) for i, (d, p) in enumerate(payloads)]
    return spark.createDataFrame(rows, S.BRONZE_SCHEMA)


def match(ms=1709942400000, teams=()):
    person = {"participantId": 1, "puuid": "p1", "kills": 7, "deaths": 0, "assists": 5, "win": True, "teamId": 100}
    return {"metadata": {"matchId": "M1"}, "info": {"gameCreation": ms, "gameStartTimestamp": ms, "participants": [person, None], "teams": list(teams)}}


def test_silver(spark):
    teams = [{"teamId": 0}, {"teamId": 100, "win": True, "objectives": {"baron": {"kills": 2}}}, {"teamId": "200"}]
    b = bronze(spark, ("matches", match(teams=teams)), ("matches", match(teams=teams)), ("matches", "{bad"), ("matches", "[1]"), ("matches", "7"))
    out = parse.build_silver(b)
    (m,) = out["matches"].collect()
    assert (m.match_id, m.game_date, m.participant_count) == ("M1", "2024-03-09", 2)
    people = {r.participant_id: r for r in out["participants"].collect()}
    assert people[1].kda == 12.0 and people[None].kda is None and len(people) == 2
    assert {(r.team_id, r.baron_kills) for r in out["teams"].collect()} == {(100, 2), (200, None)}
    zero = parse.build_silver(bronze(spark, ("matches", match(ms=0))), ["matches"])["matches"].first()
    assert zero.game_date == "2024-03-10"
    entry = {"queue": "Q", "tier": "GOLD", "entries": [{"summonerId": "s", "rank": "I", "wins": 3, "losses": 1}]}
    assert parse.build_silver(bronze(spark, ("ranked", entry)))["ranked"].first().win_rate == 0.75
    line = {"metadata": {"matchId": "M1"}, "info": {"frames": [{"timestamp": 5, "participantFrames": {"1": {}, "2": {}}, "events": [{"type": "A"}, {"type": "B"}]}, None]}}
    out = parse.build_silver(bronze(spark, ("timelines", line)))
    assert [(r.frame_index, r.participant_frame_count, r.event_count) for r in out["timeline_frames"].orderBy("frame_index").collect()] == [(0, 2, 2), (1, 0, 0)]
    assert [(r.event_index, r.event_type) for r in out["timeline_events"].orderBy("event_index").collect()] == [(0, "A"), (1, "B")]


def test_wrong_types_become_null(spark):
    p = match()
    p["info"]["participants"][0]["kills"] = "many"
    r = parse.build_silver(bronze(spark, ("matches", p)))["participants"].where("participant_id = 1").first()
    assert r.kills is None and r.kda is None


def test_detect_dataset(spark):
    rows = [("/raw/MATCHES/a.json", "{}", "matches"), ("/x/a.json", '{"metadata":1,"info":{"frames":[]}}', "timelines"), ("/x/a.json", '{"metadata":1,"info":{}}', "matches"), ("/x/a.json", '{"entries":[],"tier":"X"}', "ranked"), ("/x/a.json", '{"puuid":1,"summonerLevel":2}', "summoners"), ("/x/a.json", "[]", "unknown")]
    df = spark.createDataFrame(rows, "p string, j string, want string").select("want", X.detect_dataset("p", "j").alias("got"))
    assert all(r.want == r.got for r in df.collect())


def test_dedup_is_total(spark):
    df = spark.createDataFrame([(None, "a", "1", 1), (None, "a", "2", 2), ("k", "b", "1", 3), ("k", "c", "0", 4)], "id string, ingest_ts string, file_hash string, v int")
    assert {(r.id, r.v) for r in R.dedup_latest(df, ["id"]).collect()} == {(None, 2), ("k", 4)}
    with pytest.raises(ValueError, match="nope"):
        R.dedup_latest(df, ["nope"])


def test_gold_builds_what_it_can(spark):
    tables = V.silver(spark, SF, "participants", "teams")
    made, skipped = G.build(tables)
    assert skipped["dim_rank"] == ["ranked"] and "dim_summoner" in skipped and set(made["dim_team"].columns) == set(S.GOLD["dim_team"])
    assert len(S.table_definitions()) == 24


def test_rules(spark):
    cols = "game_date string, puuid string, matches_played long, wins long, losses long, win_rate double, avg_kills double"
    bad = spark.createDataFrame([("2024-01-01", "p", 1, 2, 0, 1.2, -1.0), ("2024-01-01", "p", 1, 1, 0, 1.0, 1.0)], cols)
    got = {r.rule: (r.status, r.failed_rows) for r in QR.evaluate(bad, "t", [QR.Rule("u", "unique", ("game_date", "puuid")), QR.Rule("r", "between", ("win_rate",), {"min": 0, "max": 1}), QR.Rule("n", "non_negative", ("avg_kills",)), QR.Rule("s", "sum_equals", ("wins", "losses"), {"target": "matches_played"}), QR.Rule("x", "not_null", ("absent",)), QR.Rule("b", "boolean_if_present", ("absent",))]).collect()}
    assert got == {"u": ("FAIL", 1), "r": ("FAIL", 1), "n": ("FAIL", 1), "s": ("FAIL", 1), "x": ("SKIP", None), "b": ("PASS", 0)}
    teams = spark.createDataFrame([(100,), (0,), (0,), (300,)], "team_id long")
    (r,) = QR.evaluate(teams, "t", [QR.Rule("ids", "accepted", ("team_id",), {"values": [100, 200]}, "warning")]).collect()
    assert (r.status, r.failed_rate) == ("WARN", 0.75)
    assert [(r.value, r.n) for r in QR.top_invalid(teams, "team_id", [100, 200]).collect()] == [(0, 2), (300, 1)]
    empty = QR.evaluate(teams.limit(0), "t", [QR.Rule("ids", "accepted", ("team_id",), {"values": [1]}), QR.Rule("min", "row_count_min", (), {"min": 1})]).collect()
    assert [r.status for r in empty] == ["PASS", "FAIL"]


def test_report(spark, tmp_path):
    checks = Q.check_tables({"ranked": V.silver(spark, SF, "ranked")["ranked"], "teams": None}, spark)
    assert {r.table: r.status for r in Q.table_status(checks).collect()}["teams"] == "FAIL"
    s = Q.summary(checks).first()
    assert (s.status, s.tables_missing, s.tables_expected, s.ready) == ("FAIL", 1, 2, False)
    sections = Q.report(spark, {"silver": {"ranked": V.silver(spark, SF, "ranked")["ranked"], "teams": None}})
    Q.write_report(sections, str(tmp_path), "r1")
    Q.write_report(sections, str(tmp_path), "r2")
    assert spark.read.json(f"{tmp_path}/latest/checks").count() == checks.count() and spark.read.json(f"{tmp_path}/runs/checks").count() == 2 * checks.count()
    assert [r.run_id for r in Q.scores(spark, str(tmp_path)).orderBy("run_id").collect()] == ["r1", "r2"]
    assert Q.foreign_keys({"dim_match": spark.range(1)}).where("status <> 'SKIP'").count() == 0


def raw_folder(root, **datasets):
    for d, contents in datasets.items():
        (root / d).mkdir(parents=True, exist_ok=True)
        for name, content in contents.items():
            (root / d / name).write_bytes(content)


def test_ingest(spark, tmp_path):
    """Stream, then batch, then stream again: one state, each file once, and every file kept or rejected."""
    raw, bronze = tmp_path / "raw", str(tmp_path / "bronze")
    raw_folder(raw, matches={f"{i}.json": b"{}" if i else b"not json" for i in range(5)} | {"bad.json": b"\xff\xfe", "note.txt": b"x"}, summoners={"a.json": b"{}"})
    stream = lambda: ingest.ingest(spark, str(raw), bronze, str(tmp_path / "cp"), ("matches", "summoners"), max_files={"matches": 2})
    stream()
    table = ingest.read_bronze(spark, bronze)
    assert table.columns == S.BRONZE and table.count() == 6 and table.where("payload_json = 'not json'").count() == 1
    assert {(r.batch, r.n) for r in ingest.ledger(spark, bronze).where("dataset = 'matches'").groupBy("batch").agg(F.count("*").alias("n")).collect()} == {(0, 2), (1, 2), (2, 2)}
    (bad,) = ingest.rejects(spark, bronze).collect()
    assert bad.path.endswith("bad.json") and (bad.length, bad.reason) == (2, "not UTF-8") and len(bad.file_hash) == 64
    raw_folder(raw, matches={"new.json": b"{}", "worse.json": b"\xc3"})
    assert ingest.ingest_pending(spark, str(raw), bronze) == 1 and ingest.ingest_pending(spark, str(raw), bronze) == 0
    raw_folder(raw, matches={"newer.json": b"{}"})
    stream()
    # Another checkpoint, as after its loss, takes nothing twice.
    ingest.ingest(spark, str(raw), bronze, str(tmp_path / "other"), ("matches", "summoners"))
    sources = [r.source_file for r in ingest.read_bronze(spark, bronze).collect()]
    assert len(sources) == len(set(sources)) == 8 and ingest.rejects(spark, bronze).count() == 2
    assert ingest.ledger(spark, bronze).count() == 10 == ingest.commits(spark, bronze).agg(F.sum("files")).first()[0]
    assert sorted(ingest.read_bronze(spark, bronze, ("summoners",)).first())[-1] == "{}"


def test_files_are_listed_once(spark, tmp_path, monkeypatch):
    """A batch run lists each dataset's folder once; folders that are not there or hold no file of the pattern give nothing, by stream or batch."""
    raw, bronze, scans, scan = tmp_path / "raw", str(tmp_path / "bronze"), [], files.scan_files
    raw_folder(raw, matches={"a.json": b"{}"}, summoners={"note.txt": b"x"}, ranked={})

    def counted(spark, root, *rest):
        scans.append(root)
        return scan(spark, root, *rest)

    for module in (files, ingest):
        monkeypatch.setattr(module, "scan_files", counted)
    assert ingest.ingest_pending(spark, str(raw), bronze) == 1 and scans == [f"{raw}/{d}" for d in ("matches", "summoners", "ranked")]
    before = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    assert all(q.exception() is None for q in ingest.ingest(spark, str(raw), bronze, str(tmp_path / "cp")))
    assert ingest.read_bronze(spark, bronze).count() == 1 and spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == before
    assert ingest.ingest_pending(spark, str(tmp_path / "none"), bronze) == 0 == len(ingest.ingest(spark, str(tmp_path / "none"), bronze, str(tmp_path / "cp2")))


def test_files_are_listed_and_read_in_parts(spark, tmp_path, monkeypatch):
    """No scan holds more files than a part may, by stream or batch; each file once, in the batches of the whole dataset, also after a run that failed."""
    raw, bronze, scan, sizes = tmp_path / "raw", str(tmp_path / "bronze"), files.scan_files, []
    folders = ["a", "a/deep", "a/deep/er", "b[1]", "c.json", "_hidden", ""]

    def more(*numbers):
        for f in folders:
            (raw / "matches" / f).mkdir(parents=True, exist_ok=True)
            for i in numbers:
                (raw / "matches" / f / f"{i}.json").write_text(f'{{"f":"{f}{i}"}}')
        (raw / "matches/note.txt").write_text("x")

    def counted(spark, root, *rest):
        found = scan(spark, root, *rest)
        sizes.append(len(found.inputFiles()))
        return found

    more(0, 1)
    monkeypatch.setattr(files, "PART_FILES", 3, raising=False)
    for module in (files, ingest):
        monkeypatch.setattr(module, "scan_files", counted)
    stream = lambda at="cp": ingest.ingest(spark, str(raw), bronze, str(tmp_path / at), ("matches",), max_files=5)
    cut = ingest.micro_batches
    monkeypatch.setattr(ingest, "micro_batches", lambda *_: 1 / 0)
    with pytest.raises(Exception, match="ZeroDivision|division"):
        stream()
    monkeypatch.setattr(ingest, "micro_batches", cut)
    more(2)  # parts are others now
    stream()
    runs = {}
    for r in ingest.ledger(spark, bronze).orderBy("path").collect():
        runs.setdefault(r.run, []).append(r.batch)
    assert sorted(runs.values()) == [[i // 5 for i in range(6)], [i // 5 for i in range(12)]]  # what the failed run was handed is handed over alone
    more(3)
    assert ingest.ingest_pending(spark, str(raw), bronze) == 6
    stream()
    stream("other")
    rows = ingest.read_bronze(spark, bronze)
    assert rows.count() == 24 == rows.select("source_file").distinct().count() == rows.select("payload_json").distinct().count()
    assert rows.where("source_file like '%hidden%'").isEmpty() and ingest.commits(spark, bronze).count() == 3
    assert len(sizes) > 8 and max(sizes) <= 4  # a folder's own files: 4 at last


def test_raw_files_of_lake_ingest(spark, tmp_path):
    """A file for each supplier, in folders whose number does not grow as that of the files."""
    spark.range(3000).selectExpr("id AS s_suppkey", "id % 25 AS s_nationkey").write.parquet(str(tmp_path / "supplier.parquet"))
    lake_queries._raw_summoners(spark, str(tmp_path), str(tmp_path / "raw"), "s_suppkey < 2000", "first")
    lake_queries._raw_summoners(spark, str(tmp_path), str(tmp_path / "raw"), "s_suppkey >= 2000", "second")
    found = [p for p in (tmp_path / "raw").rglob("*.txt")]
    assert len(found) == 3000 == len({p.read_text() for p in found}) and all(p.read_text().count("\n") == 1 for p in found)
    assert len({p.parent for p in found}) <= 8 + 2 + 8 + 1


def test_runs_without_a_commit_are_invisible(spark, tmp_path):
    raw, bronze = tmp_path / "raw", str(tmp_path / "bronze")
    raw_folder(raw, ranked={"a.json": b"{}", "b.json": b"[]"})
    ingest.ingest_pending(spark, str(raw), bronze, max_files=1)
    raw_folder(raw, ranked={"c.json": b"{}"})
    ingest.ingest_pending(spark, str(raw), bronze)
    last = ingest.commits(spark, bronze).orderBy(F.desc("committed_at")).first().run
    kept = ingest.commits(spark, bronze).where(F.col("run") != last).collect()
    spark.createDataFrame(kept, ingest.commits(spark, bronze).schema).coalesce(1).write.parquet(str(tmp_path / "log"))
    (tmp_path / "bronze/_commits").rename(tmp_path / "lost")
    (tmp_path / "log").rename(tmp_path / "bronze/_commits")
    assert ingest.read_bronze(spark, bronze).count() == 1 == ingest.ledger(spark, bronze).count()
    assert ingest.ingest_pending(spark, str(raw), bronze) == 2 and ingest.read_bronze(spark, bronze).select("source_file").distinct().count() == 3 == ingest.read_bronze(spark, bronze).count()


def test_caps_and_files(spark, tmp_path):
    raw, bronze = tmp_path / "raw", str(tmp_path / "bronze")
    raw_folder(raw, matches={f"{i}.json": b"{}" for i in range(9)}, summoners={"a.json": b"{}"})
    rows = files.bronze_rows(files.scan_files(spark, str(raw)))
    assert rows.count() == 10 and "payload_json" not in files.manifest(files.scan_files(spark, str(raw))).columns
    done = rows.where("source_file like '%/0.json' or source_file like '%/1.json'")
    assert files.pending(rows, done, dataset_max={"matches": 3}).where("dataset = 'matches'").select("source_file").first()[0].endswith("/2.json")
    assert files.pending(rows, done, max_files=2).count() == 2 and files.pending(rows, None).count() == 10
    assert ingest.ingest_pending(spark, str(raw), bronze, dataset_max={"matches": 8}, out_files=4) == 9
    written = lambda d: len(list((tmp_path / "bronze" / f"dataset={d}").rglob("*.parquet")))
    assert (written("matches"), written("summoners")) == (4, 1)
    assert ingest.ingest_pending(spark, str(raw), bronze, dataset_max={"matches": 8}) == 0
    df = spark.range(100)
    assert files.write_table(df, str(tmp_path / "t"), out_files=4) == 100 and len(list((tmp_path / "t").glob("*.parquet"))) == 4
    files.write_table(df.coalesce(1), str(tmp_path / "u"), max_rows=30)
    assert len(list((tmp_path / "u").glob("*.parquet"))) == 4


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2)], "game_date string, v long")
    path = str(tmp_path / "gold/t")
    assert files.read_table(spark, path) is None
    assert files.write_table(df, path, partition_by=("game_date", "absent"), mode="overwrite") == 2
    assert files.write_table(df.limit(0), path, mode="overwrite") == 0 and spark.read.parquet(path).count() == 2
    files.write_table(df, path, mode="append", partition_by=("game_date",))
    assert spark.read.parquet(path).count() == 4
    assert files.write_table(df, path, mode="ignore") == 0 and spark.read.parquet(path).count() == 4
    seen = {}
    assert files.write_table(df.limit(0), path, mode="overwrite", write_empty=True, observe=(F.sum("v").alias("sum"),), observed=seen) == 0
    assert spark.read.parquet(path).count() == 0 and not seen.get("sum")
    assert files.write_table(df.limit(0), f"{path}-none") == 0 and files.read_table(spark, f"{path}-none") is None
    for mode in ("upsert", "error"):
        with pytest.raises(ValueError):
            files.write_table(df, path, mode=mode)
    # Only the dates of the new rows are replaced.
    files.write_table(df, path, mode="overwrite", partition_by=("game_date",))
    fresh = spark.createDataFrame([("2024-01-02", 7), ("2024-01-03", 8)], df.schema)
    assert files.write_table(fresh, path, mode="overwrite", partition_by=("game_date",), dates=True) == 2
    assert sorted(r.v for r in files.read_table(spark, path).collect()) == [1, 7, 8]
    # A table can be overwritten from itself.
    assert files.write_table(files.read_table(spark, path).where("v > 1"), path, mode="overwrite", partition_by=("game_date",)) == 2
    assert files.read_table(spark, path).count() == 2


def test_register_drops_nothing(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2)], "game_date string, v long")
    files.write_table(df, str(tmp_path / "gold/t"), partition_by=("game_date",))
    files.write_table(df, str(tmp_path / "gold/flat"))
    run = lambda root=tmp_path: files.register_tables(spark, str(root), "gold", ["t", "absent", "flat"], "lake_test")
    before = spark.conf.get("spark.sql.sources.partitionColumnTypeInference.enabled")
    assert run() == {"gold_t": "create", "gold_flat": "create"} and run() == {"gold_t": "keep", "gold_flat": "keep"}
    assert spark.conf.get("spark.sql.sources.partitionColumnTypeInference.enabled") == before
    assert spark.table("lake_test.gold_t").columns == ["v", "game_date"] and spark.table("lake_test.gold_t").count() == 2
    # A new date and a new column are found by the next run.
    files.write_table(spark.createDataFrame([("2024-01-03", 3)], df.schema), str(tmp_path / "gold/t"), partition_by=("game_date",))
    files.write_table(df.withColumn("w", F.lit("x")), str(tmp_path / "gold/flat"), mode="overwrite")
    assert run() == {"gold_t": "keep", "gold_flat": "extend"}
    assert spark.table("lake_test.gold_t").count() == 3 and spark.table("lake_test.gold_flat").where("w = 'x'").count() == 2
    # Names that are taken are left alone, and nothing else is changed either.
    files.write_table(df.limit(1), str(tmp_path / "other/gold/t"))
    with pytest.raises(ValueError, match="gold_t: the table of this name lies at"):
        run(tmp_path / "other")
    spark.sql("CREATE TABLE lake_test.gold_kept USING parquet AS SELECT id FROM range(5)")
    files.write_table(df, str(tmp_path / "gold/kept"))
    files.write_table(df, str(tmp_path / "gold/fresh"))
    with pytest.raises(ValueError, match="gold_kept: a managed table"):
        files.register_tables(spark, str(tmp_path), "gold", ["fresh", "kept"], "lake_test")
    assert spark.table("lake_test.gold_kept").count() == 5 and not spark.catalog.tableExists("lake_test.gold_fresh")
    assert spark.table("lake_test.gold_t").count() == 3
    spark.sql("DROP DATABASE lake_test CASCADE")


def test_features(spark, tmp_path):
    made, _ = G.build(V.silver(spark, SF, "teams"), ["fact_team_objectives"])
    out = P.materialise(made, str(tmp_path), ["match_win_features"])["match_win_features"]
    assert out.columns == ["match_id", "team_id", "baron_kills", "dragon_kills", "label"] and out.count() == made["fact_team_objectives"].count()


def test_stream_dedup(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:01:00")], "id int, t string").select("id", F.to_timestamp("t").alias("t"))
    df.write.parquet(str(tmp_path / "in"))
    q = ingest.dedup_events(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), ["id"], "t").writeStream.format("memory").queryName("dedup").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("dedup").count() == 2


def raw_files(root):
    for d, payloads in {
        "matches": [match(teams=[{"teamId": 100, "win": True}]), "{bad"], "ranked": [{"queue": "Q", "tier": "GOLD", "entries": [{"summonerId": "s", "puuid": "p1", "rank": "I", "wins": 3, "losses": 1}]}],
    }.items():
        (root / d).mkdir(parents=True)
        for i, p in enumerate(payloads):
            (root / d / f"{i}.json").write_text(p if isinstance(p, str) else json.dumps(p))


def test_runners(spark, tmp_path):
    """Raw files to bronze, silver, gold and a report."""
    lake = str(tmp_path / "lake")
    raw_files(tmp_path / "raw")
    assert runners.run_silver(spark, lake) == dict.fromkeys(S.SILVER, 0) and set(runners.run_gold(spark, lake).values()) == {0}
    assert ingest.ingest_pending(spark, str(tmp_path / "raw"), f"{lake}/bronze/raw_json", max_files=1) == 1
    assert ingest.ingest_pending(spark, str(tmp_path / "raw"), f"{lake}/bronze/raw_json", out_files=1) == 2
    assert ingest.ingest_pending(spark, str(tmp_path / "raw"), f"{lake}/bronze/raw_json") == 0
    want = dict.fromkeys(S.SILVER, 0) | {"matches": 1, "participants": 2, "teams": 1, "ranked": 1}
    assert runners.run_silver(spark, lake) == want
    assert runners.run_silver(spark, str(tmp_path / "other"), "raw", str(tmp_path / "raw"), persist=None) == want
    assert runners.run_silver(spark, lake, datasets=["ranked"], tables=["ranked", "matches"]) == {"matches": 0, "ranked": 1}
    counts = runners.run_gold(spark, lake, ["dim_match", "dim_team", "dim_rank", "dim_summoner", "fact_participant_performance"])
    assert counts == {"dim_match": 1, "dim_summoner": 0, "dim_team": 1, "dim_rank": 1, "fact_participant_performance": 2}
    report = runners.run_quality(spark, lake, f"{lake}/quality", "r1", tables={"silver": ["matches", "summoners"], "gold": ["dim_match", "dim_team", "fact_participant_performance"]})
    status = {r.table: r.status for r in report["tables"].collect()}
    assert status["silver.summoners"] == "FAIL" and status["silver.matches"] == "PASS" and status["gold.dim_team"] == "WARN"
    assert report["alignment"].first().status == "PASS" and report["references"].where("status <> 'SKIP'").count() == 1
    assert report["summary"].first().tables_missing == 1 and report["coverage"].count() == 3
    for bad in (lambda: runners.run_silver(spark, lake, "lake"), lambda: runners.run_gold(spark, lake, ["nope"])):
        with pytest.raises(ValueError):
            bad()


def test_raw_as_bronze_is_typed_when_empty(spark, tmp_path):
    assert runners.raw_as_bronze(spark, str(tmp_path)).schema == S.BRONZE_SCHEMA and runners.raw_as_bronze(spark, str(tmp_path)).count() == 0


def plain_batches(sizes, most, size):
    """Greedy batches of a listing, one file after another."""
    out, n, total = [], 0, 0
    for s in sizes:
        if n and total + s > size:
            n, total = 0, 0
        out.append(0 if not out else out[-1] + (n == 0))
        n, total = n + 1, total + s
        if n >= most:
            n, total = 0, 0
    return out


def test_micro_batches(spark):
    """Ten random listings at once, each a dataset, against a plain loop; then files of four bytes under a limit of ten."""
    rng = random.Random(5)
    listings = {f"d{i}": ([rng.choice([0, 1, 10, 40, 90, 300]) for _ in range(rng.randrange(1, 60))], rng.randrange(1, 9), rng.randrange(1, 200)) for i in range(10)}
    listings["four"] = ([4] * 6, 3, 10)
    rows = [(d, f"f{i:03d}", s) for d, (sizes, _, _) in listings.items() for i, s in enumerate(sizes)]
    df = spark.createDataFrame(rows, "dataset string, path string, length long")
    got = {}
    for r in files.micro_batches(df, {d: x[1] for d, x in listings.items()}, {d: x[2] for d, x in listings.items()}).orderBy("path").collect():
        got.setdefault(r.dataset, []).append(r.batch)
    assert got == {d: plain_batches(*x) for d, x in listings.items()} and got["four"] == [0, 0, 1, 1, 2, 2]
    assert files.micro_batches(df.limit(0), 3, 100).count() == 0 and files.micro_batches(df, {}, {}).select("batch").distinct().count() == 1


def test_shared_parse_is_kept(spark):
    kept = []
    out = parse.build_silver(bronze(spark, ("matches", match())), ["matches", "participants", "ranked"], keep=kept)
    assert len(kept) == 1 and kept[0].is_cached and out["participants"].count() == 2
    kept[0].unpersist()


def test_ingest_with_both_bounds(spark, tmp_path):
    raw_folder(tmp_path / "raw", matches={f"{i}.json": b"x" * 4 for i in range(6)})
    ingest.ingest(spark, str(tmp_path / "raw"), str(tmp_path / "bronze"), str(tmp_path / "cp"), ("matches",), max_files={"matches": 3}, max_bytes={"matches": 10})
    assert [r.batch for r in ingest.ledger(spark, str(tmp_path / "bronze")).orderBy("source_file").collect()] == [0, 0, 1, 1, 2, 2]


def same_rows(a, b):
    return a.exceptAll(b.select(*a.columns)).isEmpty() and b.select(*a.columns).exceptAll(a).isEmpty()


def test_checks_taken_while_writing(spark, tmp_path):
    """Rules counted by the writes give the report that rules tried afterwards give; marts come from the written facts."""
    lake, checked = str(tmp_path / "lake"), {}
    raw_files(tmp_path / "raw")
    ingest.ingest_pending(spark, str(tmp_path / "raw"), f"{lake}/bronze/raw_json")
    names = {"silver": ["matches", "participants"], "gold": ["fact_participant_performance", "mart_player_daily_performance", "dim_team"]}
    runners.run_silver(spark, lake, checked=checked, persist="MEMORY_AND_DISK", tables=names["silver"])
    runners.run_gold(spark, lake, checked=checked, tables=names["gold"])
    tables = {layer: {t: files.read_table(spark, f"{lake}/{layer}/{t}") for t in own} for layer, own in names.items()}
    assert {"silver.matches", "silver.participants", "gold.fact_participant_performance", "gold.mart_player_daily_performance"} == set(checked)
    for layer, found in tables.items():
        for t, df in found.items():
            if df is not None:
                assert same_rows(checked[f"{layer}.{t}"], QR.evaluate(df, t, QR.rules_for(t))), t
    one, two = Q.report(spark, tables, checked), Q.report(spark, tables)
    assert all(same_rows(one[s], two[s]) for s in ("checks", "summary", "profiles"))
    direct, _ = G.build(tables["silver"], names["gold"])
    assert all(same_rows(tables["gold"][t], df) for t, df in direct.items())
    run = runners.run_quality(spark, lake, f"{lake}/quality", "r9", ["gold"], {"gold": names["gold"][:1]}, checked=checked)["run"].first()
    assert (run.id, run.layers, run.tables) == ("r9", ["gold"], 1)
    with pytest.raises(ValueError, match="storage level"):
        runners.run_silver(spark, lake, persist="SOMEWHERE")


def test_report_reads_each_table_once(spark, tmp_path):
    """Jobs of a report on one table: its rules and profile together, its keys, its dates, and what is made from saved results."""
    spark.createDataFrame([("2024-01-01", 100, "RED")], "game_date string, team_id long, team_side string").write.parquet(str(tmp_path / "t"))
    df, reads = files.read_table(spark, str(tmp_path / "t")), []
    for name, section in Q.report(spark, {"gold": {"dim_team": df}}).items():
        plan = section._jdf.queryExecution().executedPlan().toString()
        reads.append((name, str(tmp_path / "t") in plan))
    assert not any(read for _, read in reads)


def test_refresh_of_touched_dates(spark, tmp_path):
    """New bronze rows: a new match, a match that moves to another date and empties its old one, a later version on the same date."""
    day = 86_400_000
    base = 1709942400000

    def payload(match_id, ms, kills):
        p = match(ms, [{"teamId": 100, "win": True}])
        p["metadata"]["matchId"] = match_id
        p["info"]["participants"][0]["kills"] = kills
        return p

    def rows(*given):
        return spark.createDataFrame([("matches", f"raw/matches/{h}.json", h, ts, ts[:10], json.dumps(p)) for h, ts, p in given], S.BRONZE_SCHEMA)

    old = rows(*[(f"h{i}", "2024-03-20T00:00:00Z", payload(f"M{i}", base + i * day, i)) for i in range(4)])
    new = rows(("n1", "2024-03-21T00:00:00Z", payload("M9", base + day, 50)), ("n2", "2024-03-21T00:00:00Z", payload("M2", base + 9 * day, 60)), ("n3", "2024-03-21T00:00:00Z", payload("M3", base + 3 * day, 70)))
    want = parse.build_silver(old.unionAll(new), ["matches", "participants", "teams"])
    lake = str(tmp_path)
    for t, df in parse.build_silver(old, ["matches", "participants", "teams"]).items():
        files.write_table(df, f"{lake}/silver/{t}", partition_by=("game_date",))
    runners.run_gold(spark, lake, ["fact_participant_performance", "mart_champion_daily_performance", "fact_team_objectives"])
    untouched = tmp_path / "silver/participants/game_date=2024-03-09"
    before = sorted(p.name for p in untouched.iterdir())
    touched = runners.refresh_silver(spark, lake, new, ["matches", "participants", "teams"])
    assert touched["matches"] == ["2024-03-10", "2024-03-11", "2024-03-12", "2024-03-18"]
    for t, df in want.items():
        assert same_rows(df, files.read_table(spark, f"{lake}/silver/{t}")), t
    assert sorted(p.name for p in untouched.iterdir()) == before and not (tmp_path / "silver/matches/game_date=2024-03-11").exists()
    refreshed = runners.refresh_gold(spark, lake, touched)
    for t, df in G.build(want, list(refreshed))[0].items():
        assert same_rows(df, files.read_table(spark, f"{lake}/gold/{t}")), t
    assert "fact_team_objectives" in refreshed and "fact_rank_snapshot" not in refreshed


def test_profiles_by_day(spark, tmp_path):
    """A new day is profiled from its rows alone; the stored sketches together are the profile of the whole table."""
    rows = [(f"2024-01-0{1 + i % 3}", i, f"w{i % 700}", None if i % 5 else " ", i / 2, i % 2 == 0) for i in range(6000)]
    df = spark.createDataFrame(rows, "game_date string, k long, w string, e string, x double, b boolean")
    store = str(tmp_path / "profiles")
    SK.refresh(df.where("game_date < '2024-01-03'"), "t", store)
    SK.refresh(df, "t", store, ["2024-01-03"])
    got = {r.column: r for r in SK.merged(SK.read(spark, store)).collect()}
    for r in Q.profile(df, "t", exact=True).collect():
        g = got[r.column]
        assert (g.type, g.nulls, g.null_ratio, g.empty_strings, g.min_value, g.max_value) == (r.type, r.nulls, r.null_ratio, r.empty_strings, r.min_value, r.max_value)
        assert abs(g.distinct_values - r.distinct_values) <= 0.05 * r.distinct_values and (g.avg_value is None or abs(g.avg_value - r.avg_value) < 1e-9)
    assert SK.merged(SK.read(spark, store), "date").count() == 18 and SK.read(spark, str(tmp_path / "none")) is None


def shuffles(df):
    """Shuffles by a key in the plan, before any is reused."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_dedup_with_columns_chooses_by_all(spark):
    rows = [("k", "t", "h", None, "a", 1), ("k", "t", "h", "a", None, 2), ("k", "t", "h", "b", None, 3), (None, "t", "g", "x", "y", 4), (None, "t", "h", None, None, 5)]
    df = spark.createDataFrame(rows, "id string, ingest_ts string, file_hash string, a string, b string, v int")
    whole = {(r.id, r.v) for r in R.dedup_latest(df, ["id"], columns=df.columns).collect()}
    assert len(whole) == 2 and (None, 5) in whole
    for few in (["v"], ["a", "v"], ["v", "file_hash"]):
        out = R.dedup_latest(df, ["id"], columns=few, deal=["id"])
        assert set(out.columns) == {"id", *few} and {(r.id, r.v) for r in out.collect()} == whole
    # Dealt by a part of the key: one shuffle, no sort before it, and the grouping by that part adds none.
    wide = spark.range(50).selectExpr("id % 7 AS m", "id % 3 AS p", "id AS v", "cast(id AS string) AS ingest_ts")
    out = R.dedup_latest(wide, ["m", "p"], columns=["v"], deal=["m"]).groupBy("m").agg(F.sum("v").alias("v"))
    assert shuffles(out) == 1 and same_rows(out, R.dedup_latest(wide, ["m", "p"]).groupBy("m").agg(F.sum("v").alias("v")))


def test_marts_deal_rows_once_for_each_grouping(spark):
    """Rows by match, then sums by group; distinct values by group and value, then by group: the parts are joined as they lie."""
    t = V.silver(spark, SF, "participants", "teams")
    assert shuffles(G.mart_player_daily(t)) == 5 and shuffles(G.mart_champion_daily(t)) == 5
    made = G.build(t, ["mart_role_daily_performance"])[0]["mart_role_daily_performance"]
    assert shuffles(made) == 8 and made.count() == made.select("game_date", "team_position").distinct().count()
    # Null groups are groups, in all parts.
    rows = spark.createDataFrame([(None, "m1", "p1", 1), (None, "m1", "p2", 2), (None, "m2", None, 3), ("d", "m2", "p1", 4)], "game_date string, match_id string, puuid string, kills long")
    df = R.conform(rows, S.GOLD_SCHEMAS["fact_participant_performance"])
    got = {r.game_date: (r.matches_played, r.unique_players, r.total_kills, r.puuid) for r in R.participant_metrics(df, ["game_date"], ("unique_players",), names=("puuid",)).collect()}
    assert got == {None: (2, 2, 6, "p1"), "d": (1, 1, 4, "p1")}


def test_silver_payloads_deal_matches_once(spark):
    """Lines, orders and teams by match, then the parsed payloads by match: four shuffles at most (small sides are broadcast)."""
    for t in ("matches", "participants", "teams"):
        assert shuffles(parse.build_silver(V.payloads(spark, SF).where("dataset = 'matches'"), [t])[t]) <= 4


def test_exact_profile_copies_no_rows(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, None), ("b", 2, None)], "s string, v long, x double")
    one = Q.profile(df, "t", exact=True)
    assert "Expand" not in one._jdf.queryExecution().executedPlan().toString()
    assert {r.column: (r.distinct_values, r.nulls) for r in one.collect()} == {"s": (2, 0), "v": (2, 0), "x": (0, 3)}


def test_references_read_saved_keys(spark):
    """Tables of several references are saved with their keys alone; the checks are the same."""
    rows = {"fact_participant_performance": [("m1", "p1", 1, "d"), ("m2", "p9", 1, None)], "dim_match": [("m1",)]}
    t = {"fact_participant_performance": spark.createDataFrame(rows["fact_participant_performance"], "match_id string, puuid string, champion_id long, game_date string").withColumn("kills", F.lit(1)), "dim_match": spark.createDataFrame(rows["dim_match"], "match_id string").withColumn("x", F.lit(1))}
    t |= {"dim_summoner": spark.createDataFrame([("p1",)], "puuid string")}
    few = Q.narrowed(t)
    assert few["fact_participant_performance"].columns == ["match_id", "puuid", "champion_id", "game_date"] and few["dim_match"].columns == ["match_id"]
    assert same_rows(Q.foreign_keys(few), Q.foreign_keys(t))
