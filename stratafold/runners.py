"""Whole layers in one call: choose the source, build, write, count.

Layout below ``lake``: ``bronze/raw_json``, ``silver/<table>``, ``gold/<table>``.  Each table is counted while it is written, not by another pass.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas as S
from . import scratch
from .functions import parse
from .operators import gold as G
from .operators import relational as R
from .quality import report as Q
from .quality.rules import compiled, results, rules_for
from .sources import files
from .streaming import ingest

DATASETS = tuple(parse.ROUTES)


def _chosen(names: Iterable[str] | None, known: Iterable[str], what: str) -> list[str]:
    known = list(known)
    if unknown := sorted(set(names or ()) - set(known)):
        raise ValueError(f"unknown {what}: {', '.join(unknown)}")
    return [n for n in known if names is None or n in set(names)]


def raw_as_bronze(spark: SparkSession, raw_root: str, datasets: Iterable[str] | None = None, own_time: bool = True) -> DataFrame:
    """Bronze rows straight from raw files, one scan for each dataset folder; a typed empty frame where no folder holds files.

    ``own_time``: files are dated by their own modification time, else by now."""
    out = spark.createDataFrame([], S.BRONZE_SCHEMA)
    when = F.col("modificationTime") if own_time else None
    for d in _chosen(datasets, DATASETS, "dataset"):
        if files.is_there(spark, f"{raw_root}/{d}"):
            rows = files.bronze_rows(files.scan_files(spark, f"{raw_root}/{d}"), raw_root.rstrip("/").rsplit("/", 1)[-1], when)
            out = out.unionByName(rows.withColumn("dataset", F.lit(d)))
    return out


def _write(df: DataFrame, lake: str, layer: str, table: str, fmt: str, checked: dict[str, DataFrame] | None, **options: object) -> int:
    """Write one table; with ``checked`` its row rules are counted by the same write, its keys from the written columns."""
    path, rules = f"{lake}/{layer}/{table}", compiled(df, rules_for(table))
    row_rules = [c.alias(name) for name, c in rules.values.items() if name != "_n"]
    seen: dict = {}
    n = files.write_table(df, path, fmt, observe=tuple(row_rules) if checked is not None else (), observed=seen, **options)
    if checked is not None:
        written = files.read_table(df.sparkSession, path, fmt)
        values = {name: seen.get(name) or 0 for name in rules.values} | {"_n": n}
        one = df.sparkSession.range(1).select(*[F.lit(v).cast("long").alias(name) for name, v in values.items()])
        found = Q.missing_table(df.sparkSession, table) if written is None else results(one, written, rules, table)
        checked[f"{layer}.{table}"] = scratch.saved(found, "checked")
    return n


def run_silver(
    spark: SparkSession, lake: str, source: str = "bronze", raw_root: str | None = None, datasets: Iterable[str] | None = None, tables: Iterable[str] | None = None,
    fmt: str = "parquet", mode: str = "overwrite", partition_by: tuple[str, ...] = ("game_date",), persist: str | None = "DISK_ONLY",
    checked: dict[str, DataFrame] | None = None,
) -> dict[str, int]:
    """Build and write silver tables from ``bronze`` or ``raw``; rows written by table, 0 for tables without input.

    The parsed payloads that several tables share are kept at the storage level ``persist`` (None: parsed for each table) while these tables are
    written.  A table without rows leaves what is there as it is.  ``checked``, a dict, is filled with the results of the tables' rules, which are
    counted while the tables are written; give it to :func:`run_quality`."""
    if source not in ("bronze", "raw"):
        raise ValueError("source must be 'bronze' or 'raw'")
    wanted, allowed = _chosen(tables, S.SILVER, "silver table"), _chosen(datasets, DATASETS, "dataset")
    counts = dict.fromkeys(wanted, 0)
    bronze = ingest.read_bronze(spark, f"{lake}/bronze/raw_json") if source == "bronze" else raw_as_bronze(spark, raw_root or f"{lake}/raw", allowed)
    if bronze is None:
        return counts
    bronze = bronze.where(F.col("dataset").isin(allowed))
    kept: list[DataFrame] | None = [] if persist else None
    todo = [t for d in allowed for t in parse.ROUTES[d] if t in counts]
    try:
        for table, df in parse.build_silver(bronze, todo, keep=kept, level=persist or "NONE").items():
            counts[table] = _write(df, lake, "silver", table, fmt, checked, mode=mode, partition_by=partition_by)
    finally:
        for df in kept or ():
            df.unpersist()
    return counts


def run_gold(
    spark: SparkSession, lake: str, tables: Iterable[str] | None = None, fmt: str = "parquet", mode: str = "overwrite", partition_by: tuple[str, ...] = ("game_date",),
    checked: dict[str, DataFrame] | None = None,
) -> dict[str, int]:
    """Build and write gold tables from the silver ones there are; rows written by table, 0 for tables that lack a source.

    Participants and teams are deduplicated once; where several tables need them they are saved for the run.  With ``mode`` overwrite a table without
    rows replaces what is there.  ``checked`` as in :func:`run_silver`."""
    wanted = _chosen(tables, S.GOLD, "gold table")
    silver = {s: files.read_table(spark, f"{lake}/silver/{s}", fmt) for s in sorted({s for t in wanted for s in G.BUILDERS[t][1]})}
    silver = {s: df for s, df in silver.items() if df is not None}
    counts, once = dict.fromkeys(wanted, 0), {}
    for source, made in (("participants", G.participants), ("teams", G.teams)):
        if source in silver and sum(source in G.BUILDERS[t][1] and not t.startswith("dim_") for t in wanted) > 1:
            once[f"{source}_once"] = scratch.saved(made(silver), f"{source}-once")
    for t, df in G.build(silver, wanted, once)[0].items():
        counts[t] = _write(df, lake, "gold", t, fmt, checked, mode=mode, partition_by=partition_by, write_empty=mode == "overwrite")
    scratch.discard(*once.values())
    return counts


def refresh_silver(spark: SparkSession, lake: str, bronze: DataFrame, tables: Iterable[str] | None = None, fmt: str = "parquet") -> dict[str, list[str]]:
    """Bring silver up to date with the new rows ``bronze``: only the dates they touch are read and written; those dates, by table.

    A date is touched if a new row falls on it, or if it holds an old row of a new row's key: that row is replaced, and may leave its date.  The
    result equals a rebuild from all bronze rows."""
    out = {}
    for table, new in parse.build_silver(bronze, _chosen(tables, S.SILVER, "silver table")).items():
        path, keys = f"{lake}/silver/{table}", S.SILVER_KEYS[table]
        new, old = scratch.saved(new, "refresh"), files.read_table(spark, path, fmt)
        if old is None:
            files.write_table(new, path, fmt, partition_by=("game_date",))
            out[table] = sorted(r[0] for r in new.select("game_date").distinct().collect())
            continue
        same = reduce(lambda a, b: a & b, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys])
        held = old.alias("o").join(new.select(*keys).distinct().alias("n"), same, "left_semi").select("o.game_date")
        dates = sorted(r[0] for r in new.select("game_date").unionAll(held).distinct().collect())
        both = R.union_all([old.where(F.col("game_date").isin(dates)).select(*new.columns), new])
        rows = scratch.saved(R.dedup_latest(both, keys), "refreshed")
        files.write_table(rows, path, fmt, "overwrite", ("game_date",), dates=True)
        for date in set(dates) - {r[0] for r in rows.select("game_date").distinct().collect()}:
            scratch.delete(spark, f"{path}/game_date={date}")  # all its rows have moved to other dates
        out[table] = dates
    return out


#: Gold tables whose rows of a date come from silver rows of that date alone.
BY_DATE = tuple(t for t in G.BUILDERS if t.startswith(("fact_", "mart_")))


def refresh_gold(spark: SparkSession, lake: str, touched: dict[str, list[str]], tables: Iterable[str] | None = None, fmt: str = "parquet") -> dict[str, list[str]]:
    """Facts and marts of the dates that :func:`refresh_silver` touched, made anew from the silver rows of these dates; the dates by table.

    A table that is not there yet is built whole.  Dimensions span all dates and are left to :func:`run_gold`."""
    out = {}
    for t in _chosen(tables, BY_DATE, "table by date"):
        sources = G.BUILDERS[t][1]
        dates = sorted({d for s in sources for d in touched.get(s, ())})
        silver = {s: files.read_table(spark, f"{lake}/silver/{s}", fmt) for s in sources}
        if not dates or any(df is None for df in silver.values()):
            continue
        path = f"{lake}/gold/{t}"
        if files.read_table(spark, path, fmt) is None:
            files.write_table(G.build(silver, [t])[0][t], path, fmt, partition_by=("game_date",))
            out[t] = dates
            continue
        made, _ = G.build({s: df.where(F.col("game_date").isin(dates)) for s, df in silver.items()}, [t])
        files.write_table(made[t], path, fmt, "overwrite", ("game_date",), dates=True)
        left = {r[0] for r in files.read_table(spark, f"{lake}/silver/{sources[0]}", fmt).where(F.col("game_date").isin(dates)).select("game_date").distinct().collect()}
        for date in set(dates) - left:
            scratch.delete(spark, f"{path}/game_date={date}")
        out[t] = dates
    return out


def run_quality(
    spark: SparkSession, lake: str, out: str, run_id: str, layers: Iterable[str] | None = None, tables: dict[str, list[str]] | None = None, fmt: str = "parquet",
    checked: dict[str, DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """Check the tables of the chosen layers and write the report; its sections, read back.

    ``tables`` narrows a layer to some of its tables.  A table that is not there fails ``table_exists``.  ``checked`` holds the
    results that :func:`run_silver` and :func:`run_gold` took while writing; the rules of these tables are not tried again."""
    known = {"silver": list(S.SILVER), "gold": list(S.GOLD)}
    chosen = {layer: _chosen((tables or {}).get(layer), known[layer], f"{layer} table") for layer in _chosen(layers, known, "layer")}
    frames = {layer: {t: files.read_table(spark, f"{lake}/{layer}/{t}", fmt) for t in names} for layer, names in chosen.items()}
    Q.write_report(Q.report(spark, frames, checked), out, run_id)
    return {section: spark.read.json(f"{out}/latest/{section}") for section in (*Q.SECTIONS, "run")}
