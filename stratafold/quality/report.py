"""Foreign keys, profiles, statuses and the report, all as frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import scratch
from ..functions import exprs as X
from .rules import RESULT, compiled, evaluate, results, rules_for

#: Fact, its key columns, dimension and its key columns.
REFERENCES = [
    ("fact_participant_performance", ["match_id"], "dim_match", ["match_id"]), ("fact_participant_performance", ["puuid"], "dim_summoner", ["puuid"]), ("fact_participant_performance", ["champion_id"], "dim_champion", ["champion_id"]),
    ("fact_participant_performance", ["game_date"], "dim_date", ["game_date"]), ("fact_team_objectives", ["match_id"], "dim_match", ["match_id"]), ("fact_team_objectives", ["team_id"], "dim_team", ["team_id"]),
    ("fact_rank_snapshot", ["queue", "tier", "rank"], "dim_rank", ["queue", "tier", "rank"]), ("fact_rank_snapshot", ["puuid"], "dim_summoner", ["puuid"]), ("fact_timeline_frames", ["match_id"], "dim_match", ["match_id"]), ("fact_timeline_events", ["match_id"], "dim_match", ["match_id"]),
]


def distinct_keys(df: DataFrame, columns: list[str], prefix: str) -> DataFrame:
    """Distinct keys without nulls, renamed by position."""
    return df.select(*[F.col(c).alias(f"{prefix}{i}") for i, c in enumerate(columns)]).dropna().distinct()


def foreign_key(fact: DataFrame, keys: list[str], dim: DataFrame, dim_keys: list[str], name: str) -> DataFrame:
    """One row: distinct fact keys, those the dimension lacks, rate and status."""
    f, d = distinct_keys(fact, keys, "f"), distinct_keys(dim, dim_keys, "d")
    same = reduce(lambda a, b: a & b, [F.col(f"f{i}").eqNullSafe(F.col(f"d{i}")) for i in range(len(keys))])
    marked = f.join(d.withColumn("hit", F.lit(True)), same, "left")
    out = marked.agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col("hit").isNull()).alias("orphans"))
    return out.select(F.lit(name).alias("check"), "keys", "orphans", F.coalesce(F.round(F.try_divide("orphans", "keys"), 6), F.lit(0.0)).alias("orphan_rate"), F.when(F.col("orphans") > 0, "WARN").otherwise("PASS").alias("status"))


def narrowed(tables: dict[str, DataFrame], references: list[tuple] = REFERENCES) -> dict[str, DataFrame]:
    """``tables`` with those that several references read saved with the columns of these references alone, so each is built once."""
    used: dict[str, list[tuple]] = {}
    for fact, keys, dim, dim_keys in references:
        used.setdefault(fact, []).append(tuple(keys))
        used.setdefault(dim, []).append(tuple(dim_keys))
    columns = {t: list(dict.fromkeys(c for key in keys for c in key)) for t, keys in used.items() if t in tables and len(keys) > 1}
    return tables | {t: scratch.saved(tables[t].select(*names), "keys") for t, names in columns.items()}


def foreign_keys(tables: dict[str, DataFrame], references: list[tuple] = REFERENCES) -> DataFrame:
    """All references whose tables are there; SKIP for the others."""
    out = []
    for fact, keys, dim, dim_keys in references:
        name = f"{fact}({','.join(keys)})->{dim}"
        if fact in tables and dim in tables:
            out.append(foreign_key(tables[fact], keys, tables[dim], dim_keys, name))
        else:
            spark = next(iter(tables.values())).sparkSession
            out.append(spark.range(1).select(F.lit(name).alias("check"), F.lit(0).cast("long").alias("keys"), F.lit(0).cast("long").alias("orphans"), F.lit(0.0).alias("orphan_rate"), F.lit("SKIP").alias("status")))
    return reduce(DataFrame.unionAll, out)


def row_alignment(dim: DataFrame, silver: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """WARN if the row counts differ by more than ``tolerance`` of silver's."""
    d, s = dim.agg(F.count(F.lit(1)).alias("dim_rows")), silver.agg(F.count(F.lit(1)).alias("silver_rows"))
    gap = F.coalesce(F.try_divide(F.abs(F.col("dim_rows") - F.col("silver_rows")), F.col("silver_rows")), F.lit(0.0))
    return d.crossJoin(s).select("dim_rows", "silver_rows", F.when(gap > tolerance, "WARN").otherwise("PASS").alias("status"))


_PROFILE = "table string, column string, type string, nulls bigint, null_ratio double, distinct_values bigint, empty_strings bigint, min_value double, max_value double, avg_value double"


def profile_parts(df: DataFrame, exact: bool = False) -> tuple[list[Column], list[Column]]:
    """Aggregates of all columns of ``df`` (besides its number of rows, ``_n``), and from these a row for each column.  With ``exact`` the numbers of
    distinct values are not among them: :func:`profile` counts these by groupings."""
    aggs, rows = [], []
    for i, f in enumerate(df.schema):
        c, number, text = F.col(f"`{f.name}`"), isinstance(f.dataType, T.NumericType), isinstance(f.dataType, T.StringType)
        aggs += [] if exact else [F.approx_count_distinct(c).alias(f"d{i}")]
        aggs += [F.count_if(c.isNull()).alias(f"n{i}"), (F.count_if(F.trim(c) == "") if text else F.max(F.lit(0))).alias(f"e{i}")]
        aggs += [fn(c).cast("double").alias(f"{k}{i}") for k, fn in (("lo", F.min), ("hi", F.max), ("av", F.avg))] if number else []
        stats = [(F.col(f"{k}{i}") if number else F.lit(None).cast("double")).alias(name) for k, name in (("lo", "min_value"), ("hi", "max_value"), ("av", "avg_value"))]
        ratio = F.coalesce(F.round(F.try_divide(f"n{i}", "_n"), 6), F.lit(0.0)).alias("null_ratio")
        empty = F.coalesce(F.col(f"e{i}"), F.lit(0)).cast("long").alias("empty_strings")
        kind = F.lit(f.dataType.simpleString()).alias("type")
        rows.append(F.struct(F.lit(f.name).alias("column"), kind, F.col(f"n{i}").alias("nulls"), ratio, F.col(f"d{i}").alias("distinct_values"), empty, *stats))
    return aggs, rows


def profile(df: DataFrame, table: str, exact: bool = False) -> DataFrame:
    """One row per column: type, nulls, ratio, distinct values, empty strings, and min, max, mean of numbers.  One aggregation;
    distinct values are approximate unless ``exact``: then each column is grouped for itself, as one aggregation of all would copy every row for
    each column and hold keys as wide as the table."""
    aggs, rows = profile_parts(df, exact)
    one = df.agg(F.count(F.lit(1)).alias("_n"), *aggs)
    return _profiled(reduce(DataFrame.crossJoin, [one, *distinct_counts(df)]) if exact else one, rows, table)  # one row with one row


def distinct_counts(df: DataFrame) -> list[DataFrame]:
    """For each column a row with its number of distinct values, nulls aside, as ``d0``, ``d1``, ..."""
    return [df.select(F.col(f"`{c}`").alias("v")).distinct().agg(F.count("v").alias(f"d{i}")) for i, c in enumerate(df.columns)]


def _profiled(one: DataFrame, rows: list[Column], table: str) -> DataFrame:
    return one.select(F.explode(F.array(*rows)).alias("x")).select(F.lit(table).alias("table"), "x.*")


def rows_by_date(df: DataFrame, column: str = "game_date") -> DataFrame:
    """Rows of each date (null is one): what :func:`date_coverage` and :func:`top_dates` are made from, so that one reading serves both."""
    return df.groupBy(F.col(column).alias("date")).agg(F.count(F.lit(1)).alias("n"))


def date_coverage(by_date: DataFrame) -> DataFrame:
    """First and last date, and their number, of :func:`rows_by_date`."""
    return by_date.agg(F.min("date").alias("min_date"), F.max("date").alias("max_date"), F.count("date").alias("dates"))


def top_dates(by_date: DataFrame, column: str = "game_date", limit: int = 20) -> DataFrame:
    """The dates of most rows, of :func:`rows_by_date`; ties by date."""
    return by_date.where("date is not null").select(F.col("date").alias(column), "n").orderBy(F.desc("n"), column).limit(limit)


def missing_table(spark: SparkSession, name: str) -> DataFrame:
    """The one check of a table that is not there."""
    nothing = "0L AS failed_rows", "0L AS total_rows", "0D AS failed_rate", "CAST(NULL AS STRING) AS detail"
    return spark.range(1).selectExpr(f"'{name}' AS table", "'table_exists' AS rule", "'FAIL' AS status", *nothing)


def check_tables(tables: dict[str, DataFrame | None], spark: SparkSession) -> DataFrame:
    """All rules of all tables; a table that is None fails ``table_exists``."""
    return reduce(DataFrame.unionAll, [missing_table(spark, name) if df is None else evaluate(df, name, rules_for(name)) for name, df in tables.items()])


def _severity() -> Column:
    return F.when(F.col("status") == "FAIL", 2).when(F.col("status") == "WARN", 1).otherwise(0)


def table_status(checks: DataFrame) -> DataFrame:
    """PASS, WARN or FAIL of each table; skipped checks do not count."""
    worst = checks.groupBy("table").agg(F.max(_severity()).alias("w"))
    return worst.select("table", F.element_at(F.array(F.lit("PASS"), F.lit("WARN"), F.lit("FAIL")), F.col("w") + 1).alias("status"))


def summary(checks: DataFrame) -> DataFrame:
    """Grade of all tables together with counts and a recommendation; the checks are read once."""
    absent = F.max(((F.col("rule") == "table_exists") & (F.col("status") == "FAIL")).cast("int"))
    t = checks.groupBy("table").agg(F.max(_severity()).alias("w"), absent.alias("absent"))
    named = {"tables_passed": 0, "tables_warned": 1, "tables_failed": 2}
    counts = [F.count_if(F.col("w") == w).alias(name) for name, w in named.items()]
    out = t.agg(F.count(F.lit(1)).alias("tables_expected"), *counts, F.coalesce(F.sum("absent"), F.lit(0)).alias("tables_missing"))
    grade = F.when(F.col("tables_failed") > 0, "FAIL").when(F.col("tables_warned") > 0, "READY_WITH_WARNINGS").otherwise("READY")
    advice = F.when(grade == "FAIL", "Mend the failed checks before use.").when(grade == "READY", "Fit for use.").otherwise("Fit for use; look at the warnings.")
    return out.select("*", (F.col("tables_expected") - F.col("tables_missing")).alias("tables_analysed"), grade.alias("status"), (grade != "FAIL").alias("ready"), advice.alias("recommendation"))


def issues(checks: DataFrame) -> DataFrame:
    return checks.where(F.col("status").isin("FAIL", "WARN")).select("table", "rule", "status", F.to_json(F.struct("failed_rows", "total_rows", "failed_rate", "detail")).alias("details"))


def check_counts(checks: DataFrame) -> DataFrame:
    return checks.groupBy("status").agg(F.count("*").alias("n"))


def score(checks: DataFrame, *by: str) -> DataFrame:
    """Share of checks passed, skipped ones aside, by the columns ``by`` (such as a run's id)."""
    out = checks.groupBy(*by).agg(F.count_if(F.col("status") == "PASS").alias("passed"), F.count_if(F.col("status") != "SKIP").alias("total"))
    return out.withColumn("score", X.quality_score("passed", "total"))


def missing_keys(df: DataFrame, row_id: str, required: list[str]) -> DataFrame:
    """(row, field) of required fields that are missing or null."""
    absent = [F.when(F.col(c).isNull() if c in df.columns else F.lit(True), F.lit(c)) for c in required]
    return df.select(F.col(row_id).alias("row"), F.explode(F.array_compact(F.array(*absent))).alias("field"))


#: Parts of a report; each is a table of its own.
SECTIONS = ("checks", "tables", "summary", "issues", "profiles", "coverage", "dates", "references", "alignment")


def report(spark: SparkSession, layers: dict[str, dict[str, DataFrame | None]], checked: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The sections of a report on tables by layer (a table that is not there is None).

    ``checks`` (rules and, with the gold layer, references and alignment as warnings), ``tables`` (status and rows), ``summary``, ``issues``,
    ``profiles`` of columns, ``coverage`` and most frequent ``dates`` of tables with a game date, ``references`` between gold tables, ``alignment``
    of the match dimension with silver matches.  Sections without rows keep their columns.

    A table is read whole once, for its row rules and its profile together; besides, each key rule and the dates read their own columns.  These
    results are saved, and all sections are made from them.  ``checked`` holds results, by ``layer.table``, that a run took while it wrote the
    tables (see :mod:`stratafold.runners`); the rules of those are not tried again."""
    checks, profiles, coverage, dates = [], [], [], []
    for layer, tables in layers.items():
        named = lambda df, at=layer: df.select(F.lit(at).alias("layer"), "*")
        for t, df in tables.items():
            if df is None:
                checks.append(named(missing_table(spark, t)))
                continue
            known = (checked or {}).get(f"{layer}.{t}")
            rules = compiled(df, rules_for(t)) if known is None else None
            aggs, rows = profile_parts(df)
            one = scratch.saved(df.agg(*(rules.aggregates if rules else [F.count(F.lit(1)).alias("_n")]), *aggs), "facts")
            checks.append(named(known if rules is None else results(one, df, rules, t)))
            profiles.append(named(_profiled(one, rows, t)))
            if "game_date" in df.columns:
                by_date = scratch.saved(rows_by_date(df), "dates")
                coverage.append(named(date_coverage(by_date).select(F.lit(t).alias("table"), "*")))
                dates.append(named(top_dates(by_date).select(F.lit(t).alias("table"), "*")))
    gold = {t: df for t, df in layers.get("gold", {}).items() if df is not None}
    matches = layers.get("silver", {}).get("matches")
    references = [scratch.saved(foreign_keys(gold), "references")] if gold else []
    alignment = [scratch.saved(row_alignment(gold["dim_match"], matches), "alignment")] if "dim_match" in gold and matches is not None else []
    of_rows = lambda df, bad, total, rate: df.select(F.lit("gold").alias("layer"), *bad, "status", *total, rate)
    nothing = F.lit(None).cast("string")
    for r in references:
        name = [F.element_at(F.split("check", r"\(", 2), 1).alias("table"), F.concat(F.lit("reference "), "check").alias("rule")]
        counts = [F.col("orphans").alias("failed_rows"), F.col("keys").alias("total_rows")]
        checks.append(of_rows(r, name, counts, F.col("orphan_rate").alias("failed_rate")).withColumn("detail", nothing))
    for r in alignment:
        name, gap = [F.lit("dim_match").alias("table"), F.lit("silver_match_row_count_alignment").alias("rule")], F.abs(F.col("dim_rows") - F.col("silver_rows"))
        counts = [gap.alias("failed_rows"), F.col("silver_rows").alias("total_rows")]
        checks.append(of_rows(r, name, counts, F.coalesce(F.round(F.try_divide(gap, "silver_rows"), 6), F.lit(0.0)).alias("failed_rate")).withColumn("detail", nothing))
    layered = "layer string, "
    every = scratch.saved(_together(spark, checks, layered + RESULT), "checks")
    named = every.withColumn("table", F.concat_ws(".", "layer", "table")).drop("layer")
    status = table_status(named).join(named.groupBy("table").agg(F.max(F.when(F.col("rule") == "table_not_empty", F.col("total_rows"))).alias("rows")), "table")
    return {
        "checks": every, "tables": status, "summary": summary(named), "issues": issues(named), "profiles": _together(spark, profiles, layered + _PROFILE),
        "coverage": _together(spark, coverage, layered + "table string, min_date string, max_date string, dates bigint"),
        "dates": _together(spark, dates, layered + "table string, game_date string, n bigint"),
        "references": _together(spark, references, "check string, keys bigint, orphans bigint, orphan_rate double, status string"),
        "alignment": _together(spark, alignment, "dim_rows bigint, silver_rows bigint, status string"),
    }


def _together(spark: SparkSession, frames: list[DataFrame], ddl: str) -> DataFrame:
    return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], ddl)


def write_report(sections: dict[str, DataFrame], path: str, run_id: str) -> None:
    """Each section as JSON, once under ``runs/<section>/run_id=...`` and once under ``latest/<section>``, and ``run`` beside them: the run's id,
    its time, and the layers and number of tables it looked at."""
    spark = next(iter(sections.values())).sparkSession
    about = sections["checks"].where("rule not like 'reference %'").agg(F.array_sort(F.collect_set("layer")).alias("layers"), F.count_distinct("layer", "table").alias("tables"))
    run = about.select(F.lit(run_id).alias("id"), F.current_timestamp().alias("at"), "layers", "tables")
    for name, df in (sections | {"run": run}).items():
        at = f"{path}/runs/{name}/run_id={run_id}"
        df.write.mode("overwrite").json(at)
        spark.read.schema(df.schema).json(at).write.mode("overwrite").json(f"{path}/latest/{name}")


def scores(spark: SparkSession, path: str) -> DataFrame:
    """The score of every run that was written below ``path``, by run."""
    return score(spark.read.json(f"{path}/runs/checks"), "run_id")
